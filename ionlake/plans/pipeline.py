"""Operators and pipelines: status checks, hooks, serialisation, equality.

Operators are frozen dataclasses, so their parameters are never changed by running them. One pipeline holds operators
(or pipelines) of one tier: sample, assay or matrix.
"""

from __future__ import annotations

import copy
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, fields, replace
from typing import Any, ClassVar

from ionlake.plans.status import AssayStatus, MatrixStatus, SampleStatus, Status

#: Operator classes by name, for reading a serialised pipeline.
OPERATORS: dict[str, type[Operator]] = {}
NO_STATUS = {"sample": SampleStatus(), "assay": AssayStatus(), "matrix": MatrixStatus()}


@dataclass(frozen=True)
class Operator:
    """Something that maps data with a ``status`` field to new data; subclasses define ``run``.

    ``needs`` and ``makes`` are the status flags before and after. ``before`` and ``after`` are hooks that see the data.
    """

    id: str = ""
    tier: ClassVar[str] = "matrix"
    needs: ClassVar[Status | None] = None
    makes: ClassVar[Status | None] = None
    presets: ClassVar[dict[str, dict]] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        OPERATORS[cls.__name__] = cls

    @classmethod
    def from_defaults(cls, preset: str = "default", **kw):
        """The operator with the parameters of a named preset, some of them replaced."""
        if preset != "default" and preset not in cls.presets:
            raise ValueError(f"{cls.__name__} has no preset {preset!r}")
        return cls(**(cls.presets.get(preset, {}) | kw))

    def run(self, data: Any) -> Any:
        raise NotImplementedError

    def before(self, data: Any) -> None:
        """Called with the data before ``run``."""

    def after(self, data: Any) -> None:
        """Called with the result after ``run``."""

    def required(self) -> Status:
        return self.needs or NO_STATUS[self.tier]

    def produced(self) -> Status:
        return self.makes or NO_STATUS[self.tier]

    def apply(self, data: Any) -> Any:
        data.status.check(self.required())
        self.before(data)
        out = self.run(data)
        out = replace(out, status=out.status.update(self.produced()))
        self.after(out)
        return out

    def to_dict(self) -> dict:
        return {"class": type(self).__name__} | {k: v for k, v in asdict(self).items() if not callable(v)}

    def flow(self, status: Status) -> Status:
        status.check(self.required())
        return status.update(self.produced())


@dataclass
class Pipeline:
    """Steps of one tier, applied in order."""

    id: str = "pipeline"
    steps: list[Operator | Pipeline] = field(default_factory=list)

    @property
    def tier(self) -> str | None:
        return self.steps[0].tier if self.steps else None

    def add_operator(self, step: Operator | Pipeline) -> Pipeline:
        if isinstance(step, Pipeline) and not step.steps:
            raise ValueError("an empty pipeline cannot be a step")
        if self.tier and step.tier != self.tier:
            raise ValueError(f"a step of tier {step.tier} does not fit tier {self.tier}")
        if not step.id:
            name, used = type(step).__name__, self.list_operator_ids()
            new = next(n for n in (name, *(f"{name}-{k}" for k in range(2, len(used) + 3))) if n not in used)
            step = replace(step, id=new)
        if step.id in self.list_operator_ids():
            raise ValueError(f"there is a step {step.id!r} already")
        self.steps.append(step)
        return self

    def apply(self, data: Any) -> Any:
        for step in self.steps:
            data = step.apply(data)
        return data

    def flow(self, status: Status) -> Status:
        for step in self.steps:
            status = step.flow(status)
        return status

    def validate_dataflow(self, status: Status | None = None) -> Status:
        """Check that each step's needs are met by what comes before, without touching data."""
        if not self.steps:
            raise ValueError("the pipeline has no steps")
        return self.flow(status or NO_STATUS[self.tier])

    def list_operator_ids(self) -> list[str]:
        return [s.id for s in self.steps]

    def get_operator(self, id: str) -> Operator | Pipeline:
        for s in self.steps:
            if s.id == id:
                return s
        raise KeyError(id)

    def copy(self) -> Pipeline:
        return copy.deepcopy(self)

    def serialize(self) -> dict:
        return {"class": "Pipeline", "id": self.id, "steps": [s.serialize() if isinstance(s, Pipeline) else s.to_dict() for s in self.steps]}

    @classmethod
    def deserialize(cls, data: dict) -> Pipeline:
        out = cls(data["id"])
        for s in data["steps"]:
            if s["class"] == "Pipeline":
                out.add_operator(cls.deserialize(s))
                continue
            kind = OPERATORS.get(s["class"])
            if kind is None:
                raise KeyError(f"no operator class {s['class']!r}")
            known = {f.name for f in fields(kind)}
            out.add_operator(kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items() if k in known}))
        return out


@dataclass(frozen=True)
class FunctionOperator(Operator):
    """An operator from a plain function of the data; for use with custom code, not serialisable."""

    fn: Callable[[Any], Any] | None = None

    def run(self, data: Any) -> Any:
        return self.fn(data)
