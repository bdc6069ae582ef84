"""Processing status: flags that an operator needs before, and sets after, it is applied."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace


class StatusError(RuntimeError):
    """Data are not in the state that an operator needs."""


@dataclass(frozen=True)
class Status:
    extra: dict[str, bool] = field(default_factory=dict)

    def flags(self) -> dict[str, bool]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name != "extra"} | self.extra

    def check(self, needed: Status) -> None:
        """Raise unless every flag set in ``needed`` is set here."""
        mine = self.flags()
        gone = [k for k, v in needed.flags().items() if v and not mine.get(k)]
        if gone:
            raise StatusError(f"needed first: {', '.join(gone)}")

    def update(self, made: Status) -> Status:
        """Flags of both."""
        names = [f.name for f in fields(self) if f.name != "extra"]
        new = {k: getattr(self, k) or getattr(made, k, False) for k in names}
        extra = {k: self.extra.get(k, False) or made.extra.get(k, False) for k in {*self.extra, *made.extra}}
        return replace(self, **new, extra=extra)


@dataclass(frozen=True)
class SampleStatus(Status):
    roi_extracted: bool = False
    feature_extracted: bool = False
    isotopologue_annotated: bool = False


@dataclass(frozen=True)
class AssayStatus(Status):
    samples_processed: bool = False
    feature_matched: bool = False
    missing_imputed: bool = False


@dataclass(frozen=True)
class MatrixStatus(Status):
    missing_imputed: bool = False
    corrected: bool = False
    normalized: bool = False
