"""mzML as a Spark data source: ``spark.read.format("mzml").load(path)`` gives one row for each spectrum.

Each file is an input partition; large files are cut into ranges of spectra by the byte offsets of their index, or of
a scan for tags where there is none. Filters on ``ms_level`` and ``time`` are taken before arrays are decoded.
"""

from __future__ import annotations

import base64
import glob
import os
import re
import xml.etree.ElementTree as ET
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, LessThan

SPECTRUM = "sample_id string, scan int, ms_level int, polarity int, time double, centroid boolean, mz array<double>, intensity array<double>"
CHROMATOGRAM = "sample_id string, index int, name string, time array<double>, intensity array<double>"

# Controlled-vocabulary accessions of the format.
MZ, INTENSITY, TIME = "MS:1000514", "MS:1000515", "MS:1000595"
ZLIB, PLAIN = "MS:1000574", "MS:1000576"
DTYPES = {"MS:1000519": "<i4", "MS:1000520": "<f2", "MS:1000521": "<f4", "MS:1000522": "<i8", "MS:1000523": "<f8"}
MS_LEVEL, SCAN_TIME, CENTROID, POSITIVE, NEGATIVE = "MS:1000511", "MS:1000016", "MS:1000127", "MS:1000130", "MS:1000129"
MINUTES = {"minute", "UO:0000031"}


class MZMLError(ValueError):
    """A file that cannot be read."""


def find_offsets(path: str, kind: str = "spectrum", rebuild: bool = False) -> list[int]:
    """Byte offsets of spectra or chromatograms, from the file's index, else by a scan in blocks."""
    with open(path, "rb") as f:
        if not rebuild:
            f.seek(0, os.SEEK_END)
            size = f.tell()
            f.seek(max(0, size - 4096))
            m = re.search(rb"<indexListOffset>(\d+)</indexListOffset>", f.read())
            if m:
                f.seek(int(m[1]))
                part = re.search(rb'<index name="' + kind.encode() + rb'">(.*?)</index>', f.read(), re.S)
                return [int(x) for x in re.findall(rb"<offset[^>]*>(\d+)</offset>", part[1])] if part else []
        tag, out, base, rest = b"<" + kind.encode() + b" ", [], 0, b""
        f.seek(0)
        while block := f.read(1 << 22):
            data = rest + block
            out += [base - len(rest) + m.start() for m in re.finditer(re.escape(tag), data)]
            base += len(block)
            rest = data[-(len(tag) - 1) :]
        return sorted(set(out))


def element_at(f, offset: int, kind: str) -> ET.Element:
    """The element that begins at an offset."""
    f.seek(offset)
    end, data = f"</{kind}>".encode(), b""
    while end not in data:
        block = f.read(1 << 16)
        if not block:
            raise MZMLError(f"the file ends inside a {kind}")
        data += block
    return ET.fromstring(data[: data.index(end) + len(end)])


def params(e: ET.Element) -> dict[str, ET.Element]:
    return {x.get("accession"): x for x in e.iter("cvParam")}


def decode_array(e: ET.Element) -> tuple[str | None, np.ndarray]:
    """Kind (accession) and values of a binary array; times come in seconds."""
    p = params(e)
    text = (e.findtext("binary") or "").strip()
    kind = next((k for k in (MZ, INTENSITY, TIME) if k in p), None)
    dtype = next((DTYPES[k] for k in p if k in DTYPES), None)
    if dtype is None:
        raise MZMLError("a binary array has no known data type")
    if ZLIB not in p and PLAIN not in p:
        raise MZMLError("the compression of a binary array is not supported")
    raw = base64.b64decode(text)
    values = np.frombuffer(zlib.decompress(raw) if ZLIB in p and raw else raw, dtype).astype(float)
    if kind == TIME and (p[TIME].get("unitName") in MINUTES or p[TIME].get("unitAccession") in MINUTES):
        values = values * 60
    return kind, values


def parse_spectrum(e: ET.Element, wanted=lambda level, time: True) -> dict | None:
    """A spectrum as a dict; None if its header is not wanted, and then its arrays are not decoded."""
    p = params(e)
    level = int(p[MS_LEVEL].get("value")) if MS_LEVEL in p else 1
    t = p.get(SCAN_TIME)
    time = float(t.get("value")) * (60 if t.get("unitName") in MINUTES or t.get("unitAccession") in MINUTES else 1) if t is not None else None
    if not wanted(level, time):
        return None
    arrays = dict(decode_array(a) for a in e.iter("binaryDataArray"))
    polarity = 1 if POSITIVE in p else -1 if NEGATIVE in p else None
    return {"scan": int(e.get("index")), "ms_level": level, "polarity": polarity, "time": time, "centroid": CENTROID in p, "mz": arrays.get(MZ, np.zeros(0)), "intensity": arrays.get(INTENSITY, np.zeros(0))}


def parse_chromatogram(e: ET.Element) -> dict:
    arrays = dict(decode_array(a) for a in e.iter("binaryDataArray"))
    return {"index": int(e.get("index")), "name": e.get("id"), "time": arrays.get(TIME, np.zeros(0)), "intensity": arrays.get(INTENSITY, np.zeros(0))}


class Range(InputPartition):
    def __init__(self, path: str, offsets: list[int]):
        self.path, self.offsets = path, offsets


class MZMLSource(DataSource):
    """Options: ``kind`` (spectrum or chromatogram), ``chunk`` (spectra of a partition), ``rebuild_index``,
    ``pushdown`` (needs ``spark.sql.python.filterPushdown.enabled``; ``load`` sees to both)."""

    @classmethod
    def name(cls) -> str:
        return "mzml"

    def schema(self) -> str:
        return CHROMATOGRAM if self.options.get("kind") == "chromatogram" else SPECTRUM

    def reader(self, schema) -> DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else MZMLSourceReader)(self.options)


class MZMLSourceReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"].removeprefix("file://")
        self.files = sorted(glob.glob(f"{path}/*.[mM][zZ][mM][lL]")) if os.path.isdir(path) else sorted(glob.glob(path))
        if not self.files:
            raise MZMLError(f"no file at {path}")
        self.kind, self.chunk, self.rebuild = options.get("kind", "spectrum"), int(options.get("chunk", 1000)), options.get("rebuild_index", "false") == "true"
        self.level, self.lo, self.hi = None, float("-inf"), float("inf")

    def partitions(self):
        out = []
        for path in self.files:
            offsets = find_offsets(path, self.kind, self.rebuild)
            out += [Range(path, offsets[k : k + self.chunk]) for k in range(0, len(offsets), self.chunk)]
        return out

    def read(self, part: Range) -> Iterator[tuple]:
        sample = os.path.splitext(os.path.basename(part.path))[0]
        wanted = lambda level, time: (self.level is None or level == self.level) and (time is None or self.lo <= time < self.hi)
        with open(part.path, "rb") as f:
            for offset in part.offsets:
                e = element_at(f, offset, self.kind)
                if self.kind == "chromatogram":
                    c = parse_chromatogram(e)
                    yield sample, c["index"], c["name"], c["time"].tolist(), c["intensity"].tolist()
                elif (s := parse_spectrum(e, wanted)) is not None:
                    yield sample, s["scan"], s["ms_level"], s["polarity"], s["time"], s["centroid"], s["mz"].tolist(), s["intensity"].tolist()


class PushingReader(MZMLSourceReader):
    """Takes filters on ms_level and time before arrays are decoded."""

    def pushFilters(self, filters):
        for f in filters:
            at = f.attribute
            if self.kind == "spectrum" and isinstance(f, EqualTo) and at == ("ms_level",):
                self.level = f.value
            elif self.kind == "spectrum" and isinstance(f, GreaterThanOrEqual) and at == ("time",):
                self.lo = max(self.lo, f.value)
            elif self.kind == "spectrum" and isinstance(f, LessThan) and at == ("time",):
                self.hi = min(self.hi, f.value)
            else:
                yield f


class MZMLFile:
    """Random access to one file."""

    def __init__(self, path: str, rebuild_index: bool = False):
        self.path = path
        self._at = {k: find_offsets(path, k, rebuild_index) for k in ("spectrum", "chromatogram")}

    @property
    def n_spectra(self) -> int:
        return len(self._at["spectrum"])

    @property
    def n_chromatograms(self) -> int:
        return len(self._at["chromatogram"])

    def _get(self, kind: str, i: int) -> ET.Element:
        with open(self.path, "rb") as f:
            return element_at(f, self._at[kind][i], kind)

    def get_spectrum(self, i: int) -> dict:
        return parse_spectrum(self._get("spectrum", i))

    def get_chromatogram(self, i: int) -> dict:
        return parse_chromatogram(self._get("chromatogram", i))


#: Readers by name and file suffix; more can be added.
READERS: dict[str, type[DataSource]] = {"mzml": MZMLSource}


def register_reader(name: str, source: type[DataSource]) -> None:
    READERS[name.lower()] = source


def load(spark: SparkSession, path: str, reader: str | None = None, **options):
    """Read by a named reader, or by the one of the path's suffix."""
    name = (reader or os.path.splitext(path)[1].lstrip(".") or "mzml").lower()
    if name not in READERS:
        raise KeyError(f"no reader {name!r}")
    spark.dataSource.register(READERS[name])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    options.setdefault("pushdown", "true")
    return spark.read.format(READERS[name].name()).options(**options).load(path)


def write(path: str, spectra: list[dict], chromatograms: list[dict] = (), indexed: bool = True, compress: bool = True) -> None:
    """A small mzML file, for tests and exchange."""

    def array(kind: str, values, unit: str = "") -> str:
        raw = np.asarray(values, "<f8").tobytes()
        raw = zlib.compress(raw) if compress else raw
        how = ZLIB if compress else PLAIN
        return f'<binaryDataArray><cvParam accession="MS:1000523"/><cvParam accession="{how}"/><cvParam accession="{kind}"{unit}/><binary>{base64.b64encode(raw).decode()}</binary></binaryDataArray>'

    out, at = ['<?xml version="1.0" encoding="utf-8"?>\n<mzML><run><spectrumList>'], {"spectrum": [], "chromatogram": []}

    def put(kind: str, text: str) -> None:
        at[kind].append(len("\n".join(out).encode()) + 1)
        out.append(text)

    for k, s in enumerate(spectra):
        mode = f'<cvParam accession="{CENTROID}"/>' if s.get("centroid", True) else ""
        head = f'<cvParam accession="{MS_LEVEL}" value="{s.get("ms_level", 1)}"/><cvParam accession="{POSITIVE}"/>{mode}<cvParam accession="{SCAN_TIME}" value="{s["time"] / 60!r}" unitName="minute"/>'
        put("spectrum", f'<spectrum index="{k}" id="scan={k}">{head}{array(MZ, s["mz"])}{array(INTENSITY, s["intensity"])}</spectrum>')
    out.append("</spectrumList><chromatogramList>")
    for k, c in enumerate(chromatograms):
        put("chromatogram", f'<chromatogram index="{k}" id="{c["name"]}">{array(TIME, np.asarray(c["time"]) / 60, " unitName=" + chr(34) + "minute" + chr(34))}{array(INTENSITY, c["intensity"])}</chromatogram>')
    out.append("</chromatogramList></run></mzML>")
    text = "\n".join(out)
    if indexed:
        start = len(text.encode()) + 1
        index = "".join(f'<index name="{k}">' + "".join(f"<offset>{o}</offset>" for o in v) + "</index>" for k, v in at.items())
        text += f"\n<indexList>{index}</indexList><indexListOffset>{start}</indexListOffset>"
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
