"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may be found with up to k edits. Cut into k + 1 pieces, at least one piece is unharmed by k
edits, so all places worth a look are exact hits of a piece, found for all items in one pass of an Aho-Corasick
automaton. Around each hit, Myers' bit-parallel algorithm gives the least edit distance of the item to a
part of the text. Items are processed in blocks of bounded size, so what is broadcast is bounded.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Written, sliced, trimmed

#: Share of an item's characters that may be edited.
EDIT_RATE = 0.08
#: Items with fewer characters, after folding, must be found without an edit, and as whole words.
EXACT_UNDER = 40
#: Items with fewer characters, after folding, hold nothing to search for.
MIN_CHARS = 1
#: Characters of items searched for at once; each block is broadcast, and its automaton takes about 100 bytes for each.
BLOCK_CHARS = 1_000_000
#: Blocks broadcast for one pass over the documents; a longer benchmark takes further passes, with written results.
PASS_BLOCKS = 8
#: Bytes of documents that a task holds while it goes through several blocks.
GROUP_BYTES = 64 << 20


def fold(text: str | None) -> str:
    """Lower case with runs of white space as one space: what matching sees of a text."""
    return " ".join((text or "").lower().split())


def budget(m: int, rate: float = EDIT_RATE) -> int:
    """Edits allowed for an item of ``m`` characters."""
    return math.floor(m * rate) if m >= EXACT_UNDER else 0


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether no word goes on beyond either end of ``text[a:b]``; scripts without blanks have no such words."""
    return not any(0 < i < len(text) and text[i - 1].isalnum() and text[i].isalnum() and max(text[i - 1], text[i]) < "\u2e80" for i in (a, b))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """``k`` + 1 pieces of an item that cover it, with their places."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def myers_masks(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def myers(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of a pattern to any part of ``text``, and the first place where such a part ends."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get = masks.get
    for j, c in enumerate(text, 1):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, end = score, j
        ph = ph << 1 & full
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
    return best, end


class Searcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = items
        self.k = [budget(len(t), rate) for _, t in items]
        self.masks = [myers_masks(t) for _, t in items]
        found: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t) in enumerate(items):
            for at, piece in pieces(t, self.k[n]):
                found.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, places in found.items():
            self.automaton.add_word(piece, (len(piece), places))
        if found:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end) in a folded text for each item within its budget, nearest place first."""
        if not text or not self.items:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (size, places) in self.automaton.iter(text):
            for n, at in places:
                begin, k = end + 1 - size - at, self.k[n]
                if len(self.items[n][1]) < EXACT_UNDER and not whole_words(text, begin, end + 1):
                    continue
                windows.setdefault(n, []).append((max(0, begin - k), min(len(text), begin + len(self.items[n][1]) + k)))
        out = []
        for n, spans in windows.items():
            item_id, item = self.items[n]
            best, where = len(item), 0
            spans.sort()
            a, b = spans[0]
            for x, y in [*spans[1:], (len(text) + 1, 0)]:
                if x <= b:
                    b = max(b, y)
                    continue
                d, e = myers(self.masks[n], len(item), text[a:b])
                if d < best:
                    best, where = d, a + e
                a, b = x, y
            if best <= self.k[n]:
                out.append((item_id, best, where))
        return out


_SEARCHERS: dict[str, Searcher] = {}


def _blocks(items: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """Folded items in blocks of bounded size, one block on the driver at a time."""
    block, size = [], 0
    for row in items.select("item_id", F.col("text").cast("string")).toLocalIterator():
        text = fold(row[1])
        if row[0] is None or len(text) < MIN_CHARS:
            continue
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((int(row[0]), text))
        size += len(text)
    if block:
        yield block


def _passes(spark, benchmark: DataFrame, most: int, rate: float) -> Iterator[Finder]:
    """Finders of up to PASS_BLOCKS blocks each."""
    blocks = []
    for block in _blocks(benchmark, most):
        blocks.append(spark.sparkContext.broadcast(block))
        if len(blocks) == PASS_BLOCKS:
            yield Finder(blocks, rate)
            blocks = []
    if blocks:
        yield Finder(blocks, rate)


class Finder:
    """Finds the items of some blocks in batches of documents; one automaton is held at a time."""

    def __init__(self, blocks: list, rate: float):
        self.blocks, self.rate, self.key = blocks, rate, uuid.uuid4().hex

    def _searcher(self, k: int) -> Searcher:
        key = f"{self.key}/{k}"
        if key not in _SEARCHERS:
            _SEARCHERS.clear()
            _SEARCHERS[key] = Searcher(self.blocks[k].value, self.rate)
        return _SEARCHERS[key]

    def run(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[int, int, int]]]]]:
        """Each batch with what was found in each of its texts."""
        held, size = [], 0
        for b in sliced(batches):
            held.append(b)
            size += b.nbytes
            if len(self.blocks) == 1 or size > GROUP_BYTES:
                yield from self._group(held)
                held, size = [], 0
        yield from self._group(held)

    def _group(self, held: list[pa.RecordBatch]):
        texts = [[fold(t) for t in b.column("text").to_pylist()] for b in held]
        found = [[[] for _ in part] for part in texts]
        for k in range(len(self.blocks) if held else 0):
            s = self._searcher(k)
            for part, out in zip(texts, found, strict=True):
                for i, t in enumerate(part):
                    out[i] += s.find(t)
        yield from zip(held, found, strict=True)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and ``match_end`` for each document that holds an item within its edits.

    One row for each row of ``docs`` and item, with the least distance and the first place (in the folded text) where
    it is reached. Null and empty texts hold nothing; items without an id or text are ignored; those shorter than
    EXACT_UNDER match without edits and as whole words only; equal items all match; repeated rows each give their rows;
    a null doc_id stays null. Whole texts are searched. Other columns are not read. Empty tables give no rows.
    """
    spark, kept = docs.sparkSession, docs.select("doc_id", F.col("text").cast("string").alias("text"))
    id_type = kept.schema["doc_id"].dataType
    schema = f"doc_id {id_type.simpleString()}, item_id long, distance int, match_end long"

    def search(finder):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b, found in finder.run(batches):
                rows = [i for i, f in enumerate(found) for _ in f]
                item, dist, end = zip(*[x for f in found for x in f], strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id").take(pa.array(rows, pa.int64())), "item_id": pa.array(item, pa.int64()), "distance": pa.array(dist, pa.int32()), "match_end": pa.array(end, pa.int64())})

        return kept.mapInArrow(run, schema)

    out, before, tables = None, None, None
    for finder in _passes(spark, benchmark, block_chars, rate):
        if before is not None:  # a further pass: what the one before found is written, and its blocks are let go
            tables = tables or Written(spark, "matches")
            part = tables.put(search(before))
            out = part if out is None else out.union(part)
            for x in before.blocks:
                x.unpersist()
        before = finder
    if before is None:
        return spark.createDataFrame([], schema)
    return search(before) if out is None else out.union(search(before))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = EDIT_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item, by the rules of ``matches``.

    Each row is judged by its own text, so rows without an id, with a repeated id or with clashing column names are like
    any others. Null and empty texts stay; an empty benchmark drops nothing; an empty table stays empty.
    """
    tables, before = None, None
    for finder in _passes(docs.sparkSession, benchmark, block_chars, rate):
        if before is not None:
            tables = tables or Written(docs.sparkSession, "clean")
            docs = tables.put(_without(docs, before))
        before = finder
    return docs if before is None else _without(docs, before)


def _without(docs: DataFrame, finder: Finder) -> DataFrame:
    """Rows that hold none of the finder's items, found and dropped in one pass over the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, found in finder.run(batches):
            yield b.filter(pa.array([not f for f in found], pa.bool_()))

    return docs.mapInArrow(trimmed(run), docs.schema)
