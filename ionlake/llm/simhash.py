"""SimHash near-duplicates by covering locality-sensitive hashing.

Each bit position gets a non-zero vector of radius + 1 bits. A table for each non-zero vector v keeps the positions
whose vector has an odd product with v. Two fingerprints within the radius differ in at most ``radius`` positions;
their vectors cannot span the whole space, so some v is orthogonal to all of them and its table sees no difference:
every pair within the radius collides in at least one table. With radius 3 there are 15 tables of about 34 bits.

Copies share a fingerprint and are one class. Class fingerprints are dealt to tables; a bucket over BLOCK rows is cut
into blocks, and every pair of blocks meets in a task of bounded size. A bucket gives a spanning forest of its links,
not all pairs. Forests are joined into components by alternating star contraction on written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Written, at_most, map_text, one_each, row_key

SEED, BITS = 42, 64
#: Fingerprints of a bucket that meet in one task: up to two blocks of about so many, 16 bytes each.
BLOCK = 32_768
#: Runs up to this length are compared shift by shift for all buckets at once; longer ones by a search.
SHORT_RUN = 24
_STEP = 65_536


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; zero for a text without words."""
    if not text:
        return 0
    parts = text.encode().lower().split()  # of bytes: A-Z only, and white space is \\x20 and \\x09-\\x0D
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = list(accumulate(len(p) + 1 for p in parts))
    starts = [0, *ends[:-1]]
    n = max(1, len(parts) - words + 1)
    stops = ends[words - 1 :] if len(parts) >= words else ends[-1:]
    h, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for k in range(0, n, _STEP):
        counts += bit_counts(np.array([h(joined[a : b - 1], SEED) for a, b in zip(starts[k : min(n, k + _STEP)], stops[k : k + _STEP])], "<u8"))
    return _over_half(counts, n)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """In how many hashes each bit is set."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def _over_half(counts: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """Fingerprint of given shingle hashes; zero if there are none."""
    return _over_half(sum((bit_counts(hashes[k : k + _STEP]) for k in range(0, len(hashes), _STEP)), np.zeros(BITS, np.int64)), len(hashes))


def fingerprints(docs: DataFrame, *carry: str, words: int = 3) -> DataFrame:
    """``carry`` columns with ``fp``, the fingerprint as a signed long."""

    def run(texts):
        return {"fp": pa.array(np.array([fingerprint(t, words) for t in texts], np.uint64).view(np.int64))}

    return map_text(docs, run, "fp long", *carry)


def covering_masks(radius: int = 3, bits: int = BITS) -> list[int]:
    """Masks such that any two words within the radius agree under at least one."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of fingerprints within the radius, by a search that visits each once."""
    rest, links = np.unique(fps), []
    while len(rest):
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            near = np.bitwise_count(rest ^ x) <= radius
            if near.any():
                found = rest[near]
                links += [(int(x), int(y)) for y in found]
                front += list(found)
                rest = rest[~near]
    return links


def _run_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows with equal keys; rows come sorted by key."""
    if not len(fps):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    length = np.diff(np.r_[first, len(keys)])
    a, b = [], []
    for i, n in zip(first[length > SHORT_RUN], length[length > SHORT_RUN]):
        if links := forest(fps[i : i + n], radius):
            x, y = np.array(links, np.uint64).T
            a.append(x)
            b.append(y)
    left = np.repeat(length, length) - (np.arange(len(keys)) - np.repeat(first, length))  # rows to the end of the run
    left[np.repeat(length > SHORT_RUN, length)] = 0
    for d in range(1, int(left.max(initial=0))):
        i = np.flatnonzero(left > d)
        near = i[np.bitwise_count(fps[i] ^ fps[i + d]) <= radius]
        a.append(fps[near])
        b.append(fps[near + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.uint64), np.zeros(0, np.uint64))


def links(classes: DataFrame, radius: int = 3, block: int = BLOCK) -> DataFrame:
    """Links ``a < b`` of a spanning forest within each bucket, over distinct fingerprints ``fp``."""
    masks = [_signed(m) for m in covering_masks(radius)]
    keyed = classes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"))
    sizes = keyed.groupBy("t", "key").count().where(F.col("count") > block)
    sizes = sizes.select("t", "key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, ["t", "key"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    where = F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.select(where.alias("place"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def done(k, f):
            a, b = _run_links(k, f, radius)
            a, b = a.view(np.int64), b.view(np.int64)
            return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

        for batch in batches:
            keys = np.r_[keys, batch.column("place").to_numpy()]
            fps = np.r_[fps, batch.column("fp").to_numpy().astype(np.int64).view(np.uint64)]
            if not len(keys) or keys[0] == keys[-1]:
                continue
            cut = int(np.searchsorted(keys, keys[-1]))  # the last run may go on in the next batch
            yield done(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
        yield done(keys, fps)

    return dealt.repartition("place").sortWithinPartitions("place").mapInArrow(run, "a long, b long").distinct()


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges ``a``, ``b`` in order, and the least node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    up = list(range(len(nodes)))  # a node's parent is never greater, so a root is the least

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        i, j = root(i), root(j)
        up[max(i, j)] = min(i, j)
    return nodes, nodes[np.array([root(i) for i in range(len(up))], np.int64)]


def components(edges: DataFrame, most: int = 60, small: int = 0) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for the nodes of ``edges`` (``a``, ``b``, both long).

    Alternating large-star and small-star contraction. Each round is written to the shared folder, so that a lost
    executor costs no earlier round; only a count and a checksum come to the driver. Up to ``small`` edges are joined
    on the driver instead, without the shuffles of the rounds.
    """
    tables = Written(edges.sparkSession, "components")

    def star(e: DataFrame) -> DataFrame:
        """Large star, then small star."""
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        e = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = e.groupBy("b").agg(F.min("a").alias("m"))
        moved = e.join(least, "b")
        hung = moved.where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        return least.select(F.col("m").alias("a"), "b").union(hung).distinct()

    now = tables.put(edges.select("a", "b").where("a < b").distinct())
    if small and at_most(now, small):
        found = now.toArrow()
        tables.drop(now)
        node, label = joined(*(found.column(c).to_numpy() for c in "ab"))
        return edges.sparkSession.createDataFrame(pa.table({"node": node, "label": label}), "node long, label long")
    mark = None
    for _ in range(most):
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if not row[0] or tuple(row) == mark:
            break
        mark, before = tuple(row), now
        now = tables.put(star(before))
        tables.drop(before)
    else:
        raise RuntimeError("the components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).union(now.select(F.col("a"), F.col("a")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 3, words: int = 3, block: int = BLOCK) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` of every row.

    ``component_id`` is the least doc_id reachable by links between fingerprints at ``radius`` or fewer differing
    bits. Null, empty and blank texts have fingerprint zero and link like any other. Repeated rows each get a row; a
    null doc_id gets a component, and is never its least member unless all are null. Other columns are not read. Very
    long texts are hashed in steps. An empty table gives an empty one.
    """
    found = _labelled(docs, radius, words, block, "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _labelled(docs: DataFrame, radius: int, words: int, block: int, *carry: str) -> DataFrame:
    """``carry`` columns, doc_id among them, of every row with ``fp``, ``label`` (names the component) and ``component_id``."""
    tables = Written(docs.sparkSession, "simhash")
    fps = tables.put(fingerprints(docs, *carry, words=words))
    classes = tables.put(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(links(classes, radius, block))
    named = classes.join(labels, classes.fp == labels.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"))
    return fps.join(named.join(least, "label").select("fp", "label", "component_id"), "fp")


def keep_one(docs: DataFrame, radius: int = 3, words: int = 3, block: int = BLOCK) -> DataFrame:
    """One row of each component: that of the least doc_id, a null one only if all are null.

    Of rows with one id in a component the one of the least text digest stays. An id whose texts lie in different
    components may stay with each of them.
    """
    keyed = docs.select("doc_id", "text", row_key().alias("key"))
    return one_each(docs, _labelled(keyed, radius, words, block, "doc_id", "key"))
