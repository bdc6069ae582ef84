"""Near-duplicates of five-word shingle sets at a Jaccard similarity of 0.8 or more, from SimHash and beyond its radius.

Covering SimHash tables (``simhash.links``) over five-word fingerprints give the first candidates. Sets at 0.8 differ in
up to 14 of 64 bits, a radius that would take 2^15 - 1 covering tables, so the rest is found by an exact filter: two sets
of n and fewer shingles at or over a share s have s * n in common, so in any fixed order of all shingles, the first
n - ceil(s * n) + 1 of the one and the first such part of the other meet. The order is by hash, with shingles that are
in many of these heads moved to the end, so that a common line or passage rarely is in a head. Heads that are k longer
share k more, so a set whose longer head has fewer shingles in common with all other sets together is left out.

Sets that share a shingle of their heads are compared by sketches, bitmaps of the parity of shingles: the bits that
differ are never more than the shingles that differ, so a sketch drops no similar pair. Candidates are compared in full.
Each round looks only into buckets that still hold several components and takes the nearest candidates of each set; a
bucket is looked into again, for more of them, only if it had more. The search ends when none had. A bucket over BLOCK sets is cut into blocks, and
every pair of blocks meets in a task of bounded size. Texts with equal sets are one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import Bloom, Written, one_each, row_key, sliced, trimmed
from ionlake.llm.simhash import components, majority
from ionlake.llm.simhash import links as covering_links

WORDS = 5
#: Least similarity, as a fraction.
OVER, UNDER = 4, 5
#: Differing bits of fingerprints that the covering tables guarantee to find.
RADIUS = 3
#: Sets of a bucket that meet in one task: up to two blocks of about so many.
BLOCK = 4096
#: Shingles in more heads than COMMON go last in the order, the most frequent MOST_COMMON of them. Any order is exact.
COMMON, MOST_COMMON = 50, 200_000
#: Head shingles that a task counts at once; beyond it, those met once so far are forgotten (the order is still exact).
COUNTED = 1_000_000
#: Bits of a sketch: the power of two from SKETCH times the shingles up, at most MAX_SKETCH.
SKETCH, MAX_SKETCH = 4, 1 << 16
#: Candidates of a set and bucket in the first round; each later round takes GROW times as many.
NEAREST, GROW = 3, 8
#: Links joined into components on the driver (16 bytes each); more are joined by rounds of shuffles.
SMALL = 200_000
#: Words hashed at a time, and bytes from which a word counts by its digest.
_STEP, _LONG = 1 << 14, 256


def _mixed(x: np.ndarray) -> np.ndarray:
    """Hash values whose bits all depend on all bits of ``x``."""
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_UP, _DOWN = _powers(_BASE, 1 << 16), _powers(pow(_BASE, -1, 1 << 64), 1 << 16)


def _hash_shingles(line: bytes, words: int) -> np.ndarray:
    """Hashes of the shingles of a line of words, each followed by a blank."""
    global _UP, _DOWN
    raw = np.frombuffer(line, np.uint8)
    ends = np.flatnonzero(raw == 32)
    if np.diff(ends, prepend=-1).max() > _LONG:
        line = b" ".join(w if len(w) < _LONG else xxhash.xxh3_128_hexdigest(w).encode() for w in line.split(b" "))
        raw = np.frombuffer(line, np.uint8)
        ends = np.flatnonzero(raw == 32)
    if len(raw) > len(_UP):
        size = 1 << (len(raw) - 1).bit_length()
        _UP, _DOWN = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    starts = np.r_[0, ends[:-1] + 1]
    # A polynomial of random byte values, by prefix sums.
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * _UP[: len(raw)], out=total[1:])
    first, last = starts[: len(starts) - words + 1], ends[words - 1 :]
    return _mixed((total[last] - total[first]) * _DOWN[first])


def all_shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles in order, repeats included; of all words for a shorter text, none without words.

    A-Z are lower-cased; words part at \\x20 and \\x09-\\x0D.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    k = min(words, len(parts))
    steps = range(0, len(parts) - k + 1, _STEP)
    return np.concatenate([_hash_shingles(b" ".join(parts[i : i + _STEP + k - 1]) + b" ", k) for i in steps])


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes."""
    hashes = np.sort(hashes)
    return hashes[np.r_[True, hashes[1:] != hashes[:-1]]] if len(hashes) else hashes


def name_of(hashes: np.ndarray) -> int:
    """Signed 64-bit name of a set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(hashes.tobytes())).view(np.int64))


def head(hashes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The long head of a sorted set, the size of its short head, and how many of the long one a similar set shares.

    Hashes of the sorted ``common`` come last in the order. A set of n has n // 10 more shingles in its long head than
    in the short one; the smallest set that can be similar to it bounds what they share.
    """
    n = len(hashes)
    if not n:
        return hashes, 0, 1
    if len(common):
        last = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~last], hashes[last]])
    least = -(OVER * n // -UNDER)
    return hashes[: n - least + 1 + n // 10], n - least + 1, least // 10 + 1


def sketch(hashes: np.ndarray) -> bytes:
    """Bitmap of the parity of shingles by their low bits."""
    size = min(MAX_SKETCH, max(64, 1 << (SKETCH * len(hashes) - 1).bit_length())) if len(hashes) else 64
    odd = np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _folded(rows: np.ndarray) -> np.ndarray:
    """Sketches of half the size."""
    half = rows.shape[-1] // 2
    return rows[..., :half] ^ rows[..., half:]


class Bucket:
    """Sets of a bucket with their sketches, to find the candidates of one among those after it."""

    def __init__(self, sets: np.ndarray, labels: np.ndarray, sizes: np.ndarray, sketches: list[bytes]):
        order = np.argsort(sets, kind="stable")
        self.sets, self.labels, self.sizes = sets[order], labels[order], sizes[order]
        width = np.array([len(s) for s in sketches], np.int64)[order] // 8
        # By size of sketch: places in the bucket, sketches, and sketches of half the size.
        self.levels = {}
        for w in np.unique(width):
            at = np.flatnonzero(width == w)
            rows = np.frombuffer(b"".join(sketches[order[i]] for i in at), np.uint64).reshape(len(at), w)
            self.levels[int(w)] = (at, rows, _folded(rows) if w > 1 else None)
        self.width = width

    def _differ(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Places after ``i`` that may be similar by size, and the bits in which their sketches differ."""
        w = int(self.width[i])
        at, rows, _ = self.levels[w]
        mine = rows[np.searchsorted(at, i)]
        found, bits = [], []
        for other, place in ((w, 1), (w // 2, 1), (w * 2, 2)):
            if other not in self.levels or not other:
                continue
            level = self.levels[other]
            part = slice(int(np.searchsorted(level[0], i, side="right")), None)
            near = level[0][part]
            n, m = self.sizes[i], self.sizes[near]
            fits = (UNDER * np.minimum(n, m) >= OVER * np.maximum(n, m)) & (self.labels[near] != self.labels[i])
            if fits.any():
                found.append(near[fits])
                bits.append(np.bitwise_count(level[place][part][fits] ^ (_folded(mine) if other < w else mine)).sum(axis=1, dtype=np.int64))
        return (np.concatenate(found), np.concatenate(bits)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def candidates(self, nearest: int) -> Iterator[tuple[int, int, bool]]:
        """Pairs of sets with different labels that may be similar, up to ``nearest`` for each first one, and whether it has more."""
        for i in range(len(self.sets) - 1):
            at, bits = self._differ(i)
            # Similar sets differ in a share of (UNDER - OVER) / (UNDER + OVER) of their sizes' sum at most.
            may = (UNDER + OVER) * bits <= (UNDER - OVER) * (self.sizes[i] + self.sizes[at])
            at, bits = at[may], bits[may]
            more = len(at) > nearest
            for j in at[np.argsort(bits, kind="stable")[:nearest]]:
                yield int(self.sets[i]), int(self.sets[j]), more


def _lists(a: list[np.ndarray]) -> pa.Array:
    """Arrays of 64 bits as one column of lists of longs."""
    flat = np.concatenate(a).view(np.int64) if a else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, a)]), pa.int32()), pa.array(flat))


def _counted(counts: tuple[np.ndarray, np.ndarray], more: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashes with those of ``more``, each met once."""
    h, at = np.unique(np.concatenate([counts[0], *more]), return_inverse=True)
    weight = np.r_[counts[1], np.ones(len(at) - len(counts[1]), np.int64)]
    return h, np.bincount(at, weight, len(h)).astype(np.int64)


def _measured(docs: DataFrame, words: int) -> DataFrame:
    """A row for each of ``docs`` (``doc_id``, ``text``, ``key``): name of its ``set``, size ``n``, ``sketch`` and fingerprint ``fp``.

    At its end each task adds rows without a sketch: ``set`` is a shingle met in ``n`` heads of different sets of the
    task, twice at least.
    """
    none = np.zeros(0, np.uint64)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, waiting, held, ids = set(), [], 0, None
        counts = none, np.zeros(0, np.int64)
        for b in sliced(batches):
            ids = b.column("doc_id")
            sets, n, sketches, fps = [], [], [], []
            for t in b.column("text").to_pylist():
                h = all_shingles(t, words)
                fps.append(majority(h))
                h = distinct(h)
                s = name_of(h)
                if s not in seen:
                    seen.add(s)
                    waiting.append(h[: head(h, none)[1]])
                    held += len(waiting[-1])
                sets.append(s)
                n.append(len(h))
                sketches.append(sketch(h))
            if held > COUNTED:
                counts, waiting, held = _counted(counts, waiting), [], 0
                if len(counts[0]) > COUNTED:
                    counts = counts[0][counts[1] > 1], counts[1][counts[1] > 1]
                    seen.clear()
            cols = {"doc_id": ids, "key": b.column("key"), "set": pa.array(sets, pa.int64()), "n": pa.array(n, pa.int64()), "sketch": pa.array(sketches, pa.binary())}
            yield pa.RecordBatch.from_pydict(cols | {"fp": pa.array(np.array(fps, np.uint64).view(np.int64))})
        if ids is not None:
            h, n = _counted(counts, waiting)
            h, n = h[n > 1].view(np.int64), n[n > 1]
            empty = {c: pa.nulls(len(h), t) for c, t in (("doc_id", ids.type), ("key", pa.string()), ("sketch", pa.binary()), ("fp", pa.int64()))}
            cols = empty | {"set": pa.array(h), "n": pa.array(n)}
            yield pa.RecordBatch.from_pydict({c: cols[c] for c in ("doc_id", "key", "set", "n", "sketch", "fp")})

    return docs.mapInArrow(trimmed(run), f"doc_id {kind}, key string, set long, n long, sketch binary, fp long")


def _heads(docs: DataFrame, common: np.ndarray, words: int, tables: Written) -> DataFrame:
    """``set`` and ``h`` for each shingle ``h`` of a short head that is in another head too, of sets that share enough."""
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(common))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in sliced(batches):
            sets, made = [], []
            for t in b.column("text").to_pylist():
                h = distinct(all_shingles(t, words))
                s = name_of(h)
                if s not in seen:
                    if len(seen) >= COUNTED:
                        seen.clear()
                    seen.add(s)
                    sets.append(s)
                    made.append(head(h, sent.value))
            size = [len(a) for a, _, _ in made]
            h = np.concatenate([a for a, _, _ in made]).view(np.int64) if made else np.zeros(0, np.int64)
            # How many are needed, negative beyond the short head.
            need = np.concatenate([np.where(np.arange(len(a)) < k, n, -n) for a, k, n in made]) if made else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h), "set": pa.array(np.repeat(np.array(sets, np.int64), size)), "need": pa.array(need.astype(np.int32))})

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by ``h`` and ``set``, each once, those whose ``h`` an adjoining row has as well."""
        h = s = n = np.zeros(0, np.int64)  # the last row so far, whose next row is not known
        before = False  # whether the row before that has its h

        def made(h, s, n):
            return pa.RecordBatch.from_pydict({"h": pa.array(h), "set": pa.array(s), "need": pa.array(n.astype(np.int32))})

        for b in batches:
            h, s, n = (np.r_[x, b.column(c).to_numpy()] for x, c in ((h, "h"), (s, "set"), (n, "need")))
            if not len(h):
                continue
            new = np.r_[True, (h[1:] != h[:-1]) | (s[1:] != s[:-1])]
            h, s, n = h[new], s[new], n[new]
            same = h[1:] == h[:-1]
            back = np.r_[before, same]
            keep = back[:-1] | same
            yield made(h[:-1][keep], s[:-1][keep], n[:-1][keep])
            h, s, n, before = h[-1:], s[-1:], n[-1:], bool(back[-1])
        if before:
            yield made(h, s, n)

    schema = "h long, set long, need int"
    dealt = docs.select("text").mapInArrow(trimmed(deal), schema)
    met = tables.put(dealt.repartition("h").sortWithinPartitions("h", "set").mapInArrow(trimmed(shared), schema))
    enough = met.groupBy("set").agg(F.count("*").alias("n"), F.max(F.abs("need")).alias("least")).where("n >= least").select("set")
    out = tables.put(met.where("need > 0").select("h", "set").join(enough, "set", "left_semi"))
    tables.drop(met)
    return out


def _candidates(met: DataFrame, labels: DataFrame | None, sets: DataFrame, nearest: int, block: int) -> DataFrame:
    """``h``, ``a < b`` and ``more``: candidates in buckets with several labels; of buckets with the same members, in one.

    ``more`` tells that the bucket ``h`` has further candidates for ``a``.
    """
    known = met.withColumn("label", F.col("set"))
    if labels is not None:
        known = met.join(labels, F.col("set") == F.col("node"), "left").select("h", "set", F.coalesce("label", "set").alias("label"))
    same = [F.bit_xor(F.xxhash64("set", F.lit(k))).alias(f"x{k}") for k in range(2)]
    open_ = known.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("n"), *same).where("lo <> hi")
    chosen = open_.groupBy("n", "x0", "x1").agg(F.min("h").alias("h")).select("h", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = known.join(chosen, "h")
    dealt = dealt.withColumn("mine", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("h", F.least("mine", "other"), F.greatest("mine", "other"))
    dealt = dealt.select(place.alias("place"), "h", "set", "label").join(sets, "set").select("place", "h", "set", "label", "n", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, bucket, rows = None, 0, []

        def done():
            found = []
            if len(rows) > 1:
                s, label, n, sk = zip(*rows, strict=True)
                found = list(Bucket(np.array(s), np.array(label), np.array(n), list(sk)).candidates(nearest))
            a, b, more = zip(*found, strict=True) if found else ((), (), ())
            return pa.RecordBatch.from_pydict({"h": pa.array([bucket] * len(a), pa.int64()), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array(more, pa.bool_())})

        for batch in batches:
            for p, h, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if p != place:
                    yield done()
                    place, bucket, rows = p, h, []
                rows.append(row)
        yield done()

    return dealt.repartition("place").sortWithinPartitions("place").mapInArrow(trimmed(run), "h long, a long, b long, more boolean")


class Comparer:
    """Compares candidates in full. Sets are taken from the texts when first needed, and written."""

    def __init__(self, docs: DataFrame, rows: DataFrame, words: int, tables: Written):
        self.docs, self.rows, self.words, self.tables = docs, rows, words, tables
        self.known: list[DataFrame] = []

    def _take(self, pairs: DataFrame) -> None:
        """Write the sets of ``pairs`` that are not known yet."""
        need = pairs.select(F.explode(F.array("a", "b")).alias("set")).distinct()
        for k in self.known:
            need = need.join(k.select("set"), "set", "left_anti")
        need = self.tables.put(need)
        keys = self.rows.join(need, "set", "left_semi").groupBy("set").agg(F.min("key").alias("key"))
        told = Bloom(keys, "key")
        sent, words = told.sent, self.words
        places = [p.alias(f"p{i}") for i, p in enumerate(Bloom.places(F.col("key")))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in sliced(batches):
                b = b.filter(pa.array(Bloom.hit(sent.value, [b.column(f"p{i}").to_numpy() for i in range(Bloom.PROBES)])))
                made = [distinct(all_shingles(t, words)) for t in b.column("text").to_pylist()]
                yield pa.RecordBatch.from_pydict({"set": pa.array([name_of(h) for h in made], pa.int64()), "hashes": _lists(made)})

        taken = self.docs.select("text", *places).mapInArrow(trimmed(run), "set long, hashes array<long>")
        taken = taken.join(need, "set", "left_semi").groupBy("set").agg(F.first("hashes").alias("hashes"))
        self.known.append(self.tables.put(taken))
        self.tables.drop(need)

    def similar(self, pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (``a``, ``b``) whose sets are similar."""
        self._take(pairs)
        sets = self.known[0]
        for k in self.known[1:]:
            sets = sets.union(k)
        x, y = (sets.select(F.col("set").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
        both = pairs.select("a", "b").join(x, "a").join(y, "b")
        common = F.size(F.array_intersect("ha", "hb"))
        return both.where(UNDER * common >= OVER * (F.size("ha") + F.size("hb") - common)).select("a", "b")


def similar_sets(docs: DataFrame, rows: DataFrame, common: np.ndarray, tables: Written, words: int, radius: int, block: int) -> DataFrame | None:
    """``node`` and ``label`` of each set that is linked to another; None if there is no link."""
    compare = Comparer(docs, rows, words, tables)
    sets = rows.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("fp").alias("fp"))
    sets = tables.put(sets)
    # Candidates of the covering tables: sets of one fingerprint, and the first sets of linked fingerprints.
    classes = tables.put(sets.groupBy("fp").agg(F.min("set").alias("first")))
    near = covering_links(classes, radius)
    x, y = (classes.select(F.col("fp").alias(c), F.col("first").alias(f"set_{c}")) for c in "ab")
    near = near.join(x, "a").join(y, "b").select(F.least("set_a", "set_b").alias("a"), F.greatest("set_a", "set_b").alias("b"))
    alike = sets.join(classes, "fp").where("set <> first").select(F.col("first").alias("a"), F.col("set").alias("b"))
    met = _heads(docs, common, words, tables)
    tried = tables.put(near.union(alike).distinct())
    links = tables.put(compare.similar(tried))
    labels, nearest = None, NEAREST
    if links.limit(1).count():
        labels = tables.put(components(links, small=SMALL))
    while met is not None:
        found = tables.put(_candidates(met, labels, sets.select("set", "n", "sketch"), nearest, block))
        new = tables.put(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"))
        again = found.where("more").select("h").distinct()
        met = tables.put(met.join(again, "h", "left_semi")) if again.limit(1).count() else None
        if new.limit(1).count():
            more = tables.put(compare.similar(new))
            tried, links = tried.union(new), links.union(more)
            if more.limit(1).count():
                labels = tables.put(components(links, small=SMALL))
        nearest *= GROW
    return labels


def keep_one(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, block: int = BLOCK, common: int = COMMON) -> DataFrame:
    """One row of each group of ``docs`` linked by pairs whose shingle sets have a Jaccard similarity of 0.8 or more.

    It is the row of the least doc_id (a null one only if all are null); of rows with one id, the one of the least text
    digest. An id whose texts lie in different groups may stay with each of them. Null and empty texts, and others
    without words, are alike. Shingles and sets are told apart by 64-bit hashes. Columns of any name pass unchanged; an
    empty table gives an empty one.
    """
    tables = Written(docs.sparkSession, "jaccard")
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_key().alias("key"))
    made = tables.put(_measured(plain, words))
    often = made.where("sketch is null").groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") > common)
    often = np.array([r.set for r in often.orderBy(F.desc("n"), "set").limit(MOST_COMMON).collect()], np.int64)
    rows = made.where("sketch is not null")
    labels = similar_sets(plain, rows, often.view(np.uint64), tables, words, radius, block)
    named = rows.select("doc_id", "key", F.col("set").alias("label"))
    if labels is not None:
        named = rows.join(labels, F.col("set") == F.col("node"), "left").select("doc_id", "key", F.coalesce("label", "set").alias("label"))
    named = tables.put(named)
    tables.only(named)
    return one_each(docs, named)
