"""Shared helpers: tables, written intermediates, column hygiene."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ionlake.session import ship
from ionlake.written import Written  # noqa: F401


#: Rows sent to Python at once, as whole texts are long; a session that sets a number of its own keeps it.
BATCH_ROWS = 2000

# Memory of batches that are done goes back to the system, as workers wait for the next stage with what they hold.
pa.set_memory_pool(pa.system_memory_pool())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table, read by Spark so that any file system it knows works."""
    ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: Iterable[str], *names: str) -> tuple[str, ...]:
    """Column names like ``names`` that none of ``columns`` has, whatever the case."""
    taken = {c.lower() for c in columns}
    out = []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return tuple(out)


#: Rows and bytes of a batch that are Python objects at a time; a single longer row is a slice by itself.
SLICE_ROWS, SLICE_BYTES = 1000, 16 << 20


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into short ones without copying, so that few texts are held twice; an empty batch stays one."""
    for b in batches:
        todo = [b.slice(k, rows) for k in range(0, max(1, b.num_rows), rows)][::-1]
        while todo:
            part = todo.pop()
            if part.num_rows > 1 and part.nbytes > most:
                half = part.num_rows // 2
                todo += [part.slice(half), part.slice(0, half)]
            else:
                yield part


def release() -> None:
    """Hand freed memory back to the system, where the C library can, as workers wait for other work with what they hold."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def trimmed(run):
    """``run``, a function of a task's batches, that hands freed memory back once it is through and its variables are gone."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def at_most(df: DataFrame, n: int) -> bool:
    """Whether ``df`` has no more than ``n`` rows; reads no further than that many."""
    return df.limit(n + 1).count() <= n


def train_rows(col: str = "doc_id"):
    """Condition for rows that a model may learn from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col(col).cast("string")) % 3 != 1


def map_text(df: DataFrame, fn, schema: str, *carry: str, after=None) -> DataFrame:
    """Apply ``fn(list of texts) -> dict of columns`` to batches of ``text``, keeping the ``carry`` columns.

    Only the named columns are read. ``fn`` sees None for a null text. Output columns come in the order of
    ``carry`` and then ``schema``. ``after`` is called at the end of a task, as workers live on.
    """
    kept = df.select(*[F.col(c) for c in carry], F.col("text").cast("string").alias("text"))
    kinds = {f.name: f.dataType.simpleString() for f in kept.schema.fields}
    out = ", ".join(f"`{c}` {kinds[c]}" for c in carry) + (", " if carry else "") + schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            made = fn(b.column("text").to_pylist())
            cols = {c: b.column(c) for c in carry} | {k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in made.items()}
            yield pa.RecordBatch.from_pydict(cols)
        if after:
            after()
        release()

    return kept.mapInArrow(run, out)


def row_key():
    """Names a row by its id and text; rows that share it are copies."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


class Bloom:
    """A set of string keys as a bitmap of fixed size (4 MB), for leaving most rows out of a shuffle.

    It never misses a key. The more keys it holds, the more others it lets by, so what it lets by is always joined
    exactly after it.
    """

    BITS, PROBES = 1 << 25, 3

    def __init__(self, keys: DataFrame, key: str):
        at = F.explode(F.array(*self.places(F.col(key))))
        bit = F.expr("shiftleft(1L, at % 64)")
        words = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).cast("int").alias("w")).agg(F.bit_or(bit).alias("bits"))
        found = words.toArrow()  # no more than BITS / 64 rows whatever the number of keys
        bits = np.zeros(self.BITS // 64, np.int64)
        bits[found.column("w").to_numpy()] = found.column("bits").to_numpy()
        self.sent = keys.sparkSession.sparkContext.broadcast(bits)

    @classmethod
    def places(cls, key) -> list:
        """Bits of a key."""
        return [F.pmod(F.xxhash64(key, F.lit(k)), F.lit(cls.BITS)).cast("int") for k in range(cls.PROBES)]

    @staticmethod
    def hit(bits: np.ndarray, places: list) -> np.ndarray:
        """Which rows may be in the set, from the bitmap and their columns of places."""
        out = np.ones(len(places[0]), bool)
        for p in places:
            p = np.asarray(p)
            out &= (bits[p >> 6] >> (p & 63)) & 1 == 1
        return out

    def test(self, key):
        """Column: whether a key may be in the set. Only the places go to Python."""
        sent = self.sent

        @F.pandas_udf("boolean")
        def maybe(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
            return pd.Series(Bloom.hit(sent.value, [a, b, c]))

        return maybe(*self.places(key))


def one_each(docs: DataFrame, named: DataFrame) -> DataFrame:
    """The row of the least doc_id, nulls last, for each ``label`` of ``named`` (``doc_id``, ``key`` of ``row_key``).

    Rows whose key is kept and met once pass by a bitmap of the others, so their texts are not shuffled.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    kept = named.groupBy("label").agg(first.alias("r")).select("r.key").distinct().withColumn("stays", F.lit(True))
    counts = named.groupBy("key").count().join(kept, "key", "left")
    told = Bloom(counts.where("stays is null or count > 1"), "key")
    key, unsure = fresh(docs.columns, "key", "unsure")
    marked = docs.withColumn(key, row_key()).withColumn(unsure, told.test(F.col(key)))
    rest = marked.where(unsure).join(kept.select(F.col("key").alias(key)), key, "left_semi").dropDuplicates([key])
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return marked.where(~F.col(unsure)).select(*columns).unionAll(rest.select(*columns))
