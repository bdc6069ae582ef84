"""Bounded samples for fitting: the only place where an operator looks at less than all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ionlake.llm.common import at_most, train_rows

#: Values of a label that are broadcast with their shares; more are joined.
BROADCAST_CLASSES = 10_000
_SCALE = 1 << 30


def with_share(rows: DataFrame, label: str, weight, most: int, total: int | None = None) -> DataFrame:
    """``rows`` with ``share``, in 2^-30: what part of a class makes about ``most`` of the sum of its ``weight``.

    With ``total``, all classes together make about that much at most.
    """
    sums = rows.groupBy(label).agg(F.greatest(F.sum(weight), F.lit(1)).alias("weight"))
    small = at_most(sums, BROADCAST_CLASSES)
    want = most if total is None else max(1, min(most, total // max(1, sums.count())))
    sums = sums.select(label, F.least(F.lit(_SCALE), F.floor(F.lit(want * _SCALE) / F.col("weight"))).alias("share"))
    return rows.join(F.broadcast(sums) if small else sums, label)


def per_class(rows: DataFrame, label: str, most: int) -> DataFrame:
    """About ``most`` rows of each value of ``label`` (all of them where there are fewer), chosen by a hash of doc_id.

    Only rows that a model may learn from and that have a label and an id; ids must differ. The expected size is ``most``
    times the number of classes.
    """
    rows = rows.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train_rows())
    chosen = with_share(rows, label, F.lit(1), most)
    return chosen.where(F.pmod(F.xxhash64("doc_id"), F.lit(_SCALE)) < F.col("share")).drop("share")


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """Whole texts of a bounded sample of labelled documents, as (text, y).

    Of several labels of a document the largest holds, and of several texts the one of the greatest hash, so repeated
    ids do not widen the sample. The broadcast side is the bounded sample.
    """
    one = labels.where(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    ids = per_class(one, "y", most)
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first("y").alias("y")).select("text", "y")
