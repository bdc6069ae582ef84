"""Join shapes that Spark plans as nested loops when written plainly: ranges, nearest matches, missing pairs, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_join(points: DataFrame, windows: DataFrame, point: str, lo: str, hi: str, width: float, how: str = "inner", on: list[str] | None = None) -> DataFrame:
    """Points with the windows [lo, hi) that hold them, as an equi-join on bins of ``width``.

    A point lies in one bin; a window is repeated for each bin that it touches, so ``width`` should be near a window's.
    ``on`` are further equal columns of both sides. Column names must differ otherwise.
    """
    on = on or []
    p = points.withColumn("__bin", F.floor(F.col(point) / width))
    w = windows.withColumn("__bin_w", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))
    for c in on:
        w = w.withColumnRenamed(c, f"__w_{c}")
    cond = [F.col("__bin") == F.col("__bin_w"), *[F.col(c) == F.col(f"__w_{c}") for c in on], F.col(point) >= F.col(lo), F.col(point) < F.col(hi)]
    return p.join(w, cond, how).drop("__bin", "__bin_w", *[f"__w_{c}" for c in on])


def nearest_match(points: DataFrame, targets: DataFrame, point: str, target: str, tolerance: float, keys: list[str] | None = None) -> DataFrame:
    """Each point with the target nearest to it within ``tolerance``; of two equally near the larger. Others are left out.

    An equi-join on bins of twice the tolerance (a target is put in the bins it can be reached from), then the best
    of a point's few candidates by one aggregation. ``targets`` needs distinct values of ``target``. Repeated points
    are counted before the join and each get a row.
    """
    keys = keys or []
    ident = [c for c in points.columns]
    w = targets.withColumn("__lo", F.col(target) - tolerance).withColumn("__hi", F.col(target) + tolerance)
    width = 2 * tolerance
    p = points.groupBy(*ident).agg(F.count("*").alias("__n")).withColumn("__bin", F.floor(F.col(point) / width))
    w = w.withColumn("__bin_w", F.explode(F.sequence(F.floor(F.col("__lo") / width), F.floor(F.col("__hi") / width))))
    for c in keys:
        w = w.withColumnRenamed(c, f"__w_{c}")
    near = F.abs(F.col(point) - F.col(target))
    cond = [F.col("__bin") == F.col("__bin_w"), *[F.col(c) == F.col(f"__w_{c}") for c in keys], near <= tolerance]
    rest = [c for c in targets.columns if c not in keys]
    both = p.join(w, cond).select(*ident, "__n", *rest, near.alias("__d"))
    best = F.max_by(F.struct(*rest), F.struct(-F.col("__d"), F.col(target)))
    found = both.groupBy(*ident, "__n").agg(best.alias("__t"))
    return found.withColumn("__k", F.explode(F.sequence(F.lit(1).cast("long"), "__n"))).select(*ident, "__t.*")


def asof_match(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, backward: bool = True) -> DataFrame:
    """The last right value at or before (or first at or after) each left row, by one union and a running window."""
    l = left.select(*keys, F.col(left_time).alias("__t"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(1 if backward else -1).alias("__side"))
    r = right.select(*keys, F.col(right_time).alias("__t"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    order = W.partitionBy(*keys).orderBy(F.col("__t") if backward else F.col("__t").desc(), F.abs("__side")).rowsBetween(W.unboundedPreceding, 0)
    found = F.last("__v", ignorenulls=True).over(order)
    return l.unionByName(r).withColumn("matched", found).where("__l is not null").select("__l.*", "matched")


def missing_pairs(left: DataFrame, right: DataFrame, existing: DataFrame, on: list[str]) -> DataFrame:
    """Pairs of the product of two small dimension tables that ``existing`` lacks."""
    return left.crossJoin(right).join(existing.select(*on).distinct(), on, "left_anti").select(*on)


def islands(df: DataFrame, keys: list[str], order: str | Column, gap: float | Column, name: str = "island") -> DataFrame:
    """Number from 0 the runs of rows, ordered within ``keys``, whose steps do not exceed ``gap``."""
    o = F.col(order) if isinstance(order, str) else order
    w = W.partitionBy(*keys).orderBy(o)
    step = o - F.lag(o).over(w)
    marked = df.withColumn("__new", F.when(step > gap, 1).otherwise(0))
    return marked.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def global_islands(df: DataFrame, value: str, gap: float, buckets: float, name: str = "island") -> DataFrame:
    """Islands over a whole column without ordering it in one task. An island's name is its first value.

    Values are dealt to buckets of ``buckets`` (much wider than ``gap``), and rows are numbered inside each. Only the
    first and last run of a bucket can go on in a neighbour; these, at most two for each bucket of the value range
    whatever the number of rows, are chained in one order. Every other run is an island by itself.
    """
    b = df.withColumn("__b", F.floor(F.col(value) / buckets))
    inner = islands(b, ["__b"], value, gap, "__i")
    runs = inner.groupBy("__b", "__i").agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    last = runs.groupBy("__b").agg(F.max("__i").alias("__last"))
    runs = runs.join(last, "__b")
    edge = (F.col("__i") == 0) | (F.col("__i") == F.col("__last"))
    w = W.orderBy("__lo", "__hi")
    new = F.when(F.col("__lo") - F.lag("__hi").over(w) <= gap, 0).otherwise(1)
    chain = runs.where(edge).withColumn("__n", F.sum(new).over(w.rowsBetween(W.unboundedPreceding, 0)))
    start = chain.groupBy("__n").agg(F.min("__lo").alias(name))
    named = chain.join(start, "__n").select("__b", "__i", name)
    named = named.unionByName(runs.where(~edge).select("__b", "__i", F.col("__lo").alias(name)))
    return inner.join(named, ["__b", "__i"]).drop("__b", "__i")


def second_difference(df: DataFrame, keys: list[str], order: str, value: str, name: str = "second") -> DataFrame:
    """x[i] - 2 x[i-1] + x[i-2] in order; NULL for the first two."""
    w = W.partitionBy(*keys).orderBy(order)
    return df.withColumn(name, F.col(value) - 2 * F.lag(value, 1).over(w) + F.lag(value, 2).over(w))


def local_extrema(df: DataFrame, keys: list[str], order: str, value: str, name: str = "extremum", plateaus: bool = True) -> DataFrame:
    """1 at local maxima, -1 at minima, else 0; a plateau counts at its middle, ends never do.

    Without ``plateaus`` a value counts only if it is beyond both of its neighbours, so no equal neighbours do.
    """
    w = W.partitionBy(*keys).orderBy(order)
    v = F.col(value)
    beside = df.withColumns({"__before": F.lag(value).over(w), "__after": F.lead(value).over(w)})
    kind = F.when((v > F.col("__before")) & (v > F.col("__after")), 1).when((v < F.col("__before")) & (v < F.col("__after")), -1).otherwise(0)
    if not plateaus:
        return beside.withColumn(name, kind).drop("__before", "__after")
    flat = beside.withColumn("__r", F.when(v == F.col("__before"), 0).otherwise(1))
    flat = flat.withColumn("__r", F.sum("__r").over(w.rowsBetween(W.unboundedPreceding, 0)))
    run = W.partitionBy(*keys, "__r").orderBy(order)
    whole = run.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    flat = flat.withColumns({"__k": F.row_number().over(run), "__n": F.count("*").over(whole), "__before": F.first("__before").over(whole), "__after": F.last("__after").over(whole)})
    middle = F.col("__k") == F.floor((F.col("__n") - 1) / 2) + 1
    return flat.withColumn(name, F.when(middle, kind).otherwise(0)).drop("__r", "__k", "__n", "__before", "__after")
