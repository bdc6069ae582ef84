"""URL filtering by a temporal list join, with DataFrame operations only.

Dated list entries (``domain``, ``action``, ``effective``, ``entry_id``) become validity intervals: an entry holds from
its time until the next of its domain; action ``remove`` only ends. Each capture is looked up by its host and every
parent domain among the intervals that cover its fetch time, and the most specific active entry decides. Times are cut
into buckets, which are part of the join's key, so that a domain with a long history costs a capture no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ionlake.llm.common import Written, at_most

#: Up to so many intervals, of about 100 bytes each, are broadcast; a longer list is joined by a salted shuffle.
BROADCAST_ROWS = 100_000
#: Equal parts of the time between the first and last capture: a capture meets the intervals that touch its part, not all
#: those of its domain.
PARTS = 64
#: A domain's captures are dealt over so many keys in the shuffled join, as one host or parent may hold most rows.
SALTS = 64


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dot; empty where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(host, r"^.*@", "")
    return F.regexp_replace(F.regexp_replace(host, r":[0-9]*$", ""), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals ``[since, until)`` of dated entries; ``until`` is null for those in force.

    Of entries of a domain with one time, the one with the largest ``entry_id`` holds. Entries without a domain, time
    or action are void. Domains compare in lower case.
    """
    clean = entries.select(F.lower("domain").alias("domain"), "action", F.col("effective").cast("long").alias("since"), F.col("entry_id").cast("long").alias("entry_id")).dropna(subset=["domain", "since", "action"])
    last = clean.groupBy("domain", "since").agg(F.max_by(F.struct("action", "entry_id"), F.coalesce("entry_id", F.lit(-(2**62)))).alias("e"))
    until = F.lead("since").over(W.partitionBy("domain").orderBy("since"))
    return last.select("domain", "since", until.alias("until"), F.col("e.action").alias("action"), F.col("e.entry_id").alias("entry_id")).where(F.col("action") != "remove")


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_rows: int = BROADCAST_ROWS, salts: int = SALTS) -> DataFrame:
    """Decision for each capture (``page_id``, ``url``, ``fetched``): adds ``host``, ``entry_id``, ``matched``, ``decision``.

    ``decision`` is the action of the most specific entry active at the fetch time, or ``none``. A null or unparsable
    URL and a null fetch time match nothing. Repeated captures each keep their row; other columns are not read; an empty
    list or table of captures is fine.
    """
    cap = captures.select("page_id", "url", F.col("fetched").cast("long").alias("fetched")).withColumn("host", host_of(F.col("url")))
    first, last = captures.agg(F.min(F.col("fetched").cast("long")), F.max(F.col("fetched").cast("long"))).head()
    first, last = (0, -1) if first is None else (first, last)
    width = (last - first) // PARTS + 1
    part_of = lambda t: F.floor((t - first) / width)
    # The list is worked out once and written, as its size is looked at before it is joined. Intervals of a domain do not
    # overlap, so there are no more rows than intervals and parts of each domain.
    end = F.least(F.col("until") - 1, F.lit(last).cast("long"))
    spans = intervals(entries).where((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    spans = spans.withColumn("bucket", F.explode(F.sequence(part_of(F.greatest("since", F.lit(first).cast("long"))), part_of(end))))
    spans = Written(captures.sparkSession, "urls").put(spans)
    labels = F.split("host", r"\.")
    # The host and each parent; level 0 is the host itself.
    names = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    looked = cap.select("*", part_of(F.col("fetched")).alias("at"), F.posexplode(names).alias("level", "name"))
    keys = [F.col("name") == F.col("domain"), F.col("at") == F.col("bucket")]
    if at_most(spans, broadcast_rows):
        right = F.broadcast(spans)
    else:
        looked = looked.withColumn("salt", F.pmod(F.xxhash64("page_id", "url", "fetched"), F.lit(salts)).cast("int"))
        right = spans.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        keys.append(F.col("salt") == F.col("part"))
    active = [F.col("fetched") >= F.col("since"), F.col("until").isNull() | (F.col("fetched") < F.col("until"))]
    joined = looked.join(right, [*keys, *active], "left")
    hit = F.when(F.col("domain").isNotNull(), F.struct((-F.col("level")).alias("near"), "domain", "action", "entry_id"))
    best = joined.groupBy("page_id", "url", "fetched", "host").agg(F.max(hit).alias("hit"), F.sum(F.when(F.col("level") == 0, 1).otherwise(0)).alias("times"))
    whole = best.withColumn("__n", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return whole.select("page_id", "url", "fetched", "host", F.col("hit.entry_id").alias("entry_id"), F.col("hit.domain").alias("matched"), F.coalesce("hit.action", F.lit("none")).alias("decision"))
