"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own, ``(offset + k * skip) mod size``. Shards
take turns claiming their next free slot until the table is full, so each has an even part, and the loss of one moves
few keys of the others. A key's hash picks the slot. The table has a fixed size (checked), so its broadcast
is bounded whatever the data; placement is one lookup a row and needs no shuffle, so hot keys do no harm.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ionlake.llm.common import fresh

#: Default size, a prime well over 100 times the number of shards; the most that is broadcast is MAX_SIZE rows of 8 bytes.
TABLE_SIZE, MAX_SIZE = 65_537, 4_194_319


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _number(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{salt}:{text}".encode(), digest_size=8).digest(), "little")


def preferences(name: str, size: int) -> tuple[int, int]:
    """Offset and skip of a shard's order of slots."""
    return _number(name, "offset") % size, _number(name, "skip") % (size - 1) + 1


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[float] | None = None) -> np.ndarray:
    """Index of the shard that owns each slot.

    With ``weights``, a shard's turns come in proportion to its weight. Names must differ, weights be positive and
    ``size`` a prime with at least as many slots as shards.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need to be given, each once")
    if not _is_prime(size) or not len(shards) <= size <= MAX_SIZE:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_SIZE}")
    weights = weights or [1.0] * len(shards)
    if len(weights) != len(shards) or min(weights) <= 0:
        raise ValueError("each shard needs a positive weight")
    share = np.asarray(weights) / max(weights)
    at, skip = (list(x) for x in zip(*(preferences(s, size) for s in shards), strict=True))
    owner = [-1] * size
    credit, free = [0.0] * len(shards), size
    while free:
        for s in range(len(shards)):
            credit[s] += share[s]
            if credit[s] < 1 - 1e-9:
                continue
            credit[s] -= 1
            slot = at[s]
            while owner[slot] >= 0:
                slot = (slot + skip[s]) % size
            owner[slot] = s
            at[s] = (slot + skip[s]) % size
            free -= 1
            if not free:
                break
    return np.asarray(owner, np.int32)


def key_slot(keys: list[str], size: int):
    """Slot of a row's key columns: XXH64 with Spark's seed over all of them; null is a key of its own."""
    marked = [F.coalesce(F.concat(F.lit("v"), F.col(f"`{k}`").cast("string")), F.lit("n")) for k in keys]
    return F.pmod(F.xxhash64(*marked), F.lit(size)).cast("int")


def place(df: DataFrame, keys: list[str], owners: np.ndarray, slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with the slot and shard index of each row.

    Equal keys go to equal shards; null is a key like any other; repeated rows stay; columns of ``df`` that have the
    names of the new ones, in whatever case, are replaced; all others pass unchanged; an empty table stays empty. Texts
    are not read unless they are keys.
    """
    size = len(owners)
    if size > MAX_SIZE:
        raise ValueError(f"more than {MAX_SIZE} slots would be broadcast")
    spark = df.sparkSession
    taken = [*df.columns, slot, shard]
    at, number, owner = fresh(taken, "at", "number", "owner")
    schema = T.StructType([T.StructField(number, T.IntegerType(), False), T.StructField(owner, T.IntegerType(), False)])
    table = spark.createDataFrame(pd.DataFrame({number: np.arange(size, dtype=np.int32), owner: owners}), schema)
    out = df.withColumn(at, key_slot(keys, size)).join(F.broadcast(table), F.col(at) == F.col(number), "left")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot.lower(), shard.lower())]
    return out.select(*kept, F.col(at).alias(slot), F.col(owner).alias(shard))
