"""Sharding by a permutation-filled lookup table.

Every shard derives a permutation of the slots from its name; the shards take
turns, each claiming the first slot of its permutation that is still free.
Placing a key is then one hash and one lookup, and a shard that comes or goes
moves few keys of the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime far above the number of shards: slots are within 1 % of even.
TABLE_SIZE = 65_537


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[float] | None = None) -> np.ndarray:
    """The shard number of each of ``size`` slots (``size`` prime, at least
    the number of shards).  A shard of weight w claims in a share w / max(w)
    of the rounds.  Raises ValueError for no shards, repeated names, a size
    that is not prime, or weights that are not positive."""
    n = len(shards)
    if not n or len(set(shards)) < n or n > size or not _is_prime(size):
        raise ValueError("shards must be distinct, at least one, and at most the prime table size")
    weights = [1.0] * n if weights is None else list(weights)
    if len(weights) != n or min(weights) <= 0:
        raise ValueError("one positive weight a shard is needed")
    digests = [hashlib.sha256(str(name).encode()).digest() for name in shards]
    place = [int.from_bytes(d[:8], "big") % size for d in digests]
    skip = [int.from_bytes(d[8:16], "big") % (size - 1) + 1 if size > 1 else 0 for d in digests]
    credit, top = [0.0] * n, max(weights)
    table = [-1] * size
    left = size
    while left:
        for shard in range(n):
            credit[shard] += weights[shard] / top
            if credit[shard] < 1 or not left:
                continue
            credit[shard] -= 1
            slot = place[shard]
            while table[slot] >= 0:
                slot = (slot + skip[shard]) % size
            table[slot] = shard
            place[shard] = (slot + skip[shard]) % size
            left -= 1
    return np.array(table, dtype=np.int32)


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo ``size``;
    a null key counts as the empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("bigint"), F.lit(size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], size: int = TABLE_SIZE, weights: Sequence[float] | None = None) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (int) of each row's key.

    Equal keys, repeated rows included, get the same shard, null ones that of
    the empty text; keys of any length are hashed whole.  Columns of these two
    names in ``df`` are replaced, also where one is the key; other columns
    stay; an empty table stays empty.  The table of ``size`` rows is broadcast:
    it is as small for any input.
    """
    table = df.sparkSession.createDataFrame(
        list(enumerate(lookup_table(shards, size, weights).tolist())), "slot int, shard int"
    )
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    keyed = df.select(*others, slot_of(F.col(key), size).alias("slot"))
    return keyed.join(F.broadcast(table), "slot").select(*others, "slot", "shard")


def write_sharded(df: DataFrame, key: str, shards: Sequence[str], path: str, files_per_shard: int = 8) -> None:
    """Writes ``df`` as Parquet, one folder a shard; a shard's rows are dealt
    to ``files_per_shard`` tasks, so no shard becomes one task, nor does a hot
    key.  Every row is written, repeated ones and null keys too, with its
    columns and ``slot`` (see :func:`place`); an empty table writes no row.
    """
    placed = place(df, key, shards)
    hashed = [F.col(f"`{f.name}`") for f in placed.schema.fields if f.dataType.typeName() != "map"]
    placed.repartition(len(shards) * files_per_shard, "shard", F.pmod(F.xxhash64(*hashed), F.lit(files_per_shard))).write.partitionBy("shard").parquet(path)
