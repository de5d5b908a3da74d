"""Sharding by a tree of weighted hash draws.

Regions hold racks and racks hold shards; a node weighs as many shards as it holds. A
row descends from the root: at each level every child draws a number from the row's key
and its own name, and the child with the least draw over its weight wins. A child that
gains weight wins rows from its siblings and loses none, and no other child's rows move
among themselves; so a change of weight moves rows only within the subtrees on its path.

All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leaguelens.llm.common import gapless

SHARDS = 24
RACK_SHARDS = 4
REGION_RACKS = 3
LAW = "key"


def _weights(shards: int, size: int) -> list[int]:
    """Shards below each node that spans ``size`` of them."""
    return [min(size, shards - at) for at in range(0, shards, size)]


def _draw(key: Column, level: str, node: Column, weight: Column) -> Column:
    """The node's exponential waiting time at a rate of its weight."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(level), node, key), 11)
    return -F.log((place + 0.5) / float(1 << 53)) / weight


def _winner(key: Column, level: str, first: Column, children: int, weights: list[int]) -> Column:
    """The winning child among ``children`` nodes from ``first`` on; nodes beyond the last one do not take part."""
    table = F.array(*[F.lit(w) for w in weights])

    def entry(k: int) -> Column:
        node = first + k
        weight = F.get(table, node)
        return F.when(weight.isNotNull(), F.struct(_draw(key, level, node, weight).alias("wait"), node.alias("node")))

    return F.array_min(F.array(*[entry(k) for k in range(children)]))["node"]


def with_shard(
    df: DataFrame, key: str, shards: int, out: str, rack_shards: int = RACK_SHARDS, region_racks: int = REGION_RACKS
) -> DataFrame:
    """Add ``out``: the shard, 0 to ``shards`` - 1, that the key and the shape of the tree decide."""
    regions = _weights(shards, rack_shards * region_racks)
    racks, leaves = _weights(shards, rack_shards), _weights(shards, 1)
    id = F.col(key)
    return (
        df.withColumn("__region", _winner(id, "region", F.lit(0), len(regions), regions))
        .withColumn("__rack", _winner(id, "rack", F.col("__region") * region_racks, region_racks, racks))
        .withColumn(out, _winner(id, "shard", F.col("__rack") * rack_shards, rack_shards, leaves))
        .drop("__region", "__rack")
    )


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the key and the number of shards decide, so texts, equal or not,
    do not matter, repeated keys share a shard, and so do all null keys. ``slot`` numbers
    a shard's rows from 0 without gaps; ``grown_shard`` is the shard with one more, to
    which a row moves or else stays. That holds whenever the new shard opens a region of
    its own, as the 25th does here; a shard added to a rack also moves rows within its
    region. A null text counts as empty. Other columns are ignored; an empty table gives
    an empty result.
    """
    content = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(content) + 8).cast("long").alias("size"),
        F.crc32(content.cast("binary")).alias("text_crc32"),
    )
    rows = with_shard(rows, "key", shards, "shard")
    rows = with_shard(rows, "key", shards + 1, "grown_shard")
    rows = gapless(rows, "shard", ["key", "size", "text_crc32"], "slot")
    return rows.select(
        F.col("key").alias(key), "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"
    )
