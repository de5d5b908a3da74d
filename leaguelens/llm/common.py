"""What the operators of this subpackage share: sessions, samples, numbering, link components."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from leaguelens.session import checkpointed, shuffles_dropped, tune

# A task's Arrow batch, in rows and in bytes: what a Python worker holds at once.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2048",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}


def prepare(spark: SparkSession) -> SparkSession:
    """The library's session settings and bounded Arrow batches."""
    for key, value in BATCH.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return tune(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(parts)).cast("int")


def spread_hash(*cols: Column) -> Column:
    """A value in [0, 1) that does not follow the order of the columns."""
    return F.pmod(F.xxhash64(F.lit("spread"), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def bounded_sample(rows: DataFrame, key: Column, n: int, counts: DataFrame, group: str) -> DataFrame:
    """About ``n`` of ``rows``, equally many of every value of ``group`` where there are enough.

    ``counts`` has the rows of each value, in a bounded number of values; only
    these take part. Rows are chosen by a hash of ``key``, so the choice does not
    depend on the partitioning.
    """
    found = counts.collect()
    if not found:
        return rows.limit(0)
    each = n / len(found)
    for _ in range(8):  # what small groups leave goes to the others
        spare = n - sum(min(r["count"], each) for r in found)
        large = sum(r["count"] > each for r in found)
        if not large or spare < 1:
            break
        each += spare / large
    share = F.create_map(*[F.lit(x) for r in found for x in (r[group], min(1.0, each / r["count"]))])
    return rows.where(spread_hash(key) < F.coalesce(F.try_element_at(share, F.col(group)), F.lit(0.0)))


def text_digest(text: Column) -> Column:
    """16 bytes that stand for a text; a null text counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), 1, 16)


def one_row_each(docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """One row of ``docs`` for each group of texts: that of the least key, then of the least digest; all columns stay.

    ``groups`` is (id, root) of text digests; a text that it lacks is a group of its own.
    Null keys come last. Of rows equal in key and text, one stays.
    """
    seen = docs.select(text_digest(F.col(text)).alias("id"), F.col(key).alias("key")).groupBy("id", "key").agg(F.count(F.lit(1)).alias("n"))
    least = seen.groupBy("id").agg(F.min(F.struct(F.col("key").isNull().alias("last"), "key", "n")).alias("x"))
    least = least.join(groups, "id", "left").select(
        F.coalesce("root", "id").alias("root"), F.struct("x.last", "x.key", "id", "x.n").alias("x")
    )
    kept = least.groupBy("root").agg(F.min("x").alias("x"))
    kept = checkpointed(kept.select(F.col("x.key").alias("__kept"), F.col("x.id").alias("__of"), F.col("x.n").alias("__n")))

    def among(which: DataFrame) -> DataFrame:
        rows = docs.withColumn("__id", text_digest(F.col(text)))
        return rows.join(which, (F.col("__id") == F.col("__of")) & F.col(key).eqNullSafe(F.col("__kept")), "left_semi")

    # whole rows are only dealt once more where a key is repeated with its text
    repeated = kept.where("__n > 1")
    if repeated.isEmpty():
        return among(kept).select(docs.columns)
    twice = among(repeated).dropDuplicates([key, "__id"])
    return among(kept.where("__n = 1")).unionByName(twice).select(docs.columns)


def send(spark: SparkSession, value):
    """A broadcast of fitted values, whose size the caller bounds."""
    return spark.sparkContext.broadcast(value)


def in_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply a batch function to every Arrow batch; ``make`` runs once in each task."""

    def run(batches):
        step = make()
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return df.mapInArrow(run, schema)


def gapless(df: DataFrame, group: str, order: list[str], out: str, block_rows: int = 100_000) -> DataFrame:
    """Number the rows of each group from 0 by ``order`` within blocks, without gaps.

    A group is cut into blocks by the order of hashes of its rows, counted, and
    numbered block after block, so no task holds more than about a block.
    """
    counted = "__rows"
    rows = df.count()
    blocks = max(1, min(1 << 20, -(-rows // block_rows)))
    parted = df.withColumn("__block", F.pmod(F.xxhash64(F.lit("block"), *order), F.lit(blocks)))
    counts = parted.groupBy(group, "__block").agg(F.count(F.lit(1)).alias(counted))
    before = F.sum(counted).over(W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select(
        F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(before, F.lit(0)).alias("__before")
    )
    number = F.row_number().over(W.partitionBy(group, "__block").orderBy(*order)) - 1
    numbered = parted.withColumn("__number", number)
    return (
        numbered.join(offsets, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
        .withColumn(out, (F.col("__before") + F.col("__number")).cast("long"))
        .drop("__g", "__b", "__before", "__number", "__block")
    )


def _only_stars(links: DataFrame) -> bool:
    """Whether every u of the distinct links (u, v) has one v, which is no u itself."""
    with shuffles_dropped(links.sparkSession):
        ends = F.array(*[F.struct(F.col(c).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down")) for c, up in (("u", 1), ("v", 0))])
        nodes = links.select(F.explode(ends).alias("x")).groupBy("x.node").agg(F.sum("x.up").alias("up"), F.max("x.down").alias("down"))
        return nodes.where("up + down > 1 and up > 0").isEmpty()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node reachable, for every node that an edge names.

    Alternates between linking each node's larger neighbours to its smallest and
    linking its smaller ones likewise, until only stars are left. Each round is a
    reliable checkpoint. A node with many neighbours meets them in a join whose
    hot keys Spark splits, after a minimum that is aggregated before its shuffle.
    """
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    links = checkpointed(links)
    while not _only_stars(links):
        both = links.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x"))
        both = both.select("x.u", "x.v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # one row for each link, repeats included: the last step drops them
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
            .select(F.col("x.u").alias("u"), F.col("x.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        links = checkpointed(small)
    stars = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())


def local_stars(n: int, i, j):
    """Smallest index reachable in each of ``n`` places joined by the pairs (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, label[i], low)
        np.minimum.at(label, label[j], low)
        label = label[label]
        while True:
            jump = label[label]
            if (jump == label).all():
                break
            label = jump
        if (label == before).all():
            return label
