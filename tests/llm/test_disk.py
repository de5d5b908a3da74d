"""What the rounds of an operator leave on the executors' disks."""

import random
import time

import pytest
from pyspark.sql import functions as F

from leaguelens.llm.common import components
from leaguelens.session import DROP_SHUFFLES, checkpointed


def _shuffle_files(spark):
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getName() for f in map(blocks.apply, range(blocks.size())) if f.getName().startswith("shuffle_")}


def _new_files(spark, before):
    """Files are dropped in the background."""
    for _ in range(50):
        left = _shuffle_files(spark) - before
        if not left:
            break
        time.sleep(0.1)
    return left


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    before = _shuffle_files(spark)
    set_before = spark.conf.get(DROP_SHUFFLES)
    counts = checkpointed(spark.range(1000).groupBy(F.expr("id % 7 AS k")).count())
    assert not _new_files(spark, before)
    assert {(r["k"], r["count"]) for r in counts.collect()} == {(k, 143 if k < 6 else 142) for k in range(7)}
    assert spark.conf.get(DROP_SHUFFLES) == set_before


def test_the_frame_behind_a_checkpoint_runs_again(spark):
    counts = spark.range(1000).groupBy(F.expr("id % 7 AS k")).count()
    rows = sorted(counts.collect())
    assert sorted(checkpointed(counts).collect()) == rows == sorted(counts.collect())


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_components_of_chains_and_crowds(spark, kind):
    rng = random.Random(3)
    chain = [(k, k + 1) for k in range(200)]
    crowd = [(500, 501 + k) for k in range(300)] + [(900 + k % 7, 950 + k) for k in range(40)]
    edges = chain + crowd + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + crowd[:5]
    edges = [e if rng.random() < 0.5 else e[::-1] for e in edges]
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        before = dict(least)
        for a, b in edges:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
        if least == before:
            break

    def name(x):
        return x.to_bytes(4, "big") if kind == "binary" else x

    before = _shuffle_files(spark)
    found = components(spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}"), "a", "b")
    assert not _new_files(spark, before)
    rows = [(r["node"], r["component"]) for r in found.collect()]
    assert sorted(rows) == sorted((name(x), name(y)) for x, y in least.items())


def test_stars_take_no_round(spark):
    """Links that are stars already are read, written once and checked."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("stars", "")
    found = components(spark.createDataFrame([(0, k) for k in range(1, 40)], "a long, b long"), "a", "b")
    jobs = len(tracker.getJobIdsForGroup("stars"))
    spark.sparkContext.setJobGroup("none", "")
    assert jobs <= 8
    assert sorted(map(tuple, found.collect())) == [(k, 0) for k in range(40)]
