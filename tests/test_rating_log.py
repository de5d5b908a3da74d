"""The state log holds what a state written whole would, and writes in proportion to the arrivals."""

import random

from pyspark.sql import types as T

from leaguelens.plans.rating_log import FAN, MANIFEST, StateLog, runs_of

STATE = T.StructType(
    [
        T.StructField(name, kind())
        for name, kind in [
            ("pool", T.StringType), ("entity", T.IntegerType), ("rating", T.DoubleType),
            ("last_season", T.IntegerType), ("changes", T.IntegerType),
        ]
    ]
)
RATED = "pool string, entity int, rating_after double, season int, changes int"


def test_log_equals_a_dict_and_merges(spark, tmp_path):
    rng = random.Random(5)
    home, held, arrived = f"file://{tmp_path}/log", {}, 0
    log = StateLog(spark, home, STATE, "pool", "entity")
    assert log.latest().isEmpty() and log.clock().isEmpty()
    for step in range(2 * FAN + 1):
        season = 2000 + step // 4
        rows = {(p, e): (rng.random(), season, step // 4) for p in ("a", None) for e in rng.sample(range(12), 3)}
        held |= rows
        arrived += len(rows)
        log.add(spark.createDataFrame([(*k, *v) for k, v in rows.items()], RATED))
        if step == FAN:  # go on from the written manifest, as the next batch of a stream does
            log.manifest().write.parquet(f"file://{tmp_path}/runs")
            runs = runs_of(spark.read.schema(MANIFEST).parquet(f"file://{tmp_path}/runs"))
            assert sorted(runs) == sorted(log.runs)
            log = StateLog(spark, home, STATE, "pool", "entity", runs)
    assert sorted(r.level for r in log.runs) == [0, 1, 1]
    assert {(r[0], r[1]): tuple(r[2:]) for r in log.latest().collect()} == held
    assert log.latest().count() == len(held)
    some = spark.createDataFrame([("a", 1), (None, 2), (None, 2), ("a", 99)], "pool string, entity int")
    assert {(r[0], r[1]) for r in log.latest(some).collect()} == {("a", 1), (None, 2)} & held.keys()
    assert {tuple(r) for r in log.clock().collect()} == {("a", 2004, 4), (None, 2004, 4)}
    written = spark.read.schema(log.schema).option("recursiveFileLookup", True).parquet(home).count()
    assert arrived <= written <= 2 * arrived  # one rewrite a level, two levels so far
    assert all(spark.read.parquet(r.path).count() <= FAN * 6 for r in log.runs)
