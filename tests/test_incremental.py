"""Key index, feature state: what is kept up to date equals what is built at once and reads no history."""

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leaguelens.plans import feature_state as fs
from leaguelens.plans import features as fe
from leaguelens.plans.increment import Store
from leaguelens.sources.key_index import KeyIndex

SCHEMA = T.StructType([T.StructField("k", T.LongType()), T.StructField("name", T.StringType()), T.StructField("v", T.LongType())])


def _read(spark, path):
    return sorted(map(tuple, spark.read.schema(SCHEMA).parquet(path).collect()), key=repr)


def _rows(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def test_append_by_index(spark, tmp_path):
    path = f"{tmp_path}/t"
    index = KeyIndex(path, SCHEMA, ["k", "name"], buckets=8)
    first = _rows(spark, (1, "a", 1), (1, "a", 0), (2, None, 5), (None, None, 7))
    index.append(first)
    index.append(first)  # null keys match too
    want = [(1, "a", 0), (2, None, 5), (None, None, 7)]
    assert _read(spark, path) == sorted(want, key=repr)
    more = _rows(spark, (1, "a", 9), (3, "c", 1))
    files = set(spark.read.parquet(path).inputFiles())
    plan = index.missing(more)
    assert not files & set(plan.inputFiles())  # nothing of the table's rows
    executed = plan._jdf.queryExecution().executedPlan().toString()
    (pruned,) = {line for line in executed.splitlines() if "PartitionFilters" in line and "__bucket" in line}
    assert "PartitionFilters: [__bucket" in pruned  # only the buckets that the batch falls into
    index.append(more)
    assert _read(spark, path) == sorted([*want, (3, "c", 1)], key=repr)


def test_index_heals(spark, tmp_path):
    path = f"{tmp_path}/t"
    index = KeyIndex(path, SCHEMA, "k", buckets=4)
    index.append(_rows(spark, (1, "a", 1)))
    _rows(spark, (2, "b", 2)).write.mode("append").parquet(path)  # a crash before the index, or another writer
    index.append(_rows(spark, (1, "x", 0), (2, "x", 0), (3, "c", 3)))
    assert [r[0] for r in _read(spark, path)] == [1, 2, 3]
    _rows(spark, (7, "g", 7)).write.mode("overwrite").parquet(path)
    index.append(_rows(spark, (1, "back", 1), (7, "x", 0)))
    assert _read(spark, path) == [(1, "back", 1), (7, "g", 7)]
    index.append(_rows(spark).limit(0))
    assert len(_read(spark, path)) == 2


def test_extend_numbers_on(spark, tmp_path):
    path = f"{tmp_path}/t"
    index = KeyIndex(path, SCHEMA, "name", number="k", buckets=4)
    index.extend(_rows(spark, (0, "b", 1), (0, "a", 2)), "name")
    index.extend(_rows(spark, (0, "z", 1), (0, "a", 9), (0, "c", 3)), "name")
    assert _read(spark, path) == [(1, "a", 2), (2, "b", 1), (3, "c", 3), (4, "z", 1)]
    assert index.high(spark) == 4


def _fact(spark, periods=14, entities=6):
    rows = spark.range(periods * entities).select(
        (F.col("id") / entities).cast("int").alias("period_id"), (F.col("id") % entities).alias("entity_id")
    )
    seed = F.pmod(F.hash("period_id", "entity_id"), F.lit(20))
    rows = rows.where("pmod(hash(entity_id, period_id), 5) <> 0 or period_id < 2")
    return rows.select(
        (F.col("period_id") / 5).cast("int").alias("season"), "period_id", F.to_timestamp_ntz(F.lit("2020-01-01")).alias("date_start"),
        (F.col("period_id") % 3 == 0).alias("is_special"), "entity_id", (F.col("entity_id") % 2).alias("team_id"),
        (seed + 5).cast("double").alias("price"), F.when(seed != 3, seed.cast("double")).alias("points"),
        (1500.0 + seed).alias("rating_before"), (1501.0 + seed).alias("rating_after"), F.when(seed != 7, seed).cast("double").alias("seed_position"),
    )


def _same(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.select(a.columns).collect()))


@pytest.mark.parametrize("cuts", [[4, 9], [1, 2, 3]])
def test_features_in_steps(spark, tmp_path, cuts):
    fact = _fact(spark).cache()
    state = fs.FeatureState(spark, f"{tmp_path}/e", fs.ENTITY)
    for low, high in zip([-1, *cuts], [*cuts, 99], strict=True):
        state.extend(fact.where(f"period_id > {low} and period_id <= {high}"))
    whole = fe.entity_features(fact)
    assert _same(whole, state.features())
    last = fs.best_row(whole, "entity_id", "-period_id")
    assert _same(last, state.latest()) and "rating_after" in state.latest().columns
    with pytest.raises(ValueError, match="not later"):
        state.extend(fact.where("period_id = 13"))
    assert state.extend(fact.limit(0)).count() == 0


def test_a_step_reads_the_halo_only(spark, tmp_path):
    fact = _fact(spark)
    fact.write.parquet(f"{tmp_path}/fact")
    stored = spark.read.parquet(f"{tmp_path}/fact")
    state = fs.FeatureState(spark, f"{tmp_path}/e", fs.ENTITY)
    state.extend(stored.where("period_id <= 9"))
    halo = spark.read.parquet(f"{tmp_path}/e/halo/at_0")
    assert halo.groupBy("entity_id").count().agg(F.max("count")).first()[0] == fs.REACH
    new = state.extend(stored.where("period_id > 9"))
    assert all("/at_1/" in f for f in new.inputFiles())
    # a step that failed before its marker is written over
    again = fs.FeatureState(spark, f"{tmp_path}/e2", fs.ENTITY)
    again.extend(stored.where("period_id <= 9"))
    spark.range(3).write.parquet(f"{tmp_path}/e2/features/at_1")
    again.extend(stored.where("period_id > 9"))
    assert _same(fe.entity_features(fact), again.features())


def test_scoring_frames_from_the_state(spark, tmp_path):
    fact = _fact(spark).cache()
    teams = fact.groupBy("season", "period_id", "date_start", "is_special", "team_id").agg(F.sum("points").alias("points"), F.avg("price").alias("price"))
    entity, team = fs.FeatureState(spark, f"{tmp_path}/e", fs.ENTITY), fs.FeatureState(spark, f"{tmp_path}/t", fs.TEAM)
    for part in ("period_id <= 6", "period_id > 6"):
        entity.extend(fact.where(part))
        team.extend(teams.where(part))
    target = spark.sql("select 3 as season, 1 as period_num, 14 as period_id, timestamp_ntz'2021-01-01' as date_start, true as is_special")
    dim = spark.range(6).select(F.concat(F.lit("e"), "id").alias("entity_name"), F.col("id").alias("entity_id"))
    prices = dim.select(F.lit(3).alias("season"), F.lit(1).alias("period_num"), F.col("entity_name").alias("entity"), F.lit(9.0).alias("price"))
    dim_team = spark.range(2).select(F.lit(3).alias("season"), F.col("id").alias("team_id"), F.concat(F.lit("t"), "id").alias("team_name"))
    team_prices = dim_team.select("season", F.lit(1).alias("period_num"), F.col("team_name").alias("team"), F.lit(7.0).alias("price"))
    frames = fs.scoring_frames(entity, team, target, prices, dim, team_prices, dim_team)
    assert _same(fe.scoring_frame_entity(target, prices, dim, fe.entity_features(fact), fact), frames[0])
    assert _same(fe.scoring_frame_team(target, team_prices, dim_team, fe.team_features(teams, "team_id")), frames[1])


def test_a_slice_is_replaced_in_place(spark, tmp_path):
    from leaguelens.sources.tables import overwrite_table, replace_partitions

    path = f"{tmp_path}/t"
    overwrite_table(_rows(spark, (1, "a", 1), (2, "b", 2), (3, "b", 3), (4, None, 4)), path, "name")
    before = set(spark.read.parquet(path).inputFiles())
    replace_partitions(_rows(spark, (9, "b", 9), (10, "c", 10)), path, "name")
    found = spark.read.schema(SCHEMA).parquet(path).select("k", "name", "v")
    assert sorted(map(tuple, found.collect())) == [(1, "a", 1), (4, None, 4), (9, "b", 9), (10, "c", 10)]
    kept = {f for f in before if "name=b" not in f}
    assert kept <= set(spark.read.parquet(path).inputFiles())


# ---- deliveries


def _raw(spark):
    """Raw rows of five entities in two teams over two seasons, under names and dates only."""
    grain, points, prices, placed, seeds, meetings = ["season", "period_num"], [], [], [], [], []
    for k in range(7):
        season, num = (2020, k + 1) if k < 4 else (2021, k - 3)
        meetings.append((season, f"Round {num}", datetime.datetime(season, num, 1), k % 3 == 0))
        for e in range(5):
            if (e + k) % 6 == 0:
                continue  # not everybody is there
            name, team = f"e{e}", f"t{e % 2}"
            points.append((season, num, name, float((e * 7 + k * 3) % 11)))
            prices.append((season, num, name, float(5 + (e + k) % 4)))
            if (e * k) % 5 != 1:  # some have points without a result
                placed.append((season, num, name, team, float((e * 3 + k) % 5 + 1), "Finished", 0, 0, 0, 0))
            seeds.append((season, num, name, (e * 2 + k) % 5 + 1, 1))
    named = spark.createDataFrame
    points = named(points, "season int, period_num int, entity string, points double")
    prices = named(prices, "season int, period_num int, entity string, price double")
    placed = named(placed, "season int, period_num int, entity string, team string, finish_position double, status string, dns int, dnf int, dsq int, nc int")
    of = placed.select("entity", "team").distinct()
    return {
        "meetings": named(meetings, "season int, period_name string, date_start timestamp_ntz, is_special boolean"),
        "entity_points": points,
        "entity_prices": prices,
        "team_points": points.join(of, "entity").groupBy(*grain, "team").agg(F.sum("points").alias("points")),
        "team_prices": prices.join(of, "entity").groupBy(*grain, "team").agg(F.avg("price").alias("price")),
        "placements": placed,
        "seeds": named(seeds, "season int, period_num int, entity string, seed_position int, seed_laps int"),
    }


def _between(raw, low, high):
    out = {}
    for name, df in raw.items():
        time = F.year("date_start") * 100 + F.month("date_start") if name == "meetings" else F.col("season") * 100 + F.col("period_num")
        out[name] = df.where((time > low) & (time <= high))
    return out


def _rounded(df, columns):
    cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.select(columns).dtypes]
    return sorted(map(repr, df.select(*cols).collect()))


def test_deliveries_equal_one_build(spark, tmp_path):
    """Three deliveries, the second with an entity unheard of before, equal one; repeats change nothing."""
    raw = _raw(spark)
    one, many = Store(spark, f"{tmp_path}/one"), Store(spark, f"{tmp_path}/many")
    named = {"entity_points", "entity_prices", "placements", "seeds"}
    first = {k: v.where("entity <> 'e0'") if k in named else v for k, v in _between(raw, 0, 202003).items()}
    rest = _between(raw, 202003, 202199)
    assert one.deliver({k: v.unionByName(rest[k]) for k, v in first.items()}) == 0
    assert many.deliver(first) == 0
    assert many.deliver(first) == 0 and many.steps() == [0]
    assert many.deliver(_between(raw, 202003, 202101)) == 1
    overlapping = {k: v.where("season = 2021") if k in named else v for k, v in _between(raw, 202004, 202199).items()}
    assert many.deliver(overlapping) == 2 and many.steps() == [0, 1, 2]
    ids = dict(map(tuple, many.dim("entity").select("entity_name", "entity_id").collect()))
    assert ids == {"e1": 1, "e2": 2, "e3": 3, "e4": 4, "e0": 5}  # ids go on from the highest
    assert sorted(map(repr, many.dim("period").collect())) == sorted(map(repr, one.dim("period").collect()))
    facts = ["season", "period_num", "entity_name", "team_name", "price", "points", "rating_before", "rating_after", "seed_position"]
    assert _rounded(one.built("entity_fact"), facts) == _rounded(many.built("entity_fact"), facts)
    teams = ["season", "period_num", "team_name", "price", "points"]
    assert _rounded(one.built("team_fact"), teams) == _rounded(many.built("team_fact"), teams)
    features = ["season", "date_start", "price", "points", *fe.ENTITY_FEATURES]
    assert _rounded(one.entities.features(), features) == _rounded(many.entities.features(), features)
    features = ["season", "date_start", "price", "points", *fe.TEAM_FEATURES]
    assert _rounded(one.teams.features(), features) == _rounded(many.teams.features(), features)
    late = raw["entity_points"].where("season = 2021 and period_num = 1").limit(1).withColumn("entity", F.lit("new"))
    with pytest.raises(ValueError, match="built already"):
        many.deliver({"entity_points": late})
