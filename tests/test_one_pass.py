"""Plans that read their input once however many rules, sheets or rows of a hot key there are."""

import random

import pytest

from leaguelens.operators.ordering import top_k_per_group
from leaguelens.operators.quality import run_suite
from leaguelens.sources.landing import read_wide_sheets


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


RULES = {
    "columns": ["k", "t", "gone"],
    "not_null": ["k", "v", "gone"],
    "grain": ["k", "t"],
    "range": {"v": (0, 5), "t": (None, 2)},
    "coverage": (["k"], "t", 2),
    "filled": (["k"], "w"),
    "resolved": ["k", "v"],
}
ROWS = [("a", 1, 1.0, 1), ("a", 1, None, None), ("a", 3, 9.0, 2), ("b", 1, 2.0, None), (None, 2, -1.0, None)]


@pytest.fixture
def written(spark, tmp_path):
    spark.createDataFrame(ROWS, "k string, t int, v double, w int").write.parquet(f"file://{tmp_path}/t")
    return spark.read.parquet(f"file://{tmp_path}/t")


def test_suite_counts_every_rule(spark, written):
    got = {tuple(r) for r in run_suite({"t": written, "none": written.limit(0)}, {"t": RULES, "none": RULES, "far": {}}).collect()}
    assert got == {
        ("t", "required_column", "gone", 5), ("t", "not_null", "k", 1), ("t", "not_null", "v", 1),
        ("t", "grain", None, 1), ("t", "range", "v", 2), ("t", "range", "t", 1), ("t", "coverage", None, 2),
        ("t", "filled", "w", 2), ("t", "resolved", None, 2), ("none", "not_empty", None, 1),
        ("none", "required_column", "gone", 1), ("far", "exists", None, 1),
    }


def test_suite_reads_a_table_once_and_once_per_grouping(spark, written):
    rows_only = {k: v for k, v in RULES.items() if k in ("columns", "not_null", "range", "resolved")}
    assert plan(run_suite({"t": written}, {"t": rows_only})).count("Relation [") == 1
    # rows, (k, t), and coverage with filled by k
    assert plan(run_suite({"t": written}, {"t": RULES})).count("Relation [") == 3


def test_suite_names_columns_with_blanks(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id int, ` v` int")
    assert [tuple(r) for r in run_suite({"t": df}, {"t": {"columns": ["id"]}}).collect()] == [("t", "column_whitespace", " v", 1)]


@pytest.mark.parametrize("k", [1, 3, 2000])
def test_top_k_of_hot_groups(spark, k):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice([None, 1, 2, 3]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id int").repartition(6)
    out = top_k_per_group(df, "g", ["-v", "id"], k)
    want = []
    for g in ("hot", "a", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        want += own[:k]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr) and out.columns == df.columns


def test_top_k_limits_before_each_shuffle(spark):
    df = spark.range(100).selectExpr("id % 2 AS g", "id")
    text = physical(top_k_per_group(df, "g", "-id", 5))
    assert text.count("WindowGroupLimit") >= 4 and "Scan ExistingRDD" not in text
    rows = top_k_per_group(df, [], "-id", 2).collect()
    assert [r["id"] for r in rows] == [99, 98]


def _jobs(spark, run):
    spark.sparkContext.setJobGroup(name := f"jobs-{random.random()}", "")
    try:
        run()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


SHEETS = {
    "2020 Price": "Driver,1.0,2.0,Unnamed: 3\nann,1.5,,\n\"bo, b\",2,3,\n",
    "2021Price": "Unnamed: 0,Name,1.0,Race Name,Unnamed: 4\n,ann,4,5,6\n,cy,,7,\n",
    "2022Price": "Driver,1,1\nann,8,9\n",
    "2023Price": "Driver,7.0\n",
    "2024Price": "",
}


def _sheets(tmp_path, names):
    out = {}
    for name in names:
        (tmp_path / name).mkdir(exist_ok=True)
        (tmp_path / name / "part-0.csv").write_text(SHEETS[name])
        out[name] = f"file://{tmp_path}/{name}"
    return out


def test_sheets_of_all_widths(spark, tmp_path):
    out = read_wide_sheets(spark, _sheets(tmp_path, SHEETS), "entity", "period", "price")
    assert out.columns == ["entity", "period", "price", "source_sheet"]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted([
        ("ann", "1", 1.5, "2020 Price"), ("ann", "2", None, "2020 Price"),
        ("bo, b", "1", 2.0, "2020 Price"), ("bo, b", "2", 3.0, "2020 Price"),
        # an unnamed column without a value is left out, also as the first; one with a value stays
        ("ann", "1", 4.0, "2021Price"), ("ann", "race_name", 5.0, "2021Price"), ("ann", "unnamed:_4", 6.0, "2021Price"),
        ("cy", "1", None, "2021Price"), ("cy", "race_name", 7.0, "2021Price"), ("cy", "unnamed:_4", None, "2021Price"),
        ("ann", "11", 8.0, "2022Price"), ("ann", "12", 9.0, "2022Price"),
    ], key=repr)


def test_sheet_as_a_file_and_in_parts(spark, tmp_path):
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "part-0.csv").write_text("Driver,1\nann,1\n")
    (folder / "part-1.csv").write_text("Driver,1\nbo,2\n")
    (tmp_path / "single.csv").write_text("Driver,2\ncy,3\n")
    paths = {"parts": f"file://{folder}", "single": f"file://{tmp_path}/single.csv"}
    rows = read_wide_sheets(spark, paths, "entity", "period", "price").collect()
    assert sorted(map(tuple, rows)) == [("ann", "1", 1.0, "parts"), ("bo", "1", 2.0, "parts"), ("cy", "2", 3.0, "single")]


def test_more_sheets_take_no_more_scans_or_jobs(spark, tmp_path):
    plain = ["2020 Price", "2022Price", "2023Price"]
    frames = {}
    jobs = [_jobs(spark, lambda n=n: frames.update({n: read_wide_sheets(spark, _sheets(tmp_path, plain[:n]), "e", "p", "v")})) for n in (1, 3)]
    assert jobs[0] == jobs[1]
    assert [plan(frames[n]).count("Relation [") for n in (1, 3)] == [1, 1]
