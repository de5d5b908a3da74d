"""Registered queries against their SQL at the smallest scale.

A spread over the families by default; all of them with ALL_QUERIES=1.
"""

import os

import pytest

from leaguelens.catalog import ORACLE, QUERIES
from tests.oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
SPREAD = [
    "s3_read_json_landing",
    "s12_column_profile",
    "p8_unpivot_sheet",
    "j8_pair_with_leader",
    "j9_asof_carry",
    "a7_string_agg",
    "a9_dist_summary",
    "w2_trailing_mean",
    "w10_dense_rank_desc",
    "t4_latest_before",
    "u4_union_priority",
    "fn09_13_time_functions",
    "fn15_27_number_functions",
    "d2_extend_keys",
    "v10_run_suite",
    "g3_entity_features",
    "g9_sequential_rating",
    "g13_bootstrap_outcomes",
    "g16_best_selection",
    "r4_mart_model_evaluation",
    "m6_expanding_folds",
]
NAMES = sorted(ORACLE) if os.environ.get("ALL_QUERIES") else SPREAD

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(QUERIES[name](spark, FOLDER), con, ORACLE[name]) == []
