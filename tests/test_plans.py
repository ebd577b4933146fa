"""The plans of registered queries: predicates reach the scan of the table they are about."""

import re

import pytest

from palimpsest import catalog
from palimpsest.runtime import discard, materialize, remove_tables

FOLDER = "/root/testdata/sf0.001"
PUSHED = [
    "relational_scan", "predicate_equals", "predicate_in", "predicate_range", "predicate_tenant", "filter_expiry", "as_of_facts", "as_of_facts_top", "as_of_facts_many", "rank_prefer_types", "score_fused",
    "mode_action_outcome", "mode_mission", "stream_batch_extraction", "stream_importance", "stream_memory_type", "search_importance_buckets", "search_reward_buckets",
]


@pytest.mark.parametrize("name", PUSHED)
def test_filters_reach_the_scan(spark, name):
    plan = catalog.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    pushed = re.findall(r"PushedFilters: \[([^,\]]*)", plan)
    assert any(p.strip() for p in pushed), plan


def test_tables_of_a_session_can_be_removed(spark):
    kept = materialize(spark.range(3))
    assert kept.count() == 3
    remove_tables(spark)
    with pytest.raises(Exception):
        spark.read.parquet(kept.inputFiles()[0]).count()


def test_one_table_can_be_discarded(spark):
    gone, kept = materialize(spark.range(3)), materialize(spark.range(4))
    path = gone.inputFiles()[0]
    discard(gone)
    discard(spark.read.parquet(f"{FOLDER}/memories.parquet").limit(1))  # not a table of this session: left alone
    assert kept.count() == 4 and spark.read.parquet(f"{FOLDER}/memories.parquet").count() > 0
    with pytest.raises(Exception):
        spark.read.parquet(path).count()
