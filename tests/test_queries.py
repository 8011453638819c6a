"""Every registered query against its SQL twin on the smallest tables, plan checks included."""

import os

import pytest
from check_oracle import compare

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    line = compare(spark, SF, entry.queries()[name], entry.oracle_sql().get(name))
    assert not line.startswith("BAD"), line


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_entry(spark):
    assert entry.entry(spark).count() == 5


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_they_need(spark):
    text = plan(entry.queries()["bars_per_instrument"](spark, SF))
    schema = text.split("ReadSchema: ")[1].split(">")[0]
    assert "l_tax" not in schema and "l_shipdate" not in schema


@pytest.mark.parametrize("name", ["step_profiles", "pitch_class_scores", "velocity_histogram_kl", "interval_scores"])
def test_scores_shuffle_only_to_reach_their_bars(spark, name):
    """Per side: one shuffle that combines equal notes and one by bar; nothing after that."""
    assert plan(entry.queries()[name](spark, SF)).count("Exchange hashpartitioning") <= 6


def test_no_query_plan_has_a_cartesian_product(spark):
    for name in ("flagship", "pixel_scores", "self_similarity", "condition_grid", "transition_entropy"):
        assert "CartesianProduct" not in plan(entry.queries()[name](spark, SF))
