"""Plans that would not survive a thousand times the rows are not allowed."""

import re

import pytest

from cairn.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_no_nested_loops_and_no_python(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow", plan)


@pytest.mark.parametrize("name", ["matcher_outcomes", "triage_index", "name_exact", "classify_code", "current_leaf"])
def test_scans_read_only_what_is_used(spark, sf, name):
    plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert schema.count(":") <= 6


def test_filters_reach_the_scan(spark, sf):
    plan = registry.QUERIES["name_exact"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(p_name,red widget)" in plan


def test_pages_limit_groups_before_the_shuffle(spark, sf):
    plan = registry.QUERIES["fold_member_page"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"WindowGroupLimit.*Final[\s\S]*Exchange[\s\S]*WindowGroupLimit.*Partial", plan)
