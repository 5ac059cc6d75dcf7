"""Queries on tables that differ from the given ones in what larger ones have: ties, large keys, repeated groups."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cairn.operators import matching


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, **tables):
        c = duckdb.connect()
        for table, statement in tables.items():
            c.sql(f"COPY ({statement}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
            c.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        found = c.sql(entry.oracle_sql()[name])
        at = [found.columns.index(k) for k in df.columns]
        want = sorted(tuple(str(r[i]) for i in at) for r in found.fetchall())
        assert want and sorted(tuple(str(v) for v in r) for r in df.collect()) == want

    return check


def test_section_overlap_takes_ties_in_the_order_of_their_keys(same_as_sql):
    same_as_sql("section_overlap", part="SELECT 99 - k AS p_partkey, 'b' || k % 3 AS p_brand, 7 AS p_size, 900.3 AS p_retailprice FROM range(90) r(k)")


def test_big_endian_words_of_more_than_four_bytes(same_as_sql):
    same_as_sql("big_endian_words", part="SELECT k * 30000 AS p_partkey, CAST(k % 3 AS INTEGER) AS p_size FROM range(40) r(k)")


def test_neighbourhoods_are_dealt_by_their_number(spark, sf, monkeypatch):
    monkeypatch.setattr("cairn.sources.staging.TASK_ROWS", 500, raising=False)
    df = entry.queries()["matcher_neighbourhoods"](spark, sf)
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").count() + spark.read.parquet(f"{sf}/orders.parquet").count()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(anchor") == 1 and f", {-(-rows // 500)})" in plan


def test_neighbourhoods_of_repeated_and_unknown_ends(spark):
    from cairn.operators import matching

    pc = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a"), (3, "c"), (None, "a"), (9, "a")], "anchor long, pc_key string")
    xbox = spark.createDataFrame([(1, "x"), (1, "y"), (1, "y"), (2, "x"), (2, "z"), (4, "x"), (None, "x"), (9, "x")], "anchor long, xbox_key string")
    mapping = spark.createDataFrame([("a", "x", "exact"), ("a", "x", "exact"), ("a", "z", "fold_member_blocker"), ("b", "q", "exact"), ("b", None, "exact"), (None, "x", "exact")], "pc_key string, xbox_key string, kind string")
    anchors = spark.createDataFrame([(k,) for k in (1, 1, 2, 3, 4, 5)], "anchor long")
    names = ("anchor", "pc_count", "xbox_count", "closed_count", "blocked_count", "one_pc_key", "one_xbox_key", "outcome")
    got = sorted(tuple(r[c] for c in names) for r in matching.neighbourhoods(pc, xbox, mapping, anchors).collect())
    assert got == [
        (1, 2, 2, 1, 0, "b", "y", "unique_residual_proposal"),
        (2, 1, 2, 0, 2, None, None, "blocked_ambiguous_existing_relations"),
        (3, 1, 0, 0, 0, "c", None, "missing_eligible_xbox_calls"),
        (4, 0, 1, 0, 0, None, "x", "missing_pc_calls"),
        (5, 0, 0, 0, 0, None, None, "missing_pc_calls"),
    ]


@pytest.mark.parametrize("name", ["catalog_flow_checks", "catalog_slot_checks"])
def test_checks_of_a_catalog_group_lines_once(spark, sf, name):
    plan = entry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    lines = [k for k in plan.splitlines() if "Relation [" in k and "l_returnflag" in k]
    assert len(lines) <= 3  # views that group lines are read as they were written


def test_partners_that_repeat_are_one_before_they_are_dealt(spark):
    from cairn.operators import checks

    df = checks.orphans(spark.range(10).withColumnRenamed("id", "k"), spark.range(1000).selectExpr("id % 7 AS k"), ["k"])
    assert sorted(r["k"] for r in df.collect()) == [7, 8, 9] and "Aggregate" in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["matcher_square_derivations", "matcher_evidence"])
def test_matcher_stores_and_deals_no_content_ids(spark, sf, monkeypatch, name):
    """Ids of 99 characters are made when a result is read; only the table of what bundles offer has them."""
    from pyspark.sql import functions as F

    from cairn.operators import derivations as dv

    stored, keep = {}, dv.written
    monkeypatch.setattr(dv, "written", lambda df, what="t": stored.setdefault(what, keep(df, what)))
    df = entry.queries()[name](spark, sf)
    assert {n for n, t in stored.items() if t.where(F.to_json(F.struct(*t.columns)).contains(":sha256:")).count()} == {"offers"}
    assert not df.isEmpty()


def test_slot_maps_deal_a_common_ancestor_in_blocks(spark, sf, monkeypatch):
    query = entry.queries()["primary_slot_maps"]
    want = sorted(map(tuple, query(spark, sf).collect()))
    monkeypatch.setattr("cairn.sources.staging.TASK_ROWS", 25, raising=False)
    df = query(spark, sf)
    assert sorted(map(tuple, df.collect())) == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [ancestor" in plan and "block" in plan


def test_ways_over_cycles_are_counted_and_not_stored(spark, monkeypatch):
    from itertools import permutations

    from cairn.operators import alignment

    stored, keep = [], alignment.written
    for name, value in (("STARTS", 1), ("AT_ONCE", 40), ("REPEATED", 7)):
        monkeypatch.setattr(alignment, name, value, raising=False)
    monkeypatch.setattr(alignment, "written", lambda df, what="t": stored.append(keep(df, what)) or stored[-1])
    offset = {(a, b): None if (a, b) == (0, 1) else (a * b) % 3 * 4 - 4 for a in range(6) for b in range(6)}
    df = spark.createDataFrame([(f"c{a}", f"c{b}", o) for (a, b), o in offset.items()], "class_name string, base_name string, base_offset long")
    want = []
    for n in range(2, 7):
        for way in permutations(range(6), n):
            steps = [offset[e] for e in zip(way, way[1:])]
            want.append((f"c{way[0]}", f"c{way[-1]}", None if None in steps else sum(steps)))
    got = [(r["class_name"], r["base_name"], r["offset"]) for r in alignment.base_offsets(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert sum(t.count() for t in stored) < len(want) / 2  # 1,950 ways


def test_ways_through_more_classes_than_a_word_has_bits(spark, monkeypatch):
    from cairn.operators import alignment

    edges = [(k, k + d, None if k % 50 == 7 else d * 4 - 8 * (k % 3)) for k in range(70) for d in (1, 3) if (d == 1 or k % 30 == 5) and k + d < 70]
    edges += [(k + 2, k, 5) for k in (10, 40)] + [(0, 0, 1), (1, 2, 4)]
    df = spark.createDataFrame([(f"c{a}", f"c{b}", o) for a, b, o in edges], "class_name string, base_name string, base_offset long")
    want, ways = [], [((a, b), o) for a, b, o in edges if a != b]
    while ways:
        want += [(f"c{way[0]}", f"c{way[-1]}", o) for way, o in ways]
        ways = [((*way, b), None if None in (o, p) else o + p) for way, o in ways for a, b, p in edges if a == way[-1] and b not in way]
    monkeypatch.setattr(alignment, "STARTS", 0.1, raising=False)
    got = [(r["class_name"], r["base_name"], r["offset"]) for r in alignment.base_offsets(df).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_pairs_of_one_key_are_dealt(spark, monkeypatch):
    """all ends of one key, on both sides, are no one task's work; null and repeated ids stay."""
    monkeypatch.setattr(matching, "BLOCK", 20, raising=False)
    monkeypatch.setattr(matching, "TASK_PAIRS", 10_000, raising=False)
    mapping = [(k if k else None, "function", "one", None) for k in range(400)] + [(7, "function", "one", None), (8, "function", None, None), (9, "unresolved_target", None, "g")]
    flows = [(k, "function", "one", None) for k in range(200)] + [(3, "function", "one", None), (500, "fold_group", "fold", None), (501, "function", None, None), (502, "address_only", None, "g")]
    kind = "{} long, endpoint_kind string, identity string, address_group_id string"
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = matching.relation_kinds(spark.createDataFrame(mapping, kind.format("bundle_id")), spark.createDataFrame(flows, kind.format("flow_id")), spark.createDataFrame([("one", "fold"), ("one", "fold")], "function_id string, fold_group_id string"))
        got = [tuple(r) for r in out.withColumn("task", F.spark_partition_id()).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    one = lambda rows: [r[0] for r in rows if r[2] == "one"]
    want = [(a, b, "exact") for a in one(mapping) for b in one(flows)] + [(9, 502, "exact")] + [(a, 500, "fold_member_blocker") for a in one(mapping)]
    assert Counter(r[:3] for r in got) == Counter(want)
    assert max(Counter(r[3] for r in got).values()) < len(got) / 4


def test_pairs_of_two_blocks_are_not_held_at_once(spark):
    """Spark holds all rows that compiled steps make of one row, so a step that isn't compiled cuts blocks before they are paired."""
    ends = spark.createDataFrame([(k, "function", "one", None) for k in range(30)], "id long, endpoint_kind string, identity string, address_group_id string")
    out = matching.relation_kinds(ends.withColumnRenamed("id", "bundle_id"), ends.withColumnRenamed("id", "flow_id"), spark.createDataFrame([], "function_id string, fold_group_id string"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    cuts = [line for line in plan if "Generate explode(transform(" in line]
    assert len(cuts) == 3 and not any("*(" in line for line in cuts)
    assert sorted((r["bundle_id"], r["flow_id"]) for r in out.collect()) == [(a, b) for a in range(30) for b in range(30)]
