from collections import Counter

import pytest

from cairn.plans import summary
from cairn.sources import catalog
from tests.test_catalog import ROWS, padded

MORE = {
    "provenance": [("v", "k", "aligner", None, None, None, None), ("w", "k", "other", None, None, None, None)],
    "classes": [("k1", "x", "a", None, None, None), ("k2", "x", "b", None, None, None)],
    "vtables": [("t1", "x", "k1", "va", 1, "primary", 0, 2, "v", '{"extent": {"extent_suspect": true}}'), ("t2", "x", "k2", "va", 2, "primary", 0, 1, "v", '{"extent": {"extent_suspect": false}}'), ("t3", "x", "k2", "va", 3, None, 4, 1, "v", "{}")],
    "vtable_slots": [("t1", "x", 0, "g1", None, None, "v"), ("t1", "x", 1, "g2", None, None, "v")],
    "codeview_type_records": [("r1", "x", "tpi", 1, 1, 2, bytearray(b"abc"), "d"), ("r2", "x", "tpi", 2, 1, 2, None, "d")],
    "data_symbol_record_assertions": [("da1", "e", "x", "d1", "g1", 1), ("da2", "e", "x", "d2", "g1", 1), ("da3", "e", "x", "d3", None, None)],
    "unresolved_targets": [("u1", "x", None, "k", None, None, "open", None, "v", "{}"), ("u2", "x", None, "k", None, None, "resolved", None, "v", "{}")],
    "control_flow_uses": [],
    "control_flow_scans": [("s1", "e", "x", "p", None, None, None, None, None, None, "complete"), ("s2", "e", "x", "p", None, None, None, None, None, None, None)],
    "review_decisions": [("d1", "s1", None, None, "r", "defer", None, "why", "v", "rel", None), ("d2", "s1", None, None, "r", "accept", None, "why", "v", "rel", "d1"), ("d3", "s2", None, None, "r", "defer", None, "why", "v", "rel", "gone")],
}


def _published(spark, folder, rows):
    tables = {n: spark.createDataFrame(padded(n, r), catalog.schema(n)) for n, r in rows.items()}
    return catalog.publish(spark, tables, str(folder / "graph"))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return _published(spark, tmp_path_factory.mktemp("g"), {**ROWS, **MORE})


def test_counts(graph):
    rows = {**ROWS, **MORE}
    got = {(r["metric"], r["grp"]): r["n"] for r in summary.summary(graph, "aligner").collect()}
    want = {(m, None): len(rows.get(t, [])) for m, t in summary.ROWS.items()}
    effects = lambda t: Counter(r[2] for r in rows.get(t, []))
    want |= {("match_hypotheses.evidence_effects", k): n for k, n in effects("match_hypothesis_evidence").items()}
    want |= {
        ("programs.functions", "pc"): 1, ("programs.functions", "xbox360"): 3, ("programs.unique_addresses", "pc"): 1, ("programs.unique_addresses", "xbox360"): 2,
        ("shared_address_groups", None): 1,
        ("vtables.classes", "pc"): 0, ("vtables.classes", "xbox360"): 2, ("vtables.tables", "pc"): 0, ("vtables.tables", "xbox360"): 3, ("vtables.slots", "pc"): 0, ("vtables.slots", "xbox360"): 2,
        ("vtables.extent_suspect_tables", "pc"): 0, ("vtables.extent_suspect_tables", "xbox360"): 1, ("vtables.roles", "xbox360/primary"): 2, ("vtables.roles", "xbox360/null"): 1,
        ("function_signatures.total", None): 2, ("function_signatures.resolved", None): 2, ("function_signatures.unresolved", None): 0, ("function_signatures.variadic", None): 0,
        ("call_edges.total", None): 0, ("call_edges.resolved", None): 0, ("call_edges.unresolved", None): 0,
        ("match_hypotheses.sets", None): 2, ("match_hypotheses.alternatives", None): 2, ("match_hypotheses.evidence", None): 2, ("match_hypotheses.alternative_evidence", None): 0,
        ("vtable_alignments.fold_bundle_alternatives", None): 1, ("vtable_alignments.scalar_alternatives", None): 1,
        ("codeview_types.raw_records", None): 2, ("codeview_types.raw_body_bytes", None): 3, ("codeview_types.tags", None): 0, ("codeview_types.definitions", None): 0, ("codeview_types.forward_references", None): 0,
        ("data_symbols.record_assertions", None): 3, ("data_symbols.resolved_records", None): 2, ("data_symbols.unresolved_records", None): 1, ("data_symbols.unique_addresses", None): 1,
        ("control_flow.site_assertions", None): 0, ("control_flow.use_assertions", None): 0, ("control_flow.procedure_scans", None): 2, ("control_flow.scan_statuses", "complete"): 1, ("control_flow.scan_statuses", "null"): 1,
        ("unresolved_targets", None): 1,
        ("reviews.decisions", None): 3, ("reviews.historical_actions", "defer"): 2, ("reviews.historical_actions", "accept"): 1, ("reviews.current_decisions", None): 2,
    }
    statuses = {k: n for k, n in got.items() if k[0] == "reviews.current_statuses"}
    assert sum(statuses.values()) == 2 and len(statuses) == 2
    assert {k: n for k, n in got.items() if k not in statuses} == want


def test_another_producer(graph):
    got = {r["metric"]: r["n"] for r in summary.summary(graph, "nobody").where("grp IS NULL").collect()}
    assert got["match_hypotheses.alternatives"] == 2 and got["vtable_alignments.fold_bundle_alternatives"] == 0 and got["vtable_alignments.scalar_alternatives"] == 0


def test_empty_catalog(spark, tmp_path):
    got = summary.summary(_published(spark, tmp_path, {}), "aligner").collect()
    assert len(got) >= 45 and all(r["grp"] is None and r["n"] == 0 for r in got)


def test_each_table_is_scanned_once(graph):
    """Of the physical plan, as it is before it runs."""
    plan = summary.summary(graph, "aligner")._jdf.queryExecution().sparkPlan().toString()
    tables = {*summary.ROWS.values(), *summary.MEASURES, "programs", "functions", "classes", "vtables", "vtable_slots", "provenance", "match_hypothesis_sets", "match_hypothesis_alternatives", "review_decisions", "data_symbol_record_assertions"}
    assert plan.count("FileScan parquet") == len(tables)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
