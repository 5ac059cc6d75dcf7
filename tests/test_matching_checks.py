"""What the matcher records is a valid part of a graph; each changed value breaks its check; replays add nothing."""

import pytest
from pyspark.sql import functions as F

from cairn.operators import derivations as dv
from cairn.operators import load
from cairn.plans import validation, validation_matching
from cairn.sources import catalog
from cairn.sources.store import Version
from tests.test_catalog import padded
from tests.test_derivations import ADDRESS, FOLD, alt, edge, flow, pc, run, xf

NAMES = [n for n, f in validation.CHECKS.items() if getattr(f, "__module__", "") == validation_matching.__name__]
PREFIX = "control_flow_matching_"
SEEDS = [alt("a", pc("A"), xf("A")), alt("b", pc("B"), xf("B")), alt("d", pc("D"), xf("D"))]
EDGES = [edge("1", "A", pc("B")), edge("2", "A", pc("C")), edge("3", "D", pc("B")), edge("4", "D", pc("C"))]
FLOWS = [flow("1", "A", xf("B")), flow("2", "A", ADDRESS("g1")), flow("3", "D", xf("B")), flow("4", "D", FOLD)]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    """A store with the functions, into which a matching was loaded."""
    table = lambda n, rows: spark.createDataFrame(padded(n, rows), catalog.schema(n))
    base = {
        "programs": [("pc", "pc", "game"), ("x", "xbox360", "debug")],
        "provenance": [("m", "derived", "own.control_flow_matching"), ("v", "test", "other")],
        "address_groups": [("g1", "x", "xbox-va", 0x82001000, "code"), *[(f"p{k}", "pc", "ram", k, "code") for k in range(4)]],
        "functions": [*[(f, "pc", "p0", f) for f in "ABCD"], ("xB", "x", "g1", "xB")],
        "fold_groups": [("fold:G", "x", "icf", "v")],
    }
    store = load.load(Version(spark, str(tmp_path_factory.mktemp("m") / "store")), {n: table(n, r) for n, r in base.items()})
    rows = dv.candidates(run(spark, SEEDS, EDGES, FLOWS, [("fold:G", "q")]), "m", "x")
    first = load.load(store, rows, check_references=False)
    again = load.load(first, rows, check_references=False)
    assert (store.sequence, first.sequence, again.sequence) == (1, 2, 2)  # the same result adds nothing
    assert first.functions.count() == store.functions.count() and first.function_names.isEmpty()
    return first


def broken(graph):
    return {r["check"].removeprefix(PREFIX) for r in validation.violations(graph, NAMES).collect() if r["violations"]}


def test_valid(graph):
    assert len(NAMES) == 5 and broken(graph) == set()
    assert graph.match_hypothesis_sets.count() == 2 and graph.match_hypothesis_alternatives.where("xbox_fold_group_id IS NOT NULL").count() == 1 and graph.unresolved_targets.count() == 1


class Changed:
    def __init__(self, graph, table, change):
        self.graph, self.table, self.change = graph, table, change

    def __getattr__(self, name):
        df = getattr(self.graph, name)
        return self.change(df) if name == self.table else df


def put(column, value):
    return lambda df: df.withColumn(column, F.lit(value).cast(df.schema[column].dataType))


def text(old, new):
    return lambda df: df.withColumn("details_json", F.replace("details_json", F.lit(old), F.lit(new)))


STATE, SCOPE, WHOLE, SAME = "candidate_state_mismatch", "evidence_scope_mismatch", "incomplete_alternatives", "disjunction_mismatch"
CASES = [
    ("match_hypothesis_sets", put("status", "accepted"), {STATE}),
    ("match_hypothesis_sets", text('"confidence":null,', ""), {STATE}),
    ("match_hypothesis_sets", text('"confidence":null', '"confidence":0.5'), {STATE}),
    ("match_hypothesis_sets", text("_v1", "_v2"), {STATE}),
    ("match_claims", put("confidence_label", "high"), {STATE}),
    ("match_claims", text("forbidden", "allowed"), {STATE}),
    ("unresolved_targets", put("name_hint", "x"), {STATE}),
    ("unresolved_targets", put("program_id", "pc"), {STATE}),
    ("match_hypothesis_alternative_evidence", put("effect", "contradicts"), {SCOPE}),
    ("match_hypothesis_alternative_evidence", text('"independent_confirmation":false', '"independent_confirmation":true'), {SCOPE}),
    ("match_hypothesis_evidence", lambda df: df.sparkSession.createDataFrame([("e", "h", "supports", "k", "g", "m")], df.schema), {SCOPE, "provenance_leakage"}),
    ("match_hypothesis_alternative_evidence", lambda df: df.limit(0), {WHOLE}),
    ("match_claims", put("provenance_id", "v"), {WHOLE, STATE}),
    ("match_hypothesis_alternatives", lambda df: df.where("xbox_fold_group_id IS NULL"), {SAME, SCOPE}),
    ("match_hypothesis_sets", text('"alternative_ids":[', '"alternative_ids":["more",'), {SAME}),
    ("match_hypothesis_sets", text("unique_residual_call_proposal", "other"), {SAME}),
    ("match_hypothesis_sets", put("identity_key", "other"), {SAME}),
    ("call_edges", lambda df: df.sparkSession.createDataFrame([("e", "x", "f", None, None, "call", "m")], df.schema), {"provenance_leakage"}),
]


@pytest.mark.parametrize("table,change,want", CASES, ids=[f"{k}-{c[0]}" for k, c in enumerate(CASES)])
def test_one_changed_table(graph, table, change, want):
    assert broken(Changed(graph, table, change)) == want
