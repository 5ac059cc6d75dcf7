import datetime

import pytest

from cairn.plans import documents, validation
from cairn.sources import catalog

ROWS = {
    "programs": [("pc", "pc", "game", None, None, "{}"), ("x", "xbox360", "debug", None, None, "{}")],
    "address_groups": [("g1", "x", "xbox-va", 0x82001000, "code"), ("g2", "x", "xbox-va", 0x82002000, "code"), ("p1", "pc", "ram", 0x401000, "code")],
    "functions": [("f1", "x", "g1", "a", "function", 1, None, None), ("f2", "x", "g1", "b", "function", 1, None, None), ("f3", "x", "g2", "c", "function", None, None, None), ("pf", "pc", "p1", "d", "function", None, None, None)],
    "function_names": [(1, "f1", "Actor::Update", "decorated", 0, "v", "{}"), (2, "f1", "Primary", "display", 1, "v", "{}"), (3, "f2", "Actor::Update", "decorated", 1, "v", "{}"), (4, "f3", "Other", "decorated", 1, "v", "{}")],
    "function_signatures": [("f1", "x", 1, "resolved", 1, 1, 0, "void (int)", "v"), ("f2", "x", 1, "resolved", 1, 1, 0, "void (int)", "v")],
    "function_signature_arguments": [("f1", 0, 116, 0, "int"), ("f2", 0, 116, 0, "int")],
    "fold_groups": [("fold", "x", "icf", "v")],
    "fold_group_members": [("fold", "x", "f1", "member"), ("fold", "x", "f2", "member")],
    "match_claims": [("c1", "pf", None, "f3", None, "candidate", None, "v")],
    "match_hypothesis_sets": [("s1", "pf", None, "candidate", "v"), ("s2", "pf", None, "candidate", "v")],
    "match_hypothesis_alternatives": [("a1", "s1", "c1", None), ("a2", "s2", None, "fold")],
    "match_hypothesis_evidence": [("e1", "s1", "supports", "k", "g", "v"), ("e2", "s2", "context", "k", "g", "v")],
    "claim_evidence": [("e3", "c1", "supports", "k", "h", "v")],
    "review_decisions": [("d1", "s1", None, None, "r", "defer", datetime.datetime(2024, 1, 1), "why", "v", "rel", None)],
}
ROWS["function_assertions"] = [(f"as{i}", r[0], r[1], *r[4:], "v") for i, r in enumerate(ROWS["functions"])]
ROWS["function_name_assertions"] = [(f"an{r[0]}", r[0], r[4], r[5], r[6]) for r in ROWS["function_names"]]


def padded(name, rows):
    """Rows of a table, columns that they lack being null."""
    width = len(catalog.schema(name))
    return [(*r, *[None] * (width - len(r))) for r in rows]


#: The checks of the core; the families have tests of their own.
CORE = list(validation.CHECKS)[:24]


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    tables = {n: spark.createDataFrame(padded(n, r), catalog.schema(n)) for n, r in ROWS.items()}
    return catalog.publish(spark, tables, str(tmp_path_factory.mktemp("g") / "graph"))


def test_published_graph_is_valid(graph):
    assert graph.drift() == []
    assert {r["check"]: r["violations"] for r in validation.violations(graph).collect()} == dict.fromkeys(validation.CHECKS, 0)


def test_publish_does_not_replace(spark, graph):
    with pytest.raises(ValueError):
        catalog.publish(spark, {}, graph.folder)


@pytest.mark.parametrize(
    "table,rows,broken",
    [
        ("function_assertions", [], {"functions_without_assertions": 4, "function_projection_without_matching_assertion": 4}),
        ("fold_group_members", ROWS["fold_group_members"][:1], {"fold_groups_with_fewer_than_two_members": 1}),
        ("function_signature_arguments", [("f1", 0, 116, 1, "...")], {"signature_argument_count_mismatch": 1, "variadic_signature_marker_mismatch": 1}),
        ("match_hypothesis_alternatives", [("a1", "s1", "c1", "fold")], {"hypothesis_sets_without_alternatives": 1, "alternatives_not_exactly_one": 1}),
        ("claim_evidence", [], {}),
        ("address_groups", [*ROWS["address_groups"], ("g9", "x", "xbox-va", 0x82001000, "code")], {"addresses_not_unique": 1}),
    ],
)
def test_tampering_breaks_just_those_checks(spark, graph, table, rows, broken):
    class Tampered:
        def __getattr__(self, name):
            return spark.createDataFrame(padded(name, rows), catalog.schema(name)) if name == table else getattr(graph, name)

    got = {r["check"]: r["violations"] for r in validation.violations(Tampered(), CORE).collect() if r["violations"]}
    assert got == broken


def test_address_lookup_keeps_all_functions(graph):
    out = documents.at_address(graph, 0x82001000, "xbox-va").orderBy("function_id").collect()
    assert [r["function_id"] for r in out] == ["f1", "f2"] and out[0]["total"] == 2
    assert [n["name"] for n in out[0]["names"]] == ["Primary", "Actor::Update"]
    assert out[0]["fold_groups"][0]["fold_group_id"] == "fold" and out[0]["rendered_signature"] == "void (int)"


def test_name_lookup_pages(graph):
    first = documents.by_name(graph, "actor", "contains", limit=1).collect()
    assert [r["function_id"] for r in first] == ["f1"] and first[0]["has_more"]
    assert documents.by_name(graph, "actor").count() == 0


def test_reverse_hypotheses_keep_folds_whole(spark, graph):
    ids = documents.reverse_hypotheses(graph, graph.functions.where("function_id IN ('f1', 'f3')"))
    out = {r["hypothesis_set_id"]: r for r in documents.hypothesis_records(graph, ids).collect()}
    assert set(out) == {"s1", "s2"}
    assert len(out["s2"]["alternatives"]) == 1 and out["s2"]["alternatives"][0]["xbox_fold_group_id"] == "fold"
    assert [e["scope"] for e in out["s1"]["evidence"]] == ["claim", "set"]


def test_views(spark, graph):
    graph.register()
    assert spark.sql("SELECT count(*) FROM functions JOIN address_groups USING (address_group_id)").first()[0] == 4
