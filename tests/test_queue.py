"""The review queue: digest, pages, cursors, and what an item shows."""

import datetime

import pytest
from pyspark.sql import functions as F

from cairn.operators import review
from cairn.operators.digest import tree_digest
from cairn.plans import queue
from cairn.sources import catalog
from tests.test_catalog import padded

WHEN = datetime.datetime(2026, 8, 17)
ROWS = {
    "programs": [("pc", "pc", "game", None, None, "{}"), ("x", "xbox360", "debug", None, None, "{}")],
    "provenance": [("v", "test", "maker", "1", None, "m", "{}")],
    "address_groups": [("g1", "x", "xbox-va", 0x82001000, "code"), ("p1", "pc", "ram", 0x401000, "code")],
    "functions": [("pf", "pc", "p1", "d", "function", None, None, None), *[(f"f{k:02d}", "x", "g1", str(k), "function", None, None, None) for k in range(12)]],
    "function_names": [(1, "f00", "Actor::Update", "decorated", 1, "v", "{}")],
    "unresolved_targets": [("t", "x", "g1", "entry", None, "no procedure", "open", None)],
    "fold_groups": [("fold", "x", "icf", "v"), ("hollow", "x", "icf", "v")],
    "fold_group_members": [("fold", "x", f"f{k:02d}", "member") for k in range(11)],
    "match_claims": [("c1", "pf", None, "f00", None, "candidate", None, "v"), ("c2", "pf", None, "f01", None, "candidate", None, "v"), ("c3", "pf", None, None, "t", "candidate", None, "v")],
    "match_hypothesis_sets": [(s, "pf", None, "candidate", "v") for s in ("ambiguous", "contradicted", "exact", "fold", "incomplete", "unresolved")],
    "match_hypothesis_alternatives": [("a1", "exact", "c1", None), ("a2", "ambiguous", "c1", None), ("a3", "ambiguous", "c2", None), ("a4", "fold", None, "fold"), ("a5", "incomplete", None, "hollow"), ("a6", "unresolved", "c3", None), ("a7", "contradicted", "c2", None)],
    "match_hypothesis_evidence": [("e1", "ambiguous", "supports", "k", "flow", "v"), ("e2", "fold", "supports", "k", "flow", "v"), ("e3", "unresolved", "supports", "k", "flow", "v"), ("e4", "contradicted", "contradicts", "k", "manual", "v"), ("e5", "incomplete", "context", "k", "flow", "v")],
    "match_hypothesis_alternative_evidence": [("e6", "a1", "supports", "k", "names", "v"), ("e7", "a7", "supports", "k", "flow", "v")],
    "claim_evidence": [("e8", "c1", "supports", "k", "flow", "v")],
    "reviewers": [("alice", "Alice", "person"), ("bob", "Bob", "person")],
    "review_releases": [("r1", "One", "m", "v"), ("r2", "Two", "m", "v")],
    "review_decisions": [("d1", None, "a1", None, "alice", "defer", WHEN, "why", "v", "r1", None), ("d2", None, "a1", None, "alice", "accept", WHEN, "why", "v", "r1", "d1"), ("d3", None, "a1", None, "bob", "reject", WHEN, "why", "v", "r1", None), ("d4", "ambiguous", None, None, "alice", "accept", WHEN, "why", "v", "r2", None)],
}


class Graph:
    """Tables in memory, of which some can be replaced."""

    def __init__(self, spark, **changed):
        self.spark, self.rows = spark, ROWS | changed

    def __getattr__(self, name):
        return self.spark.createDataFrame(padded(name, self.rows.get(name, [])), catalog.schema(name))


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    return catalog.publish(spark, {n: spark.createDataFrame(padded(n, r), catalog.schema(n)) for n, r in ROWS.items()}, str(tmp_path_factory.mktemp("q") / "graph"))


def test_digest_is_of_the_rows_alone(spark):
    df = spark.range(5000).select((F.col("id") % 6).alias("rank"), F.when(F.col("id") != 7, F.col("id").cast("string")).alias("key"))
    one = tree_digest(df, ["rank", "key"]).first()
    assert one["row_count"] == 5000
    assert all(tree_digest(df.repartition(n).orderBy(F.rand(n)), ["rank", "key"]).first() == one for n in (1, 7))
    for other in (df.where("key <> '4999'"), df.unionByName(df.limit(1)), df.withColumn("key", F.coalesce("key", F.lit(""))), df.withColumn("rank", F.when(F.col("key") == "12", 5).otherwise(F.col("rank")))):
        assert tree_digest(other, ["rank", "key"]).first()["digest"] != one["digest"]
    assert tree_digest(df.limit(0), ["rank", "key"]).first()["row_count"] == 0


def test_buckets_evidence_folds_and_reviews(graph):
    document, _ = queue.page(graph, "alice", "r1", fold_sample_limit=3)
    assert [i["triage_bucket"] for i in document["items"]] == list(review.BUCKETS) and document["total_count"] == 6
    assert document["counts"]["by_triage_bucket"] == dict.fromkeys(review.BUCKETS, 1) and document["next_cursor"] is None
    by = {i["triage_bucket"]: i for i in document["items"]}
    assert {g["independence_group"] for g in by["contradicted"]["independence_groups"]} == {"flow", "manual"} and "contradicts" in [e["effect"] for e in by["contradicted"]["evidence"]]
    assert len(by["ambiguous"]["alternatives"]) == 2 and by["ambiguous"]["triage_flags"]["has_multiple_alternatives"]
    assert by["unresolved"]["alternatives"][0]["claim"]["xbox_endpoint"]["endpoint_kind"] == "unresolved_target"
    fold = by["fold"]["alternatives"][0]["fold_bundle"]
    assert (fold["member_count"], len(fold["member_sample"]), fold["member_sample_truncated"]) == (11, 3, True)
    assert by["fold"]["alternatives"][0]["alternative_kind"] == "fold_bundle" and by["incomplete"]["alternatives"][0]["fold_bundle"]["member_count"] == 0
    exact = by["exact"]
    assert exact["independence_groups"] == [{"independence_group": "flow", "evidence_count": 1, "evidence_references": ["claim:e8"], "literal_effects": ["supports"]}, {"independence_group": "names", "evidence_count": 1, "evidence_references": ["alternative:e6"], "literal_effects": ["supports"]}]
    assert exact["alternatives"][0]["claim"]["evidence"][0]["scope"] == "claim" and exact["alternatives"][0]["claim"]["xbox_endpoint"]["names"][0]["name"] == "Actor::Update"
    said = exact["alternatives"][0]["review"]
    assert said["selected_reviewer"]["state"] == "accepted" and said["selected_reviewer"]["current_leaf"]["decision_id"] == "d2"
    assert said["literal_leaf_summary"] == {"reviewer_count": 2, "distinct_actions": ["accept", "reject"], "has_action_disagreement": True, "consensus_inferred": False}
    stale = by["ambiguous"]["review"]["selected_reviewer"]
    assert (stale["state"], stale["basis"], stale["current_leaf"]["review_release_id"]) == ("open", "current_leaf_from_another_release", "r2")
    assert by["fold"]["review"]["selected_reviewer"]["basis"] == "no_current_decision"


def test_pages_are_stable_and_cursors_are_bound(spark, graph):
    first, digest = queue.page(graph, "alice", "r1", limit=4, fold_sample_limit=2)
    assert queue.page(graph, "alice", "r1", limit=4, fold_sample_limit=2)[1] == digest
    second, _ = queue.page(graph, "alice", "r1", limit=4, after=first["next_cursor"], fold_sample_limit=2)
    whole, _ = queue.page(graph, "alice", "r1", limit=6, fold_sample_limit=2)
    assert first["items"] + second["items"] == whole["items"] and second["next_cursor"] is None
    for other in (("bob", "r1", 2), ("alice", "r2", 2), ("alice", "r1", 3)):
        with pytest.raises(ValueError, match="changed"):
            queue.page(graph, other[0], other[1], limit=1, after=first["next_cursor"], fold_sample_limit=other[2])
    changed = Graph(spark, match_hypothesis_evidence=ROWS["match_hypothesis_evidence"][:-2])
    with pytest.raises(ValueError, match="changed|absent"):
        queue.page(changed, "alice", "r1", limit=4, after=first["next_cursor"], fold_sample_limit=2)
    gone = review.encoded_cursor({"queue_order_sha256": first["queue_order_sha256"], "queue_key": [0, "nothing"]})
    with pytest.raises(ValueError, match="absent"):
        queue.page(graph, "alice", "r1", after=gone)
    for bad in ({"queue_key": [9, "x"], "queue_order_sha256": "x"}, {"queue_key": ["x"], "queue_order_sha256": "x"}, {}):
        with pytest.raises(ValueError, match="invalid"):
            queue.page(graph, "alice", "r1", after=review.encoded_cursor(bad))
    with pytest.raises(ValueError):
        queue.page(graph, "alice", "r1", limit=1001)
