"""Versions, loads of many tables, and decisions: all or nothing, replays, and two writers."""

import datetime
import shutil
import threading

import pytest

from cairn.operators import decisions, load, review
from cairn.operators.load import Refused
from cairn.plans import validation
from cairn.sources import catalog
from cairn.sources.store import CommitConflict, Version, commit, compacted
from tests.test_catalog import ROWS, padded

def table(spark, name, rows):
    return spark.createDataFrame(padded(name, rows), catalog.schema(name))


def graph(spark, skip=("review_decisions",), **more):
    rows = {**ROWS, "provenance": [("v", "test", "p", None, None, None, "{}")], "reviewers": [("alice", "Alice", "person"), ("bob", "Bob", "person")], "review_releases": [("r1", "One", None, "v"), ("r2", "Two", None, "v")], **more}
    return {n: table(spark, n, r) for n, r in rows.items() if n not in skip}


@pytest.fixture
def empty(spark, tmp_path):
    return Version(spark, str(tmp_path / "store"))


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    return load.load(Version(spark, str(tmp_path_factory.mktemp("s") / "store")), graph(spark))


def test_load_replay_and_lineage(spark, base):
    assert base.sequence == 1 and base.drift() == [] and base.functions.count() == 4
    assert load.load(base, graph(spark)).sequence == 1  # an exact replay makes no version
    second = load.load(base, {"provenance": table(spark, "provenance", [("w", "test", "other", None, None, None, "{}")]), "functions": table(spark, "functions", ROWS["functions"]), "function_assertions": table(spark, "function_assertions", [("second", "f1", "x", "function", 1, None, None, "w")])})
    assert second.sequence == 2 and second.functions.count() == 4 and second.function_assertions.count() == base.function_assertions.count() + 1
    assert base.function_assertions.count() == 4 and Version(spark, base.target, 1).function_assertions.count() == 4  # readers keep theirs
    assert len(second.parts["functions"]) == 1 and len(second.parts["function_assertions"]) == 2
    whole = compacted(second)
    assert len(whole.parts["function_assertions"]) == 1 and whole.function_assertions.count() == 5
    assert {r["check"]: r["violations"] for r in validation.violations(whole, ["functions_without_assertions"]).collect()} == {"functions_without_assertions": 0}


def test_mutable_values_are_replaced_and_identities_are_not(spark, store):
    v = store
    new = load.load(v, {"programs": table(spark, "programs", [("pc", "pc", "renamed", "x86", None, "{}")])})
    assert {(r["program_id"], r["name"]) for r in new.programs.collect()} == {("pc", "renamed"), ("x", "debug")}
    with pytest.raises(Refused, match="programs identity_conflict pc"):
        load.load(new, {"programs": table(spark, "programs", [("pc", "xbox360", "renamed", None, None, "{}")])})


@pytest.mark.parametrize(
    "name,rows,said",
    [
        ("call_edges", [("e", "x", "f1", "f2", None, "call", "v"), ("e", "x", "f1", None, None, "call", "v")], "call_edges conflicting_rows e"),
        ("call_edges", [("e", "x", "f1", "nowhere", None, "call", "v")], "call_edges dangling_callee_function_id nowhere"),
        ("function_assertions", [("as0", "f1", "x", "function", None, None, None, "v")], "function_assertions identity_conflict as0"),  # null where it was 1
        ("fold_group_members", [("fold", "x", None, "member")], "fold_group_members null_key fold/null"),
    ],
)
def test_one_bad_row_refuses_all(spark, base, name, rows, said):
    before = Version(spark, base.target)
    good = table(spark, "address_groups", [("g77", "x", "xbox-va", 7777, "code")])
    with pytest.raises(Refused, match=said):
        load.load(before, {"address_groups": good, name: table(spark, name, rows)})
    after = Version(spark, base.target)
    assert after.sequence == before.sequence and after.address_groups.where("address_group_id = 'g77'").isEmpty()


def test_unknown_columns_are_refused(spark, base):
    with pytest.raises(Refused, match="programs.extra"):
        load.load(base, {"programs": spark.createDataFrame([("a", 1)], "program_id string, extra int")})


def test_commit_of_an_old_version_is_refused(spark, empty):
    first = commit(empty, {"programs": table(spark, "programs", [("a", "pc", "a", None, None, "{}")])})
    with pytest.raises(CommitConflict):
        commit(empty, {"programs": table(spark, "programs", [("b", "pc", "b", None, None, "{}")])})
    assert [r["program_id"] for r in Version(spark, empty.target).programs.collect()] == ["a"] and first.sequence == 1


# --- decisions


def said(spark, **values):
    row = {"reviewer_id": "alice", "action": "reject", "decided_at": "2026-08-17T17:00:00Z", "rationale": "why", "provenance_id": "v", "review_release_id": "r1", "claim_id": None, "hypothesis_set_id": None, "alternative_id": None, "previous_decision_id": None} | values
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row))


def last(version, reviewer="alice"):
    return decisions.state_of(version, "claim", "c1").where(f"reviewer_id = '{reviewer}'").first()["decision_id"]


@pytest.fixture
def store(spark, base, tmp_path):
    """The first version in a folder of its own."""
    shutil.copytree(base.target, tmp_path / "copy")
    for p in (tmp_path / "copy" / "_log").glob("*.json"):
        if not p.name.endswith("01.json"):
            p.unlink()
    return Version(spark, str(tmp_path / "copy"))


def test_chains_are_append_only_and_replays_add_nothing(spark, store):
    v = decisions.record(store, said(spark, claim_id="c1"))
    rejected = last(v)
    v = decisions.record(v, said(spark, claim_id="c1", action="reopen", previous_decision_id=rejected))  # equal times are valid
    reopened = last(v)
    v = decisions.record(v, said(spark, claim_id="c1", action="supersede", decided_at="2026-08-17T18:00:00Z", previous_decision_id=reopened, review_release_id="r2"))
    v = decisions.record(v, said(spark, claim_id="c1", reviewer_id="bob", action="accept", decided_at="2026-08-17T20:30:00+02:00", review_release_id="r2"))
    again = decisions.record(v, said(spark, claim_id="c1", action="supersede", decided_at="2026-08-17T18:00:00.000Z", previous_decision_id=reopened, review_release_id="r2"))
    assert again.sequence == v.sequence and v.review_decisions.count() == 4
    depth = {r["decision_id"]: r["depth"] for r in review.history(v.review_decisions).collect()}
    assert depth[rejected] == 0 and depth[reopened] == 1 and sorted(depth.values()) == [0, 0, 1, 2]
    assert {r["derived_status"] for r in decisions.state_of(v, "claim", "c1").collect()} == {"accepted", "superseded"}


def test_guards(spark, store):
    v = decisions.record(store, said(spark, claim_id="c1", action="defer", decided_at="2026-08-17T19:00:00Z"))
    v = decisions.record(v, said(spark, claim_id="c1", action="accept", decided_at="2026-08-17T19:00:00Z", previous_decision_id=last(v), review_release_id="r2"))
    leaf = last(v)
    first = v.review_decisions.where("previous_decision_id IS NULL").first()["decision_id"]
    bad = {
        "predates_previous": {"decided_at": "2026-08-17T18:59:59Z", "previous_decision_id": leaf},
        "different_reviewer_or_target": {"reviewer_id": "bob", "decided_at": "2026-08-17T20:00:00Z", "previous_decision_id": leaf},
        "reopen_without_previous": {"reviewer_id": "bob", "action": "reopen"},
        "timestamp_without_zone": {"reviewer_id": "bob", "decided_at": "2026-08-17T20:00:00"},
        "second_root": {"decided_at": "2026-08-17T21:00:00Z"},
        "previous_has_successor": {"decided_at": "2026-08-17T21:00:00Z", "previous_decision_id": first},
        "unknown_previous": {"previous_decision_id": "nothing"},
        "unknown_reviewer": {"reviewer_id": "carol"},
        "unknown_review_release": {"reviewer_id": "bob", "review_release_id": "r9"},
        "unknown_target": {"reviewer_id": "bob", "claim_id": "c9"},
        "not_exactly_one_target": {"reviewer_id": "bob", "hypothesis_set_id": "s1"},
        "empty_rationale": {"reviewer_id": "bob", "rationale": "  "},
        "unsupported_action": {"reviewer_id": "bob", "action": "like"},
    }
    for problem, values in bad.items():
        with pytest.raises(Refused, match=problem):
            decisions.record(v, said(spark, **({"claim_id": "c1"} | values)))
    with pytest.raises(Refused, match="different_reviewer_or_target"):
        decisions.record(v, said(spark, hypothesis_set_id="s1", decided_at="2026-08-17T20:00:00Z", previous_decision_id=leaf))
    assert Version(spark, v.target).sequence == v.sequence


def test_two_writers_of_one_leaf(spark, store):
    v = decisions.record(store, said(spark, claim_id="c1"))
    leaf, outcomes = last(v), []

    def write(rationale):
        try:
            decisions.record(v, said(spark, claim_id="c1", action="accept", decided_at="2026-08-18T00:00:00Z", previous_decision_id=leaf, rationale=rationale), retries=3)
            outcomes.append("written")
        except Refused as e:
            outcomes.append(str(e).split()[0])

    threads = [threading.Thread(target=write, args=(f"writer {k}",)) for k in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(outcomes) == ["previous_has_successor", "written"]
    assert Version(spark, v.target).review_decisions.count() == 2
    with pytest.raises(CommitConflict):  # without retries the loser only learns that it was late
        decisions.record(v, said(spark, claim_id="c1", action="defer", decided_at="2026-08-19T00:00:00Z", previous_decision_id=leaf))


def test_history_of_cycles_and_orphans(spark):
    when = datetime.datetime(2024, 1, 1)
    rows = lambda *pairs: spark.createDataFrame([(a, b, when) for a, b in pairs], "decision_id string, previous_decision_id string, decided_at timestamp")
    with pytest.raises(ValueError, match="cycle"):
        review.history(rows(("a", "b"), ("b", "c"), ("c", "a"), ("d", None)))
    got = {r["decision_id"]: (r["root_decision_id"], r["depth"]) for r in review.history(rows(("d", None), ("e", "gone"), ("f", "e"))).collect()}
    assert got == {"d": ("d", 0), "e": ("gone", 1), "f": ("gone", 2)}
