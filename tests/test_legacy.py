"""Older name maps: every format, conflicts, contexts, depth zero, verdicts, and names that lead nowhere."""

import hashlib
import json

import pytest

from cairn.operators import legacy

FILES = {
    "names_final": {"0x401000": "Actor::Process", "0x28": "DebugBreak"},
    "names_tiered": {"0x401000": {"name": "Actor::Process", "tier": "corroborated", "channels": ["vtable", "source"], "agent": "confirm", "votes": 3}, "0x28": {"name": "DebugBreak", "tier": "", "channels": ["odd"]}},
    "namemap": {"0x401000": {"vtable": "Actor::Process", "vtable_recon": "Actor::Update", "public": "SomePatch::Install", "source": "Actor.cpp", "_notes": {"modules": 2}}},
    "strmatch": {"0x401000": {"name": "Actor::Process", "score": 2}},
    "matched_ghidra": {"0x402000": {"name": "Seed", "depth": 0}, "0x403000": {"name": "Deep", "depth": 2}},
    "all_seeds": {"0x402000": {"name": "Seed"}},
    "fingerprint": {"0x403000": {"name": "Deep", "score": 1.5}},
    "pgm2": {"0x403000": {"name": "Twice"}},
    "agent_verdicts": [{"address": "0x403000", "claim": "Deep", "verdict": "REJECT"}, {"address": "0x403000", "claim": "Deep", "verdict": "unsure"}],
}


@pytest.fixture(scope="module")
def entries(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("legacy")
    for name, value in FILES.items():
        (root / f"{name}.json").write_text(json.dumps(value))
    return legacy.read(spark, {n: str(root / f"{n}.json") for n in FILES})


def test_statements(entries):
    rows = legacy.observations(entries).collect()
    got = sorted((r["pc_address"], r["name"], r["channel"], r["kind"], r["effect"], r["independence_group"]) for r in rows)
    a, d = (0x401000, "Actor::Process"), (0x403000, "Deep")
    assert got == sorted(
        [
            (*a, "legacy_master", "selected_claim_record", "context", "legacy_accumulator"),
            (0x28, "DebugBreak", "legacy_master", "selected_claim_record", "context", "legacy_accumulator"),
            (*a, "legacy_tier", "legacy_classification", "context", "legacy_accumulator"),
            (0x28, "DebugBreak", "legacy_tier", "legacy_classification", "context", "legacy_accumulator"),
            (*a, "vtable", "identity_support", "supports", "class_slot_alignment"),
            (*a, "source", "context", "context", "source_file_context"),
            (0x28, "DebugBreak", "odd", "identity_support", "supports", "legacy_channel:odd"),
            (*a, "agent", "agent_verdict_summary", "supports", "decompiler_agent_review"),
            (*a, "vtable", "identity_support", "supports", "class_slot_alignment"),
            (0x401000, "Actor::Update", "vtable_recon", "identity_support", "supports", "class_slot_alignment"),
            (*a, "strmatch", "raw_candidate_observation", "supports", "string_reference"),
            (0x402000, "Seed", "seed", "raw_graph_seed_input", "context", "legacy_seed_unknown"),
            (*d, "graph", "raw_graph_propagation", "supports", "call_graph"),
            (0x402000, "Seed", "seed", "raw_candidate_observation", "context", "legacy_seed_unknown"),
            (*d, "fingerprint", "raw_candidate_observation", "context", "legacy_composite_structural"),
            (0x403000, "Twice", "pgm", "raw_candidate_observation", "supports", "call_graph"),
            (*d, "agent", "raw_agent_verdict", "contradicts", "decompiler_agent_review"),
            (*d, "agent", "raw_agent_verdict", "context", "decompiler_agent_review"),
        ]
    )
    details = {(r["artifact"], r["name"], r["channel"], r["kind"]): r["details"] for r in rows}
    assert details["namemap.json", "Actor::Process", "vtable", "identity_support"] == {"agrees_with_legacy_master": "true"}
    assert details["namemap.json", "Actor::Update", "vtable_recon", "identity_support"] == {"agrees_with_legacy_master": "false"}
    assert details["fingerprint.json", "Deep", "fingerprint", "raw_candidate_observation"]["experimental_artifact"] == "true"
    assert details["names_tiered.json", "Actor::Process", "vtable", "identity_support"] == {"votes": "3", "agent": "confirm"}
    assert {(r["channel"], r["value"]) for r in legacy.contexts(entries).collect()} == {("public", "SomePatch::Install"), ("source", "Actor.cpp")}


def test_claims_and_resolution(spark, entries):
    rows = legacy.observations(entries)
    claims = legacy.claims(rows, spark.createDataFrame([("pf", 0x401000)], "function_id string, address long"))
    got = {r["proposed_name"]: r for r in claims.collect()}
    assert set(got) == {"Actor::Process", "Actor::Update", "DebugBreak", "Seed", "Deep", "Twice"}
    assert (got["Actor::Process"]["resolution"], got["Actor::Process"]["legacy_tier"]) == ("function_entry", "corroborated")
    assert (got["DebugBreak"]["resolution"], got["DebugBreak"]["legacy_tier"]) == ("unresolved_address", None)
    assert got["DebugBreak"]["claim_id"] == f"legacy:pc:ram:00000028:{hashlib.sha256(b'DebugBreak').hexdigest()[:16]}"
    ordered = legacy.evidence(rows).where(f"claim_id = '{got['Deep']['claim_id']}'").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in ordered] == [0, 1, 2, 3] and [r["artifact"] for r in ordered] == sorted(r["artifact"] for r in ordered)
    procedures = spark.createDataFrame([("x1", "Actor::Process"), ("x2", "Deep"), ("x3", "Deep"), ("x3", "Deep")], "function_id string, name string")
    more = claims.unionByName(claims.where("proposed_name = 'Seed'").selectExpr("'other' AS claim_id", "1L AS pc_address", "pc_function_id", "proposed_name", "resolution", "legacy_tier", "evidence_count"))
    alternatives, targets = legacy.resolved(more, procedures, "x")
    per = {}
    for r in alternatives.collect():
        per.setdefault(r["claim_id"], []).append((r["xbox_function_id"], r["candidate_count"], r["xbox_target_id"]))
    assert [x[:2] for x in per[got["Actor::Process"]["claim_id"]]] == [("x1", 1)] and sorted(x[:2] for x in per[got["Deep"]["claim_id"]]) == [("x2", 2), ("x3", 2)]
    assert per["other"] == per[got["Seed"]["claim_id"]] and per["other"][0][2] is not None  # one target a name
    assert {r["name_hint"] for r in targets.collect()} == {"Actor::Update", "DebugBreak", "Seed", "Twice"} and targets.count() == 4
    assert tuple(legacy.summary(alternatives, targets).first()) == (1, 1, 5, 8, 4)


@pytest.mark.parametrize("name,value,message", [("strmatch", {"0x1": {"score": 1}}, "empty legacy name"), ("names_final", {"here": "X"}, "not an address"), ("names_final", ["X"], "expected a JSON object"), ("agent_verdicts", {"a": 1}, "expected a JSON array")])
def test_malformed(spark, tmp_path, name, value, message):
    (tmp_path / "f.json").write_text(json.dumps(value))
    with pytest.raises(Exception, match=message):
        legacy.observations(legacy.read(spark, {name: str(tmp_path / "f.json")})).collect()
