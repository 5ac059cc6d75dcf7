"""Nested lookups over the small catalog of the check families."""

import datetime

import pytest

from cairn.operators import matching, persist
from cairn.plans import documents, exports, matcher_inputs

from .test_families import BASE, Small

MORE = {
    "classes": [{"class_id": "c", "program_id": "x", "identity_key": "k"}, {"class_id": "d", "program_id": "p", "identity_key": "k"}],
    "class_names": [{"name_id": 1, "class_id": "c", "name": "Actor", "name_kind": "rtti", "is_primary": 0}, {"name_id": 2, "class_id": "c", "name": "Hero", "name_kind": "display", "is_primary": 1}, {"name_id": 3, "class_id": "d", "name": "Actor", "name_kind": "rtti", "is_primary": 1}],
    "vtables": [{"vtable_id": "v1", "class_id": "c", "vfptr_role": "secondary", "subobject_offset": 8, "address": 5}, {"vtable_id": "v2", "class_id": "c", "vfptr_role": "primary", "address": 6}, {"vtable_id": "v3", "class_id": "c", "vfptr_role": "unknown", "address": 7}],
    "vtable_alignment_candidates": [{"alignment_id": "al", "pc_vtable_id": "p9", "xbox_vtable_id": "v2", "status": "candidate"}],
    "source_files": [{"source_file_id": "s", "normalized_path": "a.cpp"}],
    "unresolved_targets": [{"target_id": "t1", "program_id": "x", "address_group_id": "g3", "status": "open"}, {"target_id": "t2", "program_id": "x", "status": "open"}],
    "reviewers": [{"reviewer_id": "r", "display_name": "R"}, {"reviewer_id": "q", "display_name": "Q"}],
    "review_releases": [{"review_release_id": "rel", "name": "one"}],
    "review_decisions": [{"decision_id": d, "hypothesis_set_id": "h", "reviewer_id": r, "action": a, "decided_at": datetime.datetime(2024, 1, 1), "review_release_id": rel, "previous_decision_id": p} for d, r, a, rel, p in (("d1", "r", "defer", "rel", None), ("d2", "r", "accept", "rel", "d1"), ("d3", "q", "reject", None, None))],
}


@pytest.fixture(scope="module")
def small(spark):
    return Small(spark, MORE)


def ids(spark, key, *values):
    return spark.createDataFrame([(v,) for v in values], f"{key} string")


def test_slots_keep_all_functions_and_cap_the_list(spark, small):
    slots = documents.slots_to(small, ids(spark, "address_group_id", "g2"))
    one = documents.slot_records(small, slots, most=1).first()
    assert (one["vtable_id"], one["slot_index"], one["total"], [f["function_id"] for f in one["functions"]], one["target_address"]) == ("v2", 1, 2, ["f2"], 200)
    both = documents.slot_records(small, slots).first()
    assert [f["function_id"] for f in both["functions"]] == ["f2", "f3"]


def test_classes(spark, small):
    out = documents.classes_named(small, "Actor", platform="xbox360").collect()
    assert [r["class_id"] for r in out] == ["c"] and [n["name"] for n in out[0]["names"]] == ["Hero", "Actor"]
    assert [(t["vtable_id"], t["slot_count"], t["partners"]) for t in out[0]["tables"]] == [("v2", 2, ["p9"]), ("v1", 1, None), ("v3", 0, None)]
    assert documents.classes_named(small, "act", "contains").count() == 2


def test_flow(spark, small):
    site = documents.site_records(small, ids(spark, "site_id", "s0", "s1", "s2")).orderBy("site_id").collect()
    assert [(r["site_id"], r["total"], r["assertions"][0]["endpoint"]["kind"], r["assertions"][0]["endpoint"]["id"]) for r in site] == [("s0", 1, "function", "f1"), ("s1", 1, "fold_group", "fo"), ("s2", 1, "address_only", "g3")]
    flow = documents.flow_of(small, ids(spark, "function_id", "f1")).orderBy("use_id").collect()
    assert [(r["use_id"], r["role"], r["target_kind"]) for r in flow] == [("u0", "direct_call", "unique_procedure"), ("u1", "direct_call", "fold_group"), ("u2", "direct_call", "executable_non_entry")]


def test_types_and_data(spark, small):
    tag = documents.tag_records(small, ids(spark, "tag_layout_id", "l")).first()
    assert [(m["ordinal"], m["field_member_id"], m["overload_count"]) for m in tag["members"]] == [(0, "m", 1)] and tag["diagnostics"][0]["diagnostic_id"] == "d"
    record = documents.type_records(small, ids(spark, "type_record_id", "r1")).first()
    assert record["raw_body"] == "010203" and record["assertions"][0]["extraction_id"] == "t"
    data = documents.data_records(small, ids(spark, "data_record_id", "d1", "d2")).orderBy("data_record_id").collect()
    assert [r["assertions"][0]["address"] for r in data] == [100, None]


def test_targets_sources_and_reviews(spark, small):
    out = documents.target_records(small, ids(spark, "target_id", "t1", "t2")).orderBy("target_id").collect()
    assert [(r["platform"], r["address"]) for r in out] == [("xbox360", 300), ("xbox360", None)]
    assert documents.source_records(small, ids(spark, "function_id", "f1")).first()["sources"][0]["normalized_path"] == "a.cpp"
    out = documents.review_records(small, ids(spark, "hypothesis_set_id", "h"), "hypothesis_set_id").orderBy("decision_id").collect()
    assert [(r["decision_id"], r["display_name"], r["action"], r["release_name"]) for r in out] == [("d2", "R", "accept", "one"), ("d3", "Q", "reject", None)]
    assert BASE["programs"]


def test_matcher_inputs(spark):
    changed = {
        "provenance": [{"provenance_id": "v", "producer": "other"}, {"provenance_id": "m", "producer": "matcher"}],
        "unresolved_targets": [{"target_id": "t", "program_id": "x", "address_group_id": "g3"}],
        "match_hypothesis_sets": [{"hypothesis_set_id": "h", "pc_function_id": "pf", "status": "candidate", "provenance_id": "v"}, {"hypothesis_set_id": "own", "pc_function_id": "pf", "status": "candidate", "provenance_id": "m"}, {"hypothesis_set_id": "no", "pc_target_id": "t", "status": "rejected", "provenance_id": "v"}],
        "match_claims": [{"claim_id": "c1", "pc_function_id": "pf", "xbox_function_id": "f1", "status": "candidate"}, {"claim_id": "c2", "pc_function_id": "zz", "xbox_target_id": "t", "status": "candidate"}, {"claim_id": "c3", "pc_target_id": "t", "xbox_function_id": "f1", "status": "accepted"}],
        "match_hypothesis_alternatives": [{"alternative_id": a, "hypothesis_set_id": h, "claim_id": c, "xbox_fold_group_id": f} for a, h, c, f in (("a1", "h", "c1", None), ("a2", "h", "c2", None), ("a3", "h", None, "fo"), ("a4", "own", "c1", None), ("a5", "no", "c3", None), ("a6", "h", None, None))],
        "call_edges": [{"edge_id": "e1", "program_id": "p", "caller_function_id": "pf", "callee_function_id": "pg"}, {"edge_id": "e2", "program_id": "p", "caller_function_id": "pf", "unresolved_target_id": "t"}, {"edge_id": "e3", "program_id": "x", "caller_function_id": "f1", "callee_function_id": "f2"}],
    }
    c = Small(spark, changed)
    out = {r["alternative_id"]: r for r in matcher_inputs.mapping_alternatives(c, "matcher").collect()}
    assert {k: r["status"] for k, r in out.items()} == {"a1": "candidate", "a2": "candidate", "a3": "candidate", "a4": "derived_non_seed", "a5": "hypothesis:rejected|claim:accepted", "a6": "candidate"}
    assert {k: r["problem"] for k, r in out.items() if r["problem"]} == {"a2": "different_pc_endpoints", "a6": "no_xbox_endpoint"}
    assert (out["a3"]["xbox"]["endpoint_kind"], out["a3"]["xbox"]["identity"]) == ("fold_group", "fo") and tuple(out["a5"]["pc"]) == ("unresolved_target", "t", "g3")
    calls = {r["edge_id"]: tuple(r["callee"]) for r in matcher_inputs.pc_calls(c).collect()}
    assert calls == {"e1": ("function", "pg", None), "e2": ("unresolved_target", "t", "g3")}
    flows = {r["use_id"]: (r["role"], tuple(r["target"]), r["site_address"]) for r in matcher_inputs.xbox_flows(c).collect()}
    assert flows == {"u0": ("direct_call", ("function", "f1", None), 100), "u1": ("direct_call", ("fold_group", "fo", None), 100), "u2": ("direct_call", ("address_only", "g3", "g3"), 100)}
    assert sorted(tuple(r) for r in matcher_inputs.fold_members(c).collect()) == [("fo", "f2"), ("fo", "f3")]
    # the relation rule takes them as they are
    flat = lambda df, key, end: df.select(key, f"{end}.*")
    kinds = matching.relation_kinds(flat(matcher_inputs.mapping_alternatives(c, "matcher").withColumnRenamed("alternative_id", "bundle_id"), "bundle_id", "xbox"), flat(matcher_inputs.xbox_flows(c).withColumnRenamed("use_id", "flow_id"), "flow_id", "target"), matcher_inputs.fold_members(c))
    assert sorted(tuple(r) for r in kinds.collect()) == [("a1", "u0", "exact"), ("a2", "u2", "exact"), ("a3", "u1", "exact"), ("a4", "u0", "exact"), ("a5", "u0", "exact")]


def test_export_plan_of_a_catalog(spark):
    day = datetime.datetime(2024, 1, 1)
    decide = lambda d, action="accept", previous=None, **target: {"decision_id": d, "reviewer_id": "r", "action": action, "decided_at": day, "review_release_id": "rel", "previous_decision_id": previous, **target}
    changed = {
        "review_releases": [{"review_release_id": "rel", "name": "one", "manifest_id": "man"}],
        "provenance": [{"provenance_id": "v", "producer": "o", "manifest_id": "man"}, {"provenance_id": "w", "producer": "o", "manifest_id": "other"}],
        "address_groups": [{"address_group_id": "gp", "program_id": "p", "address_space": "ram", "address": 64}, {"address_group_id": "gq", "program_id": "p", "address_space": "ram", "address": 80}, {"address_group_id": "gx", "program_id": "x", "address_space": "xbox-va", "address": 1}],
        "functions": [{"function_id": "pf", "program_id": "p", "address_group_id": "gp"}, {"function_id": "pg", "program_id": "p", "address_group_id": "gq"}, {"function_id": "xf", "program_id": "x", "address_group_id": "gx"}],
        "function_assertions": [{"assertion_id": f"a{f}", "function_id": f, "provenance_id": p} for f, p in (("pf", "v"), ("xf", "v"), ("pg", "w"))],
        "function_names": [{"name_id": 1, "function_id": "xf", "name": "N", "is_primary": 1}],
        "function_name_assertions": [{"assertion_id": "n", "name_id": 1, "is_primary": 1, "provenance_id": "v"}],
        "match_hypothesis_sets": [{"hypothesis_set_id": "h", "pc_function_id": "pf", "provenance_id": "v"}],
        "match_hypothesis_alternatives": [{"alternative_id": "a", "hypothesis_set_id": "h", "claim_id": "c1"}, {"alternative_id": "b", "hypothesis_set_id": "h", "xbox_fold_group_id": "fo"}],
        "match_claims": [{"claim_id": "c1", "pc_function_id": "pf", "xbox_function_id": "xf", "provenance_id": "v"}, {"claim_id": "c2", "pc_function_id": "pg", "xbox_function_id": "xf", "provenance_id": "v"}, {"claim_id": "c3", "pc_function_id": "pf", "xbox_target_id": "t", "provenance_id": "v"}],
        "review_decisions": [decide("d1", alternative_id="a"), decide("d2", claim_id="c1"), decide("d3", claim_id="c2"), decide("d4", claim_id="c3"), decide("d5", hypothesis_set_id="h"), decide("d6", alternative_id="b"), decide("d7", claim_id="c1", previous="d8"), decide("d8", claim_id="c1", action="defer"), decide("d9", claim_id="c1", action="reject")],
    }
    plan = exports.export_plan(Small(spark, changed), "r", "rel")
    assert {r["decision_id"]: r["reasons"] for r in plan.collect()} == {
        "d1": "",
        "d2": "",
        "d3": "provenance_manifest_mismatch",
        "d4": "xbox_unresolved_endpoint",
        "d5": "hypothesis_set_only_acceptance",
        "d6": "xbox_fold_bundle",
        "d7": "",
    }
    assert [(r["pc_address"], r["name"], r["lineage_count"], r["first_decision_id"]) for r in persist.applied(plan).collect()] == [(64, "N", 3, "d1")]
    assert exports.export_plan(Small(spark, changed), "r", "none").count() == 0
