"""Check families on a small valid catalog: nothing is broken, and one changed value breaks just what it should."""

import hashlib
import struct

import pytest

from cairn.plans import validation, validation_flow, validation_slots, validation_types
from cairn.sources import catalog

BODY = b"\x01\x02\x03"
SHA = hashlib.sha256(BODY).hexdigest()
TAG = hashlib.sha256(struct.pack("<H", 5380) + BODY).hexdigest()

#: One row a table where that is enough; missing columns are null.
BASE = {
    "programs": [{"program_id": "x", "platform": "xbox360"}, {"program_id": "p", "platform": "pc"}],
    "provenance": [{"provenance_id": "v", "producer": "own.vtable_hypotheses"}, {"provenance_id": "w", "producer": "other"}],
    "address_groups": [{"address_group_id": g, "program_id": "x", "address_space": "xbox-va", "address": a} for g, a in (("g1", 100), ("g2", 200), ("g3", 300), ("g4", 400))],
    "functions": [{"function_id": f, "program_id": "x", "address_group_id": g} for f, g in (("f1", "g1"), ("f2", "g2"), ("f3", "g2"))],
    "function_assertions": [{"assertion_id": "fa", "function_id": "f1", "provenance_id": "w"}],
    "function_source_ranges": [{"function_id": "f1", "source_file_id": "s", "line_start": 1, "column_start": 0, "is_primary": 1}],
    "function_source_range_assertions": [{"assertion_id": "ra", "function_id": "f1", "source_file_id": "s", "line_start": 1, "column_start": 0, "is_primary": 1}],
    "class_names": [{"name_id": 1, "class_id": "c", "is_primary": 1}],
    "class_name_assertions": [{"assertion_id": "ca", "name_id": 1, "is_primary": 1}],
    "vtables": [{"vtable_id": "v1", "details_json": '{"observed_slot_count": 1}'}, {"vtable_id": "v2", "details_json": '{"observed_slot_count": 2}'}],
    "vtable_slots": [{"vtable_id": "v1", "slot_index": 0, "target_address_group_id": "g1"}, {"vtable_id": "v2", "slot_index": 0, "target_address_group_id": "g1"}, {"vtable_id": "v2", "slot_index": 1, "target_address_group_id": "g2"}],
    "vtable_slot_alignments": [{"slot_alignment_id": "sa", "hypothesis_set_id": "h", "pc_vtable_id": "v1", "pc_slot_index": 0, "xbox_vtable_id": "v2", "xbox_slot_index": 0, "status": "candidate"}],
    "match_hypothesis_sets": [{"hypothesis_set_id": "h", "pc_function_id": "f1", "status": "candidate", "provenance_id": "v"}],
    "match_hypothesis_alternatives": [{"alternative_id": "al", "hypothesis_set_id": "h", "claim_id": "cl"}],
    "match_claims": [{"claim_id": "cl", "xbox_function_id": "f1", "status": "candidate", "provenance_id": "v"}],
    "match_hypothesis_evidence": [{"evidence_id": "e", "hypothesis_set_id": "h", "independence_group": "class_slot_alignment", "provenance_id": "v"}],
    "fold_groups": [{"fold_group_id": "fo", "program_id": "x"}],
    "fold_group_members": [{"fold_group_id": "fo", "program_id": "x", "function_id": f} for f in ("f2", "f3")],
    "control_flow_extractions": [{"extraction_id": "e", "program_id": "x", "provenance_id": "cf", "persistence_policy": "call_relevant_v1", "source_physical_site_count": 3, "source_logical_use_count": 3, "triggering_logical_use_count": 3, "persisted_physical_site_count": 3, "persisted_logical_use_count": 3, "procedure_scan_count": 1, "details_json": '{"source_summary": {"physical_sites": 3, "logical_uses": 3, "use_roles": {"direct_call": 3}, "scan_statuses": {"ok": 1}}}'}],
    "control_flow_sites": [{"site_id": f"s{k}", "program_id": "x", "address_group_id": "g1"} for k in range(3)],
    "control_flow_site_assertions": [
        {"assertion_id": "a0", "extraction_id": "e", "program_id": "x", "site_id": "s0", "raw_site_va": 100, "raw_target_va": 100, "target_kind": "unique_procedure", "target_address_group_id": "g1", "target_function_id": "f1", "target_record_count": 1},
        {"assertion_id": "a1", "extraction_id": "e", "program_id": "x", "site_id": "s1", "raw_site_va": 100, "raw_target_va": 200, "target_kind": "fold_group", "target_address_group_id": "g2", "target_fold_group_id": "fo", "target_record_count": 2},
        {"assertion_id": "a2", "extraction_id": "e", "program_id": "x", "site_id": "s2", "raw_site_va": 100, "raw_target_va": 300, "target_kind": "executable_non_entry", "target_address_group_id": "g3", "target_record_count": 0},
    ],
    "control_flow_uses": [{"use_id": f"u{k}", "program_id": "x", "procedure_record_id": "pr", "function_id": "f1", "site_id": f"s{k}"} for k in range(3)],
    "control_flow_use_assertions": [{"assertion_id": f"b{k}", "extraction_id": "e", "program_id": "x", "use_id": f"u{k}", "role": "direct_call"} for k in range(3)],
    "control_flow_scans": [{"scan_id": "sc", "extraction_id": "e", "program_id": "x", "procedure_record_id": "pr", "function_id": "f1", "scan_address_group_id": "g1", "scanned_size": 8, "source_branch_use_count": 3, "persisted_branch_use_count": 3, "status": "ok"}],
    "codeview_type_extractions": [{"extraction_id": "t", "program_id": "x", "type_namespace": "global-tpi", "provenance_id": "tp", "raw_type_record_count": 3, "raw_body_byte_count": 9, "tag_record_count": 1, "definition_count": 1, "forward_reference_count": 0, "tag_member_occurrence_count": 1, "physical_field_member_count": 1, "physical_method_overload_count": 1, "diagnostic_count": 1}],
    "codeview_type_records": [{"type_record_id": r, "program_id": "x", "type_namespace": "global-tpi", "type_index": i, "leaf_kind": k, "record_length": 5, "raw_body": BODY, "raw_body_sha256": SHA} for r, i, k in (("r1", 1, 5380), ("r2", 2, 4611), ("r3", 3, 4614))],
    "codeview_type_record_assertions": [{"assertion_id": f"ta{r}", "extraction_id": "t", "program_id": "x", "type_namespace": "global-tpi", "type_record_id": r} for r in ("r1", "r2", "r3")],
    "codeview_tag_layouts": [{"tag_layout_id": "l", "extraction_id": "t", "program_id": "x", "type_namespace": "global-tpi", "type_record_id": "r1", "tag_kind": "class", "record_sha256": TAG, "properties": 0, "is_forward_reference": 0, "physical_member_occurrence_count": 1, "decoded_member_count": 2}],
    "codeview_field_members": [{"field_member_id": "m", "extraction_id": "t", "program_id": "x", "member_kind": "overloaded_method", "source_field_list_type_index": 2, "method_list_type_index": 3, "declared_overload_count": 2}],
    "codeview_tag_member_uses": [{"member_use_id": "mu", "extraction_id": "t", "program_id": "x", "tag_layout_id": "l", "field_member_id": "m", "ordinal": 0}],
    "codeview_method_overloads": [{"method_overload_id": "o", "extraction_id": "t", "program_id": "x", "method_list_type_index": 3, "ordinal": 0}],
    "codeview_layout_diagnostics": [{"diagnostic_id": "d", "extraction_id": "t", "program_id": "x", "tag_layout_id": "l", "ordinal": 0}],
    "data_symbol_extractions": [{"extraction_id": "de", "program_id": "x", "address_space": "xbox-va", "provenance_id": "dp", "record_count": 2, "resolved_record_count": 1, "unresolved_record_count": 1, "unique_address_count": 1}],
    "data_symbol_records": [{"data_record_id": r, "program_id": "x", "source_record_id": f"x360-data:m0001:s0002:o{o:08X}", "module_index": 1, "symbol_stream": 2, "record_offset": o} for r, o in (("d1", 26), ("d2", 27))],
    "data_symbol_record_assertions": [{"assertion_id": "da1", "extraction_id": "de", "program_id": "x", "data_record_id": "d1", "address_group_id": "g1", "resolved_va": 100}, {"assertion_id": "da2", "extraction_id": "de", "program_id": "x", "data_record_id": "d2"}],
}


class Small:
    def __init__(self, spark, changed=None):
        self.spark, self.rows = spark, {**BASE, **(changed or {})}

    def __getattr__(self, table):
        kind = catalog.schema(table)
        return self.spark.createDataFrame([tuple(r.get(f.name) for f in kind) for r in self.rows.get(table, [])], kind)


def family(module):
    return [n for n, f in validation.CHECKS.items() if getattr(f, "__module__", "") == module.__name__]


SLOTS = [*family(validation_slots), "function_source_ranges_without_assertions", "source_range_projection_without_matching_assertion", "class_names_without_assertions", "class_name_projection_without_matching_assertion"]
FLOW, TYPES = family(validation_flow), family(validation_types)


def broken(spark, names, changed=None):
    return {r["check"]: r["violations"] for r in validation.violations(Small(spark, changed), names).collect() if r["violations"]}


def test_families_are_whole():
    assert len(validation.CHECKS) == 83 and len(SLOTS) == 16 and len(FLOW) == 20 and len(TYPES) == 18


@pytest.mark.parametrize("names", [SLOTS, FLOW, TYPES], ids=["slots", "flow", "types"])
def test_valid_catalog(spark, names):
    assert broken(spark, names) == {}


def changed(table, at=0, **values):
    return {table: [{**r, **(values if k == at else {})} for k, r in enumerate(BASE[table])]}


S, C, T, D = "vtable_slot_alignment_", "control_flow_", "codeview_", "data_symbol_"
CASES = [
    (SLOTS, changed("function_source_range_assertions", line_end=3), {"source_range_projection_without_matching_assertion"}),
    (SLOTS, {"class_name_assertions": []}, {"class_names_without_assertions", "class_name_projection_without_matching_assertion"}),
    (SLOTS, changed("vtables", details_json="{}"), {"vtable_observed_slot_count_mismatch"}),
    (SLOTS, changed("match_hypothesis_evidence", independence_group="z"), {"vtable_slot_alignments_without_structural_evidence"}),
    (SLOTS, changed("vtable_slot_alignments", xbox_slot_index=1), {S + "index_mismatch", S + "scalar_xbox_endpoint_mismatch", S + "scalar_xbox_classification_mismatch"}),
    (SLOTS, changed("match_hypothesis_sets", pc_function_id="f2"), {S + "pc_endpoint_mismatch"}),
    (SLOTS, changed("match_hypothesis_alternatives", claim_id=None, xbox_fold_group_id="fo"), {S + "fold_xbox_endpoint_mismatch", S + "fold_xbox_membership_incomplete"}),
    (SLOTS, changed("match_claims", confidence_value=0.5), {S + "non_candidate_mapping"}),
    (SLOTS, changed("function_assertions", provenance_id="v"), {"vtable_alignment_provenance_created_function_or_name"}),
    (FLOW, changed("control_flow_extractions", details_json="{}"), {C + "source_summary_metadata_mismatch", C + "policy_trigger_count_mismatch"}),
    (FLOW, changed("control_flow_use_assertions", role="local_branch"), {C + "policy_trigger_count_mismatch", C + "sites_without_policy_trigger_use"}),
    (FLOW, {"control_flow_scans": []}, {C + "metadata_row_count_mismatch", C + "uses_without_matching_scan", C + "scan_total_mismatch"}),
    (FLOW, changed("control_flow_uses", site_id="s9"), {C + "sites_without_policy_trigger_use", C + "sites_without_any_use", C + "uses_without_site_assertion"}),
    (FLOW, changed("control_flow_scans", scan_address_group_id="g4"), {C + "use_outside_scan_extent", C + "scan_endpoint_mismatch"}),
    (FLOW, changed("control_flow_site_assertions", raw_target_va=7), {C + "raw_endpoint_mismatch"}),
    (FLOW, changed("control_flow_site_assertions", target_function_id="f2"), {C + "unique_endpoint_cardinality_mismatch"}),
    (FLOW, {"fold_group_members": BASE["fold_group_members"][:1]}, {C + "fold_endpoint_cardinality_mismatch"}),
    (FLOW, changed("control_flow_site_assertions", at=2, target_record_count=1), {C + "non_entry_endpoint_cardinality_mismatch"}),
    (FLOW, changed("address_groups", at=2, address_space="ram"), {C + "non_xbox_addressing", C + "raw_endpoint_mismatch"}),
    (FLOW, changed("function_assertions", provenance_id="cf"), {C + "provenance_created_function_or_name"}),
    (FLOW, changed("match_claims", provenance_id="cf"), {C + "provenance_created_match_state"}),
    (TYPES, changed("codeview_type_records", at=1, raw_body=b"\x01\x02"), {T + "type_extraction_summary_mismatch", T + "type_record_integrity_mismatch"}),
    (TYPES, changed("codeview_tag_layouts", record_sha256="0"), {T + "tag_record_identity_mismatch"}),
    (TYPES, changed("codeview_tag_layouts", properties=128), {T + "tag_record_identity_mismatch"}),
    (TYPES, changed("codeview_tag_member_uses", ordinal=1), {T + "tag_member_shape_mismatch"}),
    (TYPES, changed("codeview_field_members", source_field_list_type_index=3), {T + "field_member_identity_mismatch"}),
    (TYPES, changed("codeview_method_overloads", ordinal=4), {T + "method_overload_identity_mismatch"}),
    (TYPES, changed("codeview_layout_diagnostics", tag_layout_id="z"), {T + "layout_diagnostic_identity_mismatch"}),
    (TYPES, changed("data_symbol_records", source_record_id="z"), {D + "record_identity_mismatch"}),
    (TYPES, changed("data_symbol_record_assertions", resolved_va=101), {D + "non_xbox_addressing"}),
    (TYPES, changed("data_symbol_record_assertions", at=1, data_record_id="d1"), {D + "records_without_assertions"}),
    (TYPES, changed("match_claims", provenance_id="dp"), {"type_data_provenance_created_match_state"}),
]


@pytest.mark.parametrize("names,change,want", CASES, ids=[f"{k}-{next(iter(c[1]))}" for k, c in enumerate(CASES)])
def test_one_changed_value(spark, names, change, want):
    near = [n for n in names if n in want or len(n) % 5 == 0]  # what must break, and some that must not
    assert set(broken(spark, near, change)) == want
