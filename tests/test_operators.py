import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import expr
from cairn.operators import alignment, checks, decode, lookup, matching, paging, persist, ranges, review


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_stable_id_is_canonical_json(spark):
    df = spark.createDataFrame([("a\"b\\c é", 3)], "s string, n long")
    got = df.select(expr.stable_id("x", expr.json_text(F.col("s"), "string"), expr.json_text(F.col("n"), "number"), F.lit("null"))).first()[0]
    payload = json.dumps({"components": ['a"b\\c é', 3, None], "namespace": "x"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert got == "x:sha256:" + hashlib.sha256(payload.encode()).hexdigest()


def test_ascii_lower_and_contains(spark):
    df = spark.createDataFrame([("ÉAb",)], "s string")
    assert df.select(expr.ascii_lower(F.col("s"))).first()[0] == "Éab"
    assert df.select(expr.contains(F.col("s"), "aB")).first()[0]
    with pytest.raises(ValueError):
        expr.matches(F.col("s"), "", "exact")


@pytest.mark.parametrize("given,want", [("0x1F", 31), ("12", 12), ("-1", None), ("", None), ("0x", None), (None, None)])
def test_parse_address(spark, given, want):
    assert spark.createDataFrame([(given,)], "s string").select(expr.parse_address(F.col("s"))).first()[0] == want


@pytest.mark.parametrize("limit,offset", [(0, 0), (1001, 0), (1, -1), (True, 0)])
def test_page_limits(limit, offset):
    with pytest.raises(ValueError):
        paging.checked(limit, offset)


def test_page_counts_before_paging(spark):
    got = paging.page(spark.range(7), ["id"], 3, 3)
    assert rows(got, "id", "total", "has_more") == [(3, 7, True), (4, 7, True), (5, 7, True)]
    assert paging.page(spark.range(7), ["id"], 3, 6).first()["has_more"] is False


def test_history_of_long_chain(spark):
    df = spark.createDataFrame([(i, i - 1 if i else None) for i in range(300)], "decision_id long, previous_decision_id long")
    assert rows(review.history(df), "decision_id", "root_decision_id", "depth") == [(i, 0, i) for i in range(300)]


def test_leaves_keep_every_reviewer(spark):
    df = spark.createDataFrame([(1, None, "accept"), (2, 1, "reject"), (3, None, "defer")], "decision_id long, previous_decision_id long, action string")
    assert rows(review.current_leaves(df), "decision_id", "derived_status") == [(2, "rejected"), (3, "deferred")]


def test_triage_buckets_do_not_multiply_evidence(spark):
    sets = spark.createDataFrame([(i, 0) for i in range(5)], "hypothesis_set_id long, has_unresolved int")
    alternatives = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 0), (2, 1, 0, 0), (3, 0, 0, 1), (4, 0, 0, 0)], "hypothesis_set_id long, is_fold int, is_empty_fold int, is_unresolved int")
    evidence = spark.createDataFrame([(1, "supports"), (1, "context"), (2, "supports"), (3, "supports"), (4, "contradicts")], "hypothesis_set_id long, effect string")
    got = review.triage(sets, alternatives, evidence)
    assert rows(got, "hypothesis_set_id", "triage_rank", "evidence_count") == [(0, 1, 0), (1, 2, 2), (2, 3, 1), (3, 4, 1), (4, 0, 1)]


def test_residual_needs_one_free_endpoint_on_each_side(spark):
    pc = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c")], "anchor long, pc_key string")
    xbox = spark.createDataFrame([(1, "A"), (1, "B"), (2, "A"), (2, "B")], "anchor long, xbox_key string")
    mapping = spark.createDataFrame([("a", "A", "exact")], "pc_key string, xbox_key string, kind string")
    anchors = spark.createDataFrame([(1,), (2,), (3,)], "anchor long")
    per = matching.neighbourhoods(pc, xbox, mapping, anchors)
    assert rows(per, "anchor", "outcome") == [(1, "unique_residual_proposal"), (2, "no_unique_residual"), (3, "missing_pc_calls")]
    assert rows(matching.residuals(per), "anchor", "pc_key", "xbox_key") == [(1, "b", "B")]


def test_fold_member_blocks(spark):
    pc, xbox = spark.createDataFrame([(1, "a")], "anchor long, pc_key string"), spark.createDataFrame([(1, "A")], "anchor long, xbox_key string")
    mapping = spark.createDataFrame([("a", "A", "fold_member_blocker")], "pc_key string, xbox_key string, kind string")
    per = matching.neighbourhoods(pc, xbox, mapping, pc.select("anchor"))
    assert per.first()["outcome"] == "blocked_ambiguous_existing_relations"


def test_matching_ignores_input_order(spark):
    pc = spark.createDataFrame([(i % 7, str(i % 5)) for i in range(60)], "anchor long, pc_key string")
    xbox = spark.createDataFrame([(i % 7, str(i % 4)) for i in range(60)], "anchor long, xbox_key string")
    mapping = spark.createDataFrame([(str(i), str(i), "exact") for i in range(3)], "pc_key string, xbox_key string, kind string")
    one, two = (matching.neighbourhoods(p, x, mapping, pc.select("anchor")) for p, x in ((pc, xbox), (pc.orderBy(F.rand(1)), xbox.orderBy(F.rand(2)))))
    assert rows(one, "anchor", "outcome") == rows(two, "anchor", "outcome")


def test_interval_join_equals_nested_loop(spark):
    points = spark.range(200).select(F.col("id").alias("p"))
    spans = spark.createDataFrame([(k, k * 7 % 180, k * 7 % 180 + k % 40) for k in range(40)], "k long, s long, e long")
    got = ranges.containing(points, "p", spans, "s", "e", 16)
    want = sorted((p, k) for p in range(200) for k in range(40) if k * 7 % 180 <= p < k * 7 % 180 + k % 40)
    assert rows(got, "p", "k") == want


def test_base_offsets_stop_at_cycles(spark):
    df = spark.createDataFrame([("a", "b", 4), ("b", "c", 8), ("c", "a", 0)], "class_name string, base_name string, base_offset long")
    assert rows(alignment.base_offsets(df), "class_name", "base_name", "offset") == [("a", "b", 4), ("a", "c", 12), ("b", "a", 8), ("b", "c", 8), ("c", "a", 0), ("c", "b", 4)]


def test_alignment_picks_no_winner(spark):
    kind = "vtable_id long, class_name string, vfptr_role string, subobject_offset long, slot_count long"
    pc = spark.createDataFrame([(1, "A", "primary", None, 3), (2, "B", "primary", 0, 3), (3, "B", "primary", 0, 4), (4, "C", "secondary", 8, 2)], kind)
    xbox = spark.createDataFrame([(1, "A", "primary", 0, 5), (2, "B", "primary", 0, 3), (5, "C", "secondary", None, 2), (6, "D", "primary", 0, 1)], kind)
    got = alignment.aligned(pc, xbox)
    assert rows(got, "class_name", "verdict") == [("A", "candidate"), ("B", "primary_role_ambiguous"), ("C", "secondary_offset_missing_on_xbox"), ("D", "class_missing_on_pc")]
    assert rows(alignment.candidates(got), "pc_vtable_id", "shared_prefix", "pc_tail", "xbox_tail") == [(1, 3, 0, 2)]


@pytest.mark.parametrize(
    "word,address,kind,target",
    [
        (0x48000101, 0x1000, "branch_immediate", 0x1100),
        (0x4BFFFFFD, 0x1000, "branch_immediate", 0xFFC),
        (0x48000006, 0x1000, "branch_immediate", 4),
        (0x4182FFF0, 0x1000, "branch_conditional", 0xFF0),
        (0x4E800020, 0x1000, "branch_to_link_register", None),
        (0x4E800421, 0x1000, "branch_to_count_register", None),
        (0x4BFFFFFC, 0, "branch_immediate", 0xFFFFFFFC),
    ],
)
def test_branch_words(spark, word, address, kind, target):
    r = decode.branches(spark.createDataFrame([(address, word)], "address long, word long")).first()
    assert (r["branch_kind"], r["target"]) == (kind, target)


def test_other_words_are_no_branches(spark):
    assert decode.branches(spark.createDataFrame([(0, 0x38600001)], "address long, word long")).count() == 0


@pytest.mark.parametrize(
    "name,owner,qualifier,role",
    [
        ("??_7Actor@@6B@", "Actor", None, "unqualified_vfptr_symbol"),
        ("??_7A@@6BB@@6BC@@@", "A@@6BB", "C@@", "qualified_vfptr_symbol"),
        ("??_7A@@6B", "A", None, "unparsed"),
        ("Actor", None, None, "not_vftable"),
        ("??_7Actor", None, None, "unparsed"),
    ],
)
def test_name_parts(spark, name, owner, qualifier, role):
    r = decode.name_parts(spark.createDataFrame([(name,)], "decorated_name string")).first()
    assert (r["owner"], r["qualifier"], r["role"]) == (owner, qualifier, role)


def test_checks_are_null_safe(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (3, None)], "id long, v string")
    b = spark.createDataFrame([(1, None), (2, "y")], "id long, v string")
    assert rows(checks.unmatched(a, b, ["id"], ["v"]), "id") == [(2,), (3,)]
    assert rows(checks.not_in_domain(a, "v", ("x",)), "id") == [(1,), (3,)]
    assert rows(persist.conflicts(a, b, "id", ["v"]), "id") == [(2,)]
    assert rows(persist.additions(a, b, "id"), "id") == [(3,)]


def test_contiguity(spark):
    df = spark.createDataFrame([("ok", 0), ("ok", 1), ("gap", 0), ("gap", 2), ("twice", 0), ("twice", 0)], "g string, p long")
    assert rows(checks.not_contiguous(df, ["g"], "p"), "g") == [("gap",), ("twice",)]


def test_export_plan(spark):
    base = {"decision_id": 0, "target_kind": "claim", "xbox_fold_group_id": None, "claim_id": 1, "set_pc_function_id": 1, "pc_function_id": 1, "xbox_function_id": 5, "pc_platform": "pc", "pc_program_id": "p", "pc_address_space": "ram", "pc_address": 10, "xbox_platform": "xbox360", "name_count": 1, "name": "a", "manifest_ok": True}
    cases = [
        ({}, "conflicting_accepted_destination"),
        ({"xbox_function_id": 6}, "conflicting_accepted_destination"),
        ({"pc_address": 11}, ""),
        ({"pc_address": 11}, ""),
        ({"pc_address": 12, "name": "x"}, "conflicting_accepted_name"),
        ({"pc_address": 12, "name": "y"}, "conflicting_accepted_name"),
        ({"target_kind": "hypothesis_set", "set_pc_function_id": None}, "hypothesis_set_only_acceptance,pc_unresolved_endpoint"),
        ({"target_kind": "alternative", "xbox_fold_group_id": 3, "pc_platform": "xbox360", "pc_address_space": "file", "manifest_ok": False}, "pc_endpoint_wrong_platform,provenance_manifest_mismatch,xbox_fold_bundle"),
        ({"target_kind": "alternative", "set_pc_function_id": 2}, "alternative_pc_subject_mismatch"),
        ({"claim_id": None}, "missing_scalar_claim"),
        ({"pc_platform": "xbox360", "pc_address_space": "file"}, "pc_address_space_not_runtime,pc_endpoint_wrong_platform"),
        ({"pc_platform": None, "xbox_platform": None}, "missing_pc_function,missing_xbox_function"),
        ({"pc_function_id": None, "xbox_function_id": None}, "pc_unresolved_endpoint,xbox_unresolved_endpoint"),
        ({"xbox_platform": "pc"}, "xbox_endpoint_wrong_platform"),
        ({"name_count": 0, "name": None}, "missing_xbox_name"),
        ({"name_count": 2, "manifest_ok": False}, "ambiguous_xbox_names,provenance_manifest_mismatch"),
    ]
    kind = "decision_id long, target_kind string, xbox_fold_group_id long, claim_id long, set_pc_function_id long, pc_function_id long, xbox_function_id long, pc_platform string, pc_program_id string, pc_address_space string, pc_address long, xbox_platform string, name_count long, name string, manifest_ok boolean"
    plan = persist.export_plan(spark.createDataFrame([tuple((base | c | {"decision_id": k}).values()) for k, (c, _) in enumerate(cases)], kind))
    assert rows(plan, "decision_id", "reasons") == [(k, r) for k, (_, r) in enumerate(cases)]
    assert rows(persist.applied(plan), "pc_address", "lineage_count", "first_decision_id") == [(11, 2, 2)]


def test_values_that_nulls_and_zones_change(spark):
    leaves = spark.createDataFrame([(1, 7, "accept", None), (2, 7, "accept", 5)], "target_id long, reviewer_id long, action string, review_release_id long")
    got = review.selected_states(spark.createDataFrame([(1,), (2,)], "target_id long"), leaves, 7, 5)
    assert rows(got, "target_id", "basis") == [(1, "current_leaf_from_another_release"), (2, "current_accept_in_selected_release")]
    functions, targets = spark.createDataFrame([(1, None)], "function_id long, name string"), spark.createDataFrame([(9, None)], "target_id long, name_hint string")
    claims = spark.createDataFrame([(1, 1, None), (2, None, 9), (3, 8, None)], "claim_id long, pc_function_id long, pc_target_id long")
    assert rows(lookup.endpoints(claims, functions, targets), "claim_id", "endpoint_kind") == [(1, "function"), (2, "unresolved_target"), (3, "missing")]
    types = spark.createDataFrame([(1, None)], "type_index long, rendered string")
    assert rows(lookup.resolved_many(spark.createDataFrame([(1,), (2,)], "type_index long"), types), "type_index", "status") == [(1, "resolved"), (2, "missing_type_record")]
    assert rows(checks.id_format(spark.createDataFrame([(None, 1), ("k1", 1)], "id string, n long"), "id", "k%d", "n"), "n") == [(1,)]
    before = spark.conf.get("spark.sql.session.timeZone")
    df = spark.createDataFrame([("2020-01-01T00:00:00.000001Z",), ("1969-12-31T23:59:59.5Z",), ("2021-11-07T05:30:00Z",), ("2021-11-07T06:30:00Z",)], "t string")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert [r[0] for r in df.select(expr.utc_text(F.col("t").cast("timestamp"))).collect()] == ["2020-01-01T00:00:00.000001Z", "1969-12-31T23:59:59.500000Z", "2021-11-07T05:30:00.000000Z", "2021-11-07T06:30:00.000000Z"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_json_text_escapes_all_controls(spark):
    text = "".join(map(chr, range(1, 40))) + "\\é\x7f"
    assert spark.createDataFrame([(text,)], "t string").select(expr.json_text(F.col("t"), "string")).first()[0] == json.dumps(text, ensure_ascii=False)


def test_pointer_run_terminations(spark):
    words = spark.createDataFrame([(1, 0, 50), (1, 1, 5), (2, 0, 50), (3, 0, 50), (4, 0, 50)], "table_id long, slot_index long, target long")
    mapped = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 2), (5, 1)], "table_id long, section_count long")
    got = decode.pointer_runs(words, 10, 100, mapped=mapped)
    assert rows(got, "table_id", "slot_count", "termination") == [(1, 1, "first_non_text_pointer"), (2, 1, "mapped_section_end"), (3, 0, "unmapped_table_address"), (4, 0, "ambiguous_table_mapping"), (5, 0, "mapped_section_end")]


def test_names_stay_alternatives(spark):
    claims = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (3, "c")], "address long, name string")
    functions = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "function_id long, name string")
    assert rows(lookup.resolved_names(claims, functions), "name", "resolution") == [("a", "unique"), ("b", "ambiguous"), ("c", "unresolved")]


def test_portable_label(spark):
    df = spark.createDataFrame([("9 lives::of()", "k"), ("é", "k")], "n string, i string")
    tail = hashlib.sha256(b"k").hexdigest()[:12]
    assert sorted(r[0] for r in df.select(expr.portable_label(F.col("n"), F.col("i"), "EX")).collect()) == [f"EX_n_9_lives_of__{tail}", f"EX_symbol__{tail}"]
