"""Named checks of source ranges, class names, observed slots and slot alignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import checks
from cairn.plans.validation import _missing, _unequal, check
from cairn.sources.staging import once

RANGE = ["function_id", "source_file_id", "line_start", "column_start"]
_missing("function_source_ranges_without_assertions", "function_source_ranges", "function_source_range_assertions", RANGE)
_unequal("source_range_projection_without_matching_assertion", "function_source_ranges", "function_source_range_assertions", RANGE, ["line_end", "column_end", "is_primary", "provenance_id", "details_json"])
_missing("class_names_without_assertions", "class_names", "class_name_assertions", ["name_id"])
_unequal("class_name_projection_without_matching_assertion", "class_names", "class_name_assertions", ["name_id"], ["is_primary", "provenance_id", "details_json"])


@check
def vtable_observed_slot_count_mismatch(c):
    tables = c.vtables.withColumn("observed", F.expr("try_cast(get_json_object(details_json, '$.observed_slot_count') AS bigint)"))
    return checks.count_mismatch(tables, c.vtable_slots, "vtable_id", "observed")


@check
def vtable_slot_alignments_without_structural_evidence(c):
    return checks.orphans(c.vtable_slot_alignments, c.match_hypothesis_evidence.where("independence_group = 'class_slot_alignment'"), ["hypothesis_set_id"])


@check
def vtable_slot_alignment_alternative_count_mismatch(c):
    return checks.count_mismatch(c.vtable_slot_alignments.withColumn("wanted", F.lit(1)), c.match_hypothesis_alternatives, "hypothesis_set_id", "wanted")


@check
def vtable_slot_alignment_index_mismatch(c):
    return c.vtable_slot_alignments.where("pc_slot_index <> xbox_slot_index")


def _at(c, side: str) -> DataFrame:
    """Slot alignments, by their id, with the slot's address group on one side, as ``slot``, and the functions there, as ``at``."""
    slots = c.vtable_slots.select(F.col("vtable_id").alias(f"{side}_vtable_id"), F.col("slot_index").alias(f"{side}_slot_index"), F.col("target_address_group_id").alias("slot"))
    n = once(c, "functions_at", lambda: c.functions.groupBy(F.col("address_group_id").alias("slot")).agg(F.count("*").alias("at")))
    own = c.vtable_slot_alignments.select("slot_alignment_id", "hypothesis_set_id", f"{side}_vtable_id", f"{side}_slot_index")
    return own.join(slots, [f"{side}_vtable_id", f"{side}_slot_index"]).join(n, "slot", "left").select("slot_alignment_id", "hypothesis_set_id", "slot", F.coalesce("at", F.lit(0)).alias("at"))


def _ends(c, rows: DataFrame, side: str) -> DataFrame:
    """``rows`` with ``address_group_id``, that of the function or target at one end."""
    f = c.functions.select(F.col("function_id").alias(f"{side}_function_id"), F.col("address_group_id").alias("of_function"))
    t = c.unresolved_targets.select(F.col("target_id").alias(f"{side}_target_id"), F.col("address_group_id").alias("of_target"))
    return rows.join(f, f"{side}_function_id", "left").join(t, f"{side}_target_id", "left").withColumn("address_group_id", F.coalesce("of_function", "of_target"))


def _elsewhere(rows: DataFrame) -> DataFrame:
    return rows.where("slot IS NULL OR address_group_id <> slot")


def _misnamed(rows: DataFrame, side: str) -> DataFrame:
    """A function stands for an address with one function, a target for one with none."""
    return rows.where(f"({side}_function_id IS NOT NULL AND at <> 1) OR ({side}_target_id IS NOT NULL AND at <> 0)")


def _pc(c) -> DataFrame:
    return once(c, "pc_ends_of_slots", lambda: _at(c, "pc").join(c.match_hypothesis_sets.select("hypothesis_set_id", "pc_function_id", "pc_target_id"), "hypothesis_set_id"))


def _scalar(c) -> DataFrame:
    a = c.match_hypothesis_alternatives.select("hypothesis_set_id", "claim_id")
    a = a.join(c.match_claims.select("claim_id", "xbox_function_id", "xbox_target_id"), "claim_id").drop("claim_id")
    return once(c, "xbox_ends_of_slots", lambda: _at(c, "xbox").join(a, "hypothesis_set_id"))


def _folds(c) -> DataFrame:
    a = c.match_hypothesis_alternatives.where("xbox_fold_group_id IS NOT NULL").select("hypothesis_set_id", F.col("xbox_fold_group_id").alias("fold_group_id"))
    return _at(c, "xbox").join(a, "hypothesis_set_id")


@check
def vtable_slot_alignment_pc_endpoint_mismatch(c):
    return _elsewhere(_ends(c, _pc(c), "pc"))


@check
def vtable_slot_alignment_pc_endpoint_classification_mismatch(c):
    return _misnamed(_pc(c), "pc")


@check
def vtable_slot_alignment_scalar_xbox_endpoint_mismatch(c):
    return _elsewhere(_ends(c, _scalar(c), "xbox"))


@check
def vtable_slot_alignment_scalar_xbox_classification_mismatch(c):
    return _misnamed(_scalar(c), "xbox")


@check
def vtable_slot_alignment_fold_xbox_endpoint_mismatch(c):
    own = c.fold_group_members.join(c.functions.select("function_id", "program_id", "address_group_id"), ["function_id", "program_id"], "left")
    spread = own.groupBy("fold_group_id").agg(F.min("address_group_id").alias("lo"), F.max("address_group_id").alias("hi"), F.count("*").alias("members"))
    j = _folds(c).join(spread, "fold_group_id", "left")
    return j.where("slot IS NULL OR members IS NULL OR lo <> slot OR hi <> slot")


@check
def vtable_slot_alignment_fold_xbox_membership_incomplete(c):
    n = c.fold_group_members.groupBy("fold_group_id").agg(F.count("*").alias("members"))
    return _folds(c).join(n, "fold_group_id", "left").where("at <= 1 OR coalesce(members, 0) <> at")


@check
def vtable_slot_alignment_non_candidate_mapping(c):
    sets = c.match_hypothesis_sets.select("hypothesis_set_id", F.col("status").alias("set_status"))
    claims = c.match_claims.select("claim_id", F.col("status").alias("claim_status"), "confidence_value")
    j = c.vtable_slot_alignments.join(sets, "hypothesis_set_id").join(c.match_hypothesis_alternatives.select("hypothesis_set_id", "claim_id"), "hypothesis_set_id").join(claims, "claim_id", "left")
    return j.where("status <> 'candidate' OR set_status <> 'candidate' OR claim_status <> 'candidate' OR confidence_value IS NOT NULL")


@check
def vtable_alignment_provenance_created_function_or_name(c):
    return checks.written_by({"function_assertions": c.function_assertions, "function_name_assertions": c.function_name_assertions}, c.provenance.where("producer LIKE '%.vtable_hypotheses'"))
