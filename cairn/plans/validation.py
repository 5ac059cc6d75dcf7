"""Semantic validation of a catalog: named checks, each the rows that break it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import checks
from cairn.sources.catalog import Catalog

CHECKS: dict[str, Callable[[Catalog], DataFrame]] = {}


def check(f: Callable[[Catalog], DataFrame]):
    CHECKS[f.__name__] = f
    return f


def _missing(name: str, rows: str, other: str, keys: list[str]) -> None:
    CHECKS[name] = lambda c: checks.orphans(getattr(c, rows), getattr(c, other), keys)


def _unequal(name: str, rows: str, other: str, keys: list[str], columns: list[str]) -> None:
    CHECKS[name] = lambda c: checks.unmatched(getattr(c, rows), getattr(c, other), keys, columns)


# a projection has an assertion, and one that equals it, nulls equal to nulls
_missing("functions_without_assertions", "functions", "function_assertions", ["function_id"])
_unequal("function_projection_without_matching_assertion", "functions", "function_assertions", ["function_id", "program_id"], ["kind", "type_index", "module_id", "symbol_record_kind"])
_missing("function_names_without_assertions", "function_names", "function_name_assertions", ["name_id"])
_unequal("function_name_projection_without_matching_assertion", "function_names", "function_name_assertions", ["name_id"], ["is_primary", "provenance_id", "details_json"])
_missing("vtable_slots_without_assertions", "vtable_slots", "vtable_slot_assertions", ["vtable_id", "slot_index"])
_unequal("vtable_slot_projection_without_matching_assertion", "vtable_slots", "vtable_slot_assertions", ["vtable_id", "slot_index"], ["target_address_group_id", "unresolved_target_id", "declared_type_index", "provenance_id"])
_missing("hypothesis_sets_without_alternatives", "match_hypothesis_sets", "match_hypothesis_alternatives", ["hypothesis_set_id"])


@check
def xbox_functions_missing_signature(c):
    typed = c.functions.where("type_index IS NOT NULL").join(c.programs.where("platform = 'xbox360'"), "program_id", "left_semi")
    return checks.orphans(typed, c.function_signatures, ["function_id"])


@check
def signature_argument_count_mismatch(c):
    resolved = c.function_signatures.where("resolution_status = 'resolved'")
    return checks.count_mismatch(resolved, c.function_signature_arguments, "function_id", "argument_list_count")


@check
def unresolved_signature_has_arguments(c):
    return c.function_signatures.where("resolution_status <> 'resolved'").join(c.function_signature_arguments.select("function_id"), "function_id", "left_semi")


@check
def vtable_slot_indices_noncontiguous(c):
    return checks.not_contiguous(c.vtable_slots, ["vtable_id"], "slot_index")


@check
def variadic_signature_marker_mismatch(c):
    a = c.function_signature_arguments.groupBy("function_id").agg(F.sum("is_vararg_marker").alias("marks"), F.max(F.when(F.col("is_vararg_marker") == 1, F.col("position"))).alias("at"), F.max("position").alias("last"))
    j = c.function_signatures.where("resolution_status = 'resolved'").join(a, "function_id", "left")
    right = F.when(F.col("is_variadic") == 1, (F.col("marks") == 1) & (F.col("at") == F.col("last"))).otherwise(F.coalesce("marks", F.lit(0)) == 0)
    return j.where(~F.coalesce(right, F.lit(False)))


@check
def match_claims_without_evidence(c):
    sets = c.match_hypothesis_alternatives.join(c.match_hypothesis_evidence.select("hypothesis_set_id"), "hypothesis_set_id", "left_semi")
    alternatives = c.match_hypothesis_alternatives.join(c.match_hypothesis_alternative_evidence.select("alternative_id"), "alternative_id", "left_semi")
    held = c.claim_evidence.select("claim_id").unionByName(sets.select("claim_id")).unionByName(alternatives.select("claim_id"))
    return checks.orphans(c.match_claims, held, ["claim_id"])


@check
def hypothesis_sets_without_evidence(c):
    alternatives = c.match_hypothesis_alternatives.join(c.match_hypothesis_alternative_evidence.select("alternative_id"), "alternative_id", "left_semi")
    held = c.match_hypothesis_evidence.select("hypothesis_set_id").unionByName(alternatives.select("hypothesis_set_id"))
    return checks.orphans(c.match_hypothesis_sets, held, ["hypothesis_set_id"])


@check
def fold_groups_with_fewer_than_two_members(c):
    n = c.fold_group_members.groupBy("fold_group_id").agg(F.count("*").alias("n"))
    return c.fold_groups.join(n, "fold_group_id", "left").where(F.coalesce("n", F.lit(0)) < 2)


@check
def claim_endpoints_not_exactly_one(c):
    return checks.not_exactly_one(c.match_claims, ["pc_function_id", "pc_target_id"]).unionByName(checks.not_exactly_one(c.match_claims, ["xbox_function_id", "xbox_target_id"]))


@check
def alternatives_not_exactly_one(c):
    return checks.not_exactly_one(c.match_hypothesis_alternatives, ["claim_id", "xbox_fold_group_id"])


@check
def slots_not_exactly_one_target(c):
    return checks.not_exactly_one(c.vtable_slots, ["target_address_group_id", "unresolved_target_id"])


@check
def decisions_not_exactly_one_target(c):
    return checks.not_exactly_one(c.review_decisions, ["hypothesis_set_id", "alternative_id", "claim_id"])


@check
def addresses_not_unique(c):
    return checks.duplicates(c.address_groups, ["program_id", "address_space", "address"])


@check
def claim_pc_endpoint_of_another_platform(c):
    f = c.functions.join(c.programs.where("platform <> 'pc'").select("program_id"), "program_id", "left_semi").select(F.col("function_id").alias("pc_function_id"))
    return c.match_claims.join(f, "pc_function_id", "left_semi")


@check
def resolved_target_at_another_address(c):
    t = c.unresolved_targets.where("status = 'resolved'")
    f = c.functions.select(F.col("function_id").alias("resolved_function_id"), "address_group_id")
    return checks.orphans(t, f, ["resolved_function_id", "address_group_id"])


@check
def platform_outside_domain(c):
    return checks.not_in_domain(c.programs, "platform", ("pc", "xbox360"))


@check
def review_action_outside_domain(c):
    return checks.not_in_domain(c.review_decisions, "action", ("accept", "reject", "defer", "reopen", "supersede"))


def violations(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """check, violations: a row for each check, in one job; all zero for a valid graph."""
    return checks.counted({n: CHECKS[n](catalog) for n in names or CHECKS})


# the modules name their checks when they are imported
from cairn.plans import validation_flow, validation_matching, validation_slots, validation_types  # noqa: E402, F401
