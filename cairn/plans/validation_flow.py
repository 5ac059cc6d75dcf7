"""Named checks of control-flow extractions: sites, uses of sites in procedures, and scans of procedures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import checks
from cairn.operators.decode import CALL_RELEVANT
from cairn.plans.validation import check
from cairn.sources.staging import once

_ONE = ["extraction_id", "program_id"]


def _uses(c) -> DataFrame:
    """Use assertions with the use's procedure, function and site."""
    return once(c, "uses_of_sites", lambda: c.control_flow_use_assertions.join(c.control_flow_uses, ["use_id", "program_id"]))


def _summary(path: str, kind: str):
    return F.expr(f"from_json(get_json_object(details_json, '$.source_summary.{path}'), '{kind}')")


def _total(counts):
    return F.coalesce(F.aggregate(F.map_values(counts), F.lit(0).cast("long"), lambda a, b: a + F.coalesce(b, F.lit(0))), F.lit(0))


@check
def control_flow_source_summary_metadata_mismatch(c):
    said = lambda name: F.expr(f"try_cast(get_json_object(details_json, '$.source_summary.{name}') AS bigint)")
    good = (
        F.coalesce(F.expr("get_json_object(details_json, '$.source_summary') LIKE '{%'"), F.lit(False))
        & said("physical_sites").eqNullSafe(F.col("source_physical_site_count"))
        & said("logical_uses").eqNullSafe(F.col("source_logical_use_count"))
        & _total(_summary("use_roles", "map<string,bigint>")).eqNullSafe(F.col("source_logical_use_count"))
        & _total(_summary("scan_statuses", "map<string,bigint>")).eqNullSafe(F.col("procedure_scan_count"))
    )
    return c.control_flow_extractions.where(~good)


@check
def control_flow_metadata_row_count_mismatch(c):
    n = lambda df, name: df.groupBy("extraction_id").agg(F.count("*").alias(name))
    j = c.control_flow_extractions
    for df, name in ((c.control_flow_site_assertions, "sites"), (c.control_flow_use_assertions, "uses"), (c.control_flow_scans, "scans")):
        j = j.join(n(df, name), "extraction_id", "left")
    return j.where("coalesce(sites, 0) <> persisted_physical_site_count OR coalesce(uses, 0) <> persisted_logical_use_count OR coalesce(scans, 0) <> procedure_scan_count")


@check
def control_flow_policy_trigger_count_mismatch(c):
    roles = c.control_flow_use_assertions.groupBy("extraction_id").agg(F.count("*").alias("uses"), F.count_if(F.col("role").isin(*CALL_RELEVANT)).alias("triggers"))
    counts = _summary("use_roles", "map<string,bigint>")
    said = _total(F.map_filter(counts, lambda k, _: k.isin(*CALL_RELEVANT)))
    j = c.control_flow_extractions.join(roles, "extraction_id", "left").withColumn("said", said)
    relevant = "persistence_policy = 'call_relevant_v1' AND (coalesce(triggers, 0) <> triggering_logical_use_count OR said <> triggering_logical_use_count)"
    return j.where(f"({relevant}) OR (persistence_policy = 'all_branches_v1' AND (coalesce(uses, 0) <> triggering_logical_use_count OR triggering_logical_use_count <> source_logical_use_count))")


@check
def control_flow_sites_without_policy_trigger_use(c):
    own = c.control_flow_site_assertions.join(c.control_flow_extractions.where("persistence_policy = 'call_relevant_v1'").select("extraction_id"), "extraction_id", "left_semi")
    return checks.orphans(own, _uses(c).where(F.col("role").isin(*CALL_RELEVANT)), ["extraction_id", "site_id"])


@check
def control_flow_sites_without_any_use(c):
    return checks.orphans(c.control_flow_site_assertions, _uses(c), ["extraction_id", "site_id"])


@check
def control_flow_uses_without_site_assertion(c):
    return checks.orphans(_uses(c), c.control_flow_site_assertions, [*_ONE, "site_id"])


@check
def control_flow_uses_without_matching_scan(c):
    return checks.unlike(_uses(c), c.control_flow_scans, {k: k for k in (*_ONE, "procedure_record_id")}, ["function_id"])


@check
def control_flow_canonical_sites_without_assertions(c):
    return checks.orphans(c.control_flow_sites, c.control_flow_site_assertions, ["program_id", "site_id"])


@check
def control_flow_canonical_uses_without_assertions(c):
    return checks.orphans(c.control_flow_uses, c.control_flow_use_assertions, ["program_id", "use_id"])


@check
def control_flow_scan_use_count_mismatch(c):
    n = _uses(c).groupBy(*_ONE, "procedure_record_id").agg(F.count("*").alias("uses"))
    return c.control_flow_scans.join(n, [*_ONE, "procedure_record_id"], "left").where("persisted_branch_use_count <> coalesce(uses, 0)")


def _addresses(c, key: str, name: str) -> DataFrame:
    """Address groups under another key, their space and address prefixed."""
    return c.address_groups.select("program_id", F.col("address_group_id").alias(key), F.col("address_space").alias(f"{name}_space"), F.col("address").alias(f"{name}_address"))


@check
def control_flow_use_outside_scan_extent(c):
    sites = c.control_flow_sites.join(_addresses(c, "address_group_id", "site"), ["program_id", "address_group_id"]).select("program_id", "site_id", "site_space", "site_address")
    scans = c.control_flow_scans.select(*_ONE, "procedure_record_id", "scan_address_group_id", "scanned_size").join(_addresses(c, "scan_address_group_id", "scan"), ["program_id", "scan_address_group_id"], "left")
    j = _uses(c).join(sites, ["program_id", "site_id"]).join(scans, [*_ONE, "procedure_record_id"])
    inside = "site_space = scan_space AND site_address >= scan_address AND site_address < scan_address + scanned_size"
    return j.where(f"scan_address IS NULL OR NOT ({inside})")


@check
def control_flow_scan_endpoint_mismatch(c):
    at = {"scan_address_group_id": "address_group_id"}
    own = c.control_flow_scans
    f = c.functions.withColumn("scan_address_group_id", F.col("address_group_id"))
    t = c.unresolved_targets.withColumn("scan_address_group_id", F.col("address_group_id"))
    arms = [
        checks.unlike(own.where("function_id IS NOT NULL"), f, {"function_id": "function_id", "program_id": "program_id"}, list(at)),
        checks.unlike(own.where("unresolved_target_id IS NOT NULL"), t, {"unresolved_target_id": "target_id", "program_id": "program_id"}, list(at)),
        own.where("(status = 'unresolved_va') <> (scan_address_group_id IS NULL)"),
    ]
    return checks.any_of(arms, "scan_id")


@check
def control_flow_raw_endpoint_mismatch(c):
    sites = c.control_flow_sites.join(_addresses(c, "address_group_id", "site"), ["program_id", "address_group_id"]).select("program_id", "site_id", "site_space", "site_address")
    j = c.control_flow_site_assertions.join(sites, ["program_id", "site_id"]).join(_addresses(c, "target_address_group_id", "to"), ["program_id", "target_address_group_id"], "left")
    indirect = "raw_target_va IS NOT NULL OR target_address_group_id IS NOT NULL OR target_function_id IS NOT NULL OR target_fold_group_id IS NOT NULL OR target_record_count <> 0"
    direct = "to_address IS NULL OR NOT (raw_target_va <=> to_address) OR site_space <> to_space"
    return j.where(f"raw_site_va <> site_address OR CASE WHEN target_kind = 'indirect' THEN {indirect} ELSE {direct} END")


def _targets(c, *kinds: str) -> DataFrame:
    """Site assertions of some kinds with ``at``, the functions at the target's address."""
    n = c.functions.groupBy("program_id", F.col("address_group_id").alias("target_address_group_id")).agg(F.count("*").alias("at"))
    rows = c.control_flow_site_assertions.where(F.col("target_kind").isin(*kinds))
    return rows.join(n, ["program_id", "target_address_group_id"], "left").withColumn("at", F.coalesce("at", F.lit(0)))


@check
def control_flow_unique_endpoint_cardinality_mismatch(c):
    own = _targets(c, "unique_procedure")
    f = c.functions.withColumn("target_address_group_id", F.col("address_group_id"))
    return checks.any_of([r.select("assertion_id") for r in (own.where("at <> 1 OR target_record_count <> 1"), checks.unlike(own, f, {"target_function_id": "function_id", "program_id": "program_id"}, ["target_address_group_id"]))], "assertion_id")


@check
def control_flow_fold_endpoint_cardinality_mismatch(c):
    members = c.fold_group_members.join(c.functions.select("function_id", "program_id", "address_group_id"), ["function_id", "program_id"], "left")
    folds = members.groupBy(F.col("fold_group_id").alias("target_fold_group_id"), "program_id").agg(F.count("function_id").alias("members"), F.min("address_group_id").alias("lo"), F.max("address_group_id").alias("hi"))
    j = _targets(c, "fold_group").join(folds, ["target_fold_group_id", "program_id"], "left")
    return j.where("at <= 1 OR NOT (at <=> target_record_count) OR NOT (members <=> target_record_count) OR NOT (lo <=> target_address_group_id) OR NOT (hi <=> target_address_group_id)")


@check
def control_flow_non_entry_endpoint_cardinality_mismatch(c):
    return _targets(c, "executable_non_entry", "outside_executable").where("at <> 0 OR target_function_id IS NOT NULL OR target_fold_group_id IS NOT NULL OR target_record_count <> 0")


@check
def control_flow_non_xbox_addressing(c):
    xbox = c.programs.where("platform = 'xbox360'")
    space = c.address_groups.where("address_space = 'xbox-va'")
    there = lambda rows, key, group: checks.orphans(rows, space.withColumnRenamed("address_group_id", group), [group, "program_id"]).select(key)
    uses = c.control_flow_uses.join(c.functions.select("function_id", "program_id", "address_group_id"), ["function_id", "program_id"], "left")
    arms = [checks.orphans(rows, xbox, ["program_id"]).select(key) for key, rows in (("extraction_id", c.control_flow_extractions), ("site_id", c.control_flow_sites), ("use_id", c.control_flow_uses))]
    arms += [there(c.control_flow_sites, "site_id", "address_group_id"), there(uses, "use_id", "address_group_id")]
    arms += [there(rows.where(f"{group} IS NOT NULL"), key, group) for rows, key, group in ((c.control_flow_site_assertions, "assertion_id", "target_address_group_id"), (c.control_flow_scans, "scan_id", "scan_address_group_id"))]
    return checks.any_of(arms, "row_id")


@check
def control_flow_scan_total_mismatch(c):
    n = c.control_flow_scans.groupBy("extraction_id").agg(F.sum("source_branch_use_count").alias("source"), F.sum("persisted_branch_use_count").alias("persisted"))
    return c.control_flow_extractions.join(n, "extraction_id", "left").where("coalesce(source, 0) <> source_logical_use_count OR coalesce(persisted, 0) <> persisted_logical_use_count")


def identity_tables(c) -> dict[str, DataFrame]:
    return {n: getattr(c, n) for n in ("function_assertions", "function_names", "function_name_assertions")}


def match_tables(c, *more: str) -> dict[str, DataFrame]:
    return {n: getattr(c, n) for n in ("match_claims", "match_hypothesis_sets", "claim_evidence", "match_hypothesis_evidence", *more)}


@check
def control_flow_provenance_created_function_or_name(c):
    return checks.written_by(identity_tables(c), c.control_flow_extractions)


@check
def control_flow_provenance_created_match_state(c):
    return checks.written_by(match_tables(c), c.control_flow_extractions)
