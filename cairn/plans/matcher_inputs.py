"""What the matcher starts from: mapping alternatives, calls and flows of a catalog, with their endpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.catalog import Catalog


def _endpoint(kind: Column, identity: Column, group: Column | None = None) -> Column:
    return F.struct(kind.alias("endpoint_kind"), identity.alias("identity"), (F.lit(None).cast("string") if group is None else group).alias("address_group_id"))


def _either(function: Column, target: Column, group: Column) -> Column:
    """The function where there is one, else the unresolved target, else null."""
    return F.when(function.isNotNull(), _endpoint(F.lit("function"), function)).when(target.isNotNull(), _endpoint(F.lit("unresolved_target"), target, group))


def mapping_alternatives(c: Catalog, own: str) -> DataFrame:
    """alternative_id, hypothesis_set_id, claim_id, pc and xbox endpoints, provenance_id, status and problem of every alternative.

    ``status`` is candidate only if set and claim are; what the producer
    ``own``, the matcher itself, has derived is never a seed.  ``problem``
    names what a loader must refuse: another pc endpoint in the claim than in
    the set, or no Xbox endpoint.
    """
    targets = c.unresolved_targets.select("target_id", F.col("address_group_id").alias("group"))
    at = lambda key: targets.select(F.col("target_id").alias(key), F.col("group").alias(f"{key}_group"))
    sets = c.match_hypothesis_sets.select("hypothesis_set_id", "pc_function_id", "pc_target_id", F.col("status").alias("set_status"), "provenance_id")
    claims = c.match_claims.select("claim_id", F.col("pc_function_id").alias("claim_pc_function_id"), F.col("pc_target_id").alias("claim_pc_target_id"), "xbox_function_id", "xbox_target_id", F.col("status").alias("claim_status"))
    j = c.match_hypothesis_alternatives.join(sets, "hypothesis_set_id").join(c.provenance.select("provenance_id", "producer"), "provenance_id").join(claims, "claim_id", "left")
    j = j.join(at("pc_target_id"), "pc_target_id", "left").join(at("xbox_target_id"), "xbox_target_id", "left")
    scalar = F.col("claim_id").isNotNull()
    fold = F.when(F.col("xbox_fold_group_id").isNotNull(), _endpoint(F.lit("fold_group"), F.col("xbox_fold_group_id")))
    xbox = F.when(scalar, _either(F.col("xbox_function_id"), F.col("xbox_target_id"), F.col("xbox_target_id_group"))).otherwise(fold)
    both = F.concat(F.lit("hypothesis:"), F.col("set_status"), F.when(F.col("claim_status").isNotNull(), F.concat(F.lit("|claim:"), F.col("claim_status"))).otherwise(F.lit("")))
    live = (F.col("set_status") == "candidate") & F.coalesce(F.col("claim_status") == "candidate", F.lit(True))
    status = F.when(F.col("producer") == own, "derived_non_seed").when(live, "candidate").otherwise(both)
    subject = F.when(F.col("pc_function_id").isNotNull(), F.col("claim_pc_function_id").eqNullSafe(F.col("pc_function_id"))).otherwise(F.col("claim_pc_target_id").eqNullSafe(F.col("pc_target_id")))
    problem = F.when(scalar & ~subject, "different_pc_endpoints").when(xbox.isNull(), "no_xbox_endpoint")
    return j.select("alternative_id", "hypothesis_set_id", "claim_id", _either(F.col("pc_function_id"), F.col("pc_target_id"), F.col("pc_target_id_group")).alias("pc"), xbox.alias("xbox"), "provenance_id", status.alias("status"), problem.alias("problem"))


def pc_calls(c: Catalog) -> DataFrame:
    """edge_id, caller_function_id, callee, edge_kind of the call edges of pc programs."""
    targets = c.unresolved_targets.select(F.col("target_id").alias("unresolved_target_id"), F.col("address_group_id").alias("group"))
    rows = c.call_edges.join(c.programs.where("platform = 'pc'").select("program_id"), "program_id", "left_semi").join(targets, "unresolved_target_id", "left")
    return rows.select("edge_id", "caller_function_id", _either(F.col("callee_function_id"), F.col("unresolved_target_id"), F.col("group")).alias("callee"), "edge_kind")


def xbox_flows(c: Catalog) -> DataFrame:
    """Uses of sites with what the same extraction says of the site's target, of Xbox programs: one row for each use assertion.

    Without an address group an address-only target can't be named: its
    identity is null, which a loader must refuse.
    """
    one = ["extraction_id", "program_id"]
    uses = c.control_flow_use_assertions.withColumnRenamed("assertion_id", "use_assertion_id").join(c.control_flow_uses, ["use_id", "program_id"])
    seen = c.control_flow_site_assertions.withColumnRenamed("assertion_id", "site_assertion_id").drop("raw_site_va", "raw_target_va", "target_record_count")
    groups = c.address_groups.select("program_id", "address_group_id", F.col("address_space").alias("site_space"), F.col("address").alias("site_address"))
    sites = c.control_flow_sites.join(groups, ["program_id", "address_group_id"]).select("program_id", "site_id", "site_space", "site_address")
    rows = uses.join(seen, [*one, "site_id"]).join(sites, ["program_id", "site_id"]).join(c.control_flow_extractions.select(*one, "provenance_id"), one)
    rows = rows.join(c.programs.where("platform = 'xbox360'").select("program_id"), "program_id", "left_semi")
    kind = F.col("target_kind")
    target = F.when(kind == "unique_procedure", _endpoint(F.lit("function"), F.col("target_function_id"))).when(kind == "fold_group", _endpoint(F.lit("fold_group"), F.col("target_fold_group_id")))
    target = target.when(kind == "indirect", _endpoint(F.lit("indirect"), F.concat(F.lit("indirect:"), F.col("site_assertion_id")))).otherwise(_endpoint(F.lit("address_only"), F.col("target_address_group_id"), F.col("target_address_group_id")))
    return rows.select("use_assertion_id", "extraction_id", "use_id", "site_id", "site_assertion_id", F.col("function_id").alias("caller_function_id"), "procedure_record_id", "role", "site_space", "site_address", "target_kind", target.alias("target"), "provenance_id")


def fold_members(c: Catalog) -> DataFrame:
    """fold_group_id, function_id of Xbox folds."""
    folds = c.fold_groups.join(c.programs.where("platform = 'xbox360'").select("program_id"), "program_id", "left_semi")
    return c.fold_group_members.join(folds.select("fold_group_id"), "fold_group_id", "left_semi").select("fold_group_id", "function_id")
