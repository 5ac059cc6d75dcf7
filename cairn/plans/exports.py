"""From a catalog to an export plan: a reviewer's accepted leaves, their endpoints, names and provenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import persist
from cairn.sources.catalog import Catalog


def leaves(c: Catalog) -> DataFrame:
    """Decisions that no other one follows."""
    d = c.review_decisions
    return d.join(d.where("previous_decision_id IS NOT NULL").select(F.col("previous_decision_id").alias("decision_id")), "decision_id", "left_anti")


def accepted_leaves(c: Catalog, reviewer: str, release: str) -> DataFrame:
    """One reviewer's accepted leaves of one release with their set, alternative and claim, where there are such."""
    d = leaves(c).where((F.col("reviewer_id") == reviewer) & F.col("review_release_id").eqNullSafe(F.lit(release)) & (F.col("action") == "accept"))
    kind = F.when(F.col("hypothesis_set_id").isNotNull(), "hypothesis_set").when(F.col("alternative_id").isNotNull(), "alternative").otherwise("claim")
    d = d.select("decision_id", kind.alias("target_kind"), F.col("hypothesis_set_id").alias("own_set"), "alternative_id", F.col("claim_id").alias("own_claim"))
    a = c.match_hypothesis_alternatives.select("alternative_id", F.col("hypothesis_set_id").alias("its_set"), F.col("claim_id").alias("its_claim"), "xbox_fold_group_id")
    sets = c.match_hypothesis_sets.select("hypothesis_set_id", F.col("pc_function_id").alias("set_pc_function_id"), F.col("provenance_id").alias("set_provenance_id"))
    claims = c.match_claims.select("claim_id", "pc_function_id", "xbox_function_id", F.col("provenance_id").alias("claim_provenance_id"))
    j = d.join(a, "alternative_id", "left").withColumn("hypothesis_set_id", F.coalesce("own_set", "its_set")).withColumn("_claim", F.coalesce("own_claim", "its_claim"))
    return j.join(sets, "hypothesis_set_id", "left").join(claims.withColumn("_claim", F.col("claim_id")), "_claim", "left").drop("_claim", "own_set", "its_set", "own_claim", "its_claim")


def components(c: Catalog, rows: DataFrame) -> DataFrame:
    """target_id, component_kind, manifest_id: the manifests behind each part of a leaf; a part without provenance has a null one."""
    made = c.provenance.select("provenance_id", "manifest_id")
    of_function = c.function_assertions.select("function_id", "provenance_id").join(made, "provenance_id").select("function_id", "manifest_id")
    primary = c.function_names.where("is_primary = 1").select("name_id", "function_id")
    of_name = primary.join(c.function_name_assertions.where("is_primary = 1").select("name_id", "provenance_id"), "name_id").join(made, "provenance_id").select("function_id", "manifest_id")
    part = lambda kind, key, of, id_: rows.where(F.col(key).isNotNull()).select(F.col("decision_id").alias("target_id"), F.col(key).alias(id_)).join(of, id_, "left").select("target_id", F.lit(kind).alias("component_kind"), "manifest_id")
    subject = rows.withColumn("pc", F.when(F.col("claim_id").isNotNull(), F.col("pc_function_id")).otherwise(F.col("set_pc_function_id")))
    parts = [part("claim", "claim_provenance_id", made, "provenance_id"), part("hypothesis_set", "set_provenance_id", made, "provenance_id")]
    rows = subject
    parts += [part("pc_endpoint_function", "pc", of_function, "function_id"), part("xbox_endpoint_function", "xbox_function_id", of_function, "function_id"), part("xbox_primary_name", "xbox_function_id", of_name, "function_id")]
    return reduce(DataFrame.unionByName, parts)


def export_plan(c: Catalog, reviewer: str, release: str) -> DataFrame:
    """``persist.export_plan`` of one reviewer's accepted leaves; all parts must have provenance of the release's manifest."""
    required = c.review_releases.where(F.col("review_release_id") == release).select("manifest_id").first()  # one row, by key
    rows = accepted_leaves(c, reviewer, release)
    compatible = persist.lineage(components(c, rows), required["manifest_id"] if required else None).select(F.col("target_id").alias("decision_id"), F.col("compatible").alias("manifest_ok"))
    places = c.functions.join(c.address_groups.select("address_group_id", "address_space", "address"), "address_group_id", "left").join(c.programs.select("program_id", "platform"), "program_id", "left")
    pc = places.select(F.col("function_id").alias("_pc"), F.col("platform").alias("pc_platform"), F.col("program_id").alias("pc_program_id"), F.col("address_space").alias("pc_address_space"), F.col("address").alias("pc_address"))
    xbox = places.select(F.col("function_id").alias("xbox_function_id"), F.col("platform").alias("xbox_platform"))
    names = c.function_names.where("is_primary = 1").groupBy(F.col("function_id").alias("xbox_function_id")).agg(F.count_distinct("name").alias("name_count"), F.min("name").alias("name"))
    subject = F.when(F.col("claim_id").isNotNull() & ~((F.col("target_kind") == "hypothesis_set") | F.col("xbox_fold_group_id").isNotNull()), F.col("pc_function_id")).otherwise(F.col("set_pc_function_id"))
    j = rows.withColumn("_pc", subject).join(pc, "_pc", "left").join(xbox, "xbox_function_id", "left").join(names, "xbox_function_id", "left").join(compatible, "decision_id", "left")
    j = j.withColumn("name_count", F.coalesce("name_count", F.lit(0))).withColumn("manifest_ok", F.coalesce("manifest_ok", F.lit(False)))
    return persist.export_plan(j.drop("_pc", "set_provenance_id", "claim_provenance_id"))
