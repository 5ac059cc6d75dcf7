"""Named checks of what the matcher has recorded: candidates alone, evidence at its alternatives, and whole disjunctions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.derivations import POLICY
from cairn.plans.validation import check
from cairn.sources.catalog import COLUMNS

#: Tables in which the matcher may leave rows; every other table with provenance must have none of its.
OWN = ("match_hypothesis_sets", "match_claims", "unresolved_targets", "match_hypothesis_alternative_evidence", "provenance")


def _own(c, table: str) -> DataFrame:
    """Rows of a table that the matcher has made."""
    return getattr(c, table).join(c.provenance.where("producer LIKE '%.control_flow_matching'").select("provenance_id"), "provenance_id", "left_semi")


def _rows(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select(F.col(p.columns[0]).cast("string").alias("row_id")) for p in parts])


def _says(path: str, value: str) -> Column:
    return F.coalesce(F.get_json_object("details_json", f"$.{path}") == value, F.lit(False))


def _null(path: str) -> Column:
    """Whether the details have JSON's null there, and not nothing."""
    return F.coalesce(F.expr(f"is_variant_null(try_variant_get(try_parse_json(details_json), '$.{path}', 'variant'))"), F.lit(False))


@check
def control_flow_matching_provenance_leakage(c):
    tables = [t for t, columns in COLUMNS.items() if "provenance_id" in columns.split() and t not in OWN]
    return _rows(*[_own(c, t) for t in tables])


@check
def control_flow_matching_candidate_state_mismatch(c):
    sets = _own(c, "match_hypothesis_sets").where((F.col("status") != "candidate") | ~_says("candidate_only", "true") | ~_null("confidence") | ~_says("policy", POLICY))
    claims = _own(c, "match_claims").where((F.col("status") != "candidate") | F.col("confidence_label").isNotNull() | F.col("confidence_value").isNotNull() | ~_says("candidate_only", "true") | ~_null("confidence") | ~_says("name_transfer", "forbidden"))
    places = c.address_groups.select("address_group_id", "program_id", "address_space")
    used = c.match_hypothesis_alternatives.join(_own(c, "match_hypothesis_sets").select("hypothesis_set_id"), "hypothesis_set_id", "left_semi").select("claim_id")
    used = _own(c, "match_claims").join(used, "claim_id", "left_semi").select(F.col("xbox_target_id").alias("target_id")).distinct().withColumn("used", F.lit(True))
    targets = _own(c, "unresolved_targets").join(places, ["address_group_id", "program_id"], "left").join(c.programs.select("program_id", "platform"), "program_id", "left").join(used, "target_id", "left")
    fine = (F.col("target_kind") == "control_flow_address_only") & (F.col("status") == "open") & F.col("resolved_function_id").isNull() & F.col("name_hint").isNull() & (F.col("address_space") == "xbox-va") & (F.col("platform") == "xbox360")
    fine = F.coalesce(fine, F.lit(False)) & _says("candidate_only", "true") & _says("function_creation", "forbidden") & F.col("used").isNotNull()
    return _rows(sets.select("hypothesis_set_id"), claims.select("claim_id"), targets.where(~fine).select("target_id"))


@check
def control_flow_matching_evidence_scope_mismatch(c):
    own_sets = _own(c, "match_hypothesis_sets").select("hypothesis_set_id", F.lit(True).alias("own"))
    at = c.match_hypothesis_alternatives.select("alternative_id", "hypothesis_set_id").join(own_sets, "hypothesis_set_id")
    evidence = _own(c, "match_hypothesis_alternative_evidence").join(at, "alternative_id", "left")
    fine = F.col("own").isNotNull() & (F.col("effect") == "supports") & _says("conditional_evidence", "true") & _says("independent_confirmation", "false") & _says("acceptance_effect", "none")
    return _rows(_own(c, "claim_evidence").select("evidence_id"), _own(c, "match_hypothesis_evidence").select("evidence_id"), evidence.where(~fine).select("evidence_id"))


@check
def control_flow_matching_incomplete_alternatives(c):
    sets, claims = _own(c, "match_hypothesis_sets").select("hypothesis_set_id"), _own(c, "match_claims").select("claim_id")
    every = c.match_hypothesis_alternatives
    own = every.join(sets, "hypothesis_set_id", "left_semi")
    held = _own(c, "match_hypothesis_alternative_evidence").select("alternative_id").distinct().withColumn("held", F.lit(True))
    mine = claims.withColumn("mine", F.lit(True))
    bare = own.join(held, "alternative_id", "left").join(mine, "claim_id", "left").where("held IS NULL OR claim_id IS NOT NULL AND mine IS NULL")
    of = every.select("claim_id", "hypothesis_set_id").join(sets.withColumn("own", F.lit(1)), "hypothesis_set_id", "left")
    counts = claims.join(of, "claim_id", "left").groupBy("claim_id").agg(F.count("hypothesis_set_id").alias("n"), F.count("own").alias("m"))
    return _rows(sets.join(every, "hypothesis_set_id", "left_anti"), bare.select("alternative_id"), counts.where("n <> 1 OR m <> 1"))


@check
def control_flow_matching_disjunction_mismatch(c):
    """A set lists its alternatives, and the store has them: both as bags of rows, compared in one grouping."""
    sets = _own(c, "match_hypothesis_sets").select("hypothesis_set_id", "identity_key", "details_json", F.get_json_object("details_json", "$.kind").alias("kind"))
    listed = F.expr("try_variant_get(try_parse_json(details_json), '$.proposal_set.alternative_ids', 'array<string>')")
    sets = sets.withColumn("listed", listed)
    stored = c.match_hypothesis_alternatives.join(sets.select("hypothesis_set_id"), "hypothesis_set_id", "left_semi").select("hypothesis_set_id", "alternative_id", F.lit(0).alias("a"), F.lit(1).alias("b"))
    told = sets.select("hypothesis_set_id", F.explode("listed").alias("alternative_id"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    per = told.unionByName(stored).groupBy("hypothesis_set_id", "alternative_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    per = per.groupBy("hypothesis_set_id").agg(F.sum("b").alias("n"), F.bool_and((F.col("a") == 1) & (F.col("b") == 1)).alias("same"))
    j = sets.join(per, "hypothesis_set_id", "left")
    square = (F.col("kind") == "closed_call_square_relation") & (F.coalesce("n", F.lit(0)) == 1)
    named = F.col("identity_key").eqNullSafe(F.col("hypothesis_set_id")) & F.get_json_object("details_json", "$.proposal_set.proposal_set_id").eqNullSafe(F.col("hypothesis_set_id"))
    proposal = (F.col("kind") == "unique_residual_call_proposal") & named & F.col("listed").isNotNull() & F.coalesce("same", F.lit(True))
    return _rows(j.where(~F.coalesce(square | proposal, F.lit(False))).select("hypothesis_set_id"))
