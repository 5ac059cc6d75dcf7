"""Rules that a store keeps by triggers, as queries of the rows that break them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import checks


def signature_types(signatures: DataFrame, functions: DataFrame) -> DataFrame:
    """Signatures whose type isn't their function's, or whose function isn't there."""
    return checks.unlike(signatures, functions, {"function_id": "function_id", "program_id": "program_id"}, ["type_index"])


def argument_places(arguments: DataFrame, signatures: DataFrame) -> DataFrame:
    """Arguments that no resolved signature has room for, or variadic marks that aren't last."""
    s = signatures.select("function_id", "resolution_status", "argument_list_count")
    j = arguments.join(s, "function_id", "left")
    good = "resolution_status = 'resolved' AND position >= 0 AND position < argument_list_count AND (coalesce(is_vararg_marker, 0) = 0 OR position = argument_list_count - 1)"
    return j.where(~F.coalesce(F.expr(good), F.lit(False))).select(*arguments.columns)


def of_platform(rows: DataFrame, key: str, owners: DataFrame, owner: str, programs: DataFrame, platform: str) -> DataFrame:
    """Rows with a key whose owner is of another platform, or isn't there."""
    own = owners.join(programs.where(F.col("platform") == platform).select("program_id"), "program_id", "left_semi").select(F.col(owner).alias(key))
    return checks.orphans(rows.where(F.col(key).isNotNull()), own, [key])


def claim_platforms(claims: DataFrame, functions: DataFrame, targets: DataFrame, programs: DataFrame) -> DataFrame:
    """claim_id of claims of which an endpoint is on the wrong side."""
    ends = [("pc_function_id", functions, "function_id", "pc"), ("pc_target_id", targets, "target_id", "pc"), ("xbox_function_id", functions, "function_id", "xbox360"), ("xbox_target_id", targets, "target_id", "xbox360")]
    return checks.any_of([of_platform(claims, key, owners, owner, programs, side).select("claim_id") for key, owners, owner, side in ends], "claim_id")


def subject_platforms(sets: DataFrame, functions: DataFrame, targets: DataFrame, programs: DataFrame) -> DataFrame:
    """hypothesis_set_id of sets whose subject isn't a pc one."""
    ends = [("pc_function_id", functions, "function_id"), ("pc_target_id", targets, "target_id")]
    return checks.any_of([of_platform(sets, key, owners, owner, programs, "pc").select("hypothesis_set_id") for key, owners, owner in ends], "hypothesis_set_id")


def alternative_subjects(alternatives: DataFrame, sets: DataFrame, claims: DataFrame, folds: DataFrame, programs: DataFrame) -> DataFrame:
    """alternative_id of claims with another subject than their set's, nulls equal to nulls, and of folds that aren't Xbox ones."""
    subject = ["pc_function_id", "pc_target_id"]
    scalar = alternatives.where("claim_id IS NOT NULL").join(sets.select("hypothesis_set_id", *subject), "hypothesis_set_id", "left")
    fold = of_platform(alternatives, "xbox_fold_group_id", folds, "fold_group_id", programs, "xbox360")
    return checks.any_of([checks.unlike(scalar, claims, {"claim_id": "claim_id"}, subject).select("alternative_id"), fold.select("alternative_id")], "alternative_id")


def alignment_sides(alignments: DataFrame, tables: DataFrame, programs: DataFrame) -> DataFrame:
    """alignment_id of alignments that don't pair a pc table with an Xbox one."""
    arms = [of_platform(alignments, key, tables, "vtable_id", programs, side).select("alignment_id") for key, side in (("pc_vtable_id", "pc"), ("xbox_vtable_id", "xbox360"))]
    return checks.any_of(arms, "alignment_id")


def addresses_agree(rows: DataFrame, group: str, address: str, groups: DataFrame, space: str | None = None) -> DataFrame:
    """Rows whose address isn't that of their address group, or not within 32 bits, or of another space; without a group there must be none."""
    there = groups.where("address BETWEEN 0 AND 4294967295")
    if space:
        there = there.where(F.col("address_space") == space)
    there = there.withColumn(address, F.col("address"))
    both = rows.where(F.col(group).isNotNull())
    return checks.unlike(both, there, {group: "address_group_id"}, ["program_id", address]).unionByName(rows.where(F.col(group).isNull() & F.col(address).isNotNull()))


def frozen(old: DataFrame, new: DataFrame, key: str, columns: list[str], referenced: DataFrame | None = None) -> DataFrame:
    """Keys of old rows that a new version has changed in one of the columns, or has dropped; with ``referenced``, of the rows that something refers to."""
    rows = old if referenced is None else old.join(referenced.select(key).distinct(), key, "left_semi")
    n = new.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_there"))
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns], F.coalesce("_there", F.lit(False)))
    return rows.join(n, key, "left").where(~same).select(key)


def exclusive(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both of two tables have, of which a row may be in one only."""
    return left.select(key).distinct().join(right.select(key), key, "left_semi")
