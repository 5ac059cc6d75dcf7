"""Lookups: identities by address or name, with everything that stands at them, and no winner."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions.expr import joined, matches, reasons


def named(rows: DataFrame, columns: list[str], query: str, mode: str = "exact") -> DataFrame:
    """Rows of which one of the columns matches; each row once."""
    return rows.where(reduce(lambda a, b: a | b, [matches(F.col(c), query, mode) for c in columns]))


def arms(found: list[DataFrame]) -> DataFrame:
    """The distinct ids of several arms: an OR over keys as a union of equality lookups, which hash joins can serve."""
    return reduce(lambda a, b: a.unionByName(b), found).distinct()


def all_arms(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """Rows of several arms, each with the arm's name."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn("observation_kind", F.lit(name)) for name, df in found])


def names_in_order(names: DataFrame) -> DataFrame:
    """function_id and its names, primary first, then by kind and name."""
    one = F.struct((1 - F.col("is_primary")).alias("p"), "name_kind", "name")
    return names.groupBy("function_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["name"]), "|").alias("names"), F.count("*").alias("name_count"))


def signatures(functions: DataFrame, arguments: DataFrame) -> DataFrame:
    """Functions with their argument types in order; none is an empty list."""
    a = arguments.groupBy("function_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "rendered_type"))), lambda x: x["rendered_type"]), ", ").alias("rendered"), F.count("*").alias("argument_count"))
    out = functions.join(a, "function_id", "left")
    return out.select(*functions.columns, F.coalesce("rendered", F.lit("")).alias("rendered"), F.coalesce("argument_count", F.lit(0)).alias("argument_count"))


def ambiguity(groups: DataFrame) -> DataFrame:
    """``ambiguity``: why a group (member_count, has_fold, unresolved) stands for no single function."""
    why = reasons((F.col("member_count") > 1, "multiple_functions_at_address"), (F.col("has_fold"), "fold_group"), (F.col("unresolved"), "unresolved_target"))
    return groups.withColumn("ambiguity", why)


def intersection(flows: DataFrame, procedures: DataFrame, sites: DataFrame) -> DataFrame:
    """Flow uses of given procedures at given sites."""
    return flows.join(procedures, "procedure_id", "left_semi").join(sites, "site_id", "left_semi")


def role_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("role", "target_kind").agg(F.count("*").alias("use_count"), F.count_distinct("site_id").alias("site_count"))


def ambiguous_sets(sets: DataFrame, alternatives: DataFrame) -> DataFrame:
    """Sets with more than one alternative, or with a fold for one; the two are one grouped pass, not a correlated count."""
    a = alternatives.groupBy("hypothesis_set_id").agg(F.count("*").alias("alternative_count"), F.max("is_fold").alias("has_fold"))
    return sets.join(a, "hypothesis_set_id").where("alternative_count > 1 OR has_fold = 1")


def endpoints(claims: DataFrame, functions: DataFrame, targets: DataFrame) -> DataFrame:
    """Claims with their pc endpoint: a function, or else an unresolved target; one that is there may have no name."""
    there = F.lit(True)
    f = functions.select(F.col("function_id").alias("pc_function_id"), F.col("name").alias("f_name"), there.alias("f_there"))
    t = targets.select(F.col("target_id").alias("pc_target_id"), F.col("name_hint").alias("t_name"), there.alias("t_there"))
    j = claims.join(f, "pc_function_id", "left").join(t, "pc_target_id", "left")
    kind = F.when(F.col("f_there"), "function").when(F.col("t_there"), "unresolved_target").otherwise("missing")
    return j.select(*claims.columns, kind.alias("endpoint_kind"), F.when(F.col("f_there"), F.col("f_name")).otherwise(F.col("t_name")).alias("endpoint_name"))


def legacy_claims(channels: DataFrame) -> DataFrame:
    """(address, name) claims folded from evidence channels, with each effect's count and the independent groups that support it.

    channels: address, name, channel, effect, independence_group.
    """
    g = channels.groupBy("address", "name")
    return g.agg(*[F.count_if(F.col("effect") == e).alias(e) for e in ("supports", "contradicts", "context")], joined(F.collect_set(F.when(F.col("effect") == "supports", F.col("independence_group")))).alias("supporting_groups"))


def resolved_names(claims: DataFrame, functions: DataFrame) -> DataFrame:
    """Claimed names with the functions of that exact name: one is unique, several stay alternatives, none is one unresolved target a name."""
    n = functions.groupBy("name").agg(F.count("*").alias("function_count"), F.min("function_id").alias("first_function_id"))
    j = claims.select("address", "name").distinct().join(n, "name", "left").withColumn("function_count", F.coalesce("function_count", F.lit(0)))
    return j.withColumn("resolution", F.when(F.col("function_count") == 1, "unique").when(F.col("function_count") > 1, "ambiguous").otherwise("unresolved"))


def resolved_many(requests: DataFrame, types: DataFrame) -> DataFrame:
    """A row for every request, repeated ones too, with its type's rendering and status; a type without a rendering is there all the same."""
    j = requests.join(types.select("type_index", "rendered", F.lit(True).alias("_there")), "type_index", "left")
    return j.withColumn("status", F.when(F.col("_there"), "resolved").otherwise("missing_type_record")).drop("_there")


def candidate_report(units: list[tuple[str, DataFrame]], leaves: DataFrame, reviewer_id) -> DataFrame:
    """Claims, sets and alternatives as separate rows, each with one reviewer's current leaf if there is one."""
    parts = [df.withColumn("target_kind", F.lit(kind)) for kind, df in units]
    own = leaves.where(F.col("reviewer_id") == F.lit(reviewer_id)).select("target_id", "derived_status")
    return reduce(lambda a, b: a.unionByName(b), parts).join(own, "target_id", "left")
