"""Observations of a source tree joined to an inventory of a program: entries, sections, and every extent around a point."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators import ranges


def checked_sections(sections: DataFrame) -> DataFrame:
    """Sections (section_name, start, end, executable) of one program; computing them fails if one is empty or two overlap.

    An image has tens of sections, so they may meet in one task.
    """
    w = Window.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("end").over(w), F.lit(0))
    bad = F.when(F.col("end") <= F.col("start"), F.raise_error(F.lit("sections must be increasing ranges"))).when(F.col("start") < reach, F.raise_error(F.lit("sections must not overlap")))
    return sections.withColumn("start", F.coalesce(bad.cast("long"), F.col("start")))


def _placed(observations: DataFrame, sections: DataFrame) -> DataFrame:
    own = checked_sections(sections).select("section_name", F.col("start").alias("_s"), F.col("end").alias("_e"), "executable")
    return ranges.around(observations, "address", own, "_s", "_e", "left").drop("_s", "_e")


def code_joins(observations: DataFrame, functions: DataFrame, sections: DataFrame) -> DataFrame:
    """Code observations (observation_id, program_variant, address, ...) with their classification, section and function.

    ``pc_function_id`` is a definite link, of the game's own variant; an
    observation without a variant has ``candidate_pc_function_id`` instead, and
    one of the editor neither.  A variant other than game, unspecified_pc and
    geck is an error.  functions: function_id, address.
    """
    known = F.when(F.col("program_variant").isin("game", "unspecified_pc", "geck"), F.col("program_variant")).otherwise(F.raise_error(F.concat(F.lit("unknown program variant "), F.coalesce("program_variant", F.lit("null")))))
    rows = observations.withColumn("program_variant", known).join(functions.select("function_id", "address"), "address", "left")
    rows = ranges.classify_code(_placed(rows, sections))
    link = lambda kind: F.when(F.col("link_kind") == kind, F.col("function_id"))
    return rows.withColumn("pc_function_id", link("definitive")).withColumn("candidate_pc_function_id", link("candidate")).drop("function_id", "link_kind")


def data_joins(observations: DataFrame, sections: DataFrame) -> DataFrame:
    """Data observations (observation_id, program_variant, address, ...) with their classification and section."""
    return ranges.classify_data(_placed(observations, sections))


def boundary_candidates(joined: DataFrame, functions: DataFrame) -> DataFrame:
    """Object-creation targets in executable code that are no entry, each with the entries of all functions around it, in order.

    joined: ``code_joins`` with evidence_kind.  functions: address, size; one of
    size zero is around nothing.  None, one or many may be: all are kept.
    """
    rows = joined.where((F.col("evidence_kind") == "create_object_macro") & F.col("classification").isin("pc_executable_non_entry", "pc_executable_non_entry_variant_unspecified"))
    extents = functions.where("size > 0").select(F.col("address").alias("_s"), (F.col("address") + F.col("size")).alias("_e"))
    found = ranges.around(rows.select("observation_id", "address").distinct(), "address", extents, "_s", "_e", "left")
    lists = found.groupBy("observation_id", "address").agg(F.array_sort(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_s", "_e")))).alias("x"))
    lists = lists.select("observation_id", "address", F.transform("x", lambda e: e["_s"]).alias("containing_function_entries"))
    return rows.join(lists, ["observation_id", "address"]).withColumn("candidate_reason", F.lit("sdk_create_object_target_is_executable_non_entry"))
