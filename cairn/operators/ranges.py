"""Interval containment without a nested loop."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def containing(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with every half-open range [start, end) that has them.

    Ranges are cut into bins of ``width``; a point meets only its own bin's, by
    equality, so the join shuffles or broadcasts like any other.  Choose the
    width near the usual range length: a range makes as many rows as it has
    bins.
    """
    binned = ranges.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)))).where(F.col(end) > F.col(start))
    at = points.withColumn("_bin", F.floor(F.col(point) / width))
    a, b = at.alias("a"), binned.alias("b")
    condition = (F.col("a._bin") == F.col("b._bin")) & (F.col(f"b.{start}") <= F.col(f"a.{point}")) & (F.col(f"a.{point}") < F.col(f"b.{end}"))
    return a.join(b, condition, how).drop("_bin")


#: Bits by which the bins of one level are wider than those of the level below.
STEP = 3


def around(points: DataFrame, point: str, ranges: DataFrame, start: str, end: str, how: str = "inner") -> DataFrame:
    """Points with every half-open range [start, end) that has them, whatever the ranges' lengths.

    Bins are a hierarchy: a range goes to the level whose bins are the first as
    wide as it is, where it has two bins at most, and a point looks into one
    bin of each level that occurs; points at one place look once.  So a range makes at most two rows however
    long it is, and nested and overlapping ones are all found.  An empty range
    has nothing.
    """
    some = ranges.where(F.col(end) > F.col(start)).withColumn("_level", F.ceil(F.when(F.col(end) - F.col(start) == 1, 0).otherwise(F.length(F.bin(F.col(end) - F.col(start) - 1))) / STEP).cast("int"))
    levels = sorted(r["_level"] for r in some.select("_level").distinct().collect())  # 22 at most
    bin_of = lambda at, level: F.expr(f"shiftright({at}, {STEP} * {level})")
    binned = some.withColumn("_bin", F.explode(F.array_distinct(F.array(bin_of(f"CAST({start} AS BIGINT)", "_level"), bin_of(f"CAST({end} AS BIGINT) - 1", "_level")))))
    probe = points.select(F.col(point).alias("_at")).where("_at IS NOT NULL").distinct().withColumn("_level", F.explode(F.array(*[F.lit(k) for k in levels or [0]])))
    probe = probe.withColumn("_bin", bin_of("CAST(_at AS BIGINT)", "_level"))
    found = probe.join(binned, ["_level", "_bin"]).where((F.col(start) <= F.col("_at")) & (F.col("_at") < F.col(end))).select("_at", *ranges.columns)
    return points.join(found, F.col(point) == F.col("_at"), how).drop("_at")


def overlaps(ranges: DataFrame, start: str, end: str, by: list[str], ties: list[str] = []) -> DataFrame:
    """Ranges that begin before an earlier one of their group ends; ``ties`` order those of equal start and end."""
    w = Window.partitionBy(*by).orderBy(start, end, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("_reach", F.max(end).over(w)).where(F.col(start) < F.col("_reach")).drop("_reach")


def classify_code(rows: DataFrame) -> DataFrame:
    """``classification`` of code observations (program_variant, function_id, section_name, executable), and the link they allow."""
    entry, inside = F.col("function_id").isNotNull(), F.col("section_name").isNotNull()
    game, loose = F.col("program_variant") == "game", F.col("program_variant") == "unspecified_pc"
    place = F.when(entry, "pc_function_entry").when(inside & F.col("executable"), "pc_executable_non_entry").when(inside, "pc_non_executable_section").otherwise("outside_pc_image_sections")
    kind = F.when(game, place).when(loose, F.concat(place, F.lit("_variant_unspecified"))).otherwise("non_game_variant")
    link = F.when(game & entry, "definitive").when(loose & entry, "candidate").otherwise("none")
    return rows.withColumn("classification", kind).withColumn("link_kind", link)


def classify_data(rows: DataFrame) -> DataFrame:
    """``classification`` of data observations (program_variant, section_name, executable)."""
    place = F.when(F.col("section_name").isNull(), "outside_pc_image_sections").when(F.col("executable"), "pc_executable_section").otherwise("pc_data_section")
    suffix = F.when(F.col("program_variant") == "game", "").otherwise("_variant_unspecified")
    return rows.withColumn("classification", F.when(F.col("program_variant") == "geck", "non_game_variant").otherwise(F.concat(place, suffix)))
