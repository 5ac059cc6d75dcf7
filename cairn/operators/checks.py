"""Violations: each check gives the rows that break a rule; a valid graph gives none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def orphans(rows: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a partner; partners that repeat are one before they are dealt."""
    return rows.join(other.select(*keys).distinct(), keys, "left_anti")


def unmatched(rows: DataFrame, other: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows that no row of ``other`` equals in all columns, nulls equal to nulls."""
    a, b = rows.alias("a"), other.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys + columns])
    return a.join(b, same, "left_anti")


def unlike(rows: DataFrame, parent: DataFrame, keys: dict[str, str], same: list[str]) -> DataFrame:
    """Rows whose parent (own key to the parent's) isn't there, or has another value in one of the columns, nulls equal to nulls."""
    p = parent.select(*[F.col(b).alias(f"_k{n}") for n, b in enumerate(keys.values())], *[F.col(c).alias(f"_s{n}") for n, c in enumerate(same)], F.lit(True).alias("_there"))
    on = [F.col(a) == F.col(f"_k{n}") for n, a in enumerate(keys)]
    equal = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_s{n}")) for n, c in enumerate(same)], F.coalesce("_there", F.lit(False)))
    return rows.join(p, on, "left").where(~equal).select(*rows.columns)


def any_of(arms: list[DataFrame], key: str) -> DataFrame:
    """The keys of rows that break one of several rules, once for each table row and arm's own key column."""
    return reduce(DataFrame.unionByName, [a.select(F.col(a.columns[0]).alias(key)) for a in arms]).distinct()


def written_by(tables: dict[str, DataFrame], producers: DataFrame) -> DataFrame:
    """table_name, provenance_id of rows of tables that given producers must not write to."""
    own = producers.select("provenance_id").distinct()
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("table_name"), "provenance_id").join(own, "provenance_id", "left_semi").select("table_name", "provenance_id") for name, df in tables.items()])


def broken_order(rows: DataFrame, by: list[str], ordinal: str) -> DataFrame:
    """Groups whose ordinals don't run from 0 to the number of rows less one."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.min(ordinal).alias("lo"), F.max(ordinal).alias("hi"))
    return g.where(~(F.col("lo").eqNullSafe(F.lit(0)) & F.col("hi").eqNullSafe(F.col("n") - 1))).select(*by)


def not_in(rows: DataFrame, other: DataFrame) -> DataFrame:
    """Distinct rows that ``other`` hasn't."""
    return rows.subtract(other)


def not_contiguous(rows: DataFrame, by: list[str], position: str) -> DataFrame:
    """Groups whose positions aren't 0 to n - 1, each once."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return g.where("lo <> 0 OR hi <> n - 1 OR d <> n")


def count_mismatch(parents: DataFrame, children: DataFrame, key: str, declared: str) -> DataFrame:
    """Parents whose declared number of children isn't the number there is."""
    n = children.groupBy(key).agg(F.count("*").alias("actual"))
    return parents.join(n, key, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).where(~F.col(declared).eqNullSafe(F.col("actual")))


def summary_mismatch(parents: DataFrame, children: DataFrame, key: str, declared: dict) -> DataFrame:
    """Parents of which one of several declared aggregates differs; ``declared``: column name to aggregate of the children."""
    g = children.groupBy(key).agg(*[c.alias(f"_{n}") for n, c in declared.items()])
    j = parents.join(g, key, "left")
    bad = reduce(lambda x, y: x | y, [~F.col(n).eqNullSafe(F.coalesce(f"_{n}", F.lit(0))) for n in declared])
    return j.where(bad).select(*parents.columns)


def ordinal_mismatch(rows: DataFrame, by: list[str], order: list, ordinal: str) -> DataFrame:
    """Rows whose ordinal isn't their place in the order, from 0."""
    w = Window.partitionBy(*by).orderBy(*order)
    return rows.withColumn("expected", F.row_number().over(w) - 1).where(F.col(ordinal) != F.col("expected"))


def outside_extent(rows: DataFrame, extents: DataFrame, key: str, at: str, start: str, size: str) -> DataFrame:
    """Rows not inside [start, start + size) of their key's extent, or without one."""
    inside = (F.col(at) >= F.col(start)) & (F.col(at) < F.col(start) + F.col(size))
    return rows.join(extents.select(key, start, size), key, "left").where(~F.coalesce(inside, F.lit(False)))


def leakage(tables: dict[str, DataFrame], producers: DataFrame) -> DataFrame:
    """Rows of tables that the given producers must not write to, counted by table."""
    parts = [df.join(producers.select("provenance_id"), "provenance_id", "left_semi").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that more than one row has."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def not_exactly_one(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of which not exactly one of the columns is set."""
    held = reduce(lambda x, y: x + y, [F.col(c).isNotNull().cast("int") for c in columns])
    return rows.where(held != 1)


def not_in_domain(rows: DataFrame, column: str, domain: tuple[str, ...]) -> DataFrame:
    """Rows with a value outside an enumeration; null is outside."""
    return rows.where(~F.coalesce(F.col(column).isin(*domain), F.lit(False)))


def id_format(rows: DataFrame, column: str, pattern: str, *parts: str) -> DataFrame:
    """Rows whose id isn't the format of their parts; a null id isn't."""
    return rows.where(~F.col(column).eqNullSafe(F.format_string(pattern, *[F.col(p) for p in parts])))


def cardinality(rows: DataFrame, address: str, functions: DataFrame, kind: str) -> DataFrame:
    """Rows whose kind (unique, fold, none) isn't what the number of functions at the address says."""
    n = functions.groupBy(F.col("address").alias(address)).agg(F.count("*").alias("at"))
    j = rows.join(n, address, "left").withColumn("at", F.coalesce("at", F.lit(0)))
    said = F.when(F.col("at") == 0, "none").when(F.col("at") == 1, "unique").otherwise("fold")
    return j.where(~F.col(kind).eqNullSafe(said))


def digest_mismatch(rows: DataFrame, body: str, digest: str) -> DataFrame:
    """Rows whose bytes haven't the stored SHA-256."""
    return rows.where(~F.sha2(F.col(body), 256).eqNullSafe(F.col(digest)))


def counted(checks: dict[str, DataFrame]) -> DataFrame:
    """check, violations: one row for each check."""
    parts = [df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("check"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)
