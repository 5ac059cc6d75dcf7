"""Many counts in one scan a table: rows (metric, grp, n)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _rows(grouped: DataFrame, parts: list[tuple[str, Column, Column]]) -> DataFrame:
    """One row for each of a grouped row's parts (metric, group, number)."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), g.cast("string").alias("grp"), n.cast("long").alias("n")) for m, g, n in parts])
    return grouped.select(F.explode(each).alias("r")).select("r.metric", "r.grp", "r.n")


def counts(rows: DataFrame, measures: dict[str, Column], by: dict[str, Column] | None = None) -> DataFrame:
    """Sums of numbers or counts of conditions over a table, and counts by each of the ``by`` columns, from one partial aggregation.

    Rows are grouped by all of ``by`` together, which have to be columns of few
    values (states, kinds), so what leaves a task is a few rows.  A null
    measure counts nothing; a null value of ``by`` is the group ``null``.
    """
    by = by or {}
    number = {m: F.when(c, 1).otherwise(0) if _is_condition(rows, c) else c for m, c in measures.items()}
    keys = [c.alias(f"k{i}") for i, c in enumerate(by.values())]
    grouped = rows.groupBy(*keys).agg(F.count("*").alias("all"), *[F.coalesce(F.sum(c), F.lit(0)).alias(f"m{i}") for i, c in enumerate(number.values())])
    parts = [(m, F.lit(None), F.col(f"m{i}")) for i, m in enumerate(number)]
    parts += [(m, F.coalesce(F.col(f"k{i}").cast("string"), F.lit("null")), F.col("all")) for i, m in enumerate(by)]
    return _rows(grouped, parts)


def _is_condition(rows: DataFrame, c: Column) -> bool:
    return rows.select(c).dtypes[0][1] == "boolean"


def shared(rows: DataFrame, owner: str, key: str, total: str, unique: str, several: str) -> DataFrame:
    """Of each owner its rows and different keys, and over all owners the keys of several rows, from one scan.

    Rows are counted by key and owner first, so a key that a third of the rows
    have is one row a task; a key's owners (few: they are programs) are put
    together next.  A null key is no key of an owner, and one key if several
    rows lack it.
    """
    pairs = rows.groupBy(F.col(key).alias("key"), F.col(owner).alias("owner")).agg(F.count("*").alias("n"))
    keys = pairs.groupBy("key").agg(F.collect_list(F.struct("owner", "n")).alias("owners"), F.sum("n").alias("all"))
    name = F.coalesce(F.col("o.owner").cast("string"), F.lit("null"))
    each = keys.select("key", "all", F.posexplode("owners").alias("at", "o"))
    return _rows(
        each,
        [
            (total, name, F.col("o.n")),
            (unique, name, F.col("key").isNotNull().cast("long")),
            (several, F.lit(None), ((F.col("at") == 0) & (F.col("all") > 1)).cast("long")),
        ],
    )


def distinct(rows: DataFrame, key: str, measures: dict[str, Column], unique: str) -> DataFrame:
    """Sums over all rows and the number of different keys, nulls aside, from one scan."""
    grouped = rows.groupBy(F.col(key).alias("key")).agg(*[F.sum(F.when(c, 1).otherwise(0)).alias(f"m{i}") for i, c in enumerate(measures.values())])
    return _rows(grouped, [(m, F.lit(None), F.col(f"m{i}")) for i, m in enumerate(measures)] + [(unique, F.lit(None), F.col("key").isNotNull().cast("long"))])


def chains(decisions: DataFrame, status: Column, total: str, actions: str, current: str, statuses: str) -> DataFrame:
    """Decisions by action, and those without a successor by status, from one scan.

    A decision says its own id and its predecessor's; grouped by id, the ids
    that nobody follows are the current ones.  ``status`` is an expression
    over ``action``.
    """
    own = F.struct(F.col("decision_id").alias("id"), F.col("action"), F.lit(True).alias("own"))
    before = F.struct(F.col("previous_decision_id").alias("id"), F.lit(None).cast("string").alias("action"), F.lit(False).alias("own"))
    said = decisions.select(F.explode(F.array(own, before)).alias("r")).select("r.*").where("own OR id IS NOT NULL")
    ids = said.groupBy("id").agg(F.max("action").alias("action"), F.max("own").alias("own"), F.min("own").alias("last")).where("own")
    parts = ids.groupBy("action", "last").agg(F.count("*").alias("n"))
    last = F.when(F.col("last"), F.col("n")).otherwise(0)
    return _rows(parts, [(total, F.lit(None), F.col("n")), (actions, F.coalesce("action", F.lit("null")), F.col("n")), (current, F.lit(None), last), (statuses, F.coalesce(status, F.lit("null")), last)])


def summed(parts: list[DataFrame], metrics: list[str], kept: tuple[str, ...] = ()) -> DataFrame:
    """All parts as one table, a row for each metric and group; ``metrics`` have a row of zero where a table is empty, groups of zero have one only in the ``kept`` metrics."""
    spark = parts[0].sparkSession
    zero = spark.range(1).select(F.explode(F.array(*[F.lit(m) for m in metrics])).alias("metric"), F.lit(None).cast("string").alias("grp"), F.lit(0).cast("long").alias("n"))
    rows = reduce(DataFrame.unionByName, [*parts, zero])
    return rows.groupBy("metric", "grp").agg(F.sum("n").alias("n")).where(F.col("grp").isNull() | (F.col("n") > 0) | F.col("metric").isin(*kept))
