"""Pages: of a whole result, of each parent's children, and after a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 1000


def checked(limit: int, offset: int = 0) -> None:
    if isinstance(limit, bool) or not 1 <= limit <= MOST or offset < 0:
        raise ValueError(f"limit is from 1 to {MOST} and offset isn't negative")


def page(df: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """Rows offset + 1 to offset + limit in a total order, each with the total before paging and has_more."""
    checked(limit, offset)
    total = df.agg(F.count("*").alias("total")).scalar()
    rows = df.orderBy(*order).offset(offset).limit(limit)
    return rows.withColumn("total", total).withColumn("has_more", F.col("total") > offset + limit)


def page_per_parent(df: DataFrame, parent: list[str], order: list, limit: int, offset: int = 0) -> DataFrame:
    """The page of each parent, with the row's position and the parent's total.

    A rank filter on the window lets Spark keep only offset + limit rows of a
    group before the shuffle; totals are a grouped count of their own.
    """
    checked(limit, offset)
    totals = df.groupBy(*parent).agg(F.count("*").alias("total"))
    ranked = df.withColumn("position", F.row_number().over(Window.partitionBy(*parent).orderBy(*order)))
    ranked = ranked.where(F.col("position") <= offset + limit).where(F.col("position") > offset)
    return ranked.join(totals, parent)


def after(df: DataFrame, keys: list[tuple[str, object]], limit: int) -> DataFrame:
    """The next ``limit`` rows after a key, in the order of the key's columns."""
    checked(limit)
    later: Column = F.lit(False)
    equal: Column = F.lit(True)
    for name, value in keys:
        later = later | (equal & (F.col(name) > F.lit(value)))
        equal = equal & (F.col(name) == F.lit(value))
    return df.where(later).orderBy(*[n for n, _ in keys]).limit(limit)
