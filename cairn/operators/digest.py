"""A digest of a whole table that doesn't depend on how its rows are dealt."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.persist import unmistakable
from cairn.sources.staging import written

#: Rows that one leaf of the tree is meant to hold.
LEAF = 1024


def tree_digest(rows: DataFrame, columns: list[str], depth: int | None = None) -> DataFrame:
    """row_count and digest of a table, one row.

    Rows are told by the text of ``columns`` (nulls and lengths marked) and how
    often they occur.  A leaf holds the rows whose SHA-256 begins with the same
    ``depth`` hex digits, and its digest is that of their sorted digests; each
    level above has sixteen children a node.  So any change of any row changes
    the result, no partitioning does, and no task or driver sees more than a
    leaf.  A table that is ordered by a key among ``columns`` has its order told
    with its rows, as the key is what the order is made of.  ``depth`` is chosen
    by the number of rows if it isn't given.  An empty table has the digest of
    the empty text.
    """
    text = rows.groupBy(unmistakable(*[F.col(c) for c in columns]).alias("t")).agg(F.count("*").alias("n"))
    level = text.select(F.sha2("t", 256).alias("h"), "n")
    if depth is None:
        level = written(level, "rows")
        depth = max(0, math.ceil(math.log(max(level.count(), 1) / LEAF, 16)))
    level = level.groupBy(F.substring("h", 1, depth).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "h", "n"))), ","), 256).alias("d"))
    for k in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("p", 1, k).alias("p")).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "p", "d"))), ","), 256).alias("d"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("row_count"), F.coalesce(F.max("d"), F.sha2(F.lit(""), 256)).alias("digest"))
