"""Shards of bounded size by extendible hashing, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_of, written

#: Bits of a document's hash that the directory may use.
HASH_BITS = 60
#: Bits beyond the average depth that the first pass groups by.
FINE = 6


def hash_bits(docs: DataFrame) -> Column:
    """The first 60 bits of an MD5 of id and text: rows that differ part ways at some bit."""
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text_of(docs)))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(h: Column, depth) -> Column:
    return F.shiftright(h, F.lit(HASH_BITS) - depth) if isinstance(depth, Column) else F.shiftright(h, HASH_BITS - depth)


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Buckets (depth, prefix, bytes, n) for rows of (h, bytes): the shortest hash prefixes whose rows fit ``limit`` bytes.

    Sums are grouped by a fine prefix once and rolled up for every shorter
    depth.  A bucket that is oversized splits on another bit; the few that are
    at the finest depth still are split from the rows, a few bits more at each
    pass.  Rows that agree in all bits can't be told apart: their bucket keeps
    the full depth (see ``assigned``).
    """
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("t")).first()["t"]
    depth, at = 0, min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + FINE)
    found, over = None, None
    while True:
        part = rows if over is None else rows.withColumn("_p", _prefix(F.col("h"), depth - 1)).join(small(over), "_p", "left_semi")
        fine = part.groupBy(_prefix(F.col("h"), at).alias("p")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(at))).alias("depth"), "p", "bytes", "n")
        sums = written(levels.groupBy("depth", F.expr(f"shiftright(p, {at} - depth)").alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n")), "levels")
        fits = F.col("bytes") <= limit
        whole = sums.where(fits | (F.col("depth") == HASH_BITS) | (F.col("n") == 1))
        above = sums.where(~fits & (F.col("n") > 1)).select((F.col("depth") + 1).alias("depth"), F.explode(F.array(F.col("prefix") * 2, F.col("prefix") * 2 + 1)).alias("prefix"))
        # a bucket of the directory fits (or can't be split), and what it was split from does not
        first = F.col("depth") == depth
        own = whole.where(first).unionByName(whole.where(~first).join(above, ["depth", "prefix"], "left_semi"))
        own = written(own, "directory")
        found = own if found is None else found.unionByName(own)
        left = sums.where(~fits & (F.col("n") > 1) & (F.col("depth") == at)).select(F.col("prefix").alias("_p"))
        if at == HASH_BITS or left.isEmpty():
            return found.select("depth", "prefix", "bytes", "n")
        over, depth, at = written(left, "oversized"), at + 1, min(HASH_BITS, at + FINE)


def _placed(rows: DataFrame, buckets: DataFrame, limit: int) -> DataFrame:
    """``rows`` (h, bytes, place and others) with shard, depth, shard_bytes."""
    depths = sorted(r["depth"] for r in buckets.select("depth").distinct().collect())  # at most 61 numbers
    kind = rows.columns
    keyed = buckets.select(F.col("depth").alias("_d"), F.col("prefix").alias("_q"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("_n"))
    probe = rows.withColumn("_k", F.explode(F.array(*[F.struct(F.lit(d).alias("d"), _prefix(F.col("h"), d).alias("q")) for d in depths or [0]])))
    out = probe.select(*kind, F.col("_k.d").alias("_d"), F.col("_k.q").alias("_q")).join(small(keyed), ["_d", "_q"])
    bits = F.when(F.col("_d") == 0, F.lit("")).otherwise(F.lpad(F.conv(F.col("_q").cast("string"), 10, 2), F.col("_d"), F.lit("0")))
    out = out.withColumn("shard", bits).withColumnRenamed("_d", "depth")

    # rows that agree in all bits: dealt in runs, by their places in the table
    same = (F.col("shard_bytes") > limit) & (F.col("_n") > 1)
    equal = out.where(same).withColumn("_part", F.shiftright("place", 33))
    counts = equal.groupBy("shard", "_part").agg(F.count("*").alias("_c"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    equal = equal.withColumn("_i", F.row_number().over(Window.partitionBy("shard", "_part").orderBy("place")) - 1)
    equal = equal.join(counts.select("shard", "_part", before.alias("_before")), ["shard", "_part"])
    each = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    run = F.floor((F.col("_before") + F.col("_i")) / each)
    equal = equal.withColumn("shard_bytes", F.col("bytes") * F.least(each, F.col("_n") - run * each)).withColumn("shard", F.concat("shard", F.lit("/"), run.cast("string")))
    names = [*kind, "shard", "depth", "shard_bytes"]
    return out.where(~same).select(names).unionByName(equal.select(names))


def _hashed(docs: DataFrame, columns: list[str]) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return docs.select(*columns, hash_bits(docs).alias("h"), size.alias("bytes"), F.monotonically_increasing_id().alias("place"))


def assigned(docs: DataFrame, limit: int) -> DataFrame:
    """A shard for every row: doc_id, n_bytes, shard, depth, shard_bytes, fits.

    ``shard`` is the bucket's hash prefix as bits ("" for a directory of one
    bucket).  ``n_bytes`` is the text's size in UTF-8, none for a null text.  A
    shard is above ``limit`` (``fits`` is false) only if it holds one row
    larger than that.  Rows that repeat id and text have one hash; if their
    bucket is oversized it is dealt in runs "/0", "/1" and so on that fit.
    Other columns are ignored.  An empty table has no shards.
    """
    rows = written(_hashed(docs, ["doc_id"]), "hashes")
    out = _placed(rows, directory(rows, limit), limit)
    return out.select("doc_id", F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits"))


def write_shards(docs: DataFrame, limit: int, path: str) -> str:
    """Write the rows of ``docs``, all columns, into one folder for each shard, <name>=b<bits>, and return the name: shard, or with underscores after it if ``docs`` has that.

    Null, empty and long texts, and rows that repeat, are dealt as by
    ``assigned``; an empty table writes no folder.  The rows are written once
    with their places, so that a lost executor can't number them anew.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = written(docs.select(F.struct("*").alias("row"), hash_bits(docs).alias("h"), size.alias("bytes"), F.monotonically_increasing_id().alias("place")), "hashes")
    out = _placed(rows, directory(rows.select("h", "bytes"), limit), limit).select(F.concat(F.lit("b"), "shard").alias(name), *[F.col("row")[c].alias(c) for c in docs.columns])
    out.repartition(name).write.partitionBy(name).parquet(path)
    return name


#: The limit of the registered query.
SHARD_BYTES = 1 << 20


def sql(limit: int = SHARD_BYTES) -> str:
    """The rows of ``assigned`` in DuckDB, for tables without rows that repeat id and text."""
    return f"""
WITH rows AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) AS BIGINT) AS n_bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
levels AS (
  SELECT d AS depth, h >> (60 - d) AS prefix, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes, count(*) AS n
  FROM rows, (SELECT unnest(range(0, 41)) AS d) GROUP BY ALL),
whole AS (SELECT * FROM levels WHERE shard_bytes <= {limit} OR n = 1),
directory AS (
  SELECT w.* FROM whole w LEFT JOIN whole p ON p.depth = w.depth - 1 AND p.prefix = w.prefix >> 1 WHERE p.depth IS NULL)
SELECT r.doc_id, r.n_bytes,
       CASE WHEN d.depth = 0 THEN '' ELSE lpad(bin(d.prefix), CAST(d.depth AS INTEGER), '0') END AS shard,
       CAST(d.depth AS INTEGER) AS depth, d.shard_bytes, d.shard_bytes <= {limit} AS fits
FROM rows r JOIN directory d ON r.h >> (60 - d.depth) = d.prefix
"""
