"""Checks of stored bytes, in column functions; a value that can't be read so gives false, or null for a digest."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def little(value: Column, size: int) -> Column:
    """A number as ``size`` bytes, the lowest first; null outside its range."""
    text = F.lpad(F.hex(value.cast("bigint")), 2 * size, "0")
    turned = F.concat(*[F.substring(text, 2 * k + 1, 2) for k in reversed(range(size))])
    return F.when((value >= 0) & (value < 1 << (8 * size)), F.unhex(turned))


def record_digest(leaf: Column, body: Column) -> Column:
    """SHA-256 of a type record: its leaf kind as two bytes, and its body."""
    return F.sha2(F.concat(little(leaf, 2), body), 256)


def latin1(text: Column) -> Column:
    """A text as one byte a character; null if a character has no such byte."""
    return F.when(text.rlike(r"^[\x00-\xFF]*$"), F.encode(F.when(text.rlike(r"^[\x00-\xFF]*$"), text), "ISO-8859-1"))


def public_record_matches(raw: Column, length: Column, kind: Column, flags: Column, offset: Column, section: Column, name: Column) -> Column:
    """Whether a raw public-symbol record says what its decoded fields say, its name ended by a zero byte."""
    head = F.concat(little(length, 2), little(kind, 2), little(flags, 4), little(offset, 4), little(section, 2))
    text = F.hex(raw)
    told = F.concat(F.hex(head), F.hex(name), F.lit("00"))
    good = (F.length(raw) == length + 2) & (F.length(raw) >= 15) & text.startswith(told) & ~F.hex(name).rlike("^(..)*00")
    return F.coalesce(good, F.lit(False))


def big_endian_matches(raw: Column, value: Column, wide: bool = False) -> Column:
    """Whether four bytes, the highest first, are the number; with ``wide``, eight bytes are one that four can't hold."""
    narrow = (value >= 0) & (value < 1 << 32)
    word = lambda size: (F.length(raw) == size) & (F.hex(raw) == F.lpad(F.hex(value.cast("bigint")), 2 * size, "0"))
    return F.coalesce((narrow & word(4)) | (~narrow & word(8)) if wide else narrow & word(4), F.lit(False))


def casefold(text: Column) -> Column:
    """Unicode case folding, which lower-casing isn't for some letters."""

    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else t.casefold() for t in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def tree_digests(files: DataFrame, by: list[str]) -> DataFrame:
    """tree_sha256 of each group of files (relative_path, byte_length, sha256): the files in the order of their folded paths, each with its lengths before it.

    ``collisions`` counts paths that differ in case only: a group with one has
    no portable digest.  A tree is a list of files that one machine has
    scanned, so its digest is made in one row.
    """
    entry = F.concat(F.lpad(F.hex(F.octet_length("relative_path").cast("bigint")), 8, "0"), F.hex(F.encode("relative_path", "UTF-8")), F.lpad(F.hex(F.col("byte_length").cast("bigint")), 16, "0"), F.upper("sha256"))
    rows = files.select(*by, casefold(F.col("relative_path")).alias("_folded"), "relative_path", entry.alias("_entry"))
    g = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_folded", "relative_path", "_entry"))).alias("_r"), F.count("*").alias("file_count"), (F.count("*") - F.count_distinct("_folded")).alias("collisions"))
    text = F.array_join(F.transform("_r", lambda x: x["_entry"]), "")
    return g.select(*by, "file_count", "collisions", F.when(F.col("collisions") == 0, F.concat(F.lit("sha256:"), F.sha2(F.unhex(text), 256))).alias("tree_sha256"))
