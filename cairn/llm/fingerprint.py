"""Homomorphic multiset fingerprints of documents, in DataFrame functions only.

A text is a multiset of paragraphs.  Each paragraph is hashed to a wide vector,
and the vectors are summed lane by lane modulo powers of two:

* 16 lanes of uniform 32-bit values, from eight hashes of the paragraph with
  seeds of their own: equal multisets have equal sums, others differ but for a
  chance of about 2**-512 (xxhash64 isn't meant to withstand an adversary);
* 64 lanes that each count the paragraphs with one bit of their hash set.
  Twice the count less the number of paragraphs is a sum of random signs, so
  the squared difference of two texts' sums estimates how many paragraphs they
  don't share.

Sums do not depend on order, and a paragraph is put in or taken out by adding
or subtracting its vector.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Pairs of 32-bit lanes; each comes from one 64-bit hash.
WIDE = 8
#: Sign lanes, two in each long: lane j in its low half, lane j + 32 in its high half.
SIGNS = 64
_HALF = 0xFFFFFFFF
_ONES = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    """Lines, cut at sentence ends as well, so that a text of one long line has parts; without empty ones."""
    return F.filter(F.split(text, r"\n+|(?<=[.!?]) +"), lambda p: p != "")


def vector(p: Column) -> Column:
    """The lanes of a paragraph: its count (1), the wide lanes, the packed signs."""
    wide = [x for k in range(WIDE) for w in [F.xxhash64(F.lit(k), p)] for x in (w.bitwiseAND(F.lit(_HALF)), F.shiftrightunsigned(w, 32))]
    h = F.xxhash64(p)
    return F.array(F.lit(1).cast("long"), *wide, *[F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_ONES)) for j in range(SIGNS // 2)])


def _added(a: Column, b: Column, sign: int = 1) -> Column:
    """Lane-wise sum or difference, each 32-bit half modulo 2**32."""

    def lane(x: Column, y: Column) -> Column:
        y = y if sign > 0 else F.lit(0) - y
        return x + y

    return F.zip_with(a, b, lane)


def _reduced(lanes: Column) -> Column:
    wide = F.transform(F.slice(lanes, 1, 1 + 2 * WIDE), lambda x: x.bitwiseAND(F.lit(_HALF)))
    return F.concat(wide, F.slice(lanes, 2 + 2 * WIDE, SIGNS // 2))


def lanes(text: Column) -> Column:
    """The sums of a text's paragraphs, as an array of longs."""
    zero = F.array_repeat(F.lit(0).cast("long"), 1 + 2 * WIDE + SIGNS // 2)
    return _reduced(F.aggregate(paragraphs(text), zero, lambda acc, p: _added(acc, vector(p))))


def inserted(lanes_of: Column, paragraph: Column) -> Column:
    """The sums after one more paragraph."""
    return _reduced(_added(lanes_of, vector(paragraph)))


def deleted(lanes_of: Column, paragraph: Column) -> Column:
    """The sums after taking out a paragraph that the text has."""
    return _reduced(_added(lanes_of, vector(paragraph), -1))


def merged(a: Column, b: Column) -> Column:
    """The sums of two texts together."""
    return _reduced(_added(a, b))


def rendered(lanes_of: Column) -> Column:
    """Lowercase hex of all lanes."""
    return F.lower(F.array_join(F.transform(lanes_of, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """Share of paragraphs in common (twice the common ones by all), estimated from the sign lanes: 1 for equal sums, between 0 and 1."""
    at = 1 + 2 * WIDE

    def halves(v: Column, k: Column) -> tuple[Column, Column]:
        x, n = F.get(v, k), F.get(v, F.lit(0))
        return x.bitwiseAND(F.lit(_HALF)) * 2 - n, F.shiftrightunsigned(x, 32) * 2 - n

    def step(acc: Column, k: Column) -> Column:
        (p, q), (r, s) = halves(a, k), halves(b, k)
        square = lambda x: x.cast("double") * x.cast("double")
        return F.struct((acc["d"] + square(p - r) + square(q - s)).alias("d"), (acc["t"] + square(p) + square(q) + square(r) + square(s)).alias("t"))

    total = F.aggregate(F.sequence(F.lit(at), F.lit(at + SIGNS // 2 - 1)), F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("t")), step, lambda acc: F.when(acc["t"] == 0, F.lit(1.0)).otherwise(1 - acc["d"] / acc["t"]))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)))


def _bounds(docs: DataFrame, buckets: int) -> list[int]:
    """Ids, all of them in the table, that cut it into about equal ranges; the last is the largest."""
    at = [k / buckets for k in range(1, buckets + 1)]
    found = docs.agg(F.percentile_approx("doc_id", F.array(*[F.lit(x) for x in at]), F.lit(10_000)).alias("b"), F.max("doc_id").alias("m")).first()
    return sorted({*(found["b"] or []), *([] if found["m"] is None else [found["m"]])})


def with_next(rows: DataFrame, columns: list[str], tie: list[str]) -> DataFrame:
    """``rows`` with next_<c> for each of ``columns``: that of the row that follows in descending doc_id order; after the last comes the first.

    Ranges of ids are ordered apart.  The first row of each range is also sent,
    as a visitor, to the range before, where it stands last; so no task sees
    more than its range.  Rows of one id are in the order of ``tie``.  A null
    id has no place in the order: nothing follows it, next_<c> is null.
    """
    spark = rows.sparkSession
    lost = rows.where("doc_id IS NULL").select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(f"next_{c}") for c in columns])
    rows = rows.where("doc_id IS NOT NULL")
    bounds = _bounds(rows, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    count = len(bounds)
    if not count:
        bounds, count = [0], 1
    table = F.array(*[F.lit(b).cast("long") for b in bounds])
    steps = [1 << k for k in reversed(range(count.bit_length()))]
    below = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: F.when((at + s <= count) & (F.get(table, at + s - 1) < F.col("doc_id")), at + s).otherwise(at))
    at = F.least(below, F.lit(count - 1))
    place = F.struct(at.alias("range"), F.lit(0).alias("visitor"))
    visit = F.when(F.get(table, at) == F.col("doc_id"), F.struct(((at + 1) % count).alias("range"), F.lit(1).alias("visitor")))
    spread = rows.withColumn("_at", F.explode(F.filter(F.array(place, visit), lambda x: x.isNotNull())))
    order = Window.partitionBy("_at.range").orderBy(F.col("_at.visitor"), F.col("doc_id").desc(), *tie)
    out = spread.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where("_at.visitor = 0").drop("_at").unionByName(lost)


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they are.

    Edited: the last floor(n / 3) characters replaced by the first as many (or
    all) of the next document's, in descending doc_id order; after the last
    comes the first.  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    A null text counts as empty; texts without paragraphs have equal
    fingerprints.  Rows of one id follow each other by text.  After a row with
    a null id comes an empty text.  An empty table gives none; other columns are
    ignored.  One shuffle, by ranges of ids.
    """
    rows = docs.select("doc_id", text_of(docs).alias("text")).withColumn("lanes", lanes(F.col("text")))
    rows = with_next(rows, ["text", "lanes"], ["text"])
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - k), F.coalesce(F.col("next_text"), F.lit("")).substr(F.lit(1), k))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "lanes", F.coalesce("next_lanes", lanes(F.lit(""))).alias("next_lanes"))
    rows = rows.withColumn("edited_lanes", lanes(F.col("edited")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        rendered(F.col("lanes")).alias("fingerprint"),
        rendered(F.col("edited_lanes")).alias("edited_fingerprint"),
        likeness(F.col("lanes"), F.col("edited_lanes")).alias("near_edited"),
        likeness(F.col("lanes"), F.col("next_lanes")).alias("near_next"),
    )
