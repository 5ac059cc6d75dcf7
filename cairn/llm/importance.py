"""Documents drawn by importance towards a target: hashed word runs, whose CRCs come from the CRCs of prefixes."""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import ship, small, text_of, written

BUCKETS, SEED, RUN = 10_000, 2024, 1
#: Documents of fewer words aren't drawn; of the others this share of a hundred is.
LEAST_WORDS, DRAWN = 20, 10
#: The reflected polynomial of CRC-32: a fixed value.
POLYNOMIAL = 0xEDB88320


# --- CRCs of substrings


def _step(crc: np.ndarray) -> np.ndarray:
    """One zero bit more."""
    return crc >> np.uint32(1) ^ (crc & np.uint32(1)) * np.uint32(POLYNOMIAL)


def _tables() -> list[np.ndarray]:
    """For each k, what each byte of a CRC becomes when 2 ** k zero bytes follow: four tables of 256."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        basis = _step(basis)
    out = []
    for _ in range(31):
        byte = np.zeros((4, 256), np.uint32)
        for bit in range(32):
            byte[bit // 8] ^= np.where(np.arange(256) >> bit % 8 & 1, basis[bit], np.uint32(0)).astype(np.uint32)
        out.append(byte)
        basis = _apply(byte, basis)  # twice as many
    return out


def _apply(byte: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = byte[0][crc & np.uint32(255)]
    for k in range(1, 4):
        out = out ^ byte[k][crc >> np.uint32(8 * k) & np.uint32(255)]
    return out


_SHIFTS: list[np.ndarray] = []


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A prefix's part in the CRC of a text that goes on for ``length`` bytes: a product in GF(2)[x]."""
    if not _SHIFTS:
        _SHIFTS.extend(_tables())
    crc, k = crc.copy(), 0
    while len(length) and (length >> k).any():
        on = np.flatnonzero(length >> k & 1)
        crc[on] = _apply(_SHIFTS[k], crc[on])
        k += 1
    return crc


def prefixes(words: bytes, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The running CRC of each text at the start and at the end of each of its words, in one scan."""
    crc, run = zlib.crc32, 0
    at, out, before = starts.tolist(), np.empty(len(starts), np.uint32), np.zeros(len(starts), np.uint32)
    bounds = first.tolist()
    stops = ends.tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        run, was = 0, at[lo] if lo < hi else 0
        for k in range(lo, hi):
            run = crc(words[was : stops[k]], run)
            out[k], was = run, stops[k]
    inner = np.ones(len(starts), bool)
    inner[first[:-1][np.diff(first) > 0]] = False
    back = np.flatnonzero(inner)
    byte = _step8(~out[back - 1] ^ np.uint32(0x20))
    before[back] = ~byte  # the end of the word before, and a space
    return before, out


def _step8(crc: np.ndarray) -> np.ndarray:
    for _ in range(8):
        crc = _step(crc)
    return crc


def features(column, run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRCs of all runs of 1 to ``run`` words, the number of each text's first one (one more at the end), and the number of words of each text."""
    data, off = tx.raw(column)
    data = tx.LOWER[data]
    starts, ends, first = tx.spans(data, off, tx.ALNUM)
    inner = np.ones(len(starts), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False
    keep = tx.ALNUM[data]
    data[ends[inner]] = 0x20
    keep[ends[inner]] = True
    at = np.cumsum(keep)[starts] - 1 if len(starts) else starts
    length = ends - starts
    before, after = prefixes(data[keep].tobytes(), at, at + length, first)
    count = np.diff(first)
    text = np.repeat(np.arange(len(count)), count)
    left = np.repeat(first[1:], count) - np.arange(len(text))  # words from here to the text's end
    crcs, of = [], []
    for n in range(1, run + 1):
        i = np.flatnonzero(left >= n)
        j = i + n - 1
        crcs.append(after[j] ^ shifted(before[i], at[j] + length[j] - at[i]))
        of.append(text[i])
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return np.concatenate(crcs)[order], np.searchsorted(of[order], np.arange(len(count) + 1)), count


def bucketed(docs: DataFrame, key: str, run: int = RUN, buckets: int = BUCKETS) -> DataFrame:
    """id, n_words, items (the bucket of each feature, as 32-bit integers) of every row."""

    def work(batches):
        for batch in tx.slices(batches):
            crcs, start, words = features(batch.column(1), run)
            data = (crcs % np.uint32(buckets)).astype("<u4").tobytes()
            items = pa.array([data[4 * a : 4 * b] for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), items], names=["id", "n_words", "items"])

    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), text_of(docs).alias("text")).mapInArrow(work, "id long, n_words long, items binary")


def totals(items: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has: counted in the tasks, then summed; ``buckets`` numbers come to the driver."""

    def work(batches):
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.column(0):
                counts += np.bincount(np.frombuffer(row.as_buffer(), "<u4"), minlength=buckets) if row.is_valid else 0
        on = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(on.astype(np.int64)), pa.array(counts[on])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in items.select("items").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket says for the target, in thousandths, floored."""
    s, t, n = float(raw.sum()), float(target.sum()), len(raw)
    return np.array([math.floor(1000 * math.log((y + 1.0) * (s + n) / ((x + 1.0) * (t + n)))) for x, y in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def scored(items: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""

    def noise(i) -> int:
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))

    def work(batches):
        for batch in batches:
            n, weight = [], []
            for row in batch.column(2):
                at = np.frombuffer(row.as_buffer(), "<u4")
                n.append(len(at))
                weight.append(int(gain[at].sum()) // len(at) if len(at) else 0)
            score = [w + noise(i) for w, i in zip(weight, batch.column(0).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (n, weight, score))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])

    return items.select("id", "n_words", "items").mapInArrow(work, "doc_id long, n_words long, n_features long, weight long, score long")


def resampled(docs: DataFrame, target: DataFrame, run: int = RUN, buckets: int = BUCKETS, seed: int = SEED, least: int = LEAST_WORDS, drawn: int = DRAWN) -> DataFrame:
    """Draw documents whose hashed word runs are like the target's, without replacement (largest weight plus Gumbel noise).

    Returns doc_id, n_features, weight, score and rank (1, 2, 3 ... of the drawn,
    null for others) for every row of ``docs``; other columns are ignored.

    * A null or empty text, or one without words, has no features, weight zero,
      and isn't drawn.
    * Rows that repeat are drawn each for itself; ties go to the smaller
      doc_id, a null one last.  A null doc_id counts as empty text in the noise.
    * An empty target pulls towards features that are rare; an empty table
      gives none.  Long texts count whole.

    Plan.  The texts are scanned once: a row of bucket numbers a document is
    written.  Counts are summed in the tasks and then by bucket.  Scores are
    integers in a range that doubles bound (some 100,000 values), so ranks need
    no total sort: counts by score give each score's first rank, and rows of
    one score are numbered among themselves.
    """
    items = written(bucketed(docs, "doc_id", run, buckets), "buckets")
    mine = totals(items, buckets)
    theirs = totals(bucketed(target, "item_id", run, buckets), buckets)
    rows = written(scored(items, gains(mine, theirs), seed), "scores")
    able = rows.where(F.col("n_words") >= least)
    sizes = written(able.groupBy("score").agg(F.count("*").alias("n")), "sizes")
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.floor(F.lit(drawn) * F.sum("n").over(Window.partitionBy()) / 100)
    firsts = sizes.select("score", before.alias("_before"), take.alias("_take")).where("_before < _take")
    within = F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    some = able.join(small(firsts), "score").select("*", (F.col("_before") + within).cast("long").alias("rank")).select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= F.col("_take"), F.col("rank")).alias("rank"))
    never = rows.join(small(firsts.select("score", F.lit(True).alias("_in"))), "score", "left").where((F.col("n_words") < least) | F.col("_in").isNull())
    return some.unionByName(never.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def sample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, all columns of ``docs``; rows that repeat a doc_id come or stay away together."""
    drawn = written(resampled(docs, target, **options).where("rank IS NOT NULL").select("doc_id").distinct(), "drawn")
    return docs.join(small(drawn), "doc_id", "left_semi").select(docs.columns)


#: Lower-case A to Z only, and words, in DuckDB.
_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT {_WORDS} AS w FROM benchmark),
vocabulary AS (SELECT DISTINCT unnest(w) AS k FROM (SELECT w FROM d UNION ALL SELECT w FROM b)),
steps AS (SELECT i, list_reduce([CAST(i AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, {POLYNOMIAL}) ELSE c >> 1 END) AS v FROM range(256) t(i)),
bytes AS (SELECT k, hex(encode(k)) AS h FROM vocabulary),
crcs AS (
  SELECT k, xor(list_reduce([4294967295::BIGINT] || list_transform(range(len(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)),
                lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % {BUCKETS} AS bucket
  FROM bytes, (SELECT list(v ORDER BY i) AS t FROM steps)),
mine AS (SELECT doc_id, rid, bucket FROM (SELECT doc_id, rid, unnest(w) AS k FROM (SELECT *, row_number() OVER () AS rid FROM d)) JOIN crcs USING (k)),
s AS (SELECT bucket, count(*) AS s FROM mine GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM (SELECT unnest(w) AS k FROM b) JOIN crcs USING (k) GROUP BY 1),
sums AS (SELECT CAST((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS} AS DOUBLE) AS sn, CAST((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS} AS DOUBLE) AS tn),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * sn / ((s + 1.0::DOUBLE) * tn))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket), sums),
weights AS (SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM mine JOIN gains USING (bucket) GROUP BY 1),
scores AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT *, row_number() OVER () AS rid FROM d) LEFT JOIN weights USING (rid)),
ranks AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {LEAST_WORDS} ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER (PARTITION BY n_features >= {LEAST_WORDS}) AS n FROM scores)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= {LEAST_WORDS} AND r <= {DRAWN} * n // 100 THEN r END AS rank FROM ranks
"""
