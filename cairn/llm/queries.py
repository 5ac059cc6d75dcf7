"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import anchors, covertree, decontam, fingerprint, importance, langid, neardup, passages, pieces, pii, quality, sharding, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_multiset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compared(_table(spark, sf_dir, "documents"))


def op3_evidence_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified_tables(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


def op4_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.found(_table(spark, sf_dir, "documents"))


def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_token_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.digests(tokens.stored(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op8_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


def op9_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assigned(_table(spark, sf_dir, "documents"), sharding.SHARD_BYTES)


def op10_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(_table(spark, sf_dir, "documents"))


def op11_anchor_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anchors.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_cover_tree_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.compressed(_table(spark, sf_dir, "embeddings"))


def op13_prefix_crc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_cotraining": op1_cotraining,
    "op2_multiset_hash": op2_multiset_hash,
    "op3_evidence_fusion": op3_evidence_fusion,
    "op4_skip_chain": op4_skip_chain,
    "op5_hyperminhash": op5_hyperminhash,
    "op6_suffix_automaton": op6_suffix_automaton,
    "op7_token_lists": op7_token_lists,
    "op8_viterbi_pieces": op8_viterbi_pieces,
    "op9_extendible_hashing": op9_extendible_hashing,
    "op10_compact_windows": op10_compact_windows,
    "op11_anchor_points": op11_anchor_points,
    "op12_cover_tree_lloyd": op12_cover_tree_lloyd,
    "op13_prefix_crc": op13_prefix_crc,
}

# lower-case A to Z only
_FOLD = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_NEAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y ON x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 85 * (p.n + q.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM reach r JOIN links l ON l.a = r.a WHERE r.c < l.b),
low AS (SELECT a, min(c) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low.c AS component_id, d.doc_id = low.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN low ON low.a = d.doc_id
"""

_CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_FOLD}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dwin AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win))),
hits AS (SELECT doc_id, i, n, item_id FROM dwin JOIN win USING (n, k)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""

SQL: dict[str, str] = {
    "op5_hyperminhash": _NEAR,
    "op6_suffix_automaton": _CONTAMINATION,
    "op9_extendible_hashing": sharding.sql(),
    "op12_cover_tree_lloyd": covertree.sql(),
    "op13_prefix_crc": importance.SQL,
}
