"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import hashlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import decontam, fingerprint, langid, neardup, passages, pieces, pii, quality, sharding, tokens

KIND = "doc_id long, text string, lang string, source string, n_chars long"
WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
LONG = "lorem ipsum dolor sit amet " * 4000
CLASH = ["n", "key", "a", "b", "h", "bytes", "place", "shard", "node", "hit", "items", "sig", "kept", "language", "accepted", "depth", "lanes", "edited", "quality", "toxic", "spans"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [
        (1, "The same text of a few words here", "en", "s", 33),
        (1, "The same text of a few words here", "en", "s", 33),
        (2, None, None, None, None),
        (3, "", "", "", 0),
        (4, " \n\t ", "en", "s", 4),
        (5, LONG, "en", "s", len(LONG)),
        (6, LONG, "en", "s", len(LONG)),
        (None, "no id at all in this row of words", "en", "s", 33),
        (7, "x" * 50_000, "fr", "t", 50_000),
        (8, "émoji 🙂 ünd mail a.b@example.com +1 (555) 555-0100", "de", "t", 50),
        (9, "1.2.3.4 4111 1111 1111 1111 " + "9" * 3000, "en", "t", 3028),
    ]
    df = spark.createDataFrame(rows, KIND)
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


def operators(spark):
    benchmark = spark.createDataFrame([(1, "same text of a few words"), (2, None), (3, ""), (1, "lorem ipsum dolor sit amet lorem ipsum dolor sit amet lorem")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 1), (None, 1, 1), (8, None, 1), (99, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    return {
        "quality": lambda d: quality.scored(d, labels),
        "fingerprint": fingerprint.compared,
        "language": lambda d: langid.identified(langid.of_documents(d), ["doc_id"]),
        "pii": pii.found,
        "neardup": neardup.near_duplicates,
        "decontam": lambda d: decontam.report(d, benchmark),
        "tokens": lambda d: tokens.digests(tokens.stored(d, WORD)),
        "pieces": lambda d: pieces.encoded(d, PIECE),
        "sharding": lambda d: sharding.assigned(d, 20_000),
        "passages": passages.passages,
    }


NAMES = ["quality", "fingerprint", "language", "pii", "neardup", "decontam", "tokens", "pieces", "sharding", "passages"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, odd, name):
    out = operators(spark)[name](odd).collect()
    assert len(out) == 11
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["1", "1", "2", "3", "4", "5", "6", "None", "7", "8", "9"])


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, odd, name):
    assert operators(spark)[name](odd.limit(0)).count() == 0


#: Names that the operators use inside, and results' names.
PRIVATE = ["row", "text_lang", "probability", "_text", "_declared", "_host", "_ll", "_hit", "hit", "clean", "_clean", "_hit_0", "component", "_at", "_p0", "same", "low", "high"]


def stages(spark):
    benchmark = spark.createDataFrame([(1, "same text of a few words"), (2, None), (3, "")], "item_id long, text string")
    many = spark.createDataFrame([(k, "same text of a few words" if k == 7 else f"other words {k} " * 6) for k in range(9)], "item_id long, text string")
    return {
        "language": langid.accepted_documents,
        "neardup": neardup.deduplicated,
        "decontam": lambda d: decontam.decontaminated(d, benchmark),
        "decontam in blocks": lambda d: decontam.decontaminated(d, many),
        "pii": pii.redacted,
    }


def as_rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.mark.parametrize("name", ["language", "neardup", "decontam", "decontam in blocks", "pii"])
def test_stages_leave_columns_alone(spark, odd, name, monkeypatch):
    """Whatever the other columns are called, their values go through, and the result is that of the plain columns."""
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 8)
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    wide = plain
    for c in [*CLASH, *PRIVATE]:
        wide = wide.withColumn(c, F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    out = stages(spark)[name](wide)
    assert out.columns == wide.columns
    for r in out.collect():
        assert all(r[c] == f"{c}:{'none' if r['doc_id'] is None else r['doc_id']}" for c in [*CLASH, *PRIVATE])
    assert as_rows(out.select(plain.columns)) == as_rows(stages(spark)[name](plain))
    assert stages(spark)[name](wide.limit(0)).count() == 0


def test_what_stages_change(spark, odd):
    out = {r["doc_id"]: r for r in stages(spark)["decontam in blocks"](odd).collect()}
    assert out[2]["text"] is None and out[3]["text"] == "" and out[5]["text"] == LONG and 1 not in out  # six of seven words are an item
    clean = {r["doc_id"]: r for r in pii.redacted(odd).collect()}
    assert clean[8]["text"] == "émoji 🙂 ünd mail [EMAIL] [PHONE]" and clean[8]["n_chars"] == len(clean[8]["text"]) and clean[2]["text"] is None and clean[7]["n_chars"] == 50_000
    kept = Counter(r["doc_id"] for r in neardup.deduplicated(odd).collect())
    assert kept == Counter([1, 1, 2, 3, 4, 5, None, 7, 8, 9])


def test_written_shards_keep_clashing_columns(spark, odd, tmp_path):
    name = sharding.write_shards(odd, 20_000, str(tmp_path / "s"))
    assert name == "shard_"
    back = spark.read.parquet(str(tmp_path / "s"))
    assert as_rows(back.select(odd.columns)) == as_rows(odd)
    sharding.write_shards(odd.limit(0), 20_000, str(tmp_path / "none"))


def test_decoded_rows(spark, odd):
    out = pieces.decoded(pieces.encoded(odd, PIECE), PIECE)
    assert as_rows(out) == as_rows(odd.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert pieces.decoded(pieces.encoded(odd.limit(0), PIECE), PIECE).count() == 0
    assert pieces.decoded(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>"), PIECE).first()["text"] == ""


def test_values_on_odd_rows(spark, odd):
    ops = operators(spark)
    rows = ops["fingerprint"](odd).collect()
    twice = [r for r in rows if r["doc_id"] == 1]
    assert twice[0]["fingerprint"] == twice[1]["fingerprint"]
    lost = next(r for r in rows if r["doc_id"] is None)
    assert lost["edited_sha256"] == hashlib.sha256(b"no id at all in this r").hexdigest()
    by = {r["doc_id"]: r for r in ops["pieces"](odd).collect()}
    assert by[2]["n_pieces"] == by[3]["n_pieces"] == 0 and all(r["exact"] for r in by.values())
    made = {r["doc_id"]: r for r in ops["tokens"](odd).collect()}
    assert made[None]["start"] == 0 and made[2]["n_tokens"] == made[3]["n_tokens"] == 1
    scores = ops["quality"](odd).collect()
    assert all(0 <= r[c] <= 1 for r in scores for c in ("quality", "toxic", "text_quality", "meta_toxic"))


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_on_odd_and_empty_tables(spark, odd, tmp_path, rows):
    plain = odd.select("doc_id", "text", "lang", "source", "n_chars")
    (plain if rows == "odd" else plain.limit(0)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "same text of a few words")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = [r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert len(out) == len(set(out)) and set(out) <= {None, 5, 7, 8, 9} and (5 in out) == (rows == "odd")


def test_defined_results(spark, odd):
    ops = operators(spark)
    near = {r["doc_id"]: r for r in ops["neardup"](odd).collect()}
    assert near[6]["component_id"] == 5 and not near[6]["kept"] and near[5]["kept"]
    assert near[2]["n_shingles"] == 0 and near[2]["kept"] and near[None]["kept"] and near[None]["component_id"] is None
    hit = {r["doc_id"]: r for r in ops["decontam"](odd).collect()}
    assert hit[2]["n_words"] == 0 and hit[5]["contaminated"] and hit[1]["n_hit"] == 6 and hit[1]["n_items"] == 1
    found = {r["doc_id"]: r for r in ops["pii"](odd).collect()}
    assert (found[8]["n_email"], found[8]["n_phone"], found[9]["n_ip"], found[9]["n_card"]) == (1, 1, 1, 0)
    assert found[2]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    shards = ops["sharding"](odd).collect()
    assert all(r["fits"] or r["shard_bytes"] == r["n_bytes"] for r in shards)
    passage = {r["doc_id"]: r for r in ops["passages"](odd).collect()}
    assert passage[6]["repeated"] and passage[6]["n_copied"] == passage[6]["n_words"] and passage[5]["n_copied"] == 0 and passage[5]["repeated"]
    lang = {r["doc_id"]: r for r in ops["language"](odd).collect()}
    assert not lang[2]["accepted"] and not lang[3]["accepted"] and not lang[4]["accepted"]
