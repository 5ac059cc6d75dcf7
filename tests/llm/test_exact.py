"""Operators against brute force on the smallest tables, and round trips."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from cairn.llm import decontam, fingerprint, langid, neardup, passages, pieces, pii, quality, sharding, tokens
from cairn.llm import text as tx
from cairn.llm.queries import QUERIES, SQL

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII))
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def groups(docs, num=85):
    sets = {i: shingles(t or "") for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in held[x] if j < i).items():
            if 100 * n >= num * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates(spark, sf, docs):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in QUERIES["op5_hyperminhash"](spark, sf).collect()}
    assert got == groups(docs)


def test_near_duplicates_of_a_chain(spark):
    """Each text is like the next only, and the hub is like few: components need the comparisons beyond the hub."""
    words = [f"w{i}" for i in range(400)]
    rows = [(k, " ".join(words[k * 6 : k * 6 + 120])) for k in range(30)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def contaminated(docs, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
    known = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - width + 1, 1) if w else 0):
            known[tuple(w[k : k + width])].add(i)
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(k) for k in known}:
            for k in range(len(w) - n + 1):
                if m := known.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= m
        ids = ",".join(sorted(map(str, found)))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit))
    return out


def test_contamination(spark, sf, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    got = {r[0]: tuple(r[1:6]) for r in QUERIES["op6_suffix_automaton"](spark, sf).collect()}
    assert got == contaminated(docs, items)


def test_contamination_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = lambda n: " ".join(rng.choice(["a", "b", "C"], n))
    rows, items = [(i, text(int(rng.integers(0, 50)))) for i in range(40)], [(i, text(int(rng.integers(0, 12)))) for i in range(10)]
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 6)
    got = decontam.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 4)
    assert {r[0]: tuple(r[1:6]) for r in got.collect()} == contaminated(rows, items, 4)


def test_decontaminated_text_is_clean(spark, sf):
    d, b = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    clean = decontam.decontaminated(d, b)
    assert decontam.report(clean, b).where("contaminated").count() == 0
    dirty = {r["doc_id"] for r in decontam.report(d, b).where("contaminated").collect()}
    before = {r["doc_id"]: r["text"] for r in d.collect()}
    assert all(r["text"] == before[r["doc_id"]] for r in clean.collect() if r["doc_id"] not in dirty)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB é.,'sİ!<|endoftext>\n9中🙂", max_size=25), max_size=8))
def test_token_pieces_equal_the_tokenizer(texts):
    own = tokens.units(public_tokenizers.path("word_bpe_49k.json"))
    ids, start = own.encode(pa.array(texts, pa.string()), 1)
    assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == [own.tokenizer.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def test_token_files(spark, sf, docs):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = tokens.units(public_tokenizers.path("word_bpe_49k.json")).tokenizer
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in QUERIES["op7_token_lists"](spark, sf).collect()}
    at = 0
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abeting é 9\n\t中🙂▁-=", max_size=25), max_size=8))
def test_pieces_equal_the_library(texts):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = pieces.words(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids, start = own.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(start[:-1], start[1:], strict=True)] == [library.encode(t) for t in texts]
    data, off = own.decode(ids, start)
    assert [data[a:b].tobytes().decode() for a, b in zip(off[:-1], off[1:], strict=True)] == [t.replace("▁", " ") for t in texts]


def test_pieces_of_documents(spark, sf, docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encoded(spark.read.parquet(f"{sf}/documents.parquet"), path)
    assert all(r["exact"] for r in out.collect())
    again = {r["doc_id"]: r["text"] for r in pieces.decoded(out, path).collect()}
    assert again == dict(docs)


PATTERNS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def patterns(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if [True, k == 1 and all(int(x) <= 255 for x in m[0].split(".")), k == 2 and 13 <= len(d) <= 19 and pii.luhn(d), k == 3 and 9 <= len(d) <= 15][k]:
                out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.b_-+1 é25()", max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == patterns(text)


def test_personal_data(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op4_skip_chain"](spark, sf).collect()}
    for i, t in docs:
        want = patterns(t or "")
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in want) for k in range(4)]
        assert got[i]["base_sha256"] == hashlib.sha256(pii.rendered(want).encode()).hexdigest()
        assert set(filter(None, pii.rendered(want).split(","))) <= set(got[i]["spans"].split(","))


def test_like_tokens_get_like_labels(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    rows = [(10_001, "call +1 (988) 555-2485 now or (988) 555-2485 later"), (10_002, "in (123) there are 42 apples and 7 pears")]
    got = {r["doc_id"]: r["spans"] for r in pii.found(d.unionByName(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[10_001] == "phone:5:22,phone:30:44" and got[10_002] == ""


def test_fingerprints(spark, sf, docs):
    got = {r["doc_id"]: r for r in QUERIES["op2_multiset_hash"](spark, sf).collect()}
    down = docs[::-1]
    for k, (i, t) in enumerate(down):
        n = len(t)
        edited = t[: n - n // 3] + down[(k + 1) % len(down)][1][: n // 3]
        assert got[i]["n_chars"] == n and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
    by_text = defaultdict(set)
    for i, t in docs:
        by_text[t].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values())
    near = np.array([[r["near_edited"], r["near_next"]] for r in got.values()])
    assert near[:, 0].mean() > near[:, 1].mean() + 0.3 and near.min() >= 0 and near.max() <= 1


def test_fingerprints_are_homomorphic(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("one.\ntwo.\nthree.",)], "t string")
    lanes = lambda s: fingerprint.lanes(F.lit(s))
    r = df.select(
        lanes("one.\ntwo.\nthree.").alias("a"),
        lanes("three.\none.\ntwo.").alias("b"),
        fingerprint.inserted(lanes("one.\ntwo."), F.lit("three.")).alias("c"),
        fingerprint.deleted(lanes("one.\ntwo.\nthree.\nfour."), F.lit("four.")).alias("d"),
        fingerprint.merged(lanes("one."), lanes("two.\nthree.")).alias("e"),
        lanes("one.\ntwo.").alias("f"),
    ).first()
    assert r["a"] == r["b"] == r["c"] == r["d"] == r["e"] != r["f"]


def test_shards(spark, sf):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    d = spark.read.parquet(f"{sf}/documents.parquet")
    for limit in (sharding.SHARD_BYTES, 40_000, 3_000):
        got = sharding.assigned(d, limit)
        found = c.sql(sharding.sql(limit))
        at = [found.columns.index(x) for x in got.columns]
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in found.fetchall())


def test_equal_rows_are_dealt(spark):
    d = spark.createDataFrame([(1, "abc")] * 50, "doc_id long, text string").repartition(3)
    out = sharding.assigned(d, 10).collect()
    size = Counter()
    for r in out:
        size[r["shard"]] += r["n_bytes"]
    assert len(out) == 50 and max(size.values()) <= 10 and all(size[r["shard"]] == r["shard_bytes"] for r in out)


def test_written_shards_fit(spark, sf, tmp_path):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    sharding.write_shards(d, 60_000, str(tmp_path / "s"))
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.drop("shard").exceptAll(d).count() == 0 and back.count() == d.count()


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(30):
        start = np.append(0, np.cumsum(rng.integers(0, 60, 6)))
        values, least = rng.integers(0, 2**63, start[-1], dtype=np.uint64) << np.uint64(1), int(rng.integers(2, 12))
        want = set()

        def walk(t, x, a, b, least=least, want=want):
            if b - a + 1 >= least:
                c = a + int(np.argmin(x[a : b + 1]))
                want.add((t, a, c, b))
                walk(t, x, a, c - 1)
                walk(t, x, c + 1, b)

        for t in range(len(start) - 1):
            walk(t, values[start[t] : start[t + 1]], 0, int(start[t + 1] - start[t]) - 1)
        assert set(zip(*[x.tolist() for x in passages.compact_windows(values, start, least)], strict=True)) == want


def test_repeated_passages(spark, sf, docs):
    """Every run of 50 words that two documents share is found."""
    held = defaultdict(set)
    for i, t in docs:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(ASCII))
        for k in range(len(w) - 49):
            held[tuple(w[k : k + 50])].add(i)
    want = set().union(*[x for x in held.values() if len(x) > 1])
    got = {r["doc_id"] for r in QUERIES["op10_compact_windows"](spark, sf).where("repeated").collect()}
    assert want <= got and len(got - want) <= 0.05 * len(docs)


def test_language(spark, sf):
    out = QUERIES["op3_evidence_fusion"](spark, sf).collect()
    assert np.mean([r["language"] == r["declared"] for r in out]) > 0.97
    d = langid.of_documents(spark.read.parquet(f"{sf}/documents.parquet"))
    train, held = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    known = langid.languages(train)
    scored = held.select("lang", langid.scores(langid.text_model(train, known)).alias("s")).collect()
    assert np.mean([known[int(np.argmax(r["s"][:-1]))] == r["lang"] for r in scored]) > 0.95


def test_quality_on_held_out_labels(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    out = {r["doc_id"]: r for r in quality.scored(d, labels.where("pmod(xxhash64(doc_id), 4) <> 0")).collect()}
    held = labels.where("pmod(xxhash64(doc_id), 4) = 0").collect()
    assert np.mean([(out[r["doc_id"]]["quality"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.88
    assert np.mean([(out[r["doc_id"]]["toxic"] >= 0.5) == (r["toxic"] == 1) for r in held]) > 0.9


def test_word_hashes_agree_across_blocks(monkeypatch):
    texts = pa.array(["a b " * 300, None, "", "x" * 5000 + " tail", "É b"], pa.string())
    whole = tx.words(texts, tx.NOT_SPACE)[0]
    monkeypatch.setattr(tx, "BLOCK", 64)
    monkeypatch.setattr(tx, "_POWERS", {})
    assert (tx.words(texts, tx.NOT_SPACE)[0] == whole).all()


def test_pipeline(spark, sf, docs):
    """The stages one after the other, each held against brute force on what the stage before has kept."""
    d = spark.read.parquet(f"{sf}/documents.parquet")
    a = corpus_pipeline.language(spark, d, sf)
    assert a.columns == d.columns and a.count() == d.count()  # all are prose in a known language
    b = corpus_pipeline.near_duplicates(spark, a, sf)
    assert {r["doc_id"] for r in b.select("doc_id").collect()} == {i for i, (_, c) in groups(docs, 80).items() if i == c}  # the similarity of stages
    c = corpus_pipeline.decontamination(spark, b, sf)
    e = corpus_pipeline.personal_data(spark, c, sf)
    assert e.columns == d.columns
    assert all(not patterns(r["text"]) for r in e.collect())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == {r["doc_id"] for r in e.collect()} and all(r["exact"] for r in out)


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)] and set(SQL) <= set(QUERIES)
