"""What the methods promise: views that teach each other, consistent labels, exact leftovers, no lost passage, files as laid out."""

import glob
import itertools
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cairn.llm import fingerprint, langid, neardup, passages, pii, quality, tokens

from .test_exact import groups


def prose(rng, n, words=10**9):
    return [f"w{x}" for x in rng.integers(0, words, n)]


# co-training


@pytest.fixture(scope="module")
def classed(spark):
    """Texts whose words tell the class, and whose source tells it too."""
    rng = np.random.default_rng(11)
    rows, labels = [], []
    for i in range(900):
        good = bool(rng.random() < 0.5)
        words = [f"{'good' if good == (rng.random() < 0.8) else 'poor'}{rng.integers(0, 6)}" for _ in range(8)] + prose(rng, 20, 300)
        source = f"s{int(rng.integers(0, 4)) if good == (rng.random() < 0.85) else 4 + int(rng.integers(0, 4))}"
        rows.append((i, " ".join(words), "en", source, 200))
        labels.append((i, int(good), int(not good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs, labels


def loss(p, y):
    p = np.clip(np.array(p), 1e-9, 1 - 1e-9)
    return -np.mean(np.where(np.array(y) == 1, np.log(p), np.log(1 - p)))


def test_views_teach_each_other(spark, classed):
    docs, labels = classed
    given = spark.createDataFrame(labels[:200], "doc_id long, quality int, toxic int")
    rows = docs.select("doc_id", F.col("text").alias("_text"), quality.metadata(docs).alias("_meta"))
    _, history = quality.trained(rows, given)
    sizes = {v: [h[v] for h in history if h["target"] == "quality"] for v in ("text", "meta")}
    assert len(sizes["text"]) == 1 + quality.ROUNDS
    assert all(b > a for v in sizes.values() for a, b in itertools.pairwise(v)), sizes
    after, before = ({r["doc_id"]: r for r in quality.scored(docs, given, rounds=k).collect()} for k in (quality.ROUNDS, 0))
    assert max(abs(after[i]["quality"] - before[i]["quality"]) for i in after) > 1e-3
    held = [(i, y) for i, y, _ in labels[200:]]
    new, old = (loss([out[i]["quality"] for i, _ in held], [y for _, y in held]) for out in (after, before))
    assert new <= old + 0.01
    both = np.mean([(after[i]["quality"] >= 0.5) == (y == 1) for i, y in held])
    assert both >= max(np.mean([(after[i][f"{v}_quality"] >= 0.5) == (y == 1) for i, y in held]) for v in ("text", "meta")) - 0.01


def test_passed_rows_leave_the_pool(spark, classed):
    docs, labels = classed
    given = spark.createDataFrame(labels[:100], "doc_id long, quality int, toxic int")
    rows = docs.select("doc_id", F.col("text").alias("_text"), quality.metadata(docs).alias("_meta"))
    most = max(1, int(quality.PASSED * 75))
    _, history = quality.trained(rows, given, rounds=3)
    assert max(h["text"] for h in history) <= 75 + 3 * 2 * most


# the field of personal data


def test_marginals_equal_enumeration_on_trees():
    """Two like tokens with a neighbour each: messages are exact where edges make no circle."""
    rng = np.random.default_rng(3)
    field = pii.Field([("u", k, label, int(rng.integers(0, 30))) for k in range(pii.SHAPES) for label in range(pii.LABELS) if k < 50] + [(w, a, b, int(rng.integers(1, 40))) for w in "ts" for a in range(pii.LABELS) for b in range(pii.LABELS)])
    found = pii.Tokens(pa.array(["a1 9988776 x words 9988776 between z9"]))
    found.shape = np.arange(len(found.doc)) % 50
    label = np.zeros(len(found.doc), np.int64)
    label[0] = 3
    n = len(found.doc)
    assert n == 4 and len(found.skip) == 1
    weight = {}
    for x in itertools.product(range(pii.LABELS), repeat=n):
        if x[0] != 3:
            continue
        z = sum(field.unary[found.shape[k], x[k]] for k in range(1, n))
        z += sum(field.chain[x[a], x[b]] for a, b in found.chain) + sum(field.skip[x[a], x[b]] for a, b in found.skip)
        weight[x] = math.exp(z)
    total = sum(weight.values())
    want = [[sum(w for x, w in weight.items() if x[k] == v) / total for v in range(pii.LABELS)] for k in range(n)]
    assert np.abs(field.posterior(found, label) - np.array(want)).max() < 5e-3


def test_labels_reach_all_repeats(spark, sf):
    """Forty repeats of a bare number after one that a pattern finds: all are added."""
    d = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    field = pii.Field([tuple(r) for r in pii.counted(d).collect()])
    column = pa.array(["call +1 (988) 555-2485 now " + " and ".join(["(988) 555-2485"] * 40)])
    found = pii.Tokens(column)
    base, label = found.base(column)
    assert len(base[0]) == 1 and [k for k, *_ in field.added(found, label)[0]] == [3] * 40


# languages


def test_fusion_equals_a_plain_version(spark):
    rng = np.random.default_rng(5)
    stems = {"aa": ["lorem", "ipsum", "dolor", "amet"], "bb": ["wxyz", "zyxw", "qqqq", "kkzz"]}
    rows = []
    for i in range(80):
        lang = ("aa", "bb")[i % 2]
        text = "" if i % 17 == 0 else " ".join(rng.choice(stems[lang], 6))
        rows.append((i, text, None if i % 5 == 0 else lang if i % 11 else ("bb", "aa")[i % 2], f"h{i % 3}" if i % 7 else None))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in langid.identified(langid.of_documents(docs), ["doc_id"]).collect()}
    known = ["aa", "bb", langid.UNKNOWN]
    counts = {i: next(langid._pieces(pa.array([t])))[0] for i, t, *_ in rows}
    table = np.full((2, langid.CELLS), 0.5)
    for i, _, lang, _ in rows:
        if lang:
            table[known.index(lang)] += counts[i]
    model = np.vstack([np.log(table / table.sum(axis=1, keepdims=True)), np.full(langid.CELLS, -np.log(langid.CELLS))])
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    ll = {i: model @ counts[i] * min(counts[i].sum(), langid.TRIGRAMS) / max(counts[i].sum(), 1) for i in counts}
    own = {i: soft(ll[i]) if counts[i].sum() else np.zeros(3) for i in ll}
    whole = (sum(own.values()) + langid.PULL / 3) / (sum(x.sum() for x in own.values()) + langid.PULL)
    said = {v: sum((own[i] for i, _, lang, _ in rows if lang == v), np.zeros(3)) for v in ("aa", "bb")}
    every = sum(said.values())
    host = {h: sum((own[i] for i, *_, s in rows if s == h), np.zeros(3)) for h in ("h0", "h1", "h2")}
    for i, _, lang, source in rows:
        prior = np.log(np.maximum(host[source] - own[i], 0) + langid.PULL * whole) if source else np.log(whole)
        z = ll[i] + prior + (np.log((said[lang] + 0.5) / (every + 0.5 * 4)) if lang else 0)
        p = soft(z)
        assert got[i]["language"] == known[int(p.argmax())] and abs(got[i]["probability"] - p.max()) < 1e-6
        assert got[i]["accepted"] == bool(p.max() >= langid.ACCEPT and counts[i].sum() and p.argmax() < 2)


def test_rare_languages_are_known(spark):
    """One row in two thousand declares a language: it isn't filed under another."""
    rows = [(i, "lorem ipsum dolor sit amet consectetur", "la") for i in range(1999)] + [(5000, "zxq wvk qqz kkw vvz zzk xxq", "zx")]
    got = langid.identified(langid.of_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string")), ["doc_id"]).where("doc_id = 5000").first()
    assert got["language"] == "zx"


# near copies


def near_copies(rng, n, size=120):
    base = prose(rng, size)
    out = []
    for k in range(n):
        changed = set(rng.choice(size, int(rng.integers(0, 12)), replace=False).tolist())
        out.append((k + 1, " ".join(f"x{k}_{i}" if i in changed else w for i, w in enumerate(base))))
    return out


@pytest.mark.parametrize("num", [80, 85])
def test_near_copies_of_mixed_similarity(spark, monkeypatch, num):
    """A group of near copies, from alike to hardly so: as exact as brute force, in pairs that grow with the members."""
    rows = near_copies(np.random.default_rng(7), 500)
    seen = []
    likely = neardup._likely
    monkeypatch.setattr(neardup, "_likely", lambda pairs, *a: seen.append(pairs.count()) or likely(pairs, *a))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), num=num).collect()}
    assert got == groups(rows, num)
    assert sum(seen) < 10 * len(rows), seen  # all pairs are 124,750


def test_two_groups_that_share_bands(spark):
    """Two groups around a common half: the second hub joins the group that the first isn't in."""
    rng = np.random.default_rng(8)
    common, one, two = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(k, " ".join([*common, *(one if k % 2 else two), f"end{k}"])) for k in range(40)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups(rows)


def test_rows_that_repeat_an_id_are_one_document(spark):
    rng = np.random.default_rng(9)
    a, b = " ".join(prose(rng, 30)), " ".join(prose(rng, 30))
    rows = [(0, a), (1, a), (1, b), (2, b), (1, ""), (3, None)]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 0, False), (2, 0, False), (3, 3, True)]


# passages


def test_passage_behind_decoys(spark):
    """A passage of two documents whose shingles smaller documents have too, in other texts."""
    rng = np.random.default_rng(10)
    passage = prose(rng, 60)
    decoys = {k: [] for k in (1, 2, 3)}
    for i in range(56):
        decoys[1 + i % 3] += [*passage[i : i + 5], *prose(rng, 4)]
    rows = [(k, " ".join(w)) for k, w in decoys.items()] + [(k, " ".join([*prose(rng, 40), *passage, *prose(rng, 40)])) for k in (10, 11)]
    got = {r["doc_id"]: r["spans"] for r in passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("repeated").collect()}
    assert got == {10: "", 11: "40:100"}


@pytest.mark.parametrize("edits,least", [(1, 0.97), (2, 0.9)])
def test_recall_of_near_copies(spark, edits, least):
    """Passages of 100 words with words changed far from each other: similarity 0.9 and 0.81."""
    rng = np.random.default_rng(12)
    rows = []
    for k in range(150):
        base = prose(rng, 100)
        at = [50] if edits == 1 else [33, 66]
        rows += [(10 * k, " ".join([*prose(rng, 30), *base])), (10 * k + 1, " ".join([*(f"x{i}" if i in at else w for i, w in enumerate(base)), *prose(rng, 30)]))]
    found = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).where("n_copied >= 95").count()
    assert found >= least * 150


def test_copies_of_a_whole_text_are_passages(spark):
    text = " ".join(prose(np.random.default_rng(13), 70))
    got = sorted((r["doc_id"], r["n_copied"], r["n_repeated"]) for r in passages.passages(spark.createDataFrame([(k, text) for k in range(6)], "doc_id long, text string")).collect())
    assert got == [(0, 0, 70)] + [(k, 70, 70) for k in range(1, 6)]


# fingerprints and files


def test_likeness_is_the_share_of_paragraphs(spark):
    rng = np.random.default_rng(14)
    rows, want = [], []
    for k in range(60):
        common, one, two = ([f"p{x}." for x in rng.integers(0, 10**9, n)] for n in (int(rng.integers(0, 80)), 20, 20))
        rows.append((k, "\n".join(common + one), "\n".join(two + common)))
        want.append(2 * len(common) / (2 * len(common) + 40))
    df = spark.createDataFrame(rows, "k long, a string, b string")
    lanes = df.select("k", fingerprint.lanes(F.col("a")).alias("a"), fingerprint.lanes(F.col("b")).alias("b"))
    got = [r[0] for r in lanes.orderBy("k").select(fingerprint.likeness(F.col("a"), F.col("b"))).collect()]
    assert np.abs(np.array(got) - want).max() < 0.45 and np.abs(np.array(got) - want).mean() < 0.12


def test_token_files_have_their_layout(spark, sf, tmp_path):
    path = str(tmp_path / "t")
    tokens.write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), path)
    columns = {}
    for f in glob.glob(f"{path}/*.parquet"):
        group = pq.ParquetFile(f).metadata.row_group(0)
        for k in range(group.num_columns):
            c = group.column(k)
            columns.setdefault(c.path_in_schema.split(".")[0], []).append((set(c.encodings), c.has_offset_index))
    assert set(columns) == {"doc_id", "n_tokens", "offset", "ids"} and all(x[1] for v in columns.values() for x in v)
    assert all(any("DICTIONARY" in e for e in x[0]) for x in columns["ids"]) and all("DELTA_BINARY_PACKED" in x[0] for x in columns["offset"])
    plan = tokens.read_tokens(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema:")[-1].split(">")[0]


def test_zones_shuffle_few_bytes_a_shingle(spark):
    """Shingles on their way to lone ones are few bytes each, and the zones are those of a plain count."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [[word() for _ in range(120)] for _ in range(6)]
    texts = {k: [word() for _ in range(400)] + shared[k % 6] + [word() for _ in range(300)] + (shared[(k + 1) % 6] if k % 3 else []) for k in range(300)} | {1 << 40: ["x"] * 80, -5: shared[0]}
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    sets = {k: [tuple(w[i : i + 5]) for i in range(len(w) - 4)] for k, w in texts.items()}
    count = Counter(s for x in sets.values() for s in set(x))
    want = {}
    for k, x in sets.items():
        first = {}
        for i, s in enumerate(x):
            first.setdefault(s, i)
        want[k] = passages.possible(len(x), np.array([i for s, i in first.items() if count[s] == 1], np.int64))
    rows = spark.createDataFrame([(k, len(x)) for k, x in sets.items()], "doc_id long, n int")
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = {r["doc_id"]: [tuple(z) for z in r["zones"]] for r in passages._zones(rows, docs).collect()}
    assert got == want and any(want.values())
    assert sent() - before < 16 * sum(map(len, sets.values()))


def _shingled(words):
    return np.array([hash(tuple(words[k : k + 5])) % 2**63 for k in range(len(words) - 4)], np.uint64)


def test_junk_of_repeated_words_has_no_room_for_passages():
    """a passage is judged by distinct shingles, so runs of one word don't outweigh what is lone; no passage is ruled out by that."""
    text = _shingled([w for w in "abcd" for _ in range(30)])
    still = np.append(False, text[1:] == text[:-1])
    runs = np.flatnonzero(np.diff(np.concatenate([[0], still, [0]]))).astype(np.int32)
    lone = np.flatnonzero(~still & np.append(True, still[:-1] | ~still[1:]) & (np.arange(len(text)) % 30 != 0))
    assert passages.possible(len(text), lone) == [(0, len(text))] and passages.possible(len(text), lone, runs) == []
    rng, found = random.Random(9), 0
    for _ in range(400):
        parts = [[rng.randrange(4)] * rng.randrange(1, 60) if rng.random() < 0.5 else [rng.randrange(30) for _ in range(20)] for _ in range(8)]
        a = [w for p in parts for w in p] + list(range(100, 160))
        b = [rng.randrange(9) if rng.random() < 0.02 else w for w in a]
        x, y = _shingled(a), _shingled(b)
        texts = passages._Texts(np.concatenate([x, y]), np.array([len(x), len(y)]), [[None, None], [None, None]])
        one, two = np.array([0]), np.array([1])
        zones = texts.zones(one, two, True), texts.zones(two, one, False)
        for s, e, p, q in passages.alike(x, y):
            found += 1
            assert all(any(lo <= m and n <= hi for lo, hi in zip(z[1], z[2], strict=True)) for z, m, n in ((zones[0], s, e), (zones[1], p, q)))
    assert found > 400


def test_pairs_that_add_no_words_are_left_out():
    """three near copies are compared as long as a pair may add words; what is covered stays the same."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [base, *[[*base[:k], f"x{k}", *base[k + 1 :]] for k in (120, 240)]]
    texts = pa.table({"node": pa.array([1, 2, 3], pa.int64()), "text": [" ".join(w) for w in rows]})
    spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    links = pa.table({"doc_id": pa.array([2, 3, 3], pa.int64()), "peer": pa.array([1, 1, 2], pa.int64())})
    known = lambda copied, every: texts.append_column("copied", pa.array(copied, spans)).append_column("every", pa.array(every, spans))
    whole, none = [{"lo": 0, "hi": 300}], None
    got = passages._compared(links, known([none] * 3, [none] * 3)).to_pylist()
    assert sorted((r["role"], r["doc_id"], r["peer"], r["lo"], r["hi"]) for r in got) == [(0, 2, 1, 0, 300), (0, 3, 1, 0, 300), (1, 1, 2, 0, 300), (1, 1, 3, 0, 300)]
    got = passages._compared(links, known([none, whole, none], [whole, whole, none])).to_pylist()
    assert sorted((r["role"], r["doc_id"], r["peer"]) for r in got) == [(0, 3, 1), (1, 1, 3)]
    assert passages._compared(links, known([none, whole, whole], [whole] * 3)).num_rows == 0
