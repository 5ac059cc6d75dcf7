"""Anchor points, cover trees and prefix CRCs against brute force; their odd inputs."""

import math
import re
import zlib
from itertools import combinations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cairn.llm import anchors, covertree, importance
from cairn.llm.queries import QUERIES, SQL

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
KIND = "doc_id long, text string, fp long, node long, component string, items string, rank int, score string, anchor int"


def components(ids, joined):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in joined:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# --- anchor points


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(len(w) - 3, 1))] if w else []
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def test_simhash_of_a_table(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = {r["doc_id"]: plain_simhash(r["text"]) for r in rows}
    ids = sorted(fps)
    want = components(ids, [(a, b) for a, b in combinations(ids, 2) if (fps[a] ^ fps[b]).bit_count() <= 4])
    got = QUERIES["op11_anchor_points"](spark, sf).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in ids}


def test_code_covers_every_part():
    for width in (21, 22):
        words = np.random.default_rng(width).integers(0, 1 << width, 2000)
        flips = anchors.patterns(width, 2)
        own = words ^ np.array([flips[s][0] for s in anchors.syndrome(words)])
        assert (anchors.syndrome(own) == 0).all() and (np.bitwise_count(own ^ words) <= 1).all()
        for bit in range(width):  # what differs in one bit is dealt to the own anchor
            other = words ^ (1 << bit)
            assert all(o in (w ^ flips[s]) for o, w, s in zip(own, other, anchors.syndrome(other), strict=True))


@pytest.mark.parametrize("block", [4096, 16])
def test_links_of_planted_fingerprints(spark, monkeypatch, block):
    """Neighbours at exactly 4 and 5 bits, chains, and a dense cluster, in whole and in blocks."""
    monkeypatch.setattr(anchors, "BLOCK", block)
    rng = np.random.default_rng(5)
    flip = lambda x, n: x ^ sum(1 << int(k) for k in rng.choice(64, n, replace=False))
    base = [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = set(base) | {flip(x, 4) for x in base[:20]} | {flip(x, 5) for x in base[20:40]} | {flip(flip(x, 4), 4) for x in base[40:]}
    centre = base[0]
    fps |= {flip(centre, int(n)) for n in rng.integers(1, 7, 300)}
    fps = sorted(fps)
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 4])
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long").repartition(3)
    rows = anchors.compared(anchors.dealt(nodes)).collect()
    links = {(r["a"] & (1 << 64) - 1, r["b"] & (1 << 64) - 1) for r in rows}
    assert components(fps, links) == want
    assert all(want[a] == want[b] for a, b in links)
    if block == 4096:
        assert len(rows) < 80 * len(fps)  # forests, not all pairs of the cluster


def test_forest_holds_together():
    rng = np.random.default_rng(9)
    for n in (1, 2, 40, 400):
        a, b = rng.integers(0, 100, n), rng.integers(100, 200, n)
        x, y = anchors.forest(a, b)
        ids = set(a.tolist()) | set(b.tolist())
        assert len(x) < len(ids)
        assert components(ids, zip(x.tolist(), y.tolist(), strict=True)) == components(ids, zip(a.tolist(), b.tolist(), strict=True))


# --- prefix CRCs


@pytest.mark.parametrize("run", [1, 3])
def test_crcs_of_runs(run):
    import pyarrow as pa

    texts = ["One, two  THREEé four", "", None, "a", "..", "x" * 5000 + " y", "über 中文 1 2 3"]
    got, start, count = importance.features(pa.array(texts), run)
    for k, text in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(ASCII))
        want = [zlib.crc32(" ".join(w[i : i + n]).encode()) for n in range(1, run + 1) for i in range(len(w) - n + 1)]
        assert sorted(got[start[k] : start[k + 1]].tolist()) == sorted(want) and count[k] == len(w)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for name in ("documents", "benchmark", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", ["op12_cover_tree_lloyd", "op13_prefix_crc"])
def test_same_as_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    want = duck.sql(SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert sorted(str(tuple(r)) for r in df.select(want.columns).collect()) == sorted(map(str, want.fetchall()))


def test_draw(spark):
    """Documents like the target are drawn more often; ranks follow score and id."""
    rows = [(k, "good words of the target here and there " * 4 if k % 2 else "noise other stuff thing bits " * 6) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(1, "good words of the target here and there " * 50)], "item_id long, text string")
    got = importance.resampled(docs, target).collect()
    drawn = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in drawn] == list(range(1, 41)) and sum(r["doc_id"] % 2 for r in drawn) > 35
    order = sorted(got, key=lambda r: (-r["score"], r["doc_id"]))[:40]
    assert [r["doc_id"] for r in drawn] == [r["doc_id"] for r in order]
    kept = importance.sample(docs.withColumn("rank", F.lit("x")), target)
    assert kept.columns == ["doc_id", "text", "rank"] and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in drawn}


# --- cover trees


def plain_assign(points, book):
    return ((points[:, None].astype(np.int64) - book) ** 2).sum(axis=2).argmin(axis=1)


@pytest.mark.parametrize("kind", ["clusters", "random", "equal", "large", "one"])
def test_tree_assigns_as_brute_force(kind):
    rng = np.random.default_rng(3)
    n = 1 if kind == "one" else 700
    points = {
        "clusters": rng.integers(-8000, 8000, (12, 8))[rng.integers(0, 12, n)] + rng.integers(-30, 30, (n, 8)),
        "random": rng.integers(-4000, 4000, (n, 8)),
        "equal": np.repeat(rng.integers(-9, 9, (3, 8)), 234, axis=0)[:n],
        "large": rng.integers(-(1 << 28) + 1, 1 << 28, (n, 8)),
        "one": rng.integers(-9, 9, (1, 8)),
    }[kind]
    book = points[rng.integers(0, n, 16)] if kind != "random" else rng.integers(-4000, 4000, (16, 8))
    book[5] = book[3]  # a tie
    order, nodes = covertree.levels(points)
    assert sorted(order.tolist()) == list(range(n))
    sorted_points = points[order]
    for level in nodes:
        assert level[0, 0] == 0 and level[-1, 1] == n and (level[1:, 0] == level[:-1, 1]).all()
        for a, b, r in level:
            far = ((sorted_points[int(a) : int(b)] - sorted_points[int(a)]) ** 2).sum(axis=1).max()
            assert math.isclose(r, math.sqrt(far), rel_tol=1e-12, abs_tol=1e-9)
    code, sums, counts, exact = covertree.assigned(sorted_points, np.array([len(x) for x in nodes]), np.concatenate(nodes), book)
    want = plain_assign(sorted_points, book)
    assert (code == want).all()
    assert (counts == np.bincount(want, minlength=16)).all()
    assert all((sums[k] == sorted_points[want == k].sum(axis=0)).all() for k in range(16))
    if kind == "clusters":
        assert exact < n


def test_tree_skips_rows_far_from_borders():
    rng = np.random.default_rng(4)
    centres = rng.integers(-8000, 8000, (16, 8))
    points = centres[rng.integers(0, 16, 1000)] + rng.integers(-5, 5, (1000, 8))
    order, nodes = covertree.levels(points)
    *_, exact = covertree.assigned(points[order], np.array([len(x) for x in nodes]), np.concatenate(nodes), centres)
    assert exact == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(k, [float(k % 5)] * 16, None if k % 3 else k % 2) for k in range(40)]
    bad = [(90, None, 1), (91, [None] * 16, 1), (92, [nan] * 16, 1), (93, [inf] * 16, 1), (94, [], 1), (95, [1.0] * 8, 1), (96, [1.0] * 3, 1)]
    more = [(7, [1.0] * 16, None), (None, [2.0] * 16, 1)]
    df = spark.createDataFrame(good + bad + more, "vec_id long, embedding array<float>, label int")
    df = df.withColumn("code", F.lit(1)).withColumn("place", F.lit(1)).withColumn("v", F.lit(1)).withColumn("chunk", F.lit(1))
    out = covertree.compressed(df).collect()
    assert sorted(str(r["vec_id"]) for r in out) == sorted([*map(str, range(40)), "7", "None"])
    assert {r["error"] for r in out} == {0} and len({r["codebooks_sha256"] for r in out}) == 1
    assert covertree.compressed(df.limit(0)).count() == 0 and covertree.compressed(df.where("vec_id >= 90")).count() == 1
    assert covertree.compressed(df.where("vec_id = 1")).first()["code"] == "00" * 8


def test_label_errors_with_null_labels(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [float(x) for x in rng.normal(size=16)], None if k % 4 == 0 else k % 4) for k in range(200)]
    out = covertree.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    label, sums = {r[0]: r[2] for r in rows}, {}
    for r in out:
        sums[label[r["vec_id"]]] = sums.get(label[r["vec_id"]], 0) + r["error"]
    assert all(r["label_error"] == sums[label[r["vec_id"]]] for r in out) and len(sums) == 4


def test_vectors_too_large(spark):
    df = spark.createDataFrame([(1, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(Exception, match="too large"):
        covertree.compressed(df).count()


# --- odd texts


@pytest.mark.parametrize("name", ["anchors", "importance"])
def test_odd_texts(spark, name):
    long = "lorem ipsum dolor sit amet " * 20_000
    rows = [(1, "Same few words"), (1, "same FEW words"), (1, "something else altogether than this"), (2, None), (3, ""), (4, " \n\t "), (5, long), (6, long), (None, "no id"), (7, "x" * 50_000), (8, "émoji \U0001f642 ünd")]
    df = spark.createDataFrame([(*r, 1, 1, "c", "c", 1, "c", 1) for r in rows], KIND)
    target = spark.createDataFrame([(1, "same few words"), (None, None), (1, "")], "item_id long, text string")
    run = anchors.near_duplicates if name == "anchors" else lambda d: importance.resampled(d, target)
    out = run(df).collect()
    assert len(out) == len(rows) and run(df.limit(0)).count() == 0
    if name == "anchors":
        of = {r["doc_id"]: r["component_id"] for r in out}
        assert of[None] is None and of[1] == 1 and of[2] == of[3] == of[4] == 2 and of[5] == of[6] == 5
        assert {r["fingerprint"] for r in out if r["doc_id"] in (2, 3, 4)} == {"0" * 16}
    else:
        assert {r["n_features"] for r in out if r["doc_id"] in (2, 3, 4)} == {0}
        assert importance.resampled(df, target.limit(0)).count() == len(rows)
