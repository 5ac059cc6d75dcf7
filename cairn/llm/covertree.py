"""Product codes of vectors by Lloyd's rounds over cover trees: whole subtrees go to an entry where the triangle inequality allows."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, small, written

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of one tree, and how many of them there are to a centre.
CHUNK, CENTRES = 1024, 4
#: Components beyond this have distances that a bigint can't hold.
MOST = 1 << 28


# --- trees


def levels(points: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """A cover tree of some rows: an order of the rows, and for each level the (start, end, radius) of its nodes in that order.

    Centres are picked farthest first.  Those that are picked while the farthest
    row is at least R / 2**k away are the nodes of level k: they are that far
    apart, and cover all rows within it.  A node's parent is the nearest centre of the level
    above.  A node is a run of rows that begins with its centre; its radius is
    the largest distance from the centre to a row of the run.
    """
    n = len(points)
    p = points.astype(np.float64) - points[0]
    norm = (p * p).sum(axis=1)
    square = np.maximum(norm[:, None] + norm - 2 * p @ p.T, 0)
    near, picks, reach = square[0].copy(), [0], []
    for _ in range(max(1, n // CENTRES) - 1):
        k = int(near.argmax())
        if near[k] == 0:
            break
        picks.append(k)
        reach.append(near[k])
        near = np.minimum(near, square[k])
    picks, reach = np.array(picks), np.sqrt(np.array([*reach, 0.0]))
    sizes, at = [1], reach[0] / 2 if len(picks) > 1 else 0.0
    while sizes[-1] < len(picks):
        sizes.append(max(sizes[-1] + 1, int(np.searchsorted(-reach[:-1], -at, "right")) + 1))
        at /= 2
    own = square[:, picks].argmin(axis=1)  # each row's centre, as a number of a pick
    own[picks] = np.arange(len(picks))
    above = [own]
    for size in reversed(sizes[:-1]):
        up = square[np.ix_(picks, picks[:size])].argmin(axis=1)
        up[:size] = np.arange(size)
        above.insert(0, up[above[0]])
    points = points.astype(np.int64)
    last = np.ones(n, np.int64)
    last[picks] = 0  # a centre is the first of its run
    order = np.lexsort([last, *reversed(above)])
    out = []
    for label in above:
        label = label[order]
        start = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1]]))
        end = np.append(start[1:], n)
        apart = points[order] - points[np.repeat(order[start], end - start)]  # whole numbers: never too small a radius
        radius = np.sqrt(np.maximum.reduceat((apart * apart).sum(axis=1), start).astype(np.float64))
        out.append(np.stack([start, end, radius], axis=1))
    return order, out


def _dump(points: np.ndarray) -> dict:
    order, nodes = levels(points)
    flat = np.concatenate(nodes)
    return {"rows": order.astype("<u4").tobytes(), "points": points[order].astype("<i4").tobytes(), "sizes": np.array([len(x) for x in nodes], "<u4").tobytes(), "nodes": flat.astype("<f8").tobytes()}


def assigned(points: np.ndarray, sizes: np.ndarray, nodes: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The entry of each row of a tree, sums and counts of the rows of each entry, and how many rows were compared one by one.

    A node goes as a whole if its centre's nearest entry is nearer than all
    others by over twice the radius; sums come from the running sums of the
    tree's rows.  The others' children are looked at, and at the last level
    their rows, in whole numbers: ties go to the first entry.
    """
    total = np.concatenate([np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, axis=0)])
    code = np.zeros(len(points), np.int64)
    sums, counts = np.zeros(book.shape, np.int64), np.zeros(len(book), np.int64)
    unsure = np.array([[0, len(points)]])  # runs of rows without an entry so far
    at = 0
    for size in sizes:
        level = nodes[at : at + size]
        at += size
        start, end = level[:, 0].astype(np.int64), level[:, 1].astype(np.int64)
        of = np.searchsorted(unsure[:, 0], start, "right") - 1
        open_ = (of >= 0) & (end <= unsure[np.maximum(of, 0), 1])
        start, end, radius = start[open_], end[open_], level[open_, 2]
        far = np.sqrt(distances(points[start], book).astype(np.float64))
        best = far.argmin(axis=1)
        first = far[np.arange(len(far)), best]
        far[np.arange(len(far)), best] = np.inf
        sure = first + 2 * radius < far.min(axis=1, initial=np.inf) * (1 - 1e-9) - 1e-6
        entry = best[sure]
        a, b = start[sure], end[sure]
        np.add.at(sums, entry, total[b] - total[a])
        np.add.at(counts, entry, b - a)
        code += np.bincount(a, entry, len(points) + 1).astype(np.int64).cumsum()[:-1] - np.bincount(b, entry, len(points) + 1).astype(np.int64).cumsum()[:-1]
        unsure = np.stack([start[~sure], end[~sure]], axis=1)
        if not len(unsure):
            return code, sums, counts, 0
    rows = np.repeat(unsure[:, 0] - np.concatenate([[0], np.cumsum(unsure[:, 1] - unsure[:, 0])[:-1]]), unsure[:, 1] - unsure[:, 0])
    rows = rows + np.arange(len(rows))
    entry = distances(points[rows], book).argmin(axis=1)
    code[rows] = entry
    np.add.at(sums, entry, points[rows])
    np.add.at(counts, entry, 1)
    return code, sums, counts, len(rows)


def distances(points: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers."""
    out = np.zeros((len(points), len(book)), np.int64)
    for k in range(points.shape[1]):
        out += (points[:, k : k + 1] - book[:, k]) ** 2
    return out


# --- Spark


def whole(vectors: DataFrame, parts: int = PARTS) -> DataFrame:
    """vec_id, label, v (whole components) of the rows that are kept: finite vectors of the length that the first one has."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & (F.size(x) > 0) & (F.size(x) % parts == 0)
    rows = vectors.where(good).select("vec_id", "label", x.alias("_x"))
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), F.size("_x")).select(F.size("_x").alias("n")).first()
    length = first["n"] if first else parts
    large = F.exists("_x", lambda c: F.abs(c.cast("double")) * SCALE >= MOST)
    v = F.when(large, F.raise_error(F.concat(F.lit("components are too large for whole-number distances: vec_id "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))).otherwise(F.transform("_x", lambda c: F.floor(c.cast("double") * SCALE)))
    return rows.where(F.size("_x") == length).select("vec_id", "label", v.alias("v"))


def first_book(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """The parts of the vectors with the smallest ids, as (part, entry, component); equal ids go by their components."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r["v"] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)


_TREE = "chunk long, part int, ids binary, rows binary, points binary, sizes binary, nodes binary"


def grown(rows: DataFrame, parts: int = PARTS) -> DataFrame:
    """A row for each tree: each partition's vectors, CHUNK at a time, have a tree for each part.

    ``ids`` holds the vectors' places, an id that the written rows carry, with
    the first part.
    """

    def run(frames):
        for frame in frames:
            for at in range(0, len(frame), CHUNK):
                some = frame.iloc[at : at + CHUNK]
                ids = some["place"].to_numpy(np.int64)
                v = np.stack(some["v"].to_numpy()).astype(np.int64).reshape(len(some), parts, -1)
                trees = [{"chunk": int(ids[0]), "part": k, "ids": None if k else ids.astype("<i8").tobytes()} | _dump(v[:, k]) for k in range(parts)]
                yield pd.DataFrame(trees)

    ship(rows.sparkSession)
    return rows.select("place", "v").mapInPandas(run, _TREE)


def _loaded(row, width: int):
    points = np.frombuffer(row.points, "<i4").reshape(-1, width).astype(np.int64)
    return points, np.frombuffer(row.sizes, "<u4").astype(np.int64), np.frombuffer(row.nodes, "<f8").reshape(-1, 3)


def moved(trees: DataFrame, book: np.ndarray) -> np.ndarray:
    """The next codebook: floored means; entries that no row has stay.  A task sends its sums, a number for each component of the book."""
    width = book.shape[2]

    def run(frames):
        sums, counts = np.zeros(book.shape, np.int64), np.zeros(book.shape[:2], np.int64)
        for frame in frames:
            for row in frame.itertuples():
                _, s, c, _ = assigned(*_loaded(row, width), book[row.part])
                sums[row.part] += s
                counts[row.part] += c
        part, entry = np.nonzero(counts)
        yield pd.DataFrame({"part": part, "entry": entry, "n": counts[part, entry], "s": list(sums[part, entry])})

    got = trees.mapInPandas(run, "part int, entry int, n long, s array<long>").groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[k]) for k in range(width)]).alias("s"))
    out = book.copy()
    for r in got.collect():  # parts times entries
        out[r["part"], r["entry"]] = [x // r["n"] for x in r["s"]]
    return out


def coded(trees: DataFrame, book: np.ndarray) -> DataFrame:
    """place, codes (a byte for each part), error of every vector of the trees; the parts of a chunk meet in a group of CHUNK rows."""
    parts, _, width = book.shape

    def one(frames):
        for frame in frames:
            out = []
            for row in frame.itertuples():
                points, sizes, nodes = _loaded(row, width)
                code = assigned(points, sizes, nodes, book[row.part])[0]
                error = ((points - book[row.part][code]) ** 2).sum(axis=1)
                rows = np.frombuffer(row.rows, "<u4")
                back = np.empty(len(rows), np.int64)
                back[rows] = np.arange(len(rows))
                out.append({"chunk": row.chunk, "part": row.part, "ids": row.ids, "codes": code[back].astype("<u1").tobytes(), "errors": error[back].astype("<i8").tobytes()})
            yield pd.DataFrame(out, columns=["chunk", "part", "ids", "codes", "errors"])

    def all_parts(frames):
        for frame in frames:
            out = {"place": [], "codes": [], "error": []}
            for row in frame.itertuples():
                got = {x["part"]: x for x in row.parts}
                ids = np.frombuffer(got[0]["ids"], "<i8")
                codes = np.stack([np.frombuffer(got[k]["codes"], "<u1") for k in range(parts)], axis=1)
                out["place"].append(ids)
                out["codes"] += [c.tobytes().hex() for c in codes]
                out["error"].append(sum(np.frombuffer(got[k]["errors"], "<i8") for k in range(parts)))
            yield pd.DataFrame({"place": np.concatenate([*out["place"], np.zeros(0, np.int64)]), "code": pd.Series(out["codes"], dtype=object), "error": np.concatenate([*out["error"], np.zeros(0, np.int64)])})

    each = trees.mapInPandas(one, "chunk long, part int, ids binary, codes binary, errors binary")
    whole_ = each.groupBy("chunk").agg(F.collect_list(F.struct("part", "ids", "codes", "errors")).alias("parts"))
    return whole_.mapInPandas(all_parts, "place long, code string, error long")


def trained(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """The trees of ``rows`` (place, v, vec_id) and the codebook after all rounds."""
    trees, book = written(grown(rows, parts), "trees"), first_book(rows, parts, entries)
    for _ in range(rounds):
        book = moved(trees, book)
    return trees, book


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """Product codes of vectors: vec_id, code, error, label_error, codebooks_sha256.

    Components are floored multiples of 1 / 4096, so that all sums are exact
    and the same under any partitioning.  Dropped are rows whose vector is null
    or empty, holds null or non-finite components, can't be cut into ``parts``,
    or is of another length than that of the smallest vec_id.  Components of 65,536
    and more are an error.  With fewer rows than entries the codebook is as
    small.  Rows that repeat count each; ties go to the lower entry; a null
    vec_id comes last among the ids; null labels are one label.  Other columns
    are ignored.  An empty table gives none.

    Plan.  The rows are written once with a place; each partition grows trees
    of CHUNK vectors, which are written too.  A round reads them, and sends
    sums only.  ``label_error`` is a grouped sum that is joined back null-safely.
    """
    rows = written(whole(vectors, parts).withColumn("place", F.monotonically_increasing_id()), "vectors")
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if rows.isEmpty():
        return vectors.sparkSession.createDataFrame([], schema)
    trees, book = trained(rows, parts, entries, rounds)
    out = written(rows.select("place", "vec_id", "label").join(coded(trees, book), "place"), "codes")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    out = out.join(small(sums), out["label"].eqNullSafe(F.col("_label")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(book)).alias("codebooks_sha256"))


def sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The rows of ``compressed`` in DuckDB, for vectors of one length."""
    nearest = "list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    text = f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rid, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
parts AS MATERIALIZED (SELECT rid, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS v FROM kept, (SELECT unnest(range({parts})) AS p)),
book0 AS MATERIALIZED (SELECT p, rid - 1 AS e, v FROM parts WHERE rid <= {entries})"""
    for k in range(rounds + 1):
        text += f""",
near{k} AS MATERIALIZED (SELECT p.rid, p.p, min(struct_pack(d := {nearest}, e := c.e)) AS m FROM parts p JOIN book{k} c ON c.p = p.p GROUP BY 1, 2)"""
        if k < rounds:
            text += f""",
sums{k} AS (SELECT p, e, list(CAST(m AS BIGINT) ORDER BY i) AS v FROM (
  SELECT p, e, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) / count(*) AS m FROM (
    SELECT n.p, n.m.e AS e, unnest(q.v) AS x, unnest(range(len(q.v))) AS i FROM near{k} n JOIN parts q ON q.rid = n.rid AND q.p = n.p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(s.v, b.v) AS v FROM book{k} b LEFT JOIN sums{k} s ON s.p = b.p AND s.e = b.e)"""
    return text + f""",
codes AS (SELECT rid, string_agg(lpad(lower(to_hex(m.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM near{rounds} GROUP BY 1),
digest AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN codes USING (rid), digest
"""
