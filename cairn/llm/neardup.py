"""Near-duplicate documents by HyperMinHash registers, banded, then confirmed on full shingle sets."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import among, linked, ship, small, text_of, written

#: 64 buckets; each register holds 6 bits of leading-zero count and 10 bits of mantissa.
BUCKET_BITS, MANTISSA_BITS = 6, 10
REGISTERS = 1 << BUCKET_BITS
EMPTY = 0xFFFF
#: 16 bands of 4 registers: the odds of no common band are 8 in a million at similarity 0.85, 0.0002 at 0.8.
BAND = 4


def registers(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """One row of 16-bit registers for each group of ascending, distinct 64-bit hashes."""
    groups = len(start) - 1
    out = np.full((groups, REGISTERS), EMPTY, np.uint16)
    if not len(values):
        return out
    group = np.repeat(np.arange(groups), np.diff(start))
    bucket = (values >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    slot = group * REGISTERS + bucket
    first = np.ones(len(values), bool)
    first[1:] = slot[1:] != slot[:-1]  # ascending: the first of a bucket is its minimum
    low = (values[first] << np.uint64(BUCKET_BITS)) | np.uint64((1 << BUCKET_BITS) - 1)
    exponent = np.frexp(low.astype(np.float64))[1].astype(np.int64)  # bit length, one more where rounding carries
    exponent -= (low >> np.minimum(exponent - 1, 63).astype(np.uint64) == 0).astype(np.int64)
    zeros = 64 - exponent
    mantissa = (low << np.minimum(zeros + 1, 63).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[slot[first]] = (np.minimum(zeros, 62) << MANTISSA_BITS | mantissa.astype(np.int64)).astype(np.uint16)
    return out


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard estimates from register rows, less the agreements that compressed registers make by chance."""
    used = (a != EMPTY) | (b != EMPTY)
    same = ((a == b) & used).sum(axis=1)
    ratio = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    chance = 0.169919487 * 2.0 ** (BUCKET_BITS - MANTISSA_BITS) * 4 * ratio / (1 + ratio) ** 2
    return np.maximum(same - chance, 0) / np.maximum(used.sum(axis=1), 1)


def _shingles(column, width: int):
    word, first = tx.words(column, tx.NOT_SPACE)
    return tx.distinct(*tx.windows(word, first, width))


def signatures(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n (size of the shingle set), k1 and k2 (128 bits that identify the set), sig (registers as bytes)."""

    def run(batches):
        for batch in tx.slices(batches):
            values, start = _shingles(batch.column(1), width)
            if len(values):
                sums = [np.concatenate([[0], np.cumsum(tx.mix(values ^ np.uint64(c)))]).astype(np.uint64) for c in (0x8C9F8B1E, 0x51ED270B27B4F3CF)]
            else:
                sums = [np.zeros(1, np.uint64)] * 2
            keys = [(s[start[1:]] - s[start[:-1]]).view(np.int64) for s in sums]
            sig = registers(values, start)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(start).astype(np.int64)), pa.array(keys[0]), pa.array(keys[1]), pa.array([r.tobytes() for r in sig], pa.binary())],
                names=["doc_id", "n", "k1", "k2", "sig"],
            )

    ship(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, n long, k1 long, k2 long, sig binary")


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int = 5) -> DataFrame:
    """node, items (its ascending shingle hashes as bytes) for the documents among nodes, and perhaps some more."""
    rows, passing = among(docs.select("doc_id", text_of(docs).alias("text")), "doc_id", nodes)

    def run(batches):
        for batch in tx.slices(passing(batches)):
            values, start = _shingles(batch.column(1), width)
            data = values.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([data[8 * a : 8 * b] for a, b in zip(start[:-1], start[1:], strict=True)], pa.binary())], names=["node", "items"])

    return rows.mapInArrow(run, "node long, items binary")


def _items(sets: DataFrame) -> DataFrame:
    """node, item: a row for each shingle of a set."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                data = part.column(1).to_pylist()
                node = np.repeat(part.column(0).to_numpy(), [len(x) // 8 for x in data])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.frombuffer(b"".join(data), np.int64))], names=["node", "item"])

    return sets.select("node", "items").mapInArrow(run, "node long, item long")


def _likely(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Pairs whose estimated similarity is at least ``least``."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in (2, 3))
                keep = estimate(x, y, b.column(4).to_numpy(), b.column(5).to_numpy()) >= least
                yield b.select(["a", "b"]).filter(pa.array(keep))

    side = lambda k: nodes.select(F.col("node").alias(k), F.col("sig").alias(f"s{k}"), F.col("n").alias(f"n{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb").mapInArrow(run, "a long, b long")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def _measured(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the sizes of both full sets and of what they have in common."""

    def run(batches):
        for b in batches:
            step = 2000
            for at in range(0, b.num_rows, step):
                part = b.slice(at, step)
                x, y = part.column(2), part.column(3)
                nx, ny = (np.array([len(v) // 8 for v in c.to_pylist()], np.int64) for c in (x, y))
                values = np.concatenate([np.frombuffer(b"".join(c.to_pylist()), np.uint64) for c in (x, y)])
                pair = np.concatenate([np.repeat(np.arange(part.num_rows), nx), np.repeat(np.arange(part.num_rows), ny)])
                order = np.lexsort((values, pair))
                values, pair = values[order], pair[order]
                both = np.bincount(pair[1:][(values[1:] == values[:-1]) & (pair[1:] == pair[:-1])], minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nx), pa.array(ny), pa.array(both.astype(np.int64))], names=["a", "b", "na", "nb", "common"])

    side = lambda k: sets.select(F.col("node").alias(k), F.col("items").alias(f"i{k}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ia", "ib").mapInArrow(run, "a long, b long, na long, nb long, common long")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 85, den: int = 100) -> DataFrame:
    """Link documents whose shingle sets have den * |A & B| >= num * |A | B|.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable over
    links) and kept (doc_id = component_id) for every row of ``docs``; other
    columns are ignored, whatever their names.

    * A null or empty text, or one without words, has no shingles and links nothing.
    * A row with a null doc_id takes no part: null component, kept.
    * Rows that repeat a doc_id are one document, which has all links of its
      texts, so they share a component; n_shingles is each row's own.
    * An empty table gives none.  Long texts count whole.

    Plan.  Equal sets fold into one node first, so copies cost one grouped
    minimum.  Nodes that share a band of registers are compared with one hub of
    that band, the node whose bands are the most common: a group of copies of
    one original meets around it, in as many comparisons as it has members.
    What a band still holds apart goes to ``_leftover``.  A pair is estimated on
    registers (0.25 below the threshold or more passes: over five standard
    errors), then decided on full sets.
    """
    sigs = written(signatures(docs, width), "signatures")
    nodes = written(sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min("n").alias("n"), F.min("sig").alias("sig")), "nodes")
    several = small(nodes.groupBy("node").count().where("count > 1").select("node"))  # ids with several texts that no smaller id has

    rows = nodes.select("node", "n", F.posexplode(_keys()).alias("band", "key")).where("key IS NOT NULL")
    shared = written(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared")  # written, so that Spark can split the join of a key with many rows
    rows = written(rows.join(shared, "key"), "bands")
    fame = rows.groupBy("node").agg(F.sum("size").alias("fame"))
    edges = docs.sparkSession.createDataFrame([], "a long, b long")
    if not rows.isEmpty():
        hubs = rows.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("hub"), "n")).alias("h"))
        hubs = written(hubs.select("key", (-F.col("h.hub")).alias("hub"), F.col("h.n").alias("hub_n")), "hubs")
        pairs = rows.join(hubs, "key").where(f"node <> hub AND {den} * least(n, hub_n) >= {num} * greatest(n, hub_n)")
        pairs = written(_likely(pairs.select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct(), nodes, num / den - 0.55), "pairs")
        star = written(_measured(pairs, shingle_sets(docs, _ends(pairs), width)), "measured")
        edges = star.where(f"{den} * common >= {num} * (na + nb - common)").select("a", "b")
        edges = edges.unionByName(_leftover(docs, nodes, several, rows, hubs, star, edges, width, num, den))

    # documents with several texts: their nodes belong together
    repeats = sigs.where("n > 0 AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("k1").alias("x"), F.max("k1").alias("y"), F.min("k2").alias("z"), F.max("k2").alias("w")).where("x <> y OR z <> w").select("doc_id")
    of_repeats = sigs.where("n > 0").join(small(written(repeats, "repeats")), "doc_id").join(nodes.select("k1", "k2", "node"), ["k1", "k2"]).select("doc_id", "node")
    own = of_repeats.groupBy("doc_id").agg(F.min("node").alias("least"))
    edges = edges.unionByName(of_repeats.join(own, "doc_id").select(F.col("node").alias("a"), F.col("least").alias("b")))
    parts = written(linked(edges), "parts")

    classes = nodes.join(parts, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component_id"))
    some = sigs.where("n > 0 AND doc_id IS NOT NULL").join(classes, ["k1", "k2"]).select("doc_id", "n", "component_id")
    none = sigs.where("n = 0 OR doc_id IS NULL").join(small(of_repeats_component(own, parts)), "doc_id", "left").select("doc_id", "n", F.coalesce("component", "doc_id").alias("component_id"))
    out = some.unionByName(none)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _keys():
    """A row's band keys, null for a band without any register set."""
    band = lambda b: F.substring("sig", 2 * BAND * b + 1, 2 * BAND)
    return F.array(*[F.when(band(b) != F.lit(b"\xff" * 2 * BAND), F.xxhash64(band(b), F.lit(b))) for b in range(REGISTERS // BAND)])


def _leftover(docs, nodes, several, rows, hubs, star, edges, width: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between nodes that share a band but no component of ``edges``.

    Exact bounds come first, each from a grouped pass over the nodes' shingles.
    A shingle is lone if no other of these nodes has it.  A node with too many
    lone ones links with nothing and goes; this is done twice.  The rest is
    compared with a second hub of the band, one outside its largest component.

    For what is apart still: with A the shingles that a node has and its
    band's hub hasn't, and R those that the hub has and it hasn't, two nodes
    differ in at least lone + lone' + |(A - lone) - (A' - lone')| + |R - R'|
    shingles.  The numbers of a node are its class in the band; classes are
    compared, not nodes, and only the members of classes that may link, of
    which one is outside the largest component, are paired.  So a group of near
    copies costs as many rows as it has members, but for pairs that no bound
    tells from a link.
    """
    linking = f"{den} * common >= {num} * (na + nb - common)"
    parts = written(linked(edges), "parts")
    split = rows.join(parts, "node", "left").select("key", "band", "node", "n", "size", F.coalesce("component", "node").alias("part"))
    mixed = written(split.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key"), "mixed")
    split = written(split.join(mixed, "key").join(hubs.select("key", "hub"), "key").join(several.withColumn("more", F.lit(True)), "node", "left"), "split")
    if split.isEmpty():
        return edges.limit(0)
    sets = written(shingle_sets(docs, split.select("node").distinct(), width), "sets")
    for _ in range(2):
        once = _items(sets).groupBy("item").agg(F.count("*").alias("c"), F.min("node").alias("node")).where("c = 1")
        lone = once.groupBy("node").agg(F.count("*").alias("l"))
        split = split.drop("lone").join(lone, "node", "left").withColumn("lone", F.when(F.col("more") | (F.col("node") == F.col("hub")), 0).otherwise(F.coalesce("l", F.lit(0)))).drop("l")
        split = written(split.where(f"node = hub OR {den} * (n - lone) >= {num} * n"), "split")
        mixed = split.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
        split = written(split.join(mixed, "key"), "split")
        sets = written(sets.join(split.select("node").distinct(), "node", "left_semi"), "sets")
    if split.isEmpty():
        return edges.limit(0)

    # a second hub, and the components anew
    large = split.groupBy("key", "part").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("part", F.struct("c", "part")).alias("large"))
    outside = written(split.join(large, "key").where("part <> large"), "outside")
    fame = outside.groupBy("node").agg(F.sum("size").alias("fame"))
    second = outside.join(fame, "node").groupBy("key").agg(F.max(F.struct("fame", (-F.col("node")).alias("hub"), "n", "part")).alias("h"))
    pairs = outside.drop("hub").join(second.select("key", (-F.col("h.hub")).alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.part").alias("hub_part")), "key")
    pairs = pairs.where(f"part <> hub_part AND {den} * least(n - lone, hub_n) >= {num} * greatest(n, hub_n)").select(F.greatest("node", "hub").alias("a"), F.least("node", "hub").alias("b")).distinct()
    pairs = _likely(pairs.join(star.select("a", "b"), ["a", "b"], "left_anti"), nodes, num / den - 0.25)
    more = written(_measured(pairs, sets).where(linking).select("a", "b"), "links")
    parts = written(linked(edges.unionByName(more)), "parts")

    # classes of nodes in a band, by their numbers
    apart = star.select(F.col("a").alias("node"), F.col("b").alias("hub"), (F.col("na") - F.col("common")).alias("added"), (F.col("nb") - F.col("common")).alias("gone"))
    apart = apart.unionByName(star.select(F.col("b").alias("node"), F.col("a").alias("hub"), (F.col("nb") - F.col("common")).alias("added"), (F.col("na") - F.col("common")).alias("gone")))
    apart = apart.groupBy("node", "hub").agg(F.count("*").alias("c"), F.min("added").alias("added"), F.min("gone").alias("gone")).where("c = 1")
    rest = split.drop("part", "size").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node")).drop("component")
    rest = rest.join(large, "key").join(apart, ["node", "hub"], "left")
    known = lambda c: F.when(F.col("more"), -1).when(F.col("node") == F.col("hub"), 0).otherwise(F.coalesce(c, F.lit(-1)))
    rest = rest.select("key", "band", "node", "part", F.struct("n", "lone", known("added").alias("added"), known("gone").alias("gone"), (F.col("part") == F.col("large")).alias("large")).alias("kind"))
    rest = written(rest.join(nodes.select("node", _keys().alias("keys")), "node"), "rest")
    step = max(math.log(den / num), 1e-6) * 1.0001
    size = F.floor(F.log(F.col("kind.n")) / step)
    kinds = rest.groupBy("key", "kind").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    x = kinds.select("key", F.col("kind").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"), F.explode(F.array(size, size + 1)).alias("at"))
    y = kinds.select("key", F.col("kind").alias("y"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"), size.alias("at"))
    far = "x.lone + y.lone + CASE WHEN x.added >= 0 AND y.added >= 0 THEN abs((x.added - x.lone) - (y.added - y.lone)) + abs(x.gone - y.gone) ELSE 0 END"
    may = f"x <= y AND NOT (x.large AND y.large) AND NOT (xlo = yhi AND xhi = ylo AND xlo = ylo) AND {den + num} * ({far}) <= {den - num} * (x.n + y.n) AND {den} * least(x.n - x.lone, y.n - y.lone) >= {num} * (greatest(x.n - x.lone, y.n - y.lone) + x.lone + y.lone)"
    kinds = written(x.join(y, ["key", "at"]).where(may).select("key", "x", "y"), "kinds")
    p, q = (rest.select("key", F.col("kind").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("band", "node", "part", "keys")]) for k in "xy")
    again = "coalesce(arrays_overlap(slice(keys_x, 1, band_x), slice(keys_y, 1, band_x)), false)"  # in an earlier band of theirs
    pairs = kinds.join(p, ["key", "x"]).join(q, ["key", "y"]).where(f"node_x <> node_y AND part_x <> part_y AND NOT {again}")
    pairs = pairs.select(F.greatest("node_x", "node_y").alias("a"), F.least("node_x", "node_y").alias("b")).distinct()
    return more.unionByName(_measured(_likely(pairs, nodes, num / den - 0.25), sets).where(linking).select("a", "b"))


def of_repeats_component(own: DataFrame, parts: DataFrame) -> DataFrame:
    """doc_id, component of the documents that have several texts: an empty one among them goes with the others."""
    return own.join(parts, own["least"] == parts["node"], "left").select("doc_id", F.coalesce("component", "least").alias("component"))


def deduplicated(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without those that are not kept; all columns of ``docs``, whatever their names.

    Of linked documents the one with the smallest doc_id stays.  Rows without
    an id, and texts without words, stay; rows that repeat an id stay or go
    together.  An empty table gives none.
    """
    gone = written(near_duplicates(docs, width, num, den).where("NOT kept").select("doc_id").distinct(), "gone")
    return docs.join(small(gone), "doc_id", "left_anti").select(docs.columns)
