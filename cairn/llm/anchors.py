"""SimHash near duplicates by anchor points: fingerprints meet at the words of a covering code."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import linked, ship, small, text_of, written

BITS, SEED, WIDTH, DIFFER = 64, 42, 4, 4
#: A fingerprint's bits are cut into so many parts: of two that differ in DIFFER bits, one part differs in a third of them at most.
PARTS = 3
#: Anchors of a part: Hamming words on its lowest 15 bits, any bits above them.  The radius is 1.
HAMMING, RADIUS = 15, 1
#: Shingles whose bits are counted at a time; rows of a side that meet at once; pairs compared at a time.
STEP, BLOCK, PAIRS = 1 << 16, 4096, 1 << 20


def _joined(column) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased words of all texts with one space between, each word's start and end, and the number of each text's first word."""
    data, off = tx.raw(column)
    data = tx.LOWER[data]
    starts, ends, first = tx.spans(data, off, tx.NOT_SPACE)
    inner = np.ones(len(starts), bool)
    inner[first[1:][np.diff(first) > 0] - 1] = False  # a text's last word has no space after it
    keep = tx.NOT_SPACE[data]
    data[ends[inner]] = 0x20
    keep[ends[inner]] = True
    at = np.cumsum(keep)[starts] - 1 if len(starts) else starts
    return data[keep].tobytes(), at, at + ends - starts, first


def simhash(column, width: int = WIDTH) -> np.ndarray:
    """The fingerprint of each text: a bit is set if it is set in over half of the shingles' hashes; zero without words."""
    words, starts, ends, first = _joined(column)
    count = np.diff(first)
    made = np.maximum(count - width + 1, (count > 0).astype(count.dtype))
    text = np.repeat(np.arange(len(made)), made)
    begin = np.arange(len(text)) + np.repeat(first[:-1] - (np.cumsum(made) - made), made)
    stop = np.minimum(begin + width, np.repeat(first[1:], made)) - 1
    ones = np.zeros((len(made), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(text), STEP):
        a, b, t = starts[begin[at : at + STEP]].tolist(), ends[stop[at : at + STEP]].tolist(), text[at : at + STEP]
        h = np.fromiter((digest(words[i:j], SEED) for i, j in zip(a, b, strict=True)), ">u8", len(t))
        edge = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        ones[t[edge]] += np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1), edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > made[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a bigint) of every row."""

    def run(batches):
        for batch in tx.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(simhash(batch.column(1), width).view(np.int64))], names=["doc_id", "fp"])

    ship(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, fp long")


# --- the code and its anchors


def part_widths(parts: int = PARTS) -> list[int]:
    """Bits of each part, the first one lowest."""
    return [BITS // parts + (k < BITS % parts) for k in range(parts)]


def syndrome(word: np.ndarray) -> np.ndarray:
    """Zero for a Hamming word; else the number, from one, of the bit to flip."""
    out = np.zeros(word.shape, np.int64)
    for k in range(HAMMING):
        out ^= (word >> k & 1) * (k + 1)
    return out


def patterns(width: int, reach: int) -> list[np.ndarray]:
    """For each syndrome the bits to flip that give an anchor, up to ``reach`` of them; the fewest first."""
    masks = np.array([sum(1 << k for k in c) for n in range(reach + 1) for c in combinations(range(width), n)], np.int64)
    kind = syndrome(masks)
    return [masks[kind == s] for s in range(HAMMING + 1)]


def reached(fps: np.ndarray, parts: int = PARTS, differ: int = DIFFER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within the radius and the part's share of the threshold: row numbers, anchors (the part in the high bits), and whether it is the row's own."""
    rows, anchors, own, shift = [], [], [], 0
    for part, width in enumerate(part_widths(parts)):
        word = (fps >> np.uint64(shift)).astype(np.int64) & ((1 << width) - 1)
        kind, shift = syndrome(word), shift + width
        for s, flips in enumerate(patterns(width, RADIUS + differ // parts)):
            at = np.flatnonzero(kind == s)
            if len(at):
                rows.append(np.repeat(at, len(flips)))
                anchors.append((word[at][:, None] ^ flips | part << 40).ravel())
                own.append(np.tile(np.arange(len(flips)) == 0, len(at)))
    join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
    return join(rows, np.int64), join(anchors, np.int64), join(own, bool)


def dealt(nodes: DataFrame, parts: int = PARTS, differ: int = DIFFER) -> DataFrame:
    """anchor, own, fp: a row for each anchor that a fingerprint goes to."""

    def run(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy()
            rows, anchors, own = reached(fps.view(np.uint64), parts, differ)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(own), pa.array(fps[rows])], names=["anchor", "own", "fp"])

    return nodes.select("fp").mapInArrow(run, "anchor long, own boolean, fp long")


# --- comparison


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few links as hold together what the given links do: each end with the least of its component."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, low = at[: len(a)], at[len(a) :], np.arange(len(ends))
    while True:
        least = np.minimum(low[x], low[y])
        new = low.copy()
        np.minimum.at(new, x, least)
        np.minimum.at(new, y, least)
        np.minimum.at(new, low[x], least)
        np.minimum.at(new, low[y], least)
        new = new[new]
        if (new == low).all():
            break
        low = new
    apart = np.flatnonzero(low != np.arange(len(ends)))
    return ends[apart], ends[low[apart]]


def links(group: np.ndarray, home: np.ndarray, guest: np.ndarray, fp: np.ndarray, differ: int):
    """Links between the homes and the guests of each group of rows (``group`` ascends), a forest for each lot of pairs."""
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    guests = np.flatnonzero(guest)
    first = np.searchsorted(guests, np.append(starts, len(group)))
    at = np.flatnonzero(home)
    of = np.searchsorted(starts, at, "right") - 1
    many = first[of + 1] - first[of]
    total = np.cumsum(many)
    lo = 0
    while lo < len(at):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
        n = many[lo:hi]
        x = np.repeat(at[lo:hi], n)
        y = guests[np.arange(n.sum()) + np.repeat(first[of[lo:hi]] - (np.cumsum(n) - n), n)]
        near = np.flatnonzero(np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64)) <= differ)
        x, y = fp[x[near]], fp[y[near]]
        apart = x != y
        if apart.any():
            yield forest(x[apart], y[apart])
        lo = hi


def compared(rows: DataFrame, differ: int = DIFFER) -> DataFrame:
    """Links (a, b) of fingerprints that meet at an anchor and differ in few bits.

    At an anchor its own fingerprints meet all that were dealt to it.  An anchor
    of more than BLOCK rows is cut into blocks of both sides, and each pair of
    blocks is a group of its own.  A lot of pairs gives a forest of its links.
    """
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("own").cast("int")).alias("m"))
    hot = written(sizes.where(f"n > {BLOCK} AND m > 0").select("anchor", F.ceil(F.col("m") / BLOCK).cast("int").alias("hosts"), F.ceil(F.col("n") / BLOCK).cast("int").alias("guests")), "hot")
    plain = lambda df: df.select("anchor", F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("own").alias("home"), F.lit(True).alias("guest"), "fp")
    cells = plain(rows)
    if not hot.isEmpty():
        some = small(hot)
        cells = plain(rows.join(some, "anchor", "left_anti"))
        large = rows.join(some, "anchor").withColumn("_h", F.xxhash64("fp"))
        block = lambda n: F.pmod("_h", n).cast("int")
        side = lambda df, i, j, home: df.select("anchor", i.alias("i"), j.alias("j"), F.lit(home).alias("home"), F.lit(not home).alias("guest"), "fp")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        cells = cells.unionByName(side(large.where("own"), block(F.col("hosts")), every("guests"), True)).unionByName(side(large, every("hosts"), block(F.col("guests")), False))

    def run(batches):
        held, count = [], 0
        names = ["cell", "home", "guest", "fp"]

        def lots(table, last):
            cell = table.column("cell").to_numpy()
            end = len(cell) if last else int(np.searchsorted(cell, cell[-1]))
            flag = lambda c: table.column(c).to_numpy(zero_copy_only=False)[:end]
            if end:
                for a, b in links(cell[:end], flag("home"), flag("guest"), table.column("fp").to_numpy()[:end], differ):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= 16 * BLOCK:
                table = pa.Table.from_batches(held).combine_chunks()
                yield from lots(table, False)
                cell = table.column("cell").to_numpy()
                rest = table.slice(int(np.searchsorted(cell, cell[-1]))).combine_chunks()
                held, count = rest.to_batches(), 0  # rows of a cell that isn't complete
        if held:
            yield from lots(pa.Table.from_batches(held).select(names), True)

    cells = cells.select(F.xxhash64("anchor", "i", "j").alias("cell"), "home", "guest", "fp")
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = WIDTH, differ: int = DIFFER, parts: int = PARTS) -> DataFrame:
    """Link documents whose SimHash fingerprints differ in at most ``differ`` bits.

    Returns doc_id, fingerprint (16 hex digits) and component_id (smallest
    doc_id reachable over links) for every row of ``docs``; other columns are
    ignored, whatever their names.

    * A null or empty text, or one without words, has fingerprint zero, and
      links like any other.
    * A row with a null doc_id takes no part: its component is null.
    * Rows that repeat a doc_id are one document with all links of its texts.
    * An empty table gives none.  Long texts count whole.

    Plan.  Equal fingerprints fold into one node.  A word of 64 bits is cut into
    ``parts``: two that differ in few bits differ in one part in at most their
    share, ``differ // parts``.  The anchors of a part are the words of a code
    that covers it with radius 1; each fingerprint has one of its own, and goes
    to all within the radius and the share, so that a pair meets where one of
    the two is at home.  Two cells that had one hash would only be compared
    needlessly.  The anchors must grow with the table: 2 ** 17 a part for three
    parts, 2 ** 28 for two, which then reach ten times as many.
    """
    sigs = written(fingerprints(docs, width), "fingerprints")
    known = sigs.where("doc_id IS NOT NULL")
    nodes = written(known.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    edges = compared(dealt(nodes, parts, differ), differ)
    repeats = known.groupBy("doc_id").agg(F.min("fp").alias("least"), F.max("fp").alias("most")).where("least <> most")
    repeats = known.join(small(written(repeats.select("doc_id", "least"), "repeats")), "doc_id").select(F.col("fp").alias("a"), F.col("least").alias("b"))
    parted = written(linked(edges.unionByName(repeats)), "parts")
    of = parted.withColumnRenamed("node", "fp")
    least = nodes.join(of, "fp").groupBy("component").agg(F.min("node").alias("component_id"))
    classes = nodes.join(of, "fp", "left").join(least, "component", "left").select("fp", F.coalesce("component_id", "node").alias("component_id"))
    out = sigs.join(written(classes, "classes"), "fp", "left")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
