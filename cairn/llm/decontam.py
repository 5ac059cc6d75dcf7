"""Benchmark decontamination with a generalised suffix automaton over normalised words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import once, ship, text_of, written

#: Words of benchmark items in one automaton; more items make more automata.
BLOCK_WORDS = 200_000
#: Automata that run in one job; more are run job after job.
BLOCKS_AT_ONCE = 4


class Automaton:
    """A suffix automaton of many word sequences, and what each state says about windows of ``width`` words.

    ``items[s]``: numbers of the items that hold the window that ends in state s
    (once matches are ``width`` long); ``short[s]``: (length, number) of whole
    items of fewer words that end there.
    """

    def __init__(self, sequences: list[list[int]], width: int):
        self.width, self.vocabulary = width, 1 + max((w for s in sequences for w in s), default=0)
        size = self.vocabulary
        nxt: dict[int, int] = {}
        out: list[list[int]] = [[]]
        link, length, seen = [-1], [0], [set()]

        def state(at: int) -> int:
            link.append(-1)
            length.append(at)
            out.append([])
            seen.append(set())
            return len(link) - 1

        def split(p: int, q: int, w: int) -> int:
            """The state for the longest suffix that ends in p and then w."""
            if length[p] + 1 == length[q]:
                return q
            c = state(length[p] + 1)
            link[c] = link[q]
            for x in out[q]:
                nxt[c * size + x] = nxt[q * size + x]
            out[c] = list(out[q])
            while p != -1 and nxt.get(p * size + w) == q:
                nxt[p * size + w] = c
                p = link[p]
            link[q] = c
            return c

        ends: list[tuple[int, int, int]] = []
        for k, sequence in enumerate(sequences):
            last = 0
            for n, w in enumerate(sequence, 1):
                q = nxt.get(last * size + w)
                if q is not None:
                    last = split(last, q, w)
                else:
                    cur, p = state(n), last
                    while p != -1 and p * size + w not in nxt:
                        nxt[p * size + w] = cur
                        out[p].append(w)
                        p = link[p]
                    link[cur] = 0 if p == -1 else split(p, nxt[p * size + w], w)
                    last = cur
                seen[last].add(k)
            if 0 < len(sequence) < width:
                ends.append((last, len(sequence), k))
        order = sorted(range(1, len(link)), key=length.__getitem__)
        for s in reversed(order):
            if length[link[s]] >= min(width, length[link[s]] + 1) and link[s] > 0:
                seen[link[s]] |= seen[s]
        self.next, self.link, self.length = nxt, link, length
        self.window = list(range(len(link)))  # the ancestor that holds the last ``width`` words
        self.short: list[tuple] = [()] * len(link)
        own: dict[int, list] = {}
        for s, n, k in ends:
            own.setdefault(s, []).append((n, k))
        for s in order:
            p = link[s]
            if length[p] >= width:
                self.window[s] = self.window[p]
            self.short[s] = tuple(own.get(s, ())) + self.short[p]
        self.items = [frozenset(x) for x in seen]

    def match(self, ids: list[int], hit: bytearray, at: int, found: set[int]) -> None:
        """Walk over words that all occur in items; mark hit words from position ``at`` on, and add the items."""
        nxt, link, length, size, width = self.next, self.link, self.length, self.vocabulary, self.width
        s = n = 0
        for i, w in enumerate(ids):
            while s and s * size + w not in nxt:
                s = link[s]
                n = length[s]
            t = nxt.get(s * size + w)
            if t is None:
                s = n = 0
                continue
            s, n = t, n + 1
            if n >= width:
                hit[at + i - width + 1 : at + i + 1] = b"\1" * width
                found |= self.items[self.window[s]]
            for m, k in self.short[s]:
                if m <= n:
                    hit[at + i - m + 1 : at + i + 1] = b"\1" * m
                    found.add(k)


class Matcher:
    """An automaton with the tables that find, for whole batches, the stretches it has to walk.

    Where a word, or a word with its predecessor, is in no item, the match ends
    there; so only runs of known word pairs as long as the shortest window are
    walked.
    """

    def __init__(self, ids: list, texts: list[str], width: int):
        word, first = tx.words(pa.array(texts, pa.string()), tx.ALNUM)
        self.known = np.unique(word)
        number = np.searchsorted(self.known, word)
        sequences = [number[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
        self.ids, self.automaton = ids, Automaton(sequences, width)
        pairs = [a * len(self.known) + b for s in sequences for a, b in zip(s[:-1], s[1:], strict=True)]
        self.pairs = np.unique(np.array(pairs, np.int64))
        self.least = min([width, *(len(s) for s in sequences if s)])
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(self.known & np.uint64(0xFFFF)).astype(np.int64)] = True

    def hits(self, word: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict[int, set[int]]]:
        """A flag for each word, and the item numbers of each text that has any."""
        hit, found = bytearray(len(word)), {}
        if not len(word) or not len(self.known):
            return np.frombuffer(hit, np.uint8), found
        number = np.full(len(word), -1, np.int64)
        maybe = np.flatnonzero(self.maybe[(word & np.uint64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.known, word[maybe]), len(self.known) - 1)
        ok = self.known[at] == word[maybe]
        number[maybe[ok]] = at[ok]
        joined = np.zeros(len(word), bool)  # with the word before
        both = np.flatnonzero((number[1:] >= 0) & (number[:-1] >= 0)) + 1
        key = number[both - 1] * len(self.known) + number[both]
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined[both[self.pairs[at] == key]] = True
        joined[first[:-1][first[:-1] < len(word)]] = False
        start = np.flatnonzero((number >= 0) & ~joined)
        stop = np.flatnonzero((number >= 0) & ~np.append(joined[1:], False)) + 1
        long = stop - start >= self.least
        for a, b in zip(start[long].tolist(), stop[long].tolist(), strict=True):
            items: set[int] = set()
            self.automaton.match(number[a:b].tolist(), hit, a, items)
            if items:
                found.setdefault(int(np.searchsorted(first, a, "right")) - 1, set()).update(items)
        return np.frombuffer(hit, np.uint8), found


def _blocks(benchmark: DataFrame) -> list[list[tuple]]:
    """Items, whole, in blocks of about BLOCK_WORDS words: the stated query set, which the driver reads item by item."""
    blocks, room = [[]], BLOCK_WORDS
    for r in benchmark.select("item_id", text_of(benchmark).alias("text")).toLocalIterator():
        n = len(r["text"]) // 4 + 1
        if blocks[-1] and n > room:
            blocks, room = [*blocks, []], BLOCK_WORDS
        blocks[-1].append((r["item_id"], r["text"]))
        room -= n
    return blocks


_MATCHERS: dict[int, Matcher] = {}


def _matcher(key: int, block: list[tuple], width: int) -> Matcher:
    if key not in _MATCHERS:
        if len(_MATCHERS) >= BLOCKS_AT_ONCE:
            _MATCHERS.clear()
        _MATCHERS[key] = Matcher([i for i, _ in block], [t for _, t in block], width)
    return _MATCHERS[key]


_TYPE = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int64())), ("items", pa.list_(pa.int64()))])


def _hit_column(block: list[tuple], width: int, text: Column) -> Column:
    """struct(n_words, spans, items): hit words of a text as flat pairs of word positions, ends exclusive."""
    key = hash((width, tuple(block)))

    def run(column: pa.Array) -> pa.Array:
        matcher = _matcher(key, block, width)
        parts = []
        for piece in tx.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
            word, first = tx.words(piece.column(0), tx.ALNUM)
            hit, found = matcher.hits(word, first)
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            cut = first[1:-1][(first[1:-1] > 0) & (first[1:-1] < len(hit))]
            cut = cut[(hit[cut] == 1) & (hit[cut - 1] == 1)]  # a span ends with its text
            a = np.sort(np.concatenate([np.flatnonzero(edge == 1), cut]))
            b = np.sort(np.concatenate([np.flatnonzero(edge == -1), cut]))
            lo = np.searchsorted(a, first)
            base = np.repeat(first[:-1], np.diff(lo))
            flat = np.stack([a - base, b - base], axis=1).reshape(-1)
            names = [sorted({matcher.ids[k] for k in found.get(i, ())} - {None}) for i in range(piece.num_rows)]
            parts.append(
                pa.StructArray.from_arrays(
                    [pa.array(np.diff(first)), pa.ListArray.from_arrays(pa.array((lo * 2).astype(np.int32)), pa.array(flat, pa.int64())), pa.array(names, pa.list_(pa.int64()))], fields=list(_TYPE)
                )
            )
        return pa.concat_arrays(parts) if parts else pa.array([], _TYPE)

    return once(F.arrow_udf(run, "struct<n_words:bigint,spans:array<bigint>,items:array<bigint>>"))(text)


def hits(docs: DataFrame, benchmark: DataFrame, width: int = 10, name: str = "hit") -> DataFrame:
    """``docs`` with a column struct(n_words, spans array of struct(start, end), items array of item_id).

    Words are lower-cased (A-Z) runs of digits, letters and non-ASCII
    characters.  A window is ``width`` consecutive words of an item; an item of
    fewer words, but not none, is one window.  Words inside any occurrence of a
    window are hit; spans are the maximal runs of hit words, ends exclusive.

    A null text has no words.  Items that have no words, and an empty
    benchmark, match nothing; an item with a null id is searched for but not
    named.  Repeated item ids count once.  Rows are neither dropped nor joined,
    so repeated ids and extra columns stay as they are; a column that has the
    new one's name is an error.

    Plan: no shuffle.  The benchmark is read in blocks of bounded size, each an
    automaton that every task streams its texts through.
    """
    ship(docs.sparkSession)
    blocks = _blocks(benchmark)
    names = [f"_{name}_{k}" for k in range(len(blocks))]
    taken = [c for c in docs.columns if c in (name, *names)]
    if taken:
        raise ValueError(f"docs has columns {taken}; choose another name")
    out = docs
    for k, block in enumerate(blocks):
        if k and k % BLOCKS_AT_ONCE == 0:
            out = written(out, "hits")
        out = out.withColumn(names[k], _hit_column(block, width, text_of(out)))
    if len(names) == 1:
        pairs, items = F.col(names[0])["spans"], F.array_sort(F.array_distinct(F.col(names[0])["items"]))
    else:
        pairs = F.expr(_merged(names))
        items = F.array_sort(F.array_distinct(F.concat(*[F.col(n)["items"] for n in names])))
    spans = F.transform(F.filter(F.sequence(F.lit(0), F.size(pairs)), lambda i: (i % 2 == 0) & (i < F.size(pairs))), lambda i: F.struct(F.get(pairs, i).alias("start"), F.get(pairs, i + 1).alias("end")))
    value = F.struct(F.col(names[0])["n_words"].alias("n_words"), spans.alias("spans"), items.alias("items"))
    return out.withColumn(name, value).select(*docs.columns, name)


def _merged(names: list[str]) -> str:
    """SQL for the union of several columns of flat spans."""
    pairs = ", ".join(f"transform(filter(sequence(0, size({n}.spans)), i -> i % 2 = 0 AND i < size({n}.spans)), i -> struct({n}.spans[i] AS s, {n}.spans[i + 1] AS e))" for n in names)
    step = "CASE WHEN size(m) > 0 AND element_at(m, -1) >= p.s THEN concat(slice(m, 1, size(m) - 1), array(greatest(element_at(m, -1), p.e))) ELSE concat(m, array(p.s, p.e)) END"
    return f"aggregate(array_sort(concat({pairs})), CAST(array() AS array<bigint>), (m, p) -> {step})"


def report(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the item ids, sorted as strings, comma-joined), contaminated."""
    hit = hits(docs.select("doc_id", "text"), benchmark, width, "hit").select("doc_id", F.col("hit.*"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hit.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def _without(text: str, spans: np.ndarray) -> str:
    """The text without the characters from the first to the last word of each span (rows of start and end)."""
    data, off = tx.raw(pa.array([text], pa.string()))
    starts, ends, _ = tx.spans(tx.LOWER[data], off, tx.ALNUM)
    keep, at = [], 0
    for s, e in spans:
        keep.append(data[at : starts[s]].tobytes())
        at = ends[e - 1]
    return b"".join([*keep, data[at:].tobytes()]).decode()


def _clean_column(block: list[tuple], width: int, text: Column) -> Column:
    """struct(n_words, n_hit, clean): clean is the text without its hit spans, null where there are none."""
    key = hash((width, tuple(block)))

    def run(column: pa.Array) -> pa.Array:
        matcher = _matcher(key, block, width)
        words, hits, clean = [], [], []
        for piece in tx.slices(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
            word, first = tx.words(piece.column(0), tx.ALNUM)
            hit, _ = matcher.hits(word, first)
            total = np.append(0, np.cumsum(hit, dtype=np.int64))[first]
            words.append(np.diff(first))
            hits.append(np.diff(total))
            for i in range(piece.num_rows):
                if total[i + 1] == total[i]:
                    clean.append(None)
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[i] : first[i + 1]].astype(np.int8), [0]])))
                clean.append(_without(piece.column(0)[i].as_py(), edge.reshape(-1, 2)))
        flat = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
        return pa.StructArray.from_arrays([flat(words), flat(hits), pa.array(clean, pa.string())], names=["n_words", "n_hit", "clean"])

    return once(F.arrow_udf(run, "struct<n_words:bigint,n_hit:bigint,clean:string>"))(text)


def _cut_column(text: Column, spans: Column) -> Column:
    """The text without its spans."""

    def run(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts, spans, strict=True):
            s = s.as_py()
            out.append(_without(t.as_py(), np.array([(x["start"], x["end"]) for x in s])) if s else None)
        return pa.array(out, pa.string())

    return once(F.arrow_udf(run, "string"))(text, spans)


def decontaminated(docs: DataFrame, benchmark: DataFrame, width: int = 10, most: float = 0.5) -> DataFrame:
    """Documents without their hit spans; a document with more than ``most`` of its words hit goes.

    All columns of ``docs``, whatever their names; n_chars, if there is one, is
    counted again where the text changes.  A document without hits is unchanged,
    so null, empty and repeated rows stay as they are.  An empty table gives
    none, and an empty benchmark changes nothing.  With a benchmark of one
    block, texts go to Python once.
    """
    ship(docs.sparkSession)
    blocks = _blocks(benchmark)
    hit = docs.select(F.struct("*").alias("row"), text_of(docs).alias("text"))
    if len(blocks) == 1:
        hit = hit.select("row", _clean_column(blocks[0], width, F.col("text")).alias("hit"))
    else:
        hit = hits(hit, benchmark, width, "hit")
        n_hit = F.aggregate("hit.spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
        hit = hit.select("row", F.struct(F.col("hit.n_words").alias("n_words"), n_hit.alias("n_hit"), _cut_column(F.col("text"), F.col("hit.spans")).alias("clean")).alias("hit"))
    hit = hit.where(F.col("hit.n_hit") <= F.lit(most) * F.col("hit.n_words"))
    own = {"text": F.col("hit.clean"), "n_chars": F.length("hit.clean")}
    return hit.select(*[(F.when(F.col("hit.n_hit") > 0, own[c].cast(docs.schema[c].dataType)).otherwise(F.col("row")[c]) if c in own else F.col("row")[c]).alias(c) for c in docs.columns])
