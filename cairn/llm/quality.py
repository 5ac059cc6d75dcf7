"""Quality and toxicity by co-training a text-content and a page-metadata classifier."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import ship, small, written

#: Cells for hashed words, after the cells for the text's make-up.
WORDS = 1 << 20
MAKEUP = 24
#: Cells for hashed metadata.
META = 1 << 10
#: The two targets of the labels table.
TARGETS = ("quality", "toxic")
#: Labelled rows that the classifiers are fitted on (a bounded sample), and the share kept apart for calibration.
SAMPLE, HELD = 12_000, 0.25
#: Rounds of co-training; the share of the training rows that a view passes on in a round, for each class; and what such a row weighs.
ROUNDS, PASSED, WEIGHT = 2, 0.05, 0.5
#: The combination is pulled to adding up both views' evidence with this weight.
RIDGE = 1.0


def text_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cells of each text, distinct and ascending, and where each text's cells start: its words and their stems of 6 and 8 bytes, and buckets of its make-up.

    Make-up: shares of capitals, digits, punctuation, bars and marks, of short
    lines and of distinct words, each in a few steps.
    """
    data, off = tx.raw(column)
    n = len(off) - 1
    low = tx.LOWER[data]
    starts, ends, first = tx.spans(low, off, tx.ALNUM)
    cut = [tx.hashes(low, starts, np.minimum(ends, starts + k)) for k in (6, 8, 1 << 40)]  # stems, and the word
    words, made = np.diff(first), len(cut)
    cell = (np.stack(cut, axis=1).reshape(-1) >> np.uint64(44)).astype(np.int64) + MAKEUP * 8
    first = first * made
    size = np.maximum(np.diff(off), 1)
    shares = []
    cum = lambda mask: np.diff(np.append(0, np.cumsum(mask))[off]) / size
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    capital = np.diff(np.append(0, np.cumsum(upper))[off])
    letters = capital + np.diff(np.append(0, np.cumsum(lower))[off])
    shares.append(capital / np.maximum(letters, 1))
    shares += [cum((data >= 48) & (data <= 57)), cum(data == 124), cum(data == 33), cum((data == 35) | (data == 36) | (data == 37) | (data == 38) | (data == 42)), cum(data == 10)]
    shares.append(np.minimum(words / 1000, 1))
    values, start = tx.distinct(cell.astype(np.uint64), first)
    shares.append(np.diff(start) / np.maximum(np.diff(first), 1))
    steps = np.array([0.001, 0.005, 0.02, 0.05, 0.15, 0.4, 0.8])
    extra = np.stack([k * 8 + np.searchsorted(steps, s, "right") for k, s in enumerate(shares)], axis=1)
    made = np.diff(start) + len(shares)
    at = np.append(0, np.cumsum(made))
    out = np.empty(at[-1], np.int64)
    place = np.repeat(at[:-1] + len(shares) - start[:-1], np.diff(start)) + np.arange(len(values))
    out[place] = values.astype(np.int64)
    out[(at[:-1][:, None] + np.arange(len(shares))).reshape(-1)] = extra.reshape(-1)
    assert n == len(at) - 1
    return out, at


def metadata(docs: DataFrame) -> Column:
    """Cells of a row's metadata, without its text: language, source, their pair, and the length in steps of two."""
    columns = docs.columns
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")
    length = F.floor(F.log2(F.greatest(F.coalesce(F.col("n_chars") if "n_chars" in columns else F.length("text"), F.lit(0)), F.lit(0)) + 1)).cast("string")
    parts = [F.concat(F.lit("l:"), part("lang")), F.concat(F.lit("s:"), part("source")), F.concat(F.lit("p:"), part("lang"), F.lit("|"), part("source")), F.concat(F.lit("n:"), length)]
    return F.array(*[F.pmod(F.xxhash64(p), F.lit(META)) for p in parts])


class Logistic:
    """Logistic regression on the telling ones of a set of cells, fitted by full-batch AdaGrad with classes weighed evenly, then Platt-scaled.

    A cell is telling if at least three training rows have it and its
    chi-squared statistic against the class is over CHI; the TELLING best are
    taken.  Most words of a text are noise for a rare class, and a weight for
    each would fit that noise.
    """

    CHI, TELLING = 20.0, 2000

    def __init__(self, cells: int):
        self.cells, self.bias, self.scale, self.shift = cells, 0.0, 1.0, 0.0
        self.index, self.value = np.zeros(0, np.int64), np.zeros(0)

    def _known(self, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the telling cells among ``cell``, and their numbers."""
        if not len(self.index) or not len(cell):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        k = np.minimum(np.searchsorted(self.index, cell), len(self.index) - 1)
        at = np.flatnonzero(self.index[k] == cell)
        return at, k[at]

    def fit(self, cell: np.ndarray, start: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, steps: int = 200, rate: float = 0.3, decay: float = 1e-3) -> Logistic:
        """``y`` may lie between 0 and 1: a label that the other view gives is its calibrated probability."""
        n = len(y)
        weight = np.ones(n) if weight is None else weight
        if not n or y.min() == y.max():
            self.bias = 0.0 if not n else (3.0 if y[0] else -3.0)
            return self
        row = np.repeat(np.arange(n), np.diff(start))
        names, number = np.unique(cell, return_inverse=True)
        mean = (y * weight).sum() / weight.sum()
        have, up = np.bincount(number, weights=weight[row]), np.bincount(number, weights=(y * weight)[row])
        expect = have * mean
        chi = (up - expect) ** 2 / np.maximum(expect * (1 - mean) * (1 - have / (weight.sum() + 1)), 1e-9)
        ok = np.flatnonzero((have >= 3) & (chi > self.CHI))
        ok = np.sort(ok[np.argsort(-chi[ok], kind="stable")[: self.TELLING]])
        self.index, self.value = names[ok], np.zeros(len(ok))
        at, k = self._known(cell)
        row = row[at]
        up, down = 0.5 / mean * y * weight / weight.sum(), 0.5 / (1 - mean) * (1 - y) * weight / weight.sum()
        seen, seen_bias = np.full(len(ok), 1e-8), 1e-8
        for _ in range(steps):
            z = np.bincount(row, weights=self.value[k], minlength=n) + self.bias
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = p * (up + down) - up
            gw = np.bincount(k, weights=g[row], minlength=len(ok)) + decay * self.value / n
            seen += gw * gw
            self.value -= rate * gw / np.sqrt(seen)
            gb = g.sum()
            seen_bias += gb * gb
            self.bias -= rate * gb / np.sqrt(seen_bias)
        return self

    def raw(self, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
        at, k = self._known(cell)
        row = np.searchsorted(start, at, "right") - 1
        return np.bincount(row, weights=self.value[k], minlength=len(start) - 1) + self.bias

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> Logistic:
        """Platt scaling on held-out rows, targets drawn in a little as Platt does."""
        if len(y) < 10 or y.min() == y.max():
            return self
        up, down = y.sum(), len(y) - y.sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton's method with a little damping
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
            g = np.array([((p - target) * z).sum() + 1e-3 * a, (p - target).sum()])
            w = p * (1 - p) + 1e-9
            h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum()]]) + 1e-6 * np.eye(2)
            step = np.linalg.solve(h, g)
            step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
            a, b = a - step[0], b - step[1]
        self.scale, self.shift = max(a, 0.0), b
        return self

    def logit(self, cell: np.ndarray, start: np.ndarray) -> np.ndarray:
        return np.clip(self.scale * self.raw(cell, start) + self.shift, -30, 30)


def _joined(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    cells = [np.asarray(r, np.int64) for r in rows]
    return (np.concatenate(cells) if cells else np.zeros(0, np.int64)), np.append(0, np.cumsum([len(c) for c in cells])).astype(np.int64)


class Views:
    """The two classifiers of one target and what combines them."""

    def fit(self, text_rows: list, meta_rows: list, held: list[tuple], base: float) -> Views:
        """Fit each view on its own rows (cells, label, weight): labelled ones and what the other passed on; then calibrate on held-out labelled rows."""
        made = lambda rows: (*_joined([r[0] for r in rows]), np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))
        self.text = Logistic(MAKEUP * 8 + WORDS).fit(*made(text_rows))
        self.meta = Logistic(META).fit(*made(meta_rows))
        self.base = base
        y = np.array([h[2] for h in held], float)
        for view, k in ((self.text, 0), (self.meta, 1)):
            cells = _joined([h[k] for h in held])
            view.calibrate(view.raw(*cells), y)
        t, m = self.text.logit(*_joined([h[0] for h in held])), self.meta.logit(*_joined([h[1] for h in held]))
        self.mix = self._weigh(t - base, m - base, y, base)
        return self

    @staticmethod
    def _weigh(t: np.ndarray, m: np.ndarray, y: np.ndarray, base: float) -> np.ndarray:
        """Weights of both views' evidence and a shift: logistic regression on held-out rows, pulled to (1, 1, base), so the result is calibrated."""
        w = np.array([1.0, 1.0, base])
        if len(y) < 10 or y.min() == y.max():
            return w
        x, pull = np.stack([t, m, np.ones(len(t))], axis=1), w.copy()
        for _ in range(60):  # Newton's method with a little damping
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + RIDGE * np.eye(3), x.T @ (p - y) + RIDGE * (w - pull))
            w = w - step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        return np.append(np.maximum(w[:2], 0), w[2])

    def logits(self, text: tuple, meta: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the text view, the metadata view, and both."""
        t, m = self.text.logit(*text), self.meta.logit(*meta)
        return t, m, self.mix[0] * (t - self.base) + self.mix[1] * (m - self.base) + self.mix[2]


def _scored(rows: DataFrame, views: dict[str, Views]) -> DataFrame:
    """doc_id and, for each target, the probabilities text_<t>, meta_<t> and <t> (both views)."""
    names = [f"{v}{t}" for t in TARGETS for v in ("text_", "meta_", "")]

    def run(batches):
        for batch in tx.slices(batches, "_text"):
            cells = text_features(batch.column(1))
            lists = batch.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            meta = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[off[0] : off[-1]], off - off[0]
            out = []
            for t in TARGETS:
                out += [pa.array(1 / (1 + np.exp(-np.clip(x, -30, 30)))) for x in views[t].logits(cells, meta)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=["doc_id", *names])

    return rows.select("doc_id", "_text", "_meta").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def _features(rows: DataFrame) -> list[tuple]:
    """(doc_id, text cells, metadata cells) of a bounded set of ids; of rows that repeat an id the one with the smallest text."""
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("_text", "_meta")).alias("r")).select("doc_id", "r._text", "r._meta")

    def run(batches):
        for batch in tx.slices(batches, "_text"):
            cell, start = text_features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(cell.astype(np.int32))), batch.column(2)], names=["doc_id", "cells", "meta"])

    made = rows.select("doc_id", "_text", "_meta").mapInArrow(run, "doc_id long, cells array<int>, meta array<bigint>")
    return [(r["doc_id"], np.array(r["cells"], np.int32), np.array(r["meta"], np.int64)) for r in made.toLocalIterator()]


def _sampled(labels: DataFrame, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids in the order of their hashes: the sample that the classifiers are fitted on."""
    ok = labels.where("doc_id IS NOT NULL AND quality IN (0, 1) AND toxic IN (0, 1)")
    ok = ok.groupBy("doc_id").agg(*[F.max(t).cast("int").alias(t) for t in TARGETS])
    return ok.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def trained(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[dict[str, Views], list[dict]]:
    """The co-trained views of each target, and a history: for each fit and target how many rows each view was fitted on.

    ``rows`` has doc_id, _text and _meta.  No labelled document gives no views.
    """
    spark = rows.sparkSession
    chosen = written(_sampled(labels, sample), "labels")  # at most ``sample`` rows
    truth = {r["doc_id"]: tuple(r[t] for t in TARGETS) for r in chosen.collect()}
    known = {i: (c, m) for i, c, m in _features(rows.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi"))} if truth else {}
    if not known:
        return {}, []
    rank = sorted(known, key=lambda i: (i * 2654435761 % 2**32, i))
    cut = int(len(rank) * HELD)
    held, train = rank[:cut], rank[cut:]
    extra = {t: {"text": [], "meta": []} for t in TARGETS}
    views: dict[str, Views] = {}
    history: list[dict] = []

    def fit():
        for k, t in enumerate(TARGETS):
            own = {v: [(known[i][j], truth[i][k], 1.0) for i in train] + extra[t][v] for j, v in enumerate(("text", "meta"))}
            y = [truth[i][k] for i in held]
            base = float(np.log((sum(y) + 1) / (len(y) - sum(y) + 1)))
            views[t] = Views().fit(own["text"], own["meta"], [(*known[i], truth[i][k]) for i in held], base)
            history.append({"target": t, "text": len(own["text"]), "meta": len(own["meta"])})

    fit()
    free = rows.where("doc_id IS NOT NULL").join(small(labels.where("doc_id IS NOT NULL").select("doc_id").distinct()), "doc_id", "left_anti")
    most = max(1, int(PASSED * len(train)))
    passed: set[int] = set()
    for _ in range(rounds if len(train) >= 20 else 0):
        probs = written(_scored(free, views), "views")
        if passed:  # at most four times PASSED of the sample for each target and round
            probs = probs.join(F.broadcast(spark.createDataFrame([(i,) for i in passed], "doc_id long")), "doc_id", "left_anti")
        picked: dict[int, list] = {}
        for t in TARGETS:
            rate = 1 / (1 + np.exp(-views[t].base))
            for view, other in (("text", "meta"), ("meta", "text")):
                p = F.col(f"{view}_{t}")
                for sure, order in ((p > float(rate), p.desc()), (p < float(rate), p.asc())):
                    for r in probs.where(sure).orderBy(order, F.xxhash64("doc_id"), "doc_id").select("doc_id", p.alias("p")).limit(most).collect():
                        picked.setdefault(r["doc_id"], []).append((t, other, r["p"]))
        if not picked:
            break
        passed |= set(picked)
        wanted = spark.createDataFrame([(i,) for i in picked], "doc_id long")
        for i, cells, meta in _features(rows.join(F.broadcast(wanted), "doc_id", "left_semi")):
            for t, other, p in picked.pop(i, ()):
                extra[t][other].append((cells if other == "text" else meta, p, WEIGHT))
        fit()
    return views, history


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """Scores of every document, for each target (quality, toxic): text_<t>, meta_<t> and <t>, and kept.

    Co-training.  Both views are fitted on the labelled sample and calibrated on
    the part of it that is held out.  In each round they score all documents
    without a label; those that a view is surest of, above and below the base
    rate, up to a share PASSED of the training rows for either side, become
    training rows of the *other* view with the calibrated probability as their
    label, and leave the pool.  Ties go by a hash of the id.  At the end the
    views' evidence is combined by a regression on the held-out rows.
    ``kept``: quality at least a half and toxic below it.

    * A null text is empty.  A null language or source is a value of its own.
    * Rows without a usable label are unlabelled; labels without a document,
      with nulls, or with other values are ignored; of repeated ones the
      larger counts.  Rows that repeat an id are scored each.
    * With labels of one class only a target's score is near that class; with
      no label at all scores are one half and every document is kept.
    * An empty table gives no rows.  Other columns are ignored.

    Only the sample and the passed rows, both bounded by ``sample``, come to the
    driver; all documents are scored where they are, and no text is shuffled
    but of those rows.
    """
    ship(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"), metadata(docs).alias("_meta"))
    views, _ = trained(rows, labels, sample, rounds)
    if not views:
        half = [F.lit(0.5).alias(f"{v}{t}") for t in TARGETS for v in ("text_", "meta_", "")]
        return rows.select("doc_id", *half, F.lit(True).alias("kept"))
    return _scored(rows, views).withColumn("kept", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))
