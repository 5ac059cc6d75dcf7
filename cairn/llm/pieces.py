"""SentencePiece encoding and decoding by a batched Viterbi pass in numpy.

The public model is a byte-pair one.  Its encoding isn't the segmentation with
the best sum of scores, so the pass maximises over *valid* continuations: a
piece may follow another only if byte-pair merging of the two together gives
just those two.  Exactly one sequence of pieces is valid throughout, and it is
the one that merging gives; each position of a word then has one best last
piece, which is what a Viterbi pass needs.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .common import ship, text_of

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
#: Words whose pieces a Python worker remembers; beyond that it starts afresh.
REMEMBERED = 1_000_000
SPACE = 0x20


def _poly(codes: list[int]) -> int:
    h = 0
    for c in codes:
        h = (h * _BASE + c + 1) & _MASK
    return h


class Model:
    """Tables of a SentencePiece model: sorted piece keys, ranks, last merges, and which pieces may follow which."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.size = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        codes = {i: [SPACE if c == "▁" else ord(c) for c in names[i]] for i in plain}
        self.byte_ids = np.array([next((i for i in range(n) if sp.is_byte(i) and names[i] == f"<0x{b:02X}>"), sp.unk_id()) for b in range(256)], np.int64)
        self.longest = max(len(c) for c in codes.values())
        self.multi = {c for v in codes.values() if len(v) > 1 for c in v}
        # ranks: single characters first, then merges, best score first
        order = sorted(plain, key=lambda i: (len(codes[i]) > 1, -sp.get_score(i), i))
        self.rank = np.full(n + 1, np.iinfo(np.int64).max, np.int64)
        self.rank[order] = np.arange(len(order))
        self.length = np.zeros(n + 1, np.int64)
        self.value = np.zeros(n + 1, np.uint64)
        for i, c in codes.items():
            self.length[i], self.value[i] = len(c), _poly(c)
        keys = self.value[plain]
        at = np.argsort(keys)
        self.keys, self.ids = keys[at], np.array(plain, np.int64)[at]
        if len(np.unique(keys)) != len(keys):
            raise ValueError("two pieces share a hash")
        self.up = np.array([pow(_BASE, k, 1 << 64) for k in range(self.longest + 2)], np.uint64)
        self.left, self.right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        self.whole = np.zeros(n + 1, bool)  # merging its characters gives the piece itself
        of = {tuple(c): i for i, c in codes.items()}
        for i, c in codes.items():
            self.left[i], self.right[i], self.whole[i] = self._last_merge(c, of)
        # text of each piece
        data = [bytes([int(names[i][3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else names[i].replace("▁", " ").encode() for i in range(n)]
        self.text = np.frombuffer(b"".join(data), np.uint8)
        self.text_start = np.append(0, np.cumsum([len(d) for d in data]))
        self.seen_key, self.seen = np.full(1 << 20, -1, np.int64), np.zeros(1 << 20, bool)

    def _last_merge(self, codes: list[int], of: dict) -> tuple[int, int, bool]:
        parts, last = [(c,) for c in codes], (-1, -1)
        if len(parts) == 1:
            return -1, -1, True
        while len(parts) > 1:
            best = min(((self.rank[of[a + b]], k) for k, (a, b) in enumerate(zip(parts[:-1], parts[1:], strict=True)) if a + b in of), default=None)
            if best is None:
                return -1, -1, False
            k = best[1]
            last = of.get(parts[k], -1), of.get(parts[k + 1], -1)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return last[0], last[1], last[0] >= 0 and last[1] >= 0

    def find(self, value: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, or -1: a probe of the sorted keys."""
        at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
        return np.where(self.keys[at] == value, self.ids[at], -1)

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the two pieces' text gives just the two; remembered by pair."""
        key = a * (self.size + 1) + b
        slot = (tx.mix(key.astype(np.uint64)) >> np.uint64(44)).astype(np.int64)
        known = self.seen_key[slot] == key
        out = np.where(known, self.seen[slot], False)
        todo = np.flatnonzero(~known)
        if len(todo):
            out[todo] = self._apart(a[todo], b[todo])
            self.seen_key[slot[todo]], self.seen[slot[todo]] = key[todo], out[todo]
        return out

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undo merges, the latest first, and see if one across the border would have come before."""
        ok = np.ones(len(a), bool)
        live, limit = np.arange(len(a)), np.full(len(a), np.iinfo(np.int64).max, np.int64)
        while len(live):
            width = self.length[b]
            near = width <= self.longest
            joined = np.where(near, self.find(self.value[a] * self.up[np.minimum(width, self.longest)] + self.value[b]), -1)
            bad = (joined >= 0) & (self.rank[joined] < limit)
            ok[live[bad]] = False
            left_first = ((self.rank[a] > self.rank[b]) & (self.right[a] >= 0)) | (self.left[b] < 0)
            end = (self.right[a] < 0) & (self.left[b] < 0)
            limit = np.where(left_first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(left_first, self.right[a], a), np.where(left_first, b, self.left[b])
            keep = ~bad & ~end
            live, limit, a, b = live[keep], limit[keep], a[keep], b[keep]
        return ok

    def segment(self, codes: np.ndarray) -> list[np.ndarray]:
        """Piece ids of words of one length, a row of code points each; a character that no piece has gives -(code point) - 1."""
        m, n = codes.shape
        value = np.zeros((n + 1, m), np.uint64)
        for j in range(n):
            value[j + 1] = value[j] * np.uint64(_BASE) + codes[:, j].astype(np.uint64) + np.uint64(1)
        last = np.full((n + 1, m), self.size, np.int64)  # self.size: none, or a character without a piece
        back = np.ones((n + 1, m), np.int64)
        for j in range(1, n + 1):
            best = np.full(m, -1, np.int64)  # so far the longest valid piece that ends here
            for k in range(1, min(j, self.longest) + 1):
                t = self.find(value[j] - value[j - k] * self.up[k])
                at = np.flatnonzero((t >= 0) & self.whole[t])
                if len(at):
                    before = last[j - k, at]
                    good = before == self.size
                    rest = np.flatnonzero(~good)
                    if len(rest):
                        good[rest] = self.may_follow(before[rest], t[at[rest]])
                    at = at[good]
                    better = at[k > best[at]]
                    best[better] = k
                    last[j, better], back[j, better] = t[better], k
        out, at, rows = [], np.full(m, n), np.arange(m)
        while (at > 0).any():
            step = np.where(at > 0, back[at, rows], 0)
            piece = np.where(last[at, rows] == self.size, -codes[rows, np.maximum(at - 1, 0)].astype(np.int64) - 1, last[at, rows])
            out.append(np.where(at > 0, piece, np.iinfo(np.int64).min))
            at = at - step
        return [row[row != np.iinfo(np.int64).min] for row in np.array(out[::-1]).T] if out else [np.zeros(0, np.int64)] * m


class Words:
    """Pieces of the words met so far, by hash; texts are put together from them."""

    def __init__(self, path: str):
        self.model = Model(path)
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text starts (one more at the end)."""
        data, off = tx.raw(column)
        if len(data) and (data == 0xE2).any():  # the mark for spaces is one
            texts = [t.replace("▁", " ") for t in (column.fill_null("") if column.null_count else column).to_pylist()]
            data, off = tx.raw(pa.array(texts, pa.string()))
        full = np.diff(off) > 0
        data = np.insert(data, off[:-1][full], SPACE)
        off = off + np.append(0, np.cumsum(full))
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        space, line = data == SPACE, data == 0x0A
        first = space.copy()
        first[1:] &= ~space[:-1]
        if 0x0A not in self.model.multi:
            first |= line
            first[1:] |= line[:-1]
        first[off[:-1][full]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(data))
        keys, where, inverse = np.unique(tx.hashes(data, starts, ends), return_index=True, return_inverse=True)
        new = np.ones(len(keys), bool)
        if len(self.keys):
            new = self.keys[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)] != keys
        if new.any():
            if len(self.keys) and len(self.keys) + int(new.sum()) > REMEMBERED:
                self.clear()
                new[:] = True
            self.learn(keys[new], data, starts[where[new]], ends[where[new]])
        row = self.rows[np.searchsorted(self.keys, keys)][inverse]
        lo, n = self.start[row], self.start[row + 1] - self.start[row]
        made = np.append(0, np.cumsum(n))
        out = self.ids[np.repeat(lo - made[:-1], n) + np.arange(made[-1])]
        return out, made[np.searchsorted(starts, off)]

    def learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size = ends - starts
        at = np.append(0, np.cumsum(size))
        flat = data[np.repeat(starts - at[:-1], size) + np.arange(at[-1])]
        letters = np.append(0, np.cumsum((flat & 0xC0) != 0x80))[at]
        codes = np.frombuffer(flat.tobytes().decode().encode("utf-32-le"), np.uint32)
        length = np.diff(letters)
        made: list[np.ndarray] = [np.zeros(0, np.int64)] * len(keys)
        order = np.argsort(length, kind="stable")
        cuts = np.flatnonzero(np.diff(length[order])) + 1
        for group in np.split(order, cuts):
            n = int(length[group[0]])
            step = max(1, 400_000 // (n + 1))  # bounds the tables of one pass
            for k in range(0, len(group), step):
                part = group[k : k + step]
                for i, ids in zip(part, self.model.segment(codes[letters[part][:, None] + np.arange(n)]), strict=True):
                    made[i] = ids
        n = np.array([len(x) for x in made], np.int64)
        ids = np.concatenate(made) if made else np.zeros(0, np.int64)
        if (ids < 0).any():  # characters as the pieces of their bytes
            made = [np.concatenate([self.model.byte_ids[list(chr(-i - 1).encode())] if i < 0 else [i] for i in x]) if (x < 0).any() else x for x in made]
            n, ids = np.array([len(x) for x in made], np.int64), np.concatenate(made)
        at = np.searchsorted(self.keys, keys)
        self.rows = np.insert(self.rows, at, len(self.start) - 1 + np.arange(len(keys)))
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n)])
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])

    def decode(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes of all texts in a row, without the space put before each, and where each text starts."""
        m = self.model
        lo, n = m.text_start[ids], m.text_start[ids + 1] - m.text_start[ids]
        made = np.append(0, np.cumsum(n))
        data = m.text[np.repeat(lo - made[:-1], n) + np.arange(made[-1])]
        off = made[start]
        full = off[:-1][np.diff(off) > 0]
        lead = full[data[full] == SPACE] if len(data) else full
        return np.delete(data, lead), off - np.searchsorted(lead, off)


_WORDS: dict[str, Words] = {}


def words(path: str) -> Words:
    if path not in _WORDS:
        _WORDS[path] = Words(path)
    return _WORDS[path]


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (piece ids of the whole text), n_pieces, ids_crc32, decoded_sha256, exact (decoding gives the text again).

    A null or empty text has no pieces.  A text with the character U+2581 is
    decoded with spaces in its place, so it isn't exact.  Each row stands for
    itself: repeated ids and extra columns do not matter.  No shuffle.
    """

    def run(batches):
        own = words(model)
        for batch in tx.slices(batches):
            ids, start = own.encode(batch.column(1))
            data, off = own.decode(ids, start)
            before, at = tx.raw(batch.column(1))
            flat = ids.astype("<u4")
            crc = [zlib.crc32(flat[a:b].data) for a, b in zip(start[:-1], start[1:], strict=True)]
            texts = [data[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
            same = [t == before[a:b].tobytes() for t, a, b in zip(texts, at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids)), pa.array(np.diff(start)), pa.array(crc, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_pieces", "ids_crc32", "decoded_sha256", "exact"],
            )

    ship(docs.sparkSession)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>, n_pieces long, ids_crc32 long, decoded_sha256 string, exact boolean")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and the text of its ids; null ids give an empty text."""

    def run(batches):
        own = words(model)
        for b in batches:
            lists = b.column(1)
            off = lists.offsets.to_numpy().astype(np.int64)
            data, at = own.decode(lists.values.to_numpy(zero_copy_only=False).astype(np.int64)[off[0] : off[-1]], off - off[0])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([data[x:y].tobytes().decode(errors="replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())], names=["doc_id", "text"])

    ship(rows.sparkSession)
    return rows.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")
