"""Token ids as Parquet list columns, in document order, read selectively."""

from __future__ import annotations

import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .common import shared, ship, small, text_of

#: Units whose ids a Python worker remembers; beyond that it starts afresh.
REMEMBERED = 1_000_000

#: Layout of the files: row groups and pages small enough to skip, a dictionary
#: for the ids, delta encoding for the ascending columns.  Spark's writer adds
#: column and offset indexes for every page.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#ids.list.element": "true",
}

_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[0x30:0x3A] = _ALNUM[0x41:0x5B] = _ALNUM[0x61:0x7B] = True


class Units:
    """Ids of the pieces that a tokenizer surely treats apart, remembered by hash.

    White space always splits, and so does the change from a letter or digit to
    a run of ``.,;:!?``.  A text is cut there; each distinct piece is given to
    the tokenizer once, and texts are put together from the pieces' ids.  ASCII
    pieces are lower-cased first, as the tokenizer would, unless they may hold
    a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.stop = np.zeros(1 + max(vocabulary.values()), bool)  # tokens that end a word
        self.stop[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def cut(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Prepared bytes; starts and ends of the pieces; the number of each text's first piece."""
        starts, ends, first = tx.spans(data, off, tx.NOT_SPACE)
        if not len(starts):
            return data, starts, ends, first
        low = tx.LOWER[data]
        bad = np.append(0, np.cumsum(data >= 0x80))
        mark = np.zeros(len(data), bool)
        mark[:-1] = (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        bad += np.append(0, np.cumsum(mark))
        for k in np.flatnonzero(bad[ends] != bad[starts]) if bad[-1] < 1000 else ():
            low[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        if bad[-1] >= 1000:
            keep = np.zeros(len(data) + 1, np.int32)
            k = bad[ends] != bad[starts]
            np.add.at(keep, starts[k], 1)
            np.add.at(keep, ends[k], -1)
            low = np.where(np.cumsum(keep[:-1]) > 0, data, low)
        # where the trailing run of punctuation begins, if a letter or digit stands before it
        other = np.maximum.accumulate(np.where(_TAIL[data], -1, np.arange(len(data))))
        core = other[ends - 1] + 1
        last = np.maximum(core - 1, 0)
        letter = _ALNUM[data[last]] | ((data[np.maximum(last - 1, 0)] == 0xC3) & (data[last] >= 0x80) & (data[last] != 0x97) & (data[last] != 0xB7) & (last > starts))
        split = (core > starts) & (core < ends) & letter
        at = np.flatnonzero(split)
        s = np.insert(starts, at + 1, core[at])
        e = np.insert(ends, at, core[at])
        return low, s, e, first + np.append(0, np.cumsum(split))[first]

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``end`` after it, and where each text starts (one more at the end)."""
        data, off = tx.raw(column)
        data, starts, ends, first = self.cut(data, off)
        keys, where, inverse = np.unique(tx.hashes(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        new = np.ones(len(keys), bool) if not len(self.keys) else self.keys[at] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > REMEMBERED and len(self.keys):
                self.clear()
                new[:] = True
            self.learn(keys[new], [data[starts[k] : ends[k]].tobytes().decode() for k in where[new]])
            at = np.searchsorted(self.keys, keys)
        row = self.rows[at][inverse] if len(keys) else np.zeros(0, np.int64)
        lo, n = self.start[row], self.start[row + 1] - self.start[row]
        # the end id as one more piece of each text, taken from behind all ids
        lo = np.insert(lo, first[1:], len(self.ids))
        n = np.insert(n, first[1:], 1)
        made = np.append(0, np.cumsum(n))
        pool = np.append(self.ids, np.int32(end))
        out = pool[np.repeat(lo - made[:-1], n) + np.arange(made[-1])]
        return out, made[first + np.arange(len(first))]

    def learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces.  Pieces of letters alone are one word each: many are encoded as one text and told apart by word ends."""
        alpha = np.array([p.isalpha() for p in pieces], bool)
        lone, rest = [pieces[k] for k in np.flatnonzero(alpha)], [pieces[k] for k in np.flatnonzero(~alpha)]
        n = np.zeros(len(pieces), np.int64)
        made = []
        lines = [" ".join(lone[k : k + 200]) for k in range(0, len(lone), 200)]
        ids = np.array([i for x in self.tokenizer.encode_batch_fast(lines, add_special_tokens=False) for i in x.ids], np.int32)
        stops = np.flatnonzero(self.stop[ids]) + 1 if len(ids) else np.zeros(0, np.int64)
        if len(stops) == len(lone):
            n[alpha] = np.diff(stops, prepend=0)
            made.append(ids)
        else:
            alpha[:], rest = False, pieces
        if rest:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            n[~alpha] = [len(x) for x in found]
            made.append(np.array([i for x in found for i in x], np.int32))
        order = np.concatenate([np.flatnonzero(alpha), np.flatnonzero(~alpha)])
        rows = np.empty(len(pieces), np.int64)
        rows[order] = len(self.start) - 1 + np.arange(len(pieces))
        self.ids = np.concatenate([self.ids, *made])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(n[order])])
        at = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, at, keys), np.insert(self.rows, at, rows)


_UNITS: dict[str, Units] = {}


def units(path: str) -> Units:
    if path not in _UNITS:
        _UNITS[path] = Units(path)
    return _UNITS[path]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 1) -> None:
    """Write (doc_id, n_tokens, offset, ids) files in ascending doc_id order, null ids first, rows of one id by text.

    ``ids`` has the token ids of the whole text and then ``end``; a null text
    counts as empty.  ``offset`` counts the ids before it in its file.  Files
    are numbered in order.  One shuffle, by ranges of doc_id.
    """

    def run(batches):
        own, done = units(tokenizer), 0
        for batch in tx.slices(batches):
            ids, start = own.encode(batch.column(1), end)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(start)), pa.array(start[:-1] + done), pa.ListArray.from_arrays(pa.array(start.astype(np.int32)), pa.array(ids))],
                names=["doc_id", "n_tokens", "offset", "ids"],
            )
            done += int(start[-1])

    ship(docs.sparkSession)
    rows = docs.select("doc_id", text_of(docs).alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, "doc_id long, n_tokens long, offset long, ids array<int>").write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, start (ids of all documents before it), ids; Spark reads only the columns and pages that are asked for."""
    kind = "doc_id long, n_tokens long, offset long, ids array<int>"
    rows = spark.read.schema(kind).parquet(path).select("*", F.col("_metadata.file_name").alias("file"))
    number = F.regexp_extract("file", r"part-(\d+)-.*?(?:-c(\d+))?\.", 1).cast("long")
    part = F.coalesce(F.expr(r"try_cast(regexp_extract(file, '-c([0-9]+)\\.', 1) AS bigint)"), F.lit(0))
    sums = rows.groupBy("file").agg(F.sum("n_tokens").alias("n")).select("file", "n", number.alias("number"), part.alias("part"))
    # one row for each file
    before = F.coalesce(F.sum("n").over(Window.orderBy("number", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = small(sums.select("file", before.alias("before")), 100_000)
    return rows.join(files, "file").select("doc_id", "n_tokens", (F.col("before") + F.col("offset")).alias("start"), "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def run(batches):
        for b in batches:
            lists = b.column(2)
            off = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crc = [zlib.crc32(values[x:y].data) for x, y in zip(off[:-1], off[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.diff(off)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def stored(docs: DataFrame, tokenizer: str, end: int = 1) -> DataFrame:
    """Write the documents' tokens to the shared folder and give what is read back."""
    spark = docs.sparkSession
    path = f"{shared(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, path, end)
    return read_tokens(spark, path)
