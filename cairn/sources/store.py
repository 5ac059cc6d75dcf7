"""Versions of a graph that several writers may extend: a log of what each version consists of, and a swap that one writer wins."""

from __future__ import annotations

import contextlib
import json
import os
import uuid
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from cairn.sources.catalog import COLUMNS, Catalog, _files, fingerprint, schema

#: The folder of a store that holds one file for each version.
LOG = "_log"


class CommitConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class Version(Catalog):
    """One version of a store: ``version.functions`` is that table, from the folders that the version lists.

    A reader keeps its version while others commit.  A table that no commit has
    written is empty.
    """

    def __init__(self, spark: SparkSession, folder: str, sequence: int | None = None):
        self.spark, self.target = spark, folder.rstrip("/")
        self.sequence = _latest(spark, self.target) if sequence is None else sequence
        self.parts: dict[str, list[str]] = {}
        if self.sequence:
            text = "".join(r[0] for r in spark.read.text(_entry(self.target, self.sequence), wholetext=True).collect())
            self.parts = json.loads(text)

    def __getattr__(self, table: str) -> DataFrame:
        if table not in COLUMNS:
            raise AttributeError(table)
        paths = [f"{self.target}/{p}" for p in self.parts.get(table, [])]
        return self.spark.read.schema(schema(table)).parquet(*paths) if paths else self.spark.createDataFrame([], schema(table))

    def drift(self) -> list[str]:
        """Tables of which a folder's columns differ from the fixed schema."""
        want = {t: fingerprint(self.spark.createDataFrame([], schema(t))) for t in self.parts}
        return [t for t, paths in self.parts.items() if any(fingerprint(self.spark.read.parquet(f"{self.target}/{p}")) != want[t] for p in paths)]


def _entry(target: str, sequence: int) -> str:
    return f"{target}/{LOG}/{sequence:020d}.json"


def _latest(spark: SparkSession, target: str) -> int:
    path, fs = _files(spark, f"{target}/{LOG}")
    if not fs.exists(path(f"{target}/{LOG}")):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{target}/{LOG}"))]
    return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)


def _swap(spark: SparkSession, target: str, sequence: int, text: str) -> None:
    """Make a version's log file, whole or not at all; an error if another writer has made it.

    A name that exists is refused by the file system in one step: a hard link
    on a local disk, a rename without overwriting elsewhere.  Stores without
    an atomic rename can't hold the log.
    """
    path, fs = _files(spark, f"{target}/{LOG}")
    final, draft = _entry(target, sequence), f"{target}/{LOG}/.{uuid.uuid4().hex}"
    fs.mkdirs(path(f"{target}/{LOG}"))
    out = fs.create(path(draft), False)
    out.write(text.encode())
    out.close()
    taken = CommitConflict(f"version {sequence} of {target} was committed by another writer")
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda p: urlparse(p).path if p.startswith("file:") else p
            try:
                os.link(local(draft), local(final))
            except FileExistsError:
                raise taken from None
            return
        context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration())
        none = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(path(draft)), fs.makeQualified(path(final)), none)
        except Py4JJavaError as e:
            if fs.exists(path(final)):
                raise taken from None
            raise e
    finally:
        with contextlib.suppress(Py4JJavaError):
            fs.delete(path(draft), False)


def commit(base: Version, added: dict[str, DataFrame], replaced: dict[str, DataFrame] | None = None) -> Version:
    """The version after ``base``: rows added to tables, and tables replaced, all or nothing.

    Tables are written to a folder that no version lists yet; the last step
    is the swap of the log.  If it is lost the folder goes, and
    CommitConflict is raised: the caller has read an old version, and must
    look again.  Unchanged tables are not written anew.
    """
    unknown = sorted((set(added) | set(replaced or {})) - set(COLUMNS))
    if unknown:
        raise ValueError(f"not committed: unknown tables {unknown}")
    folder = f"data-{uuid.uuid4().hex}"
    parts = {t: list(p) for t, p in base.parts.items()}
    path, fs = _files(base.spark, base.target)
    try:
        for table, df in {**added, **(replaced or {})}.items():
            df.select(*[df[f.name].cast(f.dataType) for f in schema(table)]).write.parquet(f"{base.target}/{folder}/{table}")
            parts[table] = ([] if table in (replaced or {}) else parts.get(table, [])) + [f"{folder}/{table}"]
        _swap(base.spark, base.target, base.sequence + 1, json.dumps(parts, sort_keys=True))
    except BaseException:
        fs.delete(path(f"{base.target}/{folder}"), True)
        raise
    return Version(base.spark, base.target, base.sequence + 1)


def compacted(base: Version) -> Version:
    """A version of the same rows in which each table is one folder."""
    return commit(base, {}, {t: getattr(base, t) for t, p in base.parts.items() if len(p) > 1})
