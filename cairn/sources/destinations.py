"""Destinations that can't overwrite what a job reads: identity of paths on any Hadoop file system, and publishing in one rename."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from cairn.sources.catalog import _files


class UnsafeDestination(ValueError):
    """A destination is, links to, or lies inside something that must stay as it is."""


def _local(uri: str) -> str | None:
    """The path of a file on this machine, None for other file systems."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme == "file" else None


def identity(spark: SparkSession, name: str) -> str:
    """One text for all names of a path: scheme and authority written out, symbolic links followed as far as the path exists.

    Folders that don't exist yet keep their names below the last one that does.
    """
    path, fs = _files(spark, name)
    full = fs.makeQualified(path(name))
    own = _local(full.toString())
    if own is not None:
        return f"file:{os.path.realpath(own)}"
    tail: list[str] = []
    at = full
    while at.getParent() is not None and not fs.exists(at):
        tail.insert(0, at.getName())
        at = at.getParent()
    if fs.exists(at):
        at = fs.resolvePath(at)
    return "/".join([at.toString().rstrip("/"), *tail])


def same(spark: SparkSession, one: str, other: str) -> bool:
    """Whether two names stand for one file or folder: by identity, and on a local disk by hard link too."""
    a, b = identity(spark, one), identity(spark, other)
    if a == b:
        return True
    left, right = _local(a), _local(b)
    return left is not None and right is not None and os.path.exists(left) and os.path.exists(right) and os.path.samefile(left, right)


def refuse_aliases(spark: SparkSession, destination: str, protected: dict[str, str]) -> None:
    """UnsafeDestination if ``destination`` is one of the ``protected`` paths (label to path), lies inside one, or holds one.

    A folder that is replaced takes all below it along, so a destination above
    a protected path is refused as well.
    """
    own = identity(spark, destination)
    for label, name in sorted(protected.items()):
        other = identity(spark, name)
        if same(spark, destination, name) or own.startswith(other.rstrip("/") + "/") or other.startswith(own.rstrip("/") + "/"):
            raise UnsafeDestination(f"{destination} is not apart from {label} {name}")


def _move(spark: SparkSession, draft: str, destination: str, replace: bool) -> None:
    path, fs = _files(spark, destination)
    hadoop = spark._jvm.org.apache.hadoop.fs
    option = getattr(hadoop, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(option, int(replace))
    if replace:
        how[0] = option.OVERWRITE
    own = _local(fs.makeQualified(path(destination)).toString())
    if own is not None and not replace and os.path.isfile(_local(fs.makeQualified(path(draft)).toString())):
        # a hard link is refused by the disk itself where the name is taken
        os.link(_local(fs.makeQualified(path(draft)).toString()), own)
        fs.delete(path(draft), False)
        return
    try:
        hadoop.FileContext.getFileContext(path(destination).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(path(draft)), fs.makeQualified(path(destination)), how)
    except Py4JJavaError as e:
        if not replace and fs.exists(path(destination)):
            raise FileExistsError(destination) from None
        raise e


def publish_via(spark: SparkSession, destination: str, write: Callable[[str], None], protected: dict[str, str] | None = None, replace: bool = False) -> str:
    """Let ``write`` make a file or folder at a private name beside ``destination``, then turn it into the destination in one rename.

    Aliases are refused before the work and once more before the rename, as
    links may have changed.  With ``replace`` a file is overwritten in that
    rename; a folder is moved aside, and back if the rename fails.  Without, a
    destination that exists is a FileExistsError and stays as it is.  After an
    error nothing is left of the draft.
    """
    protected = protected or {}
    refuse_aliases(spark, destination, protected)
    path, fs = _files(spark, destination)
    final = path(destination)
    if not replace and fs.exists(final):
        raise FileExistsError(destination)
    fs.mkdirs(fs.makeQualified(final).getParent())
    draft = f"{fs.makeQualified(final).getParent().toString().rstrip('/')}/.{final.getName()}.{uuid.uuid4().hex}.building"
    aside = draft.replace(".building", ".replaced")
    try:
        write(draft)
        refuse_aliases(spark, destination, protected)
        folder = replace and fs.exists(final) and fs.getFileStatus(final).isDirectory()
        if folder:
            _move(spark, destination, aside, False)
        try:
            _move(spark, draft, destination, replace and not folder)
        except BaseException:
            if folder:
                _move(spark, aside, destination, False)
            raise
        if folder:
            fs.delete(path(aside), True)
    except BaseException:
        fs.delete(path(draft), True)
        raise
    return destination


def publish_text(spark: SparkSession, destination: str, text: str, protected: dict[str, str] | None = None, replace: bool = True) -> str:
    """A small text (a manifest, a pointer, a report) as one UTF-8 file, whole or not at all."""

    def write(draft: str) -> None:
        path, fs = _files(spark, draft)
        out = fs.create(path(draft), False)
        try:
            out.write(text.encode())
        finally:
            out.close()

    return publish_via(spark, destination, write, protected, replace)
