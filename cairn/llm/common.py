"""What the operators share: the shared folder, written tables, shipped code, ordered buckets, linked groups."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.sources.staging import shared, written  # noqa: F401

_SHIPPED: set[str] = set()


#: Rows of an Arrow batch where the session has Spark's default: texts and sets are large rows.
ARROW_ROWS = 2_000


def ship(spark: SparkSession) -> None:
    """Let executors import this package, once for each application; keep Arrow batches small unless the session says otherwise."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="cairn-code-")) / "cairn_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


def once(udf):
    """A function that Spark may not evaluate a second time, in a filter that it moves below the projection."""
    return udf.asNondeterministic()


def text_of(df: DataFrame, name: str = "text") -> Column:
    return F.coalesce(df[name], F.lit(""))


def linked(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): one row (node, component) for each node of an edge; component is the smallest node.

    Large-star and small-star steps in turn, each a grouped minimum joined back,
    until no edge changes.  Each step's edges are a written table.
    """
    e = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = None
    while not e.isEmpty():
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        e = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        e = written(e, "edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first())
        if now == mark:
            break
        mark = now
    return e.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast a table of fixed-width columns if it has at most so many rows; beyond that its join shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


#: Ids that a bitmap filter is made for, at most: 8 MB; with more ids the rows are joined by shuffle.
MOST_IDS = 4_000_000


def bitmap(ids: DataFrame, bits: int):
    """A Bloom filter of a bigint column, three bits an id, as a numpy array of bytes."""
    import numpy as np

    name = ids.columns[0]
    where = F.explode(F.array(*[F.shiftrightunsigned(F.xxhash64(F.col(name), F.lit(k)), 64 - bits) for k in range(3)]))
    set_bits = ids.select(where.alias("p")).select((F.col("p") / 64).cast("long").alias("w"), F.expr("shiftleft(1L, int(p % 64))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b"))
    out = np.zeros((1 << bits) // 64, np.int64)
    found = set_bits.toPandas()
    out[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64)
    return out


def among(rows: DataFrame, name: str, ids: DataFrame):
    """``rows`` narrowed to those whose bigint ``name`` is among ``ids``: a table, and what its batches go through in the task.

    Up to MOST_IDS ids become a Bloom filter of 16 bits an id, which a few other
    rows pass too; beyond that Spark joins.  Null ids are not among any.
    """
    count = ids.count()
    if count > MOST_IDS:
        return rows.join(ids.select(F.col(ids.columns[0]).alias(name)), name, "left_semi").select(rows.columns), lambda batches: batches
    bits = max(12, (16 * count).bit_length())
    held = rows.sparkSession.sparkContext.broadcast(bitmap(ids, bits))
    rows = rows.where(F.col(name).isNotNull()).select("*", *[F.shiftrightunsigned(F.xxhash64(F.col(name), F.lit(k)), 64 - bits).alias(f"_p{k}") for k in range(3)])

    def passing(batches):
        import numpy as np
        import pyarrow as pa

        words = held.value
        for batch in batches:
            ok = np.ones(batch.num_rows, bool)
            for k in range(3):
                p = batch.column(batch.schema.get_field_index(f"_p{k}")).to_numpy(zero_copy_only=False).astype(np.int64)
                ok &= (words[p >> 6] >> (p & 63)) & 1 == 1
            yield batch.filter(pa.array(ok))

    return rows, passing

