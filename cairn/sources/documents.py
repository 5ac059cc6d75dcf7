"""JSON documents and file trees as tables: each document is one text, parsed by from_json and exploded on the executors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.expr import parse_address
from cairn.operators import ranges

#: Endings of source files.
SUFFIXES = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".inl")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of whole files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _object(text: Column, name: str, kind: str) -> Column:
    return F.from_json(F.coalesce(F.get_json_object(text, f"$.{name}"), F.lit("{}")), f"map<string,{kind}>")


def inventory(docs: DataFrame, executable: DataFrame, width: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Functions and callees of documents {functions: {address: {name, size, thunk, callees}}}.

    Functions: address, name, size (none is 0), thunk, in_executable.  Callees:
    caller, address, classification: an entry, else by the executable ranges
    (lo, hi); each callee of a function once.  An address that stands twice
    after parsing is there twice: see ``duplicates``.
    """
    kind = "struct<name:string,size:bigint,thunk:boolean,callees:array<string>>"
    rows = docs.select(F.explode(_object(F.col("text"), "functions", kind)).alias("at", "f")).select(parse_address(F.col("at")).alias("address"), "f.*")
    spans = executable.select("lo", "hi")
    inside = ranges.containing(rows.select("address").distinct(), "address", spans, "lo", "hi", width).select("address").distinct().withColumn("in_executable", F.lit(True))
    functions = rows.join(inside, "address", "left").select("address", F.coalesce("name", F.lit("")).alias("name"), F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("size"), F.coalesce("thunk", F.lit(False)).alias("thunk"), F.coalesce("in_executable", F.lit(False)).alias("in_executable"))
    callees = rows.select(F.col("address").alias("caller"), F.explode("callees").alias("c")).select("caller", parse_address(F.col("c")).alias("address")).distinct()
    entries = rows.select("address").distinct().withColumn("is_entry", F.lit(True))
    held = ranges.containing(callees.select("address").distinct(), "address", spans, "lo", "hi", width).select("address").distinct().withColumn("is_code", F.lit(True))
    j = callees.join(entries, "address", "left").join(held, "address", "left")
    named = F.when(F.col("is_entry"), "entry").when(F.col("is_code"), "executable_non_entry").otherwise("outside_executable")
    return functions, j.select("caller", "address", named.alias("classification"))


def duplicates(rows: DataFrame, key: str = "address") -> DataFrame:
    """Keys that a loader must refuse, as two spellings of one give it twice."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def pc_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and slots of documents {classes: {class: [{rtti_name, vtable_va, col_va, offset, slots}]}}: none is chosen.

    A table at offset 0 is primary, every other secondary.
    """
    kind = "array<struct<rtti_name:string,vtable_va:string,col_va:string,offset:bigint,slot_count:bigint,slots:array<string>>>"
    rows = docs.select(F.explode(_object(F.col("text"), "classes", kind)).alias("class_name", "tables")).select("class_name", F.posexplode("tables").alias("table_index", "t"))
    tables = rows.select("class_name", "table_index", parse_address(F.col("t.vtable_va")).alias("address"), parse_address(F.col("t.col_va")).alias("col_address"), F.when(F.col("t.offset") == 0, "primary").otherwise("secondary").alias("vfptr_role"), F.col("t.offset").alias("subobject_offset"), F.col("t.rtti_name").alias("rtti_name"), F.col("t.slot_count").alias("reported_slot_count"), F.size("t.slots").alias("slot_count"))
    slots = rows.select("class_name", "table_index", F.posexplode("t.slots").alias("slot_index", "raw")).select("class_name", "table_index", "slot_index", parse_address(F.col("raw")).alias("target"))
    return tables, slots


def xbox_tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables and slots of documents {class: [{symbol, vtable_va, slots: [{va, name}]}]}; the symbol's parts come from ``decode.name_parts``."""
    kind = "array<struct<symbol:string,vtable_va:string,slot_count:bigint,slots:array<struct<va:string,name:string>>>>"
    rows = docs.select(F.explode(F.from_json("text", f"map<string,{kind}>")).alias("class_name", "tables")).select("class_name", F.posexplode("tables").alias("table_index", "t"))
    tables = rows.select("class_name", "table_index", parse_address(F.col("t.vtable_va")).alias("address"), F.col("t.symbol").alias("decorated_name"), F.col("t.slot_count").alias("reported_slot_count"), F.size("t.slots").alias("slot_count"))
    slots = rows.select("class_name", "table_index", F.posexplode("t.slots").alias("slot_index", "s")).select("class_name", "table_index", "slot_index", parse_address(F.col("s.va")).alias("target"), F.col("s.name").alias("raw_name"))
    return tables, slots


def layouts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Bases and virtuals of documents {class: {bases: [{name, offset}], virtuals: [{name, kind, slot}]}}."""
    rows = docs.select(F.explode(F.from_json("text", "map<string,struct<bases:array<struct<name:string,offset:bigint>>,virtuals:array<struct<name:string,kind:string,slot:bigint>>>>")).alias("class_name", "t"))
    bases = rows.select("class_name", F.posexplode("t.bases").alias("ordinal", "b")).select("class_name", "ordinal", F.col("b.name").alias("base_name"), F.col("b.offset").alias("base_offset"))
    virtuals = rows.select("class_name", F.posexplode("t.virtuals").alias("ordinal", "v")).select("class_name", "ordinal", "v.name", "v.kind", "v.slot")
    return bases, virtuals


def source_lines(docs: DataFrame, functions: DataFrame) -> DataFrame:
    """Links function_id, normalized_path, line of documents {hexadecimal address: {name, file, line}}: by address and exact name, to every function of the two."""
    rows = docs.select(F.explode(F.from_json("text", "map<string,struct<name:string,file:string,line:bigint>>")).alias("at", "r"))
    path = F.replace(F.col("r.file"), F.lit("\\"), F.lit("/"))
    rows = rows.select(parse_address(F.concat(F.lit("0x"), F.regexp_replace("at", "^0[xX]", ""))).alias("address"), F.col("r.name").alias("name"), path.alias("normalized_path"), F.greatest(F.col("r.line"), F.lit(0)).alias("line"))
    rows = rows.where("name <> '' AND normalized_path <> '' AND line IS NOT NULL")
    return rows.join(functions.select("function_id", "address", "name"), ["address", "name"]).select("function_id", "normalized_path", "line")


def module_map(docs: DataFrame) -> DataFrame:
    """module_index, name of documents {index: name}."""
    rows = docs.select(F.explode(F.from_json("text", "map<string,string>")).alias("k", "name"))
    return rows.select(F.col("k").cast("bigint").alias("module_index"), "name")


def source_files(spark: SparkSession, root: str) -> DataFrame:
    """relative_path, sha256, byte_length of the source files below a folder, .git left out; contents are hashed where they are read.

    Spark's readers pass over empty files, so those come from the listing.
    """
    base = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.col("path")
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toString().rstrip("/") + "/"
    plain = F.regexp_replace(name, "^([a-z]+:)/+", "$1/")
    relative = F.expr(f"substring(regexp_replace(path, '^([a-z]+:)/+', '$1/'), {len(_plain(top)) + 1})")
    keep = F.lower(plain).rlike("(" + "|".join(s.replace(".", "[.]") for s in SUFFIXES) + ")$") & ~F.contains(plain, F.lit("/.git/"))
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing, empty = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            empty.append((status.getPath().toString(), bytearray(), 0))
    base = base.select("path", "content", "length").unionByName(spark.createDataFrame(empty, "path string, content binary, length long"))
    return base.where(keep).select(relative.alias("relative_path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_length"))


def _plain(path: str) -> str:
    scheme, _, rest = path.partition(":")
    return f"{scheme}:/{rest.lstrip('/')}" if rest else path


def artifacts(spark: SparkSession, path: str) -> DataFrame:
    """content_id, size_bytes of files, whatever they hold."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_id"), F.col("length").alias("size_bytes"))
