"""Set-based writes, and export plans of what a reviewer has accepted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import joined


def conflicts(new: DataFrame, old: DataFrame, key: str, immutable: list[str]) -> DataFrame:
    """New rows whose key exists with another value in an immutable column, nulls equal to nulls."""
    o = old.select(key, *[F.col(c).alias(f"_{c}") for c in immutable])
    differs = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in immutable])
    return new.join(o, key).where(differs).select(*new.columns)


def additions(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """New rows whose key isn't there yet."""
    return new.join(old.select(key), key, "left_anti")


def upserted(new: DataFrame, old: DataFrame, key: str) -> DataFrame:
    """The old rows that no new one replaces, and the new ones."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


#: Address spaces in which a pc function can be patched.
RUNTIME_SPACES = ("ram", "va")


#: Reasons that are told once the endpoints are.
_LATER = ("ambiguous_xbox_names", "conflicting_accepted_destination", "conflicting_accepted_name", "missing_xbox_name", "provenance_manifest_mismatch")


def export_plan(accepted: DataFrame) -> DataFrame:
    """Accepted leaves with the reasons that block each, sorted and comma-joined, and ``action``.

    accepted: decision_id, target_kind (hypothesis_set, alternative or claim),
    xbox_fold_group_id, claim_id, set_pc_function_id, pc_function_id,
    xbox_function_id; of the endpoints, null where they are missing:
    pc_platform, pc_program_id, pc_address_space, pc_address, xbox_platform;
    name_count and name, the distinct primary names of the xbox function; and
    manifest_ok.  Accepting a set chooses none of its alternatives.  Leaves of
    one pc entry that name different functions or names conflict, all of them.

    A reason is a bit of a number until the text is made, at the end; conflicts
    are a window over the entry, the only shuffle.
    """
    set_, fold = F.col("target_kind") == "hypothesis_set", (F.col("target_kind") == "alternative") & F.col("xbox_fold_group_id").isNotNull()
    scalar = ~set_ & ~fold & F.col("claim_id").isNotNull()
    subject = F.when(scalar, F.col("pc_function_id")).otherwise(F.col("set_pc_function_id"))
    there = F.col("pc_platform").isNotNull()
    runtime = F.coalesce(F.col("pc_address_space").isin(*RUNTIME_SPACES), F.lit(False))
    several = set_ | fold | scalar
    named = {
        "hypothesis_set_only_acceptance": set_,
        "xbox_fold_bundle": fold,
        "missing_scalar_claim": ~several,
        "pc_unresolved_endpoint": several & subject.isNull(),
        "missing_pc_function": several & subject.isNotNull() & ~there,
        # for a bundle the first of these ends it; for a claim all count
        "pc_endpoint_wrong_platform": (fold | scalar) & subject.isNotNull() & there & (F.col("pc_platform") != "pc"),
        "pc_address_space_not_runtime": subject.isNotNull() & there & ~runtime & (scalar | fold & (F.col("pc_platform") == "pc")),
        "xbox_unresolved_endpoint": scalar & F.col("xbox_function_id").isNull(),
        "missing_xbox_function": scalar & F.col("xbox_function_id").isNotNull() & F.col("xbox_platform").isNull(),
        "xbox_endpoint_wrong_platform": scalar & F.col("xbox_function_id").isNotNull() & F.coalesce(F.col("xbox_platform") != "xbox360", F.lit(False)),
        "alternative_pc_subject_mismatch": scalar & (F.col("target_kind") == "alternative") & ~F.col("set_pc_function_id").eqNullSafe(F.col("pc_function_id")),
    }
    bit = {n: 1 << k for k, n in enumerate(sorted([*named, *_LATER]))}
    marked = lambda pairs: reduce(lambda x, y: x.bitwiseOR(y), [F.when(F.coalesce(c, F.lit(False)), F.lit(bit[n])).otherwise(F.lit(0)) for n, c in pairs.items()])
    rows = accepted.withColumn("_ends", marked(named))
    whole = F.col("_ends") == 0
    own = {"missing_xbox_name": whole & (F.col("name_count") == 0), "ambiguous_xbox_names": whole & (F.col("name_count") > 1), "provenance_manifest_mismatch": ~F.col("manifest_ok")}
    rows = rows.withColumn("_own", F.col("_ends").bitwiseOR(marked(own)))
    # leaves that nothing blocks meet at their pc entry; the others, which may have none, are dealt anywhere
    free = F.col("_own") == 0
    entry = [F.when(free, F.col(c)) for c in ("pc_program_id", "pc_address_space", "pc_address")]
    at = Window.partitionBy(*entry, F.when(~free, F.pmod(F.xxhash64("decision_id"), F.lit(10_000))))
    several = lambda c: free & (F.min(F.when(free, F.col(c))).over(at) != F.max(F.when(free, F.col(c))).over(at))
    rows = rows.withColumn("_all", F.col("_own").bitwiseOR(marked({"conflicting_accepted_destination": several("xbox_function_id"), "conflicting_accepted_name": several("name")})))
    why = F.concat_ws(",", *[F.when(F.col("_all").bitwiseAND(F.lit(k)) != 0, n) for n, k in bit.items()])
    return rows.select(*accepted.columns, why.alias("reasons"), F.when(F.col("_all") == 0, "apply").otherwise("blocked").alias("action"))


def applied(plan: DataFrame) -> DataFrame:
    """One action for each pc entry, the lineages that agree on it consolidated, under the first decision."""
    g = plan.where("action = 'apply'").groupBy("pc_program_id", "pc_address_space", "pc_address")
    return g.agg(F.min("name").alias("name"), F.min("xbox_function_id").alias("xbox_function_id"), F.count("*").alias("lineage_count"), F.min("decision_id").alias("first_decision_id"))


def blocked_counts(plan: DataFrame) -> DataFrame:
    one = plan.where("action = 'blocked'").select(F.explode(F.split("reasons", ",")).alias("reason"))
    return one.groupBy("reason").agg(F.count("*").alias("decision_count"))


def unmistakable(*values: Column) -> Column:
    """Values as one text that no other values share: each has its length before it, and a null has a mark of its own."""
    one = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    return F.concat(*[one(v) for v in values])


def manifest(entries: DataFrame) -> DataFrame:
    """The entries of each manifest in order as one digest: role, name, content and size, none to be mistaken for another."""
    line = unmistakable(*[F.col(c) for c in ("role", "logical_name", "content_id", "size_bytes")])
    g = entries.groupBy("manifest_id").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.count("*").alias("entry_count"))
    return g.select("manifest_id", "entry_count", F.sha2(F.array_join("lines", "\n"), 256).alias("digest"))


def producers_of(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(joined(F.collect_set("producer")).alias("producers"))


def lineage(components: DataFrame, required) -> DataFrame:
    """Targets with their provenance components: whether each kind has one of the required manifest, and so all have."""
    per = components.groupBy("target_id", "component_kind").agg(F.coalesce(F.bool_or(F.col("manifest_id") == F.lit(required)), F.lit(False)).alias("ok"))
    return per.groupBy("target_id").agg(F.count("*").alias("component_count"), F.bool_and("ok").alias("compatible"), joined(F.collect_set(F.when(~F.col("ok"), F.col("component_kind")))).alias("incompatible"))


def row_digests(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """A digest of each group's rows in order, every value with its length before it and nulls marked, so no two row streams share a text."""
    text = unmistakable(*[F.col(n) for n in columns])
    g = rows.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))).alias("r"))
    return g.select(by, F.size("r").cast("long").alias("row_count"), F.sha2(F.array_join(F.transform("r", lambda x: x["_text"]), ""), 256).alias("digest"))


def altered_manifests(manifests: DataFrame, entries: DataFrame) -> DataFrame:
    """Manifests (manifest_id, canonical_json) whose id isn't the digest of their text, or whose text doesn't list just their entries in order."""
    kind = "struct<entries:array<struct<role:string,logical_name:string,content_id:string>>>"
    own = entries.groupBy("manifest_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "role", "logical_name", "content_id"))), lambda x: F.struct(x["role"], x["logical_name"], x["content_id"])).alias("held"))
    j = manifests.join(own, "manifest_id", "left").withColumn("said", F.from_json("canonical_json", kind)["entries"])
    plain = lambda c: F.transform(c, lambda x: unmistakable(x["role"], x["logical_name"], x["content_id"]))
    held = plain(F.coalesce("held", F.array()))
    good = F.col("manifest_id").endswith(F.sha2("canonical_json", 256)) & (plain(F.col("said")) == held)
    return j.where(~F.coalesce(good, F.lit(False))).select("manifest_id")


def write_tagged(parts: dict[str, DataFrame], path: str) -> None:
    """Rows of several tables as JSON lines, each with its ``record`` tag first, by tag and then as the tables are sorted; Spark's writer, so a lost executor repeats its task."""
    made = []
    for k, (tag, df) in enumerate(sorted(parts.items())):
        text = F.to_json(F.struct(F.lit(tag).alias("record"), *[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"})
        made.append(df.select(F.lit(k).alias("_k"), text.alias("value")))
    rows = reduce(DataFrame.unionByName, made)
    rows.repartitionByRange("_k", "value").sortWithinPartitions("_k", "value").select("value").write.text(path)


def private_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, rows of private tables that aren't empty: nothing may be published with one."""
    parts = [df.agg(F.count("*").alias("rows")).select(F.lit(n).alias("table_name"), "rows") for n, df in tables.items()]
    return reduce(DataFrame.unionByName, parts).where("rows > 0")
