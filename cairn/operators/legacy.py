"""Older name maps as claims and evidence: formats are rows of a rule table, and nothing in them is taken as truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions.expr import json_text, parse_address, stable_id

# Channels whose observations hang on each other share an independence group.
GROUPS = {
    "vtable": "class_slot_alignment",
    "vtable_recon": "class_slot_alignment",
    "vmatch": "class_slot_alignment",
    "graph": "call_graph",
    "pgm": "call_graph",
    "strmatch": "string_reference",
    "public": "public_reference_context",
    "source": "source_file_context",
    "seed": "legacy_seed_unknown",
    "agent": "decompiler_agent_review",
    "assign": "legacy_composite_structural",
    "fingerprint": "legacy_composite_structural",
    "calleealign": "legacy_composite_structural",
    "wrappers": "public_wrapper_consensus",
    "constmatch": "constant_reference",
}
# Artifacts by format, shape, channel, effect of an observation, and for experiments what they were derived from.
RULES = [
    ("names_final", "names", "legacy_master", "context", None),
    ("names_tiered", "tiered", "legacy_tier", "context", None),
    ("namemap", "channels", None, "supports", None),
    ("strmatch", "mapping", "strmatch", "supports", None),
    ("pgm", "mapping", "pgm", "supports", None),
    ("matched_ghidra", "graph", None, None, None),
    ("all_seeds", "mapping", "seed", "context", None),
    ("assign", "mapping", "assign", "context", None),
    ("vmatch", "mapping", "vmatch", "supports", None),
    ("fingerprint", "mapping", "fingerprint", "context", "legacy seeds + name-keyed call graph + CFG + vcall + size"),
    ("calleealign", "mapping", "calleealign", "context", "legacy seeds + name-keyed call graph + composite assignment"),
    ("calleealign_new", "mapping", "calleealign", "context", "legacy seeds + name-keyed call graph + composite assignment"),
    ("wrappers", "mapping", "wrappers", "supports", "third-party plugin PDB thin-wrapper author consensus"),
    ("pgm2", "mapping", "pgm", "supports", "name-keyed call-graph propagation; same dependency as pgm"),
    ("pgm_new", "mapping", "pgm", "supports", "name-keyed call-graph propagation; same dependency as pgm"),
    ("constmatch", "mapping", "constmatch", "context", "cross-build numeric constants keyed through legacy Xbox names"),
    ("agent_verdicts", "verdicts", "agent", None, None),
]
#: Channels of context alone; they propose no identity.
CONTEXT = ("public", "source")
_MAP = "map<string,string>"


def read(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """format, artifact, key, record: the entries of each file, ``paths`` being a file for each format.

    A file is one JSON value, an object by address or, for verdicts, an array;
    so one file is one task.  A file that is neither is an error.
    """
    parts = []
    shapes = {f: shape for f, shape, *_ in RULES}
    for name, path in paths.items():
        text = spark.read.text(path, wholetext=True).select(F.lit(name).alias("format"), F.lit(path.rsplit("/", 1)[-1]).alias("artifact"), F.trim("value").alias("value"))
        kind, first = ("array<string>", "[") if shapes[name] == "verdicts" else (_MAP, "{")
        value = F.from_json("value", kind)
        good = F.when(F.col("value").startswith(first) & value.isNotNull(), value).otherwise(F.raise_error(F.concat(F.col("artifact"), F.lit(": expected a JSON " + ("array" if first == "[" else "object")))))
        entries = F.posexplode(good).alias("key", "record") if first == "[" else F.explode(good).alias("key", "record")
        parts.append(text.select("format", "artifact", entries).select("format", "artifact", F.col("key").cast("string").alias("key"), "record"))
    return reduce(DataFrame.unionByName, parts)


def _named(name: Column, where: Column) -> Column:
    return F.when(F.coalesce(F.length(name), F.lit(0)) > 0, name).otherwise(F.raise_error(F.concat(F.lit("empty legacy name at "), F.coalesce(where, F.lit("null")))))


def _at(text: Column) -> Column:
    return F.coalesce(parse_address(text), F.raise_error(F.concat(F.lit("not an address: "), F.coalesce(text, F.lit("null")))).cast("bigint"))


def _verdict(text: Column) -> Column:
    return F.when(F.upper(text) == "CONFIRM", "supports").when(F.upper(text) == "REJECT", "contradicts").otherwise("context")


def _group(channel: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in GROUPS.items() for x in pair])
    special = F.when(channel.isin("legacy_master", "legacy_tier"), "legacy_accumulator")
    return F.coalesce(special, F.get(F.filter(F.array(known[channel]), lambda x: x.isNotNull()), F.lit(0)), F.concat(F.lit("legacy_channel:"), channel))


def _rule_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(RULES, "format string, shape string, channel string, effect string, lineage string"))  # seventeen rows


def observations(entries: DataFrame) -> DataFrame:
    """pc_address, name, channel, kind, effect, independence_group, artifact, tier, details: all that the entries say, one row for each statement.

    Formats differ by a joined rule alone; each shape of record is a branch of
    expressions.  ``details`` is what else a record says, values as text.
    Context channels of a channel map are not here; see ``contexts``.  An empty
    name and a key that is no address are errors.
    """
    ruled = entries.join(_rule_table(entries.sparkSession), "format")
    rec = F.from_json("record", _MAP)
    none = F.create_map().cast(_MAP)
    # errors are guarded by the format, as Spark may ask for an address before it drops rows of other formats
    mine = lambda shape: F.col("format").isin([f for f, s, *_ in RULES if s == shape])
    told = lambda df, address, name, channel, kind, effect, details, tier=None: df.select(address.alias("pc_address"), name.alias("name"), channel.alias("channel"), kind.alias("kind"), effect.alias("effect"), "artifact", (F.lit(None).cast("string") if tier is None else tier).alias("tier"), details.alias("details"))
    lit = F.lit
    key = F.col("key")
    of = lambda shape: ruled.where(mine(shape)).withColumn("_ok", mine(shape))
    at = lambda text: F.when(F.col("_ok"), _at(text))
    named = lambda name, where: F.when(F.col("_ok"), _named(name, where))
    out = [told(of("names"), at(key), named(F.col("record"), key), F.col("channel"), lit("selected_claim_record"), F.col("effect"), none)]

    r = of("mapping").withColumn("r", rec)
    extra = F.when(F.col("lineage").isNotNull(), F.create_map(lit("experimental_artifact"), lit("true"), lit("lineage"), F.col("lineage"))).otherwise(none)
    rest = lambda *without: F.map_filter("r", lambda k, v: ~k.isin(*without))
    out.append(told(r, at(key), named(F.col("r")["name"], key), F.col("channel"), lit("raw_candidate_observation"), F.col("effect"), F.map_concat(F.map_filter(rest("name"), lambda k, v: ~k.isin("experimental_artifact", "lineage")), extra)))

    r = of("graph").withColumn("r", rec).withColumn("deep", F.coalesce(F.col("r")["depth"].try_cast("int"), lit(0)) > 0)  # depth zero is what the graph was seeded with
    pick = lambda yes, no: F.when(F.col("deep"), yes).otherwise(no)
    out.append(told(r, at(key), named(F.col("r")["name"], key), pick("graph", "seed"), pick("raw_graph_propagation", "raw_graph_seed_input"), pick("supports", "context"), rest("name")))

    r = of("tiered").withColumn("r", rec).withColumn("at", at(key)).withColumn("named", named(F.col("r")["name"], key)).withColumn("t", F.nullif(F.col("r")["tier"], lit("")))
    out.append(told(r, F.col("at"), F.col("named"), F.col("channel"), lit("legacy_classification"), F.col("effect"), F.map_filter(F.create_map(lit("tier"), F.col("t")), lambda k, v: v.isNotNull()), F.col("t")))
    each = r.withColumn("c", F.explode(F.from_json(F.col("r")["channels"], "array<string>")))
    context = F.col("c").isin(*CONTEXT)
    out.append(told(each, F.col("at"), F.col("named"), F.col("c"), F.when(context, "context").otherwise("identity_support"), F.when(context, "context").otherwise("supports"), F.map_filter("r", lambda k, v: k.isin("depth", "shared", "votes", "agent"))))
    agent = r.where(F.col("r")["agent"].isNotNull())
    out.append(told(agent, F.col("at"), F.col("named"), lit("agent"), lit("agent_verdict_summary"), _verdict(F.col("r")["agent"]), F.create_map(lit("verdict"), F.col("r")["agent"], lit("summary_only"), lit("true"))))

    # a channel map says whether it agrees with the name that the accumulator has for the address
    tiered = of("tiered").select("key", F.nullif(rec["name"], lit("")).alias("one"), lit(True).alias("there"))
    final = of("names").select("key", F.col("record").alias("two"))
    r = of("channels").select("key", "artifact", "effect", "_ok", F.explode(rec).alias("c", "value")).where(~F.col("c").startswith("_") & ~F.col("c").isin(*CONTEXT))
    r = r.join(tiered, "key", "left").join(final, "key", "left").withColumn("master", F.when(F.col("there"), F.col("one")).otherwise(F.col("two")))
    out.append(told(r, at(key), named(F.col("value"), key), F.col("c"), lit("identity_support"), F.col("effect"), F.create_map(lit("agrees_with_legacy_master"), F.col("value").eqNullSafe(F.col("master")).cast("string"))))

    r = of("verdicts").withColumn("r", rec)
    out.append(told(r, at(F.col("r")["address"]), named(F.col("r")["claim"], F.col("r")["address"]), F.col("channel"), lit("raw_agent_verdict"), _verdict(F.coalesce(F.col("r")["verdict"], lit(""))), F.map_concat(F.map_filter(rest("address", "claim"), lambda k, v: k != "row"), F.create_map(lit("row"), key))))
    rows = reduce(DataFrame.unionByName, out)
    return rows.withColumn("independence_group", _group(F.col("channel")))


def contexts(entries: DataFrame) -> DataFrame:
    """pc_address, channel, value, artifact: what a channel map says besides identities."""
    own = F.col("format") == "namemap"
    r = entries.where(own).withColumn("_ok", own).select("_ok", "key", "artifact", F.explode(F.from_json("record", _MAP)).alias("channel", "value")).where(F.col("channel").isin(*CONTEXT))
    return r.select(F.when(F.col("_ok"), _at(F.col("key"))).alias("pc_address"), "channel", "value", "artifact")


def claims(rows: DataFrame, functions: DataFrame) -> DataFrame:
    """A claim for each address and name: claim_id, pc_address, pc_function_id, proposed_name, resolution, legacy_tier, evidence_count.

    functions: function_id, address.  An address that is no entry stays
    unresolved; it is never moved to a function around it.
    """
    g = rows.groupBy("pc_address", F.col("name").alias("proposed_name")).agg(F.max("tier").alias("legacy_tier"), F.count("*").alias("evidence_count"))
    digest = F.substring(F.sha2(F.col("proposed_name").cast("binary"), 256), 1, 16)
    claim_id = F.concat(F.lit("legacy:pc:ram:"), F.lower(F.lpad(F.hex("pc_address"), 8, "0")), F.lit(":"), digest)
    j = g.join(functions.select(F.col("address").alias("pc_address"), F.col("function_id").alias("pc_function_id")), "pc_address", "left")
    resolution = F.when(F.col("pc_function_id").isNotNull(), "function_entry").otherwise("unresolved_address")
    return j.select(claim_id.alias("claim_id"), "pc_address", "pc_function_id", "proposed_name", resolution.alias("resolution"), "legacy_tier", "evidence_count")


def evidence(rows: DataFrame) -> DataFrame:
    """Each claim's evidence in a total order, ``ordinal`` from zero: stored once a claim, however many ends its name has."""
    digest = F.substring(F.sha2(F.col("name").cast("binary"), 256), 1, 16)
    claim_id = F.concat(F.lit("legacy:pc:ram:"), F.lower(F.lpad(F.hex("pc_address"), 8, "0")), F.lit(":"), digest)
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("details"))))
    r = rows.select(claim_id.alias("claim_id"), "artifact", "channel", "kind", "effect", "independence_group", text.alias("details_json"))
    return r.withColumn("ordinal", F.row_number().over(Window.partitionBy("claim_id").orderBy("artifact", "channel", "kind", "effect", "details_json")) - 1)


def resolved(claim_rows: DataFrame, procedures: DataFrame, program_id: str) -> tuple[DataFrame, DataFrame]:
    """What claims' names lead to on the other side: alternatives, and the unresolved targets that they need.

    procedures: function_id, name.  A name of one procedure has one alternative,
    a name of several all of them, unordered; a name of none leads to one
    unresolved target that all its claims share.  Returns (claim_id,
    hypothesis_set_id, match_claim_id, alternative_id, xbox_function_id,
    xbox_target_id, candidate_count) and (target_id, program_id, target_kind,
    name_hint, reason).  Names are joined, never searched.
    """
    named = procedures.select("name", "function_id").distinct()
    counts = named.groupBy("name").agg(F.count("*").alias("candidate_count"))
    c = claim_rows.select("claim_id", F.col("proposed_name").alias("name"))
    j = c.join(counts, "name", "left").join(named, "name", "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
    text = lambda name: json_text(F.col(name), "string")
    target = stable_id("unresolved-target", json_text(F.lit(program_id), "string"), json_text(F.lit("unresolved_symbol_name"), "string"), text("name"))
    j = j.withColumn("xbox_target_id", F.when(F.col("function_id").isNull(), target)).withColumn("hypothesis_set_id", stable_id("legacy-hypothesis-set", text("claim_id")))
    j = j.withColumn("match_claim_id", stable_id("legacy-match", text("claim_id"), text("function_id"), text("xbox_target_id")))
    j = j.withColumn("alternative_id", stable_id("legacy-hypothesis-alternative", text("hypothesis_set_id"), text("match_claim_id")))
    targets = j.where("xbox_target_id IS NOT NULL").select(F.col("xbox_target_id").alias("target_id"), F.lit(program_id).alias("program_id"), F.lit("unresolved_symbol_name").alias("target_kind"), F.col("name").alias("name_hint"), F.lit("legacy name has no exact lossless PDB procedure-name match").alias("reason")).distinct()
    return j.select("claim_id", "hypothesis_set_id", "match_claim_id", "alternative_id", F.col("function_id").alias("xbox_function_id"), "xbox_target_id", "candidate_count"), targets


def summary(alternatives: DataFrame, targets: DataFrame) -> DataFrame:
    """unique_matches, ambiguous_claims, unmatched_claims, alternatives, shared_targets, in one row."""
    per = alternatives.groupBy("claim_id").agg(F.max("candidate_count").alias("n"), F.count("*").alias("a"))
    counts = per.agg(F.count_if(F.col("n") == 1).alias("unique_matches"), F.count_if(F.col("n") > 1).alias("ambiguous_claims"), F.count_if(F.col("n") == 0).alias("unmatched_claims"), F.coalesce(F.sum("a"), F.lit(0)).alias("alternatives"))
    return counts.withColumn("shared_targets", targets.agg(F.count("*").alias("n")).scalar())
