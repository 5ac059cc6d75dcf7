"""Legacy channels on adapter views of the driver tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import legacy
from cairn.plans.registry import Tables, register

# Entries: suppliers are an accumulator of names, parts raw observations of three formats, orders a graph, lines verdicts.
_STATED = """
WITH stated AS (
  SELECT CAST(s_suppkey AS BIGINT) AS pc_address, s_name AS name, 'legacy_master' AS channel, 'selected_claim_record' AS kind, 'context' AS effect, 'legacy_accumulator' AS independence_group FROM supplier
  UNION ALL SELECT p_partkey, p_brand, (['strmatch', 'pgm', 'fingerprint'])[CAST(p_size % 3 AS INTEGER) + 1], 'raw_candidate_observation', CASE WHEN p_size % 3 = 2 THEN 'context' ELSE 'supports' END, (['string_reference', 'call_graph', 'legacy_composite_structural'])[CAST(p_size % 3 AS INTEGER) + 1] FROM part
  UNION ALL SELECT o_custkey, o_orderpriority, CASE WHEN o_orderkey % 3 > 0 THEN 'graph' ELSE 'seed' END, CASE WHEN o_orderkey % 3 > 0 THEN 'raw_graph_propagation' ELSE 'raw_graph_seed_input' END, CASE WHEN o_orderkey % 3 > 0 THEN 'supports' ELSE 'context' END, CASE WHEN o_orderkey % 3 > 0 THEN 'call_graph' ELSE 'legacy_seed_unknown' END FROM orders
  UNION ALL SELECT l_suppkey, 'n' || l_linenumber, 'agent', 'raw_agent_verdict', CASE l_returnflag WHEN 'A' THEN 'supports' WHEN 'R' THEN 'contradicts' ELSE 'context' END, 'decompiler_agent_review' FROM lineitem),
claims AS (SELECT pc_address, name, count(*) AS evidence_count, 'legacy:pc:ram:' || lpad(lower(to_hex(pc_address)), 8, '0') || ':' || substr(sha256(name), 1, 16) AS claim_id FROM stated GROUP BY 1, 2)
"""


def _observations(t: Tables) -> DataFrame:
    entry = lambda df, form, key, record: df.select(F.expr(form).alias("format"), F.lit("a.json").alias("artifact"), F.expr(key).alias("key"), F.expr(record).alias("record"))
    parts = [
        entry(t.supplier, "'names_final'", "'0x' || lower(hex(s_suppkey))", "s_name"),
        entry(t.part, "element_at(array('strmatch', 'pgm2', 'fingerprint'), CAST(p_size % 3 + 1 AS INT))", "CAST(p_partkey AS STRING)", "to_json(named_struct('name', p_brand, 'score', p_size))"),
        entry(t.orders, "'matched_ghidra'", "CAST(o_custkey AS STRING)", "to_json(named_struct('name', o_orderpriority, 'depth', o_orderkey % 3))"),
        entry(t.lineitem, "'agent_verdicts'", "'0'", "to_json(named_struct('address', CAST(l_suppkey AS STRING), 'claim', 'n' || l_linenumber, 'verdict', CASE l_returnflag WHEN 'A' THEN 'CONFIRM' WHEN 'R' THEN 'reject' ELSE 'unsure' END))"),
    ]
    return legacy.observations(reduce(DataFrame.unionByName, parts))


@register("legacy_statements", _STATED + "SELECT channel, kind, effect, independence_group, count(*) AS statement_count FROM stated GROUP BY 1, 2, 3, 4")
def legacy_statements(t):
    return _observations(t).groupBy("channel", "kind", "effect", "independence_group").agg(F.count("*").alias("statement_count"))


@register("legacy_claims", _STATED + "SELECT claim_id, pc_address, CAST(p_partkey AS VARCHAR) AS pc_function_id, name AS proposed_name, CASE WHEN p_partkey IS NULL THEN 'unresolved_address' ELSE 'function_entry' END AS resolution, evidence_count FROM claims LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON p_partkey = pc_address")
def legacy_claims(t):
    known = t.part.where("p_size > 5").select(F.col("p_partkey").cast("string").alias("function_id"), F.col("p_partkey").alias("address"))
    return legacy.claims(_observations(t), known).drop("legacy_tier")


@register(
    "legacy_resolution",
    _STATED + ", procedures AS (SELECT DISTINCT p_brand AS name, CAST(p_size AS VARCHAR) AS f FROM part), n AS (SELECT claim_id, name, (SELECT count(*) FROM procedures p WHERE p.name = c.name) AS n FROM claims c) "
    "SELECT count(*) FILTER (WHERE n = 1) AS unique_matches, count(*) FILTER (WHERE n > 1) AS ambiguous_claims, count(*) FILTER (WHERE n = 0) AS unmatched_claims, CAST(sum(greatest(n, 1)) AS BIGINT) AS alternatives, count(DISTINCT name) FILTER (WHERE n = 0) AS shared_targets FROM n",
)
def legacy_resolution(t):
    procedures = t.part.select(F.col("p_brand").alias("name"), F.col("p_size").cast("string").alias("function_id"))
    none = t.part.limit(0).select(F.lit("").alias("function_id"), F.lit(0).cast("long").alias("address"))
    return legacy.summary(*legacy.resolved(legacy.claims(_observations(t), none), procedures, "x"))
