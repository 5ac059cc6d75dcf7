"""The matcher's derivations, evidence and counters on adapter views of the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import derivations as dv
from cairn.plans.registry import Tables, register

# Orders are anchors, lines are calls and flows to one of fifty keys, parts relate keys.  Fixed adapter expressions:
_KEY, _SHIFT = "p_partkey % 50", "(p_partkey % 50 + CASE WHEN p_partkey % 5 = 0 AND p_size > 40 THEN 1 ELSE 0 END) % 50"
_PC_NAME = f"CASE WHEN {_KEY} % 3 = 0 THEN 'other' ELSE 'k' END"
_LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_returnflag"  # lines that agree in these repeat
_ROLE = "CASE WHEN l_returnflag = 'R' THEN 'tail_transfer' WHEN l_returnflag = 'A' THEN 'local_direct_call' ELSE 'direct_call' END"


def _matched(t: Tables) -> dv.Matching:
    text = lambda prefix, c: F.concat(F.lit(prefix), F.expr(c).cast("string"))
    end = lambda platform, identity, kind="function": dv.endpoint(platform, kind, identity)

    def alternatives(df, name, key, status, pc, xbox):
        lineage = [text(f"{name}-{k}:", key).alias(k) for k in ("alternative_id", "hypothesis_set_id", "claim_id", "provenance_id")]
        return df.select(*lineage, F.lit("seed").alias("producer"), F.expr(status).alias("status"), end("pc", pc).alias("pc"), end("xbox360", xbox).alias("xbox"))

    key = lambda name, c: F.concat(F.expr(name), F.expr(c).cast("string"))
    anchors = alternatives(t.orders, "o", "o_orderkey", "CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'candidate' END", text("c", "o_orderkey"), text("c", "o_orderkey"))
    maps = alternatives(t.part, "p", "p_partkey", "CASE WHEN p_size = 1 THEN 'derived_non_seed' ELSE 'candidate' END", key(_PC_NAME, _KEY), text("k", _SHIFT))
    line, caller, callee = F.concat_ws("-", *[F.col(f"l_{c}").cast("string") for c in ("orderkey", "linenumber", "partkey", "returnflag")]), text("c", "l_orderkey"), text("k", "l_partkey % 50")
    calls = t.lineitem.select(line.alias("edge_id"), caller.alias("caller_function_id"), end("pc", callee).alias("callee"))
    kind = F.expr("CASE WHEN l_linenumber = 7 THEN 'indirect' ELSE 'function' END")
    ids = [F.concat(F.lit(f"{n}:"), line).alias(n) for n in ("occurrence_id", "extraction_id", "use_id", "use_assertion_id", "site_id", "site_assertion_id")]
    flows = t.lineitem.select(*ids, caller.alias("caller_function_id"), caller.alias("procedure_record_id"), F.expr(_ROLE).alias("role"), end("xbox360", callee, kind).alias("target"))
    return dv.matched(anchors.unionByName(maps), calls, flows, t.spark.createDataFrame([], dv.MEMBER))


def _sid(namespace: str, *parts: str) -> str:
    inner = " || ',' || ".join(parts)
    return f"'{namespace}:sha256:' || sha256('{{\"components\":[' || {inner} || '],\"namespace\":\"{namespace}\"}}')"


_END = lambda platform, c: f"""'["{platform}","function","' || {c} || '","","",-1,""]'"""
_Q = lambda c: f"""'"' || {c} || '"'"""

_WITH = f"""
WITH alternatives AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'rejected' ELSE 'candidate' END AS status, 'c' || o_orderkey AS pc, 'c' || o_orderkey AS xbox FROM orders
  UNION ALL SELECT CASE WHEN p_size = 1 THEN 'derived_non_seed' ELSE 'candidate' END, {_PC_NAME} || {_KEY}, 'k' || ({_SHIFT}) FROM part),
bundles AS (SELECT pc, xbox, {_sid("control-flow-mapping-bundle", _END("pc", "pc"), _END("xbox360", "xbox"))} AS b FROM (SELECT DISTINCT pc, xbox FROM alternatives WHERE status = 'candidate')),
anchors AS (SELECT pc, xbox, b, {_sid("control-flow-neighborhood", _Q("b"))} AS hood FROM bundles),
calls AS (SELECT DISTINCT {_LINE} AS edge_id, 'c' || l_orderkey AS caller, 'k' || (l_partkey % 50) AS callee FROM lineitem),
flows AS (
  SELECT DISTINCT 'occurrence_id:' || {_LINE} AS occurrence_id, 'c' || l_orderkey AS caller, 'k' || (l_partkey % 50) AS target, {_ROLE} AS role,
    CASE WHEN l_returnflag <> 'R' THEN CASE WHEN l_linenumber = 7 THEN 'indirect_target' END ELSE 'tail_transfer_not_pc_call_equivalent' END AS reason
  FROM lineitem),
left_ AS (SELECT DISTINCT b, hood, callee FROM anchors JOIN calls ON caller = pc),
right_ AS (SELECT DISTINCT b, hood, target FROM anchors JOIN flows ON caller = xbox WHERE reason IS NULL),
rel AS (SELECT l.b, l.hood, callee, target, m.b AS via FROM left_ l JOIN bundles m ON m.pc = callee JOIN right_ r ON r.b = l.b AND r.target = m.xbox),
graded AS (SELECT *, count(*) OVER (PARTITION BY b, callee) = 1 AND count(*) OVER (PARTITION BY b, target) = 1 AS closed FROM rel),
squares AS (
  SELECT *, {_sid("control-flow-closed-square", _Q("hood"), _Q("relation_id"))} AS derivation_id
  FROM (SELECT *, {_sid("control-flow-candidate-relation", _END("pc", "callee"), _END("xbox360", "target"), "'[\"' || via || '\"]'")} AS relation_id FROM graded WHERE closed)),
free AS (
  SELECT b, count(*) FILTER (WHERE side = 'l') AS nl, count(*) FILTER (WHERE side = 'r') AS nr, min(k) FILTER (WHERE side = 'l') AS l, min(k) FILTER (WHERE side = 'r') AS r
  FROM (SELECT b, 'l' AS side, callee AS k FROM left_ WHERE (b, callee) NOT IN (SELECT (b, callee) FROM rel) UNION ALL SELECT b, 'r', target FROM right_ WHERE (b, target) NOT IN (SELECT (b, target) FROM rel)) GROUP BY 1),
held AS (SELECT b, hood, string_agg('"' || derivation_id || '"', ',' ORDER BY callee, target) AS ids, list(via) AS vias FROM squares GROUP BY 1, 2),
residuals AS (
  SELECT *, {_sid("control-flow-proposal-derivation", _Q("proposal_id"), _Q("hood"), "'[' || ids || ']'")} AS derivation_id
  FROM (SELECT b, hood, l, r, ids, vias, {_sid("control-flow-proposal", _END("pc", "l"), _END("xbox360", "r"))} AS proposal_id
    FROM held JOIN free USING (b) WHERE nl = 1 AND nr = 1 AND b NOT IN (SELECT b FROM graded WHERE NOT closed))),
evidence AS (
  SELECT {_sid("control-flow-evidence", _Q("kind"), _Q("derivation_id"), _Q("edge_id"), _Q("occurrence_id"))} AS evidence_id, kind AS evidence_kind, subject_id, derivation_id, edge_id AS pc_edge_id, occurrence_id AS xbox_occurrence_id
  FROM (SELECT b, 'closed_call_square' AS kind, relation_id AS subject_id, derivation_id, callee AS k, target AS m FROM squares UNION ALL SELECT b, 'unique_residual_call_pair', proposal_id, derivation_id, l, r FROM residuals) d
  JOIN anchors a USING (b) JOIN calls c ON c.caller = a.pc AND callee = k JOIN flows f ON f.caller = a.xbox AND target = m AND reason IS NULL)
"""


@register("matcher_square_derivations", _WITH + "SELECT derivation_id, relation_id, hood AS neighborhood_id, b AS conditional_on_caller_bundle_id, via AS target_mapping_bundle_ids FROM squares")
def matcher_square_derivations(t):
    return _matched(t).squares.withColumn("target_mapping_bundle_ids", F.array_join("target_mapping_bundle_ids", ","))


@register("matcher_proposal_derivations", _WITH + "SELECT derivation_id, proposal_id, hood AS neighborhood_id, array_to_string(list_sort(list_distinct(list_append(vias, b))), ',') AS conditional_on_mapping_bundle_ids, replace(ids, '\"', '') AS supporting_closed_square_derivation_ids FROM residuals")
def matcher_proposal_derivations(t):
    lists = ("conditional_on_mapping_bundle_ids", "supporting_closed_square_derivation_ids")
    return _matched(t).proposal_derivations.withColumns({c: F.array_join(c, ",") for c in lists})


@register("matcher_evidence", _WITH + "SELECT * FROM evidence")
def matcher_evidence(t):
    return _matched(t).evidence.select("evidence_id", "evidence_kind", "subject_id", "derivation_id", "pc_edge_id", "xbox_occurrence_id")


_COUNTERS = {
    "source_mapping_alternatives": "SELECT count(*) FROM alternatives",
    "semantic_mapping_bundles": "SELECT count(*) FROM bundles",
    "caller_anchor_bundles": "SELECT count(*) FROM anchors",
    "caller_anchor_neighborhoods_with_both_graph_sides": "SELECT count(*) FROM anchors WHERE b IN (SELECT b FROM left_) AND b IN (SELECT b FROM right_)",
    "closed_square_derivations": "SELECT count(*) FROM squares",
    "closed_square_evidence_occurrences": "SELECT count(*) FROM evidence WHERE evidence_kind = 'closed_call_square'",
    "blocked_neighborhoods": "SELECT count(DISTINCT b) FROM graded WHERE NOT closed",
    "fold_member_blocked_neighborhoods": "SELECT 0",
    "residual_proposal_derivations": "SELECT count(*) FROM residuals",
    "proposal_sets": "SELECT count(DISTINCT l) FROM residuals",
    "proposal_alternatives": "SELECT count(DISTINCT proposal_id) FROM residuals",
    "proposal_evidence_occurrences": "SELECT count(*) FROM evidence WHERE evidence_kind = 'unique_residual_call_pair'",
    "source_xbox_occurrences": "SELECT count(*) FROM flows",
    "eligible_xbox_occurrences": "SELECT count(*) FROM flows WHERE reason IS NULL",
}
_BY = {"excluded_mapping_status_counts": ("status", "alternatives WHERE status <> 'candidate'"), "excluded_xbox_occurrence_counts": ("reason", "flows WHERE reason IS NOT NULL"), "excluded_xbox_role_counts": ("role", "flows WHERE reason IS NOT NULL")}
_ALL = [f"SELECT '{n}' AS counter, NULL AS key, ({q}) AS value" for n, q in _COUNTERS.items()] + [f"SELECT '{n}', {k}, count(*) FROM {rows} GROUP BY 2" for n, (k, rows) in _BY.items()]


@register("matcher_counters", _WITH + " UNION ALL ".join(_ALL))
def matcher_counters(t):
    return _matched(t).summary
