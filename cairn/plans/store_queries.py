"""The queue's digest, and checks of appended decisions and of loads, on adapter views of the driver tables."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from cairn.operators import decisions, digest, load
from cairn.plans import review_queries
from cairn.plans.registry import Tables, register

_TEXT = "length(a) || ':' || a || length(b) || ':' || b"
_TREE = f"""
texts AS (SELECT sha256({_TEXT}) AS h, count(*) AS n FROM (SELECT CAST(triage_rank AS VARCHAR) AS a, CAST(hypothesis_set_id AS VARCHAR) AS b FROM triage) GROUP BY {_TEXT}),
two AS (SELECT substr(h, 1, 2) AS p, sum(n) AS n, sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS d FROM texts GROUP BY 1),
one AS (SELECT substr(p, 1, 1) AS p, sum(n) AS n, sha256(string_agg(p || ':' || d, ',' ORDER BY p || ':' || d)) AS d FROM two GROUP BY 1)
"""


@register("queue_digest", f"WITH {review_queries._SETS}, {_TREE} SELECT CAST(sum(n) AS BIGINT) AS row_count, sha256(string_agg(p || ':' || d, ',' ORDER BY p || ':' || d)) AS digest FROM one")
def queue_digest(t):
    return digest.tree_digest(review_queries.index(t), ["triage_rank", "hypothesis_set_id"], depth=2)


# Decisions: events.  Errors and sign-ups are appended to the others; some name no or an older predecessor, or say nothing.
_APPENDED = """
WITH chained AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS reviewer_id, CAST(CAST(floor(value) AS BIGINT) % 50 AS VARCHAR) AS target, ts, event_type,
    lag(event_id) OVER w AS back, lag(event_id, 2) OVER w AS back2
  FROM events WINDOW w AS (PARTITION BY user_id, CAST(floor(value) AS BIGINT) % 50 ORDER BY ts, event_id)),
d AS (
  SELECT CAST(event_id AS VARCHAR) AS decision_id, reviewer_id, target, ts, event_type IN ('error', 'signup') AS new, CASE WHEN event_type = 'signup' THEN 'reopen' ELSE 'reject' END AS action,
    CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'why' END AS rationale, CAST(CASE WHEN event_type NOT IN ('error', 'signup') THEN back WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN back2 WHEN event_id % 17 = 0 THEN -1 ELSE back END AS VARCHAR) AS prev
  FROM chained)
"""


@register(
    "decision_append_problems",
    _APPENDED
    + """
SELECT decision_id, 'reopen_without_previous' AS problem FROM d WHERE new AND action = 'reopen' AND prev IS NULL
UNION ALL SELECT decision_id, 'empty_rationale' FROM d WHERE new AND trim(rationale) = ''
UNION ALL SELECT decision_id, 'unknown_target' FROM d WHERE new AND CAST(target AS BIGINT) >= 46
UNION ALL SELECT decision_id, 'unknown_reviewer' FROM d WHERE new AND reviewer_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer)
UNION ALL SELECT decision_id, 'unknown_previous' FROM d WHERE new AND prev IS NOT NULL AND prev NOT IN (SELECT decision_id FROM d)
UNION ALL SELECT a.decision_id, 'different_reviewer_or_target' FROM d a JOIN d b ON a.prev = b.decision_id WHERE a.new AND (a.reviewer_id <> b.reviewer_id OR a.target <> b.target)
UNION ALL SELECT a.decision_id, 'predates_previous' FROM d a JOIN d b ON a.prev = b.decision_id WHERE a.new AND a.ts < b.ts
UNION ALL SELECT decision_id, 'previous_has_successor' FROM (SELECT *, count(*) OVER (PARTITION BY prev) AS c FROM d WHERE prev IS NOT NULL) WHERE new AND c > 1
UNION ALL SELECT decision_id, 'second_root' FROM (SELECT *, count(*) OVER (PARTITION BY reviewer_id, target) AS c FROM d WHERE prev IS NULL) WHERE new AND c > 1
""",
)
def decision_append_problems(t):
    target = F.expr("CAST(CAST(floor(value) AS BIGINT) % 50 AS STRING)")
    over = "OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) % 50 ORDER BY ts, event_id)"
    rows = t.events.select(
        F.col("event_id").cast("string").alias("decision_id"), F.lit(None).cast("string").alias("hypothesis_set_id"), F.lit(None).cast("string").alias("alternative_id"), target.alias("claim_id"), F.col("user_id").cast("string").alias("reviewer_id"),
        F.expr("CASE WHEN event_type = 'signup' THEN 'reopen' ELSE 'reject' END").alias("action"), F.col("ts").cast("timestamp").alias("decided_at"), F.expr("CASE WHEN event_id % 13 = 0 THEN ' ' ELSE 'why' END").alias("rationale"), F.lit("v").alias("provenance_id"), F.expr("CAST(event_id % 3 AS STRING)").alias("review_release_id"),
        F.expr(f"CAST(CASE WHEN event_type NOT IN ('error', 'signup') THEN lag(event_id) {over} WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN lag(event_id, 2) {over} WHEN event_id % 17 = 0 THEN -1 ELSE lag(event_id) {over} END AS STRING)").alias("previous_decision_id"),
        F.col("event_type").isin("error", "signup").alias("new"), F.lit("claim").alias("target_kind"), target.alias("target_id"),
    )
    none = t.spark.createDataFrame([], "hypothesis_set_id string, alternative_id string")
    claims = t.events.select(target.alias("claim_id")).distinct().where("CAST(claim_id AS BIGINT) < 46")
    base = SimpleNamespace(review_decisions=rows.where("NOT new").drop("target_kind", "target_id"), match_hypothesis_sets=none, match_hypothesis_alternatives=none, match_claims=claims, reviewers=t.customer.select(F.col("c_custkey").cast("string").alias("reviewer_id")), review_releases=t.events.selectExpr("CAST(event_id % 3 AS STRING) AS review_release_id").distinct())
    return decisions.problems(base, rows.where("new").drop("new"))


# A load: lines are call edges, of which orders hold some already; parts are the functions.
_LOADED = """
WITH staged AS (SELECT l_orderkey || '-' || l_linenumber AS edge_id, 'f' || l_suppkey AS caller, 'f' || l_partkey AS callee, CASE WHEN l_returnflag = 'R' THEN NULL ELSE 't' || l_suppkey END AS target FROM lineitem),
held AS (SELECT DISTINCT ON (edge_id) edge_id, caller, callee, target FROM (SELECT o_orderkey || '-1' AS edge_id, 'f' || o_custkey AS caller, 'f1' AS callee, NULL AS target FROM orders)),
own AS (SELECT edge_id, count(DISTINCT (caller, callee, coalesce(target, ''))) AS c, min((caller, callee, coalesce(target, ''))) AS v FROM staged GROUP BY 1),
functions AS (SELECT 'f' || p_partkey AS f FROM part WHERE p_size <> 3)
"""


@register(
    "load_problems",
    _LOADED
    + """
SELECT 'call_edges' AS table_name, 'conflicting_rows' AS problem, edge_id AS key FROM own WHERE c > 1
UNION ALL SELECT 'call_edges', 'identity_conflict', edge_id FROM own JOIN held h USING (edge_id) WHERE c = 1 AND v <> (h.caller, h.callee, coalesce(h.target, ''))
UNION ALL SELECT 'call_edges', 'dangling_caller_function_id', caller FROM (SELECT DISTINCT caller FROM staged) WHERE caller NOT IN (SELECT f FROM functions)
UNION ALL SELECT 'call_edges', 'dangling_callee_function_id', callee FROM (SELECT DISTINCT callee FROM staged) WHERE callee NOT IN (SELECT f FROM functions)
""",
)
def load_problems(t):
    edge = lambda df, key, caller, callee, target: df.select(F.expr(key).alias("edge_id"), F.lit(None).cast("string").alias("program_id"), F.expr(caller).alias("caller_function_id"), F.expr(callee).alias("callee_function_id"), F.expr(target).cast("string").alias("unresolved_target_id"), F.lit("call").alias("edge_kind"), F.lit(None).cast("string").alias("provenance_id"))
    staged = edge(t.lineitem, "l_orderkey || '-' || l_linenumber", "'f' || l_suppkey", "'f' || l_partkey", "CASE WHEN l_returnflag = 'R' THEN NULL ELSE 't' || l_suppkey END")
    held = edge(t.orders, "o_orderkey || '-1'", "'f' || o_custkey", "'f1'", "NULL")
    none = t.spark.createDataFrame([], "program_id string, provenance_id string")
    base = SimpleNamespace(call_edges=held, functions=t.part.where("p_size <> 3").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("function_id")), programs=none, provenance=none, unresolved_targets=t.supplier.select(F.concat(F.lit("t"), F.col("s_suppkey").cast("string")).alias("target_id")))
    return load.problems(base, {"call_edges": staged})
