"""Review operators on adapter views of orders, lineitem and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import paging, review
from cairn.plans.registry import Tables, register

# Decisions: events of one user (the reviewer) on one of fifty targets form a chain in time.
_DECISIONS = """
decisions AS (
  SELECT event_id AS decision_id, user_id AS reviewer_id, CAST(floor(value) AS BIGINT) % 50 AS target_id, ts AS decided_at,
         CASE event_type WHEN 'click' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'defer' WHEN 'signup' THEN 'reopen' ELSE 'supersede' END AS action,
         event_id % 3 AS review_release_id,
         lag(event_id) OVER (PARTITION BY user_id, CAST(floor(value) AS BIGINT) % 50 ORDER BY ts, event_id) AS previous_decision_id
  FROM events),
leaves AS (
  SELECT d.*, CASE d.action WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected' WHEN 'defer' THEN 'deferred' WHEN 'reopen' THEN 'open' ELSE 'superseded' END AS derived_status
  FROM decisions d WHERE NOT EXISTS (SELECT 1 FROM decisions s WHERE s.previous_decision_id = d.decision_id))
"""


def decisions(t: Tables) -> DataFrame:
    action = F.expr("CASE event_type WHEN 'click' THEN 'accept' WHEN 'error' THEN 'reject' WHEN 'view' THEN 'defer' WHEN 'signup' THEN 'reopen' ELSE 'supersede' END")
    rows = t.events.select(F.col("event_id").alias("decision_id"), F.col("user_id").alias("reviewer_id"), (F.floor("value") % 50).alias("target_id"), F.col("ts").alias("decided_at"), action.alias("action"), (F.col("event_id") % 3).alias("review_release_id"))
    return review.chained(rows, ["reviewer_id", "target_id"], ["decided_at", "decision_id"], "decision_id")


# Hypothesis sets: orders.  Alternatives: their lines up to the second, a fold if returned.  Evidence: the order's own, and its lines'.
_SETS = """
sets AS (SELECT o_orderkey AS hypothesis_set_id, CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 0 END AS has_unresolved FROM orders),
alternatives AS (
  SELECT l_orderkey AS hypothesis_set_id, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_fold,
         CASE WHEN l_returnflag = 'R' AND l_quantity < 3 THEN 1 ELSE 0 END AS is_empty_fold, CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END AS is_unresolved
  FROM lineitem WHERE l_linenumber <= 2),
evidence AS (
  SELECT o_orderkey AS hypothesis_set_id, CASE o_orderstatus WHEN 'P' THEN 'context' ELSE 'supports' END AS effect, 'order' AS independence_group, o_orderkey AS evidence_id FROM orders
  UNION ALL
  SELECT l_orderkey, CASE WHEN l_discount > 0.095 THEN 'contradicts' WHEN l_tax > 0.04 THEN 'supports' ELSE 'context' END, l_returnflag, l_partkey FROM lineitem WHERE l_linenumber <= 2
  UNION ALL
  SELECT l_orderkey, 'context', l_linestatus, l_suppkey FROM lineitem WHERE l_linenumber = 7),
a AS (SELECT hypothesis_set_id, count(*) AS alternative_count, max(is_fold) AS has_fold, max(is_empty_fold) AS has_empty_fold, max(is_unresolved) AS u FROM alternatives GROUP BY 1),
e AS (SELECT hypothesis_set_id, count(*) AS evidence_count, count(*) FILTER (WHERE effect IN ('supports', 'contradicts')) AS directional_count, count(*) FILTER (WHERE effect = 'contradicts') AS contradicting_count FROM evidence GROUP BY 1),
counted AS (
  SELECT s.hypothesis_set_id, coalesce(alternative_count, 0) AS alternative_count, coalesce(has_fold, 0) AS has_fold, coalesce(has_empty_fold, 0) AS has_empty_fold,
         coalesce(evidence_count, 0) AS evidence_count, coalesce(directional_count, 0) AS directional_count, coalesce(contradicting_count, 0) AS contradicting_count, greatest(has_unresolved, coalesce(u, 0)) AS has_unresolved
  FROM sets s LEFT JOIN a USING (hypothesis_set_id) LEFT JOIN e USING (hypothesis_set_id)),
triage AS (
  SELECT *, CASE WHEN contradicting_count > 0 THEN 0 WHEN alternative_count = 0 OR directional_count = 0 OR has_empty_fold = 1 THEN 1 WHEN alternative_count > 1 THEN 2 WHEN has_fold = 1 THEN 3 WHEN has_unresolved = 1 THEN 4 ELSE 5 END AS triage_rank
  FROM counted)
"""


def evidence(t: Tables) -> DataFrame:
    own = t.orders.select(F.col("o_orderkey").alias("hypothesis_set_id"), F.when(F.col("o_orderstatus") == "P", "context").otherwise("supports").alias("effect"), F.lit("order").alias("independence_group"), F.col("o_orderkey").alias("evidence_id"))
    effect = F.when(F.col("l_discount") > 0.095, "contradicts").when(F.col("l_tax") > 0.04, "supports").otherwise("context")
    lines = t.lineitem.where("l_linenumber <= 2").select(F.col("l_orderkey").alias("hypothesis_set_id"), effect.alias("effect"), F.col("l_returnflag").alias("independence_group"), F.col("l_partkey").alias("evidence_id"))
    last = t.lineitem.where("l_linenumber = 7").select(F.col("l_orderkey").alias("hypothesis_set_id"), F.lit("context").alias("effect"), F.col("l_linestatus").alias("independence_group"), F.col("l_suppkey").alias("evidence_id"))
    return review.all_evidence(own, lines, last)


def index(t: Tables) -> DataFrame:
    flag = lambda c: F.expr(f"CASE WHEN {c} THEN 1 ELSE 0 END")
    sets = t.orders.select(F.col("o_orderkey").alias("hypothesis_set_id"), flag("o_orderpriority = '5-LOW'").alias("has_unresolved"))
    alternatives = t.lineitem.where("l_linenumber <= 2").select(
        F.col("l_orderkey").alias("hypothesis_set_id"), flag("l_returnflag = 'R'").alias("is_fold"), flag("l_returnflag = 'R' AND l_quantity < 3").alias("is_empty_fold"), flag("l_quantity > 45").alias("is_unresolved")
    )
    return review.triage(sets, alternatives, evidence(t))


@register("current_leaf", f"WITH {_DECISIONS} SELECT decision_id, reviewer_id, target_id, action, derived_status FROM leaves")
def current_leaf(t):
    return review.current_leaves(decisions(t)).select("decision_id", "reviewer_id", "target_id", "action", "derived_status")


@register(
    "decision_history",
    f"""WITH RECURSIVE {_DECISIONS}, chain AS (
  SELECT decision_id, decision_id AS root_decision_id, CAST(0 AS BIGINT) AS depth FROM decisions WHERE previous_decision_id IS NULL
  UNION ALL SELECT d.decision_id, c.root_decision_id, c.depth + 1 FROM decisions d JOIN chain c ON d.previous_decision_id = c.decision_id)
SELECT * FROM chain""",
)
def decision_history(t):
    return review.history(decisions(t))


@register("successor_violations", f"WITH {_DECISIONS} SELECT d.decision_id FROM decisions d JOIN decisions p ON d.previous_decision_id = p.decision_id WHERE d.reviewer_id <> p.reviewer_id OR d.target_id <> p.target_id OR d.decided_at < p.decided_at")
def successor_violations(t):
    return review.successor_violations(decisions(t))


@register("root_violations", "SELECT user_id AS reviewer_id, CAST(floor(value) AS BIGINT) % 50 AS target_id, count(*) AS roots FROM events GROUP BY ALL HAVING count(*) > 1")
def root_violations(t):
    rows = t.events.select(F.col("user_id").alias("reviewer_id"), (F.floor("value") % 50).alias("target_id"), F.lit(None).cast("long").alias("previous_decision_id"))
    return review.root_violations(rows)


@register("review_status_counts", f"WITH {_DECISIONS} SELECT derived_status, count(*) AS leaf_count FROM leaves GROUP BY 1")
def review_status_counts(t):
    return review.status_counts(review.current_leaves(decisions(t)))


@register("review_disagreement", f"WITH {_DECISIONS} SELECT target_id, count(*) AS reviewer_count, string_agg(DISTINCT action, ',' ORDER BY action) AS distinct_actions, count(DISTINCT action) > 1 AS has_action_disagreement FROM leaves GROUP BY 1")
def review_disagreement(t):
    return review.disagreement(review.current_leaves(decisions(t)))


@register("triage_index", f"WITH {_SETS} SELECT hypothesis_set_id, triage_rank, alternative_count, has_fold, has_empty_fold, has_unresolved, evidence_count, directional_count, contradicting_count FROM triage")
def triage_index(t):
    return index(t).select("hypothesis_set_id", "triage_rank", "alternative_count", "has_fold", "has_empty_fold", "has_unresolved", "evidence_count", "directional_count", "contradicting_count")


@register("triage_histogram", f"WITH {_SETS} SELECT triage_rank, (['contradicted', 'incomplete', 'ambiguous', 'fold', 'unresolved', 'exact'])[triage_rank + 1] AS bucket, count(*) AS set_count FROM triage GROUP BY 1, 2")
def triage_histogram(t):
    return review.histogram(index(t))


@register("queue_page_after", f"WITH {_SETS} SELECT triage_rank, hypothesis_set_id, alternative_count, evidence_count FROM triage WHERE (triage_rank, hypothesis_set_id) > (2, 500) ORDER BY 1, 2 LIMIT 100")
def queue_page_after(t):
    return paging.after(index(t), [("triage_rank", 2), ("hypothesis_set_id", 500)], 100).select("triage_rank", "hypothesis_set_id", "alternative_count", "evidence_count")


@register("evidence_by_scope", f"WITH {_SETS} SELECT CASE WHEN independence_group = 'order' THEN 'set' WHEN independence_group IN ('O', 'F') THEN 'claim' ELSE 'alternative' END AS scope, effect, count(*) AS evidence_count FROM evidence GROUP BY 1, 2")
def evidence_by_scope(t):
    return evidence(t).groupBy("scope", "effect").agg(F.count("*").alias("evidence_count"))


@register("independence_summary", f"WITH {_SETS} SELECT hypothesis_set_id, independence_group, count(*) AS evidence_count, string_agg(DISTINCT effect, ',' ORDER BY effect) AS effects, min(evidence_id) AS first_evidence_id, max(evidence_id) AS last_evidence_id FROM evidence GROUP BY 1, 2")
def independence_summary(t):
    return review.independence(evidence(t))


# Targets of three kinds: claims, sets and alternatives of a supplier (the producer); state by reviewer 7 and release 1.
_STATES = f"""{_DECISIONS},
targets AS (
  SELECT p_partkey % 50 AS target_id, (['claim', 'hypothesis_set', 'alternative'])[CAST(p_size % 3 AS INTEGER) + 1] AS target_kind, p_brand AS producer, p_type AS producer_version, p_partkey FROM part),
states AS (
  SELECT t.*, CASE WHEN l.review_release_id = 1 AND l.action = 'accept' THEN 'accepted' WHEN l.review_release_id = 1 AND l.action = 'reject' THEN 'rejected' WHEN l.review_release_id = 1 AND l.action = 'defer' THEN 'deferred' ELSE 'open' END AS state,
         CASE WHEN l.action IS NULL THEN 'no_current_decision' WHEN l.review_release_id <> 1 THEN 'current_leaf_from_another_release' ELSE 'current_' || l.action || '_in_selected_release' END AS basis
  FROM targets t LEFT JOIN (SELECT * FROM leaves WHERE reviewer_id = 7) l USING (target_id))
"""


def states(t: Tables) -> DataFrame:
    kind = F.element_at(F.array(F.lit("claim"), F.lit("hypothesis_set"), F.lit("alternative")), (F.col("p_size") % 3 + 1).cast("int"))
    targets = t.part.select((F.col("p_partkey") % 50).alias("target_id"), kind.alias("target_kind"), F.col("p_brand").alias("producer"), F.col("p_type").alias("producer_version"), "p_partkey")
    return review.selected_states(targets, review.current_leaves(decisions(t)), 7, 1)


@register("selected_state", f"WITH {_STATES} SELECT p_partkey, target_kind, state, basis FROM states")
def selected_state(t):
    return states(t).select("p_partkey", "target_kind", "state", "basis")


@register(
    "snapshot_counts",
    f"WITH {_STATES} SELECT target_kind, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'deferred') AS deferred, count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) AS total FROM states GROUP BY 1",
)
def snapshot_counts(t):
    return review.snapshot_counts(states(t))


@register(
    "producer_evaluation",
    f"WITH {_STATES} SELECT producer, target_kind, count(*) FILTER (WHERE state = 'accepted') AS accepted, count(*) FILTER (WHERE state = 'deferred') AS deferred, count(*) FILTER (WHERE state = 'open') AS open, count(*) FILTER (WHERE state = 'rejected') AS rejected, count(*) AS total, string_agg(DISTINCT producer_version, ',' ORDER BY producer_version) AS producer_versions FROM states GROUP BY 1, 2",
)
def producer_evaluation(t):
    return review.evaluation(states(t))
