"""Review: decision chains, triage, snapshots, evaluation and independence of evidence."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import joined
from cairn.sources.staging import written

BUCKETS = ("contradicted", "incomplete", "ambiguous", "fold", "unresolved", "exact")
STATUS = {"accept": "accepted", "reject": "rejected", "defer": "deferred", "reopen": "open", "supersede": "superseded"}


def derived_status(action):
    out = F.lit(None).cast("string")
    for name, status in STATUS.items():
        out = F.when(action == name, F.lit(status)).otherwise(out)
    return out


def current_leaves(decisions: DataFrame) -> DataFrame:
    """Decisions without a successor, with their derived status."""
    follower = decisions.select(F.col("previous_decision_id").alias("decision_id")).where("decision_id IS NOT NULL")
    return decisions.join(follower, "decision_id", "left_anti").withColumn("derived_status", derived_status(F.col("action")))


def history(decisions: DataFrame) -> DataFrame:
    """Every decision with the root of its chain and its depth (the root's is 0).

    Pointer doubling: each round doubles the distance looked back, so a chain of
    a million decisions takes twenty joins.  Unlike a recursive query it has no
    level limit.  A decision whose predecessor is missing counts that as its
    root.  A cycle, on which looking back never ends, is an error.
    """
    ids = decisions.select("decision_id", F.col("previous_decision_id").alias("up"), F.when(F.col("previous_decision_id").isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = written(ids, "chain")
    for _ in range(state.count().bit_length() + 2):
        above = state.select(F.col("decision_id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("d2"))
        if state.where("up IS NOT NULL").join(above.where("up2 IS NOT NULL"), "up", "left_semi").isEmpty():
            break
        step = state.join(above, "up", "left").select("decision_id", F.when(F.col("up2").isNotNull(), F.col("up2")).otherwise(F.col("up")).alias("up"), F.when(F.col("up2").isNotNull(), F.col("depth") + F.col("d2")).otherwise(F.col("depth")).alias("depth"))
        state = written(step, "chain")
    else:
        raise ValueError("review decisions form a cycle")
    return state.select("decision_id", F.coalesce("up", "decision_id").alias("root_decision_id"), "depth")


def successor_violations(decisions: DataFrame) -> DataFrame:
    """Decisions whose predecessor doesn't exist, is of another reviewer or target, nulls being one of their own, or is later."""
    p = decisions.select(F.col("decision_id").alias("previous_decision_id"), F.lit(True).alias("p"), *[F.col(c).alias(f"p_{c}") for c in ("reviewer_id", "target_id", "decided_at")])
    j = decisions.where("previous_decision_id IS NOT NULL").join(p, "previous_decision_id", "left")
    return j.where("p IS NULL OR NOT reviewer_id <=> p_reviewer_id OR NOT target_id <=> p_target_id OR decided_at < p_decided_at").select("decision_id")


def root_violations(decisions: DataFrame) -> DataFrame:
    """Reviewers and targets with more than one root decision."""
    roots = decisions.where("previous_decision_id IS NULL").groupBy("reviewer_id", "target_id").agg(F.count("*").alias("roots"))
    return roots.where("roots > 1")


def all_evidence(sets: DataFrame, alternatives: DataFrame, claims: DataFrame) -> DataFrame:
    """Evidence of all three scopes by hypothesis set: (hypothesis_set_id, scope, effect, independence_group, evidence_id).

    ``sets`` has evidence of sets; ``alternatives`` and ``claims`` that of an
    alternative's and a claim's set, already resolved to the set.
    """
    name = ["hypothesis_set_id", "effect", "independence_group", "evidence_id"]
    parts = [df.select(*name).withColumn("scope", F.lit(scope)) for df, scope in ((sets, "set"), (alternatives, "alternative"), (claims, "claim"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def triage(sets: DataFrame, alternatives: DataFrame, evidence: DataFrame) -> DataFrame:
    """Triage rank and counts of each set.

    sets: hypothesis_set_id, has_unresolved (0 or 1).  alternatives:
    hypothesis_set_id, is_fold, is_empty_fold, is_unresolved (0 or 1).
    Alternatives and evidence are aggregated apart before they meet the sets,
    so neither multiplies the other.
    """
    a = alternatives.groupBy("hypothesis_set_id").agg(
        F.count("*").alias("alternative_count"), F.max("is_fold").alias("has_fold"), F.max("is_empty_fold").alias("has_empty_fold"), F.max("is_unresolved").alias("_unresolved")
    )
    e = evidence.groupBy("hypothesis_set_id").agg(
        F.count("*").alias("evidence_count"), F.count_if(F.col("effect").isin("supports", "contradicts")).alias("directional_count"), F.count_if(F.col("effect") == "contradicts").alias("contradicting_count")
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    names = ["alternative_count", "has_fold", "has_empty_fold", "evidence_count", "directional_count", "contradicting_count"]
    out = sets.join(a, "hypothesis_set_id", "left").join(e, "hypothesis_set_id", "left")
    out = out.select("hypothesis_set_id", *[zero(n).alias(n) for n in names], F.greatest("has_unresolved", zero("_unresolved")).alias("has_unresolved"))
    rank = (
        F.when(F.col("contradicting_count") > 0, 0)
        .when((F.col("alternative_count") == 0) | (F.col("directional_count") == 0) | (F.col("has_empty_fold") == 1), 1)
        .when(F.col("alternative_count") > 1, 2)
        .when(F.col("has_fold") == 1, 3)
        .when(F.col("has_unresolved") == 1, 4)
        .otherwise(5)
    )
    return out.withColumn("triage_rank", rank)


def histogram(index: DataFrame) -> DataFrame:
    """Sets in each bucket."""
    name = F.element_at(F.array(*[F.lit(b) for b in BUCKETS]), F.col("triage_rank") + 1)
    return index.groupBy("triage_rank").agg(F.count("*").alias("set_count")).select("triage_rank", name.alias("bucket"), "set_count")


def independence(evidence: DataFrame) -> DataFrame:
    """Evidence of each set by independence group: count, effects and ids."""
    g = evidence.groupBy("hypothesis_set_id", "independence_group")
    return g.agg(F.count("*").alias("evidence_count"), joined(F.collect_set("effect")).alias("effects"), F.min("evidence_id").alias("first_evidence_id"), F.max("evidence_id").alias("last_evidence_id"))


def selected_states(targets: DataFrame, leaves: DataFrame, reviewer_id, release_id) -> DataFrame:
    """State and basis of each target for one reviewer and release; a target without that reviewer's leaf is open."""
    own = leaves.where(F.col("reviewer_id") == F.lit(reviewer_id)).select("target_id", "action", "review_release_id")
    out = targets.join(own, "target_id", "left")
    action, here = F.col("action"), F.col("review_release_id").eqNullSafe(F.lit(release_id))
    state = F.when(here & (action == "accept"), "accepted").when(here & (action == "reject"), "rejected").when(here & (action == "defer"), "deferred").otherwise("open")
    basis = F.when(action.isNull(), "no_current_decision").when(~here, "current_leaf_from_another_release").otherwise(F.concat(F.lit("current_"), action, F.lit("_in_selected_release")))
    return out.select(*targets.columns, state.alias("state"), basis.alias("basis"))


def snapshot_counts(states: DataFrame) -> DataFrame:
    """Targets by kind and state, one column for each state, and the total."""
    p = states.groupBy("target_kind").pivot("state", ["accepted", "deferred", "open", "rejected"]).agg(F.count(F.lit(1)))
    p = p.na.fill(0)
    return p.withColumn("total", F.col("accepted") + F.col("deferred") + F.col("open") + F.col("rejected"))


def evaluation(states: DataFrame) -> DataFrame:
    """Counts of each producer by target kind and state; counts only, no rates."""
    g = states.groupBy("producer", "target_kind").agg(*[F.count_if(F.col("state") == s).alias(s) for s in ("accepted", "deferred", "open", "rejected")], F.count("*").alias("total"), joined(F.collect_set("producer_version")).alias("producer_versions"))
    return g


def disagreement(leaves: DataFrame) -> DataFrame:
    """Targets' leaves by all reviewers: how many, the distinct actions, and whether they differ."""
    g = leaves.groupBy("target_id").agg(F.count("*").alias("reviewer_count"), F.array_sort(F.collect_set("action")).alias("a"))
    return g.select("target_id", "reviewer_count", F.array_join("a", ",").alias("distinct_actions"), (F.size("a") > 1).alias("has_action_disagreement"))


def status_counts(leaves: DataFrame) -> DataFrame:
    """Current leaves by derived status."""
    return leaves.groupBy("derived_status").agg(F.count("*").alias("leaf_count"))


def chained(events: DataFrame, by: list[str], order: list[str], key: str) -> DataFrame:
    """Events as chains: each row with the id of the one before it in its group."""
    return events.withColumn("previous_decision_id", F.lag(key).over(Window.partitionBy(*by).orderBy(*order)))


def flags(index: DataFrame) -> DataFrame:
    """A triage index with the flags of its units: what they have, and three counts."""
    many, fold, open_ = F.col("alternative_count") > 1, F.col("has_fold") == 1, F.col("has_unresolved") == 1
    return index.select(
        "*",
        (F.col("contradicting_count") > 0).alias("has_contradicting_evidence"),
        (F.col("directional_count") > 0).alias("has_directional_evidence"),
        many.alias("has_multiple_alternatives"),
        fold.alias("has_fold_bundle"),
        (F.col("has_empty_fold") == 1).alias("has_empty_fold_bundle"),
        open_.alias("has_unresolved_endpoint"),
        ((F.col("alternative_count") == 1) & ~fold & ~open_).alias("has_exact_scalar_topology"),
    )


def several_leaves(leaves: DataFrame) -> DataFrame:
    """Targets for which a reviewer has more than one current leaf: a store that has one is broken."""
    return leaves.groupBy("reviewer_id", "target_id").agg(F.count("*").alias("leaf_count")).where("leaf_count > 1")


def encoded_cursor(value: dict) -> str:
    """A page's cursor: canonical JSON in URL-safe base 64 without padding."""
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decoded_cursor(text: str) -> dict:
    try:
        value = json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)).decode())
    except ValueError as e:
        raise ValueError("invalid cursor") from e
    if not isinstance(value, dict):
        raise ValueError("invalid cursor")
    return value
