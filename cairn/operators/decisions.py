"""Recording review decisions: append-only chains, checked against the version that the reviewer has read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import json_text, stable_id, utc_text
from cairn.operators.load import Refused
from cairn.operators.review import STATUS, current_leaves
from cairn.sources.staging import written
from cairn.sources.store import CommitConflict, Version, commit

#: Kinds of targets, with the column and the table of each.
TARGETS = {"hypothesis_set": ("hypothesis_set_id", "match_hypothesis_sets"), "alternative": ("alternative_id", "match_hypothesis_alternatives"), "claim": ("claim_id", "match_claims")}
#: A decision's columns; the id is made of them.
GIVEN = ("hypothesis_set_id", "alternative_id", "claim_id", "reviewer_id", "action", "decided_at", "rationale", "provenance_id", "review_release_id", "previous_decision_id")
_ZONE = r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d{1,6})?)?(Z|[+-]\d\d:?\d\d)$"


def _kind() -> Column:
    out = F.lit(None).cast("string")
    for kind, (column, _) in TARGETS.items():
        out = F.when(F.col(column).isNotNull(), kind).otherwise(out)
    return out


def prepared(rows: DataFrame, details: str = "{}") -> DataFrame:
    """Decisions with decision_id, target_kind, target_id, and decided_at as a timestamp; null where the text names no zone.

    rows: GIVEN, missing columns being null, decided_at as text with a zone, or
    a timestamp.  ``details`` is canonical JSON that all of them share.
    """
    rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast("timestamp" if c == "decided_at" and dict(rows.dtypes).get(c) == "timestamp" else "string").alias(c) for c in GIVEN])
    if dict(rows.dtypes)["decided_at"] == "string":
        rows = rows.withColumn("decided_at", F.when(F.col("decided_at").rlike(_ZONE), F.try_to_timestamp("decided_at")))
    rows = rows.withColumn("target_kind", _kind()).withColumn("target_id", F.coalesce(*[c for c, _ in TARGETS.values()]))
    text = lambda c: json_text(F.col(c), "string")
    fragments = [text("target_kind"), text("target_id"), text("reviewer_id"), text("action"), json_text(utc_text(F.col("decided_at")), "string"), text("rationale"), text("provenance_id"), text("review_release_id"), text("previous_decision_id"), F.lit(details)]
    return rows.withColumn("decision_id", stable_id("review-decision", *fragments))


def problems(base: Version, new: DataFrame) -> DataFrame:
    """decision_id, problem: what speaks against appending ``new`` (prepared, and none of it in ``base``).

    New rows may follow each other.  A predecessor's second successor and a
    reviewer's second root for a target are problems of the new rows alone.
    """
    old = base.review_decisions.withColumn("target_kind", _kind()).withColumn("target_id", F.coalesce(*[c for c, _ in TARGETS.values()]))
    names = ["decision_id", "reviewer_id", "target_kind", "target_id", "decided_at", "previous_decision_id"]
    every = old.select(*names, F.lit(False).alias("new")).unionByName(new.select(*names, F.lit(True).alias("new")))
    said = lambda df, problem: df.select("decision_id", F.lit(problem).alias("problem"))
    targets = sum((F.col(c).isNotNull().cast("int") for c, _ in TARGETS.values()), F.lit(0))
    plain = {
        "not_exactly_one_target": targets != 1,
        "unsupported_action": ~F.coalesce(F.col("action").isin(*STATUS), F.lit(False)),
        "reopen_without_previous": (F.col("action") == "reopen") & F.col("previous_decision_id").isNull(),
        "empty_rationale": F.coalesce(F.length(F.trim("rationale")) == 0, F.lit(True)),
        "timestamp_without_zone": F.col("decided_at").isNull(),
        "no_provenance": F.col("provenance_id").isNull(),
    }
    first = new.select("decision_id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in plain.items()]))).alias("problem"))
    out = [first]
    for kind, (column, table) in TARGETS.items():
        out.append(said(new.where(F.col("target_kind") == kind).join(getattr(base, table).select(column), column, "left_anti"), "unknown_target"))
    for column, table in (("reviewer_id", "reviewers"), ("review_release_id", "review_releases")):
        out.append(said(new.join(getattr(base, table).select(column), column, "left_anti"), f"unknown_{table[:-1]}"))
    before = every.select(F.col("decision_id").alias("previous_decision_id"), *[F.col(c).alias(f"_{c}") for c in names[1:5]])
    j = new.where("previous_decision_id IS NOT NULL").join(before, "previous_decision_id", "left")
    missing = F.col("_reviewer_id").isNull()
    other = ~missing & ~(F.col("reviewer_id").eqNullSafe(F.col("_reviewer_id")) & F.col("target_kind").eqNullSafe(F.col("_target_kind")) & F.col("target_id").eqNullSafe(F.col("_target_id")))
    early = ~missing & (F.col("decided_at") < F.col("_decided_at"))
    out += [said(j.where(c), n) for n, c in (("unknown_previous", missing), ("different_reviewer_or_target", other), ("predates_previous", early))]
    followers = every.where("previous_decision_id IS NOT NULL").withColumn("c", F.count("*").over(Window.partitionBy("previous_decision_id")))
    out.append(said(followers.where("new AND c > 1"), "previous_has_successor"))
    roots = every.where("previous_decision_id IS NULL").withColumn("c", F.count("*").over(Window.partitionBy("reviewer_id", "target_kind", "target_id")))
    out.append(said(roots.where("new AND c > 1"), "second_root"))
    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    return found


def record(base: Version, rows: DataFrame, details: str = "{}", retries: int = 0) -> Version:
    """Append decisions to the version that the reviewer has read, all or none.

    Exact replays add nothing, and a batch of them gives ``base`` itself.
    Refused names what is wrong, by decision.  If another writer has
    committed meanwhile, CommitConflict says so; with ``retries`` the newer
    version is read and everything is checked against it, so of two writers
    that continue one leaf the second is refused.
    """
    every = written(prepared(rows, details).dropDuplicates(["decision_id"]), "decisions")
    while True:
        new = written(every.join(base.review_decisions.select("decision_id"), "decision_id", "left_anti"), "new")
        if new.isEmpty():
            return base
        bad = problems(base, new).distinct().limit(20).collect()
        if bad:
            raise Refused("; ".join(sorted(f"{r['problem']} {r['decision_id']}" for r in bad)))
        try:
            return commit(base, {"review_decisions": new.select("decision_id", *GIVEN)})
        except CommitConflict:
            if not retries:
                raise
            retries, base = retries - 1, Version(base.spark, base.target)


def state_of(version: Version, kind: str, target_id: str) -> DataFrame:
    """The current decision of every reviewer on one target, with its derived status; no consensus is made of them."""
    column = TARGETS[kind][0]
    return current_leaves(version.review_decisions.where(F.col(column) == target_id))
