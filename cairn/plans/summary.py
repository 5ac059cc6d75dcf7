"""What a catalog holds: some sixty counts, each table scanned once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import review
from cairn.operators.summary import chains, counts, distinct, shared, summed
from cairn.plans.registry import register
from cairn.sources.catalog import Catalog

# Metrics that are the number of a table's rows.
ROWS = {
    "function_names": "function_names",
    "function_assertions": "function_assertions",
    "source_links": "function_source_ranges",
    "function_signatures.arguments": "function_signature_arguments",
    "fold_groups": "fold_groups",
    "fold_members": "fold_group_members",
    "match_claims": "match_claims",
    "claim_evidence": "claim_evidence",
    "codeview_types.extractions": "codeview_type_extractions",
    "codeview_types.record_assertions": "codeview_type_record_assertions",
    "codeview_types.tag_member_occurrences": "codeview_tag_member_uses",
    "codeview_types.physical_field_members": "codeview_field_members",
    "codeview_types.physical_method_overloads": "codeview_method_overloads",
    "codeview_types.diagnostics": "codeview_layout_diagnostics",
    "data_symbols.extractions": "data_symbol_extractions",
    "data_symbols.records": "data_symbol_records",
    "vtable_alignments.table_candidates": "vtable_alignment_candidates",
    "vtable_alignments.slot_occurrences": "vtable_slot_alignments",
    "vtable_alignments.issues": "vtable_alignment_issues",
    "control_flow.extractions": "control_flow_extractions",
    "control_flow.physical_sites": "control_flow_sites",
    "control_flow.logical_uses": "control_flow_uses",
    "reviews.reviewers": "reviewers",
    "reviews.releases": "review_releases",
}

# Metrics that count conditions or sum a number over a table, and those that count by a column.
MEASURES = {
    "function_signatures": ({"function_signatures.total": "true", "function_signatures.resolved": "resolution_status = 'resolved'", "function_signatures.unresolved": "resolution_status = 'unresolved'", "function_signatures.variadic": "is_variadic = 1"}, {}),
    "call_edges": ({"call_edges.total": "true", "call_edges.resolved": "callee_function_id IS NOT NULL", "call_edges.unresolved": "unresolved_target_id IS NOT NULL"}, {}),
    "match_hypothesis_evidence": ({"match_hypotheses.evidence": "true"}, {"match_hypotheses.evidence_effects": "effect"}),
    "match_hypothesis_alternative_evidence": ({"match_hypotheses.alternative_evidence": "true"}, {"match_hypotheses.alternative_evidence_effects": "effect"}),
    "codeview_type_records": ({"codeview_types.raw_records": "true", "codeview_types.raw_body_bytes": "length(raw_body)"}, {}),
    "codeview_tag_layouts": ({"codeview_types.tags": "true", "codeview_types.definitions": "is_forward_reference = 0", "codeview_types.forward_references": "is_forward_reference = 1"}, {}),
    "control_flow_site_assertions": ({"control_flow.site_assertions": "true"}, {"control_flow.target_kinds": "target_kind"}),
    "control_flow_use_assertions": ({"control_flow.use_assertions": "true"}, {"control_flow.roles": "role"}),
    "control_flow_scans": ({"control_flow.procedure_scans": "true"}, {"control_flow.scan_statuses": "status"}),
    "unresolved_targets": ({"unresolved_targets": "status = 'open'"}, {}),
}

# Metrics of a platform.
PLATFORM = ("programs.functions", "programs.unique_addresses", "vtables.classes", "vtables.tables", "vtables.slots", "vtables.extent_suspect_tables")
ROLES = "vtables.roles"
#: What separates a platform from a role in a group.
ROLE = "/"


def summary(c: Catalog, alignment_producer: str) -> DataFrame:
    """metric, grp, n: all counts of a catalog; grp is null for a plain count, else a platform, kind, status, effect, action, or platform/role.

    ``alignment_producer`` is the producer whose alternatives count as those of
    table alignments.  Metrics of a platform have a row for each program's
    platform, zero included; plain counts have a row always, other groups only
    if they have rows.  Programs of one platform are added up.
    """
    parts = [counts(getattr(c, table), {metric: F.lit(True)}) for metric, table in ROWS.items()]
    parts += [counts(getattr(c, table), {m: F.expr(e) for m, e in measures.items()}, {m: F.col(e) for m, e in by.items()}) for table, (measures, by) in MEASURES.items()]
    parts.append(distinct(c.data_symbol_record_assertions, "address_group_id", {"data_symbols.record_assertions": F.lit(True), "data_symbols.resolved_records": F.col("address_group_id").isNotNull(), "data_symbols.unresolved_records": F.col("address_group_id").isNull()}, "data_symbols.unique_addresses"))
    parts.append(chains(c.review_decisions, review.derived_status(F.col("action")), "reviews.decisions", "reviews.historical_actions", "reviews.current_decisions", "reviews.current_statuses"))
    parts.append(_alternatives(c, alignment_producer))
    plain = [*ROWS, *[m for measures, _ in MEASURES.values() for m in measures], "data_symbols.record_assertions", "data_symbols.resolved_records", "data_symbols.unresolved_records", "data_symbols.unique_addresses", "reviews.decisions", "reviews.current_decisions", "match_hypotheses.sets", "match_hypotheses.alternatives", *ALIGNED, "shared_address_groups"]
    return summed([*parts, _programs(c)], plain, PLATFORM)


ALIGNED = ("vtable_alignments.fold_bundle_alternatives", "vtable_alignments.scalar_alternatives")


def _alternatives(c: Catalog, producer: str) -> DataFrame:
    """Sets, alternatives, and those of the producer's sets by what they hold: alternatives are counted by set before they meet it."""
    held = c.match_hypothesis_alternatives.groupBy("hypothesis_set_id").agg(F.count("*").alias("every"), F.count("xbox_fold_group_id").alias("fold"), F.count("claim_id").alias("scalar"))
    made = c.provenance.select("provenance_id", (F.col("producer") == producer).alias("made"))
    sets = c.match_hypothesis_sets.select("hypothesis_set_id", "provenance_id", F.lit(1).alias("one")).join(made, "provenance_id", "left")
    mine = lambda n: F.when(F.col("made"), F.col(n)).otherwise(0)
    return counts(sets.join(held, "hypothesis_set_id", "full"), {"match_hypotheses.sets": F.col("one"), "match_hypotheses.alternatives": F.col("every"), ALIGNED[0]: mine("fold"), ALIGNED[1]: mine("scalar")})


def _programs(c: Catalog) -> DataFrame:
    """The count of shared addresses, and counts by platform: program ids become platforms once all is counted."""
    none = F.lit(None).cast("string").alias("role")
    own = shared(c.functions, "program_id", "address_group_id", PLATFORM[0], PLATFORM[1], "shared_address_groups").select("*", none)
    for metric, table in ((PLATFORM[2], c.classes), (PLATFORM[4], c.vtable_slots)):
        own = own.unionByName(counts(table, {}, {metric: F.col("program_id")}).select("*", none))
    suspect = F.get_json_object("details_json", "$.extent.extent_suspect").isin("true", "1")
    tables = c.vtables.groupBy("program_id", "vfptr_role").agg(F.count("*").alias("n"), F.count_if(suspect).alias("bad"))
    role = F.concat(F.lit(ROLE), F.coalesce("vfptr_role", F.lit("null"))).alias("role")
    each = F.array(*[F.struct(F.lit(m).alias("metric"), r, F.col(n).alias("n")) for m, r, n in ((PLATFORM[3], none, "n"), (PLATFORM[5], none, "bad"), (ROLES, role, "n"))])
    own = own.unionByName(tables.select(F.col("program_id").alias("grp"), F.explode(each).alias("r")).select("r.metric", "grp", "r.n", "r.role"))
    own = own.groupBy("metric", "grp", "role").agg(F.sum("n").alias("n"))
    asked = c.programs.select(F.col("program_id").alias("grp"), "platform", F.explode(F.array(*[F.lit(m) for m in (*PLATFORM, ROLES)])).alias("metric"))
    rows = asked.join(own, ["metric", "grp"], "full").where("platform IS NOT NULL OR grp IS NULL")
    return rows.select("metric", F.concat("platform", F.coalesce("role", F.lit(""))).alias("grp"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register(
    "summary_counts",
    """
    SELECT 'orders' AS metric, CAST(NULL AS VARCHAR) AS grp, count(*) AS n FROM orders
    UNION ALL SELECT 'orders.finished', NULL, count(*) FROM orders WHERE o_orderstatus = 'F'
    UNION ALL SELECT 'orders.days', NULL, sum(length(o_orderpriority)) FROM orders
    UNION ALL SELECT 'orders.statuses', o_orderstatus, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'orders.priorities', o_orderpriority, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'lines.rows', l_returnflag, count(*) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'lines.parts', l_returnflag, count(DISTINCT l_partkey) FROM lineitem GROUP BY 2
    UNION ALL SELECT 'lines.shared', NULL, count(*) FROM (SELECT l_partkey FROM lineitem GROUP BY 1 HAVING count(*) > 1)
    UNION ALL SELECT 'events', NULL, count(*) FROM events
    UNION ALL SELECT 'events.low', NULL, count(*) FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) < 50
    UNION ALL SELECT 'events.users', NULL, count(DISTINCT user_id) FROM events
    UNION ALL SELECT 'segments.total', NULL, count(*) FROM customer
    UNION ALL SELECT 'segments.actions', c_mktsegment, count(*) FROM customer GROUP BY 2
    UNION ALL SELECT 'segments.current', NULL, count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey - c_nationkey - 1 FROM customer)
    UNION ALL SELECT 'segments.statuses', upper(c_mktsegment), count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey - c_nationkey - 1 FROM customer) GROUP BY 2
    """,
)
def summary_counts(t):
    low = F.get_json_object("props", "$.k").cast("long") < 50
    chain = t.customer.select(F.col("c_custkey").alias("decision_id"), (F.col("c_custkey") - F.col("c_nationkey") - 1).alias("previous_decision_id"), F.col("c_mktsegment").alias("action"))
    parts = [
        counts(t.orders, {"orders": F.lit(True), "orders.finished": F.col("o_orderstatus") == "F", "orders.days": F.length("o_orderpriority")}, {"orders.statuses": F.col("o_orderstatus"), "orders.priorities": F.col("o_orderpriority")}),
        shared(t.lineitem, "l_returnflag", "l_partkey", "lines.rows", "lines.parts", "lines.shared"),
        distinct(t.events, "user_id", {"events": F.lit(True), "events.low": low}, "events.users"),
        chains(chain, F.upper("action"), "segments.total", "segments.actions", "segments.current", "segments.statuses"),
    ]
    return summed(parts, ["orders", "orders.finished", "orders.days", "lines.shared", "events", "events.low", "events.users", "segments.total", "segments.current"])
