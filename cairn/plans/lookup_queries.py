"""Lookup operators on adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import expr
from cairn.operators import lookup, paging
from cairn.plans.registry import Tables, register


@register("fold_member_page", "SELECT p_size AS fold_group_id, p_partkey AS function_id, position, total FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS position, count(*) OVER (PARTITION BY p_size) AS total FROM part) WHERE position > 2 AND position <= 7")
def fold_member_page(t):
    rows = t.part.select(F.col("p_size").alias("fold_group_id"), F.col("p_partkey").alias("function_id"))
    return paging.page_per_parent(rows, ["fold_group_id"], ["function_id"], 5, 2).select("fold_group_id", "function_id", "position", "total")


@register("name_exact", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_name = 'red widget'")
def name_exact(t):
    return lookup.named(t.part, ["p_name"], "red widget").select("p_partkey", "p_name", "p_brand")


@register("name_contains", "SELECT p_partkey, p_name FROM part WHERE instr(lower(p_name), 'ed w') > 0")
def name_contains(t):
    return lookup.named(t.part, ["p_name"], "eD W", "contains").select("p_partkey", "p_name")


@register(
    "pc_address_union",
    "WITH ids AS (SELECT l_orderkey AS id FROM lineitem WHERE l_partkey = 77 UNION SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7) SELECT id, total, total > 30 AS has_more FROM (SELECT id, count(*) OVER () AS total FROM ids) ORDER BY id LIMIT 20 OFFSET 10",
)
def pc_address_union(t):
    ids = lookup.arms([t.lineitem.where("l_partkey = 77").select(F.col("l_orderkey").alias("id")), t.lineitem.where("l_suppkey = 7").select(F.col("l_orderkey").alias("id"))])
    return paging.page(ids, ["id"], 20, 10)


@register(
    "reverse_hypotheses",
    "SELECT DISTINCT o.o_orderkey AS hypothesis_set_id FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey LEFT JOIN part p ON p.p_partkey = l.l_partkey WHERE o.o_custkey = 5 OR l.l_suppkey = 3 OR l.l_partkey = 11 OR p.p_size = 13",
)
def reverse_hypotheses(t):
    line = lambda df: df.select(F.col("l_orderkey").alias("hypothesis_set_id"))
    known = t.orders.select(F.col("o_orderkey").alias("hypothesis_set_id"))
    found = lookup.arms(
        [
            t.orders.where("o_custkey = 5").select(F.col("o_orderkey").alias("hypothesis_set_id")),
            line(t.lineitem.where("l_suppkey = 3")),
            line(t.lineitem.where("l_partkey = 11")),
            line(t.lineitem.join(t.part.where("p_size = 13").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")),
        ]
    )
    return found.join(known, "hypothesis_set_id", "left_semi")


@register(
    "class_slots_page",
    """WITH tables AS (SELECT n_name AS class_name, s_suppkey AS vtable_id, CASE WHEN s_acctbal > 5000 THEN 0 WHEN s_acctbal > 0 THEN 1 ELSE 2 END AS role_order FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = 1),
slots AS (SELECT DISTINCT l_suppkey AS vtable_id, l_partkey AS slot_index FROM lineitem)
SELECT class_name, role_order, vtable_id, slot_index, position, total FROM (SELECT *, row_number() OVER (PARTITION BY vtable_id ORDER BY slot_index) AS position, count(*) OVER (PARTITION BY vtable_id) AS total FROM tables JOIN slots USING (vtable_id)) WHERE position <= 3""",
)
def class_slots_page(t):
    role = F.when(F.col("s_acctbal") > 5000, 0).when(F.col("s_acctbal") > 0, 1).otherwise(2)
    tables = t.nation.where("n_regionkey = 1").join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("class_name"), F.col("s_suppkey").alias("vtable_id"), role.alias("role_order"))
    slots = t.lineitem.select(F.col("l_suppkey").alias("vtable_id"), F.col("l_partkey").alias("slot_index")).distinct()
    paged = paging.page_per_parent(slots.join(tables.select("vtable_id"), "vtable_id", "left_semi"), ["vtable_id"], ["slot_index"], 3)
    return tables.join(paged, "vtable_id").select("class_name", "role_order", "vtable_id", "slot_index", "position", "total")


def _flows(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_id").alias("use_id"), F.col("user_id").alias("procedure_id"), (F.floor("value") % 50).alias("site_id"), F.col("event_type").alias("role"), F.when(F.col("event_id") % 3 == 0, "indirect").otherwise("unique_procedure").alias("target_kind"))


@register("flow_intersection", "SELECT event_id AS use_id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 300) AND floor(value) % 50 IN (SELECT floor(value) % 50 FROM events WHERE event_type = 'error' AND user_id = 8)")
def flow_intersection(t):
    f = _flows(t)
    procedures = t.events.where("event_type = 'purchase' AND value > 300").select(F.col("user_id").alias("procedure_id"))
    return lookup.intersection(f, procedures, f.where("role = 'error' AND procedure_id = 8").select("site_id")).select("use_id")


@register("flow_role_counts", "SELECT event_type AS role, CASE WHEN event_id % 3 = 0 THEN 'indirect' ELSE 'unique_procedure' END AS target_kind, count(*) AS use_count, count(DISTINCT floor(value) % 50) AS site_count FROM events GROUP BY 1, 2")
def flow_role_counts(t):
    return lookup.role_counts(_flows(t))


@register("flow_scan_coverage", "SELECT user_id AS procedure_id, count(*) AS use_count, count(*) FILTER (WHERE event_type = 'error') AS failed, bool_and(event_type <> 'error') AS is_complete FROM events GROUP BY 1")
def flow_scan_coverage(t):
    return t.events.groupBy(F.col("user_id").alias("procedure_id")).agg(F.count("*").alias("use_count"), F.count_if(F.col("event_type") == "error").alias("failed"), F.bool_and(F.col("event_type") != "error").alias("is_complete"))


@register("type_three_field_search", "SELECT p_partkey FROM part WHERE instr(lower(p_name), 'bolt') > 0 OR instr(lower(p_brand), 'bolt') > 0 OR instr(lower(p_type), 'mo') > 0")
def type_three_field_search(t):
    bolt = lookup.named(t.part, ["p_name", "p_brand"], "bolt", "contains").select("p_partkey")
    return lookup.arms([bolt, lookup.named(t.part, ["p_type"], "mo", "contains").select("p_partkey")])


@register("data_symbol_lookup", "SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 42 OR s_name = 'Supplier#000000017'")
def data_symbol_lookup(t):
    s = t.supplier.where((F.col("s_suppkey") == 42) | (F.col("s_name") == "Supplier#000000017"))
    return s.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).select("s_suppkey", "s_name", "n_name")


@register(
    "sdk_union_search",
    """SELECT 'prototype' AS observation_kind, p_partkey AS observation_id, p_name AS name FROM part WHERE instr(lower(p_name), 'red') > 0 OR instr(lower(p_type), 'red') > 0
UNION ALL SELECT 'call_target', s_suppkey, s_name FROM supplier WHERE instr(lower(s_name), '00007') > 0 UNION ALL SELECT 'data', c_custkey, c_name FROM customer WHERE instr(lower(c_mktsegment), 'build') > 0 AND c_nationkey = 3""",
)
def sdk_union_search(t):
    p = lookup.named(t.part, ["p_name", "p_type"], "red", "contains").select(F.col("p_partkey").alias("observation_id"), F.col("p_name").alias("name"))
    s = lookup.named(t.supplier, ["s_name"], "00007", "contains").select(F.col("s_suppkey").alias("observation_id"), F.col("s_name").alias("name"))
    c = lookup.named(t.customer.where("c_nationkey = 3"), ["c_mktsegment"], "build", "contains").select(F.col("c_custkey").alias("observation_id"), F.col("c_name").alias("name"))
    return lookup.all_arms([("prototype", p), ("call_target", s), ("data", c)])


@register(
    "candidates_ambiguous",
    "SELECT o_orderkey AS hypothesis_set_id, n AS alternative_count, f AS has_fold FROM orders JOIN (SELECT l_orderkey, count(*) AS n, max(CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END) AS f FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1) ON l_orderkey = o_orderkey WHERE n > 1 OR f = 1",
)
def candidates_ambiguous(t):
    alternatives = t.lineitem.where("l_linenumber <= 3").select(F.col("l_orderkey").alias("hypothesis_set_id"), F.expr("CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END").alias("is_fold"))
    return lookup.ambiguous_sets(t.orders.select(F.col("o_orderkey").alias("hypothesis_set_id")), alternatives)


@register("candidates_unresolved", "SELECT o_orderkey AS target_id, o_orderpriority AS name_hint FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 400000")
def candidates_unresolved(t):
    return t.orders.where("o_orderstatus = 'O' AND o_totalprice > 400000").select(F.col("o_orderkey").alias("target_id"), F.col("o_orderpriority").alias("name_hint"))


@register(
    "names_in_order",
    "SELECT l_orderkey AS function_id, string_agg(name, '|' ORDER BY p, name_kind, name) AS names, count(*) AS name_count FROM (SELECT l_orderkey, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS p, l_returnflag AS name_kind, 'n' || l_partkey AS name FROM lineitem) GROUP BY 1",
)
def names_in_order(t):
    return lookup.names_in_order(t.lineitem.select(F.col("l_orderkey").alias("function_id"), F.expr("CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END").alias("is_primary"), F.col("l_returnflag").alias("name_kind"), F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("name")))


@register(
    "signature_arguments",
    "SELECT o_orderkey AS function_id, coalesce(string_agg(l_returnflag || l_suppkey, ', ' ORDER BY l_linenumber, l_returnflag || l_suppkey), '') AS rendered, count(l_orderkey) AS argument_count FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
)
def signature_arguments(t):
    arguments = t.lineitem.select(F.col("l_orderkey").alias("function_id"), F.col("l_linenumber").alias("position"), F.concat("l_returnflag", F.col("l_suppkey").cast("string")).alias("rendered_type"))
    return lookup.signatures(t.orders.select(F.col("o_orderkey").alias("function_id")), arguments)


@register(
    "ambiguity_reasons",
    "SELECT l_partkey, concat_ws(',', CASE WHEN max(l_quantity) = 50 THEN 'fold_group' END, CASE WHEN count(*) > 30 THEN 'multiple_functions_at_address' END, CASE WHEN min(l_discount) = 0 THEN 'unresolved_target' END) AS ambiguity FROM lineitem GROUP BY 1",
)
def ambiguity_reasons(t):
    g = t.lineitem.groupBy("l_partkey").agg((F.floor(F.count("*") / 31) + 1).alias("member_count"), (F.max("l_quantity") == 50).alias("has_fold"), (F.min("l_discount") == 0).alias("unresolved"))
    return lookup.ambiguity(g).select("l_partkey", "ambiguity")


@register(
    "claim_endpoints",
    "SELECT o_orderkey AS claim_id, CASE WHEN p_name IS NOT NULL THEN 'function' WHEN s_name IS NOT NULL THEN 'unresolved_target' ELSE 'missing' END AS endpoint_kind, coalesce(p_name, s_name) AS endpoint_name FROM orders LEFT JOIN part ON p_partkey = CASE WHEN o_orderstatus = 'F' THEN o_custkey END LEFT JOIN supplier ON s_suppkey = CASE WHEN o_orderstatus = 'O' THEN o_custkey END",
)
def claim_endpoints(t):
    claims = t.orders.selectExpr("o_orderkey AS claim_id", "CASE WHEN o_orderstatus = 'F' THEN o_custkey END AS pc_function_id", "CASE WHEN o_orderstatus = 'O' THEN o_custkey END AS pc_target_id")
    functions = t.part.select(F.col("p_partkey").alias("function_id"), F.col("p_name").alias("name"))
    targets = t.supplier.select(F.col("s_suppkey").alias("target_id"), F.col("s_name").alias("name_hint"))
    return lookup.endpoints(claims, functions, targets).select("claim_id", "endpoint_kind", "endpoint_name")


@register(
    "address_parse",
    "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_totalprice AS BIGINT) WHEN 1 THEN o_custkey ELSE NULL END AS address FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice) AS o_totalprice FROM orders)",
)
def address_parse(t):
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit(" 0x"), F.hex(F.floor("o_totalprice")))).when(F.col("o_orderkey") % 3 == 1, F.col("o_custkey").cast("string")).otherwise("-12x")
    return t.orders.select("o_orderkey", expr.parse_address(text).alias("address"))


@register("summary_counts", "\nUNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS row_count FROM {n}" for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")))
def summary_counts(t):
    parts = [getattr(t, n).agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("shared_addresses", "SELECT CAST(floor(o_totalprice) AS BIGINT) AS address, count(*) AS function_count FROM orders GROUP BY 1 HAVING count(*) > 1")
def shared_addresses(t):
    return t.orders.groupBy(F.floor("o_totalprice").alias("address")).agg(F.count("*").alias("function_count")).where("function_count > 1")


@register("timestamps_utc", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS at FROM events")
def timestamps_utc(t):
    return t.events.select("event_id", expr.utc_text(F.col("ts")).alias("at"))
