"""Extraction coverage, reports, lineage and integrity rules on adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.expr import relative_path
from cairn.operators import checks, decode, lookup, persist, ranges, review
from cairn.plans.registry import register
from cairn.plans.review_queries import _DECISIONS, decisions


@register(
    "callee_classes",
    """WITH callees AS (SELECT l_orderkey, l_linenumber, l_partkey * 40 + CAST(l_quantity AS BIGINT) % 4 AS address FROM lineitem),
entries AS (SELECT DISTINCT p_partkey * 40 AS address FROM part WHERE p_size > 25), spans AS (SELECT s_suppkey * 700 AS lo, s_suppkey * 700 + 400 AS hi FROM supplier)
SELECT CASE WHEN e.address IS NOT NULL THEN 'entry' WHEN s.lo IS NOT NULL THEN 'executable_non_entry' ELSE 'outside_executable' END AS callee_class, count(*) AS edge_count
FROM callees c LEFT JOIN entries e ON e.address = c.address LEFT JOIN spans s ON s.lo <= c.address AND c.address < s.hi GROUP BY 1""",
)
def callee_classes(t):
    callees = t.lineitem.select((F.col("l_partkey") * 40 + F.col("l_quantity").cast("long") % 4).alias("address"))
    entries = t.part.where("p_size > 25").select((F.col("p_partkey") * 40).alias("address"), F.lit(True).alias("is_entry")).distinct()
    spans = t.supplier.select((F.col("s_suppkey") * 700).alias("lo"), (F.col("s_suppkey") * 700 + 400).alias("hi"))
    j = ranges.containing(callees, "address", spans, "lo", "hi", 700, "left").join(entries, "address", "left")
    kind = F.when(F.col("is_entry"), "entry").when(F.col("lo").isNotNull(), "executable_non_entry").otherwise("outside_executable")
    return j.groupBy(kind.alias("callee_class")).agg(F.count("*").alias("edge_count"))


@register(
    "candidate_report",
    f"""WITH {_DECISIONS}, units AS (
  SELECT p_partkey % 50 AS target_id, p_partkey AS unit_id, 'claim' AS target_kind FROM part UNION ALL SELECT o_orderkey % 70, o_orderkey, 'hypothesis_set' FROM orders UNION ALL SELECT s_suppkey % 60, s_suppkey, 'alternative' FROM supplier)
SELECT u.target_kind, u.unit_id, l.derived_status FROM units u LEFT JOIN (SELECT * FROM leaves WHERE reviewer_id = 11) l USING (target_id)""",
)
def candidate_report(t):
    unit = lambda df, key, n: df.select((F.col(key) % n).alias("target_id"), F.col(key).alias("unit_id"))
    units = [("claim", unit(t.part, "p_partkey", 50)), ("hypothesis_set", unit(t.orders, "o_orderkey", 70)), ("alternative", unit(t.supplier, "s_suppkey", 60))]
    return lookup.candidate_report(units, review.current_leaves(decisions(t)), 11).select("target_kind", "unit_id", "derived_status")


@register(
    "lineage_components",
    """WITH per AS (SELECT l_orderkey, l_returnflag, bool_or(coalesce(l_suppkey % 4 = 1, false)) AS ok FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS target_id, count(*) AS component_count, bool_and(ok) AS compatible, coalesce(string_agg(l_returnflag, ',' ORDER BY l_returnflag) FILTER (WHERE NOT ok), '') AS incompatible FROM per GROUP BY 1""",
)
def lineage_components(t):
    return persist.lineage(t.lineitem.select(F.col("l_orderkey").alias("target_id"), F.col("l_returnflag").alias("component_kind"), (F.col("l_suppkey") % 4).alias("manifest_id")), 1)


@register(
    "row_digests",
    "SELECT l_suppkey, count(*) AS row_count, sha256(string_agg(length(a) || ':' || a || length(b) || ':' || b, '' ORDER BY l_orderkey, l_linenumber, l_partkey, a, b)) AS digest FROM (SELECT *, CAST(l_partkey AS VARCHAR) AS a, l_returnflag AS b FROM lineitem) GROUP BY 1",
)
def row_digests(t):
    return persist.row_digests(t.lineitem, "l_suppkey", ["l_orderkey", "l_linenumber", "l_partkey"], ["l_partkey", "l_returnflag"])


@register("resolve_many", "SELECT l_orderkey, l_linenumber, l_partkey % 3000 AS type_index, p_name AS rendered, CASE WHEN p_name IS NULL THEN 'missing_type_record' ELSE 'resolved' END AS status FROM lineitem LEFT JOIN part ON p_partkey = l_partkey % 3000 AND p_size <> 7")
def resolve_many(t):
    requests = t.lineitem.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 3000).alias("type_index"))
    return lookup.resolved_many(requests, t.part.where("p_size <> 7").select(F.col("p_partkey").alias("type_index"), F.col("p_name").alias("rendered")))


_SCANS = """
p AS (SELECT o_orderkey AS procedure_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey * 64 + 4096 END AS va, o_custkey % 7 * 4 + CASE WHEN o_orderkey % 11 = 0 THEN 2 ELSE 0 END AS size FROM orders),
s AS (SELECT *, CASE WHEN va >= 8192 AND va < 40000 THEN least(size - size % 4, 40000 - va) ELSE 0 END AS scanned_size,
  CASE WHEN va IS NULL THEN 'unresolved_va' WHEN NOT (va >= 8192 AND va < 40000) THEN 'unmapped_va' WHEN size = 0 THEN 'empty' WHEN va + size > 40000 THEN 'truncated_raw_extent' WHEN size % 4 <> 0 THEN 'unaligned_size' ELSE 'ok' END AS status FROM p)
"""


def _scans(t):
    va = F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey") * 64 + 4096)
    size = F.col("o_custkey") % 7 * 4 + F.when(F.col("o_orderkey") % 11 == 0, 2).otherwise(0)
    return decode.scans(t.orders.select(F.col("o_orderkey").alias("procedure_id"), va.alias("va"), size.alias("size")), 8192, 40000)


@register("scan_coverage", f"WITH {_SCANS} SELECT procedure_id, va, size, scanned_size, size - scanned_size AS unscanned_byte_count, status FROM s")
def scan_coverage(t):
    return _scans(t)


@register("scan_words", f"WITH {_SCANS} SELECT va + 4 * i AS address, count(*) AS use_count FROM s, (SELECT unnest(range(0, 8)) AS i) WHERE scanned_size >= 4 AND 4 * i <= scanned_size - 4 GROUP BY 1")
def scan_words(t):
    return decode.words_of(_scans(t)).groupBy("address").agg(F.count("*").alias("use_count"))


@register("rule_alternative_subject", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE CASE WHEN l_partkey % 2 = 0 THEN l_suppkey % 5 END IS DISTINCT FROM CASE WHEN o_orderstatus = 'F' THEN o_custkey % 5 END")
def rule_alternative_subject(t):
    alternatives = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_partkey") % 2 == 0, F.col("l_suppkey") % 5).alias("subject"))
    sets = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey") % 5).alias("subject"))
    return checks.unmatched(alternatives, sets, ["l_orderkey"], ["subject"]).select("l_orderkey", "l_linenumber")


@register("rule_endpoint_address", "SELECT l_orderkey, l_partkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT p_partkey, p_partkey % 100 FROM part WHERE p_size > 10)")
def rule_endpoint_address(t):
    at = t.part.where("p_size > 10").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_partkey") % 100).alias("l_suppkey"))
    return checks.orphans(t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey"), at, ["l_partkey", "l_suppkey"]).select("l_orderkey", "l_partkey")


@register("rule_exclusive_links", "SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority = '5-LOW'")
def rule_exclusive_links(t):
    definitive = t.orders.where("o_orderstatus = 'F'").select("o_custkey")
    return definitive.distinct().join(t.orders.where("o_orderpriority = '5-LOW'").select("o_custkey"), "o_custkey", "left_semi")


@register(
    "paths_invalid",
    r"""WITH paths AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '../' ELSE '' END || regexp_extract(url, '^https?://[^/]+/(.*)$', 1) AS p FROM pages)
SELECT page_id FROM paths WHERE NOT (length(p) > 0 AND NOT starts_with(p, '/') AND NOT contains(p, '//') AND NOT regexp_matches(p, '(^|/)[.][.]?(/|$)') AND NOT contains(p, chr(92)) AND NOT contains(p, ':'))""",
)
def paths_invalid(t):
    path = F.concat(F.when(F.col("page_id") % 3 == 0, "../").otherwise(""), F.regexp_extract("url", "^https?://[^/]+/(.*)$", 1))
    return t.pages.select("page_id", path.alias("p")).where(~relative_path(F.col("p"))).select("page_id")
