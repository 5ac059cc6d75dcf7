"""Semantic checks, one for each kind, on adapter views."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import checks
from cairn.plans.registry import register


@register("check_orphans", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def check_orphans(t):
    return checks.orphans(t.orders.select("o_orderkey"), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@register("check_projection", "SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linestatus IS NOT DISTINCT FROM CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE o.o_orderstatus END)")
def check_projection(t):
    rows = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("v"))
    return checks.unmatched(rows, t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("v")), ["id"], ["v"]).select(F.col("id").alias("o_orderkey"))


@register("check_except", "SELECT o_custkey AS id FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def check_except(t):
    return checks.not_in(t.orders.select(F.col("o_custkey").alias("id")), t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("id")))


@register("check_contiguous", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)")
def check_contiguous(t):
    return checks.not_contiguous(t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("p")), ["l_orderkey"], "p").select("l_orderkey", "n")


@register("check_count_mismatch", "SELECT o_orderkey, declared, coalesce(n, 0) AS actual FROM (SELECT o_orderkey, o_custkey % 6 AS declared FROM orders) LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE declared <> coalesce(n, 0)")
def check_count_mismatch(t):
    return checks.count_mismatch(t.orders.select("o_orderkey", (F.col("o_custkey") % 6).alias("declared")), t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "declared")


@register(
    "check_summary_mismatch",
    "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS d, count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> coalesce(n, 0) OR o_custkey % 5 <> coalesce(d, 0) OR o_custkey % 2 <> coalesce(r, 0)",
)
def check_summary_mismatch(t):
    parents = t.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("lines"), (F.col("o_custkey") % 5).alias("suppliers"), (F.col("o_custkey") % 2).alias("returned"))
    children = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag")
    declared = {"lines": F.count("*"), "suppliers": F.count_distinct("l_suppkey"), "returned": F.count_if(F.col("l_returnflag") == "R")}
    return checks.summary_mismatch(parents, children, "o_orderkey", declared).select("o_orderkey")


@register("check_row_number", "SELECT l_orderkey, l_linenumber, l_partkey, e AS expected FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS e FROM lineitem) WHERE l_linenumber - 1 <> e")
def check_row_number(t):
    rows = t.lineitem.withColumn("ordinal", F.col("l_linenumber") - 1)
    return checks.ordinal_mismatch(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "ordinal").select("l_orderkey", "l_linenumber", "l_partkey", F.col("expected").cast("long").alias("expected"))


@register("check_extent", "SELECT l_orderkey, l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey < l_suppkey * 10 OR l_partkey >= l_suppkey * 10 + 500")
def check_extent(t):
    extents = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), (F.col("s_suppkey") * 10).alias("lo"), F.lit(500).alias("size"))
    return checks.outside_extent(t.lineitem, extents, "l_suppkey", "l_partkey", "lo", "size").select("l_orderkey", "l_partkey")


@register("check_json_sum", "SELECT user_id, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY 1 HAVING sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) <> 50 * count(*)")
def check_json_sum(t):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.groupBy("user_id").agg(F.sum(k).alias("total"), F.count("*").alias("n")).where("total <> 50 * n").select("user_id", "total")


@register("check_leakage", "SELECT 'functions' AS table_name, count(*) AS rows FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') UNION ALL SELECT 'names', count(*) FROM lineitem WHERE l_partkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def check_leakage(t):
    producers = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("provenance_id"))
    return checks.leakage({"functions": t.orders.select(F.col("o_custkey").alias("provenance_id")), "names": t.lineitem.select(F.col("l_partkey").alias("provenance_id"))}, producers)


@register("check_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def check_duplicates(t):
    return checks.duplicates(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@register("check_exactly_one", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F') = (o_orderpriority = '1-URGENT')")
def check_exactly_one(t):
    rows = t.orders.selectExpr("o_orderkey", "CASE WHEN o_orderstatus = 'F' THEN 1 END AS a", "CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END AS b")
    return checks.not_exactly_one(rows, ["a", "b"]).select("o_orderkey")


@register("check_domain", "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('click', 'view', 'purchase')")
def check_domain(t):
    return checks.not_in_domain(t.events.select("event_id", "event_type"), "event_type", ("click", "view", "purchase"))


@register("check_id_format", "SELECT c_custkey FROM customer WHERE c_name <> 'Customer#' || lpad(CAST(c_custkey % 1000 AS VARCHAR), 9, '0')")
def check_id_format(t):
    return checks.id_format(t.customer.select("c_custkey", "c_name", (F.col("c_custkey") % 1000).alias("k")), "c_name", "Customer#%09d", "k").select("c_custkey")


@register("check_cardinality", "WITH f AS (SELECT p_partkey * p_size % 1499 AS a, count(*) AS n FROM part GROUP BY 1) SELECT o_orderkey FROM orders LEFT JOIN f ON a = o_custkey % 1499 WHERE CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'unique' ELSE 'fold' END <> CASE o_orderstatus WHEN 'F' THEN 'unique' WHEN 'O' THEN 'none' ELSE 'fold' END")
def check_cardinality(t):
    functions = t.part.select((F.col("p_partkey") * F.col("p_size") % 1499).alias("address"))
    kind = F.when(F.col("o_orderstatus") == "F", "unique").when(F.col("o_orderstatus") == "O", "none").otherwise("fold")
    return checks.cardinality(t.orders.select("o_orderkey", (F.col("o_custkey") % 1499).alias("at_address"), kind.alias("kind")), "at_address", functions, "kind").select("o_orderkey")


@register("check_digest", "SELECT doc_id FROM documents WHERE sha256(text) <> sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' ' ELSE text END)")
def check_digest(t):
    stored = F.sha2(F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")), 256)
    return checks.digest_mismatch(t.documents.select("doc_id", "text", stored.alias("digest")), "text", "digest").select("doc_id")


@register(
    "check_counts",
    "SELECT 'orders_without_lines' AS \"check\", count(*) AS violations FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) UNION ALL SELECT 'lines_without_part', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'orders_without_customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)",
)
def check_counts(t):
    found = {
        "orders_without_lines": checks.orphans(t.orders, t.lineitem.select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"]),
        "lines_without_part": checks.orphans(t.lineitem, t.part.select(F.col("p_partkey").alias("l_partkey")), ["l_partkey"]),
        "orders_without_customer": checks.orphans(t.orders, t.customer.select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]),
    }
    return checks.counted(found)
