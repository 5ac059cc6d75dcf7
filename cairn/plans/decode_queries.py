"""Decoding operators on words and names derived from the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import decode
from cairn.plans.registry import Tables, register

# Words: opcode 16, 18 or 19 with bits of the line's keys; address: four times the order key.
_WORDS = """
words AS (
  SELECT l_orderkey, l_linenumber, 1048576 + l_orderkey * 4 AS address,
    CASE l_linenumber WHEN 1 THEN 18 * 67108864 + (l_partkey * 4093 % 67108864) WHEN 2 THEN 16 * 67108864 + (l_partkey * 31 % 67108864) WHEN 3 THEN 19 * 67108864 + l_suppkey * 65536 + 32 + l_partkey % 2 WHEN 4 THEN 19 * 67108864 + 1056 + l_partkey % 2 ELSE 14 * 67108864 + l_partkey END AS word
  FROM lineitem),
decoded AS (
  SELECT *, word >> 26 AS op, word & 1 = 1 AS link, word & 2 = 2 AS abs_bit,
    CASE WHEN word >> 26 = 18 THEN CASE WHEN (word & 67108860) >= 33554432 THEN (word & 67108860) - 67108864 ELSE word & 67108860 END
         WHEN word >> 26 = 16 THEN CASE WHEN (word & 65532) >= 32768 THEN (word & 65532) - 65536 ELSE word & 65532 END END AS move
  FROM words WHERE word >> 26 IN (16, 18, 19)),
branches AS (
  SELECT l_orderkey, l_linenumber, address, word, CASE op WHEN 18 THEN 'branch_immediate' WHEN 16 THEN 'branch_conditional' ELSE CASE WHEN (word >> 1) & 1023 = 16 THEN 'branch_to_link_register' ELSE 'branch_to_count_register' END END AS branch_kind,
    ((CASE WHEN abs_bit THEN move ELSE address + move END) % 4294967296 + 4294967296) % 4294967296 AS target, link, abs_bit AND op <> 19 AS absolute, op <> 18 AS conditional, op = 19 AS indirect
  FROM decoded)
"""


def _branches(t: Tables) -> DataFrame:
    word = F.expr(
        "CASE l_linenumber WHEN 1 THEN 18 * 67108864L + (l_partkey * 4093 % 67108864) WHEN 2 THEN 16 * 67108864L + (l_partkey * 31 % 67108864) WHEN 3 THEN 19 * 67108864L + l_suppkey * 65536 + 32 + l_partkey % 2 WHEN 4 THEN 19 * 67108864L + 1056 + l_partkey % 2 ELSE 14 * 67108864L + l_partkey END"
    )
    return decode.branches(t.lineitem.select("l_orderkey", "l_linenumber", (F.lit(1048576) + F.col("l_orderkey") * 4).alias("address"), word.alias("word")))


@register("ppc_branch_decode", f"WITH {_WORDS} SELECT * FROM branches")
def ppc_branch_decode(t):
    return _branches(t)


_ROLES = f"""{_WORDS}, uses AS (SELECT *, 1048576 AS procedure_va, 20000 AS procedure_size, target >= 1048576 AND target < 1068576 AS inside, target = (address + 4) % 4294967296 AS setup FROM branches),
roles AS (
  SELECT *, CASE branch_kind
    WHEN 'branch_immediate' THEN CASE WHEN link THEN CASE WHEN setup THEN 'link_register_setup' WHEN inside THEN 'local_direct_call' ELSE 'direct_call' END ELSE CASE WHEN inside THEN 'local_branch' ELSE 'tail_transfer' END END
    WHEN 'branch_conditional' THEN CASE WHEN link THEN CASE WHEN setup THEN 'conditional_link_register_setup' WHEN inside THEN 'local_conditional_call' ELSE 'conditional_call' END ELSE CASE WHEN inside THEN 'local_conditional_branch' ELSE 'conditional_transfer' END END
    WHEN 'branch_to_count_register' THEN CASE WHEN link THEN 'indirect_call' ELSE 'indirect_tail_or_switch' END ELSE CASE WHEN link THEN 'indirect_link_register_call' ELSE 'return_or_indirect_branch' END END AS role
  FROM uses)"""


def _roles(t: Tables) -> DataFrame:
    return decode.use_roles(_branches(t).withColumn("procedure_va", F.lit(1048576)).withColumn("procedure_size", F.lit(20000)))


@register("use_roles", f"WITH {_ROLES} SELECT role, count(*) AS use_count FROM roles GROUP BY 1")
def use_roles(t):
    return _roles(t).groupBy("role").agg(F.count("*").alias("use_count"))


@register("policy_selection", f"WITH {_ROLES} SELECT l_orderkey, count(*) AS use_count FROM roles WHERE address IN (SELECT address FROM roles WHERE role IN ('{"', '".join(decode.CALL_RELEVANT)}')) GROUP BY 1")
def policy_selection(t):
    return decode.selected(_roles(t).withColumnRenamed("address", "site_id")).groupBy("l_orderkey").agg(F.count("*").alias("use_count"))


@register(
    "target_kinds",
    f"WITH {_WORDS}, f AS (SELECT p_partkey % 700 * 4 + 1048576 AS target, count(*) AS n FROM part GROUP BY 1) SELECT CASE WHEN target IS NULL THEN 'indirect' WHEN n = 1 THEN 'unique_procedure' WHEN n > 1 THEN 'fold_group' WHEN target >= 1048576 AND target < 1148576 THEN 'executable_non_entry' ELSE 'outside_executable' END AS target_kind, count(*) AS site_count FROM branches LEFT JOIN f USING (target) GROUP BY 1",
)
def target_kinds(t):
    functions = t.part.select((F.col("p_partkey") % 700 * 4 + 1048576).alias("address"))
    return decode.target_kinds(_branches(t), functions, 1048576, 1148576).groupBy("target_kind").agg(F.count("*").alias("site_count"))


@register(
    "pointer_run",
    "WITH w AS (SELECT l_suppkey AS table_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS slot_index, l_partkey AS target, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem), s AS (SELECT table_id, least(max(n), 4096) AS n, min(slot_index) FILTER (WHERE NOT (target >= 20 AND target < 1990)) AS stop FROM w WHERE slot_index < 4096 GROUP BY 1) SELECT table_id, CAST(coalesce(stop, n) AS BIGINT) AS slot_count, CASE WHEN stop IS NOT NULL THEN 'first_non_text_pointer' WHEN n >= 4096 THEN 'max_slots_reached' ELSE 'mapped_section_end' END AS termination FROM s",
)
def pointer_run(t):
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")) - 1
    return decode.pointer_runs(t.lineitem.select(F.col("l_suppkey").alias("table_id"), at.alias("slot_index"), F.col("l_partkey").alias("target")), 20, 1990)


@register(
    "vftable_boundary",
    "SELECT s_suppkey AS table_id, va, next_va, CASE WHEN next_va IS NULL THEN 'no_later_vftable_symbol' WHEN (next_va - va) % 4 <> 0 THEN 'next_vftable_symbol_unaligned' WHEN (next_va - va) // 4 < n THEN 'next_vftable_inside_pointer_run' WHEN (next_va - va) // 4 = n THEN 'next_vftable_at_pointer_run_end' ELSE 'next_vftable_after_pointer_run' END AS boundary FROM (SELECT *, lead(va) OVER (PARTITION BY s_nationkey ORDER BY va, s_suppkey) AS next_va FROM (SELECT s_suppkey, s_nationkey, s_suppkey * 16 + s_suppkey % 3 // 2 AS va, s_suppkey % 90 AS n FROM supplier))",
)
def vftable_boundary(t):
    rows = t.supplier.select(F.col("s_suppkey").alias("table_id"), "s_nationkey", (F.col("s_suppkey") * 16 + F.floor(F.col("s_suppkey") % 3 / 2)).alias("va"), (F.col("s_suppkey") % 90).alias("slot_count"))
    return decode.boundaries(rows, ["s_nationkey"]).select("table_id", "va", "next_va", "boundary")


@register(
    "vftable_name_parts",
    """WITH n AS (SELECT c_custkey, c_name, c_mktsegment, CAST(c_custkey % 6 AS INTEGER) AS k FROM customer)
SELECT c_custkey, CASE k WHEN 0 THEN NULL WHEN 5 THEN NULL WHEN 4 THEN '?$' || c_name ELSE c_name END AS owner, CASE k WHEN 2 THEN '?$' || c_mktsegment WHEN 3 THEN c_mktsegment END AS qualifier,
  CASE k WHEN 0 THEN 'not_vftable' WHEN 1 THEN 'unqualified_vfptr_symbol' WHEN 2 THEN 'qualified_vfptr_symbol' WHEN 3 THEN 'unparsed' WHEN 4 THEN 'unqualified_vfptr_symbol' ELSE 'unparsed' END AS role, k = 4 AS is_template_owner, k = 2 AS is_template_qualifier FROM n""",
)
def vftable_name_parts(t):
    k = F.col("c_custkey") % 6
    name = (
        F.when(k == 0, F.col("c_name"))
        .when(k == 1, F.concat(F.lit("??_7"), "c_name", F.lit("@@6B@")))
        .when(k == 2, F.concat(F.lit("??_7"), "c_name", F.lit("@@6B?$"), "c_mktsegment", F.lit("@")))
        .when(k == 3, F.concat(F.lit("??_7"), "c_name", F.lit("@@6B"), "c_mktsegment"))
        .when(k == 4, F.concat(F.lit("??_7?$"), "c_name", F.lit("@@6B@")))
        .otherwise(F.concat(F.lit("??_7"), "c_name"))
    )
    return decode.name_parts(t.customer.select("c_custkey", name.alias("decorated_name"))).drop("decorated_name")


@register(
    "variant_disagreement",
    "WITH d AS (SELECT p_partkey % 1000 AS path, p_size % 7 + 1 AS name, string_agg(DISTINCT CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END, ',' ORDER BY CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END) AS variants FROM part GROUP BY 1, 2) SELECT l_orderkey, l_suppkey AS path, l_linenumber AS name, l_returnflag AS variant, variants AS declared_variants FROM lineitem JOIN d ON path = l_suppkey AND name = l_linenumber WHERE NOT contains(variants, l_returnflag)",
)
def variant_disagreement(t):
    calls = t.lineitem.select("l_orderkey", F.col("l_suppkey").alias("path"), F.col("l_linenumber").alias("name"), F.col("l_returnflag").alias("variant"))
    variant = F.when(F.col("p_size") % 3 == 0, "A").when(F.col("p_size") % 3 == 1, "N").otherwise("R")
    return decode.variant_disagreement(calls, t.part.select((F.col("p_partkey") % 1000).alias("path"), (F.col("p_size") % 7 + 1).alias("name"), variant.alias("variant")))

