"""Matching, alignment, inventory, export and persistence on adapter views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import expr
from cairn.operators import alignment, decode, lookup, matching, persist, ranges, sdk
from cairn.plans.registry import Tables, register

# Two sides of an anchor: the odd and the even lines of an order, each calling one of fifty keys.  Mappings come from parts.
_SIDES = """
pc AS (SELECT DISTINCT l_orderkey AS anchor, l_partkey % 50 AS pc_key FROM lineitem WHERE l_linenumber % 2 = 1),
xbox AS (SELECT DISTINCT l_orderkey AS anchor, l_partkey % 50 AS xbox_key FROM lineitem WHERE l_linenumber % 2 = 0),
mapping AS (SELECT DISTINCT p_partkey % 50 AS pc_key, (p_partkey % 50 + CASE WHEN p_partkey % 5 = 0 AND p_size > 40 THEN 1 ELSE 0 END) % 50 AS xbox_key, CASE WHEN p_partkey % 50 = 7 THEN 'fold_member_blocker' ELSE 'exact' END AS kind FROM part WHERE p_partkey % 50 % 3 <> 0),
related AS (SELECT anchor, pc_key, xbox_key, min(CASE WHEN kind = 'exact' THEN 1 ELSE 0 END) = 1 AS exact FROM pc JOIN mapping USING (pc_key) JOIN xbox USING (anchor, xbox_key) GROUP BY 1, 2, 3),
closed AS (SELECT anchor, pc_key, xbox_key FROM (SELECT *, count(*) OVER (PARTITION BY anchor, pc_key) AS d1, count(*) OVER (PARTITION BY anchor, xbox_key) AS d2 FROM related) WHERE d1 = 1 AND d2 = 1 AND exact),
per AS (
  SELECT o_orderkey AS anchor,
    coalesce(pn, 0) AS pc_count, coalesce(xn, 0) AS xbox_count, coalesce(cn, 0) AS closed_count, coalesce(rn, 0) - coalesce(cn, 0) AS blocked_count,
    coalesce(fp, 0) AS free_pc_key, coalesce(fx, 0) AS free_xbox_key, op AS one_pc_key, ox AS one_xbox_key
  FROM (SELECT DISTINCT o_orderkey FROM orders)
  LEFT JOIN (SELECT anchor, count(*) AS pn FROM pc GROUP BY 1) p ON p.anchor = o_orderkey
  LEFT JOIN (SELECT anchor, count(*) AS xn FROM xbox GROUP BY 1) x ON x.anchor = o_orderkey
  LEFT JOIN (SELECT anchor, count(*) AS cn FROM closed GROUP BY 1) c ON c.anchor = o_orderkey
  LEFT JOIN (SELECT anchor, count(*) AS rn FROM related GROUP BY 1) r ON r.anchor = o_orderkey
  LEFT JOIN (SELECT anchor, count(*) AS fp, min(pc_key) AS op FROM pc WHERE (anchor, pc_key) NOT IN (SELECT anchor, pc_key FROM related) GROUP BY 1) q ON q.anchor = o_orderkey
  LEFT JOIN (SELECT anchor, count(*) AS fx, min(xbox_key) AS ox FROM xbox WHERE (anchor, xbox_key) NOT IN (SELECT anchor, xbox_key FROM related) GROUP BY 1) y ON y.anchor = o_orderkey),
outcomes AS (
  SELECT *, CASE WHEN pc_count = 0 THEN 'missing_pc_calls' WHEN xbox_count = 0 THEN 'missing_eligible_xbox_calls' WHEN blocked_count > 0 THEN 'blocked_ambiguous_existing_relations'
    WHEN free_pc_key = 1 AND free_xbox_key = 1 AND closed_count > 0 THEN 'unique_residual_proposal' WHEN free_pc_key = 0 AND free_xbox_key = 0 THEN 'closed_squares_only' ELSE 'no_unique_residual' END AS outcome
  FROM per)
"""


def _sides(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    line = t.lineitem.select(F.col("l_orderkey").alias("anchor"), (F.col("l_partkey") % 50).alias("k"), "l_linenumber")
    pc = line.where("l_linenumber % 2 = 1").select("anchor", F.col("k").alias("pc_key"))
    xbox = line.where("l_linenumber % 2 = 0").select("anchor", F.col("k").alias("xbox_key"))
    key = F.col("p_partkey") % 50
    shifted = (key + F.expr("CASE WHEN p_partkey % 5 = 0 AND p_size > 40 THEN 1 ELSE 0 END")) % 50
    mapping = t.part.where("p_partkey % 50 % 3 <> 0").select(key.alias("pc_key"), shifted.alias("xbox_key"), F.when(key == 7, "fold_member_blocker").otherwise("exact").alias("kind"))
    return pc, xbox, mapping


def _per(t: Tables) -> DataFrame:
    return matching.neighbourhoods(*_sides(t), t.orders.select(F.col("o_orderkey").alias("anchor")))


@register("matcher_bundles", "SELECT p_partkey % 50 || ':' || p_size AS bundle_id, CAST(p_partkey % 50 AS VARCHAR) AS pc_key, CAST(p_size AS VARCHAR) AS xbox_key, count(*) AS lineage_count, min(p_partkey) AS first_lineage, max(p_partkey) AS last_lineage FROM part WHERE p_type <> 'PROMO' GROUP BY ALL")
def matcher_bundles(t):
    status = F.when(F.col("p_type") == "PROMO", "derived_non_seed").otherwise("candidate")
    return matching.bundles(t.part.select((F.col("p_partkey") % 50).cast("string").alias("pc_key"), F.col("p_size").cast("string").alias("xbox_key"), F.col("p_partkey").alias("alternative_id"), status.alias("status")))


@register("matcher_relations", f"WITH {_SIDES} SELECT * FROM related")
def matcher_relations(t):
    return matching.relations(*_sides(t))


@register("matcher_closed_squares", f"WITH {_SIDES} SELECT * FROM closed")
def matcher_closed_squares(t):
    return matching.mutual(matching.relations(*_sides(t)))


@register("matcher_outcomes", f"WITH {_SIDES} SELECT outcome, count(*) AS anchor_count FROM outcomes GROUP BY 1")
def matcher_outcomes(t):
    return matching.outcome_counts(_per(t))


@register("matcher_neighbourhoods", f"WITH {_SIDES} SELECT anchor, pc_count, xbox_count, closed_count, blocked_count, outcome FROM outcomes")
def matcher_neighbourhoods(t):
    return _per(t).select("anchor", "pc_count", "xbox_count", "closed_count", "blocked_count", "outcome")


@register("matcher_residuals", f"WITH {_SIDES} SELECT anchor, one_pc_key AS pc_key, one_xbox_key AS xbox_key, closed_count FROM outcomes WHERE outcome = 'unique_residual_proposal'")
def matcher_residuals(t):
    return matching.residuals(_per(t))


@register("matcher_proposal_sets", f"WITH {_SIDES} SELECT one_pc_key AS pc_key, count(*) AS proposal_count, string_agg(DISTINCT CAST(one_xbox_key AS VARCHAR), ',' ORDER BY CAST(one_xbox_key AS VARCHAR)) AS alternatives FROM outcomes WHERE outcome = 'unique_residual_proposal' GROUP BY 1")
def matcher_proposal_sets(t):
    p = matching.residuals(_per(t)).withColumn("xbox_key", F.col("xbox_key").cast("string"))
    return matching.proposal_sets(p)


@register("matcher_exclusions", "SELECT CASE WHEN event_type = 'error' THEN 'indirect_target' WHEN event_type NOT IN ('click', 'view') THEN 'role_not_direct_call' ELSE 'eligible' END AS reason, count(*) AS flow_count FROM events GROUP BY 1")
def matcher_exclusions(t):
    role = F.when(F.col("event_type") == "click", "direct_call").when(F.col("event_type") == "view", "local_direct_call").otherwise("tail_transfer")
    kind = F.when(F.col("event_type") == "error", "indirect").otherwise("unique_procedure")
    return t.events.select(F.coalesce(matching.exclusion_reason(role, kind), F.lit("eligible")).alias("reason")).groupBy("reason").agg(F.count("*").alias("flow_count"))


@register("conflicting_ids", "SELECT l_orderkey AS record_id, count(DISTINCT (l_partkey, l_suppkey)) AS contents FROM lineitem WHERE l_linenumber = 1 GROUP BY 1 HAVING count(DISTINCT (l_partkey, l_suppkey)) > 1")
def conflicting_ids(t):
    return matching.conflicting_ids(t.lineitem.where("l_linenumber = 1").withColumnRenamed("l_orderkey", "record_id"), "record_id", ["l_partkey", "l_suppkey"])


# Sections: disjoint ranges from parts; observations: order totals as addresses.
_SECTIONS = """
sections AS (SELECT p_partkey AS section_id, 's' || p_partkey AS section_name, p_partkey * 300 AS range_start, p_partkey * 300 + p_size * 5 AS range_end, p_size % 2 = 0 AS executable FROM part),
observations AS (
  SELECT o_orderkey AS observation_id, CAST(floor(o_totalprice) AS BIGINT) AS address, (['game', 'geck', 'unspecified_pc'])[CAST(o_orderkey % 3 AS INTEGER) + 1] AS program_variant FROM orders),
functions AS (SELECT s_suppkey AS function_id, s_suppkey * 300 AS address FROM supplier),
placed AS (
  SELECT o.*, s.section_name, s.executable, f.function_id FROM observations o
  LEFT JOIN sections s ON s.range_start <= o.address AND o.address < s.range_end LEFT JOIN functions f ON f.address = o.address)
"""


def _placed(t: Tables) -> DataFrame:
    p = F.col("p_partkey")
    sections = t.part.select(F.concat(F.lit("s"), p.cast("string")).alias("section_name"), (p * 300).alias("range_start"), (p * 300 + F.col("p_size") * 5).alias("range_end"), (F.col("p_size") % 2 == 0).alias("executable"))
    variant = F.element_at(F.array(F.lit("game"), F.lit("geck"), F.lit("unspecified_pc")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    rows = t.orders.select(F.col("o_orderkey").alias("observation_id"), F.floor("o_totalprice").alias("address"), variant.alias("program_variant"))
    inside = ranges.containing(rows, "address", sections, "range_start", "range_end", 300, "left")
    functions = t.supplier.select(F.col("s_suppkey").alias("function_id"), (F.col("s_suppkey") * 300).alias("address"))
    return inside.join(functions, "address", "left")


@register(
    "classify_code",
    f"""WITH {_SECTIONS}, c AS (SELECT *, CASE WHEN function_id IS NOT NULL THEN 'pc_function_entry' WHEN executable THEN 'pc_executable_non_entry' WHEN section_name IS NOT NULL THEN 'pc_non_executable_section' ELSE 'outside_pc_image_sections' END AS place FROM placed)
SELECT observation_id, address, section_name, CASE program_variant WHEN 'geck' THEN 'non_game_variant' WHEN 'game' THEN place ELSE place || '_variant_unspecified' END AS classification,
  CASE WHEN program_variant = 'game' AND function_id IS NOT NULL THEN 'definitive' WHEN program_variant = 'unspecified_pc' AND function_id IS NOT NULL THEN 'candidate' ELSE 'none' END AS link_kind FROM c""",
)
def classify_code(t):
    return ranges.classify_code(_placed(t)).select("observation_id", "address", "section_name", "classification", "link_kind")


@register(
    "classify_data",
    f"""WITH {_SECTIONS} SELECT CASE WHEN program_variant = 'geck' THEN 'non_game_variant' ELSE CASE WHEN section_name IS NULL THEN 'outside_pc_image_sections' WHEN executable THEN 'pc_executable_section' ELSE 'pc_data_section' END || CASE WHEN program_variant = 'game' THEN '' ELSE '_variant_unspecified' END END AS classification, count(*) AS observation_count FROM placed GROUP BY 1""",
)
def classify_data(t):
    return ranges.classify_data(_placed(t)).groupBy("classification").agg(F.count("*").alias("observation_count"))


@register(
    "boundary_containers",
    """WITH extents AS (SELECT p_partkey AS function_id, p_partkey * 100 AS lo, p_partkey * 100 + p_size * 12 AS hi FROM part),
found AS (SELECT o.o_orderkey AS observation_id, e.function_id FROM orders o JOIN extents e ON e.lo <= floor(o.o_totalprice) AND floor(o.o_totalprice) < e.hi)
SELECT o_orderkey AS observation_id, count(function_id) AS container_count, min(function_id) AS first_container, max(function_id) AS last_container FROM orders LEFT JOIN found ON o_orderkey = observation_id GROUP BY 1""",
)
def boundary_containers(t):
    extents = t.part.select(F.col("p_partkey").alias("function_id"), (F.col("p_partkey") * 100).alias("lo"), (F.col("p_partkey") * 100 + F.col("p_size") * 12).alias("hi"))
    rows = t.orders.select(F.col("o_orderkey").alias("observation_id"), F.floor("o_totalprice").alias("at"))
    j = ranges.containing(rows, "at", extents, "lo", "hi", 300, "left")
    return j.groupBy("observation_id").agg(F.count("function_id").alias("container_count"), F.min("function_id").alias("first_container"), F.max("function_id").alias("last_container"))


# Observations: orders at their total; functions: parts, of nested and overlapping extents, some very long; sections: regions.
_SDK = """
WITH functions AS (SELECT p_partkey AS function_id, p_partkey * 100 AS address, CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN 200000 ELSE p_size * 12 END AS size FROM part),
sections AS (SELECT r_name AS section_name, r_regionkey * 90000 + 1000 AS lo, r_regionkey * 90000 + 90000 AS hi, r_regionkey % 2 = 0 AS executable FROM region),
seen AS (
  SELECT o_orderkey AS observation_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'geck' WHEN '2-HIGH' THEN 'unspecified_pc' ELSE 'game' END AS program_variant,
    CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) * 100 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS address, CASE WHEN o_orderstatus = 'O' THEN 'comment' ELSE 'create_object_macro' END AS evidence_kind FROM orders),
j AS (SELECT s.*, f.function_id AS f, section_name, executable FROM seen s LEFT JOIN functions f USING (address) LEFT JOIN sections c ON lo <= address AND address < hi),
code AS (
  SELECT observation_id, address, evidence_kind, section_name, program_variant, f,
    CASE WHEN program_variant = 'geck' THEN 'non_game_variant' ELSE
      CASE WHEN f IS NOT NULL THEN 'pc_function_entry' WHEN section_name IS NOT NULL AND executable THEN 'pc_executable_non_entry' WHEN section_name IS NOT NULL THEN 'pc_non_executable_section' ELSE 'outside_pc_image_sections' END
      || CASE WHEN program_variant = 'game' THEN '' ELSE '_variant_unspecified' END END AS classification
  FROM j)
"""


def _code_joins(t: Tables):
    functions = t.part.select(F.col("p_partkey").alias("function_id"), (F.col("p_partkey") * 100).alias("address"), F.expr("CASE WHEN p_size = 1 THEN 0 WHEN p_size = 2 THEN 200000 ELSE p_size * 12 END").alias("size"))
    sections = t.region.select(F.col("r_name").alias("section_name"), (F.col("r_regionkey") * 90000 + 1000).cast("long").alias("start"), (F.col("r_regionkey") * 90000 + 90000).cast("long").alias("end"), (F.col("r_regionkey") % 2 == 0).alias("executable"))
    seen = t.orders.selectExpr(
        "o_orderkey AS observation_id", "CASE o_orderpriority WHEN '1-URGENT' THEN 'geck' WHEN '2-HIGH' THEN 'unspecified_pc' ELSE 'game' END AS program_variant",
        "CASE WHEN o_orderkey % 3 = 0 THEN CAST(floor(o_totalprice / 100) AS BIGINT) * 100 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS address", "CASE WHEN o_orderstatus = 'O' THEN 'comment' ELSE 'create_object_macro' END AS evidence_kind",
    )
    return sdk.code_joins(seen, functions, sections), functions


@register("sdk_code_joins", _SDK + "SELECT observation_id, classification, section_name, CASE WHEN program_variant = 'game' THEN f END AS pc_function_id, CASE WHEN program_variant = 'unspecified_pc' THEN f END AS candidate_pc_function_id FROM code")
def sdk_code_joins(t):
    return _code_joins(t)[0].select("observation_id", "classification", "section_name", "pc_function_id", "candidate_pc_function_id")


@register(
    "sdk_boundary_candidates",
    _SDK + "SELECT observation_id, c.address, classification, coalesce(string_agg(CAST(f.address AS VARCHAR), ',' ORDER BY f.address), '') AS containing_function_entries FROM code c LEFT JOIN functions f ON f.size > 0 AND f.address <= c.address AND c.address < f.address + f.size WHERE evidence_kind = 'create_object_macro' AND starts_with(classification, 'pc_executable_non_entry') GROUP BY 1, 2, 3",
)
def sdk_boundary_candidates(t):
    rows = sdk.boundary_candidates(*_code_joins(t))
    return rows.select("observation_id", "address", "classification", F.array_join(F.transform("containing_function_entries", lambda e: e.cast("string")), ",").alias("containing_function_entries"))


@register(
    "section_overlap",
    "SELECT p_partkey, CAST(p_retailprice * 10 AS BIGINT) AS lo, CAST(p_retailprice * 10 AS BIGINT) + p_size AS hi FROM (SELECT *, max(CAST(p_retailprice * 10 AS BIGINT) + p_size) OVER (PARTITION BY p_brand ORDER BY CAST(p_retailprice * 10 AS BIGINT), p_size, p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM part) WHERE CAST(p_retailprice * 10 AS BIGINT) < reach",
)
def section_overlap(t):
    lo = F.rint(F.col("p_retailprice") * 10).cast("long")
    rows = t.part.select("p_partkey", "p_brand", lo.alias("lo"), (lo + F.col("p_size")).alias("hi"))
    return ranges.overlaps(rows, "lo", "hi", ["p_brand"], ["p_partkey"]).select("p_partkey", "lo", "hi")


# Tables of two builds: suppliers and customers; class: the nation; slots: up to twenty numbers each.
_VT = """
pc_t AS (SELECT s_suppkey AS vtable_id, 'c' || s_nationkey || '_' || s_suppkey % 3 AS class_name, CASE WHEN s_acctbal > 5000 THEN 'primary' WHEN s_acctbal > 0 THEN 'secondary' ELSE 'unknown' END AS vfptr_role, CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 * 4 END AS subobject_offset, s_suppkey % 17 + 2 AS slot_count FROM supplier),
xbox_t AS (SELECT c_custkey AS vtable_id, 'c' || c_nationkey || '_' || c_custkey % 30 AS class_name, CASE WHEN c_acctbal > 9000 THEN 'primary' WHEN c_acctbal > 6000 THEN 'secondary' ELSE 'unknown' END AS vfptr_role, CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 * 4 END AS subobject_offset, c_custkey % 13 + 2 AS slot_count FROM customer),
keyed AS (SELECT 'pc' AS side, * FROM pc_t UNION ALL SELECT 'xbox', * FROM xbox_t),
cnt AS (
  SELECT class_name, vfptr_role, CAST(CASE WHEN vfptr_role = 'primary' THEN 0 ELSE subobject_offset END AS BIGINT) AS subobject_offset,
    count(*) FILTER (WHERE side = 'pc') AS pc_count, count(*) FILTER (WHERE side = 'xbox') AS xbox_count,
    min(vtable_id) FILTER (WHERE side = 'pc') AS pc_vtable_id, min(vtable_id) FILTER (WHERE side = 'xbox') AS xbox_vtable_id, min(slot_count) FILTER (WHERE side = 'pc') AS pc_slot_count, min(slot_count) FILTER (WHERE side = 'xbox') AS xbox_slot_count
  FROM keyed WHERE vfptr_role = 'primary' OR vfptr_role = 'secondary' AND subobject_offset IS NOT NULL GROUP BY 1, 2, 3),
verdicts AS (
  SELECT *, CASE WHEN class_name NOT IN (SELECT class_name FROM xbox_t) THEN 'class_missing_on_xbox' WHEN class_name NOT IN (SELECT class_name FROM pc_t) THEN 'class_missing_on_pc' WHEN pc_count = 1 AND xbox_count = 1 THEN 'candidate'
    ELSE CASE WHEN vfptr_role = 'primary' THEN 'primary_role' ELSE 'secondary_offset' END || CASE WHEN pc_count > 1 OR xbox_count > 1 THEN '_ambiguous' WHEN xbox_count = 0 THEN '_missing_on_xbox' ELSE '_missing_on_pc' END END AS verdict FROM cnt),
cand AS (SELECT class_name, vfptr_role, subobject_offset, pc_vtable_id, xbox_vtable_id, least(pc_slot_count, xbox_slot_count) AS shared_prefix, pc_slot_count - least(pc_slot_count, xbox_slot_count) AS pc_tail, xbox_slot_count - least(pc_slot_count, xbox_slot_count) AS xbox_tail FROM verdicts WHERE verdict = 'candidate'),
pc_s AS (SELECT vtable_id, i AS slot_index, vtable_id * 31 + i AS target FROM pc_t, (SELECT unnest(range(0, 20)) AS i) WHERE i < slot_count AND (vtable_id + i) % 11 <> 0),
xbox_s AS (SELECT vtable_id, i AS slot_index, vtable_id * 37 + i AS target FROM xbox_t, (SELECT unnest(range(0, 20)) AS i) WHERE i < slot_count AND (vtable_id + i) % 13 <> 0),
pairs AS (SELECT c.pc_vtable_id, c.xbox_vtable_id, p.slot_index, p.target AS pc_target, x.target AS xbox_target FROM cand c JOIN pc_s p ON p.vtable_id = c.pc_vtable_id AND p.slot_index < c.shared_prefix JOIN xbox_s x ON x.vtable_id = c.xbox_vtable_id AND x.slot_index = p.slot_index)
"""


def _vtables(t: Tables):
    pc = t.supplier.selectExpr("s_suppkey AS vtable_id", "concat('c', s_nationkey, '_', s_suppkey % 3) AS class_name", "CASE WHEN s_acctbal > 5000 THEN 'primary' WHEN s_acctbal > 0 THEN 'secondary' ELSE 'unknown' END AS vfptr_role", "CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 5 * 4 END AS subobject_offset", "s_suppkey % 17 + 2 AS slot_count")
    xbox = t.customer.selectExpr(
        "c_custkey AS vtable_id", "concat('c', c_nationkey, '_', c_custkey % 30) AS class_name", "CASE WHEN c_acctbal > 9000 THEN 'primary' WHEN c_acctbal > 6000 THEN 'secondary' ELSE 'unknown' END AS vfptr_role", "CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 5 * 4 END AS subobject_offset", "c_custkey % 13 + 2 AS slot_count"
    )
    slot = lambda d, k, gap: d.select("vtable_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slot_count") - 1)).alias("slot_index")).where(f"(vtable_id + slot_index) % {gap} <> 0").withColumn("target", F.col("vtable_id") * k + F.col("slot_index"))
    return pc, xbox, slot(pc, 31, 11), slot(xbox, 37, 13)


def _pairs(t: Tables):
    pc, xbox, a, b = _vtables(t)
    found = alignment.candidates(alignment.aligned(pc, xbox))
    return found, alignment.slot_pairs(found, a, b)


@register("alignment_candidates", f"WITH {_VT} SELECT * FROM cand")
def alignment_candidates(t):
    return _pairs(t)[0]


@register("alignment_issues", f"WITH {_VT} SELECT class_name, vfptr_role, subobject_offset, pc_count, xbox_count, verdict FROM verdicts WHERE verdict <> 'candidate'")
def alignment_issues(t):
    pc, xbox, *_ = _vtables(t)
    return alignment.aligned(pc, xbox).where("verdict <> 'candidate'").select("class_name", "vfptr_role", "subobject_offset", "pc_count", "xbox_count", "verdict")


@register("slot_pairs", f"WITH {_VT} SELECT * FROM pairs")
def slot_pairs(t):
    return _pairs(t)[1].select("pc_vtable_id", "xbox_vtable_id", "slot_index", "pc_target", "xbox_target")


@register("slot_holes", f"WITH {_VT} SELECT c.pc_vtable_id, c.xbox_vtable_id, i AS slot_index FROM cand c, (SELECT unnest(range(0, 20)) AS i) WHERE i < c.shared_prefix AND (c.pc_vtable_id, c.xbox_vtable_id, i) NOT IN (SELECT pc_vtable_id, xbox_vtable_id, slot_index FROM pairs)")
def slot_holes(t):
    return alignment.missing_slots(*_pairs(t)).select("pc_vtable_id", "xbox_vtable_id", "slot_index")


@register("slot_hypothesis_kinds", "WITH n AS (SELECT p_partkey * p_size % 4001 AS address, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1) SELECT l_orderkey, l_linenumber, (l_partkey * 3 + l_linenumber) % 4001 AS address, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'exact' ELSE 'fold' END AS kind, CASE WHEN n = 1 THEN f END AS function_id FROM lineitem LEFT JOIN n ON n.address = (l_partkey * 3 + l_linenumber) % 4001")
def slot_hypothesis_kinds(t):
    functions = t.part.select((F.col("p_partkey") * F.col("p_size") % 4001).alias("address"), F.col("p_partkey").alias("function_id"))
    return alignment.at_address(t.lineitem.select("l_orderkey", "l_linenumber", ((F.col("l_partkey") * 3 + F.col("l_linenumber")) % 4001).alias("address")), functions)


@register("extent_status", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'unassessed_same_platform_declaration_unavailable' WHEN o_orderpriority = '1-URGENT' THEN 'unassessed_no_hole_free_xbox_tpi_map' WHEN n > o_custkey % 7 THEN 'pointer_run_exceeds_hole_free_xbox_tpi_map' WHEN n < o_custkey % 7 THEN 'shorter_than_hole_free_xbox_tpi_map' ELSE 'matches_hole_free_xbox_tpi_map' END AS status, count(*) AS table_count FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey GROUP BY 1")
def extent_status(t):
    n = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    declared = F.when(F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey") % 7)
    status = alignment.extent_status(F.when(F.col("o_orderstatus") == "P", "pc").otherwise("xbox360"), F.col("n"), declared)
    return t.orders.join(n, "o_orderkey").select(status.alias("status")).groupBy("status").agg(F.count("*").alias("table_count"))


@register(
    "base_offsets",
    """WITH RECURSIVE edges AS (SELECT DISTINCT p_partkey % 60 AS c, (p_partkey % 60 * 2 + p_size % 2 + 1) % 60 AS b, CAST(p_size % 2 * 4 AS BIGINT) AS o FROM part WHERE p_size <= 2),
walk AS (
  SELECT c AS class_name, b AS base_name, o AS base_offset, [c, b] AS path FROM edges WHERE c <> b
  UNION ALL SELECT w.class_name, e.b, w.base_offset + e.o, list_append(w.path, e.b) FROM walk w JOIN edges e ON e.c = w.base_name WHERE NOT list_contains(w.path, e.b))
SELECT class_name, base_name, base_offset AS "offset" FROM walk""",
)
def base_offsets(t):
    edges = t.part.where("p_size <= 2").select((F.col("p_partkey") % 60).alias("class_name"), ((F.col("p_partkey") % 60 * 2 + F.col("p_size") % 2 + 1) % 60).alias("base_name"), (F.col("p_size") % 2 * 4).cast("long").alias("base_offset")).distinct()
    return alignment.base_offsets(edges).select("class_name", "base_name", "offset")


@register("hole_free_tables", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS slots, min(l_linenumber) = 1 AND max(l_linenumber) = count(DISTINCT l_linenumber) AS hole_free FROM lineitem GROUP BY 1")
def hole_free_tables(t):
    return alignment.hole_free(t.lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("slot_index")), "l_orderkey")


# Accepted leaves: lines, at the part's entry; claims, alternatives and sets by line number.
_EXPORT = """
accepted AS (
  SELECT l_orderkey * 10 + l_linenumber AS decision_id, CASE WHEN l_linenumber = 7 THEN 'hypothesis_set' WHEN l_linenumber > 4 THEN 'alternative' ELSE 'claim' END AS target_kind,
    CASE WHEN l_linenumber = 6 THEN l_suppkey END AS xbox_fold_group_id, CASE WHEN l_quantity <> 1 THEN l_orderkey END AS claim_id,
    CASE WHEN l_quantity <> 2 THEN p_partkey END AS set_pc_function_id, CASE WHEN l_quantity = 3 THEN NULL WHEN l_quantity = 4 THEN 0 ELSE p_partkey END AS pc_function_id, CASE WHEN l_quantity <> 5 THEN l_partkey * 7 + CASE WHEN l_tax > 0.079 THEN 1 ELSE 0 END END AS xbox_function_id,
    CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN 'xbox360' ELSE 'pc' END AS pc_platform, p_size % 2 AS pc_program_id, CASE WHEN p_size = 3 THEN 'file' ELSE 'ram' END AS pc_address_space, p_partkey AS pc_address,
    CASE WHEN p_size = 4 THEN NULL WHEN p_size = 5 THEN 'pc' ELSE 'xbox360' END AS xbox_platform, CASE l_quantity WHEN 6 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS name_count, CASE WHEN l_discount > 0.099 THEN p_brand ELSE p_name END AS name, l_quantity <> 8 AS manifest_ok
  FROM lineitem JOIN part ON p_partkey = l_partkey),
k AS (SELECT *, target_kind = 'hypothesis_set' AS s, target_kind = 'alternative' AND xbox_fold_group_id IS NOT NULL AS f FROM accepted),
e AS (SELECT *, NOT s AND NOT f AND claim_id IS NOT NULL AS c, CASE WHEN NOT s AND NOT f AND claim_id IS NOT NULL THEN pc_function_id ELSE set_pc_function_id END AS subject FROM k),
ends AS (
  SELECT *, list_distinct([
    CASE WHEN c AND target_kind = 'alternative' AND set_pc_function_id IS DISTINCT FROM pc_function_id THEN 'alternative_pc_subject_mismatch' END, CASE WHEN s THEN 'hypothesis_set_only_acceptance' END,
    CASE WHEN (s OR f OR c) AND subject IS NOT NULL AND pc_platform IS NULL THEN 'missing_pc_function' END, CASE WHEN NOT (s OR f OR c) THEN 'missing_scalar_claim' END,
    CASE WHEN c AND xbox_function_id IS NOT NULL AND xbox_platform IS NULL THEN 'missing_xbox_function' END,
    CASE WHEN subject IS NOT NULL AND pc_platform IS NOT NULL AND pc_address_space NOT IN ('ram', 'va') AND (c OR f AND pc_platform = 'pc') THEN 'pc_address_space_not_runtime' END,
    CASE WHEN (f OR c) AND subject IS NOT NULL AND pc_platform <> 'pc' THEN 'pc_endpoint_wrong_platform' END, CASE WHEN (s OR f OR c) AND subject IS NULL THEN 'pc_unresolved_endpoint' END,
    CASE WHEN c AND xbox_function_id IS NOT NULL AND xbox_platform <> 'xbox360' THEN 'xbox_endpoint_wrong_platform' END, CASE WHEN f THEN 'xbox_fold_bundle' END, CASE WHEN c AND xbox_function_id IS NULL THEN 'xbox_unresolved_endpoint' END]) AS ends FROM e),
own AS (
  SELECT *, array_to_string(list_sort(list_concat(ends, list_distinct([CASE WHEN len(ends) = 0 AND name_count = 0 THEN 'missing_xbox_name' END, CASE WHEN len(ends) = 0 AND name_count > 1 THEN 'ambiguous_xbox_names' END, CASE WHEN NOT manifest_ok THEN 'provenance_manifest_mismatch' END]))), ',') AS own FROM ends),
plan AS (
  SELECT o.*, CASE WHEN own <> '' THEN own WHEN d > 1 AND n > 1 THEN 'conflicting_accepted_destination,conflicting_accepted_name' WHEN d > 1 THEN 'conflicting_accepted_destination' WHEN n > 1 THEN 'conflicting_accepted_name' ELSE '' END AS reasons
  FROM own o LEFT JOIN (SELECT pc_program_id, pc_address_space, pc_address, count(DISTINCT xbox_function_id) AS d, count(DISTINCT name) AS n FROM own WHERE own = '' GROUP BY ALL) c USING (pc_program_id, pc_address_space, pc_address))
"""


def _plan(t: Tables) -> DataFrame:
    lines = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    return persist.export_plan(
        lines.selectExpr(
            "l_orderkey * 10 + l_linenumber AS decision_id", "CASE WHEN l_linenumber = 7 THEN 'hypothesis_set' WHEN l_linenumber > 4 THEN 'alternative' ELSE 'claim' END AS target_kind",
            "CASE WHEN l_linenumber = 6 THEN l_suppkey END AS xbox_fold_group_id", "CASE WHEN l_quantity <> 1 THEN l_orderkey END AS claim_id",
            "CASE WHEN l_quantity <> 2 THEN p_partkey END AS set_pc_function_id", "CASE WHEN l_quantity = 3 THEN NULL WHEN l_quantity = 4 THEN 0 ELSE p_partkey END AS pc_function_id", "CASE WHEN l_quantity <> 5 THEN l_partkey * 7 + CASE WHEN l_tax > 0.079 THEN 1 ELSE 0 END END AS xbox_function_id",
            "CASE WHEN p_size = 1 THEN NULL WHEN p_size = 2 THEN 'xbox360' ELSE 'pc' END AS pc_platform", "p_size % 2 AS pc_program_id", "CASE WHEN p_size = 3 THEN 'file' ELSE 'ram' END AS pc_address_space", "p_partkey AS pc_address",
            "CASE WHEN p_size = 4 THEN NULL WHEN p_size = 5 THEN 'pc' ELSE 'xbox360' END AS xbox_platform", "CASE l_quantity WHEN 6 THEN 0 WHEN 7 THEN 2 ELSE 1 END AS name_count", "CASE WHEN l_discount > 0.099 THEN p_brand ELSE p_name END AS name", "l_quantity <> 8 AS manifest_ok",
        )
    )


@register("export_plan", f"WITH {_EXPORT} SELECT decision_id, pc_address, reasons, CASE WHEN reasons = '' THEN 'apply' ELSE 'blocked' END AS action FROM plan")
def export_plan(t):
    return _plan(t).select("decision_id", "pc_address", "reasons", "action")


@register("export_plan_actions", f"WITH {_EXPORT} SELECT pc_program_id, pc_address_space, pc_address, min(name) AS name, min(xbox_function_id) AS xbox_function_id, count(*) AS lineage_count, min(decision_id) AS first_decision_id FROM plan WHERE reasons = '' GROUP BY 1, 2, 3")
def export_plan_actions(t):
    return persist.applied(_plan(t))


@register("export_plan_blocked", f"WITH {_EXPORT} SELECT reason, count(*) AS decision_count FROM (SELECT unnest(string_split(reasons, ',')) AS reason FROM plan WHERE reasons <> '') GROUP BY 1")
def export_plan_blocked(t):
    return persist.blocked_counts(_plan(t))


@register("portable_labels", "SELECT p_partkey, 'EX_' || substr(CASE WHEN regexp_matches(n, '^[0-9]') THEN 'n_' || n ELSE n END, 1, 160) || '__' || substr(sha256(CAST(p_partkey AS VARCHAR)), 1, 12) AS label FROM (SELECT p_partkey, trim(regexp_replace(regexp_replace(p_brand || '  ' || p_name, '[^A-Za-z0-9_]', '_', 'g'), '_+', '_', 'g'), '_') AS n FROM part)")
def portable_labels(t):
    return t.part.select("p_partkey", expr.portable_label(F.concat_ws("  ", "p_brand", "p_name"), F.col("p_partkey").cast("string"), "EX").alias("label"))


# Classes: parts, each with half its number as base at zero; some with two, an unknown one, or themselves.  Slots: their lines.
@register(
    "primary_slot_maps",
    """WITH RECURSIVE classes AS (SELECT 'c' || p_partkey AS c, CASE WHEN p_size = 1 OR p_partkey = 1 THEN NULL WHEN p_size = 2 THEN 'unknown' WHEN p_size = 3 THEN 'c' || p_partkey WHEN p_size = 4 THEN 'c' || (p_partkey // 8 * 2 + 1) ELSE 'c' || (p_partkey // 2) END AS b, CASE WHEN p_size = 1 THEN 2 WHEN p_partkey = 1 THEN 0 ELSE 1 END AS n FROM part),
virtuals AS (SELECT DISTINCT 'c' || l_partkey AS c, CAST(l_linenumber - 1 + l_suppkey % 2 AS BIGINT) AS slot FROM lineitem WHERE l_returnflag = 'R'),
chain AS (
  SELECT c, c AS a, 0 AS d, [c] AS path FROM classes
  UNION ALL SELECT h.c, k.b, d + 1, list_append(path, k.b) FROM chain h JOIN classes k ON k.c = h.a JOIN classes up ON up.c = k.b WHERE NOT list_contains(path, k.b)),
held AS (SELECT h.c, bool_or(k.n = 0) AS complete FROM chain h JOIN classes k ON k.c = h.a GROUP BY 1),
slots AS (SELECT h.c, slot, min_by(v.c, d) AS decl FROM chain h JOIN virtuals v ON v.c = h.a GROUP BY 1, 2),
per AS (SELECT c, string_agg(slot || ':' || decl, ',' ORDER BY slot) AS slots, max(slot) + 1 = count(*) AS hole_free FROM slots GROUP BY 1)
SELECT c AS class_name, coalesce(slots, '') AS slots, coalesce(hole_free, false) AS hole_free, complete FROM held LEFT JOIN per USING (c)""",
)
def primary_slot_maps(t):
    name = lambda e: F.expr(f"concat('c', {e})")
    classes = t.part.select(name("p_partkey").alias("class_name"))
    base = F.expr("CASE WHEN p_size = 2 THEN 'unknown' WHEN p_size = 3 THEN concat('c', p_partkey) WHEN p_size = 4 THEN concat('c', p_partkey div 8 * 2 + 1) ELSE concat('c', p_partkey div 2) END")
    first = t.part.where("p_partkey <> 1 OR p_size = 1").select(name("p_partkey").alias("class_name"), base.alias("base_name"), F.lit(0).alias("base_offset"))
    more = t.part.where("p_size = 1").select(name("p_partkey").alias("class_name"), F.lit("c1").alias("base_name"), F.lit(0).alias("base_offset"))
    virtuals = t.lineitem.where("l_returnflag = 'R'").select(name("l_partkey").alias("class_name"), F.expr("l_linenumber - 1 + l_suppkey % 2").alias("slot"))
    out = alignment.slot_maps(classes, first.unionByName(more), virtuals)
    return out.withColumn("slots", F.array_join(F.transform("slots", lambda s: F.concat_ws(":", s["slot"].cast("string"), s["declared_by"])), ","))


_HALVES = "old AS (SELECT o_orderkey AS id, o_orderstatus AS a, o_orderpriority AS b FROM orders), new AS (SELECT o_custkey * 20 AS id, min(o_orderstatus) AS a, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE min(o_orderpriority) END AS b FROM orders GROUP BY o_custkey)"


def _halves(t: Tables):
    old = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("a"), F.col("o_orderpriority").alias("b"))
    new = t.orders.groupBy("o_custkey").agg(F.min("o_orderstatus").alias("a"), F.min("o_orderpriority").alias("b"))
    return new.select((F.col("o_custkey") * 20).alias("id"), "a", F.when(F.col("o_custkey") % 5 != 0, F.col("b")).alias("b")), old


@register("upsert_conflicts", f"WITH {_HALVES} SELECT n.* FROM new n JOIN old o USING (id) WHERE n.a IS DISTINCT FROM o.a OR n.b IS DISTINCT FROM o.b")
def upsert_conflicts(t):
    return persist.conflicts(*_halves(t), "id", ["a", "b"])


@register("bulk_insert_new", f"WITH {_HALVES} SELECT n.* FROM new n ANTI JOIN old o USING (id)")
def bulk_insert_new(t):
    return persist.additions(*_halves(t), "id")


@register("upserted", f"WITH {_HALVES} SELECT o.* FROM old o ANTI JOIN new n USING (id) UNION ALL SELECT * FROM new")
def upserted(t):
    return persist.upserted(*_halves(t), "id")


@register("stable_ids", """SELECT s_suppkey, 'sup:sha256:' || sha256('{"components":["' || s_name || '",' || s_nationkey || ',null],"namespace":"sup"}') AS stable_id FROM supplier""")
def stable_ids(t):
    return t.supplier.select("s_suppkey", expr.stable_id("sup", expr.json_text(F.col("s_name"), "string"), expr.json_text(F.col("s_nationkey"), "number"), F.lit("null")).alias("stable_id"))


_MANIFEST_LINE = " || ".join(f"length({v}) || ':' || {v}" for v in ("o_orderpriority", "o_orderstatus", "CAST(o_orderkey AS VARCHAR)", "CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR)"))


@register("manifests", f"SELECT o_custkey AS manifest_id, count(*) AS entry_count, sha256(string_agg({_MANIFEST_LINE}, chr(10) ORDER BY {_MANIFEST_LINE})) AS digest FROM orders GROUP BY 1")
def manifests(t):
    return persist.manifest(t.orders.select(F.col("o_custkey").alias("manifest_id"), F.col("o_orderpriority").alias("role"), F.col("o_orderstatus").alias("logical_name"), F.col("o_orderkey").cast("string").alias("content_id"), F.floor("o_totalprice").alias("size_bytes")))


# Legacy channels: events as evidence of a name at an address.
_LEGACY = """channels AS (SELECT user_id AS address, 'Customer#' || lpad(CAST(CAST(floor(value) AS BIGINT) % 300 AS VARCHAR), 9, '0') AS name, event_type AS channel, CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'view' THEN 'context' ELSE 'supports' END AS effect, event_type || '_group' AS independence_group FROM events)"""


def _channels(t: Tables) -> DataFrame:
    return t.events.selectExpr("user_id AS address", "concat('Customer#', lpad(cast(floor(value) % 300 AS string), 9, '0')) AS name", "event_type AS channel", "CASE event_type WHEN 'error' THEN 'contradicts' WHEN 'view' THEN 'context' ELSE 'supports' END AS effect", "concat(event_type, '_group') AS independence_group")


@register("legacy_claims", f"WITH {_LEGACY} SELECT address, name, count(*) FILTER (WHERE effect = 'supports') AS supports, count(*) FILTER (WHERE effect = 'contradicts') AS contradicts, count(*) FILTER (WHERE effect = 'context') AS context, coalesce(string_agg(DISTINCT independence_group, ',' ORDER BY independence_group) FILTER (WHERE effect = 'supports'), '') AS supporting_groups FROM channels GROUP BY 1, 2")
def legacy_claims(t):
    return lookup.legacy_claims(_channels(t))


@register("legacy_ambiguity", "SELECT l.address, l.name, coalesce(n, 0) AS function_count, f AS first_function_id, CASE WHEN n = 1 THEN 'unique' WHEN n > 1 THEN 'ambiguous' ELSE 'unresolved' END AS resolution FROM (SELECT DISTINCT l_suppkey AS address, 'red widget' || l_partkey % 40 AS name FROM lineitem) l LEFT JOIN (SELECT p_name || p_size AS name, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY 1) USING (name)")
def legacy_ambiguity(t):
    claims = t.lineitem.select(F.col("l_suppkey").alias("address"), F.concat(F.lit("red widget"), (F.col("l_partkey") % 40).cast("string")).alias("name"))
    functions = t.part.select(F.concat("p_name", F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("function_id"))
    return lookup.resolved_names(claims, functions)


@register("fold_groups", "SELECT CAST(round(p_retailprice * 10) AS BIGINT) AS address, count(*) AS member_count, string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) AS members FROM part GROUP BY 1 HAVING count(*) >= 2")
def fold_groups(t):
    return decode.fold_groups(t.part.select(F.round(F.col("p_retailprice") * 10).cast("long").alias("address"), F.col("p_partkey").alias("function_id")))
