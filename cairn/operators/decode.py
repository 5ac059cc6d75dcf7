"""Instruction words, decorated names and pointer runs, in column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.expr import U32, signed


def branches(words: DataFrame) -> DataFrame:
    """Branch instructions among (address, word): kind, target, link, absolute, conditional, indirect; other words go."""
    w, at = F.col("word"), F.col("address")
    op, low = F.shiftrightunsigned(w, 26), w.bitwiseAND(F.lit(0xFFFFFFFF))
    extended = F.shiftrightunsigned(low, 1).bitwiseAND(F.lit(0x3FF))
    link, absolute = low.bitwiseAND(F.lit(1)) == 1, low.bitwiseAND(F.lit(2)) == 2
    kind = (
        F.when(op == 18, "branch_immediate")
        .when(op == 16, "branch_conditional")
        .when((op == 19) & (extended == 16), "branch_to_link_register")
        .when((op == 19) & (extended == 528), "branch_to_count_register")
    )
    move = F.when(op == 18, signed(low.bitwiseAND(F.lit(0x03FFFFFC)), 26)).when(op == 16, signed(low.bitwiseAND(F.lit(0xFFFC)), 16))
    direct = op.isin(16, 18)
    target = F.when(direct, F.pmod(F.when(absolute, move).otherwise(at + move), F.lit(U32)))
    out = words.select("*", kind.alias("branch_kind"), target.alias("target"), link.alias("link"), (absolute & direct).alias("absolute"), (op != 18).alias("conditional"), (op == 19).alias("indirect"))
    return out.where("branch_kind IS NOT NULL")


def use_roles(uses: DataFrame) -> DataFrame:
    """``role`` of branches in a procedure (procedure_va, procedure_size)."""
    t, link, kind = F.col("target"), F.col("link"), F.col("branch_kind")
    inside = t.isNotNull() & (t >= F.col("procedure_va")) & (t < F.col("procedure_va") + F.col("procedure_size"))
    setup = t == F.pmod(F.col("address") + 4, F.lit(U32))
    role = (
        F.when((kind == "branch_immediate") & link, F.when(setup, "link_register_setup").when(inside, "local_direct_call").otherwise("direct_call"))
        .when(kind == "branch_immediate", F.when(inside, "local_branch").otherwise("tail_transfer"))
        .when((kind == "branch_conditional") & link, F.when(setup, "conditional_link_register_setup").when(inside, "local_conditional_call").otherwise("conditional_call"))
        .when(kind == "branch_conditional", F.when(inside, "local_conditional_branch").otherwise("conditional_transfer"))
        .when(kind == "branch_to_count_register", F.when(link, "indirect_call").otherwise("indirect_tail_or_switch"))
        .otherwise(F.when(link, "indirect_link_register_call").otherwise("return_or_indirect_branch"))
    )
    return uses.withColumn("role", role)


def target_kinds(sites: DataFrame, functions: DataFrame, low: int, high: int) -> DataFrame:
    """``target_kind`` of sites by what stands at the target: one procedure, several, or none inside or outside [low, high)."""
    n = functions.groupBy(F.col("address").alias("target")).agg(F.count("*").alias("n"))
    j = sites.join(n, "target", "left")
    kind = (
        F.when(F.col("target").isNull(), "indirect").when(F.col("n") == 1, "unique_procedure").when(F.col("n") > 1, "fold_group").when((F.col("target") >= low) & (F.col("target") < high), "executable_non_entry").otherwise("outside_executable")
    )
    return j.select(*sites.columns, kind.alias("target_kind"))


#: The roles that make a site worth keeping under the call-relevant policy.
CALL_RELEVANT = ("direct_call", "local_direct_call", "conditional_call", "local_conditional_call", "tail_transfer", "conditional_transfer", "indirect_call", "indirect_link_register_call")


def selected(uses: DataFrame, roles: tuple[str, ...] = CALL_RELEVANT) -> DataFrame:
    """All uses of the sites that have a use with one of the roles."""
    trigger = uses.where(F.col("role").isin(*roles)).select("site_id").distinct()
    return uses.join(trigger, "site_id", "left_semi")


def name_parts(names: DataFrame) -> DataFrame:
    """Owner, qualifier, role and template flags of decorated virtual-table names."""
    n = F.col("decorated_name")
    mark = F.lit("@@6B")
    at = F.length(n) - F.instr(F.reverse(n), F.reverse(mark)) - 2  # where the last mark begins, from 1
    has = (F.instr(n, mark) > 0) & (at >= 5)
    table = n.startswith("??_7")
    owner = F.when(table & has, n.substr(F.lit(5), at - 5))
    tail = F.when(table & has, n.substr(at + 4, F.length(n)))
    full = tail.endswith("@") & (F.length(tail) > 1)
    qualifier = F.when(tail == "@", F.lit(None)).when(full, tail.substr(F.lit(1), F.length(tail) - 1)).when(tail != "", tail)
    role = F.when(~table, "not_vftable").when(~has, "unparsed").when(tail == "@", "unqualified_vfptr_symbol").when(full, "qualified_vfptr_symbol").otherwise("unparsed")
    template = lambda c: F.coalesce(F.contains(c, F.lit("?$")), F.lit(False))
    return names.select("*", owner.alias("owner"), qualifier.alias("qualifier"), role.alias("role"), template(owner).alias("is_template_owner"), template(qualifier).alias("is_template_qualifier"))


def pointer_runs(words: DataFrame, low: int, high: int, most: int = 4096, mapped: DataFrame | None = None) -> DataFrame:
    """For each table, the words from its start that point into [low, high), up to the first that doesn't.

    words: table_id, slot_index, target; slots count from 0 without holes.
    mapped, if given: table_id and section_count, the sections that its address
    is in; a table in none, or in several, has no run.  Returns table_id,
    slot_count and termination.
    """
    text = (F.col("target") >= low) & (F.col("target") < high)
    g = words.where(F.col("slot_index") < most).groupBy("table_id").agg(F.count("*").alias("n"), F.min(F.when(~text, F.col("slot_index"))).alias("stop"))
    end = F.when(F.col("stop").isNotNull(), "first_non_text_pointer").when(F.col("n") >= most, "max_slots_reached").otherwise("mapped_section_end")
    runs = g.select("table_id", F.coalesce("stop", "n").cast("long").alias("slot_count"), end.alias("termination"))
    if mapped is None:
        return runs
    j = mapped.select("table_id", "section_count").join(runs, "table_id", "left")
    one = F.col("section_count") == 1
    end = F.when(F.col("section_count") == 0, "unmapped_table_address").when(~one, "ambiguous_table_mapping").otherwise(F.coalesce("termination", F.lit("mapped_section_end")))
    return j.select("table_id", F.when(one, F.coalesce("slot_count", F.lit(0))).otherwise(0).alias("slot_count"), end.alias("termination"))


def boundaries(tables: DataFrame, by: list[str]) -> DataFrame:
    """Tables (table_id, va, slot_count) with the next table's address and how the run stands to it."""
    nxt = F.lead("va").over(Window.partitionBy(*by).orderBy("va", "table_id"))
    out = tables.withColumn("next_va", nxt)
    far = F.col("next_va") - F.col("va")
    at = F.floor(far / 4)
    relation = (
        F.when(far.isNull(), "no_later_vftable_symbol")
        .when(far % 4 != 0, "next_vftable_symbol_unaligned")
        .when(at < F.col("slot_count"), "next_vftable_inside_pointer_run")
        .when(at == F.col("slot_count"), "next_vftable_at_pointer_run_end")
        .otherwise("next_vftable_after_pointer_run")
    )
    return out.withColumn("boundary", relation)


def fold_groups(records: DataFrame, least: int = 2) -> DataFrame:
    """Addresses with at least ``least`` records, and their members in order; none of them is chosen."""
    g = records.groupBy("address").agg(F.count("*").alias("member_count"), F.array_sort(F.collect_list("function_id")).alias("m"))
    return g.where(F.col("member_count") >= least).select("address", "member_count", F.array_join(F.transform("m", lambda x: x.cast("string")), ",").alias("members"))


def variant_disagreement(calls: DataFrame, declarations: DataFrame) -> DataFrame:
    """Calls whose variant is none of those that their name's declarations have."""
    said = declarations.groupBy("path", "name").agg(F.collect_set("variant").alias("variants"))
    return calls.join(said, ["path", "name"]).where(~F.array_contains("variants", F.col("variant"))).select(*calls.columns, F.array_join(F.array_sort("variants"), ",").alias("declared_variants"))


def scans(procedures: DataFrame, low: int, high: int) -> DataFrame:
    """Procedures (procedure_id, va, size) with what a scan of their words covers, and its status."""
    va, size = F.col("va"), F.col("size")
    mapped = va.isNotNull() & (va >= low) & (va < high)
    scanned = F.when(mapped, F.least(size - size % 4, F.lit(high) - va)).otherwise(F.lit(0))
    status = (
        F.when(va.isNull(), "unresolved_va")
        .when(~mapped, "unmapped_va")
        .when(size == 0, "empty")
        .when(va + size > high, "truncated_raw_extent")
        .when(size % 4 != 0, "unaligned_size")
        .otherwise("ok")
    )
    return procedures.select(*procedures.columns, scanned.alias("scanned_size"), (size - scanned).alias("unscanned_byte_count"), status.alias("status"))


def words_of(procedures: DataFrame) -> DataFrame:
    """The word addresses of each procedure's scanned extent: a procedure makes as many rows as it has words."""
    some = procedures.where("scanned_size >= 4")
    return some.select("procedure_id", "va", "size", F.explode(F.sequence(F.col("va"), F.col("va") + F.col("scanned_size") - 4, F.lit(4).cast("long"))).alias("address"))
