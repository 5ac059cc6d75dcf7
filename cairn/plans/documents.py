"""Lookups over a catalog as nested rows: pages of ids first, then everything about them by joins, never row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import lookup, paging
from cairn.sources.catalog import Catalog


def _listed(df: DataFrame, key: str, name: str, *columns: str) -> DataFrame:
    """One row for each key with its rows as a sorted array of structs."""
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def function_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Functions by id with address, names (primary first), signature, arguments and fold groups; one row for each."""
    f = c.functions.join(ids.select("function_id").distinct(), "function_id", "left_semi")
    names = c.function_names.withColumn("rank", 1 - F.col("is_primary"))
    out = f.join(c.address_groups.select("address_group_id", "address_space", "address"), "address_group_id", "left")
    out = out.join(c.programs.select("program_id", "platform"), "program_id", "left")
    out = out.join(c.function_signatures.select("function_id", "resolution_status", "rendered_signature"), "function_id", "left")
    for df in (
        _listed(names, "function_id", "names", "rank", "name_kind", "name"),
        _listed(c.function_signature_arguments, "function_id", "arguments", "position", "rendered_type"),
        _listed(c.fold_group_members, "function_id", "fold_groups", "fold_group_id", "member_role"),
    ):
        out = out.join(df.join(ids.select("function_id").distinct(), "function_id", "left_semi"), "function_id", "left")
    return out


def hypothesis_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Hypothesis sets by id with their alternatives and the evidence of all three scopes; a fold is one alternative."""
    keep = ids.select("hypothesis_set_id").distinct()
    a = c.match_hypothesis_alternatives.join(keep, "hypothesis_set_id", "left_semi")
    scopes = [
        ("set", c.match_hypothesis_evidence.join(keep, "hypothesis_set_id", "left_semi")),
        ("alternative", c.match_hypothesis_alternative_evidence.join(a.select("alternative_id", "hypothesis_set_id"), "alternative_id")),
        ("claim", c.claim_evidence.join(a.select("claim_id", "hypothesis_set_id"), "claim_id")),
    ]
    evidence = lookup.all_arms([(s, e.select("hypothesis_set_id", "evidence_id", "effect", "independence_group")) for s, e in scopes]).withColumnRenamed("observation_kind", "scope")
    out = c.match_hypothesis_sets.join(keep, "hypothesis_set_id", "left_semi")
    out = out.join(_listed(a, "hypothesis_set_id", "alternatives", "alternative_id", "claim_id", "xbox_fold_group_id"), "hypothesis_set_id", "left")
    return out.join(_listed(evidence, "hypothesis_set_id", "evidence", "scope", "evidence_id", "effect", "independence_group"), "hypothesis_set_id", "left")


def at_address(c: Catalog, address: int, address_space: str, limit: int = 50, offset: int = 0) -> DataFrame:
    """The functions at an address of one space, a page of them, none preferred."""
    groups = c.address_groups.where((F.col("address") == address) & (F.col("address_space") == address_space)).select("address_group_id")
    ids = paging.page(c.functions.join(groups, "address_group_id", "left_semi").select("function_id"), ["function_id"], limit, offset)
    return function_records(c, ids).join(ids, "function_id")


def by_name(c: Catalog, query: str, mode: str = "exact", platform: str = "xbox360", limit: int = 50, offset: int = 0) -> DataFrame:
    """Functions of a platform with a matching name, a page of them; several of one name all count."""
    own = c.functions.join(c.programs.where(F.col("platform") == platform).select("program_id"), "program_id", "left_semi").select("function_id")
    found = lookup.named(c.function_names, ["name"], query, mode).select("function_id").distinct().join(own, "function_id", "left_semi")
    ids = paging.page(found, ["function_id"], limit, offset)
    return function_records(c, ids).join(ids, "function_id")


def reverse_hypotheses(c: Catalog, functions: DataFrame) -> DataFrame:
    """Hypothesis sets that may lead to given Xbox functions: by claim, or by a fold that has them."""
    x = functions.select(F.col("function_id").alias("xbox_function_id"))
    claims = c.match_claims.join(x, "xbox_function_id", "left_semi").select("claim_id")
    folds = c.fold_group_members.join(functions.select("function_id"), "function_id", "left_semi").select(F.col("fold_group_id").alias("xbox_fold_group_id")).distinct()
    a = c.match_hypothesis_alternatives
    return lookup.arms([a.join(claims, "claim_id", "left_semi").select("hypothesis_set_id"), a.join(folds, "xbox_fold_group_id", "left_semi").select("hypothesis_set_id")])


def _some(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def functions_at(c: Catalog, groups: DataFrame, most: int) -> DataFrame:
    """address_group_id, total, functions: the first ``most`` function ids at each address, in order, and how many there are.

    Each group is ranked before it is gathered, so a list is never longer than ``most``.
    """
    f = _some(c.functions.select("address_group_id", "function_id"), groups, "address_group_id")
    total = f.groupBy("address_group_id").agg(F.count("*").alias("total"))
    first = paging.page_per_parent(f, ["address_group_id"], ["function_id"], most)
    return total.join(_listed(first, "address_group_id", "functions", "function_id"), "address_group_id", "left")


def slot_records(c: Catalog, slots: DataFrame, most: int = 50) -> DataFrame:
    """Slots (vtable_id, slot_index) with their address, the functions there and the unresolved target."""
    own = c.vtable_slots.join(slots.select("vtable_id", "slot_index").distinct(), ["vtable_id", "slot_index"], "left_semi")
    at = functions_at(c, own.select(F.col("target_address_group_id").alias("address_group_id")), most).withColumnRenamed("address_group_id", "target_address_group_id")
    groups = c.address_groups.select(F.col("address_group_id").alias("target_address_group_id"), F.col("address_space").alias("target_space"), F.col("address").alias("target_address"))
    targets = c.unresolved_targets.select(F.col("target_id").alias("unresolved_target_id"), "name_hint", F.col("status").alias("target_status"))
    return own.join(groups, "target_address_group_id", "left").join(at, "target_address_group_id", "left").join(targets, "unresolved_target_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def slots_to(c: Catalog, groups: DataFrame) -> DataFrame:
    """vtable_id, slot_index of the slots that lead to given address groups."""
    return c.vtable_slots.join(groups.select(F.col("address_group_id").alias("target_address_group_id")).distinct(), "target_address_group_id", "left_semi").select("vtable_id", "slot_index")


def class_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Classes by id with their names, primary first, and their tables, the primary one first, then secondary by offset, then the others, each with its partners in alignments."""
    k = _some(c.classes, ids, "class_id").join(c.programs.select("program_id", "platform"), "program_id", "left")
    names = _some(c.class_names, ids, "class_id").withColumn("rank", 1 - F.col("is_primary"))
    tables = _some(c.vtables, ids, "class_id")
    rank = F.when(F.col("vfptr_role") == "primary", 0).when(F.col("vfptr_role") == "secondary", 1).otherwise(2)
    n = c.vtable_slots.groupBy("vtable_id").agg(F.count("*").alias("slot_count"))
    a = c.vtable_alignment_candidates
    partner = a.select(F.col("pc_vtable_id").alias("vtable_id"), F.col("xbox_vtable_id").alias("partner")).unionByName(a.select(F.col("xbox_vtable_id").alias("vtable_id"), F.col("pc_vtable_id").alias("partner")))
    partners = _some(partner, tables, "vtable_id").groupBy("vtable_id").agg(F.array_sort(F.collect_set("partner")).alias("partners"))
    tables = tables.withColumn("rank", rank).join(n, "vtable_id", "left").join(partners, "vtable_id", "left").withColumn("slot_count", F.coalesce("slot_count", F.lit(0)))
    out = k.join(_listed(names, "class_id", "names", "rank", "name_kind", "name"), "class_id", "left")
    return out.join(_listed(tables, "class_id", "tables", "rank", "subobject_offset", "vtable_id", "vfptr_role", "address", "slot_count", "partners"), "class_id", "left")


def classes_named(c: Catalog, query: str, mode: str = "exact", platform: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Classes with a matching name, a page of them."""
    found = lookup.named(c.class_names, ["name"], query, mode).select("class_id").distinct()
    if platform:
        own = c.classes.join(c.programs.where(F.col("platform") == platform).select("program_id"), "program_id", "left_semi")
        found = found.join(own.select("class_id"), "class_id", "left_semi")
    ids = paging.page(found, ["class_id"], limit, offset)
    return class_records(c, ids).join(ids, "class_id")


def endpoints_of(assertions: DataFrame) -> DataFrame:
    """Site assertions with ``endpoint``: the function, the fold, the bare address, or nothing for an indirect target."""
    kind = F.col("target_kind")
    named = F.when(kind == "unique_procedure", F.struct(F.lit("function").alias("kind"), F.col("target_function_id").alias("id")))
    named = named.when(kind == "fold_group", F.struct(F.lit("fold_group").alias("kind"), F.col("target_fold_group_id").alias("id")))
    named = named.when(kind != "indirect", F.struct(F.lit("address_only").alias("kind"), F.col("target_address_group_id").alias("id")))
    return assertions.withColumn("endpoint", named)


def site_records(c: Catalog, ids: DataFrame, most: int = 50) -> DataFrame:
    """Flow sites by id with their address and the first ``most`` assertions of all extractions, each with its endpoint, and how many there are."""
    sites = _some(c.control_flow_sites, ids, "site_id").join(c.address_groups.select("address_group_id", "address_space", "address"), "address_group_id", "left")
    own = endpoints_of(_some(c.control_flow_site_assertions, ids, "site_id"))
    total = own.groupBy("site_id").agg(F.count("*").alias("total"))
    first = paging.page_per_parent(own, ["site_id"], ["extraction_id", "assertion_id"], most)
    return sites.join(total, "site_id", "left").join(_listed(first, "site_id", "assertions", "extraction_id", "assertion_id", "target_kind", "endpoint"), "site_id", "left").withColumn("total", F.coalesce("total", F.lit(0)))


def flow_of(c: Catalog, functions: DataFrame) -> DataFrame:
    """Uses of sites in given functions, each role with what the same extraction saw at the site."""
    uses = c.control_flow_uses.join(functions.select("function_id").distinct(), "function_id", "left_semi")
    own = c.control_flow_use_assertions.select("extraction_id", "program_id", "use_id", "role").join(uses, ["use_id", "program_id"])
    seen = endpoints_of(c.control_flow_site_assertions).select("extraction_id", "program_id", "site_id", "target_kind", "endpoint")
    return own.join(seen, ["extraction_id", "program_id", "site_id"], "left")


def tag_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Class layouts by id with their members in order, the overloads of each method list, and their diagnostics."""
    tags = _some(c.codeview_tag_layouts, ids, "tag_layout_id")
    uses = _some(c.codeview_tag_member_uses.select("tag_layout_id", "field_member_id", "ordinal"), ids, "tag_layout_id")
    overloads = c.codeview_method_overloads.groupBy("extraction_id", "program_id", "method_list_type_index").agg(F.count("*").alias("overload_count"))
    members = uses.join(c.codeview_field_members, "field_member_id").join(overloads, ["extraction_id", "program_id", "method_list_type_index"], "left")
    out = tags.join(_listed(members, "tag_layout_id", "members", "ordinal", "field_member_id", "member_kind", "overload_count"), "tag_layout_id", "left")
    return out.join(_listed(_some(c.codeview_layout_diagnostics, ids, "tag_layout_id"), "tag_layout_id", "diagnostics", "ordinal", "diagnostic_id"), "tag_layout_id", "left")


def type_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Type records by id, their bytes as lower-case hex, with the extractions that assert them."""
    own = _some(c.codeview_type_records, ids, "type_record_id").withColumn("raw_body", F.lower(F.hex("raw_body")))
    return own.join(_listed(_some(c.codeview_type_record_assertions, ids, "type_record_id"), "type_record_id", "assertions", "extraction_id", "assertion_id"), "type_record_id", "left")


def data_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Data symbols by id with where each extraction resolves them."""
    a = _some(c.data_symbol_record_assertions, ids, "data_record_id").join(c.address_groups.select("address_group_id", "address_space", "address"), "address_group_id", "left")
    return _some(c.data_symbol_records, ids, "data_record_id").join(_listed(a, "data_record_id", "assertions", "extraction_id", "assertion_id", "address_space", "address"), "data_record_id", "left")


def target_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """Unresolved targets by id with their platform and address, which may lack."""
    t = _some(c.unresolved_targets, ids, "target_id").join(c.programs.select("program_id", "platform"), "program_id")
    return t.join(c.address_groups.select("address_group_id", "address_space", "address"), "address_group_id", "left")


def source_records(c: Catalog, ids: DataFrame) -> DataFrame:
    """function_id and its source ranges in order, primary first."""
    r = _some(c.function_source_ranges, ids, "function_id").join(c.source_files, "source_file_id").withColumn("rank", 1 - F.col("is_primary"))
    return _listed(r, "function_id", "sources", "rank", "normalized_path", "line_start", "column_start", "line_end", "column_end")


def review_records(c: Catalog, ids: DataFrame, kind: str) -> DataFrame:
    """Current decisions of targets of a kind (hypothesis_set_id, alternative_id or claim_id), with reviewer and release; all reviewers count."""
    d = c.review_decisions
    leaves = d.join(d.select(F.col("previous_decision_id").alias("decision_id")).where("decision_id IS NOT NULL"), "decision_id", "left_anti")
    out = _some(leaves, ids, kind).join(c.reviewers, "reviewer_id").join(c.review_releases.select("review_release_id", F.col("name").alias("release_name")), "review_release_id", "left")
    return out.select(kind, "decision_id", "reviewer_id", "display_name", "action", "decided_at", "review_release_id", "release_name")
