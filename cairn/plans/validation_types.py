"""Named checks of type records, class layouts and data symbols."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import checks
from cairn.plans.validation import check
from cairn.plans.validation_flow import identity_tables, match_tables

NAMESPACE = "global-tpi"
#: Leaf kinds of records.
LEAVES = {"class": 5380, "structure": 5381, "union": 5382, "enum": 5383}
FIELD_LIST, METHOD_LIST = 4611, 4614
#: Fixed value: the bit of a tag's properties that marks a forward reference.
FORWARD = 128


@check
def codeview_type_extraction_summary_mismatch(c):
    raw = c.codeview_type_record_assertions.join(c.codeview_type_records.select("type_record_id", F.length("raw_body").alias("bytes")), "type_record_id", "left")
    n = lambda df, **what: df.groupBy("extraction_id").agg(*[v.alias(k) for k, v in what.items()])
    rows = F.count(F.lit(1))
    parts = {
        "raw_type_record_count": n(raw, raw_type_record_count=rows, raw_body_byte_count=F.sum("bytes")),
        "tag_record_count": n(c.codeview_tag_layouts, tag_record_count=rows, definition_count=F.count_if(F.col("is_forward_reference") == 0), forward_reference_count=F.count_if(F.col("is_forward_reference") == 1)),
        "tag_member_occurrence_count": n(c.codeview_tag_member_uses, tag_member_occurrence_count=rows),
        "physical_field_member_count": n(c.codeview_field_members, physical_field_member_count=rows),
        "physical_method_overload_count": n(c.codeview_method_overloads, physical_method_overload_count=rows),
        "diagnostic_count": n(c.codeview_layout_diagnostics, diagnostic_count=rows),
    }
    j, bad = c.codeview_type_extractions, []
    for df in parts.values():
        for name in df.columns[1:]:
            df = df.withColumnRenamed(name, f"_{name}")
            bad.append(F.col(name) != F.coalesce(f"_{name}", F.lit(0)))
        j = j.join(df, "extraction_id", "left")
    return j.where(reduce(lambda a, b: a | b, bad)).select(*c.codeview_type_extractions.columns)


@check
def codeview_type_record_integrity_mismatch(c):
    whole = (F.col("record_length") == F.length("raw_body") + 2) & F.sha2("raw_body", 256).eqNullSafe(F.col("raw_body_sha256"))
    return c.codeview_type_records.where(~F.coalesce(whole, F.lit(False)))


@check
def codeview_type_records_without_assertions(c):
    return checks.not_in(c.codeview_type_records.select("type_record_id"), c.codeview_type_record_assertions.select("type_record_id"))


def _same(rows: DataFrame, key: str, arms: list[tuple[DataFrame, dict[str, str], list[str]]]) -> DataFrame:
    """Keys of rows that one of their parents isn't there for, or is unlike."""
    return checks.any_of([checks.unlike(rows, parent, keys, same).select(key) for parent, keys, same in arms], key)


_EXTRACTION, _RECORD = {"extraction_id": "extraction_id"}, {"type_record_id": "type_record_id"}


@check
def codeview_type_assertion_identity_mismatch(c):
    same = ["program_id", "type_namespace"]
    return _same(c.codeview_type_record_assertions, "assertion_id", [(c.codeview_type_extractions, _EXTRACTION, same), (c.codeview_type_records, _RECORD, same)])


@check
def codeview_tag_record_identity_mismatch(c):
    kind = F.coalesce(*[F.when(F.col("tag_kind") == name, F.lit(leaf)) for name, leaf in LEAVES.items()])
    tags = c.codeview_tag_layouts.withColumn("leaf_kind", kind.cast("long"))
    low, high = F.lpad(F.hex(F.col("leaf_kind") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("leaf_kind") / 256)), 2, "0")
    records = c.codeview_type_records.withColumn("record_sha256", F.sha2(F.concat(F.unhex(F.concat(low, high)), F.col("raw_body")), 256))
    same = ["program_id", "type_namespace"]
    arms = [(c.codeview_type_extractions, _EXTRACTION, same), (records, _RECORD, [*same, "leaf_kind", "record_sha256"]), (c.codeview_type_record_assertions, _EXTRACTION | _RECORD, [])]
    flag = tags.where(f"is_forward_reference <> CAST((properties & {FORWARD}) <> 0 AS bigint)").select("tag_layout_id")
    return _same(tags, "tag_layout_id", arms).unionByName(flag).distinct()


@check
def codeview_tag_member_shape_mismatch(c):
    members = c.codeview_field_members.select("field_member_id", F.when(F.col("member_kind") == "overloaded_method", F.coalesce("declared_overload_count", F.lit(0))).when(F.col("member_kind") == "continuation", 0).otherwise(1).alias("decoded"))
    n = c.codeview_tag_member_uses.join(members, "field_member_id", "left").groupBy("tag_layout_id").agg(F.count("*").alias("physical"), F.min("ordinal").alias("lo"), F.max("ordinal").alias("hi"), F.sum(F.coalesce("decoded", F.lit(0))).alias("decoded"))
    j = c.codeview_tag_layouts.join(n, "tag_layout_id", "left").na.fill(0, ["physical", "decoded"])
    return j.where("physical_member_occurrence_count <> physical OR decoded_member_count <> decoded OR (physical > 0 AND (lo <> 0 OR hi <> physical - 1)) OR (is_forward_reference = 1 AND physical <> 0)")


def _lists(c, leaf: int, name: str) -> DataFrame:
    """extraction_id, program_id and type index (as ``name``) of asserted records of one leaf kind."""
    r = c.codeview_type_records.where(f"leaf_kind = {leaf} AND type_namespace = '{NAMESPACE}'").select("type_record_id", "program_id", F.col("type_index").alias(name))
    return c.codeview_type_record_assertions.where(f"type_namespace = '{NAMESPACE}'").join(r, ["type_record_id", "program_id"])


@check
def codeview_field_member_identity_mismatch(c):
    m, own = c.codeview_field_members, ["extraction_id", "program_id"]
    arms = [checks.unlike(m, c.codeview_type_extractions, _EXTRACTION, ["program_id"]), checks.orphans(m, c.codeview_tag_member_uses, [*own, "field_member_id"]), checks.orphans(m, _lists(c, FIELD_LIST, "source_field_list_type_index"), [*own, "source_field_list_type_index"])]
    return checks.any_of([a.select("field_member_id") for a in arms], "field_member_id")


@check
def codeview_tag_member_identity_mismatch(c):
    both = ["extraction_id", "program_id"]
    return _same(c.codeview_tag_member_uses, "member_use_id", [(c.codeview_type_extractions, _EXTRACTION, ["program_id"]), (c.codeview_tag_layouts, {"tag_layout_id": "tag_layout_id"}, both), (c.codeview_field_members, {"field_member_id": "field_member_id"}, both)])


@check
def codeview_method_overload_identity_mismatch(c):
    by = ["extraction_id", "program_id", "method_list_type_index"]
    lists = c.codeview_method_overloads.select(*by).distinct()
    arms = [checks.unlike(lists, c.codeview_type_extractions, _EXTRACTION, ["program_id"]), checks.broken_order(c.codeview_method_overloads, by, "ordinal"), checks.orphans(lists, c.codeview_field_members, by), checks.orphans(lists, _lists(c, METHOD_LIST, "method_list_type_index"), by)]
    return reduce(DataFrame.unionByName, [a.select(*by) for a in arms]).distinct()


@check
def codeview_layout_diagnostic_identity_mismatch(c):
    by = ["extraction_id", "program_id", "tag_layout_id"]
    d = c.codeview_layout_diagnostics.select(*by).distinct()
    arms = [checks.unlike(d, c.codeview_type_extractions, _EXTRACTION, ["program_id"]), checks.unlike(d, c.codeview_tag_layouts, {"tag_layout_id": "tag_layout_id"}, ["extraction_id", "program_id"]), checks.broken_order(c.codeview_layout_diagnostics, by, "ordinal")]
    return reduce(DataFrame.unionByName, [a.select(*by) for a in arms]).distinct()


@check
def codeview_type_non_xbox_identity(c):
    xbox = c.programs.where("platform = 'xbox360'")
    tables = [c.codeview_type_extractions, c.codeview_type_records, c.codeview_type_record_assertions, c.codeview_tag_layouts, c.codeview_field_members, c.codeview_tag_member_uses, c.codeview_method_overloads, c.codeview_layout_diagnostics]
    arms = [checks.orphans(t, xbox, ["program_id"]).select(t.columns[0]) for t in tables]
    arms += [t.where(f"NOT (type_namespace <=> '{NAMESPACE}')").select(t.columns[0]) for t in tables[:4]]
    return checks.any_of(arms, "row_id")


@check
def data_symbol_extraction_summary_mismatch(c):
    at = F.col("address_group_id")
    return checks.summary_mismatch(c.data_symbol_extractions, c.data_symbol_record_assertions, "extraction_id", {"record_count": F.count("*"), "resolved_record_count": F.count(at), "unresolved_record_count": F.count_if(at.isNull()), "unique_address_count": F.count_distinct(at)})


@check
def data_symbol_records_without_assertions(c):
    return checks.not_in(c.data_symbol_records.select("data_record_id"), c.data_symbol_record_assertions.select("data_record_id"))


@check
def data_symbol_record_identity_mismatch(c):
    return checks.id_format(c.data_symbol_records, "source_record_id", "x360-data:m%04d:s%04d:o%08X", "module_index", "symbol_stream", "record_offset")


@check
def data_symbol_assertion_identity_mismatch(c):
    return _same(c.data_symbol_record_assertions, "assertion_id", [(c.data_symbol_extractions, _EXTRACTION, ["program_id"]), (c.data_symbol_records, {"data_record_id": "data_record_id"}, ["program_id"])])


@check
def data_symbol_non_xbox_addressing(c):
    xbox = c.programs.where("platform = 'xbox360'")
    a = c.data_symbol_record_assertions
    groups = c.address_groups.where("address_space = 'xbox-va' AND address BETWEEN 0 AND 4294967295").withColumn("resolved_va", F.col("address"))
    arms = [checks.orphans(t, xbox, ["program_id"]).select(t.columns[0]) for t in (c.data_symbol_extractions, c.data_symbol_records, a)]
    arms += [c.data_symbol_extractions.where("NOT (address_space <=> 'xbox-va')").select("extraction_id"), a.where("(resolved_va IS NULL) <> (address_group_id IS NULL)").select("assertion_id")]
    arms.append(checks.unlike(a.where("address_group_id IS NOT NULL"), groups, {"address_group_id": "address_group_id"}, ["program_id", "resolved_va"]).select("assertion_id"))
    return checks.any_of(arms, "row_id")


def _producers(c) -> DataFrame:
    return c.codeview_type_extractions.select("provenance_id").unionByName(c.data_symbol_extractions.select("provenance_id"))


@check
def type_data_provenance_created_function_or_name(c):
    return checks.written_by(identity_tables(c), _producers(c))


@check
def type_data_provenance_created_match_state(c):
    return checks.written_by(match_tables(c, "match_hypothesis_alternative_evidence"), _producers(c))
