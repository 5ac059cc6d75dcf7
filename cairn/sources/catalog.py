"""An evidence graph as Parquet tables with fixed schemas: load, register, verify, publish."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

# Tables of the graph and their columns.  Columns are strings
# unless marked with :i (bigint), :d (double), :t (timestamp) or :b (binary).
COLUMNS = {
    "programs": "program_id platform name architecture image_base:i details_json",
    "provenance": "provenance_id kind producer producer_version method manifest_id parameters_json",
    "address_groups": "address_group_id program_id address_space address:i kind",
    "functions": "function_id program_id address_group_id identity_key kind type_index:i module_id symbol_record_kind",
    "function_assertions": "assertion_id function_id program_id kind type_index:i module_id symbol_record_kind provenance_id",
    "function_names": "name_id:i function_id name name_kind is_primary:i provenance_id details_json",
    "function_name_assertions": "assertion_id name_id:i is_primary:i provenance_id details_json",
    "function_signatures": "function_id program_id type_index:i resolution_status parameter_count:i argument_list_count:i is_variadic:i rendered_signature provenance_id",
    "function_signature_arguments": "function_id position:i type_index:i is_vararg_marker:i rendered_type",
    "fold_groups": "fold_group_id program_id kind provenance_id",
    "fold_group_members": "fold_group_id program_id function_id member_role",
    "classes": "class_id program_id identity_key type_index:i size_bytes:i module_id",
    "class_names": "name_id:i class_id name name_kind is_primary:i provenance_id details_json",
    "vtables": "vtable_id program_id class_id address_space address:i vfptr_role subobject_offset:i declared_slot_count:i provenance_id details_json",
    "vtable_slots": "vtable_id program_id slot_index:i target_address_group_id unresolved_target_id declared_type_index:i provenance_id",
    "vtable_slot_assertions": "assertion_id vtable_id program_id slot_index:i target_address_group_id unresolved_target_id declared_type_index:i provenance_id",
    "unresolved_targets": "target_id program_id address_group_id target_kind name_hint reason status resolved_function_id provenance_id details_json",
    "match_claims": "claim_id pc_function_id pc_target_id xbox_function_id xbox_target_id status confidence_value:d provenance_id confidence_label rationale details_json",
    "match_hypothesis_sets": "hypothesis_set_id pc_function_id pc_target_id status provenance_id identity_key rationale details_json",
    "match_hypothesis_alternatives": "alternative_id hypothesis_set_id claim_id xbox_fold_group_id details_json",
    "match_hypothesis_evidence": "evidence_id hypothesis_set_id effect evidence_kind independence_group provenance_id",
    "match_hypothesis_alternative_evidence": "evidence_id alternative_id effect evidence_kind independence_group provenance_id details_json",
    "claim_evidence": "evidence_id claim_id effect evidence_kind independence_group provenance_id",
    "review_decisions": "decision_id hypothesis_set_id alternative_id claim_id reviewer_id action decided_at:t rationale provenance_id review_release_id previous_decision_id",
    "call_edges": "edge_id program_id caller_function_id callee_function_id unresolved_target_id edge_kind provenance_id",
    "reviewers": "reviewer_id display_name kind",
    "review_releases": "review_release_id name manifest_id provenance_id",
    # source ranges and class names
    "source_files": "source_file_id normalized_path",
    "function_source_ranges": "function_id source_file_id line_start:i column_start:i line_end:i column_end:i is_primary:i provenance_id details_json",
    "function_source_range_assertions": "assertion_id function_id source_file_id line_start:i column_start:i line_end:i column_end:i is_primary:i provenance_id details_json",
    "class_name_assertions": "assertion_id name_id:i is_primary:i provenance_id details_json",
    # alignment of virtual tables
    "vtable_alignment_candidates": "alignment_id pc_vtable_id xbox_vtable_id status provenance_id",
    "vtable_slot_alignments": "slot_alignment_id alignment_id hypothesis_set_id pc_vtable_id pc_slot_index:i xbox_vtable_id xbox_slot_index:i status provenance_id",
    "vtable_alignment_issues": "issue_id issue_kind provenance_id",
    # control flow
    "control_flow_extractions": "extraction_id program_id provenance_id persistence_policy source_physical_site_count:i source_logical_use_count:i triggering_logical_use_count:i persisted_physical_site_count:i persisted_logical_use_count:i procedure_scan_count:i details_json",
    "control_flow_sites": "site_id program_id address_group_id",
    "control_flow_site_assertions": "assertion_id extraction_id program_id site_id raw_site_va:i raw_target_va:i target_kind target_address_group_id target_function_id target_fold_group_id target_record_count:i",
    "control_flow_uses": "use_id program_id procedure_record_id function_id site_id",
    "control_flow_use_assertions": "assertion_id extraction_id program_id use_id role",
    "control_flow_scans": "scan_id extraction_id program_id procedure_record_id function_id unresolved_target_id scan_address_group_id scanned_size:i source_branch_use_count:i persisted_branch_use_count:i status",
    # types
    "codeview_type_extractions": "extraction_id program_id type_namespace provenance_id raw_type_record_count:i raw_body_byte_count:i tag_record_count:i definition_count:i forward_reference_count:i tag_member_occurrence_count:i physical_field_member_count:i physical_method_overload_count:i diagnostic_count:i",
    "codeview_type_records": "type_record_id program_id type_namespace type_index:i leaf_kind:i record_length:i raw_body:b raw_body_sha256",
    "codeview_type_record_assertions": "assertion_id extraction_id program_id type_namespace type_record_id",
    "codeview_tag_layouts": "tag_layout_id extraction_id program_id type_namespace type_record_id tag_kind record_sha256 properties:i is_forward_reference:i physical_member_occurrence_count:i decoded_member_count:i",
    "codeview_field_members": "field_member_id extraction_id program_id member_kind source_field_list_type_index:i method_list_type_index:i declared_overload_count:i",
    "codeview_tag_member_uses": "member_use_id extraction_id program_id tag_layout_id field_member_id ordinal:i",
    "codeview_method_overloads": "method_overload_id extraction_id program_id method_list_type_index:i ordinal:i",
    "codeview_layout_diagnostics": "diagnostic_id extraction_id program_id tag_layout_id ordinal:i",
    # data symbols
    "data_symbol_extractions": "extraction_id program_id address_space provenance_id record_count:i resolved_record_count:i unresolved_record_count:i unique_address_count:i",
    "data_symbol_records": "data_record_id program_id source_record_id module_index:i symbol_stream:i record_offset:i",
    "data_symbol_record_assertions": "assertion_id extraction_id program_id data_record_id address_group_id resolved_va:i",
}

_KINDS = {"i": "bigint", "d": "double", "t": "timestamp", "b": "binary", "": "string"}


def schema(table: str) -> StructType:
    """The fixed schema of a table; nothing is ever inferred."""
    parts = (c.partition(":") for c in COLUMNS[table].split())
    return _parse_datatype_string(", ".join(f"{name} {_KINDS[kind]}" for name, _, kind in parts))


def fingerprint(df: DataFrame) -> str:
    """A digest of a table's column names and types; nullability doesn't count, as Parquet loses it."""
    return hashlib.sha256("\n".join(f"{n}\t{t}" for n, t in df.dtypes).encode()).hexdigest()


class Catalog:
    """A read-only graph in a folder: ``catalog.functions`` is that table as a DataFrame.

    Of a published folder the version that is current when the catalog is
    opened is read, so a reader keeps it while another is published.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.target = spark, folder.rstrip("/")
        version = _current(spark, self.target)
        self.folder = f"{self.target}/{version}" if version else self.target

    def __getattr__(self, table: str) -> DataFrame:
        if table not in COLUMNS:
            raise AttributeError(table)
        return self.spark.read.schema(schema(table)).parquet(f"{self.folder}/{table}")

    def drift(self) -> list[str]:
        """Tables that are missing or whose columns differ from the fixed schema."""
        bad = []
        for table in COLUMNS:
            try:
                found = self.spark.read.parquet(f"{self.folder}/{table}")
            except Exception as e:
                if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER" not in str(e):
                    raise
                bad.append(table)
                continue
            if fingerprint(found) != fingerprint(self.spark.createDataFrame([], schema(table))):
                bad.append(table)
        return bad

    def register(self) -> None:
        """Every table as a temporary view, for SQL."""
        for table in COLUMNS:
            getattr(self, table).createOrReplaceTempView(table)


#: The file of a published folder that names its current version.
POINTER = "CURRENT"


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


def _current(spark: SparkSession, folder: str) -> str | None:
    path, fs = _files(spark, folder)
    return spark.read.text(f"{folder}/{POINTER}").first()[0] if fs.exists(path(f"{folder}/{POINTER}")) else None


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, replace: bool = False) -> Catalog:
    """Write all tables as a new version below the folder, check them, then turn the pointer file to it in one rename.

    Readers see the old version or the new one, whole; old versions stay until
    they are removed by hand.
    """
    target = folder.rstrip("/")
    version = f"v-{uuid.uuid4().hex}"
    path, fs = _files(spark, target)
    if fs.exists(path(target)) and not replace:
        raise ValueError(f"not published: {target} exists")
    unknown = sorted(set(tables) - set(COLUMNS))
    if unknown:
        raise ValueError(f"not published: unknown tables {unknown}")
    for table in COLUMNS:
        df = tables.get(table)
        df = spark.createDataFrame([], schema(table)) if df is None else df.select(*[df[f.name].cast(f.dataType) for f in schema(table)])
        df.write.parquet(f"{target}/{version}/{table}")
    drift = Catalog(spark, f"{target}/{version}").drift()
    if drift:
        fs.delete(path(f"{target}/{version}"), True)
        raise ValueError(f"not published: drifted tables {drift}")
    hadoop = spark._jvm.org.apache.hadoop.fs
    out = fs.create(path(f"{target}/{version}/{POINTER}"))
    out.writeBytes(version + "\n")
    out.close()
    over = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    over[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    hadoop.FileContext.getFileContext(path(target).toUri(), spark._jsc.hadoopConfiguration()).rename(fs.makeQualified(path(f"{target}/{version}/{POINTER}")), fs.makeQualified(path(f"{target}/{POINTER}")), over)
    return Catalog(spark, target)
