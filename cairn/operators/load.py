"""Loads of many tables at once: all rows of an extraction, or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.sources.catalog import COLUMNS, schema
from cairn.sources.staging import written
from cairn.sources.store import Version, commit

# Keys of several columns; every other table's key is its first column.
KEYS = {
    "function_signature_arguments": "function_id position",
    "fold_group_members": "fold_group_id function_id",
    "vtable_slots": "vtable_id slot_index",
    "function_source_ranges": "function_id source_file_id line_start column_start",
}
# What of a row its key stands for, where the rest may be said anew by a later producer.  In every
# other table the whole row is what the key stands for; producers that differ have assertions of their own.
IDENTITY = {
    "programs": "platform",
    "source_files": "normalized_path",
    "address_groups": "program_id address_space address",
    "functions": "program_id address_group_id identity_key",
    "function_names": "function_id name name_kind",
    "function_signatures": "program_id type_index",
    "fold_groups": "program_id",
    "classes": "program_id identity_key",
    "class_names": "class_id name name_kind",
    "vtables": "program_id class_id address_space address vfptr_role",
    "vtable_slots": "program_id",
    "unresolved_targets": "program_id address_group_id target_kind name_hint",
    "match_claims": "pc_function_id pc_target_id xbox_function_id xbox_target_id provenance_id",
    "match_hypothesis_sets": "pc_function_id pc_target_id provenance_id identity_key",
    "match_hypothesis_alternatives": "hypothesis_set_id claim_id xbox_fold_group_id",
    "vtable_alignment_candidates": "pc_vtable_id xbox_vtable_id provenance_id",
    "vtable_slot_alignments": "alignment_id pc_vtable_id pc_slot_index xbox_vtable_id xbox_slot_index hypothesis_set_id provenance_id",
    "reviewers": "",
}
# Which table a column that ends so refers to.
REFERS = {
    "program_id": "programs", "provenance_id": "provenance", "address_group_id": "address_groups", "function_id": "functions", "class_id": "classes", "vtable_id": "vtables",
    "fold_group_id": "fold_groups", "target_id": "unresolved_targets", "claim_id": "match_claims", "hypothesis_set_id": "match_hypothesis_sets", "alternative_id": "match_hypothesis_alternatives",
    "reviewer_id": "reviewers", "review_release_id": "review_releases", "source_file_id": "source_files", "alignment_id": "vtable_alignment_candidates", "site_id": "control_flow_sites", "use_id": "control_flow_uses",
    "type_record_id": "codeview_type_records", "tag_layout_id": "codeview_tag_layouts", "field_member_id": "codeview_field_members", "data_record_id": "data_symbol_records", "previous_decision_id": "review_decisions",
}
_EXTRACTIONS = {"control_flow": "control_flow_extractions", "codeview": "codeview_type_extractions", "data_symbol": "data_symbol_extractions"}


class Refused(ValueError):
    """A load that would break an identity or a reference; nothing of it was published."""


def columns(table: str) -> list[str]:
    return [c.partition(":")[0] for c in COLUMNS[table].split()]


def key_of(table: str) -> list[str]:
    return KEYS.get(table, columns(table)[0]).split()


def identity_of(table: str) -> list[str]:
    """Columns besides the key that a key stands for."""
    return IDENTITY[table].split() if table in IDENTITY else [c for c in columns(table) if c not in key_of(table)]


def parents(table: str) -> dict[str, tuple[str, str]]:
    """Each column that refers to a table, with that table and its key."""
    own, found = key_of(table) if len(key_of(table)) == 1 else [], {}
    for c in columns(table):
        to = next((REFERS[k] for k in sorted(REFERS, key=len, reverse=True) if c == k or c.endswith(f"_{k}")), None)
        if c == "extraction_id":
            to = next(v for k, v in _EXTRACTIONS.items() if table.startswith(k))
        if to and c not in own:
            found[c] = (to, key_of(to)[0])
    return found


def _said(table: str, problem: str, key: Column) -> list[Column]:
    return [F.lit(table).alias("table_name"), F.lit(problem).alias("problem"), key.alias("key")]


def _text(names: list[str]) -> Column:
    return F.concat_ws("/", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names])


def _none(base, table: str) -> bool:
    """Whether a version is known to have no rows of a table."""
    return table not in getattr(base, "parts", {table: 0})


def problems(base: Version, staged: dict[str, DataFrame]) -> DataFrame:
    """table_name, problem, key: what speaks against adding ``staged`` to ``base``.

    null_key; conflicting_rows, where one key comes with two identities (or, in
    tables whose rows are immutable, two contents); identity_conflict, where it
    is there already with another, nulls equal to nulls; dangling_<column>,
    where what it refers to is neither there nor staged.  Each is a grouped
    count or an equality join on the staged rows; all are one job.
    """
    out, children = [], {}
    for table, df in staged.items():
        key, same = key_of(table), identity_of(table)
        out.append(df.where(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])).select(*_said(table, "null_key", _text(key))))
        for c, (to, to_key) in parents(table).items():
            child = df.where(F.col(c).isNotNull()).select(F.lit(table).alias("table_name"), F.lit(f"dangling_{c}").alias("problem"), F.col(c).cast("string").alias("key")).distinct()
            children.setdefault((to, to_key), []).append(child)
        if not same:
            continue
        whole = F.struct(*same)
        # staged rows and those that are there already, in one grouping: two contents of the staged ones, or of one of each
        rows = df.select(*key, whole.alias("_w"), F.lit(True).alias("_new"))
        if not _none(base, table):
            rows = rows.unionByName(getattr(base, table).join(df.select(*key).distinct(), key, "left_semi").select(*key, whole.alias("_w"), F.lit(False).alias("_new")))
        mine = F.when(F.col("_new"), F.col("_w"))
        g = rows.groupBy(*key).agg(F.min("_w").alias("a"), F.max("_w").alias("b"), F.min(mine).alias("c"), F.max(mine).alias("d")).where(~F.col("a").eqNullSafe(F.col("b")))
        out.append(g.select(*_said(table, "", _text(key))[:1], F.when(F.col("c").eqNullSafe(F.col("d")), "identity_conflict").otherwise("conflicting_rows").alias("problem"), _text(key).alias("key")))
    for (to, to_key), parts in children.items():
        there = [df.select(F.col(to_key).cast("string").alias("key")) for df in ([staged[to]] if to in staged else []) + ([] if _none(base, to) else [getattr(base, to)])]
        some = reduce(DataFrame.unionByName, parts)
        out.append(some.join(reduce(DataFrame.unionByName, there), "key", "left_anti").select("table_name", "problem", "key") if there else some)
    return reduce(DataFrame.unionByName, out)


def load(base: Version, rows: dict[str, DataFrame], check_references: bool = True) -> Version:
    """Add the rows of several tables to a graph as its next version, or none of them.

    Rows that are there already, and repeats, add nothing; a load that adds and
    changes nothing gives ``base`` itself, so a replay makes no version.  A key
    with another identity anywhere refuses the whole load with Refused, which
    names up to twenty problems.  A row with the same identity and other values
    elsewhere replaces the old row; of several staged for one key the greatest
    counts.  Two producers of one thing share its row and add assertions each.
    Missing columns are null; other columns are an error.

    Plan.  Staged tables are written once.  Checks run as one job, and another
    one tells which tables have additions, which are anti joins on the key,
    and changes; only a table with changed rows is written anew, the others
    grow by a folder.
    """
    unknown = [t for t in rows if t not in COLUMNS] + [f"{t}.{c}" for t, df in rows.items() if t in COLUMNS for c in df.columns if c not in columns(t)]
    if unknown:
        raise Refused(f"unknown tables or columns: {', '.join(sorted(unknown))}")
    fill = lambda t, df: df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema(t)])
    staged = {t: written(fill(t, df), "staged") for t, df in rows.items()}
    if not staged:
        return base
    found = problems(base, staged)
    if not check_references:
        found = found.where(~F.col("problem").startswith("dangling_"))
    bad = found.limit(20).collect()
    if bad:
        raise Refused("; ".join(sorted(f"{r['table_name']} {r['problem']} {r['key']}" for r in bad)))
    new, changed, counts = {}, {}, []
    for table, df in staged.items():
        key = key_of(table)
        rest = [c for c in columns(table) if c not in key]
        one = df.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_r")).select(*key, "_r.*")
        new[table] = one if _none(base, table) else one.join(getattr(base, table).select(key), key, "left_anti")
        counts.append(new[table].select(F.lit(table).alias("t"), F.lit(False).alias("c")))
        if table in IDENTITY and not _none(base, table):
            was = getattr(base, table).select(*key, *[F.col(c).alias(f"_{c}") for c in rest])
            changed[table] = one.join(was, key).where(reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in rest])).select(one.columns)
            counts.append(changed[table].select(F.lit(table).alias("t"), F.lit(True).alias("c")))
    there = {(r["t"], r["c"]) for r in reduce(DataFrame.unionByName, counts).distinct().collect()}  # two rows a table at most
    added = {t: df for t, df in new.items() if (t, False) in there and (t, True) not in there}
    replaced = {}
    for t in (t for t, c in there if c):
        old = getattr(base, t)
        replaced[t] = old.join(changed[t].select(key_of(t)), key_of(t), "left_anti").unionByName(changed[t].select(old.columns)).unionByName(new[t].select(old.columns))
    return commit(base, added, replaced) if added or replaced else base
