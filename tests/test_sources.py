"""JSON documents, file trees, stored bytes, rules and sinks, each on a small example."""

import hashlib
import json
import struct

import pytest
from pyspark.sql import functions as F

from cairn.functions import binary
from cairn.operators import persist, review, rules
from cairn.sources import documents


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def texts(spark, *docs):
    return spark.createDataFrame([(json.dumps(d),) for d in docs], "text string")


def test_inventory(spark, tmp_path):
    doc = {"image_base": "0x400000", "functions": {"0x401000": {"name": "a", "size": 8, "callees": ["0x402000", "0x402000", "4198400", "0x500000", "0x401004"]}, "0x402000": {"name": None, "thunk": True}}}
    (tmp_path / "inventory.json").write_text(json.dumps(doc, indent=1))
    code = spark.createDataFrame([(0x401000, 0x403000)], "lo long, hi long")
    functions, callees = documents.inventory(documents.texts(spark, str(tmp_path)), code)
    assert rows(functions, "address", "name", "size", "thunk", "in_executable") == [(0x401000, "a", 8, False, True), (0x402000, "", 0, True, True)]
    assert rows(callees) == [(0x401000, 0x401000, "entry"), (0x401000, 0x401004, "executable_non_entry"), (0x401000, 0x402000, "entry"), (0x401000, 0x500000, "outside_executable")]
    twice = texts(spark, {"functions": {"0x10": {}, "16": {}}})
    assert rows(documents.duplicates(documents.inventory(twice, code)[0])) == [(16, 2)]


def test_virtual_tables(spark):
    pc = texts(spark, {"classes": {"Actor": [{"rtti_name": "r", "vtable_va": "0x10", "col_va": "0x20", "offset": 0, "slots": ["0x1", "0x1"]}, {"rtti_name": "r", "vtable_va": "0x30", "col_va": "0x40", "offset": 8, "slots": []}]}})
    tables, slots = documents.pc_tables(pc)
    assert rows(tables, "table_index", "address", "vfptr_role", "subobject_offset", "slot_count") == [(0, 16, "primary", 0, 2), (1, 48, "secondary", 8, 0)]
    assert rows(slots, "table_index", "slot_index", "target") == [(0, 0, 1), (0, 1, 1)]
    xbox, targets = documents.xbox_tables(texts(spark, {"Actor": [{"symbol": "??_7Actor@@6B@", "vtable_va": "0x82000000", "slots": [{"va": "0x5", "name": "n"}]}]}))
    assert rows(xbox, "decorated_name", "address", "slot_count") == [("??_7Actor@@6B@", 0x82000000, 1)] and rows(targets, "target", "raw_name") == [(5, "n")]
    bases, virtuals = documents.layouts(texts(spark, {"A": {"bases": [{"name": "B", "offset": 4}], "virtuals": [{"name": "f", "kind": "intro", "slot": 0}]}}))
    assert rows(bases) == [("A", 0, "B", 4)] and rows(virtuals) == [("A", 0, "f", "intro", 0)]


def test_source_lines_and_modules(spark):
    functions = spark.createDataFrame([("f1", 0x82001000, "n"), ("f2", 0x82001000, "n"), ("f3", 0x82001000, "m")], "function_id string, address long, name string")
    doc = {"82001000": {"name": "n", "file": "d:\\src\\a.cpp", "line": -3}, "0x82002000": {"name": "n", "file": "x", "line": 1}, "0x82001000": {"name": "", "file": "x", "line": 1}}
    assert rows(documents.source_lines(texts(spark, doc), functions)) == [("f1", "d:/src/a.cpp", 0), ("f2", "d:/src/a.cpp", 0)]
    assert rows(documents.module_map(texts(spark, {"0": "a.obj", "12": "b.obj"}))) == [(0, "a.obj"), (12, "b.obj")]


def test_source_trees(spark, tmp_path):
    files = {"b/Z.cpp": b"int z;", "a.H": b"", "b/.git/x.c": b"no", "notes.txt": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    found = documents.source_files(spark, str(tmp_path))
    want = sorted((n, hashlib.sha256(files[n]).hexdigest(), len(files[n])) for n in ("b/Z.cpp", "a.H"))
    assert rows(found) == want
    digest = hashlib.sha256()
    for name, sha, size in sorted(want, key=lambda x: x[0].casefold()):
        digest.update(struct.pack(">I", len(name)) + name.encode() + struct.pack(">Q", size) + bytes.fromhex(sha))
    out = binary.tree_digests(found.withColumn("tree", F.lit(1)), ["tree"]).first()
    assert out["tree_sha256"] == f"sha256:{digest.hexdigest()}" and out["file_count"] == 2
    clash = spark.createDataFrame([(1, "A.c", 0, "00"), (1, "a.c", 0, "00")], "tree long, relative_path string, byte_length long, sha256 string")
    assert binary.tree_digests(clash, ["tree"]).first()["collisions"] == 1
    (tmp_path / "art").mkdir()
    (tmp_path / "art/x.bin").write_bytes(b"abc")
    assert rows(documents.artifacts(spark, str(tmp_path / "art")), "content_id", "size_bytes") == [("sha256:" + hashlib.sha256(b"abc").hexdigest(), 3)]


def test_stored_bytes(spark):
    name = b"??_7A@@6B@"
    body = struct.pack("<HIIH", 0x110E, 2, 0x1234, 3) + name + b"\0\0"
    raw = struct.pack("<H", len(body)) + body
    cases = [(bytearray(raw), len(body), 0x110E, 2, 0x1234, 3, bytearray(name)), (bytearray(raw), len(body), 0x110E, 2, 0x1235, 3, bytearray(name)), (bytearray(raw), len(body), 0x110E, 2, 0x1234, 3, bytearray(name[:-1])), (None, 1, 1, 1, 1, 1, None), (bytearray(raw), len(body), -1, 2, 0x1234, 3, bytearray(name))]
    df = spark.createDataFrame(cases, "raw binary, n long, kind long, flags long, off long, sec long, name binary")
    assert [r[0] for r in df.select(binary.public_record_matches(*[F.col(c) for c in df.columns])).collect()] == [True, False, False, False, False]
    words = spark.createDataFrame([(bytearray(b"\x82\x00\x10\x00"), 0x82001000), (bytearray(b"\x00\x01"), 1), (bytearray(b"\x00\x00\x00\x01"), -1), (None, 1)], "raw binary, v long")
    assert [r[0] for r in words.select(binary.big_endian_matches(F.col("raw"), F.col("v"))).collect()] == [True, False, False, False]
    df = spark.createDataFrame([(5380, bytearray(b"xy")), (70000, bytearray(b"xy"))], "leaf long, body binary")
    assert [r[0] for r in df.select(binary.record_digest(F.col("leaf"), F.col("body"))).collect()] == [hashlib.sha256(struct.pack("<H", 5380) + b"xy").hexdigest(), None]
    df = spark.createDataFrame([("aé",), ("€",), (None,)], "t string")
    assert [r[0] and bytes(r[0]) for r in df.select(binary.latin1(F.col("t"))).collect()] == ["aé".encode("latin-1"), None, None]
    assert [r[0] for r in spark.createDataFrame([("Straße",), (None,)], "t string").select(binary.casefold(F.col("t"))).collect()] == ["strasse", None]


def test_platform_rules(spark):
    programs = spark.createDataFrame([("p", "pc"), ("x", "xbox360")], "program_id string, platform string")
    functions = spark.createDataFrame([("pf", "p", 1, "g"), ("xf", "x", 2, "h")], "function_id string, program_id string, type_index long, address_group_id string")
    targets = spark.createDataFrame([("pt", "p")], "target_id string, program_id string")
    claims = spark.createDataFrame([("ok", "pf", None, "xf", None), ("swap", "xf", None, "pf", None), ("open", None, "pt", "xf", None), ("gone", "zz", None, "xf", None)], "claim_id string, pc_function_id string, pc_target_id string, xbox_function_id string, xbox_target_id string")
    assert rows(rules.claim_platforms(claims, functions, targets, programs)) == [("gone",), ("swap",)]
    sets = spark.createDataFrame([("s", "pf", None), ("t", "xf", None)], "hypothesis_set_id string, pc_function_id string, pc_target_id string")
    assert rows(rules.subject_platforms(sets, functions, targets, programs)) == [("t",)]
    folds = spark.createDataFrame([("fx", "x"), ("fp", "p")], "fold_group_id string, program_id string")
    alternatives = spark.createDataFrame([("a", "s", "ok", None), ("b", "s", "swap", None), ("c", "s", None, "fx"), ("d", "s", None, "fp")], "alternative_id string, hypothesis_set_id string, claim_id string, xbox_fold_group_id string")
    assert rows(rules.alternative_subjects(alternatives, sets, claims, folds, programs)) == [("b",), ("d",)]
    tables = spark.createDataFrame([("v", "p"), ("w", "x")], "vtable_id string, program_id string")
    pairs = spark.createDataFrame([("1", "v", "w"), ("2", "w", "v")], "alignment_id string, pc_vtable_id string, xbox_vtable_id string")
    assert rows(rules.alignment_sides(pairs, tables, programs)) == [("2",)]
    signatures = spark.createDataFrame([("pf", "p", 1), ("xf", "x", 3)], "function_id string, program_id string, type_index long")
    assert rows(rules.signature_types(signatures, functions), "function_id") == [("xf",)]


def test_address_and_version_rules(spark):
    groups = spark.createDataFrame([("g", "x", "xbox-va", 16), ("h", "x", "ram", 16)], "address_group_id string, program_id string, address_space string, address long")
    data = spark.createDataFrame([(1, "x", "g", 16), (2, "x", "g", 17), (3, "x", "h", 16), (4, "x", None, None), (5, "x", None, 3)], "id long, program_id string, group_id string, va long")
    assert rows(rules.addresses_agree(data, "group_id", "va", groups, "xbox-va"), "id") == [(2,), (3,), (5,)]
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "id long, v string")
    new = spark.createDataFrame([(1, "a"), (2, None), (3, "x")], "id long, v string")
    assert rows(rules.frozen(old, new, "id", ["v"])) == [(3,), (4,)]
    assert rows(rules.frozen(old, new, "id", ["v"], spark.createDataFrame([(4,)], "id long"))) == [(4,)]
    assert rows(rules.exclusive(old, new, "id")) == [(1,), (2,), (3,)]


def test_manifests_and_sinks(spark, tmp_path):
    text = json.dumps({"entries": [{"content_id": "c", "logical_name": "n", "role": "r"}]}, sort_keys=True, separators=(",", ":"))
    good = "manifest:sha256:" + hashlib.sha256(text.encode()).hexdigest()
    manifests = spark.createDataFrame([(good, text), ("manifest:sha256:0", text)], "manifest_id string, canonical_json string")
    entries = spark.createDataFrame([(good, 0, "r", "n", "c"), ("manifest:sha256:0", 0, "r", "n", "c")], "manifest_id string, ordinal long, role string, logical_name string, content_id string")
    assert rows(persist.altered_manifests(manifests, entries)) == [("manifest:sha256:0",)]
    assert rows(persist.altered_manifests(manifests, entries.where("ordinal < 0"))) == sorted([(good,), ("manifest:sha256:0",)])
    persist.write_tagged({"use": spark.createDataFrame([(2, None)], "id long, v string"), "site": spark.createDataFrame([(1,)], "id long")}, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == ['{"record":"site","id":1}', '{"record":"use","id":2,"v":null}']
    assert rows(persist.private_rows({"a": spark.range(3), "b": spark.range(0)})) == [("a", 3)]


def test_cursors_and_flags(spark):
    value = {"rank": 3, "id": "é"}
    assert review.decoded_cursor(review.encoded_cursor(value)) == value and "=" not in review.encoded_cursor(value)
    for bad in ("!", "W10", ""):
        with pytest.raises(ValueError):
            review.decoded_cursor(bad)
    index = spark.createDataFrame([(1, 0, 0, 0, 2, 1, 0), (2, 1, 0, 1, 0, 0, 0)], "alternative_count long, has_fold long, has_empty_fold long, has_unresolved long, evidence_count long, directional_count long, contradicting_count long")
    out = review.flags(index).orderBy("alternative_count").collect()
    assert out[0]["has_exact_scalar_topology"] and not out[0]["has_multiple_alternatives"] and out[1]["has_multiple_alternatives"] and out[1]["has_unresolved_endpoint"] and not out[1]["has_directional_evidence"]


def test_digests_tell_nulls_from_blanks(spark):
    kind = "g long, k long, a string, b string"
    digest = lambda *r: persist.row_digests(spark.createDataFrame([(1, i, *v) for i, v in enumerate(r)], kind), "g", ["k"], ["a", "b"]).first()["digest"]
    some = [(None, "x"), ("", "x"), ("x", None), ("1:x", ""), ("", "1:x"), ("n", "n"), (None, None)]
    assert len({digest(v) for v in some}) == len(some) and digest(("a", "b"), ("c", "d")) != digest(("a", "b"))
    entry = "manifest_id long, role string, logical_name string, content_id string, size_bytes long"
    manifests = spark.createDataFrame([(1, "a", None, "b", 1), (2, "a", "b", None, 1), (3, "a", "b", "", 1)], entry)
    assert len({r["digest"] for r in persist.manifest(manifests).collect()}) == 3


def test_export_plan_stays_small(spark, sf):
    """No reason is derived more than once or twice, however often the plan asks for it."""
    from cairn.plans import registry

    for name in ("export_plan", "export_plan_blocked", "export_plan_actions"):
        plan = registry.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("pc_endpoint_wrong_platform") <= 2 and len(plan) < 20_000, (name, len(plan))
