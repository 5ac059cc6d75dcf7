"""Nested extents of any length, inherited slots, and observations in sections, against plain versions."""

import random

import pytest

from cairn.operators import alignment, ranges, sdk


@pytest.mark.parametrize("how", ["inner", "left"])
def test_all_ranges_around_a_point(spark, how):
    rng = random.Random(2)
    spans = [(a, a + rng.choice([0, 1, 2, 7, 8, 9, 64, 65, 5000, 1 << 20, 1 << 40])) for a in (rng.randrange(5000) for _ in range(300))] + [(0, 1 << 62), (10, 10), (20, 5)]
    points = [(k, rng.randrange(6000)) for k in range(200)] + [(900, None), (901, 7), (902, 7)]
    got = ranges.around(spark.createDataFrame(points, "k long, at long"), "at", spark.createDataFrame(spans, "lo long, hi long"), "lo", "hi", how).collect()
    want = [(k, at, a, b) for k, at in points for a, b in spans if at is not None and a <= at < b]
    if how == "left":
        want += [(k, at, None, None) for k, at in points if at is None or not any(a <= at < b for a, b in spans)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_long_range_makes_two_rows_at_most(spark):
    spans = spark.createDataFrame([(0, 1 << 40), (3, 1 << 50)], "lo long, hi long")
    plan = ranges.around(spark.range(10).withColumnRenamed("id", "at"), "at", spans, "lo", "hi")
    assert plan.count() == 17 and "NestedLoop" not in plan._jdf.queryExecution().executedPlan().toString()


def plain_slots(known, bases, virtuals):
    out = {}
    for c in known:
        seen, at, slots, complete = [], c, {}, False
        while at in known and at not in seen:
            seen.append(at)
            for s in virtuals.get(at, []):
                slots.setdefault(s, at)
            zero = bases.get(at, [])
            complete = not zero
            if len(zero) != 1:
                break
            at = zero[0]
        out[c] = (sorted(slots.items()), bool(slots) and sorted(slots) == list(range(len(slots))), complete)
    return out


def test_inherited_slots(spark):
    """Deep, forked, unknown and circular bases."""
    known = [f"c{k}" for k in range(40)] + ["loop1", "loop2", "tail", "self", "two", "lost", "under"]
    bases = {f"c{k}": [f"c{k - 1}"] for k in range(1, 40)} | {"loop1": ["loop2"], "loop2": ["loop1"], "tail": ["loop1"], "self": ["self"], "two": ["c1", "c2"], "lost": ["nowhere"], "under": ["two"]}
    virtuals = {f"c{k}": [k % 7, k] for k in range(40)} | {"loop1": [0], "loop2": [1], "tail": [2, 0], "two": [5], "under": [0], "self": [0]}
    table = lambda rows, kind: spark.createDataFrame(rows, kind)
    base_rows = [(c, b, 0) for c, bs in bases.items() for b in bs] + [("c5", "two", 8), ("c6", "c1", None)]
    out = alignment.slot_maps(table([(c,) for c in known], "class_name string"), table(base_rows, "class_name string, base_name string, base_offset int"), table([(c, s) for c, ss in virtuals.items() for s in ss] + [("c0", -1), ("c0", None)], "class_name string, slot int"))
    got = {r["class_name"]: ([tuple(s) for s in r["slots"]], r["hole_free"], r["complete"]) for r in out.collect()}
    assert got == plain_slots(known, bases, virtuals)
    assert got["c39"][1:] == (True, True) and got["tail"] == ([(0, "tail"), (1, "loop2"), (2, "tail")], True, False) and got["lost"] == ([], False, False)


def test_sections_and_boundaries(spark):
    sections = spark.createDataFrame([("text", 100, 200, True), ("data", 200, 300, False)], "section_name string, start long, end long, executable boolean")
    functions = spark.createDataFrame([("f", 110, 80), ("g", 120, 20), ("h", 130, 0)], "function_id string, address long, size long")
    seen = spark.createDataFrame([(k, v, a, "create_object_macro") for k, (v, a) in enumerate([("game", 110), ("game", 125), ("unspecified_pc", 120), ("unspecified_pc", 195), ("geck", 110), ("game", 250), ("game", 999)])], "observation_id long, program_variant string, address long, evidence_kind string")
    joined = sdk.code_joins(seen, functions, sections)
    got = {r["observation_id"]: (r["classification"], r["pc_function_id"], r["candidate_pc_function_id"]) for r in joined.collect()}
    assert got[0] == ("pc_function_entry", "f", None) and got[2] == ("pc_function_entry_variant_unspecified", None, "g") and got[4] == ("non_game_variant", None, None)
    assert got[5][0] == "pc_non_executable_section" and got[6][0] == "outside_pc_image_sections"
    around = {r["observation_id"]: r["containing_function_entries"] for r in sdk.boundary_candidates(joined, functions).collect()}
    assert around == {1: [110, 120], 3: []}
    for bad in ([("a", 0, 10, True), ("b", 5, 20, True)], [("a", 5, 5, True)]):
        with pytest.raises(Exception, match="sections must"):
            sdk.data_joins(seen, spark.createDataFrame(bad, "section_name string, start long, end long, executable boolean")).collect()
    with pytest.raises(Exception, match="unknown program variant"):
        sdk.code_joins(spark.createDataFrame([(1, "other", 5)], "observation_id long, program_variant string, address long"), functions, sections).collect()
