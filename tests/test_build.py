"""Positional edits, levels, placement, sized types and scenes against plain Python."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planframe.operators import edits, levels, placement, scene


def test_an_edit_after_a_delete_means_the_list_as_it_stands(spark):
    els = spark.createDataFrame([(1, i, 100.0) for i in range(4)], "job_id long, ord long, width double")
    log = [(1, 0, 1, None, None, True), (1, 1, 1, "width", 5.0, False), (1, 2, 3, "width", 1.0, False), (1, 3, 0, None, None, True), (1, 4, 1, "width", 7.0, None)]
    p = spark.createDataFrame(log, "job_id long, patch_ord long, ord long, field string, value double, is_delete boolean")
    got = edits.apply_patches(els, p, ["width"]).orderBy("ord").collect()
    assert [(r.ord, r.width, r.new_ord) for r in got] == [(2, 5.0, 0), (3, 7.0, 1)]


def test_places_equal_a_list_that_is_popped():
    r = random.Random(2)
    for n in (0, 1, 7, 200):
        places, alive = edits.Places(n), list(range(n))
        for _ in range(3 * n + 5):
            at = r.randint(-2, n + 1)
            first = places.at(at)
            assert first == (alive[at] if 0 <= at < len(alive) else None)
            if first is not None and r.random() < 0.6:
                places.drop(first)
                alive.pop(at)


def replay(elements, log, fields):
    lists, errors = defaultdict(list), {}
    for job, kind, ord_, width in sorted(elements, key=lambda e: (e[0], e[1], e[2])):
        lists[job, kind].append([ord_, width])
    by_patch = defaultdict(list)
    for x in log:
        by_patch[x[0], x[2], x[1]].append(x)
    for (job, kind, patch), rows in sorted(by_patch.items(), key=lambda kv: kv[0][2]):
        edit = [x for x in rows if not x[6]]
        have = lists[job, kind]
        at = rows[0][3]
        error = None
        if kind not in fields:
            error = "unknown_type"
        elif any(x[4] not in fields[kind] for x in edit):
            error = "unknown_field"
        elif any(x[4] in edits.BLOCKED for x in edit):
            error = "blocked_field"
        elif at is None or not 0 <= at < len(have):
            error = "no_element"
        errors[job, kind, patch] = error
        if error is None:
            if any(x[6] for x in rows):
                have.pop(at)
            else:
                for x in edit:
                    if x[4] == "width":
                        have[at][1] = x[5]
    return {(job, kind, o): (w, i) for (job, kind), have in lists.items() for i, (o, w) in enumerate(have)}, errors


def test_a_log_of_edits_equals_lists(spark):
    r = random.Random(6)
    elements = [(j, k, 3 * i + j, f"w{i}") for j in range(4) for k in ("column", "slab") for i in range(r.randint(0, 30))]
    fields = {"column": ["width", "level"], "slab": ["width", "depth"]}
    log = []
    for patch in range(400):
        j, kind, at = r.randrange(5), r.choice(["column", "slab", "slab", "lift"]), r.choice([None, *range(-1, 26)])
        gone = r.random() < 0.25
        for f in r.sample(["width", "depth", "level", "colour"], r.choice([1, 1, 1, 2])) if not gone else [None]:
            log.append((j, patch, kind, at, f, f"v{patch}", gone))
    els = spark.createDataFrame(elements, "job_id long, element_type string, ord long, width string")
    p = spark.createDataFrame(log, "job_id long, patch_ord long, element_type string, ord long, field string, value string, is_delete boolean").repartition(3)
    judged = edits.judged(els, p, fields)
    want, errors = replay(elements, [(x[0], x[1], x[2], *x[3:]) for x in log], fields)
    assert {(x.job_id, x.element_type, x.patch_ord): x.error for x in judged.collect()} == errors
    got = edits.replayed(els, judged.where("error is null"), ["job_id", "element_type"], ["width"]).collect()
    assert {(x.job_id, x.element_type, x.ord): (x.width, x.new_ord) for x in got} == want
    assert set(errors.values()) == {None, "unknown_type", "unknown_field", "blocked_field", "no_element"}


def reconciled(have, want):
    want = want if len(want) >= 2 else list(levels.DEFAULT_LEVELS)
    have, out = [list(x) for x in have], []
    for name, mm in want:
        named = next((x for x in have if x[0].upper() == name.upper()), None)
        placed = next((x for x in have if abs(x[1] / 304.8 - mm / 304.8) < 1e-4), None)
        if named:
            moved = abs(named[1] / 304.8 - mm / 304.8) > 1e-4
            named[1] = mm if moved else named[1]
            out.append((name, "move" if moved else "keep", named[1], named[0]))
        elif placed:
            out.append((name, "rename", placed[1], placed[0]))
            placed[0] = name
        else:
            have.append([name, mm])
            out.append((name, "create", mm, None))
    names = {n.upper() for n, _ in want}
    left = sorted((x for x in have if x[0].upper() not in names), key=lambda x: x[1])
    return out + [(x[0], "delete", max(mm for _, mm in want) + 3000.0 * (i + 1), x[0]) for i, x in enumerate(left)]


def test_levels_equal_a_plain_loop(spark):
    r = random.Random(9)
    names = ["Level 0", "level 1", "LEVEL 1", "Level 2", "Roof", "ROOF", "Base", "Mezzanine"]
    heights = [0.0, 0.02, 3000.0, 3000.02, 3000.04, 6000.0, 9000.0, 100.0]
    have = {j: [(r.choice(names), r.choice(heights)) for _ in range(r.randint(0, 5))] for j in range(60)}
    want = {j: [(r.choice(names), r.choice(heights)) for _ in range(r.randint(0, 5))] for j in range(60)}
    frame = lambda x: spark.createDataFrame([(j, i, n, mm) for j, v in x.items() for i, (n, mm) in enumerate(v)], "job_id long, ord long, level string, elevation double")
    got = defaultdict(list)
    for x in levels.reconcile_levels(frame(have), frame(want)).collect():
        got[x.job_id].append((x.seq is None, x.seq, x.elevation, (x.level, x.action, x.elevation, x.was)))
    for j in have:
        if have[j] or want[j]:
            assert [x[3] for x in sorted(got[j], key=lambda x: (x[0], x[1] if x[1] is not None else x[2]))] == reconciled(have[j], want[j])


def test_the_probe_of_levels(spark):
    have = spark.createDataFrame([(1, 0, "level 1", 500.0), (1, 1, "Old", 12000.0), (1, 2, "Older", 9000.0)], "job_id long, ord long, level string, elevation double")
    want = spark.createDataFrame([(1, 0, "Level 0", 0.0), (1, 1, "Level 1", 3000.0)], "job_id long, ord long, level string, elevation double")
    got = {(x.level, x.action): x.elevation for x in levels.reconcile_levels(have, want).collect()}
    assert got == {("Level 0", "create"): 0.0, ("Level 1", "move"): 3000.0, ("Older", "delete"): 6000.0, ("Old", "delete"): 9000.0}


def test_the_next_level_is_strictly_above(spark):
    lv = spark.createDataFrame([(1, "a", 0.0), (1, "c", 3000.0), (1, "b", 3000.0), (1, "d", 6000.0), (2, "z", 1.0)], "job_id long, level string, elevation double")
    bases = spark.createDataFrame([(1, 0, 0.0), (1, 1, 6000.0), (1, 2, 3000.0), (1, 3, 3000.0 - 5e-7), (1, 4, -1.0), (3, 5, 0.0)], "job_id long, ord long, base double")
    out = levels.level_above(lv, bases)
    assert {r.ord: r.level for r in out.collect()} == {0: "b", 1: None, 2: "d", 3: "d", 4: "a", 5: None}
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_placement_of_lines_and_slabs(spark):
    lv = spark.createDataFrame([(1, 0, "Level 0", 0.0), (1, 1, "LEVEL 1", 3000.0)], "job_id long, ord long, level string, elevation double")
    line = lambda o, ex, level: (1, o, 0.0, 0.0, 0.0, ex, 0.0, 0.0, level)
    rows = [line(0, 10.0, None), line(1, 0.0, None), line(2, None, None), line(3, 10.0, "level 1"), line(4, 10.0, "Attic")]
    df = spark.createDataFrame(rows, "job_id long, ord long, sx double, sy double, sz double, ex double, ey double, ez double, level string")
    got = {x.ord: (x.reason, x.base_level) for x in placement.place_lines(df, lv, 1e-6).collect()}
    assert got == {0: (None, "Level 0"), 1: ("no length", None), 2: ("no location", None), 3: (None, "LEVEL 1"), 4: ("no level", None)}
    tri = [(0.0, 0.0), (1.0, 0.0), (0.0, 1.0)]
    slabs = spark.createDataFrame([(1, 0, tri, None), (1, 1, tri[:2], None), (1, 2, None, None), (1, 3, tri, "x")], "job_id long, ord long, points array<struct<x:double,y:double>>, level string")
    assert {x.ord: x.reason for x in placement.place_slabs(slabs, lv).collect()} == {0: None, 1: "no outline", 2: "no outline", 3: "no level"}
    assert [x[0] for x in spark.createDataFrame([(2500.0,), (0.0,), (None,)], "h double").select(placement.wall_height(F.col("h"))).collect()] == [2500.0, 2800.0, 2800.0]


def test_a_type_is_made_once(spark):
    want = [(1, 5, "R", 610.0, 390.0), (1, 2, "R", 600.0, 400.0), (1, 3, "R", 325.0, 375.0), (1, 4, "C", 600.0, 400.0), (2, 1, "R", 600.0, 400.0)]
    have = spark.createDataFrame([(1, "R", "300X400MM"), (2, "C", "600x400mm")], "job_id long, family string, type_name string")
    got = placement.sized_types(spark.createDataFrame(want, "job_id long, ord long, family string, width double, depth double"), have)
    assert {(x.job_id, x.ord): (x.type_name, x.outcome) for x in got.collect()} == {(1, 2): ("600x400mm", "created"), (1, 5): ("600x400mm", "reused"), (1, 3): ("300X400MM", "existing"), (1, 4): ("600x400mm", "created"), (2, 1): ("600x400mm", "created")}
    after = placement.types_after(have, got)
    assert after.count() == 5 and after.distinct().count() == 5


@pytest.mark.parametrize("round_", [False, True])
def test_solids_are_closed_and_face_outwards(spark, round_):
    df = spark.createDataFrame([(1, "column" if round_ else "wall", 0, round_, 10.0, 20.0, 30.0, 4.0, 4.0 if round_ else 2.0, 6.0, 0.5)], "job_id long, kind string, ord long, round boolean, cx double, cy double, cz double, dx double, dy double, dz double, angle double")
    at = {x.v: (x.x, x.y, x.z) for x in scene.vertices(df).collect()}
    faces = [(x.a, x.b, x.c) for x in scene.faces(df).collect()]
    part = scene.parts(df).first()
    assert (part.n_vertices, part.n_faces) == (len(at), len(faces)) == ((66, 128) if round_ else (8, 12))
    edges = [(f[i], f[(i + 1) % 3]) for f in faces for i in range(3)]
    assert len(set(edges)) == len(edges) and {(b, a) for a, b in edges} == set(edges)
    volume = 0.0
    for f in faces:
        (ax, ay, az), (bx, by, bz), (cx, cy, cz) = (at[i] for i in f)
        volume += (ax * (by * cz - bz * cy) - ay * (bx * cz - bz * cx) + az * (bx * cy - by * cx)) / 6
    assert volume == pytest.approx(6 * 16 * 0.78 if round_ else 48.0, rel=0.01)
    assert min(p[1] for p in at.values()) == 27.0  # y is up


def test_buffers_of_a_scene_join_up(spark):
    rows = [(1, 7, 0.0, 0.0, 5000.0, 0.0), (1, 3, 0.0, 0.0, 0.5, 0.0), (1, 4, 0.0, 0.0, 0.0, 900.0)]
    w = scene.walls(spark.createDataFrame(rows, "job_id long, ord long, sx double, sy double, ex double, ey double").withColumns({"thickness": F.lit(None).cast("double"), "height": F.lit(None).cast("double")}))
    whole = scene.with_placeholder(spark.createDataFrame([(1,), (2,)], "job_id long"), w)
    got = {(x.job_id, x.kind, x.ord): (x.first_vertex, x.first_face, x.colour) for x in scene.parts(whole).collect()}
    assert got == {(1, "wall", 4): (0, 0, [200, 200, 200, 255]), (1, "wall", 7): (8, 12, [200, 200, 200, 255]), (2, "placeholder", 0): (0, 0, [180, 180, 180, 255])}
    assert sorted(x.face for x in scene.faces(whole).where("job_id = 1").collect()) == list(range(24))
    assert {x.a // 8 for x in scene.faces(whole).where("job_id = 1 and face >= 12").collect()} == {1}
