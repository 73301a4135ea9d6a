"""Libraries of families, training sets, edits, sessions and sinks on small cases."""

import json

from pyspark.sql import functions as F

from planframe.functions.geometry import interpolate, to_pt, to_px
from planframe.functions.text import is_join_error, parameter, tag_join
from planframe.operators import admit, annotate, boxes, corrections, detect, edits, jobs, library, recipe, sanitize, session, strokes
from planframe.options import DEFAULTS, with_profile
from planframe.sources import readers


def test_family_index(spark, tmp_path):
    root = tmp_path / "lib"
    for folder in ("structural_columns", "doors", "misc"):
        (root / folder).mkdir(parents=True)
    (root / "structural_columns" / "Round dia300.rfa").write_bytes(b"x")
    (root / "structural_columns" / "Round dia300.json").write_text(json.dumps({"tags": ["extra"], "material": "steel", "path": "no", "note": "kept"}))
    (root / "misc" / "Timber beam 200x400.rfa").write_bytes(b"x")
    (root / "doors" / "ALONE.json").write_text(json.dumps({"family_name": "Lone door", "types": [{"type_name": "T", "width_mm": 900.0}]}))
    (root / "doors" / "TIMBER BEAM 200x400.json").write_text("{}")
    (root / "doors" / "broken.json").write_text("{nothing")
    (root / "index.json").write_text("{}")
    rows = library.scan(*readers.family_files(spark, str(root))).collect()
    assert [r.family_name for r in rows] == ["Lone door", "Round dia300", "Timber beam 200x400"]
    by = {r.family_name: r for r in rows}
    r = by["Round dia300"]
    assert (r.category, r.placement, r.shape, r.material, r.rfa_local, r.sidecar) == ("OST_StructuralColumns", "column", "circular", "steel", True, True)
    assert r.tags == ["circular", "column", "concrete", "extra", "structural"] and r.types[0].type_name == "Ø300" and r.extra == {"note": "kept"}
    r = by["Timber beam 200x400"]
    assert (r.category, r.material, r.shape, r.sidecar) == ("OST_StructuralFraming", "timber", "rectangular", False) and r.types[0].width_mm == 200.0
    r = by["Lone door"]
    assert (r.category, r.rfa_local, r.types[0].width_mm, r.tags) == ("OST_Doors", False, 900.0, ["door", "opening"])
    readers.write_index(library.scan(*readers.family_files(spark, str(root))), str(tmp_path / "index"))
    told = spark.read.json(str(tmp_path / "index"), multiLine=True).first()
    assert told.total == 3 and [f.family_name for f in told.families] == ["Lone door", "Round dia300", "Timber beam 200x400"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "column", 0, "0 a"), (1, "train", "column", 1, "0 b"), (2, "val", "column", 0, "0 c")], "job_id long, split string, type string, ord long, line string")
    readers.write_labels(rows, str(tmp_path / "labels"))
    assert spark.read.text(str(tmp_path / "labels" / "split=train" / "job_id=1")).count() == 2
    for _ in range(2):
        readers.append(rows.limit(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    readers.write_dataset(spark, str(tmp_path / "yaml"), "/data", ["column", "wall"])
    assert [r.value for r in spark.read.text(str(tmp_path / "yaml")).collect()][3:] == ["nc: 2", "names:", "  0: column", "  1: wall"]
    readers.write_profile(spark, str(tmp_path / "profile"), {"a": 1})
    assert spark.read.json(str(tmp_path / "profile")).first().a == 1
    assert readers.manifest(spark, str(tmp_path / "none.json")).count() == 0


def test_edits_and_labels(spark):
    els = spark.createDataFrame([(1, "column", 0), (1, "column", 1)], "job_id long, element_type string, ord long")
    p = [(1, 0, "column", 0, "width", False), (1, 1, "column", 0, "colour", False), (1, 2, "column", 9, "width", False), (1, 3, "lift", 0, "width", False), (1, 4, "column", 1, None, True), (1, 5, "column", 0, "id", False)]
    p = spark.createDataFrame(p, "job_id long, patch_ord long, element_type string, ord long, field string, is_delete boolean")
    assert {r.patch_ord: r.error for r in edits.judged(els, p.withColumn("value", F.lit("9")), {"column": ["width", "id"]}).collect()} == {0: None, 1: "unknown_field", 2: "no_element", 3: "unknown_type", 4: None, 5: "blocked_field"}
    det = spark.createDataFrame([(1, "columns", 0, 0.0, 0.0, 50.0, 50.0), (1, "columns", 1, 0.0, 0.0, 10.0, 20.0), (1, "walls", 0, 0.0, 0.0, 10.0, 20.0), (2, "columns", 0, 0.0, 0.0, 10.0, 0.0)], "job_id long, type string, ord long, x1 double, y1 double, x2 double, y2 double")
    fix = spark.createDataFrame([(1, "column", 0, True), (2, "column", 7, True)], "job_id long, element_type string, element_index int, is_delete boolean")
    pics = spark.createDataFrame([(1, 100, 100), (2, 100, 100)], "job_id long, width_px int, height_px int")
    got = corrections.train_labels(det, fix, pics, {"columns": 3}).collect()
    assert [(r.job_id, r.split, r.line) for r in got] == [(1, "val", "3 0.050000 0.100000 0.100000 0.200000")]


def test_session_rows(spark):
    symbols = spark.createDataFrame([("s", "F", "b", 2, {"Width": 1.0}), ("s", "F", "a", 1, {}), ("s", "G", None, 3, {})], "session_id string, family_name string, type_name string, element_id long, parameters map<string,double>")
    types = {r.family_name: [(t.type_name, t.width_mm) for t in r.types] for r in session.family_types(symbols).collect()}
    assert types == {"F": [("a", None), ("b", 304.8)]}
    levels = spark.createDataFrame([("s", "top", 3000.0), ("s", "base", 0.0)], "session_id string, level string, elevation double")
    placed = spark.createDataFrame([("s", "wall"), ("s", "wall")], "session_id string, kind string")
    snap = sorted((r.part, r.ord, r.name, r.value) for r in session.snapshot(levels, symbols, placed).collect())
    assert snap == [("family", 1, "F", 2.0), ("family", 2, "G", 0.0), ("level", 1, "base", 0.0), ("level", 2, "top", 3000.0), ("placed", 1, "wall", 2.0)]
    beats = spark.createDataFrame([("a", 1, True), ("a", 2, False)], "service string, ts long, healthy boolean")
    assert session.last_health(beats).first().healthy is False
    els = spark.createDataFrame([(1, "columns", 0, 5.0, "x"), (1, "columns", 1, 6.0, "y")], "job_id long, kind string, ord long, width double, note string")
    new = spark.createDataFrame([(1, "columns", 1, 9.0)], "job_id long, kind string, ord long, width double")
    assert [(r.width, r.note) for r in session.merge_validated(els, new, ["width"]).orderBy("ord").collect()] == [(5.0, "x"), (9.0, "y")]
    state = spark.createDataFrame([(1, "a", "x", "1")], "job_id long, key string, subkey string, value string")
    change = spark.createDataFrame([(1, 0, "a", "y", "2"), (1, 1, "a", "y", "3"), (1, 2, "a", "x", "9"), (2, 3, "a", "x", "0")], "job_id long, ord long, key string, subkey string, value string")
    assert sorted(map(tuple, jobs.set_nested(state, change).collect())) == [(1, "a", "x", "9"), (1, "a", "y", "3")]
    assert {r.job_id: r.error for r in jobs.completed(spark.createDataFrame([(1, "completed"), (2, "failed"), (3, None)], "job_id long, status string")).collect()} == {1: None, 2: "not_completed", 3: "not_completed"}
    judged = spark.createDataFrame([(1, True, False, True), (1, False, True, False)], "job_id long, is_valid boolean, is_orphan boolean, is_compliant boolean")
    assert tuple(session.check_counts(judged).first()) == (1, 1, 1, 1, 1)


def test_small_expressions(spark):
    df = spark.createDataFrame([("10", "mm"), ("3.7", "int"), ("x", "string"), ("2.5", "raw"), ("1", "other")], "v string, k string")
    got = [tuple(r.p) for r in df.select(parameter(F.col("v"), F.col("k")).alias("p")).collect()]
    assert got == [(10 / 304.8, None), (3.0, None), (None, "x"), (2.5, None), (None, None)]
    t = spark.createDataFrame([("Cannot keep elements joined", [4, 5]), ("an Element will join", []), ("fine", [1])], "t string, ids array<int>")
    assert [r[0] for r in t.select(is_join_error(F.col("t"))).collect()] == [True, True, False]
    assert t.select(tag_join(F.col("t"), F.col("ids"))).first()[0] == "[JOIN-RESOLVED:4,5] Cannot keep elements joined"
    lines, world = F.expr("array(0D, 100D, 300D)"), F.expr("array(0D, 1000D, 5000D)")
    x = spark.createDataFrame([(-50.0, -500.0), (100.0, 1000.0), (200.0, 3000.0), (400.0, 7000.0)], "x double, want double")
    assert all(abs(r.g - r.want) < 1e-9 for r in x.select(interpolate(lines, world, F.col("x")).alias("g"), "want").collect())
    assert spark.range(1).select(to_px(F.lit(36.0), F.lit(144.0)), to_pt(F.lit(72.0), F.lit(144.0))).first()[:] == (72.0, 36.0)
    o = with_profile({"typical_wall_height_mm": 3100, "floor_to_floor_height_mm": 9000, "typical_column_size_mm": 700, "typical_sill_height_mm": "high"})
    assert (o.wall_height_mm, o.default_storey_mm, o.min_column_mm, o.sill_mm) == (3100.0, DEFAULTS.default_storey_mm, DEFAULTS.min_column_mm, DEFAULTS.sill_mm)


def test_sheets_stacks_and_overlays(spark):
    pages = spark.createDataFrame([(1,), (2,)], "job_id long")
    paths = spark.createDataFrame([(1, 10.0, 20.0, 110.0, 70.0), (1, 0.0, 30.0, 50.0, 90.0)], "job_id long, x1 double, y1 double, x2 double, y2 double")
    assert {r.job_id: tuple(r)[1:] for r in detect.page_bounds(pages, paths).collect()} == {1: (0.0, 20.0, 110.0, 70.0), 2: (0.0, 0.0, 3370.0, 2384.0)}
    a = spark.createDataFrame([(1, 0, "column"), (1, 1, "column")], "job_id long, ord long, type string")
    b = spark.createDataFrame([(1, 0, "wall")], "job_id long, ord long, type string")
    assert [(r.type, r.all_ord) for r in boxes.stacked(a, b).orderBy("all_ord").collect()] == [("column", 0), ("column", 1), ("wall", 2)]
    assert boxes.drop_by_id(a, b).count() == 1
    d = spark.createDataFrame([(1, 0, "reject", "join_conflict_unsupported", 0.0, 0.0, 1.0, 1.0), (1, 1, "reject", "off_grid", 0.0, 0.0, 1.0, 1.0)], "job_id long, ord long, action string, reason string, x1 double, y1 double, x2 double, y2 double")
    assert [(r.blue, r.green, r.red) for r in admit.overlay(d).collect()] == [(0, 0, 255)]
    first = spark.createDataFrame([(1, 5, "a")], "job_id long, ord long, text string")
    more = spark.createDataFrame([(1, 2, 0, "b"), (1, 1, 9, "c"), (1, 1, 3, "d")], "job_id long, page_idx int, ord long, text string")
    flags = spark.createDataFrame([(1, 1, True), (1, 2, False)], "job_id long, page_idx int, is_schedule boolean")
    assert [r.text for r in annotate.schedule_texts(first, more, flags).orderBy("ord").collect()] == ["a", "d", "c"]
    walls = spark.createDataFrame([(1, None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None), (2, [(0.0, 0.0)], None, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], ", ".join(["job_id long", *[f"{c} array<struct<x double, y double>>" for c in ("outline", "polygon", "points")]]))
    assert [r.job_id for r in sanitize.core_wall_polygons(walls).collect()] == [1]
    cols = spark.createDataFrame([(1, 0, 150.0, 900.0), (1, 1, 100.0, 100.0)], "job_id long, ord long, width_mm double, depth_mm double")
    assert sorted((r.ord, r.field, r.old, r.new) for r in sanitize.clamp_actions(cols).collect()) == [(0, "width_mm", 150.0, 200.0), (1, "depth_mm", 100.0, 200.0), (1, "width_mm", 100.0, 200.0)]
    assert {r.kind: r.n for r in recipe.totals(columns=cols, walls=cols.limit(0)).collect()} == {"columns": 2, "walls": 0}


def test_notes_without_clauses_go_by_line(spark):
    words = [(1, 0, 10.0, 0.0, "NOTES", 0, 0)] + [(1, i, 10.0 + i, 20.0 + 10 * (i // 4), w, 1, i // 4) for i, w in enumerate("NSP2 130 THK and NSP5 150 + 200".split(), 1)]
    df = spark.createDataFrame(words, "job_id long, word_ord long, x0 double, y0 double, text string, block_no int, line_no int")
    assert {r.code: r.thickness_mm for r in strokes.clause_totals(strokes.notes_block(df)).collect()} == {"NSP2": 130.0, "NSP5": 150.0}
