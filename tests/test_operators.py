"""Small hand-made cases: brute force, properties, plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from planframe.functions.geometry import cell_world, in_polygon, nearest
from planframe.functions.text import dims, mark
from planframe.operators import alerts, annotate, boxes, corrections, edits, grid, jobs, library, sanitize
from planframe.options import Options


def test_polygon_rays(spark):
    shape = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D), named_struct('x', 4D, 'y', 4D), named_struct('x', 2D, 'y', 1D), named_struct('x', 0D, 'y', 4D))")
    df = spark.createDataFrame([(1.0, 1.0, True), (2.0, 3.0, False), (3.9, 3.0, True), (5.0, 1.0, False)], "x double, y double, want boolean")
    assert all(r.got == r.want for r in df.select(in_polygon(F.col("x"), F.col("y"), shape).alias("got"), "want").collect())
    two = F.expr("array(named_struct('x', 0D, 'y', 0D), named_struct('x', 4D, 'y', 0D))")
    assert df.select(in_polygon(F.col("x"), F.col("y"), two).alias("g")).where("g").count() == 0


def test_labels(spark):
    df = spark.createDataFrame([("C1 800x600", 800.0, 600.0, False, "C1"), ("300∅", 300.0, 300.0, True, None), ("Ø450 K12", 450.0, 450.0, True, "K12"), ("dia. 500", 500.0, 500.0, True, None), ("note", None, None, None, None), (None, None, None, None, None)], "t string, w double, d double, c boolean, m string")
    w, d, c = dims(F.col("t"))
    for r in df.select("*", w.alias("gw"), d.alias("gd"), c.alias("gc"), mark(F.col("t")).alias("gm")).collect():
        assert (r.gw, r.gd, r.gc, r.gm) == (r.w, r.d, r.c, r.m)


def test_interpolation_clamps_past_the_last_line_only(spark):
    lines, world = F.expr("array(0D, 100D, 300D)"), F.expr("array(0D, 1000D, 5000D)")
    df = spark.createDataFrame([(-50.0, -500.0), (50.0, 500.0), (100.0, 1000.0), (200.0, 3000.0), (300.0, 5000.0), (900.0, 5000.0)], "x double, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select(cell_world(lines, world, F.col("x")).alias("got"), "want").collect())


def test_nearest_takes_the_first_of_equals(spark):
    assert spark.range(1).select(nearest(F.array(F.lit(1.0), F.lit(3.0)), F.lit(2.0)).alias("v")).first().v == 1.0


BOXES = "job_id long, type string, ord long, x1 double, y1 double, x2 double, y2 double, confidence double"


def random_boxes(n, seed=3):
    r = random.Random(seed)
    out = []
    for i in range(n):
        x, y = r.uniform(0, 900), r.uniform(0, 900)
        out.append((i % 2, "column", i, x, y, x + r.uniform(20, 90), y + r.uniform(20, 90), round(r.random(), 2)))
    return out


def iou(a, b):
    w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
    if w <= 0 or h <= 0:
        return 0.0
    area = lambda c: (c[5] - c[3]) * (c[6] - c[4])
    return w * h / (area(a) + area(b) - w * h)


def test_greedy_suppression_equals_the_sequential_one(spark):
    rows = random_boxes(240)
    want = set()
    for job in (0, 1):
        kept = []
        for b in sorted((b for b in rows if b[0] == job), key=lambda b: (-b[7], b[2])):
            if all(iou(b, k) <= 0.45 for k in kept):
                kept.append(b)
        want |= {(job, k[2]) for k in kept}
    got = boxes.suppress(spark.createDataFrame(rows, BOXES))
    assert {(r.job_id, r.ord) for r in got.collect()} == want


def test_tiled_joins_equal_brute_force(spark):
    rows = random_boxes(200, 5)
    df = spark.createDataFrame(rows, BOXES)
    want = {(a[0], a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[2] < b[2] and iou(a, b) > 0.1}
    assert {(r.job_id, r.a_ord, r.b_ord) for r in boxes.overlap_pairs(df, 0.1).collect()} == want
    centre = lambda b: ((b[3] + b[5]) / 2, (b[4] + b[6]) / 2)
    o = Options(isolated_px=60.0)
    alone = {(a[0], a[2]) for a in rows if not any(a[0] == b[0] and a[2] != b[2] and math.dist(centre(a), centre(b)) <= 60 for b in rows)}
    assert {(r.job_id, r.ord) for r in boxes.isolated(df, o).collect()} == alone
    plan = boxes.overlap_pairs(df, 0.1)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], BOXES)
    lines = spark.createDataFrame([], "job_id long, axis string, idx long, px double")
    assert boxes.validate(none, lines).count() == 0
    assert boxes.suppress(none).count() == 0
    log = spark.createDataFrame([], "id long, ts timestamp_ntz, job_id long, element_type string, element_index int, changes string, is_delete boolean")
    assert corrections.stats(log).first().latest is None
    assert corrections.defaults(log).count() == 0


def test_store_fold(spark):
    ops = [(1, 1, "update", '{"a":"0"}'), (1, 2, "put", '{"a":"1","b":"2"}'), (1, 3, "update", '{"b":"3"}'), (1, 4, "contains", None), (1, 5, "put", '{"c":"4"}'), (1, 6, "update", '{"a":"9"}'), (2, 7, "get", None)]
    got = jobs.fold(spark.createDataFrame(ops, "job_id long, ord long, op string, payload string"))
    assert {(r.job_id, r.key, r.value, r.created_ord, r.accessed_ord) for r in got.collect()} == {(1, "c", "4", 2, 6), (1, "a", "9", 2, 6)}


def test_eviction_leaves_one_less_than_the_limit(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(8)], "job_id long, accessed_ord long")
    assert sorted(r.job_id for r in jobs.survivors(df, Options(max_jobs=5)).collect()) == [4, 5, 6, 7]
    assert jobs.survivors(df, Options(max_jobs=8)).count() == 8


def test_patches(spark):
    els = spark.createDataFrame([(1, i, 100.0) for i in range(4)], "job_id long, ord long, width double")
    p = spark.createDataFrame([(1, 0, 1, "width", 5.0, False), (1, 1, 1, "width", 7.0, False), (1, 2, 2, None, None, True), (1, 3, 0, "colour", 1.0, False), (1, 4, 9, "width", 1.0, False)], "job_id long, patch_ord long, ord long, field string, value double, is_delete boolean")
    got = edits.apply_patches(els, p, ["width"]).orderBy("ord").collect()
    assert [(r.ord, r.width, r.new_ord) for r in got] == [(0, 100.0, 0), (1, 7.0, 1), (3, 100.0, 2)]


def test_upper_median_and_first_mode(spark):
    df = spark.createDataFrame([("a", v, i) for i, v in enumerate([9.0, 2.0, 0.0, 5.0])] + [("b", v, i) for i, v in enumerate([3.0, 1.0, 1.0, 3.0])], "k string, v double, o long")
    assert {r.k: r.m for r in grid.upper_median(df, ["k"], "v", "m").collect()} == {"a": 5.0, "b": 3.0}
    assert {r.k: r.m for r in grid.mode_first(df, ["k"], "v", "o", "m").collect()}["b"] == 3.0


def test_fallback_labels(spark):
    y = {r.idx: r.label for r in grid.fallback_lines(spark).where("axis = 'y'").collect()}
    assert (y[0], y[25], y[26], y[29]) == ("A", "Z", "AA", "DD")


@pytest.fixture(scope="module")
def plan(spark):
    gaps = spark.createDataFrame([(1, a, i, 8000.0) for a in "xy" for i in range(3)], "job_id long, axis string, idx long, spacing_mm double")
    cols = spark.createDataFrame([(1, 4 * i + j, 8000.0 * i, 8000.0 * j, 400.0, 400.0) for i in range(4) for j in range(4) if (i, j) != (3, 3)], "job_id long, col_ord long, cx double, cy double, hw double, hd double")
    dashes = spark.createDataFrame([(1, "x", 0.0, 20000.0, 8000.0), (1, "x", 17000.0, 30000.0, 24000.0)], "job_id long, axis string, lo double, hi double, perp double")
    beams = [
        (0, 300.0, 100.0, 7700.0, -50.0),  # snaps to two columns
        (1, 200.0, -80.0, 7900.0, 60.0),  # the same span again
        (2, 300.0, 8100.0, 700.0, 8100.0),  # both ends near one column: one walks on to the next
        (3, 90000.0, 0.0, 98000.0, 0.0),  # far outside
        (4, 17000.0, 24000.0, 23000.0, 24000.0),  # its right end has a dashed line but no column
        (5, 24000.0, 16200.0, 24000.0, 23800.0),  # its upper end floats and has no line
        (6, None, 0.0, 1.0, 1.0),
    ]
    rows = spark.createDataFrame([(1, *b, 300.0) for b in beams], "job_id long, ord long, sx double, sy double, ex double, ey double, width double")
    return {r.ord: r for r in sanitize.sanitize(rows, cols, dashes, gaps).collect()}


def test_sanitizer_tags(plan):
    assert len(plan) == 7
    assert plan[0].tag is None and (plan[0].sx, plan[0].sy, plan[0].ex, plan[0].ey) == (400.0, 0.0, 7600.0, 0.0)
    assert plan[1].tag == "duplicate_span"
    assert plan[2].tag is None and abs(plan[2].ex - plan[2].sx) == 7200.0
    assert plan[3].tag == "out_of_grid"
    assert plan[4].tag == "dashline_no_anchor"
    assert plan[5].tag == "no_dashline"
    assert plan[6].tag == "no_endpoints"


def test_library(spark):
    t = "ord long, family_name string, category string, tags array<string>, types array<struct<type_name string, width_mm double, depth_mm double>>, has_path boolean"
    df = spark.createDataFrame([(0, "UC Column", "Columns", ["steel"], [("200x200", 200.0, 200.0)], True), (1, "Concrete Column", "Columns", ["Steel"], [("800x800", 800.0, 800.0)], False), (2, "Door", "Doors", [], [], True)], t)
    assert [r.ord for r in library.search(df, "columns", "steel").collect()] == [0]
    best = library.ranked(df, "Columns", "column").collect()
    assert [r.ord for r in best] == [0, 1] and best[0].score == 7.0 and best[1].score == 6.0
    assert {r.ord: r.s for r in df.select("ord", library.score(None, "800x800").alias("s")).collect()} == {0: 2.0 - 1200 / 500 if 2.0 - 1200 / 500 > 0 else 0.0, 1: 2.0 + 2.0 - 1.0, 2: 0.0}


def test_warnings_merge_and_short_columns(spark):
    w = spark.createDataFrame([(0, "a", [2, 1]), (1, "b", [3]), (2, "a", [1, 5])], "ord long, text string, element_ids array<int>")
    assert {r.text: (r.ids, r.first) for r in alerts.merge(w).collect()} == {"a": ([1, 2, 5], 0), "b": ([3], 1)}
    c = spark.createDataFrame([(300.0,), (None,), (3000.0,)], "height double")
    assert sorted(r.height for r in alerts.raise_short(c).collect()) == [1000.0, 1000.0, 3000.0]


def test_zone_takes_the_first_label_that_tells(spark):
    slabs = annotate.box_points(spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0), (1, 1, 50.0, 50.0, 60.0, 60.0)], "job_id long, ord long, x1 double, y1 double, x2 double, y2 double"))
    zones = spark.createDataFrame([(1, 0, 5.0, 5.0, "NSP9"), (1, 1, 6.0, 6.0, "NSP2"), (1, 2, 1.0, 1.0, "300CIS")], "job_id long, zone_ord long, zx double, zy double, code string")
    legend = spark.createDataFrame([(j, "NSP2", mm) for j, mm in ((1, 250.0), (2, 175.0))], "job_id long, code string, thickness_mm double")
    assert {r.ord: r.thickness_mm for r in annotate.zone_thickness(slabs, zones, legend).collect()} == {0: 250.0, 1: 200.0}
    other = [df.withColumn("job_id", F.lit(2).cast("long")) for df in (slabs, zones)]
    both = annotate.zone_thickness(slabs.unionByName(other[0]), zones.unionByName(other[1]), legend)
    assert {(r.job_id, r.ord): r.thickness_mm for r in both.collect()} == {(1, 0): 250.0, (1, 1): 200.0, (2, 0): 175.0, (2, 1): 200.0}


def test_spacings_do_not_hang_on_how_rows_are_dealt(spark):
    # Lines as wide as each other and three sizes: every inferred bay is as near to one annotated bay as to another.
    lines = spark.createDataFrame([(j, "x", i, 70.1 * i + j / 3) for j in range(5) for i in range(30)], "job_id long, axis string, idx long, px double")
    sizes = (8400.0, 7350.0, 8400.0, 9450.0, 8400.0, 7900.3)
    texts = spark.createDataFrame([(j, 100 * j + i, "x", 70.1 * i + 35 + j / 3, sizes[(i + j) % 6]) for j in range(5) for i in range(29) if (i * 7 + j) % 3], "job_id long, ord long, axis string, pos double, mm double")
    told = [sorted(map(tuple, grid.infer_spacings(texts.repartition(n), lines.repartition(n)).collect())) for n in (1, 7, 64)]
    assert told[0] == told[1] == told[2] and {x[4] for x in told[0]} == {"annotated", "inferred"}
    plan = grid.infer_spacings(texts, lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") < 10


def test_a_chain_of_overlaps_of_any_length_is_settled(spark):
    n = 60
    rows = [(1, i, "slab", 10.0 * i, 0.0, 10.0 * i + 40, 40.0, 1 - i / 1000) for i in range(n)]
    df = spark.createDataFrame(rows, "job_id long, ord long, type string, x1 double, y1 double, x2 double, y2 double, confidence double")
    kept = []
    for r in rows:
        over = lambda k, r=r: max(0.0, k[3] + 40 - r[3])
        if all(over(k) * 40 / (3200 - over(k) * 40) <= Options().nms_iou for k in kept):
            kept.append(r)
    assert sorted(x.ord for x in boxes.suppress(df).collect()) == [r[1] for r in kept]
