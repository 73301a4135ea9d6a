"""The whole job: every row of the inputs counts, whatever its id or size."""

from planframe.operators import alerts, annotate, boxes, grid, sanitize


def test_two_drawings_have_two_grids(spark):
    lines = spark.createDataFrame([(j, a, i, 100.0 * j * i) for j in (1, 5) for a in "xy" for i in range(4)], "job_id long, axis string, idx long, px double")
    gaps = spark.createDataFrame([(j, a, i, 8000.0 if j == 1 else 2000.0) for j in (1, 5) for a in "xy" for i in range(3)], "job_id long, axis string, idx long, spacing_mm double")
    box = lambda j, o, x: (j, o, "column", x - 10.0, 190.0, x + 10.0, 210.0, 0.9)
    df = spark.createDataFrame([box(1, 0, 150.0), box(1, 1, 900.0), box(5, 0, 900.0), box(5, 1, 2500.0), box(7, 0, 900.0)], "job_id long, ord long, type string, x1 double, y1 double, x2 double, y2 double, confidence double")
    kept = {(r.job_id, r.ord): r.kept for r in boxes.outside_grid(df, lines).collect()}
    assert kept == {(1, 0): True, (1, 1): False, (5, 0): True, (5, 1): False, (7, 0): True}
    at = {(r.job_id, r.ord): (r.wx, r.wy) for r in grid.to_world(boxes.centred(df), lines, gaps).collect()}
    assert at[1, 0] == (12000.0, 8000.0) and at[5, 0] == (3600.0, 5200.0)
    told = {(r.job_id, r.ord): (r.violations, r.is_compliant) for r in boxes.enforce_rules(df, lines, gaps).collect()}
    assert told[1, 0] == told[7, 0] == ("", True) and told[5, 0] == (",".join(["bay_too_narrow_2000mm"] * 6), False)


def test_a_beam_far_inside_a_wide_column(spark):
    beams = spark.createDataFrame([(1, 0, 0.0, 0.0, 99000.0, 0.0)], "job_id long, ord long, sx double, sy double, ex double, ey double")
    columns = spark.createDataFrame([(1, 5900.0, 0.0, 6000.0, 6000.0)], "job_id long, cx double, cy double, hw double, hd double")
    warnings = spark.createDataFrame([(1, 7, "Cannot keep elements joined.")], "job_id long, ord long, text string")
    assert [r.depth_mm for r in alerts.worst_beams(beams, columns, warnings).collect()] == [100.0]


def test_box_bounds_are_those_of_the_type(spark):
    sides = [("structural_framing", 250, 12), ("structural_framing", 301, 200), ("structural_framing", 250, 9), ("column", 80, 61), ("column", 80, 59), ("column", 81, 81)]
    df = spark.createDataFrame([(1, i, t, 0.0, 0.0, float(w), float(h)) for i, (t, w, h) in enumerate(sides)], "job_id long, ord long, type string, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.ord for r in boxes.box_filter(df).collect()) == [0, 3]


def test_a_wide_column_meets_every_label_in_its_reach(spark):
    # A column of 500 px reaches 1500 px; labels lie on both sides of it, just within and just past that.
    cols = spark.createDataFrame([(j, j, 4750.0 + 100 * j, 4750.0, 5250.0 + 100 * j, 5250.0) for j in range(12)], "job_id long, ord long, x1 double, y1 double, x2 double, y2 double")
    spans = spark.createDataFrame([(j, 0, 5000.0 + 100 * j + (1490.0 if j < 8 else 1510.0) * (-1) ** j, 5000.0, "900x700") for j in range(12)], "job_id long, ord long, sx double, sy double, text string")
    got = {r.ord: (r.width_mm, r.source) for r in annotate.annotate_columns(cols, spans).collect()}
    assert got == {j: (900.0, "proximity") if j < 8 else (800.0, "default") for j in range(12)}


def test_beams_end_in_core_walls_and_on_rectangles(spark):
    gaps = spark.createDataFrame([(j, a, i, 8000.0) for j in range(1, 9) for a in "xy" for i in range(3)], "job_id long, axis string, idx long, spacing_mm double")
    cols = spark.createDataFrame([(j, 0, 16000.0, 24000.0, 400.0, 400.0) for j in range(1, 9)], "job_id long, col_ord long, cx double, cy double, hw double, hd double")
    dashes = spark.createDataFrame([(j, "x", 17000.0, 30000.0, 24000.0) for j in range(1, 9)], "job_id long, axis string, lo double, hi double, perp double")
    y = {3: 23000.0}  # only the line that this beam snaps to leads into the wall
    beams = spark.createDataFrame([(j, 0, 17000.0, y.get(j, 24000.0), 23000.0, y.get(j, 24000.0), 300.0) for j in range(1, 9)], "job_id long, ord long, sx double, sy double, ex double, ey double, width double")
    box = lambda x0, y0, x1, y1: [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    walls = [(2, box(22000.0, 23000.0, 23500.0, 25000.0)), (3, box(22000.0, 23800.0, 23500.0, 24200.0)), (4, box(30900.0, 23000.0, 32000.0, 25000.0)), (7, [(31000.0, 24000.0)]), (8, box(16500.0, 23900.0, 23500.0, 24100.0))]
    walls = spark.createDataFrame(walls, "job_id long, points array<struct<x double, y double>>")
    rects = [(1, 0, 30200.0, 23720.0, 30800.0, 24320.0), (1, 1, 29900.0, 23720.0, 30500.0, 24320.0), (4, 0, 30200.0, 23720.0, 30800.0, 24320.0), (6, 0, 30000.0, 23000.0, 32000.0, 25000.0)]
    rects = spark.createDataFrame(rects, "job_id long, rect_ord long, x0 double, y0 double, x1 double, y1 double")
    got = {r.job_id: (r.tag, r.sx, r.sy, r.ex, r.ey) for r in sanitize.sanitize(beams, cols, dashes, gaps, core_walls=walls, rectangles=rects).collect()}
    assert got[1] == (None, 16400.0, 24000.0, 30500.0, 24020.0)
    assert got[2] == got[3] == (None, 16400.0, 24000.0, 23000.0, 24000.0)
    assert got[4] == (None, 16400.0, 24000.0, 31000.0, 24000.0)
    assert got[5][0] == got[6][0] == got[7][0] == "dashline_no_anchor"
    assert got[8] == (None, 17000.0, 24000.0, 23000.0, 24000.0)
