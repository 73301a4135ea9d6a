"""What is sent whole to every executor: no table that grows with the drawings."""

import re

import pytest
from pyspark.sql import functions as F

from planframe import catalog
from planframe.functions.geometry import nearest, nearest_ascending
from planframe.operators import sanitize
from planframe.options import Options

DATA = "/root/testdata/sf0.001"


def sent(df) -> list[str]:
    """What is broadcast: for each, the steps from there down to the first join or shuffle."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("\n")
    out = []
    for i, line in enumerate(plan):
        if "BroadcastExchange" in line:
            end = next((k for k in range(i + 1, len(plan)) if re.search("Join|Exchange|Scan|Union", plan[k])), len(plan))
            out.append("\n".join(plan[i:end]))
    return out


TILED = ["admit_all", "admit_counts", "annotate_columns", "annotation_sources", "enforce_rules", "framing_score", "iou_overlap", "isolated", "nearest_tag", "reject_examples", "stroke_style", "validate_all"]


@pytest.mark.parametrize("name", TILED)
def test_tables_put_on_tiles_are_not_broadcast(spark, name):
    assert not [part for part in sent(catalog.QUERIES[name](spark, DATA)) if "Generate explode" in part]


def test_legend_and_schedule_are_not_broadcast(spark):
    for name, key in (("framing_score", "tag#"), ("annotate_columns", "mark#")):
        assert not [part for part in sent(catalog.QUERIES[name](spark, DATA)) if re.search(rf"Aggregate\(key[s]?=\[job_id#\d+L, {key}", part)]


@pytest.mark.parametrize("name", ["admit_counts", "enforce_rules", "framing_score", "isolated", "reject_examples", "stroke_style"])
def test_joins_by_drawing_or_box_stay_shuffled_while_they_run(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Final Plan" in plan
    assert "BroadcastHashJoin" not in plan


def test_sanitizer_joins_stay_shuffled_while_they_run(spark):
    gaps = spark.createDataFrame([(1, a, i, 8000.0) for a in "xy" for i in range(3)], "job_id long, axis string, idx long, spacing_mm double")
    beams = spark.createDataFrame([(1, 0, 100.0, 0.0, 7900.0, 0.0, 300.0), (1, 1, 0.0, 8100.0, 0.0, 15900.0, 300.0)], "job_id long, ord long, sx double, sy double, ex double, ey double, width double")
    cols = spark.createDataFrame([(1, 0, 0.0, 0.0, 400.0, 300.0), (1, 1, 8000.0, 0.0, 400.0, 300.0)], "job_id long, col_ord long, cx double, cy double, hw double, hd double")
    dashes = spark.createDataFrame([(1, "y", 6000.0, 20000.0, 0.0)], "job_id long, axis string, lo double, hi double, perp double")
    walls = spark.createDataFrame([(1, [(-100.0, 7000.0), (100.0, 7000.0), (100.0, 9000.0), (-100.0, 9000.0)])], "job_id long, points array<struct<x double, y double>>")
    df = sanitize.sanitize(beams, cols, dashes, gaps, core_walls=walls)
    assert {(r.ord, r.tag) for r in df.collect()} == {(0, None), (1, "dashline_no_anchor")}
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "BroadcastHashJoin" not in plan


def test_dashes_meet_ends_across_tiles(spark):
    o = Options()
    ends = [(1, i, a, w, x, y) for i, (a, w, x, y) in enumerate([(a, w, x, y) for a in "xy" for w in (0.0, 400.0) for x in (-16500.0, -150.0, 0.0, 16384.0) for y in (-600.0, -450.0, 449.0, 600.0, 750.0, 751.0)])]
    dashes = [(1, a, lo, lo + 6000.0, p) for a in "xy" for lo in (-16384.0 - 6200.0, -6100.0, 200.0) for p in (-600.0, 0.0, 600.0)]
    want = set()
    for _, i, a, w, x, y in ends:
        across, along = (y, x) if a == "x" else (x, y)
        if any(b == a and abs(across - p) <= o.dash_perp_mm and lo - w * o.dash_long <= along <= hi + w * o.dash_long for _, b, lo, hi, p in dashes):
            want.add(i)
    got = sanitize.on_dash(spark.createDataFrame(ends, "job_id long, ord long, axis string, width double, qx double, qy double"), spark.createDataFrame(dashes, "job_id long, axis string, lo double, hi double, perp double"), o).collect()
    assert {r.ord for r in got} == want and len(got) == len(want) and 0 < len(want) < len(ends)


def test_nearest_of_ascending_lines(spark):
    for lines in ([0.0, 10.0, 20.0], [5.0], [-3.0, -3.0, 4.0]):
        df = spark.createDataFrame([(lines, x) for x in (-100.0, -3.0, 0.0, 0.5, 5.0, 15.0, 15.1, 99.0)], "v array<double>, x double")
        assert all(r.a == r.b for r in df.select(nearest(F.col("v"), F.col("x")).alias("a"), nearest_ascending(F.col("v"), F.col("x")).alias("b")).collect())
    assert spark.sql("SELECT array() :: array<double> AS v, 1D AS x").select(nearest_ascending(F.col("v"), F.col("x")).alias("a")).first().a is None
