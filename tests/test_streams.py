"""Streams against their batch twins, and the path and recipe operators on small cases."""

import json
import os

import pytest
from pyspark.sql import functions as F

from planframe.operators import jobs, recipe, strokes
from planframe.sources import readers
from planframe.streaming import events


def run(stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_job_store_stream_equals_the_fold(spark, tmp_path):
    ops = [(1, 1, "put", {"a": "1"}), (1, 2, "update", {"b": "2"}), (2, 3, "update", {"x": "0"}), (2, 4, "put", {"x": "1"}), (1, 5, "get", {}), (1, 6, "put", {"c": "3"}), (2, 7, "contains", {})]
    for k in (0, 1):
        part = [{"job_id": j, "ord": o, "op": op, "payload": json.dumps(p)} for j, o, op, p in ops if o <= 3] if k == 0 else [{"job_id": j, "ord": o, "op": op, "payload": json.dumps(p)} for j, o, op, p in ops if o > 3]
        (tmp_path / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        os.utime(tmp_path / f"{k}.json", (1000 + k, 1000 + k))  # a file source takes the older file first
    schema = "job_id long, ord long, op string, payload string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path))
    rows = run(events.store(stream), "update", "store_out").collect()
    last = {}
    for r in rows:
        if r.job_id not in last or r.accessed_ord >= last[r.job_id].accessed_ord:
            last[r.job_id] = r
    batch = jobs.fold(spark.read.schema(schema).json(str(tmp_path))).collect()
    want = {}
    for r in batch:
        want.setdefault(r.job_id, ({}, r.created_ord, r.accessed_ord))[0][r.key] = r.value
    assert {j: (json.loads(r.data), r.created_ord, r.accessed_ord) for j, r in last.items()} == want


def test_progress_counts(spark, tmp_path):
    rows = [{"job_id": "j", "event": e, "ts": f"2024-01-01T00:00:{s:02d}Z"} for e, s in (("warning", 1), ("warning", 2), ("nonsense", 3), ("error", 4))]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, rows)))
    stream = readers.stream(spark, "pipeline_events", str(tmp_path))
    got = run(events.progress(stream), "complete", "progress_out")
    assert {(r.event, r.n) for r in got.collect()} == {("warning", 2), ("error", 1)}


def test_dashes_and_strokes(spark):
    df = spark.createDataFrame([("[3 2] 0", True), ("[] 0", False), ("", False), (None, False), ("[]", False), ("[5] 1", True)], "d string, want boolean")
    assert all(r.got == r.want for r in df.select(strokes.is_dashed(F.col("d")).alias("got"), "want").collect())


def test_walls_take_the_nearest_line_along_them(spark):
    walls = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 20.0), (1, 1, 500.0, 0.0, 510.0, 90.0)], "job_id long, ord long, x1 double, y1 double, x2 double, y2 double")
    lines = spark.createDataFrame([(1, "h", -50.0, 80.0, 8.0), (1, "h", 10.0, 300.0, 19.0), (1, "v", 0.0, 50.0, 900.0)], "job_id long, dir string, lo double, hi double, perp double")
    got = {r.ord: (r.lo, r.hi, r.perp) for r in strokes.wall_lines(walls, lines).collect()}
    assert got == {0: (0.0, 80.0, 8.0), 1: (None, None, None)}


def test_notes_and_clauses(spark):
    text = "ALL NSP2 SHALL BE 130 THK + TOPPING 120, ALL NSP5 150 + TOPPING 200."
    words = [(1, 0, 10.0, 0.0, "NOTES:", 0, 0)] + [(1, i + 1, 10.0 + i, 20.0, w, 1, 0) for i, w in enumerate(text.split())] + [(1, 90, 10.0, 500.0, "ALL", 2, 0), (1, 91, 900.0, 30.0, "NSP9", 3, 0)]
    df = spark.createDataFrame(words, "job_id long, word_ord long, x0 double, y0 double, text string, block_no int, line_no int")
    block = strokes.notes_block(df)
    assert block.where("text = 'NSP9' or y0 > 400").count() == 0
    assert {r.code: r.thickness_mm for r in strokes.clause_totals(block).collect()} == {"NSP2": 250.0, "NSP5": 350.0}


def test_legend_lines(spark):
    spans = [(1, 0, 0.0, 0.0, 10.0, "RCB1"), (1, 1, 50.0, 2.0, 12.0, "concrete beam"), (1, 2, 0.0, 40.0, 50.0, "SB2"), (1, 3, 30.0, 41.0, 51.0, "steel"), (1, 4, 0.0, 80.0, 90.0, "X9")]
    df = spark.createDataFrame(spans, "job_id long, ord long, x0 double, y0 double, y1 double, text string")
    assert {r.tag: r.material for r in strokes.legend(strokes.text_lines(df)).collect()} == {"RCB1": "rc", "SB2": "steel"}


def test_recipe_rows(spark):
    cols = spark.createDataFrame([(1, 0, 0.0, 0.0, 300.0, 300.0, False), (1, 1, 0.0, 0.0, 900.0, 1400.0, False), (1, 2, 5.0, 5.0, 1010.0, 1010.0, True)], "job_id long, ord long, wx double, wy double, width_mm double, depth_mm double, is_circular boolean")
    got = {r.ord: (r.width, r.depth, r.family) for r in recipe.column_params(cols).collect()}
    assert got == {0: (800.0, 800.0, "RECT800x800mm"), 1: (900.0, 1400.0, "RECT900x1400mm"), 2: (1000.0, 1000.0, "CIRC1000")}
    rooms = spark.createDataFrame([(1, 0, 100.0), (1, 1, 3200.0), (2, 0, None)], "job_id long, ord long, ceiling_height double")
    assert {r.job_id: r.storey_mm for r in recipe.levels(rooms).collect()} == {1: 3200.0, 2: 5000.0}
    nested = recipe.nested(cols, columns=recipe.column_params(cols)).first()
    assert [c.ord for c in nested.columns] == [0, 1, 2]


@pytest.mark.parametrize(("w", "h", "want"), [(10, 10, 300), (30, 40, 250), (200, 300, None)])
def test_resolution_ladder(w, h, want):
    dpi = readers.render_dpi(w, h)
    assert dpi is None or (w * h * dpi * dpi <= 100_000_000 and w * h * dpi * dpi * 4.5 / 2**20 <= 600)
    assert (dpi is None) == (want is None)


def test_files_and_tiles(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.bin").write_bytes(b"zzzz")
    assert {r.status for r in readers.uploads(spark, str(tmp_path)).collect()} == {"pdf", "not_pdf"}
    pages = spark.createDataFrame([(1, 4100, 1999)], "job_id long, width_px int, height_px int")
    assert sorted((r.ty, r.tx) for r in readers.tiles(spark, pages).collect()) == [(0, 0), (0, 1), (0, 2)]
