"""The structural grid: line positions, bay spacings, pixels to millimetres, snapping."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planframe.binning import first_by, shuffled, tile
from planframe.functions.geometry import cell_world, nearest
from planframe.options import DEFAULTS, Options


def prefix_mm(gaps: DataFrame) -> DataFrame:
    """(job_id, axis, idx, start_mm): each line's millimetres, the sum of the bays before it; the last line is there too."""
    before = Window.partitionBy("job_id", "axis").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    starts = gaps.select("job_id", "axis", "idx", F.coalesce(F.sum("spacing_mm").over(before), F.lit(0.0)).alias("start_mm"))
    last = gaps.groupBy("job_id", "axis").agg((F.max("idx") + 1).alias("idx"), F.sum("spacing_mm").alias("start_mm"))
    return starts.unionByName(last)


def frame(grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """A row for each job: pixels and millimetres of both axes in order, total height and smallest bay."""
    joined = grid.join(prefix_mm(gaps), ["job_id", "axis", "idx"])
    pick = lambda a: F.array_sort(F.collect_list(F.when(F.col("axis") == a, F.struct("idx", "px", "start_mm"))))
    rows = joined.groupBy("job_id").agg(pick("x").alias("x"), pick("y").alias("y"))
    bays = gaps.groupBy("job_id").agg(F.min("spacing_mm").alias("min_bay"))
    return rows.join(bays, "job_id").select(
        "job_id", F.col("x.px").alias("x_px"), F.col("x.start_mm").alias("x_mm"), F.col("y.px").alias("y_px"), F.col("y.start_mm").alias("y_mm"), F.element_at("y.start_mm", -1).alias("height"), "min_bay"
    )


def to_world(points: DataFrame, grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """``points(job_id, cx, cy)`` of drawings with a grid, with ``wx``, ``wy`` in millimetres, y upwards."""
    joined = points.join(frame(grid, gaps), "job_id")
    out = joined.withColumns({"wx": cell_world(F.col("x_px"), F.col("x_mm"), F.col("cx")), "wy": F.col("height") - cell_world(F.col("y_px"), F.col("y_mm"), F.col("cy"))})
    return out.drop("x_px", "y_px")


def world_boxes(boxes: DataFrame, grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """``boxes(job_id, x1 .. y2)`` of drawings with a grid, with both corners in millimetres, ``wx1 .. wy2``, y upwards."""
    joined = boxes.join(frame(grid, gaps), "job_id")
    at = lambda n: cell_world(F.col("x_px"), F.col("x_mm"), F.col(n)) if n[0] == "x" else F.col("height") - cell_world(F.col("y_px"), F.col("y_mm"), F.col(n))
    return joined.withColumns({f"w{n}": at(n) for n in ("x1", "y1", "x2", "y2")}).drop("x_px", "y_px", "x_mm", "y_mm", "height", "min_bay")


def snap(points: DataFrame, grid: DataFrame, gaps: DataFrame) -> DataFrame:
    """Points in millimetres moved to the nearest line of each axis, if it is within half the smallest bay."""
    world = to_world(points, grid, gaps)

    def to(lines: Column, v: str) -> Column:
        line = nearest(lines, F.col(v))
        return F.when(F.abs(line - F.col(v)) <= F.col("min_bay") / 2, line).otherwise(F.col(v))

    ys = F.transform("y_mm", lambda m: F.col("height") - m)
    return world.withColumns({"snap_x": to(F.col("x_mm"), "wx"), "snap_y": to(ys, "wy")}).drop("x_mm", "y_mm", "height", "min_bay")


def upper_median(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """For each key the element at index n/2 of its sorted values, without interpolation."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"_rn": F.row_number().over(w.orderBy(value)), "_n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("_rn") == F.floor(F.col("_n") / 2) + 1).select(*keys, F.col(value).alias(out))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """For each key the commonest value, the first seen of equals."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return first_by(counts, keys, [-F.col("_n"), F.col("_first")], [value]).withColumnRenamed(value, out)


def gap_bounds(grid: DataFrame) -> DataFrame:
    """(job_id, axis, gap, lo, hi, width) between neighbouring lines."""
    nxt = F.lead("px").over(Window.partitionBy("job_id", "axis").orderBy("idx"))
    return grid.withColumn("_next", nxt).where("_next is not null").select("job_id", "axis", F.col("idx").alias("gap"), F.least("px", "_next").alias("lo"), F.greatest("px", "_next").alias("hi"), F.abs(F.col("_next") - F.col("px")).alias("width"))


def assign_gaps(texts: DataFrame, grid: DataFrame, size: float = 256.0) -> DataFrame:
    """Dimension texts (job_id, ord, axis, pos, mm) with the first gap whose midpoint is nearer than half its width (at least 1).

    A gap lies on every tile of the axis that it touches, so a text meets the gaps on its own tile alone.
    """
    gaps = gap_bounds(grid).withColumn("_t", F.explode(F.sequence(tile(F.col("lo") - 1, size), tile(F.col("hi") + 1, size))))
    hit = F.abs(F.col("pos") - (F.col("lo") + F.col("hi")) / 2) < F.greatest(F.col("width") / 2, F.lit(1.0))
    joined = texts.withColumn("_t", tile(F.col("pos"), size)).join(shuffled(gaps), ["job_id", "axis", "_t"])
    return first_by(joined.where(hit), ["job_id", "axis", "ord", "mm"], [F.col("gap")], ["gap", "width"])


def infer_spacings(texts: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, gap, mm, source) of every gap of every job with texts.

    annotated: the candidate nearest to what the commonest value and the gap's width let expect, within the
    tolerance; inferred: the annotated bay whose width ratio is nearest to 1 (to nine decimals, the first of equals), within
    0.5 to 1.5; else fallback. An axis of a drawing has few gaps and texts, so each is one row's work; sums go by gap, so
    that the answer does not hang on how rows are dealt.
    """
    axis = ["job_id", "axis"]
    gaps = gap_bounds(grid).groupBy(*axis).agg(F.array_sort(F.collect_list(F.struct("gap", "lo", "hi", "width"))).alias("gaps"))
    sizes = texts.groupBy(*axis).agg(F.array_sort(F.collect_list(F.struct("ord", F.col("pos").cast("double").alias("pos"), F.col("mm").cast("double").alias("mm")))).alias("texts"))
    rows = gaps.join(sizes, axis)
    hits = lambda t: F.filter("gaps", lambda g: F.abs(t["pos"] - (g["lo"] + g["hi"]) / 2) < F.greatest(g["width"] / 2, F.lit(1.0)))
    given = F.transform("texts", lambda t: F.struct(F.get(hits(t), 0).alias("g"), t["ord"].alias("ord"), t["mm"].alias("mm")))
    rows = rows.withColumn("given", F.filter(given, lambda c: c["g"].isNotNull()))
    of = lambda v: F.filter("given", lambda c: c["mm"] == v)
    seen = lambda v: F.array_min(F.transform(of(v), lambda c: F.struct(c["g"]["gap"].alias("gap"), c["ord"].alias("ord"))))
    modes = F.transform(F.array_distinct("given.mm"), lambda v: F.struct((-F.size(of(v))).alias("n"), seen(v).alias("first"), v.alias("mm")))
    widths = F.array_sort("gaps.width")
    rows = rows.withColumns({"modal": F.array_min(modes)["mm"], "median": F.get(widths, F.floor(F.size(widths) / 2).cast("int"))})
    expected = lambda g: F.col("modal") * g["width"] / F.greatest(F.col("median"), F.lit(1.0))
    off = lambda g, c: F.abs(c["mm"] - expected(g))
    fits = lambda g: F.filter("given", lambda c: (c["g"]["gap"] == g["gap"]) & (off(g, c) / F.greatest(expected(g), F.lit(1.0)) <= options.plausible))
    best = lambda g: F.array_min(F.transform(fits(g), lambda c: F.struct(off(g, c).alias("off"), c["ord"].alias("ord"), c["mm"].alias("mm"))))["mm"]
    rows = rows.withColumn("bays", F.transform("gaps", lambda g: F.struct(g["gap"].alias("gap"), g["width"].alias("width"), best(g).alias("mm"))))
    rows = rows.withColumn("known", F.filter("bays", lambda b: b["mm"].isNotNull()))
    total = F.aggregate("known", F.lit(0.0), lambda s, b: s + F.when(b["mm"] > 0, b["width"] / b["mm"]).otherwise(0.0))
    rows = rows.withColumn("ratio", total / F.nullif(F.size("known"), F.lit(0)))
    share = lambda b, k: b["width"] / F.nullif(k["mm"] * F.col("ratio"), F.lit(0.0))
    alike = lambda b: F.filter("known", lambda k: (k["mm"] * F.col("ratio") > 0) & share(b, k).between(0.5, 1.5))
    near = lambda b: F.array_min(F.transform(alike(b), lambda k: F.struct(F.round(F.abs(share(b, k) - 1), 9).alias("off"), k["gap"].alias("gap"), k["mm"].alias("mm"))))["mm"]
    told = F.transform("bays", lambda b: F.struct(b["gap"].alias("gap"), b["mm"].alias("mm"), F.when(b["mm"].isNull(), near(b)).alias("inferred")))
    out = rows.select(*axis, F.explode(told).alias("b"))
    source = F.when(F.col("b.mm").isNotNull(), "annotated").when(F.col("b.inferred").isNotNull(), "inferred").otherwise("fallback")
    return out.select(*axis, "b.gap", F.coalesce("b.mm", "b.inferred", F.lit(options.fallback_bay_mm)).alias("mm"), source.alias("source"))


def fallback_lines(spark: SparkSession, x: int = 42, y: int = 30, pitch_px: float = 100.0) -> DataFrame:
    """(axis, idx, px, label): a uniform grid; labels 1, 2, ... and A .. Z, AA, BB, ..."""
    n = spark.range(x).select(F.lit("x").alias("axis"), F.col("id").alias("idx"), (F.col("id") * pitch_px).alias("px"), (F.col("id") + 1).cast("string").alias("label"))
    letter = F.expr("repeat(char(65 + id % 26), cast(1 + floor(id / 26) as int))")
    return n.unionByName(spark.range(y).select(F.lit("y").alias("axis"), F.col("id").alias("idx"), (F.col("id") * pitch_px).alias("px"), letter.alias("label")))
