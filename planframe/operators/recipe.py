"""The recipe: element parameters in millimetres, scene extents, and the nested record of a drawing."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.binning import containing, first_by
from planframe.functions.geometry import in_polygon
from planframe.functions.text import normal_dims
from planframe.operators.annotate import box_points, zone_thickness
from planframe.operators.grid import prefix_mm
from planframe.options import DEFAULTS, ROUND_FAMILY, SQUARE_FAMILY, Options

#: Columns of each kind of element in the nested record.
KINDS = ("levels", "grids", "columns", "walls", "structural_framing", "slabs")


def column_params(columns: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, wx, wy, width, depth, shape, family_name, symbol, family) of columns ``(job_id, ord, wx, wy, width_mm, depth_mm, diameter_mm, is_circular)``.

    A circle's diameter comes first, then a width with a depth, else the least size; all sizes are raised to that.
    Annotated rectangles keep to standard sizes near them; circles and columns without a size take the nearest one.
    Without a column ``diameter_mm`` a circle's width is its diameter.
    """
    if "diameter_mm" not in columns.columns:
        columns = columns.withColumn("diameter_mm", F.col("width_mm"))
    least = F.lit(options.min_column_mm)
    circle = F.col("is_circular") & (F.col("diameter_mm") > 0)
    rect = ~F.coalesce(circle, F.lit(False)) & (F.col("width_mm") > 0) & (F.col("depth_mm") > 0)
    side = lambda c: F.greatest(F.when(circle, F.col("diameter_mm")).when(rect, F.col(c)).otherwise(least), least)
    shape = F.when(F.col("is_circular"), "circular").otherwise("rectangular")
    rows = columns.withColumns({"_w": side("width_mm"), "_d": side("depth_mm"), "shape": shape})
    n = normal_dims(F.col("_w"), F.col("_d"), F.col("shape"), F.when(rect, F.col("_w")), F.when(rect, F.col("_d")), options)
    rows = rows.withColumn("_n", n).withColumns({"width": F.bround("_n.width", 1), "depth": F.bround("_n.depth", 1)})
    size = lambda c: c.cast("long").cast("string")
    w, d = F.col("_n.width"), F.col("_n.depth")
    round_ = F.col("shape") == "circular"
    symbol = F.when(round_, F.concat(F.lit("Φ"), size(w))).otherwise(F.concat(size(F.greatest(w, d)), F.lit("x"), size(F.least(w, d)), F.lit("mm")))
    return rows.select("job_id", "ord", "wx", "wy", "width", "depth", "shape", F.when(round_, ROUND_FAMILY).otherwise(SQUARE_FAMILY).alias("family_name"), symbol.alias("symbol"), F.col("_n.suffix").alias("family"))


def beam_params(beams: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Boxes in millimetres as centre lines along their longer side; spans under 10 mm and rejected boxes go.

    The section is that of ``section_width_mm`` and ``section_depth_mm``, else the default; ``material`` (else rc) names the
    family. Columns that ``beams`` does not have count as null.
    """
    for c, kind in (("action", "string"), ("section_width_mm", "double"), ("section_depth_mm", "double"), ("material", "string")):
        if c not in beams.columns:
            beams = beams.withColumn(c, F.lit(None).cast(kind))
    low = lambda a, b: F.least(a, b)
    flat = F.abs(F.col("x2") - F.col("x1")) >= F.abs(F.col("y2") - F.col("y1"))
    mx, my = (F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2
    size = lambda c: F.coalesce(F.nullif(F.col(c), F.lit(0.0)), F.lit(options.default_beam_mm))
    width, depth = size("section_width_mm"), size("section_depth_mm")
    family = F.concat(F.when(F.col("material") == "steel", "SteelBeam").otherwise("RCBeam"), F.greatest(width, depth).cast("long").cast("string"), F.lit("x"), F.least(width, depth).cast("long").cast("string"), F.lit("mm"))
    out = beams.where(F.coalesce(F.col("action") != "reject", F.lit(True))).select(
        "job_id", "ord", F.when(flat, low("x1", "x2")).otherwise(mx).alias("sx"), F.when(flat, my).otherwise(low("y1", "y2")).alias("sy"), F.when(flat, F.greatest("x1", "x2")).otherwise(mx).alias("ex"), F.when(flat, my).otherwise(F.greatest("y1", "y2")).alias("ey"),
        F.bround(width, 1).alias("width"), F.bround(depth, 1).alias("depth"), family.alias("family_type"), F.coalesce("material", F.lit("rc")).alias("material"),
    )
    return out.where(F.abs(F.col("ex") - F.col("sx")) + F.abs(F.col("ey") - F.col("sy")) >= 10)


def beam_slabs(beams: DataFrame, slabs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Beams with ``slab_thickness``: that of the first of ``slabs(job_id, ord, points, thickness_mm)`` that holds the beam's middle, else the default."""
    middle = beams.select("job_id", "ord", ((F.col("sx") + F.col("ex")) / 2).alias("_mx"), ((F.col("sy") + F.col("ey")) / 2).alias("_my"))
    box = slabs.select("job_id", F.col("ord").alias("s_ord"), "points", "thickness_mm", F.array_min("points.x").alias("_x0"), F.array_max("points.x").alias("_x1"), F.array_min("points.y").alias("_y0"), F.array_max("points.y").alias("_y1"))
    hit = containing(middle, box, ["job_id"], "_mx", "_my", ("_x0", "_y0", "_x1", "_y1"), options.slab_tile).where(in_polygon(F.col("_mx"), F.col("_my"), F.col("points")))
    best = first_by(hit, ["job_id", "ord"], [F.col("s_ord")], ["thickness_mm"])
    out = beams.join(best, ["job_id", "ord"], "left")
    return out.withColumn("slab_thickness", F.bround(F.coalesce("thickness_mm", F.lit(options.default_slab_mm)), 1)).drop("thickness_mm")


def slab_params(slabs: DataFrame, zones: DataFrame, legend: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, points, thickness_mm): slab boxes ``(job_id, ord, x1 .. y2)`` in millimetres as polygons, with the thickness of their zone."""
    shaped = box_points(slabs.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null"))
    return shaped.select("job_id", "ord", "points").join(zone_thickness(shaped, zones, legend, options), ["job_id", "ord"])


def wall_params(walls: DataFrame, scale: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """``walls(job_id, ord, thickness, height)`` with ``thickness_mm`` to one decimal by their drawing's ``px_per_mm``; defaults for what is missing."""
    ratio = F.coalesce("px_per_mm", F.lit(options.default_px_per_mm))
    mm = F.when(ratio > 0, F.coalesce(F.col("thickness") / ratio, F.lit(options.default_wall_mm))).otherwise(options.default_wall_mm)
    out = walls.join(scale.select("job_id", "px_per_mm"), "job_id", "left")
    return out.withColumns({"thickness_mm": F.bround(mm, 1), "height": F.coalesce("height", F.lit(options.wall_height_mm))}).drop("px_per_mm")


def opening_params(openings: DataFrame, scale: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, kind, wx, wy, z, width, height) of doors and windows ``(job_id, ord, kind, wx, wy, x1 .. y2)``: at least 200 by 400 mm, to one decimal."""
    side = lambda a, b, least: F.bround(F.greatest(F.abs(F.col(b) - F.col(a)) / F.coalesce("px_per_mm", F.lit(options.default_px_per_mm)), F.lit(least)), 1)
    out = openings.join(scale.select("job_id", "px_per_mm"), "job_id", "left")
    return out.select("job_id", "ord", "kind", "wx", "wy", F.when(F.col("kind") == "door", 0.0).otherwise(options.sill_mm).alias("z"), side("x1", "x2", 200.0).alias("width"), side("y1", "y2", 400.0).alias("height"))


def levels(rooms: DataFrame, default_mm: float = DEFAULTS.default_storey_mm, profile: DataFrame | None = None) -> DataFrame:
    """(job_id, storey_mm): the height that the job's ``profile(job_id, storey_mm)`` sets, else of the first room of 2000 to 6000 mm, else the default."""
    first = rooms.where("ceiling_height between 2000 and 6000").groupBy("job_id").agg(F.min_by("ceiling_height", "ord").alias("h"))
    out = rooms.select("job_id").distinct().join(first, "job_id", "left")
    if profile is not None:
        out = out.join(profile.select("job_id", F.col("storey_mm").alias("_set")), "job_id", "left").withColumn("h", F.coalesce("_set", "h"))
    return out.select("job_id", F.coalesce("h", F.lit(default_mm)).alias("storey_mm"))


def grid_commands(grid: DataFrame, gaps: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, idx, name, sx, sy, ex, ey): grid lines in millimetres, y upwards; without a label they are named 1, 2, ... and A, B, ...

    Upright lines run over both ends of the drawing, level ones over its left end.
    """
    lines = grid if "label" in grid.columns else grid.withColumn("label", F.lit(None).cast("string"))
    total = gaps.groupBy("job_id").agg(*[F.sum(F.when(F.col("axis") == a, F.col("spacing_mm"))).alias(f"t{a}") for a in "xy"])
    rows = lines.join(prefix_mm(gaps), ["job_id", "axis", "idx"], "left").join(total, "job_id", "left")
    default = F.lit(4 * options.default_storey_mm)
    rows = rows.withColumns({"mm": F.coalesce("start_mm", F.lit(0.0)), "tx": F.coalesce("tx", default), "ty": F.coalesce("ty", default)})
    up, run = F.col("axis") == "x", F.lit(options.grid_run_mm)
    name = F.coalesce("label", F.when(up, (F.col("idx") + 1).cast("string")).otherwise(F.expr("char(65 + idx)")))
    y = F.col("ty") - F.col("mm")
    return rows.select("job_id", "axis", "idx", name.alias("name"), F.when(up, F.col("mm")).otherwise(-run).alias("sx"), F.when(up, -run).otherwise(y).alias("sy"), F.when(up, F.col("mm")).otherwise(F.col("tx")).alias("ex"), F.when(up, F.col("ty") + run).otherwise(y).alias("ey"))


def mesh_params(beams: DataFrame) -> DataFrame:
    """(job_id, ord, span, angle, cx, cy) of beams and walls of at least 1 mm: what a scene needs to place a box."""
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    out = beams.select("job_id", "ord", F.hypot(dx, dy).alias("span"), F.atan2(dy, dx).alias("angle"), ((F.col("sx") + F.col("ex")) / 2).alias("cx"), ((F.col("sy") + F.col("ey")) / 2).alias("cy"))
    return out.where("span >= 1")


def totals(**kinds: DataFrame) -> DataFrame:
    """(kind, n): how many elements of each kind there are, also of those without any."""
    out = None
    for name, rows in kinds.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def nested(job_ids: DataFrame, **kinds: DataFrame) -> DataFrame:
    """One row for each job with an ordered array of structs for each kind, for a JSON sink; a drawing bounds the arrays."""
    out = job_ids.select("job_id").distinct()
    for name in KINDS:
        if name in kinds:
            rows = kinds[name] if "ord" in kinds[name].columns else kinds[name].withColumn("ord", F.xxhash64(*[c for c in kinds[name].columns if c != "job_id"]))
            rows = rows.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("ord", *[c for c in rows.columns if c not in ("job_id", "ord")]))).alias(name))
            out = out.join(rows, "job_id", "left")
    return out
