"""Sizes from drawing labels: schedules, nearby labels, slab zones."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planframe.binning import containing, first_by, reaching, shuffled
from planframe.functions.geometry import distance, in_polygon
from planframe.functions.text import BEAM_MARK, code_thickness, dims, is_beam_label, mark
from planframe.operators.boxes import centred
from planframe.options import DEFAULTS, Options


def label_dims(spans: DataFrame) -> DataFrame:
    """Spans with ``mark``, ``width_mm``, ``depth_mm``, ``is_circular`` and ``is_beam``."""
    w, d, c = dims(F.col("text"))
    return spans.withColumns({"mark": mark(F.col("text")), "width_mm": w, "depth_mm": d, "is_circular": c, "is_beam": is_beam_label(F.col("text"))})


def schedule(spans: DataFrame) -> DataFrame:
    """(job_id, mark, width_mm, depth_mm, is_circular): the first definition of each column mark."""
    defined = label_dims(spans).where(F.col("mark").isNotNull() & F.col("width_mm").isNotNull() & ~F.col("mark").rlike(BEAM_MARK))
    return first_by(defined, ["job_id", "mark"], [F.col("ord")], ["width_mm", "depth_mm", "is_circular"])


def schedule_texts(first: DataFrame, pages: DataFrame, flags: DataFrame) -> DataFrame:
    """Spans for the schedule of each job, in order: those of the first page, then those of the pages ``(job_id, page_idx)`` that ``flags(is_schedule)`` names as schedules."""
    some = pages.join(flags.where("is_schedule").select("job_id", "page_idx"), ["job_id", "page_idx"], "left_semi")
    rows = first.withColumn("page_idx", F.lit(-1)).unionByName(some, allowMissingColumns=True)
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("job_id").orderBy("page_idx", "ord")).cast("long") - 1)


def annotate_columns(boxes: DataFrame, spans: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, width_mm, depth_mm, is_circular, type_mark, source) of every column.

    The nearest label with a size wins (proximity), else the nearest label whose mark the schedule has
    (schedule), else the schedule's size if it has just one type (schedule_fallback), else the default.
    """
    reach = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(options.search_floor_px)) * options.search_factor
    cols = centred(boxes).withColumn("reach", reach).select("job_id", "ord", "cx", "cy", "reach")
    labels = label_dims(spans).where("not is_beam").select("job_id", F.col("ord").alias("t_ord"), "sx", "sy", "mark", "width_mm", "depth_mm", "is_circular")
    labels = labels.where("width_mm is not null or mark is not null")
    table = schedule(spans)
    # Labels get what the schedule says of their mark before they meet columns: there are fewer labels than pairs.
    labels = labels.join(shuffled(table.select("job_id", "mark", *[F.col(c).alias(f"s_{c}") for c in ("width_mm", "depth_mm", "is_circular")])), ["job_id", "mark"], "left")
    near = reaching(cols, labels, ["job_id"], "cx", "cy", "reach", "sx", "sy", options.search_floor_px * options.search_factor)
    near = near.withColumn("d", distance(F.col("cx"), F.col("cy"), F.col("sx"), F.col("sy"))).where(F.col("d") < F.col("reach"))
    # One pass over the pairs finds both the nearest label with a size and the nearest one that the schedule knows.
    nearest = lambda p: F.min(F.when(F.col(f"{p}width_mm").isNotNull(), F.struct("d", "t_ord", *[F.col(f"{p}{c}").alias(c) for c in ("width_mm", "depth_mm", "is_circular")], "mark")))
    found = near.groupBy("job_id", "ord").agg(nearest("").alias("a"), nearest("s_").alias("b"))
    found = found.select("job_id", "ord", F.coalesce("a", "b").alias("v"), F.when(F.col("a").isNotNull(), "proximity").when(F.col("b").isNotNull(), "schedule").alias("source"))
    found = found.select("job_id", "ord", "v.width_mm", "v.depth_mm", "v.is_circular", "v.mark", "source")
    one = table.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("width_mm", "depth_mm", "is_circular")).alias("s")).where("n = 1").select("job_id", "s.*")
    out = cols.select("job_id", "ord").join(found, ["job_id", "ord"], "left")
    out = out.join(one.select("job_id", F.col("width_mm").alias("_w"), F.col("depth_mm").alias("_d"), F.col("is_circular").alias("_c")), "job_id", "left")
    size = F.lit(options.min_column_mm)
    return out.select(
        "job_id", "ord", F.coalesce("width_mm", "_w", size).alias("width_mm"), F.coalesce("depth_mm", "_d", size).alias("depth_mm"), F.coalesce("is_circular", "_c", F.lit(False)).alias("is_circular"),
        F.col("mark").alias("type_mark"), F.coalesce("source", F.when(F.col("_w").isNotNull(), "schedule_fallback").otherwise("default")).alias("source"),
    )


def zone_codes(zones: DataFrame, legend: DataFrame) -> DataFrame:
    """``zones(job_id, zone_ord, code, ...)`` with ``t``: the thickness that the code tells itself, else the one that its drawing's legend has for it."""
    told = legend.select("job_id", "code", F.col("thickness_mm").alias("_told"))
    return zones.join(told, ["job_id", "code"], "left").withColumn("t", code_thickness(F.col("code"), F.col("_told"))).drop("_told")


def zone_thickness(slabs: DataFrame, zones: DataFrame, legend: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, thickness_mm): that of the first zone label inside the slab whose code tells one, else the default.

    ``slabs(job_id, ord, points)`` hold polygons; a label must lie in the polygon's box before the ray is cast.
    ``legend(job_id, code, thickness_mm)`` is that of each drawing, as ``strokes.clause_totals`` gives it.
    """
    coded = zone_codes(zones, legend).where("t is not null")
    p = slabs.withColumns({"_x0": F.array_min("points.x"), "_x1": F.array_max("points.x"), "_y0": F.array_min("points.y"), "_y1": F.array_max("points.y")})
    hit = containing(coded.select("job_id", "zone_ord", "zx", "zy", "t"), p, ["job_id"], "zx", "zy", ("_x0", "_y0", "_x1", "_y1"), options.slab_tile)
    hit = hit.where(in_polygon(F.col("zx"), F.col("zy"), F.col("points")))
    best = first_by(hit, ["job_id", "ord"], [F.col("zone_ord")], ["t"])
    return slabs.select("job_id", "ord").join(best, ["job_id", "ord"], "left").select("job_id", "ord", F.coalesce("t", F.lit(options.default_slab_mm)).alias("thickness_mm"))


def provenance(annotated: DataFrame) -> DataFrame:
    """(source, n): how many columns took their size from each source."""
    return annotated.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def box_points(boxes: DataFrame) -> DataFrame:
    """Boxes with their corners as a polygon, ``points``."""
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return boxes.withColumn("points", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")))
