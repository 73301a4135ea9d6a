"""Detections: filtering, typing, suppression, culling and the checks between them."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.binning import first_by, overlapping, shuffled, within
from planframe.functions.geometry import distance, iou
from planframe.options import DEFAULTS, Options
from planframe.session import cut

BOX = ["x1", "y1", "x2", "y2"]


def centred(boxes: DataFrame) -> DataFrame:
    return boxes.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})


def box_filter(boxes: DataFrame, scale: float = 1.0, options: Options = DEFAULTS) -> DataFrame:
    """Boxes whose sides are within the bounds of their type and square enough for it, scaled, with their centre."""
    kind = F.regexp_replace(F.lower("type"), "s+$", "")
    of_type = lambda column, framing, other: F.when(kind == "column", column).when(kind == "structural_framing", framing).otherwise(other)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    square = F.least(w, h) / F.greatest(w, h, F.lit(1e-9)) >= of_type(options.column_squareness, options.framing_squareness, options.squareness)
    sized = (F.least(w, h) >= options.min_side_px) & (F.greatest(w, h) <= of_type(options.column_max_side_px, options.framing_max_side_px, options.max_side_px))
    scaled = boxes.where(sized & square).withColumns({c: F.col(c) * scale for c in BOX})
    return centred(scaled)


def dispatch(boxes: DataFrame) -> DataFrame:
    """Typed elements: the kind without its plural, a running id within kind (framing: always 0), walls' axis and thickness."""
    kind = F.regexp_replace(F.lower("type"), "s+$", "")
    known = boxes.withColumn("kind", kind).where(F.col("kind").isin("column", "wall", "structural_framing", "stair", "lift", "slab", "door"))
    rn = F.row_number().over(Window.partitionBy("job_id", "kind").orderBy("ord")) - 1
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return known.withColumns({"id": F.when(F.col("kind") == "structural_framing", 0).otherwise(rn), "flat": w >= h, "thickness": F.least(w, h)})


def suppress(boxes: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Greedy suppression of overlapping boxes of a job and type, most confident first, the first of equals.

    The overlaps are found by a tiled join. A box with no better box among its overlaps that is still open stays and
    takes out the boxes that it overlaps; that repeats over the edges still open until there are none, so all drawings
    and all clusters are settled at once, in as many rounds as the longest chain of overlaps has links.
    """
    kind = ["job_id", "type"]
    a = boxes.select(*kind, F.col("ord").alias("a_ord"), F.col("confidence").alias("a_conf"), *[F.col(c).alias(f"a_{c}") for c in BOX])
    b = boxes.select(*kind, F.col("ord").alias("b_ord"), F.col("confidence").alias("b_conf"), *[F.col(c).alias(f"b_{c}") for c in BOX])
    pairs = overlapping(a, b, kind, "a_", "b_", 256.0).where(iou("a_", "b_") > options.nms_iou)
    better = (F.col("a_conf") > F.col("b_conf")) | ((F.col("a_conf") == F.col("b_conf")) & (F.col("a_ord") < F.col("b_ord")))
    edges = cut(pairs.where(better).select(*kind, "a_ord", "b_ord"))
    gone = edges.select(*kind, F.col("b_ord").alias("ord")).limit(0)
    while True:  # each round settles the best open box of every cluster at least
        if edges.isEmpty():
            return boxes.join(gone, [*kind, "ord"], "left_anti")
        worse = edges.select(*kind, F.col("b_ord").alias("a_ord")).distinct()
        out = edges.join(worse, [*kind, "a_ord"], "left_anti").select(*kind, "b_ord").distinct()
        out = cut(out)
        gone = gone.unionByName(out.withColumnRenamed("b_ord", "ord"))
        edges = edges.join(out, [*kind, "b_ord"], "left_anti").join(out.withColumnRenamed("b_ord", "a_ord"), [*kind, "a_ord"], "left_anti")
        edges = cut(edges)


def extent(grid: DataFrame) -> DataFrame:
    """A row for each job: the least and greatest line of each axis and how many there are."""
    pick = lambda f, a: f(F.when(F.col("axis") == a, F.col("px")))
    return grid.groupBy("job_id").agg(pick(F.min, "x").alias("gx0"), pick(F.max, "x").alias("gx1"), pick(F.min, "y").alias("gy0"), pick(F.max, "y").alias("gy1"), F.count_if(F.col("axis") == "x").alias("nx"), F.count_if(F.col("axis") == "y").alias("ny"))


def outside_grid(boxes: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Rows with ``kept``: inside the grid's rectangle with a margin; nothing is culled with under two lines on an axis."""
    t = options.outside_tol_px
    joined = centred(boxes).join(extent(grid), "job_id", "left")
    inside = F.col("cx").between(F.col("gx0") - t, F.col("gx1") + t) & F.col("cy").between(F.col("gy0") - t, F.col("gy1") + t)
    return joined.withColumn("kept", F.coalesce((F.col("nx") < 2) | (F.col("ny") < 2), F.lit(True)) | inside).drop("gx0", "gx1", "gy0", "gy1", "nx", "ny")


def overlap_pairs(boxes: DataFrame, threshold: float) -> DataFrame:
    """(job_id, a_ord, b_ord, iou) of pairs in order whose overlap exceeds the threshold."""
    side = lambda p: boxes.select("job_id", F.col("ord").alias(f"{p}ord"), *[F.col(c).alias(f"{p}{c}") for c in BOX])
    pairs = overlapping(side("a_"), side("b_"), ["job_id"], "a_", "b_", 256.0).where("a_ord < b_ord")
    return pairs.withColumn("iou", iou("a_", "b_")).where(F.col("iou") > threshold).select("job_id", "a_ord", "b_ord", "iou")


def isolated(boxes: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord) of boxes with no other within the radius, in jobs of two or more."""
    points = centred(boxes).select("job_id", "ord", "cx", "cy")
    other = points.select("job_id", F.col("ord").alias("o_ord"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    near = within(points, other, ["job_id"], "cx", "cy", "ox", "oy", options.isolated_px)
    near = near.where((F.col("ord") != F.col("o_ord")) & (distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy")) <= options.isolated_px))
    jobs = points.groupBy("job_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("job_id")
    return points.join(shuffled(jobs), "job_id", "left_semi").join(shuffled(near.select("job_id", "ord").distinct()), ["job_id", "ord"], "left_anti").select("job_id", "ord")


def lines(grid: DataFrame) -> DataFrame:
    """A row for each job: the ascending lines of both axes."""
    pick = lambda a: F.sort_array(F.collect_list(F.when(F.col("axis") == a, F.col("px"))))
    return grid.groupBy("job_id").agg(pick("x").alias("xs"), pick("y").alias("ys"))


def off_grid(boxes: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Rows with ``dx``, ``dy`` to the nearest lines and ``off_grid``: both exceed the bound; an axis without lines counts as 0."""
    joined = centred(boxes).join(shuffled(lines(grid)), "job_id", "left")
    gap = lambda ls, c: F.coalesce(F.array_min(F.transform(ls, lambda v: F.abs(v - F.col(c)))), F.lit(0.0))
    joined = joined.withColumns({"dx": gap("xs", "cx"), "dy": gap("ys", "cy")}).drop("xs", "ys")
    return joined.withColumn("off_grid", (F.col("dx") > options.off_grid_px) & (F.col("dy") > options.off_grid_px))


def validate(boxes: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, flags, is_valid): flags in the order iou_overlap, off_grid, isolated."""
    pairs = overlap_pairs(boxes, options.overlap_iou)
    hit = pairs.select("job_id", F.explode(F.array("a_ord", "b_ord")).alias("ord")).distinct().withColumn("_o", F.lit("iou_overlap"))
    alone = isolated(boxes, options).withColumn("_i", F.lit("isolated"))
    rows = off_grid(boxes, grid, options).select("job_id", "ord", F.when(F.col("off_grid"), "off_grid").alias("_g"))
    joined = rows.join(shuffled(hit), ["job_id", "ord"], "left").join(shuffled(alone), ["job_id", "ord"], "left")
    flags = F.concat_ws(",", "_o", "_g", "_i")
    return joined.select("job_id", "ord", flags.alias("flags"), (flags == "").alias("is_valid"))


def bay_rules(gaps: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, idx, violation) of bays narrower or wider than allowed."""
    text = lambda s: F.concat(F.lit(s), F.bround("spacing_mm").cast("long").cast("string"), F.lit("mm"))
    bad = F.when(F.col("spacing_mm") < options.min_bay_mm, text("bay_too_narrow_")).when(F.col("spacing_mm") > options.max_bay_mm, text("bay_too_wide_"))
    return gaps.select("job_id", "axis", "idx", bad.alias("violation")).where("violation is not null")


def enforce_rules(boxes: DataFrame, grid: DataFrame, gaps: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, violations, is_orphan, is_compliant): a drawing's bay violations hold for each of its boxes, x bays before y bays.

    A box off the grid that is also isolated is an orphan.
    """
    bays = bay_rules(gaps, options).groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("axis", "idx", "violation"))), lambda v: v["violation"]), ",").alias("violations"))
    flags = validate(boxes, grid, options)
    orphan = F.col("flags").contains("off_grid") & F.col("flags").contains("isolated")
    out = flags.join(shuffled(bays), "job_id", "left")
    return out.select("job_id", "ord", F.coalesce("violations", F.lit("")).alias("violations"), orphan.alias("is_orphan"), F.col("violations").isNull().alias("is_compliant"))


def stacked(*kinds: DataFrame) -> DataFrame:
    """The rows of several agents' boxes ``(job_id, ord, ...)`` in the order given, with ``all_ord``: 0, 1, ... within each job over all of them."""
    out = None
    for rank, rows in enumerate(kinds):
        rows = rows.withColumn("_rank", F.lit(rank))
        out = rows if out is None else out.unionByName(rows)
    return out.withColumn("all_ord", F.row_number().over(Window.partitionBy("job_id").orderBy("_rank", "ord")) - 1).drop("_rank")


def drop_by_id(elements: DataFrame, gone: DataFrame) -> DataFrame:
    """The elements whose (job_id, ord) is not among those of ``gone``."""
    return elements.join(gone.select("job_id", "ord"), ["job_id", "ord"], "left_anti")


def first_seen(rows: DataFrame, keys: list[str], x: str = "cx", y: str = "cy") -> DataFrame:
    """Rows whose position, rounded to one decimal, no earlier row of the job has."""
    rn = F.row_number().over(Window.partitionBy(*keys, F.bround(x, 1), F.bround(y, 1)).orderBy("ord"))
    return rows.withColumn("_rn", rn).where("_rn = 1").drop("_rn")


def nearest_tag(boxes: DataFrame, tags: DataFrame, radius: float) -> DataFrame:
    """(job_id, ord, tag, dist) of the nearest tag within the radius, the first of equals; boxes without one have nulls."""
    points = centred(boxes).select("job_id", "ord", "cx", "cy")
    near = within(points, tags.select("job_id", F.col("ord").alias("t_ord"), "sx", "sy", F.upper(F.trim("text")).alias("tag")), ["job_id"], "cx", "cy", "sx", "sy", radius)
    near = near.withColumn("dist", distance(F.col("cx"), F.col("cy"), F.col("sx"), F.col("sy"))).where(F.col("dist") <= radius)
    best = first_by(near, ["job_id", "ord"], [F.col("dist"), F.col("t_ord")], ["tag", "dist"])
    return points.select("job_id", "ord").join(shuffled(best), ["job_id", "ord"], "left")


def tag_material(tag: Column, legend: Column) -> Column:
    """The legend's material, else what the tag's letters say: RC anywhere, or a prefix SB or S-."""
    return F.coalesce(legend, F.when(tag.contains("RC"), "rc").when(tag.startswith("SB") | tag.startswith("S-"), "steel"))


def nearest_other(points: DataFrame, targets: DataFrame, reach: float) -> DataFrame:
    """(job_id, ord, near_ord, dist) of the nearest target, at any distance; the first of equals.

    Rings of growing reach: each join only takes the points that the rings before left without a target, and
    within a reach r every target up to r is met, so the nearest found within r is the nearest of all. The
    rings go on until one covers the widest drawing; what a ring found is written once, as the next start from it.
    """
    keys = ["job_id", "ord"]
    t = targets.select("job_id", F.col("ord").alias("near_ord"), F.col("cx").alias("_ox"), F.col("cy").alias("_oy"))
    span = targets.select("cx", "cy").unionByName(points.select("cx", "cy"))
    low_x, high_x, low_y, high_y = span.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    widest = ((high_x or 0) - (low_x or 0)) + ((high_y or 0) - (low_y or 0))
    left, found, r = points.select(*keys, "cx", "cy"), None, reach
    while True:
        near = within(left, t, ["job_id"], "cx", "cy", "_ox", "_oy", r)
        near = near.withColumn("dist", distance(F.col("cx"), F.col("cy"), F.col("_ox"), F.col("_oy"))).where(F.col("dist") <= r)
        best = first_by(near, keys, [F.col("dist"), F.col("near_ord")], ["near_ord", "dist"])
        last = r > widest
        best = best if last else cut(best)
        found = best if found is None else found.unionByName(best)
        if last:
            return points.select(*keys).join(shuffled(found), keys, "left")
        left = left.join(shuffled(best), keys, "left_anti")
        r *= 8
