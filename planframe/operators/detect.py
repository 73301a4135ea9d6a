"""The structural grid of each drawing from its texts: axis labels in the margins tell the lines, dimension texts the bays."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.functions.text import COLUMN_LABEL, DIMENSION, ROW_LABEL
from planframe.operators.grid import infer_spacings, upper_median
from planframe.options import DEFAULTS, Options
from planframe.session import cut


def page_bounds(pages: DataFrame, paths: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, x0, y0, w_pt, h_pt): the extent of each job's paths ``(job_id, x1, y1, x2, y2)``, or the default sheet without any."""
    box = paths.groupBy("job_id").agg(F.min("x1").alias("x0"), F.min("y1").alias("y0"), (F.max("x2") - F.min("x1")).alias("w"), (F.max("y2") - F.min("y1")).alias("h"))
    zero = F.lit(0.0)
    out = pages.select("job_id").join(box, "job_id", "left")
    return out.select("job_id", F.coalesce("x0", zero).alias("x0"), F.coalesce("y0", zero).alias("y0"), F.coalesce("w", F.lit(options.sheet_w_pt)).alias("w_pt"), F.coalesce("h", F.lit(options.sheet_h_pt)).alias("h_pt"))


def to_image(x: Column, y: Column, w: Column, h: Column, scale: Column, rotation: Column) -> tuple[Column, Column]:
    """A point of the unrotated sheet, in points from its corner, in pixels of the page as displayed."""
    turn = lambda a, b, c, d: F.when(rotation == 90, a).when(rotation == 180, b).when(rotation == 270, c).otherwise(d)
    return turn(w - y, w - x, y, x) * scale, turn(x, h - y, h - x, y) * scale


def placed(texts: DataFrame, pages: DataFrame) -> DataFrame:
    """``texts(job_id, ord, text, x0, y0, x1, y1)`` with their trimmed text, their centre in pixels and their page's measures."""
    scale = F.col("dpi") / 72.0
    sheet = pages.select("job_id", F.col("rotation"), scale.alias("scale"), F.col("width_px").alias("img_w"), F.col("height_px").alias("img_h"), "w_pt", "h_pt")
    rows = texts.withColumns({"text": F.trim("text"), "_cx": (F.col("x0") + F.col("x1")) / 2, "_cy": (F.col("y0") + F.col("y1")) / 2}).join(sheet, "job_id")
    ix, iy = to_image(F.col("_cx"), F.col("_cy"), F.col("w_pt"), F.col("h_pt"), F.col("scale"), F.col("rotation"))
    return rows.select("job_id", "ord", "text", ix.alias("ix"), iy.alias("iy"), "scale", "img_w", "img_h")


def _around_median(rows: DataFrame, keys: list[str], value: str, tol: Column) -> DataFrame:
    """The rows whose value is within ``tol`` of their group's upper median."""
    return rows.join(upper_median(rows, keys, value, "_m"), keys).where(F.abs(F.col(value) - F.col("_m")) <= tol).drop("_m")


def margins(rows: DataFrame, pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, bx0, bx1, top, bottom, tol): where the label columns left and right and the label rows above and below lie.

    A side without labels has a share of the image instead, or lies off the letters' extent.
    """
    tol = F.bround(options.margin_pt * F.col("dpi") / 72.0)
    letters = rows.where(F.col("text").rlike(ROW_LABEL) & (F.col("ix") > 0) & (F.col("ix") < F.col("img_w")) & (F.col("iy") > 0) & (F.col("iy") < F.col("img_h")))
    letters = letters.withColumn("left", F.col("ix") < F.col("img_w") / 2)
    letters = cut(_around_median(letters, ["job_id", "left"], "ix", F.bround(options.margin_pt * F.col("scale"))))
    side = upper_median(letters, ["job_id", "left"], "ix", "m")
    at = side.groupBy("job_id").agg(F.max(F.when(F.col("left"), F.col("m"))).alias("l"), F.max(F.when(~F.col("left"), F.col("m"))).alias("r"))
    tall = letters.groupBy("job_id").agg(F.min("iy").alias("y0"), F.max("iy").alias("y1"))
    whole = lambda c, share, of: F.coalesce(F.col(c), F.col(of) * share).cast("long")
    b = pages.select("job_id", "width_px", "height_px", tol.alias("tol")).join(at, "job_id", "left").join(tall, "job_id", "left")
    b = b.select("job_id", "tol", whole("l", 0.08, "width_px").alias("bx0"), whole("r", 0.88, "width_px").alias("bx1"), whole("y0", 0.15, "height_px").alias("by0"), whole("y1", 0.92, "height_px").alias("by1"))
    numbers = rows.where(_is_number(F.col("text"))).join(b, "job_id").where((F.col("ix") > F.col("bx0") - options.margin_reach_px) & (F.col("ix") < F.col("bx1") + options.margin_reach_px))
    numbers = numbers.withColumn("upper", F.col("iy") < F.col("img_h") * 0.5)
    numbers = _around_median(numbers, ["job_id", "upper"], "iy", F.lit(options.label_band_px))
    side = upper_median(numbers, ["job_id", "upper"], "iy", "m")
    at = side.groupBy("job_id").agg(F.max(F.when(F.col("upper"), F.col("m"))).alias("t"), F.max(F.when(~F.col("upper"), F.col("m"))).alias("b"))
    out = b.join(at, "job_id", "left")
    return out.select("job_id", "bx0", "bx1", "tol", F.coalesce(F.col("t").cast("long"), F.col("by0") - 50).alias("top"), F.coalesce(F.col("b").cast("long"), F.col("by1") + 50).alias("bottom"))


def _is_number(text: Column) -> Column:
    """Whether a text is a column label: one or two digits, not 0 (signs and underscores are not taken)."""
    return text.rlike(COLUMN_LABEL) & (text.try_cast("int") > 0)


def labelled_lines(rows: DataFrame, pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, idx, px, label): for each label in its margin the upper median of where it stands, in the order of the sheet.

    Lines at one place are in the order of their numbers, if all of the axis are numbers and that keeps the order
    of the sheet, else as first seen.
    """
    band = options.label_band_px
    at = rows.join(cut(margins(rows, pages, options)), "job_id")
    near = lambda c, v, tol: F.abs(F.col(c) - F.col(v)) <= tol
    x = at.where(_is_number(F.col("text")) & F.col("ix").between(F.col("bx0"), F.col("bx1")) & (near("iy", "top", band) | near("iy", "bottom", band)))
    y = at.where(F.col("text").rlike(ROW_LABEL) & F.col("iy").between(F.col("top"), F.col("bottom")) & (near("ix", "bx0", F.col("tol")) | near("ix", "bx1", F.col("tol"))))
    found = x.select("job_id", F.lit("x").alias("axis"), "text", F.col("ix").alias("v"), "ord").unionByName(y.select("job_id", F.lit("y").alias("axis"), "text", F.col("iy").alias("v"), "ord"))
    keys = ["job_id", "axis", "text"]
    first = found.groupBy(*keys).agg(F.min("ord").alias("first"))
    lines = upper_median(found, keys, "v", "px").join(first, keys).withColumn("number", F.when(F.col("text").rlike(r"^\d+$"), F.col("text").cast("int")))
    axis = Window.partitionBy("job_id", "axis")
    down = F.col("px") < F.lag("px").over(axis.orderBy("number", "px", "first"))
    lines = lines.withColumn("_down", F.coalesce(down, F.lit(False))).withColumn("_by", ~F.max("_down").over(axis) & (F.count("number").over(axis) == F.count(F.lit(1)).over(axis)))
    order = axis.orderBy("px", F.when(F.col("_by"), F.col("number")), "first")
    return lines.select("job_id", "axis", (F.row_number().over(order) - 1).cast("long").alias("idx"), "px", F.col("text").alias("label"))


def fallback(pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, idx, px, label): the uniform grid of a page without one; labels 1, 2, ... and A .. Z, AA, BB, ..."""
    letter = F.expr("CASE WHEN idx < 26 THEN char(65 + idx) ELSE repeat(char(65 + idx - 26), 2) END")

    def axis(name: str, n: int, side: str, label: Column) -> DataFrame:
        rows = pages.select("job_id", F.lit(name).alias("axis"), F.col(side).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("idx"))
        rows = rows.withColumns({"idx": F.col("idx").cast("long"), "px": F.bround(F.col("_s") * F.col("idx") / (n - 1)).cast("double")})
        return rows.withColumn("label", label).select("job_id", "axis", "idx", "px", "label")

    return axis("x", options.fallback_x, "width_px", (F.col("idx") + 1).cast("string")).unionByName(axis("y", options.fallback_y, "height_px", letter))


def detect(texts: DataFrame, pages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, axis, idx, px, label, spacing_mm, source): the lines of each page and the bay after each (null after the last).

    ``texts(job_id, ord, text, x0, y0, x1, y1)`` in points of the unrotated sheet, ``pages(job_id, rotation, dpi, width_px,
    height_px, w_pt, h_pt)``. Bays are annotated, inferred or fallback; a page with under two lines on an axis has the
    uniform grid, with source ``default``.
    """
    # Labels and lines are few, and many steps start from them: each is written once.
    rows = cut(placed(texts, pages).where(F.col("text").rlike(f"{ROW_LABEL}|{COLUMN_LABEL}|{DIMENSION}")))
    lines = cut(labelled_lines(rows, pages, options))
    enough = lines.groupBy("job_id").agg(F.count_if(F.col("axis") == "x").alias("nx"), F.count_if(F.col("axis") == "y").alias("ny")).where("nx >= 2 and ny >= 2").select("job_id")
    lines = lines.join(enough, "job_id", "left_semi")
    sizes = rows.where(F.col("text").rlike(DIMENSION)).withColumn("mm", F.col("text").cast("double")).where(F.col("mm").between(options.least_dim_mm, options.most_dim_mm))
    both = F.explode(F.array(F.struct(F.lit("x").alias("axis"), F.col("ix").alias("pos")), F.struct(F.lit("y").alias("axis"), F.col("iy").alias("pos"))))
    sizes = sizes.select("job_id", "ord", "mm", both.alias("p")).select("job_id", "ord", "p.axis", "p.pos", "mm")
    bays = infer_spacings(sizes, lines, options).withColumnRenamed("gap", "idx")
    last = F.col("idx") == F.max("idx").over(Window.partitionBy("job_id", "axis"))
    out = lines.withColumn("_last", last).join(bays, ["job_id", "axis", "idx"], "left")
    own = lambda c, v: F.when(~F.col("_last"), F.coalesce(F.col(c), F.lit(v)))
    out = out.select("job_id", "axis", "idx", "px", "label", own("mm", options.fallback_bay_mm).alias("spacing_mm"), own("source", "fallback").alias("source"))
    rest = fallback(pages.join(enough, "job_id", "left_anti"), options)
    tail = F.col("idx") == F.when(F.col("axis") == "x", options.fallback_x - 1).otherwise(options.fallback_y - 1)
    rest = rest.withColumns({"spacing_mm": F.when(~tail, options.default_bay_mm), "source": F.when(~tail, "default")})
    return out.unionByName(rest)


def px_per_mm(detected: DataFrame) -> DataFrame:
    """(job_id, axis, px_per_mm): the mean over the bays of an axis of its pixels over its millimetres."""
    nxt = F.lead("px").over(Window.partitionBy("job_id", "axis").orderBy("idx"))
    ratio = F.when(F.col("spacing_mm") > 0, F.abs(F.col("_next") - F.col("px")) / F.col("spacing_mm"))
    return detected.withColumn("_next", nxt).groupBy("job_id", "axis").agg(F.coalesce(F.avg(ratio), F.lit(150.0 / 25.4)).alias("px_per_mm"))
