"""Vector paths: dashes, strokes near boxes, straight runs, walls on lines, notes and legends."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.binning import containing, first_by, shuffled, tile
from planframe.functions.geometry import interpolate
from planframe.functions.text import CONCRETE, SELF_CODE, STEEL, TAGS, ZONE_CODE
from planframe.operators.detect import to_image
from planframe.operators.grid import frame
from planframe.options import DEFAULTS, Options


def is_dashed(dashes: Column) -> Column:
    """Whether a dash string holds a pattern: null, empty, [] and [] 0 do not."""
    inner = F.trim(F.regexp_extract(F.coalesce(dashes, F.lit("")), r"\[([^\]]*)\]", 1))
    return inner != ""


def stroke_style(boxes: DataFrame, paths: DataFrame, size: float = 256.0) -> DataFrame:
    """(job_id, ord, style): dashed, solid or unknown, by the paths that overlap a box among those centred within a tile of its centre."""
    box = boxes.withColumns({"_tx": tile((F.col("x1") + F.col("x2")) / 2, size), "_ty": tile((F.col("y1") + F.col("y2")) / 2, size)})
    p = paths.select("job_id", F.col("x1").alias("p1"), F.col("y1").alias("q1"), F.col("x2").alias("p2"), F.col("y2").alias("q2"), is_dashed(F.col("dashes")).alias("_dashed"))
    p = p.withColumns({"_ux": tile((F.col("p1") + F.col("p2")) / 2, size), "_uy": tile((F.col("q1") + F.col("q2")) / 2, size)})
    p = p.withColumn("_tx", F.explode(F.sequence(F.col("_ux") - 1, F.col("_ux") + 1))).withColumn("_ty", F.explode(F.sequence(F.col("_uy") - 1, F.col("_uy") + 1)))
    hit = box.join(shuffled(p), ["job_id", "_tx", "_ty"]).where("p1 <= x2 and p2 >= x1 and q1 <= y2 and q2 >= y1")
    n = hit.groupBy("job_id", "ord").agg(F.count_if("_dashed").alias("d"), F.count_if(~F.col("_dashed")).alias("s"))
    style = F.when(F.col("d") >= F.greatest(F.lit(2), F.col("s")), "dashed").when(F.col("s") > F.col("d"), "solid").otherwise("unknown")
    return boxes.select("job_id", "ord").join(shuffled(n), ["job_id", "ord"], "left").select("job_id", "ord", F.coalesce(style, F.lit("unknown")).alias("style"))


def runs(items: DataFrame) -> DataFrame:
    """(job_id, path_ord, item_ord, dir, lo, hi, perp): straight pieces of ``items(job_id, path_ord, item_ord, op, x, y)``.

    A line piece counts if the last other operation before it is a move; longer than 20 along one axis and
    under 5 across.
    """
    w = Window.partitionBy("job_id", "path_ord").orderBy("item_ord")
    rows = items.withColumns({
        "_other": F.last(F.when(F.col("op") != "l", F.col("op")), ignorenulls=True).over(w),
        "_px": F.lag("x").over(w), "_py": F.lag("y").over(w),
    })
    dx, dy = F.abs(F.col("x") - F.col("_px")), F.abs(F.col("y") - F.col("_py"))
    way = F.when((dy < 5) & (dx > 20), "h").when((dx < 5) & (dy > 20), "v")
    rows = rows.where((F.col("op") == "l") & (F.col("_other") == "m")).withColumn("dir", way).where("dir is not null")
    flat = F.col("dir") == "h"
    return rows.select(
        "job_id", "path_ord", "item_ord", "dir", F.when(flat, F.least("x", "_px")).otherwise(F.least("y", "_py")).alias("lo"),
        F.when(flat, F.greatest("x", "_px")).otherwise(F.greatest("y", "_py")).alias("hi"), F.when(flat, (F.col("y") + F.col("_py")) / 2).otherwise((F.col("x") + F.col("_px")) / 2).alias("perp"),
    )


def wall_lines(walls: DataFrame, lines: DataFrame, size: float = 64.0) -> DataFrame:
    """(job_id, ord, lo, hi, perp): for each wall box the line along it nearest its centre, cut to the box; nulls without one."""
    flat = (F.col("x2") - F.col("x1")) >= (F.col("y2") - F.col("y1"))
    w = walls.withColumns({
        "dir": F.when(flat, "h").otherwise("v"), "a0": F.when(flat, F.col("x1")).otherwise(F.col("y1")), "a1": F.when(flat, F.col("x2")).otherwise(F.col("y2")),
        "b0": F.when(flat, F.col("y1")).otherwise(F.col("x1")), "b1": F.when(flat, F.col("y2")).otherwise(F.col("x2")),
    })
    w = w.withColumn("_t", F.explode(F.sequence(tile(F.col("b0"), size), tile(F.col("b1"), size))))
    near = w.join(shuffled(lines.withColumn("_t", tile(F.col("perp"), size))), ["job_id", "dir", "_t"]).where("perp >= b0 and perp <= b1 and lo < a1 and hi > a0")
    near = near.select("job_id", "ord", F.abs(F.col("perp") - (F.col("b0") + F.col("b1")) / 2).alias("_d"), F.greatest("lo", "a0").alias("lo"), F.least("hi", "a1").alias("hi"), "perp")
    best = first_by(near, ["job_id", "ord"], [F.col("_d"), F.col("perp")], ["lo", "hi", "perp"])
    return walls.select("job_id", "ord").join(best, ["job_id", "ord"], "left")


def text_lines(spans: DataFrame, gap: float = 6.0) -> DataFrame:
    """Spans with ``line``: sorted by (y0, x0), a span joins the line if its middle is nearer than ``gap`` to the one before."""
    w = Window.partitionBy("job_id").orderBy("y0", "x0", "ord")
    mid = (F.col("y0") + F.col("y1")) / 2
    rows = spans.withColumn("_mid", mid).withColumn("_break", F.coalesce(F.abs(F.col("_mid") - F.lag("_mid").over(w)) >= gap, F.lit(True)).cast("int"))
    return rows.withColumn("line", F.sum("_break").over(w) - 1).drop("_mid", "_break")


def legend(lines: DataFrame) -> DataFrame:
    """(job_id, tag, material): tags of three letters or more on lines of text that name a material, concrete before steel; the first line of a tag wins."""
    text = lines.groupBy("job_id", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text"))), lambda s: F.trim(s["text"])), " ").alias("text"))
    material = F.when(F.col("text").rlike(CONCRETE), "rc").when(F.col("text").rlike(STEEL), "steel")
    tags = F.regexp_extract_all(F.upper("text"), F.lit(TAGS), 1)
    rows = text.select("job_id", "line", material.alias("material"), F.explode(tags).alias("tag")).where("material is not null and length(tag) >= 3")
    return first_by(rows, ["job_id", "tag"], [F.col("line")], ["material"])


def notes_block(words: DataFrame, reach: float = 300.0, gap: float = 100.0) -> DataFrame:
    """Words of each NOTES block: below its heading, within ``reach`` of its x, down to the first gap over ``gap``."""
    heads = words.where(F.trim("text").rlike(r"(?i)^NOTES:?$")).select("job_id", F.col("word_ord").alias("block"), F.col("x0").alias("_hx"), F.col("y0").alias("_hy"))
    near = heads.withColumn("_t", F.explode(F.sequence(tile(F.col("_hx") - reach, reach), tile(F.col("_hx") + reach, reach))))
    rows = words.withColumn("_t", tile(F.col("x0"), reach)).join(shuffled(near), ["job_id", "_t"]).drop("_t").where((F.abs(F.col("x0") - F.col("_hx")) < reach) & (F.col("y0") > F.col("_hy")))
    w = Window.partitionBy("job_id", "block").orderBy("y0", "x0", "word_ord")
    before = F.coalesce(F.max("y0").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_hy"))
    rows = rows.withColumn("_break", (F.col("y0") - before > gap).cast("int")).withColumn("_breaks", F.sum("_break").over(w))
    return rows.where("_breaks = 0").drop("_hx", "_hy", "_break", "_breaks")


def block_rects(blocks: DataFrame) -> DataFrame:
    """(job_id, block, bx0, by0, bx1, by1): the extent of each NOTES block's words."""
    return blocks.groupBy("job_id", "block").agg(F.min("x0").alias("bx0"), F.min("y0").alias("by0"), F.max("x1").alias("bx1"), F.max("y1").alias("by1"))


def zone_labels(words: DataFrame, size: float = 512.0) -> DataFrame:
    """(job_id, zone_ord, code, zx, zy): zone codes whose corner lies in no NOTES block of their drawing."""
    codes = words.where(F.trim("text").rlike(ZONE_CODE) | F.trim("text").rlike(SELF_CODE))
    inside = containing(codes, block_rects(notes_block(words)), ["job_id"], "x0", "y0", ("bx0", "by0", "bx1", "by1"), size).select("job_id", "word_ord").distinct()
    rows = codes.join(inside, ["job_id", "word_ord"], "left_anti")
    return rows.select("job_id", F.col("word_ord").alias("zone_ord"), F.upper(F.trim("text")).alias("code"), ((F.col("x0") + F.col("x1")) / 2).alias("zx"), ((F.col("y0") + F.col("y1")) / 2).alias("zy"))


def clause_totals(words: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, code, thickness_mm) of notes blocks: a clause starts at ALL and ends after a comma; its bare integers of 100 to 600 sum up.

    A block without ALL has a clause for each of its lines, so that numbers of unrelated lines do not add up. The sum holds
    for every NSP code of the clause; later clauses override earlier ones. Codes that tell their thickness themselves come last.
    """
    w = Window.partitionBy("job_id", "block").orderBy("block_no", "line_no", "x0", "word_ord")
    words = words.withColumn("text", F.trim("text"))
    t = F.upper("text")
    starts = ((t == "ALL") | F.coalesce(F.lag("text").over(w).endswith(","), F.lit(False))).cast("int")
    has_all = F.max(t == "ALL").over(Window.partitionBy("job_id", "block"))
    rows = words.withColumns({"_s": starts, "_all": has_all}).withColumn("_run", F.sum("_s").over(w))
    rows = rows.withColumn("clause", F.when(F.col("_all"), F.struct(F.col("_run").alias("a"), F.lit(0).cast("long").alias("b"))).otherwise(F.struct(F.col("block_no").cast("long").alias("a"), F.col("line_no").cast("long").alias("b"))))
    number = F.regexp_extract(F.col("text"), r"^(\d{3})[.,]?$", 1).try_cast("double")
    clause = rows.groupBy("job_id", "block", "clause").agg(F.sum(F.when(number.between(100, 600), number)).alias("total"), F.collect_set(F.nullif(F.regexp_extract(t, r"^(NSP\d+)[.,]?$", 1), F.lit(""))).alias("codes"))
    each = clause.where("total is not null").select("job_id", F.explode("codes").alias("code"), F.struct("block", "clause").alias("at"), "total")
    told = each.groupBy("job_id", "code").agg(F.max_by("total", "at").alias("thickness_mm"))
    own = rows.select("job_id", t.alias("code"), F.regexp_extract(t, SELF_CODE, 1).try_cast("double").alias("thickness_mm")).where("thickness_mm is not null").distinct()
    return told.unionByName(own)


def to_mm(points: DataFrame, pages: DataFrame, grid: DataFrame, gaps: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """Points of the unrotated sheet ``(x<name>, y<name>)`` of drawings with a grid, in points, with ``mx<name>, my<name>`` in millimetres, y upwards.

    Positions off the grid's ends are extrapolated. ``pages`` may have the corner ``px0, py0`` that positions count from.
    """
    corner = lambda c: F.col(c) if c in pages.columns else F.lit(0.0)
    sheet = pages.select("job_id", F.col("rotation").alias("_r"), (F.col("dpi") / 72.0).alias("_s"), F.col("w_pt").alias("_w"), F.col("h_pt").alias("_h"), corner("px0").alias("_x0"), corner("py0").alias("_y0"))
    rows = points.join(sheet, "job_id").join(frame(grid, gaps), "job_id")
    for n in names:
        ix, iy = to_image(F.col(f"x{n}") - F.col("_x0"), F.col(f"y{n}") - F.col("_y0"), F.col("_w"), F.col("_h"), F.col("_s"), F.col("_r"))
        rows = rows.withColumns({f"mx{n}": interpolate(F.col("x_px"), F.col("x_mm"), ix), f"my{n}": F.col("height") - interpolate(F.col("y_px"), F.col("y_mm"), iy)})
    return rows.drop("_r", "_s", "_w", "_h", "_x0", "_y0", "x_px", "y_px", "x_mm", "y_mm", "height", "min_bay")


def dashed_segments(segments: DataFrame, pages: DataFrame, grid: DataFrame, gaps: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, axis, lo, hi, perp) in millimetres of dashed line pieces ``(job_id, ord, dashes, x1, y1, x2, y2)`` of at least 1 mm along an axis; slanted ones go."""
    rows = to_mm(segments.where(is_dashed(F.col("dashes"))), pages, grid, gaps, ("1", "2"))
    dx, dy = F.col("mx2") - F.col("mx1"), F.col("my2") - F.col("my1")
    square = dx * dx + dy * dy
    part = options.aligned_cos * options.aligned_cos
    rows = rows.withColumn("axis", F.when(dx * dx >= part * square, "x").when(dy * dy >= part * square, "y")).where((square >= 1) & F.col("axis").isNotNull())
    x = F.col("axis") == "x"
    pick = lambda f: F.when(x, f("mx1", "mx2")).otherwise(f("my1", "my2"))
    return rows.select("job_id", "ord", "axis", pick(F.least).alias("lo"), pick(F.greatest).alias("hi"), F.when(x, (F.col("my1") + F.col("my2")) / 2).otherwise((F.col("mx1") + F.col("mx2")) / 2).alias("perp"))


def column_rectangles(paths: DataFrame, pages: DataFrame, grid: DataFrame, gaps: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, rect_ord, x0, y0, x1, y1) in millimetres of path boxes ``(job_id, ord, x1, y1, x2, y2)`` whose sides are those of a column."""
    rows = to_mm(paths.where("x2 > x1 and y2 > y1"), pages, grid, gaps, ("1", "2"))
    sized = lambda a, b: F.abs(F.col(b) - F.col(a)).between(options.rect_min_mm, options.rect_max_mm)
    rows = rows.where(sized("mx1", "mx2") & sized("my1", "my2"))
    return rows.select("job_id", F.col("ord").alias("rect_ord"), F.least("mx1", "mx2").alias("x0"), F.least("my1", "my2").alias("y0"), F.greatest("mx1", "mx2").alias("x1"), F.greatest("my1", "my2").alias("y1"))
