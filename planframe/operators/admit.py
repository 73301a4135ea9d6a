"""Admission of detections: a rule for each type says admit, admit with a fixed box, or reject, and why."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.binning import first_by, shuffled, tile
from planframe.functions.geometry import iou
from planframe.operators.boxes import BOX, centred, extent, lines, nearest_other, nearest_tag, off_grid, overlapping, tag_material
from planframe.operators.strokes import stroke_style
from planframe.options import DEFAULTS, Options

#: Columns of a decision.
DECISION = ["job_id", "ord", "type", "action", "reason", *BOX]


def snapped(beams: DataFrame, columns: DataFrame, options: Options = DEFAULTS, size: float = 256.0) -> DataFrame:
    """(job_id, ord, n_lo, n_hi) of framing boxes: the centres of the nearest columns before and after the beam's middle.

    Columns count whose middle across the beam is within half their own side and the beam's. Both sides are put on
    the tiles across the beam that they reach, so a pair meets at least once, and a minimum does not mind how often.
    Null where there is no such column on that side.
    """
    flat = (F.col("x2") - F.col("x1")) >= (F.col("y2") - F.col("y1"))

    def turned(df: DataFrame, p: str, flat: Column) -> DataFrame:
        pick = lambda a, b: F.when(flat, F.col(a)).otherwise(F.col(b))
        lo, hi, low, high = pick("x1", "y1"), pick("x2", "y2"), pick("y1", "x1"), pick("y2", "x2")
        return df.select("job_id", "flat", *([F.col("ord")] if p == "b" else []), ((lo + hi) / 2).alias(f"{p}_mid"), ((low + high) / 2).alias(f"{p}_across"), F.abs(high - low).alias(f"{p}_wide"))

    b = turned(beams.withColumn("flat", flat), "b", F.col("flat"))
    c = turned(columns.withColumn("flat", F.explode(F.array(F.lit(True), F.lit(False)))), "c", F.col("flat"))
    on = lambda df, p, half: df.withColumn("_t", F.explode(F.sequence(tile(F.col(f"{p}_across") - half, size), tile(F.col(f"{p}_across") + half, size))))
    near = on(b, "b", F.col("b_wide")).join(shuffled(on(c, "c", F.col("c_wide") / 2)), ["job_id", "flat", "_t"])
    near = near.where(F.abs(F.col("c_across") - F.col("b_across")) <= F.col("c_wide") * 0.5 + F.col("b_wide"))
    before = F.col("c_mid") < F.col("b_mid")
    return near.groupBy("job_id", "ord").agg(F.max(F.when(before, F.col("c_mid"))).alias("n_lo"), F.min(F.when(~before, F.col("c_mid"))).alias("n_hi"))


def framing(boxes: DataFrame, spans: DataFrame, grid: DataFrame, legend: DataFrame, paths: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, type, action, reason, x1 .. y2, tag, material, aligned, col_dist, score) of framing boxes.

    A box whose nearest column is nearer than the clearance is in conflict. Then 3 points for a tag that the
    ``legend(job_id, tag, material)`` knows or else 2 for any tag, 2 for alignment with a grid line, 1 for a stroke
    that is known to be dashed or solid, and 1 for standing off the column; three admit with a fix, two admit, fewer
    reject. Without conflict a box whose ends reach columns is admitted with that fix, any other as it is. A fix moves
    the ends along the beam onto the centres of the columns, unless it turns the box inside out or makes it more than
    ``max_growth`` times as long.
    """
    beams = boxes.where("type = 'structural_framing'")
    columns = boxes.where("type = 'column'")
    near = nearest_other(centred(beams), centred(columns), 128.0).select("job_id", "ord", F.col("dist").alias("col_dist"))
    tags = nearest_tag(beams, spans, options.framing_tag_radius_px).select("job_id", "ord", "tag").join(shuffled(legend), ["job_id", "tag"], "left").select("job_id", "ord", "tag", F.col("material").alias("_legend"))
    flat = (F.col("x2") - F.col("x1")) >= (F.col("y2") - F.col("y1"))
    close = lambda ls, c: F.exists(ls, lambda v: F.abs(v - F.col(c)) <= options.grid_align_px)
    rows = centred(beams).join(shuffled(lines(grid)), "job_id", "left").withColumn("aligned", F.coalesce(F.when(flat, close("ys", "cy")).otherwise(close("xs", "cx")), F.lit(False)))
    rows = rows.select("job_id", "ord", "type", *BOX, "aligned").withColumn("short", F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")))
    for more in (near, tags, stroke_style(beams, paths), snapped(beams, columns, options)):
        rows = rows.join(shuffled(more), ["job_id", "ord"], "left")
    drawn = F.when(F.col("style") == "dashed", "steel").when(F.col("style") == "solid", "rc")
    material = F.coalesce(F.when(F.col("tag").isNotNull(), tag_material(F.col("tag"), F.col("_legend"))), drawn)
    lo, hi = F.when(flat, F.col("x1")).otherwise(F.col("y1")), F.when(flat, F.col("x2")).otherwise(F.col("y2"))
    across = F.when(flat, F.col("y2") - F.col("y1")).otherwise(F.col("x2") - F.col("x1"))
    n_lo, n_hi = F.coalesce("n_lo", lo), F.coalesce("n_hi", hi)
    good = (n_hi - n_lo >= across) & ~((hi - lo > 0) & (n_hi - n_lo > (hi - lo) * options.max_growth))
    rows = rows.withColumns({"material": material, "_lo": F.when(good, n_lo).otherwise(lo), "_hi": F.when(good, n_hi).otherwise(hi)})
    moved = (F.col("_lo") != lo) | (F.col("_hi") != hi)
    point = lambda c, n: F.when(c, n).otherwise(0)
    score = F.when(F.col("_legend").isNotNull(), 3).otherwise(point(F.col("tag").isNotNull(), 2)) + point(F.col("aligned"), 2) + point(F.col("style").isin("dashed", "solid"), 1) + point(F.col("col_dist") > 0.5 * F.col("short"), 1)
    conflict = F.coalesce(F.col("col_dist") < options.clearance * F.col("short"), F.lit(False))
    rows = rows.withColumn("score", score)
    rows = rows.withColumn("reason", F.when(~conflict, F.when(moved, "snap_to_columns").otherwise("no_conflict")).when(F.col("score") >= 3, "join_conflict_resolved").when(F.col("score") == 2, "join_conflict_borderline_admitted").otherwise("join_conflict_unsupported"))
    fix = F.col("reason").isin("snap_to_columns", "join_conflict_resolved")
    action = F.when(fix, "admit_with_fix").when(F.col("reason") == "join_conflict_unsupported", "reject").otherwise("admit")
    new = {"x1": F.when(fix & flat, F.col("_lo")).otherwise(F.col("x1")), "x2": F.when(fix & flat, F.col("_hi")).otherwise(F.col("x2")), "y1": F.when(fix & ~flat, F.col("_lo")).otherwise(F.col("y1")), "y2": F.when(fix & ~flat, F.col("_hi")).otherwise(F.col("y2"))}
    return rows.select("job_id", "ord", "type", action.alias("action"), "reason", *[new[c].alias(c) for c in BOX], "tag", "material", "aligned", F.round("col_dist", 6).alias("col_dist"), "score")


def column_rule(boxes: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Decisions on columns: one that is off the grid is rejected."""
    rows = off_grid(boxes.where("type = 'column'"), grid, options)
    return rows.select("job_id", "ord", "type", F.when(F.col("off_grid"), "reject").otherwise("admit").alias("action"), F.when(F.col("off_grid"), "off_grid").otherwise("on_grid").alias("reason"), *BOX)


@dataclass(frozen=True)
class Sheet:
    """What a rule may look at: the boxes of drawings and what lies around them."""

    boxes: DataFrame
    spans: DataFrame
    grid: DataFrame
    legend: DataFrame
    paths: DataFrame
    options: Options = DEFAULTS


#: The rule of each type: from a sheet to the decisions (``DECISION``) on its boxes of that type.
RULES: dict[str, Callable[[Sheet], DataFrame]] = {
    "structural_framing": lambda s: framing(s.boxes, s.spans, s.grid, s.legend, s.paths, s.options),
    "column": lambda s: column_rule(s.boxes, s.grid, s.options),
}


def slab_decisions(s: Sheet) -> DataFrame:
    """A rule for slabs, not among RULES: what ``slab_rule`` finds is rejected."""
    boxes = s.boxes.where("type = 'slab'")
    found = slab_rule(boxes, s.grid, s.options).select("job_id", "ord", F.col("reason").alias("_why"))
    why = F.col("_why").isNotNull()
    return boxes.join(found, ["job_id", "ord"]).select("job_id", "ord", "type", F.when(why, "reject").otherwise("admit").alias("action"), F.coalesce("_why", F.lit("slab_stands")).alias("reason"), *BOX)


def judge(boxes: DataFrame, spans: DataFrame, grid: DataFrame, legend: DataFrame, paths: DataFrame, options: Options = DEFAULTS, rules: dict[str, Callable[[Sheet], DataFrame]] | None = None) -> DataFrame:
    """Decisions on all boxes by the rule of their type among ``rules`` (RULES); a type without one is admitted. Fixed boxes have their fixed sides."""
    rules = RULES if rules is None else rules
    sheet = Sheet(boxes, spans, grid, legend, paths, options)
    known = F.coalesce(F.col("type").isin(*rules), F.lit(False)) if rules else F.lit(False)
    out = boxes.where(~known).select("job_id", "ord", "type", F.lit("admit").alias("action"), F.lit("no_rule_for_type").alias("reason"), *BOX)
    for rule in rules.values():
        out = out.unionByName(rule(sheet).select(*DECISION))
    return out


def counts(decisions: DataFrame) -> DataFrame:
    """(action, n): how many boxes each action took; those without a rule count as skipped."""
    action = F.when(F.col("reason") == "no_rule_for_type", "skipped").otherwise(F.col("action"))
    return decisions.groupBy(action.alias("action")).agg(F.count(F.lit(1)).alias("n"))


def slab_rule(slabs: DataFrame, grid: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, ord, area, reason, of_ord): no_bbox, too_small, outside_grid_envelope, duplicate_of_larger (of the first larger sibling), or null.

    The envelope is that of the drawing's lines; under two lines on an axis there is none.
    """
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    rows = slabs.withColumn("area", area)
    side = lambda p: rows.where("area is not null").select("job_id", F.col("ord").alias(f"{p}ord"), F.col("area").alias(f"{p}area"), *[F.col(c).alias(f"{p}{c}") for c in BOX])
    pairs = overlapping(side("a_"), side("b_"), ["job_id"], "a_", "b_", 1024.0).where((F.col("b_area") > F.col("a_area")) & (iou("a_", "b_") >= options.slab_dup_iou))
    first = first_by(pairs, ["job_id", "a_ord"], [F.col("b_ord")], ["b_ord"]).select("job_id", F.col("a_ord").alias("ord"), F.col("b_ord").alias("of_ord"))
    out = centred(rows).join(extent(grid), "job_id", "left").join(first, ["job_id", "ord"], "left")
    inside = F.col("cx").between(F.col("gx0"), F.col("gx1")) & F.col("cy").between(F.col("gy0"), F.col("gy1"))
    free = F.coalesce((F.col("nx") < 2) | (F.col("ny") < 2), F.lit(True))
    reason = F.when(F.col("area").isNull(), "no_bbox").when(F.col("area") < options.slab_min_area_px, "too_small").when(~free & ~inside, "outside_grid_envelope").when(F.col("of_ord").isNotNull(), "duplicate_of_larger")
    out = out.withColumn("reason", reason)
    return out.select("job_id", "ord", "area", "reason", F.when(F.col("reason") == "duplicate_of_larger", F.col("of_ord")).alias("of_ord"))


#: The colour of a decision on an overlay, blue, green, red.
COLOURS = {"admit_with_fix": (0, 200, 0), "reject": (0, 0, 255)}


def overlay(decisions: DataFrame) -> DataFrame:
    """(job_id, ord, x1 .. y2, blue, green, red, label): the boxes of conflicts to draw over a drawing, those fixed and those rejected."""
    hit = decisions.where(F.col("action").isin(*COLOURS) & F.col("reason").startswith("join_conflict"))
    part = lambda i: F.create_map(*[F.lit(x) for k, v in COLOURS.items() for x in (k, v[i])])[F.col("action")]
    return hit.select("job_id", "ord", *BOX, part(0).alias("blue"), part(1).alias("green"), part(2).alias("red"), F.col("reason").alias("label"))
