"""Build placement: which elements can be placed and on which levels, and the sized types that they share."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.binning import first_by
from planframe.functions.text import sized_type
from planframe.operators.levels import level_above

#: The least side of a column, the height of a wall without one, and the levels of elements that name none.
LEAST_MM, WALL_MM, BASE, TOP = 200.0, 2800.0, "Level 0", "Level 1"

#: Words of a shape, and of a type mark, that mean a round column, and those that rule it out.
ROUND_SHAPES, FLAT_SHAPES, ROUND_MARKS = ("CIRC", "ROUND"), ("RECT", "SQUARE", "SQ"), ("ROUND", "CIRC")


def is_round(shape: Column, type_mark: Column) -> Column:
    """Whether a column is round: its shape tells, else its type mark; equal sides do not."""
    holds = lambda c, words: F.greatest(*[F.upper(F.coalesce(c, F.lit(""))).contains(w) for w in words])
    return F.when(holds(shape, ROUND_SHAPES), True).when(holds(shape, FLAT_SHAPES), False).otherwise(holds(type_mark, ROUND_MARKS))


def _named(levels: DataFrame, prefix: str) -> DataFrame:
    """(job_id, key, name, elevation) of the first level of each name, in any case."""
    rows = levels.withColumn(f"{prefix}_key", F.upper("level"))
    rows = first_by(rows, ["job_id", f"{prefix}_key"], [F.col("ord")], ["level", "elevation"])
    return rows.select("job_id", f"{prefix}_key", F.col("level").alias(f"{prefix}_level"), F.col("elevation").alias(f"{prefix}_mm"))


def _on_level(elements: DataFrame, levels: DataFrame) -> DataFrame:
    return elements.withColumn("base_key", F.upper(F.coalesce("level", F.lit(BASE)))).join(_named(levels, "base"), ["job_id", "base_key"], "left").drop("base_key")


def place_columns(columns: DataFrame, levels: DataFrame, families: DataFrame) -> DataFrame:
    """(job_id, ord, status, reason, family, width, depth, base_level, top_level) of ``columns(job_id, ord, x, y, width, depth, shape, type_mark, level, top_level)``.

    ``levels(job_id, ord, level, elevation)``; ``families(job_id, rect, round)`` names what a job has loaded, and either
    serves where the other is missing. Skipped, by the first that holds: no family (the job has none), no location,
    no level. Sides are raised to LEAST_MM. A top level at or below the base gives way to the next level above it;
    one that is not there, and a base without a level above, leave the top null.
    """
    rows = _on_level(columns.join(families.select("job_id", "rect", "round"), "job_id", "left"), levels)
    rows = rows.withColumn("top_key", F.upper(F.coalesce("top_level", F.lit(TOP)))).drop("top_level").join(_named(levels, "top"), ["job_id", "top_key"], "left")
    low = F.col("top_mm") <= F.col("base_mm") + 1e-6
    above = level_above(levels, rows.where(low).select("job_id", "ord", F.col("base_mm").alias("base"))).select("job_id", "ord", F.col("level").alias("_above"))
    rows = rows.join(above, ["job_id", "ord"], "left")
    family = F.when(is_round(F.col("shape"), F.col("type_mark")), F.coalesce("round", "rect")).otherwise(F.coalesce("rect", "round"))
    reason = F.when(F.col("rect").isNull() & F.col("round").isNull(), "no family").when(F.col("x").isNull() | F.col("y").isNull(), "no location").when(F.col("base_level").isNull(), "no level")
    side = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0.0)), F.lit(LEAST_MM))
    good = reason.isNull()
    return rows.select(
        "job_id", "ord", F.when(good, "placed").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(good, family).alias("family"), side("width").alias("width"), side("depth").alias("depth"),
        F.when(good, F.col("base_level")).alias("base_level"), F.when(good, F.when(low, F.col("_above")).otherwise(F.col("top_level"))).alias("top_level"),
    )


def place_lines(lines: DataFrame, levels: DataFrame, least: float) -> DataFrame:
    """(job_id, ord, status, reason, base_level) of beams and walls ``(job_id, ord, sx, sy, sz, ex, ey, ez, level)``.

    Skipped, by the first that holds: no location (a point is missing), no length (under ``least`` feet), no level.
    """
    rows = _on_level(lines, levels)
    ends = [f"{p}{a}" for p in "se" for a in "xyz"]
    length = F.sqrt(sum((F.col(f"e{a}") - F.col(f"s{a}")) * (F.col(f"e{a}") - F.col(f"s{a}")) for a in "xyz")) / 304.8
    missing = F.greatest(*[F.col(c).isNull() for c in ends])
    reason = F.when(missing, "no location").when(length < least, "no length").when(F.col("base_level").isNull(), "no level")
    return rows.select("job_id", "ord", F.when(reason.isNull(), "placed").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("base_level")).alias("base_level"))


def place_slabs(slabs: DataFrame, levels: DataFrame) -> DataFrame:
    """(job_id, ord, status, reason, base_level) of ``slabs(job_id, ord, points, level)``: skipped under three points or without a level."""
    rows = _on_level(slabs, levels)
    reason = F.when(F.coalesce(F.size("points"), F.lit(0)) < 3, "no outline").when(F.col("base_level").isNull(), "no level")
    return rows.select("job_id", "ord", F.when(reason.isNull(), "placed").otherwise("skipped").alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("base_level")).alias("base_level"))


def wall_height(height: Column) -> Column:
    return F.when(height > 0, height).otherwise(F.lit(WALL_MM))


def sized_types(requests: DataFrame, types: DataFrame) -> DataFrame:
    """(job_id, ord, family, type_name, outcome) of ``requests(job_id, ord, family, width, depth)``: the type of each, found or made.

    A type is named by its sides to the nearest 50 mm. One that the family of ``types(job_id, family, type_name)``
    has, in any case, is existing and keeps its name; else the first request by ord makes it (created) and later ones
    of the job share it (reused). A minimum over each name, which combines before the shuffle, finds the first.
    """
    rows = requests.withColumn("_name", sized_type(F.col("width"), F.col("depth"))).withColumn("_key", F.upper("_name"))
    key = ["job_id", "family", "_key"]
    have = types.withColumn("_key", F.upper("type_name")).groupBy(*key).agg(F.min("type_name").alias("_have"))
    first = rows.groupBy(*key).agg(F.min("ord").alias("_first")).join(have, key, "left")
    out = rows.join(first, key)
    outcome = F.when(F.col("_have").isNotNull(), "existing").when(F.col("ord") == F.col("_first"), "created").otherwise("reused")
    return out.select("job_id", "ord", "family", F.coalesce("_have", "_name").alias("type_name"), outcome.alias("outcome"))


def types_after(types: DataFrame, resolved: DataFrame) -> DataFrame:
    """``types(job_id, family, type_name)`` with those that were made."""
    made = resolved.where("outcome = 'created'").select("job_id", "family", "type_name")
    return types.select("job_id", "family", "type_name").unionByName(made)
