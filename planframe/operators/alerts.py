"""Build warnings: dispatch by pattern, the worst beams, checks before export."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planframe.binning import reaching
from planframe.functions.text import WARNINGS, first_match
from planframe.options import DEFAULTS, Options
from planframe.session import cut


def dispatch(warnings: DataFrame) -> DataFrame:
    """Warnings with the ``handler`` of the first pattern that matches, else unresolved."""
    return warnings.withColumn("handler", first_match(F.col("text"), WARNINGS, "unresolved"))


def merge(warnings: DataFrame) -> DataFrame:
    """(text, ids, first): one row for each text of ``warnings(ord, text, element_ids)``, with all element ids."""
    ids = F.array_sort(F.flatten(F.collect_set("element_ids")))
    return warnings.groupBy("text").agg(F.array_distinct(ids).alias("ids"), F.min("ord").alias("first"))


def depths(beams: DataFrame, columns: DataFrame) -> DataFrame:
    """(job_id, ord, depth_mm): how deep the deeper end of each beam lies in a column, of beams with an end in one."""
    ends = beams.select("job_id", "ord", F.explode(F.array(F.struct(F.col("sx").alias("px"), F.col("sy").alias("py")), F.struct(F.col("ex").alias("px"), F.col("ey").alias("py")))).alias("p")).select("job_id", "ord", "p.*")
    reach = columns.select("job_id", "cx", "cy", "hw", "hd", F.greatest("hw", "hd").alias("_reach"))
    near = reaching(reach, ends, ["job_id"], "cx", "cy", "_reach", "px", "py", 1024.0)
    depth = F.least(F.col("hw") - F.abs(F.col("px") - F.col("cx")), F.col("hd") - F.abs(F.col("py") - F.col("cy")))
    return near.withColumn("depth_mm", depth).where("depth_mm > 0").groupBy("job_id", "ord").agg(F.max("depth_mm").alias("depth_mm"))


def worst_beams(beams: DataFrame, columns: DataFrame, warnings: DataFrame) -> DataFrame:
    """(job_id, ord, depth_mm): beams to remove, one for each join warning of the job, deepest in a column first.

    Depths do not change as beams go, so the beams that k warnings remove are the k deepest, earlier ones
    first among equals.
    """
    k = dispatch(warnings).where("handler = 'join_error'").groupBy("job_id").agg(F.count(F.lit(1)).alias("k"))
    ranked = depths(beams, columns).withColumn("_rn", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("depth_mm"), "ord")))
    return ranked.join(k, "job_id").where("_rn <= k").select("job_id", "ord", "depth_mm")


#: The kinds of elements that a missing family may clear, in the order they are looked for, with the word of the message.
CLEARED = (("structural_framing", "framing"), ("columns", "column"), ("walls", "wall"))


def replay(beams: DataFrame, columns: DataFrame, walls: DataFrame, warnings: DataFrame, rounds: int = 3) -> DataFrame:
    """(job_id, status, rounds, beams_removed, columns_raised, cleared) of every job with elements: its recorded warnings answered again.

    ``warnings(job_id, attempt, ord, text)`` holds what each attempt (0, 1, ...) gave; ``columns(job_id, ord, cx, cy, hw, hd,
    height)``. An attempt without warnings ends in success. The last of ``rounds`` attempts, one with a message that no handler
    knows and one in which no handler did anything end in warnings_accepted. In all but the last attempt each join message
    removes the beam that lies deepest in a column, short columns are raised, and then a missing family clears its kind.
    """
    low = F.lower("text")
    names = F.array(*[F.when(low.contains(word) | low.contains(name), name) for name, word in CLEARED])
    told = dispatch(warnings).withColumn("kind", F.when(F.col("handler") == "missing_family", F.try_element_at(F.filter(names, lambda k: k.isNotNull()), F.lit(1))))
    n = lambda h: F.count_if(F.col("handler") == h)
    each = told.groupBy("job_id", "attempt").agg(
        F.count(F.lit(1)).alias("_n"), n("join_error").alias("_joins"), n("unresolved").alias("_unknown"), (n("identical") + n("transient")).alias("_logged"), n("short_column").alias("_short"),
        *[F.count_if(F.col("kind") == name).alias(f"_c_{name}") for name, _ in CLEARED],
    )
    count = lambda df, name, when=F.lit(True): df.groupBy("job_id").agg(F.count_if(when).alias(name))
    state = beams.select("job_id").unionByName(columns.select("job_id")).unionByName(walls.select("job_id")).distinct()
    for more in (count(beams, "n_structural_framing"), count(columns, "n_columns"), count(walls, "n_walls"), count(depths(beams, columns), "deep"), count(columns, "low", F.col("height") < 1000)):
        state = state.join(more, "job_id", "left")
    zero = F.lit(0).cast("long")
    state = state.na.fill(0).withColumns({"status": F.lit(None).cast("string"), "rounds": zero, "removed": zero, "raised": zero, "cleared": F.array().cast("array<string>")})
    state = cut(state)
    for attempt in range(rounds):
        last = attempt == rounds - 1
        state = state.join(each.where(F.col("attempt") == attempt).drop("attempt"), "job_id", "left")
        open_ = F.col("status").isNull()
        acts = open_ & (F.coalesce("_n", zero) > 0) & (not last)
        has = lambda name: ~F.array_contains("cleared", name) & (F.col(f"n_{name}") > 0)
        joins = F.when(acts & has("structural_framing"), F.least("_joins", F.col("deep") - F.col("removed"))).otherwise(zero)
        raised = F.when(acts & (F.col("_short") > 0) & has("columns"), F.col("low") - F.col("raised")).otherwise(zero)
        clears = F.filter(F.array(*[F.when(acts & (F.col(f"_c_{name}") > 0) & has(name), name) for name, _ in CLEARED]), lambda k: k.isNotNull())
        state = state.withColumns({"_j": joins, "_r": raised, "_k": clears, "_open": open_})
        idle = (F.col("_j") == 0) & (F.col("_r") == 0) & (F.size("_k") == 0) & (F.coalesce("_logged", zero) == 0)
        end = F.when(F.coalesce("_n", zero) == 0, "success").when(F.lit(last) | (F.col("_unknown") > 0) | idle, "warnings_accepted")
        state = state.withColumns({"status": F.coalesce("status", end), "rounds": F.when(F.col("_open"), attempt + 1).otherwise(F.col("rounds")), "removed": F.col("removed") + F.col("_j"), "raised": F.col("raised") + F.col("_r"), "cleared": F.concat("cleared", "_k")})
        state = state.drop(*[c for c in state.columns if c.startswith("_")])
    removed = F.when(F.array_contains("cleared", "structural_framing"), F.col("n_structural_framing")).otherwise(F.col("removed"))
    return state.select("job_id", "status", F.col("rounds").cast("long").alias("rounds"), removed.alias("beams_removed"), F.col("raised").alias("columns_raised"), F.array_join(F.array_sort("cleared"), ",").alias("cleared"))


def pre_clash(columns: DataFrame, walls: DataFrame, openings: DataFrame) -> DataFrame:
    """(job_id, ord, kind, reason): columns under 200 mm, walls of 0 to 100 mm, doors over 2000 and windows over 3000 mm."""
    a = columns.where("width_mm < 200 or depth_mm < 200").select("job_id", "ord", F.lit("column").alias("kind"), F.lit("side under 200 mm").alias("reason"))
    length = F.hypot(F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy"))
    b = walls.where((length > 0) & (length < 100)).select("job_id", "ord", F.lit("wall").alias("kind"), F.lit("shorter than 100 mm").alias("reason"))
    wide = ((F.col("kind") == "door") & (F.col("width_mm") > 2000)) | ((F.col("kind") == "window") & (F.col("width_mm") > 3000))
    c = openings.where(wide).select("job_id", "ord", "kind", F.lit("too wide").alias("reason"))
    return a.unionByName(b).unionByName(c)


def low_confidence(elements: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """Elements below the confidence bound, least confident first."""
    return elements.where(F.col("confidence") < options.low_confidence).orderBy("confidence", "job_id", "ord")


def raise_short(columns: DataFrame, least_mm: float = 1000.0) -> DataFrame:
    """Columns at least ``least_mm`` high; a null height counts as that."""
    return columns.withColumn("height", F.greatest(F.coalesce("height", F.lit(least_mm)), F.lit(least_mm)))
