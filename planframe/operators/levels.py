"""Levels of a building: reconciliation with those a model has, and the next level above."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels closer than this many feet are at one height, and the levels of a job that asks for fewer than two.
SAME_FT = 1e-4
DEFAULT_LEVELS = (("Level 0", 0.0), ("Level 1", 3000.0))

#: Leftover levels are parked this far apart above the highest wanted one.
PARKED_MM = 3000.0

_STATE = "struct<have:array<struct<name:string,mm:double,was:string,ord:bigint>>,log:array<struct<seq:bigint,level:string,action:string,elevation:double,was:string>>>"


def _feet(mm: Column) -> Column:
    return mm / 304.8


def _step(state: Column, want: Column) -> Column:
    """The state after one wanted level: a level of its name is kept or moved, else the first at its height renamed, else one is made."""
    have = state["have"]
    named = F.array_position(F.transform(have, lambda x: F.upper(x["name"])), F.upper(want["level"]))
    placed = F.array_position(F.transform(have, lambda x: F.abs(_feet(x["mm"]) - _feet(want["elevation"])) < SAME_FT), F.lit(True))
    found = F.when(named > 0, named).otherwise(placed).cast("int")
    old = F.get(have, found - 1)
    off = F.abs(_feet(old["mm"]) - _feet(want["elevation"])) > SAME_FT
    action = F.when(named > 0, F.when(off, "move").otherwise("keep")).when(placed > 0, "rename").otherwise("create")
    mm = F.when((action == "keep") | (action == "rename"), old["mm"]).otherwise(want["elevation"])
    name = F.when(named > 0, old["name"]).otherwise(want["level"])
    new = F.struct(name.alias("name"), mm.alias("mm"), F.when(found > 0, old["was"]).alias("was"), F.when(found > 0, old["ord"]).alias("ord"))
    after = F.when(found > 0, F.transform(have, lambda x, i: F.when(i == found - 1, new).otherwise(x))).otherwise(F.array_append(have, new))
    line = F.struct(want["ord"].alias("seq"), want["level"].alias("level"), action.alias("action"), mm.alias("elevation"), F.when(found > 0, old["name"]).alias("was"))
    return F.struct(after.alias("have"), F.array_append(state["log"], line).alias("log")).cast(_STATE)


def reconcile_levels(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(job_id, seq, level, action, elevation, was) of ``existing(job_id, ord, level, elevation)`` for ``wanted(job_id, ord, level, elevation)``, in mm.

    Wanted levels are taken in order, each after what those before it changed: keep or move the first level of the
    name (in any case), else rename the first one at that height, else create one. Jobs with fewer than two wanted
    levels get the two default ones. Levels whose name nobody wants are deleted, from places above the highest
    wanted one, lowest first. A building's levels are few, so a job's fold is one row's work.
    """
    as_list = lambda df, n: df.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ord").cast("long").alias("ord"), "level", F.col("elevation").cast("double").alias("elevation")))).alias(n))
    rows = as_list(existing, "e").join(as_list(wanted, "w"), "job_id", "full")
    default = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(n).alias("level"), F.lit(mm).alias("elevation")) for i, (n, mm) in enumerate(DEFAULT_LEVELS)])
    rows = rows.withColumn("w", F.when(F.size(F.coalesce("w", F.array())) >= 2, F.col("w")).otherwise(default))
    have = F.transform(F.coalesce("e", F.array().cast("array<struct<ord:bigint,level:string,elevation:double>>")), lambda x: F.struct(x["level"].alias("name"), x["elevation"].alias("mm"), x["level"].alias("was"), x["ord"].alias("ord")))
    start = F.struct(have.alias("have"), F.array().alias("log")).cast(_STATE)
    rows = rows.withColumn("s", F.aggregate("w", start, _step))
    names = F.transform("w", lambda x: F.upper(x["level"]))
    left = F.filter("s.have", lambda x: ~F.array_contains(names, F.upper(x["name"])))
    left = F.array_sort(F.transform(left, lambda x: F.struct(x["mm"].alias("mm"), x["ord"].alias("ord"), x["name"].alias("name"))))
    top = F.array_max("w.elevation")
    gone = F.transform(left, lambda x, i: F.struct(F.lit(None).cast("long").alias("seq"), x["name"].alias("level"), F.lit("delete").alias("action"), (top + PARKED_MM * (i + 1)).alias("elevation"), x["name"].alias("was")))
    return rows.select("job_id", F.explode(F.concat("s.log", gone)).alias("r")).select("job_id", "r.*")


def level_above(levels: DataFrame, bases: DataFrame) -> DataFrame:
    """(job_id, ord, level, elevation): the lowest level of ``levels(job_id, level, elevation)`` above each base of ``bases(job_id, ord, base)``; nulls without one.

    An as-of join: both sides in one order of falling height, and the last level seen before a base is the one.
    A level at the base's height, to 1e-6, is not above it. Of levels at one height the first by name counts.
    """
    a = levels.select("job_id", F.col("elevation").cast("double").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("ord"), F.struct("level", "elevation").alias("_l"))
    b = bases.select("job_id", (F.col("base") + 1e-6).cast("double").alias("_at"), F.lit(0).alias("_side"), F.col("ord").cast("long").alias("ord"), F.lit(None).cast(a.schema["_l"].dataType).alias("_l"))
    order = Window.partitionBy("job_id").orderBy(F.desc("_at"), "_side", F.desc("_l.level"))
    seen = a.unionByName(b).withColumn("_l", F.last("_l", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return seen.where("_side = 0").select("job_id", "ord", F.col("_l.level").alias("level"), F.col("_l.elevation").alias("elevation"))
