"""The job store as folds over an ordered operation log, and its eviction."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planframe.options import DEFAULTS, Options


def fold(ops: DataFrame) -> DataFrame:
    """(job_id, key, value, created_ord, accessed_ord) of ``ops(job_id, ord, op, payload)``.

    put replaces the data and keeps the creation; update merges keys and is passed over before the first put;
    get and update touch; contains does not. Each key has the value of its latest write since the latest put.
    """
    puts = ops.where("op = 'put'").groupBy("job_id").agg(F.min("ord").alias("created_ord"), F.max("ord").alias("_put"))
    live = ops.join(puts, "job_id").where(F.col("ord") >= F.col("created_ord"))
    touched = live.where("op <> 'contains'").groupBy("job_id").agg(F.max("ord").alias("accessed_ord"))
    writes = live.where((F.col("ord") >= F.col("_put")) & F.col("op").isin("put", "update"))
    keys = writes.select("job_id", "ord", F.explode(F.from_json("payload", "map<string,string>")).alias("key", "value"))
    latest = keys.groupBy("job_id", "key").agg(F.max_by("value", "ord").alias("value"))
    return latest.join(puts.drop("_put"), "job_id").join(touched, "job_id")


def set_nested(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(job_id, key, subkey, value): ``state(job_id, key, subkey, value)`` of jobs that are there, after ``changes(job_id, ord, key, subkey, value)``, the latest of each subkey."""
    known = changes.join(state.select("job_id").distinct(), "job_id", "left_semi")
    new = known.groupBy("job_id", "key", "subkey").agg(F.max_by("value", "ord").alias("value"))
    return state.join(new, ["job_id", "key", "subkey"], "left_anti").select("job_id", "key", "subkey", "value").unionByName(new)


def count(jobs: DataFrame) -> DataFrame:
    """(n): how many jobs there are."""
    return jobs.agg(F.count_distinct("job_id").alias("n"))


def completed(jobs: DataFrame) -> DataFrame:
    """Jobs ``(job_id, status)`` with ``error``: not_completed where they are not."""
    return jobs.withColumn("error", F.when(F.coalesce(F.col("status") != "completed", F.lit(True)), "not_completed"))


def survivors(jobs: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, accessed_ord) that stay: over the limit, the least recently used n - max + 1 go (one more than needed).

    One row more than the limit is taken, a top-k that Spark takes from each partition before it orders them; whether it is
    there tells how many of those few rows stay.
    """
    some = jobs.select("job_id", "accessed_ord").orderBy(F.desc("accessed_ord"), F.desc("job_id")).limit(options.max_jobs + 1)
    order = Window.orderBy(F.desc("accessed_ord"), F.desc("job_id"))
    some = some.withColumns({"_rn": F.row_number().over(order), "_n": F.count(F.lit(1)).over(Window.partitionBy())})
    return some.where((F.col("_n") <= options.max_jobs) | (F.col("_rn") < options.max_jobs)).select("job_id", "accessed_ord")


def routed_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Events with the user whose link to their job is the latest; null without one."""
    latest = links.groupBy("job_id").agg(F.max_by("user_id", "ts").alias("user_id"))
    return events.join(latest, "job_id", "left")


def history(messages: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The last messages of each user."""
    rn = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ord")))
    return messages.withColumn("_rn", rn).where(F.col("_rn") <= options.history).drop("_rn")


def sessions(events: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(job_id, started, ended, n): events of a user with gaps of up to the time-to-live; a gap of exactly that stays."""
    last = F.lag("ts").over(Window.partitionBy("job_id").orderBy("ts"))
    new = (F.col("ts") > F.col("_last") + F.expr(f"interval {options.session_minutes} minutes")) | F.col("_last").isNull()
    numbered = events.withColumn("_last", last).withColumn("_s", F.sum(new.cast("int")).over(Window.partitionBy("job_id").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)))
    show = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return numbered.groupBy("job_id", "_s").agg(show(F.min("ts")).alias("started"), show(F.max("ts")).alias("ended"), F.count(F.lit(1)).alias("n")).drop("_s")
