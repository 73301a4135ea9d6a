"""Analytics of human corrections: counts, firm defaults, newest-first export, training labels."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.binning import first_by, ranked
from planframe.options import DEFAULTS, Options


def stats(corrections: DataFrame) -> DataFrame:
    """One row: total, deletes, edits and the latest time (null without corrections)."""
    return corrections.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_delete").alias("deletes"),
        F.count_if(~F.col("is_delete")).alias("edits"),
        F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("latest"),
    )


def stats_by_type(corrections: DataFrame) -> DataFrame:
    return corrections.groupBy("element_type").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_delete").alias("deletes"))


def defaults(corrections: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """(element_type, field, value, n_value, n_observed): the commonest value of each edited field, the first seen of equals.

    Only edits count, and only fields observed ``min_observations`` times or more. Values compare as their JSON text.
    """
    edits = corrections.where(~F.col("is_delete")).select("id", "element_type", F.explode(F.from_json("changes", "map<string,string>")).alias("field", "value"))
    edits = edits.where("value is not null")
    counts = edits.groupBy("element_type", "field", "value").agg(F.count(F.lit(1)).alias("n_value"), F.min("id").alias("first_id"))
    observed = counts.groupBy("element_type", "field").agg(F.sum("n_value").alias("n_observed")).where(F.col("n_observed") >= options.min_observations)
    best = first_by(counts, ["element_type", "field"], [-F.col("n_value"), F.col("first_id")], ["value", "n_value"])
    return best.join(observed, ["element_type", "field"])


def export(corrections: DataFrame, options: Options = DEFAULTS) -> DataFrame:
    """The newest corrections first, up to the export limit, later ids first among equal times."""
    newest = corrections.orderBy(F.desc("ts"), F.desc("id")).limit(options.export_limit)
    return newest.select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "job_id", "element_type", "element_index", "changes", F.col("is_delete").cast("int").alias("is_delete"))


def log(corrections: DataFrame) -> DataFrame:
    """All corrections, oldest first, earlier ids first among equal times."""
    return corrections.orderBy("ts", "id").select("id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"), "job_id", "element_type", "element_index", "changes", F.col("is_delete").cast("int").alias("is_delete"))


def train_split(corrections: DataFrame, share: float = 0.2) -> DataFrame:
    """(job_id, split): sorted jobs, the first max(1, n * share) of them for validation."""
    jobs = ranked(corrections.select("job_id").distinct(), "job_id", "_rn")
    n = jobs.agg(F.max("_rn").alias("_n"))  # one row
    return jobs.crossJoin(F.broadcast(n)).select("job_id", F.when(F.col("_rn") <= F.greatest(F.lit(1), F.floor(F.col("_n") * share)), "val").otherwise("train").alias("split"))


def undeleted(detections: DataFrame, corrections: DataFrame) -> DataFrame:
    """Detections whose type, or its singular, and number no correction of their job deletes."""
    gone = corrections.where("is_delete").select("job_id", F.col("element_type").alias("_kind"), F.col("element_index").cast("long").alias("ord")).distinct()
    either = F.array_distinct(F.array("type", F.regexp_replace("type", "s+$", "")))
    hit = detections.select("job_id", "type", "ord", F.explode(either).alias("_kind")).join(gone, ["job_id", "_kind", "ord"]).select("job_id", "type", "ord").distinct()
    return detections.join(hit, ["job_id", "type", "ord"], "left_anti")


def train_labels(detections: DataFrame, corrections: DataFrame, renders: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(job_id, split, type, ord, line): a line of a detector's training set for each box that stands.

    Jobs are those with corrections and a render. Deleted boxes, types without a class and boxes that are empty or leave the
    picture go; a line is the class and the box's centre and sides as shares of the picture.
    """
    known = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    rows = undeleted(detections, corrections).withColumn("_class", F.try_element_at(known, F.col("type"))).where("_class is not null")
    rows = rows.join(train_split(corrections), "job_id").join(renders.select("job_id", "width_px", "height_px"), "job_id")
    cx, cy = (F.col("x1") + F.col("x2")) / 2 / F.col("width_px"), (F.col("y1") + F.col("y2")) / 2 / F.col("height_px")
    w, h = (F.col("x2") - F.col("x1")) / F.col("width_px"), (F.col("y2") - F.col("y1")) / F.col("height_px")
    good = (w > 0) & (w <= 1) & (h > 0) & (h <= 1) & cx.between(0, 1) & cy.between(0, 1)
    return rows.where(good).select("job_id", "split", "type", "ord", F.format_string("%d %.6f %.6f %.6f %.6f", "_class", cx, cy, w, h).alias("line"))
