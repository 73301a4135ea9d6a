"""Queries of a model session: element scans, snapshots, manifests, training plans."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planframe.functions.text import MARK, SCHEDULE_SIZE, millimetres


def query_elements(elements: DataFrame, category: str | None = None, ids: list[int] | None = None, scanned: int = 5000) -> DataFrame:
    """Elements with a box among the first ``scanned`` that match; ``truncated`` tells if more matched.

    The limit is part of the query and holds before elements without a box are left out.
    """
    hits = elements
    if ids is not None:
        hits = hits.where(F.col("element_id").isin(ids))
    elif category:
        hits = hits.where(F.col("category") == category)
    some = hits.orderBy("element_id").limit(scanned + 1)
    n = some.agg((F.count(F.lit(1)) > scanned).alias("truncated"))
    return some.orderBy("element_id").limit(scanned).where("bbox is not null").crossJoin(F.broadcast(n))


def families(symbols: DataFrame) -> DataFrame:
    """(family_name, types, n): families with their type names in order; those without types are not listed."""
    rows = symbols.groupBy("family_name").agg(F.array_sort(F.collect_set("type_name")).alias("types"))
    return rows.withColumn("n", F.size("types")).where("n > 0")


#: The size parameters of a type that are listed, in feet as the program holds them, and the names they are listed under.
SIZES = {"b": "b_mm", "h": "h_mm", "Width": "width_mm", "Depth": "depth_mm", "Height": "height_mm", "Diameter": "diameter_mm"}


def family_types(symbols: DataFrame) -> DataFrame:
    """(family_name, types): families with their types ``(element_id, type_name, sizes...)``, by element, of ``symbols(family_name, type_name, element_id, parameters map<string,double>)``."""
    size = lambda name: millimetres(F.try_element_at("parameters", F.lit(name)))
    kind = F.struct("element_id", "type_name", *[size(n).alias(c) for n, c in SIZES.items()])
    return symbols.where("type_name is not null").groupBy("family_name").agg(F.array_sort(F.collect_list(kind)).alias("types"))


def last_health(beats: DataFrame) -> DataFrame:
    """(service, healthy, at): what the latest of the heartbeats ``(service, ts, healthy)`` of each service says."""
    return beats.groupBy("service").agg(F.max_by("healthy", "ts").alias("healthy"), F.max("ts").alias("at"))


def manifest(symbols: DataFrame) -> DataFrame:
    """(kind, entry): distinct Family::Type of each kind, sorted."""
    return symbols.select("kind", F.concat_ws("::", "family_name", "type_name").alias("entry")).distinct().orderBy("kind", "entry")


def training_plan(corrections: DataFrame, renders: DataFrame, classes: dict[str, int]) -> DataFrame:
    """(id, label, status) of corrections ``(id, job_id, element_type, x1 .. y2, is_delete)``: what a detector would be retrained on.

    Without a box or a render a correction is skipped; a box is clamped to the render, and one with nothing
    left is skipped; a deletion has an empty label, an unknown class a comment.
    """
    rows = corrections.join(renders.select("job_id", "width_px", "height_px"), "job_id", "left")
    clamp = lambda c, m: F.greatest(F.lit(0.0), F.least(F.col(c), F.col(m)))
    w, h = clamp("x2", "width_px") - clamp("x1", "width_px"), clamp("y2", "height_px") - clamp("y1", "height_px")
    known = F.create_map(*[F.lit(x) for kv in classes.items() for x in kv])
    number = F.try_element_at(known, F.col("element_type"))
    label = F.when(F.col("is_delete"), "").when(number.isNull(), F.concat(F.lit("# "), F.col("element_type"))).otherwise(F.format_string("%d 0.5 0.5 1.0 1.0", number))
    status = F.when(F.col("x1").isNull() | F.col("x2").isNull() | F.col("y1").isNull() | F.col("y2").isNull(), "no box").when(F.col("width_px").isNull(), "no render").when((w <= 0) | (h <= 0), "empty box").otherwise("written")
    return rows.select("id", F.when(status == "written", label).alias("label"), status.alias("status"))


def schedule_pages(texts: DataFrame, hits: int = 3) -> DataFrame:
    """(job_id, page_idx, schedule_hits, is_schedule): a page is a schedule if enough of its texts hold a mark and a size."""
    both = F.col("text").rlike(MARK) & F.col("text").rlike(SCHEDULE_SIZE)
    n = texts.groupBy("job_id", "page_idx").agg(F.count_if(both).alias("schedule_hits"))
    return n.withColumn("is_schedule", F.col("schedule_hits") >= hits)


def enrich(elements: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with the metadata of their position; a job whose two counts differ is left as it is."""
    n = elements.groupBy("job_id").agg(F.count(F.lit(1)).alias("_n")).join(metadata.groupBy("job_id").agg(F.count(F.lit(1)).alias("_m")), "job_id").where("_n = _m").select("job_id", F.lit(True).alias("_same"))
    meta = metadata.select("job_id", "ord", *[F.col(k).alias(f"_{k}") for k in keys])
    out = elements.join(n, "job_id", "left").join(meta, ["job_id", "ord"], "left")
    return out.select(*elements.columns, *[F.when(F.col("_same"), F.col(f"_{k}")).alias(k) for k in keys])


def merge_validated(elements: DataFrame, validated: DataFrame, fields: list[str]) -> DataFrame:
    """Elements ``(job_id, kind, ord, fields...)`` with the fields that ``validated(job_id, kind, ord, fields...)`` has for their number; a null there changes nothing."""
    new = validated.select("job_id", "kind", "ord", *[F.col(f).alias(f"_{f}") for f in fields])
    out = elements.join(new, ["job_id", "kind", "ord"], "left")
    return out.select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else c for c in elements.columns])


def snapshot(levels: DataFrame, symbols: DataFrame, placed: DataFrame) -> DataFrame:
    """(part, ord, name, value): a session's levels by elevation, its families by name with how many types they have, and its placed elements by kind."""
    by = lambda order: F.row_number().over(Window.partitionBy("session_id").orderBy(*order))
    l_ = levels.select("session_id", F.lit("level").alias("part"), by(["elevation", "level"]).alias("ord"), F.col("level").alias("name"), F.col("elevation").cast("double").alias("value"))
    f = symbols.groupBy("session_id", "family_name").agg(F.count_distinct("type_name").alias("n"))
    f = f.select("session_id", F.lit("family").alias("part"), by(["family_name"]).alias("ord"), F.col("family_name").alias("name"), F.col("n").cast("double").alias("value"))
    e = placed.groupBy("session_id", "kind").agg(F.count(F.lit(1)).alias("n"))
    e = e.select("session_id", F.lit("placed").alias("part"), by(["kind"]).alias("ord"), F.col("kind").alias("name"), F.col("n").cast("double").alias("value"))
    return l_.unionByName(f).unionByName(e)


def merge_snapshots(patches: DataFrame) -> DataFrame:
    """(user_id, key, value): for each key of ``patches(user_id, ord, patch)``, JSON objects, what its latest patch says."""
    each = patches.select("user_id", "ord", F.explode(F.from_json("patch", "map<string,string>")).alias("key", "value"))
    return each.groupBy("user_id", "key").agg(F.max_by("value", "ord").alias("value"))


def detection_counts(boxes: DataFrame) -> DataFrame:
    """(job_id, type, n) of the types that a job has."""
    return boxes.groupBy("job_id", "type").agg(F.count(F.lit(1)).alias("n"))


def check_counts(judged: DataFrame) -> DataFrame:
    """(job_id, valid, flagged, orphans, violating) of ``judged(job_id, is_valid, is_orphan, is_compliant)``."""
    n = lambda c: F.count_if(c)
    return judged.groupBy("job_id").agg(n(F.col("is_valid")).alias("valid"), n(~F.col("is_valid")).alias("flagged"), n(F.col("is_orphan")).alias("orphans"), n(~F.col("is_compliant")).alias("violating"))


def examples(rejected: DataFrame, keys: list[str], most: int) -> DataFrame:
    """For each key the first ``most`` rows by ord: the few examples that a report shows."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    return rejected.withColumn("_rn", rn).where(F.col("_rn") <= most).drop("_rn")


def review_gate(elements: DataFrame, paths: DataFrame, least_confidence: float = 0.6, share: float = 0.30, scanned_paths: int = 50) -> DataFrame:
    """(job_id, n, unsure, n_paths, reasons): why a person has to look at a job before it is built.

    fallback_grid where its grid is the default one, scanned with under ``scanned_paths`` paths, unsure where more than
    ``share`` of its elements ``(job_id, confidence, has_grid)`` are below the confidence asked for.
    """
    e = elements.groupBy("job_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") < least_confidence).alias("unsure"), F.bool_and("has_grid").alias("_grid"))
    p = paths.groupBy("job_id").agg(F.count(F.lit(1)).alias("n_paths"))
    out = e.join(p, "job_id", "left").withColumn("n_paths", F.coalesce("n_paths", F.lit(0)))
    reasons = F.concat_ws(",", F.when(~F.col("_grid"), "fallback_grid"), F.when(F.col("n_paths") < scanned_paths, "scanned"), F.when(F.col("unsure") / F.col("n") > share, "unsure"))
    return out.select("job_id", "n", "unsure", "n_paths", reasons.alias("reasons"))
