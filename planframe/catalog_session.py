"""Registered queries of sessions, sheets, warnings and small rules, over views of the driver's tables, and their SQL for DuckDB."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planframe.functions import answers
from planframe.functions.geometry import to_pt, to_px
from planframe.functions.text import is_join_error, parameter, tag_join
from planframe.operators import admit, alerts, annotate, boxes, detect, jobs, library, recipe, sanitize, session
from planframe.plans.adapters import view
from planframe.registry import query, rounded
from planframe.sources import readers


def _kinds(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    rows = view(spark, d, "detections")
    return [rows.where(F.col("type") == n) for n in names]


@query(
    "element_query",
    """, h AS (SELECT ord, x1, has_path, count(*) OVER () AS n FROM (SELECT f.ord, has_path, x1 FROM families_v f JOIN detections_v USING (ord) WHERE f.ord % 3 = 0) t)
    SELECT ord AS element_id, x1, n > 5000 AS truncated FROM (SELECT * FROM h ORDER BY ord LIMIT 5000) k WHERE has_path""",
    "families", "detections",
)
def element_query(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "families").join(view(spark, d, "detections"), "ord")
    rows = rows.select(F.col("ord").alias("element_id"), F.when(F.col("ord") % 3 == 0, "OST_Columns").otherwise("other").alias("category"), "x1", F.when(F.col("has_path"), F.col("x2")).alias("bbox"))
    return session.query_elements(rows, "OST_Columns").select("element_id", "x1", "truncated")


@query("family_types_listed", "SELECT family_name, array_to_string(list_sort(list(DISTINCT type_name)), ';') AS types, count(DISTINCT type_name) AS n FROM families_v GROUP BY family_name", "families")
def family_types_listed(spark: SparkSession, d: str) -> DataFrame:
    return session.families(view(spark, d, "families")).select("family_name", F.array_join("types", ";").alias("types"), F.col("n").cast("long").alias("n"))


@query("manifest_entries", "SELECT DISTINCT category AS kind, family_name || '::' || type_name AS entry FROM families_v ORDER BY 1, 2", "families")
def manifest_entries(spark: SparkSession, d: str) -> DataFrame:
    return session.manifest(view(spark, d, "families").withColumnRenamed("category", "kind"))


@query(
    "training_plan",
    """, r AS (SELECT ord AS id, d.type, ord % 4 = 0 AS gone, CASE WHEN ord % 10 <> 3 THEN x1 - 50 END AS x1, y1 - 50 AS y1, x2 - 50 AS x2, y2 - 50 AS y2, p.job_id AS page, least(greatest(x2 - 50, 0), 3400) - least(greatest(x1 - 50, 0), 3400) AS w, least(greatest(y2 - 50, 0), 2400) - least(greatest(y1 - 50, 0), 2400) AS h
        FROM detections_v d LEFT JOIN (SELECT job_id FROM pages_v WHERE job_id % 5 <> 2) p ON d.job_id = p.job_id),
    s AS (SELECT *, CASE WHEN x1 IS NULL THEN 'no box' WHEN page IS NULL THEN 'no render' WHEN w <= 0 OR h <= 0 THEN 'empty box' ELSE 'written' END AS status FROM r)
    SELECT id, CASE WHEN status <> 'written' THEN NULL WHEN gone THEN '' WHEN type = 'column' THEN '0 0.5 0.5 1.0 1.0' WHEN type = 'slab' THEN '3 0.5 0.5 1.0 1.0' ELSE '# ' || type END AS label, status FROM s""",
    "detections", "pages",
)
def training_plan(spark: SparkSession, d: str) -> DataFrame:
    moved = {c: F.col(c) - 50 for c in ("y1", "x2", "y2")} | {"x1": F.when(F.col("ord") % 10 != 3, F.col("x1") - 50)}
    log = view(spark, d, "detections").withColumns(moved).select(F.col("ord").alias("id"), "job_id", F.col("type").alias("element_type"), "x1", "y1", "x2", "y2", (F.col("ord") % 4 == 0).alias("is_delete"))
    return session.training_plan(log, view(spark, d, "pages").where("job_id % 5 <> 2"), {"column": 0, "slab": 3})


@query(
    "schedule_pages",
    r""", h AS (SELECT job_id, ord % 40 AS page_idx, count(*) FILTER (WHERE regexp_matches(text, '\b[A-Z]{1,3}\d{1,3}\b') AND regexp_matches(text, '\d{2,4}\s*[xX×*]\s*\d{2,4}|[Ø⌀∅]')) AS schedule_hits FROM spans_v GROUP BY ALL)
    SELECT *, schedule_hits >= 3 AS is_schedule FROM h""",
    "spans",
)
def schedule_pages(spark: SparkSession, d: str) -> DataFrame:
    return session.schedule_pages(view(spark, d, "spans").withColumn("page_idx", F.col("ord") % 40))


@query(
    "schedule_texts",
    ", f AS (SELECT job_id, -1 AS page_idx, ord, text FROM spans_v WHERE ord % 4 = 0 UNION ALL SELECT job_id, ord % 4, ord, text FROM spans_v WHERE ord % 4 = 2) SELECT job_id, text, row_number() OVER (PARTITION BY job_id ORDER BY page_idx, ord) - 1 AS ord FROM f",
    "spans",
)
def schedule_texts(spark: SparkSession, d: str) -> DataFrame:
    spans = view(spark, d, "spans").select("job_id", "ord", "text")
    pages = spans.where("ord % 4 <> 0").withColumn("page_idx", (F.col("ord") % 4).cast("int"))
    flags = pages.select("job_id", "page_idx").distinct().withColumn("is_schedule", F.col("page_idx") == 2)
    return annotate.schedule_texts(spans.where("ord % 4 = 0"), pages, flags).select("job_id", "text", "ord")


@query(
    "enriched",
    ", m AS (SELECT job_id, ord, 'M' || CAST(ord % 9 AS VARCHAR) AS mark FROM detections_v WHERE NOT (job_id % 3 = 1 AND ord % 50 = 7)), n AS (SELECT d.job_id, count(*) AS n FROM detections_v d GROUP BY 1), k AS (SELECT job_id, count(*) AS n FROM m GROUP BY 1) SELECT d.job_id, d.ord, CASE WHEN n.n = k.n THEN mark END AS mark FROM detections_v d JOIN n USING (job_id) LEFT JOIN k ON d.job_id = k.job_id LEFT JOIN m ON d.job_id = m.job_id AND d.ord = m.ord",
    "detections",
)
def enriched(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").select("job_id", "ord")
    meta = rows.where("not (job_id % 3 = 1 and ord % 50 = 7)").withColumn("mark", F.concat(F.lit("M"), (F.col("ord") % 9).cast("string")))
    return session.enrich(rows, meta, ["mark"])


@query("validated_merge", "SELECT job_id, type AS kind, ord, CASE WHEN ord % 3 = 0 AND ord % 2 = 0 THEN x1 + 1 ELSE x1 END AS x1, CASE WHEN ord % 3 = 0 AND ord % 5 > 0 THEN y1 + 2 ELSE y1 END AS y1 FROM detections_v", "detections")
def validated_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").select("job_id", F.col("type").alias("kind"), "ord", "x1", "y1")
    told = rows.where("ord % 3 = 0").withColumns({"x1": F.when(F.col("ord") % 2 == 0, F.col("x1") + 1), "y1": F.when(F.col("ord") % 5 > 0, F.col("y1") + 2)})
    return session.merge_validated(rows, told, ["x1", "y1"])


@query("storeys", "SELECT job_id, coalesce(arg_min(y2, ord) FILTER (WHERE y2 BETWEEN 2000 AND 6000), 5000) AS storey_mm FROM detections_v GROUP BY job_id", "detections")
def storeys(spark: SparkSession, d: str) -> DataFrame:
    return recipe.levels(view(spark, d, "detections").select("job_id", "ord", F.col("y2").alias("ceiling_height")))


@query("check_counts", "SELECT job_id, count(*) FILTER (WHERE x1 > 500) AS valid, count(*) FILTER (WHERE NOT x1 > 500) AS flagged, count(*) FILTER (WHERE y1 > 2500) AS orphans, count(*) FILTER (WHERE NOT x2 - x1 > 20) AS violating FROM detections_v GROUP BY job_id", "detections")
def check_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections")
    return session.check_counts(rows.select("job_id", (F.col("x1") > 500).alias("is_valid"), (F.col("y1") > 2500).alias("is_orphan"), (F.col("x2") - F.col("x1") > 20).alias("is_compliant")))


@query("element_totals", "SELECT k.kind, count(d.ord) AS n FROM (VALUES ('column', 'columns'), ('slab', 'slabs'), ('stair', 'stairs')) k(type, kind) LEFT JOIN detections_v d ON d.type = k.type GROUP BY k.kind", "detections")
def element_totals(spark: SparkSession, d: str) -> DataFrame:
    columns, slabs, stairs = _kinds(spark, d, "column", "slab", "stair")
    return recipe.totals(columns=columns, slabs=slabs, stairs=stairs)


@query(
    "session_snapshot",
    """ SELECT job_id AS session_id, 'level' AS part, row_number() OVER (PARTITION BY job_id ORDER BY elevation, level) AS ord, level AS name, elevation AS value FROM site_levels_v
    UNION ALL SELECT job_id, 'family', row_number() OVER (PARTITION BY job_id ORDER BY family), family, CAST(count(DISTINCT type_name) AS DOUBLE) FROM known_types_v GROUP BY job_id, family
    UNION ALL SELECT job_id, 'placed', row_number() OVER (PARTITION BY job_id ORDER BY kind), kind, CAST(count(*) AS DOUBLE) FROM scene_items_v GROUP BY job_id, kind""",
    "site_levels", "known_types", "scene_items",
)
def session_snapshot(spark: SparkSession, d: str) -> DataFrame:
    named = lambda n: view(spark, d, n).withColumnRenamed("job_id", "session_id")
    out = session.snapshot(named("site_levels"), named("known_types").withColumnRenamed("family", "family_name"), named("scene_items"))
    return out.select("session_id", "part", F.col("ord").cast("long").alias("ord"), "name", "value")


_DECIDED = "CASE ord % 3 WHEN 0 THEN 'admit_with_fix' WHEN 1 THEN 'reject' ELSE 'admit' END", "CASE WHEN ord % 2 = 0 THEN 'join_conflict_unsupported' ELSE 'off_grid' END"


@query("overlay_boxes", f"SELECT job_id, ord, x1, y1, x2, y2, 0 AS blue, CASE WHEN ord % 3 = 0 THEN 200 ELSE 0 END AS green, CASE WHEN ord % 3 = 0 THEN 0 ELSE 255 END AS red, {_DECIDED[1]} AS label FROM detections_v WHERE ord % 3 < 2 AND ord % 2 = 0", "detections")
def overlay_boxes(spark: SparkSession, d: str) -> DataFrame:
    return admit.overlay(view(spark, d, "detections").withColumns({"action": F.expr(_DECIDED[0]), "reason": F.expr(_DECIDED[1])}))


@query("warnings_merged", ", e AS (SELECT text, ord, unnest([ord % 7, ord % 5, 3]) AS id FROM warnings_v) SELECT text, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids, min(ord) AS first FROM e GROUP BY text", "warnings")
def warnings_merged(spark: SparkSession, d: str) -> DataFrame:
    ids = F.array(*[x.cast("int") for x in (F.col("ord") % 7, F.col("ord") % 5, F.lit(3))])
    return alerts.merge(view(spark, d, "warnings").withColumn("element_ids", ids)).select("text", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), "first")


@query(
    "join_tags",
    "SELECT job_id, ord, lower(text) LIKE '%cannot keep%' OR (lower(text) LIKE '%element%' AND lower(text) LIKE '%join%') AS is_join, CASE WHEN lower(text) LIKE '%cannot keep%' OR (lower(text) LIKE '%element%' AND lower(text) LIKE '%join%') THEN '[JOIN-RESOLVED:' || CAST(ord AS VARCHAR) || ',' || CAST(ord + 1 AS VARCHAR) || '] ' || text ELSE text END AS tagged FROM warnings_v",
    "warnings",
)
def join_tags(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return view(spark, d, "warnings").select("job_id", "ord", is_join_error(text).alias("is_join"), tag_join(text, F.array("ord", F.col("ord") + 1)).alias("tagged"))


@query(
    "warning_headers",
    """SELECT ord, CASE WHEN ord % 2 = 0 THEN text || '|' || CAST(ord % 9 AS VARCHAR) ELSE text || '|' END AS w FROM warnings_v""",
    "warnings",
)
def warning_headers(spark: SparkSession, d: str) -> DataFrame:
    two = F.to_json(F.array(F.struct("text", F.array((F.col("ord") % 9).cast("int")).alias("element_ids"))))
    rows = view(spark, d, "warnings").withColumn("header", F.when(F.col("ord") % 2 == 0, two).otherwise(F.to_json(F.array("text"))))
    return rows.select("ord", F.explode(answers.warnings(F.col("header"))).alias("w")).select("ord", F.concat("w.text", F.lit("|"), F.array_join(F.col("w.element_ids").cast("array<string>"), ",")).alias("w"))


@query("file_stems", r"SELECT ord, coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace('_' || name || ' (' || CAST(ord % 4 AS VARCHAR) || ').pdf', '\.[A-Za-z]{1,5}$', ''), '[^\w.\-]+', '_', 'g'), '_+', '_', 'g'), '_'), ''), 'model') AS stem FROM family_files_v", "family_files")
def file_stems(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat(F.lit("_"), F.col("name"), F.lit(" ("), (F.col("ord") % 4).cast("string"), F.lit(").pdf"))
    return view(spark, d, "family_files").select("ord", answers.stem(name).alias("stem"))


@query("answer_numbers", "SELECT job_id, ord, try_cast(nullif(regexp_replace(replace(text, ',', ''), '[^0-9.\\-]', '', 'g'), '') AS DOUBLE) AS n FROM spans_v", "spans")
def answer_numbers(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "spans").select("job_id", "ord", answers.number(F.col("text")).alias("n"))


@query("unit_scale", "SELECT job_id, ord, round(sx * 144 / 72.0, 6) AS px, round(sy * 72.0 / 150, 6) AS pt FROM spans_v", "spans")
def unit_scale(spark: SparkSession, d: str) -> DataFrame:
    return rounded(view(spark, d, "spans").select("job_id", "ord", to_px(F.col("sx"), F.lit(144.0)).alias("px"), to_pt(F.col("sy"), F.lit(150.0)).alias("pt")), "px", "pt")


@query(
    "type_values",
    """, p AS (SELECT ord, type_name AS v, CASE ord % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'raw' WHEN 2 THEN 'int' WHEN 3 THEN 'id' WHEN 4 THEN 'string' ELSE 'other' END AS k, CASE WHEN ord % 11 = 0 THEN type_name ELSE CAST(width_mm + 0.5 AS VARCHAR) END AS w FROM families_v)
    SELECT ord, round(CASE k WHEN 'mm' THEN try_cast(w AS DOUBLE) / 304.8 WHEN 'raw' THEN try_cast(w AS DOUBLE) WHEN 'int' THEN floor(try_cast(w AS DOUBLE)) WHEN 'id' THEN floor(try_cast(w AS DOUBLE)) END, 6) AS number, CASE WHEN k = 'string' THEN w END AS text FROM p""",
    "families",
)
def type_values(spark: SparkSession, d: str) -> DataFrame:
    kind = F.expr("CASE ord % 6 WHEN 0 THEN 'mm' WHEN 1 THEN 'raw' WHEN 2 THEN 'int' WHEN 3 THEN 'id' WHEN 4 THEN 'string' ELSE 'other' END")
    value = F.when(F.col("ord") % 11 == 0, F.col("type_name")).otherwise((F.col("width_mm") + 0.5).cast("string"))
    return rounded(view(spark, d, "families").select("ord", parameter(value, kind).alias("p")).select("ord", "p.number", "p.text"), "number")


@query("boxes_stacked", "SELECT job_id, type, ord, row_number() OVER (PARTITION BY job_id ORDER BY CASE type WHEN 'column' THEN 0 ELSE 1 END, ord) - 1 AS all_ord FROM detections_v WHERE type IN ('column', 'structural_framing')", "detections")
def boxes_stacked(spark: SparkSession, d: str) -> DataFrame:
    return boxes.stacked(*_kinds(spark, d, "column", "structural_framing")).select("job_id", "type", "ord", F.col("all_ord").cast("long").alias("all_ord"))


@query("boxes_left", "SELECT job_id, ord FROM detections_v WHERE type = 'column' AND ord % 5 <> 0", "detections")
def boxes_left(spark: SparkSession, d: str) -> DataFrame:
    columns = _kinds(spark, d, "column")[0].select("job_id", "ord")
    return boxes.drop_by_id(columns, columns.where("ord % 5 = 0"))


@query(
    "clamp_actions",
    "SELECT job_id, ord, 'width_mm' AS field, (x2 - x1) * 8 AS old, CAST(200 AS DOUBLE) AS new FROM detections_v WHERE (x2 - x1) * 8 < 200 UNION ALL SELECT job_id, ord, 'depth_mm', (y2 - y1) * 8, 200 FROM detections_v WHERE (y2 - y1) * 8 < 200",
    "detections",
)
def clamp_actions(spark: SparkSession, d: str) -> DataFrame:
    sides = view(spark, d, "detections").select("job_id", "ord", ((F.col("x2") - F.col("x1")) * 8).alias("width_mm"), ((F.col("y2") - F.col("y1")) * 8).alias("depth_mm"))
    return sanitize.clamp_actions(sides)


@query("events_routed", ", l AS (SELECT job_id, arg_max(ord % 13, ord) AS user_id FROM job_ops_v WHERE op = 'put' GROUP BY job_id) SELECT job_id, ord, l.user_id FROM job_ops_v LEFT JOIN l USING (job_id)", "job_ops")
def events_routed(spark: SparkSession, d: str) -> DataFrame:
    ops = view(spark, d, "job_ops").select("job_id", "ord", "op")
    links = ops.where("op = 'put'").select("job_id", (F.col("ord") % 13).alias("user_id"), F.col("ord").alias("ts"))
    return jobs.routed_events(ops.drop("op"), links)


@query("page_extents", ", b AS (SELECT job_id, min(x1) AS x0, min(y1) AS y0, max(x2) - min(x1) AS w, max(y2) - min(y1) AS h FROM strokes_v WHERE job_id % 4 <> 1 GROUP BY job_id) SELECT job_id, coalesce(x0, 0) AS x0, coalesce(y0, 0) AS y0, coalesce(w, 3370) AS w_pt, coalesce(h, 2384) AS h_pt FROM pages_v LEFT JOIN b USING (job_id)", "pages", "strokes")
def page_extents(spark: SparkSession, d: str) -> DataFrame:
    return detect.page_bounds(view(spark, d, "pages"), view(spark, d, "strokes").where("job_id % 4 <> 1"))


@query("page_tiles", "SELECT job_id, CAST(x AS INT) AS tx, CAST(y AS INT) AS ty FROM (SELECT job_id, unnest(range(CAST(greatest(ceil(width_px * (1 + job_id % 3) / 2000.0), 1) AS BIGINT))) AS x, height_px FROM pages_v) t, range(2) r(y)", "pages")
def page_tiles(spark: SparkSession, d: str) -> DataFrame:
    return readers.tiles(spark, view(spark, d, "pages").withColumn("width_px", F.col("width_px") * (1 + F.col("job_id") % 3)))


@query("jobs_completed", ", s AS (SELECT job_id, arg_max(op, ord) AS status FROM job_ops_v GROUP BY job_id) SELECT job_id, status, CASE WHEN status <> 'update' THEN 'not_completed' END AS error FROM s", "job_ops")
def jobs_completed(spark: SparkSession, d: str) -> DataFrame:
    last = view(spark, d, "job_ops").groupBy("job_id").agg(F.max_by("op", "ord").alias("status"))
    done = jobs.completed(last.withColumn("status", F.when(F.col("status") == "update", "completed").otherwise(F.col("status"))))
    return done.withColumn("status", F.when(F.col("status") == "completed", "update").otherwise(F.col("status")))


@query(
    "nested_updates",
    """, s AS (SELECT job_id, CAST(ord % 5 AS VARCHAR) AS key, CAST(ord % 3 AS VARCHAR) AS subkey, max(ord) AS o, CAST(max(ord) AS VARCHAR) AS value FROM job_ops_v WHERE op = 'put' GROUP BY ALL),
    c AS (SELECT job_id, CAST(ord % 5 AS VARCHAR) AS key, CAST(ord % 4 AS VARCHAR) AS subkey, 'n' || CAST(max(ord) AS VARCHAR) AS value FROM job_ops_v WHERE op = 'update' AND job_id IN (SELECT job_id FROM s) GROUP BY ALL)
    SELECT job_id, key, subkey, value FROM c UNION ALL SELECT job_id, key, subkey, value FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.job_id = s.job_id AND c.key = s.key AND c.subkey = s.subkey)""",
    "job_ops",
)
def nested_updates(spark: SparkSession, d: str) -> DataFrame:
    ops = view(spark, d, "job_ops").withColumn("key", (F.col("ord") % 5).cast("string"))
    state = ops.where("op = 'put'").groupBy("job_id", "key", (F.col("ord") % 3).cast("string").alias("subkey")).agg(F.max("ord").cast("string").alias("value"))
    changes = ops.where("op = 'update'").select("job_id", "ord", "key", (F.col("ord") % 4).cast("string").alias("subkey"), F.concat(F.lit("n"), F.col("ord").cast("string")).alias("value"))
    return jobs.set_nested(state, changes)


@query("sidecars_alone", "SELECT s.ord FROM family_files_v s WHERE s.ord % 3 = 1 AND NOT EXISTS (SELECT 1 FROM family_files_v b WHERE b.ord % 3 <> 1 AND lower(b.name) = lower(s.name))", "family_files")
def sidecars_alone(spark: SparkSession, d: str) -> DataFrame:
    files = view(spark, d, "family_files").select("ord", F.col("name").alias("stem"))
    return library.uncovered_sidecars(files.where("ord % 3 <> 1"), files.where("ord % 3 = 1")).select("ord")
