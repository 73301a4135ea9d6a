"""All registered queries of the drawing operators, over views of the driver's tables, and their SQL for DuckDB."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planframe import catalog_build, catalog_session  # noqa: F401
from planframe.functions.text import BEAM_MARK, CONCRETE, MARK, RECT, ROUND_FIRST, ROUND_LAST, ROUTES, STEEL, TAG, TAGS, WARNINGS, crop, feet, first_match, millimetres, normal_dims, sized_type
from planframe.operators import admit, alerts, annotate, boxes, corrections, detect, grid, jobs, library, recipe, sanitize, session, strokes
from planframe.options import DEFAULTS, ROUND_FAMILY, ROUND_SIZES, SQUARE_FAMILY, SQUARE_SIZES
from planframe.plans.adapters import view
from planframe.registry import QUERIES, SQL
from planframe.registry import query as _query
from planframe.registry import rounded as _r
from planframe.sources import readers

__all__ = ["QUERIES", "SQL"]

_TS = "strftime({}, '%Y-%m-%d %H:%M:%S.%f')"
_CORR = "corrections"


@_query("corr_stats", f"SELECT count(*) AS total, count(*) FILTER (WHERE is_delete) AS deletes, count(*) FILTER (WHERE NOT is_delete) AS edits, {_TS.format('max(ts)')} AS latest FROM corrections_v", _CORR)
def corr_stats(spark: SparkSession, d: str) -> DataFrame:
    return corrections.stats(view(spark, d, _CORR))


@_query("corr_stats_by_type", "SELECT element_type, count(*) AS n, count(*) FILTER (WHERE is_delete) AS deletes FROM corrections_v GROUP BY element_type", _CORR)
def corr_stats_by_type(spark: SparkSession, d: str) -> DataFrame:
    return corrections.stats_by_type(view(spark, d, _CORR))


@_query(
    "corr_defaults",
    """, e AS (SELECT id, element_type, 'k' AS field, json_extract_string(changes, '$.k') AS value FROM corrections_v WHERE NOT is_delete AND json_extract_string(changes, '$.k') IS NOT NULL),
    c AS (SELECT element_type, field, value, count(*) AS n, min(id) AS f FROM e GROUP BY ALL)
    SELECT element_type, field, arg_min(value, (-n, f)) AS value, CAST(arg_min(n, (-n, f)) AS BIGINT) AS n_value, CAST(sum(n) AS BIGINT) AS n_observed FROM c GROUP BY element_type, field HAVING sum(n) >= 2""",
    _CORR,
)
def corr_defaults(spark: SparkSession, d: str) -> DataFrame:
    return corrections.defaults(view(spark, d, _CORR))


@_query("corr_export", f"SELECT id, {_TS.format('ts')} AS at, job_id, element_type, element_index, changes, CAST(is_delete AS INT) AS is_delete FROM corrections_v ORDER BY ts DESC, id DESC LIMIT 5000", _CORR)
def corr_export(spark: SparkSession, d: str) -> DataFrame:
    return corrections.export(view(spark, d, _CORR))


@_query(
    "train_split",
    ", j AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT job_id FROM corrections_v)) SELECT job_id, CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM j",
    _CORR,
)
def train_split(spark: SparkSession, d: str) -> DataFrame:
    return corrections.train_split(view(spark, d, _CORR))


_FOLD = """, p AS (SELECT job_id, min(ord) AS created_ord, max(ord) AS lp FROM job_ops_v WHERE op = 'put' GROUP BY job_id),
    l AS (SELECT o.*, created_ord, lp FROM job_ops_v o JOIN p USING (job_id) WHERE ord >= created_ord),
    t AS (SELECT job_id, max(ord) AS accessed_ord FROM l WHERE op <> 'contains' GROUP BY job_id),
    k AS (SELECT job_id, 'k' AS key, arg_max(json_extract_string(payload, '$.k'), ord) AS value FROM l WHERE ord >= lp AND op IN ('put', 'update') GROUP BY job_id)"""


@_query("job_store_fold", _FOLD + " SELECT job_id, key, value, created_ord, accessed_ord FROM k JOIN p USING (job_id) JOIN t USING (job_id)", "job_ops")
def job_store_fold(spark: SparkSession, d: str) -> DataFrame:
    return jobs.fold(view(spark, d, "job_ops")).select("job_id", "key", "value", "created_ord", "accessed_ord")


@_query("job_store_lru", _FOLD + " SELECT job_id, accessed_ord FROM t ORDER BY accessed_ord DESC, job_id DESC LIMIT (SELECT CASE WHEN count(*) <= 100 THEN count(*) ELSE 99 END FROM t)", "job_ops")
def job_store_lru(spark: SparkSession, d: str) -> DataFrame:
    return jobs.survivors(jobs.fold(view(spark, d, "job_ops")).select("job_id", "accessed_ord").distinct())


_ROUTE_SQL = "CASE " + " ".join(f"WHEN regexp_matches(content, '{p.replace(chr(39), chr(39) * 2)}') THEN '{n}'" for n, p in ROUTES) + " ELSE 'general' END"


@_query("chat_route", f"SELECT user_id, ord, role, {_ROUTE_SQL} AS route FROM chat_v", "chat")
def chat_route(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "chat").select("user_id", "ord", "role", first_match(F.col("content"), ROUTES, "general").alias("route"))


@_query("chat_history_40", "SELECT user_id, ord, content FROM chat_v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ord DESC) <= 40", "chat")
def chat_history_40(spark: SparkSession, d: str) -> DataFrame:
    return jobs.history(view(spark, d, "chat")).select("user_id", "ord", "content")


@_query(
    "chat_sessions",
    f""", e AS (SELECT job_id, ts, lag(ts) OVER (PARTITION BY job_id ORDER BY ts) AS p FROM job_ops_v),
    s AS (SELECT *, sum(CASE WHEN p IS NULL OR ts > p + INTERVAL 60 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM e)
    SELECT job_id, {_TS.format("min(ts)")} AS started, {_TS.format("max(ts)")} AS ended, count(*) AS n FROM s GROUP BY job_id, s""",
    "job_ops",
)
def chat_sessions(spark: SparkSession, d: str) -> DataFrame:
    return jobs.sessions(view(spark, d, "job_ops"))


@_query(
    "box_filter",
    """SELECT job_id, ord, 2 * x1 AS x1, 2 * y1 AS y1, 2 * x2 AS x2, 2 * y2 AS y2, x1 + x2 AS cx, y1 + y2 AS cy FROM detections_v
    WHERE least(x2 - x1, y2 - y1) >= 10 AND greatest(x2 - x1, y2 - y1) <= CASE type WHEN 'structural_framing' THEN 300 ELSE 80 END
    AND least(x2 - x1, y2 - y1) / greatest(x2 - x1, y2 - y1) >= CASE type WHEN 'column' THEN 0.75 WHEN 'structural_framing' THEN 0 ELSE 0.5 END""",
    "detections",
)
def box_filter(spark: SparkSession, d: str) -> DataFrame:
    return boxes.box_filter(view(spark, d, "detections"), 2.0).select("job_id", "ord", "x1", "y1", "x2", "y2", "cx", "cy")


@_query(
    "type_dispatch",
    """SELECT job_id, ord, regexp_replace(lower(type), 's+$', '') AS kind, CAST(CASE WHEN type = 'structural_framing' THEN 0 ELSE row_number() OVER (PARTITION BY job_id, type ORDER BY ord) - 1 END AS INT) AS id,
    x2 - x1 >= y2 - y1 AS flat, least(x2 - x1, y2 - y1) AS thickness FROM detections_v""",
    "detections",
)
def type_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return boxes.dispatch(view(spark, d, "detections")).select("job_id", "ord", "kind", "id", "flat", "thickness")


_LINES_SQL = "g AS (SELECT job_id, list(px ORDER BY px) FILTER (WHERE axis = 'x') AS xs, list(px ORDER BY px) FILTER (WHERE axis = 'y') AS ys FROM grid_lines_v GROUP BY job_id)"
_C_SQL = "c AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM detections_v)"
_IOU_SQL = """CASE WHEN least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) THEN
    (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1)) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
    - (least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))) ELSE 0.0 END"""


@_query("outside_grid", f", {_LINES_SQL}, {_C_SQL} SELECT job_id, ord, cx BETWEEN xs[1] - 50 AND xs[-1] + 50 AND cy BETWEEN ys[1] - 50 AND ys[-1] + 50 AS kept FROM c JOIN g USING (job_id)", "detections", "grid_lines")
def outside_grid(spark: SparkSession, d: str) -> DataFrame:
    return boxes.outside_grid(view(spark, d, "detections"), view(spark, d, "grid_lines")).select("job_id", "ord", "kept")


_PAIRS_SQL = f"(SELECT a.job_id, a.ord AS a_ord, b.ord AS b_ord, {_IOU_SQL} AS iou FROM detections_v a JOIN detections_v b ON a.job_id = b.job_id AND a.ord < b.ord WHERE a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2)"
_ALONE_SQL = """(SELECT a.job_id, a.ord FROM c a WHERE (SELECT count(*) FROM c b WHERE b.job_id = a.job_id) >= 2
    AND NOT EXISTS (SELECT 1 FROM c b WHERE b.job_id = a.job_id AND b.ord <> a.ord AND sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) <= 200))"""


@_query("iou_overlap", f"SELECT job_id, a_ord, b_ord, round(iou, 6) AS iou FROM {_PAIRS_SQL} WHERE iou > 0.5", "detections")
def iou_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _r(boxes.overlap_pairs(view(spark, d, "detections"), 0.5), "iou")


@_query("isolated", f", {_C_SQL} SELECT job_id, ord FROM {_ALONE_SQL}", "detections")
def isolated(spark: SparkSession, d: str) -> DataFrame:
    return boxes.isolated(view(spark, d, "detections"))


_OFF_SQL = "o AS (SELECT job_id, ord, list_min(list_transform(xs, lambda v: abs(v - cx))) AS dx, list_min(list_transform(ys, lambda v: abs(v - cy))) AS dy FROM c JOIN g USING (job_id))"


@_query("off_grid", f", {_LINES_SQL}, {_C_SQL}, {_OFF_SQL} SELECT job_id, ord, dx, dy, dx > 80 AND dy > 80 AS off_grid FROM o", "detections", "grid_lines")
def off_grid(spark: SparkSession, d: str) -> DataFrame:
    return boxes.off_grid(view(spark, d, "detections"), view(spark, d, "grid_lines")).select("job_id", "ord", "dx", "dy", "off_grid")


@_query(
    "validate_all",
    f""", {_LINES_SQL}, {_C_SQL}, {_OFF_SQL}, p AS (SELECT * FROM {_PAIRS_SQL} WHERE iou > 0.5), h AS (SELECT job_id, a_ord AS ord FROM p UNION SELECT job_id, b_ord FROM p), i AS (SELECT * FROM {_ALONE_SQL})
    SELECT o.job_id, o.ord, concat_ws(',', CASE WHEN h.ord IS NOT NULL THEN 'iou_overlap' END, CASE WHEN dx > 80 AND dy > 80 THEN 'off_grid' END, CASE WHEN i.ord IS NOT NULL THEN 'isolated' END) AS flags,
    NOT (h.ord IS NOT NULL OR (dx > 80 AND dy > 80) OR i.ord IS NOT NULL) AS is_valid FROM o LEFT JOIN h USING (job_id, ord) LEFT JOIN i USING (job_id, ord)""",
    "detections",
    "grid_lines",
)
def validate_all(spark: SparkSession, d: str) -> DataFrame:
    return boxes.validate(view(spark, d, "detections"), view(spark, d, "grid_lines"))


@_query("bay_rules", "SELECT job_id, axis, idx, CASE WHEN spacing_mm < 3000 THEN 'bay_too_narrow_' ELSE 'bay_too_wide_' END || CAST(CAST(round_even(spacing_mm, 0) AS BIGINT) AS VARCHAR) || 'mm' AS violation FROM grid_gaps_v WHERE spacing_mm < 3000 OR spacing_mm > 12000", "grid_gaps")
def bay_rules(spark: SparkSession, d: str) -> DataFrame:
    return boxes.bay_rules(view(spark, d, "grid_gaps"))


@_query(
    "nms",
    f""", br AS (SELECT *, row_number() OVER (PARTITION BY job_id, type ORDER BY confidence DESC, ord) AS rn FROM detections_v),
    bt AS (SELECT b.job_id, b.type, b.ord, b.confidence, b.rn, list(a.ord) FILTER (WHERE a.ord IS NOT NULL) AS better FROM br b LEFT JOIN br a ON a.job_id = b.job_id AND a.type = b.type AND a.rn < b.rn AND {_IOU_SQL} > 0.45 GROUP BY ALL),
    kp AS (SELECT DISTINCT job_id, type, CAST(0 AS BIGINT) AS rn, CAST([] AS BIGINT[]) AS kept FROM bt
        UNION ALL SELECT kp.job_id, kp.type, bt.rn, CASE WHEN list_has_any(kept, coalesce(better, [])) THEN kept ELSE list_append(kept, bt.ord) END FROM kp JOIN bt ON bt.job_id = kp.job_id AND bt.type = kp.type AND bt.rn = kp.rn + 1),
    kl AS (SELECT job_id, type, unnest(arg_max(kept, rn)) AS ord FROM kp GROUP BY job_id, type) SELECT job_id, type, ord, confidence FROM kl JOIN bt USING (job_id, type, ord)""",
    "detections",
)
def nms(spark: SparkSession, d: str) -> DataFrame:
    return boxes.suppress(view(spark, d, "detections")).select("job_id", "type", "ord", "confidence")


_PREFIX_SQL = """w AS (SELECT job_id, axis, idx, coalesce(sum(spacing_mm) OVER (PARTITION BY job_id, axis ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_mm FROM grid_gaps_v
    UNION ALL SELECT job_id, axis, max(idx) + 1, sum(spacing_mm) FROM grid_gaps_v GROUP BY job_id, axis)"""


@_query("grid_prefix_sum", f", {_PREFIX_SQL} SELECT job_id, axis, idx, start_mm FROM w", "grid_gaps")
def grid_prefix_sum(spark: SparkSession, d: str) -> DataFrame:
    return grid.prefix_mm(view(spark, d, "grid_gaps"))


_WORLD_SQL = f"""{_PREFIX_SQL}, {_C_SQL}, l AS (SELECT job_id, axis, idx, px, start_mm AS mm, lead(px) OVER v AS npx, lead(start_mm) OVER v AS nmm,
    min(px) OVER (PARTITION BY job_id, axis) AS p0, max(px) OVER (PARTITION BY job_id, axis) AS p1, max(start_mm) OVER (PARTITION BY job_id, axis) AS m1 FROM grid_lines_v JOIN w USING (job_id, axis, idx) WINDOW v AS (PARTITION BY job_id, axis ORDER BY idx)),
    h AS (SELECT job_id, max(start_mm) AS h FROM w WHERE axis = 'y' GROUP BY job_id),
    u AS (SELECT job_id, ord, 'x' AS axis, cx AS v FROM c UNION ALL SELECT job_id, ord, 'y', cy FROM c),
    m AS (SELECT u.job_id, ord, u.axis, CASE WHEN v >= p1 THEN m1 ELSE mm + (v - px) / (npx - px) * (nmm - mm) END AS mm FROM u JOIN l ON u.job_id = l.job_id AND u.axis = l.axis AND npx IS NOT NULL AND ((v >= px AND v < npx) OR (v >= p1 AND npx = p1) OR (v < p0 AND px = p0))),
    k AS (SELECT job_id, ord, max(mm) FILTER (WHERE axis = 'x') AS wx, max(h) - max(mm) FILTER (WHERE axis = 'y') AS wy FROM m JOIN h USING (job_id) GROUP BY job_id, ord)"""


@_query("px_to_mm", f", {_WORLD_SQL} SELECT job_id, ord, round(wx, 6) AS wx, round(wy, 6) AS wy FROM k", "detections", "grid_lines", "grid_gaps")
def px_to_mm(spark: SparkSession, d: str) -> DataFrame:
    points = boxes.centred(view(spark, d, "detections"))
    return _r(grid.to_world(points, view(spark, d, "grid_lines"), view(spark, d, "grid_gaps")).select("job_id", "ord", "wx", "wy"), "wx", "wy")


_SNAP_SQL = f"""{_WORLD_SQL}, b AS (SELECT job_id, min(spacing_mm) AS bay FROM grid_gaps_v GROUP BY job_id),
    sx AS (SELECT job_id, ord, arg_min(start_mm, (abs(start_mm - wx), idx)) AS lx FROM k JOIN w USING (job_id) WHERE axis = 'x' GROUP BY job_id, ord),
    sy AS (SELECT job_id, ord, arg_min(h - start_mm, (abs(h - start_mm - wy), idx)) AS ly FROM k JOIN w USING (job_id) JOIN h USING (job_id) WHERE axis = 'y' GROUP BY job_id, ord),
    sp AS (SELECT job_id, ord, round(CASE WHEN abs(lx - wx) <= bay / 2 THEN lx ELSE wx END, 6) AS snap_x, round(CASE WHEN abs(ly - wy) <= bay / 2 THEN ly ELSE wy END, 6) AS snap_y
        FROM k JOIN sx USING (job_id, ord) JOIN sy USING (job_id, ord) JOIN b USING (job_id))"""


@_query("grid_snap", f", {_SNAP_SQL} SELECT job_id, ord, snap_x, snap_y FROM sp", "detections", "grid_lines", "grid_gaps")
def grid_snap(spark: SparkSession, d: str) -> DataFrame:
    points = boxes.centred(view(spark, d, "detections"))
    return _r(grid.snap(points, view(spark, d, "grid_lines"), view(spark, d, "grid_gaps")).select("job_id", "ord", "snap_x", "snap_y"), "snap_x", "snap_y")


@_query("label_upper_median", "SELECT job_id, text, list_sort(list(sx))[CAST(floor(count(*) / 2) AS INT) + 1] AS x FROM spans_v GROUP BY job_id, text", "spans")
def label_upper_median(spark: SparkSession, d: str) -> DataFrame:
    return grid.upper_median(view(spark, d, "spans"), ["job_id", "text"], "sx", "x")


_TEXTS_SQL = "t AS (SELECT job_id, ord, CASE WHEN ord % 12 = 5 THEN 'x' ELSE 'y' END AS axis, CASE WHEN ord % 12 = 5 THEN sx ELSE sy END AS pos, CAST(text AS DOUBLE) AS mm FROM spans_v WHERE ord % 6 = 5)"
_GAPS_SQL = "b AS (SELECT job_id, axis, idx AS gap, px AS lo, lead(px) OVER (PARTITION BY job_id, axis ORDER BY idx) AS hi FROM grid_lines_v), n AS (SELECT job_id, axis, gap, lo, hi, hi - lo AS width FROM b WHERE hi IS NOT NULL)"
_GIVEN_SQL = "a AS (SELECT t.job_id, t.axis, ord, mm, min(gap) AS gap, arg_min(width, gap) AS width FROM t JOIN n ON t.job_id = n.job_id AND t.axis = n.axis AND abs(pos - (lo + hi) / 2) < greatest(width / 2, 1) GROUP BY ALL)"
_ASSIGN_SQL = f"{_TEXTS_SQL}, {_GAPS_SQL}, {_GIVEN_SQL}"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("ord") % 12 == 5
    spans = view(spark, d, "spans").where(F.col("text").rlike(r"^\d{3,5}$"))
    return spans.select("job_id", "ord", F.when(x, "x").otherwise("y").alias("axis"), F.when(x, F.col("sx")).otherwise(F.col("sy")).alias("pos"), F.col("text").cast("double").alias("mm")).where("mm between 300 and 30000")


@_query("modal_dim", f", {_TEXTS_SQL}, m AS (SELECT job_id, axis, mm, count(*) AS n, min(ord) AS f FROM t GROUP BY ALL) SELECT job_id, axis, arg_min(mm, (-n, f)) AS mm FROM m GROUP BY job_id, axis", "spans")
def modal_dim(spark: SparkSession, d: str) -> DataFrame:
    return grid.mode_first(_texts(spark, d), ["job_id", "axis"], "mm", "ord", "out").withColumnRenamed("out", "mm")


@_query("gap_assign", f", {_ASSIGN_SQL} SELECT job_id, axis, ord, mm, gap, width FROM a", "spans", "grid_lines")
def gap_assign(spark: SparkSession, d: str) -> DataFrame:
    return grid.assign_gaps(_texts(spark, d), view(spark, d, "grid_lines"))


_INFER_SQL = """c AS (SELECT job_id, axis, mm, count(*) AS n, min((gap, ord)) AS f FROM a GROUP BY ALL), md AS (SELECT job_id, axis, arg_min(mm, (-n, f)) AS modal FROM c GROUP BY job_id, axis),
    wd AS (SELECT job_id, axis, list_sort(list(width))[CAST(floor(count(*) / 2) AS INT) + 1] AS median FROM n GROUP BY job_id, axis),
    s AS (SELECT a.*, abs(mm - modal * width / greatest(median, 1)) AS off, modal * width / greatest(median, 1) AS e FROM a JOIN md USING (job_id, axis) JOIN wd USING (job_id, axis)),
    an AS (SELECT job_id, axis, gap, arg_min(mm, (off, ord)) AS mm, arg_min(width, (off, ord)) AS width FROM s WHERE off / greatest(e, 1) <= 0.30 GROUP BY job_id, axis, gap),
    ra AS (SELECT job_id, axis, list_reduce(list(width / mm ORDER BY gap), lambda a, b: a + b) / count(*) AS ratio FROM an GROUP BY job_id, axis),
    ev AS (SELECT job_id, axis, gap, width FROM (SELECT DISTINCT job_id, axis FROM t) JOIN n USING (job_id, axis)),
    mi AS (SELECT * FROM ev WHERE NOT EXISTS (SELECT 1 FROM an WHERE an.job_id = ev.job_id AND an.axis = ev.axis AND an.gap = ev.gap)),
    tr AS (SELECT mi.job_id, mi.axis, mi.gap, an.mm, an.gap AS g, mi.width / (an.mm * ratio) AS share FROM mi JOIN an USING (job_id, axis) JOIN ra USING (job_id, axis) WHERE an.mm * ratio > 0),
    inf AS (SELECT job_id, axis, gap, arg_min(mm, (round(abs(share - 1), 9), g)) AS mm FROM tr WHERE share BETWEEN 0.5 AND 1.5 GROUP BY job_id, axis, gap),
    z AS (SELECT ev.job_id, ev.axis, ev.gap, coalesce(an.mm, inf.mm, 8400) AS mm, CASE WHEN an.mm IS NOT NULL THEN 'annotated' WHEN inf.mm IS NOT NULL THEN 'inferred' ELSE 'fallback' END AS source
    FROM ev LEFT JOIN an USING (job_id, axis, gap) LEFT JOIN inf USING (job_id, axis, gap))"""


@_query(
    "spacing_infer",
    f", {_ASSIGN_SQL}, {_INFER_SQL} SELECT * FROM z",
    "spans",
    "grid_lines",
)
def spacing_infer(spark: SparkSession, d: str) -> DataFrame:
    return grid.infer_spacings(_texts(spark, d), view(spark, d, "grid_lines"))


@_query("dedup_first_seen", f", {_C_SQL} SELECT job_id, type, ord, cx, cy FROM c QUALIFY row_number() OVER (PARTITION BY job_id, type, round_even(cx / 40, 1), round_even(cy / 40, 1) ORDER BY ord) = 1", "detections")
def dedup_first_seen(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes.centred(view(spark, d, "detections")).withColumns({"_x": F.col("cx") / 40, "_y": F.col("cy") / 40})
    return boxes.first_seen(rows, ["job_id", "type"], "_x", "_y").select("job_id", "type", "ord", "cx", "cy")


@_query(
    "dup_span",
    """, p AS (SELECT job_id, ord, least((round_even(sx / 100, 1), round_even(sy / 100, 1)), (round_even(ex / 100, 1), round_even(ey / 100, 1))) AS a, greatest((round_even(sx / 100, 1), round_even(sy / 100, 1)), (round_even(ex / 100, 1), round_even(ey / 100, 1))) AS b FROM beams_v)
    SELECT job_id, ord FROM p QUALIFY row_number() OVER (PARTITION BY job_id, a, b ORDER BY ord) > 1""",
    "beams",
)
def dup_span(spark: SparkSession, d: str) -> DataFrame:
    point = lambda p: F.struct(F.bround(F.col(f"{p}x") / 100, 1).alias("x"), F.bround(F.col(f"{p}y") / 100, 1).alias("y"))
    rows = view(spark, d, "beams").withColumn("span", F.array_sort(F.array(point("s"), point("e"))))
    rn = F.row_number().over(Window.partitionBy("job_id", "span").orderBy("ord"))
    return rows.withColumn("_rn", rn).where("_rn > 1").select("job_id", "ord")


def _RE(pattern: str) -> str:  # noqa: N802
    """A pattern of ``functions`` as DuckDB takes it inside a string; its case flag is given apart."""
    return pattern.replace("'", "''")


_DIMS_SQL = f"""q AS (SELECT *, nullif(regexp_extract(text, '{_RE(MARK)}', 1), '') AS mark, CAST(nullif(regexp_extract(text, '{_RE(RECT)}', 1), '') AS DOUBLE) AS rw,
    CAST(nullif(regexp_extract(text, '{_RE(RECT)}', 2), '') AS DOUBLE) AS rd, CAST(coalesce(nullif(regexp_extract(text, '{_RE(ROUND_FIRST)}', 1), ''), nullif(regexp_extract(text, '{_RE(ROUND_LAST)}', 1), '')) AS DOUBLE) AS rc FROM spans_v),
    l AS (SELECT job_id, ord, sx, sy, text, mark, coalesce(rw, rc) AS width_mm, coalesce(rd, rc) AS depth_mm, CASE WHEN rw IS NOT NULL THEN FALSE WHEN rc IS NOT NULL THEN TRUE END AS is_circular,
    coalesce(regexp_matches(mark, '{_RE(BEAM_MARK)}'), FALSE) AS is_beam FROM q)"""
_SCHED_SQL = "s AS (SELECT job_id, mark, arg_min(width_mm, ord) AS width_mm, arg_min(depth_mm, ord) AS depth_mm, arg_min(is_circular, ord) AS is_circular FROM l WHERE mark IS NOT NULL AND width_mm IS NOT NULL AND NOT is_beam GROUP BY job_id, mark)"


@_query("dims_extract", f", {_DIMS_SQL} SELECT job_id, ord, mark, width_mm, depth_mm, is_circular, is_beam FROM l", "spans")
def dims_extract(spark: SparkSession, d: str) -> DataFrame:
    return annotate.label_dims(view(spark, d, "spans")).select("job_id", "ord", "mark", "width_mm", "depth_mm", "is_circular", "is_beam")


@_query("schedule_first", f", {_DIMS_SQL}, {_SCHED_SQL} SELECT job_id, mark, width_mm, depth_mm, is_circular FROM s", "spans")
def schedule_first(spark: SparkSession, d: str) -> DataFrame:
    return annotate.schedule(view(spark, d, "spans"))


@_query(
    "annotate_columns",
    f""", {_DIMS_SQL}, {_SCHED_SQL}, {_C_SQL}, k AS (SELECT job_id, ord, cx, cy, greatest(x2 - x1, y2 - y1, 200) * 3.0 AS reach FROM c WHERE type = 'column'),
    n AS (SELECT k.job_id, k.ord, l.ord AS t_ord, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS d, l.mark, l.width_mm, l.depth_mm, l.is_circular FROM k JOIN l ON k.job_id = l.job_id AND NOT is_beam WHERE sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) < reach),
    a AS (SELECT job_id, ord, arg_min({{'w': width_mm, 'd': depth_mm, 'c': is_circular, 'm': mark}}, (d, t_ord)) AS v, 'proximity' AS source FROM n WHERE width_mm IS NOT NULL GROUP BY job_id, ord),
    b AS (SELECT n.job_id, n.ord, arg_min({{'w': s.width_mm, 'd': s.depth_mm, 'c': s.is_circular, 'm': n.mark}}, (d, t_ord)) AS v, 'schedule' AS source FROM n JOIN s ON n.job_id = s.job_id AND n.mark = s.mark GROUP BY n.job_id, n.ord),
    one AS (SELECT job_id, min(width_mm) AS w, min(depth_mm) AS d, bool_or(is_circular) AS c FROM s GROUP BY job_id HAVING count(*) = 1)
    SELECT k.job_id, k.ord, coalesce(a.v.w, b.v.w, one.w, 800) AS width_mm, coalesce(a.v.d, b.v.d, one.d, 800) AS depth_mm, coalesce(a.v.c, b.v.c, one.c, FALSE) AS is_circular,
    CASE WHEN a.ord IS NOT NULL THEN a.v.m ELSE b.v.m END AS type_mark, coalesce(a.source, b.source, CASE WHEN one.w IS NOT NULL THEN 'schedule_fallback' ELSE 'default' END) AS source
    FROM k LEFT JOIN a USING (job_id, ord) LEFT JOIN b USING (job_id, ord) LEFT JOIN one USING (job_id)""",
    "spans",
    "detections",
)
def annotate_columns(spark: SparkSession, d: str) -> DataFrame:
    return annotate.annotate_columns(view(spark, d, "detections").where("type = 'column'"), view(spark, d, "spans"))


_TAG_SQL = f"""g AS (SELECT job_id, ord AS t_ord, sx, sy, upper(text) AS tag FROM spans_v WHERE length(text) <= 10 AND regexp_matches(upper(text), '{_RE(TAG)}')),
    n AS (SELECT c.job_id, c.ord, tag, t_ord, sqrt((cx - sx) * (cx - sx) + (cy - sy) * (cy - sy)) AS dist FROM c JOIN g USING (job_id)),
    tg AS (SELECT job_id, ord, arg_min(tag, (dist, t_ord)) AS tag, min(dist) AS dist FROM n WHERE dist <= {{}} GROUP BY job_id, ord)"""


def _tags(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "spans").where((F.length("text") <= 10) & F.upper("text").rlike(TAG))


@_query("nearest_tag", f", {_C_SQL}, {_TAG_SQL.replace('dist <= {}', 'dist <= 80')} SELECT c.job_id, c.ord, tag, round(dist, 6) AS dist FROM c LEFT JOIN tg USING (job_id, ord)", "detections", "spans")
def nearest_tag(spark: SparkSession, d: str) -> DataFrame:
    return _r(boxes.nearest_tag(view(spark, d, "detections"), _tags(spark, d), DEFAULTS.tag_radius_px), "dist")


_NEAR_SQL = "nc AS (SELECT a.job_id, a.ord, arg_min(b.ord, (sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)), b.ord)) AS near_ord, min(sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))) AS dist FROM c a JOIN c b ON a.job_id = b.job_id AND b.type = 'column' WHERE a.type = 'structural_framing' GROUP BY a.job_id, a.ord)"


@_query("nearest_column", f", {_C_SQL}, {_NEAR_SQL} SELECT job_id, ord, near_ord, round(dist, 6) AS dist FROM c LEFT JOIN nc USING (job_id, ord) WHERE type = 'structural_framing'", "detections")
def nearest_column(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes.centred(view(spark, d, "detections"))
    return _r(boxes.nearest_other(rows.where("type = 'structural_framing'"), rows.where("type = 'column'"), 128.0), "dist")


@_query(
    "dashline_near",
    """SELECT job_id, ord FROM beams_v b WHERE EXISTS (SELECT 1 FROM dashes_v d WHERE d.job_id = b.job_id AND d.axis = b.dir AND abs(CASE WHEN dir = 'x' THEN sy ELSE sx END - perp) <= 150
    AND CASE WHEN dir = 'x' THEN sx ELSE sy END BETWEEN lo - width * 0.5 AND hi + width * 0.5)""",
    "beams",
    "dashes",
)
def dashline_near(spark: SparkSession, d: str) -> DataFrame:
    ends = view(spark, d, "beams").select("job_id", "ord", F.col("dir").alias("axis"), F.col("sx").alias("qx"), F.col("sy").alias("qy"), "width")
    return sanitize.on_dash(ends, view(spark, d, "dashes"))


_NOTES_SQL = """hd AS (SELECT job_id, word_ord AS block, x0 AS hx, y0 AS hy FROM words_v WHERE regexp_matches(trim(text), '(?i)^NOTES:?$')),
    wn AS (SELECT w.*, block, y0 - coalesce(max(y0) OVER (PARTITION BY job_id, block ORDER BY y0, x0, word_ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), hy) > 100 AS far FROM words_v w JOIN hd USING (job_id) WHERE abs(x0 - hx) < 300 AND y0 > hy),
    nb AS (SELECT * EXCLUDE (stop) FROM (SELECT *, sum(CASE WHEN far THEN 1 ELSE 0 END) OVER (PARTITION BY job_id, block ORDER BY y0, x0, word_ord) AS stop FROM wn) WHERE stop = 0)"""

_LEGEND_SQL = f"""{_NOTES_SQL}, c0 AS (SELECT *, upper(trim(text)) AS t, sum(CASE WHEN upper(trim(text)) = 'ALL' OR coalesce(ends_with(p, ','), FALSE) THEN 1 ELSE 0 END) OVER v AS run, bool_or(upper(trim(text)) = 'ALL') OVER (PARTITION BY job_id, block) AS has
        FROM (SELECT *, lag(trim(text)) OVER v AS p FROM nb WINDOW v AS (PARTITION BY job_id, block ORDER BY block_no, line_no, x0, word_ord)) WINDOW v AS (PARTITION BY job_id, block ORDER BY block_no, line_no, x0, word_ord)),
    c1 AS (SELECT *, CASE WHEN has THEN (run, 0) ELSE (CAST(block_no AS HUGEINT), line_no) END AS clause, CASE WHEN regexp_matches(t, '^[0-9]{{3}}[.,]?$') THEN CAST(t[1:3] AS DOUBLE) END AS num FROM c0),
    c2 AS (SELECT job_id, block, clause, sum(num) FILTER (WHERE num BETWEEN 100 AND 600) AS total FROM c1 GROUP BY ALL),
    c3 AS (SELECT DISTINCT job_id, block, clause, regexp_extract(t, '^(NSP[0-9]+)[.,]?$', 1) AS code FROM c1 WHERE regexp_matches(t, '^(NSP[0-9]+)[.,]?$')),
    lg AS (SELECT job_id, code, arg_max(total, (block, clause)) AS thickness_mm FROM c3 JOIN c2 USING (job_id, block, clause) WHERE total IS NOT NULL GROUP BY job_id, code
    UNION ALL SELECT DISTINCT job_id, t, CAST(t[1:3] AS DOUBLE) FROM c1 WHERE regexp_matches(t, '^[0-9]{{3}}CIS$'))"""

_ZONE_SQL = f"{_LEGEND_SQL}, z AS (SELECT v.*, CASE WHEN regexp_matches(v.code, '^\\d{{3}}CIS$') THEN CAST(v.code[1:3] AS DOUBLE) ELSE lg.thickness_mm END AS t FROM zones_v v LEFT JOIN lg ON v.job_id = lg.job_id AND v.code = lg.code)"


def _legend(spark: SparkSession, d: str) -> DataFrame:
    """What the notes of each drawing say."""
    return strokes.clause_totals(strokes.notes_block(view(spark, d, "words")))


@_query("zone_code", f", {_ZONE_SQL} SELECT job_id, zone_ord, code, t AS thickness_mm FROM z", "zones", "words")
def zone_code(spark: SparkSession, d: str) -> DataFrame:
    return annotate.zone_codes(view(spark, d, "zones"), _legend(spark, d)).select("job_id", "zone_ord", "code", F.col("t").alias("thickness_mm"))


@_query(
    "pip_thickness",
    f""", {_ZONE_SQL}, h AS (SELECT s.job_id, s.ord, arg_min(t, zone_ord) AS t FROM slabs_v s JOIN z ON s.job_id = z.job_id AND t IS NOT NULL AND zx >= x1 AND zx < x2 AND zy >= y1 AND zy < y2 GROUP BY s.job_id, s.ord)
    SELECT job_id, ord, coalesce(t, 200) AS thickness_mm FROM slabs_v LEFT JOIN h USING (job_id, ord)""",
    "slabs",
    "zones",
    "words",
)
def pip_thickness(spark: SparkSession, d: str) -> DataFrame:
    return annotate.zone_thickness(annotate.box_points(view(spark, d, "slabs")), view(spark, d, "zones"), _legend(spark, d))


def _near_sql(v: str, sizes: list[int]) -> str:
    return f"list_min(list_transform({sizes}, lambda s, i: (abs(s - {v}), i, CAST(s AS DOUBLE))))[3]"


@_query(
    "normalize_dims",
    f""", r AS (SELECT job_id, ord, CAST(200 + (ord * 37) % 1100 AS DOUBLE) AS w, CAST(200 + (ord * 53) % 1100 AS DOUBLE) AS d, CASE ord % 3 WHEN 0 THEN 'circular' WHEN 1 THEN 'rectangular' ELSE 'square' END AS shape,
    CASE WHEN ord % 2 = 0 THEN CAST(200 + 25 * (ord % 30) AS DOUBLE) END AS aw, CASE WHEN ord % 2 = 0 THEN CAST(200 + 25 * ((ord * 7) % 30) AS DOUBLE) END AS ad FROM detections_v),
    s AS (SELECT *, CASE WHEN shape = 'circular' THEN {_near_sql("greatest(aw, ad)", ROUND_SIZES)} WHEN shape = 'square' OR abs(aw - ad) <= 100 THEN {_near_sql("(aw + ad) / 2", SQUARE_SIZES)} END AS one FROM r),
    t AS (SELECT *, CASE WHEN aw IS NOT NULL THEN coalesce(one, round_even(aw / 50, 0) * 50) WHEN shape = 'circular' THEN {_near_sql("greatest(w, d)", ROUND_SIZES)}
        WHEN shape = 'square' OR 1.0 - least(w, d) / greatest(w, d) <= 0.20 THEN {_near_sql("(w + d) / 2", SQUARE_SIZES)} ELSE round_even(w / 50, 0) * 50 END AS width,
        CASE WHEN aw IS NOT NULL THEN coalesce(one, round_even(ad / 50, 0) * 50) WHEN shape = 'circular' THEN {_near_sql("greatest(w, d)", ROUND_SIZES)}
        WHEN shape = 'square' OR 1.0 - least(w, d) / greatest(w, d) <= 0.20 THEN {_near_sql("(w + d) / 2", SQUARE_SIZES)} ELSE round_even(d / 50, 0) * 50 END AS depth FROM s)
    SELECT job_id, ord, width, depth, CASE WHEN aw IS NULL AND shape = 'circular' THEN 'CIRC' || CAST(CAST(width AS BIGINT) AS VARCHAR)
        ELSE 'RECT' || CAST(CAST(least(width, depth) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(greatest(width, depth) AS BIGINT) AS VARCHAR) || 'mm' END AS suffix FROM t""",
    "detections",
)
def normalize_dims(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    shape = F.when(o % 3 == 0, "circular").when(o % 3 == 1, "rectangular").otherwise("square")
    ann = lambda k: F.when(o % 2 == 0, (200 + 25 * ((o * k) % 30)).cast("double"))
    rows = view(spark, d, "detections").select("job_id", "ord", normal_dims((200 + (o * 37) % 1100).cast("double"), (200 + (o * 53) % 1100).cast("double"), shape, ann(1), ann(7)).alias("n"))
    return rows.select("job_id", "ord", "n.width", "n.depth", "n.suffix")


_STYLE_SQL = """tb AS (SELECT *, floor((x1 + x2) / 2 / 256) AS tx, floor((y1 + y2) / 2 / 256) AS ty FROM detections_v), tp AS (SELECT *, floor((x1 + x2) / 2 / 256) AS tx, floor((y1 + y2) / 2 / 256) AS ty, dashes IN ('[3 2] 0', '[5] 1') AS dashed FROM strokes_v),
    ns AS (SELECT b.job_id, b.ord, count(*) FILTER (WHERE dashed) AS d, count(*) FILTER (WHERE NOT dashed) AS s FROM tb b JOIN tp p ON b.job_id = p.job_id AND abs(b.tx - p.tx) <= 1 AND abs(b.ty - p.ty) <= 1 AND p.x1 <= b.x2 AND p.x2 >= b.x1 AND p.y1 <= b.y2 AND p.y2 >= b.y1 GROUP BY b.job_id, b.ord),
    st AS (SELECT job_id, ord, CASE WHEN d >= greatest(2, s) THEN 'dashed' WHEN s > d THEN 'solid' ELSE 'unknown' END AS style FROM tb LEFT JOIN ns USING (job_id, ord))"""

_FRAMING_SQL = f"""{_LINES_SQL}, {_C_SQL}, {_TAG_SQL.replace("dist <= {}", "dist <= 120").replace("g AS (SELECT job_id, ord AS t_ord", "gt AS (SELECT job_id, ord AS t_ord").replace("JOIN g USING", "JOIN gt USING")}, {_NEAR_SQL}, {_STYLE_SQL},
    fb AS (SELECT c.*, x2 - x1 >= y2 - y1 AS flat, least(x2 - x1, y2 - y1) AS short FROM c WHERE type = 'structural_framing'),
    fl AS (SELECT *, CASE WHEN flat THEN x1 ELSE y1 END AS lo, CASE WHEN flat THEN x2 ELSE y2 END AS hi, CASE WHEN flat THEN cx ELSE cy END AS mid, CASE WHEN flat THEN cy ELSE cx END AS across, CASE WHEN flat THEN y2 - y1 ELSE x2 - x1 END AS wide FROM fb),
    sn AS (SELECT fl.job_id, fl.ord, max(CASE WHEN flat THEN c.cx ELSE c.cy END) FILTER (WHERE CASE WHEN flat THEN c.cx ELSE c.cy END < mid) AS n_lo, min(CASE WHEN flat THEN c.cx ELSE c.cy END) FILTER (WHERE CASE WHEN flat THEN c.cx ELSE c.cy END >= mid) AS n_hi
        FROM fl JOIN c ON c.type = 'column' AND c.job_id = fl.job_id AND abs(CASE WHEN flat THEN c.cy ELSE c.cx END - across) <= CASE WHEN flat THEN c.y2 - c.y1 ELSE c.x2 - c.x1 END * 0.5 + wide GROUP BY fl.job_id, fl.ord),
    fa AS (SELECT fl.*, tag, legend_v.material AS lm, nc.dist AS col_dist, style, coalesce(n_lo, lo) AS nl, coalesce(n_hi, hi) AS nh,
        coalesce(CASE WHEN flat THEN list_min(list_transform(ys, lambda v: abs(v - cy))) <= 30 ELSE list_min(list_transform(xs, lambda v: abs(v - cx))) <= 30 END, FALSE) AS aligned
        FROM fl LEFT JOIN g USING (job_id) LEFT JOIN tg USING (job_id, ord) LEFT JOIN nc USING (job_id, ord) LEFT JOIN st USING (job_id, ord) LEFT JOIN sn USING (job_id, ord) LEFT JOIN legend_v USING (job_id, tag)),
    fs AS (SELECT *, coalesce(lm, CASE WHEN contains(tag, 'RC') THEN 'rc' WHEN starts_with(tag, 'SB') OR starts_with(tag, 'S-') THEN 'steel' END, CASE style WHEN 'dashed' THEN 'steel' WHEN 'solid' THEN 'rc' END) AS material,
        NOT (nh - nl < wide OR (hi > lo AND nh - nl > 3 * (hi - lo))) AND (nl <> lo OR nh <> hi) AS moved, coalesce(col_dist < 1.5 * short, FALSE) AS conflict,
        CASE WHEN lm IS NOT NULL THEN 3 WHEN tag IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN aligned THEN 2 ELSE 0 END + CASE WHEN style <> 'unknown' THEN 1 ELSE 0 END + CASE WHEN col_dist > 0.5 * short THEN 1 ELSE 0 END AS score FROM fa),
    fr AS (SELECT *, CASE WHEN NOT conflict THEN CASE WHEN moved THEN 'snap_to_columns' ELSE 'no_conflict' END WHEN score >= 3 THEN 'join_conflict_resolved' WHEN score = 2 THEN 'join_conflict_borderline_admitted' ELSE 'join_conflict_unsupported' END AS reason FROM fs),
    fx AS (SELECT *, reason IN ('snap_to_columns', 'join_conflict_resolved') AND moved AS fix FROM fr),
    fd AS (SELECT job_id, ord, type, CASE WHEN reason IN ('snap_to_columns', 'join_conflict_resolved') THEN 'admit_with_fix' WHEN reason = 'join_conflict_unsupported' THEN 'reject' ELSE 'admit' END AS action, reason,
        CASE WHEN fix AND flat THEN nl ELSE x1 END AS x1, CASE WHEN fix AND NOT flat THEN nl ELSE y1 END AS y1, CASE WHEN fix AND flat THEN nh ELSE x2 END AS x2, CASE WHEN fix AND NOT flat THEN nh ELSE y2 END AS y2,
        tag, material, aligned, round(col_dist, 6) AS col_dist, score FROM fx)"""
_FRAMING_VIEWS = ("detections", "spans", "grid_lines", "legend", "strokes")


def _framing(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    return view(spark, d, "detections"), _tags(spark, d), view(spark, d, "grid_lines"), view(spark, d, "legend"), view(spark, d, "strokes")


@_query("framing_score", f", {_FRAMING_SQL} SELECT * FROM fd", *_FRAMING_VIEWS)
def framing_score(spark: SparkSession, d: str) -> DataFrame:
    return admit.framing(*_framing(spark, d))


_JUDGE_SQL = f"""{_FRAMING_SQL}, {_OFF_SQL}, jd AS (SELECT job_id, ord, type, action, reason, x1, y1, x2, y2 FROM fd UNION ALL
    SELECT job_id, ord, type, CASE WHEN dx > 80 AND dy > 80 THEN 'reject' ELSE 'admit' END, CASE WHEN dx > 80 AND dy > 80 THEN 'off_grid' ELSE 'on_grid' END, x1, y1, x2, y2 FROM c JOIN o USING (job_id, ord) WHERE type = 'column'
    UNION ALL SELECT job_id, ord, type, 'admit', 'no_rule_for_type', x1, y1, x2, y2 FROM c WHERE type NOT IN ('structural_framing', 'column'))"""


@_query("admit_all", f", {_JUDGE_SQL} SELECT * FROM jd", *_FRAMING_VIEWS)
def admit_all(spark: SparkSession, d: str) -> DataFrame:
    return admit.judge(*_framing(spark, d))


@_query("admit_counts", f", {_JUDGE_SQL} SELECT CASE WHEN reason = 'no_rule_for_type' THEN 'skipped' ELSE action END AS action, count(*) AS n FROM jd GROUP BY 1", *_FRAMING_VIEWS)
def admit_counts(spark: SparkSession, d: str) -> DataFrame:
    return admit.counts(admit.judge(*_framing(spark, d)))


@_query(
    "enforce_rules",
    f""", {_LINES_SQL}, {_C_SQL}, {_OFF_SQL}, i AS (SELECT * FROM {_ALONE_SQL}),
    bv AS (SELECT job_id, string_agg(CASE WHEN spacing_mm < 3000 THEN 'bay_too_narrow_' ELSE 'bay_too_wide_' END || CAST(CAST(round_even(spacing_mm, 0) AS BIGINT) AS VARCHAR) || 'mm', ',' ORDER BY axis, idx) AS v FROM grid_gaps_v WHERE spacing_mm < 3000 OR spacing_mm > 12000 GROUP BY job_id)
    SELECT job_id, ord, coalesce(v, '') AS violations, dx > 80 AND dy > 80 AND i.ord IS NOT NULL AS is_orphan, v IS NULL AS is_compliant FROM o LEFT JOIN i USING (job_id, ord) LEFT JOIN bv USING (job_id)""",
    "detections",
    "grid_lines",
    "grid_gaps",
)
def enforce_rules(spark: SparkSession, d: str) -> DataFrame:
    return boxes.enforce_rules(view(spark, d, "detections"), view(spark, d, "grid_lines"), view(spark, d, "grid_gaps"))


@_query(
    "slab_dup",
    f""", {_LINES_SQL}, r AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM (SELECT job_id, ord, x1, y1, x2 + 10 * (ord % 30) AS x2, y2 + 8 * (ord % 20) - CASE WHEN ord % 9 = 0 THEN 690 ELSE 0 END AS y2 FROM slabs_v)),
    p AS (SELECT a.job_id, a.ord, min(b.ord) AS of_ord FROM r a JOIN r b ON a.job_id = b.job_id AND b.area > a.area WHERE {_IOU_SQL} >= 0.5 GROUP BY a.job_id, a.ord),
    z AS (SELECT job_id, ord, area, of_ord, CASE WHEN area < 90000 THEN 'too_small' WHEN NOT ((x1 + x2) / 2 BETWEEN xs[1] AND xs[-1] AND (y1 + y2) / 2 BETWEEN ys[1] AND ys[-1]) THEN 'outside_grid_envelope' WHEN of_ord IS NOT NULL THEN 'duplicate_of_larger' END AS reason
        FROM r LEFT JOIN p USING (job_id, ord) JOIN g USING (job_id))
    SELECT job_id, ord, area, reason, CASE WHEN reason = 'duplicate_of_larger' THEN of_ord END AS of_ord FROM z""",
    "slabs",
    "grid_lines",
)
def slab_dup(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    rows = view(spark, d, "slabs").withColumns({"x2": F.col("x2") + 10 * (o % 30), "y2": F.col("y2") + 8 * (o % 20) - F.when(o % 9 == 0, 690).otherwise(0)})
    return admit.slab_rule(rows, view(spark, d, "grid_lines"))


def _float_sql(w: str, o: str, name: str, rows: str) -> str:
    """The floating ends ``w`` of ``rows`` by ``_pass_b``: what each meets, and the rows after it."""
    return f"""q{name} AS (SELECT job_id, ord, axis, bx, "by", width, budget, {w}_ax AS qx, {w}_ay AS qy, CASE WHEN loose = '{w}' THEN loose_sign WHEN CASE WHEN axis = 'x' THEN {w}_ax >= {o}_ax ELSE {w}_ay >= {o}_ay END THEN 1.0 ELSE -1.0 END AS sign FROM {rows} WHERE {w}_free),
    d{name} AS (SELECT * FROM q{name} q WHERE EXISTS (SELECT 1 FROM dashes_v d WHERE d.job_id = q.job_id AND d.axis = q.axis AND abs(CASE WHEN q.axis = 'x' THEN qy ELSE qx END - perp) <= 150 AND CASE WHEN q.axis = 'x' THEN qx ELSE qy END BETWEEN lo - width * 0.5 AND hi + width * 0.5)),
    s{name} AS (SELECT job_id, ord, n, bx, "by", qx + CASE WHEN axis = 'x' THEN bx * sign * n ELSE 0 END AS x, qy + CASE WHEN axis = 'x' THEN 0 ELSE "by" * sign * n END AS y FROM (SELECT *, unnest(range(1, budget + 1)) AS n FROM d{name})),
    k{name} AS (SELECT s.job_id, ord, n, 0 AS rank, sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) AS d, col_ord AS k, cx AS kx, cy AS ky, hw, hd FROM s{name} s JOIN columns_v c ON s.job_id = c.job_id AND abs(x - cx) <= bx * 0.25 AND abs(y - cy) <= "by" * 0.25
        UNION ALL SELECT s.job_id, ord, n, 1, 0.0, 0, x, y, 0.0, 0.0 FROM s{name} s JOIN core_walls_v c ON s.job_id = c.job_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1
        UNION ALL SELECT s.job_id, ord, n, 2, sqrt((x - (x0 + x1) / 2) * (x - (x0 + x1) / 2) + (y - (y0 + y1) / 2) * (y - (y0 + y1) / 2)), rect_ord, (x0 + x1) / 2, (y0 + y1) / 2, 0.0, 0.0
        FROM s{name} s JOIN rectangles_v c ON s.job_id = c.job_id AND abs(x - (x0 + x1) / 2) <= bx * 0.25 AND abs(y - (y0 + y1) / 2) <= "by" * 0.25 AND x1 - x0 BETWEEN 200 AND 1500 AND y1 - y0 BETWEEN 200 AND 1500),
    b{name} AS (SELECT job_id, ord, arg_min({{'x': kx, 'y': ky, 'hw': hw, 'hd': hd}}, (n, rank, d, k)) AS b FROM k{name} GROUP BY job_id, ord),
    r{name} AS (SELECT r.* EXCLUDE ({w}_ax, {w}_ay, {w}_cx, {w}_cy, {w}_hw, {w}_hd), coalesce(b.x, {w}_ax) AS {w}_ax, coalesce(b.y, {w}_ay) AS {w}_ay, CASE WHEN {w}_free THEN b.x ELSE {w}_cx END AS {w}_cx, CASE WHEN {w}_free THEN b.y ELSE {w}_cy END AS {w}_cy,
        coalesce(b.hw, {w}_hw) AS {w}_hw, coalesce(b.hd, {w}_hd) AS {w}_hd, CASE WHEN q.ord IS NULL THEN NULL WHEN d.ord IS NULL THEN 'no_dashline' WHEN b IS NULL THEN 'dashline_no_anchor' END AS {w}_tag
        FROM {rows} r LEFT JOIN q{name} q USING (job_id, ord) LEFT JOIN d{name} d USING (job_id, ord) LEFT JOIN b{name} USING (job_id, ord))"""


_SANITIZE_SQL = f"""{_PREFIX_SQL}, gl AS (SELECT job_id, list(start_mm ORDER BY start_mm) FILTER (WHERE axis = 'x') AS gx, list(start_mm ORDER BY start_mm) FILTER (WHERE axis = 'y') AS gy FROM w GROUP BY job_id),
    ba AS (SELECT job_id, avg(spacing_mm) FILTER (WHERE axis = 'x') AS bx, avg(spacing_mm) FILTER (WHERE axis = 'y') AS "by" FROM grid_gaps_v GROUP BY job_id),
    e0 AS (SELECT job_id, ord, CASE WHEN abs(ex - sx) >= abs(ey - sy) THEN 'x' ELSE 'y' END AS axis, coalesce(nullif(width, 0), 800) AS width, unnest([{{'w': 's', 'px': sx, 'py': sy}}, {{'w': 'e', 'px': ex, 'py': ey}}], recursive := true) FROM beams_v),
    e1 AS (SELECT e0.*, bx, "by", px BETWEEN gx[1] - bx AND gx[-1] + bx AND py BETWEEN gy[1] - "by" AND gy[-1] + "by" AS inside,
        CASE WHEN axis = 'x' THEN list_min(list_transform(gy, lambda v, i: (abs(v - py), i, v)))[3] ELSE list_min(list_transform(gx, lambda v, i: (abs(v - px), i, v)))[3] END AS line FROM e0 JOIN gl USING (job_id) JOIN ba USING (job_id)),
    e2 AS (SELECT *, CASE WHEN axis = 'x' THEN abs(py - line) <= "by" * 0.5 ELSE abs(px - line) <= bx * 0.5 END AS on_line FROM e1),
    e3 AS (SELECT *, CASE WHEN on_line AND axis = 'y' THEN line ELSE px END AS ax, CASE WHEN on_line AND axis = 'x' THEN line ELSE py END AS ay FROM e2),
    nr AS (SELECT e.job_id, e.ord, w, arg_min({{'x': cx, 'y': cy, 'hw': hw, 'hd': hd}}, (sqrt((ax - cx) * (ax - cx) + (ay - cy) * (ay - cy)), col_ord)) AS c FROM e3 e JOIN columns_v k ON e.job_id = k.job_id AND on_line
        AND abs(ax - cx) <= CASE WHEN axis = 'x' THEN greatest(bx, "by") * 0.5 ELSE bx * 0.25 END AND abs(ay - cy) <= CASE WHEN axis = 'x' THEN "by" * 0.25 ELSE greatest(bx, "by") * 0.5 END GROUP BY e.job_id, e.ord, w),
    e4 AS (SELECT e.*, c, EXISTS (SELECT 1 FROM core_walls_v v WHERE v.job_id = e.job_id AND px >= x0 AND px < x1 AND py >= y0 AND py < y1) AS still,
        on_line AND EXISTS (SELECT 1 FROM core_walls_v v WHERE v.job_id = e.job_id AND ax >= x0 AND ax < x1 AND ay >= y0 AND ay < y1) AS there FROM e3 e LEFT JOIN nr USING (job_id, ord, w)),
    e5 AS (SELECT *, CASE WHEN still THEN px WHEN there THEN ax ELSE c.x END AS kx, CASE WHEN still THEN py WHEN there THEN ay ELSE c.y END AS ky, CASE WHEN still OR there THEN 0 ELSE c.hw END AS hw, CASE WHEN still OR there THEN 0 ELSE c.hd END AS hd FROM e4),
    r0 AS (SELECT s.job_id, s.ord, s.axis, s.width, s.bx, s."by", s.px AS sx, s.py AS sy, e.px AS ex, e.py AS ey, s.inside AND e.inside AS inside, coalesce(s.kx, s.ax) AS s_ax, coalesce(s.ky, s.ay) AS s_ay, s.kx AS s_cx, s.ky AS s_cy, s.hw AS s_hw, s.hd AS s_hd,
        coalesce(e.kx, e.ax) AS e_ax, coalesce(e.ky, e.ay) AS e_ay, e.kx AS e_cx, e.ky AS e_cy, e.hw AS e_hw, e.hd AS e_hd FROM e5 s JOIN e5 e ON s.job_id = e.job_id AND s.ord = e.ord AND s.w = 's' AND e.w = 'e'),
    r1 AS (SELECT *, CASE WHEN s_cx = e_cx AND s_cy = e_cy AND s_hw > 0 AND e_hw > 0 THEN CASE WHEN sqrt((sx - s_cx) * (sx - s_cx) + (sy - s_cy) * (sy - s_cy)) >= sqrt((ex - s_cx) * (ex - s_cx) + (ey - s_cy) * (ey - s_cy)) THEN 's' ELSE 'e' END END AS loose FROM r0),
    r2 AS (SELECT *, CASE WHEN CASE WHEN axis = 'x' THEN CASE WHEN loose = 's' THEN sx ELSE ex END >= s_cx ELSE CASE WHEN loose = 's' THEN sy ELSE ey END >= s_cy END THEN 1.0 ELSE -1.0 END AS loose_sign,
        s_cx IS NULL OR coalesce(loose = 's', FALSE) AS s_free, e_cx IS NULL OR coalesce(loose = 'e', FALSE) AS e_free FROM r1),
    r3 AS (SELECT *, CASE WHEN s_free AND e_free THEN 2 ELSE 4 END AS budget FROM r2),
    {_float_sql("s", "e", "s", "r3")}, {_float_sql("e", "s", "e", "rs")},
    t0 AS (SELECT *, CASE WHEN NOT inside THEN 'out_of_grid' WHEN s_cx IS NULL THEN coalesce(s_tag, 'no_dashline') WHEN e_cx IS NULL THEN coalesce(e_tag, 'no_dashline') WHEN s_cx = e_cx AND s_cy = e_cy THEN 'same_column' END AS tag,
        list_sort([(round_even(s_cx, 1), round_even(s_cy, 1)), (round_even(e_cx, 1), round_even(e_cy, 1))]) AS span FROM re),
    t1 AS (SELECT * EXCLUDE (tag), coalesce(tag, CASE WHEN row_number() OVER (PARTITION BY job_id, span, tag ORDER BY ord) > 1 THEN 'duplicate_span' END) AS tag, abs(e_ax - s_ax) >= abs(e_ay - s_ay) AS flat FROM t0),
    t2 AS (SELECT *, CASE WHEN CASE WHEN flat THEN e_ax - s_ax ELSE e_ay - s_ay END > 0 THEN 1.0 ELSE -1.0 END AS way FROM t1),
    t3 AS (SELECT *, CASE WHEN flat THEN s_ax + way * s_hw ELSE s_ax END AS tsx, CASE WHEN flat THEN e_ax - way * e_hw ELSE e_ax END AS tex, CASE WHEN flat THEN s_ay ELSE s_ay + way * s_hd END AS tsy, CASE WHEN flat THEN e_ay ELSE e_ay - way * e_hd END AS tey FROM t2),
    t4 AS (SELECT * EXCLUDE (tag), coalesce(tag, CASE WHEN least(abs(e_ax - s_ax), abs(e_ay - s_ay)) > 50 THEN 'diagonal' WHEN sqrt((tex - tsx) * (tex - tsx) + (tey - tsy) * (tey - tsy)) < 500 THEN 'too_short' END) AS tag FROM t3)"""
_SANITIZE_VIEWS = ("beams", "columns", "dashes", "grid_gaps", "core_walls", "rectangles")


def _sanitized(spark: SparkSession, d: str) -> DataFrame:
    walls = annotate.box_points(view(spark, d, "core_walls").selectExpr("job_id", "x0 AS x1", "y0 AS y1", "x1 AS x2", "y1 AS y2"))
    return sanitize.sanitize(view(spark, d, "beams"), view(spark, d, "columns"), view(spark, d, "dashes"), view(spark, d, "grid_gaps"), core_walls=walls, rectangles=view(spark, d, "rectangles"))


@_query("sanitize_kept", f", {_SANITIZE_SQL} SELECT job_id, ord, round(tsx, 6) AS sx, round(tsy, 6) AS sy, round(tex, 6) AS ex, round(tey, 6) AS ey FROM t4 WHERE tag IS NULL", *_SANITIZE_VIEWS)
def sanitize_kept(spark: SparkSession, d: str) -> DataFrame:
    return _r(_sanitized(spark, d).where("tag is null").drop("tag"), "sx", "sy", "ex", "ey")


@_query("sanitize_rejects", f", {_SANITIZE_SQL} SELECT tag, count(*) AS n FROM t4 WHERE tag IS NOT NULL GROUP BY tag", *_SANITIZE_VIEWS)
def sanitize_rejects(spark: SparkSession, d: str) -> DataFrame:
    return sanitize.reject_counts(_sanitized(spark, d))


_WARN_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in WARNINGS) + " ELSE 'unresolved' END"


@_query("warning_dispatch", f"SELECT job_id, ord, {_WARN_SQL} AS handler FROM warnings_v", "warnings")
def warning_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return alerts.dispatch(view(spark, d, "warnings")).select("job_id", "ord", "handler")


@_query(
    "worst_beam",
    f""", k AS (SELECT job_id, count(*) AS k FROM warnings_v WHERE {_WARN_SQL} = 'join_error' GROUP BY job_id), e AS (SELECT job_id, ord, sx AS px, sy AS py FROM beams_v UNION ALL SELECT job_id, ord, ex, ey FROM beams_v),
    w AS (SELECT e.job_id, e.ord, max(least(hw - abs(px - cx), hd - abs(py - cy))) AS depth_mm FROM e JOIN columns_v c ON e.job_id = c.job_id AND abs(px - cx) < hw AND abs(py - cy) < hd GROUP BY e.job_id, e.ord)
    SELECT job_id, ord, depth_mm FROM w JOIN k USING (job_id) QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY depth_mm DESC, ord) <= max(k) OVER (PARTITION BY job_id)""",
    "warnings",
    "beams",
    "columns",
)
def worst_beam(spark: SparkSession, d: str) -> DataFrame:
    return alerts.worst_beams(view(spark, d, "beams"), view(spark, d, "columns"), view(spark, d, "warnings"))


def _families(spark: SparkSession, d: str) -> DataFrame:
    kind = F.array(F.struct("type_name", "width_mm", "depth_mm"))
    return view(spark, d, "families").withColumns({"tags": F.split("family_name", " "), "types": kind})


@_query("library_search", "SELECT ord, family_name, category FROM families_v WHERE lower(category) = 'economy' AND (contains(lower(family_name), 'red') OR contains(lower(type_name), 'red') OR len(list_filter(string_split(family_name, ' '), lambda t: contains(t, 'red'))) > 0)", "families")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    return library.search(_families(spark, d), "Economy", "red").select("ord", "family_name", "category")


@_query(
    "library_rank",
    r""", h AS (SELECT *, 4.0 * CAST(lower(category) = 'economy' AS INT) + CASE WHEN regexp_matches(lower(family_name), '\bring\b') THEN 3.0 WHEN contains(lower(family_name), 'ring') THEN 1.5 ELSE 0.0 END
    + CASE WHEN contains(lower(family_name), 'ring') THEN 1.0 ELSE 0.0 END - CASE WHEN has_path THEN 0.0 ELSE 1.0 END AS score FROM families_v WHERE lower(category) = 'economy' AND contains(lower(family_name), 'ring'))
    SELECT ord, family_name, score FROM h ORDER BY score DESC, ord LIMIT 15""",
    "families",
)
def library_rank(spark: SparkSession, d: str) -> DataFrame:
    return library.ranked(_families(spark, d), "economy", "ring").select("ord", "family_name", "score")


@_query(
    "library_rank_size",
    """, h AS (SELECT *, greatest(0.0, 2.0 - (abs(greatest(300.0, 200.0) - greatest(width_mm, depth_mm)) + abs(least(300.0, 200.0) - least(width_mm, depth_mm))) / 500.0) - CASE WHEN has_path THEN 0.0 ELSE 1.0 END AS score FROM families_v)
    SELECT ord, round(score, 6) AS score FROM h""",
    "families",
)
def library_rank_size(spark: SparkSession, d: str) -> DataFrame:
    return _r(_families(spark, d).select("ord", library.score(None, "200x300").alias("score")), "score")


@_query(
    "pre_clash",
    """SELECT job_id, ord, 'column' AS kind, 'side under 200 mm' AS reason FROM detections_v WHERE type = 'column' AND (4 * (x2 - x1) < 200 OR 4 * (y2 - y1) < 200)
    UNION ALL SELECT job_id, ord, 'wall', 'shorter than 100 mm' FROM beams_v WHERE sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) / 80 > 0 AND sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) / 80 < 100
    UNION ALL SELECT job_id, ord, 'door', 'too wide' FROM detections_v WHERE type = 'slab' AND 40 * (x2 - x1) > 2000""",
    "detections",
    "beams",
)
def pre_clash(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections")
    sized = lambda k: rows.select("job_id", "ord", "type", (k * (F.col("x2") - F.col("x1"))).alias("width_mm"), (k * (F.col("y2") - F.col("y1"))).alias("depth_mm"))
    walls = view(spark, d, "beams").withColumns({c: F.col(c) / 80 for c in ("sx", "sy", "ex", "ey")})
    return alerts.pre_clash(sized(4).where("type = 'column'"), walls, sized(40).where("type = 'slab'").withColumn("kind", F.lit("door")))


@_query("low_conf", "SELECT job_id, ord, type, confidence FROM detections_v WHERE confidence < 0.6", "detections")
def low_conf(spark: SparkSession, d: str) -> DataFrame:
    return alerts.low_confidence(view(spark, d, "detections")).select("job_id", "ord", "type", "confidence")


@_query("mesh_params", "SELECT job_id, ord, round(sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)), 6) AS span, round(atan2(ey - sy, ex - sx), 6) AS angle, (sx + ex) / 2 AS cx, (sy + ey) / 2 AS cy FROM beams_v WHERE sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) >= 1", "beams")
def mesh_params(spark: SparkSession, d: str) -> DataFrame:
    return _r(recipe.mesh_params(view(spark, d, "beams")), "span", "angle")


@_query(
    "beam_params",
    """SELECT job_id, ord, CASE WHEN x2 - x1 >= y2 - y1 THEN x1 ELSE (x1 + x2) / 2 END AS sx, CASE WHEN x2 - x1 >= y2 - y1 THEN (y1 + y2) / 2 ELSE y1 END AS sy, CASE WHEN x2 - x1 >= y2 - y1 THEN x2 ELSE (x1 + x2) / 2 END AS ex,
    CASE WHEN x2 - x1 >= y2 - y1 THEN (y1 + y2) / 2 ELSE y2 END AS ey, 800.0::DOUBLE AS width, 800.0::DOUBLE AS depth, 'RCBeam800x800mm' AS family_type, 'rc' AS material FROM detections_v WHERE type = 'structural_framing' AND greatest(x2 - x1, y2 - y1) >= 10""",
    "detections",
)
def beam_params(spark: SparkSession, d: str) -> DataFrame:
    return recipe.beam_params(view(spark, d, "detections").where("type = 'structural_framing'"))


def _world_sql(points: str) -> str:
    """The CTEs of ``_WORLD_SQL`` for other points (job_id, ord, cx, cy)."""
    return _WORLD_SQL.replace(_C_SQL, f"c AS ({points})")


_SIZED_SQL = """SELECT job_id, ord, ord % 4 = 0 AS is_circular, CASE WHEN ord % 8 = 0 THEN CAST(300 + 50 * (ord % 27) AS DOUBLE) END AS diameter_mm, CASE WHEN ord % 4 IN (1, 2) THEN CAST(500 + 25 * (ord % 40) AS DOUBLE) END AS width_mm,
    CASE WHEN ord % 4 = 1 THEN CAST(600 + 25 * (ord * 7 % 40) AS DOUBLE) END AS depth_mm"""


@_query(
    "recipe_columns",
    f""", {_SNAP_SQL}, r AS ({_SIZED_SQL}, type FROM detections_v WHERE type = 'column'),
    q AS (SELECT *, is_circular AND diameter_mm IS NOT NULL AS ci, width_mm IS NOT NULL AND depth_mm IS NOT NULL AND NOT (is_circular AND diameter_mm IS NOT NULL) AS re FROM r),
    v AS (SELECT *, greatest(CASE WHEN ci THEN diameter_mm WHEN re THEN width_mm ELSE 800 END, 800) AS rw, greatest(CASE WHEN ci THEN diameter_mm WHEN re THEN depth_mm ELSE 800 END, 800) AS rd FROM q),
    y AS (SELECT *, CASE WHEN is_circular THEN {_near_sql("greatest(rw, rd)", ROUND_SIZES)} WHEN NOT re OR abs(rw - rd) <= 100 THEN {_near_sql("(rw + rd) / 2", SQUARE_SIZES)} END AS one FROM v),
    x AS (SELECT *, coalesce(one, round_even(rw / 50, 0) * 50) AS width, coalesce(one, round_even(rd / 50, 0) * 50) AS depth FROM y)
    SELECT job_id, ord, snap_x AS wx, snap_y AS wy, width, depth, CASE WHEN is_circular THEN 'circular' ELSE 'rectangular' END AS shape, CASE WHEN is_circular THEN '{ROUND_FAMILY}' ELSE '{SQUARE_FAMILY}' END AS family_name,
    CASE WHEN is_circular THEN 'Φ' || CAST(CAST(width AS BIGINT) AS VARCHAR) ELSE CAST(CAST(greatest(width, depth) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(least(width, depth) AS BIGINT) AS VARCHAR) || 'mm' END AS symbol,
    CASE WHEN is_circular AND NOT re THEN 'CIRC' || CAST(CAST(width AS BIGINT) AS VARCHAR) ELSE 'RECT' || CAST(CAST(least(width, depth) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(greatest(width, depth) AS BIGINT) AS VARCHAR) || 'mm' END AS family
    FROM x JOIN sp USING (job_id, ord)""",
    "detections",
    "grid_lines",
    "grid_gaps",
)
def recipe_columns(spark: SparkSession, d: str) -> DataFrame:
    points = boxes.centred(view(spark, d, "detections").where("type = 'column'"))
    at = grid.snap(points, view(spark, d, "grid_lines"), view(spark, d, "grid_gaps"))
    o = F.col("ord")
    given = lambda when, value: F.when(when, value.cast("double"))
    sized = at.select("job_id", "ord", F.col("snap_x").alias("wx"), F.col("snap_y").alias("wy"), (o % 4 == 0).alias("is_circular"), given(o % 8 == 0, 300 + 50 * (o % 27)).alias("diameter_mm"), given((o % 4).isin(1, 2), 500 + 25 * (o % 40)).alias("width_mm"), given(o % 4 == 1, 600 + 25 * (o * 7 % 40)).alias("depth_mm"))
    return _r(recipe.column_params(sized), "wx", "wy")


_MM_BOXES_SQL = """mb AS (SELECT a.job_id, a.ord // 2 AS ord, a.wx AS x1, a.wy AS y1, b.wx AS x2, b.wy AS y2 FROM k a JOIN k b ON a.job_id = b.job_id AND a.ord % 2 = 0 AND b.ord = a.ord + 1)"""
_SLABS_SQL = f"""{_ZONE_SQL}, sh AS (SELECT s.job_id, s.ord, arg_min(t, zone_ord) AS t FROM slabs_v s JOIN z ON s.job_id = z.job_id AND t IS NOT NULL AND zx >= x1 AND zx < x2 AND zy >= y1 AND zy < y2 GROUP BY s.job_id, s.ord),
    sl AS (SELECT s.*, coalesce(t, 200) AS thickness_mm FROM slabs_v s LEFT JOIN sh USING (job_id, ord))"""


@_query(
    "recipe_beams",
    ", " + _world_sql("SELECT job_id, 2 * ord AS ord, x1 AS cx, y1 AS cy FROM detections_v WHERE type = 'structural_framing' UNION ALL SELECT job_id, 2 * ord + 1, x2, y2 FROM detections_v WHERE type = 'structural_framing'")
    + f""", {_MM_BOXES_SQL}, {_SLABS_SQL}, be AS (SELECT job_id, ord, abs(x2 - x1) >= abs(y2 - y1) AS flat, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my,
        CASE WHEN ord % 5 = 0 THEN 300.0 ELSE 800.0 END AS width, CASE WHEN ord % 5 = 0 THEN 600.0 ELSE 800.0 END AS depth, CASE WHEN ord % 4 = 0 THEN 'steel' ELSE 'rc' END AS material FROM mb WHERE ord % 13 <> 0),
    bs AS (SELECT be.job_id, be.ord, arg_min(thickness_mm, sl.ord) AS t FROM be JOIN sl ON be.job_id = sl.job_id AND mx >= sl.x1 AND mx < sl.x2 AND my >= sl.y1 AND my < sl.y2 GROUP BY be.job_id, be.ord)
    SELECT job_id, ord, round(CASE WHEN flat THEN x1 ELSE mx END, 6) AS sx, round(CASE WHEN flat THEN my ELSE y1 END, 6) AS sy, round(CASE WHEN flat THEN x2 ELSE mx END, 6) AS ex, round(CASE WHEN flat THEN my ELSE y2 END, 6) AS ey, CAST(width AS DOUBLE) AS width, CAST(depth AS DOUBLE) AS depth,
    CASE material WHEN 'steel' THEN 'SteelBeam' ELSE 'RCBeam' END || CAST(CAST(greatest(width, depth) AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(least(width, depth) AS BIGINT) AS VARCHAR) || 'mm' AS family_type, material, coalesce(t, 200) AS slab_thickness
    FROM be LEFT JOIN bs USING (job_id, ord) WHERE CASE WHEN flat THEN x2 - x1 ELSE y2 - y1 END >= 10""",
    "detections",
    "grid_lines",
    "grid_gaps",
    "slabs",
    "zones",
    "words",
)
def recipe_beams(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    beams = grid.world_boxes(view(spark, d, "detections").where("type = 'structural_framing'"), view(spark, d, "grid_lines"), view(spark, d, "grid_gaps"))
    beams = beams.select("job_id", "ord", *[F.col(f"w{c}").alias(c) for c in boxes.BOX], F.when(o % 13 == 0, "reject").alias("action"), F.when(o % 5 == 0, 300.0).alias("section_width_mm"), F.when(o % 5 == 0, 600.0).alias("section_depth_mm"), F.when(o % 4 == 0, "steel").alias("material"))
    slabs = recipe.slab_params(view(spark, d, "slabs"), view(spark, d, "zones"), _legend(spark, d))
    return _r(recipe.beam_slabs(recipe.beam_params(beams), slabs), "sx", "sy", "ex", "ey")


@_query(
    "recipe_slabs",
    f", {_SLABS_SQL} SELECT job_id, ord, x1 AS first_x, y1 AS first_y, x2 AS third_x, y2 AS third_y, thickness_mm FROM sl",
    "slabs",
    "zones",
    "words",
)
def recipe_slabs(spark: SparkSession, d: str) -> DataFrame:
    rows = recipe.slab_params(view(spark, d, "slabs"), view(spark, d, "zones"), _legend(spark, d))
    p = F.col("points")
    return rows.select("job_id", "ord", p[0]["x"].alias("first_x"), p[0]["y"].alias("first_y"), p[2]["x"].alias("third_x"), p[2]["y"].alias("third_y"), "thickness_mm")


@_query(
    "recipe_grids",
    f""", {_PREFIX_SQL}, tt AS (SELECT job_id, sum(spacing_mm) FILTER (WHERE axis = 'x') AS tx, sum(spacing_mm) FILTER (WHERE axis = 'y') AS ty FROM grid_gaps_v GROUP BY job_id)
    SELECT job_id, axis, idx, CASE axis WHEN 'x' THEN CAST(idx + 1 AS VARCHAR) ELSE chr(CAST(65 + idx AS INT)) END AS name, CASE axis WHEN 'x' THEN start_mm ELSE -10000 END AS sx, CASE axis WHEN 'x' THEN -10000 ELSE ty - start_mm END AS sy,
    CASE axis WHEN 'x' THEN start_mm ELSE tx END AS ex, CASE axis WHEN 'x' THEN ty + 10000 ELSE ty - start_mm END AS ey FROM grid_lines_v JOIN w USING (job_id, axis, idx) JOIN tt USING (job_id)""",
    "grid_lines",
    "grid_gaps",
)
def recipe_grids(spark: SparkSession, d: str) -> DataFrame:
    return recipe.grid_commands(view(spark, d, "grid_lines"), view(spark, d, "grid_gaps"))


_SCALE_SQL = "sc AS (SELECT job_id, avg(r) AS px_per_mm FROM (SELECT job_id, avg((npx - px) / spacing_mm) AS r FROM (SELECT *, lead(px) OVER (PARTITION BY job_id, axis ORDER BY idx) AS npx FROM grid_lines_v) JOIN grid_gaps_v USING (job_id, axis, idx) GROUP BY job_id, axis) GROUP BY job_id)"


def _scale(spark: SparkSession, d: str) -> DataFrame:
    lines = view(spark, d, "grid_lines").join(view(spark, d, "grid_gaps"), ["job_id", "axis", "idx"], "left")
    return detect.px_per_mm(lines).groupBy("job_id").agg(F.avg("px_per_mm").alias("px_per_mm"))


@_query(
    "recipe_walls",
    f", {_SCALE_SQL} SELECT job_id, ord, round(round_even(CASE WHEN ord % 6 = 0 THEN 200 ELSE least(x2 - x1, y2 - y1) / px_per_mm END, 1), 6) AS thickness_mm, CASE WHEN ord % 4 = 0 THEN 3300.0 ELSE 2800.0 END AS height FROM detections_v JOIN sc USING (job_id) WHERE type = 'slab'",
    "detections",
    "grid_lines",
    "grid_gaps",
)
def recipe_walls(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("ord")
    walls = view(spark, d, "detections").where("type = 'slab'").select("job_id", "ord", F.when(o % 6 != 0, F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).alias("thickness"), F.when(o % 4 == 0, 3300.0).alias("height"))
    return recipe.wall_params(walls, _scale(spark, d)).select("job_id", "ord", F.round("thickness_mm", 6).alias("thickness_mm"), "height")


@_query(
    "recipe_openings",
    ", " + _world_sql("SELECT job_id, ord, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM detections_v WHERE type = 'slab'")
    + f""", {_SCALE_SQL} SELECT job_id, ord, CASE WHEN ord % 2 = 0 THEN 'door' ELSE 'window' END AS kind, round(wx, 6) AS wx, round(wy, 6) AS wy, CASE WHEN ord % 2 = 0 THEN 0.0 ELSE 900.0 END AS z,
    round_even(greatest((x2 - x1) / px_per_mm, 200), 1) AS width, round_even(greatest((y2 - y1) / px_per_mm, 400), 1) AS height FROM detections_v JOIN k USING (job_id, ord) JOIN sc USING (job_id)""",
    "detections",
    "grid_lines",
    "grid_gaps",
)
def recipe_openings(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes.centred(view(spark, d, "detections").where("type = 'slab'"))
    rows = grid.to_world(rows, view(spark, d, "grid_lines"), view(spark, d, "grid_gaps")).withColumn("kind", F.when(F.col("ord") % 2 == 0, "door").otherwise("window"))
    return _r(recipe.opening_params(rows, _scale(spark, d)), "wx", "wy")


@_query(
    "stroke_style",
    """, b AS (SELECT *, floor((x1 + x2) / 2 / 256) AS tx, floor((y1 + y2) / 2 / 256) AS ty FROM detections_v), p AS (SELECT *, floor((x1 + x2) / 2 / 256) AS tx, floor((y1 + y2) / 2 / 256) AS ty, dashes IN ('[3 2] 0', '[5] 1') AS dashed FROM strokes_v),
    n AS (SELECT b.job_id, b.ord, count(*) FILTER (WHERE dashed) AS d, count(*) FILTER (WHERE NOT dashed) AS s FROM b JOIN p ON b.job_id = p.job_id AND abs(b.tx - p.tx) <= 1 AND abs(b.ty - p.ty) <= 1 AND p.x1 <= b.x2 AND p.x2 >= b.x1 AND p.y1 <= b.y2 AND p.y2 >= b.y1 GROUP BY b.job_id, b.ord)
    SELECT job_id, ord, CASE WHEN d >= greatest(2, s) THEN 'dashed' WHEN s > d THEN 'solid' ELSE 'unknown' END AS style FROM b LEFT JOIN n USING (job_id, ord)""",
    "detections",
    "strokes",
)
def stroke_style(spark: SparkSession, d: str) -> DataFrame:
    return strokes.stroke_style(view(spark, d, "detections"), view(spark, d, "strokes"))


@_query(
    "straight_runs",
    """, r AS (SELECT *, last_value(CASE WHEN op <> 'l' THEN op END IGNORE NULLS) OVER w AS other, lag(x) OVER w AS px, lag(y) OVER w AS py FROM items_v WINDOW w AS (PARTITION BY job_id, path_ord ORDER BY item_ord)),
    k AS (SELECT *, CASE WHEN abs(y - py) < 5 AND abs(x - px) > 20 THEN 'h' WHEN abs(x - px) < 5 AND abs(y - py) > 20 THEN 'v' END AS dir FROM r WHERE op = 'l' AND other = 'm')
    SELECT job_id, path_ord, item_ord, dir, CASE WHEN dir = 'h' THEN least(x, px) ELSE least(y, py) END AS lo, CASE WHEN dir = 'h' THEN greatest(x, px) ELSE greatest(y, py) END AS hi, CASE WHEN dir = 'h' THEN (y + py) / 2 ELSE (x + px) / 2 END AS perp FROM k WHERE dir IS NOT NULL""",
    "items",
)
def straight_runs(spark: SparkSession, d: str) -> DataFrame:
    return strokes.runs(view(spark, d, "items"))


@_query(
    "text_lines",
    """, r AS (SELECT job_id, ord, sx, sy, CASE WHEN abs(sy - lag(sy) OVER w) < 6 THEN 0 ELSE 1 END AS b FROM spans_v WINDOW w AS (PARTITION BY job_id ORDER BY sy, sx, ord))
    SELECT job_id, ord, CAST(sum(b) OVER (PARTITION BY job_id ORDER BY sy, sx, ord) - 1 AS BIGINT) AS line FROM r""",
    "spans",
)
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    spans = view(spark, d, "spans").withColumns({"x0": F.col("sx"), "y0": F.col("sy"), "y1": F.col("sy") + 10})
    return strokes.text_lines(spans).select("job_id", "ord", F.col("line").cast("long").alias("line"))


def _med(v: str, keys: str, source: str) -> str:
    return f"SELECT {keys}, list_sort(list({v}))[CAST(floor(count(*) / 2) AS INT) + 1] AS m FROM {source} GROUP BY {keys}"


_DETECT_SQL = f"""tx AS (SELECT job_id, ord, trim(text) AS text, 2.0 * CASE rotation WHEN 90 THEN w_pt - (y0 + y1) / 2 WHEN 180 THEN w_pt - (x0 + x1) / 2 WHEN 270 THEN (y0 + y1) / 2 ELSE (x0 + x1) / 2 END AS ix,
        2.0 * CASE rotation WHEN 90 THEN (x0 + x1) / 2 WHEN 180 THEN h_pt - (y0 + y1) / 2 WHEN 270 THEN h_pt - (x0 + x1) / 2 ELSE (y0 + y1) / 2 END AS iy FROM page_texts_v JOIN pages_v USING (job_id)),
    lt AS (SELECT *, ix < 1700 AS lf FROM tx WHERE regexp_full_match(text, '[A-Za-z]{{1,2}}') AND ix > 0 AND ix < 3400 AND iy > 0 AND iy < 2400),
    lm AS ({_med("ix", "job_id, lf", "lt")}), lk AS (SELECT lt.* FROM lt JOIN lm USING (job_id, lf) WHERE abs(ix - m) <= 80), ls AS ({_med("ix", "job_id, lf", "lk")}),
    b0 AS (SELECT job_id, coalesce(CAST(trunc((SELECT m FROM ls WHERE ls.job_id = p.job_id AND lf)) AS BIGINT), 272) AS bx0, coalesce(CAST(trunc((SELECT m FROM ls WHERE ls.job_id = p.job_id AND NOT lf)) AS BIGINT), 2992) AS bx1,
        coalesce(CAST(trunc((SELECT min(iy) FROM lk WHERE lk.job_id = p.job_id)) AS BIGINT), 360) AS by0, coalesce(CAST(trunc((SELECT max(iy) FROM lk WHERE lk.job_id = p.job_id)) AS BIGINT), 2208) AS by1 FROM pages_v p),
    nu AS (SELECT tx.*, iy < 1200 AS up FROM tx JOIN b0 USING (job_id) WHERE regexp_full_match(text, '[0-9]{{1,2}}') AND CAST(text AS INT) > 0 AND ix > bx0 - 200 AND ix < bx1 + 200),
    um AS ({_med("iy", "job_id, up", "nu")}), uk AS (SELECT nu.* FROM nu JOIN um USING (job_id, up) WHERE abs(iy - m) <= 50), us AS ({_med("iy", "job_id, up", "uk")}),
    mg AS (SELECT *, coalesce(CAST(trunc((SELECT m FROM us WHERE us.job_id = b0.job_id AND up)) AS BIGINT), by0 - 50) AS top, coalesce(CAST(trunc((SELECT m FROM us WHERE us.job_id = b0.job_id AND NOT up)) AS BIGINT), by1 + 50) AS bottom FROM b0),
    fo AS (SELECT tx.job_id, 'x' AS axis, text, ix AS v, ord FROM tx JOIN mg USING (job_id) WHERE regexp_full_match(text, '[0-9]{{1,2}}') AND CAST(text AS INT) > 0 AND ix BETWEEN bx0 AND bx1 AND (abs(iy - top) <= 50 OR abs(iy - bottom) <= 50)
        UNION ALL SELECT tx.job_id, 'y', text, iy, ord FROM tx JOIN mg USING (job_id) WHERE regexp_full_match(text, '[A-Za-z]{{1,2}}') AND iy BETWEEN top AND bottom AND (abs(ix - bx0) <= 80 OR abs(ix - bx1) <= 80)),
    l0 AS (SELECT job_id, axis, text AS label, min(ord) AS f, list_sort(list(v))[CAST(floor(count(*) / 2) AS INT) + 1] AS px FROM fo GROUP BY job_id, axis, text),
    l1 AS (SELECT *, coalesce(px < lag(px) OVER (PARTITION BY job_id, axis ORDER BY try_cast(label AS INT), px, f), FALSE) AS dn FROM l0),
    l2 AS (SELECT *, NOT bool_or(dn) OVER (PARTITION BY job_id, axis) AND axis = 'x' AS num FROM l1),
    l3 AS (SELECT job_id, axis, CAST(row_number() OVER (PARTITION BY job_id, axis ORDER BY px, CASE WHEN num THEN CAST(label AS INT) END, f) - 1 AS BIGINT) AS idx, px, label FROM l2),
    ok AS (SELECT job_id FROM l3 GROUP BY job_id HAVING count(*) FILTER (WHERE axis = 'x') >= 2 AND count(*) FILTER (WHERE axis = 'y') >= 2), li AS (SELECT * FROM l3 WHERE job_id IN (SELECT job_id FROM ok)),
    t AS (SELECT job_id, ord, CAST(text AS DOUBLE) AS mm, unnest([{{'axis': 'x', 'pos': ix}}, {{'axis': 'y', 'pos': iy}}], recursive := true) FROM tx WHERE regexp_full_match(text, '[0-9]{{3,5}}') AND CAST(text AS INT) BETWEEN 300 AND 30000),
    n AS (SELECT job_id, axis, idx AS gap, px AS lo, lead(px) OVER (PARTITION BY job_id, axis ORDER BY idx) AS hi, hi - lo AS width FROM li QUALIFY hi IS NOT NULL),
    {_GIVEN_SQL}, {_INFER_SQL},
    dt AS (SELECT li.*, CASE WHEN n.gap IS NOT NULL THEN coalesce(z.mm, 8400) END AS spacing_mm, CASE WHEN n.gap IS NOT NULL THEN coalesce(z.source, 'fallback') END AS source FROM li LEFT JOIN n ON n.job_id = li.job_id AND n.axis = li.axis AND n.gap = li.idx LEFT JOIN z ON z.job_id = li.job_id AND z.axis = li.axis AND z.gap = li.idx
        UNION ALL SELECT job_id, 'x', i, round_even(3400 * i / 41, 0), CAST(i + 1 AS VARCHAR), CASE WHEN i < 41 THEN 6000 END, CASE WHEN i < 41 THEN 'default' END FROM pages_v, range(42) r(i) WHERE job_id NOT IN (SELECT job_id FROM ok)
        UNION ALL SELECT job_id, 'y', i, round_even(2400 * i / 29, 0), CASE WHEN i < 26 THEN chr(CAST(65 + i AS INT)) ELSE repeat(chr(CAST(39 + i AS INT)), 2) END, CASE WHEN i < 29 THEN 6000 END, CASE WHEN i < 29 THEN 'default' END FROM pages_v, range(30) r(i) WHERE job_id NOT IN (SELECT job_id FROM ok))"""


@_query("grid_detect", f", {_DETECT_SQL} SELECT job_id, axis, idx, round(px, 6) AS px, label, spacing_mm, source FROM dt", "page_texts", "pages")
def grid_detect(spark: SparkSession, d: str) -> DataFrame:
    return _r(detect.detect(view(spark, d, "page_texts"), view(spark, d, "pages")), "px")


@_query("grid_px_per_mm", f", {_DETECT_SQL}, g AS (SELECT *, lead(px) OVER (PARTITION BY job_id, axis ORDER BY idx) AS nx FROM dt) SELECT job_id, axis, round(avg(abs(nx - px) / spacing_mm), 9) AS px_per_mm FROM g GROUP BY job_id, axis", "page_texts", "pages")
def grid_px_per_mm(spark: SparkSession, d: str) -> DataFrame:
    return detect.px_per_mm(detect.detect(view(spark, d, "page_texts"), view(spark, d, "pages"))).withColumn("px_per_mm", F.round("px_per_mm", 9))


_MM_SQL = f"""{_PREFIX_SQL}, fr AS (SELECT job_id, list(px ORDER BY idx) FILTER (WHERE axis = 'x') AS xp, list(start_mm ORDER BY idx) FILTER (WHERE axis = 'x') AS xm, list(px ORDER BY idx) FILTER (WHERE axis = 'y') AS yp, list(start_mm ORDER BY idx) FILTER (WHERE axis = 'y') AS ym
        FROM grid_lines_v JOIN w USING (job_id, axis, idx) GROUP BY job_id)"""


def _mm_sql(source: str) -> str:
    """CTEs that bring both points of ``source`` from the sheet to millimetres: mx1, my1, mx2, my2."""
    at = lambda p, m, v: f"{m}[{v}i] + ({m}[{v}i + 1] - {m}[{v}i]) * ({v} - {p}[{v}i]) / ({p}[{v}i + 1] - {p}[{v}i])"
    cell = lambda p, v: f"len(list_filter({p}[2:len({p}) - 1], lambda v: v <= {v})) + 1 AS {v}i"
    turned = lambda n: f"2.0 * CASE rotation WHEN 90 THEN w_pt - y{n} WHEN 180 THEN w_pt - x{n} WHEN 270 THEN y{n} ELSE x{n} END AS u{n}, 2.0 * CASE rotation WHEN 90 THEN x{n} WHEN 180 THEN h_pt - y{n} WHEN 270 THEN h_pt - x{n} ELSE y{n} END AS v{n}"
    return f"""{_MM_SQL}, m0 AS (SELECT s.*, xp, xm, yp, ym, {turned(1)}, {turned(2)} FROM {source} s JOIN pages_v USING (job_id) JOIN fr USING (job_id)),
    m1 AS (SELECT *, {cell("xp", "u1")}, {cell("xp", "u2")}, {cell("yp", "v1")}, {cell("yp", "v2")} FROM m0),
    m2 AS (SELECT * EXCLUDE (xp, xm, yp, ym), {at("xp", "xm", "u1")} AS mx1, {at("xp", "xm", "u2")} AS mx2, ym[-1] - ({at("yp", "ym", "v1")}) AS my1, ym[-1] - ({at("yp", "ym", "v2")}) AS my2 FROM m1)"""


@_query(
    "dashed_segments",
    f""", {_mm_sql("(SELECT * FROM segments_v WHERE dashes <> '[] 0')")}, m3 AS (SELECT *, (mx2 - mx1) * (mx2 - mx1) AS a, (my2 - my1) * (my2 - my1) AS b FROM m2), m4 AS (SELECT *, CASE WHEN a >= 0.81 * (a + b) THEN 'x' WHEN b >= 0.81 * (a + b) THEN 'y' END AS axis FROM m3 WHERE a + b >= 1)
    SELECT job_id, ord, axis, round(CASE axis WHEN 'x' THEN least(mx1, mx2) ELSE least(my1, my2) END, 6) AS lo, round(CASE axis WHEN 'x' THEN greatest(mx1, mx2) ELSE greatest(my1, my2) END, 6) AS hi, round(CASE axis WHEN 'x' THEN (my1 + my2) / 2 ELSE (mx1 + mx2) / 2 END, 6) AS perp FROM m4 WHERE axis IS NOT NULL""",
    "segments",
    "pages",
    "grid_lines",
    "grid_gaps",
)
def dashed_segments(spark: SparkSession, d: str) -> DataFrame:
    return _r(strokes.dashed_segments(view(spark, d, "segments"), view(spark, d, "pages"), view(spark, d, "grid_lines"), view(spark, d, "grid_gaps")), "lo", "hi", "perp")


@_query(
    "column_rectangles",
    f""", {_mm_sql("(SELECT * FROM rects_v WHERE x2 > x1 AND y2 > y1)")} SELECT job_id, ord AS rect_ord, round(least(mx1, mx2), 6) AS x0, round(least(my1, my2), 6) AS y0, round(greatest(mx1, mx2), 6) AS x1, round(greatest(my1, my2), 6) AS y1 FROM m2
    WHERE abs(mx2 - mx1) BETWEEN 200 AND 1500 AND abs(my2 - my1) BETWEEN 200 AND 1500""",
    "rects",
    "pages",
    "grid_lines",
    "grid_gaps",
)
def column_rectangles(spark: SparkSession, d: str) -> DataFrame:
    return _r(strokes.column_rectangles(view(spark, d, "rects"), view(spark, d, "pages"), view(spark, d, "grid_lines"), view(spark, d, "grid_gaps")), "x0", "y0", "x1", "y1")


@_query("notes_legend", f", {_LEGEND_SQL} SELECT * FROM lg", "words")
def notes_legend(spark: SparkSession, d: str) -> DataFrame:
    return _legend(spark, d)


@_query(
    "zone_labels",
    f""", {_NOTES_SQL}, br AS (SELECT job_id, block, min(x0) AS bx0, min(y0) AS by0, max(x1) AS bx1, max(y1) AS by1 FROM nb GROUP BY job_id, block)
    SELECT job_id, word_ord AS zone_ord, upper(trim(text)) AS code, (x0 + x1) / 2 AS zx, (y0 + y1) / 2 AS zy FROM words_v w WHERE regexp_matches(trim(text), '(?i)^(NSP[0-9]+|[0-9]{{3}}CIS)$')
    AND NOT EXISTS (SELECT 1 FROM br WHERE br.job_id = w.job_id AND x0 BETWEEN bx0 AND bx1 AND y0 BETWEEN by0 AND by1)""",
    "words",
)
def zone_labels(spark: SparkSession, d: str) -> DataFrame:
    return strokes.zone_labels(view(spark, d, "words"))


@_query(
    "legend_tags",
    f""", ln AS (SELECT *, sum(b) OVER (PARTITION BY job_id ORDER BY y0, x0, ord) AS line FROM (SELECT *, CASE WHEN abs((y0 + y1) / 2 - lag((y0 + y1) / 2) OVER (PARTITION BY job_id ORDER BY y0, x0, ord)) < 6 THEN 0 ELSE 1 END AS b FROM legend_spans_v)),
    lx AS (SELECT job_id, line, string_agg(trim(text), ' ' ORDER BY y0, x0, ord) AS text FROM ln GROUP BY job_id, line),
    ly AS (SELECT job_id, line, CASE WHEN regexp_matches(text, '{_RE(CONCRETE)}') THEN 'rc' WHEN regexp_matches(text, '{_RE(STEEL)}') THEN 'steel' END AS material, unnest(regexp_extract_all(upper(text), '{TAGS}', 1)) AS tag FROM lx)
    SELECT job_id, tag, arg_min(material, line) AS material FROM ly WHERE material IS NOT NULL AND length(tag) >= 3 GROUP BY job_id, tag""",
    "legend_spans",
)
def legend_tags(spark: SparkSession, d: str) -> DataFrame:
    return strokes.legend(strokes.text_lines(view(spark, d, "legend_spans")))


def _first_sql(column: str, cases, default: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{_RE(p)}') THEN '{n}'" for n, p in cases) + f" ELSE '{default}' END"


def _holds_sql(column: str, words, how: str = "contains") -> str:
    return "(" + " OR ".join(f"{how}({column}, '{w}')" for w in words) + ")"


_FOLDER_SQL = "(VALUES " + ", ".join(f"('{k}', '{c}', '{p}', {list(t)}::VARCHAR[])" for k, (c, p, t) in library.FOLDERS.items()) + ") fo(fk, fc, fp, ft)"


@_query(
    "family_records",
    f""", n0 AS (SELECT *, {_first_sql("name", library.SHAPES, "rectangular")} AS shape, {_first_sql("name", library.MATERIALS, "concrete")} AS material, {_first_sql("name", library.CATEGORIES, "OST_GenericModel")} AS named,
        coalesce(nullif(regexp_extract(name, '{_RE(library.DIAMETER)}', 1), ''), nullif(regexp_extract(name, '{_RE(library.DIAMETER)}', 2), '')) AS dia, nullif(regexp_extract(name, '{_RE(library.HOLLOW)}', 1), '') AS chs FROM family_files_v)
    SELECT ord, name, coalesce(fc, named) AS category, coalesce(fp, 'point') AS placement, shape, material, array_to_string(list_sort(list_distinct(coalesce(ft, []) || [material, shape])), ',') AS tags,
    CASE WHEN dia IS NOT NULL THEN 'Ø' || CAST(CAST(dia AS INT) AS VARCHAR) WHEN chs IS NOT NULL THEN 'CHS ' || CAST(CAST(chs AS INT) AS VARCHAR) || '×' || CAST(CAST(regexp_extract(name, '{_RE(library.HOLLOW)}', 2) AS INT) AS VARCHAR)
    ELSE array_to_string(list_transform(regexp_extract_all(name, '{library.SIDES}', 0), lambda x: CAST(CAST(regexp_extract(x, '{library.SIDES}', 1) AS INT) AS VARCHAR) || '×' || CAST(CAST(regexp_extract(x, '{library.SIDES}', 2) AS INT) AS VARCHAR) || 'mm'), ';') END AS types
    FROM n0 LEFT JOIN {_FOLDER_SQL} ON fk = lower(folder)""",
    "family_files",
)
def family_records(spark: SparkSession, d: str) -> DataFrame:
    rows = library.records(view(spark, d, "family_files"))
    return rows.select("ord", "name", "category", "placement", "shape", "material", F.array_join("tags", ",").alias("tags"), F.array_join("types.type_name", ";").alias("types"))


@_query(
    "family_kinds",
    f"""SELECT ord, (contains(upper(name), 'UNIVERSAL') AND contains(upper(name), 'COLUMN')) OR {_holds_sql("upper(name)", ("UC-", "UC_"), "starts_with")} AS steel_column,
    NOT {_holds_sql("upper(name)", ("UC-", "UB-", "UNIVERSAL", "I-BEAM", "WIDE FLANGE", "W-SHAPE"))} AND {_holds_sql("upper(name)", ("CONCRETE", "RC ", "CJY", "CAST-IN-PLACE"))} AND {_holds_sql("upper(name)", ("COLUMN", "RECTANGULAR", "ROUND", "CIRCULAR"))} AS concrete_column,
    {_holds_sql("upper(name)", ("STEEL", "I BEAM", "I-BEAM", "W-SHAPE", "WIDE FLANGE", "UB-", "UC-", "PURLIN", "L-ANGLE", "L ANGLE"))} OR {_holds_sql("upper(name)", ("UB ", "UC "), "starts_with")} AS steel_beam FROM family_files_v""",
    "family_files",
)
def family_kinds(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "family_files").select("ord", library.family_kind(F.col("name")).alias("k")).select("ord", "k.*")


@_query(
    "family_files_match",
    "SELECT ord, name AS family_name, 'C:\\lib\\' || folder || '\\' || name || '.RFA' AS path FROM family_files_v WHERE (contains(lower(name), 'column') OR contains(lower(name), 'col')) AND contains(lower(name), 'un') ORDER BY ord LIMIT 15".replace("\\\\", "\\"),
    "family_files",
)
def family_files_match(spark: SparkSession, d: str) -> DataFrame:
    paths = view(spark, d, "family_files").select("ord", F.concat(F.lit("C:\\lib\\"), "folder", F.lit("\\"), "name", F.lit(".RFA")).alias("path"))
    return library.match_files(paths, "OST_StructuralColumns", "Un")


def _replay_sql(rounds: int = 3) -> str:
    kinds = ("structural_framing", "columns", "walls")
    ctes = [
        f"""wa AS (SELECT *, {_WARN_SQL} AS handler FROM build_warnings_v),
    wk AS (SELECT *, CASE WHEN handler = 'missing_family' THEN CASE WHEN contains(lower(text), 'framing') OR contains(lower(text), 'structural_framing') THEN 'structural_framing' WHEN contains(lower(text), 'column') THEN 'columns' WHEN contains(lower(text), 'wall') THEN 'walls' END END AS kind FROM wa),
    wn AS (SELECT job_id, attempt, count(*) AS n, count(*) FILTER (WHERE handler = 'join_error') AS joins, count(*) FILTER (WHERE handler = 'unresolved') AS unknown, count(*) FILTER (WHERE handler IN ('identical', 'transient')) AS logged, count(*) FILTER (WHERE handler = 'short_column') AS short,
        {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS c_{k}" for k in kinds)} FROM wk GROUP BY job_id, attempt),
    en AS (SELECT job_id, ord, sx AS px, sy AS py FROM beams_v UNION ALL SELECT job_id, ord, ex, ey FROM beams_v),
    dp AS (SELECT DISTINCT e.job_id, e.ord FROM en e JOIN columns_v c ON e.job_id = c.job_id AND abs(px - cx) < hw AND abs(py - cy) < hd),
    s0 AS (SELECT job_id, (SELECT count(*) FROM beams_v b WHERE b.job_id = j.job_id) AS n_structural_framing, (SELECT count(*) FROM columns_v b WHERE b.job_id = j.job_id) AS n_columns, (SELECT count(*) FROM core_walls_v b WHERE b.job_id = j.job_id) AS n_walls,
        (SELECT count(*) FROM dp b WHERE b.job_id = j.job_id) AS deep, (SELECT count(*) FROM columns_v b WHERE b.job_id = j.job_id AND col_ord % 7 = 0) AS low, CAST(NULL AS VARCHAR) AS status, 0 AS rounds, 0 AS removed, 0 AS raised, CAST([] AS VARCHAR[]) AS cleared
        FROM (SELECT job_id FROM beams_v UNION SELECT job_id FROM columns_v UNION SELECT job_id FROM core_walls_v) j)"""
    ]
    for a in range(rounds):
        acts = f"(status IS NULL AND coalesce(n, 0) > 0 AND {a < rounds - 1})"
        has = lambda k: f"(NOT list_contains(cleared, '{k}') AND n_{k} > 0)"
        clear = ", ".join(f"CASE WHEN {acts} AND c_{k} > 0 AND {has(k)} THEN '{k}' END" for k in kinds)
        ctes.append(f"""a{a} AS (SELECT s.*, n, unknown, logged, CASE WHEN {acts} AND {has("structural_framing")} THEN least(joins, deep - removed) ELSE 0 END AS j, CASE WHEN {acts} AND short > 0 AND {has("columns")} THEN low - raised ELSE 0 END AS r,
        list_filter([{clear}], lambda x: x IS NOT NULL) AS k FROM s{a} s LEFT JOIN wn ON wn.job_id = s.job_id AND attempt = {a}),
    s{a + 1} AS (SELECT * EXCLUDE (n, unknown, logged, j, r, k) REPLACE (coalesce(status, CASE WHEN coalesce(n, 0) = 0 THEN 'success' WHEN {a == rounds - 1} OR unknown > 0 OR (j = 0 AND r = 0 AND len(k) = 0 AND coalesce(logged, 0) = 0) THEN 'warnings_accepted' END) AS status,
        CASE WHEN status IS NULL THEN {a + 1} ELSE rounds END AS rounds, removed + j AS removed, raised + r AS raised, cleared || k AS cleared) FROM a{a})""")
    return ", ".join(ctes)


@_query(
    "warning_replay",
    f", {_replay_sql()} SELECT job_id, status, CAST(rounds AS BIGINT) AS rounds, CAST(CASE WHEN list_contains(cleared, 'structural_framing') THEN n_structural_framing ELSE removed END AS BIGINT) AS beams_removed, CAST(raised AS BIGINT) AS columns_raised, array_to_string(list_sort(cleared), ',') AS cleared FROM s3",
    "build_warnings",
    "beams",
    "columns",
    "core_walls",
)
def warning_replay(spark: SparkSession, d: str) -> DataFrame:
    columns = view(spark, d, "columns").withColumn("height", F.when(F.col("col_ord") % 7 == 0, 900.0).otherwise(3000.0))
    return alerts.replay(view(spark, d, "beams"), columns, view(spark, d, "core_walls"), view(spark, d, "build_warnings"))


@_query(
    "train_labels",
    """, j AS (SELECT job_id, row_number() OVER (ORDER BY job_id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT job_id FROM edits_v)), sp AS (SELECT job_id, CASE WHEN rn <= greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split FROM j),
    b AS (SELECT d.*, CASE d.type WHEN 'column' THEN 0 WHEN 'slabs' THEN 4 END AS cl FROM (SELECT * REPLACE (CASE type WHEN 'slab' THEN 'slabs' ELSE type END AS type) FROM detections_v) d
        WHERE NOT EXISTS (SELECT 1 FROM edits_v e WHERE e.is_delete AND e.job_id = d.job_id AND e.element_index = d.ord AND e.element_type IN (d.type, regexp_replace(d.type, 's+$', '')))),
    x AS (SELECT *, (x1 + x2) / 2 / 3400 AS cx, (y1 + y2) / 2 / 2400 AS cy, (x2 - x1) / 3400 AS w, (y2 - y1) / 2400 AS h FROM b JOIN sp USING (job_id) WHERE cl IS NOT NULL AND job_id % 5 <> 4)
    SELECT job_id, split, type, ord, printf('%d %.6f %.6f %.6f %.6f', cl, cx, cy, w, h) AS line FROM x WHERE w > 0 AND w <= 1 AND h > 0 AND h <= 1 AND cx BETWEEN 0 AND 1 AND cy BETWEEN 0 AND 1""",
    "detections",
    "edits",
)
def train_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "detections").withColumn("type", F.when(F.col("type") == "slab", "slabs").otherwise(F.col("type")))
    renders = view(spark, d, "pages").where("job_id % 5 <> 4")
    return corrections.train_labels(rows, view(spark, d, "edits"), renders, {"column": 0, "slabs": 4})


@_query("detection_counts", "SELECT job_id, type, count(*) AS n FROM detections_v GROUP BY job_id, type", "detections")
def detection_counts(spark: SparkSession, d: str) -> DataFrame:
    return session.detection_counts(view(spark, d, "detections"))


@_query("annotation_sources", "SELECT source, count(*) AS n FROM (" + SQL["annotate_columns"] + ") GROUP BY source")
def annotation_sources(spark: SparkSession, d: str) -> DataFrame:
    return annotate.provenance(annotate_columns(spark, d))


@_query(
    "review_gate",
    """, e AS (SELECT job_id, count(*) AS n, count(*) FILTER (WHERE confidence < 0.6) AS unsure FROM detections_v GROUP BY job_id), p AS (SELECT job_id, count(*) AS np FROM strokes_v WHERE job_id % 4 <> 2 GROUP BY job_id)
    SELECT job_id, n, unsure, coalesce(np, 0) AS n_paths, concat_ws(',', CASE WHEN job_id % 8 = 7 THEN 'fallback_grid' END, CASE WHEN coalesce(np, 0) < 50 THEN 'scanned' END, CASE WHEN unsure / n > 0.3 THEN 'unsure' END) AS reasons FROM e LEFT JOIN p USING (job_id)""",
    "detections",
    "strokes",
)
def review_gate(spark: SparkSession, d: str) -> DataFrame:
    return session.review_gate(view(spark, d, "detections").withColumn("has_grid", F.col("job_id") % 8 != 7), view(spark, d, "strokes").where("job_id % 4 <> 2"))


@_query(
    "snapshot_merge",
    "SELECT job_id AS user_id, 'k' AS key, arg_max(json_extract_string(payload, '$.k'), ord) AS value FROM job_ops_v WHERE json_extract_string(payload, '$.k') IS NOT NULL GROUP BY job_id",
    "job_ops",
)
def snapshot_merge(spark: SparkSession, d: str) -> DataFrame:
    return session.merge_snapshots(view(spark, d, "job_ops").select(F.col("job_id").alias("user_id"), "ord", F.col("payload").alias("patch")))


@_query(
    "reject_examples",
    f", {_JUDGE_SQL} SELECT job_id, ord, reason FROM jd WHERE action = 'reject' QUALIFY row_number() OVER (PARTITION BY reason ORDER BY ord) <= 5",
    *_FRAMING_VIEWS,
)
def reject_examples(spark: SparkSession, d: str) -> DataFrame:
    return session.examples(admit.judge(*_framing(spark, d)).where("action = 'reject'"), ["reason"], 5).select("job_id", "ord", "reason")


_SHEETS = "SELECT p_partkey AS ord, 5.0 + p_partkey % 70 AS width_in, 4.0 + p_partkey * 7 % 59 AS height_in, 1.0 * (p_partkey * 13 % 110) AS file_mb, p_partkey * 3 % 230 AS objects FROM part"


@_query(
    "render_plan",
    f"""WITH s AS ({_SHEETS}), l AS (SELECT *, list_filter([300, 250, 200, 150, 125, 100, 72], lambda r: width_in * r * height_in * r <= 100000000 AND width_in * r * height_in * r * 4.5 / 1048576 <= 600)[1] AS d,
    CASE WHEN file_mb > 100 THEN 'too_large' WHEN greatest(width_in, height_in) > 60 THEN 'too_wide' WHEN greatest(width_in, height_in) / least(width_in, height_in) > 4 THEN 'too_long' END AS error FROM s)
    SELECT ord, error, CASE WHEN error IS NULL THEN CASE WHEN d IS NULL OR objects > 200 THEN 'tiled' ELSE 'direct' END END AS method, CASE WHEN error IS NULL THEN coalesce(d, 72) END AS dpi,
    CASE WHEN width_in * 150 * height_in * 150 > 100000000 THEN greatest(72, CAST(floor(sqrt(100000000 / (width_in * height_in))) AS INT)) ELSE 150 END AS capped FROM l""",
)
def render_plan(spark: SparkSession, d: str) -> DataFrame:
    sheets = spark.sql(_SHEETS.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{d}/part.parquet"))
    w, h = F.col("width_in").cast("double"), F.col("height_in").cast("double")
    sheets = sheets.withColumns({"width_in": w, "height_in": h, "capped": readers.capped_dpi(w, h)})
    return readers.render_plan(sheets).select("ord", "error", "method", "dpi", "capped")


@_query(
    "type_parameters",
    """SELECT ord, CAST(CAST(round_even((x2 - x1) * 20 / 50, 0) * 50 AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(round_even((y2 - y1) * 20 / 50, 0) * 50 AS BIGINT) AS VARCHAR) || 'mm' AS sized, round((x2 - x1) / 304.8, 9) AS feet, round_even((y2 - y1) / 3 * 304.8, 1) AS mm,
    CASE WHEN big THEN x0 END AS x0, CASE WHEN big THEN y0 END AS y0, CASE WHEN big THEN cx1 END AS cx1, CASE WHEN big THEN cy1 END AS cy1
    FROM (SELECT *, cx1 - x0 >= 20 AND cy1 - y0 >= 20 AS big FROM (SELECT *, greatest(0, CAST(trunc(cx - w / 2 - p) AS INT)) AS x0, greatest(0, CAST(trunc(cy - h / 2 - p) AS INT)) AS y0, least(3400, CAST(trunc(cx + w / 2 + p) AS INT)) AS cx1, least(2400, CAST(trunc(cy + h / 2 + p) AS INT)) AS cy1
    FROM (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, greatest(x2 - x1, 50) AS w, greatest(y2 - y1, 50) AS h, greatest(x2 - x1, y2 - y1, 50) * 2.5 AS p FROM detections_v)))""",
    "detections",
)
def type_parameters(spark: SparkSession, d: str) -> DataFrame:
    rows = boxes.centred(view(spark, d, "detections"))
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = rows.select("ord", sized_type(w * 20, h * 20).alias("sized"), F.round(feet(w), 9).alias("feet"), millimetres(h / 3).alias("mm"), crop(F.col("cx"), F.col("cy"), w, h, F.lit(3400), F.lit(2400)).alias("c"))
    return rows.select("ord", "sized", "feet", "mm", F.col("c.x0").alias("x0"), F.col("c.y0").alias("y0"), F.col("c.x1").alias("cx1"), F.col("c.y1").alias("cy1"))
