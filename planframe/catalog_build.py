"""Registered queries of edits, levels, placement, scenes and answers, over views of the driver's tables, and their SQL for DuckDB."""

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planframe.functions import answers
from planframe.operators import corrections, edits, jobs, levels, placement, scene
from planframe.plans.adapters import view
from planframe.registry import query, rounded

#: Fields of each kind that the edit queries let change.
_FIELDS = {"column": ["width", "depth", "level"], "structural_framing": ["width", "depth"], "slab": ["width", "level"]}

_ALLOWED = " OR ".join(f"(element_type = '{k}' AND field IN ({', '.join(repr(f) for f in v)}))" for k, v in _FIELDS.items())
_REPLAY = f""", n AS (SELECT job_id, element_type, list(ord ORDER BY ord) AS alive FROM listed_v GROUP BY ALL),
    c AS (SELECT *, CASE WHEN element_type NOT IN ({", ".join(repr(k) for k in _FIELDS)}) THEN 'unknown_type' WHEN NOT is_delete AND NOT ({_ALLOWED}) THEN 'unknown_field' WHEN NOT is_delete AND field IN ('id', 'level', 'top_level') THEN 'blocked_field' END AS e FROM edit_log_v),
    k AS (SELECT *, row_number() OVER (PARTITION BY job_id, element_type ORDER BY patch_ord) AS k FROM c WHERE e IS NULL),
    st AS (SELECT job_id, element_type, CAST(0 AS BIGINT) AS k, alive, CAST(NULL AS BIGINT) AS target, CAST(NULL AS BIGINT) AS patch_ord FROM n
        UNION ALL SELECT st.job_id, st.element_type, k.k, CASE WHEN k.is_delete AND k.ord >= 0 AND k.ord < len(alive) THEN alive[:k.ord] || alive[k.ord + 2:] ELSE alive END,
        CASE WHEN k.ord >= 0 AND k.ord < len(alive) THEN alive[k.ord + 1] END, k.patch_ord FROM st JOIN k ON st.job_id = k.job_id AND st.element_type = k.element_type AND k.k = st.k + 1)"""


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    listed = view(spark, d, "listed")
    return listed, edits.judged(listed, view(spark, d, "edit_log"), _FIELDS)


@query(
    "edit_replay",
    _REPLAY
    + """, f AS (SELECT job_id, element_type, arg_max(alive, k) AS alive FROM st GROUP BY ALL), s AS (SELECT job_id, element_type, unnest(alive) AS ord, unnest(range(len(alive))) AS new_ord FROM f),
    v AS (SELECT st.job_id, st.element_type, st.target AS ord, arg_max(value, st.patch_ord) FILTER (WHERE field = 'width') AS w, arg_max(value, st.patch_ord) FILTER (WHERE field = 'depth') AS d
        FROM st JOIN k ON st.job_id = k.job_id AND st.element_type = k.element_type AND st.k = k.k WHERE NOT is_delete AND target IS NOT NULL GROUP BY ALL)
    SELECT s.job_id, s.element_type, s.ord, s.new_ord, coalesce(w, width) AS width, coalesce(d, depth) AS depth FROM s JOIN listed_v l ON s.ord = l.ord
    LEFT JOIN v ON s.job_id = v.job_id AND s.element_type = v.element_type AND s.ord = v.ord""",
    "listed", "edit_log",
)
def edit_replay(spark: SparkSession, d: str) -> DataFrame:
    listed, log = _judged(spark, d)
    return edits.replayed(listed, log.where("error is null"), ["job_id", "element_type"], ["width", "depth"])


@query(
    "edit_errors",
    _REPLAY + " SELECT c.job_id, c.element_type, c.patch_ord, c.ord, coalesce(e, CASE WHEN target IS NULL THEN 'no_element' END) AS error FROM c LEFT JOIN st ON c.job_id = st.job_id AND c.element_type = st.element_type AND c.patch_ord = st.patch_ord",
    "listed", "edit_log",
)
def edit_errors(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[1].select("job_id", "element_type", "patch_ord", "ord", "error")


@query(
    "level_reconcile",
    """, e AS (SELECT job_id, list(struct_pack(name := level, mm := elevation, ord := ord) ORDER BY ord) AS have FROM have_levels_v GROUP BY job_id),
    w AS (SELECT job_id, list(struct_pack(level := level, mm := elevation) ORDER BY ord) AS want FROM want_levels_v GROUP BY job_id),
    j AS (SELECT coalesce(e.job_id, w.job_id) AS job_id, coalesce(have, []) AS have, CASE WHEN len(want) >= 2 THEN want ELSE [struct_pack(level := 'Level 0', mm := CAST(0 AS DOUBLE)), struct_pack(level := 'Level 1', mm := CAST(3000 AS DOUBLE))] END AS want FROM e FULL JOIN w ON e.job_id = w.job_id),
    st AS (SELECT job_id, CAST(0 AS BIGINT) AS k, have, want, CAST(NULL AS VARCHAR) AS level, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS DOUBLE) AS elevation, CAST(NULL AS VARCHAR) AS was FROM j
        UNION ALL SELECT job_id, k + 1, CASE WHEN i > 0 THEN have[:i - 1] || [struct_pack(name := CASE WHEN n > 0 THEN have[i].name ELSE t.level END, mm := new_mm, ord := have[i].ord)] || have[i + 1:] ELSE have || [struct_pack(name := t.level, mm := new_mm, ord := CAST(NULL AS BIGINT))] END,
            want, t.level, action, new_mm, CASE WHEN i > 0 THEN have[i].name END
        FROM (SELECT *, CASE WHEN action IN ('keep', 'rename') THEN have[i].mm ELSE t.mm END AS new_mm
            FROM (SELECT *, CASE WHEN n > 0 THEN n ELSE p END AS i, CASE WHEN n > 0 THEN CASE WHEN abs(have[n].mm / 304.8 - t.mm / 304.8) > 1e-4 THEN 'move' ELSE 'keep' END WHEN p > 0 THEN 'rename' ELSE 'create' END AS action
                FROM (SELECT job_id, k, have, want, want[k + 1] AS t, coalesce(list_position(list_transform(have, lambda x: upper(x.name)), upper(want[k + 1].level)), 0) AS n,
                    coalesce(list_position(list_transform(have, lambda x: abs(x.mm / 304.8 - want[k + 1].mm / 304.8) < 1e-4), true), 0) AS p FROM st WHERE k < len(want)) a) b) c),
    l AS (SELECT job_id, unnest(have) AS h, want FROM st WHERE k = len(want)),
    g AS (SELECT job_id, h.name AS name, list_max(list_transform(want, lambda x: x.mm)) AS top, row_number() OVER (PARTITION BY job_id ORDER BY h.mm, h.ord) AS r FROM l WHERE NOT list_contains(list_transform(want, lambda x: upper(x.level)), upper(h.name)))
    SELECT job_id, level, action, elevation, was FROM st WHERE k > 0 UNION ALL SELECT job_id, name, 'delete', top + 3000 * r, name FROM g""",
    "have_levels", "want_levels",
)
def level_reconcile(spark: SparkSession, d: str) -> DataFrame:
    return levels.reconcile_levels(view(spark, d, "have_levels"), view(spark, d, "want_levels")).drop("seq")


_ROUND = """CASE WHEN regexp_matches(upper(coalesce(shape, '')), 'CIRC|ROUND') THEN true WHEN regexp_matches(upper(coalesce(shape, '')), 'RECT|SQ') THEN false ELSE regexp_matches(upper(coalesce(type_mark, '')), 'CIRC|ROUND') END"""
_PLACED = f""", f AS (SELECT job_id, upper(level) AS key, arg_min(level, ord) AS level, arg_min(elevation, ord) AS mm FROM site_levels_v GROUP BY ALL),
    r AS (SELECT c.*, m.rect, m.round, b.level AS base_name, b.mm AS base_mm, t.level AS top_name, t.mm AS top_mm FROM column_items_v c LEFT JOIN loaded_families_v m ON c.job_id = m.job_id
        LEFT JOIN f b ON c.job_id = b.job_id AND b.key = upper(coalesce(c.level, 'Level 0')) LEFT JOIN f t ON c.job_id = t.job_id AND t.key = upper(coalesce(c.top_level, 'Level 1'))),
    a AS (SELECT r.job_id, r.ord, arg_min(l.level, (l.elevation, l.level)) AS above FROM r JOIN site_levels_v l ON r.job_id = l.job_id AND l.elevation > r.base_mm + 1e-6 WHERE top_mm <= base_mm + 1e-6 GROUP BY ALL),
    q AS (SELECT r.*, above, CASE WHEN rect IS NULL AND round IS NULL THEN 'no family' WHEN x IS NULL OR y IS NULL THEN 'no location' WHEN base_name IS NULL THEN 'no level' END AS reason,
        CASE WHEN {_ROUND} THEN coalesce(round, rect) ELSE coalesce(rect, round) END AS family, greatest(width, 200) AS w, greatest(depth, 200) AS d FROM r LEFT JOIN a ON r.job_id = a.job_id AND r.ord = a.ord)"""


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return placement.place_columns(*(view(spark, d, n) for n in ("column_items", "site_levels", "loaded_families")))


@query(
    "placement_columns",
    _PLACED
    + """ SELECT job_id, ord, CASE WHEN reason IS NULL THEN 'placed' ELSE 'skipped' END AS status, reason, CASE WHEN reason IS NULL THEN family END AS family, w AS width, d AS depth, CASE WHEN reason IS NULL THEN base_name END AS base_level,
    CASE WHEN reason IS NOT NULL THEN NULL WHEN top_mm <= base_mm + 1e-6 THEN above ELSE top_name END AS top_level FROM q""",
    "column_items", "site_levels", "loaded_families",
)
def placement_columns(spark: SparkSession, d: str) -> DataFrame:
    return _placed(spark, d)


@query(
    "placement_types",
    _PLACED
    + """, s AS (SELECT job_id, ord, family, CAST(CAST(round_even(w / 50, 0) * 50 AS BIGINT) AS VARCHAR) || 'x' || CAST(CAST(round_even(d / 50, 0) * 50 AS BIGINT) AS VARCHAR) || 'mm' AS name FROM q WHERE reason IS NULL),
    h AS (SELECT job_id, family, upper(type_name) AS key, min(type_name) AS have FROM known_types_v GROUP BY ALL)
    SELECT s.job_id, s.ord, s.family, coalesce(have, name) AS type_name, CASE WHEN have IS NOT NULL THEN 'existing' WHEN row_number() OVER (PARTITION BY s.job_id, s.family, name ORDER BY ord) = 1 THEN 'created' ELSE 'reused' END AS outcome
    FROM s LEFT JOIN h ON s.job_id = h.job_id AND s.family = h.family AND h.key = upper(name)""",
    "column_items", "site_levels", "loaded_families", "known_types",
)
def placement_types(spark: SparkSession, d: str) -> DataFrame:
    return placement.sized_types(_placed(spark, d).where("status = 'placed'"), view(spark, d, "known_types"))


@query(
    "next_level",
    """ SELECT b.job_id, b.ord, arg_min(l.level, (l.elevation, l.level)) AS level, min(l.elevation) AS elevation FROM scene_items_v b LEFT JOIN site_levels_v l ON b.job_id = l.job_id AND l.elevation > coalesce(b.sz, 0) + 1e-6 GROUP BY b.job_id, b.ord""",
    "scene_items", "site_levels",
)
def next_level(spark: SparkSession, d: str) -> DataFrame:
    bases = view(spark, d, "scene_items").select("job_id", "ord", F.coalesce("sz", F.lit(0.0)).alias("base"))
    return levels.level_above(view(spark, d, "site_levels"), bases)


_LEVEL_MM = "(SELECT job_id, level, max(elevation) AS mm FROM site_levels_v GROUP BY ALL)"
_SOLIDS = f""", i AS (SELECT s.*, coalesce(b.mm, 0) AS base, t.mm AS top FROM scene_items_v s LEFT JOIN {_LEVEL_MM} b ON s.job_id = b.job_id AND b.level = coalesce(s.level, 'Level 0') LEFT JOIN {_LEVEL_MM} t ON s.job_id = t.job_id AND t.level = coalesce(s.top_level, 'Level 1')),
    g AS (SELECT *, sqrt((ex - sx) * (ex - sx) + (ey - sy) * (ey - sy)) AS span, coalesce(top - base, coalesce(height, 2800)) AS tall FROM i),
    o AS (SELECT job_id, kind, ord, false AS round, (sx + ex) / 2 AS cx, (sy + ey) / 2 AS cy, coalesce(height, 2800) / 2 AS cz, span AS dx, coalesce(width, 200) AS dy, coalesce(height, 2800) AS dz, atan2(ey - sy, ex - sx) AS angle FROM g WHERE kind = 'wall' AND span >= 1
        UNION ALL SELECT job_id, kind, ord, false, (sx + ex) / 2, (sy + ey) / 2, coalesce(sz, 0) - coalesce(depth, 800) / 2, span, coalesce(width, 200), coalesce(depth, 800), atan2(ey - sy, ex - sx) FROM g WHERE kind = 'beam' AND span >= 1
        UNION ALL SELECT job_id, kind, ord, coalesce(shape = 'circular', false), sx, sy, base + tall / 2, coalesce(width, 300), CASE WHEN shape = 'circular' THEN coalesce(width, 300) ELSE coalesce(depth, 300) END, tall, 0 FROM g WHERE kind = 'column' AND tall > 0
        UNION ALL SELECT job_id, kind, ord, false, sx, sy, coalesce(sz, 0) + coalesce(height, 2100) / 2, coalesce(width, 900), CASE kind WHEN 'door' THEN 100 ELSE 50 END, coalesce(height, 2100), 0 FROM g WHERE kind IN ('door', 'window')
        UNION ALL SELECT job_id, kind, ord, false, (sx + ex) / 2, (sy + ey) / 2, coalesce(sz, 0) - coalesce(width, 200) / 2, abs(ex - sx), abs(ey - sy), coalesce(width, 200), 0 FROM g WHERE kind = 'slab' AND abs(ex - sx) >= 1 AND abs(ey - sy) >= 1),
    a AS (SELECT * FROM o UNION ALL SELECT DISTINCT job_id, 'placeholder', 0, false, 0, 0, 0, 1000, 1000, 1, 0 FROM scene_items_v WHERE job_id NOT IN (SELECT job_id FROM o))"""


def _solids(spark: SparkSession, d: str) -> DataFrame:
    items = view(spark, d, "scene_items")
    of = lambda kind: items.where(F.col("kind") == kind)
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    outline = F.array(corner("sx", "sy"), corner("ex", "sy"), corner("ex", "ey"), corner("sx", "ey"))
    made = [
        scene.walls(of("wall").withColumn("thickness", F.col("width"))),
        scene.beams(of("beam")),
        scene.columns(of("column").withColumns({"x": F.col("sx"), "y": F.col("sy")}), view(spark, d, "site_levels")),
        scene.openings(items.withColumns({"x": F.col("sx"), "y": F.col("sy"), "z": F.col("sz")})),
        scene.slabs(of("slab").select("job_id", "ord", outline.alias("points"), F.col("width").alias("thickness"), F.col("sz").alias("elevation"))),
    ]
    whole = made[0]
    for m in made[1:]:
        whole = whole.unionByName(m)
    return scene.with_placeholder(items, whole)


_TURNED = "round({}, 6) + 0.0"


@query(
    "scene_vertices",
    _SOLIDS
    + f""", c AS (SELECT * FROM (VALUES (0, -0.5, -0.5, -0.5), (1, 0.5, -0.5, -0.5), (2, -0.5, 0.5, -0.5), (3, 0.5, 0.5, -0.5), (4, -0.5, -0.5, 0.5), (5, 0.5, -0.5, 0.5), (6, -0.5, 0.5, 0.5), (7, 0.5, 0.5, 0.5)) t(v, px, py, pz)),
    u AS (SELECT z.i * 33 AS v, CAST(0 AS DOUBLE) AS px, CAST(0 AS DOUBLE) AS py, z.pz FROM (VALUES (0, -0.5), (1, 0.5)) z(i, pz) UNION ALL SELECT z.i * 33 + 1 + k, cos(2 * {math.pi!r} * k / 32) / 2, sin(2 * {math.pi!r} * k / 32) / 2, z.pz FROM (VALUES (0, -0.5), (1, 0.5)) z(i, pz), range(32) r(k)),
    p AS (SELECT a.*, c.v, CAST(c.px AS DOUBLE) * dx AS lx, CAST(c.py AS DOUBLE) * dy AS ly, CAST(c.pz AS DOUBLE) * dz AS lz FROM a, c WHERE NOT round UNION ALL SELECT a.*, u.v, u.px * dx, u.py * dy, CAST(u.pz AS DOUBLE) * dz FROM a, u WHERE round)
    SELECT job_id, kind, ord, CAST(v AS INT) AS v, {_TURNED.format("cx + lx * cos(angle) - ly * sin(angle)")} AS x, {_TURNED.format("cz + lz")} AS y, {_TURNED.format("0.0 - (cy + lx * sin(angle) + ly * cos(angle))")} AS z FROM p""",
    "scene_items", "site_levels",
)
def scene_vertices(spark: SparkSession, d: str) -> DataFrame:
    out = rounded(scene.vertices(_solids(spark, d)), "x", "y", "z")
    return out.withColumns({c: F.col(c) + 0.0 for c in "xyz"})


@query(
    "scene_parts",
    _SOLIDS
    + """, n AS (SELECT *, CASE WHEN round THEN 66 ELSE 8 END AS nv, CASE WHEN round THEN 128 ELSE 12 END AS nf, list_position(['wall', 'column', 'door', 'window', 'slab', 'beam', 'placeholder'], kind) AS k FROM a)
    SELECT job_id, kind, ord, CAST(coalesce(sum(nv) OVER w, 0) AS BIGINT) AS first_vertex, CAST(nv AS BIGINT) AS n_vertices, CAST(coalesce(sum(nf) OVER w, 0) AS BIGINT) AS first_face, CAST(nf AS BIGINT) AS n_faces FROM n
    WINDOW w AS (PARTITION BY job_id ORDER BY k, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "scene_items", "site_levels",
)
def scene_parts(spark: SparkSession, d: str) -> DataFrame:
    return scene.parts(_solids(spark, d)).drop("colour")


_TS = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f')"


@query("corr_log", f"SELECT id, {_TS} AS at, job_id, element_type, element_index, changes, CAST(is_delete AS INT) AS is_delete FROM corrections_v ORDER BY ts, id", "corrections")
def corr_log(spark: SparkSession, d: str) -> DataFrame:
    return corrections.log(view(spark, d, "corrections"))


@query("job_count", "SELECT count(DISTINCT job_id) AS n FROM job_ops_v WHERE op = 'put'", "job_ops")
def job_count(spark: SparkSession, d: str) -> DataFrame:
    return jobs.count(jobs.fold(view(spark, d, "job_ops")))


@query("answer_repair", "SELECT id, CASE WHEN id % 7 <> 6 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN id % 7 = 5 THEN 'a # b // c' END AS l FROM answers_v", "answers")
def answer_repair(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "answers").select("id", answers.repair_json("answer").alias("r"))
    return rows.select("id", F.get_json_object("r", "$.k").alias("k"), F.get_json_object("r", "$.l").alias("l"))
