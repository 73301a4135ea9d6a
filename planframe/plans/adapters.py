"""Views of the driver's tables that look like drawing data; one text serves Spark and the SQL checks."""

from pyspark.sql import DataFrame, SparkSession

_TABLES = ("part", "nation", "region", "orders", "lineitem", "supplier", "events", "conversations")

#: Each 2000 parts, 15,000 orders and 100 suppliers are 16 drawings, so that the number of drawings grows with the data and their size does not.
_JOBS = "(SELECT DISTINCT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id FROM {part}) j"

_GAPS = f"""SELECT j.job_id, 'x' AS axis, CAST(n_nationkey AS BIGINT) AS idx, CAST(CASE WHEN (n_nationkey + j.job_id) % 11 = 10 THEN 12600 WHEN (n_nationkey + 2 * j.job_id) % 7 = 6 THEN 2400 ELSE 8400 END AS DOUBLE) AS spacing_mm
        FROM {{nation}} CROSS JOIN {_JOBS} WHERE n_nationkey < 24 UNION ALL SELECT j.job_id, 'y', CAST(r_regionkey AS BIGINT), CAST(8400 - 600 * ((r_regionkey + j.job_id) % 2) AS DOUBLE) FROM {{region}} CROSS JOIN {_JOBS} WHERE r_regionkey < 4"""

#: Where each job's lines lie, in millimetres.
_MM = f"""(SELECT job_id, axis, idx, coalesce(sum(spacing_mm) OVER (PARTITION BY job_id, axis ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mm, spacing_mm AS bay FROM ({_GAPS}) g
        UNION ALL SELECT job_id, axis, max(idx) + 1, sum(spacing_mm), 8400 FROM ({_GAPS}) g GROUP BY job_id, axis)"""

#: Drawings of 125 parts each, so that their number grows with the data and their size does not.
_MODELS = "(SELECT DISTINCT CAST(floor(p_partkey / 125) AS BIGINT) AS job_id FROM {part}) j"
_PARTS = "(SELECT *, CAST(floor(p_partkey / 125) AS BIGINT) AS job_id FROM {part}) p"

#: name -> (SQL with {table} placeholders).
VIEWS = {
    "corrections": """SELECT event_id AS id, ts, user_id AS job_id, event_type AS element_type, CAST(event_id % 50 AS INT) AS element_index,
        props AS changes, event_type = 'error' AS is_delete FROM {events}""",
    "job_ops": """SELECT user_id AS job_id, event_id AS ord, ts, props AS payload, CASE event_type WHEN 'signup' THEN 'put' WHEN 'click' THEN 'update'
        WHEN 'view' THEN 'get' WHEN 'purchase' THEN 'update' ELSE 'contains' END AS op FROM {events}""",
    "chat": """SELECT conv_id AS user_id, turn AS ord, role, concat(CASE (conv_id * 7 + turn) % 6 WHEN 0 THEN 'Why did it fail: ' WHEN 1 THEN 'current status? '
        WHEN 2 THEN 'explain ' WHEN 3 THEN 'how many in the queue ' WHEN 4 THEN 'hello ' ELSE 'what is the dpi ' END, text) AS content FROM {conversations}""",
    # Every seventh box lies on an earlier one of its job and type; every eleventh is larger than 200 px.
    "detections": """SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS ord, CASE p_partkey % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'structural_framing' ELSE 'slab' END AS type,
        CAST((q * 97) % 4000 AS DOUBLE) AS x1, CAST((q * 61) % 3000 AS DOUBLE) AS y1,
        CAST((q * 97) % 4000 + 10 + p_size + big AS DOUBLE) AS x2, CAST((q * 61) % 3000 + 10 + (q * 7) % 50 AS DOUBLE) AS y2,
        CAST((p_partkey * 31) % 100 AS DOUBLE) / 100 AS confidence
        FROM (SELECT p_partkey, p_size, CASE WHEN p_partkey % 7 = 0 AND p_partkey > 48 THEN p_partkey - 48 ELSE p_partkey END AS q, CASE WHEN p_partkey % 11 = 0 THEN 220 ELSE 0 END AS big FROM {part}) p""",
    "grid_lines": f"""SELECT j.job_id, 'x' AS axis, CAST(n_nationkey AS BIGINT) AS idx, CAST((155 + 2 * (j.job_id % 16)) * n_nationkey + 3 * (j.job_id % 16) AS DOUBLE) AS px FROM {{nation}} CROSS JOIN {_JOBS}
        UNION ALL SELECT j.job_id, 'y', CAST(r_regionkey AS BIGINT), CAST((640 + 8 * (j.job_id % 16)) * r_regionkey + 5 * (j.job_id % 16) AS DOUBLE) FROM {{region}} CROSS JOIN {_JOBS}""",
    "grid_gaps": _GAPS,
    "spans": """SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS ord, CAST((p_partkey * 89) % 4000 AS DOUBLE) AS sx, CAST((p_partkey * 53) % 3000 AS DOUBLE) AS sy,
        CASE p_partkey % 6 WHEN 0 THEN concat('C', CAST(p_partkey % 40 AS STRING), ' ', CAST(200 + 50 * (p_partkey % 17) AS STRING), 'x', CAST(200 + 50 * (p_partkey % 13) AS STRING))
        WHEN 1 THEN concat(CAST(300 + 50 * (p_partkey % 11) AS STRING), 'Ø') WHEN 2 THEN concat('Ø', CAST(300 + 50 * (p_partkey % 7) AS STRING))
        WHEN 3 THEN concat('C', CAST(p_partkey % 60 AS STRING)) WHEN 4 THEN concat('RCB', CAST(p_partkey % 30 AS STRING)) ELSE CAST(2400 + 600 * (p_partkey % 20) AS STRING) END AS text FROM {part}""",
    # A beam from one line to the next of its job, off by up to a metre; every fifth lies on the lines.
    "beams": f"""SELECT o.job_id, o.ord, o.dir, x0.mm + o.off * (o.ord * 13 % 1900 - 900) AS sx, y0.mm + o.off * (o.ord * 17 % 1500 - 700) AS sy,
        x0.mm + CASE WHEN o.dir = 'x' THEN x0.bay + o.off * (o.ord * 19 % 1400 - 700) ELSE o.off * (o.ord * 23 % 90) END AS ex,
        y0.mm + CASE WHEN o.dir = 'x' THEN o.off * (o.ord * 29 % 90) ELSE y0.bay + o.off * (o.ord * 31 % 1400 - 700) END AS ey, o.width
        FROM (SELECT CAST(o_orderkey % 16 + 16 * floor(o_orderkey / 15000) AS BIGINT) AS job_id, o_orderkey AS ord, CASE WHEN o_orderkey % 2 = 0 THEN 'x' ELSE 'y' END AS dir, (o_orderkey * 7) % 24 AS i, (o_orderkey * 11) % 5 AS j,
        CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS off, CAST(300 + 100 * (o_orderkey % 6) AS DOUBLE) AS width FROM {{orders}}) o
        JOIN {_MM} x0 ON x0.job_id = o.job_id AND x0.axis = 'x' AND x0.idx = o.i JOIN {_MM} y0 ON y0.job_id = o.job_id AND y0.axis = 'y' AND y0.idx = o.j""",
    "columns": f"""SELECT x.job_id, x.idx * 5 + y.idx AS col_ord, x.mm AS cx, y.mm AS cy, CAST(400 AS DOUBLE) AS hw, CAST(300 AS DOUBLE) AS hd FROM {_MM} x JOIN {_MM} y ON x.job_id = y.job_id
        WHERE x.axis = 'x' AND y.axis = 'y' AND (x.idx * 3 + y.idx * 5 + x.job_id) % 4 <> 0""",
    "dashes": f"""SELECT l.job_id, l.axis, x.mm AS lo, x.mm + 6000 AS hi, y.mm + l.off AS perp FROM (SELECT DISTINCT CAST(l_orderkey % 16 + 16 * floor(l_orderkey / 15000) AS BIGINT) AS job_id, CASE WHEN l_linenumber % 2 = 0 THEN 'x' ELSE 'y' END AS axis,
        l_orderkey % CASE WHEN l_linenumber % 2 = 0 THEN 24 ELSE 5 END AS i, l_partkey % CASE WHEN l_linenumber % 2 = 0 THEN 5 ELSE 25 END AS j, CAST(l_linenumber * 40 AS DOUBLE) AS off FROM {{lineitem}}) l
        JOIN {_MM} x ON x.job_id = l.job_id AND x.axis = l.axis AND x.idx = l.i JOIN {_MM} y ON y.job_id = l.job_id AND y.axis <> l.axis AND y.idx = l.j""",
    # Core walls in one bay of every third job, and drawn rectangles sized like columns on lines that have none.
    "core_walls": f"""SELECT x.job_id, x.idx AS wall_ord, x.mm - 600 AS x0, y.mm - 500 AS y0, x.mm + 900 AS x1, y.mm + 700 AS y1 FROM {_MM} x JOIN {_MM} y ON x.job_id = y.job_id
        WHERE x.axis = 'x' AND y.axis = 'y' AND x.job_id % 3 = 0 AND x.idx % 6 = 3 AND y.idx = 2""",
    "rectangles": f"""SELECT x.job_id, x.idx * 5 + y.idx AS rect_ord, x.mm - 300 AS x0, y.mm - 250 AS y0, x.mm + 350 + 300 * (x.idx % 5) AS x1, y.mm + 250 AS y1 FROM {_MM} x JOIN {_MM} y ON x.job_id = y.job_id
        WHERE x.axis = 'x' AND y.axis = 'y' AND (x.idx * 3 + y.idx * 5 + x.job_id) % 4 = 0 AND x.idx % 2 = 0""",
    "slabs": """SELECT CAST(s_suppkey % 4 + 16 * floor(s_suppkey / 100) AS BIGINT) AS job_id, s_suppkey AS ord, CAST((s_suppkey * 131) % 9000 AS DOUBLE) AS x1, CAST((s_suppkey * 71) % 7000 AS DOUBLE) AS y1,
        CAST((s_suppkey * 131) % 9000 + 900 AS DOUBLE) AS x2, CAST((s_suppkey * 71) % 7000 + 700 AS DOUBLE) AS y2 FROM {supplier}""",
    "zones": """SELECT CAST(s_suppkey % 4 + 16 * floor(s_suppkey / 100) AS BIGINT) AS job_id, s_suppkey AS zone_ord, CAST((s_suppkey * 113) % 9500 AS DOUBLE) AS zx, CAST((s_suppkey * 67) % 7500 AS DOUBLE) AS zy,
        CASE WHEN s_suppkey % 3 = 0 THEN concat(CAST(150 + 50 * (s_suppkey % 4) AS STRING), 'CIS') ELSE concat('NSP', CAST(s_suppkey % 7 AS STRING)) END AS code FROM {supplier}""",
    # Sheets of all four rotations; every eighth has no letters, so no grid.
    "pages": f"""SELECT j.job_id, 90 * (j.job_id % 4) AS rotation, CAST(144 AS DOUBLE) AS dpi, 3400 AS width_px, 2400 AS height_px, CAST(1700 AS DOUBLE) AS w_pt, CAST(1200 AS DOUBLE) AS h_pt FROM {_JOBS}""",
    "page_texts": f"""SELECT job_id, ord, text, cx - 4 AS x0, cy - 3 AS y0, cx + 4 AS x1, cy + 3 AS y1 FROM (
        SELECT job_id, ord, text, CASE job_id % 4 WHEN 1 THEN dy WHEN 2 THEN 1700 - dx WHEN 3 THEN 1200 - dy ELSE dx END AS cx, CASE job_id % 4 WHEN 1 THEN 1700 - dx WHEN 2 THEN 1200 - dy WHEN 3 THEN dx ELSE dy END AS cy FROM (
        SELECT j.job_id, CAST(n_nationkey AS BIGINT) AS ord, CAST(n_nationkey + 1 AS STRING) AS text, CAST(150 + 55 * n_nationkey + j.job_id % 16 AS DOUBLE) AS dx, CAST(50 AS DOUBLE) AS dy FROM {{nation}} CROSS JOIN {_JOBS}
        UNION ALL SELECT j.job_id, 100 + n_nationkey, concat(' ', CAST(n_nationkey + 1 AS STRING)), 151 + 55 * n_nationkey + j.job_id % 16, 1150 FROM {{nation}} CROSS JOIN {_JOBS} WHERE n_nationkey % 3 <> 0
        UNION ALL SELECT j.job_id, 200 + n_nationkey, CASE WHEN n_nationkey % 7 = 3 THEN '16800' WHEN n_nationkey % 6 = 1 THEN '2400' ELSE '8400' END, 177 + 55 * n_nationkey + j.job_id % 16, 30 FROM {{nation}} CROSS JOIN {_JOBS} WHERE n_nationkey < 24 AND (n_nationkey + j.job_id) % 5 <> 4
        UNION ALL SELECT j.job_id, 300 + r_regionkey, char(65 + CAST(r_regionkey AS INT)), 70, 140 + 220 * r_regionkey + j.job_id % 16 FROM {{region}} CROSS JOIN {_JOBS} WHERE j.job_id % 8 <> 7
        UNION ALL SELECT j.job_id, 310 + r_regionkey, char(65 + CAST(r_regionkey AS INT)), 1640, 141 + 220 * r_regionkey + j.job_id % 16 FROM {{region}} CROSS JOIN {_JOBS} WHERE j.job_id % 8 <> 7 AND r_regionkey % 2 = 0
        UNION ALL SELECT j.job_id, 320 + r_regionkey, CAST(6000 + 300 * r_regionkey AS STRING), 30, 250 + 220 * r_regionkey + j.job_id % 16 FROM {{region}} CROSS JOIN {_JOBS} WHERE r_regionkey < 3
        UNION ALL SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT), 1000 + p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST(p_partkey % 120 AS STRING) WHEN 1 THEN char(65 + CAST(p_partkey % 20 AS INT)) WHEN 2 THEN CAST(100 * (p_partkey % 320) AS STRING) ELSE concat('N', CAST(p_partkey AS STRING)) END,
            CAST(100 + (p_partkey * 89) % 1500 AS DOUBLE), CAST(100 + (p_partkey * 53) % 1000 AS DOUBLE) FROM {{part}}) t) u""",
    # What three attempts at a build gave: jobs with unknown messages, with known ones only, with missing families, and without any.
    "build_warnings": f"""SELECT j.job_id, a.attempt, CAST(n_nationkey AS BIGINT) AS ord, CASE WHEN j.job_id % 4 = 0 AND n_nationkey = 2 THEN 'Highlighted in red' WHEN a.attempt = 1 AND j.job_id % 4 = 2 THEN 'ExternalEvent still Pending'
        WHEN j.job_id % 4 = 2 AND n_nationkey = 1 THEN CASE j.job_id % 16 WHEN 2 THEN 'Missing wall family' WHEN 6 THEN 'framing: unresolved reference' ELSE 'column family not loaded' END WHEN n_nationkey % 3 = 0 THEN 'Cannot keep elements joined.'
        WHEN n_nationkey % 3 = 1 THEN 'There are identical instances in the same place.' ELSE 'The column is too short' END AS text
        FROM {{nation}} CROSS JOIN {_JOBS} CROSS JOIN (SELECT r_regionkey AS attempt FROM {{region}} WHERE r_regionkey < 3) a
        WHERE j.job_id % 4 <> 3 AND n_nationkey < 2 + j.job_id % 5 * 4 AND (a.attempt = 0 OR j.job_id % 4 = 2 OR (j.job_id % 4 = 1 AND a.attempt <= j.job_id % 3))""",
    "edits": """SELECT p_partkey AS id, CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, CASE p_partkey % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'structural_framing' ELSE 'slabs' END AS element_type, CAST(p_partkey - CASE WHEN p_partkey % 5 = 0 THEN 16 ELSE 0 END AS INT) AS element_index,
        p_partkey % 4 = 0 AS is_delete FROM {part}""",
    "segments": """SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS ord, CASE p_partkey % 4 WHEN 3 THEN '[] 0' WHEN 1 THEN '[5] 1' ELSE '[3 2] 0' END AS dashes, CAST((p_partkey * 83) % 1600 AS DOUBLE) AS x1, CAST((p_partkey * 59) % 1100 AS DOUBLE) AS y1,
        CAST((p_partkey * 83) % 1600 + CASE p_partkey % 3 WHEN 0 THEN 60 + p_partkey % 50 WHEN 1 THEN p_partkey % 5 ELSE 40 END AS DOUBLE) AS x2, CAST((p_partkey * 59) % 1100 + CASE p_partkey % 3 WHEN 1 THEN 60 + p_partkey % 50 WHEN 0 THEN p_partkey % 7 ELSE 25 END AS DOUBLE) AS y2 FROM {part}""",
    "rects": """SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS ord, CAST((p_partkey * 83) % 1600 AS DOUBLE) AS x1, CAST((p_partkey * 59) % 1100 AS DOUBLE) AS y1,
        CAST((p_partkey * 83) % 1600 + p_partkey % 20 AS DOUBLE) AS x2, CAST((p_partkey * 59) % 1100 + 3 + p_partkey % 50 AS DOUBLE) AS y2 FROM {part}""",
    # A NOTES block of three lines for each job, of clauses or (odd jobs) of plain lines, and zone codes inside and outside of it.
    "words": f"""SELECT job_id, word_ord, text, x0, y0, x0 + 20 AS x1, y0 + 10 AS y1, block_no, line_no FROM (
        SELECT j.job_id, CAST(0 AS BIGINT) AS word_ord, CASE j.job_id % 3 WHEN 0 THEN 'Notes' ELSE 'NOTES:' END AS text, CAST(2000 AS DOUBLE) AS x0, CAST(100 AS DOUBLE) AS y0, 1 AS block_no, 0 AS line_no FROM {_JOBS}
        UNION ALL SELECT j.job_id, 1 + n_nationkey, CASE n_nationkey % 8 WHEN 0 THEN CASE j.job_id % 2 WHEN 0 THEN 'ALL' ELSE 'ZONE' END WHEN 1 THEN concat('NSP', CAST(n_nationkey % 5 + 1 AS STRING)) WHEN 2 THEN CAST(100 + 10 * (n_nationkey + j.job_id % 16) AS STRING) WHEN 3 THEN 'THK'
            WHEN 4 THEN '+' WHEN 5 THEN CAST(90 + 10 * (n_nationkey % 7) AS STRING) WHEN 6 THEN CASE n_nationkey WHEN 14 THEN 'THK,' ELSE 'THK' END ELSE CAST(700 + n_nationkey AS STRING) END,
            CAST(2000 + 30 * (n_nationkey % 8) AS DOUBLE), CAST(120 + 15 * floor(n_nationkey / 8) AS DOUBLE), 1, CAST(floor(n_nationkey / 8) AS INT) FROM {{nation}} CROSS JOIN {_JOBS} WHERE n_nationkey < 24
        UNION ALL SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT), 1000 + p_partkey, CASE p_partkey % 3 WHEN 0 THEN concat(CAST(150 + 50 * (p_partkey % 4) AS STRING), 'cis') WHEN 1 THEN concat('NSP', CAST(p_partkey % 9 AS STRING)) ELSE concat('W', CAST(p_partkey AS STRING)) END,
            CAST(1500 + (p_partkey * 37) % 1400 AS DOUBLE), CAST(CASE WHEN p_partkey % 5 = 0 THEN 130 ELSE 400 + (p_partkey * 53) % 900 END AS DOUBLE), 2, CAST(p_partkey AS INT) FROM {{part}} WHERE NOT (p_partkey % 3 = 2 AND p_partkey % 5 = 0)) w""",
    "legend_spans": """SELECT job_id, ord, CAST(100 + 40 * k AS DOUBLE) AS x0, CAST(12 * line + k % 3 AS DOUBLE) AS y0, CAST(12 * line + k % 3 + 8 AS DOUBLE) AS y1,
        CASE k WHEN 0 THEN concat('rcb', CAST(ord % 20 AS STRING)) WHEN 1 THEN CASE line % 3 WHEN 0 THEN 'R.C. beam ' WHEN 1 THEN 'h-beam' ELSE 'plain' END WHEN 2 THEN concat('SB', CAST(ord % 9 AS STRING)) WHEN 3 THEN CASE line % 2 WHEN 0 THEN 'universal' ELSE 'typical' END WHEN 4 THEN concat('H-RCB', CAST(ord % 30 AS STRING)) ELSE 'as shown' END AS text
        FROM (SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS ord, CAST(floor(p_partkey / 16) AS BIGINT) % 6 AS k, CAST(floor(p_partkey / 96) AS BIGINT) AS line FROM {part}) p""",
    "legend": """SELECT DISTINCT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, concat('RCB', CAST(p_partkey % 30 AS STRING)) AS tag, CASE WHEN (p_partkey % 30 + p_partkey % 16) % 3 = 0 THEN 'steel' ELSE 'rc' END AS material
        FROM {part} WHERE p_partkey % 6 = 4 AND (p_partkey % 30 + p_partkey % 16) % 3 < 2""",
    "warnings": """SELECT CAST(o_orderkey % 16 + 16 * floor(o_orderkey / 15000) AS BIGINT) AS job_id, o_orderkey AS ord, CASE o_orderkey % 6 WHEN 0 THEN 'Cannot keep elements joined.' WHEN 1 THEN 'There are identical instances in the same place.'
        WHEN 2 THEN 'ExternalEvent request pending' WHEN 3 THEN 'Missing structural framing family' WHEN 4 THEN 'The column is too short' ELSE concat('Note ', o_orderpriority) END AS text FROM {orders}""",
    "strokes": """SELECT CAST(p_partkey % 16 + 16 * floor(p_partkey / 2000) AS BIGINT) AS job_id, p_partkey AS path_ord, CAST((p_partkey * 83) % 4000 AS DOUBLE) AS x1, CAST((p_partkey * 59) % 3000 AS DOUBLE) AS y1,
        CAST((p_partkey * 83) % 4000 + 30 + (p_partkey * 3) % 400 AS DOUBLE) AS x2, CAST((p_partkey * 59) % 3000 + 20 + (p_partkey * 5) % 300 AS DOUBLE) AS y2,
        CASE p_partkey % 4 WHEN 0 THEN '[3 2] 0' WHEN 1 THEN '[] 0' WHEN 2 THEN '[5] 1' ELSE '' END AS dashes FROM {part}""",
    "items": """SELECT CAST(l_orderkey % 16 + 16 * floor(l_orderkey / 15000) AS BIGINT) AS job_id, l_orderkey AS path_ord, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS item_ord, CASE WHEN l_linenumber = 1 THEN 'm' WHEN l_partkey % 7 = 0 THEN 'c' WHEN l_partkey % 11 = 0 THEN 'm' ELSE 'l' END AS op,
        CAST((l_linenumber * 40) % 200 + l_suppkey % 3 AS DOUBLE) AS x, CAST((l_orderkey * 7 + CASE WHEN l_linenumber % 3 = 0 THEN 90 ELSE 0 END) % 500 AS DOUBLE) AS y FROM {lineitem}""",
    "family_files": """SELECT p_partkey AS ord, CASE p_partkey % 7 WHEN 0 THEN 'Structural_Columns' WHEN 1 THEN 'structural_framing' WHEN 2 THEN 'doors' WHEN 3 THEN 'ceilings' ELSE 'other' END AS folder,
        CASE p_partkey % 11 WHEN 0 THEN 'UC 152x152' WHEN 1 THEN concat('Round Column dia ', CAST(300 + p_partkey % 500 AS STRING)) WHEN 2 THEN concat('CHS_', CAST(100 + p_partkey % 200 AS STRING), 'x', CAST(4 + p_partkey % 9 AS STRING))
        WHEN 3 THEN concat('RC beam ', CAST(200 + p_partkey % 400 AS STRING), 'x', CAST(300 + p_partkey % 300 AS STRING), ' 450X600') WHEN 4 THEN 'timber post' WHEN 5 THEN concat('RHS-', CAST(p_partkey % 9 AS STRING)) WHEN 6 THEN 'Steel door 900x2100'
        WHEN 7 THEN 'Universal Column UC-254' WHEN 8 THEN 'Concrete-Rectangular-Column' WHEN 9 THEN 'W-Shape I-Beam' ELSE p_name END AS name FROM {part}""",
    # A list of each kind for each drawing, and a log of edits by place: fields that may not change, unknown kinds and places out of range are among them.
    "listed": f"""SELECT job_id, CASE p_partkey % 3 WHEN 0 THEN 'column' WHEN 1 THEN 'structural_framing' ELSE 'slab' END AS element_type, p_partkey AS ord, CAST(p_size AS STRING) AS width, CAST(p_size + 7 AS STRING) AS depth FROM {_PARTS}""",
    "edit_log": f"""SELECT job_id, (p_partkey * 37) % 125 AS patch_ord, CASE WHEN p_partkey % 29 = 0 THEN 'stairs' WHEN p_partkey % 3 = 0 THEN 'column' WHEN p_partkey % 3 = 1 THEN 'structural_framing' ELSE 'slab' END AS element_type,
        CAST((p_size * 3 + p_partkey) % 47 - 1 AS BIGINT) AS ord, CASE p_partkey % 7 WHEN 0 THEN 'depth' WHEN 1 THEN 'level' WHEN 2 THEN 'colour' ELSE 'width' END AS field, CAST(1000 + p_partkey AS STRING) AS value, p_partkey % 4 = 0 AS is_delete FROM {_PARTS}""",
    # What a model might answer with: fences, remarks, cut ends, lists of one, trailing and missing commas, nothing.
    "answers": """SELECT event_id AS id, props, CASE event_id % 7 WHEN 0 THEN concat('```json', char(10), props, char(10), '```') WHEN 1 THEN concat('Here you are: ', props, ' // done') WHEN 2 THEN substr(props, 1, length(props) - 1) WHEN 3 THEN concat('[', props, ',]')
        WHEN 4 THEN concat(substr(props, 1, length(props) - 1), ', # note', char(10), char(125)) WHEN 5 THEN concat(substr(props, 1, length(props) - 1), char(10), '"l": "a # b // c"', char(125)) ELSE 'no answer' END AS answer FROM {events}""",
    "have_levels": f"""SELECT job_id, CAST(r_regionkey AS BIGINT) AS ord, CASE r_regionkey WHEN 0 THEN 'LEVEL 0' WHEN 1 THEN 'Level 2' WHEN 2 THEN 'Roof' WHEN 3 THEN concat('Old ', CAST(job_id % 3 AS STRING)) ELSE 'level 3' END AS level,
        CAST(CASE r_regionkey WHEN 0 THEN 50 * (job_id % 2) WHEN 1 THEN 3000 WHEN 2 THEN 9000 WHEN 3 THEN 6000.02 ELSE 3000 * (job_id % 5) END AS DOUBLE) AS elevation FROM {{region}} CROSS JOIN {_MODELS} WHERE job_id % 7 <> 3""",
    "want_levels": f"""SELECT job_id, CAST(n_nationkey AS BIGINT) AS ord, CASE n_nationkey WHEN 0 THEN 'Level 0' WHEN 1 THEN 'Level 1' WHEN 2 THEN 'Level 2' WHEN 3 THEN 'Level 3' WHEN 4 THEN 'level 1' ELSE concat('Roof ', CAST(job_id % 2 AS STRING)) END AS level,
        CAST(CASE n_nationkey WHEN 1 THEN 3000 WHEN 2 THEN 6000 WHEN 3 THEN 9000 WHEN 4 THEN 3500 WHEN 5 THEN 12000 ELSE 0 END AS DOUBLE) AS elevation FROM {{nation}} CROSS JOIN {_MODELS} WHERE n_nationkey < 6 AND n_nationkey <= job_id % 7""",
    "site_levels": f"""SELECT job_id, CAST(r_regionkey AS BIGINT) AS ord, CASE r_regionkey WHEN 0 THEN 'Level 0' WHEN 1 THEN 'LEVEL 1' WHEN 2 THEN 'Mezzanine' WHEN 3 THEN 'Level 2' ELSE 'Level 1' END AS level,
        CAST(CASE r_regionkey WHEN 0 THEN 0 WHEN 1 THEN 3000 WHEN 2 THEN 1500 WHEN 3 THEN 6000 ELSE -500 END AS DOUBLE) AS elevation FROM {{region}} CROSS JOIN {_MODELS} WHERE NOT (job_id % 4 = 0 AND r_regionkey = 1)""",
    "column_items": f"""SELECT job_id, p_partkey AS ord, CASE WHEN p_partkey % 23 <> 0 THEN CAST((p_partkey * 97) % 40000 AS DOUBLE) END AS x, CAST((p_partkey * 61) % 30000 AS DOUBLE) AS y, CAST(150 + 25 * (p_size % 20) AS DOUBLE) AS width, CAST(180 + 35 * (p_partkey % 9) AS DOUBLE) AS depth,
        CASE p_partkey % 5 WHEN 0 THEN 'Circular' WHEN 1 THEN 'square' WHEN 2 THEN 'other' END AS shape, CASE p_partkey % 4 WHEN 0 THEN 'RC round' WHEN 1 THEN 'Circ 300' END AS type_mark,
        CASE p_partkey % 6 WHEN 0 THEN 'level 2' WHEN 1 THEN 'mezzanine' WHEN 2 THEN 'Attic' WHEN 3 THEN 'Level 0' END AS level, CASE p_partkey % 7 WHEN 0 THEN 'Level 0' WHEN 1 THEN 'LEVEL 2' WHEN 2 THEN 'Attic' WHEN 3 THEN 'Mezzanine' END AS top_level FROM {_PARTS}""",
    "loaded_families": f"""SELECT job_id, CASE WHEN job_id % 5 <> 1 THEN 'RC Rect' END AS rect, CASE WHEN job_id % 5 NOT IN (1, 2) OR job_id % 10 = 1 THEN 'RC Round' END AS round FROM {_MODELS}""",
    "known_types": f"""SELECT job_id, CASE n_nationkey % 2 WHEN 0 THEN 'RC Rect' ELSE 'RC Round' END AS family, CASE n_nationkey % 3 WHEN 0 THEN concat(CAST(200 + 50 * (n_nationkey % 9) AS STRING), 'X', CAST(200 + 50 * (n_nationkey % 5) AS STRING), 'MM') ELSE concat(CAST(200 + 50 * (n_nationkey % 9) AS STRING), 'x', CAST(200 + 50 * (n_nationkey % 5) AS STRING), 'mm') END AS type_name
        FROM {{nation}} CROSS JOIN {_MODELS} WHERE job_id % 3 <> 2""",
    # Elements of all kinds in millimetres, with spans, sides and storeys too small to show; each ninth drawing has no element that shows.
    "scene_items": f"""SELECT job_id, p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'wall' WHEN 1 THEN 'column' WHEN 2 THEN 'door' WHEN 3 THEN 'window' WHEN 4 THEN 'slab' ELSE 'beam' END AS kind, CAST((p_partkey * 97) % 40000 AS DOUBLE) AS sx, CAST((p_partkey * 61) % 30000 AS DOUBLE) AS sy,
        CASE WHEN p_partkey % 4 <> 0 THEN CAST(3000 * (p_size % 3) AS DOUBLE) END AS sz, CAST((p_partkey * 97) % 40000 + CASE WHEN p_partkey % 11 = 0 OR job_id % 9 = 4 THEN 0 ELSE p_size * 90 END AS DOUBLE) AS ex, CAST((p_partkey * 61) % 30000 + CASE WHEN p_partkey % 11 = 0 OR job_id % 9 = 4 THEN 0 ELSE (p_partkey * 13) % 4000 END AS DOUBLE) AS ey,
        CASE WHEN p_size % 5 <> 0 THEN CAST(200 + 10 * p_size AS DOUBLE) END AS width, CASE WHEN p_size % 7 <> 0 THEN CAST(400 + 10 * p_size AS DOUBLE) END AS depth, CASE WHEN p_size % 3 <> 0 THEN CAST(2000 + 30 * p_size AS DOUBLE) END AS height, CASE WHEN p_partkey % 18 = 1 THEN 'circular' WHEN p_partkey % 18 = 7 THEN 'rectangular' END AS shape,
        CASE WHEN job_id % 9 = 4 THEN 'Level 2' WHEN p_partkey % 4 = 1 THEN 'Level 0' WHEN p_partkey % 4 = 3 THEN 'Mezzanine' END AS level, CASE WHEN job_id % 9 = 4 THEN 'Level 0' WHEN p_partkey % 8 = 1 THEN 'Attic' WHEN p_partkey % 8 = 3 THEN 'Level 2' WHEN p_partkey % 8 = 5 THEN 'Level 0' END AS top_level
        FROM {_PARTS} WHERE NOT (job_id % 9 = 4 AND p_partkey % 6 IN (2, 3))""",
    "families": """SELECT p_partkey AS ord, p_name AS family_name, p_type AS category, p_brand AS type_name, CAST(10 * p_size AS DOUBLE) AS width_mm, CAST(10 * (p_size % 37) AS DOUBLE) AS depth_mm,
        p_partkey % 4 <> 0 AS has_path FROM {part}""",
}


def text(name: str, spark: bool) -> str:
    """The SQL of a view, for Spark with table arguments or for DuckDB with table names."""
    sql = VIEWS[name]
    if spark:
        return sql
    for t in _TABLES:
        sql = sql.replace("{" + t + "}", t)
    return sql.replace(" AS STRING)", " AS VARCHAR)").replace("char(65", "chr(65").replace("char(10", "chr(10").replace("char(125", "chr(125")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; only the columns that a query uses are read."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if "{" + t + "}" in VIEWS[name]}
    return spark.sql(text(name, True), **used)


def with_views(sql: str, *names: str) -> str:
    """DuckDB SQL with the named views as common table expressions before it."""
    ctes = ", ".join(f"{n}_v AS ({text(n, False)})" for n in names)
    return f"WITH RECURSIVE {ctes} {sql}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {ctes}{sql}"
