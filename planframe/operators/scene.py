"""The scene of a drawing: boxes and cylinders of its elements as vertex and index buffers, y upwards."""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sides of a round column's rim.
SECTIONS = 32

#: Depths of openings, sizes of elements that have none, and the box of an empty scene, in mm.
DOOR_MM, WINDOW_MM = 100.0, 50.0
SIZES = {"wall": (200.0, 2800.0), "column": (300.0, 300.0, 2800.0), "opening": (900.0, 2100.0), "slab": 200.0, "beam": (200.0, 800.0)}
PLACEHOLDER = (1000.0, 1000.0, 1.0)

#: Red, green, blue and opacity of each kind.
COLOURS = {
    "wall": (200, 200, 200, 255),
    "column": (150, 150, 150, 255),
    "door": (139, 90, 43, 255),
    "window": (135, 206, 235, 200),
    "slab": (220, 210, 190, 255),
    "beam": (90, 75, 60, 255),
    "placeholder": (180, 180, 180, 255),
}

#: The order of kinds in a scene.
KINDS = tuple(COLOURS)

_SOLID = ("job_id", "kind", "ord", "round", "cx", "cy", "cz", "dx", "dy", "dz", "angle")


def _or(c: str, default: float) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(default))


def _solid(df: DataFrame, kind: str, centre: tuple, sides: tuple, angle: Column | None = None, round_: Column | None = None) -> DataFrame:
    values = (F.lit(kind), F.col("ord"), F.lit(False) if round_ is None else F.coalesce(round_, F.lit(False)), *centre, *sides, F.lit(0.0) if angle is None else angle)
    out = df.select("job_id", *[v.alias(n) for v, n in zip(values, _SOLID[1:], strict=True)])
    return out.where(" and ".join(f"{c} is not null" for c in _SOLID[3:]))


def _along(df: DataFrame, kind: str, width: Column, height: Column, z: Column) -> DataFrame:
    """Boxes along the axes sx, sy to ex, ey; spans under 1 mm have none."""
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    centre = ((F.col("sx") + F.col("ex")) / 2, (F.col("sy") + F.col("ey")) / 2, z)
    return _solid(df.where(F.hypot(dx, dy) >= 1), kind, centre, (F.hypot(dx, dy), width, height), F.atan2(dy, dx))


def walls(df: DataFrame) -> DataFrame:
    """Solids of ``(job_id, ord, sx, sy, ex, ey, thickness, height)``, standing on the ground."""
    w, h = SIZES["wall"]
    return _along(df, "wall", _or("thickness", w), _or("height", h), _or("height", h) / 2)


def beams(df: DataFrame) -> DataFrame:
    """Solids of ``(job_id, ord, sx, sy, sz, ex, ey, width, depth)``, hanging from the height of their start."""
    w, d = SIZES["beam"]
    return _along(df, "beam", _or("width", w), _or("depth", d), _or("sz", 0.0) - _or("depth", d) / 2)


def columns(df: DataFrame, levels: DataFrame) -> DataFrame:
    """Solids of ``(job_id, ord, x, y, width, depth, height, shape, level, top_level)`` between the levels ``(job_id, level, elevation)``.

    A base level that is not there is at 0; a top that is not there is ``height`` above the base. None under the base.
    """
    w, d, h = SIZES["column"]
    at = lambda p: levels.groupBy("job_id", F.col("level").alias(f"_{p}")).agg(F.max("elevation").cast("double").alias(p))
    rows = df.withColumns({"_base": F.coalesce("level", F.lit("Level 0")), "_top": F.coalesce("top_level", F.lit("Level 1"))})
    rows = rows.join(at("base"), ["job_id", "_base"], "left").join(at("top"), ["job_id", "_top"], "left")
    base = F.coalesce("base", F.lit(0.0))
    tall = F.coalesce(F.col("top") - base, _or("height", h))
    width = _or("width", w)
    round_ = F.col("shape") == "circular"
    rows = rows.where(tall > 0)
    depth = F.when(F.coalesce(round_, F.lit(False)), width).otherwise(_or("depth", d))
    return _solid(rows, "column", (F.col("x"), F.col("y"), base + tall / 2), (width, depth, tall), round_=round_)


def openings(df: DataFrame) -> DataFrame:
    """Solids of doors and windows ``(job_id, ord, kind, x, y, z, width, height)``."""
    w, h = SIZES["opening"]
    made = [
        _solid(df.where(F.col("kind") == kind), kind, (F.col("x"), F.col("y"), _or("z", 0.0) + _or("height", h) / 2), (_or("width", w), F.lit(depth), _or("height", h)))
        for kind, depth in (("door", DOOR_MM), ("window", WINDOW_MM))
    ]
    return made[0].unionByName(made[1])


def slabs(df: DataFrame) -> DataFrame:
    """Solids of ``(job_id, ord, points, thickness, elevation)``: the bounds of three points or more, at least 1 mm wide and deep, below their elevation."""
    x0, x1, y0, y1 = (f(f"points.{a}") for a in "xy" for f in (F.array_min, F.array_max))
    thick = _or("thickness", SIZES["slab"])
    rows = df.where((F.size("points") >= 3) & (x1 - x0 >= 1) & (y1 - y0 >= 1))
    return _solid(rows, "slab", ((x0 + x1) / 2, (y0 + y1) / 2, _or("elevation", 0.0) - thick / 2), (x1 - x0, y1 - y0, thick))


def with_placeholder(job_ids: DataFrame, solids: DataFrame) -> DataFrame:
    """``solids`` and, for each job that has none, a plate."""
    bare = job_ids.select("job_id").distinct().join(solids.select("job_id").distinct(), "job_id", "left_anti").withColumn("ord", F.lit(0).cast("long"))
    zero = F.lit(0.0)
    return solids.unionByName(_solid(bare, "placeholder", (zero, zero, zero), tuple(F.lit(s) for s in PLACEHOLDER)))


#: Corners of a box as halves of its sides, x fastest, and the rim of a cylinder as shares of its sides: a centre and a ring below, then above.
_BOX = [(x, y, z) for z in (-0.5, 0.5) for y in (-0.5, 0.5) for x in (-0.5, 0.5)]
_ROUND = [p for z in (-0.5, 0.5) for p in [(0.0, 0.0, z), *((math.cos(2 * math.pi * k / SECTIONS) / 2, math.sin(2 * math.pi * k / SECTIONS) / 2, z) for k in range(SECTIONS))]]


def _box_faces() -> list[tuple[int, int, int]]:
    """Two triangles a side, seen from outside counter-clockwise; corner number = x + 2 y + 4 z."""
    out = []
    for axis in range(3):
        u, v = 1 << (axis + 1) % 3, 1 << (axis + 2) % 3
        for far in (0, 1):
            a = far << axis
            quad = (a, a + u, a + u + v, a + v) if far else (a, a + v, a + u + v, a + u)
            out += [(quad[0], quad[1], quad[2]), (quad[0], quad[2], quad[3])]
    return out


def _round_faces() -> list[tuple[int, int, int]]:
    out, n = [], SECTIONS + 1
    for k in range(SECTIONS):
        a, b = 1 + k, 1 + (k + 1) % SECTIONS
        out += [(0, b, a), (n, n + a, n + b), (a, b, n + b), (a, n + b, n + a)]
    return out


def _table(rows: list[tuple], names: tuple[str, ...], kind: str) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast(kind).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])


def vertices(solids: DataFrame) -> DataFrame:
    """(job_id, kind, ord, v, x, y, z): the corners of each solid, turned about its upright axis and moved to its place; y is up."""
    shape = F.when(F.col("round"), _table(_ROUND, ("px", "py", "pz"), "double")).otherwise(_table(_BOX, ("px", "py", "pz"), "double"))
    rows = solids.select(*_SOLID, F.posexplode(shape).alias("v", "p"))
    lx, ly = F.col("p.px") * F.col("dx"), F.col("p.py") * F.col("dy")
    x = F.col("cx") + lx * F.cos("angle") - ly * F.sin("angle")
    y = F.col("cy") + lx * F.sin("angle") + ly * F.cos("angle")
    z = F.col("cz") + F.col("p.pz") * F.col("dz")
    return rows.select("job_id", "kind", "ord", "v", x.alias("x"), z.alias("y"), (F.lit(0.0) - y).alias("z"))


def parts(solids: DataFrame) -> DataFrame:
    """(job_id, kind, ord, first_vertex, n_vertices, first_face, n_faces, colour): where each solid lies in its scene's buffers, by kind and ord."""
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    n = lambda table: F.when(F.col("round"), len(table[1])).otherwise(len(table[0])).cast("long")
    rows = solids.withColumns({"n_vertices": n((_BOX, _ROUND)), "n_faces": n((_box_faces(), _round_faces())), "_rank": rank})
    before = Window.partitionBy("job_id").orderBy("_rank", "ord").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    colours = F.create_map(*[x for k, c in COLOURS.items() for x in (F.lit(k), F.array(*[F.lit(v) for v in c]))])
    return rows.select("job_id", "kind", "ord", start("n_vertices").alias("first_vertex"), "n_vertices", start("n_faces").alias("first_face"), "n_faces", colours[F.col("kind")].alias("colour"))


def faces(solids: DataFrame) -> DataFrame:
    """(job_id, face, a, b, c): triangles by the numbers of their corners in the scene's vertex buffer."""
    shape = F.when(F.col("round"), _table(_round_faces(), ("a", "b", "c"), "long")).otherwise(_table(_box_faces(), ("a", "b", "c"), "long"))
    rows = parts(solids).join(solids.select("job_id", "kind", "ord", "round"), ["job_id", "kind", "ord"])
    rows = rows.select("job_id", "first_vertex", "first_face", F.posexplode(shape).alias("f", "t"))
    at = lambda c: (F.col("first_vertex") + F.col(f"t.{c}")).alias(c)
    return rows.select("job_id", (F.col("first_face") + F.col("f")).alias("face"), at("a"), at("b"), at("c"))
