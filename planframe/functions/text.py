"""Column expressions over labels and messages."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from planframe.functions.geometry import nearest
from planframe.options import DEFAULTS, ROUND_SIZES, SQUARE_SIZES, Options

# Fixed patterns of drawing labels and chat messages.
RECT = r"(\d{2,4})\s*[xX×*]\s*(\d{2,4})"
ROUND_FIRST = r"(?i)(?:Ø|⌀|∅|dia\.?\s*|phi\s*)(\d{2,4})"
ROUND_LAST = r"(\d{2,4})\s*[Ø⌀∅]"
MARK = r"\b([A-Z]{1,3}\d{1,3})\b"
BEAM_MARK = r"(?i)^(RCB|GB|SB|TB|FB|RB|SL|LB|L|B)\d"
TAG = r"^[A-Z]{1,3}[-]?[A-Z]{0,3}\d{1,3}[A-Z]?$"
# What names a material on a line of the legend, the tags on it, and slab zone codes.
CONCRETE = r"(?i)\b(RC|R\.?C\.?|REINFORCED[\s-]?CONCRETE|CONCRETE)\b"
STEEL = r"(?i)\b(STEEL|S\.?S\.?|UB|UC|H-?BEAM|UNIVERSAL)\b"
TAGS = r"\b([A-Z]{1,3}-?[A-Z]{0,3}\d{1,3}[A-Z]?)\b"
ZONE_CODE = r"(?i)^NSP\d+$"
SELF_CODE = r"(?i)^(\d{3})CIS$"
# What a page of schedules has beside marks.
SCHEDULE_SIZE = r"\d{2,4}\s*[xX×*]\s*\d{2,4}|[Ø⌀∅]"
ROW_LABEL = r"^[A-Za-z]{1,2}$"
COLUMN_LABEL = r"^\d{1,2}$"
DIMENSION = r"^\d{3,5}$"
ROUTES = (
    ("troubleshoot", r"(?i)\b(fail|error|wrong|broken|issue|problem|crash|why did|can't|cannot|not working|retry)\b"),
    ("status", r"(?i)\b(status|progress|how.*going|how.*long|eta|done|finish|complete|stage|current)\b"),
    ("technical", r"(?i)\b(what is|what does|explain|difference|gltf|rvt|revit|yolo|dpi|scale|vector|stage \d|track [ab]|fusion|semantic|geometry)\b"),
    ("admin", r"(?i)\b(queue|server|load|active jobs|how many|memory|cpu|uptime)\b"),
)
WARNINGS = (
    ("join_error", r"(?i)cannot (be )?kept? (elements )?joined|cannot keep.*joined|highlights elements whose.*join"),
    ("identical", r"(?i)identical.*instance|instance.*identical"),
    ("transient", r"(?i)ExternalEvent.*[Pp]ending|event.*rejected.*pending"),
    ("missing_family", r"(?i)unresolved references?|missing.*family|family.*not.*load"),
    ("short_column", r"(?i)column is too short|too short to"),
)


def portable(pattern: str) -> str:
    """A pattern so written that Java finds with it what RE2 (DuckDB) does: words of ASCII at \\b, any character but \\n at a dot, and all cases of k and s.

    Java's \\b takes accented letters as parts of words, and its dot stops at \\r too.
    """
    word = "[0-9A-Za-z_]"
    told = {r"\b": f"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))", ".": r"[^\n]"}
    if pattern.startswith("(?i)"):
        told |= dict.fromkeys("kK", "[kK\u212a]") | dict.fromkeys("sS", "[sS\u017f]")
    return re.sub(r"\\.|\[[^\]]*\]|[.kKsS]", lambda m: told.get(m[0], m[0]), pattern)


def first_match(text: Column, cases, default: str) -> Column:
    """The name of the first pattern that a text matches."""
    out = None
    for name, pattern in cases:
        hit = text.rlike(portable(pattern))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise(default)


def group(text: Column, pattern: str, k: int = 1) -> Column:
    """A group of the first match, or null without one."""
    return F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))


def mark(text: Column) -> Column:
    """The type mark of a label, or null."""
    return group(text, MARK)


def is_beam_label(text: Column) -> Column:
    return F.coalesce(mark(text).rlike(BEAM_MARK), F.lit(False))


def dims(text: Column) -> tuple[Column, Column, Column]:
    """(width, depth, circular) of a label, rectangular before circular; nulls without either."""
    w, d = group(text, RECT, 1).cast("double"), group(text, RECT, 2).cast("double")
    hit = F.least(F.nullif(F.regexp_instr(text, F.lit(ROUND_FIRST)), F.lit(0)), F.nullif(F.regexp_instr(text, F.lit(ROUND_LAST)), F.lit(0)))
    before = F.nullif(F.regexp_instr(text, F.lit(ROUND_FIRST)), F.lit(0)) == hit
    c = F.when(before, group(text, ROUND_FIRST)).otherwise(group(text, ROUND_LAST)).cast("double")
    return F.coalesce(w, c), F.coalesce(d, c), F.when(w.isNotNull(), False).when(c.isNotNull(), True)


def code_thickness(code: Column, legend: Column) -> Column:
    """Thickness of a zone code: ddd before CIS says it itself, else the legend's (null without)."""
    return F.coalesce(group(code, SELF_CODE).cast("double"), legend)


def normal_dims(width: Column, depth: Column, shape: Column, ann_w: Column, ann_d: Column, options: Options = DEFAULTS) -> Column:
    """struct(width, depth, suffix): column sizes brought to standard ones, annotated sizes first."""
    square = F.array(*[F.lit(float(v)) for v in SQUARE_SIZES])
    round_ = F.array(*[F.lit(float(v)) for v in ROUND_SIZES])
    fifty = lambda v: F.bround(v / 50) * 50
    gap = F.abs(ann_w - ann_d)
    one = (
        F.when(shape == "circular", nearest(round_, F.greatest(ann_w, ann_d)))
        .when(shape == "square", nearest(square, (ann_w + ann_d) / 2))
        .when((shape == "rectangular") & (gap <= 100), nearest(square, (ann_w + ann_d) / 2))
    )
    a_w = F.coalesce(one, F.when(shape == "rectangular", fifty(ann_w)).otherwise(ann_w))
    a_d = F.coalesce(one, F.when(shape == "rectangular", fifty(ann_d)).otherwise(ann_d))
    annotated = ann_w.isNotNull() & ann_d.isNotNull() & (a_w > 0) & (a_d > 0)
    near = F.abs(a_w - a_d) < 10
    a_w, a_d = F.when(near, F.greatest(a_w, a_d)).otherwise(a_w), F.when(near, F.greatest(a_w, a_d)).otherwise(a_d)
    aspect = F.when((width > 0) & (depth > 0), F.least(width, depth) / F.greatest(width, depth)).otherwise(1.0)
    squarish = (shape == "square") | (1.0 - aspect <= options.square_aspect)
    bare = F.when(shape == "circular", nearest(round_, F.greatest(width, depth))).when(squarish, nearest(square, (width + depth) / 2))
    w = F.when(annotated, a_w).otherwise(F.coalesce(bare, fifty(width)))
    d = F.when(annotated, a_d).otherwise(F.coalesce(bare, fifty(depth)))
    size = lambda v: v.cast("long").cast("string")
    rect = F.concat(F.lit("RECT"), size(F.least(w, d)), F.lit("x"), size(F.greatest(w, d)), F.lit("mm"))
    suffix = F.when(~annotated & (shape == "circular"), F.concat(F.lit("CIRC"), size(w))).otherwise(rect)
    return F.struct(w.alias("width"), d.alias("depth"), suffix.alias("suffix"))


def sized_type(width_mm: Column, depth_mm: Column) -> Column:
    """The name of a type by its sides to the nearest 50 mm."""
    side = lambda v: (F.bround(v / 50) * 50).cast("long").cast("string")
    return F.concat(side(width_mm), F.lit("x"), side(depth_mm), F.lit("mm"))


def feet(mm: Column) -> Column:
    return mm / 304.8


def millimetres(ft: Column) -> Column:
    """Feet in millimetres, to one decimal."""
    return F.bround(ft * 304.8, 1)


def parameter(value: Column, kind: Column) -> Column:
    """struct(number, text): a parameter's value as its kind asks for: mm in feet, raw, int and id as numbers, string as text; null for another kind."""
    number = value.try_cast("double")
    n = F.when(kind == "mm", feet(number)).when(kind == "raw", number).when(kind.isin("int", "id"), F.floor(number).cast("double"))
    return F.struct(n.alias("number"), F.when(kind == "string", value).alias("text"))


def is_join_error(text: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains("cannot keep") | (low.contains("element") & low.contains("join"))


def tag_join(text: Column, element_ids: Column) -> Column:
    """A join message with the elements that were taken apart; other messages as they are."""
    return F.when(is_join_error(text), F.concat(F.lit("[JOIN-RESOLVED:"), F.array_join(element_ids.cast("array<string>"), ","), F.lit("] "), text)).otherwise(text)


def crop(cx: Column, cy: Column, width: Column, height: Column, img_w: Column, img_h: Column) -> Column:
    """struct(x0, y0, x1, y1): a window around a box, two and a half of its sides (50 px at least) beyond it, cut to the image; null under 20 px."""
    w, h = F.greatest(F.abs(width), F.lit(50.0)), F.greatest(F.abs(height), F.lit(50.0))
    pad = F.greatest(w, h) * 2.5
    low = lambda c, s: F.greatest(F.lit(0), (c - s / 2 - pad).cast("int"))
    high = lambda c, s, m: F.least(m.cast("int"), (c + s / 2 + pad).cast("int"))
    x0, y0, x1, y1 = low(cx, w), low(cy, h), high(cx, w, img_w), high(cy, h, img_h)
    return F.when((x1 - x0 >= 20) & (y1 - y0 >= 20), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))
