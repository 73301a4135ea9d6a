"""The family library: filter, score and rank; names to shapes and sizes."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.functions.text import first_match
from planframe.options import DEFAULTS, Options


def search(families: DataFrame, category: str | None, keyword: str | None) -> DataFrame:
    """Families of the category (any case) whose name, tags or type names hold the keyword.

    ``families(family_name, category, tags array<string>, types array<struct<type_name,...>>)``. Tags are
    compared as they are, names and type names in lower case. A null or empty argument filters nothing.
    """
    out = families
    if category:
        out = out.where(F.lower(F.coalesce("category", F.lit(""))) == category.lower())
    if keyword:
        kw = keyword.lower()
        in_types = F.exists(F.coalesce("types", F.array()), lambda t: F.lower(F.coalesce(t["type_name"], F.lit(""))).contains(kw))
        in_tags = F.exists(F.coalesce("tags", F.array()), lambda t: t.contains(kw))
        out = out.where(F.lower(F.coalesce("family_name", F.lit(""))).contains(kw) | in_tags | in_types)
    return out


def score(category: str | None, keyword: str | None) -> Column:
    """Relevance: category 4, name 3 as a word or 1.5 within, a tag 1, a type name 2, sizes up to 2, no path -1."""
    kw = (keyword or "").lower().strip()
    total = F.lit(0.0)
    if category:
        total = total + F.when(F.lower("category") == category.lower(), 4.0).otherwise(0.0)
    if kw:
        name = F.lower(F.coalesce("family_name", F.lit("")))
        total = total + F.when(name.rlike(rf"\b{re.escape(kw)}\b"), 3.0).when(name.contains(kw), 1.5).otherwise(0.0)
        total = total + F.when(F.exists("tags", lambda t: F.lower(t).contains(kw)), 1.0).otherwise(0.0)
        total = total + F.when(F.exists("types", lambda t: F.lower(F.coalesce(t["type_name"], F.lit(""))).contains(kw)), 2.0).otherwise(0.0)
    nums = sorted((float(n) for n in re.findall(r"\d+", kw)[:2]), reverse=True)
    if nums:
        first = float(re.findall(r"\d+", kw)[0])

        def near(t: Column) -> Column:
            w, d = t["width_mm"], t["depth_mm"]
            both = F.abs(F.lit(nums[0]) - F.greatest(w, d)) + F.abs(F.lit(nums[-1]) - F.least(w, d)) if len(nums) > 1 else F.lit(None)
            one = F.least(F.abs(w - first), F.abs(d - first))
            err = F.when(w.isNotNull() & d.isNotNull(), F.coalesce(both, one)).otherwise(one)
            return F.coalesce(F.greatest(F.lit(0.0), 2.0 - err / 500.0), F.lit(0.0))

        total = total + F.coalesce(F.greatest(F.lit(0.0), F.array_max(F.transform("types", near))), F.lit(0.0))
    return total - F.when(F.col("has_path"), 0.0).otherwise(1.0)


def ranked(families: DataFrame, category: str | None, keyword: str | None, options: Options = DEFAULTS) -> DataFrame:
    """The best families, best first, earlier ones first among equals: a top-k that the query asks for."""
    hits = search(families, category, keyword).withColumn("score", score(category, keyword))
    return hits.orderBy(F.desc("score"), "ord").limit(options.search_rows)


def search_total(families: DataFrame, category: str | None, keyword: str | None) -> DataFrame:
    """One row, (total): how many families match, before the best are taken."""
    return search(families, category, keyword).agg(F.count(F.lit(1)).alias("total"))


# Fixed patterns of family file names, tried in this order; the first that a name holds decides.
SHAPES = (
    ("circular", r"(?i)round|circ|chs|hollow\s*section|∅|dia"),
    ("rectangular", r"(?i)rect|square|rectangular"),
    ("I-section", r"(?i)\buc\b|\bub\b|\bi\s*section|ipea?|hea?|heb?"),
    ("rectangular_hollow", r"(?i)rhs|shs|hollow"),
)
MATERIALS = (
    ("concrete", r"(?i)concrete|beton|RC"),
    ("steel", r"(?i)steel|UC|UB|CHS|RHS|SHS|HEA|HEB|IPE|UPE"),
    ("timber", r"(?i)timber|wood|glulam|CLT"),
    ("masonry", r"(?i)masonry|brick|block|CMU"),
    ("aluminium", r"(?i)alumin"),
)
CATEGORIES = (
    ("OST_StructuralColumns", r"(?i)column|pillar|col_"),
    ("OST_StructuralFraming", r"(?i)beam|framing|girder|rafter|joist"),
    ("OST_Doors", r"(?i)\bdoor\b"),
    ("OST_Windows", r"(?i)\bwindow\b|\bglaz"),
    ("OST_Floors", r"(?i)\bfloor\b|\bslab\b"),
    ("OST_Walls", r"(?i)\bwall\b"),
)
#: What a folder says of the families in it (category, placement, tags).
FOLDERS = {
    "structural_columns": ("OST_StructuralColumns", "column", ("column", "structural")),
    "structural_framing": ("OST_StructuralFraming", "beam", ("beam", "structural", "framing")),
    "walls": ("OST_Walls", "wall", ("wall",)),
    "doors": ("OST_Doors", "hosted", ("door", "opening")),
    "windows": ("OST_Windows", "hosted", ("window", "opening", "glazing")),
    "floors": ("OST_Floors", "floor", ("floor", "slab")),
    "ceilings": ("OST_Ceilings", "ceiling", ("ceiling",)),
    "roofs": ("OST_Roofs", "roof", ("roof",)),
    "generic_models": ("OST_GenericModel", "point", ()),
}
#: Parts of a file name that hint at a category.
HINTS = {
    "ost_structuralcolumns": ("column", "col"),
    "ost_structuralframing": ("beam", "framing", "uc", "ub", "rhs", "chs"),
    "ost_doors": ("door",),
    "ost_windows": ("window",),
    "ost_walls": ("wall",),
    "ost_floors": ("floor", "slab"),
}
DIAMETER = r"(?i)(?:Ø|⌀|∅|dia\.?\s*|phi\s*)(\d{2,4})|(\d{2,4})\s*[Ø⌀∅]"
HOLLOW = r"(?i)CHS[_\-]?(\d{2,4})[xX×](\d{1,3})"
SIDES = r"(\d{2,4})[xX×](\d{2,4})"


TYPES = "array<struct<type_name:string,is_circular:boolean,width_mm:double,depth_mm:double,diameter_mm:double,thickness_mm:double>>"


def infer(names: DataFrame) -> DataFrame:
    """``names(name)`` with ``shape``, ``material`` and ``types``: what a family's file name tells; rectangular and concrete where it tells nothing.

    A type is (type_name, is_circular, width_mm, depth_mm, diameter_mm, thickness_mm): one of a diameter, else one of
    a hollow section, else one for each pair of sides.
    """
    n = F.col("name")
    group = lambda pattern, k: F.nullif(F.regexp_extract(n, pattern, k), F.lit(""))
    whole = lambda v: v.cast("long").cast("string")
    none = F.lit(None).cast("double")

    def kind(name: Column, circular: bool, w: Column, d: Column, dia: Column, t: Column) -> Column:
        return F.struct(name.alias("type_name"), F.lit(circular).alias("is_circular"), w.alias("width_mm"), d.alias("depth_mm"), dia.alias("diameter_mm"), t.alias("thickness_mm"))

    dia = F.coalesce(group(DIAMETER, 1), group(DIAMETER, 2)).cast("double")
    outer, wall = group(HOLLOW, 1).cast("double"), group(HOLLOW, 2).cast("double")
    w, d = F.regexp_extract_all(n, F.lit(SIDES), 1), F.regexp_extract_all(n, F.lit(SIDES), 2)
    sides = F.zip_with(w, d, lambda a, b: kind(F.concat(whole(a.cast("double")), F.lit("×"), whole(b.cast("double")), F.lit("mm")), False, a.cast("double"), b.cast("double"), none, none))
    types = F.when(dia.isNotNull(), F.array(kind(F.concat(F.lit("Ø"), whole(dia)), True, none, none, dia, none)))
    types = types.when(outer.isNotNull(), F.array(kind(F.concat(F.lit("CHS "), whole(outer), F.lit("×"), whole(wall)), True, none, none, outer, wall))).otherwise(sides)
    return names.withColumns({"shape": first_match(n, SHAPES, "rectangular"), "material": first_match(n, MATERIALS, "concrete"), "types": types})


def records(files: DataFrame) -> DataFrame:
    """``files(name, folder)`` with category, placement, shape, material, sorted tags and types, by folder and else by name."""
    known = F.create_map(*[v for k, (c, p, tags) in FOLDERS.items() for v in (F.lit(k), F.struct(F.lit(c).alias("category"), F.lit(p).alias("placement"), F.array(*[F.lit(t) for t in tags]).cast("array<string>").alias("tags")))])
    told = F.try_element_at(known, F.lower("folder"))
    out = infer(files).withColumn("_told", told)
    category = F.coalesce("_told.category", first_match(F.col("name"), CATEGORIES, "OST_GenericModel"))
    tags = F.array_sort(F.array_union(F.coalesce("_told.tags", F.array().cast("array<string>")), F.array("material", "shape")))
    return out.withColumns({"category": category, "placement": F.coalesce("_told.placement", F.lit("point")), "tags": tags}).drop("_told")


def scan(binaries: DataFrame, sidecars: DataFrame) -> DataFrame:
    """The family index of ``binaries(path, stem, folder)`` and ``sidecars(path, stem, folder, content)``, by category and name.

    (path, family_name, category, placement, shape, material, tags, types, rfa_local, sidecar, extra). A sidecar beside its binary
    wins over what the name tells: its tags are added, its types and other fields replace. A sidecar whose stem (in any case)
    no binary has is a record of its own; its missing fields come from its name. ``extra`` holds its other fields. A sidecar
    that is no JSON object counts as not there.
    """
    fields = ("family_name", "category", "placement", "shape", "material", "tags", "types")
    schema = f"family_name string, category string, placement string, shape string, material string, tags array<string>, types {TYPES}"
    parsed = sidecars.where("lower(stem) <> 'index'").withColumns({"_s": F.from_json("content", schema), "_all": F.from_json("content", "map<string,string>")})
    parsed = parsed.where("_all is not null").withColumn("extra", F.map_filter("_all", lambda k, _: ~k.isin(*fields, "path"))).drop("_all")
    named = lambda df: records(df.withColumn("name", F.col("stem")))
    beside = parsed.select("folder", "stem", "_s", "extra")
    own = named(binaries).join(beside, ["folder", "stem"], "left")
    pick = lambda c: F.coalesce(F.col(f"_s.{c}"), F.col(c)).alias(c)
    tags = F.array_sort(F.array_union("tags", F.coalesce("_s.tags", F.array().cast("array<string>")))).alias("tags")
    own = own.select("path", F.coalesce("_s.family_name", "stem").alias("family_name"), pick("category"), pick("placement"), pick("shape"), pick("material"), tags, pick("types"), F.lit(True).alias("rfa_local"), F.col("extra").isNotNull().alias("sidecar"), "extra")
    rest = named(uncovered_sidecars(binaries, parsed).select("path", "stem", "folder", "_s", "extra"))
    base = F.try_element_at(F.create_map(*[v for k, (_, _, t) in FOLDERS.items() for v in (F.lit(k), F.array(*[F.lit(x) for x in t]).cast("array<string>"))]), F.lower("folder"))
    rest = rest.select("path", F.coalesce("_s.family_name", "stem").alias("family_name"), pick("category"), pick("placement"), pick("shape"), pick("material"), F.array_sort(F.coalesce("_s.tags", base, F.array().cast("array<string>"))).alias("tags"), F.coalesce(F.col("_s.types"), F.array().cast(TYPES)).alias("types"), F.lit(False).alias("rfa_local"), F.lit(True).alias("sidecar"), "extra")
    return own.unionByName(rest).orderBy("category", "family_name", "path")


def match_files(paths: DataFrame, category: str | None, keyword: str | None, options: Options = DEFAULTS) -> DataFrame:
    """(ord, family_name, path) of the first family files ``(ord, path)`` whose name holds a hint at the category and the keyword."""
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace("path", r"\\", "/"), r"([^/]*)/*$", 1), r"(?i)\.rfa$", "")
    rows = paths.select("ord", stem.alias("family_name"), "path")
    name = F.lower("family_name")
    hints = HINTS.get((category or "").lower(), ())
    if hints:
        rows = rows.where(F.greatest(*[name.contains(h).cast("int") for h in hints], F.lit(0)) == 1)
    if keyword:
        rows = rows.where(name.contains(keyword.lower()))
    return rows.orderBy("ord").limit(options.search_rows)


#: Words of a loaded family's name, and beginnings of it, that tell what it is.
UNIVERSAL_COLUMN = ("UNIVERSAL", "COLUMN")
UNIVERSAL_STARTS = ("UC-", "UC_")
STEEL_SECTIONS = ("UC-", "UB-", "UNIVERSAL", "I-BEAM", "WIDE FLANGE", "W-SHAPE")
CONCRETE_WORDS = ("CONCRETE", "RC ", "CJY", "CAST-IN-PLACE")
COLUMN_WORDS = ("COLUMN", "RECTANGULAR", "ROUND", "CIRCULAR")
STEEL_BEAMS = ("STEEL", "I BEAM", "I-BEAM", "W-SHAPE", "WIDE FLANGE", "UB-", "UC-", "PURLIN", "L-ANGLE", "L ANGLE")
STEEL_BEAM_STARTS = ("UB ", "UC ")


def family_kind(name: Column) -> Column:
    """struct(steel_column, concrete_column, steel_beam): what the name of a loaded family says it is."""
    n = F.upper(F.coalesce(name, F.lit("")))
    holds = lambda words: F.greatest(*[n.contains(w).cast("int") for w in words], F.lit(0)) == 1
    starts = lambda words: F.greatest(*[n.startswith(w).cast("int") for w in words], F.lit(0)) == 1
    steel_column = (n.contains(UNIVERSAL_COLUMN[0]) & n.contains(UNIVERSAL_COLUMN[1])) | starts(UNIVERSAL_STARTS)
    concrete = ~holds(STEEL_SECTIONS) & holds(CONCRETE_WORDS) & holds(COLUMN_WORDS)
    steel_beam = holds(STEEL_BEAMS) | starts(STEEL_BEAM_STARTS)
    return F.struct(steel_column.alias("steel_column"), concrete.alias("concrete_column"), steel_beam.alias("steel_beam"))


def uncovered_sidecars(binaries: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars whose lower-case stem no binary has."""
    return sidecars.join(binaries.select(F.lower("stem").alias("_stem")).distinct(), F.lower("stem") == F.col("_stem"), "left_anti")
