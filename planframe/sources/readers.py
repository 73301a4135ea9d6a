"""Sources and sinks: typed JSON and Parquet tables of drawings, files by listing, recipes by job."""

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planframe.binning import ranked

SCHEMAS = {
    "page_meta": "job_id long, x0 double, y0 double, x1 double, y1 double, rotation int, dpi double, width_px int, height_px int",
    "paths": "job_id long, path_ord long, type string, rect struct<x0:double,y0:double,x1:double,y1:double>, dashes string, width double, items array<struct<op:string,pts:array<struct<x:double,y:double>>>>",
    "spans": "job_id long, span_ord long, text string, bbox struct<x0:double,y0:double,x1:double,y1:double>, size double, font string",
    "words": "job_id long, word_ord long, x0 double, y0 double, x1 double, y1 double, text string, block_no int, line_no int",
    "detections": "job_id long, ord long, id string, type string, x1 double, y1 double, x2 double, y2 double, confidence double",
    "grid_lines": "job_id long, axis string, idx long, px double, label string",
    "families": "path string, family_name string, category string, placement string, shape string, material string, tags array<string>, types array<struct<type_name:string,is_circular:boolean,width_mm:double,depth_mm:double,diameter_mm:double>>",
    "corrections": "id long, ts timestamp_ntz, job_id string, element_type string, element_index int, original_element string, changes string, is_delete boolean",
    "pipeline_events": "job_id string, event string, ts timestamp, payload string",
}


def read(spark: SparkSession, kind: str, path: str, form: str = "json") -> DataFrame:
    """A table of a known kind; a malformed record is a row of nulls."""
    return spark.read.schema(SCHEMAS[kind]).format(form).load(path)


def stream(spark: SparkSession, kind: str, path: str, form: str = "json", files: int = 100) -> DataFrame:
    """The same as a stream of files, so many to a batch."""
    return spark.readStream.schema(SCHEMAS[kind]).format(form).option("maxFilesPerTrigger", files).load(path)


def uploads(spark: SparkSession, path: str, most: int = 100 * 1024 * 1024) -> DataFrame:
    """(path, length, status) of files: pdf, too_large or not_pdf by the first bytes."""
    files = spark.read.format("binaryFile").load(path)
    status = F.when(F.col("length") > most, "too_large").when(F.substring("content", 1, 4) == F.lit(b"%PDF"), "pdf").otherwise("not_pdf")
    return files.select("path", "length", status.alias("status"))


def path_items(paths: DataFrame) -> DataFrame:
    """(job_id, path_ord, item_ord, op, x, y): the last point of each item of each path."""
    each = paths.select("job_id", "path_ord", F.posexplode("items").alias("item_ord", "item"))
    last = F.element_at("item.pts", -1)
    return each.select("job_id", "path_ord", "item_ord", F.col("item.op").alias("op"), last["x"].alias("x"), last["y"].alias("y"))


#: The resolutions that are tried, best first, and the bounds of a page.
DPI_LADDER = (300, 250, 200, 150, 125, 100, 72)
MOST_PIXELS, MOST_MB, MOST_FILE_MB, MOST_INCHES, MOST_ASPECT, MOST_OBJECTS = 100_000_000, 600.0, 100.0, 60.0, 4.0, 200


def render_dpi(width_in: float, height_in: float, most_pixels: int = MOST_PIXELS, most_mb: float = MOST_MB) -> int | None:
    """The first of the fixed resolutions at which a page fits both bounds; none: null."""
    for dpi in DPI_LADDER:
        pixels = width_in * dpi * height_in * dpi
        if pixels <= most_pixels and pixels * 3 * 1.5 / 2**20 <= most_mb:
            return dpi
    return None


def picture_mb(width_in: Column, height_in: Column, dpi: Column) -> Column:
    """The estimated megabytes of a page rendered in three colours."""
    return width_in * dpi * height_in * dpi * 3 * 1.5 / 2**20


def safe_dpi(width_in: Column, height_in: Column) -> Column:
    """``render_dpi`` as a column."""
    fits = lambda d: (width_in * d * height_in * d <= MOST_PIXELS) & (picture_mb(width_in, height_in, d) <= MOST_MB)
    return F.try_element_at(F.filter(F.array(*[F.lit(d) for d in DPI_LADDER]), fits), F.lit(1))


def capped_dpi(width_in: Column, height_in: Column, dpi: int = 150) -> Column:
    """``dpi`` where a page stays within the pixels allowed at it, else the highest resolution that does, 72 at least."""
    most = F.floor(F.sqrt(F.lit(float(MOST_PIXELS)) / (width_in * height_in))).cast("int")
    return F.when(width_in * dpi * height_in * dpi > MOST_PIXELS, F.greatest(F.lit(72), most)).otherwise(dpi)


def render_plan(pages: DataFrame) -> DataFrame:
    """``pages(width_in, height_in, file_mb, objects)`` with ``error``, ``method`` and ``dpi``: how each is to be rendered.

    Errors, in the order they are tried: too_large, too_wide, too_long (beyond the aspect allowed). A page that no resolution
    fits is tiled at 72, one with many embedded objects at its own; others are rendered directly.
    """
    w, h = F.col("width_in"), F.col("height_in")
    short, long_ = F.least(w, h), F.greatest(w, h)
    error = F.when(F.col("file_mb") > MOST_FILE_MB, "too_large").when(long_ > MOST_INCHES, "too_wide").when((short > 0) & (long_ / short > MOST_ASPECT), "too_long")
    dpi = safe_dpi(w, h)
    tiled = dpi.isNull() | (F.col("objects") > MOST_OBJECTS)
    ok = error.isNull()
    return pages.withColumns({"error": error, "method": F.when(ok, F.when(tiled, "tiled").otherwise("direct")), "dpi": F.when(ok, F.coalesce(dpi, F.lit(72)))})


def family_files(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The family binaries (path, stem, folder) and sidecars (path, stem, folder, content) anywhere below ``root``; binaries are listed, not read."""
    listed = lambda glob: spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    stem, folder = F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1), F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    binaries = listed("*.rfa").select("path", stem.alias("stem"), folder.alias("folder"))
    sidecars = listed("*.json").select("path", stem.alias("stem"), folder.alias("folder"), F.col("content").cast("string").alias("content"))
    return binaries, sidecars


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest rows (kind, entry) of a JSON file, or none where it is not there."""
    schema = "kind string, entry string"
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def text_blocks(spans: DataFrame) -> DataFrame:
    """(job_id, ord, text, x0, y0, x1, y1) of ``spans(job_id, span_ord, text, bbox)`` that hold more than blanks."""
    return spans.where(F.trim("text") != "").select("job_id", F.col("span_ord").alias("ord"), F.trim("text").alias("text"), "bbox.*")


def tiles(spark: SparkSession, pages: DataFrame, side: int = 2000) -> DataFrame:
    """(job_id, tx, ty): the tiles of pages ``(job_id, width_px, height_px)``, row by row."""
    n = lambda c: F.greatest(F.ceil(F.col(c) / side), F.lit(1)).cast("int")
    rows = pages.withColumn("ty", F.explode(F.sequence(F.lit(0), n("height_px") - 1)))
    return rows.withColumn("tx", F.explode(F.sequence(F.lit(0), n("width_px") - 1))).select("job_id", "tx", "ty")


def write_recipes(recipes: DataFrame, path: str) -> None:
    """Nested recipes as JSON, a folder for each job."""
    recipes.write.mode("overwrite").partitionBy("job_id").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Adds rows to a JSON table: corrections, traces and session logs grow by appending."""
    rows.write.mode("append").json(path)


def write_index(families: DataFrame, path: str) -> None:
    """The family index as one ordered JSON file with its total and version.

    Families are numbered by ranges of their order and written a line each between the file's first and last line, so that no
    row holds the library; the one file is written as a stream of those lines.
    """
    families = families.withColumns({c: F.to_json(c) for c, kind in families.dtypes if kind.startswith("map")})  # maps have no order
    names = ["category", "family_name", *[c for c in families.columns if c not in ("category", "family_name")]]
    rows = ranked(families.select(F.struct(*names).alias("family")), "family", "at")
    comma = F.when(F.col("at") > 1, ",").otherwise("")
    lines = rows.select(F.col("at").cast("long").alias("at"), F.concat(comma, F.to_json("family", {"ignoreNullFields": "true"})).alias("value"))
    total = rows.agg(F.count(F.lit(1)).alias("n"))
    head = total.select(F.lit(0).cast("long").alias("at"), F.concat(F.lit('{"version":"1.0","total":'), F.col("n").cast("string"), F.lit(',"families":[')).alias("value"))
    foot = total.select((F.col("n") + 1).cast("long").alias("at"), F.lit("]}").alias("value"))
    head.unionByName(lines).unionByName(foot).orderBy("at").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_labels(labels: DataFrame, path: str) -> None:
    """Label files of a training set: a folder for each split and job, lines in the order of their boxes."""
    rows = labels.groupBy("split", "job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", "ord", "line"))), lambda x: x["line"]), "\n").alias("value"))
    rows.write.mode("overwrite").partitionBy("split", "job_id").text(path)


def write_dataset(spark: SparkSession, path: str, data: str, classes: list[str]) -> None:
    """The YAML that tells a trainer where its pictures lie and what their classes are."""
    lines = [f"path: {data}", "train: images/train", "val: images/val", f"nc: {len(classes)}", "names:", *[f"  {i}: {name}" for i, name in enumerate(classes)]]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_profile(spark: SparkSession, path: str, profile: dict) -> None:
    """A project's profile as one JSON record."""
    spark.createDataFrame([(json.dumps(profile),)], "value string").coalesce(1).write.mode("overwrite").text(path)
