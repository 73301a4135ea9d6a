"""Helpers that the corpus operators share: tables, lineage cuts, numbering and fixed-size filters."""

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most rows that a caller may mark for broadcast by hand (ids of 8 bytes).
BROADCAST_ROWS = 200_000

#: A key with more than one row in this many counts as hot; so at most this many keys are hot, whatever the data.
HOT_KEYS = 2_000

#: Places that the rows of a hot key are dealt to.
SPREAD = 4096

#: Most bits of a broadcast membership filter (8 MB). A full filter lets more rows pass and changes no result.
FILTER_BITS = 1 << 26

_OWN_DIRS: dict[str, str] = {}
_USED: set[tuple[str, str]] = set()


#: Rows in a batch that Spark hands to Python: texts may be long, and a worker holds a few batches.
ARROW_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Keeps the session's Arrow batches at ARROW_ROWS rows or fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table, and no others."""
    tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application below ``spark.checkpoint.dir``; only a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if app not in _OWN_DIRS:
            _OWN_DIRS[app] = tempfile.mkdtemp(prefix="planframe-")
        root = _OWN_DIRS[app]
    path = f"{root}/planframe-{app}"
    _USED.add((app, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path through Hadoop, in whatever store it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    for app, path in _USED:
        try:
            if spark.sparkContext.applicationId == app:
                remove(spark, path)
        except Exception:  # the session may have ended already
            return


def settle(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage and survives lost executors."""
    tune(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled = path
    return out


def unsettle(df: DataFrame) -> None:
    """Deletes what ``settle`` wrote, once nothing reads it any more."""
    if path := getattr(df, "_settled", None):
        remove(df.sparkSession, path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def numbered(df: DataFrame, keys: list[str], order: list[Column], salts: int, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within ``keys``, gapless, without one task per key.

    Rows are dealt to (keys, salt) by a hash of their order columns, numbered there, and shifted by the
    counts of the salts before. A key may hold all rows.
    """
    salt = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salt.groupBy(*keys, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    local = salt.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    return local.join(counts, [*keys, "_salt"]).withColumn(out, (F.col("_before") + F.col("_rn") - 1).cast("long")).drop("_salt", "_rn", "_before")


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """Joins ``left`` with ``right``, which has unique keys and in ``count`` how many rows of ``left`` each has (at most ``total`` in all).

    Keys that hold more than one row in HOT_KEYS of all are few by that measure: their rows of ``right`` are
    broadcast, and their rows of ``left``, served already, are dealt anywhere in the shuffled join of the others.
    ``left`` is read once. For a left join ``right`` has to list every hot key. ``count`` is not in the result;
    null keys join with nothing.
    """
    hot = F.col(count) > max(1, total // HOT_KEYS)
    told = [c for c in right.columns if c not in (*keys, count)]
    row = F.struct(*told) if told else F.struct(F.lit(1).alias("_1"))
    out = left.join(F.broadcast(right.where(hot).select(*keys, row.alias("_hot"))), keys, "left")
    anywhere = F.pmod(F.xxhash64(*left.columns), F.lit(SPREAD)) + 1
    out = out.withColumn("_deal", F.when(F.col("_hot").isNull(), F.lit(0)).otherwise(anywhere).cast("int"))
    # Always 0, but no constant: Spark would take a constant out of the join's keys, and deal hot rows by their key again.
    never = F.pmod(F.col(count), F.lit(1)).cast("int").alias("_deal")
    out = out.join(right.where(~hot).select(*keys, row.alias("_cold"), never), [*keys, "_deal"], "left")
    if how == "inner":
        out = out.where("_hot is not null or _cold is not null")
    return out.select(*left.columns, *[F.coalesce("_hot", "_cold")[c].alias(c) for c in told])


class IdFilter:
    """A one-hash membership filter of 64-bit values for executors: no false negatives."""

    def __init__(self, bits: int, words: np.ndarray):
        self.bits, self.words = bits, words

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = spread(values.view(np.uint64)) & np.uint64(self.bits - 1)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def spread(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def id_filter(df: DataFrame, column: str, count: int) -> "IdFilter":
    """Builds an IdFilter over a long column; executors fold the bits, the driver gets FILTER_BITS / 64 words at most."""
    bits = 1 << 12
    while bits < 24 * count and bits < FILTER_BITS:
        bits <<= 1

    def fold(batches):
        words = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            x = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            at = spread(x.view(np.uint64)) & np.uint64(bits - 1)
            np.bitwise_or.at(words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(words[used].view(np.int64))], ["word", "value"])

    rows = df.select(column).where(F.col(column).isNotNull()).mapInArrow(fold, "word int, value long").groupBy("word").agg(F.expr("bit_or(value)").alias("value")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[rows["word"].to_numpy()] = rows["value"].to_numpy().view(np.uint64)
    return IdFilter(bits, words)


def only_ids(docs: DataFrame, ids: DataFrame, count: int, how: str) -> DataFrame:
    """``docs`` semi- or anti-joined on doc_id; the ids are broadcast up to BROADCAST_ROWS, else shuffled."""
    ids = ids.select(F.col("doc_id").alias("__pf_id"))
    return docs.join(F.broadcast(ids) if count <= BROADCAST_ROWS else ids, docs["doc_id"] == F.col("__pf_id"), how)


def runs(batches, keys: int):
    """Record batches of a partition sorted by its first ``keys`` columns -> one batch for each run of equal keys.

    Only the run at hand is held; callers bound the size of a run when they deal the rows.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[lo] for c in cols)
            if last is not None and key != last:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = key
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def block_components(linked: np.ndarray) -> np.ndarray:
    """Components of a small symmetric boolean matrix: for each row, the first row that it reaches."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1))
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
