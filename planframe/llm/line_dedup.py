"""Line dedup: hashes of lines range-partitioned with a secondary sort, first occurrences streamed, compressed keep bitmaps.

All of it is DataFrame functions.

1. Each line of at least ``least`` code points gives two 64-bit hashes of its key, with document and position.
2. A frequent-items sketch of fixed size names the keys that hold more than one line in HOT_KEYS. Their first
   documents are a combinable minimum, and their lines are judged where they lie, by a broadcast of those few.
3. All other lines go to ranges of the hash, sorted there by hash, document and position; the first document of
   a hash streams down its lines, and a line of any later document is dropped.
4. The dropped positions of a document become runs: a run-length compressed bitmap, which is all that goes back
   to the texts.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.llm.common import HOT_KEYS, settle

#: What is stripped at both ends of a line: space and \t to \r.
BLANKS = " \t\n\x0b\x0c\r"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _whole(docs: DataFrame) -> tuple[Column, Column, Column]:
    """doc_id, text and its hash; the hash tells rows of one doc_id apart."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs["doc_id"].cast("long"), text, F.xxhash64(text)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, t, pos, k1, k2) of every line whose key has ``least`` code points or more; rows without a doc_id give none."""
    doc_id, text, t = _whole(docs)
    rows = docs.select(doc_id.alias("doc_id"), t.alias("t"), F.split(F.translate(text, _UPPER, _LOWER), "\n", -1).alias("lines")).where("doc_id is not null")
    lines = rows.select("doc_id", "t", F.posexplode("lines").alias("pos", "line")).select("doc_id", "t", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
    return lines.where(F.char_length("key") >= least).select("doc_id", "t", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"))


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, t, pos) of the lines of ``line_keys`` whose key a smaller doc_id holds too."""
    # Any key above 1 / HOT_KEYS of the lines is among the items of a sketch of this size; which keys it names changes no result.
    sketch = lines.agg(F.expr(f"approx_top_k(k1, {HOT_KEYS}, {8 * HOT_KEYS})").alias("items"), F.count(F.lit(1)).alias("total"))
    hot = sketch.select(F.explode("items").alias("i"), "total").where(F.col("i.count") > F.greatest(F.lit(1), F.col("total") / HOT_KEYS)).select(F.col("i.item").alias("k1"))
    hot = settle(hot, "hot-lines")
    firsts = lines.join(F.broadcast(hot), "k1").groupBy("k1", "k2").agg(F.min("doc_id").alias("first"))
    here = lines.join(F.broadcast(firsts), ["k1", "k2"])
    rest = lines.join(F.broadcast(hot), "k1", "left_anti")
    ranges = rest.repartitionByRange("k1", "k2").sortWithinPartitions("k1", "k2", "doc_id", "pos")
    so_far = Window.partitionBy("k1", "k2").orderBy("doc_id", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    streamed = ranges.withColumn("first", F.first("doc_id").over(so_far))
    return here.select("doc_id", "t", "pos", "first").unionByName(streamed.select("doc_id", "t", "pos", "first")).where(F.col("doc_id") > F.col("first")).drop("first")


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, t, drops): for each document that loses lines its keep bitmap, as the runs (at, n) of lines that go.

    ``docs`` needs ``doc_id`` and ``text``; ``t`` is the text's xxhash64. Lines end at \\n, and a null or empty
    text is one empty line. A line's key is the line without the blanks at both ends, A-Z lower-cased. A key of
    ``least`` code points or more that two documents hold keeps only the lines of the smallest doc_id; within
    one document a key may repeat. Rows that repeat a doc_id are one document, each with a bitmap of its own.
    Rows without a doc_id count for no key and lose nothing. Keys compare by 128 bits.
    """
    lines = settle(line_keys(docs, least), "lines")
    gone = dropped_lines(lines).groupBy("doc_id", "t").agg(F.array_sort(F.collect_set("pos")).alias("p"))
    before, after = (lambda i: F.get("p", i - 1)), (lambda i: F.get("p", i + 1))
    starts = F.filter("p", lambda x, i: F.coalesce(before(i) != x - 1, F.lit(True)))
    ends = F.filter("p", lambda x, i: F.coalesce(after(i) != x + 1, F.lit(True)))
    return gone.select("doc_id", "t", F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("at"), (b - a + 1).alias("n"))).alias("drops"))


def _kept(lines: Column, drops: Column) -> Column:
    """The lines that stay: the stretches between the runs that go."""

    def stretch(i: Column) -> Column:
        run = F.get(drops, i - 1)
        start = F.coalesce(run["at"] + run["n"], F.lit(0))
        return F.slice(lines, start + 1, F.coalesce(F.get(drops, i)["at"], F.size(lines)) - start)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(drops)), stretch))


def _judged(docs: DataFrame, least: int) -> DataFrame:
    """``docs`` with ``__n``, ``__gone`` (lines, and lines that go) and ``__kept`` (the text that stays)."""
    doc_id, text, t = _whole(docs)
    maps = keep_bitmaps(docs, least).select(F.col("doc_id").alias("__id"), F.col("t").alias("__t"), F.col("drops").alias("__drops"))
    out = docs.withColumns({"__own": doc_id, "__hash": t}).join(maps, (F.col("__own") == F.col("__id")) & (F.col("__hash") == F.col("__t")), "left")
    lines = F.split(text, "\n", -1)
    gone = F.coalesce(F.aggregate("__drops", F.lit(0), lambda s, r: s + r["n"]), F.lit(0))
    kept = F.when(F.col("__drops").isNull(), text).otherwise(F.array_join(_kept(lines, F.col("__drops")), "\n"))
    return out.withColumns({"__n": F.size(lines), "__gone": gone, "__kept": kept})


def drop_repeated_lines(docs: DataFrame, least: int = 10) -> DataFrame:
    """``docs``, all columns, with the repeated lines cut from ``text`` (see ``keep_bitmaps``); a text that loses none stays as it is, null included."""
    names = [c for c in docs.columns if c != "text"]
    out = _judged(docs, least)
    text = F.when(F.col("__drops").isNull(), docs["text"].cast("string")).otherwise(F.col("__kept"))
    return out.select(*[docs[c] for c in names], text.alias("text")).select(*docs.columns)


def line_digest(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every row of ``docs(doc_id, text)``."""
    out = _judged(docs, least)
    return out.select(docs["doc_id"], F.col("__n").cast("long").alias("n_lines"), F.col("__gone").cast("long").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))
