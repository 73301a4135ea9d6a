"""Removal of repeated long passages, by compaction of the de Bruijn graph of token windows.

An edge is a window of ``window`` consecutive words. Every window has an anchor, the least-hashed
``anchor``-word k-mer in it, so equal windows have equal anchors. Consecutive windows of a document with
one anchor occurrence are a path that is compacted to one row: (anchor, hash of the path's words).

1. One narrow pass emits a row per path (one for about 13 words). Grouping by anchor tells anchors that
   occur once (dropped), those whose occurrences all lie on one path (the path repeats without a branch:
   nothing finer is needed) and those where paths branch.
2. A second pass emits, for anchors that may repeat (a broadcast filter of fixed size), the coordinates of
   nonbranching paths, and the single windows of branching ones, under 128-bit keys of their words.
3. A join on those keys gives each its source: the coordinates in the document of the least doc_id. Spans
   that follow each other in their document and in one source alike are one repeated path, compacted again.
4. The words at the source coordinates are read and hashed (SHA-256); a last pass over the texts removes a
   span where its own words have that hash.

Documents are told by doc_id and, where rows repeat a doc_id, by a hash of their text as well.
"""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planframe.llm.common import BROADCAST_ROWS, hot_join, id_filter, settle, spread
from planframe.llm.words import Spans, Words, chunks


class Paths:
    """The compacted paths of a chunk: anchors, path hashes, the document row, first and last window."""

    def __init__(self, data: np.ndarray, at: np.ndarray, window: int, anchor: int, mask: np.uint64):
        self.words = words = Words(data, at)
        self.first, n = words.first, len(words.hashes)
        inner = window - anchor + 1
        if n < window:
            self.anchors = self.paths = np.zeros(0, np.uint64)
            self.rows = self.lo = self.hi = np.zeros(0, np.int64)
            return
        self.spans = Spans(words.hashes, 1)
        k = self.spans(np.arange(n - anchor + 1), np.arange(anchor, n + 1))
        least = np.arange(n - window + 1)
        best = k[least]
        for j in range(1, inner):  # the first of the least wins, wherever the window lies
            other = k[j : j + len(best)]
            less = other < best
            best = np.where(less, other, best)
            least[less] = np.flatnonzero(less) + j
        starts = np.arange(n - window + 1)
        row = np.searchsorted(words.first, starts, side="right") - 1
        good = starts + window <= words.first[row + 1]
        starts, row, least = starts[good], row[good], least[good]
        if not len(starts):
            cuts = np.zeros(0, np.int64)
        else:
            cuts = np.flatnonzero(np.r_[True, (np.diff(least) != 0) | (np.diff(row) != 0) | (np.diff(starts) != 1)])
        self.lo, self.hi = starts[cuts], starts[np.r_[cuts[1:] - 1, len(starts) - 1]] if len(cuts) else starts[cuts]
        self.rows, place = row[cuts], least[cuts]
        self.anchors = k[place] & mask
        shape = ((place - self.lo).astype(np.uint64) << np.uint64(32)) + (self.hi - self.lo).astype(np.uint64)
        self.paths = spread(self.spans(self.lo, self.hi + window) ^ spread(shape + np.uint64(1)))


def _mask(bits: int) -> np.uint64:
    return np.uint64((1 << bits) - 1)


def _paths(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    mask = _mask(bits)

    def run(batches):
        for batch in batches:
            for _, data, at in chunks(batch.column(0)):
                p = Paths(data, at, window, anchor, mask)
                if len(p.rows):
                    yield pa.RecordBatch.from_arrays([pa.array(p.anchors.view(np.int64)), pa.array(p.paths.view(np.int64))], ["anchor", "path"])

    return docs.select("text").mapInArrow(run, "anchor long, path long")


def _occurrences(docs: DataFrame, window: int, anchor: int, bits: int, straight, branching) -> DataFrame:
    """Coordinates of the paths and of the windows whose anchors may repeat; ``hash`` is of an anchor or a window, ``check`` of all the words."""
    mask = _mask(bits)

    def run(batches):
        for batch in batches:
            for row, data, at in chunks(batch.column(2)):
                p = Paths(data, at, window, anchor, mask)
                if not len(p.rows):
                    continue
                anchors = p.anchors.view(np.int64)
                s, b = np.flatnonzero(straight.value(anchors)), np.flatnonzero(branching.value(anchors))
                length = p.hi[b] - p.lo[b] + 1
                base = np.cumsum(length) - length
                start = np.arange(length.sum()) - np.repeat(base - p.lo[b], length)
                rows = np.r_[p.rows[s], np.repeat(p.rows[b], length)]
                if not len(rows):
                    continue
                hashes = p.spans(start, start + window) & mask if len(start) else np.zeros(0, np.uint64)
                lo, hi = np.r_[p.lo[s], start], np.r_[p.hi[s], start]
                check = Spans(p.words.again(), 3)(lo, hi + window)
                first, of = p.first[rows], pa.array(rows + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[np.ones(len(s), bool), np.zeros(len(start), bool)]),
                        pa.array(np.r_[anchors[s], hashes.view(np.int64)]),
                        pa.array(check.view(np.int64)),
                        batch.column(0).take(of),
                        batch.column(1).take(of),
                        pa.array((lo - first).astype(np.int32)),
                        pa.array((hi - first).astype(np.int32)),
                    ],
                    ["whole", "hash", "check", "doc_id", "row", "lo", "hi"],
                )

    return docs.select("doc_id", "row", "text").mapInArrow(run, "whole boolean, hash long, check long, doc_id long, row long, lo int, hi int")


def _proof(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


def _proofs(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(s_doc, s_row, s_lo, length, proof) for the spans ``wanted(s_doc, s_row, s_lo, length)`` of source documents, from their words."""
    each = wanted.groupBy("s_doc", "s_row").agg(F.collect_list(F.struct("s_lo", "length")).alias("spans"))
    each = settle(each, "sources")
    maybe = docs.sparkSession.sparkContext.broadcast(id_filter(each, "s_doc", each.count()))

    def prune(batches):
        for batch in batches:
            yield batch.filter(pa.array(maybe.value(batch.column(0).to_numpy())))

    def run(batches):
        for batch in batches:
            out = []
            for doc, row, text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                words = text.as_py().encode().split()
                out += [(doc, row, x["s_lo"], x["length"], _proof(words[x["s_lo"] : x["s_lo"] + x["length"] + window])) for x in spans]
            columns = zip(*out, strict=True) if out else [[] for _ in range(5)]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["s_doc", "s_row", "s_lo", "length", "proof"])

    sources = docs.select("doc_id", "row", "text").mapInArrow(prune, "doc_id long, row long, text string")
    sources = sources.join(each, (F.col("doc_id") == F.col("s_doc")) & (F.col("row") == F.col("s_row"))).select("doc_id", "row", "text", "spans")
    proofs = settle(sources.mapInArrow(run, "s_doc long, s_row long, s_lo int, length int, proof binary").dropDuplicates(["s_doc", "s_row", "s_lo", "length"]), "proofs")
    maybe.destroy()
    return proofs


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__pf_row``: 0, or a hash of the text where rows repeat the doc_id."""
    ids = docs.select(F.col("doc_id").cast("long").alias("__pf_id")).where("__pf_id is not null")
    again = settle(ids.groupBy("__pf_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__pf_id"), "again")
    n = again.count()
    if not n:
        return docs.withColumn("__pf_row", F.lit(0).cast("long"))
    again = F.broadcast(again) if n <= BROADCAST_ROWS else again
    row = F.when(F.col("__pf_id").isNotNull(), F.xxhash64(F.col("text").cast("string"))).otherwise(F.lit(0))
    return docs.join(again, docs["doc_id"].cast("long") == F.col("__pf_id"), "left").withColumn("__pf_row", row).drop("__pf_id")


def repeated_spans(docs: DataFrame, window: int = 50, anchor: int = 25, bits: int = 64) -> DataFrame:
    """(doc_id, row, spans): for documents ``(doc_id, row, text)`` with words to remove, the ranges of windows to remove.

    A span has ``lo`` and ``hi``, the words at which its first and its last window start, and ``proof``, the
    hash of the source's words. ``bits`` fewer than 64 make the first hash collide, for tests.
    """
    docs = docs.where("doc_id is not null and text is not null")
    anchors = _paths(docs, window, anchor, bits).groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("p0"), F.max("path").alias("p1"))
    anchors = settle(anchors.where("n > 1").select("anchor", (F.col("p0") == F.col("p1")).alias("straight")), "anchors")
    counts = {r[0]: r[1] for r in anchors.groupBy("straight").count().collect()}
    share = docs.sparkSession.sparkContext.broadcast
    straight = share(id_filter(anchors.where("straight"), "anchor", counts.get(True, 0)))
    branching = share(id_filter(anchors.where("not straight"), "anchor", counts.get(False, 0)))
    found = settle(_occurrences(docs, window, anchor, bits, straight, branching), "occurrences")
    straight.destroy()
    branching.destroy()
    key = ["whole", "hash", "check"]
    source = found.groupBy(*key).agg(F.min(F.struct("doc_id", "row", "lo")).alias("s"), F.max("doc_id").alias("most"), F.count(F.lit(1)).alias("_n"))
    source = source.where("s.doc_id < most").select(*key, F.col("s.doc_id").alias("s_doc"), F.col("s.row").alias("s_row"), F.col("s.lo").alias("s_lo"), "_n")
    again = hot_join(found, source, key, "_n", found.count()).where("doc_id > s_doc")
    # Windows of one document and source at one distance: a run of them is a path, and a document bounds the group.
    path = ["doc_id", "row", "s_doc", "s_row", "away"]
    spans = again.withColumn("away", F.col("lo") - F.col("s_lo"))
    w = Window.partitionBy(*path).orderBy("lo")
    new = F.coalesce(F.col("lo") > F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(False)).cast("int")
    spans = spans.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w))
    spans = spans.groupBy(*path, "_run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    spans = settle(spans.select("doc_id", "row", "s_doc", "s_row", "lo", "hi", (F.col("lo") - F.col("away")).alias("s_lo"), (F.col("hi") - F.col("lo")).alias("length")), "spans")
    place = ["s_doc", "s_row", "s_lo", "length"]
    wanted = settle(spans.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")), "wanted")
    proofs = _proofs(docs, wanted, window).join(wanted, place)
    proved = hot_join(spans, proofs, place, "_n", spans.count())
    return proved.groupBy("doc_id", "row").agg(F.collect_set(F.struct("lo", "hi", "proof")).alias("spans"))


def _keep(text: str, spans: list[dict] | None, window: int) -> tuple[list[bytes], int]:
    """The kept words of a text and the number of its words; a span goes where its words are those of its source."""
    words = text.encode().split()  # bytes.split() parts at space and \t \n \v \f \r, and nothing else
    if not spans:
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for x in spans:
        lo, hi = x["lo"], x["hi"] + window
        if hi <= len(words) and _proof(words[lo:hi]) == x["proof"]:
            edge[lo] += 1
            edge[hi] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    return [words[i] for i in kept], len(words)


def _with_spans(docs: DataFrame, window: int, anchor: int, bits: int) -> DataFrame:
    docs = _keyed(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("__pf_row").alias("row"), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(texts, window, anchor, bits).select(F.col("doc_id").alias("__pf_id"), F.col("row").alias("__pf_of"), F.col("spans").alias("__pf_spans"))
    return docs.join(spans, (docs["doc_id"].cast("long") == F.col("__pf_id")) & (docs["__pf_row"] == F.col("__pf_of")), "left").drop("__pf_id", "__pf_row", "__pf_of")


def removal_digest(docs: DataFrame, window: int = 50, anchor: int = 25, bits: int = 64) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs(doc_id, text)``.

    A word is removed if it lies in a window of ``window`` words that also starts in a document with a
    smaller doc_id, as the input stands. A null or empty text has no words. A text shorter than the window
    loses nothing. Rows of one doc_id never remove from each other; each is judged by its own text. A row
    with a null doc_id keeps all its words and removes none.
    """

    def run(batches):
        for batch in batches:
            total, gone, sha = [], [], []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                kept, n = _keep(text.as_py() or "", spans.as_py(), window)
                total.append(n)
                gone.append(n - len(kept))
                sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    joined = _with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), window, anchor, bits)
    return joined.select("doc_id", "text", "__pf_spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame, window: int = 50, anchor: int = 25) -> DataFrame:
    """``docs``, all columns and rows, with repeated passages cut from ``text`` and ``n_chars`` brought up to date.

    A text that loses nothing stays as it is; one that loses words is its kept words joined by one space,
    and may be empty. Rows of one doc_id never remove from each other; a null doc_id loses and removes nothing.
    """
    schema = docs.schema
    names = [f.name for f in schema]

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            columns = [batch.column(i) for i in range(len(names))]
            spans = batch.column(len(names))
            cut = pc.fill_null(pc.greater(pc.list_value_length(spans), 0), False)
            rows = pc.indices_nonzero(cut)
            if len(rows):  # only what is cut becomes Python objects, a text at a time
                texts = [b" ".join(_keep(columns[at][i].as_py(), spans[i].as_py(), window)[0]).decode() for i in rows.to_pylist()]
                columns[at] = pc.replace_with_mask(columns[at], cut, pa.array(texts, columns[at].type))
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pc.utf8_length(columns[at]).cast(columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return _with_spans(docs, window, anchor, 64).mapInArrow(run, schema)
