"""Near-duplicate documents by MinHash: universal hash minima, banding, verification, connected components.

1. One pass over the texts gives each document its number of distinct shingles, a 128-bit key of the set,
   and (for banding) the minima of ``bands * rows`` universal hashes.
2. Documents with one set are a class; only its least doc_id goes on.
3. Classes that share a band bucket are compared by signature. A bucket of any size is cut into blocks,
   pairs of blocks are dealt out, and each pair of blocks gives a row per member, not a row per pair.
4. Candidate components are the reach of those links. The full shingle sets of their members are dealt
   out in blocks again, those of a large component by size first (sets of too unequal sizes can't link),
   and every candidate pair is settled on full sets.
5. Components of the verified links, by alternating large-star and small-star.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import block_components, hot_join, id_filter, only_ids, runs, settle, spread
from planframe.llm.components import components
from planframe.llm.words import Words, chunks

#: Members of a block; a bucket or candidate component of up to two blocks is one group.
BLOCK = 256

#: Cells of a dense block matrix of members by shared shingles (float32).
DENSE = 1 << 23

_FEATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, minima binary"


def _hashes(bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(7)
    n = bands * rows
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(texts: pa.Array, shingle: int):
    """For each text the sorted distinct shingle hashes, in chunks: lists of arrays."""
    for _, data, at in chunks(texts):
        values, first = Words(data, at, lower=True).shingles(shingle)
        yield [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]


def features(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """Set sizes, set keys, band hashes and 8-bit minima of all documents, in one narrow pass."""

    def run(batches):
        mul, add = _hashes(bands, rows)
        salt = spread(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            ids, row = batch.column(0), 0
            for sets in shingle_sets(batch.column(1), shingle):
                size = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(size)
                flat = np.concatenate([sets[i] for i in full]) if len(full) else np.zeros(0, np.uint64)
                starts = np.zeros(len(full), np.int64)
                np.cumsum(size[full][:-1], out=starts[1:])
                key = np.zeros((2, len(sets)), np.uint64)
                minima = np.zeros((bands * rows, len(sets)), np.uint64)
                if len(full):
                    for k in range(2):
                        key[k, full] = np.add.reduceat(spread(flat ^ np.uint64(0x5851F42D4C957F2D * (k + 1) & (2**64 - 1))), starts)
                    for k in range(bands * rows):
                        minima[k, full] = np.minimum.reduceat(flat * mul[k] + add[k], starts)
                folded = np.zeros((len(sets), bands), np.uint64)
                for r in range(rows):
                    folded = spread(folded * np.uint64(0x9E3779B97F4A7C15) + minima[r::rows].T)
                folded = spread(folded ^ salt[None, :]).view(np.int64)
                small = np.ascontiguousarray((minima.T >> np.uint64(40)).astype(np.uint8))
                n = len(sets)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(folded.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(row, n), pa.array(size), pa.array(key[0].view(np.int64)), pa.array(key[1].view(np.int64)), lists, pa.array([x.tobytes() for x in small], pa.binary())],
                    ["doc_id", "n_shingles", "k1", "k2", "bands", "minima"],
                )
                row += n

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _FEATURES)


def _deal(df: DataFrame, size: str, per_block: int) -> DataFrame:
    """Gives each member of a key of ``size`` members the pairs (ba, bb) of blocks that its own block is in; one pair up to two blocks."""
    n = F.greatest(F.lit(1), F.ceil(F.col(size) / per_block)).cast("int")
    df = df.withColumn("_blocks", F.when(F.col(size) <= 2 * per_block, 1).otherwise(n))
    df = df.withColumn("_own", F.pmod(F.xxhash64("id", F.lit(11)), F.col("_blocks")).cast("int"))
    df = df.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return df.withColumns({"ba": F.least("_own", "_other"), "bb": F.greatest("_own", "_other")})


def _gather(df: DataFrame, key: str) -> DataFrame:
    """Brings the members of each key and pair of blocks together, in order."""
    return df.repartition(key, "ba", "bb").sortWithinPartitions(key, "ba", "bb", "id")


def _links(ids: np.ndarray, linked: np.ndarray):
    label = block_components(linked)
    at = np.flatnonzero(label != np.arange(len(label)))
    return ids[at], ids[label[at]]


def _emit(pairs):
    if pairs:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[i] for p in pairs])) for i in (0, 1)], ["u", "v"])


def candidate_links(classes: DataFrame, similarity: float, hashes: int) -> DataFrame:
    """Spanning links (u, v) of the classes ``(row, bands, minima)`` that share a band bucket and whose signatures agree well enough.

    The bar lies 4.5 standard deviations below the similarity asked for.
    """
    bar = hashes * (similarity - 4.5 * (similarity * (1 - similarity) / hashes) ** 0.5)
    bands = classes.select(F.col("row").alias("id"), F.explode("bands").alias("band"))
    full = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_n", F.col("n"))
    full = settle(full, "buckets")
    total = full.agg(F.sum("n")).first()[0] or 0
    members = hot_join(bands, full, ["band"], "_n", total).join(classes.select(F.col("row").alias("id"), "minima"), "id")

    def run(batches):
        out = []
        for t in runs(batches, 3):
            if len(t) < 2:
                continue
            sig = np.frombuffer(b"".join(t["minima"].to_pylist()), np.uint8).reshape(len(t), hashes)
            ids = t["id"].to_numpy()
            if len(t) == 2:
                linked = np.zeros((2, 2), bool)
                linked[0, 1] = linked[1, 0] = (sig[0] == sig[1]).sum() >= bar
            else:
                linked = np.stack([(sig == s).sum(axis=1) >= bar for s in sig])
            out.append(_links(ids, linked))
            if len(out) > 5000:
                yield from _emit(out)
                out = []
        yield from _emit(out)

    return _gather(_deal(members, "n", BLOCK), "band").select("band", "ba", "bb", "id", "minima").mapInArrow(run, "u long, v long").distinct()


def _groups(candidates: DataFrame, count: int, percent: int, per_block: int) -> DataFrame:
    """(id, place, n): the groups of candidates ``(id, component, n_shingles)`` that have to be compared, with their sizes.

    Members of a component that is more than two blocks go by size: class c holds sizes within a factor of
    100 / percent, so members of sets that may link are in one class or in neighbouring ones, and meet in the
    group of the lower class.
    """
    size = candidates.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("_n", F.col("n"))
    members = hot_join(candidates, size, ["component"], "_n", count)
    step = F.floor(F.log("n_shingles") / float(np.log(100 / percent)) + 1e-9).cast("int")
    lower = F.when(F.col("n") <= 2 * per_block, F.array(F.lit(-1))).otherwise(F.array(step - 1, step))
    split = members.withColumn("_class", F.explode(lower)).withColumn("place", F.xxhash64("component", "_class")).select("id", "place").distinct()
    again = split.groupBy("place").agg(F.count(F.lit(1)).alias("n")).where("n > 1").withColumn("_n", F.col("n"))
    return hot_join(split, again, ["place"], "_n", 2 * count)


def verified_links(docs: DataFrame, candidates: DataFrame, count: int, shingle: int, percent: int) -> DataFrame:
    """Spanning links of the members (id, component, n_shingles) of candidate components, settled on full shingle sets."""
    maybe = docs.sparkSession.sparkContext.broadcast(id_filter(candidates, "id", count))

    def sets(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(maybe.value(ids))
            row = 0
            taken = batch.column(1).take(pa.array(at))
            for some in shingle_sets(taken, shingle):
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[row : row + len(some)]]), pa.array([x.tobytes() for x in some], pa.binary())], ["doc_id", "grams"])
                row += len(some)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null").mapInArrow(sets, "doc_id long, grams binary")
    members = _deal(_groups(candidates, count, percent, BLOCK // 2), "n", BLOCK // 2).join(found.withColumnRenamed("doc_id", "id"), "id")

    def run(batches):
        out = []
        for t in runs(batches, 3):
            if len(t) < 2:
                continue
            ids = t["id"].to_numpy()
            grams = [np.frombuffer(x, np.uint64) for x in t["grams"].to_pylist()]
            out.append(_links(ids, similar(grams, percent)))
            if len(out) > 5000:
                yield from _emit(out)
                out = []
        yield from _emit(out)

    links = settle(_gather(members, "place").select("place", "ba", "bb", "id", "grams").mapInArrow(run, "u long, v long").distinct(), "links")
    maybe.destroy()
    return links


def similar(grams: list[np.ndarray], percent: int) -> np.ndarray:
    """Which of a few sets link: 100 * intersection >= percent * union, on full sets."""
    n, size = len(grams), np.array([len(g) for g in grams], np.int64)
    flat = np.concatenate(grams)
    owner = np.repeat(np.arange(n), size)
    _, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times[inverse] > 1
    column = np.cumsum(times > 1)[inverse[shared]] - 1
    owner = owner[shared]
    width = int(column.max()) + 1 if len(column) else 0
    common = np.zeros((n, n), np.int64)
    step = max(1, DENSE // n)
    for lo in range(0, width, step):
        part = (column >= lo) & (column < lo + step)
        m = np.zeros((n, min(step, width - lo)), np.float32)
        m[owner[part], column[part] - lo] = 1
        common += (m @ m.T).astype(np.int64)
    return 100 * common >= percent * (size[:, None] + size[None, :] - common)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the near-duplicate class of every document.

    ``docs`` needs ``doc_id`` and ``text``; other columns are not read. Words are the runs of bytes other
    than space and \\t \\n \\v \\f \\r of the text with A-Z lower-cased. Documents link if
    ``100 * |A & B| >= percent * |A | B|`` over their sets of ``shingle``-word shingles. A null or empty
    text, or one of white space, has an empty set and links with nothing. Rows that repeat a doc_id each
    give a row; such a document is one node and links by any of its texts. A null doc_id gives a row with a null component
    and ``kept`` true. With 40 bands of 5 rows a pair at 0.80 meets in no bucket with probability 1e-7, one
    at 0.85 with 1e-10; the comparison of signatures then passes over one in 1e5 at the similarity asked for.
    """
    all_rows = settle(features(docs, shingle, bands, rows).withColumn("row", F.monotonically_increasing_id()), "minhash")
    count = all_rows.count()
    slim = all_rows.select("doc_id", "n_shingles", "k1", "k2")
    key = ["n_shingles", "k1", "k2"]
    some = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    reps = slim.where(some).groupBy(*key).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("_n"))
    classes = all_rows.where(some).join(reps.select(F.col("rep").alias("doc_id"), *key), ["doc_id", *key], "left_semi").dropDuplicates(["doc_id", *key])
    links = candidate_links(classes, percent / 100, bands * rows)
    candidates = components(links).join(classes.select(F.col("row").alias("id"), "doc_id", "n_shingles"), "id")
    candidates = settle(candidates.select(F.col("doc_id").alias("id"), "component", "n_shingles"), "candidates")
    n = candidates.count()
    # A document of several sets is one node: it links the classes of its sets.
    several = slim.where(some).groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("b")).where("a <> b").select("doc_id")
    edges = slim.where(some).join(several, "doc_id").join(reps, key).select(F.col("doc_id").alias("u"), F.col("rep").alias("v"))
    found = components(verified_links(docs, candidates, n, shingle, percent).unionByName(edges) if n else edges)
    group = reps.join(found.withColumnRenamed("id", "rep"), "rep", "left").select(*key, F.coalesce("component", "rep").alias("component_id"), "_n")
    linked = hot_join(slim.where(some), group, key, "_n", count).select("doc_id", "n_shingles", "component_id")
    out = linked.unionByName(slim.where(~some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, less those whose near-duplicate class has a smaller doc_id."""
    judged = settle(near_duplicates(docs, **options).where("not kept").select("doc_id").distinct(), "dropped")
    return only_ids(docs, judged, judged.count(), "left_anti")
