"""Hard-negative mining by norm-bucketed search of exact inner products.

Vectors become integers, and a score is an integer inner product. Candidates are sorted by norm and range-
partitioned into slices; a slice's largest norm times an anchor's bounds all scores between the two
(Cauchy-Schwarz). Each search has two rounds. In the first every group of anchors meets the slice of the largest
norms; that gives running kth scores. In the second an anchor goes only to the slices whose bound reaches both the
lower limit of one of its windows and the kth score that the window has. A task streams one slice past one group
of anchors in blocks of falling norm, and the same bound, with kth scores that rise as it goes, passes over blocks.

The first search is among the anchor's own label and has one open window; its results, the positives, set the
windows of the second, among all other labels.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, numbered, settle, tune

#: Candidates of a slice (more where that would be over SLICES slices), slices of a search, and anchors of a group.
SLICE, SLICES, GROUP = 2048, 4096, 1024

#: Squared norms from here on take no part: scores with them may not fit a long.
LIMIT = 2.0**63

#: Every score lies between them.
LOW, HIGH = -(2**63), 2**63 - 1

_ROW = "vec_id long, label long, dims int, norm2 double, q binary"
_UNIT = ["key", "dims", "group", "part"]


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """(row, vec_id, label, dims, norm2, q) of the rows of ``vectors`` that take part; q holds floor(scale * x) in 2, 4 or 8 bytes each."""
    tune(vectors.sparkSession)

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            at = np.cumsum(size) - size
            keep, norm2, q = [], [], []
            for i, (lo, n) in enumerate(zip(at, size, strict=True)):
                x = flat[lo : lo + n]
                top = np.abs(x).max(initial=0.0)
                total = float((x * x).sum()) if top < 2.0**32 else LIMIT
                if total < LIMIT:
                    keep.append(i)
                    norm2.append(total)
                    q.append(x.astype(np.int16 if top < 2**15 else np.int32 if top < 2**31 else np.int64).tobytes())
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(size[keep].astype(np.int32), pa.int32()), pa.array(norm2, pa.float64()), pa.array(q, pa.binary())],
                ["vec_id", "label", "dims", "norm2", "q"],
            )

    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return rows.mapInArrow(run, _ROW).withColumn("row", F.monotonically_increasing_id())


def sliced(rows: DataFrame, key: Column, slices: int) -> DataFrame:
    """``rows`` with (key, part), settled in order of falling norm: within a key the parts are ranges of the norm."""
    order = ["key", "dims", F.desc("norm2"), "row"]
    dealt = rows.withColumn("key", key).repartitionByRange(slices, *order).sortWithinPartitions(*order)
    return settle(dealt.withColumn("part", F.spark_partition_id()), "slices")


class Best:
    """The best k of each anchor and window, and where a score has to lie to be among them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, k: int):
        self.k, self.high, self.bar = k, high, low.copy()
        self.found = [np.zeros((4, 0), np.int64) for _ in range(low.shape[1])]  # anchor, score, id, row

    def add(self, at: np.ndarray, score: np.ndarray, ok: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        """Takes the block's scores (anchors ``at`` by candidates) where ``ok`` holds."""
        for w, have in enumerate(self.found):
            low, high = self.bar[at, w], self.high[at, w]
            some = np.flatnonzero(low <= high)
            if not len(some):
                continue
            s = score[some]
            fit = ok[some] & (s >= low[some, None]) & (s <= high[some, None])
            if s.shape[1] > self.k:
                least = np.partition(np.where(fit, s, LOW if s.dtype == np.int64 else -np.inf), s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                fit &= s >= least[:, None]
            i, j = np.nonzero(fit)
            if not len(i):
                continue
            new = np.stack([at[some[i]], s[i, j].astype(np.int64), ids[j], rows[j]])
            whole = np.concatenate([have, new], axis=1)
            whole = whole[:, np.lexsort((whole[3], whole[2], -whole[1], whole[0]))]
            start = np.flatnonzero(np.r_[True, whole[0, 1:] != whole[0, :-1]])
            place = np.arange(whole.shape[1]) - np.repeat(start, np.diff(np.r_[start, whole.shape[1]]))
            self.found[w] = whole[:, place < self.k]
            full = whole[:, place == self.k - 1]
            self.bar[full[0], w] = np.maximum(self.bar[full[0], w], full[1])


def _matrix(values: list[bytes], dims: int) -> np.ndarray:
    kinds = {2: np.int16, 4: np.int32, 8: np.int64}
    return np.stack([np.frombuffer(v, kinds[len(v) // dims] if dims else np.int16).astype(np.int64) for v in values])


class Unit:
    """One group of anchors and one slice of candidates, a block at a time."""

    def __init__(self, same: bool, k: int):
        self.same, self.k, self.anchors, self.best = same, k, [], None

    def anchor(self, t: pa.RecordBatch) -> None:
        self.anchors.append(t)

    def _start(self) -> None:
        t = pa.Table.from_batches(self.anchors).combine_chunks()
        self.dims = t["dims"][0].as_py()
        self.row, self.id, self.label, self.norm2 = (t[c].to_numpy() for c in ("row", "vec_id", "label", "norm2"))
        self.q = _matrix(t["q"].to_pylist(), self.dims)
        low, high = (np.array(t[c].to_pylist(), np.int64).reshape(len(t), -1) for c in ("low", "high"))
        self.best, self.anchors = Best(low, high, self.k), []

    def candidates(self, t: pa.RecordBatch) -> None:
        if self.best is None:
            if not self.anchors:
                return
            self._start()
        norm2 = t.column("norm2").to_numpy()
        bar = np.where(self.best.bar <= self.best.high, self.best.bar, HIGH).min(axis=1).astype(np.float64)
        at = np.flatnonzero((bar <= 0) | (norm2.max() * self.norm2 * (1 + 1e-9) >= bar * bar))
        if not len(at):
            return
        a, c = self.q[at], _matrix(t.column("q").to_pylist(), self.dims)
        if self.norm2[at].max() * norm2.max() < 2.0**105:  # all sums on the way stay below 2**53
            score = a.astype(np.float64) @ c.T.astype(np.float64)
        else:
            score = a @ c.T
        ids, label, rows = (t.column(x).to_numpy() for x in ("vec_id", "label", "row"))
        alike = self.label[at, None] == label[None, :]
        ok = alike & (self.id[at, None] != ids[None, :]) if self.same else ~alike
        self.best.add(at, score, ok, ids, rows)

    def result(self) -> pa.RecordBatch | None:
        if self.best is None:
            return None
        out = np.concatenate([np.stack([self.row[f[0]], np.full(f.shape[1], w), *f[1:]]) for w, f in enumerate(self.best.found)], axis=1)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["row", "window", "score", "found_id", "found_row"])


def _scan(anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """The best of each unit. ``anchors`` has group, part, low and high; its units' candidates follow them in one stream."""
    needed = anchors.select(*_UNIT).distinct()
    meet = candidates.join(needed, ["key", "dims", "part"]).withColumn("low", F.lit(None).cast("array<long>")).withColumn("high", F.col("low"))
    columns = [*_UNIT, "kind", "norm2", "row", "vec_id", "label", "q", "low", "high"]
    both = anchors.withColumn("kind", F.lit(0)).select(*columns).unionByName(meet.withColumn("kind", F.lit(1)).select(*columns))

    def run(batches):
        unit, last = None, None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(5)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if lo == hi:
                    continue
                if last != (here := tuple(keys[:4, lo])):
                    if unit is not None and (r := unit.result()) is not None:
                        yield r
                    unit, last = Unit(same, k), here
                (unit.candidates if keys[4, lo] else unit.anchor)(batch.slice(lo, hi - lo))
        if unit is not None and (r := unit.result()) is not None:
            yield r

    dealt = both.repartition(*_UNIT).sortWithinPartitions(*_UNIT, "kind", F.desc("norm2"), "row")
    return dealt.mapInArrow(run, "row long, window long, score long, found_id long, found_row long")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("row", "window").orderBy(F.desc("score"), "found_id", "found_row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """(row, window, rank, score, found_id): the best k candidates in each window (low, high) of each anchor.

    ``candidates`` comes from ``sliced``; ``anchors`` are rows of it with arrays ``low`` and ``high``. Candidates
    have the anchor's label and another vec_id, or with ``same`` False another label.
    """
    place = ["key", "dims"]
    tops = candidates.groupBy(*place, "part").agg(F.max("norm2").alias("top"))
    tops = tops.groupBy(*place).agg(F.sort_array(F.collect_list(F.struct("top", "part")), asc=False).alias("slices"))  # SLICES of a key at most
    tops = settle(tops.join(anchors.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")), place), "tops")
    total = tops.agg(F.sum("_n")).first()[0] or 0
    salts = max(1, total // (4 * GROUP))
    slim = anchors.select(*place, "norm2", "row", "vec_id", "label", "q", "low", "high")
    grouped = numbered(slim, place, [F.col("row")], salts, "_at").withColumn("group", F.floor(F.col("_at") / GROUP).cast("long")).drop("_at")
    grouped = settle(hot_join(grouped, tops, place, "_n", total), "anchors")
    first = grouped.withColumn("part", F.col("slices")[0]["part"])
    near = settle(_scan(first, candidates, same, k), "near")
    kth = near.groupBy("row", "window").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
    kth = kth.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("window", "kth"))).alias("kth"))  # one a window
    told = grouped.join(kth, "row", "left")
    bar = F.transform("low", lambda x, w: F.greatest(x, F.coalesce(F.try_element_at("kth", w.cast("long")), x)))
    told = told.withColumn("low", F.when(F.col("kth").isNull(), F.col("low")).otherwise(bar))
    least = F.array_min(F.zip_with("low", "high", lambda a, b: F.when(a <= b, a))).cast("double")
    far = F.filter(F.slice("slices", 2, SLICES + 1), lambda s: (F.col("_least") <= 0) | (s["top"] * F.col("norm2") * (1 + 1e-9) >= F.col("_least") * F.col("_least")))
    rest = told.withColumn("_least", least).where("_least is not null").withColumn("part", F.explode(F.transform(far, lambda s: s["part"])))
    return _top(near.unionByName(_scan(rest, candidates, same, k)), k)


def hard_negatives(vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``vectors(vec_id, embedding, label)`` where ``anchors`` holds.

    ``anchors`` is a condition on vec_id and label. A component x becomes floor(scale * x), and a score is the
    exact integer inner product. An anchor's positives are the best rows of its label with another vec_id; for each,
    the negatives are the best rows of other labels with ``low * positive <= high * negative <= high * positive``.
    Higher scores come first, ties by smaller vec_id; all are returned where there are fewer. Rows with a null
    vec_id, label, vector or component or one that is not finite take no part, nor do those whose squared integer
    norm is 2**63 or more, as their scores may not fit a long. Vectors of different lengths do not meet; empty ones score 0.
    Rows that repeat a vec_id count each. No anchors or no rows: no rows.
    """
    rows = quantised(vectors, scale)
    slices = min(SLICES, max(1, -(-vectors.count() // SLICE)))
    by_label = sliced(rows, F.col("label"), slices)
    by_norm = sliced(by_label.drop("key", "part"), F.lit(0).cast("long"), slices)
    asked = by_label.where(F.coalesce(anchors, F.lit(False)))
    open_ = [F.array(F.lit(x).cast("long")) for x in (LOW, HIGH)]
    good = search(asked.withColumns({"low": open_[0], "high": open_[1]}), by_label, True, positives)
    good = settle(good.select("row", F.col("rank").alias("positive"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    score = F.col("positive_score")
    # ceil(low * score / high) without leaving a long
    least = F.expr(f"(positive_score div {high}) * {low} + ((positive_score % {high}) * {low} + {high - 1}) div {high}")
    limits = good.where(score >= 0).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("positive", least.alias("low"), score.alias("high")))).alias("w"))
    windows = limits.select("row", F.col("w.positive").alias("places"), F.col("w.low").alias("low"), F.col("w.high").alias("high"))
    # Windows are padded to one number with empty ones.
    padded = [F.slice(F.concat(c, F.array_repeat(F.lit(x).cast("long"), positives)), 1, positives).alias(c) for c, x in (("low", HIGH), ("high", LOW))]
    hunting = asked.select("vec_id", "label", "dims", "norm2", "q", "row").withColumn("key", F.lit(0).cast("long")).join(windows.select("row", *padded), "row")
    bad = search(hunting, by_norm, False, negatives)
    bad = bad.select("row", (F.col("window") + 1).cast("int").alias("positive"), F.col("rank"), F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    names = asked.select("row", F.col("vec_id").alias("anchor_id"))
    out = bad.join(good, ["row", "positive"]).join(names, "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
