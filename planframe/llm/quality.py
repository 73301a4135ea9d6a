"""Text quality by weak labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

1. One narrow pass over all texts takes each labeller's vote (bad, none, good). Votes are counted by pattern,
   of which there are at most 3 ** labellers, over all documents.
2. EM over the pattern counts estimates, for good and bad texts, how each labeller votes; it gives each
   pattern a posterior.
3. A linear scorer over hashed word shapes learns the posteriors of a bounded sample of documents.
4. A second narrow pass scores every text by the scorer.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import settle, spread
from planframe.llm.words import SEP, Spans, Words, chunks, powers

#: Words of no account that every text is taken to have besides its own, so that a text of a few words is hardly judged.
PLAIN = 8

#: Distinct documents that the scorer is fitted on, those with the least hashes of id and text.
SAMPLE = 4_000

#: Buckets of hashed features; the last three are of repeated words, repeated word runs and texts.
BUCKETS = 1024

#: (measure, bad beyond, good within, least words). Between the bounds, and for shorter texts, is no vote. Most
#: labellers know one defect and never vote good (-1): that a text has no bars says nothing of its repeats.
LABELLERS = (
    ("symbols", 0.08, -1, 3),
    ("odd_words", 0.25, -1, 10),
    ("exclaims", 0.30, -1, 3),
    ("bars", 0.20, -1, 3),
    ("capitals", 0.40, -1, 3),
    ("repeats", 0.20, -1, 5),
    ("copied", 0.40, -1, 30),
    ("sameness", 0.85, 0.5, 50),
    ("long_words", 0.30, -1, 5),
)

_RUN = 8
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[128:] = ord("a")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[*b"#$%&*+/<=>@\\^_`{|}~"]] = True


def _sum(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return np.diff(total[first])


class Texts:
    """Measures and hashed word features of a chunk of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        w = Words(data, at)
        self.first, n = w.first, len(w.hashes)
        self.words = np.diff(w.first)
        doc = np.repeat(np.arange(len(self.words)), self.words)
        some = np.maximum(self.words, 1)
        kind = _CLASS[data]
        solid = np.maximum(_sum(~SEP[data], at), 1)
        letters = np.maximum(_sum((kind == ord("a")) | (kind == ord("A")), at), 1)
        again = np.zeros(n, bool)
        again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (doc[1:] == doc[:-1])
        salt = spread(doc.astype(np.uint64) + np.uint64(1))
        copied = np.zeros(n, bool)
        if n >= _RUN:
            starts = np.arange(n - _RUN + 1)
            starts = starts[doc[starts] == doc[starts + _RUN - 1]]
            run = spread(Spans(w.hashes, 1)(starts, starts + _RUN) ^ salt[starts])
            known = np.zeros(len(starts), bool)
            known[np.unique(run, return_index=True)[1]] = True
            copied[starts[~known]] = True
        distinct = np.bincount(doc[np.unique(spread(w.hashes ^ salt), return_index=True)[1]], minlength=len(self.words)) if n else np.zeros(len(self.words))
        length = w.ends - w.starts
        strange = _SYMBOL[data] | (data == ord("!"))
        total = np.zeros(len(data) + 1, np.int64)
        np.cumsum(strange, out=total[1:])
        odd = total[w.ends] > total[w.starts]
        self.measures = {
            "odd_words": _sum(odd, w.first) / some,
            "symbols": _sum(_SYMBOL[data], at) / solid,
            "exclaims": _sum(data == ord("!"), at) / some,
            "bars": _sum(data == ord("|"), at) / some,
            "capitals": _sum(kind == ord("A"), at) / letters,
            "repeats": _sum(again, w.first) / some,
            "copied": _sum(copied, w.first) / some,
            "sameness": 1 - distinct / some,
            "long_words": _sum(length > 30, w.first) / some,
        }
        # A word's shape: its character classes with runs taken once.
        new = np.ones(len(data), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[w.starts] = True
        order = np.cumsum(new) - 1
        value = np.where(new, spread(kind.astype(np.uint64) + np.uint64(77)), np.uint64(0))
        base = 0x9E3779B97F4A7C15
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(value * powers(base, len(data) + 1)[order], out=total[1:])
        back = powers(pow(base, -1, 1 << 64), len(data) + 1)
        shape = spread((total[w.ends] - total[w.starts]) * back[order[w.starts]]) if n else np.zeros(0, np.uint64)
        self.buckets = (shape % np.uint64(BUCKETS - 3)).astype(np.int64)
        self.again, self.copied, self.doc = again, copied, doc

    def votes(self) -> np.ndarray:
        """The pattern of each text: a base-3 digit for each labeller, 0 bad, 1 none, 2 good."""
        out = np.zeros(len(self.words), np.int64)
        for name, bad, good, least in LABELLERS:
            m = self.measures[name]
            vote = np.where(self.words < least, 1, np.where(m > bad, 0, np.where(m <= good, 2, 1)))
            out = 3 * out + vote
        return out

    def features(self, row: int) -> np.ndarray:
        """The shares of the hashed features of a text."""
        lo, hi = self.first[row], self.first[row + 1]
        x = np.zeros(BUCKETS)
        if hi > lo:
            x[:BUCKETS] = np.bincount(self.buckets[lo:hi], minlength=BUCKETS)
            x[-3], x[-2] = self.again[lo:hi].sum(), self.copied[lo:hi].sum()
            x /= hi - lo + PLAIN
        x[-1] = 1
        return x

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The scorer's probability that each text is good."""
        each = weights[self.buckets] + weights[-3] * self.again + weights[-2] * self.copied
        total = np.bincount(self.doc, each, minlength=len(self.words)) / (self.words + PLAIN)
        return 1 / (1 + np.exp(-(total + weights[-1])))


def digits(pattern: np.ndarray) -> np.ndarray:
    """(patterns, labellers): the votes of patterns."""
    k = len(LABELLERS)
    return np.stack([pattern // 3 ** (k - 1 - i) % 3 for i in range(k)], axis=1)


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of good for each vote pattern, and p(vote | class) as (class, labeller, vote).

    Starts from the mean vote; pseudo-counts hold a labeller that hardly votes near its prior belief.
    """
    n, k = votes.shape
    lean = (votes - 1).sum(axis=1)
    good = np.where(lean < 0, 0.05, np.where(lean == 0, 0.8, 0.95))
    one = votes[:, :, None] == np.arange(3)[None, None, :]
    prior_votes = np.array([[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]])  # bad texts draw votes of bad more often, good ones of good
    table = np.zeros((2, k, 3))
    for _ in range(rounds):
        for c, p in enumerate((1 - good, good)):
            m = np.einsum("n,nkv->kv", p * count, one) + prior_votes[c]
            table[c] = m / m.sum(axis=1, keepdims=True)
        share = ((good * count).sum() + 8.0) / (count.sum() + 10.0)
        loglik = np.einsum("nkv,ckv->nc", one.astype(float), np.log(table)) + np.log([1 - share, share])
        new = 1 / (1 + np.exp(np.clip(loglik[:, 0] - loglik[:, 1], -50, 50)))
        if np.abs(new - good).max() < 1e-6:
            break
        good = new
    return good, table


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1e-5, rounds: int = 800) -> np.ndarray:
    """Logistic weights for soft labels, by gradient descent with momentum.

    The last weight, the intercept, is the labels' log odds and stays: a text without words is as good as most.
    """
    x = x.astype(np.float64)
    w, speed = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    share = (y.sum() + 2) / (len(y) + 3)
    w[-1] = np.log(share / (1 - share))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / max(1, len(y)) + ridge * w
        g[-1] = 0
        speed = 0.95 * speed - 5.0 * g
        w = w + speed
    return w


def least_hashes(hashes: DataFrame, n: int) -> int | None:
    """The ``n``-th least distinct value of a long column, or the greatest of fewer; a task passes on ``n`` values at most."""

    def run(batches):
        kept = np.zeros(0, np.int64)
        for batch in batches:
            kept = np.unique(np.r_[kept, batch.column(0).to_numpy()])[:n]
        yield pa.RecordBatch.from_arrays([pa.array(kept)], ["h"])

    return hashes.mapInArrow(run, "h long").distinct().orderBy("h").limit(n).agg(F.max("h")).first()[0]


def fit(docs: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, dict[int, float]]:
    """The scorer's weights, and the posterior of each vote pattern. Votes are counted over all documents.

    The scorer sees ``sample`` distinct documents: rows of one id and one text are drawn together and count once.
    """
    order = F.xxhash64(F.lit(5), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    least = least_hashes(docs.select(order), sample)
    if least is None:
        return np.zeros(BUCKETS), {}

    def run(batches):
        told = np.zeros(0, np.int64)
        for batch in batches:
            order = batch.column(1).to_numpy()
            for row, data, at in chunks(batch.column(0)):
                t = Texts(data, at)
                pattern = t.votes()
                value, n = np.unique(pattern, return_counts=True)
                own = order[row : row + len(pattern)]
                drawn, rows = np.unique(own, return_index=True)
                new = (drawn <= least) & ~np.isin(drawn, told)
                drawn, rows = drawn[new], rows[new]
                told = np.union1d(told, drawn)
                dense = [t.features(r).astype(np.float32).tobytes() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.r_[value, pattern[rows]]), pa.array(np.r_[n, np.zeros(len(rows), np.int64)]), pa.array([None] * len(value) + drawn.tolist(), pa.int64()), pa.array([None] * len(value) + dense, pa.binary())],
                    ["pattern", "n", "drawn", "features"],
                )

    seen = settle(docs.select(F.col("text").cast("string"), order).mapInArrow(run, "pattern long, n long, drawn long, features binary"), "votes")
    counts = seen.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    pattern, n = counts["pattern"].to_numpy(), counts["n"].to_numpy().astype(float)
    good, _ = expectation_maximisation(digits(pattern), n)
    posterior = dict(zip(pattern.tolist(), good.tolist(), strict=True))
    # A row for each hash drawn, so ``sample`` at most; in the order of the hashes, so that sums come out alike.
    rows = seen.where("drawn is not null").dropDuplicates(["drawn"]).orderBy("drawn").select("pattern", "features").toArrow()
    x = np.stack([np.frombuffer(f, np.float32) for f in rows["features"].to_pylist()])
    y = np.array([posterior[p] for p in rows["pattern"].to_pylist()])
    return fit_linear(x, y), posterior


def judge(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, votes, posterior, score, kept) of every row of ``docs(doc_id, text)``.

    ``votes`` has a letter for each labeller: b bad, - none, g good. ``kept`` is ``score >= least``. A null or
    empty text, and one too short for the labellers, gets no vote; its score is the scorer's intercept
    and whatever its words add. Rows that repeat a doc_id are judged each.
    """
    weights, posterior = fit(docs, sample)
    share = docs.sparkSession.sparkContext.broadcast((weights, posterior))

    def run(batches):
        weights, posterior = share.value
        for batch in batches:
            for row, data, at in chunks(batch.column(1)):
                t = Texts(data, at)
                pattern, score = t.votes(), t.scores(weights)
                letters = np.array(list("b-g"))[digits(pattern)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(score)), pa.array(["".join(x) for x in letters], pa.string()), pa.array([posterior[p] for p in pattern.tolist()], pa.float64()), pa.array(score), pa.array(score >= least)],
                    ["doc_id", "votes", "posterior", "score", "kept"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, votes string, posterior double, score double, kept boolean")


def keep_good(docs: DataFrame, least: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``."""
    weights, _ = fit(docs, sample)
    share = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            kept = [Texts(data, at).scores(share.value) >= least for _, data, at in chunks(text)]
            if kept:
                yield batch.filter(pa.array(np.concatenate(kept)))

    return docs.mapInArrow(run, docs.schema)
