"""Spelling variants: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

The vocabulary's trie is cut into subtries by prefix: a prefix with more than LEAF words is cut at about twice
its depth again. Two words at distance one part at one node of the trie. If that node lies within a subtrie, the
subtrie's task finds the pair. If it lies above, between two cuts, the words agree after the lower cut, so the
stretches between the cuts of all words with one upper prefix and one rest are a trie of their own.

A task holds the tries of some groups and propagates active nodes: a node and its sibling, or a node and its
parent, are at distance one, and from then on both go down by equal letters. Where both end a word, the two
words are a pair.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, runs, settle, unsettle

#: Words of a subtrie that is not cut further.
LEAF = 1024

#: Letters whose tries a task holds at a time, and pairs of nodes that it starts from at a time.
LETTERS, PAIRS = 200_000, 500_000

#: Fixed value: what a word is made of.
RUN = r"[A-Za-zÀ-ÿ]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BITS = np.int64(21)


def word_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, run): every maximal run of letters of ``docs(doc_id, text)``, A-Z lower-cased; a null text has none."""
    text = F.translate(docs["text"].cast("string"), _UPPER, _LOWER)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.explode(F.regexp_extract_all(text, F.lit(RUN), 0)).alias("run"))


def vocabulary(words: DataFrame, length: int = 5, count: int = 3) -> DataFrame:
    """(word, n) of the words of ``words(word)`` with ``length`` code points and ``count`` rows or more; null is no word."""
    return words.where(F.char_length("word") >= length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= count)


class Trie:
    """The tries of some groups of strings as arrays. Nodes are numbered by depth, the groups' roots first."""

    def __init__(self, group: np.ndarray, letters: np.ndarray, at: np.ndarray):
        size = np.diff(at)
        self.roots = int(group.max()) + 1 if len(group) else 0
        self.end = group.astype(np.int64)  # the node of each string
        node, alive, keys, total = self.end.copy(), np.arange(len(group)), [], self.roots
        for d in range(int(size.max()) if len(size) else 0):
            alive = alive[size[alive] > d]
            made, which = np.unique((node[alive] << _BITS) | letters[at[alive] + d], return_inverse=True)
            node[alive] = total + which
            keys.append(made)
            total += len(made)
        self.end = node
        self.nodes = total
        #: parent << 21 | letter of each node that is no root; ascending, as parents are numbered before children.
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.letter = self.keys & ((np.int64(1) << _BITS) - 1)
        self.first = np.searchsorted(self.keys, np.arange(total + 1, dtype=np.int64) << _BITS) + self.roots

    def down(self, a: np.ndarray, b: np.ndarray, other_than: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of children of the node pairs by equal letters, less those by the letter in ``other_than``."""
        times = self.first[a + 1] - self.first[a]
        child = np.repeat(self.first[a] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        letter = self.letter[child - self.roots]
        want = (np.repeat(b, times) << _BITS) | letter
        found = np.searchsorted(self.keys, want)
        ok = found < len(self.keys)
        ok[ok] = self.keys[found[ok]] == want[ok]
        if other_than is not None:
            ok &= letter != np.repeat(other_than, times)
        return child[ok], found[ok] + self.roots

    def active(self):
        """Yields (a, b, kind) with arrays of all node pairs at distance one: b has another letter somewhere (kind 0), lacks a's last letter (1) or one before (2)."""
        parents = np.flatnonzero(np.diff(self.first) > 0)
        fan = np.diff(self.first)[parents]
        share = np.cumsum(fan * (fan + 1) // 2) // PAIRS
        for lo, hi in _cuts(share):
            some, n = parents[lo:hi], fan[lo:hi]
            child = np.repeat(self.first[some] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            parent = np.repeat(some, n)
            later = np.repeat(self.first[some + 1], n) - child - 1  # siblings after this one
            a = np.repeat(child, later)
            b = a + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
            while len(a):
                yield a, b, 0
                a, b = self.down(a, b)
            a, b, skip = child, parent, self.letter[child - self.roots]
            while len(a):
                yield a, b, 2 if skip is None else 1
                a, b = self.down(a, b, skip)
                skip = None


def _cuts(share: np.ndarray):
    """Ranges of equal values."""
    at = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(share)]
    return [(lo, hi) for lo, hi in zip(at[:-1], at[1:], strict=True) if hi > lo]


def distance_one(group: np.ndarray, role: np.ndarray, letters: np.ndarray, at: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row, row) of strings of one group at distance one: equal lengths among roles 1, and longer roles 2 with shorter roles 1.

    A shorter string that is ``cut``, so that its word may go on, has no pair that lacks a letter at its end: those
    words part at the cut or below it, and another group has the pair.
    """
    trie = Trie(group, letters, at)
    same, longer = np.full((2, trie.nodes), -1, np.int64)
    rows = np.arange(len(group))
    same[trie.end[role & 1 > 0]] = rows[role & 1 > 0]
    longer[trie.end[role & 2 > 0]] = rows[role & 2 > 0]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b, kind in trie.active():
        x, y = (longer if kind else same)[a], same[b]
        both = (x >= 0) & (y >= 0)
        if kind == 1:
            both &= ~cut[y]
        left.append(x[both])
        right.append(y[both])
    return np.concatenate(left), np.concatenate(right)


def subtries(vocab: DataFrame, leaf: int) -> DataFrame:
    """(k1, k2, role, part, cut, word, n): each word in its subtrie, and between the cuts above it; ``cut`` tells a part that reaches the lower cut."""

    def rest(at: int) -> Column:
        return F.expr(f"substring(word, {at + 1})")

    def rows(df: DataFrame, place: list[Column], role: int, part: Column, cut: Column) -> DataFrame:
        return df.select(F.xxhash64(*place).alias("k1"), F.xxhash64(F.lit(1), *place).alias("k2"), F.lit(role).alias("role"), part.alias("part"), cut.alias("cut"), "word", "n")

    open_, count, depth, out = vocab, vocab.count(), 0, []
    over = count > leaf
    if not over:
        return rows(vocab, [F.lit(-1), F.lit("")], 3, F.col("word"), F.lit(False))
    while over:
        lower = max(2, 2 * depth)
        upper = F.substring("word", 1, depth)
        between = open_.where(F.char_length("word") >= depth)
        out.append(rows(between, [F.lit(depth), upper, rest(lower)], 1, F.expr(f"substring(word, {depth + 1}, {lower - depth})"), F.char_length("word") >= lower))
        out.append(rows(between.where(F.char_length("word") > depth), [F.lit(depth), upper, rest(lower + 1)], 2, F.expr(f"substring(word, {depth + 1}, {lower + 1 - depth})"), F.lit(False)))
        depth = lower
        head = F.substring("word", 1, depth)
        sizes = open_.groupBy(head.alias("_head")).agg(F.count(F.lit(1)).alias("_size")).withColumn("_n", F.col("_size"))
        sized = settle(hot_join(open_.withColumn("_head", head), sizes, ["_head"], "_n", count), "subtries")
        out.append(rows(sized.where(F.col("_size") <= leaf), [F.lit(-1), F.col("_head")], 3, rest(depth), F.lit(False)))
        open_ = sized.where(F.col("_size") > leaf).select("word", "n")
        over = not open_.isEmpty()
    whole = out[0]
    for df in out[1:]:
        whole = whole.unionByName(df)
    return whole


def near_pairs(vocab: DataFrame, leaf: int = LEAF) -> DataFrame:
    """(word, other, n_other): both directions of every pair of words at distance one, each once.

    ``vocab(word, n)`` has unique words. One inserted, deleted or replaced code point is a distance of one.
    The words of a task's group share their prefix and, above a subtrie, all but the letters between two cuts.
    """

    def run(batches):
        held, letters = [], 0
        for t in runs(batches, 2):
            if len(t) < 2:
                continue
            held.append(t)
            letters += t["part"].nbytes
            if letters > LETTERS:
                yield _pairs_of(held)
                held, letters = [], 0
        if held:
            yield _pairs_of(held)

    dealt = subtries(vocab, leaf).repartition("k1", "k2").sortWithinPartitions("k1", "k2")
    return dealt.mapInArrow(run, "word string, other string, n_other long")


def _pairs_of(tables: list[pa.Table]) -> pa.RecordBatch:
    group = np.repeat(np.arange(len(tables)), [len(t) for t in tables])
    whole = pa.concat_tables(tables).combine_chunks()
    parts = [p.encode("utf-32-le") for p in whole["part"].to_pylist()]
    at = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) // 4 for p in parts], out=at[1:])
    letters = np.frombuffer(b"".join(parts), np.uint32).astype(np.int64)
    a, b = distance_one(group, whole["role"].to_numpy(), letters, at, whole["cut"].to_numpy())
    one, other = pa.array(np.concatenate([a, b])), pa.array(np.concatenate([b, a]))
    words = whole["word"].combine_chunks()
    return pa.RecordBatch.from_arrays([words.take(one), words.take(other), whole["n"].combine_chunks().take(other)], ["word", "other", "n_other"])


def variants(vocab: DataFrame, times: int = 2, leaf: int = LEAF) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``vocab(word, n)``.

    ``n_near`` counts the words at distance one. ``form`` is the one of largest n (ties: the smallest in
    code-point order) if its n is at least ``times`` that of the word, else null; ``form_n`` is its n. ``root``
    follows the forms to the last and is the word itself without a form. ``times`` is 2 or more, so a chain of
    forms has at most 63 words and each round of joins doubles what it has followed. An empty table gives no rows.
    """
    vocab = settle(vocab.select("word", F.col("n").cast("long").alias("n")), "vocabulary")
    near = near_pairs(vocab, leaf).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("m"), "other")).alias("best"))
    table = vocab.join(near, "word", "left").withColumn("form_n", F.when(-F.col("best.m") >= times * F.col("n"), -F.col("best.m")))
    table = table.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("form_n").isNotNull(), F.col("best.other")).alias("form"), "form_n")
    table = settle(table, "forms")
    up = table.where("form is not null").select("word", F.col("form").alias("root"))
    last = None
    while True:
        follow = up.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        new = settle(up.join(follow, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = not new.where("_moved").isEmpty()
        up = new.drop("_moved")
        if last is not None:
            unsettle(last)
        last = new
        if not moved:
            break
    return table.join(up, "word", "left").withColumn("root", F.coalesce("root", "word"))
