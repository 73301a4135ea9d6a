"""Line dedup, spelling variants and hard negatives against plain loops; repeated ids, extreme vectors and long payloads."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus import ROWS

from planframe.llm import embeddings, line_dedup, minhash, negatives, spelling, warc
from planframe.llm.common import hot_join

LOWER = {i: i + 32 for i in range(65, 91)}
BLANKS = " \t\n\x0b\x0c\r"


def line_rows():
    r = random.Random(8)
    common = ["A line that many hold", "  a LINE that many hold\t", "\x0b ÉCLAIR au chocolat \r", "\xa0nine cps\xa0", "short one", "x" * 30_000]
    rows = []
    for i in range(60):
        lines = [r.choice([*common, f"own line number {r.randint(0, 80)}", "", " "]) for _ in range(r.randint(0, 12))]
        rows.append(((i * 13) % 60, "\n".join(lines)))
    rows += [(70, None), (71, ""), (72, "\n"), (73, "own line number 1\n\nown line number 1"), (74, "A line that many hold")]
    rows += [(74, "A line that many hold")] * 2 + [(3, "A line that many hold\nnot said elsewhere"), (None, "A line that many hold"), (None, None), (80, "\n".join(f"own line number {i % 90}" for i in range(5000)))]
    return rows


def kept_lines(rows):
    keys = defaultdict(set)
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                keys[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key(x)) < 10 or min(keys[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_lines(spark):
    rows = line_rows()
    df = spark.createDataFrame([(*x, 1, 2, 3) for x in rows], "doc_id long, text string, t int, first int, drops int").repartition(5)
    want = kept_lines(rows)
    got = line_dedup.line_digest(df).collect()
    told = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(repr((i, n, g, told(k))) for i, n, g, k in want) == sorted(repr((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256)) for x in got)
    assert sum(g for _, _, g, _ in want) > 1500
    whole = line_dedup.drop_repeated_lines(df)
    assert whole.columns == df.columns
    assert sorted(repr((i, None if t is None else k)) for (i, t), (_, _, _, k) in zip(rows, want, strict=True)) == sorted(repr((x.doc_id, x.text)) for x in whole.collect())


def test_no_lines_at_all(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert line_dedup.line_digest(df).count() == 0 and line_dedup.drop_repeated_lines(df).count() == 0
    nulls = spark.createDataFrame([(1, None), (None, None), (2, "")], "doc_id long, text string")
    assert sorted(str((x.doc_id, x.n_lines, x.n_dropped)) for x in line_dedup.line_digest(nulls).collect()) == ["(1, 1, 0)", "(2, 1, 0)", "(None, 1, 0)"]


def test_bitmaps_are_runs(spark):
    rows = [(1, "a line of ten\nb line of ten\nc line of ten"), (2, "a line of ten\nB line of ten\nnew\nc line of ten")]
    got = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(x.doc_id, [tuple(d) for d in x.drops]) for x in got] == [(2, [(0, 2), (3, 1)])]


def test_streamed_lines_take_one_exchange(spark):
    lines = line_dedup.line_keys(spark.createDataFrame([(1, "a line of ten")], "doc_id long, text string"), 10)
    plan = line_dedup.dropped_lines(lines)._jdf.queryExecution().executedPlan().toString()
    between = plan[plan.index("Window") : plan.index("rangepartitioning")]
    assert "hashpartitioning" not in between and "collect" not in plan.lower()


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def vocabulary():
    r = random.Random(3)
    base = ["".join(r.choice("abé") for _ in range(r.randint(1, 11))) for _ in range(160)]
    stem = "r" * 700
    base += [stem, stem + "r", stem + "rr", "q" + stem, stem[:350] + "x" + stem[351:], stem + "x", "日本語学校", "日本語高校", "日本語校", "🙂🙂🙂🙂🙂", "🙂🙂🙂🙂", "aaaa", "aaaaa", "aaaaaa"]
    base += [w + "s" for w in base[:40]] + [w[1:] for w in base[:40] if len(w) > 1]
    return [(w, r.choice([3, 4, 6, 8, 9, 16, 33, 70])) for w in sorted(set(base))]


@pytest.mark.parametrize("leaf", [1, 4, 30, 100_000])
def test_near_words_are_paired_once(spark, leaf):
    words = vocabulary()
    got = Counter((x.word, x.other, x.n_other) for x in spelling.near_pairs(spark.createDataFrame(words, "word string, n long"), leaf).collect())
    want = Counter((a, b, n) for (a, _), (b, n) in itertools.permutations(words, 2) if near(a, b))
    assert got == want and len(want) > 100


def test_variants_equal_plain_loops(spark):
    words = dict(vocabulary())
    form, count = {}, {}
    for a in words:
        others = [b for b in words if near(a, b)]
        count[a] = len(others)
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best is not None and words[best] >= 2 * words[a] else None

    def root(a):
        return a if form[a] is None else root(form[a])

    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), leaf=20).collect()
    assert len(got) == len(words)
    assert {x.word: (x.n, x.n_near, x.form, x.form_n, x.root) for x in got} == {a: (words[a], count[a], form[a], words.get(form[a]), root(a)) for a in words}
    assert any(form[f] for f in form.values() if f)


def test_vocabulary_of_documents(spark):
    df = spark.createDataFrame([(i, t, 5) for i, t in [*ROWS, (9000, "Straße ÀÀÀÀÀ×÷ Straße,straße x1y2"), (9001, "ÀÀÀÀÀ×÷-ÀÀÀÀÀ×÷")]], "doc_id long, text string, n int")
    got = {x.word: x.n for x in spelling.vocabulary(spelling.word_runs(df).select(F.col("run").alias("word"))).collect()}
    assert got["straße"] == 3 and got["ÀÀÀÀÀ×÷"] == 3 and "x" * 40_000 not in got
    empty = spelling.variants(spelling.vocabulary(spelling.word_runs(df.limit(0)).select(F.col("run").alias("word"))))
    assert empty.count() == 0


def mined(rows, low=80, k=5):
    good = [(i, v, c) for i, v, c in rows if i is not None and c is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, [math.floor(256 * x) for x in v], c) for i, v, c in good]
    good = [r for r in good if sum(x * x for x in r[1]) < 2**63]
    out = []
    for i, v, c in good:
        if i % 10:
            continue
        score = lambda u: sum(x * y for x, y in zip(u, v, strict=True))  # noqa: E731, B023
        near_ = sorted(((-score(u), j, d) for j, u, d in good if len(u) == len(v)), key=lambda t: t[:2])
        for ps, p, _ in [t for t in near_ if t[2] == c and t[1] != i][:k]:
            ns = [t for t in near_ if t[2] != c and low * -ps <= 100 * -t[0] <= 100 * -ps][:k]
            out += [(i, p, n + 1, t[1], -ps, -t[0]) for n, t in enumerate(ns)]
    return out


def vector_rows():
    r = np.random.default_rng(5)
    rows = [(i, (r.normal(size=6) * r.choice([0.1, 1, 3])).tolist(), int(r.integers(0, 4))) for i in range(400)]
    rows += [(1000 + i, [1.0, 1.0, 0.5, 0.0, 0.0, 0.25], i % 2) for i in range(300)]  # ties, a third of all rows
    rows += [(410, None, 1), (420, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (430, [float("nan")] * 6, 1), (440, [float("inf")] * 6, 1), (450, [0.0] * 6, 2), (460, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(470, [0.5, 0.25], 1), (471, [0.5, 0.5], 1), (472, [0.45, 0.4], 2), (480, [], 1), (481, [], 1), (482, [], 2)]
    rows += [(490, [1e200] * 6, 1), (500, [3e6] * 6, 1), (501, [3e6] * 6, 1), (502, [2.9e6] * 6, 2), (503, [3.0e6 + 1 / 256] + [3e6] * 5, 2), (510, [1e-300] * 6, 1)]
    return rows


def test_hard_negatives_equal_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(negatives, "SLICE", 64)
    monkeypatch.setattr(negatives, "GROUP", 8)
    rows = vector_rows()
    df = spark.createDataFrame([(*x, 1, 2) for x in rows], "vec_id long, embedding array<double>, label int, part int, low int").repartition(3)
    got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0).collect()
    want = mined(rows)
    assert sorted(want) == sorted(tuple(x) for x in got) and len(want) > 300
    assert any(abs(w[4]) > 2**53 for w in want)
    assert negatives.hard_negatives(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert negatives.hard_negatives(df, F.col("vec_id") < 0).count() == 0


def test_an_id_with_two_contents_joins_their_classes(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (7, b), (9, "alone and by itself here")], "doc_id long, text string")
    assert sorted((x.doc_id, x.component_id, x.kept) for x in minhash.near_duplicates(docs).collect()) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 3, False), (9, 9, True)]
    vectors = spark.createDataFrame([(3, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (7, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted((x.vec_id, x.component_id) for x in embeddings.near_vectors(vectors).collect()) == [(3, 3), (5, 3), (5, 3), (7, 3)]


def test_vectors_whose_squares_leave_a_double(spark):
    big, small = [1e200] * 16, [1e-200] * 16
    rows = [(1, big, 0), (2, [1e200] * 15 + [1.01e200], 0), (3, small, 1), (4, [1e-200] * 15 + [1.01e-200], 1), (5, [1e-200, *[0.0] * 15], 1), (6, [5e-324] * 16, 2), (7, [1.0] * 16, 2)]
    got = embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert {x.vec_id: (x.n_links, x.component_id) for x in got} == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5), 6: (1, 6), 7: (1, 6)}


def test_a_long_payload_comes_back(spark):
    text = "".join(chr(33 + i % 90) for i in range(1000)) * 12_000
    got = warc.round_trip(spark.createDataFrame([(1, "u", text), (2, "v", "short")], "page_id long, url string, html string")).collect()
    assert {x.page_id: (x.payload_bytes, x.complete) for x in got} == {1: (len(text), True), 2: (5, True)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_a_hot_key_is_dealt_out(spark, how):
    left = spark.range(20_000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id AS v")
    right = left.where("k % 5 <> 1 or k = 7").groupBy("k").agg(F.count(F.lit(1)).alias("_n"), F.max("v").alias("m")).where("k is not null")
    got = hot_join(left, right, ["k"], "_n", 20_000, how)
    want = left.join(right.drop("_n"), "k", how).select("k", "v", "m")
    assert got.columns == ["k", "v", "m"]
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "_deal" in plan[plan.index("LeftOuter") - 80 : plan.index("LeftOuter")]  # a key of the join, so that hot rows are not dealt by k
