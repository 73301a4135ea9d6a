"""Operators without SQL against plain Python: votes, EM and scorer; fingerprints; token digests; recall of vectors; the pipeline."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from test_corpus import ROWS, WORD, component_of, removed, shingles
from tokenizers import Tokenizer

from planframe.llm import bpe, embeddings, fingerprints, minhash, packing, quality, queries, url_filter, warc
from planframe.llm.words import Words

M = (1 << 64) - 1


def mixed(x):
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & M
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & M
    return x ^ (x >> 31)


def junk_and_prose():
    r = random.Random(21)
    word = lambda: "".join(r.choice("aeiouélmnrst") for _ in range(r.randint(2, 9)))
    prose = [". ".join(" ".join(word() for _ in range(r.randint(4, 12))).capitalize() for _ in range(r.randint(1, 9))) + "." for _ in range(60)]
    bad = [" ".join(word() + r.choice(["%%", "$$$", "!!"]) for _ in range(40)) for _ in range(12)] + [" ".join([word()] * 55) for _ in range(8)] + ["A | B | " * 20, "X" * 40 + " " + word() + " " + word() + " q w", "BUY NOW!!! " * 6]
    run = " ".join(word() for _ in range(8))
    return [(i, t) for i, t in enumerate([*prose, *bad, " ".join([run] * 5), None, "", "Yes.", "a b"])] + [(3, prose[3]), (3, "another text")]


def measures(text):
    data = (text or "").encode()
    words = data.split()
    n = max(1, len(words))
    symbols = set(b"#$%&*+/<=>@\\^_`{|}~")
    blanks = set(b" \t\n\x0b\x0c\r")
    upper = sum(65 <= b <= 90 for b in data)
    letters = upper + sum(97 <= b <= 122 or b >= 128 for b in data)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    m = {
        "symbols": sum(b in symbols for b in data) / max(1, sum(b not in blanks for b in data)),
        "odd_words": sum(any(b in symbols or b == 33 for b in w) for w in words) / n,
        "exclaims": data.count(b"!") / n,
        "bars": data.count(b"|") / n,
        "capitals": upper / max(1, letters),
        "repeats": sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        "copied": sum(x in runs[:i] for i, x in enumerate(runs)) / n,
        "sameness": 1 - len(set(words)) / n,
        "long_words": sum(len(w) > 30 for w in words) / n,
    }
    votes = ""
    for name, bad, good, least in quality.LABELLERS:
        votes += "-" if len(words) < least else "b" if m[name] > bad else "g" if m[name] <= good else "-"
    return words, runs, votes


def posteriors(patterns):
    """Expectation-maximisation over vote patterns with their counts, by loops."""
    kinds = "b-g"
    good = {p: {-1: 0.05, 0: 0.8, 1: 0.95}[int(np.sign(p.count("g") - p.count("b")))] for p in patterns}
    for _ in range(100):
        table = []
        for c in (0, 1):
            rows = []
            for k in range(len(quality.LABELLERS)):
                mass = [[2.0, 1.0, 1.0], [1.0, 1.0, 2.0]][c][:]
                for p, n in patterns.items():
                    mass[kinds.index(p[k])] += n * (good[p] if c else 1 - good[p])
                rows.append([x / sum(mass) for x in mass])
            table.append(rows)
        total = sum(patterns.values())
        share = (sum(good[p] * n for p, n in patterns.items()) + 8) / (total + 10)
        new = {}
        for p in patterns:
            ll = [math.log(s) + sum(math.log(table[c][k][kinds.index(v)]) for k, v in enumerate(p)) for c, s in ((0, 1 - share), (1, share))]
            new[p] = 1 / (1 + math.exp(min(50, max(-50, ll[0] - ll[1]))))
        done = max(abs(new[p] - good[p]) for p in patterns) < 1e-6
        if done:
            break
        good = new
    return good


def bucket(word):
    kind = lambda b: 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b
    total, i, last = 0, 0, None
    for b in word:
        if kind(b) != last:
            total = (total + mixed(kind(b) + 77) * pow(0x9E3779B97F4A7C15, i, 1 << 64)) & M
            i, last = i + 1, kind(b)
    return mixed(total) % (quality.BUCKETS - 3)


def test_quality_equals_plain_loops(spark):
    rows = junk_and_prose()
    told = [measures(t) for _, t in rows]
    good = posteriors(Counter(v for _, _, v in told))
    xs, ys, known = [], [], set()
    every = []
    for (i, t), (words, runs, votes) in zip(rows, told, strict=True):
        x = np.zeros(quality.BUCKETS)
        for w in words:
            x[bucket(w)] += 1
        x[-3] = sum(a == b for a, b in zip(words, words[1:], strict=False))
        x[-2] = sum(r in runs[:k] for k, r in enumerate(runs))
        x /= len(words) + quality.PLAIN
        x[-1] = 1
        every.append(x)
        if (i, t) not in known:  # rows of one id and text count once
            known.add((i, t))
            xs.append(x)
            ys.append(good[votes])
    x, y = np.array(xs), np.array(ys)
    w, speed = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    w[-1] = math.log((y.sum() + 2) / (len(y) + 3) / (1 - (y.sum() + 2) / (len(y) + 3)))
    for _ in range(800):
        p = 1 / (1 + np.exp(-(x @ w)))
        g = x.T @ (p - y) / len(y) + 1e-5 * w
        g[-1] = 0
        speed = 0.95 * speed - 5.0 * g
        w = w + speed
    want = sorted((i, len(t or ""), v, round(good[v], 5), round(float(1 / (1 + math.exp(-(e @ w)))), 3)) for (i, t), (_, _, v), e in zip(rows, told, every, strict=True))
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, votes string").repartition(3)
    length = {}
    got = []
    for r in quality.judge(df).collect():
        got.append((r.doc_id, r.votes, round(r.posterior, 5), round(r.score, 3), r.kept))
        length[r.doc_id] = r.score
    assert sorted(g[:4] for g in got) == sorted((i, v, a, b) for i, _, v, a, b in want)
    assert all(k == (s >= 0.5) for *_, s, k in got if abs(s - 0.5) > 0.01)
    assert 15 <= sum(not g[4] for g in got) <= 30


def test_sample_is_bounded_when_all_rows_are_alike(spark):
    same = spark.createDataFrame([(None, "one text of some words")] * 400 + [(i, f"text {i} of some words") for i in range(30)], "doc_id long, text string").repartition(4)
    weights, posterior = quality.fit(same, sample=10)
    assert len(weights) == quality.BUCKETS and len(posterior) == 1
    from pyspark.sql import functions as F

    h = same.select(F.xxhash64(F.lit(5), "doc_id", "text").alias("h"))
    values = sorted({r.h for r in h.collect()})
    assert quality.least_hashes(h, 10) == values[9] and quality.least_hashes(h, 500) == values[-1]


def test_fingerprints_equal_plain_sets(spark):
    rows = [*ROWS, (None, "a null id of its own"), (None, None)] + [(900 + i, " ".join(f"w{(i * 7 + k) % 400}" for k in range(i))) for i in range(0, 60, 3)]
    hashed = {}

    def term(word):
        if word not in hashed:
            data = np.frombuffer(word.encode(), np.uint8)
            hashed[word] = int(Words(data, np.array([0, len(data)]), lower=True).hashes[0])
        return hashed[word]

    words = [[w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(t or "")] for _, t in rows]
    df = Counter(w for ws, (_, t) in zip(words, rows, strict=True) if t is not None for w in set(ws))
    least, most = 0.02, 0.3
    low, high = max(2, math.ceil(least * len(rows))), max(2, int(most * len(rows)))
    lexicon = {w for w, n in df.items() if low <= n <= high}
    shares = [k for k, n in enumerate(fingerprints.LEXICONS) for _ in range(n)]

    def codes(text):
        ws = [w.translate({k: k + 32 for k in range(65, 91)}) for w in WORD.findall(text)]
        own = sorted({term(w) for w in ws if w in lexicon})
        out = []
        for k, share in enumerate(shares):
            salt = mixed((k + 1) * 0xD1B54A32D192ED03 & M)
            some = [h for h in own if mixed(h ^ salt) <= M >> share]
            out.append((int.from_bytes(hashlib.sha1(np.array(some, np.uint64).tobytes()).digest()[:4], "big") or 1) if some else 0)
        if not any(out):
            out = [int.from_bytes(hashlib.sha1(b"text" + np.array([term(w) for w in ws], np.uint64).tobytes()).digest()[:4], "big") or 1] * len(out)
        return out

    def alike(a, b):
        used = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in used) / len(used) if used else 1.0

    order = sorted(((i, t or "") for i, t in rows), key=lambda x: (math.inf if x[0] is None else -x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        changed = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = codes(t), codes(changed), codes(after)
        hexed = lambda x: "".join(f"{v:08x}" for v in x)
        want.append((i, len(t), hashlib.sha256(changed.encode()).hexdigest(), hexed(a), hexed(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ordered = lambda rows: sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r))
    for shared in (fingerprints.LEXICON, 100):  # a lexicon that is broadcast, and one that is joined
        got = fingerprints.compare(docs, least, most, shared).collect()
        assert ordered(want) == ordered((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got)
    assert len(lexicon) > 100


def test_fingerprints_of_null_ids_alone(spark):
    docs = spark.createDataFrame([(None, "b"), (None, "a"), (None, None)], "doc_id long, text string")
    for shared in (fingerprints.LEXICON, -1):
        got = fingerprints.compare(docs, shared=shared).collect()
        assert sorted(r.n_chars for r in got) == [0, 1, 1]
        assert fingerprints.compare(docs.limit(0), shared=shared).count() == 0


def test_token_digests_equal_the_library(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    rows = [*ROWS, (700, "<|endoftext|>  x y\x1c\x85 don't 12345"), (701, "a\r\n\r\n  b\t\tc   ")]
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want.append(repr((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())))
    got = bpe.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    assert sorted(want) == sorted(repr((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256)) for r in got)


@pytest.mark.parametrize("rotations", [None, 1, 2, 3])
def test_all_planted_vectors_are_found(spark, rotations):
    r = np.random.default_rng(11)
    x = r.normal(size=(400, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = r.normal(size=(400, 64))
    y -= (x * y).sum(axis=1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    near = r.uniform(0.925, 0.99, 400)[:, None]
    v = np.concatenate([x, near * x + np.sqrt(1 - near**2) * y])
    v[7] = v[3]
    rows = [(i, e.tolist(), 5, 0, 0) for i, e in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, place int, codes int")
    cos = v @ v.T / np.linalg.norm(v, axis=1)[:, None] / np.linalg.norm(v, axis=1)[None, :]
    linked = [(a, b) for a, b in zip(*np.nonzero(np.triu(cos >= 0.93, 1)), strict=True)]
    want, links = component_of(range(len(v)), linked), Counter(int(k) for pair in linked for k in pair)
    got = embeddings.near_vectors(df, rotations=rotations).collect()
    assert len(linked) > 300
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == {i: (links[i], want[i]) for i in range(len(v))}


def test_rotations_grow_with_the_largest_label():
    assert [embeddings.rotations_for(n, 64, 3) for n in (0, 1000, 150_000, 1_000_000, 10_000_000, 1_000_000_000)] == [1, 1, 1, 2, 2, 3]
    assert embeddings.tables_for(0.93, 64, 3, 1) < embeddings.tables_for(0.93, 64, 3, 2) < embeddings.tables_for(0.93, 64, 3, 3) < 20


def test_vectors_that_share_an_id(spark):
    a, b, c = [1.0, 0.0, 0.2], [0.0, 1.0, 0.1], [0.0, 1.0, 0.12]
    df = spark.createDataFrame([(1, a, 0), (1, b, 0), (2, c, 0), (3, a, 0)], "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_a_large_chained_component_and_repeated_ids(spark):
    r = random.Random(31)
    base = [f"t{i}" for i in range(220)]
    rows = []
    for i in range(700):  # a chain of sizes, so that neighbours link and the ends do not
        words = base[: 90 + i % 130]
        if i % 3:
            words = [*words]
            words[r.randrange(len(words))] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(5, "other text altogether, under an id that is taken"), (800, "other text altogether, under an id that is taken"), (5, None)]
    sets = [(i, shingles(t, 5)) for i, t in rows]
    linked = [(a[0], b[0]) for k, a in enumerate(sets) for b in sets[:k] if a[1] and b[1] and 5 * len(a[1] & b[1]) >= 4 * len(a[1] | b[1])]
    want = component_of({i for i, _ in rows}, linked)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and want[800] == want[5]
    assert all(x.component_id == want[x.doc_id] for x in got if x.n_shingles)


def test_sequences_are_as_few_as_the_tokens_ask_for():
    import duckdb

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    for sf in ("sf0.01", "sf0.1"):
        texts = [x or "" for (x,) in duckdb.sql(f"SELECT text FROM '/root/testdata/{sf}/documents.parquet'").fetchall()]
        h = defaultdict(int)
        for e in t.encode_batch(texts, add_special_tokens=False):
            h[4096] += (len(e.ids) + 1) // 4096
            if (len(e.ids) + 1) % 4096:
                h[(len(e.ids) + 1) % 4096] += 1
        kinds = packing.best_plan(dict(h), 4096)
        assert sum(n for _, n in kinds) == -(-sum(k * n for k, n in h.items()) // 4096)


def test_empty_tables(spark):
    none = lambda schema: spark.createDataFrame([], schema)
    assert url_filter.judge(none("page_id long, url string"), none("page_id long, bad boolean")).count() == 0
    assert warc.round_trip(none("page_id long, url string, html string")).count() == 0
    assert embeddings.near_vectors(none("vec_id long, embedding array<float>, label int")).count() == 0
    assert set(queries.SQL) <= set(queries.QUERIES)


def test_mined_rules_of_three_tokens(spark):
    # Only all three tokens together tell a bad page: each pair of them is mostly fine.
    pages, labels, i = [], [], 0
    for a in (0, 1):
        for b in (0, 1):
            for c in (0, 1):
                for _ in range(30 if a + b + c == 3 else 40):
                    i += 1
                    pages.append((i, f"http://{'red' if a else 'blue'}-{"cat" if b else "dog"}.shop.info/{'x' if c else 'y'}/{i}"))
                    labels.append((i, a + b + c == 3))
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad boolean"), confidence=0.9).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i, bad in labels if bad}
    assert all(len(r.mined.split(" ")) >= 3 for r in got if r.mined)


def test_the_whole_pipeline(spark, tmp_path):
    r = random.Random(17)
    word = lambda: "".join(r.choice("aeiouklmnrst") for _ in range(r.randint(2, 8)))
    text = lambda n: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(n)) + "."
    passage = text(8)
    prose = [text(r.randint(3, 12)) for _ in range(60)]
    prose += [prose[4], prose[5] + " end", text(4) + " " + passage, text(5) + " " + passage + " " + text(2)]
    junk = [" ".join(word() + "$$%" for _ in range(60)) for _ in range(10)] + [" ".join([word()] * 60) for _ in range(6)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(prose + junk)] + [(500, None, "en", "web", 0), (501, "", "en", "web", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = {x.doc_id for x in quality.judge(docs).collect() if x.kept}
    assert not kept & set(range(len(prose), len(prose) + len(junk))) and set(range(len(prose))) <= kept
    left = {i: t for i, t, *_ in rows if i in kept}
    sets = {i: shingles(t, 5) for i, t in left.items()}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    up = component_of(left, linked)
    left = {i: t for i, t in left.items() if up[i] == i}
    assert 60 not in left and 61 not in left
    gone = {i: n for i, _, n, _ in removed(list(left.items()))}
    assert gone[63] > 50 and sum(gone.values()) == gone[63]
    words = WORD.findall(left[63])
    first = {tuple(WORD.findall(left[62])[j : j + 50]) for j in range(len(WORD.findall(left[62])) - 49)}
    out = {k for j in range(len(words) - 49) if tuple(words[j : j + 50]) in first for k in range(j, j + 50)}
    left[63] = " ".join(w for k, w in enumerate(words) if k not in out)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((i, len(t.encode(x or "", add_special_tokens=False).ids) + 1) for i, x in left.items())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((x.doc_id, x.length) for x in got) == want
    places = defaultdict(list)
    for x in got:
        places[x.sequence_id].append((x.offset, x.length))
    assert len(places) == -(-sum(n for _, n in want) // 4096)
    assert all(at == sum(n for _, n in sorted(p)[:k]) for p in places.values() for k, (at, _) in enumerate(sorted(p)))
