"""Corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planframe.llm import bpe, components, embeddings, fingerprints, minhash, packing, quality, sharding, substrings, url_filter, warc
from planframe.llm.common import numbered
from planframe.llm.words import Words, chunks

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def made_documents():
    r = random.Random(4)
    vocabulary = ["w" + str(i) for i in range(400)] + ["É", "naïve", "日本", "🙂x", "Ab,", "c."]
    base = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 160))) for _ in range(30)]
    passage = " ".join(r.choice(vocabulary) for _ in range(70))
    rows, i = [], 0
    for b in base:
        words = b.split()
        near = list(words)
        near[r.randrange(len(near))] = "changed"
        for t in (b, " ".join(near), b.upper() if r.random() < 0.3 else b, " ".join(words[:5] + passage.split() + words[5:])):
            rows.append((i * 7 % 121, t))
            i += 1
    rows += [(500, None), (501, ""), (502, " \n\t "), (503, "one"), (504, "one two"), (505, "one two"), (506, "one two three"), (507, " ".join(r.choice(vocabulary) for _ in range(9000))), (508, "x" * 40_000)]
    rows += [(508, "x" * 40_000), (None, "a row without an id"), (None, None)]
    return rows


ROWS = made_documents()
SCHEMA = "doc_id long, text string, _id long, band int"


@pytest.fixture(scope="module")
def docs(spark):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(*r, 1, 2) for r in ROWS], SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_kernel_equals_regex():
    texts = [t for _, t in ROWS]
    for _, data, at in chunks(pa.array(texts, pa.string()), 2000):
        w = Words(data, at, lower=True)
        assert len(w.first) == len(at)
    whole = next(iter(chunks(pa.array(texts, pa.string()), 1 << 30)))
    w = Words(whole[1], whole[2])
    for k, t in enumerate(texts):
        own = [bytes(w.data[a:b]).decode() for a, b in zip(w.starts[w.first[k] : w.first[k + 1]], w.ends[w.first[k] : w.first[k + 1]], strict=True)]
        assert own == WORD.findall(t or "")
    by = defaultdict(set)
    for h, a, b in zip(w.hashes.tolist(), w.starts, w.ends, strict=True):
        by[h].add(bytes(w.data[a:b]))
    assert all(len(x) == 1 for x in by.values())


def shingles(t, k):
    w = WORD.findall((t or "").translate(LOWER))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set())


def component_of(ids, linked):
    up = {i: i for i in ids}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in linked:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    sets = {i: shingles(t, k) for i, t in ROWS if i is not None}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = component_of(sets, linked)
    got = minhash.near_duplicates(docs, k, percent).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_block_verification_of_large_groups():
    r = random.Random(1)
    base = [r.getrandbits(63) for _ in range(60)]
    grams = [np.unique(np.array([x if r.random() > 0.04 else r.getrandbits(63) for x in base], np.uint64)) for _ in range(90)]
    got = minhash.similar(grams, 85)
    for i in range(90):
        for j in set(range(90)) - {i}:
            n = len(np.intersect1d(grams[i], grams[j]))
            assert got[i, j] == (100 * n >= 85 * (len(grams[i]) + len(grams[j]) - n))


def test_components_of_a_long_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5, 5)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 341
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def removed(rows, window=50):
    """(doc_id, words, removed words, hash of the kept ones) of each row, by comparing all windows."""
    first, out = {}, []
    for i, t in rows:
        w = WORD.findall(t or "")
        for j in range(len(w) - window + 1) if i is not None else ():
            first[tuple(w[j : j + window])] = min(i, first.get(tuple(w[j : j + window]), i))
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = {k for j in range(len(w) - window + 1) if i is not None and first[tuple(w[j : j + window])] < i for k in range(j, j + window)}
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest()))
    return out


def digests(df):
    return sorted(map(repr, [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()]))


def test_removed_passages(docs):
    want = removed(ROWS)
    assert sum(x[2] for x in want) > 1000
    assert digests(substrings.removal_digest(docs)) == sorted(map(repr, want))


def test_removed_passages_where_ids_repeat_and_hashes_collide(spark):
    r = random.Random(12)
    word = lambda n: " ".join("v" + str(r.randrange(900)) for _ in range(n))
    passage, other = word(80), word(64)
    rows = [(1, word(40) + " " + passage), (2, word(30) + " " + passage + " " + word(9)), (2, "short " + word(20)), (2, passage + " " + other), (2, passage + " " + other), (3, other + " " + word(5)), (3, None), (None, passage), (4, other + passage[:200] + " " + other)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert digests(substrings.removal_digest(df)) == sorted(map(repr, removed(rows)))
    # With 7 bits the first hashes of nearly all windows collide; the second ones and the words themselves still tell them apart.
    assert digests(substrings.removal_digest(df, bits=7)) == sorted(map(repr, removed(rows)))
    cut = substrings.drop_repeats(df).collect()
    assert sorted(len(WORD.findall(x.text or "")) for x in cut) == sorted(n - gone for _, n, gone, _ in removed(rows))


def test_byte_level_bpe_equals_the_library(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    ours = bpe.PairIndexBPE(path)
    odd = ["", " ", "  a  b \n\n c", "aaaaaaaaa <|endoftext|>x<|endoftext|>", " 's it's　x  y\x1c z\u0085q", "日本語🙂🙂 ١٢٣ ½", "<|endoftext|> \n<|endoftext|", "a\n b \t", "don't we'll  I'm"]
    texts = odd + [x or "" for _, x in ROWS]
    ours.learn_all(texts)
    ids, at = ours.encode(texts)
    decoded = ours.decode(ids, at)
    for k, x in enumerate(texts):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids[at[k] : at[k + 1]].tolist() == want
        assert decoded[k] == t.decode(want, skip_special_tokens=False) == x
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(docs, path), path).collect() if r.doc_id is not None}
    assert back == {i: x or "" for i, x in ROWS if i is not None}


def test_packing_holds_every_piece(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path, length=512, with_ids=True).collect()
    ids = defaultdict(list)
    for i, x in ROWS:
        ids[i].append(t.encode(x or "", add_special_tokens=False).ids + [1])
    total, placed = 0, defaultdict(list)
    for r in got:
        assert any(d[r.start : r.start + 512] == list(r.ids) for d in ids[r.doc_id]) and r.length == len(r.ids) and r.start == 512 * r.piece
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        placed[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(d) for ds in ids.values() for d in ds)
    for parts in placed.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    assert len(placed) <= -(-total // 512) * 1.05 + 1
    assert packing.pack(none, path).count() == 0


def test_plans_hold_the_histogram():
    r = random.Random(2)
    for n in (1, 5, 400):
        h = defaultdict(int)
        for _ in range(n):
            h[min(4096, int(r.expovariate(1 / 900)) + 1)] += r.randint(1, 50)
        kinds = packing.best_plan(dict(h), 4096)
        back = defaultdict(int)
        for kind, times in kinds:
            assert sum(kind) <= 4096 and times > 0
            for k in kind:
                back[k] += times
        assert back == h


def test_nnls_meets_its_conditions():
    r = np.random.default_rng(3)
    a, b = r.random((12, 30)), r.random(12) * 5
    x = packing.nnls(a, b)
    gradient = a.T @ (a @ x - b)
    assert (x >= 0).all() and gradient.min() > -1e-6 and np.abs(gradient[x > 1e-9]).max() < 1e-6


def test_fingerprints(spark, docs, none):
    got = fingerprints.compare(docs).collect()
    assert len(got) == len(ROWS)
    single = sorted((i, t or "") for i, t in {(i, t) for i, t in ROWS if i not in (None, 508)})[::-1]
    following = dict(zip([i for i, _ in single], single[1:], strict=False))
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    for i, t in single[:-1]:
        want = fingerprints.edited(t, following[i][1])
        assert by[i].n_chars == len(t) and by[i].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert 0 <= by[i].near_next <= 1 and 0 <= by[i].near_edited <= 1
    text = {}
    for r in got:
        if r.doc_id is not None and r.doc_id != 508:
            t = dict(single)[r.doc_id]
            assert text.setdefault(t, r.fingerprint) == r.fingerprint
    assert fingerprints.compare(none).count() == 0
    one = fingerprints.compare(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1.0


def test_shards(spark, docs, none):
    got = sharding.shard(docs, shards=5).collect()
    assert len(got) == len(ROWS)
    where, by = {}, defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    for r, t in [(r, t) for r in got for i, t in ROWS if i == r.doc_id and i is not None]:
        if zlib.crc32((t or "").encode()) == r.text_crc32:
            assert where.setdefault(t or "", r.shard) == r.shard and r.size == len((t or "").encode()) + 16
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in by.values())
    assert sharding.shard(none).count() == 0


def test_best_fit_decreasing_equals_a_plain_search():
    r = random.Random(9)
    sizes = {i: r.randint(1, 60) for i in range(300)}
    rooms, want = [], {}
    for item, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        fits = [(room, -b) for b, room in enumerate(rooms) if room >= size]
        if fits:
            b = -min(fits)[1]
        else:
            b = len(rooms)
            rooms.append(100)
        rooms[b] -= size
        want[item] = b
    assert sharding.best_fit_decreasing(sizes, 100) == want
    equal = sharding.near_equal(sizes | {999: 3000}, 8)
    loads = defaultdict(int)
    for item, b in equal.items():
        loads[b] += (sizes | {999: 3000})[item]
    assert len(loads) <= 8 and loads[equal[999]] == 3000 and max(v for b, v in loads.items() if b != equal[999]) <= 1.02 * sum(sizes.values()) / 7


def test_warc_round_trip(spark):
    r = random.Random(5)
    pages = [(i, f"http://h/{i}", "é<p>" * r.randint(0, 200)) for i in range(60)] + [(100, None, None), (101, "u\r\nv", ""), (102, "x", "ü" * 150_000), (103, "x", "ü" * 150_000), (104, "y", "\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(*p, 9) for p in pages], "page_id long, url string, html string, digest int")
    last = {}
    for i, _, h in pages:
        last[h or ""] = max(last.get(h or "", -1), i)
    got = warc.round_trip(df).collect()
    assert len(got) == len(pages) and all(x.complete for x in got)
    text = {i: h or "" for i, _, h in pages}
    for x in got:
        data = text[x.page_id].encode()
        first = last[text[x.page_id]]
        assert x.payload_bytes == len(data) and x.payload_digest == base64.b32encode(hashlib.sha1(data).digest()).decode()
        assert (x.record_type, x.refers_to) == (("response", None) if first == x.page_id else ("revisit", first))
        assert x.record_type == "revisit" or bytes(x.payload) == data


def test_warc_rows_that_repeat_a_page_id(spark):
    long, other = "é" * 50_000, "x" * 40_000
    pages = [(1, "a", long), (1, "a", long), (2, "b", "p"), (2, "b", "q"), (3, "c", "p"), (4, "d", other), (4, "d", long[1:]), (5, "e", "r"), (5, "f", "r"), (6, "g", other), (6, "g", other), (None, "h", "p"), (None, "i", None), (None, "i", None), (None, "j", long + "y")]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    told = lambda text: base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
    refers = {(2, "p"): 3, (None, "p"): 3, (4, other): 6}
    want = [(p, told(h or ""), len((h or "").encode()), refers.get((p, h))) for p, _, h in pages]
    assert sorted(map(str, want)) == sorted(str((x.page_id, x.payload_digest, x.payload_bytes, x.refers_to)) for x in got)
    assert all(x.complete and (x.record_type == "revisit") == (x.refers_to is not None) for x in got)
    assert all(x.payload is None if x.refers_to else told(bytes(x.payload).decode()) == x.payload_digest for x in got)


def test_warc_framing():
    assert warc.unchunked(warc.chunked("é" * 9000).encode()) == ("é" * 9000).encode()
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nab\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab\r\n\r\n"))


def test_near_vectors(spark):
    r = np.random.default_rng(6)
    rows = []
    for label in (0, 1):
        for _ in range(6):
            base = r.normal(size=20)
            for _ in range(8):
                rows.append((len(rows), (base + r.normal(size=20) * 0.18).tolist(), label))
    rows += [(500, rows[0][1], 0), (501, None, 0), (502, [0.0] * 20, 0), (503, [float("nan")] * 20, 0), (504, rows[0][1], None), (505, [None] * 20, 1), (506, [1.0, 2.0], 0), (507, [1.0, 2.1], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    good = [(i, np.array(v, float), c) for i, v, c in rows if i is not None and c is not None and v is not None and None not in v and np.isfinite(v).all() and any(v)]
    linked = [(a[0], b[0]) for a in good for b in good if a[0] < b[0] and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93]
    want = component_of([x[0] for x in rows if x[0] is not None], linked)
    links = defaultdict(int)
    for a, b in linked:
        links[a] += 1
        links[b] += 1
    got = embeddings.near_vectors(df).collect()
    assert len(got) == len(rows) and len(linked) > 40
    for x in got:
        if x.vec_id is not None:
            assert (x.n_links, x.component_id, x.kept) == (links[x.vec_id], want[x.vec_id], want[x.vec_id] == x.vec_id)


def test_urls(spark):
    urls = [(1, "http://A.Example.NET/en/x?y"), (2, "https://net/"), (3, "http://b.net"), (4, "http://x.example.com/de/1#f"), (5, "http://x.org/fr/"), (6, "http://x.org/de/"), (7, None), (8, "no scheme"), (9, "http://example.network/")]
    urls += [(100 + i, f"http://bad-site.example.info/{'p' if i % 2 else 'q'}/{i}") for i in range(40)] + [(200 + i, f"http://fine.example.info/p/{i}") for i in range(40)]
    df = spark.createDataFrame([(*u, 1) for u in urls], "page_id long, url string, tokens int")
    labels = spark.createDataFrame([(100 + i, True) for i in range(30)] + [(200 + i, False) for i in range(40)] + [(1, None)], "page_id long, bad boolean")
    got = {r.page_id: r for r in url_filter.judge(df, labels).collect()}
    assert len(got) == len(urls)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("net/", "block") and (got[3].rule, got[3].path) == (None, "")
    assert got[4].verdict == "block" and got[5].rule == "org/fr/" and got[6].rule is None and got[9].rule is None
    assert (got[7].host, got[7].path, got[8].host, got[8].verdict) == ("", "", "", "allow")
    assert all(got[100 + i].verdict == "block" and got[100 + i].mined for i in range(40))
    assert all(got[200 + i].verdict == "allow" for i in range(40))
    empty = labels.limit(0)
    assert url_filter.judge(df, empty).where("verdict = 'block'").count() == 2 + 0 * len(urls)


def test_urls_that_hold_another_url(spark):
    urls = [(1, "http://a.net?u=http://b.org/fr/x"), (2, "http://a.net#http://b.org/fr/x"), (3, "http://a.net/p?u=http://b.org/fr/x"), (4, "http://x.org/fr/http://net/"), (5, "http://fine.info?u=http://h/d/7")]
    df = spark.createDataFrame(urls, "page_id long, url string")
    none = spark.createDataFrame([], "page_id long, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, none).collect()}
    assert got[1] == got[2] == ("a.net", "", None, "allow")
    assert got[3] == ("a.net", "/p", "net/", "block") and got[4] == ("x.org", "/fr/http://net/", "org/fr/", "allow")
    assert url_filter.page_labels(df, spark.createDataFrame([(7, 0, 0)], "doc_id long, quality int, toxic int")).count() == 0


def test_quality_keeps_clean_texts(spark, none):
    r = random.Random(8)
    word = lambda: "".join(r.choice("aeioubcdlmnrst") for _ in range(r.randint(2, 9)))
    clean = [". ".join(" ".join(word() for _ in range(r.randint(4, 14))).capitalize() for _ in range(r.randint(1, 12))) + "." for _ in range(400)]
    junk = [" ".join(word() + r.choice(["%%%", "$$$", "***"]) for _ in range(80)) for _ in range(40)] + [" ".join([word()] * 60) for _ in range(40)] + [" ".join(word().upper() + "!!" for _ in range(70)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(clean + junk)] + [(900, None), (901, ""), (902, "Yes.")]
    got = {x.doc_id: x for x in quality.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert sum(not got[i].kept for i in range(400)) == 0 and got[900].kept and got[901].kept and got[902].kept
    assert sum(not got[i].kept for i in range(400, 520)) >= 110
    assert quality.judge(none).count() == 0
    kept = quality.keep_good(spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, score string"))
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.kept}


def test_numbering_has_no_gaps(spark):
    df = spark.range(500).withColumn("k", F.when(F.col("id") < 400, 0).otherwise(F.col("id") % 3))
    by = defaultdict(list)
    for r in numbered(df, ["k"], [F.col("id")], 7, "n").collect():
        by[r.k].append(r.n)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_empty_documents_table(none):
    assert minhash.near_duplicates(none).count() == 0
    assert substrings.removal_digest(none).count() == 0
    assert bpe.digest(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_pipeline_stages_keep_the_columns(spark, docs):
    kept = minhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    judged = {r.doc_id for r in minhash.near_duplicates(docs).where("not kept").collect()}
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, _ in ROWS if i is not None and i not in judged)
    cut = substrings.drop_repeats(docs)
    assert cut.columns == docs.columns and cut.count() == len(ROWS)
    text = {r.doc_id: r.text for r in cut.collect() if r.doc_id is not None}
    removed = {r.doc_id: r for r in substrings.removal_digest(docs).collect()}
    for i, t in ROWS:
        if i is not None and removed[i].n_removed == 0:
            assert text[i] == t
        elif i is not None:
            assert hashlib.sha256(text[i].encode()).hexdigest() == removed[i].kept_sha256


def test_forgetting_stretches_changes_no_id():
    from planframe.llm.packing import StretchEncoder

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [f"Word{i} and, more word{i % 7}. " * 3 for i in range(60)]
    small, large = StretchEncoder(path, 5), StretchEncoder(path)
    for lo in range(0, 60, 10):
        a, b = small(texts[lo : lo + 10]), large(texts[lo : lo + 10])
        assert a[0].tolist() == b[0].tolist() and a[1].tolist() == b[1].tolist()


def test_pipeline_packing_remembers_little(monkeypatch):
    import corpus_pipeline

    seen = {}
    monkeypatch.setattr(corpus_pipeline, "tune", lambda s: s)
    monkeypatch.setattr(corpus_pipeline, "ship", lambda s: s)
    monkeypatch.setattr(corpus_pipeline.packing, "pack", lambda docs, path, **k: seen.update(k))
    corpus_pipeline.best_fit_packing(None, None, "")
    assert seen["remembered"] * 900 <= 100_000_000
