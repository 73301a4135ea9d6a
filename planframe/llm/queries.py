"""The registered queries of the corpus operators: thin digests of what the operators return."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planframe.llm import bpe, embeddings, fingerprints, line_dedup, minhash, negatives, packing, quality, sharding, spelling, substrings, url_filter, warc
from planframe.llm.common import table

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), shingle=3, percent=85)


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = url_filter.page_labels(pages, table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))
    return url_filter.judge(pages, labels)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removal_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = sharding.shard(table(spark, sf_dir, "documents", "doc_id", "text"), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op11_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.word_runs(table(spark, sf_dir, "documents", "doc_id", "text"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (h % F.char_length("run")).cast("int")
    word = F.when(h % 97 == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))).otherwise(F.col("run"))
    return spelling.variants(spelling.vocabulary(runs.select(word.alias("word"))))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label").withColumn("label", label)
    return negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_minhash": op1_minhash,
    "op2_urls": op2_urls,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_fingerprints": op5_fingerprints,
    "op6_substrings": op6_substrings,
    "op7_bpe": op7_bpe,
    "op8_sharding": op8_sharding,
    "op9_warc": op9_warc,
    "op10_embeddings": op10_embeddings,
    "op11_lines": op11_lines,
    "op12_spelling": op12_spelling,
    "op13_negatives": op13_negatives,
}

#: CRC-32 of ``<doc_id>:<run>`` by bytes; runs hold code points up to U+00FF, so of one or two bytes.
_CRC = """xor(list_reduce(flatten(list_transform(string_split(doc_id || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)]
        ELSE [CAST(192 | (unicode(x) >> 6) AS BIGINT), CAST(128 | (unicode(x) & 63) AS BIGINT)] END)), lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INT) + 1]), 4294967295), 4294967295)"""

SQL = {
    "op1_minhash": rf"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s
    FROM w
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reach AS (
    SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least.c AS component_id, s.doc_id = least.c AS kept
FROM s JOIN least ON s.doc_id = least.a
""",
    "op6_substrings": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM x),
m AS (SELECT h, min(doc_id) AS d FROM h GROUP BY h),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM h JOIN m USING (h) WHERE doc_id > d),
gone AS (SELECT doc_id, list(j) AS j FROM g GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(j), 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(list_filter(w, lambda x, k: NOT list_contains(coalesce(j, []), k)), ' ')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id
""",
    "op10_embeddings": """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
    WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
), least AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON vec_id = least.a LEFT JOIN n ON vec_id = n.a
""",
    "op2_urls": rf"""
WITH u AS (
    SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
        regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
    FROM pages
), r(rh, rp, rv) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
f AS (
    SELECT page_id, arg_max(rh || rp, (len(rh || rp), rh || rp)) AS rule, arg_max(rv, (len(rh || rp), rh || rp)) AS rv
    FROM (SELECT DISTINCT page_id, host, path FROM u) JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
), t AS (
    SELECT *, string_split(host, '.') AS l,
        CASE WHEN host = '' THEN [] ELSE list_distinct(list_filter(
            list_transform(regexp_split_to_array(host, '[.-]'), lambda w: 'word=' || w)
            || [CASE WHEN len(l) > 1 THEN 'site=' || l[-2] || '.' || l[-1] END, 'dir=' || regexp_extract(path, '^/([^/]*)/', 1)],
            lambda x: x IS NOT NULL)) END AS tokens
    FROM u
), b AS (
    SELECT row_number() OVER () AS i, tokens, quality = 0 OR toxic = 1 AS bad FROM t
    JOIN labels ON doc_id = try_cast(nullif(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})(?:\.html|/)?$', 1), '') AS BIGINT)
    WHERE len(tokens) > 0 AND (quality = 0 OR toxic = 1) IS NOT NULL
), q AS (SELECT i, bad, list_sort(tokens) AS x, unnest(range(1, CAST(1 << len(tokens) AS BIGINT))) AS m FROM b),
s AS (
    SELECT list_filter(x, lambda v, k: (m >> (k - 1)) & 1 = 1) AS a, count(*) AS n, count(*) FILTER (WHERE bad) AS nb FROM q GROUP BY 1
), k AS (
    SELECT a, array_to_string(a, ' ') AS id, CAST(nb AS DOUBLE) / CAST(n AS DOUBLE) AS c FROM s
    WHERE nb >= greatest(1, ceil(0.005 * (SELECT count(*) FROM b))) AND CAST(nb AS DOUBLE) / CAST(n AS DOUBLE) >= 0.5
), h AS (
    SELECT page_id, arg_min(id, (-c, id)) AS mined FROM (SELECT DISTINCT page_id, tokens FROM t) JOIN k ON list_has_all(tokens, a)
    WHERE page_id NOT IN (SELECT page_id FROM f) GROUP BY page_id
)
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.rv, CASE WHEN h.mined IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, h.mined
FROM u LEFT JOIN f USING (page_id) LEFT JOIN h USING (page_id)
""",
    "op11_lines": rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT doc_id, unnest(a) AS line, unnest(range(1, len(a) + 1)) AS i FROM d),
k AS (SELECT *, trim(translate(line, '{_UPPER}', '{_LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS key FROM l),
m AS (SELECT key, min(doc_id) AS first FROM k WHERE len(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
j AS (SELECT k.doc_id, i, line, coalesce(k.doc_id > first, false) AS gone FROM k LEFT JOIN m ON k.key = m.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM j GROUP BY doc_id
""",
    "op12_spelling": rf"""
WITH RECURSIVE c0 AS (
    SELECT list(x ORDER BY n) AS crc FROM (
        SELECT n, list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS x
        FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))
), r AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
), q AS (SELECT doc_id, run, count(*) AS k FROM r GROUP BY doc_id, run),
h AS (SELECT run, k, {_CRC} AS h FROM q, c0),
w AS (
    SELECT CASE WHEN h % 97 = 0 THEN run[:CAST(h % len(run) AS BIGINT)] || run[CAST(h % len(run) AS BIGINT) + 2:] ELSE run END AS word, sum(k) AS n
    FROM h GROUP BY 1 HAVING len(word) >= 5 AND sum(k) >= 3
), v AS (SELECT word, CAST(n AS BIGINT) AS n FROM w),
g AS (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM v),
cut AS (SELECT word, n, i, word[:i - 1] AS a, word[i + 1:] AS b FROM g),
p AS (
    SELECT x.word, y.word AS other, y.n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
    UNION SELECT x.word, v.word, v.n FROM cut x JOIN v ON x.a || x.b = v.word
    UNION SELECT v.word, x.word, x.n FROM cut x JOIN v ON x.a || x.b = v.word
), best AS (SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS m FROM p GROUP BY word),
f AS (
    SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN other END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
    FROM v LEFT JOIN best ON v.word = best.word
), up AS (
    SELECT word, word AS root FROM f UNION ALL SELECT up.word, f.form FROM up JOIN f ON up.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.n, f.n_near, f.form, f.form_n, up.root FROM f JOIN up ON f.word = up.word JOIN f t ON t.word = up.root WHERE t.form IS NULL
""",
    "op13_negatives": """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
    SELECT a, b AS positive_id, score AS positive_score FROM s WHERE same AND a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5
)
SELECT p.a AS anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, b) AS INT) AS rank, b AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY p.a, positive_id ORDER BY score DESC, b) <= 5
""",
}
