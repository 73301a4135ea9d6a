"""URL filtering by association rules that FP-growth mines from labels, beside fixed host and path rules.

All of it is DataFrame functions and Spark's FP-growth. A mined rule says that URLs with certain tokens are
bad; rules are pruned by support and confidence, and matched through an inverted index on each rule's
rarest token.
"""

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planframe.llm.common import hot_join, settle

#: Fixed rules of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The item that stands for a bad label among the tokens; tokens have a prefix, so none equals it.
BAD = "bad"


def host(url: str) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z lower-cased; empty for a null or a URL without ://."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, _UPPER, _LOWER)


def path(url: str) -> Column:
    """What follows the host up to ? # or the end; empty for a null or a URL without ://."""
    # The path may be empty, so the pattern never goes on to a :// in a query or fragment.
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def tokens(host: str, path: str) -> Column:
    """Distinct tokens of a URL: the words of its host, the host's last two labels, and the first part of the path; none without a host."""
    labels = F.split(F.col(host), r"\.")
    words = F.transform(F.split(F.col(host), r"[.\-]"), lambda w: F.concat(F.lit("word="), w))
    site = F.when(F.size(labels) > 1, F.concat(F.lit("site="), F.element_at(labels, -2), F.lit("."), F.element_at(labels, -1)))
    parts = F.concat(words, F.array(site, F.concat(F.lit("dir="), F.regexp_extract(path, r"^/([^/]*)/", 1))))
    return F.when(F.col(host) == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.filter(parts, lambda t: t.isNotNull())))


def mine(labelled: DataFrame, support: float, confidence: float) -> DataFrame:
    """(rule_id, tokens, rarest, confidence): token sets whose URLs are bad.

    ``labelled(tokens, bad)``: all labelled URLs. A rule has any number of tokens; the sets that FP-growth keeps
    are bounded by the support asked for and the few tokens of a URL.
    """
    items = F.when(F.col("bad"), F.array_append("tokens", BAD)).otherwise(F.col("tokens"))
    baskets = labelled.select(items.alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    single = model.freqItemsets.where(F.size("items") == 1).select(F.col("items")[0].alias("token"), F.col("freq").alias("token_freq"))
    rules = model.associationRules.where(F.array_contains("consequent", BAD))
    rules = rules.select(F.array_sort("antecedent").alias("tokens"), "confidence").withColumn("rule_id", F.concat_ws(" ", "tokens"))
    rare = rules.select("rule_id", F.explode("tokens").alias("token")).join(single, "token")
    rare = rare.groupBy("rule_id").agg(F.min(F.struct("token_freq", "token")).alias("r")).select("rule_id", F.col("r.token").alias("rarest"))
    return settle(rules.join(rare, "rule_id"), "url-rules")


def judge(urls: DataFrame, labels: DataFrame, support: float = 0.005, confidence: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined) of every row of ``urls(page_id, url)``.

    The longest fixed rule that fits decides: its host equals the URL's or is a parent domain of it, and the
    URL's path starts with the rule's; longest is by the rule's characters, and ties go by its text. Else a
    mined rule that matches blocks, and ``mined`` names the first of the most confident; else the URL is
    allowed. ``labels(page_id, bad)`` gives the labels to mine; rows with a null bad are passed over, and
    repeated page_ids count each. Null URLs and those without :// have an empty host and path and no tokens
    that a rule could hold. No labels: no mined rules.
    """
    parsed = urls.select(F.col("page_id").cast("long").alias("page_id"), host("url").alias("host"), path("url").alias("path"))
    fits = [
        F.when(((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in RULES
    ]
    best = F.array_max(F.filter(F.array(*fits), lambda x: x.isNotNull()))
    parsed = parsed.withColumn("_best", best).withColumn("tokens", tokens("host", "path"))
    labelled = labels.where("bad is not null").select(F.col("page_id").cast("long").alias("page_id"), "bad").join(parsed.select("page_id", "tokens"), "page_id").where(F.size("tokens") > 0).select("tokens", "bad")
    rules = mine(labelled, support, confidence)
    # Mined rules are told by the tokens of a URL, so each distinct token set is matched once.
    open_ = parsed.where("_best is null")
    sets = settle(open_.groupBy("tokens").agg(F.count(F.lit(1)).alias("_n")), "url-tokens")
    hits = sets.select("tokens", F.explode("tokens").alias("rarest")).join(rules.select(F.col("tokens").alias("_rule"), "rarest", "confidence", "rule_id"), "rarest")
    hits = hits.where(F.size(F.array_except("_rule", "tokens")) == 0)
    hits = hits.groupBy("tokens").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "rule_id")).alias("r")).select("tokens", F.col("r.rule_id").alias("mined"))
    told = hot_join(open_, sets.join(hits, "tokens", "left"), ["tokens"], "_n", sets.agg(F.sum("_n")).first()[0] or 0)
    columns = ["page_id", "host", "path", "_best", "mined"]
    out = told.select(*columns).unionByName(parsed.where("_best is not null").withColumn("mined", F.lit(None).cast("string")).select(*columns))
    verdict = F.coalesce(F.col("_best.verdict"), F.when(F.col("mined").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"), "mined")


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(page_id, bad): the label of the document that a page's URL numbers; bad is low quality or toxic."""
    numbered = pages.select("page_id", F.regexp_extract(path("url"), r"^/[^/]*/(\d{1,18})(?:\.html|/)?$", 1).try_cast("long").alias("doc_id")).where("doc_id is not null")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    return numbered.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("page_id", "bad")
