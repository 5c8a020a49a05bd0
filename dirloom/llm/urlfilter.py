"""URL filters: curated rules first, mined association rules for all other URLs.

Curated rules (host, path, verdict) fit their host and its subdomains where the URL's
path starts with the rule's; the longest wins.  They are met by an inverted index: a
URL offers its host and each parent domain, as deep as rules go.

Where none fits, mined rules decide.  A URL is a set of tokens (``url_tokens``: scheme,
domains, first path segments with digits masked, depth, extension, parameter names,
fragment; a dozen at most, whatever its length).  Spark's FP-growth finds the frequent
token combinations of labelled URLs, the label being one more token, and gives rules
"these tokens -> unwanted".  A rule stays if

* support: at least ``MIN_SUPPORT`` of the labelled URLs, and ``MIN_ROWS`` of them, are
  unwanted and have its tokens,
* confidence: at least ``MIN_CONFIDENCE`` of the URLs with its tokens are unwanted,
* no rule with one token less is as confident.

Rules stand in an inverted index under their rarest token.  A URL looks up each of its
tokens, and is blocked if it has all tokens of a rule found there.

All labelled URLs are mined and all URLs are judged; token counts and rules follow from
the whole table.  Nothing but rule tables, which the support bounds, is broadcast, and
only up to ``BROADCAST_ROWS`` rows.

Edge cases: a null URL and one without "://" have an empty host and path, no tokens, and
are allowed; hosts and paths of any length are kept whole; pages with equal ids or URLs
each keep their row; labels that are null don't count; without labelled pages, or with
labels of one kind, no rule is mined; an empty table gives an empty one.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import BROADCAST_ROWS, Scratch

MIN_SUPPORT, MIN_ROWS, MIN_CONFIDENCE = 0.001, 10, 0.5
#: The consequent of mined rules.
UNWANTED = "label:unwanted"

#: Fixed values of the contract: (host, path, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def url_host(url: Column) -> Column:
    """From behind the first "://" up to /, ?, # or the end, A-Z lower-cased."""
    host = F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From behind the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column, sign: str) -> Column:
    """What stands behind the path and ``sign``."""
    return F.coalesce(F.regexp_extract(url, rf"(?s)\A.*?://[^?#]*{sign}", 1), F.lit(""))


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, a dozen at most; none for one without a host."""
    labels = F.split(host, r"\.")
    masked = F.regexp_replace(path, "[0-9]+", "0")
    parts = F.filter(F.split(masked, "/"), lambda p: p != "")
    query = _rest(url, r"\?([^#]*)")
    names = F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "&"), lambda p: p != ""), lambda p: F.substring_index(p, "=", 1))))
    token = lambda kind, value, there: F.when(there, F.concat(F.lit(kind + ":"), value))
    made = F.array(
        token("scheme", F.substring_index(url, "://", 1), F.lit(True)),
        token("top", F.element_at(labels, -1), F.lit(True)),
        token("site", F.array_join(F.slice(labels, -2, 2), "."), F.size(labels) >= 2),
        token("name", F.try_element_at(labels, F.lit(-3)), F.size(labels) >= 3),
        token("host", host, F.lit(True)),
        token("first", F.get(labels, 0), F.size(labels) >= 3),
        token("path1", F.get(parts, 0), F.size(parts) >= 1),
        token("path2", F.get(parts, 1), F.size(parts) >= 2),
        token("depth", F.size(parts).cast("string"), F.lit(True)),
        token("ext", F.regexp_extract(masked, r"\.([A-Za-z0-9]+)\z", 1), masked.rlike(r"\.[A-Za-z0-9]+\z")),
        token("query", F.array_join(names, "&"), F.size(names) > 0),
        token("part", F.lit("fragment"), url.contains("#")),
    )
    return F.when(host != "", F.array_distinct(F.filter(made, lambda t: t.isNotNull()))).otherwise(F.array().cast("array<string>"))


def _checked(rows: DataFrame) -> DataFrame:
    """``rows`` as the side to broadcast, if they are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def curated_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (row, host, path); rules: (host, path, verdict).  (row, rule, verdict) of the
    longest rule of each row that has one; of equal ones the longer host, then block."""
    known = _checked(rules.select(F.lower("host").alias("domain"), F.col("path").alias("prefix"), "verdict"))
    deepest = known.agg(F.max(F.size(F.split("domain", r"\.")))).first()[0] or 0
    if not deepest:
        return urls.select("row", F.lit("").alias("rule"), F.lit("").alias("verdict")).limit(0)
    domains = F.expr(f"transform(sequence(1, {deepest}), k -> substring_index(host, '.', -k))")
    offered = urls.filter("host <> ''").select("row", "path", F.explode(F.array_distinct(domains)).alias("domain"))
    fits = offered.join(known, "domain").filter(F.col("path").startswith(F.col("prefix")))
    size = F.struct(F.length("domain") + F.length("prefix"), F.length("domain"), F.col("verdict") == "block")
    return fits.groupBy("row").agg(F.max_by(F.struct(F.concat("domain", "prefix").alias("rule"), "verdict"), size).alias("r")).select("row", "r.rule", "r.verdict")


def mine_rules(labelled: DataFrame, scratch: Scratch, min_support: float = MIN_SUPPORT, min_rows: int = MIN_ROWS, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """labelled: (tokens array, unwanted boolean).  Rules (tokens sorted, confidence, rows,
    rarest): the share of labelled rows with these tokens that are unwanted, how many are,
    and the one of the tokens that the fewest labelled rows have."""
    baskets = labelled.filter("unwanted is not null and size(tokens) > 0")
    n = baskets.count()
    if not n:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, rows long, rarest string")
    items = baskets.select(F.when(F.col("unwanted"), F.array_append("tokens", F.lit(UNWANTED))).otherwise(F.col("tokens")).alias("items"))
    least = max(math.ceil(min_support * n), min_rows)
    # half a row below, so that rounding loses no combination; the count is checked again
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n), minConfidence=min_confidence).fit(items)
    counts = scratch.save(model.freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "combinations")
    unwanted = F.array_contains("items", UNWANTED)
    both = counts.filter(unwanted & (F.size("items") > 1) & (F.col("freq") >= least)).select(F.array_remove("items", UNWANTED).alias("tokens"), F.col("freq").alias("rows"))
    alone = counts.filter(~unwanted).select(F.col("items").alias("tokens"), "freq")
    rules = both.join(alone, "tokens").withColumn("confidence", F.col("rows") / F.col("freq")).filter(F.col("confidence") >= min_confidence)
    rules = _general(scratch.save(rules.select("tokens", "confidence", "rows"), "candidates"))
    single = alone.filter(F.size("tokens") == 1).select(F.get("tokens", 0).alias("token"), "freq")
    rarest = rules.select("tokens", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens").agg(F.min_by("token", F.struct("freq", "token")).alias("rarest"))
    return rules.join(rarest, "tokens")


def _general(rules: DataFrame) -> DataFrame:
    """``rules`` without those of which a rule with one token less is as confident.  That
    one, or one it was left out for, fits wherever the longer one does."""
    shorter = F.transform("tokens", lambda t: F.array_remove("tokens", t))
    offers = rules.select(F.col("tokens").alias("whole"), "confidence", F.explode(shorter).alias("tokens"))
    known = rules.select("tokens", F.col("confidence").alias("general"))
    beaten = offers.join(known, "tokens").filter("general >= confidence").select(F.col("whole").alias("tokens")).distinct()
    return rules.join(beaten, "tokens", "left_anti")


def mined_hits(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """urls: (row, tokens); rules: as ``mine_rules`` gives them.  (row, confidence) of the
    rows that have all tokens of a rule, with the greatest confidence of these rules."""
    index = _checked(rules.select(F.col("tokens").alias("needs"), "confidence", F.col("rarest").alias("token")))
    found = urls.select("row", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return found.filter(F.size(F.array_except("needs", "tokens")) == 0).groupBy("row").agg(F.max("confidence").alias("confidence"))


def judge_urls(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules: DataFrame | None = None, key: str = "page_id", url: str = "url", **mining) -> DataFrame:
    """pages: (key, url); labels: (key, unwanted boolean).  key, host, path, rule, verdict
    and confidence (of the mined rule that blocks, else null) of every page."""
    scratch = Scratch(spark, "urlfilter")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string") if rules is None else rules
    host, path = url_host(F.col("url")), url_path(F.col("url"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url")).withColumns({"host": host, "path": path})
    rows = rows.select("key", "host", "path", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.save(rows, "urls")
    marked = labels.select(F.col(key).alias("key"), "unwanted").groupBy("key").agg(F.max("unwanted").alias("unwanted"))
    mined = scratch.save(mine_rules(rows.select("key", "tokens").join(marked, "key").select("tokens", "unwanted"), scratch, **mining), "rules")
    ruled = curated_hits(rows.select("row", "host", "path"), rules)
    hits = mined_hits(rows.select("row", "tokens"), mined)
    joined = rows.drop("tokens").join(ruled, "row", "left").join(hits, "row", "left")
    verdict = F.coalesce("verdict", F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return joined.select(F.col("key").alias(key), "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("rule").isNull(), F.col("confidence")).alias("confidence"))


def url_report(spark: SparkSession, pages: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each page.  A label belongs to the page of the same number
    (the document taken from it): of low quality or toxic means unwanted."""
    marks = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("unwanted"))
    return judge_urls(spark, pages, marks)
