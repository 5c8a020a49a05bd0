"""Registered queries over the driver's tables, each with the same result in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..materialize import cut
from ..operators import html as H
from ..operators import relational as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- links and URLs -------------------------------------------------------------------

_HOST = r"regexp_replace(lower(regexp_extract({u}, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\.', '')"
_PATH = r"regexp_extract({u}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract({u}, '^[^?#]*\?([^#]*)', 1)"


def _sql_url(template: str, u: str) -> str:
    return template.replace("{u}", u)


_LINKS_SQL = rf"""
raw AS (SELECT page_id, url AS base,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)))) AS k
  FROM pages),
absolute AS (SELECT page_id, k, trim(regexp_replace(label, '\s+', ' ', 'g')) AS text,
    'http' || CASE WHEN base LIKE 'https:%' THEN 's' ELSE '' END || '://' ||
    lower(regexp_extract(base, '^[a-zA-Z]+://([^/?#]*)', 1)) || regexp_replace(href, '#.*$', '') AS url
  FROM raw WHERE href LIKE '/%'),
links AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k) AS INTEGER) AS pos, url, text FROM (
    SELECT *, row_number() OVER (PARTITION BY page_id, url ORDER BY k) AS rn FROM absolute) WHERE rn = 1)
"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return H.page_links(H.parse_pages(pages, H.LINK_TAGS))


@query(f"WITH {_LINKS_SQL} SELECT page_id, pos, url, text FROM links")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


_TEXT = "replace(replace(replace(replace(replace({t}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#x27;', chr(39)), '&amp;', '&')"


@query(r"SELECT page_id, " + _TEXT.format(t=r"trim(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '\s+', ' ', 'g'))") + " AS title FROM pages")
def page_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.page_summary(H.parse_pages(table(spark, sf_dir, "pages"))).select("page_id", "title")


@query()
def link_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir).filter(~U.is_social(F.col("url")))
    return links.groupBy(U.site_key(F.col("url")).alias("site")).agg(
        F.count("*").alias("links"), F.count_distinct("page_id").alias("pages"), F.count_distinct("url").alias("urls")
    )


ORACLE["link_directory"] = (
    f"WITH {_LINKS_SQL} SELECT array_to_string(string_split(h, '.')[-2:], '.') AS site, count(*) AS links, "
    f"count(DISTINCT page_id) AS pages, count(DISTINCT url) AS urls FROM (SELECT *, {_sql_url(_HOST, 'url')} AS h FROM links) GROUP BY 1"
)

_SORTED_QUERY = "array_to_string(list_sort(list_filter(string_split({q}, '&'), lambda x: x <> '')), '&')"
_CANON = f"SELECT page_id, h || CASE WHEN p = '' THEN '/' ELSE p END || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical FROM (SELECT page_id, {_sql_url(_HOST, 'url')} AS h, regexp_replace({_sql_url(_PATH, 'url')}, '/+$', '') AS p, {_SORTED_QUERY.replace('{q}', _sql_url(_QUERY, 'url'))} AS q FROM pages)"


@query(_CANON)
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.canonical_url(F.col("url")).alias("canonical"))


@query(f"SELECT array_to_string(string_split(h, '.')[-2:], '.') AS site, count(*) AS pages FROM (SELECT {_sql_url(_HOST, 'url')} AS h FROM pages) GROUP BY 1")
def site_key_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").groupBy(U.site_key(F.col("url")).alias("site")).agg(F.count("*").alias("pages"))


_KEY_SQL = f"""SELECT page_id, h || '|' || p || '|' || array_to_string(list_sort(list_filter(string_split(q, '&'),
  lambda x: x LIKE '%=_%' AND NOT list_contains(['page','p','pg','paged','pageno','page_no','pagenum','start','offset','per_page'], lower(string_split(x, '=')[1])))), '&') AS listing
FROM (SELECT page_id, {_sql_url(_HOST, 'url')} AS h, regexp_replace(regexp_replace({_sql_url(_PATH, 'url')}, '/page/[0-9]+/?$', ''), '/+$', '') AS p,
  {_sql_url(_QUERY, 'url')} AS q FROM pages)"""


@query(_KEY_SQL)
def listing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.listing_key(F.col("url")).alias("listing"))


@query(f"SELECT listing, count(*) AS pages, min(page_id) AS first_page FROM ({_KEY_SQL}) GROUP BY 1")
def pagination_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    keyed = listing_keys(spark, sf_dir)
    return keyed.groupBy("listing").agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))


@query(f"SELECT page_id, regexp_extract(lower({_sql_url(_PATH, 'url')}), '\\.[a-z0-9]{{2,5}}$', 0) AS extension FROM pages")
def url_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.url_extension(F.col("url")).alias("extension"))


_EXCLUDED = "news|event|notice|gallery|video|admission|apply|result|login|register|calendar|career|alumni|publication|journal|blog"


@query(
    f"SELECT page_id, (h = 'example.com' OR h LIKE '%.example.com') AND NOT regexp_matches(url, '(?i){_EXCLUDED}') "
    f"AND NOT list_contains([{', '.join(repr(x) for x in P.UNWANTED_SUBDOMAINS)}], string_split(h0, '.')[1]) AS allowed, "
    "regexp_matches(p, '(?i)(^|[/_-])(staffs?|officers?|officials?|employees)([/_.-]|$)') AS staff "
    f"FROM (SELECT page_id, url, {_sql_url(_HOST, 'url')} AS h, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS h0, {_sql_url(_PATH, 'url')} AS p FROM pages)"
)
def url_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.is_allowed(u, ["example.com"], [], ["(?i)" + _EXCLUDED]).alias("allowed"), U.is_staff_only(u).alias("staff"))


@query(
    f"""WITH RECURSIVE {_LINKS_SQL},
tails AS (SELECT DISTINCT page_id, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*(.*)$', 1) AS t FROM links),
edges AS (SELECT DISTINCT a.page_id AS src, b.page_id AS dst FROM tails a JOIN tails b USING (t) WHERE a.page_id <> b.page_id),
walk(node, depth) AS (SELECT CAST(0 AS BIGINT), 0 UNION ALL SELECT e.dst, w.depth + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE w.depth < 2)
SELECT node, min(depth) AS depth FROM walk GROUP BY node"""
)
def frontier_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = _links(spark, sf_dir)
    tail = F.regexp_extract("url", r"^[a-zA-Z]+://[^/?#]*(.*)$", 1)
    # Pages and link targets are both nodes: a step between pages is two, and edges are linear in the links.
    met = links.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("src"), F.concat(F.lit("t"), tail).alias("dst")).distinct()
    edges = cut(met.unionByName(met.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    near = R.reach(spark.range(1).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("node")), edges, 4)
    return near.filter(F.startswith("node", F.lit("p"))).select(F.substr("node", F.lit(2)).cast("long").alias("node"), F.expr("depth div 2").cast("int").alias("depth"))


@query("SELECT p.page_id, p.url FROM pages p WHERE p.page_id % 2 = 1")
def incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return R.incremental(pages.select("page_id", "url"), pages.filter("page_id % 2 = 0"), "page_id")


# --- text -----------------------------------------------------------------------------

_EMAIL_SQL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_REVEALED = r"regexp_replace(regexp_replace(text, '\s*[\[\(\{<]\s*(?:at|@)\s*[\]\)\}>]\s*', '@', 'gi'), '\s*[\[\(\{<]\s*dot\s*[\]\)\}>]\s*', '.', 'gi')"


@query(
    f"SELECT doc_id, e AS email FROM (SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all({_REVEALED}, '{_EMAIL_SQL}'), lambda x: lower(trim(x, '.'))))) AS e FROM documents) "
    r"WHERE NOT regexp_matches(e, '\.(png|jpg|jpeg|gif|webp)$')"
)
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(F.col("text").rlike(r"@|[\[({<]\s*(?i:at)\s*[\])}>]"))
    return docs.select("doc_id", F.explode(T.extract_emails(F.col("text"))).alias("email"))


@query(
    r"SELECT doc_id, CASE WHEN labelled <> '' THEN labelled ELSE mobile END AS phone FROM (SELECT doc_id, trim(trim(regexp_extract(text, '(?i)(?:phone|tel(?:ephone)?|mobile|cell|contact(?:\s+no)?|ext(?:ension)?)\.?\s*(?:no\.?)?\s*[:\-]?\s*(\+?[0-9][0-9\s\-()/,]{2,24}[0-9])', 1)), ' ,/-') AS labelled, "
    r"regexp_extract(text, '(?:\+?88)?01[3-9][0-9]{2}[-\s]?[0-9]{6}', 0) AS mobile FROM documents)"
)
def phone_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.extract_phone(F.col("text")).alias("phone"))


@query(r"SELECT doc_id, sha1(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned, length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS n FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = T.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1(c).alias("cleaned"), F.length(c).cast("long").alias("n"))


@query(
    r"""WITH l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\r\n]+'),
  lambda x: trim(trim(regexp_replace(x, '\s+', ' ', 'g')), ' |:-–—•*')), lambda x: x <> '') AS a FROM documents),
k AS (SELECT doc_id, list_filter(a, lambda x, i: i = 1 OR x <> a[i - 1]) AS a FROM l)
SELECT doc_id, len(a) AS n, sha1(array_to_string(a, chr(10))) AS lines FROM k"""
)
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = T.text_lines(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", lines.alias("a"))
    return docs.select("doc_id", F.size("a").cast("long").alias("n"), F.sha1(F.array_join("a", "\n")).alias("lines"))


@query(
    r"SELECT p_partkey, CASE WHEN length(f) > 12 THEN regexp_replace(substr(f, 1, 12), '[ .]+$', '') ELSE f END AS file FROM "
    r'''(SELECT p_partkey, CASE WHEN s = '' THEN 'unnamed' ELSE s END AS f FROM (SELECT p_partkey, trim(trim(trim(regexp_replace(regexp_replace(p_name, '[<>:"/\\|?*]', ' ', 'g'), '\s+', ' ', 'g')), '.')) AS s FROM part))'''
)
def safe_filenames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.safe_filename(F.col("p_name"), 12).alias("file"))


@query(
    "SELECT c_custkey, array_to_string(list_transform(list_filter(regexp_split_to_array(lower(c_name), '[^a-z0-9]+'), lambda x: x <> ''), lambda x: x), ' ') AS words, "
    "trim(regexp_replace(lower(c_name), '[^a-z]+', ' ', 'g')) AS letters FROM customer"
)
def name_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(T.tokens(c), " ").alias("words"), T.name_key(c, fold=False).alias("letters"))


@query()
def name_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of conversations that could be names."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(T.text_lines(F.col("text"))).alias("k", "line"))
    return said.filter(T.looks_like_name(F.col("line"), strict=False))


# --- aggregation, windows, sets -------------------------------------------------------


@query("SELECT sha1(text) AS content, count(DISTINCT doc_id) AS owners FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3")
def placeholder_shared_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.sha1("text").alias("content"), "doc_id")
    return R.shared_content(docs, "content", "doc_id", 3)


@query("SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return R.first_wins(docs, ["source", "lang"], ["doc_id"])


_FILL = "min_by({c}, doc_id) FILTER ({c} <> '')"


@query(
    "WITH j AS (SELECT d.source, d.doc_id, CASE WHEN l.quality = 1 THEN 'good-' || d.doc_id ELSE '' END AS quality, CASE WHEN l.toxic = 1 THEN 'toxic-' || d.doc_id ELSE '' END AS toxicity "
    f"FROM documents d LEFT JOIN labels l USING (doc_id)) SELECT source, coalesce({_FILL.format(c='quality')}, '') AS quality, coalesce({_FILL.format(c='toxicity')}, '') AS toxicity FROM j GROUP BY source"
)
def fill_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels")
    j = docs.join(labels, "doc_id", "left")
    named = j.select("source", "doc_id", *(F.when(F.col(c) == 1, F.concat(F.lit(w), "doc_id")).otherwise("").alias(o) for c, w, o in (("quality", "good-", "quality"), ("toxic", "toxic-", "toxicity"))))
    return R.fill_missing(named, ["source"], "doc_id", ["quality", "toxicity"])


@query(
    "SELECT coalesce(source, 'TOTAL') AS source, count(*) AS people, count(*) FILTER (lang = 'en') AS with_url, count(*) FILTER (n_chars > 1000) AS saved FROM documents GROUP BY ROLLUP (source)"
)
def summary_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", F.when(F.col("lang") == "en", "x").otherwise("").alias("photo_url"), F.when(F.col("n_chars") > 1000, "x").otherwise("").alias("photo_file"))
    return R.summary(docs, "source")


@query(
    "SELECT doc_id, CASE WHEN lang = 'es' THEN 'no photo found' WHEN l.toxic = 1 THEN 'placeholder (no real photo)' WHEN l.quality = 0 THEN 'download failed' "
    "WHEN n_chars > 2000 THEN 'already downloaded' ELSE 'downloaded' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)"
)
def status_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    url = F.when(F.col("lang") == "es", "").otherwise("x")
    result = F.when(F.col("quality") == 0, P.FAILED).otherwise(P.DOWNLOADED)
    return j.select("doc_id", R.photo_status(F.col("toxic") == 1, result, url, F.col("n_chars") > 2000).alias("status"))


@query("SELECT source, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'es') AS es FROM documents GROUP BY source")
def status_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = table(spark, sf_dir, "documents").groupBy("source").pivot("lang", ["en", "de", "fr", "es"]).count()
    return out.na.fill(0)


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 15")
def value_counts_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.value_counts(table(spark, sf_dir, "part"), "p_brand", 15)


@query(
    "SELECT p_partkey, p_brand, CASE WHEN k = 1 THEN p_name ELSE p_name || ' (' || k || ')' END AS path_name FROM "
    "(SELECT p_partkey, p_brand, p_name, row_number() OVER (PARTITION BY p_brand, lower(p_name) ORDER BY p_partkey) AS k FROM part)"
)
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_names(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_name"), "p_brand", "p_name", "p_partkey").drop("p_name")


_MISS = """WITH a AS (SELECT event_id, user_id, ts, event_type = 'purchase' AS hit FROM events),
b AS (SELECT *, sum(hit::INT) OVER w AS island FROM a WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, sum((NOT hit)::INT) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS misses FROM b),
d AS (SELECT *, coalesce(max((misses >= 10)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM c)
SELECT user_id, count(*) AS kept, max(event_id) AS last_event FROM d WHERE stopped = 0 GROUP BY user_id"""


@query(_MISS)
def miss_run_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    kept = R.miss_cutoff(events, "user_id", ["ts", "event_id"], F.col("event_type") == "purchase", 10)
    return kept.groupBy("user_id").agg(F.count("*").alias("kept"), F.max("event_id").alias("last_event"))


@query(
    "WITH a AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events) "
    "SELECT event_id, CAST(i * 30000000 + max(t - i * 30000000) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS slot FROM a"
)
def rate_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return R.rate_slots(events, "user_id", "t", ["t", "event_id"], 30_000_000).select("event_id", "slot")


@query(
    "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS heading FROM events"
)
def latest_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", R.latest_before(events, "user_id", ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("heading"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rn FROM documents) WHERE rn = 1")
def best_of_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.best_of(table(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], "n_chars", "doc_id")


@query("SELECT least(greatest(max(length(p_name)) + 2, 10), 60) AS p_name, least(greatest(max(length(p_brand)) + 2, 10), 60) AS p_brand, least(greatest(max(length(p_type)) + 2, 10), 60) AS p_type FROM part")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sinks import column_widths as widths

    return widths(table(spark, sf_dir, "part").select("p_name", "p_brand", "p_type")).select(*(F.col(c).cast("long").alias(c) for c in ("p_name", "p_brand", "p_type")))


@query("SELECT page_id, nullif(regexp_extract(url, '[?&]page=([0-9]+)', 1), '')::INT AS page_number FROM pages")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"[?&]page=(\d+)", 1).try_cast("int").alias("page_number"))


@query("SELECT page_id, len(regexp_extract_all(html, '<a ')) AS anchors, len(regexp_extract_all(html, '<h1')) AS headings FROM pages")
def page_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = H.parse_pages(table(spark, sf_dir, "pages"))
    return nodes.groupBy("page_id").agg(F.count_if(F.col("tag") == "a").alias("anchors"), F.count_if(F.col("tag") == "h1").alias("headings"))
