"""Extractor queries over list pages that are made from the tables, so that SQL over
the same tables says who must be found: a person a customer, a page a nation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures
from ..functions import text as T
from ..functions import urls as U
from ..operators import extract as E
from ..operators import html as H
from ..operators import photos as PH
from ..operators import relational as R
from ..operators.departments import page_departments as by_texts
from ..operators.chains import chain_pages
from ..operators.crawl import CrawlSettings
from ..operators.people import directory
from ..operators.resolve import resolve
from ..sources import SiteSpec, site_tables
from .queries import query, table

SITE = "https://mock.edu"
TITLES = ["Professor", "Lecturer", "Associate Professor", "SENIOR LECTURER"]
SAID = ["Asst. Prof. & Head", "Assoc. Prof.", "Designation: Sr. Lecturer", "Lect. ", "Position - Adjunct Faculty", "PROF. AND DEAN", "Lab Officer"]


def _sql_case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


def _case(key: Column, values: list[str]) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), (key % len(values)).cast("int"))


def _letters(key: Column) -> Column:
    return F.translate(F.lpad(key.cast("string"), 7, "0"), "0123456789", "abcdefghij")


_SQL_PEOPLE = f"""(SELECT c_custkey AS k, c_nationkey AS page, translate(lpad(c_custkey::VARCHAR, 7, '0'), '0123456789', 'abcdefghij') AS w,
  {_sql_case("c_custkey", TITLES)} AS title FROM customer)"""
_SQL_TITLE = "CASE WHEN title = upper(title) THEN 'Senior Lecturer' ELSE title END"


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, page, w, name, title) of each customer."""
    k = F.col("c_custkey")
    w = _letters(k)
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.col("c_nationkey").cast("long").alias("page"), w.alias("w"), F.concat(F.lit("Anna K"), w).alias("name"), _case(k, TITLES).alias("title"))


def _pages(rows: DataFrame, item: Column, before: str, after: str, path: str) -> DataFrame:
    items = rows.select("page", F.struct("k", item.alias("h")).alias("i")).groupBy("page").agg(F.sort_array(F.collect_list("i")).alias("i"))
    html = F.concat(F.lit(fixtures.HEAD + before), F.array_join(F.transform("i", lambda x: x["h"]), ""), F.lit(after + fixtures.FOOT))
    return items.select(F.col("page").alias("page_id"), F.concat(F.lit(SITE + path), F.col("page").cast("string")).alias("url"), html.alias("html"))


@query(
    f"SELECT page AS page_id, 'Anna K' || w AS name, {_SQL_TITLE} AS designation, w || '@mock.edu' AS email, '{SITE}/people/' || w AS profile_url, "
    f"'{SITE}/uploads/' || w || '.jpg' AS photo_url, 'M.Sc in Botany' AS qualifications, 'mosses, ' || w AS research_interests, '' AS phone, '' AS department_hint FROM {_SQL_PEOPLE}"
)
def extract_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    card = F.concat(
        F.lit('<div class="card"><a href="/people/'), F.col("w"), F.lit('"><img src="/uploads/'), F.col("w"), F.lit('.jpg"></a><h5>'), F.col("name"), F.lit('</h5><p class="designation">'), F.col("title"),
        F.lit("</p><p>"), F.col("w"), F.lit("@mock.edu</p><p>M.Sc in Botany</p><p>Research interests: mosses, "), F.col("w"), F.lit("</p></div>"),
    )
    pages = _pages(people(spark, sf_dir), card, "<div>", "</div>", "/staff/list")
    nodes = H.parse_pages(pages)
    return E.extract_cards(nodes, pages).select("page_id", *(c for c in E.RAW_FIELDS))


@query(f"SELECT page AS page_id, 'Anna K' || w AS name, {_SQL_TITLE} AS designation, w || '@mock.edu' AS email, '{SITE}/staff/p.php?id=' || k AS profile_url FROM {_SQL_PEOPLE}")
def extract_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.concat(F.lit("<tr><td><a href='p.php?id="), F.col("k").cast("string"), F.lit("'>"), F.col("name"), F.lit("</a><td>"), F.col("title"), F.lit("<td>"), F.col("w"), F.lit("@mock.edu"))
    pages = _pages(people(spark, sf_dir), row, "<table><tr><th>Name</th><th>Title</th></tr>", "</table>", "/staff/table")
    rows = E.extract_table_rows(H.parse_pages(pages), pages)
    return rows.select("page_id", "name", "designation", "email", "profile_url")


@query(
    f"SELECT page AS page_id, 'Anna K' || w AS name, {_SQL_TITLE} AS designation, 'Botany' AS department_hint, w || '@mock.edu' AS email, '{SITE}/people/' || w AS profile_url, "
    f"'{SITE}/uploads/' || w || '.jpg' AS photo_url FROM {_SQL_PEOPLE}"
)
def extract_json_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.concat(
        F.lit('{"fullName":{"en":"'), F.col("name"), F.lit('"},"designation":"'), F.col("title"), F.lit('","dept":"Botany","photo":{"data":{"url":"/uploads/'), F.col("w"),
        F.lit('.jpg"}},"email":"'), F.upper("w"), F.lit('@mock.edu","url":"/people/'), F.col("w"), F.lit('","list":[{"title":"Read the annual report","image":"/a.jpg"}]},'),
    )
    pages = _pages(people(spark, sf_dir), item, '<script id="__NEXT_DATA__" type="application/json">{"props":{"list":[', "{}]}}</script>", "/staff/json")
    rows = E.extract_json_records(H.parse_pages(pages), pages)
    return rows.select("page_id", "name", "designation", "department_hint", "email", "profile_url", "photo_url")


@query(f"SELECT k AS page_id, 'Anna K' || w AS name, {_SQL_TITLE} AS designation, '02-555 1234' AS phone, '{SITE}/uploads/people/' || w || '.jpg' AS photo_url FROM {_SQL_PEOPLE} WHERE k % 10 = 0")
def extract_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of their own for each tenth customer (the pages are the input)."""
    some = people(spark, sf_dir).filter("k % 10 = 0")
    body = F.concat(F.lit(fixtures.HEAD + "<h1>"), F.col("name"), F.lit('</h1><div class="profile"><img src="/uploads/people/'), F.col("w"), F.lit('.jpg" width="200" height="220"></div><p>'), F.col("title"), F.lit("</p><p>Phone: 02-555 1234</p>" + fixtures.FOOT))
    pages = some.select(F.col("k").alias("page_id"), F.concat(F.lit(f"{SITE}/people/"), "w").alias("url"), body.alias("html"))
    nodes = H.parse_pages(pages)
    return E.extract_profiles(nodes, pages).select("page_id", "name", "designation", "phone", "photo_url")


@query(f"SELECT n_nationkey::BIGINT AS page_id, (j - 1)::INT AS pos, '{SITE}/list/' || n_nationkey || '?page=' || j AS url FROM nation, (SELECT unnest(range(2, 6)) AS j) WHERE j <= 2 + n_nationkey % 4")
def pagination_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    links = F.array_join(F.transform(F.sequence(F.lit(2), 2 + k % 4), lambda j: F.concat(F.lit('<li><a href="?page='), j.cast("string"), F.lit('">'), j.cast("string"), F.lit("</a>"))), "")
    html = F.concat(F.lit(fixtures.HEAD + '<ul class="pagination">'), links, F.lit('<li><a href="/other?page=2">2</a></ul>' + fixtures.FOOT))
    pages = table(spark, sf_dir, "nation").select(k.cast("long").alias("page_id"), F.concat(F.lit(f"{SITE}/list/"), k.cast("string")).alias("url"), html.alias("html"))
    return H.pagination_links(H.parse_pages(pages))


# --- rules over values made from the tables ----------------------------------------------


@query(
    "SELECT c_custkey, trim(trim(CASE WHEN v = upper(v) THEN regexp_replace('P' || lower(substr(v, 2)), ' and dean', ' And Dean') ELSE v END), ' ,;|-') AS designation, non_academic FROM (SELECT c_custkey, "
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(raw), "
    r"'^(designation|position|title)\s*[:\-]\s*', '', 'i'), 'Asst\.?\s*Prof\.?', 'Assistant Professor', 'gi'), 'Assoc\.?\s*Prof\.?', 'Associate Professor', 'gi'), "
    r"'Prof\.(\s|$)', 'Professor\1', 'gi'), 'Sr\.?(\s)', 'Senior\1', 'gi'), 'Lect\.?(\s|$)', 'Lecturer\1', 'gi') AS v, "
    f"regexp_matches(raw, '(?i)officer') AS non_academic FROM (SELECT c_custkey, {_sql_case('c_custkey', SAID)} AS raw FROM customer))"
)
def designation_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", _case(k, SAID).alias("raw"))
    return rows.select("c_custkey", T.normalize_designation(F.col("raw")).alias("designation"), T.is_non_academic(F.col("raw")).alias("non_academic"))


_SIZED = ["-300x200", "_64x64", "", "-1024x768"]
_STYLE = ["", "/styles/large/public", "/styles/thumb/private"]
_SQL_PHOTO = f"'https://img.example.com/a' || {_sql_case('p_size', _STYLE)} || '/U' || p_partkey || {_sql_case('p_partkey', _SIZED)} || '.jpg?w=10&v=' || p_size"


def _photo() -> Column:
    return F.concat(F.lit("https://img.example.com/a"), _case(F.col("p_size"), _STYLE), F.lit("/U"), F.col("p_partkey").cast("string"), _case(F.col("p_partkey"), _SIZED), F.lit(".jpg?w=10&v="), F.col("p_size").cast("string"))


@query(
    rf"""WITH u AS (SELECT p_partkey, {_SQL_PHOTO} AS u, p_size FROM part), p AS (SELECT *, regexp_extract(u, '^https://[^/]+([^?]*)', 1) AS p FROM u),
v AS (SELECT *, regexp_replace(p, '-[0-9]{{2,4}}x[0-9]{{2,4}}(\.jpg)$', '\1') AS a, regexp_replace(p, '/styles/[^/]+/(public|private)/', '/') AS b FROM p)
SELECT p_partkey, regexp_replace(lower(p), '[-_][0-9]{{2,4}}x[0-9]{{2,4}}(\.\w+)$', '\1') AS identity,
  CASE WHEN a <> p THEN 'https://img.example.com' || a || '?v=' || p_size WHEN b <> p THEN 'https://img.example.com' || b || '?v=' || p_size ELSE u END AS best,
  1 + (a <> p)::INT + (b <> p)::INT AS n FROM v"""
)
def photo_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _photo()
    v = U.full_size_variants(u)
    return table(spark, sf_dir, "part").select("p_partkey", U.image_identity(u).alias("identity"), F.get(v, F.lit(0)).alias("best"), F.size(v).alias("n"))


@query(
    "SELECT p_partkey, 'https://m.edu' || CASE WHEN p_partkey % 2 = 0 THEN '/uploads/' || p_partkey || '.jpg' ELSE '/pics/' || p_partkey || '.png' END AS url FROM part"
)
def unwrapped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    proxied = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("https://m.edu/_next/image?url=%2Fuploads%2F"), k, F.lit(".jpg&w=64&q=75"))).otherwise(F.concat(F.lit("https://m.edu/_ipx/w_200,q_80/pics/"), k, F.lit(".png")))
    return table(spark, sf_dir, "part").select("p_partkey", U.unwrap_image_proxy(proxied).alias("url"))


_FILES = ["default-avatar.png", "male.jpg", "people/anna.jpg", "no-image-64x64.gif", "2019/user.png", "team/logo.png", "icons/arrow.svg", "themes/x/face.jpg"]


@query(
    f"""WITH f AS (SELECT p_partkey, '/img/' || {_sql_case("p_partkey", _FILES)} AS p FROM part), s AS (SELECT *, regexp_replace(regexp_replace(string_split(p, '/')[-1], '\\.[a-z0-9]{{2,5}}$', ''), '[-_]?[0-9]+x[0-9]+$', '') AS stem,
regexp_replace(p, '/[^/]*$', '') AS folder, regexp_split_to_array(p, '[^a-z0-9]+') AS words FROM f)
SELECT p_partkey, (list_contains(['default', 'avatar', 'user', 'users', 'no-image', 'noimage', 'placeholder', 'dummy', 'blank', 'male', 'female', 'man', 'woman', 'person', 'default-avatar', 'user-avatar', 'default-user', 'demo', 'sample'], stem)
  AND NOT regexp_matches(folder, '[0-9]')) OR contains(p, 'default-avatar') OR contains(p, 'no-image') AS placeholder,
  p LIKE '%.svg' OR p LIKE '%/themes/%' OR list_has_any(words, ['logo', 'arrow', 'icons']) AS junk FROM s"""
)
def image_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.concat(F.lit("https://m.edu/img/"), _case(F.col("p_partkey"), _FILES))
    return table(spark, sf_dir, "part").select("p_partkey", U.is_placeholder_image(u).alias("placeholder"), U.is_junk_image_url(u).alias("junk"))


_PATHS = ["/cse/faculty-members", "/people/", "/school-of-law", "/news/faculty-of-arts", "/about", "/teaching-staff/anna", "/dept/eee?x=1", "/faculty/profile/anna"]


@query(
    f"""WITH u AS (SELECT n_nationkey, n_name, s_suppkey, {_sql_case("s_suppkey", _PATHS)} AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey), w AS (SELECT *, string_split(p, '?')[1] AS path FROM u)
SELECT s_suppkey, regexp_matches(path, '(?i)faculty[-_]?members?|teaching[-_]staff|/people/?$') AND NOT regexp_matches(p, '/profile/') AS listing,
  NOT regexp_matches(p, '(?i)news') AND (regexp_matches(p, '(?i)department|dept|/school|faculty[-_]of|/faculty/') OR regexp_matches(n_name, '(?i)_1')) AS follow,
  regexp_matches(n_name, '_(3|13|23)$') AS social FROM w"""
)
def link_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = table(spark, sf_dir, "supplier").join(nation, "s_nationkey")
    u = F.concat(F.lit("https://m.edu"), _case(F.col("s_suppkey"), _PATHS))
    text = F.when(F.col("n_name").contains("_1"), "Department of Law").otherwise("x")
    host = F.when(F.col("n_name").rlike("_(3|13|23)$"), "https://www.facebook.com/x").otherwise(u)
    return j.select("s_suppkey", U.is_listing_url(u, [], ["/profile/"]).alias("listing"), U.worth_following(u, text, []).alias("follow"), U.is_social(host).alias("social"))




_SQL_SLUG = """CASE p_partkey % 5 WHEN 0 THEN 'department-of-' || replace(p_name, ' ', '-') WHEN 1 THEN replace(p_name, ' ', '_') || '_of_' || p_type WHEN 2 THEN 'bsc-in-' || replace(p_name, ' ', '-')
WHEN 3 THEN '/' || replace(p_name, ' ', '-') || '-and-Design/' ELSE lower(p_type) || '-for-it' END"""


@query(
    f"""WITH s AS (SELECT p_partkey, {_SQL_SLUG} AS s FROM part), w AS (SELECT *, list_filter(regexp_split_to_array(trim(s, '/ '), '[-_ ]+'), lambda x: x <> '') AS w FROM s),
x AS (SELECT *, CASE WHEN w[1] = 'department' AND w[2] = 'of' THEN w[3:] ELSE w END AS y FROM w)
SELECT p_partkey, array_to_string(list_transform(y, lambda t, i: CASE WHEN i > 1 AND list_contains(['and', 'of', 'in', 'for', 'the', '&'], lower(t)) THEN lower(t) WHEN length(t) <= 3 AND NOT list_contains(['and', 'of', 'in', 'for', 'the', '&'], lower(t)) THEN upper(t)
  ELSE upper(t[1]) || lower(t[2:]) END), ' ') AS title FROM x"""
)
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs made of the words of part names and types."""
    n = F.col("p_name")
    dashed = F.replace(n, F.lit(" "), F.lit("-"))
    forms = [F.concat(F.lit("department-of-"), dashed), F.concat(F.replace(n, F.lit(" "), F.lit("_")), F.lit("_of_"), "p_type"), F.concat(F.lit("bsc-in-"), dashed), F.concat(F.lit("/"), dashed, F.lit("-and-Design/")), F.concat(F.lower("p_type"), F.lit("-for-it"))]
    slug = F.get(F.array(*forms), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.slug_to_title(slug).alias("title"))


@query(
    """WITH t AS (SELECT s_suppkey, chr(65 + (s_suppkey % 26)::INT) || translate(lpad(s_suppkey::VARCHAR, 6, '0'), '0123456789', 'abcdefghij') AS w FROM supplier)
SELECT s_suppkey AS page_id, CASE s_suppkey % 5 WHEN 0 THEN 'Computing' WHEN 1 THEN w || ' Studies' WHEN 2 THEN w || ' Science' WHEN 3 THEN w || ' Law' ELSE w || ' Arts' END AS department FROM t"""
)
def page_departments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the site's map, the page's title, its breadcrumb, the text of the link to it, or its address."""
    x, k = F.lit, F.col("s_suppkey")
    w = F.concat(F.char(65 + k % 26), F.translate(F.lpad(k.cast("string"), 6, "0"), "0123456789", "abcdefghij"))
    case = lambda *forms: F.get(F.array(*(c if isinstance(c, Column) else x(c) for c in forms)), (k % 5).cast("int"))
    path = case("/department-of-computer-science/faculty-members", "/people/1", "/people/2", "/people/3", F.concat(x("/department-of-"), F.lower(w), x("-arts/people")))
    title = case("Department of Nothing", F.concat(x("Department of "), w, x(" Studies | M")), "People", "People", "People")
    crumb = case("", "", F.concat(x('<div class="breadcrumb">Home / Department of '), w, x(" Science</div>")), "", "")
    via = case("", "", "", F.concat(x("Department of "), w, x(" Law")), "")
    page = F.concat(x("<html><head><title>"), title, x("</title></head><body>"), crumb, x("<h1>People</h1><p>x</p></body></html>"))
    rows = table(spark, sf_dir, "supplier").select(k.alias("page_id"), x("m").alias("site"), F.concat(x("https://m.edu"), path).alias("url"), page.alias("html"), via.alias("via"))
    sites = spark.createDataFrame([("m", "M", "Made", {"department-of-computer-science": "Computing"})], "key string, short_name string, name string, departments map<string, string>")
    return by_texts(rows.drop("html"), H.parse_pages(rows), sites)


def _be(c: Column, n: int) -> Column:
    return F.lpad(F.hex(c), 2 * n, "0")


def _le(c: Column, n: int) -> Column:
    return F.concat(*(F.lpad(F.hex(F.floor(c / 256**k) % 256), 2, "0") for k in range(n)))


def _picture_heads(w: Column, h: Column) -> list[tuple[str | None, int, Column]]:
    """(extension, bytes, hexadecimal digits) of the beginning of a picture of each kind."""
    x = F.lit
    return [
        (".jpg", 31, F.concat(x("FFD8FFE000104A46494600010100000100010000FFC0001108"), _be(h, 2), _be(w, 2), x("0311"))),
        (".png", 24, F.concat(x("89504E470D0A1A0A0000000D49484452"), _be(w, 4), _be(h, 4))),
        (".gif", 10, F.concat(x("474946383961"), _le(w, 2), _le(h, 2))),
        (".bmp", 26, F.concat(x("424D00000000000000003600000028000000"), _le(w, 4), _le(h, 4))),
        (".webp", 30, F.concat(x("524946460000000057454250565038580A00000000000000"), _le(w - 1, 3), _le(h - 1, 3))),
        (".webp", 30, F.concat(x("5249464600000000574542505650382000000000" + "000000" + "9D012A"), _le(w, 2), _le(h, 2))),
        (".webp", 30, F.concat(x("5249464600000000574542505650384C000000002F"), _le((w - 1) + (h - 1) * (1 << 14), 4), x("0000000000"))),
        (".tif", 34, F.concat(x("49492A00080000000200" + "0001030001000000"), _le(w, 4), x("0101030001000000"), _le(h, 4))),
        (".avif", 12, x("0000001C6674797061766966")),
        (".jpg", 3, x("FFD8FF")),  # ends before it tells its size
        (None, 6, x("3C68746D6C3E")),
    ]


_KINDS = [(".jpg", 31), (".png", 24), (".gif", 10), (".bmp", 26), (".webp", 30), (".webp", 30), (".webp", 30), (".tif", 34), (".avif", 12), (".jpg", 3), (None, 6)]
_SQL_KIND = f"CASE p_partkey % {len(_KINDS)} " + " ".join(f"WHEN {k} THEN '{e}'" for k, (e, _) in enumerate(_KINDS) if e) + " END"
_SQL_BYTES = f"CASE p_partkey % {len(_KINDS)} " + " ".join(f"WHEN {k} THEN {n}" for k, (_, n) in enumerate(_KINDS)) + " END + p_size * 100"


@query(
    f"""SELECT p_partkey, e AS extension, CASE WHEN e IS NULL THEN 'not a valid image' WHEN n < 1500 THEN 'image too small' WHEN e = '.avif' THEN 'downloaded' WHEN p_partkey % {len(_KINDS)} = 9 THEN 'not a valid image'
WHEN least(w, h) < 60 THEN 'image too small' ELSE 'downloaded' END AS result, CASE WHEN e <> '.avif' AND p_partkey % {len(_KINDS)} <> 9 THEN w * 100000 + h END AS size
FROM (SELECT p_partkey, {_SQL_KIND} AS e, {_SQL_BYTES} AS n, p_size + 20 AS w, p_partkey % 97 + 40 AS h FROM part)"""
)
def image_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures of all kinds, of 21 to 70 by 40 to 136 pixels, and files that are none."""
    heads = [c for *_, c in _picture_heads(F.col("p_size") + 20, F.col("p_partkey") % 97 + 40)]
    head = F.get(F.array(*heads), (F.col("p_partkey") % len(heads)).cast("int"))
    files = table(spark, sf_dir, "part").withColumn("content", F.unhex(F.concat(head, F.repeat(F.lit("00"), F.col("p_size") * 100))))
    size = R.image_size(F.col("content"), R.sniff_extension(F.col("content")))
    return files.select("p_partkey", R.sniff_extension(F.col("content")).alias("extension"), R.image_result(F.col("content")).alias("result"), (size["width"] * 100000 + size["height"]).alias("size"))


@query(
    f"""WITH r AS (SELECT page, k % 50 AS person, k, w FROM {_SQL_PEOPLE}), g AS (SELECT page, person, min(k) AS k, max((k % 3 = 0)::INT) AS mail FROM r GROUP BY 1, 2)
SELECT 'n' || page AS site, k AS seq, CASE WHEN mail = 1 THEN 'p' || person || '@mock.edu' ELSE '' END AS email FROM g"""
)
def resolve_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one name and department are one person, with the first email that isn't empty."""
    p = people(spark, sf_dir).withColumn("person", F.col("k") % 50)
    name = F.concat(F.lit("Bela M"), _letters(F.col("person")))
    email = F.when(F.col("k") % 3 == 0, F.concat(F.lit("p"), F.col("person").cast("string"), F.lit("@mock.edu"))).otherwise("")
    empty = [F.lit("").alias(c) for c in ("designation", "department_hint", "phone", "qualifications", "research_interests", "profile_url", "photo_url")]
    records = p.select(F.concat(F.lit("n"), F.col("page").cast("string")).alias("site"), F.col("k").alias("seq"), F.lit("Law").alias("department"), F.lit("").alias("source_page"), name.alias("name"), email.alias("email"), *empty)
    return resolve(records).select("site", "seq", "email")


@query(
    f"""WITH p AS (SELECT *, 'photo' || k % 7 AS photo, CASE WHEN k % 7 < 2 THEN 'same' ELSE 'sha' || k END AS sha1 FROM {_SQL_PEOPLE}), s AS (SELECT page, sha1 FROM p GROUP BY 1, 2 HAVING count(DISTINCT w) >= 3)
SELECT k, CASE WHEN s.sha1 IS NOT NULL THEN 'placeholder (no real photo)' ELSE 'downloaded' END AS photo_status, CASE WHEN s.sha1 IS NULL THEN 'photos/N' || p.page || '/Law/Anna K' || w || '.jpg' ELSE '' END AS photo_file FROM p LEFT JOIN s USING (page, sha1)"""
)
def photo_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A picture of three or more people of a site is a placeholder; the others are saved under their names."""
    p = people(spark, sf_dir)
    url = F.concat(F.lit("https://m.edu/u/"), F.col("k").cast("string"))
    rows = p.select(F.concat(F.lit("n"), F.col("page").cast("string")).alias("site"), F.col("k").alias("seq"), F.concat(F.lit("N"), F.col("page").cast("string")).alias("university"), F.lit("Law").alias("department"), "name", F.lit("").alias("profile_url"), url.alias("photo_url"))
    sha = F.when(F.col("k") % 7 < 2, "same").otherwise(F.concat(F.lit("sha"), F.col("k").cast("string")))
    results = p.select(url.alias("url"), F.lit("downloaded").alias("result"), F.lit(".jpg").alias("extension"), sha.alias("sha1"))
    out = PH.photo_results(PH.target_paths(rows), results)
    return out.select(F.col("seq").alias("k"), "photo_status", "photo_file")


MADE = "https://www.made.edu"
_LIST = "/department-of-n{k}/faculty-members"
_SQL_LIST = f"'{MADE}/department-of-n' || page || '/faculty-members'"


def _made_site() -> SiteSpec:
    """A site of 25 departments (as many as there are nations); a third of their lists are seeds."""
    return SiteSpec(
        "made", "MADE", "Made University", f"{MADE}/", ["made.edu"], starts=[f"{MADE}/"], profile=[r"/people/\w+"],
        seeds=[MADE + _LIST.format(k=k) for k in range(25) if k % 3 == 1], departments={f"department-of-n{k}": f"Subject {chr(65 + k)}" for k in range(25)},
    )


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The home page links to a third of the lists, and to pages that link to another third.
    Lists have two pages each; one in five is gone, one in seven leads to the home page.  Each
    list page has a copy with a person who isn't on it.  Each fiftieth person's photo is only
    on their own page."""
    x = F.lit
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("page"))
    k = F.col("page").cast("string")
    slug = F.concat(x("/department-of-n"), k)
    home_links = nation.filter("page % 3 <> 1").select("page", F.when(F.col("page") % 3 == 0, F.concat(x('<a href="'), slug, x('/faculty-members">Faculty Members</a>'))).otherwise(F.concat(x('<a href="'), slug, x('">Department of N'), k, x("</a>"))).alias("a"))
    body = home_links.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "a"))), lambda i: i["a"]), " ").alias("b"))
    home = F.concat(x("<html><head><title>Made University</title></head><body><main>"), "b", x("</main></body></html>"))
    whole = body.select(x(0).cast("long").alias("page_id"), x(f"{MADE}/").alias("requested_url"), x(f"{MADE}/").alias("url"), home.alias("html"))
    between = nation.select((F.col("page") + 1000).alias("page_id"), F.concat(x(MADE), slug).alias("requested_url"), F.concat(x(MADE), slug).alias("url"), F.concat(x("<html><head><title>Department of N"), k, x('</title></head><body><main><a href="'), slug, x('/faculty-members">Our Faculty</a></main></body></html>')).alias("html"))

    w, own = F.col("w"), F.col("k") % 50 == 3
    photo = F.when(own, "/img/default-avatar.png").otherwise(F.concat(x("/uploads/"), w, x(".jpg")))
    card = F.concat(x('<div class="card"><a href="/people/'), w, x('"><img src="'), photo, x('"></a><h5><a href="/people/'), w, x('">'), F.col("name"), x('</a></h5><p class="designation">'), F.col("title"), x("</p></div>"))
    cards = people(spark, sf_dir).withColumn("part", F.col("k") % 2).groupBy("page", "part").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", card.alias("h")))), lambda i: i["h"]), "").alias("cards"))
    at = F.concat(x(MADE), slug, x("/faculty-members"), F.when(F.col("part") == 1, "?page=2").otherwise(""))
    shell = lambda more: F.concat(x("<html><head><title>Faculty Members</title></head><body><main><div>"), "cards", x(more), x('</div><ul class="pagination"><li><a href="?page=2">2</a></ul></main></body></html>'))
    gone, moved = F.col("page") % 5 == 4, F.col("page") % 7 == 6
    html = F.when(gone, x("<html><head><title>Page not found</title></head><body><h1>404</h1></body></html>")).when(moved, F.col("home")).otherwise(shell(""))
    lists = cards.crossJoin(F.broadcast(body.select(home.alias("home")))).select((F.col("page") + 2000 + 1000 * F.col("part")).alias("page_id"), at.alias("requested_url"), F.when(moved, x(f"{MADE}/")).otherwise(at).alias("url"), html.alias("html"))
    other = F.concat(x("http://made.edu"), slug, x("/faculty-members/"), F.when(F.col("part") == 1, "?page=2").otherwise(""))
    nobody = '<div class="card"><a href="/people/nobody"><img src="/uploads/nobody.jpg"></a><h5>Nobody Known</h5><p class="designation">Professor</p></div>'
    copies = cards.select((F.col("page") + 1_000_000 + 1000 * F.col("part")).alias("page_id"), other.alias("requested_url"), other.alias("url"), shell(nobody).alias("html"))
    mine = F.concat(x(f"{MADE}/people/"), w)
    profile = F.concat(x("<html><head><title>"), F.col("name"), x("</title></head><body><main><h1>"), F.col("name"), x('</h1><div class="profile"><img src="/uploads/people/'), w, x('.jpg" width="200" height="220"></div><p>'), F.col("title"), x("</p></main></body></html>"))
    profiles = people(spark, sf_dir).filter(own).select((F.col("k") + 10_000_000).alias("page_id"), mine.alias("requested_url"), mine.alias("url"), profile.alias("html"))
    return whole.unionByName(between).unionByName(lists).unionByName(copies).unionByName(profiles)


@query(
    f"""SELECT 'Anna K' || w AS name, 'Subject ' || chr(65 + page::INT) AS department, {_SQL_TITLE} AS designation, '{MADE}/people/' || w AS profile_url,
'{MADE}/uploads/' || CASE WHEN k % 50 = 3 THEN 'people/' ELSE '' END || w || '.jpg' AS photo_url, {_SQL_LIST} || CASE WHEN k % 2 = 1 THEN '?page=2' ELSE '' END AS source_page
FROM {_SQL_PEOPLE} WHERE page % 5 <> 4 AND page % 7 <> 6"""
)
def made_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawl, extraction, resolution and profile visits over a site made of all customers."""
    found, _ = directory(E.cut(_made_pages(spark, sf_dir)), site_tables(spark, [_made_site()]), CrawlSettings(max_profiles=None))
    return found.select("name", "department", "designation", "profile_url", "photo_url", "source_page")


@query(
    """WITH RECURSIVE c AS (SELECT c_nationkey AS n, c_custkey AS page, row_number() OVER w AS k, lead(c_custkey) OVER w AS after, first_value(c_custkey) OVER w AS first, count(*) OVER (PARTITION BY c_nationkey) AS all_ FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
e AS (SELECT n, page, k, CASE WHEN after IS NOT NULL THEN after WHEN n % 3 = 0 THEN first WHEN n % 3 = 1 THEN page END AS next FROM c WHERE k <> all_ // 2 OR n % 4 <> 2),
r(n, page, pos, next) AS (SELECT n, page, 0, next FROM e WHERE k = 1 UNION ALL SELECT e.n, e.page, r.pos + 1, e.next FROM r JOIN e ON r.next = e.page WHERE e.k > 1 AND e.page <> r.page)
SELECT n::BIGINT AS list, page, pos::BIGINT AS pos FROM r"""
)
def page_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers of a nation are pages of a list, each naming the next; some lists end at
    their last page, some there lead back to the first or to themselves, some are broken."""
    w = Window.partitionBy("c_nationkey").orderBy("c_custkey")
    n = F.col("c_nationkey")
    c = table(spark, sf_dir, "customer").select(n.cast("long").alias("list"), F.col("c_custkey").alias("page"), F.row_number().over(w).alias("k"), F.lead("c_custkey").over(w).alias("after"), F.first("c_custkey").over(w).alias("first"), F.count("*").over(Window.partitionBy("c_nationkey")).alias("all"))
    after = F.coalesce("after", F.when(F.col("list") % 3 == 0, F.col("first")).when(F.col("list") % 3 == 1, F.col("page")))
    links = c.filter((F.col("k") != F.floor(F.col("all") / 2)) | (F.col("list") % 4 != 2)).select("list", "page", "k", after.alias("next"))
    return chain_pages(links.select("page", "next"), links.filter("k = 1").select("list", F.col("page").alias("start")), "list")
