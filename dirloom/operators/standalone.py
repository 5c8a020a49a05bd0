"""List pages of the five stand-alone sources, over the node table, and their photo states.

"The heading before" and "the table after" are windows in document order; a list's
pages are read up to its last page, or to the first that brings nothing new.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..functions import urls as U
from .html import attribute, with_text

MAX_PAGES = 60
CLIMB = 8
HEADING = r"^h[1-6]$"


def _text() -> Column:
    return F.trim(T.squeeze(F.col("text")))


def _link(href: Column) -> Column:
    return U.absolute_url(href, F.col("base"))


def _inside(nodes: DataFrame, *columns: Column | str) -> DataFrame:
    """(page_id, box, pre, columns): each element under each of its ancestors and itself."""
    return nodes.select("page_id", F.explode(F.concat("ancestors", F.array("pre"))).alias("box"), "pre", *columns)


def departments_of_home(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, faculty, department, url): links to staff lists, under the last
    "Faculty of ..." said before; the first link of each URL."""
    order = Window.partitionBy("page_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, 0)
    said = F.when(F.col("own_text").rlike(r"^\s*Faculty of"), F.trim("own_text"))
    marked = nodes.withColumn("faculty", F.last(said, ignorenulls=True).over(order))
    a = with_text(marked.filter((F.col("tag") == "a") & attribute("href").rlike(P.TEACHERS_PATH)), nodes)
    a = a.select("page_id", "pre", F.coalesce("faculty", F.lit(P.UNKNOWN_FACULTY)).alias("faculty"), _text().alias("department"), _link(attribute("href")).alias("url")).filter("department <> ''")
    first = a.groupBy("page_id", "url").agg(F.min(F.struct("pre", "faculty", "department")).alias("f"))
    return first.select("page_id", F.col("f.pre").alias("pos"), "f.faculty", "f.department", "url")


def photo_list(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, name, designation, profile_url, image_url, is_dean): people by their
    photos under /images/; those before a "Department of" heading are deans."""
    src = T.first_filled(attribute("src"), attribute("data-src"))
    img = nodes.filter((F.col("tag") == "img") & F.contains(src, F.lit("/images/")) & ~F.contains(src, F.lit("/dist/")))
    li = nodes.filter("tag = 'li'").select("page_id", F.col("pre").alias("box"))
    up = img.select("page_id", "pre", F.explode("ancestors").alias("box")).join(li, ["page_id", "box"]).groupBy("page_id", "pre").agg(F.max("box").alias("li"))
    cards = img.select("page_id", "pre", "parent", "base", src.alias("src"), F.trim(attribute("alt")).alias("alt")).join(up, ["page_id", "pre"], "left").withColumn("box", F.coalesce("li", "parent"))
    parts = _inside(with_text(nodes.filter(F.col("tag").rlike("^(a|h[1-6])$")), nodes), "tag", _text().alias("t"), attribute("href").alias("href")).withColumnRenamed("pre", "at")

    def first(c: Column, *fields: str) -> Column:
        return F.min(F.when(c, F.struct("at", *fields)))

    held = parts.join(cards.select("page_id", "box").distinct(), ["page_id", "box"], "left_semi").groupBy("page_id", "box").agg(
        first((F.col("tag") == "a") & F.contains("href", F.lit("/profile/")), "href", "t").alias("link"),
        first(F.col("tag").rlike(HEADING), "t").alias("heading"),
        first(F.col("tag") == "h4", "t").alias("h4"),
    )
    marks = with_text(nodes.filter(F.col("tag").rlike(HEADING)), nodes).filter(_text().rlike("^Department of")).groupBy("page_id").agg(F.min("pre").alias("mark"))
    j = cards.join(held, ["page_id", "box"], "left").join(marks, "page_id", "left")
    name = F.when(F.coalesce("link.t", F.lit("")) != "", F.col("link.t")).when(F.col("heading").isNotNull(), F.col("heading.t")).otherwise(F.col("alt"))
    out = j.select(
        "page_id",
        F.col("pre").alias("pos"),
        name.alias("name"),
        F.coalesce("h4.t", F.lit("")).alias("designation"),
        F.when(F.col("link").isNotNull(), _link(F.col("link.href"))).otherwise("").alias("profile_url"),
        _link(F.col("src")).alias("image_url"),
        F.coalesce(F.col("pre") < F.col("mark"), F.lit(False)).alias("is_dean"),
    )
    return out.filter("name <> ''")


def linked_page(nodes: DataFrame, said: str) -> DataFrame:
    """(page_id, url): where the first link that says so leads, unless to the page itself."""
    a = nodes.filter((F.col("tag") == "a") & F.col("own_text").rlike(said) & (attribute("href") != "")).select("page_id", "pre", "base", attribute("href").alias("href"))
    first = a.groupBy("page_id").agg(F.min(F.struct("pre", "base", "href")).alias("a")).select("page_id", "a.base", "a.href")
    return first.withColumn("url", _link(F.col("href"))).filter(~F.startswith("href", F.lit("#")) & (F.col("url") != "") & (F.col("url") != F.col("base"))).select("page_id", "url")


def headed_tables(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, department, name, profile_url, designation, email): rows of the table
    that follows each "Faculty Member List" heading; columns count, names come second."""
    heading = F.col("tag").rlike("^h[1-5]$") & F.lower(_text()).startswith("faculty member list")
    after = Window.partitionBy("page_id").orderBy("pre").rowsBetween(1, Window.unboundedFollowing)
    marked = with_text(nodes.filter(F.col("tag").rlike("^(h[1-5]|table)$")), nodes).filter(heading | (F.col("tag") == "table")).withColumn("table", F.min(F.when(F.col("tag") == "table", F.col("pre"))).over(after))
    heads = marked.filter(heading & F.col("table").isNotNull())
    title = _text()
    heads = heads.select("page_id", F.col("pre").alias("head"), "table", F.when(F.contains(title, F.lit(":")), F.trim(F.regexp_replace(title, "^[^:]*:", ""))).otherwise(title).alias("department"))
    rows = _inside(nodes.filter("tag = 'tr'")).withColumnRenamed("box", "table").join(heads, ["page_id", "table"])
    links = _inside(with_text(nodes.filter("tag = 'a'"), nodes), attribute("href").alias("href"), _text().alias("said")).groupBy("page_id", "box").agg(F.min(F.struct("pre", "href", "said")).alias("link")).withColumnRenamed("box", "cell")
    cells = with_text(nodes.filter(F.col("tag").isin("td", "th")), nodes).select("page_id", "base", F.col("parent").alias("pre"), F.col("pre").alias("cell"), "tag", _text().alias("t")).join(links, ["page_id", "cell"], "left")
    listed = cells.groupBy("page_id", "pre").agg(F.first("base").alias("base"), F.max((F.col("tag") == "th").cast("int")).alias("th"), F.sort_array(F.collect_list(F.struct("cell", "t", "link"))).alias("c"))
    j = rows.join(listed, ["page_id", "pre"]).filter("th = 0 and size(c) >= 2").withColumn("link", F.col("c")[1]["link"])
    linked = F.coalesce("link.href", F.lit("")) != ""

    def cell(k: int) -> Column:
        return F.coalesce(F.get("c", F.lit(k))["t"], F.lit(""))

    out = j.select("page_id", F.col("pre").alias("pos"), "department", F.when(linked, F.col("link.said")).otherwise(cell(1)).alias("name"), F.when(linked, _link(F.col("link.href"))).otherwise("").alias("profile_url"), cell(2).alias("designation"), cell(4).alias("email"))
    return out.filter("name <> ''")


def portrait(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """(page_id, image_url): the upload on a profile page whose text fits the name best; names: (page_id, name)."""
    src = T.first_filled(attribute("src"), attribute("data-src"))
    file = F.lower(F.substring_index(src, "/", -1))
    other = F.exists(F.array(*(F.lit(h) for h in P.NO_PORTRAITS)), lambda h: F.contains(file, h))
    img = nodes.filter((F.col("tag") == "img") & F.contains(src, F.lit(P.UPLOADS)) & ~other).join(names, "page_id")
    said = F.trim(F.concat_ws(" ", F.lower(F.trim(attribute("alt"))), F.lower(F.trim(attribute("title")))))
    name = F.lower("name")

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.regexp_replace(c, "[.,]", " "), r"\s+"), lambda w: w != ""))

    score = F.when((said != "") & (F.contains(name, said) | F.contains(said, name)), 100).otherwise(F.size(F.array_intersect(words(name), words(said))))
    return img.groupBy("page_id").agg(F.max(F.struct(score.alias("s"), (-F.col("pre")).alias("o"), _link(src).alias("u")))["u"].alias("image_url"))


def _lazy_source() -> Column:
    values = F.array(*(F.trim(attribute(a)) for a in P.LAZY_SOURCES))
    return F.coalesce(F.get(F.filter(values, lambda v: (v != "") & ~v.startswith("data:")), F.lit(0)), F.lit(""))


def linked_cards(nodes: DataFrame, department_path: str) -> DataFrame:
    """(page_id, pos, name, profile_url, img_src): links below a department's path; a
    card's picture is the first in the least box around the link that holds one, unless
    the box holds other people's links."""
    href = attribute("href")
    root = department_path.rstrip("/")
    target = _link(href)
    mine = ~href.rlike("^(#|mailto:|tel:|javascript:)") & (U.query(target) == "") & F.startswith(F.regexp_replace(U.path(target), "/+$", ""), F.lit(root + "/"))
    links = nodes.filter((F.col("tag") == "a") & (href != "")).withColumn("url", target).filter(mine)
    links = with_text(links, nodes).select("page_id", "pre", "ancestors", "url", _text().alias("t"))
    held = links.select("page_id", F.explode(F.concat("ancestors", F.array("pre"))).alias("box"), "url").groupBy("page_id", "box").agg(F.count_distinct("url").alias("people"))
    pictures = _inside(nodes.filter("tag = 'img'"), _lazy_source().alias("src"), T.squeeze(attribute("alt")).alias("alt")).groupBy("page_id", "box").agg(F.min(F.struct("pre", "src", "alt")).alias("img"))
    climb = links.select("page_id", "pre", "url", F.posexplode(F.slice(F.reverse(F.concat("ancestors", F.array("pre"))), 1, CLIMB)).alias("level", "box"))
    tags = nodes.select("page_id", F.col("pre").alias("box"), F.col("tag").alias("box_tag"))
    steps = climb.join(held, ["page_id", "box"]).join(tags, ["page_id", "box"]).join(pictures, ["page_id", "box"], "left")
    order = Window.partitionBy("page_id", "pre").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.max(((F.col("people") > 1) | F.col("box_tag").isin("body", "html")).cast("int")).over(order)
    found = steps.withColumn("stop", stop).filter((F.col("stop") == 0) & (F.coalesce("img.src", F.lit("")) != "")).groupBy("page_id", "pre").agg(F.min_by("img", "level").alias("img"))
    j = links.join(found, ["page_id", "pre"], "left")
    per = j.groupBy("page_id", "url").agg(F.min("pre").alias("pos"), F.min(F.when(F.col("t") != "", F.struct("pre", "t")))["t"].alias("t"), F.min(F.when(F.col("img").isNotNull(), F.struct("pre", "img")))["img"].alias("img"))
    return per.select("page_id", "pos", T.first_filled(F.col("t"), F.col("img.alt")).alias("name"), F.col("url").alias("profile_url"), F.coalesce("img.src", F.lit("")).alias("img_src"))


def celled_people(nodes: DataFrame) -> DataFrame:
    """(page_id, pos, name, profile_url, img_src): table rows with a picture in the first cell and a bold name in the second."""
    cells = nodes.filter("tag = 'td'").select("page_id", "base", F.col("parent").alias("row"), F.col("pre").alias("cell"))
    k = F.row_number().over(Window.partitionBy("page_id", "row").orderBy("cell"))
    cells = cells.withColumn("k", k).filter("k <= 2")
    parts = _inside(with_text(nodes.filter(F.col("tag").isin("strong", "b", "a", "img")), nodes), "tag", _text().alias("t"), attribute("href").alias("href"), _lazy_source().alias("src")).withColumnRenamed("box", "cell")
    j = cells.join(parts, ["page_id", "cell"], "left")
    second = F.col("k") == 2
    out = j.groupBy("page_id", "row").agg(
        F.max("k").alias("cells"),
        F.first("base").alias("base"),
        F.min(F.when(second & F.col("tag").isin("strong", "b"), F.struct("pre", "t")))["t"].alias("name"),
        F.min(F.when(second & (F.col("tag") == "a") & (F.lower("t") == "profile") & (F.col("href") != ""), F.struct("pre", "href")))["href"].alias("href"),
        F.min(F.when((F.col("k") == 1) & (F.col("tag") == "img"), F.struct("pre", "src")))["src"].alias("src"),
    )
    out = out.filter("cells = 2 and name <> ''")
    return out.select("page_id", F.col("row").alias("pos"), "name", T.first_filled(_link(F.col("href")), F.concat(F.lit("ece:"), "name")).alias("profile_url"), F.coalesce("src", F.lit("")).alias("img_src"))


def last_page(nodes: DataFrame, path: str) -> DataFrame:
    """(page_id, last): the greatest ?page=N among links below a path, 1 if none."""
    href = attribute("href")
    n = F.regexp_extract(href, r"[?&]page=(\d+)", 1).try_cast("int")
    a = F.when((F.col("tag") == "a") & F.contains(U.path(href), F.lit(path)), n)
    return nodes.groupBy("page_id").agg(F.greatest(F.lit(1), F.coalesce(F.max(a), F.lit(1))).alias("last"))


def new_until_none(people: DataFrame, list_key: str, page: str, order: str, most: int = MAX_PAGES) -> DataFrame:
    """The people of a list's pages, each profile_url once, up to the first page without new ones; at most ``most`` pages."""
    once = people.filter(F.col(page) <= most).withColumn("_n", F.row_number().over(Window.partitionBy(list_key, "profile_url").orderBy(page, order))).filter("_n = 1").drop("_n")
    pages = once.select(list_key, page).distinct()
    k = F.row_number().over(Window.partitionBy(list_key).orderBy(page))
    unbroken = pages.withColumn("_k", k).filter(F.col("_k") == F.col(page)).select(list_key, page)
    return once.join(unbroken, [list_key, page], "left_semi")


# --- files and photo states ---------------------------------------------------------------


def plain_filename(c: Column, underscored: bool = False) -> Column:
    """File names of these sources: without what file systems refuse, 120 characters; or
    (``underscored``) letters, digits, dots and dashes joined by underscores."""
    if underscored:
        v = T.squeeze(F.regexp_replace(T.decomposed(c), r"(?U)[^\w\s.-]", ""))
        return F.coalesce(F.nullif(F.replace(T.strip_chars(v, "."), F.lit(" "), F.lit("_")), F.lit("")), F.lit("unnamed"))
    v = T.strip_chars(F.regexp_replace(T.squeeze(c), r'[<>:"/\\|?*\x00-\x1f]', ""), " .")
    return F.coalesce(F.nullif(F.substring(v, 1, 120), F.lit("")), F.lit("unknown"))


def unique_stems(df: DataFrame, folder: str, stem: str, order: str) -> DataFrame:
    """``path_stem``: the stem, or ``stem_k`` for the k-th of its folder, ignoring case."""
    k = F.row_number().over(Window.partitionBy(folder, F.lower(stem)).orderBy(order))
    return df.withColumn("path_stem", F.when(k == 1, F.col(stem)).otherwise(F.concat(stem, F.lit("_"), k.cast("string"))))


def tidy_variants(u: Column) -> Column:
    """The URL, and it without doubled slashes and the repeated folder."""
    p = F.replace(F.regexp_replace(U.path(u), "/{2,}", "/"), F.lit(P.REPEATED_FOLDER), F.lit(P.REPEATED_FOLDER[: len(P.REPEATED_FOLDER) // 2 + 1]))
    tidy = F.concat(U.scheme(u), F.lit("://"), U.authority(u), p, F.when(U.query(u) != "", F.concat(F.lit("?"), U.query(u))).otherwise(""))
    return F.array_distinct(F.array(u, tidy))


def file_extension(u: Column, content_type: Column | None = None) -> Column:
    """The URL's ending if it is a picture's, else the content type's, else .jpg."""
    ext = U.url_extension(u)
    kinds = F.create_map(*(F.lit(x) for kv in P.CONTENT_TYPES.items() for x in kv))
    other = F.try_element_at(kinds, content_type) if content_type is not None else F.lit(None).cast("string")
    return F.when(ext.isin(P.SOURCE_EXTENSIONS), ext).otherwise(F.coalesce(other, F.lit(".jpg")))


def served_as_image(u: Column, content_type: Column) -> Column:
    kind = F.lower(F.trim(F.substring_index(content_type, ";", 1)))
    binary = kind.isin("application/octet-stream", "binary/octet-stream")
    return kind.startswith("image/") | (binary & U.url_extension(u).isin(P.SOURCE_EXTENSIONS))


def list_photo_status(img: Column, url: Column, exists: Column, fetched: Column) -> Column:
    """State of a photo of the paged lists; ``fetched``: "downloaded" or "failed: ..."."""
    generic = F.exists(F.array(*(F.lit(h) for h in P.DEFAULT_PORTRAITS)), lambda h: F.contains(F.lower(url), h))
    return F.when(img == "", "no_image").when(generic, "placeholder_skipped").when(exists, "skipped_exists").otherwise(fetched)


def profile_photo_status(profile: Column, page_read: Column, image: Column, saved: Column, skip: bool = False) -> Column:
    """State of a photo that is looked for on the person's own page."""
    file = F.lower(F.substring_index(image, "/", -1))
    generic = F.exists(F.array(*(F.lit(h) for h in P.SITE_PLACEHOLDERS)), lambda h: F.contains(file, h))
    done = F.when(~saved, "download_failed").when(generic, "placeholder_downloaded").otherwise("downloaded")
    done = F.when(generic, "skipped_placeholder").otherwise(done) if skip else done
    return F.when(F.coalesce(profile, F.lit("")) == "", "no_profile_link").when(~page_read, "profile_fetch_failed").when(F.coalesce(image, F.lit("")) == "", "no_image_found").otherwise(done)


def status_totals(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """(by, found, downloaded, existing, placeholder, no_image, failed) of each value and in total."""
    is_ = {"downloaded": F.col(status) == "downloaded", "existing": F.col(status) == "skipped_exists", "placeholder": F.col(status) == "placeholder_skipped", "no_image": F.col(status) == "no_image", "failed": F.startswith(status, F.lit("failed"))}
    out = rows.rollup(by).agg(F.count("*").alias("found"), *(F.count_if(c).alias(k) for k, c in is_.items()))
    return out.withColumn(by, F.coalesce(by, F.lit("TOTAL")))
