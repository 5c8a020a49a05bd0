"""Column functions against plain expectations."""

import random
from urllib.parse import urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from dirloom.functions import text as T
from dirloom.functions import urls as U


def apply(spark, f, values):
    rows = spark.createDataFrame(list(enumerate(values)), "k int, v string").select("k", f(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["k"])]


def test_names(spark):
    good = ["Dr. Anna Karlow", "Md. Rafid Olson", "Prof. Dr. Jörg Önder, PhD", "Bela Mirstone", "O’Neil Carrow", "Engr. Tansy", "Mary-Jane Plover", "A. K. M. Fenwick"]
    bad = ["Faculty Members", "Contact", "Lecturer", "Department of Law", "read more", "12345", "Kim", "all of our news", "x@mock.edu", "Head of School", ""]
    assert all(apply(spark, T.looks_like_name, good))
    assert not any(apply(spark, T.looks_like_name, bad))


def test_name_key_and_clean_name(spark):
    keys = apply(spark, T.name_key, ["Prof. Dr. Jörg Önder, PhD", "Jorg Onder", "1. Jorg Onder (On Leave)", "Jorg Onder, Professor"])
    assert set(keys) == {"jorg onder"}


def test_designations(spark):
    raw = ["Asst. Prof. & Head", "Designation: Sr. Lecturer", "Lab Officer", "Lecturer & Lab Coordinator"]
    assert apply(spark, T.normalize_designation, raw)[:2] == ["Assistant Professor & Head", "Senior Lecturer"]
    assert apply(spark, T.is_non_academic, raw) == [False, False, True, False]
    assert apply(spark, lambda c: T.normalize_designation(c), ["ASSISTANT PROFESSOR"]) == ["Assistant Professor"]


def test_contacts(spark):
    assert apply(spark, T.extract_emails, ["A [at] mock [dot] edu, a@mock.edu b@x.org pic@2x.png"]) == [["a@mock.edu", "b@x.org"]]
    assert apply(spark, T.extract_phone, ["Tel: +1 (20) 555-1234 x", "call 01712345678", "none"]) == ["+1 (20) 555-1234", "01712345678", ""]


def test_files_and_slugs(spark):
    assert apply(spark, T.safe_filename, ["a/b:c?", "con", "  .x. ", ""]) == ["a b c", "_con", "x", "unnamed"]
    assert apply(spark, T.slug_to_title, ["department-of-computer-science-and-engineering", "cse", "law_of-the-sea"]) == ["Computer Science and Engineering", "CSE", "LAW of the SEA"]


def test_lines(spark):
    assert apply(spark, T.text_lines, ["• a  b\r\n\na b\nc |\n c", None]) == [["a b", "c"], []]


@pytest.mark.parametrize(
    ("href", "want"),
    [("/a b", "https://mock.edu/a%20b"), ("x.html#t", "https://mock.edu/d/x.html"), ("../y", "https://mock.edu/y"), ("//CDN.org/z", "https://cdn.org/z"), ("mailto:a@b.c", ""), ("#x", ""), ("?q=1", "https://mock.edu/d/e?q=1"), ("HTTP://X.ORG", "http://x.org/"), (None, "")],
)
def test_absolute_url(spark, href, want):
    rows = spark.createDataFrame([(href, "https://mock.edu/d/e")], "h string, b string")
    assert rows.select(U.absolute_url(F.col("h"), F.col("b")).alias("u")).first()["u"] == want


def test_references_resolve_as_the_standard_library_does(spark):
    rng = random.Random(4)
    hrefs = ["/".join(rng.choice(["", ".", "..", "a", "b.c", "..x", "...", "d"]) for _ in range(rng.randint(1, 7))) + rng.choice(["", "", "?q=1/../2", "#f"]) for _ in range(600)]
    hrefs += ["http:x", "https://o.org/a/../b/./c", "//o.org/a/../b", "?x", "/..", "/.", ".", "..", "./", "../", "x/..", "//o.org", "a\tb", "ftp://x/y", "a//b", "/a//../b"]
    bases = ["https://m.edu/d/e", "https://m.edu", "http://m.edu/", "https://m.edu/a/b/c/?p=1", "https://m.edu/a//b/c.html"]
    hrefs = [h for h in hrefs if not h.startswith("///")]  # an empty host: no URL of a page
    rows = spark.createDataFrame([(h, b) for h in hrefs for b in bases], "h string, b string")

    def want(h, b):
        if not h or h.startswith("#"):
            return ""
        u = urlsplit(urljoin(b, h))
        return f"{u.scheme}://{u.netloc}{u.path or '/'}" + (f"?{u.query}" if u.query else "") if u.scheme in ("http", "https") else ""

    bad = [(r["h"], r["b"], r["u"], want(r["h"], r["b"])) for r in rows.select("h", "b", U.absolute_url(F.col("h"), F.col("b")).alias("u")).collect() if r["u"] != want(r["h"], r["b"])]
    assert not bad, bad[:10]


def test_url_keys(spark):
    assert apply(spark, U.canonical_url, ["https://www.Mock.edu/a/?b=2&a=1#f", "http://mock.edu"]) == ["mock.edu/a?a=1&b=2", "mock.edu/"]
    assert len(set(apply(spark, U.listing_key, ["https://mock.edu/l?page=2&d=1", "https://www.mock.edu/l/page/3/?d=1"]))) == 1
    assert apply(spark, U.site_key, ["https://a.b.mock.edu/x", "https://a.mock.ac.uk"]) == ["mock.edu", "mock.ac.uk"]
    assert apply(spark, U.full_size_variants, ["https://m.edu/p-150x150.jpg?w=9", "https://m.edu/x.jpg?w=100"]) == [["https://m.edu/p.jpg", "https://m.edu/p-150x150.jpg?w=9"], ["https://m.edu/x.jpg?w=100"]]
    assert apply(spark, U.is_placeholder_image, ["https://m.edu/img/avatar.png", "https://m.edu/77/avatar.png", "https://m.edu/no-photo.jpg", "https://m.edu/ann.jpg"]) == [True, False, True, False]
