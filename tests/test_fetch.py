"""Fetch rules of the page source, over saved answers."""

import pytest

from dirloom.sources import fetch as X

ANSWERS = "url string, failures int, status int, final_url string, content_type string, body binary"


def answer(url, status=200, kind="text/html", body=b"<p>x</p>", failures=0, final=None):
    return url, failures, status, final, kind, body


def outcomes(spark, tmp_path, requests, answers, **options):
    r = spark.createDataFrame([(u, k, kind) for k, (u, kind) in enumerate(requests)], "url string, seq long, kind string")
    df = X.fetched(r, str(tmp_path / "f"), 4, spark.createDataFrame(answers, ANSWERS), **options)
    return [r for r in df.orderBy("seq").collect()]


def test_pages_pictures_and_statuses(spark, tmp_path):
    requests = [("https://a.edu/1", "page"), ("https://a.edu/2.pdf", "page"), ("https://a.edu/2.pdf", "image"), ("https://a.edu/gone", "page"), ("https://a.edu/moved", "page"), ("ftp://a.edu/", "page")]
    answers = [answer("https://a.edu/1"), answer("https://a.edu/2.pdf", kind="application/pdf"), answer("https://a.edu/gone", 404), answer("https://a.edu/moved", final="https://a.edu/")]
    got = outcomes(spark, tmp_path, requests, answers)
    assert [r["outcome"] for r in got] == ["fetched", "not a page", "fetched", "http 404", "fetched", "no connection"]
    assert got[0]["content"] == b"<p>x</p>" and got[4]["final_url"] == "https://a.edu/" and got[3]["content"] is None
    assert [r["slot"] for r in got] == [0.0, 1.5, 0.0, 3.0, 4.5, None]  # pictures have slots of their own


def test_other_scheme_and_retries(spark, tmp_path):
    answers = [answer("http://a.edu/1"), answer("https://a.edu/2", failures=3), answer("https://a.edu/3", 503), answer("https://a.edu/4", failures=4)]
    got = outcomes(spark, tmp_path, [(f"https://a.edu/{k}", "page") for k in (1, 2, 3, 4)], answers)
    assert [(r["outcome"], r["attempts"]) for r in got] == [("fetched", 5), ("fetched", 4), ("http 503", 4), ("no connection", 8)]
    assert [r["slot"] for r in got] == [1.5, 3.0, 4.5, 7.5]


def test_answers_of_one_request(spark, tmp_path):
    """Pages of one address have answers, or none, of their own; robots rules are for all."""
    requests = spark.createDataFrame([("https://a.edu/p", k, "page") for k in range(4)], "url string, seq long, kind string")
    answers = [(*answer("https://a.edu/p"), 0), (*answer("https://a.edu/p", 404), 2), (*answer("http://a.edu/p", kind="application/pdf"), 3), (*answer("https://a.edu/robots.txt", kind="text/plain", body=b"User-agent: *\nCrawl-delay: 3"), None)]
    got = X.fetched(requests, str(tmp_path / "f"), 4, spark.createDataFrame(answers, ANSWERS + ", seq long"), retries=0).orderBy("seq").collect()
    assert [(r["outcome"], r["slot"]) for r in got] == [("fetched", 0.0), ("no connection", 6.0), ("http 404", 9.0), ("not a page", 15.0)]


def test_dead_hosts_are_left_alone(spark, tmp_path):
    """Six failures in a row end a host, not its site; one answer starts the count anew."""
    requests = [(f"https://x.a.edu/{k}", "page") for k in range(14)] + [("https://a.edu/", "page")]
    got = outcomes(spark, tmp_path, requests, [answer("https://x.a.edu/5"), answer("https://x.a.edu/13"), answer("https://a.edu/")], retries=0)
    assert [r["outcome"] for r in got] == ["no connection"] * 5 + ["fetched"] + ["no connection"] * 6 + ["dead host"] * 2 + ["fetched"]


@pytest.mark.parametrize(("body", "kind", "allowed", "delay"), [(b"User-agent: *\nDisallow: /p\nCrawl-delay: 90", "text/plain", False, 15.0), (b"User-agent: *\nDisallow: /p", "text/html", True, 1.5), (b"User-agent: other\nDisallow: /", "text/plain", True, 1.5)])
def test_robots(spark, tmp_path, body, kind, allowed, delay):
    answers = [answer("https://a.edu/robots.txt", kind=kind, body=body), *(answer(f"https://a.edu/{u}") for u in ("p", "q", "r"))]
    got = outcomes(spark, tmp_path, [(f"https://a.edu/{u}", "page") for u in ("p", "q", "r")], answers)
    assert (got[0]["outcome"] == "fetched") == allowed and got[2]["slot"] - got[1]["slot"] == delay
    assert [r["outcome"] for r in outcomes(spark, tmp_path, [("https://a.edu/p", "page")], answers, robots=False)] == ["fetched"]


def test_filters_of_sites_are_pushed_down(spark, tmp_path):
    requests = spark.createDataFrame([(f"https://{s}.edu/", k, "page") for k, s in enumerate("abcd")], "url string, seq long, kind string")
    answers = spark.createDataFrame([answer(f"https://{s}.edu/") for s in "abcd"], ANSWERS)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = X.fetched(requests, str(tmp_path / "f"), 4, answers).filter("site = 'c.edu'")
        assert [r["url"] for r in df.collect()] == ["https://c.edu/"]
        assert "c.edu" not in df._jdf.queryExecution().executedPlan().toString()  # Spark has no such filter of its own left
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    reader = X.PushingReader({"buckets": "1"})
    assert list(reader.pushFilters([X.EqualTo(("site",), "a"), X.EqualTo(("kind",), "page")])) == [X.EqualTo(("kind",), "page")] and reader.sites == ["a"]
