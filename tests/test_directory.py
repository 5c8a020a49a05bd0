"""Departments, site rules, the crawl and people over small sites."""

import re

import pytest
from pyspark.sql import functions as F

from dirloom import site_fixture as X
from dirloom import sources as S
from dirloom.functions import urls as U
from dirloom.operators import crawl as C
from dirloom.operators import extract as E
from dirloom.operators import html as H
from dirloom.operators import people as PP
from dirloom.operators.departments import page_departments
from dirloom.operators.people import directory
from dirloom.sites import SITES


def judged(spark, rows):
    """(allowed, listing, profile) of each (site, url)."""
    sites = S.site_tables(spark, SITES)["site"].withColumnRenamed("key", "site")
    urls = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, site string, url string").join(sites, "site")
    u = F.col("url")
    got = urls.select("k", U.is_allowed(u, F.col("domains"), F.col("blocked"), F.col("exclude")), U.is_listing_url(u, F.col("listing"), F.col("profile")), U.matches_any(u, F.col("profile")))
    return [tuple(r[1:]) for r in sorted(got.collect())]


def test_every_seed_is_a_list_that_may_be_read(spark):
    rows = [(s.key, u) for s in SITES for u in s.seeds]
    assert len(rows) > 50 and [x for x, g in zip(rows, judged(spark, rows), strict=True) if g[:2] != (True, True)] == []


def test_starts_and_blocked_hosts(spark):
    rows = [(s.key, u) for s in SITES for u in (*s.starts, *s.fallback)]
    assert all(g[0] for g in judged(spark, rows))
    refused = [(s.key, f"https://{h}/x") for s in SITES for h in s.blocked] + [(s.key, u) for s in SITES for u in (f"https://jobs.{s.domains[0]}/", f"https://x{s.domains[0]}/", f"https://{s.domains[0]}/a.pdf", "https://elsewhere.example/faculty")]
    assert not any(g[0] for g in judged(spark, refused))


def test_numbered_profiles_match_their_sites_patterns(spark):
    rows = [(s.key, s.profile_ids[0].replace("{id}", str(n))) for s in SITES if s.profile_ids for n in (s.profile_ids[1], s.profile_ids[2] - 1)]
    assert rows and all(g == (True, False, True) for g in judged(spark, rows))


@pytest.mark.parametrize(("tail", "kinds"), [("faculty-members", (True, False)), ("faculty-members/", (True, False)), ("faculty-view/anna-karlow", (False, True)), ("faculty-view/", (False, False)), ("news/faculty-view-of-the-year", (False, False))])
def test_lists_and_profiles_of_one_site(spark, tail, kinds):
    ewu = next(s for s in SITES if s.key == "ewu")
    root = re.match(r"https?://[^/]+/", ewu.seeds[0])[0]
    assert judged(spark, [("ewu", root + ("some-department/" if kinds[0] else "") + tail)])[0][1:] == kinds


def test_departments_follow_the_slug_of_each_site(spark):
    """Each slug of a site's map, in an address made for it, gives the map's department."""
    rows = [(k, s.key, f"https://{s.domains[0]}/{slug}/faculty", name) for s in SITES for k, (slug, name) in enumerate(s.departments.items())]
    rows = [(n, *r[1:]) for n, r in enumerate(rows)]
    pages = spark.createDataFrame([r[:3] for r in rows], "page_id long, site string, url string")
    got = {r["page_id"]: r["department"] for r in page_departments(pages, None, S.site_tables(spark, SITES)["site"]).collect()}
    assert len(rows) > 80 and [(r, got[r[0]]) for r in rows if got[r[0]] != r[3]] == []


def test_unknown_sites(spark):
    assert [s.key for s in S.select_sites(SITES, ["EWU", "cub"])] == ["ewu", "cub"]
    with pytest.raises(ValueError, match="unknown sites: nowhere"):
        S.select_sites(SITES, ["EWU", "nowhere"])


def test_directory_of_a_small_site(spark):
    people, log = directory(X.pages(spark), S.site_tables(spark, [X.SPEC]))
    rows = {r["name"]: r for r in people.collect()}
    cse, eee = "Computer Science and Engineering", "Electrical Engineering"
    assert {n: r["department"] for n, r in rows.items()} == {"Dr. Anna Karlow": cse, "Bela Mirstone": cse, "Carl Dunwick": cse, "Dora Elmsworth": cse, "Ines Ferra": cse, "Edgar Finchley": eee, "Flora Gantry": eee, "Thale Morgen": cse}
    assert rows["Bela Mirstone"]["designation"] == "Assistant Professor" and rows["Carl Dunwick"]["photo_url"].endswith("/uploads/people/dunwick.jpg")
    assert rows["Edgar Finchley"]["phone"] == "02-555 1234" and rows["Flora Gantry"]["photo_url"] == ""
    assert rows["Thale Morgen"]["designation"] == "Associate Professor" and rows["Thale Morgen"]["source_page"].endswith("/faculty-view/thale-morgen")
    assert [tuple(r) for r in log.select("list_pages", "people", "with_photo").collect()] == [(3, 8, 7)]


PAGE_TABLE = "page_id long, url string, requested_url string, html string, status int, rendered boolean"


def test_copies_of_a_page_are_read_once(spark):
    """Other schemes, www. and last slashes are one page; of copies a rendered one is read."""
    lists = X._page("Faculty Members", "<div>" + X._card("karlow", "Dr. Anna Karlow", "Professor") + X._card("elm", "Dora Elmsworth", "Lecturer") + X._card("ferra", "Ines Ferra", "Lecturer") + "</div>")
    other = lists.replace("Ines Ferra", "Nobody Known")
    at = f"{X.ROOT}/department-of-physics/faculty-members"
    rows = [(1, at, at, other, 200, False), (2, at + "/", at + "/", lists, 200, True), (3, at.replace("https://www.", "http://"), at.replace("https://www.", "http://"), other, 200, False)]
    pages = spark.createDataFrame(rows, PAGE_TABLE)
    tables = S.site_tables(spark, [X.SPEC])
    read = C.crawl(pages, H.parse_pages(pages), tables["site"], tables["seed"].filter("kind = 'listing'"))
    assert [(r["page_id"], r["is_listing"]) for r in read.collect()] == [(2, True)]
    assert [r["page_id"] for r in C.pages_by_key(pages.drop("rendered")).collect()] == [1]


def test_seeds_are_read_in_their_order(spark):
    """Two lists name one person: the department is that of the list which comes first."""
    spec = S.SiteSpec("m", "M", "M", X.ROOT, ["mock.edu"], seeds=[f"{X.ROOT}/department-of-zoology/faculty-members", f"{X.ROOT}/department-of-botany/faculty-members"])
    html = X._page("Faculty Members", "<div>" + X._card("karlow", "Dr. Anna Karlow", "Professor") + "</div>")
    pages = spark.createDataFrame([(k, u, u, html, 200, False) for k, u in enumerate(sorted(spec.seeds))], PAGE_TABLE)
    tables = S.site_tables(spark, [spec])
    read = C.crawl(pages, H.parse_pages(pages), tables["site"], tables["seed"])
    assert [r["department"] for r in read.orderBy("at").collect()] == ["Zoology", "Botany"]


def test_profile_patterns_hold_for_their_own_site(spark):
    """The same address is a person's page on one site and none on the other."""
    link = '<a href="/department/member_details/7">More</a><div>' + X._card("karlow", "Dr. Anna Karlow", "Professor") + "</div>"
    specs = [S.SiteSpec(k, k, k, f"https://{k}.edu", [f"{k}.edu"], seeds=[f"https://{k}.edu/department-of-law/faculty-members"], profile=p) for k, p in (("one", [r"/member_details/\d+"]), ("two", [r"/never/\d+"]))]
    pages = spark.createDataFrame([(k, s.seeds[0], s.seeds[0], X._page("Faculty", link), 200, False) for k, s in enumerate(specs)], PAGE_TABLE)
    tables, nodes = S.site_tables(spark, specs), H.parse_pages(pages)
    read = C.crawl(pages, nodes, tables["site"], tables["seed"])
    none = spark.createDataFrame([], "site string, profile_url string")
    assert [(r["site"], r["url"]) for r in PP.orphan_links(read, pages, nodes, tables["site"], none).filter("url like '%member_details%'").collect()] == [("one", "https://one.edu/department/member_details/7")]


def test_the_sites_own_picture_is_no_portrait(spark):
    """A picture that the first page gives as its own is passed over on people's pages."""
    home = '<html><head><meta name="twitter:image" content="/uploads/people/elmsworth.jpg"></head><body><a href="/department-of-law/faculty-members">Faculty</a></body></html>'
    own = X._profile("Dora Elmsworth", "Lecturer", "/uploads/people/elmsworth.jpg", '<img src="/uploads/people/dora.jpg">')
    at = [f"{X.ROOT}/", f"{X.ROOT}/faculty-view/elm", f"{X.ROOT}/later"]
    pages = spark.createDataFrame([(k, u, u, h, 200, False) for k, (u, h) in enumerate(zip(at, (home, own, home.replace("elmsworth", "other")), strict=True))], PAGE_TABLE)
    nodes = H.parse_pages(pages)
    read = spark.createDataFrame([("m", 2, 9), ("m", 0, 3), ("m", 1, 1)], "site string, page_id long, at long")
    ignored = PP.ignored_pictures(read, C.page_facts(pages, nodes))
    assert [tuple(r) for r in ignored.collect()] == [("m", [f"{X.ROOT}/uploads/people/elmsworth.jpg"])]
    for known, photo in ((ignored.select("ignored"), "dora.jpg"), (None, "elmsworth.jpg")):
        expected = spark.createDataFrame([(1, "Dora Elmsworth")], "page_id long, expected_name string")
        expected = expected.crossJoin(known) if known is not None else expected
        assert E.extract_profiles(nodes, pages, expected).filter("page_id = 1").first()["photo_url"].endswith("/" + photo)


def test_outputs_that_fail_and_folders_that_refuse(spark, tmp_path):
    from dirloom import sinks

    (tmp_path / "raw.csv").write_text("a file where a folder should be")
    (tmp_path / "file").write_text("x")
    rows = spark.createDataFrame([("U", "A"), ("V", "B")], "university string, name string")
    from dirloom.operators.relational import finished

    written = sinks.write_sites(finished(rows), str(tmp_path / "file" / "no"), ("csv", "odd"))
    assert written == [] and sinks.write_sites(finished(rows), str(tmp_path / "ok"), ("json",)) == [str(tmp_path / "ok" / f"{n}.json") for n in ("raw", "merged")]
    assert sinks.usable_folder(str(tmp_path / "file" / "no"), str(tmp_path / "spare")) == str(tmp_path / "spare") and (tmp_path / "spare").is_dir()
    assert sinks.usable_folder(str(tmp_path / "new"), "x") == str(tmp_path / "new") and not any((tmp_path / "new").iterdir())


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    from dirloom import __main__ as cli

    assert cli.main(["--list"]) == 0 and len(capsys.readouterr().out.splitlines()) == 9
    assert cli.main(["--site", "nowhere", "--pages", "x"]) == 2
    monkeypatch.setattr(cli, "SITES", [X.SPEC])
    X.pages(spark).write.parquet(str(tmp_path / "pages"))
    assert cli.main(["--site", "MOCK", "--pages", str(tmp_path / "pages"), "--output", str(tmp_path / "out"), "--format", "all", "--profiles", "never"]) == 0
    assert [x.split() for x in capsys.readouterr().out.splitlines()[-2:]] == [["MOCK", "7", "4", "0"], ["TOTAL", "7", "4", "0"]]
    assert {p.name for p in (tmp_path / "out").iterdir()} == {f"{n}.{f}" for n in ("raw", "merged") for f in ("csv", "json", "parquet")} | {"merged.xlsx"}
    out = spark.read.parquet(str(tmp_path / "out" / "merged.parquet"))
    assert out.count() == 7 and out.filter("photo_file <> '' or photo_status <> ''").count() == 0  # nothing was fetched


@pytest.mark.parametrize(("most", "n"), [(700, 700), (None, 710)])
def test_own_pages_may_be_read_without_limit(spark, most, n):
    text = F.lit("")
    people = spark.range(710).select(F.lit("m").alias("site"), F.col("id").alias("seq"), F.format_string("https://m.edu/people/%d", "id").alias("profile_url"), text.alias("photo_url"), F.lit("Anna").alias("name"), F.lit("Law").alias("department"))
    orphans = people.select("site", F.col("profile_url").alias("url"), text.alias("key"), text.alias("text"), "department", F.struct(F.col("seq").alias("at"), F.lit(0).alias("pos")).alias("o")).limit(0)
    assert PP.profile_jobs(people, orphans, C.CrawlSettings(max_profiles=most)).count() == n
