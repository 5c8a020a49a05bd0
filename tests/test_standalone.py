"""Stand-alone list pages, their photo states, and photos of a site."""

from pyspark.sql import functions as F

from dirloom import sources as S
from dirloom.operators import html as H
from dirloom.operators import photos as PH
from dirloom.operators import standalone as A

HOME = "<body>Faculty of Science <ul><li><a href='/teachers/cse'>Department of CSE</a><li><a href='/teachers/eee'>EEE</a></ul><p>Faculty of Arts</p><a href='/teachers/law'>Law</a><a href='/teachers/law'>Law again</a></body>"
LIST = (
    "<body><ul><li><img src='/images/dean.jpg' alt='Prof. Dean One'></ul><h2>Department of CSE</h2><ul>"
    "<li><img src='/images/a.jpg'><a href='/profile/a'>Anna Karlow</a><h4>Lecturer</h4><li><img data-src='/images/b.jpg'><h3>Bela Orr</h3><li><img src='/dist/images/logo.png'></ul>"
    "<a href='?page=2'>Next</a><a href='/adjunct'>Adjunct Faculty</a></body>"
)
TABLES = (
    "<body><h3>Faculty Member List: Department of CSE</h3><table><tr><th>SL</th><th>Name</th></tr><tr><td>1</td><td><a href='/p/1'>Anna Karlow</a></td><td>Lecturer</td><td>12</td><td>a@m.edu</td></tr></table>"
    "<h3>Faculty Member List: EEE</h3><table><tr><td>1</td><td>Bela Orr</td></tr></table></body>"
)
CARDS = (
    "<body><div class='grid'><div><div><a href='/staff/cse/anna'><img data-src='/i/a.jpg' src='data:x' alt='Anna'></a></div><a href='/staff/cse/anna'>Anna Karlow</a></div>"
    "<div><a href='/staff/cse/bela'>Bela Orr</a></div></div><a href='/staff/cse?page=3'>3</a><a href='/staff/eee/carl'>Carl</a></body>"
)
CELLS = "<body><table><tr><td>Photo</td><td>Name</td></tr><tr><td><img src='/i/a.jpg'></td><td><b>Anna Karlow</b><a href='/p/a'>Profile</a></td></tr><tr><td></td><td><strong>Bela Orr</strong></td></tr></table></body>"
PROFILE = "<body><img src='/wp-content/uploads/logo.png'><img src='/wp-content/uploads/x.jpg' alt='campus'><img src='/wp-content/uploads/anna.jpg' alt='Anna'></body>"


def test_list_pages(spark):
    pages = spark.createDataFrame([(k, "https://m.edu/list", h) for k, h in enumerate([HOME, LIST, TABLES, CARDS, CELLS, PROFILE])], "page_id long, url string, html string")
    nodes = H.parse_pages(pages).cache()

    def rows(df, page, *columns):
        return [tuple(r) for r in df.filter(F.col("page_id") == page).orderBy("page_id", *(["pos"] if "pos" in df.columns else [])).select(*columns).collect()]

    assert rows(A.departments_of_home(nodes), 0, "faculty", "department", "url") == [("Faculty of Science", "Department of CSE", "https://m.edu/teachers/cse"), ("Faculty of Science", "EEE", "https://m.edu/teachers/eee"), ("Faculty of Arts", "Law", "https://m.edu/teachers/law")]
    assert rows(A.photo_list(nodes), 1, "name", "designation", "profile_url", "is_dean") == [("Prof. Dean One", "", "", True), ("Anna Karlow", "Lecturer", "https://m.edu/profile/a", False), ("Bela Orr", "", "", False)]
    assert rows(A.linked_page(nodes, "Next"), 1, "url") == [("https://m.edu/list?page=2",)] and rows(A.linked_page(nodes, "(?i)Adjunct Faculty"), 1, "url") == [("https://m.edu/adjunct",)]
    assert rows(A.headed_tables(nodes), 2, "department", "name", "profile_url", "designation", "email") == [("Department of CSE", "Anna Karlow", "https://m.edu/p/1", "Lecturer", "a@m.edu"), ("EEE", "Bela Orr", "", "", "")]
    assert rows(A.linked_cards(nodes, "/staff/cse"), 3, "name", "profile_url", "img_src") == [("Anna Karlow", "https://m.edu/staff/cse/anna", "/i/a.jpg"), ("Bela Orr", "https://m.edu/staff/cse/bela", "")]
    assert rows(A.last_page(nodes, "/staff/cse"), 3, "last") == [(3,)]
    assert rows(A.celled_people(nodes), 4, "name", "profile_url", "img_src") == [("Anna Karlow", "https://m.edu/p/a", "/i/a.jpg"), ("Bela Orr", "ece:Bela Orr", "")]
    assert rows(A.portrait(nodes, spark.createDataFrame([(5, "Anna Karlow")], "page_id long, name string")), 5, "image_url") == [("https://m.edu/wp-content/uploads/anna.jpg",)]


def test_list_ends_and_states(spark):
    seen = [("l", 1, 0, "a"), ("l", 1, 1, "b"), ("l", 2, 0, "b"), ("l", 3, 0, "c"), ("m", 1, 0, "x"), ("m", 2, 0, "y")]
    people = spark.createDataFrame(seen, "list string, page int, pos int, profile_url string")
    assert sorted(r["profile_url"] for r in A.new_until_none(people, "list", "page", "pos").collect()) == ["a", "b", "x", "y"]
    t = spark.createDataFrame([("Ana: Lía/Orr  ", "https://m.edu//a/newassets/images/newassets/images/x.JPG?v=1", "image/png; q=1")], "n string, u string, c string")
    r = t.select(
        A.plain_filename(F.col("n")), A.plain_filename(F.col("n"), True), A.tidy_variants(F.col("u"))[1], A.file_extension(F.col("u")), A.file_extension(F.lit("https://m.edu/x"), F.lit("image/gif")),
        A.served_as_image(F.col("u"), F.col("c")), A.list_photo_status(F.lit("x"), F.lit("https://m.edu/default-faculty.png"), F.lit(False), F.lit("downloaded")), A.profile_photo_status(F.lit("p"), F.lit(True), F.lit("/a/no-image.png"), F.lit(True)),
    ).first()
    assert tuple(r) == ("Ana LíaOrr", "Ana_LíaOrr".replace("í", "í"), "https://m.edu/a/newassets/images/x.JPG?v=1", ".jpg", ".gif", True, "placeholder_skipped", "placeholder_downloaded")
    totals = A.status_totals(spark.createDataFrame([("cse", "downloaded"), ("cse", "failed: x"), ("eee", "no_image")], "dept string, status string"), "dept")
    assert {r["dept"]: (r["found"], r["downloaded"], r["failed"], r["no_image"]) for r in totals.collect()} == {"cse": (2, 1, 1, 0), "eee": (1, 0, 0, 1), "TOTAL": (3, 1, 1, 1)}
    stems = A.unique_stems(spark.createDataFrame([("f", "A", 1), ("f", "a", 2), ("g", "a", 3)], "f string, s string, k int"), "f", "s", "k")
    assert [r["path_stem"] for r in stems.orderBy("k").collect()] == ["A", "a_2", "a"]


def test_photos_of_a_site(spark):
    rows = [("s", k, "U", "Law", n, "", u) for k, (n, u) in enumerate([("Ann Orr", "u1"), ("ann orr", "u2"), ("Ann Orr (2)", "u3"), ("Bo Lee", "u4"), ("Cy Poe", "u5"), ("Di Roe", "u4"), ("Ann Orr", "u1"), ("Ed Moe", "")])]
    people = spark.createDataFrame(rows, "site string, seq long, university string, department string, name string, profile_url string, photo_url string")
    placed = PH.target_paths(people)
    assert [r["target"] for r in placed.orderBy("seq").collect()] == [f"photos/U/Law/{n}" for n in ("Ann Orr", "ann orr (3)", "Ann Orr (2)", "Bo Lee", "Cy Poe", "Di Roe", "Ann Orr", "Ed Moe")]
    jpg = bytes.fromhex("FFD8FFC0001108006400640311") + bytes(2000)
    contents = spark.createDataFrame([("u1", jpg), ("u2", bytes(9)), ("u4", jpg + b"x"), ("u5", jpg + b"x")], "url string, content binary")
    variants = people.filter("photo_url <> ''").select(F.col("photo_url").alias("url")).distinct().select("url", F.lit(0).alias("k"), F.col("url").alias("variant"))
    results = PH.fetched_photos(variants, contents)
    out = {r["seq"]: (r["photo_status"], r["photo_file"]) for r in PH.photo_results(placed, results).collect()}
    assert out[0] == out[6] == ("downloaded", "photos/U/Law/Ann Orr.jpg") and out[1][0] == "not a valid image" and out[2][0] == "download failed" and out[7] == ("no photo found", "")
    assert out[3] == out[4] == out[5] == ("placeholder (no real photo)", "")
    manifest = PH.manifest_of(PH.photo_results(placed, results), spark.createDataFrame([("old", "f", "s")], "url string, file string, sha1 string"))
    assert {r["url"] for r in manifest.collect()} == {"u1", "old"}
    kept = PH.from_manifest(placed.select(F.col("photo_url").alias("url"), "target", "seq"), manifest, spark.createDataFrame([("photos/U/Law/Ann Orr.jpg",)], "file string"))
    assert [(r["url"], r["result"]) for r in kept.collect()] == [("u1", "already downloaded")]


def test_sources_decode_and_fall_back(spark):
    t = spark.createDataFrame([(bytearray("é".encode("latin-1")), "text/html; charset=ISO-8859-1"), (bytearray(b"<meta charset='latin-1'>\xe9"), ""), (bytearray("é".encode()), "text/html; charset=nope")], "c binary, h string")
    assert [r[0][-1] for r in t.select(S.decode_html(F.col("c"), F.col("h"))).collect()] == ["é", "é", "é"]
    robots = spark.createDataFrame([("a", "User-agent: *\nCrawl-delay: 40"), ("b", "<html>"), ("c", None)], "origin string, body string")
    assert {r["origin"]: r["delay"] for r in S.crawl_delays(robots).collect()} == {"a": 15.0, "b": 0.0, "c": 0.0}
    flat = spark.createDataFrame([(k, b) for k, b in [(1, '{"faculties":[{"name":"P"}],"pagination":{"facultyTotal":2}}'), (2, '{"faculties":[{"name":"Q"}]}'), (3, '{"faculties":[{"name":"R"}]}'), (5, "x")]], "page int, body string")
    assert [r["name"] for r in S.from_flat_json(flat).orderBy("page").collect()] == ["P", "Q"]
    people = spark.createDataFrame([("x", "u7", "a@m.edu"), ("", "u8", "")], "image_url string, user_id string, email string")
    got = S.with_fallback_addresses(people, "https://m.edu", "https://m.edu/pics/{user_id}.jpg", "https://m.edu/p?q={email}").orderBy("user_id").collect()
    assert [(r["image_url"], r["profile_url"]) for r in got] == [("https://m.edu/x", "https://m.edu/p?q=a@m.edu"), ("https://m.edu/pics/u8.jpg", "")]
