"""Workbooks, manifests in one JSON object, chains of pages."""

import random
import zipfile
from xml.etree import ElementTree

import pytest

from dirloom import workbook as W
from dirloom.operators.chains import chain_pages
from dirloom.sources.manifest import scan_manifest

NS = {"m": W._MAIN}


def sheets(path):
    """Each sheet's rows of (cell, text), and its xml."""
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        names = sorted(n for n in z.namelist() if n.startswith("xl/worksheets/"))
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        return [([[(c.get("r"), "".join(c.itertext())) for c in r] for r in ElementTree.fromstring(z.read(n)).iterfind(".//m:row", NS)], z.read(n).decode()) for n in names]


def test_workbook(spark, tmp_path):
    rows = [(k, f"<Name> & {k}", None if k % 2 else "x\x0by", k / 4) for k in range(20)]
    df = spark.createDataFrame(rows, "k int, name string, note string, share double").repartition(5)
    at = str(tmp_path / "out" / "people.xlsx")
    W.write_workbook(df, at, ["k"])
    W.write_workbook(df, at, ["k"])  # again, over the first
    ((cells, xml),) = sheets(at)
    assert len(cells) == 21 and [v for _, v in cells[0]] == ["k", "name", "note", "share"]
    assert cells[1] == [("A2", "0"), ("B2", "<Name> & 0"), ("C2", "xy"), ("D2", "0.0")] and cells[2] == [("A3", "1"), ("B3", "<Name> & 1"), ("D3", "0.25")]
    assert 'state="frozen"' in xml and '<col min="2" max="2" width="13" customWidth="1"/>' in xml
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["people.xlsx"]
    W.write_workbook(df.limit(0), at)
    assert len(sheets(at)[0][0]) == 1


def test_long_tables_go_on_in_further_sheets(tmp_path):
    book = W.Workbook(str(tmp_path / "b.xlsx"), "A sheet", ["a"], [10], most=4)
    for k in range(7):
        book.add([k])
    book.close()
    got = sheets(str(tmp_path / "b.xlsx"))
    assert [len(r) for r, _ in got] == [4, 4, 2] and book.sheets == ["A sheet", "A sheet 2", "A sheet 3"]
    assert [W.column_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_failed_workbooks_leave_the_old_file(spark, tmp_path):
    at = tmp_path / "p.xlsx"
    at.write_bytes(b"old")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        W.write_workbook(spark.range(3).selectExpr("id", "if(id = 1, cast(1 / (id - 1) as string), 'x') as v"), str(at))
    assert at.read_bytes() == b"old"


def test_manifest_scan(spark, tmp_path):
    assert scan_manifest(spark, str(tmp_path / "none.json")).collect() == []
    for name, text in {"a": '{"u1": {"file": "p/a.jpg", "sha1": "s"}, "u.2": {"file": "p/b é.png"}, "u3": {"file": ""}, "u4": "x", "u5": {"sha1": "t"}}', "b": "{broken", "c": "[1, 2]", "d": ""}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    want = {("u1", "p/a.jpg", "s"), ("u.2", "p/b é.png", "")}
    assert {tuple(r) for r in scan_manifest(spark, str(tmp_path / "a.json")).collect()} == want
    assert {tuple(r) for r in scan_manifest(spark, str(tmp_path / "*.json")).collect()} == want
    assert all(scan_manifest(spark, str(tmp_path / f"{n}.json")).count() == 0 for n in "bcd")


@pytest.mark.parametrize("most", [None, 1, 6])
def test_chains_equal_walking(spark, most):
    rng = random.Random(7)
    step = {k: rng.choice([None, k, k + 1, k + 1, k + 1, k + 1, rng.randrange(90)]) for k in range(80)}
    starts = [(i, rng.randrange(80)) for i in range(12)] + [(99, 500)]
    want = set()
    for key, at in starts:
        seen = []
        while at in step and at not in seen and (most is None or len(seen) < most):
            seen.append(at)
            at = step[at]
        want |= {(key, p, k) for k, p in enumerate(seen)}
    links = spark.createDataFrame(list(step.items()), "page long, next long")
    got = chain_pages(links, spark.createDataFrame(starts, "list long, start long"), "list", most)
    assert {tuple(r) for r in got.collect()} == want
