"""Photos from people to files and manifest, over two runs; sizes of pictures."""

import struct

import pytest
from pyspark.sql import functions as F

from dirloom.functions.images import image_size, jpeg_size, tiff_size
from dirloom.operators import photo_store as PS
from dirloom.operators import relational as R

PEOPLE = "site string, seq long, university string, department string, name string, profile_url string, photo_url string"


def jpg(w=100, h=100, more=b"", pad=2000):
    return b"\xff\xd8\xff\xe0\x00\x04ab" + b"\xff\xc0\x00\x11\x08" + struct.pack(">HH", h, w) + b"\x03\x11" + more + bytes(pad)


def png(w=100, h=100):
    return b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", w, h) + bytes(2000)


def files(base):
    return {str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and "photos/" in str(p)}


def test_two_runs_fetch_only_what_is_missing(spark, tmp_path):
    at = "https://m.edu/u/"
    rows = [("Ann Orr", "a-150x150.jpg"), ("Bo Lee", "b.jpg"), ("Cy Poe", "c.jpg"), ("Di Roe", "d.jpg"), ("Ed Moe", "d.jpg"), ("Flo Ray", "d2.jpg"), ("Gus Tay", ""), ("Hal Fox", "h.jpg"), ("Ann Orr", "a-150x150.jpg")]
    people = spark.createDataFrame([("s", k, "U", "Law", n, "", at + u if u else "") for k, (n, u) in enumerate(rows)], PEOPLE)
    first = spark.createDataFrame([(at + "a.jpg", jpg()), (at + "a-150x150.jpg", jpg(70, 70)), (at + "b.jpg", jpg(59, 90)), (at + "d.jpg", jpg(more=b"x")), (at + "d2.jpg", jpg(more=b"x")), (at + "h.jpg", b"<html>" + bytes(2000))], "url string, content binary")
    assert {r["variant"] for r in PS.to_fetch(people, str(tmp_path)).collect()} == {at + u for u in ("a.jpg", "a-150x150.jpg", "b.jpg", "c.jpg", "d.jpg", "d2.jpg", "h.jpg")}
    out = {r["seq"]: (r["photo_status"], r["photo_file"]) for r in PS.save_photos(people, first, str(tmp_path)).collect()}
    none = "placeholder (no real photo)"
    assert out == {0: ("downloaded", "photos/U/Law/Ann Orr.jpg"), 1: ("image too small", ""), 2: ("download failed", ""), 3: (none, ""), 4: (none, ""), 5: (none, ""), 6: ("no photo found", ""), 7: ("not a valid image", ""), 8: ("downloaded", "photos/U/Law/Ann Orr.jpg")}
    assert files(tmp_path) == {"photos/U/Law/Ann Orr.jpg"} and (tmp_path / "photos/U/Law/Ann Orr.jpg").read_bytes() == jpg()

    # again: the saved photo isn't asked for; another ending replaces an old file
    (tmp_path / "photos/U/Law/Bo Lee.gif").write_bytes(b"old")
    (tmp_path / "photos/U/Law/Di Roe.png").write_bytes(b"old")
    assert {r["variant"] for r in PS.to_fetch(people, str(tmp_path)).collect()} == {at + u for u in ("b.jpg", "c.jpg", "d.jpg", "d2.jpg", "h.jpg")}
    second = spark.createDataFrame([(at + "b.jpg", png()), (at + "d.jpg", jpg(more=b"x")), (at + "d2.jpg", jpg(more=b"x"))], "url string, content binary")
    out = {r["seq"]: (r["photo_status"], r["photo_file"]) for r in PS.save_photos(people, second, str(tmp_path)).collect()}
    assert out[0] == ("already downloaded", "photos/U/Law/Ann Orr.jpg") and out[1] == ("downloaded", "photos/U/Law/Bo Lee.png") and out[3][0] == none
    assert files(tmp_path) == {"photos/U/Law/Ann Orr.jpg", "photos/U/Law/Bo Lee.png"}
    assert {r["file"] for r in PS.read_manifest(spark, str(tmp_path)).collect()} == files(tmp_path)

    # a file that went missing is asked for again, and a further owner gets a copy of a saved one
    (tmp_path / "photos/U/Law/Bo Lee.png").unlink()
    more = people.unionByName(spark.createDataFrame([("s", 20, "U", "Art", "Zoe Kay", "", at + "a-150x150.jpg")], PEOPLE))
    assert at + "b.jpg" in {r["variant"] for r in PS.to_fetch(more, str(tmp_path)).collect()}
    PS.save_photos(more, second, str(tmp_path))
    assert (tmp_path / "photos/U/Art/Zoe Kay.jpg").read_bytes() == jpg() and "photos/U/Law/Bo Lee.png" in files(tmp_path)


def test_broken_manifests_count_as_empty(spark, tmp_path):
    assert PS.read_manifest(spark, str(tmp_path)).count() == 0
    (tmp_path / PS.POINTER).write_text("manifest-gone")
    assert PS.read_manifest(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize(("side", "result"), [(59, "image too small"), (60, "downloaded"), (61, "downloaded")])
def test_least_side(spark, side, result):
    rows = spark.createDataFrame([(jpg(side, 200),), (png(200, side),), (b"GIF89a" + struct.pack("<HH", side, 99) + bytes(2000),)], "c binary")
    assert [r[0] for r in rows.select(R.image_result(F.col("c"))).collect()] == [result] * 3


def test_sizes_of_odd_headers(spark):
    lossy = b"RIFF0000WEBPVP8 0000000\x9d\x01*" + struct.pack("<HH", 70 + (1 << 14), 80)
    lossless = b"RIFF0000WEBPVP8L0000/" + struct.pack("<I", 69 + (79 << 14)) + bytes(5)
    bmp = b"BM" + bytes(12) + struct.pack("<Iii", 40, 70, -80)
    old = b"BM" + bytes(12) + struct.pack("<IHH", 12, 70, 80) + bytes(4)
    tif = b"MM\x00*" + struct.pack(">IH", 8, 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 80)
    rows = spark.createDataFrame([(k, c) for k, c in enumerate([lossy, lossless, bmp, old, tif, jpg(70, 80, pad=0), png(70, 80)])], "k int, c binary")
    got = [tuple(r["s"]) for r in rows.select("k", image_size(F.col("c"), R.sniff_extension(F.col("c"))).alias("s")).orderBy("k").collect()]
    assert got == [(70, 80)] * 7
    assert jpeg_size(b"\xff\xd8\xff\xff\xd0\xff\xda\x00\x04ab\xff\xc2\x00\x11\x08\x00\x02\x00\x03\x03") == (3, 2) and jpeg_size(b"\xff\xd8") is None and tiff_size(b"II*\x00") is None
    short = rows.select(*(image_size(F.lit(c[:n]).cast("binary"), R.sniff_extension(F.lit(c[:n]).cast("binary"))).alias(f"s{n}_{k}") for k, c in enumerate([lossy, bmp, png()]) for n in (9, 12, 20))).first()
    assert all(v is None for v in short)
