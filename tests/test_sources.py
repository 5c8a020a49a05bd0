"""Adapters, robots rules and streaming."""

from pyspark.sql import functions as F

from dirloom import sources as S
from dirloom.streaming import new_pages, request_rates


def test_adapters(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿name,position,department_folder,profile_url,image_url\nLea Morr,Lecturer,Computer_Science,/x,http://m.edu/l.jpg\n,x,y,z,w\n".encode())
    people = S.adapt_external(S.read_csv(spark, str(tmp_path / "a.csv")), "M", "Mock", "http://m.edu").collect()
    assert [(p["name"], p["department"], p["profile_url"], p["photo_status"], p["phone"]) for p in people] == [("Lea Morr", "Computer Science", "", "download failed", "")]


def test_json_sources(spark):
    nested = spark.createDataFrame([('{"EmployeeProfileLightList":[{"CvPersonal":{"Name":"Nia Orr","Email":"n@m.edu"},"Designation":"Lecturer"}]}',), ("broken",)], "body string")
    assert [(r["name"], r["department"]) for r in S.from_nested_json(nested).collect()] == [("Nia Orr", "Unknown Department")]
    flat = spark.createDataFrame([(1, '{"faculties":[{"name":"Pia","image":"x.jpg"},{"name":"Quin","image":"http://m.edu/q.jpg"}],"pagination":{"facultyTotal":2}}')], "page int, body string")
    assert [(r["name"], r["image_url"]) for r in S.from_flat_json(flat).collect()] == [("Pia", ""), ("Quin", "http://m.edu/q.jpg")]


def test_robots(spark):
    urls = spark.createDataFrame([("http://m.edu/a",), ("http://m.edu/private/x",), ("http://n.edu/private/x",)], "url string")
    robots = spark.createDataFrame([("http://m.edu", "User-agent: *\nDisallow: /private/")], "origin string, body string")
    assert {r["url"]: r["allowed"] for r in S.robots_allowed(urls, robots).collect()} == {"http://m.edu/a": True, "http://m.edu/private/x": False, "http://n.edu/private/x": True}


def test_usable_pages(spark):
    rows = [(1, "u", "u", "static", 200, False), (2, "u", "u", "rendered", 200, True), (3, "v", "v", "gone", 404, False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, requested_url string, html string, status int, rendered boolean")
    assert [r["html"] for r in S.usable_pages(pages).collect()] == ["rendered"]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:05"), ("a", "2024-01-01 00:00:50"), ("b", "2024-01-01 00:02:00")], "url string, t string").select("url", F.col("t").cast("timestamp").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df, mode, want in (("first", new_pages(stream), "append", 2), ("rates", request_rates(stream.withColumnRenamed("url", "site")), "complete", 2)):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(name).count() == want
