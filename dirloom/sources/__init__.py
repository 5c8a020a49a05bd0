"""Sources: pages, external CSV and JSON dialects, robots rules, site rules.

Fetching over a network is a connector's work and isn't part of queries: pages
come as a table (page_id, url, html, ...), JSON payloads and CSV logs as files.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType

from .. import patterns as P
from ..functions import text as T
from ..functions import urls as U
from ..operators.relational import finished


PATTERN_KINDS = ("listing", "profile", "follow", "exclude")


@dataclass(frozen=True)
class SiteSpec:
    """A site as data: registering one is adding a row to the tables built from it."""

    key: str
    short_name: str
    name: str
    homepage: str
    domains: list[str]
    blocked: list[str] = field(default_factory=list)
    starts: list[str] = field(default_factory=list)
    seeds: list[str] = field(default_factory=list)
    fallback: list[str] = field(default_factory=list)
    listing: list[str] = field(default_factory=list)
    profile: list[str] = field(default_factory=list)
    follow: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    departments: dict[str, str] = field(default_factory=dict)
    #: Template of profile URLs with {id}, first id, id to stop before.
    profile_ids: tuple[str, int, int] | None = None

    def __post_init__(self):
        for kind in PATTERN_KINDS:
            for r in getattr(self, kind):
                re.compile(r)  # a site with a broken pattern isn't registered


def site_tables(spark: SparkSession, specs: list[SiteSpec]) -> dict[str, DataFrame]:
    """Dimension tables: site, pattern (key, kind, regex), department (key, slug, name), seed (key, url, kind, pos: its place in the site's list)."""
    kinds = PATTERN_KINDS
    fields = "key string, short_name string, name string, homepage string, domains array<string>, blocked array<string>, departments map<string, string>"
    patterns = ", ".join(f"{k} array<string>" for k in kinds)
    return {
        "site": spark.createDataFrame([(s.key, s.short_name, s.name, s.homepage, s.domains, s.blocked, s.departments, *(["(?i)" + r for r in getattr(s, k)] for k in kinds)) for s in specs], f"{fields}, {patterns}"),
        "pattern": spark.createDataFrame([(s.key, k, r) for s in specs for k in kinds for r in getattr(s, k)], "key string, kind string, regex string"),
        "department": spark.createDataFrame([(s.key, k, v) for s in specs for k, v in s.departments.items()], "key string, slug string, department string"),
        "seed": spark.createDataFrame([(s.key, u, k, n) for s in specs for k, us in (("listing", s.seeds), ("explore", s.starts), ("fallback", s.fallback)) for n, u in enumerate(us)], "key string, url string, kind string, pos int"),
    }


def select_sites(specs: list[SiteSpec], keys: list[str]) -> list[SiteSpec]:
    """The sites with these keys, whatever their capitals; an unknown key is an error."""
    known = {s.key.lower(): s for s in specs}
    unknown = [k for k in keys if k.lower() not in known]
    if unknown:
        raise ValueError(f"unknown sites: {', '.join(unknown)}; known: {', '.join(known)}")
    return [known[k.lower()] for k in keys]


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that were served, the rendered copy of each URL before the static one."""
    best = pages.filter((F.col("status") < 400) & F.col("html").isNotNull())
    return best.groupBy("requested_url").agg(F.max_by(F.struct(*pages.columns), F.struct("rendered", (-F.col("page_id")).alias("o"))).alias("p")).select("p.*")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; a byte order mark is no part of the first name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿") for c in df.columns))


def adapt_external(df: DataFrame, short_name: str, name: str, homepage: str) -> DataFrame:
    """Rows of any of the CSV dialects as people; missing columns count as empty."""

    def first(*names: str) -> Column:
        return T.first_filled(*(F.col(n) if n in df.columns else F.lit("") for n in names))

    def said(*names: str) -> Column:
        return T.clean_text(first(*names), True)

    dept = T.spaced_department(said("department", "department_folder"))
    saved, url, profile = first("image_path", "local_image_path", "saved_file"), first("image_url"), first("profile_url")
    status = first("status")
    people = df.select(
        F.lit(short_name).alias("university"),
        F.lit(name).alias("university_name"),
        T.first_filled(dept, F.lit("Other")).alias("department"),
        said("name").alias("name"),
        said("designation", "position").alias("designation"),
        said("email").alias("email"),
        said("research_interests").alias("research_interests"),
        F.when(profile.startswith("http"), profile).otherwise("").alias("profile_url"),
        url.alias("photo_url"),
        F.lit(homepage).alias("source_page"),
        saved.alias("photo_file"),
        F.when(status != "", status).when(saved != "", P.DOWNLOADED).when(url != "", P.FAILED).otherwise(P.NO_PHOTO).alias("photo_status"),
    )
    return finished(people.filter("name <> ''"))


#: Payload of one nested and one flat JSON source.
NESTED = "EmployeeProfileLightList array<struct<CvPersonal: struct<Name: string, Email: string, UserId: string>, PersonalOtherInfo: struct<SecondProfilePhoto: string>, Faculty: string, HrDepartment: string, Designation: string, Position: string>>"
FLAT = "faculties array<struct<name: string, department: string, position: string, email: string, slug: string, image: string>>, pagination struct<facultyTotal: int>"


def from_nested_json(payloads: DataFrame) -> DataFrame:
    """payloads: (body string).  One row a person."""
    rows = payloads.select(F.inline(F.from_json("body", NESTED)["EmployeeProfileLightList"]))
    return rows.select(
        T.first_filled(F.col("CvPersonal.Name"), F.lit("Unknown Name")).alias("name"),
        T.first_filled(F.col("HrDepartment"), F.lit("Unknown Department")).alias("department"),
        T.first_filled(F.col("Faculty"), F.lit("Unknown Faculty")).alias("faculty"),
        F.coalesce("Designation", F.lit("")).alias("designation"),
        F.coalesce("Position", F.lit("")).alias("position"),
        F.coalesce("CvPersonal.Email", F.lit("")).alias("email"),
        F.coalesce("CvPersonal.UserId", F.lit("")).alias("user_id"),
        F.coalesce("PersonalOtherInfo.SecondProfilePhoto", F.lit("")).alias("image_url"),
    )


def with_fallback_addresses(people: DataFrame, base: str, photos: str, profile: str) -> DataFrame:
    """Photo addresses made absolute, or from the user's id; profile addresses from
    the e-mail or slug.  ``photos`` and ``profile`` are templates with {user_id}, {email} or {slug}."""

    def filled(template: str) -> Column:
        out, used = F.lit(template), F.lit(True)
        for c in ("user_id", "email", "slug"):
            if "{" + c + "}" in template:
                value = F.coalesce(F.col(c), F.lit(""))
                out, used = F.replace(out, F.lit("{" + c + "}"), value), used & (value != "")
        return F.when(used, out).otherwise("")

    image = U.absolute_url(F.col("image_url"), F.lit(base + "/"))
    return people.withColumn("image_url", T.first_filled(image, filled(photos))).withColumn("profile_url", filled(profile))


def crawl_delays(robots: DataFrame, agent: str = "*", most: float = 15.0) -> DataFrame:
    """(origin, delay): the delay that each origin asks of the agent, ``most`` seconds at most; 0 if none."""

    def of(body: pd.Series) -> pd.Series:
        out = []
        for b in body:
            rules = RobotFileParser()
            rules.parse([] if b is None or b.lstrip().startswith("<") else b.splitlines())
            out.append(min(float(rules.crawl_delay(agent) or 0), most))
        return pd.Series(out)

    return robots.select("origin", F.pandas_udf(of, DoubleType(), F.PandasUDFType.SCALAR)(F.col("body")).alias("delay"))


def decode_html(content: Column, header: Column) -> Column:
    """The text of fetched bytes, in the charset of the header, else of a meta tag in the
    first 4096 bytes, else UTF-8; unknown charsets count as UTF-8, broken bytes are replaced."""

    def one(raw: bytes | None, kind: str | None) -> str | None:
        if raw is None:
            return None
        raw = bytes(raw)
        m = re.search(r"charset=[\s\"']*([\w.:-]+)", kind or "") or re.search(r"(?i)<meta[^>]+charset=[\s\"']*([\w.:-]+)", raw[:4096].decode("latin-1"))
        try:
            return raw.decode(m[1] if m else "utf-8", "replace")
        except LookupError:
            return raw.decode("utf-8", "replace")

    def all_(raw: pd.Series, kind: pd.Series) -> pd.Series:
        return pd.Series([one(r, k) for r, k in zip(raw, kind, strict=True)])

    return F.pandas_udf(all_, StringType(), F.PandasUDFType.SCALAR)(content, header)


def pages_of_files(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """Pages from saved files; index: (file, page_id, url, requested_url, status, content_type,
    rendered).  Only HTML, XML and plain text count as pages."""
    files = spark.read.format("binaryFile").load(path).select(F.substring_index("path", "/", -1).alias("file"), "content")
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    text = F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("xml")) | F.contains(kind, F.lit("text/plain")) | (kind == "")
    met = index.filter(text & (F.col("status") < 400)).join(files, "file")
    return met.select("page_id", "url", "requested_url", decode_html(F.col("content"), F.col("content_type")).alias("html"), "status", "rendered")


def from_flat_json(payloads: DataFrame) -> DataFrame:
    """payloads: (page int, body string, perhaps list: which list the page belongs to), the
    pages of each list from 1 on: up to its total, or before the first page that is missing,
    broken or empty."""
    keyed = payloads if "list" in payloads.columns else payloads.withColumn("list", F.lit(""))
    parsed = keyed.select("list", "page", F.from_json("body", FLAT).alias("p")).filter("size(p.faculties) > 0")
    pages = Window.partitionBy("list").orderBy("page")
    numbered = parsed.withColumn("k", F.row_number().over(pages)).filter("k = page")
    total = F.max("p.pagination.facultyTotal").over(pages.rowsBetween(Window.unboundedPreceding, 0))
    got = F.sum(F.size("p.faculties")).over(pages.rowsBetween(Window.unboundedPreceding, -1))
    wanted = numbered.withColumn("total", total).withColumn("got", F.coalesce(got, F.lit(0))).filter("total is null or got < total")
    rows = wanted.select("list", "page", F.posexplode("p.faculties").alias("pos", "f"))
    return rows.select(*(["list"] if "list" in payloads.columns else []), "page", "pos", *(F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c) for c in ("name", "department", "position", "email", "slug")), F.when(F.col("f.image").startswith("http"), F.col("f.image")).otherwise("").alias("image_url"))


def robots_allowed(urls: DataFrame, robots: DataFrame, agent: str = "*") -> DataFrame:
    """Adds ``allowed``; robots: (origin, body).  Origins without rules allow all."""

    def decide(url: pd.Series, body: pd.Series) -> pd.Series:
        parsers: dict[str, RobotFileParser] = {}
        out = []
        for u, b in zip(url, body, strict=True):
            if not b:
                out.append(True)
                continue
            if b not in parsers:
                parsers[b] = RobotFileParser()
                parsers[b].parse(b.splitlines())
            out.append(parsers[b].can_fetch(agent, u))
        return pd.Series(out)

    check = F.pandas_udf(decide, BooleanType(), F.PandasUDFType.SCALAR)
    origin = F.concat(U.scheme(F.col("url")), F.lit("://"), U.authority(F.col("url")))
    rules = robots.select("origin", F.when(F.col("body").rlike(r"(?i)^\s*<"), "").otherwise(F.col("body")).alias("_body"))
    return urls.withColumn("origin", origin).join(rules, "origin", "left").withColumn("allowed", check(F.col("url"), F.coalesce("_body", F.lit("")))).drop("_body", "origin")
