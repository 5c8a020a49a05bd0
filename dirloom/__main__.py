"""Command line: the people of registered sites, from a table of saved pages.

    python -m dirloom --pages pages.parquet --site ewu --site seu --output out --format csv
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import patterns as P
from .operators.crawl import CrawlSettings
from .operators.people import directory
from .operators.photo_store import save_photos
from .operators.relational import ordered
from .sinks import run_summary, usable_folder, write_sites
from .sites import SITES
from .sources import select_sites, site_tables, usable_pages

FORMATS = {"all": ("csv", "json", "parquet", "xlsx")}
SPARE = "output"


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="dirloom", description=__doc__.split("\n")[0])
    which = p.add_mutually_exclusive_group(required=True)
    which.add_argument("--all", action="store_true", help="all registered sites")
    which.add_argument("--site", action="append", metavar="KEY", help="a site, whatever the capitals of its key; may be repeated")
    which.add_argument("--list", action="store_true", help="list the sites and stop")
    p.add_argument("--pages", help="Parquet table of pages: page_id, url, requested_url, html, status, rendered")
    p.add_argument("--output", default="output")
    p.add_argument("--format", default="csv", choices=["csv", "json", "parquet", "xlsx", "all"])
    p.add_argument("--depth", type=int, default=CrawlSettings.depth)
    p.add_argument("--max-pages", type=int, default=CrawlSettings.max_pages)
    p.add_argument("--profiles", default=CrawlSettings.visit_profiles, choices=["auto", "always", "never"])
    p.add_argument("--deep", action="store_true", help="also try numbered profile pages")
    p.add_argument("--include-staff", action="store_true")
    p.add_argument("--images", help="Parquet table of fetched pictures: url, content; saves them below the output folder")
    p.add_argument("--no-images", action="store_true", help="save no pictures")
    p.add_argument("--verbose", action="store_true")
    a = p.parse_args(argv)
    if not a.list and not a.pages:
        p.error("--pages is needed")
    return a


def main(argv: list[str] | None = None) -> int:
    a = arguments(argv)
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO, format="%(message)s")
    log = logging.getLogger("dirloom")
    if a.list:
        for s in SITES:
            print(f"{s.key:8} {s.name}")
        return 0
    try:
        specs = SITES if a.all else select_sites(SITES, a.site)
    except ValueError as e:
        log.error("%s", e)
        return 2
    output = a.output if "://" in a.output else usable_folder(a.output, SPARE)
    spark = SparkSession.builder.appName("dirloom").getOrCreate()
    pages = usable_pages(spark.read.parquet(a.pages))
    settings = CrawlSettings(depth=a.depth, max_pages=a.max_pages, visit_profiles=a.profiles, include_staff=a.include_staff)
    templates = [(s.key, *s.profile_ids) for s in specs if s.profile_ids] if a.deep else None
    people, runs = directory(pages, site_tables(spark, specs), settings, templates)
    if a.images and not a.no_images:
        people = save_photos(people, spark.read.parquet(a.images), output)
    elif a.no_images:
        people = people.withColumn("photo_status", F.lit(P.SKIPPED))
    for r in runs.orderBy("site").collect():  # a row a site
        log.info("%s: %d people (%d with a photo) from %d list pages, %d pages read", r["site"], r["people"], r["with_photo"], r["list_pages"], r["pages_read"])
    for path in write_sites(ordered(people), output, FORMATS.get(a.format, (a.format,))):
        log.info("written: %s", path)
    print(f"{'University':<12}{'People':>9}{'With photo URL':>16}{'Photos saved':>14}")
    for r in run_summary(people).collect():  # a row a site
        print(f"{r['university']:<12}{r['people']:>9}{r['with_photo']:>16}{r['saved']:>14}")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
