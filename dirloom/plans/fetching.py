"""Fetch rules over answers that are made from the tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls as U
from ..materialize import shared_base
from ..sources import fetch as X
from .queries import query, table

#: Every page's address is asked for in the order of page_id.  Of each host whose address has an
#: even length and each page whose number is no multiple of 5, nothing answers; other pages
#: give 404 (multiples of 7), a PDF (of 11), or their HTML.  Hosts refuse /fr/ and ask for 3 s.
_OUTCOME = "CASE WHEN page_id % 7 = 0 THEN 'http 404' WHEN page_id % 11 = 0 THEN 'not a page' ELSE 'fetched' END"


@query(
    f"""WITH p AS (SELECT page_id, url, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, array_to_string(string_split(lower(regexp_extract(url, '://([^/?#]*)', 1)), '.')[-2:], '.') AS site FROM pages),
a AS (SELECT *, url LIKE '%/fr/%' AS refused, length(host) % 2 = 0 AND page_id % 5 <> 0 AS lost FROM p),
o AS (SELECT *, row_number() OVER w AS k, sum(lost::INT) OVER (PARTITION BY host ORDER BY page_id ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS six FROM a WHERE NOT refused WINDOW w AS (PARTITION BY host ORDER BY page_id)),
d AS (SELECT host, min(page_id) AS died FROM o WHERE six = 6 AND k >= 6 GROUP BY 1),
r AS (SELECT a.*, CASE WHEN page_id > died THEN 'dead host' WHEN refused THEN 'refused by robots' WHEN lost THEN 'no connection' ELSE {_OUTCOME} END AS outcome FROM a LEFT JOIN d USING (host)),
t AS (SELECT *, CASE WHEN outcome IN ('dead host', 'refused by robots') THEN 0 WHEN lost THEN 2 ELSE 1 END AS turns FROM r)
SELECT page_id, outcome, CASE WHEN turns > 0 THEN 3.0 * (sum(turns) OVER (PARTITION BY site ORDER BY page_id) - 1) END AS slot FROM t"""
)
def fetch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules, slots, the other scheme, dead hosts and page types over saved answers."""
    pages = table(spark, sf_dir, "pages")
    u, k = F.col("url"), F.col("page_id")
    answers = pages.filter(~((F.length(U.authority(u)) % 2 == 0) & (k % 5 != 0))).select(
        "url",
        k.alias("seq"),
        F.lit(0).alias("failures"),
        F.when(k % 7 == 0, 404).otherwise(200).alias("status"),
        u.alias("final_url"),
        F.when(k % 11 == 0, "application/pdf").otherwise("text/html").alias("content_type"),
        F.col("html").cast("binary").alias("body"),
    )
    origins = pages.select(F.concat(U.scheme(u), F.lit("://"), U.authority(u)).alias("origin")).distinct()
    robots = origins.select(F.concat("origin", F.lit("/robots.txt")).alias("url"), F.lit(None).cast("long").alias("seq"), F.lit(0).alias("failures"), F.lit(200).alias("status"), F.lit("").alias("final_url"), F.lit("text/plain").alias("content_type"), F.lit("User-agent: *\nDisallow: /fr/\nCrawl-delay: 3").cast("binary").alias("body"))
    requests = pages.select("url", k.alias("seq"), F.lit("page").alias("kind"))
    found = X.fetched(requests, f"{shared_base(spark)}/fetch-{uuid.uuid4().hex}", 16, answers.unionByName(robots))
    return found.select(F.col("seq").alias("page_id"), "outcome", "slot")
