"""Pages and pictures over a transport, as the Python data source ``dirloom_pages``.

    requests = write_requests(frontier, path)          # site by site, in order
    spark.dataSource.register(PagesSource)
    spark.read.format("dirloom_pages").option("requests", path).option("transport", "saved").option("responses", saved).load()

Requests are dealt out by site (registered domain), a partition a bucket of sites, as
what may be asked next depends on what the site said before:

* robots rules are read once an origin; a missing, failed or HTML answer allows all.
* each (site, kind) has slots: pages ``delay`` seconds apart or the crawl delay that the
  site asks for (15 s at most), pictures ``image_delay``.  ``slot`` says when a request was
  due if answers took no time; with ``wait`` the reader sleeps until then.
* a failed connection is tried again with the other of http and https; an answer of 429 or
  500 to 504 is asked for again up to ``retries`` times, 0, 2, 4, ... seconds apart.
* a host that failed ``dead_after`` requests in a row isn't asked any more.

Equality filters on ``site`` are pushed down.  A lost partition is read again from its
requests; nothing is kept between partitions.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition
from pyspark.sql.types import StructType

from ..functions import urls as U

SCHEMA = "site string, seq long, url string, kind string, outcome string, status int, final_url string, content_type string, content binary, attempts int, slot double"

ACCEPT = {"page": "text/html,application/xhtml+xml,application/xml;q=0.9,*/*;q=0.8", "image": "image/avif,image/webp,image/apng,image/*,*/*;q=0.8"}
AGAIN = frozenset((429, 500, 502, 503, 504))
FETCHED, REFUSED, DEAD, UNREACHED, NO_PAGE = "fetched", "refused by robots", "dead host", "no connection", "not a page"
ROBOTS_SECONDS, LONGEST_DELAY = 12, 15.0


@dataclass
class Answer:
    status: int
    url: str
    content_type: str = ""
    body: bytes = b""


class SavedTransport:
    """Answers from a Parquet table (url, failures, status, final_url, content_type, body), such
    as a test or an earlier run has left: ``failures`` tries fail before the answer comes.
    In a column ``seq`` an answer may name the one request that it is for.
    Other addresses have no connection.  A bucket's answers are held while it is read."""

    def __init__(self, options: dict[str, str], bucket: int):
        import pyarrow.parquet as pq

        rows = pq.read_table(_local(options["responses"]), filters=[("bucket", "=", bucket)])
        self.rows = {(r["url"], r.get("seq")): r for r in rows.to_pylist()}
        self.tries: dict[tuple[str, int | None], int] = {}
        self.seq: int | None = None

    def get(self, url: str, headers: dict[str, str], seconds: float) -> Answer:
        at = (url, self.seq) if (url, self.seq) in self.rows else (url, None)
        r = self.rows.get(at)
        self.tries[at] = self.tries.get(at, 0) + 1
        if r is None or self.tries[at] <= (r["failures"] or 0):
            raise ConnectionError(url)
        return Answer(r["status"], r["final_url"] or url, r["content_type"] or "", r["body"] or b"")


class HttpTransport:
    """Answers from the network, by the standard library."""

    def __init__(self, options: dict[str, str], bucket: int):
        self.agent = options.get("agent", "dirloom")
        self.seq: int | None = None

    def get(self, url: str, headers: dict[str, str], seconds: float) -> Answer:
        request = urllib.request.Request(url, headers={"User-Agent": self.agent, **headers})  # noqa: S310  only http and https come here
        try:
            with urllib.request.urlopen(request, timeout=seconds) as r:  # noqa: S310
                return Answer(r.status, r.url, r.headers.get("Content-Type", ""), r.read())
        except urllib.error.HTTPError as e:
            return Answer(e.code, e.url or url, e.headers.get("Content-Type", ""), e.read())
        except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
            raise ConnectionError(str(e)) from e


TRANSPORTS = {"saved": SavedTransport, "http": HttpTransport}


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path


@dataclass
class Site:
    """What a reader knows of one site so far."""

    next_slot: dict[str, float] = field(default_factory=dict)
    crawl_delay: float = 0.0
    rules: dict[str, RobotFileParser | None] = field(default_factory=dict)
    failures: dict[str, int] = field(default_factory=dict)


class Fetcher:
    """Fetches requests of one site after the other."""

    def __init__(self, options: dict[str, str], bucket: int):
        number = lambda name, value: float(options.get(name, value))
        self.transport = TRANSPORTS[options.get("transport", "saved")](options, bucket)
        self.delays = {"page": number("delay", 1.5), "image": number("image_delay", 0.4)}
        self.seconds, self.retries, self.dead_after = number("timeout", 25), int(number("retries", 3)), int(number("dead_after", 6))
        self.agent, self.robots, self.wait = options.get("agent", "*"), options.get("robots", "true") == "true", options.get("wait", "false") == "true"
        self.began = time.monotonic()
        self.site = Site()

    def _ask(self, url: str, kind: str, seconds: float) -> tuple[Answer, int]:
        """(the answer, tries it took); raises ConnectionError where none came."""
        answer = None
        for k in range(self.retries + 1):
            if k > 1 and self.wait:
                time.sleep(2.0 ** (k - 1))
            try:
                answer = self.transport.get(url, {"Accept": ACCEPT[kind]}, seconds)
            except ConnectionError:
                if k == self.retries:
                    raise
                continue
            if answer.status not in AGAIN:
                return answer, k + 1
        if answer is None:
            raise ConnectionError(url)
        return answer, self.retries + 1

    def _rules(self, origin: str) -> RobotFileParser | None:
        if origin not in self.site.rules:
            self.site.rules[origin] = None
            try:
                answer, _ = self._ask(f"{origin}/robots.txt", "page", min(self.seconds, ROBOTS_SECONDS))
            except ConnectionError:
                return None
            if answer.status == 200 and "html" not in answer.content_type.lower():
                rules = RobotFileParser()
                rules.parse(answer.body.decode("utf-8", "replace").splitlines())
                self.site.rules[origin] = rules
                self.site.crawl_delay = max(self.site.crawl_delay, min(float(rules.crawl_delay(self.agent) or 0), LONGEST_DELAY))
        return self.site.rules[origin]

    def _turn(self, kind: str) -> float:
        now = time.monotonic() - self.began if self.wait else 0.0
        slot = max(now, self.site.next_slot.get(kind, 0.0))
        self.site.next_slot[kind] = slot + max(self.delays[kind], self.site.crawl_delay if kind == "page" else 0.0)
        if slot > now and self.wait:
            time.sleep(slot - now)
        return slot

    def fetch(self, url: str, kind: str) -> tuple:
        """outcome, status, final_url, content_type, content, attempts, slot of a request."""
        parts = urlsplit(url)
        host, none = parts.hostname or "", (None, None, None, None, 0, None)
        if parts.scheme not in ("http", "https"):
            return UNREACHED, *none
        if self.site.failures.get(host, 0) >= self.dead_after:
            return DEAD, *none
        if self.robots and (rules := self._rules(f"{parts.scheme}://{parts.netloc}")) is not None and not rules.can_fetch(self.agent, url):
            return REFUSED, *none
        tries = 0
        for scheme in (parts.scheme, "http" if parts.scheme == "https" else "https"):
            slot = self._turn(kind)
            try:
                answer, n = self._ask(parts._replace(scheme=scheme).geturl(), kind, self.seconds)
            except ConnectionError:
                tries += self.retries + 1
                continue
            self.site.failures[host] = 0
            about = answer.status, answer.url, answer.content_type
            said = answer.content_type.lower()
            if answer.status >= 400:
                return f"http {answer.status}", *about, None, tries + n, slot
            if kind == "page" and said and not any(t in said for t in ("html", "xml", "text/plain")):
                return NO_PAGE, *about, None, tries + n, slot
            return FETCHED, *about, answer.body, tries + n, slot
        self.site.failures[host] = self.site.failures.get(host, 0) + 1
        return UNREACHED, None, None, None, None, tries, slot


class Bucket(InputPartition):
    def __init__(self, number: int):
        self.number = number


class PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.sites: list[str] | None = None

    def partitions(self) -> list[Bucket]:
        return [Bucket(k) for k in range(int(self.options["buckets"]))]

    def read(self, partition: Bucket) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        wanted = [("bucket", "=", partition.number)] + ([("site", "in", self.sites)] if self.sites else [])
        if self.sites == []:
            return
        rows = pq.read_table(_local(self.options["requests"]), columns=["site", "seq", "url", "kind"], filters=wanted)
        fetcher, site = None, None
        for r in rows.sort_by([("site", "ascending"), ("seq", "ascending")]).to_pylist():
            fetcher = fetcher or Fetcher(self.options, partition.number)
            if r["site"] != site:
                site, fetcher.site = r["site"], Site()
            fetcher.transport.seq = r["seq"]
            yield r["site"], r["seq"], r["url"], r["kind"], *fetcher.fetch(r["url"], r["kind"])


class PushingReader(PagesReader):
    """Spark refuses readers that take filters unless its session allows that."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality of the site; what a site's requests give depends on no other's."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("site",):
                self.sites = [f.value] if self.sites is None or f.value in self.sites else []
            else:
                yield f


class PagesSource(DataSource):
    """Options: requests, buckets, transport (saved or http), responses, delay, image_delay,
    timeout, retries, dead_after, agent, robots, wait, pushdown (true where the session has
    spark.sql.python.filterPushdown.enabled)."""

    @classmethod
    def name(cls) -> str:
        return "dirloom_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> PagesReader:
        return (PushingReader if self.options.get("pushdown") == "true" else PagesReader)(dict(self.options))


def by_bucket(rows: DataFrame, buckets: int) -> DataFrame:
    """``rows`` (url, ...) with the site of each and the bucket that the site is dealt to."""
    site = U.site_key(F.col("url"))
    return rows.withColumn("site", site).withColumn("bucket", F.pmod(F.xxhash64(site), F.lit(buckets)).cast("int"))


def write_buckets(rows: DataFrame, path: str, buckets: int) -> str:
    """Requests (url, seq, kind) or saved answers (url, ...) where readers find them by bucket."""
    by_bucket(rows, buckets).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
    return path


def fetched(requests: DataFrame, path: str, buckets: int = 64, responses: DataFrame | None = None, **options: object) -> DataFrame:
    """SCHEMA rows of ``requests`` (url, seq, kind), by the saved ``responses`` or the network;
    ``path`` is a folder that driver and executors share."""
    spark = requests.sparkSession
    spark.dataSource.register(PagesSource)
    reader = spark.read.format("dirloom_pages").option("requests", write_buckets(requests, f"{path}/requests", buckets)).option("buckets", buckets).option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if responses is not None:
        reader = reader.option("transport", "saved").option("responses", write_buckets(responses, f"{path}/responses", buckets))
    return reader.options(**{k: str(v).lower() if isinstance(v, bool) else v for k, v in options.items()}).load()
