"""Structured Streaming forms of incremental operators (beyond what batch needs)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds between requests of a kind, and failures in a row after which a host isn't asked.
DELAYS = {"page": 1.5, "image": 0.4}
DEAD_AFTER = 6


def new_pages(stream: DataFrame, key: str = "url", at: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first arrival of each page; state is dropped ``late`` after its time."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def request_rates(stream: DataFrame, site: str = "site", at: str = "ts", width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Requests of each site in each window, once the window can't change any more."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, width), site).agg(F.count("*").alias("requests"))
    return counted.select("window.start", site, "requests")


SLOTS = "site string, kind string, seq long, host string, at double, slot double"
_STATE = "next_slot double, crawl_delay double, failures string"


def request_slots(stream: DataFrame, delays: dict[str, float] | None = None, dead_after: int = DEAD_AFTER) -> DataFrame:
    """SLOTS of a stream of requests (site, kind, seq, host, at in seconds, perhaps
    crawl_delay, failed): when each may start, as ``relational.rate_slots`` says for a table.

    A site has a queue for each kind.  Its state outlives restarts: the next free slot, the
    greatest crawl delay told so far (for pages), and how many requests of each host failed in
    a row (``failed``; null: not known yet, a row that only asks).  Requests to a host that
    failed ``dead_after`` times in a row get no slot (null) and take no turn.  Rows of a
    micro-batch are taken by (at, seq); a site's requests come in order from batch to batch."""
    waits = DELAYS if delays is None else delays

    def step(key: tuple[str, str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        site, kind = key
        free, crawl, known = state.get if state.exists else (0.0, 0.0, "{}")
        failures = json.loads(known)
        rows = pd.concat(batches).sort_values(["at", "seq"])
        slots: list[float | None] = []
        for at, host, told, failed in zip(rows["at"], rows["host"], rows["crawl_delay"], rows["failed"], strict=True):
            if pd.notna(told) and kind == "page":
                crawl = max(crawl, float(told))
            if failures.get(host, 0) >= dead_after:
                slots.append(None)
                continue
            slot = max(float(at), free)
            free = slot + max(waits[kind], crawl)
            slots.append(slot)
            if pd.notna(failed):
                failures[host] = failures.get(host, 0) + 1 if failed else 0
        state.update((free, crawl, json.dumps({h: n for h, n in failures.items() if n})))
        yield pd.DataFrame({"site": site, "kind": kind, "seq": rows["seq"], "host": rows["host"], "at": rows["at"], "slot": pd.Series(slots, rows.index, dtype="float64")})

    have = stream.columns
    none = {"crawl_delay": "double", "failed": "boolean"}
    rows = stream.select("site", "kind", "seq", "host", F.col("at").cast("double").alias("at"), *(F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in none.items()))
    return rows.groupBy("site", "kind").applyInPandasWithState(step, SLOTS, _STATE, "append", GroupStateTimeout.NoTimeout)
