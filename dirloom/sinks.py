"""Sinks: per-source and merged outputs, array JSON, column widths, manifest."""

from __future__ import annotations

import logging
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .schema import COLUMNS

BOM = "﻿"


def write_csv(people: DataFrame, path: str) -> None:
    """CSV with a byte order mark before the header of its one file."""
    first, *rest = people.columns
    marked = people.select(F.col(first).alias(BOM + first), *rest)
    marked.coalesce(1).write.mode("overwrite").option("header", True).option("quoteAll", False).option("escape", '"').csv(path)


def write_json(people: DataFrame, path: str) -> None:
    """NDJSON; empty strings stay."""
    people.write.mode("overwrite").json(path)


def json_array(people: DataFrame, order: list[str]) -> DataFrame:
    """One row: all records as a JSON array, in order (for small, final outputs)."""
    row = F.struct(*order, F.to_json(F.struct(*people.columns)).alias("j"))
    return people.agg(F.concat(F.lit("["), F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda r: r["j"]), ",\n"), F.lit("]")).alias("json"))


def column_widths(df: DataFrame) -> DataFrame:
    """Width of each column of a sheet: the longest value and 2, from 10 to 60."""
    return df.agg(*(F.least(F.greatest(F.coalesce(F.max(F.length(F.col(c).cast("string"))), F.lit(0)) + 2, F.lit(10)), F.lit(60)).alias(c) for c in df.columns))


def write_parquet(people: DataFrame, path: str) -> None:
    people.write.mode("overwrite").parquet(path)


def write_xlsx(people: DataFrame, path: str) -> None:
    from .workbook import write_workbook

    write_workbook(people, path, [F.lower("department"), F.lower("name")])


WRITERS = {"csv": write_csv, "json": write_json, "parquet": write_parquet, "xlsx": write_xlsx}


def write_sites(people: DataFrame, base: str, formats: tuple[str, ...] = ("parquet",)) -> list[str]:
    """The paths that could be written: per-source datasets (partitions; none of workbooks) and
    the merged one in each format.  Unknown formats are skipped; one that fails is logged and
    doesn't keep the others from being written."""
    rows = people.select(*COLUMNS)
    written = []
    for f in formats:
        if f not in WRITERS:
            continue
        parts = [] if f == "xlsx" else [(f"{base}/raw.{f}", lambda p, f=f: rows.write.mode("overwrite").partitionBy("university").format(f).save(p))]
        for path, write in [*parts, (f"{base}/merged.{f}", lambda p, f=f: WRITERS[f](rows, p))]:
            try:
                write(path)
                written.append(path)
            except (PySparkException, Py4JJavaError, OSError) as e:
                logging.getLogger("dirloom").error("could not write %s: %s", path, str(e).split("\n")[0])
    return written


def usable_folder(wanted: str, spare: str) -> str:
    """``wanted`` if a file can be written there, else ``spare``."""
    try:
        os.makedirs(wanted, exist_ok=True)
        probe = os.path.join(wanted, f".probe-{uuid.uuid4().hex}")
        with open(probe, "w", encoding="utf-8") as f:
            f.write("ok")
        os.remove(probe)
        return wanted
    except OSError as e:
        logging.getLogger("dirloom").warning("cannot write to %s (%s), using %s", wanted, e, spare)
        os.makedirs(spare, exist_ok=True)
        return spare


def run_summary(people: DataFrame) -> DataFrame:
    """(university, people, with_photo, saved) of each site, and in total (TOTAL) at the end."""
    out = people.rollup("university").agg(F.count("*").alias("people"), F.count_if(F.col("photo_url") != "").alias("with_photo"), F.count_if(F.col("photo_file") != "").alias("saved"))
    return out.select(F.coalesce("university", F.lit("TOTAL")).alias("university"), "people", "with_photo", "saved").orderBy(F.col("university") == "TOTAL", "university")


def update_manifest(old: DataFrame, photos: DataFrame) -> DataFrame:
    """(url, file, sha1): saved photos replace older entries."""
    new = photos.filter("file <> ''").select("url", "file", "sha1")
    return new.unionByName(old.select("url", "file", "sha1").join(new, "url", "left_anti"))
