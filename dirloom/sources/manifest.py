"""Manifests kept as one JSON object, {url: {"file": ..., "sha1": ...}}, as rows."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "url string, file string, sha1 string"


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """MANIFEST rows of one file, or of all files of a folder or pattern.  A file that isn't
    there, isn't JSON or isn't an object is an empty manifest; so is an entry that isn't an
    object or names no file.  A missing sha1 is empty.  An address of several files has the
    entry of the file with the greatest modification time, then name."""
    try:
        files = spark.read.format("binaryFile").load(path).select("path", "modificationTime", F.col("content").cast("string").alias("text"))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)
    parsed = files.select("path", "modificationTime", F.try_parse_json("text").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))
    entries = parsed.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("key").alias("url"), F.col("value").alias("entry")))
    rows = entries.select("url", *(F.try_variant_get("entry", f"$.{c}", "string").alias(c) for c in ("file", "sha1")), F.struct("modificationTime", "path").alias("o"))
    last = rows.filter("file <> ''").groupBy("url").agg(F.max_by(F.struct("file", F.coalesce("sha1", F.lit("")).alias("sha1")), "o").alias("e"))
    return last.select("url", "e.file", "e.sha1")
