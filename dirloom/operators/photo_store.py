"""The photo stage: from people and fetched pictures to files, statuses and the manifest.

    wanted = to_fetch(people, base)                    # what a run has to ask for
    people = save_photos(people, contents, base)       # contents: (url, content) of what came

Files go through the data source ``dirloom_photos``: each is written beside its place and
moved there, so none is ever seen in part, and the same photo saved earlier with another
ending is deleted.  A task that runs twice writes the same files twice.  The manifest of
(url, file, sha1) is a new table each run, and a pointer file is moved to name it last: a
run that dies leaves the old one.  Of photos that the manifest names and that are still
under their path nothing is fetched again; failures and placeholders are.

``base`` is a folder that driver and executors share, a path or a URI that pyarrow knows.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

from .. import patterns as P
from ..materialize import cut
from .photos import PLACEHOLDER_OWNERS, fetched_photos, from_manifest, manifest_of, photo_results, target_paths, wanted_variants

#: Endings of saved photos.
ENDINGS = (".jpg", ".png", ".webp", ".gif", ".bmp", ".avif", ".heic", ".tif")
MANIFEST = "url string, file string, sha1 string"
POINTER = "manifest.current"


class Store:
    """Files below a base folder."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, root = fs.FileSystem.from_uri(base if "://" in base else "file://" + posixpath.abspath(base))
        self.root = root.rstrip("/")

    def at(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, names: list[str]) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info([self.at(n) for n in names])
        return [n for n, i in zip(names, found, strict=True) if i.type == fs.FileType.File]

    def read(self, name: str) -> bytes:
        with self.fs.open_input_stream(self.at(name)) as f:
            return f.read()

    def replace(self, name: str, content: bytes) -> None:
        """Write whole, beside the place, then move."""
        part = self.at(f"{name}.{uuid.uuid4().hex}.part")
        self.fs.create_dir(posixpath.dirname(part), recursive=True)
        with self.fs.open_output_stream(part) as f:
            f.write(content)
        self.fs.move(part, self.at(name))

    def keep_only(self, target: str, ending: str) -> None:
        """Delete what was saved for ``target`` with another ending (all of it if none is given)."""
        for name in self.exists([target + e for e in ENDINGS if e != ending]):
            self.fs.delete_file(self.at(name))


@dataclass
class Written(WriterCommitMessage):
    files: int
    size: int


class PhotoWriter(DataSourceWriter):
    """Rows (target, extension, content, source): content, or a copy of the saved file
    ``source``, is written as target + extension; without either the target's files go."""

    def __init__(self, base: str):
        self.base = base

    def write(self, rows: Iterator[Row]) -> Written:
        store, files, size = Store(self.base), 0, 0
        for r in rows:
            content = bytes(r["content"]) if r["content"] is not None else store.read(r["source"]) if r["source"] else None
            if content is not None:
                store.replace(r["target"] + r["extension"], content)
                files, size = files + 1, size + len(content)
            store.keep_only(r["target"], r["extension"] if content is not None else "")
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Each file is complete by itself; the manifest, moved afterwards, tells which count."""

    def abort(self, messages: list[Written | None]) -> None:
        """Files that are complete stay: no manifest names them, so the next run writes them again."""


class PhotoSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dirloom_photos"

    def schema(self) -> str:
        return "target string, extension string, content binary, source string"

    def writer(self, schema: StructType, overwrite: bool) -> PhotoWriter:
        return PhotoWriter(self.options["base"])


def read_manifest(spark: SparkSession, base: str) -> DataFrame:
    """The manifest that counts; none, or a pointer to nothing that can be read, is an empty one."""
    store = Store(base)
    if store.exists([POINTER]):
        name = store.read(POINTER).decode()
        if store.exists([f"{name}/_SUCCESS"]):
            return spark.read.schema(MANIFEST).json(f"{base}/{name}")
    return spark.createDataFrame([], MANIFEST)


def write_manifest(manifest: DataFrame, base: str) -> None:
    name = f"manifest-{uuid.uuid4().hex}"
    manifest.select("url", "file", "sha1").write.json(f"{base}/{name}")
    Store(base).replace(POINTER, name.encode())


def _existing(manifest: DataFrame, base: str) -> DataFrame:
    """(file) of the manifest's files that are there, asked for by the executors."""

    def there(batches):  # noqa: ANN001, ANN202
        import pandas as pd

        store = Store(base)
        for b in batches:
            yield pd.DataFrame({"file": store.exists(b["file"].tolist()) if len(b) else []}, dtype="object")

    return manifest.select("file").distinct().mapInPandas(there, "file string")


def _known(placed: DataFrame, base: str) -> tuple[DataFrame, DataFrame]:
    """(results of photos that are saved already, the manifest)."""
    manifest = read_manifest(placed.sparkSession, base)
    owners = placed.filter("photo_url <> ''").select(F.col("photo_url").alias("url"), "target", "seq")
    return from_manifest(owners, manifest, _existing(manifest, base)), manifest


def to_fetch(people: DataFrame, base: str) -> DataFrame:
    """(url, k, variant): addresses to ask for, the first of each photo first; none of photos
    that are saved under their path.  people: (site, seq, university, department, name,
    profile_url, photo_url)."""
    known, _ = _known(target_paths(people), base)
    return wanted_variants(people).join(known.select("url"), "url", "left_anti")


def save_photos(people: DataFrame, contents: DataFrame, base: str, least_bytes: int = 1500, least_side: int = 60, least_owners: int = PLACEHOLDER_OWNERS) -> DataFrame:
    """``people`` with photo_file (below ``base``) and photo_status, once the files are written."""
    spark = people.sparkSession
    spark.dataSource.register(PhotoSink)
    placed = cut(target_paths(people))
    known, manifest = _known(placed, base)
    known = cut(known)
    wanted = wanted_variants(people).join(known.select("url"), "url", "left_anti")
    fresh = cut(fetched_photos(wanted, contents, least_bytes, least_side))
    results = known.withColumn("variant", F.lit(None).cast("string")).unionByName(fresh)
    found = cut(photo_results(placed, results, least_owners))

    saved = found.filter("photo_file <> ''")
    extension = F.regexp_extract("photo_file", r"\.[A-Za-z0-9]+$", 0).alias("extension")
    new = saved.select(F.col("photo_url").alias("url"), "target", extension).distinct().join(fresh.filter(F.col("variant").isNotNull()).select("url", "variant"), "url")
    new = new.join(contents.select(F.col("url").alias("variant"), "content").groupBy("variant").agg(F.first("content").alias("content")), "variant").select("target", "extension", "content", F.lit(None).cast("string").alias("source"))
    # further people of a photo that is saved already get copies of its file
    first = manifest.select("url", F.col("file").alias("source")).join(known.select("url"), "url")
    more = saved.select(F.col("photo_url").alias("url"), "target", "photo_file", extension).distinct().join(first, "url").filter(F.col("photo_file") != F.col("source"))
    gone = found.filter(F.col("photo_status") == P.PLACEHOLDER).select("target").distinct().join(saved.select("target"), "target", "left_anti")
    none = F.lit(None).cast("binary").alias("content")
    rows = new.unionByName(more.select("target", "extension", none, "source")).unionByName(gone.select("target", F.lit("").alias("extension"), none, F.lit(None).cast("string").alias("source")))
    rows.write.format("dirloom_photos").option("base", base).mode("append").save()
    write_manifest(manifest_of(found, manifest), base)
    return found
