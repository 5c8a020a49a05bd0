"""What becomes of people's photos: variants, validity, placeholders, paths, manifest.

Fetching is a connector's work; here photos come as a table (url, content) of what
was fetched, such as ``binaryFile`` reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import patterns as P
from ..functions import text as T
from ..functions import urls as U
from .relational import image_result, sniff_extension

PLACEHOLDER_OWNERS = 3


def photo_owners(people: DataFrame) -> DataFrame:
    """(url, site, seq, owner, name): each person under their photo's URL."""
    return people.filter("photo_url <> ''").select(F.col("photo_url").alias("url"), "site", "seq", "name", T.name_key(F.col("name")).alias("owner"))


def wanted_variants(people: DataFrame) -> DataFrame:
    """(url, k, variant): the URLs to try for each photo, the largest picture's first."""
    return people.filter("photo_url <> ''").select(F.col("photo_url").alias("url")).distinct().select("url", F.posexplode(U.full_size_variants(F.col("url"))).alias("k", "variant"))


def fetched_photos(variants: DataFrame, contents: DataFrame, least_bytes: int = 1500, least_side: int = 60) -> DataFrame:
    """(url, result, extension, sha1, variant) of each photo: its first valid variant, else
    the result of the last that could be read; contents: (url, content)."""
    tried = variants.join(contents.select(F.col("url").alias("variant"), "content"), "variant", "left")
    about = tried.select("url", "k", "variant", image_result(F.col("content"), least_bytes, least_side).alias("result"), sniff_extension(F.col("content")).alias("extension"), F.sha1("content").alias("sha1"))
    good = F.min(F.when(F.col("result") == P.DOWNLOADED, F.struct("k", "result", "extension", "sha1", "variant")))
    bad = F.max(F.when(F.col("result") != P.FAILED, F.struct("k", "result")))
    best = about.groupBy("url").agg(good.alias("g"), bad.alias("b"))
    return best.select("url", F.coalesce("g.result", "b.result", F.lit(P.FAILED)).alias("result"), F.coalesce("g.extension", F.lit("")).alias("extension"), F.coalesce("g.sha1", F.lit("")).alias("sha1"), F.col("g.variant").alias("variant"))


def placeholder_hashes(owners: DataFrame, results: DataFrame, least: int = PLACEHOLDER_OWNERS) -> DataFrame:
    """(site, sha1) of pictures that so many people of a site share (2 at least)."""
    met = owners.join(results.filter("sha1 <> ''").select("url", "sha1"), "url")
    return met.groupBy("site", "sha1").agg(F.count_distinct("owner").alias("n")).filter(F.col("n") >= max(2, least)).select("site", "sha1")


def target_paths(people: DataFrame) -> DataFrame:
    """``target`` of each person: university/department/name, without an ending.

    People of one identity (photo, else profile, else name) share a path; of others with
    the same name, ignoring case, the second is ``name (2)`` and so on, in order; a
    numbered name that someone bears already is passed over."""
    folder = F.concat_ws("/", T.safe_filename(F.col("university"), 45), T.safe_filename(T.first_filled(F.col("department"), F.lit("Other")), 55))
    identity = T.first_filled(F.col("photo_url"), F.col("profile_url"), F.col("name"))
    named = people.withColumn("_folder", folder).withColumn("_base", T.safe_filename(F.col("name"), 80)).withColumn("_identity", identity)
    firsts = named.groupBy("_folder", F.lower("_base").alias("_low"), "_identity").agg(F.min(F.struct("site", "seq")).alias("at"))
    k = F.row_number().over(Window.partitionBy("_folder", "_low").orderBy("at"))
    numbered = firsts.withColumn("k", k)
    # numbers that a name can't get, as someone of the folder bears them: met by name, number by number
    bearer = r"^(.*) \(([1-9][0-9]{0,8})\)$"
    borne = numbered.filter("k = 1").select("_folder", F.regexp_extract("_low", bearer, 1).alias("_low"), F.regexp_extract("_low", bearer, 2).try_cast("int").alias("n")).filter("n >= 2")
    borne = borne.join(numbered.select("_folder", "_low").distinct(), ["_folder", "_low"], "left_semi").groupBy("_folder", "_low").agg(F.sort_array(F.collect_set("n")).alias("borne"))

    def free(k: Column, borne: Column) -> Column:
        """The (k - 1)-th number from 2 on that isn't borne: each borne one up to it moves it on."""
        return F.reduce(borne, k, lambda n, x: F.when(x <= n, n + 1).otherwise(n))

    chosen = numbered.join(borne, ["_folder", "_low"], "left").select("_folder", "_low", "_identity", F.when(F.col("k") == 1, 1).otherwise(free(F.col("k"), F.coalesce("borne", F.array().cast("array<int>")))).alias("_k"))
    joined = named.join(chosen, (named["_folder"] == chosen["_folder"]) & (F.lower(named["_base"]) == chosen["_low"]) & (named["_identity"] == chosen["_identity"])).drop(chosen["_folder"], chosen["_low"], chosen["_identity"])
    name = F.when(F.col("_k") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit(" ("), F.col("_k").cast("string"), F.lit(")")))
    return joined.withColumn("target", F.concat_ws("/", F.lit("photos"), "_folder", name)).drop("_folder", "_base", "_identity", "_k")


def from_manifest(owners_target: DataFrame, manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(url, result, extension, sha1) of photos saved earlier under the path that their
    first owner has now; owners_target: (url, target, seq), manifest: (url, file, sha1), files: (file) that exist."""
    first = owners_target.groupBy("url").agg(F.min_by("target", "seq").alias("target"))
    known = first.join(manifest, "url").join(files.select("file").distinct(), "file", "left_semi")
    extension = F.regexp_extract("file", r"\.[A-Za-z0-9]+$", 0)
    same = F.col("file") == F.concat("target", extension)
    return known.filter(same).select("url", F.lit(P.ALREADY).alias("result"), extension.alias("extension"), "sha1")


def photo_results(people: DataFrame, results: DataFrame, least: int = PLACEHOLDER_OWNERS) -> DataFrame:
    """``people`` (with target) with photo_file and photo_status; results: (url, result, extension, sha1)."""
    shared = placeholder_hashes(photo_owners(people), results, least).withColumn("shared", F.lit(True))
    known = results.select(F.col("url").alias("photo_url"), "result", "extension", "sha1")
    met = people.drop("photo_file", "photo_status").join(known, "photo_url", "left").join(shared, ["site", "sha1"], "left")
    saved = F.col("result").isin(P.DOWNLOADED, P.ALREADY) & F.col("shared").isNull()
    status = F.when(F.col("photo_url") == "", P.NO_PHOTO).when(F.col("shared"), P.PLACEHOLDER).otherwise(F.coalesce("result", F.lit(P.FAILED)))
    file = F.when((F.col("photo_url") != "") & saved, F.concat("target", F.col("extension"))).otherwise("")
    kept = [c for c in people.columns if c not in ("photo_file", "photo_status")]
    return met.withColumn("photo_status", status).withColumn("photo_file", F.coalesce(file, F.lit(""))).withColumn("file_sha1", F.coalesce("sha1", F.lit(""))).select(*kept, "photo_file", "photo_status", "file_sha1")


def manifest_of(people: DataFrame, old: DataFrame) -> DataFrame:
    """(url, file, sha1): photos saved now, beside those known before; people: see ``photo_results``."""
    new = people.filter("photo_file <> ''").groupBy(F.col("photo_url").alias("url")).agg(F.max_by("photo_file", "seq").alias("file"), F.max_by("file_sha1", "seq").alias("sha1"))
    return new.unionByName(old.select("url", "file", "sha1").join(new, "url", "left_anti"))
