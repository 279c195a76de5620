"""Binary files: documents, page images and figure crops; lookups that stay below their root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfig.functions import text as T


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(doc_id, path, content) of the PDF files in a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(root)
    return rows.select(F.regexp_extract("path", r"([^/]+)\.pdf$", 1).alias("doc_id"), "path", "content")


def images(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, md5) of all images below a folder."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg}").load(root)
    return rows.select("path", "content", F.md5("content").alias("md5"))


def image_candidates(base: str) -> Column:
    """The places where a record's image may be, best first: its path as it is, in the data folder, then the older forms."""
    at, rel, file, doc = (F.coalesce(F.col(c), F.lit("")) for c in ("image_path", "path_rel", "file", "doc_id"))

    def where(used: Column, *parts) -> Column:
        return F.when(used != "", F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts]))

    return F.filter(
        F.array(
            where(at, T.to_posix(at)), where(at, f"{base}/", T.data_path(at)), where(at, f"{base}/", doc, "/", T.to_posix(at)), where(rel, T.to_posix(rel)), where(rel, f"{base}/", T.to_posix(rel)),
            where(file, f"{base}/", doc, "/crops/", file), F.when(doc != "", where(file, f"{base}/", doc, "/images/", file)),
        ),
        lambda p: p.isNotNull(),
    )


def with_image(records: DataFrame, listing: DataFrame, base: str, key: str = "image_path") -> DataFrame:
    """Records with the path of the first candidate that exists, null if none does. listing: path."""
    each = records.withColumn("_tries", image_candidates(base))
    tries = each.select("_tries").distinct().select("_tries", F.posexplode("_tries").alias("_at", "path"))
    there = listing.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).distinct()
    first = tries.join(there, "path").groupBy("_tries").agg(F.min_by("path", "_at").alias("image_file"))
    return each.join(first, "_tries", "left").drop("_tries")


def first_image(spark: SparkSession, root: str) -> bytes | None:
    """Some image for a preflight; crops only if there are no images."""
    for sub in ("images", "crops"):
        rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg}").load(root)
        got = rows.where(F.contains("path", F.lit(f"/{sub}/"))).select("content").limit(1).collect()
        if got:
            return bytes(got[0][0])
    return None


def one_file(spark: SparkSession, root: str, path: str) -> bytes:
    """A single file below ``root``; a path that would leave it is refused, a missing one is an error."""
    row = spark.range(1).select(T.data_path(F.lit(path)).alias("p"), T.escapes_root(F.lit(path)).alias("out")).first()
    if row["out"]:
        raise ValueError("path leaves its root")
    got = spark.read.format("binaryFile").load(f"{root}/{row['p']}").select("content").collect()
    return bytes(got[0][0])
