"""The keyed vector index: text assembly, insert-if-absent, upsert, orphans, dimension check, embedding."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from lumenfig.functions import text as T

INDEX_SCHEMA = (
    "figure_key STRING, doc_id STRING, source_pdf STRING, source_pdf_url STRING, page INT, image_path STRING, caption STRING, "
    "description2 STRING, description3 STRING, questions ARRAY<STRING>, full_text STRING, embedding ARRAY<FLOAT>"
)


class Embedder(Protocol):
    """Turns texts into vectors of one length; made once per process."""

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def index_rows(manifest: DataFrame) -> DataFrame:
    """Index documents of manifest records, without vectors; empty text and no questions where there are none."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")).alias(c)

    return manifest.select(
        T.figure_key(F.col("doc_id"), F.col("id")).alias("figure_key"), "doc_id", "source_pdf", "source_pdf_url", "page", "image_path", text("caption"), text("description2"), text("description3"),
        F.coalesce("questions", F.array().cast("array<string>")).alias("questions"), T.full_text(F.col("caption"), F.col("description2"), F.col("description3"), F.col("questions")).alias("full_text"),
    )


def first_of_key(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the first in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def absent(source: DataFrame, index: DataFrame, key: str) -> DataFrame:
    """Source rows whose key the index lacks. Only the index's keys are read, before anything is embedded."""
    return source.join(index.select(key).distinct(), key, "left_anti")


def insert_if_absent(index: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The index with the source's new keys; changed text of known keys is not refreshed."""
    return index.unionByName(absent(source, index, key))


def upsert(index: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """The index with every source row in place of the one with its key."""
    return index.join(source.select(key).distinct(), key, "left_anti").unionByName(source)


def orphans(index: DataFrame, local: DataFrame, key: str) -> DataFrame:
    """Index keys that no local record has any more."""
    return index.select(key).distinct().join(local.select(key), key, "left_anti")


def without_orphans(index: DataFrame, local: DataFrame, key: str) -> DataFrame:
    return index.join(local.select(key).distinct(), key, "left_semi")


def dimension(index: DataFrame, vec: str = "embedding") -> int:
    """The one length of the index's vectors, and the one its table is fixed to if it is; an error if there are several, 0 for an empty index without."""
    fixed = index.schema[vec].metadata.get("dimension")
    got = index.where(F.col(vec).isNotNull()).agg(F.min(F.size(vec)).alias("a"), F.max(F.size(vec)).alias("b")).first()
    if got["a"] != got["b"]:
        raise ValueError(f"vectors of {got['a']} to {got['b']} values in one index")
    if fixed and got["a"] and got["a"] != fixed:
        raise ValueError(f"vectors of {got['a']} values in an index of {fixed}")
    return int(got["a"] or fixed or 0)


def embedded(rows: DataFrame, embedder: Embedder, text: str = "full_text", vec: str = "embedding") -> DataFrame:
    """Rows with a vector and, where embedding failed, the reason; one bad row doesn't stop the others."""

    @pandas_udf("struct<value: array<float>, error: string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            said = [t or "" for t in texts]
            try:
                made = embedder.embed(said) if said else []
                if len(made) != len(said):
                    raise ValueError("not a vector for every text")
                yield pd.DataFrame({"value": made, "error": [None] * len(said)})
                continue
            except Exception:
                values, errors = [], []
            # One text of the batch spoils it: each is asked for by itself.
            for t in said:
                try:
                    values.append(embedder.embed([t])[0])
                    errors.append(None)
                except Exception as e:
                    values.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({"value": values, "error": errors})

    return rows.withColumn("_made", run(F.col(text))).withColumn(vec, F.col("_made.value")).withColumn("error", F.col("_made.error")).drop("_made")


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda p: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)


def fixed_to(rows: DataFrame, dim: int, vec: str = "embedding") -> DataFrame:
    """Rows whose column of vectors says, in the table's own schema, how long they are."""
    return rows.withMetadata(vec, {"dimension": dim})


def ensure_table(spark: SparkSession, path: str, schema: str = INDEX_SCHEMA, dim: int | None = None) -> DataFrame:
    """The index table at a path, made empty, for vectors of a length if one is given, if there is none.

    A table that a stopped :func:`build` left beside its path is put back.
    """
    fs, of = _files(spark, path)
    if not fs.exists(of(path)):
        if fs.exists(of(f"{path}.old")):
            fs.rename(of(f"{path}.old"), of(path))
        else:
            empty = spark.createDataFrame([], schema)
            (empty if dim is None else fixed_to(empty, dim)).write.parquet(path)
    return spark.read.parquet(path).select(*spark.createDataFrame([], schema).columns)


def build(spark: SparkSession, path: str, manifest: DataFrame, embedder: Embedder, force: bool = False, dim: int | None = None) -> tuple[int, int]:
    """Brings the index at ``path`` up to the manifest: orphans out, new keys embedded and in (all keys if forced). Counts before and after.

    What is new is written beside the index and checked first. Without orphans, new rows are added as files of their own; otherwise
    the whole new version is written beside the old one, which is renamed away and deleted only when the new one has its name. So a run
    that fails at any point leaves an index, which the next one finds. dim: length of vectors that a table made here is fixed to.
    """
    fs, of = _files(spark, path)
    index = ensure_table(spark, path, dim=dim)
    before, fixed = index.count(), index.schema["embedding"].metadata.get("dimension")
    local = first_of_key(index_rows(manifest), "figure_key", ["page", "image_path"])
    made = embedded(local if force else absent(local, index, "figure_key"), embedder).where("error is null").drop("error").select(*index.columns)
    made.write.mode("overwrite").parquet(f"{path}.new")
    fresh = spark.read.parquet(f"{path}.new")
    if fixed:
        fresh = fixed_to(fresh, fixed)
    have, more = dimension(index), dimension(fresh)
    if have and more and have != more:
        raise ValueError(f"vectors of {more} values for an index of {have}")
    if force or not orphans(index, local, "figure_key").isEmpty():
        kept = without_orphans(index, local, "figure_key")
        rows = upsert(kept, fresh, "figure_key") if force else kept.unionByName(fresh)
        (fixed_to(rows, fixed) if fixed else rows).write.mode("overwrite").parquet(f"{path}.next")
        fs.delete(of(f"{path}.old"), True)
        fs.rename(of(path), of(f"{path}.old"))
        fs.rename(of(f"{path}.next"), of(path))
        fs.delete(of(f"{path}.old"), True)
    elif not fresh.isEmpty():
        fresh.write.mode("append").parquet(path)
    fs.delete(of(f"{path}.new"), True)
    spark.catalog.refreshByPath(path)
    return before, spark.read.parquet(path).count()
