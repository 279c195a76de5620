"""Manifests: one JSON list of figure records per document."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from lumenfig import schemas
from lumenfig.functions import text as T


def read(spark: SparkSession, root: str, on_error: str = "skip", legacy: bool = False) -> DataFrame:
    """All records below ``root``/*/manifest.json, with the schema given and never inferred.

    on_error: "skip" leaves out every file with an unreadable record, "raise" fails on it. A missing column is null.
    """
    fields = schemas.MANIFEST + (f", {schemas.LEGACY}" if legacy else "")
    find = {"pathGlobFilter": "manifest.json", "recursiveFileLookup": True}
    if on_error == "raise":
        return spark.read.options(**find).option("multiLine", True).option("mode", "FAILFAST").schema(fields).json(root)
    # A manifest is one document's list and small, so a file is one value: it parses whole or not at all.
    files = spark.read.options(**find).text(root, wholetext=True)
    parsed = files.select(F.from_json("value", ArrayType(StructType.fromDDL(fields))).alias("r"))
    return parsed.select(F.explode("r").alias("r")).select("r.*")


def resolved_root(spark: SparkSession, candidates: Sequence[str]) -> str | None:
    """The first folder that holds a manifest of some document, or None."""
    for root in candidates:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/*/manifest.json")
        if spark.sparkContext._jsc and (found := at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)) and len(found):
            return root
    return None


def counted(records: DataFrame) -> DataFrame:
    """(doc_id, records, blank, pictured): how many records each document has, how many without a caption, and with an image (image_file, of files.with_image)."""
    return records.groupBy("doc_id").agg(
        F.count("*").alias("records"), F.count_if(T.strip(F.col("caption")) == "").alias("blank"), F.count("image_file").alias("pictured"),
    )


def current(records: DataFrame) -> DataFrame:
    """Records without the columns of earlier versions, paths with forward slashes."""
    rows = records.drop(*schemas.DROPPED)
    for c in ("image_path", "source_pdf", "path_rel"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.when(F.col(c).isNotNull(), T.to_posix(F.col(c))))
    return rows


def write(records: DataFrame, path: str) -> None:
    """One folder of JSON lines per document; the manifest table of choice."""
    records.write.mode("overwrite").partitionBy("doc_id").json(path)


def write_lists(records: DataFrame, documents: DataFrame, path: str) -> int:
    """One pretty JSON list per document, also for documents without figures, written by the tasks that hold them; gives how many lists changed.

    ``path`` is a folder that all executors share. A list is written beside the old one and then takes its place; one that says the same is left alone.
    """
    import json
    import os
    import uuid

    import pandas as pd

    columns = [c for c in records.columns if c != "doc_id"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        doc = pdf["doc_id"].iloc[0]
        rows = json.loads(pdf.dropna(subset=["id"]).sort_values("id").to_json(orient="records", force_ascii=False))
        folder = os.path.join(path, doc.replace("/", "_"))
        os.makedirs(folder, exist_ok=True)
        said = json.dumps([{k: int(v) if k in ("id", "page") and v is not None else v for k, v in r.items()} for r in rows], ensure_ascii=False, indent=2).encode()
        name = os.path.join(folder, "manifest.json")
        if os.path.exists(name) and open(name, "rb").read() == said:
            return pd.DataFrame({"doc_id": [doc], "changed": [0]})
        part = f"{name}.{uuid.uuid4().hex[:8]}"
        with open(part, "wb") as f:
            f.write(said)
        os.replace(part, name)
        return pd.DataFrame({"doc_id": [doc], "changed": [1]})

    whole = documents.select("doc_id").distinct().join(records, "doc_id", "left").select("doc_id", *columns)
    return whole.groupBy("doc_id").applyInPandas(run, "doc_id STRING, changed LONG").agg(F.coalesce(F.sum("changed"), F.lit(0))).first()[0]
