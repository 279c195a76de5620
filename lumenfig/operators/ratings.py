"""Votes on hits: append, count, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RATING_SCHEMA = "query STRING, image_path STRING, score INT, timestamp STRING"


def valid(score: Column) -> Column:
    """1 to 5; null is no vote."""
    return F.coalesce(score.between(1, 5), F.lit(False))


def append(spark: SparkSession, path: str, query: str, image_path: str, score: int, timestamp: str) -> int:
    """Adds one vote, which may repeat another, and gives the number of votes that now stand there."""
    if not 1 <= score <= 5:
        raise ValueError("a vote is 1 to 5")
    spark.createDataFrame([(query, image_path, score, timestamp)], RATING_SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(RATING_SCHEMA).parquet(path).count()


def compact(spark: SparkSession, path: str, files: int = 1) -> int:
    """Rewrites the votes as a few files, beside the many and then in their place; gives how many there are. Nobody may vote meanwhile."""
    jvm = spark.sparkContext._jvm
    of = jvm.org.apache.hadoop.fs.Path
    fs = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    spark.read.schema(RATING_SCHEMA).parquet(path).coalesce(files).write.mode("overwrite").parquet(f"{path}.next")
    fs.rename(of(path), of(f"{path}.old"))
    fs.rename(of(f"{path}.next"), of(path))
    fs.delete(of(f"{path}.old"), True)
    spark.catalog.refreshByPath(path)
    return spark.read.schema(RATING_SCHEMA).parquet(path).count()


def export_rows(ratings: DataFrame) -> DataFrame:
    """Votes under the names of the export, missing values empty."""

    def text(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(""))

    return ratings.select(text("timestamp").alias("Timestamp"), text("query").alias("Query"), text("image_path").alias("Ruta_Imagen"), text("score").alias("Estrellas"))


def export_csv(ratings: DataFrame, path: str) -> None:
    """CSV with a header, doubled quotes and CRLF lines."""
    out = export_rows(ratings).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n")
    out.csv(path)
