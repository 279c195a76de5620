"""Votes as a stream: an extension, since nothing here is streamed otherwise.

An append-only sink without deduplication, as for single votes, and running counts per image and window with a
watermark. Checkpoints go to the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfig.operators import ratings
from lumenfig.workdir import shared_root


def read(spark: SparkSession, path: str) -> DataFrame:
    """Votes that arrive as JSON lines in a folder, out-of-range ones left out."""
    rows = spark.readStream.schema(ratings.RATING_SCHEMA).json(path)
    return rows.where(ratings.valid(F.col("score")))


def append(votes: DataFrame, path: str, name: str) -> StreamingQuery:
    """Adds all votes that have arrived to the table at ``path``, then ends; call again for later ones."""
    check = f"{shared_root(votes.sparkSession)}/streams/{name}"
    return votes.writeStream.format("parquet").option("path", path).option("checkpointLocation", check).outputMode("append").trigger(availableNow=True).start()


def counted(votes: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Votes and mean score per image and window; votes later than the watermark are dropped."""
    at = F.try_to_timestamp(F.replace("timestamp", F.lit(" "), F.lit("T")))
    rows = votes.withColumn("at", at).where("at is not null").withWatermark("at", late)
    return rows.groupBy(F.window("at", window), "image_path").agg(F.count("*").alias("votes"), F.avg("score").alias("score"))
