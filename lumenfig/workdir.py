"""Tables that cut lineage, kept in the folder that all executors share.

The folder is the one named in ``spark.checkpoint.dir``. Only where the session
names none (tests, local runs) a temporary folder of this machine is set up.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder of the session; sets one where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] not in ("local", "local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lumenfig-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme of the file system that Spark finds it on, for those who open it without Spark."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()


class Workdir:
    """A folder of its own below the shared one, holding written tables; it goes when the driver ends."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{shared_root(spark)}/lumenfig/{label}-{uuid.uuid4().hex[:12]}"
        fs, at = self._at(self.path)
        fs.mkdirs(at)
        fs.deleteOnExit(at)

    def _at(self, path: str):
        """The file system of a path, and the path as it names it."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes the rows and gives them back without their lineage."""
        path = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Removes a written table that nothing reads any more."""
        fs, at = self._at(f"{self.path}/{name}")
        fs.delete(at, True)
