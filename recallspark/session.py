"""What operators need of the session: the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it names none and all run on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("the cluster names no folder that driver and executors share: set spark.checkpoint.dir")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="recallspark-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's name below the shared one."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class Kept:
    """Rows that a command needs more than once, as compressed columns in the shared folder, until the command is done with them.

    A checkpoint is not compressed, has all columns of a row together, and stays until the driver happens to collect its garbage.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.where, self.made = spark, scratch(spark, "kept"), 0

    def __call__(self, df: DataFrame) -> DataFrame:
        self.made += 1
        df.write.option("compression", "zstd").parquet(f"{self.where}/{self.made}")
        return self.spark.read.schema(df.schema).parquet(f"{self.where}/{self.made}")

    def clear(self) -> None:
        """Removes the rows; nothing that is made from them can be read any more."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def checkpointed(df: DataFrame) -> DataFrame:
    """df from the shared folder, so that a lost executor costs no more than the last step."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
