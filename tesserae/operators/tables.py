"""Tables in the folder that the cluster shares: they cut lineage, so lost executors cost nothing that was written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder the cluster shares (spark.checkpoint.dir). Where none is set, a local session gets a
    temporary folder and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-tesserae-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again, which cuts its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Deletes a table made by saved() that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Ledger:
    """A table that rounds append to; reading it is one scan however many rounds there were."""

    def __init__(self, spark: SparkSession, schema: str, name: str):
        self.spark, self.schema, self.path = spark, schema, shared_path(spark, name)

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        """All rows so far; add() must have been called."""
        return self.spark.read.schema(self.schema).parquet(self.path)
