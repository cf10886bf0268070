"""What the text operators share: reading tables, row keys and tables cut out of the lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a word after A-Z were lower-cased; runs of them are words.
WORD_CLASS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP_CLASS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and leaves every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the whole cluster shares. Where none is set, a new local one on a single machine, and an error elsewhere."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="spark-tesserae-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back: later steps neither recompute it nor depend on an executor's disk."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of a batch of rows that a Python task gets at once, where the session sets no limit of its own.
ARROW_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Sets the session's limit, which holds for whatever runs later too, unless it is set already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(ARROW_BYTES))


def packed(df: DataFrame, needed: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """The needed columns beside row_, a struct of the kept ones (all by default), so that no column can clash with a new one."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row_"), *needed)
