"""Builds over files that keep coming, which can be stopped anywhere and go on: partial aggregates by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def build(spark: SparkSession, source: str, schema: StructType, path: str, checkpoint: str, parts: Callable[[DataFrame], DataFrame], files: int = 16, kind: str = "parquet") -> StreamingQuery:
    """Takes the files of ``source``, a folder or one file, that weren't taken yet, ``files`` a batch, writes ``parts`` of each batch below ``path`` and ends.

    A batch that was cut off is taken again, of the same files and under the same number, and replaces what it left: so each
    file counts once, however often the build is stopped. ``parts`` gives partial aggregates, which ``merged`` adds up.
    """
    reader = spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files)
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, source = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    stream = reader.load(source)

    def put(df: DataFrame, batch: int) -> None:
        parts(df).write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parts_done(spark: SparkSession, path: str) -> list[str]:
    """Batches below ``path`` that were written whole."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(at):
        return []
    found = [s.getPath() for s in system.listStatus(at) if s.getPath().getName().startswith("batch=")]
    return sorted(p.toString() for p in found if system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def merged(spark: SparkSession, path: str, by: list[str], sums: list[str] = (), least: list[str] = (), greatest: list[str] = (), schema: StructType | None = None) -> DataFrame:
    """One row an entity from the parts of all batches that are whole: sums of sums, least of least, greatest of greatest. Means
    come from sums and counts. Without a batch an empty table of ``schema``."""
    done = parts_done(spark, path)
    df = spark.read.option("basePath", path).parquet(*done).drop("batch") if done else spark.createDataFrame([], schema)
    return df.groupBy(*by).agg(*(F.sum(c).alias(c) for c in sums), *(F.min(c).alias(c) for c in least), *(F.max(c).alias(c) for c in greatest))
