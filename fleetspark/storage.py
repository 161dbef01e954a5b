"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, ByteType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, TimestampType

#: Where the tables of ``written`` are; folders of local sessions that have no ``spark.checkpoint.dir``, by application.
_PATHS: WeakKeyDictionary = WeakKeyDictionary()
_LOCAL: dict[str, str] = {}
#: Bytes of a table up to which it is broadcast.
BROADCAST = 64 << 20
#: Shuffle files of a query go as soon as it ends; else they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where that is unset, a local session, whose driver is its only executor, gets
    a temporary folder of its own; on a cluster no folder of one machine would do, so it is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables are written there")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='fleetspark-')}"
        at = _LOCAL[context.applicationId]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, survives lost executors. Shuffle files
    that the writing took are deleted with its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, True)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            jvm, context = t.sparkSession._jvm, t.sparkSession.sparkContext
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, limit: int = BROADCAST) -> DataFrame:
    """``df``, with a hint to broadcast it if its rows take at most ``limit`` bytes by count. For tables cheap to read twice."""
    fixed = {BooleanType: 1, ByteType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, DateType: 4, LongType: 8, DoubleType: 8, TimestampType: 8}
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if isinstance(f.dataType, (StringType, BinaryType))]
    wide += [F.coalesce(8 * F.size(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() == "array"]
    size = F.lit(32 + sum(fixed.get(type(f.dataType), 16) for f in df.schema))
    for w in wide:
        size = size + w
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df
