import re
import time

from pyspark.sql import functions as F

from fleetspark.storage import CLEANUP, written


def test_written_leaves_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: set(re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(",")))
    before, was = files(), spark.conf.get(CLEANUP, None)
    out = written(spark.range(1000).repartition(3).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and spark.conf.get(CLEANUP, None) == was
    assert out.agg(F.sum("count")).first()[0] == 1000
