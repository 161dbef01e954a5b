"""What several operators share: intermediate tables, words of a text, columns, values that go to tasks."""

from __future__ import annotations

import pickle
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fleetspark.storage import bounded, discard, shared_dir, written  # noqa: F401

#: A-Z to a-z, byte for byte; UTF-8 sequences of other letters are left alone.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: As LOWER, and every ASCII character but letters and digits becomes a space.
WORDS = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in LOWER)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only, as ``lower`` of Spark also changes other letters."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def remainder(c: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n."""
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(n))


def shipped(spark: SparkSession, value) -> Callable:
    """A function that gives ``value`` in tasks; it is broadcast with the code of its classes. For bounded values only."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(held.value)
