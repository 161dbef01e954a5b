"""Folders whose files differ: what each file holds, read from its footer, and one table of all that can be read."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Its functions travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

REPORT = "path string, state string, reason string, rows long, found string, missing array<string>, retyped map<string,string>, extra array<string>"
#: Files that a task probes.
PER_TASK = 64
#: Kinds of files (sets of columns and types) that one table is made from at most; each is a scan of its own.
MOST_KINDS = 200


def footer(path: str) -> tuple[StructType, int]:
    """Columns and rows of a Parquet file, by its footer alone."""
    import pyarrow.parquet as pq
    from pyarrow import fs
    from pyspark.sql.pandas.types import from_arrow_schema

    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    else:
        system, at = fs.LocalFileSystem(), path
    with system.open_input_file(at) as f:
        meta = pq.ParquetFile(f)
        return from_arrow_schema(meta.schema_arrow), meta.metadata.num_rows


def probe(spark: SparkSession, paths: list[str], schema: StructType) -> DataFrame:
    """A row a file: path, state ('read', 'broken'), reason of those that are broken, rows, found (its columns as JSON of a schema), missing
    (columns of ``schema`` that it lacks), retyped (those of another type, with that) and extra (those that ``schema`` lacks).

    Footers are read in tasks over the list of files; a file system that only Spark opens is probed through Spark's reader, a file at a time.
    Names differ by case as Spark's do: not at all. Repeated paths are one.
    """
    wanted = {f.name.lower(): f for f in schema}

    def judged(path: str, found: StructType, rows: int | None) -> tuple:
        there = {f.name.lower(): f for f in found}
        missing = [f.name for n, f in wanted.items() if n not in there]
        retyped = {f.name: there[n].dataType.simpleString() for n, f in wanted.items() if n in there and there[n].dataType != f.dataType}
        return path, "read", None, rows, found.json(), missing, retyped, [f.name for n, f in there.items() if n not in wanted]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in REPORT.split(", ")]
        for b in batches:
            rows = []
            for path in b["path"]:
                try:
                    found, n = footer(path)
                except FileNotFoundError as e:
                    rows.append((path, "broken", f"{type(e).__name__}: {e}"[:300], None, None, None, None, None))
                except (OSError, ValueError) as e:  # Arrow's errors are ValueErrors or OSErrors; which schemes it knows it says by ValueError
                    state = "unknown" if "scheme" in str(e).lower() or "filesystem" in str(e).lower() else "broken"
                    rows.append((path, state, f"{type(e).__name__}: {e}"[:300], None, None, None, None, None))
                else:
                    rows.append(judged(path, found, n))
            yield pd.DataFrame(rows, columns=columns)

    paths = sorted(set(paths))
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, -(-len(paths) // PER_TASK)), "path")
    report = listed.mapInPandas(run, REPORT)
    unknown = [r["path"] for r in report.where("state = 'unknown'").select("path").collect()] if any("://" in p for p in paths) else []
    if not unknown:
        return report
    more = []
    for path in unknown:
        try:
            more.append(judged(path, spark.read.parquet(path).schema, None))
        except Exception as e:  # noqa: BLE001 whatever Spark can't read is named
            more.append((path, "broken", str(e)[:300], None, None, None, None, None))
    return report.where("state <> 'unknown'").unionByName(spark.createDataFrame(more, REPORT))


def read_tolerant(spark: SparkSession, paths: list[str], schema: StructType, defaults: dict | None = None, require: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(table, report): the columns of ``schema`` of all files that can be read, and ``probe``'s report with state 'skipped' for files
    that lack a column of ``require``.

    Missing columns get their default, or null; columns of another type are cast, and what doesn't fit becomes null. Files of like columns
    are read together. Without a file that can be read the table is empty.
    """
    lacks = F.arrays_overlap("missing", F.lit([*require]) if require else F.array().cast("array<string>"))
    report = probe(spark, paths, schema).withColumn("state", F.when(F.coalesce(lacks, F.lit(False)), "skipped").otherwise(F.col("state")))
    report = spark.createDataFrame(report.collect(), report.schema)  # a row a file
    kinds: dict[str, list[str]] = {}
    for r in report.where("state = 'read'").select("path", "found").collect():
        kinds.setdefault(r["found"], []).append(r["path"])
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"the files are of {len(kinds)} kinds; more than {MOST_KINDS} aren't made one table")
    parts = []
    for found, files in kinds.items():
        there = {f.name.lower(): f for f in StructType.fromJson(json.loads(found))}
        df = spark.read.schema(StructType([f for n, f in there.items() if n in {w.name.lower() for w in schema}])).parquet(*files)
        made = []
        for f in schema:
            own = there.get(f.name.lower())
            c = F.lit((defaults or {}).get(f.name)).cast(f.dataType) if own is None else F.col(own.name) if own.dataType == f.dataType else F.col(own.name).try_cast(f.dataType)
            made.append(c.alias(f.name))
        parts.append(df.select(*made))
    table = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return table, report
