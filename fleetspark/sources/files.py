"""Sources and sinks: discovery, schemas, tolerant reading, CSV, Feather, GeoPackage, incremental parts."""

from __future__ import annotations

import os
import re
import sqlite3
import struct
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructType

#: Dates in a file's name: from, to.
SPAN = re.compile(r"(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})")


def read_parquet(spark: SparkSession, path: str | list[str], columns: list[str] | None = None, schema: StructType | None = None, defaults: dict | None = None) -> DataFrame:
    """Columns of Parquet files as one table; those that are missing get their default, or null, of the schema's type."""
    paths = [path] if isinstance(path, str) else path
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    for c in columns or []:
        if c not in df.columns:
            kind = schema[c].dataType if schema is not None and c in schema.names else "double"
            df = df.withColumn(c, F.lit((defaults or {}).get(c)).cast(kind))
    return no_nans(df.select(*columns) if columns else df)


def no_nans(df: DataFrame) -> DataFrame:
    """NaN becomes null in all floating columns."""
    return df.withColumns({f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))})


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header; values that don't fit the schema become null."""
    df = spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, one_file: bool = False) -> None:
    """CSV with a header; times keep their microseconds."""
    at = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    writer = (df.coalesce(1) if one_file else df).write.mode("overwrite")
    writer.options(timestampFormat=f"{at}XXX", timestampNTZFormat=at).csv(path, header=True)


def discover(spark: SparkSession, root: str, suffix: str = ".parquet") -> list[str]:
    """Paths below a folder, in order; the folder may be in any file system that Spark reads."""
    jvm, path = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while files.hasNext():
        name = files.next().getPath().toString()
        if name.endswith(suffix):
            out.append(name)
    del jvm
    return sorted(out)


def in_window(paths: list[str], first: str, last: str) -> list[str]:
    """The files whose names hold a span of dates within a window: partition pruning by name."""
    return [p for p in paths if (m := SPAN.search(os.path.basename(p))) and first <= m[1] and m[2] <= last]


def by_role(paths: list[str], roles: dict[str, str]) -> dict[str, list[str]]:
    """Files by the first role whose pattern their name holds."""
    out: dict[str, list[str]] = {r: [] for r in roles}
    for p in paths:
        for role, pattern in roles.items():
            if re.search(pattern, os.path.basename(p), re.I):
                out[role].append(p)
                break
    return out


def resolve(df: DataFrame, *aliases: str) -> str | None:
    """The first column that one of the aliases names, by lower case without other signs; else one that contains it."""
    plain = {re.sub(r"[^a-z0-9]", "", c.lower()): c for c in df.columns}
    wanted = [re.sub(r"[^a-z0-9]", "", a.lower()) for a in aliases]
    return next((plain[a] for a in wanted if a in plain), next((c for a in wanted for p, c in plain.items() if a in p), None))


def tidy_names(df: DataFrame) -> DataFrame:
    """Column names in lower case, stripped, spaces as underscores."""
    return df.withColumnsRenamed({c: re.sub(r"\s+", "_", c.strip().lower()) for c in df.columns})


def unzip(path: str, to: str | None = None) -> str:
    """Extracts an archive on the driver; gives the folder."""
    to = to or tempfile.mkdtemp(prefix="unzipped-")
    with zipfile.ZipFile(path) as z:
        z.extractall(to)
    return to


def read_feather(spark: SparkSession, path: str) -> DataFrame:
    """A Feather file of the driver's, a small cache; Spark has no reader of its own."""
    import pyarrow.feather

    return spark.createDataFrame(pyarrow.feather.read_table(path))


def write_feather(df: DataFrame, path: str) -> None:
    """Writes a small table as a Feather file of the driver's."""
    import pyarrow.feather

    pyarrow.feather.write_feather(df.toArrow(), path)


def write_part(df: DataFrame, path: str, part: str, value: str) -> bool:
    """Writes one part of an incremental table, unless it is there already; says whether it wrote."""
    spark, at = df.sparkSession, f"{path}/{part}={value}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return False
    df.write.mode("overwrite").parquet(at)
    return True


def lines_of(blob: bytes) -> list[list[tuple[float, float]]]:
    """Rings and lines of a GeoPackage geometry: a header with an optional box, then well-known binary."""
    if blob[:2] == b"GP":
        blob = blob[8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7] :]
    out: list[list[tuple[float, float]]] = []

    def read(at: int) -> int:
        order = "<" if blob[at] else ">"
        (kind,) = struct.unpack_from(order + "I", blob, at + 1)
        at += 5
        width = 2 + (kind // 1000 in (1, 2)) + 2 * (kind // 1000 == 3)
        kind %= 1000

        def points(at):
            (n,) = struct.unpack_from(order + "I", blob, at)
            flat = struct.unpack_from(f"{order}{n * width}d", blob, at + 4)
            out.append([(flat[i * width], flat[i * width + 1]) for i in range(n)])
            return at + 4 + 8 * n * width

        if kind == 1:
            return at + 8 * width
        if kind == 2:
            return points(at)
        (n,) = struct.unpack_from(order + "I", blob, at)
        at += 4
        for _ in range(n):
            at = points(at) if kind == 3 else read(at)
        return at

    read(0)
    return out


def read_layers(spark: SparkSession, path: str, mine: str, layers: list[str] | None = None) -> DataFrame:
    """Segments of a GeoPackage's layers: (mine, layer, geom_id, part, seg_id, x1, y1, x2, y2), in the file's coordinates.

    A GeoPackage is a database file of the driver's; its layers are mine plans of bounded size.
    """
    rows = []
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        for layer, column in db.execute("SELECT table_name, column_name FROM gpkg_geometry_columns").fetchall():
            if layers and layer not in layers:
                continue
            for geom_id, blob in enumerate(b for (b,) in db.execute(f'SELECT "{column}" FROM "{layer}"') if b):
                for part, line in enumerate(lines_of(blob)):
                    rows += [(mine, layer, geom_id, part, i, *a, *b) for i, (a, b) in enumerate(zip(line, line[1:]))]
    return spark.createDataFrame(rows, "mine string, layer string, geom_id long, part int, seg_id int, x1 double, y1 double, x2 double, y2 double")
