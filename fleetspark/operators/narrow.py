"""The narrowest types that hold a table's numbers without loss, found in one aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType

WHOLE = [(ByteType(), 7), (ShortType(), 15), (IntegerType(), 31), (LongType(), 63)]
NUMBERS = (ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)


def narrowest(df: DataFrame, columns: list[str] | None = None, whole: bool = True, single: bool = True) -> DataFrame:
    """(column, was, narrow, least, greatest, whole, nulls, levels) of the numeric and text columns: narrow is the narrowest type
    that gives every value back when it is cast to it and back.

    Whole numbers go to the least of byte, short, int and long that holds them; floating columns too if ``whole`` and all their values are whole
    numbers other than -0.0, else doubles go to float if ``single`` and none changes. NaN and infinities keep a column floating. Columns
    without values keep their type. levels counts distinct values about (a text of few levels is one to encode). One pass, a row a column.
    """
    kinds = {f.name: f.dataType for f in df.schema if f.name in (columns or df.columns) and isinstance(f.dataType, (*NUMBERS, StringType))}
    aggs = []
    for i, (name, kind) in enumerate(kinds.items()):
        c = F.col(f"`{name}`")
        aggs += [F.count(c).alias(f"n{i}"), F.approx_count_distinct(c).alias(f"d{i}")]
        if isinstance(kind, StringType):
            continue
        aggs += [F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}")]
        if isinstance(kind, (FloatType, DoubleType)):
            d = c.cast("double")
            bound = float(2**63)
            plain = (F.abs(d) < bound) & (F.floor(F.when(F.abs(d) < bound, d)).cast("double") == d) & (d.cast("string") != "-0.0")
            aggs += [F.count(F.when(~F.coalesce(plain, F.lit(False)) & c.isNotNull(), 1)).alias(f"p{i}")]
            aggs += [F.count(F.when(~d.cast("float").cast("double").eqNullSafe(d), 1)).alias(f"f{i}")]
    row = df.agg(F.count("*").alias("n"), *aggs).first()
    out = []
    for i, (name, kind) in enumerate(kinds.items()):
        text = isinstance(kind, StringType)
        floating = isinstance(kind, (FloatType, DoubleType))
        least, greatest = (None, None) if text else (row[f"a{i}"], row[f"b{i}"])
        all_whole = not text and row[f"n{i}"] > 0 and (not floating or row[f"p{i}"] == 0)
        narrow: DataType = kind
        if all_whole and (whole or not floating):
            narrow = next((t for t, bits in WHOLE if -(2**bits) <= int(least) and int(greatest) <= 2**bits - 1), kind)
        elif isinstance(kind, DoubleType) and single and row[f"n{i}"] and row[f"f{i}"] == 0:
            narrow = FloatType()
        if _wider(narrow, kind):
            narrow = kind
        out.append((name, kind.simpleString(), narrow.simpleString(), None if least is None else float(least), None if greatest is None else float(greatest), None if text else bool(all_whole), row["n"] - row[f"n{i}"], row[f"d{i}"]))
    return df.sparkSession.createDataFrame(out, "column string, was string, narrow string, least double, greatest double, whole boolean, nulls long, levels long")


BYTES = {ByteType: 1, ShortType: 2, IntegerType: 4, FloatType: 4, LongType: 8, DoubleType: 8}


def _wider(a: DataType, b: DataType) -> bool:
    return BYTES.get(type(a), 0) > BYTES.get(type(b), 0) or BYTES.get(type(a)) == BYTES.get(type(b))


def downcast(df: DataFrame, columns: list[str] | None = None, whole: bool = True, single: bool = True) -> DataFrame:
    """``df`` with its numeric columns in their narrowest types; see ``narrowest``. The order of columns stays."""
    found = {r["column"]: r["narrow"] for r in narrowest(df, columns, whole, single).where("was <> narrow").collect()}
    return df.select(*(F.col(f"`{c}`").cast(found[c]).alias(c) if c in found else F.col(f"`{c}`") for c in df.columns))
