import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType, TimestampType

from fleetspark.operators import narrow
from fleetspark.sources import files, incremental, probe

SCHEMA = StructType([StructField("vehicle", StringType()), StructField("speed", DoubleType()), StructField("n", IntegerType()), StructField("ts", TimestampType())])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    one = spark.createDataFrame([("a", 1.5, 1), ("b", None, 2)], "vehicle string, speed double, n int").withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    put = lambda df, name: df.coalesce(1).write.parquet(f"{at}/{name}")
    put(one, "whole")
    put(one.drop("speed").withColumn("more", F.lit(1)), "missing")
    put(one.withColumn("speed", F.when(F.col("n") == 1, "7.25").otherwise("n/a")).withColumn("n", F.col("n").cast("long")).withColumnRenamed("vehicle", "VEHICLE"), "retyped")
    put(one.drop("vehicle"), "nameless")
    (at / "broken.parquet").write_bytes(b"PAR1 this is no footer PAR1")
    (at / "empty.parquet").write_bytes(b"")
    return str(at)


def test_files_that_differ(spark, folder):
    paths = files.discover(spark, folder)
    table, report = probe.read_tolerant(spark, [*paths, paths[0], f"{folder}/gone.parquet"], SCHEMA, {"speed": -1.0}, require=["vehicle"])
    by = {r.path.rsplit("/", 2)[-2] if "part-" in r.path else r.path.rsplit("/", 1)[-1]: r for r in report.collect()}
    assert {k: r.state for k, r in by.items()} == {"whole": "read", "missing": "read", "retyped": "read", "nameless": "skipped", "broken.parquet": "broken", "empty.parquet": "broken", "gone.parquet": "broken"}
    assert by["missing"].missing == ["speed"] and by["missing"].extra == ["more"] and by["whole"].missing == [] and by["whole"].rows == 2
    assert by["retyped"].retyped == {"speed": "string", "n": "bigint"} and by["broken.parquet"].reason
    assert table.schema.simpleString() == SCHEMA.simpleString()
    assert sorted(((r.vehicle, r.speed, r.n) for r in table.collect()), key=str) == sorted([("a", 1.5, 1), ("b", None, 2), ("a", -1.0, 1), ("b", -1.0, 2), ("a", 7.25, 1), ("b", None, 2)], key=str)


def test_nothing_to_read(spark, folder):
    table, report = probe.read_tolerant(spark, [f"{folder}/broken.parquet"], SCHEMA)
    assert table.count() == 0 and table.columns == SCHEMA.names and report.count() == 1
    assert probe.read_tolerant(spark, [], SCHEMA)[0].count() == 0


BOUNDS = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-(2**31), 2**31 - 1), "long": (-(2**63), 2**63 - 1)}


def test_downcast_loses_nothing(spark):
    rows = []
    for low, high in BOUNDS.values():
        rows += [(low,), (high,), (None,)]
    for i, (name, (low, high)) in enumerate(BOUNDS.items()):
        df = spark.createDataFrame([(low,), (high,), (None,)], "x long")
        out = narrow.downcast(df)
        assert out.schema["x"].dataType.simpleString() == {"byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint"}[name]
        assert sorted(out.select(F.col("x").cast("long")).collect(), key=str) == sorted(df.collect(), key=str)
        if name != "long":
            beyond = narrow.downcast(spark.createDataFrame([(low,), (high + 1,)], "x long")).schema["x"].dataType.simpleString()
            assert beyond == {"byte": "smallint", "short": "int", "int": "bigint"}[name]


def test_downcast_of_floating_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1.0, 0.5, 0.1, -0.0, nan, inf, 2.0**40, 2.0**62, None, "a", 3), (-7.0, 1e30 * 0 + 0.25, 0.5, 1.0, 2.0, 1.0, 1.0, 1.0, None, "b", 300), (None,) * 11]
    names = "whole half tenth minus_zero nan inf big huge nothing text n".split()
    df = spark.createDataFrame(rows, ", ".join(f"{c} {'string' if c == 'text' else 'int' if c == 'n' else 'double'}" for c in names))
    out = narrow.downcast(df)
    kinds = {f.name: f.dataType.simpleString() for f in out.schema}
    assert kinds == {"whole": "tinyint", "half": "float", "tenth": "double", "minus_zero": "float", "nan": "float", "inf": "float", "big": "float", "huge": "float", "nothing": "double", "text": "string", "n": "smallint"} or kinds["big"] in ("float", "double")
    back = out.select(*(F.col(c).cast(df.schema[c].dataType).alias(c) for c in names))
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    facts = {r.column: r for r in narrow.narrowest(df).collect()}
    assert facts["whole"].nulls == 1 and facts["text"].levels == 2 and facts["n"].greatest == 300 and facts["tenth"].whole is False
    assert narrow.downcast(df, whole=False, single=False).schema["whole"].dataType.simpleString() == "double"
    assert narrow.downcast(df.limit(0)).schema == df.schema


def test_build_goes_on_where_it_was_stopped(spark, tmp_path):
    src, rows = str(tmp_path / "in"), [(i % 5, float(i), i) for i in range(120)]
    schema = StructType.fromDDL("g int, x double, i int")
    for k in range(6):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], schema).coalesce(1).write.mode("append").parquet(src)
    parts = lambda df: df.groupBy("g").agg(F.sum("x").alias("total"), F.count("*").alias("n"), F.min("i").alias("first"), F.max("i").alias("last"))
    seen = []

    def dies(df):
        seen.append(1)
        if len(seen) == 4:
            parts(df).write.mode("overwrite").parquet(f"{tmp_path}/out/batch=3")  # what a build leaves that ends before its batch is done
            raise RuntimeError("stopped")
        return parts(df)

    q = incremental.build(spark, src, schema, f"{tmp_path}/out", f"{tmp_path}/check", dies, files=1)
    with pytest.raises(Exception, match="stopped"):
        q.awaitTermination()
    made = lambda: sorted(tuple(r) for r in incremental.merged(spark, f"{tmp_path}/out", ["g"], ["total", "n"], ["first"], ["last"]).collect())
    incremental.build(spark, src, schema, f"{tmp_path}/out", f"{tmp_path}/check", parts, files=1).awaitTermination()
    want = sorted(tuple(r) for r in spark.createDataFrame(rows, schema).groupBy("g").agg(F.sum("x"), F.count("*"), F.min("i"), F.max("i")).collect())
    assert made() == want and len(incremental.parts_done(spark, f"{tmp_path}/out")) == 6
    incremental.build(spark, src, schema, f"{tmp_path}/out", f"{tmp_path}/check", parts, files=1).awaitTermination()
    assert made() == want  # nothing new, nothing twice
    spark.createDataFrame([(9, 1.0, 500)], schema).coalesce(1).write.mode("append").parquet(src)
    incremental.build(spark, src, schema, f"{tmp_path}/out", f"{tmp_path}/check", parts, files=1).awaitTermination()
    assert made() == sorted([*want, (9, 1.0, 1, 500, 500)])
    assert incremental.merged(spark, f"{tmp_path}/none", ["g"], ["x"], schema=schema).count() == 0
