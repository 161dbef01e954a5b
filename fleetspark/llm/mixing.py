"""Mixing of sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Every source's documents are shuffled by a hash and laid end to end; the words so numbered are cut into blocks of
equal length within a source, BLOCK words at most and a thousandth of a mean target if that is less. The mix is a sequence of slots. Slot n has the point frac(n * golden ratio), which
the cumulative shares of the sources map to a source; the slots of a source are ranked, and rank r takes the source's
block r modulo its number of blocks. So any stretch of the mix holds the sources nearly in proportion to their targets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, FINE = 4096, 1000
#: Most of a source that a mix takes, in times its size.
MOST = 3
#: Rows of a run within which sizes are summed in order; slots of a run within which they are ranked.
RUN, SLOTS = 20_000, 1_000_000
GOLDEN = (math.sqrt(5) - 1) / 2
WHITE = r"[\x09-\x0D\x20]+"


def n_words(text: Column) -> Column:
    """Number of runs without ASCII white space; 0 for null."""
    parts = F.split(text, WHITE)
    ends = (F.element_at(parts, 1) == "").cast("int") + ((F.size(parts) > 1) & (F.element_at(parts, -1) == "")).cast("int")
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(parts) - ends).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, block: int = BLOCK) -> DataFrame:
    """From (source, source_size), one row a source: also its target, the number of its blocks and its bounds among slots.

    Sources by code point, null last, weigh ``weights``, repeating. They share all words by weight; a target stops at
    ``most`` times its source's size and the excess is shared again: in order of size over weight, a source is capped
    where its even share of what is left exceeds its cap. The table has a row a source, so its windows are small.
    """
    every = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.pmod(F.row_number().over(every) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    left = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", left).withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    # Caps come first in this order; the level of the first source that isn't capped holds for all after it.
    s = s.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "level"))).over(whole)["level"])
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("level") * F.col("weight"))))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("slots", F.when(F.col("blocks") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0))
    upper = F.sum("slots").over(every.rowsBetween(Window.unboundedPreceding, 0))
    return s.withColumn("upper", upper).withColumn("lower", F.col("upper") - F.col("slots")).withColumn("all_slots", F.sum("slots").over(whole))


def schedule(plan: DataFrame, most: int = MOST) -> DataFrame:
    """The mix from ``targets``: slot, source_no, rank and block of each slot.

    A source has one row in ``plan``, so slots meet sources by ranges of points: a cell of the unit interval lists the few
    sources that reach into it, and slots join cells by equality. Ranks are counted in runs of SLOTS slots, offset by what
    earlier runs hold, so no source's slots pass through one task.
    """
    spark = plan.sparkSession
    size = plan.agg(F.max("all_slots").alias("n"), F.count("*").alias("sources")).first()
    n = int(round(size["n"] or 0))
    cells = 4 * max(1, size["sources"])
    span = plan.where("slots > 0").select("source_no", "blocks", (F.col("lower") / F.col("all_slots")).alias("a"), (F.col("upper") / F.col("all_slots")).alias("b"))
    at = lambda c: F.least(F.floor(c * cells), F.lit(cells - 1))
    span = span.withColumn("cell", F.explode(F.sequence(at(F.col("a")), at(F.col("b")))))
    # n * GOLDEN in two parts, each far from losing its fraction
    high, low = F.floor(F.col("slot") / 2**20), F.pmod(F.col("slot"), F.lit(2**20))
    point = high * F.lit(math.fmod(2**20 * GOLDEN, 1.0)) + low * F.lit(GOLDEN) + 0.5 / max(1, n)
    slots = spark.range(n).select(F.col("id").alias("slot")).withColumn("x", point - F.floor(point)).withColumn("cell", at(F.col("x")))
    found = slots.join(F.broadcast(span) if size["sources"] <= 10_000 else span, "cell").where("x >= a and x < b").select("slot", "source_no", "blocks", F.floor(F.col("slot") / SLOTS).alias("run"))
    held = found.groupBy("run", "source_no").agg(F.count("*").alias("held"))
    earlier = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select("run", "source_no", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("run", "source_no").orderBy("slot")
    ranked = found.withColumn("nth", F.row_number().over(inside) - 1).join(held, ["run", "source_no"]).withColumn("rank", F.col("base") + F.col("nth"))
    return ranked.where(F.col("rank") < most * F.col("blocks")).select("slot", "source_no", "rank", F.pmod("rank", "blocks").alias("block"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), most: int = MOST, block: int | None = None) -> DataFrame:
    """Per row of ``docs``: the key, size, source_size, target and taken, the words that the mix takes of it.

    Size is the number of words, 0 for null texts; a null source is a source. Rows without words are kept and give none.
    Repeated rows count each; an empty table gives an empty result; other columns are ignored. The hash that shuffles is
    of key and size, so reruns agree. A source with a third of all rows is cut into runs of about RUN rows by ranges of
    the hash before its sizes are summed in order.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"))
    rows = written(rows.withColumn("hash", F.xxhash64("key", "size", F.lit(8))), "mix-sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    if block is None:
        known = sizes.agg(F.sum("source_size").alias("words"), F.count("*").alias("sources")).first()
        block = min(BLOCK, max(1, (known["words"] or 0) // (FINE * max(1, known["sources"]))))
    plan = targets(sizes, weights, most, block)
    plan = written(plan.withColumn("source_no", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source"))), "mix-plan")
    runs = 1 + rows.count() // RUN
    # A power of two of equal ranges of the hash
    bits = max(1, math.ceil(math.log2(runs))) if runs > 1 else 0
    numbered = rows.join(plan.select("source", "source_no", "source_size", "target", "blocks"), rows["source"].eqNullSafe(plan["source"])).drop("source")
    numbered = numbered.withColumn("run", F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long"))
    total = numbered.groupBy("source_no", "run").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("source_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select("source_no", "run", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source_no", "run").orderBy(F.shiftleft("hash", bits), "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = numbered.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offset, ["source_no", "run"])
    placed = written(placed.select("key", "size", "source_size", "target", "source_no", "blocks", (F.col("base") + F.col("inner")).alias("start")), "mix-places")

    plan_of = schedule(plan, most)
    times = plan_of.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # Block b of a source holds its words from ceil(b * size / blocks) on.
    first = F.floor(F.col("start") * F.col("blocks") / F.col("source_size"))
    last = F.floor((F.col("start") + F.col("size") - 1) * F.col("blocks") / F.col("source_size"))
    bound = lambda b: F.ceil(b * F.col("source_size") / F.col("blocks"))
    some = placed.where("size > 0").withColumn("row", F.struct("key", "start")).withColumn("block", F.explode(F.sequence(F.greatest(first - 1, F.lit(0)), F.least(last + 1, F.col("blocks") - 1))))
    part = F.least(bound(F.col("block") + 1), F.col("start") + F.col("size")) - F.greatest(bound(F.col("block")), F.col("start"))
    some = some.withColumn("part", part).where("part > 0")
    got = some.join(times, ["source_no", "block"], "left").groupBy("source_no", "start").agg(F.first("key").alias("key"), F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    columns = ["key", "size", "source_size", "target", "taken"]
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return got.select(*columns).unionAll(none.select(*columns)).select(F.col("key").alias(key), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))
