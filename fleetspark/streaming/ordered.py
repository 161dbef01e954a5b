"""Walks along an entity's rows in time order, on streams whose rows arrive in any order.

A row is held in the state until the watermark has passed it, so that none before it can come; then the rows that are
due are walked in order, from where the last walk stopped. What a walk carries on is a few numbers. The state of an
entity is the rows within the watermark's delay, however long its history. Streams need the RocksDB state store
(``state_store``); rows later than the watermark are dropped and counted in the query's progress (``dropped``).
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

# Its functions travel to the executors with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def state_store(spark: SparkSession) -> None:
    """Sets the session to the state store that timers and lists need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Holds an entity's rows until they are due and hands them to ``step`` in order.

    step(rows, carried) -> (rows to give out, carried): rows are a frame sorted by time and tie; carried is a tuple, None at first.
    """

    def __init__(self, step: Callable, held: StructType, carried: StructType, key: str, out: list[str], tie: str):
        self.step, self.held, self.kept, self.key, self.out, self.tie = step, held, carried, key, out, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.held)
        self.carried = handle.getValueState("carried", self.kept)
        self.due = handle.getValueState("due", StructType([StructField("at", LongType())]))

    def _wake(self, micros: int) -> None:
        """A timer at the first millisecond after ``micros``, unless one comes before."""
        at = int(micros) // 1000 + 1
        set_to = self.due.get()[0] if self.due.exists() else None
        if set_to is None or at < set_to:
            if set_to is not None:
                self.handle.deleteTimer(set_to)
            self.handle.registerTimer(at)
            self.due.update((at,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = self.held.names
        for f in rows:
            f = f[names].astype(object).where(f[names].notna(), None)
            if len(f):
                self.rows.appendList([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in f.itertuples(index=False, name=None)])
                self._wake(f["micros"].min())
        yield pd.DataFrame(columns=self.out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.due.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame([tuple(r) for r in self.rows.get()], columns=self.held.names).sort_values(["micros", self.tie])
        done, rest = held[held["micros"] <= passed], held[held["micros"] > passed]
        if len(rest):
            kept = rest.astype(object).where(rest.notna(), None)
            self.rows.put([tuple(x.item() if isinstance(x, np.generic) else x for x in r) for r in kept.itertuples(index=False, name=None)])
            self._wake(rest["micros"].min())
        else:
            self.rows.clear()
        if len(done):
            out, carried = self.step(done, tuple(self.carried.get()) if self.carried.exists() else None)
            self.carried.update(carried)
            out = out.assign(**{self.key: key[0]})
            yield out[self.out]
        else:
            yield pd.DataFrame(columns=self.out)

    def close(self) -> None:
        pass


def in_order(df: DataFrame, by: str, tie: str, fields: list[str], step: Callable, gives: str, carries: str, ts: str = "ts", watermark: str = "1 hour") -> DataFrame:
    """(by, and what ``step`` gives) of a stream with an instant ``ts``. Rows without time or entity are left out."""
    rows = df.where(F.col(ts).isNotNull() & F.col(by).isNotNull()).withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, watermark)
    rows = rows.select(by, ts, F.unix_micros(ts).alias("micros"), tie, *fields)
    held = StructType([rows.schema[c] for c in ("micros", tie, *fields)])
    out = StructType([rows.schema[by], *StructType.fromDDL(gives)])
    machine = InOrder(step, held, StructType.fromDDL(carries), by, out.names, tie)
    return rows.groupBy(by).transformWithStateInPandas(machine, out, "append", "eventTime")


def load_step(rows: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple]:
    """Load state after each row: 1 on leaving the loading zone, 0 in the dump zone, unchanged elsewhere; at first 0."""
    was, loaded = carried or (False, 0)
    known = rows["at_load"].notna().to_numpy()
    loading = rows["at_load"].eq(True).to_numpy()
    dumping = rows["at_dump"].eq(True).to_numpy()
    before = np.r_[was, loading[:-1]].astype(bool)
    event = np.where(loading, np.nan, np.where(dumping, 0.0, np.where(before & known, 1.0, np.nan)))
    state = pd.Series(event).ffill().fillna(loaded).astype(int)
    return pd.DataFrame({"event_id": rows["event_id"].to_numpy(), "loaded": state.to_numpy()}), (bool(loading[-1]), int(state.iloc[-1]))


def load_states(df: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """(vehicle, event_id, loaded): each vehicle's load state after each of its rows, given out when the watermark has passed it."""
    return in_order(df, "vehicle", "event_id", ["at_load", "at_dump"], load_step, "event_id long, loaded int", "loading boolean, loaded int", watermark=watermark)


def gate_step(gate: float) -> Callable:
    """Keeps the first row with a position and then each that is at least ``gate`` beyond the last one kept."""

    def step(rows: pd.DataFrame, carried: tuple | None) -> tuple[pd.DataFrame, tuple]:
        last = carried[0] if carried else None
        rows = rows[rows["at"].notna()]
        x = rows["at"].to_numpy(float)
        top = np.maximum.accumulate(x) if len(x) else x
        keep = []
        while (k := int(np.searchsorted(top, -np.inf if last is None else last + gate))) < len(x):
            keep.append(k)
            last = float(top[k])
        kept = rows.iloc[keep]
        return pd.DataFrame({"event_id": kept["event_id"].to_numpy(), "at": kept["at"].to_numpy(float)}), (last,)

    return step


def gated_rows(df: DataFrame, gate: float, at: str, watermark: str = "1 hour") -> DataFrame:
    """(vehicle, event_id, at): the rows that ``greedy_gate`` keeps, on a stream; NaN counts as null."""
    rows = df.withColumn("at", F.nanvl(F.col(at).cast("double"), F.lit(None).cast("double")))
    return in_order(rows, "vehicle", "event_id", ["at"], gate_step(gate), "event_id long, at double", "last double", watermark=watermark)


def trailing_refuels(shifts: DataFrame, refuels: DataFrame, hours: int = 24, watermark: str = "1 hour") -> DataFrame:
    """(vehicle, start, n, litres, last_refuel_ts) of the refuels in [start - hours, start) of each shift: an interval join of two streams.

    Both sides carry a watermark, so that a refuel is forgotten when no shift can reach back to it, and a shift when no refuel
    can come before it; a shift without refuels comes out with 0 then. shifts: (vehicle, start); refuels: (vehicle,
    refuel_ts, litres). One row a vehicle and start is expected. On batches, the same rows.
    """
    s = shifts.select("vehicle", F.col("start").cast("timestamp").alias("start"))
    r = refuels.select(F.col("vehicle").alias("__v"), F.col("refuel_ts").cast("timestamp").alias("refuel_ts"), F.col("litres").cast("double").alias("litres"))
    if s.isStreaming:
        s, r = s.withWatermark("start", watermark), r.withWatermark("refuel_ts", watermark)
    near = (F.col("vehicle") == F.col("__v")) & (F.col("refuel_ts") >= F.col("start") - F.expr(f"INTERVAL {hours} HOURS")) & (F.col("refuel_ts") < F.col("start"))
    out = s.join(r, near, "leftOuter").groupBy("vehicle", "start").agg(F.count("refuel_ts").alias("n"), F.coalesce(F.sum("litres"), F.lit(0.0)).alias("litres"), F.max("refuel_ts").alias("last_refuel_ts"))
    return out.select("vehicle", "start", "n", "litres", "last_refuel_ts")


def dropped(query: StreamingQuery) -> int:
    """Rows that came later than the watermark and were dropped, over all batches that the query's progress still holds."""
    return sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"])
