"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Every text is cut into pieces of some bytes, so that a piece can't learn from the text itself, and all pieces are
compressed with either dictionary. The difference of the two sizes over their sum says which sort of text it resembles;
a logistic curve over that difference and the compressed size, fitted on labelled rows that the dictionaries have not
seen, makes it a probability.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import discard, remainder, shipped, written

#: Bounds of the sample that is learned from: labelled rows of either label, and bytes of their whole texts.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 16 << 20
#: Precision of what the curve is drawn towards (the share of good texts, and no slope): that of any number of texts, and of one's worth.
RIDGE, DRAWN = 0.02, 1.0
PIECE, DICTIONARY, LEVEL = 128, 112_640, 3


def pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE] for i in range(0, len(text), PIECE)]


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: list[float]

    def scorer(self):
        """A function from UTF-8 text to its score."""
        options = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
        with_good, with_bad = (zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None, **options).compress for d in (self.good, self.bad))

        def features(text: bytes) -> list[float]:
            cut = pieces(text)
            overhead = 9 * len(cut)  # of a frame and its block
            g, b = (max(1, sum(len(f(x)) for x in cut) - overhead) for f in (with_good, with_bad))
            d, r = (b - g) / (b + g), (g + b) / (2 * max(1, len(text)))
            sure = min(1.0, len(text) / 400)
            return [1.0, 10 * d * sure, 10 * d * (1 - sure), 20 * d * abs(d), r, r * r, sure]

        return features

    def score(self, features: list[float]) -> float:
        z = sum(a * b for a, b in zip(self.weights, features))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(good: list[str], bad: list[str], seed: int = 7) -> Model:
    """Dictionaries from two thirds of the texts of either sort, the curve from the rest. The fewer texts there are, the nearer the curve
    stays to the share of good ones, 0.5 if there are none at all.
    """
    rng = random.Random(seed)
    good, bad = sorted(good), sorted(bad)
    rng.shuffle(good), rng.shuffle(bad)
    prior = math.log((len(good) + 0.5) / (len(bad) + 0.5))
    part = lambda texts, held: [t.encode() for i, t in enumerate(texts) if (i % 3 == 1) == held]

    def dictionary(texts: list[bytes]) -> bytes:
        cut = [x for t in texts for x in pieces(t) if x]
        rng.shuffle(cut)
        size = max(1024, min(DICTIONARY, sum(map(len, cut)) // 8))
        try:
            return zstandard.train_dictionary(size, cut).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself serves
            return b"".join(cut)[:size]

    model = Model(dictionary(part(good, False)), dictionary(part(bad, False)), [])
    features = model.scorer()
    shown = [*part(good, True), *part(bad, True)]
    x = np.array([features(t) for t in shown]).reshape(len(shown), len(features(b"")))
    y = np.array([1.0] * len(part(good, True)) + [0.0] * len(part(bad, True)))
    aim = np.array([prior] + [0.0] * (x.shape[1] - 1))
    w, pull = aim.copy(), DRAWN / max(1, min(len(good), len(bad)))
    ridge = np.diag([pull] + [RIDGE + pull] * (x.shape[1] - 1))
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (y - p) - ridge @ (w - aim)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(len(w)), grad)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-9:
            break
    model.weights = [float(v) for v in w]
    return model


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from whole texts of labelled rows outside the held-out fold: at most ``sample_rows`` of either label, those with the least
    hash of their id, as long as their texts take ``sample_bytes`` together; one that would take more is passed over. Null labels, ids and texts aren't used; an id with
    several texts gives the least of them; an id with both labels counts for both.
    """
    marked = labels.select("doc_id", F.col("quality").alias("y")).where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (remainder(F.col("doc_id"), folds) != held)).distinct()
    # The sample is drawn by id alone, so that only its own texts leave their partitions.
    chosen = [marked.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows) for y in (0, 1)]
    chosen = docs.sparkSession.createDataFrame(chosen[0].union(chosen[1]).collect(), marked.schema)
    whole = docs.select("doc_id", "text").where("text is not null and text <> ''").join(F.broadcast(chosen), "doc_id")
    whole = written(whole.groupBy("doc_id", "y").agg(F.min("text").alias("t")), "labelled")
    left, kept = {0: sample_bytes, 1: sample_bytes}, []
    for r in whole.select("doc_id", "y", F.octet_length("t").alias("n"), F.xxhash64("doc_id").alias("h")).orderBy("h", "doc_id").collect():  # of the sample
        if r["n"] <= left[r["y"]]:
            left[r["y"]] -= r["n"]
            kept.append((r["doc_id"], r["y"]))
    kept = docs.sparkSession.createDataFrame(kept, marked.schema)
    sample = whole.join(F.broadcast(kept), ["doc_id", "y"], "left_semi").collect()
    discard(whole)
    good, bad = ([r["t"] for r in sample if r["y"] == y] for y in (1, 0))
    model = fit(good, bad)
    if good and bad:  # the sample has its own share of good rows; scores follow that of all
        n = {r["y"]: r["count"] for r in marked.groupBy("y").count().collect()}
        model.weights[0] += math.log(n[1] / n[0]) - math.log(len(good) / len(bad))
    return model


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``score``, 0 to 1, of the whole text; null and empty texts are scored as ''.

    A column named as the score gives way. One narrow stage, no shuffle; repeated rows get equal scores.
    """
    held = shipped(docs.sparkSession, model)
    source = docs.drop(score)
    names = source.columns
    inner = source.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(text)
    schema = StructType([*inner.schema, StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held()
        features = m.scorer()
        for b in batches:
            out = [m.score(features(t or b"")) for t in b.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], schema.names)

    return inner.mapInArrow(run, schema).toDF(*names, score)


def digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score and predicted (1 from ``threshold`` on). A null doc_id is not held out."""
    model = train(docs, labels)
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject, in their own columns."""
    return scored(docs, train(docs, labels), score="__score").where(F.col("__score") >= threshold).drop("__score")
