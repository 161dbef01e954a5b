"""Ranked lexical search for many items at once, by masks of matched terms.

Texts are cut once. Of every document a row is written that has its number of terms and, of the items' terms, which it
holds and how often: from it come the corpus counts and, block by block, the search. In a block, each item's documents
are given a mask, bit by bit from the terms' postings, of which of its terms they hold. All documents of a mask share an
upper bound, the sum of the most that each of its terms can give within the block. The distinct masks are evaluated from
the highest bound down until the bound is below the item's k-th best score so far in the task; from there on no document
can enter. Scores are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from .common import WORDS, discard, shipped, written

#: Bytes of the terms of items that are searched for in one pass; more go in several.
PASS_BYTES = 8 << 20
#: Documents of a block, and postings of one at most (a document's are kept together).
BLOCK, POSTINGS = 8192, 2_000_000
#: Parts in which an item's candidates are ranked before they meet.
PARTS = 64
ONE, STEP, SHARE = 1_000_000_000, 1000, 20


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters beyond ASCII; only A-Z lower-cased."""
    return (text or "").encode().translate(WORDS).split()


def _items(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term), distinct."""
    kept = items.select(F.col(item_id).alias("item"), F.col(text).alias("text"))
    schema = StructType([kept.schema["item"], StructField("term", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(t))) for t in b.column(1).to_pylist()]
            at = np.repeat(np.arange(len(found)), [len(f) for f in found])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([w.decode() for f in found for w in f], pa.string())], ["item", "term"])

    return kept.mapInArrow(run, schema).distinct()


def _postings(docs: DataFrame, vocabulary: list[str], key: str, text: str) -> DataFrame:
    """Per row of ``docs``: key, n (its terms, with repeats), term (indexes into the vocabulary) and tf, aligned."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType.fromDDL("n long, term array<int>, tf array<int>")
    schema = StructType([source.schema["key"], *schema])
    held = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w.encode(): i for i, w in enumerate(held())}
        for b in batches:
            sizes, which, counts = [], [], []
            for t in b.column(1):
                seq = terms(t.as_py())
                sizes.append(len(seq))
                at, tf = np.unique(np.fromiter((i for i in map(number.get, seq) if i is not None), np.int32), return_counts=True)
                which.append(at)
                counts.append(tf.astype(np.int32))
            offsets = pa.array(np.cumsum([0, *(len(w) for w in which)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.array([], np.int32))) for x in (which, counts)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], schema.names)

    return source.mapInArrow(run, schema)


class Best:
    """The k best (score, key) so far: highest score first, then null keys, then by key."""

    def __init__(self, k: int, like: np.ndarray):
        self.k, self.score, self.key, self.given = k, np.empty(0, np.int64), like[:0], np.empty(0, bool)
        self.least = 1  # a score below it can't enter

    def add(self, score: np.ndarray, key: np.ndarray, given: np.ndarray) -> None:
        enter = score >= self.least
        score, key, given = (np.concatenate(p) for p in zip((self.score, self.key, self.given), (score[enter], key[enter], given[enter])))
        order = np.lexsort((key, given, -score))[: self.k]
        self.score, self.key, self.given = score[order], key[order], given[order]
        if len(order) == self.k:
            self.least = max(1, int(self.score[-1]))


def search_block(best: Best, key: np.ndarray, given: np.ndarray, m: np.ndarray, postings: list[tuple[np.ndarray, np.ndarray]], weight: np.ndarray) -> int:
    """Puts a block's documents to ``best`` for one item. postings: of each of the item's terms the documents, as indexes,
    and tf; weight: of each. Gives the number of documents that were evaluated."""
    docs, k = len(key), len(weight)
    mask = np.zeros((docs, (k + 63) // 64), np.uint64)
    tf = np.zeros((k, docs), np.int64)
    most = np.zeros(k, np.int64)
    for j, (at, times) in enumerate(postings):
        if len(at):
            mask[at, j // 64] |= np.uint64(1 << (j % 64))
            tf[j, at] = times
            high = int(times.max())
            most[j] = weight[j] * (ONE * high // (STEP * high + SHARE * int(m[at].min())))
    matched = np.flatnonzero(mask.any(axis=1))
    if not len(matched):
        return 0
    if mask.shape[1] == 1:
        masks, group = np.unique(mask[matched, 0], return_inverse=True)
        masks = masks[:, None]
    else:
        masks, group = np.unique(mask[matched], axis=0, return_inverse=True)
    bits = (masks[:, np.arange(k) // 64] >> (np.arange(k) % 64).astype(np.uint64)) & np.uint64(1)
    bound = bits.astype(np.int64) @ most
    order = np.argsort(-bound, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    by_mask = matched[np.argsort(place[group.reshape(-1)], kind="stable")]  # documents, those of the highest mask first
    ends = np.cumsum(np.bincount(place[group.reshape(-1)], minlength=len(order)))
    at = done = 0
    while at < len(order) and bound[order[at]] >= best.least:
        # whole masks, of about as many documents as were done before
        upto = min(int(np.searchsorted(ends, done + max(best.k, done))) + 1, len(order))
        upto = min(upto, int(np.searchsorted(-bound[order], -best.least, side="right")))
        chosen = by_mask[done : ends[upto - 1]]
        held = tf[:, chosen]
        score = (weight[:, None] * (ONE * held // (STEP * held + SHARE * m[chosen]))).sum(axis=0)
        best.add(score, key[chosen], given[chosen])
        at, done = upto, int(ends[upto - 1])
    return done


def _candidates(found: DataFrame, plan: tuple, k: int, total: int, length: int) -> DataFrame:
    """Per task and item its k best documents: part, item (a number), key, score."""
    held = shipped(found.sparkSession, plan)
    schema = StructType([StructField("part", IntegerType()), StructField("item", IntegerType()), StructField("key", found.schema["key"].dataType), StructField("score", LongType())])
    text = isinstance(found.schema["key"].dataType, StringType)
    types = [pa.int32(), pa.int32(), None, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        vocabulary, items = held()  # number of terms; per item its terms and weights
        best: dict[int, Best] = {}
        kind = None

        def block(rows: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(rows).combine_chunks()
            raw = t["key"]
            given = raw.is_valid().to_numpy()
            key = np.array(raw.fill_null("").to_pylist(), object) if text else raw.fill_null(0).to_numpy()
            n = t["n"].to_numpy()
            m = np.array([50 + 50 * int(x) * total // length for x in n], np.int64) if length else np.full(len(n), 50, np.int64)
            lists = t["term"].combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            counts = t["tf"].combine_chunks()
            counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
            term, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy()
            doc = np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy()))
            order = np.argsort(term, kind="stable")
            begins = np.searchsorted(term[order], np.arange(vocabulary + 1))
            doc, tf = doc[order], tf[order].astype(np.int64)
            for i, (which, weight) in enumerate(items):
                search_block(best.setdefault(i, Best(k, key)), key, given, m, [(doc[begins[x] : begins[x + 1]], tf[begins[x] : begins[x + 1]]) for x in which], weight)

        rows, size, postings = [], 0, 0
        for b in batches:
            kind = b.schema.field("key").type
            at = 0
            offsets = np.concatenate([[0], np.cumsum(b.column(b.schema.get_field_index("term")).value_lengths().to_numpy())]) if len(b) else [0]
            while at < len(b):
                upto = min(at + BLOCK - size, len(b), max(at + 1, int(np.searchsorted(offsets, offsets[at] + POSTINGS - postings, side="right")) - 1))
                rows.append(b.slice(at, upto - at))
                size, postings, at = size + upto - at, postings + int(offsets[upto] - offsets[at]), upto
                if size >= BLOCK or postings >= POSTINGS or at < len(b):
                    block(rows)
                    rows, size, postings = [], 0, 0
        if rows:
            block(rows)
        part = TaskContext.get().partitionId() % PARTS
        for i, b in best.items():
            if len(b.score):
                keys = pa.array([x if g else None for x, g in zip(b.key.tolist(), b.given)], kind)
                whole = [pa.array([part] * len(keys), types[0]), pa.array([i] * len(keys), types[1]), keys, pa.array(b.score, types[3])]
                yield pa.RecordBatch.from_arrays(whole, schema.names)

    return found.mapInArrow(run, schema)


def search(docs: DataFrame, items: DataFrame, k: int = 50, key: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", pass_bytes: int = PASS_BYTES) -> DataFrame:
    """item_id, rank (int, from 1), key and score: the k documents of highest score above 0 of each item, equal scores by
    ascending key.

    key is of an integer type or a string. Null and empty texts have no terms: such documents are never found, such items
    find nothing. Rows of items with one id are one item, null ids too; repeated rows of ``docs`` are ranked each, a null key before others
    of its score. Empty tables give no rows; other columns are ignored. Items are searched for in as many passes as keep
    the terms of one below ``pass_bytes``, which is what is broadcast; an item's own terms pass whole. Candidates of
    tasks are ranked in parts first, so that no task ranks more than k rows a part.
    """
    spark = docs.sparkSession
    if not isinstance(docs.schema[key].dataType, (LongType, IntegerType, ShortType, ByteType, StringType)):
        raise TypeError(f"{key} has type {docs.schema[key].dataType.simpleString()}; integers and strings are ranked")
    wanted = written(_items(items, item_id, item_text), "search-items")
    size = wanted.agg(F.sum(F.octet_length("term") + 24)).first()[0] or 0
    passes = 1 + int(size) // pass_bytes
    dealt = wanted.withColumn("pass", F.pmod(F.xxhash64("item"), F.lit(passes)))
    out = None
    for p in range(passes):
        found = _search(spark, docs, dealt.where(F.col("pass") == p).select("item", "term"), k, key, text)
        out = found if out is None else out.unionAll(found)
    discard(wanted)
    return out.withColumnsRenamed({"item": item_id, "key": key}) if item_id != key else out.withColumnRenamed("item", item_id)


def _search(spark, docs: DataFrame, wanted: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """One pass, written: item, rank, key and score."""
    pairs = wanted.collect()  # bounded by the bytes of a pass
    vocabulary = sorted({r["term"] for r in pairs})
    number = {w: i for i, w in enumerate(vocabulary)}
    found = written(_postings(docs, vocabulary, key, text), "search-postings")
    total, length = found.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = found.select(F.explode("term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = df.select("term", F.floor(1000 * F.log((2.0 * total + 2) / (2.0 * F.col("df") + 1))).alias("w"))
    weight = {r["term"]: r["w"] for r in weights.collect()}  # of the terms of this pass
    of: dict = {}
    for r in pairs:
        i = number[r["term"]]
        if weight.get(i, 0) > 0:  # others add nothing to a score
            of.setdefault(r["item"], []).append(i)
    ids = list(of)
    plan = len(vocabulary), [(np.array(sorted(of[i]), np.int64), np.array([weight[x] for x in sorted(of[i])], np.int64)) for i in ids]
    best = _candidates(found, plan, k, total, length)
    order = [F.desc("score"), F.asc("key")]
    for by in (["item", "part"], ["item"]):
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    names = spark.createDataFrame(list(enumerate(ids)), StructType([StructField("number", IntegerType()), wanted.schema["item"]]))
    named = best.withColumnRenamed("item", "number").join(F.broadcast(names), "number")
    out = written(named.select("item", F.col("rank").cast("int").alias("rank"), "key", "score"), "search-best")
    discard(found)
    return out
