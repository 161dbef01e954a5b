"""Hidden Markov language model over words.

A word falls into one of BUCKETS classes by its crc32; a latent state emits classes, and a class emits its words by their
corpus counts, so that the model knows every word of the corpus while its matrices have a fixed size:

    P(w_1 .. w_n, end) = sum over state paths of prod A[z_{i-1}, z_i] * E[z_i, class(w_i)] * P(w_i | class(w_i))

The last factor doesn't depend on the path. Baum-Welch learns A and E from all training texts: each task runs scaled
forward and backward recursions over its texts and gives the expected counts it gathered; Spark adds those up by class.
The likelihood of a text is exact, by the scaled forward recursion over the whole text.

Texts are coded once, in blocks of a bounded number of words: a block has a dictionary of its own, its texts are numbers
in that dictionary, and only dictionaries are shuffled to count words and to bring the counts back.
"""

from __future__ import annotations

import itertools
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, IntegerType, LongType, StructField, StructType

from .common import LOWER, remainder, shipped, written

STATES, BUCKETS = 6, 16_384
#: Baum-Welch goes on until a round's log likelihood rises by less than this share, or for so many rounds.
GAIN, ROUNDS = 0.005, 8
BLOCK_WORDS = 1_000_000
#: Words in flight in a task's recursions, whose messages are in memory at once; words and end from which a text is walked
#: in spans, side by side, and those of a span.
FLIGHT, LONG, SPAN = 200_000, 2000, 256


def _encode(docs: DataFrame, key: str, text: str, block_words: int) -> DataFrame:
    """Rows of texts (block, key, held, ids, classes) and of dictionaries (block, word, lid, n: uses in training texts)."""
    source = docs.select(F.col(key).alias("key"), F.coalesce(remainder(F.col(key), 7) == 2, F.lit(False)).alias("held"), F.col(text).alias("text"))
    schema = StructType(
        [StructField("block", LongType()), source.schema["key"], StructField("held", BooleanType()), StructField("ids", BinaryType()), StructField("classes", BinaryType())]
        + [StructField("word", BinaryType()), StructField("lid", IntegerType()), StructField("n", LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        part, numbers = TaskContext.get().partitionId(), itertools.count()
        key_type = None

        def batch(**cols):
            n = len(next(iter(cols.values())))
            types = [pa.int64(), key_type, pa.bool_(), pa.binary(), pa.binary(), pa.binary(), pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(cols[f], t) if f in cols else pa.nulls(n, t) for f, t in zip(schema.names, types)], schema.names)

        def fresh():
            ids: defaultdict = defaultdict(itertools.count().__next__)
            return (part << 32) + next(numbers), ids, [], [0]

        def flush(block, ids, rows, _):
            vocabulary = list(ids)
            classes = np.fromiter((zlib.crc32(w) % BUCKETS for w in vocabulary), np.uint16, len(vocabulary))
            uses = np.zeros(len(vocabulary), np.int64)
            for _, held, x in rows:
                if not held:
                    uses += np.bincount(x, minlength=len(vocabulary))
            for i in range(0, len(rows), 500):
                cut = rows[i : i + 500]
                yield batch(block=[block] * len(cut), key=[r[0] for r in cut], held=[r[1] for r in cut], ids=[pack(r[2].tobytes()) for r in cut], classes=[pack(classes[r[2]].tobytes()) for r in cut])
            for i in range(0, len(vocabulary), 50_000):
                cut = vocabulary[i : i + 50_000]
                yield batch(block=[block] * len(cut), word=cut, lid=np.arange(i, i + len(cut), dtype=np.int32), n=uses[i : i + len(cut)])

        state = fresh()
        for b in batches:
            key_type = b.schema.types[0]
            for k, held, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary()).to_pylist()):
                found = (raw or b"").translate(LOWER).split()
                _, ids, rows, size = state
                rows.append((k, held, np.fromiter(map(ids.__getitem__, found), np.int32, len(found))))
                size[0] += len(found) + 1
                if size[0] >= block_words:
                    yield from flush(*state)
                    state = fresh()
        if state[2]:
            yield from flush(*state)

    return written(source.mapInArrow(run, schema), "hmm-texts")


def _cut(text: np.ndarray) -> int:
    return 1 if len(text) < LONG else len(text) // SPAN + 1


def _spans(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """All texts, each with the end symbol and the long ones in spans, as many at once as FLIGHT allows, of like length:
    (text, number of the span in it, symbols by time and span, active spans by time). A text's spans may be apart."""
    count = [_cut(t) for t in texts]
    text = np.repeat(np.arange(len(texts)), count)
    number = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    whole = np.array([len(t) + 1 for t in texts], np.int64)[text]
    size = np.where(np.array(count)[text] == 1, whole, np.minimum(whole - number * SPAN, SPAN)) if len(text) else whole
    order = np.argsort(-size, kind="stable")
    i = 0
    while i < len(order):
        longest = int(size[order[i]])
        cut = order[i : i + max(1, FLIGHT // longest)]
        i += len(cut)
        x = np.full((longest, len(cut)), BUCKETS, np.int32)
        for c, k in enumerate(cut):
            piece = texts[text[k]][number[k] * SPAN : number[k] * SPAN + size[k]]
            x[: len(piece), c] = piece
        yield text[cut], number[cut], x, (size[cut][None, :] > np.arange(longest)[:, None]).sum(1).tolist()


def _entries(texts: list[np.ndarray], start, move, emit, backward: bool):
    """For texts of several spans: of each span the distributions over its first states and over the last ones of the span
    before (zeros for the first span), the log likelihoods of whole texts, and, if asked, what follows each span (its
    likelihood from each last state, up to a factor).

    A span is a matrix from first to last states; those of all spans are found side by side, then multiplied in order, so
    a long text costs no more steps than its spans are long. emit: by state and class.
    """
    k, some = len(start), [t for t in range(len(texts)) if _cut(texts[t]) > 1]
    first, after, ll, matrices = {}, {}, {}, {}
    for text, number, x, active in _spans([texts[t] for t in some]):
        m, scale = np.zeros((k, k, len(text))), np.zeros(len(text))
        m[np.arange(k), np.arange(k)] = emit[:, x[0]]
        for t in range(1, len(x)):
            n = active[t]
            m[:, :, :n] = np.matmul(move.T, m[:, :, :n]) * emit[:, x[t, :n]]
            if t % 8 == 0 or t + 1 == len(x) or active[t + 1] < n:  # before values leave the range of numbers
                top = m[:, :, :n].max((0, 1))
                m[:, :, :n] /= top
                scale[:n] += np.log(top)
        matrices.update({(some[a], int(b)): (m[:, :, c], scale[c]) for c, (a, b) in enumerate(zip(text, number))})
    for t in some:
        a, before, total, last = start, np.zeros(k), 0.0, _cut(texts[t])
        for i in range(last):
            m, scale = matrices[t, i]
            first[t, i] = a, before
            a = a @ m
            total += scale + np.log(a.sum())
            before = a / a.sum()
            a = before @ move
        ll[t] = total
        b = np.ones(k)
        for i in range(last - 1, -1, -1) if backward else ():
            after[t, i] = b
            b = move @ (matrices[t, i][0] @ b)
            b /= b.sum()
    return first, after, ll


def log_likelihood(texts: list[np.ndarray], start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each sequence of classes and its end. emit: by class and state."""
    out, emit = np.zeros(len(texts)), np.ascontiguousarray(emit.T)
    for t, total in _entries(texts, start, move, emit, False)[2].items():
        out[t] = total
    short = np.array([t for t in range(len(texts)) if _cut(texts[t]) == 1], np.int64)
    for text, _, x, active in _spans([texts[t] for t in short]):
        a = start[:, None] * emit[:, x[0]]
        ll = np.zeros(len(text))
        for t, n in enumerate(active):
            if t:
                a = (move.T @ a[:, :n]) * emit[:, x[t, :n]]
            s = a.sum(0)
            a /= s
            ll[:n] += np.log(s)
        out[short[text]] = ll
    return out


def expected_counts(texts: list[np.ndarray], start, move, emit, to_start, to_move, to_emit) -> float:
    """Adds the texts' expected counts to the last three; gives their log likelihood. Memory is that of FLIGHT symbols and
    of a matrix a span of the long texts."""
    total, k, emit = 0.0, len(start), np.ascontiguousarray(emit.T)
    first, after, _ = _entries(texts, start, move, emit, True)
    for text, number, x, active in _spans(texts):
        count, span = len(text), len(x)
        begin, beta, before = np.repeat(start[:, None], count, 1), np.ones((k, count)), np.zeros((k, count))
        for c, at in enumerate(zip(text.tolist(), number.tolist())):
            if at in first:
                (begin[:, c], before[:, c]), beta[:, c] = first[at], after[at]
        alpha, scale = np.zeros((span, k, count)), np.ones((span, count))
        ends = np.empty((k, count))
        for t, n in enumerate(active):
            a = (begin[:, :n] if t == 0 else move.T @ alpha[t - 1, :, :n]) * emit[:, x[t, :n]]
            scale[t, :n] = s = a.sum(0)
            np.divide(a, s, out=alpha[t, :, :n])
            ends[:, :n] = alpha[t, :, :n]
        total += float(np.log(scale).sum())
        beta /= (ends * beta).sum(0)
        for t in range(span - 1, 0, -1):
            n = active[t]
            w = emit[:, x[t, :n]]
            w *= beta[:, :n]
            w /= scale[t, :n]
            to_move += move * (alpha[t - 1, :, :n] @ w.T)
            alpha[t, :, :n] *= beta[:, :n]
            beta[:, :n] = move @ w
        to_move += move * (before @ (emit[:, x[0]] * beta / scale[0]).T)
        alpha[0] *= beta
        to_start += alpha[0][:, number == 0].sum(1)
        flat = x.ravel()
        for z in range(k):  # spans that have ended weigh nothing: alpha is 0 there
            to_emit[:, z] += np.bincount(flat, weights=alpha[:, z].ravel(), minlength=BUCKETS + 1)
    return total


def _classes(column: pa.Array) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(unpack(r), np.uint16) for r in column.to_pylist()]


def _round(texts: DataFrame, start, move, emit, states: int):
    """One Baum-Welch round: the sums of expected counts over all training texts."""
    params = shipped(texts.sparkSession, (start, move, emit))
    schema = StructType.fromDDL("row int, " + ", ".join(f"z{z} double" for z in range(states)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pi, a, e = params()
        to_start, to_move, to_emit, total, waiting = np.zeros(states), np.zeros((states, states)), np.zeros((BUCKETS + 1, states)), 0.0, []
        size = seen = 0
        for b in batches:
            for x in _classes(b.column(0)):
                waiting.append(x)
                size, seen = size + len(x) + 1, seen + 1
                if size >= 8 * FLIGHT:
                    total += expected_counts(waiting, pi, a, e, to_start, to_move, to_emit)
                    waiting, size = [], 0
        if waiting:
            total += expected_counts(waiting, pi, a, e, to_start, to_move, to_emit)
        if seen:
            table = np.vstack([to_emit, to_move, to_start[None], np.array([[total] + [0.0] * (states - 1)])])
            rows = np.flatnonzero(table.any(1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(rows), *(pa.array(table[rows, z]) for z in range(states))], schema.names)

    counted = texts.where("not held").select("classes").mapInArrow(run, schema)
    table = np.zeros((BUCKETS + 1 + states + 2, states))
    for r in counted.groupBy("row").agg(*(F.sum(f"z{z}").alias(f"z{z}") for z in range(states))).collect():  # a fixed number of rows
        table[r[0]] = r[1:]
    return table[: BUCKETS + 1], table[BUCKETS + 1 : BUCKETS + 1 + states], table[-2], table[-1, 0]


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN, block_words: int = BLOCK_WORDS, history: list | None = None) -> DataFrame:
    """Per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are split at ASCII white space after lower-casing A-Z; each text ends with one end token. Rows whose
    crc32(key as text) mod 7 is 2 are held out; a null key is not. Null and empty texts have the end token only. Without
    training rows the model is uniform over classes. base_score: unigram log10 probability with one added to each count;
    score: log10 probability under the model. Repeated rows count and are scored each. history: gets the training log
    likelihood of each round.
    """
    spark = docs.sparkSession
    coded = _encode(docs, key, text, block_words)
    texts = coded.where("ids is not null").select("block", "key", "held", "ids", "classes")
    w = Window.partitionBy("word")
    # One row for each word of each block: as many as blocks even for the most frequent word.
    words = coded.where("word is not null").select("block", "word", "lid", "n")
    words = words.select("block", "lid", F.sum("n").over(w).alias("c"), (F.row_number().over(w.orderBy("block")) == 1).alias("once"), F.pmod(F.crc32("word"), F.lit(BUCKETS)).cast("int").alias("class"))
    words = written(words, "hmm-words")
    uses, kinds = np.zeros(BUCKETS), np.zeros(BUCKETS)
    once = words.where("once and c > 0").groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    for r in once.collect():  # BUCKETS rows at most
        uses[r["class"]], kinds[r["class"]] = r["c"], r["v"]
    ends = texts.where("not held").count()
    n_train, n_kinds = int(uses.sum()) + ends, int(kinds.sum()) + (ends > 0)

    rng = np.random.default_rng(11)
    known = np.append(uses, ends) + 0.5
    known /= known.sum()
    emit = known[:, None] * np.exp(0.6 * rng.standard_normal((BUCKETS + 1, states)))
    emit[BUCKETS] = known[BUCKETS]
    emit /= emit.sum(0)
    move = np.full((states, states), 0.03 / states) + 0.97 * np.eye(states)
    start = np.full(states, 1 / states)
    last = None
    for _ in range(rounds if ends else 0):
        e, m, s, total = _round(texts, start, move, emit, states)
        if history is not None:
            history.append(total)
        if last is not None and total - last < gain * abs(last):
            break
        last = total
        emit = (e + 2.0 * known[:, None]) / (e + 2.0 * known[:, None]).sum(0)
        move = (m + 0.1) / (m + 0.1).sum(1, keepdims=True)
        start = (s + 0.1) / (s + 0.1).sum()

    in_class = -np.log10(uses + kinds + 1.0)
    params = shipped(spark, (start, move, emit, in_class))
    schema = StructType([StructField("key", texts.schema["key"].dataType), *StructType.fromDDL("held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")])
    base = float(np.log10(n_train + 1.0 * (n_kinds + 1)))
    end_use = ends

    def run(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        pi, a, e, within = params()
        lid, c, cls = (dictionary.column(n).to_numpy() for n in ("lid", "c", "class"))
        of_class, counts = np.zeros(len(lid), np.int32), np.zeros(len(lid), np.int64)
        of_class[lid], counts[lid] = cls, c
        plain = np.log10(counts + 1.0)
        inside, seen = plain + within[of_class], (counts > 0).astype(np.int64)
        unpack = zstandard.ZstdDecompressor().decompress
        ids = [np.frombuffer(unpack(r), np.int32) for r in block.column("ids").to_pylist()]
        chain = log_likelihood([of_class[x] for x in ids], pi, a, e) / np.log(10) if ids else []
        n = [len(x) + 1 for x in ids]
        return pa.table(
            [
                block.column("key").combine_chunks(),
                block.column("held").combine_chunks(),
                pa.array(n, pa.int64()),
                pa.array([int(seen[x].sum()) + (end_use > 0) for x in ids], pa.int64()),
                pa.array([n_train] * len(ids), pa.int64()),
                pa.array([float(plain[x].sum() + np.log10(end_use + 1.0) - k * base) for x, k in zip(ids, n)], pa.float64()),
                pa.array([float(s + inside[x].sum()) for x, s in zip(ids, chain)], pa.float64()),
            ],
            schema.names,
        )

    out = texts.select("block", "key", "held", "ids").groupBy("block").cogroup(words.select("block", "lid", "c", "class").groupBy("block")).applyInArrow(run, schema)
    return out.withColumnRenamed("key", key)
