"""Whitening of embeddings by principal components, from singular values to full relative accuracy.

Every entry becomes a whole number, so that sums are exact. Each task reduces its centred rows to a triangle by blockwise
QR, and triangles are stacked and reduced again until one is left, whose Gram matrix is that of all rows; no covariance is ever
formed. The triangle, of the size of the dimensions alone, is made bidiagonal by Householder reflections; dqds finds the
singular values without subtractions that could cancel; each right singular vector of the bidiagonal comes from a twisted
factorisation, the stationary and progressive qd transforms joined where the remainder is least.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import shipped, written

#: Whole numbers of entries: floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000
#: Rows that are reduced at a time; triangles that a task stacks.
BLOCK, FAN = 4096, 32
EPS = np.finfo(float).eps
TINY = np.finfo(float).tiny
#: Starts that are tried for a vector of several like values.
ATTEMPTS = 8
#: Entries beyond this have no exact deviation; they are an error.
LARGEST = 1 << 40


# ---- the bidiagonal solver, on matrices of the size of the dimensions ----


def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v and beta of the reflection that leaves of x only its first entry."""
    v, norm = x.copy(), float(np.linalg.norm(x))
    if norm == 0.0:
        return v, 0.0
    v[0] += np.copysign(norm, x[0])
    return v, 2.0 / float(v @ v)


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of the upper bidiagonal B in a = U B V', and V."""
    a, n = a.copy(), a.shape[1]
    v = np.eye(n)
    for k in range(n):
        u, beta = reflector(a[k:, k])
        a[k:, k:] -= beta * np.outer(u, u @ a[k:, k:])
        if k < n - 2:
            w, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= beta * np.outer(a[k:, k + 1 :] @ w, w)
            v[:, k + 1 :] -= beta * np.outer(v[:, k + 1 :] @ w, w)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix, falling."""
    found: list[float] = []
    parts = [(diagonal.astype(float) ** 2, above.astype(float) ** 2, 0.0)]
    while parts:
        q, e, shifted = parts.pop()
        guess = 0.0
        while len(q):
            n = len(q)
            if n == 1:
                found.append(q[0] + shifted)
                break
            if len(cut := np.flatnonzero(e[: n - 1] <= EPS * EPS * (shifted + np.minimum(q[:-1], q[1:])))):
                # nothing holds these parts together
                k = int(cut[-1]) + 1
                parts.append((q[k:], e[k:], shifted))
                q, e, guess = q[:k], e[: k - 1], 0.0
                continue
            if n == 2:
                a, b, c = q[0], q[1], e[0]
                high = ((a + b + c) + np.sqrt(max((a + b + c) ** 2 - 4 * a * b, 0.0))) / 2
                low = a * (b / high) if high > 0 else 0.0
                found += [high + shifted, low + shifted]
                break
            while True:
                moved = _transform(q, e, guess)
                if moved is not None:
                    break
                guess = guess / 4 if guess > EPS * EPS * shifted and guess > TINY else 0.0
            q, e, low = moved
            shifted += guess
            # what can safely be taken off next: below the least diagonal of the transform, less what hangs on to it
            guess = 0.0 if low <= 0 else 0.98 * max(low - np.sqrt(low) * np.sqrt(e[-1]), 0.0) if e[-1] < low else 0.25 * low
    return np.sort(np.array(found))[::-1]


def _transform(q: np.ndarray, e: np.ndarray, shift: float):
    """One differential quotient-difference step with a shift; None if the shift was above the least value."""
    n = len(q)
    to_q, to_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    least = d
    for i in range(n - 1):
        if d < 0:
            return None
        to_q[i] = d + e[i]
        t = q[i + 1] / to_q[i] if to_q[i] > 0 else 0.0
        to_e[i] = e[i] * t
        d = d * t - shift if to_q[i] > 0 else q[i + 1] - shift
        least = min(least, d)
    if d < 0:
        return None
    to_q[n - 1] = d
    return to_q, to_e, least


def _twisted(q: np.ndarray, e: np.ndarray, value: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of the tridiagonal B'B less ``value``: the factors from above (l), from below (u), the remainders gamma and where they are least.

    B'B has diagonal q_i + e_(i-1) and beside it sqrt(q_i e_i)."""
    n = len(q)
    beside = np.sqrt(q[:-1] * e)
    full = q.copy()
    full[1:] += e
    # stationary: s_i carries what is left of q_i less the value, from above; progressive: p_i from below
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(max(n - 1, 0)), np.empty(max(n - 1, 0))
    small = EPS * EPS * max(float(full.max()), TINY)
    s[0] = -value
    for i in range(n - 1):
        pivot = s[i] + q[i]
        pivot = pivot if abs(pivot) > small else np.copysign(small, pivot)
        lower[i] = beside[i] / pivot
        s[i + 1] = s[i] * (e[i] / pivot) - value
    p[n - 1] = q[n - 1] - value
    for i in range(n - 2, -1, -1):
        pivot = p[i + 1] + e[i]
        pivot = pivot if abs(pivot) > small else np.copysign(small, pivot)
        upper[i] = beside[i] / pivot
        p[i] = p[i + 1] * (q[i] / pivot) - value
    gamma = s + p + value
    return lower, upper, gamma, int(np.argmin(np.abs(gamma)))


def singular_vectors(diagonal: np.ndarray, above: np.ndarray, values: np.ndarray, close: float = 1e-3) -> np.ndarray:
    """Right singular vectors of a bidiagonal matrix for falling squares of its singular values, as columns.

    Values nearer than ``close`` of the greatest are made orthogonal to each other, and found again from another start where
    little is left of one."""
    n = len(diagonal)
    q, e = diagonal.astype(float) ** 2, above.astype(float) ** 2
    sign = np.ones(n)
    for i in range(n - 1):  # entries of B'B beside the diagonal may be negative; their signs are moved to the vectors
        sign[i + 1] = sign[i] * (-1.0 if diagonal[i] * above[i] < 0 else 1.0)
    rng = np.random.default_rng(12)
    out = np.zeros((n, len(values)))
    group = 0
    for k, value in enumerate(values):
        if k and values[k - 1] - value > close * max(values[0], TINY):
            group = k
        lower, upper, _, at = _twisted(q, e, value)
        z = np.zeros(n)
        z[at] = 1.0
        for i in range(at - 1, -1, -1):
            z[i] = -lower[i] * z[i + 1]
        for i in range(at, n - 1):
            z[i + 1] = -upper[i] * z[i]
        z /= np.linalg.norm(z)
        before = out[:, group:k]
        for attempt in range(ATTEMPTS):
            size = np.linalg.norm(z)
            for _ in range(3):
                z = z - before @ (before.T @ z)
            left = np.linalg.norm(z)
            z /= left
            if left > 0.1 * size:
                break
            if attempt + 1 < ATTEMPTS:
                z = _solved(q, e, value, rng.standard_normal(n))
        out[:, k] = z
    return out * sign[:, None]


def _solved(q: np.ndarray, e: np.ndarray, value: float, right: np.ndarray) -> np.ndarray:
    """A step of inverse iteration by the twisted factors."""
    lower, upper, gamma, at = _twisted(q, e, value)
    n, x = len(q), right.copy()
    small = EPS * max(float(q.max()), TINY)
    beside = np.sqrt(q[:-1] * e)
    for i in range(at):
        x[i + 1] -= lower[i] * x[i]
    for i in range(n - 2, at - 1, -1):
        x[i] -= upper[i] * x[i + 1]
    kept = lambda y: y if abs(y) > small else np.copysign(small, y)
    for i in range(n):
        if i < at:
            x[i] = x[i] / kept(beside[i] / lower[i] if lower[i] else q[i] - value)
        elif i > at:
            x[i] = x[i] / kept(beside[i - 1] / upper[i - 1] if upper[i - 1] else q[i] - value)
    x[at] = x[at] / kept(gamma[at])
    for i in range(at - 1, -1, -1):
        x[i] -= lower[i] * x[i + 1]
    for i in range(at, n - 1):
        x[i + 1] -= upper[i] * x[i]
    return x / np.linalg.norm(x)


def principal(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of a triangle, falling, and its right singular vectors as columns, each with its largest
    entry positive."""
    size = float(np.abs(triangle).max(initial=0.0))
    if size == 0.0:
        return np.zeros(triangle.shape[1]), np.eye(triangle.shape[1])
    d, e, v = bidiagonal(triangle / size)
    d[np.abs(d) < EPS * EPS], e[np.abs(e) < EPS * EPS] = 0.0, 0.0
    values = dqds(d, e)
    # where the bidiagonal falls apart, but for rounding, each part has its own vectors
    cut = np.flatnonzero(np.abs(e) <= EPS * len(d) * np.sqrt(values[0]))
    vectors = np.zeros((len(d), len(d)))
    order, at = [], 0
    for end in [*(int(c) + 1 for c in cut), len(d)]:
        own = dqds(d[at:end], e[at : end - 1])
        part = singular_vectors(d[at:end], e[at : end - 1], own)
        for j, value in enumerate(own):
            vectors[at:end, len(order)] = part[:, j]
            order.append(value)
        at = end
    vectors = v @ vectors[:, np.argsort(-np.array(order), kind="stable")]
    largest = vectors[np.argmax(np.abs(vectors), axis=0), np.arange(len(d))]
    return values * size * size, vectors * np.where(largest < 0, -1.0, 1.0)


# ---- over tables ----


def _triangle(rows: np.ndarray) -> np.ndarray:
    """The square triangle of a QR of rows; fewer rows than columns are filled up by zeros."""
    d = rows.shape[1]
    r = np.linalg.qr(rows, mode="r")
    return r if len(r) == d else np.vstack([r, np.zeros((d - len(r), d))])


def whole(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key and x: the vectors without nulls and non-finite entries, as whole numbers. An empty vector has none and is dropped."""
    c = F.col(vector)
    good = F.coalesce(F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & (F.size(c) > 0)
    fits = F.forall(c, lambda x: F.abs(x.cast("double")) <= LARGEST / SCALE)
    # filters may be evaluated in any order, so that the error asks again whether the vector counts
    error = F.raise_error(F.lit(f"entries beyond {LARGEST // SCALE} have no exact deviation")).cast("array<bigint>")
    x = F.when(~good, None).when(fits, F.transform(c, lambda y: F.floor(SCALE * y.cast("double")) + OFFSET)).otherwise(error)
    return vectors.where(good).select(F.col(key).alias("key"), x.alias("x"))


def _matrix(b: pa.RecordBatch, at: int, d: int) -> np.ndarray:
    lists = b.column(at)
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(b), d)


def _sums(rows: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of rows and exact sums by dimension: a row a task, added by position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, np.zeros(d, np.int64)
        for b in batches:
            n += len(b)
            s += _matrix(b, 0, d).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([s.tolist()], pa.list_(pa.int64()))})

    parts = rows.select("x").mapInArrow(run, "n long, s array<long>")
    total = parts.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    s = np.zeros(d, np.int64)
    for r in total:
        s[r["at"]] = r["s"]
    return (total[0]["n"] if total else 0), s


def _reduced(rows: DataFrame, n: int, s: np.ndarray) -> np.ndarray:
    """The triangle of all centred rows."""
    d, spark = len(s), rows.sparkSession
    held = shipped(spark, s)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, r = held(), np.zeros((0, d))
        for b in batches:
            x = _matrix(b, 0, d)
            for i in range(0, len(x), BLOCK):
                r = _triangle(np.vstack([r, (n * x[i : i + BLOCK] - own) / n]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            for x in b.column(0).to_pylist():
                r = _triangle(np.vstack([r, np.frombuffer(x).reshape(d, d)]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"r": [r.tobytes()]})

    level = written(rows.select("x").mapInArrow(first, "r binary"), "triangles")
    while (count := level.count()) > FAN:
        level = written(level.repartition(-(-count // FAN)).mapInArrow(again, "r binary"), "triangles")
    r = np.zeros((0, d))
    for row in level.collect():  # FAN triangles at most
        r = _triangle(np.vstack([r, np.frombuffer(row["r"]).reshape(d, d)]))
    return r


def whiten(vectors: DataFrame, components: int = 8, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per vector and component: key, component (int, from 1, by falling variance), n, deviation, whitened, explained and
    identity_error, the last measured over the whitened values of all vectors.

    Vectors that are null, empty or hold null or non-finite entries are dropped, and so are vectors of another length than the most
    frequent (the longest of those). Components whose variance is zero but for rounding are not given: equal vectors have none, nor
    has a single one. Repeated rows count each; an empty table gives no rows; other columns are ignored. Three passes over the vectors, each
    narrow; what tasks give back is of the size of the dimensions. Entries too large for exact deviations are an error.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, key, vector)
    lengths = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    schema = StructType([rows.schema["key"], *StructType.fromDDL("component int, n long, deviation long, whitened double, explained double, identity_error double")])
    if lengths is None:
        return spark.createDataFrame([], schema).withColumnRenamed("key", key)
    d = lengths["d"]
    rows = rows.where(F.size("x") == d)
    n, s = _sums(rows, d)
    values, axes = principal(_reduced(rows, n, s))
    total = float(values.sum())
    given = int(np.count_nonzero(values > (EPS * max(n, d)) ** 2 * total)) if total > 0 else 0
    given = min(given, components)
    scale = axes[:, :given] / np.sqrt(values[:given] / n)
    held = shipped(spark, (s, scale))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = held()
        sums, gram = np.zeros(given), np.zeros((given, given))
        for b in batches:
            y = ((n * _matrix(b, 0, d) - own) / n) @ w
            sums += y.sum(axis=0)
            gram += y.T @ y
        yield pa.RecordBatch.from_pydict({"v": pa.array([np.concatenate([sums, gram.ravel()]).tolist()], pa.list_(pa.float64()))})

    error = 0.0
    if given:
        parts = rows.select("x").mapInArrow(spread, "v array<double>")
        added = np.zeros(given + given * given)
        for r in parts.select(F.posexplode("v").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v")).collect():
            added[r["at"]] = r["v"]
        mean = added[:given] / n
        error = float(np.abs(added[given:].reshape(given, given) / n - np.outer(mean, mean) - np.eye(given)).max())
    explained = values[:given] / total if given else values[:0]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = held()
        for b in batches:
            wide = n * _matrix(b, 1, d) - own
            far = np.abs(wide.astype(float)).max(initial=0.0)
            if far * far * d < 2**62:
                deviation = (wide * wide).sum(axis=1)
            else:
                deviation = np.array([sum(int(x) ** 2 for x in r) for r in wide], object)
            y = (wide / n) @ w
            size = len(b)
            at = np.repeat(np.arange(size), given)
            columns = [b.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, given + 1, dtype=np.int32), size)), pa.array(np.full(len(at), n, np.int64)), pa.array(np.repeat(deviation, given).tolist(), pa.int64())]
            columns += [pa.array(y.ravel()), pa.array(np.tile(explained, size)), pa.array(np.full(len(at), error))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(project, schema).withColumnRenamed("key", key)


def digest(vectors: DataFrame) -> DataFrame:
    """The first eight components of every vector; see ``whiten``."""
    return whiten(vectors)
