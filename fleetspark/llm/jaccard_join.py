"""Exact Jaccard self-join of texts on word n-grams by partition of the universe.

A text's set holds the 64-bit hashes of its n-grams. Two sets of sizes a and b with similarity t differ in at most
H = (1-t)/(1+t) * (a+b) elements. Sizes fall into bands, each 1/t wide, so partners stand in one band or in neighbouring
ones; a band's instance holds its own sets and those of the band below. An instance cuts the universe into a little more
than H+1 segments. As H differences touch H segments at most, of the segments where a set has elements, all but H are
equal in its partner; so a set with more than H such segments finds every partner by a segment's exact hash.

Cost-based allocation keeps the index small and free of hot entries:
  tier 0 leaves out elements known to be very frequent, which only makes segments differ less;
  tier 1 takes all elements, of sets that have too few segments with elements in tier 0;
  tier 2 takes, of sets that fail in tier 1 too, half as many segments with all one-deletion neighbours: there some
  segment differs by one element at most, so equal segments or neighbours meet, empty ones included.
A pair with one set that succeeds in a tier is found there; a pair without one goes on to the next tier.

Texts are cut and hashed once: their signatures travel in packed blocks by hash bucket, with their keys and sizes beside
them; a bucket's task finds the signatures that several sets share. Of each such run the sets are first compared with one
leader. Members of a run that the links found so far don't connect are looked at in blocks of BLOCK by BLOCK members: parity
sketches give a lower bound of how much two sets differ, and a task gives no pairs but a star for each group of members
that the bound leaves together, so its output is linear. Sets so connected are brought together in blocks again, compared
exactly on the whole sets, and each task gives a spanning forest of the links it finds. No pair that meets in a run and
isn't connected yet is left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from fleetspark.operators.graph import components, contracted

from .common import LOWER, bounded, discard, shipped, written

#: Similarity as a fraction, and words of an n-gram.
NUM, DEN, N = 75, 100, 5
#: Signatures of a bucket, buckets at least, and signatures that a task packs at once; members of small runs in a group.
PER_BUCKET, BUCKETS, PACKED, TOGETHER = 1_000_000, 256, 1_000_000, 20_000
#: Members of a run or of a group of candidates that a task compares at once, all with all or with as many others; bytes of
#: their sketches and sets, so that blocks of long texts have fewer members. Rows that move go down as blocks grow.
BLOCK, HELD = 2048, 64 << 20
#: Pairs that are sent to their sets at once, and passes at most over more of them, beyond which sets are shuffled by both ends.
PAIRS, PASSES = 1_300_000, 4
#: Sample from which frequent elements are learned: rows, how many of them share an element, elements kept at most.
SAMPLE, OFTEN, FREQUENT = 20_000, 10, 200_000
#: Bits of a sketch at least; it has two a shingle, up to a power of two.
SKETCH = 256
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes; one to one."""
    x = (x ^ (x >> U(33))) * U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def _salt(seed: int) -> np.uint64:
    return U(seed * 0xD6E8FEB86659FD93 & (1 << 64) - 1)


class _WordHashes(dict):
    def __missing__(self, w):
        if len(self) > 200_000:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingles(raw: bytes | None, hashes: dict, n: int = N) -> np.ndarray:
    """Sorted distinct hashes of the text's n-grams; of fewer words, the hash of all; of none, nothing."""
    words = (raw or b"").translate(LOWER).split()
    if not words:
        return np.empty(0, U)
    w = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(w) < n:
        h = np.array([len(w)], U)
        for x in w:
            h = _mix(h * U(0x9E3779B97F4A7C15) + x)
        return h
    h = w[: len(w) - n + 1]
    for k in range(1, n):
        h = h * U(0x9E3779B97F4A7C15) + w[k : len(w) - n + 1 + k]
    return np.unique(_mix(h))


def sketch(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements by class. Two sketches differ in no more bits than their sets in elements; the
    halves of one, joined by exclusive or, are the sketch of half the width."""
    width = max(SKETCH, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((_mix(s) & U(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def set_id(s: np.ndarray) -> int:
    """A signed 64-bit name of the set."""
    x = _mix(np.array([len(s)], U) + s.sum(dtype=U, keepdims=True) * U(0x9E3779B97F4A7C15) + _mix(s ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U))
    return int(x.view(np.int64)[0])


def bands(limit: int, num: int = NUM, den: int = DEN) -> list[tuple[int, int]]:
    """(least, greatest) size of each band up to ``limit``."""
    out, low = [], 1
    while low <= limit:
        high = low * den // num
        out.append((low, high))
        low = high + 1
    return out


class Signatures:
    """Of sets, by band and tier. frequent: sorted hashes that tier 0 leaves out."""

    def __init__(self, frequent: np.ndarray, num: int = NUM, den: int = DEN):
        self.frequent, self.num, self.den = frequent, num, den
        self.bands = bands(1 << 40, num, den)
        self.highs = [h for _, h in self.bands]

    def differences(self, a: int, b: int) -> int:
        return (self.den - self.num) * (a + b) // (self.den + self.num)

    def of(self, s: np.ndarray) -> np.ndarray:
        """All signatures of a set that has elements."""
        n, out = len(s), []
        own = int(np.searchsorted(self.highs, n))
        light = s
        if len(self.frequent):
            at = np.searchsorted(self.frequent, s)
            at[at == len(self.frequent)] = 0
            light = s[self.frequent[at] != s]
        for band in (own, own + 1):
            low, high = self.bands[band]
            largest = min(high, n * self.den // self.num)
            if largest < low:
                continue
            most = self.differences(n, largest)
            segments = (self.differences(high, high) + 1) * 11 // 10 + 2
            found = self._segments(light, segments, 4 * band)
            # Of two partners, the segments with elements before the first equal one all differ, so it is among the first
            # H+1 of either.
            out.append(found[: most + 1])
            if len(found) > most:
                continue
            found = self._segments(s, segments, 4 * band + 1)
            out.append(found[: most + 1])
            if len(found) > most:
                continue
            out.append(self._neighbours(s, (self.differences(high, high) + 2) // 2, 4 * band + 2))
        return np.concatenate(out)

    @staticmethod
    def _segments(s: np.ndarray, segments: int, seed: int) -> np.ndarray:
        """A hash for each segment with elements. Segments are ranges of the hash, so sorted elements stand together."""
        if not len(s):
            return s
        segment = ((s >> U(32)) * U(segments)) >> U(32)
        starts = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
        return _mix(np.add.reduceat(_mix(s + U(1)), starts) + segment[starts] * U(0x9E3779B97F4A7C15) + _salt(seed))

    @staticmethod
    def _neighbours(s: np.ndarray, segments: int, seed: int) -> np.ndarray:
        """Hashes of all segments, empty ones too, and of each segment less one element."""
        segment = ((s >> U(32)) * U(segments)) >> U(32)
        x, salt = _mix(s + U(1)), lambda k: k * U(0x9E3779B97F4A7C15) + _salt(seed)
        sums = np.zeros(segments, U)
        np.add.at(sums, segment.astype(np.int64), x)
        return np.unique(np.concatenate([_mix(sums + salt(np.arange(segments, dtype=U))), _mix(sums[segment.astype(np.int64)] - x + salt(segment))]))


def _packed(h: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, hashes) by the upper eight bits."""
    h = np.sort(h)
    bucket = h >> U(56)
    starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    for i, j in zip(starts, np.append(starts[1:], len(h))):
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[i])], pa.int64()), pa.array([h[i:j].tobytes()], pa.binary())], ["bucket", "hashes"])


def _frequent(docs: DataFrame, text: str, rows: int) -> np.ndarray:
    """Hashes that stand in at least OFTEN texts of a sample of about SAMPLE: a hint of bounded size, never a condition."""
    share = max(1, rows // SAMPLE)
    sample = docs.select(F.col(text).alias("text")).where(F.pmod(F.xxhash64("text", F.lit(3)), F.lit(share)) == 0)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _WordHashes(), [], 0
        for b in batches:
            for raw in b.column(0).cast(pa.binary()).to_pylist():
                held.append(shingles(raw, hashes))
                size += len(held[-1])
                if size >= PACKED:
                    yield from _packed(np.concatenate(held))
                    held, size = [], 0
        if size:
            yield from _packed(np.concatenate(held))

    def count(block: pa.Table) -> pa.Table:
        h, n = np.unique(np.concatenate([np.frombuffer(x, U) for x in block.column("hashes").to_pylist()]), return_counts=True)
        often = n >= OFTEN
        return pa.table([pa.array(h[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["h", "count"])

    # Packed by their upper bits, as a row for each would fill the executors' memory.
    common = sample.mapInArrow(pack, "bucket long, hashes binary").groupBy("bucket").applyInArrow(count, "h long, count long").orderBy(F.desc("count"), "h").limit(FREQUENT)
    # As Arrow, since as many rows would be objects of the driver's Python.
    return np.sort(common.select("h").toArrow().column("h").to_numpy().view(U))


def _met(docs: DataFrame, key: str, text: str, signatures: Signatures, buckets: int) -> DataFrame:
    """Rows of two sorts. Of texts: key, n (size of the set) and a (its name, null without words). Of sets that share a
    signature: run, a and b, with b the least set of the run and a another; run is 0 for a pair."""
    ship = shipped(docs.sparkSession, signatures)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType
    packed_schema = StructType([*StructType.fromDDL("bucket long, sigs binary, sids binary, ns binary"), StructField("keys", ArrayType(kind))])
    met_schema = StructType([*StructType.fromDDL("run long, a long, b long, n long"), StructField("key", kind)])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, hashes, seen, turn = ship().of, _WordHashes(), set(), 0
        sigs, sids, size = [], [], 0

        def flush():
            s, owner = np.concatenate(sigs), np.repeat(np.array(sids, np.int64), [len(x) for x in sigs])
            # The bucket comes from the upper bits; of the lower ones 40 go on, as buckets are small and sets are verified.
            bucket = (s >> U(40)) % U(buckets)
            order = np.argsort(bucket, kind="stable")
            s, owner, bucket = s[order], owner[order], bucket[order]
            low, high = s.astype(np.uint32), (s >> U(32)).astype(np.uint8)
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            ends = np.append(starts[1:], len(s))
            rows = [(int(bucket[i]), low[i:j].tobytes() + high[i:j].tobytes(), owner[i:j].tobytes()) for i, j in zip(starts, ends)]
            for k in range(0, len(rows), 200):
                b, x, y = zip(*rows[k : k + 200])
                yield pa.RecordBatch.from_arrays([pa.array(b, pa.int64()), pa.array(x, pa.binary()), pa.array(y, pa.binary()), pa.nulls(len(b), pa.binary()), pa.nulls(len(b), pa.list_(keys.type))], packed_schema.names)

        for b in batches:
            keys, own, counts = b.column(0), [], []
            for raw in b.column(1).cast(pa.binary()).to_pylist():
                s = shingles(raw, hashes)
                sid = set_id(s) if len(s) else 0
                own.append(sid), counts.append(len(s))
                if not len(s) or sid in seen:
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                sigs.append(of(s))
                sids.append(sid)
                size += len(sigs[-1])
                if size >= PACKED:
                    yield from flush()
                    sigs, sids, size = [], [], 0
            if len(own):
                turn += 1
                at = zlib.crc32(np.array(own[:8] + [turn], np.int64).tobytes()) % buckets
                yield pa.RecordBatch.from_arrays(
                    [pa.array([at], pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.array(own, np.int64).tobytes()]), pa.array([np.array(counts, np.int64).tobytes()]), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)],
                    packed_schema.names,
                )
        if size:
            yield from flush()

    def meet(block: pa.Table) -> pa.Table:
        texts = pc.is_valid(block.column("ns"))
        alone, block = block.filter(texts), block.filter(pc.invert(texts))
        keys, own, n = alone.column("keys").combine_chunks(), b"".join(alone.column("sids").to_pylist()), b"".join(alone.column("ns").to_pylist())
        keys = (pa.concat_arrays(keys.chunks) if isinstance(keys, pa.ChunkedArray) else keys).flatten()
        own, n = np.frombuffer(own, np.int64), np.frombuffer(n, np.int64)
        none = np.empty(0, U)
        sig = np.concatenate([none, *(np.frombuffer(x[: len(x) // 5 * 4], np.uint32) | np.frombuffer(x[len(x) // 5 * 4 :], np.uint8).astype(U) << U(32) for x in block.column("sigs").to_pylist())])
        sid = np.frombuffer(b"".join(block.column("sids").to_pylist()), np.int64)
        order = np.lexsort((sid, sig))
        sig, sid = sig[order], sid[order]
        fresh = np.append(True, (sig[1:] != sig[:-1]) | (sid[1:] != sid[:-1]))[: len(sig)]
        sig, sid = sig[fresh], sid[fresh]
        starts = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        length = np.diff(np.append(starts, len(sig)))
        shared = length > 1
        starts, length = starts[shared], length[shared]
        of_run = np.repeat(np.arange(len(starts)), length)
        at = np.arange(len(of_run)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(starts, length)
        member = sid[at]
        # A run is named by its members, so runs with the same members fall together.
        named = _mix(np.add.reduceat(_mix(member.view(U)), np.cumsum(length) - length)).view(np.int64) if len(starts) else np.empty(0, np.int64)
        least = sid[starts]
        table = np.unique(np.stack([np.where(length > 2, named, 0)[of_run], member, least[of_run]]), axis=1) if len(starts) else np.empty((3, 0), np.int64)
        table = table[:, table[1] != table[2]]
        more, width = pa.nulls, table.shape[1]
        columns = [
            pa.concat_arrays([pa.array(table[0]), more(len(n), pa.int64())]),
            pa.concat_arrays([pa.array(table[1]), pa.array(own, mask=n == 0)]),
            pa.concat_arrays([pa.array(table[2]), more(len(n), pa.int64())]),
            pa.concat_arrays([more(width, pa.int64()), pa.array(n)]),
            pa.concat_arrays([more(width, keys.type), keys]),
        ]
        return pa.table(columns, met_schema.names)

    return source.mapInArrow(pack, packed_schema).groupBy("bucket").applyInArrow(meet, met_schema)


def _elements(docs: DataFrame, key: str, text: str, owners: DataFrame) -> DataFrame:
    """(sid, n, sketch, set) of the rows whose key is in ``owners``, one for each set that is asked for; the set as packed
    hashes in order. Rows that repeat a key give more sets or repeat one, which does no harm below."""
    own = bounded(owners.select(F.col("key").alias("__own")).distinct())
    among = docs.join(own, F.col(key).eqNullSafe(F.col("__own")), "left_semi").select(F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _WordHashes()
        for b in batches:
            rows = [(set_id(s), len(s), sketch(s), s.tobytes()) for s in (shingles(raw, hashes) for raw in b.column(0).cast(pa.binary()).to_pylist()) if len(s)]
            for i in range(0, len(rows), 100):
                cols = list(zip(*rows[i : i + 100]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["sid", "n", "sketch", "set"])

    return written(among.mapInArrow(run, "sid long, n long, sketch binary, set binary"), "jaccard-sets")


def _linked(s: np.ndarray, t: np.ndarray, num: int, den: int) -> bool:
    """Whether two sets of sorted hashes reach the similarity."""
    if len(s) * den < len(t) * num or len(t) * den < len(s) * num:
        return False
    at = np.searchsorted(s, t)
    at[at == len(s)] = 0
    same = int((s[at] == t).sum())
    return den * same >= num * (len(s) + len(t) - same)


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that reach the similarity, by their whole sets. Pairs go to the sets a by broadcast, so that only these
    and the sets b that are asked for are shuffled, once each; more than PAIRS take several passes, each with its own files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                keep.append(_linked(np.frombuffer(x, U), np.frombuffer(y, U), num, den))
            kept = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(kept), b.column(1).filter(kept)], ["a", "b"])

    found = []
    passes = min(PASSES, -(-pairs.count() // PAIRS) or 1)
    for i in range(passes):
        part = pairs.select("a", "b").where(F.pmod(F.xxhash64("b"), F.lit(passes)) == i)
        one = sets.select(F.col("sid").alias("a"), F.col("set").alias("sa")).join(bounded(part), "a")
        two = sets.join(bounded(part.select(F.col("b").alias("sid")).distinct()), "sid", "left_semi").select(F.col("sid").alias("b"), F.col("set").alias("sb"))
        found.append(written(one.join(two, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "jaccard-links"))
    return reduce(DataFrame.unionAll, found)


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``pairs`` whose a and b the links don't connect yet."""
    named = bounded(roots)
    p = pairs.join(named.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(named.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    return p.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select(*pairs.columns)


def _in_blocks(members: DataFrame, group: str, rows: int, size: Column) -> DataFrame:
    """``members`` (group, sid, ...) with task, i, j and own: a group of more than BLOCK members, or HELD bytes by ``size``,
    is dealt into blocks, each pair of which, i <= j, is a task of its own; smaller groups share tasks by their hash."""
    large = members.groupBy(group).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum(size) / HELD)).cast("int").alias("blocks")).where("blocks > 1")
    m = members.join(large, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    m = m.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    m = m.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(max(64, rows // TOGETHER)))).otherwise(F.xxhash64(group, "i", "j"))
    return m.withColumn("task", task).drop("blocks", "other")


def _of_blocks(t: pa.Table, group: str, compare) -> pa.Table:
    """(a, b) from ``compare(rows, left, forest)`` for each group and pair of blocks of a task: rows stand by size, left tells
    the first block of two, or is null where a block meets itself; the task's groups share one forest, so that its output
    grows with the sets it has seen and not with the runs in which they meet."""
    g, i, j, n, own = (t.column(c).to_numpy() for c in (group, "i", "j", "n", "own"))
    order = np.lexsort((n, j, i, g))
    key = np.stack([g[order], i[order], j[order]])
    cuts = np.append(np.flatnonzero(np.append(True, (key[:, 1:] != key[:, :-1]).any(0))), len(order))
    out, forest = [np.empty((2, 0), np.int64)], _Forest()
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        at = order[lo:hi]
        if hi - lo > 1 and (found := compare(at, own[at] == i[at] if i[at[0]] != j[at[0]] else None, forest)) is not None:
            out.append(found)
    table = np.unique(np.concatenate(out, axis=1), axis=1)
    return pa.table([pa.array(table[0]), pa.array(table[1])], ["a", "b"])


def _narrowed(raw: list[bytes], width: int) -> np.ndarray:
    """Sketches folded to ``width`` bytes, as rows of 64-bit words."""
    out = np.empty((len(raw), width // 8), U)
    for k, x in enumerate(raw):
        v = np.frombuffer(x, U)
        while len(v) * 8 > width:
            v = v[: len(v) // 2] ^ v[len(v) // 2 :]
        out[k] = v
    return out


def _possible(raw: list[bytes], n: np.ndarray, root: np.ndarray, left: np.ndarray | None, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs x < y of rows of different roots that sizes and sketches don't rule out, some rows at a time. Rows stand by size.

    Rows go in groups of like width of their sketches, so that a wide one isn't folded for the sake of a narrow one far off.
    """
    width = np.array([len(x) for x in raw])
    kinds = np.unique(width)
    for w in kinds:
        for v in kinds[kinds >= w]:
            p, q = np.flatnonzero(width == w), np.flatnonzero(width == v)
            x, y = _narrowed([raw[k] for k in p], w), _narrowed([raw[k] for k in q], w)
            step = max(1, (1 << 21) // (y.size + 1))
            for k in range(0, len(p), step):
                a = p[k : k + step]
                total = n[a][:, None] + n[q][None, :]
                fits = (np.minimum(n[a][:, None], n[q][None, :]) * den >= np.maximum(n[a][:, None], n[q][None, :]) * num) & (root[a][:, None] != root[q][None, :])
                if left is not None:
                    fits &= left[a][:, None] != left[q][None, :]
                if w == v:
                    fits &= a[:, None] < q[None, :]
                if not fits.any():
                    continue
                differ = np.bitwise_count(x[k : k + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                r, c = np.nonzero(fits & (differ * (den + num) <= (den - num) * total))
                if len(r):
                    yield a[r], q[c]


class _Forest(dict):
    """Disjoint sets by name."""

    def find(self, x):
        while (p := self.get(x, x)) != x:
            self[x] = x = self.get(p, p)
        return x

    def join(self, x, y) -> bool:
        x, y = self.find(x), self.find(y)
        self[max(x, y)] = min(x, y)
        return x != y


def _across(runs: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): links that connect sets of a run which no links connect yet, a spanning forest of them per task.

    A run with unconnected members has one that its least isn't connected with, so only such runs are brought together.
    """
    open_runs = written(_apart(runs.select("run", "a", "b"), roots).select("run").distinct(), "jaccard-open")
    rows = written(runs.join(open_runs, "run", "left_semi"), "jaccard-runs")
    members = rows.select("run", F.col("a").alias("sid")).unionAll(rows.select("run", F.col("b").alias("sid"))).distinct()
    rooted = sets.dropDuplicates(["sid"]).join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    places = ["task", "run", "i", "j", "own", "sid", "n", "root"]
    # Placed by themselves, so that sketches and sets move only once it is known where to.
    placed = written(_in_blocks(members.join(rooted.select("sid", "n", "root"), "sid"), "run", rows.count(), F.col("n") / 4 + 64).select(*places), "jaccard-placed")

    def sketched(t: pa.Table) -> pa.Table:
        sid, n, root = (t.column(c).to_numpy() for c in ("sid", "n", "root"))
        sketches = t.column("sketch").combine_chunks()

        def compare(at, left, forest):
            if (root[at] == root[at[0]]).all():
                return None
            out, own = [], sid[at]
            for x, y in _possible([sketches[int(k)].as_py() for k in at], n[at], root[at], left, num, den):
                label = np.array([forest.find(k) for k in own.tolist()])
                fresh = label[x] != label[y]
                out += [pair for pair in zip(*(k.tolist() for k in contracted(own[x[fresh]], own[y[fresh]]))) if forest.join(*pair)]
            return np.array(out, np.int64).T if out else None

        return _of_blocks(t, "run", compare)

    near = placed.join(rooted.select("sid", "sketch"), "sid").select(*places, "sketch").groupBy("task").applyInArrow(sketched, "a long, b long")
    near = written(near.distinct(), "jaccard-near")
    # Whatever pair the bound leaves has both its ends in one group of these.
    together = written(components(near, contract=True).select(F.col("node").alias("sid"), F.col("root").alias("party")), "jaccard-parties")
    discard(open_runs, rows, near, placed)
    places[1] = "party"
    placed = written(_in_blocks(together.join(rooted.select("sid", "n", "root"), "sid"), "party", together.count(), F.col("n") * 8.25 + 64).select(*places), "jaccard-placed")

    def exact(t: pa.Table) -> pa.Table:
        sid, n, root = (t.column(c).to_numpy() for c in ("sid", "n", "root"))
        sketches, sets_of = t.column("sketch").combine_chunks(), t.column("set").combine_chunks()

        def compare(at, left, forest):
            out = []
            whole = [np.frombuffer(sets_of[int(k)].as_py(), U) for k in at]
            for x, y in _possible([sketches[int(k)].as_py() for k in at], n[at], root[at], left, num, den):
                for p, q in zip(x.tolist(), y.tolist()):
                    if forest.find(root[at[p]]) != forest.find(root[at[q]]) and _linked(whole[p], whole[q], num, den):
                        forest.join(root[at[p]], root[at[q]])
                        out.append((sid[at[p]], sid[at[q]]))
            return np.array(out, np.int64).T if out else None

        return _of_blocks(t, "party", compare)

    asked = sets.join(bounded(together.select("sid")), "sid", "left_semi").select("sid", "sketch", "set").dropDuplicates(["sid"])
    links = placed.join(asked, "sid").select(*places, "sketch", "set").groupBy("task").applyInArrow(exact, "a long, b long")
    links = written(links, "jaccard-links")
    discard(placed)
    return links


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", num: int = NUM, den: int = DEN) -> DataFrame:
    """Per row of ``docs``: the key, n_shingles and component_id, the least key that links lead to.

    Words are split at ASCII white space after lower-casing A-Z. Rows link when den * shared >= num * united n-grams; rows
    without words (null and empty texts among them) have an empty set and stand alone with their own key. Rows with equal
    sets are one set, whose copies meet only by partial aggregation; sets are told apart by a 64-bit hash. A null key is
    never the least of a group that has others. Other columns are ignored; an empty table gives no rows. No cap anywhere:
    bytes of tables decide between broadcast and shuffle, the sample only hints at frequent n-grams.
    """
    size = docs.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes")).first()
    signatures = Signatures(_frequent(docs, text, size["rows"]), num, den)
    # A text has about a signature for every ten bytes.
    met = written(_met(docs, key, text, signatures, max(BUCKETS, size["bytes"] // (10 * PER_BUCKET))), "jaccard-met")
    sets_of = met.where("n is not null").select("key", "n", F.col("a").alias("sid"))
    found = written(met.where("n is null").select("run", "a", "b").distinct(), "jaccard-candidates")
    pairs = found.groupBy("a", "b").agg(F.count("*").alias("shared"))
    pairs = written(pairs, "jaccard-pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionAll(pairs.select("b")).distinct()
    owners = written(sets_of.join(ends, "sid", "left_semi").groupBy("sid").agg(F.min("key").alias("key")), "jaccard-owners")
    sets = _elements(docs, key, text, owners)

    # Each set with the one it shares most with; then pairs, then members of runs, that these links leave apart.
    best = written(pairs.groupBy("a").agg(F.max_by("b", F.struct("shared", F.col("b"))).alias("b")), "jaccard-best")
    links = _verified(best, sets, num, den)
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))  # one link suffices to tell that two are connected
    more = written(_apart(pairs.select("a", "b"), roots).join(best, ["a", "b"], "left_anti"), "jaccard-more")
    links = links.unionAll(_verified(more, sets, num, den))
    roots = written(components(links, contract=True), "jaccard-roots")
    across = _across(found.where("run <> 0"), roots, sets, num, den)
    roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(across), contract=True), "jaccard-roots")
    discard(found, pairs, owners, sets, best, more)
    out = sets_of.join(roots.withColumnRenamed("node", "sid"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = sets_of.where("sid is not null").groupBy("sid").agg(F.min("key").alias("key")).join(roots.withColumnRenamed("node", "sid"), "sid", "left")
    least = least.groupBy(F.coalesce("root", "sid").alias("root")).agg(F.min("key").alias("component_id"))
    alone = sets_of.where("sid is null").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("key").alias("component_id"))
    return out.where("sid is not null").join(least, "root").select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id").unionAll(alone)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those that a row with a lesser doc_id is grouped with. Of rows with one id all stay or
    go together; a null id stays."""
    stay = groups(docs).where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select("doc_id").distinct()
    return docs.join(written(stay, "jaccard-gone"), "doc_id", "left_anti").select(*docs.columns)
