"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton accepts every run of words that stands in some item. A document's words stream through it; after each word
the state's length is that of the longest run of document words, ending here, that some item holds. Where it reaches the
window's length, the last ``window`` words stand in an item and are hit. An item shorter than a window is a window itself.

The items are read in shards of a bounded number of words, one automaton each. The shards of PASS_BYTES of items are built
and broadcast together, and the documents pass through them in one narrow stage. More items take several passes: the documents are
written with what was found so far, and each pass adds its own spans and items to it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORDS, discard, shipped, written

#: Words of one shard of items: about 100 MB of automaton.
SHARD_WORDS = 400_000
#: Bytes of the items' texts of one pass: their automata take some 40 times as much.
PASS_BYTES = 4 << 20


def words(text: bytes) -> list[bytes]:
    """Lower-cased runs of letters, digits and characters beyond ASCII."""
    return text.translate(WORDS).split()


class SuffixAutomaton:
    """Of several word sequences; states carry the items in which their runs stand."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.next, self.link, self.len = [{}], [-1], [0]
        ends: list[tuple[int, int]] = []
        for k, (_, seq) in enumerate(items):
            last = 0
            for w in seq:
                last = self._extend(last, w)
                ends.append((last, k))
        # Items of a state: those of all states below it in the tree of suffix links, gathered only where a window can end.
        n = len(self.len)
        own: list[set[int]] = [set() for _ in range(n)]
        for state, k in ends:
            own[state].add(k)
        order = sorted(range(1, n), key=self.len.__getitem__, reverse=True)
        for s in order:
            if (p := self.link[s]) > 0:
                own[p] |= own[s]
        # short: for each state, the whole items of fewer words than a window that end with it, as (words, item)
        self.short: list[tuple[tuple[int, int], ...]] = [()] * n
        whole: dict[int, list[tuple[int, int]]] = {}
        for k, (_, seq) in enumerate(items):
            if 0 < len(seq) < window:
                s = 0
                for w in seq:
                    s = self.next[s][w]
                whole.setdefault(s, []).append((len(seq), k))
        for s in reversed(order):
            p = self.link[s]
            self.short[s] = self.short[p] + tuple(whole.get(s, ()))
        # full: for each state whose runs include one of window words, the items that hold it
        self.full: list[frozenset[int] | None] = [None] * n
        for s in range(1, n):
            if self.len[self.link[s]] < window <= self.len[s]:
                self.full[s] = frozenset(own[s])
        self.vocabulary = {w for _, seq in items for w in seq}
        self.least = min([window, *(len(seq) for _, seq in items if seq)])

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, length = self.next, self.link, self.len
        if (q := nxt[last].get(w)) is not None:
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        cur = len(length)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return cur

    def _clone(self, p: int, w: bytes, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        new = len(length)
        nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
        link[q] = new
        while p >= 0 and nxt[p].get(w) == q:
            nxt[p][w] = new
            p = link[p]
        return new

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Hit spans of words (start, end), disjoint and in order; the items with occurring windows; the longest match."""
        if len(seq) < self.least:
            return [], set(), 0
        # Only inside runs of known words can a window end; a run shorter than the shortest window has none.
        known = bytes(map(self.vocabulary.__contains__, seq))
        spans, found, longest = [], set(), 0
        nxt, link, length, full, short, window = self.next, self.link, self.len, self.full, self.short, self.window
        for run in re.finditer(b"\x01{%d,}" % self.least, known):
            state = matched = 0
            for i in range(run.start(), run.end()):
                w = seq[i]
                while state and w not in nxt[state]:
                    state = link[state]
                    matched = length[state]
                if w in nxt[state]:
                    state = nxt[state][w]
                    matched += 1
                if matched > longest:
                    longest = matched
                size = 0
                if matched >= window:
                    s = state
                    while full[s] is None:
                        s = link[s]
                    found |= full[s]
                    size = window
                for n, k in short[state]:
                    if n <= matched:
                        found.add(k)
                        size = max(size, n)
                if size:
                    start = i + 1 - size
                    while spans and spans[-1][0] >= start:
                        spans.pop()
                    if spans and spans[-1][1] >= start:
                        start = spans.pop()[0]
                    spans.append((start, i + 1))
        return spans, found, longest


def _passes(items: DataFrame, item_id: str, text: str, pass_bytes: int) -> list[DataFrame]:
    """(id, text) of the items, in parts of about ``pass_bytes`` of text; one part for a table that takes no more."""
    kept = items.select(F.col(item_id).cast("string").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    size = kept.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if size <= pass_bytes:
        return [kept]
    n = 1 + 2 * size // pass_bytes  # twice as many, as hashes deal unevenly
    dealt = written(kept.withColumn("pass", F.pmod(F.xxhash64("id", "text", F.lit(3)), F.lit(n))), "items")
    return [dealt.where(F.col("pass") == k).select("id", "text") for k in range(n)]


def _shards(kept: DataFrame, window: int, shard_words: int) -> list[SuffixAutomaton]:
    """The automata of one pass, built from bounded parts of its items."""
    size = kept.agg(F.sum(F.octet_length("text")).alias("n"), F.count("*").alias("rows")).first()
    if not size["rows"]:
        return []
    n = 1 + (size["n"] or 0) // (2 * shard_words)  # a word and its gap take two characters at least
    if n == 1:
        return [SuffixAutomaton([(r["id"], words(r["text"].encode())) for r in kept.collect()], window)]
    dealt = written(kept.withColumn("shard", F.pmod(F.xxhash64("id", "text"), F.lit(n))), "items")
    return [SuffixAutomaton([(r["id"], words(r["text"].encode())) for r in dealt.where(F.col("shard") == k).collect()], window) for k in range(n)]


SPANS = "n_words long, n_hit long, n_items long, items array<string>, longest long, clean_text string"


#: What earlier passes found: starts and ends of hit spans, ids of items, whether one had no id, the longest match.
STATE = "starts array<int>, ends array<int>, items array<string>, nameless boolean, longest long"


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", remove: bool = True, shard_words: int = SHARD_WORDS, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """All columns of ``docs``, then n_words, n_hit (words inside a hit span), n_items, items (ids as sorted strings),
    longest (words of the longest run that an item holds, within runs that can hold a window) and clean_text, the text
    without its hit spans (null unless ``remove``; the text itself where nothing is hit).

    Null and empty texts have no words; null and wordless items no windows; items with null ids are one item, which counts but isn't named. Items
    of one id are one item; repeated rows of ``docs`` count each. An empty table of items hits nothing. A column of ``docs`` with one of these names gives
    way. Texts pass whole. Narrow: no shuffle; the items of a pass are broadcast, and between passes the documents are written.
    """
    added = [x.split()[0] for x in SPANS.split(", ")]
    source = docs.drop(*added)
    names = source.columns
    inner = source.toDF(*[f"c{i}" for i in range(len(names))])
    plain = inner.schema
    parts = _passes(items, item_id, item_text, pass_bytes)
    for k, part in enumerate(parts):
        last = k + 1 == len(parts)
        schema = StructType([*plain, *StructType.fromDDL(SPANS if last else STATE)])
        automata = shipped(docs.sparkSession, _shards(part, window, shard_words))
        inner, before = inner.mapInArrow(_scanning(automata, names.index(text), len(names), k > 0, last, remove, schema.names), schema), inner
        if not last:
            inner = written(inner, "decontaminated")
            discard(before)
    return inner.toDF(*names, *added)


def _scanning(automata, at: int, width: int, begun: bool, last: bool, remove: bool, columns: list[str]):
    """One pass: takes documents, with what earlier passes found if any did, and adds what this one finds, or the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machines = automata()
        for b in batches:
            rows = []
            earlier = list(zip(*(b.column(width + i).to_pylist() for i in range(5)))) if begun else [((), (), (), False, 0)] * len(b)
            for raw, (starts, ends, ids, nameless, longest) in zip(b.column(at).cast(pa.binary()).to_pylist(), earlier):
                seq = words(raw or b"")
                spans, found = list(zip(starts, ends)), {*ids, *([None] if nameless else [])}
                for m in machines:
                    s, f, n = m.scan(seq)
                    spans = s if not spans else _merged(spans + s) if s else spans
                    found |= {m.ids[k] for k in f}
                    longest = max(longest, n)
                named = sorted(x for x in found if x is not None)
                if not last:
                    rows.append(([s for s, _ in spans], [e for _, e in spans], named, None in found, longest))
                    continue
                clean = None
                if remove and raw is not None:
                    clean = _without(raw, spans).decode() if spans else raw.decode()
                rows.append((len(seq), sum(e - s for s, e in spans), len(found), named, longest, clean))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.string()] if last else [pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([*b.columns[:width], *(pa.array(c, t) for c, t in zip(cols, types))], columns)

    return run


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of the spans and what stands between them."""
    at = [m.span() for m in WORD.finditer(raw.translate(WORDS))]
    out, last = [], 0
    for s, e in spans:
        out.append(raw[last : at[s][0]])
        last = at[e - 1][1]
    return b"".join([*out, raw[last:]])


def digest(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256 and contaminated; see ``decontaminate``."""
    found = decontaminate(docs.select("doc_id", "text"), items, window, remove=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.2, max_span: int = 50) -> DataFrame:
    """The documents as training text, in the columns of ``docs``: hit spans are removed; a document goes where more than
    ``max_coverage`` of its words are hit or a run of more than ``max_span`` words stands in an item. n_chars, where the
    documents have it, follows the text. Documents without a hit stay as they are, null texts too.
    """
    names = docs.columns
    inner = {c: f"__{i}" for i, c in enumerate(names)}  # so that no column clashes with those that are added
    text = inner["text"]
    found = decontaminate(docs.toDF(*inner.values()), items, window, text=text)
    kept = found.where((F.col("n_hit") <= max_coverage * F.col("n_words")) & (F.col("longest") <= max_span))
    kept = kept.withColumn(text, F.when(F.col("n_hit") > 0, F.col("clean_text")).otherwise(F.col(text)))
    if "n_chars" in names:
        size = inner["n_chars"]
        kept = kept.withColumn(size, F.when(F.col("n_hit") > 0, F.length(text).cast("long")).otherwise(F.col(size)))
    return kept.select(*(F.col(i).alias(c) for c, i in inner.items()))


def sha(ids: list[str]) -> str:
    """items_sha256 of sorted ids."""
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
