"""Token counts by greedy longest match, in time linear in the word.

The pieces form a trie. Every node has a failure link: where the longest match of the text read so far ends in a piece
boundary before the node, the link leads to what is left after those pieces, and their number is kept beside it. Reading
on, a node without the next symbol adds that number and follows its link; no piece is ever built and no symbol is read
twice.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import shipped

#: Symbol after the last byte of a word.
END = 256
#: What a run without white space is cut into: clitics, runs of letters, single digits, runs of other characters.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Counts that a task remembers; it forgets them all beyond that.
REMEMBERED = 400_000


class LongestMatch:
    """Numbers of pieces by greedy longest match. first: pieces that can begin a word, rest: those that can go on."""

    def __init__(self, first: Iterable[tuple[int, ...]], rest: Iterable[tuple[int, ...]] | None = None):
        first = set(first)
        rest = first if rest is None else set(rest)
        self.next: list[dict[int, int]] = [{}]
        piece = [False]
        self.rest = 0 if rest == first else 1
        if self.rest:
            self.next.append({})
            piece.append(False)
        for root, pieces in ((0, first), (self.rest, rest))[: 1 + self.rest]:
            for p in pieces:
                v = root
                for symbol in p:
                    if symbol not in self.next[v]:
                        self.next[v][symbol] = len(self.next)
                        self.next.append({})
                        piece.append(False)
                    v = self.next[v][symbol]
                piece[v] = piece[v] or bool(p)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        queue = deque(sorted({0, self.rest}))
        while queue:
            u = queue.popleft()
            for symbol, v in self.next[u].items():
                if piece[v]:
                    self.fail[v], self.popped[v] = self.rest, 1
                else:
                    z, pops = self.fail[u], self.popped[u]
                    while z >= 0 and symbol not in self.next[z]:
                        pops += self.popped[z]
                        z = self.fail[z]
                    if z >= 0:
                        self.fail[v], self.popped[v] = self.next[z][symbol], pops
                queue.append(v)

    def count(self, symbols: Iterable[int]) -> int:
        """Pieces of the word; -1 if greedy matching gets stuck. No symbols: none."""
        nxt, fail, popped, rest = self.next, self.fail, self.popped, self.rest
        u = n = 0
        for s in symbols:
            while s not in nxt[u]:
                n += popped[u]
                u = fail[u]
                if u < 0:
                    return -1
            u = nxt[u][s]
        while u != rest and u != 0:
            n += popped[u]
            u = fail[u]
            if u < 0:
                return -1
        return n


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def load(path: str, end: str = "</w>") -> LongestMatch:
    """The automaton of a ``tokenizer.json`` whose byte-level pieces mark the end of a word by ``end``."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {x["content"] for x in data.get("added_tokens", ())}
    of = byte_characters()
    pieces = set()
    for piece in data["model"]["vocab"]:
        if piece in special:
            continue
        last = piece.endswith(end)
        body = piece[: -len(end)] if last else piece
        if all(c in of for c in body):
            pieces.add(tuple(of[c] for c in body) + ((END,) if last else ()))
    return LongestMatch(pieces)


def counts(docs: DataFrame, vocabulary: LongestMatch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words, n_tokens and n_unknown, of its whole text.

    Text is lower-cased and cut at white space and by CUT into words; a word that greedy matching can't finish counts as
    one token and as unknown. Null and empty texts have none. Repeated rows are counted each, other columns are ignored.
    One narrow stage; the automaton, of a fixed vocabulary, is broadcast.
    """
    machine = shipped(docs.sparkSession, vocabulary)
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([source.schema["key"], *(StructField(n, LongType()) for n in ("n_words", "n_tokens", "n_unknown"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, cut = machine().count, regex.compile(CUT).findall
        known: dict[str, tuple[int, int, int]] = {}

        def measure(run_of_text: str) -> tuple[int, int, int]:
            words = tokens = unknown = 0
            for w in cut(run_of_text):
                n = count((*w.encode(), END))
                words += 1
                tokens += max(n, 1)
                unknown += n < 0
            return words, tokens, unknown

        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                words = tokens = unknown = 0
                for x in t.lower().split() if t else ():
                    found = known.get(x)
                    if found is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        found = known[x] = measure(x)
                    words += found[0]
                    tokens += found[1]
                    unknown += found[2]
                rows.append((words, tokens, unknown))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in rows], pa.int64()) for i in range(3))], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)
