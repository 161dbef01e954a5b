"""BPE encoding by a streaming transducer with bounded lookahead, and decoding by an incremental state machine.

How far may what comes later change the tokens of what was read? Two texts that begin alike are merged alike, rule by rule
in order of rank, but for what stands before the place where they part. A rule (u, v) moves that place to the left by
the length of u, if the last common token is u and one of the texts goes on with v; v then begins with the u of the rule
that moved it before. So the places move along chains of rules of rising rank, each one's v beginning with the u of the
one before, and the heaviest chain, found in one pass over the merges, is the lookahead: tokens that end that far before
the last symbol read are final. The transducer keeps the symbols that aren't, a block more at most, whatever the length
of a word.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
import struct
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import shipped
from .token_counts import byte_characters

#: Symbols that are read beyond the lookahead before tokens are emitted.
BLOCK = 1024
#: Symbols that are merged by scanning a list; more go through a queue.
FEW = 24
#: Above all ranks.
NEVER = (1 << 60, -1)
#: Pieces of text that a task remembers of each kind, newer and older ones, and the characters of one of them at most.
REMEMBERED, MEMORABLE = 250_000, 64
#: Characters of a run of text from which it goes through the transducer by itself.
LONG = 1 << 12
#: Characters of a text that are cut and encoded at a time, at white space where the vocabulary drops it.
SLICE = 1 << 18
#: What ``str.split`` takes for white space and Unicode doesn't.
SEPARATORS = re.compile("[\x1c-\x1f]")


def lookahead(merges: Iterable[tuple[tuple, tuple]]) -> int:
    """Symbols after its end that settle a token. merges: pairs of symbol sequences, in order of rank."""
    heaviest: dict[tuple, int] = {}  # by u: the heaviest chain so far that ends with a rule of that u
    most = 0
    for u, v in merges:
        n = len(u) + max((heaviest.get(v[:i], 0) for i in range(1, len(v) + 1)), default=0)
        if n > heaviest.get(u, 0):
            heaviest[u] = n
            most = max(most, n)
    return most


class Transducer:
    """Symbols in, final tokens out. rules: (left id, right id) -> (rank, id of both); sizes: symbols of each id."""

    def __init__(self, rules: dict[tuple[int, int], tuple[int, int]], sizes: list[int], ahead: int, block: int = BLOCK):
        self.rules, self.sizes, self.ahead, self.full = rules, sizes, ahead, ahead + max(block, 1)
        self.held: list[int] = []

    def feed(self, symbols: Iterable[int]) -> Iterator[int]:
        """Takes symbols and gives the tokens that have become final."""
        held = self.held
        for s in symbols:
            held.append(s)
            if len(held) >= self.full:
                end, last = 0, len(held) - self.ahead
                for token in self.merged(held):
                    if end + self.sizes[token] > last:
                        break
                    end += self.sizes[token]
                    yield token
                del held[:end]

    def close(self) -> list[int]:
        """The tokens of what is held, as the word ends here."""
        out, self.held = self.merged(self.held), []
        return out

    def merged(self, symbols: list[int]) -> list[int]:
        """The symbols merged by least rank, leftmost first."""
        return self._few(symbols) if len(symbols) <= FEW else self._many(symbols)

    def _few(self, symbols: list[int]) -> list[int]:
        """By the ranks of all neighbours in a list."""
        ids, rules = list(symbols), self.rules
        ranks = [rules.get(p, NEVER) for p in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least is NEVER:
                break
            i = ranks.index(least)
            ids[i : i + 2] = [least[1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rules.get((ids[i], ids[i + 1]), NEVER)
            if i:
                ranks[i - 1] = rules.get((ids[i - 1], ids[i]), NEVER)
        return ids

    def _many(self, symbols: list[int]) -> list[int]:
        """By a queue of pairs."""
        ids, rules, n = list(symbols), self.rules, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, found[1], ids[i], ids[i + 1]) for i in range(n - 1) if (found := rules.get((ids[i], ids[i + 1])))]
        heapq.heapify(queue)
        while queue:
            _, i, new, left, right = heapq.heappop(queue)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if found := rules.get((new, ids[k])):
                    heapq.heappush(queue, (found[0], i, found[1], new, ids[k]))
            if (h := before[i]) >= 0 and (found := rules.get((ids[h], new))):
                heapq.heappush(queue, (found[0], h, found[1], ids[h], new))
        return [x for x in ids if x >= 0]


class Vocabulary:
    """A ``tokenizer.json`` with a BPE model. Its normaliser and its cut into words are the file's own; merges must be
    proper (each token has one pair, whose parts come first), else an error says so."""

    def __init__(self, text: str, block: int = BLOCK):
        from tokenizers import Tokenizer

        data = json.loads(text)
        model, own = data["model"], Tokenizer.from_str(text)
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or any(a[k] for a in data["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"only plain BPE models are read, without {odd or 'other kinds or added tokens that take text around them'}")
        if (data["decoder"] or {"type": "ByteLevel"})["type"] != "ByteLevel":
            raise ValueError(f"decoder {data['decoder']} isn't known")
        self.end = model["end_of_word_suffix"] or ""
        self.ids = dict(model["vocab"])
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.cut = regex.compile("|".join(sorted(map(re.escape, self.special), key=len, reverse=True))) if self.special else None
        self.normalizer, self.splitter = own.normalizer, own.pre_tokenizer
        #: True if words never reach over white space, so that runs without it can be encoded each for itself.
        self.spaceless = bool(self.splitter) and not self.splitter.pre_tokenize_str(" \n") and not self._apart(" a") and self._apart("a b")
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        size = {s: 1 for s in self.ids}  # of what no merge makes
        made: set[str] = set()
        later = {a + b for a, b in pairs}
        for a, b in pairs:
            if a + b in made or any(x in later and x not in made for x in (a, b)):
                raise ValueError(f"the merges aren't proper at {a} {b}")
            made.add(a + b)
            size[a + b] = size[a] + size[b]
        self.ahead = lookahead((self._symbols(a), self._symbols(b)) for a, b in pairs)
        self.rules = {(self.ids[a], self.ids[b]): (rank, self.ids[a + b]) for rank, (a, b) in enumerate(pairs)}
        n = 1 + max([*self.ids.values(), *self.special.values()])
        self.sizes = [0] * n
        for s, i in self.ids.items():
            self.sizes[i] = size[s]
        #: Between tokens when they are decoded: a vocabulary without a decoder shows its pieces.
        self.between = b"" if data["decoder"] else b" "
        to_byte = byte_characters()
        self.bytes = [b""] * n
        for s, i in self.ids.items():
            self.bytes[i] = bytes(to_byte[c] for c in s) if data["decoder"] and all(c in to_byte for c in s) else s.encode()
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.block = block

    def _apart(self, text: str) -> bool:
        return [x for x, _ in self.splitter.pre_tokenize_str(text)] == text.split(" ")

    def _symbols(self, piece: str) -> tuple[str, ...]:
        if self.end and piece.endswith(self.end):
            body = piece[: -len(self.end)]
            return (*body[:-1], body[-1:] + self.end)
        return tuple(piece)

    def transducer(self) -> Transducer:
        return Transducer(self.rules, self.sizes, self.ahead, self.block)

    def words(self, text: str) -> Iterator[Iterator[int]]:
        """The words of a text without special tokens, each as a stream of symbols."""
        if self.normalizer:
            text = self.normalizer.normalize_str(text)
        for word, _ in self.splitter.pre_tokenize_str(text) if self.splitter else ([(text, None)] if text else []):
            yield self.symbols(word)

    def symbols(self, word: str) -> Iterator[int]:
        """The symbols that a word begins as; the last one marks its end where the vocabulary does."""
        get = self.ids.get
        return (s for s in chain(map(get, word[:-1]), (get(c + self.end) for c in word[-1:])) if s is not None)

    def parts(self, text: str) -> Iterator[str | int]:
        """The text between special tokens, in order, and their ids."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            if m.start() > at:
                yield text[at : m.start()]
            yield self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:]

    def encode(self, text: str | None) -> Iterator[int]:
        """The ids of a text, as they become final. Null and empty texts have none."""
        machine = self.transducer()
        for part in self.parts(text or ""):
            if isinstance(part, int):
                yield part
            else:
                for word in self.words(part):
                    yield from machine.feed(word)
                    yield from machine.close()


class Memo:
    """Remembers the newer entries: when they are ``size``, they become the older ones, and what was older is forgotten."""

    def __init__(self, size: int = REMEMBERED):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.new, self.old = {}, self.new
        self.new[key] = value


class Encoder:
    """Encodes many texts in a task, remembering what short runs of text and short words became."""

    def __init__(self, vocabulary: Vocabulary):
        self.of, self.machine, self.runs, self.words = vocabulary, vocabulary.transducer(), Memo(), Memo()

    def chunks(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """Parts of the text in turn: ids as little-endian words, and their tokens' bytes as decoding would join them."""
        for part in self.of.parts(text):
            if isinstance(part, int):
                yield part.to_bytes(4, "little"), self.of.bytes[part]
            elif not self.of.spaceless:
                yield from self._stream(part)
            else:
                for begin in self._slices(part):
                    runs = regex.findall(r"\S+", begin) if SEPARATORS.search(begin) else begin.split()
                    at = 0
                    for i in [i for i, r in enumerate(runs) if len(r) > LONG] if len(begin) > LONG else ():
                        yield from self._runs(runs[at:i])
                        yield from self._stream(runs[i])
                        at = i + 1
                    yield from self._runs(runs[at:])

    def _slices(self, text: str) -> Iterator[str]:
        at = 0
        while at < len(text):
            end = min(at + SLICE, len(text))
            while end < len(text) and not text[end].isspace():
                end += 1
            # a separator that only ``isspace`` takes for white space is inside a word
            while end < len(text) and SEPARATORS.match(text[end]):
                end += 1
                while end < len(text) and not text[end].isspace():
                    end += 1
            yield text[at:end]
            at = end

    def _runs(self, runs: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Of runs that aren't long, in one chunk."""
        found = list(map(self.runs.new.get, runs))
        if None in found:
            fresh: dict[str, tuple[bytes, bytes] | None] = {r: self.runs.get(r) for r, f in zip(runs, found) if f is None}
            unknown = [r for r, f in fresh.items() if f is None]
            for r, f in zip(unknown, self._encoded(unknown)):
                fresh[r] = f
                if len(r) <= MEMORABLE:
                    self.runs.put(r, f)
            found = [fresh[r] if f is None else f for r, f in zip(runs, found)]
        found = [f for f in found if f[0]]
        if found:
            yield b"".join([f[0] for f in found]), self.of.between.join([f[1] for f in found])

    def _encoded(self, runs: list[str]) -> list[tuple[bytes, bytes]]:
        """Each run by itself; they are normalised and cut together, with a space between."""
        if not runs:
            return []
        of, words, between = self.of, self.words, self.of.between
        text = " ".join(runs)
        if of.normalizer:
            text = of.normalizer.normalize_str(text)
        ends, at = [], -1
        while (at := text.find(" ", at + 1)) >= 0:
            ends.append(at)
        ends.append(len(text))
        out: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in runs]
        k = 0
        for word, (begin, _) in of.splitter.pre_tokenize_str(text):
            while begin >= ends[k]:
                k += 1
            found = words.get(word)
            if found is None:
                tokens = self._word(word)
                found = _packed(tokens), between.join(map(of.bytes.__getitem__, tokens))
                if len(word) <= MEMORABLE:
                    words.put(word, found)
            out[k][0].append(found[0])
            out[k][1].append(found[1])
        return [(b"".join(ids), between.join(tokens)) for ids, tokens in out]

    def _word(self, word: str) -> list[int]:
        machine = self.machine
        if len(word) < machine.full:  # what the transducer would hold to the end
            return machine.merged([*self.of.symbols(word)])
        return [*machine.feed(self.of.symbols(word)), *machine.close()]

    def _stream(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """By the transducer, in chunks of bounded size."""
        of, machine = self.of, self.of.transducer()
        out: list[int] = []
        for word in of.words(text):
            for token in machine.feed(word):
                out.append(token)
            out += machine.close()
            if len(out) >= BLOCK:
                yield _packed(out), of.between.join(map(of.bytes.__getitem__, out))
                out = []
        if out:
            yield _packed(out), of.between.join(map(of.bytes.__getitem__, out))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Decoder:
    """Ids, or the bytes of tokens, in; text out, as soon as its characters are whole. Bytes that are no UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.of, self.machine, self.begun = vocabulary, codecs.getincrementaldecoder("utf-8")("replace"), False

    def feed(self, ids: Iterable[int | None]) -> str:
        """Ids that the vocabulary doesn't have, and null ones, are passed over."""
        known = [self.of.bytes[i] for i in ids if i is not None and 0 <= i < len(self.of.bytes) and self.of.bytes[i]]
        return self.joined(self.of.between.join(known)) if known else ""

    def joined(self, tokens: bytes) -> str:
        """Tokens that are joined already."""
        out = self.machine.decode(self.of.between + tokens if self.begun and self.of.between else tokens)
        self.begun = True
        return out

    def close(self) -> str:
        """What an unfinished character becomes; the machine can begin anew."""
        out, self.begun = self.machine.decode(b"", True), False
        self.machine.reset()
        return out


def load(path: str, block: int = BLOCK) -> Vocabulary:
    """The vocabulary of a ``tokenizer.json``, read on the driver; its size is fixed."""
    with open(path, encoding="utf-8") as f:
        return Vocabulary(f.read(), block)


def _rows(docs: DataFrame, vocabulary: Vocabulary, key: str, text: str, added: list[StructField], row) -> DataFrame:
    """key and what ``row(encoder, text)`` gives, per row of ``docs``, in one narrow stage."""
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = StructType([source.schema["key"], *added])
    held = shipped(docs.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        encoder, types = Encoder(held()), [to_arrow_type(f.dataType) for f in added]
        for b in batches:
            made = [row(encoder, x.as_py()) for x in b.column(1)]  # one text at a time
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([m[i] for m in made], t) for i, t in enumerate(types))], schema.names)

    return source.mapInArrow(run, schema).withColumnRenamed("key", key)


def encode(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key and ids (array<int>) of its whole text, as the library of the vocabulary's file encodes it,
    its special tokens recognised where they stand in a text.

    Null and empty texts have no ids (an empty array). Repeated rows are encoded each; other columns are ignored. Narrow; the vocabulary is broadcast.
    """

    def row(encoder: Encoder, t: str | None):
        packed = b"".join(ids for ids, _ in encoder.chunks(t or ""))
        return (memoryview(packed).cast("I").tolist() if packed else [],)

    return _rows(docs, vocabulary, key, text, [StructField("ids", ArrayType(IntegerType()))], row)


def decode(tokens: DataFrame, vocabulary: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All columns of ``tokens`` and ``out``, the text of ``ids``; null for null, empty for none. A column named ``out`` gives way."""
    held = shipped(tokens.sparkSession, vocabulary)
    source = tokens.drop(out) if out != ids else tokens
    names = source.columns
    inner = source.toDF(*[f"c{i}" for i in range(len(names))])
    at = names.index(ids)
    schema = StructType([*inner.schema, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Decoder(held())
        for b in batches:
            texts = [None if x.as_py() is None else machine.feed(x.as_py()) + machine.close() for x in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], schema.names)

    return inner.mapInArrow(run, schema).toDF(*names, out)


def digest(docs: DataFrame, vocabulary: Vocabulary, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_tokens, ids_sha256 (of the ids as little-endian 32-bit words) and decoded_sha256 (of the text
    that they decode to). Ids and decoded text go through the hashes chunk by chunk; nulls and repeats as in ``encode``."""

    def row(encoder: Encoder, t: str | None):
        import hashlib

        machine, of_ids, of_text, n = Decoder(encoder.of), hashlib.sha256(), hashlib.sha256(), 0
        for ids, tokens in encoder.chunks(t or ""):
            n += len(ids) // 4
            of_ids.update(ids)
            of_text.update(machine.joined(tokens).encode())
        of_text.update(machine.close().encode())
        return n, of_ids.hexdigest(), of_text.hexdigest()

    return _rows(docs, vocabulary, key, text, [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())], row)
