import hashlib
import random
import struct

import pytest

from fleetspark.llm import bpe

tokenizers = pytest.importorskip("tokenizers")
place = pytest.importorskip("public_tokenizers").path
NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")


@pytest.fixture(scope="module", params=NAMES)
def both(request):
    return bpe.load(place(request.param), block=64), tokenizers.Tokenizer.from_file(place(request.param))


def texts():
    rng = random.Random(3)
    alphabet = ["a", "b", "ab", "the", "in", "é", "é", "日本", "  ", "\n", "'s", "1", "!", "<|endoftext|>", "<|startoftext|>", "Σ", "İ", "\x1c", "\x85", " ", "😀", "<|", "ing", "́", "lll", "Ᲊ", "�"]
    out = ["".join(rng.choice(alphabet) for _ in range(rng.choice((1, 3, 10, 100, 2000)))) for _ in range(60)]
    out += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz"[:k]) for _ in range(9000)) for k in (1, 2, 3, 26)]
    return out + ["日本語テキスト" * 700, "!" * 9001, "", None, " \n\t ", "Hello  World", "ΟΔΟΣ"]


def test_same_as_the_library(both):
    own, library = both
    encoder, machine = bpe.Encoder(own), bpe.Decoder(own)
    for t in texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        chunks = list(encoder.chunks(t or ""))
        assert list(own.encode(t)) == ids and b"".join(c[0] for c in chunks) == struct.pack(f"<{len(ids)}I", *ids)
        said = library.decode(ids, skip_special_tokens=False)
        assert "".join(machine.joined(c[1]) for c in chunks) + machine.close() == said
        assert "".join(machine.feed([i]) for i in ids) + machine.close() == said  # token by token, characters cut across tokens


def test_tokens_come_early_and_little_is_held(both):
    own, _ = both
    machine = own.transducer()
    symbols, most, out = [s for w in own.words("abcab" * 4000) for s in w], 0, []
    for s in symbols:
        out += machine.feed([s])
        most = max(most, len(machine.held))
    assert most <= own.ahead + 64 and len(out) > 1000
    assert out + machine.close() == own.transducer().merged(symbols)


def test_lookahead():
    """A chain of rules that carries a change far to the left, and its bound."""
    assert bpe.lookahead([]) == 0
    assert bpe.lookahead([(("a",), ("b",)), (("c",), ("d",))]) == 1  # no v begins with the u of a rule before
    assert bpe.lookahead([(("a",), ("b",)), (("c",), ("a", "b")), (("d",), ("c", "a", "b"))]) == 3  # d, c, a: what follows a decides
    merges = [(("a",), ("b",)), (("c",), ("a",)), (("d",), ("c",)), (("e",), ("d",))]
    assert bpe.lookahead(merges) == 4


@pytest.mark.parametrize("seed", range(6))
def test_lookahead_suffices(seed):
    """On random proper merge lists every token that ends before the lookahead stays, whatever follows."""
    rng = random.Random(seed)
    pieces, merges = [("a",), ("b",), ("c",)], []
    while len(merges) < 25:
        u, v = rng.choice(pieces), rng.choice(pieces)
        if u + v not in pieces:
            merges.append((u, v))
            pieces.append(u + v)
    ids = {p: i for i, p in enumerate(pieces)}
    rules = {(ids[u], ids[v]): (r, ids[u + v]) for r, (u, v) in enumerate(merges)}
    sizes, ahead = [len(p) for p in pieces], bpe.lookahead(merges)
    for _ in range(300):
        symbols = [rng.randrange(2) if rng.random() < 0.9 else 2 for _ in range(rng.randrange(1, 160))]
        machine = bpe.Transducer(rules, sizes, ahead, 1)
        assert [*machine.feed(symbols), *machine.close()] == machine.merged(symbols)


def test_tables(spark, both):
    own, library = both
    rows = list(enumerate(texts())) + [(0, texts()[0]), (None, "null key")]
    df = spark.createDataFrame([(i, t, [1], "x") for i, t in rows], "doc_id long, text string, ids array<int>, decoded string").repartition(3)
    expected = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        said = library.decode(ids, skip_special_tokens=False)
        expected.append((i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digest(df, own).collect()), key=str) == sorted(expected, key=str)
    back = bpe.decode(bpe.encode(df, own), own).collect()
    assert sorted(((r.doc_id, len(r["ids"]), hashlib.sha256(r.decoded.encode()).hexdigest()) for r in back), key=str) == sorted(((e[0], e[1], e[3]) for e in expected), key=str)
    assert bpe.digest(df.limit(0), own).collect() == []
    odd = spark.createDataFrame([(1, None, 1), (2, [], 2), (3, [None, -1, 10**9, 257], 3)], "c0 int, ids array<int>, decoded int")
    assert {r.c0: r.decoded for r in bpe.decode(odd, own).collect()} == {1: None, 2: "", 3: library.decode([257], skip_special_tokens=False)}


def test_round_trip():
    """The byte vocabulary gives every text back."""
    own = bpe.load(place("byte_bpe_50k.json"))
    for t in texts():
        assert bpe.Decoder(own).feed(own.encode(t)) == (t or "")


def test_merges_that_are_not_proper():
    import json

    with open(place("byte_bpe_50k.json"), encoding="utf-8") as f:
        data = json.load(f)
    data["model"]["merges"] = [["a", "b"], ["ab", "c"], ["a", "bc"], ["b", "c"]]
    for piece in ("ab", "abc", "bc"):
        data["model"]["vocab"].setdefault(piece, len(data["model"]["vocab"]) + 5)
    with pytest.raises(ValueError, match="proper"):
        bpe.Vocabulary(json.dumps(data))
