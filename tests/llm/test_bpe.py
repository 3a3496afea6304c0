import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleaner.llm.bpe import Decoder, Encoder, Transducer, Vocabulary, ids_of, sufficient_lookahead

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIB = Tokenizer.from_file(PATH)
ENC = Encoder(PATH)
ALPHABET = ["the ", "don't ", "'ll", "'", " ", "  ", "\n", "\t", "é", "ß", "日本", "́", "꟏", "\U0001f600", "123", "!?", "<|endoftext|>", "<|endof", "x" * 7, " " * 9, "\x1c", "\x85", "　", "s", "ll", "՘"]


def ids(text, chunk):
    return list(ids_of(b"".join(ENC.encode(text, chunk))))


@pytest.mark.parametrize("chunk", [1, 3, 17, 1 << 16])
def test_random_texts_equal_the_library(chunk):
    rnd = random.Random(chunk)
    for _ in range(300):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(30)))
        assert ids(text, chunk) == LIB.encode(text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("unit", ["a", " ", "ab", "é", "-", "7", "\n", "=-", "antidisestablishment", "aab"])
@pytest.mark.parametrize("chunk", [50, 1000])
def test_very_long_pretokens(unit, chunk):
    for end in ("", "z", " z", "\n"):
        text = "pre " + unit * (3000 // len(unit)) + end
        assert ids(text, chunk) == LIB.encode(text, add_special_tokens=False).ids


def test_transducer_memory_is_bounded():
    t, v = Transducer(ENC.v), ENC.v
    rnd = random.Random(1)
    out, text = [], bytes(rnd.choice(b"abcdefgh") for _ in range(20_000))
    for i in range(0, len(text), 100):
        out += t.feed(text[i : i + 100])
        assert len(t.data) < 2 * v.lookahead
    assert out + t.close() == LIB.encode(text.decode(), add_special_tokens=False).ids


def test_decoder_is_incremental_and_lossy_like_the_library():
    v = Vocabulary(PATH)
    rnd = random.Random(2)
    for _ in range(100):
        some = [rnd.randrange(50257) for _ in range(20)]
        d = Decoder(v)
        assert "".join(d.feed([i]) for i in some) + d.close() == LIB.decode(some, skip_special_tokens=False)


class Small(Vocabulary):
    """A vocabulary of given merges over a few letters."""

    def __init__(self, letters, pairs):
        self.bytes_of = {i: bytes([c]) for i, c in enumerate(letters)}
        self.single = {c: i for i, c in enumerate(letters)}
        self.merges = {}
        for rank, (a, b) in enumerate(pairs):
            self.bytes_of[len(letters) + rank] = self.bytes_of[a] + self.bytes_of[b]
            self.merges[a, b] = (rank, len(letters) + rank)
        self.lookahead = sufficient_lookahead(self.merges, {i: len(t) for i, t in self.bytes_of.items()})
        self.lookahead = max(self.lookahead, *map(len, self.bytes_of.values()))


def test_lookahead_is_sufficient_for_random_merge_lists():
    rnd = random.Random(3)
    for _ in range(60):
        pairs = []
        while len(pairs) < 8:
            pair = (rnd.randrange(2 + len(pairs)), rnd.randrange(2 + len(pairs)))
            if pair not in pairs:
                pairs.append(pair)
        v = Small(b"ab", pairs)
        for _ in range(60):
            text = bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(1, 3 * v.lookahead + 9)))
            t, out = Transducer(v), []
            for i in range(0, len(text), 3):
                out += t.feed(text[i : i + 3])
            whole = v.merge(text)
            assert out + t.close() == whole
            ends, at = set(), 0
            for token in whole:
                at += len(v.bytes_of[token])
                ends.add(at)
            short, at = v.merge(text[: (n := rnd.randrange(len(text) + 1))]), 0
            for token in short:
                at += len(v.bytes_of[token])
                assert at in ends or at > n - v.lookahead


def test_the_heap_merges_like_the_list():
    rnd = random.Random(4)
    v = ENC.v
    for _ in range(200):
        data = bytes(rnd.choice(b"aaab the-") for _ in range(rnd.randrange(1, 60)))
        assert v._merge_by_heap([v.single[b] for b in data]) == v.merge(data)


def test_unordered_rules_are_refused():
    with pytest.raises(ValueError, match="before one"):
        sufficient_lookahead({(0, 3): (0, 4), (0, 1): (1, 3)}, {0: 1, 1: 1, 3: 2, 4: 3})
