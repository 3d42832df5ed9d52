"""Word ids from the vocabulary's ranks against the plain tokenizer."""

from __future__ import annotations

import random

import public_tokenizers
import pyarrow.parquet as pq
import pytest

from gazeframe.llm import tokens

PATH = tokens.default_path()


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


def plain(encoder, text: str) -> bytes:
    ids = encoder.tokenizer.encode(text, add_special_tokens=False).ids
    return b"".join(i.to_bytes(4, "little") for i in [*ids, 2])


def test_every_token_rebuilds_by_its_own_pair():
    ranks = tokens.word_ranks(PATH)
    assert len(ranks) == 49406 and ranks[b"the\0"] > 511
    # "abc" is listed as a + bc, but ab is merged first.
    ranks = {b"a": 0, b"b": 1, b"c": 2, b"ab": 3, b"bc": 4, b"abc": 5}
    assert tokens.rebuilds([(b"a", b"b"), (b"b", b"c"), (b"ab", b"c")], ranks)
    assert not tokens.rebuilds([(b"a", b"b"), (b"b", b"c"), (b"a", b"bc")], ranks)


def test_other_vocabularies_are_left_to_the_tokenizer():
    assert tokens.word_ranks(public_tokenizers.path("byte_bpe_50k.json")) is None


def test_ranks_give_the_tokenizers_ids_for_all_words_of_a_table(encoder):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    words = list({w for t in texts if t for w in t.encode().split()})
    assert encoder._learn(words) == encoder._by_tokenizer(words)


def test_ranks_give_the_tokenizers_ids_for_made_up_words(encoder):
    draw = random.Random(5)
    letters = [chr(c) for c in [*range(33, 127), *range(161, 256)]]
    words = {"".join(draw.choices(letters, k=draw.randint(1, 12))) for _ in range(20_000)}
    words |= {"".join(draw.choices("aeinrst'lvdmAÉß.!</w>0²", k=draw.randint(1, 30))) for _ in range(20_000)}
    some = [w.encode() for w in words if "<|" not in w]
    assert encoder._by_ranks([(w, w.decode()) for w in some]) == encoder._by_tokenizer(some)


@pytest.mark.parametrize(
    "text",
    ["", " ", "It'S  we'LL.", "été İstanbul ẞ", " a\u0085b\x1cc", "nul\0byte a\0", "<|endoftext|> A<|x|>", "中文 한국", "x" * 5000, "­ µª²"],
)
def test_texts_of_any_characters(encoder, text):
    assert encoder.encode([text.encode()], 2) == [plain(encoder, text)]


def test_the_table_of_words_stays_bounded(encoder, monkeypatch):
    made = tokens.Encoder(PATH)
    monkeypatch.setattr(tokens, "KNOWN_WORDS", 10)
    texts = [" ".join(f"w{i}x{j}" for j in range(30)) + " " + "y" * 500 for i in range(5)]
    for text in texts:
        assert made.encode([text.encode()], 2) == [plain(encoder, text)]
        assert len(made.known) <= 10 + 30 and max(map(len, made.known)) <= tokens.LONG_WORD
    assert made.encode([None], 2) == [(2).to_bytes(4, "little")]
