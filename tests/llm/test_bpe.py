import random

import pytest
from tokenizers import Tokenizer

from lathework.llm.bpe import TOKENIZER, Decoder, Encoder, MergeList, Transducer, count_tokens, decode_ids, encode_texts


@pytest.fixture(scope="module")
def merges():
    return MergeList()


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(TOKENIZER)
    tokenizer.encode_special_tokens = True
    return tokenizer


def samples():
    rnd = random.Random(7)
    alphabets = ["abcdefgh", "aAbBeE ", "0123456789", "!?,.-=_ ", "   \n\t x", "'s'll're d", "äöüéß", "日本語中文", "ÃÂ", "= -", "​ "]
    texts = ["", " ", "\n", "   ", "'", "'l", "'ll", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "\n" * 2000, "=-" * 2000, "é" * 1500, "🎉" * 400, " 1" * 900]
    for _ in range(120):
        text = ""
        for _ in range(rnd.choice([1, 5, 20])):
            if rnd.random() < 0.8:
                text += "".join(rnd.choice(rnd.choice(alphabets)) for _ in range(rnd.choice([1, 3, 40])))
            else:
                text += rnd.choice("a= \n-é1") * rnd.choice([5, 700])
        texts.append(text)
    return texts


@pytest.mark.parametrize(("block", "held"), [(1 << 16, 512), (50, 20), (7, 5), (1, 3)])
def test_stream_equals_the_library(merges, library, block, held):
    encoder = Encoder(merges, block, held)
    for text in samples():
        assert encoder.encode(text) == library.encode(text, add_special_tokens=False).ids, repr(text[:60])


WORDS = [b"abcdefghijklmnopqrstuvwxyz", b"ab", b" ", b"=-", b"-", bytes(range(256)), "éèüñ".encode(), b"etaoinshrdlu"]


@pytest.mark.parametrize("letters", WORDS)
def test_window_is_constant_and_tokens_come_once_stable(merges, letters):
    rnd = random.Random(1)
    through, got, most = Transducer(merges), [], 0
    word = bytes(rnd.choice(letters) for _ in range(8000))
    for byte in word:
        got += through.feed(bytes([byte]))
        most = max(most, len(through.data))
    assert got and most <= 2 * merges.lookahead + 2
    assert got + through.close() == merges.merged(word)


@pytest.mark.parametrize("letters", WORDS)
def test_lookahead_suffices(merges, letters):
    """No continuation changes a token that ends ``lookahead`` bytes before the end."""
    rnd = random.Random(2)
    for _ in range(40):
        start = bytes(rnd.choice(letters) for _ in range(rnd.randint(merges.lookahead, 2 * merges.lookahead)))
        stable, end = [], 0
        for token in merges.merged(start):
            end += len(merges.bytes_of[token])
            if end > len(start) - merges.lookahead:
                break
            stable.append(token)
        longer = merges.merged(start + bytes(rnd.choice(letters) for _ in range(rnd.randint(1, 200))))
        assert longer[: len(stable)] == stable


def test_decoder_is_incremental(merges, library):
    for text in samples():
        decoder = Decoder(merges)
        parts = [decoder.feed([i]) for i in library.encode(text, add_special_tokens=False).ids]
        assert "".join([*parts, decoder.close()]) == text


def test_frames(spark):
    rows = [(1, "hello world", "x"), (2, "", None), (3, None, "y"), (None, "a", None), (1, "hello world", "x"), (4, "z" * 100_000, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = encode_texts(frame)
    assert got.columns == ["doc_id", "ids"]
    by = {r.doc_id: list(r.ids) for r in got.collect()}
    assert by[2] == [] and by[3] == [] and len(by) == 5
    assert got.count() == 6
    back = {r.doc_id: r.text for r in decode_ids(got).collect()}
    assert back == {1: "hello world", 2: "", 3: "", None: "a", 4: "z" * 100_000}
    assert {r.doc_id: r.tokens for r in count_tokens(frame).collect()} == {k: len(v) for k, v in by.items()}
    assert encode_texts(frame.filter("doc_id > 9")).collect() == []
