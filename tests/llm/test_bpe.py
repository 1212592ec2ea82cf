import random

import public_tokenizers as P
import pytest
import tiktoken

from lattix.llm.bpe import Encoder, PrefixTable, TextEncoding, Vocabulary, read_ranks

TEXTS = ["", " ", "a", "it's we'll  I'd\n\n x", "Größe café ñandú 😀😀", "The\t\tquick   brown fox 12345!!", "ab" * 3000, "x\r\n \n y  ", "日本語のテキスト", "'" * 50, "a" * 500 + " " * 300]


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder(ranks):
    return Encoder(ranks, P.PATTERN)


def noise(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(["a", "e", "th", "ion", " ", " ", "é", "ß", "'", "s", "re", "ll", "\n", "1", "$$", "ż", "…"]) for _ in range(n))


def test_same_ids_as_the_library(encoder, library):
    for text in TEXTS + [noise(k, 200) for k in range(60)]:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()
        assert encoder.decode_decimal(encoder.decimal(text)) == text.encode()


def test_append_and_replace_of_bytes(ranks):
    v = Vocabulary(ranks)
    r = random.Random(5)
    for k in range(25):
        data = noise(k, 60).replace(" ", "").encode()
        t = PrefixTable(v, data[:20])
        t.append(data[20:])
        assert t.tokens() == PrefixTable(v, data).tokens()
        a = r.randrange(len(data))
        b = min(len(data), a + r.randrange(6))
        new = noise(k + 99, r.randrange(4)).encode()
        t.replace(a, b, new)
        assert t.data == data[:a] + new + data[b:]
        assert t.tokens() == PrefixTable(v, t.data).tokens()


def test_edit_of_a_long_string_is_local(ranks):
    v = Vocabulary(ranks)
    data = noise(3, 4000).replace(" ", "").encode()
    t = PrefixTable(v, data)
    t.steps = 0
    t.replace(10, 11, b"q")
    assert t.tokens() == PrefixTable(v, data[:10] + b"q" + data[11:]).tokens()
    assert t.steps < 400


def test_append_and_replace_of_text(encoder, library):
    r = random.Random(7)
    for k in range(60):
        text = noise(k, 50)
        t = TextEncoding(encoder, text[:17])
        t.append(text[17:])
        assert t.tokens() == library.encode_ordinary(text)
        for _ in range(3):
            a = r.randrange(len(t.text) + 1)
            b = min(len(t.text), a + r.randrange(8))
            new = noise(r.randrange(10**6), r.randrange(5))
            want = t.text[:a] + new + t.text[b:]
            t.replace(a, b, new)
            assert t.text == want
            assert t.tokens() == library.encode_ordinary(want)
