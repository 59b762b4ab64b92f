"""Words, tokens and hashes of batches against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from marginalia.llm import words as W
from marginalia.llm.tokens import Encoder, public_path

from .helpers import odd_rows, words

TEXTS = [r[1] for r in odd_rows()]
PARTS = ["a", "B", "the", " ", "  ", "\n", "\t", "\r\n", "don't", "'s", "'", "é", "É", "ß", "İ", "—", "1", "23", ".", "!!", "|", "\x00", "\x1c", "\x85", "\xa0", " ", "　", "日本", "😀", "H̱", "_", "<|endoftext|>", "''s", "x'y"]


def random_texts(n):
    r = random.Random(5)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]


def test_words_and_joined():
    texts = TEXTS + random_texts(500)
    found = W.words_of(pa.array(texts, pa.string()))
    data, start, end = found.joined()
    got = [data[a:b].decode() for a, b in zip(start, end, strict=True)]
    assert [got[i:j] for i, j in zip(found.first, found.first[1:], strict=False)] == [words(t) for t in texts]


def test_hashes_are_equal_where_words_are():
    texts = TEXTS + random_texts(300)
    found = W.words_of(pa.array(texts, pa.string()))
    flat = [w for t in texts for w in words(t)]
    h = found.hashes().tolist()
    assert len(set(zip(flat, h, strict=True))) == len(set(flat)) == len(set(h))
    at = found.windows(3)
    grams = [tuple(flat[i : i + 3]) for i in at]
    wh = W.window_hash(found.hashes(), at, 3).tolist()
    assert len(set(zip(grams, wh, strict=True))) == len(set(grams)) == len(set(wh))


def test_slices_cover_all_rows():
    column = pa.array(TEXTS, pa.string())
    spans = list(W.slices(column, 1000))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(TEXTS)))
    assert list(W.slices(column.slice(0, 0))) == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_are_the_librarys(name):
    plain = Tokenizer.from_file(public_path(name))
    plain.encode_special_tokens = True
    texts = TEXTS + random_texts(2000)
    ids, offsets = Encoder(public_path(name), 7).encode(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        assert ids[offsets[k] : offsets[k + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 7], repr(t)
    none, at = Encoder(public_path(name), 7).encode(pa.array([], pa.string()))
    assert len(none) == 0 and np.array_equal(at, [0])
