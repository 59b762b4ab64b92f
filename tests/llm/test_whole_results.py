"""Results that must be whole: pairs at the threshold, groups without ids, ids of texts with added tokens."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from marginalia.llm import decontamination, packing, simhash, wavelet
from marginalia.llm.tokens import encoder, public_path
from marginalia.llm.words import PUNCTUATION, words_of

from .helpers import components, fingerprint, prose


def best_share(item, text):
    """Plain Smith-Waterman over the whole text, words as lists."""
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(text):
            new.append(max(0, row[j] + (2 if a == b else -1), row[j + 1] - 1, new[j] - 1))
        row, best = new, max(best, *new)
    return best / (2 * len(item))


def edited(words, r, rate):
    out = []
    for w in words:
        x = r.random()
        out += [] if x < rate / 3 else [f"new{r.randint(0, 99)}"] if x < 2 * rate / 3 else [w, f"put{r.randint(0, 99)}"] if x < rate else [w]
    return out


@pytest.mark.parametrize("hits", [2_000_000, 50])
def test_every_pair_at_the_threshold_is_found(spark, monkeypatch, hits):
    """Lone edited copies, with and without exact copies of their item beside them, against all pairs."""
    monkeypatch.setattr(decontamination, "HITS", hits, raising=False)
    r = random.Random(5)
    items = [[f"w{k}x{r.randint(0, 60)}" for _ in range(n)] for k, n in enumerate((40, 41, 25, 15, 3, 40))]
    docs = []
    for item in items:
        for nth in (3, 4, 5, 6):
            docs.append([f"other{i}" if i % nth == nth - 1 else w for i, w in enumerate(item)])
        docs.append([x for i, w in enumerate(item) for x in ([w, f"put{i}"] if i % 2 else [w])])
        docs += [edited(item, r, rate) for rate in (0.2, 0.3, 0.4, 0.5, 0.6, 0.7)]
    docs = [prose(r.randint(0, 30), i).split() + d + prose(r.randint(0, 30), 900 + i).split() for i, d in enumerate(docs)]
    docs += [items[0], items[5]] * 3 + [prose(200, 3).split()]
    split = [[w.decode() for w in _words(" ".join(d))] for d in docs]
    want = {(d, k): share for d, text in enumerate(split) for k, item in enumerate(items) if (share := best_share(item, text)) >= 0.5}
    assert sum(0.5 <= s < 0.75 for s in want.values()) >= 15
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x["score"] for x in decontamination.contamination(table, bench).collect()}
    assert got == want
    assert {x["doc_id"] for x in decontamination.without_contaminated(table, bench).collect()} == set(range(len(docs))) - {d for d, _ in want}


def _words(text):
    import pyarrow as pa

    found = words_of(pa.array([text]), PUNCTUATION, lower=True)
    return [bytes(found.buf[a:b]) for a, b in zip(found.start, found.end, strict=True)]


def test_groups_without_an_id_or_with_the_same_one_stay_apart(spark):
    rows = [(None, prose(90, 60 + i)) for i in range(5)] + [(None, prose(90, 60)), (4, prose(90, 80)), (4, prose(90, 81)), (9, prose(90, 81)), (None, prose(150, 70)), (7, prose(150, 70))]
    comp = components([fingerprint(t) for _, t in rows])
    assert len(set(comp)) == 8
    kept = [tuple(r) for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(map(repr, kept)) == sorted(map(repr, [*rows[:5], *rows[6:8], rows[10]]))


ADDED = ["a b<|endoftext|> c", "<|endoftext|>", "x <|startoftext|>y'<|endoftext|>s", "A <|ENDOFTEXT|> b", "<|endoftext", "it's <|endoftext|><|endoftext|>\n  end", "plain words, here", None, "é\u00a0<|endoftext|>z"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_have_the_ids_of_the_unchanged_library(name):
    import pyarrow as pa

    plain = Tokenizer.from_file(public_path(name))
    ids, offsets = encoder(public_path(name), 7).encode(pa.array(ADDED, pa.string()))
    assert [ids[i:j].tolist() for i, j in zip(offsets[:-1], offsets[1:], strict=True)] == [[*plain.encode(t or "", add_special_tokens=False).ids, 7] for t in ADDED]


def test_queries_with_added_tokens(spark):
    docs = spark.createDataFrame(list(enumerate(ADDED)), "doc_id long, text string").repartition(2)
    for name, end, made in (("byte_bpe_50k.json", 0, packing.pack_documents(docs)), ("word_bpe_49k.json", 1, wavelet.token_shards(docs))):
        plain = Tokenizer.from_file(public_path(name))
        want = {d: zlib.crc32(np.array([*plain.encode(t or "", add_special_tokens=False).ids, end], "<u4").tobytes()) for d, t in enumerate(ADDED)}
        assert {r["doc_id"]: r["ids_crc32"] for r in made.collect()} == want
