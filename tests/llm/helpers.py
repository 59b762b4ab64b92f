"""Small tables with all the odd cases, and brute-force versions."""

import hashlib
import random
import re

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["fingerprint", "component_id", "score", "kept", "doc", "places", "hit", "row", "fp", "salt", "length", "sequence_id", "offset", "piece", "n_words", "held_out", "words", "a", "b", "shard", "sha", "lang_key", "arrival_number", "n_email", "rank"]

random.seed(11)
WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa", "Größe", "naïve", "中文", "the", "of"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (str(r.randint(0, 400)) if r.random() < 0.7 else "") for _ in range(n))


PASSAGE = prose(60, 99)


def odd_rows():
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [
        (0, prose(80, 2), "en", "s0", 1),
        (1, base, "en", "s0", 1),
        (2, base, "en", "s1", None),  # exact copy
        (3, " ".join(near), "de", "s0", 1),  # near copy
        (4, "", "en", "s0", 0),
        (5, None, "en", "s0", None),
        (None, prose(70, 3), None, None, None),
        (7, prose(90, 4) + "\n" + PASSAGE + "\n" + prose(50, 5), "fr", "s1", 1),
        (8, PASSAGE + " " + prose(60, 6), "fr", "s1", 1),
        (9, prose(30000, 7), "en", "s0", 1),  # very long
        (10, "word " * 3000, "en", "s0", 1),
        (11, "\x1c   x  y  z\r\n\tq", "xx", "s0", 1),
        (12, "mail a.b7@ex.org, card 4111 1111 1111 1111, ip 10.0.0.1, tel (555) 123-4567, 2024-02-29", "en", "s0", 1),
        (1, base, "en", "s0", 1),  # repeated row
        (14, "Licensed under CC BY-NC 4.0. All rights reserved. GNU General Public License", "en", "s0", 1),
        (None, None, None, None, None),
        (16, "one", "en", "s0", 1),
        (17, "   \n \t ", "en", "s0", 1),
    ]
    return rows


def odd_docs(spark, clash=True):
    df = spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)
    if clash:
        for c in CLASHING:
            df = df.selectExpr("*", f"'own' as `{c}`")
    return df


def empty_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def fingerprint(text):
    w = words(lower(text))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps, radius=4):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def removed(texts, length=35):
    where = {}
    split = [words(t) for t in texts]
    for d, w in enumerate(split):
        for i in range(len(w) - length + 1):
            where.setdefault(tuple(w[i : i + length]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    out = []
    for w, g in zip(split, gone, strict=True):
        kept = [x for i, x in enumerate(w) if i not in g]
        out.append((len(w), len(g), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out
