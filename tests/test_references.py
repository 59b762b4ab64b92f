"""Matching of entries with the rows of a source's list, against plain Python over all pairs."""

import random
import re
from difflib import SequenceMatcher

from marginalia.operators import references as X
from marginalia.plans import naming


def key(s):
    s = re.sub(r"[_-]+", " ", re.sub(r"\.(pdf|md)$", "", s.strip(), flags=re.I))
    return re.sub(" +", " ", re.sub(r"[^\w ]", " ", s).lower()).strip()


def score(raw, row, w):
    doi = re.search(r"10\.\d{4,9}/[^\s\"<>]+", raw.lower())
    if doi and row["doi"].lower() == doi.group():
        return 1.0
    if not row["text"]:
        return None
    a, b = key(raw), key(row["text"])
    x, y = set(a.split()), set(b.split())
    s = 0.68 * SequenceMatcher(None, a, b).ratio() + 0.32 * (len(x & y) / len(x | y)) if a and b else 0.0
    years = re.findall(r"(?:19|20)\d{2}", raw)
    if years:
        gap = abs(int(row["year"]) - int(years[-1])) if row["year"] else None
        s += w["year"] if gap == 0 else w["near"] if gap == 1 else -w["other_year"]
    plain = re.sub(r"^\s*(\[\d+\]|\d+\.)\s*", "", raw)
    words = re.findall("[A-Za-z]+", plain.split(",")[0])
    author = max(words, key=len).lower() if words else ""
    if author:
        s += w["author"] if author in row["author"].lower() else -w["other_author"]
    s += w["doi"] if row["doi"] else 0
    return min(max(s, 0), 1)


def mapped(refs, rows):
    """refs: num -> raw; rows: a list."""
    nums = sorted(refs)
    inside = [n for n in nums if n <= len(rows) and refs[n].strip()]
    aligned = True
    if len(inside) >= 4:
        at = {0, 1, 2, len(inside) // 2 - 1, len(inside) // 2, len(inside) - 3, len(inside) - 2, len(inside) - 1}
        told = [n for n in (inside[i] for i in sorted(at)) if len(re.findall("[A-Za-z]{2,}", rows[n - 1]["text"])) >= 4 or (rows[n - 1]["doi"] and "10." in refs[n])]
        s = [x for x in (score(refs[n], rows[n - 1], X.STRICT) for n in told) if x is not None]
        if len(s) >= 3:
            aligned = sum(x >= 0.56 for x in s) >= max(3, int(len(s) * 0.6 + 0.999)) and sum(x >= 0.66 for x in s) >= max(2, int(len(s) * 0.3 + 0.999)) and sum(s) / len(s) >= 0.58
    exact = aligned and nums == list(range(1, len(rows) + 1))
    m = min(len(rows), len(nums))
    prefix = aligned and nums[:m] == list(range(1, m + 1))
    loose = aligned and len(nums) >= 8 and sum(n <= len(rows) for n in nums) / len(nums) >= 0.75
    out = {}
    for n in nums:
        if n <= len(rows):
            lenient = score(refs[n], rows[n - 1], X.LENIENT)
            how = "order" if exact or prefix else "number" if lenient is not None and round(lenient, 6) >= X.NUMBER_FLOOR else "loose" if loose else None
            if how:
                out[n] = (n, how, lenient)
                continue
        found = [(round(x, 6), -p) for p, row in enumerate(rows, 1) if (x := score(refs[n], row, X.STRICT)) is not None and round(x, 6) >= X.CONTENT_FLOOR]
        if found:
            best, p = max(found)
            out[n] = (-p, "content", best)
    return out


def test_match_rows_against_all_pairs(spark):
    r = random.Random(3)
    words = [f"{a}{b}" for a in ("spec", "imag", "lens", "phot", "noise", "deep", "fast", "net") for b in ("tral", "ing", "ier", "on", "s", "er")]
    docs, lists = {}, {}
    for d in range(24):
        own = [(f"{r.choice(words).title()}, {' '.join(r.choice(words) for _ in range(r.randint(6, 12)))}. Venue {r.randint(1990, 2022)}") for _ in range(r.randint(3, 12))]
        refs = {n: f"[{n}] {t}" + (f" doi 10.1000/{d}.{n}" if r.random() < 0.2 else "") for n, t in enumerate(own, 1) if r.random() < 0.95 or d % 2}
        rows = []
        for n, t in enumerate(own, 1):
            kept = " ".join(w for w in t.split() if r.random() < (1.0, 0.8, 0.4)[d % 3])
            rows.append({"text": "" if r.random() < 0.05 else kept, "doi": f"10.1000/{d}.{n}" if r.random() < 0.2 else "", "year": re.search(r"\d{4}", t).group() if r.random() < 0.7 else "", "author": t.split(",")[0] if r.random() < 0.7 else ""})
        if d % 4 == 1:
            r.shuffle(rows)
        if d % 4 == 2:
            rows = rows[1:]
        docs[d], lists[d] = refs, rows
    entries = spark.createDataFrame([(d, n, raw) for d, refs in docs.items() for n, raw in refs.items()], "doc_id long, num int, raw string")
    listed = spark.createDataFrame([(d, p, x["text"], x["doi"], x["year"], x["author"]) for d, rows in lists.items() for p, x in enumerate(rows, 1)], "doc_id long, pos int, text string, doi string, year string, author string")
    got = {(x["doc_id"], x["num"]): (x["pos"], x["method"], x["score"]) for x in X.match_rows(entries, listed).collect()}
    want = {(d, n): v for d in docs for n, v in mapped(docs[d], lists[d]).items()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    assert all((v[2] is None) == (want[k][2] is None) and (v[2] is None or abs(v[2] - want[k][2]) < 1e-5) for k, v in got.items())
    assert {v[1] for v in got.values()} == {"order", "number", "loose", "content"} or {v[1] for v in got.values()} >= {"order", "number", "content"}


SF = "/root/testdata/sf0.001"


def similar(a, b, w):
    x, y = key(a), key(b)
    if not x or not y:
        return 0.0
    p, q = set(x.split()), set(y.split())
    return w * SequenceMatcher(None, x, y).ratio() + (1 - w) * len(p & q) / len(p | q)


def venue(a, b):
    x, y = key(a), key(b)
    if not x or not y:
        return 0.0
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.92
    p, q = (key(re.sub("([a-z])([A-Z])", r"\1 \2", v).replace("&", " and ")).split() for v in (a, b))
    s, t = ("".join(w[:4] for w in v) for v in (p, q))
    if s and t and (s in t or t in s):
        return 0.96
    if p and [w[0] for w in p] == [w[0] for w in q]:
        return 0.94
    return similar(a, b, 0.72)


def test_records_of_titles_against_all_candidates(spark):
    docs = {r["doc_id"]: r for r in naming._named(spark, SF).collect()}
    found = {}
    for r in naming._searched(spark, SF).collect():
        found.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, doc in docs.items():
        title, year, place = doc["title"], doc["year"] if d % 3 == 0 else "", doc["venue"] if d % 3 == 1 else ""
        best = None
        for c in sorted(found[d], key=lambda c: c["rank"]):
            t, same, fit = similar(title, c["title"], 0.72), year == c["year"] and year != "", venue(place, c["venue"]) if place else 0.0
            s = round(t + (0 if not year else 0.06 if same else -0.10) + (0.05 * (2 * fit - 1) if place else 0), 9)
            by_doi = c["doi"] == f"10.1/{d}" and (not title or t >= 0.80)
            if best is None or (by_doi, s, fit, same) > best[:4]:
                best = (by_doi, s, fit, same, t, c["rank"])
        by_doi, s, fit, same, t, rank = best
        gate = same if year else fit >= 0.90 if place else t >= 0.94 and s >= 0.96
        if by_doi or (title and gate and s >= 0.90 and t >= 0.88):
            want[d] = (rank, "doi" if by_doi else "title", round(max(0.97, t) if by_doi else min(max(s, 0), 1), 4))
    got = {r["want_id"]: (r["rank"], r["method"], r["score"]) for r in naming.title_records(spark, SF).collect()}
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()} and all(abs(v[2] - want[k][2]) <= 1.01e-4 for k, v in got.items())
    assert {v[1] for v in got.values()} == {"doi", "title"} and 20 < len(got) < len(docs)


def test_records_of_texts_against_all_candidates(spark):
    docs = {r["doc_id"]: r for r in naming._named(spark, SF).collect()}
    found = {}
    for r in naming._searched(spark, SF).collect():
        found.setdefault(r["doc_id"], []).append(r)
    want = {}
    for d, doc in docs.items():
        raw = f"{doc['head']}, {doc['title']}, {doc['venue']}, {doc['year']}"
        if not (24 <= len(raw) <= 420 and len(re.findall("[A-Za-z]{3,}", raw)) >= 4):
            continue
        words = re.findall("[A-Za-z]+", re.sub(r"\s+", " ", raw).strip(" ").split(",")[0])
        author = max(words, key=len).lower() if words else ""
        year, best = int(re.findall(r"(?:19|20)\d{2}", raw)[-1]), None
        for c in sorted(found[d], key=lambda c: c["rank"]):
            text = " ".join([c["authors"][0], c["title"], c["venue"], c["year"]])
            gap, names = abs(int(c["year"]) - year), [a.lower() for a in c["authors"]]
            s = similar(raw, text, 0.64) + (0.18 if gap == 0 else 0.06 if gap == 1 else -0.12) + ((0.14 if author in names else -0.08) if author else 0) + (0.03 if c["doi"] else 0)
            s = round(min(max(s, 0), 1), 9)
            if best is None or s > best[0]:
                best = (s, gap == 0, author in names, c["rank"])
        s, same_year, same_author, rank = best
        if s >= 0.62 and (same_year or s >= 0.72) and (not author or same_author or s >= 0.74):
            want[d] = (rank, round(s, 4))
    got = {r["want_id"]: (r["rank"], r["score"]) for r in naming.text_records(spark, SF).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(v[1] - want[k][1]) <= 1.01e-4 for k, v in got.items()) and len(got) > 20


def test_equal_pairs_are_scored_in_one_task_and_compared_once(spark):
    """the same two texts were compared anew for each document that has them."""
    import random
    from difflib import SequenceMatcher

    from pyspark.sql import functions as F

    from marginalia.functions import scoring
    from marginalia.operators import references

    r = random.Random(3)
    long = ["".join(r.choice("etaoin shrdluxq") for _ in range(n)) for n in (0, 1, 199, 200, 450, 5000)]
    scoring._known.cache_clear()
    for x in long:
        assert scoring.ratio_of(x, x) == SequenceMatcher(None, x, x).ratio() == 1.0
        for y in [*long[:5], x[3:] + "z"] * 2:
            assert scoring.ratio_of(x, y) == SequenceMatcher(None, x, y).ratio()
    assert scoring._known.cache_info().hits > 20 and scoring.ratio_of(None, "a") == 0.0
    rows = [(i, f"[1] Doe J. A title about number {i % 3}. 2019", f"A title about number {i % 3 + i % 2}", "", "2019", "Doe") for i in range(60)]
    scored = references._scored(spark.createDataFrame(rows, "doc_id long, raw string, row_text string, doi string, year string, author string").repartition(4), references.STRICT)
    tasks = scored.withColumn("task", F.spark_partition_id()).groupBy("raw", "row_text").agg(F.countDistinct("task").alias("tasks"), F.countDistinct("score").alias("scores"), F.count("*").alias("n")).collect()
    assert len(tasks) == 6 and {(t["tasks"], t["scores"], t["n"]) for t in tasks} == {(1, 1, 10)}


def test_ratio_of_short_strings_is_difflibs():
    from marginalia.functions import scoring

    r = random.Random(5)
    for letters in ("ab", "abc d", "abcdefgh 中😀"):
        for _ in range(400):
            x, y = ("".join(r.choice(letters) for _ in range(r.randint(0, n))) for n in (300, 190))
            if x or y:
                assert 2.0 * scoring._matched(x, y) / (len(x) + len(y)) == SequenceMatcher(None, x, y).ratio()
    for n in (199, 200, 260):  # from 200 characters on difflib leaves out the frequent ones
        x, y = ("".join(r.choice("abcdefgh ijk") for _ in range(n)) for _ in range(2))
        assert scoring.ratio_of(x, y) == SequenceMatcher(None, x, y).ratio()


def test_names_come_from_the_first_words_alone(spark, tmp_path):
    texts = [None, "", "12 \n 3", "One", "one, two-three\nfour 5 six中seven", " ".join(f"w{chr(97 + i)}{i}" for i in range(26)), "x " * 18 + "last", "--a" * 19 + "!", "z" * 5000 + " y"]
    spark.createDataFrame([(i, "s", "en", t) for i, t in enumerate(texts)], "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    named = naming._named(spark, tmp_path)
    for r in named.collect():
        words = re.findall("[A-Za-z]+", texts[r["doc_id"]] or "")
        assert (r["head"], r["title"]) == (" ".join(words[:3]), " ".join(words[3:19]))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(regexp_extract(" in plan.replace("coalesce(", "")  # the whole text isn't searched for each use


def test_contents_of_many_documents_are_compared_once(spark):
    """the texts of each pair of a document's entries and rows were shuffled and read anew, though many documents say the same."""
    from marginalia.operators import references

    own = [f"[{n}] {x}. {2000 + n}" for n, x in enumerate(("Lens of clear quartz glass", "Counting photons one by one", "Why any noise may vary", "Deep nets make quick sums", "How grey old images fade", "Fast snapshots with two keys"), 1)]
    listed = [(x[4:], f"10.1000/{n}" if n == 2 else None, "2013" if n == 3 else "", "Doe" if n % 2 else None) for n, x in enumerate(own, 1)]
    entries = [(d, n, x) for d in range(30) for n, x in enumerate(own, 1)]
    rows = [(d, (n + d) % 6 + 1, *x) for d in range(30) for n, x in enumerate(listed)] + [(30, 1, None, None, None, None)]
    refs = spark.createDataFrame(entries + [(30, 1, own[0]), (31, 1, own[0])], "doc_id long, num int, raw string")
    table = spark.createDataFrame(rows, "doc_id long, pos int, text string, doi string, year string, author string")
    lists = references._Lists(refs, table)
    assert lists.entries.count() == 6 and lists.sources.count() == 7
    pairs = lists.refs.join(lists.rows, "doc_id")
    scored = lists.scored(pairs, references.STRICT)
    assert scored.count() == pairs.count() == 30 * 36 + 1 and scored.where("score is null").count() == 1
    plain = lambda x: {"text": x[0], "doi": x[1] or "", "year": x[2], "author": x[3] or ""}
    want = {(d, n): v for d in range(30) for n, v in mapped(dict(enumerate(own, 1)), [plain(r[2:]) for r in sorted(r for r in rows if r[0] == d)]).items()}
    got = {(x["doc_id"], x["num"]): (x["pos"], x["method"]) for x in X.match_rows(refs, table).collect()}
    assert got == {**{k: v[:2] for k, v in want.items()}, (30, 1): (1, "order")} and {"order", "content"} <= {v[1] for v in got.values()}
