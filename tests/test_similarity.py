"""Joins by similarity against all pairs."""

import random
import re
from difflib import SequenceMatcher

import pytest

from marginalia.functions import scoring
from marginalia.operators import similarity as S


def mixed_names(n=60, seed=2):
    r = random.Random(seed)
    names = ["", "a", "b", "ab", "abc", "abd", "aaaaaaaaaa", "aaaaaaaaab", "ab" * 300, "ab" * 299 + "b", "customer 000000001", "customer 000000002", "customer 100000001"]
    for _ in range(n):
        name = " ".join("".join(r.choice("abcde") for _ in range(r.randint(1, 7))) for _ in range(r.randint(1, 9)))
        names.append(name)
        for _ in range(3):
            x = list(name)
            for _ in range(r.randint(1, max(1, len(x) // 8))):
                i = r.randrange(len(x) + 1)
                x[i : i + r.randint(0, 1)] = r.choice(["", "q", "e"])
            names.append("".join(x).strip())
    return list(dict.fromkeys(names))


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@pytest.mark.parametrize("floor", [0.82, 0.9])
def test_no_pair_at_the_floor_is_lost(spark, floor):
    names = mixed_names()
    left, right = list(enumerate(names))[::2] + [(9999, names[5])], [(1000 + i, x) for i, x in enumerate(names)][1::2]
    left = [(i, x) for i, x in left if x != names[5] or i != 9999]
    want = sorted((i, j, round(ratio(a, b), 9)) for i, a in left for j, b in right if a and b and a != b and ratio(a, b) >= floor)
    table = lambda rows: spark.createDataFrame(rows, "id long, name string").repartition(3)
    got = sorted((r["left_id"], r["right_id"], round(r["ratio"], 9)) for r in S.similar_pairs(table(left), table(right), floor).collect())
    assert got == want and len(want) > 30
    with pytest.raises(ValueError):
        S.similar_pairs(table(left), table(right), 0.5)


def test_a_run_that_all_names_have_makes_few_pairs(spark):
    """Names with a common part: only those meet that share a rare run."""
    r = random.Random(1)
    rows = [(i, "the proceedings of " + "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(24))) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, name string")
    frequency = S._runs(t).groupBy("run").count().withColumnRenamed("count", "often")
    rare = S._rarest(S._runs(t), frequency, 0.9)
    assert rare.join(rare.withColumnRenamed("id", "other"), "run").where("id < other").select("id", "other").distinct().count() < 0.35 * 400 * 399 / 2


def test_nearest_names_with_repeated_null_and_empty_ones(spark):
    names = mixed_names(25, 4)
    rows = list(enumerate(names)) + [(500 + i, names[3 + i % 4]) for i in range(9)] + [(600, None), (601, "")]
    want = []
    for i, a in rows:
        if a:
            same = sorted(j for j, b in rows if j != i and b == a)
            near = sorted((-ratio(a, b), j) for j, b in rows if b and b != a and ratio(a, b) >= 0.9)
            if same:
                want.append((i, same[0], 1.0, "equal"))
            elif near:
                want.append((i, near[0][1], round(-near[0][0], 9), "similar"))
    t = spark.createDataFrame(rows, "id long, name string").repartition(4)
    got = sorted((r["left_id"], r["right_id"], round(r["ratio"], 9), r["found"]) for r in S.nearest_others(t).collect())
    assert got == sorted(want) and {"equal", "similar"} == {r[3] for r in want}
    other = spark.createDataFrame([(7, names[8]), (8, names[8]), (9, "zz")], "id long, name string")
    best = {r["left_id"]: (r["right_id"], r["found"]) for r in S.best_names(t, other).collect()}
    assert best[8] == (7, "equal") and 600 not in best


def test_names_and_venues_are_normalised(spark):
    x = spark.createDataFrame([("The Größe–of_Things (v2)", "Proc. of the IEEE Conference on Computer Vision (CVPR), 2019"), (None, None)], "a string, b string")
    got = x.select(S.name_key("a"), S.plain_venue("b"), S.acronym("b")).collect()
    assert tuple(got[0]) == ("the gr e of things v2", ". of the on Computer Vision CVPR", "CVPR") and tuple(got[1]) == ("", "", "")
    short = spark.createDataFrame([("IEEE ICASSP 2020",), ("International Conference on Machine Learning",), ("Nature",)], "b string").select(S.acronym("b")).collect()
    assert [r[0] for r in short] == ["ICASSP", "ICOML", ""]


def test_tiers_against_all_pairs(spark):
    tiers = [(1, "Computer Vision and Pattern Recognition", "CVPR", "A*"), (2, "International Conference on Machine Learning", "ICML", "A*"), (3, "Neural Information Processing Systems", "NIPS", "A*"), (4, "Asian Conference on Machine Learning", "ACML", "B"), (5, "Image Processing", "ICIP", ""), (6, "SIGGRAPH", "X", "A"), (7, None, "CVPR", "C")]
    venues = ["IEEE Conference on Computer Vision and Pattern Recognition (CVPR), 2019", "Conference on Machine Learnin", "Neural Information Processing System", "Siggraph", "Image Processing", "Something else", "ICML", "", None, "International Conference on Machine Learning"]

    def key(s):
        return re.sub(r"[^a-z0-9]+", " ", (s or "").lower().replace("&", " and ")).strip()

    def sim(a, b):
        a, b = key(a), key(b)
        if not a or not b:
            return 0.0
        ta, tb = set(a.split()), set(b.split())
        return 1.0 if a == b else 0.68 * ratio(a, b) + 0.32 * len(ta & tb) / len(ta | tb)

    frame = spark.createDataFrame([(v,) for v in venues], "venue string")
    forms = {r[0]: (r[1], r[2]) for r in frame.select("venue", S.plain_venue("venue"), S.acronym("venue")).collect()}
    want = {}
    for v in venues:
        plain, short = forms[v]
        best = max(((max(sim(v, t), sim(plain, t)) + 1.2 * bool(short and short.upper() == a) + 0.3 * (max(sim(v, t), sim(plain, t), sim(short, t)) >= 0.92), -i, r) for i, t, a, r in tiers if r and t), default=(0,))
        if v and best[0] >= 0.88:
            want[v] = (-best[1], best[2], round(best[0], 6))
    got = {r["venue"]: (r["tier_id"], r["rank"], r["score"]) for r in S.venue_tiers(frame, spark.createDataFrame(tiers, "tier_id long, title string, acronym string, rank string")).collect()}
    assert got == want and len(want) >= 5


def test_long_names_of_one_language_make_few_pairs(spark):
    """names of some hundred characters from the same syllables share most of their runs; nearly all pairs of them used to be compared by difflib."""
    r = random.Random(5)
    parts = ["th", "an", "er", "on", "in", "re", "st", "nd", " ", " the ", "ing", "ha", "or", "es", "tion", "qu", "w", "b", "z", "7"]
    names = list(dict.fromkeys("".join(r.choices(parts, weights=[9] * 15 + [1] * 5, k=r.randint(60, 150))).strip() for _ in range(120)))
    for x in names[:40]:  # copies with changes here and there, or a changed beginning
        y = list(x)
        for _ in range(r.randint(1, len(y) // 14)):
            y[r.randrange(len(y))] = r.choice(["", "x", "th", "7"])
        names += ["".join(y), "zz " + x[r.randint(0, 9) :]]
    names = list(dict.fromkeys(names))
    sides = S._Names(list(range(len(names))), names)
    assert sum(i != j for i, j, *_ in S._promising(sides, sides, 0.9)) < 0.03 * len(names) ** 2
    want = sorted((i, j, round(ratio(a, b), 9)) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and ratio(a, b) >= 0.9)
    t = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    got = sorted((q["left_id"], q["right_id"], round(q["ratio"], 9)) for q in S.similar_pairs(t, t, 0.9).collect())
    assert got == want and sum(len(names[i]) >= 200 for i, _, _ in want) > 30


def test_long_names_without_a_common_run_are_not_compared(spark):
    """names of 200 characters and more of the same words met one another in all pairs, and pairs of 100 and more were compared by difflib for their runs of two."""
    r = random.Random(7)
    words = ["the", "of", "and", "thin", "ering", "tion", "over", "ness", "jump", "quiz", "vex", "book", "was", "in", "that", "hand", "ever", "shan"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    names = [text(r.randint(55, 90)) for _ in range(60)] + [text(r.randint(24, 40)) for _ in range(40)]
    for x in names[:30] + names[60:80]:  # copies with a word here and there
        y = x.split()
        for _ in range(r.randint(1, 1 + len(y) // 20)):
            y[r.randrange(len(y))] = r.choice(["xkq", "vex", ""])
        names.append(re.sub(" +", " ", " ".join(y)).strip())
    names = sorted(set(names))
    similar = lambda m: m.real_quick_ratio() >= 0.9 and m.quick_ratio() >= 0.9 and m.ratio() >= 0.9
    pairs = [(i, j) for i, a in enumerate(names) for j, b in enumerate(names) if i != j and similar(SequenceMatcher(None, a, b))]
    sides = S._Names(list(range(len(names))), names)
    promising = {(sides.ids[i], sides.ids[j]) for i, j, *_ in S._promising(sides, sides, 0.9)}
    assert set(pairs) <= promising and sum(i != j for i, j in promising) < 0.04 * len(names) ** 2 and len(pairs) > 30
    long = S._common_runs(sides, sides, 0.9) > 0
    assert long.sum() > 50 and all(len(sides.names[i]) >= 200 for i in long.nonzero()[0])
    t = spark.createDataFrame(list(enumerate(names)), "id long, name string").repartition(3)
    got = {(q["left_id"], q["right_id"]): q["ratio"] for q in S.similar_pairs(t, t, 0.9).collect()}
    assert got == {(i, j): ratio(names[i], names[j]) for i, j in pairs}


def test_the_ratio_is_that_of_difflib():
    """also of strings in which difflib leaves out the frequent characters, and where it ends early."""
    r = random.Random(3)
    for k in range(1500):
        n = r.choice((3, 40, 199, 200, 201, 320, 700))
        x = "".join(r.choice(("abc" * 9 + "xyz", "etaoin shrdlu" * 2 + "jkqxzvb", "ab")[k % 3]) for _ in range(n))
        y = list(x if r.random() < 0.8 else x[::-1])
        for _ in range(r.randint(0, 1 + n // 12)):
            i = r.randrange(len(y) + 1)
            y[i : i + r.randint(0, 3)] = r.choice(["", "q", "the ", "zz", "xy"])
        if r.random() < 0.2:
            i = r.randrange(len(y) + 1)
            y = y[i:] + y[:i]
        y = "".join(y)
        want = ratio(x, y)
        assert scoring.matching_ratio(x, y) == want and scoring.matching_ratio(x, y, 0.9) in ({want} if want >= 0.9 else {want, 0.0})
    assert scoring.matching_ratio("", "") == 1.0 and scoring.matching_ratio("", "a") == 0.0
