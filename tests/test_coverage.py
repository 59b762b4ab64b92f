"""Bindings, contract and coverage of claims against plain Python."""

import re
from difflib import SequenceMatcher
from math import sqrt

import pytest
from pyspark.sql import functions as F

from marginalia.operators import coverage as C

BY = ["a"]
CLAIM = "a int, seg_no int, segment string, kind string, doc_id int, block_id string, order_index int, mode string, heading string"
BLOCK = "doc_id int, block_id string, order_index int, kind string, line string, heading_path string, anchor_id string, is_caption boolean, number int"


def norm(x):
    return re.sub(r"[\s_]+", " ", x.lower()).strip()


def words(x):
    return set(re.findall("[a-z0-9]{2,}", x.lower()))


def over(a, b):
    return len(a & b) / sqrt(len(a) * len(b)) if a and b else 0.0


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def formula_words(x):
    return {t.lower() for p in (r"\\[a-zA-Z]{2,}", r"[A-Za-z](?:_[A-Za-z0-9]+)?(?:\^[A-Za-z0-9]+)?", r"\b\d{1,4}\b") for t in re.findall(p, x)}


def formula_key(x):
    x = x.lower()
    for p in (r"\$+", r"\\tag\{\s*\d{1,4}\s*\}", r"\\(?:left|right|mathbf|mathrm)\b", "[{}]", r"\\[,;:!]", r"\s+"):
        x = re.sub(p, "", x)
    return x


def similar(a, b):
    a, b = formula_key(a), formula_key(b)
    return ratio(a, b) if a and b else 0.0


def quote_score(seed, body, kind, under):
    q, b = norm(seed), norm(body)
    score = 1.54 * (q in b)
    parts = list(dict.fromkeys(p for p in (norm(v).strip(" \"'`*[](){}") for v in re.split(r"\s+…\s+", re.sub(C.OMISSION, " … ", seed))) if len(p) >= 14))[:4]
    if len(parts) >= 2:
        n = at = 0
        for p in parts:
            at = b.find(p, at)
            if at < 0:
                break
            n, at = n + 1, at + len(p)
        score += (0.26 * n + 0.84 * (n >= 2) + 0.24 * (n >= len(parts))) if n else 0
    best = max((1.2 if norm(s) == q else 0.82 if norm(s) in q or q in norm(s) else 0.0) + over(words(seed), words(s)) + 0.28 * ratio(q[:420], norm(s)[:420]) for s in [v for v in re.split(r"(?<=[.!;:])\s+", body) if v.strip()][:16])
    return round(score + 0.92 * best + 0.52 * over(words(seed), words(body)) + 0.34 * ratio(q[:520], b[:520]) + 0.08 * over(words(seed), words(under)) + 0.05 * (kind in ("paragraph", "blockquote")), 6)


SENTENCES = [
    "The detector counts single photons in every pixel. It saturates at high flux.", "Noise of the detector grows with the temperature of the chip.", "We train the network for ninety epochs on simulated scenes.",
    "The loss is the mean error of all pixels; a prior keeps it smooth.", "Results on real scenes agree with simulated ones. The error stays below two percent.", "", "Photons.",
]


def blocks(spark):
    rows = [(d, f"b{i}", i + 1, ("paragraph", "list_item", "heading", "blockquote")[(i + d) % 4], SENTENCES[(i * 3 + d) % len(SENTENCES)], "Methods of the detector" if i % 2 else "", "x", False, 0) for d in (1, 2) for i in range(9)]
    return spark.createDataFrame(rows, BLOCK), rows


def test_quotations_are_bound_as_by_all_pairs(spark):
    df, rows = blocks(spark)
    said = [
        "They say \"counts single photons in every pixel\" there.", "As “The detector counts ... saturates at high flux” says", "\"the loss is the mean error [...] a prior keeps it smooth\"", "> We train the network for ninety epochs on simulated scenes.",
        "\"nothing of this kind was ever written\"", "\"Noise of the detector grows\" and \"agree with simulated ones\"", "> 。", None, "> error below two percent", "\"simulated scenes\" or \"temperature of the chip\"",
    ]
    have = [None, "b4", "b1", "gone", "b0", None, None, None, "b2", "b7"]
    claims = [(1, i, s, "blockquote" if (s or "").startswith(">") else "paragraph", 1 + i % 2, have[i], None, "direct", "") for i, s in enumerate(said)]
    typed = C.claim_types(spark.createDataFrame(claims, CLAIM))
    got = {r.seg_no: (r.block_id, r.score) for r in C.quote_bindings(typed, df, BY).collect()}
    want = {}
    for _, i, s, kind, doc, own, *_ in claims:
        spans = [m for p in C.QUOTES for m in re.findall(p, s or "") if len(m) >= 12]
        seeds = spans or ([s.lstrip("> ")] if kind == "blockquote" else [])
        scores = {}
        for d, b, order, k, line, under, *_ in rows:
            met = [v for v in seeds if words(v) & words(line) or len(words(v)) < 3]
            if d == doc and line and met:
                scores[b] = (max(quote_score(v, line, k, under) for v in met), -order, k)
        mine = scores.get(own, (-1,))[0]
        best = max(((v[0], v[1], b) for b, v in scores.items() if v[2] in C.PROSE), default=None)
        if best and best[0] >= C.QUOTE_FLOOR and (best[2] == own or mine <= 0 or best[0] >= mine + C.QUOTE_GAIN):
            want[i] = (best[2], best[0])
    assert got.keys() == want.keys() and len(want) >= 4
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)


def test_equations_are_bound_as_by_all_pairs(spark):
    eqs = [(1, "e1", "x", "Methods", 3, "$$ E = m c^2 \\tag{3} $$"), (1, "e2", "", "", 3, "$$ E = \\sum x_i \\tag{3} $$"), (1, "e3", "x", "", 4, "$$ a = b \\tag{4} $$"), (2, "e1", "x", "", 3, "$$ E = m c^2 \\tag{3} $$"), (1, "e4", "x", "Methods", 3, "$$ E = m c^2 \\tag{3} $$")]
    claims = [(1, 1, "$$ E = m c^2 \\tag{3} $$", "equation", 1, None, None, "direct", ""), (1, 2, "$$ E = \\sum x_i \\tag{3} $$", "equation", 1, "e2", 2, "direct", ""), (1, 3, "$$ q = 1 \\tag{9} $$", "equation", 1, None, None, "direct", ""), (1, 4, "eq. (4) says a", "paragraph", 1, None, None, "direct", "")]
    typed = C.claim_types(spark.createDataFrame(claims, CLAIM))
    frame = spark.createDataFrame(eqs, "doc_id int, block_id string, anchor_id string, heading_path string, number int, tex string")
    got = {r.seg_no: (r.block_id, r.score) for r in C.equation_bindings(typed, frame, BY).collect()}
    want = {}
    for _, i, s, _, doc, own, *_ in claims[:2]:
        want[i] = max(((round(12 + 0.6 * bool(a) + 0.3 * (own == b) + 1.8 * over(formula_words(s), formula_words(t)) + 1.2 * similar(s, t) + 0.4 * (h == "Methods"), 6), b) for d, b, a, h, n, t in eqs if d == doc and n == 3), key=lambda v: (v[0], [-ord(c) for c in v[1]]))[::-1]
    assert got.keys() == want.keys() and got[1][0] == "e1"
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 2e-6 for i in want)


READY = "a int, seg_no int, segment string, claim_type string, mode string, outside boolean, must_locate boolean, block_id string, order_index int, anchor_text string, number int, align double, heading string"
FORMULA = "$$ E = m c^2 $$"
ROWS = [
    (1, 1, "intro", "critical_fact_claim", "direct", False, False, "b1", 1, "intro", 0, 0.0, ""),
    (1, 2, FORMULA, "formula_claim", "direct", False, False, "b5", 5, FORMULA, 3, 1.5, ""),
    (1, 3, FORMULA, "formula_claim", "direct", False, False, "b5", 5, FORMULA, 0, 1.5, ""),
    (1, 4, "where m denotes the mass", "critical_fact_claim", "direct", False, False, "b6", 6, "m", 0, 0.0, ""),
    (1, 5, "where c is the speed of light", "critical_fact_claim", "direct", False, False, None, None, "c", 0, 0.0, "Methods"),
    (1, 6, "$$ x = y $$", "formula_claim", "direct", False, False, "b8", 8, "$$ x = y $$", 0, 0.2, ""),
    (1, 7, "where y represents the output", "critical_fact_claim", "direct", False, False, "b7", 7, "y", 0, 0.0, ""),
    (1, 8, "\"a quotation of it\"", "quote_claim", "direct", False, False, "b9", 9, "A  quotation of it", 0, 0.0, ""),
    (1, 9, "\"a quotation of it\"", "quote_claim", "direct", False, False, "b9", 9, "a quotation of it", 0, 0.0, ""),
    (1, 10, "$m c$", "inline_formula_claim", "direct", False, False, "b9", 9, "m c", 0, 0.0, ""),
    (1, 11, "$mc$", "inline_formula_claim", "direct", False, False, "b9", 9, "mc", 0, 0.0, ""),
    (1, 12, "Figure 2 shows it", "figure_claim", "direct", False, False, None, None, "Figure 2 shows it", 2, 0.0, "Results"),
    (1, 13, "Figure 3", "figure_claim", "direct", True, False, "b3", 3, "Figure 3", 3, 0.0, ""),
    (1, 14, "well:", "shell_sentence", "direct", False, False, "b1", 1, "", 0, 0.0, ""),
    (1, 15, "must be found", "critical_fact_claim", "synthesis", False, True, None, None, "", 0, 0.0, ""),
    (1, 16, None, "critical_fact_claim", "direct", False, False, "b4", 4, None, 0, 0.0, ""),
    (2, 1, "where m denotes the mass", "critical_fact_claim", "direct", False, False, "b6", 6, "m", 0, 0.0, ""),
    (2, 2, FORMULA, "formula_claim", "direct", False, False, None, None, FORMULA, 0, 0.0, ""),
]


def explained(x, formula, number, far):
    eq = re.search(r"(?i)eq(?:uation)?s?\.?\s*\(?(\d{1,3})\)?", x)
    score = 0.6 * bool(re.search(C.EXPLAINS_FIRST, x)) + 0.42 * bool(re.search(C.EXPLAINS, x)) + 0.5 * bool(number and eq and int(eq[1]) == number)
    return score + 0.58 * over(formula_words(x), formula_words(formula)) + 0.24 * similar(x, formula) + 0.16 * over(words(x), words(formula)) + {1: 0.14, 2: 0.06}[far]


def one_after_another(rows):
    """The contract as a plain loop over the claims of one answer."""
    names = [c.split()[0] for c in READY.split(", ")]
    out = [dict(zip(names, r, strict=True)) for r in sorted(rows, key=lambda r: r[1])]
    for c in out:
        kind, direct = c["claim_type"], c["mode"] == "direct"
        marked = kind in C.MARKED and direct and not c["outside"]
        c["policy"] = "hidden" if c["outside"] or kind == "shell_sentence" else "required" if marked or c["must_locate"] else "optional" if direct else "hidden"
        c["surface"] = "hidden" if c["policy"] != "required" else "secondary" if marked and kind == "inline_formula_claim" else "primary"
        c["origin"] = {"formula_claim": "source", "inline_formula_claim": "explanation"}.get(kind, "") if marked else ""
        spot = c["block_id"] or str(c["seg_no"])
        c["grp"] = "" if not marked or kind == "figure_claim" else ("quote:" if kind in C.QUOTED else "formula:") + spot
    heads = []
    for g in dict.fromkeys(c["grp"] for c in out if c["claim_type"] == "formula_claim" and c["grp"]):
        best, *rest = sorted((c for c in out if c["grp"] == g and c["claim_type"] == "formula_claim"), key=lambda c: (-c["align"], -(c["number"] > 0), -len(c["anchor_text"]), c["seg_no"]))
        heads.append(best)
        for c in rest:
            c.update(policy="hidden", surface="hidden", origin="derived")
    used = set()
    for h in heads:
        for c in out:
            if not h["block_id"] or c["seg_no"] in used or c["mode"] != "direct" or c["claim_type"] in (*C.MARKED, "shell_sentence") or not c["segment"]:
                continue
            both = h["order_index"] and c["order_index"]
            far = abs(h["order_index"] - c["order_index"]) if both else abs(h["seg_no"] - c["seg_no"])
            if far in (1, 2) and explained(c["segment"], h["anchor_text"], h["number"], far) >= C.EXPLANATION_FLOOR:
                apart = c["block_id"] and c["block_id"] != h["block_id"]
                c.update(claim_type="equation_explanation_claim", origin="explanation", grp=h["grp"], policy="required" if apart else "hidden", surface="secondary" if apart else "hidden")
                used.add(c["seg_no"])
    seen = set()
    for c in sorted(out, key=lambda c: (-len(c["anchor_text"] or ""), c["seg_no"])):
        inline = c["claim_type"] == "inline_formula_claim"
        if c["grp"] and (inline or c["claim_type"] in C.QUOTED):
            key = (c["grp"], inline, (formula_key if inline else norm)(c["anchor_text"])[:420])
            if key in seen:
                c.update(policy="hidden", surface="hidden")
            seen.add(key)
    return {(c["a"], c["seg_no"]): tuple(c[k] for k in ("claim_type", "policy", "surface", "origin", "grp")) for c in out}


def test_contract_equals_a_plain_loop(spark):
    got = C.contract(spark.createDataFrame(ROWS, READY), BY).collect()
    got = {(r.a, r.seg_no): (r.claim_type, r.policy, r.surface, r.origin, r.grp) for r in got}
    want = {}
    for a in (1, 2):
        want |= one_after_another([r for r in ROWS if r[0] == a])
    assert got == want
    assert want[1, 4][:3] == ("equation_explanation_claim", "required", "secondary") and want[1, 3][1] == "hidden" and want[1, 5][1] == "hidden"


def test_coverage_has_a_row_for_each_required_claim(spark):
    ready = C.contract(spark.createDataFrame(ROWS, READY), BY)
    got = {(r.a, r.seg_no): r.state for r in C.coverage(ready, BY).collect()}
    assert got.keys() == {(r.a, r.seg_no) for r in ready.where("policy = 'required'").collect()}
    assert got[1, 2] == "located" and got[1, 12] == "degraded" and got[1, 15] == "missing" and (1, 13) not in got


def test_what_is_not_from_the_source_ends_at_a_header(spark):
    lines = ["A fact.", "Supplementary generic knowledge:", "Something known.", "", None, "Limitations: few samples", "The paper does not mention costs.", "After it."]
    df = C.scoped(spark.createDataFrame([(1, i, s) for i, s in enumerate(lines)], "a int, seg_no int, segment string"), BY)
    assert [r.outside for r in df.orderBy("seg_no").collect()] == [False, True, True, True, True, False, True, False]


@pytest.mark.parametrize("empty", ["claims", "blocks"])
def test_empty_tables(spark, empty):
    df, _ = blocks(spark)
    claims = spark.createDataFrame([(1, 1, "Figure 2 and \"a quotation of it\"", "paragraph", 1, None, None, "direct", "")], CLAIM)
    claims, df = (claims.limit(0), df) if empty == "claims" else (claims, df.limit(0))
    typed = C.claim_types(claims)
    figures = df.select("doc_id", "block_id", "number", F.lit("").alias("caption_block_id"))
    assert C.quote_bindings(typed, df, BY).count() == 0 and C.figure_bindings(typed, df, figures, BY).count() == 0
