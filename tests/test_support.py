"""Slots, their assignment and the resolution of markers against plain Python and values written by hand."""

import itertools
import random

from marginalia.operators import support as S
from pyspark.sql import functions as F

CARD = "q long, place int, doc_idx int, sid string, source string, heading string, cue string, snippet string, candidate_refs array<int>, family string"


def card(place, snippet, family="", doc=1, refs=None, heading="", sid="abcd1234", source="a.md", q=1):
    return (q, place, doc, sid, source, heading, "", snippet, refs, family)


def slots_of(spark, cards, k=4):
    return S.slots(spark.createDataFrame(cards, CARD), ["q"], k)


def test_slots_have_claims_policies_and_numbers(spark):
    got = slots_of(spark, [
        card(1, "Phase correlation was performed using the toolbox software [12, 14] of the group.", "method"),
        card(2, "Image registration aligns the frames; see [3-5]. Then shift vectors are applied back.", "method"),
        card(3, "Phase correlation was performed using the toolbox software [12, 14] of the group.", "method"),
        card(4, "", "method"),
        card(5, "Second document on detector arrays.", "method", doc=2, source="b.md", refs=[0, 7]),
        card(6, "A last one that is beyond the fourth slot?", "method", doc=3, source="c.md"),
        card(7, "Beyond.", "method", doc=4, source="d.md"),
    ]).orderBy("slot").collect()
    assert [(r["slot"], r["support_id"], r["claim_type"], r["cite_policy"], r["refs"]) for r in got] == [
        (1, "DOC-1-S1", "borrowed_tool", "prefer_ref", [12, 14]), (2, "DOC-1-S2", "method_detail", "prefer_ref", [3, 4, 5]),
        (3, "DOC-2", "method_detail", "prefer_ref", [7]), (4, "DOC-3", "method_detail", "prefer_ref", []),
    ]
    assert got[0]["cite_example"] == "[[CITE:abcd1234:12]]" and got[3]["cite_example"] is None and got[1]["locate"].startswith("Image registration")
    kinds = {
        ("figure_walkthrough", "Panels (a, b) show the sample."): ("figure_panel", "locate_only"), ("figure_walkthrough", "The workflow of the radial variance transform"): ("method_detail", "prefer_ref"),
        ("figure_walkthrough", "The resolution of both modes"): ("compare_result", "locate_only"), ("citation_lookup", "Introduced by others [4]"): ("prior_work", "prefer_ref"), ("citation_lookup", "Nothing cited here"): ("own_result", "locate_only"),
        ("compare", "Better [1]"): ("compare_result", "allow_none"), ("strength_limits", "As known [2]"): ("prior_work", "prefer_ref"), ("", "In prior work [2]"): ("prior_work", "prefer_ref"), ("abstract", "We show"): ("abstract_quote", "locate_only"),
    }
    made = slots_of(spark, [card(1, text, family, q=i) for i, (family, text) in enumerate(kinds)]).orderBy("q").collect()
    assert [(r["claim_type"], r["cite_policy"]) for r in made] == list(kinds.values())


def greedy(scored, most):
    """Line by line, the best free slot."""
    out = []
    for q in sorted({r[0] for r in scored}):
        used = []
        for pos in sorted({r[1] for r in scored if r[0] == q}):
            free = sorted((-score, slot, floor) for a, b, slot, score, floor in scored if (a, b) == (q, pos) and slot not in used)
            if free and len(used) < most and -free[0][0] >= free[0][2]:
                used.append(free[0][1])
                out.append((q, pos, free[0][1], -free[0][0]))
    return sorted(out)


def test_assignment_is_one_to_one_and_greedy(spark):
    r = random.Random(6)
    scored = [(q, pos, slot, round(r.random() * 4, 1), r.choice([1.0, 2.0, 3.5])) for q, pos, slot in itertools.product(range(30), range(8), range(1, 5)) if r.random() < 0.6]
    slot = spark.createDataFrame([(q, s) for q in range(30) for s in range(1, 5)], "q long, slot int")
    table = spark.createDataFrame([(*x, "") for x in scored], "q long, pos int, slot int, score double, floor double, family string").repartition(3)
    for most in (1, 3, 9):
        got = sorted((x["q"], x["pos"], x["slot"], x["score"]) for x in S.assignments(table, slot, ["q"], most).collect())
        assert got == greedy(scored, most) and len({(a, c) for a, _, c, _ in got}) == len(got)
    five = S.assignments(table.withColumn("family", F.lit("figure_walkthrough")), slot, ["q"], 1).collect()
    assert sorted((x["q"], x["pos"], x["slot"], x["score"]) for x in five) == greedy(scored, 4)


def test_markers_go_to_their_lines(spark):
    slot = slots_of(spark, [
        card(1, "Phase correlation aligns frames in the registration step [12].", "method"), card(2, "Frames are denoised by a learned prior afterwards.", "method"), card(3, "The detector array records central pixel images [9].", "method", doc=2, source="b.md"),
    ])
    text = ["Evidence:", "Frames pass phase correlation for registration.", "| phase correlation | registration |", "Based on the retrieved context, phase correlation is used.", "The learned prior denoised frames afterwards.", "Nothing of the kind.", "Phase correlation again with registration."]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "q long, pos int, line string")
    scored = S.scores(lines, slot, ["q"])
    by_line = {(r["pos"], r["slot"]): (r["score"], r["floor"]) for r in scored.collect()}
    # frames, phase, correlation, registration: 4; strong .45; prefer_ref .1; method detail .35; its words .45
    assert by_line[1, 1] == (5.35, 1.0) and by_line[4, 2] == (5.45, 1.35) and set(p for p, _ in by_line) == {1, 4, 6}
    assigned = S.assignments(scored, slot, ["q"])
    put = {r["pos"]: r["line"] for r in S.marked(lines, assigned, slot, ["q"]).collect()}
    assert put[1].endswith("[[SUPPORT:DOC-1-S1]]") and put[4].endswith("[[SUPPORT:DOC-1-S2]]") and all(put[i] == text[i] for i in (0, 2, 3, 5, 6))
    done = S.resolved(S.marked(lines, assigned, slot, ["q"]), slot, ["q"])
    assert sorted((r["pos"], r["num"], r["mode"]) for r in done.collect()) == [(1, 12, "slot_ref_span"), (4, None, "no_ref")]
    final = {r["pos"]: r["line"] for r in S.with_citations(S.marked(lines, assigned, slot, ["q"]), done, ["q"]).collect()}
    assert final[1] == "Frames pass phase correlation for registration. [[CITE:abcd1234:12]]" and final[4] == text[4]


def test_markers_without_a_number_choose_by_the_line(spark):
    slot = slots_of(spark, [
        card(1, "Phase correlation aligns frames in the registration step [12, 13] of Smith.", "method"), card(2, "A learned prior denoised the frames.", "method", refs=[21, 22]), card(3, "Own result.", "", doc=2, source="b.md"), card(4, "Tool of others", "method", doc=3, refs=[5], sid=""),
    ])
    text = [
        "Registration by phase correlation [[SUPPORT:DOC-1]].", "The prior denoised [[support: doc-1 ]] , as said [22]", "Out [[SUPPORT:DOC-2]] of scope", "Nowhere [[SUPPORT:DOC-9]]!", "One candidate [[SUPPORT:DOC-3]]",
        "source: [[SUPPORT:DOC-1]]", "As Smith et al. (2019) did [[SUPPORT:DOC-1-S2]]", "Two [[SUPPORT:DOC-1-S1]] and [[SUPPORT:DOC-2]]", None, "In [13] [[SUPPORT:DOC-1-S1]]",
    ]
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(text)], "q long, pos int, line string")
    done = S.resolved(lines, slot, ["q"])
    got = {(r["pos"], r["n"]): (r["support_id"], r["num"], r["mode"]) for r in done.collect()}
    assert got == {
        (0, 0): ("DOC-1-S1", None, "no_ref"), (1, 0): ("DOC-1-S2", 22, "context_explicit_ref"), (2, 0): ("DOC-2", None, "locate_only"), (3, 0): ("DOC-9", None, "missing_slot"), (4, 0): ("DOC-3", 5, "slot_candidate"),
        (6, 0): ("DOC-1-S2", 21, "context_hint_candidate"), (7, 0): ("DOC-1-S1", None, "no_ref"), (7, 1): ("DOC-2", None, "locate_only"), (9, 0): ("DOC-1-S1", 13, "context_explicit_ref"),
    }
    final = {r["pos"]: r["line"] for r in S.with_citations(lines, done, ["q"]).collect()}
    assert final[0] == "Registration by phase correlation." and final[1] == "The prior denoised [[CITE:abcd1234:22]], as said [22]" and final[3] == "Nowhere!" and final[4] == "One candidate" and final[5] == "source:" and final[8] is None
