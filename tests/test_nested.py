"""Texts of nested values against a plain recursion."""

import json

from marginalia.operators.nested import FIRST_KEYS, nested_texts

VALUES = [
    {"b": ["x", {"name": "n", "z": [" deep "]}], "a": "y", "title": 5, "text": " t "}, "plain", ["p", 1, True, None, "", ["q", ["r", ["s"]]]], {}, [], {"keywords": ["k1", "k2"], "label": {"name": "inner", "other": "o"}},
    [str(i) for i in range(40)], {"long": "w" * 2000}, {"name": ["n"] * 7, "title": "t"},
]


def walk(value, depth):
    if depth < 0:
        return []
    if isinstance(value, str):
        return [value.strip()[:600]] if value.strip() else []
    if isinstance(value, list):
        return [s for v in value for s in walk(v, depth - 1)]
    if isinstance(value, dict):
        order = [value[k] for k in FIRST_KEYS if k in value] + [value[k] for k in sorted(value)]
        return [s for v in order for s in walk(v, depth - 1)]
    return []


def test_equals_a_recursion_at_every_depth(spark):
    rows = [(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(90, None), (91, "{broken"), (92, "")]
    df = spark.createDataFrame(rows, "id int, json string")
    for depth in (0, 2, 4):
        got = {}
        for r in nested_texts(df, ["id"], depth=depth).orderBy("id", "place").collect():
            got.setdefault(r.id, []).append(r.text)
        want = {i: walk(v, depth)[:12] for i, v in enumerate(VALUES)}
        assert got == {i: w for i, w in want.items() if w}
