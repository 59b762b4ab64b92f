"""Values of the queries that SQL can't express, against plain Python over the same table."""

import hashlib
import re
from difflib import SequenceMatcher

import pandas as pd

from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"


def _texts():
    d = pd.read_parquet(f"{SF}/documents.parquet", columns=["doc_id", "text"])
    return {int(r.doc_id): r.text or "" for r in d.itertuples()}


def _lines(text):
    """As the queries' Markdown: (level, line, heading path) of each line."""
    path, out = {}, []
    for pos, line in enumerate(text.split("\n")):
        k = pos % 9 + 1
        made = f"# {line}" if pos % 7 == 0 else f"## {line}" if pos % 3 == 0 else line + (f" [{k}-{k + 2}]" if pos % 12 == 1 else f" [{k}]" if pos % 4 == 1 else "")
        mark = re.match(r"(#{1,6})\s", made)
        level = len(mark.group(1)) if mark else 0
        if level:
            path = {n: t for n, t in path.items() if n < level} | {level: re.sub(r"^#{1,6}\s+", "", made).strip(" ")}
        out.append((level, made, " / ".join(path[n] for n in sorted(path) if n <= 3)))
    return out


def _chunks(rows, size=1400, overlap=200):
    """A heading begins a chunk; a line that would overfill one of over 200 characters begins the next, which starts with the last ones of this."""
    out, held, heading = [], "", ""
    first = True
    for level, line, path in rows:
        if level:
            if held.strip():
                out.append((held.strip(), heading))
            held, first, heading = "", True, path
        used = len(held) + (0 if first else 1)
        if not first and used + len(line) + 1 > size and used > 200:
            text = held.strip()
            if text:
                out.append((text, heading))
            held, first = (text[-overlap:], False) if text else ("", True)
            used = len(held)
        held, first = (line if first else f"{held}\n{line}"), False
    if held.strip():
        out.append((held.strip(), heading))
    return out


def test_chunks(spark):
    got = {(r["doc_id"], r["chunk_idx"]): (r["heading_path"], r["chars"], r["sha1"]) for r in catalog.QUERIES["chunks_with_overlap"](spark, SF).collect()}
    want = {}
    for d, text in _texts().items():
        for k, (chunk, path) in enumerate(_chunks(_lines(text))):
            want[d, k] = (path, len(chunk), hashlib.sha1(chunk.encode()).hexdigest())
    assert got == want


def test_name_similarity(spark):
    names = {int(r.c_custkey): r.c_name for r in pd.read_parquet(f"{SF}/customer.parquet").itertuples()}
    got = {r["c_custkey"]: r["ratio"] for r in catalog.QUERIES["name_similarity"](spark, SF).collect()}
    assert got == {k: round(SequenceMatcher(None, n, names[k + 1]).ratio(), 6) for k, n in names.items() if k + 1 in names}


def _joined(text):
    special = re.compile(r"\s*(?:[#>|]|\$\$|```|!\[)")
    out, fenced = [], False
    for line in text.split("\n"):
        if line.lstrip().startswith("```"):
            fenced = not fenced
        list_item = re.match(r"\s*(?:[-*+]\s|\d+\.\s)", line)
        goes_on = not fenced and line.strip() and not special.match(line) and not list_item and out and out[-1].strip() and out[-1].rstrip()[-1] not in ".!?:|" and not special.match(out[-1])
        if goes_on:
            head, tail = out[-1].rstrip(), line.lstrip()
            out[-1] = head[:-1] + tail if head[-1] == "-" and tail[0].islower() else head + " " + tail
        else:
            out.append(line)
    return out


def test_reflowed_documents(spark):
    got = {r["doc_id"]: (r["before"], r["after"]) for r in catalog.QUERIES["reflowed_documents"](spark, SF).collect()}
    assert got == {d: (len(t.split("\n")), len(_joined(t))) for d, t in _texts().items()}
