"""All registered queries of the library and their DuckDB SQL."""

from __future__ import annotations

from . import answers, cards, cleanup, coverage, evidence, extracts, indices, intents, library, markdown, naming, nested, quality, reader, retrieval, selection, shelf, streams, support, taxonomy

FLAGSHIP = "bm25_top_k"
_PARTS = (retrieval, markdown, library, naming, shelf, selection, extracts, reader, cards, quality, evidence, indices, intents, answers, cleanup, taxonomy, streams, support, coverage, nested)
QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE_SQL = {k: v for p in _PARTS for k, v in p.ORACLE_SQL.items()}
