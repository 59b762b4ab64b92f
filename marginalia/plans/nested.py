"""Texts of nested values, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as N
from .common import table


def nested_texts(spark, sf):
    """The strings of each turn as an object of its role and its lines."""
    turn = table(spark, sf, "conversations")
    json = F.to_json(F.struct("turn", F.struct("role").alias("meta"), F.split("text", "\n").alias("text")))
    return N.nested_texts(turn.select("conv_id", "turn", json.alias("json")), ["conv_id", "turn"]).select("conv_id", "turn", "place", F.sha1("text").alias("sha1"))


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')".format
TEXT_SQL = f"""WITH l AS (SELECT conv_id, turn, role, unnest(range(0, len(ls))) AS i, unnest(ls) AS line FROM (SELECT *, string_split(text, chr(10)) AS ls FROM conversations)),
x AS (SELECT conv_id, turn, 0 AS k, i, line AS s FROM l UNION ALL SELECT conv_id, turn, 1, 0, role FROM conversations UNION ALL SELECT conv_id, turn, 2, i, line FROM l),
c AS (SELECT conv_id, turn, k, i, {_STRIP("s")} AS s FROM x WHERE {_STRIP("s")} <> '')
SELECT conv_id, turn, place::INT AS place, sha1(substr(s, 1, 600)) AS sha1 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY k, i) AS place FROM c) WHERE place <= 12"""

QUERIES = {"nested_texts": nested_texts}
ORACLE_SQL = {"nested_texts": TEXT_SQL}
