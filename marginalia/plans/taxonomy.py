"""Queries on headings, tags, sets, runs, boxes and lookups; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import taxonomy as X
from .common import PROMPTS, prompts, table

_SECTIONS = ["Methods and models", "Results", "Introduction", "Discussion", "References", "Data"]
def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


def heading_choice(spark, sf):
    """For each prompt the line, as a heading of some section, that suits it best in the document of the conversation's number."""
    turns = prompts(spark, sf).select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("id"), F.col("text").alias("ask"))
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    section = F.element_at(_lit_array(_SECTIONS), (F.pmod("pos", F.lit(len(_SECTIONS))) + 1).cast("int"))
    heads = lines.select("doc_id", "pos", F.concat(section, F.lit(": "), F.substring("line", 1, 30)).alias("heading"))
    bonus = X.heading_bonus(X.heading_intent("ask"), X.heading_kind("heading"))
    scored = turns.join(heads, "doc_id").withColumn("score", F.round(bonus + 3.0 - 0.25 * F.col("pos") + F.greatest(F.lit(0.0), (50 - F.abs(F.length("heading") - 38)) / 200), 6))
    return X.best_heading(scored, "id")


def _sql_list(values):
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _sql_ladder(rules, default, col):
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{default}' END"


_BONUS = "CASE " + " ".join(f"WHEN intent = '{a}' AND kind = '{b}' THEN {w}" for (a, b), w in X.HEADING_WEIGHTS.items()) + " ELSE 0 END"
HEADING_SQL = f"""WITH {PROMPTS}, t AS (SELECT conv_id AS doc_id, conv_id || ':' || turn AS id, text AS ask FROM pr),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
h AS (SELECT id, ask, pos, {_sql_list(_SECTIONS)}[pos % {len(_SECTIONS)} + 1] || ': ' || substr(line, 1, 30) AS heading FROM t JOIN l USING (doc_id)),
k AS (SELECT *, {_sql_ladder(X._INTENTS, 'none', 'ask')} AS intent, {_sql_ladder(X._HEADINGS, 'other', 'heading')} AS kind FROM h),
s AS (SELECT *, round(({_BONUS} + CASE WHEN kind = 'references' AND intent <> 'references' THEN -3.4 ELSE 0 END + 3.0 - 0.25 * pos + greatest(0, (50 - abs(length(heading) - 38)) / 200))::DOUBLE, 6) AS score FROM k)
SELECT id, heading, score FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pos) = 1"""


def tag_edits(spark, sf):
    """Tags of documents after cleaning, adding and removing."""
    d = table(spark, sf, "documents")
    tags = F.array(F.concat(F.lit(" "), "lang"), F.upper("lang"), "source", F.lit("x  y"))
    return d.select("doc_id", F.array_join(X.edited_tags(tags, F.array(F.lit("New"), F.lit("new")), F.array(F.lit("SRC0"))), ",").alias("tags"))


TAGS_SQL = "SELECT doc_id, lang || CASE WHEN source <> 'src0' THEN ',' || source ELSE '' END || ',x y,New' AS tags FROM documents"


def year_mode(spark, sf):
    """The most frequent year of each customer's orders, and the first of the latest."""
    o = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("year"))
    return X.majority_year(o, "o_custkey")


YEAR_SQL = "SELECT o_custkey, year FROM (SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, year DESC) = 1"


def event_islands(spark, sf):
    """Runs of a user's event numbers that are close together."""
    return X.islands(table(spark, sf, "events"), "user_id", "event_id", 40)


ISLAND_SQL = """WITH g AS (SELECT user_id, event_id, CASE WHEN event_id - lag(event_id) OVER w <= 40 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM g) SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY user_id, run"""


def event_gaps(spark, sf):
    return X.widest_gap(table(spark, sf, "events"), "user_id", "event_id")


GAP_SQL = "SELECT user_id, event_id AS start, gap FROM (SELECT user_id, event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) - event_id AS gap FROM events) WHERE gap IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, event_id) = 1"


def box_overlaps(spark, sf):
    """Common areas of boxes made of neighbouring line items of an order."""
    li = table(spark, sf, "lineitem")
    box = F.struct((F.col("l_quantity") * 1.0).alias("x0"), (F.col("l_linenumber") * 1.0).alias("y0"), (F.col("l_quantity") + 20.0).alias("x1"), (F.col("l_linenumber") + 2.5).alias("y1"))
    boxes = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(box).alias("box"))
    other = boxes.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("box").alias("next"))
    return boxes.join(other, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", F.round(X.overlap_area(F.col("box"), F.col("next")), 4).alias("area"))


BOX_SQL = """WITH b AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT a.l_orderkey, a.l_linenumber, round(greatest(0, least(a.q, c.q) + 20.0 - greatest(a.q, c.q)) * greatest(0, least(a.l_linenumber, c.l_linenumber) + 2.5 - greatest(a.l_linenumber, c.l_linenumber)), 4) AS area FROM b a JOIN b c ON a.l_orderkey = c.l_orderkey AND c.l_linenumber = a.l_linenumber + 1"""


def markdown_tables(spark, sf):
    """Each nation's supplier counts and balances as a Markdown table."""
    n = table(spark, sf, "nation").join(table(spark, sf, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"))
    rows = n.groupBy("n_regionkey", "n_name").agg(F.count("*").cast("string").alias("n"))
    cells = F.array_sort(F.collect_list(F.array("n_name", "n")))
    return rows.groupBy("n_regionkey").agg(X.table_to_markdown(F.concat(F.array(F.array(F.lit("nation"), F.lit("n"), F.lit("note"))), cells)).alias("md"))


TABLE_SQL = r"""WITH r AS (SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY ALL)
SELECT n_regionkey, '| nation | n | note |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || n_name || ' | ' || n || ' |  |', chr(10) ORDER BY n_name) AS md FROM r GROUP BY 1"""


def journal_lookup(spark, sf):
    """Parts as papers and suppliers as journals: impact by number, else by name."""
    papers = table(spark, sf, "part").select(F.col("p_partkey").alias("paper_id"), F.when(F.col("p_partkey") % 2 == 0, F.lpad((F.col("p_partkey") % 50).cast("string"), 8, "0")).alias("issn"), F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("p_partkey") % 70).cast("string"), 9, "0")).alias("venue"))
    journals = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("issn"), F.concat(F.lit("Supplier#"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("name"), F.col("s_acctbal").alias("impact"))
    return X.issn_join(papers, journals)


JOURNAL_SQL = """WITH p AS (SELECT p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN p_partkey % 50 END AS k, p_partkey % 70 AS v FROM part)
SELECT paper_id, coalesce(a.s_acctbal, b.s_acctbal) AS impact FROM p LEFT JOIN supplier a ON a.s_suppkey = k LEFT JOIN supplier b ON b.s_suppkey = v"""


def json_patch(spark, sf):
    """Event properties with one key put in and one taken out."""
    e = table(spark, sf, "events")
    stored = F.coalesce(F.from_json("props", "map<string,string>"), F.create_map().cast("map<string,string>"))
    change = F.when(F.col("event_id") % 2 == 0, F.create_map(F.lit("k"), F.lit(None).cast("string"), F.lit("seen"), F.lit("1"))).otherwise(F.create_map(F.lit("k"), F.lit("9")))
    out = X.patched(stored, change)
    return e.select("event_id", F.array_join(F.array_sort(F.transform(F.map_entries(out), lambda x: F.concat_ws("=", x["key"], x["value"]))), ",").alias("props"))


PATCH_SQL = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'seen=1' ELSE 'k=9' END AS props FROM events"


def index_words(spark, sf):
    """Turns rebuilt from an inverted index of their words."""
    t = table(spark, sf, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), F.posexplode(text.tokens("text")).alias("p", "w"))
    own = t.groupBy("id", "w").agg(F.collect_list("p").alias("ps")).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return own.select("id", F.sha1(X.words_of_index(F.col("index"))).alias("sha1"))


INDEX_SQL = "SELECT conv_id || ':' || turn AS id, sha1(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]'), lambda x: lower(x)), ' ')) AS sha1 FROM conversations WHERE len(regexp_extract_all(text, '[A-Za-z0-9_]+|[\\x{4e00}-\\x{9fff}]')) > 0"

QUERIES = {f.__name__: f for f in (heading_choice, tag_edits, year_mode, event_islands, event_gaps, box_overlaps, markdown_tables, journal_lookup, json_patch, index_words)}
ORACLE_SQL = {"heading_choice": HEADING_SQL, "tag_edits": TAGS_SQL, "year_mode": YEAR_SQL, "event_islands": ISLAND_SQL, "event_gaps": GAP_SQL, "box_overlaps": BOX_SQL, "markdown_tables": TABLE_SQL, "journal_lookup": JOURNAL_SQL, "json_patch": PATCH_SQL, "index_words": INDEX_SQL}
