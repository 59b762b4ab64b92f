"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from marginalia.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SF}/{name}'")
    return con


def _value(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 5) if not v.is_integer() else int(v)
    return v.item() if hasattr(v, "item") else v


def rows(df):
    cols = sorted(df.columns)
    return sorted((tuple(_value(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def _against_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{folder}/{t}/*.parquet'")
    ours, theirs = catalog.QUERIES[name](spark, str(folder)).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert rows(ours) == rows(theirs)
    return ours


def test_numbers_of_anchors_end_at_letters_of_any_script(spark, tmp_path):
    """'Ciónquebo' is no number 101, though the SQL's word border was one of ASCII."""
    turns = [(18, 0, "user", "Ciónquebo. Una"), (18, 1, "assistant", "x"), (19, 0, "user", "iv Ciónb"), (19, 1, "assistant", "iv, ii"), (36, 0, "user", "c定"), (36, 1, "user", "3")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = _against_sql(spark, tmp_path, "anchor_hints")
    assert set(got.loc[got["conv_id"] == 18, "number"].dropna()) == set()


def test_headings_meet_where_one_stands_within_a_word_of_the_other(spark, tmp_path):
    """a segment's heading 'in.' is part of a block's heading 'Thin. Walls'."""
    lines = ["# Thin. Walls", "", "in. ab", "A long paragraph about walls and their colours."]
    text = "\n".join([*lines, *["some other words stand here"] * 5, "", "In.", "", "The next paragraph has its own words."])
    texts = [(i, "\n".join(["Thin. walls stand", "", *["other words here and there"] * k, "In.", *["more of them stand in a line"] * 30])) for i, k in enumerate((0, 4, 8, 16, 20))] + [(9, text)]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    _against_sql(spark, tmp_path, "evidence_blocks")


def test_lines_that_name_panels_resolve_as_in_sql(spark, tmp_path):
    """F8: '. Y,' names a panel, which the SQL left out."""
    texts = ["alphabet bravado charlie deltas stand here\nalphabet bravado charlie echoes stand there"]
    turns = [(0, 0, "user", "alphabet bravado charlie deltas echoes"), (0, 1, "assistant", "Then alphabet bravado charlie deltas. Y, so\nThen alphabet bravado charlie echoes (a, b)\nNothing else")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = _against_sql(spark, tmp_path, "support_resolutions")
    assert got["score"].notna().any()


def test_cells_of_long_phrases_count_in_sql(spark, tmp_path):
    """a cell of eight words and more, which the SQL took for impossible."""
    phrase = "one.two.three.four.five.six.seven.eight"
    texts = ["\n".join([f"{phrase} stand 12 here now"] * 4), "\n".join([f"{phrase} {phrase} 12 {phrase} now"] * 9), "\n".join(["some words stand here now"] * 3)]
    spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = _against_sql(spark, tmp_path, "table_grids").set_index("doc_id")
    assert list(got["phrase_share"] > 0) == [True, True, False] and not got["sane"][1]


def test_pairs_of_segments_and_blocks_are_not_shuffled(spark, tmp_path):
    """the keys of all segments and blocks, their pairs and the texts of both went through shuffles, which filled the disk."""
    line = lambda i, k: ["eq. 3 and (4) of wood", "Fig. # 7 shows the (  5 ) walls", "some words stand here and there", "equation.12 holds; figure 8a no", "x_1 = 5 in (16), eq 07 of it", ""][(i * 5 + k * 3 + i * i // 7) % 6] + f" w{(i * k) % 11}"
    texts = ["\n".join(line(i, k) for i in range(n)) for k, n in enumerate((1, 3, 7, 45, 160))] + [None, "", "\n\n\n"]
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = _against_sql(spark, tmp_path, "evidence_blocks")
    assert len(got) > 40
    plan = catalog.QUERIES["evidence_blocks"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
    assert 1 <= len(exchanges) <= 2 and not any("block_id" in x.split(")")[0] for x in exchanges)
