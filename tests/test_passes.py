"""How often the queries read their tables and shuffle them, and that odd texts keep their results."""

import pytest

from marginalia.plans import catalog

from .test_queries import SF, _against_sql

ODD = [
    None, "", "\n", "one line", "\n\n\n", "\n".join(["| a | b |"] * 9), "\n".join(["| a | b |", "| a |", "| a | b | c |"] * 20), "\n".join(["text line"] * 70), "\n".join(["", *["text line"] * 30, ""] * 3), "\n".join(["$$", "a = b", "$$"] * 25),
    "\n".join(["## References", "[1] Doe, J., A paper of some length, 2011", "[2] x", "# REFERENCE", "[3-5] b 1999 doi"] * 15), "\n".join(["![a](b.png)", "", "", "", "", "Figure 1 x"] * 12), "\n".join(["cost $5 and $6 and $7", "#  3a", "###### deep", "# X2 = 4"] * 18),
]


def _documents(spark, folder, texts):
    spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")


def _scans(spark, name, table):
    """How many scans of a table are in a query's plan."""
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().sparkPlan().toString()
    return sum("FileScan parquet" in line and f"/{table}.parquet" in line for line in plan.split("\n"))


@pytest.mark.parametrize(("name", "most"), [("regression_report", 2), ("analyzer_issues", 1), ("markdown_quality", 1)])
def test_lines_are_made_once_for_all_issues(spark, tmp_path, name, most):
    """Each of 19 issues had its own scan of documents."""
    assert _scans(spark, name, "documents") <= most
    _documents(spark, tmp_path, ODD)
    assert len(_against_sql(spark, tmp_path, name)) > 0


def test_first_author_splits_a_reference_once(spark):
    """the longest word was sought anew for each word, with the reference cleaned each time."""
    from pyspark.sql import functions as F

    from marginalia.functions import text

    rows = [("[1] Doe J. Miller, K., 2011",), ("ab cd, longest",), ("",), (None,), ("1234, Abc",), ("Ünal Äb Cde",), ("Aa-Bb Cc",)]
    df = spark.createDataFrame(rows, "raw string").select("raw", text.first_author(text.clean_reference("raw")).alias("author"))
    assert [r["author"] for r in df.collect()] == ["miller", "ab", None, None, None, "nal", "aa"]
    plan = spark.createDataFrame(rows, "raw string").select(text.first_author(F.concat("raw", F.lit("?marker?"))).alias("author"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("?marker?") == 1


def test_citation_signal_takes_its_topics_once(spark):
    """the cue words of a prompt were sought some twenty times a row."""
    from pyspark.sql import functions as F

    from marginalia.operators.selection import citation_signal

    df = spark.createDataFrame([("what is cited for sampling", "A / B", "Based on Sensing and sampling [4, 7]"), ("cited for nothing here", "Sampling", "x [3]"), ("", "", "")], "prompt string, heading string, body string")
    assert [r[0] for r in df.select(citation_signal(F.col("prompt"), F.col("heading"), F.col("body"))).collect()] == [24.4, -6.0, 0.0]
    plan = df.select(citation_signal(F.concat("prompt", F.lit("?prompt?")), F.col("heading"), F.concat("body", F.lit("?body?"))).alias("score"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("?prompt?") == 2 and plan.count("?body?") == 4


def test_texts_go_to_python_in_bounded_batches(spark, tmp_path):
    """a batch had up to 10,000 texts of any length."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    _documents(spark, tmp_path, [*ODD, "ﬁ ½ Å " * 100_000, *["é" * 50_000] * 50])
    _folded_as_in_python(spark, tmp_path)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def _folded_as_in_python(spark, folder):
    import unicodedata

    got = {r["doc_id"]: r["compatible"] for r in catalog.QUERIES["folded_text"](spark, str(folder)).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert got == {i: len(unicodedata.normalize("NFKC", "ﬁrst “quoted” " + t)) for i, t in texts.items()}


def test_chunks_go_to_python_in_bounded_batches_with_a_path_a_heading(spark):
    """a batch had up to 10,000 documents, each line of them with its whole path."""
    from marginalia.operators import markdown as M

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    md = spark.createDataFrame([(1, i, line) for i, line in enumerate(["before", "# A", *["x" * 90] * 5, "## B", "end"])], "doc_id long, pos int, line string")
    got = M.chunks(M.with_heading_path(md), size=300, overlap=20)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20
    assert [(r["heading_path"], r["text"][:3]) for r in got.orderBy("chunk_idx").collect()] == [("", "bef"), ("A", "# A"), ("A", "xxx"), ("A / B", "## ")]
    assert "THEN heading_path" in got._jdf.queryExecution().analyzed().toString()
