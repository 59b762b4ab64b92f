"""Operators on small inputs with known results."""

from difflib import SequenceMatcher


from marginalia.functions import scoring, text
from marginalia.operators import markdown as M
from marginalia.operators import references as X
from marginalia.operators import retrieval as R
from marginalia.sources import files as S
from marginalia.streaming import events as E


def one(spark, column, **values):
    return spark.createDataFrame([values]).select(column.alias("x")).first()["x"]


def test_tokens_split_at_letters_beyond_ascii(spark):
    assert one(spark, text.tokens("t"), t="Größe_1 über 中文 A-b") == ["gr", "e_1", "ber", "中", "文", "a", "b"]


def test_match_tokens_have_bigrams(spark):
    assert one(spark, text.match_tokens("t"), t="Ab c 光谱成像 x1") == ["ab", "x1", "光谱", "谱成", "成像"]


def test_citation_set(spark):
    assert one(spark, text.citation_set("t"), t="1, 3-5,3, 9-40, x") == [1, 3, 4, 5]


def test_parts_are_trimmed_of_spaces_alone(spark):
    assert one(spark, text.sentences("t"), t="0 the first sentence 0.  1 the second sentence 1") == ["0 the first sentence 0.", "1 the second sentence 1"]
    assert one(spark, text.heading_parts("t"), t=" 0 Intro 0 / 1 Setup 1 ") == ["0 Intro 0", "1 Setup 1"]


def test_top_k_is_limited_before_the_shuffle(spark):
    hits = spark.range(1000).selectExpr("concat('q', id % 3) as query_id", "id as doc_id", "cast(id % 50 as double) as score")
    top = R.top_k(hits, 4)
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert sorted((r["score"], r["doc_id"]) for r in top.where("query_id = 'q0'").collect()) == sorted([(49.0, 99), (49.0, 249), (49.0, 399), (49.0, 549)])


def test_budget_with_empty_rows(spark):
    rows = [("q", i, t) for i, t in enumerate(["", "a" * 6, "", "b" * 4, "", "c", ""])] + [("r", 1, "x" * 20), ("s", 1, ""), ("s", 2, None)]
    got = {(r["query_id"], r["rank"]): r["used"] for r in R.within_budget(spark.createDataFrame(rows, "query_id string, rank int, text string"), 10).collect()}
    assert got == {("q", 0): 0, ("q", 1): 6, ("q", 2): 6, ("q", 3): 10, ("q", 4): 10, ("s", 1): 0, ("s", 2): 0}


def test_doi_and_year(spark):
    assert one(spark, text.doi_like("t"), t="see 10.1000/ABC.5). 2019") == "10.1000/abc.5"
    assert one(spark, text.doi_like("t"), t="arXiv:2101.00001 (2021)") == "10.48550/arxiv.2101.00001"
    assert one(spark, text.last_year("t"), t="1999 and 2021.") == 2021


def test_sequence_ratio(spark):
    a, b = "spectral imaging", "imaging of spectra"
    assert abs(one(spark, scoring.sequence_ratio("a", "b"), a=a, b=b) - SequenceMatcher(None, a, b).ratio()) < 1e-12


def test_bm25_ties_and_empty(spark):
    docs = spark.createDataFrame([(1, "x y"), (2, "x y"), (3, "z"), (4, None), (5, "w"), (6, "v")], "doc_id long, text string")
    asked = spark.createDataFrame([("a", "x x"), ("b", "nothing"), ("c", "")], "query_id string, query string")
    top = R.top_k(R.bm25(R.corpus(docs), asked), 5).collect()
    assert [(r["query_id"], r["doc_id"], r["rank"]) for r in sorted(top, key=lambda r: r["rank"])] == [("a", 1, 1), ("a", 2, 2)]


def test_heading_path_resets(spark):
    md = spark.createDataFrame([(1, i, x) for i, x in enumerate(["# A", "a", "## B", "b", "# C", "c"])], "doc_id long, pos int, line string")
    got = {r["pos"]: r["heading_path"] for r in M.with_heading_path(md).collect()}
    assert [got[i] for i in range(6)] == ["A", "A", "A / B", "A / B", "C", "C"]


def test_chunks_overlap(spark):
    lines = ["# H"] + ["x" * 150] * 6
    md = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    got = [r["text"] for r in M.chunks(M.with_heading_path(md), size=400, overlap=50).orderBy("chunk_idx").collect()]
    assert len(got) > 1 and all(b.startswith(a[-50:]) for a, b in zip(got, got[1:], strict=False))


def test_references_catalog(spark):
    lines = ["# T", "text [1]", "## References", "[1] A. Author. First work here. 2001.", "more of it", "[2] B. Second 2002.", "[4] C. Fourth 2004.", "[2018] year"]
    md = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id long, pos int, line string")
    entry = X.without_outliers(X.entries(md))
    assert {r["num"]: r["raw"] for r in entry.collect()}[1].endswith("2001. more of it")
    row = X.catalog(entry).first()
    assert (row["ref_count"], row["missing"], row["status"]) == (3, "3", "gapped")


def test_path_suffix(spark):
    assert one(spark, X.path_suffix_score("a", "b"), a="C:\\x\\lib\\p.pdf", b="/y/lib/p.pdf") == 2


def test_ingest_is_incremental(spark, tmp_path):
    root, store = tmp_path / "md", str(tmp_path / "store")
    (root / "temp").mkdir(parents=True)
    (root / "a.md").write_text("# A\n" + "text " * 40)
    (root / "b.md").write_text("# B\nshort")
    (root / "temp" / "c.md").write_text("# C")
    texts = lambda: sorted(r["text"].split("\n")[-1].strip() for r in S.read_chunks(spark, store).collect())
    first = ("text " * 40).strip()
    assert S.ingest(spark, str(root), store) == {"documents": 2, "written": 2, "vanished": 0}
    assert S.ingest(spark, str(root), store) == {"documents": 2, "written": 0, "vanished": 0} and texts() == ["short", first]
    (root / "b.md").write_text("# B\nchanged")
    assert S.ingest(spark, str(root), store) == {"documents": 2, "written": 1, "vanished": 0} and texts() == ["changed", first]
    (root / "a.md").unlink()
    # A run that died before its commit left chunks and an index without its mark.
    (tmp_path / "store" / "chunks" / "version=4").mkdir()
    (tmp_path / "store" / "chunks" / "version=4" / "part-0.json").write_text('{"doc_id": "x", "chunk_idx": 0, "text": "dead"}')
    (tmp_path / "store" / "versions" / "v4").mkdir()
    assert texts() == ["changed", first]
    assert S.ingest(spark, str(root), store)["vanished"] == 1 and texts() == ["changed"]
    assert S.read_index_version(spark, store).select("chunks", "version").collect() == [(1, 3)]
    (root / "a.md").write_text("# A\nback")
    assert S.ingest(spark, str(root), store)["written"] == 1 and texts() == ["back", "changed"]


def test_suites_uploads_and_lines_of_json(spark, tmp_path):
    (tmp_path / "suite.json").write_text('{"name": "s", "papers": [{"id": "p", "path": "x.md",\n "cases": [{"id": "c1", "prompt": "why", "tags": ["t"]}, {"id": "c2"}]}, {"id": "q", "cases": []}]}')
    assert [tuple(r) for r in S.suite_cases(spark, str(tmp_path / "suite.json")).orderBy("case_id").collect()] == [("s", "p", "x.md", "c1", "why", "", ["t"]), ("s", "p", "x.md", "c2", "", "", [])]
    up = spark.createDataFrame([("a", bytearray(b"one")), ("b", bytearray(b"one")), ("c", bytearray(b"two"))], "name string, content binary")
    for _ in range(2):
        got = {r["name"]: r["sha1"] for r in S.store_uploads(up, str(tmp_path / "up")).collect()}
        assert spark.read.parquet(str(tmp_path / "up")).count() == 2 and got["a"] == got["b"] == "fe05bcdcdc4928012781a5f1a2a77cbb5398e106"
    S.write_jsonl(spark.range(3), str(tmp_path / "rows"))
    (tmp_path / "rows" / "more.json").write_text("no json\n")
    assert S.read_jsonl(spark, str(tmp_path / "rows"), "id long").count() == 3


def test_index_tables_are_read_by_bucket(spark, tmp_path):
    from marginalia.operators import indices as I

    docs = spark.createDataFrame([(d, "\n".join(f"line {d} {k} of words here" for k in range(30))) for d in range(6)], "doc_id long, text string")
    blocks = M.blocks(M.with_heading_path(M.rich_lines(docs)))
    S.write_indices({"anchors": I.anchors(blocks), "equations": I.equations(blocks), "figures": I.figures(blocks)}, str(tmp_path / "ix"))
    one = S.read_index(spark, str(tmp_path / "ix"), "anchors", 3)
    assert one.count() == blocks.where("doc_id = 3").count() and one.where("doc_id <> 3").count() == 0
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().toString()
    assert S.read_index(spark, str(tmp_path / "ix"), "equations", 3).count() == I.equations(blocks).where("doc_id = 3").count() > 0


def test_bounded_reads(spark):
    df = spark.createDataFrame([(bytearray(b"abcdef"),)], "c binary")
    row = df.select(S.head("c", 2).alias("h"), S.tail("c", 2).alias("t"), S.tail("c", 20).alias("all")).first()
    assert (bytes(row["h"]), bytes(row["t"]), bytes(row["all"])) == (b"ab", b"ef", b"abcdef")


def test_json_in_text(spark):
    df = spark.createDataFrame([('so: {"a": 1} end',), ("none",), (None,)], "t string")
    assert [r[0] and r[0]["a"] for r in df.select(S.json_in_text("t", "a int")).collect()] == [1, None, None]


def _files(spark, folder, parts):
    """The events of the smallest tables as files of a stream, in order of time."""
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = sorted(events.collect(), key=lambda r: (r["ts"], r["event_id"]))
    cut = [len(rows) * k // parts for k in range(parts + 1)]

    def write(k):
        spark.createDataFrame(rows[cut[k] : cut[k + 1]], events.schema).coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")

    return rows, write


def _folded(rows):
    want = {}
    for r in rows:
        want[r["user_id"]] = E.step(want.get(r["user_id"], (-1, "idle", 0, 0)), r["event_id"], r["event_type"])
    return want


def test_task_states_go_on_from_a_checkpoint(spark, tmp_path):
    """The stream is stopped between files and started again; a batch that failed half-way is run again."""
    rows, write = _files(spark, tmp_path / "in", 3)
    folder = f"file://{tmp_path}/state"
    for k in range(3):
        write(k)
        got = {r["user_id"]: (r["task"], r["status"], r["done"], r["rejected"]) for r in E.task_states(E.source(spark, str(tmp_path / "in")), folder).collect()}
        assert got == _folded(rows[: len(rows) * (k + 1) // 3])
    import shutil

    shutil.rmtree(tmp_path / "state" / "checkpoint" / "commits")  # as if no batch had been committed
    again = {r["user_id"]: (r["task"], r["status"], r["done"], r["rejected"]) for r in E.task_states(E.source(spark, str(tmp_path / "in")), folder).collect()}
    assert again == _folded(rows)


def test_one_hot_user_is_a_row_a_slice(spark):
    import random

    r = random.Random(2)
    rows = [(1, i, r.choice(["click", "view", "purchase", "error", "signup"]), 60 * i) for i in range(3000)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, t long").selectExpr("user_id", "event_id", "event_type", "timestamp_seconds(t) as ts")
    assert E.slices(events).count() == 50
    got = E.advanced(spark.createDataFrame([], E.STATE), events).first()
    want = (-1, "idle", 0, 0)
    for _, i, kind, _ in rows:
        want = E.step(want, i, kind)
    assert (got["task"], got["status"], got["done"], got["rejected"]) == want


def test_windows_and_duplicates_go_on_from_a_checkpoint(spark, tmp_path):
    rows, write = _files(spark, tmp_path / "in", 2)
    out, check = f"{tmp_path}/out", f"{tmp_path}/check"

    def run(stream, name):
        stream.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{check}/{name}").trigger(availableNow=True).outputMode("append").start().awaitTermination()
        return spark.read.parquet(f"{out}/{name}").collect()

    for k in range(2):
        write(k)
        if k:  # the first file once more, under another name
            spark.read.parquet(f"{tmp_path}/in/events.parquet").limit(50).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/events.parquet")
        distinct = run(E.distinct_events(E.source(spark, str(tmp_path / "in"))), "distinct")
        windows = run(E.window_counts(E.source(spark, str(tmp_path / "in")), late="1 hour"), "windows")
    assert sorted(r["event_id"] for r in distinct) == sorted(r["event_id"] for r in rows)
    # Windows behind the watermark are written once.
    assert len({(r["start"], r["event_type"]) for r in windows}) == len(windows) > 0


def test_pages_budget(spark):
    hits = spark.createDataFrame([("q", 1, "a" * 7), ("q", 2, "b" * 7), ("q", 3, "c")], "query_id string, rank int, text string")
    assert [r["rank"] for r in R.within_budget(hits, 10).orderBy("rank").collect()] == [1]


def test_blocks_without_a_common_word_are_no_pairs(spark):
    """No word, number or formula in common, and no number sought: no pair, however many blocks; a block that contains the beginning within its words is one."""
    from marginalia.operators import indices as I

    seg = [(1, i, f"alpha{i} beta{i} gamma{i} delta{i}", "", "", 0, False, [f"alpha{i}", f"beta{i}", f"gamma{i}", f"delta{i}"]) for i in range(300)]
    seg += [(1, 900, "ta0 middle0 ep", "", "", 0, False, ["ta0", "middle0", "ep"]), (1, 901, "lon", "", "", 0, False, ["lon"])]
    rows = [(1, f"p{i}", i, "paragraph", False, 0, f"zeta{i} middle{i} epsilon{i}", "", False, [f"zeta{i}", f"middle{i}", f"epsilon{i}"]) for i in range(300)]
    seg = spark.createDataFrame(seg, "doc_id long, seg_no int, segment string, heading string, prefer_kind string, wanted int, q_eq boolean, q_words array<string>")
    rows = spark.createDataFrame(rows, "doc_id long, block_id string, order_index int, kind string, is_caption boolean, number int, text string, b_heading string, b_eq boolean, b_words array<string>")
    got = {(r["seg_no"], r["block_id"]) for r in I.block_pairs(seg, rows).collect()}
    assert {p for p in got if p[0] < 900} == set() and (900, "p0") in got and len({p for p in got if p[0] == 901}) == 300


def test_names_of_authors_with_apostrophes_are_noise(spark):
    from marginalia.operators import cleanup as C

    lines = ["J. O'Neil et al.", "M. Smith-Jones et al.", "J. O'Neil et al. show that"]
    assert [r[0] for r in spark.createDataFrame([(x,) for x in lines], "x string").select(C.is_noise_line("x")).collect()] == [True, True, False]


def test_phrases_are_found_alike_however_many(spark, monkeypatch):
    from marginalia.operators import library as L

    signals = spark.createDataFrame([(1, "head", 2.0, "in the light of it"), (1, "body", 1.0, "light of the in"), (2, "body", 1.0, ""), (3, "body", 1.0, None), (4, "body", 1.0, "the light the light")], "doc_id long, signal string, weight double, text string")
    phrases = spark.createDataFrame([("a", "the light"), ("b", "light"), ("c", "in the light of it"), ("d", "ght of"), ("e", "it in")], "label string, phrase string")
    found = []
    for few in (200, 0):
        monkeypatch.setattr(L, "FEW_PHRASES", few)
        found.append(sorted(map(tuple, L.phrase_hits(phrases, signals).collect())))
    assert found[0] == found[1] and [r[3] for r in found[0]] == ["b", "a", "b", "c", "a", "b"]


def test_a_sentence_is_cleaned_once_for_all_its_marks(spark):
    """the plan holds the clean-up once, not once a mark."""
    from marginalia.operators.selection import critical_fact

    x = spark.createDataFrame([("The camera (12) of Fig. 3 has $x_1 = 2$ [3-5] and a long baseline of 40 cm in the experiment.",), ("",), (None,)], "x string")
    made = x.select(critical_fact("x").alias("fact"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("<[^>]+>") == 1
    assert [round(r[0], 2) for r in made.collect()][1:] == [0.0, 0.0] and made.first()[0] > 0.6
