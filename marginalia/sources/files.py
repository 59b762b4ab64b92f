"""File sources and sinks: Markdown trees, bounded reads, JSON lines, listings and the incremental ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_path, stem
from .shared import cut, delete

CHUNK_SCHEMA = T.StructType([T.StructField("id", T.StringType()), T.StructField("doc_id", T.StringType()), T.StructField("chunk_idx", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("heading_path", T.StringType())])


def listing(spark: SparkSession, root: str, pattern: str = "*.md", exclude_dirs: tuple[str, ...] = ("temp", "__pycache__", ".git"), exclude_names: tuple[str, ...] = ("assets_manifest.md", "quality_report.md")) -> DataFrame:
    """path, name, modified and size of all files of a tree but those in excluded folders or of excluded names; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    out = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0)))
    return out.where(~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in exclude_dirs])) & ~F.col("name").isin(*exclude_names))


def markdown(spark: SparkSession, root: str, **kwargs) -> DataFrame:
    """path, doc_id (of the normalised path), sha1 (of the content) and md of the files of listing()."""
    names = listing(spark, root, **kwargs).select("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", kwargs.get("pattern", "*.md")).load(root)
    return files.join(names, "path", "left_semi").select("path", F.substring(F.sha1(norm_path("path")), 1, 16).alias("doc_id"), F.sha1("content").alias("sha1"), F.decode("content", "UTF-8").alias("md"))


def head(content: str, size: int):
    """The first `size` bytes of a binary column."""
    return F.substring(content, 1, size)


def tail(content: str, size: int):
    """The last `size` bytes of a binary column."""
    return F.substring(F.col(content), F.greatest(F.octet_length(content) - size + 1, F.lit(1)), F.lit(size))


def newest(files: DataFrame, n: int) -> DataFrame:
    """The n files changed last (a listing's first page)."""
    return files.orderBy(F.desc("modified"), F.desc("path")).limit(n)


def main_file(files: DataFrame) -> DataFrame:
    """For each stem the preferred file: <stem>.en.md, then output.md, then the newest."""
    rank = F.when(F.col("name").endswith(".en.md"), 2).when(F.col("name") == "output.md", 1).otherwise(0)
    return files.groupBy(F.lower(stem("path")).alias("stem")).agg(F.max_by("path", F.struct(rank.alias("rank"), "modified", "path")).alias("path"))


def write_chunks(chunks: DataFrame, folder: str) -> None:
    """JSON lines with an id for each chunk, in as many files as there are tasks."""
    chunks.withColumn("id", F.concat_ws(":", "doc_id", "chunk_idx")).write.json(folder)


def read_chunks(spark: SparkSession, store: str) -> DataFrame:
    """The chunks of a store as its last index has them: of each document those of the version that the index names, none of vanished ones."""
    index = read_index_version(spark, store)
    made = spark.read.schema(T.StructType([*CHUNK_SCHEMA, T.StructField("version", T.IntegerType())])).json(f"{store}/chunks")
    return made.join(index.select("doc_id", "version"), ["doc_id", "version"], "left_semi").drop("version")


INDEX_SCHEMA = "doc_id string, path string, sha1 string, chunks long, version int"


def _versions(spark: SparkSession, store: str) -> list[int]:
    """The committed versions of a store's index."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/versions")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(p.getName()[1:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_index_version(spark: SparkSession, store: str) -> DataFrame:
    have = _versions(spark, store)
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{store}/versions/v{have[-1]}") if have else spark.createDataFrame([], INDEX_SCHEMA)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an evaluation run; lines that are no JSON give rows of nulls, which are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


SUITE_SCHEMA = "name string, papers array<struct<id: string, path: string, cases: array<struct<id: string, prompt: string, family: string, tags: array<string>>>>>"


def suite_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of suite manifests (JSON of papers with cases), a row each: suite, paper_id, paper_path, case_id, prompt, family, tags."""
    suites = spark.read.schema(SUITE_SCHEMA).option("multiLine", True).json(path)
    papers = suites.select(F.col("name").alias("suite"), F.explode("papers").alias("p"))
    cases = papers.select("suite", F.col("p.id").alias("paper_id"), F.col("p.path").alias("paper_path"), F.explode("p.cases").alias("c"))
    return cases.select("suite", "paper_id", "paper_path", F.col("c.id").alias("case_id"), F.coalesce("c.prompt", F.lit("")).alias("prompt"), F.coalesce("c.family", F.lit("")).alias("family"), F.coalesce("c.tags", F.array().cast("array<string>")).alias("tags"))


def store_uploads(uploads: DataFrame, folder: str) -> DataFrame:
    """uploads: name, content.  Adds the contents that the folder lacks, each once, named by their SHA-1.  Returns name, sha1 and size of all uploads."""
    spark = uploads.sparkSession
    named = uploads.select("name", "content", F.sha1("content").alias("sha1"))
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = spark.read.parquet(folder).select("sha1") if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else spark.createDataFrame([], "sha1 string")
    new = named.groupBy("sha1").agg(F.first("content").alias("content")).join(known, "sha1", "left_anti")
    new.write.mode("append").parquet(folder)
    return named.select("name", "sha1", F.octet_length("content").alias("size"))


#: Buckets of the tables of structured indices; a document's rows of each are in one.
INDEX_BUCKETS = 256


def write_indices(indices: dict[str, DataFrame], folder: str) -> None:
    """Structured indices as a table each, in folders of buckets of doc_id."""
    for name, df in indices.items():
        df.withColumn("bucket", F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(INDEX_BUCKETS)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/{name}")


def read_index(spark: SparkSession, folder: str, name: str, doc_id: object) -> DataFrame:
    """The rows of one document; only its bucket is read."""
    bucket = F.pmod(F.xxhash64(F.lit(str(doc_id))), F.lit(INDEX_BUCKETS)).cast("int")
    return spark.read.parquet(f"{folder}/{name}").where((F.col("bucket") == bucket) & (F.col("doc_id").cast("string") == str(doc_id))).drop("bucket")


def tolerant_json(column: str, schema: str):
    """A decoded JSON column; what can't be decoded is null."""
    return F.from_json(column, schema, {"mode": "PERMISSIVE"})


def json_in_text(column: str, schema: str):
    """The JSON object within a text, if there is one."""
    return F.from_json(F.nullif(F.regexp_extract(column, r"(?s)\{.*\}", 0), F.lit("")), schema)


def write_csv(frames: list[DataFrame], path: str) -> None:
    """Frames of different columns as one CSV with the union of their columns."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    out.write.mode("overwrite").option("header", True).csv(path)


def changed(docs: DataFrame, index: DataFrame) -> DataFrame:
    """Documents whose content differs from the index, or is new."""
    old = index.select(F.col("doc_id").alias("_id"), F.col("sha1").alias("_sha1"))
    return docs.join(old, F.col("doc_id") == F.col("_id"), "left").where("not (sha1 <=> _sha1)").drop("_id", "_sha1")


def vanished(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Index rows whose document is gone."""
    return index.join(docs.select("doc_id"), "doc_id", "left_anti")


def next_index(index: DataFrame, docs: DataFrame, counts: DataFrame, version: int) -> DataFrame:
    """The index after an ingest.  counts: doc_id, chunks of the documents written as this version; the others keep theirs."""
    now = docs.select("doc_id", "path", "sha1").join(counts.select("doc_id", F.col("chunks").alias("_new")), "doc_id", "left")
    old = index.select("doc_id", "sha1", F.col("chunks").alias("_old"), F.col("version").alias("_version"))
    joined = now.join(old, ["doc_id", "sha1"], "left")
    fresh = F.col("_version").isNull()
    return joined.select("doc_id", "path", "sha1", F.when(fresh, F.coalesce("_new", F.lit(0).cast("long"))).otherwise(F.col("_old")).alias("chunks"), F.when(fresh, version).otherwise(F.col("_version")).alias("version"))


def ingest(spark: SparkSession, root: str, store: str, size: int = 1400, overlap: int = 200) -> dict[str, int]:
    """Scans a tree, skips unchanged documents, chunks the others and drops vanished ones.  Returns counters.

    The tree is hashed once, and read once more for the changed documents.  Chunks of a version are written beside those before, and take effect with the
    version's index, which is committed last: a run that dies leaves the last version in force, and the next one writes over its files."""
    from ..operators.markdown import chunks, lines, with_heading_path

    version = (_versions(spark, store) or [0])[-1] + 1
    index = read_index_version(spark, store)
    docs = cut(markdown(spark, root).select("path", "doc_id", "sha1"))
    fresh = cut(changed(docs, index))
    n, total, gone = fresh.count(), docs.count(), vanished(index, docs).count()
    counts = spark.createDataFrame([], "doc_id string, chunks long")
    if n:
        texts = markdown(spark, root).join(fresh.select("path"), "path", "left_semi")
        folder = f"{store}/chunks/version={version}"
        delete(spark, folder)
        write_chunks(chunks(with_heading_path(lines(texts)), size, overlap), folder)
        counts = spark.read.schema(CHUNK_SCHEMA).json(folder).groupBy("doc_id").agg(F.count("*").alias("chunks"))
    next_index(index, docs, counts, version).write.mode("overwrite").parquet(f"{store}/versions/v{version}")
    return {"documents": total, "written": n, "vanished": gone}


def ordinal(chunks: DataFrame) -> DataFrame:
    """Chunks with their place in the corpus: by document, then by number within it."""
    return chunks.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_idx")))
