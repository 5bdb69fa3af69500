"""What a run leaves behind, as Parquet and JSON tables in a folder that every executor can reach."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import index, synthesis, thematic
from quire.operators.tables import kept
from quire.sources import bundles


def _by_book(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the books in df and leaves those of other books alone.

    Rows stay where they are, so a book of any size is written by many tasks; each writes a file per book it holds.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").parquet(path)


def write_index(chunks: DataFrame, folder: str) -> None:
    """Chunks, then postings and vectors, then metadata, by book: a new book whose metadata is there is complete.

    Indexing a book again replaces it, and postings or vectors of chunks that are gone don't count when it is read.
    What is built on is the table of chunks just written, not its plan.
    """
    spark = chunks.sparkSession
    books = chunks.select("book_id").distinct()
    _by_book(chunks, f"{folder}/chunks")
    written = spark.read.parquet(f"{folder}/chunks").join(books, "book_id", "left_semi")
    book_of = written.select("chunk_id", "book_id")
    posts = index.postings(written)
    _by_book(posts.join(book_of, "chunk_id"), f"{folder}/postings")
    _by_book(index.hashed(posts).join(book_of, "chunk_id"), f"{folder}/vectors")
    _by_book(index.metadata(written), f"{folder}/metadata")


def read_index(spark: SparkSession, folder: str, *books: str) -> dict[str, DataFrame]:
    """The tables of the books named, or of all, without those whose metadata is missing. Other books aren't read.

    Postings and vectors of unknown chunks are left out: a book that has lost all its tokens writes no new ones over
    the old.
    """
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    chosen = lambda df: df.where(F.col("book_id").isin(*books)) if books else df
    complete = chosen(read("metadata"))
    ready = complete.select("book_id")
    chunks = chosen(read("chunks")).join(ready, "book_id", "left_semi")
    known = chunks.select("book_id", "chunk_id")
    return {"metadata": complete, "chunks": chunks} | {name: chosen(read(name)).join(known, ["book_id", "chunk_id"], "left_semi") for name in ("postings", "vectors")}


#: Schemas of the JSON-lines artifacts of a book.
CONTEXT = "struct<chunk_id:string,text:string,is_golden:boolean>"
EXAMPLES = f"example_id string, book_id string, question string, contexts array<{CONTEXT}>, answer string, answerable boolean"
PAIRS = "pair_id string, book_id string, chunk_id string, chapter string, question string, answer string, quotes array<string>"
NODES = "node_id string, book_id string, level int, n int, title string, n_children long, n_chunks long, summary string"
CHILDREN = "book_id string, node_id string, child string, n int"
MEMBERS = "book_id string, node_id string, chunk_id string, ordinal int"


def write_json_lines(rows: DataFrame, path: str, *by: str) -> None:
    """rows as JSON lines; nulls are written, so that a reader sees every field."""
    writer = rows.write.mode("overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines artifact. A line that isn't an object of this schema ends the job with an error; blank lines don't count."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, EXAMPLES)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return read_json_lines(spark, path, PAIRS)


def write_tree(nodes: DataFrame, chunks: DataFrame, folder: str) -> None:
    """The nodes of trees, then what lies below them as rows, then what they were made from as the last: see `read_tree`."""
    columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
    write_json_lines(nodes.select(*columns(NODES)), f"{folder}/nodes")
    written = read_json_lines(nodes.sparkSession, f"{folder}/nodes", NODES)
    write_json_lines(thematic.node_children(written).select(*columns(CHILDREN)), f"{folder}/children")
    children = read_json_lines(nodes.sparkSession, f"{folder}/children", CHILDREN)
    write_json_lines(thematic.node_chunks(written, chunks, children).select(*columns(MEMBERS)), f"{folder}/members")
    write_json_lines(thematic.tree_identity(written, chunks), f"{folder}/identity")


def read_tree(spark: SparkSession, folder: str, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, children, members) of trees that fit the chunks; else an error that names the first of their faults."""
    read = lambda name, schema: read_json_lines(spark, f"{folder}/{name}", schema)
    parts = read("nodes", NODES), read("children", CHILDREN), read("members", MEMBERS)
    faults = thematic.tree_faults(*parts, chunks)
    stale = thematic.stale_trees(read("identity", "book_id string, source_hash string"), chunks).select("book_id", "reason", F.lit(None).cast("string").alias("what"))
    first = faults.unionByName(stale).orderBy("book_id", "reason", "what").limit(5).collect()
    if first:
        raise ValueError("unusable trees: " + "; ".join(f"{r.book_id}: {r.reason} {r.what or ''}".strip() for r in first))
    return parts


def write_report(summaries: DataFrame, path: str, **identity: str) -> None:
    """A report of few rows, such as metrics or manifests, each with what it was made from, as one JSON-lines file."""
    named = summaries.withColumns({k: F.lit(v) for k, v in identity.items()})
    write_json_lines(_in_places(named).coalesce(1), path)


def _in_places(df: DataFrame) -> DataFrame:
    """Doubles rounded to the four places of reports."""
    return df.select(*(X.four_places(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def append_cache(made: DataFrame, path: str) -> None:
    """Adds (key, pos, value) rows to a cache that only grows; a null value is a failure and isn't kept."""
    made.where("value is not null").select("key", "pos", "value").write.mode("append").parquet(path)


def write_training(examples: DataFrame, folder: str, title: str = "the book") -> str:
    """Publishes chat examples (with split) as JSON lines for training and validation, with a manifest; the path of what was written.

    The plan runs once: what is checked is what is written. Examples at fault publish nothing, and a failure between two
    tables leaves the bundle that was there (see `bundles`, and `read_training`).
    """
    made = kept(examples)
    faults = synthesis.errors(made, title).groupBy("error").agg(F.count(F.lit(1)).alias("n")).orderBy("error").collect()  # a row per kind
    if faults:
        raise ValueError("invalid examples: " + ", ".join(f"{r['error']} ({r['n']})" for r in faults))
    kinds = {r["answerable"] for r in made.select("answerable").distinct().collect()}  # two at most
    if kinds != {True, False}:
        raise ValueError("training needs answerable and unanswerable examples")
    tables = {"examples": lambda path: write_json_lines(made.select("split", "example_id", "messages"), path, "split")}
    if "book_id" in made.columns:
        tables["manifest"] = lambda path: write_json_lines(synthesis.training_manifest(made, title).coalesce(1), path)
    return bundles.publish(made.sparkSession, folder, tables)


def read_training(spark: SparkSession, folder: str) -> DataFrame:
    """(split, example_id, messages) of the bundle published last."""
    messages = "array<struct<role:string,content:string>>"
    return read_json_lines(spark, f"{bundles.published(spark, folder)}/examples", f"example_id string, messages {messages}, split string")


def write_synthesis(pairs: DataFrame, examples: DataFrame, manifest: DataFrame, folder: str) -> str:
    """Publishes what synthesis gives, which appears as a whole: judged pairs kept and rejected, examples, and the manifest by book."""
    judged, kept_ones = kept(pairs), F.col("reason").isNull()
    plain = [c.split()[0] for c in PAIRS.split(", ") if c.split()[0] in judged.columns]
    return bundles.publish(
        judged.sparkSession, folder,
        {
            "pairs": lambda path: write_json_lines(judged.where(kept_ones).select(*plain), path),
            "rejected": lambda path: write_json_lines(judged.where(~kept_ones).select(*plain, "reason"), path),
            "raft": lambda path: write_json_lines(examples, path),
            "manifest": lambda path: write_json_lines(manifest.coalesce(1), path),
        },
    )
