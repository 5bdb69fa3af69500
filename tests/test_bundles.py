"""Outputs that appear as a whole, and retrieval from a stored index."""

import glob
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import answers, chunking, index
from quire.sources import artifacts, bundles, retrieval
from tests.conftest import SMALL


def examples(spark, *names):
    said = lambda text: [("system", "s"), ("user", '<doc id="1">x</doc>'), ("assistant", text)]
    rows = [(n, i % 2 == 0, said("yes [1]" if i % 2 == 0 else "I couldn't find that in the book."), "train") for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "example_id string, answerable boolean, messages array<struct<role:string,content:string>>, split string")


def test_a_failure_between_tables_leaves_the_old_bundle(spark, tmp_path, monkeypatch):
    folder = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError, match="nothing was published"):
        artifacts.read_training(spark, folder)
    ids = lambda: sorted(r.example_id for r in artifacts.read_training(spark, folder).collect())
    artifacts.write_training(examples(spark, "a", "b"), folder)
    assert ids() == ["a", "b"]

    def gone(df, title):
        raise OSError("disk full")

    monkeypatch.setattr(artifacts.synthesis, "training_manifest", gone)
    with pytest.raises(OSError, match="disk full"):
        artifacts.write_training(examples(spark, "c", "d").withColumn("book_id", F.lit("x")), folder)
    assert ids() == ["a", "b"]
    monkeypatch.undo()
    artifacts.write_training(examples(spark, "e", "f"), folder)
    assert ids() == ["e", "f"]


def test_what_is_checked_is_what_is_written(spark, tmp_path):
    made = examples(spark, "a", "b").withColumn("example_id", F.expr("uuid()"))
    path = artifacts.write_training(made, str(tmp_path / "out"))
    twice = [sorted(r.example_id for r in artifacts.read_training(spark, str(tmp_path / "out")).collect()) for _ in range(2)]
    assert twice[0] == twice[1] and len(glob.glob(f"{path}/examples/split=train/part-*")) >= 1


def test_retrieval_reads_the_folders_of_asked_tokens(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source")
    chunks = chunking.of_documents(docs).cache()
    questions = spark.read.parquet(f"{SMALL}/benchmark.parquet").where("item_id < 2").selectExpr("item_id AS question_id", "text AS question")
    retrieval.write_retrieval(chunks, str(tmp_path))
    stored = retrieval.Retrieval(spark, str(tmp_path))
    rows = lambda df: sorted((r.question_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert rows(stored.retrieve(questions)) == rows(index.retrieve(chunks, questions))
    asked = index.postings(questions, "question_id", "question").select("token")
    wanted = asked.distinct().count()
    read = stored.of_tokens("postings", asked)
    plan = read._jdf.queryExecution().executedPlan().toString()
    buckets = {r.bucket for r in asked.distinct().select(retrieval._bucket(F.col("token"), retrieval.BUCKETS).alias("bucket")).collect()}
    assert len(buckets) <= wanted < retrieval.BUCKETS
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ IN", plan)
    assert {r.bucket for r in read.select("bucket").distinct().collect()} <= buckets
    with pytest.raises(ValueError, match="made by hash-512, not by other"):
        retrieval.Retrieval(spark, str(tmp_path), "other")
    assert rows(stored.bm25(questions.limit(0))) == []


def test_postings_are_kept_by_block(spark, tmp_path):
    """A token has one row for a block of texts, not one for each text; places lead back to the texts."""
    rows = [(f"c{i:04d}", "every word" + " again" * (i % 3) + (" once" if i == 900 else "")) for i in range(3000)] + [("none", None), ("empty", "")]
    chunks = spark.createDataFrame(rows, "chunk_id string, text string").repartition(2)
    retrieval.write_retrieval(chunks, str(tmp_path))
    stored = retrieval.Retrieval(spark, str(tmp_path))
    posts = stored.table("postings")
    assert posts.count() <= 4 * 4 and posts.agg(F.sum(F.size("places"))).first()[0] == index.postings(chunks).count()
    ids = stored.table("chunks").select("chunk_id", F.floor(F.col("number") / retrieval.TEXTS).alias("block"), (F.col("number") % retrieval.TEXTS).cast("int").alias("place"))
    back = posts.select("token", "block", F.explode(F.arrays_zip("places", "times")).alias("x")).selectExpr("token", "block", "x.places AS place", "x.times AS tf").join(ids, ["block", "place"])
    pairs = lambda df: sorted(tuple(r) for r in df.select("chunk_id", "token", F.col("tf").cast("int")).collect())
    assert pairs(back) == pairs(index.postings(chunks))
    questions = spark.createDataFrame([(1, "once again"), (2, "again again every"), (3, "unknown")], "question_id long, question string")
    hits = lambda df: sorted((r.question_id, r.chunk_id, r["rank"], round(r.score, 9)) for r in df.collect())
    assert hits(stored.bm25(questions)) == hits(index.bm25(chunks, questions))
    assert hits(stored.retrieve(questions)) == hits(index.retrieve(chunks, questions))


def test_runs_end_with_their_block():
    number = np.array([0, 1, 2, 1022, 1023, 1024, 1025, 1 << 33, (1 << 33) + 1])
    found = [(block, first, part.num_rows) for block, first, part in retrieval._runs([pa.record_batch([pa.array(number)], ["number"]), pa.record_batch([pa.array([5])], ["number"])])]
    assert found == [(0, 0, 3), (0, 1022, 2), (1, 0, 2), ((1 << 33) // 1024, 0, 2), (0, 5, 1)]


def test_no_variant_ran(spark):
    def absent():
        raise ValueError("not set")

    with pytest.raises(ValueError, match="no variant ran: a: ValueError: not set"):
        answers.ablation(spark, {"a": absent})


def test_versions_are_seen_when_published(spark, tmp_path):
    folder, one = str(tmp_path), spark.createDataFrame([(1,)], "a int")
    bundles.publish(spark, folder, {"t": lambda path: one.write.parquet(path)})
    first = bundles.published(spark, folder)
    one.write.parquet(f"{folder}/versions/half/t")
    assert bundles.published(spark, folder) == first and bundles.read(spark, first, "t").count() == 1
