"""Documents that keep arriving, into a table of postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quire.operators import index


def arriving(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """The stream of documents (doc_id, text, source) whose Parquet files land in a folder."""
    return spark.readStream.schema("doc_id long, text string, source string").option("maxFilesPerTrigger", files_at_once).parquet(folder)


def append_postings(docs: DataFrame, table: str, progress: str) -> StreamingQuery:
    """Writes the postings of each micro-batch to its own partition of a table; ends when all that is there is read.

    docs: a stream with doc_id and text, no id twice in a batch. A batch that runs again after a failure replaces its
    partitions, so nothing counts twice. A token's document frequency comes from the table when it is read and needs
    no state here. The ids are kept beside the postings, as a text without tokens has none.
    """

    def write(batch: DataFrame, n: int) -> None:
        index.postings(batch, "doc_id").write.mode("overwrite").parquet(f"{table}/postings/batch={n}")
        batch.select("doc_id").write.mode("overwrite").parquet(f"{table}/docs/batch={n}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", progress).trigger(availableNow=True).start()


def latest(spark: SparkSession, table: str) -> DataFrame:
    """The postings of a table: a document that arrived again counts as it was in its last batch.

    A batch that was broken off before its ids were written doesn't count yet.
    """
    seen = spark.read.schema("doc_id long, batch long").parquet(f"{table}/docs")
    last = seen.groupBy("doc_id").agg(F.max("batch").alias("batch"))
    all_ = spark.read.schema("doc_id long, length int, token string, tf long, batch long").parquet(f"{table}/postings")
    return all_.join(last, ["doc_id", "batch"]).drop("batch")
