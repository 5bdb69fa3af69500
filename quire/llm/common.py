"""Helpers that the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the space and the five control characters from TAB to CR.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, from spark.checkpoint.dir where it isn't set yet; in local mode a folder of its own will do."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # not local-cluster
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder, so that a lost executor costs no more than its own tasks."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written as a Parquet table to the shared checkpoint folder: what `cut` does in a third of the space."""
    path = f"{_shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that are turned into Python objects at once, on average; Spark bounds the batch itself.
AT_ONCE = 8 << 20


def sliced(batches: Iterable[pa.RecordBatch], rows: int = 500, most: int = AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `most` bytes, without copying."""
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * most // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def n_words(text: Column) -> Column:
    """The number of words, 0 for null: the changes from a separator (or the start) to a word."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
