"""Outputs of several tables that appear as a whole: staged under a version, then published by a marker written last."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.operators.completions import complete_folders

MARKERS = "published"


def published(spark: SparkSession, folder: str) -> str:
    """The path of the version published last; FileNotFoundError if there is none.

    A version whose tables or marker weren't finished isn't seen, so a failure between two tables leaves the last one.
    """
    markers = complete_folders(spark, f"{folder}/{MARKERS}")
    if not markers:
        raise FileNotFoundError(f"nothing was published in {folder}")
    version = spark.read.schema("version string").json(f"{folder}/{MARKERS}/{markers[-1]}").first()["version"]
    return f"{folder}/versions/{version}"


def publish(spark: SparkSession, folder: str, tables: dict[str, Callable[[str], None]]) -> str:
    """Writes each of tables by name (a function that writes to the path it gets), then makes them what readers see.

    Tables are written in order, each under a version of its own and only once. The marker is one row, written by Spark
    to a folder that counts when it is complete. Versions before stay where they are. One publisher at a time.
    """
    version = uuid.uuid4().hex
    path = f"{folder}/versions/{version}"
    for name, write in tables.items():
        write(f"{path}/{name}")
    markers = complete_folders(spark, f"{folder}/{MARKERS}")
    number = int(markers[-1].split("=")[1]) + 1 if markers else 1
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{folder}/{MARKERS}/number={number:012d}")
    return path


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A Parquet table of a version."""
    return spark.read.parquet(f"{path}/{name}")
