"""Calls to a language model that may fail, and the logs that keep what they gave."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.tables import kept

#: A model's client: from the system and the user prompt, the reply; it may raise. Each task opens its own.
Client = Callable[[str, str], str]
Connect = Callable[[], Client]

#: Prompts that are asked before their replies are handed on, calls for one prompt, and characters of an error.
AT_ONCE, ATTEMPTS, MAX_ERROR = 64, 3, 300
ENTRY = "key string, pos long, value string"


def completed(asked: DataFrame, connect: Connect, attempts: int = ATTEMPTS, at_once: int = AT_ONCE, wait: float = 0.0) -> DataFrame:
    """(key, reply, error, attempts) for each distinct key of asked (key, system, user); the least prompt of a key is sent.

    connect runs in the task, once unless it fails. A call that raises, or replies with something else than text, is made
    again after `wait` seconds, then twice that and so on; after the last attempt the row has the error and no reply, and
    the other rows have theirs. Replies are written before they are used: no action asks twice, and a lost executor costs
    the prompts of its own tasks only. A null prompt counts as empty.
    """
    once = asked.groupBy("key").agg(F.min(F.struct(*(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("system", "user")))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client: Client | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, at_once):
                part, out = batch.slice(at, at_once), []
                for system, user in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    reply = error = None
                    for n in range(1, attempts + 1):
                        try:
                            client = client or connect()
                            reply = client(system, user)
                            if not isinstance(reply, str):
                                raise TypeError(f"a reply of type {type(reply).__name__}")
                            error = None
                            break
                        except Exception as problem:  # whatever a client raises belongs to its row
                            reply, error = None, f"{type(problem).__name__}: {problem}"[:MAX_ERROR]
                            if n < attempts and wait:
                                time.sleep(wait * 2 ** (n - 1))
                    out.append((reply, error, n))
                replies, errors, tries = map(list, zip(*out))
                columns = [part.column(0), pa.array(replies, pa.string()), pa.array(errors, pa.string()), pa.array(tries, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "reply", "error", "attempts"])

    rows = once.select("key", "p.system", "p.user")
    return kept(rows.mapInArrow(run, "key string, reply string, error string, attempts int"))


def complete_folders(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in path whose writing ended, in order; none if there is no such path."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(top):
        return []
    names = [s.getPath().getName() for s in files.listStatus(top) if s.isDirectory()]
    return sorted(n for n in names if files.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def append_log(entries: DataFrame, folder: str, run: int) -> None:
    """Adds entries (key, pos, value) as JSON lines of a run to a log that only grows; a null value isn't kept.

    Runs are numbered by the caller, later ones count more. A run that failed half-way isn't read; made again under its
    number it takes its own place, so nothing is doubled.
    """
    entries.where("value is not null").select("key", "pos", "value").write.mode("overwrite").json(f"{folder}/log/run={run:012d}")


def _read(spark: SparkSession, paths: list[str], run: Column) -> DataFrame:
    """The lines of a log as (line, run, key, pos, value); a line that isn't an entry has nulls."""
    if not paths:
        return spark.createDataFrame([], f"line string, run long, {ENTRY}")
    lines = spark.read.text(paths).where(F.trim("value") != "")
    parsed = F.from_json("value", ENTRY)
    lines = lines.select(F.col("value").alias("line"), run.cast("long").alias("run"), parsed.alias("e"))
    return lines.select("line", "run", "e.key", "e.pos", "e.value")


def scan_log(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejected) of a log: (key, run, pos, value), and (line, reason) of lines that are no entries.

    What was compacted comes from the newest base, the rest from the runs after it. A torn or foreign line costs itself
    only. A log that doesn't exist yet is empty.
    """
    bases = complete_folders(spark, f"{folder}/base")
    upto = bases[-1].split("=")[1] if bases else ""
    runs = [n for n in complete_folders(spark, f"{folder}/log") if n.split("=")[1] > upto]
    of_file = F.regexp_extract(F.col("_metadata.file_path"), r"(?:run|upto)=([0-9]+)", 1)
    lines = _read(spark, [*(f"{folder}/base/{b}" for b in bases[-1:]), *(f"{folder}/log/{n}" for n in runs)], of_file)
    reason = F.when(F.col("key").isNull() | (F.col("key") == ""), "no key").when(F.col("pos").isNull(), "no position").when(F.col("value").isNull(), "no value")
    lines = lines.withColumn("reason", reason)
    return lines.where("reason is null").select("key", "run", "pos", "value"), lines.where("reason is not null").select("line", "reason")


def latest(entries: DataFrame) -> DataFrame:
    """(key, pos, value): of each key what was written last; of one position the greatest value. Combined before the shuffle."""
    place = [c for c in ("run", "pos") if c in entries.columns]
    last = F.max(F.struct(*place, "value")).alias("e")
    return entries.groupBy("key").agg(last).select("key", "e.pos", "e.value")


def compact_log(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the last entry of each key as a new base, which the next scan starts from; gives the lines set aside.

    Nothing is deleted: until the base is complete, scans go by the old one and the runs after it.
    """
    runs = complete_folders(spark, f"{folder}/log")
    entries, rejected = scan_log(spark, folder)
    aside = kept(rejected)
    if runs:
        latest(entries).write.mode("overwrite").json(f"{folder}/base/upto={runs[-1].split('=')[1]}")
    return aside


def from_log(wanted: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted by key; hits have value."""
    known = latest(entries).select("key", "value")
    return wanted.join(known, "key"), wanted.join(known, "key", "left_anti")


def asked_once(asked: DataFrame, entries: DataFrame, connect: Connect, usable: Callable[[Column], Column], attempts: int = ATTEMPTS) -> tuple[DataFrame, DataFrame]:
    """(results, new): (key, value, made, error) for each key of asked (key, system, user), and entries for the log.

    made: "reused", "generated", or "failed" with the client's error or "unusable". usable: from a reply the value, or
    null where it can't be used. Only what the log lacks is asked; a failure isn't kept, so the next run tries again.
    """
    hits, misses = from_log(asked, entries)
    made = completed(misses, connect, attempts).withColumn("value", usable(F.col("reply")))
    made = made.withColumn("error", F.coalesce("error", F.when(F.col("value").isNull(), "unusable")))
    fresh = made.select("key", "value", F.when(F.col("value").isNull(), "failed").otherwise("generated").alias("made"), "error")
    reused = hits.select("key", "value", F.lit("reused").alias("made"), F.lit(None).cast("string").alias("error")).distinct()
    new = made.where("value is not null").select("key", F.lit(0).cast("long").alias("pos"), "value")
    return fresh.unionByName(reused), new


def lines_in_order(spark: SparkSession, path: str) -> DataFrame:
    """(line, pos): the lines of files that other programs append to, with a position that grows along each file.

    Files go by time of change, then name; within a file by the split's start, then by the line's place in the split.
    """
    where = F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n"))
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("line"), where.alias("pos"))


def last_lines(lines: DataFrame, key: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(latest, rejected) of lines (line, pos) as JSON objects: (key, value) by the last line, and (line) of the others."""
    fields = F.from_json("line", f"`{key}` string, `{value}` string")
    parsed = lines.select("line", "pos", fields[key].alias("key"), fields[value].alias("value"))
    good = (F.coalesce("key", F.lit("")) != "") & (F.coalesce("value", F.lit("")) != "")
    return parsed.where(good).groupBy("key").agg(F.max_by("value", "pos").alias("value")), parsed.where(~good).select("line")


