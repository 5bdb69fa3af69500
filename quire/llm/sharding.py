"""Operator 4: shards of near-equal bytes by histogram sort, in DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

SHARDS = 40
ROW_BYTES = 16
#: Cells that a round divides a key range into; with it, every table that is broadcast has a fixed size.
CELLS = 4096
#: The same in the rounds after the first, which probe up to SHARDS ranges at once.
FINE_CELLS = 256
#: Cells that each shard is cut into to number its rows.
PLACES = 64
#: A splitter may miss its target by this share of a shard, or by what lies on a single key.
TOLERANCE = 0.002


def _cell(key: Column, lo: int, hi: int, cells: int) -> Column:
    """The cell of a key in lo..hi: cells of equal width, in whole numbers."""
    width = max(1, -(-(hi - lo + 1) // cells))
    return F.floor((key.cast("decimal(38,0)") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long")


@dataclass
class _Open:
    """A key range that still holds targets: keys[: len(prefix)] equal the prefix and the next one lies in lo..hi."""

    prefix: list[int]
    lo: int
    hi: int
    below: int
    targets: list[int]

    def width(self, cells: int) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // cells))


def _counted(df: DataFrame, keys: list[str], ranges: list[_Open], cells: int) -> list[list[tuple[int, int]]]:
    """For each range the (cell, bytes) of its cells that hold rows, by one pass over all partitions."""
    at = F.lit(None).cast("struct<r:int,c:bigint>")
    for n, x in enumerate(ranges):
        inside = F.col(keys[len(x.prefix)]).between(F.lit(x.lo), F.lit(x.hi))
        for key, value in zip(keys, x.prefix):
            inside = inside & (F.col(key) == F.lit(value))
        cell = _cell(F.col(keys[len(x.prefix)]), x.lo, x.hi, cells)
        at = F.when(inside, F.struct(F.lit(n).alias("r"), cell.alias("c"))).otherwise(at)
    sums = df.select(at.alias("at"), "_size").where("at is not null").groupBy("at").agg(F.sum("_size").alias("bytes"))
    out: list[list[tuple[int, int]]] = [[] for _ in ranges]
    for row in sums.collect():
        out[row["at"]["r"]].append((row["at"]["c"], int(row["bytes"])))
    return [sorted(x) for x in out]


def splitters(df: DataFrame, keys: list[str], lo: int, hi: int, targets: list[int], slack: float) -> dict[int, tuple]:
    """For each target a boundary (a tuple of key values) below which lie as many bytes, but for the slack.

    Each round counts the exact bytes of the cells of every open range in one job. A target falls into one cell; if
    neither edge of it is close enough, the cell is what the next round probes, and in a cell of a single key, the key
    after it. A round narrows a range CELLS-fold, so there are few.
    """
    found: dict[int, tuple] = {}
    ranges, cells = [_Open([], lo, hi, 0, targets)], CELLS
    while ranges:
        following: dict[tuple, _Open] = {}
        for x, counts in zip(ranges, _counted(df, keys, ranges, cells)):
            width, level = x.width(cells), len(x.prefix)
            for target in x.targets:
                run = x.below
                for cell, size in counts:
                    if run + size >= target:
                        break
                    run += size
                a = x.lo + cell * width
                start, end = (*x.prefix, a), (*x.prefix, a + width)
                short, over = target - run, run + size - target
                if min(short, over) <= slack or (width == 1 and level + 1 == len(keys)):
                    found[target] = start if short <= over else end
                elif width == 1:
                    following.setdefault(start, _Open([*x.prefix, a], -(2**63), 2**63 - 1, run, [])).targets.append(target)
                else:
                    following.setdefault(start, _Open(x.prefix, a, min(x.hi, a + width - 1), run, [])).targets.append(target)
        ranges, cells = list(following.values()), FINE_CELLS
    return found


def _not_below(keys: list[str], bound: tuple) -> Column:
    """Whether a row's keys are at or after a boundary; a boundary may be shorter than the keys."""
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, bound))):
        big = value > 2**63 - 1
        at = F.lit(None) if big else F.lit(value)
        out = F.lit(False) if big else (F.col(key) > at) | ((F.col(key) == at) & out)
    return out


def _placed(df: DataFrame) -> DataFrame:
    """df (shard, _key, _tie) with slot: its place in its shard by (_key, _tie).

    Quantiles of each shard's own keys cut it into cells of about equal numbers of rows, wherever the keys lie; a key
    that fills several of them is cut by its ties. Rows are numbered within a cell, on from the cells before it.
    """
    at = [i / PLACES for i in range(1, PLACES)]
    quantiles = df.groupBy(F.col("shard").alias("_s")).agg(F.percentile_approx("_key", F.lit(at)).alias("_q"))
    df = df.join(F.broadcast(quantiles), F.col("shard") == F.col("_s"))  # a row per shard
    cell = F.struct(
        F.size(F.filter("_q", lambda q: q < F.col("_key"))).alias("below"),
        F.size(F.filter("_q", lambda q: q == F.col("_key"))).alias("here"),
    )
    often = F.col("_c.here") > 1  # all between two equal quantiles is one key, which comes after the rest of its cell
    df = df.withColumn("_c", cell).withColumn("_t", F.when(often, F.shiftright("_tie", 58)).otherwise(F.lit(-64).cast("long")))
    df = df.withColumn("_c", F.col("_c.below"))
    group = ["shard", "_c", "_t"]
    running = Window.partitionBy("shard").orderBy("_c", "_t").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*group, F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_key", "_tie"))
    return df.withColumn("_place", place - 1).join(starts, group).withColumn("slot", (F.col("_start") + F.col("_place")).cast("long"))


def shard(rows: DataFrame, key: str, size: Column, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """rows with shard and slot: ranges of the key, in order, of near-equal total size.

    key: a column of long; null comes first. size: what is balanced, at least 0. Rows of one key are told apart by
    their other columns and then by their place in the input, so a key with very many rows, or even equal rows, is
    split like any other. Rows are written once to the checkpoint folder, so that every counting pass and the final
    exchange see the same ones: pass just the columns to be carried. slot counts from 0 in a shard without gaps, in the
    order of the keys. More shards than rows leave some empty; an empty table gives an empty result. Input columns
    named shard or slot are replaced, all others stay, whatever their names.
    """
    kept = [c for c in rows.columns if c not in ("shard", "slot")]
    spread = F.xxhash64(*(rows[c] for c in kept), F.monotonically_increasing_id())
    key_of = F.coalesce(rows[key].cast("long"), F.lit(-(2**63)))
    df = cut(rows.select(F.struct(*(rows[c] for c in kept)).alias("_row"), key_of.alias("_key"), spread.alias("_tie"), F.coalesce(size, F.lit(0)).cast("long").alias("_size")))
    keys = ["_key", "_tie"]
    thin = df.select(*keys, "_size")
    total, n, lo, hi = thin.agg(F.sum("_size"), F.count(F.lit(1)), F.min("_key"), F.max("_key")).first()
    if not n:
        return df.select("_row.*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    targets = [total * i // shards for i in range(1, shards)]
    bounds = splitters(thin, keys, lo, hi, sorted(set(targets)), tolerance * total / shards)
    shard_of = F.lit(0)
    for target in targets:
        shard_of = shard_of + _not_below(keys, bounds[target]).cast("int")
    return _placed(df.withColumn("shard", shard_of)).select("_row.*", "shard", "slot")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), crc.alias("text_crc32"))
    out = shard(docs, "doc_id", F.col("size"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
