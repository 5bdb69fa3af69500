"""Operator 9: sources mixed to target weights along a time-varying curriculum, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, table

MAX_REPEATS = 3
SEED = 42
#: Hex digits of a document's hash that name its cell: places in a source come from sums over these cells.
CELL_DIGITS = 3
#: The slope of a source's weight over the run: odd-numbered sources fade out, even-numbered ones fade in.
SLOPE = 0.5


def targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size): sources in code point order, null last, weigh 1, 2, 3 in turn.

    A target stops at `repeats` times its source's size and the excess goes to the others by weight. The sources stop
    in the order of size over weight, so one pass of running sums finds the level at which the rest share what is left.
    This table has one row per source; its windows see sums, never documents.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    df = sizes.withColumn("n", F.row_number().over(by_name)).withColumn("weight", (F.col("n") - 1) % 3 + 1)
    cap = F.col("source_size") * repeats
    by_level = Window.orderBy(F.col("source_size") / F.col("weight"), "n")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns(
        {
            "total": F.sum("source_size").over(everything),
            "weights": F.sum("weight").over(everything),
            "capped": F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "gone": F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    level = (F.col("total") - F.col("capped")) / (F.col("weights") - F.col("gone"))
    df = df.withColumn("level", level)
    # The level is the least one: it falls as sources that stop are added, then rises again.
    stops = F.col("level") * F.col("weight") >= cap
    df = df.withColumn("stops", stops)
    share = F.min(F.when(~F.col("stops"), F.struct(F.col("gone"), F.col("level")))).over(everything)["level"]
    target = F.when(F.col("stops"), cap.cast("double")).otherwise(F.col("weight") * share)
    return df.select("source", "source_size", "n", F.coalesce(target, F.lit(0.0)).alias("target"), "total")


def curriculum_position(demand: Column, target: Column, n: Column, slope: float = SLOPE) -> Column:
    """The moment of the run, 0 to 1, at which a source has spent `demand` of its target.

    A source's weight runs linearly from 1 - s to 1 + s times its mean, where s is slope or -slope by its number. Its
    integral up to t, the share spent, is (1 - s) t + s t^2; this is the inverse.
    """
    s = F.when(n % 2 == 0, F.lit(slope)).otherwise(F.lit(-slope))
    spent = F.least(F.lit(1.0), demand / target)
    return F.abs((F.sqrt((1 - s) * (1 - s) + 4 * s * spent) - (1 - s)) / (2 * s))


def mix(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """docs with _size, _source_size, _target, _copies, _taken and _positions (of the copies, in order).

    Each source is laid out in the order of a hash of its ids. Every document is taken target / source_size times
    rounded down; one more copy goes to those whose middle lies in the part of the layout that the rest of the target
    covers, so a source misses its target by half a document at most. Where a layout repeats, later rounds follow
    earlier ones. Places within a source are sums over cells of the hash, so no source is held in one task.

    Null and empty texts have size 0 and are taken no times; a null source is a source of its own. Repeated rows are
    documents of their own: they share a hash and follow each other. Other columns stay; an empty table stays empty.
    """
    kept = docs.columns
    order = F.md5(F.concat_ws("|", F.lit(str(SEED)), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    df = docs.withColumns({"_size": n_words(F.col(text_col)), "_hash": order})
    df = df.withColumn("_cell", F.substring("_hash", 1, CELL_DIGITS))
    df = df.withColumn("_source", F.col(source_col))
    cells = df.groupBy("_source", "_cell").agg(F.sum("_size").alias("bytes"))
    sources = targets(cells.groupBy(F.col("_source").alias("source")).agg(F.sum("bytes").alias("source_size")))
    before = Window.partitionBy("_source").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("_source", "_cell", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("_start"))
    starts = starts.join(sources, F.col("_source").eqNullSafe(F.col("source")))
    starts = starts.select(F.col("_source").alias("_s"), F.col("_cell").alias("_c"), "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), F.col("n").alias("_n"))
    inside = Window.partitionBy("_source", "_cell").orderBy("_hash", "_size").rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
    df = df.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_cell") == F.col("_c")))
    df = df.withColumn("_at", F.col("_start") + F.col("_inside"))
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(0.0)
    whole = F.least(F.lit(MAX_REPEATS), F.floor(ratio + 1e-9)).cast("int")
    rest = F.col("_target") - whole * F.col("_source_size")
    more = F.when((whole < MAX_REPEATS) & (F.col("_at") + F.col("_size") / 2 < rest), 1).otherwise(0)
    copies = F.when(F.col("_size") > 0, whole + more).otherwise(0)
    df = df.withColumn("_copies", copies).withColumn("_taken", F.col("_size") * F.col("_copies"))
    demand = lambda i: F.col("_at") + i * F.col("_source_size")
    place = lambda i: curriculum_position(demand(i), F.col("_target"), F.col("_n"))
    none = F.array().cast("array<double>")
    positions = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), place)).otherwise(none)
    df = df.withColumn("_positions", positions)
    return df.select(*kept, "_size", "_source_size", "_target", "_copies", "_taken", "_positions")


def training_order(mixed: DataFrame) -> DataFrame:
    """A row for each copy, range-sorted by its position in the run: sorting by range needs no task with all rows."""
    columns = [c for c in mixed.columns if c != "_positions"]
    return mixed.select(*columns, F.explode("_positions").alias("_position")).orderBy("_position", "doc_id")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    first = F.round(F.try_element_at("_positions", F.lit(1)), 9).alias("first_position")
    out = out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), first)
    return out.orderBy("first_position", "doc_id")


OP9_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('42|' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), sizes AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), named AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight
  FROM sizes
), leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level,
         coalesce(sum(weight) OVER b, 0) AS gone
  FROM named WINDOW b AS (ORDER BY source_size / weight::DOUBLE, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shared AS (
  SELECT *, level * weight >= 3 * source_size AS stops FROM leveled
), targets AS (
  SELECT source, source_size, n,
         CASE WHEN stops THEN 3.0::DOUBLE * source_size
              ELSE weight * (SELECT arg_min(level, gone) FROM shared WHERE NOT stops) END AS target
  FROM shared
), placed AS (
  SELECT doc_id, size, source_size, target, n,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos,
         least(3, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END)::INT AS whole
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
), taken AS (
  SELECT *, CASE WHEN size = 0 THEN 0 WHEN whole < 3 AND pos + size / 2.0::DOUBLE < target - whole * source_size THEN whole + 1 ELSE whole END AS copies,
         CASE WHEN n % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS s
  FROM placed
)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken,
       CASE WHEN copies > 0 THEN round(abs((sqrt((1 - s) * (1 - s) + 4 * s * least(1.0, pos / target)) - (1 - s)) / (2 * s)), 9) END AS first_position
FROM taken
"""
