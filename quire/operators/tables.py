"""Tables that are built once and used several times."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The least and the greatest number of cells that ids are dealt to, and the error of their bounds as a part of all rows.
CELLS, MOST_CELLS, ACCURACY = 64, 1024, 10_000
#: Rows of a table of ids or tokens that may be sent to all tasks.
FEW = 100_000


def _set_folder(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):  # not local-cluster
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared checkpoint folder."""
    _set_folder(df.sparkSession)
    return df.checkpoint()


def few(df: DataFrame, most: int = FEW) -> DataFrame:
    """df, kept; with at most `most` rows it goes to all tasks, so what it is joined with stays where it is.

    For narrow rows only. With more rows, joins with it are what Spark plans for any table.
    """
    df = kept(df)
    return F.broadcast(df) if df.count() <= most else df


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the shared checkpoint folder."""
    _set_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared checkpoint folder: for texts, which take a fraction of the
    space of `kept` there, and for tables of which a reader wants few columns."""
    path = new_folder(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cells(rows: DataFrame, by: str) -> Column:
    """The cell of a numeric column that a row falls into, along which the column grows; nulls come first.

    Bounds are quantiles of the column, found in a job that reads nothing else, so cells hold about as many rows each
    however far apart ids lie, and there are as many cells at most as twice the session's shuffle partitions ask for.
    """
    n = min(MOST_CELLS, max(CELLS, 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    found = rows.agg(F.percentile_approx(F.col(by), [i / n for i in range(1, n)], ACCURACY)).first()[0]
    bounds = sorted(set(found or []))

    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        middle = (lo + hi) // 2
        return F.when(F.col(by) <= bounds[middle], place(lo, middle)).otherwise(place(middle + 1, hi))

    return F.when(F.col(by).isNull(), -1).otherwise(place(0, len(bounds)))


def running(rows: DataFrame, group: str, order: list[str], **sums: Column) -> DataFrame:
    """rows with a column for each of sums: its total over the rows before, within the group and by the order.

    The first of `order` is a number, of any size. Rows are summed within cells of it (see `cells`) and moved on by the
    sums of the cells before, so no task holds a group. Rows are numbered one by one, so repeated ones keep their own places.
    Sums within cells and those of the cells before meet by one key, a struct as groups may be null: rows are shuffled once.
    """
    rows = rows.withColumns({"_key": F.struct(F.col(group).alias("g"), cells(rows, order[0]).alias("b"))} | {f"_{name}": value for name, value in sums.items()})
    blocks = rows.groupBy("_key").agg(*(F.sum(f"_{name}").alias(f"_t_{name}") for name in sums))
    earlier = Window.partitionBy("_key.g").orderBy("_key.b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_key", *(F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums))
    within = Window.partitionBy("_key").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_w_{name}": F.coalesce(F.sum(f"_{name}").over(within), F.lit(0)) for name in sums})
    joined = rows.join(blocks, "_key")
    added = {name: (F.col(f"_w_{name}") + F.col(f"_o_{name}")).cast("long") for name in sums}
    return joined.withColumns(added).drop("_key", *(f"{p}_{name}" for p in ("_t", "_o", "_w") for name in sums), *(f"_{name}" for name in sums))
