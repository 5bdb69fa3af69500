"""Operator 3: exact top-k inner products by vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, sliced, table

SCALE = 1024
K = 10
QUERY_STEP = 100
#: Vectors in a block of the file, and cells that a block's range is quantised into in each dimension.
BLOCK = 2048
CELLS = 256
#: Share by which float bounds are widened; products of rows of 64-bit floats err by far less.
SLACK = 1e-9
#: Vectors read exactly for each query before the rest is held against the kth of them.
FIRST = 2 * K
_LONG = 2**63 - 1


def usable(vector: Column) -> Column:
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vector.isNotNull() & F.forall(vector, fine)


def _rows(lists: pa.ListArray) -> np.ndarray:
    """The vectors as rows of 64-bit floats; shorter ones are padded with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.arange(out.shape[1])[None, :] < sizes[:, None]] = flat
    return out


def _whole(rows: np.ndarray) -> np.ndarray:
    """floor(1024 x), still as floats: a product with a power of two is exact, so these are whole numbers."""
    with np.errstate(over="ignore"):
        return np.nan_to_num(np.floor(SCALE * rows))


def _unpacked(data: bytes, rows: int, kind: type) -> np.ndarray:
    flat = np.frombuffer(data, kind)
    return flat.reshape(rows, len(flat) // rows)


def approximate(whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The approximation file of a block: a cell number for each component, and each dimension's start and cell width."""
    low = whole.min(axis=0, initial=np.inf)
    width = (whole.max(axis=0, initial=-np.inf) - low) / CELLS
    cells = np.floor((whole - low) / np.where(width > 0, width, 1.0))
    return np.clip(cells, 0, CELLS - 1).astype(np.uint8), low, width


def approximation_file(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "v") -> DataFrame:
    """(ids, cells, low, width): up to BLOCK vectors a row, a byte for each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK, 64 << 20):
            cells, low, width = approximate(_whole(_rows(batch.column(1))))
            found = [batch.column(0).to_numpy().tobytes(), cells.tobytes(), low.tobytes(), width.tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in found], ["ids", "cells", "low", "width"])

    return vectors.select(id_col, vector_col).mapInArrow(run, "ids binary, cells binary, low binary, width binary")


def _query_blocks(asked: DataFrame) -> DataFrame:
    """(block, names, query_ids, queries): the queries (q, query_id, v) in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK, 64 << 20):
            names, ids = (batch.column(n).to_numpy() for n in (0, 1))
            found = [pa.array([x], pa.binary()) for x in (names.tobytes(), ids.tobytes(), _whole(_rows(batch.column(2))).tobytes())]
            yield pa.RecordBatch.from_arrays([pa.array([int(names[0])], pa.int64()), *found], ["block", "names", "query_ids", "queries"])

    return asked.mapInArrow(run, "block long, names binary, query_ids binary, queries binary")


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of every query's inner product with every vector of a block, from its cells alone."""
    dim = max(queries.shape[1], cells.shape[1])
    queries = np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
    n = dim - cells.shape[1]
    cells, low, width = np.pad(cells, ((0, 0), (0, n))), np.pad(low, (0, n)), np.pad(width, (0, n))
    with np.errstate(over="ignore", invalid="ignore"):
        middle = (queries * width) @ cells.T.astype(np.float64) + (queries @ (low + width / 2))[:, None]
        size = np.abs(queries) @ (np.abs(low) + CELLS * width)
        reach = (np.abs(queries) @ width / 2 + SLACK * size)[:, None]
        return np.nan_to_num(middle - reach, nan=-np.inf), np.nan_to_num(middle + reach, nan=np.inf, posinf=np.inf)


class _Scan:
    """What is left of the vectors for one block of queries, as blocks of cells are scanned one after another."""

    def __init__(self, block: int, names: bytes, query_ids: bytes, queries: bytes, k: int) -> None:
        self.block, self.k = block, k
        self.names, self.ids = np.frombuffer(names, np.int64), np.frombuffer(query_ids, np.int64)
        self.queries = _unpacked(queries, len(self.ids), np.float64)
        #: the k largest lower bounds of each query so far
        self.best = np.full((len(self.ids), k), -np.inf)
        self.left: list[tuple[np.ndarray, ...]] = []

    def add(self, ids: bytes, cells: bytes, low: bytes, width: bytes) -> None:
        ids, low, width = np.frombuffer(ids, np.int64), np.frombuffer(low), np.frombuffer(width)
        lower, upper = bounds(self.queries, _unpacked(cells, len(ids), np.uint8), low, width)
        own = self.ids[:, None] == ids[None, :]
        lower[own] = -np.inf
        both = np.concatenate((self.best, lower), axis=1)
        self.best = np.partition(both, both.shape[1] - self.k, axis=1)[:, -self.k :]
        row, column = np.nonzero((upper >= self.best.min(axis=1)[:, None]) & ~own)
        self.left.append((row, ids[column], lower[row, column], upper[row, column]))

    def found(self) -> pa.RecordBatch:
        row, ids, lower, upper = (np.concatenate(x) for x in zip(*self.left))
        kept = upper >= self.best.min(axis=1)[row]
        columns = [self.names[row], ids, lower, upper]
        return pa.RecordBatch.from_arrays([pa.array(c[kept]) for c in columns], ["q", "vec_id", "lower", "upper"])


def scan(files: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(q, vec_id, lower, upper): what the approximation files leave of the vectors for each query.

    Blocks of queries meet the blocks of cells of each part; a task carries a query block's kth lower bound from one
    block of cells to the next. Then the bounds of all parts meet: what can't beat the kth largest lower bound is out.
    """
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = files.withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)))
    everywhere = _query_blocks(asked).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    pairs = everywhere.join(dealt, "part").select("block", "names", "query_ids", "queries", "ids", "cells", "low", "width")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: _Scan | None = None
        for batch in sliced(batches, 1):
            (row,) = batch.to_pylist()
            if open_ is None or open_.block != row["block"]:
                if open_ is not None:
                    yield open_.found()
                open_ = _Scan(*(row[c] for c in ("block", "names", "query_ids", "queries")), k)
            open_.add(*(row[c] for c in ("ids", "cells", "low", "width")))
        if open_ is not None:
            yield open_.found()

    found = pairs.mapInArrow(run, "q long, vec_id long, lower double, upper double")
    by_lower = Window.partitionBy("q").orderBy(F.desc("lower")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kth = F.coalesce(F.nth_value("lower", k).over(by_lower), F.lit(float("-inf")))
    return found.withColumn("kth", kth).where(F.col("upper") >= F.col("kth")).select("q", "vec_id", "upper")


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The exact inner products of paired rows of whole numbers; what a long can't hold becomes the nearest long."""
    dim = max(queries.shape[1], vectors.shape[1])
    queries, vectors = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (queries, vectors))
    with np.errstate(over="ignore"):
        size = (np.abs(queries) * np.abs(vectors)).sum(axis=1)
    out = np.zeros(len(queries), np.int64)
    small = size < 2.0**52  # every partial sum is a float without error
    out[small] = (queries[small] * vectors[small]).sum(axis=1).astype(np.int64)
    for n in np.flatnonzero(~small).tolist():
        exact = sum(int(a) * int(b) for a, b in zip(queries[n].tolist(), vectors[n].tolist()))
        out[n] = max(-_LONG - 1, min(_LONG, exact))
    return out


def _exact(pairs: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """(q, query_id, vec_id, score) of pairs (q, vec_id): only their vectors are read."""
    both = pairs.select("q", "vec_id").distinct().join(asked.select("q", "query_id", F.col("v").alias("a")), "q").join(vectors.select("vec_id", F.col("v").alias("b")), "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, BLOCK, 64 << 20):
            score = products(_whole(_rows(batch.column(3))), _whole(_rows(batch.column(4))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(score)], ["q", "query_id", "vec_id", "score"])

    return both.select("q", "query_id", "vec_id", "a", "b").mapInArrow(run, "q long, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries its k rows of vectors with the largest inner products.

    Both tables have id_col (long) and vector_col (array of numbers, turned into floor(1024 x)); other columns are
    ignored. A row whose id or vector is null, or whose vector holds null or non-finite components, takes no part.
    Rows of a query's own id are no candidates. Components may be of any size; a score that a long can't hold becomes
    the nearest long. Vectors of unequal length count as padded with zeros. Equal scores go by id. Rows of vectors that
    share an id each count. Each row of queries is a query: rows that share an id have k ranks each. With fewer
    candidates than k all are returned; empty tables give an empty result.

    A file of cells, a byte for each component, is scanned for bounds. Of what they leave, the vectors of the largest
    upper bounds are read first; the rest only where its upper bound reaches the kth exact score found by then.
    """
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    all_ = pick(vectors)
    asked = cut(pick(queries).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("query_id"), "v"))
    files = cut(approximation_file(all_))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("upper"), "vec_id"))
    left = cut(scan(files, asked, k).withColumn("place", place))
    by_score = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    first = cut(_exact(left.where(F.col("place") <= max(FIRST, 2 * k)), all_, asked))
    kth = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == k).select("q", F.col("score").alias("kth"))
    done = first.select("q", "vec_id").distinct()
    more = left.where(F.col("place") > max(FIRST, 2 * k)).join(kth, "q").where(F.col("upper") >= F.col("kth") - SLACK * F.abs("kth"))
    rest = _exact(more.select("q", "vec_id").join(done, ["q", "vec_id"], "left_anti"), all_, asked)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(by_score))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))


OP3_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 100 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""
