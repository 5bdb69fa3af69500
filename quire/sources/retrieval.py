"""An index for retrieval that is stored once and read by the tokens that are asked for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import index
from quire.operators.tables import kept
from quire.sources import bundles

#: Folders that postings are dealt to by token.
BUCKETS = 256
#: Texts of a block: their numbers differ in what is left of a division by it only.
TEXTS = index.TEXTS
#: What made the vectors of an index; questions must be turned into vectors by the same.
EMBEDDER = f"hash-{index.DIM}"


def _bucket(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(block, first, rows) of the runs of rows (number, ...) whose numbers follow each other within a block; first is a place in the block."""
    for batch in batches:
        number = batch.column(0).to_numpy()
        edges = np.flatnonzero((np.diff(number) != 1) | (number[1:] % TEXTS == 0)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(number)]):
            if b > a:
                yield int(number[a]) // TEXTS, int(number[a]) % TEXTS, batch.slice(a, b - a)


def _postings(tokens: DataFrame) -> DataFrame:
    """(token, block, places, times): the places in a block of texts at which a token occurs, and how often; nothing is shuffled. tokens: (number, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first, part in _runs(batches):
            _, rows, words, times, known = index.counted(part.column(1))
            order = np.argsort(words, kind="stable")
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(words, minlength=len(known))))), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x[order], pa.int32())) for x in (rows + first, times)]
            yield pa.RecordBatch.from_arrays([known, pa.array(np.full(len(known), block)), *lists], ["token", "block", "places", "times"])

    return tokens.mapInArrow(run, "token string, block long, places array<int>, times array<int>")


def _vectors(tokens: DataFrame, key_type: str) -> DataFrame:
    """Texts of a block as `index.hits_of` takes them for vectors: a bucket with its sign stands for all tokens in it. tokens: (number, tokens, chunk_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, first, part in _runs(batches):
            lengths, rows, words, times, known = index.counted(part.column(1))
            digests = index.digests_of(known)[words]
            signed = np.where(digests >> np.uint64(63) > 0, times, -times)
            cell, which = np.unique(rows * index.DIM + (digests % np.uint64(index.DIM)).astype(np.int64), return_inverse=True)
            sums = np.bincount(which, signed, len(cell)).astype(np.int64)
            cell, sums = cell[sums != 0], sums[sums != 0]
            ends = np.cumsum(np.bincount(cell // index.DIM, minlength=part.num_rows)).astype(np.int64)
            slots = (cell % index.DIM).astype(np.uint64) | (sums > 0).astype(np.uint64) << np.uint64(63)
            ids = pa.array([part.column(2).to_pylist()], pa.list_(part.column(2).type))
            held = (pa.array([x.tobytes()], pa.binary()) for x in (lengths, ends, slots, np.abs(sums)))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([first], pa.int32()), ids, *held], ["block", "first", "ids", "lengths", "ends", "digests", "times"])

    return tokens.mapInArrow(run, f"block long, first int, ids array<{key_type}>, lengths binary, ends binary, digests binary, times binary")


def write_retrieval(chunks: DataFrame, folder: str, embedder: str = EMBEDDER, buckets: int = BUCKETS) -> str:
    """Publishes postings by bucket of their token, tokens with their df, vectors, chunks and the index's figures.

    chunks: (chunk_id, text, ...), which are written first, with a number each, and read from there. Postings name a text
    by its place in a block of numbers, so what is shuffled and kept of one is a few bytes; they lie sorted by token within
    a folder, so a reader skips most of a file, too. A frequent token's postings are one bucket of many files: they are dealt
    by block as well. Readers keep the index they opened, or the last one that was published whole.
    """
    spark = chunks.sparkSession

    def beside(path: str, name: str) -> DataFrame:
        return bundles.read(spark, path.rsplit("/", 1)[0], name)

    def tokens(path: str, *more: str) -> DataFrame:
        return beside(path, "chunks").select("number", X.tokens(F.col("text")).alias("tokens"), *more)

    def written(rows: DataFrame, path: str) -> None:
        rows.write.option("compression", "zstd").parquet(path)

    def by_bucket(rows: DataFrame, path: str, *more: Column) -> None:
        rows = rows.withColumn("bucket", _bucket(F.col("token"), buckets))
        dealt = rows.repartition("bucket", *more).sortWithinPartitions("bucket", "token")
        dealt.write.partitionBy("bucket").option("compression", "zstd").parquet(path)

    def figures(path: str) -> None:
        n, mean_length = index.index_figures(beside(path, "chunks"))
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        one = beside(path, "tokens").agg(F.avg(raw).alias("mean_raw")).select(F.lit(n).alias("n"), F.lit(mean_length).cast("double").alias("mean_length"), "mean_raw", F.lit(embedder).alias("embedder"), F.lit(buckets).alias("buckets"))
        one.write.parquet(path)

    df = F.sum(F.size("places")).alias("df")
    return bundles.publish(
        spark, folder,
        {
            "chunks": lambda path: written(chunks.withColumn("number", F.monotonically_increasing_id()), path),
            "postings": lambda path: by_bucket(_postings(tokens(path)), path, F.pmod(F.xxhash64("block"), F.lit(8))),
            "tokens": lambda path: by_bucket(beside(path, "postings").groupBy("token").agg(df), path),
            "vectors": lambda path: written(_vectors(tokens(path, "chunk_id"), dict(chunks.dtypes)["chunk_id"]), path),
            "figures": figures,
        },
    )


def _blocks(vectors: DataFrame, posts: DataFrame) -> DataFrame:
    """The texts of vectors as `index.hits_of` takes them, with the tokens of posts (token, block, places, times) alone.

    A block's postings of asked tokens come together, which is bounded by the block.
    """
    digest = F.unhex(X.digest(F.col("token"), 16)).alias("digest")
    met = posts.groupBy("block").agg(F.collect_list(F.struct(digest, "places", "times")).alias("x"))
    both = vectors.select("block", "first", "ids", "lengths").join(met, "block").select("ids", "lengths", "first", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, found = len(batch.column(0)[i].values), batch.column(3)[i].values
                sizes = found.field(1).value_lengths().to_numpy()
                place, times = (found.field(j).flatten().to_numpy().astype(np.int64) for j in (1, 2))
                place = place - batch.column(2)[i].as_py()
                digests = np.repeat(np.frombuffer(b"".join(found.field(0).to_pylist()), ">u8").astype(np.uint64), sizes)
                order = np.argsort(place, kind="stable")
                order = order[(place[order] >= 0) & (place[order] < n)]
                ends = np.cumsum(np.bincount(place[order], minlength=n)).astype(np.int64)
                held = (pa.array([x.tobytes()], pa.binary()) for x in (ends, digests[order], times[order]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *held], ["ids", "lengths", "ends", "digests", "times"])

    return both.mapInArrow(run, f"ids {dict(vectors.dtypes)['ids']}, lengths binary, ends binary, digests binary, times binary")


class Retrieval:
    """The published index of a folder, opened for questions turned into vectors by `embedder`."""

    def __init__(self, spark: SparkSession, folder: str, embedder: str = EMBEDDER) -> None:
        self.spark, self.path = spark, bundles.published(spark, folder)
        self.figures = bundles.read(spark, self.path, "figures").first()
        if self.figures["embedder"] != embedder:
            raise ValueError(f"the index was made by {self.figures['embedder']}, not by {embedder}: build it again")

    def table(self, name: str) -> DataFrame:
        return bundles.read(self.spark, self.path, name)

    def of_tokens(self, name: str, asked: DataFrame) -> DataFrame:
        """The rows of postings or tokens for asked (token): only folders of asked tokens are read, at most `buckets` names."""
        wanted = [r["bucket"] for r in asked.select(_bucket(F.col("token"), self.figures["buckets"]).alias("bucket")).distinct().collect()]
        return self.table(name).where(F.col("bucket").isin(wanted)).join(asked.select("token").distinct(), "token", "left_semi")

    def _hits(self, blocks: DataFrame, weighed: DataFrame, depths: dict[str, int]) -> DataFrame:
        key_type = dict(self.table("chunks").dtypes)["chunk_id"]
        return index.hits_of(blocks, key_type, weighed, self.figures["mean_length"], depths).drop("kind")

    def bm25(self, questions: DataFrame, k: int = index.DEPTH) -> DataFrame:
        """What `index.bm25` gives over the stored chunks; df and the mean come from the index, not from its postings."""
        asked = kept(index.postings(questions, "question_id", "question").select("question_id", "token", F.col("tf").alias("times")))
        n, mean_raw = self.figures["n"], self.figures["mean_raw"]
        raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        tokens = self.of_tokens("tokens", asked).select("token", F.when(raw < 0, index.EPSILON * F.lit(mean_raw)).otherwise(raw).alias("idf"))
        return self._hits(_blocks(self.table("vectors"), self.of_tokens("postings", asked)), asked.join(tokens, "token", "left"), {"sparse": k})

    def dense(self, questions: DataFrame, k: int = index.DEPTH) -> DataFrame:
        """The best by the cosine of hashed vectors, as in `index.retrieve`; blocks of vectors stay where they are."""
        asked = index.postings(questions, "question_id", "question").select("question_id", "token", F.col("tf").alias("times"), F.lit(None).cast("double").alias("idf"))
        return self._hits(self.table("vectors").select("ids", "lengths", "ends", "digests", "times"), asked, {"dense": k})

    def retrieve(self, questions: DataFrame, depth: int = index.DEPTH, k: int = index.FINAL) -> DataFrame:
        """Hybrid retrieval as `index.retrieve`, from the stored index."""
        return index.fuse(self.dense(questions, depth), self.bm25(questions, depth), k)
