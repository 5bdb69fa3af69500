"""Lexical and dense retrieval as tables: BM25 postings, hashed vectors, reciprocal-rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.tables import few, kept

K1, B, EPSILON = 1.5, 0.75, 0.25
DIM, DEPTH, FINAL, RRF_K, POOL = 512, 20, 8, 60, 40


def postings(texts: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, token, tf, length): tokens are counted within their row, so nothing but distinct ones is shuffled."""
    tokens = texts.select(key, X.tokens(F.col(text)).alias("tokens"))
    return tokens.select(key, F.size("tokens").alias("length"), F.explode("tokens").alias("token")).groupBy(key, "length", "token").agg(F.count(F.lit(1)).alias("tf"))


def frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, df) of texts: tokens are counted where they stand before they are shuffled."""
    return texts.select(F.explode(F.array_distinct(X.tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))


def idf(posts: DataFrame, n: int | Column) -> DataFrame:
    """(token, df, idf) of postings, see `idf_of`."""
    return idf_of(posts.groupBy("token").agg(F.count(F.lit(1)).alias("df")), n)


def idf_of(df: DataFrame, n: int | Column) -> DataFrame:
    """(token, df, idf): a token in more than half of the texts gets EPSILON times the mean over all tokens."""
    total = n if isinstance(n, Column) else F.lit(n)
    df = df.withColumn("raw", F.log(total - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = df.agg(F.avg("raw").alias("mean"))
    df = df.crossJoin(F.broadcast(mean))  # one row
    return df.select("token", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def idf_of_asked(texts: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """(token, idf) of the tokens of texts that asked (token) has, see `idf_of`; all tokens are counted, and once.

    What isn't asked for is one row with its number and sum, which the mean needs.
    """
    each = frequencies(texts).withColumn("raw", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    wanted = few(asked.select("token").distinct().withColumn("asked", F.lit(True)))
    sums = kept(each.join(wanted, "token", "left").groupBy(F.when(F.col("asked"), F.col("token")).alias("token")).agg(F.sum("raw").alias("raw"), F.count(F.lit(1)).alias("n")))
    mean = F.lit(sums.agg(F.sum("raw") / F.sum("n")).first()[0]).cast("double")
    return sums.where("token is not null").select("token", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each question: scores equal to nine digits go by chunk."""
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(texts: DataFrame, questions: DataFrame, k: int = DEPTH) -> DataFrame:
    """(question_id, chunk_id, score, rank) by BM25 of texts (chunk_id, text) with positive scores; a repeated query token counts again.

    The mean idf takes all tokens' df, so all tokens are counted, once; `sources.retrieval` keeps both in the index.
    """
    return _hits(texts, questions, {"sparse": k}).drop("kind")


def hashed(posts: DataFrame, key: str = "chunk_id", dim: int = DIM) -> DataFrame:
    """(key, bucket, w): the unit vectors of signed token counts; a bucket that cancels out has no row.

    Postings are dealt by key once, for the sums, the norms and whatever groups the vectors' rows again.
    """
    b = posts.select(key, "tf", X.bucket(F.col("token"), dim).alias("bucket"), X.sign(F.col("token")).alias("sign")).repartition(key)
    b = b.groupBy(key, "bucket").agg(F.sum(F.col("sign") * F.col("tf")).alias("v")).where("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(key)))
    return b.select(key, "bucket", (F.col("v") / norm).alias("w"))


#: Rows of a block of vectors.
BLOCK = 2048


def _met(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """Each block of vectors, dealt by a hash of its ids, beside each block of queries, which goes to every part."""
    parts = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.withColumn("part", F.pmod(F.hash("ids"), F.lit(parts)))
    everywhere = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return dealt.join(everywhere, "part").drop("part")


def _sparse_blocks(vectors: DataFrame, key: str, weight: str, names: str) -> DataFrame:
    """Rows of up to BLOCK vectors (key, bucket, weight): their keys, where each ends, and all buckets and weights as bytes."""
    kind = dict(vectors.dtypes)[key]
    one = vectors.groupBy(key).agg(F.collect_list(F.struct(F.col("bucket").cast("int").alias("b"), F.col(weight).alias("w"))).alias("x"))
    ids, ends, buckets, weights = names.split()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                lists = part.column(1)
                sizes, flat = np.asarray(lists.value_lengths()), lists.flatten()
                data = (np.cumsum(sizes).astype(np.int64), *(np.asarray(flat.field(i)) for i in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *(pa.array([x.tobytes()], pa.binary()) for x in data)], names.split())

    return one.mapInArrow(run, f"{ids} array<{kind}>, {ends} binary, {buckets} binary, {weights} binary")


def _matrix(ends: bytes, buckets: bytes, weights: bytes, dim: int) -> np.ndarray:
    """The vectors of a block as the rows of a matrix."""
    ends = np.frombuffer(ends, np.int64)
    out = np.zeros((len(ends), dim))
    out[np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)), np.frombuffer(buckets, np.int32)] = np.frombuffer(weights)
    return out


def dense(vectors: DataFrame, questions: DataFrame, k: int = DEPTH, dim: int = DIM) -> DataFrame:
    """(question_id, chunk_id, score, rank) by the cosine of hashed vectors; a chunk without a bucket of the question has no score.

    Blocks of chunks meet blocks of questions as matrices and give a question k rows each, so what is shuffled is the
    vectors, once, and not their products by bucket.
    """
    asked = hashed(postings(questions, "question_id", "question"), "question_id", dim)
    pairs = _met(_sparse_blocks(vectors, "chunk_id", "w", "ids ends buckets weights"), _sparse_blocks(asked, "question_id", "w", "queries q_ends q_buckets q_weights"))
    types = {"question_id": dict(asked.dtypes)["question_id"], "chunk_id": dict(vectors.dtypes)["chunk_id"], "score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, *held, queries, q_ends, q_buckets, q_weights = (c[row] for c in batch.columns)
                chunks, wanted = (_matrix(*(x.as_py() for x in m), dim) for m in (held, (q_ends, q_buckets, q_weights)))
                scores, names = np.round(wanted @ chunks.T, 9), np.array(ids.as_py(), object)
                which, best = [], []
                for i, mine in enumerate(scores):
                    least = np.partition(mine, -k)[-k] if k < len(mine) else mine.min()
                    if least <= 0:  # a zero may be that of a chunk with nothing in common
                        apart = ~(chunks[:, wanted[i] != 0] != 0).any(axis=1)
                        mine = np.where(apart, -np.inf, mine)
                        least = np.partition(mine, -k)[-k] if k < len(mine) else mine.min()
                    found = np.flatnonzero((mine >= least) & (mine > -np.inf))
                    found = sorted(found.tolist(), key=lambda j: (-mine[j], names[j]))[:k]
                    which += [i] * len(found)
                    best += found
                columns = (queries.values.take(pa.array(which, pa.int64())), ids.values.take(pa.array(best, pa.int64())), pa.array(scores[which, best]))
                yield pa.RecordBatch.from_arrays(list(columns), list(types))

    return _best(pairs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items())), k)


#: Texts and questions of a block of tokens. A block of questions has some thousand tokens, which a matrix has as columns.
TEXTS, QUESTIONS = 1024, 256


def counted(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(lengths, rows, words, times, dictionary): the length of each list of tokens and how often each has each word of the dictionary, by rows."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    n = max(len(words.dictionary), 1)
    found, times = np.unique(np.repeat(np.arange(len(lists)), lengths) * n + words.indices.to_numpy(zero_copy_only=False), return_counts=True)
    return lengths, found // n, found % n, times.astype(np.int64), words.dictionary


def digests_of(words: pa.Array) -> np.ndarray:
    """The first 64 bits of each word's SHA-256, which give its bucket and its sign."""
    return np.array([int.from_bytes(sha256(w.encode()).digest()[:8]) for w in words.to_pylist()], np.uint64)


def _token_blocks(texts: DataFrame, key: str, text: str, size: int, names: str) -> DataFrame:
    """Rows of up to `size` texts: their keys, lengths, where each ends, and the digests and counts of their distinct tokens.

    Keys are distinct. Texts stay where they are: nothing is shuffled.
    """
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lengths, rows, words, times, known = counted(part.column(1))
                ends = np.cumsum(np.bincount(rows, minlength=part.num_rows)).astype(np.int64)
                held = (lengths, ends, digests_of(known)[words], times)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *(pa.array([x.tobytes()], pa.binary()) for x in held)], names.split())

    first, *others = names.split()
    return texts.select(key, X.tokens(F.col(text)).alias("tokens")).mapInArrow(run, f"{first} array<{kind}>, " + ", ".join(f"{c} binary" for c in others))


def _first(scores: np.ndarray, names: np.ndarray, k: int) -> list[int]:
    """The places of the k best scores above minus infinity, equal ones by name."""
    least = np.partition(scores, -k)[-k] if k < len(scores) else -np.inf
    found = np.flatnonzero((scores >= least) & (scores > -np.inf)).tolist()
    return sorted(found, key=lambda j: (-scores[j], names[j]))[:k]


def _hits(texts: DataFrame, questions: DataFrame, depths: dict[str, int], dim: int = DIM) -> DataFrame:
    """(kind, question_id, chunk_id, score, rank): the best texts (chunk_id, text) of each question by each kind asked for.

    depths: how many of each kind, "dense" as in `dense`, "sparse" as in `bm25`. Texts become blocks of tokens where they
    are and meet all blocks of questions; what is shuffled is a question's best of each block.
    """
    n, mean_length = index_figures(texts)
    times = postings(questions, "question_id", "question").select("question_id", "token", F.col("tf").alias("times"))
    weighed = times.join(idf_of_asked(texts, times, n), "token", "left") if "sparse" in depths else times.withColumn("idf", F.lit(None).cast("double"))
    blocks = _token_blocks(texts, "chunk_id", "text", TEXTS, "ids lengths ends digests times")
    return hits_of(blocks, dict(texts.dtypes)["chunk_id"], weighed, mean_length, depths, dim)


def hits_of(blocks: DataFrame, key_type: str, weighed: DataFrame, mean_length: float, depths: dict[str, int], dim: int = DIM) -> DataFrame:
    """What `_hits` gives, from blocks (ids, lengths, ends, digests, times; see `_token_blocks`) and the questions' tokens (question_id, token, times, idf)."""
    digest = F.unhex(X.digest(F.col("token"), 16))
    listed = weighed.groupBy("question_id").agg(F.collect_list(F.struct(digest.alias("d"), F.col("times"), F.coalesce("idf", F.lit(0.0)).alias("idf"))).alias("x"))
    kind = dict(weighed.dtypes)["question_id"]

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUESTIONS):
                part = batch.slice(at, QUESTIONS)
                lists = part.column(1)
                ends, flat = np.cumsum(np.asarray(lists.value_lengths())).astype(np.int64), lists.flatten()
                digests = np.frombuffer(b"".join(flat.field(0).to_pylist()), ">u8").astype(np.uint64)
                held = (ends, digests, np.asarray(flat.field(1)), np.asarray(flat.field(2)))
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(part.column(0).type)), *(pa.array([x.tobytes()], pa.binary()) for x in held)], ["queries", "q_ends", "q_digests", "q_times", "q_idf"])

    wanted = kept(listed.repartition(1).mapInArrow(asked, f"queries array<{kind}>, q_ends binary, q_digests binary, q_times binary, q_idf binary"))
    pairs = blocks.crossJoin(wanted)
    types = {"kind": "string", "question_id": kind, "chunk_id": key_type, "score": "double"}

    def unit(rows: np.ndarray, digests: np.ndarray, times: np.ndarray, n: int) -> np.ndarray:
        """Signed counts by bucket as unit vectors."""
        signed = np.where(digests >> np.uint64(63) > 0, times, -times)
        out = np.bincount(rows * dim + (digests % np.uint64(dim)).astype(np.int64), signed, n * dim).reshape(n, dim)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, ends, digests, times, queries, q_ends, q_digests, q_times, q_idf = (c[row] for c in batch.columns)
                lengths, ends, times, q_ends, q_times = (np.frombuffer(x.as_py(), np.int64) for x in (lengths, ends, times, q_ends, q_times))
                digests, q_digests, q_idf = np.frombuffer(digests.as_py(), np.uint64), np.frombuffer(q_digests.as_py(), np.uint64), np.frombuffer(q_idf.as_py())
                at, q_at = (np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (ends, q_ends))
                names = np.array(ids.as_py(), object)
                for name, k in depths.items():
                    if name == "dense":
                        left, right = unit(q_at, q_digests, q_times, len(q_ends)), unit(at, digests, times, len(ends))
                        scores = left @ right.T
                        scores[((left != 0).astype(np.float32) @ (right != 0).astype(np.float32).T) == 0] = -np.inf  # nothing in common
                    else:
                        terms, place = np.unique(q_digests, return_inverse=True)
                        left, right = np.zeros((len(q_ends), len(terms))), np.zeros((len(ends), len(terms)))
                        left[q_at, place] = q_times * q_idf
                        found = np.searchsorted(terms, digests)
                        known = np.flatnonzero(terms[np.minimum(found, len(terms) - 1)] == digests) if len(terms) else np.empty(0, np.int64)
                        tf, length = times[known], lengths[at[known]]
                        right[at[known], found[known]] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean_length))
                        scores = left @ right.T
                        scores[scores <= 0] = -np.inf
                    best = [_first(mine, names, k) for mine in np.round(scores, 9)]
                    which, chosen = np.repeat(np.arange(len(best)), [len(x) for x in best]), np.array([j for x in best for j in x], np.int64)
                    columns = (pa.array([name] * len(which), pa.string()), queries.values.take(pa.array(which)), ids.values.take(pa.array(chosen)), pa.array(scores[which, chosen]))
                    yield pa.RecordBatch.from_arrays(list(columns), list(types))

    found = pairs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))
    order = Window.partitionBy("kind", "question_id").orderBy(F.desc(F.round("score", 9)), "chunk_id")
    depth = F.coalesce(*(F.when(F.col("kind") == name, k) for name, k in depths.items()))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= depth)


def fuse(dense_hits: DataFrame, sparse_hits: DataFrame, k: int = FINAL, rrf_k: int = RRF_K) -> DataFrame:
    """(question_id, chunk_id, score, rank): reciprocal ranks summed; ties by dense, then by sparse rank."""
    both = dense_hits.select("question_id", "chunk_id", F.col("rank").alias("d"), F.lit(None).cast("int").alias("s"))
    both = both.unionByName(sparse_hits.select("question_id", "chunk_id", F.lit(None).cast("int").alias("d"), F.col("rank").alias("s")))
    one = both.groupBy("question_id", "chunk_id").agg(F.max("d").alias("d"), F.max("s").alias("s"))
    reciprocal = lambda c: F.coalesce(1 / (rrf_k + F.col(c)), F.lit(0.0))
    one = one.withColumn("score", reciprocal("d") + reciprocal("s"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 12)), F.asc_nulls_last("d"), "s")
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "chunk_id", "score", "rank")


def retrieve(chunks: DataFrame, questions: DataFrame, depth: int = DEPTH, k: int = FINAL) -> DataFrame:
    """Hybrid retrieval of every question over all chunks, which are best a table that is built (see `kept`).

    Both kinds of hits are found in one pass over the chunks; two figures of the index come to the driver.
    """
    hits = kept(_hits(chunks, questions, {"dense": depth, "sparse": depth}))
    of = lambda kind: hits.where(F.col("kind") == kind).drop("kind")
    return fuse(of("dense"), of("sparse"), k)


def index_figures(chunks: DataFrame) -> tuple[int, float]:
    """The number of chunks and their mean length in tokens."""
    n, mean = chunks.agg(F.count(F.lit(1)), F.avg(F.size(X.tokens(F.col("text"))))).first()
    return n, mean or 1.0


def truncated(vector: Column, dim: int) -> Column:
    """The first dim components of a vector, as a unit vector again; a shorter vector stays as it is."""
    head = F.slice(vector, 1, dim)
    norm = F.sqrt(F.aggregate(head, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(F.size(vector) <= dim, F.transform(vector, lambda x: x.cast("double"))).otherwise(F.transform(head, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double"))))


def nearest(vectors: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, rank): for each of asked (query_id, q) the k vectors (vec_id, v) of the largest cosine.

    Blocks of vectors meet blocks of queries as matrices; each pair of blocks gives k rows for a query. Vectors of zeros
    have the cosine 0. A shorter vector counts as filled up with zeros; vectors that are null, empty, or hold null or
    non-finite components take no part, as rows without an id.
    """
    whole = lambda v: ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    vectors, asked = (df.where(F.col(i).isNotNull() & (F.size(v) > 0) & whole(F.col(v))) for df, i, v in ((vectors, "vec_id", "v"), (asked, "query_id", "q")))

    def blocks(rows: DataFrame, names: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    sizes = np.asarray(part.column(1).value_lengths())
                    matrix = np.zeros((part.num_rows, sizes.max(initial=0)))
                    row = np.repeat(np.arange(part.num_rows), sizes)
                    matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = part.column(1).flatten().to_numpy(zero_copy_only=False)
                    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
                    unit = matrix / np.where(norm > 0, norm, 1.0)
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (part.column(0).to_numpy(), unit)], names.split())

        return rows.mapInArrow(run, ", ".join(f"{n} binary" for n in names.split()))

    pairs = _met(blocks(vectors.select("vec_id", "v"), "ids matrix"), blocks(asked.select("query_id", "q"), "queries wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, matrix, queries, wanted = (c[row].as_py() for c in batch.columns)
                ids, queries = np.frombuffer(ids, np.int64), np.frombuffer(queries, np.int64)
                left, right = np.frombuffer(wanted).reshape(len(queries), -1), np.frombuffer(matrix).reshape(len(ids), -1)
                both = min(left.shape[1], right.shape[1])  # what one block lacks is zeros
                scores = np.round(left[:, :both] @ right[:, :both].T, 9) + 0.0
                best = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :k]
                q = np.repeat(np.arange(len(queries)), best.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (queries[q], ids[best.ravel()], scores[q, best.ravel()])], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def overlap(question: Column, text: Column) -> Column:
    """The share of a question's distinct tokens that a text has; 0 for a question without any."""
    asked = F.array_distinct(X.tokens(question))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(asked, X.tokens(text))), F.size(asked)), F.lit(0.0))


def rerank(pool: DataFrame, chunks: DataFrame, questions: DataFrame, k: int = FINAL, score: Callable[[Column, Column], Column] = overlap) -> DataFrame:
    """(question_id, chunk_id, score, rank): the k best of a wider pool of hits by a score of question and text.

    score: a column expression or pandas UDF. Equal scores keep the order of the pool. Only the pool's chunks are read.
    """
    both = few(pool.select("question_id", "chunk_id", F.col("rank").alias("was"))).join(chunks.select("chunk_id", "text"), "chunk_id").join(questions, "question_id")
    scored = both.withColumn("score", score(F.col("question"), F.col("text")).cast("double"))
    order = Window.partitionBy("question_id").orderBy(F.desc(F.round("score", 9)), "was")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("question_id", "chunk_id", "score", "rank")


def metadata(chunks: DataFrame) -> DataFrame:
    """A row per book; context_count is the number of chunks that enrichment gave a context."""
    contexts = F.count(F.col("context") if "context" in chunks.columns else F.lit(None))
    return chunks.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("chunk_count"), F.avg("char_count").alias("average_chunk_chars"), F.countDistinct("doc_id").alias("chapter_count"), contexts.alias("context_count")
    )


def index_text(context: Column, text: Column) -> Column:
    """What is indexed of a chunk: its context, if it has one, before its text."""
    return F.when(context.isNotNull(), F.concat(context, F.lit("\n\n"), text)).otherwise(text)
