"""Answers to questions about whole books: nodes of a summary tree chosen, asked one by one, and put together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import answers, completions, index, thematic
from quire.operators.tables import cells, kept

#: Nodes or questions of a book in a block of the product, and partial answers that one call puts together.
BLOCK, AT_ONCE = 1024, 64
_MARKS = r"\[[0-9]{1,3}\]"


def _vectors(rows: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """rows (book_id, key, more) with buckets and weights of their hashed text; both empty for a text without tokens."""
    w = index.hashed(index.postings(rows, key, text), key).groupBy(key).agg(F.collect_list(F.struct("bucket", "w")).alias("v"))
    joined = rows.select("book_id", key, *more).join(w, key, "left")
    return joined.select("book_id", key, *more, F.coalesce(F.transform("v", lambda x: x["bucket"]), F.array().cast("array<int>")).alias("buckets"), F.coalesce(F.transform("v", lambda x: x["w"]), F.array().cast("array<double>")).alias("weights"))


def _blocks(rows: DataFrame, key: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(book_id, block, rows) of about `size` rows each, dealt by a hash of their keys, and (book_id, blocks)."""
    sizes = rows.groupBy("book_id").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "book_id").withColumn("block", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int")).drop("blocks")
    return dealt.groupBy("book_id", "block").agg(F.collect_list(F.struct(*(c for c in rows.columns if c != "book_id"))).alias("rows")), sizes


def _matrix(rows: pa.Array) -> np.ndarray:
    """The vectors of a block's rows as a matrix."""
    out = np.zeros((len(rows), index.DIM))
    lists = rows.field("buckets")
    at = np.repeat(np.arange(len(rows)), np.asarray(lists.value_lengths()))
    out[at, np.asarray(lists.flatten())] = np.asarray(rows.field("weights").flatten())
    return out


def nearest_nodes(nodes: DataFrame, questions: DataFrame, k: int = thematic.MAP_TOP_K, block: int = BLOCK) -> DataFrame:
    """(question_id, book_id, rank, node_id, level, n, score): for each question the k nodes of its book nearest to it.

    The score is the cosine of hashed vectors, 0 without a common bucket; equal scores (nine digits) go in reading order.
    Nodes without a summary take no part. A book's nodes and its questions are cut into blocks; every block of nodes
    meets every block of questions of its book as matrices and keeps k nodes for a question, so no task holds a book.
    """
    told = nodes.where("summary is not null").select("book_id", "node_id", "level", "n", "summary")
    held, sizes = _blocks(_vectors(told, "node_id", "summary", "level", "n"), "node_id", block)
    asked, _ = _blocks(_vectors(questions.select("book_id", "question_id", "question"), "question_id", "question"), "question_id", block)
    everywhere = asked.select("book_id", F.col("rows").alias("asked")).join(sizes, "book_id").select("book_id", "asked", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = held.join(everywhere, ["book_id", "block"]).select("book_id", "rows", "asked")
    types = {"book_id": "string", "question_id": "string", "node_id": "string", "level": "int", "n": "int", "score": "double"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                mine, wanted = (c[i].values for c in batch.columns[1:])
                # Columns in reading order, which a stable sort by score keeps among equals.
                order = np.lexsort((np.asarray(mine.field("node_id").to_pylist(), object).astype(str), np.asarray(mine.field("n")), np.asarray(mine.field("level"))))
                scores = np.round(_matrix(wanted) @ _matrix(mine)[order].T, 9) + 0.0  # no zeros below zero
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(wanted)), best.shape[1])
                at = pa.array(order[best.ravel()])
                columns = [pa.array([batch.column(0)[i].as_py()] * len(q), pa.string()), wanted.field("question_id").take(pa.array(q)), *(mine.field(c).take(at) for c in ("node_id", "level", "n")), pa.array(scores[q, best.ravel()])]
                yield pa.RecordBatch.from_arrays([c.cast(pa.int32()) if n in ("level", "n") else c for n, c in zip(types, columns)], list(types))

    found = pairs.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in types.items()))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "level", "n", "node_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def chapters_in_order(nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, book_id, rank, node_id, level, n): without vectors, all chapters of the question's book that have a summary."""
    told = nodes.where("level = 1 and summary is not null").select("book_id", "node_id", "level", F.col("n").alias("no"))
    numbered = thematic.numbered(told, cells(told, "no"), "no").withColumnRenamed("n", "rank").withColumnRenamed("no", "n")
    return questions.select("question_id", "book_id").join(numbered, "book_id")


#: Fixed: how a node stands in a prompt.
NODE = '<doc id="%d" node="%s" level="%d" title="%s">\n%s\n</doc>'


def _block(position: Column, node: Column | None, body: Column) -> Column:
    field = lambda c: F.col(c) if node is None else node[c]
    return F.format_string(NODE, position, field("node_id"), field("level"), field("title"), body)


def map_prompts(selected: DataFrame, nodes: DataFrame, questions: DataFrame) -> DataFrame:
    """selected (question_id, book_id, rank, node_id) with title, level, summary, and the user prompt of each: one node, one question."""
    named = selected.select("question_id", "book_id", "rank", "node_id").join(nodes.select("book_id", "node_id", "level", "title", "summary"), ["book_id", "node_id"])
    both = named.join(questions.select("question_id", "question"), "question_id")
    return both.withColumn("user", F.format_string(thematic.ASK_MAP, _block(F.lit(1), None, F.col("summary")), F.col("question")))


def reduce_prompts(partials: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, nodes, user) of partials (question_id, rank, node_id, level, title, partial), in the order of their rank.

    Numbers are ranks, so a mark in the answer names its node. Lists are as long as `partials` of a question.
    """
    row = F.struct("rank", "node_id", "level", "title", "partial")
    c = partials.groupBy("question_id").agg(F.sort_array(F.collect_list(row)).alias("c")).join(questions.select("question_id", "question"), "question_id")
    body = F.array_join(F.transform("c", lambda x: _block(x["rank"], x, x["partial"])), "\n\n")
    return c.select("question_id", F.transform("c", lambda x: x["node_id"]).alias("nodes"), F.format_string(thematic.ASK_REDUCE, body, F.col("question")).alias("user"))


def _replied(rows: DataFrame, title: str, complete: answers.Completion | None, connect: completions.Connect | None, deterministic: Column) -> DataFrame:
    """rows (user) with reply and error. Equal prompts are sent once to a client."""
    system = answers.system_prompt(title)
    if connect is not None:
        keyed = kept(rows.withColumn("key", F.sha2("user", 256)))
        said = completions.completed(keyed.select("key", F.lit(system).alias("system"), "user"), connect)
        return keyed.join(said.select("key", F.trim("reply").alias("reply"), "error"), "key").drop("key")
    said = deterministic if complete is None else F.trim(complete(F.lit(system), F.col("user")))
    return rows.withColumns({"reply": said, "error": F.lit(None).cast("string")})


def answered(
    nodes: DataFrame, questions: DataFrame, k: int | None = thematic.MAP_TOP_K, title: str = "the book",
    complete: answers.Completion | None = None, connect: completions.Connect | None = None, at_once: int = AT_ONCE,
) -> DataFrame:
    """(question_id, nodes, prompt, text, citations, refused, error) for each question (question_id, book_id, question).

    The k nearest nodes of the book, or with k None all its chapters in reading order, are asked one by one; their partial
    answers, without their marks, are put together in the order of the selection. Up to at_once go into one prompt; of
    more, runs of at_once are put together first, then those, so no row grows with a book: nodes are those of the last
    prompt. citations: the numbers in the text that name one of them. A question without nodes is refused.
    An error of a call about one node or of a later one leaves the question without text. complete (a column) or connect
    (a client, see `completions`) replies; without both, the deterministic model, which quotes the first document.
    """
    selected = kept(nearest_nodes(nodes, questions, k) if k else chapters_in_order(nodes, questions))
    asked = map_prompts(selected, nodes, questions)
    told = _replied(asked, title, complete, connect, X.says(X.ANSWER, F.col("summary")))
    # What the deterministic model quotes has no marks of its own, only the one at the end.
    partials = kept(told.select("question_id", F.col("rank"), "node_id", "level", "title", F.trim(F.regexp_replace("reply", f" ?{_MARKS}", "")).alias("partial"), "error"))
    most = selected.groupBy("question_id").agg(F.max("rank").alias("most"))
    failed = partials.where("error is not null").groupBy("question_id").agg(F.min("error").alias("error"))
    rows = partials.where("error is null").drop("error")
    quoted = lambda user: X.says(X.ANSWER, F.regexp_extract(user, r'(?s)<doc id="[^\n]*">\n(.*?)\n</doc>', 1))
    longest = most.agg(F.max("most")).first()[0] or 0
    while longest > at_once:
        part = F.floor((F.col("rank") - 1) / at_once).cast("int")
        parts = rows.withColumn("id", F.concat_ws("|", "question_id", part))
        prompts = reduce_prompts(parts.drop("question_id").withColumnRenamed("id", "question_id"), parts.select(F.col("id").alias("question_id"), F.col("question_id").alias("of")).distinct().join(questions.select(F.col("question_id").alias("of"), "question"), "of"))
        heads = parts.groupBy("id").agg(F.min(F.struct("rank", "question_id", "node_id", "level", "title")).alias("h"))
        said = _replied(prompts, title, complete, connect, quoted(F.col("user"))).select(F.col("question_id").alias("id"), "reply", "error")
        both = kept(said.join(heads, "id"))
        failed = failed.unionByName(both.where("error is not null").select("h.question_id", "error")).groupBy("question_id").agg(F.min("error").alias("error"))
        rows = both.where("error is null").select("h.question_id", (F.floor((F.col("h.rank") - 1) / at_once) + 1).cast("int").alias("rank"), "h.node_id", "h.level", "h.title", F.col("reply").alias("partial"))
        longest = -(-longest // at_once)
    prompts = reduce_prompts(rows.join(failed, "question_id", "left_anti"), questions)
    last = _replied(prompts, title, complete, connect, quoted(F.col("user"))).select("question_id", "nodes", "user", "reply", F.col("error").alias("last"))
    df = questions.select("question_id").join(last, "question_id", "left").join(failed, "question_id", "left").join(most, "question_id", "left")
    error = F.coalesce("last", "error")
    text = F.when(F.col("most").isNull(), F.lit(X.REFUSAL % title)).when(error.isNull(), F.col("reply"))
    df = df.select("question_id", F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"), F.col("user").alias("prompt"), text.alias("text"), error.alias("error"), "most")
    numbers = F.coalesce(F.filter(X.cited(F.col("text")), lambda x: (x >= 1) & (x <= F.size("nodes"))), F.array().cast("array<int>"))
    no = F.contains(X.normalise(F.substring("text", 1, answers.REFUSED_HEAD)), F.lit("couldn't find")) | F.contains("text", F.lit(X.REFUSAL % title))
    return df.withColumn("citations", numbers).withColumn("refused", F.coalesce(no & (F.size("citations") == 0), F.lit(False))).select("question_id", "nodes", "prompt", "text", "citations", "refused", "error")
