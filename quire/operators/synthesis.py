"""Question-answer pairs, their filter, distractor-augmented examples, chat examples, splits and validation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import text as X
from quire.operators.answers import Completion, provenance, render, system_prompt, user_prompt
from quire.operators.thematic import numbered

SEED, MAX_CHUNKS, PER_CHUNK, DISTRACTORS, NEGATIVE_RATIO = 13, 100, 2, 4, 0.15
VAL_RATIO = 0.1
REASONS = ("no_verified_quotes", "too_short", "duplicate_question", "question_echoes_answer")
MIN_QUOTE, MIN_QUESTION, MIN_ANSWER, ECHO = 15, 12, 20, 0.7


def drawn(*keys: Column, seed: int = SEED) -> Column:
    """A pseudo-random order of rows that is the same everywhere: the hash of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *keys))


def sample_chunks(chunks: DataFrame, n: int = MAX_CHUNKS, seed: int = SEED) -> DataFrame:
    """n chunks of each book, all if it has fewer."""
    order = Window.partitionBy("book_id").orderBy(drawn(F.col("chunk_id"), seed=seed), "chunk_id")
    return chunks.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


#: The request for pairs; the reply is a JSON array.
ASK_PAIRS = "Write %d question-answer pairs about the passage as a JSON array of objects with question, answer and quotes, a list of its own words.\n\nPassage:\n%s"


def replies(chunks: DataFrame, count: int = PER_CHUNK, complete: Completion | None = None) -> DataFrame:
    """chunks with reply, what `complete` answers to a request for pairs: a JSON array; without it, the deterministic model's."""
    if complete is not None:
        return chunks.withColumn("reply", complete(F.lit("You write training questions."), F.format_string(ASK_PAIRS, F.lit(count), F.col("text"))))
    one = X.collapse(F.col("text"))
    made = [
        F.struct(X.says(X.QUESTIONS[i % len(X.QUESTIONS)], F.substring(one, 1, 30)).alias("question"), X.says(X.QA_ANSWER, F.substring(one, 1, 60)).alias("answer"), F.array(F.substring(one, 1, 60)).alias("quotes"))
        for i in range(count)
    ]
    return chunks.withColumn("reply", F.to_json(F.array(*made)))


def rescued(reply: Column) -> Column:
    """The JSON array in a reply as a variant: the whole, or what lies between the first and the last bracket."""
    whole = F.try_parse_json(reply)
    part = F.try_parse_json(F.regexp_extract(reply, r"(?s)\[.*\]", 0))
    found = F.when(whole.isNull(), part).otherwise(whole)
    return F.when(F.schema_of_variant(found).startswith("ARRAY"), found)


def pairs(chunks_with_reply: DataFrame) -> DataFrame:
    """(pair_id, book_id, chunk_id, chapter, question, answer, quotes, pos): the valid items of each reply, trimmed."""
    items = F.expr("try_variant_get(items, '$', 'array<variant>')")
    df = chunks_with_reply.withColumn("items", rescued(F.col("reply"))).select("book_id", "chunk_id", "chapter", F.posexplode(items).alias("pos", "item"))
    is_text = lambda path: F.coalesce(F.expr(f"schema_of_variant(try_variant_get(item, '{path}', 'variant'))") == "STRING", F.lit(False))
    text = lambda path: F.when(is_text(path), F.trim(F.expr(f"try_variant_get(item, '{path}', 'string')")))
    quotes = F.expr("filter(transform(try_variant_get(item, '$.quotes', 'array<variant>'), q -> if(schema_of_variant(q) = 'STRING', trim(try_variant_get(q, '$', 'string')), '')), q -> q <> '')")
    df = df.withColumns({"question": text("$.question"), "answer": text("$.answer"), "quotes": F.coalesce(quotes, F.array().cast("array<string>"))})
    df = df.where("question <> '' and answer <> ''").drop("item")
    return df.withColumn("pair_id", F.concat("chunk_id", F.lit(":"), X.digest(F.col("question"), 12)))


@F.pandas_udf(T.BooleanType())
def echoes(question: pd.Series, answer: pd.Series) -> pd.Series:
    """Whether a question repeats its answer. Only pairs whose lengths allow the ratio are compared."""
    out = []
    for q, a in zip(question, answer):
        q, a = " ".join(q.lower().split()), " ".join(a.lower().split())
        near = 2 * min(len(q), len(a)) >= ECHO * (len(q) + len(a)) and len(q) > 0
        out.append(bool(near and difflib.SequenceMatcher(None, q, a).ratio() >= ECHO))
    return pd.Series(out)


def judged(found: DataFrame, chunks: DataFrame, with_echo: bool = True) -> DataFrame:
    """pairs with reason, null for those kept: no verified quote, too short, duplicate question, echo, in this order.

    A question is a duplicate only of an earlier one that was kept, so it is compared with the first eligible pair of
    its normalised text in the order of chunks and positions.
    """
    source = chunks.select("chunk_id", F.col("text").alias("source"), "ordinal")
    df = found.join(source, "chunk_id", "left")
    inside = lambda q: (F.length(q) >= MIN_QUOTE) & F.contains(X.normalise(F.col("source")), X.normalise(q))
    df = df.withColumn("verified", F.coalesce(F.filter("quotes", inside), F.array().cast("array<string>")))
    short = (F.length("question") < MIN_QUESTION) | (F.length("answer") < MIN_ANSWER)
    df = df.withColumn("echo", echoes("question", "answer") if with_echo else F.lit(False))
    eligible = (F.size("verified") > 0) & ~short & ~F.col("echo")
    place = F.struct("book_id", "ordinal", "pos", "pair_id")
    asked = Window.partitionBy("book_id", X.normalise(F.col("question")))
    df = df.withColumns({"place": place, "first": F.min(F.when(eligible, place)).over(asked)})
    reason = (
        F.when(F.size("verified") == 0, "no_verified_quotes")
        .when(short, "too_short")
        .when(F.col("place") > F.col("first"), "duplicate_question")
        .when(F.col("echo"), "question_echoes_answer")
    )
    return df.withColumn("reason", reason).drop("place", "first", "source", "echo")


def raft(kept: DataFrame, chunks: DataFrame, title: str = "the book", k: int = DISTRACTORS, ratio: float = NEGATIVE_RATIO, seed: int = SEED) -> DataFrame:
    """(example_id, book_id, question, answerable, answer, contexts): the golden chunk among k others, or only others.

    Distractors come from the chunks that follow a pair's hash in its book's hash order: each pair starts at a place of
    its own in a ring of the book's chunks and takes the next k that aren't its golden one, so pairs meet k + 1
    chunks each and never the whole book.
    """
    drawn_ids = chunks.select("book_id", "chunk_id", drawn(F.col("chunk_id"), seed=seed).alias("o"))
    ringed = numbered(drawn_ids, F.substring("o", 1, 3), "o", "chunk_id").select("book_id", "chunk_id", (F.col("n") - 1).alias("place"))
    sizes = ringed.groupBy("book_id").agg(F.count(F.lit(1)).alias("n"))
    begin = F.pmod(F.conv(F.substring(drawn(F.col("pair_id"), seed=seed), 1, 8), 16, 10).cast("long"), F.col("n"))
    step = F.explode(F.sequence(F.lit(0), F.least(F.col("n") - 1, F.lit(k).cast("long")))).alias("step")
    near = kept.join(sizes, "book_id").select("pair_id", "book_id", F.col("chunk_id").alias("golden"), "n", begin.alias("begin"), step)
    near = near.withColumn("place", F.pmod(F.col("begin") + F.col("step"), F.col("n"))).join(ringed, ["book_id", "place"])
    near = near.where("chunk_id <> golden")
    first = Window.partitionBy("pair_id").orderBy("step")
    picked = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k).join(chunks.select("chunk_id", "text"), "chunk_id").select("pair_id", "chunk_id", "text", F.lit(False).alias("is_golden"))
    coin = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit("coin"), F.lit(str(seed)), F.col("pair_id"))), 1, 8), 16, 10).cast("double") / 2.0**32
    positive = kept.withColumn("answerable", coin >= ratio)
    golden = positive.where("answerable").join(chunks.select("chunk_id", "text"), "chunk_id").select("pair_id", "chunk_id", "text", F.lit(True).alias("is_golden"))
    context = F.struct(drawn(F.col("pair_id"), F.col("chunk_id"), seed=seed).alias("o"), "chunk_id", "text", "is_golden")
    sets = picked.unionByName(golden).groupBy("pair_id").agg(F.sort_array(F.collect_list(context)).alias("c"))
    df = positive.join(sets, "pair_id", "left").withColumn("contexts", F.coalesce(F.transform("c", lambda x: x.dropFields("o")), F.array().cast("array<struct<chunk_id:string,text:string,is_golden:boolean>>")))
    at = F.array_position(F.transform("contexts", lambda x: x["is_golden"]), True).cast("int")
    says = F.format_string(X.GROUNDED, F.coalesce(F.get("verified", F.lit(0)), F.lit("")), at, F.col("answer"))
    target = F.when(F.col("answerable"), says).otherwise(F.lit(X.REFUSAL % title))
    return df.select(F.concat("pair_id", F.lit(":raft")).alias("example_id"), "book_id", "question", "answerable", target.alias("answer"), "contexts")


def chat(examples: DataFrame, chunks: DataFrame, title: str = "the book") -> DataFrame:
    """(example_id, book_id, question, answerable, messages): each example as system, user and assistant messages.

    A context whose chunk doesn't exist ends the job with an error: without it the numbers cited would be others'.
    """
    one = examples.select("example_id", F.posexplode("contexts").alias("n", "c")).select("example_id", "n", "c.chunk_id")
    known = chunks.select("chunk_id", "chapter", "text", F.lit(True).alias("known"), *provenance(chunks))
    named = one.join(known, "chunk_id", "left")
    lost = F.raise_error(F.concat(F.lit("no chunk "), F.col("chunk_id"), F.lit(" for a training context: build the examples anew")))
    block = F.when(F.col("known"), render(F.col("n") + 1, F.col("chapter"), F.col("section"), F.col("pages"), F.col("text"))).otherwise(lost.cast("string"))
    documents = named.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct("n", block.alias("b")))).alias("d"))
    df = examples.join(documents, "example_id", "left")
    shown = F.coalesce(F.array_join(F.transform("d", lambda x: x["b"]), "\n\n"), F.lit(""))
    system = F.lit(system_prompt(title))
    user = user_prompt(shown, F.col("question"))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    messages = F.array(message("system", system), message("user", user), message("assistant", F.col("answer")))
    return df.select("example_id", "book_id", "question", "answerable", messages.alias("messages"))


def missing_contexts(examples: DataFrame, chunks: DataFrame) -> DataFrame:
    return examples.select("example_id", F.explode("contexts.chunk_id").alias("chunk_id")).join(chunks, "chunk_id", "left_anti")


def split(rows: DataFrame, key: str, *by: str, ratio: float = VAL_RATIO, seed: int = SEED) -> DataFrame:
    """rows with split: of each group at least one row, and else ratio of them, go to validation, drawn by hash."""
    order = Window.partitionBy(*by).orderBy(drawn(F.col(key).cast("string"), seed=seed), key)
    size = F.count(F.lit(1)).over(Window.partitionBy(*by))
    n = F.least(F.greatest(F.lit(1), F.floor(size * ratio)), size)
    return rows.withColumn("split", F.when(F.row_number().over(order) <= n, "validation").otherwise("train"))


def errors(examples: DataFrame, title: str = "the book") -> DataFrame:
    """(example_id, error) for each fault of chat examples."""
    contents = F.transform("messages", lambda m: m["content"])
    target = F.element_at(contents, -1)
    n_docs = F.size(F.split(F.get(contents, F.lit(1)), "<doc ")) - 1
    numbers = X.cited(target)
    faults = F.array_compact(
        F.array(
            F.when(F.size("messages") == 0, "no messages"),
            F.when(F.exists(contents, lambda c: F.trim(c) == ""), "blank content"),
            F.when(n_docs == 0, "no documents"),
            F.when(F.col("answerable") & ((F.size(numbers) == 0) | F.exists(numbers, lambda x: (x < 1) | (x > n_docs))), "bad citations"),
            F.when(~F.col("answerable") & (target != F.lit(X.REFUSAL % title)), "not the refusal"),
        )
    )
    return examples.select("example_id", F.explode(faults).alias("error"))


def prompt_hash(title: str = "the book") -> Column:
    """A digest of the system prompt and the empty user prompt: what training and answering must share."""
    return X.digest(F.concat(F.lit(system_prompt(title)), F.lit("\n\n"), user_prompt(F.lit(""), F.lit(""))), 40)


def set_hash(by: str, key: str, *parts: Column) -> tuple[Column, ...]:
    """Aggregates of a group of rows: their number and an order-free digest of them.

    Rows' 64-bit hashes are summed without loss, so the digest combines before the shuffle and no task holds a group.
    """
    row = F.conv(F.substring(F.md5(F.concat_ws("\u001f", F.col(key), *parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return F.count(F.lit(1)).alias(f"{by}_count"), X.digest(F.concat_ws(":", F.count(F.lit(1)), F.sum(row)), 40).alias(f"{by}_hash")


def synthesis_manifest(chunks: DataFrame, sampled: DataFrame, found: DataFrame, examples: DataFrame) -> DataFrame:
    """(book_id, counts): what a synthesis run saw and made, by book. found: the pairs with their reasons (see `judged`)."""
    n = F.count(F.lit(1))
    made = chunks.groupBy("book_id").agg(n.alias("chunk_count")).join(sampled.groupBy("book_id").agg(n.alias("sampled_chunks")), "book_id", "left")
    rejected = [F.count_if(F.col("reason") == r).alias(r) for r in REASONS]
    made = made.join(found.groupBy("book_id").agg(n.alias("generated_pairs"), F.count_if(F.col("reason").isNull()).alias("kept_pairs"), *rejected), "book_id", "left")
    yes = F.count_if(F.col("answerable"))
    made = made.join(examples.groupBy("book_id").agg(n.alias("example_count"), yes.alias("answerable_examples"), (n - yes).alias("unanswerable_examples")), "book_id", "left")
    return made.na.fill(0)


def training_manifest(split_rows: DataFrame, title: str = "the book") -> DataFrame:
    """(book_id, counts, dataset_hash, prompt_hash) of chat examples with their split."""
    yes, n = F.count_if(F.col("answerable")), F.count(F.lit(1))
    count, digest = set_hash("dataset", "example_id", F.col("split"), F.array_join(F.transform("messages", lambda m: m["content"]), "\u001f"))
    made = split_rows.groupBy("book_id").agg(
        n.alias("source_count"), F.count_if(F.col("split") == "train").alias("train_count"), F.count_if(F.col("split") == "validation").alias("validation_count"),
        yes.alias("answerable_count"), (n - yes).alias("unanswerable_count"), digest,
    )
    return made.withColumn("prompt_hash", prompt_hash(title))
