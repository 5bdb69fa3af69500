"""Answers with citations from a deterministic model, and their evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.tables import few, kept

QUOTE = 240
REFUSED_HEAD = 200


def render(position: Column, chapter: Column, section: Column, pages: Column, text: Column) -> Column:
    """A document block with its provenance; null section and pages have no attribute."""
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value.cast("string"), F.lit('"'))).otherwise("")
    return F.concat(F.lit("<doc"), attribute("id", position), attribute("chapter", chapter), attribute("section", section), attribute("pages", pages), F.lit(">\n"), text, F.lit("\n</doc>"))


def system_prompt(title: str) -> str:
    return f'Answer questions about "{title}" from the documents only, cite them as [n], and else reply: {X.REFUSAL % title}'


def user_prompt(documents: Column, question: Column) -> Column:
    return F.concat(F.lit("Documents:\n"), documents, F.lit("\n\nQuestion: "), question)


#: What stands for a language model: from the system and the user prompt, a column or a pandas UDF with its reply.
Completion = Callable[[Column, Column], Column]


def prompts(hits: DataFrame, chunks: DataFrame, questions: DataFrame) -> DataFrame:
    """(question_id, question, documents, contexts): each question's hits in the order of their rank; none: empty.

    A question has at most as many hits as retrieval keeps, so the collected lists are short.
    """
    named = few(hits.select("question_id", "chunk_id", "rank")).join(chunks.select("chunk_id", "chapter", "text", *provenance(chunks)), "chunk_id")
    block = render(F.col("rank"), F.col("chapter"), F.col("section"), F.col("pages"), F.col("text"))
    found = named.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "chapter", "text", block.alias("block")))).alias("contexts"))
    out = questions.join(found, "question_id", "left")
    return out.withColumn("documents", F.coalesce(F.array_join(F.transform("contexts", lambda c: c["block"]), "\n\n"), F.lit("")))


def provenance(chunks: DataFrame) -> list[Column]:
    """section, the innermost heading where it isn't the chapter's, and pages, of chunks that have them; else null."""
    none = F.lit(None).cast("string")
    if "heading_path" not in chunks.columns:
        return [none.alias("section"), none.alias("pages")]
    inner = F.try_element_at("heading_path", F.lit(-1))
    pages = F.when(F.col("page_start") == F.col("page_end"), F.col("page_start").cast("string")).otherwise(F.concat_ws("-", "page_start", "page_end"))
    return [F.when(inner != F.col("chapter"), inner).alias("section"), F.when(F.col("page_start").isNotNull(), pages).alias("pages")]


def quote(text: Column, most: int = QUOTE) -> Column:
    """A text in one line, cut at the last space before `most` characters and then with an ellipsis."""
    one = X.collapse(text)
    head = F.substring(one, 1, most)
    at_word = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(one) > most, F.concat(at_word, F.lit("…"))).otherwise(one)


def answer(asked: DataFrame, title: str = "the book", complete: Completion | None = None) -> DataFrame:
    """asked (see `prompts`) with text, citations, refused and retrieved chapters.

    complete: what replies to the prompts; without it, the deterministic model. A question without hits isn't asked.
    """
    first = F.get("contexts", F.lit(0))["text"]
    said = X.says(X.ANSWER, quote(first)) if complete is None else F.trim(complete(F.lit(system_prompt(title)), user_prompt(F.col("documents"), F.col("question"))))
    text = F.when(first.isNull(), F.lit(X.REFUSAL % title)).otherwise(said)
    df = asked.withColumn("text", text)
    size = F.coalesce(F.size("contexts"), F.lit(0))
    numbers = F.filter(X.cited(F.col("text")), lambda n: (n >= 1) & (n <= size))
    head = X.normalise(F.substring("text", 1, REFUSED_HEAD))
    no = F.contains(head, F.lit("couldn't find")) | F.contains(F.col("text"), F.lit(X.REFUSAL % title))
    df = df.withColumns({"citations": numbers, "refused": no & (F.size(numbers) == 0)})
    return df.withColumn("chapters", F.coalesce(F.array_distinct(F.transform("contexts", lambda c: c["chapter"])), F.array().cast("array<string>")))


def golden(questions: DataFrame, docs: DataFrame) -> DataFrame:
    """questions with answerable and expected_chapters: the documents that contain the question word by word.

    A question is a run of tokens: documents that share its rarest token are compared, not all with all. Few questions,
    and few documents that are compared, go to where the texts are.
    """
    tokens = docs.select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token"))
    asked = kept(questions.select("question_id", "question", F.explode(F.array_distinct(X.tokens(F.col("question")))).alias("token")))
    counts = tokens.join(few(asked.select("token").distinct()), "token").groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("question_id").orderBy(F.coalesce("df", F.lit(0)), "token")
    probe = asked.join(counts, "token", "left").withColumn("n", F.row_number().over(rarest)).where("n = 1").select("question_id", "question", "token")
    hit = few(tokens.join(few(probe), "token").select("doc_id", "question_id", "question")).join(docs.select("doc_id", F.col("text").alias("body")), "doc_id").where(F.contains("body", "question"))
    found = hit.groupBy("question_id").agg(F.array_sort(F.collect_set(F.concat(F.lit("doc-"), F.col("doc_id")))).alias("expected_chapters"))
    out = questions.join(found, "question_id", "left")
    return out.withColumn("answerable", F.col("expected_chapters").isNotNull()).withColumn("expected_chapters", F.coalesce("expected_chapters", F.array().cast("array<string>")))


def item_results(golden_items: DataFrame, answers: DataFrame) -> DataFrame:
    """A row per item: whether an expected chapter is within a retrieved one, and the share of snippets in the answer.

    Snippets are the items' `snippets`, a list of an editor's length, compared without regard to case and spacing; an item
    without any has no rate. A table without this column expects the question's beginning. All are matched in one pass.
    """
    given = "snippets" in golden_items.columns
    both = golden_items.select("question_id", "question", "answerable", "expected_chapters", *(["snippets"] if given else [])).join(answers.select("question_id", "text", "refused", "citations", "chapters"), "question_id")
    within = F.exists("expected_chapters", lambda e: F.exists("chapters", lambda c: F.contains(X.normalise(c), X.normalise(e))))
    has = lambda s: F.contains(X.normalise(F.col("text")), X.normalise(s))
    if given:
        wanted = F.filter("snippets", lambda s: X.normalise(s) != "")
        snippet = F.try_divide(F.size(F.filter(wanted, has)), F.size(wanted))
    else:
        snippet = has(F.substring("question", 1, 40)).cast("int")
    return both.withColumns(
        {
            "retrieval_hit": F.when(F.col("answerable") & (F.size("expected_chapters") > 0), within),
            "contains_rate": F.when(F.col("answerable"), snippet.cast("double")),
            "citation_count": F.size("citations"),
        }
    ).drop("snippets")


def summary(items: DataFrame, *by: str) -> DataFrame:
    """The metrics of item results; a metric of no items is null."""
    yes = F.col("answerable")
    mean = lambda c: F.avg(c)
    return items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("item_count"),
        F.count_if(yes).alias("answerable_count"),
        F.count_if(~yes).alias("unanswerable_count"),
        mean(F.col("retrieval_hit").cast("double")).alias("retrieval_hit_rate"),
        mean(F.when(yes, (~F.col("refused")).cast("double"))).alias("answer_rate"),
        mean((yes != F.col("refused")).cast("double")).alias("refusal_accuracy"),
        mean(F.when(~yes, F.col("refused").cast("double"))).alias("unanswerable_refusal_rate"),
        mean("contains_rate").alias("contains_rate"),
        mean(F.when(~F.col("refused"), (F.col("citation_count") > 0).cast("double"))).alias("citation_coverage"),
        mean(F.when(~F.col("refused"), F.col("citation_count").cast("double"))).alias("average_citations"),
    )


METRICS = ("retrieval_hit_rate", "answer_rate", "refusal_accuracy", "contains_rate", "citation_coverage", "average_citations")


def deltas(by_variant: DataFrame, baseline: Column) -> DataFrame:
    """Each variant's metrics less those of the one row that is the baseline."""
    base = by_variant.where(baseline).select(*(F.col(m).alias(f"base_{m}") for m in METRICS))
    out = by_variant.crossJoin(F.broadcast(base))  # one row
    return out.select("variant", *((F.col(m) - F.col(f"base_{m}")).alias(f"{m}_delta") for m in METRICS))


def variants(hits: DataFrame, reranked: DataFrame, sizes: list[int]) -> DataFrame:
    """(variant, question_id, chunk_id, rank): reranking off and on crossed with the number of hits kept.

    Hits and reranked hits are ranked once; a variant takes the first of them.
    """
    kinds = hits.select("question_id", "chunk_id", "rank", F.lit("hybrid").alias("kind"))
    kinds = kinds.unionByName(reranked.select("question_id", "chunk_id", "rank", F.lit("hybrid+rerank").alias("kind")))
    k = F.explode(F.array(*(F.lit(n) for n in sizes))).alias("k")
    return kinds.select("*", k).where("rank <= k").select(F.format_string("%s-k%d", "kind", "k").alias("variant"), "question_id", "chunk_id", "rank")


def variant_items(ranked: DataFrame, chunks: DataFrame, questions: DataFrame, gold: DataFrame, title: str = "the book", complete: Completion | None = None) -> DataFrame:
    """Item results of all variants in one pass: a question of a variant is a question of its own."""
    names = ranked.select("variant").distinct()
    own = lambda: F.concat_ws("|", "variant", "question_id")
    each = questions.crossJoin(F.broadcast(names))  # a few rows, one for each variant
    asked = each.select(own().alias("question_id"), "question")
    told = answer(prompts(ranked.select(own().alias("question_id"), "chunk_id", "rank"), chunks, asked), title, complete)
    expected = gold.crossJoin(F.broadcast(names)).withColumn("question_id", own())
    return item_results(expected, told).withColumn("variant", F.substring_index("question_id", "|", 1))


#: Characters of the reason why a variant was skipped.
MAX_REASON = 200


def attempted(runs: dict[str, Callable[[], DataFrame]]) -> tuple[list[DataFrame], dict[str, str]]:
    """The item results of variants that ran, and why the others didn't, by name.

    Each is planned and written on its own, so one that fails, in its plan or in a task, costs itself only. A variant is
    a few jobs, and there are a handful of variants.
    """
    done, skipped = [], {}
    for name, run in runs.items():
        try:
            done.append(kept(run().withColumn("variant", F.lit(name))))
        except Exception as problem:  # whatever it is belongs to the variant
            first = (str(problem).strip().splitlines() or [""])[0]
            skipped[name] = f"{type(problem).__name__}: {first}"[:MAX_REASON]
    return done, skipped


def ablation(spark: SparkSession, runs: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """(variant, position, baseline, item_count, metrics, deltas, skipped) of all variants, in the order given.

    The baseline is the first that ran; a variant that didn't has null metrics and its reason. If none ran, an error says
    why the first didn't.
    """
    done, skipped = attempted(runs)
    if not done:
        raise ValueError("no variant ran: " + "; ".join(f"{k}: {v}" for k, v in skipped.items()))
    first = next(name for name in runs if name not in skipped)
    named = spark.createDataFrame([(name, n, name == first, skipped.get(name)) for n, name in enumerate(runs)], "variant string, position int, baseline boolean, skipped string")
    results = done[0]
    for more in done[1:]:
        results = results.unionByName(more)
    made = kept(summary(results, "variant"))
    both = named.join(made.select("variant", "item_count", *METRICS), "variant", "left").join(deltas(made, F.col("variant") == first), "variant", "left")
    return both.select("variant", "position", "baseline", F.coalesce("item_count", F.lit(0)).alias("item_count"), *METRICS, *(f"{m}_delta" for m in METRICS), "skipped")


def compare(items: DataFrame, kinds: DataFrame) -> DataFrame:
    """(variant, kind, metrics, deltas) of item results per generator; kinds: (variant, kind), one of them "base".

    Deltas are against the first base generator that has results, by name; without one they are null. A generator
    without results has null metrics.
    """
    made = kinds.join(summary(items, "variant"), "variant", "left")
    base = made.where("kind = 'base' and item_count > 0").orderBy("variant").limit(1).select(*(F.col(m).alias(f"base_{m}") for m in METRICS))
    out = made.join(F.broadcast(base), F.lit(True), "left")  # one row
    return out.select("variant", "kind", F.coalesce("item_count", F.lit(0)).alias("item_count"), *METRICS, *((F.col(m) - F.col(f"base_{m}")).alias(f"{m}_delta") for m in METRICS))
