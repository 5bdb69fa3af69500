"""Summary trees over books and whole-book answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.completions import Connect, asked_once
from quire.operators.tables import cells, few, kept, stored

#: See `answers.Completion`.
Completion = Callable[[Column, Column], Column]

WINDOW, MAP_TOP_K, MAX_SOURCE, MAX_SUMMARY, MIN_SUMMARY = 4, 6, 6000, 1200, 10
#: Fixed: a completion with one of these isn't a summary.
UNUSABLE = ("i'm sorry", "as an ai", "cannot summarize", "couldn't find")


#: What is asked of a model for a summary, a partial answer and a final one.
ASK_SUMMARY = "Summarise this part of the book in at most %d characters.\n\n<source>\n%s\n</source>"
ASK_MAP = "Answer from the summary only, citing it as [1].\n\n%s\n\nQuestion: %s"
ASK_REDUCE = "Put the partial answers together into one, citing them as [n].\n\n%s\n\nQuestion: %s"
PROMPT_VERSION, MODEL = "1", "deterministic"


def summary_key(node_id: Column, source: Column, model: str = MODEL) -> Column:
    """What identifies a summary in the cache: prompt version, model, node, budgets and the source that is sent."""
    parts = [F.lit(PROMPT_VERSION), F.lit(model), node_id, F.lit(str(MAX_SOURCE)), F.lit(str(MAX_SUMMARY)), F.substring(source, 1, MAX_SOURCE)]
    return F.sha2(F.concat_ws("\u001f", *parts), 256)


def summarise(source: Column, complete: Completion | None = None) -> Column:
    """A summary of a source, cut to its budget; null if it can't be used. Without `complete`, the deterministic model's."""
    if complete is None:
        head = F.regexp_replace(F.substring(X.collapse(F.substring(source, 1, MAX_SOURCE)), 1, 160), r"[ .]+$", "")
        said = X.says(X.SUMMARY, head)
    else:
        said = F.trim(complete(F.lit("You summarise books."), F.format_string(ASK_SUMMARY, F.lit(MAX_SUMMARY), F.substring(source, 1, MAX_SOURCE))))
    return F.when(F.trim(source) != "", usable_summary(said))


def usable_summary(reply: Column) -> Column:
    """A reply cut to a summary's budget; null if it is too short or says that there is none."""

    def judged(text: Column) -> Column:
        bad = F.lit(False)
        for marker in UNUSABLE:
            bad = bad | F.contains(F.lower(text), F.lit(marker))
        return F.when((F.length(text) >= MIN_SUMMARY) & ~bad, text)

    return X.named(F.regexp_replace(F.substring(F.trim(reply), 1, MAX_SUMMARY), r"\s+$", ""), judged)


def numbered(rows: DataFrame, block: Column, *order: str) -> DataFrame:
    """rows with n, their number from 1 within their book_id in the given order, along which `block` must not fall.

    Rows are numbered within each block and moved on by the sizes of the blocks before it, so no task holds a book.
    """
    rows = rows.withColumn("block", block)
    sizes = rows.groupBy("book_id", "block").agg(F.count(F.lit(1)).alias("size"))
    before = Window.partitionBy("book_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(F.col("book_id").alias("_book"), F.col("block").alias("_block"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("book_id", "block").orderBy(*order)
    joined = rows.withColumn("_own", F.row_number().over(within)).join(offsets, F.col("book_id").eqNullSafe(F.col("_book")) & F.col("block").eqNullSafe(F.col("_block")))
    return joined.withColumn("n", (F.col("_own") + F.col("_offset")).cast("int")).drop("block", "_book", "_block", "_own", "_offset")


def _leading(rows: DataFrame, by: list[str], order: str, text: str, gap: int) -> DataFrame:
    """Of each group the first rows, by order, whose texts or the `gap` before them begin within MAX_SOURCE characters.

    A running sum over sizes; what isn't part of a summary's source is left out before anything is gathered.
    """
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum(F.length(text) + gap).over(before), F.lit(0))).where(F.col("_before") < MAX_SOURCE + gap).drop("_before")


def chapter_nodes(chunks: DataFrame) -> DataFrame:
    """What `chapters` gives before summaries are made: (node_id, book_id, level, n, title, n_children, n_chunks, source).

    Texts are read once, for the sources; chapters are counted and numbered without them.
    """
    by = ["book_id", "doc_id", "chapter"]
    sizes = kept(chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("n_chunks")))
    thin = numbered(sizes, cells(sizes, "doc_id"), "doc_id", "chapter")
    told_by = chapter_sources(chunks).select(*(F.col(c).alias(f"_{c}") for c in by), "source")
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return thin.join(told_by, same).select(F.format_string("%s:chapter:%d", "book_id", "n").alias("node_id"), "book_id", F.lit(1).alias("level"), "n", F.col("chapter").alias("title"), F.lit(0).cast("long").alias("n_children"), "n_chunks", "source")


def chapters(chunks: DataFrame, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """Level 1: (node_id, book_id, level, n, title, n_children, n_chunks, source, summary, made), one for each chapter.

    What lies below a node is in tables of their own: see `node_children` and `node_chunks`.
    """
    return told(chapter_nodes(chunks), cache, complete)


def _sources(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, source): the summaries of the nodes of each group, in order of n, as many as MAX_SOURCE characters hold.

    Each has at least MIN_SUMMARY characters, so the first few hundred that have one will do: they are found in parts
    of a group before they meet.
    """
    most = MAX_SOURCE // MIN_SUMMARY
    line = F.concat("title", F.lit(": "), "summary")
    lines = nodes.where("summary is not null").select(*by, "n", line.alias("line")).withColumn("_part", F.pmod(F.xxhash64("n"), F.lit(64)))
    first = lambda rows, *keys: rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("n"))).where(F.col("_r") <= most).drop("_r")
    few = _leading(first(first(lines, *by, "_part").drop("_part"), *by), by, "n", "line", 2)
    listed = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("n", "line"))).alias("c"))
    return listed.select(*by, F.substring(F.array_join(F.transform("c", lambda x: x["line"]), "\n\n"), 1, MAX_SOURCE).alias("source"))


def _parents(nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, n_children, n_chunks, lo, hi, source) of groups of nodes: counts and bounds, and the leading summaries."""
    counts = nodes.groupBy(*by).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_chunks").alias("n_chunks"), F.min("n").alias("lo"), F.max("n").alias("hi"))
    joined = counts.join(_sources(nodes, by), by, "left")
    return joined.withColumn("source", F.coalesce("source", F.lit("")))


def _window(size: int) -> Column:
    return F.floor((F.col("n") - 1) / size)


def windows(level1: DataFrame, size: int = WINDOW, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """Level 2: runs of `size` chapters, only in books with more of them than that."""
    counts = level1.groupBy("book_id").agg(F.count(F.lit(1)).alias("_all")).where(F.col("_all") > size)
    df = _parents(level1.join(counts, "book_id").withColumn("w", _window(size)), ["book_id", "w"])
    df = df.select(F.format_string("%s:window:%d-%d", "book_id", "lo", "hi").alias("node_id"), "book_id", F.lit(2).alias("level"), F.col("lo").alias("n"), F.format_string("Chapters %d-%d", "lo", "hi").alias("title"), "n_children", "n_chunks", "source")
    return told(df, cache, complete)


def roots(level1: DataFrame, level2: DataFrame, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """Level 3: a book over its windows, or over its chapters if it has none."""
    small = level1.join(level2.select("book_id").distinct(), "book_id", "left_anti")
    df = _parents(small.unionByName(level2), ["book_id"])
    df = df.select(F.concat("book_id", F.lit(":root")).alias("node_id"), "book_id", F.lit(3).alias("level"), F.lit(1).alias("n"), F.col("book_id").alias("title"), "n_children", "n_chunks", "source")
    return told(df, cache, complete)


def tree(chunks: DataFrame, size: int = WINDOW, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """The nodes of all books' trees; each level is built once. cache: (key, pos, value), see `cached`.

    No row grows with a book: a node has counts, and the summaries that its own is made from.
    """
    return tree_over(chapter_nodes(chunks), size, cache, complete)


def tree_over(nodes: DataFrame, size: int = WINDOW, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """`tree` over chapters that are there already, see `chapter_nodes`."""
    one = stored(told(nodes, cache, complete))
    two = kept(windows(one, size, cache, complete))
    return one.unionByName(two).unionByName(roots(one, two, cache, complete))


def node_children(nodes: DataFrame, size: int = WINDOW) -> DataFrame:
    """(book_id, node_id, child, n): a row for each node below another, n its number among its level."""
    one, two, top = (nodes.where(F.col("level") == n) for n in (1, 2, 3))
    above = two.select("book_id", _window(size).alias("w"), F.col("node_id").alias("_up"))
    in_window = one.withColumn("w", _window(size)).join(above, ["book_id", "w"]).select("book_id", F.col("_up").alias("node_id"), F.col("node_id").alias("child"), "n")
    below = two.unionByName(one.join(two.select("book_id").distinct(), "book_id", "left_anti"))
    at_top = below.join(top.select("book_id", F.col("node_id").alias("_up")), "book_id").select("book_id", F.col("_up").alias("node_id"), F.col("node_id").alias("child"), "n")
    return in_window.unionByName(at_top)


def node_chunks(nodes: DataFrame, chunks: DataFrame, children: DataFrame) -> DataFrame:
    """(book_id, node_id, chunk_id, ordinal): every chunk below every node, one row each; chapters by their place, not title.

    children: of the same nodes, see `node_children`.
    """
    thin = chunks.select("book_id", "doc_id", "chapter", "chunk_id", "ordinal")
    keys = numbered(thin.select("book_id", "doc_id", "chapter").distinct(), cells(thin, "doc_id"), "doc_id", "chapter")
    keys = keys.select(*(F.col(c).alias(f"_{c}") for c in ("book_id", "doc_id", "chapter")), "n")
    same = F.lit(True)
    for c in ("book_id", "doc_id", "chapter"):
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    numbers = thin.join(keys, same).select("book_id", "n", "chunk_id", "ordinal")
    own = kept(numbers.join(nodes.where("level = 1").select("book_id", "n", "node_id"), ["book_id", "n"]).select("book_id", "node_id", "chunk_id", "ordinal"))
    up = children.select("book_id", F.col("child").alias("_child"), F.col("node_id").alias("_up"))
    lift = lambda rows: rows.join(up, (rows["book_id"] == up["book_id"]) & (F.col("node_id") == F.col("_child"))).select(rows["book_id"], F.col("_up").alias("node_id"), "chunk_id", "ordinal")
    second = kept(lift(own))
    return own.unionByName(second).unionByName(lift(second))


def tree_faults(nodes: DataFrame, children: DataFrame, members: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, reason, what): why a stored tree can't be used: its tables don't fit each other or the chunks.

    A book with another number of roots than one, an id that two nodes have, a level that there isn't, a child or a
    chunk that isn't known, a node that none is above, counts that differ from the rows below. No rows: a sound tree.
    """
    fault = lambda rows, reason, what: rows.select("book_id", F.lit(reason).alias("reason"), what.cast("string").alias("what"))
    ids = nodes.select("book_id", "node_id")
    known = nodes.select("book_id", F.col("node_id").alias("child"))
    roots_ = nodes.groupBy("book_id").agg(F.count_if(F.col("level") == 3).alias("k")).where("k <> 1")
    counts = children.groupBy("book_id", "node_id").agg(F.count(F.lit(1)).alias("below"))
    held = members.groupBy("book_id", "node_id").agg(F.count(F.lit(1)).alias("held"))
    counted = nodes.join(counts, ["book_id", "node_id"], "left").join(held, ["book_id", "node_id"], "left")
    found = [
        fault(roots_, "roots", F.col("k")),
        fault(ids.groupBy("book_id", "node_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "repeated node", F.col("node_id")),
        fault(nodes.where("level is null or level not between 1 and 3"), "level", F.col("node_id")),
        fault(children.join(known, ["book_id", "child"], "left_anti"), "unknown child", F.col("child")),
        fault(children.join(ids, ["book_id", "node_id"], "left_anti"), "unknown parent", F.col("node_id")),
        fault(known.join(nodes.where("level = 3").select("book_id", F.col("node_id").alias("child")), ["book_id", "child"], "left_anti").join(children, ["book_id", "child"], "left_anti"), "no parent", F.col("child")),
        fault(members.join(chunks.select("book_id", "chunk_id"), ["book_id", "chunk_id"], "left_anti"), "unknown chunk", F.col("chunk_id")),
        fault(counted.where(F.coalesce("below", F.lit(0)) != F.col("n_children")), "number of children", F.col("node_id")),
        fault(counted.where(F.coalesce("held", F.lit(0)) != F.col("n_chunks")), "number of chunks", F.col("node_id")),
    ]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


#: Rows whose digests make one digest of the next level.
FAN_OUT = 256


def merkle(rows: DataFrame, book: str, order: str, text: Column, *apart: str) -> DataFrame:
    """(book, digest): one digest of the rows of each book in their order, with `apart` (columns of few values) first.

    Rows are digested, then runs of FAN_OUT positions, then runs of those, then the book; order is a number from 0 that
    rows of a group don't share. A task holds FAN_OUT digests, and at the top one for 2^16 positions.
    """
    level = rows.select(book, *apart, F.col(order).cast("long").alias("at"), F.sha2(text, 256).alias("d"))
    for _ in range(2):
        run = level.withColumn("at_", F.floor(F.col("at") / FAN_OUT)).groupBy(book, *apart, "at_").agg(F.sort_array(F.collect_list(F.struct("at", "d"))).alias("c"))
        level = run.select(book, *apart, F.col("at_").alias("at"), F.sha2(F.array_join(F.transform("c", lambda x: x["d"]), ""), 256).alias("d"))
    top = level.groupBy(book).agg(F.sort_array(F.collect_list(F.struct(*apart, "at", "d"))).alias("c"))
    return top.select(book, X.digest(F.array_join(F.transform("c", lambda x: x["d"]), ""), 40).alias("digest"))


def tree_hash(nodes: DataFrame) -> DataFrame:
    """(book_id, node_count, tree_hash): a digest of the ids and summaries by level and in reading order, see `merkle`."""
    line = F.concat("node_id", F.lit("\u001f"), F.coalesce("summary", F.lit("")))
    counts = nodes.groupBy("book_id").agg(F.count(F.lit(1)).alias("node_count"))
    hashes = merkle(nodes.withColumn("_at", F.col("n") - 1), "book_id", "_at", line, "level")
    return counts.join(hashes.withColumnRenamed("digest", "tree_hash"), "book_id")


def source_hash(chunks: DataFrame) -> DataFrame:
    """(book_id, source_hash): a digest of the ordered chunk ids, which hold digests of the texts: what a tree was made from."""
    return merkle(chunks, "book_id", "ordinal", F.col("chunk_id")).withColumnRenamed("digest", "source_hash")


def tree_identity(nodes: DataFrame, chunks: DataFrame, model: str = MODEL) -> DataFrame:
    """(book_id, tree_hash, source_hash, model, counts by level): what reports say a tree was. nodes: see `tree`."""
    level = lambda n: F.count_if(F.col("level") == n)
    counts = nodes.groupBy("book_id").agg(level(1).alias("chapter_count"), level(2).alias("window_count"))
    return tree_hash(nodes).join(source_hash(chunks), "book_id").join(counts, "book_id").withColumn("model", F.lit(model))


def stale_trees(identity: DataFrame, chunks: DataFrame) -> DataFrame:
    """(book_id, reason) of stored identities (book_id, source_hash) that the chunks have gone on from."""
    now = source_hash(chunks).withColumnRenamed("source_hash", "_now")
    both = identity.select("book_id", "source_hash").join(now, "book_id", "full")
    reason = F.when(F.col("source_hash").isNull(), "no tree").when(F.col("_now").isNull(), "no chunks").when(F.col("_now") != F.col("source_hash"), "other chunks")
    return both.select("book_id", reason.alias("reason")).where("reason is not null")


def global_answers(nodes: DataFrame, questions: DataFrame, k: int = MAP_TOP_K) -> DataFrame:
    """(question_id, nodes, text) for each question about a book (book_id): partial answers of its k best nodes, reduced.

    A node's score is the number of the question's distinct tokens in its summary; ties go in reading order. A node
    without a summary takes no part; a question without nodes is refused.
    """
    asked = questions.select("question_id", "book_id", F.array_distinct(X.tokens(F.col("question"))).alias("q"))
    # A summary is cut into tokens once, not for each question; what is ranked has no texts.
    thin = nodes.where("summary is not null").select("book_id", "node_id", "level", "n", F.array_distinct(X.tokens(F.col("summary"))).alias("t"))
    score = F.size(F.array_intersect("q", "t"))
    order = Window.partitionBy("question_id").orderBy(F.desc("score"), "level", "n")
    ranked = thin.join(asked, "book_id").select("question_id", "book_id", "node_id", "level", "n", score.alias("score"))
    best = few(ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    best = nodes.where("summary is not null").select("book_id", "node_id", "level", "n", "summary").join(best, ["book_id", "node_id", "level", "n"])
    partial = X.says(X.ANSWER, F.col("summary"))
    best = best.withColumn("partial", F.trim(F.regexp_replace(partial, r" ?\[[0-9]{1,3}\]", "")))
    df = best.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("rank", "node_id", "partial"))).alias("c"))
    out = questions.select("question_id").join(df, "question_id", "left")
    first = F.get("c", F.lit(0))["partial"]
    text = F.when(first.isNull(), F.lit(X.REFUSAL % "the book")).otherwise(X.says(X.ANSWER, first))
    return out.select("question_id", F.coalesce(F.transform("c", lambda x: x["node_id"]), F.array().cast("array<string>")).alias("nodes"), text.alias("text"))


def cached(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hits, misses) of wanted by key: the last entry of a key in the cache (key, pos, value) counts."""
    latest = cache.groupBy("key").agg(F.max_by("value", "pos").alias("value"))
    return wanted.join(latest, "key"), wanted.join(latest, "key", "left_anti")


def told(nodes: DataFrame, cache: DataFrame | None = None, complete: Completion | None = None, model: str = MODEL) -> DataFrame:
    """nodes (node_id, source) with summary and made: "reused" from the cache (key, pos, value), "generated", or "failed".

    Only what the cache lacks is summarised.
    """
    if cache is None:
        hits, misses = None, nodes
    else:
        hits, misses = cached(nodes.withColumn("key", summary_key(F.col("node_id"), F.col("source"), model)), cache)
        hits, misses = hits.withColumnRenamed("value", "summary").withColumn("made", F.lit("reused")).drop("key"), misses.drop("key")
    fresh = misses.withColumn("summary", summarise(F.col("source"), complete))
    fresh = fresh.withColumn("made", F.when(F.col("summary").isNull(), "failed").otherwise("generated"))
    return fresh if hits is None else fresh.unionByName(hits)


def cache_entries(nodes: DataFrame, model: str = MODEL) -> DataFrame:
    """(key, pos, value) of nodes with source, summary and made, for the cache: what was generated anew."""
    return nodes.where("made = 'generated'").select(summary_key(F.col("node_id"), F.col("source"), model).alias("key"), F.unix_micros(F.current_timestamp()).alias("pos"), F.col("summary").alias("value"))


def chapter_sources(chunks: DataFrame) -> DataFrame:
    """(book_id, doc_id, chapter, source): the leading text of each chapter, as much as a summary is made from."""
    by = ["book_id", "doc_id", "chapter"]
    few = _leading(chunks.select(*by, "ordinal", "text"), by, "ordinal", "text", 2)
    listed = few.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.substring("text", 1, MAX_SOURCE).alias("t")))).alias("c"))
    return listed.select(*by, F.substring(F.array_join(F.transform("c", lambda x: x["t"]), "\n\n"), 1, MAX_SOURCE).alias("source"))


def tree_manifest(nodes: DataFrame) -> DataFrame:
    """(book_id, counts by level and by how summaries were made); a book none of whose chapters has a summary is an error.

    nodes: of a tree (see `told`).
    """
    level = lambda n: F.count_if(F.col("level") == n)
    out = nodes.groupBy("book_id").agg(
        level(1).alias("chapter_count"), level(2).alias("window_count"), F.count(F.lit(1)).alias("node_count"),
        *(F.count_if(F.col("made") == m).alias(f"{m}_summaries") for m in ("generated", "reused", "failed")),
        F.count_if((F.col("level") == 1) & F.col("summary").isNotNull()).alias("_told"),
    )
    failed = F.raise_error(F.concat(F.lit("no chapter could be summarised: "), F.col("book_id")))
    return out.withColumn("node_count", F.when(F.col("_told") > 0, F.col("node_count")).otherwise(failed.cast("long"))).drop("_told")


#: Fixed: an excerpt's length, a context's greatest and least, and what marks a reply that is no context.
MAX_EXCERPT, MAX_CONTEXT, MIN_CONTEXT = 6000, 500, 10
NO_CONTEXT = ("couldn't find", "cannot find", "i'm sorry", "as an ai")
ASK_CONTEXT = "Say in one sentence where this passage stands in its chapter.\n\nChapter:\n%s\n\nPassage:\n%s"


def usable_context(reply: Column) -> Column:
    """A reply in one line and cut to its budget; null if it is too short or says that there is none."""

    def judged(text: Column) -> Column:
        bad = F.length(text) < MIN_CONTEXT
        for marker in NO_CONTEXT:
            bad = bad | F.contains(F.lower(text), F.lit(marker))
        return F.when(~bad, F.regexp_replace(F.substring(text, 1, MAX_CONTEXT), r"\s+$", ""))

    return X.named(X.collapse(reply), judged)


def last_excerpts(excerpts: DataFrame) -> DataFrame:
    """(book_id, chapter, excerpt): of chapters of one title in a book the last by pos, where there is such a column."""
    cut = F.substring("excerpt", 1, MAX_EXCERPT)
    last = F.max_by(cut, "pos") if "pos" in excerpts.columns else F.max(cut)
    return excerpts.groupBy("book_id", "chapter").agg(last.alias("excerpt"))


def last_contexts(cache: DataFrame) -> DataFrame:
    """(chunk_id, context) of a log (chunk_id, pos, context): the last that isn't empty; without pos the greatest."""
    said = cache.where("chunk_id <> '' and context <> ''")
    last = F.max_by("context", F.struct("pos", "context")) if "pos" in cache.columns else F.max("context")
    return said.groupBy("chunk_id").agg(last.alias("context"))


def enriched(chunks: DataFrame, excerpts: DataFrame, cache: DataFrame | None = None, complete: Completion | None = None) -> DataFrame:
    """chunks with context: what the cache (chunk_id, pos, context) has, else a sentence on the chapter, null where it can't be used.

    excerpts: (book_id, chapter, pos, excerpt); of a title that repeats in a book the last counts, and a chunk of a
    chapter without one gets no context from the deterministic model, and a prompt with an empty excerpt otherwise.
    """
    if complete is None and "pos" in excerpts.columns:  # a sentence for each excerpt, before anything is sent
        excerpts = excerpts.withColumn("_said", _placed(F.substring("excerpt", 1, MAX_EXCERPT)))
        named = excerpts.groupBy("book_id", "chapter").agg(F.max_by("_said", "pos").alias("_said"))
    else:
        named = last_excerpts(excerpts)
        named = named if complete is not None else named.select("book_id", "chapter", _placed(F.col("excerpt")).alias("_said"))
    named = named.toDF("_book", "_chapter", "_said")
    rows = chunks.join(named, F.col("book_id").eqNullSafe(F.col("_book")) & F.col("chapter").eqNullSafe(F.col("_chapter")), "left").drop("_book", "_chapter")
    known = last_contexts(cache).withColumnRenamed("context", "_known") if cache is not None else None
    rows = rows.withColumn("_known", F.lit(None).cast("string")) if known is None else rows.join(known, "chunk_id", "left")
    fresh = F.col("_said") if complete is None else usable_context(complete(F.lit("You place passages."), context_prompt(F.col("_said"), F.col("text"))))
    return rows.withColumn("context", F.coalesce("_known", fresh)).drop("_known", "_said")


def _placed(excerpt: Column) -> Column:
    """The deterministic model's context from an excerpt, null without one."""
    head = F.regexp_replace(F.substring(X.collapse(excerpt), 1, 80), r"[ .]+$", "")
    return F.when(excerpt.isNotNull(), usable_context(X.says(X.CONTEXT, head)))


def context_prompt(excerpt: Column, text: Column) -> Column:
    return F.format_string(ASK_CONTEXT, F.coalesce(excerpt, F.lit("")), text)


def enriched_by_client(chunks: DataFrame, excerpts: DataFrame, log: DataFrame, connect: Connect) -> tuple[DataFrame, DataFrame]:
    """(chunks with context and error, new entries for the log) by a client that may fail (see `completions`).

    log: (key, run, pos, value) with chunk ids as keys. Only chunks that it lacks are asked; one that fails keeps its
    place without a context and is asked again the next time.
    """
    named = last_excerpts(excerpts).toDF("_book", "_chapter", "excerpt")
    rows = chunks.join(named, F.col("book_id").eqNullSafe(F.col("_book")) & F.col("chapter").eqNullSafe(F.col("_chapter")), "left")
    asked = rows.select(F.col("chunk_id").alias("key"), F.lit("You place passages.").alias("system"), context_prompt(F.col("excerpt"), F.col("text")).alias("user"))
    found, new = asked_once(asked, log, connect, usable_context)
    return chunks.join(found.select(F.col("key").alias("chunk_id"), F.col("value").alias("context"), "error"), "chunk_id", "left"), new


def summarised_by_client(nodes: DataFrame, log: DataFrame, connect: Connect, model: str, regenerate: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes with summary, made and error, new entries for the log): `told` by a client that may fail.

    nodes: (node_id, source); made is "reused", "generated" or "failed". regenerate: the log isn't looked at, but gets
    the new summaries. A node without source text fails without being asked.
    """
    keyed = kept(nodes.withColumn("key", summary_key(F.col("node_id"), F.col("source"), model)))
    user = F.format_string(ASK_SUMMARY, F.lit(MAX_SUMMARY), F.substring("source", 1, MAX_SOURCE))
    asked = keyed.where(F.trim("source") != "").select("key", F.lit("You summarise books.").alias("system"), user.alias("user"))
    found, new = asked_once(asked, log.limit(0) if regenerate else log, connect, usable_summary)
    out = keyed.join(found.select("key", F.col("value").alias("summary"), "made", "error"), "key", "left").drop("key")
    empty = F.col("made").isNull()
    return out.withColumns({"error": F.when(empty, "no source text").otherwise(F.col("error")), "made": F.coalesce("made", F.lit("failed"))}), new
