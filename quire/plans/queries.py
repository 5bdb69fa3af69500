"""The library's queries on the driver's tables, and the same in DuckDB SQL.

A source is a book, a document a chapter, a line a block; benchmark items are the questions.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import answers, chunking, completions, index, markdown, synthesis, thematic, whole_book
from quire.operators.tables import kept, new_folder, stored
from quire.sources import retrieval


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents, built once for whatever a query does with them."""
    return stored(chunking.of_documents(_docs(spark, sf_dir)))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def doc_term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = index.postings(_docs(spark, sf_dir), "doc_id")
    return posts.groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    n = docs.agg(F.count(F.lit(1))).scalar()
    return index.idf(index.postings(docs, "doc_id"), n).select("token", "df", F.round("idf", 6).alias("idf"))


def char_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = chunking.pieces_with_offsets(chunking.document_chapters(_docs(spark, sf_dir)))
    return pieces.select("book_id", "doc_id", "piece", "char_start", "char_end")


def chunk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.of_documents(_docs(spark, sf_dir)).select("chunk_id", "book_id", "doc_id", "ordinal", "char_start", "char_end", "char_count")


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = index.metadata(chunking.of_documents(_docs(spark, sf_dir)))
    return made.withColumn("average_chunk_chars", F.round("average_chunk_chars", 6)).drop("context_count")


def hash_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = index.hashed(index.postings(_docs(spark, sf_dir), "doc_id"), "doc_id")
    return vectors.select("doc_id", "bucket", F.round("w", 6).alias("w"))


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.bm25(_chunks(spark, sf_dir), _questions(spark, sf_dir))
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def dense_topk_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.dense(index.hashed(index.postings(_chunks(spark, sf_dir))), _questions(spark, sf_dir))
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = index.retrieve(_chunks(spark, sf_dir), _questions(spark, sf_dir))
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def stored_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval from an index that was stored before, whose postings are read by the tokens asked for."""
    folder = new_folder(spark)
    retrieval.write_retrieval(chunking.of_documents(_docs(spark, sf_dir)), folder)
    hits = retrieval.Retrieval(spark, folder).retrieve(_questions(spark, sf_dir))
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 9).alias("score"))


def rrf_chapter_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits in the first chapter that contains the question; ranks are those before the filter."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = index.retrieve(chunks, questions).join(chunks.select("chunk_id", "chapter"), "chunk_id")
    wanted = answers.golden(questions, _docs(spark, sf_dir)).where("answerable")
    wanted = wanted.select("question_id", F.concat(F.lit("  "), F.upper(F.get("expected_chapters", F.lit(0)))).alias("wanted"))
    return hits.join(wanted, "question_id").where(X.names_chapter(F.col("chapter"), F.col("wanted"))).select("question_id", "chunk_id", "rank")


def reranked_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of a pool of 40 hits by the tokens they share with the question."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = index.rerank(index.retrieve(chunks, questions, k=index.POOL), chunks, questions)
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def label_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors of label 3, by cosine, to each vector whose id is divisible by 100; the filter goes to the scan."""
    vectors = _table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    hits = index.nearest(vectors.where("label = 3").select("vec_id", F.col("embedding").alias("v")), asked, 10)
    return hits.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def _answers(spark: SparkSession, sf_dir: str, k: int = index.FINAL) -> DataFrame:
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    return answers.answer(answers.prompts(index.retrieve(chunks, questions, k=k), chunks, questions))


def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("question_id", "text", F.array_join("citations", ",").alias("citations"), "refused", F.md5("documents").alias("prompt_md5"))


def golden_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = answers.golden(_questions(spark, sf_dir), _docs(spark, sf_dir))
    return out.select("question_id", "answerable", F.array_join("expected_chapters", ",").alias("expected_chapters"))


def _variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item results of retrieval depths 4 and 8; hits are ranked once and cut for each."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits = kept(index.retrieve(chunks, questions))
    ranked = hits.withColumn("k", F.explode(F.array(F.lit(8), F.lit(4)))).where("rank <= k")
    return answers.variant_items(ranked.withColumn("variant", F.concat(F.lit("top"), "k")), chunks, questions, answers.golden(questions, _docs(spark, sf_dir)))


def _rounded(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*(c if c in keys or not t == "double" else F.round(c, 6).alias(c) for c, t in df.dtypes))


def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(answers.summary(_variants(spark, sf_dir), "variant"))


def ablation_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(answers.deltas(answers.summary(_variants(spark, sf_dir), "variant"), F.col("variant") == "top8"))


def _capitals(text: Column) -> Column:
    """A text with a-z in capitals; a sharp s stays, as its capitals aren't it again in small letters."""
    return F.translate(text, ascii_lowercase, ascii_uppercase)


def snippet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of each item's four snippets in its answer: three parts of the question, and one that no text has."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    part = lambda at: _capitals(F.substring("question", at, 15))
    gold = answers.golden(questions, _docs(spark, sf_dir)).withColumn("snippets", F.array(part(1), part(16), part(31), F.lit("no such words"), F.lit(" ")))
    items = answers.item_results(gold, answers.answer(answers.prompts(index.retrieve(chunks, questions), chunks, questions)))
    return items.select("question_id", F.round("contains_rate", 6).alias("contains_rate"))


def ablation_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval depths as variants, of which the first can't be planned and another fails while it runs."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    hits, gold = kept(index.retrieve(chunks, questions)), answers.golden(questions, _docs(spark, sf_dir))

    def top(k: int) -> DataFrame:
        return answers.item_results(gold, answers.answer(answers.prompts(hits.where(F.col("rank") <= k), chunks, questions)))

    def absent() -> DataFrame:
        raise ValueError("no reranker is set")

    def broken() -> DataFrame:
        return top(4).withColumn("citation_count", F.raise_error(F.lit("the judge is gone")).cast("int"))

    out = answers.ablation(spark, {"reranked": absent, "top8": lambda: top(8), "judged": broken, "top4": lambda: top(4)})
    return _rounded(out.withColumn("skipped", F.regexp_extract("skipped", "no reranker is set|the judge is gone", 0)))


def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics with reranking off and on, crossed with 4 and 8 hits kept."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    pool = kept(index.retrieve(chunks, questions, k=index.POOL))
    ranked = answers.variants(pool, index.rerank(pool, chunks, questions), [4, 8])
    return _rounded(answers.summary(answers.variant_items(ranked, chunks, questions, answers.golden(questions, _docs(spark, sf_dir))), "variant"))


def generator_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generators over the same hits, one of which quotes a first line only, and one that wasn't run."""
    chunks, questions = _chunks(spark, sf_dir), _questions(spark, sf_dir)
    asked, gold = answers.prompts(kept(index.retrieve(chunks, questions)), chunks, questions), answers.golden(questions, _docs(spark, sf_dir))
    brief = lambda system, user: F.concat(F.lit("In the book: "), F.substring(F.regexp_extract(user, r"<doc[^>]*>\n([^\n]*)", 1), 1, 60), F.lit(" [1]"))
    made = [("plain", None), ("brief", brief)]
    items = [answers.item_results(gold, answers.answer(asked, complete=c)).withColumn("variant", F.lit(name)) for name, c in made]
    kinds = spark.sql("SELECT * FROM VALUES ('plain', 'base'), ('brief', 'adapter'), ('absent', 'file') AS v(variant, kind)")
    return _rounded(answers.compare(items[0].unionByName(items[1]), kinds))


def _pairs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = _chunks(spark, sf_dir)
    return synthesis.pairs(synthesis.replies(synthesis.sample_chunks(chunks))), chunks


def qa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)[0].select("pair_id", "book_id", "chunk_id", "question", "answer", F.array_join("quotes", "|").alias("quotes"))


def qa_filter_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chunks = _pairs(spark, sf_dir)
    return synthesis.judged(found, chunks, with_echo=False).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def qa_echo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, chunks = _pairs(spark, sf_dir)
    return synthesis.judged(found, chunks).select("pair_id", "reason")


def _raft(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    found, chunks = _pairs(spark, sf_dir)
    return synthesis.raft(synthesis.judged(found, chunks, with_echo=False).where("reason is null"), chunks), chunks


def raft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    golden = F.size(F.filter("contexts", lambda c: c["is_golden"]))
    return _raft(spark, sf_dir)[0].select("example_id", "book_id", "answerable", "answer", F.size("contexts").alias("n_contexts"), golden.alias("n_golden"))


def chat_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = synthesis.split(synthesis.chat(*_raft(spark, sf_dir)), "example_id", "book_id")
    return made.select("example_id", "split", "answerable", F.size("messages").alias("n_messages"))


def chat_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.errors(synthesis.chat(*_raft(spark, sf_dir)))


def conversation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    cell = ids.withColumn("cell", F.substring(synthesis.drawn(F.col("conv_id").cast("string")), 1, 1))
    return synthesis.split(cell, "conv_id", "cell").select("conv_id", "turns", "split")


def conversation_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of the conversations as training examples that should be grounded in documents, counted."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("content"))
    made = _table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("example_id")).agg(F.sort_array(F.collect_list(turn)).alias("m"))
    made = made.select("example_id", (F.col("example_id") % 2 == 0).alias("answerable"), F.transform("m", lambda x: F.struct(x["role"], x["content"])).alias("messages"))
    return synthesis.errors(made).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


def synthesis_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    sampled = synthesis.sample_chunks(chunks)
    judged = kept(synthesis.judged(synthesis.pairs(synthesis.replies(sampled)), chunks))
    return synthesis.synthesis_manifest(chunks, sampled, judged, synthesis.raft(judged.where("reason is null"), chunks))


def training_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthesis.training_manifest(synthesis.split(synthesis.chat(*_raft(spark, sf_dir)), "example_id", "book_id"))


def _outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as book files: a line of at most 60 characters is a heading, of a level from its length."""
    lines = _docs(spark, sf_dir).select(F.concat(F.lit("doc-"), "doc_id").alias("book_id"), F.lit("Untitled").alias("title"), F.posexplode(F.split("text", "\n")).alias("block_no", "text"))
    lines = lines.withColumn("text", F.trim("text")).where("text <> ''")
    short = F.length("text") <= 60
    return chunking.assign_chapters(lines.withColumns({"type": F.when(short, "heading").otherwise("paragraph"), "level": F.when(short, F.length("text") % 3 + 1)}))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of documents whose lines have got marks by their number."""

    def marked(line: Column, n: Column) -> Column:
        put = lambda mark: F.concat(F.lit(mark), line)
        return (
            F.when(n % 17 == 0, put("## ")).when(n % 11 == 3, put(" - ")).when(n % 11 == 4, put("12. ")).when(n % 13 == 5, put("> ")).when(n % 19 == 7, "```")
            .when(n % 23 == 1, "").when(n % 29 == 2, F.concat(F.lit("|"), line, F.lit("|"))).when(n % 31 == 4, " ---").otherwise(line)
        )

    texts = _docs(spark, sf_dir).select("doc_id", F.array_join(F.transform(F.split("text", "\n"), marked), "\n").alias("text"))
    return markdown.blocks(texts, "doc_id").select("doc_id", "block_no", "type", F.md5("text").alias("md5"), F.coalesce("level", F.lit(0)).alias("level"))


def chapter_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _outline(spark, sf_dir).select("book_id", "block_no", "chapter_no", "chapter", F.coalesce("level", F.lit(0)).alias("level"))


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.heading_paths(_outline(spark, sf_dir)).select("book_id", "block_no", F.array_join("heading_path", " / ").alias("path"))


def outline_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with chapters to chunks with the heading path of each."""
    return chunking.of_blocks(_outline(spark, sf_dir)).select("chunk_id", "book_id", "chapter", "ordinal", F.array_join("heading_path", " / ").alias("path"), "char_count")


def tree_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of trees that find the summaries of the labelled documents' chapters in the cache."""
    chunks = _chunks(spark, sf_dir)
    labelled = chunks.join(_table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi").select("chapter").distinct()
    nodes = stored(thematic.chapter_nodes(chunks))
    first = thematic.told(nodes.join(labelled, F.col("title") == F.col("chapter"), "left_semi"))
    cache = kept(thematic.cache_entries(first))
    return thematic.tree_manifest(thematic.tree_over(nodes, cache=cache))


def summary_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each chapter's summary is kept under."""
    sources = thematic.chapter_sources(_chunks(spark, sf_dir))
    return sources.select("book_id", "chapter", thematic.summary_key(F.col("chapter"), F.col("source")).alias("key"))


def contextual_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best five chunks of each question where each chunk's context is indexed before its text."""
    docs = _docs(spark, sf_dir)
    excerpts = docs.select(F.col("source").alias("book_id"), F.concat(F.lit("doc-"), "doc_id").alias("chapter"), F.col("doc_id").alias("pos"), F.col("text").alias("excerpt"))
    chunks = thematic.enriched(_chunks(spark, sf_dir), excerpts)
    whole = stored(chunks.select("chunk_id", index.index_text(F.col("context"), F.col("text")).alias("text")))
    hits = index.bm25(whole, _questions(spark, sf_dir), k=5)
    return hits.select("question_id", "chunk_id", "rank", F.round("score", 6).alias("score"))


def truncated_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors' first 16 components as unit vectors, with the least and greatest of them."""
    short = _table(spark, sf_dir, "embeddings").select("vec_id", index.truncated(F.col("embedding"), 16).alias("v"))
    return short.select("vec_id", F.size("v").alias("dim"), F.round(F.array_min("v"), 6).alias("least"), F.round(F.array_max("v"), 6).alias("greatest"))


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines when filled to 88 characters: how many, and a digest."""
    lines = X.wrapped(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", lines.alias("l")).select("doc_id", F.size("l").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("md5"))


def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = thematic.tree(_chunks(spark, sf_dir))
    return nodes.select("node_id", "book_id", "level", "title", F.col("n_children").cast("int").alias("n_children"), F.col("n_chunks").cast("int").alias("n_chunks"), "summary")


def tree_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return thematic.tree_hash(thematic.tree(_chunks(spark, sf_dir)))


def tree_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _chunks(spark, sf_dir)
    return thematic.tree_identity(kept(thematic.tree(chunks)), chunks)


def tree_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies below each node: its children, and its chunks with the first and last of them."""
    chunks = _chunks(spark, sf_dir)
    nodes = kept(thematic.tree(chunks))
    children = kept(thematic.node_children(nodes))
    members = thematic.node_chunks(nodes, chunks, children).groupBy("node_id").agg(F.count(F.lit(1)).alias("chunks"), F.min_by("chunk_id", "ordinal").alias("first_chunk"), F.max_by("chunk_id", "ordinal").alias("last_chunk"))
    below = children.groupBy("node_id").agg(F.count(F.lit(1)).alias("children"), F.min_by("child", "n").alias("first_child"), F.max_by("child", "n").alias("last_child"))
    return members.join(below, "node_id", "left").withColumn("children", F.coalesce("children", F.lit(0)))


def tree_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of trees that were damaged: nodes numbered 7 are gone, those numbered 5 are there twice, and chunks of every ninth document, too."""
    chunks = _chunks(spark, sf_dir)
    nodes = kept(thematic.tree(chunks))
    children = kept(thematic.node_children(nodes))
    members = kept(thematic.node_chunks(nodes, chunks, children))
    damaged = nodes.where("n <> 7").unionByName(nodes.where("n = 5 and level = 1"))
    found = thematic.tree_faults(damaged, children, members, chunks.where("doc_id % 9 <> 0"))
    return found.groupBy("book_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("what").alias("least"))


def global_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = thematic.global_answers(kept(thematic.tree(_chunks(spark, sf_dir))), _book_questions(spark, sf_dir))
    return out.select("question_id", F.array_join("nodes", ",").alias("nodes"), "text")


def _book_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions about whole books: an eighth of the benchmark items for each book."""
    asked = _table(spark, sf_dir, "benchmark").join(_docs(spark, sf_dir).select(F.col("source").alias("book_id")).distinct(), F.conv(F.substring(F.md5("book_id"), 1, 8), 16, 10).cast("long") % 8 == F.col("item_id") % 8)
    return asked.select(F.format_string("%s|%d", "book_id", "item_id").alias("question_id"), "book_id", F.col("text").alias("question"))


def global_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nodes of its book nearest to each question, by vectors."""
    hits = whole_book.nearest_nodes(kept(thematic.tree(_chunks(spark, sf_dir))), _book_questions(spark, sf_dir))
    return hits.select("question_id", "rank", "node_id", (F.round("score", 6) + 0.0).alias("score"))


def global_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the model is asked last about each question, after an answer from each node, and what comes of it."""
    out = whole_book.answered(kept(thematic.tree(_chunks(spark, sf_dir))), _book_questions(spark, sf_dir))
    return out.select("question_id", F.array_join("nodes", ",").alias("nodes"), F.md5("prompt").alias("prompt_md5"), "text", F.array_join("citations", ",").alias("citations"), "refused")


def global_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without vectors: all chapters of the book in reading order, as the prompt that puts their answers together has them."""
    nodes, asked = kept(thematic.tree(_chunks(spark, sf_dir))), _book_questions(spark, sf_dir)
    rows = whole_book.map_prompts(whole_book.chapters_in_order(nodes, asked), nodes, asked)
    return rows.groupBy("question_id").agg(F.count(F.lit(1)).alias("chapters"), F.max("rank").alias("last_rank"), F.max_by("node_id", "rank").alias("last_node"), F.max(F.md5("user")).alias("greatest_md5"))


def context_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What enrichment puts before each chunk: a sentence on its chapter's start."""
    chapter = _docs(spark, sf_dir).select(F.col("source").alias("book_id"), "doc_id", F.substring("text", 1, 6000).alias("excerpt"))
    head = F.regexp_replace(F.substring(X.collapse(F.col("excerpt")), 1, 80), r"[ .]+$", "")
    return _chunks(spark, sf_dir).join(chapter, ["book_id", "doc_id"]).select("chunk_id", F.substring(X.says(X.CONTEXT, head), 1, 500).alias("context"))


def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts where titles repeat, the log has several of a chunk, and the model gives some that can't be used.

    Documents are named by their first digit, so a book has at most nine titles and the last document of each counts.
    """
    title = F.concat(F.lit("part-"), F.substring(F.col("doc_id").cast("string"), 1, 1))
    excerpts = _docs(spark, sf_dir).select(F.col("source").alias("book_id"), title.alias("chapter"), F.col("doc_id").alias("pos"), F.col("text").alias("excerpt"))
    chunks = _chunks(spark, sf_dir).withColumn("chapter", title)
    times = F.explode(F.array(F.lit(1), F.lit(2), F.lit(10)))
    log = chunks.where("ordinal % 5 = 0").select("chunk_id", times.alias("pos")).withColumn("context", F.when((F.col("pos") < 10) | (F.length("chunk_id") % 2 == 0), F.concat(F.lit("kept "), "pos")))
    model = lambda system, user: F.when(F.length(user) % 3 == 0, F.lit("Sorry,  I CANNOT find it")).when(F.length(user) % 3 == 1, F.lit(" too\n few ")).otherwise(F.concat(F.lit("In  part\n"), F.length(user).cast("string"), F.lit(" ")))
    return thematic.enriched(chunks, excerpts, log, model).select("chunk_id", "chapter", "context")


def reply_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies that conversations leave in a log of two runs, compacted between them, of which each speaker's last counts.

    Lines of turns whose text has an exclamation mark or an odd length are torn, and set aside.
    """
    turns = _table(spark, sf_dir, "conversations").where("text is not null")
    torn = (F.length("text") % 2 == 1) | F.contains("text", F.lit("!"))
    lines = turns.select("turn", F.to_json(F.struct(F.format_string("%d/%s", "conv_id", "role").alias("key"), F.col("turn").alias("pos"), F.md5("text").alias("value"))).alias("line"), torn.alias("torn"))
    lines = lines.select("turn", F.when(F.col("torn"), F.expr("substring(line, 1, length(line) - 5)")).otherwise(F.col("line")).alias("value"))
    folder = new_folder(spark)
    lines.where("turn < 3").select("value").write.text(f"{folder}/log/run={1:012d}")
    first = completions.compact_log(spark, folder)
    lines.where("turn >= 3").select("value").write.text(f"{folder}/log/run={2:012d}")
    entries, rejected = completions.scan_log(spark, folder)
    aside = first.unionByName(rejected).agg(F.lit("set aside").alias("key"), F.count(F.lit(1)).alias("pos"), F.lit(None).cast("string").alias("value"))
    return completions.latest(entries).unionByName(aside)


def summary_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents find a summary under their text's key, if those of the labelled ones were kept; the last counts."""
    keyed = _docs(spark, sf_dir).select("doc_id", X.digest(F.col("text"), 40).alias("key"))
    kept = _table(spark, sf_dir, "labels").select("doc_id").distinct().join(keyed, "doc_id").select("key", F.col("doc_id").alias("pos"), F.col("doc_id").alias("value"))
    hits, misses = thematic.cached(keyed, kept)
    return hits.select("doc_id", F.col("value").cast("string").alias("value")).unionByName(misses.select("doc_id", F.lit(None).cast("string").alias("value")))


def chapter_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chapter as Markdown: its title, then its blocks."""
    pieces = chunking.document_chapters(_docs(spark, sf_dir)).where(F.size("pieces") > 0)
    body = F.array_join(F.transform("pieces", lambda x: x["text"]), "\n\n")
    return pieces.select("book_id", "doc_id", F.concat(F.lit("## "), "chapter", F.lit("\n\n"), body, F.lit("\n")).alias("markdown"))


def page_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What names a page as a chapter: its first h1, else h2, else h3, else the last part of its address."""
    heading = lambda n: F.nullif(X.collapse(F.regexp_replace(F.regexp_extract("html", rf"(?is)<h{n}(?:\s[^>]*)?>(.*?)</h{n}>", 1), "<[^>]*>", "")), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract("url", r"([^/.?#]*)[^/]*$", 1), "[-_]+", " ")
    return _table(spark, sf_dir, "pages").select("page_id", F.coalesce(heading(1), heading(2), heading(3), stem).alias("heading"))


def location_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = lambda c: F.floor(F.col(c) / 2000).cast("int")
    label = X.location(F.col("chapter"), F.col("book_id"), page("char_start"), page("char_end"))
    return _chunks(spark, sf_dir).select("chunk_id", label.alias("label"))


def library_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    books = _docs(spark, sf_dir).groupBy(F.col("source").alias("book_id")).agg(F.count(F.lit(1)).alias("documents"))
    built = index.metadata(_chunks(spark, sf_dir)).select("book_id", "chunk_count")
    return books.join(built, "book_id", "left").withColumn("indexed", F.col("chunk_count").isNotNull()).orderBy("book_id")


QUERIES = {
    f.__name__: f
    for f in (
        tokenize_stats, doc_term_stats, idf_table, char_offsets, chunk_packing, index_metadata, hash_buckets, bm25_topk, dense_topk_hash, hybrid_rrf, stored_hybrid, snippet_rates, ablation_skipped,
        rrf_chapter_filter, reranked_topk, label_topk, cited_answers, golden_items, eval_summary, ablation_deltas, qa_pairs, qa_filter_reasons, qa_echo_filter,
        raft_examples, ablation_matrix, generator_comparison, conversation_errors, synthesis_manifest, training_manifest, markdown_blocks, chapter_assignment, heading_paths, outline_chunks, tree_manifest, summary_keys, contextual_bm25, truncated_vectors, wrapped_lines, chat_split, chat_errors, conversation_split, tree_nodes, tree_hash, tree_identity, tree_members, tree_faults, global_answers, global_selection, global_prompts, global_chapters, context_prefixes, enriched_chunks, reply_log, summary_cache, chapter_markdown, page_headings, location_labels, library_listing,
    )
}
