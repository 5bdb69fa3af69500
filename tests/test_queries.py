from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quire.operators import synthesis, thematic
from quire.plans import oracle, queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_query_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SMALL), oracle.ORACLE_SQL[name])


def test_examples_are_sound(spark):
    assert queries.chat_errors(spark, SMALL).count() == 0
    for r in queries.raft_examples(spark, SMALL).collect():
        assert r.n_golden == int(r.answerable) and r.n_contexts <= 5


def test_split_has_both_sides(spark):
    assert {r.split for r in queries.chat_split(spark, SMALL).collect()} == {"train", "validation"}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_replies_are_made_once(spark):
    rows = spark.createDataFrame([("Some source text.", "b", "c", 1)], "source string, book_id string, chapter string, pos int")
    assert _plan(rows.select(thematic.summarise(F.col("source")).alias("z"))).count("regexp_replace(substring(source") == 1
    assert _plan(rows.select(thematic.usable_context(F.col("source")).alias("z"))).count("regexp_replace(source") == 1


def test_chunks_are_read_by_column(spark):
    chunks = queries._chunks(spark, SMALL)
    assert "parquet" in _plan(chunks) and "text" not in chunks.select("doc_id")._jdf.queryExecution().executedPlan().toString()


def test_excerpts_become_contexts_before_they_are_sent(spark):
    chunks = spark.createDataFrame([("1", "b", "c", "text")], "chunk_id string, book_id string, chapter string, text string")
    excerpts = spark.createDataFrame([("b", "c", 1, "An older start of it."), ("b", "c", 2, "The start of the chapter.")], "book_id string, chapter string, pos int, excerpt string")
    found = thematic.enriched(chunks, excerpts)
    assert found.first().context == "A passage about: The start of the chapter."
    joined = _plan(found).split("Join", 1)[0]
    assert "regexp_replace" not in joined


def test_manifest_counts_echoes(spark):
    """Every rule over the pairs one by one: an echo is rejected, counted, and makes no example."""
    level = lambda text: " ".join(text.lower().split())
    chunks = {r.chunk_id: r for r in queries._chunks(spark, SMALL).collect()}
    found = sorted(queries.qa_pairs(spark, SMALL).collect(), key=lambda r: (r.book_id, chunks[r.chunk_id].ordinal, r.question.startswith("Why")))
    want, asked = Counter(), set()
    for r in found:
        q, a = level(r.question), level(r.answer)
        if len(r.quotes) < synthesis.MIN_QUOTE or level(r.quotes) not in level(chunks[r.chunk_id].text):
            reason = "no_verified_quotes"
        elif len(r.question) < synthesis.MIN_QUESTION or len(r.answer) < synthesis.MIN_ANSWER:
            reason = "too_short"
        elif (r.book_id, q) in asked:
            reason = "duplicate_question"
        elif SequenceMatcher(None, q, a).ratio() >= synthesis.ECHO:
            reason = "question_echoes_answer"
        else:
            reason = "kept_pairs"
            asked.add((r.book_id, q))
        want[r.book_id, reason] += 1
    got = queries.synthesis_manifest(spark, SMALL).collect()
    assert sum(r.question_echoes_answer for r in got) > 0
    for r in got:
        assert {c: r[c] for c in (*synthesis.REASONS, "kept_pairs")} == {c: want[r.book_id, c] for c in (*synthesis.REASONS, "kept_pairs")}
        assert r.example_count == r.kept_pairs
