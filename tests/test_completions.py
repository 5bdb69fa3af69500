"""Model calls that fail, logs of what they gave, and whole-book answers."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from quire.operators import completions, thematic, whole_book


def failing_third():
    """A client whose third prompt always fails and whose fifth fails once."""
    calls = []

    def ask(system, user):
        calls.append(user)
        if user == "3" or (user == "5" and calls.count("5") == 1):
            raise TimeoutError("no reply")
        return f"{system}: reply to {user}" if user != "7" else None

    return ask


def test_a_failing_call_keeps_the_other_rows(spark):
    asked = spark.createDataFrame([(str(i), "s", str(i)) for i in range(10)] * 2, "key string, system string, user string").coalesce(1)
    got = {r.key: r for r in completions.completed(asked, failing_third, at_once=3).collect()}
    assert len(got) == 10
    assert got["3"].reply is None and got["3"].error == "TimeoutError: no reply" and got["3"].attempts == 3
    assert got["7"].error.startswith("TypeError") and got["7"].reply is None
    assert got["5"].reply == "s: reply to 5" and got["5"].attempts == 2 and got["5"].error is None
    assert all(got[str(i)].reply == f"s: reply to {i}" for i in (0, 1, 2, 4, 6, 8, 9))


def test_a_client_that_cannot_connect_is_an_error_of_each_row(spark):
    def connect():
        raise ConnectionError("closed")

    asked = spark.createDataFrame([("a", None, "x"), (None, "s", None)], "key string, system string, user string")
    assert {r.error for r in completions.completed(asked, connect).collect()} == {"ConnectionError: closed"}
    assert completions.completed(asked.limit(0), connect).collect() == []


def test_replies_are_asked_once_and_not_by_later_actions(spark, tmp_path):
    folder = str(tmp_path)

    def connect():
        def ask(system, user):
            with open(f"{folder}/calls", "a") as file:
                file.write("x")
            return "a reply of some length"

        return ask

    asked = spark.createDataFrame([("a", "s", "u"), ("a", "s", "u"), ("b", "s", "u")], "key string, system string, user string")
    out = completions.completed(asked, connect)
    assert out.count() == 2 and len(out.collect()) == 2
    assert os.path.getsize(f"{folder}/calls") == 2


def test_log_takes_the_last_and_sets_torn_lines_aside(spark, tmp_path):
    folder = str(tmp_path / "log")
    entries, rejected = completions.scan_log(spark, folder)
    assert entries.collect() == [] and rejected.collect() == []
    entry = lambda *rows: spark.createDataFrame(rows, completions.ENTRY)
    completions.append_log(entry(("a", 1, "old"), ("a", 2, "newer"), ("b", 5, "b"), ("c", 1, None)), folder, 1)
    completions.append_log(entry(("a", 0, "last\nline")), folder, 2)
    completions.append_log(entry(("a", 0, "last\nline")), folder, 2)  # the same run again
    spark.createDataFrame([('{"key":"d","pos":1,"va',), ("",), ("[]",), ('{"key":"","pos":1,"value":"x"}',), ('{"key":"e","pos":"x","value":"y"}',)], "value string").write.text(f"{folder}/log/run={3:012d}")
    os.makedirs(f"{folder}/log/run={4:012d}")
    with open(f"{folder}/log/run={4:012d}/part-0", "w") as file:  # a run that didn't end
        file.write('{"key":"z","pos":1,"value":"z"}\n')

    def state():
        entries, rejected = completions.scan_log(spark, folder)
        return {r.key: r.value for r in completions.latest(entries).collect()}, entries.count(), sorted(r.line for r in rejected.collect())

    values, n, aside = state()
    assert values == {"a": "last\nline", "b": "b"} and n == 4 and len(aside) == 4
    assert completions.compact_log(spark, folder).count() == 4
    values, n, aside = state()
    assert values == {"a": "last\nline", "b": "b"} and n == 2 and aside == []
    completions.append_log(entry(("b", 0, "after")), folder, 5)
    assert state()[0] == {"a": "last\nline", "b": "after"}
    hits, misses = completions.from_log(spark.createDataFrame([("a",), ("q",)], "key string"), completions.scan_log(spark, folder)[0])
    assert [r.value for r in hits.collect()] == ["last\nline"] and [r.key for r in misses.collect()] == ["q"]


def test_lines_of_other_programs_keep_their_order(spark, tmp_path):
    path = str(tmp_path / "cache.jsonl")
    with open(path, "w") as file:
        for i in range(20_000):
            file.write(f'{{"chunk_id": "c{i % 7}", "context": "context {i}"}}\n' if i % 1000 else "torn {\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        latest, rejected = completions.last_lines(completions.lines_in_order(spark, path), "chunk_id", "context")
        want = {f"c{i % 7}": f"context {i}" for i in range(20_000) if i % 1000}
        assert {r.key: r.value for r in latest.collect()} == want and rejected.count() == 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_enrichment_goes_on_after_failures(spark, tmp_path):
    def connect():
        def ask(system, user):
            if "two" in user:
                raise OSError("gone")
            return "I cannot find it" if "three" in user else f"  A passage\nwith {len(user)} characters "

        return ask

    chunks = spark.createDataFrame([("b", "c", f"id{i}", t) for i, t in enumerate(["one", "two", "three", "four"])], "book_id string, chapter string, chunk_id string, text string")
    excerpts = spark.createDataFrame([("b", "c", 1, "first of the title"), ("b", "c", 2, "last of the title")], "book_id string, chapter string, pos int, excerpt string")
    folder = str(tmp_path)
    got, new = thematic.enriched_by_client(chunks, excerpts, completions.scan_log(spark, folder)[0], connect)
    rows = {r.text: r for r in got.collect()}
    assert len(rows) == 4 and rows["two"].error == "OSError: gone" and rows["three"].error == "unusable"
    assert rows["one"].context == f"A passage with {len(thematic.ASK_CONTEXT % ('last of the title', 'one'))} characters"
    completions.append_log(new, folder, 1)
    again, newer = thematic.enriched_by_client(chunks, excerpts, completions.scan_log(spark, folder)[0], lambda: lambda s, u: "written at the second time")
    assert {r.text: r.context for r in again.collect()} == {"one": rows["one"].context, "four": rows["four"].context, "two": "written at the second time", "three": "written at the second time"}
    assert newer.count() == 2


def test_summaries_by_a_client(spark):
    nodes = spark.createDataFrame([("n1", "text one"), ("n2", "bad"), ("n3", "  ")], "node_id string, source string")

    def connect():
        def ask(system, user):
            if "bad" in user:
                raise ValueError("refused")
            return "A summary of some length."

        return ask

    empty = spark.createDataFrame([], completions.ENTRY)
    out, new = thematic.summarised_by_client(nodes, empty, connect, "m")
    assert {r.node_id: (r.summary, r.made, r.error) for r in out.collect()} == {
        "n1": ("A summary of some length.", "generated", None), "n2": (None, "failed", "ValueError: refused"), "n3": (None, "failed", "no source text")}
    other = lambda: lambda s, u: "Another summary this time."
    made = lambda **k: {r.node_id: r.made for r in thematic.summarised_by_client(nodes, new, other, "m", **k)[0].collect()}
    assert made() == {"n1": "reused", "n2": "generated", "n3": "failed"}
    assert made(regenerate=True) == {"n1": "generated", "n2": "generated", "n3": "failed"}


@pytest.fixture
def a_tree(spark):
    rows = [("b", f"b:chapter:{i}", 1, i, f"T{i}", f"summary {i} lighthouse" if i % 5 else None) for i in range(1, 31)] + [("b", "b:root", 3, 1, "b", "lighthouse harbour storm"), ("other", "other:root", 3, 1, "other", "...")]
    nodes = spark.createDataFrame(rows, "book_id string, node_id string, level int, n int, title string, summary string")
    questions = spark.createDataFrame([("q1", "b", "harbour storm"), ("q2", "b", "..."), ("q3", "none", "x"), ("q4", "other", "harbour")], "question_id string, book_id string, question string")
    return nodes, questions


def test_selection_by_vectors_and_in_order(a_tree):
    nodes, questions = a_tree
    small, whole = (sorted(map(tuple, whole_book.nearest_nodes(nodes, questions, 4, block).collect())) for block in (3, 1000))
    assert small == whole
    named = lambda q: [r.node_id for r in sorted(whole_book.nearest_nodes(nodes, questions, 4).collect(), key=lambda r: r.rank) if r.question_id == q]
    assert named("q1")[0] == "b:root" and len(named("q1")) == 4
    assert named("q2") == [f"b:chapter:{i}" for i in (1, 2, 3, 4)]  # nothing in common: reading order
    assert named("q3") == [] and named("q4") == ["other:root"]
    chapters = whole_book.chapters_in_order(nodes, questions).where("question_id = 'q1'").orderBy("rank").collect()
    assert [r.node_id for r in chapters] == [f"b:chapter:{i}" for i in range(1, 31) if i % 5] and [r["rank"] for r in chapters] == list(range(1, 25))


def test_answers_by_a_client_that_fails_for_one_question(spark, a_tree):
    nodes, questions = a_tree

    def connect():
        def ask(system, user):
            if user.startswith("Answer") and user.endswith("harbour"):
                raise RuntimeError("overloaded")
            return f"partial [1] of {user.count('<doc')}" if user.startswith("Answer") else f"all of {user.count('<doc')} [2] [99] [2]"

        return ask

    got = {r.question_id: r for r in whole_book.answered(nodes, questions, 4, connect=connect).collect()}
    assert len(got) == 4
    assert got["q1"].text == "all of 4 [2] [99] [2]" and list(got["q1"].citations) == [2] and not got["q1"].refused
    assert "[1] of" not in got["q1"].prompt and "partial of 1" in got["q1"].prompt
    assert got["q3"].refused and got["q3"].text == "I couldn't find that in the book." and got["q3"].error is None
    assert got["q4"].text is None and got["q4"].error == "RuntimeError: overloaded"
    # All 24 chapters in rounds of five, whose numbers stay those of the rounds' order.
    rounds = {r.question_id: r for r in whole_book.answered(nodes, questions, None, complete=lambda s, u: F.concat(F.lit("of "), F.regexp_count(u, F.lit("<doc")).cast("string")), at_once=5).collect()}
    assert rounds["q1"].text == "of 5" and [n.split(":")[-1] for n in rounds["q1"].nodes] == ["1", "7", "13", "19", "26"]
    assert not glob.glob("spark-warehouse")
