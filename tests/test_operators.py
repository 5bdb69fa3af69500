import io
import math
import random
import re
import struct
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import answers, chunking, index, markdown, synthesis, tables, thematic
from quire.plans import queries
from quire.sources import artifacts, books
from quire.streaming import postings


def literal_packer(chars, heading, target, overlap, most):
    """The packer with an explicit buffer of piece numbers."""
    out, held = [], []
    size = lambda: sum(chars[i] + 2 for i in held)

    def flush(room):
        nonlocal held
        out.append((held[0], held[-1]))
        keep = []
        for i in reversed(held):
            if sum(chars[j] + 2 for j in keep) + chars[i] + 2 > room:
                break
            keep.insert(0, i)
        held = keep

    for i, n in enumerate(chars):
        if any(not heading[j] for j in held) and size() + n + 2 > most:
            flush(min(overlap, most - n - 2))
        held.append(i)
        if size() >= target:
            flush(overlap)
    if held:
        out.append((held[0], held[-1]))
    return out


def test_packer_equals_a_literal_one():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(0, 30)
        chars = [rng.choice([rng.randint(1, 60), rng.randint(1, 350)]) for _ in range(n)]
        heading = [rng.random() < 0.2 for _ in range(n)]
        assert chunking.pack_ranges(chars, heading, 180, 25, 360) == literal_packer(chars, heading, 180, 25, 360)


def test_long_lines_are_cut_at_spaces(spark):
    texts = ["word " * 2000, "x" * 8000, "short", "", "y" * 50 + "\n" + "z" * 3590]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", chunking.split_long(F.col("t")).alias("p")).collect()
    parts = {r.i: r.p for r in rows}
    assert all(len(p) <= 3600 for p in parts[0]) and " ".join(parts[0]).split() == texts[0].split()
    assert parts[1] == ["x" * 3600, "x" * 3600, "x" * 800] and parts[2] == ["short"] and parts[3] == []
    assert parts[4] == [texts[4][:3600], texts[4][3600:]]


def test_lines_keep_digits_and_lose_spaces_at_their_ends(spark):
    lines = [f"{n} of {n} {n}" for n in range(12)]
    docs = spark.createDataFrame([("a", 1, "\n".join(f" {line} " for line in lines))], "source string, doc_id bigint, text string")
    assert [p.text for p in chunking.document_chapters(docs).first().pieces] == lines


def test_sources_end_in_what_lies_between_texts(spark):
    for size, want in ((5997, "x" * 5997 + "\n\ny"), (5998, "x" * 5998 + "\n\n"), (5999, "x" * 5999 + "\n"), (6000, "x" * 6000)):
        rows = spark.createDataFrame([("a", 1, "c", 0, "x" * size), ("a", 1, "c", 1, "yz")], "book_id string, doc_id long, chapter string, ordinal int, text string")
        assert thematic.chapter_sources(rows).first().source == want


def test_capitals_keep_what_small_letters_say(spark):
    texts = ["Enlich schß. Ö.", "Das. Ein Über"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(queries._capitals(F.col("t"))).collect()
    assert [r[0] for r in got] == ["ENLICH SCHß. Ö.", "DAS. EIN ÜBER"]


def test_bm25_shuffles_no_chunks_and_equals_brute_force(spark):
    rng = random.Random(5)
    texts = {f"c{i:04d}": " ".join(rng.choices([f"w{n}" for n in range(60)], k=rng.randint(0, 30))) for i in range(1500)} | {"c-empty": "", "c-none": None}
    asked = {i: " ".join(rng.choices([f"w{n}" for n in range(70)], k=5)) for i in range(300)} | {900: "absent", 901: "", 902: "w1 w1 w2"}
    chunks = tables.kept(spark.createDataFrame(list(texts.items()), "chunk_id string, text string"))
    got = index.bm25(chunks, spark.createDataFrame(list(asked.items()), "question_id long, question string"), 4)
    assert "hashpartitioning(chunk_id" not in got._jdf.queryExecution().executedPlan().toString()

    words = {c: (t or "").split() for c, t in texts.items()}
    df = Counter(w for t in words.values() for w in set(t))
    raw = {w: math.log(len(words) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
    idf = {w: r if r >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, r in raw.items()}
    # The size of an absent text's tokens is null, and a mean leaves it out.
    mean = sum(len(t) for c, t in words.items() if c != "c-none") / (len(words) - 1)
    want = []
    for q, text in asked.items():
        scores = {}
        for c, t in words.items():
            of = lambda w: t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean))  # noqa: E731, B023
            scores[c] = sum(idf.get(w, 0) * of(w) for w in text.split() if w in t)
        best = sorted((c for c in scores if scores[c] > 0), key=lambda c: (-round(scores[c], 9), c))[:4]
        want += [(q, c, n + 1) for n, c in enumerate(best)]
    assert sorted((r.question_id, r.chunk_id, r["rank"]) for r in got.collect()) == sorted(want)


def test_books_may_share_ids_and_repeat(spark):
    docs = spark.createDataFrame([(0, "one two", "a"), (0, "three four", "b"), (None, "five", "a"), (0, None, "a"), (1, "six", "a"), (1, "six", "a")], "doc_id long, text string, source string")
    got = chunking.of_documents(docs).collect()
    assert sorted((r.book_id, r.doc_id if r.doc_id is not None else -1, r.text) for r in got) == [("a", -1, "five"), ("a", 0, "one two"), ("a", 1, "six"), ("a", 1, "six"), ("b", 0, "three four")]
    assert sorted(r.ordinal for r in got if r.book_id == "a") == [0, 1, 2, 3]
    assert all(r.char_end - r.char_start == r.char_count for r in got)


def literal_paths(blocks):
    """Heading paths with an explicit stack."""
    out, stack = [], []
    for kind, text, level in blocks:
        if kind == "heading":
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
        out.append([t for _, t in stack])
    return out


def test_heading_paths_equal_a_literal_stack(spark):
    rng = random.Random(2)
    blocks = [("heading", f"h{i}", rng.randint(1, 6)) if rng.random() < 0.5 else ("paragraph", f"p{i}", None) for i in range(200)]
    df = spark.createDataFrame([("b", 1, i, *b) for i, b in enumerate(blocks)], "book_id string, chapter_no int, block_no int, type string, text string, level int")
    got = [r.heading_path for r in chunking.heading_paths(df).orderBy("block_no").collect()]
    assert got == literal_paths(blocks)


def test_files_become_chunks_with_headings_and_an_index(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.md").write_text("# One\n\n## Deep\n\n" + "red fox " * 20 + "\n\n### Deeper\n\n" + "blue sea " * 30 + "\n\n# Two\n\n## Two\n\nend\n")
    (tmp_path / "in" / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "in" / "empty.txt").write_text("\n \n")
    blocks = books.read_books(spark, str(tmp_path / "in"))
    assert sorted(r.path.rpartition("/")[2] for r in books.failures(blocks).collect()) == ["bad.epub", "empty.txt"]
    chunks = chunking.chunks(chunking.block_chapters(blocks), target=150, overlap=20, most=400)
    got = [(r.chapter, r.ordinal, r.heading_path, r.text[:8]) for r in chunks.orderBy("ordinal").collect()]
    assert got == [("One", 0, ["Deep"], "Deep\n\nre"), ("One", 1, ["Deep", "Deeper"], "Deeper\n\n"), ("Two", 2, ["Two"], "Two\n\nend")]
    artifacts.write_index(chunks.withColumn("heading_path", F.array_join("heading_path", "/")), str(tmp_path / "index"))
    assert {"fox", "sea"} <= {r.token for r in artifacts.read_index(spark, str(tmp_path / "index"))["postings"].collect()}


def test_missing_training_context_is_fatal(spark):
    chunks = a_book(spark, "a", "one two", "three")
    context = [("gone", "x", True)]
    df = spark.createDataFrame([("e", "a", "q", True, "x [1]", context)], f"example_id string, book_id string, question string, answerable boolean, answer string, contexts array<{artifacts.CONTEXT}>")
    with pytest.raises(Exception, match="no chunk gone"):
        synthesis.chat(df, chunks).collect()


def test_completions_and_caches(spark):
    chunks = a_book(spark, "a", "one two", "three", "four", "five", "six")
    calls = lambda system, user: F.concat(F.lit("Summary with "), F.length(user).cast("string"), F.lit(" characters"))
    first = thematic.tree(chunks, complete=calls).cache()
    assert {r.made for r in first.collect()} == {"generated"} and first.where("summary not like 'Summary with %'").count() == 0
    again = thematic.tree_manifest(thematic.tree(chunks, cache=thematic.cache_entries(first), complete=calls)).first()
    assert (again.chapter_count, again.window_count, again.node_count, again.reused_summaries, again.generated_summaries) == (5, 2, 8, 8, 0)
    with pytest.raises(Exception, match="no chapter could be summarised: a"):
        thematic.tree_manifest(thematic.tree(chunks, complete=lambda s, u: F.lit("I'm sorry"))).collect()
    excerpts = spark.createDataFrame([("a", "doc-0", "An excerpt"), ("a", "doc-1", "Other")], "book_id string, chapter string, excerpt string")
    known = spark.createDataFrame([(chunks.orderBy("ordinal").first().chunk_id, "kept before")], "chunk_id string, context string")
    got = {r.chapter: r.context for r in thematic.enriched(chunks, excerpts, known).collect()}
    assert got == {"doc-0": "kept before", "doc-1": "A passage about: Other.", "doc-2": None, "doc-3": None, "doc-4": None}


def test_lines_wrap_and_join(spark):
    rows = spark.createDataFrame([("aa bb  cc ddddddd e",), ("",)], "t string").select(X.wrapped(F.col("t"), 5)).collect()
    assert [r[0] for r in rows] == [["aa bb", "cc", "ddddddd", "e"], [""]]
    page = spark.createDataFrame([("A line that  \ngoes on.\nNew: \nlast\n\nend",)], "t string").select(X.rejoined(F.col("t"))).first()[0]
    assert page == "A line that goes on.\nNew:\nlast  end"


def test_json_lines_round_trip(spark, tmp_path):
    chunks = a_book(spark, "a", "one", "two")
    nodes, folder = thematic.tree(chunks), str(tmp_path / "tree")
    artifacts.write_tree(nodes, chunks, folder)
    again, children, members = artifacts.read_tree(spark, folder, chunks)
    assert sorted(map(tuple, again.select("node_id", "summary").collect())) == sorted(map(tuple, nodes.select("node_id", "summary").collect()))
    assert children.count() == 2 and members.count() == 4
    with pytest.raises(ValueError, match="a: other chunks"):
        artifacts.read_tree(spark, folder, chunks.where("ordinal = 0"))
    with pytest.raises(ValueError, match="b: no tree"):
        artifacts.read_tree(spark, folder, chunks.unionByName(a_book(spark, "b", "three")))
    (tmp_path / "bad.jsonl").write_text('{"pair_id": 3\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        artifacts.read_pairs(spark, str(tmp_path / "bad.jsonl")).collect()


def test_nearest_vectors(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 2.0]) for _ in range(4)]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = {}
    for r in index.nearest(df, df.where("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id))
    cosine = lambda a, b: sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1)
    for i, q in rows[:20]:
        best = sorted((-round(cosine(q, v), 9) + 0.0, j) for j, v in rows)[:5]
        assert sorted(got[i]) == [(n, j) for n, (_, j) in enumerate(best, 1)]


def test_nearest_of_odd_vectors(spark):
    """Vectors of other lengths, of nothing, with nulls or infinities, and in blocks of their own."""
    odd = [(1, [1.0, 0.0]), (2, [1.0]), (3, [0.0, 0.0, 2.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan")]), (8, [float("inf"), 1.0]), (9, [0.0]), (None, [1.0])]
    vectors = spark.createDataFrame(odd, "vec_id long, v array<double>")
    for n in (1, 4):
        got = {(r.query_id, r.vec_id): r.score for r in index.nearest(vectors.repartition(n), vectors.toDF("query_id", "q"), 9).collect()}
        assert {q for q, _ in got} == {v for _, v in got} == {1, 2, 3, 9} and len(got) == 16
        assert got[1, 2] == 1.0 and got[1, 3] == 0.0 and got[3, 3] == 1.0 and got[9, 9] == 0.0
    assert index.nearest(vectors.limit(0), vectors.toDF("query_id", "q"), 9).collect() == []


def test_chapter_names(spark):
    rows = [("The  Storm", "storm"), ("Stormy", "storm"), ("a+b (c)", "+b (c)"), ("any", " ")]
    got = spark.createDataFrame(rows, "chapter string, wanted string").select(X.names_chapter(F.col("chapter"), F.col("wanted"))).collect()
    assert [r[0] for r in got] == [True, False, True, True]


def test_reply_rescue(spark):
    rows = [("c1", 'Sure: [{"question": " Why? ", "answer": "Because.", "quotes": ["x", 1, " "]}] ok'), ("c2", '{"question": "q"}'), ("c3", "no"), ("c4", '[{"question": 5, "answer": "a"}]')]
    df = spark.createDataFrame(rows, "chunk_id string, reply string").withColumns({"book_id": F.lit("b"), "chapter": F.lit("c")})
    got = synthesis.pairs(df).collect()
    assert [(r.chunk_id, r.question, r.answer, r.quotes) for r in got] == [("c1", "Why?", "Because.", ["x"])]


def test_cache_takes_the_last_entry(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "key string")
    cache = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new")], "key string, pos int, value string")
    hits, misses = thematic.cached(wanted, cache)
    assert [tuple(r) for r in hits.collect()] == [("a", "new")] and [r.key for r in misses.collect()] == ["b"]


def test_markdown(spark):
    """Each case as the blocks it makes; the first is a whole page."""
    cases = [
        ("# One #\n\na\nb\n\n- x\n  more\n> q\n> r\n\n---\n```\ncode\n```\n|a|b|\n## Two\nend", [("heading", "One", 1), ("paragraph", "a b", None), ("list", "- x\nmore", None), ("quote", "q\nr", None), ("code", "code", None), ("table", "|a|b|", None), ("heading", "Two", 2), ("paragraph", "end", None)]),
        ("a\r\n1. b\rc\n12) d\n1234. e", [("paragraph", "a", None), ("list", "1. b\nc\n12) d\n1234. e", None)]),
        ("``` x\na\n~~~\n\n# no\n```\n~~~\nb\n```\nc", [("code", "a\n~~~\n\n# no", None), ("code", "b\n```\nc", None)]),
        ("```\n```\n```\nx\n```\n```\ny\n```", [("code", "x", None), ("code", "y", None)]),
        ("####### seven\n#none\n# C# ##\n# #\n#  \n###### six", [("paragraph", "####### seven #none", None), ("heading", "C#", 1), ("heading", "#", 1), ("heading", "six", 6)]),
        ("***\n* a\n**b**\n---\n--\n    - far\n\n    > far", [("list", "* a\n**b**", None), ("paragraph", "-- - far", None), ("paragraph", "> far", None)]),
        (">\n>x\n>  y \n|\n||\n|a", [("quote", "x\n y", None), ("paragraph", "|", None), ("table", "||", None), ("paragraph", "|a", None)]),
        ("-\tx\n-y\n+ z", [("list", "-\tx\n-y\n+ z", None)]),
        ("", []), (None, []), (" \n\t", []),
    ]
    texts = spark.createDataFrame([(i, c[0], "other") for i, c in enumerate(cases)], "id int, text string, line string")
    got = markdown.blocks(texts, "id").orderBy("id", "block_no").collect()
    for i, (_, want) in enumerate(cases):
        assert [(r.type, r.text, r.level) for r in got if r.id == i] == want
        assert [r.block_no for r in got if r.id == i] == list(range(len(want)))
    again = markdown.blocks(markdown.rendered(markdown.blocks(texts.where("id in (0, 3)"), "id"), "id"), "id", "markdown")
    assert sorted(map(tuple, again.collect())) == sorted(tuple(r) for r in got if r.id in (0, 3))
    assert books.slug("Été à Paris!") == "ete-a-paris" and books.slug("…") == "book"


def test_books_from_files(spark, tmp_path):
    (tmp_path / "b.md").write_text("intro\n\n# A\n\ntext\n")
    with zipfile.ZipFile(tmp_path / "e.epub", "w") as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package><metadata><title>My Book</title></metadata><manifest><item id="c" href="c.xhtml"/><item id="s" href="s.xhtml"/></manifest><spine><itemref idref="c"/><itemref idref="s"/></spine></package>')
        z.writestr("o/c.xhtml", "<html><head><title>x</title></head><body><h1>First</h1><p>Some &amp; more</p></body></html>")
        z.writestr("o/s.xhtml", "<p>short</p>")
    rows = books.read_books(spark, str(tmp_path)).orderBy("book_id", "chapter_no", "block_no").collect()
    assert [(r.book_id, r.chapter, r.type, r.text) for r in rows] == [("b", "b", "paragraph", "intro"), ("b", "A", "paragraph", "text"), ("my-book", "First", "paragraph", "Some & more")]


def test_sums_run_over_ids_that_lie_far_apart(spark):
    """Ids 2^40 apart, negative ones, ties and nulls: few cells, and the sums of the rows before each."""
    ids = [(i - 500) << 40 for i in range(1000)] + [7] * 50 + [None]
    rows = spark.createDataFrame([("ab"[n % 2], i, n, n % 9) for n, i in enumerate(ids)], "g string, id long, n int, w int").repartition(4)
    placed = rows.withColumn("cell", tables.cells(rows, "id"))
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert 32 <= len(sizes) <= tables.CELLS + 1 and max(sizes) <= 3 * len(ids) // tables.CELLS + 50
    got = {r.n: r.before for r in tables.running(rows, "g", ["id", "n"], before=F.col("w")).collect()}
    for g in "ab":
        total = 0
        for _, n in sorted((-(1 << 62) if i is None else i, n) for n, i in enumerate(ids) if "ab"[n % 2] == g):
            assert got[n] == total
            total += n % 9
    assert tables.running(rows.limit(0), "g", ["id", "n"], before=F.col("w")).collect() == []


def test_books_are_numbered_in_blocks(spark):
    rng = random.Random(4)
    ids = rng.sample(range(-9000, 60000), 300)
    docs = spark.createDataFrame([(i, f"text of {i}", "ab"[i % 2]) for i in ids], "doc_id long, text string, source string")
    got = thematic.numbered(docs.select("doc_id", F.col("source").alias("book_id")), F.floor(F.col("doc_id") / 4096), "doc_id").collect()
    for book in "ab":
        assert [r.doc_id for r in sorted((r for r in got if r.book_id == book), key=lambda r: r.n)] == sorted(i for i in ids if "ab"[i % 2] == book)
        assert sorted(r.n for r in got if r.book_id == book) == list(range(1, 1 + sum("ab"[i % 2] == book for i in ids)))
    one = thematic.chapters(chunking.of_documents(docs))
    numbered = re.findall(r"row_number\(\) windowspecdefinition\((\w+)#\d+L?, (\w+)#", one._jdf.queryExecution().optimizedPlan().toString())
    assert ("book_id", "block") in numbered and ("book_id", "doc_id") not in numbered and one.count() == 300


def test_model_header():
    s = lambda t: struct.pack("<Q", len(t)) + t.encode()
    data = b"GGUF" + struct.pack("<IQQ", 3, 1, 1) + s("general.architecture") + struct.pack("<I", 8) + s("x") + s("w") + struct.pack("<IQQIQ", 2, 3, 4, 0, 0)
    head = books.gguf_header(io.BytesIO(data))
    assert head["parameter_count"] == 12 and head["metadata"] == {"general.architecture": "x"}
    with pytest.raises(ValueError, match="truncated in tensors"):
        books.gguf_header(io.BytesIO(data[:-4]))


def a_book(spark, name, *texts):
    return chunking.of_documents(spark.createDataFrame([(n, t, name) for n, t in enumerate(texts)], "doc_id long, text string, source string"))


def test_index_again_replaces_a_book_and_no_other(spark, tmp_path):
    folder = str(tmp_path)
    artifacts.write_index(a_book(spark, "a", "one two", "three").unionByName(a_book(spark, "b", "four")), folder)
    artifacts.write_index(a_book(spark, "a", "five").unionByName(a_book(spark, "c", "six")), folder)
    artifacts.write_index(a_book(spark, "c", "!"), folder)
    got = artifacts.read_index(spark, folder)
    assert {(r.book_id, r.text) for r in got["chunks"].collect()} == {("a", "five"), ("b", "four"), ("c", "!")}
    assert {r.token for r in got["postings"].collect()} == {"five", "four"}
    assert [r.book_id for r in artifacts.read_index(spark, folder, "b")["vectors"].select("book_id").distinct().collect()] == ["b"]


def test_invalid_training_examples_write_nothing(spark, tmp_path):
    rows = [("e1", True, [("system", "s"), ("user", "<doc id=\"1\">x</doc>"), ("assistant", "yes [2]")], "train")]
    bad = spark.createDataFrame(rows, "example_id string, answerable boolean, messages array<struct<role:string,content:string>>, split string")
    with pytest.raises(ValueError, match="bad citations"):
        artifacts.write_training(bad, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists()


def test_rerank_orders_by_score_then_pool(spark):
    pool = spark.createDataFrame([(1, c, n) for n, c in enumerate("abc", 1)], "question_id long, chunk_id string, rank int")
    chunks = spark.createDataFrame([("a", "none"), ("b", "red"), ("c", "The RED fox")], "chunk_id string, text string")
    asked = spark.createDataFrame([(1, "red fox fox")], "question_id long, question string")
    got = index.rerank(pool, chunks, asked, 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in got] == [("c", 1.0), ("b", 0.5)]


def test_streamed_postings_equal_those_of_the_last_texts(spark, tmp_path):
    into, table, progress = (str(tmp_path / x) for x in ("in", "table", "progress"))
    schema = "doc_id long, text string, source string"
    spark.createDataFrame([(1, "a b a", "s"), (2, "c", "s")], schema).write.mode("append").parquet(into)
    postings.append_postings(postings.arriving(spark, into), table, progress).awaitTermination()
    spark.createDataFrame([(2, "…", "s"), (3, None, "s"), (4, "d", "s")], schema).write.mode("append").parquet(into)
    postings.append_postings(postings.arriving(spark, into), table, progress).awaitTermination()
    assert sorted((r.doc_id, r.token, r.tf) for r in postings.latest(spark, table).collect()) == [(1, "a", 2), (1, "b", 1), (4, "d", 1)]


def test_dense_equals_brute_force(spark):
    """Every chunk that shares a bucket with a question can be a hit, whatever its score; ties go by chunk, and empty questions have none."""
    texts = ["red fox", "red fox", "blue fox runs", "red red red", "green owl", "", None, "owl owl fox", "one two three four five six"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    questions = spark.createDataFrame([(1, "red fox"), (2, "owl"), (3, ""), (4, None), (5, "unheard word"), (6, "three green foxes")], "question_id long, question string")
    for dim, k in ((4, 3), (512, 20)):  # few buckets: collisions, cancelled and negative scores
        vectors = index.hashed(index.postings(chunks), dim=dim)
        asked = index.hashed(index.postings(questions, "question_id", "question"), "question_id", dim)
        side = lambda df, key: {i: {r.bucket: r.w for r in df.collect() if r[key] == i} for i in {r[key] for r in df.collect()}}
        held, wanted = side(vectors, "chunk_id"), side(asked, "question_id")
        want = []
        for q, b in wanted.items():
            scored = [(-round(sum(w * b.get(x, 0.0) for x, w in v.items()), 9), c) for c, v in held.items() if set(v) & set(b)]
            want += [(q, c, n + 1) for n, (_, c) in enumerate(sorted(scored)[:k])]
        got = index.dense(vectors, questions, k, dim).select("question_id", "chunk_id", "rank").collect()
        assert want and sorted(map(tuple, got)) == sorted(want)
    assert index.dense(vectors.limit(0), questions).count() == index.dense(vectors, questions.limit(0)).count() == 0


def test_texts_are_shuffled_once_for_running_sums_and_not_for_hits(spark):
    rows = spark.createDataFrame([(g, i, (i or 0) % 7, "text") for g in ("a", "b", None) for i in [None, *range(300)]], "g string, id long, w int, text string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        summed = tables.running(rows, "g", ["id"], before=F.coalesce("w", F.lit(0)))
        # The rows, and the sums of cells three times: by cell, by group, and to where the rows are.
        assert summed._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 4
        got = sorted((r.g or "", r.id, r.before) for r in summed.where("id is not null").collect())
        assert got == [(g, i, sum(k % 7 for k in range(i))) for g in ("", "a", "b") for i in range(300)]

        chunks = tables.kept(spark.createDataFrame([(f"c{i}", "one", f"text {i}") for i in range(50)], "chunk_id string, chapter string, text string"))
        hits = spark.createDataFrame([(1, "c3", 2), (1, "c5", 1), (2, "c5", 1)], "question_id long, chunk_id string, rank int")
        questions = spark.createDataFrame([(1, "text 5"), (2, "text"), (3, "none")], "question_id long, question string")
        asked, again = answers.prompts(hits, chunks, questions), index.rerank(hits, chunks, questions)
        for df in (asked, again):
            assert "hashpartitioning(chunk_id" not in df._jdf.queryExecution().executedPlan().toString()
        assert {r.question_id: [c.chunk_id for c in r.contexts or []] for r in asked.collect()} == {1: ["c5", "c3"], 2: ["c5"], 3: []}
        assert [(r.question_id, r.chunk_id) for r in again.orderBy("question_id", "rank").collect()] == [(1, "c5"), (1, "c3"), (2, "c5")]
        many = chunks.join(tables.few(hits, 2), "chunk_id")  # three rows are more than a few
        assert "hashpartitioning(chunk_id" in many._jdf.queryExecution().executedPlan().toString() and many.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
