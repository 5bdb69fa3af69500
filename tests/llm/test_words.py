"""Operators 11 to 13 against the library, SQL and brute force."""

import base64
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from quire.llm import bytepairs, phrases, queries, spelling
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(bytepairs.VOCABULARY), "rb"))}
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_pairs_equal_the_library(spark, library):
    ranks, encoding = library
    rng = random.Random(5)
    pieces = sorted(ranks)
    texts = [None, "", " ", "\n\n\n x", "<|endoftext|> a", "\x00\x01", "it's 'LL we'll \u0085x　y", "-" * 1501, "ab" * 700, " " * 900 + "x"]
    texts += ["".join(rng.choices("abcdefghij", k=400))] * 2
    texts += [b"".join(rng.choices(pieces, k=rng.randint(1, 12))).decode("utf-8", "ignore") for _ in range(100)]
    # Code points of every kind, with those that are newer than Java's Unicode: beside letters, digits and marks.
    codes = [c for c in range(0, 0x32400, 23) if not 0xD800 <= c < 0xE000] + [*range(0x1DF00, 0x1DF2B), *range(0x31350, 0x31360), *range(0x10D40, 0x10D90)]
    texts += ["".join(f"x{chr(c)} {chr(c)}1{chr(c)}." for c in codes[a : a + 900]) for a in range(0, len(codes), 900)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("a column of the table"))
    rows = bytepairs.encoded(docs, known=50).withColumn("decoded", bytepairs.decoded(F.col("_ids"))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["_ids"] == ",".join(map(str, encoding.encode_ordinary(r.text or "")))
        assert bytes(r.decoded).decode() == (r.text or "")


def test_byte_pairs_of_the_tables(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op11_bytepairs"](spark, SMALL).collect():
        assert r.n_tokens == len(library[1].encode_ordinary(texts[r.doc_id]))


def test_byte_pairs_of_an_empty_table(spark):
    assert bytepairs.encoded(spark.createDataFrame([], "text string")).collect() == []


def test_phrases_equal_sql(spark, same):
    same(queries.QUERIES["op12_phrases"](spark, SMALL), queries.ORACLE_SQL["op12_phrases"])


def brute_phrases(rows, depth, least, top):
    f, n = Counter(), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            f.update((lang or "und", *w[i : i + d]) for d in range(1, depth + 1) for i in range(len(w) - d + 1))
    held = {p: c for p, c in f.items() if c >= least and len(p) > 2}
    inside = lambda p, q: any(q[1 + i : 1 + i + len(p) - 1] == p[1:] for i in range(len(q) - len(p) + 1))
    out = {}
    for p, a in held.items():
        if any(q[0] == p[0] and len(q) > len(p) and c >= a and inside(p, q) for q, c in held.items()):
            continue
        cuts = [(1000 * a * n[p[0]] // (f[p[: k + 1]] * f[(p[0], *p[k + 1 :])]), k, f[p[: k + 1]], f[(p[0], *p[k + 1 :])]) for k in range(1, len(p) - 1)]
        score, _, l, r = min(cuts)  # noqa: E741
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), l, r))
    return {(lang, i + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top])}


def test_phrases_by_brute_force(spark, monkeypatch):
    """Small shards and few counters, so that tries meet and pairs share counters; odd rows, languages and white space."""
    rng = random.Random(8)
    words = ["the", "The", "Éa", "éa", "a", "b", "c d", "eee", "<x>"]
    rows = [(rng.choice(["en", "fr", None]), "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", "!"]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    rows += [("en", None), (None, ""), ("de", " \t"), ("en", "a"), ("en", "the a b"), ("en", "the a b")] + [("xx", "p q r s t u v")] * 12
    docs = spark.createDataFrame(rows, "lang string, text string").withColumn("f", F.lit(1)).repartition(3)
    monkeypatch.setattr(phrases, "SHARD", 3000)
    for top in (2000, 3):
        got = {tuple(r) for r in phrases.collocations(docs, min_count=10, top=top).collect()}
        assert got == brute_phrases(rows, 5, 10, top)
    assert phrases.collocations(docs.limit(0)).collect() == []


def test_phrase_scores_pass_64_bits(spark):
    a, n, l, r = 10**11 + 7, 10**13 + 9, 2 * 10**11, 3 * 10**11  # noqa: E741
    one = spark.createDataFrame([(a, n, l, r)], "a long, n long, l long, r long")
    assert one.select(phrases._score(*(F.col(c) for c in "anlr")).alias("s")).first().s == 1000 * a * n // (l * r)


def brute_variants(words):
    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = {}, {}
    for w, n in words.items():
        beside = sorted((-words[x], x) for x in words if x != w and near(w, x))
        if beside and -beside[0][0] >= 5 * n:
            form[w] = beside[0][1]
        out[w] = (n, len(beside))
    for w, (n, count) in out.items():
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, n, count, words[form[w]] if w in form else None)
    return out


def test_spelling_of_the_tables(spark):
    counts = Counter()
    lower = str.maketrans(spelling.UPPER, spelling.UPPER.lower())
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r.text):
            w = w.translate(lower)
            h = zlib.crc32(f"{r.doc_id}:{w}".encode())
            counts[w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.QUERIES["op13_spelling"](spark, SMALL).collect()}
    assert got == brute_variants(words)


def test_spelling_of_edits(spark):
    """Words with every kind of edit at every place, long chains, ties, accents, and a short word that isn't one."""
    rng = random.Random(3)
    words = {}
    for base in ("absolut", "élégante", "zzzzzzz", "mississippi", "Éaÿbcdef"):
        words[base] = 20_000
        for _ in range(60):
            i, c = rng.randrange(len(base) + 1), rng.choice("abzéÿ")
            words[rng.choice([base[:i] + c + base[i:], base[:i] + base[i + 1 :], base[:i] + c + base[i + 1 :]])] = rng.choice([5, 30, 30, 200])
    words |= {"chaina" + "x" * i: 5 ** (8 - i) for i in range(7)}
    words = {w: n for w, n in words.items() if len(w) >= 6}
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(spark.createDataFrame(sorted(words.items()), "word string, n long")).collect()}
    assert got == brute_variants(words)
    assert got["chainaxxxxxx"][1] == "chaina"


def test_words_of_odd_texts(spark):
    rows = [(1, "Straße STRASSE ÀÉÎÕÜß"), (None, "Straße"), (1, None), (2, ""), (3, "abcde"), (3, "İabcdef \u212Aabcdef")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("x")).withColumn("n", F.lit(0))
    got = {r.word: r.n for r in spelling.counted_words(docs, min_count=2).collect()}
    assert got == {"straße": 4, "strasse": 2, "ÀÉÎÕÜß": 2, "abcdef": 4}
    assert spelling.variants(spelling.counted_words(docs.limit(0))).collect() == []


def test_a_step_of_the_fold_copies_one_array():
    path = public_tokenizers.path(bytepairs.VOCABULARY)
    made = str(bytepairs.literal_ranks(path, lambda rank: bytepairs.folded(F.col("word"), path, rank)))
    assert made.count("slice(") == 2 and made.count("array_min(") == 1


def test_spelling_sends_no_words_through_the_driver(spark, tmp_path):
    """Words take few bytes as Parquet, but twelve keys each: none of the joins may take them for small."""
    spark.createDataFrame([(f"{x}spelling", 9) for x in "abcdef"], "word string, n long").write.parquet(str(tmp_path / "w"))
    words = spark.read.parquet(str(tmp_path / "w"))
    for df in (spelling.near_words(words), spelling.variants(words)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert spelling.near_words(words).count() == 30
