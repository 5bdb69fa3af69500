import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quire.llm import html, mixing, packing, passages, quality, queries, sharding, simhash, tokens, toxicity, vafile
from tests.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, size long"


def docs_of(spark, texts, sources=None):
    """Documents with columns whose names clash with those of the operators."""
    sources = sources or ["s"] * len(texts)
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "k", 1, 2) for i, (t, s) in enumerate(zip(texts, sources))], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefg", k=5)) for _ in range(n))


EDGE = [None, "", " \n\t ", "one", "one two three", "x" * 30000, "a b " * 4000, "İ é 日本 \U0001f600", "<|endoftext|> it's fine", "same text here now", "same text here now"]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, same, name):
    same(queries.QUERIES[name](spark, SMALL), queries.ORACLE_SQL[name])


def brute_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    counts = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g, 42)
        counts.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(grams))


def brute_components(fps):
    part = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 4 and part[i] != part[j]:
                    part[i] = part[j] = min(part[i], part[j])
                    changed = True
    return part


def test_simhash(spark):
    rng = random.Random(3)
    base = [prose(rng, 120) for _ in range(12)]
    texts = EDGE + base + [b + " more" for b in base] + [base[0]] * 20
    got = {r.doc_id: r for r in simhash.simhash_components(docs_of(spark, texts)).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [got[i].fp % 2**64 for i in range(len(texts))] == fps
    assert [got[i].component_id for i in range(len(texts))] == brute_components(fps)


def test_keep_one_never_drops_a_component(spark):
    rng = random.Random(21)
    a, b, c, d, e, f = (prose(rng, 120) for _ in range(6))
    rows = [(None, a), (None, b), (None, b), (None, c), (1, c), (2, d), (2, e), (2, e), (3, e), (4, d), (5, f), (5, f)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in simhash.keep_one(docs).collect()]
    assert Counter(got) == Counter([(None, a), (None, b), (1, c), (2, d), (2, e), (5, f)])


def test_hot_keys_are_dealt_and_joined_whole(spark):
    rng = random.Random(4)
    fps = {0}
    at = 0
    while len(fps) < 300:  # a walk of close fingerprints
        at ^= 1 << rng.randrange(20) | 1 << rng.randrange(20)
        fps.add(at)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    edges = simhash.links(df, block=16).collect()
    more = simhash.links(df, block=16, bands=7).collect()  # keys as for billions of fingerprints
    assert 0 < len(edges)  # a forest over each group: its edges need not be links themselves, what they connect counts
    part = {f: f for f in fps}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    order = sorted(fps)
    for found in (edges, more):
        part.update({f: f for f in fps})
        for r in found:
            part[max(root(r.u), root(r.v))] = min(root(r.u), root(r.v))
        assert [root(f) for f in order] == [order[i] for i in brute_components(order)]


def test_bands_select_more_as_fingerprints_grow():
    assert [simhash.bands_for(n) for n in (0, 10**5, 10**7, 10**10, 10**13)] == [5, 5, 6, 7, 8]
    for bands in (5, 6, 7, 8):
        masks = simhash._masks(bands, 4)
        rng = random.Random(bands)
        for _ in range(200):
            flipped = sum(1 << b for b in rng.sample(range(64), 4))
            agreed = [m for m in masks if not m & flipped]
            assert agreed and all(any(not o & flipped for o in simhash._other_masks(m, 4)) for m in agreed)


def test_quality_of_edge_texts(spark):
    got = quality.quality(docs_of(spark, EDGE)).orderBy("doc_id").collect()
    assert [r.n_words for r in got] == [len((t or "").encode().split()) for t in EDGE]
    assert not any(r.kept for r in got)
    fine = prose(random.Random(1), 80)
    assert quality.quality(docs_of(spark, [fine])).first().kept
    assert quality.quality(docs_of(spark, [fine]).limit(0)).count() == 0


def test_vectors_of_every_kind(spark):
    rng = random.Random(5)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 500)]  # ties
    rows += [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (503, [float("inf")] * 8), (None, [1.0] * 8), (600, [1.0]), (700, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vafile.top_k(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    ok = {i: np.pad(np.floor(1024 * np.array(v, float)), (0, 8 - len(v))).astype(int) for i, v in rows if i is not None and (i < 500 or i >= 600)}
    for q in (i for i in ok if i % 100 == 0):
        best = sorted((-int(ok[q] @ v), i) for i, v in ok.items() if i != q)[:10]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert vafile.top_k(df.limit(0), df.limit(0)).count() == 0
    assert vafile.top_k(df.limit(2), df.limit(1)).count() == 1


def test_shards(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), (F.col("id") % 90 + 16).alias("n"))
    got = sharding.shard(rows, "k", F.col("n")).toPandas()
    sizes = got.groupby("shard")["n"].sum()
    assert len(got) == 20000 and len(sizes) == 40 and sizes.max() - sizes.min() < 0.02 * sizes.mean()
    assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert all(a <= b for a, b in zip(got.groupby("shard")["k"].max(), got.groupby("shard")["k"].min()[1:]))
    assert sharding.shard(rows.limit(0), "k", F.col("n")).count() == 0
    few = sharding.shard(spark.createDataFrame([(None, 5), (1, None)], "k long, n long"), "k", F.col("n")).collect()
    assert len(few) == 2


def test_mix(spark):
    rng = random.Random(6)
    texts = EDGE + [prose(rng, rng.randint(1, 60)) for _ in range(600)]
    sources = [rng.choice(["a", "a", "a", "b", "c", None, "d"]) for _ in texts]
    got = mixing.mix(docs_of(spark, texts, sources)).toPandas()
    assert len(got) == len(texts) and (got["_taken"] <= 3 * got["_size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["_taken"].sum() - g["_target"].iloc[0]) <= g["_size"].max()
    assert got.groupby("source", dropna=False)["_target"].first().sum() == pytest.approx(got["_size"].sum())
    order = mixing.training_order(mixing.mix(docs_of(spark, texts, sources)))
    assert order.count() == got["_copies"].sum() and order.agg(F.min("_position"), F.max("_position")).first()[1] <= 1
    assert mixing.mix(docs_of(spark, [])).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(7)
    texts = EDGE + [prose(rng, rng.randint(1, 400)) for _ in range(150)]
    packed = packing.best_fit_pack(docs_of(spark, texts), with_ids=True)
    rows = packed.collect()
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    by_doc, by_bin = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length <= 4 * 2048
        by_doc[r.doc_id].append((r.piece, r.start, bytes(r.ids)))
        by_bin[r.sequence_id].append((r.offset, r.length))
    for i, text in enumerate(texts):
        ids = np.array([*encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert b"".join(x[2] for x in sorted(by_doc[i])) == ids
    for places in by_bin.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    assert len(by_bin) <= 1.02 * sum(r.length for r in rows) / 2048 + 2
    whole = {r.sequence_id: len(r.ids) // 4 for r in packing.sequences(packed).collect()}
    assert whole == {k: sum(n for _, n in v) for k, v in by_bin.items()}
    assert packing.best_fit_pack(docs_of(spark, [])).count() == 0


def test_plan_places_every_piece():
    rng = random.Random(8)
    for _ in range(4):
        counts = Counter(rng.choice([rng.randint(1, 2048), rng.randint(500, 1100)]) for _ in range(rng.choice([3, 2000])))
        rows, bins = packing.plan(dict(counts))
        used = Counter()
        for length, _, n, first, _ in rows:
            used[length] += n
            assert first + n <= bins
        assert used == counts


PAGE = '<!DOCTYPE html><html><head><title>T</title></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies</div>{}<div class="comments"><p>First! I like this article very much indeed.</p></div><form><p>Send</p></form><footer>&copy; x</footer></body></html>'


def test_html(spark):
    article = "<article><h1>Title</h1><p>Fish &amp; chips,<br>a  long line of text.<p>Second <b>bold</b> part</p><script>var x='<p>no</p>'</script><aside>Related</aside></article>"
    pages = [(1, "http://a.org/1", PAGE.format(article)), (2, "http://a.org/2", PAGE.format(article.replace("Title", "Other"))), (3, None, None), (4, "bad url", "plain text only"), (5, "http://b.org", PAGE.format('<div class="post-12">' + "<p>Words in a plain container.</p>" * 3 + "</div>")), (6, "http://a.org/3", "<article><p>cut off &am")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r._text for r in html.extract(df).collect()}
    assert got[1] == "Title\nFish & chips, a long line of text.\nSecond bold part"
    assert got[3] == "" and got[4] == "plain text only" and got[6] == "cut off &am"
    assert got[5] == "\n".join(["Words in a plain container."] * 3)
    assert html.extract(df.limit(0)).count() == 0


def test_passages(spark):
    rng = random.Random(9)
    shared, near = prose(rng, 70).split(), prose(rng, 200).split()
    edited = list(near)
    edited[100] = "changed"
    line = prose(rng, 9).split()
    texts = EDGE + [" ".join(prose(rng, rng.randint(0, 200)).split() + x + prose(rng, 30).split()) for x in [shared] * 30 + [near, edited] + [line] * 60]
    first = len(EDGE)
    got = passages.repeated_passages(docs_of(spark, texts)).collect()
    found = defaultdict(int)
    for r in got:
        assert r.other_id < r.doc_id and r.n_words >= 50
        found[r.doc_id] = max(found[r.doc_id], r.n_words)
    assert set(found) == {*range(first + 1, first + 30), first + 31}
    assert all(found[i] >= 70 for i in range(first + 1, first + 30)) and found[first + 31] >= 200
    cut = {r.doc_id: r.text for r in passages.cut_repeats(docs_of(spark, texts)).collect()}
    assert cut[first] == texts[first] and " ".join(shared) not in cut[first + 1] and len(cut) == len(texts)
    assert passages.repeated_passages(docs_of(spark, [])).count() == 0


def test_html_keeps_all_but_noise(spark):
    long = "<p>" + "A long running text. " * 40 + "</p>"
    nested = f'<article><h1>Head</h1><p>Lead</p><div class="body">{long}</div><p>End</p></article>'
    sections = f'<main><section class="a">{long}</section><section class="b"><p>Other part</p></section></main>'
    minority = f'<article><p>Teaser</p></article><div class="story">{long}<p>More of it</p></div>'
    loose = f"<article>{long}</article><div><p>Stray words of the template</p></div>"
    links = '<ul><li><a href="/1">First entry</a></li><li><a href="/2">Second entry</a></li></ul>'
    one = f"<article>{long}</article>"
    bodies = [nested, sections, minority, links, loose, *[one] * 12]
    df = spark.createDataFrame([(i, "http://c.org/", PAGE.format(x)) for i, x in enumerate(bodies)], "page_id long, url string, html string")
    got = {r.page_id: r._text.split("\n") for r in html.extract(df).collect()}
    text = ("A long running text. " * 40).strip()
    assert got[0] == ["Head", "Lead", text, "End"] and got[1] == [text, "Other part"]
    assert got[2] == ["Teaser", text, "More of it"] and got[3] == ["First entry", "Second entry"]
    assert all(got[i] == [text] for i in range(4, 17))


def edited(rng, words, inserted, deleted):
    out = list(words)
    for _ in range(inserted):
        out.insert(rng.randrange(10, len(out) - 10), "".join(rng.choices("hijk", k=6)))
    for _ in range(deleted):
        del out[rng.randrange(10, len(out) - 10)]
    return out


def test_passages_with_insertions_and_deletions(spark):
    rng = random.Random(19)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, similar = [], []
    while len(texts) < 240:
        a = prose(rng, rng.randint(54, 80)).split()
        b = edited(rng, a, *rng.choice([(1, 0), (0, 1), (1, 1)]))
        x, y = grams(a), grams(b)
        if 0.8 <= len(x & y) / len(x | y) <= 0.9 and len(b) >= 50:
            similar.append(len(texts) + 1)
            texts += [" ".join(prose(rng, rng.randint(20, 90)).split() + w + prose(rng, 40).split()) for w in (a, b)]
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    assert sum((i, i - 1) in got for i in similar) >= 0.97 * len(similar)
    assert all(i - j == 1 and i % 2 for i, j in got)


def test_every_copy_and_partner_of_a_passage(spark):
    rng = random.Random(20)
    whole, twice = prose(rng, 50).split(), prose(rng, 55).split()
    short = [" ".join(prose(rng, 30).split() + whole[i % 4 : i % 4 + 46] + prose(rng, 30).split()) for i in range(120)]
    texts = [" ".join(prose(rng, 20).split() + whole), *short, " ".join(whole + prose(rng, 20).split())]
    texts += [" ".join(twice), " ".join(twice + prose(rng, 70).split() + twice + prose(rng, 70).split() + twice)]
    docs = docs_of(spark, texts)
    got = {(r.doc_id, r.start_word, r.other_id) for r in passages.repeated_passages(docs).collect()}
    assert got == {(121, 0, 0), (123, 0, 122), (123, 125, 122), (123, 250, 122)}
    cut = {r.doc_id: r.text for r in passages.cut_repeats(docs).collect()}
    assert len(cut[123].split()) == 140 and len(cut[121].split()) == 20


def test_compact_windows_hold_each_subsequence_once():
    values = np.random.default_rng(1).permutation(120).astype(np.uint64)
    windows = passages.compact_windows(values, 10).T.tolist()
    for a in range(0, 111):
        inside = [w for w in windows if w[0] <= a and a + 10 <= w[2] and a <= w[1] < a + 10]
        assert len(inside) == 1 and inside[0][1] == a + int(values[a : a + 10].argmin())


def test_windows_and_hashes_of_many_texts_at_once():
    """Batches give what each text gives alone, whatever lies beside it."""
    rng = random.Random(9)
    texts = [prose(rng, rng.choice([0, 1, 3, 4, 5, 49, 50, 51, 200])) + rng.choice(["", " ", "\n\t"]) for _ in range(60)]
    texts += ["", " ", None, "A" * 3000, "same word " * 60, "É é  É\x0bx"]
    words, bounds = passages.hashed(pa.array(["cut off", *texts])[1:])
    doc, keys, spans = passages.anchors(words, bounds)
    _, often = np.unique(keys, return_counts=True)
    frequent = np.unique(keys)[often > 1]
    finer = passages.finer(words, bounds, frequent)
    names = {}
    for n, text in enumerate(texts):
        own = (text or "").encode().lower().split()
        alone, ends = passages.hashed(pa.array([text], pa.string()))
        assert alone.tolist() == words[bounds[n] : bounds[n + 1]].tolist() and len(alone) == len(own)
        assert all(names.setdefault(w, h) == h for w, h in zip(own, alone.tolist()))
        _, k, s = passages.anchors(alone, ends)
        assert k.tolist() == keys[doc == n].tolist() and s.tolist() == spans[doc == n].tolist()
        assert (len(k) > 0) == (len(own) >= 50)
        for (d, k, s), (_, k1, s1) in zip(finer, passages.finer(alone, ends, frequent)):
            assert k1.tolist() == k[d == n].tolist() and s1.tolist() == s[d == n].tolist()
    assert len(set(names.values())) == len(names)


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(10)
    bad = ["zorkish", "blatling", "grumfed"]
    texts, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split()
        if toxic := i % 6 == 0:
            words[rng.randrange(60)] = rng.choice(bad) + rng.choice(["", "er", "s"])
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    docs = docs_of(spark, texts + EDGE)
    labelled = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    chain = toxicity.fit_chain(docs, labelled.where("doc_id < 400"))
    got = {r.doc_id: r.toxic for r in toxicity.score(docs, chain).collect()}
    held = range(400, 600)
    assert sum(got[i] == (i % 6 == 0) for i in held) >= 0.98 * len(held) and not any(got[i] for i in range(600, 600 + len(EDGE)))
    none = toxicity.score(docs, toxicity.fit_chain(docs, labelled.limit(0)))
    assert none.where("toxic").count() == 0 and none.count() == len(texts) + len(EDGE)
    assert toxicity.keep_clean(docs.limit(0), labelled).count() == 0


def test_token_counts(spark):
    texts = [t for t in EDGE] + ["don't we'LL  \n\n  x", "aaaaaaaaaaaa", "a<|endoftext|>b"]
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    got = {r.doc_id: r for r in tokens.token_counts(docs_of(spark, texts)).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(encode(t or "", add_special_tokens=False).ids) for t in texts]
    assert [got[i].n_bytes for i in range(len(texts))] == [len((t or "").encode()) for t in texts]
    assert tokens.token_counts(docs_of(spark, [])).count() == 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL).cache()
        assert out.columns == docs.columns and 0 < out.count()
        assert name == "mixing" or out.count() <= docs.count()
        docs = out
    packed = corpus_pipeline.run(spark, SMALL)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES])
def test_stages_take_empty_and_odd_tables(spark, stage):
    docs = docs_of(spark, EDGE).select("doc_id", "text", "lang", "source", "n_chars")
    assert stage(spark, docs.limit(0), SMALL).count() == 0
    got = stage(spark, docs, SMALL)
    ids = Counter(r.doc_id for r in got.select("doc_id").collect())
    if stage is corpus_pipeline.drop_near_copies:  # texts 0 to 2 have no words, 9 and 10 are equal
        assert set(ids) == {0, *range(3, 10)} and max(ids.values()) == 1
    elif stage is corpus_pipeline.mix_sources:
        assert set(ids) <= set(range(3, 11)) and max(ids.values()) <= 3
    else:
        assert set(ids) == set(range(len(EDGE)))


def brute_passages(texts):
    """For each text, the words of it that lie in 50 words that an earlier text has as well."""
    seen, out = {}, []
    for n, t in enumerate(texts):
        w = (t or "").lower().split()
        out.append({k for i in range(len(w) - 49) if seen.get(" ".join(w[i : i + 50]), n) < n for k in range(i, i + 50)})
        for i in range(len(w) - 49):
            seen.setdefault(" ".join(w[i : i + 50]), n)
    return out


def test_passages_equal_brute_force_on_exact_repeats(spark):
    rng = random.Random(23)
    blocks = [prose(rng, rng.choice([30, 49, 50, 51, 80])).split() for _ in range(12)]
    line = prose(rng, 6).split()
    texts = []
    for _ in range(120):
        parts = [rng.choice([rng.choice(blocks), prose(rng, rng.randint(1, 30)).split(), line * rng.randint(1, 4)]) for _ in range(rng.randint(1, 6))]
        texts.append(" ".join(x for p in parts for x in p))
    found = defaultdict(set)
    for r in passages.repeated_passages(docs_of(spark, texts)).collect():
        assert r.other_id < r.doc_id
        found[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    for n, words in enumerate(brute_passages(texts)):
        assert words <= found[n], n


@pytest.mark.parametrize("words", [50, 60, 80, 120])
def test_recall_of_edited_passages(spark, words):
    """A word put in, taken out or changed in passages that keep a similarity of 0.8."""
    rng = random.Random(words)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, planted = [], []
    while len(planted) < 150:
        a = prose(rng, words).split()
        b = list(a)
        at, kind = rng.randrange(5, words - 5), len(planted) % 3  # passages begin and end with five common words
        b[at : at + (kind != 0)] = [] if kind == 1 else ["changed"]
        if len(b) < 50 or len(grams(a) & grams(b)) < 0.8 * len(grams(a) | grams(b)):
            if words == 50 and kind == 1:  # one word less is too short
                planted.append(None)
            continue
        planted.append(len(texts) + 1)
        texts += [" ".join(prose(rng, rng.randint(10, 60)).split() + w + prose(rng, 30).split()) for w in (a, b)]
    got = {(r.doc_id, r.other_id) for r in passages.repeated_passages(docs_of(spark, texts)).collect()}
    real = [i for i in planted if i is not None]
    assert sum((i, i - 1) in got for i in real) >= 0.95 * len(real)


@pytest.mark.parametrize("words,copies,edits", [(60, 30, 1), (60, 60, 1), (70, 60, 1), (60, 200, 1), (60, 200, 2), (120, 200, 2)])
def test_recall_of_edited_passages_under_frequent_signatures(spark, words, copies, edits):
    """Copies of one passage, each with edits of its own: what is 0.8 alike with an earlier one is found, whatever it is tied to."""
    rng = random.Random(words * copies + edits)
    fresh = lambda n: ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    base, variants = fresh(words), []
    for _ in range(copies):
        v = list(base)
        for _ in range(edits):
            at, kind = rng.randrange(5, len(v) - 5), rng.randrange(3)
            v[at : at + (kind != 0)] = [] if kind == 1 else fresh(1)
        variants.append(v)
    texts = [" ".join(fresh(rng.randint(20, 60)) + v + fresh(30)) for v in variants]
    alike = lambda x, y: len(x & y) >= 0.8 * len(x | y)
    sets = [grams(v) for v in variants]
    want = {i for i in range(copies) if len(variants[i]) >= 50 and any(alike(sets[i], sets[j]) for j in range(i))}
    rows = passages.repeated_passages(docs_of(spark, texts)).collect()
    assert len(want & {r.doc_id for r in rows}) >= 0.95 * len(want) > 0
    for r in rows:
        a, b = texts[r.doc_id].split(), texts[r.other_id].split()
        x, y = grams(a[r.start_word : r.start_word + r.n_words]), grams(b[r.other_start : r.other_start + r.other_words])
        assert r.other_id < r.doc_id and r.n_words >= 50 and alike(x, y)


def test_common_lines_seek_no_partners():
    """Grams of a line that many texts share don't suffice; those of two runs beside an edit do."""
    line, halves = np.arange(0, 9), np.concatenate([np.arange(0, 7), np.arange(26, 33)])
    assert not passages.dense(line, 50).any() and passages.dense(halves, 50).all()
    assert passages.dense(np.concatenate([line, line + 500]), 50).sum() == 0
    spans = [10 << 32 | 100]  # words 10 to 104
    assert passages.uncovered(spans, [], 50) == [0 << 32 | 129]
    assert passages.uncovered(spans, [(0, 20), (40, 60)], 50) == [] and passages.uncovered(spans, [(60, 200)], 50) == [0 << 32 | 85]
    assert passages.uncovered(spans, [(0, 50), (40, 20), (90, 5)], 50) == [35 << 32 | 115]


def test_pairs_without_a_passage_are_not_compared():
    """Of pairs of all degrees of similarity, in parts and ranges as they are sent, none with a passage is left out, and most others are."""
    rng = random.Random(31)
    rows, expected = [], []
    for n in range(200):
        a, b = prose(rng, rng.randint(3, 60)).split(), prose(rng, rng.randint(3, 60)).split()
        same = prose(rng, rng.randint(30, 110)).split()
        a, b = a + same, b + edited(rng, same, n % 3, n % 4) + ["and"] * (n % 5) if n % 2 else b
        a, b = (passages.hashed(pa.array([" ".join(x)]))[0] for x in (a, b))
        cut_at = rng.randrange(len(a)) if n % 7 == 0 else 0
        parts, ranges = [a[:cut_at], a[cut_at:]][not cut_at :], [0, len(b) // 2, len(b) // 2, len(b) + 9] if n % 11 == 0 else [0, len(b) + 9]
        rows.append(([p.tobytes() for p in parts], ranges, b.tobytes()))
        whole = passages._spread(parts, [0] * len(parts), 0, 26)[0], passages._spread([b[x:y] for x, y in zip(ranges[::2], ranges[1::2])], ranges[::2], 1, 26)[0]
        expected.append(bool(passages.shared_passages(*whole)))
    kinds = (pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary())
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["parts", "ranges", "words"])
    for lo, hi in ((0, 200), (37, 140), (5, 6)):
        got = passages.comparable(batch.slice(lo, hi - lo), 50, 0.8)
        assert all(g or not e for g, e in zip(got, expected[lo:hi]))
    assert 20 < sum(expected) < sum(passages.comparable(batch, 50, 0.8)) < sum(expected) + 30
    assert not passages.comparable(batch.slice(0, 0), 50, 0.8).any()


def test_a_task_keeps_one_python_worker_for_grams(spark):
    docs = docs_of(spark, [" ".join(map(str, range(80)))])
    stretches = spark.createDataFrame([(0, [0 << 32 | 80], [0 << 32 | 80])], "doc long, seeks array<long>, offers array<long>")
    kept = passages._grams_of(docs.select("doc_id", "text"), stretches, 50)
    assert kept._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    (row,) = kept.collect()
    assert np.frombuffer(row.words, np.uint32).tolist() == passages.hashed(pa.array([" ".join(map(str, range(80)))]))[0].tolist() and len(row.grams) > 10


def test_passages_cover_the_same_words():
    rng = random.Random(1)
    covered = lambda found: {k for s, w, *_ in found for k in range(s, s + w)}
    for _ in range(2000):
        some = [(rng.randint(0, 60), rng.randint(5, 20), 0, 0) for _ in range(rng.randint(0, 12))]
        assert covered(passages._cover(some)) == covered(some)


NOISE_PAGES = {
    "wrapper": ('<div class="site no-sidebar"><h1>Head</h1><p>{0}</p></div>', ["Head", "{0}"]),
    "lead_and_tail": ('<article><h1>Head</h1><div class="body"><p>{0}</p></div><div class="tail"><p>The end of it</p></div></article>', ["Head", "{0}", "The end of it"]),
    "telling_names": ('<article><p>{0}</p><div class="social-history"><p>Smoked once</p></div><p class="notice-period">Three months</p><p>{0}</p></article>', ["{0}", "Smoked once", "Three months", "{0}"]),
    "ads_inside": ('<article><p>{0}</p><div class="ad-box">Buy now</div><p>{0}</p><section class="comments"><p>First!</p><p>Second</p></section></article>', ["{0}", "{0}"]),
    "long_comments": ('<article><h1>Head</h1><p>Short text</p></article><div id="comments"><p>{0}</p></div>', ["Head", "Short text"]),
    "links": ('<div class="content"><p>{0}</p><div class="related-links"><a href="/a">One</a> <a href="/b">Two</a></div><p>More</p></div>', ["{0}", "More"]),
    "roles": ('<div><div role="navigation">Here and there</div><p>{0}</p><div role="contentinfo">Imprint</div></div>', ["{0}"]),
}


def test_html_against_hand_marked_pages(spark):
    text = ("A long running text of the page. " * 12).strip()
    rows = [(n, f"http://{name}.org/x", f"<html><body>{source.format(text)}</body></html>") for n, (name, (source, _)) in enumerate(NOISE_PAGES.items())]
    got = {r.page_id: r._text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for n, (name, (_, want)) in enumerate(NOISE_PAGES.items()):
        assert got[n].split("\n") == [w.format(text) for w in want], name


def test_html_drops_what_a_host_repeats_and_joins_both_ways(spark):
    rng = random.Random(31)
    bodies = [" ".join(prose(rng, 60).split()) for _ in range(8)]
    rows = [(n, f"http://h{n % 2}.org/{n}", f"<body><div>Subscribe for more</div><div><p>{b}</p></div><p>All rights kept</p></body>") for n, b in enumerate(bodies)]
    df = spark.createDataFrame([(*r, "p") for r in rows], "page_id long, url string, html string, paths string")
    few, many = html.extract(df), html.extract(df, broadcast_hosts=0)
    assert few.columns == many.columns == ["page_id", "url", "html", "paths", "_text"]
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert {r.page_id: r._text for r in few.collect()} == dict(enumerate(bodies))


def test_vectors_beyond_any_clip(spark):
    rows = [(100, [40000.0]), (101, [50000.0]), (102, [39000.0]), (200, [1e200, 1.0]), (300, [1.0, 2.0]), (300, [2.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in vafile.top_k(df, df.where("vec_id % 100 = 0")).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert sorted(got[100])[1:3] == [(2, 101, 2_097_152_000_000_000), (3, 102, 1_635_778_560_000_000)]
    assert sorted(got[100])[0] == (1, 200, 2**63 - 1)
    assert Counter(rank for rank, *_ in got[300]) == {1: 2, 2: 2, 3: 2, 4: 2}  # two rows of an id are two queries
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) * 10 ** rng.randint(0, 6) for _ in range(5)]) for i in range(5000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    got = defaultdict(list)
    for r in vafile.top_k(df, df.where("vec_id % 1000 = 0"), k=3).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    for q, v in whole[::1000]:
        best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:3]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]


def test_shards_of_odd_keys(spark):
    even = spark.range(8000).select((F.col("id") * 2).alias("k"), F.lit(20).alias("n"))
    odd = spark.createDataFrame([(None, 5), (10**17, 7), (-(10**18), 7)], "k long, n int")
    hot = spark.range(4000).select(F.lit(7777).cast("long").alias("k"), F.lit(3).alias("n"))
    rows = even.unionByName(odd).unionByName(hot).withColumns({"_c": F.lit(1), "_key": F.lit("x"), "slot": F.lit(9)})
    made = sharding.shard(rows, "k", F.col("n"))
    assert made.columns == ["k", "n", "_c", "_key", "shard", "slot"]
    got = made.toPandas().sort_values(["shard", "slot"])
    assert all(list(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got["k"].fillna(-(2**63)).is_monotonic_increasing and len(got) == 12003


def test_rules_are_ordered_and_columns_replaced(spark):
    fine = prose(random.Random(1), 80)
    docs = docs_of(spark, [fine] * 50).withColumns({"n_words": F.lit("x"), "kept": F.lit("y"), "_again": F.lit(1)})
    got = quality.quality(docs)
    assert got.columns.count("n_words") == got.columns.count("kept") == 1 and got.where("kept").count() == 50
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("all", F.col("n_words") > 0)]
    assert [r.name for r in quality.order_by_yield(quality.base_counts(docs_of(spark, [fine] * 50)), rules)] == ["all", "never"]


def test_folds_choose_their_own_features():
    seen = []

    def chosen(f):
        seen.append(f)
        return np.array([True, False]), np.array([False, False])

    x = toxicity.Rows(np.arange(40), np.arange(40) % 2, 40, 2)
    chain = toxicity.Chain(toxicity.CATEGORIES)
    p = chain.fit(x, (np.arange(40) % 2 == 0).astype(float), np.arange(40) % 5, chosen)
    assert seen == [None, 0, 1, 2, 3, 4] and p.shape == (40, 3) and (p[::2, 2] > p[1::2, 2]).all()


CONTRACTS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_quality": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3_vafile": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op4_shards": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op5_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_html": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_mixing": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op10_tokens": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.parametrize("name", sorted(CONTRACTS))
def test_contract_columns(spark, name):
    out = queries.QUERIES[name](spark, SMALL)
    assert CONTRACTS[name].items() <= dict(out.dtypes).items()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    rows = out.collect()
    if name == "op1_simhash":
        assert all(r.fingerprint == f"{brute_fingerprint(docs[r.doc_id]):016x}" for r in rows) and len(rows) == len(docs)
    elif name == "op4_shards":
        assert all(r.size == len(docs[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode()) and r.law == "bytes" and r.grown_shard is None for r in rows)
    elif name == "op6_html":
        assert all(len(r.text) == r.n_chars for r in rows)
    elif name == "op10_tokens":
        assert all(r.over_limit == (r.n_tokens > 512) for r in rows)


def test_words_of_documents_without_pairs_are_not_hashed(spark):
    """Ids that a join would drop go before; none that it needs does, whatever its sign."""
    ids = [*range(-3000, 3000, 3), 2**62, -(2**63)]
    docs = spark.createDataFrame([(i, "a text") for i in [*range(-3000, 3000), 2**62, -(2**63)]], "doc_id long, text string")
    got = [r.doc_id for r in passages._among(docs, spark.createDataFrame([(i,) for i in ids], "doc long")).collect()]
    assert set(ids) <= set(got) and len(got) == len(set(got)) < len(ids) + 10
    assert passages._among(docs, spark.createDataFrame([], "doc long")).count() == 0


def test_what_is_covered_needs_no_look(monkeypatch):
    """Rows of runs whose words lie in a passage found before aren't looked at again."""
    looked = []
    stretches = passages._stretches
    monkeypatch.setattr(passages, "_stretches", lambda path, *more: looked.append(path) or stretches(path, *more))
    one = np.arange(1, 121, dtype=np.uint32)
    one[60] = 500
    two = np.arange(1, 121, dtype=np.uint32)
    both = np.concatenate([two, two, two])
    assert [r[:2] for r in passages.shared_passages(one, both)] == [(0, 120)]
    assert len(looked) == 1
