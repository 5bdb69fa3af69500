"""Operator 12: phrase collocations from depth-limited count tries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

DEPTH, MIN_COUNT, TOP = 5, 100, 2000
#: What ends a piece, and what separates words within one.
BREAKS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Counters of hashed word pairs, and how many of them are summed as one row. More counters prune larger corpora better.
PAIR_BITS, ROW_BITS = 24, 14
#: Bytes of text whose words make one trie.
SHARD = 12 << 20
#: Parts of a language whose best phrases are found apart before they meet.
PARTS = 64


class Words:
    """The words of a table of (lang, text) as numbers, in order of language and word, with what follows what."""

    def __init__(self, rows: pa.Table) -> None:
        langs = rows.column(0).combine_chunks().cast(pa.large_string()).dictionary_encode()
        text = rows.column(1).cast(pa.large_binary()).combine_chunks()
        bounds = np.frombuffer(text.buffers()[1], np.int64, len(text) + 1, text.offset * 8)
        raw = text.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[bounds[0] : bounds[-1]] if raw else np.zeros(0, np.uint8)
        bounds = bounds - bounds[0]
        lower = np.arange(256, dtype=np.uint8)
        lower[65:91] += 32
        data = lower[data]
        kind = np.zeros(256, np.uint8)
        kind[list(BREAKS)], kind[list(BLANKS)] = 2, 1
        kind = kind[data]
        word = kind == 0
        # A word begins after a byte that belongs to none, and where a text begins.
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = bounds[:-1][np.diff(bounds) > 0]
        first[edges] = word[edges]
        starts = np.flatnonzero(first)
        # Where a word ends: before what belongs to none, before a text's beginning, and at the end.
        last = word.copy()
        last[:-1] &= ~word[1:]
        last[edges[edges > 0] - 1] = word[edges[edges > 0] - 1]
        offsets = np.append(0, np.cumsum(np.flatnonzero(last) + 1 - starts))
        letters = pa.py_buffer(data[word])
        del data, first, last, word
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), letters]).dictionary_encode()
        order = pc.sort_indices(words.dictionary).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words = words.dictionary.take(pa.array(order))
        self.langs = langs.dictionary
        of_text = np.searchsorted(bounds, starts, "right") - 1
        ids = np.asarray(words.indices, np.int64)
        self.word = rank[ids] if len(order) else ids
        self.lang = np.asarray(langs.indices, np.int64)[of_text] if len(starts) else ids
        # A word follows the one before it in a piece if there is neither a break nor a text's beginning between them.
        cuts = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.follows = np.append(False, (cuts[1:] == cuts[:-1]) & (of_text[1:] == of_text[:-1])) if len(starts) else np.zeros(0, bool)

    def pair_hashes(self) -> np.ndarray:
        """For each word the counter of the pair that it ends; it depends on nothing but the language and both words."""
        seed = np.array([xxhash.xxh64_intdigest(x.encode()) for x in self.langs.to_pylist()], np.uint64)
        own = np.array([xxhash.xxh64_intdigest(x) for x in self.words.to_pylist()], np.uint64)
        if not len(self.word):
            return np.zeros(0, np.int64)
        own = own[self.word]
        before = np.append(np.uint64(0), own[:-1])
        mixed = (before * np.uint64(0x9E3779B97F4A7C15) ^ own ^ seed[self.lang]) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)


def _shards(batches: Iterable[pa.RecordBatch], most: int = SHARD) -> Iterator[Words]:
    """The batches of (lang, text) in shards of about `most` bytes, however the batches are cut."""
    held, size = [], 0
    for batch in batches:
        step = max(1, batch.num_rows * most // max(1, batch.nbytes))
        for at in range(0, batch.num_rows, step):
            held.append(batch.slice(at, step))
            size += held[-1].nbytes
            if size >= most:
                yield Words(pa.Table.from_batches(held))
                held, size = [], 0
    if held:
        yield Words(pa.Table.from_batches(held))


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, counts): per shard and run of counters, the low bits of those that aren't zero and their counts."""
    for shard in _shards(batches):
        at, n = np.unique(shard.pair_hashes()[shard.follows], return_counts=True)
        cells, starts = np.unique(at >> ROW_BITS, return_index=True)
        low, n = (at & ((1 << ROW_BITS) - 1)).astype(np.uint16), n.astype(np.uint32)
        blobs = [a.tobytes() + b.tobytes() for a, b in zip(np.split(low, starts[1:]), np.split(n, starts[1:]))] if len(at) else []
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(blobs, pa.binary())], ["cell", "counts"])


def _frequent_cells(min_count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums the counters of whatever cells come here, 2^ROW_BITS each, and says which reach min_count."""
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for cell, blob in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(blob) // 6
                mine = sums.setdefault(cell, np.zeros(1 << ROW_BITS, np.int64))
                mine[np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob, np.uint32, n, 2 * n)
        found = [np.packbits(x >= min_count).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(found, pa.binary())], ["cell", "bits"])

    return run


def frequent_pairs(texts: DataFrame, min_count: int) -> np.ndarray:
    """A bit for each counter of hashed pairs: whether all pairs that share it occur min_count times together.

    No pair that is as frequent as that is missing; 2^PAIR_BITS bits come to the driver, whatever the corpus.
    """
    counted = texts.mapInArrow(_pair_counts, "cell long, counts binary").repartition("cell")
    bits = np.zeros((1 << (PAIR_BITS - ROW_BITS), (1 << ROW_BITS) // 8), np.uint8)
    for row in counted.mapInArrow(_frequent_cells(min_count), "cell long, bits binary").collect():
        bits[row.cell] = np.frombuffer(row.bits, np.uint8)
    return bits.reshape(-1)


def tries(texts: DataFrame, frequent: np.ndarray, depth: int = DEPTH) -> DataFrame:
    """(lang, phrase, depth, f): the nodes of a count trie for each shard of the texts (lang, text), in order within a level.

    A trie holds every word and the runs of up to `depth` words within a piece whose pairs may all be frequent. It is
    built level by level as arrays: a node is its parent's number and its last word's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            n_words = max(1, len(shard.words))
            h = shard.pair_hashes()
            alive = shard.follows & ((frequent[h >> 3] >> (7 - (h & 7)).astype(np.uint8)) & 1).astype(bool)
            key, at = shard.lang * n_words + shard.word, np.arange(len(h))
            for level in range(1, depth + 1):
                nodes, node, counts = np.unique(key, return_inverse=True, return_counts=True)
                last = shard.words.take(pa.array(nodes % n_words)).cast(pa.large_string())
                parent = pa.array(nodes // n_words)
                langs = shard.langs.take(parent) if level == 1 else langs.take(parent)
                phrases = last if level == 1 else pc.binary_join_element_wise(phrases.take(parent), last, pa.scalar(" ", pa.large_string()))
                for a in range(0, len(nodes), 50_000):
                    b = min(len(nodes), a + 50_000)
                    yield pa.RecordBatch.from_arrays([langs[a:b].cast(pa.string()), phrases[a:b].cast(pa.string()), pa.array([level] * (b - a), pa.int32()), pa.array(counts[a:b], pa.int64())], ["lang", "phrase", "depth", "f"])
                on = at + level < len(h)
                on[on] = alive[at[on] + level]
                at = at[on]
                if not len(at):
                    break
                key = node[on] * n_words + shard.word[at + level]

    return texts.mapInArrow(run, "lang string, phrase string, depth int, f long")


def counted_phrases(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, depth, f) of all runs of up to depth words that occur min_count times, and (lang, n) of all words.

    A null language is `und`, a null text has no words. The shards' tries are written, each level in order; then ranges
    of phrases, whose bounds a sample of the tries gives, merge them. A phrase has a row for each shard at most, so the
    ranges stay even whatever repeats.
    """
    lang, text = (F.coalesce(F.col(c), F.lit(d)) for c, d in ((lang_col, "und"), (text_col, "")))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    made = stored(tries(texts, frequent_pairs(texts, min_count), depth))
    merged = made.repartitionByRange("lang", "phrase").groupBy("lang", "phrase", "depth").agg(F.sum("f").alias("f"))
    total = made.where("depth = 1").groupBy("lang").agg(F.sum("f").alias("n"))
    return stored(merged.where(F.col("f") >= min_count)), total


def _linked(nodes: DataFrame, depth: int) -> list[DataFrame]:
    """For each depth from 1, (lang, phrase, f, parent, rest, lefts, rights): how often its first and its last words occur.

    lefts[k - 1] is that of the first k words, what the walk down the trie to the phrase has passed; rights[k - 1] that
    of what follows them, by k suffix links. A level reads both off the level before it.
    """
    none = F.array().cast("array<long>")
    levels = [nodes.where("depth = 1").select("lang", "phrase", "f", none.alias("lefts"), none.alias("rights"))]
    for d in range(2, depth + 1):
        here = nodes.where(F.col("depth") == d).select("lang", "phrase", "f", F.substring_index("phrase", " ", d - 1).alias("parent"), F.substring_index("phrase", " ", 1 - d).alias("rest"))
        up = levels[-1].select("lang", F.col("phrase").alias("parent"), F.array_append("lefts", F.col("f")).alias("lefts"))
        link = levels[-1].select("lang", F.col("phrase").alias("rest"), F.array_prepend("rights", F.col("f")).alias("rights"))
        levels.append(stored(here.join(up, ["lang", "parent"]).join(link, ["lang", "rest"])))
    return levels


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exact for up to 10^14 phrases and 10^16 words."""
    whole = lambda c, p: c.cast(f"decimal({p},0)")
    return F.call_function("div", F.lit(1000).cast("decimal(4,0)") * whole(a, 14) * whole(n, 16), whole(l, 14) * whole(r, 14))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", depth: int = DEPTH, min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to depth words by their weakest cut.

    Texts are lower-cased in A-Z, cut into pieces at BREAKS and into words at blanks; everything is counted in a
    language. a: how often the phrase occurs, at least min_count; l and r: how often the parts at its weakest cut occur;
    n: the language's words; score: floor(1000 * a * n / (l * r)). Phrases that occur only inside one and the same
    longer one are left out. Order: score, then a, then the phrase's bytes. Null languages are `und`, null texts empty;
    repeated rows count again; an empty table gives an empty result.
    """
    nodes, total = counted_phrases(docs, lang_col, text_col, depth, min_count)
    levels = _linked(nodes, depth)[1:]
    found = reduce(DataFrame.unionByName, levels)
    # A longer phrase that holds this one as often holds it with one more word, too, as often.
    longer = reduce(DataFrame.unionByName, [x.select("lang", F.explode(F.array("parent", "rest")).alias("phrase"), "f") for x in levels[1:]]) if depth > 2 else found.limit(0).select("lang", "phrase", "f")
    longer = longer.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    cuts = F.arrays_zip(F.col("lefts").alias("l"), F.col("rights").alias("r"))
    scores = F.transform(cuts, lambda c, k: F.struct(_score(F.col("f"), F.col("n"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
    df = found.join(longer, ["lang", "phrase"], "left").where(F.col("longest").isNull() | (F.col("longest") < F.col("f"))).join(total, "lang")
    df = df.select("lang", "phrase", F.col("f").alias("a"), "n", F.array_min(scores).alias("cut"))
    df = df.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    rank = lambda rows, *by: rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return rank(rank(df.withColumn("part", part), "lang", "part").drop("rank"), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH piece AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p
  FROM documents
), word AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM piece
), total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM word GROUP BY lang),
spread AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM word WHERE len(w) > 0),
f AS (
  SELECT lang, d, array_to_string(w[i:i + d - 1], ' ') AS phrase, count(*) AS f
  FROM spread, (SELECT unnest(range(1, 6)) AS d) WHERE i + d - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
), cut AS (
  SELECT f.lang, d, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, d)) AS k FROM f WHERE d > 1
), scored AS (
  SELECT c.lang, c.phrase, c.d, c.a, c.k, x.f AS l, y.f AS r, n, ((1000::HUGEINT * c.a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cut c JOIN total USING (lang)
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (
  SELECT * FROM best b WHERE NOT EXISTS (
    SELECT 1 FROM best o WHERE o.lang = b.lang AND o.d > b.d AND contains(' ' || o.phrase || ' ', ' ' || b.phrase || ' ') AND 100 * o.a >= 100 * b.a)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
) WHERE rank <= 2000
"""
