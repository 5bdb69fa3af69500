"""Operator 1: SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table
from .components import components

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
PIVOTS = 24
#: Evenly spread fingerprints that a key may have on average; with more of them in all, keys select more.
FEW = 128
#: Fingerprints of one key that a task compares at most with as many others.
BLOCK = 4096


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """The 64-bit SimHash of one text; 0 without words."""
    return int(_fingerprints([text], words)[0])


def _fingerprints(texts: list[str | None], words: int = SHINGLE_WORDS) -> np.ndarray:
    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for n, text in enumerate(texts):
        tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # both know ASCII only
        if not tokens:
            continue
        joined = b" ".join(tokens)
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        k = min(words, len(tokens))
        starts = np.concatenate(([0], ends[:-1] + 1))[: len(tokens) - k + 1].tolist()
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)
        out[n] = _majority(hashes)
    return out


_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray) -> np.uint64:
    """The bits set in more than half of the hashes; eight counters of a byte each are summed at a time."""
    cuts = np.arange(0, len(hashes), 255)
    bits = np.zeros(64, np.uint8)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, cuts)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        bits[shift::8] = 2 * counts > len(hashes)
    return np.packbits(bits, bitorder="little").view(np.uint64)[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): a row for each document; fp is the fingerprint as a signed long."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = _fingerprints(batch.column(1).to_pylist()).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    ids = F.col(id_col).cast("long").alias("doc_id")
    return docs.select(ids, F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _fingerprint_column(text_col: str) -> Column:
    @F.pandas_udf("long")
    def found(text):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(_fingerprints(text.tolist()).view(np.int64))

    return found(text_col)


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: the same pseudo-random ones in each task."""
    return np.random.default_rng(SEED).integers(0, 2**64, n, np.uint64)


def bands_for(n: int, max_bits: int = MAX_BITS) -> int:
    """The fewest bands whose keys (agreement on all but max_bits of them) have at most FEW of n fingerprints each."""
    return next((b for b in range(max_bits + 1, 2 * max_bits) if n >> (64 * (b - max_bits) // b) <= FEW), 2 * max_bits)


def _masks(bands: int, max_bits: int) -> list[int]:
    """The bits of each choice of bands - max_bits bands: two fingerprints within max_bits agree on all those of one."""
    edges = [64 * i // bands for i in range(bands + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(each, bands - max_bits)]


def _other_masks(mask: int, max_bits: int) -> list[int]:
    """The bits outside a mask in max_bits + 1 parts: two fingerprints that agree on the mask agree on one of them, too."""
    bits = [1 << i for i in range(64) if not mask >> i & 1]
    return [sum(bits[i :: max_bits + 1]) for i in range(max_bits + 1)]


def _literal(masks: list[int]) -> Column:
    return F.array(*(F.lit(m - (1 << 64) if m >> 63 else m) for m in masks))


def _keyed(fp: Column, masks: Column, *parts: Column) -> Column:
    """A key of the fingerprint's bits under each of the masks."""
    return F.transform(masks, lambda m, i: F.xxhash64(fp.bitwiseAND(m), i, *parts))


def _with_blocks(keyed: DataFrame, block: int) -> DataFrame:
    """keyed with `blocks`, the number of blocks of a key of more than `block` fingerprints; 1 for others."""
    hot = keyed.groupBy("key").count().where(F.col("count") > block)
    hot = hot.select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    return keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _forest(fps: np.ndarray, group: np.ndarray, max_bits: int) -> np.ndarray:
    """For each fingerprint, the index of the one it is tied to within its group.

    The pivot table holds each fingerprint's Hamming distance to every pivot. By the triangle inequality two
    fingerprints within max_bits differ by at most max_bits in each coordinate. In the order of the first coordinate
    a sweep ends where that alone exceeds it, the largest difference over the others discards most pairs left, and
    only the survivors are compared bit by bit.
    """
    distances = np.bitwise_count(fps[:, None] ^ pivots()[None, :]).astype(np.int8)
    order = np.lexsort((fps, distances[:, 0], group))
    fps, group, distances = fps[order], group[order], distances[order]
    parent = np.arange(len(fps))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = int(parent[x])
        return x

    active, step = np.arange(len(fps)), 1
    while True:
        active = active[active < len(fps) - step]
        other = active + step
        near = (group[active] == group[other]) & (distances[other, 0] - distances[active, 0] <= max_bits)
        active = active[near]
        if not len(active):
            break
        other = active + step
        apart = parent[active] != parent[other]
        a, b = active[apart], other[apart]
        kept = np.abs(distances[a] - distances[b]).max(axis=1, initial=0) <= max_bits
        a, b = a[kept], b[kept]
        kept = np.bitwise_count(fps[a] ^ fps[b]) <= max_bits
        if kept.any():
            for x, y in zip(a[kept].tolist(), b[kept].tolist()):
                x, y = root(x), root(y)
                parent[max(x, y)] = min(x, y)
            while (parent[parent] != parent).any():
                parent = parent[parent]
        step += 1
    out = np.empty(len(fps), np.int64)
    out[order] = order[parent]
    return out


def links(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK, bands: int | None = None) -> DataFrame:
    """(u, v): edges between fingerprints (column fp, distinct) that connect just what lies within max_bits.

    Fingerprints meet where they agree on some choice of bands. Those of a key with more than `block` of them meet only
    where they also agree on a part of their other bits; a key that is still too frequent is dealt into blocks, each
    two of which meet in a group of their own. So no task holds more than two blocks, and a group returns a forest,
    not its pairs. Pivot distances are worked out where fingerprints meet: 24 coordinates are three times what a
    fingerprint takes in the shuffle.
    """
    masks = _masks(bands or bands_for(distinct.count(), max_bits), max_bits)
    keyed = distinct.select("fp", F.posexplode(_keyed(F.col("fp"), _literal(masks))).alias("choice", "key"))
    coarse = _with_blocks(keyed, block)
    others = F.get(F.array(*(_literal(_other_masks(m, max_bits)) for m in masks)), F.col("choice"))
    finer = coarse.where("blocks > 1").select("fp", F.explode(_keyed(F.col("fp"), others, F.col("key"))).alias("key"))
    dealt = coarse.where("blocks = 1").select("fp", "key", "blocks").unionByName(_with_blocks(finer, block).select("fp", "key", "blocks"))
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("blocks")).cast("int")
    dealt = dealt.withColumn("own", own).select("fp", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    met = dealt.groupBy("key", F.least("own", "with").alias("b1"), F.greatest("own", "with").alias("b2"))
    met = met.agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 2000):
            lists = batch.column(0)
            fps = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            sizes = np.diff(lists.offsets.to_numpy())
            if not len(fps):
                continue
            to = _forest(fps, np.repeat(np.arange(len(sizes)), sizes), max_bits)
            tied = np.flatnonzero(to != np.arange(len(fps)))
            signed = fps.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(signed[tied]), pa.array(signed[to[tied]])], ["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def _parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, part, component_id, copies): simhash_components with part, the component's least fingerprint."""
    found = cut(fingerprints(docs, id_col, text_col))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    parts = components(links(distinct.select("fp"), max_bits))
    named = distinct.join(parts, distinct["fp"] == parts["node"], "left")
    named = named.select("fp", "least", "copies", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("least").alias("component_id"))
    named = named.join(least, "part").select(F.col("fp").alias("f"), "part", "component_id", "copies")
    return found.join(named, found["fp"] == named["f"]).drop("f")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id, copies): a row for each row of docs.

    component_id is the least id among the documents reachable over links of at most max_bits differing bits, the
    document itself included; copies counts the rows with the same fingerprint. A text that is null, empty or all
    white space has fingerprint 0. Repeated rows all stay; a null id stays null and never names a component unless it
    has no other. Other columns are ignored; an empty table gives an empty result.
    """
    return _parts(docs, id_col, text_col, max_bits).select("doc_id", "fp", "component_id", "copies")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "copies")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row for each component: of its least doc_id, then of its least fingerprint; one of several such rows.

    A component is told by its fingerprints, never by an id, so rows of one id or of null id whose texts lie in
    different components don't stand for each other. A null id is chosen where its component has no other.
    """
    columns = docs.columns
    found = cut(_parts(docs).select("doc_id", "fp", "part"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")
    chosen = found.groupBy("part").agg(F.min(order).alias("c")).select(F.col("c.doc_id").alias("_kept"), F.col("c.fp").alias("_kept_fp"))
    several = found.groupBy("doc_id").agg((F.min("fp") != F.max("fp")).alias("_several"))
    chosen = cut(chosen.join(several, F.col("_kept").eqNullSafe(F.col("doc_id"))).drop("doc_id"))

    plain, mixed = chosen.where("not _several"), chosen.where("_several")
    kept = docs.join(plain, docs["doc_id"].eqNullSafe(plain["_kept"]), "left_semi").dropDuplicates(["doc_id"])
    ids = mixed.select("_kept").distinct()
    marked = docs.join(ids, docs["doc_id"].eqNullSafe(ids["_kept"]), "left_semi").withColumn("_fp", _fingerprint_column("text"))
    same = marked["doc_id"].eqNullSafe(mixed["_kept"]) & (marked["_fp"] == mixed["_kept_fp"])
    return kept.select(*columns).unionByName(marked.join(mixed, same, "left_semi").dropDuplicates(["doc_id", "_fp"]).select(*columns))
