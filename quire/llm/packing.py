"""Operator 5: best-fit packing by a linear grouping scheme."""

from __future__ import annotations

import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, sliced, table

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 2048
END = 0
#: Lengths of at least this share of the capacity are large; so few fit that a bin's contents are a short list.
LARGE = 0.25
GROUPS = 96
REMEMBERED = 400_000
#: Words that the tokenizer encodes at once; its results are many times their size.
ENCODED = 4000
#: Words that go to it as one text, and the special token between them.
TOGETHER = 100
APART = "<|endoftext|>"


@lru_cache(maxsize=1)
def _tokenizer(path: str):  # noqa: ANN202
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each core a task; threads of its own would only contend
    return Tokenizer.from_file(path), {}


#: A full stop or comma between an ASCII letter or digit and white space is a pre-token of its own.
_MARK = re.compile(rb"(?<=[a-z0-9])([.,])(?![^\x20\x09-\x0D])")


def _units(text: str | None) -> list[bytes]:
    """The parts of a text that are encoded on their own.

    No id of this vocabulary spans white space, it lowers all letters itself, and a mark after a letter is cut from it,
    so words in lower case and marks apart give the same ids and far fewer different parts. Texts that may hold a
    special token's string keep their case.
    """
    if not text:
        return []
    data = text.encode("utf-8", "surrogatepass")
    if b"<|" not in data:
        data = _MARK.sub(rb" \1", data.lower())
    return data.split()


def _encoded(tokenizer, units: list[bytes]) -> Iterator[tuple[bytes, bytes]]:  # noqa: ANN001
    """Each unit with its ids. A special token always stands alone, so units with one between them keep their ids.

    A unit that may hold such a token's string itself is a text of its own.
    """
    plain = [u for u in units if b"<|" not in u]
    groups = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)] + [[u] for u in units if b"<|" in u]
    texts = [APART.join(u.decode("utf-8", "replace") for u in group) for group in groups]
    apart = tokenizer.token_to_id(APART)
    for group, encoding in zip(groups, tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
        ids = np.array(encoding.ids, "<u4")
        cuts = np.flatnonzero(ids == apart).tolist() if len(group) > 1 else []
        yield from zip(group, (ids[a:b].tobytes() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(ids)])), strict=True)


def token_ids(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers, with END at the end; each unit is encoded once."""
    tokenizer, known = _tokenizer(path)
    words = [_units(t) for t in texts]
    missing = set().union(*words) - known.keys()
    if len(known) + len(missing) > REMEMBERED:
        known.clear()
        missing = set().union(*words)
    new = list(missing)
    for a in range(0, len(new), ENCODED):
        known.update(_encoded(tokenizer, new[a : a + ENCODED]))
    get, end = known.__getitem__, np.array([END], "<u4").tobytes()
    return [b"".join(map(get, w)) + end for w in words]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, pid, rank[, ids]): the documents' ids, cut where longer than capacity.

    pid is the task and rank the piece's number among those of its length there.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, pid int, rank long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, pid = [0] * (capacity + 1), TaskContext.get().partitionId()
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in sliced(batches):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), token_ids(batch.column(1).to_pylist(), path)):
                for piece, start in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[start : start + 4 * capacity]
                    n = len(part) // 4
                    rows.append((doc_id, piece, start // 4, n, zlib.crc32(part), pid, seen[n], *[part] * with_ids))
                    seen[n] += 1
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        _tokenizer(path)[1].clear()  # the worker goes on to other tasks

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _groups(counts: dict[int, int], wanted: int) -> list[tuple[int, int, dict[int, int]]]:
    """Large lengths in groups of equal cardinality, longest first: (rounded length, number, what it holds)."""
    each = max(1, -(-sum(counts.values()) // wanted))
    out, room, held = [], 0, {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if not room:
                held, room = {}, each
                out.append((length, 0, held))
            take = min(left, room)
            held[length] = held.get(length, 0) + take
            left, room = left - take, room - take
            out[-1] = (out[-1][0], out[-1][1] + take, held)
    return out


def _configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[float, np.ndarray]]:
    """(times, configuration): how often to use each, by the linear programme over all configurations of the sizes.

    Column generation: the basis starts with bins of one size; the duals price the sizes, the best configuration for
    these prices comes from a knapsack over the few sizes that fit into one bin, and enters until none saves anything.
    """
    k = len(sizes)
    most = capacity // int(sizes.min())
    basis = np.diag(np.maximum(1, capacity // sizes)).astype(float)
    inverse = np.linalg.inv(basis)
    x = inverse @ demand
    room = np.arange(capacity + 1)
    for step in range(40 * k):
        duals = inverse.sum(axis=0)
        value, picks = np.zeros(capacity + 1), []
        for _ in range(most):
            gain = np.full((k, capacity + 1), -1.0)
            for i, size in enumerate(sizes):
                gain[i, size:] = duals[i] + value[: capacity + 1 - size]
            pick = gain.argmax(axis=0)
            better = np.maximum(gain[pick, room], 0)
            pick = np.where(better > value, pick, -1)
            picks.append(pick)
            value = np.maximum(better, value)
        if value[capacity] <= 1 + 1e-6:
            break
        column, at = np.zeros(k), capacity
        for pick in reversed(picks):
            if (i := pick[at]) >= 0:
                column[i] += 1
                at -= int(sizes[i])
        direction = inverse @ column
        up = np.flatnonzero(direction > 1e-9)
        if not len(up):
            break
        ratio = x[up] / direction[up]
        out = up[ratio.argmin()]
        theta = x[out] / direction[out]
        x = x - theta * direction
        x[out] = theta
        basis[:, out] = column
        inverse[out] /= direction[out]
        for i in np.flatnonzero(np.abs(direction) > 1e-12):
            if i != out:
                inverse[i] -= direction[i] * inverse[out]
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return [(float(t), basis[:, i].astype(int)) for i, t in enumerate(x) if t > 1e-9]


class _Bins:
    """Bins in classes of equal contents: (first bin, how many, room left), and who lies where in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.n = capacity, 0
        self.rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.used: dict[int, int] = defaultdict(int)
        self.plan: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first bin, offset

    def put(self, length: int, n: int, bin_: int, offset: int) -> None:
        self.plan.append((length, self.used[length], n, bin_, offset))
        self.used[length] += n

    def open(self, n: int) -> int:
        self.n += n
        return self.n - n

    def best_fit(self, length: int, n: int) -> None:
        """n pieces of one length, each into the bins with the least room that holds one; the rest into new bins."""
        while n:
            room = min((r for r in self.rooms if r >= length), default=None)
            if room is None:
                each = self.capacity // length
                full, rest = divmod(n, each)
                for bins, of in ((full, each), (1, rest)):
                    if bins and of:
                        first = self.open(bins)
                        for i in range(of):
                            self.put(length, bins, first, i * length)
                        if left := self.capacity - of * length:
                            self.rooms[left].append((first, bins))
                return
            first, bins = self.rooms[room].pop()
            if not self.rooms[room]:
                del self.rooms[room]
            fit = room // length
            take = min(bins, n // fit) or 1
            fit = min(fit, n)
            for i in range(fit):
                self.put(length, take, first, self.capacity - room + i * length)
            n -= take * fit
            if left := room - fit * length:
                self.rooms[left].append((first, take))
            if bins > take:
                self.rooms[room].append((first + take, bins - take))


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Where pieces go, from the number of pieces of each length: (length, first rank, how many, first bin, offset) and the bins.

    The large lengths, in groups of equal cardinality and rounded up to each group's longest, form few sizes whose
    configurations are optimised; the whole part of each configuration's number is used, filled with the actual
    lengths, which are shorter, and what is over is packed best-fit, longest first, then the small ones likewise.
    The work depends on the number of lengths (at most the capacity), never on the number of pieces.
    """
    bins = _Bins(capacity)
    left = dict(counts)
    large = {length: n for length, n in counts.items() if length >= LARGE * capacity and length < capacity and n}
    grouped = _groups(large, groups)
    if grouped:
        sizes = np.array([g[0] for g in grouped])
        for times, config in _configurations(sizes, np.array([float(g[1]) for g in grouped]), capacity):
            _substitute(bins, grouped, config, int(times + 1e-6), left)
    for length in sorted((x for x in left if left[x]), reverse=True):
        bins.best_fit(length, left[length])
    return bins.plan, bins.n


def _substitute(bins: _Bins, grouped: list[tuple[int, int, dict[int, int]]], config: np.ndarray, times: int, left: dict[int, int]) -> None:
    """`times` bins of one configuration with actual lengths: runs of bins whose lengths agree form a class."""
    slots = [i for i, n in enumerate(config) for _ in range(n)]
    while times and slots:
        chosen, taken = [], defaultdict(int)
        for i in slots:
            held = grouped[i][2]
            length = next((x for x in sorted(held, reverse=True) if held[x] > taken.get((i, x), 0) and left[x] > 0), None)
            if length is None:
                return
            taken[i, length] += 1
            chosen.append((i, length))
        n = min([times, *(grouped[i][2][x] // k for (i, x), k in taken.items())])
        n = max(n, 1)
        first, offset = bins.open(n), 0
        for i, length in chosen:
            bins.put(length, n, first, offset)
            grouped[i][2][length] -= n
            left[length] -= n
            offset += length
        if room := bins.capacity - offset:
            bins.rooms[room].append((first, n))
        times -= n


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces (see `pieces`; it must give the same rows each time) with sequence_id and offset.

    Only the number of pieces of each length, at most `capacity` numbers, comes to the driver; the plan made from them
    is as small and goes to every task. Pieces find their place by their rank among all pieces of their length: the
    rank in their task, and the number in earlier tasks.
    """
    spark = cut_pieces.sparkSession
    by_task = cut_pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n"))
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, _ = plan(counts, capacity)
    table_ = pd.DataFrame(rows, columns=["length", "rank", "n", "bin", "offset"]).sort_values(["length", "rank"])
    known = spark.sparkContext.broadcast({k: (g["rank"].to_numpy(), g["bin"].to_numpy(), g["offset"].to_numpy()) for k, g in table_.groupby("length")})
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_task.select(F.col("length").alias("_l"), F.col("pid").alias("_p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    ranked = cut_pieces.join(starts, (F.col("length") == F.col("_l")) & (F.col("pid") == F.col("_p")))
    ranked = ranked.withColumn("rank", (F.col("rank") + F.col("_start")).cast("long")).drop("_l", "_p", "_start")

    @F.pandas_udf("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        for one in np.unique(lengths):
            at = np.flatnonzero(lengths == one)
            first, bins, offsets = known.value[int(one)]
            row = np.searchsorted(first, ranks[at], "right") - 1
            sequence[at], offset[at] = bins[row] + ranks[at] - first[row], offsets[row]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = ranked.withColumn("_to", place("length", "rank"))
    kept = [c for c in cut_pieces.columns if c not in ("pid", "rank")]
    return placed.select(*kept, "_to.sequence_id", "_to.offset")


def best_fit_pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document, with the sequence it goes to and its place there.

    Every document ends with END, so an empty or null text has one id. Only documents of more ids than capacity are
    cut. Repeated rows are packed each; other columns are ignored; an empty table gives an empty result.
    """
    return pack(cut(pieces(docs, id_col, text_col, path, capacity, with_ids)), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, from pieces that carry their ids. No sequence exceeds the capacity."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
