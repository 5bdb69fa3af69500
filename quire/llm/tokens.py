"""Operator 10: token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
#: How many distinct pre-tokens a Python worker remembers.
REMEMBERED = 150_000
#: Fixed: how byte-level BPE cuts a text into pre-tokens.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then the rest."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)]


class Merges:
    """A byte-level BPE vocabulary: for a pair of symbols its rank and what it becomes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        self.of_byte = np.array([vocab[c] for c in _byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order, made[order]
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.cut = regex.compile(PRE_TOKEN)
        self.at_special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.known: dict[str, int] = {}

    def count_symbols(self, tokens: list[str]) -> np.ndarray:
        """How many symbols each pre-token ends as.

        All of them lie in one ragged array. Every round finds each sequence's lowest-rank pair and merges all its
        occurrences there, left to right; a sequence without a known pair is done and leaves the array.
        """
        encoded = [t.encode("utf-8", "surrogatepass") for t in tokens]
        sizes = np.fromiter(map(len, encoded), np.int64, len(encoded))
        out = sizes.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(encoded), np.uint8)]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        while len(symbols) > 1:
            pair = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            real = (self.keys[at] == pair) & (owner[:-1] == owner[1:])
            rank = np.where(real, self.rank[at], len(self.keys))
            rank = np.append(rank, len(self.keys))
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(starts, len(owner)))
            best = np.minimum.reduceat(rank, starts)
            going = best < len(self.keys)
            out[owner[starts[~going]]] = lengths[~going]
            merge = (rank == np.repeat(best, lengths)) & (rank < len(self.keys))
            # In a run of overlapping pairs every second one goes with the one before it.
            hit = np.flatnonzero(merge)
            if len(hit) > 1:
                first = np.append(True, np.diff(hit) > 1)
                run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
            symbols[hit] = self.made[at[hit]]
            stay = np.repeat(going, lengths)
            stay[hit + 1] = False
            symbols, owner = symbols[stay], owner[stay]
        out[owner] = np.bincount(owner, minlength=len(out))[owner]
        return out

    def learn(self, tokens: set[str]) -> None:
        new = list(tokens)
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            self.known.update(zip(part, self.count_symbols(part).tolist()))

    def counts(self, texts: list[str | None]) -> list[int]:
        """The number of tokens of each text; a special token's string counts as that token."""
        special = [0] * len(texts)
        pieces = []
        for n, text in enumerate(texts):
            text = text or ""
            if self.at_special and self.at_special.search(text):
                parts = self.at_special.split(text)
                special[n] = len(parts) - 1
                pieces.append([t for p in parts for t in self.cut.findall(p)])
            else:
                pieces.append(self.cut.findall(text))
        missing = set().union(*pieces) - self.known.keys()
        if len(self.known) + len(missing) > REMEMBERED:
            self.known.clear()
            missing = set().union(*pieces)
        self.learn(missing)
        get = self.known.__getitem__
        return [s + sum(map(get, p)) for s, p in zip(special, pieces)]


@lru_cache(maxsize=1)
def merges(path: str) -> Merges:
    return Merges(path)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of docs; a null text counts as empty: 0 tokens.

    path: a byte-level BPE tokenizer file that every executor can read. Texts are counted whole; distinct pre-tokens
    are merged once for a batch and remembered by the worker, up to a fixed number. Repeated rows are counted alike,
    other columns ignored, and an empty table gives an empty result.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = merges(path).counts(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long")
    df = docs.select(F.col(id_col).cast("long").alias("doc_id"), size.alias("n_bytes"), text.alias("text"))
    df = df.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return df.withColumn("over_limit", F.col("n_tokens") > limit)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
