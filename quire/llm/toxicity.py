"""Operator 8: toxicity by a chain of linear classifiers."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table

#: Labelled rows that a model is fitted on at most, those with the least hash of their id.
MAX_ROWS = 10_000
MIN_ROWS = 3
#: A feature counts if it is this many standard deviations more frequent among toxic rows than chance has it.
MIN_DEVIATIONS = 4.0
#: The threshold is tuned, but no document of a lower probability is toxic.
MIN_THRESHOLD = 0.15
FOLDS = 5
PENALTY = 0.05
PREFIXES = (4, 5)
CATEGORIES = ("explicit", "severe", "toxic")
REMEMBERED = 100_000

_WORD = re.compile(r"[^\W\d_]+")


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _features(word: str) -> list[int]:
    """A word and its stems."""
    return [_hash(word), *(_hash(word[:n] + "*") for n in PREFIXES if len(word) >= n)]


def features(text: str | None) -> set[int]:
    return {f for word in set(_WORD.findall((text or "").lower())) for f in _features(word)}


@dataclass
class Rows:
    """Sparse binary rows: feature `column[i]` is set in row `row[i]`."""

    row: np.ndarray
    column: np.ndarray
    n: int
    width: int

    def some(self, chosen: np.ndarray) -> Rows:
        place = np.cumsum(chosen) - 1
        in_ = chosen[self.row]
        return Rows(place[self.row[in_]], self.column[in_], int(chosen.sum()), self.width)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Linear:
    """Logistic regression on sparse features and a few dense ones."""

    weights: np.ndarray
    dense: np.ndarray
    bias: float

    def predict(self, x: Rows, more: np.ndarray) -> np.ndarray:
        return _sigmoid(np.bincount(x.row, self.weights[x.column], x.n) + more @ self.dense + self.bias)

    @classmethod
    def fit(cls, x: Rows, more: np.ndarray, y: np.ndarray, steps: int = 400) -> Linear:
        """Accelerated gradient steps on the mean loss and a squared penalty that leaves the bias alone."""
        w = np.zeros(x.width + more.shape[1] + 1)
        seen, penalty = w, np.full(len(w), PENALTY / 10)
        penalty[-1] = 0.0

        def times(v: np.ndarray) -> np.ndarray:
            return np.bincount(x.row, v[x.column], x.n) + more @ v[x.width : -1] + v[-1]

        def back(r: np.ndarray) -> np.ndarray:
            return np.concatenate((np.bincount(x.column, r[x.row], x.width), more.T @ r, [r.sum()]))

        scale = np.ones(x.n)
        scale[y > 0] = max(1.0, min(5.0, (y == 0).sum() / max(1, (y > 0).sum())))
        scale /= scale.sum()
        v = np.ones(len(w))
        for _ in range(12):
            v = back(scale * times(v))
            norm = np.linalg.norm(v)
            v /= norm or 1.0
        rate = 1 / (0.25 * 1.2 * norm + penalty.max() / 10)
        for t in range(steps):
            at = w + (t / (t + 3)) * (w - seen)
            gradient = back(scale * (_sigmoid(times(at)) - y)) + penalty / 10 * at
            w, seen = at - rate * gradient, w
        return cls(w[: x.width], w[x.width : -1], float(w[-1]))


@dataclass
class Chain:
    """One linear model per category; each sees the probabilities of the categories before it."""

    categories: tuple[str, ...]
    models: list[Linear] = field(default_factory=list)
    feature_of: dict[int, int] = field(default_factory=dict)
    width: int = 0
    threshold: float = 2.0

    def probabilities(self, x: Rows) -> np.ndarray:
        out = np.zeros((x.n, 0))
        for model in self.models:
            out = np.column_stack((out, model.predict(x, out)))
        return out if self.models else np.zeros((x.n, len(self.categories)))

    def fit(self, x: Rows, toxic: np.ndarray, fold: np.ndarray, chosen: Callable[[int | None], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Fits the chain; returns the out-of-fold probabilities.

        chosen(f) tells which features count, and which of them are strong, from the rows outside fold f (None: from
        all). What a later model learns from is what it will see: for each row, an earlier category's probability comes
        from a model whose features, category labels and weights owe nothing to the row's fold.
        """
        folds = [f for f in range(FOLDS) if (fold == f).any() and not (fold == f).all()]
        parts = {f: self._part(x, toxic, *chosen(f)) for f in [None, *folds]}
        held_out = np.zeros((x.n, 0))
        for k in range(len(self.categories)):
            own, labels = parts[None]
            self.models.append(Linear.fit(own, held_out, labels[k]))
            p = np.zeros(x.n)
            for f in folds:
                (own, labels), test = parts[f], fold == f
                p[test] = Linear.fit(own.some(~test), held_out[~test], labels[k][~test]).predict(own.some(test), held_out[test])
            held_out = np.column_stack((held_out, p))
        return held_out

    @staticmethod
    def _part(x: Rows, toxic: np.ndarray, counts: np.ndarray, strong: np.ndarray) -> tuple[Rows, list[np.ndarray]]:
        """x with the features that count, and the labels of each category.

        `explicit` is a toxic row with a strong feature, `severe` one with more of them than the median explicit row.
        """
        kept = counts[x.column]
        own = Rows(x.row[kept], x.column[kept], x.n, x.width)
        n_strong = np.bincount(own.row, strong[own.column].astype(float), x.n)
        explicit = (toxic > 0) & (n_strong > 0)
        severe = explicit & (n_strong > np.median(n_strong[explicit])) if explicit.any() else explicit
        return own, [explicit.astype(float), severe.astype(float), toxic]

    def tune(self, p: np.ndarray, y: np.ndarray) -> None:
        """The threshold of the last category with the best F1 on out-of-fold probabilities, amid the gap it lies in."""
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
        best = int(f1.argmax())
        after = p[order[best + 1]] if best + 1 < len(p) else 0.0
        self.threshold = float(max((p[order[best]] + after) / 2, MIN_THRESHOLD))


def _telling(yes: Column, no: Column, all_yes: Column, all_no: Column) -> tuple[Column, Column]:
    """(counts, strong) of a feature from its numbers of toxic and other rows, and those of all rows.

    A feature counts if it is MIN_DEVIATIONS standard deviations more frequent among toxic rows than chance has it; it
    is strong if no other row has it.
    """
    expected = (yes + no) * all_yes / (all_yes + all_no)
    counts = (yes >= MIN_ROWS) & (yes - expected > MIN_DEVIATIONS * F.sqrt(expected))
    return F.coalesce(counts, F.lit(False)), F.coalesce(counts & (no == 0) & (yes >= 2 * MIN_ROWS), F.lit(False))


def _featured(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, fold, toxic, features) of at most max_rows labelled documents."""
    chosen = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    # The bound on the rows bounds the broadcast.
    rows = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).dropDuplicates(["doc_id"]).select("doc_id", "text", "_toxic")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            found = [sorted(features(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "toxic", "features"])

    got = rows.select(F.col("doc_id").cast("long"), "text", F.col("_toxic").cast("int")).mapInArrow(run, "doc_id long, toxic int, features array<long>")
    return got.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))


def fit_chain(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Chain:
    """A chain for the label `toxic` and two categories before it that are read off the labelled rows.

    docs: doc_id, text. labels: doc_id, toxic (0, 1 or null: left out). At most max_rows labelled rows are used. Which
    features count is worked out in Spark, for all rows and for those outside each fold; only these features, and which
    rows have them, come to the driver. Without toxic and other rows the chain is empty and finds nothing toxic.
    """
    rows = cut(_featured(docs, labels, max_rows))
    named = rows.select("doc_id", "fold", (F.col("toxic") > 0).cast("int").alias("toxic")).orderBy("doc_id").toPandas()
    chain = Chain(CATEGORIES)
    toxic, fold = named["toxic"].to_numpy(float), named["fold"].to_numpy()
    if not 0 < toxic.sum() < len(toxic):
        return chain
    is_toxic, without = F.col("toxic") > 0, [None, *range(FOLDS)]
    outside = lambda f: F.lit(True) if f is None else F.col("fold") != f
    numbers = [F.count_if(hit & outside(f)).alias(f"{name}{n}") for n, f in enumerate(without) for name, hit in (("yes", is_toxic), ("no", ~is_toxic))]
    counted = rows.select("fold", "toxic", F.explode("features").alias("feature")).groupBy("feature").agg(*numbers)
    verdicts = []
    for n, f in enumerate(without):
        seen = np.ones(len(fold), bool) if f is None else fold != f
        all_yes = float(toxic[seen].sum())
        counts, strong = _telling(F.col(f"yes{n}"), F.col(f"no{n}"), F.lit(all_yes), F.lit(float(seen.sum()) - all_yes))
        verdicts += [counts.alias(f"counts{n}"), strong.alias(f"strong{n}")]
    telling = counted.select("feature", *verdicts).where(" or ".join(f"counts{n}" for n in range(len(without))))
    telling = cut(telling)
    told = telling.orderBy("feature").toPandas()
    hits = rows.select("doc_id", F.explode("features").alias("feature")).join(telling.select("feature"), "feature").toArrow()
    x = Rows(np.searchsorted(named["doc_id"].to_numpy(), hits["doc_id"].to_numpy()), np.searchsorted(told["feature"].to_numpy(), hits["feature"].to_numpy()), len(toxic), len(told))
    order = np.lexsort((x.column, x.row))
    x = Rows(x.row[order], x.column[order], x.n, x.width)
    at = lambda f, what: told[f"{what}{without.index(f)}"].to_numpy(bool)
    p = chain.fit(x, toxic, fold, lambda f: (at(f, "counts"), at(f, "strong")))
    chain.feature_of = {int(f): i for i, f in enumerate(told["feature"]) if told["counts0"][i]}
    chain.width = len(told)
    chain.tune(p[:, -1], toxic)
    return chain


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with p_<category> for each category and toxic, from whole texts. A null or empty text has no features.

    The chain has a few numbers for each feature that tells toxic rows among at most MAX_ROWS; it goes to every task.
    Columns of docs that have one of the added names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(chain)
    kept = [f for f in docs.schema.fields if f.name not in {f"p_{c}" for c in chain.categories} | {"toxic"}]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"p_{c} double" for c in chain.categories), "toxic boolean"])
    at = [f.name for f in kept].index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, known = model.value, {}
        feature_of = chain.feature_of
        for batch in sliced(batches):
            row, column = [], []
            for n, text in enumerate(batch.column(at).to_pylist()):
                found: set[int] = set()
                for word in set(_WORD.findall((text or "").lower())):
                    hit = known.get(word)
                    if hit is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        hit = known[word] = tuple(feature_of[f] for f in _features(word) if f in feature_of)
                    if hit:
                        found.update(hit)
                row += [n] * len(found)
                column += sorted(found)
            x = Rows(np.array(row, int), np.array(column, int), batch.num_rows, chain.width)
            p = chain.probabilities(x)
            flags = p[:, -1] >= chain.threshold
            names = [f.name for f in kept] + [f"p_{c}" for c in chain.categories] + ["toxic"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c) for c in p.T), pa.array(flags)], names)

    return docs.select(*(f"`{f.name}`" for f in kept)).mapInArrow(run, schema)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit_chain(docs, table(spark, sf_dir, "labels"))).drop("text")


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the chain, fitted on them and their labels, finds toxic. Columns stay as they are."""
    scored = score(docs, fit_chain(docs.select("doc_id", "text"), labels))
    return scored.where(~F.col("toxic")).select(*docs.columns)
