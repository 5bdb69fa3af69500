"""Operator 2: quality rules in a short-circuit cascade, in DataFrame functions only."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, WORD, cut, table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
#: Rows that the order of the rules is estimated on; they decide no document.
SAMPLE_ROWS = 400
SAMPLE_SHARE = 0.05
#: Times that a rule is evaluated on each row of the sample, and the least seconds that all of it counts as.
REPEATS = 16
LEAST_COST = 0.001
#: Columns that are added; input columns of these names give way to them.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
VERDICT = ("rejected_by", "kept")


@dataclass(frozen=True)
class Rule:
    """A named test; `fails` is a column over text and the base counts that is true for what the rule rejects."""

    name: str
    fails: Column


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once for a row, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """How many words lie in a three-word window found at least twice in the text.

    Windows are compared by a 64-bit hash. Sorted with their positions, equal ones are neighbours; the sorted starts of
    those that have an equal neighbour then cover three words each, less the overlap with the one before.
    """
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))

    def starts(windows: Column) -> Column:
        twice = lambda x, j: x["h"].eqNullSafe(F.get(windows, j - 1)["h"]) | x["h"].eqNullSafe(F.get(windows, j + 1)["h"])
        return F.sort_array(F.transform(F.filter(windows, twice), lambda x: x["i"]))

    covered = F.aggregate(
        _let(F.sort_array(F.transform(F.sequence(F.lit(0), F.size(words) - 3), window)), starts),
        F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")),
        lambda a: a["n"],
    )
    return F.when(F.size(words) < 3, F.lit(0).cast("long")).otherwise(covered)


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the counts of the base rules: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed.

    A null text counts as one without words. Columns of docs that have one of these names are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c in COUNTS and c != text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    of_words = lambda words: F.struct(F.size(words).cast("long").alias("n"), _repeated_words(words).alias("repeated"))
    doubled = lambda lines: (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")
    df = docs.withColumn("_counts", _let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words))
    df = df.select(
        *docs.columns,
        F.col("_counts.n").alias("n_words"),
        F.length(F.regexp_replace(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _let(F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)), doubled).alias("n_dup_lines"),
        F.col("_counts.repeated").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def default_rules(text_col: str = "text") -> list[Rule]:
    """The rules that follow the base ones. All thresholds are shares, so they hold for texts of any length."""
    text, n = F.coalesce(F.col(text_col), F.lit("")), F.col("n_words")
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]+", ""))
    capitals = F.length(F.regexp_replace(text, r"[^\p{Lu}]+", ""))
    lines = F.size(F.split(text, "\n"))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("repeated_lines", 10 * F.col("n_dup_lines") > 5 * lines),
        Rule("few_letters", 2 * letters < F.col("word_chars")),
        Rule("capitals", 2 * capitals > letters),
        Rule("exclamations", 5 * (F.length(text) - F.length(F.translate(text, "!?", ""))) > n),
    ]


def _seconds(rows: DataFrame, value: Column) -> tuple[float, float]:
    """(share of rows for which value is true, seconds that it takes); the lesser of two runs after one that compiles."""
    query = rows.agg(F.avg(F.coalesce(value, F.lit(False)).cast("double")))
    query.first()
    took = []
    for _ in range(2):
        began = time.perf_counter()
        share = query.first()[0] or 0.0
        took.append(time.perf_counter() - began)
    return share, min(took)


def order_by_yield(sample: DataFrame, rules: Sequence[Rule]) -> list[Rule]:
    """The rules by falling rejections per second on sample (rows with the base counts).

    A rule's cost is what it adds to reading the sample REPEATS times over, so a job's own time doesn't count.
    """
    rows = sample.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))
    _, idle = _seconds(rows, F.col("_again") < 0)
    yields = []
    for rule in rules:
        rejected, took = _seconds(rows, rule.fails)
        yields.append((-rejected / max(took - idle, LEAST_COST), rule.name, rule))
    return [rule for *_, rule in sorted(yields, key=lambda x: x[:2])]


def cascade(rules: Sequence[Rule]) -> Column:
    """The name of the first rule that rejects, or null. CASE stops there: what comes later isn't evaluated."""
    first, *rest = rules
    out = F.when(first.fails, first.name)
    for rule in rest:
        out = out.when(rule.fails, rule.name)
    return out


def quality(docs: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """docs with the base counts, base_failed, rejected_by and kept.

    The base rules come first, as every document needs their counts; the others run cheapest rejection first, and only
    for what has passed so far. Their order is estimated on a bounded sample. It decides the cost and, for a document
    that several rules reject, the name in rejected_by; kept never depends on it. A null or empty text fails the base
    rules. Repeated rows are judged alike; other columns stay, but those of the added names are replaced.
    """
    docs = docs.drop(*(c for c in docs.columns if c in VERDICT and c != text_col))
    rules = default_rules(text_col) if rules is None else list(rules)
    counted = base_counts(docs, text_col)
    if len(rules) > 1:
        some = docs.select(text_col).sample(SAMPLE_SHARE, seed=42).limit(SAMPLE_ROWS)
        rules = order_by_yield(cut(base_counts(some, text_col).where("not base_failed")), rules)
    verdict = F.when(F.col("base_failed"), "base")
    if rules:
        verdict = F.coalesce(verdict, F.when(~F.col("base_failed"), cascade(rules)))
    df = counted.withColumn("rejected_by", verdict)
    return df.withColumn("kept", F.col("rejected_by").isNull())


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP2_SQL = r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         row_number() OVER () AS r
  FROM documents
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM words, unnest(range(1, len(w) - 1)) AS u(i)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY r
), lines AS (
  SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM words
), counts AS (
  SELECT doc_id, text, len(w)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters,
         length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS capitals,
         length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS marks,
         len(string_split(text, chr(10))) AS n_lines
  FROM words JOIN lines USING (r) LEFT JOIN covered USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words
            OR 10 * n_dup_lines > 5 * n_lines OR 2 * letters < word_chars OR 2 * capitals > letters
            OR 5 * marks > n_words) AS kept
FROM judged
"""
