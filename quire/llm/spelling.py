"""Operator 13: spelling variants by letter-parity bitmasks in three bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: What a word consists of, and the letters that are lower-cased.
LETTERS, UPPER = r"A-Za-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MIN_LENGTH, MIN_COUNT, RATIO = 6, 5, 5
#: One run in so many loses a letter.
DAMAGED = 199
BANDS, BAND_BITS = 3, 21


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damaged: int | None = None) -> DataFrame:
    """(word, n): the lower-cased runs of letters of at least min_length letters that occur min_count times in all texts.

    damaged: where it divides the crc32 of `<id>:<run>`, the run's letter crc32 % length is deleted first, which plants
    misspellings; a null id is written as nothing. A null text has no words, an empty table gives an empty result, other
    columns are ignored. Counts are combined before the shuffle, so a frequent word is a row per task.
    """
    runs = F.regexp_extract_all(text_col, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    df = docs.select(F.col(id_col).alias("id"), F.explode(runs).alias("run"))
    # Only ASCII letters are lower-cased, which `lower` does where there are no others.
    plain = F.octet_length("run") == F.char_length("run")
    df = df.select("id", F.when(plain, F.lower("run")).otherwise(F.translate("run", UPPER, UPPER.lower())).alias("word"))
    if damaged:
        df = df.withColumn("h", F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.char_length("word")).cast("int")
        df = df.withColumn("word", F.when(F.col("h") % damaged == 0, F.concat(F.substring("word", F.lit(1), at), F.substring("word", at + 2, F.char_length("word")))).otherwise(F.col("word")))
        df = df.where(F.char_length("word") >= min_length)
    return df.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def parity_mask(word: Column) -> Column:
    """A bit for each letter, set if the letter occurs an odd number of times; a letter's bit lies in band code % 3.

    Letters may share a bit, which only makes words more alike: an insertion or deletion flips one bit, a replacement
    two or none.
    """
    code = lambda x: F.ascii(x).cast("int")
    slot = lambda c: F.when((c >= 97) & (c <= 122), c - 97).otherwise(26 + c % 37)
    bit = lambda s: F.call_function("shiftleft", F.lit(1).cast("long"), (s % BANDS * BAND_BITS + F.floor(s / BANDS)).cast("int"))
    return F.aggregate(F.split(word, ""), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(bit(slot(code(x)))))


def _keys(words: DataFrame) -> DataFrame:
    """(key, word, n), twelve for each word; two words that differ by one edit share at least one key.

    One edit flips at most two bits, so one of three bands stays as it is. A key is a band with its value, beside the
    length of the shorter word of the pair (a word is the shorter one or the longer one: the length filter) and its first
    or last half, one of which the edit doesn't touch; without the halves a band's value would be shared by a share of
    all words that doesn't fall as words grow in number. The key is a hash; what meets by chance isn't verified.
    """
    df = words.select("word", "n", parity_mask(F.col("word")).alias("mask"), F.char_length("word").alias("size"))
    df = df.withColumn("shorter", F.explode(F.array(F.col("size"), F.col("size") - 1)))
    half = F.floor(F.col("shorter") / 2).cast("int")
    df = df.withColumn("side", F.explode(F.array(F.substring("word", F.lit(1), half), F.concat(F.lit(">"), F.right("word", half)))))
    df = df.withColumn("band", F.explode(F.array(*(F.lit(b) for b in range(BANDS)))))
    value = F.call_function("shiftright", F.col("mask"), F.col("band") * BAND_BITS).bitwiseAND(F.lit((1 << BAND_BITS) - 1))
    return df.select(F.xxhash64("shorter", "side", "band", value).alias("key"), "word", "n")


def _large(df: DataFrame) -> DataFrame:
    """df for a join by shuffle: words are short in Parquet, so Spark would size what an explode makes of them far too low and send it through the driver."""
    return df.hint("merge")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n), both ways, for all words (word, n) that differ by one letter put in, taken out or replaced."""
    a, b = _keys(words), _keys(words).toDF("key", "other", "other_n")
    pairs = a.join(_large(b), "key").where((F.col("word") < F.col("other")) & (F.levenshtein("word", "other", 1) == 1)).drop("key").distinct()
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where following forms (word, form) ends; every round doubles how far each word has looked.

    Forms don't run in circles. The rounds are as many as the logarithm of the longest chain.
    """
    at = stored(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(at.join(_large(ahead), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each of words (word, n), which are distinct.

    form: the near word (see `near_words`) of the largest n, the first of equal ones, if that is at least ratio (two or
    more) times the word's n; root: the last of the chain of forms. Groups of variants are never gathered in a row: a
    word keeps a count and a best neighbour, both combined before the shuffle.
    """
    words = stored(words)
    best = F.min(F.struct((-F.col("other_n")).alias("minus_n"), "other"))
    near = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    df = words.join(_large(near), "word", "left")
    has = -F.col("best.minus_n") >= ratio * F.col("n")
    df = stored(df.select("word", F.when(has, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, -F.col("best.minus_n")).alias("form_n")))
    df = df.join(_large(roots(df.where("form is not null"))), "word", "left")
    return df.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(table(spark, sf_dir, "documents"), damaged=DAMAGED))
