"""Operator 11: byte-level BPE encoding and decoding by Spark's higher-order functions."""

from __future__ import annotations

import base64
import json
from collections import defaultdict
from collections.abc import Callable
from functools import lru_cache
from itertools import count

import public_tokenizers
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: How many frequent words, of at most so many bytes, are encoded beforehand, and the places for them, a prime number.
KNOWN, KNOWN_BYTES, PLACES = 1 << 17, 64, 262_139
#: Buckets of pairs, and the least number of places for them: prime numbers.
BUCKETS, PAIR_PLACES = 65_521, 131_071

#: Bits of an id, and of a rank beside it; the rank of an id that can't be joined with the next.
BITS, NONE = 20, 1 << 20
#: For two columns of ids the element that the first is in a fold's state: its rank with the second (or NONE), then itself.
Ranks = Callable[[Column, Column], Column]


def _literal(values: list, kind: str) -> Column:
    """An array as a constant of the plan, from one string: what folds away before the job starts."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


@lru_cache(maxsize=2)
def pieces(path: str) -> list[bytes]:
    """A rank file's byte strings in order of rank, which is a token's id; a rank without one is null bytes no text can have."""
    with open(path, "rb") as file:
        ranks = {int(rank): base64.b64decode(piece) for piece, rank in map(bytes.split, file)}
    return [ranks.get(n, b"") for n in range(max(ranks) + 1)]


@lru_cache(maxsize=2)
def displaced(path: str) -> tuple[list[int], list[int], list[int]]:
    """(shifts, keys, ranks): the map from two ids to the id that they become, in which every look-up takes one place.

    A pair's key is first * 2^16 + second. The bucket of a key, key % BUCKETS, has a shift, and the key's place is
    (key + shift) % len(keys); shifts are chosen, for full buckets first, so that no two keys get one place. Keys of a
    bucket can't meet, as they differ by less than 2^16 buckets and the number of places is a larger prime.
    """
    listed = pieces(path)
    if len(listed) > 1 << 16:
        raise ValueError("a vocabulary of more than 2^16 ids")
    ids = {piece: n for n, piece in enumerate(listed) if piece}
    made = {}
    for piece, rank in ids.items():
        for cut in range(1, len(piece)):
            first, second = ids.get(piece[:cut]), ids.get(piece[cut:])
            if first is not None and second is not None:
                made[first << 16 | second] = rank
    places = PAIR_PLACES
    while places < 1.2 * len(made):
        places = next(n for n in count(2 * places) if all(n % d for d in range(2, int(n**0.5) + 1)))
    buckets: dict[int, list[int]] = defaultdict(list)
    for key in made:
        buckets[key % BUCKETS].append(key)
    shifts, keys, ranks, start = [0] * BUCKETS, [-1] * places, [0] * places, 0
    for bucket, held in sorted(buckets.items(), key=lambda x: -len(x[1])):
        shift = next(n for n in count(start) if all(keys[(key + n) % places] < 0 for key in held))
        start = (start + 40_503) % places  # somewhere else the next time
        shifts[bucket] = shift
        for key in held:
            keys[(key + shift) % places], ranks[(key + shift) % places] = key, made[key]
    return shifts, keys, ranks


def _named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once: a transform of one element gives it a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_ranks(path: str, body: Callable[[Ranks], Column]) -> Column:
    """body with the rank map of a vocabulary as constants, which the plan holds once for all look-ups.

    Spark looks through the whole of a map value for a key, so it isn't one.
    """
    shifts, keys, ranks = displaced(path)
    # A slot is a key and its rank; one that isn't taken has a key that no pair has.
    slots = [(key if key >= 0 else 1 << 32) << BITS | rank for key, rank in zip(keys, ranks)]
    held = F.struct(_literal(shifts, "long").alias("shifts"), _literal(slots, "long").alias("slots"))

    def ranked(map_: Column) -> Column:
        def of(first: Column, second: Column) -> Column:
            # Apart from the key, a slot is a rank below NONE; another key leaves more than that, and no second is null.
            place = lambda mine: ((mine + F.get(map_["shifts"], (mine % BUCKETS).cast("int"))) % len(slots)).cast("int")
            rank = _named(F.shiftleft(first, 16).bitwiseOR(second), lambda mine: F.get(map_["slots"], place(mine)).bitwiseXOR(F.shiftleft(mine, BITS)))
            return F.shiftleft(F.least(rank, F.lit(NONE).cast("long")), BITS).bitwiseOR(first)

        return body(of)

    return _named(held, ranked)


def _class(name: str) -> str:
    r"""\p{name} for Java, with the code points that the tokenizers' library counts to it and Java's Unicode doesn't know yet."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    probe = tiktoken.Encoding("probe", pat_str=rf"\p{{{name}}}+", mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    codes = sorted(map(ord, bytes(probe.encode_ordinary(every)).decode()))
    first = [c for c, before in zip(codes, [-2, *codes]) if c != before + 1]
    last = [c for c, after in zip(codes, [*codes[1:], -2]) if c != after - 1]
    newer = "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in zip(first, last))
    return rf"\p{{{name}}}[\p{{Cn}}&&[{newer}]]"


@lru_cache(maxsize=2)
def java_pattern(pattern: str = public_tokenizers.PATTERN) -> str:
    r"""The pattern of words for Spark: \s, \p{L} and \p{N} mean the same code points as in the tokenizers' library."""
    for name in "LN":
        inside = _class(name)
        # Within a class as part of it, elsewhere as a class of its own.
        pattern = regex.sub(rf"(?<=\[[^\]]*)\\p\{{{name}\}}", lambda _: f"\0{name}", pattern).replace(rf"\p{{{name}}}", f"[{inside}]").replace(f"\0{name}", inside)
    return "(?U)" + pattern


def folded(word: Column, path: str, rank: Ranks) -> Column:
    """The ids of a word's bytes (binary) after all ranked merges.

    The state of the fold is one array of a long for each id: its rank with the next above it (see `Ranks`), so the least
    is the pair to join and says what it becomes. A step joins the first of them and looks up the two ranks that this
    changes; without a pair, nothing changes any more. A null stands before the first and after the last. There are no
    more steps than bytes, and each copies the word's array: a word of 10^5 letters is slow, but takes no more memory
    than its arrays.
    """
    ids = {piece: n for n, piece in enumerate(pieces(path))}
    of_byte = _literal([ids[bytes([b])] for b in range(256)], "long")
    # As Latin-1 every byte is a character.
    letters = F.transform(F.split(F.decode(word, "ISO-8859-1"), ""), lambda x: F.get(of_byte, F.ascii(x)))
    edge = F.array(F.lit(None).cast("long"))
    start = _named(letters, lambda s: F.concat(edge, F.transform(s, lambda x, i: rank(x, F.get(s, i + 1))), edge))
    id_of = lambda x: x.bitwiseAND(F.lit(NONE - 1).cast("long"))

    def joined(state: Column, least: Column, p: Column) -> Column:
        """The state after the ids at p and p + 1, counted from 1, have become one."""
        made = F.shiftright(least, BITS)
        pair = F.array(rank(id_of(F.get(state, p - 2)), made), rank(made, id_of(F.get(state, p + 1))))
        return F.concat(F.slice(state, F.lit(1), p - 2), pair, F.slice(state, p + 2, F.size(state)))

    def step(state: Column, _: Column) -> Column:
        join = lambda least: _named(F.array_position(state, least).cast("int"), lambda p: joined(state, least, p))
        return _named(F.array_min(state), lambda least: F.when(least < NONE << BITS, join(least)).otherwise(state))

    size = F.octet_length(word)
    folds = F.aggregate(F.sequence(F.lit(2), F.greatest(size, F.lit(2))), start, step, lambda state: F.transform(F.filter(state, F.isnotnull), lambda x: id_of(x).cast("int")))
    return F.when(size > 0, folds).otherwise(F.array().cast("array<int>"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(java_pattern()), F.lit(0))


def frequent_words(docs: DataFrame, text_col: str, path: str, known: int = KNOWN) -> list[tuple[int, str, str]]:
    """(place, word, ids) of the `known` most frequent of the distinct words of all texts: at most known * KNOWN_BYTES bytes.

    Of words that get one place, the most frequent stays. What is encoded here isn't encoded again in the texts; nothing
    else depends on it.
    """
    words = docs.select(F.explode(_words(F.col(text_col))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.octet_length("word") <= KNOWN_BYTES)
    # Spread again: the best of all come in one partition.
    best = words.orderBy(F.desc("n"), "word").limit(known).repartition("word")
    ids = literal_ranks(path, lambda rank: F.array_join(folded(F.col("word").cast("binary"), path, rank), ","))
    held = best.select(_place(F.col("word")).alias("place"), "n", "word", ids.alias("ids")).toArrow().sort_by([("n", "ascending"), ("word", "ascending")])
    return list(zip(*(held.column(c).to_pylist() for c in ("place", "word", "ids"))))


def _place(word: Column) -> Column:
    return F.pmod(F.hash(word), F.lit(PLACES))


def encoded(docs: DataFrame, text_col: str = "text", path: str | None = None, known: int = KNOWN) -> DataFrame:
    """docs with `_ids`: the token ids of each text as decimal numbers with commas; "" for null and empty texts.

    path: a file of ranked byte strings, at most 2^16, read by the driver. Texts are cut by the tokenizers' pattern, and
    each word's bytes are merged by rank: of the `known` most frequent words once for all, of the others where they
    stand. Special tokens' strings are text. No text is shuffled; other columns and repeated rows stay; an empty table
    stays empty.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    words, ids = [None] * PLACES, [None] * PLACES
    for place, word, listed in frequent_words(docs, text_col, path, known):
        words[place], ids[place] = word, listed
    words, ids = _literal(words, "string"), _literal(ids, "string")
    coded = lambda w, rank: F.when(F.get(words, _place(w)) == w, F.get(ids, _place(w))).otherwise(F.array_join(folded(w.cast("binary"), path, rank), ","))
    listed = literal_ranks(path, lambda rank: F.transform(_words(F.col(text_col)), lambda w: coded(w, rank)))
    return docs.withColumn("_ids", F.coalesce(F.array_join(listed, ","), F.lit("")))


def decoded(ids: Column, path: str | None = None) -> Column:
    """The bytes (binary) of token ids as written by `encoded`: their pieces put together."""
    listed = _literal([base64.b64encode(p).decode() for p in pieces(path or public_tokenizers.path(VOCABULARY))], "binary").cast("array<string>")
    parts = F.transform(F.filter(F.split(ids, ","), lambda x: x != ""), lambda x: F.get(listed, x.cast("int")))
    return F.array_join(parts, "").cast("binary")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = encoded(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("_ids").alias("ids"))
    n_tokens = F.when(F.col("ids") == "", 0).otherwise(F.regexp_count("ids", F.lit(",")) + 1)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), n_tokens.cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(decoded(F.col("ids")), 256).alias("decoded_sha256"))
