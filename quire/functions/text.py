"""Text expressions: everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of Unicode letters, numbers and the underscore are tokens; WS is Unicode white space.
TOKEN = r"[\p{L}\p{N}_]+"
WS = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
#: Fixed wording: the sentence that refuses, and the openings of the deterministic model's replies.
REFUSAL = "I couldn't find that in %s."
ANSWER = 'According to the book: "%s" [1]'
CONTEXT = "A passage about: %s."
SUMMARY = "This part of the book covers: %s."
GROUNDED = 'The relevant passage says: "%s" [%d]\n\n%s'
QA_ANSWER = "According to the passage: %s"
QUESTIONS = (
    "What does the passage say about %s?",
    "Why does the passage mention %s?",
    "How is %s described in the book?",
    "What happens in the part about %s?",
    "Which details does the passage give about %s?",
)


def named(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body has it: a transform of one element gives it a name."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def collapse(text: Column) -> Column:
    """White space levelled to single spaces, none at the ends."""
    return F.trim(F.regexp_replace(text, WS, " "))


def normalise(text: Column) -> Column:
    return collapse(F.lower(text))


def digest(text: Column, length: int) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def bucket(token: Column, dim: int) -> Column:
    """The bucket that a token hashes to: the first 64 bits of its SHA-256, unsigned, modulo dim."""
    return (F.conv(digest(token, 16), 16, 10).cast("decimal(20,0)") % dim).cast("int")


def sign(token: Column) -> Column:
    return F.when(digest(token, 1) >= "8", 1).otherwise(-1)


def chunk_id(book: Column, ordinal: Column, text: Column) -> Column:
    return F.format_string("%s:%04d:%s", book, ordinal, digest(text, 10))


def cited(text: Column) -> Column:
    """The distinct numbers in square brackets, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,3})\]"), F.lit(1)), lambda x: x.cast("int"))))


def location(chapter: Column, section: Column, first: Column, last: Column) -> Column:
    """A label such as "Harbour — Low Tide (pp. 4-6)"; a null or 0 page has none."""
    name = F.when(section.isNotNull() & (section != chapter), F.concat(chapter, F.lit(" — "), section)).otherwise(chapter)
    pages = F.when(first == last, F.format_string(" (p. %d)", first)).otherwise(F.format_string(" (pp. %d-%d)", first, last))
    return F.when(first > 0, F.concat(name, pages)).otherwise(name)


def says(template: str, value: Column) -> Column:
    return F.format_string(template, value)


def names_chapter(chapter: Column, wanted: Column) -> Column:
    """Whether a chapter title contains the wanted words whole, whatever their case and spacing; blank wants any."""
    edge = lambda at: F.when(at.rlike(r"[\p{L}\p{N}_]"), F.lit("1")).otherwise(F.lit(""))
    need = normalise(wanted)
    left = F.when(edge(F.substring(need, 1, 1)) == "1", F.lit(r"(?<![\p{L}\p{N}_])")).otherwise(F.lit(""))
    right = F.when(edge(F.substring(need, -1, 1)) == "1", F.lit(r"(?![\p{L}\p{N}_])")).otherwise(F.lit(""))
    quoted = F.concat(F.lit("\\Q"), F.replace(need, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (need == "") | F.regexp_like(normalise(chapter), F.concat(left, quoted, right))


def wrapped(text: Column, width: int = 88) -> Column:
    """The lines of a text, filled greedily at word boundaries; a longer word has a line of its own; at least one line."""
    none = F.array().cast("array<string>")
    words = F.filter(F.split(collapse(text), " "), lambda w: w != "")

    def step(state: Column, word: Column) -> Column:
        longer = F.when(state["line"] == "", word).otherwise(F.concat(state["line"], F.lit(" "), word))
        full = (F.length(longer) > width) & (state["line"] != "")
        return F.struct(F.when(full, F.concat(state["out"], F.array(state["line"]))).otherwise(state["out"]).alias("out"), F.when(full, word).otherwise(longer).alias("line"))

    start = F.struct(none.alias("out"), F.lit("").alias("line"))
    done = lambda s: F.when((s["line"] != "") | (F.size(s["out"]) == 0), F.concat(s["out"], F.array(s["line"]))).otherwise(s["out"])
    return F.aggregate(words, start, step, done)


#: Fixed: what may end a line of running text.
LINE_ENDS = r"[.!?:;\"”]$"


def rejoined(text: Column) -> Column:
    """Lines of a page put together again: a line that ends no sentence goes on with the next, over blank ones, too."""
    lines = F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, rf"{WS}$", ""))

    def step(out: Column, line: Column) -> Column:
        last, own = F.element_at(out, -1), F.regexp_replace(line, rf"^{WS}", "")
        goes_on = (F.size(out) > 0) & (F.coalesce(last, F.lit("")) != "") & ~F.coalesce(last, F.lit("")).rlike(LINE_ENDS)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat(last, F.lit(" "), own)))
        return F.when(goes_on, joined).otherwise(F.concat(out, F.array(own)))

    out = F.aggregate(lines, F.array().cast("array<string>"), lambda o, x: F.when(F.size(o) == 0, F.array(F.regexp_replace(x, rf"^{WS}", ""))).otherwise(step(o, x)))
    return F.array_join(F.filter(out, lambda x: x != ""), "\n")


def four_places(value: Column) -> Column:
    """A metric for reports; halves go to the even digit."""
    return F.bround(value, 4)
