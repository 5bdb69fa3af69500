"""Markdown as rows: lines become blocks by windows over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Unicode white space, which is trimmed from lines.
SPACES = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
DIGITS = "0123456789"
#: How far a mark may be indented, the digits of a list's number, and the levels of headings.
INDENT, MOST_DIGITS, LEVELS = 3, 3, 6


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACES))


def _at(text: Column, place: Column | int) -> Column:
    """The character at a place from 1, "" beyond the end."""
    return F.substring(text, F.lit(place) if isinstance(place, int) else place, F.lit(1))


def _leading(text: Column, marks: str) -> Column:
    """How many of the marks a text begins with."""
    return F.length(text) - F.length(F.ltrim(text, F.lit(marks)))


def _blank(character: Column) -> Column:
    return (character != "") & (_trimmed(character) == "")


def line_kind(line: Column) -> Column:
    """What a line is by itself: blank, heading, rule, fence, table, quote, list or paragraph, in this order where several fit."""
    bare, own = _trimmed(line), F.ltrim(line, F.lit(SPACES))
    near = F.length(line) - F.length(own) <= INDENT
    first = _at(bare, 1)
    hashes, digits = _leading(line, "#"), _leading(own, DIGITS)
    return (
        F.when(bare == "", "blank")
        .when(hashes.between(1, LEVELS) & _blank(_at(line, hashes + 1)), "heading")
        .when(near & first.isin("-", "*", "_") & (F.length(bare) >= 3) & (F.replace(bare, first, F.lit("")) == ""), "rule")
        .when(fence_mark(line) != "", "fence")
        .when((first == "|") & (F.length(bare) >= 2) & (F.right(bare, F.lit(1)) == "|"), "table")
        .when(near & (first == ">"), "quote")
        .when(near & first.isin("-", "*", "+") & _blank(_at(own, 2)), "list")
        .when(near & digits.between(1, MOST_DIGITS) & _at(own, digits + 1).isin(".", ")") & _blank(_at(own, digits + 2)), "list")
        .otherwise("paragraph")
    )


def fence_mark(line: Column) -> Column:
    """"b" for a line that begins with three back-ticks, "t" for one with three tildes, else ""."""
    bare = _trimmed(line)
    return F.when(F.startswith(bare, F.lit("```")), "b").when(F.startswith(bare, F.lit("~~~")), "t").otherwise("")


def heading_text(line: Column) -> Column:
    """A heading without its marks, those at its end, too; of a heading of nothing but marks one stays."""
    body = _trimmed(F.ltrim(line, F.lit("#")))
    given = _trimmed(F.substring(line, _leading(line, "#") + 1, F.length(line)))
    bare = _trimmed(F.rtrim(body, F.lit("#")))
    return F.when((bare == "") & (given != ""), "#").otherwise(bare)


def _quoted(line: Column) -> Column:
    """A quote's line without its mark and one blank after it."""
    rest = F.substring(F.ltrim(line, F.lit(SPACES)), F.lit(2), F.length(line))
    return F.rtrim(F.when(_blank(_at(rest, 1)), F.substring(rest, F.lit(2), F.length(rest))).otherwise(rest), F.lit(SPACES))


def blocks(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, block_no, type, text, level) of Markdown texts, one row each and with distinct keys; block_no counts from 0.

    A fence closes at the next line that begins with its three marks, or with the text; whatever lies between is code,
    another fence's marks, too. Tables and quotes are runs of such lines; a run of list and paragraph lines is a list from
    its first list line on. Lines of a paragraph are joined by spaces, others by line feeds; rules and blank blocks go.
    Lines keep to their text's partition, which is shuffled once; a null text has no blocks.
    """
    lines = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n")
    rows = texts.select(F.col(key).alias("_key"), F.posexplode(lines).alias("_n", "line"))
    rows = rows.withColumns({"kind": line_kind(F.col("line")), "mark": fence_mark(F.col("line"))})
    whole = Window.partitionBy("_key").orderBy("_n")
    so_far = whole.rowsBetween(Window.unboundedPreceding, 0)

    # Which fence lines open and close: over the marks of a text as one string, each stretch runs to the next like mark.
    marks = F.array_join(F.transform(F.filter(lines, lambda x: fence_mark(x) != ""), fence_mark), "")
    runs = F.regexp_extract_all(marks, F.lit("b[^b]*(?:b|$)|t[^t]*(?:t|$)"), F.lit(0))
    fences = texts.select(F.col(key).alias("_key"), F.posexplode(runs).alias("_i", "run"))
    last = F.sum(F.length("run")).over(Window.partitionBy("_key").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    closes = (F.length("run") > 1) & (F.right("run", F.lit(1)) == _at(F.col("run"), 1))
    ends = fences.select("_key", (last - F.length("run") + 1).alias("first"), F.when(closes, last).alias("last"))
    roles = ends.select("_key", F.explode(F.array(F.struct(F.col("first").alias("f"), F.lit(1).alias("opens")), F.struct(F.col("last").alias("f"), F.lit(0).alias("opens")))).alias("r")).where("r.f is not null").select("_key", "r.f", "r.opens")
    rows = rows.withColumn("f", F.when(F.col("mark") != "", F.sum(F.when(F.col("mark") != "", 1).otherwise(0)).over(so_far)))
    rows = rows.join(roles, ["_key", "f"], "left")
    opened = F.coalesce(F.sum("opens").over(so_far), F.lit(0))
    closed = F.count(F.when(F.col("opens") == 0, 1)).over(so_far)
    rows = rows.withColumns({"_opened": opened, "_inside": opened > closed})

    # Inside a fence all lines but the one that opens it are code; a line that closes one parts what lies around it.
    group = F.when(F.col("opens").isNotNull(), "fence").when(F.col("_inside"), "code").when(F.col("kind").isin("list", "paragraph"), "text").otherwise(F.col("kind"))
    rows = rows.withColumn("group", group)
    new = F.coalesce((F.col("group") != F.lag("group").over(whole)) | F.col("group").isin("heading", "fence"), F.lit(True))
    rows = rows.withColumn("_run", F.sum(new.cast("int")).over(so_far))
    in_run = Window.partitionBy("_key", "_run").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    listed = F.max((F.col("kind") == "list").cast("int")).over(in_run) == 1
    rows = rows.withColumn("type", F.when(F.col("group") == "text", F.when(listed, "list").otherwise("paragraph")).otherwise(F.col("group")))
    rows = rows.where(F.col("type").isin("heading", "code", "table", "quote", "list", "paragraph"))

    part = F.when(F.col("type") == "heading", heading_text(F.col("line"))).when(F.col("type") == "code", F.col("line")).when(F.col("type") == "quote", _quoted(F.col("line"))).otherwise(_trimmed(F.col("line")))
    made = rows.select("_key", "_run", "type", "_n", part.alias("part"), F.when(F.col("type") == "heading", _leading(F.col("line"), "#")).alias("level"))
    made = made.groupBy("_key", "_run", "type").agg(F.sort_array(F.collect_list(F.struct("_n", "part"))).alias("c"), F.max("level").alias("level"))
    parts = F.transform("c", lambda x: x["part"])
    joined = _trimmed(F.when(F.col("type") == "paragraph", F.array_join(parts, " ")).otherwise(F.array_join(parts, "\n")))
    made = made.select("_key", F.get("c", F.lit(0))["_n"].alias("_n"), "type", joined.alias("text"), "level").where("text <> ''")
    return made.select(F.col("_key").alias(key), (F.row_number().over(whole) - 1).alias("block_no"), "type", "text", "level")


def rendered(rows: DataFrame, key: str) -> DataFrame:
    """(key, markdown): blocks (key, block_no, type, text, level) as Markdown again, parted by blank lines."""
    text = F.col("text")
    quoted = F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))
    one = F.when((F.col("type") == "heading") & F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text)).when(F.col("type") == "code", F.concat(F.lit("```\n"), text, F.lit("\n```"))).when(F.col("type") == "quote", quoted).otherwise(text)
    listed = rows.where(_trimmed(text) != "").groupBy(key).agg(F.sort_array(F.collect_list(F.struct("block_no", one.alias("m")))).alias("c"))
    return listed.select(key, F.concat(F.array_join(F.transform("c", lambda x: x["m"]), "\n\n"), F.lit("\n")).alias("markdown"))
