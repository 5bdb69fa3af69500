"""Documents and book blocks to provenance-tracked chunks: pieces, offsets, heading paths, greedy packing with overlap."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators.tables import running

TARGET, OVERLAP, MOST = 1800, 250, 3600
LEVELS = 6

_STRIP = rf"^{X.WS}|{X.WS}$"


def split_long(text: Column, most: int = MOST) -> Column:
    """Parts of at most `most` characters: cut at the last line feed, else the last space, unless they come too early."""
    none = F.array().cast("array<string>")

    def step(state: Column, _: Column) -> Column:
        rest = state["rest"]
        head = F.substring(rest, 1, most)
        before = lambda sep: F.lit(most) - F.instr(F.reverse(head), sep)
        fits = lambda sep: (F.instr(head, sep) > 0) & (before(sep) >= most // 2)
        at = F.when(fits("\n"), before("\n")).when(fits(" "), before(" ")).otherwise(most)
        long_ = F.length(rest) > most
        part = F.when(long_, F.regexp_replace(F.substr(rest, F.lit(1), at), _STRIP, "")).otherwise(rest)
        left = F.when(long_, F.regexp_replace(F.substr(rest, at + 1), "^" + X.WS, "")).otherwise("")
        return F.struct(F.when(part != "", F.concat(state["out"], F.array(part))).otherwise(state["out"]).alias("out"), left.alias("rest"))

    steps = F.sequence(F.lit(0), F.floor(F.length(text) / (most // 2)).cast("int"))
    cut = F.aggregate(steps, F.struct(none.alias("out"), text.alias("rest")), step, lambda state: state["out"])
    return F.when(F.length(text) > most, cut).otherwise(F.filter(F.array(text), lambda t: t != ""))


def _piece(text: Column, heading: Column, path: Column, page: Column) -> Column:
    return F.struct(text.alias("text"), heading.alias("heading"), path.alias("path"), page.alias("page"))


def document_chapters(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(book_id, doc_id, chapter, pieces): each non-blank line is a paragraph; long ones are cut.

    A document is a chapter of the book that its source names. A chapter is one row all along.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda line: F.trim(line)), lambda line: line != "")
    parts = F.flatten(F.transform(lines, lambda line: split_long(line, most)))
    plain = lambda t: _piece(t, F.lit(False), F.array().cast("array<string>"), F.lit(None).cast("int"))
    return docs.select(F.col("source").alias("book_id"), "doc_id", F.concat(F.lit("doc-"), F.col("doc_id")).alias("chapter"), F.transform(parts, plain).alias("pieces"))


def assign_chapters(blocks: DataFrame, drop_repeats: bool = True) -> DataFrame:
    """blocks (book_id, title, block_no, type, text, level) with chapter_no and chapter.

    Chapters break at headings of level 1, in books without any at those of level 2, else nowhere. The heading that
    opens a chapter is its title and goes; what comes before the first has the book's title. Chapters of blank blocks
    go, and so does, with drop_repeats, a first block that only repeats the title.
    """
    book = Window.partitionBy("book_id")
    is_heading = F.col("type") == "heading"
    has = lambda n: F.max((is_heading & (F.col("level") == n)).cast("int")).over(book) == 1
    level = F.when(has(1), 1).when(has(2), 2).otherwise(0)
    so_far = book.orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    df = blocks.withColumn("_break", is_heading & F.coalesce(F.col("level") == level, F.lit(False)))
    opened = F.max(F.when(F.col("_break"), F.struct("block_no", F.trim("text").alias("t")))).over(so_far)
    df = df.withColumn("_no", F.sum(F.col("_break").cast("int")).over(so_far)).withColumn("chapter", F.coalesce(opened["t"], F.col("title")))
    df = df.where(~F.col("_break") & (X.collapse(F.col("text")) != ""))
    inside = Window.partitionBy("book_id", "_no").orderBy("block_no")
    repeats = is_heading & (X.normalise(F.col("text")) == X.normalise(F.col("chapter"))) & (F.row_number().over(inside) == 1)
    df = df.withColumn("_repeats", repeats & F.lit(drop_repeats)).where("not _repeats")
    return df.withColumn("chapter_no", F.dense_rank().over(book.orderBy("_no"))).drop("_break", "_no", "_repeats")


def heading_paths(blocks: DataFrame) -> DataFrame:
    """blocks (book_id, chapter_no, block_no, type, text, level) with heading_path: the headings above each, from the outside in.

    A heading ends those of its own or a deeper level. So a level's last heading is open if it is later than the last of
    each outer level: running maxima within a chapter, no stack.
    """
    so_far = Window.partitionBy("book_id", "chapter_no").orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda n: (F.col("type") == "heading") & (F.col("level") == n)
    last = [F.max(F.when(at(n), F.struct("block_no", F.trim("text").alias("t")))).over(so_far).alias(f"_h{n}") for n in range(1, LEVELS + 1)]
    df = blocks.select("*", *last)
    place = lambda n: F.coalesce(F.col(f"_h{n}.block_no"), F.lit(-1))
    open_ = []
    for n in range(1, LEVELS + 1):
        outer = F.greatest(*(place(k) for k in range(1, n)), F.lit(-1), F.lit(-1))
        open_.append(F.when(place(n) > outer, F.col(f"_h{n}.t")))
    return df.withColumn("heading_path", F.array_compact(F.array(*open_))).drop(*(f"_h{n}" for n in range(1, LEVELS + 1)))


def block_chapters(blocks: DataFrame, most: int = MOST) -> DataFrame:
    """(book_id, doc_id, chapter, pieces) from blocks with chapters: chapter_no becomes doc_id; a page column is optional."""
    page = F.col("page").cast("int") if "page" in blocks.columns else F.lit(None).cast("int")
    df = heading_paths(blocks.where("type <> 'error'")).withColumn("_page", page).where(X.collapse(F.col("text")) != "")
    heading = (F.col("type") == "heading") & F.col("level").isNotNull()
    parts = F.transform(split_long(F.regexp_replace("text", _STRIP, ""), most), lambda t: _piece(t, heading, F.col("heading_path"), F.col("_page")))
    listed = F.sort_array(F.collect_list(F.struct("block_no", parts.alias("parts"))))
    whole = df.groupBy("book_id", F.col("chapter_no").cast("long").alias("doc_id"), "chapter").agg(listed.alias("b"))
    return whole.select("book_id", "doc_id", "chapter", F.flatten(F.transform("b", lambda x: x["parts"])).alias("pieces"))


def _sizes(pieces: Column) -> Column:
    return F.transform(pieces, lambda p: F.length(p["text"]))


def _total(pieces: Column) -> Column:
    return F.aggregate(_sizes(pieces), F.lit(0).cast("long"), lambda a, n: a + n + 2)


def pieces_with_offsets(chapters: DataFrame) -> DataFrame:
    """(book_id, doc_id, chapter, piece, text, char_start, char_end): pieces lie two characters apart in their book."""
    placed = running(chapters, "book_id", ["doc_id", "chapter"], base=_total(F.col("pieces")))
    # The start of a piece is the total of those before it, carried along in one fold.
    none = F.array().cast("array<bigint>")
    fold = F.aggregate(_sizes(F.col("pieces")), F.struct(none.alias("out"), F.lit(0).cast("long").alias("n")), lambda a, n: F.struct(F.concat(a["out"], F.array(a["n"])).alias("out"), (a["n"] + n + 2).alias("n")), lambda a: a["out"])
    rows = placed.select("book_id", "doc_id", "chapter", "base", F.posexplode(F.arrays_zip("pieces", fold.alias("at"))).alias("piece", "x"))
    start = F.col("base") + F.col("x.at")
    text = F.col("x.pieces.text")
    return rows.select("book_id", "doc_id", "chapter", "piece", text.alias("text"), start.alias("char_start"), (start + F.length(text)).alias("char_end"))


def pack_ranges(chars: list[int], heading: list[bool], target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> list[tuple[int, int]]:
    """Ranges of pieces that make chunks: each grows to the target and the next begins with up to `overlap` of its end.

    What a chunk holds is always a range, so the state is its first piece. Before a piece that doesn't fit, what there
    is goes out unless it is headings only, and less is carried on if the piece needs the room. What is carried past
    the last piece makes a chunk of its own.
    """
    sums, bodies = [0], [0]
    for n, h in zip(chars, heading):
        sums.append(sums[-1] + n + 2)
        bodies.append(bodies[-1] + (not h))

    def carried(lo: int, hi: int, room: int) -> int:
        return next((k for k in range(lo, hi + 1) if 0 < sums[hi + 1] - sums[k] <= room), hi + 1)

    out, lo = [], 0
    for i, n in enumerate(chars):
        if bodies[i] > bodies[lo] and sums[i] - sums[lo] + n + 2 > most:
            out.append((lo, i - 1))
            lo = carried(lo, i - 1, min(overlap, most - n - 2))
        if sums[i + 1] - sums[lo] >= target:
            out.append((lo, i))
            lo = carried(lo, i, overlap)
    return [*out, (lo, len(chars) - 1)] if lo < len(chars) else out


def chunks(chapters: DataFrame, target: int = TARGET, overlap: int = OVERLAP, most: int = MOST) -> DataFrame:
    """(chunk_id, book_id, doc_id, chapter, ordinal, text, heading_path, page_start, page_end, char_start, char_end, char_count).

    chapters: (book_id, doc_id, chapter, pieces), in the order of doc_id within a book. Chapters are packed on their own;
    only the lengths of their pieces go through Python. Offsets and ordinals run on through the book. A chunk's heading
    path is that of its first piece that isn't a heading, else of its first; its pages are the least and greatest
    of its pieces' pages. Books may share doc_ids; repeated chapters are chapters of their own.
    """

    @F.pandas_udf("array<struct<lo:int,hi:int,start:bigint,stop:bigint>>")
    def ranges(chars: pd.Series, heading: pd.Series) -> pd.Series:
        out = []
        for n, h in zip(chars, heading):
            at = [0]
            for c in n:
                at.append(at[-1] + int(c) + 2)
            out.append([{"lo": a, "hi": b, "start": at[a], "stop": at[b + 1] - 2} for a, b in pack_ranges(list(n), list(h), target, overlap, most)])
        return pd.Series(out)

    packed = chapters.withColumn("ranges", ranges(_sizes(F.col("pieces")), F.transform("pieces", lambda p: p["heading"])))
    placed = running(packed, "book_id", ["doc_id", "chapter"], base=_total(F.col("pieces")), first=F.size("ranges"))
    rows = placed.select("book_id", "doc_id", "chapter", "pieces", "base", "first", F.posexplode("ranges").alias("n", "r"))
    rows = rows.withColumn("part", F.slice("pieces", F.col("r.lo") + 1, F.col("r.hi") - F.col("r.lo") + 1))
    anchor = F.coalesce(F.get(F.filter("part", lambda p: ~p["heading"]), F.lit(0)), F.get("part", F.lit(0)))
    pages = F.filter(F.transform("part", lambda p: p["page"]), lambda p: p > 0)
    rows = rows.select(
        "book_id",
        "doc_id",
        "chapter",
        (F.col("first") + F.col("n")).cast("int").alias("ordinal"),
        F.array_join(F.transform("part", lambda p: p["text"]), "\n\n").alias("text"),
        anchor["path"].alias("heading_path"),
        F.array_min(pages).alias("page_start"),
        F.array_max(pages).alias("page_end"),
        (F.col("base") + F.col("r.start")).alias("char_start"),
        (F.col("base") + F.col("r.stop")).alias("char_end"),
    )
    return rows.withColumns({"chunk_id": X.chunk_id(F.col("book_id"), F.col("ordinal"), F.col("text")), "char_count": F.length("text")})


def of_documents(docs: DataFrame) -> DataFrame:
    return chunks(document_chapters(docs))


def of_blocks(blocks: DataFrame) -> DataFrame:
    """Chunks of the blocks that `read_books` gives."""
    return chunks(block_chapters(blocks))
