"""Book files as tables: Markdown, EPUB and model-file headers, read where the tasks run."""

from __future__ import annotations

import io
import posixpath
import re
import struct
import unicodedata
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import chunking, markdown
from quire.operators.tables import kept

BLOCKS = "path string, book_id string, title string, authors string, language string, chapter_no int, chapter string, block_no int, type string, text string, level int"

def slug(text: str, most: int = 60) -> str:
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode().lower()
    return re.sub(r"[^a-z0-9]+", "-", plain).strip("-")[:most].strip("-") or "book"


class _Visible(HTMLParser):
    """An XHTML chapter as Markdown lines."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines, self.skip = [""], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.skip += tag in ("script", "style", "nav", "head")
        if re.fullmatch("h[1-6]", tag):
            self.lines += ["", "#" * int(tag[1]) + " "]
        elif tag in ("p", "div", "section", "li", "blockquote", "tr", "br"):
            self.lines += ["", "- " if tag == "li" else "> " if tag == "blockquote" else ""]

    def handle_endtag(self, tag: str) -> None:
        self.skip -= tag in ("script", "style", "nav", "head")
        if re.fullmatch("h[1-6]|p|div|li|blockquote", tag):
            self.lines.append("")

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.lines[-1] += re.sub(r"\s+", " ", data)


def _contents(file: zipfile.ZipFile, base: str, items: list) -> dict[str, str]:
    """The titles that tables of contents give to files: those of navigation pages, then of NCX files; the first counts."""
    local = lambda e: e.tag.rpartition("}")[2]
    told = lambda e: " ".join("".join(e.itertext()).split())
    titles: dict[str, str] = {}
    for item in sorted(items, key=lambda i: "nav" not in (i.get("properties") or "").split()):
        if "nav" in (item.get("properties") or "").split():
            at = posixpath.dirname(item.get("href"))
            page = ElementTree.fromstring(file.read(posixpath.join(base, item.get("href"))))
            links = [(posixpath.normpath(posixpath.join(at, a.get("href") or "")), told(a)) for a in page.iter() if local(a) == "a" and a.get("href")]
        elif item.get("media-type") == "application/x-dtbncx+xml":
            points = [e for e in ElementTree.fromstring(file.read(posixpath.join(base, item.get("href")))).iter() if local(e) == "navPoint"]
            first = lambda p, name: next((e for e in p.iter() if local(e) == name), None)
            links = [(first(p, "content").get("src") or "", told(first(p, "text"))) for p in points if first(p, "content") is not None and first(p, "text") is not None]
        else:
            continue
        for target, label in links:
            if label and target.partition("#")[0]:
                titles.setdefault(target.partition("#")[0], label)
    return titles


def epub_parts(content: bytes) -> tuple[dict[str, str | None], list[tuple[str | None, str, str]]]:
    """(title, authors and language; linear entries of the spine as their title in the contents, a name from the file, and Markdown)."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as file:
        box = ElementTree.fromstring(file.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(file.read(opf))
        items = {e.get("id"): e for e in package.iter() if local(e) == "item"}
        values = lambda name: [" ".join(e.text.split()) for e in package.iter() if local(e) == name and e.text and e.text.strip()]
        about = {"title": next(iter(values("title")), None), "authors": ", ".join(values("creator")) or None, "language": next(iter(values("language")), None)}
        base = posixpath.dirname(opf)
        titles = _contents(file, base, list(items.values()))
        out = []
        for ref in (e for e in package.iter() if local(e) == "itemref"):
            item = items.get(ref.get("idref"))
            if item is None or (ref.get("linear") or "").lower() in ("no", "false") or ref.get("idref") in ("nav", "toc"):
                continue
            page = _Visible()
            page.feed(file.read(posixpath.join(base, item.get("href"))).decode("utf-8", "replace"))
            name = posixpath.splitext(posixpath.basename(item.get("href")))[0].replace("_", " ").replace("-", " ").title()
            out.append((titles.get(item.get("href")), name, "\n".join(page.lines)))
    return about, out


PARTS = "path string, book_id string, title string, authors string, language string, part int, named string, stem string, markdown string, error string"
#: What an EPUB's entry needs, if it has no heading.
MIN_PART = 80


def file_parts(where: str, content: bytes) -> list[tuple]:
    """A file's texts as Markdown: one, or those of an EPUB's spine; a file that can't be read is one row with the error."""
    stem = posixpath.splitext(posixpath.basename(where))[0]
    try:
        if not where.lower().endswith(".epub"):
            return [(where, slug(stem), stem, None, None, 0, None, None, content.decode("utf-8", "replace"), None)]
        about, found = epub_parts(content)
        title = about.get("title") or stem
        head = (where, slug(title), title, about.get("authors"), about.get("language"))
        return [(*head, n, *part, None) for n, part in enumerate(found, 1)] or [(*head, 1, None, None, "", None)]
    except Exception as error:  # noqa: BLE001  one bad file is no reason to lose the others
        return [(where, slug(stem), stem, None, None, 0, None, None, None, f"{type(error).__name__}: {error}")]


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all .md, .markdown, .txt and .epub files below a path, with chapters.

    Files are opened where the tasks run, none on the driver, and their Markdown becomes blocks in Spark. Texts break into
    chapters at headings; an EPUB's entries are chapters, named by the contents, else by their first heading, else by the
    file; those of under MIN_PART characters without a heading go. A file that can't be read or has no text has one row of
    type "error"; `failures` lists these, and chunks leave them out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.where(F.lower("path").rlike(r"\.(md|markdown|txt|epub)$")).select("path", "content")
    columns = [c.split()[0] for c in PARTS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for where, content in zip(batch["path"], batch["content"]):
                yield pd.DataFrame(file_parts(where, content), columns=columns).astype({"part": "int32"})

    parts = kept(files.mapInPandas(run, PARTS).withColumn("key", F.concat_ws("\n", "path", "part")))
    found = kept(markdown.blocks(parts.where("error is null"), "key", "markdown").join(parts.drop("markdown", "error"), "key"))
    out = _of_texts(found.where("part = 0")).unionByName(_of_entries(found.where("part > 0")))
    whole = out.select("path").distinct()
    bad = parts.groupBy("path").agg(F.min(F.struct("part", "book_id", "title", F.coalesce("error", F.lit("ValueError: no text")).alias("text"))).alias("x")).join(whole, "path", "left_anti")
    none = lambda kind: F.lit(None).cast(kind)
    errors = bad.select("path", "x.book_id", "x.title", none("string").alias("authors"), none("string").alias("language"), F.lit(0).alias("chapter_no"), none("string").alias("chapter"), F.lit(0).alias("block_no"), F.lit("error").alias("type"), "x.text", none("int").alias("level"))
    return out.unionByName(errors).select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in BLOCKS.split(", ")))


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with block_no from 1 in each chapter."""
    return rows.withColumn("block_no", F.row_number().over(Window.partitionBy("path", "chapter_no").orderBy("block_no")))


def _of_texts(rows: DataFrame) -> DataFrame:
    """Blocks of text files with chapters by their headings; a file is a book, whatever other files are called."""
    named = rows.withColumn("_id", F.col("book_id")).withColumn("book_id", F.col("path"))
    return _numbered(chunking.assign_chapters(named, drop_repeats=False).withColumn("book_id", F.col("_id")).drop("_id", "key", "part", "named", "stem"))


def _of_entries(rows: DataFrame) -> DataFrame:
    """Blocks of EPUB entries, each a chapter; one that only repeats the chapter's name at its start goes."""
    entry = Window.partitionBy("key")
    heading = F.min(F.when((F.col("type") == "heading") & (F.col("level") <= 3), F.struct("block_no", "text"))).over(entry)["text"]
    df = rows.withColumns({"_heading": heading, "_size": F.sum(F.length("text")).over(entry)}).where(F.col("_heading").isNotNull() | (F.col("_size") >= MIN_PART))
    df = df.withColumn("chapter", F.coalesce("named", "_heading", "stem"))
    df = df.where(~((F.col("block_no") == 0) & (F.col("type") == "heading") & (X.normalise(F.col("text")) == X.normalise(F.col("chapter")))))
    numbers = F.dense_rank().over(Window.partitionBy("path").orderBy("part"))
    return _numbered(df.withColumn("chapter_no", numbers).drop("key", "part", "named", "stem", "_heading", "_size"))


def failures(blocks: DataFrame) -> DataFrame:
    """(path, reason) of the files that couldn't be read."""
    return blocks.where("type = 'error'").select("path", F.col("text").alias("reason"))


_FORMATS = {0: "B", 1: "b", 2: "H", 3: "h", 4: "I", 5: "i", 6: "f", 7: "?", 10: "Q", 11: "q", 12: "d"}


def gguf_header(file: io.BufferedIOBase) -> dict:
    """version, metadata and the number of parameters from the head of a GGUF file; ValueError names what's cut off."""

    def take(fmt: str, what: str):  # noqa: ANN202
        size = struct.calcsize("<" + fmt)
        data = file.read(size)
        if len(data) < size:
            raise ValueError(f"truncated in {what}")
        return struct.unpack("<" + fmt, data)[0]

    def text(what: str) -> str:
        size = take("Q", what)
        if size > 1 << 26:
            raise ValueError(f"string too long in {what}")
        data = file.read(size)
        if len(data) < size:
            raise ValueError(f"truncated in {what}")
        return data.decode("utf-8", "replace")

    def value(kind: int, what: str):  # noqa: ANN202
        if kind == 8:
            return text(what)
        if kind == 9:
            inner, n = take("I", what), take("Q", what)
            if n > 1 << 26:
                raise ValueError(f"array too long in {what}")
            return [value(inner, what) for _ in range(n)]
        if kind not in _FORMATS:
            raise ValueError(f"unknown value type {kind} in {what}")
        return take(_FORMATS[kind], what)

    if file.read(4) != b"GGUF":
        raise ValueError("not a GGUF file")
    version = take("I", "version")
    if version not in (2, 3):
        raise ValueError(f"version {version} isn't known")
    tensors, pairs = take("Q", "counts"), take("Q", "counts")
    metadata = {text("metadata"): value(take("I", "metadata"), "metadata") for _ in range(pairs)}
    parameters = 0
    for _ in range(tensors):
        text("tensors")
        size = 1
        dims = take("I", "tensors")
        if dims > 8:
            raise ValueError("too many dimensions in tensors")
        for _ in range(dims):
            size *= take("Q", "tensors")
        take("I", "tensors"), take("Q", "tensors")
        parameters += size
    return {"version": version, "metadata": metadata, "tensor_count": tensors, "parameter_count": parameters}
