"""Operator 6: main text of web pages by consensus host paths."""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, sliced, table

#: A path wins on its host with this share of the pages' votes.
WINNING_SHARE = 0.2
#: A winning path is taken on pages of whose text it holds this share.
TEXT_SHARE = 0.8
#: A block outside article and main is the host's, not the page's, if this share of the host's pages, at least so many, have it.
REPEATED_SHARE, REPEATED_PAGES = 0.3, 3
#: Hosts up to which the table of winning paths, a few short strings for each, is broadcast.
BROADCAST_HOSTS = 50_000
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run to their end tag, or to the page's end without one; those that need an end tag; those that may close themselves.
RUNNING = "script|style"
RAW = frozenset("noscript template iframe svg textarea select title object canvas math".split())
FOREIGN = frozenset("svg math".split())
#: Characters of a path beyond which it goes on from a digest.
MOST_PATH = 400
CONTAINERS = frozenset("body main article section div td center".split())
BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tr caption figure figcaption address details summary fieldset hr".split()) | CONTAINERS | frozenset("nav aside header footer form html head menu dialog".split())
NOISE_TAGS = frozenset("head nav aside footer menu dialog".split())
#: What a form consists of; its words count in running text only.
FIELDS = frozenset("button label option legend".split())
NOISE_ROLES = frozenset("navigation banner complementary contentinfo search dialog alertdialog menu menubar toolbar".split())
#: Fixed: words that name what isn't the article, and words of layout beside them. A name of these alone is a hint, no proof.
NOISE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert newsletter subscribe subscription "
    "popup modal overlay sidebar widget widgets related recommended recommendations share sharing social comment comments disqus respond reply replies "
    "breadcrumb breadcrumbs menu nav navbar navigation footer header masthead pagination pager login signup register search copyright legal toolbar".split()
)
LAYOUT_NAMES = frozenset("area bar block box container content inner item items left links list right section site top bottom wrap wrapper slot unit page global main primary secondary".split())
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "dt": {"dl"}, "dd": {"dl"}}

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RUNNING})(?=[\s/>])[^>]*>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|\Z)"
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>"']+|"[^"]*"|'[^']*'|["'])*+)>|<[!?/][^>]*>|(?P<text>[^<]+|<)""",
    re.S | re.I,
)
_ENDS = re.compile(rf"</({'|'.join(sorted(RAW))})(?=[\s/>])[^>]*>", re.I)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PART = re.compile(r"[^\W_]+")


def _hints(name: str) -> bool:
    parts = [re.sub(r"\d+$", "", p) for p in _PART.findall(name)]
    parts = [p for p in parts if p]
    return any(p in NOISE_NAMES for p in parts) and all(p in NOISE_NAMES or p in LAYOUT_NAMES for p in parts)


def _named(attrs: str) -> tuple[str, bool, bool]:
    """The generalised class (its first name, numbers as #), whether a name hints at noise, and whether the role is noise."""
    general, hinted, role = "", False, False
    if "=" in attrs:
        for kind, *values in _NAMES.findall(attrs):
            value = html.unescape("".join(values)).lower()
            if kind.lower() == "role":
                role = value.strip() in NOISE_ROLES
            else:
                hinted = hinted or any(map(_hints, value.split()))
            if kind.lower() == "class" and value.split():
                general = "." + re.sub(r"\d+", "#", value.split()[0])
    return general, hinted, role


@dataclass
class Container:
    path: str
    parent: int
    hinted: bool
    inside: bool  # an article or main, or within one
    size: int = 0  # characters of text, those of containers within it included
    linked: int = 0  # those of them in links
    within: int = 0  # those of them inside an article or main
    first: int = -1  # its first and last block
    last: int = -1
    form: bool = False
    above: int = 0  # the nearest container around it that has more text, or the page


class Page:
    """A page as blocks of text, each with the containers it lies in."""

    def __init__(self, source: str) -> None:
        self.containers = [Container("", -1, False, False)]  # 0 is the page itself
        self.blocks: list[tuple[int, str, int]] = []  # container, text, characters in links
        self._stack: list[tuple[str, int, bool]] = []  # tag, container, noise
        self._buffer: list[str] = []
        self._linked = self._fielded = 0
        self._opened: Counter[str] = Counter()  # tags on the stack
        ends: dict[str, list[tuple[int, int]]] = {}  # of raw elements, those still to come with the nearest last
        for match in _ENDS.finditer(source):
            ends.setdefault(match[1].lower(), []).append(match.span())
        for found in ends.values():
            found.reverse()
        at = 0
        while match := _TOKEN.match(source, at):
            at = match.end()
            if (text := match["text"]) is not None:
                if not (self._stack and self._stack[-1][2]):
                    text = html.unescape(text)
                    self._buffer.append(text)
                    self._linked += len(text.strip()) * bool(self._opened["a"])
                    self._fielded += len("".join(text.split())) * any(self._opened[f] for f in FIELDS)
            elif tag := match["tag"]:
                tag = tag.lower()
                if match["end"]:
                    self._close(tag)
                elif tag in RAW:
                    coming = ends.get(tag, [])
                    while coming and coming[-1][0] < at:
                        coming.pop()
                    if coming and not (tag in FOREIGN and match["attrs"].endswith("/")):
                        at = coming[-1][1]
                    self._buffer.append(" ")
                else:
                    self._open(tag, match["attrs"])
            elif match["raw"]:
                self._buffer.append(" ")
        self._flush()
        self._drop_hinted()

    def _here(self) -> int:
        return self._stack[-1][1] if self._stack else 0

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text and self._fielded < len(text) - text.count(" "):  # not of buttons and labels alone
                self.blocks.append((self._here(), text, min(self._linked, len(text))))
            self._buffer = []
        self._linked = self._fielded = 0

    def _pop_to(self, n: int) -> None:
        self._flush()
        while len(self._stack) > n:
            self._opened[self._stack.pop()[0]] -= 1

    def _open(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self._flush()
            elif tag == "br":
                self._buffer.append(" ")
            return
        if tag in BLOCKS:
            self._flush()
        if tag in ("body", "article", "main"):  # these end a head, menu, header or footer left open
            for n, (open_tag, *_) in enumerate(self._stack):
                if open_tag in ("head", "nav", "footer", "header"):
                    self._pop_to(n)
                    break
        ends = IMPLIED.get(tag, {"p"} if tag in BLOCKS and tag not in ("tr", "td") else set())
        for n in range(len(self._stack) - 1, -1, -1) if any(self._opened[e] for e in ends) else ():
            if self._stack[n][0] in ends:
                self._pop_to(n)
                break
            if self._stack[n][0] in SCOPES.get(tag, CONTAINERS | {"table", "ul", "ol", "blockquote"}):
                break
        if tag in ("td", "th"):
            self._buffer.append(" ")
        _, here, noise = self._stack[-1] if self._stack else ("", 0, False)
        general, hinted, role = _named(attrs)
        if tag in ("html", "body", "main", "article"):
            hinted = role = False
        around = self.containers[here]
        noise = noise or role or tag in NOISE_TAGS or (tag == "header" and not around.inside)
        if tag in CONTAINERS and tag != "td" or (hinted or tag == "form") and tag in BLOCKS:
            path = around.path if len(around.path) < MOST_PATH else "#" + hashlib.md5(around.path.encode("utf-8", "surrogatepass")).hexdigest()
            self.containers.append(Container(f"{path}>{tag}{general}", here, hinted, around.inside or tag in ("article", "main"), form=tag == "form"))
            here = len(self.containers) - 1
        self._stack.append((tag, here, noise))
        self._opened[tag] += 1

    def _close(self, tag: str) -> None:
        for n in range(len(self._stack) - 1, -1, -1) if self._opened[tag] else ():
            if self._stack[n][0] == tag:
                if tag in BLOCKS:
                    self._pop_to(n)
                else:
                    del self._stack[n]
                    self._opened[tag] -= 1
                return

    def _measure(self) -> None:
        for c in self.containers:
            c.size = c.linked = c.within = 0
            c.first = c.last = -1
        for n, (at, text, linked) in enumerate(self.blocks):
            c = self.containers[at]
            c.size, c.linked, c.within = c.size + len(text), c.linked + linked, c.within + len(text) * c.inside
            c.first, c.last = (n if c.first < 0 else c.first), n
        for c in reversed(self.containers[1:]):
            up = self.containers[c.parent]
            up.size, up.linked, up.within = up.size + c.size, up.linked + c.linked, up.within + c.within
            if c.first >= 0:
                up.first, up.last = min(c.first, up.first) if up.first >= 0 else c.first, max(c.last, up.last)
        for c in self.containers[1:]:
            up = self.containers[c.parent]
            c.above = c.parent if up.size != c.size or up.parent < 0 else up.above

    def _aside(self, c: Container) -> bool:
        """Whether what a name hints at is borne out by where it stands, its size and its links."""
        page = self.containers[0]
        if not c.size or (c.within and not c.inside):
            return False  # empty, or around an article
        if c.form:
            return 2 * c.size <= page.size  # a page that lies in a form isn't one
        if not c.inside and page.within:
            return True  # beside an article
        up = self.containers[c.above]
        at_end = c.last == up.last and c.first != up.first
        if c.size > (0.9 if at_end else 0.5) * up.size:
            return False
        return at_end or c.first == up.first or 2 * c.linked >= c.size or 5 * c.size <= page.size

    def _drop_hinted(self) -> None:
        """Forms go, then blocks of containers with a noisy name, where more than the tag or name tells against them."""
        self._measure()
        for is_noise in (lambda c: c.form, lambda c: c.hinted and not c.form):
            gone: set[int] = set()
            for n, c in enumerate(self.containers):
                if c.parent in gone or (is_noise(c) and self._aside(c)):
                    gone.add(n)
            if gone:
                self.blocks = [b for b in self.blocks if b[0] not in gone]
                self._measure()

    def loose(self) -> set[int]:
        """Hashes of the blocks outside article and main."""
        return {_block_hash(text) for at, text, _ in self.blocks if not self.containers[at].inside}

    def drop_repeated(self, repeated: set[int]) -> None:
        """Blocks outside article and main that the host repeats go, unless they are half of the page's text."""
        kept = [b for b in self.blocks if self.containers[b[0]].inside or _block_hash(b[1]) not in repeated]
        if 2 * sum(len(b[1]) for b in kept) > self.containers[0].size:
            self.blocks = kept
            self._measure()

    def best(self) -> str | None:
        """The path of the deepest container that holds all text but noise; None without text."""
        size = self.containers[0].size
        return next(c.path for c in reversed(self.containers) if c.size == size) if size else None

    def text(self, winners: list[str]) -> str:
        """All blocks, or those in the winning path that holds most of them.

        A winning path counts if it lies in an article or main and leaves out no block of one, and if it holds
        TEXT_SHARE of the page's text.
        """
        kept, most = self.blocks, 0
        page = self.containers[0]
        for path in winners:
            inside: set[int] = set()
            for n, c in enumerate(self.containers):
                if c.path == path or c.parent in inside:
                    inside.add(n)
            blocks = [block for block in self.blocks if block[0] in inside]
            size = sum(len(text) for _, text, _ in blocks)
            whole = all(n in inside or not self.containers[n].inside for n, *_ in self.blocks)
            if size > most and size >= TEXT_SHARE * page.size and whole and any(c.inside for c in self.containers if c.path == path):
                kept, most = blocks, size
            elif size == page.size:
                return "\n".join(text for _, text, _ in self.blocks)
        return "\n".join(text for _, text, _ in kept)


def _block_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_template(pages: DataFrame) -> DataFrame:
    """(host, paths, repeated): the container paths that at least WINNING_SHARE of a host's pages voted for, and the
    hashes of blocks outside article and main that at least REPEATED_SHARE of them have.

    pages has host and html. Votes and blocks are counted before the shuffle, so a host with very many pages is no hot
    key; by their shares, what stays of a host is as small as a page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 200):
            rows = []
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                page = Page(source or "")
                rows.append((host, page.best() or "", None))
                rows += [(host, None, block) for block in page.loose()]
            columns = list(zip(*rows)) or [[], [], []]
            kinds = (pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "path", "block"])

    counted = pages.mapInArrow(run, "host string, path string, block long").groupBy("host", "path", "block").agg(F.count(F.lit(1)).alias("n"))
    counted = cut(counted.where((F.col("n") >= REPEATED_PAGES) | F.col("path").isNotNull()))
    total = counted.where("path is not null").groupBy("host").agg(F.sum("n").alias("all"))
    share = F.when(F.col("path").isNull(), REPEATED_SHARE).otherwise(WINNING_SHARE)
    won = counted.join(total, "host").where((F.col("n") >= share * F.col("all")) & ~F.coalesce(F.col("path") == "", F.lit(False)))
    return won.groupBy("host").agg(F.sort_array(F.collect_list("path")).alias("paths"), F.sort_array(F.collect_list("block")).alias("repeated"))


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """pages with _text: each page's main text, its blocks joined by line feeds; empty if it has none.

    Menus, headers, footers, sidebars, forms, scripts and styles go by their tags or roles. What only a class or id
    names as noise goes if its place, size or links tell against it as well. Every page votes for the generalised path
    (tags with their first class, numbers levelled) of the deepest container that holds all that is left; each is then
    read again at its host's winning paths, which only leave out text outside article and main, a fifth of a page at
    most. Blocks outside article and main that a host repeats on many pages go, unless they make up half of the page.

    A null page is empty, a null or malformed url belongs to the host "". Markup that is cut off or badly nested is
    read as far as it goes. Repeated rows vote each; other columns stay, but one named _text is replaced; an empty table
    stays empty. Hosts of up to broadcast_hosts are joined by broadcast, more over salts, with the same result.
    """
    kept = [c for c in pages.columns if c != "_text"]
    host = host_of(pages[url_col])
    won = cut(host_template(pages.select(host.alias("host"), pages[html_col].alias("html")))).select(F.col("host").alias("_h"), "paths", "repeated")
    rows = pages.select(F.struct(*(pages[c] for c in kept)).alias("_row"), host.alias("_host"), pages[html_col].alias("_html"))
    if won.count() <= broadcast_hosts:
        joined = rows.join(F.broadcast(won), F.col("_host") == F.col("_h"), "left")
    else:  # hosts with very many pages are dealt over salts
        salted = won.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("_html"), F.lit(SALTS)).cast("int"))
        joined = dealt.join(salted, (F.col("_host") == F.col("_h")) & (F.col("_salt") == F.col("_s")), "left")

    @F.pandas_udf("string")
    def main_text(source, paths, repeated):  # noqa: ANN001, ANN202
        import pandas as pd

        found = []
        for s, p, r in zip(source, paths, repeated):
            page = Page(s or "")
            if r is not None and len(r):
                page.drop_repeated(set(r.tolist()))
            found.append(page.text([] if p is None else list(p)))
        return pd.Series(found, dtype=object)

    return joined.select("_row", main_text("_html", "paths", "repeated").alias("_text")).select("_row.*", "_text")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))
