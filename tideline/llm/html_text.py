"""Main text of web pages: templates deduced from same-host pages, and the extraction of what remains."""

from __future__ import annotations

import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, materialize, string_weight
from .urls import host_of

#: A class of tokens is a template's if it has so many tokens and is on so many different pages of the host.
CLASS_SIZE, CLASS_PAGES = 2, 3
#: Tokens of templates that are broadcast at most; beyond that pages and templates are joined by shuffling.
TEMPLATE_TOKENS = 500_000

_MARKUP = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>", re.S
)
_TAG_START = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
NOISE = {"nav", "footer", "aside", "form", "script", "style", "noscript", "template", "head", "button", "select", "iframe", "svg", "canvas", "object", "dialog", "menu", "title", "textarea", "audio", "video", "map", "input", "datalist", "label"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "frameset",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Words of class, id or role that mark what is not article.
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "sponsor", "sponsored", "promo", "promotion", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "footer", "masthead",
    "comment", "comments", "disqus", "replies", "respond", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "related", "recommended", "widget", "pagination", "pager", "toolbar", "skip", "complementary", "contentinfo", "search",
}
#: Elements a paragraph ends at, and those that keep paragraphs around them open.
_ENDS_P = BLOCK - {"body", "html"}
_AROUND = {"applet", "button", "caption", "html", "marquee", "object", "table", "td", "template", "th"}


class Block(NamedTuple):
    text: str
    inside: bool  # in an article or main element
    token: int  # of the block among the page's tokens, by its place and text


def _hash(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


def _marked(attrs: str, inside: bool) -> bool:
    if not attrs or attrs.isspace():
        return False
    for m in _ATTR.finditer(attrs):
        name = m[1].lower()
        if name == "hidden":
            return True
        value = (m[2] or "").strip("\"'")
        if name in ("class", "id", "role"):
            words = {w.lower() for w in _WORD.findall(value)}
            if words & MARKS or ("header" in words and not inside):
                return True
        elif name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True
    return False


class Page:
    """Blocks of a page in order, and the tokens (tags by their path, blocks) that lie outside its article."""

    def __init__(self, html: str):
        self.blocks: list[Block] = []
        self.tokens: list[int] = []
        self.has_article = False
        self._stack: list[tuple[str, int, bool]] = []  # tag, kind of noise (2 an element's, 1 a mark's), article
        self._noise, self._inside = 0, 0
        self._buffer: list[str] = []
        self._paths = [0]  # hashes of the open elements' tags, from the outermost to each of them
        self._paragraphs = 0
        self._read(html)

    def _read(self, html: str) -> None:
        at, end = 0, len(html)
        while at < end:
            m = _MARKUP.search(html, at)
            if not m:
                # an unfinished tag at the end of the page is markup, too
                cut = html.rfind("<", at)
                self._text(html[at : cut if cut >= 0 and _TAG_START.match(html, cut) else end])
                break
            self._text(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self._close(tag)
                else:
                    self._open(tag, m[3])
                    if tag in RAW and not m[3].endswith("/"):
                        close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
                        at = close.start() if close else end
        self._flush()

    def _text(self, raw: str) -> None:
        if raw and not self._noise:
            self._buffer.append(unescape(raw) if "&" in raw else raw)

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            self._buffer = []
            if text:
                inside = self._inside > 0
                token = 0 if inside else _hash(str(self._paths[-1]), text)
                self.blocks.append(Block(text, inside, token))
                if not inside:
                    self.tokens.append(token)

    def _open(self, tag: str, attrs: str) -> None:
        if tag in BLOCK:
            self._flush()
        elif tag == "br":
            self._text("\n")
        if tag in _ENDS_P and self._paragraphs and self._in_paragraph():
            self._close("p")
        if tag == "li" and self._stack and self._stack[-1][0] == "li":
            self._close("li")
        if tag in VOID:
            return
        article = tag in ("article", "main")
        marked = _marked(attrs, self._inside > 0)
        noise = 2 if tag in NOISE or (tag == "header" and not self._inside) else 1 if marked else 0
        if article and not marked and not any(n == 2 for _, n, _ in self._stack):
            # a marked wrapper around the whole article is layout
            self._stack = [(t, 0, a) for t, _, a in self._stack]
            self._noise = 0
        if article and not noise and not self._noise:
            self.has_article = True
            self._inside += 1
        else:
            article = False
        self._stack.append((tag, noise, article))
        self._noise += noise > 0
        self._paragraphs += tag == "p"
        self._paths.append(_hash(str(self._paths[-1]), tag))
        if not self._inside:
            self.tokens.append(_hash(str(self._paths[-1]), "<"))

    def _in_paragraph(self) -> bool:
        for tag, _, _ in reversed(self._stack):
            if tag == "p":
                return True
            if tag in _AROUND:
                return False
        return False

    def _close(self, tag: str) -> None:
        for k in range(len(self._stack) - 1, -1, -1):
            if self._stack[k][0] == tag:
                break
        else:
            return
        if tag in BLOCK or any(t in BLOCK for t, _, _ in self._stack[k:]):
            self._flush()
        for t, noise, article in self._stack[k:]:
            self._noise -= noise > 0
            self._inside -= article
            self._paragraphs -= t == "p"
        del self._stack[k:]
        del self._paths[k + 1 :]


def text_of_page(page: Page, classes: list[tuple[int, list[list[int]]]]) -> str:
    """The blocks of the article; without one, the slots of the template: blocks no valid class contains.

    ``classes`` come by their number of pages. Only those on equally many pages must nest: of two others the one
    on fewer pages may be a section's template, whose parts lie among those of the whole site's.
    """
    if page.has_article:
        return "\n".join(b.text for b in page.blocks if b.inside)
    fixed = {t for _, some in classes for c in valid_classes(page.tokens, some) for t in c}
    return "\n".join(b.text for b in page.blocks if b.token not in fixed)


def valid_classes(tokens: list[int], classes: list[list[int]]) -> list[list[int]]:
    """Classes (tokens in template order) that the page has in that order and that nest: none crosses one that begins before it."""
    at = {t: k for k, t in enumerate(tokens)}
    placed = []
    for c in classes:
        where = [at[t] for t in c if t in at]
        if len(where) == len(c) and where == sorted(where):
            placed.append((where, c))
    placed.sort(key=lambda x: (x[0][0], -x[0][-1]))
    kept: list[tuple[list[int], list[int]]] = []
    for where, c in placed:
        # within the span of an earlier class it must lie in one slot, between two of its neighbours
        if all(bisect(w, where[0]) == bisect(w, where[-1]) for w, _ in kept):
            kept.append((where, c))
    return [c for _, c in kept]


_PARSED = "host string, key long, article boolean, shape long, once array<long>, more array<long>"


def _token_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page its tokens that occur once, in order, the others if it has no article, and a hash of its whole content."""
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for html in batch.column("html").to_pylist():
            page = Page(html)
            seen = Counter(page.tokens)
            once = [t for t in page.tokens if seen[t] == 1]
            more = [] if page.has_article else [t for t in seen if seen[t] > 1]
            shape = _hash(",".join(map(str, page.tokens)), *(b.text for b in page.blocks))
            for column, x in zip(out, (page.has_article, shape, once, more)):
                column.append(x)
        types = [pa.bool_(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("key"), *map(pa.array, out, types)], ["host", "key", "article", "shape", "once", "more"])


def templates(parsed: DataFrame) -> DataFrame:
    """(host, lead, pages, c): the equivalence classes of each host's templates, tokens in template order, by first token.

    Tokens outside articles with the same occurrence vector over the host's pages form a class. Vectors are
    compared by page count and fingerprint, so no host's pages meet in a task. A class has CLASS_SIZE tokens or
    more, on CLASS_PAGES pages or more, however large a share of the host's those are: a host may have many
    templates. Pages of equal content count once, since copies cannot tell a template from what fills it.
    """
    different = parsed.groupBy("host", "shape").agg(F.first("once").alias("once"))
    tokens = different.select("host", "shape", F.posexplode("once").alias("rank", "token"))
    sums = tokens.groupBy("host", "token").agg(F.count("*").alias("pages"), F.bit_xor("shape").alias("vector"), F.sum("rank").alias("rank")).where(F.col("pages") >= CLASS_PAGES)
    classes = sums.groupBy("host", "pages", "vector").agg(F.array_sort(F.collect_list(F.struct((F.col("rank") / F.col("pages")).alias("r"), "token"))).alias("c"))
    classes = classes.where(F.size("c") >= CLASS_SIZE).select("host", "pages", F.col("c.token").alias("c"))
    return classes.select(F.col("host").alias("__host"), F.col("c")[0].alias("__lead"), "pages", "c")


def classes_of_pages(parsed: DataFrame) -> DataFrame:
    """(__host, __key, classes, size): for each page without article the classes whose first token it has, by their number of pages.

    A token belongs to one class at most, so a page meets few of its host's classes and a large host's never meet.
    """
    plain = parsed.where("not article").groupBy(F.col("host").alias("__host"), F.col("key").alias("__key")).agg(F.first(F.concat("once", "more")).alias("tokens"))
    hosts = checked_broadcast(plain.select("__host").distinct(), TEMPLATE_TOKENS, string_weight("__host"))
    found = materialize(templates(parsed.join(hosts, F.col("host") == F.col("__host"), "left_semi")))
    found = checked_broadcast(found, TEMPLATE_TOKENS, F.size("c") + string_weight("__host"))
    met = plain.select("__host", "__key", F.explode("tokens").alias("__lead")).join(found, ["__host", "__lead"])
    by_pages = met.groupBy("__host", "__key", "pages").agg(F.collect_list("c").alias("c"), F.sum(F.size("c")).alias("size"))
    return by_pages.groupBy("__host", "__key").agg(F.collect_list(F.struct("pages", "c")).alias("classes"), F.sum("size").alias("size"))


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [text_of_page(Page(html), [(c["pages"], c["c"]) for c in classes or []]) for html, classes in zip(batch.column("html").to_pylist(), batch.column("classes").to_pylist())]
        # half a surrogate pair is no character
        texts = [t.encode("utf-8", "replace").decode() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of ``pages``.

    The main text is the text of the article or main element, without what elements or marks (class, id, role)
    show to be menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or comments. A page
    without such an element keeps the slots of its host's template. Blocks come in page order, one line each,
    white space within them as one space. A null html is empty; nothing found is an empty text; a null url is a
    host of its own; repeated rows stay; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("key", F.xxhash64("page_id", "url", "html"))
    parsed = materialize(rows.select("host", "key", "html").mapInArrow(_token_batches, _PARSED))
    found = checked_broadcast(materialize(classes_of_pages(parsed)), TEMPLATE_TOKENS, F.col("size") + string_weight("__host"))
    joined = rows.join(found, (F.col("host") == F.col("__host")) & (F.col("key") == F.col("__key")), "left").select("page_id", "url", "html", "classes")
    kind = pages.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(_text_batches, f"page_id {kind}, url string, text string, n_chars long")
