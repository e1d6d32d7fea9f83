"""Main text of web pages: page structure first, host suffix arrays where structure does not decide.

Suffix arrays alone do not give right results: passages that several articles share are removed with the boilerplate,
and menus or adverts that differ from page to page stay (README has figures). So elements decide where a page has an
article or main element: its blocks are kept, without the menus, headers, footers, sidebars, notices, adverts, forms and
comments inside it. Pages without such an element are decided by the host: near copies (verified as in near dedup) count
as one page; the token streams are cut into all their windows of `depth` tokens, and a window is boilerplate if it is
found on a tenth of the host's distinct pages, at least three; a whole block may be on two. Tokens that boilerplate covers
are removed; the runs of the others stay. Where two pages or near copies are all that a host has, nothing is removed.

Windows of `depth` tokens find the same covered tokens as a whole suffix array, since a repeated substring of at least
that length is covered by its windows. Pages are counted by host, window and page first, so a hot host or window is many
keys.

Defined results: null html gives an empty text; markup that never ends takes the rest of the page with it; a null address is a host of its own; a null identifier passes through;
repeated rows count as one page for repetition and each get a row; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import short_batches, stored
from netloom.llm.near_dup import near_duplicates

#: A tag: name and attributes as browsers read them. Every part is possessive, so each character is read once; a quote
#: that is never closed is part of a name, and the tag ends at its next `>`.
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?=>)|[^\s>\"'][^\s>]*+))?+)*+)>")
_COMMENT_END = re.compile(r"--!?>")
#: Decimal references too long for Python's integers.
_LONG_REFERENCE = re.compile(r"&#([0-9]{8,});?")
_ATTR = re.compile(r"(?:^|\s|/)(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.I)
#: Elements whose content is not markup.
_RAW = {"script", "style", "textarea", "title", "xmp", "noscript", "iframe", "noembed", "noframes"}
#: Elements that hold no text of their own or are not the page's text.
_DROP = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "template", "svg", "math", "object", "audio", "video", "canvas", "fieldset", "head", "map"}
#: Elements that nest and have to be closed.
_NEST = _DROP | {"html", "body", "article", "main", "header", "div", "section", "ul", "ol", "dl", "table", "figure", "details", "blockquote", "hgroup", "center"}
_BLOCK = _NEST | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "pre", "hr", "address", "figcaption", "summary", "legend", "option"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "alertdialog", "menu", "menubar"}
#: Words in class or id that mark what is not the article.
_HINT = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banners?|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|comments?|disqus|respond|replies|sidebars?|menus?|nav|navbar|navigation|breadcrumbs?|masthead|header|footer|social|shar(?:e|ing)|related|recommend\w*|newsletter|subscribe|popup|modal|overlay|widgets?|toolbar|pagination|pager|skip)(?=$|[\s_-])",
    re.I,
)
_COMMENT = re.compile(r"(?:^|[\s_-])(?:comments?|repl(?:y|ies)|respond)(?=$|[\s_-])", re.I)

#: The share of a host's distinct pages from which a repeated substring is boilerplate.
SHARE = 0.1


def _marks(tag: str, attrs: str) -> tuple[bool, bool]:
    """Whether an element is left out, and whether its role makes it the main part."""
    if tag in _DROP:
        return True, False
    if not attrs or tag in ("html", "body"):
        return False, False
    main = False
    for name, *values in _ATTR.findall(attrs):
        value, name = "".join(values), name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True, False
        if name == "role":
            main |= value.lower() == "main"
            if value.lower() in _ROLES:
                return True, False
        elif name in ("class", "id") and tag != "main" and (_COMMENT if tag == "article" else _HINT).search(value):
            return True, False
    return False, main


def _decoded(text: str) -> str:
    """Character references decoded, white space as one space."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0")
        return f"&#{digits or 0};" if len(digits) < 8 else "\ufffd"

    return " ".join(html.unescape(_LONG_REFERENCE.sub(short, text) if "&#" in text else text).split())


def _markup(page: str) -> Iterator[tuple[int, int, re.Match | None]]:
    """(start, end, tag) of each piece of markup; the tag is None for comments, declarations and raw content.

    One forward pass. Markup that never ends takes all that follows it, as in browsers; no later place is tried for it
    again, so a page's time grows with its length."""
    at, end, last = 0, len(page), page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        after = page[start + 1 : start + 2]
        named = page[start + 2 : start + 3] if after == "/" else after
        if not (after in ("/", "!", "?") and after or named.isalpha() and named.isascii()):
            at = start + 1
            continue
        tag = None
        if start > last:
            at = end
        elif page.startswith("<!--", start):
            if page.startswith((">", "->"), start + 4):
                at = page.index(">", start) + 1
            else:
                close = _COMMENT_END.search(page, start + 4)
                at = end if close is None else close.end()
        elif named.isalpha() and named.isascii():
            tag = _TAG.match(page, start)
            at = end if tag is None else tag.end()
        else:
            at = page.index(">", start) + 1
        yield start, at, tag
        if tag is not None and not tag[1] and (name := tag[2].lower()) in _RAW:
            close = _raw_end(name).search(page, at)
            stop = -1 if close is None else page.find(">", close.end())
            at = end if stop < 0 else stop + 1
            yield tag.end(), at, None


@functools.cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{name}(?=[\s/>])", re.I)


def page_blocks(page: str | None) -> tuple[bool, list[str]]:
    """Whether the structure decides, and the blocks in page order: of the articles, else of the main element, else of
    the body without what is marked as something else."""
    page = page or ""
    found: dict[str, list[str]] = {"article": [], "main": [], "body": []}
    stack: list[tuple[str, bool, str]] = []
    # How many elements of a name are open: an end without a start is seen at once, and every start is closed once.
    opened: Counter[str] = Counter()
    zone, out = "body", False
    text: list[str] = []

    def flush() -> None:
        if text:
            block = _decoded("".join(text))
            text.clear()
            if block and not out:
                found[zone].append(block)

    at = 0
    for start, after, m in _markup(page):
        if start > at and not out:
            text.append(page[at:start])
        at = after
        if m is None:
            continue
        tag = m[2].lower()
        if tag == "br":
            text.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        if tag not in _NEST:
            continue
        if m[1]:
            while opened[tag]:
                name, out, zone = stack.pop()
                opened[name] -= 1
                if name == tag:
                    break
        elif not m[3].endswith("/"):
            stack.append((tag, out, zone))
            opened[tag] += 1
            dropped, main = _marks(tag, m[3])
            out = out or dropped or tag == "header" and zone == "body"
            if not out and tag == "article":
                zone = "article"
            elif not out and (tag == "main" or main) and zone == "body":
                zone = "main"
    if not out:
        text.append(page[at:])
    flush()
    for name in ("article", "main"):
        if found[name]:
            return True, found[name]
    return False, found["body"]


def _parsed(pages: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [page_blocks(p) for p in batch.column(2).to_pylist()]
            text = [("\n\n".join(b) if d or not b else None) for d, b in got]
            open_blocks = [(None if d or not b else b) for d, b in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(open_blocks, pa.list_(pa.string()))], names=["page_id", "url", "text", "blocks"])

    return pages.mapInArrow(run, "page_id long, url string, text string, blocks array<string>")


def unique_runs(pages: DataFrame, depth: int = 8, least_run: int = 1, share: float = 0.0, least_pages: int = 2, copy_col: str | None = None) -> DataFrame:
    """row, text: of pages (row, host, blocks), what host suffix arrays leave. `depth`: tokens that a repeated substring
    has at least. Tokens covered by one that is found in `share` of the host's distinct pages, at least `least_pages`, go,
    and so do whole blocks found in that share and on two; rows with one value of `copy_col` count as one page. Of the
    other tokens, runs inside a block of at least `least_run` stay, and blocks are joined by an empty line."""
    tokens = F.flatten(F.transform("blocks", lambda b, k: F.transform(F.split(b, " "), lambda w: F.struct(k.alias("block"), w.alias("word")))))
    p = pages.select("row", F.coalesce("host", F.lit("")).alias("host"), "blocks", tokens.alias("t"), (F.xxhash64("blocks") if copy_col is None else F.col(copy_col)).alias("digest"))
    words = F.transform("t", lambda x: x["word"])
    p = p.select("row", "host", "blocks", "t", "digest", words.alias("words"))
    # Windows are made inside their row: an exploded row holds its own window only, never the page.
    window = F.transform(F.sequence(F.lit(1), F.size("words") - (depth - 1)), lambda at: F.struct(at.alias("at"), F.array_join(F.slice("words", at, F.lit(depth)), " ").alias("key")))
    suffixes = p.filter(F.size("words") >= depth).select("row", "host", "digest", F.explode(window).alias("s")).select("row", "host", "digest", "s.at", "s.key")
    of_host = p.select("host", "digest").distinct().groupBy("host").agg(F.ceil(F.count(F.lit(1)) * share).alias("least"))

    def repeated(keys: DataFrame, least: int) -> DataFrame:
        n = keys.select("host", "key", "digest").distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
        return n.join(of_host, "host").filter("n >= least").select("host", "key")

    hits = suffixes.join(repeated(suffixes, least_pages), ["host", "key"], "left_semi").select("row", F.explode(F.sequence(F.col("at") - 1, F.col("at") + (depth - 2))).alias("pos")).distinct()
    each = p.select("row", F.posexplode("t").alias("pos", "tok")).join(hits, ["row", "pos"], "left_anti")
    if least_pages > 2:
        blocks = p.select("row", "host", "digest", F.posexplode("blocks").alias("block", "key")).filter(F.size(F.split("key", " ")) >= depth)
        gone = blocks.join(repeated(blocks, 2), ["host", "key"], "left_semi").select("row", "block")
        each = each.withColumn("block", F.col("tok.block")).join(gone, ["row", "block"], "left_anti")
    runs = each.groupBy("row", F.col("tok.block").alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", F.col("tok.word").alias("word")))).alias("words"))
    runs = runs.filter(F.size("words") >= least_run).select("row", "block", F.array_join(F.transform("words", lambda x: x["word"]), " ").alias("text"))
    return runs.groupBy("row").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "text"))), lambda x: x["text"]), "\n\n").alias("text"))


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", depth: int = 8) -> DataFrame:
    """page_id, url, text, n_chars for each row of df."""
    short_batches(df.sparkSession)
    parsed = stored(_parsed(df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))), "pages")
    done = parsed.filter("blocks IS NULL").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    host = F.lower(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1))
    undecided = parsed.filter("blocks IS NOT NULL").select("page_id", "url", host.alias("host"), "blocks", F.monotonically_increasing_id().alias("row"))
    undecided = stored(undecided, "undecided")
    if undecided.isEmpty():
        return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
    copies = near_duplicates(undecided.select("row", F.array_join("blocks", " ").alias("text")), id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("copy"))
    pages = undecided.select("row", "host", "blocks").join(copies, "row")
    rest = undecided.select("row", "page_id", "url").join(unique_runs(pages, depth, share=SHARE, least_pages=3, copy_col="copy"), "row", "left").select("page_id", "url", F.coalesce("text", F.lit("")).alias("text"))
    return done.unionByName(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
