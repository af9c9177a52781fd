"""Main text of web pages by tree scoring.

A page is read once into a list of its block elements. Blocks that hold text are paragraphs; each passes
points for its length and commas to its parent and half of them to the parent above, and a container's
points are discounted by the share of its text that is link text. The best container is kept, with those
siblings that look like parts of the same article. Menus, headers, footers, sidebars, notices, adverts,
forms, scripts, styles and comments are left out wherever they stand.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(?P<raw>script|style|noscript|template|svg|math|iframe|object|textarea|title|select|button)\b(?:[^>"']++|"[^"]*+"|'[^']*+')*+>
        (?:.*?</(?P=raw)\s*>|.*\Z)
      | <(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
      | <[a-z/!?][^>]*+(?:>|\Z)""",
    re.S | re.I | re.X,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+")

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
PARAGRAPH = frozenset("p pre li td th dt dd h1 h2 h3 h4 h5 h6 blockquote figcaption caption".split())
#: Closed by their own next one, up to the container that may hold several.
REPEAT = {"p": (), "li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}
ROOTS = frozenset("html body main article".split())
DROPPED = frozenset("head nav aside footer header menu dialog input label optgroup option".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark what is no article, and those that outweigh the weaker marks.
NEVER = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner cookie cookies consent "
    "gdpr comment comments commentlist disqus respond reply replies share sharing social related recommended recommendations newsletter "
    "subscribe subscription popup modal overlay breadcrumb breadcrumbs pagination pager nav navbar navigation menu menus footer login "
    "signup register search skip".split()
)
RARELY = frozenset("header masthead sidebar side aside widget widgets notice notices alert hidden toolbar tools meta byline tags".split())
LIKELY = frozenset("article body content main entry post story text page column".split())
#: Where nothing else is found, parts left out by their class stand for the article if their plain text is so long.
PROSE = 250


def _left_out(tag: str, attrs: str, in_article: bool) -> int:
    """2: left out for good; 1: by a class or id, so unless nothing else holds text; 0: not. A class that
    is content by all its words is not overruled by another that only mentions what is no article
    (content has-ads). An article's own header stays."""
    if tag in DROPPED and not (tag == "header" and in_article):
        return 2
    if not attrs or tag in ROOTS:
        return 0
    names: list[set[str]] = []
    for m in ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            names += [set(WORD.findall(name)) for name in value.split()]
        elif key == "role" and value.strip() in ROLES:
            return 2
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return 2
    never, every = any(n & NEVER for n in names), set().union(*names)
    if never and (any(n and n <= NEVER for n in names) or not any(n and n <= LIKELY for n in names)):
        return 1
    return int(bool(every & RARELY) and not every & LIKELY)


def _semantic(tag: str, attrs: str) -> bool:
    return tag in ("article", "main") or "articlebody" in attrs.lower()


class _Block:
    __slots__ = ("tag", "parent", "out", "best", "article", "start", "end", "chars", "commas", "linked", "points")

    def __init__(self, tag: str, parent: _Block | None, out: bool, best: bool, start: int):
        self.tag, self.parent, self.out, self.best, self.start, self.end = tag, parent, out, best, start, -1
        self.article = tag == "article" or parent is not None and parent.article
        self.chars = self.commas = self.linked = 0
        self.points = 0.0


def _read(page: str, least: int) -> tuple[list[_Block], list[str]]:
    """The blocks in page order, and the texts; a block's texts are those from its start to its end. Left
    out is what ``_left_out`` gives ``least`` or more."""
    root = _Block("#page", None, False, False, 0)
    blocks, texts, stack, links = [root], [], [root], 0

    def close(depth: int) -> None:
        while len(stack) > depth:
            stack.pop().end = len(texts)
        texts.append(" ")

    def text(data: str) -> None:
        if data:
            if "&" in data:
                data = html.unescape(data)
            block = stack[-1]
            texts.append("" if block.out else data)
            n = len(data) if not data.isspace() else 0
            block.chars += n
            block.commas += data.count(",") if n else 0
            block.linked += n if links else 0

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if (tag := m["tag"]) is None:
            continue
        tag = tag.lower()
        if tag == "a":
            links = 0 if m["close"] else 1
        if tag in INLINE:
            continue
        if tag in VOID:
            texts.append(" ")
        elif m["close"]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    links = 0
                    break
        else:
            for depth in range(len(stack) - 1, 0, -1):  # what this element ends
                open_tag = stack[depth].tag
                if open_tag == "p" or open_tag == tag and tag in REPEAT:
                    close(depth)
                    break
                if open_tag not in PARAGRAPH or tag in REPEAT and open_tag in REPEAT[tag]:
                    break
            texts.append(" ")
            attrs = m["attrs"]
            parent = stack[-1]
            out = parent.out or _left_out(tag, attrs, parent.article) >= least
            block = _Block(tag, parent, out, _semantic(tag, attrs), len(texts))
            blocks.append(block)
            stack.append(block)
            links = 0
    text(page[at:])
    close(0)
    return blocks, texts


def _totals(blocks: list[_Block]) -> dict[int, list[int]]:
    """Characters and link characters of each block with all that it holds."""
    whole = {id(b): [b.chars, b.linked] for b in blocks}
    for b in reversed(blocks):  # parents come first
        if b.parent is not None:
            above, own = whole[id(b.parent)], whole[id(b)]
            above[0] += own[0]
            above[1] += own[1]
    return whole


def _without_forms(blocks: list[_Block], texts: list[str]) -> list[_Block]:
    """Forms and fieldsets are left out but for those that hold most of the page's plain text."""
    if not any(b.tag in ("form", "fieldset") for b in blocks):
        return blocks
    whole = _totals(blocks)
    plain = {k: chars - linked for k, (chars, linked) in whole.items()}
    for b in blocks:
        b.out = b.parent is not None and b.parent.out or b.tag in ("form", "fieldset") and 2 * plain[id(b)] <= plain[id(blocks[0])]
        if b.out and not b.parent.out:
            texts[b.start : b.end] = [""] * (b.end - b.start)
    return [b for b in blocks if not b.out]


def main_text(page: str | None) -> str:
    """The article of a page: character references decoded, white space within a block turned into one
    space, blocks in page order joined by one space. Empty for a null or empty page and where no block
    outside the left-out parts holds text; if parts left out by their class then hold much plain text,
    that is taken. Malformed and cut-off pages are read as far as they go."""
    found = _main_text(page or "", 1)
    if not found:
        found = _main_text(page or "", 2)
        found = found if len(found) >= PROSE else ""
    return found


def _main_text(page: str, least: int) -> str:
    blocks, texts = _read(page, least)
    blocks = _without_forms([b for b in blocks if not b.out], texts)
    whole = _totals(blocks)
    for b in blocks:
        if not b.chars:
            continue
        points = (b.commas + 1 + b.chars / 100) * (1 - b.linked / b.chars)
        if b.tag in PARAGRAPH and b.parent is not None:
            b.parent.points += points
            if b.parent.parent is not None:
                b.parent.parent.points += points / 2
        else:
            b.points += points
            if b.parent is not None:
                b.parent.points += points / 2

    def score(b: _Block) -> float:
        chars, linked = whole[id(b)]
        return b.points * (1 - linked / chars) if chars else 0.0

    top = max(blocks, key=score)  # the first of equals
    if score(top) <= 0:
        return ""
    above, marked = top, False
    while above is not None:  # a part of a marked article stands for all of it
        if above.best:
            top, marked = above, True
        above = above.parent
    enough = max(10.0, 0.2 * score(top))

    def belongs(b: _Block) -> bool:
        """The best container; its siblings that score well; where no element is marked as the article, all
        siblings that are text and not links: headings and paragraphs of any length, others from 80
        characters on."""
        if b is top:
            return True
        chars, linked = whole[id(b)]
        if b.parent is not top.parent or not chars:
            return False
        plain = linked < 0.25 * chars
        if score(b) >= enough or b.tag == "p" and chars > 80 and plain:
            return True
        return not marked and plain and (b.tag in PARAGRAPH or chars > 80)

    kept = [b for b in blocks if belongs(b)]
    return " ".join(" ".join("".join(texts[b.start : b.end]) for b in kept).split())


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) for every row of ``pages``, repeated rows each; null html gives an empty
    text, null ids and urls stay null. Other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([main_text(x.as_py()) for x in batch.column(2)], pa.string())
            yield pa.record_batch([batch.column(0), batch.column(1), found], names=["id", "url", "text"])

    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("h"))
    found = rows.mapInArrow(run, f"id {kind}, url string, text string")
    return found.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
