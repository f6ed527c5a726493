"""Main text of web pages by tag-path ratios.

A page is a sequence of blocks of text, each under a path of tags from the root to its leaf. Per path the text
length and the punctuation are summed over the page; their ratios to the number of blocks, smoothed over neighbouring
blocks and fused with link density, with being inside an article or main element and with class and id names, separate content paths from boilerplate ones. Elements that never
hold content (scripts, forms, navigation, ...) are left out beforehand by what they are.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from careledger.llm.storage import bounded_batches, tidy

# Elements of HTML by what they do.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
NEVER = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "svg", "math", "canvas", "object", "audio", "video", "map", "datalist", "label", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br"}
#: Start tags that end an open element of the same kind.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
ENDS_P = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
STOP = {"table", "ul", "ol", "dl", "body", "html", "article", "section", "div", "main", "blockquote"}
#: Parts of class and id names that are a penalty: those of boilerplate, and those that content has as well.
BOILER = re.compile(
    r"(?:^|[_-])(?:(ads?|advert\w*|adsense|adslot|banner\w*|promo\w*|sponsor\w*|nav\w*|menu\w*|breadcrumbs?|footer|masthead|topbar|sidebar\w*|widget\w*|share|sharing"
    r"|cookies?|gdpr|popup|newsletter|subscribe|signup|login|comments?\w*|commentlist|disqus|replies|reply|pagination|pager|copyright|toolbar)"
    r"|(header|side|related|recommend\w*|social|consent|notice\w*|modal|overlay|subscription|respond|legal|skip|tags?|meta|byline))(?:$|[_-])",
    re.I,
)
#: Names that say what stands beside an element, not what it is.
BESIDE = re.compile(r"(?:has|no|not|with|without|layout)[_-]", re.I)
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"[\s/]*+(=?[^\s/>=]*+)(\s*+=\s*+)?+")
BARE_VALUE = re.compile(r"[^\s>]*+")
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
SPACES = re.compile(r"\s+")
PUNCT = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ITEMS = {"li", "dt", "dd", "td", "th", "caption", "figcaption", "pre"}
#: Names that make an article element one of the readers' comments.
SAID = re.compile(r"(?:^|[_-])(?:comments?\w*|reply|replies|respond)(?:$|[_-])", re.I)
#: Weight of blocks inside an article or main element; marks a block from which on text in links counts as prose.
INSIDE, PROSE = 4, 3
#: Factors for names of boilerplate and for names that content has as well; share of a page's text from which on a name is no penalty.
NAMED, MAYBE_NAMED, MOST = 0.003, 0.3, 2 / 3
#: The same share for names of readers' comments inside an article or main element, which may be longer than the article.
MOST_SAID = 0.95


@dataclass
class Block:
    """A piece of text: path is the number of its tag path, name that of the innermost name around most of it (-1: none)."""

    path: int
    text: str
    linked: int
    inside: bool
    name: int
    heading: bool
    item: bool


@dataclass
class Open:
    """An open element. path, item and name hold for what is in it; block and closer are the places of the nearest elements, itself included, that are no inline ones, or that an end may be implied for."""

    tag: str
    skipped: bool
    path: int
    item: bool
    name: int
    block: int
    closer: int


class Names:
    """Class and id names of boilerplate as a forest: each has the one around it, the path of its element, and whether only boilerplate has it."""

    def __init__(self):
        self.up: list[int] = []
        self.part: list[str] = []
        self.sure: list[bool] = []
        self.most: list[float] = []
        self._known: dict[tuple[int, int, str], int] = {}

    def add(self, up: int, path: int, part: str, sure: bool, inside: bool) -> int:
        k = self._known.setdefault((up, path, part), len(self.up))
        if k == len(self.up):
            self.up.append(up), self.part.append(part), self.sure.append(sure), self.most.append(MOST_SAID if inside and SAID.search(part) else MOST)
        return k

    def held(self, own: dict[int, int]) -> list[int]:
        """Sum of ``own`` in each name and those in it."""
        total = [own.get(k, 0) for k in range(len(self.up))]
        for k in range(len(total) - 1, -1, -1):
            if self.up[k] >= 0:
                total[self.up[k]] += total[k]
        return total

    def spans(self) -> tuple[list[int], list[int]]:
        """First and last number of each name in an order in which what is in a name follows it without a gap."""
        size = self.held(dict.fromkeys(range(len(self.up)), 1))
        first, free = [], []
        at = 0
        for k, up in enumerate(self.up):
            if up < 0:
                first.append(at)
                at += size[k]
            else:
                first.append(free[up])
                free[up] += size[k]
            free.append(first[k] + 1)
        return first, [f + n - 1 for f, n in zip(first, size, strict=True)]


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int, bool]:
    """(attributes, place after the tag, whether it closes itself) of a tag whose name ends at ``at``; a quote without an end ends with the tag."""
    found: dict[str, str] = {}
    end = len(page)
    while True:
        m = ATTRIBUTE.match(page, at)
        at = m.end()
        if at >= end:
            return found, end, False
        if m[1]:
            value = ""
            if m[2]:
                quote = page[at]
                if quote in "\"'" and last[quote] > at:
                    stop = page.index(quote, at + 1)
                    value, at = page[at + 1 : stop], stop + 1
                else:
                    bare = BARE_VALUE.match(page, at)
                    value, at = bare[0].strip("\"'"), bare.end()
            found.setdefault(m[1].lower(), value)
        elif page[at] == ">":
            return found, at + 1, page[at - 1] == "/"
        elif not m[0]:
            at += 1


def _is_boilerplate(tag: str, attrs: dict[str, str], inside_article: bool) -> bool:
    if tag in NEVER or (tag == "header" and not inside_article):
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display:\s*none|visibility:\s*hidden", attrs.get("style", ""), re.I):
        return True
    return attrs.get("role", "").lower() in ROLES


def _names(tag: str, attrs: dict[str, str], inside: bool) -> list[tuple[str, bool]]:
    """What the element's class and id names say: (part of a name, whether only boilerplate has it). Of an article element only the names of a reader's comment count, unless it is in another one."""
    if tag in ("html", "body", "main"):
        return []
    found = []
    for k in ("class", "id", "itemprop"):
        for name in attrs.get(k, "").split():
            plain = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name)
            m = None if BESIDE.match(name) else BOILER.search(plain)
            if m and (tag != "article" or inside or SAID.search(plain)):
                found.append(((m[1] or m[2]).lower(), m[1] is not None))
    return found


class Parser:
    """Blocks of a page in one pass: each step looks at the next tag and the top of the stack only, so the time is in proportion to the page, however it is nested or broken."""

    def __init__(self, page: str):
        self.page, self.names, self.blocks = page, Names(), []
        self.stack: list[Open] = []
        self.open: dict[str, int] = defaultdict(int)
        self.paths: dict[tuple[int, str], int] = {}
        self.parts: list[str] = []
        self.linked, self.under = 0, defaultdict(int)
        self.unclosed: set[str] = set()
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.parse()

    def inside(self) -> bool:
        return bool(self.open["article"] or self.open["main"])

    def flush(self) -> None:
        if not self.parts:
            return
        text = SPACES.sub(" ", "".join(self.parts)).strip()
        if text:
            top = self.stack[-1] if self.stack else None
            leaf = self.stack[top.block].tag if top and top.block >= 0 else ""
            self.blocks.append(Block(top.path if top else 0, text, self.linked, self.inside(), max(self.under, key=self.under.get), leaf in HEADINGS, bool(top and top.item)))
        self.parts, self.linked = [], 0
        self.under.clear()

    def pop(self, to: int) -> None:
        if self.stack[-1].block >= to:
            self.flush()
        for x in self.stack[to:]:
            self.open[x.tag] -= 1
        del self.stack[to:]

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else None
        if top and top.skipped:
            return
        text = html.unescape(raw)
        n = len(text.strip())
        self.parts.append(text)
        self.under[top.name if top else -1] += n
        if self.open["a"]:
            self.linked += n

    def end_tag(self, tag: str) -> None:
        if not self.open[tag]:
            return
        k = len(self.stack) - 1
        while self.stack[k].tag != tag:
            k -= 1
        self.pop(k)

    def imply_ends(self, tag: str) -> None:
        if tag in ENDS_P and self.stack and self.stack[-1].block >= 0 and self.stack[self.stack[-1].block].tag == "p":
            self.pop(self.stack[-1].block)
        ends = CLOSES.get(tag)
        k = self.stack[-1].closer if ends and self.stack else -1
        while k >= 0 and self.stack[k].tag not in STOP:
            if self.stack[k].tag in ends:
                self.pop(k)
                break
            k = self.stack[k - 1].closer if k else -1

    def start_tag(self, tag: str, attrs: dict[str, str]) -> None:
        self.imply_ends(tag)
        inline = tag in INLINE
        if not inline:
            self.flush()
        at, top = len(self.stack), self.stack[-1] if self.stack else Open("", False, 0, False, -1, -1, -1)
        inside = self.inside()
        skipped = top.skipped or _is_boilerplate(tag, attrs, inside)
        kind = attrs.get("class", "").split()
        path, name = top.path, top.name
        if not inline:
            path = self.paths.setdefault((path, f"{tag}.{kind[0]}" if kind else tag), len(self.paths) + 1)
        if attrs and not skipped:
            for part, sure in _names(tag, attrs, inside):
                name = self.names.add(name, path, part, sure, inside)
        self.stack.append(Open(tag, skipped, path, top.item or tag in ITEMS, name, top.block if inline else at, at if tag in STOP or tag in CLOSES else top.closer))
        self.open[tag] += 1

    def parse(self) -> None:
        page, at, end = self.page, 0, len(self.page)
        while at < end:
            lt = page.find("<", at)
            if lt < 0:
                break
            after = page[lt + 1 : lt + 2]
            m = TAG_NAME.match(page, lt + 2 if after == "/" else lt + 1)
            if not m and after not in ("!", "?", "/"):
                self.text(page[at : lt + 1])  # a lone sign, not a tag
                at = lt + 1
                continue
            if lt > at:
                self.text(page[at:lt])
            if not m:
                stop = "-->" if page.startswith("<!--", lt) else "]]>" if page.startswith("<![CDATA[", lt) else ">"
                to = page.find(stop, lt + (4 if stop == "-->" else 1))
                if stop == "]]>":
                    self.text(html.escape(page[lt + 9 : to if to >= 0 else end]))
                at = to + len(stop) if to >= 0 else end
                continue
            tag = m[0].lower()
            attrs, at, alone = _attributes(page, m.end(), self.last)
            if after == "/":
                self.end_tag(tag)
            elif tag in RAW:
                close = None if tag in self.unclosed else RAW_END[tag].search(page, at)
                if close:
                    at = page.find(">", close.end() - 1) + 1 or end
                else:
                    self.unclosed.add(tag)
                    at = end if tag in ("script", "style") else at
            elif tag in VOID:
                if tag == "br":
                    self.parts.append(" ")
                    self.under[self.stack[-1].name if self.stack else -1] += 0
                elif tag == "hr":
                    self.flush()
            elif not (alone and tag in ("path", "circle", "rect", "use")):
                self.start_tag(tag, attrs)
        if at < end:
            self.text(page[at:])
        self.flush()


def main_text(page: str | None) -> str:
    """The article of a page: its content blocks in order, joined by line feeds; empty for a null, empty or textless page.

    On every page blocks are kept by the fused ratio of their path: text and punctuation per block, smoothed over the neighbours in the same
    zone, against the page's own mean. Being inside an article or main element is one weight in it. Text in links counts as far as it is
    punctuated, and blocks that are mostly links without it are left out. Names of classes and ids are a penalty, but not those of elements
    that hold most of the page's text. Headings follow the block after them; lists and tables in an
    article or main element follow the text around them.
    """
    parsed = Parser(page or "")
    blocks, names = parsed.blocks, parsed.names
    if not blocks:
        return ""
    n = len(blocks)
    count: dict[int, int] = defaultdict(int)
    chars: dict[int, int] = defaultdict(int)
    links: dict[int, int] = defaultdict(int)
    marks: dict[int, int] = defaultdict(int)
    dots = [len(PUNCT.findall(b.text)) for b in blocks]
    for b, d in zip(blocks, dots, strict=True):
        count[b.path] += 1
        chars[b.path] += len(b.text)
        links[b.path] += min(b.linked, len(b.text))
        marks[b.path] += d
    ratio = {p: (chars[p] - links[p] * max(0.0, 1 - marks[p] / k / PROSE)) / k * (1 + marks[p] / k) for p, k in count.items()}
    # What names hold of the page's text; text in an article or main element weighs more.
    own: dict[int, int] = defaultdict(int)
    whole = 0
    for b in blocks:
        weight = (len(b.text) - min(b.linked, len(b.text))) * (INSIDE if b.inside else 1)
        whole += weight
        own[b.name] += weight
    penalty = [1.0] * len(names.up)
    for k, held in enumerate(names.held(own)):
        around = penalty[names.up[k]] if names.up[k] >= 0 else 1.0
        penalty[k] = min(around, (NAMED if names.sure[k] else MAYBE_NAMED) if held < names.most[k] * whole else 1.0)
    factor = [penalty[b.name] if b.name >= 0 else 1.0 for b in blocks]
    zone = [(b.inside, f) for b, f in zip(blocks, factor, strict=True)]
    raw = [math.log1p(ratio[b.path]) for b in blocks]
    near = lambda i, j: raw[j] if 0 <= j < n and zone[j] == zone[i] else raw[i]
    # Neighbours lift a block of prose; a small one doesn't pull down its neighbour's path.
    score = [math.expm1(max(raw[i], (0.5 * raw[i] + 0.25 * near(i, i - 1) + 0.25 * near(i, i + 1)) * (marks[b.path] > 0))) * (INSIDE if b.inside else 1) * factor[i] for i, b in enumerate(blocks)]
    # Boilerplate by name has no part in the mean if there is other text.
    counted = [s for s, f in zip(score, factor, strict=True) if f != NAMED] or score
    level = 0.1 * sum(counted) / len(counted)

    def listed(i: int) -> bool:
        b = blocks[i]
        part, all_, d = (links[b.path], chars[b.path], marks[b.path] / count[b.path]) if b.inside else (b.linked, len(b.text), dots[i])
        return part >= 0.5 * all_ and d < PROSE

    keep = [score[i] >= level and not listed(i) for i in range(n)]
    # Items between blocks of text: kept with either neighbour of their run.
    i = 0
    while i < n:
        j = i
        while j < n and blocks[j].inside and blocks[j].item:
            j += 1
        if j > i and ((i > 0 and zone[i - 1] == zone[i] and keep[i - 1]) or (j < n and zone[j] == zone[i] and keep[j])):
            for k in range(i, j):
                keep[k] = not listed(k)
        i = max(j, i + 1)
    # A heading goes with what follows it; one in a header of its own with what comes after that header.
    first, last = names.spans()
    own_header = [b.name if b.heading and b.name >= 0 and names.part[b.name] == "header" else -1 for b in blocks]
    beyond: dict[int, int] = {}  # of a header: the block after the run that its last heading seen is in
    for i in range(n - 2, -1, -1):
        if not blocks[i].heading:
            continue
        j, header = i + 1, own_header[i]
        if header >= 0:
            while j < n - 1 and blocks[j].name >= 0 and first[header] <= first[blocks[j].name] <= last[header]:
                j = max(j + 1, beyond.get(own_header[j], 0))
            beyond[header] = j
        keep[i] = keep[j]
    return "\n".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars. Narrow: pages are never shuffled and each is parsed whole, on its own.

    A null or empty html gives an empty text; null ids and urls stay null, repeated rows are rows like others. Broken and very long pages are parsed
    in time in proportion to their length. An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(pages.sparkSession)
    id_type = pages.schema[id_col].dataType.simpleString()

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            text = [main_text(x) for x in batch["html"]]
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": text, "n_chars": [len(x) for x in text]})

    rows = pages.selectExpr(f"`{id_col}` as page_id", f"`{url_col}` as url", f"`{html_col}` as html")
    return rows.mapInPandas(tidy(extract), f"page_id {id_type}, url string, text string, n_chars long")
