"""The main text of web pages by scoring the tree of elements.

Blocks of text pass points to the elements that hold them: one for their being there (less if under 25 characters), one
for each comma, and up to three for length, less the share of their text that is in links. A block's own element gets them
in full, the one above half, those above these a third of that and so on for five levels. Points of an element lose the
share of its text in links once more. The best element is widened to the article around it, if there is one; else its
siblings that have a fifth of its points, that are headings, or that are sentences with few links join it.

Elements never read: head matter, scripts, styles, forms and their controls, menus, headers, footers, sidebars and dialogs
by their tag, role or name (a class or id with a word of `BOILERPLATE`, unless it holds the article), and hidden ones. A
header within an article gives its headings. An article within an article is a comment, unless the outer one has no text.

Text: character references are decoded, white space in a block (line breaks too) is one space, blocks are joined by \\n.

Defined results: null or empty pages give empty texts; a page without any text outside such elements too; null ids and
urls stay; repeated rows count each time; other columns are ignored; empty tables give no rows. Unclosed comments, scripts
and styles end with the page; other unclosed elements close with those around them; the time is linear in the page.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import steps

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
#: Elements whose content is text up to their own end tag, or to the page's end if that lacks; the last two are passed over then.
_RAW = ("script", "style", "iframe", "noembed", "noframes", "xmp", "textarea", "title")
_END_OF_RAW = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_DROPPED = frozenset("nav footer aside form button select option datalist noscript template dialog menu object canvas svg audio video applet map frameset search".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes first, up to the elements that bound it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "thead": ("tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
_BOUNDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), **dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), ("table",))}
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
#: Words in a class or id that mark what isn't the article, and words after which they don't.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle banner banners breadcrumb breadcrumbs comment comments cookie cookies consent disclaimer disqus footer footers gdpr masthead menu menus modal nav navbar "
    "navigation newsletter notice notices outbrain pager pagination paywall popup promo promos promoted promotion recommended recommendations related replies reply respond share sharing sidebar sidebars signup social sponsor "
    "sponsored sponsors subscribe subscription taboola toolbar widget widgets".split()
)
_NEGATED = frozenset("has with no without have".split())
_COMMAS = re.compile(r"[,،、，]")
LEVELS, SIBLING_SHARE = 5, 0.2
#: Elements open at a time; deeper ones close the one before them.
DEEPEST = 512


def _named(attributes: dict[str, str]) -> bool:
    """Whether a class or id has a word that marks boilerplate."""
    for kind in ("class", "id"):
        for name in attributes.get(kind, "").split():
            words = [w.lower() for w in _WORDS.findall(name)]
            if any(w in BOILERPLATE and (not i or words[i - 1] not in _NEGATED) for i, w in enumerate(words)):
                return True
    return False


def _hidden(attributes: dict[str, str]) -> bool:
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", ""), re.I))


class Page:
    """A page's elements (parents before what they hold) and its blocks of text."""

    def __init__(self, html: str):
        self.tags, self.parents, self.dropped, self.named = ["body"], [-1], [False], [False]
        self.blocks: list[tuple[int, str, int]] = []
        self._open, self._tags, self._parts, self._linked = [0], Counter(), [], 0
        self._link: int | None = None
        #: The text before an inline element that isn't read; it goes on after that.
        self._held: dict[int, tuple[list[str], int]] = {}
        self._parse(html)
        while len(self._open) > 1:
            self._pop()
        self._block()

    def _block(self) -> None:
        if self._parts:
            text = " ".join("".join(self._parts).split())
            if text:
                self.blocks.append((self._open[-1], text, min(self._linked, len(text))))
            self._parts, self._linked = [], 0

    def _text(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._parts.append(text)
            if self._link is not None:
                self._linked += len(" ".join(text.split()))

    def _push(self, tag: str, dropped: bool, named: bool) -> None:
        if len(self._open) >= DEEPEST:
            self._pop()
        self.tags.append(tag)
        self.parents.append(self._open[-1])
        self.dropped.append(dropped)
        self.named.append(named)
        self._open.append(len(self.tags) - 1)
        self._tags[tag] += 1

    def _pop(self) -> None:
        self._block()
        closed = self._open.pop()
        self._tags[self.tags[closed]] -= 1
        if closed in self._held:
            self._parts, self._linked = self._held.pop(closed)
        if self._link is not None and len(self._open) < self._link:
            self._link = None

    def _close(self, tags: tuple[str, ...], bounds: tuple[str, ...]) -> None:
        """Closes up to and with the outermost open element of `tags` above the innermost of `bounds`."""
        if any(self._tags[t] for t in tags):
            depth = len(self._open)
            for k in range(len(self._open) - 1, 0, -1):
                tag = self.tags[self._open[k]]
                if tag in bounds:
                    break
                if tag in tags:
                    depth = k
                    if tags == ("p",):
                        break
            while len(self._open) > depth:
                self._pop()

    def _start(self, tag: str, raw: str) -> None:
        attributes = {}
        if raw and not raw.isspace():
            for name, value in _ATTRIBUTE.findall(raw):
                attributes.setdefault(name.lower(), unescape(value.strip("\"'")))
        if tag == "br":
            self._parts.append(" ")
        elif tag == "a":
            self._link = len(self._open)
        named = bool(attributes) and (_named(attributes) or attributes.get("role", "").lower() in _ROLES)
        dropped = tag in _DROPPED or bool(attributes) and _hidden(attributes)
        if tag in ("html", "body", "head") or tag in _VOID:
            if tag == "hr":
                self._block()
            return
        if tag in _INLINE:
            if named or dropped:
                held = self._parts, self._linked
                self._parts, self._linked = [], 0
                self._push(tag, dropped, named)
                self._held[self._open[-1]] = held
            return
        self._block()
        if self._tags["p"]:
            self._close(("p",), ("table", "td", "th", "button", "object", "caption"))
        if tag in _CLOSES:
            self._close(_CLOSES[tag], _BOUNDS[tag])
        self._push(tag, dropped, named)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self._link = None
        if not self._tags[tag]:
            return
        bounds = () if tag == "table" else ("table",) if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else ("td", "th", "caption")
        for k in range(len(self._open) - 1, 0, -1):
            found = self.tags[self._open[k]]
            if found == tag:
                while len(self._open) > k:
                    self._pop()
                return
            if found in bounds:
                return

    def _parse(self, html: str) -> None:
        at, end, lacking = 0, len(html), set()
        while at < end:
            start = html.find("<", at)
            if start < 0:
                self._text(html[at:])
                return
            mark = html[start + 1 : start + 2]
            if not (mark.isascii() and mark.isalpha()) and mark not in ("/", "!", "?"):
                self._text(html[at : start + 1])
                at = start + 1
                continue
            self._text(html[at:start])
            if html.startswith("<!--", start):
                stop = html.find("-->", start + 2)
                at = end if stop < 0 else stop + 3
                continue
            tag = (_TAG.match(html, start) or _LOOSE.match(html, start)) if mark not in ("!", "?") else None
            if tag is None:
                stop = html.find(">", start)
                at = end if stop < 0 else stop + 1
                continue
            at = tag.end()
            name = tag[2].lower()
            if tag[1]:
                self._end(name)
            elif name in _END_OF_RAW:
                over = _END_OF_RAW[name].search(html, at) if name not in lacking else None
                if over:
                    stop = html.find(">", over.end())
                    at = end if stop < 0 else stop + 1
                elif name not in ("textarea", "title"):
                    return
                else:
                    lacking.add(name)
            else:
                self._start(name, tag[3])

    def main_blocks(self) -> list[str]:
        """The texts of the main blocks, in page order."""
        n = len(self.tags)
        names = self.named
        # names count within the page's article too, but not around it: there is one outside all named elements, or they are ignored where they hold one
        apart = [False] * n
        for i in range(1, n):
            apart[i] = apart[self.parents[i]] or names[i]
        articles = [i for i in range(1, n) if self.tags[i] in ("article", "main") and not names[i]]
        holds = [False] * n
        if articles and all(apart[i] for i in articles):
            for i in articles:
                while i >= 0 and not holds[i]:
                    holds[i], i = True, self.parents[i]
        gone, inside = [False] * n, [-1] * n
        for i in range(1, n):
            p = self.parents[i]
            gone[i] = gone[p] or self.dropped[i] or (names[i] and not holds[i]) or (self.tags[i] == "header" and inside[p] < 0)
            inside[i] = i if self.tags[i] == "article" and inside[p] < 0 and not gone[i] else inside[p]
        in_header = [False] * n
        for i in range(1, n):
            in_header[i] = in_header[self.parents[i]] or self.tags[i] == "header" and inside[i] >= 0
        live = [(e, text, links) for e, text, links in self.blocks if not gone[e] and (not in_header[e] or self.tags[e] in _HEADINGS)]
        # articles within articles, where the outer one has text of its own
        nested = [i for i in range(1, n) if self.tags[i] == "article" and inside[i] not in (-1, i)]
        if nested:
            comment = [False] * n
            marked = set(nested)
            for i in range(1, n):
                comment[i] = comment[self.parents[i]] or i in marked
            own = {inside[e] for e, _, _ in live if not comment[e]}
            live = [x for x in live if not comment[x[0]] or inside[x[0]] not in own]
        points, chars, linked = [0.0] * n, [0] * n, [0] * n
        for e, text, links in live:
            size = len(text)
            given = (min(1.0, size / 25) + len(_COMMAS.findall(text)) + min(size / 100, 3.0)) * (1 - links / size)
            holder = e if self.tags[e] in ("div", "article", "main", "section", "body", "td") else self.parents[e]
            for level in range(LEVELS):
                points[holder] += given * (1.0 if not level else 0.5 if level == 1 else 1 / (3 * level))
                holder = self.parents[holder]
                if holder < 0:
                    break
            chars[e] += size
            linked[e] += links
        for i in range(n - 1, 0, -1):
            chars[self.parents[i]] += chars[i]
            linked[self.parents[i]] += linked[i]
        worth = [p * (1 - l / c) if c else 0.0 for p, c, l in zip(points, chars, linked, strict=True)]
        best = max(range(n), key=lambda i: (worth[i], -i))
        if not live:
            return []
        around, i = -1, best
        while i > 0:
            if self.tags[i] == "article" or self.tags[i] == "main" and around < 0:
                around = i
            i = self.parents[i]
        best = around if around > 0 else best
        chosen = [False] * n
        chosen[best] = True
        if best:
            floor = SIBLING_SHARE * worth[best]
            shown = [(chars[i], linked[i]) for i in range(n)]
            last = {e: text[-1] for e, text, _ in live}
            for i in range(1, n):
                if self.parents[i] == self.parents[best] and i != best and shown[i][0]:
                    share = shown[i][1] / shown[i][0]
                    same = around < 0 or self.tags[i] == self.tags[best]
                    if same and worth[i] >= floor > 0 or around < 0 and share < 0.25 and (self.tags[i] in _HEADINGS or self.tags[i] == "p" and (shown[i][0] > 80 or last.get(i, "") in ".!?。")):
                        chosen[i] = True
        for i in range(1, n):
            chosen[i] = chosen[i] or chosen[self.parents[i]]
        return [text for e, text, _ in live if chosen[e]]


def main_text(html: str) -> str:
    return "\n".join(Page(html).main_blocks())


_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, pages in steps(batches, "html"):
        texts = [main_text(p.decode()) for p in pages]
        yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_SCHEMA)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page. No shuffle; each page is parsed by itself."""
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    return given.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")
