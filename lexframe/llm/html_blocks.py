"""Main text of web pages by the distribution of line blocks.

Markup is stripped into lines, one per block element. The text lengths of ``WINDOW`` neighbouring lines are summed
for every window; text starts where the sums surge over a threshold and ends where they dive to nothing, and the
lines between a surge and the next dive are kept. Lines of menus, headers, footers and sidebars, known by element or role,
weigh nothing and are never kept; linked text does not weigh. Forms, and blocks whose class or id names sidebars, notices,
adverts or reader comments (the head of the name counts: ``cookie-notice`` and ``comment-list`` do, ``social-policy`` and
``has-sidebar`` do not), are left out whole, unless they hold the article or more than half of the page's unlinked
text; for comments that half must also hold the title, or be all the text that surges. Where a page marks its article
(``article``, ``main`` or their roles), only that part weighs, by the same windows; there a dive cuts lines of links only,
and named blocks go unless nothing else would be left. A page whose windows all stay under the threshold is cut at its
highest window.

Defined results: a null, empty or textless page gives an empty text; character references are decoded once,
unfinished ones as browsers do, numbers beyond Unicode as U+FFFD; unclosed comments and scripts run to the end; a tag that no
``>`` ends is text; after a quote that never closes, quotes in tags no longer hide a ``>``; white space (any of Unicode)
inside a block is one blank; a line break is a block end; repeated rows give the same text. Added columns replace input
columns of the same name. The time of a page grows in proportion to its length.
"""

from __future__ import annotations

import html as entities
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from lexframe.llm.common import add_columns

WINDOW = 3
SURGE = 86

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)", re.S)
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|itemprop|type|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"\s(?:hidden(?:[\s=/]|$)|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_ZEROS = re.compile(r"(&#[xX]?)0{9,}")
_HUGE = re.compile(r"&#(?:0?[1-9][0-9]{7,}|[xX]0?[1-9a-fA-F][0-9a-fA-F]{7,});?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed".split())
_BLOCK = frozenset(
    "address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary "
    "table tbody td tfoot th thead tr ul".split())
_BOILERPLATE = frozenset("nav footer aside button select menu dialog head".split())
_FORMS = frozenset("form fieldset".split())
_CONTAINERS = frozenset(
    "div section ul ol dl dd li p table td tr aside nav header footer form figure details blockquote h2 h3 h4 h5 h6".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog menu menubar".split())
_COMMENTS = frozenset("comment comments discussion discussions disqus reply replies respond".split())
_WORDS = _COMMENTS | frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner sidebar menu "
    "nav navbar navigation breadcrumb breadcrumbs header footer masthead cookie cookies consent gdpr notice notices "
    "newsletter subscribe subscription popup modal overlay share sharing social related recommended widget toolbar "
    "pagination pager login signup".split())
#: What may follow such a word in a name without changing what the block is.
_PARTS = frozenset(
    "area aside bar block body bottom box boxes buttons center column container content cta footer form group heading "
    "icons inner item items left link links list media outer panel popup posts right row section slot stories text thread "
    "title top unit wrap wrapper".split())
_NEGATIONS = frozenset("no has without with hide".split())
_NOT_ARTICLE = _COMMENTS | frozenset("related recommended teaser promo ad advert sponsored".split())


@dataclass
class Line:
    """A block: its text, the length of its unlinked text, whether it lies in the article, and in boilerplate."""

    text: str
    weight: int
    inside: bool
    silent: bool


@dataclass
class Block:
    """A form or an element whose class or id names what is not main text, as a range of lines."""

    first: int
    comments: bool
    header: bool
    inside: bool
    last: int = 0
    holds_article: bool = False
    holds_title: bool = False


@dataclass
class _Open:
    tag: str
    boilerplate: bool
    article: bool
    named: Block | None


def _heads(value: str) -> set[str]:
    """The head word of every name in a class or id, without what only tells of a part or place."""
    found = set()
    for name in value.split():
        words = [w.lower() for w in _NAMES.findall(name) if len(w) > 1]
        if _NEGATIONS.intersection(words):
            continue
        while words and words[-1] in _PARTS and words[-1] not in _WORDS:
            words.pop()
        if words:
            found.add(words[-1])
    return found


def _decode(raw: str) -> str:
    """Text with its character references decoded and white space as single blanks."""
    if "&#" in raw:
        raw = _HUGE.sub("\ufffd", _ZEROS.sub(r"\g<1>0", raw))
    return " ".join(entities.unescape(raw).split())


class _Page:
    """Lines and named blocks of a page, in one pass over its tags."""

    def __init__(self, page: str):
        self.lines: list[Line] = []
        self.named: list[Block] = []
        self._stack: list[_Open] = []
        self._places: dict[str, list[int]] = {}  # open elements of a tag
        self._blocks: list[int] = []  # open block elements
        self._articles: list[int] = []  # lines at which articles start
        self._titles: list[int] = []
        self._parts: list[str] = []
        self._boilerplate = self._inside = self._linked = 0
        self._silent = False
        self._read(page)
        self._flush()
        while self._stack:
            self._close()

    def _flush(self):
        text = _decode("".join(self._parts)) if self._parts else ""
        if text:
            self.lines.append(Line(text, max(0, len(text) - self._linked), self._inside > 0, False))
        elif self._silent:
            self.lines.append(Line("", 0, self._inside > 0, True))
        self._parts.clear()
        self._linked, self._silent = 0, False

    def _write(self, raw: str):
        if self._boilerplate:
            self._silent |= bool(raw.strip())
        elif raw:
            self._parts.append(raw)
            if self._places.get("a"):
                self._linked += len(_decode(raw))

    def _open(self, tag: str, boilerplate: bool, article: bool, named: Block | None):
        at = len(self._stack)
        self._stack.append(_Open(tag, boilerplate, article, named))
        self._places.setdefault(tag, []).append(at)
        if tag in _BLOCK:
            self._blocks.append(at)
        if named:
            self.named.append(named)
        if article:
            self._articles.append(len(self.lines))
        if tag == "h1":
            self._titles.append(len(self.lines))
        self._boilerplate += boilerplate
        self._inside += article

    def _close(self):
        top = self._stack.pop()
        self._places[top.tag].pop()
        if top.tag in _BLOCK:
            self._blocks.pop()
        self._boilerplate -= top.boilerplate
        self._inside -= top.article
        if top.named:
            block = top.named
            block.last = len(self.lines)
            block.holds_article = bool(self._articles) and self._articles[-1] >= block.first and not block.inside
            block.holds_title = bool(self._titles) and self._titles[-1] >= block.first

    def _end(self, tag: str):
        places = self._places.get(tag)
        # inline ends never close a block
        if places and (tag in _BLOCK or not self._blocks or self._blocks[-1] < places[-1]):
            for _ in range(len(self._stack) - places[-1]):
                self._close()

    def _read(self, page: str):
        at, last, quotes = 0, page.rfind(">"), True
        while match := _TAG.search(page, at):
            self._write(page[at:match.start()])
            at = match.end()
            if match[2] is None:
                continue
            if at > last:
                self._write(match[0])
                continue
            whole = _QUOTED.match(page, at) if quotes else None
            quotes = whole is not None
            attributes = page[at:(whole.end() if whole else page.index(">", at) + 1) - 1]
            at += len(attributes) + 1
            tag = match[2].lower()
            if tag in _BLOCK:
                self._flush()
            if match[1]:
                self._end(tag)
            elif tag in _RAW:
                if tag not in ("svg", "math") or not attributes.rstrip().endswith("/"):
                    end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                    at = end.end() if end else len(page)
            elif tag not in _VOID:
                top = self._stack[-1].tag if self._stack else ""
                if top == "p" and tag in _BLOCK or top == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                    self._close()
                self._start(tag, attributes)
        self._write(page[at:])

    def _start(self, tag: str, attributes: str):
        inside = self._inside > 0
        page = tag in ("article", "main", "body", "html")
        boilerplate = tag in _BOILERPLATE or (tag == "header" and not inside)
        article = tag in ("article", "main")
        form, heads = tag in _FORMS, set()
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                value = value.lower()
                article |= value in ("main", "article")
                boilerplate |= value in _ROLES
                form |= value == "form" and tag in _BLOCK
            elif name == "itemprop":
                article |= value.lower() == "articlebody"
            elif name == "aria-hidden":
                boilerplate |= value.lower() == "true"
            elif name in ("class", "id"):
                heads |= _heads(value)
        boilerplate |= bool(attributes and _HIDDEN.search(attributes))
        if tag == "article" and heads & _NOT_ARTICLE:
            # teasers and comments are often marked as articles of their own
            boilerplate, article = True, False
        elif page:
            boilerplate = False
        named = heads & _WORDS if tag in _CONTAINERS and not article else set()
        if named or form and not article:
            found = Block(len(self.lines), bool(named & _COMMENTS), named == {"header"} and not form, inside)
        else:
            found = None
        self._open(tag, boilerplate, article, found)


def surges(weights: list[int], window: int = WINDOW, threshold: int = SURGE) -> list[tuple[int, int]]:
    """Ranges of lines between a surge of the window sums and the next dive."""
    n = len(weights)
    sums, running = [0] * n, 0
    for at in range(n - 1, -1, -1):
        running += weights[at] - (weights[at + window] if at + window < n else 0)
        sums[at] = running
    top = max(sums, default=0)
    if not top:
        return []
    threshold = min(threshold, top - 1)
    ranges, at = [], 0
    while at < n:
        if sums[at] <= threshold:
            at += 1
            continue
        start = at
        while start > (ranges[-1][1] if ranges else 0) and sums[start - 1] > 0:
            start -= 1
        while not weights[start]:
            start += 1
        end = at
        while end < n and sums[end] > 0:
            end += 1
        ranges.append((start, end))
        at = end + 1
    return ranges


def _left_out(page: _Page, threshold: int, window: int) -> list[bool]:
    """Per line whether a named block takes it out."""
    lines = page.lines
    marked = any(line.inside and line.text for line in lines)
    before = [0]
    for line in lines:
        before.append(before[-1] + (line.weight if line.inside or not marked else 0))
    blocks = [b for b in page.named if not b.holds_article and not (b.header and (b.inside or b.holds_title))]
    large = [b for b in blocks if 2 * (before[b.last] - before[b.first]) > before[-1]]

    def without(some: list[Block]) -> list[bool]:
        depth = [0] * (len(lines) + 1)
        for b in some:
            depth[b.first] += 1
            depth[b.last] -= 1
        out, open_blocks = [], 0
        for change in depth[:-1]:
            open_blocks += change
            out.append(open_blocks > 0)
        return out

    def weights(gone: list[bool]) -> list[int]:
        return [0 if out or marked and not line.inside else line.weight for line, out in zip(lines, gone)]

    small = [b for b in blocks if b not in large]
    gone = without(small + [b for b in large if marked or b.comments and not b.holds_title])
    left = weights(gone)
    if marked:
        enough = any(left)
    else:
        enough = any(sum(left[at:at + window]) > threshold for at in range(len(left)))
    return gone if enough else without(small)


def main_text(page: str, window: int = WINDOW, threshold: int = SURGE) -> str:
    """The lines between surges and dives, joined by line ends."""
    found = _Page(page)
    lines = found.lines
    gone = _left_out(found, threshold, window)
    marked = any(line.text and line.inside for line in lines)
    live = [bool(line.text) and not out and (line.inside or not marked) for line, out in zip(lines, gone)]
    weights = [line.weight if on else 0 for line, on in zip(lines, live)]
    if not any(weights):
        # nothing but links
        weights = [len(line.text) if on and line.inside else 0 for line, on in zip(lines, live)]
    kept = {at for start, end in surges(weights, window, threshold) for at in range(start, end)}
    if marked:
        kept |= {at for at, line in enumerate(lines) if 2 * line.weight >= len(line.text)}
    return "\n".join(line.text for at, line in enumerate(lines) if live[at] and at in kept)


def extract_main_text(
    pages: DataFrame, html: str = "html", window: int = WINDOW, threshold: int = SURGE
) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (code points)."""

    def make():
        def one(bodies):
            texts = [main_text(b.decode("utf-8", "replace"), window, threshold) if b else "" for b in bodies]
            return [texts, [len(t) for t in texts]]

        return one

    return add_columns(pages, [html], "text string, n_chars bigint", make)
