"""HTML as a stream of elements, read into blocks of text with their place in the page.

Only what text extraction needs: which elements are open, where a block of text ends, which text is in a link, and which
elements are boilerplate by their own name. Broken markup is read as browsers read it in the common cases: a new
paragraph, list item or table cell closes the one before, unknown end tags are ignored, an unclosed element ends with the
page. Reading takes time in proportion to the page.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import xxhash

# HTML's elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
    summary table tbody tfoot thead tr ul""".split()
)
CELL = frozenset(("td", "th"))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start tag of the first kind ends an open element of the second, unless an element of the third is open in between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select",)),
}
PARAGRAPH_SCOPE = ("td", "th", "table", "button", "object", "caption", "blockquote", "li", "div", "section", "article", "body")

# Elements, roles and names that are not the article.
DROPPED = frozenset("aside audio button canvas datalist dialog footer form head iframe input map menu nav noembed noframes noscript object script search select style svg template textarea title video xmp".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
DROPPED_NAMES = frozenset(
    """ad ads adsense advert advertisement advertisements adverts alert banner banners breadcrumb breadcrumbs colophon comment
    commentlist comments consent cookie cookies copyright disclaimer disqus footer gdpr legal login masthead menu menus modal
    nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion
    recommended related reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    subscription toolbar topbar widget widgets""".split()
)
#: Left out of the page by these unless they stand in an article.
OUTER_NAMES = frozenset(("header",))
NEGATED = frozenset("has with no without is".split())
ARTICLE, MAIN = 2, 1

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.S)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NUMBER, _LONG_NUMBER = re.compile(r"\d+"), re.compile(r"\d{3,}")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass(slots=True)
class Element:
    name: str
    path: int
    #: boilerplate by its own name, or in it
    dropped: bool
    inside: int
    link: bool
    #: no text of the page, or a control within a line: its text is not read
    mute: bool = False


@dataclass(slots=True)
class Block:
    """Text between two block borders. ``path`` is the role of the element that holds it."""

    path: int
    dropped: bool
    inside: int
    heading: bool
    text: str
    words: int
    linked: int


@dataclass(slots=True)
class Page:
    blocks: list[Block] = field(default_factory=list)
    #: (token, parent token) of every element that structures the page, in page order
    elements: list[tuple[int, int]] = field(default_factory=list)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


@lru_cache(maxsize=1 << 16)
def token_of(parent: int, name: str) -> int:
    return _signed(xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass"), seed=parent & 0xFFFFFFFFFFFFFFFF))


ROOT = token_of(0, "")


def attributes(written: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(written):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def _names(value: str) -> list[list[str]]:
    return [[w.lower() for w in _NAME.findall(one)] for one in value.split()]


def _boilerplate(name: str, own: dict[str, str], inside: bool) -> bool:
    if name in DROPPED or (name == "header" and not inside) or "hidden" in own or own.get("aria-hidden") == "true":
        return True
    if own.get("role", "").lower() in DROPPED_ROLES or _HIDDEN.search(own.get("style", "")):
        return True
    if name in ("html", "body", "main"):
        return False
    for words in _names(own.get("class", "") + " " + own.get("id", "")):
        if words and words[0] not in NEGATED and any(w in DROPPED_NAMES or (w in OUTER_NAMES and not inside) for w in words):
            return True
    return False


def _role(name: str, own: dict[str, str]) -> str:
    """An element's own part of its path. Numbers of ids, and long ones of classes, differ from page to page."""
    classes = sorted(_LONG_NUMBER.sub("", c) for c in own.get("class", "").split())
    return " ".join([name, *classes, "#" + _NUMBER.sub("", own.get("id", ""))])


@lru_cache(maxsize=1 << 14)
def _marked(name: str, written: str, inside: bool) -> tuple[str, bool, int]:
    """Of a start tag: the element's part of its path, whether it is boilerplate, and the part of the page it begins."""
    own = attributes(written) if written.strip(" /\t\n\r\f") else {}
    begins = 0
    if name == "article" or own.get("itemprop", "").lower() == "articlebody":
        begins = ARTICLE
    elif name == "main" or own.get("role", "").lower() == "main":
        begins = MAIN
    return _role(name, own) if name in BLOCK else "", _boilerplate(name, own, inside), begins


class _Reader:
    def __init__(self) -> None:
        self.page, self.stack, self.open = Page(), [Element("", ROOT, False, 0, False)], {}
        self.parts: list[str] = []
        self.linked = 0

    def text(self, value: str) -> None:
        if value and not self.stack[-1].mute:
            value = unescape(value) if "&" in value else value
            self.parts.append(value)
            if self.stack[-1].link:
                self.linked += len(value.split())

    def border(self) -> None:
        """Ends a block. All its text stands in the innermost block element that is open."""
        if self.parts:
            words = "".join(self.parts).split()
            if words:
                at = next(e for e in reversed(self.stack) if e.name in BLOCK or not e.name)
                self.page.blocks.append(Block(at.path, at.dropped, at.inside, at.name in HEADING, " ".join(words), len(words), min(self.linked, len(words))))
            self.parts, self.linked = [], 0

    def pop(self, to: int) -> None:
        while len(self.stack) > to:
            if self.stack[-1].name in BLOCK:
                self.border()
            self.open[self.stack.pop().name] -= 1

    def close(self, names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        if any(self.open.get(n) for n in names):
            for i in range(len(self.stack) - 1, 0, -1):
                if self.stack[i].name in names:
                    return self.pop(i)
                if self.stack[i].name in scope:
                    return None
        return None

    def start(self, name: str, written: str) -> None:
        if name in BLOCK or name in CELL:
            if self.open.get("p") and name not in CELL:
                self.close(("p",), PARAGRAPH_SCOPE)
            if name in CLOSES:
                self.close(*CLOSES[name])
            if name in BLOCK:
                self.border()
        if name in CELL or name == "br":
            self.parts.append(" ")
        if name in VOID:
            return None
        top = self.stack[-1]
        if top.mute and name not in BLOCK:  # nothing in here is read; only nesting counts
            return self.push(Element(name, top.path, top.dropped, top.inside, False, True))
        role, dropped, begins = _marked(name, written, top.inside > 0)
        path = top.path
        if name in BLOCK:
            path = token_of(top.path, role)
            self.page.elements.append((path, top.path))
        mute = top.mute or (dropped and name not in BLOCK)
        return self.push(Element(name, path, top.dropped or dropped, max(top.inside, begins), top.link or name == "a", mute))

    def push(self, e: Element) -> None:
        self.stack.append(e)
        self.open[e.name] = self.open.get(e.name, 0) + 1

    def end(self, name: str) -> None:
        if name in ("br", "p") and not self.open.get(name):
            self.border() if name == "p" else self.parts.append(" ")
        if not self.open.get(name) or name in ("html", "body"):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].name == name:
                return self.pop(i)
            if self.stack[i].name in BLOCK and name not in BLOCK and name not in CELL:
                return None  # an inline element does not end the block around it
        return None


def read(html: str | None) -> Page:
    """The blocks and elements of a page, in page order. A null page has none."""
    reader, at = _Reader(), 0
    html = html or ""
    while True:
        open_ = html.find("<", at)
        if open_ < 0:
            reader.text(html[at:])
            break
        reader.text(html[at:open_])
        if html.startswith("<!--", open_):
            stop = html.find("-->", open_ + 4)
            at = len(html) if stop < 0 else stop + 3
            continue
        if html.startswith(("<!", "<?"), open_):
            stop = html.find(">", open_)
            at = len(html) if stop < 0 else stop + 1
            continue
        tag = _TAG.match(html, open_)
        if tag is None:
            if re.match(r"</?[a-zA-Z]", html[open_ : open_ + 3]):
                break  # the page ends within a tag
            reader.text("<")
            at = open_ + 1
            continue
        at = tag.end()
        closing, name, written = tag.group(1, 2, 3) if tag.group(2) else tag.group(4, 5, 6)
        name = name.lower()
        if closing:
            reader.end(name)
            continue
        reader.start(name, written)
        if name in RAW:
            stop = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.I).search(html, at)
            at = stop.start() if stop else len(html)
    reader.pop(1)
    reader.border()
    return reader.page
