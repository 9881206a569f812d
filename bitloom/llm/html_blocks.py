"""Blocks of an HTML page and where they stand: a tokenizer with HTML's attribute states, and the places that tags give.

Tags, comments and raw text are told apart as browsers do: quotes count only where an attribute's value begins, the slash
of a self-closing tag counts only in SVG and MathML, end tags may be left out, and what a page ends in the middle of
(a tag, a comment, a script) is dropped. Every step consumes what it read, so a page of any length takes linear time.
Not followed: scripts that hold both ``<!--`` and ``<script``, and the re-opening of formatting tags.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

LINKED = 0.6

_S = r"[ \t\n\f\r]"
_VALUE = rf"\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+|(?=>)"
_ATTRIBUTE = rf"[ \t\n\f\r/]*+[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{_S}*+={_S}*+(?:{_VALUE}))?+"
_TAG = re.compile(rf"<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)((?:{_ATTRIBUTE})*+)([ \t\n\f\r/]*+)>")
_ATTR = re.compile(rf"[ \t\n\f\r/]*+([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:{_S}*+={_S}*+({_VALUE}))?+")
_COMMENT_END = re.compile(r"--!?>")
#: What stands in them is no markup.
_RAW = {t: re.compile(rf"</{t}(?=[ \t\n\f\r/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp")}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base basefont bgsound br col embed hr img input keygen link meta param source track wbr".split())
FOREIGN = frozenset(("svg", "math"))
#: A new one of these ends an open paragraph.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li dd dt listing main menu nav ol p "
    "plaintext pre search section summary table ul xmp".split()
)
#: A new key ends an open one of its like, unless one of the last stands between.
_LIKES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "tr": (("tr",), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
}
#: No end tag but a table's own reaches beyond one of these.
_SCOPE = frozenset("applet caption html table td th marquee object template".split())
_TABLE = frozenset("table thead tbody tfoot tr td th caption".split())

OUTSIDE_TAGS = frozenset("nav footer aside form button select option dialog menu head title script style noscript template iframe svg math textarea object canvas audio video noembed noframes".split())
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar sidebars menu menus nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar comment comments disqus replies respond share sharing social related recommended recommendations "
    "newsletter subscribe subscription signup login popup modal overlay widget widgets pagination pager copyright legal disclaimer skip search form".split()
)
#: Names that can't hold the article, whatever stands in them; the others of OUTSIDE_WORDS may name a wrapper of it.
NEVER_WORDS = frozenset("ad ads advert adverts advertisement comment comments disqus replies respond related recommended recommendations footer nav navbar menu cookie cookies newsletter popup modal".split())
ARTICLE_NAMES = frozenset("article articlebody articlecontent articletext post postbody postcontent posttext entry entrycontent entrybody story storybody storycontent".split())
MAIN_NAMES = frozenset("main maincontent content pagecontent primary primarycontent".split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_HIDDEN = re.compile(r"display\s*:\s*none")

#: Places: article and main text, what is left open, and outside; a wrapper's "outside" may yet hold an article.
ARTICLE, MAIN, OPEN, WRAPPER, OUT = "article", "main", "open", "wrapper", "out"


def attributes(raw: str) -> dict[str, str]:
    """Names in lower case and decoded values; of a name that comes twice the first counts."""
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), entities.unescape(value) if "&" in value else value)
    return out


def _named(raw: str) -> tuple[str, str]:
    """What a tag's attributes say: ("never", "outside", "header" or "", "article", "main" or "")."""
    found = attributes(raw)
    role = found.get("role", "").strip().lower()
    if role in OUTSIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "").lower()):
        return "never", ""
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    words, plain = {w.lower() for n in names for w in _WORD.findall(n)}, {re.sub("[^a-z]", "", n.lower()) for n in names}
    inside = "article" if role == "article" or found.get("itemprop", "").lower() == "articlebody" or plain & ARTICLE_NAMES else "main" if role == "main" or plain & MAIN_NAMES else ""
    outside = "never" if words & NEVER_WORDS else "outside" if words & OUTSIDE_WORDS else "header" if "header" in words else ""
    return outside, inside


def _place(tag: str, attrs: str, place: str) -> str:
    outside, inside = _named(attrs) if attrs else ("", "")
    if place == OUT or tag in ("html", "body"):
        return place
    if tag in OUTSIDE_TAGS or outside == "never" or (tag == "header" or outside == "header") and place in (OPEN, WRAPPER) and not inside:
        return OUT
    if tag == "article" or inside == "article":
        return ARTICLE
    if outside:
        return OUT if place in (ARTICLE, MAIN) else WRAPPER
    return MAIN if (tag == "main" or inside == "main") and place != ARTICLE else place


class _Page:
    """The open elements, the blocks so far and the block that is being read."""

    def __init__(self):
        self.blocks: list[tuple[str, str]] = []
        self.stack: list[tuple[str, str]] = []  # tag, place
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.linked = self.chars = 0
        self.in_link = False

    @property
    def place(self) -> str:
        return self.stack[-1][1] if self.stack else OPEN

    def say(self, raw: str, decode: bool = True) -> None:
        raw = entities.unescape(raw) if decode and "&" in raw else raw
        self.text.append(raw)
        n = len(raw.strip())
        self.chars += n
        self.linked += n * self.in_link

    def close(self) -> None:
        """Ends the block."""
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                # a block of links that is in no article is a menu
                menu = self.place == OPEN and self.linked >= LINKED * self.chars
                self.blocks.append((OUT if menu else self.place, words))
            self.text, self.linked, self.chars = [], 0, 0

    def push(self, tag: str, place: str) -> None:
        self.stack.append((tag, place))
        self.open[tag] += 1

    def pop_to(self, at: int) -> None:
        for tag, _ in self.stack[at:]:
            self.open[tag] -= 1
        del self.stack[at:]

    def find(self, tags: tuple, barriers) -> int:
        """Where the innermost of these tags is open with no barrier within it; -1 where there is none."""
        if any(self.open[t] > 0 for t in tags):
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in tags:
                    return i
                if self.stack[i][0] in barriers:
                    break
        return -1

    def start(self, tag: str, attrs: str, closed: bool) -> None:
        foreign = any(self.open[t] > 0 for t in FOREIGN)
        if tag == "a":
            self.in_link = True
        if tag == "wbr" or tag in INLINE and not foreign and not self.open[tag] > 0 and not (attrs and _named(attrs)[0] == "never"):
            return  # part of its block
        self.close()
        if tag in _ENDS_P and (at := self.find(("p",), _SCOPE | {"button"})) >= 0:
            self.pop_to(at)
        if tag in _LIKES and (at := self.find(*_LIKES[tag])) >= 0:
            self.pop_to(at)
        if tag not in VOID and not (closed and (foreign or tag in FOREIGN)):
            self.push(tag, _place(tag, attrs, self.place))

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        if tag in INLINE and not self.open[tag] > 0:  # only those outside the text stand on the stack
            return
        self.close()
        if (at := self.find((tag,), _SCOPE - {tag} if tag not in _TABLE else {"table"} - {tag})) >= 0:
            self.pop_to(at)
            self.in_link = False


def blocks(page: str | None) -> list[tuple[str, str]]:
    """(place, text) of a page's blocks in order; texts are decoded, white space is one space."""
    page, at = page or "", 0
    size, out = len(page), _Page()
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            out.say(page[at:])
            break
        if begin > at:
            out.say(page[at:begin])
        after = page[begin + 1 : begin + 3]
        if after[:1].isascii() and after[:1].isalpha() or after[:1] == "/" and after[1:].isascii() and after[1:].isalpha():
            m = _TAG.match(page, begin)
            if not m:
                break  # the page ends within the tag
            at, tag = m.end(), m[2].lower()
            if m[1]:
                out.end(tag)
            elif tag in _RAW and not (m[4].endswith("/") and any(out.open[t] > 0 for t in FOREIGN)):
                out.close()
                end = _RAW[tag].search(page, at)
                if tag == "xmp":
                    out.say(page[at : end.start() if end else size], decode=False)
                    out.close()
                at = end.end() if end else size
            elif tag == "plaintext":
                out.close()
                out.say(page[at:], decode=False)
                at = size
            else:
                out.start(tag, m[3], m[4].endswith("/"))
        elif page.startswith("<!--", begin):
            short = next((s for s in ("<!-->", "<!--->") if page.startswith(s, begin)), None)
            end = None if short else _COMMENT_END.search(page, begin + 4)
            at = begin + len(short) if short else end.end() if end else size
        elif after[:1] in ("!", "?") or after[:1] == "/" and len(after) == 2:
            at = page.find(">", begin) + 1 or size
        else:
            out.say("<")
            at = begin + 1
    out.close()
    return out.blocks


def chosen(page: str | None) -> tuple[str, list[str] | None, bool]:
    """The main text as far as structure tells, the blocks that the other pages of the host decide on (its own, or
    those left open where it has none), and whether they are the main text's own."""
    found = blocks(page)
    for place in (ARTICLE, MAIN):
        if inside := [t for p, t in found if p == place]:
            return " ".join(inside), inside, True
    return "", [t for p, t in found if p == OPEN] or None, False
