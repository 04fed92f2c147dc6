"""A small reader of web pages: balanced elements from real-life markup, their subtree hashes, and blocks of text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from html import unescape

# Names of elements and attributes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
HEAD = frozenset("title meta link base style script noscript template head".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html "
    "legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of text inside an article; they are never taken for a template.
FLOW = frozenset("p pre blockquote li dt dd td th tr tbody thead tfoot caption figcaption h1 h2 h3 h4 h5 h6 summary".split())
#: What an open element of this name is closed by, and where the search for it ends.
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "thead": ({"tbody", "caption"}, {"table"}), "tfoot": ({"tbody", "thead"}, {"table"})}
SCOPE = frozenset("html td th caption table template object button".split())
LEFT_OUT = frozenset(
    "nav aside footer script style title noscript template iframe object embed svg math canvas audio video button select textarea input datalist dialog menu head search noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: First or last parts of class names and ids of what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion banner sidebar sidebars aside rail widget widgets cookie cookies consent gdpr "
    "notice notices notification notifications alert disclaimer menu menus nav navbar navigation breadcrumb breadcrumbs toolbar pagination pager comment comments commentlist discussion disqus replies respond "
    "share sharing social related recommended recommendations newsletter subscribe subscription signup login popup modal overlay footer copyright skip search form searchform".split())
NOT_NAMES = frozenset("has no with without not".split())

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>]*+))*+)>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z)|/?[a-zA-Z][^>]*+\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s/>=\"']++)\s*+(?:=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+>", re.I) for t in RAW}
_PARTS = re.compile(r"[-_]+|(?<=[a-z0-9])(?=[A-Z])")
_SPACE = re.compile(r"\s+")


@dataclass
class Element:
    """``first`` and ``last``: its own events in the page's list; ``digest``: of its name, classes and text."""

    tag: str
    attributes: str
    parent: int
    first: int
    last: int = -1
    digest: int = 0
    letters: int = 0

    def attribute(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None


@dataclass
class Page:
    """``events``: text (str), or ``k`` where element k opens and ``~k`` where it closes."""

    events: list
    elements: list[Element]


def read(html: str) -> Page:
    """The page's elements, all of them closed: implied ends are added, ends without a start and broken markup at the end are left out."""
    events: list = []
    elements: list[Element] = []
    stack: list[int] = []
    open_: Counter = Counter()

    def close(to: int) -> None:
        while len(stack) > to:
            k = stack.pop()
            elements[k].last = len(events)
            open_[elements[k].tag] -= 1
            events.append(~k)

    def find(names, ends) -> int | None:
        """The place on the stack of the innermost open element of these names, unless one of ``ends`` is nearer."""
        for at in range(len(stack) - 1, -1, -1):
            tag = elements[stack[at]].tag
            if tag in names:
                return at
            if tag in ends:
                return None
        return None

    def close_if(names, ends) -> None:
        if any(open_[n] for n in names):
            at = find(names, ends)
            if at is not None:
                close(at)

    def text(part: str) -> None:
        if part:
            if open_["head"] and not part.isspace():
                close_if({"head"}, ())
            events.append(unescape(part) if "&" in part else part)

    at = 0
    while True:
        m = _TAG.search(html, at)
        if not m:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body"):
                continue
            if tag == "br":
                events.append(" ")
            elif tag in HEADINGS:
                close_if(HEADINGS, SCOPE)
            elif open_[tag]:
                close_if({tag}, SCOPE - {"table"} if tag in SCOPE or tag in CLOSED_BY else SCOPE if tag in BLOCK else BLOCK)
            continue
        if open_["head"] and tag not in HEAD:
            close_if({"head"}, ())
        if tag in BLOCK:
            close_if({"p"}, SCOPE)
            if tag in HEADINGS and stack and elements[stack[-1]].tag in HEADINGS:
                close(len(stack) - 1)
        if tag in CLOSED_BY:
            close_if(*CLOSED_BY[tag])
        elements.append(Element(tag, m[3], stack[-1] if stack else -1, len(events)))
        stack.append(len(elements) - 1)
        open_[tag] += 1
        events.append(len(elements) - 1)
        if tag in VOID:
            close(len(stack) - 1)
        elif tag in RAW:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            close(len(stack) - 1)
    close(0)
    return Page(events, elements)


def hashed(page: Page) -> None:
    """Fills in ``digest`` and ``letters`` of every element, from the leaves up."""
    stack: list = []
    for e in page.events:
        if isinstance(e, str):
            words = " ".join(e.split())
            if words and stack:
                stack[-1][0].update(b"\x00" + words.encode("utf-8", "replace"))
                stack[-1][1] += len(words)
        elif e >= 0:
            own = page.elements[e]
            name = f"{own.tag}\x01{own.attribute('class') or ''}\x01{own.attribute('id') or ''}" if own.attributes else own.tag
            stack.append([blake2b(name.encode("utf-8", "replace"), digest_size=8), 0])
        else:
            h, letters = stack.pop()
            raw = h.digest()
            page.elements[~e].digest, page.elements[~e].letters = int.from_bytes(raw, "big", signed=True), letters
            if stack:
                stack[-1][0].update(b"\x01" + raw)
                stack[-1][1] += letters


def _named(value: str | None) -> bool:
    for name in (value or "").split():
        parts = [p.lower() for p in _PARTS.split(name) if p]
        if parts and parts[0] not in NOT_NAMES and (parts[0] in NAMES or parts[-1] in NAMES):
            return True
    return False


def _boilerplate(e: Element, in_article: bool) -> bool:
    """Whether name, role, class or id say that an element is not part of the article."""
    if e.tag in LEFT_OUT or e.tag == "header" and not in_article:
        return True
    if not e.attributes or e.tag in ("html", "body"):
        return False
    if e.attribute("hidden") is not None or (e.attribute("aria-hidden") or "").lower() == "true" or "display:none" in (e.attribute("style") or "").replace(" ", "").lower():
        return True
    role = (e.attribute("role") or "").lower()
    if role in ROLES and not (in_article and role == "banner"):
        return True
    if _named(e.attribute("class")) or _named(e.attribute("id")):
        return True
    return not in_article and any("header" in (p.lower() for p in _PARTS.split(n)) for n in f"{e.attribute('class') or ''} {e.attribute('id') or ''}".split())


def _is_root(e: Element) -> int:
    """2 for an article, 1 for a page's main part, 0 else."""
    if e.tag == "article":
        return 2
    if e.tag == "main":
        return 1
    if "role" in e.attributes or "itemprop" in e.attributes:
        if (e.attribute("itemprop") or "").lower() == "articlebody" or (e.attribute("role") or "").lower() == "article":
            return 2
        return int((e.attribute("role") or "").lower() == "main")
    return 0


@dataclass
class Layout:
    """``roots``: the outermost articles, else main parts, of a page; ``out``: elements that are not part of one by their marks."""

    roots: set[int]
    out: set[int]
    holds_root: set[int]
    inside: list[bool]


def layout(page: Page) -> Layout:
    elements = page.elements
    found: dict[int, set[int]] = {2: set(), 1: set()}
    gone: list[bool] = []
    within: list[list[bool]] = []  # whether in (or) an article, a main part
    out: set[int] = set()
    forms: set[int] = set()
    for k, e in enumerate(elements):
        above = e.parent
        outside = above >= 0 and gone[above]
        a, m = within[above] if above >= 0 else [False, False]
        kind = _is_root(e)
        marked = not outside and _boilerplate(e, a or m)
        if marked:
            out.add(k)
        gone.append(outside or marked)
        if kind and not gone[-1]:
            if kind == 2 and not a or kind == 1 and not m:
                found[kind].add(k)
        if e.tag == "form" and not gone[-1]:
            forms.add(k)
        within.append([a or kind == 2 and not gone[-1], m or kind == 1 and not gone[-1]])
    roots = found[2] or found[1]
    holds: set[int] = set()
    for k in roots:
        k = elements[k].parent
        while k >= 0 and k not in holds:
            holds.add(k)
            k = elements[k].parent
    titled = set(holds)
    for k, e in enumerate(elements):  # a form around the whole page
        if e.tag == "h1" or k in roots:
            while k >= 0:
                titled.add(k)
                k = elements[k].parent
    out |= forms - titled
    inside: list[bool] = []
    for k, e in enumerate(elements):
        inside.append(k in roots or e.parent >= 0 and inside[e.parent])
    return Layout(roots, out, holds, inside)


def _may_be_template(page: Page, plan: Layout, k: int) -> bool:
    """Blocks with text, but for roots, what holds them and flow text inside them."""
    e = page.elements[k]
    if not e.letters or e.tag not in BLOCK or e.tag in ("html", "body") or k in plan.roots or k in plan.holds_root:
        return False
    return not (plan.inside[k] and e.tag in FLOW)


def subtrees(page: Page, plan: Layout) -> set[int]:
    """Digests of the elements that may belong to a site's template."""
    return {e.digest for k, e in enumerate(page.elements) if _may_be_template(page, plan, k)}


def blocks(page: Page, plan: Layout, template: set[int] = frozenset()) -> list[str]:
    """The text of the article block by block, without elements left out by their marks or found in ``template``."""
    out: list[str] = []
    now: list[str] = []
    skip = inside = 0
    whole = not plan.roots

    def flush() -> None:
        if now:
            text = _SPACE.sub(" ", "".join(now)).strip()
            if text:
                out.append(text)
            now.clear()

    for e in page.events:
        if isinstance(e, str):
            if not skip and (whole or inside):
                now.append(e)
            continue
        k = e if e >= 0 else ~e
        own = page.elements[k]
        if own.tag in BLOCK:
            flush()
        elif own.tag in ("br", "wbr") and e >= 0:
            now.append(" " if own.tag == "br" else "")
        step = 1 if e >= 0 else -1
        if k in plan.roots:
            inside += step
        if k in plan.out or template and own.digest in template and _may_be_template(page, plan, k):
            skip += step
    flush()
    return out
