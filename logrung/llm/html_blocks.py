"""One page of HTML as text runs with their place in the tag tree; a small helper of the extraction."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import xxhash

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
_LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
#: One attribute at its place: a name inside another one's value is no name.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_NAMING = frozenset("class id role itemprop".split())
_DIGITS = re.compile(r"\d+")
#: Elements deeper than this, and longer labels, are told apart no further.
_MOST_DEPTH = 64
_LONG_LABEL = 200

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no text of the page.
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas head select".split())
#: Without an end tag these run to the end of the page; others of RAW then have no content.
_TO_THE_END = frozenset("script style textarea title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr".split()
)
#: A start tag that ends an open element of the same set.
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
         "th": ("td", "th"), "option": ("option",)}
_LIMITS = frozenset("ul ol dl table td th body article section main div nav aside footer form".split())
BOILERPLATE_TAGS = frozenset("nav footer aside button menu dialog input".split())
#: Boilerplate, unless the page's main element lies inside.
WRAPPERS = frozenset("form fieldset header".split())
BOILERPLATE_NAMES = frozenset(
    "nav navbar navigation menu menubar header masthead footer sidebar aside ad ads advert adverts advertisement "
    "adsense banner promo promotion sponsor sponsored cookie cookies consent notice notices alert popup modal overlay "
    "comment comments respond reply replies discussion disqus share sharing social related recommended breadcrumb "
    "breadcrumbs newsletter subscribe signup login search searchform widget pagination pager toolbar topbar "
    "copyright legal complementary contentinfo".split()
)
#: Their own names say nothing about being boilerplate.
UNNAMED = frozenset("html body main article".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_NAMES = frozenset(
    "main article articlebody article-body article-content main-content maincontent post-content entry-content".split()
)


class Run(NamedTuple):
    """A text run: ``path`` of its element, ``slot`` as path of the block around it, text, and what its ancestors say."""

    path: str
    slot: str
    text: str
    block: int
    boilerplate: bool
    main: bool
    link: bool
    #: Inside the main element, under a name of boilerplate: a hint that the template has to confirm.
    named: bool


class _Element:
    """An element of the page; whether it is boilerplate is known once the whole page is read."""

    __slots__ = ("boilerplate", "depth", "hidden", "link", "listed", "main", "named", "parent", "path", "slot", "tag", "chars")

    def __init__(self, parent: _Element | None, tag: str, attributes: str):
        label, names, self.hidden = _names(attributes) if "=" in attributes or "hidden" in attributes else ("", set(), False)
        self.parent, self.tag, self.chars = parent, tag, 0
        self.listed = tag not in UNNAMED and bool(names & BOILERPLATE_NAMES)
        if parent is None:
            self.path = self.slot = ""
            self.depth, self.main, self.link, self.named, self.boilerplate = 0, False, False, False, False
            return
        self.depth = parent.depth + 1
        self.main = parent.main or tag in MAIN_TAGS or bool(names & MAIN_NAMES)
        self.link = parent.link or tag == "a"
        self.named = parent.named or (self.listed and parent.main)
        name = f"{tag}.{label}" if label else tag
        self.path = f"{parent.path}/{name}" if self.depth <= _MOST_DEPTH else parent.path
        self.slot = parent.slot if tag in INLINE else self.path


def _names(attributes: str) -> tuple[str, set[str], bool]:
    """(label for the path, whole names of class, id and role, hidden)."""
    label, names, hidden = [], set(), False
    for m in _ATTR.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            hidden = True
        elif name == "style":
            hidden = hidden or "display:none" in value.replace(" ", "")
        elif name in _NAMING and value:
            label.append(_DIGITS.sub("0", value.replace("/", "|")))
            names.update(value.split())
    whole = " ".join(label)
    if len(whole) > _LONG_LABEL:
        whole = xxhash.xxh64_hexdigest(whole)
    return whole, names, hidden


def _judge(elements: list[_Element]) -> None:
    """Mark boilerplate. Forms, headers and named blocks around the page's main element are none.

    The main element is the outermost article or the like with most text; on
    a page without one, a form that holds most of the text wraps the page.
    """
    for e in reversed(elements[1:]):
        e.parent.chars += e.chars
    largest = max((e for e in elements[1:] if e.main and not e.parent.main), key=lambda e: e.chars, default=None)
    around = set()
    while largest is not None:
        around.add(id(largest))
        largest = largest.parent
    whole = elements[0].chars
    for e in elements[1:]:
        outside = not e.parent.main
        wraps = id(e) in around or (not around and e.tag == "form" and 2 * e.chars >= whole)
        # An article's own header holds its title; any other header is the page's.
        soft = e.tag in WRAPPERS and (outside or e.tag != "header") or (e.listed and outside)
        e.boilerplate = e.parent.boilerplate or e.hidden or e.tag in BOILERPLATE_TAGS or (soft and not wraps)


def walk(html: str) -> Iterator[Run | str]:
    """Text runs in page order, and the path of every element as it opens.

    One pass over the page, whatever its tags: what was searched for in vain
    once is not searched for again.
    """
    elements = [_Element(None, "", "")]
    stack = [elements[0]]
    items: list[_Element | tuple[_Element, str, int]] = []
    open_tags: dict[str, int] = {}
    unclosed: set[str] = set()
    last_end = html.rfind(">")
    block, at, done, n = 0, 0, 0, len(html)

    def text(upto: int) -> None:
        if upto > done:
            part = html[done:upto]
            top = stack[-1]
            top.chars += len(part.strip())
            items.append((top, unescape(part) if "&" in part else part, block))

    def cut(depth: int) -> None:
        for e in stack[depth:]:
            open_tags[e.tag] -= 1
        del stack[depth:]

    while True:
        start = html.find("<", at)
        if start < 0 or start >= last_end:
            break
        if html.startswith("<!--", start):
            text(start)
            end = html.find("-->", start + 4)
            at = done = n if end < 0 else end + 3
            continue
        if html[start + 1] in "!?":
            text(start)
            at = done = html.index(">", start) + 1
            continue
        m = _TAG.match(html, start) or _LOOSE_TAG.match(html, start)
        if m is None:
            at = start + 1
            continue
        text(start)
        at = done = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag not in INLINE and tag != "br":
            block += 1
        if closing:
            if open_tags.get(tag):
                cut(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag))
            continue
        if tag == "br":
            items.append((stack[-1], " ", block))
            continue
        if tag in RAW:
            closed = attributes.rstrip().endswith("/")
            end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(html, at)
            if end is not None:
                at = end.end()
            else:
                unclosed.add(tag)
                at = n if tag in _TO_THE_END and not closed else at
            done = at
            continue
        if tag not in INLINE and open_tags.get("p"):
            # A block ends an open paragraph, with the inline elements left open in it.
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    cut(i)
                    break
                if stack[i].tag not in INLINE:
                    break
        if tag in _ENDS and any(open_tags.get(t) for t in _ENDS[tag]):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _ENDS[tag]:
                    cut(i)
                    break
                if stack[i].tag in _LIMITS:
                    break
        if tag in VOID or attributes.endswith("/") and tag not in MAIN_TAGS:
            continue
        stack.append(_Element(stack[-1], tag, attributes))
        open_tags[tag] = open_tags.get(tag, 0) + 1
        elements.append(stack[-1])
        items.append(stack[-1])
    text(n)
    _judge(elements)
    for item in items:
        if isinstance(item, _Element):
            yield item.path
        else:
            e, part, number = item
            yield Run(e.path, e.slot, part, number, e.boilerplate, e.main, e.link, e.named)


def joined(runs: list[Run]) -> str:
    """Runs as text: white space in a block becomes one space, blocks are joined by one space."""
    blocks: list[list[str]] = []
    last = None
    for run in runs:
        if run.block != last:
            blocks.append([])
            last = run.block
        blocks[-1].append(run.text)
    texts = (" ".join("".join(b).split()) for b in blocks)
    return " ".join(t for t in texts if t)
