"""One HTML page to flat facts: text pieces, links, paragraphs, candidate blocks.

The only Python that runs per page. It decides nothing: which links and blocks
count is worked out by DataFrame steps on the facts listed here. A block names
its text as a range of the page's pieces, so nested blocks repeat no text.

Tags are cut with one compiled pattern; attributes are looked at only where a
class or a link is wanted. That reads several times as many pages per second as
the standard library's parser.
"""

from __future__ import annotations

import re
from html import unescape
from operator import itemgetter
from urllib.parse import urljoin

# A whole script or style, a comment or declaration, or a tag: (1) script or style,
# (2) slash of an end tag, (3) name, (4) attributes. No tag reaches over the next "<" outside
# quotes, so a page full of unclosed tags is still read in one go.
_ATTRIBUTES = r"(?:[^<>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+"
_TAG = re.compile(
    rf"<(script|style)\b{_ATTRIBUTES}>.*?(?:</\1[^>]*+>|\Z)|<!--.*?(?:-->|\Z)|<[!?][^<>]*+>"
    rf"|<(/?)([A-Za-z][^\s/>]*+)({_ATTRIBUTES})>",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
# The attributes of a link that has nothing but its address, without entities.
_HREF = re.compile(r"\s+href=\"([^\"&]*)\"\s*")
_ORIGIN = re.compile(r"https?://[^/?#\s]+")
# A page URL whose folder can be put in front of a link as it is.
_PLAIN_BASE = re.compile(r"(https?://[A-Za-z0-9.:\-]+)((?:/(?!\.)[^\s/?#;\x00-\x20]+)*/?)")
# Links that stand for themselves (another scheme, a whole URL), and links to a place on the page.
_WHOLE = re.compile(r"(?:javascript|mailto|tel):(?!//)[^\s\x00-\x20]*|https?://[A-Za-z0-9.:\-]+(?:/[^\s?#;\x00-\x20]*)?(?:\?[^\s#\x00-\x20]+)?(?:#[^\s\x00-\x20]+)?")
_PLACE = re.compile(r"#[^\s\x00-\x20]+")
# A link beside the page, without dot segments and empty parts: folder + link.
_BESIDE = re.compile(r"(?!\.)[^\s/:?#;\x00-\x20]+(?:/(?!\.)[^\s/:?#;\x00-\x20]+)*/?(?:\?[^\s#\x00-\x20]+)?(?:#[^\s\x00-\x20]+)?")
# A rooted link without dot segments and empty parts: origin + link, nothing to resolve.
_ROOTED = re.compile(r"/(?!/)[^\s?#;]*(?:\?[^\s#]+)?(?:#\S+)?")

# Fixed values of HTML: elements without content, and one (besides script and style) whose
# text is not read.
VOID = frozenset(
    "area base br col embed frame hr img input link meta param source track wbr".split()
)
UNREAD = frozenset(["template"])
# Fixed values of HTML 4: start tags that end an open paragraph or list entry.
_BLOCK_STARTS = frozenset(
    "address blockquote center dd dir div dl dt fieldset form h1 h2 h3 h4 h5 h6 hr li menu ol p "
    "pre table tbody td tfoot th thead tr ul".split()
)
_ENDED_BY = {
    "p": _BLOCK_STARTS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "td": frozenset(["td", "th", "tr", "tbody"]),
    "th": frozenset(["td", "th", "tr", "tbody"]),
    "tr": frozenset(["tr", "tbody"]),
    "a": frozenset(["a"]),
    "head": frozenset(["body"]),
}
# An end tag closes nothing across an open element of a higher level.
_LEVEL = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180,
    "tfoot": 180, "table": 190, "head": 200, "body": 200, "html": 220,
}


_FIRST = itemgetter(0)
# Start tags whose attributes were looked at, by their text: pages of one site, and of most sites, share them.
_REMEMBERED = 4096


class _Tag:
    """What the rules say of a start tag; links are looked at anew each time, as hardly two are alike."""

    __slots__ = ("name", "classes", "zone", "nav_side", "void", "level", "ended_by", "block", "title", "summary", "heading")

    def __init__(self, name: str, classes: list[str] | None, rules: dict):
        def class_has(rule):
            return bool(classes) and any(part in word for word in map(str.lower, classes) for part in rules[rule])

        self.name, self.classes = name, classes
        # 0 in nav or header, 1 in a menu container, 2 elsewhere
        self.zone = 0 if name in rules["zone_tags"] else 1 if name in rules["zone_classed_tags"] and class_has("zone_parts") else 2
        self.nav_side = name in rules["nav_tags"] or (classes is not None and not rules["nav_classes"].isdisjoint(classes))
        self.void = name in VOID
        self.level = _LEVEL.get(name, 100)
        self.ended_by = _ENDED_BY.get(name, frozenset())
        self.block = name in rules["plain_blocks"] or (
            classes is not None and (name in rules["classed_blocks"] or not rules["block_classes"].isdisjoint(classes))
        )
        self.title = name in rules["title_tags"]
        self.summary = name in rules["summary_tags"] and class_has("summary_parts")
        self.heading = name in rules["heading_tags"]


def _found(attributes: str) -> dict[str, str]:
    found = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), unescape(values[0] or values[1] or values[2]))
    return found


class PageFacts:
    """Facts of the page at ``url``; ``rules`` names the tags and classes to look for.

    Either links are read (``only_links`` among the rules: no text outside them, no paragraphs, no blocks) or all the
    rest. ``tags`` among the rules remembers start tags from page to page. ``links``: lists of link_ix, href, link_url,
    text, zone. ``paras``: tuples of start, stop, chars. ``blocks``: tuples of ix, tag, classes, chars, in_nav,
    has_heading, has_link, link, and the ranges of text, title (or None), summary (or None) and paras.
    """

    def __init__(self, url: str, html: str, rules: dict):
        self.url, self.rules = url, rules
        self.pieces, self.paras, self.links, self.blocks = [], [], [], []
        self._tags = rules.get("tags", {})
        self._bases = None  # origin, page and folder that links are put behind
        # One cut of the whole page: a text, then the four groups of the tag behind it, and so on.
        parts = _TAG.split(html)
        parts += [None] * 4
        cut = iter(parts)
        each = zip(cut, cut, cut, cut, cut)
        if rules.get("only_links", False):
            self._read_links(each)
        else:
            self._read_blocks(each)

    def _read_links(self, cut):
        pieces, links, tags, absolute = self.pieces, self.links, self._tags, self._absolute
        stack: list[tuple] = []  # of each open element: tag, zone, link, first piece
        open_by_tag: dict[str, int] = {}
        in_link = unread = 0

        def close():
            nonlocal in_link, unread
            tag, _, link, piece = stack.pop()
            name = tag.name
            open_by_tag[name] -= 1
            if name == "a":
                in_link -= 1
                if link is not None:
                    link[3] = "".join(pieces[piece:]).lower()
            elif name in UNREAD:
                unread -= 1

        for text, _, slash, name, attributes in cut:
            if text and in_link and not unread:
                if "&" in text:
                    text = unescape(text)
                text = text.strip()
                if text:
                    pieces.append(text)
            if not name:
                continue
            if slash:
                if stack and stack[-1][0].name == name:
                    close()
                else:
                    for _ in range(self._ended(stack, open_by_tag, name.lower())):
                        close()
                continue
            href = None
            if not attributes or "=" not in attributes:
                tag = tags.get(name) or self._remember(name)
            elif name == "a" or name == "A":
                tag, href = self._link_tag(attributes)
            else:
                tag = tags.get((name, attributes)) or self._remember(name, attributes)
            name = tag.name
            while stack and name in stack[-1][0].ended_by:
                close()
            if tag.void:
                continue
            zone = tag.zone
            if stack and stack[-1][1] < zone:
                zone = stack[-1][1]
            link = None
            if href is not None:
                href = href.strip()
                link = [len(links), href, absolute(href), None, zone]
                links.append(link)
            stack.append((tag, zone, link, len(pieces)))
            open_by_tag[name] = open_by_tag.get(name, 0) + 1
            if name == "a":
                in_link += 1
            elif name in UNREAD:
                unread += 1
        while stack:
            close()

    def _read_blocks(self, cut):
        pieces, paras, blocks, tags = self.pieces, self.paras, self.blocks, self._tags
        lengths = [0]  # running text length after each piece
        # Of each open element: tag, number, first piece, first paragraph; then the first link, title and summary seen
        # below it, and whether a heading was.
        stack: list[list] = []
        open_by_tag: dict[str, int] = {}
        levels = self.rules["nav_levels"]
        unread = count = 0

        def close():
            nonlocal unread
            tag, ix, piece, para, href, title, summary, heading = stack.pop()
            name, end = tag.name, len(pieces)
            open_by_tag[name] -= 1
            if name == "p":
                paras[para] = (piece, end, lengths[end] - lengths[piece])
            elif name in UNREAD:
                unread -= 1
            if tag.block:
                link = href if name != "a" else None
                in_nav = False
                for above in stack[-levels:]:
                    if above[0].nav_side:
                        in_nav = True
                        break
                blocks.append(
                    (
                        ix, name, tag.classes, lengths[end] - lengths[piece], in_nav, heading, link is not None,
                        None if link is None else self._absolute(link), (piece, end), title, summary, (para, len(paras)),
                    )
                )
            if stack:
                parent = stack[-1]
                if tag.title:
                    title = (piece, end)
                if title is not None and parent[5] is None:
                    parent[5] = title
                if tag.summary:
                    summary = (piece, end)
                if summary is not None and parent[6] is None:
                    parent[6] = summary
                if href is not None and parent[4] is None and parent[0].name != "a":
                    parent[4] = href
                if heading or tag.heading:
                    parent[7] = True

        for text, script, slash, name, attributes in cut:
            if text and not unread:
                if "&" in text:
                    text = unescape(text)
                text = text.strip()
                if text:
                    pieces.append(text)
                    lengths.append(lengths[-1] + len(text))
            if not name:
                if script:
                    count += 1  # a script is an element too
                continue
            if slash:
                if stack and stack[-1][0].name == name:
                    close()
                else:
                    for _ in range(self._ended(stack, open_by_tag, name.lower())):
                        close()
                continue
            href = None
            if not attributes or "=" not in attributes:
                tag = tags.get(name) or self._remember(name)
            elif name == "a" or name == "A":
                tag, href = self._link_tag(attributes)
            else:
                tag = tags.get((name, attributes)) or self._remember(name, attributes)
            name = tag.name
            while stack and name in stack[-1][0].ended_by:
                close()
            if not tag.void or tag.block:
                stack.append([tag, count, len(pieces), len(paras), href, None, None, False])
                open_by_tag[name] = open_by_tag.get(name, 0) + 1
                if name == "p":
                    paras.append(None)
                elif name in UNREAD:
                    unread += 1
                if tag.void:
                    close()
            count += 1
        while stack:
            close()
        blocks.sort(key=_FIRST)

    def _remember(self, name, attributes=None):
        found = _found(attributes) if attributes else {}
        return self._kept((name, attributes) if attributes else name, name.lower(), found.get("class"))

    def _link_tag(self, attributes):
        """The tag and the href of a link; links of the same classes share a tag."""
        plain = _HREF.fullmatch(attributes)
        if plain:
            return self._tags.get("a") or self._remember("a"), plain[1]
        found = _found(attributes)
        if "class" not in found:
            return self._tags.get("a") or self._remember("a"), found.get("href")
        key = ("a", found["class"])  # no other key: attributes of links are not remembered
        return self._tags.get(key) or self._kept(key, "a", found["class"]), found.get("href")

    def _kept(self, key, name, classes):
        tag = _Tag(name, None if classes is None else classes.split(), self.rules)
        if len(self._tags) >= _REMEMBERED:
            self._tags.clear()
        self._tags[key] = tag
        return tag

    @staticmethod
    def _ended(stack, open_by_tag, name) -> int:
        """How many open elements an end tag closes that does not belong to the innermost one."""
        if not open_by_tag.get(name):
            return 0
        level = _LEVEL.get(name, 100)
        for depth in range(len(stack) - 1, -1, -1):
            tag = stack[depth][0]
            if tag.name == name:
                return len(stack) - depth
            if tag.level > level:
                return 0
        return 0

    def _absolute(self, href):
        if self._bases is None:
            origin, plain = _ORIGIN.match(self.url), _PLAIN_BASE.fullmatch(self.url)
            folder = plain and f"{plain[1]}{plain[2][: plain[2].rfind('/') + 1] or '/'}"
            self._bases = origin and origin[0], plain and self.url, folder
        origin, page, folder = self._bases
        if origin and "/." not in href and _ROOTED.fullmatch(href):
            return origin + href
        if page:
            if _WHOLE.fullmatch(href):
                return href
            if _PLACE.fullmatch(href):
                return page + href
            if _BESIDE.fullmatch(href):
                return folder + href
        try:
            return urljoin(self.url, href)
        except ValueError:  # not a URL at all
            return None


def read_page(url: str, html: str, rules: dict) -> PageFacts:
    return PageFacts(url, html, rules)
