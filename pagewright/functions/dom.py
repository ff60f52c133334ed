"""A forgiving HTML reader for measuring pages: one pass of a tokenizer, implied end tags, void elements.

Nothing is a tree of objects with children: elements stand in document order, and each knows the places of
its descendants and of its text, which are contiguous. What is asked of ancestors (regions, pictures, silence) is
noted when an element opens. No adoption agency and no foster parenting: misnested formatting closes
where its parent closes. Any string can be read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Opening one of these ends an open element of the listed kinds, up to the nearest of the stops.
ENDS = {
    "li": (("li",), ("ul", "ol")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tr", "td", "th"), ("table",)),
    "thead": (("thead", "tbody", "tr", "td", "th"), ("table",)),
}
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
HEAD = frozenset("base link meta title script style noscript template".split())
SILENT = frozenset("script style noscript template svg".split())
#: Elements whose content is text up to their own end tag; in the second group with character references.
RAW, RAW_WITH_REFERENCES = frozenset("script style xmp iframe noembed noframes".split()), frozenset("title textarea".split())
#: What opens a region, in order of precedence: name, elements, role.
REGIONS = (("nav", ("nav",), "navigation"), ("footer", ("footer",), "contentinfo"), ("header", ("header",), "banner"), ("aside", ("aside",), "complementary"), ("main", ("main", "article"), "main"))
TAG_BITS = {t: 1 << i for i, (_, tags, _) in enumerate(REGIONS) for t in tags}
ROLE_BITS = {role: 1 << i for i, (_, _, role) in enumerate(REGIONS)}
REGION_OF = tuple(REGIONS[(b & -b).bit_length() - 1][0] if b else "body" for b in range(1 << len(REGIONS)))
SPACE = re.compile(r"[\s\ufeff]+")
TOKEN = re.compile(r"""<(?:([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*"|'[^']*')|[="'])*+)>|/([a-zA-Z][^\s/>]*+)[^>]*+>|(!--)|[!?/])""")
ATTRIBUTE = re.compile(r"""([^\s=/>"'][^\s=/>]*+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*+)))?""")
COMMENT_END = re.compile(r"--!?>")
OPENS = re.compile(r"</?[a-zA-Z]")
REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);")


def closed_references(text: str) -> str:
    """text with its character references read, those that end in a semicolon; what a cut left of others stays as it is."""
    return REFERENCE.sub(lambda m: unescape(m[0]), text)


class Node:
    __slots__ = ("tag", "attrs", "at", "end", "text_at", "text_end", "images", "images_end", "regions", "in_head", "in_picture", "hushed")

    def get(self, name: str) -> str | None:
        """An attribute, null if absent or empty."""
        return self.attrs.get(name) or None

    @property
    def region(self) -> str:
        return REGION_OF[self.regions]


class Page:
    """nodes: the elements in document order, the root left out; by: the same by tag."""

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        self.by: dict[str, list[Node]] = {}
        self.texts: list[str] = []
        self.loud: list[str] = []  # texts without those of silent elements
        self.html: dict[str, str] = {}

    def of(self, tag: str) -> list[Node]:
        return self.by.get(tag, [])

    def text(self, n: Node) -> str:
        return "".join(self.texts[n.text_at : n.text_end])

    def spoken(self, n: Node) -> str:
        """Text without that of silent elements inside."""
        return "".join((self.texts if n.hushed else self.loud)[n.text_at : n.text_end])

    def below(self, n: Node) -> list[Node]:
        return self.nodes[n.at + 1 : n.end]


class _Reader:
    def __init__(self, read: Callable[[str], str]) -> None:
        self.page, self.read = Page(), read
        self.stack: list[Node] = []
        self.open: dict[str, int] = {}
        self.hush = self.images = 0
        self.in_body = False
        self.head = self.opened("head", {})
        self.body: Node | None = None

    def opened(self, tag: str, attrs: dict[str, str]) -> Node:
        n, page = Node(), self.page
        n.tag, n.attrs, n.at = tag, attrs, len(page.nodes)
        n.text_at, n.images = len(page.texts), self.images
        n.end = n.text_end = n.images_end = -1
        bits = TAG_BITS.get(tag, 0)
        if "role" in attrs:
            bits |= ROLE_BITS.get(attrs["role"], 0)
        if self.stack:
            above = self.stack[-1]
            bits |= above.regions
            n.in_picture, n.in_head = above.in_picture or tag == "picture", above.in_head
        else:
            n.in_picture, n.in_head = tag == "picture", tag == "head"
        n.regions, n.hushed = bits, self.hush > 0
        page.nodes.append(n)
        page.by.setdefault(tag, []).append(n)
        self.stack.append(n)
        self.open[tag] = self.open.get(tag, 0) + 1
        if tag in SILENT:
            self.hush += 1
        elif tag == "img":
            self.images += 1
        return n

    def close(self) -> None:
        n = self.stack.pop()
        n.end, n.text_end, n.images_end = len(self.page.nodes), len(self.page.texts), self.images
        self.open[n.tag] -= 1
        if n.tag in SILENT:
            self.hush -= 1

    def close_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.close()

    def to_body(self) -> None:
        if not self.in_body:
            self.in_body = True
            self.close_to(0)
            self.body = self.opened("body", {})

    def imply(self, names: tuple[str, ...], stops: tuple[str, ...]) -> None:
        last = None
        for depth in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[depth].tag
            if tag in stops:
                break
            if tag in names:
                last = depth
        if last is not None:
            self.close_to(last)

    def start(self, tag: str, attrs: dict[str, str], closed: bool) -> None:
        if tag in ("html", "head", "body"):
            if tag == "body":
                self.to_body()
            own = self.page.html if tag == "html" else self.head.attrs if tag == "head" else self.body.attrs
            for k, v in attrs.items():
                own.setdefault(k, v)
            if tag == "body":
                self.body.regions |= ROLE_BITS.get(attrs.get("role"), 0)
            return
        if not self.in_body and tag not in HEAD and len(self.stack) == 1:
            self.to_body()
        if tag in BLOCKS and self.open.get("p"):
            self.imply(("p",), ("button", "table"))
        if tag in ENDS and any(self.open.get(x) for x in ENDS[tag][0]):
            self.imply(*ENDS[tag])
        self.opened(tag, attrs)
        if tag in VOID or closed and self.open.get("svg"):
            self.close()

    def finish(self, tag: str) -> None:
        if tag == "head":
            self.to_body()
        elif tag not in ("html", "body") and self.open.get(tag):
            for depth in range(len(self.stack) - 1, 0, -1):
                if self.stack[depth].tag == tag:
                    self.close_to(depth)
                    return

    def data(self, text: str) -> None:
        if not self.in_body and len(self.stack) == 1:
            if not text.strip():
                return
            self.to_body()
        if "&" in text:
            text = self.read(text)
        self.page.texts.append(text)
        self.page.loud.append("" if self.hush else text)

    def raw(self, text: str) -> None:
        if text:
            self.page.texts.append(text)
            self.page.loud.append("" if self.hush else text)


def attributes(raw: str, read: Callable[[str], str] = unescape) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(raw):
        value = double or single or bare
        out.setdefault(name.lower(), read(value) if "&" in value else value)
    return out


def parse(html: str, read: Callable[[str], str] = unescape) -> Page:
    """html as a page; read: how character references are read, by default as browsers do."""
    r, at, size, match = _Reader(read), 0, len(html), TOKEN.match
    while at < size:
        begin = html.find("<", at)
        while begin >= 0 and (m := match(html, begin)) is None and not OPENS.match(html, begin):
            begin = html.find("<", begin + 1)  # that one was text
        if begin < 0 or m is None:  # a tag that the page's end cuts off is dropped
            if text := html[at:] if begin < 0 else html[at:begin]:
                r.data(text)
            break
        if begin > at:
            r.data(html[at:begin])
        at = m.end()
        tag, own, ended, comment = m.groups()
        if tag is not None:
            tag = tag.lower()
            closed = own.endswith("/")
            r.start(tag, attributes(own, read) if own else {}, closed)
            if (tag in RAW or tag in RAW_WITH_REFERENCES) and r.stack and r.stack[-1].tag == tag:
                end = re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE).search(html, at)
                text = html[at : end.start() if end else size]
                r.raw(read(text) if tag in RAW_WITH_REFERENCES else text)
                at = end.start() if end else size
        elif ended is not None:
            r.finish(ended.lower())
        elif comment is not None:
            if html.startswith((">", "->"), at):
                at = html.index(">", at) + 1
            else:
                end = COMMENT_END.search(html, at)
                at = end.end() if end else size
        else:  # a declaration, an instruction or an end tag without a name
            end = html.find(">", at - 1)
            at = end + 1 if end >= 0 else size
    r.to_body()
    r.close_to(0)
    return r.page


def squeeze(s: str | None, limit: int = 300) -> str:
    if not s:
        return ""
    return (" ".join(s.split()) if s.isascii() else SPACE.sub(" ", s).strip())[:limit]
