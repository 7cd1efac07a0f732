"""A tolerant tree of an HTML page, as far as text density needs it."""

from __future__ import annotations

from html.parser import HTMLParser

# Elements without an end tag, without visible text, and those whose start ends an open one.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template head title iframe svg".split())
_PHRASE_PARENTS = frozenset("div section article aside main nav header footer td th li blockquote body table ul ol form fieldset figure".split())
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul center".split())
_SAME = {"li": "ul ol menu", "tr": "table tbody thead tfoot", "td": "tr table", "th": "tr table", "option": "select", "dt": "dl", "dd": "dl", "tbody": "table", "thead": "table"}
_CLOSES = {"li": ("li",), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "thead")}


class Node:
    """An element; text directly inside is kept in order with the child elements."""

    __slots__ = ("tag", "attrs", "parent", "children", "content", "order")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node] = []
        self.content: list[str | Node] = []

    def text(self) -> str:
        out, stack = [], [iter(self.content)]
        while stack:
            for x in stack[-1]:
                if isinstance(x, str):
                    out.append(x)
                else:
                    stack.append(iter(x.content))
                    break
            else:
                stack.pop()
        return "".join(out)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.here = Node("#root", {}, None)
        self.hidden = 0

    def updatepos(self, i: int, j: int) -> int:
        """Lines and columns aren't counted: nobody asks for them."""
        return j

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in VOID:
            if tag == "br":
                self.here.content.append("\n")
            return
        if tag in ("html", "body") and self._open(tag):
            return
        if tag in HIDDEN:
            self.hidden += 1
        if tag in _BLOCKS:
            self._close_paragraph()
        if tag in _CLOSES:
            self._close_same(tag)
        node = Node(tag, {k: v or "" for k, v in attrs}, self.here)
        self.here.children.append(node)
        self.here.content.append(node)
        self.here = node

    def handle_endtag(self, tag: str) -> None:
        node = self.here
        while node.parent is not None and node.tag != tag:
            # An end tag that matches nothing inside its cell or list item is stray.
            if node.tag in ("td", "table") and tag in ("p", "div", "span", "li", "b", "a") and node.tag != tag:
                return
            node = node.parent
        if node.parent is None:
            return
        x = self.here
        while x is not node.parent:
            if x.tag in HIDDEN:
                self.hidden -= 1
            x = x.parent
        self.here = node.parent

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.here.content.append(data)

    def _open(self, tag: str) -> bool:
        x = self.here
        while x is not None:
            if x.tag == tag:
                return True
            x = x.parent
        return False

    def _close_paragraph(self) -> None:
        x = self.here
        while x.parent is not None and x.tag not in _PHRASE_PARENTS:
            if x.tag == "p":
                self.here = x.parent
                return
            x = x.parent

    def _close_same(self, tag: str) -> None:
        x, ends = self.here, _SAME[tag].split()
        while x.parent is not None and x.tag not in ends:
            if x.tag in _CLOSES[tag]:
                self.here = x.parent
                if tag not in ("tr", "tbody"):
                    return
            x = x.parent


def parse(html: str) -> Node:
    """The tree of a page, whatever its faults; a page cut off ends its open elements."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):
        pass  # a declaration that can't be read: what came before it stays
    return builder.root


def walk(node: Node):
    """All elements below a node in document order."""
    stack = list(reversed(node.children))
    while stack:
        x = stack.pop()
        yield x
        stack.extend(reversed(x.children))
