"""HTML to blocks: the one step of page parsing that needs Python.

``page_blocks`` flattens a page to the elements that follow its headings; what
they mean is decided by column expressions later.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd

from quire.runtime import vectorised

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CLOSES_P = {"address", "article", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = ("h1", "h2", "h3")
#: Tags in their plainest form, read by one match each; all others are left to the lenient parser.
PLAIN_START = re.compile(r"""<([a-z][a-z0-9]*)((?: [a-z][a-z-]*=(?:"[^"'&<>]*"|'[^"'&<>]*'))*)>""")
PLAIN_END = re.compile(r"</([a-z][a-z0-9]*)>")
PLAIN_ATTR = re.compile(r""" ([a-z][a-z-]*)=["']([^"']*)["']""")
#: Characters of HTML, about, whose blocks go back to Spark at a time.
PIECE = 2_000_000
#: Elements whose contents may be no markup.
PARSED_APART = {"script", "style", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext", "textarea", "title"}

BLOCK = "struct<no:int,head:int,head_id:string,head_tag:string,kind:string,label:string,lines:string,inline:string,joined:string,href:string,hrefs:array<string>>"
PAGE = f"struct<title_b:string,title_h:string,title_tag:string,tags:array<string>,headings:array<struct<no:int,tag:string,id:string,text:string>>,blocks:array<{BLOCK}>,links:array<struct<href:string,text:string>>>"


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.children = tag, attrs or {}, []

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [c for c in reversed(n.children) if isinstance(c, Node)]

    def first(self, *tags: str) -> Node | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def strings(self) -> list[str]:
        """Stripped pieces of text below, empty ones left out."""
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                stack += reversed(c.children)
            elif s := c.strip():
                out.append(s)
        return out

    def raw(self) -> str:
        out, stack = [], list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, Node):
                stack += reversed(c.children)
            else:
                out.append(c)
        return "".join(out)


class Tree(HTMLParser):
    """A forgiving tree: unclosed paragraphs and list items end where the next one begins."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("")
        self.open = [self.root]

    def updatepos(self, i, j):  # line numbers, which nobody asks for
        return j

    def parse_starttag(self, i):
        m = PLAIN_START.match(self.rawdata, i)
        if m is None or m[1] in PARSED_APART:
            return super().parse_starttag(i)
        self.handle_starttag(m[1], PLAIN_ATTR.findall(m[2]) if m[2] else ())
        return m.end()

    def parse_endtag(self, i):
        m = PLAIN_END.match(self.rawdata, i) if self.cdata_elem is None else None
        if m is None:
            return super().parse_endtag(i)
        self.handle_endtag(m[1])
        return m.end()

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and any(n.tag == "p" for n in self.open):
            self._close("p", {"blockquote", "li", "td", "div"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        n = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(n)
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def _close(self, tag: str, stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        if self.open[-1].tag not in ("script", "style"):
            self.open[-1].children.append(data)


def tree(html: str | None) -> Node:
    t = Tree()
    t.feed(html or "")
    t.close()
    return t.root


def parse_page(html: str | None) -> dict:
    root = tree(html)
    nodes = list(root.walk())
    title = next((n for n in nodes if n.tag == "div" and "post-title" in n.attrs.get("class", "").split()), None)
    tags = next((n for n in nodes if n.tag == "div" and "post-tags" in n.attrs.get("class", "").split()), None)
    text = lambda n: "".join(n.strings()) if n is not None else None
    names = [text(a) for a in tags.walk() if a.tag == "a" and "post-category" in a.attrs.get("class", "").split() and "/categories#" not in a.attrs.get("href", "")] if tags else []
    tag = next((n for n in nodes if n.tag == "title"), None)
    headings, blocks = [], []

    def note(kind: str, node: Node, head: int, label: str | None = None, body: Node | None = None) -> None:
        s = (body or node).strings()
        links = [a.attrs["href"] for a in node.walk() if a.tag == "a" and "href" in a.attrs]
        h = headings[head]
        blocks.append({
            "no": len(blocks), "head": head, "head_id": h["id"], "head_tag": h["tag"], "kind": kind, "label": label, "lines": "\n".join(s),
            "inline": " ".join(s), "joined": node.raw() if kind == "pre" else "".join(s), "href": links[0] if links else None, "hrefs": links,
        })

    for parent in [root, *nodes]:
        at = None
        for c in parent.children:
            if not isinstance(c, Node):
                continue
            if c.tag in HEADINGS:
                at = len(headings)
                headings.append({"no": at, "tag": c.tag, "id": c.attrs.get("id", ""), "text": text(c)})
            elif c.tag == "hr":
                at = None
            elif at is not None and c.tag in ("ul", "ol"):
                for li in (x for x in c.children if isinstance(x, Node) and x.tag == "li"):
                    strong, quote = li.first("strong"), li.first("blockquote")
                    both = strong is not None and quote is not None
                    note("field" if both else "li", li, at, text(strong) if both else None, quote if both else None)
            elif at is not None:
                note(c.tag, c, at)
    links = [{"href": a.attrs["href"], "text": text(a)} for a in nodes if a.tag == "a" and "href" in a.attrs]
    return {
        "title_b": text(title.first("b")) if title else None, "title_h": text(title.first(*HEADINGS)) if title else None, "title_tag": text(tag),
        "tags": [n for n in names if n], "headings": headings, "blocks": blocks, "links": links,
    }


@vectorised(PAGE, once=True)
def page_blocks(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Blocks take several times the page's size, so they go back in pieces, however many pages come at a time."""
    columns = ["title_b", "title_h", "title_tag", "tags", "headings", "blocks", "links"]
    for html in pages:
        rows, room = [], PIECE
        for h in html:
            rows.append(parse_page(h))
            room -= len(h or "")
            if room < 0:
                yield pd.DataFrame(rows, columns=columns)
                rows, room = [], PIECE
        if rows:
            yield pd.DataFrame(rows, columns=columns)


@vectorised("array<struct<filename:string,area:string>>")
def categories(html: pd.Series) -> pd.Series:
    """(filename, area) of a categories page: divs with a link after an ``h3`` that has an id."""
    def one(text):
        out = []
        for parent in (root := tree(text)), *root.walk():
            area = None
            for c in parent.children:
                if isinstance(c, Node) and c.tag == "h3":
                    area = c.attrs.get("id", "").strip() or None
                elif isinstance(c, Node) and c.tag == "div" and area:
                    a = next((x for x in c.walk() if x.tag == "a" and "href" in x.attrs), None)
                    name = a.attrs["href"].rstrip("/").split("/")[-1] if a else ""
                    if name.endswith(".html"):
                        out.append({"filename": name, "area": area})
        return out

    return html.map(one)


@vectorised("string")
def visible_text(html: pd.Series) -> pd.Series:
    """Text of a page without scripts and styles, runs of white space as one blank."""
    return html.map(lambda h: re.sub(r"\s+", " ", " ".join(tree(h).strings())), na_action="ignore")
