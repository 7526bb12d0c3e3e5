"""Rich text to markdown: document trees in JSON and storage XHTML, through one small tree."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What tags of either format stand for (fixed values).
SAME = {
    "paragraph": "p", "bulletList": "ul", "orderedList": "ol", "listItem": "li", "blockquote": "blockquote", "rule": "hr", "hardBreak": "br",
    "tableRow": "tr", "tableCell": "td", "b": "strong", "i": "em", "link": "a",
}
#: Panels of the storage format with their labels (fixed values).
PANELS = {"info": "Info", "note": "Note", "warning": "Warning", "tip": "Tip", "success": "Success", "error": "Error"}
#: Macros and nodes without text of their own (fixed values).
DROPPED = {
    "toc", "children", "recently-updated", "contributors", "view-file", "lucidchart", "attachments", "script", "style", "media",
    "mediaSingle", "mediaGroup", "ac:image",
}
MARKS = {"code": "`{}`", "strong": "**{}**", "em": "*{}*"}
VOID = {"br", "hr", "img", "ri:page", "ri:user", "ri:attachment"}


class Node:
    def __init__(self, tag: str, attrs: dict | None = None, text: str = ""):
        self.tag, self.attrs, self.text, self.children = tag, attrs or {}, text, []

    def deep_text(self) -> str:
        return self.text + "".join(c.deep_text() for c in self.children)

    def first(self, tag: str) -> "Node | None":
        return next((c for c in self.children if c.tag == tag), None)


def _level(attrs: dict) -> int:
    """A heading's level from 1 to 6; 1 where it is no number."""
    level = attrs.get("level")
    return min(6, max(1, int(level))) if isinstance(level, (int, float)) else 1


def from_json(raw: dict) -> Node:
    """A node of a JSON document tree; text with marks becomes nested nodes, code innermost."""
    kind, attrs = raw.get("type", ""), raw.get("attrs") or {}
    if kind == "text":
        node = Node("#text", text=raw.get("text", ""))
        marks = {m.get("type"): m.get("attrs") or {} for m in raw.get("marks") or []}
        for m in ("code", "strong", "em", "link"):
            if m in marks:
                outer = Node(SAME.get(m, m), marks[m])
                outer.children, node = [node], outer
        return node
    if kind == "mention":
        return Node("#text", text="@" + str(attrs.get("text") or attrs.get("displayName") or "user").removeprefix("@"))
    if kind == "emoji":
        return Node("#text", text=str(attrs.get("text") or attrs.get("shortName") or ""))
    if kind in ("inlineCard", "blockCard"):
        url = attrs.get("url") or ""
        return Node("#text", text=f"[{url}]({url})" if url else "")
    tag = f"h{_level(attrs)}" if kind == "heading" else SAME.get(kind, kind)
    node = Node(tag, attrs)
    node.children = [from_json(c) for c in raw.get("content") or []]
    return node


class _Storage(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("doc")
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(SAME.get(tag, tag), dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(SAME.get(tag, tag), dict(attrs)))

    def handle_endtag(self, tag):
        tag = SAME.get(tag, tag)
        if any(n.tag == tag for n in self.open[1:]):
            while self.open.pop().tag != tag:
                pass

    def handle_data(self, data):
        self.open[-1].children.append(Node("#text", text=data.replace("\xa0", " ")))

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.open[-1].children.append(Node("#text", text=data[6:]))


def from_storage(text: str) -> Node:
    p = _Storage()
    p.feed(text)
    p.close()
    return p.root


def inline(node: Node) -> str:
    body = "".join(map(inline, node.children))
    if node.tag == "#text":
        return node.text
    if node.tag == "br":
        return "  \n"
    if node.tag in MARKS:
        return MARKS[node.tag].format(body) if body else ""
    if node.tag == "a":
        return f"[{body}]({node.attrs.get('href', '')})"
    if node.tag == "ac:link":
        return _link(node)
    if node.tag == "ac:structured-macro":
        return _macro(node).strip("\n")
    return "" if node.tag in DROPPED else body


def _link(node: Node) -> str:
    """Links to pages as marks that are resolved later: ⟦pg-id:ID|label⟧ and ⟦pg-title:SPACE|TITLE|label⟧."""
    label = (node.first("ac:link-body") or node.first("ac:plain-text-link-body") or Node("")).deep_text().strip()
    page, user = node.first("ri:page"), node.first("ri:user")
    if page is None:
        return "@" + (label or "user").removeprefix("@") if user is not None else label
    a = page.attrs
    if number := a.get("ri:content-id"):
        return f"⟦pg-id:{number}|{label or 'page ' + number}⟧"
    title = a.get("ri:content-title", "")
    return f"⟦pg-title:{a.get('ri:space-key', '')}|{title}|{label or title}⟧"


def _macro(node: Node) -> str:
    name = node.attrs.get("ac:name", "")
    given = {c.attrs.get("ac:name"): c.deep_text().strip() for c in node.children if c.tag == "ac:parameter"}
    rich, plain = node.first("ac:rich-text-body"), node.first("ac:plain-text-body")
    if name in DROPPED:
        return ""
    if name == "code":
        return f"```{given.get('language', '')}\n{plain.deep_text().rstrip(chr(10)) if plain else ''}\n```\n\n"
    if name == "jira":
        return given.get("key", "")
    if name in PANELS and rich:
        return f"> **{PANELS[name]}:** {inline(rich).strip()}\n\n"
    return blocks(rich) if rich else plain.deep_text() if plain else ""


def _quoted(node: Node) -> str:
    """Each block with a mark on its first line; lists and tables with one on every line."""
    out = ""
    for c, text in block_list(node):
        every = c is not None and c.tag in ("ul", "ol", "table")
        lines = text.split("\n")
        out += "\n".join(f"> {x}" if x and (every or not i) else x for i, x in enumerate(lines))
    return out


def _panel(node: Node) -> str:
    kind = node.attrs.get("panelType") or "info"
    rest, lead = Node("doc"), ""
    rest.children = list(node.children)
    if rest.children and rest.children[0].tag == "p":
        lead = inline(rest.children.pop(0))
    return f"> **{kind[:1].upper()}{kind[1:]}:** {lead}\n\n" + _quoted(rest)


def _list(node: Node, depth: int) -> str:
    """Items with their first paragraph beside the mark, other blocks below, inner lists indented."""
    out, number = "", 0
    for item in (c for c in node.children if c.tag == "li"):
        number += 1
        rest, lead = list(item.children), ""
        while rest and not _is_block(rest[0]):
            lead += inline(rest.pop(0))
        if not lead.strip() and rest and rest[0].tag == "p":
            lead = inline(rest.pop(0))
        out += "  " * depth + (f"{number}. " if node.tag == "ol" else "- ") + lead.strip() + "\n"
        for c in rest:
            if c.tag in ("ul", "ol"):
                out += _list(c, depth + 1)
            else:
                one = Node("doc")
                one.children = [c]
                out += blocks(one)
    return out


def _cell(node: Node) -> str:
    text = " ".join(x.deep_text() if x.tag == "#text" else inline(x) for x in node.children)
    return text.strip().replace("|", "\\|").replace("\n", " ")


def _table(node: Node) -> str:
    """A table with its first row that has header cells, or else its first row, as the head."""
    rows: list[list[str]] = []
    heads: list[int] = []

    def collect(n: Node):
        for c in n.children:
            if c.tag == "tr":
                cells = [cell for cell in c.children if cell.tag in ("td", "th", "tableHeader")]
                if any(cell.tag == "tableHeader" for cell in cells):
                    heads.append(len(rows))
                rows.append([_cell(cell) for cell in cells])
            else:
                collect(c)

    collect(node)
    if not any(rows):
        return ""
    rows.insert(0, rows.pop(heads[0] if heads else 0))
    width = len(rows[0])
    lines = ["| " + " | ".join(r + [""] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * width, *lines[1:]]) + "\n\n"


def _is_block(node: Node) -> bool:
    """Whether a node is a block, or an unknown one that holds blocks."""
    return node.tag in BLOCKS or node.tag in DROPPED or (node.tag not in INLINE and any(map(_is_block, node.children)))


def block_list(node: Node) -> list[tuple[Node | None, str]]:
    """The blocks of a node's children with their markdown; inline children in a row make a paragraph (None)."""
    out: list[tuple[Node | None, str]] = []
    run = ""

    def end_run():
        nonlocal run
        if run.strip():
            out.append((None, run.strip() + "\n\n"))
        run = ""

    for c in node.children:
        if not _is_block(c):
            run += inline(c)
            continue
        end_run()
        if c.tag in BLOCKS:
            out.append((c, BLOCKS[c.tag](c)))
        elif c.tag not in DROPPED:
            out += block_list(c)
    end_run()
    return out


def blocks(node: Node) -> str:
    return "".join(text for _, text in block_list(node))


def _paragraph(n: Node) -> str:
    text = inline(n).strip()
    return f"{text}\n\n" if text else ""


INLINE = {"#text", "br", "a", "ac:link", *MARKS}
BLOCKS = {
    **{f"h{i}": (lambda n, i=i: f"{'#' * i} {inline(n).strip()}\n\n") for i in range(1, 7)},
    "p": _paragraph, "ul": lambda n: _list(n, 0) + "\n", "ol": lambda n: _list(n, 0) + "\n", "hr": lambda n: "---\n\n", "table": _table, "doc": blocks,
    "pre": lambda n: f"```{n.attrs.get('language', '')}\n{n.deep_text().strip(chr(10))}\n```\n\n", "blockquote": _quoted, "panel": _panel,
    "codeBlock": lambda n: f"```{n.attrs.get('language') or ''}\n{n.deep_text()}\n```\n\n", "ac:structured-macro": _macro,
    **{t: blocks for t in ("div", "section", "tbody", "ac:layout", "ac:layout-section", "ac:layout-cell", "expand", "layoutSection", "layoutColumn")},
}


def markdown(node: Node) -> str:
    """Markdown that ends in exactly one line's end; empty for an empty tree."""
    text = blocks(node).strip("\n")
    return text + "\n" if text else ""


def _tree(raw: str | None) -> str | None:
    if raw is None:
        return None
    try:
        return markdown(from_json(json.loads(raw)))
    except (ValueError, AttributeError, TypeError):
        return None


def tree_markdown(c: Column) -> Column:
    """Markdown of JSON document trees; null for what is none."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(_tree)

    return run(c)


def trees_markdown(c: Column) -> Column:
    """Markdown of each tree of an array."""

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda trees: None if trees is None else [_tree(t) for t in trees])

    return run(c)


def storage_markdown(c: Column) -> Column:
    """Markdown of storage XHTML."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else markdown(from_storage(t)))

    return run(c)
