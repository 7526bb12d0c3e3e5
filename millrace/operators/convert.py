"""Readable text of web pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements without readable text; those that are taken whole; and those that end an open paragraph (fixed by the markup's standard).
DROPPED = frozenset(("script", "style", "noscript", "template"))
HEADINGS = frozenset(f"h{n}" for n in range(1, 7))
WHOLE = HEADINGS | {"p", "li", "pre", "code"}
BLOCKS = HEADINGS | frozenset((
    "address", "article", "aside", "blockquote", "body", "center", "details", "dialog", "dir", "div", "dl", "fieldset", "figcaption", "figure", "footer",
    "form", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "ul",
))
LISTS = frozenset(("ul", "ol", "menu"))


class _Page(HTMLParser):
    """Writes a page as its tags come. An element that is taken whole collects its text until it ends, be it by its own tag, by one that
    can't stand in it, or by the end of what it is in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.title: str | None = None
        self.text: list[str] = []
        self.dropped = self.whole = ""
        self.inner = self.lists = 0
        self.in_title = False

    def written(self) -> str:
        self.close()
        self._end()
        head = (self.title or "").strip()
        return ((f"# {head}\n\n" if head else "") + "".join(self.out)).strip() + "\n"

    def _flush(self) -> None:
        """Text between two tags, outside of what is taken whole."""
        if not self.whole and not self.in_title:
            t = "".join(self.text).strip()
            self.out += [t, " "] if t else []
            self.text.clear()

    def _end(self) -> None:
        """What was open is complete."""
        self._flush()
        text, tag = "".join(self.text), self.whole
        if self.in_title:
            self.title = text if self.title is None else self.title
        elif tag in HEADINGS:
            self.out.append(f"\n\n{'#' * int(tag[1])} {text.strip()}\n\n")
        elif tag == "p":
            self.out.append(f"\n\n{text.strip()}\n\n")
        elif tag == "li":
            self.out.append(f"- {text.strip()}\n")
        elif tag:
            self.out.append(f"\n```\n{text.removeprefix(chr(10)) if tag == 'pre' else text}\n```\n\n")
        self.text.clear()
        self.whole, self.in_title, self.inner, self.lists = "", False, 0, 0

    def _ends(self, tag: str) -> bool:
        """Whether a start tag can't stand in what is open."""
        return (self.whole == "p" and tag in BLOCKS) or (self.whole in HEADINGS and tag in HEADINGS) or (self.whole == tag == "li" and not self.lists)

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.dropped or self.in_title:
            return
        if tag in DROPPED:
            self._flush()
            self.dropped = tag
        elif self.whole and not self._ends(tag):
            self.inner += tag == self.whole
            self.lists += tag in LISTS
        else:
            self._end()
            self.in_title = tag == "title"
            self.whole = tag if tag in WHOLE else ""
            if tag == "br":
                self.out.append("  \n")

    def handle_endtag(self, tag: str) -> None:
        if self.dropped:
            self.dropped = "" if tag == self.dropped else self.dropped
        elif self.in_title:
            self._end() if tag == "title" else None
        elif tag == self.whole and self.inner:
            self.inner -= 1
        elif tag in LISTS and self.lists:
            self.lists -= 1
        elif tag == self.whole or (self.whole == "p" and tag in BLOCKS) or (self.whole == "li" and tag in LISTS):
            self._end()
        else:
            self._flush()

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)


def page_text(html: str) -> str:
    page = _Page()
    page.feed(html)
    return page.written()


def html_text(html: Column) -> Column:
    """Readable text of a page: its title and headings as headings, paragraphs apart, list items as dashes, code in fences, line
    breaks; script, style, noscript, template and comments dropped; other elements give way to their content. Null for null."""
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(page_text, na_action="ignore")

    return run(html)
