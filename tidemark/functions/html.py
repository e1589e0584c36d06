"""HTML that is safe to show: allowed tags and attributes alone, well nested."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from tidemark.functions.strings import ATTRIBUTES, EVERYWHERE, PROTOCOLS, TAGS

#: Tags without an end, and tags whose contents go as well.
VOID = {"br", "img", "hr", "col"}
SILENT = {"script", "style", "title", "noscript"}
#: A tag that ends an open tag of these, unless one of the others lies between.
_ITEMS = ({"li"}, {"ul", "ol"}), ({"dt", "dd"}, {"dl"}), ({"tr"}, {"table", "thead", "tbody", "tfoot"}), ({"td", "th"}, {"tr", "table"}), ({"p"}, {"td", "th", "li", "div", "blockquote"})
ENDS = {tag: (own, walls) for own, walls in _ITEMS for tag in own}
BLOCKS = {"blockquote", "div", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "pre", "table", "ul"}  # they end an open paragraph


class _Cleaner(HTMLParser):
    """Writes what is allowed; open tags are a stack, so that an end tag ends what was opened inside, and no other."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []
        self.silent = ""

    def _end(self, depth: int) -> None:
        while len(self.open) > depth:
            self.out.append(f"</{self.open.pop()}>")

    def _implied(self, tag: str) -> None:
        for name in [tag, *(["p"] if tag in BLOCKS else [])]:
            own, walls = ENDS.get(name, ((), ()))
            for depth in range(len(self.open) - 1, -1, -1):
                if self.open[depth] in walls:
                    break
                if self.open[depth] in own:
                    self._end(depth)
                    break

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.silent:
            return
        if tag in SILENT:
            self.silent = tag
        elif tag in TAGS:
            self._implied(tag)
            self.out.append(f"<{tag}{_attributes(tag, attrs)}>")
            if tag not in VOID:
                self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in SILENT:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.silent:
            self.silent = "" if tag == self.silent else self.silent
        elif tag in self.open:
            self._end(len(self.open) - 1 - self.open[::-1].index(tag))

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.out.append(escape(data, quote=False))


def _attributes(tag: str, attrs: list[tuple[str, str | None]]) -> str:
    """The allowed ones, each once; links are judged as a browser reads them: entities decoded, control characters aside."""
    kept: dict[str, str] = {}
    for name, value in attrs:
        if name in kept or not (name in EVERYWHERE or name in ATTRIBUTES.get(tag, [])):
            continue
        plain = "".join(ch for ch in value or "" if ch > " ").lower()
        if name not in PROTOCOLS or plain.startswith(tuple(PROTOCOLS[name])):
            kept[name] = value or ""
    return "".join(f' {name}="{escape(value)}"' for name, value in kept.items())


def safe(text: str | None) -> str:
    cleaner = _Cleaner()
    cleaner.feed(text or "")
    cleaner.close()
    cleaner._end(0)
    return "".join(cleaner.out)


@F.pandas_udf(StringType())
def _safe(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(safe)


def balanced_html(c: Column) -> Column:
    """HTML with the allowed tags and attributes alone, every opened tag closed in its place; null is "".

    The text of other tags stays, that of scripts, styles, titles and comments goes.  An end tag
    without a beginning goes; a list item, a table cell or row and a paragraph end where the next begins.
    """
    return _safe(F.coalesce(c, F.lit("")))
