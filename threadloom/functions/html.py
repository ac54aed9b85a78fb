"""The text of HTML: every text node on a line of its own, quoted parts left out."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Elements that never hold others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset(("script", "style", "template"))
QUOTED = frozenset(("blockquote", "cite"))


class _TextNodes(HTMLParser):
    """Collects text nodes; an element is left out together with all that it holds."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[str] = []
        self.held: list[str] = []
        self.open: list[tuple[str, bool]] = []

    def _close_node(self) -> None:
        node = "".join(self.held)
        self.held.clear()
        if not node:
            return
        if not node.strip(" \t\n\r\f\v"):
            node = "\n" if "\n" in node else " "
        self.nodes.append(node)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_node()
        if tag in VOID:
            return
        skipped = bool(self.open) and self.open[-1][1] or tag in HIDDEN or tag in QUOTED
        if tag == "div" and not skipped:
            skipped = any(name == "class" and "gmail_quote" in (value or "").split() for name, value in attrs)
        self.open.append((tag, skipped))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._close_node()

    def handle_endtag(self, tag: str) -> None:
        self._close_node()
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth][0] == tag:
                del self.open[depth:]
                break

    def handle_data(self, data: str) -> None:
        if not (self.open and self.open[-1][1]):
            self.held.append(data)

    def handle_comment(self, data: str) -> None:
        self._close_node()

    handle_decl = handle_pi = unknown_decl = handle_comment


def text_of(html: str) -> str:
    parser = _TextNodes()
    parser.feed(html)
    parser.close()
    parser._close_node()
    return "\n".join(parser.nodes)


@F.arrow_udf(StringType())
def _parse(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else text_of(t) for t in texts.to_pylist()], type=pa.string())


def html_to_text(c: Column) -> Column:
    """The text nodes of HTML joined by line ends; entities decoded, scripts, styles, comments and quotes left out.

    Null gives ''. A text without '<' and '&' is its own only node and doesn't go through Python.
    """
    text = F.coalesce(c, F.lit(""))
    marked = F.contains(text, F.lit("<")) | F.contains(text, F.lit("&"))
    blank_node = F.when(text == "", text).when(text.rlike(r"[^ \t\n\r\f\x0B]"), text).when(F.contains(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit(" "))
    return F.coalesce(_parse(F.when(marked, text)), blank_node)
