"""The visible lines of a text that may be HTML, each with the role its markup gives it."""

from __future__ import annotations

import re
from html import unescape

#: Elements that end a line.
BREAKS = frozenset("br p div li ul ol tr table h1 h2 h3 h4 h5 h6 hr blockquote pre body html head tbody thead center".split())
TAG_NAMES = "a|abbr|b|blockquote|body|br|center|cite|code|div|em|font|h[1-6]|head|hr|html|i|img|li|meta|ol|p|pre|s|script|small|span|strong|style|sub|sup|table|tbody|td|th|thead|title|tr|u|ul"
TAG = re.compile(rf"<!--.*?-->|<(style|script|title)\b[^<>]*>.*?</\1\s*>|<(/?)({TAG_NAMES})(\s[^<>]*)?/?>", re.S | re.I)
LOOKS_HTML = re.compile(r"<(?:!--|/?(?:p|br|div|html|body|span|blockquote|table|style|a href)\b)", re.I)
OPENING = frozenset("blockquote div span small p cite".split())
QUOTE, SIGNATURE, NOTICE = "q", "s", "n"
_QUOTING = re.compile(r"gmail_quote|moz-cite|border-(?:top|left)\s*:", re.I)
_SIGNING = re.compile(r"signature|color\s*:\s*gr[ae]y", re.I)
_SMALL = re.compile(r"font-size\s*:\s*[1-8]p[tx]", re.I)
_LINE_END = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")


def is_html(text: str, content_type: str | None) -> bool:
    return content_type == "text/html" or content_type != "text/plain" and LOOKS_HTML.search(text) is not None


def _role(name: str, attributes: str | None) -> str:
    if name in ("blockquote", "cite"):
        return QUOTE
    if name == "small":
        return NOTICE
    if attributes:
        if _QUOTING.search(attributes):
            return QUOTE
        if _SIGNING.search(attributes):
            return SIGNATURE
        if _SMALL.search(attributes):
            return NOTICE
    return ""


def html_lines(text: str) -> list[tuple[str, str]]:
    """(line, role) of the visible text. Unclosed and stray tags are tolerated."""
    lines: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    role, at = "", 0

    def close() -> None:
        line = "".join(parts)
        if "&" in line:
            line = unescape(line)
        lines.append((" ".join(line.split()), role))
        parts.clear()

    for match in TAG.finditer(text):
        if match.start() > at:
            parts.append(text[at : match.start()])
        at = match.end()
        name = match[3]
        if name is None:
            continue
        name = name.lower()
        if name in BREAKS:
            close()
        if match[2]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if stack[i][1] and name not in BREAKS:
                        close()
                    del stack[i:]
                    break
            else:
                continue
            role = stack[-1][1] if stack else ""
        elif name in OPENING:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
                role = stack[-1][1] if stack else ""
            own = _role(name, match[4])
            if own and name not in BREAKS:
                close()
            stack.append((name, own or role))
            role = stack[-1][1]
    if at < len(text):
        parts.append(text[at:])
    close()
    return lines


def plain_lines(text: str) -> list[tuple[str, str]]:
    return [(line.strip(), "") for line in _LINE_END.split(text.replace("\xa0", " "))]


def lines_of(text: str, content_type: str | None = None) -> list[tuple[str, str]]:
    return html_lines(text) if is_html(text, content_type) else plain_lines(text)
