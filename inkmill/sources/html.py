"""HTML to Markdown on the standard library's parser."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.operators.clean import dehyphenate

#: Elements that aren't content, and where content is looked for, in order.
DROPPED = ("script", "style", "noscript", "nav", "footer", "header")
ROOTS = ("article", "main", "body")
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_BLOCKS = {"p", "div", "section", "article", "main", "table", "figure", "dl", "dt", "dd", "address", "aside"}
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Stand-ins until lines are trimmed: line feed, space and tab that stay, and the two ends of a quote.
_LINE, _BLANK, _TAB, _QUOTE, _END = "\ue000\ue001\ue002\ue003\ue004"
_KEEP = str.maketrans({"\n": _LINE, " ": _BLANK, "\t": _TAB})
_BACK = str.maketrans({_LINE: "\n", _BLANK: " ", _TAB: "\t"})
_NO_STAND_INS = str.maketrans("", "", _LINE + _BLANK + _TAB + _QUOTE + _END)


class _Writer(HTMLParser):
    """Collects Markdown for each possible root at once.

    Headings with ``#``, bullets ``-``, numbers as counted, nested lists indented
    by two or three blanks, tables with a rule below their first row, ``>`` before
    quoted lines, code as it is. ``*`` and ``_`` of plain text are escaped.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: dict[str, list[str]] = {r: [] for r in (*ROOTS, "")}
        self.open: list[str] = []
        self.closed: set[str] = set()
        self.skip, self.pre, self.code, self.cell = 0, 0, 0, 0
        self.links: list[str | None] = []
        self.lists: list[tuple[str, list[int]]] = []
        self.tables: list[list[int]] = []  # rows closed, cells of the open row

    def put(self, text: str) -> None:
        if self.skip:
            return
        if self.cell:
            text = text.replace("\n", " ").replace(_LINE, " ")
        self.out[""].append(text)
        for r in ROOTS:
            if r in self.open and r not in self.closed:
                self.out[r].append(text)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in DROPPED:
            self.skip += 1
        if tag not in _VOID:
            self.open.append(tag)
        if tag in _HEADINGS:
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            kind, count = self.lists[-1] if self.lists else ("ul", [0])
            count[0] += 1
            indent = sum(3 if k == "ol" else 2 for k, _ in self.lists[:-1])
            self.put("\n" + _BLANK * indent + (f"{count[0]}. " if kind == "ol" else "- "))
        elif tag in ("ul", "ol"):
            start = a.get("start") or ""
            self.lists.append((tag, [int(start) - 1 if start.isdecimal() else 0]))
            self.put("\n" if len(self.lists) > 1 else "\n\n")
        elif tag == "blockquote":
            self.put(f"\n\n{_QUOTE}\n")
        elif tag in _BLOCKS:
            self.put("\n\n")
            if tag == "table":
                self.tables.append([0, 0])
        elif tag == "tr":
            if self.tables:
                self.tables[-1][1] = 0
        elif tag in ("td", "th"):
            self.put("| ")
            self.cell += 1
            if self.tables:
                self.tables[-1][1] += 1
        elif tag == "br":
            self.put("  \n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "img":
            self.put(f"![{a.get('alt') or ''}]({a.get('src') or ''})")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code":
            self.code += 1
            self.put("" if self.pre else "`")
        elif tag == "a":
            self.links.append(a.get("href"))
            self.put("[" if a.get("href") else "")

    def handle_endtag(self, tag):
        if tag not in self.open:
            return
        while self.open:
            last = self.open.pop()
            self._close(last)
            if last == tag:
                break

    def _close(self, tag):
        if tag in ("ul", "ol") and self.lists:
            self.lists.pop()
            self.put("\n" if self.lists else "\n\n")
        elif tag in _HEADINGS:
            self.put("\n\n")
        elif tag == "blockquote":
            self.put(f"\n{_END}\n\n")
        elif tag in ("td", "th"):
            self.cell = max(0, self.cell - 1)
            self.put(" ")
        elif tag == "tr":
            rows = self.tables[-1] if self.tables else [1, 0]
            rows[0] += 1
            self.put("|\n" + (f"|{' --- |' * rows[1]}\n" if rows[0] == 1 else ""))
        elif tag in _BLOCKS:
            if tag == "table" and self.tables:
                self.tables.pop()
            self.put("\n\n")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("*")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code":
            self.code = max(0, self.code - 1)
            self.put("" if self.pre else "`")
        elif tag == "a" and self.links and (href := self.links.pop()):
            self.put(f"]({href})")
        if tag in DROPPED:
            self.skip = max(0, self.skip - 1)
        if tag in ROOTS and tag not in self.open:
            self.closed.add(tag)  # only the first one counts

    def handle_data(self, data):
        data = data.translate(_NO_STAND_INS)
        if self.pre:
            self.put(data.strip("\n").translate(_KEEP))
            return
        words = " ".join(data.split())
        if not self.code:
            words = words.replace("\\", "\\\\").replace("*", "\\*").replace("_", "\\_")
        self.put(f"{' ' * data[:1].isspace()}{words}{' ' * data[-1:].isspace()}" if words else " " * bool(data))


def to_markdown(html: str | None) -> str | None:
    if html is None:
        return None
    w = _Writer()
    w.feed(html)
    w.close()
    parts = next((w.out[r] for r in ROOTS if w.out[r]), w.out[""])
    lines, depth = [], 0
    for line in "".join(parts).split("\n"):
        line = line.strip()
        depth += line.count(_QUOTE)
        closing = line.count(_END)
        line = line.translate({ord(_QUOTE): None, ord(_END): None})
        if line.startswith("|"):
            line = " ".join(line.split())
        mark = "> " * depth
        if not mark:
            lines.append(line)
        elif line or (not closing and lines and lines[-1].strip("> ")):  # no mark alone at a quote's ends
            lines.append((mark + line.replace(_LINE, "\n" + mark)).rstrip(" "))
        while closing and lines and lines[-1].startswith(">") and not lines[-1].strip("> "):
            lines.pop()
        depth = max(0, depth - closing)
    text = "\n".join(lines)
    while "\n\n\n" in text:
        text = text.replace("\n\n\n", "\n\n")
    return text.strip().translate(_BACK) + "\n"


@F.pandas_udf(T.StringType())
def _convert(html: pd.Series) -> pd.Series:
    return pd.Series([to_markdown(x) for x in html], dtype=object)


def html_to_markdown(pages: DataFrame, column: str = "html") -> DataFrame:
    """Adds ``md``: the main content as Markdown, words joined across line ends."""
    return pages.withColumn("md", _convert(column)).withColumn("md", F.expr(dehyphenate("md")))
