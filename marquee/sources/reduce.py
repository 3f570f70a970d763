"""Readable text of a page: structured data and meta tags first, then the main content.

The tree walk needs a parser, so this is an Arrow-batched helper around the
standard library's; pages stay partitioned as Spark read them.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_DROP_TAGS = {"script", "style", "noscript", "iframe", "svg", "nav", "footer", "form", "link", "meta"}
_DROP_ROLES = {"navigation", "banner", "contentinfo"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
# A start tag that closes an open one of the same group.
_CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
           "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Reader(HTMLParser):
    """Collects text per candidate root while skipping dropped subtrees."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.count: Counter[str] = Counter()  # open tags by name, so that depth costs nothing
        self.stack: list[tuple[str, bool, list[int]]] = []  # tag, dropped, roots opened here
        self.roots: dict[int, list[str]] = {}  # rank of the root -> text parts
        self.open: list[int] = []
        self.body: list[str] = []
        self.meta: list[str] = []
        self.jsonld: list[str] = []
        self._script: list[str] | None = None

    def updatepos(self, i, j):  # line numbers are not used
        return j

    def handle_starttag(self, tag, attrs):
        a = {k: (v or "") for k, v in attrs}
        if tag == "meta":
            key = a.get("property") or a.get("name") or a.get("itemprop")
            wanted = a.get("property", "").startswith("og:") or a.get("name", "").startswith("twitter:") or "itemprop" in a
            if wanted and key and a.get("content"):
                self.meta.append(f"{key}: {a['content']}")
        if tag == "script" and a.get("type") == "application/ld+json":
            self._script = []
        while self.stack and self.stack[-1][0] in _CLOSES.get(tag, ()):
            self._close()
        if tag in _VOID:
            return
        dropped = (
            tag in _DROP_TAGS or a.get("aria-hidden") == "true" or a.get("role") in _DROP_ROLES)
        inside = self.stack and self.stack[-1][1]
        opened: list[int] = []
        if not (dropped or inside):
            ranks = [
                tag == "article" and self.count["main"] > 0, tag == "article", tag == "main", a.get("role") == "main",
                a.get("id") == "content", "content" in a.get("class", "").split()]
            opened = [r for r, hit in enumerate(ranks) if hit and r not in self.roots]
            for r in opened:
                self.roots[r] = []
            self.open += opened
        self.stack.append((tag, bool(dropped or inside), opened))
        self.count[tag] += 1

    def _close(self) -> None:
        tag, _, opened = self.stack.pop()
        self.count[tag] -= 1
        for r in opened:
            self.open.remove(r)

    def handle_endtag(self, tag):
        if tag == "script" and self._script is not None:
            self.jsonld.append("".join(self._script).strip())
            self._script = None
        if self.count[tag]:
            while True:
                done = self.stack[-1][0] == tag
                self._close()
                if done:
                    break

    def handle_data(self, data):
        if self._script is not None:
            self._script.append(data)
        if self.stack and self.stack[-1][1]:
            return
        if self.count["head"] or self.count["title"]:
            return
        self.body.append(data)
        for r in self.open:
            self.roots[r].append(data)


def reduce_page(html: str) -> str:
    """The whole reduced text; a caller that needs a shorter one cuts it."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    parts = reader.roots[min(reader.roots)] if reader.roots else reader.body
    # Runs only, each round halves them: a single blank, by far the most frequent, costs no match.
    text = "".join(parts).replace("\t", " ").replace("\u00a0", " ")
    while "  " in text:
        text = text.replace("  ", " ")
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    blobs = [b for b in reader.jsonld if b and re.search("event", b, re.I)]
    out = ("JSON-LD:\n" + "\n---\n".join(blobs) + "\n\n") if blobs else ""
    out += ("MetaTags:\n" + "\n".join(reader.meta) + "\n\n") if reader.meta else ""
    return f"{out}Text:\n{text}"


@F.pandas_udf(StringType())
def reduced_text(html: pd.Series) -> pd.Series:
    return pd.Series([reduce_page(h) for h in html], dtype=object)
