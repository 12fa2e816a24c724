"""Marked fragments as a source: the blocks of an HTML document by their data-b markers, nested ones apart.

Tags must be followed in order, so a fragment is read in Python, in Arrow batches; everything after that is relational.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

from foliant.session import give_back, ship
from foliant.sources.html import VOID

#: Documents that are read together: what a batch of them holds is made in parts.
PART_ROWS = 50


class MarkReader(HTMLParser):
    """Open elements are a list of (tag, number of its marker or None); text goes to the innermost marked element."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int | None]] = []
        self.found: list[tuple[str, str, list[str], bool, bool]] = []

    def _begin(self, tag: str, attrs: list[tuple[str, str | None]]) -> int | None:
        own = dict(attrs)
        if "data-b" not in own:
            return None
        self.found.append((own["data-b"] or "", tag, [], own.get("data-nt") == "1", own.get("data-pt") == "1"))
        return len(self.found) - 1

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        mark = self._begin(tag, attrs)
        if tag not in VOID:
            self.open.append((tag, mark))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._begin(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        at = max((i for i, (name, _) in enumerate(self.open) if name == tag), default=None)
        if at is not None:
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        if any(tag in ("style", "script") for tag, _ in self.open):
            return
        for _, mark in reversed(self.open):
            if mark is not None:
                self.found[mark][2].append(data)
                return


def read(html: str | None) -> list[tuple[int, str, str, str, bool, bool]]:
    """(n, id, tag, text, untranslated, partial) of each marker, in order; text goes to the innermost marked element."""
    reader = MarkReader()
    reader.feed(html or "")
    reader.close()
    return [(n, i, tag, " ".join("".join(parts).split()), nt, pt) for n, (i, tag, parts, nt, pt) in enumerate(reader.found)]


def markers(docs: DataFrame, html: str = "html") -> DataFrame:
    """(paper_id, n, id, tag, text, untranslated, partial) from (paper_id, html)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PART_ROWS):
                b = whole.iloc[at : at + PART_ROWS]
                rows = [(p, *r) for p, h in zip(b.paper_id, b[html], strict=True) for r in read(h)]
                yield pd.DataFrame(rows, columns=["paper_id", "n", "id", "tag", "text", "untranslated", "partial"])
        give_back()

    ship(docs.sparkSession)
    return docs.select("paper_id", html).mapInPandas(run, "paper_id long, n long, id string, tag string, text string, untranslated boolean, partial boolean")
