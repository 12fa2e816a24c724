"""HTML papers as sources: the abstract and the numbered equations, read by the standard library's parser in Arrow batches.

Elements are followed by depth: the abstract ends where its own element does, and a number belongs to the equation
table that is still open. Mathematics stands for its alternative text, between inline or display signs.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.session import ship
from foliant.sources.html import VOID

#: Class names that a paper's abstract, its equation tables and their printed numbers have.
ABSTRACT, EQUATION, NUMBER = "ltx_abstract", {"ltx_equation", "ltx_eqn_table"}, "ltx_tag_equation"
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
SILENT = {"script", "style"}
RESULT = "struct<abstract:string,equations:array<struct<eq_id:string,number:string>>>"


class PaperReader(HTMLParser):
    """Reads one paper; open elements are a list of (tag, what the element is)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.abstract: list[str] = []
        self.done = False
        self.equations: list[list[str]] = []
        self.numbers: list[str] = []

    def inside(self, kind: str) -> bool:
        return any(k == kind for _, k in self.open)

    def _say(self, text: str) -> None:
        if self.inside("abstract") and not self.inside("left out"):
            self.abstract.append(text)
        if self.inside("number"):
            self.numbers.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        own = dict(attrs)
        names = set((own.get("class") or "").split())
        kind = ""
        if tag == "div" and ABSTRACT in names and not self.done and not self.inside("abstract"):
            kind = "abstract"
        elif tag == "table" and EQUATION <= names and not self.inside("equation"):
            kind = "equation"
            self.equations.append([own.get("id") or "", ""])
        elif tag == "span" and NUMBER in names and self.inside("equation") and not self.equations[-1][1] and not self.inside("number"):
            kind, self.numbers = "number", []
        elif tag == "math":
            kind = "left out"
            if not self.inside("left out"):
                pair = (r"\[", r"\]") if own.get("display") == "block" else (r"\(", r"\)")
                self._say(f"{pair[0]}{own.get('alttext') or ''}{pair[1]}")
        elif tag in SILENT or tag in HEADINGS and self.inside("abstract"):
            kind = "left out"
        if tag in VOID:
            self._say(" ")
        else:
            self.open.append((tag, kind))
            if tag not in ("a", "b", "i", "em", "strong", "sub", "sup", "span", "math"):
                self._say(" ")

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        for _, kind in self.open[at:]:
            if kind == "abstract":
                self.done = True
            if kind == "number":
                self.equations[-1][1] = _number("".join(self.numbers))
        del self.open[at:]

    def handle_data(self, data: str) -> None:
        self._say(data)


def _number(text: str) -> str:
    bare = text.strip().removeprefix("(").removesuffix(")").strip()
    return bare if bare and all(c.isalnum() or c in "._" for c in bare) else ""


def read(html: str | None) -> tuple[str, list[tuple[str, str]]]:
    """(abstract, [(id, number) of each outermost equation table])."""
    reader = PaperReader()
    reader.feed(html or "")
    reader.close()
    return " ".join("".join(reader.abstract).split()), [tuple(e) for e in reader.equations]


def _read_all(pages: pd.Series) -> pd.DataFrame:
    rows = [read(h) for h in pages]
    return pd.DataFrame({"abstract": [a for a, _ in rows], "equations": [[{"eq_id": i, "number": n} for i, n in e] for _, e in rows]})


def papers(pages: DataFrame, html: Column) -> DataFrame:
    """pages with paper, the struct (abstract, equations) of each."""
    ship(pages.sparkSession)
    return pages.withColumn("paper", F.pandas_udf(_read_all, RESULT)(html))


def equation_marks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, eq_id, number) of each displayed equation: its printed number, and empty where none is printed."""
    return papers(pages, F.col(html_col)).select(id_col, F.inline("paper.equations"))


def abstracts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, abstract) without its heading; empty if there is none."""
    return papers(pages, F.col(html_col)).select(id_col, F.col("paper.abstract").alias("abstract"))
