"""Tables of HTML pages: no built-in function parses HTML, so this is a pandas UDF over the standard library's parser."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    """Tables as lists of rows, rows as lists of (is a header, text); a table inside another is one of its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tables, self.open, self.cell = [], [], None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append([])
            self.tables.append(self.open[-1])
        elif tag == "tr" and self.open:
            self.open[-1].append([])
        elif tag in ("td", "th") and self.open and self.open[-1]:
            self.cell = [tag == "th", []]
            self.open[-1][-1].append(self.cell)
        elif tag == "br" and self.cell:
            self.cell[1].append(" ")

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self.open.pop()
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[1].append(data)


def tables(html: str) -> list[list[list[tuple[bool, str]]]]:
    parser = _Tables()
    parser.feed(html)
    parser.close()
    return [[[(head, " ".join("".join(parts).split())) for head, parts in row] for row in own] for own in parser.tables]


def find_table(html: str | None, needles: Mapping[str, Sequence[str]], required: Sequence[str]) -> list[dict[str, str | None]]:
    """The rows of the first table whose header has every required column, as wanted column -> text.

    A column is the first header cell that holds one of its needles, without regard to case. Rows of header cells only are
    the header; if stacked ones give more cells than the first body row has, the last ones count. A missing or too short
    row's cell is null. No such table, or no page, gives no rows.
    """
    for own in tables(html) if isinstance(html, str) else []:
        head = [text.lower() for row in own if row and all(h for h, _ in row) for _, text in row]
        body = [[text for _, text in row] for row in own if row and not all(h for h, _ in row)]
        if not head or not body:
            continue
        head = head[-len(body[0]) :]
        at = {name: next((i for i, text in enumerate(head) if any(n in text for n in wanted)), None) for name, wanted in needles.items()}
        if any(at[name] is None for name in required):
            continue
        return [{name: row[i] if i is not None and i < len(row) else None for name, i in at.items()} for row in body]
    return []


def table_rows(html: Column, needles: Mapping[str, Sequence[str]], required: Sequence[str]) -> Column:
    """find_table() as array<struct> of strings, one member a wanted column; inline() makes rows of it."""
    kind = "array<struct<" + ",".join(f"{name}:string" for name in needles) + ">>"

    @F.pandas_udf(kind)
    def of(pages: pd.Series) -> pd.Series:
        return pages.map(lambda page: find_table(page, needles, required))

    return of(html)
