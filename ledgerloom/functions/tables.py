"""HTML tables to pipe tables: a grid with spans, header, empty columns dropped."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[list[list[tuple[str, int, int, bool]]]] = []
        self.open: list[list] = []
        self.cell: list[str] | None = None
        self.span, self.head = (1, 1), False

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.open.append([])
        elif not self.open:
            return
        elif tag == "tr":
            self.open[-1].append([])
        elif tag in ("td", "th"):
            self.close_cell()
            n = lambda k: int(a[k]) if (a.get(k) or "").isdigit() and 0 < int(a[k]) < 200 else 1
            self.cell, self.span, self.head = [], (n("rowspan"), n("colspan")), tag == "th"
            if not self.open[-1]:
                self.open[-1].append([])

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self.close_cell()
        elif tag == "table" and self.open:
            self.close_cell()
            self.done.append(self.open.pop())

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def close_cell(self):
        if self.cell is not None and self.open and self.open[-1]:
            self.open[-1][-1].append((" ".join("".join(self.cell).split()), *self.span, self.head))
        self.cell = None


def grid(rows) -> list[list[str]]:
    """Cells at their places; a spanned place repeats its cell."""
    out: dict[tuple[int, int], str] = {}
    for i, row in enumerate(rows):
        j = 0
        for text, down, right, _ in row:
            while (i, j) in out:
                j += 1
            for di in range(min(down, len(rows) - i)):
                for dj in range(right):
                    out[i + di, j + dj] = text
            j += right
    width = max((j for _, j in out), default=-1) + 1
    full = [[out.get((i, j), "") for j in range(width)] for i in range(len(rows))]
    keep = [j for j in range(width) if any(r[j] for r in full)]
    return [[r[j] for j in keep] for r in full if any(r)]


def pipe_tables(html: str | None) -> list[str]:
    p = _Tables()
    p.feed(html or "")
    p.close()
    out = []
    for rows in p.done:
        g = grid(rows)
        if g and g[0]:
            line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in r) + " |"
            out.append("\n".join([line(g[0]), "|" + "---|" * len(g[0]), *map(line, g[1:])]))
    return out


def html_tables(html: Column) -> Column:
    """array<string>: each table of a page as a pipe table."""

    @F.pandas_udf("array<string>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(pipe_tables)

    return parse(html)
