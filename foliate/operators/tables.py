"""HTML tables: grids, headers, and merging the fragments of a table that goes on over pages (T-series, C16)."""

from __future__ import annotations

import hashlib
import html
import re
import unicodedata
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .grouped import by_rows

HEADER_ROWS = 5


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__()
        self.rows: list[list[dict]] = []
        self.cell: dict | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self.rows.append([])
        elif tag in ("td", "th"):
            span = {k: int(v) for k, v in attrs if k in ("colspan", "rowspan") and v and v.isdigit() and int(v) > 0}
            self.cell = {"tag": tag, "cols": min(span.get("colspan", 1), 1000), "rows": min(span.get("rowspan", 1), 65534), "text": ""}
            if not self.rows:
                self.rows.append([])
            self.rows[-1].append(self.cell)

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell["text"] += data


_CELL = re.compile(r'<(t[dh])((?: (?:col|row)span="[0-9]+")*)>([^<]*)</t[dh]>')
_SPAN = re.compile(r'(col|row)span="([0-9]+)"')


def _regular(row: str) -> list[dict] | None:
    """The cells of a row of nothing but closed cells of text; None for any other row."""
    if row.startswith("<td>") and row.endswith("</td>"):
        texts = row[4:-5].split("</td><td>")
        if row.count("<") == 2 * len(texts):
            return [{"tag": "td", "cols": 1, "rows": 1, "text": html.unescape(t) if "&" in t else t} for t in texts]
    cells, end = [], 0
    for m in _CELL.finditer(row):
        if m.start() != end:
            return None
        end = m.end()
        span = {k: int(v) for k, v in _SPAN.findall(m[2]) if int(v) > 0}
        cells.append({"tag": m[1], "cols": min(span.get("col", 1), 1000), "rows": min(span.get("row", 1), 65534), "text": html.unescape(m[3]) if "&" in m[3] else m[3]})
    return cells if end == len(row) else None


def parse(source: str | None) -> list[list[dict]]:
    """Rows of cells {tag, cols, rows, text}. Tables as plain as these operators write them are cut at their tags, others are read tag by tag."""
    source = source or ""
    if source.startswith("<table><tr>") and source.endswith("</tr></table>"):
        rows = [_regular(r) for r in source[11:-13].split("</tr><tr>")]
        if None not in rows:
            return [r for r in rows if r]
    reader = _Reader()
    reader.feed(source)
    return [r for r in reader.rows if r]


def grid(rows: list[list[dict]]) -> list[list[tuple[int, int] | None]]:
    """Which cell (row, place) covers each square, spans included; squares below the last row are left out."""
    out: list[list] = [[] for _ in rows]
    for y, row in enumerate(rows):
        x = 0
        for k, cell in enumerate(row):
            while x < len(out[y]) and out[y][x] is not None:
                x += 1
            for below in range(y, min(len(rows), y + cell["rows"])):
                out[below] += [None] * (x + cell["cols"] - len(out[below]))
                out[below][x : x + cell["cols"]] = [(y, k)] * cell["cols"]
            x += cell["cols"]
    return out


class _Covered:
    """Squares that rows cover, row after row, as in grid(); only what reaches down is held."""

    def __init__(self):
        self.y, self.until = 0, []  # until: the first row no longer covered, by column

    def add(self, row: list[dict]) -> tuple[int, int]:
        """(columns to the last covered one, covered squares) of the next row."""
        y, until, x = self.y, self.until, 0
        self.y += 1
        if not until and all(c["cols"] == c["rows"] == 1 for c in row):
            return len(row), len(row)
        for cell in row:
            while x < len(until) and until[x] > y:
                x += 1
            until += [0] * (x + cell["cols"] - len(until))
            for k in range(x, x + cell["cols"]):
                until[k] = max(until[k], y + cell["rows"])
            x += cell["cols"]
        squares, width = sum(u > y for u in until), max((k + 1 for k, u in enumerate(until) if u > y), default=0)
        while until and until[-1] <= y + 1:
            until.pop()
        return width, squares


def covered(rows: list[list[dict]]) -> list[tuple[int, int]]:
    """(columns to the last covered one, covered squares) of each row of the grid."""
    c = _Covered()
    return [c.add(r) for r in rows]


def total_columns(rows: list[list[dict]]) -> int:
    """T2."""
    return max((w for w, _ in covered(rows)), default=0)


def row_widths(rows: list[list[dict]], y: int) -> tuple[int, int, int]:
    """(sum of spans, cells, squares covered) of a row."""
    if not rows:
        return 0, 0, 0
    return sum(c["cols"] for c in rows[y]), len(rows[y]), covered(rows[: y + 1] if y >= 0 else rows)[y][1]


def plain(text: str) -> str:
    return "".join(unicodedata.normalize("NFKC", text).split())


def _head(row: list[dict]) -> list[tuple[int, int, str]]:
    return [(c["cols"], c["rows"], plain(c["text"])) for c in row]


def header_rows(a: list[list[dict]], b: list[list[dict]]) -> int:
    """T4: leading rows, at most five, in which two tables agree in spans and text."""
    n = 0
    for x, y in zip(a[:HEADER_ROWS], b[:HEADER_ROWS]):
        if len(x) != len(y) or _head(x) != _head(y):
            break
        n += 1
    return n


def last_cells(rows: list[list[dict]]) -> list[dict]:
    """The cells seen in the last row of the grid, those that reach down to it included."""
    last = grid(rows)[-1] if rows else []
    return [rows[y][k] for y, k in dict.fromkeys(s for s in last if s is not None)]


def first_data_row(rows: list[list[dict]], headers: int) -> int:
    """The first row after the headers that isn't one cell as wide as the table; no more than five are passed over."""
    return _first_data_row(rows, headers, total_columns(rows))


def _first_data_row(rows: list[list[dict]], headers: int, width: int) -> int:
    y = headers
    while y < min(len(rows), headers + HEADER_ROWS) and len(rows[y]) == 1 and rows[y][0]["cols"] == width:
        y += 1
    return y if y < len(rows) else headers


def shape(rows: list[list[dict]]) -> tuple[int, list[int], list[str], list[list[int]]]:
    """What columns_agree() asks of a table: (columns, widths of the last row, digests of the leading rows, widths of the first
    data row after none to five headers); a fixed size, however large the table."""
    if not rows:
        return 0, [], [], []
    squares = covered(rows)
    columns = max(w for w, _ in squares)
    widths = lambda y: [sum(c["cols"] for c in rows[y]), len(rows[y]), squares[y][1]]
    heads = [hashlib.sha256(repr(_head(r)).encode("utf-8", "surrogatepass")).hexdigest() for r in rows[:HEADER_ROWS]]
    firsts = [widths(min(_first_data_row(rows, n, columns), len(rows) - 1)) for n in range(len(heads) + 1)]
    return columns, widths(len(rows) - 1), heads, firsts


def shapes_agree(a: tuple, b: tuple) -> bool:
    """C16, of shape()s: as many columns in all, or the last row of one like the first data row of the other by squares, spans or cells."""
    if not a[1] or not b[1]:
        return False
    if a[0] == b[0]:
        return True
    headers = 0
    while headers < min(len(a[2]), len(b[2])) and a[2][headers] == b[2][headers]:
        headers += 1
    return any(x == z for x, z in zip(a[1], b[3][headers]))


def columns_agree(a: list[list[dict]], b: list[list[dict]]) -> bool:
    """As many columns in all, or the last row of one like the first data row of the other by squares, spans or cells."""
    return shapes_agree(shape(a), shape(b))


def _write(rows: list[list[dict]]) -> str:
    def cell(c: dict) -> str:
        spans = "".join(f' {name}="{c[k]}"' for k, name in (("rows", "rowspan"), ("cols", "colspan")) if c[k] > 1)
        return f"<{c['tag']}{spans}>{html.escape(c['text'], quote=False)}</{c['tag']}>"

    return "<table>" + "".join("<tr>" + "".join(map(cell, r)) + "</tr>" for r in rows) + "</table>"


class Merged:
    """Tables put one below the other; each is read once, however many there are."""

    def __init__(self, first: str):
        self.source: str | None = first  # as long as nothing is merged
        self.rows: list[list[dict]] | None = None  # not read before something is added
        self.seen, self.width, self.squares = 0, 0, _Covered()

    def add(self, second: str, joined: list[int] | None = None, rows: list[list[dict]] | None = None) -> None:
        """The table's rows without a repeated header.

        joined flags the cells of its first row that go on in the row above; a row all of whose text has gone up is left out.
        Rows narrower than the table above get a wider last cell. rows: the table if it has been read already; it is altered.
        """
        if self.rows is None:
            self.rows = parse(self.source)
        b = parse(second) if rows is None else rows
        if not self.rows or not b:
            if not self.rows:
                self.source, self.rows = second, b
            return
        a, self.source = self.rows, None
        rest = b[header_rows(a, b) :]
        if rest and joined and any(joined):
            for up, cell, flag in zip(last_cells(a), rest[0], joined):
                if flag:
                    up["text"] += cell["text"]
                    cell["text"] = ""
            if not any(c["text"].strip() for c in rest[0]):
                rest = rest[1:]
        for row in a[self.seen :]:
            for c in row:
                c["cols"] = min(c["cols"], 1000)  # as when the table is read again
            self.width = max(self.width, self.squares.add(row)[0])
        self.seen = len(a)
        for row, (width, _) in zip(rest, covered(rest)):
            if row and width < self.width:
                row[-1]["cols"] += self.width - width
        a += rest

    def html(self) -> str:
        return _write(self.rows) if self.source is None else self.source


def merge(first: str, second: str, joined: list[int] | None = None) -> str:
    """Two tables as Merged puts them."""
    m = Merged(first)
    m.add(second, joined)
    return m.html()


def merge_chains(tables: DataFrame) -> DataFrame:
    """tables(doc_id, ord, html, follows) with chains folded into their first table: (doc_id, ord, html, fragments).

    follows tells the tables that go on with the one before; chains of any length are kept whole. Rows stream by document and
    order; a task holds one chain.
    """
    return by_rows(tables.select("doc_id", "ord", "html", "follows"), _chained, "doc_id long, ord int, html string, fragments int", "doc_id", order=("ord",))


def _chained(rows: Iterator[tuple]) -> Iterator[tuple]:
    chain = doc = ord_ = None
    n = 0
    for d, o, source, follows in rows:
        if n and d == doc and follows:
            chain.add(source)
            n += 1
        else:
            if n:
                yield doc, ord_, chain.html(), n
            chain, doc, ord_, n = Merged(source), d, o, 1
    if n:
        yield doc, ord_, chain.html(), n


def merge_pages(tables: DataFrame) -> DataFrame:
    """C9, C16 and T9 at once: tables(doc_id, page, ord, html) whose page's first goes on with the last of the page before, where columns
    agree, as merge_candidates() and merge_chains() have them; ord grows with page. Tables without a neighbour aren't read."""
    return by_rows(tables.select("doc_id", "page", "ord", "html"), _followed, "doc_id long, ord int, html string, fragments int", "doc_id", order=("page", "ord"))


def _followed(rows: Iterator[tuple]) -> Iterator[tuple]:
    chain = doc = page = ord_ = source = seen = None
    n = 0
    for d, p, o, html_ in rows:
        near = n and d == doc and p == page + 1
        parsed, now = (parse(html_), None) if near else (None, None)
        if near:
            now = shape(parsed)
            seen = shape(parse(source)) if seen is None else seen
        if near and shapes_agree(seen, now):
            chain.add(html_, rows=parsed)
            n += 1
        else:
            if n:
                yield doc, ord_, chain.html(), n
            chain, ord_, n = Merged(html_), o, 1
        doc, page, source, seen = d, p, html_, now
    if n:
        yield doc, ord_, chain.html(), n


def _measured(source: pd.Series) -> pd.DataFrame:
    found = []
    for s in source:
        rows = parse(s)
        squares = covered(rows)
        found.append((len(rows), max((w for w, _ in squares), default=0), *((sum(c["cols"] for c in rows[-1]), len(rows[-1]), squares[-1][1]) if rows else (0, 0, 0))))
    return pd.DataFrame(found, columns=["rows", "columns", "spans", "cells", "squares"])


def measure(source: Column) -> Column:
    """T1, T2, T3 of the last row."""
    return F.pandas_udf(_measured, "struct<rows:int,columns:int,spans:int,cells:int,squares:int>")(source)


_SHAPE = "struct<columns:int,last:array<int>,heads:array<string>,firsts:array<array<int>>>"


def _shaped(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shape(parse(s)) for s in source], columns=["columns", "last", "heads", "firsts"])


def merge_candidates(tables: DataFrame) -> DataFrame:
    """The last table of a page with the first of the next: (doc_id, ord, next_ord, agree). Tables are read once each, shapes are exchanged."""
    by = tables.select("doc_id", "page", "ord", F.pandas_udf(_shaped, _SHAPE)(F.col("html")).alias("s")).groupBy("doc_id", "page").agg(F.max_by(F.struct("ord", "s"), "ord").alias("last"), F.min_by(F.struct("ord", "s"), "ord").alias("first"))
    order = W.partitionBy("doc_id").orderBy("page")
    pairs = by.withColumn("next", F.when(F.lead("page").over(order) == F.col("page") + 1, F.lead("first").over(order))).where("next is not null")
    a, b = F.col("last.s"), F.col("next.s")
    pairs_of_heads = F.arrays_zip(a.heads.alias("x"), b.heads.alias("y"))
    headers = F.aggregate(pairs_of_heads, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, h: F.struct((s["n"] + F.when(s["on"] & h.x.eqNullSafe(h.y), 1).otherwise(0)).alias("n"), (s["on"] & h.x.eqNullSafe(h.y)).alias("on")), lambda s: s["n"])
    alike = F.exists(F.arrays_zip(a["last"].alias("x"), F.get(b.firsts, headers).alias("y")), lambda w: w.x == w.y)
    agree = (F.size(a["last"]) > 0) & (F.size(b["last"]) > 0) & ((a.columns == b.columns) | alike)
    return pairs.select("doc_id", F.col("last.ord").alias("ord"), F.col("next.ord").alias("next_ord"), agree.alias("agree"))
