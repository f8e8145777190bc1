"""HTML: tables, links by section.  Only the table and section parsers need Python."""

from __future__ import annotations

import csv
import io
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Endings of links that are images.
IMAGE_ENDINGS = r"\.(jpg|jpeg|png|svg|gif)\z"


class _Tables(HTMLParser):
    """Tables of class `wikitable`: rows are tr, cells td or th; nested tables count by themselves,
    and their text and rows belong to the outer table as well."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.done: list[tuple[int, list]] = []
        self.open: list[dict] = []
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            wiki = "wikitable" in (dict(attrs).get("class") or "").split()
            self.open.append({"wiki": wiki, "rows": [], "cells": [], "n": self.n})
            self.n += 1
        for t in self.open:
            if tag == "tr":
                t["rows"].append([])
            elif tag in ("td", "th") and t["rows"]:
                t["cells"] = [*t["cells"], []] if t is not self.open[-1] else [[]]
                t["rows"][-1].append(t["cells"][-1])

    def handle_endtag(self, tag):
        if tag == "table" and self.open:
            self._close()
        elif tag in ("td", "th"):
            for t in self.open:
                t["cells"] = t["cells"][:-1]
        elif tag == "tr":
            if self.open:
                self.open[-1]["cells"] = []

    def _close(self):
        t = self.open.pop()
        if t["wiki"]:
            self.done.append((t["n"], [["".join(c).strip() for c in r] for r in t["rows"]]))

    def handle_data(self, data):
        for t in self.open:
            for c in t["cells"]:
                c.append(data)

    def tables(self) -> list[list[list[str]]]:
        while self.open:
            self._close()
        return [rows for _, rows in sorted(self.done, key=lambda x: x[0])]


def parse_tables(html: str | None) -> list[dict]:
    """{columns, rows} of each wiki table: ragged rows are padded with nulls; columns, then rows,
    that are all null go; an empty cell is not null.  columns keeps the original numbers."""
    if not html:
        return []
    parser = _Tables()
    parser.feed(html)
    parser.close()
    out = []
    for rows in parser.tables():
        width = max(map(len, rows), default=0)
        full = [[*r, *[None] * (width - len(r))] for r in rows]
        columns = [j for j in range(width) if any(r[j] is not None for r in full)]
        full = [[r[j] for j in columns] for r in full]
        full = [r for r in full if any(c is not None for c in r)]
        if full:
            out.append({"columns": columns, "rows": full})
    return out


def table_csv(table: dict) -> str:
    """A header of column numbers, then the rows; nulls and empty cells are both empty."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(table["columns"])
    for r in table["rows"]:
        if len(r) == 1 and not r[0]:
            out.write('""\n')
        else:
            w.writerow(["" if c is None else c for c in r])
    return out.getvalue()


_STRING = T.StringType()
TABLES_TYPE = T.ArrayType(T.StructType([T.StructField("columns", T.ArrayType(T.IntegerType())), T.StructField("rows", T.ArrayType(T.ArrayType(_STRING))), T.StructField("csv", _STRING)]))
LINKS_TYPE = T.ArrayType(T.StructType([T.StructField(c, _STRING) for c in ("section", "text", "url")]))


@F.pandas_udf(TABLES_TYPE)
def wiki_tables(html: pd.Series) -> pd.Series:
    return html.map(lambda h: [{**t, "csv": table_csv(t)} for t in parse_tables(h)])


def anchors(html: Column) -> Column:
    """array<struct<text, url>>: the links of a page in order, text without tags."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r'(?s)<a\s[^>]*?href="[^"]*"[^>]*>.*?</a>'), F.lit(0))
    return F.transform(
        found,
        lambda a: F.struct(
            F.regexp_replace(F.regexp_extract(a, r"(?s)^<a\s[^>]*>(.*?)</a>\z", 1), "<[^>]*>", "").alias("text"),
            F.regexp_extract(a, r'href="([^"]*)"', 1).alias("url"),
        ),
    )


def is_cite_note(url: Column) -> Column:
    return url.contains("#cite_note")


def is_wiki_link(url: Column) -> Column:
    return ~url.contains("cite_note") & ~F.lower(url).rlike(IMAGE_ENDINGS)


class _Sections(HTMLParser):
    """Links under the heading (h2..h6) they follow; those before any heading go."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.section: str | None = None
        self.heading: list[str] | None = None
        self.link: list | None = None
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("h2", "h3", "h4", "h5", "h6"):
            self.heading = []
        elif tag == "a":
            self.link = [dict(attrs).get("href"), []]

    def handle_endtag(self, tag):
        if self.heading is not None and tag in ("h2", "h3", "h4", "h5", "h6"):
            self.section, self.heading = "".join(self.heading).strip(), None
        elif tag == "a" and self.link is not None:
            url, text = self.link
            if url is not None and self.section is not None and self.heading is None:
                self.found.append({"section": self.section, "text": "".join(text).strip(), "url": url})
            self.link = None

    def handle_data(self, data):
        if self.heading is not None:
            self.heading.append(data)
        elif self.link is not None:
            self.link[1].append(data)


@F.pandas_udf(LINKS_TYPE)
def section_links(html: pd.Series) -> pd.Series:
    def of(h):
        p = _Sections()
        p.feed(h or "")
        p.close()
        return p.found

    return html.map(of)
