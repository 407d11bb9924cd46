"""Tables from marked-up text: Markdown catalogues and HTML pages.

Lines keep their file and number; a heading is carried to the lines under it by a window over the file alone.
HTML is parsed by the standard library in Arrow batches, one page at a time.
"""
import html
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normal_title, quoted_spans

HEADING = r"^##+\s+(\d{4})(?:\s*[—–-]\s*\*?([^*]+)\*?)?"
BULLET = r"^\s*[-*]\s+[\"“]([^\"”]+)[\"”](?:\s*[—–-]\s*(.*?))?(?:\s*\[([^\]]*)\])?\s*$"


def markdown_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files; a file is read whole, since a heading governs what follows."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value"))
    return files.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def catalogue(lines: DataFrame, stop: str | None = None) -> DataFrame:
    """Rows of a catalogue: year and era of the last heading, title, credit and tags of a bullet.

    Lines from the first heading that holds ``stop`` on are left out."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    year = F.nullif(F.regexp_extract("line", HEADING, 1), F.lit(""))
    head = F.when(year.isNotNull(), F.struct(year.cast("int").alias("year"), F.nullif(F.trim(F.regexp_extract("line", HEADING, 2)), F.lit("")).alias("era")))
    stopped = F.max(F.lower("line").contains(stop.lower()) & F.col("line").startswith("#")).over(w) if stop else F.lit(False)
    carried = lines.withColumns({"__head": F.last(head, ignorenulls=True).over(w), "__stop": stopped})
    rows = carried.where(~F.col("__stop") & F.col("line").rlike(BULLET))
    part = lambda i: F.nullif(F.trim(F.regexp_extract("line", BULLET, i)), F.lit(""))
    return rows.select("file", "n", "__head.year", "__head.era", part(1).alias("title"), part(2).alias("credit"), part(3).alias("tags"))


def bold_titles(lines: DataFrame) -> DataFrame:
    found = F.regexp_extract_all("line", F.lit(r"\*\*[\"“]?([^*\"”]+)[\"”]?\*\*"))
    return lines.select("file", "n", F.explode(found).alias("title"))


# The paragraph of a work with its tracks, and a title with what follows it in brackets.
WORK = r"^\s*\*\*(.+?)\s*\(([^)]+)\)\*\*.*?\*\*\[([^\]]+)\]\*\*.*?:\s*(.+?)\s*$"
MENTION = r"\"([^\"]+)\"\s*\(([^)]+)\)"


def catalogue_mentions(lines: DataFrame) -> DataFrame:
    """Titles of a catalogue's prose, a row each: of a work's paragraph (with its name, date and tag), or followed by a
    credit in brackets; ``year`` and ``era`` are the last heading's.  Bullets are left to ``catalogue``."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    year = F.nullif(F.regexp_extract("line", HEADING, 1), F.lit(""))
    head = F.last(F.when(year.isNotNull(), F.struct(year.cast("int").alias("year"), F.nullif(F.trim(F.regexp_extract("line", HEADING, 2)), F.lit("")).alias("era"))), ignorenulls=True).over(w)
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(c, r"[*_`]", "")), F.lit(""))
    none = F.lit(None).cast("string")

    def found(titles, title, work, day, tag, credit):
        return F.transform(titles, lambda t, i: F.struct(i.alias("place"), F.regexp_replace(F.trim(title(t)), ",+$", "").alias("title"), work.alias("work"), day.alias("day"), tag.alias("tag"), credit(t).alias("credit")))

    works = found(F.regexp_extract_all(F.regexp_extract("line", WORK, 4), F.lit("\"([^\"]+)\"")), lambda t: t, *[plain(F.regexp_extract("line", WORK, i)) for i in (1, 2, 3)], lambda t: none)
    mentions = found(F.regexp_extract_all("line", F.lit(MENTION), F.lit(0)), lambda t: F.regexp_extract(t, MENTION, 1), none, none, none, lambda t: plain(F.regexp_extract(t, MENTION, 2)))
    text = F.col("line")
    rows = F.when(text.rlike(r"^\s*#") | text.rlike(BULLET), F.slice(mentions, 1, 0)).when(text.rlike(WORK), works).otherwise(mentions)
    return lines.withColumn("__head", head).select("file", "n", "__head.year", "__head.era", F.explode(rows).alias("r")).where("r.title <> ''").select("file", "n", "year", "era", "r.*")


def sectioned_titles(lines: DataFrame, sections: dict, skipped, tags=(), shortest: int = 3, longest: int = 80) -> DataFrame:
    """Quoted titles of a catalogue below its first year, with the year and the section, one row per file, year and normal title.

    A section (name to words, tried in order) opens with a line whose bold text holds one of its words, and closes with
    the next year; lines outside all are ``unknown``.  Lines of ``skipped`` sections or with one of ``tags`` go.  Of a
    repeated title the row of the first section in order stays, ``unknown`` last, then the first line."""
    w = Window.partitionBy("file").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    year = F.nullif(F.regexp_extract("line", r"^## (\d{4})", 1), F.lit("")).cast("int")
    bold = F.lower(F.array_join(F.regexp_extract_all("line", F.lit(r"\*\*([^*]+?)\*\*")), " "))
    named = F.lit(None).cast("string")
    for name, words in reversed(list(sections.items())):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(bold, F.lit(word))
        named = F.when(hit, name).otherwise(named)
    opened = F.coalesce(F.last(F.when(year.isNotNull(), F.lit("")).otherwise(named), ignorenulls=True).over(w), F.lit(""))
    placed = lines.select("file", "n", "line", F.last(year, ignorenulls=True).over(w).alias("year"), F.when(opened == "", "unknown").otherwise(opened).alias("section"), year.isNotNull().alias("__heads"))
    tagged = F.lit(False)
    for tag in tags:
        tagged = tagged | F.contains("line", F.lit(tag))
    kept = placed.where(F.col("year").isNotNull() & ~F.col("__heads") & ~F.col("section").isin(*skipped) & ~tagged)
    titles = F.transform(F.regexp_extract_all("line", F.lit("\"([^\"]+)\"")), lambda t: F.trim(F.regexp_replace(F.trim(t), r"[,.;:?!]+$", "")))
    rows = kept.select("file", "n", "year", "section", F.posexplode(titles).alias("place", "title")).where(F.length("title").between(shortest, longest))
    order = {name: i for i, name in enumerate(sections)}
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col("section")], F.lit(len(order)))
    first = F.min_by(F.struct("n", "section", "title"), F.struct(rank, "n", "place"))
    return rows.groupBy("file", "year", normal_title(F.col("title")).alias("key")).agg(first.alias("r")).select("file", "year", "key", "r.*")


class _Boxes(HTMLParser):
    """Text pieces of the outermost elements that each layout (tag, attribute, value, whole) names."""

    def __init__(self, layouts):
        super().__init__(convert_charrefs=True)
        self.layouts, self.depth, self.found = layouts, [0] * len(layouts), [[] for _ in layouts]

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        for k, (wanted, name, value, whole) in enumerate(self.layouts):
            if tag == wanted:
                has = attrs.get(name) or ""
                if self.depth[k] or has == value or not whole and value in has:
                    self.depth[k] += 1

    def handle_endtag(self, tag):
        for k, layout in enumerate(self.layouts):
            if tag == layout[0] and self.depth[k]:
                self.depth[k] -= 1

    def handle_data(self, data):
        for k, depth in enumerate(self.depth):
            if depth:
                self.found[k].append(data)


def containers(df: DataFrame, layouts, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """Text of the containers of the first layout that a page has, its pieces joined by newlines; empty where there is none.

    A layout is (tag, attribute, value, whether the value is the whole attribute or a part of it)."""
    layouts = list(layouts)

    def read(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                boxes = _Boxes(layouts)
                boxes.feed(text or "")
                boxes.close()
                out.append("\n".join(next((f for f in boxes.found if f), [])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["page_id", "text"])

    return df.select(F.col(page_id).alias("page_id"), F.col(page).alias("html")).mapInArrow(read, f"page_id {df.schema[page_id].dataType.simpleString()}, text string")


def title_counts(rows: DataFrame) -> DataFrame:
    """(page_id, title, n) of the table rows whose second cell is a whole number, with or without commas."""
    cell = lambda i: F.trim(F.regexp_replace(F.get("cells", F.lit(i)), r"\s+", " "))
    n = F.regexp_replace(cell(1), ",", "")
    return rows.where((F.size("cells") >= 2) & n.rlike(r"^\d{1,18}$") & (cell(0) != "")).select("page_id", cell(0).alias("title"), n.cast("long").alias("n"))


def labelled_cell(cells: Column, label: str) -> Column:
    """The first cell that holds a label; null if there is none."""
    return F.get(F.filter(cells, lambda c: F.contains(c, F.lit(label))), F.lit(0))


def linked_slug(links: Column, marker: str = "/wiki/", skipped=()) -> Column:
    """The page that the first link with ``marker`` names, in plain words; links whose name begins with one of
    ``skipped`` don't count."""
    def name(link):
        return F.regexp_replace(F.try_url_decode(F.substring_index(link, marker, -1)), "#.*$", "")
    known = F.filter(links, lambda x: F.contains(x, F.lit(marker)))
    names = F.filter(F.transform(known, name), lambda x: ~x.rlike("^(?:" + "|".join(skipped) + ")") if skipped else x.isNotNull())
    return F.replace(F.get(names, F.lit(0)), F.lit("_"), F.lit(" "))


class _Page(HTMLParser):
    """Text of a page, its tables (row spans carried down) and its linked-data scripts."""

    BLOCKS = {"p", "br", "div", "li", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "table"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.tables, self.scripts, self.paragraphs, self.links = [], [], [], [], []
        self.skip, self.script, self.cell, self.row, self.spans, self.paragraph = 0, None, None, None, {}, None

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        if tag == "script" and attrs.get("type") == "application/ld+json":
            self.script = []
        elif tag in ("script", "style"):
            self.skip += 1
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "a" and attrs.get("href"):
            self.links.append(attrs["href"])
        if tag == "p":
            self.paragraph = []
        if tag == "table":
            self.tables.append([])
            self.spans = {}
        elif tag == "tr" and self.tables:
            self.row = []
        elif tag in ("td", "th") and self.row is not None:
            self.cell = []
            self.cell_span = int(attrs["rowspan"]) if str(attrs.get("rowspan", "")).isdigit() else 1

    def handle_endtag(self, tag):
        if tag == "script" and self.script is not None:
            self.scripts.append("".join(self.script))
            self.script = None
        elif tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag in self.BLOCKS:
            self.out.append("\n")
        if tag == "p" and self.paragraph is not None:
            self.paragraphs.append(" ".join("".join(self.paragraph).split()))
            self.paragraph = None
        if tag in ("td", "th") and self.cell is not None:
            self._carry()
            text = " ".join("".join(self.cell).split())
            if self.cell_span > 1:
                self.spans[len(self.row)] = [text, self.cell_span - 1]
            self.row.append(text)
            self.cell = None
        elif tag == "tr" and self.row is not None and self.tables:
            self._carry()
            self.tables[-1].append(self.row)
            self.row = None

    def _carry(self):
        while (held := self.spans.get(len(self.row))) and held[1] > 0:
            held[1] -= 1
            self.row.append(held[0])

    def handle_data(self, data):
        if self.script is not None:
            self.script.append(data)
        elif not self.skip:
            self.out.append(data)
            for part in (self.cell, self.paragraph):
                if part is not None:
                    part.append(data)


def parse_page(page: str | None):
    """(text, paragraphs, linked data, rows of all tables as (table, row, cells), links)."""
    parser = _Page()
    parser.feed(page or "")
    parser.close()
    text = re.sub(r"[ \t\xa0]+", " ", "".join(parser.out))
    text = "\n".join(x for x in (line.strip() for line in text.split("\n")) if x)
    rows = [{"table": t, "row": r, "cells": cells} for t, table in enumerate(parser.tables) for r, cells in enumerate(table)]
    return text, [p for p in parser.paragraphs if p], parser.scripts, rows, parser.links


PAGE_TYPE = "page_id {}, text string, paragraphs array<string>, linked array<string>, rows array<struct<table:int,row:int,cells:array<string>>>, links array<string>"


def _pages(batches):
    row = pa.struct([("table", pa.int32()), ("row", pa.int32()), ("cells", pa.list_(pa.string()))])
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            got = [parse_page(x) for x in part.column(1).to_pylist()]
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(row), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([g[k] for g in got], kind) for k, kind in enumerate(kinds))], names=["page_id", "text", "paragraphs", "linked", "rows", "links"])


def pages(df: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """One row per page: its text, paragraphs, linked-data scripts, table rows and links."""
    return df.select(F.col(page_id).alias("page_id"), F.col(page).alias("html")).mapInArrow(_pages, PAGE_TYPE.format(df.schema[page_id].dataType.simpleString()))


def table_rows(parsed: DataFrame) -> DataFrame:
    return parsed.select("page_id", F.explode("rows").alias("r")).select("page_id", "r.*")


def longest_review(parsed: DataFrame) -> DataFrame:
    """Author and body of the longest review among a page's linked data."""
    blob = F.from_json("linked", "reviewBody string, author struct<name:string>, datePublished string").alias("b")
    found = parsed.select("page_id", F.explode("linked").alias("linked")).select("page_id", blob).where("b.reviewBody is not null")
    return found.groupBy("page_id").agg(F.max_by("b", F.struct(F.length("b.reviewBody"), F.col("b.reviewBody"))).alias("b")).select("page_id", F.col("b.author.name").alias("author"), F.col("b.datePublished").alias("published"), F.col("b.reviewBody").alias("body"))


def article_body(parsed: DataFrame) -> DataFrame:
    """Paragraphs as one text, without a byline."""
    kept = F.filter("paragraphs", lambda p: ~p.rlike(r"(?i)^by\s+\S+(\s+\S+){0,4}$"))
    return parsed.select("page_id", F.array_join(kept, "\n").alias("body"))


def quotes(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(quoted_spans(F.col(text))).alias("place", "quote"))


def unescape(text: str | None) -> str | None:
    return None if text is None else html.unescape(text)
