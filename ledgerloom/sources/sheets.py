"""Rows of workbooks and of described text files, found by their titles: what banks and tills export."""

from __future__ import annotations

import csv
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterator, Sequence
from datetime import date, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.money import number
from ledgerloom.functions.parse import day as read_day, payments
from ledgerloom.functions.text import search_key
from ledgerloom.sources.ship import ship
from ledgerloom.sources.statements import C1, WESTERN, encoding_of

#: Rows a task holds at once, columns that a sheet can have, and what a workbook may unpack to.
CHUNK, MOST_COLUMNS, MOST_BYTES = 4096, 16384, 2 << 30

#: Fixed value: built-in number formats that are dates.
DATE_FORMATS = {*range(14, 18), 22}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(book: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ElementTree.Element]:
    """Each ``wanted`` element of a part, dropped once it was looked at."""
    if name not in book.namelist():
        return
    with book.open(name) as part:
        path: list[ElementTree.Element] = []
        for event, element in ElementTree.iterparse(part, ("start", "end")):
            if event == "start":
                path.append(element)
                continue
            path.pop()
            if _local(element.tag) == wanted:
                yield element
                if path:
                    path[-1].remove(element)


def _said(element: ElementTree.Element) -> str:
    # Phonetic readings stand beside the text, not in it.
    return "".join(t.text or "" for r in element for t in ([r] if _local(r.tag) == "t" else r if _local(r.tag) == "r" else ()) if _local(t.tag) == "t")


def _sheet_rows(content: bytes, sheet: str | None) -> Iterator[tuple[int, list[str | None]]]:
    """(number, cells) of each row of a sheet, the first one if none is named; dates as ISO text."""
    book = zipfile.ZipFile(io.BytesIO(content))
    if sum(x.file_size for x in book.infolist()) > MOST_BYTES:
        raise ValueError("a workbook that unpacks to more than is read")
    rel = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    targets = {e.get("Id"): e.get("Target") for e in _elements(book, "xl/_rels/workbook.xml.rels", "Relationship")}
    sheets = {e.get("name"): targets[e.get(rel)] for e in _elements(book, "xl/workbook.xml", "sheet")}
    if not sheets or (sheet is not None and sheet not in sheets):
        raise ValueError(f"no sheet {sheet!r} among {sorted(sheets)}")
    path = sheets[sheet] if sheet is not None else next(iter(sheets.values()))
    path = path.lstrip("/") if path.startswith("/") else f"xl/{path}"
    strings = [_said(e) for e in _elements(book, "xl/sharedStrings.xml", "si")]
    own = {int(e.get("numFmtId")) for e in _elements(book, "xl/styles.xml", "numFmt") if re.search(r"[dy]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", e.get("formatCode", "").lower()))}
    dated = [int(x.get("numFmtId", 0)) in DATE_FORMATS | own for e in _elements(book, "xl/styles.xml", "cellXfs") for x in e]
    first = date(1904, 1, 1) if any(e.get("date1904") in ("1", "true") for e in _elements(book, "xl/workbook.xml", "workbookPr")) else date(1899, 12, 30)
    for n, row in enumerate(_elements(book, path, "row"), 1):
        cells: list[str | None] = []
        for cell in row:
            letters = re.match(r"[A-Z]+", cell.get("r", ""))
            at = len(cells)
            if letters:
                at = 0
                for letter in letters.group():
                    at = at * 26 + ord(letter) - 64
                at -= 1
            if at >= MOST_COLUMNS:
                raise ValueError(f"a cell {cell.get('r')} beyond the columns of a sheet")
            value = next((x.text for x in cell if _local(x.tag) == "v"), None)
            kind, style = cell.get("t"), int(cell.get("s", 0))
            if kind == "s" and value is not None:
                value = strings[int(value)]
            elif kind == "inlineStr":
                value = "".join(_said(x) for x in cell)
            elif value is not None and kind in (None, "n") and style < len(dated) and dated[style]:
                value = (first + timedelta(days=int(float(value)))).isoformat()
            cells.extend([None] * (at + 1 - len(cells)))
            cells[at] = value
        yield int(row.get("r", n)), cells


def workbook_rows(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """file, row (its number in the sheet), cells of every workbook at ``path``. A task streams one file's rows; files go apart."""

    def read(batches):
        for batch in batches:
            for file, content in zip(batch.path, batch.content, strict=True):
                held: list[tuple[str, int, list[str | None]]] = []
                for n, cells in _sheet_rows(bytes(content), sheet):
                    held.append((file, n, cells))
                    if len(held) == CHUNK:
                        yield pd.DataFrame(held, columns=["file", "row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "row", "cells"])

    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "file string, row int, cells array<string>")


def text_rows(spark: SparkSession, path: str, separator: str = ";") -> DataFrame:
    """file, row, cells of every text file at ``path``, each in the encoding that its own bytes tell. A row is a record: a quoted
    cell may hold line breaks, and doubled quotes; it has as many cells as are written, empty ones null. A task streams one
    file's rows; files go apart."""
    content, kind = F.col("content"), F.col("encoding")
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content", encoding_of(F.col("content")).alias("encoding"))
    text = F.when(kind == "UTF-16", F.decode(content, "UTF-16")).when(kind == "UTF-8", F.decode(content, "UTF-8")).otherwise(F.translate(F.decode(content, "ISO-8859-1"), C1, WESTERN))

    def read(batches):
        csv.field_size_limit(MOST_BYTES)
        for batch in batches:
            for file, whole in zip(batch.file, batch.text, strict=True):
                held: list[tuple[str, int, list[str | None]]] = []
                for n, cells in enumerate(csv.reader(io.StringIO(whole.removeprefix("\ufeff"), newline=""), delimiter=separator), 1):
                    held.append((file, n, [c or None for c in cells]))
                    if len(held) == CHUNK:
                        yield pd.DataFrame(held, columns=["file", "row", "cells"])
                        held = []
                yield pd.DataFrame(held, columns=["file", "row", "cells"])

    ship(spark)
    return files.select("file", text.alias("text")).mapInPandas(read, "file string, row int, cells array<string>")


def titled(rows: DataFrame, titles: dict[str, Sequence[str]], within: int = 20) -> DataFrame:
    """The rows below each file's titles, a text column a name: file, row, refused, names. ``titles``: each name with the titles it
    can have, case and accents aside.

    The first of the leading rows that has a title for every name is the header. A file without one gives a single row that is
    refused for it.
    """
    fold = lambda text: search_key(F.trim(text))
    place = lambda known: F.array_position(F.transform("cells", lambda c: F.coalesce(fold(c).isin([_fold(k) for k in known]), F.lit(False))), True).cast("int")
    at = [place(known).alias(name) for name, known in titles.items()]
    leading = rows.filter(F.col("row") <= within).select("file", "row", F.struct(*at).alias("at"))
    for name in titles:
        leading = leading.filter(F.col("at")[name] > 0)
    heads = leading.groupBy("file").agg(F.min("row").alias("head"), F.min_by("at", "row").alias("at"))
    met = rows.join(heads, "file", "left")
    cell = lambda name: F.nullif(F.trim(F.get("cells", F.col("at")[name] - 1)), F.lit("")).alias(name)
    good = met.filter(F.col("row") > F.col("head")).select("file", "row", F.lit(None).cast("string").alias("refused"), *map(cell, titles))
    bad = met.filter("head is null").select("file").distinct().select("file", F.lit(None).cast("int").alias("row"), F.lit("header").alias("refused"), *(F.lit(None).cast("string").alias(n) for n in titles))
    return good.unionByName(bad)


def _fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.strip().lower()) if unicodedata.category(c) != "Mn")


def typed(rows: DataFrame, kinds: dict[str, str], order: str = "dmy", needed: Sequence[str] = ()) -> DataFrame:
    """``titled`` rows with their texts read as ``day``, ``number`` or ``text``. A row is refused for the first name that does not
    read, or is needed and empty; rows with nothing in them go."""
    iso = lambda c: F.coalesce(F.when(F.col(c).rlike(r"^\d{4}-\d\d-\d\d"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd")), read_day(F.col(c), order))
    plain = lambda c: F.coalesce(number(F.col(c)), F.col(c).try_cast("decimal(18,4)"))
    read: dict[str, Column] = {n: iso(n) if k == "day" else plain(n) if k == "number" else F.col(n) for n, k in kinds.items()}
    wrong = [F.when(F.col(n).isNotNull() & x.isNull() | (F.col(n).isNull() & F.lit(n in needed)), n) for n, x in read.items()]
    some = F.coalesce(*(F.col(n) for n in kinds)).isNotNull() | F.col("refused").isNotNull()
    return rows.filter(some).select("file", "row", F.coalesce("refused", *wrong).alias("refused"), *(x.alias(n) for n, x in read.items()))


def till_sales(rows: DataFrame, titles: dict[str, Sequence[str]], total: str = "total") -> DataFrame:
    """Sales of a till's export, a row a day and product: file, day, product, quantity, revenue, and rows refused as they are. Its
    rows of totals, whose product begins with ``total``, are left out; ``titles``: day, product, quantity, revenue."""
    read = typed(titled(rows, titles), {"day": "day", "product": "text", "quantity": "number", "revenue": "number"}, needed=("day", "product", "quantity"))
    read = read.filter(F.coalesce(~search_key(F.col("product")).startswith(total), F.lit(True)))
    good = read.filter("refused is null").groupBy("file", "day", "product").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    return good.select("*", F.lit(None).cast("string").alias("refused"), F.lit(None).cast("int").alias("row")).unionByName(read.filter("refused is not null").select("file", "day", "product", "quantity", "revenue", "refused", "row"))


def till_book(spark: SparkSession, path: str, lines: str, tickets: str, line_titles: dict[str, Sequence[str]], ticket_titles: dict[str, Sequence[str]]) -> tuple[DataFrame, DataFrame]:
    """The two sheets of a till's workbook: sales by (day, product, rate), and the payments printed on its tickets by (day,
    method). ``line_titles``: day, product, quantity, revenue, rate; ``ticket_titles``: day, payments."""
    sold = typed(titled(workbook_rows(spark, path, lines), line_titles), {"day": "day", "product": "text", "quantity": "number", "revenue": "number", "rate": "number"}, needed=("day", "product"))
    sold = sold.filter("refused is null").groupBy("file", "day", "product", "rate").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    paid = typed(titled(workbook_rows(spark, path, tickets), ticket_titles), {"day": "day", "payments": "text"}, needed=("day",)).filter("refused is null")
    paid = paid.select("file", "day", F.explode(payments(F.col("payments"))).alias("p")).groupBy("file", "day", "p.method").agg(F.sum("p.amount").alias("amount"), F.count("*").alias("n"))
    return sold, paid
