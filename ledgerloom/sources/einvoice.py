"""Electronic invoices: lines and headers of UBL and CII files, alone or inside a PDF, by a streaming XML parser.

Names are told by their local part, as prefixes differ from sender to sender. A credit note states its amounts positive and means
the other way round, so what it states is signed, unless its total is negative already.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.ship import ship

LINES = "number int, name string, quantity decimal(12,3), ht decimal(12,2), vat decimal(5,4)"

#: Lines handed on at once, and bytes parsed at once.
CHUNK, FED = 4096, 1 << 20
#: Elements of a line in either format, codes of credit notes, and elements that come several times.
UBL, CII = ("InvoiceLine", "CreditNoteLine"), ("IncludedSupplyChainTradeLineItem",)
CREDIT_CODES = ("381", "261", "396")
REPEATED = {"TaxTotal", "TaxSubtotal", "AllowanceCharge", "ApplicableTradeTax", "SpecifiedTradeAllowanceCharge"}
#: Elements of a line that have names and amounts of their own.
ASIDE = {"AllowanceCharge", "SpecifiedTradeAllowanceCharge", "DocumentReference", "OrderLineReference", "Price", "SubInvoiceLine", "SellerTradeParty", "ManufacturerParty"}


class Damaged(ValueError):
    """Not an invoice that can be read."""


def _xml(content: bytes) -> bytes:
    """The invoice itself: of a PDF the first of its streams that holds one."""
    if not content.startswith(b"%PDF"):
        return content
    for m in re.finditer(rb"stream\r?\n", content):
        end = content.find(b"endstream", m.end())
        if m.start() >= 3 and content[m.start() - 3 : m.start()] == b"end" or end < 0:
            continue
        data = content[m.end() : end]
        try:
            data = zlib.decompressobj().decompress(data)
        except zlib.error:
            pass
        if b"CrossIndustryInvoice" in data or b"xsd:Invoice-2" in data or b"xsd:CreditNote-2" in data:
            return data
    raise Damaged("a PDF without an invoice")


Leaf = tuple[tuple[str, ...], str, dict[str, str]]


def _leaves(content: bytes, lines: tuple[str, ...]) -> Iterator[tuple[bool, list[Leaf]]]:
    """(True, leaves) of each line in turn, then (False, leaves) of all that is in no line: path, text, attributes. Paths of a line
    begin below it; elements that come several times carry a number."""
    path: list[str] = []
    counts: dict[str, int] = {}
    header: list[Leaf] = []
    done: list[list[Leaf]] = []
    state: dict = {"line": None, "base": 0, "text": [], "leaf": False, "attributes": {}}

    def start(tag: str, attributes: dict[str, str]) -> None:
        name = tag.rpartition(":")[2]
        if name in lines and state["line"] is None:
            state["line"], state["base"] = [], len(path) + 1
        if name in REPEATED:
            counts[name] = counts.get(name, 0) + 1
            name = f"{name}#{counts[name]}"
        path.append(name)
        state["text"], state["leaf"], state["attributes"] = [], True, attributes

    def end(tag: str) -> None:
        if state["leaf"]:
            into = header if state["line"] is None else state["line"]
            at = tuple(path[state["base"] :]) if state["line"] is not None else tuple(path)
            into.append((at, "".join(state["text"]).strip(), state["attributes"]))
        if state["line"] is not None and len(path) == state["base"]:
            done.append(state["line"])
            state["line"], state["base"] = None, 0
        state["leaf"] = False
        path.pop()

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = lambda text: state["text"].append(text)
    try:
        for lo in range(0, max(len(content), 1), FED):
            parser.Parse(content[lo : lo + FED], lo + FED >= len(content))
            yield from ((True, x) for x in done)
            done.clear()
    except expat.ExpatError as e:
        raise Damaged(str(e)) from e
    yield False, header


def _under(leaves: list[Leaf], *names: str, within: str | None = None) -> str | None:
    """The text of the first leaf of one of ``names``, inside ``within`` if given."""
    return next((text for path, text, _ in leaves if path and path[-1] in names and (within is None or within in path[:-1])), None)


def _groups(leaves: list[Leaf], name: str, top: str | None = None) -> list[list[Leaf]]:
    out: dict[str, list[Leaf]] = {}
    for leaf in leaves:
        for part in leaf[0]:
            if part.startswith(f"{name}#") and (top is None or top in leaf[0]):
                out.setdefault(part, []).append(leaf)
                break
    return list(out.values())


def _sign(header: list[Leaf]) -> tuple[bool, int]:
    """Whether it is a credit note, and what its amounts are multiplied by."""
    root = header[0][0][0] if header else ""
    code = _under(header, "InvoiceTypeCode", "CreditNoteTypeCode") or _under(header, "TypeCode", within="ExchangedDocument")
    credit = root == "CreditNote" or code in CREDIT_CODES
    stated = _under(header, "PayableAmount", "DuePayableAmount") or _under(header, "TaxInclusiveAmount", "GrandTotalAmount") or ""
    return credit, -1 if credit and not stated.startswith("-") else 1


def _line(leaves: list[Leaf]) -> tuple:
    own = [x for x in leaves if not {p.partition("#")[0] for p in x[0][:-1]} & ASIDE]
    number = next((t for path, t, _ in own if path == ("ID",)), None) or _under(own, "LineID", "ID")
    name = _under(own, "Name", within="Item") or _under(own, "Name")
    return number, name, _under(own, "InvoicedQuantity", "CreditedQuantity", "BilledQuantity"), _under(own, "LineExtensionAmount", "LineTotalAmount"), _under(own, "Percent", "RateApplicablePercent")


def _files(spark: SparkSession, path: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def _lines(spark: SparkSession, path: str, tags: tuple[str, ...]) -> DataFrame:
    def read(batches):
        for batch in batches:
            for file, content in zip(batch.file, batch.content, strict=True):
                held = []
                try:
                    data = _xml(bytes(content))
                    # The total that tells the sign may come behind the lines.
                    sign = next(_sign(x)[1] for line, x in _leaves(data, tags) if not line)
                    for line, leaves in _leaves(data, tags):
                        if line:
                            held.append((file, sign, *_line(leaves)))
                        if len(held) == CHUNK:
                            yield pd.DataFrame(held, columns=NAMES)
                            held = []
                except Damaged:
                    continue
                yield pd.DataFrame(held, columns=NAMES)

    NAMES = ["file", "sign", "number", "name", "quantity", "ht", "vat"]
    rows = _files(spark, path).mapInPandas(read, "file string, sign int, number string, name string, quantity string, ht string, vat string")
    signed = lambda c, kind: (F.col(c).try_cast(kind) * F.col("sign")).cast(kind).alias(c)
    return rows.select("file", F.col("number").try_cast("int").alias("number"), "name", signed("quantity", "decimal(12,3)"), signed("ht", "decimal(12,2)"), (F.col("vat").try_cast("decimal(6,2)") / 100).cast("decimal(5,4)").alias("vat"))


def read_ubl(spark: SparkSession, path: str) -> DataFrame:
    """file, number, name, quantity, ht, vat of every line of UBL invoices and credit notes; those of a credit note are negative. A
    file that is no invoice has no lines, and ``ubl_headers`` says why."""
    return _lines(spark, path, UBL)


def read_cii(spark: SparkSession, path: str) -> DataFrame:
    """The same of CII invoices, PDFs with one included."""
    return _lines(spark, path, CII)


HEADERS = "file string, sign int, number string, day string, seller string, ht string, tax string, ttc string, due string, rates array<struct<rate:string,base:string,tax:string>>, allowances array<struct<amount:string,reason:string,charge:boolean>>, credit boolean, refused string"


def _ubl_header(h: list[Leaf]) -> dict:
    party = [x for x in h if "AccountingSupplierParty" in x[0]]
    currency = (_under(h, "DocumentCurrencyCode") or "").upper()
    totals = [(t, (a.get("currencyID") or currency).upper() == currency or not currency) for p, t, a in h if p[-1] == "TaxAmount" and len(p) > 1 and p[-2].startswith("TaxTotal#")]
    return {
        "number": next((t for p, t, _ in h if p[-1] == "ID" and len(p) == 2), None), "day": _under(h, "IssueDate"), "seller": _under(party, "RegistrationName") or _under(party, "Name"),
        "ht": _under(h, "TaxExclusiveAmount"), "tax": next((t for t, ours in totals if ours), totals[0][0] if totals else None), "ttc": _under(h, "TaxInclusiveAmount"), "due": _under(h, "PayableAmount"),
        "rates": [{"rate": _under(g, "Percent"), "base": _under(g, "TaxableAmount"), "tax": _under(g, "TaxAmount")} for g in _groups(h, "TaxSubtotal")],
        "allowances": [{"amount": _under(g, "Amount"), "reason": _under(g, "AllowanceChargeReason") or "", "charge": (_under(g, "ChargeIndicator") or "").lower() == "true"} for g in _groups(h, "AllowanceCharge")],
    }


def _cii_header(h: list[Leaf]) -> dict:
    sums, ours = "SpecifiedTradeSettlementHeaderMonetarySummation", (_under(h, "InvoiceCurrencyCode") or "").upper()
    tax = [(t, (a.get("currencyID") or ours).upper() == ours or not ours) for p, t, a in h if p[-1] == "TaxTotalAmount"]
    return {
        "number": _under(h, "ID", within="ExchangedDocument"), "day": _under(h, "DateTimeString", within="ExchangedDocument"), "seller": _under(h, "Name", within="SellerTradeParty"),
        "ht": _under(h, "TaxBasisTotalAmount", within=sums), "tax": next((t for t, same in tax if same), tax[0][0] if tax else None), "ttc": _under(h, "GrandTotalAmount", within=sums), "due": _under(h, "DuePayableAmount", within=sums),
        "rates": [{"rate": _under(g, "RateApplicablePercent"), "base": _under(g, "BasisAmount"), "tax": _under(g, "CalculatedAmount")} for g in _groups(h, "ApplicableTradeTax")],
        "allowances": [{"amount": _under(g, "ActualAmount"), "reason": _under(g, "Reason") or "", "charge": (_under(g, "Indicator") or "").lower() == "true"} for g in _groups(h, "SpecifiedTradeAllowanceCharge")],
    }


def _headers(spark: SparkSession, path: str, tags: tuple[str, ...], of, day: Column) -> DataFrame:
    columns = [x.split()[0] for x in HEADERS.split(", ")]

    def read(batches):
        for batch in batches:
            rows = []
            for file, content in zip(batch.file, batch.content, strict=True):
                row = dict.fromkeys(columns) | {"file": file, "sign": 1, "rates": [], "allowances": []}
                try:
                    found = next(x for line, x in _leaves(_xml(bytes(content)), tags) if not line)
                    row["credit"], row["sign"] = _sign(found)
                    row |= of(found)
                except Damaged as e:
                    row["refused"] = str(e)
                rows.append(row)
            yield pd.DataFrame(rows, columns=columns)

    rows = _files(spark, path).mapInPandas(read, HEADERS)
    money = lambda c: (c.try_cast("decimal(12,2)") * F.col("sign")).cast("decimal(12,2)")
    rate = lambda c: (c.try_cast("decimal(6,2)") / 100).cast("decimal(5,4)")
    return rows.select(
        "file", "number", day.alias("day"), "seller", *(money(F.col(c)).alias(c) for c in ("ht", "tax", "ttc", "due")),
        F.transform("rates", lambda x: F.struct(rate(x["rate"]).alias("rate"), money(x["base"]).alias("base"), money(x["tax"]).alias("tax"))).alias("rates"),
        F.transform("allowances", lambda x: F.struct((money(x["amount"]) * F.when(x["charge"], -1).otherwise(1)).cast("decimal(12,2)").alias("amount"), x["reason"].alias("reason"))).alias("allowances"), "credit", "refused",
    )


def ubl_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row a UBL file: file, number, day, seller, ht, tax, ttc, due, rates (rate, base, tax), allowances (amount, reason; a charge is
    negative), credit (a credit note: its amounts are negative), refused (why a file could not be read)."""
    return _headers(spark, path, UBL, _ubl_header, F.try_to_date("day", "yyyy-MM-dd"))


def cii_headers(spark: SparkSession, path: str) -> DataFrame:
    """The same of CII files, PDFs with one included."""
    return _headers(spark, path, CII, _cii_header, F.try_to_date(F.trim("day"), "yyyyMMdd"))
