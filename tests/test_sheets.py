"""Workbooks and text files whose titles are searched for, and what documents print."""

import zipfile
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import text
from ledgerloom.operators import identifiers, names, packs
from ledgerloom.sources import einvoice, sheets

MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path, parts):
    """A workbook with a sheet for each (name, xml rows)."""
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {MAIN} xmlns:r="{REL}"><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _) in enumerate(parts, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="r{i}" Target="worksheets/s{i}.xml"/>' for i in range(1, len(parts) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {MAIN}><si><t>Jour</t></si><si><r><t>Pro</t></r><r><t>duit</t></r></si><si><t>Qté</t></si><si><t>CA TTC</t></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {MAIN}><numFmts><numFmt numFmtId="170" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        for i, (_, rows) in enumerate(parts, 1):
            z.writestr(f"xl/worksheets/s{i}.xml", f"<worksheet {MAIN}><sheetData>{rows}</sheetData></worksheet>")


SALES = """<row r="1"><c r="A1" t="inlineStr"><is><t>Export</t></is></c></row>
<row r="3"><c r="B3" t="s"><v>0</v></c><c r="C3" t="s"><v>1</v></c><c r="E3" t="s"><v>2</v></c><c r="F3" t="s"><v>3</v></c></row>
<row r="4"><c r="B4" s="1"><v>45293</v></c><c r="C4" t="str"><v>Gin</v></c><c r="E4"><v>2</v></c><c r="F4"><v>17.5</v></c></row>
<row r="5"><c r="B5" t="str"><v>02/01/2024</v></c><c r="C5" t="str"><v>Gin</v></c><c r="E5"><v>1</v></c><c r="F5" t="str"><v>8,75</v></c></row>
<row r="6"><c r="B6" t="str"><v>02/01/2024</v></c><c r="C6" t="str"><v>Rum</v></c><c r="E6" t="str"><v>two</v></c></row>
<row r="7"><c r="B7" t="str"><v>02/01/2024</v></c><c r="C7" t="str"><v>TOTAL</v></c><c r="E7"><v>3</v></c><c r="F7"><v>26.25</v></c></row>"""
TITLES = {"day": ["jour", "date"], "product": ["produit"], "quantity": ["qte", "quantité"], "revenue": ["ca ttc"]}


def test_workbook(spark, tmp_path):
    book(tmp_path / "a.xlsx", [("Ventes", SALES), ("Vide", "")])
    rows = sheets.workbook_rows(spark, str(tmp_path / "a.xlsx"))
    assert [(r.row, r.cells) for r in rows.collect()][2] == (4, [None, "2024-01-02", "Gin", None, "2", "17.5"])
    got = sheets.till_sales(rows, TITLES).collect()
    assert [(r.day, r["product"], r.quantity, r.revenue) for r in got if r.refused is None] == [(date(2024, 1, 2), "Gin", Decimal(3), Decimal("26.25"))]
    assert [(r.row, r.refused) for r in got if r.refused] == [(6, "quantity")]
    assert sheets.workbook_rows(spark, str(tmp_path / "a.xlsx"), "Vide").count() == 0
    with pytest.raises(Exception, match="no sheet"):
        sheets.workbook_rows(spark, str(tmp_path / "a.xlsx"), "Autre").collect()


def test_till_book(spark, tmp_path):
    cell = lambda x: f'<c t="str"><v>{x}</v></c>'
    row = lambda *x: "<row>" + "".join(map(cell, x)) + "</row>"
    lines = row("Day", "Name", "Qty", "TTC", "Rate") + row("01/02/2024", "Beer", 2, 10, 20) + row("01/02/2024", "Beer", 1, 5, 20) + row("01/02/2024", "Bread", 1, 3, 10)
    book(tmp_path / "b.xlsx", [("L", lines), ("T", row("Day", "Paid") + row("01/02/2024", "CB(4,50)/Cash(2,00)") + row("01/02/2024", "CB(11,50)"))])
    sold, paid = sheets.till_book(spark, str(tmp_path / "b.xlsx"), "L", "T", {"day": ["day"], "product": ["name"], "quantity": ["qty"], "revenue": ["ttc"], "rate": ["rate"]}, {"day": ["day"], "payments": ["paid"]})
    assert {(r["product"], r.rate, r.quantity, r.revenue) for r in sold.collect()} == {("Beer", 20, 3, 15), ("Bread", 10, 1, 3)}
    assert {(r.method, float(r.amount), r.n) for r in paid.collect()} == {("CB", 16.0, 2), ("Cash", 2.0, 1)}


def test_text_files_in_any_encoding(spark, tmp_path):
    body = 'Compte;1\nDate;Libellé;Montant\n02/01/2024;"Café; bar";-4,50\n;;\nx;Y;1\n'
    for name, encoding in (("a", "utf-8-sig"), ("b", "cp1252"), ("c", "utf-16")):
        (tmp_path / f"{name}.csv").write_text(body, encoding=encoding)
    (tmp_path / "d.csv").write_text("nothing\n")
    rows = sheets.titled(sheets.text_rows(spark, str(tmp_path)), {"day": ["DATE"], "label": ["libelle"], "amount": ["montant"]})
    got = sheets.typed(rows, {"day": "day", "label": "text", "amount": "number"}, needed=("day", "amount")).collect()
    assert sorted((r.file[-5], r.refused or "") for r in got) == [("a", ""), ("a", "day"), ("b", ""), ("b", "day"), ("c", ""), ("c", "day"), ("d", "header")]
    assert {(r.day, r.label, r.amount) for r in got if not r.refused} == {(date(2024, 1, 2), "Café; bar", Decimal("-4.50"))}


def test_identifiers(spark):
    texts = ["SIREN 732 829 320\nTel 01 23 45 67 89", "732829320", "SIRET 73282932000074", "FR 44 732 829 320", "FR 45 732 829 320", "+33 (0)1.23.45.67.89 me@shop.fr https://www.Shop.fr/x", "01.23 45.67 89.00", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.x for r in df.select("i", text.identifiers(F.col("t")).alias("x")).collect()}
    assert got == {0: ["siren:732829320", "tel:0123456789"], 1: [], 2: ["siren:732829320"], 3: ["siren:732829320"], 4: [], 5: ["tel:0123456789", "web:shop.fr"], 6: [], 7: None, 8: []}


def test_recognised(spark):
    filed = spark.createDataFrame([(i, i // 4, False) for i in range(8)], "doc_id long, supplier_id long, bare boolean")
    printed = spark.createDataFrame([(i, f"tel:{i // 4}") for i in range(8)] + [(i, "tel:client") for i in range(8)] + [(i, f"web:{i // 4}") for i in range(8)], "doc_id long, identifier string")
    known = identifiers.learnt(printed, filed)
    assert {tuple(r) for r in known.collect()} == {(0, "tel:0"), (1, "tel:1"), (0, "web:0"), (1, "web:1")}
    new = spark.createDataFrame([(1, "tel:0"), (2, "web:0"), (3, "tel:0"), (3, "tel:1"), (4, "tel:1"), (4, "siren:9"), (5, "tel:1"), (5, "web:1")], "doc_id long, identifier string")
    assert {tuple(r) for r in identifiers.recognised(new, known).collect()} == {(1, 0, "tel:0"), (5, 1, "tel:1 web:1")}


def test_packs(spark):
    rows = [(0, "VAP 5L", 1, 3, "0.9", "UNIT 1 high False UNIT"), (1, "HUILE 5L", 5, 5, "0", "L 1 high False L"), (2, "7UP 1.5L", 1, 1, "0", "UNIT 1.5 high False L"), (3, "PH 2PLIS 200F 24RLX", 1, 1, "0", "UNIT 24 medium False UNIT"), (4, None, 1, 1, None, "UNIT 1 low False UNIT"), (5, "COLA 33 CL X 24", 1, 1, "7.92", "UNIT 1 high False UNIT"), (6, "ROTI 1KGENV", 1, 1, "0", "UNIT 1 medium True KG"), (7, "RHUM 70CL", 1, 2, "1.4", "L 1 high False L")]
    df = spark.createDataFrame([r[:5] for r in rows], "id int, name string, pack int, quantity int, total_volume string")
    got = {r.id: f"{r.unit} {r.equivalent.normalize():f} {r.confidence} {r.approx} {r.stock_unit}" for r in packs.pack_equivalents(df).collect()}
    assert got == {r[0]: r[5] for r in rows}
    names_ = {"MPRO PH 2PLIS 200F 24RLX": "PH 2PLIS", "7UP 1.5L": "7UP", "1664 BLD 33CL": "1664 BLD", "ORGEAT 1L X 1 VP": "ORGEAT VP", "SOMETHING, 33CL": "SOMETHING"}
    df = spark.createDataFrame(list(names_.items()), "n string, want string")
    # A count of leaves in the middle is no size.
    assert [(r.x, r.want) for r in df.select(packs.without_packs(F.col("n")).alias("x"), "want").collect() if r.x != r.want] == [("PH 2PLIS 200F", "PH 2PLIS")]


def test_paired_words(spark):
    said = ["BOUTEILLE GAZ CONS", "CONSIGNE BOUTEILLE GAZ CONS", "gaz bouteilles consigne", "PROSECO DOC", "DOC PROSECCO", "REF7001 SEC", "REF7002 SEC", "PROSECCO DOC", ""]
    df = spark.createDataFrame([(i, 1, n) for i, n in enumerate(said)], "id long, grp int, name string")
    assert {tuple(r) for r in names.paired(df).collect()} == {(0, 2, False), (3, 4, False)}


def test_likeness(spark):
    pairs = [("Cold Bolt", "old-bolt"), ("a b", "b a"), ("x", ""), (None, "x"), ("abc", "xyz"), ("gin", "GIN ")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] and round(r[0], 2) for r in df.select(text.likeness(F.col("a"), F.col("b"))).collect()][:3] == [94.12, 100.0, 0.0]
    assert [r[0] for r in df.select(text.likeness(F.col("a"), F.col("b"))).collect()][4:] == [0.0, 100.0]


def test_einvoice_headers(spark, tmp_path):
    ubl = """<Invoice><cbc:ID>F-12</cbc:ID><cbc:IssueDate>2024-03-05</cbc:IssueDate><cac:AccountingSupplierParty><cac:PartyName><cbc:Name>Shop</cbc:Name></cac:PartyName><cbc:ID>9</cbc:ID></cac:AccountingSupplierParty>
<cac:AllowanceCharge><cbc:ChargeIndicator>false</cbc:ChargeIndicator><cbc:AllowanceChargeReason>Promo</cbc:AllowanceChargeReason><cbc:Amount currencyID="EUR">2.00</cbc:Amount></cac:AllowanceCharge>
<cac:AllowanceCharge><cbc:ChargeIndicator>true</cbc:ChargeIndicator><cbc:Amount>1.00</cbc:Amount></cac:AllowanceCharge>
<cac:TaxTotal><cbc:TaxAmount>4.80</cbc:TaxAmount><cac:TaxSubtotal><cbc:TaxableAmount>20</cbc:TaxableAmount><cbc:TaxAmount>4</cbc:TaxAmount><cac:TaxCategory><cbc:Percent>20</cbc:Percent></cac:TaxCategory></cac:TaxSubtotal><cac:TaxSubtotal><cbc:TaxableAmount>8</cbc:TaxableAmount><cbc:TaxAmount>0.80</cbc:TaxAmount><cbc:Percent>10</cbc:Percent></cac:TaxSubtotal></cac:TaxTotal>
<cac:LegalMonetaryTotal><cbc:TaxExclusiveAmount>28.00</cbc:TaxExclusiveAmount><cbc:TaxInclusiveAmount>32.80</cbc:TaxInclusiveAmount><cbc:PayableAmount>30</cbc:PayableAmount></cac:LegalMonetaryTotal>
<cac:InvoiceLine><cbc:ID>1</cbc:ID><cac:AllowanceCharge><cbc:Amount>9</cbc:Amount></cac:AllowanceCharge></cac:InvoiceLine></Invoice>"""
    (tmp_path / "u.xml").write_text(ubl)
    d = lambda x: Decimal(x).quantize(Decimal("0.01"))
    want = ("F-12", date(2024, 3, 5), "Shop", d("28"), d("4.80"), d("32.80"), d("30"))
    r = einvoice.ubl_headers(spark, str(tmp_path / "u.xml")).first()
    assert tuple(r)[1:8] == want
    assert [tuple(x) for x in r.rates] == [(Decimal("0.2000"), d(20), d(4)), (Decimal("0.1000"), d(8), d("0.8"))] and [tuple(x) for x in r.allowances] == [(d(2), "Promo"), (d(-1), "")]
    cii = """<x><rsm:ExchangedDocument><ram:ID>F-12</ram:ID><ram:IssueDateTime><udt:DateTimeString format="102">20240305</udt:DateTimeString></ram:IssueDateTime></rsm:ExchangedDocument>
<ram:IncludedSupplyChainTradeLineItem><ram:LineID>1</ram:LineID><ram:ApplicableTradeTax><ram:RateApplicablePercent>5.5</ram:RateApplicablePercent></ram:ApplicableTradeTax></ram:IncludedSupplyChainTradeLineItem>
<ram:SellerTradeParty><ram:Name>Shop</ram:Name></ram:SellerTradeParty><ram:ApplicableTradeTax><ram:CalculatedAmount>4.80</ram:CalculatedAmount><ram:BasisAmount>28</ram:BasisAmount><ram:RateApplicablePercent>20</ram:RateApplicablePercent></ram:ApplicableTradeTax>
<ram:SpecifiedTradeSettlementHeaderMonetarySummation><ram:TaxBasisTotalAmount>28</ram:TaxBasisTotalAmount><ram:TaxTotalAmount currencyID="EUR">4.80</ram:TaxTotalAmount><ram:GrandTotalAmount>32.80</ram:GrandTotalAmount><ram:DuePayableAmount>30</ram:DuePayableAmount></ram:SpecifiedTradeSettlementHeaderMonetarySummation></x>"""
    (tmp_path / "c.xml").write_text(cii)
    r = einvoice.cii_headers(spark, str(tmp_path / "c.xml")).first()
    assert tuple(r)[1:8] == want and [tuple(x) for x in r.rates] == [(Decimal("0.2000"), d(28), d("4.8"))] and r.allowances == []


def test_einvoice_credit_notes_entities_and_pdf(spark, tmp_path):
    import zlib

    line = "<cac:{0}Line unit='1'><!-- <cac:InvoiceLine> --><cbc:ID>{1}</cbc:ID><cbc:{2}Quantity unitCode='C62'>{3}</cbc:{2}Quantity><cbc:LineExtensionAmount>10.50</cbc:LineExtensionAmount><cac:Price><cbc:Name>no</cbc:Name></cac:Price><cac:Item><cbc:Name>{4}</cbc:Name><cac:ClassifiedTaxCategory><cbc:Percent>5.5</cbc:Percent></cac:ClassifiedTaxCategory></cac:Item></cac:{0}Line>"
    head = "<?xml version='1.0' encoding='UTF-8'?><{0} xmlns='urn:oasis:names:specification:ubl:schema:xsd:{0}-2'><cbc:ID>A&amp;1</cbc:ID><cbc:IssueDate>2024-03-05</cbc:IssueDate>{1}<cac:LegalMonetaryTotal><cbc:PayableAmount>{2}</cbc:PayableAmount></cac:LegalMonetaryTotal>"
    for name, due in (("credit", "21.00"), ("signed", "-21.00")):
        lines = line.format("CreditNote", 1, "Credited", 2, "Salt &amp; pepper") + line.format("CreditNote", 2, "Credited", 1, "<![CDATA[a < b]]>")
        (tmp_path / f"{name}.xml").write_text(head.format("CreditNote", "<cac:AccountingSupplierParty><cbc:Name>É &lt; Co</cbc:Name></cac:AccountingSupplierParty>", due) + lines + "</CreditNote>")
    (tmp_path / "many.xml").write_text(head.format("Invoice", "", "1") + "".join(line.format("Invoice", i, "Invoiced", i, "x") for i in range(10_000)) + "</Invoice>")
    (tmp_path / "broken.xml").write_text("<Invoice><cbc:ID>1</Invoice>")
    rows = {(r.file.rpartition("/")[2], r.number): (r["name"], r.quantity, r.ht, r.vat) for r in einvoice.read_ubl(spark, str(tmp_path)).collect()}
    assert rows["credit.xml", 1] == ("Salt & pepper", Decimal(-2), Decimal("-10.50"), Decimal("0.0550")) and rows["credit.xml", 2][0] == "a < b"
    assert rows["signed.xml", 1][1:3] == (Decimal(2), Decimal("10.50")) and sum(f == "many.xml" for f, _ in rows) == 10_000 and not any(f == "broken.xml" for f, _ in rows)
    heads = {r.file.rpartition("/")[2]: r for r in einvoice.ubl_headers(spark, str(tmp_path)).collect()}
    assert (heads["credit.xml"].number, heads["credit.xml"].seller, heads["credit.xml"].due, heads["credit.xml"].credit) == ("A&1", "É < Co", Decimal("-21.00"), True)
    assert heads["signed.xml"].due == Decimal("-21.00") and heads["many.xml"].credit is False and heads["broken.xml"].refused and heads["many.xml"].refused is None
    cii = b"<rsm:CrossIndustryInvoice><rsm:ExchangedDocument><ram:ID>7</ram:ID><ram:TypeCode>381</ram:TypeCode></rsm:ExchangedDocument><ram:IncludedSupplyChainTradeLineItem><ram:LineID>1</ram:LineID><ram:Name>N</ram:Name><ram:BilledQuantity>3</ram:BilledQuantity><ram:LineTotalAmount>9</ram:LineTotalAmount></ram:IncludedSupplyChainTradeLineItem></rsm:CrossIndustryInvoice>"
    folder = tmp_path / "pdf"
    folder.mkdir()
    (folder / "a.pdf").write_bytes(b"%PDF-1.7\n1 0 obj <<>> stream\nnothing\nendstream\n2 0 obj <</Filter/FlateDecode>> stream\r\n" + zlib.compress(cii) + b"\r\nendstream\n%%EOF")
    (folder / "b.pdf").write_bytes(b"%PDF-1.7\n%%EOF")
    assert [tuple(r)[1:5] for r in einvoice.read_cii(spark, str(folder)).collect()] == [(1, "N", Decimal(-3), Decimal(-9))]
    assert {(r.number, r.refused is None) for r in einvoice.cii_headers(spark, str(folder)).collect()} == {("7", True), (None, False)}


def test_text_rows_keep_every_column_and_quoted_breaks(spark, tmp_path):
    wide = ";".join(f"c{i}" for i in range(70))
    (tmp_path / "w.csv").write_bytes(("﻿" + wide + '\r\n"a\nb";"say ""x""";;;' + "\r\n\r\nlast").encode())
    (tmp_path / "l.csv").write_bytes("café;€".encode("cp1252"))
    got = {(r.file.rpartition("/")[2], r.row): r.cells for r in sheets.text_rows(spark, str(tmp_path)).collect()}
    assert got["w.csv", 1] == wide.split(";") and got["w.csv", 2] == ["a\nb", 'say "x"', None, None, None] and got["w.csv", 4] == ["last"]
    assert got["l.csv", 1] == ["café", "€"] and len(got) == 5


def test_a_cell_far_to_the_right_is_kept(spark, tmp_path):
    book(tmp_path / "far.xlsx", [("S", '<row r="1"><c r="ZZ1" t="str"><v>far</v></c></row>')])
    (r,) = sheets.workbook_rows(spark, str(tmp_path / "far.xlsx")).collect()
    assert len(r.cells) == 702 and r.cells[-1] == "far"
