"""Readers of files, archives, parsing of cells."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import parse
from ledgerloom.operators import invoices, names
from ledgerloom.sources import archive, einvoice, statements
from ledgerloom.streaming import till


def test_bank_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Date;Libellé;Débit;Crédit\n02/01/2024;CARTE X;1 234,50;\n03/01/24;VIR;;10,00\nTotal;;1;2\n03/01/2024;BAD;x;\n", encoding="cp1252")
    rows = statements.read_csv(spark, str(tmp_path), statements.Layout(day=0, label=1, debit=2, credit=3, encoding="windows-1252")).collect()
    good = [(r.day, r.label, r.amount) for r in rows if r.refused is None]
    assert good == [(date(2024, 1, 2), "CARTE X", Decimal("-1234.50")), (date(2024, 1, 3), "VIR", Decimal("10.00"))]
    assert sorted(r.refused for r in rows if r.refused) == ["amount", "day", "day"]
    with pytest.raises(ValueError):
        statements.Layout(day=0, label=1)


def test_sniff_and_encoding(spark):
    df = spark.createDataFrame([(b"OFXHEADER:100\n",), (b'<?xml version="1.0"?><Document xmlns="urn:iso:camt.053">',), (b"<a/>",), (b"a;b\xe9",), ("a;é".encode("utf-16"),)], "content binary")
    got = [(r.k, r.e) for r in df.select(statements.sniff(F.col("content")).alias("k"), statements.encoding_of(F.col("content")).alias("e")).collect()]
    assert [k for k, _ in got[:4]] == ["ofx", "camt", "xml", "csv"] and [e for _, e in got] == ["UTF-8", "UTF-8", "UTF-8", "windows-1252", "UTF-16"]


def test_camt_and_ofx(spark, tmp_path):
    camt = tmp_path / "c.xml"
    camt.write_text('<Document><Ntry><Amt Ccy="EUR">12.50</Amt><CdtDbtInd>DBIT</CdtDbtInd><BookgDt><Dt>2024-03-01</Dt></BookgDt><AddtlNtryInf>SHOP</AddtlNtryInf></Ntry><Ntry><Amt Ccy="EUR">3</Amt><CdtDbtInd>CRDT</CdtDbtInd><BookgDt><Dt>2024-03-02</Dt></BookgDt><AddtlNtryInf>IN</AddtlNtryInf></Ntry></Document>')
    assert [(r.day, r.label, r.amount) for r in statements.read_camt(spark, str(camt)).collect()] == [(date(2024, 3, 1), "SHOP", Decimal("-12.50")), (date(2024, 3, 2), "IN", Decimal("3.00"))]
    ofx = tmp_path / "o.ofx"
    ofx.write_text("<OFX><STMTTRN>\n<DTPOSTED>20240105120000\n<TRNAMT>-4,50\n<FITID>1\n<NAME>BAR\n</STMTTRN><STMTTRN><DTPOSTED>20240106<TRNAMT>7<FITID>2<MEMO>M</STMTTRN></OFX>")
    rows = statements.read_ofx(spark, str(ofx))
    assert [(r.day, r.label, r.amount, r.fitid) for r in rows.collect()] == [(date(2024, 1, 5), "BAR", Decimal("-4.50"), "1"), (date(2024, 1, 6), "M", Decimal("7.00"), "2")]
    twice = statements.fingerprints(rows.unionByName(rows), "acc")
    assert twice.select("fingerprint").distinct().count() == 4 and statements.unseen(twice, statements.fingerprints(rows, "acc")).count() == 2


def test_einvoices(spark, tmp_path):
    (tmp_path / "u.xml").write_text("<Invoice><cac:InvoiceLine><cbc:ID>1</cbc:ID><cbc:InvoicedQuantity unitCode='C62'>2</cbc:InvoicedQuantity><cbc:LineExtensionAmount currencyID='EUR'>10.00</cbc:LineExtensionAmount><cac:Item><cbc:Name>Gin</cbc:Name><cbc:Percent>20</cbc:Percent></cac:Item></cac:InvoiceLine></Invoice>")
    r = einvoice.read_ubl(spark, str(tmp_path / "u.xml")).first()
    assert (r.number, r.name, r.quantity, r.ht, r.vat) == (1, "Gin", Decimal("2.000"), Decimal("10.00"), Decimal("0.2000"))
    (tmp_path / "c.xml").write_text("<x><ram:IncludedSupplyChainTradeLineItem><ram:LineID>3</ram:LineID><ram:Name>Rum</ram:Name><ram:BilledQuantity unitCode='C62'>1.5</ram:BilledQuantity><ram:RateApplicablePercent>5.5</ram:RateApplicablePercent><ram:LineTotalAmount>7</ram:LineTotalAmount></ram:IncludedSupplyChainTradeLineItem></x>")
    r = einvoice.read_cii(spark, str(tmp_path / "c.xml")).first()
    assert (r.number, r.name, r.quantity, r.ht, r.vat) == (3, "Rum", Decimal("1.500"), Decimal("7.00"), Decimal("0.0550"))


def test_archive(spark, tmp_path, data_dir):
    part = spark.read.parquet(f"{data_dir}/part.parquet")
    archive.dump({"part": part, "few": part.limit(3)}, str(tmp_path / "a"))
    got = archive.load(spark, str(tmp_path / "a"))
    assert got["part"].exceptAll(part).count() == 0 and got["few"].count() == 3
    part.limit(2).write.mode("overwrite").json(str(tmp_path / "a" / "few"))
    with pytest.raises(ValueError):
        archive.load(spark, str(tmp_path / "a"))


def test_archive_names_the_part_that_was_touched(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PART_ROWS", 10)
    rows = spark.createDataFrame([(i, f"n{i % 7}", None) for i in range(95)] + [(3, "n3", None)], "k long, name string, note string")
    archive.dump({"rows": rows, "none": rows.limit(0)}, str(tmp_path / "b"), {"rows": ["k"]})
    got = archive.load(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, got["rows"].collect())) == sorted(map(tuple, rows.collect())) and got["none"].count() == 0
    part = got["rows"].select(F.pmod(F.xxhash64(F.col("k").cast("string")), F.lit(10)).alias("p")).filter("k = 42").first().p
    rows.withColumn("name", F.when(F.col("k") == 42, "changed").otherwise(F.col("name"))).write.mode("overwrite").json(str(tmp_path / "b" / "rows"))
    with pytest.raises(ValueError, match=rf"rows: parts \[{part}\] of 10"):
        archive.load(spark, str(tmp_path / "b"))
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(str(tmp_path / "b" / "rows"))
    spark.read.schema(archive.PARTS).json(str(tmp_path / "b" / "digests" / "rows")).filter("part > 0").coalesce(1).write.json(str(tmp_path / "less"))
    (tmp_path / "b" / "digests" / "rows").rename(tmp_path / "old")
    (tmp_path / "less").rename(tmp_path / "b" / "digests" / "rows")
    with pytest.raises(ValueError, match="manifest"):
        archive.load(spark, str(tmp_path / "b"))


def test_natural_keys_and_sections(spark):
    there = archive.with_key(spark.createDataFrame([(10, "a", 1), (11, "a", 2), (12, "b", 1), (13, "c", 1), (14, "c", 1), (15, "d", 1), (16, "e", 1)], "id long, name string, at int"), ["name"], ["at"])
    here = archive.with_key(spark.createDataFrame([(20, "a", 1), (21, "a", 9), (22, "b", 5), (23, "c", 1), (24, "e", 1), (25, "e", 1)], "id long, name string, at int"), ["name"], ["at"])
    got = {r.old: (r.id, r.refused) for r in archive.resolve(there.select(F.col("id").alias("old"), "key", "rank"), here, "id").collect()}
    assert got == {10: (20, None), 11: (21, None), 12: (22, None), 13: (None, "ambiguous"), 14: (None, "ambiguous"), 15: (None, "missing"), 16: (None, "ambiguous")}
    needs = {"lines": ["invoices", "products"], "invoices": ["suppliers"], "products": ["suppliers", "articles"], "suppliers": [], "articles": [], "x": ["y"], "y": ["x"]}
    assert archive.closure(["lines"], needs) == ["suppliers", "invoices", "articles", "products", "lines"]
    for wrong in (["x"], ["z"]):
        with pytest.raises(ValueError):
            archive.closure(wrong, needs)


def test_cells(spark):
    df = spark.createDataFrame([("7h30",), ("7:5",), ("7,5",), ("8h",), ("7h75",), ("x",)], "t string")
    assert [r.h and float(r.h) for r in df.select(parse.hours(F.col("t")).alias("h")).collect()] == [7.5, pytest.approx(7.08), 7.5, 8.0, None, None]
    days = spark.createDataFrame([("31/12/99",), ("1-2-2024",), ("31/02/2024",), ("45292",), ("x",)], "t string")
    assert [r.d for r in days.select(parse.day(F.col("t")).alias("d")).collect()] == [date(1999, 12, 31), date(2024, 2, 1), None, date(2024, 1, 1), None]
    cells = spark.createDataFrame([("CB(4,50)/Cash(-2,00)",), ("CB(4,50",), ("",)], "t string")
    got = [r.p for r in cells.select(parse.payments(F.col("t")).alias("p")).collect()]
    assert [(x.method, x.amount) for x in got[0]] == [("CB", Decimal("4.50")), ("Cash", Decimal("-2.00"))] and got[1] is None and got[2] is None
    labels = spark.createDataFrame([("CARTE 28/12 X", date(2024, 1, 3)), ("CARTE 02/01", date(2024, 1, 3)), ("none", date(2024, 1, 3))], "l string, b date")
    assert [r.d for r in labels.select(parse.card_date(F.col("l"), F.col("b")).alias("d")).collect()] == [date(2023, 12, 28), date(2024, 1, 2), None]
    when = spark.createDataFrame([(date(2024, 9, 12),)], "d date")
    assert [when.filter(parse.of_partial_date(w, F.col("d"))).count() for w in ("2024", "09/2024", "12/09/2024", "08/2024", "abc", "12")] == [1, 1, 1, 0, 0, 0]


def test_names(spark):
    assert names.misread_cost("B0L7", "BOL7", 0.9) == 0.3 and names.misread_cost("BOL7", "BOL8", 3) == float("inf") and names.misread_cost("CAT", "CAR", 2) == 1
    read = spark.createDataFrame([("s", 1, "RED B0LT BIG"), ("s", 2, "RED BOLX BIG"), ("t", 3, "RED BOLT BIG")], "supplier_id string, id long, name string")
    known = spark.createDataFrame([("s", 10, "RED BOLT BIG"), ("s", 11, "BLUE RING")], "supplier_id string, id long, name string")
    assert sorted((r.read_id, r.known_id, r.cost) for r in names.misread_match(read, known).collect()) == [(1, 10, 0.3), (2, 10, 1.0)]


def test_states_and_chains(spark):
    df = spark.createDataFrame([(10, 0), (10, 4), (10, 10), (10, 12)], "due int, paid int")
    assert [r.s for r in df.select(invoices.payment_state(F.col("due"), F.col("paid")).alias("s")).collect()] == ["unpaid", "partly", "paid", "over"]
    chain = spark.createDataFrame([(i, i + 1 if i < 20 else None) for i in range(1, 21)], "id long, replaced_by long")
    assert {r.final_id for r in invoices.final_versions(chain).collect()} == {20}


def test_stream_resumes_exactly(spark, data_dir):
    once = till.drained(till.once(till.event_stream(spark, data_dir), ["event_id"]))
    assert once.count() == spark.read.parquet(f"{data_dir}/events.parquet").count()
