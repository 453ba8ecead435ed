"""Bank statements and till exports as DataFrames: described CSV, CAMT XML, OFX; kinds told from the first bytes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerloom.functions.money import number
from ledgerloom.functions.parse import day as read_day


@dataclass(frozen=True)
class Layout:
    """Where a file's columns are, by number from 0: one signed amount, or a debit and a credit column."""

    day: int
    label: int
    amount: int | None = None
    debit: int | None = None
    credit: int | None = None
    separator: str = ";"
    encoding: str = "UTF-8"
    order: str = "dmy"
    skip: int = 0
    columns: int = 0
    extra: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if (self.amount is None) == (self.debit is None or self.credit is None):
            raise ValueError("either one amount column or both a debit and a credit column")


#: What Windows-1252 has where ISO-8859-1 has control characters.
WESTERN = bytes(i for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)).decode("cp1252")
C1 = "".join(chr(i) for i in range(0x80, 0xA0) if i not in (0x81, 0x8D, 0x8F, 0x90, 0x9D))


def sniff(content: Column) -> Column:
    """ofx, camt, xml or csv, by a file's first bytes."""
    head = F.lower(F.decode(F.substring(content, 1, 512), "ISO-8859-1"))
    return F.when(head.contains("ofxheader") | head.contains("<ofx>"), "ofx").when(head.contains("camt.05"), "camt").when(F.ltrim(head).startswith("<") | head.contains("<?xml"), "xml").otherwise("csv")


def encoding_of(content: Column) -> Column:
    """UTF-16 by its mark, UTF-8 where it reads as that, else Windows-1252."""
    mark = F.hex(F.substring(content, 1, 2))
    return F.when(mark.isin("FFFE", "FEFF"), "UTF-16").when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, kind and encoding of every file in a folder: only these bytes decide."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select("path", "length", sniff(F.col("content")).alias("kind"), encoding_of(F.col("content")).alias("encoding"))


def read_csv(spark: SparkSession, path: str, layout: Layout) -> DataFrame:
    """Lines of described CSV files: file, day, label, amount, refused (why a line does not read, null if it does).

    Files are split and read in parallel; a header or a total is a line whose day does not read, and is refused like any other.
    """
    last = max(layout.columns - 1, *(x for x in (layout.day, layout.label, layout.amount, layout.debit, layout.credit, *layout.extra.values()) if x is not None))
    schema = ", ".join(f"c{i} string" for i in range(last + 1))
    western = layout.encoding.lower() in ("windows-1252", "cp1252")
    rows = spark.read.schema(schema).option("sep", layout.separator).option("encoding", "ISO-8859-1" if western else layout.encoding).option("mode", "PERMISSIVE").csv(path)
    if western:
        rows = rows.select(*(F.translate(c, C1, WESTERN).alias(c) for c in rows.columns), F.col("_metadata.file_path").alias("file"))
    else:
        rows = rows.select("*", F.col("_metadata.file_path").alias("file"))
    when = read_day(F.col(f"c{layout.day}"), layout.order)
    if layout.amount is not None:
        amount = number(F.col(f"c{layout.amount}"))
    else:
        debit, credit = (number(F.col(f"c{i}")) for i in (layout.debit, layout.credit))
        amount = F.when(debit.isNotNull() | credit.isNotNull(), F.coalesce(credit, F.lit(0)) - F.abs(F.coalesce(debit, F.lit(0))))
    refused = F.when(when.isNull(), "day").when(amount.isNull(), "amount")
    return rows.select("file", when.alias("day"), F.trim(f"c{layout.label}").alias("label"), amount.cast("decimal(12,2)").alias("amount"), refused.alias("refused"), *(F.trim(f"c{i}").alias(n) for n, i in layout.extra.items()))


def read_camt(spark: SparkSession, path: str) -> DataFrame:
    """Entries of CAMT.053 files: day, label, amount (signed), currency."""
    schema = "Amt struct<_VALUE: string, _Ccy: string>, CdtDbtInd string, BookgDt struct<Dt: string>, AddtlNtryInf string"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "Ntry").load(path)
    amount = F.col("Amt._VALUE").try_cast("decimal(12,2)")
    return rows.select(F.col("BookgDt.Dt").try_cast("date").alias("day"), F.trim("AddtlNtryInf").alias("label"), F.when(F.col("CdtDbtInd") == "DBIT", -amount).otherwise(amount).cast("decimal(12,2)").alias("amount"), F.col("Amt._Ccy").alias("currency"))


def read_ofx(spark: SparkSession, path: str) -> DataFrame:
    """Transactions of OFX files, with or without closing tags: file, day, label, amount, fitid."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parts = text.select("file", F.explode(F.filter(F.split("value", r"(?i)<STMTTRN>"), lambda x, i: i > 0)).alias("x"))
    tag = lambda name: F.trim(F.regexp_extract("x", rf"(?i)<{name}>([^<\r\n]*)", 1))
    return parts.select("file", F.try_to_date(F.substring(tag("DTPOSTED"), 1, 8), "yyyyMMdd").alias("day"), F.coalesce(F.nullif(tag("NAME"), F.lit("")), tag("MEMO")).alias("label"), F.translate(tag("TRNAMT"), ",", ".").try_cast("decimal(12,2)").alias("amount"), tag("FITID").alias("fitid"))


def fingerprints(rows: DataFrame, account: str) -> DataFrame:
    """``rows`` (file, day, label, amount) with the fingerprint that makes an import idempotent: the fields, and the rank
    among identical lines of one file."""
    same = Window.partitionBy("file", "day", "label", "amount").orderBy(F.lit(0))
    rows = rows.withColumn("occurrence", F.row_number().over(same) - 1)
    text = F.concat_ws("|", F.lit(account), F.col("day").cast("string"), F.lit(""), "label", F.col("amount").cast("string"), F.col("occurrence").cast("string"))
    return rows.withColumn("fingerprint", F.sha2(text, 256))


def unseen(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Only what is not known yet, each fingerprint once: running an import again adds nothing."""
    return rows.join(known.select("fingerprint"), "fingerprint", "left_anti").dropDuplicates(["fingerprint"])
