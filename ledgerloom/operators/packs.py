"""What one unit bought is worth in stock: sizes and counts read from names, held against what the invoice line says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Units, can formats, and how names print sizes, counts, dimensions and lengths.
VOLUMES = {"ML": "0.001", "CL": "0.01", "L": "1"}
WEIGHTS = {"MG": "0.000001", "GRS": "0.001", "GR": "0.001", "G": "0.001", "KG": "1"}
CANS = {"1/8": "0.125", "1/4": "0.2", "1/2": "0.4", "1/1": "0.85", "4/4": "0.85", "3/1": "2.5", "5/1": "4.25", "10/1": "10"}
UNITS, LENGTHS, NO_COUNT = "ML|CL|KG|MG|GRS|GR|G|L", "MM|CM|M", "ML|CL|KG|MG|GRS|GR|MM|CM"
WEIGHT_SAID, VOLUME_SAID = r"(?<![A-Z])(KG|GRS?|MG|G)\b", r"(?<![A-Z])(CL|ML|L)\b"
BRANDS = r"^(?:MPRO|ARO|MC|ROCH|RIOBA)\b\s*"
DIMENSION = rf"(?<![A-Z0-9.,])\d+(?:[.,]\d+)?X\d+(?:[.,]\d+)?(?:X\d+(?:[.,]\d+)?)?(?:{LENGTHS})?(?![A-Z0-9.,])"
LENGTH = rf"(?<!\d)(\d+(?:[.,]\d+)?)\s*({LENGTHS})\b"
SIZE_BY_COUNT = rf"(\d+(?:[.,]\d+)?)({UNITS})X(\d+)\b"
COUNT_BY_SIZE = rf"(?<![A-Z0-9.,])(\d+)X(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
SIZE_BY_COUNT_SPACED = rf"(\d+(?:[.,]\d+)?)\s*({UNITS})\s*X\s*(\d+)\b"
SIZE = rf"(?<!\d)(\d+(?:[.,]\d+)?)\s*({UNITS})\b"
COUNT_AT_END, COUNT_INSIDE, COUNT_IN_WORD = r"(?<=\s)X(\d+)\s*$", r"(?<=\s)X\s*\d+(?=\s|$)", r"(\d+)([A-Z]{2,})\s*$"
COUNT_FIRST, COUNT_FIRST_SPACED = r"^(\d+)\s*(?=[A-Z])", r"^(\d+)\s+(?=[A-Z])"
CAN = r"\b(1/8|1/4|1/2|1/1|4/4|3/1|5/1|10/1)\b"
ABOUT, ABOUT_FUSED = r"\bENV\b", r"(?<=[A-Z0-9])ENV"
CONTAINER = r"(?<!LAVE[ -])\b(VERRES?|VAP|GOB(?:ELETS?)?|TASSES?|MUGS?|BOLS?|DISTRIB\w*)\b"
SMALL, MOST_COUNT = "0.33", 1000

SIZED = "decimal(18,6)"


def _value(text: Column) -> Column:
    return F.translate(F.nullif(text, F.lit("")), ",", ".").try_cast(SIZED)


def _masked(name: Column, pattern: str) -> Column:
    """``name`` with blanks over the first match."""
    hit = F.regexp_substr(name, F.lit(pattern))
    return F.when(hit.isNull(), name).otherwise(F.overlay(name, F.repeat(F.lit(" "), F.length(hit)), F.regexp_instr(name, F.lit(pattern))))


def _table(values: dict[str, str], key: Column) -> Column:
    out = F.lit(None).cast(SIZED)
    for name, value in values.items():
        out = F.when(key == name, F.lit(value).cast(SIZED)).otherwise(out)
    return out


def pack_equivalents(lines: DataFrame, one: Column | None = None, poured: Column | None = None) -> DataFrame:
    """``lines`` (id, name, pack, quantity, total_volume) -> id, unit, equivalent, confidence, approx, stock_unit.

    A measured volume of the line is believed, but small bottles and containers are counted. Else the name is read from its
    clearest marks to its vaguest, each covered with blanks once read; a count in it matters only where the invoice's pack is 1 and
    the quantity is not that count already. ``one``: rows that are one unit whatever they say; ``poured``: rows that are never
    counted by the bottle. Every step is a projection of its own, so that each pattern runs once.
    """
    one, poured = F.lit(False) if one is None else one, F.lit(False) if poured is None else poured
    name, w = F.regexp_replace(F.upper(F.coalesce("name", F.lit(""))), ABOUT_FUSED, " ENV "), F.col("w")
    size, unit, count = F.col("size"), F.col("size_unit"), F.col("count")
    part = lambda pattern, i: F.regexp_extract(w, pattern, i)
    number = lambda pattern, i=1: F.nullif(part(pattern, i), F.lit("")).try_cast("int")
    rows = lines.select("id", "pack", "quantity", F.col("total_volume").cast(SIZED).alias("volume"), one.alias("one"), poured.alias("poured"), name.alias("name"), name.alias("w"))
    rows = rows.withColumns({"container": w.rlike(CONTAINER), "approx": w.rlike(ABOUT)})
    rows = rows.withColumns({"size": _value(part(SIZE_BY_COUNT, 1)), "size_unit": F.nullif(part(SIZE_BY_COUNT, 2), F.lit("")), "count": number(SIZE_BY_COUNT, 3), "w": _masked(w, SIZE_BY_COUNT)})
    rows = rows.withColumns({"open": size.isNull(), "hit": part(COUNT_BY_SIZE, 0) != ""})
    now = F.col("open") & F.col("hit")
    rows = rows.withColumns({"size": F.when(now, _value(part(COUNT_BY_SIZE, 2))).otherwise(size), "size_unit": F.when(now, part(COUNT_BY_SIZE, 3)).otherwise(unit), "count": F.when(now, number(COUNT_BY_SIZE)).otherwise(count), "w": F.when(now, _masked(w, COUNT_BY_SIZE)).otherwise(w)})
    rows = rows.withColumn("w", F.regexp_replace(F.regexp_replace(w, DIMENSION, " "), LENGTH, " "))
    rows = rows.withColumns({"count": F.coalesce(count, number(COUNT_AT_END)), "w": F.when(count.isNull(), _masked(w, COUNT_AT_END)).otherwise(w)})
    fused = count.isNull() & (part(COUNT_IN_WORD, 0) != "") & ~part(COUNT_IN_WORD, 2).isin(NO_COUNT.split("|"))
    rows = rows.withColumns({"count": F.when(fused, number(COUNT_IN_WORD)).otherwise(count), "w": F.when(fused, _masked(w, COUNT_IN_WORD)).otherwise(w)})
    can = size.isNull() & (part(CAN, 1) != "")
    rows = rows.withColumns({"size": F.when(can, _table(CANS, part(CAN, 1))).otherwise(size), "size_unit": F.when(can, "KG").otherwise(unit), "approx": F.col("approx") | can, "w": F.when(can, _masked(w, CAN)).otherwise(w)})
    plain = size.isNull() & (part(SIZE, 0) != "")
    rows = rows.withColumns({"size": F.when(plain, _value(part(SIZE, 1))).otherwise(size), "size_unit": F.when(plain, part(SIZE, 2)).otherwise(unit), "w": F.when(plain, _masked(w, SIZE)).otherwise(w)})
    rows = rows.withColumns({"w": F.regexp_replace(F.trim(w), BRANDS, ""), "branded": F.trim(w).rlike(BRANDS)})
    rows = rows.withColumn("count", F.coalesce(count, F.when(F.col("branded"), number(COUNT_FIRST)).otherwise(number(COUNT_FIRST_SPACED))))
    rows = rows.withColumn("count", F.when(count < MOST_COUNT, count))

    # What the line itself measured.
    said = lambda pattern, i: F.nullif(F.regexp_extract("name", pattern, i), F.lit("")).try_cast("int")
    inside, small = F.coalesce(said(COUNT_BY_SIZE, 1), said(SIZE_BY_COUNT_SPACED, 3)), F.lit(SMALL).cast(SIZED)
    volume, bottles = F.col("volume"), F.when((F.col("pack") == 1) & inside.isNotNull(), inside).otherwise(F.col("quantity"))
    weighed = F.col("name").rlike(WEIGHT_SAID) & ~F.col("name").rlike(VOLUME_SAID)
    counted = ~F.col("weighed") & (F.col("quantity") != 0) & ~F.col("poured") & ((F.try_divide(volume, F.col("bottles")) <= small) | F.col("container"))
    rows = rows.withColumns({"weighed": weighed, "bottles": bottles, "measured": F.coalesce(volume != 0, F.lit(False)), "is_volume": unit.isin(list(VOLUMES)), "base": (size * _table(VOLUMES | WEIGHTS, unit)).cast(SIZED)})
    guess = lambda u, e, c, s="UNIT": F.struct(*((x if isinstance(x, Column) else F.lit(x)).alias(n) for n, x in (("unit", u), ("equivalent", (e if isinstance(e, Column) else F.lit(e)).cast(SIZED)), ("confidence", c), ("stock_unit", s))))
    kind = F.when(F.col("is_volume"), "L").otherwise("KG")
    in_pack = (F.col("pack") != 1) | (count == F.col("quantity"))
    extra = count.isNotNull() & ~in_pack
    measured = F.when(counted, guess("UNIT", 1, "high")).otherwise(guess(F.when(F.col("weighed"), "KG").otherwise("L"), 1, "high", F.when(F.col("weighed"), "KG").otherwise("L")))
    sized = (
        F.when((F.col("pack") != 1) & (size == F.col("pack")), guess(kind, 1, "high", kind)).when(extra, guess("UNIT", count, "medium"))
        .when(~F.col("poured") & F.col("is_volume") & ((F.col("base") <= small) | F.col("container")), guess("UNIT", 1, "high")).otherwise(guess("UNIT", F.col("base"), F.when(F.col("approx"), "medium").otherwise("high"), kind))
    )
    read = F.when(size.isNotNull(), sized).when(extra, guess("UNIT", count, "medium")).when(count.isNotNull(), guess("UNIT", 1, "high")).otherwise(guess("UNIT", 1, "low"))
    out = rows.withColumn("guess", F.when(F.col("one"), guess("UNIT", 1, "high")).when(F.col("measured"), measured).otherwise(read))
    # A measured line says nothing of about; neither does one that its pack explains.
    about = F.col("approx") & ~F.col("one") & ~F.col("measured") & ~F.coalesce((F.col("pack") != 1) & (size == F.col("pack")), F.lit(False))
    return out.select("id", "guess.unit", "guess.equivalent", "guess.confidence", about.alias("approx"), "guess.stock_unit")


def without_packs(text: Column) -> Column:
    """A name without the sizes, counts, dimensions and house brands that ``pack_equivalents`` reads."""
    up = F.upper(F.trim(text))
    x = F.regexp_replace(F.regexp_replace(up, BRANDS, ""), ABOUT_FUSED, " ENV ")
    ends = rf"\d+(?!(?:{NO_COUNT})\s*$)[A-Z]{{2,}}\s*$"
    for pattern in (SIZE_BY_COUNT, COUNT_BY_SIZE, DIMENSION, LENGTH, ends, COUNT_AT_END, CAN, SIZE, COUNT_INSIDE, ABOUT):
        x = F.regexp_replace(x, pattern, " ")
    x = F.when(up.rlike(BRANDS), F.regexp_replace(x, r"^\d{1,3}\s*(?=[A-Z])", " ")).otherwise(F.regexp_replace(x, r"^\d{1,3}\s+(?=[A-Z])", " "))
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s+", " ")), r"^[,.\-/]+\s*|\s*[,.\-/]+$", ""), r"\s+", " "))
