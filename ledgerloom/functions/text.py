"""Text columns: folds, signatures, identifiers, sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources.ship import ship


def _accented() -> tuple[str, str]:
    """Every Latin letter with marks that Unicode composes in one character, and the letter without them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


ACCENTED, PLAIN = _accented()


def search_key(text: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or stand behind it."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"[\u0300-\u036F]", "")


def ocr_fold(text: Column) -> Column:
    """Upper-case letters and digits only."""
    return F.regexp_replace(F.upper(search_key(text)), r"[^A-Z0-9]", "")


def name_words(text: Column) -> Column:
    """Upper-case words of at least three letters."""
    return F.regexp_extract_all(F.upper(search_key(text)), F.lit(r"[A-Z]{3,}"), F.lit(0))


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence: a bit for each letter of ``a``, cleared once it is used."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = free = (1 << len(a)) - 1
    for c in b:
        used = free & places.get(c, 0)
        free = ((free + used) | (free - used)) & full
    return len(a) - free.bit_count()


def _common(a: Column, b: Column) -> Column:
    """``common_letters`` of two texts, an Arrow batch at a time; a null has none in common."""
    ship(SparkSession.active())

    @F.pandas_udf("int")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([common_letters(p or "", q or "") for p, q in zip(x, y, strict=True)], dtype="int32")

    return of(a, b)


def likeness(a: Column, b: Column) -> Column:
    """0 to 100: the letters that two names have in common, in order, of all; the better of as written and with words sorted."""
    clean = lambda x: F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", " "))
    sorted_ = lambda x: F.array_join(F.array_sort(F.split(clean(x), r"\s+")), " ")
    share = lambda x, y: F.when((F.length(x) > 0) & (F.length(y) > 0), F.lit(200.0) * _common(x, y) / (F.length(x) + F.length(y))).otherwise(0.0)
    return F.when(clean(a) == clean(b), F.when(clean(a) == "", 0.0).otherwise(100.0)).otherwise(F.greatest(share(clean(a), clean(b)), share(sorted_(a), sorted_(b))))


def numeric_signature(text: Column) -> Column:
    """The numbers in a name, sorted, without zeros that say nothing and with one kind of decimal mark."""
    numbers = F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))
    plain = F.transform(numbers, lambda x: F.regexp_replace(F.translate(x, ",", "."), r"^0+(?=\d)", ""))
    return F.array_sort(F.transform(plain, lambda x: F.when(x.contains("."), F.regexp_replace(x, r"\.?0+$", "")).otherwise(x)))


def luhn_candidates(text: Column, digits: int = 9) -> Column:
    """Runs of exactly ``digits`` digits that pass the Luhn check."""
    runs = F.regexp_extract_all(text, F.lit(rf"(?<!\d)\d{{{digits}}}(?!\d)"), F.lit(0))
    return F.array_distinct(F.filter(runs, lambda x: F.call_function("luhn_check", x)))


#: How documents print company numbers, phones and web sites.
COMPANY_LABEL = r"(?i)\b(?:siren|siret|rcs)\b"
VAT_NUMBER = r"(?<![A-Za-z0-9])FR ?[0-9A-Z]{2} ?\d{3} ?\d{3} ?\d{3}(?!\d)"
DIGIT_RUN = r"(?<![\d,.])\d(?:[ \u00A0]?\d){8,}(?!\d|[.,]\d)"
PHONE = r"(?<!\d)(?<!\d[.,])(?:\+33 ?(?:\(0\) ?)?|0)[1-9]([ .-]?)\d{2}(?:\1\d{2}){3}(?!\d|[.,]\d)"
WEB = (
    r"(?i)(?<![\w@.-])(?:https?://)?www\.((?:[a-z0-9-]+\.)+[a-z]{2,})(?![\w@-])",
    r"(?i)(?<![\w@.-])https?://((?:[a-z0-9-]+\.)+[a-z]{2,})(?![\w@-])",
    r"(?i)(?<![\w@.-])((?:[a-z0-9-]+\.)*[a-z][a-z0-9-]{2,}\.(?:fr|com|net|org|eu|shop|paris|biz|info|io))(?![\w@-]|\.\w)",
)


def identifiers(text: Column) -> Column:
    """What a text prints that can name its sender, each once and checked as it is built: ``siren:`` (from a VAT number, a SIRET, or
    nine digits on a line that says what they are), ``tel:`` and ``web:``."""
    every = lambda x, pattern, group=0: F.regexp_extract_all(x, F.lit(pattern), F.lit(group))
    digits = lambda values: F.transform(values, lambda x: F.translate(x, " \u00A0.-+()", ""))
    luhn = lambda x: F.call_function("luhn_check", x)
    # No pattern reaches over the end of a line, so each reads the text once; what it cannot do without is looked for first.
    having = lambda found, values: F.when(found, values).otherwise(F.array().cast("array<string>"))

    def company(x: Column) -> Column:
        x = F.translate(x, " ", "")
        key, number = F.substring(x, 3, 2), F.substring(x, 5, 9)
        return F.when(F.when(key.rlike(r"^\d\d$"), key == vat_key(number)).otherwise(luhn(number)), number)

    def establishment(x: Column) -> Column:
        head = F.substring(x, 1, 9)
        return F.when((F.length(x) == 14) & luhn(x) & luhn(head), head)

    def national(x: Column) -> Column:
        return F.when(x.startswith("33"), F.concat(F.lit("0"), F.regexp_replace(F.substring(x, 3, 20), "^0", ""))).otherwise(x)

    # Nine digits count on a line that says what they are.
    lines = F.filter(F.split(text, r"[\r\n]+"), lambda line: line.rlike(COMPANY_LABEL))
    labelled = having(text.rlike(COMPANY_LABEL), F.flatten(F.transform(lines, lambda line: every(line, DIGIT_RUN))))
    phones = F.transform(digits(having(text.contains("0") | text.contains("+33"), every(text, PHONE))), national)
    site = lambda mark, pattern: having(F.lower(text).contains(mark), every(text, pattern, 1))
    sites = F.concat(*(site(mark, p) for mark, p in zip(("www.", "://", "."), WEB, strict=True)))
    said = lambda kind, values: F.transform(values, lambda x: F.concat(F.lit(f"{kind}:"), x))
    found = F.concat(
        said("siren", F.transform(having(text.contains("FR"), every(text, VAT_NUMBER)), company)), said("siren", F.transform(digits(every(text, DIGIT_RUN)), establishment)),
        said("siren", F.filter(digits(labelled), lambda x: (F.length(x) == 9) & luhn(x))), said("tel", F.filter(phones, lambda x: F.length(x) == 10)), said("web", F.transform(sites, lambda x: F.regexp_replace(F.lower(x), r"^www\.", ""))),
    )
    return F.array_distinct(F.array_compact(found))


def vat_key(siren: Column) -> Column:
    """The two check digits of a French VAT number."""
    return F.lpad(((12 + 3 * (siren.cast("long") % 97)) % 97).cast("string"), 2, "0")


#: Units that a size can have, with what they are in the base unit.
SIZE_UNITS = {"CL": ("l", "0.01"), "ML": ("l", "0.001"), "L": ("l", "1"), "KG": ("kg", "1"), "G": ("kg", "0.001")}


def size_of(text: Column) -> Column:
    """struct(quantity, unit, times) of a name like ``6X33CL`` or ``70CL``; null if it has none."""
    pattern = r"(?:(\d+)\s*X\s*)?(\d+(?:[.,]\d+)?)\s*(CL|ML|KG|L|G)(?![A-Z])"
    up = F.upper(text)
    times = F.coalesce(F.nullif(F.regexp_extract(up, pattern, 1), F.lit("")).cast("int"), F.lit(1))
    amount = F.translate(F.nullif(F.regexp_extract(up, pattern, 2), F.lit("")), ",", ".").cast("decimal(12,4)")
    unit = F.regexp_extract(up, pattern, 3)
    factor, base = F.lit(None), F.lit(None)
    for name, (to, by) in SIZE_UNITS.items():
        factor = F.when(unit == name, F.lit(by).cast("decimal(6,3)")).otherwise(factor)
        base = F.when(unit == name, F.lit(to)).otherwise(base)
    return F.when(unit != "", F.struct((amount * factor).cast("decimal(12,4)").alias("quantity"), base.alias("unit"), times.alias("times")))


def is_gtin(code: Column) -> Column:
    """8, 12, 13 or 14 digits whose last makes the weighted sum, 3 and 1 in turn from the right, a multiple of ten."""
    weighted = F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0), lambda a, i: a + F.substring(F.reverse(code), i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1))
    return F.when(code.rlike(r"^(\d{8}|\d{12,14})$"), weighted % 10 == 0).otherwise(False)


def without_sizes(text: Column) -> Column:
    """A name without its sizes, pack sizes and counts, which the size column already has."""
    size = r"(?:CL|ML|KG|L|G)(?![A-Z])"
    number = r"\d+(?:[.,]\d+)?"
    up = F.upper(F.trim(text))
    for pattern in (rf"\b\d+\s*X\s*{number}\s*{size}", rf"\b{number}\s*{size}\s*X\s*\d+\b", rf"\b{number}\s*{size}", r"\bX\s*\d+\b", r"\s\d+$"):
        up = F.regexp_replace(up, pattern, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(up, r"\s+", " ")), r"^[,.\-/]+\s*|\s*[,.\-/]+$", ""), r"\s+", " "))


def spelled(text: Column, known: dict[str, str]) -> Column:
    """The known spelling of a word, accents and case aside; another as it is printed."""
    key = search_key(F.trim(text))
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    return F.coalesce(F.try_element_at(table, key), F.trim(text))


def is_blank(json: Column) -> Column:
    """Whether JSON text holds nothing: "", [], {} or null, or is no JSON; 0 and false are values."""
    return F.coalesce(F.to_json(F.try_parse_json(json)), F.lit("null")).isin("null", '""', "[]", "{}")
