"""Exact-decimal money columns. Rounding is half away from zero; a ratio to nothing is null, never 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY, QUANTITY, RATE, WIDE = "decimal(12,2)", "decimal(12,3)", "decimal(5,4)", "decimal(38,6)"


def money(column: Column | str) -> Column:
    return _col(column).cast(MONEY)


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def cents(x: Column) -> Column:
    return F.round(x, 2)


def truncated(x: Column) -> Column:
    """To cents, toward zero."""
    return F.when(x < 0, -F.floor(F.abs(x), F.lit(2))).otherwise(F.floor(F.abs(x), F.lit(2)))


def vat_divisor(rate: Column) -> Column:
    """1 + rate; a rate of -100 % counts as none."""
    return F.coalesce(F.nullif(F.lit(1) + rate, F.lit(0).cast(RATE)), F.lit(1).cast(RATE))


def line_ttc(printed: Column, promotion: Column, ht: Column, rate: Column) -> Column:
    """The printed amount less its promotion, else HT with its VAT."""
    return F.coalesce(printed - F.coalesce(promotion, F.lit(0)), ht * (F.lit(1) + rate))


def cost_ht(ht: Column, is_spread_charge: Column, share: Column) -> Column:
    """What goods cost: nothing for a charge that is spread over others, else HT and its share."""
    return F.when(is_spread_charge, F.lit(0)).otherwise(ht + F.coalesce(share, F.lit(0)))


def percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part, whole) * 100


def held(value: Column, bound: Column) -> Column:
    """Between 0 and ``bound``, on the bound's own side."""
    return F.when(bound >= 0, F.greatest(F.least(value, bound), F.lit(0))).otherwise(F.least(F.greatest(value, bound), F.lit(0)))


def per_sale(amount: Column, sale_quantity: Column, yields: Column) -> Column:
    return F.try_divide(amount * sale_quantity, yields)


def loss_allowance(left_the_shelf: Column, loss_percent: Column) -> Column:
    return F.greatest(left_the_shelf, F.lit(0)) * F.least(F.greatest(loss_percent, F.lit(0)), F.lit(100)) / 100


#: Fixed value: how many times its reference a price may be, or be below it, without a doubt.
DOUBT = 10


def doubtful(per_unit: Column, reference: Column) -> Column:
    """dear or cheap, where a price for each unit consumed is far from its reference; null where either is none."""
    known = (per_unit > 0) & (reference > 0)
    return F.when(known & (per_unit > reference * DOUBT), "dear").when(known & (per_unit * DOUBT < reference), "cheap")


def number(text: Column) -> Column:
    """A number with French grouping: spaces, no-break spaces and apostrophes only as thousands; comma or point as mark."""
    shape = text.rlike(r"^\s*[+-]?(\d{1,3}([   '’]\d{3})+|\d+)([.,]\d+)?\s*$")
    return F.when(shape, F.translate(F.regexp_replace(text, r"[\s  '’]", ""), ",", ".").cast("decimal(18,4)"))


def fits(x: Column, precision: int, scale: int) -> Column:
    """Whether a value fits its column; too many digits or places do not."""
    return x.cast("string").try_cast(f"decimal({precision},{scale})").isNotNull() & (F.round(x, scale) == x)


def vat_rate(text: Column) -> Column:
    """A VAT rate printed as a percentage or a fraction, as a fraction."""
    x = number(F.regexp_replace(text, r"\s*%\s*$", ""))
    return F.when(text.rlike("%") | (x >= 1), x / 100).otherwise(x).cast(RATE)


def line_consumption(consumed: Column, quantity: Column) -> Column:
    """What a sale line took off the shelf: what it says, 0 included, else what it bills."""
    return F.coalesce(consumed, quantity)


def sale_line_total(ht: Column, rate: Column, quantity: Column, typed_price: Column, menu_price: Column) -> Column:
    """HT with its VAT where the line has one, else its quantity at the typed price or the menu's; 0 without any."""
    return F.coalesce(ht * (F.lit(1) + F.coalesce(rate, F.lit(0))), quantity * F.coalesce(typed_price, menu_price), F.lit(0))


def document_to_pay(stated: Column, payable: Column, prepaid: Column, computed: Column) -> Column:
    """What a document asks for: its own payable amount, else its total, stated or computed, less what was prepaid."""
    return F.coalesce(payable, F.coalesce(stated, cents(computed)) - F.coalesce(prepaid, F.lit(0)))


#: Type codes of electronic invoices.
CREDIT_NOTES, DEPOSIT, INVOICE = ("261", "381", "396"), "386", "380"


def kind_label(code: Column, total: Column) -> Column:
    """A credit note by its code or a total below 0, whatever else it says; then a deposit, an invoice, or the code itself."""
    return F.when(code.isin(*CREDIT_NOTES) | (total < 0), "credit note").when(code == DEPOSIT, "deposit").when(code.isin("", INVOICE), "invoice").otherwise(F.concat(F.lit("type "), code))


def base_amount(by_the_unit: Column, quantity: Column, volume: Column) -> Column:
    """What a line counts in its article's unit: pieces, or the measured volume where there is one."""
    return F.when(by_the_unit, quantity).otherwise(F.coalesce(F.nullif(volume, F.lit(0).cast(QUANTITY)), quantity))


def servings(room: Column, allowance: Column, amount: Column) -> tuple[Column, Column]:
    """Whole servings of ``amount``: up to the room, and up to the allowance too, which the last may cross; 0 where there is
    none of either."""
    fit = F.when((room > 0) & (amount > 0), F.floor(room / amount)).otherwise(0)
    return fit, F.when((allowance > 0) & (fit > 0), F.least(fit, F.ceil(allowance / amount))).otherwise(0)
