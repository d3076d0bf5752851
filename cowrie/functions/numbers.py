"""Numbers and money as Column expressions; amounts are whole units (BIGINT)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of written amounts.
CURRENCY_PREFIX = r"(?i)^\s*(?:fcfa|xaf|cfa)\s*"
CURRENCY_SUFFIX = r"(?i)\s*(?:f\s*cfa|fcfa|xaf|cfa|frs?|f)\.?\s*$"
THOUSANDS_K = r"(?i)^(\d+)(?:[.,](\d+))?\s*k(\d*)$"
GROUPED = r"^\d{1,3}(?:[ .,]\d{3})+$"
DECIMAL = r"^\d+[.,]\d{1,2}$"
WHOLE = r"^\d+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def half_up(c: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity; without digits the result is a whole number."""
    if not digits:
        return F.floor(c + F.lit(0.5)).cast("long")
    f = float(10**digits)
    return F.floor(c * f + 0.5) / f


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))


def plain_spaces(c: Column) -> Column:
    """No-break and narrow no-break spaces as plain ones."""
    return F.translate(c, "  ", "  ")


def parse_amount(text: Column) -> Column:
    """A written amount as BIGINT; null for what is not clearly an amount.

    Digits may be grouped by spaces, dots or commas, end in cents, bear a currency
    before or behind, or count thousands ("7k", "1,2k", "1k2"). Null and empty
    texts and amounts beyond 18 digits give null.
    """
    bare = F.regexp_replace(F.trim(plain_spaces(text)), CURRENCY_PREFIX, "")

    def read(s: Column) -> Column:
        group = lambda i: F.nullif(F.regexp_extract(s, THOUSANDS_K, i), F.lit(""))
        fraction = F.coalesce(group(2), group(3), F.lit("0"))
        thousands = F.concat(group(1), F.lit("."), fraction).try_cast("double") * 1000
        return (
            F.when(s.rlike(THOUSANDS_K), half_up(thousands))
            .when(s.rlike(GROUPED), F.regexp_replace(s, "[ .,]", "").try_cast("long"))
            .when(s.rlike(DECIMAL), half_up(F.translate(s, ",", ".").try_cast("double")))
            .when(s.rlike(WHOLE), s.try_cast("long"))
        )

    return let(F.trim(F.regexp_replace(bare, CURRENCY_SUFFIX, "")), read)


def group_thousands(n: Column) -> Column:
    """Space-grouped digits; the sign is kept."""
    return F.regexp_replace(n.cast("string"), r"\B(?=(\d{3})+(?!\d))", " ")


def normalize_confidence(c: Column) -> Column:
    """0 to 1 with two decimals; percentages are scaled, null and non-positive values give 0.5."""
    sound = c.isNotNull() & ~F.isnan(c) & (c > 0) & (F.abs(c) != float("inf"))
    scaled = F.when((c > 1) & (c <= 100), c / 100).otherwise(c)
    return F.when(sound, half_up(clamp(scaled, 0.0, 1.0), 2)).otherwise(F.lit(0.5))


def normalize_box(box: Column) -> Column:
    """[top, left, bottom, right] in thousandths, ordered; null if not four finite numbers or too thin."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    sound = (F.size(box) == 4) & F.forall(box, finite)
    unit = F.forall(box, lambda v: (v >= 0) & (v <= 1.5))
    scale = F.when(unit, F.lit(1000.0)).otherwise(F.lit(1.0))
    at = lambda i: clamp(half_up(F.get(box, i) * scale), 0, 1000).cast("int")
    top, bottom = F.least(at(0), at(2)), F.greatest(at(0), at(2))
    left, right = F.least(at(1), at(3)), F.greatest(at(1), at(3))
    wide = (bottom - top >= 2) & (right - left >= 2)
    return F.when(sound, F.when(wide, F.array(top, left, bottom, right)))


def quantile(values: Column, q: float) -> Column:
    """Aggregate: the quantile with linear interpolation; 0 without values."""
    return F.coalesce(F.percentile(values, F.lit(q)), F.lit(0.0))


def variation(values: Column) -> Column:
    """Aggregate: population standard deviation over mean; 0 unless the mean is positive."""
    return F.when(F.avg(values) > 0, F.stddev_pop(values) / F.avg(values)).otherwise(F.lit(0.0))
