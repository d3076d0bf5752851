"""What inputs must hold, as arrays of issues; an empty array is a sound input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cowrie.functions.dates import is_iso_date
from cowrie.functions.text import is_phone, normalize_phone

# Cities that forms offer, identifiers of pages, and limits.
CITIES = (
    "Yaoundé", "Douala", "Bamenda", "Bafoussam", "Garoua", "Maroua", "Ngaoundéré", "Bertoua",
    "Ebolowa", "Kribi", "Limbe", "Buea", "Kumba", "Dschang", "Nkongsamba", "Edéa", "Foumban",
)
SOURCE_ID = r"^src_[0-9a-z]{6,24}$"
LARGEST_AMOUNT = 50_000_000
PROVIDERS = ("mtn", "orange")


def _issues(*checks: tuple[Column, str]) -> Column:
    """Names of the checks that do not hold; a check that is null does not hold."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in checks]))


def _length(c: Column, least: int, most: int, prefix: str) -> list[tuple[Column, str]]:
    n = F.length(F.trim(F.coalesce(c, F.lit(""))))
    return [(n >= least, f"{prefix}_short"), (n <= most, f"{prefix}_long")]


def _providers(c: Column) -> list[tuple[Column, str]]:
    given = F.coalesce(c, F.array().cast("array<string>"))
    return [(F.forall(given, lambda p: F.coalesce(p.isin(*PROVIDERS), F.lit(False))), "provider_unknown"), (F.size(given) <= len(PROVIDERS), "providers_many")]


def trader_issues(name: Column, business: Column, market: Column, city: Column, phone: Column, providers: Column | None = None) -> Column:
    """A phone may be absent or empty; else it has nine digits that begin with 6 or 2. Providers are two at most, none is fine."""
    sound = F.coalesce(normalize_phone(phone), F.lit("")) == ""
    return _issues(*_length(name, 2, 80, "name"), *_length(business, 2, 80, "business"), *_length(market, 2, 80, "market"), *_length(city, 2, 60, "city"), (sound | is_phone(phone), "phone_invalid"), *([] if providers is None else _providers(providers)))


def _amount(amount: Column, least: int) -> list[tuple[Column, str]]:
    return [(amount == F.floor(amount), "amount_whole"), (amount >= least, "amount_missing"), (amount <= LARGEST_AMOUNT, "amount_large")]


def patch_issues(date: Column, description: Column, amount: Column, kind: Column, status: Column) -> Column:
    """A patch of a line; null fields say nothing, an empty date clears it, and one field at least must speak."""
    absent = lambda c, checks: [(c.isNull() | ok, name) for ok, name in checks]
    some = F.coalesce(date, description, amount.cast("string"), kind, status).isNotNull()
    return _issues(
        (some, "empty_patch"),
        *absent(date, [((date == "") | date.rlike(r"^\d{4}-\d{2}-\d{2}$"), "date_invalid")]),
        *absent(description, [(F.length(F.trim(description)) > 0, "description_empty"), (F.length(F.trim(description)) <= 120, "description_long")]),
        *absent(amount, _amount(amount, 0)),
        *absent(kind, [(kind.isin("sale", "expense"), "type_unknown")]),
        *absent(status, [(status.isin("pending", "confirmed", "rejected"), "status_unknown")]),
    )


def added_line_issues(source_id: Column, date: Column, description: Column, amount: Column, kind: Column) -> Column:
    n = F.length(F.trim(F.coalesce(description, F.lit(""))))
    return _issues((source_id.rlike(SOURCE_ID), "source_invalid"), (is_iso_date(date), "date_invalid"), (n > 0, "description_empty"), (n <= 120, "description_long"), *_amount(amount, 1), (kind.isin("sale", "expense"), "type_unknown"))


def messages_issues(text: Column) -> Column:
    return _issues(*_length(text, 10, 60_000, "messages"))


def question_issues(question: Column, locale: Column) -> Column:
    """The locale may be absent."""
    return _issues(*_length(question, 3, 300, "question"), (locale.isNull() | locale.isin("en", "fr"), "locale_unknown"))


def consent_issues(granted: Column) -> Column:
    return _issues((granted.isNotNull(), "granted_missing"))


def distinct_issues(other_id: Column) -> Column:
    return _issues((other_id.rlike(SOURCE_ID), "source_invalid"))
