"""Price tags in mixed number formats, availability phrases and currencies."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcat.functions.text import literal_map
from shopcat.functions.words import AVAILABILITY, CURRENCIES

PARSED = "decimal(38,6)"
STORED = "decimal(18,2)"

# Fixed values: (decimal, grouping) separators by language; any other has those of the default.
SEPARATORS = {"en": (".", ","), "zh": (".", ","), "ja": (".", ","), "ko": (".", ","), "he": (".", ","),
              "fr": (",", "\u202f"), "ru": (",", "\u00a0"), "uk": (",", "\u00a0"), "pl": (",", "\u00a0"),
              "cs": (",", "\u00a0"), "sk": (",", "\u00a0"), "hu": (",", "\u00a0"), "bg": (",", "\u00a0"),
              "sv": (",", "\u00a0"), "nb": (",", "\u00a0"), "fi": (",", "\u00a0")}


def separators(locale: str) -> tuple[str, str]:
    """Decimal and grouping separator of a language tag such as ``ro-RO``."""
    return SEPARATORS.get(locale.replace("_", "-").split("-")[0].lower(), (",", "."))


def normalise_price(c: Column, decimal: str = ",", grouping: str = ".") -> Column:
    """Rewrite a tag so that ``decimal`` is its decimal and ``grouping`` its grouping separator.

    Without a decimal separator every ``.`` and ``,`` is read as one. With decimal separators
    only, three digits after the first make all of them grouping. With both in reversed order
    they are swapped. Separators are taken literally.
    """
    d, g = F.locate(decimal, c), F.locate(grouping, c)
    digits_after = F.substr(c, d + 1).rlike(r"^\d{3}")
    return (
        F.when(d == 0, F.translate(c, ".,", decimal * 2))
        .when((g == 0) & digits_after, F.translate(c, decimal, grouping))
        .when((g > 0) & (g > d), F.translate(c, decimal + grouping, grouping + decimal))
        .otherwise(c)
    )


def _numeric_prefix(tag: Column, decimal: str, grouping: str) -> Column:
    d, g = f"\\{decimal}", f"\\{grouping}"
    return F.regexp_extract(tag, f"^-?(?=[{g}]*{d}?\\d)[\\d{g}]*(?:{d}\\d*)?", 0)


def parse_price(tag: Column, decimal: str = ",", grouping: str = ".") -> Column:
    """Longest numeric prefix of a normalised tag; null when it does not start with a number."""
    prefix = _numeric_prefix(tag, decimal, grouping)
    plain = F.replace(F.replace(prefix, F.lit(grouping), F.lit("")), F.lit(decimal), F.lit("."))
    return F.when(prefix != "", plain.try_cast(PARSED))


def starts_with_number(c: Column, decimal: str = ",", grouping: str = ".") -> Column:
    """Does a price tag start with a number, of any size?"""
    return _numeric_prefix(normalise_price(c, decimal, grouping), decimal, grouping) != ""


def implied_cents(value: Column, tag: Column, rounding: str = "exact") -> Column:
    """Divide by 100 when the whole normalised tag has no separator and the value exceeds 100.

    ``exact`` keeps the cents, ``ceiling`` rounds up to an integer as the selector path of the
    original rules does (``1699`` gives 17).
    """
    if rounding not in ("exact", "ceiling"):
        raise ValueError(f"rounding must be 'exact' or 'ceiling', not {rounding!r}")
    cents = (value / 100).try_cast(PARSED)
    if rounding == "ceiling":
        cents = F.ceil(cents).try_cast(PARSED)
    return F.when(~tag.rlike("[.,]") & (value > 100), cents).otherwise(value)


def price_value(c: Column, rounding: str = "exact", decimal: str = ",", grouping: str = ".") -> Column:
    """Value of a price tag: normalise, parse the numeric prefix, apply implied cents."""
    tag = normalise_price(c, decimal, grouping)
    return implied_cents(parse_price(tag, decimal, grouping), tag, rounding)


def coerce_availability(c: Column) -> Column:
    """Dictionary lookup of a whole phrase, trimmed and in any case; null when unknown."""
    return F.try_element_at(literal_map(AVAILABILITY), F.lower(F.trim(c)))


def currency_of(locale: Column) -> Column:
    """ISO 4217 code for a language tag such as ``ro-RO``; the price text is never inspected."""
    country = F.upper(F.regexp_extract(locale, r"[-_]([A-Za-z]{2})$", 1))
    return F.try_element_at(literal_map(CURRENCIES), country)
