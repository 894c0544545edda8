"""ISBN scanning, coercion and check digits, as native column expressions."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed pattern: an ISBN-shaped run of digits with optional single separators.
ISBN_PATTERN = r"(?=[-\d\ xX]{10,})\d+[-\ ]?\d+[-\ ]?\d+[-\ ]?\d*[-\ ]?[\dxX]"


def strip_separators(c: Column) -> Column:
    return F.regexp_replace(c, r"[\s-]", "")


def isbn_matches(c: Column) -> Column:
    """Raw ISBN-shaped runs (separators kept) that have 10 or 13 characters without separators."""
    runs = F.regexp_extract_all(c, F.lit(ISBN_PATTERN), F.lit(0))
    return F.filter(runs, lambda m: F.length(strip_separators(m)).isin(10, 13))


def isbn_candidates(c: Column) -> Column:
    """ISBN candidates in text order, separators removed. The first one is used for a page.

    A phone number of ten digits is a candidate too.
    """
    return F.transform(isbn_matches(c), strip_separators)


def normalise_isbn(c: Column) -> Column:
    """Drop hyphens and spaces."""
    return F.translate(c, "- ", "")


def coerce_isbn(c: Column, strict: bool = False) -> Column:
    """Strip leading spaces and letters and one trailing character that is not a digit.

    The trailing rule also eats a real check digit ``X``; ``strict=True`` keeps it. Only one
    trailing character goes, so ``"9786066733632 (pdf)"`` keeps ``" (pdf"``.
    """
    tail = "[^0-9xX]$" if strict else "[^0-9]$"
    return F.regexp_replace(F.regexp_replace(c, r"^[ \p{L}]*", ""), tail, "")


def _digit(number: Column, place: int) -> Column:
    """Decimal digit of ``number`` at 10 to the power of ``place``."""
    return F.call_function("div", number, F.lit(10**place)) % 10


def ean13_check_digit(first12: Column) -> Column:
    """Check digit for a text of twelve digits."""
    number = first12.try_cast("bigint")
    total = reduce(add, [_digit(number, 11 - i) * (3 if i % 2 else 1) for i in range(12)])
    return ((10 - total % 10) % 10).cast("int")


def has_valid_check_digit(c: Column) -> Column:
    """True when ``c`` is a well-formed ISBN-10 or ISBN-13 with a correct check digit."""
    nine = F.left(c, F.lit(9)).try_cast("bigint")
    check = F.when(F.right(c, F.lit(1)).isin("x", "X"), 10).otherwise(
        F.right(c, F.lit(1)).try_cast("int"))
    ten = reduce(add, [_digit(nine, 8 - i) * (10 - i) for i in range(9)]) + check
    return (
        F.when(c.rlike(r"^\d{13}$"), check == ean13_check_digit(F.left(c, F.lit(12))))
        .when(c.rlike(r"^\d{9}[\dxX]$"), ten % 11 == 0)
        .otherwise(F.lit(False))
    )


def full_form(stem: Column) -> Column:
    """The ISBN with a valid check digit for a text of 9 or 12 digits, null for any other text."""
    nine = stem.try_cast("bigint")
    check = (11 - reduce(add, [_digit(nine, 8 - i) * (10 - i) for i in range(9)]) % 11) % 11
    return F.when(stem.rlike(r"^\d{12}\z"), F.concat(stem, ean13_check_digit(stem).cast("string"))).when(
        stem.rlike(r"^\d{9}\z"), F.concat(stem, F.when(check == 10, "X").otherwise(check.cast("string"))))


def isbn_rank(c: Column) -> Column:
    """0 = length 10/13 with a valid check digit, 1 = length 10/13, 2 = anything else."""
    return F.when(~F.length(c).isin(10, 13), 2).when(has_valid_check_digit(c), 0).otherwise(1)


def isbn_stem(c: Column) -> Column:
    """The ISBN without its check digit for length 10/13, else the ISBN itself.

    An ISBN that lost its check digit has the same stem as the full one, so both land in the
    same group without a self-join.
    """
    return F.when(F.length(c).isin(10, 13), F.left(c, F.length(c) - 1)).otherwise(c)


def isbn_book(c: Column) -> Column:
    """The ISBN a book most likely goes by: a full one itself, for others the full form if there is one."""
    return F.when(F.length(c).isin(10, 13), c).otherwise(F.coalesce(full_form(c), c))


def is_odd_isbn(c: Column) -> Column:
    """Has it length 10 or 13, but is not the full form of its stem? Only such ISBNs can make an :func:`isbn_book` wrong."""
    return F.length(c).isin(10, 13) & ~c.eqNullSafe(full_form(isbn_stem(c)))
