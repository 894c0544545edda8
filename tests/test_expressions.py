"""Literal vectors for prices, ISBNs, availability, urls and keywords."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from shopcat.functions.isbn import (
    coerce_isbn, ean13_check_digit, has_valid_check_digit, isbn_candidates, isbn_matches,
    normalise_isbn,
)
from shopcat.functions.price import coerce_availability, currency_of, price_value
from shopcat.functions.text import absolute_url, keywords, site_of

PRICES = [
    ("1699lei", "16.99"), ("19.2lei 24lei", "19.2"), ("10.79lei 27lei", "10.79"),
    ("28lei 35lei", "28"), ("1.5 lei", "1.5"), ("2,780.5 lei", "2780.5"), ("1,260 lei", "1260"),
    ("201700lei", "2017"), ("1.260 lei", "1.26"), ("1.234.567 lei", "1.234"),
    ("1,260,500 lei", "1260500"), ("1.234,56 lei", "1234.56"), ("12,50 RON", "12.5"),
    ("0,99 lei", "0.99"), ("-5 lei", "-5"), ("100 lei", "100"), ("101 lei", "1.01"),
    ("1250 RON", "12.5"), ("1E3 lei", "1"), ("lei 25", None), ("", None), (None, None),
    ("10.05", "10.05"), (".5 lei", "0.5"), ("5, lei", "5"),
]


def column(spark, values, make, ddl="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {ddl}")
    return [r[0] for r in rows.orderBy("i").select(make(F.col("v"))).collect()]


def test_price_vectors(spark):
    got = column(spark, [p for p, _ in PRICES], price_value)
    assert got == [None if w is None else Decimal(w) for _, w in PRICES]


def test_price_ceiling(spark):
    tags = ["1699lei", "1700lei", "16,99 lei", "99lei"]
    got = column(spark, tags, lambda c: price_value(c, "ceiling"))
    assert got == [17, 17, Decimal("16.99"), 99]


def test_price_separators_are_literal(spark):
    got = column(spark, ["1.234,5", "1,234.5", "12.50"], lambda c: price_value(c, decimal=".", grouping=","))
    assert got == [Decimal("1234.5"), Decimal("1234.5"), Decimal("12.5")]


def test_unknown_rounding(spark):
    with pytest.raises(ValueError):
        price_value(F.lit("1"), "floor")


def test_isbn_coerce(spark):
    raw = ["ISBN 978-606-673-363-2", "9786066733632 ", "ISBN 080442957X", "9786066733632 (pdf)",
           "ISBN: 97860", None]
    assert column(spark, raw, coerce_isbn) == [
        "978-606-673-363-2", "9786066733632", "080442957", "9786066733632 (pdf", ": 97860", None]
    assert column(spark, raw, lambda c: coerce_isbn(c, strict=True))[2] == "080442957X"


def test_isbn_equality_ignores_separators(spark):
    assert len(set(column(spark, ["978-1234-1093-23", "978 -1234-1093-23"], normalise_isbn))) == 1


def test_isbn_scan(spark):
    texts = ["ISBN 978-606-673-363-2 pages 320", "tel 0721 123 456 isbn 9786066733632",
             "978-6-06-6733-63-2", "12345", "cod 080442957X."]
    assert column(spark, texts, isbn_candidates) == [
        ["9786066733632"], ["0721123456", "9786066733632"], [], [], ["080442957X"]]
    assert column(spark, texts[:2], isbn_matches) == [
        ["978-606-673-363-2"], ["0721 123 456", "9786066733632"]]


def test_check_digits(spark):
    values = ["9786066733632", "9786066733631", "080442957X", "0804429571", "0306406152", "12345", "x" * 13]
    assert column(spark, values, has_valid_check_digit) == [
        True, False, True, False, True, False, False]
    assert column(spark, ["978030640615"], ean13_check_digit) == [7]


def test_availability(spark):
    phrases = ["În Stoc", " stoc limitat ", "la comandă", "Indisponibil", "precomanda", "preorder",
               "in stock", "InStock", None]
    assert column(spark, phrases, coerce_availability) == [
        "IN_STOCK", "LIMITED_AVAILABILITY", "OUT_OF_STOCK", "DISCONTINUED", "PREORDER", None, None,
        "IN_STOCK", None]


def test_currency(spark):
    assert column(spark, ["ro-RO", "ro-ro", "en_GB", "ro", None], currency_of) == [
        "RON", "RON", "GBP", None, None]


def test_site(spark):
    urls = ["https://www.Shop.example.ro/a?b", "http://shop.example.ro:8080/", "no url", "www.a.ro/x",
            "https://www2.a.ro", None]
    assert column(spark, urls, site_of) == [
        "shop.example.ro", "shop.example.ro", None, None, "www2.a.ro", None]


@pytest.mark.parametrize("href, want", [
    ("/i/1.jpg", "https://a.ro/i/1.jpg"), ("1.jpg", "https://a.ro/b/c/1.jpg"),
    ("../1.jpg", "https://a.ro/b/1.jpg"), ("../../../1.jpg", "https://a.ro/1.jpg"),
    ("./x/./1.jpg", "https://a.ro/b/c/x/1.jpg"), ("//cdn.ro/1.jpg", "https://cdn.ro/1.jpg"),
    ("http://x.ro/../1.jpg", "http://x.ro/../1.jpg"), ("?q=1", "https://a.ro/b/c/d.html?q=1"),
    ("#t", "https://a.ro/b/c/d.html?z=1#t"), ("", "https://a.ro/b/c/d.html?z=1"),
    ("x/../../y", "https://a.ro/b/y"),
])
def test_absolute_url(spark, href, want):
    base = F.lit("https://a.ro/b/c/d.html?z=1")
    assert column(spark, [href], lambda c: absolute_url(c, base)) == [want]


def test_absolute_url_without_base(spark):
    assert column(spark, ["1.jpg"], lambda c: absolute_url(c, F.lit("nowhere"))) == [""]


def test_keywords(spark):
    row = spark.createDataFrame([("Școala de Țânțari", None, "ANA-ana")], "a string, b string, c string")
    assert row.select(keywords("a", "b", "c")).first()[0] == ["ana", "de", "scoala", "tantari"]
