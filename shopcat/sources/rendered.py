"""Shop pages, fetch attempts and site selectors made from the ``part`` table, for tests and queries.

Everything is a projection over ``part``; nothing is invented beside it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.functions.isbn import ean13_check_digit
from shopcat.functions.words import AVAILABILITY
from shopcat.schemas import WRAPPERS

# Fixed values of the rendering.
EPOCH = 1_704_067_200
FORMAT_WORDS = {"STANDARD": "Cartonata", "ECONOMY": "Necartonata", "MEDIUM": "PDF",
                "PROMO": "ePub", "LARGE": "Audiobooks", "SMALL": "brosata"}
PHRASES = tuple(AVAILABILITY)
WRAPPER_ROWS = [
    ("shop0.example.ro", "title", "h1", None),
    ("shop0.example.ro", "authors", "ul.detalii > li.scris-de", None),
    ("shop0.example.ro", "isbn", ".isbn", None),
    ("shop0.example.ro", "format", ".detalii li", None),
    ("shop0.example.ro", "pricepoint", ".pret .amount", None),
    ("shop0.example.ro", "attributes", ".detalii li", None),
    ("shop0.example.ro", "availability", ".stoc", None),
    ("shop0.example.ro", "description", "div[class*=descr]", None),
    ("shop0.example.ro", "image", "img[alt=cover]", "src"),
    ("shop1.example.ro", "title", "h1", None),
    ("shop1.example.ro", "pricepoint", ".pret .amount", None),
    ("shop1.example.ro", "attributes", "ul.detalii > li", None),
    ("shop1.example.ro", "availability", "#produs .stoc", None),
    ("shop1.example.ro", "description", "p.none, .descriere", None),
    ("shop1.example.ro", "image", "img", "abs:src"),
]


def isbn13_of(key: Column) -> Column:
    """A well-formed ISBN-13 for a number."""
    body = F.concat(F.lit("978"), F.lpad(key.cast("string"), 9, "0"))
    return F.concat(body, ean13_check_digit(body).cast("string"))


def hyphenated(isbn13: Column) -> Column:
    return F.concat_ws("-", *[F.substring(isbn13, a, n)
                              for a, n in ((1, 3), (4, 3), (7, 3), (10, 3), (13, 1))])


def render_shop_pages(part: DataFrame) -> DataFrame:
    """One shop page per part: ``page_id, url, html, retrieved_time``."""
    k = F.col("p_partkey")
    price = F.col("p_retailprice").cast("decimal(12,2)")
    plain = price.cast("string")
    variant = k % 6
    amount = (
        F.when(variant == 1, F.concat(F.replace(plain, F.lit("."), F.lit(",")), F.lit(" lei")))
        .when(variant == 2, F.concat(
            F.lit("<span>"), F.substring_index(plain, ".", 1), F.lit("</span><span>"),
            F.substring_index(plain, ".", -1), F.lit("</span><span>lei</span>")))
        .when(variant == 3, F.concat(F.format_number(price + 1000, 2), F.lit(" lei")))
        .otherwise(F.concat(plain, F.lit(" lei")))
    )
    isbn13 = isbn13_of(k)
    isbn = F.when(k % 3 == 0, hyphenated(isbn13)).otherwise(isbn13)
    word = F.element_at(
        F.create_map(*[F.lit(x) for kv in FORMAT_WORDS.items() for x in kv]), F.col("p_type"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in PHRASES]), (k % len(PHRASES) + 1).cast("int"))
    first_shop, shop = k % 5 == 0, (k % 5).cast("string")

    def when(condition: Column, *parts) -> Column:
        return F.when(condition, F.concat(*parts)).otherwise("")

    lit = F.lit
    html = F.concat(
        lit('<!DOCTYPE html><html lang="ro"><head><meta charset="utf-8"><title>'), "p_name",
        lit(" - shop"), shop, lit("</title>"),
        when(k % 2 == 0, lit('<meta property="og:title" content="'), "p_name", lit('">')),
        when(k % 4 == 0, lit('<link rel="canonical" href="/c/'), k.cast("string"), lit('">')),
        lit("<script>var pret='<p>0,00 lei';</script></head><body><nav><ul><li><a href=\"/\">Acasa</a>"
            "<li><a href=\"/carti\">Carti</a></ul></nav><!-- 1,00 lei --><article id=\"produs\"><h1>"),
        "p_name", lit('</h1><img src="/pix.gif" alt=""><img alt="cover" src="/img/'),
        k.cast("string"), lit('.jpg">'),
        when(variant != 4, lit('<div class="pret">Pret: <span class="amount">'), amount,
             lit("</span></div>")),
        lit('<span class="stoc">'), phrase, lit('</span><ul class="detalii"><li>Editura: '),
        "p_brand", lit("</li>"),
        when(variant != 5, lit("<li>ISBN: "), F.when(first_shop, '<span class="isbn">').otherwise(""),
             isbn, F.when(first_shop, "</span>").otherwise(""), lit("</li>")),
        lit("<li>Format: "), word, lit("</li><li"),
        F.when(first_shop, ' class="scris-de"').otherwise(""), lit(">Autor: Ana "), "p_brand",
        lit('</li></ul><div class="descriere">Despre '), "p_name", lit(" &amp; altele, "),
        F.lower("p_type"), lit(".</div></article><footer>Contact</footer></body></html>"),
    )
    return part.select(
        k.alias("page_id"),
        F.concat(lit("https://www.shop"), shop, lit(".example.ro/carte/"), k.cast("string")).alias("url"),
        html.alias("html"),
        F.timestamp_seconds(k + EPOCH).alias("retrieved_time"),
    )


def fetch_attempts(part: DataFrame) -> DataFrame:
    """Two fetch attempts per part: both fail for ``k % 11 = 0``, the first for ``k % 7 = 0``."""
    k = F.col("p_partkey")
    attempts = part.select(
        F.concat(F.lit("job"), (k % 5).cast("string")).alias("job_id"),
        F.concat(F.lit("https://www.shop"), (k % 5).cast("string"), F.lit(".example.ro/carte/"),
                 k.cast("string")).alias("url"),
        F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt"),
        ((k % 11 != 0).alias("reachable")), (k % 7 == 0).alias("flaky"),
        (100 + k % 50).alias("download_ms"),
    )
    # The second attempt happens only when the first failed.
    ok = F.col("reachable") & ((F.col("attempt") == 1) | ~F.col("flaky"))
    happened = (F.col("attempt") == 0) | ~F.col("reachable") | F.col("flaky")
    return attempts.filter(happened).select("job_id", "url", "attempt", ok.alias("ok"), "download_ms")


def wrappers(part: DataFrame) -> DataFrame:
    """Selectors of the sites that occur in ``part`` and have any."""
    return _of_sites(part, WRAPPER_ROWS)


def edited_wrappers(part: DataFrame) -> DataFrame:
    """Later selectors: the first shop has none any more, the second another title, the third the second's."""
    second = [r for r in WRAPPER_ROWS if r[0] == "shop1.example.ro"]
    titled = [(d, f, "head > title" if f == "title" else q, a) for d, f, q, a in second]
    third = [("shop2.example.ro", *r[1:]) for r in second]
    return _of_sites(part, [("shop0.example.ro", None, None, None), *titled, *third])


def _of_sites(part: DataFrame, selectors: list[tuple]) -> DataFrame:
    rows = part.sparkSession.createDataFrame(selectors, WRAPPERS)
    sites = part.select(
        F.concat(F.lit("shop"), (F.col("p_partkey") % 5).cast("string"), F.lit(".example.ro"))
        .alias("domain")).distinct()
    return rows.join(sites, "domain", "left_semi")
