"""Book and offer extraction: heuristics, per-site selectors, and the choice between them.

A strategy is any function ``DataFrame -> DataFrame`` that adds the columns ``title, authors,
isbn, description, publisher, format, image_url, price_tag, nominal_value, availability`` to pages
with nodes; :func:`assemble` turns them into keywords and an offer struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopcat.functions import fields as X
from shopcat.functions.isbn import normalise_isbn
from shopcat.functions.nodes import base_url, canonical_url, document_title, is_named, node_text
from shopcat.functions.price import (
    STORED, coerce_availability, currency_of, price_value, separators, starts_with_number,
)
from shopcat.functions.selectors import is_supported, selected, selector_steps
from shopcat.functions.text import absolute_url, built_once, keywords, let, site_of
from shopcat.operators.joins import BROADCAST_BYTES, fits_broadcast
from shopcat.sources.html import with_nodes

BOOK_FIELDS = ("title", "authors", "isbn", "description", "publisher", "format", "image_url")


def _prepare(pages: DataFrame) -> DataFrame:
    parsed = pages if "nodes" in pages.columns else with_nodes(pages)
    if "site" not in parsed.columns:
        parsed = parsed.withColumn("site", site_of(F.col("url")))
    return parsed.withColumns(_node_columns()).withColumn("_base", _base_column()).withColumns(_page_columns())


@built_once
def _node_columns() -> dict[str, Column]:
    """The few nodes that most fields look at: by their tag, and by their class or id."""
    return {"_tagged": F.filter(F.col("nodes"), lambda n: n["tag"].isin("base", "link", "meta", "title", "img")),
            "_named": F.filter(F.col("nodes"), is_named)}


@built_once
def _base_column() -> Column:
    return base_url(F.col("_tagged"), F.col("url"))


@built_once
def _page_columns() -> dict[str, Column]:
    return {
        "canonical_url": canonical_url(F.col("_tagged"), F.col("url"), F.col("_base")),
        "page_title": document_title(F.col("_tagged"), F.col("page_text")),
        "isbn_run": X.isbn_text(F.col("page_text")),
    }


def wrappers_by_domain(wrappers: DataFrame) -> DataFrame:
    """One row per domain: ``selectors`` (field -> attr and steps) and ``selector_errors``.

    A second selector for the same field of a domain is ignored (the smallest text is kept). If ``wrappers`` has
    ``valid_from``, rows of a domain with the same one are a version, which replaces the former as a whole; there is one row
    for each, valid in ``[_from, _until)``. Null is the beginning of time. A version whose only row has a null field ends
    the domain's selectors.
    """
    version = ["valid_from"] if "valid_from" in wrappers.columns else []
    compiled = wrappers.groupBy("domain", *version, "field").agg(
        F.min(F.struct("query", "attr")).alias("s")
    ).select(
        "domain", *version, "field", "s.attr",
        selector_steps(F.col("s.query")).alias("steps"),
        F.when(~is_supported(F.col("s.query")),
               F.concat(F.lit("unsupported selector "), "field", F.lit(": "), "s.query")
               ).alias("error"),
    )
    known = F.when(F.col("field").isNotNull(), F.struct("field", F.struct("attr", "steps")))
    entries = F.collect_list(known)
    by_domain = compiled.groupBy(F.col("domain").alias("site"), *version).agg(
        F.when(F.size(entries) > 0, F.map_from_entries(entries)).alias("selectors"),
        F.array_sort(F.collect_list("error")).alias("selector_errors"),
    )
    if not version:
        return by_domain
    in_time = Window.partitionBy("site").orderBy(F.col("valid_from").asc_nulls_first())
    return by_domain.withColumn("_until", F.lead("valid_from").over(in_time)).withColumnRenamed("valid_from", "_from")


def choose_strategy(pages: DataFrame, wrappers: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Attach each site's selectors (null without any) and name the strategy of the page.

    Compiled selectors within ``max_bytes`` are broadcast. Beyond that it is a shuffle join, for which
    AQE splits a site that owns a large part of the pages; give pages that are not parsed yet.
    """
    compiled = wrappers_by_domain(wrappers)
    return _with_strategy(pages, F.broadcast(compiled) if fits_broadcast(compiled, max_bytes) else compiled)


def _with_strategy(pages: DataFrame, compiled: DataFrame) -> DataFrame:
    with_site = pages if "site" in pages.columns else pages.withColumn("site", site_of(F.col("url")))
    joined = _valid_then(with_site, compiled) if "_from" in compiled.columns else with_site.join(compiled, "site", "left")
    return joined.withColumn(
        "strategy", F.when(F.col("selectors").isNotNull(), "selectors").otherwise("heuristic"))


def _valid_then(pages: DataFrame, versions: DataFrame) -> DataFrame:
    """Each page with the version of its site's selectors that was valid at its ``retrieved_time``.

    An equi-join on the site with the time as a further condition; versions of a site don't overlap, so a page
    meets one at most. A page without time takes the last version.
    """
    time = F.col("retrieved_time")
    begun = F.col("_from").isNull() | time.isNull() | (F.col("_from") <= time)
    valid = begun & (F.col("_until").isNull() | (time < F.col("_until")))
    same = pages["site"] == versions["site"]
    return pages.join(versions, same & valid, "left").drop(versions["site"]).drop("_from", "_until")


def _selector_value(nodes: Column, page_text: Column, base: Column, selector: Column) -> Column:
    """Text of the first selected node, or the attribute asked for (``abs:name`` resolves it)."""
    def read(node: Column) -> Column:
        name = F.regexp_replace(selector["attr"], "^abs:", "")
        value = F.try_element_at(node["attrs"], name)
        return (
            F.when(selector["attr"].isNull(), node_text(node, page_text))
            .when(selector["attr"].startswith("abs:"), absolute_url(value, base))
            .otherwise(F.when(node.isNotNull(), F.coalesce(value, F.lit(""))))
        )

    return let(F.get(selected(nodes, selector["steps"]), F.lit(0)), read)


def with_wrapper_fields(pages: DataFrame, wrappers: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Apply each page's own selectors: ``fields map<string,string>`` and ``selected_texts``.

    A defined selector that matches nothing gives a null value under its key; ``selected_texts``
    holds all texts of the ``attributes`` selector. Selectors too large to broadcast are joined with
    the raw pages, before these are parsed, so nodes are never shuffled.
    """
    compiled = wrappers_by_domain(wrappers)
    if fits_broadcast(compiled, max_bytes):
        return _apply_selectors(_with_strategy(_prepare(pages), F.broadcast(compiled)))
    return _apply_selectors(_prepare(_with_strategy(pages, compiled)))


def _apply_selectors(joined: DataFrame) -> DataFrame:
    return joined.withColumns(_wrapper_columns())


@built_once
def _wrapper_columns() -> dict[str, Column]:
    nodes, text, base = F.col("nodes"), F.col("page_text"), F.col("_base")
    many = F.try_element_at(F.col("selectors"), F.lit("attributes"))
    single = F.map_filter(F.col("selectors"), lambda k, _: k != "attributes")
    return {
        "fields": F.transform_values(
            single, lambda _, s: _selector_value(nodes, text, base, s)),
        "selected_texts": F.coalesce(
            F.transform(selected(nodes, many["steps"]), lambda n: node_text(n, text)),
            F.array().cast("array<string>"),
        ),
    }


@built_once
def _heuristic_columns(strict_isbn: bool) -> dict[str, Column]:
    nodes, text, attributes = F.col("nodes"), F.col("page_text"), F.col("attributes")
    tagged, named = F.col("_tagged"), F.col("_named")
    return {
        "title": X.title(tagged, text, named),
        "authors": X.authors(named, text, attributes),
        "isbn": X.isbn_attribute(attributes, strict_isbn),
        "description": X.description(named, text),
        "publisher": X.publisher(attributes),
        "format": X.book_format(attributes),
        "image_url": X.image_url(tagged, F.col("_base")),
        "price_tag": X.price_tag(nodes, text),
        "availability": F.lit(None).cast("string"),
    }


@built_once
def _selector_columns(strict_isbn: bool) -> dict[str, Column]:
    fields, attributes = F.col("fields"), F.col("attributes")

    def value(name: str) -> Column:
        return F.try_element_at(fields, F.lit(name))

    def defined(name: str) -> Column:
        return F.map_contains_key(fields, F.lit(name))

    return {
        "title": value("title"),
        "authors": F.when(defined("authors"), value("authors")).otherwise(
            X.author_attribute(attributes)),
        # The selector's text is not coerced; only separators go.
        "isbn": F.when(defined("isbn"), normalise_isbn(value("isbn"))).otherwise(
            X.isbn_attribute(attributes, strict_isbn)),
        "description": value("description"),
        # A `format` selector turns off both attribute readings and gives nothing itself.
        "publisher": F.when(~defined("format"), X.publisher(attributes)),
        "format": F.when(~defined("format"), X.book_format(attributes)),
        "image_url": value("image"),
        "price_tag": value("pricepoint"),
        "availability": coerce_availability(value("availability")),
    }


def assemble(extracted: DataFrame, locale: str = "ro-RO") -> DataFrame:
    """Add ``keywords`` and the ``offer`` struct (null when the tag has no leading number)."""
    keyed = extracted.withColumns(_stored_columns(locale))
    known = F.col("selector_errors") if "selector_errors" in extracted.columns else F.lit(None).cast("array<string>")
    done = keyed.withColumn("_selector_errors", known).withColumns(_catalog_columns(locale))
    return done.drop("_stored", "_currency", "_offer_site", "_selector_errors")


@built_once
def _stored_columns(locale: str) -> dict[str, Column]:
    return {
        "_stored": F.col("nominal_value").try_cast(STORED),
        "_currency": currency_of(F.lit(locale)),
        "_offer_site": site_of(F.col("canonical_url")),
    }


@built_once
def _catalog_columns(locale: str) -> dict[str, Column]:
    key = ("_offer_site", "canonical_url", "retrieved_time", "_stored", "_currency")
    offer = F.struct(
        F.xxhash64(*key).alias("offer_id"),
        F.col("_stored").alias("nominal_value"),
        F.col("_currency").alias("currency"),
        F.col("retrieved_time"),
        F.col("canonical_url").alias("url"),
        F.col("page_title"),
        F.col("_offer_site").alias("site"),
        F.col("availability"),
    )
    return {
        "keywords": keywords(*[F.col(c) for c in ("title", "authors", "isbn", "publisher", "format")]),
        # A page whose address has no host cannot carry an offer; it says so.
        "offer": F.when(F.col("_stored").isNotNull() & F.col("_offer_site").isNotNull(), offer),
        "errors": F.array_compact(F.concat(
            F.array("parse_error"),
            F.array(F.when(F.col("_stored").isNotNull() & F.col("_offer_site").isNull(),
                           F.concat(F.lit("no host in address: "), "canonical_url"))),
            F.array(F.when(F.col("_stored").isNull() & starts_with_number(F.col("price_tag"), *separators(locale)),
                           F.concat(F.lit("price out of range: "), "price_tag"))),
            F.array(F.when(F.col("_stored").isNotNull() & F.col("_currency").isNull(),
                           F.lit(f"no currency for locale: {locale}"))),
            F.array(F.when(F.col("nominal_value") != F.col("_stored"),
                           F.concat(F.lit("more than two decimals: "), "price_tag"))),
            F.coalesce("_selector_errors", F.array().cast("array<string>")),
        )),
    }


def _finish(df: DataFrame, locale: str) -> DataFrame:
    done = assemble(df, locale)
    return done.drop("_base", "_tagged", "_named", "nodes", "page_text", "attributes", "isbn_run", "selectors", "fields",
                     "selected_texts", "selector_errors", "parse_error")


@built_once
def _block_texts() -> Column:
    return X.attribute_texts(F.col("nodes"), F.col("page_text"), F.col("isbn_run"))


@built_once
def _stock_phrase() -> Column:
    return X.stock_phrase(F.col("_named"), F.col("page_text"))


@built_once
def _value(locale: str, rounding: str = "exact") -> Column:
    return price_value(F.col("price_tag"), rounding, *separators(locale))


def heuristic_books(pages: DataFrame, strict_isbn: bool = False, locale: str = "ro-RO") -> DataFrame:
    """Extract book and offer of every page by heuristics."""
    df = _prepare(pages).withColumn("attributes", X.split_attributes(_block_texts()))
    df = df.withColumns({
        **_heuristic_columns(strict_isbn),
        "stock_phrase": _stock_phrase(),
        "strategy": F.lit("heuristic"),
    }).withColumn("nominal_value", _value(locale))
    return _finish(df, locale)


def wrapper_books(
    pages: DataFrame, wrappers: DataFrame, rounding: str = "exact", strict_isbn: bool = False,
    locale: str = "ro-RO",
) -> DataFrame:
    """Extract book and offer of the pages whose site has selectors; other pages are left out."""
    df = with_wrapper_fields(pages, wrappers).filter(F.col("strategy") == "selectors")
    df = df.withColumn("attributes", X.split_attributes(F.col("selected_texts")))
    df = df.withColumns(_selector_columns(strict_isbn)).withColumn(
        "nominal_value", _value(locale, rounding))
    return _finish(df.withColumn("stock_phrase", F.lit(None).cast("string")), locale)


def scrape(
    pages: DataFrame, wrappers: DataFrame | None = None, rounding: str = "exact",
    strict_isbn: bool = False, locale: str = "ro-RO",
) -> DataFrame:
    """Extract every page by its site's selectors or, without any, by heuristics.

    One pass: the choice is a lazy CASE per field, so a page is parsed and read once. ``rounding``
    applies to the selector path.
    """
    if wrappers is None:
        return heuristic_books(pages, strict_isbn, locale)
    df = with_wrapper_fields(pages, wrappers)
    by_selector = F.col("strategy") == "selectors"
    df = df.withColumn("attributes", X.split_attributes(
        F.when(by_selector, F.col("selected_texts")).otherwise(_block_texts())))
    heuristic, selector = _heuristic_columns(strict_isbn), _selector_columns(strict_isbn)
    df = df.withColumns({
        **{c: F.when(by_selector, selector[c]).otherwise(heuristic[c]) for c in heuristic},
        "stock_phrase": F.when(
            ~by_selector, _stock_phrase()),
    }).withColumn(
        "nominal_value",
        F.when(by_selector, _value(locale, rounding)).otherwise(_value(locale)),
    )
    return _finish(df, locale)
