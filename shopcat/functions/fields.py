"""Book fields and price tag of a page, read from its nodes by heuristics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcat.functions.isbn import coerce_isbn, isbn_matches, normalise_isbn, strip_separators
from shopcat.functions.nodes import attr, first, first_text, names_any, node_text
from shopcat.functions.text import absolute_url, let, literal_map
from shopcat.functions.words import (
    AUTHOR_WORDS, CODE_WORDS, FORMATS, PRICE_WORDS, PUBLISHER_WORDS, TITLE_WORDS,
)

# Fixed pattern: a price in Romanian lei inside a node's own text.
PRICE_TEXT_PATTERN = r"(,|.)[0-9]{2} lei"


def isbn_text(page_text: Column) -> Column:
    """The first ISBN-shaped run of a page as it is written there."""
    return F.get(isbn_matches(page_text), F.lit(0))


def split_attributes(texts: Column) -> Column:
    """Key/value pairs of texts split at the first colon; a text without one is both.

    An array of structs in document order; of equal keys the last one stays.
    """
    def pair(text: Column, pos: Column) -> Column:
        parts = F.split(text, ":", 2)
        key = F.trim(F.get(parts, F.lit(0)))
        return F.struct(pos.alias("pos"), key.alias("key"),
                        F.coalesce(F.trim(F.get(parts, F.lit(1))), key).alias("value"))

    return let(
        F.transform(texts, pair),
        lambda pairs: F.filter(
            pairs,
            lambda p: ~F.exists(pairs, lambda q: (q["key"] == p["key"]) & (q["pos"] > p["pos"])),
        ),
    )


def attribute_texts(nodes: Column, page_text: Column, isbn_run: Column) -> Column:
    """Texts of the block around the ISBN: the siblings of its element, then the element.

    The element is the last node that contains the run. If its text is exactly the ISBN without
    separators, its parent is taken; a hyphenated ISBN alone in an element stays where it is.
    """
    def holder(m: Column) -> Column:
        # Only nodes that span from before the last to after the first occurrence can contain one.
        return F.element_at(
            F.filter(
                nodes,
                lambda n: (n["text_start"] < m["last_at"]) & (n["text_end"] >= m["first_end"])
                & node_text(n, m["text"]).contains(m["run"]),
            ),
            -1,
        )

    def moved(node: Column) -> Column:
        return F.when(node_text(node, page_text) == strip_separators(isbn_run),
                      F.coalesce(F.get(nodes, node["parent"]), node)).otherwise(node)

    def block(node: Column) -> Column:
        siblings = F.filter(
            nodes, lambda n: (n["parent"] == node["parent"]) & (n["pos"] != node["pos"]))
        return F.transform(
            F.concat(siblings, F.array(node)), lambda n: node_text(n, page_text))

    text, run = (F.replace(c, F.lit("X"), F.lit("x")) for c in (page_text, isbn_run))
    match = F.struct(
        text.alias("text"),
        run.alias("run"),
        (F.position(run, text) + F.length(run) - 1).alias("first_end"),
        (F.length(text) - F.position(F.reverse(run), F.reverse(text)) - F.length(run) + 2)
        .alias("last_at"),
    )
    return F.when(isbn_run.isNotNull(), let(let(let(match, holder), moved), block)).otherwise(
        F.array().cast("array<string>"))


def title(nodes: Column, page_text: Column, named: Column | None = None) -> Column:
    """``og:title`` if present (even empty), else ``title``, else the first title-like element.

    ``named`` are the nodes to look for a title-like element in, if ``nodes`` are not all.
    """
    og = first(nodes, lambda n: (n["tag"] == "meta")
               & (F.lower(F.trim(attr(n, "property"))) == "og:title"))
    element = first_text(nodes, page_text, lambda n: n["tag"] == "title")
    # A node's text is never null, so a null text means no such node.
    return F.coalesce(
        let(og, lambda n: F.when(n.isNotNull(), F.coalesce(attr(n, "content"), F.lit("")))),
        element,
        first_text(nodes if named is None else named, page_text, lambda n: names_any(n, TITLE_WORDS)),
    )


def author_attribute(attributes: Column) -> Column:
    hit = first(attributes, lambda a: F.lower(a["key"]).isin(*AUTHOR_WORDS))
    return hit["value"]


def authors(nodes: Column, page_text: Column, attributes: Column) -> Column:
    """First author-like element, else the attribute whose whole key is an author word."""
    return F.coalesce(
        first_text(nodes, page_text, lambda n: names_any(n, AUTHOR_WORDS)),
        author_attribute(attributes),
    )


def _shares_token(text: Column, pattern: str, words) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), pattern), F.array(*[F.lit(w) for w in words]))


def isbn_attribute(attributes: Column, strict: bool = False) -> Column:
    """Coerced value of the first attribute with an ISBN word in its key."""
    hit = first(attributes, lambda a: _shares_token(a["key"], r"[\s|,.;:]", CODE_WORDS))
    return normalise_isbn(coerce_isbn(hit["value"], strict))


def book_format(attributes: Column) -> Column:
    """Canonical format named by the first attribute value that holds a known word."""
    known = literal_map(FORMATS)
    hit = first(attributes, lambda a: _shares_token(a["value"], " ", FORMATS))
    word = first(F.split(F.lower(hit["value"]), " "), lambda w: w.isin(*FORMATS))
    return let(word, lambda w: F.try_element_at(known, w))


def publisher(attributes: Column) -> Column:
    """Value of the first attribute with a publisher word in its key."""
    hit = first(attributes, lambda a: _shares_token(a["key"], " ", PUBLISHER_WORDS))
    return hit["value"]


def description(nodes: Column, page_text: Column) -> Column:
    """Text of the first node whose class contains ``descri``."""
    return first_text(nodes, page_text, lambda n: names_any(n, ("descri",), class_only=True))


def image_url(nodes: Column, base: Column) -> Column:
    """First ``meta[property*=image]`` content, else the first described image, absolute."""
    meta = first(nodes, lambda n: (n["tag"] == "meta")
                 & F.lower(attr(n, "property")).contains("image"))
    image = first(nodes, lambda n: (n["tag"] == "img") & (F.trim(attr(n, "alt")) != ""))
    return F.coalesce(
        let(meta, lambda n: F.when(n.isNotNull(), F.coalesce(attr(n, "content"), F.lit("")))),
        let(image, lambda n: F.when(
            n.isNotNull(), F.coalesce(absolute_url(attr(n, "src"), base), F.lit("")))),
    )


def stock_phrase(nodes: Column, page_text: Column) -> Column:
    """``available`` / ``unavailable`` from the first stock-like element, else null.

    The phrase is kept beside the offer; on this path it never becomes the offer's availability.
    """
    text = F.lower(first_text(nodes, page_text, lambda n: names_any(n, ("stoc",))))
    return let(text, lambda t: F.when(t.rlike("in stoc|în stoc|limitat"), "available").when(
        t.rlike("indisponibil|comanda"), "unavailable"))


def price_tag(nodes: Column, page_text: Column) -> Column:
    """Text after the last colon of the first node that looks like a price."""
    text = first_text(nodes, page_text, lambda n: n["own_text"].rlike(PRICE_TEXT_PATTERN)
                      | names_any(n, PRICE_WORDS))
    return F.trim(F.regexp_replace(text, ".*:", ""))
