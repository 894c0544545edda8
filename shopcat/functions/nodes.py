"""Selections over the ``nodes`` array of a page."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcat.functions.text import absolute_url, let

# Fixed value: elements outside the main content of a page.
BOILERPLATE_TAGS = ("nav", "header", "footer", "aside", "form")
_TOPS = 128  # subtrees in a block


def node_text(node: Column, page_text: Column) -> Column:
    """Whole text of a node, trimmed; null for a null node."""
    return F.trim(F.substr(page_text, node["text_start"] + 1, node["text_end"] - node["text_start"]))


def attr(node: Column, name: str) -> Column:
    """An attribute of a node; null when it is absent."""
    return F.try_element_at(node["attrs"], F.lit(name))


def first(nodes: Column, condition) -> Column:
    """First node in document order that fulfils ``condition``."""
    return F.get(F.filter(nodes, condition), F.lit(0))


def first_text(nodes: Column, page_text: Column, condition) -> Column:
    """Text of the first node that fulfils ``condition``."""
    return let(first(nodes, condition), lambda n: node_text(n, page_text))


def names_any(node: Column, words: Iterable[str], class_only: bool = False) -> Column:
    """True when the node's class or id contains one of ``words``, as a substring in any case."""
    names = node["class"] if class_only else F.concat_ws(" ", node["class"], node["id"])
    return is_named(node) & F.lower(names).rlike("|".join(words))


def is_named(node: Column) -> Column:
    """Has the node a class or an id? Most have none, and conditions on names need not look at them."""
    return (node["class"] != "") | (node["id"] != "")


def first_by_class_or_id(nodes: Column, words: Iterable[str]) -> Column:
    """First node whose class or id contains one of ``words``."""
    words = tuple(words)
    return first(nodes, lambda n: names_any(n, words))


def document_title(nodes: Column, page_text: Column) -> Column:
    """Text of the first ``title`` element, empty without one."""
    text = first_text(nodes, page_text, lambda n: n["tag"] == "title")
    return F.when(nodes.isNotNull(), F.coalesce(text, F.lit("")))


def base_url(nodes: Column, url: Column) -> Column:
    """What relative addresses of the page refer to: its first ``base`` with an address, else its own url."""
    base = first(nodes, lambda n: (n["tag"] == "base") & (F.trim(attr(n, "href")) != ""))
    return let(absolute_url(attr(base, "href"), url), lambda u: F.when(u != "", u).otherwise(url))


def canonical_url(nodes: Column, url: Column, base: Column | None = None) -> Column:
    """Address in ``link[rel=canonical]``, made absolute by :func:`base_url`; the page's own url without one."""
    link = first(
        nodes,
        lambda n: (n["tag"] == "link") & (F.lower(F.trim(attr(n, "rel"))) == "canonical")
        & (F.trim(attr(n, "href")) != ""),
    )
    return let(absolute_url(attr(link, "href"), base_url(nodes, url) if base is None else base),
               lambda u: F.when(u != "", u).otherwise(url))


def covered(tops: Column, own: bool = True) -> Column:
    """A mark for each node, by position: is it inside a subtree of ``tops``, the top itself counted if ``own``?

    ``tops`` are nodes in document order. Subtrees lie apart or inside each other, so one pass over ``tops`` keeps the
    outer ones as runs of marks. Positions after the last subtree have no mark. Runs are gathered by blocks of tops, as
    each addition copies the array that it adds to.
    """
    empty = F.array().cast("array<struct<outside:int,inside:int>>")

    def one(state: Column, node: Column) -> Column:
        run = F.struct((node["pos"] - state["until"] - F.lit(int(own))).alias("outside"),
                       (node["last"] - node["pos"] + F.lit(int(own))).alias("inside"))
        return F.when((node["pos"] <= state["until"]) | (node["last"] < node["pos"] + F.lit(int(not own))), state).otherwise(
            F.struct(node["last"].alias("until"), F.array_append(state["runs"], run).alias("runs")))

    def block(found: Column, state: Column, at: Column) -> Column:
        inner = F.aggregate(F.slice(found, at, F.lit(_TOPS)), F.struct(state["until"].alias("until"), empty.alias("runs")), one)
        return let(inner, lambda i: F.struct(
            i["until"].alias("until"), F.array_append(state["blocks"], i["runs"]).alias("blocks")))

    def runs(found: Column) -> Column:
        start = F.struct(F.lit(-1).alias("until"), F.array().cast("array<array<struct<outside:int,inside:int>>>").alias("blocks"))
        return F.flatten(F.aggregate(
            F.sequence(F.lit(1), F.greatest(F.size(found), F.lit(1)), F.lit(_TOPS)), start,
            lambda state, at: block(found, state, at), lambda state: state["blocks"]))

    return F.flatten(F.transform(let(tops, runs), lambda r: F.concat(
        F.array_repeat(F.lit(False), r["outside"]), F.array_repeat(F.lit(True), r["inside"]))))


def main_content(nodes: Column) -> Column:
    """Nodes outside navigation, header, footer, aside and form subtrees."""
    return let(
        covered(F.filter(nodes, lambda n: n["tag"].isin(*BOILERPLATE_TAGS))),
        lambda cut: F.filter(nodes, lambda n: ~F.coalesce(F.get(cut, n["pos"]), F.lit(False))),
    )


def main_text(nodes: Column, page_text: Column) -> Column:
    """Text of the body without navigation, header, footer, aside and form subtrees, in page order.

    The ranges of these subtrees are cut out of the page text; what is left is joined by spaces.
    """
    def texts(body: Column) -> Column:
        begin = F.coalesce(body["text_start"], F.lit(0))
        end = F.coalesce(body["text_end"], F.length(page_text))
        cuts = F.filter(nodes, lambda n: n["tag"].isin(*BOILERPLATE_TAGS, "title")
                        & (n["text_end"] > begin) & (n["text_start"] < end))

        def keep(state: Column, start: Column, stop: Column) -> Column:
            piece = F.trim(F.substr(page_text, state["at"] + 1, start - state["at"]))
            return F.struct(
                F.greatest(state["at"], stop).alias("at"),
                F.when((start > state["at"]) & (piece != ""), F.concat(state["pieces"], F.array(piece)))
                .otherwise(state["pieces"]).alias("pieces"))

        first_state = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("pieces"))
        return F.aggregate(
            cuts, first_state, lambda s, n: keep(s, n["text_start"], n["text_end"]),
            lambda s: F.array_join(keep(s, end, end)["pieces"], " "))

    return F.when(nodes.isNotNull(), let(first(nodes, lambda n: n["tag"] == "body"), texts))
