"""CSS selectors as data: a selector text becomes an array of steps, and the steps are evaluated
over a ``nodes`` array, both in native expressions.

Supported: tag, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]``, ``[a*=v]``, ``[a^=v]``, ``[a$=v]``,
descendant, ``>`` and comma. Attribute values and classes compare in any case.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcat.functions.nodes import covered
from shopcat.functions.text import let

_NAME = r"[\w-]+"
_TEST = rf"\[\s*{_NAME}\s*(?:[*^$]?=\s*(?:\"[^\"]*\"|'[^']*'|[^\]\"']*))?\s*\]"
_STEP = rf"(?:\*|{_NAME}|#{_NAME}|\.{_NAME}|{_TEST})(?:#{_NAME}|\.{_NAME}|{_TEST})*"
_ONE = rf"\s*{_STEP}(?:(?:\s*>\s*|\s+){_STEP})*\s*"
_GRAMMAR = rf"^{_ONE}(?:,{_ONE})*$"
_OUTSIDE_TESTS = r",(?![^\[]*\])"


def is_supported(query: Column) -> Column:
    return query.rlike(_GRAMMAR)


def selector_steps(query: Column) -> Column:
    """``array<array<step>>``: alternatives of a selector, each a chain of steps."""

    def test(source: Column) -> Column:
        value = F.trim(F.regexp_extract(source, r"=\s*(.*?)\s*\]$", 1))
        return F.struct(
            F.lower(F.regexp_extract(source, rf"\[\s*({_NAME})", 1)).alias("name"),
            F.regexp_extract(source, rf"^\[\s*{_NAME}\s*([*^$]?=)", 1).alias("op"),
            F.lower(F.trim(F.regexp_replace(value, r"^[\"']|[\"']$", ""))).alias("value"),
        )

    def step(source: Column) -> Column:
        bare = F.regexp_replace(source, r"\[[^\]]*\]", "")
        tag = F.lower(F.regexp_extract(bare, rf"^[>\s]*({_NAME})", 1))
        return F.struct(
            F.contains(bare, F.lit(">")).alias("child"),
            tag.alias("tag"),
            F.regexp_extract(bare, rf"#({_NAME})", 1).alias("id"),
            F.transform(F.regexp_extract_all(bare, F.lit(rf"\.({_NAME})"), F.lit(1)), F.lower)
            .alias("classes"),
            F.transform(F.regexp_extract_all(source, F.lit(r"\[[^\]]*\]"), F.lit(0)), test)
            .alias("tests"),
        )

    def chain(alternative: Column) -> Column:
        pieces = F.regexp_extract_all(
            F.trim(alternative), F.lit(rf"(?:\s*>\s*|\s+)?{_STEP}"), F.lit(0))
        return F.transform(pieces, step)

    return F.when(
        is_supported(query), F.transform(F.split(query, _OUTSIDE_TESTS), chain))


def _fulfils(node: Column, step: Column) -> Column:
    classes = F.concat(F.lit(" "), F.translate(F.lower(node["class"]), "\t\n\x0b\f\r", " " * 5), F.lit(" "))

    def passes(test: Column) -> Column:
        value = F.lower(F.trim(F.try_element_at(node["attrs"], test["name"])))
        return F.coalesce(
            F.when(test["op"] == "", value.isNotNull())
            .when(test["op"] == "=", value == test["value"])
            .when(test["op"] == "*=", value.contains(test["value"]))
            .when(test["op"] == "^=", value.startswith(test["value"]))
            .otherwise(value.endswith(test["value"])),
            F.lit(False),
        )

    return reduce(and_, [
        (step["tag"] == "") | (node["tag"] == step["tag"]),
        (step["id"] == "") | (node["id"] == step["id"]),
        (F.size(step["classes"]) == 0) | ((node["class"] != "") & F.forall(
            step["classes"], lambda c: F.contains(classes, F.concat(F.lit(" "), c, F.lit(" "))))),
        F.forall(step["tests"], passes),
    ])


_FEW = 8  # subtrees that each node of a step is compared with, instead of marking all nodes below them


def selected(nodes: Column, alternatives: Column) -> Column:
    """Nodes that match any alternative, in document order.

    Each step keeps one mark for every node, and the next step is one pass over the nodes: a child looks up its parent's
    mark, a descendant the mark of the ranges below all marked nodes, or these ranges themselves where they are few.
    Selectors of one step need no marks.
    """

    def follow(marks: Column, step: Column) -> Column:
        def below(tops: Column) -> Column:
            def inside(n: Column) -> Column:
                return F.exists(tops, lambda t: (t["pos"] < n["pos"]) & (n["pos"] <= t["last"]))

            return F.when(F.size(tops) <= _FEW, F.transform(nodes, lambda n: _fulfils(n, step) & inside(n))).otherwise(
                let(covered(tops, own=False), lambda above: F.transform(
                    nodes, lambda n: F.coalesce(F.get(above, n["pos"]), F.lit(False)) & _fulfils(n, step))))

        children = F.transform(nodes, lambda n: F.coalesce(F.get(marks, n["parent"]), F.lit(False)) & _fulfils(n, step))
        return F.when(step["child"], children).otherwise(
            let(F.filter(nodes, lambda n: F.get(marks, n["pos"])), below))

    def marked(steps: Column) -> Column:
        roots = let(F.get(steps, F.lit(0)), lambda s: F.transform(nodes, lambda n: _fulfils(n, s)))
        rest = F.slice(steps, F.lit(2), F.greatest(F.size(steps) - 1, F.lit(0)))
        return F.aggregate(rest, roots, follow)

    single = F.filter(nodes, lambda n: F.exists(alternatives, lambda steps: _fulfils(n, F.get(steps, F.lit(0)))))
    return F.when(F.forall(alternatives, lambda steps: F.size(steps) == 1), single).when(alternatives.isNotNull(), let(
        F.transform(alternatives, marked),
        lambda found: F.filter(nodes, lambda n: F.exists(found, lambda marks: F.get(marks, n["pos"])))))
