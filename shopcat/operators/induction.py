"""Selector induction: one CSS selector per labelled group of nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.functions.text import let


def label_nodes(pages: DataFrame, rules: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row per node that a rule names: the page's columns, ``field``, ``node``, ``lineage``.

    ``rules`` maps a field to a condition on a node; a node may carry several fields. ``lineage``
    is the node and its ancestors, nearest first. Only labelled nodes leave the page's array.
    """
    nodes = F.col("nodes")

    def lineage(n: Column) -> Column:
        above = F.filter(nodes, lambda a: (a["pos"] <= n["pos"]) & (n["pos"] <= a["last"]))
        return F.reverse(F.transform(
            above, lambda a: F.struct(*[a[c].alias(c) for c in ("tag", "id", "class")])))

    def labelled(field: str, rule: Callable[[Column], Column]) -> Column:
        return F.transform(F.filter(nodes, rule), lambda n: F.struct(
            F.lit(field).alias("field"), n.alias("node"), lineage(n).alias("lineage")))

    hits = F.concat(*[labelled(field, rule) for field, rule in rules.items()])
    kept = [c for c in pages.columns if c not in ("nodes", "page_text", "parse_error")]
    return pages.select(*kept, F.explode(hits).alias("h")).select(*kept, "h.*")


def selector_of(lineage: Column) -> Column:
    """``#id`` or ``.class.names`` of the nearest named node, then ``>tag`` down to the node."""
    named = F.transform(lineage, lambda n: (n["id"] != "") | (F.trim(n["class"]) != ""))
    at = F.coalesce(F.nullif(F.array_position(named, True), F.lit(0)), F.size(lineage))

    def build(i: Column) -> Column:
        top = F.element_at(lineage, i.cast("int"))
        classes = F.array_distinct(F.split(F.trim(top["class"]), r"\s+"))
        base = (
            F.when(top["id"] != "", F.concat(F.lit("#"), top["id"]))
            .when(F.trim(top["class"]) != "", F.concat(F.lit("."), F.array_join(classes, ".")))
            .otherwise(top["tag"])
        )
        below = F.reverse(F.slice(lineage, F.lit(1), i.cast("int") - 1))
        return F.concat_ws(">", F.array(base), F.transform(below, lambda n: n["tag"]))

    return let(at, build)


def induce_selectors(labelled: DataFrame, *keys: str) -> DataFrame:
    """A selector per group of ``labelled(*keys, page_id, node, lineage)`` (domain and field).

    One node: its own selector. Several: the most frequent class text, written as it stands; when
    that is empty, the parent of the first node, followed by ``>`` and the most frequent tag if
    the parent has an id. Ties go to the smaller text. Frequencies are counted per value before
    the groups are formed, so a site with a third of all nodes is spread over its values.
    """
    keys = keys or ("domain", "field")
    first = F.struct("page_id", F.col("node.pos").alias("pos"), "lineage")
    values = F.explode(F.array(
        F.struct(F.lit("class").alias("kind"), F.col("node.class").alias("value")),
        F.struct(F.lit("tag").alias("kind"), F.col("node.tag").alias("value")),
    ))
    counted = (
        labelled.select(*keys, first.alias("first"), values.alias("v"))
        .groupBy(*keys, "v.kind", "v.value")
        .agg(F.count("*").alias("n"), F.min("first").alias("first"))
    )

    def mode(kind: str) -> Column:
        return F.min(F.when(F.col("kind") == kind, F.struct((-F.col("n")).alias("n"), "value")))

    groups = counted.groupBy(*keys).agg(
        mode("class").alias("by_class"), mode("tag").alias("by_tag"),
        F.sum(F.when(F.col("kind") == "tag", F.col("n"))).alias("members"),
        F.min("first").alias("first"),
    )
    own = F.col("first.lineage")
    above = F.slice(own, F.lit(2), F.greatest(F.size(own) - 1, F.lit(1)))
    parent = F.when(F.size(own) > 1, selector_of(above))
    selector = (
        F.when(F.col("members") == 1, selector_of(own))
        .when(F.col("by_class.value") != "", F.concat(F.lit("."), F.col("by_class.value")))
        .when(F.get(above, F.lit(0))["id"] != "",
              F.concat(parent, F.lit(">"), F.col("by_tag.value")))
        .otherwise(F.coalesce(parent, F.col("by_tag.value")))
    )
    return groups.select(*keys, "members", selector.alias("selector"))
