"""Column functions over urls and free text."""

from __future__ import annotations

from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from shopcat.functions.words import DIACRITICS


def built_once(f):
    """Cache a function that only builds columns of fixed names, for the running session.

    A column is a tree of JVM objects made by one call each, so building the extraction takes longer than
    planning it; the same trees serve any table.
    """
    known: dict = {}

    @wraps(f)
    def cached(*args):
        key = (SparkContext._active_spark_context.applicationId, *args)
        if key not in known:
            known[key] = f(*args)
        return known[key]

    return cached


def literal_map(entries: dict[str, str]) -> Column:
    """A constant map column."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def site_of(url: Column) -> Column:
    """Lower-cased host of ``url`` without a leading ``www.``; null without a scheme or host.

    Only the host must be well formed: an address with spaces, ``|`` or braces further on, or a host with
    ``_``, has a site as well.
    """
    # Possessive parts: what they take never has to be given back, so a match takes one pass over the address.
    host = F.nullif(F.lower(F.regexp_extract(
        url, r"^\s*+[A-Za-z][A-Za-z0-9+.-]*+://(?:[^/?#@]*+@)?(\[[0-9A-Fa-f:.]+\]|[^/?#:\s]++)(?::[0-9]*+)?(?:[/?#]|\s*$)", 1)), F.lit(""))
    return F.substring(host, F.when(F.startswith(host, F.lit("www.")), 5).otherwise(1), F.lit(2**31 - 1))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it in a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def absolute_url(href: Column, base: Column) -> Column:
    """``href`` resolved against ``base``; empty when that cannot be done."""

    def resolve(b: Column) -> Column:
        folder = F.concat(b["root"], F.when(b["path"] == "", "/").otherwise(
            F.regexp_replace(b["path"], r"[^/]*$", "")))
        joined = (
            F.when(b["root"] == "", F.lit(""))
            .when(b["href"].startswith("//"), F.concat(b["scheme"], b["href"]))
            .when(b["href"].startswith("/"), F.concat(b["root"], b["href"]))
            .when(b["href"].startswith("?"), F.concat(b["root"], b["path"], b["href"]))
            .when(b["href"].startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), b["href"]))
            .when(b["href"] == "", base)
            .otherwise(F.concat(folder, b["href"]))
        )
        return F.when(b["href"].rlike(_SCHEME), b["href"]).otherwise(
            let(joined, lambda u: F.when(u.contains("/."), _drop_dot_segments(u)).otherwise(u)))

    parts = F.struct(
        F.trim(href).alias("href"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1).alias("scheme"),
        F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1).alias("root"),
        F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1).alias("path"),
    )
    return F.when(href.isNotNull() & base.isNotNull(), let(parts, resolve))


def _drop_dot_segments(url: Column) -> Column:
    single = F.regexp_replace(F.regexp_replace(url, r"/(\./)+", "/"), r"/\.$", "/")
    ups = F.regexp_count(single, F.lit(r"/\.\.(?=/|$)"))
    # One "name/.." pair goes per step, so as many steps as there are ".." segments.
    folded = F.aggregate(
        F.sequence(F.lit(0), ups),
        single,
        lambda acc, _: F.regexp_replace(
            acc, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*(?:/[^/?#]+)*?)/(?!\.\.(?:/|$))[^/?#]+/\.\.(?:/|$)",
            "$1/"),
    )
    return F.regexp_replace(folded, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(?:/\.\.(?=/|$))+", "$1")


def keywords(*columns: Column) -> Column:
    """Sorted distinct words of the given texts: lower case, diacritics folded, nulls skipped.

    A word is a run of letters, marks and digits of any script.
    """
    text = F.translate(F.lower(F.concat_ws(" ", *columns)), *DIACRITICS)
    tokens = F.split(text, r"[^\p{L}\p{M}\p{N}]+")
    return F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t != "")))
