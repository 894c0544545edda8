"""URL filter: explicit rules, then association rules mined from labels."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth, PrefixSpan
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopcat.llm.common import lower_ascii, written

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
LEAST, CONFIDENCE = 10, 0.8  # bad pages that a rule matches, at least; share of bad ones among all it matches
LONGEST = 4  # tokens of a mined rule
SHORT = 16  # tokens of a row for FP-growth, which may list all 2^16 subsets of one


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host and path. Both are empty for null urls and urls without ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    return pages.withColumn("host", lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1))


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a url: host suffixes, path words, query keys. Digits become one token each run."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels), F.lit(1))), lambda n: F.concat(
        F.lit("h:"), F.array_join(F.slice(labels, -n, n), ".")))
    words = F.transform(
        F.filter(F.split(path, r"[/._\-]+"), lambda x: x != ""),
        lambda w: F.concat(F.lit("p:"), F.regexp_replace(F.lower(w), r"[0-9]+", "0")))
    keys = F.transform(
        F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#]+)"), F.lit(1)), lambda k: F.concat(F.lit("q:"), k))
    return F.array_distinct(F.concat(F.when(F.size(labels) > 0, suffixes).otherwise(F.array().cast("array<string>")), words, keys))


def mine(labelled: DataFrame, least: int = LEAST, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """(rules (rule_id, items), classes (token, rep)): sets of classes that foretell a block, from (items, bad).

    A rule needs ``least`` bad rows and the confidence. A url with all tokens of a rule is blocked, so rules
    with more tokens than another one are needless: tokens that are rules alone are counted and set apart, and
    FP-growth mines the bad rows for sets of two to ``LONGEST`` of the others. Tokens that the labelled rows hold
    always together count as one class, named by its smallest token: any of them stands for it. If a row has more
    than ``SHORT`` classes, PrefixSpan reads the sorted rows instead: its patterns of at most ``LONGEST`` single items
    are the sets of that size, and it lists no larger ones. Both find every set; they only propose, and support and
    confidence are counted over whole rows.
    """
    rows = written(labelled.select(
        F.monotonically_increasing_id().alias("row"), "items", F.col("bad").cast("long").alias("bad")), "labelled")
    seen = rows.select("row", "bad", F.explode("items").alias("token"))
    counts = written(seen.groupBy("token").agg(
        F.sum("bad").alias("hits"), F.count("*").alias("uses"),
        F.bit_xor(F.xxhash64("row")).alias("print"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("print2"),
    ).where(F.col("hits") >= least), "tokens")
    sure = F.col("hits") / F.col("uses") >= confidence
    alone = counts.where(sure).select("token", F.col("token").alias("rep"))
    same = ["hits", "uses", "print", "print2"]
    reps = counts.where(~sure).groupBy(*same).agg(F.min("token").alias("rep"))
    classes = written(counts.where(~sure).join(reps, same).select("token", "rep"), "classes")
    # Rows with the same classes are one row with two numbers.
    held = written(seen.join(classes, "token").groupBy("row").agg(
        F.max("bad").alias("bad"), F.sort_array(F.collect_set("rep")).alias("items")).where(F.size("items") > 1), "held")
    sets = written(held.groupBy("items").agg(F.sum("bad").alias("hits"), F.count("*").alias("uses")), "sets")
    bad = written(held.where("bad = 1").select("items"), "transactions")
    proposed = _frequent(bad, least).where(F.size("items").between(2, LONGEST))
    proposed = written(proposed.withColumn("rule_id", F.xxhash64("items")), "proposed")
    found = looked_up(sets, proposed, "items", "hits", "uses").groupBy("rule_id").agg(
        F.sum("hits").alias("hits"), F.sum("uses").alias("uses")).where((F.col("hits") >= least) & sure)
    several = proposed.join(found, "rule_id", "left_semi").select("rule_id", "items")
    rules = alone.select(F.xxhash64(F.array("token")).alias("rule_id"), F.array("token").alias("items")).union(several)
    return written(rules, "rules"), classes.union(alone)


def _frequent(rows: DataFrame, least: int) -> DataFrame:
    """(items): the sorted sets of up to ``LONGEST`` items that ``least`` of the rows hold, and maybe larger ones."""
    n, longest = rows.agg(F.count("*"), F.coalesce(F.max(F.size("items")), F.lit(0))).first()
    share = (least - 0.5) / max(least, n)
    if longest <= SHORT:
        return FPGrowth(itemsCol="items", minSupport=share).fit(rows).freqItemsets.select(F.sort_array("items").alias("items"))
    singles = rows.select(F.transform("items", lambda x: F.array(x)).alias("sequence"))
    return PrefixSpan(minSupport=share, maxPatternLength=LONGEST).findFrequentSequentialPatterns(singles).select(
        F.flatten("sequence").alias("items"))


def looked_up(sets: DataFrame, rules: DataFrame, *kept: str) -> DataFrame:
    """(kept.., rule_id): each row of ``sets`` with each rule whose tokens are all in its ``items``.

    Each rule is filed under its rarest token; a row looks up its tokens and then checks the
    rules found. Tokens no rule is filed under leave in the join, before anything is compared.
    """
    uses = sets.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    filed = rules.select("rule_id", "items", F.explode("items").alias("token")).join(uses, "token", "left").groupBy(
        "rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("m"), F.first("items").alias("needs")
    ).select("rule_id", "needs", F.col("m.token").alias("token"))
    also = [c for c in kept if c != "items"]
    looked = sets.select("items", *also, F.explode("items").alias("token")).join(filed, "token")
    return looked.where(F.size(F.array_except("needs", "items")) == 0).select(*kept, "rule_id")


def matched(pages: DataFrame, rules: DataFrame, classes: DataFrame, id_col: str) -> DataFrame:
    """(id): rows of ``pages`` (id, items; ids differ) with all classes of a rule, by an inverted index."""
    needed = rules.select(F.explode("items").alias("rep")).distinct()
    filed = written(classes.join(needed, "rep", "left_semi"), "filed")
    held = written(pages.select(id_col, F.explode("items").alias("token")).join(filed, "token").groupBy(id_col).agg(
        F.collect_set("rep").alias("items")), "classed")
    return looked_up(held, rules, id_col).select(id_col).distinct()


def explicit(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):  # longer ones overwrite
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def judged(pages: DataFrame, labels: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
           least: int = LEAST, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined): a verdict for every url.

    The longest explicit rule that fits decides. Else the url is blocked if a mined rule matches all its
    tokens, and allowed if none does. ``labels`` (doc_id, quality, toxic) are of the documents made from
    the pages with these ids: a page is bad if its document is toxic or has quality 0. Without labels
    nothing is mined. Null urls and ids are judged as well; repeated rows are judged alike.
    """
    parts = with_parts(pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")), "url")
    rows = written(parts.withColumn("items", tokens(F.col("host"), F.col("path"), F.col("url"))), "urls")
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("bad"))
    found, classes = mine(rows.join(marks, rows["page_id"] == marks["doc_id"]).select("items", "bad"), least, confidence)
    open_urls = rows.where(F.size("items") > 0).select("url", "items").dropDuplicates(["url"])
    blocked = matched(open_urls, found, classes, "url").select(F.col("url").alias("_url"))
    rule, verdict = explicit(F.col("host"), F.col("path"), rules)
    return (
        rows.join(blocked, rows["url"] == blocked["_url"], "left")
        .withColumn("mined", F.col("_url").isNotNull())
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(
            verdict, F.when(F.col("mined"), "block").otherwise("allow")).alias("verdict"), "mined")
    )
