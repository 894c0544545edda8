"""Trees, selectors, field extraction and strategy choice on literal pages."""

import random
import re
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shopcat.functions.nodes import document_title, main_content, main_text, node_text
from shopcat.functions.selectors import is_supported, selected, selector_steps
from shopcat.operators.extract import heuristic_books, scrape, with_wrapper_fields
from shopcat.operators.induction import induce_selectors, label_nodes
from shopcat.schemas import RAW_PAGES, WRAPPER_VERSIONS, WRAPPERS
from shopcat.sources.html import _NodeBatch, with_nodes
from shopcat.sources.wrappers import publish_wrappers, read_wrappers

URL = "https://www.carti.example.ro/carte/1?x=2"


def pages(spark, *htmls, url=URL):
    return spark.createDataFrame(
        [(i, url, h, datetime(2024, 1, 1)) for i, h in enumerate(htmls)], RAW_PAGES)


def tree(spark, html, **options):
    row = with_nodes(pages(spark, html), **options).first()
    return row, [(n["tag"], n["parent"]) for n in row["nodes"]]


def texts(row):
    return [row["page_text"][n["text_start"]:n["text_end"]].strip() for n in row["nodes"]]


def test_inline_joins_and_blocks_separate(spark):
    row, _ = tree(spark, "<div><span>16</span><span>99</span><span>lei</span><p>a<br>b</p>c</div>")
    assert row["page_text"] == "1699lei a b c"


def test_implied_end_tags(spark):
    _, t = tree(spark, "<ul><li>a<li>b<ul><li>c</ul><li>d</ul><table><tr><td>1<td>2<tr><td>3</table>"
                       "<dl><dt>k<dd>v<dt>l</dl><select><option>x<option>y</select>")
    assert t == [("ul", -1), ("li", 0), ("li", 0), ("ul", 2), ("li", 3), ("li", 0), ("table", -1),
                 ("tr", 6), ("td", 7), ("td", 7), ("tr", 6), ("td", 10), ("dl", -1), ("dt", 12),
                 ("dd", 12), ("dt", 12), ("select", -1), ("option", 16), ("option", 16)]


def test_paragraph_closes_through_inline(spark):
    _, t = tree(spark, "<p><b>a<br><p>b<div>c</div></i>d")
    assert t == [("p", -1), ("b", 0), ("br", 1), ("p", -1), ("div", -1)]


def test_sanitize_and_raw_text(spark):
    html = "<title>A &amp; <b>B</b></title><script>if (a<b) '</p>'</script><style>p{}</style>" \
           "<!-- <p>no</p> --><noscript><p>n</p></noscript><p>y&nbsp; z&#8203;w</p>"
    row, t = tree(spark, html)
    assert t == [("title", -1), ("p", -1)]
    assert row["page_text"] == "A & <b>B</b> y zw"
    _, raw = tree(spark, html, sanitize=False)
    assert [x[0] for x in raw] == ["title", "script", "style", "noscript", "p", "p"]


@pytest.mark.parametrize("html", ["", "plain text", "<", "a < b", "<p", "<p class='x", "</p></div>",
                                  "<a title=\"x>y\" href=z>t</a>", "<p a=1 a=2 B>q</p>", "<svg><path/><g>t</g></svg>"])
def test_odd_markup_is_kept(spark, html):
    row, _ = tree(spark, html)
    n = len(row["nodes"])
    for i, node in enumerate(row["nodes"]):
        assert node["pos"] == i and node["parent"] < i <= node["last"] < n
    if html.startswith("<a"):
        assert row["nodes"][0]["attrs"] == {"title": "x>y", "href": "z"}
    if html.startswith("<p a"):
        assert row["nodes"][0]["attrs"] == {"a": "1", "b": ""}
    if html == "a < b":
        assert row["page_text"] == "a < b"


@pytest.mark.parametrize("html,text,error", [
    ("<p>a <img alt=Men's><p>lost</p><img alt=Women's> b</p>", "a lost b", None),
    ("<p title='a>b'>x</p><p title=\"it's\">y</p>", "x y", None),
    ("<p>x</p><a href='y", "x", "unterminated tag"),
    ("x <b", "x", "unterminated tag"), ("a < b", "a < b", None), ("x<!-- no end", "x", None),
    ("<p a=\"1>x</p><p>y</p>", "x y", None),
])
def test_quotes_and_unfinished_tags(spark, html, text, error):
    row, _ = tree(spark, html)
    assert (row["page_text"], row["parse_error"]) == (text, error)


def tokens(html):
    batch = _NodeBatch(True)
    batch.add(html)
    return list(zip(batch.tag, batch.own)), batch.attr_keys, batch.attr_values, batch.texts, batch.errors


def test_starts_looked_at_one_by_one_are_those_of_the_pattern(monkeypatch):
    from shopcat.sources import html as H

    rng = random.Random(1)
    ends, tag_end = [], H._tag_end
    monkeypatch.setattr(H, "_tag_end", lambda html, at, hopeless, last: ends.append((html, at, tag_end(html, at, hopeless, last))) or ends[-1][2])
    for _ in range(12_000):
        tokens("<a b='>" + "".join(rng.choice(["<a", "<p ", " b=", "=", '"', "'", ">", " ", "x", "</a>", "= '"]) for _ in range(rng.randint(3, 40))))
    pattern = re.compile(r"((?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')|=)*+)>")
    assert len(ends) > 1000
    for html, at, end in ends:
        m = pattern.match(html, at)
        assert (m.end() - 1 if m else -1) == end, (html, at)


def test_tags_that_come_again_are_read_once(monkeypatch):
    from shopcat.sources import html as H

    read, attributes = [], H._attributes
    monkeypatch.setattr(H, "_attributes", lambda source: read.append(source) or attributes(source))
    batch = _NodeBatch(True)
    for k in range(50):
        batch.add(f'<ul class="a b"><li title="x=y">A &amp; B</li><li><img alt="c" src="{k}.jpg"></li></ul>')
    assert len(read) == 2 + 50
    nodes, texts, _ = batch.arrays()
    assert [n["tag"] for n in nodes[49].as_py()] == ["ul", "li", "li", "img"] and texts[49].as_py() == "A & B"
    assert nodes[49].as_py()[0]["class"] == "a b" and nodes[49].as_py()[1]["attrs"] == [("title", "x=y")]
    assert nodes[7].as_py()[3]["attrs"] == [("alt", "c"), ("src", "7.jpg")]


def test_plain_tags_are_those_of_the_pattern():
    from shopcat.sources import html as H

    rng, plain = random.Random(3), 0
    parts = ["<a", "</b", " c", "=", '="', '"', "'", " ", "/", "x", "\n", '="x y"', "<", "= "]
    for _ in range(60_000):
        token = rng.choice(parts[:2]) + "".join(rng.choice(parts[2:]) for _ in range(rng.randint(0, 6))) + ">"
        m = H._PLAIN.fullmatch(token)
        if m:
            plain += 1
            for tail in ("", '">', "'>\" x", '<d e="f">'):
                full = H._TOKEN.match(token + tail)
                assert full.end() == len(token) and full["end"] == m[3], token
                assert m[3] or (full["start"], full["attrs"]) == (m[1], m[2]), token
    assert plain > 5000


def test_base_address(spark):
    def urls(head, url="https://a.ro/x/1"):
        row = heuristic_books(pages(spark, f"<head>{head}</head><img alt=c src=i.jpg>", url=url)).first()
        return row["canonical_url"], row["image_url"]

    assert urls("") == ("https://a.ro/x/1", "https://a.ro/x/i.jpg")
    assert urls("<base href='https://cdn.b.ro/y/'>") == ("https://a.ro/x/1", "https://cdn.b.ro/y/i.jpg")
    assert urls("<base href=' '><base href=../z/><base href='https://c.ro/'><link rel=canonical href=k>") == (
        "https://a.ro/z/k", "https://a.ro/z/i.jpg")


def test_unknown_locale_says_so(spark):
    html = "<title>t</title><ul><li>ISBN: 9786066733632</li></ul><div class=pret>12,50 lei</div>"
    for locale in ("ro", "sr-RS"):
        row = heuristic_books(pages(spark, html), locale=locale).first()
        assert row["offer"]["currency"] is None and row["errors"] == [f"no currency for locale: {locale}"]


@pytest.mark.parametrize("html", [
    "<div>" * 20_000 + "x", "<font>" * 20_000 + "<p>a" * 20_000, "<a " * 20_000, "<a b=\"" * 20_000, "<b>x<br>" * 20_000,
    "<p>" + "x<br>" * 50_000, "</i>" * 20_000 + "<i>" * 20_000, "<li><ul>" * 20_000, "<script>" * 20_000, "<" * 50_000,
    "<a b=\">\" " * 20_000, "<a b='>' c=\">\" " * 20_000, "<a =\"'=" * 20_000 + ">", "<" + "a=" * 50_000 + "\">" * 20_000,
])
def test_hostile_pages_take_linear_time(html):
    began = time.process_time()
    _NodeBatch(True).add(html)
    assert time.process_time() - began < 1


def test_hosts_and_words_of_any_kind_keep_their_offer(spark):
    html = "<title>Война и мир Straße</title><ul><li>ISBN: 9786066733632</li></ul><div class=pret>12,50 lei</div>"
    for url in ("https://www.a.ro/x|y", "https://a.ro/harry potter", "https://my_shop.ro/x"):
        row = heuristic_books(pages(spark, html, url=url)).first()
        assert row["offer"] is not None and row["errors"] == []
        assert {"война", "и", "мир", "straße"} <= set(row["keywords"])
    row = heuristic_books(pages(spark, html, url="no address")).first()
    assert row["offer"] is None and row["errors"] == ["no host in address: no address"]


def test_a_price_out_of_range_is_reported(spark):
    for tag in ("1234567890123456789012 lei", "9" * 50 + ",00 lei"):
        row = heuristic_books(pages(spark, f"<div class=pret>{tag}</div>")).first()
        assert row["offer"] is None and row["errors"] == [f"price out of range: {tag}"]
    row = heuristic_books(pages(spark, "<div class=pret>123456789012345 lei</div>")).first()
    assert str(row["offer"]["nominal_value"]) == "1234567890123.45"


def test_locale_decides_the_separators(spark):
    page = pages(spark, "<div class=pret>1,234.50</div>", "<div class=pret>1,234</div>")
    values = [str(r["offer"]["nominal_value"]) for r in heuristic_books(page, locale="en-US").orderBy("page_id").collect()]
    assert values == ["1234.50", "1.23"]  # a lone separator is read as the decimal one


def test_main_text_keeps_inline_markup_in_order(spark):
    html = ("<title>t</title><body><nav>n</nav><p>one <b>two</b> three<aside>no <nav>no</nav></aside> four</p>"
            "<footer>f</footer>five</body>")
    row = with_nodes(pages(spark, html, "<p>a<b>b</b>c</p>", None)).select(
        main_text(F.col("nodes"), F.col("page_text")).alias("m")).collect()
    assert [r["m"] for r in row] == ["one two three four five", "abc", None]


def test_selectors_are_joined_before_pages_are_parsed(spark):
    sites = [(f"s{i}.ro", f, f".{f}{i}", None) for i in range(800) for f in ("title", "isbn", "pricepoint", "format", "attributes", "image", "description")]
    wrappers = spark.createDataFrame([*sites, ("carti.example.ro", "title", "h1", None)], WRAPPERS)
    page = pages(spark, "<h1>a</h1><h2>b</h2>", "<h1>c</h1>")
    plan = with_wrapper_fields(page, wrappers)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("MapInArrow")[0]
    assert "Exchange hashpartitioning" not in above and "BroadcastHashJoin" in above
    forced = with_wrapper_fields(page, wrappers, max_bytes=1)
    above = forced._jdf.queryExecution().executedPlan().toString().split("MapInArrow")[0]
    assert "Exchange" not in above
    assert [r["fields"] for r in forced.orderBy("page_id").collect()] == [{"title": "a"}, {"title": "c"}]


def test_null_page_and_batches(spark):
    many = pages(spark, *[None if i % 3 == 0 else f"<p>{'x' * i}</p>" for i in range(50)])
    rows = with_nodes(many, slice_chars=100).orderBy("page_id").collect()
    assert [r["nodes"] is None for r in rows] == [i % 3 == 0 for i in range(50)]
    assert rows[7]["page_text"] == "x" * 7


def test_main_text_and_title(spark):
    html = "<html><head><title> T  t</title></head><body><nav>menu</nav><p>one <b>two</b></p>" \
           "<footer>f</footer></body></html>"
    n = with_nodes(pages(spark, html, "<p>x</p>"))
    rows = n.orderBy("page_id").select(
        main_text(F.col("nodes"), F.col("page_text")), document_title(F.col("nodes"), F.col("page_text"))).collect()
    assert [tuple(r) for r in rows] == [("one two", "T t"), ("x", "")]


SELECTOR_PAGE = """<div id="A" class="x Y"><p class="y"><b data-k="Vend">1</b></p><ul class="list"><li>2</li>
<li class="last y">3</li></ul></div><p>4 <i href="https://q/z.png">5</i></p>"""


@pytest.mark.parametrize("query, want", [
    ("li", ["2", "3"]), ("#A > p", ["1"]), ("#a p", []), (".y", ["1 2 3", "1", "3"]), ("div.x.y", ["1 2 3"]),
    ("div .y b", ["1"]), ("div > b", []), ("ul>li.last", ["3"]), ("[data-k]", ["1"]),
    ("b[data-k=vend]", ["1"]), ("[data-k^='ve']", ["1"]), ("[href$='.PNG']", ["5"]),
    ("[href*=q]", ["5"]), ("i, li", ["2", "3", "5"]), ("* > i", ["5"]), ("p i,#A li", ["2", "3", "5"]),
    ("[href='a,b'], i", ["5"]),
])
def test_selectors(spark, query, want):
    n = with_nodes(pages(spark, SELECTOR_PAGE)).withColumn("q", F.lit(query))
    got = n.select(F.transform(selected(F.col("nodes"), selector_steps(F.col("q"))),
                               lambda x: node_text(x, F.col("page_text")))).first()[0]
    assert got == want


def test_unsupported_selectors(spark):
    rows = spark.createDataFrame([("a:first-child",), ("a + b",), ("a > b",), ("",), ("> a",)], "q string")
    assert [r[0] for r in rows.select(is_supported(F.col("q"))).collect()] == [
        False, False, True, False, False]


def book_page(attributes, price='<div class="pret">Pret: 25,50 lei</div>'):
    return f"<html><head><title>Titlu</title></head><body>{price}{attributes}</body></html>"


def test_attribute_block(spark):
    block = "<ul><li>Editura: Polirom</li><li>ISBN: 9786066733632</li><li>Cartonata</li><li>Autor : Ana</li></ul>"
    # the ISBN alone in an element, with and without hyphens
    alone = "<ul><li>Editura: P</li><li>ISBN: <b>9786066733632</b></li></ul>"
    hyphens = "<ul><li>Editura: P</li><li>ISBN: <b>978-606-673-363-2</b></li></ul>"
    twice = "<p>Autor: A</p><p>Autor: B</p><p>cod produs|isbn: ISBN 9786066733632 </p>"
    rows = heuristic_books(pages(spark, *map(book_page, (block, alone, hyphens, twice)))).orderBy(
        "page_id").collect()
    assert [(r["isbn"], r["publisher"], r["format"], r["authors"]) for r in rows] == [
        ("9786066733632", "Polirom", "hardcover", "Ana"), ("9786066733632", "P", None, None),
        (None, None, None, None), ("9786066733632", None, None, "B")]
    assert float(rows[0]["offer"]["nominal_value"]) == 25.5
    assert rows[0]["offer"]["site"] == "carti.example.ro" and rows[0]["offer"]["currency"] == "RON"


def test_isbn_repeated_on_the_page(spark):
    # the last node in document order that contains the run decides, not the first
    html = "<div>9786066733632 <p>Editura: A</p></div><div><p>Editura: B</p><p>ISBN: 9786066733632</p></div>"
    assert heuristic_books(pages(spark, html)).first()["publisher"] == "B"


def test_heuristic_fields(spark):
    html = """<head><meta property="og:title" content=""><title>t</title><meta property="og:image" content="i.png">
      <link rel="canonical" href="/c/1"></head><body><p class="product-Autor">Ana &amp; Dan</p>
      <div id="descriere">no</div><div class="short-Descriere">yes</div><em class="in-stoc">În stoc limitat</em>
      <p>Vechi 12,30 lei</p></body>"""
    r = heuristic_books(pages(spark, html)).first()
    assert (r["title"], r["authors"], r["description"], r["image_url"], r["stock_phrase"]) == (
        "", "Ana & Dan", "yes", "i.png", "available")
    assert r["offer"] is None and r["price_tag"] == "Vechi 12,30 lei"
    assert r["canonical_url"] == "https://www.carti.example.ro/c/1"


def test_title_without_any_match_is_null(spark):
    r = heuristic_books(pages(spark, "<p>x</p>", '<p id="username">u</p>')).orderBy("page_id").collect()
    assert [x["title"] for x in r] == [None, "u"]


def test_first_price_in_document_order(spark):
    html = "<p>a 10,00 lei</p><p class=price>20 lei</p>"
    other = "<p class=price>Pret: vechi: 20 lei</p><p>a 10,00 lei</p>"
    rows = heuristic_books(pages(spark, html, other)).orderBy("page_id").collect()
    assert [r["price_tag"] for r in rows] == ["a 10,00 lei", "20 lei"]


def test_more_than_two_decimals_is_reported(spark):
    r = heuristic_books(pages(spark, "<p class=pret>1,2345 lei</p>", "<p class=pret>0,125 lei</p>")).orderBy(
        "page_id").collect()
    # three digits after the only comma make it a grouping separator
    assert [float(x["offer"]["nominal_value"]) for x in r] == [12345.0, 125.0]
    assert str(heuristic_books(pages(spark, "<p class=pret>0.1259 lei</p>")).first()["offer"]["nominal_value"]) == "0.13"


WRAPPER = [
    ("carti.example.ro", "title", "h1", None), ("carti.example.ro", "authors", ".none", None),
    ("carti.example.ro", "pricepoint", "b", None), ("carti.example.ro", "image", "img", "abs:src"),
    ("carti.example.ro", "availability", "a:hover", None), ("other.ro", "title", "p", None),
]


def test_selector_path(spark):
    wrappers = spark.createDataFrame(WRAPPER, WRAPPERS)
    html = "<h1>H</h1><b>1699lei</b><img src=x.png><p>Autor: A</p>"
    here = pages(spark, html)
    there = pages(spark, "<title>T</title><p class=pret>1699lei</p>", url="https://z.ro/a")
    both = scrape(here.union(there), wrappers, rounding="ceiling").orderBy("site").collect()
    assert [(r["strategy"], r["title"], float(r["offer"]["nominal_value"])) for r in both] == [
        ("selectors", "H", 17.0), ("heuristic", "T", 16.99)]
    assert both[0]["authors"] is None and both[0]["image_url"] == "https://www.carti.example.ro/carte/x.png"
    assert both[0]["errors"] == ["unsupported selector availability: a:hover"]
    fields = with_wrapper_fields(here, wrappers).first()["fields"]
    assert fields["title"] == "H" and fields["authors"] is None and "isbn" not in fields


def test_induction(spark):
    html = """<div id="top"><div class="a  b"><span>1</span></div><p><u>2</u></p></div>
      <table><tr><td class="k">3</td><td class="k">4</td><td class="z">5</td></tr></table>
      <ul id="list"><li>6</li><li>7</li></ul><ol class="plain"><li>8</li><li>9</li></ol>"""
    def own(*texts):
        return lambda n: n["own_text"].isin(*texts)

    got = induce_selectors(label_nodes(with_nodes(pages(spark, html)), {
        "class": lambda n: n["class"] == "a  b", "inside": own("1"), "deep": own("2"),
        "id": lambda n: n["id"] == "top", "modal": own("3", "4", "5"), "tags": own("6", "7"),
        "parent": own("8", "9")}), "field")
    assert {r["field"]: r["selector"] for r in got.collect()} == {
        "class": ".a.b", "inside": ".a.b>span", "deep": "#top>p>u", "id": "#top", "modal": ".k",
        "tags": "#list>li", "parent": ".plain"}


def _by_climbing(nodes, chain):
    """Positions that a chain of (tag, is child) selects, by looking at the ancestors of each node."""
    def matches(n, k):
        if chain[k][0] not in ("*", n["tag"]):
            return False
        if k == 0:
            return True
        up = n["parent"]
        while up >= 0:
            if matches(nodes[up], k - 1):
                return True
            if chain[k][1]:
                return False
            up = nodes[up]["parent"]
        return False

    return [n["pos"] for n in nodes if matches(n, len(chain) - 1)]


def test_selectors_on_random_trees(spark):
    rng = random.Random(5)

    def grow(depth):
        tag = rng.choice(("div", "b", "nav", "i"))
        inside = "".join(grow(depth - 1) for _ in range(rng.randint(0, 3))) if depth else ""
        return f"<{tag}>x{inside}</{tag}>"

    rows = with_nodes(pages(spark, "", *["".join(grow(6) for _ in range(3)) for _ in range(20)]))
    chains = [[(rng.choice(("div", "b", "i", "*")), rng.random() < 0.4) for _ in range(rng.randint(1, 4))] for _ in range(25)]
    queries = ["".join((" > " if child else " ") * (k > 0) + tag for k, (tag, child) in enumerate(c)) for c in chains]
    got = rows.select("nodes", F.transform(main_content(F.col("nodes")), lambda n: n["pos"]).alias("main"), *[
        F.transform(selected(F.col("nodes"), selector_steps(F.lit(q))), lambda n: n["pos"]).alias(f"q{k}")
        for k, q in enumerate(queries)]).collect()
    for row in got:
        nodes = row["nodes"]
        for k, chain in enumerate(chains):
            assert row[f"q{k}"] == _by_climbing(nodes, chain), queries[k]
        cut = {p for n in nodes if n["tag"] == "nav" for p in range(n["pos"], n["last"] + 1)}
        assert row["main"] == [n["pos"] for n in nodes if n["pos"] not in cut]
    assert sum(len(r["nodes"]) for r in got) > 500


@pytest.mark.parametrize("shape", ["<div><div><div>x</div></div></div>", "<div><nav>x</nav></div><b>y</b>"])
def test_selectors_take_linear_time(spark, shape):
    page = with_nodes(pages(spark, shape * 6700)).cache()
    nodes, steps = F.col("nodes"), selector_steps(F.lit("div div div, div > nav"))
    measure = page.select(F.size(selected(nodes, steps)).alias("n"), F.size(main_content(nodes)).alias("m"))
    measure.first()
    start = time.time()
    row = measure.first()
    assert time.time() - start < 5
    assert (row["n"], row["m"]) == ((6700, 20100) if "nav" not in shape else (6700, 13400))
    page.unpersist()


def test_selectors_of_the_time_of_a_page(spark):
    at = [datetime(2024, 1, d) for d in (1, 3, 5, 7)]
    page = spark.createDataFrame(
        [(i, f"https://{site}.ro/{i}", "<title>t</title><h1>h</h1><h2>g</h2>", t)
         for i, (site, t) in enumerate([("a", at[0]), ("a", at[1]), ("a", at[2]), ("a", at[3]), ("a", None), ("b", at[0]),
                                        ("b", at[1]), ("c", at[1]), (" ", at[1])])], RAW_PAGES)
    rows = [("a.ro", "title", "h1", None, at[1]), ("a.ro", "title", "h2", None, at[2]), ("a.ro", None, None, None, at[3]),
            ("b.ro", "title", "h1", None, None), ("b.ro", "isbn", "h1", None, at[1]), (None, "title", "h1", None, None)]
    wrappers = spark.createDataFrame(rows, WRAPPER_VERSIONS)
    want = [None, {"title": "h"}, {"title": "g"}, None, None, {"title": "h"}, {"isbn": "h"}, None, None]
    for limit in (64 << 20, 1):
        got = with_wrapper_fields(page, wrappers, limit).orderBy("page_id")
        assert [r["fields"] for r in got.collect()] == want
        assert not {"_from", "_until", "_site"} & set(got.columns) and got.columns.count("site") == 1
    assert scrape(page, wrappers.limit(0)).where("strategy = 'heuristic'").count() == 9
    # Neither way shuffles or parses pages a second time.
    plan = with_wrapper_fields(page, wrappers)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "BroadcastNestedLoopJoin" not in plan


def test_wrapper_store(spark, tmp_path):
    root, first = str(tmp_path / "w"), [("a.ro", "title", "h1", None)]
    assert read_wrappers(spark, root).count() == 0
    publish_wrappers(spark.createDataFrame(first, WRAPPERS), root)
    before = read_wrappers(spark, root)
    publish_wrappers(spark.createDataFrame([("a.ro", "title", "h2", None)], WRAPPERS), root, datetime(2024, 1, 2))
    assert [tuple(r) for r in before.collect()] == [(*first[0], None)]
    assert sorted((r["query"], r["valid_from"]) for r in read_wrappers(spark, root).collect()) == [
        ("h1", None), ("h2", datetime(2024, 1, 2))]
