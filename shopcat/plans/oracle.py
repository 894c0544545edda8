"""Expected results of the registered queries as DuckDB SQL over the same tables.

The SQL computes results directly from the tables the pages and observations are made of; it
parses no html.
"""

from __future__ import annotations

from shopcat.plans.queries import BATCH, JOB, KEYWORD, LOOKUPS, NEXT, SITE
from shopcat.sources.rendered import EPOCH

# Fixed values, written out here so that a wrong entry of the engine does not confirm itself. The
# pages show the phrases in this order.
AVAILABILITY = {
    "indisponibil": "DISCONTINUED",
    "discontinued": "DISCONTINUED",
    "in stoc": "IN_STOCK",
    "în stoc": "IN_STOCK",
    "disponibil": "IN_STOCK",
    "in_stock": "IN_STOCK",
    "instock": "IN_STOCK",
    "limitat": "LIMITED_AVAILABILITY",
    "stoc limitat": "LIMITED_AVAILABILITY",
    "limited": "LIMITED_AVAILABILITY",
    "limited_availability": "LIMITED_AVAILABILITY",
    "limitedavailability": "LIMITED_AVAILABILITY",
    "epuizat": "OUT_OF_STOCK",
    "la comandă": "OUT_OF_STOCK",
    "la comanda": "OUT_OF_STOCK",
    "comandă": "OUT_OF_STOCK",
    "comanda": "OUT_OF_STOCK",
    "out_of_stock": "OUT_OF_STOCK",
    "outofstock": "OUT_OF_STOCK",
    "precomandă": "PREORDER",
    "precomanda": "PREORDER",
    "preoder": "PREORDER",
}
PHRASES = tuple(AVAILABILITY)


def _check_digit(text: str) -> str:
    total = " + ".join(
        f"CAST(substr({text}, {i + 1}, 1) AS INTEGER) * {3 if i % 2 else 1}" for i in range(12))
    return f"CAST((10 - ({total}) % 10) % 10 AS VARCHAR)"


def _isbn13(key: str) -> str:
    body = f"('978' || lpad(CAST({key} AS VARCHAR), 9, '0'))"
    return f"({body} || {_check_digit(body)})"


def _hyphenated(isbn: str) -> str:
    cuts = ((1, 3), (4, 3), (7, 3), (10, 3), (13, 1))
    return " || '-' || ".join(f"substr({isbn}, {a}, {n})" for a, n in cuts)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _words(text: str) -> str:
    return (f"array_to_string(list_sort(list_distinct(string_split("
            f"trim(regexp_replace(lower({text}), '[^a-z0-9]+', ' ', 'g')), ' '))), ' ')")


_AVAILABILITY_CASE = "CASE {x} " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in AVAILABILITY.items()) + " END"

# One row per part: what its rendered page says.
_SHOP = f"""
WITH page AS (
  SELECT p_partkey AS k, p_name, p_brand, lower(p_type) AS kind,
         {_isbn13('p_partkey')} AS isbn13,
         'shop' || (p_partkey % 5) || '.example.ro' AS site,
         'https://www.shop' || (p_partkey % 5) || '.example.ro' AS root,
         p_name || ' - shop' || (p_partkey % 5) AS doc_title,
         CAST(p_retailprice AS DECIMAL(12,2)) AS p,
         {_list(PHRASES)}[CAST(p_partkey % {len(PHRASES)} + 1 AS INTEGER)] AS phrase,
         CASE p_type WHEN 'STANDARD' THEN 'hardcover' WHEN 'ECONOMY' THEN 'paperback'
              WHEN 'MEDIUM' THEN 'pdf' WHEN 'PROMO' THEN 'epub' WHEN 'LARGE' THEN 'audiobook' END AS fmt
  FROM part
), shop AS (
  SELECT *,
         k % 6 <> 5 AND NOT (k % 5 = 0 AND k % 3 = 0) AS block,
         root || '/carte/' || k AS url,
         CASE WHEN k % 4 = 0 THEN root || '/c/' || k ELSE root || '/carte/' || k END AS canonical,
         CAST(CASE k % 6 WHEN 4 THEN NULL WHEN 3 THEN p + 1000 ELSE p END AS DOUBLE) AS price,
         'Despre ' || p_name || ' & altele, ' || kind || '.' AS descr
  FROM page
), heuristic AS (
  SELECT k, site, 'heuristic' AS strategy,
         CASE WHEN k % 2 = 0 THEN p_name ELSE doc_title END AS title,
         CASE WHEN block THEN 'Ana ' || p_brand END AS authors,
         CASE WHEN block THEN isbn13 END AS isbn,
         descr AS description,
         CASE WHEN block THEN p_brand END AS publisher,
         CASE WHEN block THEN fmt END AS format,
         root || '/img/' || k || '.jpg' AS image_url,
         price, CAST(NULL AS VARCHAR) AS availability, canonical, doc_title, phrase
  FROM shop
), selector AS (
  SELECT k, site, 'selectors' AS strategy,
         p_name AS title,
         CASE WHEN k % 5 = 0 THEN 'Autor: Ana ' || p_brand ELSE 'Ana ' || p_brand END AS authors,
         CASE WHEN k % 6 <> 5 THEN isbn13 END AS isbn,
         descr AS description,
         CASE WHEN k % 5 = 1 THEN p_brand END AS publisher,
         CASE WHEN k % 5 = 1 THEN fmt END AS format,
         CASE WHEN k % 5 = 0 THEN '/img/' || k || '.jpg' ELSE root || '/pix.gif' END AS image_url,
         price, {_AVAILABILITY_CASE.format(x='phrase')} AS availability, canonical, doc_title, phrase
  FROM shop WHERE k % 5 < 2
), chosen AS (
  SELECT * FROM selector UNION ALL SELECT * FROM heuristic WHERE site NOT IN (SELECT site FROM selector)
), product AS (
  SELECT * FROM chosen WHERE isbn IS NOT NULL AND price IS NOT NULL
)
"""

# What the pages say to selectors that are edited halfway.
_EDITED = _SHOP + f""", half AS (
  SELECT max(k) // 2 AS h FROM shop
), edited AS (
  SELECT k, site, 'selectors' AS strategy, CASE WHEN k % 5 = 1 THEN doc_title ELSE p_name END AS title,
         'Ana ' || p_brand AS authors, CASE WHEN k % 6 <> 5 THEN isbn13 END AS isbn, p_brand AS publisher, price,
         {_AVAILABILITY_CASE.format(x='phrase')} AS availability
  FROM shop, half WHERE k >= h AND k % 5 IN (1, 2)
  UNION ALL SELECT k, site, strategy, title, authors, isbn, publisher, price, availability
  FROM chosen, half WHERE k < h
  UNION ALL SELECT k, site, strategy, title, authors, isbn, publisher, price, availability
  FROM heuristic, half WHERE k >= h AND k % 5 NOT IN (1, 2)
)
"""

_OFFER_COLUMNS = """
  k AS page_id, {price} AS nominal_value,
  CASE WHEN price IS NOT NULL THEN 'RON' END AS currency,
  CASE WHEN price IS NOT NULL THEN canonical END AS offer_url,
  CASE WHEN price IS NOT NULL THEN site END AS offer_site,
  CASE WHEN price IS NOT NULL THEN doc_title END AS offer_title,
  CASE WHEN price IS NOT NULL THEN availability END AS availability,
  CASE WHEN price IS NOT NULL THEN (k + {epoch}) * 1000000 ELSE -1 END AS retrieved_us
"""

_US = "epoch_us({})"

# One row per line: what the scrape of its part observed.
_SEEN = f"""
WITH line AS (
  SELECT *, {_isbn13('l_partkey')} AS isbn13,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents, {_US.format('l_shipdate')} AS us
  FROM lineitem
), seen AS (
  SELECT l_orderkey * 10 + l_linenumber AS page_id, l_partkey AS k, l_linestatus, isbn13, us,
         'https://www.s' || l_suppkey || '.example.ro/' || l_orderkey || '/' || l_linenumber || '/'
           || CAST(l_quantity AS INTEGER) || '/' || cents AS url,
         's' || l_suppkey || '.example.ro' AS site,
         CASE WHEN l_linenumber % 2 = 0 THEN 'T' || l_suppkey END AS title,
         'A' || repeat('a', CAST(l_suppkey % 7 AS BIGINT)) AS authors,
         CASE WHEN l_linenumber % 3 = 0 THEN substr(isbn13, 1, 12) ELSE isbn13 END AS isbn,
         CASE WHEN l_returnflag <> 'R' THEN 'D' || l_orderkey END AS description,
         CASE WHEN l_linestatus = 'F' THEN 'P' || l_suppkey END AS publisher,
         'i' || l_orderkey || '.jpg' AS image_url,
         'k' || (l_suppkey % 5) AS word1, 'p' || l_partkey AS word2,
         CAST(cents AS DOUBLE) / 100 AS value
  FROM line
)
"""

_MERGED = _SEEN + """, word AS (
  SELECT k, word1 AS w FROM seen UNION SELECT k, word2 FROM seen
), words AS (
  SELECT k, string_agg(w, ' ' ORDER BY w) AS keywords FROM word GROUP BY k
), books AS (
  SELECT k,
    CASE WHEN bool_or(isbn = isbn13) THEN max(isbn13) ELSE max(isbn) END AS isbn,
    arg_min(title, {t: us, p: page_id, u: url}) FILTER (WHERE title IS NOT NULL) AS title,
    arg_min(authors, {n: -length(authors), t: us, p: page_id, u: url}) AS authors,
    arg_min(description, {n: -length(description), t: us, p: page_id, u: url})
      FILTER (WHERE description IS NOT NULL) AS description,
    arg_min(publisher, {t: us, p: page_id, u: url}) FILTER (WHERE publisher IS NOT NULL) AS publisher,
    arg_min(image_url, {t: us, p: page_id, u: url}) AS image_url,
    string_agg(DISTINCT isbn, ' ' ORDER BY isbn) AS isbns,
    arg_max(value, {t: us, p: page_id, u: url}) AS best_value,
    max(us) AS best_us,
    arg_max(url, {t: us, p: page_id, u: url}) AS best_url
  FROM seen GROUP BY k
)
SELECT isbn, title, authors, description, publisher, image_url, keywords, isbns, best_value, best_us,
       best_url
FROM books JOIN words USING (k)
"""

_BEST = _SEEN + """
SELECT isbn, arg_max(value, {t: us, p: page_id, u: url}) AS value, max(us) AS retrieved_us,
       arg_max(url, {t: us, p: page_id, u: url}) AS url
FROM seen GROUP BY isbn
"""

_JOBS = f"""
WITH jobs AS (
  SELECT 'j' || o_orderkey AS job_id, 's' || (o_custkey * 7) || '.example.ro' AS domain,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'CRAWL' ELSE 'SCRAPE' END AS type,
         CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'FINISHED' ELSE 'STOPPED' END AS status,
         {_US.format('o_orderdate')} AS start_us,
         CASE WHEN o_orderstatus = 'F' THEN {_US.format('o_orderdate')} + 86400000000 END AS end_us
  FROM orders
)
"""

_ATTEMPTS = """
WITH rows AS (
  SELECT 'j' || (user_id % 10) AS job_id, 'd' || (user_id % 10) AS domain,
         'u' || user_id || '/' || (event_id % 20) AS url, value > 20 AS ok,
         CASE WHEN event_type = 'purchase' THEN 'PRODUCT' ELSE 'JUNK' END AS type,
         event_id, event_type, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS ms
  FROM events
)
"""

# The pattern without its look-ahead; equal once the length is 10 or 13.
_ISBN_RUN = r"\d+[- ]?\d+[- ]?\d+[- ]?\d*[- ]?[\dxX]"
_CLEAN = r"regexp_replace(html, '<script>.*?</script>|<style>.*?</style>|<!--.*?-->', '', 'gs')"

_TITLE = (r"trim(regexp_replace(replace(replace(replace(replace(regexp_extract(html, "
          r"'<title>(.*?)</title>', 1), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), "
          r"'\s+', ' ', 'g'))")

ORACLE: dict[str, str] = {
    "page_title": f"SELECT page_id, {_TITLE} AS title, {_TITLE} AS page_title FROM pages",
    "page_site": r"""
        SELECT page_id, regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/:?#]+)', 1) AS site
        FROM pages""",
    "url_sites": """
        SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'my_shop' || (p_partkey % 5) || '.ro'
            WHEN 3 THEN '[2001:db8::1]' WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN NULL
            ELSE 'shop' || (p_partkey % 5) || '.example.ro' END AS site
        FROM part""",
    "shop_main_text": _SHOP + """
        SELECT k AS page_id, concat_ws(' ', shop.p_name,
          CASE k % 6 WHEN 4 THEN NULL WHEN 1 THEN 'Pret: ' || replace(CAST(p AS VARCHAR), '.', ',') || ' lei'
            WHEN 2 THEN 'Pret: ' || replace(CAST(p AS VARCHAR), '.', '') || 'lei'
            WHEN 3 THEN 'Pret: 1,' || substr(CAST(p + 1000 AS VARCHAR), 2) || ' lei'
            ELSE 'Pret: ' || CAST(p AS VARCHAR) || ' lei' END,
          phrase, 'Editura: ' || shop.p_brand,
          CASE WHEN k % 6 <> 5 THEN 'ISBN: ' || CASE WHEN k % 3 = 0 THEN """ + _hyphenated("isbn13") + """ ELSE isbn13 END END,
          'Format: ' || CASE kind WHEN 'standard' THEN 'Cartonata' WHEN 'economy' THEN 'Necartonata'
            WHEN 'medium' THEN 'PDF' WHEN 'promo' THEN 'ePub' WHEN 'large' THEN 'Audiobooks' ELSE 'brosata' END,
          'Autor: Ana ' || shop.p_brand, descr) AS main_text
        FROM shop""",
    "page_tags": f"""
        WITH t AS (SELECT page_id, unnest(regexp_extract_all(lower({_CLEAN}),
                     '<([a-z][a-z0-9]*)[^>]*>', 1)) AS tag FROM pages)
        SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag""",
    "isbn_scan": rf"""
        WITH m AS (SELECT doc_id, regexp_extract_all(text, '{_ISBN_RUN}') AS runs FROM documents),
        x AS (SELECT doc_id, i, regexp_replace(runs[i], '[\s-]', '', 'g') AS isbn
              FROM (SELECT doc_id, runs, unnest(range(1, len(runs) + 1)) AS i FROM m)),
        g AS (SELECT doc_id, count(*) AS n, string_agg(isbn, ' ' ORDER BY i) AS isbns
              FROM x WHERE length(isbn) IN (10, 13) GROUP BY doc_id)
        SELECT doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n, coalesce(isbns, '') AS isbns
        FROM documents LEFT JOIN g USING (doc_id)""",
    "isbn_coerced": f"""
        WITH i AS (SELECT p_partkey, {_isbn13('p_partkey')} AS isbn FROM part)
        SELECT p_partkey,
          CASE p_partkey % 5 WHEN 2 THEN substr(isbn, 5, 9) WHEN 3 THEN isbn || '(pdf'
            WHEN 4 THEN ':' || isbn ELSE isbn END AS isbn,
          CASE p_partkey % 5 WHEN 2 THEN substr(isbn, 5, 9) || 'X' WHEN 3 THEN isbn || '(pdf'
            WHEN 4 THEN ':' || isbn ELSE isbn END AS strict_isbn
        FROM i""",
    "shop_books": _SHOP + f"""
        SELECT k AS page_id, title, authors, isbn, description, image_url, doc_title AS page_title,
          {_words("concat_ws(' ', title, authors, isbn, publisher, format)")} AS keywords
        FROM heuristic""",
    "shop_formats": _SHOP + "SELECT k AS page_id, format FROM heuristic",
    "shop_publishers": _SHOP + "SELECT k AS page_id, publisher FROM heuristic",
    "shop_offers": _SHOP + f"SELECT {_OFFER_COLUMNS.format(price='price', epoch=EPOCH)} FROM heuristic",
    "stock_phrase": _SHOP + """
        SELECT k AS page_id,
          CASE WHEN contains(lower(phrase), 'in stoc') OR contains(lower(phrase), 'în stoc')
                 OR contains(lower(phrase), 'limitat') THEN 'available'
               WHEN contains(lower(phrase), 'indisponibil') OR contains(lower(phrase), 'comanda')
                 THEN 'unavailable' END AS stock_phrase
        FROM shop""",
    "based_urls": _SHOP + """,
        based AS (SELECT *, CASE WHEN k % 3 = 0 THEN 'https://cdn.example.ro' ELSE root END AS base FROM shop)
        SELECT k AS page_id, CASE WHEN k % 4 = 0 THEN base || '/c/' || k ELSE root || '/carte/' || k END AS canonical_url,
               base || '/img/' || k || '.jpg' AS image_url FROM based""",
    "encoded_pages": _SHOP + """
        SELECT k AS page_id, CASE k % 4 WHEN 0 THEN 'utf-8' WHEN 1 THEN 'utf-16-be' WHEN 2 THEN 'iso8859-1' ELSE 'iso8859-2' END AS charset,
          title, isbn, replace(description, 'Despre ', 'Despre câine înalt, ') AS description FROM heuristic""",
    "canonical_urls": _SHOP + "SELECT k AS page_id, canonical AS canonical_url FROM shop",
    "price_vectors": """
        WITH c AS (SELECT l_orderkey, l_linenumber AS v,
                     CAST(round(l_extendedprice * 100) AS BIGINT) AS n FROM lineitem),
        p AS (SELECT l_orderkey, v, n // 100 AS whole, CAST(n // 100 AS VARCHAR) AS w,
                CAST(n // 100000 AS VARCHAR) AS k3,
                lpad(CAST((n // 100) % 1000 AS VARCHAR), 3, '0') AS d3,
                lpad(CAST(n % 100 AS VARCHAR), 2, '0') AS d2, CAST(n AS DOUBLE) / 100 AS value FROM c)
        SELECT l_orderkey,
          CASE v WHEN 1 THEN w || '.' || d2 || ' lei' WHEN 2 THEN w || ',' || d2 || ' lei'
            WHEN 3 THEN w || d2 || 'lei' WHEN 4 THEN k3 || ',' || d3 || '.' || d2 || ' lei'
            WHEN 5 THEN k3 || '.' || d3 || ',' || d2 || ' lei' WHEN 6 THEN k3 || ',' || d3 || ' lei'
            ELSE k3 || '.' || d3 || ' lei' END AS tag,
          CASE v WHEN 6 THEN CAST(whole AS DOUBLE) WHEN 7 THEN CAST(whole AS DOUBLE) / 1000
            ELSE value END AS value,
          CASE v WHEN 6 THEN CAST(whole AS DOUBLE) WHEN 7 THEN CAST(whole AS DOUBLE) / 1000
            WHEN 3 THEN ceil(value) ELSE value END AS ceiling_value
        FROM p""",
    "availability_map": f"""
        WITH e AS (SELECT event_id, lower({_list(PHRASES + ('preorder', 'in stock', 'altceva'))}
                     [CAST(event_id % {len(PHRASES) + 3} + 1 AS INTEGER)]) AS phrase FROM events),
        d(phrase, availability) AS (VALUES {", ".join(f"('{k}', '{v}')" for k, v in AVAILABILITY.items())})
        SELECT event_id, availability FROM e LEFT JOIN d USING (phrase)""",
    "wrapper_books": _SHOP + """
        SELECT k AS page_id, title, authors, isbn, description, publisher, format, image_url
        FROM selector""",
    "wrapper_offers": _SHOP + f"""
        SELECT {_OFFER_COLUMNS.format(
            price="CASE WHEN k % 6 = 2 THEN ceil(price) ELSE price END", epoch=EPOCH)}
        FROM selector""",
    "strategies": _SHOP + """
        SELECT k AS page_id, site, strategy, title, authors, isbn, publisher, format, image_url,
          price AS nominal_value, CASE WHEN price IS NOT NULL THEN availability END AS availability
        FROM chosen""",
    "wrapper_versions": _EDITED + """
        SELECT k AS page_id, site, strategy, title, authors, isbn, publisher,
          price AS nominal_value, CASE WHEN price IS NOT NULL THEN availability END AS availability
        FROM edited""",
    "selector_modes": """
        WITH page AS (SELECT p_partkey AS k, 'shop' || (p_partkey % 5) || '.example.ro' AS domain FROM part),
        label AS (
          SELECT domain, 'pricepoint' AS field, 'amount' AS class, 'span' AS tag, '.amount' AS own,
                 '.pret' AS parent FROM page WHERE k % 6 <> 4
          UNION ALL SELECT domain, 'title', '', 'h1', '#produs>h1', '#produs>h1' FROM page
          UNION ALL SELECT domain, 'attributes', CASE WHEN i = 4 AND k % 5 = 0 THEN 'scris-de' ELSE '' END,
                 'li', '', '.detalii' FROM page, (SELECT unnest([1, 2, 3, 4]) AS i) WHERE i <> 2 OR k % 6 <> 5),
        cls AS (SELECT domain, field, class, count(*) AS n, max(tag) AS tag, max(own) AS own,
                  max(parent) AS parent FROM label GROUP BY ALL),
        top AS (SELECT domain, field, CAST(sum(n) AS BIGINT) AS members,
                  arg_min(class, {n: -n, c: class}) AS class, max(own) AS own, max(parent) AS parent
                FROM cls GROUP BY domain, field)
        SELECT domain, field, members,
          CASE WHEN members = 1 THEN own WHEN class <> '' THEN '.' || class ELSE parent END AS selector
        FROM top""",
    "page_types": """
        SELECT p_partkey AS page_id,
          CASE WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 2 ELSE 1 END AS attempts,
          CASE WHEN p_partkey % 11 = 0 THEN 'UNREACHABLE' WHEN p_partkey % 6 = 5 THEN 'JUNK'
               WHEN p_partkey % 6 = 4 THEN 'UNAVAILABLE' ELSE 'PRODUCT' END AS type
        FROM part""",
    "frontier_latest": """
        WITH e AS (
          SELECT 'u' || user_id AS url, 'd' || (user_id % 5) AS domain, event_id, epoch_us(ts) AS us,
            event_type <> 'error' AS reached,
            CASE event_type WHEN 'error' THEN 'UNREACHABLE' WHEN 'signup' THEN 'JUNK'
              WHEN 'view' THEN 'UNAVAILABLE' ELSE 'PRODUCT' END AS type
          FROM events),
        l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us DESC) AS r FROM e),
        s AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us DESC) AS r FROM e WHERE reached),
        f AS (SELECT url, min(us) AS us FROM e GROUP BY url)
        SELECT l.url, l.domain, coalesce('c' || s.event_id, 'stored') AS canonical_url,
          coalesce('t' || s.event_id, 'stored') AS title, l.type, coalesce(s.us, f.us) AS retrieved_us,
          coalesce('job' || (s.event_id % 3), 'job9') AS last_job
        FROM l JOIN f USING (url) LEFT JOIN s ON s.url = l.url AND s.r = 1 WHERE l.r = 1""",
    "frontier_late": """
        WITH e AS (
          SELECT 'u' || user_id AS url, user_id, 'd' || (user_id % 5) AS domain, event_id, epoch_us(ts) AS us,
            event_type <> 'error' AS reached,
            CASE event_type WHEN 'error' THEN 'UNREACHABLE' WHEN 'signup' THEN 'JUNK'
              WHEN 'view' THEN 'UNAVAILABLE' ELSE 'PRODUCT' END AS type
          FROM events),
        l AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us DESC) AS r FROM e),
        s AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY us DESC) AS r FROM e WHERE reached),
        f AS (SELECT url, min(us) AS low, max(us) AS high FROM e GROUP BY url)
        SELECT l.url, l.domain, CASE WHEN user_id % 2 = 0 THEN 'stored' ELSE coalesce(c, 'stored') END AS canonical_url,
          CASE WHEN user_id % 2 = 0 THEN 'stored' ELSE coalesce(t, 'stored') END AS title,
          CASE WHEN user_id % 2 = 0 THEN 'PRODUCT' ELSE l.type END AS type,
          CASE WHEN user_id % 2 = 0 THEN high + 86400000000 ELSE coalesce(s_us, low) END AS retrieved_us,
          CASE WHEN user_id % 2 = 0 THEN 'job9' ELSE coalesce(j, 'job9') END AS last_job
        FROM l JOIN f USING (url) LEFT JOIN (SELECT url AS s_url, us AS s_us, 'c' || event_id AS c,
          't' || event_id AS t, 'job' || (event_id % 3) AS j FROM s WHERE r = 1) ON s_url = l.url WHERE l.r = 1""",
    "frontier_resume": """
        SELECT 'e' || event_id AS url, CASE WHEN user_id % 3 = 1 THEN 'PRODUCT' END AS type,
          CASE WHEN event_id % 4 > 0 THEN 'job' || (event_id % 4) END AS last_job,
          epoch_us(ts) AS retrieved_us
        FROM events WHERE event_type = 'click' AND user_id % 3 <> 0 AND event_id % 4 <> 1""",
    "frontier_next": f"""
        WITH f AS (
          SELECT 'e' || event_id AS url, event_type AS domain, CASE WHEN user_id % 3 = 1 THEN 'PRODUCT' END AS type,
            CASE WHEN event_id % 50 > 0 THEN epoch_us(date_trunc('hour', ts)) END AS retrieved_us,
            CASE WHEN event_id % 4 > 0 THEN 'job' || (event_id % 4) END AS last_job
          FROM events WHERE user_id % 3 <> 0),
        r AS (
          SELECT *, row_number() OVER (PARTITION BY domain ORDER BY retrieved_us NULLS FIRST, url) AS place
          FROM f WHERE last_job IS DISTINCT FROM 'job' || (length(domain) % 4))
        SELECT domain, place, url, type, last_job, retrieved_us FROM r WHERE place <= {NEXT}""",
    "fetch_fold": """
        SELECT event_type AS job_id, 'u' || user_id AS url,
          CAST(bool_or(value > 40) AS INTEGER) AS reached, count(*) AS attempts
        FROM events WHERE event_id % 3 < 2 GROUP BY event_type, user_id""",
    "merged_books": _MERGED,
    "catalog_upsert": _MERGED,
    "catalog_versions": f"""
        SELECT *, 'last' AS version FROM ({_MERGED})
        UNION ALL SELECT *, 'first' FROM ({_MERGED.replace("FROM lineitem", "FROM lineitem WHERE l_linestatus = 'F'")})""",
    "isbn_match": _SEEN + f""",
        stored AS (SELECT isbn AS stored_isbn, min(page_id) AS book_id FROM seen GROUP BY isbn),
        new AS (SELECT {_isbn13('p_partkey')} AS isbn FROM part),
        k AS (SELECT isbn, 'exact' AS match, isbn AS stored_isbn FROM new
              UNION ALL SELECT isbn, 'prefix', left(isbn, -1) FROM new)
        SELECT isbn, match, stored_isbn, book_id FROM k JOIN stored USING (stored_isbn)""",
    "best_offer": _BEST,
    "offer_history": _SEEN + """,
        o AS (SELECT DISTINCT isbn, site, url, us, value FROM seen),
        old AS (SELECT DISTINCT url, us, value FROM seen WHERE l_linestatus = 'F')
        SELECT isbn, site, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total
        FROM o ANTI JOIN old USING (url, us, value) GROUP BY isbn, site""",
    "book_history": _SEEN + """
        SELECT CASE WHEN bool_or(isbn = isbn13) THEN max(isbn13) ELSE max(isbn) END AS book_isbn,
          count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM seen GROUP BY k""",
    "distinct_offers": _SEEN + """
        SELECT DISTINCT url, site, us AS retrieved_us, value, 'RON' AS currency FROM seen""",
    "distinct_books": _SEEN + """
        SELECT isbn, title, authors, publisher, word1 || ' ' || word2 AS keywords, max(us) AS best_us
        FROM seen GROUP BY isbn, title, authors, publisher, word1, word2""",
    "keyword_lookup": _SHOP + f"""
        SELECT k AS page_id, title FROM heuristic
        WHERE list_contains(string_split(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g'), ' '),
                            '{KEYWORD}')""",
    "site_offers": _SEEN + f"SELECT url, us AS retrieved_us, value FROM seen WHERE site = '{SITE}'",
    "book_lookup": f"""
        WITH m AS ({_MERGED})
        SELECT 'title' AS field, isbn, title FROM m WHERE title = '{LOOKUPS["title"]}'
        UNION ALL SELECT 'authors', isbn, title FROM m WHERE authors = '{LOOKUPS["authors"]}'
        UNION ALL SELECT 'isbn', isbn, title FROM m WHERE isbn = '{LOOKUPS["isbn"]}'
        UNION ALL SELECT 'best_offer_site', isbn, title FROM m WHERE contains(best_url, '//www.{SITE}/')""",
    "indexed_lookup": f"""
        WITH m AS ({_MERGED})
        SELECT 'title' AS field, isbn, title FROM m WHERE title = '{LOOKUPS["title"]}'
        UNION ALL SELECT 'authors', isbn, title FROM m WHERE authors = '{LOOKUPS["authors"]}'
        UNION ALL SELECT 'isbn', isbn, title FROM m WHERE isbn = '{LOOKUPS["isbn"]}'
        UNION ALL SELECT 'best_offer_site', isbn, title FROM m WHERE contains(best_url, '//www.{SITE}/')""",
    "job_lookup": _JOBS + f"SELECT job_id, domain, status FROM jobs WHERE job_id = '{JOB}'",
    "catalog_roundtrip": _SHOP + """
        SELECT isbn, title, authors, publisher, site, price AS nominal_value, availability FROM product""",
    "jobs_active": _JOBS + """
        SELECT job_id, domain, start_us FROM jobs WHERE type = 'SCRAPE' AND status = 'ACTIVE'""",
    "jobs_closed": _JOBS + """,
        c AS (SELECT 'j' || user_id AS job_id, max(epoch_us(ts)) AS us FROM events GROUP BY user_id)
        SELECT job_id, CASE WHEN us IS NOT NULL THEN 'FINISHED' ELSE status END AS status,
          coalesce(us, end_us, -1) AS end_us
        FROM jobs LEFT JOIN c USING (job_id)""",
    "job_durations": _JOBS + """
        SELECT job_id, domain, coalesce((end_us - start_us) // 1000, -1) AS total_ms FROM jobs""",
    "job_triage": _JOBS + """,
        active AS (SELECT domain AS site, min(job_id) AS active_job FROM jobs
                   WHERE type = 'SCRAPE' AND status = 'ACTIVE' GROUP BY domain),
        r AS (SELECT event_id AS request_id, epoch_us(ts) AS us,
                CASE WHEN event_id % 7 IN (5, 6) OR event_id % 7 = 3 AND event_id % 3 = 2
                  THEN 's' || user_id || '.example.ro' END AS site,
                CASE WHEN event_id % 7 = 3 THEN lpad('' || event_id, 24, '0') ELSE '' || event_id END AS own_job
              FROM events),
        w AS (SELECT site, min({t: us, i: request_id}) AS f,
                arg_min(own_job, {t: us, i: request_id}) AS first_job
              FROM r WHERE site IS NOT NULL GROUP BY site)
        SELECT request_id, r.site,
          CASE WHEN r.site IS NULL THEN 400 WHEN active_job IS NOT NULL OR w.f.i <> request_id THEN 409
            ELSE 202 END AS status,
          CASE WHEN r.site IS NOT NULL THEN coalesce(active_job, first_job) END AS job_id
        FROM r LEFT JOIN w ON w.site = r.site LEFT JOIN active a ON a.site = r.site""",
    "job_counters": _ATTEMPTS + """,
        p AS (SELECT job_id, domain, url, count(*) AS n, bool_or(ok) AS ok FROM rows GROUP BY ALL),
        f AS (SELECT job_id, domain, count(*) AS pages_requested, CAST(sum(n) AS BIGINT) AS requests,
                count(*) FILTER (WHERE ok) AS pages_reached FROM p GROUP BY ALL),
        s AS (SELECT job_id, domain, count(*) FILTER (WHERE type = 'PRODUCT') AS pairs_found
              FROM rows GROUP BY ALL)
        SELECT * FROM f JOIN s USING (job_id, domain)""",
    "job_timings": _ATTEMPTS + """,
        t AS (SELECT job_id, domain, count(*) AS n,
                count(*) FILTER (WHERE event_type <> 'error') AS reached,
                count(*) FILTER (WHERE type = 'PRODUCT') AS paired,
                CAST(sum(ms) AS BIGINT) AS d, CAST(sum(ms * 2) AS BIGINT) AS p,
                CAST(sum(ms % 97) AS BIGINT) AS c, CAST(sum(ms % 13) AS BIGINT) AS q
              FROM rows GROUP BY job_id, domain)
        SELECT job_id, domain, d AS download_total_ms, p AS processing_total_ms,
          c AS crawl_persist_total_ms, q AS product_persist_total_ms,
          CAST(d AS DOUBLE) / nullif(n, 0) AS download_mean_ms,
          CAST(p AS DOUBLE) / nullif(reached, 0) AS processing_mean_ms,
          CAST(c AS DOUBLE) / nullif(reached, 0) AS crawl_persist_mean_ms,
          CAST(q AS DOUBLE) / nullif(paired, 0) AS product_persist_mean_ms
        FROM t""",
    "job_batches": _ATTEMPTS + f""",
        n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1)
                // {BATCH} AS batch FROM rows),
        b AS (SELECT event_type AS job_id, CAST(batch AS INTEGER) AS batch, count(*) AS pages,
                sum(event_id % 2 + 1) AS requests, count(*) FILTER (WHERE ok) AS reached,
                count(*) FILTER (WHERE type = 'PRODUCT') AS pairs FROM n GROUP BY event_type, batch)
        SELECT job_id, batch, pages, CAST(sum(pages) OVER w AS BIGINT) AS pages_so_far,
          CAST(sum(requests) OVER w AS BIGINT) AS requests_so_far,
          CAST(sum(reached) OVER w AS BIGINT) AS reached_so_far,
          CAST(sum(pairs) OVER w AS BIGINT) AS pairs_so_far
        FROM b WINDOW w AS (PARTITION BY job_id ORDER BY batch)""",
    "stream_job_batches": _ATTEMPTS + f""",
        n AS (SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY us, event_id) - 1)
                // {BATCH} AS batch FROM rows),
        b AS (SELECT event_type AS job_id, CAST(batch AS INTEGER) AS batch, count(*) AS pages,
                count(*) FILTER (WHERE us <= (SELECT max(us) FROM rows) - 3 * 86400000000) AS final,
                sum(event_id % 2 + 1) AS requests, count(*) FILTER (WHERE ok) AS reached,
                count(*) FILTER (WHERE type = 'PRODUCT') AS pairs FROM n GROUP BY event_type, batch)
        SELECT job_id, batch, pages, CAST(sum(pages) OVER w AS BIGINT) AS pages_so_far,
          CAST(sum(requests) OVER w AS BIGINT) AS requests_so_far,
          CAST(sum(reached) OVER w AS BIGINT) AS reached_so_far,
          CAST(sum(pairs) OVER w AS BIGINT) AS pairs_so_far, final = {BATCH} AS complete
        FROM b WINDOW w AS (PARTITION BY job_id ORDER BY batch)""",
    "stream_page_types": _SHOP + """
        SELECT k AS page_id, site, CASE WHEN isbn IS NULL THEN 'JUNK' WHEN price IS NULL
          THEN 'UNAVAILABLE' ELSE 'PRODUCT' END AS type FROM chosen""",
    "stream_best_offer": _BEST,
    "stream_offer_ttl": f"""
        WITH best AS ({_BEST})
        SELECT *, retrieved_us + (45 * 24 + 1) * 3600000000 AS expires_us FROM best
        WHERE retrieved_us + (45 * 24 + 1) * 3600000000
              > (SELECT max({_US.format('l_shipdate')}) FROM lineitem) - 2 * 24 * 3600000000""",
    "stream_distinct_offers": _SEEN + """
        SELECT DISTINCT url, site, us AS retrieved_us, value, 'RON' AS currency FROM seen""",
    "stream_offers": _SHOP + f"""
        SELECT canonical AS url, site, isbn, (k + {EPOCH}) * 1000000 AS retrieved_us, price AS nominal_value
        FROM product""",
    "stream_catalog": _SHOP + """
        SELECT isbn, title, authors, publisher, site, price AS nominal_value, availability FROM product""",
    "stream_wrapper_versions": _EDITED + """
        SELECT isbn, title, authors, publisher, site, price AS nominal_value, availability
        FROM edited WHERE isbn IS NOT NULL AND price IS NOT NULL""",
    "shop_overview": _SHOP + """
        SELECT site, CASE WHEN isbn IS NULL THEN 'JUNK' WHEN price IS NULL THEN 'UNAVAILABLE'
            ELSE 'PRODUCT' END AS type, count(*) AS pages, min(price) AS lowest, max(price) AS highest
        FROM chosen GROUP BY ALL""",
}
