"""DuckDB SQL with the expected result of the queries that SQL can express."""

# All pairs by cosine, then everything reachable through links.
_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
pair AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id
         WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
link AS (SELECT x, y FROM pair UNION ALL SELECT y, x FROM pair),
reach(id, r) AS (SELECT vec_id, vec_id FROM v
                 UNION SELECT reach.id, link.y FROM reach JOIN link ON link.x = reach.r),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x)
SELECT id AS vec_id, coalesce(max(n), 0) AS n_links, min(r) AS component_id, min(r) = id AS kept
FROM reach LEFT JOIN n ON n.x = reach.id GROUP BY id
"""

# Turn numbers are unique within the given dialogues, and each fits into one part.
_PERSPECTIVES = """
WITH t AS (
  SELECT conv_id, turn, role, replace(text, '<|', '<\\|') || '<|end|>' || chr(10) AS body FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM conversations),
s AS (
  SELECT conv_id, perspective, turn, role = perspective AS own, body,
         CASE WHEN role = perspective THEN '<|assistant|>' ELSE '<|user name=' || role || '|>' END || chr(10) AS head
  FROM t JOIN p USING (conv_id)),
a AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM s)
SELECT conv_id, perspective, '0' AS part, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn) AS rendered,
       coalesce(string_agg(CAST(before + length(head) AS BIGINT) || '-' || CAST(before + length(head) + length(body) AS BIGINT), ' '
                           ORDER BY turn) FILTER (WHERE own), '') AS mask
FROM a GROUP BY conv_id, perspective
"""

# Base32 of the digest: the bits of its hexadecimal digits in groups of five.
_ARCHIVE = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
             min(page_id) OVER (PARTITION BY html) AS first FROM page),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: substr(
        '0000000100100011010001010110011110001001101010111100110111101111',
        CAST(instr('0123456789abcdef', substr(hex, i, 1)) * 4 - 3 AS BIGINT), 4)), '') AS bits FROM d)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(substr(bits, i * 5 + 1, 1) AS INT) + 8 * CAST(substr(bits, i * 5 + 2, 1) AS INT)
    + 4 * CAST(substr(bits, i * 5 + 3, 1) AS INT) + 2 * CAST(substr(bits, i * 5 + 4, 1) AS INT)
    + CAST(substr(bits, i * 5 + 5, 1) AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
"""

# Every set of up to four tokens of the bad pages is tried as a rule.
_URLS = r"""
WITH page AS (
  SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, url, regexp_extract(rest, '^([^/?#]*)', 1) AS raw_host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM page),
part AS (
  SELECT page_id, url, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, path FROM split),
label AS (SELECT *, list_filter(string_split(host, '.'), lambda x: x <> '') AS names FROM part),
token AS (
  SELECT DISTINCT page_id, t FROM (
    SELECT page_id, 'h:' || array_to_string(names[n:], '.') AS t FROM (
      SELECT page_id, names, unnest(range(1, len(names) + 1)) AS n FROM label)
    UNION ALL SELECT page_id, 'p:' || regexp_replace(lower(w), '[0-9]+', '0', 'g') FROM (
      SELECT page_id, unnest(regexp_split_to_array(path, '[/._-]+')) AS w FROM label) WHERE w <> ''
    UNION ALL SELECT page_id, 'q:' || unnest(regexp_extract_all(coalesce(url, ''), '[?&]([^=&#]+)', 1)) FROM label)),
mark AS (
  SELECT doc_id AS page_id, max(coalesce(toxic, 0) = 1 OR coalesce(quality, 1) = 0) AS bad
  FROM labels JOIN part ON page_id = doc_id GROUP BY doc_id),
seen AS (SELECT page_id, t, bad FROM token JOIN mark USING (page_id)),
often AS (
  SELECT t FROM seen WHERE bad GROUP BY t HAVING count(*) >= 10),
own AS (SELECT page_id, t, bad FROM seen SEMI JOIN often USING (t)),
tuple AS (
  SELECT page_id, bad, [t] AS items FROM own
  UNION ALL SELECT a.page_id, a.bad, [a.t, b.t] FROM own a JOIN own b ON a.page_id = b.page_id AND a.t < b.t
  UNION ALL SELECT a.page_id, a.bad, [a.t, b.t, c.t] FROM own a JOIN own b ON a.page_id = b.page_id AND a.t < b.t
    JOIN own c ON c.page_id = b.page_id AND b.t < c.t
  UNION ALL SELECT a.page_id, a.bad, [a.t, b.t, c.t, d.t] FROM own a JOIN own b ON a.page_id = b.page_id AND a.t < b.t
    JOIN own c ON c.page_id = b.page_id AND b.t < c.t JOIN own d ON d.page_id = c.page_id AND c.t < d.t),
rule AS (
  SELECT items, count(*) FILTER (WHERE tuple.bad) AS hits, count(*) AS uses FROM tuple GROUP BY items
  HAVING hits >= 10 AND hits / uses >= 0.8),
blocked AS (
  SELECT DISTINCT page_id FROM (
    SELECT page_id, items FROM (SELECT items, unnest(items) AS t FROM rule) JOIN token USING (t)
    GROUP BY page_id, items HAVING count(*) = len(items))),
verdict AS (
  SELECT part.*, blocked.page_id IS NOT NULL AS mined,
    CASE WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
         WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
         WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
         WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM part LEFT JOIN blocked ON blocked.page_id = part.page_id)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, mined,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN mined THEN 'block' ELSE 'allow' END AS verdict
FROM verdict
"""

# crc32 by its bits: a list of steps, each a byte to mix in or (-1) a shift. Rebuilt conversations, their prefixes and,
# for each node, the nodes above it are spelled out as lists of turns.
_TRIE = """
WITH t AS (
  SELECT conv_id, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(said ORDER BY place) AS l FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, l, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295], flatten(list_transform(
      string_split(CAST(conv_id AS VARCHAR), ''), lambda d: [ascii(d), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) % 9 AS h
  FROM own),
re AS (
  SELECT c.conv_id, list_concat(coalesce(b.l[1:h], []), c.l[h + 1:]) AS l FROM c LEFT JOIN own b ON b.conv_id = c.base),
member AS (SELECT conv_id, d, l[1:d] AS node, d = len(l) AS ends FROM (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM re)),
node AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM member GROUP BY node, d),
child AS (SELECT node[1:d - 1] AS node, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
fact AS (
  SELECT node, d, (n_convs - 1) * CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(node[d].text)) END AS saved,
         CASE WHEN n_children IS NULL THEN 1 ELSE 0 END AS leaf
  FROM node LEFT JOIN child USING (node)),
under AS (
  SELECT node[1:k] AS node, CAST(sum(leaf) AS BIGINT) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens
  FROM (SELECT node, leaf, saved, unnest(range(0, d + 1)) AS k FROM fact) GROUP BY 1)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children,
       n_leaves, saved_tokens, n.ends_sha256
FROM node n JOIN under u ON u.node = n.node LEFT JOIN child c ON c.node = n.node
LEFT JOIN node p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""

# Every run of as many words as a window has is compared with every window.
_LEAKS = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, w[k:k + 9] AS x
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM item WHERE len(w) > 0)),
size AS (SELECT DISTINCT len(x) AS n FROM win),
run AS (SELECT doc_id, k, n, w[k:k + n - 1] AS x FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM doc, size)),
hit AS (SELECT doc_id, item_id, k, n FROM run JOIN win USING (x)),
word AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(k, k + n)) AS at FROM hit) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN word USING (doc_id) LEFT JOIN named USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op1_sorted_passes": _VECTORS,
    "op4_perspectives": _PERSPECTIVES,
    "op6_warc": _ARCHIVE,
    "op9_url_rules": _URLS,
    "op12_prefix_trie": _TRIE,
    "op13_decontamination": _LEAKS,
}
