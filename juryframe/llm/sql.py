"""DuckDB twins of the queries that SQL can express."""

from __future__ import annotations

from collections.abc import Sequence

from juryframe.llm import odd_sketch, prefix_trie, quality_rules, url_filter
from juryframe.llm.beta import beta_cdf_sql

_WORD = r"[^\x20\x09-\x0D]"


def quality_sql(cutoffs: dict[str, tuple[float, ...]] = quality_rules.CUTOFFS, alpha: float = quality_rules.ALPHA, delta: float = quality_rules.DELTA) -> str:
    risk = alpha / len(cutoffs)
    grid = ", ".join(f"('{rule}', CAST({c} AS DOUBLE))" for rule, cs in cutoffs.items() for c in cs)
    score = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in cutoffs) + " END"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '{_WORD}+') AS words,
          list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM texts),
windows AS (SELECT rid, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
            FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM split WHERE len(words) >= 3)),
found AS (SELECT rid, i FROM windows QUALIFY count(*) OVER (PARTITION BY rid, a, b, c) > 1),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM found, (VALUES (0), (1), (2)) t(d) GROUP BY rid),
measured AS (
  SELECT s.rid, doc_id, lang, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(length(array_to_string(words, '')), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (rid)),
scored AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE) AS symbol_share,
         n_dup_lines / CAST(greatest(n_words, 1) AS DOUBLE) AS dup_lines_per_word,
         n_repeat_words / CAST(greatest(n_words, 1) AS DOUBLE) AS repeat_share,
         abs(greatest(word_chars, 1) / CAST(greatest(n_words, 1) AS DOUBLE) - {quality_rules.USUAL_LENGTH}) AS odd_word_length
  FROM measured),
marks AS (SELECT doc_id, min(quality) > 0 AS good FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
labelled AS (SELECT lang, good, {", ".join(cutoffs)} FROM scored JOIN marks USING (doc_id) WHERE NOT base_failed),
grid(rule, cutoff) AS (VALUES {grid}),
counts AS (
  SELECT lang, rule, cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE good AND score > cutoff) AS k, count(*) FILTER (WHERE NOT good AND score > cutoff) AS bad
  FROM (SELECT lang, good, rule, cutoff, {score} AS score FROM labelled, grid) GROUP BY ALL),
tails AS (
  SELECT *, list_sum(list_transform(range(0, CAST(k AS BIGINT) + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({risk!r}) + (n - j) * ln(1 - {risk!r})))) AS tail
  FROM counts WHERE n > 0 AND k <= n * {risk!r} AND bad > 0),
held AS (SELECT * FROM tails WHERE tail <= CAST({delta} AS DOUBLE) / ((SELECT count(*) FROM (SELECT DISTINCT lang FROM labelled)) * {sum(map(len, cutoffs.values()))})),
chosen AS (SELECT lang, rule, max({{'bad': bad, 'cutoff': cutoff}}).cutoff AS cutoff FROM held GROUP BY lang, rule),
rejected AS (SELECT DISTINCT rid FROM scored s JOIN chosen c ON s.lang IS NOT DISTINCT FROM c.lang WHERE {score} > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND r.rid IS NULL AS kept
FROM scored s LEFT JOIN rejected r ON s.rid = r.rid"""


def _posterior(level: str, table: str, keys: str) -> str:
    """A CTE with the posterior of each key of ``table`` (keys, n, bad, m)."""
    return f"""
{level}_fit AS (SELECT CASE WHEN total > c AND (s - c) / (total - c) > 0 THEN least(greatest(1 / ((s - c) / (total - c)) - 1, {url_filter.WEAKEST}), {url_filter.STRONGEST}) ELSE {url_filter.STRONGEST} END AS strength
  FROM (SELECT sum(n * pow(bad / CAST(n AS DOUBLE) - m, 2) / (m * (1 - m))) AS s, count(*) AS c, CAST(sum(n) AS DOUBLE) AS total FROM {table} WHERE n > 0)),
{level}_post AS (SELECT {keys}, strength * m + bad AS a, strength * (1 - m) + n - bad AS b FROM {table}, {level}_fit)"""


def url_sql(rules: Sequence[tuple[str, str]], limit: float = url_filter.LIMIT, sure: float = url_filter.SURE) -> str:
    """Pages are their own outcomes; one of two rows with the same id is bad if the other is."""
    values = ", ".join(f"('{kind}', '{text}', '{text.split('/')[0]}', '/{text.partition('/')[2]}')" for kind, text in rules)
    two = ", ".join(f"'{s}'" for s in url_filter.SUFFIXES)
    tail = lambda k: f"array_to_string(list_slice(string_split(name, '.'), -{k}, -1), '.')"
    number = f"regexp_matches(name, '{url_filter.NUMBER}')"
    return f"""
WITH own AS (
  SELECT row_number() OVER () AS rid, page_id, translate(coalesce(regexp_extract(url, '{url_filter.PARTS}', 1), ''), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
         coalesce(regexp_extract(url, '{url_filter.PARTS}', 2), '') AS path, coalesce(html, '') AS html FROM pages),
named AS (SELECT *, rtrim(regexp_replace(host, '{url_filter.NOT_NAME}', '', 'g'), '.') AS name FROM own),
marks AS (SELECT page_id, bool_or(length(html) - length(regexp_replace(html, '{url_filter.JUNK}', '', 'g')) > CAST({url_filter.JUNK_SHARE} AS DOUBLE) * length(html)) AS bad
          FROM own WHERE page_id IS NOT NULL GROUP BY page_id),
hosts AS (SELECT name, count(bad) AS n, count(*) FILTER (WHERE bad) AS bad,
          CASE WHEN {number} THEN name WHEN {tail(2)} IN ({two}) THEN {tail(3)} ELSE {tail(2)} END AS domain,
          CASE WHEN {number} THEN name WHEN {tail(2)} IN ({two}) THEN {tail(2)} ELSE {tail(1)} END AS suffix
          FROM named LEFT JOIN marks USING (page_id) GROUP BY name),
everything AS (SELECT (coalesce(sum(bad), 0) + {limit!r}::DOUBLE) / (coalesce(sum(n), 0) + CAST(1 AS DOUBLE)) AS m FROM hosts),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM hosts, everything GROUP BY suffix),{_posterior("s", "s", "suffix")},
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(a / (a + b)) AS m FROM hosts JOIN s_post USING (suffix) GROUP BY suffix, domain),{_posterior("d", "d", "suffix, domain")},
h AS (SELECT name, n, bad, a / (a + b) AS m FROM hosts JOIN d_post USING (suffix, domain)),{_posterior("h", "h", "name")},
above AS (SELECT name, 1 - ({beta_cdf_sql(f"{limit!r}::DOUBLE", "a", "b")}) AS above FROM h_post),
rules(kind, text, name, start) AS (VALUES {values}),
best AS (SELECT rid, max({{'size': length(text), 'name': length(rules.name), 'kind': kind, 'text': text}}) AS r FROM named, rules
         WHERE (host = rules.name OR ends_with(host, '.' || rules.name)) AND starts_with(path, start) GROUP BY rid)
SELECT page_id, host, path, r.text AS rule, coalesce(r.kind, CASE WHEN above >= {sure} THEN 'block' ELSE 'allow' END) AS verdict
FROM named JOIN above USING (name) LEFT JOIN best USING (rid)"""


def warc_sql() -> str:
    """Payloads are compared as texts; a digit of base 32 is five bits of the digest's hex digits."""
    digit = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((('0x' || substr(sha, 5 * i // 4 + 1, 2))::INTEGER >> (3 - 5 * i % 4)) & 31 AS INTEGER) + 1, 1)"
    return f"""
WITH own AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
marked AS (SELECT *, min(page_id) OVER (PARTITION BY payload) AS first, sha1(payload) AS sha FROM own)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: {digit}), '') AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM marked"""


def odd_sketch_sql(shingle: int = odd_sketch.RULE.shingle, percent: int = odd_sketch.RULE.percent) -> str:
    """All pairs that share a shingle, counted exactly; equal sets are one node. Ids are taken to be unique, as in the given tables."""
    gram = " || ' ' || ".join(["words[i]", *[f"words[i + {k}]" for k in range(1, shingle)]])
    return f"""
WITH RECURSIVE own AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{url_filter.UPPER}', '{url_filter.LOWER}'), '{_WORD}+') AS words FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {shingle} THEN [array_to_string(words, ' ')]
         ELSE list_sort(list_distinct(list_transform(range(1, len(words) - {shingle - 2}), lambda i: {gram}))) END AS grams FROM own),
nodes AS (SELECT min(doc_id) AS node, len(grams) AS n, any_value(grams) AS grams FROM sets WHERE len(grams) > 0 GROUP BY grams),
flat AS (SELECT node, n, unnest(grams) AS gram FROM nodes),
links AS (SELECT x.node AS a, y.node AS b FROM flat x JOIN flat y ON x.gram = y.gram AND x.node <> y.node AND 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)
          GROUP BY x.node, y.node, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
reached(node, other) AS (SELECT node, node FROM nodes UNION SELECT node, b FROM reached JOIN links ON a = other),
roots AS (SELECT node, min(other) AS root FROM reached GROUP BY node),
found AS (SELECT s.doc_id, CAST(len(s.grams) AS BIGINT) AS n_shingles, coalesce(r.root, s.doc_id) AS component_id
          FROM sets s LEFT JOIN nodes n ON s.grams = n.grams LEFT JOIN roots r ON n.node = r.node)
SELECT *, doc_id = component_id AS kept FROM found"""


def prefix_trie_sql(family: int = prefix_trie.FAMILY, given: int = prefix_trie.GIVEN) -> str:
    """Every prefix of every rebuilt conversation as a list; CRC-32 (polynomial 0xEDB88320) bit by bit over the id's digits."""
    codes = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))"
    bits = "list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))"
    return f"""
WITH own AS (SELECT conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda s, b: {bits}), 4294967295) % {given} AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, i, t FROM convs c JOIN own o ON o.conv_id = c.conv_id - c.conv_id % {family} AND i <= h
  UNION ALL SELECT c.conv_id, 1, i, t FROM convs c JOIN own o ON o.conv_id = c.conv_id AND i > h),
sequences AS (SELECT conv_id, list(t ORDER BY part, i) AS s FROM rebuilt GROUP BY conv_id),
paths AS (SELECT conv_id, coalesce(s, []) AS s FROM convs LEFT JOIN sequences USING (conv_id)),
steps AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM paths),
nodes AS (SELECT s[1:depth] AS p, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
  string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE len(s) = depth) AS ends FROM steps GROUP BY s[1:depth], depth),
children AS (SELECT p[1:depth - 1] AS p, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY p[1:depth - 1]),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(nodes.p[depth].text) END AS saved FROM nodes LEFT JOIN children ON nodes.p = children.p),
above AS (SELECT *, unnest(range(0, depth + 1)) AS d FROM counted),
sums AS (SELECT p[1:d] AS p, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY p[1:d])
SELECT c.conv_id, c.depth, parent.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(c.ends, '')) AS ends_sha256
FROM counted c JOIN sums ON c.p = sums.p LEFT JOIN nodes parent ON c.depth > 0 AND parent.p = c.p[1:c.depth - 1]"""
