"""SQL of the queries that SQL can express, written from the operators' contracts and not from their code.

Fingerprints, seeded selections, trained models and parsed pages have no SQL form; tests hold those against brute force.
"""
from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_HOST = _FOLD.format(f"regexp_extract({_REST}, '^([^/?#]*)', 1)")
_LINK = r"""(?i)\bhref\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\s"''<>]+)"""


def _spread(name: str, start: str, end: str, total: str) -> str:
    """Mass of ``name`` along the links from ``start`` to ``end``, by shares of the linker, until 0.85 ** 61 of it is on its way."""
    return f"""{name}_sent AS (SELECT 0 AS turn, host, {name} AS mass FROM seeds WHERE {name} > 0
 UNION ALL SELECT turn + 1, l.{end}, 0.85::DOUBLE * sum(l.n / t.n * s.mass) FROM {name}_sent s JOIN links l ON l.{start} = s.host
  JOIN (SELECT src, sum(n) AS n FROM links GROUP BY src) t ON t.src = l.src WHERE turn < 61 GROUP BY turn + 1, l.{end}),
{total} AS (SELECT host, sum(mass) AS {name} FROM {name}_sent GROUP BY host)"""


OP1 = f"""WITH RECURSIVE parts AS (SELECT page_id, html, coalesce({_HOST}, '') AS host,
  coalesce(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS given FROM ruled),
seeds AS (SELECT host, count(*) FILTER (given = 'allow') / count(*) AS trust, count(*) FILTER (given = 'block') / count(*) AS distrust
 FROM judged WHERE host <> '' GROUP BY host),
found AS (SELECT page_id, host AS src, unnest(list_distinct(regexp_extract_all(coalesce(html, ''), '{_LINK}', 1))) AS link FROM parts),
ends AS (SELECT src, {_FOLD.format("regexp_extract(link, '^[^/]*//([^/?#]*)', 1)")} AS dst FROM found),
links AS (SELECT src, dst, count(*) AS n FROM ends WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY src, dst),
{_spread('trust', 'src', 'dst', 'good')},
{_spread('distrust', 'dst', 'src', 'bad')}
SELECT page_id, host, path, rule, coalesce(given, CASE WHEN coalesce(b.distrust, 0) - coalesce(g.trust, 0) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
 CAST(coalesce(g.trust, 0) AS DOUBLE) AS trust, CAST(coalesce(b.distrust, 0) AS DOUBLE) AS distrust
FROM judged LEFT JOIN good g USING (host) LEFT JOIN bad b USING (host)"""

OP2 = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS width FROM embeddings
 WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.width = b.width AND a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reached AS (SELECT a AS root, a AS node FROM links UNION SELECT root, b FROM reached JOIN links ON a = node),
named AS (SELECT node, min(root) AS component_id FROM reached GROUP BY node),
counted AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN named ON node = vec_id LEFT JOIN counted ON a = vec_id"""

OP3 = f"""WITH texts AS (SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM texts),
grams AS (SELECT *, lag(w, 1) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
one AS (SELECT w, count(*) AS n FROM grams GROUP BY w),
two AS (SELECT w1, w, count(*) AS n FROM grams WHERE w1 IS NOT NULL GROUP BY w1, w),
three AS (SELECT w2, w1, w, count(*) AS n FROM grams WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
met AS (SELECT doc_id, one.n AS n1, two.n AS n2, three.n AS n3, before.n AS h1, pair.n AS h2, sum(1) OVER () AS total FROM grams g
 JOIN one ON one.w = g.w LEFT JOIN two ON two.w1 = g.w1 AND two.w = g.w LEFT JOIN three ON three.w2 = g.w2 AND three.w1 = g.w1 AND three.w = g.w
 LEFT JOIN one before ON before.w = g.w1 LEFT JOIN two pair ON pair.w1 = g.w2 AND pair.w = g.w1),
scored AS (SELECT doc_id, CASE WHEN n3 >= 2 THEN ln(n3 / h2)
  ELSE CASE WHEN n3 IS NULL THEN 0 ELSE ln(0.4) END + CASE WHEN n2 >= 2 THEN ln(n2 / h1)
   ELSE CASE WHEN n2 IS NULL THEN 0 ELSE ln(0.4) END + ln(n1 / total) END END AS s FROM met),
sums AS (SELECT doc_id, count(*) AS n_words, sum(s) AS total FROM scored GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(total, 0), 6) AS log_score, round(total / n_words, 6) AS mean_log_score
FROM documents LEFT JOIN sums USING (doc_id)"""

_TERMS = r"regexp_extract_all(" + _FOLD.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""WITH texts AS (SELECT doc_id, {_TERMS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TERMS} AS ws FROM benchmark),
starts AS (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS pos FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(ws[pos:pos + n - 1], ' ') AS run FROM starts),
places AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS pos FROM texts, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n),
hits AS (SELECT doc_id, pos, p.n, item FROM places p JOIN windows w ON w.n = p.n AND w.run = array_to_string(ws[pos:pos + p.n - 1], ' ')),
inside AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + n)) AS word FROM hits),
n_inside AS (SELECT doc_id, count(*) AS n_hit FROM inside GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits WHERE item IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
 sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN n_inside USING (doc_id) LEFT JOIN named USING (doc_id)"""

OP13 = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words, row_number() OVER () AS nth
  FROM documents
), w AS (SELECT lang, source, nth, unnest(words) AS term FROM d
), kept AS (SELECT lang, term, count(*) AS everywhere FROM w GROUP BY 1, 2 HAVING count(DISTINCT nth) >= 3
), langs AS (SELECT lang, count(*) AS v, sum(everywhere) AS total FROM kept GROUP BY 1
), groups AS (SELECT DISTINCT lang, source FROM d
), counts AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3
), sizes AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY 1, 2
), grid AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (coalesce(s.total, 0) + l.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.everywhere + 1)) // (l.total + l.v)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN sizes s USING (lang, source) LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), pair AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
  FROM grid a JOIN grid b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3
), every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
), every_term AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM grid WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS place
  FROM (FROM every_pair UNION ALL FROM every_term)
)
SELECT lang, source, part, item, value::BIGINT AS value, place::INTEGER AS rank FROM ranked WHERE part = 'pair' OR place <= 200
"""
