"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from tidewatch.llm import quality

UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"


def words(pattern: str, text: str = "text") -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), {UPPER}, {LOWER}), '{pattern}')"


PLAIN, BLANK = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

DECONTAMINATION = f"""
WITH item AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {words(PLAIN)} AS w FROM benchmark),
win AS (SELECT DISTINCT item, m, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS m, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {words(PLAIN)} AS w FROM documents),
own AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item FROM own JOIN win USING (m, g)),
cover AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*)::BIGINT AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, len(w)::BIGINT AS n_words, coalesce(cover.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(cover.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN cover USING (doc_id) LEFT JOIN named USING (doc_id)"""

JACCARD = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {words(BLANK)} AS w FROM documents),
gram AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*)::BIGINT AS n FROM gram GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_have FROM gram a JOIN gram b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * both_have >= 80 * (x.n + y.n - both_have)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM doc UNION SELECT reach.a, link.b FROM reach JOIN link ON link.a = reach.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) LEFT JOIN size USING (doc_id)"""

_GRID = ", ".join(f"('{rule}', {k}, {c}::DOUBLE)" for rule, grid in quality.GRID.items() for k, c in enumerate(grid))
_RISK = f"(0.05::DOUBLE / {len(quality.GRID)})"
_SYMBOLS = "[" + quality.SYMBOLS.replace("|", r"\|") + "]"

QUALITY = f"""
WITH doc AS (SELECT doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{BLANK}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM doc WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM win) WHERE k > 1),
cover AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS p FROM again) GROUP BY doc_id),
measured AS (SELECT doc.doc_id, stratum, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{_SYMBOLS}'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0) AS n_repeat_words FROM doc LEFT JOIN cover USING (doc_id)),
scored AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    {{'symbols': n_symbols / greatest(n_words, 1)::DOUBLE, 'lines': n_dup_lines / greatest(n_lines, 1)::DOUBLE,
      'repeats': n_repeat_words / greatest(n_words, 1)::DOUBLE, 'length': word_chars / greatest(n_words, 1)::DOUBLE}} AS s FROM measured),
flat AS (SELECT doc_id, stratum, base_failed, unnest(['symbols', 'lines', 'repeats', 'length']) AS rule, unnest([s.symbols, s.lines, s.repeats, s."length"]) AS score FROM scored),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
grid(rule, k, cutoff) AS (VALUES {_GRID}),
cell AS (SELECT stratum, rule, cutoff, count(*) AS n, count(*) FILTER (score > cutoff) AS k FROM flat JOIN good USING (doc_id) JOIN grid USING (rule) WHERE NOT base_failed GROUP BY ALL),
term AS (SELECT stratum, rule, cutoff, n, k, unnest(range(0, k + 1)) AS i FROM cell WHERE k < {_RISK} * n),
tail AS (SELECT stratum, rule, cutoff, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({_RISK}) + (n - i) * ln(1 - {_RISK}))) AS p FROM term GROUP BY ALL),
best AS (SELECT stratum, rule, min(cutoff) AS cutoff FROM tail WHERE p <= 0.05 / ({len(quality.GRID)} * (SELECT count(DISTINCT stratum) FROM cell)) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM flat JOIN best USING (stratum, rule) WHERE score > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM scored"""


_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
WITH item AS (SELECT item_id, {words(_TERM)} AS w FROM benchmark),
want AS (SELECT item_id, t, count(*)::BIGINT AS q FROM (SELECT item_id, unnest(w) AS t FROM item) GROUP BY ALL),
doc AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM (SELECT doc_id, {words(_TERM)} AS w FROM documents) WHERE len(w) > 0),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM doc),
has AS (SELECT doc_id, n, t, count(*)::BIGINT AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM want) GROUP BY ALL),
weight AS (SELECT t, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM has, total GROUP BY t),
impact AS (SELECT doc_id, t, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))) AS worth FROM has JOIN weight USING (t), total),
scored AS (SELECT item_id, doc_id, sum(q * worth)::BIGINT AS score FROM want JOIN impact USING (t) GROUP BY ALL HAVING sum(q * worth) > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored)
WHERE rank <= 20"""
