"""Oracle SQL (DuckDB) of the registered queries, where SQL can express them."""

from __future__ import annotations

from . import secret_scan
from .quality import RULES, STOP_WORDS


def _broken(rule) -> str:
    value = f"({rule.measure.split(' / ')[0]}) / nullif({rule.measure.split(' / ')[1]}, 0)"
    tests = [f"{value} < {rule.low}"] if rule.low is not None else []
    tests += [f"{value} > {rule.high}"] if rule.high is not None else []
    return f"coalesce(n_words >= {rule.min_words} AND ({' OR '.join(tests)}), false)"


_NAMES = ", ".join(f"CASE WHEN {_broken(r)} THEN '{r.name}' END" for r in RULES)
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

QUALITY = f"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents),
pos AS (
  SELECT doc_id, i, array_to_string(words[i:i + 4], chr(32)) AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, gram FROM pos GROUP BY ALL HAVING count(*) > 1),
repeats AS (
  SELECT doc_id, count(DISTINCT k) AS n_repeat_words
  FROM (SELECT doc_id, unnest(range(i, i + 5)) AS k FROM pos JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
counts AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(body) - length(regexp_replace(body, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
    length(body) - length(regexp_replace(body, '[A-Z]', '', 'g')) AS n_capitals,
    length(body) - length(replace(body, '!', '')) AS n_exclamations
  FROM w LEFT JOIN repeats USING (doc_id)),
judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    array_to_string(list_filter([{_NAMES}], lambda x: x IS NOT NULL), ',') AS broken_rules
  FROM counts)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND broken_rules = '' AS kept, broken_rules
FROM judged"""


def _secret(rank: int, rule: secret_scan.Rule) -> str:
    quoted = rule.java.replace("'", "''")
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, string_split_regex(body, '{quoted}') AS between,
    regexp_extract_all(body, '{quoted}', 0) AS whole, regexp_extract_all(body, '{quoted}', {rule.group}) AS judged,
    {rule.least} AS least
  FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents) WHERE regexp_matches(body, '{quoted}')"""


SECRETS = f"""
WITH raw AS ({" UNION ALL ".join(_secret(n, r) for n, r in enumerate(secret_scan.RULES))}),
pos AS (SELECT *, unnest(range(1, len(whole) + 1)) AS k FROM raw),
spans AS (
  SELECT doc_id, rank, kind,
    list_sum(list_transform(between[1:k], lambda x: length(x)))
      + coalesce(list_sum(list_transform(whole[1:k - 1], lambda x: length(x))), 0) AS start, length(whole[k]) AS n
  FROM pos WHERE length(judged[k]) >= least),
per AS (
  SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT), ',' ORDER BY start, rank) AS spans,
    string_agg(CASE WHEN rank < 3 THEN kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + n AS BIGINT) END, ',' ORDER BY start, rank) AS base,
    count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex
  FROM spans GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents LEFT JOIN per USING (doc_id)"""


LINES = """
WITH raw AS (
  SELECT doc_id, text, i, string_split(text, chr(10))[i] AS line
  FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
lines AS (
  SELECT doc_id, i, words, len(words) AS n
  FROM (SELECT doc_id, i, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM raw)
  WHERE len(words) > 0),
firsts AS (SELECT words, n, min((doc_id, i)) AS first FROM lines GROUP BY words, n),
variants AS (
  SELECT words, first, n, words AS variant, true AS whole FROM firsts WHERE n >= 4
  UNION ALL
  SELECT words, first, n, list_concat(words[1:k - 1], words[k + 1:]), false
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM firsts WHERE n >= 5)),
-- Equal variants may come from gaps in different places, so pairs are checked for their distance.
pairs AS (
  SELECT DISTINCT b.words AS words, a.words AS other, a.first AS earlier
  FROM variants a JOIN variants b ON a.variant = b.variant AND a.first < b.first),
near AS (
  SELECT words, min(earlier) AS earlier FROM pairs
  WHERE abs(len(words) - len(other)) = 1 OR (len(words) = len(other)
    AND len(list_filter(range(1, len(words) + 1), lambda k: words[k] <> other[k])) <= 1)
  GROUP BY words),
gone AS (
  SELECT doc_id, count(*) FILTER (first < (doc_id, i)) AS n_exact,
    count(*) FILTER (first = (doc_id, i) AND earlier IS NOT NULL) AS n_near,
    list(i) FILTER (first < (doc_id, i) OR earlier IS NOT NULL) AS numbers
  FROM lines JOIN firsts USING (words, n) LEFT JOIN near USING (words) GROUP BY doc_id),
kept AS (
  SELECT raw.doc_id, string_agg(line, chr(10) ORDER BY i) AS kept_text
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id
  WHERE numbers IS NULL OR NOT list_contains(numbers, i) GROUP BY raw.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_lines, coalesce(n_exact, 0) AS n_exact, coalesce(n_near, 0) AS n_near,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept_text, '')) END AS kept_sha256
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id) n ON d.doc_id = n.doc_id
LEFT JOIN gone ON d.doc_id = gone.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id"""


COPIES = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


DIVERGENCE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
per_doc AS MATERIALIZED (
  SELECT lang, source, doc_id, term, count(*) AS n
  FROM (SELECT lang, source, doc_id, unnest(terms) AS term FROM docs) GROUP BY ALL),
kept AS MATERIALIZED (SELECT lang, term, CAST(sum(n) AS BIGINT) AS n FROM per_doc GROUP BY ALL HAVING count(DISTINCT doc_id) >= 30),
counts AS MATERIALIZED (
  SELECT lang, source, term, CAST(sum(n) AS BIGINT) AS n FROM per_doc SEMI JOIN kept USING (lang, term) GROUP BY ALL),
groups AS MATERIALIZED (
  SELECT g.lang, g.source, coalesce(t.total, 0) AS total, coalesce(v.kinds, 0) AS kinds, coalesce(v.total, 0) AS lang_total
  FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t ON g.lang = t.lang AND g.source = t.source
  LEFT JOIN (SELECT lang, count(*) AS kinds, sum(n) AS total FROM kept GROUP BY ALL) v ON g.lang = v.lang),
shares AS MATERIALIZED (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
    1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.kinds) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (g.lang_total + 5 * g.kinds) AS q
  FROM groups g JOIN kept k ON g.lang = k.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(d.value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN apart d ON d.lang = a.lang AND d.source = a.source AND d.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM shares WHERE n > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM found)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50"""


def _codes(parts: int = 4, entries: int = 256, rounds: int = 4, width: int = 16) -> str:
    """The rounds written out, each an assignment and an update; vectors of ``parts * width`` components."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT r, pos, part, best.entry AS entry, best.d AS d FROM (
    SELECT p.r, p.pos, any_value(p.part) AS part, min({{'d': CAST(p.norm - 2 * list_inner_product(p.num, b.num) + b.norm AS BIGINT), 'entry': b.entry}}) AS best
    FROM parts p JOIN b{k} b USING (pos) GROUP BY p.r, p.pos)),""")
        if k < rounds:
            steps.append(f"""
s{k} AS (
  SELECT pos, entry, i, sum(x) AS s, count(*) AS n
  FROM (SELECT pos, entry, unnest(part) AS x, unnest(range(1, {width + 1})) AS i FROM a{k}) GROUP BY ALL),
n{k} AS (SELECT pos, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS part FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (
  SELECT *, CAST(part AS DOUBLE[]) AS num, list_inner_product(CAST(part AS DOUBLE[]), CAST(part AS DOUBLE[])) AS norm
  FROM (SELECT pos, entry, coalesce(n.part, b.part) AS part FROM b{k} b LEFT JOIN n{k} n USING (pos, entry))),""")
    return f"""
WITH whole AS MATERIALIZED (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cut AS (SELECT r, pos, w[pos * {width} + 1:(pos + 1) * {width}] AS part FROM whole, range({parts}) t(pos)),
parts AS MATERIALIZED (
  SELECT *, CAST(part AS DOUBLE[]) AS num, list_inner_product(CAST(part AS DOUBLE[]), CAST(part AS DOUBLE[])) AS norm FROM cut),
b0 AS MATERIALIZED (SELECT pos, r - 1 AS entry, part, num, norm FROM parts WHERE r <= {entries}),{"".join(steps)}
digest AS (
  SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY pos, entry, i)) AS codebooks_sha256
  FROM (SELECT pos, entry, unnest(part) AS x, unnest(range({width})) AS i FROM b{rounds})),
coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM whole JOIN coded USING (r), digest"""


CODES = _codes()
