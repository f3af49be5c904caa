"""DuckDB SQL for the rows of the operators' queries, where SQL can express them."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Fixed value: a word, as in the operators.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op2_url_rules"] = r"""
WITH rules(host, path, verdict) AS (VALUES
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest),
urls AS (SELECT DISTINCT host, path FROM parts),
best AS (
  SELECT u.host, u.path, max({'size': length(r.host) + length(r.path), 'rule': r.host || r.path, 'verdict': r.verdict}) AS b
  FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
  GROUP BY u.host, u.path)
SELECT page_id, p.host, p.path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN best USING (host, path)
"""

ORACLE["op3_mixing"] = f"""
WITH docs AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS most,
         [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM docs GROUP BY source),
ranked AS (
  SELECT *, coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM sources),
tried AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources) - CAST(capped AS DOUBLE)) / CAST(free AS DOUBLE) AS level FROM ranked),
levels AS (SELECT arg_min(level, most / w) AS level FROM tried WHERE most / w > level),
targets AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), w * (SELECT level FROM levels)) AS target FROM sources),
queued AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))) AS h, d.source,
         row_number() OVER (ORDER BY d.source NULLS LAST, md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))), doc_id, size) AS i,
         sum(size) OVER (PARTITION BY d.source ORDER BY md5(concat_ws('|', 'mix', CAST(doc_id AS VARCHAR))), doc_id, size
                         ROWS UNBOUNDED PRECEDING) AS upto
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
rounds AS (
  SELECT *, CASE WHEN target > 0 THEN CAST(upto + e * source_size AS DOUBLE) / target ELSE 0 END AS finish
  FROM queued, (VALUES (0), (1)) AS x(e)),
served AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY finish, i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM rounds)
SELECT doc_id, size, source_size, target, CAST(sum(least(size, greatest(0,
         CAST(floor(1.5 * (SELECT sum(source_size) FROM sources)) AS BIGINT) - earlier))) AS BIGINT) AS taken
FROM served GROUP BY i, doc_id, size, source_size, target
"""

ORACLE["op4_embeddings"] = """
WITH RECURSIVE x AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM x a JOIN x b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
least_id AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(c, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(c, vec_id)) AS kept
FROM embeddings e LEFT JOIN least_id l ON l.a = e.vec_id LEFT JOIN links k ON k.a = e.vec_id
"""

_RULES = {
    "symbols": ("n_symbols / nullif(n_words, 0)", (0.1, 0.2, 0.3, 0.5, 0.75, 1.0, 1.5, 2.0)),
    "repeated": ("n_repeat_words / nullif(n_words, 0)", (0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45)),
    "dup_lines": ("n_dup_lines / nullif(n_lines, 0)", (0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "word_size": ("word_chars / nullif(n_words, 0)", (6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0)),
}

# The measures of the documents of a table: one row each, by row number.
_MEASURES = r"""
numbered AS (SELECT row_number() OVER () AS rid, * FROM {table}),
worded AS (SELECT rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM numbered),
grams AS (
  SELECT rid, i, {{'a': w[i], 'b': w[i + 1], 'c': w[i + 2]}} AS g
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM worded)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k) AS n FROM often, (VALUES (0), (1), (2)) AS x(k) GROUP BY rid),
lined AS (
  SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT rid, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM numbered)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
measured AS (
  SELECT d.*, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(l.dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(l.n, 0) AS BIGINT) AS n_lines
  FROM numbered d JOIN worded USING (rid) LEFT JOIN lined l USING (rid) LEFT JOIN covered c USING (rid)),
rates AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {rates} FROM measured),
good AS (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1),
rules(rule, cutoff) AS (VALUES {cutoffs}),
held AS (
  SELECT lang, rule, rate FROM (SELECT lang, {names} FROM rates WHERE doc_id IN (SELECT doc_id FROM good))
  UNPIVOT (rate FOR rule IN ({names}))),
strata AS (SELECT lang, count(*) AS n FROM rates WHERE doc_id IN (SELECT doc_id FROM good) GROUP BY lang),
counted AS (
  SELECT h.lang, h.rule, r.cutoff, count(*) FILTER (WHERE rate > cutoff) AS k FROM held h JOIN rules r USING (rule) GROUP BY ALL),
pooled AS (SELECT rule, cutoff, sum(k) AS k FROM counted GROUP BY ALL),
level AS (SELECT 0.05 / ((SELECT count(DISTINCT rule) FROM rules) * (count(*) + 1)) AS p FROM strata),
used AS (
  SELECT lang, n * ln(1 - 0.0025) <= ln(p) AS own,
         CAST(CASE WHEN n * ln(1 - 0.0025) <= ln(p) THEN n ELSE (SELECT sum(n) FROM strata) END AS BIGINT) AS n FROM strata, level),
chances AS (
  SELECT lang, j, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.0025) + (n - j) * ln(1 - 0.0025)))
           OVER (PARTITION BY lang ORDER BY j) AS p
  FROM (SELECT lang, n, unnest(range(0, CAST(ceil(n * 0.0025) AS BIGINT) + 1)) AS j FROM used)),
allowed AS (SELECT lang, max(j) AS most FROM chances WHERE p <= (SELECT p FROM level) GROUP BY lang),
cuts AS (
  SELECT c.lang, c.rule, min(c.cutoff) AS cutoff
  FROM counted c JOIN pooled o ON c.rule = o.rule AND c.cutoff = o.cutoff
  JOIN used u ON c.lang IS NOT DISTINCT FROM u.lang JOIN allowed a ON c.lang IS NOT DISTINCT FROM a.lang
  WHERE CASE WHEN own THEN c.k ELSE o.k END <= a.most GROUP BY ALL),
bad AS (
  SELECT DISTINCT rid FROM (SELECT rid, lang, {names} FROM rates) UNPIVOT (rate FOR rule IN ({names})) x
  JOIN cuts c ON x.rule = c.rule AND x.lang IS NOT DISTINCT FROM c.lang WHERE rate > cutoff),
judged AS (SELECT r.*, NOT base_failed AND rid NOT IN (SELECT rid FROM bad) AS kept FROM rates r)"""


def measures_sql(table: str) -> str:
    """Common table expressions up to ``judged``: the rows of ``table`` with the quality measures and ``kept``."""
    return _MEASURES.format(
        table=table, names=", ".join(_RULES), rates=", ".join(f"coalesce({e}, 0.0) AS {n}" for n, (e, _) in _RULES.items()),
        cutoffs=", ".join(f"('{n}', {c}::DOUBLE)" for n, (_, cs) in _RULES.items() for c in cs))


ORACLE["op7_quality"] = f"""
WITH {measures_sql("documents")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged
"""

# The lines of a table that an earlier one matches, by exact document counts of the words.
_LINES = r"""
texts AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM {table}),
lines AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM texts),
sets AS (
  SELECT doc_id, i, row_number() OVER (ORDER BY doc_id, i) AS id, list_distinct(regexp_extract_all(
           lower(line), '[^\x20\x09-\x0D]+')) AS t
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
words AS (SELECT id, len(t) AS n, unnest(t) AS w FROM sets),
ranked AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS r
  FROM words JOIN (SELECT w, count(*) AS c FROM words GROUP BY w) USING (w)),
rare AS (SELECT id, n, w FROM ranked WHERE r <= n - (4 * n + 4) // 5 + 1),
pairs AS (
  SELECT DISTINCT a.id AS a, b.id AS b FROM rare a JOIN rare b ON a.w = b.w AND a.id < b.id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
gone AS (
  SELECT DISTINCT y.doc_id, y.i FROM pairs JOIN sets x ON x.id = a JOIN sets y ON y.id = b
  WHERE 5 * len(list_intersect(x.t, y.t)) >= 4 * (len(x.t) + len(y.t) - len(list_intersect(x.t, y.t)))),
removed AS (SELECT doc_id, list(i) AS out, count(*) AS n FROM gone GROUP BY doc_id),
cleaned AS (
  SELECT t.doc_id, t.text AS before, CASE WHEN t.text IS NOT NULL THEN array_to_string(
           list_filter(lines, lambda x, k: NOT list_contains(coalesce(out, []), k - 1)), chr(10)) END AS text,
         CAST(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS INTEGER) AS n_lines,
         CAST(coalesce(n, 0) AS INTEGER) AS n_removed
  FROM texts t LEFT JOIN removed r ON t.doc_id = r.doc_id)"""


def lines_sql(table: str) -> str:
    """Common table expressions up to ``cleaned``: each document's text without the lines that repeat."""
    return _LINES.format(table=table)


ORACLE["op9_line_dedup"] = f"""
WITH {lines_sql("documents")}
SELECT doc_id, n_lines, n_removed, md5(text) AS text_md5 FROM cleaned
"""

ORACLE["op11_filter_audit"] = r"""
WITH first AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
said AS (
  SELECT doc_id, bool_or(quality IS NOT DISTINCT FROM 1) AS good, bool_or(toxic IS NOT DISTINCT FROM 1) AS toxic
  FROM labels GROUP BY doc_id),
split AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [
    len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words),
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS f
  FROM split JOIN first USING (t) LEFT JOIN said USING (doc_id)),
cells AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic
  FROM failed GROUP BY part, f),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o
  FROM i a, i b, i c, i d, i e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
applied AS (
  SELECT part, o, step, o[step] AS filter, n, good, toxic, f[o[step]] AS fails,
         len(list_filter(o[:step - 1], lambda x: f[x])) AS earlier, len(list_filter(f, lambda x: x)) AS failing
  FROM cells, orders, (SELECT i AS step FROM i)),
steps AS (
  SELECT part, o, step, filter,
         sum(CASE WHEN earlier = 0 AND NOT fails THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN earlier = 0 AND fails THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN earlier > 0 AND fails THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN fails AND failing = 1 THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN earlier = 0 AND fails THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN earlier = 0 AND fails THEN toxic ELSE 0 END) AS toxic_lost
  FROM applied GROUP BY part, o, step, filter)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
       CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM steps
"""


def _codes(books: str, name: str) -> str:
    """Nearest entry of every part in the codebooks ``books`` (p, e, c)."""
    return f"""{name} AS (
  SELECT r, p, any_value(x) AS x, min(z) AS z FROM (
    SELECT cut.r, cut.p, cut.x, {{'d': CAST(list_sum(list_transform(list_zip(cut.x, b.c), lambda y: (y[1] - y[2]) * (y[1] - y[2]))) AS BIGINT),
                                 'e': b.e}} AS z
    FROM cut JOIN {books} b USING (p)) GROUP BY r, p)"""


def _moved(books: str, codes: str, name: str) -> str:
    return f"""{name} AS (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM {books} b LEFT JOIN (
    SELECT p, e, list(m ORDER BY i) AS c FROM (
      SELECT p, z.e AS e, i, CAST(floor(CAST(sum(x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
      FROM {codes}, (SELECT unnest(range(1, 5)) AS i) GROUP BY p, z.e, i) GROUP BY p, e) m USING (p, e))"""


# The tables' vectors have 64 components: 16 parts of 4. Sums stay below 2^53, and a quotient of two such integers
# that is not whole differs from the next whole number by more than the rounding.
ORACLE["op12_vector_codes"] = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label,
         list_transform(embedding, lambda v: CAST(floor(256 * CAST(v AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
cut AS (SELECT r, p, x[4 * p + 1:4 * p + 4] AS x FROM kept, (SELECT unnest(range(16)) AS p)),
books0 AS (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= 64),
{_codes('books0', 'codes0')},
{_moved('books0', 'codes0', 'books1')},
{_codes('books1', 'codes1')},
{_moved('books1', 'codes1', 'books2')},
{_codes('books2', 'codes2')},
coded AS (
  SELECT r, string_agg(printf('%02x', z.e), '' ORDER BY p) AS code, CAST(sum(z.d) AS BIGINT) AS error FROM codes2 GROUP BY r),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (r), digest
"""
