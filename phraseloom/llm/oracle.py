"""DuckDB SQL for the registered queries of this package that SQL can express:
written by windows and joins over words as rows, where the operators work on
hashes inside a task. The license, secret, toxicity, BPE, sharding and URL
queries rest on trained models, a tokenizer file or a keyed permutation; tests
compare them with brute-force versions."""

from __future__ import annotations

from phraseloom.llm import collocations, neardup, quality
from phraseloom.llm.decontaminate import WINDOW

SPACED = r"[^\x20\x09-\x0D]+"
ALPHANUMERIC = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(x: str) -> str:
    return f"translate(coalesce({x}, ''), '{UPPER}', '{LOWER}')"


def numbered(table: str, key: str, array: str) -> str:
    """key, array to one row per element with its position from 0."""
    return f"SELECT {key}, CAST(generate_subscripts(a, 1) - 1 AS BIGINT) AS i, unnest(a) AS w FROM (SELECT {key}, {array} AS a FROM {table}) s"


def quality_sql() -> str:
    rules = quality.DEFAULTS
    line = f"list_aggregate(regexp_extract_all(regexp_replace({folded('w')}, '[0-9]', '0', 'g'), '{SPACED}'), 'string_agg', ' ')"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
words AS ({numbered("docs", "r", f"regexp_extract_all(t, '{SPACED}')")}),
grams AS (
  SELECT r, i, [w, lead(w) OVER o, lead(w, 2) OVER o] AS g, lead(w, 2) OVER o IS NOT NULL AS whole
  FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM grams WHERE whole) x WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, range(3) AS d(k) GROUP BY r),
counted AS (SELECT r, count(*) AS n_words, sum(length(w)) AS chars FROM words GROUP BY r),
lines AS (
  SELECT r, i, w, {line} AS line, len(regexp_extract_all(w, '{SPACED}')) AS size
  FROM ({numbered("docs", "r", "string_split(t, chr(10))")}) x WHERE regexp_matches(w, '{SPACED}')),
dups AS (SELECT r, count(*) - count(DISTINCT w) AS n FROM lines GROUP BY r),
hosts AS (SELECT host, count(DISTINCT t) AS n FROM docs GROUP BY host),
often AS (
  SELECT host, line, min(doc_id) AS first, count(DISTINCT t) AS n FROM lines JOIN docs USING (r) GROUP BY host, line),
cut AS (
  SELECT r, sum(size) AS n FROM lines JOIN docs d USING (r) JOIN often o USING (host, line) JOIN hosts h USING (host)
  WHERE o.n > {rules.line_documents} AND (h.n >= {rules.small_host} OR o.n > h.n * {rules.line_share}::DOUBLE) AND d.doc_id IS DISTINCT FROM o.first GROUP BY r),
base AS (
  SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(chars, 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(u.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(v.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(x.n, 0) AS BIGINT) AS removed_words
  FROM docs LEFT JOIN counted USING (r) LEFT JOIN dups u USING (r) LEFT JOIN covered v USING (r) LEFT JOIN cut x USING (r)),
judged AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed,
    n_words - removed_words < n_words * {rules.min_remaining}::DOUBLE AS depleted
  FROM base)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM judged"""


def decontamination_sql() -> str:
    joined = lambda n: " || ' ' || ".join(f"w{k}" for k in range(n))
    leads = ", ".join(f"lead(w, {k}) OVER o AS w{k}" for k in range(WINDOW))

    def grams(words: str, key: str) -> str:
        """Windows of every length up to the full one: key, i, size, g."""
        parts = [f"SELECT {key}, i, {n} AS size, {joined(n)} AS g FROM led WHERE w{n - 1} IS NOT NULL" for n in range(1, WINDOW + 1)]
        return (
            f"WITH led AS (SELECT {key}, i, {leads} FROM {words} WINDOW o AS (PARTITION BY {key} ORDER BY i)) "
            + " UNION ALL ".join(parts)
        )

    return rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {folded("text")} AS t FROM documents),
words AS MATERIALIZED ({numbered("docs", "r", f"regexp_extract_all(t, '{ALPHANUMERIC}')")}),
items AS (SELECT row_number() OVER () AS b, coalesce(CAST(item_id AS VARCHAR), '') AS item, {folded("text")} AS t FROM benchmark),
item_words AS MATERIALIZED ({numbered("items", "b", f"regexp_extract_all(t, '{ALPHANUMERIC}')")}),
item_sizes AS (SELECT b, least({WINDOW}, count(*)) AS size FROM item_words GROUP BY b),
wanted AS MATERIALIZED (
  SELECT DISTINCT item, size, g FROM ({grams("item_words", "b")}) x JOIN item_sizes USING (b, size) JOIN items USING (b)),
sizes AS (SELECT DISTINCT size FROM wanted),
found AS MATERIALIZED (
  SELECT DISTINCT r, i, x.size, item FROM ({grams("words", "r")}) x JOIN wanted USING (size, g)),
hit AS (SELECT r, count(DISTINCT i + k) AS n FROM found, range({WINDOW}) AS d(k) WHERE k < size GROUP BY r),
owned AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT r, item FROM found) x GROUP BY r),
counted AS (SELECT r, count(*) AS n FROM words GROUP BY r)
SELECT doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(o.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN counted c USING (r) LEFT JOIN hit h USING (r) LEFT JOIN owned o USING (r)"""


def near_duplicates_sql() -> str:
    percent = neardup.DEFAULTS.percent
    return rf"""
WITH RECURSIVE docs AS (SELECT doc_id, {folded("text")} AS t FROM documents),
words AS ({numbered("docs", "doc_id", f"regexp_extract_all(t, '{SPACED}')")}),
pairs AS (
  SELECT doc_id, w || ' ' || lead(w) OVER o AS s, w, count(*) OVER (PARTITION BY doc_id) AS n
  FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, CASE WHEN n = 1 THEN w ELSE s END AS s FROM pairs WHERE n = 1 OR s IS NOT NULL),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
-- a pair at the limit shares a shingle among the rarest of each side
ranked AS (
  SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY f, s) AS k
  FROM (SELECT *, count(*) OVER (PARTITION BY s) AS f FROM shingles) x),
prefix AS (SELECT doc_id, s FROM ranked JOIN sizes USING (doc_id) WHERE 100 * (k - 1) <= (100 - {percent}) * n),
candidates AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM prefix a JOIN prefix b USING (s) WHERE a.doc_id < b.doc_id),
common AS (
  SELECT a, b, count(*) AS k FROM candidates JOIN shingles x ON x.doc_id = a JOIN shingles y ON y.doc_id = b AND y.s = x.s GROUP BY a, b),
linked AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
edges AS MATERIALIZED (SELECT a, b FROM linked UNION SELECT b, a FROM linked),
reached AS (
  SELECT doc_id AS a, doc_id AS c FROM docs UNION SELECT e.b, r.c FROM reached r JOIN edges e ON e.a = r.a),
component AS (SELECT a AS doc_id, min(c) AS component_id FROM reached GROUP BY a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM docs JOIN component USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def warc_sql() -> str:
    return """
WITH given AS (SELECT page_id, coalesce(html, '') AS h, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
latest AS (SELECT h, max(page_id) AS last FROM given WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM given LEFT JOIN latest USING (h)"""


def collocations_sql() -> str:
    how = collocations.DEFAULTS
    return rf"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, {folded("text")} AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs),
words AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, size, w[i : i + size - 1] AS g
  FROM words, range(1, {how.longest + 1}) AS s(size), range(1, len(w) - size + 2) AS x(i)),
counted AS MATERIALIZED (
  SELECT lang, size, g, CAST(count(*) AS HUGEINT) AS f FROM grams GROUP BY ALL HAVING count(*) >= {how.min_count}),
candidates AS MATERIALIZED (SELECT * FROM counted WHERE size > 1),
inner_phrases AS (
  SELECT lang, g[i : i + k - 1] AS g, max(f) AS most
  FROM candidates, range(2, {how.longest}) AS s(k), range(1, size - k + 2) AS x(i) WHERE k < size GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, x.f AS l, y.f AS r, t.n, k, (1000 * c.f * t.n) // (x.f * y.f) AS score
  FROM candidates c JOIN total t USING (lang), range(1, {how.longest}) AS s(k)
  JOIN counted x ON x.lang = c.lang AND x.g = c.g[1 : k]
  JOIN counted y ON y.lang = c.lang AND y.g = c.g[k + 1 : c.size]
  WHERE k < c.size),
weakest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
kept AS (
  SELECT w.*, array_to_string(w.g, ' ') AS phrase FROM weakest w LEFT JOIN inner_phrases i ON i.lang = w.lang AND i.g = w.g
  WHERE i.most IS NULL OR 100 * i.most < 100 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n,
  CAST(score AS BIGINT) AS score
FROM ranked WHERE rank <= {how.top}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op4_decontamination": decontamination_sql(),
        "op7_near_duplicates": near_duplicates_sql(),
        "op10_warc_archives": warc_sql(),
        "op12_collocations": collocations_sql(),
    }
