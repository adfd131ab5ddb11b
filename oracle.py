"""The same results in DuckDB SQL.

Written row by row (tokens as rows, gaps and islands, plain joins), where the
Spark side works on arrays inside the document row, so the two agree only if
both are right. The word lists are shared; the rules are written out again.
"""

from __future__ import annotations

from zlib import crc32

from phraseloom.functions import lexicon as lx
from phraseloom.functions.text import ENTITIES

BLANK = r"\t\n\x0B\f\r\x{85}\p{Z}"
TOKEN = rf"[\p{{L}}\p{{N}}]+(?:[-''’][\p{{L}}\p{{N}}]+)*|[^{BLANK}]"
ENDING = r"(?i)([\p{L}\p{N}])([''’](?:s|re|ve|ll|d|m)|n[''’]t)([^\p{L}\p{N}]|$)"
LANGUAGE = f"CASE WHEN lang IN ({', '.join(repr(x) for x in lx.LEXICONS)}) THEN lang ELSE 'en' END AS lang"
CORPUS = f"SELECT doc_id, {LANGUAGE}, text FROM documents"
# the file name holds words of the text; a title is the name without .txt
TITLE = "array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}')[1:4], ' ') || ' ' || doc_id"
FILE = f"source || '/' || {TITLE} || '.txt'"
TITLED_DOCS = f"SELECT doc_id, {LANGUAGE}, {TITLE} || '. ' || text AS text FROM documents"


def fold(x: str) -> str:
    return f"lower(replace({x}, 'İ', 'i'))"


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def tag_sql(t: str, lexicon: lx.Lexicon) -> str:
    """Tag of a folded token."""
    case = "".join(f" WHEN {t} IN ({quoted(ws)}) THEN '{tag}'" for tag, ws in lexicon.words().items())
    suffixes = "".join(f" WHEN suffix({t}, '{s}') THEN '{tag}'" for s, tag in lexicon.suffixes)
    return (
        f"CASE{case} WHEN {t} IN ('.', '!', '?') THEN '.' WHEN {t} = ',' THEN ',' WHEN {t} IN (':', ';') THEN ':'"
        rf" WHEN NOT regexp_matches({t}, '[\p{{L}}\p{{N}}]') THEN 'SYM'"
        rf" WHEN regexp_full_match({t}, '\p{{Nd}}+') THEN 'CD'{suffixes} ELSE 'NN' END"
    )


def singular_sql(w: str) -> str:
    irregular = "".join(f" WHEN {w} = '{a}' THEN '{b}'" for a, b in lx.IRREGULAR.items())
    endings = "".join(
        f" WHEN suffix({w}, '{a}')" + (f" AND length({w}) > 4" if a == "ies" else "")
        + f" THEN left({w}, length({w}) - {len(a)}) || '{b}'"
        for a, b in lx.ENDINGS
    )
    return (
        f"CASE{irregular} WHEN {w} IN ({quoted(lx.UNCHANGED)}) THEN {w}{endings}"
        f" WHEN regexp_matches({w}, '(ss|us|is)$') THEN {w}"
        f" WHEN suffix({w}, 's') THEN left({w}, length({w}) - 1) ELSE {w} END"
    )


CONTENT = r"(regexp_matches(tag, 'NN|JJ|VB') AND regexp_full_match(token, '[\p{L}\p{Nd}]+') AND length(token) > 2)"


def split_endings(x: str) -> str:
    # twice, as neighbours share a character
    for _ in range(2):
        x = rf"regexp_replace({x}, '{ENDING}', '\1 \2\3', 'g')"
    return x


def tokens_sql(docs: str, more: str = "") -> str:
    """doc_id, ``more``, pos, token"""
    return (
        f"SELECT doc_id, {more}CAST(generate_subscripts(t, 1) - 1 AS INTEGER) AS pos, unnest(t) AS token "
        f"FROM (SELECT doc_id, {more}regexp_extract_all({split_endings('text')}, '{TOKEN}') AS t FROM ({docs}) d) x"
    )


def tagged_sql(docs: str, lexicon: lx.Lexicon = lx.ENGLISH) -> str:
    """doc_id, pos, token, tag"""
    return (
        f"SELECT doc_id, pos, token, {tag_sql('f', lexicon)} AS tag "
        f"FROM (SELECT *, {fold('token')} AS f FROM ({tokens_sql(docs)}) k) y"
    )


def context_sql(docs: str) -> str:
    """Tags changed rule by rule, by what stands before and behind."""
    q = tagged_sql(docs)
    for rule in lx.ENGLISH_CONTEXT:
        fits = f"tag IN ({quoted(rule.tag)})"
        if rule.after:
            fits += f" AND coalesce(lag(tag) OVER o IN ({quoted(rule.after)}), false)"
        if rule.before:
            fits += f" AND coalesce(lead(tag) OVER o IN ({quoted(rule.before)}), false)"
        q = (
            f"SELECT doc_id, pos, token, CASE WHEN {fits} THEN '{rule.to}' ELSE tag END AS tag "
            f"FROM ({q}) r WINDOW o AS (PARTITION BY doc_id ORDER BY pos)"
        )
    return q


def by_language(make) -> str:
    """An expression for the language of the row."""
    cases = "".join(f" WHEN '{lang}' THEN {make(lexicon)}" for lang, lexicon in lx.LEXICONS.items())
    return f"CASE lang{cases} END"


def chain(docs: str = CORPUS, prefix: str = "") -> str:
    """CTEs from documents (doc_id, lang, text) to counts per document."""
    p = prefix
    word = by_language(lambda lexicon: singular_sql("f") if lexicon.singularize else "f")
    return f"""
{p}src AS MATERIALIZED ({docs}),
{p}tagged AS (
  SELECT *, {by_language(lambda lexicon: tag_sql("f", lexicon))} AS tag
  FROM (SELECT *, {fold('token')} AS f FROM ({tokens_sql(f'SELECT doc_id, lang, text FROM {p}src', 'lang, ')}) k) y),
{p}marked AS (
  SELECT doc_id, lang, pos, {word} AS word, NOT {CONTENT} AS closes,
    sum(CASE WHEN {CONTENT} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
  FROM {p}tagged),
{p}ends AS (SELECT doc_id, max(run) AS closed FROM {p}marked GROUP BY doc_id),
{p}cand AS MATERIALIZED (
  SELECT doc_id, lang, run, string_agg(word, ' ' ORDER BY pos) AS phrase
  FROM {p}marked JOIN {p}ends USING (doc_id) WHERE NOT closes AND run < closed GROUP BY doc_id, lang, run),
{p}dp AS MATERIALIZED (SELECT doc_id, lang, phrase, count(*) AS tf FROM {p}cand GROUP BY doc_id, lang, phrase)"""


def corpus(prefix: str = "", least: int = 2) -> str:
    p = prefix
    return f"""
{p}dl AS MATERIALIZED (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM {p}dp GROUP BY doc_id),
{p}pc AS MATERIALIZED (SELECT lang, phrase, CAST(sum(tf) AS BIGINT) AS cf FROM {p}dp GROUP BY lang, phrase),
{p}kept AS MATERIALIZED (SELECT dp.* FROM {p}dp dp ANTI JOIN (SELECT * FROM {p}pc WHERE cf < {least}) rare USING (lang, phrase)),
{p}stats AS MATERIALIZED (
  SELECT lang, count(*) AS n, CAST(round_even(avg(s), 0) AS DOUBLE) AS avgdl
  FROM (SELECT doc_id, lang, sum(tf) AS s FROM {p}kept GROUP BY doc_id, lang) x GROUP BY lang),
{p}inputs AS MATERIALIZED (
  SELECT k.doc_id, k.lang, k.phrase, k.tf, pc.cf, dl.dl FROM {p}kept k JOIN {p}pc pc USING (lang, phrase) JOIN {p}dl dl USING (doc_id)),
{p}scores AS MATERIALIZED (
  SELECT doc_id, lang, phrase,
    CASE WHEN n - cf + 0.5::DOUBLE > 0 THEN
      ln((n - cf + 0.5::DOUBLE) / (cf + 0.5::DOUBLE)) * (tf * (1.2::DOUBLE + 1))
      / (tf + 1.2::DOUBLE * (1 - 0.75::DOUBLE + (0.75::DOUBLE * dl / avgdl))) END AS bm25
  FROM {p}inputs JOIN {p}stats USING (lang)),
{p}passed AS MATERIALIZED (SELECT * FROM {p}scores WHERE bm25 >= 5.0),
{p}model AS MATERIALIZED (SELECT lang, phrase, avg(bm25) AS bm25 FROM {p}passed GROUP BY lang, phrase HAVING avg(bm25) >= 5.0)"""


def scored(target: str = "", model: str = "") -> str:
    """Ranked phrases of documents in ``{target}src`` under ``{model}model``."""
    t = target
    return f"""
{t}matches AS MATERIALIZED (SELECT dp.doc_id, dp.phrase, m.bm25 FROM {t}dp dp JOIN {model}model m USING (lang, phrase)),
{t}kp AS MATERIALIZED (
  SELECT doc_id, CAST(rk AS INTEGER) AS rank, phrase, bm25 FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(bm25, 6) DESC, phrase) AS rk FROM {t}matches) r
  WHERE rk <= 30)"""


def summarized(target: str = "") -> str:
    t = target
    return f"""
{t}sent AS MATERIALIZED ({sentences_sql(f'SELECT doc_id, text FROM {t}src')}),
{t}hits AS MATERIALIZED (
  SELECT s.doc_id, s.sentence, k.phrase, k.bm25, k.rank FROM {t}sent s JOIN {t}kp k USING (doc_id)
  WHERE k.rank <= 10 AND contains({fold('s.piece')}, k.phrase) AND length(s.piece) > 20 AND {words_sql('s.piece')} >= 3),
{t}totals AS MATERIALIZED (SELECT doc_id, sentence, sum(bm25 ORDER BY rank) AS total FROM {t}hits GROUP BY doc_id, sentence),
{t}best AS (
  SELECT doc_id, sentence FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(total, 6) DESC, sentence) AS rk
    FROM {t}totals WHERE total > 0) b WHERE rk <= 3),
{t}picked AS (
  SELECT doc_id, list(piece ORDER BY sentence) AS summary FROM {t}best JOIN {t}sent USING (doc_id, sentence) GROUP BY doc_id),
{t}summaries AS MATERIALIZED (
  SELECT d.doc_id, coalesce(p.summary, {fallback_sql('d.text')}) AS summary FROM {t}src d LEFT JOIN {t}picked p USING (doc_id)),
{t}terms AS MATERIALIZED (SELECT doc_id, list(phrase ORDER BY rank) AS terms FROM {t}kp GROUP BY doc_id)"""


def sentences_sql(docs: str) -> str:
    return (
        "SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS sentence, unnest(s) AS piece "
        f"FROM (SELECT doc_id, string_split_regex(text, '[.!?]') AS s FROM ({docs}) d) x"
    )


def words_sql(x: str) -> str:
    """Non-blank runs, plus one for a leading blank."""
    return (
        f"(len(regexp_extract_all({x}, '[^{BLANK}]+'))"
        f" + CASE WHEN regexp_matches({x}, '^[{BLANK}]') THEN 1 ELSE 0 END)"
    )


def fallback_sql(text: str) -> str:
    first = f"string_split_regex({text}, '[.!?]')"
    return f"list_transform(range(least(3, len({first}))), lambda i: {first}[1])"


def decoded_sql(x: str) -> str:
    """Character references, piece by piece behind each ampersand."""
    names = ", ".join("'" + n + "': '" + c.replace("'", "''") + "'" for n, c in ENTITIES.items())
    code = (
        "CASE WHEN regexp_matches(p, '^#[0-9]{1,7};') THEN CAST(regexp_extract(p, '^#([0-9]+);', 1) AS INTEGER) "
        "WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]{1,6};') "
        "THEN CAST('0x' || regexp_extract(p, '^#[xX]([0-9a-fA-F]+);', 1) AS INTEGER) END"
    )
    valid = f"({code} BETWEEN 1 AND 55295 OR {code} BETWEEN 57344 AND 1114111)"
    name = "regexp_extract(p, '^([A-Za-z][A-Za-z0-9]*);', 1)"
    rest = "substr(p, strpos(p, ';') + 1)"
    piece = (
        f"CASE WHEN {valid} THEN chr({code}) || {rest} "
        f"WHEN map_contains(MAP {{{names}}}, {name}) THEN MAP {{{names}}}[{name}] || {rest} ELSE '&' || p END"
    )
    parts = f"string_split({x}, '&')"
    return f"({parts}[1] || array_to_string(list_transform({parts}[2:], lambda p: {piece}), ''))"


def page_text_sql(html: str = "html") -> str:
    x = html
    for pattern, replacement in (
        (r"(?is)<(?:script|style)(?:[ \t\r\n/][^<>]*)?>.*?(?:</(?:script|style)[^<>]*>|\z)", "' '"),
        (r"(?s)<!--.*?(?:-->|\z)", "' '"),
        (r"(?i)</(?:p|div|li|h[1-6]|article|title)>|<br ?/?>", "chr(10)"),
        (r"<[^<>]*>", "''"),
    ):
        x = f"regexp_replace({x}, '{pattern}', {replacement}, 'g')"
    x = decoded_sql(x)
    x = rf"regexp_replace({x}, '[ \t\r\f]+', ' ', 'g')"
    x = rf"regexp_replace({x}, ' ?\n[ \n]*', chr(10), 'g')"
    return f"trim({x}, ' ' || chr(10))"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts) + "\n"


CONVERSATIONS = "SELECT conv_id || '-' || turn AS doc_id, 'en' AS lang, text FROM conversations"
NO_PHRASE = "'Error processing the Document: no candidate phrase found'"


def answers() -> str:
    """CTEs: one row per record of the requests made from conversations."""
    error = "'Error processing the Document: ' || problem"
    return with_(chain(TITLED_DOCS), corpus(), chain(CONVERSATIONS, "c_"), scored("c_"), summarized("c_")) + f""",
ok AS (
  SELECT s.doc_id AS request_id, 0 AS pos, s.doc_id AS recordId,
    CASE WHEN c.doc_id IS NULL THEN {NO_PHRASE} END AS error,
    CAST(to_json(coalesce(t.terms, [])) AS VARCHAR) AS keyphrases,
    CAST(to_json(s.summary) AS VARCHAR) AS summaries
  FROM c_summaries s LEFT JOIN c_terms t USING (doc_id) LEFT JOIN (SELECT DISTINCT doc_id FROM c_cand) c USING (doc_id)),
bad AS (
  SELECT doc_id AS request_id, pos, doc_id || kind AS recordId, {error} AS error
  FROM c_src, (VALUES (1, '-n', 'content is not a string'), (2, '-m', 'content is missing'), (3, '-z', 'content is null'))
    v(pos, kind, problem)),
answered AS (
  SELECT request_id, CAST(pos AS INTEGER) AS pos, recordId,
    CASE WHEN error IS NULL THEN keyphrases END AS keyphrases,
    CASE WHEN error IS NULL THEN summaries END AS summaries, error
  FROM (SELECT * FROM ok UNION ALL SELECT request_id, pos, recordId, error, NULL, NULL FROM bad) u)
"""


def oracle_sql() -> dict[str, str]:
    base = with_(chain())
    # corpora count titles, scoring does not
    titled = with_(chain(TITLED_DOCS))
    full = with_(chain(TITLED_DOCS), corpus())
    ranked = with_(chain(TITLED_DOCS), corpus(), chain(CORPUS, "u_"), scored("u_"))
    summed = with_(chain(TITLED_DOCS), corpus(), chain(CORPUS, "u_"), scored("u_"), summarized("u_"))
    all_docs = "SELECT doc_id, text FROM documents"
    pages = f"SELECT page_id AS doc_id, 'en' AS lang, replace(regexp_extract(url, '([^/]*)$', 1), '.txt', '') || '. ' || {page_text_sql()} AS text FROM pages"
    sql = {
        "page_text": f"SELECT page_id, {page_text_sql()} AS text FROM pages",
        "titled_text": f"SELECT doc_id, {TITLE} || '. ' || text AS titled FROM documents",
        "document_tokens": tokens_sql(all_docs),
        "tagged_tokens": tagged_sql(all_docs),
        "content_tokens": f"SELECT doc_id, pos, token, tag FROM ({tagged_sql(all_docs)}) t WHERE {CONTENT}",
        "singular_tokens": f"SELECT doc_id, pos, token, {singular_sql('f')} AS singular FROM "
        f"(SELECT *, {fold('token')} AS f FROM ({tagged_sql(all_docs)}) t WHERE {CONTENT}) c",
        "context_tags": context_sql(all_docs),
        "context_phrases": f"""WITH marked AS (
          SELECT doc_id, pos, {singular_sql(fold('token'))} AS word, NOT {CONTENT} AS closes,
            sum(CASE WHEN {CONTENT} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run
          FROM ({context_sql(all_docs)}) c),
        ends AS (SELECT doc_id, max(run) AS closed FROM marked GROUP BY doc_id)
        SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS n,
          string_agg(word, ' ' ORDER BY pos) AS phrase
        FROM marked JOIN ends USING (doc_id) WHERE NOT closes AND run < closed GROUP BY doc_id, run""",
        "candidate_phrases": base
        + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS n, phrase FROM cand",
        "doc_phrase_counts": titled + "SELECT doc_id, phrase, tf FROM dp",
        "top_phrases_per_document": titled
        + "SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, phrase) AS INTEGER) AS rank, phrase, tf FROM dp",
        "document_lengths": full + "SELECT doc_id, dl FROM dl",
        "phrase_counts": full + "SELECT lang, phrase, cf FROM pc",
        "repeated_phrases": full + "SELECT lang, phrase, cf FROM pc WHERE cf > 1",
        "kept_phrases": full + "SELECT doc_id, phrase, tf FROM kept",
        "corpus_stats": full + "SELECT lang, n, avgdl FROM stats",
        "scoring_inputs": full + "SELECT doc_id, lang, phrase, tf, cf, dl FROM inputs",
        "bm25_scores": full + "SELECT doc_id, phrase, round(bm25, 6) AS bm25 FROM scores",
        "doc_keyphrases": full + "SELECT doc_id, phrase, round(bm25, 6) AS bm25 FROM passed",
        "phrase_model": full + "SELECT lang, phrase, round(bm25, 6) AS bm25 FROM model",
        "phrase_model_by_language": with_(chain(), corpus()) + "SELECT lang, phrase, round(bm25, 6) AS bm25 FROM model",
        "page_model": with_(chain(pages), corpus()) + "SELECT phrase, round(bm25, 6) AS bm25 FROM model",
        "document_matches": ranked + "SELECT doc_id, phrase, round(bm25, 6) AS bm25 FROM u_matches",
        "document_keyphrases": ranked + "SELECT doc_id, rank, phrase, round(bm25, 6) AS bm25 FROM u_kp",
        "benchmark_keyphrases": with_(
            chain(TITLED_DOCS), corpus(), chain("SELECT item_id AS doc_id, 'en' AS lang, text FROM benchmark", "b_"), scored("b_")
        )
        + "SELECT doc_id, rank, phrase, round(bm25, 6) AS bm25 FROM b_kp",
        "document_sentences": sentences_sql(all_docs),
        "sentence_hits": summed + "SELECT doc_id, sentence, phrase, round(bm25, 6) AS bm25 FROM u_hits",
        "sentence_scores": summed + "SELECT doc_id, sentence, round(total, 6) AS total FROM u_totals WHERE total > 0",
        "document_summaries": summed + "SELECT doc_id, CAST(to_json(summary) AS VARCHAR) AS summary FROM u_summaries",
        "summary_fallback": f"SELECT doc_id, CAST(to_json({fallback_sql('text')}) AS VARCHAR) AS repeated, "
        "CAST(to_json(string_split_regex(text, '[.!?]')[1:3]) AS VARCHAR) AS lead FROM documents",
        "word_counts": f"SELECT doc_id, CAST({words_sql('text')} AS INTEGER) AS words FROM documents",
        "sampled_documents": "SELECT doc_id, text FROM documents ORDER BY md5('phraseloom:' || doc_id) LIMIT 250",
        "encoded_ids": f"SELECT doc_id, to_base64(encode({FILE})) AS id, {FILE} AS decoded FROM documents",
        "enriched_documents": summed
        + f"SELECT to_base64(encode({FILE})) AS id, {TITLE} || '.txt' AS filename, 'txt' AS filetype, text AS content, "
        "CAST(to_json(summary) AS VARCHAR) AS summary, CAST(to_json(coalesce(terms, [])) AS VARCHAR) AS terms "
        "FROM documents d JOIN u_summaries USING (doc_id) LEFT JOIN u_terms USING (doc_id)",
        "filetype_facets": with_(
            chain(TITLED_DOCS),
            corpus(),
            chain(
                f"SELECT {FILE} AS doc_id, {LANGUAGE}, text FROM documents UNION ALL "
                f"SELECT 'pages/' || page_id || '.html' AS doc_id, 'en' AS lang, {page_text_sql()} AS text FROM pages",
                "f_",
            ),
            scored("f_"),
        )
        + "SELECT split_part(doc_id, '.', 2) AS filetype, count(*) AS docs, "
        "CAST(sum(CASE WHEN doc_id IN (SELECT doc_id FROM f_kp) THEN 1 ELSE 0 END) AS BIGINT) AS with_terms "
        "FROM f_src GROUP BY 1",
        "term_facets": ranked + "SELECT phrase AS term, count(*) AS docs FROM u_kp GROUP BY phrase",
        "facets": ranked
        + """, valued AS (
          SELECT 'terms' AS field, phrase AS value FROM u_kp UNION ALL SELECT 'filetype', 'txt' FROM documents UNION ALL
          SELECT 'creation_ts', strftime(date_trunc('month', make_timestamp((1600000000 + doc_id * 86400) * 1000000)), '%Y-%m-%d')
          FROM documents),
        counted AS (SELECT field, value, count(*) AS docs FROM valued GROUP BY field, value)
        SELECT field, value, docs, CAST(row_number() OVER (PARTITION BY field ORDER BY docs DESC, value) AS INTEGER) AS rank
        FROM counted QUALIFY rank <= 12""",
        "request_records": "SELECT conv_id || '-' || turn AS request_id, CAST(pos AS INTEGER) AS pos, "
        "conv_id || '-' || turn || kind AS recordId, CASE WHEN pos = 0 THEN text END AS content, problem FROM conversations, "
        "(VALUES (0, '', NULL), (1, '-n', 'content is not a string'), (2, '-m', 'content is missing'), "
        "(3, '-z', 'content is null')) v(pos, kind, problem)",
        "request_rejects": "SELECT conv_id || '-' || turn AS request_id, text AS corrupt_body FROM conversations WHERE role = 'user'",
        "response_records": answers() + "SELECT request_id, pos, recordId, keyphrases, summaries, error FROM answered",
        "response_bodies": answers()
        + """SELECT request_id, '{"values":[' || string_agg('{"recordId":"' || recordId || '","data":{' ||
          CASE WHEN error IS NULL THEN '"keyphrases":' || CAST(to_json(keyphrases) AS VARCHAR) || ',"summaries":' ||
            CAST(to_json(summaries) AS VARCHAR) ELSE '' END || '},"errors":[' ||
          coalesce('"' || error || '"', '') || '],"warnings":[]}', ',' ORDER BY pos) || ']}' AS body
          FROM answered GROUP BY request_id UNION ALL
          SELECT conv_id || '-' || turn || '-e', '{"values":[]}' FROM conversations WHERE role = 'assistant'""",
        "stream_rejects": """SELECT conv_id || '-' || turn || '-b' AS request_id, '{"values"' AS corrupt_body
          FROM conversations WHERE turn = 0""",
        "document_rejects": "SELECT doc_id, CASE WHEN source = 'src1' THEN 'text is blank' ELSE 'text is missing' END AS reason "
        "FROM documents WHERE source IN ('src1', 'src2')",
        "phrase_model_of_three": with_(chain(TITLED_DOCS), corpus(least=3))
        + "SELECT lang, phrase, round(bm25, 6) AS bm25 FROM model",
    }
    sql["phrase_runs"] = base + "SELECT doc_id, phrase FROM cand"
    sql["phrase_file_roundtrip"] = sql["doc_phrase_counts"]
    for same in ("published_model", "model_after_append", "model_of_phrase_files"):
        sql[same] = sql["phrase_model"]
    # DuckDB has no crc32: the sources whose checksum is even
    early = f"{TITLED_DOCS} WHERE source IN ({quoted(s for s in (f'src{i}' for i in range(1000)) if crc32(s.encode()) % 2 == 0)})"
    sql["model_after_withdrawal"] = (
        with_(chain(early), corpus()) + "SELECT lang, phrase, round(bm25, 6) AS bm25 FROM model"
    )
    sql["stream_scoring"] = sql["response_records"]
    return sql
