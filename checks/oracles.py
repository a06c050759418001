"""The same queries as plain SQL for an independent engine.

Each statement is put together from named common table expressions; a statement carries only
those that it reaches. Where it is possible the SQL takes another road than the DataFrame code:
joins on rule tables instead of CASE chains, numbered rows instead of folds and slices.
"""

from __future__ import annotations

import re

from checks import queries as Q
from checks.views import CATEGORY_WORDS, FEEDBACK_PHRASES, GROUP_WORDS, PHRASES, TAIL_FROM, TAUGHT
from ticketloom import fixed_values as V

SPACE = r"\s\x0B\x1C-\x1F\x{85}\p{Z}"
WORD = r"\p{L}\p{N}_"


def lit(x) -> str:
    if x is None:
        return "NULL"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)


def values(rows) -> str:
    return "VALUES " + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in rows)


def listing(xs) -> str:
    return ", ".join(lit(x) for x in xs)


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def spaced(x: str) -> str:
    """Two replacements and a trim, as the step is described."""
    dashed = f"regexp_replace(lower(coalesce({x}, '')), '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"trim(regexp_replace({dashed}, '\\s+', ' ', 'g'))"


def words(x: str, compat: bool = False) -> str:
    text = f"replace(lower(coalesce({x}, 'nan')), 'can''t', 'cannot')"
    if compat:
        text = f"replace({text}, 'can t', 'cannot')"
    else:
        text = f"regexp_replace({text}, '\\bcan t\\b', 'cannot', 'g')"
    return f"regexp_replace({text}, '[^{WORD}{SPACE}]', '', 'g')"


def without(x: str, literals) -> str:
    for literal in literals:
        x = f"replace({x}, {lit(literal)}, '')"
    return x


def report(x: str) -> str:
    cleaned = strip(without(f"coalesce({x}, '')", V.MARKDOWN_REMNANTS))
    labels = "|".join(V.REPORT_LABELS)
    return strip(f"regexp_replace({cleaned}, '(?im)^[{SPACE}]*[\"'']?({labels}):\\**[{SPACE}]*', '', 'g')")


def key(text: str, date: str, version: str) -> str:
    parts = [f"coalesce(cast({x} AS varchar), 'nan')" for x in (text, date, version)]
    return f"upper(sha1({parts[0]} || '_' || {parts[1]} || '_' || {parts[2]}))"


def ticket(text: str, date: str, version: str) -> str:
    return f"{key(text, date, version)} AS ticket_key, 'BUG-' || substr({key(text, date, version)}, 1, 8) AS TicketID"


def tokens(x: str) -> str:
    """List of a-z tokens with contractions split."""
    text = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z{SPACE}]', '', 'g')"
    for word, parts in V.CONTRACTIONS.items():
        text = f"regexp_replace({text}, '\\b{word}\\b', '{' '.join(parts)}', 'g')"
    return f"regexp_split_to_array({text}, '[{SPACE}]+')"


def lemma_rows(source: str, key: str, text: str) -> str:
    """Lemma text per key by numbered tokens, lost keys brought back by an outer join."""
    return f"""
    SELECT s.{key}, coalesce(g.cleaned_text, '') AS cleaned_text FROM {source} s LEFT JOIN (
      SELECT t.{key}, string_agg(coalesce(l.lemma, t.token), ' ' ORDER BY t.pos) AS cleaned_text
      FROM (SELECT {key}, unnest(list) AS token, generate_subscripts(list, 1) AS pos
            FROM (SELECT {key}, {tokens(text)} AS list FROM {source})) t
      LEFT JOIN lemmas l ON l.token = t.token
      WHERE t.token <> '' AND t.token NOT IN (SELECT token FROM stopwords)
      GROUP BY t.{key}) g ON g.{key} = s.{key}"""


def score_rows(source: str, key: str, text: str) -> str:
    return f"""
    SELECT s.{key}, coalesce(g.score, 0.0) AS sentiment_score FROM {source} s LEFT JOIN (
      SELECT t.{key}, round(avg(x.polarity), 12) AS score
      FROM (SELECT {key}, unnest(string_split({text}, ' ')) AS token FROM {source}) t
      JOIN lexicon x ON x.token = t.token GROUP BY t.{key}) g ON g.{key} = s.{key}"""


def padded_version(x: str) -> str:
    part = (
        "CASE WHEN regexp_full_match(p, '[0-9]+') THEN '0' || lpad(cast(length(coalesce(nullif(ltrim(p, '0'), ''), '0')) AS varchar), 4, '0')"
        " || coalesce(nullif(ltrim(p, '0'), ''), '0') ELSE '1' || lower(p) END"
    )
    return (
        f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '[.{SPACE}]+'),"
        f" lambda p: p <> ''), lambda p: {part}), '.')"
    )


KEYWORDS = [(i, c, k) for i, (c, k) in enumerate((c, k) for c, ks in V.TAXONOMY.items() for k in ks)]
BUCKET = (
    "CASE WHEN sentiment_score > -1 AND sentiment_score <= -0.3 THEN 'Negative' "
    "WHEN sentiment_score > -0.3 AND sentiment_score <= 0.3 THEN 'Neutral' "
    "WHEN sentiment_score > 0.3 AND sentiment_score <= 1 THEN 'Positive' END"
)
RANK = "CASE priority_level " + " ".join(f"WHEN '{p}' THEN {i}" for i, p in enumerate(V.PRIORITIES)) + " END"
DETAILS = "ticket_key, TicketID, bug_category, app_version, review_date, review_description"

CTES: dict[str, str] = {
    "phrases(pid, phrase)": values(enumerate(PHRASES)),
    "rules(pos, category, keyword)": values(KEYWORDS),
    "severity(category, syslog_level, severity_code)": values(V.SEVERITY),
    "stopwords(token)": values([(w,) for w in V.STOPWORDS]),
    "lemmas(token, lemma)": values(V.LEMMAS.items()),
    "lexicon(token, polarity)": values(
        (t, p) for t, p in V.LEXICON.items()
    ).replace(")", "::double)"),
    "feed": f"""
    SELECT e.event_id, cast(e.event_id AS varchar) AS review_id, 'user' || e.user_id AS user_name,
      CASE WHEN e.k = 17 THEN NULL WHEN e.k = 23 THEN ''
           ELSE p.phrase || '! ' || e.event_type || ' ' || coalesce(d.text, '') END AS review_description,
      CASE WHEN e.k % 10 <> 0 THEN cast(1 + e.k // 20 AS double) END AS rating,
      cast(floor(e.value) AS bigint) AS thumbs_up,
      CASE WHEN e.k NOT IN (30, 31) THEN e.ts END AS review_date,
      CASE WHEN e.event_type = 'purchase' THEN 'Noted, user' || e.user_id END AS developer_response,
      CASE WHEN e.event_type = 'purchase' THEN e.ts + INTERVAL 1 DAY END AS developer_response_date,
      CASE WHEN e.user_id % 13 <> 0 THEN '1.' || (e.user_id % 4) || '.' || (e.user_id % 12) END AS app_version,
      cast(e.k NOT IN (17, 23) AND p.pid NOT IN ({listing(FEEDBACK_PHRASES)}) AS int) AS is_bug_report,
      e.value / (1 + e.value) AS bug_confidence
    FROM (SELECT *, cast(props->>'k' AS int) AS k FROM events) e
    JOIN phrases p ON p.pid = e.k % {len(PHRASES)} LEFT JOIN documents d ON d.doc_id = e.event_id""",
    "reviews": """
    SELECT 'Google Play' AS source, review_id, cast(NULL AS varchar) AS review_title, user_name,
      review_description, rating, thumbs_up, review_date, developer_response,
      developer_response_date, app_version, 'en' AS language_code, 'us' AS country_code FROM feed""",
    "predictions": f"""
    SELECT review_id, user_name, {spaced('review_description')} AS review_description, review_date,
      app_version, rating, is_bug_report, bug_confidence FROM feed""",
    "matched": f"""
    SELECT t.review_id, min_by(r.category, (-length(r.keyword), r.pos)) AS category
    FROM (SELECT review_id, ' ' || {words('review_description')} || ' ' AS padded FROM predictions) t
    JOIN rules r ON contains(t.padded, ' ' || r.keyword || ' ') GROUP BY t.review_id""",
    "categorized": """
    SELECT p.review_id, p.review_description, coalesce(m.category, 'Other') AS bug_category,
      p.review_date, p.app_version
    FROM predictions p LEFT JOIN matched m USING (review_id) WHERE p.is_bug_report = 1""",
    "tickets": f"""
    SELECT {ticket('c.review_description', 'c.review_date', 'c.app_version')},
      c.review_date AS "Timestamp", coalesce(s.syslog_level, 'debug') AS syslog_level,
      coalesce(s.severity_code, 7) AS severity_code, c.bug_category, c.app_version, c.review_date,
      c.review_description
    FROM categorized c LEFT JOIN severity s ON s.category = c.bug_category""",
    "attended": """
    SELECT DISTINCT ticket_key, TicketID, review_date + INTERVAL 1 DAY AS attended_at FROM tickets WHERE syslog_level = 'crit'
    UNION ALL SELECT 'user' || user_id, 'BUG-user' || user_id, max(ts) FROM events GROUP BY user_id""",
    "sent": """
    SELECT ' ' || ticket_key || ' ' AS ticket_key, ' ' || TicketID || ' ' AS ticket_id FROM tickets WHERE syslog_level = 'err'
    UNION ALL SELECT ' ', ' ' FROM events WHERE event_type = 'view'""",
    "legacy": "SELECT NULL AS ticket_key, 'BUG-' || user_id AS ticket_id FROM events",
    "unsent": f"""
    SELECT {DETAILS} FROM tickets t
    WHERE NOT EXISTS (SELECT 1 FROM sent s WHERE trim(s.ticket_key) = t.ticket_key)""",
    "feedback": "SELECT * FROM predictions WHERE is_bug_report = 0",
    "feedback_text": lemma_rows("feedback", "review_id", "review_description"),
    "feedback_score": score_rows("feedback_text", "review_id", "cleaned_text"),
    "analysed": f"""
    SELECT f.*, t.cleaned_text, s.sentiment_score, {BUCKET} AS sentiment_category
    FROM feedback f JOIN feedback_text t USING (review_id) JOIN feedback_score s USING (review_id)""",
    "bug_text": lemma_rows("categorized", "review_id", "review_description"),
    "bug_score": score_rows("bug_text", "review_id", "cleaned_text"),
    "version_seen": """
    SELECT bug_category, app_version, min(review_date) AS seen FROM categorized
    WHERE app_version IS NOT NULL GROUP BY ALL""",
    "rollup": """
    SELECT c.bug_category, count(*) AS bug_count, max(c.review_date) AS latest_date,
      coalesce(any_value(v.versions), '') AS versions_affected,
      coalesce(any_value(s.syslog_level), 'debug') AS syslog_level,
      coalesce(any_value(s.severity_code), 7) AS severity_code
    FROM categorized c LEFT JOIN severity s ON s.category = c.bug_category
    LEFT JOIN (SELECT bug_category, string_agg(app_version, ', ' ORDER BY seen NULLS LAST, app_version) AS versions
               FROM version_seen GROUP BY bug_category) v ON v.bug_category = c.bug_category
    GROUP BY c.bug_category""",
    "summaries": """
    SELECT bug_category, bug_count AS "count",
      '### 1. SUMMARY: ' || bug_count || ' reports of ' || bug_category AS summary,
      'KEY FINDINGS:' || chr(10) || '- versions ' || versions_affected || chr(10) || '- code ' || severity_code AS key_findings,
      '"Suggested Actions:** check - fix - test ' || bug_count AS suggested_actions,
      CASE severity_code WHEN 2 THEN 'Critical' WHEN 3 THEN 'High' WHEN 4 THEN 'Medium'
        WHEN 6 THEN 'whenever' ELSE 'Unknown' END AS priority_level,
      'from the rollup' AS additional_notes, latest_date, versions_affected, syslog_level, severity_code
    FROM rollup""",
    "responses": """
    SELECT conv_id, turn, CASE role
      WHEN 'user' THEN '### 1. SUMMARY: ' || text || nn || '**KEY FINDINGS:**' || chr(10) || '- ' || dashes
        || nn || '### 3. SUGGESTED ACTIONS: ' || items || nn || '4. PRIORITY LEVEL: ' || level
      WHEN 'assistant' THEN 'summary: ' || items || nn || 'key findings: ' || dashes || nn
        || 'priority level: ' || level || nn || 'because of the reports'
      ELSE text || nn || 'Suggested actions' || nn || items END AS response
    FROM (SELECT *, chr(10) || chr(10) AS nn, replace(text, chr(10), chr(10) || '- ') AS dashes,
            replace(text, '. ', '.' || chr(10) || chr(10)) AS items,
            CASE conv_id % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'high' WHEN 2 THEN 'MEDIUM'
              WHEN 3 THEN 'low' ELSE 'to be decided' END AS level
          FROM conversations)""",
    "paragraphs": f"""
    SELECT conv_id, turn, pos, p,
      CASE WHEN contains(lower(substr(p, 1, 30)), 'summary') THEN 'summary'
           WHEN contains(lower(substr(p, 1, 30)), 'key findings') THEN 'key_findings'
           WHEN contains(lower(substr(p, 1, 35)), 'suggested actions') THEN 'suggested_actions'
           WHEN contains(lower(substr(p, 1, 30)), 'priority') OR contains(lower(substr(p, 1, 30)), 'level')
             THEN 'priority_level' END AS header
    FROM (SELECT conv_id, turn, generate_subscripts(list, 1) AS pos, unnest(list) AS raw,
            {strip('raw')} AS p
          FROM (SELECT conv_id, turn, string_split(response, chr(10) || chr(10)) AS list FROM responses))""",
    "owned": """
    SELECT *, last_value(header IGNORE NULLS) OVER w AS owner,
      max(CASE WHEN header IS NOT NULL THEN pos END) OVER w AS opened_at
    FROM paragraphs WINDOW w AS (PARTITION BY conv_id, turn ORDER BY pos)""",
    "last_opened": """
    SELECT conv_id, turn, owner, max(opened_at) AS opened_at FROM owned
    WHERE header IS NOT NULL GROUP BY ALL""",
    "pieces": f"""
    SELECT o.conv_id, o.turn, o.owner, o.pos, o.header, CASE
      WHEN header IS NULL THEN chr(10) || ltrim(p, {lit(V.SECTION_LEAD)})
      ELSE ltrim({strip("CASE WHEN contains(p, mark) THEN substr(p, strpos(p, mark) + length(mark)) ELSE p END")},
                 {lit(V.SECTION_LEAD)}) END AS piece
    FROM (SELECT *, CASE header WHEN 'summary' THEN 'summary:' WHEN 'key_findings' THEN 'key findings:'
            WHEN 'suggested_actions' THEN 'suggested actions:' ELSE 'priority level:' END AS mark FROM owned) o
    JOIN last_opened l ON l.conv_id = o.conv_id AND l.turn = o.turn AND l.owner = o.owner
    WHERE o.pos >= l.opened_at AND (o.header IS NOT NULL OR o.p <> '')""",
    "sections": f"""
    SELECT conv_id, turn, owner, string_agg(CASE WHEN header = 'priority_level' THEN
        CASE WHEN contains(lower(piece), 'critical') THEN 'Critical' WHEN contains(lower(piece), 'high') THEN 'High'
             WHEN contains(lower(piece), 'medium') THEN 'Medium' WHEN contains(lower(piece), 'low') THEN 'Low'
             ELSE 'Unknown' END
        ELSE piece END, '' ORDER BY pos) AS body,
      any_value(CASE WHEN header = 'priority_level' THEN piece END) AS notes
    FROM pieces GROUP BY ALL""",
    "keyed": """
    SELECT user_name || ':' || cast(rating AS int) AS review_id, event_id AS feed_id, review_date,
      review_description, developer_response FROM feed""",
    "grams": """
    SELECT review_id, list_concat(w, list_transform(list_zip(w[:-2], w[2:]), lambda z: z[1] || ' ' || z[2])) AS g
    FROM (SELECT review_id, list_filter(string_split(cleaned_text, ' '), lambda t: length(t) >= 2) AS w FROM analysed)""",
    "row_terms": """
    SELECT review_id, term, count(*) AS tf FROM (SELECT review_id, unnest(g) AS term FROM grams) GROUP BY ALL""",
    "vocabulary": """
    SELECT term, ln((1 + (SELECT count(*) FROM grams)) / (1 + count(*))) + 1 AS idf
    FROM row_terms GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 100""",
    "weighted": """
    SELECT review_id, term, tf * idf AS w, sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY review_id)) AS norm
    FROM row_terms JOIN vocabulary USING (term)""",
    "taught": f"""
    SELECT doc_id, cast(doc_id % {TAUGHT} NOT IN ({listing(FEEDBACK_PHRASES)}) AS int) AS label FROM labels""",
    "phrase_reviews": f"""
    SELECT cast(event_id AS varchar) AS review_id, 'user' || user_id AS user_name, phrase AS review_description, ts AS review_date,
      '1.0' AS app_version, CASE WHEN k % 10 <> 0 THEN cast(k % 5 + 1 AS double) END AS rating,
      cast(pid NOT IN ({listing(FEEDBACK_PHRASES)}) AS int) AS is_bug
    FROM (SELECT *, cast(props->>'k' AS int) AS k FROM events) JOIN phrases ON pid = k % {len(PHRASES)}""",
    "planted_words(n, i, word)": values((n, i, w) for n, ws in enumerate(CATEGORY_WORDS.values()) for i, w in enumerate(ws)),
    "planted_names(n, known)": values(enumerate(CATEGORY_WORDS)),
    "planted_bugs": """
    SELECT a.word || ' ' || b.word AS review_description, c.known, e.ts AS review_date, cast(e.event_id AS varchar) AS app_version,
      CASE WHEN e.event_id % 10 = 9 THEN 'Other' WHEN e.event_id % 97 <> 5 THEN c.known END AS given
    FROM events e JOIN planted_names c ON c.n = e.event_id % 3
    JOIN planted_words a ON a.n = c.n AND a.i = e.event_id % 4 JOIN planted_words b ON b.n = c.n AND b.i = e.user_id % 4""",
    "group_texts(g, cleaned_text)": values((i, " ".join(ws)) for i, ws in enumerate(GROUP_WORDS)),
    "grouped_texts": "SELECT event_id, cleaned_text FROM events JOIN group_texts ON g = user_id % 5",
}
NAMES = {re.match(r"\w+", head).group(): head for head in CTES}


def reached(sql: str) -> set[str]:
    found: set[str] = set()
    queue = [sql]
    while queue:
        text = queue.pop()
        for name, head in NAMES.items():
            if name not in found and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                found.add(name)
                queue.append(CTES[head])
    return found


def statement(sql: str) -> str:
    needed = reached(sql)
    heads = [f"{head} AS ({CTES[head]})" for name, head in NAMES.items() if name in needed]
    return (f"WITH {', '.join(heads)}\n" if heads else "") + sql


BY_CATEGORY = "SELECT bug_category, count(*) AS bug_count FROM categorized GROUP BY bug_category"
IN_SELECTION = f"trim(app_version) IN ({listing(Q.VERSIONS)})"
CHOSEN = f"{IN_SELECTION} AND bug_category IN ({listing(Q.CATEGORIES)})"
WEEK_END = "cast(date_trunc('week', review_date) AS date) + 6"
WEEKLY = f"""
SELECT cast(cast({WEEK_END} AS date) AS varchar) AS week_end, app_version, bug_category, count(*) AS bug_count FROM categorized
WHERE review_date IS NOT NULL AND app_version IS NOT NULL GROUP BY ALL"""
UPSERT = """
SELECT review_id, feed_id, review_date, review_description, developer_response FROM (
  SELECT *, row_number() OVER (PARTITION BY review_id ORDER BY review_date DESC NULLS FIRST,
    {batch}feed_id) AS n FROM keyed) WHERE n = 1"""
PROFILE = "UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS row_count FROM reviews "
    for c in ("source review_id review_title user_name review_description rating thumbs_up review_date "
              "developer_response developer_response_date app_version language_code country_code").split()
)
SAMPLE = """
SELECT bug_category, cast(row_number() OVER (PARTITION BY bug_category
    ORDER BY sha1('42:' || review_id), review_id) AS int) AS sample_rank,
  review_id, review_description, review_date, app_version FROM categorized"""
TAG = """
SELECT review_id, user_name, coalesce(review_description, '') AS body, thumbs_up, CASE
  WHEN letters > 0 AND sinhala >= letters * 0.5 THEN 'si' WHEN letters = 0 THEN 'unknown'
  ELSE coalesce(language_code, 'unknown') END AS detected_language
FROM (SELECT *,
  length(regexp_replace(coalesce(review_description, ''), '[^\\p{L}\\x{0D80}-\\x{0DFF}]', '', 'g')) AS letters,
  length(regexp_replace(coalesce(review_description, ''), '[^\\x{0D80}-\\x{0DFF}]', '', 'g')) AS sinhala
  FROM reviews)"""
ROMANISED = f"regexp_matches(lower(body), '(^|[^{WORD}])({'|'.join(V.ROMANISED_WORDS)})($|[^{WORD}])')"
BULLETS = f"""
SELECT conv_id, turn, cast(n - 1 AS int) AS item_no, item FROM (
  SELECT conv_id, turn, unnest(items) AS item, generate_subscripts(items, 1) AS n FROM (
    SELECT conv_id, turn, list_filter(list_transform(CASE
        WHEN contains(t, chr(10) || '-') THEN string_split(t, chr(10) || '-')
        WHEN contains(t, chr(10)) THEN string_split(t, chr(10))
        WHEN length(t) - length(replace(t, '-', '')) > 1 THEN string_split(t, '-')
        WHEN length(t) - length(replace(t, '.', '')) > 2 THEN string_split(t, '.')
        ELSE [t] END,
      lambda x: ltrim({strip('x')}, {lit(V.BULLET_LEAD)})), lambda x: x <> '') AS items
    FROM (SELECT conv_id, turn, {strip(without(report('response'), V.MARKDOWN_REMNANTS))} AS t FROM responses)))"""
SECTION_COLUMNS = ", ".join(
    f"{without(f'''coalesce(max(CASE WHEN owner = '{s}' THEN body END), '')''', V.MARKDOWN_REMNANTS)} AS {s}"
    for s in ("summary", "key_findings", "suggested_actions", "priority_level")
)

SELECTS: dict[str, str] = {
    "feed_normalize": "SELECT * FROM reviews",
    "profile_nulls": PROFILE,
    "syslog_lines": """
SELECT '<' || severity_code || '> [' || TicketID || '] (' || upper(syslog_level) || ') ' || bug_category || ' in v'
  || coalesce(app_version, 'nan') || ' on ' || coalesce(strftime(review_date, '%Y-%m-%d'), 'N/A') || ': '
  || coalesce(review_description, 'nan') AS value FROM tickets""",
    "summary_export": "SELECT * FROM summaries WHERE bug_category = 'Login Error'",
    "text_clean_spaced": f"SELECT doc_id, {spaced('text')} AS cleaned FROM documents",
    "text_clean_words": f"""
SELECT review_id, {words('review_description')} AS cleaned, {words('review_description', True)} AS cleaned_compat
FROM reviews""",
    "text_clean_stripped": f"""
SELECT doc_id, regexp_replace(lower(coalesce(text, 'nan')), '[^a-z0-9{SPACE}]', '', 'g') AS cleaned FROM documents""",
    "text_clean_lemmas": lemma_rows("documents", "doc_id", "text"),
    "text_lengths": """
SELECT review_id, cast(length(review_description) AS int) AS review_length,
  CASE WHEN review_description = '' THEN 0
       ELSE cast(len(string_split(review_description, ' ')) AS int) END AS word_count FROM predictions""",
    "bug_keyword_count": "SELECT review_id, " + " + ".join(
        f"cast(contains(review_description, '{k}') AS int)" for k in V.BUG_KEYWORDS
    ) + " AS bug_keyword_count FROM predictions",
    "categorize": """
SELECT p.review_id, coalesce(m.category, 'Other') AS bug_category
FROM predictions p LEFT JOIN matched m USING (review_id)""",
    "categorize_large": f"""
WITH doc_words AS (SELECT doc_id, string_split({words(spaced('text'))}, ' ') AS w FROM documents),
doc_tails AS (
  SELECT {TAIL_FROM} + min(doc_id) AS pos, 'Tail ' || left(keyword, 1) AS category, keyword
  FROM (SELECT doc_id, array_to_string(list_slice(w, greatest(len(w) - 2, 1), len(w)), ' ') AS keyword FROM doc_words)
  WHERE keyword <> '' AND keyword NOT IN (SELECT keyword FROM rules) GROUP BY keyword),
review_words AS (SELECT review_id, string_split({words('review_description')}, ' ') AS w FROM predictions),
review_grams AS (
  SELECT review_id, array_to_string(list_slice(w, i, i + n - 1), ' ') AS keyword
  FROM (SELECT review_id, w, unnest(generate_series(1, len(w))) AS i FROM review_words), (VALUES (1), (2), (3)) AS lengths(n)
  WHERE i + n - 1 <= len(w)),
review_hits AS (
  SELECT review_id, pos, category, keyword FROM review_grams JOIN doc_tails USING (keyword)
  UNION ALL
  SELECT t.review_id, r.pos, r.category, r.keyword
  FROM (SELECT review_id, ' ' || array_to_string(w, ' ') || ' ' AS padded FROM review_words) t
  JOIN rules r ON contains(t.padded, ' ' || r.keyword || ' ')),
review_best AS (SELECT review_id, min_by(category, (-length(keyword), pos)) AS category FROM review_hits GROUP BY review_id)
SELECT p.review_id, coalesce(b.category, 'Other') AS bug_category
FROM predictions p LEFT JOIN review_best b USING (review_id)""",
    "severity_map": """
SELECT review_id, bug_category, coalesce(syslog_level, 'debug') AS syslog_level,
  coalesce(severity_code, 7) AS severity_code
FROM categorized LEFT JOIN severity ON category = bug_category""",
    "ticket_id": f"SELECT review_id, {ticket('review_description', 'review_date', 'app_version')} FROM categorized",
    "parse_dates": """
SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('day', ts)
  WHEN 'error' THEN NULL WHEN 'purchase' THEN NULL ELSE date_trunc('second', ts) END AS parsed FROM events""",
    "rating_impute": """
SELECT review_id, round(coalesce(r, (SELECT median(r) FROM (
    SELECT CASE WHEN developer_response IS NULL THEN rating END AS r FROM reviews))), 6) AS rating
FROM (SELECT review_id, CASE WHEN developer_response IS NULL THEN rating END AS r FROM reviews)""",
    "priority_order": f"SELECT bug_category, priority_level, cast({RANK} AS double) AS priority_rank FROM summaries",
    "tickets": "SELECT * FROM tickets",
    "sentiment_bucket": """
SELECT review_id, round(sentiment_score, 6) AS sentiment_score, sentiment_category FROM analysed""",
    "report_text": f"SELECT conv_id, turn, {report('response')} AS report FROM responses",
    "report_bullets": BULLETS,
    "report_sections": f"""
SELECT r.conv_id, r.turn, {SECTION_COLUMNS},
  {without("coalesce(max(CASE WHEN owner = 'priority_level' THEN notes END), '')", V.MARKDOWN_REMNANTS)} AS additional_notes
FROM responses r LEFT JOIN sections s ON s.conv_id = r.conv_id AND s.turn = r.turn GROUP BY r.conv_id, r.turn""",
    "singlish_flag": f"SELECT review_id, cast({ROMANISED} AS int) AS is_singlish FROM ({TAG})",
    "language_tag": f"SELECT review_id, detected_language FROM ({TAG})",
    "translation_route": f"""
SELECT review_id, is_singlish, CASE WHEN moved THEN 'translate' ELSE 'keep' END AS route,
  CASE WHEN detected_language = 'si' THEN 'si' WHEN is_singlish = 1 THEN 'auto' END AS src_lang,
  CASE WHEN NOT moved THEN body WHEN thumbs_up > 2 THEN 'translated for ' || user_name ELSE '' END AS translated_review
FROM (SELECT *, detected_language = 'si' OR is_singlish = 1 AS moved FROM (
  SELECT *, cast(detected_language = 'en' AND {ROMANISED} AS int) AS is_singlish FROM ({TAG})))""",
    "text_clean_lemmas_large": lemma_rows("documents", "doc_id", "text"),
    "sentiment_score_large": f"""
WITH docs AS (SELECT doc_id, {spaced('text')} AS c FROM documents)
SELECT doc_id, round(sentiment_score, 6) AS sentiment_score FROM ({score_rows('docs', 'doc_id', 'c')})""",
    "digest_delivered": "SELECT * FROM unsent",
    "digest_confirmed": """
SELECT trim(ticket_key) AS ticket_key, trim(ticket_id) AS ticket_id FROM sent WHERE trim(ticket_key) <> ''
UNION SELECT ticket_key, TicketID FROM unsent""",
    "sentiment_score": f"""
WITH docs AS (SELECT doc_id, {spaced('text')} AS c FROM documents)
SELECT doc_id, round(sentiment_score, 6) AS sentiment_score FROM ({score_rows('docs', 'doc_id', 'c')})""",
    "versions_sorted": f"""
SELECT v AS app_version, {padded_version('v')} AS version_key
FROM (SELECT DISTINCT trim(app_version) AS v FROM reviews) WHERE v <> ''""",
    "summary_context": f"""
SELECT bug_category, count(*) AS reviews, string_agg('Review ' || sample_rank || ' (Date: '
  || coalesce(cast(review_date AS varchar), 'nan') || ', Version: ' || coalesce(app_version, 'nan') || '): '
  || coalesce(review_description, 'nan'), chr(10) || chr(10) ORDER BY sample_rank) AS context
FROM ({SAMPLE}) WHERE sample_rank <= 25 GROUP BY bug_category""",
    "summary_prompt": f"""
SELECT bug_category, 'Summarize the following bug reports about ' || bug_category || ':' || chr(10) || chr(10)
  || string_agg(coalesce(review_description, ''), chr(10) || chr(10) ORDER BY sample_rank) AS prompt
FROM ({SAMPLE}) WHERE sample_rank <= 25 GROUP BY bug_category""",
    "text_features": """
SELECT review_id, CASE WHEN review_description = '' THEN 0.0::double ELSE 1.0::double END AS norm,
  CASE WHEN review_description = '' THEN 0 ELSE cast(len(string_split(review_description, ' ')) AS int) END AS tokens
FROM predictions""",
    "csv_round_trip": "SELECT review_description, bug_category, review_date, app_version FROM categorized",
    "table_round_trip": "SELECT review_id, rating, review_date FROM predictions",
    "file_before_table": "SELECT ticket_key, ticket_id, 0 AS replaced FROM sent",
    "required_columns": "SELECT rating, review_id FROM reviews",
    "parse_dates_strict": """
SELECT event_id, CASE event_type WHEN 'click' THEN date_trunc('day', ts) ELSE date_trunc('second', ts) END AS parsed
FROM events WHERE event_type <> 'error'""",
    "held_out_report": f"""
WITH shares AS (SELECT label, cast(count(*) - floor(count(*) * 0.75 + 0.5) AS bigint) AS held FROM taught GROUP BY label)
SELECT cast(label AS varchar) AS class, 1.0::double AS "precision", 1.0::double AS recall, 1.0::double AS f1, held AS support FROM shares
UNION ALL SELECT name, 1.0, 1.0, 1.0, cast(sum(held) AS bigint) FROM shares, (VALUES ('macro avg'), ('weighted avg'), ('accuracy')) n(name)
GROUP BY name""",
    "bug_classifier": f"""
SELECT c::double AS c, class_weight, solver, 1::bigint AS settings_chosen, 1.0::double AS best_f1
FROM (VALUES {', '.join(f'({c})' for c in V.GRID_C)}) g(c), (VALUES ('unit'), ('balanced')) w(class_weight),
  (VALUES ('liblinear'), ('lbfgs')) s(solver)""",
    "hashed_weights": f"""
WITH cleaned AS (SELECT review_id, {spaced('review_description')} AS t FROM phrase_reviews),
words AS (SELECT review_id, unnest(list_filter(string_split(t, ' '), lambda w: w <> '')) AS w FROM cleaned),
counts AS (SELECT review_id, w, count(*) AS tf FROM words GROUP BY review_id, w),
idf AS (SELECT w, ln((1 + (SELECT count(*) FROM cleaned)) / (1 + count(*))) AS idf FROM counts GROUP BY w),
norms AS (SELECT review_id, sqrt(sum(tf * idf * tf * idf)) AS norm FROM counts JOIN idf USING (w) GROUP BY review_id),
weighed AS (SELECT review_id, tf * idf / norm AS weight FROM counts JOIN idf USING (w) JOIN norms USING (review_id))
SELECT review_id, cast(count(weight) AS int) AS n_weights, round(coalesce(max(weight), 0), 6) AS greatest, round(coalesce(sum(weight), 0), 6) AS total
FROM cleaned LEFT JOIN weighed USING (review_id) GROUP BY review_id""",
    "latent_groups": """
SELECT 1.0::double AS norm, min(event_id) AS first_review, count(*) AS reviews, 1::bigint AS texts FROM grouped_texts GROUP BY cleaned_text""",
    "csv_blocks": r"""
SELECT review_id, nullif(regexp_replace(review_description, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g'), '') AS review_description, developer_response,
  review_date, app_version FROM reviews""",
    "self_training": "SELECT review_id, is_bug AS is_bug_report, is_bug AS likely FROM phrase_reviews",
    "bug_predictions": f"""
SELECT review_id, user_name, t AS review_description, review_date, app_version,
  coalesce(rating, (SELECT median(rating) FROM phrase_reviews)) AS rating, is_bug AS is_bug_report, is_bug AS likely,
  {" + ".join(f"cast(contains(t, '{k}') AS int)" for k in V.BUG_KEYWORDS)} AS bug_keyword_count,
  cast(length(t) AS int) AS review_length
FROM (SELECT *, {spaced('review_description')} AS t FROM phrase_reviews)""",
    "reclassified": """
SELECT review_description, coalesce(CASE WHEN given = 'Other' THEN known END, given) AS bug_category, review_date, app_version,
  CASE WHEN given = 'Other' THEN known END AS predicted_category FROM planted_bugs""",
    "other_clusters": """
SELECT min(event_id) AS first_review, count(*) AS reviews, 1::bigint AS texts FROM grouped_texts GROUP BY cleaned_text""",
    "topics": """
SELECT DISTINCT array_to_string(list_sort(string_split(t.cleaned_text, ' ')), ' ') AS words
FROM events e JOIN group_texts t ON t.g = e.user_id % 2""",
    "topic_vocabulary": """
SELECT term, count(*) AS tf, round(ln((1 + (SELECT count(*) FROM analysed)) / (1 + count(DISTINCT review_id))) + 1, 6) AS idf
FROM (SELECT review_id, unnest(string_split(cleaned_text, ' ')) AS term FROM analysed) WHERE length(term) >= 2
GROUP BY term ORDER BY tf DESC, term LIMIT 1000""",
    "bugs_only": "SELECT review_id, review_description FROM predictions WHERE is_bug_report = 1",
    "feedback_only": "SELECT review_id, review_description FROM predictions WHERE is_bug_report = 0",
    "tickets_by_level": f"SELECT * FROM tickets WHERE syslog_level IN ({listing(Q.LEVELS)})",
    "bugs_filtered": f"SELECT * FROM categorized WHERE {CHOSEN}",
    "bugs_date_range": f"""
SELECT review_id, bug_category, review_date FROM categorized
WHERE review_date BETWEEN timestamp '{Q.FIRST_DAY}' AND timestamp '{Q.LAST_MOMENT}'""",
    "high_confidence": """
SELECT review_id, round(bug_confidence, 6) AS bug_confidence FROM predictions WHERE bug_confidence > 0.8""",
    "other_split": """
SELECT review_id, bug_category, CASE WHEN lower(bug_category) <> 'other' THEN 'keyword' ELSE 'other' END AS part
FROM categorized""",
    "insights_by_severity": """
SELECT bug_category, s.syslog_level, s.severity_code FROM summaries JOIN severity s ON s.category = bug_category
WHERE s.syslog_level = 'err'""",
    "attended_report": """
SELECT a.ticket_key, a.TicketID, attended_at, "Timestamp", syslog_level, cast(severity_code AS double) AS severity_code, bug_category,
  app_version, review_date, review_description FROM attended a LEFT JOIN tickets t ON t.ticket_key = a.ticket_key""",
    "new_tickets": "SELECT * FROM unsent",
    "mark_attended": f"""
SELECT ticket_key, TicketID, attended_at FROM attended
UNION ALL SELECT DISTINCT ticket_key, TicketID, timestamp '{Q.MARKED_AT}' FROM tickets
WHERE syslog_level IN ('crit', 'info') AND ticket_key NOT IN (SELECT ticket_key FROM attended)""",
    "category_insights": f"""
SELECT n.bug_category, {report('summary')} AS summary, {report('key_findings')} AS key_findings,
  {report('suggested_actions')} AS suggested_actions, priority_level, s.syslog_level, s.severity_code, b.bug_count
FROM summaries n JOIN severity s ON s.category = n.bug_category JOIN (
  SELECT bug_category, count(*) AS bug_count FROM categorized WHERE {IN_SELECTION} GROUP BY bug_category) b
ON b.bug_category = n.bug_category""",
    "digest_mode": """
SELECT history, count(DISTINCT id) AS sent_ids, cast(bool_and(regexp_full_match(substr(id, 5), '[0-9]+')) AS int) AS first_run
FROM (SELECT 'legacy' AS history, trim(ticket_id) AS id FROM legacy
      UNION ALL SELECT 'sent', trim(ticket_id) FROM sent) WHERE id <> '' GROUP BY history""",
    "digest_first_run": f"""
SELECT {DETAILS} FROM tickets
ORDER BY review_date DESC NULLS LAST, TicketID, ticket_key LIMIT 10""",
    "sent_state_next": """
SELECT trim(ticket_key) AS ticket_key, trim(ticket_id) AS ticket_id FROM sent WHERE trim(ticket_key) <> ''
UNION SELECT ticket_key, TicketID FROM unsent""",
    "upsert_latest": UPSERT.format(batch="developer_response IS NULL, "),
    "bugs_per_category": BY_CATEGORY,
    "category_share": f"""
SELECT bug_category, bug_count, round(bug_count / (SELECT count(*) FROM categorized), 6) AS share FROM ({BY_CATEGORY})""",
    "version_category_grid": """
SELECT app_version, bug_category, coalesce(n, 0) AS bug_count
FROM (SELECT DISTINCT app_version FROM categorized WHERE app_version IS NOT NULL)
CROSS JOIN (SELECT DISTINCT bug_category FROM categorized WHERE app_version IS NOT NULL)
LEFT JOIN (SELECT app_version, bug_category, count(*) AS n FROM categorized GROUP BY ALL) USING (app_version, bug_category)""",
    "day_category_grid": """
SELECT day_of_month, bug_category, CASE WHEN n IS NULL AND day_of_month NOT IN
    (SELECT day(review_date) FROM categorized WHERE review_date IS NOT NULL) THEN 0.0 ELSE cast(n AS double) END AS bug_count
FROM (SELECT cast(range AS int) AS day_of_month FROM range(1, 32))
CROSS JOIN (SELECT DISTINCT bug_category FROM categorized WHERE review_date IS NOT NULL)
LEFT JOIN (SELECT cast(day(review_date) AS int) AS day_of_month, bug_category, count(*) AS n FROM categorized GROUP BY ALL)
  USING (day_of_month, bug_category)""",
    "weekly_counts": WEEKLY,
    "weekly_sentiment": f"""
SELECT cast(cast({WEEK_END} AS date) AS varchar) AS week_end, app_version, bug_category, round(avg(sentiment_score), 6) AS mean_sentiment
FROM categorized JOIN bug_score USING (review_id)
WHERE review_date IS NOT NULL AND app_version IS NOT NULL GROUP BY ALL""",
    "monthly_sentiment": """
SELECT cast(last_day(m) AS varchar) AS month_end, round(avg(a.sentiment_score), 6) AS mean_sentiment, count(a.review_id) AS review_count
FROM (SELECT unnest(generate_series(date_trunc('month', min(review_date)), max(review_date), INTERVAL 1 MONTH)) AS m
      FROM analysed)
LEFT JOIN analysed a ON date_trunc('month', a.review_date) = m GROUP BY m""",
    "version_sentiment": """
SELECT app_version, round(avg(sentiment_score), 6) AS sentiment_mean, round(avg(rating), 6) AS rating_mean,
  count(review_description) AS review_count FROM analysed WHERE app_version IS NOT NULL GROUP BY app_version""",
    "sentiment_summary": """
SELECT count(*) AS total_reviews, round(avg(sentiment_score), 6) AS average_sentiment,
  round(avg(rating), 6) AS average_rating FROM analysed""",
    "sentiment_distribution": """
SELECT b AS sentiment_category, count(a.review_id) AS review_count
FROM (VALUES ('Negative'), ('Neutral'), ('Positive')) x(b) LEFT JOIN analysed a ON a.sentiment_category = b GROUP BY b""",
    "rating_distribution": """
SELECT rating, count(*) AS review_count FROM predictions WHERE is_bug_report = 0 AND rating IS NOT NULL GROUP BY rating""",
    "developer_rollup": "SELECT * FROM rollup",
    "kpis": f"""
SELECT (SELECT count(*) FROM categorized WHERE {CHOSEN}) AS total_bugs, cast({len(Q.CATEGORIES)} AS bigint) AS categories,
  count(DISTINCT trim(app_version)) AS versions,
  max_by(trim(app_version), {padded_version('trim(app_version)')}) AS latest_version FROM categorized""",
    "bug_rate": """
SELECT count(*) AS total_reviews, cast(sum(is_bug_report) AS bigint) AS bug_count,
  round(100.0 * sum(is_bug_report) / count(*), 6)::double AS bug_percentage,
  count(*) FILTER (bug_confidence > 0.8) AS high_confidence FROM predictions""",
    "priority_counts": "SELECT priority_level, count(*) AS categories FROM summaries GROUP BY priority_level",
    "date_bounds": "SELECT min(review_date) AS min_date, max(review_date) AS max_date FROM categorized",
    "dimension_values": "SELECT DISTINCT bug_category AS value FROM categorized",
    "term_frequencies": """
SELECT term, count(*) AS term_count FROM (SELECT unnest(string_split(cleaned_text, ' ')) AS term FROM analysed)
WHERE term <> '' GROUP BY term ORDER BY term_count DESC, term LIMIT 100""",
    "category_sample": f"SELECT bug_category, sample_rank, review_id FROM ({SAMPLE}) WHERE sample_rank <= 25",
    "prioritized_bugs": "SELECT p.review_id, user_name, review_description, review_date, app_version, rating, "
        "is_bug_report, round(bug_confidence, 6) AS bug_confidence, " + " + ".join(
            f"cast(contains(review_description, '{k}') AS int)" for k in V.BUG_KEYWORDS
        ) + " AS bug_keyword_count, cast(length(review_description) AS int) AS review_length "
        "FROM predictions p WHERE is_bug_report = 1",
    "stratified_split": """
SELECT doc_id, toxic, cast(row_number() OVER (PARTITION BY toxic ORDER BY sha1('42:' || doc_id), doc_id)
  <= floor(count(*) OVER (PARTITION BY toxic) * 0.75 + 0.5) AS int) AS is_train FROM labels""",
    "stratified_folds": """
SELECT doc_id, toxic, cast((row_number() OVER (PARTITION BY toxic ORDER BY sha1('42:' || doc_id), doc_id) - 1) % 5 AS int) AS fold
FROM labels""",
    "class_weights": """
SELECT doc_id, 1.0::double AS unit, round((SELECT count(*) FROM labels)
  / ((SELECT count(DISTINCT toxic) FROM labels) * count(*) OVER (PARTITION BY toxic)), 6) AS balanced FROM labels""",
    "pseudo_labels": """
SELECT review_id, CASE WHEN bug_confidence > 0.95 THEN 1 ELSE 0 END AS label FROM predictions
WHERE bug_confidence > 0.95 OR bug_confidence < 0.05""",
    "classification_report": """
WITH g AS (SELECT toxic AS y, 1 - quality AS p FROM labels),
c AS (SELECT k, (SELECT count(*) FROM g WHERE y = k) AS support, (SELECT count(*) FROM g WHERE p = k) AS claimed,
        (SELECT count(*) FROM g WHERE y = k AND p = k) AS hits FROM (SELECT y AS k FROM g UNION SELECT p FROM g)),
m AS (SELECT *, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS pr, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS re,
        2 * hits / (claimed + support) AS f FROM c)
SELECT cast(k AS varchar) AS class, round(pr, 6) AS "precision", round(re, 6) AS recall, round(f, 6) AS f1, support FROM m
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f), 6), cast(sum(support) AS bigint) FROM m
UNION ALL SELECT 'weighted avg', round(sum(pr * support) / sum(support), 6), round(sum(re * support) / sum(support), 6),
  round(sum(f * support) / sum(support), 6), cast(sum(support) AS bigint) FROM m
UNION ALL SELECT 'accuracy', round(sum(hits) / sum(support), 6), round(sum(hits) / sum(support), 6),
  round(sum(hits) / sum(support), 6), cast(sum(support) AS bigint) FROM m""",
    "key_phrases": """
SELECT term, round(sum(w / norm), 4) AS importance FROM weighted GROUP BY term
ORDER BY round(sum(w / norm), 9) DESC, term LIMIT 20""",
    "stream_upsert": UPSERT.format(batch=""),
    "stream_new_tickets": "SELECT DISTINCT * FROM unsent",
    "stream_weekly_counts": WEEKLY,
}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, sql in SELECTS.items():
        built = statement(sql)
        if sql.lstrip().startswith("WITH ") and built != sql:
            # a statement with its own heads joins the shared ones
            shared = built[: -len(sql)].rstrip()
            built = shared + ", " + sql.lstrip()[len("WITH "):]
        out[name] = built.strip()
    return out
