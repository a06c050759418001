"""The queries of this subpackage that SQL can express, in SQL."""

from __future__ import annotations

from ticketloom.llm.chat import INSTRUCT
from ticketloom.llm.hard_negatives import HIGH, LOW, NEGATIVES, POSITIVES
from ticketloom.llm.importance import BUCKETS, LEAST_WORDS, PERCENT
from ticketloom.llm.queries import ALLOW_LISTS, LIST_EPOCH
from ticketloom.llm.sharding import PRIME, round_keys
from ticketloom.llm.substrings import WINDOW

SUBSTRINGS = f"""
WITH split AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS held
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM split)),
firsts AS (SELECT held, min(doc_id) AS first FROM windows GROUP BY held),
gone AS (
  SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN firsts USING (held), range(0, {WINDOW}) r(k) WHERE first < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM split),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n
  FROM words w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.pos = w.pos) GROUP BY doc_id)
SELECT s.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id"""

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_DAY = lambda n: f"TIMESTAMP '{LIST_EPOCH}' + INTERVAL {n} DAY"
URLS = f"""
WITH captures AS (
  SELECT page_id, url, TIMESTAMP '{LIST_EPOCH}' + to_minutes(cast(page_id % 25920 * 10 AS int)) AS at,
    lower(rtrim(regexp_extract(url, '{_SCHEME}(?:[^/?#@]*@)?([^/?#:@]*)', 1), '.')) AS host,
    regexp_extract(url, '{_SCHEME}[^/?#]*(/[^?#]*)', 1) AS path FROM pages),
hosts AS (SELECT host, min(page_id) AS first FROM captures WHERE host <> '' GROUP BY host),
entries AS (
  SELECT 'spam' AS list, host AS pattern, a AS action, t AS at FROM hosts,
    (VALUES ('add', {_DAY(10)}), ('remove', {_DAY(100)}), ('add', {_DAY(120)})) v(a, t) WHERE first % 3 = 0
  UNION ALL SELECT 'adult', host, 'add', {_DAY(30)} FROM hosts WHERE first % 3 = 1
  UNION ALL SELECT 'adult', host || '/de/', a, t FROM hosts, (VALUES ('add', {_DAY(0)}), ('remove', {_DAY(90)})) v(a, t)
  UNION ALL SELECT 'partners', host, 'add', {_DAY(60)} FROM hosts WHERE first % 5 = 0),
valid AS (
  SELECT * FROM (SELECT *, lead("at") OVER (PARTITION BY list, pattern ORDER BY "at", action) AS until FROM entries)
  WHERE action = 'add'),
held AS (
  SELECT c.page_id, v.list, v.pattern FROM captures c JOIN valid v
    ON (c.host = v.pattern OR ends_with(c.host, '.' || v.pattern)
        OR (contains(v.pattern, '/') AND starts_with(c.host || c.path, v.pattern)))
    AND c.at >= v.at AND (v.until IS NULL OR c.at < v.until)),
found AS (
  SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
    max(CASE WHEN list NOT IN ('{"', '".join(ALLOW_LISTS)}') THEN {{'n': length(pattern), 'p': pattern}} END) AS block,
    max(CASE WHEN list IN ('{"', '".join(ALLOW_LISTS)}') THEN length(pattern) END) AS allow FROM held GROUP BY page_id)
SELECT c.page_id, coalesce(lists, '') AS lists, coalesce(block.p, '') AS pattern,
  coalesce(block.p IS NOT NULL AND (allow IS NULL OR allow <= block.n), false) AS blocked
FROM captures c LEFT JOIN found f ON f.page_id = c.page_id"""


def _escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    marks = {m.strip() for pair in [*INSTRUCT.roles.values(), INSTRUCT.other] for m in pair}
    for mark in sorted(marks, key=lambda m: (-len(m), m)):
        out = f"replace({out}, '{mark}', '{mark[0]}\\{mark[1:]}')"
    return out


_MARKS = " ".join(f"WHEN '{role}' THEN {len(a) + len(b)}" for role, (a, b) in INSTRUCT.roles.items())
_FOLLOWS = ", ".join(f"('{a}', '{b}')" for a, following in INSTRUCT.follows.items() for b in sorted(following))
CHAT = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
ordered AS (
  SELECT *, lag(role, 1, '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM turns)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS bigint) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(length({_escaped('text')}) + CASE role {_MARKS} END) AS bigint) AS formatted_chars,
  count(*) FILTER ((before, role) NOT IN ({_FOLLOWS})) AS n_illegal_turns
FROM ordered GROUP BY conv_id"""


def _crc_table() -> list[int]:
    """What four bits do to a checksum: four steps of the polynomial for each value."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


def _network(source: str, x: str) -> str:
    """One pass over ``source``'s column ``x``, as ``place``."""
    sql = f"SELECT *, {x} // base AS l, {x} % base AS r FROM {source}"
    for a, b in round_keys(20_240_229):
        mixed = f"SELECT * EXCLUDE (l, r), l AS l0, r AS r0, (r % {PRIME} * {a} + {b}) % {PRIME} AS m FROM ({sql})"
        sql = f"SELECT * EXCLUDE (l0, r0, m), r0 AS l, (l0 + (m * m + {a}) % {PRIME}) % base AS r FROM ({mixed})"
    return f"SELECT * EXCLUDE (l, r), l * base + r AS place FROM ({sql})"


SHARDS = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, cast(octet_length(encode(coalesce(text, ''))) + 1 AS bigint) AS size,
    list_reduce(list_prepend(4294967295, list_transform(range(1, len(d) + 1),
      lambda i: cast(strpos('0123456789ABCDEF', d[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS bigint))),
      lambda crc, nibble: xor(crc >> 4, {_crc_table()}[(xor(crc, nibble) & 15) + 1])) AS crc
  FROM (SELECT *, CASE WHEN coalesce(text, '') = '' THEN [] ELSE string_split(hex(encode(text)), '') END AS d FROM documents)),
numbered AS (
  SELECT doc_id, size, cast(xor(crc, 4294967295) AS bigint) AS text_crc32, count(*) OVER () AS total,
    cast(ceil(sqrt(count(*) OVER ())) AS bigint) AS base,
    row_number() OVER (ORDER BY doc_id NULLS FIRST, size, crc) - 1 AS n FROM sized),
walk AS (
  {_network('numbered', 'n')}
  UNION ALL {_network('(SELECT * EXCLUDE (place), place AS was FROM walk WHERE place >= total)', 'was').replace('SELECT * EXCLUDE (l, r), l', 'SELECT * EXCLUDE (l, r, was), l', 1)})
SELECT doc_id, size, text_crc32, 'rows' AS law, cast(place % 8 AS int) AS shard, place // 8 AS slot, cast(NULL AS double) AS grown_shard
FROM walk WHERE place < total"""


def _words_crc(word: str) -> str:
    """The checksum of a text, four bits at a time, in each byte the low ones first."""
    digits = f"string_split(hex(encode({word})), '')"
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(1, len({digits}) + 1),
      lambda i: cast(strpos('0123456789ABCDEF', ({digits})[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS bigint))),
      lambda crc, nibble: xor(crc >> 4, {_crc_table()}[(xor(crc, nibble) & 15) + 1])), 4294967295)"""


_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_FOUND = f"regexp_extract_all(translate(coalesce(text, ''), '{_LETTERS}', '{_LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
IMPORTANCE = f"""
WITH held AS (SELECT doc_id, {_FOUND} AS ws FROM documents),
words AS (SELECT doc_id, unnest(ws) AS word FROM held),
aimed AS (SELECT unnest(ws) AS word FROM (SELECT {_FOUND} AS ws FROM benchmark)),
buckets AS (
  SELECT word, {_words_crc("word")} % {BUCKETS} AS bucket
  FROM (SELECT word FROM words UNION SELECT word FROM aimed)),
own AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (word) GROUP BY bucket),
aim AS (SELECT bucket, count(*) AS t FROM aimed JOIN buckets USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, cast(floor(1000 * ln(
    (coalesce(t, 0) + 1)::double * ((SELECT coalesce(sum(s), 0) FROM own) + {BUCKETS})::double
    / ((s + 1)::double * ((SELECT coalesce(sum(t), 0) FROM aim) + {BUCKETS})::double))) AS bigint) AS gain
  FROM own LEFT JOIN aim USING (bucket)),
sums AS (SELECT doc_id, sum(gain) AS total FROM words JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT h.doc_id, cast(len(ws) AS bigint) AS n_features,
    cast(CASE WHEN len(ws) = 0 THEN 0 ELSE (total - ((total % len(ws)) + len(ws)) % len(ws)) // len(ws) END AS bigint) AS weight,
    cast(floor(-1000 * ln(-ln((('0x' || sha256('2024:' || h.doc_id)[1:8])::bigint + 0.5::double) / 4294967296::double))) AS bigint) AS noise
  FROM held h LEFT JOIN sums USING (doc_id)),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= {LEAST_WORDS})
SELECT s.doc_id, n_features, weight, weight + noise AS score, cast(CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS double) AS rank
FROM scored s LEFT JOIN drawn d USING (doc_id)"""

NEGATIVES_OF = f"""
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, cast(list_inner_product(a.v, b.v) AS bigint) AS score
  FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {POSITIVES}),
found AS (
  SELECT p.*, s.id AS negative_id, s.score AS negative_score,
    cast(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.id) AS int) AS rank
  FROM positives p JOIN scored s USING (anchor_id)
  WHERE NOT s.same AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= {NEGATIVES}"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": SUBSTRINGS,
        "op3_url_filters": URLS,
        "op7_chat_format": CHAT,
        "op9_shards": SHARDS,
        "op11_importance": IMPORTANCE,
        "op13_hard_negatives": NEGATIVES_OF,
    }
