"""DuckDB counterparts of the queries that SQL can express on whole tables."""

from __future__ import annotations

from foldlog.llm import licences
from foldlog.llm.common import LOWER, UPPER

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: str) -> str:
    return f"[x FOR x IN regexp_split_to_array(translate({text}, '{UPPER}', '{LOWER}'), '{_GAP}') IF x <> '']"


CHAT = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id,
  count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(9 + length(role || text) + len(regexp_extract_all(role || text, '[\\<>\[\]]')))::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS n_tokens_attached
FROM rows GROUP BY conv_id
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
sh AS (SELECT rid, array_to_string(w[k:k + least(5, len(w)) - 1], ' ') AS s, count(*) AS m FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 5, 0) + 2)) AS k FROM d WHERE len(w) > 0) GROUP BY ALL),
n AS (SELECT rid, sum(m) AS n FROM sh GROUP BY rid),
common AS (SELECT a.rid AS x, b.rid AS y, sum(least(a.m, b.m)) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.rid < b.rid GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.rid = x JOIN n q ON q.rid = y WHERE c >= 0.8 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT rid, rid FROM d UNION SELECT reach.x, sides.y FROM reach JOIN sides ON reach.y = sides.x),
class AS (SELECT x AS rid, min(d.doc_id) AS class_id FROM reach JOIN d ON d.rid = reach.y GROUP BY x)
SELECT doc_id, class_id, doc_id = class_id AS representative FROM d JOIN class USING (rid)
"""


def licence_scan() -> str:
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in licences.PHRASES)
    templates = ", ".join(f"('{label}', [{', '.join(repr(w) for w in licences.template_words(t))}], {licences.window_words(t)})" for label, t in licences.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w FROM documents),
phrases(phrase, label, n) AS (VALUES {phrases}), templates(label, words, size) AS (VALUES {templates}),
spots AS (SELECT rid, k - 1 AS place, label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS k FROM d) p JOIN phrases ON array_to_string(p.w[k:k + n - 1], ' ') = phrase),
base AS (SELECT rid, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels FROM spots GROUP BY rid),
blocks AS (
  SELECT rid, 0 AS of, list_distinct({_words("line")}) AS have FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
  UNION ALL SELECT rid, size, list_distinct(w[k:k + size - 1]) FROM (SELECT rid, w, size, unnest(range(1, greatest(1, len(w) - size // 2 + 1) + 1, size // 2)) AS k FROM d, (SELECT DISTINCT size FROM templates))),
found AS (SELECT rid, label, max(len(list_intersect(have, words)) / len(words)) AS share FROM blocks, templates WHERE of IN (0, size) AND len(list_intersect(have, words)) >= {licences.CONTAINMENT} * len(words) - 1e-9 GROUP BY ALL),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(share) AS share FROM found GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ',') AS labels,
  (CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END)::DOUBLE AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""


DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {_words("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS k FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT rid, n, k, array_to_string(w[k:k + n - 1], ' ') AS s FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT rid, k, n, item FROM dw JOIN bw USING (n, s)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(k, k + n)) AS p FROM hit) GROUP BY rid),
ids AS (SELECT rid, list_sort(list(DISTINCT item)) AS l FROM hit WHERE item IS NOT NULL GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(l), 0)::BIGINT AS n_items,
  sha256(coalesce(array_to_string(l, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN places USING (rid) LEFT JOIN ids USING (rid)
"""
