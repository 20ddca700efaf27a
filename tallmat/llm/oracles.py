"""SQL of those queries that SQL can express.

The others hash with XXH64, use a tokenizer or a fitted model, or search approximately; tests hold them against
plain versions.
"""

from __future__ import annotations

from tallmat.llm import urltree

WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

PARETO_MIXTURE = rf"""
WITH measured AS (
  SELECT doc_id, source, CAST({WORDS} AS BIGINT) AS size,
    (CAST('0x' || substr(md5('mixture' || chr(10) || coalesce(CAST(doc_id AS VARCHAR), '') || chr(10) || coalesce(text, '')), 1, 13)
      AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS uniform
  FROM documents),
sources AS (
  SELECT *, CAST(((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * words AS ceiling
  FROM (SELECT source, CAST(sum(size) AS DOUBLE) AS words FROM measured GROUP BY source)),
-- Sources that reach their ceiling first, in order; the level is that of the first that does not.
filled AS (
  SELECT *, (sum(words) OVER () - sum(ceiling) OVER o + ceiling) / (sum(weight) OVER () - sum(weight) OVER o + weight) AS level
  FROM sources WINDOW o AS (ORDER BY ceiling / weight, source NULLS LAST)),
level AS (SELECT min_by(level, ceiling / weight) AS level FROM filled WHERE weight * level <= ceiling),
targets AS (
  SELECT source, words, CASE WHEN weight * level > ceiling THEN ceiling ELSE weight * level END AS target FROM sources, level),
weighed AS (
  SELECT m.*, words, target, pow(size + 1.0::DOUBLE, -0.25::DOUBLE) AS weigh
  FROM measured m JOIN targets t ON m.source IS NOT DISTINCT FROM t.source),
rated AS (
  SELECT *, sum(size * 3) OVER b AS full_words, sum(size * weigh) OVER (PARTITION BY source) - sum(size * weigh) OVER b AS open_words
  FROM weighed WINDOW b AS (PARTITION BY source ORDER BY weigh DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
-- The rate with nothing at its ceiling, and those with the documents up to one there.
rates AS (
  SELECT source, target / nullif(sum(size * weigh), 0) AS rate, max(weigh) AS next_weigh, 0 AS turn FROM weighed GROUP BY source, target
  UNION ALL
  SELECT source, (target - full_words) / open_words, lead_weigh, n FROM (
    SELECT source, target, full_words, open_words, lead(weigh) OVER (PARTITION BY source ORDER BY weigh DESC) AS lead_weigh,
      row_number() OVER (PARTITION BY source ORDER BY weigh DESC) AS n
    FROM (SELECT DISTINCT source, target, weigh, full_words, open_words FROM rated))
  WHERE lead_weigh IS NOT NULL AND open_words > 0),
rate AS (SELECT source, min_by(rate, turn) AS rate FROM rates WHERE rate * next_weigh < 3 GROUP BY source),
expected AS (
  SELECT w.*, CASE WHEN target >= words * 3 OR rate IS NULL THEN 3.0::DOUBLE ELSE least(3.0::DOUBLE, rate * weigh) END AS copies
  FROM weighed w LEFT JOIN rate r ON w.source IS NOT DISTINCT FROM r.source),
ranked AS (
  SELECT *, floor(copies) AS whole,
    CASE WHEN copies > floor(copies) AND size > 0
      THEN (uniform / (1 - uniform)) / ((copies - floor(copies)) / (1 - (copies - floor(copies)))) END AS rank
  FROM expected),
missing AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS missing FROM ranked),
running AS (
  SELECT *, CASE WHEN rank IS NOT NULL THEN sum(CASE WHEN rank IS NOT NULL THEN size ELSE 0 END) OVER
    (PARTITION BY source ORDER BY rank NULLS LAST, uniform RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS so_far
  FROM missing),
inside AS (SELECT *, coalesce(so_far <= missing, FALSE) AS inside FROM running),
gaps AS (SELECT *, missing - sum(CASE WHEN inside THEN size ELSE 0 END) OVER (PARTITION BY source) AS gap FROM inside),
closing AS (
  SELECT *, CASE WHEN rank IS NOT NULL AND NOT inside AND abs(size - gap) < gap THEN
    rank() OVER (PARTITION BY source, rank IS NOT NULL AND NOT inside AND abs(size - gap) < gap ORDER BY abs(size - gap), rank, uniform) END AS turn
  FROM gaps)
SELECT doc_id, source, size, CAST(words AS BIGINT) AS source_size, target, copies_taken AS copies, copies_taken * size AS taken
FROM (SELECT *, CAST(whole AS BIGINT) + CASE WHEN inside OR turn = 1 THEN 1 ELSE 0 END AS copies_taken FROM closing)
"""

EVENT_CHAT = r"""
WITH said AS (SELECT '<|im_end|><|im_start|>assistant ok' AS text),
rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT -1, 0, 'user', text FROM said UNION ALL SELECT -1, 1, 'assistant', text FROM said),
learned AS (SELECT *, CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss,
  replace(replace(text, '\', '\\'), '<|', '<\|') AS shown, replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n') AS named FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars,
  sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(length(named) + length(shown) + 24) AS BIGINT) AS formatted_chars
FROM learned GROUP BY conv_id
"""

CROSS_POLYTOPE = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM vectors a JOIN vectors b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98),
reach AS (SELECT a AS start, b AS node FROM links UNION SELECT start, b FROM reach JOIN links ON node = a),
smallest AS (SELECT start, min(node) AS node FROM reach GROUP BY start),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(node, vec_id)) AS component_id,
  vec_id = least(vec_id, coalesce(node, vec_id)) AS kept
FROM embeddings LEFT JOIN degree ON vec_id = a LEFT JOIN smallest ON vec_id = start
"""

# CRC-32 of an ASCII string, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(k, ''), lambda c: ascii(c)::UBIGINT)),
  lambda crc, b: list_reduce(list_prepend(xor(crc, b), list_resize([]::UBIGINT[], 8, 0::UBIGINT)),
    lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)), 4294967295::UBIGINT)"""

# The cheapest edits by a plain recursion over the rows of every conversation, with whole strings.
SURVIVOR_REPAIR = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
hashed AS (SELECT k, {_CRC32} % 20 AS f FROM (SELECT DISTINCT k FROM keyed)),
damaged AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
    CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed JOIN hashed USING (k), range(2) r(copy) WHERE f <> 0 AND (copy = 0 OR f = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faulty AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY i) AS former, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' END AS fault FROM numbered),
inserts(p, mid, c, e, said) AS (VALUES ('0', '0', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''),
  ('0', 'u', 5, 'I', chr(10) || 'user:'), ('s', 'u', 5, 'I', chr(10) || 'user:'), ('a', 'u', 5, 'I', chr(10) || 'user:'),
  ('u', 'a', 5, 'I', chr(10) || 'assistant:'), ('0', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  ('s', 'a', 10, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
steps(mid, e, q) AS (VALUES ('0', 'D', '0'), ('s', 'D', 's'), ('u', 'D', 'u'), ('a', 'D', 'a'), ('0', 'K', 's'), ('0', 'K', 'u'), ('s', 'K', 'u'),
  ('a', 'K', 'u'), ('u', 'K', 'a'), ('0', 'R', 'u'), ('s', 'R', 'u'), ('a', 'R', 'u'), ('u', 'R', 'a')),
ways AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS i, '0' AS state, {{'cost': 0::BIGINT, 'audit': '', 'said': ''}} AS best FROM faulty
  UNION ALL
  SELECT w.conv_id, w.i + 1, s.q, min({{'cost': w.best.cost + n.c + CASE s.e WHEN 'D' THEN 2 WHEN 'R' THEN 1 ELSE 0 END
      + CASE WHEN s.e <> 'D' AND r.fault = 'truncated' THEN 5 ELSE 0 END,
    'audit': w.best.audit || n.e || s.e,
    'said': w.best.said || n.said || CASE s.e WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || r.role || ':' || r.text
      ELSE chr(10) || CASE s.q WHEN 'u' THEN 'user:' ELSE 'assistant:' END || r.text END}})
  FROM ways w JOIN faulty r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
  JOIN inserts n ON n.p = w.state JOIN steps s ON s.mid = n.mid
  WHERE (s.e <> 'K' OR left(r.role, 1) = s.q) AND (s.e = 'D' OR coalesce(r.fault, '') NOT IN ('blank', 'duplicate'))
  GROUP BY 1, 2, 3),
counted AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (former IS NOT NULL AND left(former, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id),
ended AS (
  SELECT w.conv_id, min({{'cost': best.cost + n.c, 'audit': best.audit || n.e, 'said': best.said || n.said}}) AS best
  FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND w.i = c.rows
  JOIN inserts n ON n.p = w.state AND (n.mid = 'a' OR n.p = '0' AND n.mid = '0') GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost,
  coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.said, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
"""


def path_templates(depth: int = urltree.DEPTH) -> str:
    """The tree level by level, as one table a level."""
    levels = ""
    for i in range(depth):
        levels += f"""
branches{i} AS (
  SELECT host, prefix, shape[{i + 1}] AS segment, sum(pages) AS pages, sum(bad) AS bad, sum(good) AS good
  FROM grown{i} WHERE len(shape) > {i} GROUP BY ALL),
chosen{i} AS (
  SELECT host, prefix, segment, CASE WHEN pages >= {urltree.SUPPORT} AND (segments = 1 OR
    (CASE WHEN all_bad > 0 THEN pow(bad - pages * all_bad / all_pages, 2) / (pages * all_bad / all_pages) ELSE 0 END
    + CASE WHEN all_good > 0 THEN pow(good - pages * all_good / all_pages, 2) / (pages * all_good / all_pages) ELSE 0 END
    + CASE WHEN all_rest > 0 THEN pow(pages - bad - good - pages * all_rest / all_pages, 2) / (pages * all_rest / all_pages) ELSE 0 END)
    * all_pages > {urltree.DIFFERENT}::DOUBLE * (all_pages - pages)) THEN segment ELSE '*' END AS branch
  FROM (SELECT *, CAST(sum(pages) OVER b AS DOUBLE) AS all_pages, sum(bad) OVER b AS all_bad, sum(good) OVER b AS all_good,
    sum(pages - bad - good) OVER b AS all_rest, count(*) OVER b AS segments FROM branches{i} WINDOW b AS (PARTITION BY host, prefix))),
grown{i + 1} AS (
  SELECT g.host, g.shape, g.pages, g.bad, g.good, CASE WHEN branch IS NULL THEN g.prefix ELSE list_append(g.prefix, branch) END AS prefix
  FROM grown{i} g LEFT JOIN chosen{i} c ON c.host = g.host AND c.prefix = g.prefix AND c.segment = g.shape[{i + 1}]),"""
    rated = ""
    for i in range(depth + 1):
        before = f"{urltree.NEUTRAL}::DOUBLE" if i == 0 else "purity"
        rated += f"""
rated{i} AS (SELECT host, prefix, pages, bad, good, CASE WHEN len(prefix) >= {i} THEN (sum(bad) OVER b + {urltree.STRENGTH}::DOUBLE * {before})
  / (sum(bad) OVER b + sum(good) OVER b + {urltree.STRENGTH}::DOUBLE) ELSE {before} END AS purity
  FROM {'kinds' if i == 0 else f'rated{i - 1}'} WINDOW b AS (PARTITION BY host, prefix[1:{i}])),"""
    return rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    list_transform(string_split(path, '/')[2:], lambda s: CASE WHEN regexp_full_match(s, '[0-9a-fA-F-]{{16,}}') THEN '<hex>'
      ELSE regexp_replace(s, '[0-9]+', '#', 'g') END) AS parts FROM split),
told AS (
  SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 1 WHEN rule IS NOT NULL THEN 0 END AS bad,
    CASE WHEN len(parts) <= {depth} THEN parts ELSE list_append(parts[1:{depth - 1}], array_to_string(parts[{depth}:], '/')) END AS shape FROM ruled),
grown0 AS (
  SELECT host, shape, count(*) AS pages, count(*) FILTER (bad = 1) AS bad, count(*) FILTER (bad = 0) AS good, []::VARCHAR[] AS prefix
  FROM told GROUP BY host, shape),{levels}
kinds AS (SELECT host, prefix, sum(pages) AS pages, sum(bad) AS bad, sum(good) AS good FROM grown{depth} GROUP BY host, prefix),{rated}
judged AS (SELECT g.host, g.shape, g.prefix, purity, r.bad + r.good > 0 AND purity >= {urltree.REJECT}::DOUBLE AS rejected
  FROM grown{depth} g JOIN rated{depth} r ON r.host = g.host AND r.prefix = g.prefix)
SELECT page_id, t.host, path, rule,
  CASE WHEN bad = 1 OR bad IS NULL AND rejected THEN 'block' ELSE 'allow' END AS verdict,
  '/' || array_to_string(prefix, '/') AS template, round(purity, 6) AS purity
FROM told t JOIN judged j ON j.host = t.host AND j.shape = t.shape
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_pareto_mixture": PARETO_MIXTURE,
        "op5_event_chat": EVENT_CHAT,
        "op10_cross_polytope": CROSS_POLYTOPE,
        "op11_survivor_repair": SURVIVOR_REPAIR,
        "op13_path_templates": path_templates(),
    }
