"""DuckDB SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _either(host: str, path: str, rule: str) -> str:
    wanted, _, start = rule.partition("/")
    return f"(({host} = '{wanted}' OR ends_with({host}, '.{wanted}')) AND starts_with({path}, '/{start}'))"


_RULES = {"www.example.com/en/": "allow", "example.com/en/": "block", "net/es/": "block", "net/fr/": "block", "com/": "allow"}

OP3 = f"""
WITH u AS (
  SELECT page_id, {LOWER.format("coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_either('host', 'path', r)} THEN '{r}'" for r in _RULES)} END AS rule,
  CASE {" ".join(f"WHEN {_either('host', 'path', r)} THEN '{v}'" for r, v in _RULES.items())} ELSE 'allow' END AS verdict
FROM u
"""

OP2 = r"""
WITH RECURSIVE rows AS (
  SELECT *, least(64, greatest(1, coalesce(floor(8 * length(text) / nullif(5 * size, 0)), 8)))::BIGINT AS weight_class, length(bin(size)) AS size_class
  FROM (SELECT row_number() OVER () AS r, doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    (('0x' || md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS u
    FROM documents)),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * CAST(sum(size) AS BIGINT) AS cap
  FROM rows GROUP BY source),
levels AS (
  SELECT b, (any_value(total) - coalesce(sum(cap) FILTER (cap / weight <= b), 0)::DOUBLE) / (sum(weight) FILTER (cap / weight > b))::DOUBLE AS level, min(cap / weight) FILTER (cap / weight > b) AS next
  FROM sources, (SELECT -1.0 AS b UNION SELECT DISTINCT cap / weight FROM sources), (SELECT sum(source_size)::DOUBLE AS total FROM sources) GROUP BY b),
goals AS (SELECT source, source_size, least(cap, weight * level) AS target FROM sources, (SELECT level FROM levels WHERE level >= b AND level < next ORDER BY b LIMIT 1)),
weights AS (SELECT source, weight_class AS w, sum(size)::BIGINT AS words FROM rows GROUP BY source, weight_class),
within AS (
  SELECT a.source, a.w AS b, any_value(target) AS target, coalesce(sum(x.words) FILTER (x.w > a.w), 0)::BIGINT AS capped, sum(x.words * x.w) FILTER (x.w <= a.w)::BIGINT AS weighed, min(x.w) FILTER (x.w > a.w) AS next
  FROM weights a JOIN weights x ON x.source IS NOT DISTINCT FROM a.source JOIN goals g ON g.source IS NOT DISTINCT FROM a.source GROUP BY a.source, a.w),
open AS (
  SELECT source, b, level FROM (SELECT *, (target - 3 * capped)::DOUBLE / nullif(weighed, 0) AS level FROM within)
  WHERE level * b < 3 AND (next IS NULL OR level * next >= 3) QUALIFY row_number() OVER (PARTITION BY source ORDER BY b DESC) = 1),
copies AS (
  SELECT *, floor(e)::BIGINT AS whole, e - floor(e) AS p FROM (
    SELECT g.source, w, words, CASE WHEN source_size = 0 THEN 0 WHEN o.source_found IS NULL OR w > o.b THEN 3 ELSE w * o.level END::DOUBLE AS e
    FROM weights JOIN goals g ON g.source IS NOT DISTINCT FROM weights.source LEFT JOIN (SELECT *, true AS source_found FROM open) o ON o.source IS NOT DISTINCT FROM g.source)),
ranked AS (
  SELECT r, rows.source, size, size_class, whole, p, CASE WHEN p > 0 AND size > 0 THEN floor((cbrt(rank / (1 + rank) * 2 - 1) + 1) * 8192)::BIGINT END AS rank_range
  FROM (SELECT *, u / (1 - u) / nullif(p / (1 - p), 0) AS rank FROM rows JOIN copies ON rows.source IS NOT DISTINCT FROM copies.source AND rows.weight_class = copies.w) rows),
expected AS (SELECT source, size_class, sum(size * p) AS expected FROM ranked GROUP BY source, size_class),
ranges AS (SELECT source, size_class, rank_range, sum(size)::BIGINT AS words FROM ranked WHERE rank_range IS NOT NULL GROUP BY source, size_class, rank_range),
summed AS (SELECT *, sum(words) OVER (PARTITION BY source, size_class ORDER BY rank_range)::BIGINT AS upto FROM ranges),
classes AS (
  SELECT s.source, s.size_class, any_value(expected) AS expected, list(rank_range ORDER BY rank_range) AS cells, list(words ORDER BY rank_range) AS words, list(upto ORDER BY rank_range) AS upto,
    (('0x' || md5('20:' || coalesce(s.source, '') || ':' || s.size_class)[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496 AS v, row_number() OVER (PARTITION BY s.source ORDER BY s.size_class DESC) AS step
  FROM summed s JOIN expected e ON e.source IS NOT DISTINCT FROM s.source AND e.size_class = s.size_class GROUP BY s.source, s.size_class),
walk AS (
  SELECT DISTINCT source, 0::BIGINT AS step, NULL::INTEGER AS size_class, NULL::BIGINT AS last, 0::DOUBLE AS carried FROM classes
  UNION ALL
  SELECT source, step, size_class, cells[fits + CASE WHEN more THEN 1 ELSE 0 END], missing - given - CASE WHEN more THEN following ELSE 0 END FROM (
    SELECT *, following > 0 AND missing - given > v * following AS more FROM (
      SELECT *, coalesce(upto[fits], 0)::DOUBLE AS given, coalesce(words[fits + 1], 0)::DOUBLE AS following FROM (
        SELECT c.*, carried + expected AS missing, len(list_filter(c.upto, lambda x: x <= carried + expected)) AS fits
        FROM walk JOIN classes c ON c.source IS NOT DISTINCT FROM walk.source AND c.step = walk.step + 1))))
SELECT rows.doc_id, rows.size, g.source_size, g.target, rows.size * (k.whole + coalesce(k.rank_range <= w.last, false)::BIGINT) AS taken
FROM rows JOIN ranked k USING (r) JOIN goals g ON rows.source IS NOT DISTINCT FROM g.source
LEFT JOIN walk w ON w.source IS NOT DISTINCT FROM rows.source AND w.size_class = rows.size_class
"""

_OP4_WORDS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP4 = f"""
WITH d AS (SELECT doc_id, {_OP4_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_OP4_WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT item, w, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


_ESCAPED = "replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;'), ']', '&rsqb;')"

OP7 = f"""
WITH r AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), '')) AS loss_sha256,
  CAST(3 + sum(length({_ESCAPED.format("text")})
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 16 + length({_ESCAPED.format("coalesce(role, '')")}) END) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(CASE role WHEN 'system' THEN 's' WHEN 'user' THEN 'u' WHEN 'assistant' THEN 'a' ELSE 'x' END, '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text), 's?(ua)+') AS valid
FROM r GROUP BY conv_id
"""

OP9 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes na ON na.doc_id = a JOIN sizes nb ON nb.doc_id = b WHERE 100 * k >= 80 * (na.n + nb.n - k)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS first_id, a AS here FROM ways UNION SELECT r.first_id, w.b FROM reach r JOIN ways w ON w.a = r.here),
roots AS (SELECT first_id AS doc_id, min(here) AS root FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN roots USING (doc_id)
"""

_UPPER_CASE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_GRID = "([0.0, 0.005, 0.01, 0.015, 0.02, 0.025, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.16, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]::DOUBLE[])"
_BUDGETS = "([0.0, 0.0025, 0.005, 0.01, 0.015, 0.02, 0.03, 0.04]::DOUBLE[])"

OP10 = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS times FROM (SELECT r, i, w[i:i + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM win WHERE times > 1) GROUP BY r),
counted AS (
  SELECT d.r, doc_id, lang, md5(t) AS digest, len(w) AS n_words, length(translate(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(again.n, 0) AS n_repeat_words, length(t) - length(translate(t, '!', '')) AS n_exclaims, length(t) - length(translate(t, '{_UPPER_CASE}', '')) AS n_upper
  FROM d LEFT JOIN again USING (r)),
m AS (
  SELECT *, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counted),
levels AS (
  SELECT *, list_transform([coalesce(n_symbols::DOUBLE / nullif(word_chars, 0), 0), coalesce(n_dup_lines::DOUBLE / nullif(len(lines), 0), 0),
    coalesce(n_repeat_words::DOUBLE / nullif(n_words, 0), 0), coalesce(n_exclaims::DOUBLE / nullif(n_words, 0), 0), coalesce(n_upper::DOUBLE / nullif(word_chars, 0), 0)],
    lambda v: len(list_filter({_GRID}, lambda c: v > c))) AS lv
  FROM m),
known AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) AND doc_id IS NOT NULL GROUP BY doc_id),
texts AS (
  SELECT lang, digest, lv, min(quality) AS q, ('0x' || digest[1:8])::BIGINT % 3 = 0 AS tuning FROM levels JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY lang, digest, lv),
tune AS (SELECT lang, rule, lv[rule] AS level, q FROM (SELECT *, unnest(range(1, 6)) AS rule FROM texts WHERE tuning)),
above AS (
  SELECT lang, rule, place, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND level > place) AS good, count(*) FILTER (q = 0 AND level > place) AS bad
  FROM tune, range(0, len({_GRID}) + 1) AS p(place) GROUP BY lang, rule, place),
tried AS (
  SELECT lang, rule, j, count(*) FILTER (good > n * {_BUDGETS}[j]) AS place FROM above, range(1, len({_BUDGETS}) + 1) AS b(j) WHERE place < len({_GRID}) GROUP BY lang, rule, j),
chain AS (
  SELECT lang, rule, 0::BIGINT AS j, len({_GRID})::BIGINT AS place FROM (SELECT DISTINCT lang, rule FROM above)
  UNION ALL
  SELECT c.lang, c.rule, t.j, CASE WHEN (x.bad - y.bad) - (x.good - y.good) > 0 THEN t.place ELSE c.place END
  FROM chain c JOIN tried t ON t.lang IS NOT DISTINCT FROM c.lang AND t.rule = c.rule AND t.j = c.j + 1
  JOIN above x ON x.lang IS NOT DISTINCT FROM c.lang AND x.rule = c.rule AND x.place = t.place
  JOIN above y ON y.lang IS NOT DISTINCT FROM c.lang AND y.rule = c.rule AND y.place = c.place),
sets AS (SELECT lang, j, list(place ORDER BY rule) AS places FROM chain WHERE j > 0 GROUP BY lang, j),
tested AS (
  SELECT t.lang, j, any_value(places) AS places, count(*) FILTER (q = 1) AS n, count(*) FILTER (q = 1 AND out) AS good, count(*) FILTER (q = 0 AND out) AS bad
  FROM (SELECT t.lang, s.j, s.places, t.q, len(list_filter(range(1, 6), lambda i: t.lv[i] > s.places[i])) > 0 AS out FROM texts t JOIN sets s ON s.lang IS NOT DISTINCT FROM t.lang WHERE NOT t.tuning) t
  GROUP BY t.lang, j),
judged AS (
  SELECT *, CASE WHEN good >= n * 0.05 THEN 1 ELSE list_sum(list_transform(range(0, good + 1),
    lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * ln(0.05::DOUBLE) + (n - k) * ln(0.95::DOUBLE)))) END AS p,
    0.05 / (SELECT count(*) FROM (SELECT DISTINCT lang FROM tested)) AS level
  FROM tested),
certified AS (SELECT *, bool_and(p <= level) OVER (PARTITION BY lang ORDER BY j) AS certified FROM judged),
chosen AS (SELECT lang, places FROM certified WHERE certified AND bad > good QUALIFY row_number() OVER (PARTITION BY lang ORDER BY bad - good DESC, j) = 1)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(len(list_filter(range(1, 6), lambda i: lv[i] > places[i])) > 0, false) AS kept
FROM levels l LEFT JOIN chosen c ON c.lang IS NOT DISTINCT FROM l.lang
"""

OP11 = rf"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) AS sizes(m) WHERE len(w) >= m)),
counts AS (SELECT lang, m, phrase, count(*) AS f FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
cuts AS (SELECT lang, m, phrase, f AS a, k, string_split(phrase, ' ') AS w FROM (SELECT *, unnest(range(1, m)) AS k FROM counts WHERE m > 1)),
scored AS (
  SELECT c.lang, c.m, c.phrase, c.a, c.k, x.f AS l, y.f AS r, n, CAST((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts c JOIN total USING (lang) JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ') JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
kept AS (
  SELECT * FROM scored s WHERE NOT EXISTS (
    SELECT 1 FROM counts b WHERE b.lang = s.lang AND b.m > s.m AND 100 * b.f >= 100 * s.a AND contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept
QUALIFY rank <= 2000
"""


def _leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


OP12 = f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, {_leaf("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_leaf(LOWER.format("text"))} ELSE {_leaf("text")} END AS seen,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS width
  FROM (SELECT *, crc FROM documents JOIN (SELECT DISTINCT doc_id AS crc_id, $CRC AS crc FROM documents) ON crc_id IS NOT DISTINCT FROM doc_id)),
nodes AS (
  SELECT grp, 0 AS level, idx, width, leaf AS h FROM leaves
  UNION ALL
  SELECT grp, level + 1, idx // 8, (width + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE width > 1 GROUP BY grp, level, width, idx // 8),
subroots AS (SELECT grp, h AS subroot, level AS height, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS width FROM nodes WHERE width = 1),
upper AS (
  SELECT 0 AS level, idx, width, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, idx // 8, (width + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM upper WHERE width > 1 GROUP BY level, width, idx // 8),
root AS (SELECT h AS root FROM upper WHERE width = 1),
siblings AS (
  SELECT l.r, n.level, n.idx, n.idx < l.idx // (8 ** n.level)::BIGINT AS is_left, n.idx = l.idx // (8 ** n.level)::BIGINT AS is_self, n.h
  FROM leaves l JOIN nodes n ON n.grp = l.grp AND n.width > 1 AND n.idx // 8 = l.idx // (8 ** (n.level + 1))::BIGINT
  UNION ALL
  SELECT l.r, s.height + u.level, u.idx, u.idx < s.idx // (8 ** u.level)::BIGINT, u.idx = s.idx // (8 ** u.level)::BIGINT, u.h
  FROM leaves l JOIN subroots s USING (grp) JOIN upper u ON u.width > 1 AND u.idx // 8 = s.idx // (8 ** (u.level + 1))::BIGINT),
steps AS (
  SELECT r, level, coalesce(string_agg(h, '' ORDER BY idx) FILTER (is_left), '') AS before, coalesce(string_agg(h, '' ORDER BY idx) FILTER (NOT is_left AND NOT is_self), '') AS after
  FROM siblings GROUP BY r, level),
proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY level)) AS proof_sha256 FROM steps GROUP BY r),
folds AS (
  SELECT r, 0 AS level, seen AS h FROM leaves
  UNION ALL
  SELECT f.r, f.level + 1, sha256(before || h || after) FROM folds f JOIN steps s ON s.r = f.r AND s.level = f.level),
folded AS (SELECT r, arg_max(h, level) AS folded_root FROM folds GROUP BY r)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM leaves JOIN subroots USING (grp) JOIN folded USING (r) LEFT JOIN proofs USING (r), root
"""

# DuckDB has no CRC-32: eight shifts for each byte of the id.
def _crc32(text: str) -> str:
    step = "list_reduce(range(0, 8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, {0})"
    each = step.format("xor(c, b)")
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {each}, 4294967295::BIGINT), 4294967295)"


OP12 = OP12.replace("$CRC", _crc32("CAST(doc_id AS VARCHAR)"))

OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (
  SELECT r, doc_id, i, line, {LOWER.format(r"trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT r, doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d)),
repeated AS (SELECT key, min(doc_id) AS keeper FROM l WHERE length(key) >= 10 GROUP BY key HAVING min(doc_id) < max(doc_id)),
judged AS (SELECT l.*, coalesce(doc_id > keeper, false) AS gone FROM l LEFT JOIN repeated USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY r
"""

ORACLES = {"op2_mixing": OP2, "op3_url_filter": OP3, "op4_decontaminate": OP4, "op7_chat_format": OP7, "op9_near_dedup": OP9, "op10_quality_rules": OP10, "op11_collocations": OP11, "op12_merkle_manifest": OP12, "op13_line_dedup": OP13}
