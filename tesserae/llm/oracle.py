"""SQL that gives the rows of text operators' queries, where SQL expresses them."""

from __future__ import annotations

from .decontaminate import WINDOW as ITEM_WINDOW
from .licenses import PHRASES, TEMPLATES, THRESHOLD
from .quality import BASE, RULES, STRICT
from .substrings import WINDOW as WORD_WINDOW

SPACED = r"[^\x20\x09-\x0D]+"
LETTERED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A place is covered if some window that begins at or before it reaches beyond it.
DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERED}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTERED}') AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT item_id, w, least({ITEM_WINDOW}, len(w)) AS z FROM b WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, z, list_slice(w, i, i + z - 1) AS g FROM (SELECT *, unnest(range(1, len(w) - z + 2)) AS i FROM bw)),
sizes AS (SELECT DISTINCT z FROM item_windows),
doc_windows AS (SELECT doc_id, i, z, list_slice(w, i, i + z - 1) AS g FROM (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, sizes WHERE len(w) >= z)),
hits AS (SELECT doc_id, i, x.z, item_id FROM doc_windows x JOIN item_windows y ON x.z = y.z AND x.g = y.g),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + z)) AS p FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN items USING (doc_id) LEFT JOIN covered USING (doc_id)
"""


def _rows(rows: list[tuple[str, str]]) -> str:
    return ", ".join("('" + "', '".join(v.replace("'", "''") for v in r) + "')" for r in rows)


def _lettered(text: str) -> str:
    return f"regexp_extract_all(translate({text}, '{UPPER}', '{LOWER}'), '{LETTERED}')"


#: A block is a line (c = 0) or 2 c words from a multiple of c, c the least power of two not below a template's words.
LICENSES = f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {_lettered("coalesce(text, '')")} AS w FROM documents),
phrases AS MATERIALIZED (SELECT label, len(u) AS z, array_to_string(u, ' ') AS g FROM (SELECT *, {_lettered("phrase")} AS u FROM (VALUES {_rows(list(PHRASES))}) v(phrase, label))),
grams AS (SELECT r, i - 1 AS place, array_to_string(list_slice(w, i, i + z - 1), ' ') AS g FROM (SELECT r, w, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM phrases) WHERE len(w) >= z)),
base AS (SELECT r, count(*) AS n, min(place) AS a, max(place) AS b, list_sort(list(DISTINCT label)) AS labels FROM grams JOIN phrases USING (g) GROUP BY r),
t0 AS (SELECT DISTINCT label, list_sort(list_distinct(w)) AS tokens, CAST(pow(2, ceil(log2(len(w)))) AS BIGINT) AS c FROM (SELECT label, {_lettered("notice")} AS w FROM (VALUES {_rows([(k, x) for k, xs in TEMPLATES.items() for x in xs])}) v(label, notice))),
t AS (SELECT row_number() OVER () AS k, label, c, len(tokens) AS size, ceil({THRESHOLD} * len(tokens) - 1e-9) AS need, tokens FROM t0),
wanted AS MATERIALIZED (SELECT k, c, unnest(tokens) AS w FROM t),
units AS (SELECT r, place, w[place + 1] AS w FROM (SELECT r, w, unnest(range(0, len(w))) AS place FROM d)),
lines AS (SELECT r, line, unnest({_lettered("l[line]")}) AS w FROM (SELECT r, l, unnest(range(1, len(l) + 1)) AS line FROM (SELECT r, string_split(text, chr(10)) AS l FROM d))),
blocks AS (SELECT DISTINCT r, 0 AS kind, line AS block, k, w FROM lines JOIN wanted USING (w)
  UNION SELECT r, 1, block, k, w FROM (SELECT r, unnest([place // c, place // c - 1]) AS block, k, w FROM units JOIN wanted USING (w)) WHERE block >= 0),
hits AS (SELECT r, label, share FROM (SELECT r, kind, block, k, count(*) AS n FROM blocks GROUP BY ALL) JOIN (SELECT k, label, need, size FROM t) USING (k), LATERAL (SELECT n / size AS share) WHERE n >= need),
found AS (SELECT r, list(DISTINCT label) AS labels, max(share) AS best FROM hits GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word, coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels, CAST(CASE WHEN n > 0 THEN 1 ELSE coalesce(best, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN found USING (r)
"""

SUBSTRINGS = f"""
WITH u AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
windows AS (SELECT doc_id, i, list_slice(w, i, i + {WORD_WINDOW - 1}) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WORD_WINDOW} + 2)) AS i FROM u WHERE len(w) >= {WORD_WINDOW})),
least_of AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
starts AS (SELECT doc_id, i FROM windows JOIN least_of USING (g) WHERE first < doc_id),
units AS (SELECT doc_id, w[i] AS unit, i FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM u)),
marked AS (SELECT n.doc_id, n.i, unit, coalesce(max(s.i) OVER (PARTITION BY n.doc_id ORDER BY n.i) > n.i - {WORD_WINDOW}, false) AS removed
  FROM units n LEFT JOIN starts s ON n.doc_id = s.doc_id AND n.i = s.i),
sums AS (SELECT doc_id, count_if(removed) AS n_removed, string_agg(unit, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS kept FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM u LEFT JOIN sums USING (doc_id)
"""

MEASURES = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{SPACED}') AS w FROM documents),
grams AS (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2))),
again AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM grams WHERE n > 1) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{SPACED}')) AS l FROM t),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines
  FROM t JOIN lines USING (r) LEFT JOIN again USING (r))
"""


def _any(rules: tuple[str, ...]) -> str:
    return " OR ".join(f"({RULES[r]})" for r in rules)


QUALITY = MEASURES + f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_any(BASE.rules)} AS base_failed, NOT ({_any(STRICT.rules)}) AS kept FROM m"


def _ablation(policy, rule: str) -> str:
    others = tuple(r for r in policy.rules if r != rule)
    return f"SELECT '{policy.version}' AS version, '{rule}' AS rule, CAST(count_if({RULES[rule]}) AS BIGINT) AS fails, CAST(count_if(({RULES[rule]}) AND NOT ({_any(others)})) AS BIGINT) AS removes_alone, CAST(count_if(NOT ({_any(policy.rules)})) AS BIGINT) AS kept FROM m"


ABLATIONS = MEASURES + " UNION ALL ".join(_ablation(p, r) for p in (BASE, STRICT) for r in p.rules)

# A table of the CRC polynomial finds the tampered rows; levels of the trees and ways to the roots by recursion.
MERKLE = """
WITH RECURSIVE polynomials AS (SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, n) ORDER BY n) AS t FROM range(0, 256) AS r(n)),
crc AS (SELECT doc_id, xor(4294967295, list_reduce([ord(x) for x in string_split(CAST(doc_id AS VARCHAR), '')], lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 7 = 0 AS hit
  FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL), polynomials),
values_ AS (SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
  coalesce(strlen(text) || ':' || text, '-') AS tail, n_chars, CAST(CAST(n_chars AS HUGEINT) + 1 AS VARCHAR) AS more FROM documents),
hashed AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf, sha256(head || coalesce(strlen(more) || ':' || more, '-') || tail) AS changed FROM values_),
leaves AS (SELECT row_number() OVER () AS row, h.doc_id, lang, leaf, CASE WHEN coalesce(hit, false) THEN changed ELSE leaf END AS claimed,
  row_number() OVER (PARTITION BY lang ORDER BY h.doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed AS h LEFT JOIN crc USING (doc_id)),
tree AS (SELECT lang, 0 AS level, pos, leaf AS node, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL SELECT lang, level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, level, pos // 2),
subroots AS (SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
high AS (SELECT 0 AS level, pos, subroot AS node, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, pos // 2, sha256(string_agg(node, '' ORDER BY pos)), (max(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY level, pos // 2),
root AS (SELECT node AS root FROM high WHERE n = 1),
steps AS (SELECT row, l.level AS k, (pos >> l.level) & 1 AS side, l.level, a.lang, xor(a.pos >> l.level, 1) AS beside FROM leaves AS a JOIN (SELECT DISTINCT lang, level FROM tree WHERE n > 1) AS l ON a.lang IS NOT DISTINCT FROM l.lang),
low_path AS (SELECT row, list({'side': side, 'node': coalesce(node, '')} ORDER BY s.level) AS path FROM steps AS s LEFT JOIN tree AS t ON t.lang IS NOT DISTINCT FROM s.lang AND t.level = s.level AND t.pos = beside GROUP BY row),
high_path AS (SELECT lang, list({'side': (s.pos >> l.level) & 1, 'node': coalesce(node, '')} ORDER BY l.level) AS path FROM subroots AS s CROSS JOIN (SELECT DISTINCT level FROM high WHERE n > 1) AS l LEFT JOIN high AS h ON h.level = l.level AND h.pos = xor(s.pos >> l.level, 1) GROUP BY lang),
ways AS (SELECT a.*, subroot, root, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path FROM leaves AS a JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM a.lang CROSS JOIN root LEFT JOIN low_path AS p USING (row) LEFT JOIN high_path AS q ON q.lang IS NOT DISTINCT FROM a.lang),
folded AS (SELECT *, list_reduce([x.node || x.side for x in path], lambda h, x: sha256(CASE WHEN right(x, 1) = '1' THEN x[:-2] || h ELSE h || x[:-2] END), claimed) AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(list_aggregate([x.node for x in path], 'string_agg', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""
