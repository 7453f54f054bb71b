"""SQL of the registered queries, for DuckDB."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op10_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT doc_id, i, CASE WHEN i <= len(w) - 2 THEN [w[i], w[i + 1], w[i + 2]] END AS g FROM pos),
twice AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS r FROM grams),
flags AS (SELECT doc_id, r OR coalesce(lag(r) OVER p, false) OR coalesce(lag(r, 2) OVER p, false) AS hit
          FROM twice WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
repeats AS (SELECT doc_id, count(*) FILTER (hit) AS n FROM flags GROUP BY doc_id),
lines AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line,
                 unnest(range(0, len(string_split(text, chr(10))))) AS nr FROM d),
worded AS (SELECT *, regexp_replace(trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')), '[0-9]+', '0', 'g') AS norm,
                  len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
           FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY doc_id),
often AS (SELECT host, norm, min(doc_id) AS first FROM worded GROUP BY host, norm HAVING count(DISTINCT text) > 20),
removed AS (SELECT doc_id, count(*) AS lines, sum(n) AS words FROM worded JOIN often USING (host, norm)
            WHERE doc_id <> first GROUP BY doc_id),
facts AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
       CAST(len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
       CAST(coalesce(dups.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(repeats.n, 0) AS BIGINT) AS n_repeat_words,
       CAST(coalesce(removed.words, 0) AS BIGINT) AS removed_words, CAST(coalesce(removed.lines, 0) AS BIGINT) AS n_removed_lines
FROM d JOIN w USING (doc_id) LEFT JOIN dups USING (doc_id) LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)),
base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
SELECT *, NOT base_failed AND n_words - removed_words >= n_words * 0.5 AS kept FROM base
"""

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op7_near_duplicates"] = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 75 * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT v, root FROM reach JOIN both_ways ON node = u),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""

ORACLES["op8_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT item_id, w, least(len(w), 10) AS l, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM b WHERE len(w) > 0)),
l AS (SELECT DISTINCT l FROM q),
x AS (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS g FROM (
        SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, l WHERE len(w) >= l)),
hits AS (SELECT doc_id, item_id, l, i FROM x JOIN q USING (l, g)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(items.s, '')) AS items_sha256,
       coalesce(covered.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLES["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS nr
           FROM documents WHERE text IS NOT NULL),
worded AS (SELECT *, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS w
           FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
sets AS (SELECT *, len(w) AS n, doc_id * 1000000 + nr AS spot FROM worded WHERE len(w) >= 5),
classes AS (SELECT w, n, min(spot) AS first FROM sets GROUP BY w, n),
t AS (SELECT first, n, unnest(w) AS word FROM classes),
p AS (SELECT a.first AS a, b.first AS b, a.n AS an, b.n AS bn, count(*) AS k FROM t a JOIN t b
      ON a.word = b.word AND a.first < b.first AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
m AS (SELECT b AS first, min(a) AS witness FROM p WHERE 100 * k >= 85 * (an + bn - k) GROUP BY b),
removed AS (SELECT doc_id, nr
            FROM sets JOIN classes USING (w, n) LEFT JOIN m USING (first)
            WHERE witness IS NOT NULL OR spot <> first),
r AS (SELECT doc_id, count(*) AS n, string_agg(nr, ',' ORDER BY nr) AS s
      FROM removed GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) AS n FROM worded GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(lines.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
       coalesce(r.s, '') AS removed
FROM documents d LEFT JOIN lines USING (doc_id) LEFT JOIN r USING (doc_id)
"""

ORACLES["op1_line_links"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS nr
           FROM documents WHERE text IS NOT NULL),
worded AS (SELECT doc_id, nr, list_sort(list_distinct(regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+'))) AS w FROM l),
sets AS (SELECT *, len(w) AS n, doc_id * 1000000 + nr AS spot FROM worded WHERE len(w) >= 5),
classes AS (SELECT w, n, min(spot) AS first, count(*) AS size FROM sets GROUP BY w, n),
t AS (SELECT first, n, size, unnest(w) AS word FROM classes),
p AS (SELECT a.first AS a, any_value(b.size) AS size, a.n AS an, b.n AS bn, count(*) AS k FROM t a JOIN t b
      ON a.word = b.word AND a.first <> b.first AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.first, b.first, a.n, b.n),
m AS (SELECT a AS first, sum(size) AS near FROM p WHERE 100 * k >= 85 * (an + bn - k) GROUP BY a)
SELECT doc_id, nr AS line, first // 1000000 AS class_id, first % 1000000 AS class_line,
       CAST(size - 1 + coalesce(near, 0) AS BIGINT) AS n_links
FROM sets JOIN classes USING (w, n) LEFT JOIN m USING (first)
"""

ORACLES["op6_chat_formatting"] = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, 20 + length(role) + length(regexp_replace(role, '[^\\<\[]', '', 'g'))
                   + length(text) + length(regexp_replace(text, '[^\\<\[]', '', 'g')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

#: CRC-32 of an integer in decimal.
CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda ch: ascii(ch)::BIGINT)),
  lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda s, i: CASE WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END)), 4294967295)"""
FIELD = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
ROW = "sha256(" + " || ".join(FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", "{0}")) + ")"

# Levels of one tree per group `g`, and the siblings of every node: {0} names the tables, {1} the leaves (g, place, h).
TREE = """
{0}_lv AS (SELECT g, 0 AS lvl, place, h, count(*) OVER (PARTITION BY g) AS n FROM {1}
  UNION ALL
  SELECT g, lvl + 1, place // 3, sha256(string_agg(h, '' ORDER BY place)), (n + 2) // 3
  FROM {0}_lv WHERE n > 1 GROUP BY g, lvl, place // 3, n),
{0}_sib AS (SELECT a.g, a.lvl, a.place,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before,
    coalesce(string_agg(b.h, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
  FROM {0}_lv a JOIN {0}_lv b ON a.g = b.g AND a.lvl = b.lvl AND a.place // 3 = b.place // 3 WHERE a.n > 1 GROUP BY ALL),
{0}_top AS (SELECT g, h FROM {0}_lv WHERE n = 1)
"""

ORACLES["op13_merkle_manifest"] = f"""
WITH RECURSIVE
d AS (SELECT *, CASE WHEN {CRC32.format("doc_id")} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM documents),
sources AS (SELECT source AS host, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM documents)),
hashed AS (SELECT doc_id, g, {ROW.format("text")} AS h, {ROW.format("changed")} AS bad
           FROM d JOIN sources ON source IS NOT DISTINCT FROM host),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h, bad) - 1 AS place FROM hashed),
{TREE.format("own", "leaves")},
subroots AS (SELECT 0 AS g, g AS place, h FROM own_top),
{TREE.format("top", "subroots")},
climb AS (SELECT g, place, 0 AS lvl, place AS at, bad AS folded, '' AS met FROM leaves
  UNION ALL
  SELECT c.g, c.place, c.lvl + 1, c.at // 3, sha256(before || folded || after), met || before || after
  FROM climb c JOIN own_sib s ON c.g = s.g AND c.lvl = s.lvl AND c.at = s.place),
half AS (SELECT g, place, arg_max(folded, lvl) AS folded, arg_max(met, lvl) AS met FROM climb GROUP BY g, place),
rest AS (SELECT g, place, 0 AS lvl, g AS at, folded, met FROM half
  UNION ALL
  SELECT c.g, c.place, c.lvl + 1, c.at // 3, sha256(before || folded || after), met || before || after
  FROM rest c JOIN top_sib s ON c.lvl = s.lvl AND c.at = s.place),
done AS (SELECT g, place, arg_max(folded, lvl) AS folded, arg_max(met, lvl) AS met FROM rest GROUP BY g, place)
SELECT doc_id, leaves.h AS leaf, own_top.h AS subroot, top_top.h AS root, sha256(met) AS proof_sha256,
       folded AS folded_root, folded = top_top.h AS verified
FROM leaves JOIN done USING (g, place) JOIN own_top USING (g) CROSS JOIN top_top
"""

ORACLES["op12_prefix_trie"] = rf"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("conv_id")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM t)),
own AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY i) AS a FROM t GROUP BY conv_id),
built AS (SELECT c.conv_id, list_concat(coalesce(b.a[1:h], []), o.a[h + 1:]) AS a
          FROM c JOIN own o USING (conv_id) LEFT JOIN own b ON b.conv_id = base),
p AS (SELECT conv_id, a, unnest(range(0, len(a) + 1)) AS depth FROM built),
m AS (SELECT conv_id, depth, a[1:depth] AS k, len(a) = depth AS ends, a FROM p),
named AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, k) AS node FROM m),
n AS (SELECT node, depth, count(*) AS n_convs,
             (count(*) - 1) * max(CASE WHEN depth > 0 THEN len(regexp_extract_all(k[depth].text, '[^\x20\x09-\x0D]+')) ELSE 0 END) AS tokens,
             sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
      FROM named GROUP BY node, depth),
linked AS (SELECT n.*, u.node AS parent FROM n LEFT JOIN named u ON u.conv_id = n.node AND u.depth = n.depth - 1),
kids AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY ALL),
full_ AS (SELECT linked.*, coalesce(n_children, 0) AS n_children FROM linked LEFT JOIN kids USING (node, depth)),
sums AS (SELECT u.node, u.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(tokens) AS saved_tokens
         FROM full_ f JOIN named u ON u.conv_id = f.node AND u.depth <= f.depth GROUP BY u.node, u.depth)
SELECT node AS conv_id, depth, parent AS parent_conv_id, n_convs, n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256
FROM full_ JOIN sums USING (node, depth)
"""

ORACLES["op11_ngram_join"] = rf"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 3], ' ') END AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * k >= 85 * (a.n + b.n - k)),
both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
reach AS (SELECT doc_id AS node, doc_id AS root FROM documents
          UNION SELECT v, root FROM reach JOIN both_ways ON node = u),
c AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
