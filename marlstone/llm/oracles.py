"""DuckDB SQL of the corpus queries that SQL can express."""

from __future__ import annotations

_SPACE = r"[\x20\x09-\x0D]+"

#: Exact near-duplicate components: every pair that shares a shingle is compared.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_SPACE}'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * (na + nb - shared)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, d.b FROM r JOIN d ON r.b = d.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(s) AS bigint) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)"""

_RATES = ("symbol_rate", 4.0), ("dup_line_rate", 1.0), ("repeat_rate", 1.0), ("upper_rate", 1.0), ("shout_rate", 4.0), ("mean_word", 64.0)
_PLACE = ", ".join(f"CASE WHEN {r} <= 0 THEN 48 ELSE least(greatest(CAST(floor(ln({r} / {top}) / ln(0.88)) AS int) + 1, 0), 48) END" for r, top in _RATES)

#: The base counts, and cutoffs on a common grid as far as the exact binomial tail of the distinct labelled good texts allows.
QUALITY_RULES = rf"""
WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
g AS (SELECT *, CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) ELSE [] END AS g FROM w),
x AS (SELECT doc_id, unnest(g) AS t, unnest(range(1, len(g) + 1)) AS i FROM g),
tw AS (SELECT doc_id, t FROM x GROUP BY ALL HAVING count(*) > 1),
rw AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT x.doc_id, unnest([i, i + 1, i + 2]) AS k FROM x JOIN tw ON x.doc_id = tw.doc_id AND x.t = tw.t) GROUP BY 1),
b AS (SELECT g.doc_id, lang, text, CAST(len(w) AS bigint) AS n_words, CAST(length(array_to_string(w, '')) AS bigint) AS word_chars, CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS bigint) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS bigint) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS bigint) AS n_repeat_words, len(lines) AS n_lines, length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_upper, length(text) - length(translate(text, '!?', '')) AS n_shouts FROM g LEFT JOIN rw ON g.doc_id = rw.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_rate, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_rate, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_rate,
  coalesce(n_upper / nullif(word_chars, 0), 0) AS upper_rate, coalesce(n_shouts / nullif(n_words, 0), 0) AS shout_rate, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word FROM b),
places AS (SELECT doc_id, coalesce(lang, '(none)') AS lang_group, text, base_failed, least({_PLACE}) AS place FROM f),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
held AS (SELECT DISTINCT lang_group, text, place FROM places WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM good)),
n AS (SELECT lang_group, count(*) AS n, list(place) AS held FROM held GROUP BY ALL),
grid AS (SELECT lang_group, n, unnest(range(0, 48)) AS j, held FROM n),
cnt AS (SELECT lang_group, n, j, len(list_filter(held, lambda p: p <= j)) AS k FROM grid),
tail AS (SELECT lang_group, j, CASE WHEN k >= n * 0.01 THEN 1 ELSE list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.01) + (n - i) * ln(0.99)))) END AS p FROM cnt),
ok AS (SELECT lang_group, j, p <= 0.05 / (SELECT count(DISTINCT lang_group) FROM places) AS ok FROM tail),
cut AS (SELECT lang_group, coalesce(min(j) FILTER (NOT ok), 48) - 1 AS cut FROM ok GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f.base_failed, NOT f.base_failed AND NOT coalesce(place <= cut, false) AS kept
FROM f JOIN places USING (doc_id) LEFT JOIN cut USING (lang_group)"""

#: Each beginning of each rebuilt conversation by the string of its turns' digests; crc32 bit by bit.
CONVERSATION_TRIE = """
WITH t AS (SELECT conv_id, turn, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS id, strlen(coalesce(text, '')) AS n_bytes FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(id ORDER BY turn NULLS FIRST, id) AS ids, list(n_bytes ORDER BY turn NULLS FIRST, id) AS sizes FROM t GROUP BY 1),
steps AS (SELECT *, flatten(list_transform(string_split(CAST(conv_id AS varchar), ''), lambda c: [CAST(ascii(c) AS bigint), 0, 0, 0, 0, 0, 0, 0])) AS steps FROM o),
h AS (SELECT conv_id, ids, sizes, xor(list_reduce(list_concat([CAST(4294967295 AS bigint)], steps), lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 9 AS h FROM steps),
c AS (SELECT h.conv_id, list_concat(coalesce(b.ids[1:h.h], []), h.ids[h.h + 1:]) AS ids, list_concat(coalesce(b.sizes[1:h.h], []), h.sizes[h.h + 1:]) AS sizes FROM h LEFT JOIN o b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, len(ids) AS n, d, array_to_string(ids[1:d], '') AS prefix, CASE WHEN d = 0 THEN 0 ELSE sizes[d] END AS n_bytes FROM (SELECT *, unnest(range(0, len(ids) + 1)) AS d FROM c)),
n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_bytes) AS n_bytes, sha256(coalesce(string_agg(CAST(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (n = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT substr(prefix, 1, 32 * (d - 1)) AS prefix, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (prefix)),
s AS (SELECT substr(prefix, 1, 32 * j) AS prefix, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((n_convs - 1) * n_bytes) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM u) GROUP BY 1)
SELECT u.conv_id, u.d AS depth, a.conv_id AS parent_conv_id, u.n_convs, u.n_children, CAST(s.n_leaves AS bigint) AS n_leaves, CAST(s.saved AS bigint) AS saved_tokens, u.ends_sha256
FROM u JOIN s USING (prefix) LEFT JOIN n a ON u.d > 0 AND a.d = u.d - 1 AND a.prefix = substr(u.prefix, 1, 32 * (u.d - 1))"""

#: All phrases of each piece, counted whole.
COLLOCATIONS = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
ks AS (SELECT unnest(range(1, 5)) AS k),
o AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, ks WHERE len(w) >= k),
n AS (SELECT lang, count(*) AS n FROM o WHERE k = 1 GROUP BY 1),
f AS (SELECT lang, k, phrase, count(*) AS f FROM o GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, k, f AS a, cut, array_to_string(w[1:cut], ' ') AS x, array_to_string(w[cut + 1:], ' ') AS y FROM (SELECT *, unnest(range(1, k)) AS cut FROM c)),
s AS (SELECT cuts.lang, cuts.phrase, a, cut, fx.f AS l, fy.f AS r, CAST((CAST(2000000 AS hugeint) * a) // (fx.f + fy.f) AS bigint) AS score FROM cuts JOIN f fx ON fx.lang = cuts.lang AND fx.phrase = x JOIN f fy ON fy.lang = cuts.lang AND fy.phrase = y),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inside AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
ranked AS (SELECT worst.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst LEFT JOIN inside USING (lang, phrase) WHERE longer IS NULL OR CAST(longer AS hugeint) * 100 < CAST(a AS hugeint) * 80)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""
