"""DuckDB SQL for the queries that it can express, over whole tables."""

from __future__ import annotations

GAP = r"[\x20\x09-\x0D]+"
ALPHABET_SIZE = 32


def words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '{GAP}'), lambda w: w != '')"


def line(text: str) -> str:
    return f"trim(regexp_replace({text}, '{GAP}', ' ', 'g'))"


QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text, {words("text")} AS w FROM documents),
l AS (SELECT r, host, unnest(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS raw FROM d),
n AS (SELECT r, host, raw, lower({line("raw")}) AS h, len({words("raw")}) AS nw FROM l),
e AS (SELECT r, host, md5(text) AS whole FROM d),
f AS (SELECT n.host, h, count(DISTINCT whole) AS n_docs FROM n JOIN e USING (r) GROUP BY n.host, h HAVING count(DISTINCT whole) > 20),
a AS (SELECT host, count(DISTINCT whole) AS n_host FROM e GROUP BY host),
q AS (SELECT f.host, h FROM f JOIN a ON f.host IS NOT DISTINCT FROM a.host WHERE n_docs > 0.1 * n_host),
g AS (SELECT r, sum(nw) AS gone FROM n SEMI JOIN q ON n.h = q.h AND n.host IS NOT DISTINCT FROM q.host GROUP BY r),
u AS (SELECT r, count(*) - count(DISTINCT raw) AS n_dup FROM l GROUP BY r),
x AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d),
y AS (SELECT r, i, array_to_string(list_slice(w, i, i + 7), ' ') AS s FROM x),
z AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM y) WHERE c > 1),
t AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM z) GROUP BY r),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, '{GAP}', '', 'g'))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_dup, 0)::BIGINT AS n_dup_lines,
             coalesce(n_rep, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS n_words_frequent
      FROM d LEFT JOIN u USING (r) LEFT JOIN t USING (r) LEFT JOIN g USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words - n_words_frequent < 0.2 * n_words) AS kept, n_words_frequent
FROM b
"""

LINES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, text FROM documents),
l AS (SELECT doc_id, body, row_number() OVER (PARTITION BY doc_id, body ORDER BY i) AS k, i, t
      FROM (SELECT DISTINCT doc_id, body, unnest(range(1, len(string_split(body, chr(10))) + 1)) AS i, {line("unnest(string_split(body, chr(10)))")} AS t FROM d) WHERE t != ''),
w AS (SELECT doc_id, body, i, lead(i) OVER o AS i2, lead(i, 2) OVER o AS i3, t, lead(t) OVER o AS t2, lead(t, 2) OVER o AS t3 FROM l WINDOW o AS (PARTITION BY doc_id, body ORDER BY i)),
p AS (SELECT *, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id NULLS FIRST, body, i) AS nth FROM w WHERE t3 IS NOT NULL),
g AS (SELECT doc_id, body, list(DISTINCT x) AS gone FROM (SELECT doc_id, body, unnest([i, i2, i3]) AS x FROM p WHERE nth > 1) GROUP BY doc_id, body),
n AS (SELECT doc_id, body, count(*) AS n_lines FROM l GROUP BY doc_id, body)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed,
       CASE WHEN gone IS NULL THEN md5(d.text) ELSE md5(array_to_string(list_filter(string_split(d.body, chr(10)), lambda x, j: NOT list_contains(gone, j)), chr(10))) END AS kept_md5
FROM d LEFT JOIN n ON n.doc_id IS NOT DISTINCT FROM d.doc_id AND n.body = d.body LEFT JOIN g ON g.doc_id IS NOT DISTINCT FROM d.doc_id AND g.body = d.body
"""


def _model(kind: str) -> str:
    return f"""
{kind}0 AS (SELECT c, (sum({kind}) + any_value(kinds) / {ALPHABET_SIZE}.0) / any_value(total + kinds) AS p FROM grams,
    (SELECT sum(n) AS total, count(*) FILTER (n > 0) AS kinds FROM (SELECT c, sum({kind}) AS n FROM grams GROUP BY c)) GROUP BY c),
{kind}1 AS (SELECT b, o.c, CASE WHEN total > 0 THEN (n + kinds * p) / (total + kinds) ELSE p END AS p
    FROM (SELECT b, c, n, sum(n) OVER (PARTITION BY b) AS total, count(*) FILTER (n > 0) OVER (PARTITION BY b) AS kinds FROM (SELECT b, c, sum({kind}) AS n FROM grams GROUP BY b, c)) o JOIN {kind}0 z ON o.c = z.c),
{kind}2 AS (SELECT g, CASE WHEN total > 0 THEN ({kind} + kinds * p) / (total + kinds) ELSE p END AS p
    FROM (SELECT *, sum({kind}) OVER (PARTITION BY a, b) AS total, count(*) FILTER ({kind} > 0) OVER (PARTITION BY a, b) AS kinds FROM grams) t JOIN {kind}1 o ON t.b = o.b AND t.c = o.c)"""


URLS = f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
v AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
    WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule,
    '^^' || regexp_replace(regexp_replace(lower(host || path), '[0-9]', '0', 'g'), '[^a-z0./-]', '_', 'g') || '$' AS s FROM v),
k AS (SELECT *, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS ruled FROM r),
strings AS (SELECT s, substr(md5(s), 1, 1) IN ('0', '1', '2', '3') AS held, count(*) FILTER (ruled = 'allow') AS accepted, count(*) FILTER (ruled = 'block') AS rejected FROM k GROUP BY s),
each AS (SELECT s, held, accepted, rejected, substr(s, i, 3) AS g FROM (SELECT *, unnest(range(1, length(s) - 1)) AS i FROM strings)),
grams AS (SELECT g, substr(g, 1, 1) AS a, substr(g, 2, 1) AS b, substr(g, 3, 1) AS c, sum(CASE WHEN held THEN 0 ELSE accepted END) AS accepted, sum(CASE WHEN held THEN 0 ELSE rejected END) AS rejected FROM each GROUP BY g),
{_model("accepted")},{_model("rejected")},
ratio AS (SELECT x.g, ln(x.p) - ln(y.p) AS ratio FROM accepted2 x JOIN rejected2 y ON x.g = y.g),
scored AS (SELECT s, any_value(held) AS held, round(avg(ratio), 9) AS score, any_value(accepted) AS accepted, any_value(rejected) AS rejected FROM each JOIN ratio USING (g) GROUP BY s),
parts AS (SELECT 1 AS part, * FROM scored WHERE held UNION ALL SELECT 2, * FROM scored),
m AS (SELECT part, sum(accepted * score) / nullif(sum(accepted), 0) AS ma, sum(rejected * score) / nullif(sum(rejected), 0) AS mr,
             sum(accepted * score * score) / nullif(sum(accepted), 0) AS sa, sum(rejected * score * score) / nullif(sum(rejected), 0) AS sr FROM parts GROUP BY part),
h AS (SELECT part, round((ma * dr + mr * da) / (da + dr), 9) AS least FROM (SELECT part, ma, mr, sqrt(greatest(sa - ma * ma, 1e-12)) AS da, sqrt(greatest(sr - mr * mr, 1e-12)) AS dr FROM m)),
t AS (SELECT coalesce(max(least) FILTER (part = 1), max(least)) AS least FROM h)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score < least THEN 'block' ELSE 'allow' END) AS verdict FROM k JOIN scored USING (s), t
"""

#: Draws, units and cuts as the task states them; the output is put together and taken apart again by its markers.
MIDDLES = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, ('0x' || substr(x, 1, 8))::BIGINT AS h1,
        ('0x' || substr(x, 9, 8))::BIGINT AS h2, ('0x' || substr(x, 17, 8))::BIGINT AS h3, ('0x' || substr(x, 25, 8))::BIGINT AS h4 FROM d),
k AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
        CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, n, form, t, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p),
c AS (SELECT *, regexp_split_to_array(output, '<[PSM]>') AS cut FROM o)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN cut[2] || cut[4] || cut[3] ELSE cut[3] || cut[4] || cut[2] END) AS restored_sha256 FROM c
"""

ORACLE_SQL = {"op6_quality_rules": QUALITY, "op7_line_dedup": LINES, "op10_url_filter": URLS, "op11_fill_in_middle": MIDDLES}
