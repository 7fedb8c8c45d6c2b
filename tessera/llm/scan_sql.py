"""SQL that states the results of operators 12 and 13: their definitions, spelled out. DuckDB has no CRC-32, so it is
computed bit by bit."""

from __future__ import annotations


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes, as an expression."""
    digits = f"hex(encode({text}))"
    byte = f"CAST('0x' || substr({digits}, CAST(1 + 2 * (k // 8) AS BIGINT), 2) AS BIGINT)"
    bits = f"list_transform(range(4 * length({digits})), lambda k: ({byte} >> (k % 8)) & 1)"
    return f"xor(4294967295, list_reduce(list_concat([4294967295], {bits}), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)))"


# A run of at least 12 words repeats at least 6 of them at its lag, so windows of 6 words find every run.
OP12_SQL = rf"""
WITH split AS (SELECT doc_id, {crc32("CAST(doc_id AS VARCHAR)")} AS h, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM split),
placed AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n END AS a, CASE WHEN h % 10 = 0 AND n > 0 THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM sized),
texts AS (SELECT row_number() OVER () AS row, doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_concat(w[1:a], list_transform(range(n - a), lambda i: w[1 + a + i % p])) END AS w FROM placed),
grams AS (SELECT row, i, array_to_string(w[i + 1:i + 6], ' ') AS gram, n FROM (SELECT row, w, n, unnest(range(n - 5)) AS i FROM texts WHERE n >= 12)),
pairs AS (SELECT x.row, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON x.row = y.row AND x.gram = y.gram AND y.i > x.i AND 2 * (y.i - x.i) <= x.n),
islands AS (SELECT row, q, min(i) AS start, count(*) + 5 AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY row, q ORDER BY i) AS island FROM pairs) GROUP BY row, q, island),
runs AS (SELECT row, start, size + q AS length, min(q) AS period FROM islands WHERE size >= greatest(12 - q, q) GROUP BY row, start, size + q),
told AS (SELECT row, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS said FROM runs GROUP BY row),
greatest_ AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY length DESC, start, period) AS place FROM runs) WHERE place = 1),
gone AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT t.row, string_agg(t.w[t.i + 1], ' ' ORDER BY t.i) AS words FROM (SELECT row, w, unnest(range(n)) AS i FROM texts WHERE row IN (SELECT row FROM runs)) t ANTI JOIN gone USING (row, i) GROUP BY t.row)
SELECT t.doc_id, coalesce(told.n_runs, 0) AS n_runs, g.start, CAST(g.length AS BIGINT) AS length, CAST(g.period AS BIGINT) AS period, CAST(1000 * g.length // g.period AS BIGINT) AS exponent_milli,
  sha256(coalesce(told.said, '')) AS runs_sha256, sha256(CASE WHEN told.row IS NULL THEN array_to_string(t.w, ' ') ELSE coalesce(kept.words, '') END) AS collapsed_sha256
FROM texts t LEFT JOIN told ON told.row = t.row LEFT JOIN greatest_ g ON g.row = t.row LEFT JOIN kept ON kept.row = t.row
"""

OP13_SQL = rf"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
low AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times FROM found WHERE length(run) >= 6 GROUP BY 1, 2),
hashed AS (SELECT *, {crc32("doc_id || ':' || run")} AS h FROM low),
slipped AS (SELECT times, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
one AS (SELECT DISTINCT c.word AS a, w.word AS b FROM cut c JOIN words w ON w.word = c.rest),
near AS (SELECT a AS word, b AS other FROM one UNION ALL SELECT b, a FROM one UNION ALL SELECT x.word, y.word FROM cut x JOIN cut y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word),
ranked AS (SELECT near.word, other, o.n AS other_n, row_number() OVER (PARTITION BY near.word ORDER BY o.n DESC, other) AS place, count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words o ON o.word = other),
formed AS (SELECT w.word, w.n, coalesce(r.n_near, 0) AS n_near, CASE WHEN r.other_n >= 5 * w.n THEN r.other END AS form, CASE WHEN r.other_n >= 5 * w.n THEN r.other_n END AS form_n FROM words w LEFT JOIN ranked r ON r.word = w.word AND r.place = 1),
chain(word, root) AS (SELECT word, word FROM formed WHERE form IS NULL UNION ALL SELECT f.word, c.root FROM formed f JOIN chain c ON f.form = c.word)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c USING (word)
"""
