"""The DuckDB twin of ``op11_spelling_variants``: near words by the words with one letter
left out, which two near words share, and an exact test of the pairs that meet."""

from __future__ import annotations

# Bytes of a text of letters up to U+00FF: one, or two of UTF-8.
_BYTES = (
    "flatten(list_transform(string_split({text}, ''), lambda s: CASE WHEN ord(s) < 128 THEN [ord(s)::bigint]"
    " ELSE [192 + (ord(s)::bigint >> 6), 128 + (ord(s)::bigint & 63)] END))"
)
# The table of CRC-32 steps of the 256 bytes, made by the rule.
_TABLE = (
    "list_transform(range(256), lambda b: list_reduce([b::bigint] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[],"
    " lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))"
)

OP11_SQL = f"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT {_TABLE} AS step),
runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM documents) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce([4294967295::bigint] || {_BYTES.format(text="coalesce(doc_id::varchar, '') || ':' || run")},
         lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM runs, steps),
words AS MATERIALIZED (
  SELECT word, sum(times)::bigint AS n FROM (
    SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::integer) || substr(run, (h % length(run))::integer + 2)
                  ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
less AS (
  SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION
  SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, max(n) AS best_n, arg_min(other, struct_pack(less := -n, w := other)) AS best
  FROM near GROUP BY word),
formed AS MATERIALIZED (
  SELECT word, words.n, coalesce(n_near, 0)::bigint AS n_near,
         CASE WHEN best_n >= 5 * words.n THEN best END AS form,
         (CASE WHEN best_n >= 5 * words.n THEN best_n END)::bigint AS form_n
  FROM words LEFT JOIN best USING (word)),
chain AS (
  SELECT word, form AS link FROM formed WHERE form IS NOT NULL
  UNION ALL
  SELECT chain.word, formed.form FROM chain JOIN formed ON formed.word = chain.link WHERE formed.form IS NOT NULL),
roots AS (SELECT word, arg_max(link, n) AS root FROM chain JOIN (SELECT word AS link, n FROM words) USING (link) GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, n_near, form_n FROM formed LEFT JOIN roots USING (word)
"""
