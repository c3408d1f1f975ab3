"""The DuckDB twin of ``op12_conversation_repair``: a recursive query over the turns.

Each step reads one turn and keeps, for the four states of the role pattern, the least
(cost, edits) with the repaired text; ``crc32`` is written out bit by bit.
"""

from __future__ import annotations

FAR = 1_000_000_000


def crc32_sql(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text without characters beyond ASCII."""
    step = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))"
    codes = f"list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)"
    return f"xor(list_reduce([4294967295::bigint] || {codes}, lambda c, b: {step}), 4294967295)"


def _add(state: str, cost: str, edit: str, line: str) -> str:
    return f"struct_pack(c := {state}.c + {cost}, e := {state}.e || '{edit}', t := {state}.t || {line})"


def _when(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE far END"


_USER, _ASSISTANT = "'user:' || chr(10)", "'assistant:' || chr(10)"
_U1 = f"least(u, {_add('s0', '2', 'I', _USER)}, {_add('s1', '2', 'I', _USER)}, {_add('a', '2', 'I', _USER)})"


def _reroled(state: str, role: str) -> str:
    return _when("status < 2", _add(state, "2 + extra", "R", f"'{role}:' || text || chr(10)"))


def _kept(state: str, initial: str) -> str:
    return _when(f"status < 2 AND initial = '{initial}'", _add(state, "extra", "K", "role || ':' || text || chr(10)"))


def _deleted(state: str) -> str:
    return _add(state, "3", "D", "''")


OP12_SQL = f"""
WITH RECURSIVE raw AS (
  SELECT coalesce('=' || conv_id::varchar, '-') AS key, conv_id, turn, coalesce(role, ' ') AS role,
         coalesce(text, ' ') AS text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') AS k
  FROM conversations),
kinds AS (SELECT k, {crc32_sql("k")} % 20 AS kind FROM (SELECT DISTINCT k FROM raw)),
harmed AS (
  SELECT key, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM raw JOIN kinds USING (k) WHERE kind <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64),
                               sha256(length(role)::varchar || ':' || role || text), copy) AS i FROM harmed),
judged AS (
  SELECT *, left(role, 1) AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS seen,
         row_number() OVER (PARTITION BY key, role, text ORDER BY i) AS nth,
         lag(left(role, 1)) OVER (PARTITION BY key ORDER BY i) AS before
  FROM placed),
turns AS (
  SELECT key, i, turn, role, text, initial, before,
         CASE WHEN seen = '' THEN 2 WHEN nth > 1 THEN 3 WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 1 ELSE 0 END AS status
  FROM judged),
steps AS (SELECT *, CASE WHEN status = 1 THEN 1 ELSE 0 END AS extra FROM turns),
walk AS (
  SELECT key, 0::bigint AS i, struct_pack(c := 0::bigint, e := '', t := '') AS s0, far AS s1, far AS u, far AS a, far
  FROM (SELECT DISTINCT key, struct_pack(c := {FAR}::bigint, e := '', t := '') AS far FROM turns)
  UNION ALL
  SELECT key, i, {_deleted("s0")},
         least({_deleted("s1")}, {_kept("s0", "s")}),
         least({_deleted("u")}, {_kept("s0", "u")}, {_kept("s1", "u")}, {_kept("a", "u")},
               {_reroled("s0", "user")}, {_reroled("s1", "user")}, {_reroled("a", "user")}),
         least({_deleted("a")}, {_kept("u", "a")}, {_reroled("u", "assistant")}), far
  FROM (
    SELECT closed.key, steps.i, s0, s1, u, least(a, {_add("u", "2", "I", _ASSISTANT)}) AS a, far,
           role, text, initial, status, extra
    FROM (SELECT key, i, s0, s1, {_U1} AS u, a, far FROM walk) closed
    JOIN steps ON steps.key = closed.key AND steps.i = closed.i + 1)),
ends AS (
  SELECT key, least(s0, a, {_add("u", "2", "I", _ASSISTANT)}, {_add(_add("s1", "2", "I", _USER), "2", "I", _ASSISTANT)}) AS best
  FROM walk JOIN (SELECT key, max(i) AS i FROM turns GROUP BY key) USING (key, i)),
counts AS (
  SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (WHERE status = 2) AS blank, count(*) FILTER (WHERE status = 3) AS duplicate,
         count(*) FILTER (WHERE status = 1) AS truncated,
         count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM turns GROUP BY key)
SELECT conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank,
       coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated,
       coalesce(illegal, 0)::bigint AS illegal, coalesce(best.c, 0)::bigint AS cost, coalesce(best.e, '') AS audit,
       sha256(coalesce(left(best.t, greatest(length(best.t) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT key, conv_id FROM raw) LEFT JOIN counts USING (key) LEFT JOIN ends USING (key)
"""
