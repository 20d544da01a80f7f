"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from pulsefield.llm.quality_rules import STOP_WORDS

WORD = r"[^\x20\x09-\x0D]+"

_LISTED = ", ".join("'" + w.replace("'", "''") + "'" for s in STOP_WORDS for w in dict.fromkeys((s, s.capitalize())))

OP8 = rf"""
WITH t AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '{WORD}') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls
  FROM t
), wins AS (
  SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS win
  FROM w, unnest(range(1, len(ws) - 6)) AS u(i)
), dup AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1
), reach AS (
  SELECT rid, least(8, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 8)) AS n FROM dup
), rep AS (
  SELECT rid, sum(n)::BIGINT AS n_repeat_words FROM reach GROUP BY rid
), m AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words,
         length(array_to_string(ws, ''))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
         len(ls)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: x IN ({_LISTED})))::BIGINT AS n_stop_words,
         len(regexp_extract_all(text, '\p{{Lu}}{{2,}}'))::BIGINT AS n_shouted
  FROM w LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
)
SELECT *, NOT base_failed AND word_chars BETWEEN 2 * n_words AND 14 * n_words
  AND n_symbols / nullif(n_words, 0)::DOUBLE <= 0.25 AND n_stop_words / nullif(n_words, 0)::DOUBLE >= 0.03
  AND coalesce(n_dup_lines / nullif(n_lines, 0)::DOUBLE <= 0.5, true)
  AND n_shouted / nullif(n_words, 0)::DOUBLE <= 0.3 AS kept
FROM b
"""

OP4 = rf"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size, md5(concat_ws('/', doc_id::VARCHAR, md5(text))) AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place, (2 * source_size)::DOUBLE AS cap FROM s
), v AS (
  SELECT *, CASE place % 3 WHEN 0 THEN 3e0 WHEN 1 THEN 1e0 ELSE 2e0 END AS weight FROM w
), l AS (
  SELECT *, (1.5e0 * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM v
), t AS (
  SELECT source, source_size, place,
    CASE WHEN cap < weight * level THEN cap
      ELSE weight * (SELECT arg_min(level, struct_pack(r := cap / weight, p := place)) FROM l WHERE cap >= weight * level) END AS target FROM l
), q AS (
  SELECT *, floor(target + 0.5)::BIGINT AS quota, ceil(floor(target + 0.5) / 16384)::BIGINT AS blocks FROM t
), e AS (
  SELECT *, sum(blocks) OVER (ORDER BY place) / (SELECT sum(blocks) FROM q)::DOUBLE AS upto FROM q
), slots AS (
  SELECT i AS slot, (i % 2147483648 * 1327217885 % 2147483648) / 2147483648e0 AS u FROM range((SELECT 3 * sum(blocks)::BIGINT + 3 FROM q)) r(i)
), dealt AS (
  SELECT slot, least((SELECT count(*) FROM e WHERE upto <= u), (SELECT max(place) FROM e)) AS place FROM slots
), ranked AS (
  SELECT slot, place, row_number() OVER (PARTITION BY place ORDER BY slot) - 1 AS block FROM dealt
), p AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d
), k AS (
  SELECT doc_id, size, source_size, target, start, place,
    (greatest(0, least(start + size, quota) - start) + greatest(0, least(start + source_size + size, quota) - start - source_size))::BIGINT AS taken
  FROM p JOIN q ON p.source IS NOT DISTINCT FROM q.source
)
SELECT doc_id, size, source_size, target, taken, slot AS first_slot
FROM k LEFT JOIN ranked ON taken > 0 AND ranked.place = k.place AND ranked.block = start // 16384
"""

OP13 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST)
"""

#: crc32 of the ASCII characters of a decimal number, bit by bit.
CRC32 = """xor(list_reduce(flatten(list_transform(string_split({}::VARCHAR, ''), lambda ch: [ascii(ch), -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda crc, b: CASE WHEN b >= 0 THEN xor(crc, b) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END, 4294967295::BIGINT), 4294967295)"""

OP12 = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS src, {CRC32.format('conv_id')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.src AND pos < h
  UNION ALL SELECT ids.conv_id, pos, role, text FROM ids JOIN t ON t.conv_id = ids.conv_id AND pos >= h
), lists AS (
  SELECT ids.conv_id, coalesce(list(md5(md5(role) || md5(text)) || ':' || octet_length(encode(text)) ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS l FROM ids LEFT JOIN r USING (conv_id) GROUP BY 1
), p AS (
  SELECT conv_id, d, array_to_string(l[1:d], ' ') AS node, array_to_string(l[1:d - 1], ' ') AS parent, d = len(l) AS last,
    CASE WHEN d > 0 THEN string_split(l[d], ':')[2]::BIGINT ELSE 0 END AS bytes FROM lists, unnest(range(len(l) + 1)) u(d)
), n AS (
  SELECT node, d, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256 FROM p GROUP BY ALL
), c AS (
  SELECT parent, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL
), own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.parent = n.node AND c.d = n.d
), above AS (
  SELECT own.*, u.k, CASE WHEN u.k = 0 THEN '' ELSE array_to_string(string_split(node, ' ')[1:u.k], ' ') END AS top FROM own, unnest(range(d + 1)) u(k)
), sums AS (
  SELECT top, k, sum((n_children = 0)::BIGINT)::BIGINT AS n_leaves, sum((n_convs - 1) * bytes)::BIGINT AS saved_tokens FROM above GROUP BY ALL
)
SELECT own.conv_id, own.d AS depth, CASE WHEN own.d > 0 THEN o.conv_id END AS parent_conv_id, own.n_convs, own.n_children, n_leaves, saved_tokens, own.ends_sha256
FROM own JOIN sums ON top = own.node AND k = own.d LEFT JOIN own o ON o.node = own.parent AND o.d = own.d - 1
"""

_SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
#: For each state of the role pattern (nothing yet, after s, after u, after a): what a kept initial leads to, and what an inserted row does.
_KEPT, _NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (2, 2, 3, 2)
_edit = lambda cost, edit, at: f"struct_pack(c := {cost} + {at}.c, a := '{edit}' || {at}.a)"


def _best_of_row(state: int) -> str:
    """The least (cost, audit) from a row on, without an insert before it; the list v has what comes after the row."""
    kept = " ".join(f"WHEN NOT x.gone AND x.i = '{i}' THEN {_edit('x.cut', 'K', f'acc.v[{to + 1}]')}" for i, to in _KEPT[state].items())
    return f"list_min([{_edit('3', 'D', f'acc.v[{state + 1}]')}, CASE WHEN NOT x.gone THEN {_edit('2 + x.cut', 'R', f'acc.v[{_NEXT[state] + 1}]')} END, CASE {kept} END])"


_rows = ", ".join(_best_of_row(k) for k in range(4))
_inserts = ", ".join(f"list_min([w[{k + 1}], {_edit('2', 'I', f'w[{_NEXT[k] + 1}]')}, {_edit('4', 'II', f'w[{_NEXT[_NEXT[k]] + 1}]')}])" for k in range(4))

OP11 = f"""
WITH k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS kind FROM conversations
), r AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) u(copy) WHERE kind <> 0)
), f AS (
  SELECT *, left(role, 1) AS ini, right(rtrim(text, {_SPACES}), 1) AS fin, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again FROM r
), g AS (
  SELECT *, CASE WHEN fin = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN fin NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, ini || lead(ini) OVER (PARTITION BY conv_id ORDER BY pos) AS pair FROM f
), c AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list(struct_pack(i := ini, gone := fault IN ('blank', 'duplicate') AND fault IS NOT NULL, cut := coalesce((fault = 'truncated')::INT, 0), v := NULL::STRUCT(c INT, a VARCHAR)[]) ORDER BY pos DESC) AS l FROM g GROUP BY conv_id
), best AS (
  SELECT * EXCLUDE (l), list_reduce(l, lambda acc, x: struct_pack(i := '', gone := false, cut := 0, v := list_transform([[{_rows}]], lambda w: [{_inserts}])[1]),
    struct_pack(i := '', gone := false, cut := 0, v := [struct_pack(c := 0, a := ''), struct_pack(c := 4, a := 'II'), struct_pack(c := 2, a := 'I'), struct_pack(c := 0, a := '')])).v[1] AS b FROM c
), e AS (
  SELECT conv_id, p, substr(b.a, p::INT, 1) AS ch, count(*) FILTER (WHERE substr(b.a, p::INT, 1) <> 'I') OVER (PARTITION BY conv_id ORDER BY p) AS pos FROM best, unnest(range(1, length(b.a) + 1)) u(p)
), o AS (
  SELECT e.conv_id, p, ch, r.role, CASE WHEN ch = 'I' THEN '' ELSE r.text END AS text, row_number() OVER w AS idx, first_value((ch = 'K' AND left(r.role, 1) = 's')::INT) OVER w AS has_s
  FROM e LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM e.conv_id AND r.pos = e.pos AND ch <> 'I' WHERE ch <> 'D' WINDOW w AS (PARTITION BY e.conv_id ORDER BY p)
), h AS (
  SELECT conv_id, sha256(string_agg(CASE WHEN ch = 'K' THEN role WHEN (idx - 1 - has_s) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY p)) AS sha FROM o GROUP BY 1
)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""

ORACLES: dict[str, str] = {"op11_conversation_repair": OP11, "op12_conversation_prefix_trie": OP12, "op13_exact_dedup": OP13, "op4_mixing_sources": OP4, "op8_quality_rules": OP8}
