"""DuckDB statements for the operators that SQL can express on whole tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[x for x in string_split_regex({}, '[\x20\x09-\x0D]+') if x <> '']"

SQL: dict[str, str] = {}

SQL["op1_cross_entropy_difference"] = rf"""
WITH d AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS t,
                  list_concat([NULL], {_WORDS.format("coalesce(text, '')")}, ['</s> ']) AS w FROM documents),
tok AS (SELECT doc_id, t, coalesce(w[i], '</s> ') AS v, w[i + 1] AS x, w[i] IS NULL AS head FROM d, unnest(range(1, len(w))) AS r(i)),
uni AS (SELECT x, sum(t::INT)::DOUBLE AS ct, sum((NOT t)::INT)::DOUBLE AS cb FROM tok GROUP BY x),
bi AS (SELECT head, v, x, sum(t::INT)::DOUBLE AS ct, sum((NOT t)::INT)::DOUBLE AS cb FROM tok GROUP BY head, v, x),
n AS (SELECT sum(ct) AS nt, sum(cb) AS nb FROM uni),
p AS (SELECT bi.head, bi.v, bi.x,
        log2((bi.ct + 20.0::DOUBLE * ((u.ct + 1000.0::DOUBLE * ((u.ct + u.cb) / (nt + nb))) / (nt + 1000.0::DOUBLE))) / (c.ct + 20.0::DOUBLE)) AS lt,
        log2((bi.cb + 20.0::DOUBLE * ((u.cb + 1000.0::DOUBLE * ((u.ct + u.cb) / (nt + nb))) / (nb + 1000.0::DOUBLE))) / (c.cb + 20.0::DOUBLE)) AS lb
      FROM bi JOIN uni u ON u.x = bi.x JOIN uni c ON c.x = bi.v CROSS JOIN n)
SELECT doc_id, count(*)::BIGINT AS n_tokens, round(-avg(lt), 6) AS ce_target, round(-avg(lb), 6) AS ce_background, round(avg(lb) - avg(lt), 6) AS score
FROM tok JOIN p USING (head, v, x) GROUP BY doc_id
"""

SQL["op3_suffix_tree"] = rf"""
WITH t AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, hash(w[i : i + 34]) AS h FROM t, unnest(range(1, len(w) - 33)) AS r(i)),
rep AS (SELECT doc_id, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM rep),
word AS (SELECT doc_id, p, w[p] AS x FROM t, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, len(t.w)::BIGINT AS n_words, (len(t.w) - coalesce(kept.n, 0))::BIGINT AS n_removed,
       sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

SQL["op7_minhash_containment"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(_LOWER)} AS w FROM benchmark),
item AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
         FROM (SELECT *, least(5, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS r(i)),
doc AS (SELECT DISTINCT doc_id, n, array_to_string(w[i : i + n - 1], ' ') AS s
        FROM d, (SELECT DISTINCT n FROM item), unnest(range(1, len(w) - n + 2)) AS r(i)),
size AS (SELECT item_id, count(*) AS q FROM item GROUP BY item_id)
SELECT doc_id, item_id, any_value(q)::BIGINT AS n_shingles, count(*)::BIGINT AS n_found, count(*) / any_value(q) AS containment
FROM doc JOIN item USING (n, s) JOIN size USING (item_id)
GROUP BY doc_id, item_id HAVING count(*) / any_value(q) >= 0.8
"""

SQL["op8_curriculum_mix"] = r"""
WITH t AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS k FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM t GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS sid FROM s0),
s2 AS (SELECT *, [5, 2, 1][sid % 3 + 1] AS weight, [1.5, 1.0, 0.5][sid % 3 + 1]::DOUBLE AS r FROM s1),
s3 AS (SELECT *, ((sum(source_size) OVER ()
                  - coalesce(sum(3 * source_size) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                 / (sum(weight) OVER (ORDER BY 3.0::DOUBLE * source_size / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE) AS level FROM s2),
s4 AS (SELECT *, least((3 * source_size)::DOUBLE, max(level) OVER () * weight) AS target, sum(source_size) OVER () AS words FROM s3),
u AS (SELECT t.*, source_size, target, r, words,
             (CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END)::INT AS passes,
             sum(size) OVER (PARTITION BY t.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT - size / 2 AS middle
      FROM t JOIN s4 ON t.source IS NOT DISTINCT FROM s4.source),
v AS (SELECT *, passes + CASE WHEN middle < target - passes * source_size THEN 1 ELSE 0 END AS copies,
             least(middle / target, 1.0::DOUBLE) AS x FROM u)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken, copies::INT AS copies,
       CASE WHEN copies > 0 THEN 2 * x / (r + sqrt(r * r + 4 * (1 - r) * x)) * words::DOUBLE END AS position
FROM v
"""

SQL["op9_lsh_forest"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS x
      FROM d, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(i)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b USING (x) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT u, v FROM p JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT reach.doc_id, v FROM reach JOIN link ON link.u = reach.other)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN reach ON reach.doc_id = d.doc_id GROUP BY d.doc_id
"""

_CONTROLS = r"<\|endoftext\|>|<\|startoftext\|>|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|im_start\|>|<\|im_end\|>"
_ESCAPED = "length({x}) + length({x}) - length(replace({x}, chr(92), '')) + 2 * len(regexp_extract_all({x}, '" + _CONTROLS + "'))"
SQL["op10_chat_masks"] = rf"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS learned,
             sum({_ESCAPED.format(x='role')} + {_ESCAPED.format(x='text')}) AS chars
      FROM t GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(said) AS turns_sha256, length(learned)::BIGINT AS loss_chars, sha256(learned) AS loss_sha256,
       (chars + 13 * (2 * n_turns + 1))::BIGINT AS formatted_chars
FROM g
"""

_CRC32 = ("xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(c)::BIGINT for c in string_split({x}, '')]), "
          "lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, z: xor(r >> 1, (r & 1) * 3988292384))))")
SQL["op11_checkpoint_repair"] = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
f AS (SELECT *, {_CRC32.format(x='k')} % 20 AS fault FROM src),
d AS (SELECT conv_id, turn, CASE fault WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM f, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS r(copy)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
             rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM d),
w AS (SELECT *, said = '' AS blank, said <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
             left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM o),
rows_ AS (SELECT *, blank OR again AS gone, NOT blank AND NOT again AND right(said, 1) NOT IN ('.', '!', '?') AS cut FROM w),
ins(st, via, letters, price) AS (VALUES ('e', 'e', '', 0), ('e', 'u', 'I', 3), ('e', 'a', 'II', 6), ('s', 's', '', 0), ('s', 'u', 'I', 3), ('s', 'a', 'II', 6),
                                        ('u', 'u', '', 0), ('u', 'a', 'I', 3), ('a', 'a', '', 0), ('a', 'u', 'I', 3)),
op(via, c, letter, st2, price) AS (VALUES ('e', 's', 'K', 's', 0), ('e', 'u', 'K', 'u', 0), ('s', 'u', 'K', 'u', 0), ('a', 'u', 'K', 'u', 0), ('u', 'a', 'K', 'a', 0),
                                          ('e', NULL, 'R', 'u', 3), ('s', NULL, 'R', 'u', 3), ('a', NULL, 'R', 'u', 3), ('u', NULL, 'R', 'a', 3),
                                          ('e', NULL, 'D', 'e', 4), ('s', NULL, 'D', 's', 4), ('u', NULL, 'D', 'u', 4), ('a', NULL, 'D', 'a', 4)),
convs AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0::BIGINT AS i, 'e' AS st, {{'cost': 0::BIGINT, 'audit': ''}} AS best FROM convs
       UNION ALL
       SELECT dp.conv_id, r.i, op.st2, min({{'cost': (best.cost + ins.price + op.price + CASE WHEN cut AND letter <> 'D' THEN 3 ELSE 0 END)::BIGINT,
                                             'audit': best.audit || ins.letters || op.letter}})
       FROM dp JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM dp.conv_id AND r.i = dp.i + 1
       JOIN ins ON ins.st = dp.st JOIN op ON op.via = ins.via AND (op.c IS NULL OR op.c = r.c) AND (op.letter = 'D' OR NOT r.gone)
       GROUP BY dp.conv_id, r.i, op.st2),
n AS (SELECT conv_id, max(i) AS n FROM dp GROUP BY conv_id),
e AS (SELECT dp.conv_id, min({{'cost': best.cost + ins.price, 'audit': best.audit || ins.letters}}) AS best
      FROM dp JOIN n ON n.conv_id IS NOT DISTINCT FROM dp.conv_id AND n.n = dp.i JOIN ins ON ins.st = dp.st AND ins.via IN ('e', 'a') GROUP BY dp.conv_id),
l AS (SELECT conv_id, p, best.audit[p] AS x, sum(CASE WHEN best.audit[p] = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) AS i
      FROM e, unnest(range(1, length(best.audit) + 1)) AS r(p)),
k AS (SELECT l.conv_id, p, x, role, text, c, row_number() OVER (PARTITION BY l.conv_id ORDER BY p) AS q
      FROM l LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.x <> 'I' WHERE x <> 'D'),
m AS (SELECT *, q - max(CASE WHEN q = 1 AND x = 'K' AND c = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS place FROM k),
out_ AS (SELECT conv_id, string_agg(CASE WHEN x = 'K' THEN role WHEN place % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN x = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS said
         FROM m GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank, sum(again::INT) AS duplicate,
                  sum(cut::INT) AS truncated, sum((c0 IS NOT NULL AND c0 || c NOT IN ('su', 'ua', 'au'))::INT) AS illegal FROM rows_ GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(coalesce(said, '')) AS repaired_sha256
FROM e LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN out_ ON out_.conv_id IS NOT DISTINCT FROM e.conv_id
"""
