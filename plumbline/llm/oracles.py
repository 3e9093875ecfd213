"""DuckDB SQL for the queries that SQL can express, written without the operators.

Not here: the classifier's and the trees' fits, tokenizers, packing, the scan's merged notices and the minimax cuts;
tests hold these against plain versions.
"""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

OP2 = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
g AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS said,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '') AS loss,
  sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\\\*\\|'))) AS chars, string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text) AS roles FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars,
  regexp_full_match(roles, '(system,)?user(,assistant,user)*(,assistant)?') AS valid FROM g
"""

MEASURES = ("symbol_bp", "dup_line_bp", "repeat_bp", "word_len_c")
OP4 = f"""
WITH w AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, {WORDS} AS ws FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM (SELECT doc_id, i, list_slice(ws, i, i + 4) AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w) x) y),
r AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM g WHERE c > 1) x GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS lines, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) x WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
b AS (SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  coalesce(dups, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(lines, 0) AS lines FROM w LEFT JOIN r ON w.doc_id = r.doc_id LEFT JOIN l ON w.doc_id = l.doc_id),
m AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, CASE WHEN word_chars > 0 THEN 10000 * n_symbols // word_chars ELSE 0 END AS symbol_bp, CASE WHEN lines > 0 THEN 10000 * n_dup_lines // lines ELSE 0 END AS dup_line_bp,
  CASE WHEN n_words > 0 THEN 10000 * n_repeat_words // n_words ELSE 0 END AS repeat_bp, CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END AS word_len_c FROM b),
u AS (SELECT lang, source, unnest({list(MEASURES)}) AS measure, unnest([{', '.join(MEASURES)}]) AS x FROM m WHERE n_words > 0),
v AS (SELECT lang, source, measure, CASE WHEN x < 64 THEN x ELSE (x >> (length(bin(x)) - 6)) << (length(bin(x)) - 6) END AS x FROM u),
q AS (SELECT lang, source, measure, n, x, count(*) OVER (PARTITION BY level, lang, source, measure ORDER BY x RANGE UNBOUNDED PRECEDING) AS upto, level FROM (
  SELECT *, count(*) OVER (PARTITION BY level, lang, source, measure) AS n FROM (SELECT 0 AS level, lang, source, measure, x FROM v UNION ALL SELECT 1, lang, NULL, measure, x FROM v UNION ALL SELECT 2, NULL, NULL, measure, x FROM v) a) c),
s AS (SELECT level, lang, source, measure, any_value(n) AS n, min(x) FILTER (WHERE upto * 4 >= n) AS q1, min(x) FILTER (WHERE upto * 4 >= n * 3) AS q3 FROM q GROUP BY level, lang, source, measure),
f AS (SELECT o.lang, o.source, o.measure, CASE WHEN o.n >= 200 THEN o.q1 WHEN a.n >= 200 THEN a.q1 ELSE z.q1 END AS q1, CASE WHEN o.n >= 200 THEN o.q3 WHEN a.n >= 200 THEN a.q3 ELSE z.q3 END AS q3
  FROM s o JOIN s a ON a.level = 1 AND a.lang = o.lang AND a.measure = o.measure JOIN s z ON z.level = 2 AND z.measure = o.measure WHERE o.level = 0),
bad AS (SELECT DISTINCT m.doc_id FROM m JOIN f ON m.lang = f.lang AND m.source = f.source WHERE (measure = 'symbol_bp' AND symbol_bp > 4 * q3 - 3 * q1 + 300) OR (measure = 'dup_line_bp' AND dup_line_bp > 4 * q3 - 3 * q1 + 2000)
  OR (measure = 'repeat_bp' AND repeat_bp > 4 * q3 - 3 * q1 + 1000) OR (measure = 'word_len_c' AND (word_len_c > 4 * q3 - 3 * q1 + 150 OR word_len_c < 4 * q1 - 3 * q3 - 150)))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m
"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS i FROM w WHERE len(ws) > 0) x) y),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (SELECT a, b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2) p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
two AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON d.doc_id = c.a
"""

OP8 = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS norm FROM e WHERE label IS NOT NULL),
two AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, two.b FROM reach JOIN two ON reach.b = two.a)
SELECT vec_id, (SELECT count(*) FROM two WHERE two.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON vec_id = c.a
"""

OP11 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id) AS h FROM documents),
u AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, form, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

OP12 = f"""
WITH RECURSIVE bit AS (SELECT k, 0 AS step, k AS c FROM range(256) r(k) UNION ALL SELECT k, step + 1, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bit WHERE step < 8),
tab AS (SELECT list(c ORDER BY k) AS tab FROM bit WHERE step = 8),
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents) x WHERE length(run) >= 7 GROUP BY 1, 2),
b AS (SELECT run, n, list_prepend(4294967295::BIGINT, list_transform(range(1, length(x), 2), lambda i: ('0x' || substr(x, i, 2))::BIGINT)) AS bytes FROM (SELECT run, n, hex(encode(doc_id || ':' || run)) AS x FROM r) y),
h AS (SELECT run, n, xor(list_reduce(bytes, lambda a, c: xor(a >> 8, tab[1 + xor(a & 255, c)])), 4294967295) AS h FROM b, tab),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) x),
s AS (SELECT word, n, substr(word, 1, i - 1) || chr(0) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v) x),
one AS (SELECT a.word AS a, b.word AS b, b.n FROM s a JOIN s b ON a.rest = b.rest AND a.word <> b.word UNION ALL SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.rest UNION ALL SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.rest),
m AS (SELECT a, count(*) AS n_near, min({{'n': -n, 'word': b}}) AS best FROM one GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 10 * n THEN best.word END AS form, CASE WHEN -best.n >= 10 * n THEN -best.n END AS form_n FROM v LEFT JOIN m ON a = word),
go AS (SELECT word, word AS at, form AS onward FROM f UNION ALL SELECT go.word, f.word, f.form FROM go JOIN f ON f.word = go.onward)
SELECT f.word, f.form, go.at AS root, f.n, f.n_near, f.form_n FROM f JOIN go ON go.word = f.word AND go.onward IS NULL
"""

ORACLES: dict[str, str] = {"op2_chat_format": OP2, "op4_quality_rules": OP4, "op6_near_dedup": OP6, "op8_vector_dedup": OP8, "op11_fill_in_middle": OP11, "op12_spelling_variants": OP12}
