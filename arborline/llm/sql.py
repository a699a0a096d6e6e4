"""DuckDB SQL for the corpus queries, where SQL can express them; each goes its own way over whole tables."""

from __future__ import annotations

_UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORD = r"'[^\x20\x09-\x0D]+'"

OP1 = rf"""WITH s AS (SELECT *, row_number() OVER (PARTITION BY source, draw) - 1 AS j FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size, ('0x'||substr(md5(coalesce(doc_id::VARCHAR, '') || chr(10) || coalesce(text, '')), 1, 13))::BIGINT AS draw FROM documents)),
src AS (SELECT source, sum(size)::BIGINT AS source_size, sum(sum(size)) OVER ()::BIGINT AS total, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM s GROUP BY source),
f AS (SELECT *, row_number() OVER o AS nth, (total - 3*coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level
  FROM src WINDOW o AS (ORDER BY source_size::DOUBLE/w, source NULLS LAST)),
t AS (SELECT source, source_size, CASE WHEN 3*source_size <= level*w OR common IS NULL THEN (3*source_size)::DOUBLE ELSE common*w END AS target
  FROM (SELECT *, (SELECT arg_min(level, nth) FROM f WHERE 3*source_size > level*w) AS common FROM f)),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target/source_size)::BIGINT ELSE 0 END AS copies FROM t),
g AS (SELECT source, draw, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM s GROUP BY 1, 2)
SELECT s.doc_id, s.size, c.source_size, c.target, (s.size * (copies + CASE WHEN g.before + s.j*s.size + s.size/2.0::DOUBLE <= target - copies*source_size THEN 1 ELSE 0 END))::BIGINT AS taken
FROM s JOIN c ON s.source IS NOT DISTINCT FROM c.source JOIN g ON g.source IS NOT DISTINCT FROM s.source AND g.draw = s.draw"""

OP2 = r"""WITH t AS (SELECT conv_id, turn, role AS author, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text) - 1 AS seq FROM conversations),
sp AS (SELECT DISTINCT conv_id, author AS speaker FROM t WHERE author IS DISTINCT FROM 'system'),
x AS (SELECT t.*, speaker, regexp_replace(author, '<(\\*)\|', '<\1\\|', 'g') AS name, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS said, author IS NOT DISTINCT FROM speaker AS own FROM t JOIN sp ON t.conv_id IS NOT DISTINCT FROM sp.conv_id),
y AS (SELECT *, CASE WHEN author = 'system' THEN author WHEN own THEN 'assistant' ELSE 'user' END AS role FROM x),
z AS (SELECT *, '<|' || role || CASE WHEN role = 'user' AND author IS NOT NULL THEN ' name=' || name ELSE '' END || '|>' || chr(10) AS head FROM y),
q AS (SELECT *, head || said || '<|end|>' || chr(10) AS piece FROM z),
p AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY conv_id, speaker ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM q)
SELECT conv_id, speaker, seq, turn, role, author AS name, piece, start, (start + length(piece))::BIGINT AS "end",
  CASE WHEN own THEN (start + length(head))::BIGINT END AS loss_start, CASE WHEN own THEN (start + length(head) + length(said))::BIGINT END AS loss_end FROM p"""

OP4 = """WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT id, p, md5(substr(h, 2*p+1, 400)) AS w FROM (SELECT id, h, unnest(range(length(h)//2 - 199)) AS p FROM d)),
rep AS (SELECT id, p FROM w WHERE w IN (SELECT w FROM w GROUP BY w HAVING count(*) > 1)),
isl AS (SELECT id, p, sum(CASE WHEN prev IS NULL OR p > prev + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY p) AS n FROM (SELECT id, p, lag(p) OVER (PARTITION BY id ORDER BY p) AS prev FROM rep)),
sp AS (SELECT id, min(p) AS a, max(p) + 200 AS b FROM isl GROUP BY id, n),
st AS (SELECT id, sum(b - a)::BIGINT AS removed, count(*) AS spans FROM sp GROUP BY id),
cut AS (SELECT id, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS f, a AS t FROM sp UNION ALL SELECT id, max(b), 2000000000 FROM sp GROUP BY id),
kept AS (SELECT cut.id, string_agg(substr(h, 2*f+1, 2*(t-f)), '' ORDER BY f) AS h FROM cut JOIN d ON d.id = cut.id GROUP BY cut.id)
SELECT doc_id, (length(d.h)//2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept.h, d.h))) AS kept_sha256
FROM d LEFT JOIN st ON st.id = d.id LEFT JOIN kept ON kept.id = d.id"""

OP5 = rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_UPPER}), {_WORD}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 4 THEN array_to_string(w[i:i+3], ' ') ELSE array_to_string(w, ' ') END AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100*c >= 80*(x.n + y.n - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m AS component_id, d.doc_id = m AS kept FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS m FROM r GROUP BY 1) ON node = d.doc_id"""


def _covered(k: int, name: str) -> str:
    """Words that lie in a window of k words that occurs again in the text."""
    return f"""{name}w AS (SELECT id, i, count(*) OVER (PARTITION BY id, g) AS c FROM (SELECT id, i, array_to_string(w[i:i+{k - 1}], ' ') AS g FROM (SELECT id, w, unnest(range(1, len(w) - {k - 2})) AS i FROM d))),
{name} AS (SELECT id, count(DISTINCT p) AS n FROM (SELECT id, unnest(range(i, i+{k})) AS p FROM {name}w WHERE c > 1) GROUP BY 1)"""


OP7 = rf"""WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
{_covered(5, 'short')},
{_covered(3, 'long')},
{_covered(21, 'far')},
lines AS (SELECT id, count(*) - count(DISTINCT x) AS n FROM (SELECT id, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, {_WORD}) GROUP BY 1),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
  coalesce(short.n, 0)::BIGINT AS n_repeat_words, coalesce(long.n, 0) AS lw, far.n IS NOT NULL AS far FROM d LEFT JOIN short USING (id) LEFT JOIN long USING (id) LEFT JOIN far USING (id) LEFT JOIN lines USING (id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100*n_repeat_words > 20*n_words) AS base_failed,
  NOT (n_words < 10 OR 100*n_repeat_words > 20*n_words) AND 100*lw <= 20*n_words AND NOT far AS kept FROM m"""

OP9 = """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
u AS (SELECT vec_id, label, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.n > 0 AND b.n > 0 AND list_dot_product(a.x, b.x)/a.n/b.n >= 0.93::DOUBLE),
r(node, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen)
SELECT v.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, m::BIGINT AS component_id, v.vec_id = m AS kept FROM v JOIN (SELECT node, min(seen) AS m FROM r GROUP BY 1) ON node = v.vec_id
LEFT JOIN (SELECT a, count(*) AS n FROM e GROUP BY 1) k ON k.a = v.vec_id"""

SQL = {"op1_mixing": OP1, "op2_chat": OP2, "op4_repeats": OP4, "op5_nearset": OP5, "op7_quality": OP7, "op9_vectors": OP9}
