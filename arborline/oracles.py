"""DuckDB SQL for the tree queries: recursion over merge steps, windows for edges, a closure table for ancestors."""

from __future__ import annotations

_KEYS = """ord AS (SELECT o_custkey AS tree_id, o_orderkey AS ok, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS i FROM orders)"""


def _vv(x: str = "(ok*7919 + i*104729 + 17) % (2*i+1)") -> str:
    return f"""vv AS (SELECT tree_id, i, ok, CAST({x} AS BIGINT) AS x, ((ok*31+7)%97+1)/100.0::DOUBLE AS b1, ((ok*17+3)%89+1)/100.0::DOUBLE AS b2 FROM ord)"""


def _supplier(ordered: bool = False) -> str:
    m = "(i+1)" if ordered else "(2*i+1)"
    return f"""vv AS (SELECT s_suppkey AS tree_id, i, CAST((((s_suppkey+1)*(i*7919+31))%1000003*613 + i*104729) % {m} AS BIGINT) AS x, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2
  FROM supplier, (SELECT unnest(range(9)) AS i))"""


# pairs by recursion over the places of v, edges by the last row a label was in
_TREE = """kk AS (SELECT tree_id, count(*) AS k FROM vv GROUP BY 1),
p(tree_id, i, c1, c2) AS (
  SELECT tree_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM kk
  UNION ALL
  SELECT p.tree_id, p.i+1, CASE WHEN x<=p.i THEN [x]||c1 ELSE c1[1:(x-p.i)]||[c1[x-p.i]]||c1[(x-p.i+1):] END,
    CASE WHEN x<=p.i THEN [p.i+1]||c2 ELSE c2[1:(x-p.i)]||[p.i+1]||c2[(x-p.i+1):] END
  FROM p JOIN vv ON vv.tree_id=p.tree_id AND vv.i=p.i),
pr AS (SELECT p.tree_id, k, unnest(range(k)) AS r, unnest(c1) AS c1, unnest(c2) AS c2 FROM p JOIN kk ON p.tree_id=kk.tree_id AND p.i=k),
lab AS (SELECT tree_id, k, r, 0 AS side, c1 AS l FROM pr UNION ALL SELECT tree_id, k, r, 1, c2 FROM pr),
ed AS (SELECT tree_id, k, r, side, coalesce(lag(k+1+r) OVER (PARTITION BY tree_id, l ORDER BY r), l) AS child, k+1+r AS parent FROM lab),
an AS (SELECT tree_id, k, r, max(CASE WHEN side=0 THEN child END) AS c1, max(CASE WHEN side=1 THEN child END) AS c2, max(parent) AS p FROM ed GROUP BY 1,2,3)"""

_CLOSURE = """edl AS (SELECT ed.*, CASE WHEN side=0 THEN b1 ELSE b2 END AS bl FROM ed JOIN vv ON vv.tree_id=ed.tree_id AND vv.i=ed.r),
up(tree_id, k, node, anc, d, dl) AS (
  SELECT tree_id, k, unnest(range(2*k+1)), unnest(range(2*k+1)), 0, 0.0::DOUBLE FROM kk
  UNION ALL
  SELECT up.tree_id, up.k, up.node, e.parent, up.d+1, up.dl+e.bl FROM up JOIN edl e ON e.tree_id=up.tree_id AND e.child=up.anc),
dep AS (SELECT tree_id, k, node, max(d) AS d, max(dl) AS dl FROM up WHERE anc=2*k GROUP BY 1,2,3)"""

_MRCA = """mr AS (SELECT a.tree_id, a.k, a.node AS l, b.node AS r, min(a.anc) AS m FROM up a JOIN up b ON a.tree_id=b.tree_id AND a.anc=b.anc AND a.node<=a.k AND b.node<=b.k GROUP BY 1,2,3,4),
md AS (SELECT mr.*, dl.d AS ld, dl.dl AS ldl, dr.d AS rd, dr.dl AS rdl, dm.d AS md, dm.dl AS mdl, t.bl AS top
  FROM mr JOIN dep dl ON dl.tree_id=mr.tree_id AND dl.node=mr.l JOIN dep dr ON dr.tree_id=mr.tree_id AND dr.node=mr.r
  JOIN dep dm ON dm.tree_id=mr.tree_id AND dm.node=mr.m LEFT JOIN edl t ON t.tree_id=mr.tree_id AND t.child=2*mr.k-1 AND t.parent=2*mr.k)"""

_NEWICK = """txt(tree_id, r, c, cb) AS (
  SELECT tree_id, 0::BIGINT, list_transform(range(k+1), lambda z: z::VARCHAR), list_transform(range(k+1), lambda z: z::VARCHAR) FROM kk
  UNION ALL
  SELECT t.tree_id, t.r+1, t.c[:pr.c1]||['('||t.c[pr.c1+1]||','||t.c[pr.c2+1]||')'||(pr.k+1+pr.r)]||t.c[pr.c1+2:],
    t.cb[:pr.c1]||['('||t.cb[pr.c1+1]||':'||vv.b1::VARCHAR||','||t.cb[pr.c2+1]||':'||vv.b2::VARCHAR||')'||(pr.k+1+pr.r)]||t.cb[pr.c1+2:]
  FROM txt t JOIN pr ON pr.tree_id=t.tree_id AND pr.r=t.r JOIN vv ON vv.tree_id=t.tree_id AND vv.i=t.r),
nwk AS (SELECT t.tree_id, kk.k, c[1]||';' AS plain, cb[1]||';' AS newick FROM txt t JOIN kk ON kk.tree_id=t.tree_id AND t.r=kk.k)"""


def _clades(source: str = "ed", closure: str = "up") -> str:
    return f"""cl AS (SELECT tree_id, k, anc, count(*) AS n, min(node) AS least FROM {closure} WHERE node<=k AND anc>k AND anc<2*k GROUP BY 1,2,3),
side AS (SELECT u.tree_id, u.k, u.anc, leaf FROM (SELECT cl.*, unnest(range(k+1)) AS leaf FROM cl WHERE n>1 AND n<k) u
  LEFT JOIN {closure} x ON x.tree_id=u.tree_id AND x.anc=u.anc AND x.node=u.leaf
  WHERE (x.node IS NOT NULL) = (2*u.n < u.k+1 OR (2*u.n = u.k+1 AND u.least=0))),
sp AS (SELECT DISTINCT tree_id, k, split FROM (SELECT tree_id, k, anc, string_agg(leaf::VARCHAR, ',' ORDER BY leaf) AS split FROM side GROUP BY 1,2,3))"""


def _with(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


_BASE = _with(_KEYS, _vv(), _TREE)
_DEPTH = _with(_KEYS, _vv(), _TREE, _CLOSURE)
_PAIRS = _with(_KEYS, _vv(), _TREE, _CLOSURE, _MRCA)
_TEXT = _with(_KEYS, _vv(), _TREE, _NEWICK)
_VECTOR = "WITH " + _KEYS + ", " + _vv() + " SELECT tree_id, string_agg(x::VARCHAR, ',' ORDER BY i) AS v FROM vv GROUP BY 1"
_LENGTHS = "WITH " + _KEYS + ", " + _vv() + " SELECT tree_id, i::INT AS row, b1, b2 FROM vv"
_SPLIT = _with(_KEYS, _vv(), _TREE, _CLOSURE, _clades())
_SUPPLIER_SPLITS = _with(_supplier(), _TREE, _CLOSURE, _clades())

_CANDIDATES = "WITH " + _KEYS + ", c AS (SELECT tree_id, i, (ok*31+i*7) % (2*i+1+CASE WHEN ok%11=0 THEN 1 ELSE 0 END) AS x, ((ok*31+7)%97+1)/100.0::DOUBLE AS b1 FROM ord) "

_LEAF_DEPTHS = _DEPTH + """SELECT tree_id, {what} FROM dep WHERE node<=k GROUP BY tree_id"""

_MATRIX = "SELECT tree_id, l::INT AS row, r::INT AS col, {value} AS value FROM md"


def _rf(value: str) -> str:
    """Both trees in one: the second's ids are moved up."""
    both = """one AS (SELECT * FROM ord),
vv AS (SELECT tree_id*2 AS tree_id, i, CAST((ok*7919 + i*104729 + 17) % (2*i+1) AS BIGINT) AS x, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM ord
  UNION ALL SELECT tree_id*2+1, i, CAST((ok*104729 + i*7919 + 5) % (2*i+1) AS BIGINT), 1.0::DOUBLE, 1.0::DOUBLE FROM ord)"""
    return _with(_KEYS, both, _TREE, _CLOSURE, _clades()) + f""", w AS (SELECT tree_id//2 AS t, split, count(*) AS c FROM sp GROUP BY 1,2),
q AS (SELECT t, sum(CASE WHEN c=1 THEN 1 ELSE 0 END)::DOUBLE AS apart, sum(c)::DOUBLE AS every FROM w GROUP BY 1)
SELECT k.tree_id, {value} AS rf FROM (SELECT DISTINCT tree_id FROM ord) k LEFT JOIN q ON q.t=k.tree_id"""


_CELLS = """ce AS (SELECT tree_id, k, 2*r+side AS edge, parent AS row, child AS col, -1 AS value FROM ed UNION ALL SELECT tree_id, k, 2*r+side, child, child, 1 FROM ed)"""


def _compressed(by: str, other: str, size: str) -> str:
    return _with(_KEYS, _vv(), _TREE, _CELLS) + f"""SELECT a.tree_id, indptr, indices, data FROM
(SELECT tree_id, string_agg({other}::VARCHAR, ',' ORDER BY {by}, {other}) AS indices, string_agg(value::VARCHAR, ',' ORDER BY {by}, {other}) AS data FROM ce GROUP BY 1) a
JOIN (SELECT tree_id, string_agg(c::VARCHAR, ',' ORDER BY n) AS indptr FROM (SELECT g.tree_id, n, (SELECT count(*) FROM ce WHERE ce.tree_id=g.tree_id AND {by}<n) AS c FROM (SELECT tree_id, unnest(range({size})) AS n FROM kk) g) GROUP BY 1) b USING (tree_id)"""


_PRE = _with(_KEYS, _vv(), _TREE, _CLOSURE) + """, wt AS (SELECT tree_id, k, child, parent, {w} AS w FROM edl),
cell AS (SELECT tree_id, k, child AS row, child AS col, w AS value FROM wt UNION ALL SELECT tree_id, k, parent, parent, w FROM wt
  UNION ALL SELECT tree_id, k, child, parent, -w FROM wt UNION ALL SELECT tree_id, k, parent, child, -w FROM wt)
SELECT tree_id, row::INT AS row, col::INT AS col, {v} AS value FROM cell WHERE row<2*k AND col<2*k GROUP BY 1,2,3"""

_NAMED = _with(_KEYS, _vv(), _TREE, _NEWICK) + """, nam AS (SELECT tree_id, k, plain, newick, regexp_replace(regexp_replace(newick, '\\)(\\d+)', ')', 'g'), '([(,])(\\d+):', '\\1<\\2>:', 'g') AS marked FROM nwk),
lv AS (SELECT tree_id, unnest(regexp_extract_all(marked, '<(\\d+)>', 1))::BIGINT AS leaf, unnest(range(k+1)) AS nth FROM nam),
rep(tree_id, n, s) AS (SELECT tree_id, 0::BIGINT, marked FROM nam UNION ALL
  SELECT rep.tree_id, n+1, replace(s, '<'||n||'>', 'taxon_'||(rep.tree_id+n*7)) FROM rep JOIN kk ON kk.tree_id=rep.tree_id AND n<=k),
num(tree_id, n, s) AS (SELECT tree_id, 0::BIGINT, marked FROM nam UNION ALL
  SELECT num.tree_id, n+1, replace(s, '<'||leaf||'>', nth::VARCHAR) FROM num JOIN lv ON lv.tree_id=num.tree_id AND nth=n)
"""

# a vector from the clades of a tree: ch has, for each inner node, the smallest leaves below its two children and how many
# leaves it holds; nodes that share their smallest leaf are nested, and merge in the order of the least leaf met so far
_FROM_CHERRIES = """co AS (SELECT tree_id, n, least(a, b) AS lo, greatest(a, b) AS hi FROM ch),
ck AS (SELECT *, min(hi) OVER (PARTITION BY tree_id, lo ORDER BY n) AS s FROM co),
cp AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY s DESC, n) AS pos FROM ck),
cb AS (SELECT x.tree_id, x.lo, x.hi, count(y.hi) AS earlier FROM cp x LEFT JOIN cp y ON y.tree_id=x.tree_id AND y.pos<x.pos AND y.hi<x.hi GROUP BY 1,2,3),
vec AS (SELECT tree_id, string_agg((CASE WHEN earlier=0 THEN lo ELSE hi-1+earlier END)::VARCHAR, ',' ORDER BY hi) AS v FROM cb GROUP BY 1)"""

_ADDED = _with(_KEYS, """v0 AS (SELECT tree_id, i, CAST((ok*7919 + i*104729 + 17) % (2*i+1) AS BIGINT) AS x FROM ord),
k0 AS (SELECT tree_id, count(*) AS k FROM v0 GROUP BY 1),
vv AS (SELECT tree_id, i, x, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM v0 UNION ALL SELECT tree_id, k, (tree_id*5+2)%(2*k+1), 1.0::DOUBLE, 1.0::DOUBLE FROM k0)""", _TREE, _CLOSURE, """lv AS (SELECT up.tree_id, anc, min(CASE WHEN node=k THEN leaf WHEN node>=leaf THEN node+1 ELSE node END) AS low, count(*) AS n
  FROM (SELECT *, (tree_id*7+3)%(k+1) AS leaf FROM up WHERE node<=k) up GROUP BY 1,2),
ch AS (SELECT an.tree_id, x.low AS a, y.low AS b, x.n+y.n AS n FROM an JOIN lv x ON x.tree_id=an.tree_id AND x.anc=an.c1 JOIN lv y ON y.tree_id=an.tree_id AND y.anc=an.c2)""", _FROM_CHERRIES) + "SELECT tree_id, v FROM vec"

_REMOVED = _DEPTH[:-1] + """,
cut AS (SELECT kk.tree_id, kk.k, (kk.tree_id*7+3)%(kk.k+1) AS leaf FROM kk),
gone AS (SELECT cut.*, CASE WHEN an.c1=leaf THEN an.c2 ELSE an.c1 END AS sister, an.p AS parent FROM cut JOIN an ON an.tree_id=cut.tree_id AND (an.c1=leaf OR an.c2=leaf)),
lv AS (SELECT up.tree_id, anc, min(node - CASE WHEN node>leaf THEN 1 ELSE 0 END) AS low, count(*) AS n FROM up JOIN gone ON gone.tree_id=up.tree_id WHERE node<=up.k AND node<>leaf GROUP BY 1,2),
ch AS (SELECT an.tree_id, x.low AS a, y.low AS b, x.n+y.n AS n FROM an JOIN gone ON gone.tree_id=an.tree_id AND an.p<>gone.parent JOIN lv x ON x.tree_id=an.tree_id AND x.anc=an.c1 JOIN lv y ON y.tree_id=an.tree_id AND y.anc=an.c2),
""" + _FROM_CHERRIES + "\nSELECT gone.tree_id, leaf::INT AS leaf, coalesce(v, '') AS v, sister::INT AS sister FROM gone LEFT JOIN vec ON vec.tree_id=gone.tree_id"

# above the new root's node clades turn inside out: a node on the way to the old root holds what was outside of it
_REROOTED = _DEPTH[:-1] + """,
tp AS (SELECT tree_id, k, (tree_id*7+3)%(2*k) AS top FROM kk),
path AS (SELECT up.tree_id, up.anc FROM up JOIN tp ON tp.tree_id=up.tree_id AND up.node=top WHERE up.anc<>top),
inside AS (SELECT tree_id, anc, min(node) AS low, count(*) AS n FROM up WHERE node<=k GROUP BY 1,2),
outside AS (SELECT g.tree_id, g.anc, min(leaf) AS low, count(*) AS n FROM (SELECT kk.tree_id, k, unnest(range(2*k)) AS anc FROM kk) g JOIN (SELECT tree_id, unnest(range(k+1)) AS leaf FROM kk) l ON l.tree_id=g.tree_id
  LEFT JOIN up ON up.tree_id=g.tree_id AND up.anc=g.anc AND up.node=l.leaf WHERE up.node IS NULL GROUP BY 1,2),
ch AS (SELECT an.tree_id, x.low AS a, y.low AS b, x.n+y.n AS n FROM an JOIN inside x ON x.tree_id=an.tree_id AND x.anc=an.c1 JOIN inside y ON y.tree_id=an.tree_id AND y.anc=an.c2
    WHERE NOT EXISTS (SELECT 1 FROM path WHERE path.tree_id=an.tree_id AND path.anc=an.p)
  UNION ALL SELECT an.tree_id, x.low, o.low, x.n+o.n FROM an JOIN path ON path.tree_id=an.tree_id AND path.anc=an.p JOIN tp ON tp.tree_id=an.tree_id
    JOIN inside x ON x.tree_id=an.tree_id AND x.anc = CASE WHEN an.c1=top OR EXISTS (SELECT 1 FROM path q WHERE q.tree_id=an.tree_id AND q.anc=an.c1) THEN an.c2 ELSE an.c1 END
    JOIN outside o ON o.tree_id=an.tree_id AND o.anc=an.p WHERE an.p<2*an.k
  UNION ALL SELECT tp.tree_id, x.low, o.low, x.n+o.n FROM tp JOIN inside x ON x.tree_id=tp.tree_id AND x.anc=top JOIN outside o ON o.tree_id=tp.tree_id AND o.anc=top),
""" + _FROM_CHERRIES + "\nSELECT tree_id, v FROM vec"

# a walk by levels, one node of the queue a step
_SHUFFLED = _BASE[:-1] + """,
sh(tree_id, k, t, nodes, leaves, v, m) AS (SELECT tree_id, k, 1, [2*k], [0::BIGINT], []::BIGINT[], []::STRUCT(l BIGINT, n BIGINT)[] FROM kk
  UNION ALL SELECT sh.tree_id, sh.k, t+1, CASE WHEN an.p IS NULL THEN nodes ELSE nodes||[an.c2]||[an.c1] END, CASE WHEN an.p IS NULL THEN leaves ELSE leaves||[leaves[t]]||[len(v)+1] END,
    CASE WHEN an.p IS NULL THEN v ELSE v||[leaves[t]] END, CASE WHEN an.p IS NULL THEN m||[{'l': leaves[t], 'n': nodes[t]}] ELSE m END
  FROM sh LEFT JOIN an ON an.tree_id=sh.tree_id AND an.p=nodes[t] WHERE t<=2*sh.k+1)
SELECT tree_id, array_to_string(v, ',') AS v, array_to_string(list_transform(list_sort(m), lambda e: e.n), ',') AS mapping FROM sh WHERE t=2*k+2"""

# the inverse covariance from independent contrasts: each merge adds one, and the root's estimate the last
_PRECISION = _BASE[:-1] + """,
pc(tree_id, k, r, w, e, m) AS (SELECT tree_id, k, 0::BIGINT, list_transform(range(k+1), lambda i: list_transform(range(k+1), lambda j: CASE WHEN i=j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)),
    list_transform(range(k+1), lambda i: 0.0::DOUBLE), list_transform(range((k+1)*(k+1)), lambda i: 0.0::DOUBLE) FROM kk
  UNION ALL SELECT tree_id, k, r+1, w[:c1]||[list_transform(range(1, k+2), lambda j: (w1[j]*s2+w2[j]*s1)/(s1+s2))]||w[c1+2:], e[:c1]||[s1*s2/(s1+s2)]||e[c1+2:],
    list_transform(range((k+1)*(k+1)), lambda i: m[i+1] + (w1[i//(k+1)+1]-w2[i//(k+1)+1])*(w1[i%(k+1)+1]-w2[i%(k+1)+1])/(s1+s2))
  FROM (SELECT pc.*, pr.c1, w[pr.c1+1] AS w1, w[pr.c2+1] AS w2, vv.b1+e[pr.c1+1] AS s1, vv.b2+e[pr.c2+1] AS s2 FROM pc JOIN pr ON pr.tree_id=pc.tree_id AND pr.r=pc.r JOIN vv ON vv.tree_id=pc.tree_id AND vv.i=pc.r))
SELECT tree_id, (i//(k+1))::INT AS row, (i%(k+1))::INT AS col, round(m[i+1] + w[1][i//(k+1)+1]*w[1][i%(k+1)+1]/e[1], 6)+0.0 AS value FROM (SELECT *, unnest(range((k+1)*(k+1))) AS i FROM pc WHERE r=k)"""

# likelihoods of each site pruned up the merges, unscaled
_JC69 = _BASE[:-1] + """,
pl(tree_id, site, r, c) AS (SELECT tree_id, site, 0::BIGINT, list_transform(range(k+1), lambda l: list_transform(range(4), lambda j: CASE WHEN (tree_id*3 + l*(site%4+1) + site*site)%5 IN (j, 4) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))
    FROM kk, (SELECT unnest(range(12)) AS site)
  UNION ALL SELECT tree_id, site, r+1, c[:c1]||[list_transform(range(1, 5), lambda j: (d1*x[j]+(1-d1)*0.25::DOUBLE*list_sum(x))*(d2*y[j]+(1-d2)*0.25::DOUBLE*list_sum(y)))]||c[c1+2:]
  FROM (SELECT pl.*, pr.c1, c[pr.c1+1] AS x, c[pr.c2+1] AS y, exp(-4.0::DOUBLE/3*b1) AS d1, exp(-4.0::DOUBLE/3*b2) AS d2 FROM pl JOIN pr ON pr.tree_id=pl.tree_id AND pr.r=pl.r JOIN vv ON vv.tree_id=pl.tree_id AND vv.i=pl.r))
SELECT pl.tree_id, round(sum(ln(0.25::DOUBLE*list_sum(c[1]))), 5) AS loglik FROM pl JOIN kk ON kk.tree_id=pl.tree_id AND pl.r=k GROUP BY 1"""


def _written(n: str, shift: int) -> str:
    """A number of at most two digits, divided by ten to the power of shift, as text with 18 places and an exponent."""
    zeros = "0" * 17
    exponent = lambda e: f"e-{-e:02d}" if e < 0 else f"e+{e:02d}"
    return f"CASE WHEN {n}=0 THEN '0.{zeros}0e+00' WHEN {n}<10 THEN {n}||'.{zeros}0{exponent(-shift)}' ELSE ({n}//10)||'.'||({n}%10)||'{zeros}{exponent(1 - shift)}' END"


_SAVED = "WITH " + _KEYS + ", " + _vv() + f" SELECT tree_id, string_agg({_written('x', 0)}||','||{_written('((ok*31+7)%97+1)', 2)}||','||{_written('((ok*17+3)%89+1)', 2)}, chr(10) ORDER BY i) AS value FROM vv GROUP BY 1"

SQL = {
    "add_leaf": _ADDED,
    "remove_leaf": _REMOVED,
    "reroot": _REROOTED,
    "queue_shuffle": _SHUFFLED,
    "precision": _PRECISION,
    "jc69_loglik": _JC69,
    "save_text": _SAVED,
    "segment_balance": _DEPTH + """, b AS (SELECT tree_id, sum(d) AS s, sum(d*d)/count(*)::DOUBLE - (sum(d)/count(*)::DOUBLE)*(sum(d)/count(*)::DOUBLE) AS v, sum(d*pow(2.0,-d)) AS b2 FROM dep WHERE node<=k GROUP BY 1)
SELECT coalesce(c_mktsegment, 'all') AS segment, count(*) AS trees, sum(s)::BIGINT AS sackin, round(avg(v),6) AS variance, round(avg(b2),6) AS b2 FROM b JOIN customer ON tree_id=c_custkey GROUP BY ROLLUP(c_mktsegment)""",
    "to_pairs": _BASE + "SELECT tree_id, r::INT AS row, c1::INT AS c1, c2::INT AS c2 FROM pr",
    "to_ancestry": _BASE + "SELECT tree_id, r::INT AS row, c1::INT AS c1, c2::INT AS c2, p::INT AS p FROM an",
    "to_edges": _BASE + "SELECT tree_id, r::INT AS row, side::INT AS side, child::INT AS child, parent::INT AS parent FROM ed",
    "to_newick": _TEXT + "SELECT tree_id, plain AS newick FROM nwk",
    "to_newick_bl": _TEXT + "SELECT tree_id, newick FROM nwk",
    "to_newick_kernel": _TEXT + "SELECT tree_id, newick FROM nwk",
    **{k: _VECTOR for k in ("from_pairs", "from_ancestry", "from_edges", "from_newick", "from_newick_noparents", "from_newick_kernel", "load_text")},
    **{k: _LENGTHS for k in ("from_newick_bl", "from_newick_bl_noparents")},
    "check_v": _CANDIDATES + "SELECT tree_id, bool_and(x>=0 AND x<=2*i) AS valid FROM c GROUP BY 1",
    "check_m": _CANDIDATES + "SELECT tree_id, bool_and(x>=0 AND x<=2*i AND b1-0.02::DOUBLE>=0) AS valid FROM c GROUP BY 1",
    "is_ordered": "WITH " + _KEYS + ", " + _vv() + " SELECT tree_id, bool_and(x<=i) AS ordered FROM vv GROUP BY 1",
    "sample_hash": "WITH " + _supplier() + " SELECT tree_id, string_agg(x::VARCHAR, ',' ORDER BY i) AS v FROM vv GROUP BY 1",
    "sample_hash_ordered": "WITH " + _supplier(True) + " SELECT tree_id, string_agg(x::VARCHAR, ',' ORDER BY i) AS v FROM vv GROUP BY 1",
    "node_depths": _DEPTH + "SELECT tree_id, node::INT AS node, d::DOUBLE AS depth FROM dep",
    "node_depths_bl": _DEPTH + "SELECT tree_id, node::INT AS node, round(dl,6)+0.0 AS depth FROM dep",
    "node_depth_at": _DEPTH + "SELECT tree_id, node::INT AS node, round(dl,6)+0.0 AS depth FROM dep WHERE node = (tree_id*7+3)%(2*k+1)",
    "mrca": _DEPTH + "SELECT u.tree_id, u.node::INT AS a, w.node::INT AS b, min(u.anc)::INT AS ancestor FROM up u JOIN up w ON u.tree_id=w.tree_id AND u.anc=w.anc WHERE u.node=(u.tree_id*7+3)%(2*u.k+1) AND w.node=(u.tree_id*5+1)%(2*u.k+1) GROUP BY 1,2,3",
    "cophenetic": _PAIRS + _MATRIX.format(value="(ld+rd-2*md)::DOUBLE"),
    "cophenetic_unrooted": _PAIRS + _MATRIX.format(value="(ld+rd-2*md - CASE WHEN k>=2 AND m=2*k AND l<>r THEN 1 ELSE 0 END)::DOUBLE"),
    "cophenetic_bl": _PAIRS + _MATRIX.format(value="CASE WHEN l=r THEN 0.0::DOUBLE ELSE round(ldl+rdl-2*mdl,6)+0.0 END"),
    "cophenetic_unrooted_bl": _PAIRS + _MATRIX.format(value="CASE WHEN l=r THEN 0.0::DOUBLE ELSE round(ldl+rdl-2*mdl - CASE WHEN k>=2 AND m=2*k THEN top ELSE 0 END,6)+0.0 END"),
    "vcv": _PAIRS + _MATRIX.format(value="md::DOUBLE"),
    "vcv_bl": _PAIRS + _MATRIX.format(value="round(mdl,6)+0.0"),
    "incidence_coo": _with(_KEYS, _vv(), _TREE, _CELLS) + "SELECT tree_id, edge::INT AS edge, row::INT AS row, col::INT AS col, value::INT AS value FROM ce",
    "incidence_dok": _with(_KEYS, _vv(), _TREE, _CELLS) + "SELECT tree_id, row::INT AS row, col::INT AS col, value::INT AS value FROM ce",
    "incidence_csr": _compressed("row", "col", "2*k+2"),
    "incidence_csc": _compressed("col", "row", "2*k+1"),
    "incidence_dense": _BASE + "SELECT g.tree_id, g.n::INT AS row, string_agg(CASE WHEN ed.parent=g.n THEN '-1' WHEN ed.child=g.n THEN '1' ELSE '0' END, ',' ORDER BY ed.child) AS cells FROM (SELECT tree_id, unnest(range(2*k+1)) AS n FROM kk) g JOIN ed ON ed.tree_id=g.tree_id GROUP BY 1,2",
    "pre_precision": _PRE.format(w="1.0::DOUBLE", v="sum(value)::DOUBLE"),
    "pre_precision_bl": _PRE.format(w="1.0::DOUBLE/bl", v="round(sum(value),6)+0.0"),
    "precision_identity": _BASE + "SELECT tree_id, a::INT AS row, b::INT AS col, CASE WHEN a=b THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM (SELECT tree_id, k, unnest(range(k+1)) AS a FROM kk) JOIN (SELECT tree_id AS t, unnest(range(k+1)) AS b FROM kk) ON t=tree_id",
    "sackin": _LEAF_DEPTHS.format(what="sum(d)::BIGINT AS sackin"),
    "leaf_depth_variance": _LEAF_DEPTHS.format(what="round(sum(d*d)/count(*)::DOUBLE - (sum(d)/count(*)::DOUBLE)*(sum(d)/count(*)::DOUBLE),6)+0.0 AS variance"),
    "b2": _LEAF_DEPTHS.format(what="round(sum(d*pow(2.0,-d)),6)+0.0 AS b2"),
    "splits": _SPLIT + "SELECT tree_id, split FROM sp",
    "rf_pair": _rf("coalesce(apart, 0.0)"),
    "rf_normalized": _rf("CASE WHEN coalesce(every,0)=0 THEN 0.0::DOUBLE ELSE round(apart/every,6) END"),
    "rf_all_pairs": _SUPPLIER_SPLITS + """, n AS (SELECT kk.tree_id, kk.k, count(split) AS n FROM kk LEFT JOIN sp ON sp.tree_id=kk.tree_id GROUP BY 1,2)
SELECT x.tree_id AS a, y.tree_id AS b, (x.n+y.n-2*coalesce(c,0))::DOUBLE AS rf FROM n x JOIN n y ON x.k=y.k AND x.tree_id<y.tree_id
LEFT JOIN (SELECT s.tree_id AS a, t.tree_id AS b, count(*) AS c FROM sp s JOIN sp t ON s.split=t.split AND s.tree_id<t.tree_id GROUP BY 1,2) ON a=x.tree_id AND b=y.tree_id""",
    "split_support": _SUPPLIER_SPLITS + "SELECT (k+1)::INT AS n_leaves, split, count(*) AS trees, round(count(*)/(SELECT count(*) FROM kk)::DOUBLE,6)+0.0 AS support FROM sp GROUP BY 1,2",
    "find_num_leaves": _BASE + "SELECT tree_id, (k+1)::INT AS n FROM kk",
    "newick_predicates": _BASE + "SELECT tree_id, true AS parents, false AS named_parents, true AS lengths, false AS bare_lengths, true AS integers, false AS named_integers FROM kk",
    "remove_parent_labels": _TEXT + "SELECT tree_id, regexp_replace(newick, '\\)(\\d+)', ')', 'g') AS newick FROM nwk",
    "remove_branch_lengths": _TEXT + "SELECT tree_id, plain AS newick FROM nwk",
    "apply_label_mapping": _NAMED + "SELECT rep.tree_id, s AS newick FROM rep JOIN kk ON kk.tree_id=rep.tree_id AND n=k+1",
    "create_label_mapping": _NAMED + "SELECT tree_id, nth::INT AS leaf, 'taxon_'||(tree_id+leaf*7) AS taxon FROM lv",
    "label_mapping_newick": _NAMED + "SELECT num.tree_id, s AS newick FROM num JOIN kk ON kk.tree_id=num.tree_id AND n=k+1",
    "leaf_round_trip": _VECTOR + " HAVING count(*) > 1",
    "reroot_distance": "SELECT o_custkey AS tree_id, 0.0::DOUBLE AS rf FROM orders GROUP BY 1",
    "list_datasets": "SELECT * FROM (VALUES ('fluA',69,987,'fasta'),('h3n2',19,1407,'fasta'),('m501',29,2520,'fasta'),('zika',86,10807,'fasta')) t(name, n_taxa, n_bases, format)",
    "read_fasta": "SELECT 'part'||p_partkey AS taxon, regexp_replace(translate(upper(p_name), 'BDEFHIJKLMNOPQRSUVWXYZ0123456789 #-_', 'ACGTACGTACGTACGTACGTACACGTACGTACGTAC'), '\\s+', '', 'g') AS seq FROM part",
    "dnadist": """WITH s AS (SELECT 's'||s_suppkey AS taxon, i, (s_suppkey*(i%5+1) + (i*i)%7 + s_suppkey//(i+1))%4 AS b FROM supplier, (SELECT unnest(range(40)) AS i))
SELECT x.taxon AS a, y.taxon AS b, round(sum(CASE WHEN x.b<>y.b THEN 1 ELSE 0 END)/40.0::DOUBLE,6)+0.0 AS distance FROM s x JOIN s y ON x.i=y.i AND x.taxon<y.taxon GROUP BY 1,2""",
    "bme_score": _PAIRS + "SELECT tree_id, round(ln(sum((((l*r*31+l+r)%97)+1)/10.0::DOUBLE * pow(2.0, -(ld+rd-2*md - CASE WHEN k>=2 AND m=2*k THEN 1 ELSE 0 END)))),6) AS score FROM md WHERE l<>r GROUP BY 1",
    "hill_climb_step": "WITH RECURSIVE " + _KEYS + """, base AS (SELECT tree_id, i, CAST((ok*7919 + i*104729 + 17) % (2*i+1) AS BIGINT) AS x FROM ord),
kb AS (SELECT tree_id AS t, count(*) AS k FROM base GROUP BY 1 HAVING count(*)>1),
try AS (SELECT t, k, unnest(range(2*k-1)) AS j FROM kb),
vv AS (SELECT t*1000+j AS tree_id, i, CASE WHEN i=k-1 THEN j ELSE x END AS x, 1.0::DOUBLE AS b1, 1.0::DOUBLE AS b2 FROM try JOIN base ON base.tree_id=t
  WHERE j <> (SELECT x FROM base z WHERE z.tree_id=t AND z.i=k-1)),
""" + _TREE + ",\n" + _CLOSURE + """, s AS (SELECT tree_id//1000 AS t, tree_id%1000 AS x, sum(d) AS s FROM dep WHERE node<=k GROUP BY 1,2)
SELECT t AS tree_id, min(s)::BIGINT AS sackin, min_by(x, s*10000+x)::INT AS x FROM s GROUP BY 1""",
}
