"""Validity, conversions, depths, common ancestors, balance and Newick strings as SQL functions of a session, for SQL users."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Bodies in SQL: a session inlines them like any expression, so there is no Python worker.
FUNCTIONS = {
    "tree_is_valid(v ARRAY<INT>)": ("BOOLEAN", "forall(transform(v, (x, i) -> x >= 0 AND x <= 2 * i), ok -> ok)"),
    "tree_is_ordered(v ARRAY<INT>)": ("BOOLEAN", "forall(transform(v, (x, i) -> x <= i), ok -> ok)"),
    "tree_n_leaves(v ARRAY<INT>)": ("INT", "size(v) + 1"),
    "tree_pairs(v ARRAY<INT>)": (
        "ARRAY<STRUCT<c1: INT, c2: INT>>",
        """aggregate(transform(v, (x, i) -> named_struct('x', x, 'i', i)), cast(array() AS array<struct<c1:int,c2:int>>),
          (acc, e) -> CASE WHEN e.x <= e.i THEN concat(array(named_struct('c1', e.x, 'c2', e.i + 1)), acc)
            ELSE concat(slice(acc, 1, e.x - e.i), array(named_struct('c1', element_at(acc, e.x - e.i).c1, 'c2', e.i + 1)),
                        slice(acc, e.x - e.i + 1, greatest(size(acc), 1))) END)""",
    ),
    # a value that is used more than once is bound by transform(array(value), name -> ...)
    "tree_ancestry(v ARRAY<INT>)": (
        "ARRAY<STRUCT<c1: INT, c2: INT, p: INT>>",
        """get(transform(array(tree_pairs(v)), p -> get(transform(array(array_sort(concat(transform(p, (e, r) -> named_struct('l', e.c1, 'r', r, 's', 0)), transform(p, (e, r) -> named_struct('l', e.c2, 'r', r, 's', 1))))),
          u -> get(transform(array(array_sort(transform(u, (x, j) -> named_struct('r', x.r, 's', x.s, 'n', IF(j > 0 AND get(u, j - 1).l = x.l, size(p) + 1 + get(u, j - 1).r, x.l))))),
            n -> transform(p, (e, r) -> named_struct('c1', get(n, 2 * r).n, 'c2', get(n, 2 * r + 1).n, 'p', size(p) + 1 + r))), 0)), 0)), 0)""",
    ),
    "tree_edges(v ARRAY<INT>)": ("ARRAY<STRUCT<child: INT, parent: INT>>", "flatten(transform(tree_ancestry(v), r -> array(named_struct('child', r.c1, 'parent', r.p), named_struct('child', r.c2, 'parent', r.p))))"),
    "tree_parents(v ARRAY<INT>)": ("ARRAY<INT>", "concat(transform(array_sort(tree_edges(v)), e -> e.parent), array(2 * size(v)))"),
    "tree_depths(v ARRAY<INT>)": (
        "ARRAY<DOUBLE>",
        """transform(aggregate(sequence(0, cast(ceil(log2(2 * size(v) + 1)) AS int)), transform(tree_parents(v), (p, i) -> named_struct('to', p, 'd', IF(p = i, 0.0D, 1.0D))),
          (s, y) -> transform(s, x -> named_struct('to', get(s, x.to).to, 'd', x.d + get(s, x.to).d))), x -> x.d)""",
    ),
    "tree_mrca(v ARRAY<INT>, a INT, b INT)": (
        "INT",
        """get(transform(array(tree_parents(v)), up -> aggregate(sequence(0, size(up)), named_struct('a', a, 'b', b),
          (s, y) -> IF(s.a = s.b, s, named_struct('a', get(up, least(s.a, s.b)), 'b', greatest(s.a, s.b))), s -> s.a)), 0)""",
    ),
    "tree_sackin(v ARRAY<INT>)": ("BIGINT", "cast(aggregate(slice(tree_depths(v), 1, size(v) + 1), 0.0D, (a, d) -> a + d) AS bigint)"),
    "tree_b2(v ARRAY<INT>)": ("DOUBLE", "aggregate(slice(tree_depths(v), 1, size(v) + 1), 0.0D, (a, d) -> a + d * pow(2.0D, -d))"),
    "tree_newick(v ARRAY<INT>)": (
        "STRING",
        """concat(get(aggregate(transform(tree_pairs(v), (e, i) -> named_struct('e', e, 'i', i)), transform(sequence(0, size(v)), x -> cast(x AS string)),
          (t, s) -> transform(t, (x, j) -> CASE WHEN j = s.e.c1 THEN concat('(', x, ',', get(t, s.e.c2), ')', cast(size(t) + s.i AS string)) WHEN j = s.e.c2 THEN '' ELSE x END)), 0), ';')""",
    ),
    "newick_has_integer_labels(s STRING)": ("BOOLEAN", r"regexp_count(s, '\\(\\b(\\d+)\\b') = regexp_count(s, '\\(\\b(\\w+)\\b') AND regexp_count(s, ',\\b(\\d+)\\b') = regexp_count(s, ',\\b(\\w+)\\b')"),
    "newick_has_parents(s STRING)": ("BOOLEAN", r"s RLIKE '\\)(\\d+)'"),
    "newick_has_branch_lengths(s STRING)": ("BOOLEAN", r"s RLIKE ':\\d+(\\.\\d+)?([eE][+-]?\\d+)?'"),
    "newick_remove_parents(s STRING)": ("STRING", r"regexp_replace(s, '\\)(\\d+)', ')')"),
    "newick_remove_branch_lengths(s STRING)": ("STRING", r"regexp_replace(s, ':\\d+(\\.\\d+)?([eE][+-]?\\d+)?', '')"),
    "newick_n_leaves(s STRING)": ("INT", r"regexp_count(s, '(\\(\\b(\\d+)\\b)|(,\\b(\\d+)\\b)')"),
}


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names."""
    for head, (kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    return [head.split("(")[0] for head in FUNCTIONS]
