"""Column functions on one tree a row: no shuffle, no Python worker.

A tree of k + 1 leaves is an ``ARRAY<INT>`` v of length k with 0 <= v[i] <= 2i. Leaves are 0..k; the row r of its
merge order makes the internal node k + 1 + r, so labels grow towards the root 2k. Branch lengths are an
``ARRAY<STRUCT<b1 DOUBLE, b2 DOUBLE>>``, a pair for each row of the ancestry (not for each place of v).

Functions take columns, not long expressions: ``arborline.plans.stages`` adds pairs, ancestry and so on as columns
of their own, so that each is analysed and computed once. Ancestry, depths, lengths and common ancestors cost k log k or
less; conversions that fold a tree (pairs, Newick) copy an array a step, which is k^2: ``arborline.operators.kernels``
has those as Arrow kernels for trees of more than a few hundred leaves.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PAIRS = "array<struct<c1:int,c2:int>>"
ROWS = "array<struct<c1:int,c2:int,p:int>>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def _indexed(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i")))


def _int(n: int | Column) -> Column:
    return (F.lit(n) if isinstance(n, int) else n).cast("int")


def _once(f: Callable[..., Column]) -> Callable[..., Column]:
    """Bind a function's first column to a name, so that it is computed once wherever the optimiser moves the expression."""

    @functools.wraps(f)
    def bound(x: Column, *args, **named) -> Column:
        return F.transform(F.array(x), lambda y: f(y, *args, **named)).getItem(0)

    return bound


def _let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.transform(F.array(x), f).getItem(0)


# -- validity


def is_valid(v: Column) -> Column:
    """0 <= v[i] <= 2i everywhere, and no null."""
    return F.coalesce(F.forall(F.transform(v, lambda x, i: F.coalesce((x >= 0) & (x <= 2 * i), F.lit(False))), lambda ok: ok), F.lit(False))


def check(v: Column) -> Column:
    """v itself; an error that names the first place out of bounds otherwise."""
    bad = F.filter(_indexed(v), lambda e: F.coalesce((e["x"] < 0) | (e["x"] > 2 * e["i"]), F.lit(True)))
    first = bad.getItem(0)
    text = F.concat(F.lit("Validation failed: v["), first["i"].cast("string"), F.lit("] = "), F.coalesce(first["x"].cast("string"), F.lit("null")), F.lit(" is out of bounds (max = "), (2 * first["i"]).cast("string"), F.lit(")"))
    return F.when(F.size(bad) == 0, v).otherwise(F.raise_error(text).cast("array<int>"))


def is_valid_matrix(v: Column, bls: Column) -> Column:
    """A valid, non-empty v with as many pairs of lengths, none negative or null."""
    lengths = F.forall(bls, lambda b: F.coalesce((b["b1"] >= 0) & (b["b2"] >= 0), F.lit(False)))
    return F.coalesce(is_valid(v) & (F.size(v) > 0) & (F.size(v) == F.size(bls)) & lengths, F.lit(False))


def is_ordered(v: Column) -> Column:
    """v[i] <= i everywhere: a tree of a birth process."""
    return F.forall(F.transform(v, lambda x, i: x <= i), lambda ok: ok)


def n_leaves(v: Column) -> Column:
    return F.size(v) + 1


# -- conversions


def to_pairs(v: Column) -> Column:
    """(branch, new leaf) in merge order.

    Place i either puts its pair first (v[i] <= i) or after the (v[i] - i)-th pair, whose branch it shares.
    """

    def step(acc, e):
        x, i = e["x"], e["i"]
        at = x - i
        new = lambda c1: F.array(F.struct(c1.alias("c1"), (i + 1).alias("c2")))
        after = F.concat(F.slice(acc, F.lit(1), at), new(F.element_at(acc, at)["c1"]), F.slice(acc, at + 1, F.greatest(F.size(acc), F.lit(1))))
        return F.when(at <= 0, F.concat(new(x), acc)).otherwise(after)

    return F.aggregate(_indexed(v), _empty(PAIRS), step)


@_once
def from_pairs(pairs: Column) -> Column:
    """The vector of pairs in merge order (of any orientation).

    The larger label of a row is the leaf it adds; with no smaller leaf added in an earlier row it hangs on the
    label it is paired with, else on a node counted by those rows.
    """
    high = F.transform(pairs, lambda e: F.greatest(e["c1"], e["c2"]))

    def place(e, r):
        top = F.greatest(e["c1"], e["c2"])
        before = F.size(F.filter(F.slice(high, F.lit(1), r), lambda h: h < top))
        return F.struct((top - 1).alias("i"), F.when(before == 0, F.least(e["c1"], e["c2"])).otherwise(top - 1 + before).alias("x"))

    return F.transform(F.sort_array(F.transform(pairs, place)), lambda e: e["x"])


@_once
def ancestry_of_pairs(pairs: Column) -> Column:
    """(c1, c2, p) of each row: a label stands for the last node that was made of it.

    Sorted by label and row, a label's earlier use is the entry before, so no step copies the tree.
    """
    k = F.size(pairs)
    side = lambda c, n: F.transform(pairs, lambda e, r: F.struct(e[c].alias("l"), r.alias("r"), F.lit(n).alias("s")))
    uses = F.array_sort(F.concat(side("c1", 0), side("c2", 1)))

    def node(sorted_uses):
        def made(u, j):
            before = F.get(sorted_uses, j - 1)
            return F.struct(u["r"].alias("r"), u["s"].alias("s"), F.when((j > 0) & (before["l"] == u["l"]), k + 1 + before["r"]).otherwise(u["l"]).alias("n"))

        return F.array_sort(F.transform(sorted_uses, made))

    rows = _let(uses, lambda u: _let(node(u), lambda n: F.transform(pairs, lambda e, r: F.struct(F.get(n, 2 * r)["n"].alias("c1"), F.get(n, 2 * r + 1)["n"].alias("c2"), (k + 1 + r).alias("p")))))
    return F.when(k == 0, _empty(ROWS)).otherwise(rows)


def edges_of_ancestry(rows: Column) -> Column:
    """(child, parent), the two children of a row side by side."""
    return F.flatten(F.transform(rows, lambda r: F.array(F.struct(r["c1"].alias("child"), r["p"].alias("parent")), F.struct(r["c2"].alias("child"), r["p"].alias("parent")))))


@_once
def rows_of_edges(edges: Column) -> Column:
    """Ancestry rows of edges whose siblings lie side by side, in order of their parents; an odd count is an error."""
    half = F.when(F.size(edges) % 2 == 0, (F.size(edges) / 2).cast("int")).otherwise(F.raise_error(F.lit("edges must come in pairs")).cast("int"))
    row = lambda r: F.struct(F.get(edges, 2 * r)["parent"].alias("p"), F.get(edges, 2 * r)["child"].alias("c1"), F.get(edges, 2 * r + 1)["child"].alias("c2"))
    rows = F.when(half == 0, _empty("array<struct<p:int,c1:int,c2:int>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(half, F.lit(1)) - 1), row))
    return F.transform(F.sort_array(rows), lambda r: F.struct(r["c1"], r["c2"], r["p"]))


@_once
def least_leaves(rows: Column) -> Column:
    """For each row, in an order that has children before parents, the smallest leaf under its first and second child."""
    parents = rows["p"]

    def step(acc, r):
        def least(c):
            at = F.array_position(parents, c).cast("int")
            found = F.get(acc, at - 1)
            return F.when(at == 0, c).otherwise(F.least(found["c1"], found["c2"]))

        return F.array_append(acc, F.struct(least(r["c1"]).alias("c1"), least(r["c2"]).alias("c2")))

    return F.aggregate(rows, _empty(PAIRS), step)


@_once
def newick_of_pairs(pairs: Column, bls: Column | None = None) -> Column:
    """Nested brackets with the parents' labels; with branch lengths, ``:length`` after each child."""
    k = F.size(pairs)
    steps = F.transform(pairs, lambda e, i: F.struct(e.alias("e"), i.alias("i")))

    def step(texts, s):
        e, b = s["e"], (F.get(bls, s["i"]) if bls is not None else None)
        one = lambda t, side: t if bls is None else F.concat(t, F.lit(":"), number(b[side]))
        both = lambda t: F.concat(F.lit("("), one(t, "b1"), F.lit(","), one(F.get(texts, e["c2"]), "b2"), F.lit(")"), (k + 1 + s["i"]).cast("string"))
        # a text that was used up is dropped, so that only living ones are copied
        return F.transform(texts, lambda t, j: F.when(j == e["c1"], both(t)).when(j == e["c2"], F.lit("")).otherwise(t))

    start = F.transform(F.sequence(F.lit(0), k), lambda x: x.cast("string"))
    return F.concat(F.aggregate(steps, start, step, lambda texts: F.get(texts, F.lit(0))), F.lit(";"))


def number(x: Column) -> Column:
    """A double in the fewest digits that give it back, with a point: plain for 1e-5 <= |x| < 1e16, else with an exponent as in 1e-7."""
    s = x.cast("string")
    mantissa, power = F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), F.regexp_extract(s, r"E(-?\d+)$", 1)
    sign = F.when(s.startswith("-"), F.lit("-")).otherwise(F.lit(""))
    digits = F.regexp_replace(F.regexp_replace(mantissa, r"\.0$", ""), r"[-.]", "")
    e = F.when(power == "", F.lit(0)).otherwise(power.try_cast("int"))
    whole = F.greatest(e + 1, F.lit(1))
    padded = F.rpad(digits, F.greatest(whole, F.length(digits)), F.lit("0"))
    large = F.concat(sign, F.substring(padded, F.lit(1), whole), F.lit("."), F.when(F.length(padded) > whole, F.substring(padded, whole + 1, F.length(padded))).otherwise(F.lit("0")))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), F.greatest(-e - 1, F.lit(0))), digits)
    far = F.concat(F.regexp_replace(mantissa, r"\.0$", ""), F.lit("e"), power)
    return F.when(power == "", s).when((e >= 0) & (e < 16), large).when((e < 0) & (e >= -5), small).otherwise(far)


# -- statistics


def _by_child(rows: Column, value: Callable[[Column, Column, str], Column], root: Column) -> Column:
    """An array over all 2k + 1 nodes: ``value(row, place, side)`` for a child, ``root`` for the root."""

    def both(r, i):
        return F.array(*[F.struct(r[c].alias("n"), value(r, i, b).alias("x")) for c, b in (("c1", "b1"), ("c2", "b2"))])

    below = F.array_sort(F.flatten(F.transform(rows, both)))
    return F.concat(F.transform(below, lambda e: e["x"]), F.array(root))


@_once
def parents(rows: Column) -> Column:
    """The parent of every node; the root is its own."""
    return _by_child(rows, lambda r, i, side: r["p"], 2 * F.size(rows))


@_once
def node_lengths(rows: Column, bls: Column | None = None) -> Column:
    """The length of the branch above every node; 0 at the root."""
    return _by_child(rows, lambda r, i, side: F.lit(1.0) if bls is None else F.get(bls, i)[side], F.lit(0.0))


@_once
def node_depths(rows: Column, bls: Column | None = None) -> Column:
    """The depth of every node as a double; a branch counts 1 without lengths. No rows: one node of depth 0.

    Every node jumps to its parent, then as far again in each round, and adds up what it passes: k log k.
    """
    state = F.zip_with(parents(rows), node_lengths(rows, bls), lambda p, d: F.struct(p.alias("to"), d.alias("d")))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(2 * F.size(rows) + F.lit(1))).cast("int"))

    def jump(s, _):
        return F.transform(s, lambda x: _let(F.get(s, x["to"]), lambda y: F.struct(y["to"].alias("to"), (x["d"] + y["d"]).alias("d"))))

    return F.transform(F.aggregate(rounds, state, jump), lambda x: x["d"])


def leaf_depths(depths: Column) -> Column:
    return F.slice(depths, F.lit(1), (F.size(depths) / 2).cast("int") + 1)


def sackin(depths: Column) -> Column:
    """The sum of the leaves' depths (topological)."""
    return F.aggregate(leaf_depths(depths), F.lit(0.0), lambda a, d: a + d).cast("long")


@_once
def leaves_below(rows: Column) -> Column:
    """The number of leaves below every node, itself at a leaf: a fold up the ancestry."""
    k = F.size(rows)
    below = lambda acc, c: F.when(c <= k, 1).otherwise(F.get(acc, c - k - 1))
    inner = F.aggregate(rows, _empty("array<int>"), lambda acc, r: F.array_append(acc, below(acc, r["c1"]) + below(acc, r["c2"])))
    return F.concat(F.array_repeat(F.lit(1), k + 1), inner)


@_once
def sackin_with_leaf(depths: Column, below: Column) -> Column:
    """The Sackin index with one leaf more above each node, from all nodes' depths and the leaves below them.

    The leaf takes the node's branch: what is below it goes down by one, and the leaf is as deep as the node is then.
    """
    return _let(sackin(depths), lambda now: F.zip_with(depths, below, lambda d, n: now + n + d.cast("long") + 1))


def leaf_depth_variance(depths: Column) -> Column:
    """The population variance of the leaves' depths."""
    leaves = leaf_depths(depths)
    n = F.size(leaves).cast("double")
    total = F.aggregate(leaves, F.lit(0.0), lambda a, d: a + d)
    squares = F.aggregate(leaves, F.lit(0.0), lambda a, d: a + d * d)
    return squares / n - (total / n) * (total / n)


def b2(depths: Column) -> Column:
    """The sum of d / 2^d over the leaves."""
    return F.aggregate(leaf_depths(depths), F.lit(0.0), lambda a, d: a + d * F.pow(F.lit(2.0), -d))


@_once
def common_ancestor(up: Column, a: Column, b: Column, steps: Column) -> Column:
    """The lowest node above both: labels grow upwards, so of two nodes the smaller goes to its parent until they meet, which they do within ``steps``."""

    def climb(s, _):
        lower, higher = F.least(s["a"], s["b"]), F.greatest(s["a"], s["b"])
        return F.when(s["a"] == s["b"], s).otherwise(F.struct(F.get(up, lower).alias("a"), higher.alias("b")))

    start = F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))
    return F.aggregate(F.sequence(F.lit(0), steps.cast("int")), start, climb, lambda s: s["a"])


@_once
def splits(rows: Column) -> Column:
    """The distinct non-trivial splits of the leaves by a branch: the smaller side, of equal sides the one with leaf 0; sorted leaves."""
    k = F.size(rows)

    def step(acc, r):
        def leaves(c):
            return F.when(c <= k, F.array(c)).otherwise(F.get(acc, c - k - 1))

        return F.array_append(acc, F.concat(leaves(r["c1"]), leaves(r["c2"])))

    clades = F.transform(F.aggregate(rows, _empty("array<array<int>>"), step), lambda c: F.array_sort(c))
    inner = F.filter(clades, lambda c: (F.size(c) > 1) & (F.size(c) < k))

    def canonical(c):
        rest = F.array_except(F.sequence(F.lit(0), k), c)
        smaller = (2 * F.size(c) < k + 1) | ((2 * F.size(c) == k + 1) & F.array_contains(c, 0))
        return F.when(smaller, c).otherwise(rest)

    return F.array_distinct(F.transform(inner, canonical))


def robinson_foulds(a: Column, b: Column, normalize: bool = False) -> Column:
    """The number of splits in one tree only, from both trees' splits; normalised by their total (0 for no splits)."""
    apart = (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).cast("double")
    if not normalize:
        return apart
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(apart / total)


# -- editing


def without_leaf(rows: Column, leaf: Column) -> Column:
    """(rows, sister): the ancestry without a leaf, and what was its sister in the old labels; no such leaf is an error."""
    k = F.size(rows)
    held = F.filter(rows, lambda r: (r["c1"] == leaf) | (r["c2"] == leaf)).getItem(0)
    held = F.when((leaf < 0) | (leaf > k), F.raise_error(F.concat(F.lit("no leaf "), leaf.cast("string"))).cast("struct<c1:int,c2:int,p:int>")).otherwise(held)

    def result(h):
        sister, parent = F.when(h["c1"] == leaf, h["c2"]).otherwise(h["c1"]), h["p"]

        def label(c):
            to = F.when(c == parent, sister).otherwise(c)
            return to - (to > leaf).cast("int") - (to >= parent).cast("int")

        left = F.filter(rows, lambda r: r["p"] != parent)
        new = F.transform(left, lambda r: F.struct(label(r["c1"]).alias("c1"), label(r["c2"]).alias("c2"), label(r["p"]).alias("p")))
        return F.struct(new.alias("rows"), sister.alias("sister"))

    return F.transform(F.array(held), result).getItem(0)


@_once
def order_by_sister(pairs: Column, lengths: bool = False) -> Column:
    """(s, r, c1, c2) of unlabelled cherries (the smallest leaves of both sides) in merge order; ``r`` is the old place.

    A row goes by the smallest leaf that was added so far to its smaller leaf, downwards; ties keep their order.
    With ``lengths`` a row's b1 and b2 go along, the smaller leaf's first.
    """

    def keyed(e, r):
        low, high = F.least(e["c1"], e["c2"]), F.greatest(e["c1"], e["c2"])
        same = F.filter(F.slice(pairs, F.lit(1), r + 1), lambda o: F.least(o["c1"], o["c2"]) == low)
        sister = F.array_min(F.transform(same, lambda o: F.greatest(o["c1"], o["c2"])))
        first = e["c1"] < e["c2"]
        more = [F.when(first, e["b1"]).otherwise(e["b2"]).alias("b1"), F.when(first, e["b2"]).otherwise(e["b1"]).alias("b2")] if lengths else []
        return F.struct((-sister).alias("s"), r.alias("r"), low.alias("c1"), high.alias("c2"), *more)

    return F.sort_array(F.transform(pairs, keyed))


def relabelled(rows: Column, leaf: Column) -> Column:
    """The ancestry of v with a branch appended, its newest leaf called ``leaf``; labels of leaves from ``leaf`` on move up by one."""
    last = F.size(rows)
    label = lambda c: F.when(c > last, c).when(c == last, leaf).otherwise(c + (c >= leaf).cast("int"))
    return F.transform(rows, lambda r: F.struct(label(r["c1"]).alias("c1"), label(r["c2"]).alias("c2"), r["p"].alias("p")))
