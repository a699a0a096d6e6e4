"""Column functions on Newick strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .trees import _empty

# The patterns of the format.
PARENT = r"\)(\d+)"
LENGTH = r":\d+(\.\d+)?([eE][+-]?\d+)?"
LEFT_INTEGER, RIGHT_INTEGER = r"\(\b(\d+)\b", r",\b(\d+)\b"
LEFT_ANY, RIGHT_ANY = r"\(\b(\w+)\b", r",\b(\w+)\b"
#: A closing bracket with what is written on it, or a leaf with what is written on it.
TOKEN = r"(\)[^,();]*|[^,();]+)"
#: Every piece of a string: brackets, commas, the end, and labels.
PIECE = r"([(),;]|[^(),;]+)"

NODES = "array<struct<c1:int,c2:int,p:int,b1:double,b2:double>>"


def has_parents(newick: Column) -> Column:
    return newick.rlike(PARENT)


def has_branch_lengths(newick: Column) -> Column:
    return newick.rlike(LENGTH)


def has_integer_labels(newick: Column) -> Column:
    """As many leaves that are numbers as leaves, on either side of a comma."""
    n = lambda p: F.regexp_count(newick, F.lit(p))
    return (n(LEFT_INTEGER) == n(LEFT_ANY)) & (n(RIGHT_INTEGER) == n(RIGHT_ANY))


def find_num_leaves(newick: Column) -> Column:
    return F.regexp_count(newick, F.lit(f"({LEFT_INTEGER})|({RIGHT_INTEGER})"))


def remove_parent_labels(newick: Column) -> Column:
    return F.regexp_replace(newick, PARENT, ")")


def remove_branch_lengths(newick: Column) -> Column:
    return F.regexp_replace(newick, LENGTH, "")


def tokens(newick: Column) -> Column:
    return F.regexp_extract_all(newick, F.lit(TOKEN), F.lit(1))


def is_binary(newick: Column) -> Column:
    """Each bracket holds two: one leaf more than brackets."""
    count = lambda p: F.regexp_count(newick, F.lit(p))
    return count(r"[(,][^(),;]") == count(r"\(") + 1


def parse(newick_tokens: Column, lengths: bool = False) -> Column:
    """Rows (c1, c2, p, b1, b2) in the order of their closing brackets.

    Without a parent's label p is the larger child and the smaller one goes on in its place. With ``lengths``, a child
    without a length is an error; without, lengths are ignored and null.
    """

    def step(acc, t):
        stack, rows = acc["stack"], acc["rows"]
        name = F.get(F.split(F.regexp_replace(t, r"^\)", ""), ":"), F.lit(0))
        leaf = F.struct(name.try_cast("int").alias("n"), F.when(F.contains(t, F.lit(":")), F.get(F.split(t, ":"), F.lit(1)).try_cast("double")).alias("b"))
        n = F.size(stack)
        one, two = F.get(stack, n - 2), F.get(stack, n - 1)
        p = F.coalesce(name.try_cast("int"), F.greatest(one["n"], two["n"]))
        up = F.coalesce(name.try_cast("int"), F.least(one["n"], two["n"]))
        side = lambda b: F.coalesce(b, F.raise_error(F.lit("no branch length")).cast("double")) if lengths else F.lit(None).cast("double")
        row = F.struct(one["n"].alias("c1"), two["n"].alias("c2"), p.alias("p"), side(one["b"]).alias("b1"), side(two["b"]).alias("b2"))
        closed = F.struct(F.array_append(F.slice(stack, F.lit(1), F.greatest(n - 2, F.lit(0))), F.struct(up.alias("n"), leaf["b"].alias("b"))).alias("stack"), F.array_append(rows, row).alias("rows"))
        opened = F.struct(F.array_append(stack, leaf).alias("stack"), rows.alias("rows"))
        return F.when(t.startswith(")"), closed).otherwise(opened)

    start = F.struct(_empty("array<struct<n:int,b:double>>").alias("stack"), _empty(NODES).alias("rows"))
    return F.aggregate(newick_tokens, start, step, lambda acc: acc["rows"])


def by_parent(rows: Column) -> Column:
    """Labelled rows in order of their parents' labels."""
    keyed = F.transform(rows, lambda r: F.struct(r["p"].alias("p"), r["c1"].alias("c1"), r["c2"].alias("c2"), r["b1"].alias("b1"), r["b2"].alias("b2")))
    return F.sort_array(keyed)


def oriented(rows: Column, least: Column) -> Column:
    """Lengths with the child of the smaller leaf first, row by row."""
    return F.zip_with(rows, least, lambda r, m: F.when(m["c1"] < m["c2"], F.struct(r["b1"], r["b2"])).otherwise(F.struct(r["b2"].alias("b1"), r["b1"].alias("b2"))))


def label_pieces(newick: Column) -> Column:
    """Pieces of a string without its parents' labels: brackets and commas as they are, leaves with their lengths."""
    bare = F.regexp_replace(newick, r"\)[^(),;:]+", ")")
    return F.regexp_extract_all(bare, F.lit(PIECE), F.lit(1))


def _is_leaf(piece: Column, before: Column) -> Column:
    return ~piece.isin("(", ")", ",", ";") & (before.isNull() | before.isin("(", ","))


def taxa(pieces: Column) -> Column:
    """The names of the leaves in order of appearance."""
    numbered = F.transform(pieces, lambda x, i: F.struct(x.alias("x"), F.when(i > 0, F.get(pieces, i - 1)).alias("before")))
    return F.transform(F.filter(numbered, lambda e: _is_leaf(e["x"], e["before"])), lambda e: F.get(F.split(e["x"], ":"), F.lit(0)))


def numbered(pieces: Column) -> Column:
    """The string with each leaf's name replaced by its place among the leaves."""

    def step(acc, x):
        leaf = ~x.isin("(", ")", ",", ";") & (acc["open"])
        text = F.when(leaf, F.concat(acc["n"].cast("string"), F.regexp_extract(x, r"^[^:]*(.*)$", 1))).otherwise(x)
        return F.struct((acc["n"] + leaf.cast("int")).alias("n"), x.isin("(", ",").alias("open"), F.array_append(acc["out"], text).alias("out"))

    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("open"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(pieces, start, step, lambda acc: F.array_join(acc["out"], ""))


def named(pieces: Column, names: Column) -> Column:
    """The string with each leaf's number replaced by ``names[number]`` (a map or an array); an unknown one is an error."""

    def name(x):
        label = F.get(F.split(x, ":"), F.lit(0)).try_cast("int")
        found = F.coalesce(F.try_element_at(names, label), F.raise_error(F.concat(F.lit("no name for leaf "), x)).cast("string"))
        return F.concat(found, F.regexp_extract(x, r"^[^:]*(.*)$", 1))

    out = F.transform(pieces, lambda x, i: F.when(_is_leaf(x, F.when(i > 0, F.get(pieces, i - 1))), name(x)).otherwise(x))
    return F.array_join(out, "")
