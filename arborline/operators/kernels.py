"""Arrow kernels for trees whose size makes in-row folds slow, and for what the built-in functions can't express.

Each works on batches of whole trees in ``mapInArrow``: no shuffle, memory bounded by a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import stages

#: From so many places of v on, kernels take over from folds.
LARGE = 256


def pairs(v: list[int]) -> list[tuple[int, int]]:
    """(branch, new leaf) in merge order, in k log k.

    Pair i is put at a place of a list of i pairs. Backwards, the last one put has its place for good, so each takes
    the free place of that rank, found in a tree of counts. A pair put after another shares its branch: that is the
    nearest to its left that was put earlier.
    """
    k = len(v)
    place = []
    for i, x in enumerate(v):
        if not 0 <= x <= 2 * i:
            raise ValueError(f"Validation failed: v[{i}] = {x} is out of bounds (max = {2 * i})")
        place.append(max(x - i, 0))
    size = 1 << max(k - 1, 0).bit_length()
    free = [0] * (size + 1)
    for i in range(1, size + 1):
        free[i] = i & -i if i <= k else max(0, k - (i - (i & -i)))
    order = [0] * k
    for i in range(k - 1, -1, -1):
        # the largest prefix with no more free places than the rank
        at, rest, step = 0, place[i], size
        while step:
            if at + step <= size and free[at + step] <= rest:
                at += step
                rest -= free[at]
            step >>= 1
        order[at] = i
        at += 1
        while at <= size:
            free[at] -= 1
            at += at & -at
    branch, stack = [0] * k, []
    for i in order:
        while stack and stack[-1] > i:
            stack.pop()
        branch[i] = branch[stack[-1]] if place[i] else v[i]
        stack.append(i)
    return [(branch[i], i + 1) for i in order]


def ancestry(v: list[int]) -> list[tuple[int, int, int]]:
    k = len(v)
    now = list(range(k + 1))
    rows = []
    for r, (a, b) in enumerate(pairs(v)):
        rows.append((now[a], now[b], k + 1 + r))
        now[a] = k + 1 + r
    return rows


def vector(low_high: list[tuple[int, int]]) -> list[int]:
    """The vector of cherries (smallest leaves of both sides) in merge order, with counts in a binary indexed tree."""
    k = len(low_high)
    tree = [0] * (k + 2)
    v = [0] * k
    for a, b in low_high:
        low, high = min(a, b), max(a, b)
        before, i = 0, high - 1
        while i > 0:
            before += tree[i]
            i &= i - 1
        v[high - 1] = low if before == 0 else high - 1 + before
        i = high
        while i <= k + 1:
            tree[i] += 1
            i += i & -i
    return v


def least(rows: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Smallest leaves under both children; rows have children before parents."""
    low: dict[int, int] = {}
    out = []
    for a, b, p in rows:
        x, y = low.get(a, a), low.get(b, b)
        out.append((x, y))
        low[p] = min(x, y)
    return out


def newick(v: list[int], bls: list[tuple[float, float]] | None = None) -> str:
    """Nested brackets, written from the root down without copying texts."""
    k = len(v)
    rows = ancestry(v)
    if not rows:
        return "0;"
    out: list[str] = []
    todo: list = [(2 * k, "")]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        n, tail = item
        if n <= k:
            out.append(f"{n}{tail}")
            continue
        a, b, p = rows[n - k - 1]
        la, lb = (("", "") if bls is None else tuple(f":{x!r}" for x in bls[n - k - 1]))
        todo += [f"){p}{tail}", (b, lb), ",", (a, la), "("]
    return "".join(out) + ";"


def by_sister(low_high: list[tuple[int, int]]) -> list[int]:
    """Places of unlabelled cherries in merge order."""
    seen: dict[int, int] = {}
    key = []
    for a, b in low_high:
        low, high = min(a, b), max(a, b)
        seen[low] = min(seen.get(low, high), high)
        key.append(seen[low])
    return sorted(range(len(key)), key=lambda r: -key[r])


def parse(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[float | None, float | None]], bool]:
    """Rows in closing order (children as written; without labels the smaller leaf stands for a node), lengths, and whether parents are labelled."""
    stack: list[tuple[int, float | None]] = []
    rows, lengths, labelled = [], [], False
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "(,;" or c.isspace():
            i += 1
            continue
        j = i + (c == ")")
        while j < n and text[j] not in "(),;":
            j += 1
        name, _, length = text[i + (c == ")") : j].partition(":")
        bl = float(length) if length else None
        if c == ")":
            if len(stack) < 2:
                raise ValueError(f"not a binary tree: {text[:80]}")
            (b, y), (a, x) = stack.pop(), stack.pop()
            labelled |= name.isdigit()
            p = int(name) if name.isdigit() else max(a, b)
            rows.append((a, b, p))
            lengths.append((x, y))
            stack.append((p if name.isdigit() else min(a, b), bl))
        else:
            stack.append((int(name), bl))
        i = j
    if len(stack) > 1:
        raise ValueError(f"not a binary tree: {text[:80]}")
    return rows, lengths, labelled


def from_newick(text: str) -> tuple[list[int], list[tuple[float | None, float | None]]]:
    rows, lengths, labelled = parse(text)
    if labelled:
        order = sorted(range(len(rows)), key=lambda r: rows[r][2])
        low = least([rows[r] for r in order])
    else:
        order = by_sister([(a, b) for a, b, _ in rows])
        low = [rows[r][:2] for r in order]
    swapped = [lengths[r] if a < b else lengths[r][::-1] for r, (a, b) in zip(order, low, strict=True)]
    return vector(low), swapped


def shuffle(v: list[int], shuffle_cherries: bool = False, seed: int = 0) -> tuple[list[int], list[int]]:
    """(ordered vector, mapping): leaves renamed in the order in which a walk by levels from the root meets them.

    The second child of a row is met first and keeps the leaf that stands for the row, the other gets the next
    leaf; mapping[new] = old leaf.
    With ``shuffle_cherries`` the two children of each row are met in random order.
    """
    k = len(v)
    rows = ancestry(v)
    if not rows:
        return [], [0]
    rng = np.random.default_rng(seed)
    new_v: list[int] = [0] * k
    mapping = [0] * (k + 1)
    queue = [(2 * k, 0)]
    added = 0
    for node, leaf in queue:  # grows while it is walked
        if node <= k:
            mapping[leaf] = node
            continue
        second, first, _ = rows[node - k - 1]
        if shuffle_cherries and rng.random() < 0.5:
            first, second = second, first
        new_v[added] = leaf
        added += 1
        queue += [(first, leaf), (second, added)]
    return new_v, mapping


def reroot(v: list[int], node: int, bls: list[tuple[float, float]] | None = None) -> tuple[list[int], list[tuple[float, float]] | None]:
    """The tree with its root on the branch above ``node``; that branch is halved, and the old root's two branches become one."""
    k = len(v)
    if not 0 <= node < 2 * k:
        raise ValueError(f"no branch above node {node}")
    rows = ancestry(v)
    near: dict[int, list[tuple[int, float]]] = {}

    def link(a, b, w):
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))

    for r, (a, b, p) in enumerate(rows):
        x, y = (1.0, 1.0) if bls is None else bls[r]
        if p == 2 * k:
            link(a, b, x + y)
        else:
            link(a, p, x)
            link(b, p, y)
    parent = next(p for a, b, p in rows if node in (a, b))
    other = parent if parent != 2 * k else next(b if a == node else a for a, b, p in rows if p == parent)
    whole = next(w for n, w in near[node] if n == other)
    # walk both halves from the new root; a node follows its children in the reverse of the walk
    walk: list[tuple[int, list[tuple[int, float]]]] = [(-1, [(node, whole / 2), (other, whole / 2)])]
    todo = [(node, other), (other, node)]
    while todo:
        n, came = todo.pop()
        children = [(m, w) for m, w in near[n] if m != came]
        if children:
            walk.append((n, children))
            todo += [(m, n) for m, _ in children]
    made = [(a, b, p) for p, ((a, _), (b, _)) in reversed(walk)]
    lengths = [(x, y) for _, ((_, x), (_, y)) in reversed(walk)]
    low = least(made)
    order = by_sister(low)
    out = [lengths[r] if low[r][0] < low[r][1] else lengths[r][::-1] for r in order]
    return vector([low[r] for r in order]), None if bls is None else out


def precision(c1: np.ndarray, c2: np.ndarray, p: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """The inverses of the leaves' covariances of trees of one size (a row each), by eliminating the inner nodes of their Laplacians together."""
    m, k = c1.shape
    full = np.zeros((m, 2 * k + 1, 2 * k + 1))
    at = np.arange(m)[:, None]
    for child, length in ((c1, b1), (c2, b2)):
        w = 1.0 / length
        full[at, child, child] += w
        np.add.at(full, (at, p, p), w)
        full[at, child, p] -= w
        full[at, p, child] -= w
    full, n = full[:, :-1, :-1], k + 1
    if k == 1:
        return full
    return full[:, :n, :n] - full[:, :n, n:] @ np.linalg.solve(full[:, n:, n:], full[:, n:, :n])


def mapped(trees: DataFrame, schema: str, f: Callable[[dict], dict]) -> DataFrame:
    """Apply a function of one row (as a dict) to all rows, in Arrow batches."""
    names = [c.strip().split(" ")[0] for c in _split(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 1024):
                out = [f(row) for row in batch.slice(a, 1024).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], t) for c, t in zip(names, types, strict=True)], names)

    from pyspark.sql.pandas.types import to_arrow_type

    kind = trees.sparkSession.createDataFrame([], schema).schema
    types = [to_arrow_type(x.dataType) for x in kind]
    return trees.mapInArrow(run, schema)


def _split(schema: str) -> list[str]:
    """Cut a schema at its outer commas."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


def _bls(row: dict) -> list[tuple[float, float]] | None:
    return None if row.get("bls") is None else [(b["b1"], b["b2"]) for b in row["bls"]]


def newicks(trees: DataFrame, lengths: bool = False, large: int = LARGE) -> DataFrame:
    """(tree_id, newick): small trees by folds in the JVM, trees of more than ``large`` places by the kernel."""
    # the fold itself sees no large tree, wherever the optimiser puts the filter
    few = F.when(F.size("v") <= large, F.col("v"))
    small = stages.newick(trees.where(F.size("v") <= large).withColumn("v", few), lengths).select("tree_id", "newick")
    kind = trees.schema["tree_id"].dataType.simpleString()
    wanted = trees.where(F.size("v") > large).select("tree_id", "v", *(["bls"] if lengths else []))
    return small.union(mapped(wanted, f"tree_id {kind}, newick string", lambda r: {"tree_id": r["tree_id"], "newick": newick(r["v"], _bls(r) if lengths else None)}))


def vectors(trees: DataFrame, large: int = LARGE) -> DataFrame:
    """(tree_id, v) of a table of integer Newick strings, split by the number of commas."""
    size = F.length("newick") - F.length(F.replace(F.col("newick"), F.lit(",")))
    few = F.when(size <= large, F.col("newick"))
    small = stages.vector_of_newick(trees.where(size <= large).withColumn("newick", few)).select("tree_id", "v")
    kind = trees.schema["tree_id"].dataType.simpleString()
    return small.union(mapped(trees.where(size > large).select("tree_id", "newick"), f"tree_id {kind}, v array<int>", lambda r: {"tree_id": r["tree_id"], "v": from_newick(r["newick"])[0]}))


def with_rows(trees: DataFrame, large: int = LARGE) -> DataFrame:
    """The trees with ``rows`` (their ancestry), by folds or, for more than ``large`` places, by the kernel.

    Stages and relations take ``rows`` as they find them, so depths, ancestors, balance or incidence of large trees cost
    k log k from here on.
    """
    few = F.when(F.size("v") <= large, F.col("v"))
    small = stages.ancestry(trees.where(F.size("v") <= large).withColumn("v", few)).drop("pairs")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in trees.schema)
    names = [f.name for f in trees.schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("c1", pa.int32()), ("c2", pa.int32()), ("p", pa.int32())]))
        for whole in batches:
            for i in range(len(whole)):
                batch = whole.slice(i, 1)
                rows = np.array(ancestry(batch.column(names.index("v"))[0].as_py()), np.int32).T
                made = pa.StructArray.from_arrays([pa.array(c) for c in rows], ["c1", "c2", "p"])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array([0, len(made)], pa.int32()), made).cast(kind)], [*names, "rows"])

    return small.unionByName(trees.where(F.size("v") > large).mapInArrow(run, f"{fields}, rows array<struct<c1:int,c2:int,p:int>>"))


def queue_shuffle(trees: DataFrame, shuffle_cherries: bool = False, seed: int = 0) -> DataFrame:
    """(tree_id, v, mapping)."""
    kind = trees.schema["tree_id"].dataType.simpleString()

    def one(r):
        v, m = shuffle(r["v"], shuffle_cherries, seed)
        return {"tree_id": r["tree_id"], "v": v, "mapping": m}

    return mapped(trees.select("tree_id", "v"), f"tree_id {kind}, v array<int>, mapping array<int>", one)


def rerooted(trees: DataFrame, node: str = "node") -> DataFrame:
    """(tree_id, v, bls) with the root above the node in column ``node``; bls is null where there are no lengths."""
    kind = trees.schema["tree_id"].dataType.simpleString()
    columns = ["tree_id", "v", *(["bls"] if "bls" in trees.columns else []), F.col(node).alias("node")]

    def one(r):
        v, b = reroot(r["v"], r["node"], _bls(r))
        return {"tree_id": r["tree_id"], "v": v, "bls": None if b is None else [{"b1": x, "b2": y} for x, y in b]}

    return mapped(trees.select(*columns), f"tree_id {kind}, v array<int>, bls array<struct<b1:double,b2:double>>", one)


def reroot_at_random(trees: DataFrame, seed: int = 0) -> DataFrame:
    """The same at a node drawn from a hash of the tree's id."""
    return rerooted(trees.withColumn("_node", F.pmod(F.xxhash64("tree_id", F.lit(seed)), 2 * F.size("v")).cast("int")), "_node")


def covariance(c1: np.ndarray, c2: np.ndarray, p: np.ndarray, b1: np.ndarray, b2: np.ndarray) -> np.ndarray:
    """The leaves' covariances of trees of one size (a row each): what leaves share of their ways from the root, branch by branch."""
    m, k = c1.shape
    at, under = np.arange(m), np.zeros((m, 2 * k + 1, k + 1))
    under[:, np.arange(k + 1), np.arange(k + 1)] = 1.0
    out = np.zeros((m, k + 1, k + 1))
    for r in range(k):
        for child, length in ((c1[:, r], b1[:, r]), (c2[:, r], b2[:, r])):
            leaves = under[at, child]
            out += length[:, None, None] * leaves[:, :, None] * leaves[:, None, :]
            under[at, p[:, r]] += leaves
    return out


def _matrices(trees: DataFrame, lengths: bool, f: Callable[..., np.ndarray]) -> DataFrame:
    """(tree_id, row, col, value) of a matrix of the leaves of every tree with a branch; trees of one size in a batch go to ``f`` together."""
    kind = trees.schema["tree_id"].dataType.simpleString()
    one = F.transform("rows", lambda r: F.struct(F.lit(1.0).alias("b1"), F.lit(1.0).alias("b2")))
    wanted = stages.ancestry(trees.where(F.size("v") > 0)).select("tree_id", "rows", (F.col("bls") if lengths else one).alias("bls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column(1).value_lengths().to_numpy()
            for k in np.unique(sizes).tolist():
                every = whole.filter(pa.array(sizes == k))
                # a few megabytes of matrices at a time
                step = max(1, (1 << 20) // (2 * k + 1) ** 2)
                for a in range(0, len(every), step):
                    part = every.slice(a, step)
                    flat = lambda c, f: part.column(c).flatten().field(f).to_numpy(zero_copy_only=False).reshape(len(part), k)  # noqa: B023, E731
                    made = f(*(flat(1, f) for f in ("c1", "c2", "p")), *(flat(2, f) for f in ("b1", "b2")))
                    n, cells = len(part), (k + 1) ** 2
                    place = np.tile(np.arange(cells), n)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(n), cells))), pa.array(place // (k + 1), pa.int32()), pa.array(place % (k + 1), pa.int32()), pa.array(made.ravel())], ["tree_id", "row", "col", "value"])

    return wanted.mapInArrow(run, f"tree_id {kind}, row int, col int, value double")


def precisions(trees: DataFrame, lengths: bool = False) -> DataFrame:
    """(tree_id, row, col, value) of the precision matrix of every tree with a branch."""
    return _matrices(trees, lengths, precision)


def precision_products(trees: DataFrame, lengths: bool = False) -> DataFrame:
    """(tree_id, row, col, value) of the precision times the covariance of every tree with a branch, multiplied where the tree stands: nothing is joined."""
    return _matrices(trees, lengths, lambda *tree: precision(*tree) @ covariance(*tree))
