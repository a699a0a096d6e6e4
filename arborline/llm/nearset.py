"""Near-duplicate documents by SuperMinHash, banding, verification on full shingle sets, and components.

1. Words are hashed from Arrow's buffers, a text's distinct shingles form its set, and rows with equal sets are
   one class; only classes go on, so exact copies cost a row each.
2. SuperMinHash: each shingle draws a permutation of the signature's places by Fisher-Yates, one swap a level, and
   offers level + fraction at the level's place. Levels run over all shingles of a slice at once; a text stops at
   the first level that can't lower any of its places, which is early for all but short texts.
3. Bands of the signature are buckets. In a small bucket all pairs are candidates. In a larger one every class is
   compared with the bucket's most central one (it shares most buckets with others), so a group of copies costs a
   pair each. Links are confirmed on full sets.
4. Components of the links are formed. In buckets that still hold several, members of different components are
   compared in blocks by signature, and a pair of blocks returns the members that have a partner whose estimate is
   within seven deviations of the threshold. Only those meet again, with their full sets. So no link that shares a
   bucket is left unseen, though pairs are never listed (a pair of blocks returns a spanning forest of its links), and
   full sets travel only where signatures leave the question open.

With 32 bands of 4 a pair at the threshold shares no bucket with probability 5e-8.

Defined results: a null or empty text has an empty set and links with nothing (repeated empty rows neither); a
text of fewer words than a shingle has its whole sequence as one; a null id is never a component's name unless
all ids in it are null; repeated rows are linked; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import materialize, scratch
from .textbytes import mix, slices, spans_hash, words

PLACES, BANDS = 128, 32
ROWS = PLACES // BANDS
#: Buckets up to this size are compared pair by pair.
SMALL = 6
#: Members, and hashes of sets, of a block where components of a bucket are compared.
BLOCK, BLOCK_HASHES = 512, 1 << 19
#: Signatures are kept as 16 bits a place; classes below this estimate are not linked at 0.8 (over seven deviations).
LOWEST = 0.55

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each text, and the offsets of the texts among them."""
    data = _LOWER[data]
    starts, ends, at = words(data, offsets)
    h = spans_hash(data, starts, ends)
    n = np.diff(at)
    salt = mix(np.arange(1, k + 1).astype(np.uint64)) | _U(1)
    grams = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        grams += h[j : len(h) - k + 1 + j] * salt[j]
    grams = mix(grams)
    out, sizes = [], np.zeros(len(n), np.int64)
    for i, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if b - a >= k:
            s = np.unique(grams[a : b - k + 1])
        elif b > a:
            s = mix(((h[a:b] * salt[: b - a]).sum(keepdims=True) ^ _U(b - a)) + _U(1))
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum(sizes)])


def superminhash(h: np.ndarray, at: np.ndarray, places: int = PLACES) -> np.ndarray:
    """Signatures (texts x places) of sets of hashes; the top byte of a value is its level."""
    n = len(at) - 1
    sig = np.full(n * places, np.iinfo(np.uint64).max, np.uint64)
    text = np.repeat(np.arange(n), np.diff(at))

    def fraction(hashes, level):
        return mix(hashes ^ mix(np.array([2 * level + 1], np.uint64))) >> _U(8)

    def swap(hashes, level):
        left = _U(places - level)
        return level + ((mix(hashes ^ mix(np.array([2 * level + 2], np.uint64))) >> _U(32)) * left >> _U(32)).astype(np.int64)

    place = swap(h, 0)
    np.minimum.at(sig, text * places + place, fraction(h, 0))
    perm = None
    for level in range(1, places):
        # a later level offers `level` at least, so texts whose places are all below it are done
        open_ = sig.reshape(n, places).max(1) >= _U(level << 56)
        still = open_[text]
        if not still.any():
            break
        if perm is None:
            h, text, place = h[still], text[still], place[still]
            perm = np.tile(np.arange(places, dtype=np.uint8), (len(h), 1))
            perm[np.arange(len(h)), place] = 0
            perm[:, 0] = place
        elif still.sum() < 0.7 * len(still):
            h, text, perm = h[still], text[still], perm[still]
        rows, j = np.arange(len(h)), swap(h, level)
        place = perm[rows, j].astype(np.int64)
        perm[rows, j] = perm[:, level]
        np.minimum.at(sig, text * places + place, fraction(h, level) | _U(level << 56))
    return sig.reshape(n, places)


def _signed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text hash, the set's fingerprint and size, and signature (16 bits a place) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                h, at = shingles(data, offsets, k)
                n = np.diff(at)
                sums = [np.concatenate([[_U(0)], np.cumsum(mix(h ^ _U(c)))]) for c in (1, 2)]
                a, b = ((s[at[1:]] - s[at[:-1]]).astype(np.int64) for s in sums)
                some = np.flatnonzero(n)
                sig = superminhash(h, np.concatenate([[0], np.cumsum(n[some])]))
                counts = (n > 0).astype(np.int32)
                short = (mix(sig.ravel()) & _U(0xFFFF)).astype("<u2").tobytes()
                ends = np.concatenate([[0], np.cumsum(counts * PLACES * 2)]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(a), pa.array(b), pa.array(n, pa.int64()), binary], ["doc_id", "th", "a", "b", "n", "sig"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    wanted = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    return wanted.mapInArrow(run, f"doc_id {kind}, th long, a long, b long, n long, sig binary")


def _sets(docs: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cid, n, members) of the given classes: the sorted hashes of each class's set, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for rows, data, offsets in slices(batch):
                h, at = shingles(data, offsets, k)
                cids = rows.column(0).to_pylist()
                # repeated rows of the representative meet side by side
                new = [i for i, c in enumerate(cids) if c != (cids[i - 1] if i else last)]
                last = cids[-1]
                yield pa.RecordBatch.from_arrays([pa.array([cids[i] for i in new], pa.int64()), pa.array([h[at[i] : at[i + 1]].tobytes() for i in new], pa.binary())], ["cid", "members"])

    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    wanted = classes.join(texts, F.col("rep.doc_id").eqNullSafe(F.col("_id")) & (F.col("rep.th") == F.col("_th"))).select("cid", "text")
    return wanted.mapInArrow(run, "cid long, members binary")


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (x, y) whose sets have percent of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for p, q in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (p, q))
                if min(len(a), len(b)) * 100 < max(len(a), len(b)) * percent:
                    keep.append(False)
                    continue
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                both = int((b[at] == a).sum())
                keep.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one = sets.select(F.col("cid").alias("x"), F.col("members").alias("xs"))
    two = sets.select(F.col("cid").alias("y"), F.col("members").alias("ys"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "xs", "ys").mapInArrow(run, "u long, v long")


class _Block:
    """Members of a pair of blocks: which pairs their signatures allow to be linked."""

    def __init__(self, key: tuple[pa.Scalar, ...], table: pa.Table, percent: int):
        self.band, self.percent = key[0].as_py(), percent
        self.sig = np.frombuffer(b"".join(x.as_py() for x in table["sig"]), "<u2").reshape(-1, PLACES)
        self.cid, comp, side, self.n = (table[c].to_numpy() for c in ("cid", "comp", "side", "n"))
        self.left = np.flatnonzero(side <= 0)
        self.right = self.left if key[2] == key[3] else np.flatnonzero(side > 0)
        _, self.root = np.unique(comp, return_inverse=True)

    def near(self, i: int) -> np.ndarray:
        """Members of the other side, in another component, that may be linked with member i and share no earlier band with it."""
        n, right = self.n, self.right
        others = right[(self.root[right] != self.root[i]) & (np.minimum(n[right], n[i]) * 100 >= self.percent * np.maximum(n[right], n[i]))]
        same = self.sig[others] == self.sig[i]
        fit = same.mean(1) >= LOWEST
        if self.band:
            fit &= ~same[:, : self.band * ROWS].reshape(len(others), self.band, ROWS).all(2).any(1)
        return others[fit]


_BLOCK_KEY = ["band", "key", "one", "two"]


def _open(blocks: DataFrame, percent: int) -> DataFrame:
    """The members of pairs of blocks that have a possible partner there, by signatures."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(key, table, percent)
        hit = np.zeros(len(block.cid), bool)
        for i in block.left.tolist():
            others = block.near(i)
            hit[others] = True
            hit[i] |= len(others) > 0
        return table.filter(pa.array(hit))

    return blocks.groupBy(*_BLOCK_KEY).applyInArrow(run, blocks.schema)


def _apart(blocks: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between members of different components in the same pair of blocks, as a spanning forest.

    Pairs whose signatures allow it are confirmed on the full sets, which lie in the blocks. A pair that shares
    several buckets is looked at in the first of them, and not at all once it is joined in this pair of blocks.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        block = _Block(key, table, percent)
        cid, n, root = block.cid, block.n, block.root
        ends = np.cumsum(n)
        _, element = np.unique(np.frombuffer(b"".join(x.as_py() for x in table["members"]), np.uint64), return_inverse=True)
        mark = np.zeros(len(element) + 1, bool)
        out = []
        for i in block.left.tolist():
            others = block.near(i)
            if not len(others):
                continue
            mark[element[ends[i] - n[i] : ends[i]]] = True
            sizes = n[others]
            stops = np.cumsum(sizes)
            at = np.arange(stops[-1]) + np.repeat(ends[others] - stops, sizes)
            both = np.add.reduceat(mark[element[at]].astype(np.int64), stops - sizes)
            mark[element[ends[i] - n[i] : ends[i]]] = False
            linked = others[100 * both >= percent * (n[i] + sizes - both)]
            roots, first = np.unique(root[linked], return_index=True)
            out += [(cid[i], cid[j]) for j in linked[first].tolist()]
            root[np.isin(root, roots)] = root[i]
        return pa.table({"u": pa.array([a for a, _ in out], pa.int64()), "v": pa.array([b for _, b in out], pa.int64())})

    return blocks.groupBy(*_BLOCK_KEY).applyInArrow(run, "u long, v long")


def _blocks(members: DataFrame) -> DataFrame:
    """Deal the members of each bucket of several components to pairs of blocks; side -1 or 1 tells the block, 0 both."""
    spread = F.pmod(F.xxhash64("cid"), F.col("n_blocks")).cast("int")
    m = members.withColumn("own", spread).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    side = F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1)
    return m.select("band", "key", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), "cid", "comp", "n", "sig", side.alias("side"))


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """doc_id, th (the text's hash), n_shingles, component_id and kept of every document."""
    with scratch(docs.sparkSession) as keep:
        return _grouped(docs, k, percent, keep)


def _grouped(docs: DataFrame, k: int, percent: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    rows = keep(materialize(_signed(docs, k), "signed"))
    grouped = rows.where("n > 0").groupBy("a", "b").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")).alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")

    held = classes.select("cid", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    held = held.select("cid", "n", "band", F.xxhash64(F.substring("sig", F.col("band") * (2 * ROWS) + 1, F.lit(2 * ROWS))).alias("key"))
    sizes = held.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1").withColumnsRenamed({"band": "_band", "key": "_key"})
    # the members of buckets that hold two or more
    shared = materialize(held.join(sizes, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).select("band", "key", "size", "cid", "n"), "shared")
    small = shared.where(F.col("size") <= SMALL).groupBy("band", "key").agg(F.collect_list(F.struct("cid", "n")).alias("m"))
    pair = F.explode(F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: b["cid"] > a["cid"]), lambda b: F.struct(a["cid"].alias("x"), a["n"].alias("xn"), b["cid"].alias("y"), b["n"].alias("yn"))))))
    close = small.select(pair.alias("p")).select("p.*")
    large = shared.where(F.col("size") > SMALL)
    centre = large.groupBy("cid").agg(F.sum("size").alias("centre")).withColumnRenamed("cid", "_cid")
    ranked = large.join(centre, F.col("cid") == F.col("_cid"))
    pivots = ranked.groupBy("band", "key").agg(F.max(F.struct("centre", (-F.col("cid")).alias("cid"), "n")).alias("p"))
    pivots = pivots.select(F.col("band").alias("_band"), F.col("key").alias("_key"), (-F.col("p.cid")).alias("pivot"), F.col("p.n").alias("pn"))
    star = large.join(pivots, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).where("cid <> pivot")
    star = star.select(F.least("cid", "pivot").alias("x"), F.when(F.col("cid") < F.col("pivot"), F.col("n")).otherwise(F.col("pn")).alias("xn"), F.greatest("cid", "pivot").alias("y"), F.when(F.col("cid") < F.col("pivot"), F.col("pn")).otherwise(F.col("n")).alias("yn"))
    fits = F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent
    pairs = materialize(close.union(star).where(fits).select("x", "y").distinct(), "pairs")

    # sets of all classes that share a bucket with any of a fitting size
    involved = pairs.select(F.col("x").alias("_cid")).union(pairs.select(F.col("y").alias("_cid"))).union(large.select(F.col("cid").alias("_cid"))).distinct()
    sets = materialize(_sets(docs, classes.join(involved, F.col("cid") == F.col("_cid")).select("cid", "rep"), k), "sets")
    links = materialize(_verify(pairs, sets, percent), "links")
    found = materialize(components(links), "roots")

    parted = large.join(found.withColumnRenamed("node", "_cid"), F.col("cid") == F.col("_cid"), "left").withColumn("comp", F.coalesce("root", "cid")).drop("root", "_cid")
    parted = materialize(parted, "parted")
    several = parted.groupBy("band", "key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("hashes")).where("c0 <> c1")
    n_blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("hashes") / F.lit(BLOCK_HASHES))).cast("int")
    several = several.select(F.col("band").alias("_band"), F.col("key").alias("_key"), n_blocks.alias("n_blocks"))
    members = parted.join(several, (F.col("band") == F.col("_band")) & (F.col("key") == F.col("_key"))).select("band", "key", "cid", "comp", "n", "n_blocks")
    signed = classes.select(F.col("cid").alias("_cid"), "sig")
    # one job: what the signatures leave open is joined with its sets as it comes
    still = _open(_blocks(members.join(signed, F.col("cid") == F.col("_cid"))), percent)
    more = _apart(still.join(sets.withColumnRenamed("cid", "_set"), F.col("cid") == F.col("_set")).drop("_set"), percent)
    more = materialize(more, "more")
    if more.limit(1).count():
        found = materialize(components(links.union(more)), "roots")

    owned = classes.select("a", "b", "rep", "cid").join(found, F.col("cid") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "cid"))
    owned = materialize(owned.select("a", "b", "rep", "comp"), "owned")
    names = owned.groupBy("comp").agg(F.min("rep").alias("first")).withColumnRenamed("comp", "_comp")
    named = keep(materialize(owned.join(names, F.col("comp") == F.col("_comp")).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "first"), "named"))
    full = rows.where("n > 0").select("doc_id", "th", "n", "a", "b").join(named, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
    first = (F.col("first.th") == F.col("th")) & F.col("first.doc_id").eqNullSafe(F.col("doc_id"))
    full = full.select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("first.doc_id").alias("component_id"), first.alias("first"))
    empty = rows.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return full.union(empty).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def component_report(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80) -> DataFrame:
    """One document of each component (the smallest id, of equal ids the smallest text hash), with its own columns; of repeated rows one stays."""
    found = materialize(near_duplicates(docs, k, percent).select("doc_id", "th", "first", F.col("n_shingles") > 0), "found")
    gone = found.where("NOT first").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).distinct()
    th = F.xxhash64(F.col("text"))
    kept = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (th == F.col("_th")), "left_anti")
    repeated = found.where("first").groupBy("doc_id", "th").count().where("count > 1")
    if repeated.limit(1).count() == 0:
        return kept
    names = docs.columns
    whole = kept.select(F.col("doc_id").alias("_id"), th.alias("_th"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    once = whole.groupBy("_id", "_th").agg(F.first("row").alias("row"))
    return once.select(*[F.col("row").getField(c).alias(c) for c in names])
