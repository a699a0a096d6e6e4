"""Removal of passages that occur more than once anywhere, by maximal repeats of an enhanced suffix array.

A window is LENGTH bytes. Its anchor is the GRAM bytes in it with the lowest hash (the leftmost of equals), so
equal windows have equal anchors at equal places. Windows next to each other that share an anchor are a run; a
text of n bytes has about 2n / (LENGTH - GRAM) runs, and only runs travel:

1. Runs whose anchor occurs once anywhere hold no repeated window and end there (counts by anchor).
2. Runs with equal bytes are one class, a string whose weight is their number.
3. Classes that share an anchor are put into one bucket; over a bucket's strings an enhanced suffix array is built, in
   which a suffix counts as often as its string weighs. The stack scan of its LCP array gives the common-prefix
   intervals of LENGTH or more, and those of a total weight of two or more with diverse left extensions are the maximal
   repeats, with all their occurrences, whose spans are removed from all rows of the class.
4. An anchor of more than CROWD classes (a passage with thousands of surroundings) is dealt to blocks, which are
   treated alike. Windows that occur once in their block are looked for in other blocks by a hash, with partial sums; a
   class that has such a window meets a witness, a class of another block with the same window, in a second round of
   suffix arrays. So no task holds a crowd, and hashes choose what is compared, but spans come from intervals alone.

Spans of a text are united, and the rest of its bytes is kept.

Defined results: a null or empty text has no bytes and nothing removed; texts shorter than LENGTH keep all;
repeated rows repeat each other, so all their windows go; a null id is kept; an empty table gives no rows. Only
doc_id and text are read (a text is told apart by its id and a 64-bit hash of its bytes).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, scratch
from .suffixes import intervals
from .textbytes import SLICE_BYTES, mix, slices

LENGTH, GRAM = 200, 40
WIDTH = LENGTH - GRAM + 1
#: Classes of one anchor that are compared in one bucket at most; bytes of a bucket, about.
CROWD, BUCKET_BYTES = 1000, 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))
_BYTES = mix(np.arange(256).astype(np.uint64))
_PLACE = _U((1 << 24) - 1)


class _Sums:
    """Prefix sums of a polynomial hash modulo 2**64 over up to 2**24 bytes."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        powers = np.full(n, _BASE)
        powers[:1] = 1
        self.down = np.full(n + 1, _INVERSE)
        self.down[0] = 1
        with np.errstate(over="ignore"):
            powers = np.multiply.accumulate(powers)
            self.down = np.multiply.accumulate(self.down)
            self.sums = np.concatenate([[_U(0)], np.cumsum(_BYTES[data] * powers, dtype=np.uint64)])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of texts: text, first window, last window, anchor's place, the anchor's hash and the hash of the run's bytes and anchor place."""
    count = np.maximum(np.diff(offsets) - LENGTH + 1, 0)
    some = np.flatnonzero(count)
    if not len(some):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    sums = _Sums(data)
    at = np.arange(len(data) - GRAM + 1)
    gram = sums.of(at, at + GRAM)
    low = np.full(-(-len(gram) // WIDTH) * WIDTH, np.iinfo(np.uint64).max, np.uint64)
    low[: len(gram)] = (gram & ~_PLACE) | at.astype(np.uint64)
    low = low.reshape(-1, WIDTH)
    # the minimum of any WIDTH neighbours: the end of one block and the start of the next
    head = np.minimum.accumulate(low, 1).ravel()
    tail = np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1].ravel()
    total = np.cumsum(count[some])
    window = np.arange(total[-1]) + np.repeat(offsets[some] - (total - count[some]), count[some])
    place = (np.minimum(tail[window], head[window + WIDTH - 1]) & _PLACE).astype(np.int64)
    new = np.ones(len(window), bool)
    new[1:] = (place[1:] != place[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    text = np.searchsorted(offsets, window[first], "right") - 1
    anchor, start, end = place[first], window[first], window[last]
    whole = mix(sums.of(start, end + LENGTH) ^ mix((anchor - start).astype(np.uint64)))
    return text, start, end, anchor, gram[anchor], whole


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, byte it begins at, bytes, offsets): texts over a slice in overlapping pieces, each window in one of them."""
    if len(offsets) > 2 or len(data) <= 2 * SLICE_BYTES:
        yield 0, 0, data, offsets
        return
    for a in range(0, max(1, len(data) - LENGTH + 1), SLICE_BYTES):
        part = data[a : a + SLICE_BYTES + LENGTH - 1]
        yield 0, a, part, np.array([0, len(part)])


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text")


def _runs(docs: DataFrame) -> DataFrame:
    """anchor, whole (hash), doc_id, th and at (first window, length in bytes and place of the anchor, packed) of every run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                for _, base, part, cuts in _pieces(data, offsets):
                    text, start, end, anchor, gram, whole = anchors(part, cuts)
                    which = pa.array(text)
                    at = (start - cuts[text] + base) << 20 | (end - start + LENGTH) << 10 | (anchor - start)
                    yield pa.RecordBatch.from_arrays([pa.array(gram.astype(np.int64)), pa.array(whole.astype(np.int64)), rows.column(0).take(which), rows.column(1).take(which), pa.array(at, pa.int64())], ["anchor", "whole", "doc_id", "th", "at"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _keyed(docs).mapInArrow(run, f"anchor long, whole long, doc_id {kind}, th long, at long")


def _text_join(docs: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """Texts with a one-row-a-text table keyed by (_id, _th)."""
    return _keyed(docs).join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), how)


def _bytes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The bytes of the classes' representatives."""
    wanted = classes.groupBy(F.col("rep.doc_id").alias("_id"), F.col("rep.th").alias("_th")).agg(F.collect_list(F.struct("anchor", "whole", "n", F.col("rep.at").alias("at"), "crowd", "members")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for row in range(len(batch)):
                key = (batch.column(0)[row].as_py(), batch.column(1)[row].as_py())
                if key == last:
                    continue  # repeated rows lie side by side
                last = key
                text = np.frombuffer(batch.column(2)[row].as_buffer(), np.uint8)
                runs = pa.RecordBatch.from_struct_array(batch.column(3)[row].values)
                at = runs.column(3).to_numpy()
                cut = [text[a : a + n].tobytes() for a, n in zip((at >> 20).tolist(), ((at >> 10) & 1023).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*runs.columns, pa.array(cut, pa.binary())], ["anchor", "whole", "n", "at", "crowd", "members", "bytes"])

    joined = _text_join(docs, wanted, "inner").select("doc_id", "th", "text", "runs")
    return joined.mapInArrow(run, "anchor long, whole long, n long, at long, crowd boolean, members long, bytes binary")


def maximal_repeats(strings: list[bytes], family: np.ndarray, least: int = LENGTH, weight: np.ndarray | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, strings, places) of the maximal repeats of ``least`` bytes or more in strings of the same family.

    The suffix array is sparse: it holds the suffixes of ``least`` bytes or more whose first half of that many bytes
    occurs again in the family, by a hash; they are sorted by all their bytes, so prefixes are exact. A string of weight
    two or more stands for so many rows: its longest suffix is a repeat by itself, and what stands before it is diverse.
    """
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings], np.int64)
    ends = np.cumsum(sizes)
    n = np.maximum(sizes - least + 1, 0)
    if not n.any():
        return []
    which = np.repeat(np.arange(len(strings)), n)
    at = np.arange(len(which)) - np.repeat(np.cumsum(n) - n - (ends - sizes), n)
    half = _Sums(data).of(at, at + least // 2) ^ mix(family.astype(np.uint64))[which]
    _, group, size = np.unique(half, return_inverse=True, return_counts=True)
    first = at == (ends - sizes)[which]
    copied = first & (weight[which] > 1) if weight is not None else np.zeros(len(at), bool)
    again = (size[group] > 1) | copied
    at, which, copied = at[again], which[again], copied[again]
    if not len(at):
        return []
    # of suffixes that differ only in zero bytes at their ends the shorter comes first
    order = np.argsort(ends[which] - at, kind="stable")
    at, which, copied = at[order], which[order], copied[order]
    left = ends[which] - at
    # a row for each suffix: its family, its bytes, and zeros after its end
    width = int(left.max())
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    table = np.lib.stride_tricks.sliding_window_view(padded, width)[at]
    table[np.arange(width) >= left[:, None]] = 0
    table = np.concatenate([family[which].astype(">u4").view(np.uint8).reshape(-1, 4), table], 1)
    sa = np.argsort(table.view(f"S{width + 4}").ravel(), kind="stable")
    lcp = np.zeros(len(sa), np.int64)
    for a in range(1, len(sa), 65_536):
        b = min(len(sa), a + 65_536)
        apart = table[sa[a:b]] != table[sa[a - 1 : b - 1]]
        lcp[a:b] = np.where(apart.any(1), apart.argmax(1), width + 4) - 4
    lcp[1:] = np.minimum(lcp[1:], np.minimum(left[sa[1:]], left[sa[:-1]]))
    # what stands before a suffix; nothing at the start of a string, which is unlike all else
    before = np.where(at == (ends - sizes)[which], -1 - which, data[np.maximum(at - 1, 0)].astype(np.int64))[sa]
    change = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    place = at - (ends - sizes)[which]
    alone = np.flatnonzero(copied[sa])
    found = [(length, a, b) for length, a, b in intervals(lcp, least) if change[b] > change[a]]
    found += zip(left[sa[alone]].tolist(), alone.tolist(), alone.tolist(), strict=True)
    return [(length, which[sa[a : b + 1]], place[sa[a : b + 1]]) for length, a, b in found]


def _edges(table: pa.Table) -> pa.Table:
    """Spans of the maximal repeats in classes, as (anchor, whole, first byte, bytes)."""
    strings = [v.as_py() for v in table["bytes"]]
    families, family = np.unique(table["anchor"].to_numpy(), return_inverse=True)
    size = np.array([len(s) for s in strings], np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    marks = np.zeros(base[-1] + 1, np.int64)
    for length, which, place in maximal_repeats(strings, family, weight=table["n"].to_numpy()):
        np.add.at(marks, base[which] + place, 1)
        np.add.at(marks, base[which] + np.minimum(place + length, size[which]), -1)
    covered = np.concatenate([[0], (np.cumsum(marks[:-1]) > 0).astype(np.int64), [0]])
    start, end = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
    which = np.searchsorted(base, start, "right") - 1
    return pa.table({"anchor": table["anchor"].take(pa.array(which)), "whole": table["whole"].take(pa.array(which)), "start": pa.array(start - base[which], pa.int64()), "size": pa.array(end - start, pa.int64())})


def _ranges(flags: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the runs of set flags, each within a string."""
    padded = np.concatenate([[False], flags, [False]])
    cut = np.zeros(len(flags) + 1, bool)
    cut[1:-1] = string[1:] != string[:-1]
    start = np.flatnonzero(padded[1:-1] & (~padded[:-2] | cut[:-1]))
    end = np.flatnonzero(padded[1:-1] & (~padded[2:] | cut[1:])) + 1
    return start, end - start


def _block(table: pa.Table) -> pa.Table:
    """A block of a crowd: spans repeated inside it ("span"), and ranges of windows to look for in other blocks.

    The latter are windows that occur once here, in a class of one ("ask"), and one occurrence of each other ("show").
    """
    spans = _edges(table)
    strings = [v.as_py() for v in table["bytes"]]
    sizes = np.array([len(x) for x in strings], np.int64)
    n = sizes - LENGTH + 1
    string = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(string)) - np.repeat(np.cumsum(n) - n, n)
    p = place + (np.cumsum(sizes) - sizes)[string]
    _, first, group, count = np.unique(_Sums(np.frombuffer(b"".join(strings), np.uint8)).of(p, p + LENGTH), return_index=True, return_inverse=True, return_counts=True)
    ask = (count[group] == 1) & (table["n"].to_numpy()[string] == 1)
    show = np.zeros(len(string), bool)
    show[first] = True
    parts = [(spans["anchor"].to_pylist(), spans["whole"].to_pylist(), "span", spans["start"].to_pylist(), spans["size"].to_pylist())]
    for kind, flags in (("ask", ask), ("show", show & ~ask)):
        at, size = _ranges(flags, string)
        which = pa.array(string[at])
        parts.append((table["anchor"].take(which).to_pylist(), table["whole"].take(which).to_pylist(), kind, place[at].tolist(), size.tolist()))
    flat = lambda c: [x for part in parts for x in part[c]]
    kinds = [part[2] for part in parts for _ in part[0]]
    return pa.table({"anchor": pa.array(flat(0), pa.int64()), "whole": pa.array(flat(1), pa.int64()), "kind": pa.array(kinds, pa.string()), "start": pa.array(flat(3), pa.int64()), "size": pa.array(flat(4), pa.int64())})


def _windows(classes: DataFrame) -> DataFrame:
    """(window, anchor, whole, start, ask): the hash of each window in the ranges of classes (anchor, whole, bytes, ranges)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, len(batch), 2048):
                b = batch.slice(a, 2048)
                strings = b.column(2).to_pylist()
                size = np.array([len(x) for x in strings], np.int64)
                sums = _Sums(np.frombuffer(b"".join(strings), np.uint8))
                lists = b.column(3)
                row = np.repeat(np.arange(len(b)), lists.value_lengths().to_numpy())
                ranges = lists.flatten()
                first, n, ask = (ranges.field(c).to_numpy(zero_copy_only=False) for c in ("start", "size", "ask"))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
                row, ask = np.repeat(row, n), np.repeat(ask, n)
                p = at + (np.cumsum(size) - size)[row]
                which = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(sums.of(p, p + LENGTH).astype(np.int64)), b.column(0).take(which), b.column(1).take(which), pa.array(at, pa.int64()), pa.array(ask, pa.bool_())], ["window", "anchor", "whole", "start", "ask"])

    return classes.mapInArrow(run, "window long, anchor long, whole long, start long, ask boolean")


def _crowded(cut: DataFrame) -> DataFrame:
    """Spans (anchor, whole, start, size) of the repeats in classes of crowded anchors.

    Classes are dealt to blocks, where the suffix array finds what is repeated inside. A window that a block holds once
    is looked for in other blocks by its hash, with partial counts; its class then meets a class of another block that
    has the window, in a suffix array of the classes that asked and of their witnesses.
    """
    crowd = cut.where("crowd")
    dealt = crowd.withColumn("block", F.pmod(F.xxhash64("whole"), F.ceil(F.col("members") / F.lit(CROWD)))).select("anchor", "block", "whole", "n", "bytes")

    def block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _block(table)

    local = dealt.groupBy("anchor", "block").applyInArrow(block, "anchor long, whole long, kind string, start long, size long")
    local = materialize(local, "blocks")
    ranges = local.where("kind <> 'span'").groupBy(F.col("anchor").alias("_anchor"), F.col("whole").alias("_whole")).agg(F.collect_list(F.struct("start", "size", (F.col("kind") == "ask").alias("ask"))).alias("ranges"))
    asked = crowd.join(ranges, (F.col("anchor") == F.col("_anchor")) & (F.col("whole") == F.col("_whole"))).select("anchor", "whole", "bytes", "ranges")
    # a class makes a row for each of its windows, so classes are dealt evenly first
    windows = _windows(asked.repartition(F.col("whole")))
    again = windows.groupBy("window", "anchor").agg(F.count(F.lit(1)).alias("c"), F.max("ask").alias("asked"), F.min("whole").alias("w0"), F.max("whole").alias("w1")).where("c > 1 AND asked")
    again = materialize(again.select(F.col("window").alias("_w"), F.col("anchor").alias("_a"), "w0", "w1"), "windows")
    met = windows.where("ask").join(again, (F.col("window") == F.col("_w")) & (F.col("anchor") == F.col("_a")))
    met = materialize(met.select("anchor", "whole", F.when(F.col("w0") != F.col("whole"), F.col("w0")).otherwise(F.col("w1")).alias("witness")).distinct(), "witnesses")
    own = (F.col("anchor") == F.col("_anchor")) & (F.col("whole") == F.col("_whole"))
    asking = dealt.join(met.select(F.col("anchor").alias("_anchor"), F.col("whole").alias("_whole")).distinct(), own).drop("_anchor", "_whole")
    asking = materialize(asking, "asking")
    blocks = asking.select(F.col("anchor").alias("_a"), F.col("whole").alias("_w"), "block")
    seen = met.join(blocks, (F.col("anchor") == F.col("_a")) & (F.col("whole") == F.col("_w"))).select(F.col("anchor").alias("_anchor"), F.col("witness").alias("_whole"), "block").distinct()
    seen = dealt.drop("block").join(seen, own).select("anchor", "block", "whole", F.lit(1).cast("long").alias("n"), "bytes", F.lit(False).alias("asks"))

    def second(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        spans = _edges(table)
        return spans.filter(pc.is_in(spans["whole"], value_set=table.filter(table["asks"])["whole"].combine_chunks()))

    far = asking.withColumn("asks", F.lit(True)).unionByName(seen).groupBy("anchor", "block").applyInArrow(second, "anchor long, whole long, start long, size long")
    return local.where("kind = 'span'").select("anchor", "whole", "start", "size").union(far)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_id, _th, spans): for each text with repeats, the (start, size) of their spans, in bytes, overlapping or not."""
    with scratch(docs.sparkSession) as keep:
        return _spans(docs, keep)


def _spans(docs: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    runs = materialize(_runs(docs), "runs")
    seen = runs.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("anchor").alias("_anchor"))
    shared = keep(materialize(runs.join(materialize(seen, "anchors"), F.col("anchor") == F.col("_anchor")).drop("_anchor"), "shared"))
    classes = shared.groupBy("anchor", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "at")).alias("rep"))
    classes = materialize(classes, "classes")
    crowds = materialize(classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > CROWD).withColumnRenamed("anchor", "_anchor"), "crowds")
    flagged = classes.join(crowds, F.col("anchor") == F.col("_anchor"), "left").withColumn("crowd", F.col("_anchor").isNotNull()).drop("_anchor")
    cut = materialize(_bytes(docs, flagged), "bytes")

    total = cut.where("NOT crowd").agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(1, int(total // BUCKET_BYTES))
    calm = cut.where("NOT crowd").withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))

    def edges(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _edges(table)

    found = calm.select("bucket", "anchor", "whole", "n", "bytes").groupBy("bucket").applyInArrow(edges, "anchor long, whole long, start long, size long")
    found = found.union(_crowded(cut))
    found = keep(materialize(found.withColumnsRenamed({"anchor": "_anchor", "whole": "_whole"}), "edges"))

    spans = shared.join(found, (F.col("anchor") == F.col("_anchor")) & (F.col("whole") == F.col("_whole")))
    spans = spans.select("doc_id", "th", (F.shiftright("at", 20) + F.col("start")).alias("start"), "size").distinct()
    return spans.groupBy(F.col("doc_id").alias("_id"), F.col("th").alias("_th")).agg(F.collect_list(F.struct("start", "size")).alias("spans"))


def _united(spans: pa.Scalar, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of covered bytes."""
    if not spans.is_valid or not len(spans.values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = spans.values.field("start").to_numpy()
    end = np.minimum(start + spans.values.field("size").to_numpy(), n)
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _kept(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    edges = [0, *(x for pair in zip(start.tolist(), end.tolist(), strict=True) for x in pair), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of the kept bytes of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(batch.column(1), batch.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                start, end = _united(spans, len(raw))
                out.append((len(raw), int((end - start).sum()), len(start), hashlib.sha256(_kept(raw, start, end)).hexdigest()))
            n, gone, k, sha = zip(*out, strict=True) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = _text_join(docs, repeated_spans(docs), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _whole_characters(raw: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without characters that lie in them only in part."""
    inside = np.append((np.frombuffer(raw, np.uint8) & 0xC0) == 0x80, False)
    start, end = start.copy(), end.copy()
    for _ in range(3):
        start += inside[start]
        end -= inside[end]
    full = start < end
    return start[full], end[full]


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The documents with repeated passages cut from ``text``; a character is cut if all its bytes are.

    Rows whose text is gone entirely stay, with an empty text; null texts stay null; other columns are as they came.
    """

    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.RecordBatch.from_struct_array(batch.column(0))
            out = []
            for text, spans in zip(rows.column(at), batch.column(1), strict=True):
                if not text.is_valid:
                    out.append(None)
                    continue
                raw = text.as_buffer().to_pybytes()
                out.append(_kept(raw, *_whole_characters(raw, *_united(spans, len(raw)))).decode())
            columns = [pa.array(out, pa.string()) if i == at else c for i, c in enumerate(rows.columns)]
            yield pa.RecordBatch.from_arrays(columns, names)

    whole = docs.select(F.col("doc_id").alias("_doc"), F.xxhash64("text").alias("_text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
    joined = whole.join(repeated_spans(docs), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_th")), "left").select("row", "spans")
    return joined.mapInArrow(run, schema)
