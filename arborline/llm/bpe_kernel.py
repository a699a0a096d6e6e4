"""The ranked merges of ``bpe`` as an Arrow kernel: the same ids, for stages that can't afford interpreted folds.

The distinct words of a slice of texts are byte arrays on which merges are folded all at once: each round merges, in
every word, the adjacent pair of lowest rank (the leftmost of equal ones), until no pair is in the rank map, a hash
table of all the ways to split a vocabulary entry into two entries. A word of more than CHUNK bytes is folded in chunks
that overlap by half, joined at a piece that both have, as in ``bpe``; so rounds are few and the work is linear.

The map is the tokenizer's vocabulary, of a fixed size; each Python worker builds it once from the bytes that the driver
read. Memory is bounded by a slice of texts (and the longest text). Results are defined as in ``bpe``.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .textbytes import slices

#: Bytes of a chunk of a long word; half of it overlaps, and is longer than any vocabulary entry.
CHUNK = 128
#: No pair, as a rank.
NONE = np.int64(1 << 40)


class Vocabulary:
    """Ranks of byte strings, and the ranks of the pairs that make them."""

    def __init__(self, table: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.base = np.int64(max(ranks.values()) + 1)
        pairs = [(ranks[t[:i]] * int(self.base) + ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        pairs.sort()
        # a table by hash (open addressing, the load kept low) makes a lookup a few gathers
        keys, values = np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)
        self.bits = np.uint64(64 - max(4, int(len(keys) * 4).bit_length()))
        self.keys = np.full(1 << (64 - int(self.bits)), -1, np.int64)
        self.values = np.full(len(self.keys), NONE, np.int64)
        self.steps = 0
        at, rest = self._slot(keys), np.arange(len(keys))
        while len(rest):
            self.steps += 1
            free = self.keys[at[rest]] == -1
            put = rest[free]
            _, one = np.unique(at[put], return_index=True)
            put = put[one]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            done = np.zeros(len(keys), bool)
            done[put] = True
            rest = rest[~done[rest]]
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
        by_rank = sorted((r, t) for t, r in ranks.items())
        self.ids = np.full(int(self.base), -1, np.int64)
        self.ids[[r for r, _ in by_rank]] = np.arange(len(by_rank))
        self.pieces = np.frombuffer(b"".join(t for _, t in by_rank), np.uint8)
        self.ends = np.cumsum([len(t) for _, t in by_rank])
        self.lengths = np.array([len(t) for _, t in by_rank], np.int64)
        self.ranks = ranks

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's concatenation, NONE where it isn't in the map."""
        keys = left * self.base + right
        at = self._slot(keys)
        out = np.full(len(keys), NONE, np.int64)
        seen = self.keys[at]
        hit = seen == keys
        out[hit] = self.values[at[hit]]
        rest = np.flatnonzero(~hit & (seen != -1))
        for _ in range(self.steps):
            if not len(rest):
                break
            at[rest] = (at[rest] + 1) & (len(self.keys) - 1)
            seen = self.keys[at[rest]]
            hit = seen == keys[rest]
            out[rest[hit]] = self.values[at[rest[hit]]]
            rest = rest[~hit & (seen != -1)]
        return out

    def fold(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words given as bytes with offsets, and the offsets of the words among the ids."""
        n = len(offsets) - 1
        ids = self.single[data]
        counts = np.diff(offsets)
        out_ids: list[np.ndarray] = []
        out_word: list[np.ndarray] = []
        word = np.repeat(np.arange(n), counts)
        rank = np.full(len(ids), NONE, np.int64)  # of the pair that starts at each id
        inner = word[:-1] == word[1:]
        rank[:-1][inner] = self.pair(ids[:-1][inner], ids[1:][inner])
        while len(ids):
            # words are contiguous: the lowest rank of each, and its leftmost place
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(ids)))
            open_ = low < NONE
            done = np.repeat(~open_, size)
            if done.any():
                out_ids.append(ids[done])
                out_word.append(word[done])
                ids, word, rank = ids[~done], word[~done], rank[~done]
                low, size = low[open_], size[open_]
                if not len(ids):
                    break
                first = np.concatenate([[0], np.cumsum(size)[:-1]])
            hits = np.flatnonzero(rank == np.repeat(low, size))
            own = word[hits]
            at = hits[np.concatenate([[True], own[1:] != own[:-1]])]
            ids[at] = low
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            # the merged id has a new right neighbour (two further on) and is one for its left neighbour
            last = len(ids)
            right = at + 2
            ok = right < last
            ok[ok] = word[right[ok]] == word[at[ok]]
            rank[at] = NONE
            rank[at[ok]] = self.pair(ids[at[ok]], ids[right[ok]])
            before = at - 1
            ok = before >= 0
            ok[ok] = word[before[ok]] == word[at[ok]]
            rank[before[ok]] = self.pair(ids[before[ok]], ids[at[ok]])
            ids, word, rank = ids[keep], word[keep], rank[keep]
        if not out_ids:
            return np.zeros(0, np.int64), np.zeros(n + 1, np.int64)
        ids, word = np.concatenate(out_ids), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=n))])

    def long_word(self, word: np.ndarray) -> np.ndarray:
        """Ids of a word of more than CHUNK bytes."""
        half, n = CHUNK // 2, -(-(len(word) - CHUNK) // (CHUNK // 2)) + 1
        starts = np.arange(n) * half
        sizes = np.minimum(starts + CHUNK, len(word)) - starts
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        ids, at = self.fold(word[np.arange(offsets[-1]) - np.repeat(offsets[:-1] - starts, sizes)], offsets)
        length = self.lengths[self.ids[ids]]
        chunk = np.repeat(np.arange(n), np.diff(at))
        ends = np.cumsum(length)
        place = ends - length - offsets[chunk] + starts[chunk]
        # a piece at the same place in two chunks: the earliest ends the one and begins the other
        order = np.lexsort((chunk, length, place))
        same = (place[order[1:]] == place[order[:-1]]) & (length[order[1:]] == length[order[:-1]]) & (chunk[order[1:]] == chunk[order[:-1]] + 1)
        cut = np.full(n + 1, -1, np.int64)
        later, where = chunk[order[1:]][same], place[order[1:]][same]
        cut[later[::-1]] = where[::-1]
        cut[0], cut[n] = 0, len(word)
        if (cut < 0).any():
            return self.fold(word, np.array([0, len(word)]))[0]
        return ids[(place >= cut[chunk]) & (place < cut[chunk + 1])]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``fold`` for words of any length."""
        long = np.flatnonzero(np.diff(offsets) > CHUNK)
        if not len(long):
            return self.fold(data, offsets)
        sizes = np.diff(offsets)
        short = sizes.copy()
        short[long] = 0
        keep = np.repeat(short > 0, sizes)
        ids, at = self.fold(data[keep], np.concatenate([[0], np.cumsum(short)]))
        parts, counts, before = [], np.diff(at), 0
        for i in long.tolist():
            own = self.long_word(data[offsets[i] : offsets[i + 1]])
            parts += [ids[before : at[i]], own]
            before, counts[i] = at[i], len(own)
        return np.concatenate([*parts, ids[before:]]), np.concatenate([[0], np.cumsum(counts)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the offsets of the texts among them."""
        found = [self.pattern.findall(t) for t in texts]
        per_text = np.array([len(x) for x in found], np.int64)
        flat = [w for x in found for w in x]
        if not flat:
            return np.zeros(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        coded = pa.array(flat, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = coded.dictionary
        offsets = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1, distinct.offset * 8)
        ids, at = self.words(np.frombuffer(distinct.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0])
        sizes = np.diff(at)[codes]
        ends = np.cumsum(sizes)
        take = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(at[:-1][codes], sizes)
        return ids[take], np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' pieces, one after another."""
        rows = self.ids[ids]
        sizes = self.lengths[rows]
        ends = np.cumsum(sizes)
        if not len(ends):
            return np.zeros(0, np.uint8)
        return self.pieces[np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.ends[rows] - sizes, sizes)]


@functools.lru_cache(2)
def _vocabulary(table: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(table, pattern)


def run_kernel(docs: DataFrame, table: bytes, pattern: str, full: bool) -> DataFrame:
    """doc_id with ids and decoded bytes (``full``), or with their number and digests."""
    shared = docs.sparkSession.sparkContext.broadcast((table, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(*shared.value)
        for batch in batches:
            for rows, _, _ in slices(batch):
                ids, at = vocabulary.encode(rows.column(1).fill_null("").to_pylist())
                if full:
                    decoded = pa.array([vocabulary.decode(ids[a:b]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
                    lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))
                    yield pa.RecordBatch.from_arrays([rows.column(0), lists, decoded], ["doc_id", "ids", "decoded"])
                    continue
                small = ids.astype("<u4")
                hashes = [(hashlib.sha256(small[a:b]).hexdigest(), hashlib.sha256(vocabulary.decode(ids[a:b])).hexdigest()) for a, b in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(at), pa.int64()), pa.array([x for x, _ in hashes], pa.string()), pa.array([x for _, x in hashes], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = "ids array<int>, decoded binary" if full else "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {columns}")
