"""Quality rules on repetition inside a text.

The stack scan of the LCP array over the suffix array of a text's words gives the tree of common-prefix intervals; those
whose suffixes differ in the word before them are the maximal repeated substrings. Spans are united; a text fails if
maximal repeats of LONG_WORDS words or more cover too much of it (stuttered words, say, which windows of five don't see)
or one is too long. The base rules are read from the same arrays: a word lies in a five-word window that occurs again
exactly if a maximal repeat of five words or more covers it.

Defined results: a null or empty text has no words and fails the base rule; a null id is kept; repeated rows
are judged alike, each by itself; whole texts are read, however long; an empty table gives no rows. Only doc_id
and text are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffixes import cover, deepest, enhanced, maximal, ranks
from .textbytes import SPACE, count_in, mix, slices, spans_hash, words

MIN_WORDS, WINDOW, MOST_PERCENT = 10, 5, 20
#: Maximal repeats of so many words or more may cover at most so many percent of the words ...
LONG_WORDS, LONG_PERCENT = 3, 20
#: ... and none may be longer than this.
LONGEST = 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def measure(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The figures of each text in a slice."""
    starts, ends, at = words(data, offsets)
    n_words = np.diff(at)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    ink = ~SPACE[data]
    chars = count_in(ink & ((data & 0xC0) != 0x80), offsets)
    symbols = count_in(_SYMBOL[data], offsets)

    # lines, cut at \n and at the ends of texts
    breaks = data == 10
    cuts = np.flatnonzero(breaks)
    line_starts = np.unique(np.concatenate([offsets[:-1], cuts + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_ends = line_ends - (breaks[line_ends - 1] if len(data) else 0)
    full = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_doc = np.searchsorted(offsets, line_starts, "right") - 1
    keys = spans_hash(data, line_starts, line_ends) + mix(line_doc.astype(np.uint64))
    _, first = np.unique(keys, return_index=True)
    lines = np.bincount(line_doc, minlength=len(n_words)) - np.bincount(line_doc[first], minlength=len(n_words))

    keys = spans_hash(data, starts, ends) + mix(doc.astype(np.uint64))
    left = np.repeat(at[1:], n_words) - np.arange(len(doc))
    sa, lcp = enhanced(ranks(keys), left)
    repeat = deepest(sa, lcp)
    # the word before each suffix; the start of a text is unlike all else
    before = np.concatenate([[0], keys[:-1].astype(np.int64)])[: len(keys)]
    before[at[:-1][n_words > 0]] = -1 - np.flatnonzero(n_words > 0)
    start, length = maximal(sa, lcp, before, LONG_WORDS)

    def covered(least: int) -> np.ndarray:
        p = np.flatnonzero(repeat >= least)
        return count_in(cover(p, repeat[p], len(doc)), at)

    longest = np.zeros(len(n_words), np.int64)
    np.maximum.at(longest, doc[start], length)
    return {"n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": covered(WINDOW), "n_long_words": count_in(cover(start, length, len(doc)), at), "longest": longest}


_FIGURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_long_words", "longest"]


def _verdicts(m):
    """base_failed and kept, from arrays or columns."""
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_PERCENT * m["n_words"])
    return failed, ~failed & (100 * m["n_long_words"] <= LONG_PERCENT * m["n_words"]) & (m["longest"] <= LONGEST)


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, all figures, base_failed and kept of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch):
                m = measure(data, offsets)
                failed, kept = _verdicts(m)
                yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(m[c], pa.int64()) for c in _FIGURES], pa.array(failed), pa.array(kept)], ["doc_id", *_FIGURES, "base_failed", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in _FIGURES)}, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns and rows they came with."""

    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.RecordBatch.from_arrays([batch.column(at)], ["text"])
            done = 0
            for rows, data, offsets in slices(texts):
                _, kept = _verdicts(measure(data, offsets))
                yield batch.slice(done, len(rows)).filter(pa.array(kept))
                done += len(rows)

    return docs.mapInArrow(run, schema)


def quality_report(docs: DataFrame) -> DataFrame:
    q = quality(docs)
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("base_failed"), F.col("kept"))
