"""Byte-level BPE encoding and decoding by higher-order functions.

A text is cut into words by the tokenizer's pattern. A word is an array of byte pieces, on which ranked merges are
folded: each step joins the adjacent pieces of lowest rank (the leftmost of equal ones), until no pair is in the rank
map, a literal: rows of the left ids laid over each other in one array, and where each begins. A piece is one long of
the rank of the pair it begins, its place and its id, so the least element of the array is the next merge. The map holds
one pair an entry, its last merge: what happens inside an entry's bytes until they are joined doesn't depend on what is
around them; a table with an entry that no merges make is an error.
Decoding concatenates the binary pieces of the ids, from a literal too. No Python runs on executors.

Words are counted over a SAMPLE of the texts, and the DICTIONARY most frequent ones of up to CHUNK bytes are folded
once; their ids are the value of a scalar subquery. Any other word is folded where it stands, so the dictionary decides
the cost alone, never the ids.
A word of more than CHUNK bytes is folded in chunks that overlap by half: a row of pieces is the word's own if each two
neighbours are, so chunks are joined at a piece that both have. If two chunks share none, the word is folded whole.

Defined results: a null or empty text has no tokens and decodes to no bytes; a null id is kept; repeated rows
are encoded alike; whole texts are encoded, however long; an empty table gives no rows. Only doc_id and text are read.
The pattern's letters and numbers are those of the JVM's Unicode tables and of Python's.
"""

from __future__ import annotations

import base64
import functools
import json
import unicodedata

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe_kernel import run_kernel

#: Words that are folded once, the most frequent ones; each is of CHUNK bytes at most.
DICTIONARY = 1 << 18
#: One text in so many (by a hash) is counted for the dictionary.
SAMPLE = 4
#: Bytes of a chunk of a long word; half of it overlaps.
CHUNK = 72
#: Small maps of the dictionary (a power of two).
WORD_SLOTS = 1 << 17


def _default() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@functools.lru_cache(2)
def _ranges(kind: str) -> str:
    """A general category's code points beyond ASCII, as ranges of a character class."""
    out: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] == kind:
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in out)


def java_pattern(pattern: str) -> str:
    r"""The pattern for the JVM: \s is Unicode's white space, letters and numbers are also those of Python's tables.

    The ranges are looked at only for a character that is not ASCII and that the JVM doesn't know as one.
    """
    classes = {f"\\p{{{k}}}": f"\\p{{{k}}}[[^\\x00-\\x7F]&&[{_ranges(k)}]]" for k in "LN"}
    out, inside, i = "", False, 0
    while i < len(pattern):
        token = pattern[i : i + 5] if pattern.startswith(tuple(classes), i) else pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(token)
        inside = token == "[" or (inside and token != "]")
        if token in classes:
            out += classes[token] if inside else f"[{classes[token]}]"
        else:
            out += {"\\s": "\\p{IsWhite_Space}", "\\S": "\\P{IsWhite_Space}"}.get(token, token)
    return out


def _last_merge(entry: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """The two pieces whose merge makes ``entry``."""
    pieces = [entry[i : i + 1] for i in range(len(entry))]
    while len(pieces) > 2:
        found = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(pieces, pieces[1:], strict=False)) if x + y in ranks]
        if not found:
            raise ValueError(f"no merges make the vocabulary entry {entry!r}")
        i = min(found)[1]
        pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
    return pieces


def _displaced(rows: dict[int, dict[int, int]]) -> tuple[dict[int, int], list[tuple[int, int] | None]]:
    """Sparse rows laid over each other without a clash: each row's start, and the row and value at start + column."""
    starts, free = {}, np.ones(1 << 12, bool)
    table: dict[int, tuple[int, int]] = {}
    for k, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        columns = np.array(sorted(row))
        # starts that put the first column on a free place
        places = np.flatnonzero(free)
        starts[k] = None
        for at in range(0, len(places), 256):
            tried = places[at : at + 256] - columns[0]
            tried = tried[tried >= 0]
            spots = tried[:, None] + columns
            ok = (free[np.minimum(spots, len(free) - 1)] | (spots >= len(free))).all(axis=1)
            if ok.any():
                starts[k] = int(tried[ok.argmax()])
                break
        if starts[k] is None:
            starts[k] = max(0, len(free) - int(columns[0]))
        spots = starts[k] + columns
        if spots[-1] >= len(free):
            free = np.concatenate([free, np.ones(int(spots[-1]) + 1 - len(free), bool)])
        free[spots] = False
        table |= {starts[k] + c: (k, v) for c, v in row.items()}
    return starts, [table.get(i) for i in range(max(table, default=-1) + 1)]


class Tokenizer:
    """The literals of a rank table (as JSON), and the pattern for the JVM."""

    def __init__(self, table: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in table.splitlines() if line)}
        self.pattern = java_pattern(pattern)
        # a long is, from its high bits, a rank (or none, the highest), a place and an id
        self.bits = (max(ranks.values()) + 1).bit_length()
        self.shift = 62 - self.bits
        self.none, self.end = (2 << self.bits) - 1, (1 << self.bits) - 1
        pairs: dict[int, dict[int, int]] = {}
        for t, r in ranks.items():
            if len(t) > 1:
                left, right = (ranks[x] for x in _last_merge(t, ranks))
                pairs.setdefault(left, {})[right] = r
        starts, table = _displaced(pairs)
        self.starts = _json([starts.get(i, 0) for i in range(max(ranks.values()) + 1)])
        # an id that begins the pair, and the pair's rank; -1 is of no pair
        self.ranks = _json([-1 if e is None else e[0] << 64 - self.shift | e[1] for e in table])
        self.bytes = _json([ranks[bytes([x])] for x in range(256)])
        self.first = _json([ranks.get(bytes([x, y]), self.none) for x in range(256) for y in range(256)])
        pieces = [""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            pieces[r] = t.hex().upper()
        self.pieces = pieces

    def _rank(self, left: str, right: str) -> str:
        """SQL: the rank of two ids together, in the high bits."""
        return _bind(f"get(ranks, get(starts, {left}) + {right})", "e", "0L", f"IF(shiftright(e, {64 - self.shift}) = {left}, shiftleft(e, {self.shift}), {self.none << self.shift}L)")

    def fold(self, binary: str, piece: str) -> str:
        """SQL: ``piece`` (of e, a place and an id) for each piece of a byte string that isn't empty."""
        low, ids = f"{(1 << self.shift) - 1}L", f"{self.end}L"
        left, right, x = "get(a, j - 2)", "get(a, j + 1)", f"shiftright(m, {self.shift})"
        # an end on both sides, so each piece has neighbours; removing and inserting is cheaper than slices put together
        joined = f"""array_insert(array_insert(array_remove(array_remove(array_remove(a, {left}), m), {right.replace("+ 1", "")}),
            j - 1, ({left} & {low}) | {self._rank(f"({left} & {ids})", x)}), j, (m & {low} & ~{ids}) | {x} | {self._rank(x, f"({right} & {ids})")})"""
        step = _bind("array_min(a)", "m", "a", f"IF(m < {self.none << self.shift}L, {_bind('cast(array_position(a, m) AS int)', 'j', 'a', joined)}, a)")
        ends = f"array({(1 << 63) - 1}L)", f"array({(1 << 63) - 1 - (1 << self.bits)}L)"
        start = f"""transform(b, (x, i) -> shiftleft(cast(coalesce(get(first, x * 256 + get(b, i + 1)), {self.none}) AS bigint), {self.shift})
            | shiftleft(cast(i AS bigint), {self.bits}) | get(bytes, x))"""
        folded = f"aggregate(slice(b, 2, size(b)), flatten(array({ends[0]}, {start}, {ends[1]})), (a, y) -> {step}, a -> transform(slice(a, 2, size(a) - 2), e -> {piece}))"
        return _let(f"transform(split(decode({binary}, 'ISO-8859-1'), ''), c -> ascii(c))", "b", folded)

    def fold_word(self, w: str) -> str:
        """SQL: the ids of a word, in chunks if it is long."""
        half, own_id = CHUNK // 2, f"cast(e & {self.end}L AS int)"
        whole = self.fold(f"cast({w} AS binary)", own_id)
        # pieces with their places in the word
        chunk = self.fold(f"substring(cast({w} AS binary), s + 1, {CHUNK})", f"(e & {(1 << self.shift) - 1}L) + shiftleft(cast(s AS bigint), {self.bits})")
        chunks = f"transform(sequence(0, cast(ceil((octet_length({w}) - {CHUNK}) / {half}) AS int) * {half}, {half}), s -> {chunk})"
        cuts = "transform(slice(t, 2, size(t)), (y, k) -> array_min(array_intersect(get(t, k), y)))"
        own = f"transform(flatten(transform(t, (y, k) -> filter(y, e -> e >= coalesce(get(cuts, k - 1), 0L) AND (k = size(cuts) OR e < get(cuts, k))))), e -> {own_id})"
        glued = _let(chunks, "t", _let(cuts, "cuts", f"IF(exists(cuts, c -> c IS NULL), {whole}, {own})"))
        return f"IF(octet_length({w}) <= {CHUNK}, {whole}, {glued})"

    def bound(self, body: str) -> str:
        """SQL: ``body`` with the literals bound to their names."""
        out = body
        for name, table, kind in (("ranks", self.ranks, "array<bigint>"), ("starts", self.starts, "array<bigint>"), ("first", self.first, "array<int>"), ("bytes", self.bytes, "array<bigint>")):
            out = _let(f"from_json({_quoted(table)}, '{kind}')", name, out)
        return out


def _json(table: list) -> str:
    return json.dumps(table, separators=(",", ":"))


@functools.lru_cache(2)
def _tokenizer(table: bytes, pattern: str) -> Tokenizer:
    return Tokenizer(table, pattern)


def load(path: str | None = None, pattern: str | None = None) -> tuple[bytes, str]:
    """The rank table and pattern of a tokenizer, read on the driver."""
    found = _default() if path is None or pattern is None else (path, pattern)
    with open(path or found[0], "rb") as f:
        return f.read(), pattern or found[1]


def _let(value: str, name: str, body: str) -> str:
    """``body`` with a value bound to a name, computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _bind(value: str, name: str, like: str, body: str) -> str:
    """``_let`` for a body of the type of ``like``; it copies no arrays."""
    return f"aggregate(array({value}), {like}, (z, {name}) -> {body})"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _with_words(docs: DataFrame, t: Tokenizer) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(t.pattern), F.lit(0))
    return docs.select("doc_id", words.alias("words"))


def dictionary(docs: DataFrame, t: Tokenizer, size: int) -> Column:
    """The most frequent words with their ids, as a scalar subquery: an array of small maps, addressed by a word's hash."""
    words = _with_words(docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0), t).select(F.explode("words").alias("w"))
    counts = words.groupBy("w").count().where(F.octet_length("w") <= CHUNK)
    top = counts.orderBy(F.desc("count"), "w").limit(size).select("w")
    # a limit leaves one partition
    top = top.repartition(docs.sparkSession.sparkContext.defaultParallelism * 2)
    folded = top.select("w", F.expr(t.bound(t.fold_word("w"))).alias("ids"))
    held = folded.groupBy(F.xxhash64("w").bitwiseAND(F.lit(WORD_SLOTS - 1)).alias("slot")).agg(F.collect_list(F.struct("w", "ids")).alias("held"))
    every = docs.sparkSession.range(WORD_SLOTS).join(held, F.col("id") == F.col("slot"), "left").select("id", F.coalesce("held", F.expr("cast(array() AS array<struct<w:string,ids:array<int>>>)")).alias("held"))
    return every.agg(F.expr("transform(array_sort(collect_list(struct(id, held))), e -> map_from_entries(e.held))").alias("known")).scalar()


def _encoded(docs: DataFrame, t: Tokenizer, size: int | None = None) -> DataFrame:
    """doc_id and ids."""
    known = f"try_element_at(get(known, cast(xxhash64(w) & {WORD_SLOTS - 1}L AS int)), w)"
    every = t.bound(f"flatten(transform(words, w -> coalesce({known}, {t.fold_word('w')})))")
    # the dictionary is named once, so both selections become one, and no row carries it
    return _with_words(docs, t).select("doc_id", "words", dictionary(docs, t, DICTIONARY if size is None else size).alias("held")).select("doc_id", F.expr(_let("held", "known", every)).alias("ids"))


def _strings(table: list[str]) -> str:
    return f"split('{','.join(table)}', ',')"


def packed(ids: str, table: list[str]) -> Column:
    """Binary: an entry of ``table`` (in hex) for each id, one after another."""
    return F.expr(_let(_strings(table), "pieces", f"unhex(array_join(transform({ids}, i -> get(pieces, i)), ''))"))


def decode(ids: str, path: str | None = None, pattern: str | None = None) -> Column:
    """The bytes of a column of ids."""
    return packed(ids, _tokenizer(*load(path, pattern)).pieces)


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, engine: str = "fold") -> DataFrame:
    """doc_id, ids (array of int) and decoded (binary) of every row, by higher-order functions ("fold") or the Arrow kernel ("arrow")."""
    table, pattern = load(path, pattern)
    if engine == "arrow":
        return run_kernel(docs, table, pattern, full=True)
    t = _tokenizer(table, pattern)
    return _encoded(docs, t).select("doc_id", "ids", packed("ids", t.pieces).alias("decoded"))


def encode_digest(docs: DataFrame, path: str | None = None, pattern: str | None = None, engine: str = "fold", size: int | None = None) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded bytes; engines as above, ``size`` is the dictionary's."""
    table, pattern = load(path, pattern)
    if engine == "arrow":
        return run_kernel(docs, table, pattern, full=False)
    t = _tokenizer(table, pattern)
    little = [i.to_bytes(4, "little").hex() for i in range(len(t.pieces))]
    return _encoded(docs, t, size).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(packed("ids", little), 256).alias("ids_sha256"), F.sha2(packed("ids", t.pieces), 256).alias("decoded_sha256")
    )
