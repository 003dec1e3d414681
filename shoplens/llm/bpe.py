"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

A batch of texts becomes one array of code points. Each code point gets a class, and with
one or two characters of look-ahead a symbol; a symbol is a transition function on the
eight states of the splitting pattern (``PATTERN``, see below). Functions compose
associatively, so the states of all positions come from a blocked scan: functions of whole
blocks first, then the blocks' start states, then all blocks side by side. A boundary is a
(state, symbol) pair of a fixed table. No regular expression runs on the texts.

The slices between boundaries are bytes; the distinct slices of a batch are merged by their
pair ranks, those of one length side by side, and remembered. Tokens keep their byte offsets, which decoding checks.

Defined results: a null or empty text has no tokens and decodes to empty bytes. Repeated
rows are encoded alike; other columns pass through.

The pattern's parts, in order of preference: the contractions 's 't 're 've 'm 'll 'd;
letters, digits, or other signs, each with one optional leading space; white space up to
the last before a sign that isn't white; white space.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import with_struct

#: the pattern this module implements (fixed value)
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: code points with the Unicode property White_Space (fixed values), as inclusive ranges
WHITE = ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
         (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000))
#: slices the memo holds before it starts anew; longest slice that is its own key
MEMO_SLICES = 1 << 19
KEY_BYTES = 24
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: code points encoded in one step
CHUNK_CHARS = 1 << 20
#: slices longer than this are merged one by one
LONG_PIECE = 48
NONE = np.iinfo(np.int32).max
BLOCK = 512

# classes of code points
OTHER, LETTER, NUMBER, SPACE = range(4)
# states: what stands before a position. FRESH: whatever follows begins a slice. TAIL1, TAIL2: one
# or two letters of a contraction are still to come. LEAD: a space that the next sign joins.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_WHITE, LEAD, TAIL1, TAIL2 = range(8)
# symbols; FIRST is added for the first code point of a text, whose state before is FRESH
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_LEAD, S_LAST_WHITE, S_APOS1, S_APOS2 = range(8)
FIRST = 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol * 8 + state] and boundary[symbol * 8 + state]."""
    goes = np.zeros((16, 8), dtype=np.uint8)
    cuts = np.ones((16, 8), dtype=bool)
    runs = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    for symbol in range(8):
        for state in range(8):
            cut = True
            if symbol == S_LETTER and state in (TAIL1, TAIL2):
                to, cut = (FRESH if state == TAIL1 else TAIL1), False
            elif symbol in runs:
                to = runs[symbol]
                cut = state not in (to, LEAD)
            elif symbol in (S_APOS1, S_APOS2):
                if state in (IN_OTHERS, LEAD):
                    to, cut = IN_OTHERS, False
                else:
                    to = TAIL1 if symbol == S_APOS1 else TAIL2
            elif symbol == S_WHITE:
                to, cut = IN_WHITE, state != IN_WHITE
            else:
                to = LEAD if symbol == S_LEAD else FRESH
            goes[symbol, state], cuts[symbol, state] = to, cut
    goes[FIRST:] = goes[:FIRST, FRESH:FRESH + 1]
    return goes.ravel(), cuts.ravel()


GOES, CUTS = _tables()
CONSTANT = (GOES.reshape(16, 8) == GOES.reshape(16, 8)[:, :1]).all(axis=1)


@cache
def classes() -> np.ndarray:
    """The class of every code point, from the Unicode categories and ``WHITE``."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)],
                     dtype=np.uint8)
    for lo, hi in WHITE:
        table[lo:hi + 1] = SPACE
    return table


def symbols(points: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Symbols of concatenated texts; ``starts``: the positions where a text begins; ``kinds``: see classes()."""
    n = len(points)
    kind = kinds[points]
    first = np.zeros(n + 2, dtype=bool)
    first[starts] = True
    first[n:] = True

    def ahead(k: int) -> np.ndarray:  # code points k later, 0 beyond the text's end
        out = np.zeros(n, dtype=points.dtype)
        out[:max(0, n - k)] = points[k:]
        for j in range(1, k + 1):
            out[first[j:n + j]] = 0
        return out

    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE], dtype=np.uint8)[kind]
    solid = np.zeros(n, dtype=bool)  # a sign that isn't white follows in the same text
    solid[:-1] = (kind[1:] != SPACE) & ~first[1:n]
    last = (kind == SPACE) & solid
    symbol[last] = np.where(points[last] == 0x20, S_LEAD, S_LAST_WHITE)
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        a, b = ahead(1)[marks], ahead(2)[marks]
        symbol[marks[np.isin(a, [ord(c) for c in "stmd"])]] = S_APOS1
        pair = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        symbol[marks[pair]] = S_APOS2
    symbol[starts[starts < n]] += FIRST
    return symbol


def boundaries(symbol: np.ndarray) -> np.ndarray:
    """Positions where a slice begins, by a blocked scan over the symbols' transition functions.

    A function that leads from all states to one makes all before it irrelevant, so a block's
    function is composed from the last such symbol on.
    """
    n = len(symbol)
    blocks = -(-n // BLOCK)
    padded = np.full(blocks * BLOCK, S_OTHER, dtype=np.uint8)
    padded[:n] = symbol
    constant = CONSTANT[padded].reshape(blocks, BLOCK)
    since = np.where(constant.any(axis=1), BLOCK - 1 - constant[:, ::-1].argmax(axis=1), 0)
    columns = np.ascontiguousarray((padded.astype(np.int16) * 8).reshape(blocks, BLOCK).T)
    whole = np.tile(np.arange(8, dtype=np.uint8), (blocks, 1))
    order = np.argsort(since, kind="stable")
    live = np.searchsorted(since[order], np.arange(BLOCK), side="right")
    for j, column in enumerate(columns):
        if live[j]:
            some = order[:live[j]]
            whole[some] = GOES[column[some, None] + whole[some]]
    before = np.empty(blocks, dtype=np.uint8)
    state = FRESH
    for k, function in enumerate(whole.tolist()):
        before[k] = state
        state = function[state]
    cut = np.empty((BLOCK, blocks), dtype=bool)
    for j, column in enumerate(columns):
        at = column + before
        cut[j] = CUTS[at]
        before = GOES[at]
    return np.flatnonzero(cut.T.ravel()[:n])


def split(texts: list[str], kinds: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts' bytes in one piece, the byte offsets of all slices (and the end), and for
    each text the number of its first slice (and the count of slices)."""
    joined = "".join(texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64) if texts else np.zeros(0, dtype=np.int64)
    if not len(points):
        return b"", np.zeros(1, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
    starts = np.concatenate([[0], ends[:-1]])
    # an empty text begins where the next one does
    kinds = classes() if kinds is None else kinds
    cuts = boundaries(symbols(points, np.unique(starts[starts < len(points)]), kinds))
    width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    offset = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    return (joined.encode("utf-8", "surrogatepass"), np.append(offset[cuts], offset[-1]),
            np.searchsorted(cuts, np.append(starts, len(points))))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of one slice: join the adjacent pair of lowest rank, leftmost first, until none is
    left; a heap of pairs over a linked list of parts, for slices of any length."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that begins here
    back = list(range(-1, n))
    alive = [True] * n

    def pair(i: int) -> int | None:
        j = end[i]
        return ranks.get(piece[i:end[j]]) if j < n else None

    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != to:
            continue  # a part of this pair has been joined to another
        alive[end[i]] = False
        end[i] = to
        if to < n:
            back[to] = i
        for j in (back[i], i):
            if j >= 0 and (r := pair(j)) is not None:
                heapq.heappush(heap, (r, j, end[end[j]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


class PairTable:
    """Rank of the token that two adjacent tokens make, looked up for arrays of pairs (an
    open-addressing table of all splits of all tokens into two tokens)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.size = 1 << 16
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                a, b = ranks.get(token[:k]), ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        while self.size < 4 * len(pairs):
            self.size *= 2
        self.keys = np.full(self.size, -1, dtype=np.int64)
        self.ranks = np.full(self.size, NONE, dtype=np.int32)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        values = np.fromiter(pairs.values(), dtype=np.int32, count=len(pairs))
        at = self._slot(keys)
        while len(keys):  # of those that want a slot, one gets it; the others go on to the next
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.ranks[at[mine]] = values[mine]
            keys, values, at = keys[~mine], values[~mine], (at[~mine] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(40)).astype(np.int64) & (self.size - 1)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at[open_] = (at[open_] + 1) & (self.size - 1)
            found = self.keys[at[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.ranks[at[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        return out


def merge_many(pieces: list[bytes], byte_ids: np.ndarray, pairs: PairTable) -> list[list[int]]:
    """Ranks of slices of one length: all slices take their next merge side by side."""
    n, width = len(pieces), len(pieces[0])
    ids = byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8).reshape(n, width)]
    low = pairs(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
    row, out = np.arange(n), [None] * n
    while True:
        k = low.argmin(axis=1) if low.shape[1] else np.zeros(len(row), dtype=np.int64)
        best = low[np.arange(len(row)), k] if low.shape[1] else np.full(len(row), NONE, dtype=np.int32)
        done = best == NONE
        if done.any():
            for r, x in zip(row[done].tolist(), ids[done].tolist(), strict=True):
                out[r] = x
            row, ids, low, k, best = row[~done], ids[~done], low[~done], k[~done], best[~done]
        if not len(row):
            return out
        every = np.arange(len(row))
        ids[every, k] = best
        column = np.arange(ids.shape[1] - 1)
        ids = np.take_along_axis(ids, column + (column > k[:, None]), axis=1)
        column = column[:-1]
        low = np.take_along_axis(low, column + (column >= k[:, None]), axis=1)
        some = np.flatnonzero(k > 0)
        low[some, k[some] - 1] = pairs(ids[some, k[some] - 1], ids[some, k[some]])
        some = np.flatnonzero(k < low.shape[1])
        low[some, k[some]] = pairs(ids[some, k[some]], ids[some, k[some] + 1])


def read_ranks(raw: bytes) -> dict[bytes, int]:
    """The ranks of a rank file: lines of base64 token and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in raw.splitlines() if line)}


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start[i] .. start[i] + size[i] - 1 of all i, one after another."""
    total = int(size.sum())
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(total)


class Strings:
    """Byte strings by number, laid out for gathering many at once."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.size = np.array([len(x) for x in strings], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ``ids`` in one piece, and the offset where each begins (and the end)."""
        size = self.size[ids]
        return self.data[_ragged(self.start[ids], size)], np.concatenate([[0], np.cumsum(size)])


class Memo:
    """Token ids of slices seen before. Slices of up to KEY_BYTES bytes are their own keys
    (three 64-bit words and the length) in an open-addressing table; longer ones go to a dict."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.slots = np.full(4 * MEMO_SLICES, -1, dtype=np.int32)
        self.keys = np.zeros((4, MEMO_SLICES), dtype=np.uint64)
        self.start = np.zeros(MEMO_SLICES, dtype=np.int64)
        self.size = np.zeros(MEMO_SLICES, dtype=np.int64)
        self.ids = np.zeros(4 * MEMO_SLICES, dtype=np.int32)
        self.used, self.ids_used, self.long = 0, 0, {}

    @staticmethod
    def keys_of(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Key words of slices of ``raw``, which has KEY_BYTES + 8 spare bytes at its end."""
        window = np.ndarray(len(raw) - 7, dtype="<u8", buffer=raw, strides=(1,))
        out = np.empty((4, len(start)), dtype=np.uint64)
        for k in range(3):
            out[k] = window[start + 8 * k] & MASKS[np.clip(size - 8 * k, 0, 8)]
        out[3] = size
        return out

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[0] * np.uint64(0x9E3779B97F4A7C15) ^ keys[1] * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed = (mixed ^ keys[2] ^ keys[3]) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(32)).astype(np.int64) % len(self.slots)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Entry of each key, -1 if it isn't known."""
        at = self._slot(keys)
        out = self.slots[at].astype(np.int64)
        open_ = np.flatnonzero((out >= 0) & (self.keys[:, out] != keys).any(axis=0))
        while len(open_):
            at[open_] = (at[open_] + 1) % len(self.slots)
            found = self.slots[at[open_]]
            out[open_] = found
            open_ = open_[(found >= 0) & (self.keys[:, found] != keys[:, open_]).any(axis=0)]
        return out

    def add(self, keys: np.ndarray, ids: list[list[int]]) -> np.ndarray:
        """Enter new, distinct keys with their ids."""
        entry = self._store(ids)
        self.keys[:, entry] = keys
        at, want = self._slot(keys), entry
        while len(want):
            free = self.slots[at] < 0
            self.slots[at[free]] = want[free]
            rest = self.slots[at] != want
            at, want = (at[rest] + 1) % len(self.slots), want[rest]
        return entry

    def _store(self, ids: list[list[int]]) -> np.ndarray:
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32)
        while self.ids_used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.used + len(ids) > len(self.start):
            self.keys = np.concatenate([self.keys, np.zeros_like(self.keys)], axis=1)
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        if 2 * (self.used + len(ids)) > len(self.slots):
            raise MemoryError("more distinct slices in one batch than the memo holds")
        entry = np.arange(self.used, self.used + len(ids))
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        self.size[entry] = size
        self.start[entry] = self.ids_used + np.cumsum(size) - size
        self.ids[self.ids_used:self.ids_used + len(flat)] = flat
        self.ids_used += len(flat)
        self.used += len(ids)
        return entry

    def add_long(self, piece: bytes, ids: list[int]) -> int:
        self.long[piece] = int(self._store([ids])[0])
        return self.long[piece]


@dataclass(frozen=True)
class Encoded:
    """Token ids of texts, one after another, and the range of each text among them."""

    ids: np.ndarray
    first: np.ndarray

    def __iter__(self) -> Iterator[np.ndarray]:
        return (self.ids[a:b] for a, b in zip(self.first[:-1], self.first[1:], strict=True))


class Codec:
    """Encodes and decodes with a rank table; remembers the tokens of recent slices."""

    def __init__(self, ranks: dict[bytes, int], kinds: np.ndarray | None = None):
        self.ranks = ranks
        self.kinds = classes() if kinds is None else kinds
        by_rank = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.tokens = Strings(by_rank)
        self.numerals = Strings([b"%d," % i for i in range(len(by_rank))])
        self.byte_ids = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.pairs = PairTable(ranks)
        self.memo = Memo()

    def _merged(self, pieces: list[bytes]) -> list[list[int]]:
        """Token ids of distinct slices."""
        out: list = [None] * len(pieces)
        by_size: dict[int, list[int]] = {}
        for k, piece in enumerate(pieces):
            whole = self.ranks.get(piece)
            if whole is not None:
                out[k] = [whole]
            elif len(piece) > LONG_PIECE:
                out[k] = merge(piece, self.ranks)
            else:
                by_size.setdefault(len(piece), []).append(k)
        for same in by_size.values():
            for k, ids in zip(same, merge_many([pieces[k] for k in same], self.byte_ids, self.pairs), strict=True):
                out[k] = ids
        return out

    def encode(self, texts: list[str]) -> Encoded:
        raw, at, first = split(texts, self.kinds)
        padded = np.frombuffer(raw + bytes(KEY_BYTES + 8), dtype=np.uint8)
        # runs of slices, cut at boundaries, so that the memo holds the slices of any text
        runs = [self._encode_run(raw, padded, at[k:k + MEMO_SLICES + 1]) for k in range(0, len(at) - 1, MEMO_SLICES)]
        ids, count = map(np.concatenate, zip(*runs, strict=True)) if runs else (np.zeros(0, dtype=np.int32),) * 2
        return Encoded(ids, np.concatenate([[0], np.cumsum(count, dtype=np.int64)])[first])

    def _encode_run(self, raw: bytes, padded: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the slices between the offsets ``at`` (MEMO_SLICES at most), and how many each has."""
        start, size = at[:-1], np.diff(at)
        if self.memo.used > MEMO_SLICES // 2:
            self.memo.clear()
        entry = np.full(len(start), -1, dtype=np.int64)
        short = np.flatnonzero(size <= KEY_BYTES)
        keys = self.memo.keys_of(padded, start[short], size[short])
        found = self.memo.find(keys)
        new = np.flatnonzero(found < 0)
        if len(new):
            one, back = _distinct(keys[:, new])
            pick = new[one]
            pieces = [raw[a:b] for a, b in zip(start[short[pick]], start[short[pick]] + size[short[pick]], strict=True)]
            found[new] = self.memo.add(keys[:, pick], self._merged(pieces))[back]
        entry[short] = found
        for k in np.flatnonzero(size > KEY_BYTES).tolist():
            piece = raw[at[k]:at[k + 1]]
            known = self.memo.long.get(piece)
            entry[k] = self.memo.add_long(piece, self._merged([piece])[0]) if known is None else known
        count = self.memo.size[entry]
        return self.memo.ids[_ragged(self.memo.start[entry], count)], count

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset in its text where each of a text's tokens begins."""
        size = self.tokens.size[ids]
        return np.cumsum(size) - size

    def decode(self, ids: np.ndarray) -> bytes:
        return self.tokens(ids)[0].tobytes()


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of key columns: one index for each distinct column, and the number of each column's."""
    order = np.lexsort(keys)
    ordered = keys[:, order]
    new = np.concatenate([[True], (ordered[:, 1:] != ordered[:, :-1]).any(axis=0)])
    back = np.empty(len(order), dtype=np.int64)
    back[order] = np.cumsum(new) - 1
    return order[new], back


def codec_of(spark, path: str):
    """A broadcast of the rank file at ``path`` and of the class table, which each worker would
    otherwise build anew (bounded by the vocabulary and by Unicode)."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), classes().tobytes()))


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """One codec for each worker process and rank file."""
    raw, kinds = shared.value
    key = hash(raw)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(read_ranks(raw), np.frombuffer(kinds, dtype=np.uint8))
    return _codecs[key]


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    """Consecutive texts of about CHUNK_CHARS code points: bounds the arrays of a step."""
    part, chars = [], 0
    for t in texts:
        part.append(t)
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield part
            part, chars = [], 0
    if part:
        yield part


def encode(docs: DataFrame, path: str, offsets: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and, if asked for, ``offsets`` (of each token, in bytes)."""
    shared = codec_of(docs.sparkSession, path)

    @F.pandas_udf("ids array<int>, offsets array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for batch in texts:
            found = [x for part in _chunks([t or "" for t in batch]) for x in codec.encode(part)]
            yield pd.DataFrame({"ids": found, "offsets": [codec.offsets(x).astype(np.int32) for x in found]})

    return with_struct(docs, run("text"), ("ids", "offsets") if offsets else ("ids",))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary), from its column ``ids`` (null: empty)."""
    shared = codec_of(encoded.sparkSession, path)

    @F.pandas_udf("binary")
    def run(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for batch in ids:
            yield pd.Series([b"" if x is None else codec.decode(np.asarray(x, dtype=np.int64)) for x in batch],
                            dtype=object)

    return with_struct(encoded, F.struct(run("ids").alias("decoded")), ("decoded",))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: encodes each text, decodes
    the ids again, and keeps only the digests, so no id list leaves a batch."""
    shared = codec_of(docs.sparkSession, path)
    names = ("n_tokens", "ids_sha256", "decoded_sha256")

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(shared)
        for batch in texts:
            rows = []
            for part in _chunks([t or "" for t in batch]):
                found = codec.encode(part)
                listed, comma = codec.numerals(found.ids)
                decoded, byte = codec.tokens(found.ids)
                for a, b in zip(found.first[:-1], found.first[1:], strict=True):
                    rows.append((b - a, hashlib.sha256(listed[comma[a]:max(comma[a], comma[b] - 1)]).hexdigest(),
                                 hashlib.sha256(decoded[byte[a]:byte[b]]).hexdigest()))
            yield pd.DataFrame(rows, columns=list(names))

    return with_struct(docs, run("text"), names)
