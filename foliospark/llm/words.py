"""Vectorised word spans, word hashes and window hashes over Arrow text batches.

Every operator that reads whole texts word by word shares this kernel: one numpy pass
over the bytes of a batch gives the word boundaries and the XXH64 of every word (spans of
equal hash are told apart by their bytes in exact_numbers); window
hashes then come from prefix sums of polynomials over the word hashes in the field of
2**61 - 1 elements (modulo a power of two, some word patterns would collide for every
base).  Bytes are read in pieces of about a megabyte cut between words; what is returned
takes 32 bytes a word, so memory follows the words of a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20

#: `[^\x20\x09-\x0D]+` on UTF-8 bytes: every byte but ASCII white space.
PLAIN = np.ones(256, dtype=bool)
PLAIN[[0x20, *range(0x09, 0x0E)]] = False

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z: digits, letters and every non-ASCII byte.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: Byte map that lower-cases A-Z and leaves everything else.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

#: Window hashes are polynomials over the field of this many elements.
FIELD = (1 << 61) - 1
_FIELD, _LOW32, _LOW29 = np.uint64(FIELD), np.uint64((1 << 32) - 1), np.uint64((1 << 29) - 1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (a bijection on unsigned 64-bit integers)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def xxh64(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of the bytes [start, end) of each span: short ones all at once, those of 32 bytes or more by the library."""
    n = end - start
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight, four = (np.ndarray((len(data) + 1,), kind, padded, 0, (1,)) for kind in ("<u8", "<u4"))
    h = n.astype(np.uint64) + np.uint64(seed) + _P5
    for k in range(0, 24, 8):
        some = np.flatnonzero(n >= k + 8)
        if not len(some):
            break
        h[some] = _turn(h[some] ^ (_turn(eight[start[some] + k] * _P2, 31) * _P1), 27) * _P1 + _P4
    at = start + (n & ~7)
    some = np.flatnonzero(n & 4)
    h[some] = _turn(h[some] ^ (four[at[some]].astype(np.uint64) * _P1), 23) * _P2 + _P3
    at += n & 4
    for k in range(3):
        some = np.flatnonzero((n & 3) > k)
        h[some] = _turn(h[some] ^ (padded[at[some] + k].astype(np.uint64) * _P5), 11) * _P1
    h ^= h >> np.uint64(33)
    h *= _P2
    h ^= h >> np.uint64(29)
    h *= _P3
    h ^= h >> np.uint64(32)
    long = np.flatnonzero(n >= 32)
    if len(long):
        raw, digest = memoryview(np.ascontiguousarray(data)), xxhash.xxh64_intdigest
        h[long] = [digest(raw[a:b], seed) for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)]
    return h


def _reduced(x: np.ndarray) -> np.ndarray:
    """Any 64-bit integer modulo the field's size."""
    x = (x & _FIELD) + (x >> np.uint64(61))
    return np.where(x >= _FIELD, x - _FIELD, x)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field; 2**61 is 1 there, so the 122 bits fold into sums of parts below 2**61."""
    a1, a0, b1, b0 = a >> np.uint64(32), a & _LOW32, b >> np.uint64(32), b & _LOW32
    mid, low = a1 * b0 + a0 * b1, a0 * b0
    return _reduced(((a1 * b1) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & _LOW29) << np.uint64(32)) + (low & _FIELD) + (low >> np.uint64(61)))


def _running(x: np.ndarray) -> np.ndarray:
    """Prefix sums in the field, the empty one first; halves are summed apart so that nothing overflows."""
    low = np.cumsum(x & _LOW32, dtype=np.uint64)
    high = _reduced(np.cumsum(x >> np.uint64(32), dtype=np.uint64))
    out = np.zeros(len(x) + 1, dtype=np.uint64)
    out[1:] = _reduced(_reduced(low) + (high >> np.uint64(29)) + ((high & _LOW29) << np.uint64(32)))
    return out


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i in the field for i up to n."""
    got = _powers.get(base)
    if got is None or len(got[0]) <= n:
        size = max(n + 1, PIECE + 4096)
        both = []
        for x in (base % FIELD, pow(base, -1, FIELD)):
            out = np.ones(size, dtype=np.uint64)
            done = 1
            while done < size:
                more = min(done, size - done)
                out[done : done + more] = _times(out[:more], np.uint64(pow(x, done, FIELD)))
                done += more
            both.append(out)
        got = _powers[base] = tuple(both)
    return got


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of len(column) + 1) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    _, off, data = column.buffers()
    if n == 0 or data is None or data.size == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offsets = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = 4 * PIECE):
    """Row ranges of about `limit` bytes each; a longer text is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end
        at = end


class Words:
    """The words of some texts: byte spans [start, end), row of each, and hashes by seed."""

    __slots__ = ("end", "first", "hashes", "row", "start")

    def __init__(self, start, end, row, hashes, first):
        self.start, self.end, self.row, self.hashes, self.first = start, end, row, hashes, first

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def find_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = PLAIN, fold: np.ndarray | None = None, seeds: tuple[int, ...] = (1,)) -> Words:
    """Words of the texts data[offsets[r]:offsets[r+1]]; `first[r]` is the index of row r's first word."""
    n = len(data)
    starts, ends, hashes = [], [], {s: [] for s in seeds}
    rows_at = offsets[1:-1]
    at = 0
    while at < n:
        stop = min(n, at + PIECE)
        while stop < n:  # cut between words, or where a text begins
            nxt = table[data[stop : stop + 4096]]
            gap = np.flatnonzero(~nxt)
            lo = np.searchsorted(rows_at, stop)
            edge = int(rows_at[lo]) if lo < len(rows_at) else n
            cut = min(stop + int(gap[0]) if len(gap) else n, edge)
            if cut <= stop + len(nxt):
                stop = cut
                break
            stop += len(nxt)
        piece = data[at:stop]
        is_word = table[piece]
        before = np.empty(len(piece) + 1, dtype=bool)
        before[0] = before[-1] = False
        before[1:] = is_word
        opens = is_word & ~before[:-1]
        after = np.empty(len(piece), dtype=bool)
        after[:-1] = is_word[1:]
        after[-1] = False
        closes = is_word & ~after
        lo, hi = np.searchsorted(rows_at, at, side="left"), np.searchsorted(rows_at, stop, side="left")
        edges = np.unique(rows_at[lo:hi]) - at
        if len(edges):
            opens[edges] = is_word[edges]
            inner = edges[edges > 0] - 1
            closes[inner] = is_word[inner]
        s, e = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        if len(s):
            if fold is not None:
                piece = fold[piece]
            for seed in seeds:
                hashes[seed].append(xxh64(piece, s, e, seed))
            starts.append(s + at)
            ends.append(e + at)
        at = stop
    none = np.zeros(0, dtype=np.int64)
    start = np.concatenate(starts) if starts else none
    end = np.concatenate(ends) if ends else none
    first = np.searchsorted(start, offsets, side="left")
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    got = {s: np.concatenate(h) if h else np.zeros(0, dtype=np.uint64) for s, h in hashes.items()}
    return Words(start, end, row, got, first)


def equal_spans(data: np.ndarray, start: np.ndarray, other: np.ndarray, there: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether data[start:start + size] and other[there:there + size] hold the same bytes, elementwise: eight bytes at a time, long spans by slices."""
    same = np.ones(len(size), dtype=bool)
    short = np.flatnonzero(size <= 64)
    a, b, n = start[short], there[short], size[short]
    mine, its = (np.ndarray((max(len(x) - 7, 0),), "<u8", np.ascontiguousarray(x), 0, (1,)) for x in (data, other))
    for k in range(0, int(n.max(initial=0)), 8):
        some = np.flatnonzero(n >= k + 8)
        same[short[some]] &= mine[a[some] + k] == its[b[some] + k]
    for k in range(7):
        some = np.flatnonzero((n & 7) > k)
        at = (n[some] & ~7) + k
        same[short[some]] &= data[a[some] + at] == other[b[some] + at]
    for i in np.flatnonzero(size > 64).tolist():
        same[i] = data[start[i] : start[i] + size[i]].tobytes() == other[there[i] : there[i] + size[i]].tobytes()
    return same


def exact_numbers(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each span, the same for equal bytes and for these only; hashes only propose."""
    kinds, first, number = np.unique(hashes, return_index=True, return_inverse=True)
    model, size = first[number], end - start
    same = size == size[model]
    some = np.flatnonzero(same)
    same[some] = equal_spans(data, start[some], data, start[model[some]], size[some])
    others: dict[bytes, int] = {}
    for i in np.flatnonzero(~same).tolist():
        number[i] = len(kinds) + others.setdefault(data[start[i] : end[i]].tobytes(), len(others))
    return number


def windows(hashes: np.ndarray, first: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first word, hash) of every window of `width` words inside one text."""
    n = len(hashes)
    if n < width:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    ok = np.ones(n - width + 1, dtype=bool)
    for f in np.unique(first[1:-1]) if len(first) < 65 else ():  # few texts: mark directly
        ok[max(0, f - width + 1) : f] = False
    if len(first) >= 65:
        last = np.repeat(first[1:], np.diff(first))[: n - width + 1]
        ok = np.arange(n - width + 1) + width <= last
    at = np.flatnonzero(ok)
    sums = window_sums(hashes, base)
    return at, window_at(sums, at, at + width, base)


def window_sums(hashes: np.ndarray, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Prefix sums from which window_at() takes the hash of any run of words."""
    up, _ = powers(base, len(hashes))
    return _running(_times(_reduced(hashes), up[: len(hashes)]))


def window_at(sums: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hash of the words [start, end), the same wherever they stand."""
    _, down = powers(base, len(sums))
    whole = _times(_reduced(sums[end] + (_FIELD - sums[start])), down[start])
    return mix(whole ^ ((end - start).astype(np.uint64) * _P1))
