"""Words of whole Arrow text columns as flat numpy arrays, without a Python loop per word.

A word is a maximal run of bytes other than the six ASCII white-space bytes (0x20, 0x09-0x0D),
which is what the pattern ``[^\\x20\\x09-\\x0D]+`` finds in the text, as no byte of a longer
UTF-8 character is one of the six. Null texts have no words.
"""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def release() -> None:
    """Give memory that is free back to the system, at the end of a task: a worker that waits for
    its next one then takes little beside the others of its executor."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def hold() -> None:
    """Let memory that a task frees stay with it until release(): arrays of a megabyte that come and
    go would otherwise be mapped anew each time."""
    try:
        c = ctypes.CDLL(None)
        c.mallopt(-3, 1 << 28)  # the size from which memory is mapped
        c.mallopt(-1, 1 << 28)  # what may be free before it is given back
    except (OSError, AttributeError):
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the first 0 to 8 bytes of a little-endian number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a word beyond which it is hashed by itself.
LONG = 64
_K1, _K2 = np.uint64(_BASE), np.uint64(0xC2B2AE3D27D4EB4F)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept for the next batch."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and n + 1 offsets into them."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks)
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, column: int | str, size: int = 2_000_000):
    """Parts of a batch with about size bytes of text, so that what is worked out for each byte
    stays small however many rows a batch has; a longer text is a part of its own."""
    texts = batch.column(column)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    offsets = texts.buffers()[1] if len(texts) else None
    if offsets is None:
        if len(batch):
            yield batch
        return
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    start = 0
    while start < len(batch):
        end = max(int(np.searchsorted(at, at[start] + size, "right")) - 1, start + 1)
        yield batch.slice(start, end - start)
        start = end


class Words:
    """start, end: byte range of each word in data; at: n + 1 offsets of the texts' first words."""

    def __init__(self, texts: pa.Array):
        self.data, self.offsets = buffers(texts)
        data, offsets, size = self.data, self.offsets, len(self.data)
        if size:
            space = SPACE[data]
            before = np.empty(size, bool)
            before[0], before[1:] = True, space[:-1]
            before[offsets[:-1][offsets[:-1] < size]] = True
            after = np.empty(size, bool)
            after[-1], after[:-1] = True, space[1:]
            after[offsets[1:][offsets[1:] > 0] - 1] = True
            word = ~space
            self.start = np.flatnonzero(word & before)
            self.end = np.flatnonzero(word & after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.at = np.searchsorted(self.start, offsets)
        self.at[-1] = len(self.start)

    def __len__(self) -> int:
        return len(self.start)

    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; A-Z count as a-z if lower."""
        return self.prints(lower)[0]

    def prints(self, lower: bool) -> tuple[np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each word that don't follow from each other: eight bytes at a time
        go into a state of 128 bits; words beyond LONG bytes are hashed by XXH3 with 128 bits."""
        start, length = self.start, self.end - self.start
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[:-8] = _LOWER[self.data] if lower else self.data
        eight = np.ndarray(len(self.data), "<u8", padded, strides=(1,))
        one, two = length.astype(np.uint64) * _K1, length.astype(np.uint64) ^ _K2
        live, done = slice(None), 0
        while True:
            left = length[live] - done
            part = eight[start[live] + done] & _MASKS[np.minimum(left, 8)]
            one[live] = mix(one[live] ^ part)
            state = two[live]
            state = ((state << np.uint64(29) | state >> np.uint64(35)) + part) * _K2
            two[live] = state ^ state >> np.uint64(31)
            done += 8
            more = np.flatnonzero((left > 8) & (left <= LONG - done + 8))
            if not len(more):
                break
            live = more if isinstance(live, slice) else live[more]
        for i in np.flatnonzero(length > LONG).tolist():
            whole = xxhash.xxh3_128_intdigest(padded[start[i] : self.end[i]].tobytes())
            one[i], two[i] = whole & 0xFFFFFFFFFFFFFFFF, whole >> 64
        return mix(one + two * _K1), mix(two ^ one * _K2)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words, by place; the last size - 1 places have none."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = hashes * powers(_BASE, len(hashes))
    np.cumsum(total, out=total)
    got = total[size - 1 :].copy()
    got[1:] -= total[: n - 1]
    got *= powers(pow(_BASE, -1, 1 << 64), n)
    return mix(got + np.uint64(size))


def shingles(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of every text, ascending in each, and their n + 1 offsets.

    A text with fewer words than size has its whole sequence as its only shingle."""
    words = Words(texts)
    hashes, counts, at = words.hashes(True), words.counts(), words.at
    grams = windows(hashes, size)
    out, lengths = [], np.zeros(len(counts), np.int64)
    for i in np.flatnonzero(counts):
        n, first = counts[i], at[i]
        if n < size:
            own = windows(hashes[first : first + n], int(n))
        else:
            own = grams[first : first + n - size + 1].copy()
            own.sort()
            own = own[np.r_[True, own[1:] != own[:-1]]]
        lengths[i] = len(own)
        out.append(own)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), np.r_[0, np.cumsum(lengths)]
