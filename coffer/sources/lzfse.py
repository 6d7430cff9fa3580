"""LZFSE and LZVN, from the published format."""

from __future__ import annotations

import struct

from ..errors import corrupt
from .codecs import copy


def lzvn(raw: bytes, size: int) -> bytes:
    """Literals and matches by opcode; a match may use the distance of the one before."""
    out, at, distance = bytearray(), 0, 0
    try:
        while len(out) < size:
            op = raw[at]
            literals = n = 0
            if op >= 0xF0:  # a match at the old distance
                n, at = (op & 15, at + 1) if op & 15 else (raw[at + 1] + 16, at + 2)
            elif op >= 0xE0:  # literals
                literals, at = (op & 15, at + 1) if op & 15 else (raw[at + 1] + 16, at + 2)
            elif 0xA0 <= op < 0xC0:
                literals, n = op >> 3 & 3, ((op & 7) << 2 | raw[at + 1] & 3) + 3
                distance, at = raw[at + 1] >> 2 | raw[at + 2] << 6, at + 3
            elif 0x70 <= op < 0x80 or 0xD0 <= op < 0xE0:
                raise corrupt("LZVN opcode")
            else:
                literals, n = op >> 6, (op >> 3 & 7) + 3
                if op & 7 == 7:
                    distance, at = raw[at + 1] | raw[at + 2] << 8, at + 3
                elif op & 7 < 6:
                    distance, at = (op & 7) << 8 | raw[at + 1], at + 2
                elif op == 0x06:
                    break
                elif op in (0x0E, 0x16):
                    at += 1
                    continue
                elif op < 0x40:
                    raise corrupt("LZVN opcode")
                else:
                    at += 1
            if at + literals > len(raw):
                raise corrupt("LZVN data is cut short")
            out += raw[at : at + literals]
            at += literals
            if n:
                copy(out, distance, n)
    except IndexError:
        raise corrupt("LZVN data is cut short") from None
    if len(out) < size:
        raise corrupt("LZVN data is cut short")
    return bytes(out[:size])


# Extra bits of the last symbols of literal runs and match lengths.
_LITERAL_BITS = [0] * 16 + [2, 3, 5, 8]
_MATCH_BITS = [0] * 16 + [3, 5, 8, 11]
_DISTANCE_BITS = [i // 4 for i in range(64)]


def _bases(bits: list[int]) -> list[int]:
    out = [0]
    for b in bits[:-1]:
        out.append(out[-1] + (1 << b))
    return out


class _Back:
    """Bits from the end of a payload, whose last byte lacks some."""

    def __init__(self, raw: bytes, lacking: int):
        self.raw, self.at = raw, 8 * len(raw) + lacking

    def take(self, n: int) -> int:
        self.at -= n
        if self.at < 0:
            raise corrupt("LZFSE payload is cut short")
        byte = self.at >> 3
        return int.from_bytes(self.raw[byte : byte + 8], "little") >> (self.at & 7) & (1 << n) - 1


def _states(counts: list[int], total: int) -> list[tuple[int, int, int]]:
    """(bits, delta, symbol) of each state: a symbol has as many states as its count."""
    if sum(counts) > total:
        raise corrupt("LZFSE counts")
    out = []
    for symbol, f in enumerate(counts):
        if not f:
            continue
        k = total.bit_length() - f.bit_length()
        first = (2 * total >> k) - f
        for j in range(f):
            out.append((k, ((f + j) << k) - total, symbol) if j < first else (k - 1, (j - first) << (k - 1), symbol))
    return out + [(0, 0, 0)] * (total - len(out))


def _counts(raw: bytes, n: int) -> list[int]:
    """n counts of variable length, from the low end."""
    value, at, out = int.from_bytes(raw, "little"), 0, []
    # By five bits, how many belong to a count and which it is.
    sizes = [2, 3, 2, 5, 2, 3, 2, 8, 2, 3, 2, 5, 2, 3, 2, 14] * 2
    small = [0, 2, 1, 4, 0, 3, 1, -1, 0, 2, 1, 5, 0, 3, 1, -1, 0, 2, 1, 6, 0, 3, 1, -1, 0, 2, 1, 7, 0, 3, 1, -1]
    while len(out) < n:
        bits = value >> at
        size = sizes[bits & 31]
        out.append(8 + (bits >> 4 & 15) if size == 8 else 24 + (bits >> 4 & 0x3FF) if size == 14 else small[bits & 31])
        at += size
    if at > 8 * len(raw) + 7:
        raise corrupt("LZFSE counts")
    return out


def _block(raw: bytes, at: int, out: bytearray) -> int:
    """A block with entropy coding; gives the place behind it."""
    n_raw, a, b, c = struct.unpack_from("<IQQQ", raw, at + 4)
    cut = lambda v, start, n: v >> start & (1 << n) - 1
    n_literals, literal_bytes, n_matches, literal_lack = cut(a, 0, 20), cut(a, 20, 20), cut(a, 40, 20), cut(a, 60, 3) - 7
    states = [cut(b, 10 * k, 10) for k in range(4)]
    match_bytes, match_lack = cut(b, 40, 20), cut(b, 60, 3) - 7
    header, *now = cut(c, 0, 32), cut(c, 32, 10), cut(c, 42, 10), cut(c, 52, 10)
    if header < 32 or at + header + literal_bytes + match_bytes > len(raw):
        raise corrupt("LZFSE block is out of bounds")
    counts = _counts(raw[at + 32 : at + header], 20 + 20 + 64 + 256)
    tables = [_states(counts[:20], 64), _states(counts[20:40], 64), _states(counts[40:104], 256)]
    literal_table = _states(counts[104:], 1024)
    bits = _Back(raw[at + header : at + header + literal_bytes], literal_lack)
    literals = bytearray()
    for _ in range(0, n_literals, 4):
        for k in range(4):
            n, delta, symbol = literal_table[states[k]]
            states[k] = delta + bits.take(n)
            literals.append(symbol)
    start = at + header + literal_bytes
    bits = _Back(raw[start : start + match_bytes], match_lack)
    extra = (_LITERAL_BITS, _MATCH_BITS, _DISTANCE_BITS)
    base = tuple(map(_bases, extra))
    used = distance = 0
    end = len(out) + n_raw
    for _ in range(n_matches):
        got = []
        for k in range(3):
            n, delta, symbol = tables[k][now[k]]
            more = extra[k][symbol]
            value = bits.take(n + more)
            now[k] = delta + (value >> more)
            got.append(base[k][symbol] + (value & (1 << more) - 1))
        run, length, d = got
        distance = d or distance
        if used + run > len(literals):
            raise corrupt("LZFSE literals are cut short")
        out += literals[used : used + run]
        used += run
        if length:
            copy(out, distance, length)
    if len(out) != end:
        raise corrupt("LZFSE block has another size")
    return start + match_bytes


def lzfse(raw: bytes) -> bytes:
    """Blocks up to the end mark."""
    out, at = bytearray(), 0
    try:
        while True:
            magic = raw[at : at + 4]
            if magic == b"bvx$":
                return bytes(out)
            if magic == b"bvx-":
                n, = struct.unpack_from("<I", raw, at + 4)
                if at + 8 + n > len(raw):
                    raise corrupt("LZFSE block is cut short")
                out += raw[at + 8 : at + 8 + n]
                at += 8 + n
            elif magic == b"bvxn":
                n, packed = struct.unpack_from("<II", raw, at + 4)
                out += lzvn(raw[at + 12 : at + 12 + packed], n)
                at += 12 + packed
            elif magic == b"bvx2":
                at = _block(raw, at, out)
            else:
                raise corrupt("LZFSE block")
    except (struct.error, IndexError) as e:
        raise corrupt(f"LZFSE: {e}") from None
