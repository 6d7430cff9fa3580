"""Decoders of the eighties: run lengths, squeezing, LZW and LZ with Huffman codes."""

from __future__ import annotations

from ...errors import corrupt
from ..codecs import codes, copy


def rle90(raw: bytes) -> bytes:
    """A 0x90 repeats the byte before so many times in all; 0x90 0x00 is a 0x90."""
    out, at, last = bytearray(), 0, 0
    while at < len(raw):
        b = raw[at]
        at += 1
        if b != 0x90:
            out.append(b)
            last = b
            continue
        if at >= len(raw):
            raise corrupt("run is cut short")
        n = raw[at]
        at += 1
        if n == 0:
            out.append(0x90)
            last = 0x90
        else:
            out += bytes([last]) * (n - 1)
    return bytes(out)


def unsqueeze(raw: bytes) -> bytes:
    """A tree of nodes with two signed children: a leaf is -(value + 1), and 256 ends."""
    if len(raw) < 2:
        raise corrupt("squeezed data is cut short")
    n = int.from_bytes(raw[:2], "little")
    if n > 257 or 2 + 4 * n > len(raw):
        raise corrupt("squeeze tree")
    nodes = [(int.from_bytes(raw[2 + 4 * i : 4 + 4 * i], "little", signed=True), int.from_bytes(raw[4 + 4 * i : 6 + 4 * i], "little", signed=True)) for i in range(n)]
    if not n:
        return b""
    out, at = bytearray(), 0
    for b in raw[2 + 4 * n :]:
        for k in range(8):
            at = nodes[at][b >> k & 1]
            if at >= n:
                raise corrupt("squeeze tree")
            if at < 0:
                if at == -257:
                    return bytes(out)
                out.append(-(at + 1))
                at = 0
    raise corrupt("squeezed data is cut short")


def lzw_dynamic(raw: bytes, most: int, clear: bool = True, start: int = 257, limit: int | None = None, end: int | None = None, group: bool = True) -> bytes:
    """LZW with codes of 9 bits up to most, from the low end, 256 clearing the table."""
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b""] * (start - 256)
    out, bit, width, last, size, begin = bytearray(), 0, 9, None, 8 * len(raw), 0
    while bit + width <= size and (limit is None or len(out) < limit):
        code = int.from_bytes(raw[bit >> 3 : (bit >> 3) + 4], "little") >> (bit & 7) & (1 << width) - 1
        bit += width
        if code == end and end is not None:
            break
        if clear and code == 256:
            if group:
                bit = begin + -(-(bit - begin) // (8 * width)) * 8 * width
            del table[start:]
            width, last, begin = 9, None, bit
            continue
        if code < len(table):
            entry = table[code]
        elif code == len(table) and last is not None:
            entry = last + last[:1]
        else:
            raise corrupt("LZW code without an entry")
        if last is not None and len(table) < 1 << most:
            table.append(last + entry[:1])
        out += entry
        last = entry
        if len(table) >= 1 << width and width < most:
            if group:
                bit = begin + -(-(bit - begin) // (8 * width)) * 8 * width
            begin, width = bit, width + 1
    return bytes(out)


def lzh(raw: bytes, size: int, window: int, n_positions: int, position_bits: int) -> bytes:
    """The later LHarc scheme: blocks of a count, three tables of code lengths and codes, lengths
    from 3 and distances by the number of their bits."""
    out, bits, left = bytearray(), _Stream(raw), 0
    while len(out) < size:
        if not left:
            left = bits.take(16) or 65536
            short = _lengths(bits, 19, 5, 3)
            main = _main_lengths(bits, short)
            where = _lengths(bits, n_positions, position_bits, -1)
        left -= 1
        s = _next(bits, main)
        if s < 256:
            out.append(s)
            continue
        p = _next(bits, where)
        distance = p if p < 2 else (1 << p - 1) + bits.take(p - 1)
        n = s - 253
        if distance + 1 > len(out):
            out += b""
            # Before the start the window holds blanks.
            for _ in range(n):
                out.append(out[-distance - 1] if distance < len(out) else 0x20)
        else:
            copy(out, distance + 1, n)
    return bytes(out[:size])


class _Stream:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.have, self.n = raw, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            if self.at > len(self.raw) + 16:
                raise corrupt("bit stream is cut short")
            self.have = self.have << 8 | (self.raw[self.at] if self.at < len(self.raw) else 0)
            self.at += 1
            self.n += 8
        self.n -= n
        out = self.have >> self.n
        self.have &= (1 << self.n) - 1
        return out


def _lengths(bits: _Stream, most: int, width: int, gap: int):
    n = bits.take(width)
    if not n:
        return bits.take(width)
    out = []
    while len(out) < n:
        k = bits.take(3)
        if k == 7:
            while bits.take(1):
                k += 1
        out.append(k)
        if len(out) == gap:
            out += [0] * bits.take(2)
    if len(out) > most:
        raise corrupt("too many code lengths")
    return codes(out)


def _main_lengths(bits: _Stream, short):
    n = bits.take(9)
    if not n:
        return bits.take(9)
    out: list[int] = []
    while len(out) < n:
        s = _next(bits, short)
        if s > 2:
            out.append(s - 2)
        else:
            out += [0] * (1 if s == 0 else bits.take(4) + 3 if s == 1 else bits.take(9) + 20)
    return codes(out[:n])


def _next(bits: _Stream, table) -> int:
    if isinstance(table, int):
        return table
    code = 0
    for n in range(1, 25):
        code = code << 1 | bits.take(1)
        if (n, code) in table:
            return table[n, code]
    raise corrupt("no such code")


def powerpacker(raw: bytes) -> bytes:
    """Read from the end: literals and matches ahead, with offset widths from the header."""
    if len(raw) < 16 or raw[:4] != b"PP20":
        raise corrupt("PowerPacker header")
    widths, size, skip = raw[4:8], int.from_bytes(raw[-4:-1], "big"), raw[-1]
    data, at, have, n = raw[8:-4], len(raw) - 12, 0, 0

    def take(count: int) -> int:
        nonlocal at, have, n
        while n < count:
            at -= 1
            if at < 0:
                raise corrupt("PowerPacker data is cut short")
            have |= data[at] << n
            n += 8
        value = 0
        for _ in range(count):
            value = value << 1 | have & 1
            have >>= 1
            n -= 1
        return value

    take(skip)
    out = bytearray()  # backwards
    while len(out) < size:
        if not take(1):
            count = 1
            while (k := take(2)) == 3:
                count += 3
            for _ in range(count + k):
                out.append(take(8))
            if len(out) >= size:
                break
        k = take(2)
        width, count = widths[k], k + 2
        if k == 3:
            if not take(1):
                width = 7
            distance = take(width)
            while (more := take(3)) == 7:
                count += 7
            count += more
        else:
            distance = take(width)
        copy(out, distance + 1, count)
    return bytes(out[:size][::-1])


class HuffmanTree:
    """A tree that stands before its data: bit 1 and eight bits are a leaf, bit 0 two subtrees."""

    def __init__(self, bits: _Stream):
        self.bits = bits
        self.root = self._read(0)

    def _read(self, depth: int):
        if depth > 256:
            raise corrupt("Huffman tree is too deep")
        if self.bits.take(1):
            return self.bits.take(8)
        return self._read(depth + 1), self._read(depth + 1)

    def take(self, n: int) -> bytes:
        out = bytearray()
        for _ in range(n):
            node = self.root
            while isinstance(node, tuple):
                node = node[self.bits.take(1)]
            out.append(node)
        return bytes(out)


def huffman(raw: bytes, size: int) -> bytes:
    return HuffmanTree(_Stream(raw)).take(size)


#: What a block of Compact Pro holds: two for a literal, three for a match.
_BLOCK = 0x1FFF0


def compact_lzh(raw: bytes, size: int | None = None) -> bytes:
    """Blocks of three tables of code lengths, of a nibble each, then literals (bit 1) and matches
    of a length, the high bits of a distance and six low ones."""
    out, bits, left, begin = bytearray(), _Stream(raw), 0, None

    def table(n: int):
        k = bits.take(8)
        if 2 * k > n:
            raise corrupt("Compact Pro code lengths")
        return codes([bits.take(4) for _ in range(2 * k)])

    while size is None or len(out) < size:
        if size is None and bits.at >= len(raw) and bits.n < 8 and not bits.have:
            break
        if left <= 0:
            if begin is not None:  # blocks end at an even place, and two bytes on
                bits.take(bits.n % 8)
                place = bits.at - bits.n // 8
                bits.take(24 if (place - begin) & 1 else 16)
            literal, length, distance = table(256), table(64), table(128)
            left, begin = _BLOCK, bits.at - bits.n // 8
        if bits.take(1):
            out.append(_next(bits, literal))
            left -= 2
        else:
            n = _next(bits, length)
            copy(out, _next(bits, distance) << 6 | bits.take(6), n)
            left -= 3
    return bytes(out)
