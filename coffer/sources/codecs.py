"""Compressed streams to bytes."""

from __future__ import annotations

import bz2
import lzma
import zlib

import pyarrow as pa
import zstandard

from ..errors import ArchiveError, corrupt, unsupported

GZIP, BZIP2, XZ, ZSTD, LZMA, LZC, LZ4, BROTLI = "Gzip", "Bzip2", "Xz", "Zstd", "Lzma", "Lzc", "Lz4", "Brotli"

# What a compressed stream starts with.
MAGICS = ((b"\x1f\x8b", GZIP), (b"BZh", BZIP2), (b"\xfd7zXZ\x00", XZ), (b"\x28\xb5\x2f\xfd", ZSTD), (b"\x1f\x9d", LZC), (b"\x04\x22\x4d\x18", LZ4))
#: Most of a dictionary that a stream may ask for.
MAX_DICT = 256 << 20


def detect_compressor(header: bytes) -> str | None:
    return next((kind for magic, kind in MAGICS if header.startswith(magic)), None)


def compressor_by_name(name: str) -> str | None:
    return BROTLI if name.lower().endswith(".br") else None


def gunzip(raw: bytes) -> bytes:
    """All members; zeros after the last one are padding."""
    out = []
    while raw:
        d = zlib.decompressobj(31)
        out.append(d.decompress(raw))
        if not d.eof:
            raise corrupt("gzip stream is cut short")
        raw = d.unused_data.lstrip(b"\0")
    return b"".join(out)


def members(raw: bytes):
    """The members of a gzip file one by one."""
    while raw:
        d = zlib.decompressobj(31)
        out = d.decompress(raw)
        if not d.eof:
            raise corrupt("gzip member is cut short")
        yield out
        raw = d.unused_data.lstrip(b"\0")


def _first(d, raw: bytes) -> bytes:
    """The first stream only, as of a decoder that stops at its end."""
    out = d.decompress(raw)
    if not d.eof:
        raise corrupt("compressed stream is cut short")
    return out


def unzstd(raw: bytes) -> bytes:
    out = []
    while raw:
        if raw[:4] != b"\x28\xb5\x2f\xfd":
            if len(raw) >= 8 and 0x184D2A50 <= int.from_bytes(raw[:4], "little") <= 0x184D2A5F:
                raw = raw[8 + int.from_bytes(raw[4:8], "little") :]
                continue
            raise corrupt("no zstd frame")
        d = zstandard.ZstdDecompressor(max_window_size=1 << 31).decompressobj()
        out.append(d.decompress(raw))
        if not d.eof:
            raise corrupt("zstd frame is cut short")
        raw = d.unused_data
    return b"".join(out)


def lzw(raw: bytes) -> bytes:
    """Unix compress: codes of 9 bits and more, in groups of eight codes of a width."""
    if len(raw) < 3 or raw[:2] != b"\x1f\x9d":
        raise corrupt("no compress header")
    most, block = raw[2] & 31, bool(raw[2] & 0x80)
    if not 9 <= most <= 16:
        raise corrupt("code width out of range")
    table: list[bytes] = [bytes([i]) for i in range(256)] + ([b""] if block else [])
    out, bit, width, last, start = [], 24, 9, None, 24
    total = len(raw) * 8
    while bit + width <= total:
        at = bit >> 3
        code = (int.from_bytes(raw[at : at + 4], "little") >> (bit & 7)) & ((1 << width) - 1)
        bit += width
        if block and code == 256:
            # The rest of the group of eight codes is not used.
            group = width * 8
            bit = start + -(-(bit - start) // group) * group
            del table[257:]
            width, last, start = 9, None, bit
            continue
        if last is None:
            if code >= 256:
                raise corrupt("LZW code without an entry")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table) and len(table) < 1 << most:
                entry = last + last[:1]
            else:
                raise corrupt("LZW code without an entry")
            if len(table) < 1 << most:
                table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) >= 1 << width and width < most:
            group = width * 8
            bit = start + -(-(bit - start) // group) * group
            start, width = bit, width + 1
    return b"".join(out)


def _arrow(kind: str, raw: bytes) -> bytes:
    with pa.CompressedInputStream(pa.BufferReader(raw), kind) as f:
        return f.read()


def raw_lzma(raw: bytes, props: bytes, size: int | None, filters: list | None = None) -> bytes:
    """LZMA1 after five property bytes."""
    if len(props) != 5:
        raise corrupt("LZMA properties have a wrong length")
    d, dictionary = props[0], int.from_bytes(props[1:5], "little")
    if d >= 225:
        raise corrupt("LZMA properties out of range")
    if dictionary > MAX_DICT:
        raise unsupported("LZMA dictionary is too large")
    own = {"id": lzma.FILTER_LZMA1, "dict_size": max(dictionary, 4096), "lc": d % 9, "lp": d // 9 % 5, "pb": d // 45}
    dec = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[*(filters or []), own])
    out = dec.decompress(raw, max_length=-1 if size is None else size)
    if size is not None and len(out) < size:
        raise corrupt("LZMA data is cut short")
    return out


def decompress(raw: bytes, kind: str) -> bytes:
    try:
        if kind == GZIP:
            return gunzip(raw)
        if kind == BZIP2:
            return _first(bz2.BZ2Decompressor(), raw)
        if kind == XZ:
            return _first(lzma.LZMADecompressor(lzma.FORMAT_XZ), raw)
        if kind == LZMA:
            return _first(lzma.LZMADecompressor(lzma.FORMAT_ALONE), raw)
        if kind == ZSTD:
            return unzstd(raw)
        if kind == LZC:
            return lzw(raw)
        if kind in (LZ4, BROTLI):
            return _arrow(kind.lower(), raw)
    except ArchiveError:
        raise
    except (zlib.error, lzma.LZMAError, zstandard.ZstdError, OSError, EOFError, ValueError) as e:
        raise corrupt(f"{kind}: {e}") from None
    raise unsupported(f"compressor {kind}")


def inflate(raw: bytes, size: int | None = None, dictionary: bytes = b"") -> bytes:
    d = zlib.decompressobj(-15, zdict=dictionary) if dictionary else zlib.decompressobj(-15)
    try:
        out = d.decompress(raw) + d.flush()
    except zlib.error as e:
        raise corrupt(f"deflate: {e}") from None
    if size is not None and len(out) < size:
        raise corrupt("deflate data is cut short")
    return out if size is None else out[:size]


class Bits:
    """Bits from the low end of each byte."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.have, self.n = raw, 0, 0, 0

    def need(self, n: int) -> None:
        while self.n < n:
            if self.at >= len(self.raw):
                raise corrupt("bit stream is cut short")
            self.have |= self.raw[self.at] << self.n
            self.at += 1
            self.n += 8

    def take(self, n: int) -> int:
        if not n:
            return 0
        self.need(n)
        out = self.have & ((1 << n) - 1)
        self.have >>= n
        self.n -= n
        return out

    def align(self) -> None:
        drop = self.n & 7
        self.have >>= drop
        self.n -= drop


def codes(lengths: list[int], reverse: bool = True) -> dict[tuple[int, int], int]:
    """Canonical Huffman codes: (length, code) to symbol."""
    out, code = {}, 0
    for n in range(1, max(lengths, default=0) + 1):
        for symbol, length in enumerate(lengths):
            if length == n:
                out[n, code] = symbol
                code += 1
        code <<= 1
    return out


def _symbol(bits: Bits, table: dict[tuple[int, int], int]) -> int:
    code = 0
    for n in range(1, 17):
        code = code << 1 | bits.take(1)
        if (n, code) in table:
            return table[n, code]
    raise corrupt("no such Huffman code")


def inflate64(raw: bytes, size: int) -> bytes:
    """Deflate64: deflate with a window of 64 KiB, lengths up to 65538 and 32 distance codes."""
    bits, out = Bits(raw), bytearray()
    length_base, length_bits = [], []
    base = 3
    for i in range(28):
        extra = max(0, (i >> 2) - 1)
        length_base.append(base)
        length_bits.append(extra)
        base += 1 << extra
    length_base[27:], length_bits[27:] = [base - (1 << length_bits[27])], [length_bits[27]]
    length_base.append(3)
    length_bits.append(16)
    dist_base, dist_bits, base = [], [], 1
    for i in range(32):
        extra = max(0, (i >> 1) - 1)
        dist_base.append(base)
        dist_bits.append(extra)
        base += 1 << extra
    order = [16, 17, 18, 0, 8, 7, 9, 6, 10, 5, 11, 4, 12, 3, 13, 2, 14, 1, 15]
    while True:
        final, kind = bits.take(1), bits.take(2)
        if kind == 0:
            bits.align()
            n = bits.take(16)
            bits.take(16)
            out += bytes(bits.take(8) for _ in range(n))
        elif kind == 3:
            raise corrupt("deflate64 block type")
        else:
            if kind == 1:
                lit = codes([8] * 144 + [9] * 112 + [7] * 24 + [8] * 8)
                dist = codes([5] * 32)
            else:
                n_lit, n_dist, n_len = bits.take(5) + 257, bits.take(5) + 1, bits.take(4) + 4
                lengths = [0] * 19
                for k in range(n_len):
                    lengths[order[k]] = bits.take(3)
                table, all_lengths = codes(lengths), []
                while len(all_lengths) < n_lit + n_dist:
                    s = _symbol(bits, table)
                    if s < 16:
                        all_lengths.append(s)
                    elif s == 16:
                        all_lengths += all_lengths[-1:] * (3 + bits.take(2))
                    else:
                        all_lengths += [0] * (3 + bits.take(3) if s == 17 else 11 + bits.take(7))
                lit, dist = codes(all_lengths[:n_lit]), codes(all_lengths[n_lit : n_lit + n_dist])
            while (s := _symbol(bits, lit)) != 256:
                if s < 256:
                    out.append(s)
                    continue
                if s > 285:
                    raise corrupt("deflate64 length code")
                n = length_base[s - 257] + bits.take(length_bits[s - 257])
                d = _symbol(bits, dist)
                copy(out, dist_base[d] + bits.take(dist_bits[d]), n)
        if final or len(out) > size:
            break
    if len(out) != size:
        raise corrupt("deflate64 data has another size")
    return bytes(out)


def copy(out: bytearray, distance: int, n: int) -> None:
    """Append n bytes from distance back; the stretch may overlap its copy."""
    if distance <= 0 or distance > len(out):
        raise corrupt("match before the start")
    start = len(out) - distance
    if distance >= n:
        out += out[start : start + n]
    else:
        whole = bytes(out[start:])
        out += (whole * (n // distance + 1))[:n]


def adc(raw: bytes, size: int | None = None) -> bytes:
    """Apple data compression: literals, short and long matches by the top bits of a byte."""
    out, at = bytearray(), 0
    try:
        while at < len(raw) and (size is None or len(out) < size):
            b = raw[at]
            if b & 0x80:
                n = (b & 0x7F) + 1
                if at + 1 + n > len(raw):
                    raise corrupt("ADC literal is cut short")
                out += raw[at + 1 : at + 1 + n]
                at += 1 + n
            elif b & 0x40:
                copy(out, (raw[at + 1] << 8 | raw[at + 2]) + 1, (b & 0x3F) + 4)
                at += 3
            else:
                copy(out, ((b & 3) << 8 | raw[at + 1]) + 1, (b >> 2 & 15) + 3)
                at += 2
    except IndexError:
        raise corrupt("ADC data is cut short") from None
    return bytes(out)


def lz4_block(raw: bytes, size: int) -> bytes:
    try:
        return pa.Codec("lz4_raw").decompress(raw, size, asbytes=True)
    except (OSError, pa.ArrowException):
        pass
    out, at = bytearray(), 0  # the size was but a bound
    try:
        while at < len(raw):
            token = raw[at]
            at += 1
            n = token >> 4
            while n >= 15:
                n += raw[at]
                at += 1
                if raw[at - 1] != 255:
                    break
            out += raw[at : at + n]
            at += n
            if at >= len(raw):
                break
            distance = raw[at] | raw[at + 1] << 8
            at += 2
            n = token & 15
            while n >= 15:
                n += raw[at]
                at += 1
                if raw[at - 1] != 255:
                    break
            copy(out, distance, n + 4)
    except IndexError:
        raise corrupt("lz4 block is cut short") from None
    return bytes(out)


def lzo(raw: bytes) -> bytes:
    """LZO1X. The two low bits of a match's last distance byte say how many literals follow it."""
    out, at = bytearray(), 0

    def more(bits: int) -> int:
        nonlocal at
        n = (1 << bits) - 1
        while raw[at] == 0:
            n += 255
            at += 1
        n += raw[at]
        at += 1
        return n

    try:
        state = 0
        if raw[0] > 17:
            n = raw[0] - 17
            at = 1 + n
            out += raw[1:at]
            state = 4 if n >= 4 else n
        while True:
            b = raw[at]
            at += 1
            if b >= 64:
                n, d = (b >> 5) + 1, (raw[at] << 3) + (b >> 2 & 7) + 1
                at += 1
                left = b & 3
            elif b >= 32:
                n = (b & 31) + 2 if b & 31 else more(5) + 2
                left = raw[at] & 3
                d = (raw[at] >> 2) + (raw[at + 1] << 6) + 1
                at += 2
            elif b >= 16:
                n = (b & 7) + 2 if b & 7 else more(3) + 2
                left = raw[at] & 3
                d = ((b & 8) << 11) + (raw[at] >> 2) + (raw[at + 1] << 6)
                at += 2
                if not d:
                    return bytes(out)
                d += 16384
            elif state == 0:
                n = b + 3 if b else more(4) + 3
                out += raw[at : at + n]
                at += n
                state = 4
                continue
            else:
                left = b & 3
                n, d = (2, (raw[at] << 2) + (b >> 2) + 1) if state < 4 else (3, (raw[at] << 2) + (b >> 2) + 2049)
                at += 1
            copy(out, d, n)
            out += raw[at : at + left]
            at += left
            state = left
    except IndexError:
        raise corrupt("LZO data is cut short") from None


def xpress_huffman(raw: bytes, size: int) -> bytes:
    """XPRESS with Huffman codes: blocks of 64 KiB, each with 512 code lengths of four bits."""
    out, at = bytearray(), 0
    try:
        while len(out) < size:
            lengths = [x for b in raw[at : at + 256] for x in (b & 15, b >> 4)]
            if len(lengths) < 512:
                raise corrupt("XPRESS table is cut short")
            table = codes(lengths)
            at += 256
            word = lambda: raw[at] | raw[at + 1] << 8  # noqa: E731,B023
            have = word() << 16
            at += 2
            have |= word()
            at += 2
            left = 16
            end = min(size, len(out) + 65536)

            def take(n: int) -> int:
                nonlocal have, left, at
                value = have >> (32 - n) if n else 0
                have = have << n & 0xFFFFFFFF
                left -= n
                if left < 0:
                    if at + 1 < len(raw):
                        have |= (raw[at] | raw[at + 1] << 8) << -left
                    at += 2
                    left += 16
                return value

            while len(out) < end:
                code = 0
                for n in range(1, 16):
                    code = code << 1 | take(1)
                    if (n, code) in table:
                        break
                else:
                    raise corrupt("no such XPRESS code")
                s = table[n, code]
                if s < 256:
                    out.append(s)
                    continue
                s -= 256
                n, bits = s & 15, s >> 4
                if n == 15:
                    n = raw[at]
                    at += 1
                    if n == 255:
                        n = word()
                        at += 2
                        if n < 15:
                            raise corrupt("XPRESS length")
                    else:
                        n += 15
                distance = (1 << bits) + take(bits)
                copy(out, distance, n + 3)
    except IndexError:
        raise corrupt("XPRESS data is cut short") from None
    if len(out) != size:
        raise corrupt("XPRESS data has another size")
    return bytes(out)


class _WordBits:
    """Bits from the high end of little-endian 16-bit words, as in LZX."""

    def __init__(self, raw: bytes):
        self.raw, self.at, self.have, self.n = raw, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            word = int.from_bytes(self.raw[self.at : self.at + 2], "little")
            if self.at > len(self.raw) + 4:
                raise corrupt("LZX data is cut short")
            self.at += 2
            self.have = self.have << 16 | word
            self.n += 16
        self.n -= n
        out = self.have >> self.n
        self.have &= (1 << self.n) - 1
        return out

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take(1)
            if (n, code) in table:
                return table[n, code]
        raise corrupt("no such LZX code")


class Lzx:
    """LZX of CAB and WIM. One object keeps window, repeated distances and code lengths over the
    blocks of a folder."""

    def __init__(self, window_bits: int, wim: bool = False):
        self.wim = wim
        slots = {15: 30, 16: 32, 17: 34, 18: 36, 19: 38, 20: 42, 21: 50}.get(window_bits)
        if slots is None:
            raise unsupported("LZX window")
        self.slots = slots
        self.extra = [0 if i < 4 else min((i >> 1) - 1, 17) for i in range(slots)]
        self.base = [0]
        for e in self.extra[:-1]:
            self.base.append(self.base[-1] + (1 << e))
        self.main, self.lengths = [0] * (256 + 8 * slots), [0] * 249
        self.recent = [1, 1, 1]
        self.out = bytearray()
        self.window = 1 << window_bits
        self.left = 0
        self.kind = 0
        self.translate: int | None = None
        self.begun = False
        self.done = 0

    def _read_lengths(self, bits: _WordBits, lengths: list[int], first: int, last: int) -> None:
        pre = codes([bits.take(4) for _ in range(20)])
        at = first
        while at < last:
            s = bits.symbol(pre)
            if s == 17:
                at += self._fill(lengths, at, last, bits.take(4) + 4, 0)
            elif s == 18:
                at += self._fill(lengths, at, last, bits.take(5) + 20, 0)
            elif s == 19:
                n = bits.take(1) + 4
                value = (lengths[at] - bits.symbol(pre)) % 17
                at += self._fill(lengths, at, last, n, value)
            else:
                lengths[at] = (lengths[at] - s) % 17
                at += 1

    @staticmethod
    def _fill(lengths: list[int], at: int, last: int, n: int, value: int) -> int:
        n = min(n, last - at)
        lengths[at : at + n] = [value] * n
        return n

    def _block(self, bits: _WordBits) -> None:
        self.kind = bits.take(3)
        if self.wim:
            self.left = 32768 if bits.take(1) else bits.take(16)
        else:
            self.left = bits.take(16) << 8 | bits.take(8)
        if self.kind == 2:
            self.aligned = codes([bits.take(3) for _ in range(8)])
        if self.kind in (1, 2):
            self._read_lengths(bits, self.main, 0, 256)
            self._read_lengths(bits, self.main, 256, len(self.main))
            self._read_lengths(bits, self.lengths, 0, 249)
            self.main_codes, self.length_codes = codes(self.main), codes(self.lengths)
        elif self.kind == 3:
            drop = bits.n % 16
            if drop:
                bits.take(drop)
            else:
                bits.take(16)
            bits.at -= bits.n // 8
            bits.have = bits.n = 0
            self.recent = [int.from_bytes(bits.raw[bits.at + 4 * k : bits.at + 4 * k + 4], "little") for k in range(3)]
            bits.at += 12
        else:
            raise corrupt("LZX block type")

    def frame(self, raw: bytes, size: int) -> bytes:
        """The next size bytes, from a compressed frame of its own."""
        bits, out = _WordBits(raw), self.out
        if len(out) > 4 * self.window:
            del out[: len(out) - self.window]
        if not self.begun:
            self.begun = True
            if not self.wim and bits.take(1):
                self.translate = bits.take(16) << 16 | bits.take(16)
        start, end = len(out), len(out) + size
        while len(out) < end:
            if not self.left:
                self._block(bits)
            if self.kind == 3:
                n = min(self.left, end - len(out))
                if bits.at + n > len(raw):
                    raise corrupt("LZX data is cut short")
                out += raw[bits.at : bits.at + n]
                bits.at += n
                self.left -= n
                if not self.left and bits.at & 1:
                    bits.at += 1
                continue
            s = bits.symbol(self.main_codes)
            if s < 256:
                out.append(s)
                self.left -= 1
                continue
            slot, n = (s - 256) >> 3, (s - 256) & 7
            if n == 7:
                n += bits.symbol(self.length_codes)
            n += 2
            if slot < 3:
                distance = self.recent[slot]
                self.recent[slot], self.recent[0] = self.recent[0], distance
            else:
                extra = self.extra[slot]
                if self.kind == 2 and extra >= 3:
                    low = bits.take(extra - 3) << 3
                    low += bits.symbol(self.aligned)
                else:
                    low = bits.take(extra)
                distance = self.base[slot] + low - 2
                self.recent = [distance, *self.recent[:2]]
            copy(out, distance, n)
            self.left -= n
        if len(out) != end:
            raise corrupt("LZX frame has another size")
        got = bytes(out[start:])
        size_for_calls = 12_000_000 if self.wim else self.translate
        if size_for_calls and size > 10 and (self.wim or self.done < 0x40000000):
            got = _calls(got, 0 if self.wim else self.done, size_for_calls)
        self.done += size
        return got


def _calls(raw: bytes, base: int, size: int) -> bytes:
    """x86 calls back from absolute to relative targets."""
    out, at = bytearray(raw), 0
    while (at := raw.find(b"\xe8", at, len(raw) - 10)) >= 0:
        here = base + at
        target = int.from_bytes(raw[at + 1 : at + 5], "little", signed=True)
        if -here <= target < size:
            value = target - here if target >= 0 else target + size
            out[at + 1 : at + 5] = (value & 0xFFFFFFFF).to_bytes(4, "little")
        at += 5
    return bytes(out)
