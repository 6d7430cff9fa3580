"""7z and RAR."""

from __future__ import annotations

import bz2
import hashlib
import lzma
import struct
import zlib

from ..errors import ArchiveError, corrupt, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from .ciphers import Aes
from .codecs import inflate, inflate64, raw_lzma

# Ids of methods.
_BCJ = {b"\x03\x03\x01\x03": lzma.FILTER_X86, b"\x04": lzma.FILTER_X86, b"\x03\x03\x02\x05": lzma.FILTER_POWERPC, b"\x05": lzma.FILTER_POWERPC, b"\x03\x03\x04\x01": lzma.FILTER_IA64, b"\x06": lzma.FILTER_IA64, b"\x03\x03\x05\x01": lzma.FILTER_ARM, b"\x07": lzma.FILTER_ARM, b"\x03\x03\x07\x01": lzma.FILTER_ARMTHUMB, b"\x08": lzma.FILTER_ARMTHUMB, b"\x03\x03\x08\x05": lzma.FILTER_SPARC, b"\x09": lzma.FILTER_SPARC}
_AES = b"\x06\xf1\x07\x01"


class _In:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        if n < 0 or len(out) < n:
            raise corrupt("7z header is cut short")
        self.at += n
        return out

    def byte(self) -> int:
        return self.take(1)[0]

    def number(self) -> int:
        first, mask, value = self.byte(), 0x80, 0
        for i in range(8):
            if not first & mask:
                return value + ((first & mask - 1) << 8 * i)
            value |= self.byte() << 8 * i
            mask >>= 1
        return value

    def count(self) -> int:
        n = self.number()
        if n > 8 * len(self.raw) + 64:
            raise corrupt("7z count")
        return n

    def bits(self, n: int) -> list[bool]:
        raw = self.take(-(-n // 8))
        return [bool(raw[i >> 3] & 0x80 >> (i & 7)) for i in range(n)]

    def defined(self, n: int) -> list[bool]:
        return [True] * n if self.byte() else self.bits(n)


class _Folder:
    def __init__(self, r: _In):
        self.coders, n_in, n_out = [], 0, 0
        for _ in range(r.count()):
            flags = r.byte()
            method = r.take(flags & 15)
            ins, outs = (r.count(), r.count()) if flags & 0x10 else (1, 1)
            props = r.take(r.count()) if flags & 0x20 else b""
            self.coders.append((method, ins, outs, props))
            n_in, n_out = n_in + ins, n_out + outs
        self.binds = [(r.number(), r.number()) for _ in range(n_out - 1)]
        n_packed = n_in - len(self.binds)
        self.packed = [r.number() for _ in range(n_packed)] if n_packed > 1 else [i for i in range(n_in) if i not in {b for b, _ in self.binds}]
        self.sizes: list[int] = []
        self.n_out, self.crc = n_out, None

    @property
    def size(self) -> int:
        bound = {o for _, o in self.binds}
        return next((self.sizes[i] for i in range(self.n_out) if i not in bound), 0)

    def encrypted(self) -> bool:
        return any(m == _AES for m, *_ in self.coders)

    def unpack(self, raw: bytes, password: str | None) -> bytes:
        """Coders in a line, from the packed stream on."""
        if any(i != 1 or o != 1 for _, i, o, _ in self.coders):
            raise unsupported("coder with several streams")
        of = dict((o, i) for i, o in self.binds)
        at = self.packed[0] if self.packed else 0
        pending = None
        while True:
            method, _, _, props = self.coders[at]
            raw, pending = _coder(method, props, raw, self.sizes[at], password), None
            if at not in of:
                break
            at = of[at]
        if self.crc is not None and zlib.crc32(raw) != self.crc:
            raise ArchiveError("WRONG_PASSWORD") if self.encrypted() else corrupt("7z checksum")
        return raw


def _coder(method: bytes, props: bytes, raw: bytes, size: int, password: str | None) -> bytes:
    try:
        if method == b"\0":
            return raw[:size]
        if method == b"\x03\x01\x01":
            return raw_lzma(raw, props, size)
        if method == b"\x21":
            if not props or props[0] > 40:
                raise corrupt("LZMA2 properties")
            bits = props[0]
            dictionary = 0xFFFFFFFF if bits == 40 else (2 | bits & 1) << (bits // 2 + 11)
            d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": max(min(dictionary, 1 << 30), 4096)}])
            return d.decompress(raw, size)
        if method in _BCJ:
            return _unbranch(raw, _BCJ[method])
        if method == b"\x03":
            distance, out = (props[0] if props else 0) + 1, bytearray(raw)
            for i in range(distance, len(out)):
                out[i] = (out[i] + out[i - distance]) & 255
            return bytes(out)
        if method == b"\x04\x01\x08":
            return inflate(raw, size)
        if method == b"\x04\x01\x09":
            return inflate64(raw, size)
        if method == b"\x04\x02\x02":
            return bz2.decompress(raw)
        if method == _AES:
            if password is None:
                raise ArchiveError("ENCRYPTED")
            return _aes(raw, props, password)[:size]
    except (lzma.LZMAError, OSError, ValueError, EOFError) as e:
        raise corrupt(f"7z coder: {e}") from None
    raise unsupported(f"7z method {method.hex()}")


def _unbranch(raw: bytes, which: int) -> bytes:
    """A branch filter alone: behind it, uncompressed LZMA2 chunks."""
    chunks = b"".join((b"\1" if i == 0 else b"\2") + struct.pack(">H", len(p) - 1) + p for i in range(0, len(raw), 65536) for p in [raw[i : i + 65536]]) + b"\0"
    d = lzma.LZMADecompressor(lzma.FORMAT_RAW, filters=[{"id": which}, {"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}])
    return d.decompress(chunks)


def _aes(raw: bytes, props: bytes, password: str) -> bytes:
    if len(props) < 2:
        raise corrupt("7z cipher properties")
    power = props[0] & 63
    n_salt = (props[0] >> 7 & 1) + (props[1] >> 4)
    n_iv = (props[0] >> 6 & 1) + (props[1] & 15)
    salt, iv = props[2 : 2 + n_salt], props[2 + n_salt : 2 + n_salt + n_iv].ljust(16, b"\0")
    if power > 24:
        raise unsupported("7z key derivation")
    own = salt + password.encode("utf-16-le")
    h = hashlib.sha256()
    step = 1 << min(power, 12)
    for start in range(0, 1 << power, step):
        h.update(b"".join(own + i.to_bytes(8, "little") for i in range(start, start + step)))
    return Aes(h.digest()).cbc(raw, iv)


def _streams(r: _In):
    packed_at, packed, folders, subs = 0, [], [], None
    while (tag := r.byte()) != 0:
        if tag == 6:
            packed_at, n = r.number(), r.count()
            while (t := r.byte()) != 0:
                if t == 9:
                    packed = [r.number() for _ in range(n)]
                elif t == 10:
                    for ok in r.defined(n):
                        if ok:
                            r.take(4)
        elif tag == 7:
            if r.byte() != 11:
                raise corrupt("7z folders")
            n = r.count()
            if r.byte():
                raise unsupported("7z external folders")
            folders = [_Folder(r) for _ in range(n)]
            while (t := r.byte()) != 0:
                if t == 12:
                    for f in folders:
                        f.sizes = [r.number() for _ in range(f.n_out)]
                elif t == 10:
                    for f, ok in zip(folders, r.defined(n)):
                        if ok:
                            f.crc, = struct.unpack("<I", r.take(4))
        elif tag == 8:
            counts, t = [1] * len(folders), r.byte()
            if t == 13:
                counts = [r.count() for _ in folders]
                t = r.byte()
            sizes = []
            for f, n in zip(folders, counts):
                own = [r.number() if t == 9 else 0 for _ in range(n - 1)]
                sizes.append([*own, f.size - sum(own)] if n else [])
            if t == 9:
                t = r.byte()
            crcs = [[f.crc] if n == 1 and f.crc is not None else [None] * n for f, n in zip(folders, counts)]
            while t != 0:
                if t == 10:
                    places = [(i, j) for i, c in enumerate(crcs) for j in range(len(c)) if not (len(c) == 1 and c[0] is not None)]
                    for (i, j), ok in zip(places, r.defined(len(places))):
                        if ok:
                            crcs[i][j], = struct.unpack("<I", r.take(4))
                t = r.byte()
            subs = list(zip(sizes, crcs))
    if subs is None:
        subs = [([f.size], [f.crc]) for f in folders]
    return packed_at, packed, folders, subs


def open_7z(buf: bytes, name: str, options: Options) -> Archive:
    if len(buf) < 32 or buf[:6] != b"7z\xbc\xaf\x27\x1c":
        raise corrupt("7z signature")
    crc, = struct.unpack_from("<I", buf, 8)
    if zlib.crc32(buf[12:32]) != crc:
        raise corrupt("7z start header checksum")
    offset, size, header_crc = struct.unpack_from("<QQI", buf, 12)
    if 32 + offset + size > len(buf):
        raise corrupt("7z header is out of bounds")
    header = buf[32 + offset : 32 + offset + size]
    if not size:
        return Archive("SevenZ", [])
    if zlib.crc32(header) != header_crc:
        raise corrupt("7z header checksum")
    r = _In(header)
    tag = r.byte()
    if tag == 23:
        at, packed, folders, _ = _streams(r)
        if not folders or not packed:
            raise corrupt("7z packed header")
        r = _In(folders[0].unpack(buf[32 + at : 32 + at + packed[0]], options.password))
        tag = r.byte()
    if tag != 1:
        raise corrupt("7z header")
    at, packed, folders, subs, files = 0, [], [], [], []
    while (tag := r.byte()) != 0:
        if tag == 2:
            while r.byte() != 0:
                r.take(r.count())
        elif tag == 3:
            _streams(r)
        elif tag == 4:
            at, packed, folders, subs = _streams(r)
        elif tag == 5:
            n = r.count()
            files = [{"name": "", "empty": False, "folder": False, "attr": None} for _ in range(n)]
            while (tag := r.byte()) != 0:
                length = r.number()
                end, body = r.at + length, _In(r.take(length))
                if tag == 14:
                    for f, x in zip(files, body.bits(n)):
                        f["empty"] = x
                elif tag == 15:
                    empty = [f for f in files if f["empty"]]
                    for f in empty:
                        f["folder"] = True
                    for f, x in zip(empty, body.bits(len(empty))):
                        f["folder"] = not x
                    for f in empty:
                        f["flagged"] = True
                elif tag == 17:
                    if body.byte():
                        raise unsupported("7z external names")
                    names = body.raw[1:].decode("utf-16-le", "replace").split("\0")
                    for f, x in zip(files, names):
                        f["name"] = x
                elif tag == 21:
                    known = body.defined(n)
                    body.byte()
                    for f, x in zip(files, known):
                        if x:
                            f["attr"], = struct.unpack("<I", body.take(4))
                r.at = end
            for f in files:
                if f["empty"] and "flagged" not in f:
                    f["folder"] = True
    starts, where = [], 32 + at
    for p in packed:
        starts.append(where)
        where += p
    known: dict[int, bytes] = {}
    first_pack = [0]
    for f in folders:
        first_pack.append(first_pack[-1] + len(f.packed))

    def folder(i: int) -> bytes:
        if i not in known:
            if len(folders[i].packed) != 1:
                raise unsupported("coder with several streams")
            k = first_pack[i]
            if k >= len(starts) or starts[k] + packed[k] > len(buf):
                raise corrupt("7z stream is out of bounds")
            known.clear()  # a folder at a time: its files come after each other
            known[i] = folders[i].unpack(buf[starts[k] : starts[k] + packed[k]], options.password)
        return known[i]

    def body(i: int, start: int, size: int, crc: int | None):
        def read() -> bytes:
            out = folder(i)[start : start + size]
            if len(out) < size or crc is not None and zlib.crc32(out) != crc:
                raise ArchiveError("WRONG_PASSWORD") if folders[i].encrypted() else corrupt("7z file checksum")
            return out

        return read

    places = [(i, j, sum(sizes[:j]), s, crcs[j]) for i, (sizes, crcs) in enumerate(subs) for j, s in enumerate(sizes)]
    entries, place = [], iter(places)
    for f in files:
        attr = f["attr"]
        mode = attr >> 16 & 0o7777 if attr is not None and attr & 0x8000 else None
        e = Entry(f["name"].encode("utf-8", "replace"), kind=DIR if f["folder"] or attr is not None and attr & 0x10 else FILE, mode=mode)
        if not f["empty"]:
            found = next(place, None)
            if found is None:
                raise corrupt("7z file without a stream")
            i, _, start, size, crc = found
            e.size, e.encrypted, e.read = size, folders[i].encrypted(), body(i, start, size, crc)
            if mode is not None and attr >> 16 & 0o170000 == 0o120000 and e.kind == FILE:
                try:
                    target = e.read()
                except ArchiveError:
                    target = b""
                if target:
                    e.kind, e.link_target = SYMLINK, target.decode("utf-8", "replace")
        entries.append(e)

    def verify() -> None:
        first = next((e for e in entries if e.encrypted), None)
        if first:
            if options.password is None:
                raise ArchiveError("ENCRYPTED")
            try:
                first.read()
            except ArchiveError as e:
                raise ArchiveError("WRONG_PASSWORD") if e.kind == "CORRUPT" else e

    return Archive("SevenZ", entries, verify)


# RAR: listing and stored files; its compression is not public


def open_rar(buf: bytes, name: str, options: Options) -> Archive:
    try:
        if buf[:8] == b"Rar!\x1a\x07\x01\x00":
            return _rar5(buf, options)
        if buf[:7] == b"Rar!\x1a\x07\x00":
            return _rar4(buf, options)
    except (struct.error, IndexError) as e:
        raise corrupt(f"RAR header: {e}") from None
    raise corrupt("RAR signature")


def _vint(raw: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        b = raw[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if not b & 0x80:
            return value, at
        if shift > 63:
            raise corrupt("RAR number")


def _unix_mode(attr: int) -> int | None:
    return attr & 0o7777 if attr & 0o170000 in (0o100000, 0o040000, 0o120000) else None


def _rar5(buf: bytes, options: Options) -> Archive:
    entries, at = [], 8
    while at + 7 <= len(buf):
        crc, = struct.unpack_from("<I", buf, at)
        size, start = _vint(buf, at + 4)
        head = buf[start : start + size]
        if len(head) < size or zlib.crc32(buf[at + 4 : start + size]) != crc:
            raise corrupt("RAR header checksum")
        kind, p = _vint(head, 0)
        flags, p = _vint(head, p)
        extra, p = _vint(head, p) if flags & 1 else (0, p)
        data, p = _vint(head, p) if flags & 2 else (0, p)
        body_at = start + size
        at = body_at + data
        if kind == 4:
            raise ArchiveError("ENCRYPTED", "encrypted headers") if options.password is None else unsupported("encrypted headers")
        if kind == 5:
            break
        if kind != 2:
            continue
        own, p = _vint(head, p)
        unpacked, p = _vint(head, p)
        attr, p = _vint(head, p)
        p += 4 if own & 2 else 0
        check = None
        if own & 4:
            check, = struct.unpack_from("<I", head, p)
            p += 4
        how, p = _vint(head, p)
        system, p = _vint(head, p)
        n, p = _vint(head, p)
        raw = head[p : p + n]
        locked, q = False, size - extra
        while q < size:
            k, q = _vint(head, q)
            tag, _ = _vint(head, q)
            locked = locked or tag == 1
            q += k
        if flags & 8:  # goes on from the volume before: its first part is listed there
            if entries and entries[-1].raw == raw:
                previous = entries[-1]
                old = previous.read
                previous.read = lambda o=old, s=body_at, d=data: o() + buf[s : s + d]
                continue
        e = Entry(raw, kind=DIR if own & 1 else FILE, size=0 if own & 8 else unpacked, mode=_unix_mode(attr) if system == 1 else None, encrypted=locked)
        if e.kind == FILE:
            e.read = _rar_body(buf, body_at, data, how >> 7 & 7, locked, check if not flags & 0x10 else None, options)
        entries.append(e)
    return Archive("Rar", entries, lambda: _rar_verify(entries, options))


def _rar_verify(entries, options):
    if any(e.encrypted for e in entries) and options.password is None:
        raise ArchiveError("ENCRYPTED")


def _rar_body(buf, start, size, method, locked, check, options):
    def read() -> bytes:
        if locked:
            raise ArchiveError("ENCRYPTED") if options.password is None else unsupported("RAR encryption")
        if method:
            raise unsupported("RAR compression")
        out = buf[start : start + size]
        if len(out) < size:
            raise ArchiveError("MISSING_VOLUME")
        if check is not None and zlib.crc32(out) != check:
            raise corrupt("RAR checksum")
        return out

    return read


def _rar4(buf: bytes, options: Options) -> Archive:
    entries, at = [], 7
    while at + 7 <= len(buf):
        _, kind, flags, size = struct.unpack_from("<HBHH", buf, at)
        if size < 7:
            raise corrupt("RAR header")
        if kind == 0x73 and flags & 0x80:
            raise ArchiveError("ENCRYPTED", "encrypted headers") if options.password is None else unsupported("encrypted headers")
        if kind == 0x7B:
            break
        data = struct.unpack_from("<I", buf, at + 7)[0] if flags & 0x8000 or kind == 0x74 else 0
        if kind == 0x74:
            packed, unpacked, system, crc, _, _, method, n, attr = struct.unpack_from("<IIBIIBBHI", buf, at + 7)
            p = at + 32
            if flags & 0x100:
                high = struct.unpack_from("<II", buf, p)
                packed, unpacked, p = packed | high[0] << 32, unpacked | high[1] << 32, p + 8
                data = packed
            raw = buf[p : p + n].split(b"\0")[0].replace(b"\\", b"/")
            folder = flags & 0xE0 == 0xE0 or system == 3 and attr & 0o170000 == 0o040000
            e = Entry(raw, kind=DIR if folder else FILE, size=unpacked, mode=_unix_mode(attr) if system == 3 else None, encrypted=bool(flags & 4))
            if not folder:
                e.read = _rar_body(buf, at + size, data, method - 0x30, bool(flags & 4), None if flags & 2 else crc, options)
            entries.append(e)
        at += size + data
    return Archive("Rar", entries, lambda: _rar_verify(entries, options))
