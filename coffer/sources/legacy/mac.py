"""Encodings and archives of the old Macintosh."""

from __future__ import annotations

import struct
import zlib

from ...errors import ArchiveError, corrupt, unsupported
from ...schema import Archive, Entry, Options
from .decoders import HuffmanTree, _Stream, compact_lzh, huffman, lzw_dynamic, rle90
from .dos import stem

# The characters of BinHex 4.0.
_HQX = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"
_BANNER = b"(This file must be converted with BinHex"


def is_binhex(buf: bytes) -> bool:
    return _BANNER in buf[:4096]


def open_binhex(buf: bytes, name: str, options: Options) -> Archive:
    at = buf.find(_BANNER)
    start = buf.find(b":", buf.find(b"\n", at) if buf.find(b"\n", at) >= 0 else at)
    end = buf.find(b":", start + 1)
    if at < 0 or start < 0 or end < 0:
        raise corrupt("BinHex frame")
    place = {c: i for i, c in enumerate(_HQX)}
    value = n = 0
    raw = bytearray()
    for c in buf[start + 1 : end]:
        if c in b"\r\n\t ":
            continue
        if c not in place:
            raise corrupt("BinHex character")
        value, n = value << 6 | place[c], n + 6
        if n >= 8:
            n -= 8
            raw.append(value >> n & 255)
            value &= (1 << n) - 1
    out = rle90(bytes(raw))
    k = out[0] if out else 0
    if len(out) < k + 22:
        raise corrupt("BinHex header")
    own = out[1 : 1 + k]
    data, resource = struct.unpack_from(">II", out, k + 12)
    at = k + 22
    if at + data > len(out):
        raise corrupt("BinHex data is cut short")
    return Archive("BinHex", _forks(own, out, at, data, at + data + 2, resource))


def _forks(own: bytes, buf: bytes, data_at: int, data: int, resource_at: int, resource: int) -> list[Entry]:
    entries = []
    if data or not resource:
        entries.append(Entry(own, size=data, read=lambda: buf[data_at : data_at + data]))
    if resource and resource_at + resource <= len(buf):
        entries.append(Entry(own + b".rsrc", size=resource, read=lambda: buf[resource_at : resource_at + resource]))
    return entries


def is_macbinary(buf: bytes) -> bool:
    if len(buf) < 128 or buf[0] or buf[74] or buf[82] or not 1 <= buf[1] <= 63:
        return False
    crc = 0
    for b in buf[:124]:
        crc ^= b << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x1021 if crc & 0x8000 else crc << 1) & 0xFFFF
    if crc == struct.unpack_from(">H", buf, 124)[0] and crc:
        return True
    return buf[102:106] == b"mBIN"


def open_macbinary(buf: bytes, name: str, options: Options) -> Archive:
    if not is_macbinary(buf):
        raise corrupt("MacBinary header")
    own = buf[2 : 2 + buf[1]]
    data, resource = struct.unpack_from(">II", buf, 83)
    second, = struct.unpack_from(">H", buf, 120)
    at = 128 + second + -second % 128
    if at + data > len(buf):
        raise corrupt("MacBinary data is cut short")
    return Archive("MacBinary", _forks(own, buf, at, data, at + data + -data % 128, resource))


def is_applesingle(buf: bytes) -> bool:
    return buf[:4] in (b"\0\5\x16\0", b"\0\5\x16\7")


def open_applesingle(buf: bytes, name: str, options: Options) -> Archive:
    if not is_applesingle(buf) or len(buf) < 26:
        raise corrupt("AppleSingle header")
    n, = struct.unpack_from(">H", buf, 24)
    parts = {}
    for i in range(n):
        if 38 + 12 * i > len(buf):
            raise corrupt("AppleSingle entries")
        kind, at, size = struct.unpack_from(">III", buf, 26 + 12 * i)
        if at + size > len(buf):
            raise corrupt("AppleSingle entry is out of bounds")
        parts[kind] = at, size
    own = buf[parts[3][0] : sum(parts[3])] if 3 in parts else stem(name)
    data, resource = parts.get(1, (0, 0)), parts.get(2, (0, 0))
    return Archive("AppleSingle", _forks(own, buf, *data, *resource))


def is_compactpro(buf: bytes) -> bool:
    if len(buf) < 8 or buf[0] != 1:
        return False
    at, = struct.unpack_from(">I", buf, 4)
    return 8 <= at and at + 7 <= len(buf) and zlib.crc32(buf[at + 4 :][: _compact_size(buf, at)]) ^ 0xFFFFFFFF == struct.unpack_from(">I", buf, at)[0]


def _compact_size(buf: bytes, at: int) -> int:
    """Bytes of the directory behind its checksum."""
    n, = struct.unpack_from(">H", buf, at + 4)
    p = at + 7 + buf[at + 6]
    for _ in range(n):
        if p >= len(buf):
            return 0
        k = buf[p]
        p += 1 + (k & 0x7F) + (2 if k & 0x80 else 45)
    return p - at - 4


def open_compactpro(buf: bytes, name: str, options: Options) -> Archive:
    if len(buf) < 8 or buf[0] != 1:
        raise corrupt("Compact Pro header")
    at, = struct.unpack_from(">I", buf, 4)
    try:
        n, = struct.unpack_from(">H", buf, at + 4)
        p, entries, folders = at + 7 + buf[at + 6], [], []
        for _ in range(n):
            while folders and folders[-1][1] == 0:
                folders.pop()
            if folders:
                folders[-1][1] -= 1
            k = buf[p]
            own = buf[p + 1 : p + 1 + (k & 0x7F)]
            p += 1 + (k & 0x7F)
            path = b"/".join([*(f[0] for f in folders), own])
            if k & 0x80:
                count, = struct.unpack_from(">H", buf, p)
                p += 2
                entries.append(Entry(path, kind="Dir"))
                folders.append([own, count])
                continue
            start, = struct.unpack_from(">I", buf, p + 1)
            flags, resource, data, packed_resource, packed = struct.unpack_from(">HIIII", buf, p + 27)
            p += 45

            def read(start=start + packed_resource, packed=packed, size=data, flags=flags) -> bytes:
                if flags & 1:
                    raise unsupported("Compact Pro encryption")
                data = buf[start : start + packed]
                if flags & 4:
                    # Runs shrink what the matches give, so it ends where the input does.
                    data = _until(compact_lzh, data, lambda part: len(_escaped(part)) >= size)
                out = _escaped(data)
                if len(out) < size:
                    raise corrupt("Compact Pro data is cut short")
                return out[:size]

            entries.append(Entry(path, size=data, read=read))
    except (struct.error, IndexError) as e:
        raise corrupt(f"Compact Pro directory: {e}") from None
    return Archive("CompactPro", entries)


def _until(decode, raw: bytes, enough) -> bytes:
    """The shortest output, by doubling, that is enough."""
    n = 4096
    while True:
        part = decode(raw, n)
        if enough(part):
            return part
        n *= 2


def _escaped(raw: bytes) -> bytes:
    """Runs: 0x81 0x82 n repeats, 0x81 0x82 0 is the two bytes, another byte after 0x81 is itself."""
    out, at = bytearray(), 0
    while at < len(raw):
        b = raw[at]
        if b == 0x81 and raw[at + 1 : at + 2] == b"\x82" and at + 2 < len(raw):
            n = raw[at + 2]
            out += out[-1:] * (n - 1) if n else b"\x81\x82"
            at += 3
        else:
            out.append(b)
            at += 1
    return bytes(out)


def is_packit(buf: bytes) -> bool:
    return buf[:3] == b"PMa" and buf[3:4] in b"g456" and len(buf) >= 4


def open_packit(buf: bytes, name: str, options: Options) -> Archive:
    entries, at = [], 0
    while buf[at : at + 3] == b"PMa":
        kind = buf[at + 3 : at + 4]
        h = buf[at + 4 : at + 98]
        if kind in b"56":

            def read() -> bytes:
                raise ArchiveError("ENCRYPTED") if options.password is None else unsupported("PackIt encryption")

            entries.append(Entry(stem(name) if not entries else b"%s-%d" % (stem(name), len(entries)), encrypted=True, read=read))
            break  # sizes of what follows are locked as well
        if kind == b"4":
            bits = _Stream(buf[at + 4 :])
            tree = HuffmanTree(bits)
            h = tree.take(94)
            data, resource = struct.unpack_from(">II", h, 76)
            body = tree.take(data)
            tree.take(resource + 2)
            entries.append(Entry(h[1 : 1 + min(h[0], 63)], size=data, read=lambda b=body: b))
            at += 4 + bits.at - bits.n // 8
            continue
        if len(h) < 94:
            raise corrupt("PackIt header is cut short")
        own = h[1 : 1 + min(h[0], 63)]
        data, resource = struct.unpack_from(">II", h, 76)
        start = at + 98
        if start + data > len(buf):
            raise corrupt("PackIt data is cut short")
        entries.append(Entry(own, size=data, read=lambda s=start, n=data: buf[s : s + n]))
        at = start + data + resource + 2
    if not entries:
        raise corrupt("PackIt header")
    return Archive("PackIt", entries)


def is_stuffit(buf: bytes) -> bool:
    return len(buf) >= 22 and buf[10:14] == b"rLau" and (buf[:4] in (b"SIT!", b"STin") or buf[:2] == b"ST")


def open_stuffit(buf: bytes, name: str, options: Options) -> Archive:
    entries, at, folders = [], 22, []
    while at + 112 <= len(buf):
        h = buf[at : at + 112]
        resource_how, how = h[0], h[1]
        own = h[3 : 3 + min(h[2], 63)]
        size_resource, size, packed_resource, packed = struct.unpack_from(">IIII", h, 84)
        at += 112
        if how & 0x6F == 33 or resource_how & 0x6F == 33:
            folders.pop() if folders else None
            continue
        path = b"/".join([*folders, own])
        if how & 0x6F == 32 or resource_how & 0x6F == 32:
            entries.append(Entry(path, kind="Dir"))
            folders.append(own)
            continue
        start = at + packed_resource
        at += packed_resource + packed
        if at > len(buf):
            raise corrupt("StuffIt entry is cut short")

        def read(start=start, packed=packed, size=size, how=how) -> bytes:
            data = buf[start : start + packed]
            if how & 0x80:
                raise unsupported("StuffIt encryption")
            if how == 0:
                return data
            if how == 1:
                return rle90(data)[:size]
            if how == 2:
                return lzw_dynamic(data, 14, limit=size)[:size]
            if how == 3:
                return huffman(data, size)
            raise unsupported(f"StuffIt method {how}")

        entries.append(Entry(path, size=size, encrypted=bool(how & 0x80), read=read))
    return Archive("StuffIt", entries)


def is_stuffit5(buf: bytes) -> bool:
    return buf[:9] == b"StuffIt (" and b"Aladdin" in buf[:80]


def open_stuffit5(buf: bytes, name: str, options: Options) -> Archive:
    if not is_stuffit5(buf) or len(buf) < 100:
        raise corrupt("StuffIt 5 header")
    entries, names = [], {}
    n, at = struct.unpack_from(">HI", buf, 92)
    seen = set()
    while n > 0 and at:
        if at in seen or buf[at : at + 4] != b"\xa5\xa5\xa5\xa5" or at + 48 > len(buf):
            raise corrupt("StuffIt 5 entry")
        seen.add(at)
        n -= 1
        version, header, flags = buf[at + 4], *struct.unpack_from(">H", buf, at + 6), buf[at + 9]
        _, _, _, following, above = struct.unpack_from(">IIIII", buf, at + 10)
        k, = struct.unpack_from(">H", buf, at + 30)
        size, packed = struct.unpack_from(">II", buf, at + 34)
        folder = bool(flags & 0x40)
        if folder:
            count, = struct.unpack_from(">H", buf, at + 46)
            own = buf[at + 48 : at + 48 + k]
            n += count
        else:
            how, password = buf[at + 46], buf[at + 47]
            own = buf[at + 48 + password : at + 48 + password + k]
        path = names[above] + b"/" + own if above in names else own
        if folder:
            if size != 0xFFFFFFFF:
                names[at] = path
                entries.append(Entry(path, kind="Dir"))
            at = following if size == 0xFFFFFFFF else at + header
            continue
        body = at + header
        second = 14 + (18 if version == 1 else 22)
        resource = 0
        flags2, = struct.unpack_from(">H", buf, body)
        start = body + 32 if version == 1 else body + 36
        if flags2 & 1:
            resource, = struct.unpack_from(">I", buf, start + 4)
            start += 14 + buf[start + 13]
        del second

        def read(start=start + resource, packed=packed, size=size, how=how, locked=flags & 0x20) -> bytes:
            if locked:
                raise ArchiveError("ENCRYPTED") if options.password is None else unsupported("StuffIt 5 encryption")
            if how:
                raise unsupported(f"StuffIt 5 method {how}")
            return buf[start : start + size]

        entries.append(Entry(path, size=size, encrypted=bool(flags & 0x20), read=read))
        at = start + resource + packed
    return Archive("StuffIt5", entries)


def is_stuffitx(buf: bytes) -> bool:
    return buf[:8] in (b"StuffIt!", b"StuffIt?")


def open_stuffitx(buf: bytes, name: str, options: Options) -> Archive:
    raise unsupported("StuffIt X")
