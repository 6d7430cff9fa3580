"""Archives of CP/M and DOS."""

from __future__ import annotations

import struct
import zlib

from ...errors import corrupt, unsupported
from ...schema import Archive, Entry, Options
from .decoders import lzh, lzw_dynamic, rle90, unsqueeze


def stem(name: str) -> bytes:
    own = name.rsplit("/", 1)[-1]
    return (own.rsplit(".", 1)[0] or own).encode()


def is_arj(buf: bytes) -> bool:
    return buf[:2] == b"\x60\xea" and len(buf) > 10 and 0 < int.from_bytes(buf[2:4], "little") <= 2600 and buf[10] <= 2 + 8


def open_arj(buf: bytes, name: str, options: Options) -> Archive:
    entries, at, first = [], 0, True
    while True:
        if buf[at : at + 2] != b"\x60\xea" or at + 4 > len(buf):
            raise corrupt("ARJ header")
        n, = struct.unpack_from("<H", buf, at + 2)
        if not n:
            break
        h = buf[at + 4 : at + 4 + n]
        if len(h) < n or n < 30 or zlib.crc32(h) != struct.unpack_from("<I", buf, at + 4 + n)[0]:
            raise corrupt("ARJ header checksum")
        at += 8 + n
        while (extra := struct.unpack_from("<H", buf, at)[0]) != 0:
            at += 2 + extra + 4
        at += 2
        if first:
            first = False
            continue
        flags, method, kind = h[4], h[5], h[6]
        packed, size, crc = struct.unpack_from("<III", h, 12)
        raw = h[h[0] :].split(b"\0")[0]
        start = at
        at += packed
        e = Entry(raw, kind="Dir" if kind == 3 else "File", size=size, encrypted=bool(flags & 1))

        def read(start=start, packed=packed, size=size, method=method, crc=crc, locked=flags & 1) -> bytes:
            data = buf[start : start + packed]
            if locked:
                raise unsupported("ARJ encryption")
            if method == 0:
                out = data
            elif method in (1, 2, 3):
                out = lzh(data, size, 26624, 17, 5)
            else:
                raise unsupported(f"ARJ method {method}")
            if zlib.crc32(out) != crc:
                raise corrupt("ARJ checksum")
            return out

        if e.kind == "File":
            e.read = read
        entries.append(e)
    return Archive("Arj", entries)


def is_zoo(buf: bytes) -> bool:
    return buf[20:24] == b"\xdc\xa7\xc4\xfd"


def open_zoo(buf: bytes, name: str, options: Options) -> Archive:
    at, = struct.unpack_from("<I", buf, 24)
    entries, seen = [], set()
    while at and at + 51 <= len(buf):
        if buf[at : at + 4] != b"\xdc\xa7\xc4\xfd" or at in seen:
            raise corrupt("Zoo entry")
        seen.add(at)
        kind, method = buf[at + 4], buf[at + 5]
        following, start, _, _, _, size, packed = struct.unpack_from("<IIHHHII", buf, at + 6)
        if not following:
            break
        raw = buf[at + 38 : at + 51].split(b"\0")[0]
        deleted = buf[at + 30]
        if kind == 2 and at + 58 <= len(buf):
            n_long, n_dir = buf[at + 56], buf[at + 57]
            long = buf[at + 58 : at + 58 + n_long].split(b"\0")[0]
            where = buf[at + 58 + n_long : at + 58 + n_long + n_dir].split(b"\0")[0]
            raw = long or raw
            raw = where + b"/" + raw if where else raw

        def read(start=start, packed=packed, size=size, method=method) -> bytes:
            data = buf[start : start + packed]
            if method == 0:
                return data
            if method == 1:
                return lzw_dynamic(data, 13, start=258, limit=size, end=257, group=False)[:size]
            if method == 2:
                return lzh(data, size, 8192, 14, 4)
            raise unsupported(f"Zoo method {method}")

        if not deleted:
            entries.append(Entry(raw, size=size, read=read))
        at = following
    return Archive("Zoo", entries)


def is_lbr(buf: bytes) -> bool:
    return len(buf) >= 128 and buf[0] == 0 and buf[1:12] == b" " * 11 and buf[12:14] == b"\0\0" and buf[14:16] != b"\0\0"


def open_lbr(buf: bytes, name: str, options: Options) -> Archive:
    n, = struct.unpack_from("<H", buf, 14)
    entries = []
    for at in range(32, min(n * 128, len(buf)), 32):
        e = buf[at : at + 32]
        if len(e) < 32 or e[0] != 0:
            continue
        sector, count = struct.unpack_from("<HH", e, 12)
        pad = e[26]
        base, ext = e[1:9].rstrip(), e[9:12].rstrip()
        size = max(count * 128 - pad, 0)
        if sector * 128 + size > len(buf):
            raise corrupt("LBR member is out of bounds")
        entries.append(Entry(base + (b"." + ext if ext else b""), size=size, read=lambda s=sector * 128, k=size: buf[s : s + k]))
    return Archive("Lbr", entries)


def _own_name(raw: bytes) -> bytes:
    return bytes(b & 0x7F for b in raw.split(b"\0")[0]).split(b"[")[0].strip()


def open_crunch(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:2] != b"\x76\xfe":
        raise corrupt("Crunch header")

    def read() -> bytes:
        raise unsupported("Crunch compression")

    return Archive("Crunch", [Entry(_own_name(buf[2:66]) or stem(name), read=read)])


def open_squeeze(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:2] != b"\x76\xff" or len(buf) < 6:
        raise corrupt("Squeeze header")
    end = buf.find(b"\0", 4)
    if end < 0:
        raise corrupt("Squeeze header")

    def read() -> bytes:
        out = rle90(unsqueeze(buf[end + 1 :]))
        if sum(out) & 0xFFFF != struct.unpack_from("<H", buf, 2)[0]:
            raise corrupt("Squeeze checksum")
        return out

    return Archive("Squeeze", [Entry(_own_name(buf[4:]) or stem(name), read=read)])


def _crc16(raw: bytes) -> int:
    crc = 0
    for b in raw:
        crc ^= b
        for _ in range(8):
            crc = crc >> 1 ^ (0xA001 if crc & 1 else 0)
    return crc


def open_arc(buf: bytes, name: str, options: Options) -> Archive:
    entries, at = [], 0
    while at + 2 <= len(buf):
        if buf[at] != 0x1A:
            raise corrupt("ARC header")
        method = buf[at + 1]
        if method in (0, 0x80):
            break
        if at + 29 > len(buf):
            raise corrupt("ARC header is cut short")
        raw = buf[at + 2 : at + 15].split(b"\0")[0]
        packed, _, _, crc = struct.unpack_from("<IHHH", buf, at + 15)
        size = packed if method & 0x7F == 1 else struct.unpack_from("<I", buf, at + 25)[0]
        start = at + (25 if method & 0x7F == 1 else 29) + (12 if method & 0x80 else 0)
        if start + packed > len(buf):
            raise corrupt("ARC entry is cut short")
        at = start + packed

        def read(start=start, packed=packed, size=size, method=method & 0x7F, crc=crc) -> bytes:
            data = buf[start : start + packed]
            if method in (1, 2):
                out = data
            elif method == 3:
                out = rle90(data)
            elif method == 4:
                out = rle90(unsqueeze(data))
            elif method == 8:
                out = rle90(lzw_dynamic(data[1:], 12))
            elif method == 9:
                out = lzw_dynamic(data, 13)
            else:
                raise unsupported(f"ARC method {method}")
            if _crc16(out[:size]) != crc:
                raise corrupt("ARC checksum")
            return out[:size]

        entries.append(Entry(raw, size=size, read=read))
    else:
        if not entries:
            raise corrupt("ARC without entries")
    return Archive("Arc", entries)


def is_alz(buf: bytes) -> bool:
    return buf[:4] == b"ALZ\1"


def open_alz(buf: bytes, name: str, options: Options) -> Archive:
    import bz2

    from ...errors import ArchiveError
    from ..ciphers import ZipCrypto
    from ..codecs import inflate

    entries, at = [], 8
    while buf[at : at + 4] == b"BLZ\1":
        n, attributes, _, descriptor, _ = struct.unpack_from("<HBIBB", buf, at + 4)
        width, at = descriptor >> 4, at + 13
        method = check = size = packed = 0
        if width:
            method, at = buf[at], at + 2
            check, at = struct.unpack_from("<I", buf, at)[0], at + 4
            packed, size = int.from_bytes(buf[at : at + width], "little"), int.from_bytes(buf[at + width : at + 2 * width], "little")
            at += 2 * width
        raw = buf[at : at + n]
        at += n
        locked, head = descriptor & 1, b""
        if locked:
            head, at = buf[at : at + 12], at + 12
        start = at
        at += packed
        if at > len(buf):
            raise corrupt("ALZ entry is cut short")

        def read(start=start, packed=packed, size=size, method=method, check=check, locked=locked, head=head) -> bytes:
            data = buf[start : start + packed]
            if locked:
                if options.password is None:
                    raise ArchiveError("ENCRYPTED")
                plain = ZipCrypto(options.password.encode()).decrypt(head + data)
                if plain[11] != check >> 24:
                    raise ArchiveError("WRONG_PASSWORD")
                data = plain[12:]
            if method == 0:
                out = data
            elif method == 1:
                out = bz2.decompress(data)
            elif method == 2:
                out = inflate(data, size)
            else:
                raise unsupported(f"ALZ method {method}")
            if zlib.crc32(out) != check:
                raise corrupt("ALZ checksum")
            return out

        folder = bool(attributes & 0x10)
        entries.append(Entry(raw, kind="Dir" if folder else "File", size=size, encrypted=bool(locked), read=None if folder else read))
    return Archive("Alz", entries)


def is_nsis(buf: bytes) -> bool:
    return buf.find(b"\xef\xbe\xad\xdeNullsoftInst") >= 0


def open_nsis(buf: bytes, name: str, options: Options) -> Archive:
    raise unsupported("installer script")
