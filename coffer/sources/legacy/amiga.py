"""Archives of the Amiga."""

from __future__ import annotations

import struct

from ...errors import ArchiveError, corrupt, unsupported
from ...schema import Archive, Entry, Options
from .decoders import powerpacker, rle90
from .dos import stem


def open_powerpacker(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:4] == b"PX20":
        raise ArchiveError("ENCRYPTED")
    if buf[:4] != b"PP20" or len(buf) < 16:
        raise corrupt("PowerPacker header")
    return Archive("PowerPacker", [Entry(stem(name), size=int.from_bytes(buf[-4:-1], "big"), read=lambda: powerpacker(buf))])


def open_lzx(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:3] != b"LZX" or len(buf) < 10:
        raise corrupt("LZX header")
    entries, at, group = [], 10, []
    while at + 31 <= len(buf):
        h = buf[at : at + 31]
        size, packed = struct.unpack_from("<II", h, 2)
        method, k_comment, k_name = h[11], h[14], h[30]
        raw = buf[at + 31 : at + 31 + k_name]
        at += 31 + k_name + k_comment
        group.append((raw, size))
        if not packed:
            continue
        start, offset = at, 0
        at += packed
        if at > len(buf):
            raise corrupt("LZX entry is cut short")
        for own, n in group:  # merged files share one packed stretch

            def read(start=start + offset, n=n, method=method) -> bytes:
                if method:
                    raise unsupported("LZX compression")
                return buf[start : start + n]

            entries.append(Entry(own, size=n, read=read))
            offset += n
        group = []
    entries += [Entry(own, size=n) for own, n in group]
    return Archive("Lzx", entries)


def open_dms(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:4] != b"DMS!" or len(buf) < 56:
        raise corrupt("DMS header")
    flags, = struct.unpack_from(">I", buf, 8)
    locked = bool(flags & 2)

    def read() -> bytes:
        if locked:
            raise ArchiveError("ENCRYPTED") if options.password is None else unsupported("DMS encryption")
        out, at = {}, 56
        while buf[at : at + 2] == b"TR" and at + 20 <= len(buf):
            number, _, packed, _, size, _, how = struct.unpack_from(">HHHHHBB", buf, at + 2)
            data = buf[at + 20 : at + 20 + packed]
            at += 20 + packed
            if number >= 80:
                continue  # banner and notes
            if how == 0:
                out[number] = data[:size]
            elif how == 1:
                out[number] = rle90(data)[:size]
            else:
                raise unsupported(f"DMS mode {how}")
        return b"".join(out[k] for k in sorted(out))

    return Archive("Dms", [Entry(stem(name) + b".adf", encrypted=locked, read=read)])
