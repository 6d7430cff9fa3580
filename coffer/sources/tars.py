"""Tape and Unix archives: tar, cpio, ar, deb and rpm."""

from __future__ import annotations

import struct

from ..errors import corrupt, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from . import codecs, times


def is_tar(buf: bytes) -> bool:
    return len(buf) >= 263 and buf[257:262] == b"ustar"


def _number(field: bytes) -> int:
    if field[:1] and field[0] & 0x80:
        return int.from_bytes(bytes([field[0] & 0x7F]) + field[1:], "big") if field[0] != 0xFF else 0
    field = field.split(b"\0")[0].strip()
    if not field:
        return 0
    try:
        return int(field, 8)
    except ValueError:
        raise corrupt("tar number") from None


def _pax(body: bytes) -> dict[bytes, bytes]:
    out, at = {}, 0
    while at < len(body):
        blank = body.find(b" ", at)
        if blank < 0 or not body[at:blank].isdigit():
            break
        n = int(body[at:blank])
        if n <= 0:
            break
        key, _, value = body[blank + 1 : at + n - 1].partition(b"=")
        out[key] = value
        at += n
    return out


def open_tar(buf: bytes, name: str, options: Options) -> Archive:
    entries, at, pax, long_name, long_link = [], 0, {}, None, None
    while at + 512 <= len(buf):
        h = buf[at : at + 512]
        if not any(h):
            break
        total = _number(h[148:156])
        if total != sum(h) - sum(h[148:156]) + 8 * 32:
            raise corrupt("tar header checksum")
        size, flag, start = _number(h[124:136]), h[156:157], at + 512
        # The raw size is listed; a size of extended headers says how much there is to pass over.
        real = int(pax[b"size"]) if pax.get(b"size", b"").isdigit() else size
        body = buf[start : start + real]
        at = start + -(-real // 512) * 512
        if flag in b"xg" and flag:
            if flag == b"x":
                pax = _pax(body)
            continue
        if flag == b"L":
            long_name = body.split(b"\0")[0]
            continue
        if flag == b"K":
            long_link = body.split(b"\0")[0]
            continue
        raw = h[:100].split(b"\0")[0]
        if h[257:263] == b"ustar\0" and h[345]:
            raw = h[345:500].split(b"\0")[0] + b"/" + raw
        raw = pax.get(b"path") or long_name or raw
        link = pax.get(b"linkpath") or long_link or h[157:257].split(b"\0")[0]
        kind = DIR if flag == b"5" or (flag in (b"0", b"\0") and raw.endswith(b"/")) else SYMLINK if flag == b"2" else FILE
        e = Entry(raw, kind=kind, size=size, mode=_number(h[100:108]), modified=times.unix(_number(h[136:148])), tidy=lambda s: s.rstrip("/"))
        if kind == SYMLINK:
            e.link_target = link.decode("utf-8", "replace")
        if len(body) < real:
            e.read = _cut
        elif kind == FILE:
            e.read = lambda s=start, n=real: buf[s : s + n]
        entries.append(e)
        pax, long_name, long_link = {}, None, None
    return Archive("Tar", entries)


def _cut() -> bytes:
    raise corrupt("entry is cut short")


def open_cpio(buf: bytes, name: str, options: Options, format: str = "Cpio") -> Archive:
    entries, at = [], 0
    while True:
        h = buf[at : at + 110]
        if len(h) < 110:
            raise corrupt("cpio without a trailer")
        if h[:6] != b"070701":
            raise corrupt("cpio header")
        try:
            f = [int(h[i : i + 8], 16) for i in range(6, 110, 8)]
        except ValueError:
            raise corrupt("cpio number") from None
        mode, mtime, size, n = f[1], f[5], f[6], f[11]
        raw = buf[at + 110 : at + 110 + n].split(b"\0")[0]
        start = at + 110 + n
        start += -start % 4
        body = buf[start : start + size]
        if raw == b"TRAILER!!!":
            break
        if len(body) < size:
            raise corrupt("cpio entry is cut short")
        at = start + size
        at += -at % 4
        kind = {0o100000: FILE, 0o040000: DIR, 0o120000: SYMLINK}.get(mode & 0o170000)
        if kind is None:
            continue
        e = Entry(raw, kind=kind, size=0 if kind == DIR else size, mode=mode, modified=times.unix(mtime) if mtime else None, tidy=_without_dot)
        if kind == SYMLINK:
            e.link_target = body.decode("utf-8", "replace")
        elif kind == FILE:
            e.read = lambda s=start, k=size: buf[s : s + k]
        entries.append(e)
    return Archive(format, entries)


def _without_dot(s: str) -> str:
    return s.rstrip("/").removeprefix("./")


def ar_members(buf: bytes) -> list[tuple[bytes, int, int, int, int]]:
    """(name, mtime, mode, start, size) of members; name tables and symbol tables are left out."""
    if buf[:8] != b"!<arch>\n":
        raise corrupt("ar magic")
    out, at, table = [], 8, b""
    while at + 60 <= len(buf):
        h = buf[at : at + 60]
        if h[58:60] != b"`\n":
            raise corrupt("ar header")
        try:
            number = lambda a, z, base: int(h[a:z].strip() or b"0", base)  # noqa: E731,B023
            mtime, mode, size = number(16, 28, 10), number(40, 48, 8), number(48, 58, 10)
        except ValueError:
            raise corrupt("ar number") from None
        start = at + 60
        if start + size > len(buf):
            raise corrupt("ar member is cut short")
        at = start + size + (size & 1)
        raw = h[:16].rstrip(b" ")
        if raw == b"//":
            table = buf[start : start + size]
            continue
        if raw in (b"/", b"/SYM64/", b"__.SYMDEF", b"__.SYMDEF SORTED"):
            continue
        if raw.startswith(b"#1/") and raw[3:].isdigit():
            n = int(raw[3:])
            raw = buf[start : start + n].rstrip(b"\0")
            start, size = start + n, size - n
        elif raw.startswith(b"/") and raw[1:].isdigit():
            raw = table[int(raw[1:]) :].split(b"\n")[0].rstrip(b"/")
        else:
            raw = raw.removesuffix(b"/")
        out.append((raw, mtime, mode, start, size))
    return out


def open_ar(buf: bytes, name: str, options: Options) -> Archive:
    return Archive("Ar", [Entry(raw, size=n, mode=mode & 0o7777, modified=times.unix(t), read=lambda s=s, n=n: buf[s : s + n]) for raw, t, mode, s, n in ar_members(buf)])


def is_deb(buf: bytes) -> bool:
    return buf[:8] == b"!<arch>\n" and buf[8:24].rstrip(b" ").rstrip(b"/") == b"debian-binary"


def open_deb(buf: bytes, name: str, options: Options) -> Archive:
    found = next((m for m in ar_members(buf) if m[0].startswith(b"data.tar")), None)
    if found is None:
        raise corrupt("package without data")
    raw, _, _, start, size = found
    body, ext = buf[start : start + size], raw[len(b"data.tar") :]
    kind = codecs.detect_compressor(body)
    if ext == b".lzma":
        kind = codecs.LZMA
    elif kind is None and ext:
        raise unsupported(f"package data {raw.decode('utf-8', 'replace')}")
    return Archive("Deb", open_tar(codecs.decompress(body, kind) if kind else body, name, options).entries)


# What the payload compressor tag names.
_RPM_KINDS = {b"gzip": codecs.GZIP, b"bzip2": codecs.BZIP2, b"xz": codecs.XZ, b"lzma": codecs.LZMA, b"zstd": codecs.ZSTD}


def open_rpm(buf: bytes, name: str, options: Options) -> Archive:
    def header(at: int) -> tuple[dict[int, bytes], int]:
        if buf[at : at + 3] != b"\x8e\xad\xe8":
            raise corrupt("rpm header")
        n, size = struct.unpack_from(">II", buf, at + 8)
        store = at + 16 + 16 * n
        if store + size > len(buf):
            raise corrupt("rpm header is out of bounds")
        tags = {}
        for i in range(n):
            tag, _, offset, _ = struct.unpack_from(">IIII", buf, at + 16 + 16 * i)
            tags[tag] = buf[store + offset : store + size].split(b"\0")[0]
        return tags, store + size

    _, end = header(96)
    tags, end = header(end + -end % 8)
    if tags.get(1124, b"cpio") != b"cpio":
        raise unsupported("rpm payload")
    how = tags.get(1125, b"gzip")
    payload = buf[end:]
    if how not in _RPM_KINDS and how not in (b"", b"none", b"identity"):
        raise unsupported(f"rpm compressor {how.decode('utf-8', 'replace')}")
    if how in _RPM_KINDS:
        payload = codecs.decompress(payload, _RPM_KINDS[how])
    return open_cpio(payload, name, options, "Rpm")
