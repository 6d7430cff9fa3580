"""ZIP and what is built on it: office and mobile bundles, browser extensions, conda packages."""

from __future__ import annotations

import bz2
import lzma
import struct
import zlib

from ..errors import ArchiveError, corrupt, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from . import times
from .ciphers import ZipCrypto, winzip_aes
from .codecs import inflate, inflate64, raw_lzma, unzstd

# Extensions that make a ZIP file a bundle of its own format.
BUNDLES = {"jar": "Jar", "apk": "Apk", "ipa": "Ipa", "epub": "Epub", "docx": "Docx", "xlsx": "Xlsx", "pptx": "Pptx", "odt": "Odt", "ods": "Ods", "odp": "Odp"}


def _directory(buf: bytes) -> tuple[int, int, int, int]:
    """(offset, size, entries of the central directory, bytes in front of the archive)."""
    at = buf.rfind(b"PK\5\6", max(0, len(buf) - 65557))
    if at < 0 or at + 22 > len(buf):
        raise corrupt("no end of central directory")
    entries, size, offset = struct.unpack_from("<HII", buf, at + 10)
    end = at
    locator = at - 20
    if locator >= 0 and buf[locator : locator + 4] == b"PK\6\7":
        (where,) = struct.unpack_from("<Q", buf, locator + 8)
        found = where if buf[where : where + 4] == b"PK\6\6" else buf.rfind(b"PK\6\6", 0, locator)
        if found >= 0 and found + 56 <= len(buf):
            entries, size, offset = struct.unpack_from("<QQQ", buf, found + 32)
            end = found
    front = end - size - offset
    if front < 0 or buf[offset + front : offset + front + 4] not in (b"PK\1\2", b"PK\5\6", b"PK\6\6"):
        front = 0
    if offset + front > len(buf):
        raise corrupt("central directory is out of bounds")
    return offset + front, size, entries, front


def open_zip(buf: bytes, name: str, options: Options, format: str = "Zip") -> Archive:
    at, _, count, front = _directory(buf)
    entries, first_encrypted = [], []
    for _ in range(count):
        if buf[at : at + 4] != b"PK\1\2" or at + 46 > len(buf):
            raise corrupt("central directory entry")
        made, _, flags, method, time, day, crc, packed, size, n, m, k, _, _, outer, offset = struct.unpack_from("<HHHHHHIIIHHHHHII", buf, at + 4)
        raw, extra = buf[at + 46 : at + 46 + n], buf[at + 46 + n : at + 46 + n + m]
        at += 46 + n + m + k
        aes = None
        while len(extra) >= 4:
            tag, length = struct.unpack_from("<HH", extra)
            body, extra = extra[4 : 4 + length], extra[4 + length :]
            if tag == 1:
                wide = [struct.unpack_from("<Q", body, i)[0] for i in range(0, len(body) - 7, 8)]
                if size == 0xFFFFFFFF and wide:
                    size = wide.pop(0)
                if packed == 0xFFFFFFFF and wide:
                    packed = wide.pop(0)
                if offset == 0xFFFFFFFF and wide:
                    offset = wide.pop(0)
            elif tag == 0x9901 and length >= 7:
                aes = (body[4], *struct.unpack_from("<H", body, 5), struct.unpack_from("<H", body)[0])
        if size >= 1 << 63:
            raise corrupt("size is too large")
        unix = outer >> 16 if made >> 8 in (3, 19) or outer >> 16 else 0
        kind = FILE
        if raw.endswith(b"/") or unix & 0o170000 == 0o040000:
            kind = DIR
        elif unix & 0o170000 == 0o120000:
            kind = SYMLINK
        e = Entry(raw, kind=kind, size=size, mode=unix & 0o7777 if unix else None, encrypted=bool(flags & 1), modified=times.dos(day, time))
        check = time >> 8 if flags & 8 else crc >> 24
        e.read = _reader(buf, offset + front, packed, size, method, flags, crc, aes, check, options)
        if e.encrypted:
            first_encrypted.append(e)
        if flags & 0x800:
            e.tidy = None
        entries.append(e)
    for e in entries:
        if e.kind == SYMLINK:
            try:
                e.link_target = e.read().decode("utf-8", "replace")
            except ArchiveError:
                e.link_target = ""

    def verify() -> None:
        if first_encrypted:
            if options.password is None:
                raise ArchiveError("ENCRYPTED")
            try:
                first_encrypted[0].read()
            except ArchiveError as e:
                if e.kind == "WRONG_PASSWORD":
                    raise

    return Archive(format, entries, verify)


def _reader(buf, offset, packed, size, method, flags, crc, aes, check, options):
    def read() -> bytes:
        if buf[offset : offset + 4] != b"PK\3\4" or offset + 30 > len(buf):
            raise corrupt("local header")
        n, m = struct.unpack_from("<HH", buf, offset + 26)
        start = offset + 30 + n + m
        raw = buf[start : start + packed]
        if len(raw) < packed:
            raise corrupt("entry is cut short")
        how, checked = method, True
        if flags & 1:
            if options.password is None:
                raise ArchiveError("ENCRYPTED")
            password = options.password.encode()
            if aes:
                strength, how, version = aes
                raw, checked = winzip_aes(raw, strength, password), version == 1
            else:
                if how == 14:
                    raise unsupported("encrypted LZMA")
                plain = ZipCrypto(password).decrypt(raw)
                if len(plain) < 12 or plain[11] != check:
                    raise ArchiveError("WRONG_PASSWORD")
                raw = plain[12:]
            if how == 14:
                raise unsupported("encrypted LZMA")
        out = unpack(raw, how, size)
        if len(out) != size:
            raise corrupt("entry has another size")
        if checked and zlib.crc32(out) != crc:
            raise corrupt("entry has another checksum")
        return out

    return read


def unpack(raw: bytes, method: int, size: int) -> bytes:
    try:
        if method == 0:
            return raw
        if method == 8:
            return inflate(raw, size)
        if method == 9:
            return inflate64(raw, size)
        if method == 12:
            return bz2.decompress(raw)
        if method == 14:
            if len(raw) < 9 or int.from_bytes(raw[2:4], "little") != 5:
                raise corrupt("LZMA properties have a wrong length")
            return raw_lzma(raw[9:], raw[4:9], size)
        if method in (20, 93):
            return unzstd(raw)
        if method == 95:
            return lzma.decompress(raw, lzma.FORMAT_XZ)
    except (OSError, ValueError, EOFError, lzma.LZMAError) as e:
        raise corrupt(f"method {method}: {e}") from None
    raise unsupported(f"compression method {method}")


def open_bundle(buf: bytes, name: str, options: Options) -> Archive:
    return open_zip(buf, name, options, BUNDLES[name.rsplit(".", 1)[-1].lower()])


def crx_offset(buf: bytes) -> int:
    if len(buf) < 16:
        raise corrupt("extension header is cut short")
    version, a, b = struct.unpack_from("<III", buf, 4)
    if version == 3:
        return 12 + a
    if version == 2:
        return 16 + a + b
    raise unsupported(f"extension version {version}")


def open_crx(buf: bytes, name: str, options: Options) -> Archive:
    at = crx_offset(buf)
    if at >= len(buf):
        raise corrupt("extension header is out of bounds")
    return open_zip(buf[at:], name, options, "Crx")


def open_conda(buf: bytes, name: str, options: Options) -> Archive:
    """The entries of all inner archives after each other."""
    from .tars import open_tar

    outer = open_zip(buf, name, options)
    inner = [e for e in outer.entries if e.raw.lower().endswith(b".tar.zst")]
    if not inner:
        raise corrupt("package without an inner archive")
    entries = []
    for e in inner:
        entries += open_tar(unzstd(e.read()), name, options).entries
    return Archive("Conda", entries)
