"""Cabinets, installers, XAR, WARC and archives behind a program."""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import xml.etree.ElementTree as ET
import zlib

from ..errors import ArchiveError, corrupt, unknown, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from . import times
from .codecs import Lzx


def open_cab(buf: bytes, name: str, options: Options, format: str = "Cab") -> Archive:
    if buf[:4] != b"MSCF" or len(buf) < 36:
        raise corrupt("cabinet header")
    files_at, = struct.unpack_from("<I", buf, 16)
    n_folders, n_files, flags = struct.unpack_from("<HHH", buf, 26)
    at, folder_extra, data_extra = 36, 0, 0
    if flags & 4:
        n, folder_extra, data_extra = struct.unpack_from("<HBB", buf, at)
        at += 4 + n
    for bit in (1, 2):
        if flags & bit:
            for _ in range(2):
                at = buf.find(b"\0", at) + 1
                if not at:
                    raise corrupt("cabinet name")
    folders = []
    for _ in range(n_folders):
        if at + 8 > len(buf):
            raise corrupt("cabinet folder")
        folders.append(_Folder(buf, *struct.unpack_from("<IHH", buf, at), data_extra))
        at += 8 + folder_extra
    entries, at = [], files_at
    for _ in range(n_files):
        if at + 16 > len(buf):
            raise corrupt("cabinet file")
        size, offset, folder, day, time, attributes = struct.unpack_from("<IIHHHH", buf, at)
        end = buf.find(b"\0", at + 16)
        if end < 0:
            raise corrupt("cabinet name")
        raw = buf[at + 16 : end]
        at = end + 1
        text = raw.decode("utf-8", "replace").replace("\\", "/")
        entries.append((folder, Entry(text.encode(), path=text, size=size, modified=times.dos(day, time), read=_cab_body(folders, folder, offset, size))))
    # Files are listed folder by folder.
    entries.sort(key=lambda x: min(x[0], n_folders))
    return Archive(format, [e for _, e in entries])


def _cab_body(folders, folder, offset, size):
    def read() -> bytes:
        if folder >= len(folders):
            raise unsupported("file that goes on in another cabinet")
        out = folders[folder].data()[offset : offset + size]
        if len(out) < size:
            raise corrupt("cabinet file is cut short")
        return out

    return read


class _Folder:
    def __init__(self, buf, start, blocks, kind, extra):
        self.buf, self.start, self.blocks, self.kind, self.extra = buf, start, blocks, kind, extra
        self.known: bytes | None = None

    def data(self) -> bytes:
        """All of the folder, worked out once for all its files."""
        if self.known is None:
            how, out, at = self.kind & 15, [], self.start
            if how not in (0, 1, 3):
                raise unsupported("Quantum compression")
            lzx = Lzx(self.kind >> 8 & 31) if how == 3 else None
            before = b""
            for _ in range(self.blocks):
                if at + 8 > len(self.buf):
                    raise corrupt("cabinet block")
                _, packed, size = struct.unpack_from("<IHH", self.buf, at)
                raw = self.buf[at + 8 + self.extra : at + 8 + self.extra + packed]
                at += 8 + self.extra + packed
                if len(raw) < packed:
                    raise corrupt("cabinet block is cut short")
                if how == 1:
                    if raw[:2] != b"CK":
                        raise corrupt("MSZIP block")
                    d = zlib.decompressobj(-15, zdict=before) if before else zlib.decompressobj(-15)
                    try:
                        raw = d.decompress(raw[2:])
                    except zlib.error as e:
                        raise corrupt(str(e)) from None
                    before = raw[-32768:]
                elif how == 3:
                    raw = lzx.frame(raw, size)
                if len(raw) != size:
                    raise corrupt("cabinet block has another size")
                out.append(raw)
            self.known = b"".join(out)
        return self.known


# XAR

MAX_TOC, MAX_TOC_PLAIN, MAX_DEPTH = 128 << 20, 256 << 20, 64


def exceeds_depth(xml: bytes, limit: int) -> bool:
    """Whether elements nest deeper than limit; what is broken doesn't."""
    depth = 0
    token = re.compile(rb"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>]*>|<(/?)[^\s/>!?][^\s/>]*((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
    for m in token.finditer(xml):
        if m[2] is None:
            continue
        if m[1]:
            depth -= 1
        elif not m[2].endswith(b"/"):
            depth += 1
            if depth > limit:
                return True
    return False


def codec_of_style(style: str | None) -> str | None:
    """What an encoding style means: its codec, or None for one nobody knows."""
    style = (style or "").lower()
    return next((kind for part, kind in (("gzip", "zlib"), ("zlib", "zlib"), ("bzip2", "bzip2"), ("xz", "xz"), ("lzma", "xz"), ("octet-stream", "stored")) if part in style), None if style else "stored")


def open_xar(buf: bytes, name: str, options: Options) -> Archive:
    if len(buf) < 28 or buf[:4] != b"xar!":
        raise corrupt("xar header")
    header, = struct.unpack_from(">H", buf, 4)
    packed, plain = struct.unpack_from(">QQ", buf, 8)
    if header < 28 or packed > MAX_TOC or plain > MAX_TOC_PLAIN or header + packed > len(buf):
        raise corrupt("xar table of contents")
    d = zlib.decompressobj()
    try:
        xml = d.decompress(buf[header : header + packed], MAX_TOC_PLAIN)
    except zlib.error as e:
        raise corrupt(str(e)) from None
    if exceeds_depth(xml, MAX_DEPTH):
        raise corrupt("xar table of contents is too deep")
    try:
        root = ET.fromstring(xml)
    except ET.ParseError as e:
        raise corrupt(str(e)) from None
    heap, entries, by_id = header + packed, [], {}

    def walk(node, above: str) -> None:
        for f in node.findall("file"):
            own = (f.findtext("name") or "").strip("\n")
            # A name with .. in it or an absolute one isn't listed, nor is what lies below it.
            parts = own.replace("\\", "/").split("/")
            if not own or own.startswith(("/", "\\")) or ".." in parts or re.match(r"[A-Za-z]:", own):
                continue
            path = f"{above}/{own}" if above else own
            kind = (f.findtext("type") or "file").strip()
            try:
                size = int(f.findtext("data/size") or f.findtext("size") or 0)
                mode = int(f.findtext("mode"), 8) if f.findtext("mode") else None
            except ValueError:
                raise corrupt("xar number") from None
            e = Entry(path.encode(), path=path, mode=mode, modified=times.iso8601(f.findtext("mtime") or "", 19))
            if kind == "directory":
                e.kind = DIR
            elif kind == "symlink":
                e.kind, e.link_target = SYMLINK, (f.findtext("link") or "")
            else:
                e.size, data = size, f.find("data")
                if data is not None:
                    try:
                        offset, length = int(data.findtext("offset") or 0), int(data.findtext("length") or 0)
                    except ValueError:
                        raise corrupt("xar number") from None
                    style = data.find("encoding")
                    e.read = _xar_body(buf, heap + offset, length, size, codec_of_style(style.get("style") if style is not None else None))
                    by_id[f.get("id")] = e
                else:
                    e.size = 0
            entries.append(e)
            walk(f, path)

    toc = root.find("toc")
    walk(toc if toc is not None else root, "")
    return Archive("Xar", entries)


def _xar_body(buf, start, length, size, kind):
    def read() -> bytes:
        raw = buf[start : start + length]
        if start < 0 or length < 0 or len(raw) < length:
            raise corrupt("xar heap is out of bounds")
        try:
            if kind == "zlib":
                return zlib.decompress(raw, 47 if raw[:2] == b"\x1f\x8b" else 15)
            if kind == "bzip2":
                return bz2.decompress(raw)
            if kind == "xz":
                return lzma.decompress(raw)
        except (zlib.error, OSError, ValueError, lzma.LZMAError) as e:
            raise corrupt(str(e)) from None
        if kind is None:
            raise unsupported("xar encoding")
        return raw

    return read


# WARC


def uri_to_path(uri: str) -> str:
    rest = uri.split("://", 1)[-1].split("?")[0].split("#")[0]
    parts = ["_" if p == ".." else p for p in rest.split("/") if p not in ("", ".")]
    return "/".join(parts) or "index"


def strip_http(block: bytes) -> bytes:
    head, found, body = block.partition(b"\r\n\r\n")
    return body if found else block


def warc_date(text: str) -> int | None:
    return times.iso8601(text, 20)


def warc_records(buf: bytes):
    """(headers in lower case, start, length) of records, compressed archives unpacked before."""
    at = 0
    while at < len(buf):
        if buf[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = buf.find(b"\r\n\r\n", at)
        if buf[at : at + 7] != b"WARC/1." or end < 0:
            raise corrupt("WARC record")
        headers = {}
        for line in buf[at:end].split(b"\r\n")[1:]:
            key, _, value = line.partition(b":")
            headers[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
        try:
            n = int(headers["content-length"])
        except (KeyError, ValueError):
            raise corrupt("WARC record without a length") from None
        if n < 0 or end + 4 + n > len(buf):
            raise corrupt("WARC record is cut short")
        yield headers, end + 4, n
        at = end + 4 + n


def open_warc(buf: bytes, name: str, options: Options) -> Archive:
    from .codecs import gunzip

    if buf[:2] == b"\x1f\x8b":
        try:
            buf = gunzip(buf)
        except zlib.error as e:
            raise corrupt(str(e)) from None
    entries, seen = [], {}
    for h, start, n in warc_records(buf):
        kind = h.get("warc-type", "")
        if kind not in ("response", "resource"):
            continue
        block = buf[start : start + n]
        if kind == "response" and h.get("content-type", "").lower().startswith("application/http") or block.startswith(b"HTTP/"):
            block = strip_http(block)
        uri = h.get("warc-target-uri", "").strip("<>")
        base = uri_to_path(uri) if uri else f"record-{len(entries)}"
        again = seen.get(base, 0)
        seen[base] = again + 1
        path = f"{base}-{again}" if again else base
        entries.append(Entry(path.encode(), path=path, size=len(block), modified=warc_date(h.get("warc-date", "")), read=lambda b=block: b))
    return Archive("Warc", entries)


# Programs with an archive behind them

# What an archive behind a program starts with.
SFX_MAGICS = (b"PK\x03\x04", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"MSCF")


def pe_end(buf: bytes) -> int:
    """Where the sections of a program end; 0 if it can't be read."""
    try:
        pe, = struct.unpack_from("<I", buf, 0x3C)
        if buf[pe : pe + 4] != b"PE\0\0":
            return 0
        n, = struct.unpack_from("<H", buf, pe + 6)
        optional, = struct.unpack_from("<H", buf, pe + 20)
        ends = [sum(struct.unpack_from("<II", buf, pe + 24 + optional + 40 * i + 16)) for i in range(n)]
        return min(max(ends, default=0), len(buf))
    except struct.error:
        return 0


def open_sfx(buf: bytes, name: str, options: Options) -> Archive:
    floor = pe_end(buf)
    found = min((at for m in SFX_MAGICS if (at := buf.find(m, floor)) >= 0), default=-1)
    if found < 0:
        raise unknown("program without an archive")
    from .detect import open_archive

    return open_archive(name, buf[found:], options, carved=True)


def appimage_offset(buf: bytes) -> int:
    if buf[:4] != b"\x7fELF" or len(buf) < 64:
        raise corrupt("no ELF program")
    order = {1: "<", 2: ">"}.get(buf[5])
    if order is None or buf[4] not in (1, 2):
        raise corrupt("ELF class")
    if buf[4] == 2:
        table, = struct.unpack_from(order + "Q", buf, 0x28)
        each, n = struct.unpack_from(order + "HH", buf, 0x3A)
    else:
        table, = struct.unpack_from(order + "I", buf, 0x20)
        each, n = struct.unpack_from(order + "HH", buf, 0x2E)
    if not 0 < table + each * n < len(buf):
        raise corrupt("ELF sections are out of bounds")
    return table + each * n


def open_appimage(buf: bytes, name: str, options: Options) -> Archive:
    from .images import open_iso, open_squashfs

    at = appimage_offset(buf)
    if buf[at : at + 4] == b"hsqs":
        inner = open_squashfs(buf[at:], name, options)
    elif buf[at + 0x8001 : at + 0x8006] == b"CD001":
        inner = open_iso(buf[at:], name, options)
    elif buf[0x8001:0x8006] == b"CD001":
        inner = open_iso(buf, name, options)
    else:
        raise unsupported("file system of the program")
    return Archive("AppImage", inner.entries)


# MSI: tables in a compound file


class Compound:
    """Streams of a compound file by name."""

    def __init__(self, buf: bytes):
        if buf[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" or len(buf) < 512:
            raise corrupt("compound file header")
        self.buf = buf
        self.shift, self.mini_shift = struct.unpack_from("<HH", buf, 30)
        if not 7 <= self.shift <= 16 or not 3 <= self.mini_shift <= self.shift:
            raise corrupt("compound file sectors")
        n_fat, directory, _, self.cutoff, mini_fat, n_mini, difat, n_difat = struct.unpack_from("<I I I I I I I I", buf, 44)
        sectors = list(struct.unpack_from("<109I", buf, 76))
        per = (1 << self.shift) // 4
        while difat < 0xFFFFFFFA and n_difat > 0:
            block = struct.unpack(f"<{per}I", self._sector(difat))
            sectors += block[:-1]
            difat, n_difat = block[-1], n_difat - 1
        self.fat: list[int] = []
        for s in sectors[:n_fat]:
            if s < 0xFFFFFFFA:
                self.fat += struct.unpack(f"<{per}I", self._sector(s))
        raw = self._chain(directory)
        self.mini_fat = list(struct.unpack(f"<{len(m) // 4}I", m)) if (m := self._chain(mini_fat) if n_mini else b"") else []
        self.streams: dict[str, tuple[int, int]] = {}
        self.mini = b""
        for i in range(0, len(raw) - 127, 128):
            e = raw[i : i + 128]
            n, kind = struct.unpack_from("<H", e, 64)[0], e[66]
            start, size = struct.unpack_from("<IQ", e, 116)
            if self.shift == 9:
                size &= 0xFFFFFFFF
            own = e[: max(n - 2, 0)].decode("utf-16-le", "replace")
            if kind == 5:
                self.mini = self._chain(start)[:size] if size else b""
            elif kind == 2:
                self.streams[decode_stream_name(own)] = (start, size)

    def _sector(self, i: int) -> bytes:
        at = (i + 1) << self.shift
        out = self.buf[at : at + (1 << self.shift)]
        return out.ljust(1 << self.shift, b"\0") if out else self._fail()

    def _fail(self):
        raise corrupt("compound file sector")

    def _chain(self, start: int) -> bytes:
        out, seen = [], 0
        while start < 0xFFFFFFFA:
            if start >= len(self.fat) and self.fat or seen > len(self.buf) >> self.shift:
                self._fail()
            out.append(self._sector(start))
            start = self.fat[start] if self.fat else 0xFFFFFFFE
            seen += 1
        return b"".join(out)

    def read(self, name: str) -> bytes:
        start, size = self.streams[name]
        if size >= self.cutoff:
            return self._chain(start)[:size]
        out, left = [], size
        while left > 0 and start < 0xFFFFFFFA:
            if start >= len(self.mini_fat):
                self._fail()
            at = start << self.mini_shift
            out.append(self.mini[at : at + (1 << self.mini_shift)])
            start, left = self.mini_fat[start], left - (1 << self.mini_shift)
        return b"".join(out)[:size]


_STREAM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz._"


def decode_stream_name(name: str) -> str:
    """Two characters of a stream's name are packed into one; a table's starts with a mark."""
    out = []
    for c in name:
        v = ord(c)
        if 0x3800 <= v < 0x4800:
            v -= 0x3800
            out += [_STREAM[v & 63], _STREAM[v >> 6]]
        elif 0x4800 <= v < 0x4840:
            out.append(_STREAM[v - 0x4800])
        elif v == 0x4840:
            out.append("!")
        else:
            out.append(c)
    return "".join(out)


def encode_stream_name(name: str, table: bool = False) -> str:
    out, i = ["䡀"] if table else [], 0
    while i < len(name):
        if name[i] in _STREAM and i + 1 < len(name) and name[i + 1] in _STREAM:
            out.append(chr(0x3800 + (_STREAM.index(name[i + 1]) << 6 | _STREAM.index(name[i]))))
            i += 2
        elif name[i] in _STREAM:
            out.append(chr(0x4800 + _STREAM.index(name[i])))
            i += 1
        else:
            out.append(name[i])
            i += 1
    return "".join(out)


class MsiTables:
    """The tables of an installer as lists of rows by column name."""

    def __init__(self, file: Compound):
        self.file = file
        if "!_Tables" not in file.streams:
            raise unknown("compound file without tables")
        pool, data = file.read("!_StringPool"), file.read("!_StringData")
        code, = struct.unpack_from("<I", pool)
        self.wide = bool(code & 0x80000000)
        code = code & 0x7FFFFFFF
        encoding = {0: "cp1252", 65001: "utf-8"}.get(code, f"cp{code}")
        self.strings, at, i = [None], 0, 4
        while i + 4 <= len(pool):
            n, refs = struct.unpack_from("<HH", pool, i)
            i += 4
            if n == 0 and refs and i + 4 <= len(pool):  # a long one: the size follows
                n, = struct.unpack_from("<I", pool, i)
                i += 4
            try:
                self.strings.append(data[at : at + n].decode(encoding, "replace"))
            except LookupError:
                self.strings.append(data[at : at + n].decode("utf-8", "replace"))
            at += n
        self.columns: dict[str, list[tuple[str, int]]] = {}
        for table, number, column, kind in self._rows("_Columns", [0x0D00, 0x0502, 0x0D00, 0x0502]):
            self.columns.setdefault(table, []).append((column, kind, number))

    def _rows(self, table: str, kinds: list[int]):
        if "!" + table not in self.file.streams:
            return []
        raw = self.file.read("!" + table)
        sizes = [(3 if self.wide else 2) if k & 0x0800 else (4 if k & 0xFF == 4 else 2) for k in kinds]
        n = len(raw) // max(sum(sizes), 1)
        columns, at = [], 0
        for k, size in zip(kinds, sizes):
            column = []
            for i in range(n):
                v = int.from_bytes(raw[at + i * size : at + (i + 1) * size], "little")
                if k & 0x0800:
                    column.append(self.strings[v] if v < len(self.strings) else None)
                else:
                    column.append(v - (1 << (8 * size - 1)) if v else None)
            at += n * size
            columns.append(column)
        return list(zip(*columns))

    def table(self, name: str) -> list[dict] | None:
        if name not in self.columns:
            return None
        columns = sorted(self.columns[name], key=lambda c: c[2] or 0)
        kinds = [(k or 0) + 0 for _, k, _ in columns]
        return [dict(zip((c for c, _, _ in columns), row)) for row in self._rows(name, kinds)]


def default_dir_name(value: str | None) -> str | None:
    """The long name before the source's; none for the empty one and the dot."""
    own = (value or "").split(":")[0].split("|")[-1]
    return own if own not in ("", ".") else None


def long_name(value: str) -> str:
    return value.split("|")[-1]


MSI_DEPTH = 256


def directory_path(key: str, directories: dict[str, tuple[str | None, str | None]]) -> list[str]:
    """Names from the root down to key. A root adds none; a circle ends where it closes."""
    names, seen = [], set()
    while key in directories and key not in seen and len(seen) < MSI_DEPTH:
        seen.add(key)
        parent, own = directories[key]
        if not parent or parent == key:
            break
        if own:
            names.append(own)
        key = parent
    return names[::-1]


def open_msi(buf: bytes, name: str, options: Options) -> Archive:
    file = Compound(buf)
    tables = MsiTables(file)
    media = tables.table("Media") or []
    cabinets = [m["Cabinet"][1:] for m in sorted(media, key=lambda m: m.get("DiskId") or 0) if (m.get("Cabinet") or "").startswith("#")]
    components, files, directories = (tables.table(t) for t in ("Component", "File", "Directory"))
    entries = []
    for cabinet in cabinets:
        if cabinet not in file.streams:
            raise corrupt(f"installer without its cabinet {cabinet}")
        inner = open_cab(file.read(cabinet), name, options)
        for e in inner.entries:
            entries.append((cabinet, e))
    if components is not None and files is not None and directories is not None:
        by_file = {f["File"]: f for f in files}
        by_component = {c["Component"]: c.get("Directory_") for c in components}
        tree = {d["Directory"]: (d.get("Directory_Parent"), default_dir_name(d.get("DefaultDir"))) for d in directories}
        for _, e in entries:
            row = by_file.get(e.path)
            if row:
                own = long_name(row.get("FileName") or "")
                where = by_component.get(row.get("Component_"))
                e.path = "/".join([*(directory_path(where, tree) if where else []), own])
    elif len(cabinets) > 1:
        for cabinet, e in entries:
            e.path = f"{cabinet}/{e.path}"
    for _, e in entries:
        e.raw = e.path.encode()
    return Archive("Msi", [e for _, e in entries])
