"""Writers of archives, for tests and for the queries' own inputs only: the engine reads."""

from __future__ import annotations

import base64
import bz2
import gzip
import hashlib
import io
import lzma
import struct
import zipfile
import zlib

import pyarrow as pa
import zstandard

Files = list[tuple[str, bytes]]


def zip_bytes(files: Files, method: int = zipfile.ZIP_DEFLATED) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, body in files:
            z.writestr(zipfile.ZipInfo(name, (2020, 2, 2, 2, 2, 2)), body, method)
    return out.getvalue()


def tar_bytes(files: Files, mode: int = 0o644, mtime: int = 1600000000) -> bytes:
    out = bytearray()
    for name, body in files:
        kind, link = b"0", b""
        if name.endswith("/"):
            kind = b"5"
        h = bytearray(512)
        raw = name.encode()
        prefix = b""
        if len(raw) > 100:
            cut = raw.rfind(b"/", 0, 155)
            prefix, raw = raw[:cut], raw[cut + 1 :]
        h[: len(raw)] = raw
        h[100:108], h[108:116], h[116:124] = b"%07o\0" % mode, b"%07o\0" % 0, b"%07o\0" % 0
        h[124:136], h[136:148] = b"%011o\0" % len(body), b"%011o\0" % mtime
        h[148:156], h[156:157], h[157 : 157 + len(link)] = b" " * 8, kind, link
        h[257:265] = b"ustar\x0000"
        h[345 : 345 + len(prefix)] = prefix
        h[148:156] = b"%06o\0 " % sum(h)
        out += h + body + bytes(-len(body) % 512)
    return bytes(out + bytes(1024))


def cpio_bytes(files: Files, mode: int = 0o100644, mtime: int = 1600000000) -> bytes:
    out = bytearray()
    for i, (name, body) in enumerate([*files, ("TRAILER!!!", b"")]):
        raw = name.encode() + b"\0"
        fields = [i, mode if name != "TRAILER!!!" else 0, 0, 0, 1, mtime, len(body), 0, 0, 0, 0, len(raw), 0]
        out += b"070701" + b"".join(b"%08X" % f for f in fields) + raw
        out += bytes(-len(out) % 4) + body
        out += bytes(-len(out) % 4)
    return bytes(out)


def ar_bytes(files: Files, mode: int = 0o100644, mtime: int = 1600000000) -> bytes:
    table, out = bytearray(), bytearray()
    for name, body in files:
        raw = name.encode()
        if len(raw) > 15 or b"/" in raw:
            own = b"/%d" % len(table)
            table += raw + b"/\n"
        else:
            own = raw + b"/"
        out += own.ljust(16) + b"%-12d%-6d%-6d%-8o%-10d`\n" % (mtime, 0, 0, mode, len(body)) + body + b"\n" * (len(body) & 1)
    head = b"//".ljust(16) + b" " * 32 + b"%-10d`\n" % len(table) + bytes(table) + b"\n" * (len(table) & 1) if table else b""
    return b"!<arch>\n" + head + bytes(out)


def compress(raw: bytes, kind: str, mtime: int = 0) -> bytes:
    if kind == "Gzip":
        return gzip.compress(raw, 6, mtime=mtime)
    if kind == "Bzip2":
        return bz2.compress(raw)
    if kind == "Xz":
        return lzma.compress(raw)
    if kind == "Lzma":
        return lzma.compress(raw, lzma.FORMAT_ALONE)
    if kind == "Zstd":
        return zstandard.ZstdCompressor().compress(raw)
    if kind == "Lzc":
        return lzc(raw)
    out = pa.BufferOutputStream()
    with pa.CompressedOutputStream(out, kind.lower()) as f:
        f.write(raw)
    return out.getvalue().to_pybytes()


def lzc(raw: bytes) -> bytes:
    """Unix compress with codes of 16 bits at most and no clearing."""
    table, codes, width = {bytes([i]): i for i in range(256)}, [], 9
    out, have, n, group = bytearray(b"\x1f\x9d\x90"), 0, 0, 0

    def put(code: int) -> None:
        nonlocal have, n, group
        have |= code << n
        n += width
        group += 1
        while n >= 8:
            out.append(have & 255)
            have >>= 8
            n -= 8

    w, following = b"", 257
    for b in raw:
        c = w + bytes([b])
        if c in table:
            w = c
            continue
        put(table[w])
        if following < 1 << 16:
            table[c] = following
            following += 1
            # The reader's table is one entry behind the writer's.
            if following - 1 >= 1 << width and width < 16:
                while group % 8:
                    put(0)
                width, group = width + 1, 0
        w = bytes([b])
    if w:
        put(table[w])
    if n:
        out.append(have & 255)
    del codes
    return bytes(out)


def deb_bytes(files: Files, kind: str | None = "Gzip") -> bytes:
    ext = {None: "", "Gzip": ".gz", "Xz": ".xz", "Zstd": ".zst", "Lzma": ".lzma", "Bzip2": ".bz2"}[kind]
    data = tar_bytes(files)
    return ar_bytes([("debian-binary", b"2.0\n"), ("control.tar", tar_bytes([])), (f"data.tar{ext}", compress(data, kind) if kind else data)])


def rpm_bytes(files: Files, kind: str = "Gzip") -> bytes:
    tag = {"Gzip": b"gzip", "Xz": b"xz", "Zstd": b"zstd", "Bzip2": b"bzip2", "Lzma": b"lzma"}[kind]

    def header(tags: dict[int, bytes]) -> bytes:
        index, store = b"", b""
        for t, value in tags.items():
            index += struct.pack(">IIII", t, 6, len(store), 1)
            store += value + b"\0"
        return b"\x8e\xad\xe8\1" + bytes(4) + struct.pack(">II", len(tags), len(store)) + index + store

    lead = b"\xed\xab\xee\xdb\3\0" + bytes(90)
    signature = header({1000: b"x"})
    return lead + signature + bytes(-len(lead + signature) % 8) + header({1124: b"cpio", 1125: tag}) + compress(cpio_bytes(files), kind)


def conda_bytes(files: Files, info: Files) -> bytes:
    z = lambda f: zstandard.ZstdCompressor().compress(tar_bytes(f))
    return zip_bytes([("metadata.json", b"{}"), ("pkg-x.tar.zst", z(files)), ("info-x.tar.zst", z(info))], zipfile.ZIP_STORED)


def crx_bytes(files: Files, version: int = 3) -> bytes:
    z = zip_bytes(files)
    return b"Cr24" + (struct.pack("<II", 3, 10) + bytes(10) if version == 3 else struct.pack("<III", 2, 3, 5) + bytes(8)) + z


def xar_bytes(files: Files) -> bytes:
    from xml.sax.saxutils import escape

    tree: dict = {}
    heap = bytearray()
    for name, body in files:
        node = tree
        *folders, own = name.split("/")
        for f in folders:
            node = node.setdefault(f, {})
        packed = zlib.compress(body)
        node[own] = (len(heap), len(packed), len(body))
        heap += packed

    def xml(node: dict) -> str:
        out = []
        for name, value in node.items():
            if isinstance(value, dict):
                out.append(f"<file><name>{escape(name)}</name><type>directory</type>{xml(value)}</file>")
            else:
                at, packed, size = value
                out.append(f'<file><name>{escape(name)}</name><type>file</type><mode>0644</mode><mtime>2020-09-13T12:26:40Z</mtime><data><offset>{at}</offset><length>{packed}</length><size>{size}</size><encoding style="application/x-gzip"/></data></file>')
        return "".join(out)

    toc = f'<?xml version="1.0" encoding="UTF-8"?><xar><toc>{xml(tree)}</toc></xar>'.encode()
    packed = zlib.compress(toc)
    return b"xar!" + struct.pack(">HHQQI", 28, 1, len(packed), len(toc), 0) + packed + bytes(heap)


def warc_record(kind: str, uri: str | None, body: bytes, date: str = "2024-03-01T12:00:00Z") -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if kind == "response" else body
    lines = ["WARC/1.0", f"WARC-Type: {kind}", f"WARC-Date: {date}"]
    if uri is not None:
        lines.append(f"WARC-Target-URI: {uri}")
    if kind == "response":
        lines.append("Content-Type: application/http; msgtype=response")
    return "\r\n".join([*lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def warc_bytes(records: list[tuple[str, str | None, bytes]], packed: bool = False) -> bytes:
    parts = [warc_record("warcinfo", None, b"software: test\r\n"), *(warc_record(*r) for r in records)]
    return b"".join(gzip.compress(p, 6, mtime=0) if packed else p for p in parts)


def cab_bytes(files: Files, packed: bool = True) -> bytes:
    data = b"".join(b for _, b in files)
    blocks, before = [], b""
    for i in range(0, max(len(data), 1), 32768):
        raw = data[i : i + 32768]
        if packed:
            c = zlib.compressobj(6, zlib.DEFLATED, -15, zdict=before) if before else zlib.compressobj(6, zlib.DEFLATED, -15)
            body = b"CK" + c.compress(raw) + c.flush()
            before = raw
        else:
            body = raw
        blocks.append(struct.pack("<IHH", 0, len(body), len(raw)) + body)
    entries, at = b"", 0
    for name, body in files:
        entries += struct.pack("<IIHHHH", len(body), at, 0, (2020 - 1980) << 9 | 2 << 5 | 2, 2 << 11 | 2 << 5 | 1, 0x20) + name.encode() + b"\0"
        at += len(body)
    first = 36 + 8
    start = first + len(entries)
    total = start + sum(map(len, blocks))
    head = b"MSCF" + struct.pack("<IIIIIBBHHHHH", 0, total, 0, first, 0, 3, 1, 1, len(files), 0, 1, 0)
    return head + struct.pack("<IHH", start, len(blocks), 1 if packed else 0) + entries + b"".join(blocks)


def wim_bytes(files: Files, stamp: int = 132443692000000000) -> bytes:
    """An uncompressed image; files with equal bodies share one."""
    tree: dict = {}
    bodies: dict[bytes, bytes] = {}
    for name, body in files:
        node = tree
        *folders, own = name.split("/")
        for f in folders:
            node = node.setdefault(f, {})
        node[own] = hashlib.sha1(body).digest() if body else bytes(20)
        if body:
            bodies.setdefault(node[own], body)

    def size(name: str) -> int:
        n = 0x66 + 2 * len(name) + 2
        return n + -n % 8

    meta = bytearray(struct.pack("<II", 8, 0))

    def entry(name: str, folder: bool, sub: int, digest: bytes) -> bytes:
        raw = name.encode("utf-16-le")
        n = 0x66 + len(raw) + 2
        e = bytearray(n)
        struct.pack_into("<QII", e, 0, n, 0x10 if folder else 0x20, 0xFFFFFFFF)
        struct.pack_into("<Q", e, 16, sub)
        struct.pack_into("<QQQ", e, 0x28, stamp, stamp, stamp)
        e[0x40:0x54] = digest
        struct.pack_into("<H", e, 0x64, len(raw))
        e[0x66 : 0x66 + len(raw)] = raw
        return bytes(e) + bytes(-n % 8)

    def place(node: dict) -> int:
        at = len(meta)
        meta.extend(bytes(sum(size(k) for k in node) + 8))
        pos = at
        for k, v in node.items():
            sub = place(v) if isinstance(v, dict) else 0
            e = entry(k, isinstance(v, dict), sub, v if isinstance(v, bytes) else bytes(20))
            meta[pos : pos + len(e)] = e
            pos += len(e)
        return at

    n_root = size("")
    meta.extend(bytes(n_root + 8))
    sub = place(tree)
    meta[8 : 8 + n_root] = entry("", True, sub, bytes(20))
    out, table = bytearray(208), b""
    resource = lambda n, flags, at: struct.pack("<QQQ", n | flags << 56, at, n)
    for digest, body in bodies.items():
        table += resource(len(body), 0, len(out)) + struct.pack("<HI", 1, 1) + digest
        out += body
    table += resource(len(meta), 2, len(out)) + struct.pack("<HI", 1, 1) + hashlib.sha1(meta).digest()
    out += meta
    at = len(out)
    out += table
    out[:8] = b"MSWIM\0\0\0"
    struct.pack_into("<IIII", out, 8, 208, 0x10D00, 0, 0)
    struct.pack_into("<HHI", out, 40, 1, 1, 1)
    out[48:72] = resource(len(table), 0, at)
    return bytes(out)


def dmg_bytes(image: bytes, kind: int = 0x80000005, sectors: int = 64) -> bytes:
    """An image in chunks of one kind, with zeros left out."""
    image += bytes(-len(image) % 512)
    chunks, data = [], bytearray()
    for at in range(0, len(image), sectors * 512):
        raw = image[at : at + sectors * 512]
        if not any(raw):
            chunks.append((0, at // 512, len(raw) // 512, 0, 0))
            continue
        packed = {1: lambda: raw, 0x80000005: lambda: zlib.compress(raw), 0x80000006: lambda: bz2.compress(raw), 0x80000008: lambda: lzma.compress(raw), 0x80000004: lambda: b"".join(bytes([0x80 | len(p) - 1]) + p for i in range(0, len(raw), 128) for p in [raw[i : i + 128]])}[kind]()  # noqa: B023
        chunks.append((kind, at // 512, len(raw) // 512, len(data), len(packed)))
        data += packed
    chunks.append((0xFFFFFFFF, len(image) // 512, 0, len(data), 0))
    mish = bytearray(0xCC)
    mish[:4] = b"mish"
    struct.pack_into(">IQQQ", mish, 4, 1, 0, len(image) // 512, 0)
    struct.pack_into(">I", mish, 0xC8, len(chunks))
    for c in chunks:
        mish += struct.pack(">IIQQQQ", c[0], 0, *c[1:])
    xml = b'<?xml version="1.0" encoding="UTF-8"?><plist version="1.0"><dict><key>resource-fork</key><dict><key>blkx</key><array><dict><key>Data</key><data>' + base64.b64encode(bytes(mish)) + b"</data></dict></array></dict></dict></plist>"
    koly = bytearray(512)
    koly[:8] = b"koly\0\0\0\4"
    struct.pack_into(">QQ", koly, 0x18, 0, len(data))
    struct.pack_into(">QQ", koly, 0xD8, len(data), len(xml))
    return bytes(data) + xml + bytes(koly)


def sfx_bytes(archive: bytes) -> bytes:
    """A program of one section with a false signature in it, and an archive behind it."""
    pe = bytearray(1024)
    pe[:2] = b"MZ"
    struct.pack_into("<I", pe, 0x3C, 0x80)
    pe[0x80:0x84] = b"PE\0\0"
    struct.pack_into("<HHIIIHH", pe, 0x84, 0x14C, 1, 0, 0, 0, 0, 0)
    struct.pack_into("<II", pe, 0x98 + 16, 512, 512)
    pe[0x100:0x104] = b"PK\3\4"
    return bytes(pe) + archive


def split(raw: bytes, parts: int) -> list[bytes]:
    n = -(-len(raw) // parts)
    return [raw[i : i + n] for i in range(0, len(raw), n)]


def rar_bytes(files: Files) -> bytes:
    """RAR 5 with stored entries."""

    def vint(n):
        out = bytearray()
        while True:
            out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
            n >>= 7
            if not n:
                return bytes(out)

    def block(kind, flags, rest, data=b""):
        head = vint(kind) + vint(flags) + (vint(len(data)) if flags & 2 else b"") + rest
        sized = vint(len(head)) + head
        return struct.pack("<I", zlib.crc32(sized)) + sized + data

    out = b"Rar!\x1a\x07\x01\x00" + block(1, 0, vint(0))
    for name, body in files:
        raw = name.encode()
        out += block(2, 2, vint(4) + vint(len(body)) + vint(0o100755) + struct.pack("<I", zlib.crc32(body)) + vint(0) + vint(1) + vint(len(raw)) + raw, body)
    return out + block(5, 0, vint(0))


def hfs_bytes(files: Files) -> bytes:
    """A small volume: one leaf with a thread-free catalog, files in blocks behind it."""
    block, blocks = 4096, [b"", b"", b""]  # 0: header, 1-2: catalog
    records, places = [], []
    folders = {"": 2}
    for name, body in files:
        *up, own = name.split("/")
        for k in range(len(up)):
            folders.setdefault("/".join(up[: k + 1]), 16 + len(folders))
        start = len(blocks)
        n = max(-(-len(body) // block), 1)
        blocks += [body[i * block : (i + 1) * block].ljust(block, b"\0") for i in range(n)]
        places.append(("/".join(up), own, 100 + start, start, n, len(body)))
    key = lambda parent, name: struct.pack(">HIH", 6 + 2 * len(name), parent, len(name)) + name.encode("utf-16-be")
    stamp = 2082844800 + 1600000000
    for path, cnid in folders.items():
        if path:
            up, _, own = path.rpartition("/")
            records.append((folders[up], own, struct.pack(">HHIIIIII", 1, 0, 0, cnid, 0, stamp, 0, 0) + bytes(64)))
    for up, own, cnid, start, n, size in places:
        fork = struct.pack(">QII", size, 0, n) + struct.pack(">II", start, n) + bytes(56)
        body = struct.pack(">HHIIIII", 2, 0, 0, cnid, 0, stamp, 0).ljust(32, b"\0") + bytes(10) + struct.pack(">H", 0o100644) + bytes(4)
        records.append((folders[up], own, body.ljust(88, b"\0") + fork + bytes(80)))
    records.sort(key=lambda r: (r[0], r[1]))
    leaf, offsets = bytearray(struct.pack(">IIbBHH", 0, 0, -1, 1, len(records), 0)), []
    for parent, own, body in records:
        offsets.append(len(leaf))
        k = key(parent, own)
        leaf += k + bytes(len(k) & 1) + body
    leaf = leaf.ljust(4096, b"\0")
    for i, at in enumerate(offsets):
        struct.pack_into(">H", leaf, 4096 - 2 * (i + 1), at)
    head = bytearray(4096)
    struct.pack_into(">IIbBHH", head, 0, 0, 0, 1, 0, 3, 0)
    struct.pack_into(">HIIII", head, 14, 1, 1, len(records), 1, 1)
    struct.pack_into(">H", head, 14 + 18, 4096)
    blocks[1], blocks[2] = bytes(head), bytes(leaf)
    volume = bytearray(512)
    volume[:2] = b"H+"
    struct.pack_into(">I", volume, 40, block)
    struct.pack_into(">QIIII", volume, 272, 8192, 0, 2, 1, 2)
    blocks[0] = (bytes(1024) + bytes(volume)).ljust(4096, b"\0")
    return b"".join(blocks)


def squashfs_bytes(files: Files, how: int = 1) -> bytes:
    """Files of one folder, in whole blocks without fragments."""
    pack_one = {1: zlib.compress, 4: lambda b: lzma.compress(b, lzma.FORMAT_XZ)}[how]
    out, inodes, entries = bytearray(96), bytearray(), bytearray()
    for i, (name, body) in enumerate(files):
        start, sizes = len(out), []
        for k in range(0, len(body), 131072):
            z = pack_one(body[k : k + 131072])
            sizes.append(len(z))
            out += z
        offset = len(inodes)
        inodes += struct.pack("<HHHHII", 2, 0o644, 0, 0, 1600000000, i + 2) + struct.pack("<IIII", start, 0xFFFFFFFF, 0, len(body)) + struct.pack(f"<{len(sizes)}I", *sizes)
        entries += struct.pack("<HhHH", offset, i, 2, len(name) - 1) + name.encode()
    listing = struct.pack("<III", len(files) - 1, 0, 2) + bytes(entries)
    root = len(inodes)
    inodes += struct.pack("<HHHHII", 1, 0o755, 0, 0, 1600000000, 1) + struct.pack("<IIHHI", 0, 2, len(listing) + 3, 0, 0)
    meta = lambda b: struct.pack("<H", len(z := pack_one(bytes(b)))) + z
    inode_at = len(out)
    out += meta(inodes)
    dir_at = len(out)
    out += meta(listing)
    out[:96] = b"hsqs" + struct.pack("<IIIIHH", len(files) + 1, 0, 131072, 0, how, 17) + struct.pack("<HHHH", 0, 1, 4, 0) + struct.pack("<QQQQQQQQ", root, len(out), 0, 2**64 - 1, inode_at, dir_at, len(out), 2**64 - 1)
    return bytes(out)


def appimage_bytes(files: Files) -> bytes:
    elf = bytearray(128)
    elf[:11] = b"\x7fELF\x02\x01\x01\x00AI\x02"
    struct.pack_into("<Q", elf, 0x28, 64)
    struct.pack_into("<HH", elf, 0x3A, 64, 1)
    return bytes(elf) + squashfs_bytes(files)


def compound_bytes(streams: dict[str, bytes]) -> bytes:
    """A compound file; streams below 4096 bytes share the small sectors of the root's own."""
    sector, sectors, fat = 512, [], []

    def chain(body: bytes) -> int:
        start = len(sectors)
        parts = [body[i : i + sector].ljust(sector, b"\0") for i in range(0, len(body), sector)]
        sectors.extend(parts)
        fat.extend([*range(start + 1, start + len(parts)), 0xFFFFFFFE][: len(parts)])
        return start if parts else 0xFFFFFFFE

    small, small_fat, directory = bytearray(), [], []
    for name, body in streams.items():
        if len(body) >= 4096:
            start = chain(body)
        else:
            start, n = len(small_fat), -(-len(body) // 64)
            small += body.ljust(64 * n, b"\0")
            small_fat += [*range(start + 1, start + n), 0xFFFFFFFE][:n]
            start = start if n else 0xFFFFFFFE
        directory.append((name, 2, start, len(body)))
    directory.insert(0, ("Root Entry", 5, chain(bytes(small)), len(small)))
    raw = b""
    for name, kind, start, size in directory:
        raw += name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", *[0xFFFFFFFF] * 3) + bytes(36) + struct.pack("<IQ", start, size)
    small_fat += [0xFFFFFFFF] * (-len(small_fat) % 128)
    small_at = chain(struct.pack(f"<{len(small_fat)}I", *small_fat))
    directory_at = chain(raw)
    n_fat = 1
    while (len(sectors) + n_fat) * 4 > n_fat * sector:
        n_fat += 1
    fat_at = len(sectors)
    fat += [0xFFFFFFFD] * n_fat
    fat += [0xFFFFFFFF] * (n_fat * 128 - len(fat))
    sectors += [struct.pack("<128I", *fat[128 * k : 128 * k + 128]) for k in range(n_fat)]
    head = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + bytes(16) + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + bytes(10)
    head += struct.pack("<IIIIIIII", n_fat, directory_at, 0, 4096, small_at, len(small_fat) // 128, 0xFFFFFFFE, 0)
    head += struct.pack("<109I", *[fat_at + k if k < n_fat else 0xFFFFFFFF for k in range(109)])
    return head + b"".join(sectors)


def sevenz_bytes(files: Files, packed: bool = True, stamp: int = 132443692000000000) -> bytes:
    """One solid folder, of LZMA2 or copied."""

    def number(n: int) -> bytes:
        for k in range(8):
            if n < 1 << 7 * (k + 1):
                return bytes([(0xFF00 >> k) & 0xFF | n >> 8 * k]) + (n & (1 << 8 * k) - 1).to_bytes(k, "little")
        return b"\xff" + n.to_bytes(8, "little")

    full = [b for _, b in files if b]
    data = b"".join(full)
    body = lzma.compress(data, lzma.FORMAT_RAW, filters=[{"id": lzma.FILTER_LZMA2, "dict_size": 1 << 20}]) if packed else data
    coder = b"\x21\x21\x01\x10" if packed else b"\x01\x00"
    streams = b""
    if full:
        streams = b"\x04\x06" + number(0) + number(1) + b"\x09" + number(len(body)) + b"\0"
        streams += b"\x07\x0b\x01\0\x01" + coder + b"\x0c" + number(len(data)) + b"\0"
        streams += b"\x08\x0d" + number(len(full)) + (b"\x09" + b"".join(number(len(b)) for b in full[:-1]) if len(full) > 1 else b"")
        streams += b"\x0a\x01" + b"".join(struct.pack("<I", zlib.crc32(b)) for b in full) + b"\0\0"
    field = lambda tag, raw: bytes([tag]) + number(len(raw)) + raw
    bits = lambda flags: int("".join("01"[f] for f in flags).ljust(-(-len(flags) // 8) * 8, "0"), 2).to_bytes(-(-len(flags) // 8), "big")
    info = b"\x05" + number(len(files))
    empty = [not b for _, b in files]
    if any(empty):
        info += field(14, bits(empty)) + field(15, bits([True] * sum(empty)))
    info += field(17, b"\0" + b"".join(n.encode("utf-16-le") + b"\0\0" for n, _ in files))
    info += field(20, b"\x01\0" + struct.pack("<Q", stamp) * len(files)) + b"\0"
    header = b"\x01" + streams + info + b"\0"
    start = struct.pack("<QQI", len(body) if full else 0, len(header), zlib.crc32(header))
    return b"7z\xbc\xaf\x27\x1c\0\4" + struct.pack("<I", zlib.crc32(start)) + start + (body if full else b"") + header


def iso_bytes(files: Files) -> bytes:
    """An image with Rock Ridge names and folders of one level."""
    block, out = 2048, []  # blocks behind the descriptors
    stamp = bytes([120, 9, 13, 12, 26, 40, 0])
    both = lambda n: struct.pack("<I", n) + struct.pack(">I", n)

    def record(raw: bytes, at: int, size: int, folder: bool, system: bytes = b"") -> bytes:
        own = both(at) + both(size) + stamp + bytes([2 if folder else 0, 0, 0, 1, 0, 0, 1, len(raw)]) + raw + bytes(1 - len(raw) % 2) + system
        own += bytes(len(own) % 2)
        return bytes([len(own) + 2, 0]) + own

    def put(raw: bytes) -> int:
        at = 18 + len(out)
        out.extend(raw[i : i + block].ljust(block, b"\0") for i in range(0, max(len(raw), 1), block))
        return at

    def table(rows: list[bytes]) -> bytes:
        raw = b""
        for r in rows:
            if len(raw) % block + len(r) > block:
                raw += bytes(-len(raw) % block)
            raw += r
        return raw + bytes(-len(raw) % block)

    name_of = lambda name: b"NM" + bytes([5 + len(name.encode()), 1, 0]) + name.encode()
    folders: dict[str, list[bytes]] = {"": []}
    for i, (name, body) in enumerate(files):
        up, _, own = name.rpartition("/")
        folders.setdefault(up, []).append(record(b"F%07d.;1" % i, put(body), len(body), False, name_of(own)))
    root = folders.pop("")
    for k, (name, rows) in enumerate(folders.items()):
        raw = table([record(b"\0", 0, block, True), record(b"\1", 0, block, True), *rows])
        root.append(record(b"D%07d" % k, put(raw), len(raw), True, name_of(name)))
    size = len(table([bytes(34 + 7 + 7), bytes(34), *root]))
    at = 18 + len(out)
    raw = table([record(b"\0", at, size, True, b"SP\7\1\xbe\xef\0"), record(b"\1", at, size, True), *root])
    put(raw)
    volume = bytearray(block)
    volume[:7] = b"\1CD001\1"
    struct.pack_into("<H", volume, 128, block)
    volume[156:190] = record(b"\0", at, len(raw), True)[:34]
    return bytes(0x8000) + bytes(volume) + b"\xffCD001\1".ljust(block, b"\0") + b"".join(out)


def locked_zip_bytes(files: Files, password: str, strong: bool) -> bytes:
    """Stored entries under the old cipher or AES-256."""
    import hmac

    from ..sources import ciphers

    out, central = bytearray(), b""
    for name, body in files:
        raw, crc = name.encode(), zlib.crc32(body)
        if strong:
            salt = hashlib.sha256(raw).digest()[:16]
            keys = hashlib.pbkdf2_hmac("sha1", password.encode(), salt, 1000, 66)
            data = ciphers.Aes(keys[:32]).ctr(body)
            data = salt + keys[64:] + data + hmac.new(keys[32:64], data, "sha1").digest()[:10]
            method, extra, crc = 99, struct.pack("<HHHHBH", 0x9901, 7, 2, 0x4541, 3, 0), 0
        else:
            data = ciphers.ZipCrypto(password.encode()).encrypt(bytes(11) + bytes([crc >> 24]) + body)
            method, extra = 0, b""
        fields = struct.pack("<HHHHIIIHH", 1, method, 0, 33, crc, len(data), len(body), len(raw), len(extra))
        central += b"PK\1\2" + struct.pack("<HH", 20, 20) + fields + struct.pack("<HHHII", 0, 0, 0, 0, len(out)) + raw + extra
        out += b"PK\3\4" + struct.pack("<H", 20) + fields + raw + extra + data
    return bytes(out) + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(files), len(files), len(central), len(out), 0)


def crc16(raw: bytes) -> int:
    table = _CRC16 or _CRC16.extend(_crc16_table()) or _CRC16
    crc = 0
    for b in raw:
        crc = crc >> 8 ^ table[(crc ^ b) & 255]
    return crc


_CRC16: list[int] = []


def _crc16_table():
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ 0xA001 * (b & 1)
        yield b


def arc_bytes(files: Files) -> bytes:
    return b"".join(b"\x1a\x02" + n.encode().ljust(13, b"\0") + struct.pack("<IHHHI", len(b), 5, 0, crc16(b), len(b)) + b for n, b in files) + b"\x1a\0"


def lbr_bytes(files: Files) -> bytes:
    """Members begin at sectors of 128 bytes; a member's last one is padded."""
    n = -(-32 * (len(files) + 1) // 128)
    entry = lambda name, ext, at, count, pad: b"\0" + name.ljust(8) + ext.ljust(3) + struct.pack("<HH", at, count) + bytes(10) + bytes([pad]) + bytes(5)
    table, data = entry(b"", b"", 0, n, 0), b""
    for name, body in files:
        base, _, ext = name.encode().partition(b".")
        count = -(-len(body) // 128)
        table += entry(base, ext, n + len(data) // 128, count, 128 * count - len(body))
        data += body.ljust(128 * count, b"\0")
    return table.ljust(128 * n, b"\xff") + data


def alz_bytes(files: Files) -> bytes:
    out = b"ALZ\1" + bytes(4)
    for k, (name, body) in enumerate(files):
        method, data = [(0, body), (1, bz2.compress(body)), (2, zlib.compress(body)[2:-4])][k % 3]
        raw = name.encode()
        out += b"BLZ\1" + struct.pack("<HBIBB", len(raw), 0x20, 0, 0x40, 0) + bytes([method, 0]) + struct.pack("<III", zlib.crc32(body), len(data), len(body)) + raw + data
    return out


def arj_bytes(files: Files) -> bytes:
    def header(kind: int, name: str, size: int, crc: int) -> bytes:
        raw = bytes([30, 11, 1, 0, 0, 0, kind, 0]) + bytes(4) + struct.pack("<III", size, size, crc) + bytes(6) + name.encode() + b"\0\0"
        return b"\x60\xea" + struct.pack("<H", len(raw)) + raw + struct.pack("<I", zlib.crc32(raw)) + b"\0\0"

    return header(2, "x.arj", 0, 0) + b"".join(header(0, n, len(b), zlib.crc32(b)) + b for n, b in files) + b"\x60\xea\0\0"


def zoo_bytes(files: Files) -> bytes:
    out = bytearray(b"ZOO 2.10 Archive.\x1a".ljust(20, b"\0") + b"\xdc\xa7\xc4\xfd" + struct.pack("<I", 42) + bytes(14))
    for name, body in files:
        following, start = len(out) + 58 + len(body), len(out) + 58
        out += b"\xdc\xa7\xc4\xfd\1\0" + struct.pack("<IIHHHII", following, start, 0, 0, 0, len(body), len(body)) + bytes(10) + name.encode().ljust(13, b"\0") + bytes(7) + body
    return bytes(out + b"\xdc\xa7\xc4\xfd\1\0" + bytes(52))


def stuffit_bytes(files: Files) -> bytes:
    out = b""
    for name, body in files:
        raw = name.encode()
        h = bytearray(112)
        h[2], h[3 : 3 + len(raw)] = len(raw), raw
        struct.pack_into(">IIII", h, 84, 0, len(body), 0, len(body))
        out += bytes(h) + body
    return b"SIT!" + struct.pack(">HI", len(files), 22 + len(out)) + b"rLau" + bytes(8) + out


def macbinary_bytes(files: Files) -> bytes:
    (name, body), head = files[0], bytearray(128)
    raw = name.encode()
    head[1], head[2 : 2 + len(raw)], head[102:106] = len(raw), raw, b"mBIN"
    struct.pack_into(">II", head, 83, len(body), 0)
    return bytes(head) + body + bytes(-len(body) % 128)


def applesingle_bytes(files: Files) -> bytes:
    (name, body), raw = files[0], files[0][0].encode()
    return b"\0\5\x16\0\0\2\0\0" + bytes(16) + struct.pack(">H", 2) + struct.pack(">III", 3, 50, len(raw)) + struct.pack(">III", 1, 50 + len(raw), len(body)) + raw + body


def binhex_bytes(files: Files) -> bytes:
    """Both checksums are left zero."""
    (name, body), raw = files[0], files[0][0].encode()
    plain = bytes([len(raw)]) + raw + b"\0TEXTttxt\0\0" + struct.pack(">II", len(body), 0) + b"\0\0" + body + b"\0\0\0\0"
    plain = plain.replace(b"\x90", b"\x90\0")
    characters = b"!\"#$%&'()*+,-012345689@ABCDEFGHIJKLMNPQRSTUVXYZ[`abcdefhijklmpqr"  # fixed values
    sixes = base64.b64encode(plain).rstrip(b"=").translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", characters))
    lines = b"\n".join(sixes[i : i + 64] for i in range(0, len(sixes), 64))
    return b"(This file must be converted with BinHex 4.0)\n:" + lines + b":\n"


def dms_bytes(files: Files) -> bytes:
    """Tracks of 20000 bytes, stored or, if that is shorter, as runs."""
    out, body = b"DMS!" + bytes(52), files[0][1]
    for k in range(0, len(body), 20000):
        data = body[k : k + 20000]
        out += b"TR" + struct.pack(">HHHHHBB", k // 20000, 0, len(data), 0, len(data), 0, 0) + bytes(6) + data
    return out


def msi_bytes(tables: dict, cabs: dict[str, bytes]) -> bytes:
    """A database of tables (columns "s" or "i", rows) with cabinets."""
    from ..sources import packs

    strings, index = [], {}

    def s(text):
        if text is None:
            return 0
        if text not in index:
            strings.append(text)
            index[text] = len(strings)
        return index[text]

    streams, columns = {}, []
    for table, (kinds, rows) in tables.items():
        columns_of = list(kinds)
        for k, n in enumerate(columns_of):
            columns.append((s(table), k + 1 + 0x8000, s(n), (0x0D48 if kinds[n] == "s" else 0x0502) + 0x8000))
        raw = b""
        for k, n in enumerate(columns_of):
            for row in rows:
                raw += struct.pack("<H", s(row[k]) if kinds[n] == "s" else row[k] + 0x8000)
        streams[packs.encode_stream_name(table, True)] = raw
    columns.sort()
    streams[packs.encode_stream_name("_Columns", True)] = b"".join(struct.pack("<H", c[k]) for k in range(4) for c in columns)
    streams[packs.encode_stream_name("_Tables", True)] = b"".join(struct.pack("<H", s(t)) for t in tables)
    streams[packs.encode_stream_name("_StringPool", True)] = struct.pack("<I", 65001) + b"".join(struct.pack("<HH", len(t.encode()), 1) for t in strings)
    streams[packs.encode_stream_name("_StringData", True)] = "".join(strings).encode()
    for name, raw in cabs.items():
        streams[packs.encode_stream_name(name)] = raw
    return compound_bytes(streams)
