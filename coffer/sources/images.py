"""File-system images: ISO 9660, SquashFS, WIM, HFS+ and disk images around them."""

from __future__ import annotations

import base64
import bz2
import lzma
import plistlib
import re
import struct
import zlib

from ..errors import ArchiveError, corrupt, unknown, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from . import times
from .codecs import Lzx, adc, lz4_block, lzo, unzstd, xpress_huffman
from .lzfse import lzfse, lzvn

# ISO 9660


def is_iso(buf: bytes) -> bool:
    return buf[0x8001:0x8006] == b"CD001"


def open_iso(buf: bytes, name: str, options: Options) -> Archive:
    """Rock Ridge names if there are any, else Joliet's, else short ones."""
    if len(buf) < 0x8006:
        raise ArchiveError("IO", "image is too short")
    if not is_iso(buf):
        raise unknown("no image signature")
    primary = joliet = None
    for at in range(0x8000, min(len(buf), 0x8000 + 2048 * 64), 2048):
        d = buf[at : at + 2048]
        if len(d) < 2048 or d[1:6] != b"CD001" or d[0] == 255:
            break
        if d[0] == 1 and primary is None:
            primary = d
        elif d[0] == 2 and d[88:91] in (b"%/@", b"%/C", b"%/E"):
            joliet = d
    if primary is None:
        raise corrupt("image without a primary descriptor")
    block = struct.unpack_from("<H", primary, 128)[0] or 2048
    root = primary[156:190]
    first = struct.unpack_from("<I", root, 2)[0] * block
    head = buf[first : first + (buf[first] if first < len(buf) else 0)]
    susp = head[34:]
    ridge = susp[:2] == b"SP"
    skip = susp[6] if ridge and len(susp) > 6 else 0
    if not ridge and joliet is not None:
        root = joliet[156:190]
    wide, entries, seen = not ridge and joliet is not None, [], set()

    def fields(raw: bytes):
        hops = 0
        while True:
            more = None
            while len(raw) >= 4 and raw[2] >= 4 and raw[2] <= len(raw):
                if raw[:2] == b"CE" and raw[2] >= 28:
                    where, off, n = (struct.unpack_from("<I", raw, k)[0] for k in (4, 12, 20))
                    more = buf[where * block + off : where * block + off + n]
                elif raw[:2] == b"ST":
                    break
                yield raw[:2], raw[4 : raw[2]]
                raw = raw[raw[2] :]
            hops += 1
            if more is None or hops > 32:
                return
            raw = more

    def walk(at: int, size: int, above: str, depth: int) -> None:
        if at in seen or depth > 256:
            return
        seen.add(at)
        if at + size > len(buf):
            raise corrupt("directory is out of bounds")
        end, pos = at + size, at
        while pos < end:
            n = buf[pos]
            if n == 0:
                pos = (pos // block + 1) * block
                continue
            r = buf[pos : pos + n]
            pos += n
            if len(r) < 34 or 33 + r[32] > len(r):
                raise corrupt("directory record")
            raw = r[33 : 33 + r[32]]
            if raw in (b"\0", b"\1"):
                continue
            where, length = struct.unpack_from("<I", r, 2)[0], struct.unpack_from("<I", r, 10)[0]
            own = raw.decode("utf-16-be", "replace") if wide else raw.decode("latin-1")
            own = re.sub(r";\d+$", "", own)
            if not wide:
                own = own.rstrip(".") if own.endswith(".") else own
            kind, link, moved = DIR if r[25] & 2 else FILE, None, False
            if ridge:
                nm, parts = b"", []
                for tag, body in fields(r[33 + r[32] + (1 - r[32] % 2) + skip :]):
                    if tag == b"NM" and body and not body[1 - 1] & 6:
                        nm += body[1:]
                    elif tag == b"SL" and body:
                        c = body[1:]
                        while len(c) >= 2:
                            flag, k = c[0], c[1]
                            parts.append("." if flag & 2 else ".." if flag & 4 else "" if flag & 8 else c[2 : 2 + k].decode("utf-8", "replace"))
                            c = c[2 + k :]
                        kind = SYMLINK
                    elif tag == b"RE":
                        moved = True
                    elif tag == b"CL" and len(body) >= 4:
                        kind, where = DIR, struct.unpack_from("<I", body)[0]
                        length = struct.unpack_from("<I", buf, where * block + 10)[0]
                if nm:
                    own = nm.decode("utf-8", "replace")
                if kind == SYMLINK:
                    link = "/".join(parts) if parts != [""] else "/"
            if moved:
                continue
            path = f"{above}/{own}" if above else own
            e = Entry(path.encode(), path=path, kind=kind, link_target=link, size=length if kind == FILE else 0)
            if kind == FILE:
                t = r[18:25]
                stamp = times.civil(t[0] + 1900, *t[1:6])
                zone = struct.unpack("b", t[6:7])[0]
                e.modified = stamp - zone * 900 * times.NS if stamp is not None and stamp >= zone * 900 * times.NS else None
                e.read = _span(buf, where * block, length)
            entries.append(e)
            if kind == DIR:
                walk(where * block, length, path, depth + 1)

    walk(struct.unpack_from("<I", root, 2)[0] * block, struct.unpack_from("<I", root, 10)[0], "", 0)
    return Archive("Iso", entries)


def _span(buf, start, size):
    def read() -> bytes:
        out = buf[start : start + size]
        if len(out) < size:
            raise corrupt("file is out of bounds")
        return out

    return read


# SquashFS


def open_squashfs(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:4] != b"hsqs" or len(buf) < 96:
        raise corrupt("squashfs header")
    n_inodes, _, block, n_frag, how, log = struct.unpack_from("<IIIIHH", buf, 4)
    _, n_ids, major, _ = struct.unpack_from("<HHHH", buf, 24)
    root, _, _, _, inode_at, dir_at, frag_at, _ = struct.unpack_from("<QQQQQQQQ", buf, 32)
    if major != 4:
        raise unsupported(f"squashfs version {major}")
    if not 12 <= log <= 20 or block != 1 << log:
        raise corrupt("squashfs block size")

    def unpack(raw: bytes, size: int) -> bytes:
        try:
            if how == 1:
                return zlib.decompress(raw)
            if how == 2:
                return lzma.decompress(raw, lzma.FORMAT_ALONE)
            if how == 3:
                return lzo(raw)
            if how == 4:
                return lzma.decompress(raw, lzma.FORMAT_XZ)
            if how == 5:
                return lz4_block(raw, size)
            if how == 6:
                return unzstd(raw)
        except (zlib.error, lzma.LZMAError, ValueError) as e:
            raise corrupt(str(e)) from None
        raise unsupported(f"squashfs compressor {how}")

    blocks: dict[int, tuple[bytes, int]] = {}

    def meta(at: int) -> tuple[bytes, int]:
        if at not in blocks:
            if at + 2 > len(buf):
                raise corrupt("squashfs table is out of bounds")
            head, = struct.unpack_from("<H", buf, at)
            n = head & 0x7FFF
            raw = buf[at + 2 : at + 2 + n]
            if len(raw) < n:
                raise corrupt("squashfs table is cut short")
            blocks[at] = raw if head & 0x8000 else unpack(raw, 8192), at + 2 + n
        return blocks[at]

    def take(start: int, offset: int, n: int) -> bytes:
        out, at = b"", start
        while len(out) < offset + n:
            part, after = meta(at)
            if not part or after <= at:
                raise corrupt("squashfs table")
            out, at = out + part, after
        return out[offset : offset + n]

    def inode(ref: int):
        start, offset = inode_at + (ref >> 16), ref & 0xFFFF
        kind, mode, _, _, mtime, _ = struct.unpack("<HHHHII", take(start, offset, 16))
        rest = lambda n, skip=0: take(start, offset + 16 + skip, n)
        base = (kind - 1) % 7 + 1
        info = {"kind": base, "mode": mode, "mtime": mtime}
        if kind == 1:
            info["dir"], _, info["size"], info["at"], _ = struct.unpack("<IIHHI", rest(16))
        elif kind == 8:
            _, info["size"], info["dir"], _, _, info["at"], _ = struct.unpack("<IIIIHHI", rest(24))
        elif base == 2:
            if kind == 2:
                info["start"], info["frag"], info["off"], info["size"] = struct.unpack("<IIII", rest(16))
                head = 16
            else:
                info["start"], info["size"], _, _, info["frag"], info["off"], _ = struct.unpack("<QQQIIII", rest(40))
                head = 40
            n = info["size"] // block if info["frag"] != 0xFFFFFFFF else -(-info["size"] // block)
            if n > len(buf):
                raise corrupt("squashfs file size")
            info["blocks"] = struct.unpack(f"<{n}I", rest(4 * n, head))
        elif base == 3:
            _, n = struct.unpack("<II", rest(8))
            if n > 65536:
                raise corrupt("squashfs link")
            info["link"] = rest(n, 8)
        return info

    def fragment(i: int) -> bytes:
        if i >= n_frag:
            raise corrupt("squashfs fragment")
        start, = struct.unpack_from("<Q", buf, frag_at + 8 * (i // 512))
        where, size, _ = struct.unpack("<QII", take(start, 16 * (i % 512), 16))
        return data(where, size, block)

    def data(where: int, size: int, most: int) -> bytes:
        n = size & 0xFFFFFF
        raw = buf[where : where + n]
        if len(raw) < n:
            raise corrupt("squashfs block is out of bounds")
        return raw if size & 1 << 24 else unpack(raw, most)

    def body(info):
        def read() -> bytes:
            out, where, left = [], info["start"], info["size"]
            for size in info["blocks"]:
                n = min(block, left)
                out.append(data(where, size, block) if size & 0xFFFFFF else bytes(n))
                where, left = where + (size & 0xFFFFFF), left - n
            if left and info["frag"] != 0xFFFFFFFF:
                out.append(fragment(info["frag"])[info["off"] : info["off"] + left])
            whole = b"".join(out)
            if len(whole) != info["size"]:
                raise corrupt("squashfs file has another size")
            return whole

        return read

    entries, seen = [], set()

    def walk(ref: int, above: str, depth: int) -> None:
        info = inode(ref)
        if info["kind"] != 1 or ref in seen or depth > 256:
            return
        seen.add(ref)
        size, at = info["size"] - 3, 0
        raw = take(dir_at + info["dir"], info["at"], size) if size > 0 else b""
        while at + 12 <= len(raw):
            n, start, _ = struct.unpack_from("<III", raw, at)
            at += 12
            for _ in range(n + 1):
                if at + 8 > len(raw):
                    raise corrupt("squashfs directory")
                offset, _, _, k = struct.unpack_from("<HhHH", raw, at)
                own = raw[at + 8 : at + 9 + k]
                at += 9 + k
                child = start << 16 | offset
                i = inode(child)
                path = (above + "/" if above else "") + own.decode("utf-8", "replace")
                kind = {1: DIR, 2: FILE, 3: SYMLINK}.get(i["kind"])
                if kind is None:
                    continue
                e = Entry(path.encode(), path=path, kind=kind, mode=i["mode"], modified=times.unix_or_none(i["mtime"]))
                if kind == FILE:
                    e.size, e.read = i["size"], body(i)
                elif kind == SYMLINK:
                    e.link_target = i["link"].decode("utf-8", "replace")
                entries.append(e)
                if kind == DIR:
                    walk(child, path, depth + 1)

    try:
        walk(root, "", 0)
    except struct.error as e:
        raise corrupt(str(e)) from None
    return Archive("Squashfs", entries)


# WIM

_SPANNED, _COMPRESSED, _XPRESS, _LZX, _LZMS = 0x8, 0x2, 0x20000, 0x40000, 0x80000


def _resource(raw: bytes) -> tuple[int, int, int, int]:
    """(size on disk, flags, offset, original size)"""
    word, offset, original = struct.unpack("<QQQ", raw)
    return word & (1 << 56) - 1, word >> 56, offset, original


def open_wim(buf: bytes, name: str, options: Options) -> Archive:
    if buf[:8] != b"MSWIM\0\0\0" or len(buf) < 208:
        raise corrupt("wim header")
    flags, chunk = struct.unpack_from("<II", buf, 16)
    part, parts, images = struct.unpack_from("<HHI", buf, 40)
    if flags & _SPANNED or parts > 1:
        raise unsupported("image in several parts")
    how = None
    if flags & _COMPRESSED:
        found = [k for k in (_XPRESS, _LZX, _LZMS) if flags & k]
        if len(found) != 1:
            raise corrupt("wim compression")
        how = found[0]
        if not chunk:
            raise corrupt("wim chunk size")

    def read(resource) -> bytes:
        size, own, offset, original = resource
        if offset + size > len(buf):
            raise corrupt("wim resource is out of bounds")
        raw = buf[offset : offset + size]
        if not own & 4 or how is None:
            return raw[:original]
        n = -(-original // chunk)
        width = 4 if original < 0xFFFFFFFF else 8
        table = width * (n - 1) if n else 0
        if table > len(raw):
            raise corrupt("wim chunk table")
        starts = [0, *struct.unpack(f"<{max(n - 1, 0)}{'I' if width == 4 else 'Q'}", raw[:table]), len(raw) - table]
        out = []
        for i in range(n):
            part, want = raw[table + starts[i] : table + starts[i + 1]], min(chunk, original - i * chunk)
            if starts[i + 1] < starts[i]:
                raise corrupt("wim chunk table")
            if len(part) == want:
                out.append(part)
            elif how == _XPRESS:
                out.append(xpress_huffman(part, want))
            elif how == _LZX:
                out.append(Lzx(max(chunk.bit_length() - 1, 15), wim=True).frame(part, want))
            else:
                raise unsupported("LZMS compression")
        return b"".join(out)

    table = read(_resource(buf[48:72]))
    if len(table) % 50:
        raise corrupt("wim lookup table")
    bodies, metadata = {}, None
    for i in range(0, len(table), 50):
        resource = _resource(table[i : i + 24])
        if resource[1] & 2:
            metadata = metadata or resource
        else:
            bodies[table[i + 30 : i + 50]] = resource
    if metadata is None:
        raise corrupt("wim without an image")
    tree = read(metadata)
    if len(tree) < 8:
        raise corrupt("wim metadata")
    security, = struct.unpack_from("<I", tree)
    start = max(security, 8) + -max(security, 8) % 8
    entries, seen = [], set()

    def walk(at: int, above: str, depth: int, root: bool = False) -> None:
        if at in seen or depth > 256:
            raise corrupt("wim directory")
        seen.add(at)
        while at + 8 <= len(tree):
            n, = struct.unpack_from("<Q", tree, at)
            if n <= 8:
                return
            if at + 0x66 > len(tree) or n < 0x66:
                raise corrupt("wim directory entry")
            attributes, = struct.unpack_from("<I", tree, at + 8)
            sub, = struct.unpack_from("<Q", tree, at + 16)
            stamp, = struct.unpack_from("<Q", tree, at + 0x38)
            digest = tree[at + 0x40 : at + 0x54]
            streams, short, k = struct.unpack_from("<HHH", tree, at + 0x60)
            raw = tree[at + 0x66 : at + 0x66 + k]
            try:
                own = raw.decode("utf-16-le")
            except UnicodeDecodeError:
                raise corrupt("wim name") from None
            folder = bool(attributes & 0x10)
            if root:
                if sub:
                    walk(sub, "", depth + 1)
                return
            path = f"{above}/{own}" if above else own
            e = Entry(path.encode(), path=path, kind=DIR if folder else FILE, modified=times.filetime(stamp))
            after = at + n + -n % 8
            for _ in range(streams):  # further streams stand behind; an unnamed one is the body
                m, = struct.unpack_from("<Q", tree, after)
                if m < 38:
                    break
                if not struct.unpack_from("<H", tree, after + 36)[0] and not any(digest):
                    digest = tree[after + 16 : after + 36]
                after += m + -m % 8
            if not folder and any(digest):
                if digest not in bodies:
                    raise corrupt("wim body is missing")
                e.size, e.read = bodies[digest][3], lambda r=bodies[digest]: read(r)
            entries.append(e)
            if folder and sub:
                walk(sub, path, depth + 1)
            at = after

    try:
        walk(start, "", 0, True)
    except struct.error as e:
        raise corrupt(str(e)) from None
    return Archive("Wim", entries)


# HFS+


def is_hfs(buf: bytes) -> bool:
    return buf[1024:1026] in (b"H+", b"HX")


class _Hfs:
    def __init__(self, buf: bytes):
        self.buf = buf
        if not is_hfs(buf) or len(buf) < 1536:
            raise unknown("no volume signature")
        self.block, = struct.unpack_from(">I", buf, 1024 + 40)
        if self.block < 512 or self.block & self.block - 1:
            raise corrupt("HFS+ block size")
        self.overflow: dict[tuple[int, int], list] = {}
        over = self.fork(buf[1024 + 192 : 1024 + 272], 3)
        for key, body in self.leaves(over):
            fork, _, cnid, start = struct.unpack_from(">BBII", key)
            self.overflow.setdefault((cnid, fork), []).append((start, body[:64]))
        self.catalog = self.fork(buf[1024 + 272 : 1024 + 352], 4)
        self.attributes = {}
        raw = self.fork(buf[1024 + 352 : 1024 + 432], 8)
        for key, body in self.leaves(raw) if raw else ():
            _, cnid, _, n = struct.unpack_from(">HIIH", key)
            kind, = struct.unpack_from(">I", body)
            if kind == 0x10:
                size, = struct.unpack_from(">I", body, 12)
                self.attributes[cnid, key[12 : 12 + 2 * n].decode("utf-16-be", "replace")] = body[16 : 16 + size]

    def fork(self, raw: bytes, cnid: int, which: int = 0) -> bytes:
        size, _, total = struct.unpack_from(">QII", raw)
        if size > len(self.buf):
            raise corrupt("HFS+ fork is out of bounds")
        parts = [raw[16:80], *(x for _, x in sorted(self.overflow.get((cnid, which), [])))]
        out, have = [], 0
        for extents in parts:
            for i in range(0, 64, 8):
                start, n = struct.unpack_from(">II", extents, i)
                if n and have < size:
                    out.append(self.buf[start * self.block : (start + n) * self.block])
                    have += len(out[-1])
        whole = b"".join(out)[:size]
        if len(whole) < size:
            raise corrupt("HFS+ fork is cut short")
        return whole

    def leaves(self, tree: bytes):
        if len(tree) < 48:
            return
        first, = struct.unpack_from(">I", tree, 14 + 10)
        size, = struct.unpack_from(">H", tree, 14 + 18)
        if size < 512:
            raise corrupt("HFS+ node size")
        node, seen = first, set()
        while node:
            if node in seen or (node + 1) * size > len(tree):
                raise corrupt("HFS+ tree")
            seen.add(node)
            raw = tree[node * size : (node + 1) * size]
            following, _, kind, _, n = struct.unpack_from(">IIbBH", raw)
            if kind == -1:
                for i in range(n):
                    at, = struct.unpack_from(">H", raw, size - 2 * (i + 1))
                    k, = struct.unpack_from(">H", raw, at)
                    body = at + 2 + k + (k & 1)
                    yield raw[at + 2 : at + 2 + k], raw[body:]
            node = following


def _decmpfs(header: bytes, resource) -> tuple[int, object]:
    magic, kind, size = struct.unpack_from("<4sIQ", header)

    def read() -> bytes:
        inline = header[16:]
        if kind == 1:
            return inline[:size]
        if kind == 3:
            return inline[1:] if inline[:1] and inline[0] & 15 == 15 else zlib.decompress(inline)
        if kind == 4:
            raw = resource()
            at, = struct.unpack_from(">I", raw)
            at += 4
            n, = struct.unpack_from("<I", raw, at)
            out = []
            for i in range(n):
                off, length = struct.unpack_from("<II", raw, at + 4 + 8 * i)
                part = raw[at + off : at + off + length]
                out.append(part[1:] if part[0] & 15 == 15 else zlib.decompress(part))
            return b"".join(out)
        if kind in (7, 11):
            return inline[1 : 1 + size] if inline[:1] == b"\x06" else _apple(kind, inline, size)
        if kind in (8, 12):
            raw = resource()
            n, = struct.unpack_from("<I", raw)
            places = struct.unpack_from(f"<{n // 4}I", raw)
            out = []
            for i, (start, end) in enumerate(zip(places, places[1:])):
                part, want = raw[start:end], min(65536, size - 65536 * i)
                if want <= 0:
                    break
                out.append(part[1 : 1 + want] if part[:1] == b"\x06" else _apple(kind, part, want))
            return b"".join(out)
        raise unsupported(f"file compression {kind}")

    return size, read


def _apple(kind: int, raw: bytes, size: int) -> bytes:
    return lzvn(raw, size) if kind in (7, 8) else lzfse(raw)


def open_hfs(buf: bytes, name: str, options: Options, format: str = "HfsPlus") -> Archive:
    try:
        volume = _Hfs(buf)
        children: dict[int, list] = {}
        for key, body in volume.leaves(volume.catalog):
            parent, n = struct.unpack_from(">IH", key)
            kind, = struct.unpack_from(">H", body)
            if kind in (1, 2):
                own = key[6 : 6 + 2 * n].decode("utf-16-be", "replace").replace("/", ":")
                children.setdefault(parent, []).append((own, kind, body))
    except struct.error as e:
        raise corrupt(str(e)) from None
    entries, seen = [], set()

    def walk(folder: int, above: str, depth: int) -> None:
        if folder in seen or depth > 256:
            raise corrupt("HFS+ folders go in circles")
        seen.add(folder)
        for own, kind, body in children.get(folder, ()):
            if own.startswith("\0"):
                continue
            path = f"{above}/{own}" if above else own
            _, cnid, _, modified = struct.unpack_from(">IIII", body, 4) if kind == 1 else struct.unpack_from(">IIII", body, 4)
            e = Entry(path.encode(), path=path, kind=DIR if kind == 1 else FILE, modified=times.mac(modified))
            if kind == 2:
                data, resource = body[88:168], body[168:248]
                mode, = struct.unpack_from(">H", body, 32 + 10)
                e.size, = struct.unpack_from(">Q", data)
                e.read = lambda d=data, c=cnid: volume.fork(d, c)
                packed = volume.attributes.get((cnid, "com.apple.decmpfs"))
                if packed and len(packed) >= 16:
                    e.size, e.read = _decmpfs(packed, lambda r=resource, c=cnid: volume.fork(r, c, 0xFF))
                if mode & 0o170000 == 0o120000:
                    e.kind, e.link_target, e.size, e.read = SYMLINK, e.read().decode("utf-8", "replace"), 0, None
            entries.append(e)
            if kind == 1:
                walk(cnid, path, depth + 1)

    walk(2, "", 0)
    return Archive(format, entries)


# DMG


def koly(buf: bytes) -> bool:
    return len(buf) >= 512 and buf[-512:-508] == b"koly"


#: Most of an image that is put together.
MAX_IMAGE = 4 << 30


def dmg_chunks(buf: bytes) -> list[tuple[int, int, int, int, int]]:
    """(type, first sector, sectors, offset, length) of all chunks of all tables."""
    trailer = buf[-512:]
    data_at, = struct.unpack_from(">Q", trailer, 0x18)
    xml_at, xml_size = struct.unpack_from(">QQ", trailer, 0xD8)
    if xml_at + xml_size > len(buf):
        raise corrupt("property list is out of bounds")
    xml = buf[xml_at : xml_at + xml_size]
    from .packs import MAX_DEPTH, exceeds_depth

    if exceeds_depth(xml, MAX_DEPTH):
        raise corrupt("property list is too deep")
    try:
        tables = plistlib.loads(xml)["resource-fork"]["blkx"]
    except Exception as e:
        raise corrupt(f"property list: {e}") from None
    out = []
    for t in tables:
        mish = t.get("Data", b"")
        if isinstance(mish, str):
            mish = base64.b64decode(mish)
        if mish[:4] != b"mish" or len(mish) < 0xCC:
            raise corrupt("chunk table")
        first, _, at = struct.unpack_from(">QQQ", mish, 8)
        n, = struct.unpack_from(">I", mish, 0xC8)
        if 0xCC + 40 * n > len(mish):
            raise corrupt("chunk table is cut short")
        for i in range(n):
            kind, _, sector, count, offset, length = struct.unpack_from(">IIQQQQ", mish, 0xCC + 40 * i)
            out.append((kind, first + sector, count, data_at + at + offset, length))
    return out


def dmg_image(buf: bytes) -> bytes:
    chunks = dmg_chunks(buf)
    size = max((s + n for _, s, n, _, _ in chunks), default=0) * 512
    if size > MAX_IMAGE:
        raise corrupt("disk image is too large")
    image = bytearray(size)
    for kind, sector, count, offset, length in chunks:
        if kind in (0, 2, 0x7FFFFFFE, 0xFFFFFFFF):  # zeros, nothing, comment, end
            continue
        if offset + length > len(buf):
            raise corrupt("chunk is out of bounds")
        raw, want = buf[offset : offset + length], count * 512
        try:
            if kind == 1:
                part = raw
            elif kind == 0x80000004:
                part = adc(raw, want)
            elif kind == 0x80000005:
                part = zlib.decompress(raw)
            elif kind == 0x80000006:
                part = bz2.decompress(raw)
            elif kind == 0x80000007:
                part = lzfse(raw)
            elif kind == 0x80000008:
                part = lzma.decompress(raw)
            else:
                raise unsupported(f"chunk type {kind:#x}")
        except (zlib.error, OSError, ValueError, lzma.LZMAError) as e:
            raise corrupt(str(e)) from None
        if len(part) != want:
            raise corrupt("chunk has another size")
        image[sector * 512 : sector * 512 + want] = part
    return bytes(image)


def open_dmg(buf: bytes, name: str, options: Options) -> Archive:
    """The first volume of the image that can be read."""
    from .apfs import is_apfs, open_apfs

    image = dmg_image(buf) if koly(buf) else buf
    if is_hfs(image):
        return open_hfs(image, name, options, "Dmg")
    if is_apfs(image):
        return Archive("Dmg", open_apfs(image, name, options).entries)
    at = image.find(b"NXSB")
    while at >= 0:
        if at % 512 == 32:
            return Archive("Dmg", open_apfs(image[at - 32 :], name, options).entries)
        at = image.find(b"NXSB", at + 1)
    for mark in (b"H+", b"HX"):
        at = image.find(mark)
        while at >= 0:
            if at % 512 == 0 and at >= 1024 and image[at + 2 : at + 4] in (b"\0\4", b"\0\5"):
                return open_hfs(image[at - 1024 :], name, options, "Dmg")
            at = image.find(mark, at + 1)
    raise unsupported("file system of the disk image")
