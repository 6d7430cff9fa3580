"""APFS containers: the first volume, from its published on-disk format."""

from __future__ import annotations

import struct
import zlib

from ..errors import corrupt, unknown, unsupported
from ..schema import DIR, FILE, SYMLINK, Archive, Entry, Options
from .times import NS

MAX_DEPTH, MAX_ENTRIES = 256, 1_000_000


def is_apfs(buf: bytes) -> bool:
    return buf[32:36] == b"NXSB"


class _Container:
    def __init__(self, buf: bytes):
        if not is_apfs(buf) or len(buf) < 4096:
            raise unknown("no container signature")
        self.buf = buf
        self.block, = struct.unpack_from("<I", buf, 36)
        if self.block < 4096 or self.block > 65536 or self.block & self.block - 1:
            raise corrupt("APFS block size")
        best = self.at(0)
        n, = struct.unpack_from("<I", best, 104)
        base, = struct.unpack_from("<Q", best, 112)
        for i in range(n & 0x7FFFFFFF):  # the checkpoint of the highest transaction holds
            if (base + i + 1) * self.block > len(buf):
                break
            b = self.at(base + i)
            if b[32:36] == b"NXSB" and struct.unpack_from("<Q", b, 16) > struct.unpack_from("<Q", best, 16):
                best = b
        omap, = struct.unpack_from("<Q", best, 160)
        volumes = [v for v in struct.unpack_from("<100Q", best, 184) if v]
        if not volumes:
            raise corrupt("APFS container without a volume")
        where = self.objects(omap)
        self.volume = self.at(self.find(where, volumes[0]))
        if self.volume[32:36] != b"APSB":
            raise corrupt("APFS volume")
        v_omap, root = struct.unpack_from("<QQ", self.volume, 128)
        self.map = self.objects(v_omap)
        self.insensitive = struct.unpack_from("<Q", self.volume, 56)[0] & 9 != 0
        self.root = root

    def at(self, i: int) -> bytes:
        out = self.buf[i * self.block : (i + 1) * self.block]
        if len(out) < self.block:
            raise corrupt("APFS block is out of bounds")
        return out

    @staticmethod
    def find(where: dict, oid: int) -> int:
        if oid not in where:
            raise corrupt("APFS object is missing")
        return where[oid]

    def objects(self, at: int) -> dict[int, int]:
        """Block of each object's last version."""
        tree, = struct.unpack_from("<Q", self.at(at), 48)
        out: dict[int, tuple[int, int]] = {}
        for key, value in self.records(tree, None, 16, 16):
            oid, xid = struct.unpack_from("<QQ", key)
            _, _, block = struct.unpack_from("<IIQ", value)
            if oid not in out or xid >= out[oid][0]:
                out[oid] = xid, block
        return {k: v for k, (_, v) in out.items()}

    def records(self, root: int, where: dict | None, key_size: int = 0, value_size: int = 0):
        stack, seen = [root], set()
        while stack:
            i = stack.pop()
            if i in seen:
                raise corrupt("APFS tree goes in circles")
            seen.add(i)
            b = self.at(i)
            flags, level, n, table, length = struct.unpack_from("<HHIHH", b, 32)
            keys = 56 + table + length
            end = self.block - (40 if flags & 1 else 0)
            children = []
            for k in range(n):
                if flags & 4:
                    ko, vo = struct.unpack_from("<HH", b, 56 + table + 4 * k)
                    kl, vl = key_size, value_size if flags & 2 else 8
                else:
                    ko, kl, vo, vl = struct.unpack_from("<HHHH", b, 56 + table + 8 * k)
                key, value = b[keys + ko : keys + ko + kl], b[end - vo : end - vo + vl]
                if flags & 2:
                    yield key, value
                else:
                    child, = struct.unpack_from("<Q", value)
                    children.append(child if where is None else self.find(where, child))
            stack += children[::-1]


def open_apfs(buf: bytes, name: str, options: Options) -> Archive:
    try:
        box = _Container(buf)
        inodes, names, extents, attributes = {}, {}, {}, {}
        for key, value in box.records(box.find(box.map, box.root), box.map):
            word, = struct.unpack_from("<Q", key)
            oid, kind = word & (1 << 60) - 1, word >> 60
            if kind == 3:
                inodes[oid] = value
            elif kind == 9:
                at = 12 if box.insensitive else 10
                child, = struct.unpack_from("<Q", value)
                names.setdefault(oid, []).append((key[at:].split(b"\0")[0], child))
            elif kind == 8:
                logical, = struct.unpack_from("<Q", key, 8)
                length, physical = struct.unpack_from("<QQ", value)
                extents.setdefault(oid, []).append((logical, length & (1 << 56) - 1, physical))
            elif kind == 4:
                flags, n = struct.unpack_from("<HH", value)
                attributes[oid, key[10:].split(b"\0")[0].decode("utf-8", "replace")] = (flags, value[4 : 4 + n])
    except struct.error as e:
        raise corrupt(str(e)) from None

    def stream(owner: int, size: int) -> bytes:
        out = bytearray(size)
        for logical, length, physical in extents.get(owner, ()):
            if physical:
                part = buf[physical * box.block : physical * box.block + length][: max(size - logical, 0)]
                out[logical : logical + len(part)] = part
        return bytes(out)

    def attribute(oid: int, own: str) -> bytes | None:
        if (oid, own) not in attributes:
            return None
        flags, raw = attributes[oid, own]
        if flags & 1:
            owner, size = struct.unpack_from("<QQ", raw)
            return stream(owner, size)
        return raw

    def inode(oid: int):
        value = inodes.get(oid)
        if value is None or len(value) < 92:
            raise corrupt("APFS inode is missing")
        _, private, _, modified = struct.unpack_from("<QQQQ", value)
        mode, = struct.unpack_from("<H", value, 80)
        size, fields = 0, value[92:]
        if len(fields) >= 4:
            n, _ = struct.unpack_from("<HH", fields)
            at = 4 + 4 * n
            for k in range(n):
                kind, _, length = struct.unpack_from("<BBH", fields, 4 + 4 * k)
                if kind == 8:
                    size, = struct.unpack_from("<Q", fields, at)
                at += length + -length % 8
        return private, modified, mode, size

    entries, seen = [], set()

    def walk(folder: int, above: str, depth: int) -> None:
        if folder in seen or depth > MAX_DEPTH:
            raise corrupt("APFS folders go in circles")
        seen.add(folder)
        for raw, child in sorted(names.get(folder, ())):
            if len(entries) >= MAX_ENTRIES:
                raise corrupt("too many entries")
            own = raw.decode("utf-8", "replace")
            path = f"{above}/{own}" if above else own
            private, modified, mode, size = inode(child)
            what = mode & 0o170000
            e = Entry(path.encode(), path=path, kind=DIR if what == 0o040000 else FILE, modified=modified or None)
            if what == 0o120000:
                e.kind, e.link_target = SYMLINK, (attribute(child, "com.apple.fs.symlink") or b"").rstrip(b"\0").decode("utf-8", "replace")
            elif what == 0o100000:
                e.size, e.read = size, lambda o=private, n=size: stream(o, n)
                packed = attribute(child, "com.apple.decmpfs")
                if packed and len(packed) >= 16:
                    from .images import _decmpfs

                    e.size, e.read = _decmpfs(packed, lambda c=child: attribute(c, "com.apple.ResourceFork") or b"")
            entries.append(e)
            if e.kind == DIR:
                walk(child, path, depth + 1)

    try:
        walk(2, "", 0)
    except (struct.error, zlib.error) as e:
        raise corrupt(str(e)) from None
    if not entries and not names:
        raise unsupported("volume without folders")
    return Archive("Apfs", entries)
