"""A container of one volume, written by hand from the published layout."""

import struct

import pytest

from coffer.errors import ArchiveError
from coffer.sources import detect

BLOCK = 4096


def node(records, fixed, leaf=True, root=True, oid=0):
    """A tree node; keys grow up from the table, values down from the end."""
    flags = (1 if root else 0) | (2 if leaf else 0) | (4 if fixed else 0)
    b = bytearray(BLOCK)
    table = len(records) * (4 if fixed else 8)
    struct.pack_into("<Q", b, 8, oid)
    struct.pack_into("<HHIHH", b, 32, flags, 0 if leaf else 1, len(records), 0, table)
    key_at, value_at = 56 + table, BLOCK - (40 if root else 0)
    ko = vo = 0
    for i, (key, value) in enumerate(records):
        b[key_at + ko : key_at + ko + len(key)] = key
        vo += len(value)
        b[value_at - vo : value_at - vo + len(value)] = value
        if fixed:
            struct.pack_into("<HH", b, 56 + 4 * i, ko, vo)
        else:
            struct.pack_into("<HHHH", b, 56 + 8 * i, ko, len(key), vo, len(value))
        ko += len(key)
    return bytes(b)


def omap(tree, oid):
    b = bytearray(BLOCK)
    struct.pack_into("<Q", b, 8, oid)
    struct.pack_into("<Q", b, 48, tree)
    return bytes(b)


def inode(private, mode, size=None, modified=1600000000123456789):
    b = bytearray(92)
    struct.pack_into("<QQQQ", b, 0, 0, private, 0, modified)
    struct.pack_into("<H", b, 80, mode)
    if size is not None:
        b += struct.pack("<HH", 1, 40) + struct.pack("<BBH", 8, 0, 40) + struct.pack("<QQQQQ", size, size, 0, 0, 0)
    return bytes(b)


def key(oid, kind, rest=b""):
    return struct.pack("<Q", oid | kind << 60) + rest


def named(parent, name):
    raw = name.encode() + b"\0"
    return key(parent, 9, struct.pack("<H", len(raw)) + raw)


def container():
    body = b"hello apfs " * 500
    records = [
        (key(2, 3), inode(2, 0o040755)),
        (named(2, "a.txt"), struct.pack("<QQH", 16, 0, 8)), (named(2, "d"), struct.pack("<QQH", 17, 0, 4)), (named(2, "link"), struct.pack("<QQH", 18, 0, 10)),
        (key(16, 3), inode(16, 0o100644, len(body))), (key(16, 8, struct.pack("<Q", 0)), struct.pack("<QQQ", 8192, 8, 0)),
        (key(17, 3), inode(17, 0o040755)), (named(17, "empty"), struct.pack("<QQH", 19, 0, 8)),
        (key(18, 3), inode(18, 0o120755)), (key(18, 4, struct.pack("<H", 21) + b"com.apple.fs.symlink\0"), struct.pack("<HH", 2, 6) + b"a.txt\0"),
        (key(19, 3), inode(19, 0o100600, 0)),
    ]
    box = bytearray(BLOCK)
    struct.pack_into("<QQ", box, 8, 1, 5)
    box[32:36] = b"NXSB"
    struct.pack_into("<I", box, 36, BLOCK)
    struct.pack_into("<Q", box, 160, 1)
    struct.pack_into("<Q", box, 184, 1026)
    volume = bytearray(BLOCK)
    volume[32:36] = b"APSB"
    struct.pack_into("<QQ", volume, 128, 4, 1030)
    blocks = [
        bytes(box), omap(2, 1), node([(struct.pack("<QQ", 1026, 5), struct.pack("<IIQ", 0, BLOCK, 3)), (struct.pack("<QQ", 1026, 4), struct.pack("<IIQ", 0, BLOCK, 99))], True),
        bytes(volume), omap(5, 4), node([(struct.pack("<QQ", 1030, 5), struct.pack("<IIQ", 0, BLOCK, 6))], True), node(records, False), bytes(BLOCK),
        body[:BLOCK], body[BLOCK:].ljust(BLOCK, b"\0"),
    ]
    return b"".join(blocks), body


def test_apfs():
    raw, body = container()
    a = detect.open_archive("x.img", raw)
    assert a.format == "Apfs"
    assert [(e.path, e.kind, e.link_target, e.size) for e in a.entries] == [("a.txt", "File", None, len(body)), ("d", "Dir", None, 0), ("d/empty", "File", None, 0), ("link", "Symlink", "a.txt", 0)]
    assert a.body(0) == body and a.body(2) == b"" and a.entries[0].modified == 1600000000123456789
    assert detect.open_archive("x.dmg", raw).format == "Dmg"
    for cut in (5000, 9000, 20000):
        with pytest.raises(ArchiveError):
            detect.open_archive("x.img", raw[:cut])
