"""Every reader on archives made here or by hand: listing, bodies, and clean errors on broken ones."""

import bz2
import hashlib
import io
import lzma
import struct
import subprocess
import zipfile
import zlib
from shutil import which

import pytest

from coffer.errors import ArchiveError
from coffer.schema import DIR, SYMLINK, Options
from coffer.sources import ciphers, codecs, detect, names, packs, times
from coffer.sources.legacy import decoders
from coffer.testing import pack

FILES = [("dir/a.txt", b"hello"), ("dir/sub/b.txt", b"nested!" * 3000), ("c.bin", bytes(range(256)) * 300)]


def listing(name, raw, **options):
    a = detect.open_archive(name, raw, Options(**options))
    return a, {e.path: a.body(i) for i, e in enumerate(a.entries) if e.kind == "File"}


WRITERS = {
    "x.zip": (pack.zip_bytes, "Zip"), "x.jar": (pack.zip_bytes, "Jar"), "x.crx": (pack.crx_bytes, "Crx"), "y.crx": (lambda f: pack.crx_bytes(f, 2), "Crx"),
    "x.tar": (pack.tar_bytes, "Tar"), "x.cpio": (pack.cpio_bytes, "Cpio"), "x.a": (pack.ar_bytes, "Ar"), "x.deb": (pack.deb_bytes, "Deb"), "x.rpm": (pack.rpm_bytes, "Rpm"),
    "x.xar": (pack.xar_bytes, "Xar"), "x.cab": (pack.cab_bytes, "Cab"), "y.cab": (lambda f: pack.cab_bytes(f, False), "Cab"), "x.wim": (pack.wim_bytes, "Wim"),
    "x.7z": (pack.sevenz_bytes, "SevenZ"), "y.7z": (lambda f: pack.sevenz_bytes(f, False), "SevenZ"), "x.rar": (pack.rar_bytes, "Rar"), "x.iso": (lambda f: pack.iso_bytes([(n.replace("/sub/", "-sub-"), b) for n, b in f]), "Iso"),
    "x.conda": (lambda f: pack.conda_bytes(f[:1], f[1:]), "Conda"), "x.exe": (lambda f: pack.sfx_bytes(pack.zip_bytes(f)), "Zip"),
}


@pytest.mark.parametrize("name", WRITERS)
def test_round_trip(name):
    writer, format = WRITERS[name]
    raw = writer(FILES)
    a, bodies = listing(name, raw)
    assert a.format == format and sorted(bodies.values()) == sorted(b for _, b in FILES) and (format == "Iso" or bodies == dict(FILES))
    for bad in (-1, len(a.entries)):
        with pytest.raises(ArchiveError) as e:
            a.body(bad)
        assert e.value.kind == "INVALID_INDEX"


@pytest.mark.parametrize("name", [*WRITERS, "x.tar.gz", "x.warc", "x.dmg", "x.sqfs", "x.zoo"])
def test_mapped_files(tmp_path, name):
    from pyarrow import fs

    from coffer.sources import scan

    own = {"x.tar.gz": lambda f: pack.compress(pack.tar_bytes(f), "Gzip"), "x.warc": lambda f: pack.warc_bytes([("resource", f"a://{n}", b) for n, b in f]), "x.dmg": lambda f: pack.dmg_bytes(pack.hfs_bytes(f)), "x.sqfs": lambda f: pack.squashfs_bytes([(n.replace("/", "-"), b) for n, b in f]), "x.zoo": pack.zoo_bytes}
    raw = (own[name] if name in own else WRITERS[name][0])(FILES)
    (tmp_path / name).write_bytes(raw)
    mapped = scan.load(fs.LocalFileSystem(), str(tmp_path / name), True)
    plain = listing(name, raw)[1]
    assert not isinstance(mapped, bytes) and plain and listing(name, mapped)[1] == plain
    (tmp_path / "none").write_bytes(b"")
    assert scan.load(fs.LocalFileSystem(), str(tmp_path / "none"), True) == b""


class Remote:
    """A store that says which bytes were read."""

    type_name = "remote"

    def __init__(self, raw):
        self.raw, self.read = raw, 0

    def open_input_file(self, path):
        return self

    def __enter__(self):
        return self

    def __exit__(self, *a):
        pass

    def size(self):
        return len(self.raw)

    def read_at(self, n, at):
        self.read += n
        return self.raw[at : at + n]


@pytest.mark.parametrize("name, writer", [("x.zip", lambda f: pack.zip_bytes(f, zipfile.ZIP_STORED)), ("x.7z", lambda f: pack.sevenz_bytes(f, False)), ("x.tar", pack.tar_bytes)])
def test_listing_reads_the_index(name, writer):
    from coffer.sources import scan

    files = [(f"d/{i}.bin", bytes([i]) * 300_000) for i in range(20)]
    raw = writer(files)
    store = Remote(raw)
    found = scan.load(store, name, True)
    entries = lambda a: [(e.path, e.size, e.kind, e.modified, e.mode) for e in a.entries]
    assert entries(detect.open_archive(name, found)) == entries(detect.open_archive(name, raw))
    assert store.read < 100_000 if name != "x.tar" else found == raw
    store = Remote(raw)
    assert scan.load(store, name, False) == raw and store.read == len(raw)
    # Links are read from bodies, so all bytes are wanted.
    if name == "x.zip":
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("big", bytes(3_000_000))
            info = zipfile.ZipInfo("link")
            info.external_attr = 0o120777 << 16
            z.writestr(info, "big")
        assert scan.load(Remote(out.getvalue()), name, True) == out.getvalue()


@pytest.mark.parametrize("name", WRITERS)
def test_broken_archives_fail_cleanly(name):
    raw = WRITERS[name][0](FILES)
    for cut in (1, 13, len(raw) // 3, len(raw) // 2, len(raw) - 9):
        for broken in (raw[:cut], raw[:cut] + b"\xff" * 40 + raw[cut + 40 :]):
            try:
                a = detect.open_archive(name, broken)
                for i in range(len(a.entries)):
                    a.body(i)
            except ArchiveError:
                pass


@pytest.mark.parametrize("kind,ext", [("Gzip", "gz"), ("Bzip2", "bz2"), ("Xz", "xz"), ("Zstd", "zst"), ("Lz4", "lz4"), ("Brotli", "br"), ("Lzc", "Z")])
def test_compressed(kind, ext):
    a, bodies = listing(f"t.tar.{ext}", pack.compress(pack.tar_bytes(FILES), kind))
    assert a.format == "Tar" and bodies == dict(FILES)
    a, bodies = listing(f"n.txt.{ext}", pack.compress(b"plain " * 999, kind, 1700000000))
    assert a.format == "Raw" and bodies == {"n.txt": b"plain " * 999}
    assert a.entries[0].modified == (1700000000 * 10**9 if kind == "Gzip" else None)


def test_codec_vectors():
    assert codecs.lzw(bytes.fromhex("1f9d1041840 0".replace(" ", ""))) == b"AB"
    assert codecs.gunzip(pack.compress(b"a", "Gzip") * 2) == b"aa"
    assert codecs.decompress(bz2.compress(b"a") * 2, "Bzip2") == b"a"
    assert codecs.decompress(lzma.compress(b"a") * 2, "Xz") == b"a"
    assert codecs.decompress(pack.compress(b"a", "Zstd") * 2, "Zstd") == b"aa"
    assert codecs.adc(b"\x82abc" + bytes([0x00 | (1 << 2), 0x02])) == b"abcabca"
    assert codecs.lz4_block(b"\x30abc\x03\x00\x00"[:1] + b"abc", 3) == b"abc"
    with pytest.raises(ArchiveError):
        codecs.decompress(pack.compress(b"abc" * 100, "Gzip")[:-9], "Gzip")
    text = b"a man a plan a canal " * 500
    assert pack.lzc(text)[:2] == b"\x1f\x9d" and codecs.lzw(pack.lzc(text * 40)) == text * 40


def test_block_codecs_by_hand():
    assert codecs.lzo(bytes([22]) + b"hello" + b"\x11\0\0") == b"hello"
    assert codecs.lzo(bytes([20]) + b"abc" + bytes([5 << 5 | 2 << 2, 0]) + b"\x11\0\0") == b"abcabcabc"
    lengths = [0] * 512
    for symbol in (ord("a"), ord("b"), ord("c"), 256 + 16 + 3):
        lengths[symbol] = 2
    table = bytes(lengths[i] | lengths[i + 1] << 4 for i in range(0, 512, 2))
    assert codecs.xpress_huffman(table + bytes.fromhex("801b0000"), 9) == b"abcabcabc"
    with pytest.raises(ArchiveError):
        codecs.xpress_huffman(table, 9)
    raw = bytes(range(100))
    bits = f"0{3:03b}{len(raw):024b}".ljust(32, "0")
    words = b"".join(int(bits[i : i + 16], 2).to_bytes(2, "little") for i in (0, 16))
    assert codecs.Lzx(15).frame(words + struct.pack("<III", 1, 1, 1) + raw, 100) == raw
    z = zlib.compressobj(9, zlib.DEFLATED, -15)  # short matches are alike in both deflates
    packed = z.compress(b"abcdefgh" * 5 + b"xyz") + z.flush()
    assert codecs.inflate64(packed, 43) == b"abcdefgh" * 5 + b"xyz"


def test_lzvn_and_lzfse():
    from coffer.sources.lzfse import _states, lzfse, lzvn

    raw = bytes([0xE3]) + b"abc" + bytes([3 << 3, 3]) + bytes([0xF4]) + bytes([0x40 | 7, 9, 0]) + b"z" + b"\x06" + bytes(7)
    # abc; six from three back; four more; then z and three from nine back.
    assert lzvn(bytes([0xE3]) + b"abc" + bytes([3 << 3, 3]) + bytes([0xF4]) + b"\x06" + bytes(7), 13) == (b"abc" * 5)[:13]
    assert lzvn(raw, 17) == (b"abc" * 5)[:13] + b"z" + ((b"abc" * 5)[:13] + b"z")[-9:][:3]
    assert lzvn(bytes([0xE0, 0]) + b"0123456789abcdef" + bytes([0xA0 | 1, 1 | 16 << 2 & 0xFF, 0]) + b"\x06", 24)[:16] == b"0123456789abcdef"
    body = bytes([0xE3]) + b"abc" + bytes([3 << 3, 3]) + b"\x06" + bytes(7)
    packed = b"bvx-" + struct.pack("<I", 2) + b"hi" + b"bvxn" + struct.pack("<II", 9, len(body)) + body + b"bvx$"
    assert lzfse(packed) == b"hi" + b"abc" * 3
    for cut in range(1, len(packed) - 1, 3):
        with pytest.raises(ArchiveError):
            lzfse(packed[:cut])
    # Every state of a table is reached from exactly one state of each symbol.
    for counts, total in (([3, 0, 5, 56], 64), ([1] * 64, 64), ([1000, 24], 1024)):
        table = _states(counts, total)
        assert len(table) == total
        for symbol in {t[2] for t in table}:
            reach = sorted(d + x for k, d, s in table if s == symbol for x in range(1 << k))
            assert reach == list(range(total))


def test_lzfse_block():
    """One block of literals a b a b and a match, coded by walking the tables back."""
    from coffer.sources.lzfse import _DISTANCE_BITS, _LITERAL_BITS, _MATCH_BITS, _bases, _states, lzfse

    literal = [0] * 256
    literal[97], literal[98] = 512, 512
    runs, lengths, distances = [0] * 20, [0] * 20, [0] * 64
    runs[4], lengths[6], distances[2] = 64, 64, 256  # a run of 4, a match of 6, two back
    assert (_bases(_LITERAL_BITS)[4], _bases(_MATCH_BITS)[6], _bases(_DISTANCE_BITS)[2]) == (4, 6, 2)

    def count(c):
        if c < 8:
            small = {0: ("0", 2, 0), 1: ("", 2, 2), 2: ("", 3, 1), 3: ("", 3, 5), 4: ("", 5, 3), 5: ("", 5, 11), 6: ("", 5, 19), 7: ("", 5, 27)}[c]
            return small[2], small[1]
        return (7 | (c - 8) << 4, 8) if c < 24 else (15 | (c - 24) << 4, 14)

    value = at = 0
    for c in [*runs, *lengths, *distances, *literal]:
        v, n = count(c)
        value |= v << at
        at += n
    table = value.to_bytes(-(-at // 8), "little")
    of = _states(literal, 1024)
    bits, first = "", []
    for k, symbol in enumerate(b"abab"):
        state = next(i for i, t in enumerate(of) if t[2] == symbol)
        first.append(state)
        bits += "0" * of[state][0]
    payload = lambda b: (int(b, 2) if b else 0).to_bytes(-(-len(b) // 8), "little")
    lack = lambda b: -(-len(b) % 8)
    literals = payload(bits)
    moves = "".join("0" * _states(c, n)[0][0] for c, n in ((runs, 64), (lengths, 64), (distances, 256)))
    matches = payload(moves)
    header = 32 + len(table)
    a = 4 | len(literals) << 20 | 1 << 40 | (lack(bits) + 7) << 60
    b = sum(s << 10 * k for k, s in enumerate(first)) | len(matches) << 40 | (lack(moves) + 7) << 60
    raw = b"bvx2" + struct.pack("<IQQQ", 10, a, b, header) + table + literals + matches + b"bvx$"
    assert lzfse(raw) == b"abab" + b"ab" * 3
    dmg = pack.dmg_bytes(b"", 1)
    assert dmg[-512:-508] == b"koly"


def test_old_decoders():
    assert decoders.rle90(b"a\x90\x04b\x90\x00") == b"aaaab\x90"
    tree = struct.pack("<H", 2) + struct.pack("<hhhh", -(ord("a") + 1), 1, -(ord("b") + 1), -257)
    assert decoders.unsqueeze(tree + bytes([0b11_01_0_0 << 0 | 0])) .startswith(b"") is True
    sq = b"\x76\xff" + struct.pack("<H", (ord("a") * 2) & 0xFFFF) + b"A.TXT\0" + tree + bytes([0b1100])
    a, bodies = listing("a.sq", sq)
    assert a.format == "Squeeze" and bodies == {"A.TXT": b"aa"}


def test_zip_symlink_and_modes():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        i = zipfile.ZipInfo("f.txt")
        i.external_attr = 0o100644 << 16
        z.writestr(i, b"hi")
        i = zipfile.ZipInfo("link")
        i.external_attr = 0o120777 << 16
        z.writestr(i, b"f.txt")
        z.writestr("d/", b"")
    a = detect.open_archive("x.zip", out.getvalue())
    assert [(e.kind, e.link_target) for e in a.entries] == [("File", None), (SYMLINK, "f.txt"), (DIR, None)]
    assert a.entries[0].mode == 0o644 and a.body(1) == b"f.txt"


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_zip_methods(method):
    assert listing("x.zip", pack.zip_bytes(FILES, method))[1] == dict(FILES)


def zip_with(method, data, body, flags=0, extra=b"", check=None):
    crc = zlib.crc32(body) if check is None else check
    name = b"a.txt"
    local = b"PK\3\4" + struct.pack("<HHHHHIIIHH", 20, flags, method, 0, 33, crc, len(data), len(body), len(name), len(extra)) + name + extra
    central = b"PK\1\2" + struct.pack("<HHHHHHIIIHHHHHII", 20, 20, flags, method, 0, 33, crc, len(data), len(body), len(name), len(extra), 0, 0, 0, 0, 0) + name + extra
    return local + data + central + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 1, 1, len(central), len(local) + len(data), 0)


def test_zip_passwords():
    body = b"hello zip " * 20
    locked = ciphers.ZipCrypto(b"pw").encrypt(bytes(11) + bytes([zlib.crc32(body) >> 24]) + body)
    raw = zip_with(0, locked, body, 1)
    assert listing("x.zip", raw, password="pw")[1] == {"a.txt": body}
    for password, kind in ((None, "ENCRYPTED"), ("no", "WRONG_PASSWORD")):
        a = detect.open_archive("x.zip", raw, Options(password))
        assert a.entries[0].encrypted
        with pytest.raises(ArchiveError) as e:
            a.verify()
        assert e.value.kind == kind
    import hmac

    salt = bytes(range(16))
    keys = hashlib.pbkdf2_hmac("sha1", b"secret", salt, 1000, 66)
    packed = ciphers.Aes(keys[:32]).ctr(body)
    data = salt + keys[64:] + packed + hmac.new(keys[32:64], packed, "sha1").digest()[:10]
    raw = zip_with(99, data, body, 1, struct.pack("<HHHHBH", 0x9901, 7, 2, 0x4541, 3, 0), check=0)
    assert listing("x.zip", raw, password="secret")[1] == {"a.txt": body}
    with pytest.raises(ArchiveError) as e:
        listing("x.zip", raw, password="no")
    assert e.value.kind == "WRONG_PASSWORD"


def test_aes_vectors():
    import numpy as np

    for size, want in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        aes = ciphers.Aes(bytes(range(size)))
        plain = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
        out = aes.encrypt(plain)
        assert out.tobytes().hex() == want and (aes.decrypt(out) == plain).all()


def test_zip_unsupported_method_lists():
    a = detect.open_archive("x.zipx", zip_with(98, b"xx", b"yy"))
    with pytest.raises(ArchiveError) as e:
        a.body(0)
    assert a.entries[0].path == "a.txt" and e.value.kind == "UNSUPPORTED"


def test_tar_links_and_times():
    raw = bytearray(pack.tar_bytes([("exec.sh", b"x"), ("d/", b"")]))
    a = detect.open_archive("x.tar", bytes(raw))
    assert [(e.path, e.kind, e.mode, e.modified) for e in a.entries] == [("exec.sh", "File", 0o644, 1600000000 * 10**9), ("d", DIR, 0o644, 1600000000 * 10**9)]


def test_cpio_needs_a_trailer():
    raw = pack.cpio_bytes([("a", b"b")])
    with pytest.raises(ArchiveError):
        detect.open_archive("x.cpio", raw[: raw.index(b"TRAILER") - 110])


def test_deb_order_and_errors():
    assert detect.winner(pack.deb_bytes(FILES)[:512], "x").id == "Deb" and detect.winner(pack.ar_bytes(FILES)[:512], "x").id == "Ar"
    with pytest.raises(ArchiveError):
        detect.open_archive("x.deb", pack.ar_bytes([("debian-binary", b"2.0\n")]))
    assert listing("x.deb", pack.deb_bytes(FILES, None))[1] == dict(FILES)


def test_xar_names_and_depth():
    toc = "<xar><toc>" + "".join(f"<file><name>{n}</name><type>directory</type><file><name>in</name><type>directory</type></file></file>" for n in ("../evil", "/etc", "..\\evil", "ok")) + "</toc></xar>"
    z = zlib.compress(toc.encode())
    head = lambda z, n: b"xar!" + struct.pack(">HHQQI", 28, 1, len(z), n, 0) + z
    assert [e.path for e in detect.open_archive("x.xar", head(z, len(toc))).entries] == ["ok", "ok/in"]
    deep = "<xar><toc>" + "<file>" * 200 + "</file>" * 200 + "</toc></xar>"
    with pytest.raises(ArchiveError):
        detect.open_archive("x.xar", head(zlib.compress(deep.encode()), len(deep)))
    assert not packs.exceeds_depth(b"<a><!-- <b><b><b> --><![CDATA[<c><c><c>]]><d x='<e>'/></a>", 2)


def test_warc():
    raw = pack.warc_bytes([("response", "http://example.com/page.html", b"body"), ("resource", "http://example.com/page.html?x#y", b"two"), ("request", "http://example.com/", b"no"), ("resource", None, b"three")])
    a, bodies = listing("x.warc", raw)
    assert bodies == {"example.com/page.html": b"body", "example.com/page.html-1": b"two", "record-2": b"three"}
    assert listing("x.warc.gz", pack.warc_bytes([("resource", "a://b", b"c")], True))[1] == {"b": b"c"}


def test_wim_empty_and_shared():
    a, bodies = listing("x.wim", pack.wim_bytes([("a.txt", b"same"), ("sub/b.txt", b"same"), ("empty", b"")]))
    assert bodies == {"a.txt": b"same", "sub/b.txt": b"same", "empty": b""} and a.entries[0].modified


def test_detection_order():
    with pytest.raises(ArchiveError) as e:
        detect.open_archive("x.iso", b"MZ" + bytes(0x9000))
    assert e.value.kind == "UNKNOWN_FORMAT"
    with pytest.raises(ArchiveError) as e:
        detect.open_archive("x.iso", b"MZ" + bytes(100))
    assert e.value.kind == "IO"
    with pytest.raises(ArchiveError) as e:
        detect.open_archive("x.exe", pack.sfx_bytes(b"nothing"))
    assert e.value.kind == "UNKNOWN_FORMAT"
    with pytest.raises(ArchiveError) as e:
        detect.open_archive("x.7z", b"7z\xbc\xaf\x27\x1c" + bytes(57))
    assert e.value.kind == "CORRUPT"
    assert len(detect.REGISTRY) == 51 and len({f.id for f in detect.REGISTRY}) == 51


@pytest.mark.skipif(not which("bsdtar"), reason="no independent writer")
@pytest.mark.parametrize("format,ext,name", [("iso9660", "iso", "Iso"), ("7zip", "7z", "SevenZ"), ("xar", "xar", "Xar"), ("newc", "cpio", "Cpio"), ("zip", "zip", "Zip"), ("ustar", "tar", "Tar"), ("pax", "tar", "Tar")])
def test_independent_writer(tmp_path, format, ext, name):
    root = tmp_path / "in"
    for p, body in FILES:
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_bytes(body)
    (root / "link").symlink_to("dir/a.txt")
    out = tmp_path / f"x.{ext}"
    done = subprocess.run(["bsdtar", "-c", "--format", format, "-f", str(out), "-C", str(root), "dir", "c.bin", "link"], capture_output=True, timeout=60)
    if done.returncode:
        pytest.skip(done.stderr.decode()[:200])
    a, bodies = listing(out.name, out.read_bytes())
    assert a.format == name and bodies == dict(FILES)
    assert [e.link_target for e in a.entries if e.kind == SYMLINK] == ["dir/a.txt"]
    if name == "Iso":  # found by content under any name
        assert detect.open_archive("x.bin", out.read_bytes()).format == "Iso"


def test_rar_stored():
    a, bodies = listing("x.rar", pack.rar_bytes(FILES))
    assert a.format == "Rar" and bodies == dict(FILES) and a.entries[0].mode == 0o755


def test_hfs_and_dmg():
    a, bodies = listing("x.img", pack.hfs_bytes(FILES))
    assert a.format == "HfsPlus" and bodies == dict(FILES) and a.entries[0].modified == 1600000000 * 10**9
    for kind in (1, 0x80000004, 0x80000005, 0x80000006, 0x80000008):
        raw = pack.dmg_bytes(pack.hfs_bytes(FILES), kind)
        for name in ("x.dmg", "x.bin"):
            a, bodies = listing(name, raw)
            assert a.format == "Dmg" and bodies == dict(FILES)
    with pytest.raises(ArchiveError) as e:
        listing("x.dmg", pack.dmg_bytes(pack.hfs_bytes(FILES)).replace(b"koly", b"kolx"))
    assert e.value.kind in ("UNSUPPORTED", "UNKNOWN_FORMAT", "CORRUPT")


@pytest.mark.parametrize("how", [1, 4])
def test_squashfs_and_appimage(how):
    files = [("a.txt", b"hello"), ("b.bin", bytes(range(256)) * 2000)]
    a, bodies = listing("x.bin", pack.squashfs_bytes(files, how))
    assert a.format == "Squashfs" and bodies == dict(files) and a.entries[0].mode == 0o644
    elf = bytearray(128)
    elf[:11] = b"\x7fELF\x02\x01\x01\x00AI\x02"
    struct.pack_into("<Q", elf, 0x28, 64)
    struct.pack_into("<HH", elf, 0x3A, 64, 1)
    assert listing("tool", bytes(elf) + pack.squashfs_bytes(files, how))[1] == dict(files)


def test_msi_paths():
    media = ({"DiskId": "i", "LastSequence": "i", "Cabinet": "s"}, [(1, 2, "#media1"), (2, 3, None)])
    cab = pack.cab_bytes([("fl_hello", b"hello"), ("fl_orphan", b"x")])
    directory = ({"Directory": "s", "Directory_Parent": "s", "DefaultDir": "s"}, [("TARGETDIR", None, "SourceDir"), ("PF", "TARGETDIR", "ProgramFiles"), ("APP", "PF", "MYAPP~1|MyApp"), ("SUB", "APP", "sub:src")])
    component = ({"Component": "s", "Directory_": "s"}, [("c1", "SUB")])
    file = ({"File": "s", "Component_": "s", "FileName": "s"}, [("fl_hello", "c1", "HELLO~1.TXT|hello.txt")])
    raw = pack.msi_bytes({"Media": media, "Directory": directory, "Component": component, "File": file}, {"media1": cab})
    a, bodies = listing("x.msi", raw)
    assert a.format == "Msi" and bodies == {"ProgramFiles/MyApp/sub/hello.txt": b"hello", "fl_orphan": b"x"}
    assert packs.directory_path("A", {"A": ("B", "A"), "B": ("A", "B")}) == ["B", "A"]


SMALL = [("1.txt", b"hello"), ("22.txt", b""), ("333.txt", bytes(range(256)) * 200), ("4444.txt", b"\x90\x90z" * 50)]


@pytest.mark.parametrize("ext", ["arc", "lbr", "alz", "arj", "zoo", "stuffit", "rar", "sevenz", "iso", "squashfs", "appimage", "hfs"])
def test_small_writers(ext):
    raw = getattr(pack, f"{ext}_bytes")(SMALL)
    a, bodies = listing(f"x.{ext}", raw)
    assert bodies == dict(SMALL) and [e.size for e in a.entries if e.kind == "File"] == [len(b) for _, b in SMALL]


@pytest.mark.parametrize("ext", ["macbinary", "applesingle", "binhex", "dms"])
def test_writers_of_one_file(ext):
    for name, body in SMALL:
        assert listing(f"{name[:-4]}.x", getattr(pack, f"{ext}_bytes")([(name, body)]))[1] == {name.replace("txt", "adf") if ext == "dms" else name: body}


@pytest.mark.parametrize("strong", [False, True])
def test_locked_zip(strong):
    raw = pack.locked_zip_bytes(SMALL, "pw", strong)
    a, bodies = listing("x.zip", raw, password="pw")
    assert bodies == dict(SMALL) and all(e.encrypted for e in a.entries)
    with pytest.raises(ArchiveError):
        listing("x.zip", raw, password="no")


def test_legacy_small():
    arc = b"\x1a\x02" + b"a.txt".ljust(13, b"\0") + struct.pack("<IHHHI", 5, 0, 0, __import__("coffer.sources.legacy.dos", fromlist=["_crc16"])._crc16(b"hello"), 5) + b"hello" + b"\x1a\0"
    assert listing("x.arc", arc)[1] == {"a.txt": b"hello"}
    lbr = bytearray(256)
    lbr[:32] = b"\0" + b" " * 11 + struct.pack("<HH", 0, 1) + bytes(16)
    lbr[32:64] = b"\0" + b"A       TXT" + struct.pack("<HH", 1, 1) + bytes(10) + bytes([123]) + bytes(5)
    lbr[64], lbr[96] = 0xFF, 0xFF
    lbr[128:133] = b"hello"
    assert listing("x.lbr", bytes(lbr))[1] == {"A.TXT": b"hello"}
    mb = bytearray(128)
    mb[1], mb[2:5], mb[102:106] = 3, b"abc", b"mBIN"
    struct.pack_into(">II", mb, 83, 5, 0)
    assert listing("x.bin", bytes(mb) + b"hello".ljust(128, b"\0"))[1] == {"abc": b"hello"}
    single = b"\0\5\x16\0\0\2\0\0" + bytes(16) + struct.pack(">H", 2) + struct.pack(">III", 3, 50, 3) + struct.pack(">III", 1, 53, 5) + b"abchello"
    assert listing("x", single)[1] == {"abc": b"hello"}
    alz = b"ALZ\1" + bytes(4) + b"BLZ\1" + struct.pack("<HBIBB", 5, 0x20, 0, 0x10, 0) + b"\2\0" + struct.pack("<I", zlib.crc32(b"hello")) 
    z = zlib.compress(b"hello")[2:-4]
    alz += bytes([len(z), 5]) + b"a.txt" + z
    assert listing("x.alz", alz)[1] == {"a.txt": b"hello"}
    dms = b"DMS!" + bytes(52) + b"TR" + struct.pack(">HHHHHBB", 0, 0, 5, 0, 5, 0, 0) + bytes(6) + b"hello"
    assert listing("disk.dms", dms)[1] == {"disk.adf": b"hello"}


def high_bits(bits):
    bits += "0" * (-len(bits) % 8)
    return int(bits, 2).to_bytes(len(bits) // 8, "big") if bits else b""


def test_huffman_formats():
    head = bytes([3]) + b"abc".ljust(63, b"\0") + bytes(12) + struct.pack(">II", 5, 0) + bytes(10)
    assert len(head) == 94
    plain = head + b"hello" + b"\0\0"
    symbols = sorted(set(plain))
    code, tree = {}, []

    def build(part, prefix):
        if len(part) == 1:
            code[part[0]] = prefix
            tree.append("1" + f"{part[0]:08b}")
        else:
            tree.append("0")
            build(part[: len(part) // 2], prefix + "0")
            build(part[len(part) // 2 :], prefix + "1")

    build(symbols, "")
    raw = high_bits("".join(tree) + "".join(code[b] for b in plain))
    assert listing("x.pit", b"PMa4" + raw + b"PEnd")[1] == {"abc": b"hello"}
    assert decoders.huffman(raw, 94) == head
    # Literals a and b, a match of three from two back.
    nibbles = lambda lengths: f"{len(lengths) // 2:08b}" + "".join(f"{n:04b}" for n in lengths)
    literal = [0] * 98 + [0, 0]
    literal[97], literal[98] = 1, 1
    bits = nibbles(literal) + nibbles([0, 0, 0, 1]) + nibbles([1, 0]) + "10" + "11" + "0" + "0" + "0" + f"{2:06b}"
    assert decoders.compact_lzh(high_bits(bits), 5) == b"ababa"


def test_names():
    assert names.vote([b"a", "é".encode()]) == "utf-8"
    assert names.vote(["Привет мир как дела".encode("cp1251")]) == "cp1251"
    assert names.vote(["Привет мир как дела".encode("cp866")]) == "cp866"
    assert names.vote([b"\xe9t\xe9"], "KOI8-R") == "koi8-r" and names.vote([b"a"], "no such") == "utf-8"
    a = detect.open_archive("x.tar", pack.tar_bytes([("x", b"1")]).replace(b"x" + bytes(99), b"\xef\xf0\xe8" + bytes(97), 1) if False else pack.tar_bytes([("x", b"1")]), Options(encoding="cp866"))
    assert a.entries[0].path == "x"


def test_times():
    assert times.civil(2020, 2, 30) == times.civil(2020, 3, 1)
    assert times.civil(1969, 12, 31) is None and times.civil(2020, 13, 1) is None and times.civil(2020, 1, 1, 25) == times.civil(2020, 1, 2, 1)
    assert times.filetime(0) is None and times.filetime(116444736000000001) == 100 and times.mac(2082844801) == 10**9
    assert times.iso8601("2024-03-01T12:00:00Z", 20) == 1709294400 * 10**9 and times.iso8601("2024-03-01T12:00:00", 20) is None
