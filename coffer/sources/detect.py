"""Which format a file has, from its bytes and its name, and opening it."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Callable

from ..errors import ArchiveError, corrupt, unknown
from ..schema import Archive, Entry, Options
from . import apfs, codecs, images, names, packs, solid, tars, times, zips
from .legacy import amiga, dos, mac

NONE, EXTENSION, MAGIC = 0, 50, 100
#: Bytes of a file that the rules of the registry look at.
HEADER = 512

Rule = Callable[[bytes, str], int]


@dataclass(frozen=True)
class Format:
    id: str
    rule: Rule
    open: Callable[[bytes, str, Options], Archive]
    text: str


def _ext(name: str, *extensions: str) -> bool:
    return name.lower().endswith(tuple("." + e for e in extensions))


def _magic(*magics: bytes, ext: tuple[str, ...] = ()) -> tuple[Rule, str]:
    text = " or ".join([m.hex() for m in magics] + ["." + e for e in ext])
    return (lambda h, n: MAGIC if h.startswith(magics) or _ext(n, *ext) else NONE), text


def _test(test: Callable[[bytes], bool], text: str, ext: tuple[str, ...] = ()) -> tuple[Rule, str]:
    return (lambda h, n: MAGIC if test(h) or (ext and _ext(n, *ext)) else NONE), text


def _weak(*ext: str) -> tuple[Rule, str]:
    return (lambda h, n: EXTENSION if _ext(n, *ext) else NONE), " or ".join("." + e for e in ext)


_PK = b"PK\3\4"


def _bundle(ext: str) -> tuple[Rule, str]:
    return (lambda h, n: MAGIC if h.startswith(_PK) and _ext(n, ext) else NONE), f"{_PK.hex()} and .{ext}"


_CFB = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_never: tuple[Rule, str] = ((lambda h, n: NONE), "by content before the registry")


def _formats() -> list[Format]:
    f = lambda id, rule, open: Format(id, rule[0], open, rule[1])
    return [
        *(f(id, _bundle(ext), zips.open_bundle) for ext, id in zips.BUNDLES.items()),
        f("Crx", _magic(b"Cr24"), zips.open_crx),
        f("Conda", _bundle("conda"), zips.open_conda),
        f("Zip", _magic(_PK, b"PK\5\6"), zips.open_zip),
        f("Cpio", _magic(b"070701"), tars.open_cpio),
        f("SevenZ", _magic(b"7z\xbc\xaf\x27\x1c"), solid.open_7z),
        f("Rar", _magic(b"Rar!\x1a\x07"), solid.open_rar),
        f("Tar", _test(tars.is_tar, "ustar at 257"), tars.open_tar),
        f("Cab", _magic(b"MSCF"), packs.open_cab),
        f("Deb", _test(tars.is_deb, "ar with debian-binary first"), tars.open_deb),
        f("Ar", _magic(b"!<arch>\n"), tars.open_ar),
        f("Rpm", _magic(b"\xed\xab\xee\xdb"), tars.open_rpm),
        f("Xar", _magic(b"xar!"), packs.open_xar),
        f("Msi", ((lambda h, n: MAGIC if h.startswith(_CFB) and _ext(n, "msi") else NONE), f"{_CFB.hex()} and .msi"), packs.open_msi),
        f("Iso", _weak("iso"), images.open_iso),
        f("Squashfs", _magic(b"hsqs", ext=("squashfs", "sfs")), images.open_squashfs),
        f("AppImage", _test(lambda h: h[:4] == b"\x7fELF" and h[8:11] in (b"AI\1", b"AI\2"), "ELF with AI", ("appimage",)), packs.open_appimage),
        f("Wim", _magic(b"MSWIM\0\0\0", ext=("wim", "esd", "swm")), images.open_wim),
        f("Sfx", ((lambda h, n: EXTENSION if h.startswith(b"MZ") else NONE), "MZ"), packs.open_sfx),
        f("Warc", _magic(b"WARC/1.", ext=("warc", "warc.gz")), packs.open_warc),
        f("HfsPlus", _weak("hfs", "hfsplus", "hfsx"), images.open_hfs),
        f("Apfs", _test(apfs.is_apfs, "NXSB at 32", ("apfs",)), apfs.open_apfs),
        f("Dmg", _test(lambda h: False, ".dmg", ("dmg",)), images.open_dmg),
        f("Arj", _test(dos.is_arj, "60ea and a sane header"), dos.open_arj),
        f("Zoo", _test(dos.is_zoo, "dca7c4fd at 20"), dos.open_zoo),
        f("Lbr", _test(dos.is_lbr, "empty name in the first entry"), dos.open_lbr),
        f("Crunch", _magic(b"\x76\xfe"), dos.open_crunch),
        f("Arc", _test(lambda h: False, ".arc .ark .pak .spark", ("arc", "ark", "pak", "spark")), dos.open_arc),
        f("Squeeze", _magic(b"\x76\xff", ext=("sq", "qqq")), dos.open_squeeze),
        f("BinHex", _test(mac.is_binhex, "banner"), mac.open_binhex),
        f("MacBinary", _test(mac.is_macbinary, "header checksum"), mac.open_macbinary),
        f("AppleSingle", _test(mac.is_applesingle, "00051600 or 00051607"), mac.open_applesingle),
        f("CompactPro", _test(mac.is_compactpro, "directory checksum", ("cpt",)), mac.open_compactpro),
        f("PackIt", _test(mac.is_packit, "PMag PMa4 PMa5 PMa6", ("pit",)), mac.open_packit),
        f("StuffIt5", _test(mac.is_stuffit5, "StuffIt banner"), mac.open_stuffit5),
        f("StuffIt", _test(mac.is_stuffit, "SIT! and rLau"), mac.open_stuffit),
        f("StuffItX", _test(mac.is_stuffitx, "StuffIt! or StuffIt?"), mac.open_stuffitx),
        f("Alz", _magic(b"ALZ\1", ext=("alz",)), dos.open_alz),
        f("Nsis", _never, dos.open_nsis),
        f("PowerPacker", _magic(b"PP20", ext=("pp",)), amiga.open_powerpacker),
        f("Lzx", _magic(b"LZX\0", b"LZX", ext=("lzx",)), amiga.open_lzx),
        f("Dms", _magic(b"DMS!", ext=("dms",)), amiga.open_dms),
    ]


REGISTRY = _formats()


def probe(header: bytes, name: str) -> list[tuple[int, str, int]]:
    """(priority, format, confidence) of all formats with any."""
    return [(i, f.id, c) for i, f in enumerate(REGISTRY) if (c := f.rule(header[:HEADER], name))]


def winner(header: bytes, name: str) -> Format | None:
    """The highest confidence, of equal ones the first in the registry."""
    found = probe(header, name)
    return REGISTRY[min(found, key=lambda x: (-x[2], x[0]))[0]] if found else None


def stem_without_compressor(name: str) -> str:
    own = name.rsplit("/", 1)[-1]
    return next((own[: -len(e)] for e in (".gz", ".bz2", ".xz", ".zst", ".Z", ".lz4", ".br") if own.endswith(e)), own)


def detect(name: str, buf: bytes) -> str:
    """How a file would be opened: a format, or Compressed."""
    own = name.rsplit("/", 1)[-1]
    if _ext(own, "warc", "warc.gz"):
        return "Warc"
    if _ext(own, "dmg") or images.koly(buf):
        return "Dmg"
    if codecs.detect_compressor(buf[:HEADER]) or codecs.compressor_by_name(own):
        return "Compressed"
    if buf[:2] == b"MZ" and dos.is_nsis(buf):
        return "Nsis"
    found = winner(buf, own)
    if found:
        return found.id
    if images.is_iso(buf):
        return "Iso"
    if images.is_hfs(buf):
        return "HfsPlus"
    raise unknown()


_BY_ID = {f.id: f for f in REGISTRY}


def open_archive(name: str, buf: bytes, options: Options | None = None, carved: bool = False) -> Archive:
    """Detect, list and decode names. carved: a file within another, which has no extension of its
    own to go by."""
    options = options or Options()
    own = name.rsplit("/", 1)[-1]
    kind = detect("" if carved else own, buf)
    try:
        if kind == "Compressed":
            archive = _compressed(own, buf, options)
        else:
            archive = _BY_ID[kind].open(buf, own, options)
    except ArchiveError:
        raise
    except (struct.error, IndexError, ValueError, OverflowError, zlib.error, EOFError, RecursionError, MemoryError) as e:
        raise corrupt(f"{kind}: {type(e).__name__}: {e}") from None
    _decode_names(archive, options)
    return archive


def _compressed(own: str, buf: bytes, options: Options) -> Archive:
    kind = codecs.detect_compressor(buf[:HEADER]) or codecs.compressor_by_name(own)
    plain = codecs.decompress(buf[:], kind)
    if tars.is_tar(plain):
        return tars.open_tar(plain, own, options)
    modified = None
    if kind == codecs.GZIP and len(buf) >= 8:
        seconds = int.from_bytes(buf[4:8], "little")
        modified = times.unix(seconds) if seconds else None
    stem = stem_without_compressor(own)
    return Archive("Raw", [Entry(stem.encode(), path=stem, size=len(plain), modified=modified, read=lambda: plain)])


def _decode_names(archive: Archive, options: Options) -> None:
    open_names = [e for e in archive.entries if e.path is None]
    if not open_names:
        return
    charset = names.vote([e.raw for e in open_names], options.encoding)
    for e in open_names:
        text = names.decode(e.raw, charset)
        e.path = e.tidy(text) if e.tidy else text
