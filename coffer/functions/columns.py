"""Scalar functions as Column expressions: all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column | str


def _col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def components(path: C) -> Column:
    """The parts of a path that count: neither empty nor a dot."""
    return F.filter(F.split(_col(path), "/"), lambda p: (p != "") & (p != "."))


def normalize_path(path: C) -> Column:
    """For comparison: no slash at the end, no empty parts, no dots but a leading one."""
    parts = F.split(_col(path), "/")
    kept = F.filter(parts, lambda p, i: (p != "") & ((p != ".") | (i == 0)))
    return F.concat(F.when(F.startswith(_col(path), F.lit("/")), "/").otherwise(""), F.array_join(kept, "/"))


def is_macos_metadata(path: C) -> Column:
    """Any part __MACOSX, or a last part .DS_Store or one that begins with ._"""
    parts = components(path)
    last = F.coalesce(F.try_element_at(parts, F.lit(-1)), F.lit(""))
    return F.array_contains(parts, "__MACOSX") | (last == ".DS_Store") | F.startswith(last, F.lit("._"))


def is_safe_path(path: C) -> Column:
    text = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return ~(F.array_contains(F.split(text, "/"), "..") | F.startswith(text, F.lit("/")))


def safe_join(dest: C, path: C) -> Column:
    """dest/path with backslashes as slashes and without dots; null if the path would leave dest.
    The empty path is dest itself."""
    text = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    parts = components(text)
    joined = F.when(F.size(parts) == 0, _col(dest)).otherwise(F.concat(F.rtrim(_col(dest), F.lit("/")), F.lit("/"), F.array_join(parts, "/")))
    return F.when(is_safe_path(path), joined)


def safe_symlink_target(link: C, target: C) -> Column:
    """The target, if it stays below the root at every step from the link's folder on; else null.
    Only the target's backslashes are slashes."""
    text = F.replace(_col(target), F.lit("\\"), F.lit("/"))
    start = F.greatest(F.size(F.filter(components(link), lambda p: p != "..")) - 1, F.lit(0))
    depth = F.aggregate(components(text), start, lambda d, p: F.when(d < 0, d).when(p == "..", d - 1).otherwise(d + 1))
    return F.when(~F.startswith(text, F.lit("/")) & (depth >= 0), _col(target))


def wrapper_name(archive: C) -> Column:
    """The file name without its last extension; a name that only begins with a dot keeps it."""
    name = F.substring_index(_col(archive), "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def stem_without_compressor(name: C) -> Column:
    return F.regexp_replace(F.substring_index(_col(name), "/", -1), r"\.(gz|bz2|xz|zst|Z|lz4|br)$", "")


def uri_to_path(uri: C) -> Column:
    """A relative path of an address: no scheme, query or fragment; .. becomes _; never empty."""
    text = _col(uri)
    at = F.position(F.lit("://"), text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(text)
    rest = F.substring_index(F.substring_index(rest, "?", 1), "#", 1)
    parts = F.transform(components(rest), lambda p: F.when(p == "..", "_").otherwise(p))
    joined = F.array_join(parts, "/")
    return F.when(joined == "", "index").otherwise(joined)


def strip_http_headers(block: C) -> Column:
    """Bytes behind the first empty line; all, if there is none. The search is on Latin-1, where a
    character is a byte."""
    raw = _col(block)
    at = F.position(F.lit("\r\n\r\n"), F.decode(raw, "ISO-8859-1"))
    return F.when(at > 0, F.substring(raw, at + 4, F.octet_length(raw))).otherwise(raw)


def civil_seconds(year: C, month: C, day: C, hour: C, minute: C, second: C) -> Column:
    """Seconds since 1970; days beyond a month's end and odd hours count on. Null before 1970 and
    for months or days that no calendar has."""
    y, mo, d = (_col(c).cast("int") for c in (year, month, day))
    ok = y.between(1970, 9999) & mo.between(1, 12) & d.between(1, 31)
    first = F.make_date(F.when(ok, y), F.when(ok, mo), F.lit(1))
    days = F.unix_date(first).cast("long") + d - 1
    return F.when(ok, days * 86400 + _col(hour).cast("long") * 3600 + _col(minute).cast("long") * 60 + _col(second).cast("long"))


def iso_seconds(text: C, least: int) -> Column:
    """Seconds of a date of at least least characters; its zone is ignored."""
    t = F.trim(_col(text))
    pattern = r"^([0-9]{4}).([0-9]{2}).([0-9]{2}).([0-9]{2}).([0-9]{2}).([0-9]{2})"
    part = lambda i: F.regexp_extract(t, pattern, i)
    fits = t.rlike(pattern) & (F.length(t) >= least)
    n = lambda i: F.when(fits, part(i))
    return civil_seconds(*(n(i) for i in range(1, 7)))


def warc_seconds(text: C) -> Column:
    return iso_seconds(text, 20)


def xar_seconds(text: C) -> Column:
    return iso_seconds(text, 19)


def little_endian(raw: C, at: int, size: int) -> Column:
    """An unsigned number of size bytes from byte at on (counted from 0)."""
    b = _col(raw)
    digits = F.hex(F.concat(*(F.substring(b, at + k + 1, 1) for k in reversed(range(size)))))
    return F.when(F.octet_length(b) >= at + size, F.conv(digits, 16, 10).cast("decimal(20,0)").cast("long" if size < 8 else "decimal(20,0)"))


def gzip_mtime(header: C) -> Column:
    """Seconds in a gzip header; null for none."""
    seconds = little_endian(header, 4, 4)
    return F.when(seconds > 0, seconds)


def filetime_seconds(ticks: C) -> Column:
    """Whole seconds of ticks of 100 ns since 1601; null for 0 and before 1970."""
    t = _col(ticks).cast("long")
    return F.when((t != 0) & (t >= 116444736000000000), ((t - 116444736000000000) - F.pmod(t - 116444736000000000, F.lit(10000000))) / 10000000).cast("long")


def hfs_seconds(seconds: C) -> Column:
    """Seconds since 1904 as seconds since 1970; null before."""
    s = _col(seconds).cast("long") - 2082844800
    return F.when(s >= 0, s)


def unix_seconds_or_null(seconds: C) -> Column:
    s = _col(seconds).cast("long")
    return F.when(s != 0, s)


def default_dir_name(value: C) -> Column:
    """The long name before the source's name; null for the empty one and the dot."""
    name = F.substring_index(F.substring_index(_col(value), ":", 1), "|", -1)
    return F.when(~name.isin("", "."), name)


def file_long_name(value: C) -> Column:
    return F.substring_index(_col(value), "|", -1)


def crx_zip_offset(header: C) -> Column:
    """Where the ZIP archive of an extension begins; null for a version that nobody knows."""
    version = little_endian(header, 4, 4)
    return F.when(version == 3, 12 + little_endian(header, 8, 4)).when(version == 2, 16 + little_endian(header, 8, 4) + little_endian(header, 12, 4))


def start_header_ok(header: C) -> Column:
    """Whether the checksum of a 7z start header fits."""
    return F.crc32(F.substring(_col(header), 13, 20)) == little_endian(header, 8, 4)


def detect_compressor(header: C) -> Column:
    h = _col(header)
    out = None
    # What a compressed stream starts with.
    for magic, kind in (("1f8b", "Gzip"), ("425a68", "Bzip2"), ("fd377a585a00", "Xz"), ("28b52ffd", "Zstd"), ("1f9d", "Lzc"), ("04224d18", "Lz4")):
        test = F.startswith(h, F.unhex(F.lit(magic)))
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out


def compressor_by_name(name: C) -> Column:
    return F.when(F.endswith(F.lower(_col(name)), F.lit(".br")), "Brotli")


def is_tar(content: C) -> Column:
    return F.coalesce((F.substring(_col(content), 258, 5) == F.lit(b"ustar")) & (F.octet_length(_col(content)) >= 263), F.lit(False))


def has_extension(name: C, *extensions: str) -> Column:
    lower = F.lower(_col(name))
    out = F.lit(False)
    for e in extensions:
        out = out | F.endswith(lower, F.lit("." + e))
    return out


def is_koly(content: C) -> Column:
    c = _col(content)
    return (F.octet_length(c) >= 512) & (F.substring(c, -512, 4) == F.lit(b"koly"))


def is_iso(content: C) -> Column:
    return F.substring(_col(content), 0x8002, 5) == F.lit(b"CD001")


def is_hfs(content: C) -> Column:
    return F.substring(_col(content), 1025, 2).isin(F.lit(b"H+"), F.lit(b"HX"))


def xar_codec(style: C) -> Column:
    """The codec of an encoding style; a gzip style is zlib as well."""
    s = F.lower(_col(style))
    return F.when(s.contains("gzip") | s.contains("zlib"), "zlib").when(s.contains("bzip2"), "bzip2").when(s.contains("xz") | s.contains("lzma"), "xz").when(s.contains("octet-stream") | s.isNull() | (s == ""), "stored")


def rpm_compressor(tag: C) -> Column:
    t = _col(tag)
    return F.when(t == "gzip", "Gzip").when(t == "bzip2", "Bzip2").when(t == "xz", "Xz").when(t == "lzma", "Lzma").when(t == "zstd", "Zstd")


def kind_of_mode(mode: C) -> Column:
    """File, Dir or Symlink by the type bits of a Unix mode; null for devices and pipes."""
    t = _col(mode).bitwiseAND(F.lit(0o170000))
    return F.when(t == 0o100000, "File").when(t == 0o040000, "Dir").when(t == 0o120000, "Symlink")


def permissions(mode: C) -> Column:
    return _col(mode).bitwiseAND(F.lit(0o7777))


def decode_utf16le(raw: C) -> Column:
    """UTF-16 text; an odd length is an error, as is a lone surrogate."""
    c = _col(raw)
    return F.when(F.octet_length(c) % 2 == 1, F.raise_error(F.lit("CORRUPT: odd length of UTF-16"))).otherwise(F.decode(c, "UTF-16LE"))


def is_utf8(raw: C) -> Column:
    return F.is_valid_utf8(_col(raw).cast("string")) if hasattr(F, "is_valid_utf8") else F.decode(_col(raw), "UTF-8").isNotNull()
