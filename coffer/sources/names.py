"""Charsets of names: one for all names of an archive."""

from __future__ import annotations

import codecs

# Labels of the Encoding Standard that Python spells otherwise.
LABELS = {"utf-8": "utf-8", "utf8": "utf-8", "koi8-r": "koi8-r", "koi8-u": "koi8-u", "ibm866": "cp866", "cp866": "cp866", "gbk": "gb18030", "gb2312": "gb18030", "gb18030": "gb18030", "big5": "big5hkscs", "shift_jis": "cp932", "shift-jis": "cp932", "sjis": "cp932", "euc-jp": "euc_jp", "euc-kr": "cp949", "iso-8859-1": "cp1252", "latin1": "cp1252", "us-ascii": "cp1252", "ascii": "cp1252", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be"}
_NAMES = {"utf-8": "UTF-8", "koi8-r": "KOI8-R", "cp866": "IBM866", "cp932": "Shift_JIS", "gb18030": "GBK", "big5hkscs": "Big5", "euc_jp": "EUC-JP", "cp949": "EUC-KR", "cp1251": "windows-1251", "cp1252": "windows-1252"}


def codec(label: str | None) -> str | None:
    """The codec of a label, or None if nobody knows it."""
    if not label:
        return None
    label = label.strip().lower()
    label = LABELS.get(label, label.replace("windows-", "cp"))
    try:
        return codecs.lookup(label).name
    except LookupError:
        return None


def is_utf8(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
        return True
    except UnicodeDecodeError:
        return False


def _guess(raw: bytes) -> str:
    """Approximate: Cyrillic charsets by how much looks like words in small letters, Japanese by
    valid pairs, else Western."""
    best, score = "cp1252", 0.0
    high = sum(b >= 128 for b in raw)
    for name in ("cp866", "cp1251", "koi8-r", "cp932", "gb18030"):
        try:
            text = raw.decode(name)
        except (UnicodeDecodeError, LookupError):
            continue
        wide = [c for c in text if ord(c) > 127]
        if not wide:
            continue
        if name in ("cp932", "gb18030"):
            good = sum("぀" <= c <= "ヿ" or "一" <= c <= "鿿" for c in wide) * 2 * (1.0 if name == "cp932" else 0.8) if any("぀" <= c <= "ヿ" for c in wide) or name == "gb18030" else 0
        else:
            small = sum("а" <= c <= "я" or c == "ё" for c in wide)
            common = sum(c in "оеаинтсрвлк" for c in wide)
            good = 0.6 * small + 0.6 * common - sum(not c.isalpha() for c in wide)
        if good / high > max(score, 0.45):
            best, score = name, good / high
    return best


def vote(raws: list[bytes], override: str | None = None) -> str:
    """The codec of all names together: a known override, else UTF-8 if all are, else a guess."""
    named = codec(override)
    if named:
        return named
    if all(map(is_utf8, raws)):
        return "utf-8"
    return _guess(b"\n".join(r for r in raws if not r.isascii()))


def label(name: str) -> str:
    """The label of a codec in the Encoding Standard."""
    return _NAMES.get(name, name.replace("cp125", "windows-125"))


def decode(raw: bytes, name: str) -> str:
    if raw.startswith(b"\xef\xbb\xbf"):
        raw, name = raw[3:], "utf-8"
    return raw.decode(name, "replace")
