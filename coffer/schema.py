"""The one schema of entries, whatever archive they come from."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import types as T

ENTRY_SCHEMA = T.StructType([
    T.StructField("archive", T.StringType()),
    T.StructField("format", T.StringType()),
    T.StructField("idx", T.IntegerType()),
    T.StructField("path_raw", T.BinaryType()),
    T.StructField("path", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("link_target", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mode", T.IntegerType()),
    T.StructField("is_encrypted", T.BooleanType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("modified_ns_rem", T.ShortType()),
    T.StructField("content", T.BinaryType()),
    T.StructField("error_class", T.StringType()),
    T.StructField("error_message", T.StringType()),
])

FILE, DIR, SYMLINK = "File", "Dir", "Symlink"


@dataclass
class Entry:
    """raw: the name as stored. path: the decoded name, or None to decode raw with the charset of
    the archive. modified: nanoseconds since 1970. read: gives the body; None for none."""

    raw: bytes
    path: str | None = None
    kind: str = FILE
    link_target: str | None = None
    size: int = 0
    mode: int | None = None
    encrypted: bool = False
    modified: int | None = None
    read: Callable[[], bytes] | None = None
    #: What is done to the decoded name.
    tidy: Callable[[str], str] | None = None


@dataclass
class Archive:
    format: str
    entries: list[Entry]
    #: Raises if the password doesn't open the archive; None if nothing is checked up front.
    verify: Callable[[], None] | None = None

    def body(self, idx: int) -> bytes:
        from .errors import ArchiveError

        if not 0 <= idx < len(self.entries):
            raise ArchiveError("INVALID_INDEX", str(idx))
        read = self.entries[idx].read
        return read() if read else b""


@dataclass
class Options:
    password: str | None = None
    encoding: str | None = None
