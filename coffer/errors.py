"""Errors of archives, by class. In permissive scans they become columns of a row."""

from __future__ import annotations

CLASSES = ("IO", "UNKNOWN_FORMAT", "UNSUPPORTED", "ENCRYPTED", "WRONG_PASSWORD", "CORRUPT", "PATH_TRAVERSAL", "MISSING_VOLUME", "INVALID_INDEX")


class ArchiveError(Exception):
    def __init__(self, kind: str, message: str = ""):
        assert kind in CLASSES, kind
        super().__init__(f"{kind}: {message}" if message else kind)
        self.kind, self.message = kind, message

    def __reduce__(self):
        return ArchiveError, (self.kind, self.message)


def corrupt(message: str) -> ArchiveError:
    return ArchiveError("CORRUPT", message)


def unsupported(message: str) -> ArchiveError:
    return ArchiveError("UNSUPPORTED", message)


def unknown(message: str = "no format fits") -> ArchiveError:
    return ArchiveError("UNKNOWN_FORMAT", message)
