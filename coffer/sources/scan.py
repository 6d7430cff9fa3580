"""Archives as tables: files in, entries out, with bodies only if asked for.

``list_entries`` turns a DataFrame of (path, content) into entries: of binaryFile, of a stream or
of archives that were made in memory. ``read_archives`` reads files; ``register`` adds the format
"archive" and the SQL table function list_entries(path, content, options).
"""

from __future__ import annotations

import json
import mmap
import os
from typing import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition

from ..errors import ArchiveError
from ..schema import ENTRY_SCHEMA, SYMLINK, Archive, Options
from ..shipping import ship
from .detect import REGISTRY, open_archive, probe

#: Rows and bytes of bodies of an Arrow batch.
ROWS, BYTES = 2000, 16 << 20

ARROW = pa.schema([
    ("archive", pa.string()), ("format", pa.string()), ("idx", pa.int32()), ("path_raw", pa.binary()), ("path", pa.string()),
    ("kind", pa.string()), ("link_target", pa.string()), ("size", pa.int64()), ("mode", pa.int32()), ("is_encrypted", pa.bool_()),
    ("modified", pa.timestamp("us", "UTC")), ("modified_ns_rem", pa.int16()), ("content", pa.binary()), ("error_class", pa.string()), ("error_message", pa.string()),
])


def _failed(name: str, e: ArchiveError, format: str | None = None, idx: int | None = None) -> dict:
    return {f.name: None for f in ARROW} | {"archive": name, "format": format, "idx": idx, "error_class": e.kind, "error_message": e.message}


def rows_of(name: str, content: bytes | None, password: str | None = None, encoding: str | None = None, body: bool = False, mode: str = "FAILFAST", idxs: frozenset[int] | None = None) -> Iterator[dict]:
    """The rows of one file. PERMISSIVE turns an error into columns: of a file that can't be opened
    into a row without idx, of a body into its entry's row."""
    permissive = mode.upper() == "PERMISSIVE"
    try:
        if content is None:
            raise ArchiveError("IO", "no content")
        archive = open_archive(name, content, Options(password, encoding))
    except ArchiveError as e:
        if not permissive:
            raise
        yield _failed(name, e)
        return
    for i, e in enumerate(archive.entries):
        if idxs is not None and i not in idxs:
            continue
        row = {
            "archive": name, "format": archive.format, "idx": i, "path_raw": e.raw, "path": e.path, "kind": e.kind, "link_target": e.link_target,
            "size": e.size, "mode": e.mode, "is_encrypted": e.encrypted, "modified": None if e.modified is None else e.modified // 1000,
            "modified_ns_rem": None if e.modified is None else e.modified % 1000, "content": None, "error_class": None, "error_message": None,
        }
        if body:
            try:
                row["content"] = archive.body(i)
            except ArchiveError as x:
                if not permissive:
                    raise
                row |= {"error_class": x.kind, "error_message": x.message}
        yield row


def _batches(rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row["content"] or b"")
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=ARROW)


def list_entries(files: DataFrame, content: bool = False, password: str | None = None, encoding: str | None = None, mode: str = "FAILFAST", path_col: str = "path", content_col: str = "content") -> DataFrame:
    """Entries of the archives in files, each file by one task, without a shuffle. Bodies are
    decoded only with content=True, so a listing doesn't pay for them."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0), b.column(1)):
                yield from _batches(rows_of(name.as_py(), raw.as_py(), password, encoding, content, mode))

    return files.select(F.col(path_col), F.col(content_col)).mapInArrow(run, ENTRY_SCHEMA)


def read_entries(files: DataFrame, selected: DataFrame, password: str | None = None, mode: str = "FAILFAST") -> DataFrame:
    """Bodies of the selected (archive, idx), each archive opened once and read in one pass; an idx
    that an archive doesn't have is INVALID_INDEX."""
    ship(files.sparkSession)
    wanted = selected.groupBy(F.col("archive").alias("path")).agg(F.collect_set("idx").alias("idxs"))
    joined = files.select("path", "content").join(wanted, "path").select("path", "content", "idxs")

    def run(batches):
        for b in batches:
            for name, raw, idxs in zip(*(c.to_pylist() for c in b.columns)):
                yield from _batches(_selected(name, raw, idxs, password, mode))

    return joined.mapInArrow(run, ENTRY_SCHEMA)


def _selected(name, raw, idxs, password, mode):
    seen = set()
    for row in rows_of(name, raw, password, None, True, mode, frozenset(idxs)):
        seen.add(row["idx"])
        yield row
    for i in sorted(set(idxs) - seen - ({*idxs} if seen == {None} else set())):
        e = ArchiveError("INVALID_INDEX", str(i))
        if mode.upper() != "PERMISSIVE":
            raise e
        yield _failed(name, e, idx=i)


def read_archives(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """Entries of the files under path, by binaryFile: any store that Spark reads."""
    glob = options.pop("pathGlobFilter", None)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return list_entries(reader.load(path).select("path", "content"), **options)


def formats(spark: SparkSession) -> DataFrame:
    """The registry: (priority, format, rule) in the order that decides between equal rules."""
    return spark.createDataFrame([(i, f.id, f.text) for i, f in enumerate(REGISTRY)], "priority int, format string, rule string")


def probes(files: DataFrame, path_col: str = "path", header_col: str = "content") -> DataFrame:
    """(archive, priority, format, confidence) of every rule that fits a file's first bytes. Only
    those bytes reach the workers."""
    ship(files.sparkSession)

    def run(batches):
        for b in batches:
            rows = [{"archive": n, "priority": p, "format": f, "confidence": c} for n, h in zip(*(c.to_pylist() for c in b.columns)) for p, f, c in probe(h or b"", n.rsplit("/", 1)[-1])]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("archive", pa.string()), ("priority", pa.int32()), ("format", pa.string()), ("confidence", pa.int8())]))

    return files.select(path_col, F.substring(header_col, 1, 512)).mapInArrow(run, "archive string, priority int, format string, confidence tinyint")


def winners(probed: DataFrame) -> DataFrame:
    """The rule of highest confidence, of equal ones the first: one aggregate, no sort."""
    best = F.max_by(F.struct("format", "confidence"), F.struct(F.col("confidence"), -F.col("priority")))
    return probed.groupBy("archive").agg(best.alias("best")).select("archive", "best.format", "best.confidence")


# The data source "archive"


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


def load(system, path: str, listing: bool):
    """A file's bytes, of which only those are read that are looked at. A file of this machine or a
    mounted store is mapped. Of others a listing gets the index of a ZIP or 7z archive, with
    nothing where the bodies are, if the index says all that a listing says; else all bytes."""
    if system.type_name == "local":
        with open(path, "rb") as f:
            return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if os.fstat(f.fileno()).st_size else b""
    with system.open_input_file(path) as f:
        size = f.size()
        if listing and size > INDEXED:
            for start in _index_at(f, size):
                raw = mmap.mmap(-1, size)  # takes memory only where something is put
                raw[:512], raw[start:] = f.read_at(512, 0), f.read_at(size - start, start)
                try:
                    archive = open_archive(path, raw)
                    if all(e.kind != SYMLINK for e in archive.entries):
                        return raw
                except ArchiveError:
                    pass  # the index is packed or lies elsewhere
        return f.read_at(size, 0)


#: Files up to here are read as a whole.
INDEXED = 1 << 20


def _index_at(f, size: int) -> Iterator[int]:
    """Where the index of an archive begins that ends with one."""
    head = f.read_at(32, 0)
    if head[:4] in (b"PK\3\4", b"PK\5\6"):
        n = min(size, (1 << 16) + 22)
        tail = f.read_at(n, size - n)
        end = tail.rfind(b"PK\5\6")
        if end >= 0 and end + 22 <= n:
            length = int.from_bytes(tail[end + 12 : end + 16], "little")
            if length != 0xFFFFFFFF and length <= size - n + end:
                yield size - n + end - length
    elif head[:6] == b"7z\xbc\xaf\x27\x1c":
        at = 32 + int.from_bytes(head[12:20], "little")
        if at < size:
            yield at


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.options = options
        self.archives: frozenset[str] | None = None
        self.idxs: frozenset[int] | None = None

    def pushFilters(self, filters):
        """Filters on archive choose files, those on idx entries; all are checked again above."""
        for f in filters:
            if isinstance(f, (EqualTo, In)):
                values = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                if f.attribute == ("archive",):
                    self.archives = values if self.archives is None else self.archives & values
                elif f.attribute == ("idx",):
                    self.idxs = values if self.idxs is None else self.idxs & values
            yield f

    def partitions(self):
        from pyarrow import fs

        path = self.options["path"]
        system, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.Directory:
            found = [f.path for f in system.get_file_info(fs.FileSelector(root, recursive=True)) if f.is_file and not f.base_name.startswith((".", "_"))]
        elif info.type == fs.FileType.File:
            found = [info.path]
        else:
            raise ArchiveError("IO", f"no such file: {path}")
        found = sorted(p for p in found if self.archives is None or p in self.archives)
        return [_Part(p) for p in found]

    def read(self, partition):
        from pyarrow import fs

        if partition is None:
            return
        path, o = self.options["path"], self.options
        system = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        body = o.get("content", "false").lower() == "true"
        raw = load(system, partition.path, not body)
        yield from _batches(rows_of(partition.path, raw, o.get("password"), o.get("encoding"), body, o.get("mode", "FAILFAST"), self.idxs))


class ArchiveSource(DataSource):
    """spark.read.format("archive").option("content", "true").load(path): one task for each file.
    Options: password, encoding, content, mode (FAILFAST or PERMISSIVE)."""

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return ENTRY_SCHEMA

    def reader(self, schema):
        return ArchiveReader(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    from pyspark.sql.functions import udtf

    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArchiveSource)
    returns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ENTRY_SCHEMA.fields)
    spark.udtf.register("list_entries", udtf(_ListEntries, returnType=returns))


class _ListEntries:
    def eval(self, path: str, content: bytes, options: str = "{}"):
        import datetime

        o = json.loads(options or "{}")
        for r in rows_of(path, bytes(content) if content is not None else None, o.get("password"), o.get("encoding"), bool(o.get("content")), o.get("mode", "FAILFAST")):
            if r["modified"] is not None:
                r["modified"] = datetime.datetime.fromtimestamp(0, datetime.timezone.utc) + datetime.timedelta(microseconds=r["modified"])
            yield tuple(r[f.name] for f in ARROW)


def decompress(column: Column | str, kind: Column | str) -> Column:
    """The bytes of a compressed stream of a kind: Gzip, Bzip2, Xz, Zstd, Lzma, Lzc, Lz4, Brotli."""
    from pyspark.sql.functions import arrow_udf

    ship(SparkSession.active())
    return arrow_udf(_decompress, "binary")(column, kind)


def _decompress(raw: pa.Array, kinds: pa.Array) -> pa.Array:
    from .codecs import decompress as one

    return pa.array([None if r is None or k is None else one(r, k) for r, k in zip(raw.to_pylist(), kinds.to_pylist())], pa.binary())


__all__ = ["Archive", "ArchiveSource", "decompress", "formats", "list_entries", "probes", "read_archives", "read_entries", "register", "rows_of", "winners"]
