"""The engine's queries over the driver's tables, and the same relations in SQL.

Tables become archives in memory (testing.pack), a thousand rows to an archive at most, so no
task's group grows with the table; the engine then detects, lists and reads them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import relational as R
from ..shipping import ship
from ..sources import scan
from ..testing import pack

FILES = "path string, content binary"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack_rows(rows: DataFrame, writer: Callable[[list[tuple[str, bytes]]], bytes]) -> DataFrame:
    """(path, content) of archives from rows (archive, name, body, seq), in the order of seq."""
    ship(rows.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        files = [(n, b or b"") for n, b in zip(table.column("name").to_pylist(), table.column("body").to_pylist())]
        return pa.table([pa.array([table.column("archive")[0].as_py()]), pa.array([writer(files)], pa.binary())], names=["path", "content"])

    return rows.select("archive", "name", "body", "seq").groupBy("archive").applyInArrow(run, FILES)


def documents(spark: SparkSession, sf_dir: str, ext: str) -> DataFrame:
    """Rows to pack: an archive for each language and thousand of ids."""
    d = _table(spark, sf_dir, "documents")
    archive = F.concat(F.col("lang"), F.lit("-"), F.expr("doc_id div 1000").cast("string"), F.lit(ext))
    name = F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return d.select(archive.alias("archive"), name.alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.col("doc_id").alias("seq"))


def _listing(entries: DataFrame) -> DataFrame:
    return entries.select("archive", "format", F.col("idx").cast("long").alias("idx"), "path", "kind", "size", F.unix_seconds("modified").alias("modified_s"))


def _bodies(entries: DataFrame) -> DataFrame:
    return entries.where("kind = 'File'").select("archive", "format", "path", "size", F.md5("content").alias("body_md5"))


_SIZE = "CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT)"


def _doc_sql(ext: str, format: str, modified: str, where: str = "") -> str:
    return f"""SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '{ext}' AS archive, '{format}' AS format,
        row_number() OVER (PARTITION BY lang, doc_id // 1000 ORDER BY doc_id) - 1 AS idx, lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path,
        'File' AS kind, {_SIZE} AS size, CAST({modified} AS BIGINT) AS modified_s FROM documents {where}"""


def _body_sql(ext: str, format: str) -> str:
    return f"""SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '{ext}' AS archive, '{format}' AS format,
        lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, {_SIZE} AS size, md5(coalesce(text, '')) AS body_md5 FROM documents"""


#: 2020-02-02 02:02:02, the time of all entries of DOS-like archives here.
_DOS = "1580608922"
_UNIX = "1600000000"


def _in_tar(kind: str):
    return lambda files: pack.compress(pack.tar_bytes(files), kind)


def _deb(files):
    return pack.deb_bytes(files, "Zstd")


def _conda(files):
    half = len(files) // 2
    return pack.conda_bytes(files[:half], files[half:])


def _sfx(files):
    return pack.sfx_bytes(pack.zip_bytes(files))


def _in_cab(files):
    return pack.cab_bytes([(n.replace("/", "\\"), b) for n, b in files])


#: name: (extension, writer, format reported, seconds of entries)
_PACKED: dict[str, tuple[str, Callable, str, str]] = {
    "zip": (".zip", pack.zip_bytes, "Zip", _DOS),
    "crx": (".crx", pack.crx_bytes, "Crx", _DOS),
    "sfx": (".exe", _sfx, "Zip", _DOS),
    "tar": (".tar", pack.tar_bytes, "Tar", _UNIX),
    "sevenz": (".7z", pack.sevenz_bytes, "SevenZ", "NULL"),
    "cpio": (".cpio", pack.cpio_bytes, "Cpio", _UNIX),
    "ar": (".a", pack.ar_bytes, "Ar", _UNIX),
    "deb": (".deb", _deb, "Deb", _UNIX),
    "rpm": (".rpm", pack.rpm_bytes, "Rpm", _UNIX),
    "cab": (".cab", _in_cab, "Cab", "1580608922"),
    "conda": (".conda", _conda, "Conda", _UNIX),
    **{f"tar_{e}": (f".tar.{e}", _in_tar(k), "Tar", _UNIX) for e, k in (("gz", "Gzip"), ("bz2", "Bzip2"), ("xz", "Xz"), ("zst", "Zstd"), ("lz4", "Lz4"), ("br", "Brotli"))},
}

_READ = ("zip", "sevenz", "tar_zst", "cpio", "ar", "deb", "rpm", "cab", "conda", "sfx")


def _list_query(name: str):
    ext, writer, _, _ = _PACKED[name]
    return lambda spark, d: _listing(scan.list_entries(pack_rows(documents(spark, d, ext), writer)))


def _body_query(name: str):
    ext, writer, _, _ = _PACKED[name]
    return lambda spark, d: _bodies(scan.list_entries(pack_rows(documents(spark, d, ext), writer), content=True))


# Trees: formats that list folders as well

_TREE_SQL = """WITH f AS (SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '{ext}' AS archive, lang, doc_id, {size} AS size FROM documents)
SELECT archive, '{format}' AS format, 'Dir' AS kind, lang AS path, CAST(0 AS BIGINT) AS size FROM f GROUP BY archive, lang
UNION ALL SELECT archive, '{format}', 'File', lang || '/' || CAST(doc_id AS VARCHAR) || '.txt', size FROM f"""


def _tree(spark, d, ext, writer):
    return scan.list_entries(pack_rows(documents(spark, d, ext), writer)).select("archive", "format", "kind", "path", "size")


# Small archives: ten documents or one in each


def _msi(files):
    """Each document a component in a folder of its language."""
    rows = [(f"f{i}", f"c{i}", *n.split("/"), b) for i, (n, b) in enumerate(files)]
    tables = {
        "Media": ({"DiskId": "i", "LastSequence": "i", "Cabinet": "s"}, [(1, len(rows), "#cab1")]),
        "Directory": ({"Directory": "s", "Directory_Parent": "s", "DefaultDir": "s"}, [("TARGETDIR", None, "SourceDir"), *((f"D_{x}", "TARGETDIR", f"{x.upper()}~1|{x}") for x in sorted({r[2] for r in rows}))]),
        "Component": ({"Component": "s", "Directory_": "s"}, [(c, f"D_{folder}") for _, c, folder, _, _ in rows]),
        "File": ({"File": "s", "Component_": "s", "FileName": "s"}, [(f, c, f"{f.upper()}~1.TXT|{name}") for f, c, _, name, _ in rows]),
    }
    return pack.msi_bytes(tables, {"cab1": pack.cab_bytes([(r[0], r[4]) for r in rows])})


def _locked_zip(files):
    """The old cipher and the strong one by turns."""
    return pack.locked_zip_bytes(files, "secret", int(files[0][0][:-4]) // 10 % 2 == 1)


def _dmg(files):
    return pack.dmg_bytes(pack.hfs_bytes(files))


#: name: (extension, writer, format reported, documents of an archive, path in SQL)
_SMALL: dict[str, tuple[str, Callable, str, int, str]] = {
    **{n: (f".{e}", w, f, 10, "CAST(doc_id AS VARCHAR) || '.txt'") for n, e, w, f in (
        ("rar", "rar", pack.rar_bytes, "Rar"), ("squashfs", "sqfs", pack.squashfs_bytes, "Squashfs"), ("appimage", "AppImage", pack.appimage_bytes, "AppImage"),
        ("hfs", "hfs", pack.hfs_bytes, "HfsPlus"), ("dmg", "dmg", _dmg, "Dmg"), ("arc", "arc", pack.arc_bytes, "Arc"), ("lbr", "lbr", pack.lbr_bytes, "Lbr"),
        ("alz", "alz", pack.alz_bytes, "Alz"), ("arj", "arj", pack.arj_bytes, "Arj"), ("zoo", "zoo", pack.zoo_bytes, "Zoo"), ("stuffit", "sit", pack.stuffit_bytes, "StuffIt"),
        ("locked_zip", "zip", _locked_zip, "Zip"),
    )},
    "msi": (".msi", _msi, "Msi", 10, "lang || '/' || CAST(doc_id AS VARCHAR) || '.txt'"),
    **{n: (f".{n}", w, f, 1, "CAST(doc_id AS VARCHAR) || '.txt'") for n, w, f in (("macbinary", pack.macbinary_bytes, "MacBinary"), ("applesingle", pack.applesingle_bytes, "AppleSingle"), ("hqx", pack.binhex_bytes, "BinHex"))},
    "dms": (".dms", pack.dms_bytes, "Dms", 1, "CAST(doc_id AS VARCHAR) || '.adf'"),
}


def small_archives(spark, d, name: str) -> DataFrame:
    ext, writer, _, n, _ = _SMALL[name]
    docs = _table(spark, d, "documents")
    own = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    rows = docs.select(
        F.concat(F.expr(f"doc_id div {n}").cast("string"), F.lit(ext)).alias("archive"), (F.concat_ws("/", "lang", own) if name == "msi" else own).alias("name"),
        F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.col("doc_id").alias("seq"),
    )
    return pack_rows(rows, writer)


def _small_query(name: str):
    def run(spark, d):
        entries = scan.list_entries(small_archives(spark, d, name), content=True, password="secret").where("kind = 'File'")
        # A disk image's size is known only when it is read.
        size = F.when(F.col("format") == "Dms", F.octet_length("content")).otherwise(F.col("size")).cast("long").alias("size")
        return entries.select("archive", "format", "path", "is_encrypted", size, F.md5("content").alias("body_md5"))

    return run


def _small_sql(name: str) -> str:
    ext, _, format, n, path = _SMALL[name]
    return f"""SELECT CAST(doc_id // {n} AS VARCHAR) || '{ext}' AS archive, '{format}' AS format, {path} AS path, {"true" if name == "locked_zip" else "false"} AS is_encrypted,
        {_SIZE} AS size, md5(coalesce(text, '')) AS body_md5 FROM documents"""


# The sink


def _with_evil(files):
    return pack.zip_bytes([*files, ("../evil.txt", b"x"), ("__MACOSX/._a", b"y"), ("/etc/evil", b"z")])


def _folder(spark) -> str:
    """A folder that driver and executors share; the sink writes through the file system."""
    import tempfile
    import uuid

    named = spark.conf.get("spark.checkpoint.dir", None)
    return f"{named.removeprefix('file://')}/extract-{uuid.uuid4().hex}" if named else tempfile.mkdtemp(prefix="coffer-extract-")


def _tens(spark, d) -> DataFrame:
    rows = _table(spark, d, "documents").select(F.concat(F.expr("doc_id div 10").cast("string"), F.lit(".zip")).alias("archive"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("body"), F.col("doc_id").alias("seq"))
    return pack_rows(rows, _with_evil)


def extract_status(spark, d):
    """What the sink says of every entry: documents are written, metadata is passed over, and what
    would lie outside fails."""
    from ..operators import extract as E

    return E.extract_archives(_tens(spark, d), _folder(spark)).select("archive", F.col("idx").cast("long").alias("idx"), "path", "status", "error_class", "bytes")


_STATUS_SQL = f"""WITH f AS (SELECT CAST(doc_id // 10 AS VARCHAR) || '.zip' AS archive, doc_id, CAST(doc_id AS VARCHAR) || '.txt' AS path, {_SIZE} AS bytes FROM documents)
SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id) - 1 AS idx, path, 'OK' AS status, NULL AS error_class, bytes FROM f
UNION ALL SELECT archive, count(*), '../evil.txt', 'FAILED', 'PATH_TRAVERSAL', NULL FROM f GROUP BY archive
UNION ALL SELECT archive, count(*) + 2, '/etc/evil', 'FAILED', 'PATH_TRAVERSAL', NULL FROM f GROUP BY archive"""


def extract_written(spark, d):
    """The files that the sink wrote, each archive in a folder of its name."""
    from ..operators import extract as E

    to = _folder(spark)
    E.extract_archives(_tens(spark, d), to).write.format("noop").mode("overwrite").save()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(to)
    return files.select(F.substring_index("path", "/", -2).alias("path"), F.col("length").alias("size"), F.md5("content").alias("body_md5"))


_WRITTEN_SQL = f"SELECT CAST(doc_id // 10 AS VARCHAR) || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, {_SIZE} AS size, md5(coalesce(text, '')) AS body_md5 FROM documents"


# Single compressed files

_KINDS = ("Gzip", "Bzip2", "Xz", "Zstd", "Lz4", "Brotli")
_EXTS = (".gz", ".bz2", ".xz", ".zst", ".lz4", ".br")


def compressed_documents(spark, d) -> DataFrame:
    ship(spark)
    rows = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("body"))

    def run(batches):
        for b in batches:
            paths, raw = [], []
            for i, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                paths.append(f"{i}.txt{_EXTS[i % 6]}")
                raw.append(pack.compress(body, _KINDS[i % 6], 1700000000 + i))
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(raw, pa.binary())], names=["path", "content"])

    return rows.mapInArrow(run, FILES)


def raw_files(spark, d):
    return _listing(scan.list_entries(compressed_documents(spark, d)))


_RAW_SQL = f"""SELECT CAST(doc_id AS VARCHAR) || '.txt' || ['.gz', '.bz2', '.xz', '.zst', '.lz4', '.br'][doc_id % 6 + 1] AS archive, 'Raw' AS format, CAST(0 AS BIGINT) AS idx,
    CAST(doc_id AS VARCHAR) || '.txt' AS path, 'File' AS kind, {_SIZE} AS size, CASE WHEN doc_id % 6 = 0 THEN 1700000000 + doc_id END AS modified_s FROM documents"""


def detected_compressors(spark, d):
    files = compressed_documents(spark, d)
    kind = F.coalesce(X.detect_compressor("content"), X.compressor_by_name("path"))
    return files.select("path", kind.alias("compressor"), X.stem_without_compressor("path").alias("stem"), X.gzip_mtime(F.when(kind == "Gzip", F.col("content"))).alias("mtime"))


_COMPRESSOR_SQL = """SELECT CAST(doc_id AS VARCHAR) || '.txt' || ['.gz', '.bz2', '.xz', '.zst', '.lz4', '.br'][doc_id % 6 + 1] AS path,
    ['Gzip', 'Bzip2', 'Xz', 'Zstd', 'Lz4', 'Brotli'][doc_id % 6 + 1] AS compressor, CAST(doc_id AS VARCHAR) || '.txt' AS stem,
    CASE WHEN doc_id % 6 = 0 THEN 1700000000 + doc_id END AS mtime FROM documents"""


def decompressed(spark, d):
    files = compressed_documents(spark, d)
    kind = F.coalesce(X.detect_compressor("content"), X.compressor_by_name("path"))
    return files.select("path", F.md5(scan.decompress(F.col("content"), kind)).alias("body_md5"))


_DECOMPRESSED_SQL = """SELECT CAST(doc_id AS VARCHAR) || '.txt' || ['.gz', '.bz2', '.xz', '.zst', '.lz4', '.br'][doc_id % 6 + 1] AS path, md5(coalesce(text, '')) AS body_md5 FROM documents"""


# Detection

_BUNDLES = ("jar", "apk", "ipa", "epub", "docx", "xlsx", "pptx", "odt", "ods", "odp", "zip")


def bundles(spark, d):
    """Suppliers, each a bundle of one entry whose format follows from the extension."""
    s = _table(spark, d, "supplier")
    ext = F.element_at(F.array(*map(F.lit, _BUNDLES)), (F.col("s_suppkey") % 11 + 1).cast("int"))
    rows = s.select(F.concat(F.col("s_suppkey").cast("string"), F.lit("."), ext).alias("archive"), F.col("s_name").alias("name"), F.col("s_name").cast("binary").alias("body"), F.lit(0).alias("seq"))
    return scan.list_entries(pack_rows(rows, pack.zip_bytes)).select("archive", "format", "path", "size")


_BUNDLE_SQL = """SELECT CAST(s_suppkey AS VARCHAR) || '.' || ['jar', 'apk', 'ipa', 'epub', 'docx', 'xlsx', 'pptx', 'odt', 'ods', 'odp', 'zip'][s_suppkey % 11 + 1] AS archive,
    ['Jar', 'Apk', 'Ipa', 'Epub', 'Docx', 'Xlsx', 'Pptx', 'Odt', 'Ods', 'Odp', 'Zip'][s_suppkey % 11 + 1] AS format, s_name AS path, CAST(octet_length(encode(s_name)) AS BIGINT) AS size FROM supplier"""

# First bytes in hexadecimal, a name, and what they are.
_HEADERS = [("504b0304", "a.zip", "Zip", 100), ("504b0304", "a.JAR", "Jar", 100), ("504b0304", "a.conda", "Conda", 100), ("504b0506", "e.bin", "Zip", 100), ("43723234", "x.crx", "Crx", 100), ("303730373031", "x", "Cpio", 100), ("377abcaf271c", "x", "SevenZ", 100), ("526172211a0700", "x", "Rar", 100), ("4d534346", "x", "Cab", 100), ("213c617263683e0a", "x.a", "Ar", 100), ("213c617263683e0a64656269616e2d62696e6172792020202020", "x.deb", "Deb", 100), ("edabeedb", "x.rpm", "Rpm", 100), ("78617221", "x.pkg", "Xar", 100), ("d0cf11e0a1b11ae1", "x.msi", "Msi", 100), ("00", "x.iso", "Iso", 50), ("4d5a", "x.iso", "Iso", 50), ("4d5a", "x.exe", "Sfx", 50), ("68737173", "x", "Squashfs", 100), ("7f454c4602010100414902", "x", "AppImage", 100), ("4d5357494d000000", "x", "Wim", 100), ("574152432f312e30", "x", "Warc", 100), ("00", "x.hfsx", "HfsPlus", 50), ("00", "x.dmg", "Dmg", 100), ("414c5a01", "x", "Alz", 100), ("50503230", "x", "PowerPacker", 100), ("4c5a5800", "x", "Lzx", 100), ("444d5321", "x", "Dms", 100), ("76ff0000", "x", "Squeeze", 100), ("76fe4142", "x", "Crunch", 100), ("00", "x.arc", "Arc", 100), ("00051607", "x", "AppleSingle", 100), ("504d6167", "x", "PackIt", 100)]


def detect_top1(spark, d):
    """Which rule wins for the header that a part's key chooses, over all parts."""
    heads = spark.createDataFrame([(i, h, n) for i, (h, n, _, _) in enumerate(_HEADERS)], "i long, head string, name string")
    parts = _table(spark, d, "part").select("p_partkey")
    files = parts.join(F.broadcast(heads), F.col("p_partkey") % len(_HEADERS) == F.col("i"))
    files = files.select(F.concat_ws("/", F.col("p_partkey").cast("string"), "name").alias("path"), F.unhex("head").alias("content"))
    return scan.winners(scan.probes(files)).select("archive", "format", F.col("confidence").cast("long").alias("confidence"))


_DETECT_SQL = "WITH h(i, name, format, confidence) AS (VALUES " + ", ".join(f"({i}, '{n}', '{f}', CAST({c} AS BIGINT))" for i, (_, n, f, c) in enumerate(_HEADERS)) + f") SELECT CAST(p_partkey AS VARCHAR) || '/' || name AS archive, format, confidence FROM part JOIN h ON p_partkey % {len(_HEADERS)} = i"


# Scalar functions

_PATHS = "[p_name, replace(p_name, ' ', '/'), '../' || p_name, replace(p_name, ' ', '/../'), '/' || p_name, './' || replace(p_name, ' ', '/./'), 'a' || chr(92) || p_name, '__MACOSX/' || p_name, 'x/.DS_Store', 'x/._' || p_name][p_partkey % 10 + 1]"


def _paths(spark, d) -> DataFrame:
    p = _table(spark, d, "part")
    n = F.col("p_name")
    slashed = lambda s: F.replace(n, F.lit(" "), F.lit(s))
    forms = F.array(n, slashed("/"), F.concat(F.lit("../"), n), slashed("/../"), F.concat(F.lit("/"), n), F.concat(F.lit("./"), slashed("/./")), F.concat(F.lit("a\\"), n), F.concat(F.lit("__MACOSX/"), n), F.lit("x/.DS_Store"), F.concat(F.lit("x/._"), n))
    return p.select("p_partkey", F.element_at(forms, (F.col("p_partkey") % 10 + 1).cast("int")).alias("path"))


def safe_paths(spark, d):
    return _paths(spark, d).select("p_partkey", "path", X.safe_join(F.lit("/out"), "path").alias("joined"), X.is_macos_metadata("path").alias("is_metadata"), X.wrapper_name(F.concat(F.col("path"), F.lit(".tar.gz"))).alias("wrapper"))


_SAFE_SQL = f"""WITH p AS (SELECT p_partkey, {_PATHS} AS path FROM part), q AS (SELECT *, replace(path, chr(92), '/') AS t FROM p)
SELECT p_partkey, path, CASE WHEN list_contains(string_split(t, '/'), '..') OR starts_with(t, '/') THEN NULL
    ELSE '/out/' || array_to_string(list_filter(string_split(t, '/'), lambda x: x <> '' AND x <> '.'), '/') END AS joined,
  list_contains(string_split(path, '/'), '__MACOSX') OR string_split(path, '/')[-1] = '.DS_Store' OR starts_with(string_split(path, '/')[-1], '._') AS is_metadata,
  string_split(path, '/')[-1] || '.tar' AS wrapper FROM q"""


def symlink_targets(spark, d):
    link = F.concat(F.col("p_brand"), F.lit("/links/l"))
    target = F.concat(F.repeat(F.lit("../"), (F.col("p_size") % 5).cast("int")), F.col("p_name"))
    return _table(spark, d, "part").select("p_partkey", target.alias("target"), X.safe_symlink_target(link, target).isNotNull().alias("is_safe"))


_LINK_SQL = "SELECT p_partkey, repeat('../', p_size % 5) || p_name AS target, p_size % 5 <= 2 AS is_safe FROM part"


def uri_paths(spark, d):
    return _table(spark, d, "pages").select("page_id", X.uri_to_path("url").alias("path"))


_URI_SQL = """WITH p AS (SELECT page_id, list_transform(list_filter(string_split(string_split(string_split(regexp_replace(url, '^.*?://', ''), '?')[1], '#')[1], '/'), lambda x: x <> '' AND x <> '.'), lambda x: CASE WHEN x = '..' THEN '_' ELSE x END) AS parts FROM pages)
SELECT page_id, CASE WHEN len(parts) = 0 THEN 'index' ELSE array_to_string(parts, '/') END AS path FROM p"""


def dates(spark, d):
    """Seconds of events through the encodings of dates that archives have."""
    ts = F.col("ts").cast("timestamp")
    s = F.unix_seconds(ts)
    part = lambda f: F.date_format(ts, f)
    text = part("yyyy-MM-dd'T'HH:mm:ss'Z'")
    civil = X.civil_seconds(F.year(ts), F.month(ts), F.lit(31), F.hour(ts), F.minute(ts), F.second(ts))
    return _table(spark, d, "events").select(
        "event_id", X.filetime_seconds((s + 11644473600) * 10000000).alias("from_filetime"), X.hfs_seconds(s + 2082844800).alias("from_hfs"),
        X.warc_seconds(text).alias("from_warc"), X.xar_seconds(F.substring(text, 1, 19)).alias("from_xar"), civil.alias("on_31st"),
    )


_DATE_SQL = """SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS from_filetime, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS from_hfs, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS from_warc,
    CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS from_xar, CAST(epoch(date_trunc('month', ts)) AS BIGINT) + 30 * 86400 + CAST(date_part('hour', ts) * 3600 + date_part('minute', ts) * 60 + floor(date_part('second', ts)) AS BIGINT) AS on_31st FROM events"""


def msi_names(spark, d):
    value = F.concat(F.substring("p_name", 1, 8), F.lit("|"), F.col("p_name"), F.lit(":src"))
    return _table(spark, d, "part").select("p_partkey", X.default_dir_name(value).alias("dir_name"), X.file_long_name(F.concat(F.lit("S~1|"), F.col("p_name"))).alias("file_name"))


_NAME_SQL = "SELECT p_partkey, p_name AS dir_name, p_name AS file_name FROM part"


def headers(spark, d):
    """Numbers, codecs and kinds that expressions read from bytes and modes."""
    p = _table(spark, d, "part")
    n = F.col("p_partkey")
    four = F.unhex(F.lpad(F.hex(n), 8, "0"))
    little = F.concat(*(F.substring(four, k, 1) for k in (4, 3, 2, 1)))
    crx = F.concat(F.lit(b"Cr24\3\0\0\0"), little)
    mode = F.element_at(F.array(F.lit(0o100644), F.lit(0o040755), F.lit(0o120777), F.lit(0o020600)), (n % 4 + 1).cast("int"))
    start = F.concat(F.lit(bytes(8)), four, F.lit(bytes(20)))
    return p.select(
        "p_partkey", X.little_endian(little, 0, 4).alias("number"), X.crx_zip_offset(crx).alias("zip_at"), X.kind_of_mode(mode).alias("kind"),
        X.permissions(mode).cast("long").alias("permissions"), X.strip_http_headers(F.concat(F.lit(b"H: 1\r\n\r\n"), F.col("p_name").cast("binary"))).cast("string").alias("payload"),
        X.start_header_ok(start).alias("is_7z"), X.decode_utf16le(F.encode("p_name", "UTF-16LE")).alias("name"),
    )


_HEADER_SQL = """SELECT p_partkey, p_partkey AS number, 12 + p_partkey AS zip_at, ['File', 'Dir', 'Symlink', NULL][p_partkey % 4 + 1] AS kind,
    CAST([420, 493, 511, 384][p_partkey % 4 + 1] AS BIGINT) AS permissions, p_name AS payload, false AS is_7z, p_name AS name FROM part"""


# Relations over entries


def common_roots(spark, d):
    files = pack_rows(documents(spark, d, ".zip"), pack.zip_bytes).unionByName(pack_rows(_mixed(spark, d), pack.zip_bytes))
    return R.common_root(scan.list_entries(files))


def _mixed(spark, d):
    """An archive for each nation whose entries have several first parts."""
    c = _table(spark, d, "customer")
    return c.select(F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("-"), F.expr("c_custkey div 1000").cast("string"), F.lit(".zip")).alias("archive"), F.concat_ws("/", "c_mktsegment", "c_name").alias("name"), F.col("c_name").cast("binary").alias("body"), F.col("c_custkey").alias("seq"))


_ROOT_SQL = """SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '.zip' AS archive, lang AS root FROM documents GROUP BY lang, doc_id // 1000
UNION ALL SELECT 'nation' || CAST(c_nationkey AS VARCHAR) || '-' || CAST(c_custkey // 1000 AS VARCHAR) || '.zip', CASE WHEN min(c_mktsegment) = max(c_mktsegment) THEN min(c_mktsegment) END FROM customer GROUP BY c_nationkey, c_custkey // 1000"""


def selected_bodies(spark, d):
    """Bodies of every third entry, each archive read in one pass."""
    files = pack_rows(documents(spark, d, ".zip"), pack.zip_bytes)
    chosen = scan.list_entries(files).where("idx % 3 = 0").select("archive", "idx")
    return scan.read_entries(files, chosen).select("archive", F.col("idx").cast("long").alias("idx"), F.md5("content").alias("body_md5"))


_SELECTED_SQL = """SELECT * FROM (SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '.zip' AS archive,
    row_number() OVER (PARTITION BY lang, doc_id // 1000 ORDER BY doc_id) - 1 AS idx, md5(coalesce(text, '')) AS body_md5 FROM documents) WHERE idx % 3 = 0"""


def visible_entries(spark, d):
    """Entries that are no metadata of a Macintosh, of archives of parts."""
    rows = _paths(spark, d).select(F.concat(F.expr("p_partkey div 1000").cast("string"), F.lit(".tar")).alias("archive"), F.col("path").alias("name"), F.lit(b"x").alias("body"), F.col("p_partkey").alias("seq"))
    entries = scan.list_entries(pack_rows(rows, pack.tar_bytes))
    return R.without_macos_metadata(entries).groupBy("archive").agg(F.count(F.lit(1)).alias("n"), F.min("idx").cast("long").alias("first_idx"))


_VISIBLE_SQL = """SELECT CAST(p_partkey // 1000 AS VARCHAR) || '.tar' AS archive, count(*) AS n, CAST(min(idx) AS BIGINT) AS first_idx
    FROM (SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey // 1000 ORDER BY p_partkey) - 1 AS idx FROM part) WHERE p_partkey % 10 < 7 GROUP BY p_partkey // 1000"""


def extract_plans(spark, d):
    rows = _paths(spark, d).select(F.concat(F.expr("p_partkey div 1000").cast("string"), F.lit(".tar")).alias("archive"), F.col("path").alias("name"), F.lit(b"x").alias("body"), F.col("p_partkey").alias("seq"))
    return R.extract_report(R.extract_plan(scan.list_entries(pack_rows(rows, pack.tar_bytes))))


_PLAN_SQL = f"""WITH p AS (SELECT p_partkey, {_PATHS} AS path FROM part), q AS (SELECT p_partkey, list_contains(string_split(path, '/'), '..') OR starts_with(path, '/') AS bad FROM p WHERE p_partkey % 10 < 7)
SELECT CAST(p_partkey // 1000 AS VARCHAR) || '.tar' AS archive, count(*) FILTER (WHERE NOT bad) AS extracted, count(*) FILTER (WHERE bad) AS failed FROM q GROUP BY p_partkey // 1000"""


def _warc_files(spark, d, packed: bool) -> DataFrame:
    """Archives of pages; every page twice, so that names repeat."""
    ship(spark)
    p = _table(spark, d, "pages").select((F.expr("page_id div 100")).alias("of"), "page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    ext = ".warc.gz" if packed else ".warc"

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["page_id"])
        records = [(kind, r["url"], r["html"].encode()) for kind in ("response", "resource") for r in rows]
        return pa.table([pa.array([f"{rows[0]['of']}{ext}"]), pa.array([pack.warc_bytes(records, packed)], pa.binary())], names=["path", "content"])

    return p.groupBy("of").applyInArrow(run, FILES)


def warc_list(spark, d, packed: bool = False):
    entries = scan.list_entries(_warc_files(spark, d, packed), content=True)
    return entries.select("archive", "format", F.col("idx").cast("long").alias("idx"), "path", "size", F.unix_seconds("modified").alias("modified_s"), F.md5("content").alias("body_md5"))


def _warc_sql(ext: str) -> str:
    return f"""WITH p AS (SELECT page_id, page_id // 100 AS of, coalesce(html, '') AS html, list_transform(list_filter(string_split(string_split(string_split(regexp_replace(url, '^.*?://', ''), '?')[1], '#')[1], '/'), lambda x: x <> '' AND x <> '.'), lambda x: CASE WHEN x = '..' THEN '_' ELSE x END) AS parts FROM pages),
q AS (SELECT page_id, of, html, visit, CASE WHEN len(parts) = 0 THEN 'index' ELSE array_to_string(parts, '/') END AS base FROM p, (VALUES (0), (1)) v(visit)),
r AS (SELECT *, row_number() OVER (PARTITION BY of ORDER BY visit, page_id) - 1 AS idx, row_number() OVER (PARTITION BY of, base ORDER BY visit, page_id) - 1 AS again FROM q)
SELECT CAST(of AS VARCHAR) || '{ext}' AS archive, 'Warc' AS format, idx, base || CASE WHEN again > 0 THEN '-' || CAST(again AS VARCHAR) ELSE '' END AS path,
  CAST(octet_length(encode(html)) AS BIGINT) AS size, CAST(1709294400 AS BIGINT) AS modified_s, md5(html) AS body_md5 FROM r"""


def warc_relation(spark, d):
    """The same naming and de-duplication as DataFrame windows, over records."""
    p = _table(spark, d, "pages")
    kinds = [F.struct(F.lit(i).alias("visit"), F.lit(t).alias("type")) for i, t in enumerate(("response", "resource", "request"))]
    visits = p.withColumn("v", F.explode(F.array(*kinds))).select("*", "v.*")
    head = F.when(F.col("type") == "response", F.lit(b"HTTP/1.1 200 OK\r\nA: b\r\n\r\n")).otherwise(F.lit(b""))
    block = F.concat(head, F.coalesce("html", F.lit("")).cast("binary"))
    records = visits.select((F.expr("page_id div 100")).cast("string").alias("archive"), (F.col("visit") * 100 + F.col("page_id") % 100).alias("record_no"), "type", F.col("url").alias("uri"), F.lit("2024-03-01T12:00:00Z").alias("date"), block.alias("block"))
    return R.warc_entries(records).select("archive", F.col("idx").cast("long").alias("idx"), "path", "modified_s", F.md5("content").alias("body_md5"))


_RELATION_SQL = "SELECT regexp_replace(archive, '[.]warc$', '') AS archive, idx, path, modified_s, body_md5 FROM (" + _warc_sql(".warc") + ")"


def warc_nameless(spark, d):
    """Records half of which have no address: they are named by how many entries come before."""
    p = _table(spark, d, "pages")
    uri = F.when(F.col("page_id") % 2 == 1, F.col("url"))
    records = p.select(F.expr("page_id div 100").cast("string").alias("archive"), F.col("page_id").alias("record_no"), F.lit("resource").alias("type"), uri.alias("uri"), F.lit("2024-03-01T12:00:00Z").alias("date"), F.coalesce("html", F.lit("")).cast("binary").alias("block"))
    return R.warc_entries(records).select("archive", F.col("idx").cast("long").alias("idx"), "path", F.md5("content").alias("body_md5"))


_NAMELESS_SQL = """WITH p AS (SELECT page_id, page_id // 100 AS of, coalesce(html, '') AS html, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) - 1 AS idx, list_transform(list_filter(string_split(string_split(string_split(regexp_replace(url, '^.*?://', ''), '?')[1], '#')[1], '/'), lambda x: x <> '' AND x <> '.'), lambda x: CASE WHEN x = '..' THEN '_' ELSE x END) AS parts FROM pages),
q AS (SELECT *, CASE WHEN page_id % 2 = 0 THEN 'record-' || CAST(idx AS VARCHAR) WHEN len(parts) = 0 THEN 'index' ELSE array_to_string(parts, '/') END AS base FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY of, base ORDER BY page_id) - 1 AS again FROM q)
SELECT CAST(of AS VARCHAR) AS archive, idx, base || CASE WHEN again > 0 THEN '-' || CAST(again AS VARCHAR) ELSE '' END AS path, md5(html) AS body_md5 FROM r"""


def _msi_tables(spark, d):
    """Regions and nations as folders, suppliers as files, the first region below itself and two
    folders in a circle."""
    region, nation, supplier = (_table(spark, d, t) for t in ("region", "nation", "supplier"))
    directories = region.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("directory"), F.lit("TARGETDIR").alias("parent"), F.concat(F.lit("SHORT~1|"), F.col("r_name")).alias("default_dir"))
    directories = directories.unionByName(nation.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("directory"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.col("n_name"), F.lit(":SRC")).alias("default_dir")))
    extra = spark.createDataFrame([("TARGETDIR", None, "SourceDir"), ("A", "B", "A"), ("B", "A", "B"), ("DOT", "R0", ".")], "directory string, parent string, default_dir string")
    components = supplier.select(F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("component"), F.when(F.col("s_suppkey") % 7 == 0, "DOT").when(F.col("s_suppkey") % 7 == 1, "A").otherwise(F.concat(F.lit("N"), F.col("s_nationkey").cast("string"))).alias("directory"))
    files = supplier.where("s_suppkey % 11 <> 0").select(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("file"), F.concat(F.lit("C"), F.col("s_suppkey").cast("string")).alias("component"), F.concat(F.lit("S~1|"), F.col("s_name")).alias("file_name"))
    members = supplier.select(F.concat(F.lit("F"), F.col("s_suppkey").cast("string")).alias("name"))
    return members, files, components, directories.unionByName(extra)


def msi_paths(spark, d):
    return R.msi_paths(*_msi_tables(spark, d))


_MSI_SQL = """SELECT 'F' || CAST(s_suppkey AS VARCHAR) AS name, CASE WHEN s_suppkey % 11 = 0 THEN 'F' || CAST(s_suppkey AS VARCHAR)
    WHEN s_suppkey % 7 = 0 THEN (SELECT r_name FROM region WHERE r_regionkey = 0) || '/' || s_name
    WHEN s_suppkey % 7 = 1 THEN 'B/A/' || s_name ELSE r_name || '/' || n_name || '/' || s_name END AS path
    FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""


def msi_many(spark, d):
    """The same tables in two archives at once, in the second with other names: keys don't mix."""
    members, files, components, directories = _msi_tables(spark, d)
    twice = lambda df, change: df.withColumn("archive", F.lit("a.msi")).unionByName(df.withColumns({**change, "archive": F.lit("b.msi")}))
    tables = twice(members, {}), twice(files, {"file_name": F.concat("file_name", F.lit(".b"))}), twice(components, {}), twice(directories, {"default_dir": F.when(F.col("default_dir") == ".", ".").otherwise(F.concat(F.lit("x"), F.regexp_extract("default_dir", r"([^|:]*)(:.*)?$", 1)))})
    return R.msi_paths(*tables).select("archive", "name", "path")


_MSI_MANY_SQL = f"""WITH m AS ({_MSI_SQL})
SELECT 'a.msi' AS archive, name, path FROM m UNION ALL
SELECT 'b.msi', name, CASE WHEN path NOT LIKE '%/%' THEN path ELSE 'x' || replace(regexp_replace(path, '/[^/]*$', ''), '/', '/x') || '/' || regexp_extract(path, '[^/]*$') || '.b' END FROM m"""


def wim_join(spark, d):
    """Documents as entries of images, their bodies found by hash."""
    docs = _table(spark, d, "documents").select("doc_id", "lang", F.coalesce("text", F.lit("")).cast("binary").alias("body"))
    hashed = docs.select("doc_id", "lang", F.unhex(F.sha1("body")).alias("hash"), F.octet_length("body").cast("long").alias("size"))
    lookup = hashed.select(F.col("lang").alias("archive"), "hash", "size", F.col("doc_id").alias("resource_offset"), F.col("doc_id").alias("row_no"))
    dentries = hashed.select(F.col("lang").alias("archive"), F.col("doc_id").alias("idx"), F.when(F.col("doc_id") % 13 == 0, F.lit(bytes(20))).otherwise(F.col("hash")).alias("hash"))
    return R.wim_bodies(dentries, lookup).select("archive", "idx", "size", "resource_offset")


_WIM_SQL = f"""WITH h AS (SELECT doc_id, lang, sha1(coalesce(text, '')) AS hash, {_SIZE} AS size FROM documents), l AS (SELECT lang, hash, max(doc_id) AS last, max(size) AS size FROM h GROUP BY lang, hash)
SELECT h.lang AS archive, doc_id AS idx, CASE WHEN doc_id % 13 = 0 THEN 0 ELSE l.size END AS size, CASE WHEN doc_id % 13 <> 0 THEN last END AS resource_offset FROM h JOIN l ON h.lang = l.lang AND h.hash = l.hash"""


def volumes(spark, d):
    """Archives cut into three parts; of every fifth archive the second part is missing."""
    ship(spark)
    whole = pack_rows(documents(spark, d, ".zip"), pack.zip_bytes)
    cut = F.ceil(F.octet_length("content") / 3).cast("int")
    parts = whole.select("path", "content", cut.alias("cut")).select("path", "content", "cut", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k"))
    parts = parts.select(F.concat(F.col("path"), F.format_string(".%03d", F.col("k") + 1)).alias("path"), F.substring("content", F.col("k") * F.col("cut") + 1, F.col("cut")).alias("content"), "k", F.col("path").alias("of"))
    parts = parts.where("NOT (k = 1 AND of LIKE 'de-%')").select("path", "content")
    members = R.volume_members(parts).groupBy("volume").agg(F.max("n").alias("parts"))
    good = R.assemble_volumes(parts.where("path NOT LIKE 'de-%'"))
    listed = scan.list_entries(good).groupBy("archive").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("size"))
    return members.join(listed, F.col("volume") == F.col("archive"), "left").select("volume", F.col("parts").cast("long").alias("parts"), "entries", "size")


_VOLUME_SQL = f"""SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '.zip' AS volume, CAST(CASE WHEN lang = 'de' THEN 1 ELSE 3 END AS BIGINT) AS parts,
    CASE WHEN lang <> 'de' THEN count(*) END AS entries, CASE WHEN lang <> 'de' THEN CAST(sum({_SIZE}) AS BIGINT) END AS size FROM documents GROUP BY lang, doc_id // 1000"""


def dmg_tables(spark, d):
    """Order lines as chunks of images."""
    rows = _table(spark, d, "lineitem").select(F.col("l_suppkey").cast("string").alias("archive"), F.element_at(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(0x80000005), F.lit(0x7FFFFFFE)), (F.col("l_linenumber") % 5 + 1).cast("int")).alias("type"), F.col("l_orderkey").alias("sector"), F.col("l_quantity").cast("long").alias("sectors"))
    return R.dmg_sectors(rows)


_DMG_SQL = "SELECT CAST(l_suppkey AS VARCHAR) AS archive, max(l_orderkey + CAST(l_quantity AS BIGINT)) AS total_sectors, count(*) FILTER (WHERE l_linenumber % 5 IN (1, 3)) AS data_chunks FROM lineitem GROUP BY l_suppkey"


def chunk_spans(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_custkey").alias("resource"), F.col("o_orderkey").alias("chunk"), (F.col("o_orderkey") * 10).alias("offset"), F.lit(1 << 40).alias("length"))
    return R.chunk_spans(rows)


_SPAN_SQL = "SELECT o_custkey AS resource, o_orderkey AS chunk, o_orderkey * 10 AS start, coalesce(lead(o_orderkey * 10) OVER (PARTITION BY o_custkey ORDER BY o_orderkey), 1099511627776) AS \"end\" FROM orders"


def name_votes(spark, d):
    """Whether an archive's names are all UTF-8: half of the archives have Latin-1 names."""
    ship(spark)
    rows = documents(spark, d, ".tar").select("archive", F.concat(F.lit("é"), "name").alias("name"), "body", "seq")
    files = pack_rows(rows, pack.tar_bytes)
    entries = scan.list_entries(files)
    raw = F.when(F.startswith(F.col("archive"), F.lit("en")), F.col("path_raw")).otherwise(F.encode("path", "ISO-8859-1"))
    return R.encoding_of_names(entries.withColumn("path_raw", raw))


_VOTE_SQL = "SELECT lang || '-' || CAST(doc_id // 1000 AS VARCHAR) || '.tar' AS archive, lang = 'en' AS all_utf8, count(*) AS n_names FROM documents GROUP BY lang, doc_id // 1000"


def kinds_and_sizes(spark, d):
    """An archive of regions and nations: entries and bytes by format and kind."""
    region = _table(spark, d, "region").select(F.lit("world.zip").alias("archive"), F.concat(F.col("r_name"), F.lit("/")).alias("name"), F.lit(b"").alias("body"), F.col("r_regionkey").alias("seq"))
    nation = _table(spark, d, "nation").select(F.lit("world.zip").alias("archive"), F.col("n_name").alias("name"), F.col("n_name").cast("binary").alias("body"), (F.col("n_nationkey") + 1000).alias("seq"))
    entries = scan.list_entries(pack_rows(region.unionByName(nation), pack.zip_bytes))
    return entries.groupBy("format", "kind").agg(F.count(F.lit(1)).alias("entries"), F.sum("size").alias("total_size"))


_KIND_SQL = "SELECT 'Zip' AS format, 'Dir' AS kind, count(*) AS entries, CAST(0 AS BIGINT) AS total_size FROM region UNION ALL SELECT 'Zip', 'File', count(*), CAST(sum(octet_length(encode(n_name))) AS BIGINT) FROM nation"


def first_members(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("member_no"), F.when(F.col("l_linenumber") > 1, F.concat(F.lit("data.tar."), F.col("l_returnflag"))).otherwise("control.tar").alias("name"))
    return R.first_data_member(rows)


_FIRST_SQL = "SELECT l_orderkey AS archive, 'data.tar.' || chr(CAST(min(l_linenumber * 1000 + ascii(l_returnflag)) % 1000 AS INTEGER)) AS name, min(l_linenumber) AS member_no FROM lineitem WHERE l_linenumber > 1 GROUP BY l_orderkey"


def encrypted_first(spark, d):
    rows = _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), F.col("l_linenumber").alias("idx"), (F.col("l_returnflag") == "R").alias("is_encrypted"))
    return R.encrypted_archives(rows)


_ENCRYPTED_SQL = "SELECT l_orderkey AS archive, bool_or(l_returnflag = 'R') AS any_encrypted, min(l_linenumber) FILTER (WHERE l_returnflag = 'R') AS first_encrypted FROM lineitem GROUP BY l_orderkey"


def signature_places(spark, d):
    """Where the earliest signature is, in documents with one put behind 'text'."""
    t = _table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("b"))
    content = F.concat(F.col("b"), F.when(F.col("doc_id") % 2 == 0, F.lit(b"PK\3\4")).otherwise(F.lit(b"")), F.lit(b"MSCF"))
    return t.select("doc_id", R.earliest_signature(content, b"PK\3\4", b"7z\xbc\xaf\x27\x1c", b"Rar!\x1a\x07", b"MSCF").cast("long").alias("at"))


_PLACE_SQL = f"SELECT doc_id, {_SIZE} AS at FROM documents"


# The formats in the order in which equal rules are decided.
_FORMATS = (
    "Jar Apk Ipa Epub Docx Xlsx Pptx Odt Ods Odp Crx Conda Zip Cpio SevenZ Rar Tar Cab Deb Ar Rpm Xar Msi Iso Squashfs AppImage Wim Sfx Warc HfsPlus Apfs Dmg Arj Zoo Lbr Crunch Arc Squeeze BinHex MacBinary AppleSingle CompactPro PackIt StuffIt5 StuffIt StuffItX Alz Nsis PowerPacker Lzx Dms"
).split()
_REGISTRY_SQL = "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(_FORMATS)) + ") t(priority, format)"


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kinds_and_sizes(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        **{f"{n}_list": _list_query(n) for n in _PACKED},
        **{f"{n}_bodies": _body_query(n) for n in _READ},
        "xar_tree": lambda s, d: _tree(s, d, ".xar", pack.xar_bytes),
        "wim_tree": lambda s, d: _tree(s, d, ".wim", pack.wim_bytes),
        "iso_tree": lambda s, d: _tree(s, d, ".iso", pack.iso_bytes),
        **{f"{n}_files": _small_query(n) for n in _SMALL},
        "extract_status": extract_status,
        "extract_written": extract_written,
        "warc_nameless": warc_nameless,
        "registry": lambda s, d: scan.formats(s).select("priority", "format"),
        "msi_many": msi_many,
        "raw_files": raw_files,
        "detected_compressors": detected_compressors,
        "decompressed": decompressed,
        "bundles": bundles,
        "detect_top1": detect_top1,
        "safe_paths": safe_paths,
        "symlink_targets": symlink_targets,
        "uri_paths": uri_paths,
        "dates": dates,
        "msi_names": msi_names,
        "headers": headers,
        "common_roots": common_roots,
        "selected_bodies": selected_bodies,
        "visible_entries": visible_entries,
        "extract_plans": extract_plans,
        "warc_list": warc_list,
        "warc_gz_list": lambda s, d: warc_list(s, d, True),
        "warc_relation": warc_relation,
        "msi_paths": msi_paths,
        "wim_join": wim_join,
        "volumes": volumes,
        "dmg_tables": dmg_tables,
        "chunk_spans": chunk_spans,
        "name_votes": name_votes,
        "kinds_and_sizes": kinds_and_sizes,
        "first_members": first_members,
        "encrypted_first": encrypted_first,
        "signature_places": signature_places,
        "formats": lambda s, d: scan.formats(s),
    }


def oracle_sql() -> dict[str, str]:
    return {
        **{f"{n}_list": _doc_sql(e, f, m) for n, (e, _, f, m) in _PACKED.items()},
        **{f"{n}_bodies": _body_sql(_PACKED[n][0], _PACKED[n][2]) for n in _READ},
        "xar_tree": _TREE_SQL.format(ext=".xar", format="Xar", size=_SIZE),
        "wim_tree": _TREE_SQL.format(ext=".wim", format="Wim", size=_SIZE),
        "iso_tree": _TREE_SQL.format(ext=".iso", format="Iso", size=_SIZE),
        **{f"{n}_files": _small_sql(n) for n in _SMALL},
        "extract_status": _STATUS_SQL,
        "extract_written": _WRITTEN_SQL,
        "warc_nameless": _NAMELESS_SQL,
        "registry": _REGISTRY_SQL,
        "msi_many": _MSI_MANY_SQL,
        "raw_files": _RAW_SQL,
        "detected_compressors": _COMPRESSOR_SQL,
        "decompressed": _DECOMPRESSED_SQL,
        "bundles": _BUNDLE_SQL,
        "detect_top1": _DETECT_SQL,
        "safe_paths": _SAFE_SQL,
        "symlink_targets": _LINK_SQL,
        "uri_paths": _URI_SQL,
        "dates": _DATE_SQL,
        "msi_names": _NAME_SQL,
        "headers": _HEADER_SQL,
        "common_roots": _ROOT_SQL,
        "selected_bodies": _SELECTED_SQL,
        "visible_entries": _VISIBLE_SQL,
        "extract_plans": _PLAN_SQL,
        "warc_list": _warc_sql(".warc"),
        "warc_gz_list": _warc_sql(".warc.gz"),
        "warc_relation": _RELATION_SQL,
        "msi_paths": _MSI_SQL,
        "wim_join": _WIM_SQL,
        "volumes": _VOLUME_SQL,
        "dmg_tables": _DMG_SQL,
        "chunk_spans": _SPAN_SQL,
        "name_votes": _VOTE_SQL,
        "kinds_and_sizes": _KIND_SQL,
        "first_members": _FIRST_SQL,
        "encrypted_first": _ENCRYPTED_SQL,
        "signature_places": _PLACE_SQL,
    }
