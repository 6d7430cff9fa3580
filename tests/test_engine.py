"""The scan, expressions, relations, sink and stream on small inputs."""

import os

import pytest
from pyspark.sql import functions as F

from coffer.errors import ArchiveError
from coffer.functions import columns as X
from coffer.operators import extract as E
from coffer.operators import relational as R
from coffer.schema import Options
from coffer.sources import scan
from coffer.sources.detect import open_archive
from coffer.streaming.listing import stream_entries
from coffer.testing import pack

FILES = [("root/a.txt", b"aaaa"), ("root/b.txt", b"bb"), ("root/c.txt", b"ccc")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "path string, content binary")


def test_scan(spark):
    files = frame(spark, [("x.zip", pack.zip_bytes(FILES)), ("bad.zip", b"PK\3\4 no"), ("none", None), ("what", b"?")])
    rows = scan.list_entries(files, content=True, mode="PERMISSIVE").collect()
    good = [r for r in rows if r.error_class is None]
    assert [(r.archive, r.idx, r.path, r.content) for r in good] == [("x.zip", i, n, bytearray(b)) for i, (n, b) in enumerate(FILES)]
    assert {r.archive: r.error_class for r in rows if r.error_class} == {"bad.zip": "CORRUPT", "none": "IO", "what": "UNKNOWN_FORMAT"}
    with pytest.raises(Exception, match="CORRUPT"):
        scan.list_entries(files.where("path = 'bad.zip'")).collect()
    assert scan.list_entries(files.limit(0)).count() == 0


def test_read_entries(spark):
    files = frame(spark, [("x.zip", pack.zip_bytes(FILES))])
    chosen = spark.createDataFrame([("x.zip", 0), ("x.zip", 2), ("x.zip", 9)], "archive string, idx int")
    rows = scan.read_entries(files, chosen, mode="PERMISSIVE").orderBy("idx").collect()
    assert [(r.idx, r.error_class) for r in rows] == [(0, None), (2, None), (9, "INVALID_INDEX")] and bytes(rows[1].content) == b"ccc"


def test_data_source_and_sql(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(pack.zip_bytes(FILES))
    (tmp_path / "y.tar").write_bytes(pack.tar_bytes(FILES))
    scan.register(spark)
    df = spark.read.format("archive").option("content", "true").load(str(tmp_path))
    assert df.count() == 6
    assert [bytes(r.content) for r in df.where(f"archive = '{tmp_path}/y.tar' AND idx = 1").collect()] == [b"bb"]
    assert scan.read_archives(spark, str(tmp_path), pathGlobFilter="*.zip").count() == 3
    frame(spark, [("x.zip", pack.zip_bytes(FILES))]).createOrReplaceTempView("f")
    assert spark.sql("SELECT e.path FROM f, LATERAL list_entries(f.path, f.content, '{}') e WHERE e.idx = 2").first()[0] == "root/c.txt"


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "x.zip").write_bytes(pack.zip_bytes(FILES))
    q = stream_entries(spark, str(source)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))
    q.awaitTermination(120)
    assert spark.read.parquet(str(out)).count() == 3


PATHS = ["a/b", "../x", "a/../b", "/abs", "./a/./b/", "a\\b", "..\\x", "", ".", "__MACOSX/x", "a/.DS_Store", "a/._b", "a//b", "._a/b"]


def test_paths_agree_with_the_sink(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "p string")
    for r in df.select("p", X.safe_join(F.lit("/d"), "p").alias("j"), X.is_macos_metadata("p").alias("m"), X.wrapper_name("p").alias("w")).collect():
        try:
            want = E.safe_join("/d", r.p)
        except ArchiveError:
            want = None
        assert r.j == want, r.p
        assert r.m == E.is_macos_metadata(r.p), r.p


def test_symlinks_agree_with_the_sink(spark):
    pairs = [(a, b) for a in ("l", "a/l", "a/b/l", "./a/l") for b in ("x", "../x", "../../x", "../../../x", "/x", "a/../../x", "..\\x", "a/../b", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", X.safe_symlink_target("a", "b").alias("t")).collect():
        try:
            want = E.safe_symlink_target(r.a, r.b)
        except ArchiveError:
            want = None
        assert r.t == want, (r.a, r.b)


def test_bytes_not_characters(spark):
    raw = bytes(range(128, 256)) + b"\r\n\r\n" + bytes(range(256))
    df = spark.createDataFrame([(raw,)], "b binary")
    r = df.select(X.strip_http_headers("b").alias("s"), R.earliest_signature("b", b"\r\n\r\n", b"zzzz").alias("a"), X.little_endian("b", 0, 4).alias("n")).first()
    assert bytes(r.s) == bytes(range(256)) and r.a == 128 and r.n == int.from_bytes(raw[:4], "little")


def test_common_root(spark):
    rows = [("one", "r/a", "File"), ("one", "r/b/c", "File"), ("two", "a", "File"), ("two", "b/c", "File"), ("file", "a", "File"), ("dir", "a/", "Dir"), ("empty", "", "File"), ("dot", "./a", "File")]
    df = spark.createDataFrame(rows, "archive string, path string, kind string")
    assert {r.archive: r.root for r in R.common_root(df).collect()} == {"one": "r", "two": None, "file": None, "dir": "a", "empty": None, "dot": "."}


def test_msi_closure(spark):
    directories = spark.createDataFrame([("T", None, "SourceDir"), ("P", "T", "S~1|Programs"), ("D", "P", "."), ("S", "D", "sub:src"), ("A", "B", "A"), ("B", "A", "B"), ("L", "L", "self"), ("X", "gone", "x")], "directory string, parent string, default_dir string")
    got = {r.directory: r.path for r in R.msi_directories(directories).collect()}
    assert got == {"T": "", "P": "Programs", "D": "Programs", "S": "Programs/sub", "A": "B/A", "B": "A/B", "L": "", "X": "x"}


def test_volumes(spark):
    raw = pack.zip_bytes(FILES)
    parts = pack.split(raw, 3)
    rows = [(f"a.zip.{i + 1:03d}", p) for i, p in enumerate(parts)] + [("b.zip.001", b"1"), ("b.zip.003", b"3"), ("c.zip.002", b"2"), ("d.zip", raw)]
    files = frame(spark, rows)
    assert {(r.volume, r.n) for r in R.volume_members(files).collect()} == {("a.zip", 1), ("a.zip", 2), ("a.zip", 3), ("b.zip", 1)}
    whole = R.assemble_volumes(files).where("path in ('a.zip', 'd.zip')")
    assert scan.list_entries(whole).count() == 6


def test_wim_bodies(spark):
    d = spark.createDataFrame([("w", 0, b"h" * 20), ("w", 1, bytes(20)), ("w", 2, b"h" * 20)], "archive string, idx int, hash binary")
    lookup = spark.createDataFrame([("w", b"h" * 20, 5, 100, 0), ("w", b"h" * 20, 6, 200, 1)], "archive string, hash binary, size long, resource_offset long, row_no int")
    assert [(r.size, r.resource_offset) for r in R.wim_bodies(d, lookup).orderBy("idx").collect()] == [(6, 200), (0, None), (6, 200)]
    with pytest.raises(Exception, match="body is missing"):
        R.wim_bodies(d, lookup.limit(0)).collect()


def opened(files, **o):
    return open_archive("my.zip", pack.zip_bytes(files), Options(**o))


def test_extract_wrapper_and_slip(tmp_path):
    r = E.extract_all(opened(FILES), str(tmp_path / "a"), E.ExtractOptions("my"))
    assert r.extracted == 3 and r.wrapped is None and (tmp_path / "a/root/b.txt").read_bytes() == b"bb"
    r = E.extract_all(opened([("a.txt", b"A"), ("b.txt", b"B")]), str(tmp_path / "b"), E.ExtractOptions("my"))
    assert r.wrapped == "my" and (tmp_path / "b/my/a.txt").exists()
    r = E.extract_all(opened([("../evil.txt", b"pwn")]), str(tmp_path / "c"))
    assert r.extracted == 0 and [f[2] for f in r.failed] == ["PATH_TRAVERSAL"] and not (tmp_path / "evil.txt").exists()
    with pytest.raises(ArchiveError):
        E.extract_all(opened([("../evil.txt", b"pwn")]), str(tmp_path / "c"), E.ExtractOptions(strict=True))


def test_extract_selection_metadata_progress(tmp_path):
    assert E.extract_all(opened(FILES), str(tmp_path / "a"), E.ExtractOptions(selection=[0, 2])).extracted == 2
    r = E.extract_all(opened(FILES), str(tmp_path / "b"), E.ExtractOptions("my", selection=[]))
    assert r.extracted == 0 and r.wrapped == "my" and (tmp_path / "b/my").is_dir()
    side = [("keep.txt", b"1"), ("._keep.txt", b"2"), (".DS_Store", b"3")]
    assert E.extract_all(opened(side), str(tmp_path / "c")).extracted == 1
    assert E.extract_all(opened(side), str(tmp_path / "d"), E.ExtractOptions(keep_macos_metadata=True)).extracted == 3
    seen = []
    r = E.extract_all(opened(FILES), str(tmp_path / "e"), E.ExtractOptions(progress=lambda *a: seen.append(a)))
    assert [a[0] for a in seen] == ["EntryStart", "Bytes", "EntryDone"] * 3 and seen[1][2] == 4
    r = E.extract_all(opened(FILES), str(tmp_path / "f"), E.ExtractOptions(progress=lambda *a: False))
    assert r.aborted and r.extracted == 0


def test_extract_times_and_links(tmp_path):
    a = open_archive("x.tar", pack.tar_bytes([("d/", b""), ("d/f", b"x")]))
    a.entries[0].mode = 0o755
    E.extract_all(a, str(tmp_path / "a"))
    assert os.stat(tmp_path / "a/d/f").st_mtime == os.stat(tmp_path / "a/d").st_mtime == 1600000000
    from coffer.schema import SYMLINK, Archive, Entry

    links = Archive("Tar", [Entry(b"evil", "evil", SYMLINK, "../../etc/passwd"), Entry(b"ok", "ok", read=lambda: b"1")])
    r = E.extract_all(links, str(tmp_path / "b"))
    assert r.extracted == 1 and not (tmp_path / "b/evil").is_symlink()


def test_extract_never_leaves_the_folder(tmp_path):
    from coffer.schema import DIR, SYMLINK, Archive, Entry

    def archive(*rows):
        return Archive("Tar", [Entry(p.encode(), p, DIR if p.endswith("/") else SYMLINK if to else "File", to, read=None if to or p.endswith("/") else lambda: b"pwned") for p, to in rows])

    def outside():
        return sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if not str(p).startswith(str(tmp_path / "out") + "/") and p != tmp_path / "out")

    # Links that each look harmless lead, one after another, to a sibling with the same beginning.
    chain = archive(("x/", None), ("x/y", ".."), ("x/y/z", "../out-evil"), ("x/y/z/pwned", None))
    r = E.extract_all(chain, str(tmp_path / "out"))
    assert not outside() and ("x/y/z", "PATH_TRAVERSAL") in [(f[1], f[2]) for f in r.failed]
    # A link whose way changes after it was laid is taken away in the end, and nothing goes through it.
    late = archive(("d/", None), ("d/p", "q/../up"), ("d/q", ".."), ("d/p/pwned", None), ("ok", "d"))
    r = E.extract_all(late, str(tmp_path / "out" / "late"))
    assert not (tmp_path / "out" / "up").exists() and not (tmp_path / "out" / "late" / "d" / "p").is_symlink()
    assert {f[1] for f in r.failed} >= {"d/p/pwned", "d/p"} and (tmp_path / "out" / "late" / "ok").is_symlink()
    # Folders through a link that was there before.
    (tmp_path / "out" / "old").mkdir()
    os.symlink(str(tmp_path / "elsewhere"), tmp_path / "out" / "old" / "l")
    (tmp_path / "elsewhere").mkdir()
    r = E.extract_all(archive(("l/", None), ("l/f", None)), str(tmp_path / "out" / "old"))
    assert r.extracted == 0 and outside() == ["elsewhere"]


def test_msi_paths_of_many_archives(spark):
    one = lambda a, name: ((a, "T", None, "SourceDir"), (a, "D", "T", name))
    directories = spark.createDataFrame([*one("a", "one"), *one("b", "two")], "archive string, directory string, parent string, default_dir string")
    components = spark.createDataFrame([("a", "c", "D"), ("b", "c", "D")], "archive string, component string, directory string")
    files = spark.createDataFrame([("a", "f", "c", "X|x"), ("b", "f", "c", "Y|y")], "archive string, file string, component string, file_name string")
    members = spark.createDataFrame([("a", "f"), ("b", "f"), ("c", "f")], "archive string, name string")
    assert {(r.archive, r.path) for r in R.msi_paths(members, files, components, directories).collect()} == {("a", "one/x"), ("b", "two/y"), ("c", "f")}


def test_extract_archives(spark, tmp_path):
    files = frame(spark, [("my.zip", pack.zip_bytes([("a.txt", b"A"), ("../b", b"B")])), ("bad.zip", b"PK\3\4")])
    rows = {(r.archive, r.path): (r.status, r.error_class, r.bytes) for r in E.extract_archives(files, str(tmp_path)).collect()}
    assert rows == {("my.zip", "a.txt"): ("OK", None, 1), ("my.zip", "../b"): ("FAILED", "PATH_TRAVERSAL", None), ("bad.zip", None): ("FAILED", "CORRUPT", None)}
    assert (tmp_path / "my/a.txt").read_bytes() == b"A"


def test_entry_imports():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and len(names) > 50


def test_engine_never_imports_llm():
    import pathlib

    import coffer

    for p in pathlib.Path(coffer.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "coffer.llm" not in p.read_text() and "from .llm" not in p.read_text(), p
