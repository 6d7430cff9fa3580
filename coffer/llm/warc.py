"""WARC archives of pages: written in segments, reassembled when read.

Writing: a page becomes an HTTP response with chunked transfer framing. A response beyond
``segment`` bytes is cut: its first part is a response record with WARC-Segment-Number 1, the rest
are continuation records that name it in WARC-Segment-Origin-ID; the last has the total length.
Records are dealt over the archives by their own ids, so the segments of a page lie in several
archives. A payload that occurs again is a revisit record without it. An archive is one gzip stream,
as Spark's text writer makes it, so that it can lie in any store that Spark writes to.

Reading: archives are parsed record by record, continuation records are grouped by origin, put in
the order of their numbers and checked against the total length; then the chunks are decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import folder, forget, join_unique, keep, ship

SEGMENT = 64 * 1024
CHUNK = 8 * 1024
#: Bytes of payloads of an archive, and of the smallest ones that many tasks are worth.
ARCHIVE, LEAST = 32 << 20, 1 << 20
CRLF = b"\r\n"
_END = CRLF * 2


class WarcError(ValueError):
    """An archive that breaks the format."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def cut(raw: bytes, size: int) -> list[bytes]:
    """Parts of at most size bytes (size of 4 at least) of UTF-8 text that end between characters,
    so that archives are text as well and Spark's text writer can write them to any store."""
    out, at = [], 0
    while at < len(raw):
        end = min(at + size, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end -= 1
        out.append(raw[at:end])
        at = end
    return out


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for p in cut(payload, size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = framed.find(CRLF, at)
        if end < 0:
            raise WarcError("chunk size without an end of line")
        try:
            size = int(framed[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise WarcError("chunk size is no hexadecimal number") from None
        at = end + 2
        if not size:
            return b"".join(out)
        if size < 0 or framed[at + size : at + size + 2] != CRLF:
            raise WarcError("chunk without an end")
        out.append(framed[at : at + size])
        at += size + 2


def http_response(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)


def http_payload(block: bytes) -> bytes:
    head, found, body = block.partition(_END)
    if not found:
        raise WarcError("HTTP head without an end")
    framed = any(k.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for k, _, v in (x.partition(b":") for x in head.split(CRLF)[1:]))
    return unchunked(body) if framed else body


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + _END + block + _END


def parse(archive: bytes):
    """(headers in lower case, block) of each record of an uncompressed archive."""
    at = 0
    while at < len(archive):
        end = archive.find(_END, at)
        if end < 0 or not archive.startswith(b"WARC/1.", at):
            raise WarcError(f"no record at byte {at}")
        lines = archive[at:end].decode("utf-8", "surrogateescape").split("\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        try:
            length = int(headers["content-length"])
        except (KeyError, ValueError):
            raise WarcError(f"no length in the record at byte {at}") from None
        at = end + 4
        if length < 0 or archive[at + length : at + length + 4] != _END:
            raise WarcError(f"a record is cut short at byte {at}")
        yield headers, archive[at : at + length]
        at += length + 4


def urn(text: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, text)}>"


def _common(page: int | None, url: str | None, sha1: str) -> list[tuple[str, str]]:
    uri = " ".join((url or f"page:{page}").split())
    own = [("X-Page-ID", str(page))] if page is not None else []
    return [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{sha1}"), *own]


def segments(name: str, page: int | None, url: str | None, payload: bytes, size: int) -> list[tuple[str, bytes]]:
    """(id, record) of a page's response and its continuations; name is the row's own."""
    block = http_response(payload)
    origin = urn(name)
    common = _common(page, url, digest(payload))
    head = [("WARC-Type", "response"), ("WARC-Record-ID", origin), *common, ("Content-Type", "application/http;msgtype=response")]
    parts = cut(block, size)
    if len(parts) == 1:
        return [(origin, record(head, block))]
    out = [(origin, record([*head, ("WARC-Segment-Number", "1")], parts[0]))]
    for n, part in enumerate(parts[1:], 2):
        own = urn(f"{name}/{n}")
        tail = [("WARC-Type", "continuation"), ("WARC-Record-ID", own), *common[:2], ("WARC-Segment-Origin-ID", origin), ("WARC-Segment-Number", str(n))]
        if n == len(parts):
            tail.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append((own, record(tail, part)))
    return out


def revisit(name: str, page: int | None, url: str | None, refers_to: int, refers_name: str, sha1: str) -> tuple[str, bytes]:
    own = urn(name)
    headers = [("WARC-Type", "revisit"), ("WARC-Record-ID", own), *_common(page, url, sha1), ("WARC-Refers-To", urn(refers_name)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
    return own, record(headers, b"")


def _records(size: int):
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 200) for i in range(0, len(batch), 200)):
                ids, raw = [], []
                for page, url, html, sha1, copy, last in zip(*(c.to_pylist() for c in b.columns)):
                    sha1 = base64.b32encode(sha1).decode()
                    name = lambda page, url, copy: f"page/{page}/{sha1}/{url}/{copy}"  # noqa: E731,B023
                    own = name(page, url, copy)
                    found = segments(own, page, url, (html or "").encode(), size) if last is None else [revisit(own, page, url, last["page"], name(last["page"], last["url"], 0), sha1)]
                    ids += [own for own, _ in found]
                    # The line separator of the writer gives the record its second end of line.
                    raw += [r[:-2].decode("utf-8") for _, r in found]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(raw, pa.string())], names=["record", "value"])

    return run


def write_archives(pages: DataFrame, path: str, archives: int | None = None, segment: int = SEGMENT, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write a WARC record for each row of pages to files under path, about ``archives`` of them: by
    default as many as shuffles have partitions, with LEAST to ARCHIVE bytes of payloads in each.

    Of rows with equal payloads of at least least_bytes bytes those with the largest id are
    responses and the others revisit it; a null id is smaller than any. Only digests are shuffled to
    find out which; a payload of very many pages is no hot key (join_unique), and revisits go on
    without their html. Rows that repeat as a whole are told apart by a number.
    """
    ship(pages.sparkSession)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), F.unhex(F.sha1(html.cast("binary"))).alias("sha1"), F.lit(0).cast("long").alias("copy"))
    own = ["page", "url", "sha1"]
    prints = keep(rows.select(*own, F.octet_length(html).cast("long").alias("n")), "prints")
    if archives is None:
        size = prints.agg(F.sum("n")).first()[0] or 0
        archives = max(min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // LEAST), size // ARCHIVE, 4)
    if prints.groupBy(*own).agg(F.count(F.lit(1)).alias("k")).where("k > 1").limit(1).count():
        whole = rows.groupBy(*own).agg(F.max("html").alias("html"), F.count(F.lit(1)).alias("k"))
        rows = whole.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1))).select(*rows.columns)
    prints = prints.where(F.col("n") >= least_bytes)
    total = max(prints.count(), 1)
    same = F.struct("sha1", "n").alias("same")
    copies = prints.groupBy("sha1", "n").agg(F.max(F.struct("page", "url")).alias("last"), F.count(F.lit(1)).alias("k")).where("k > 1").select(same, "last", "k")
    older = join_unique(prints.select("page", same), copies, "same", "k", total, "inner").where("NOT page <=> last.page")
    older = keep(older.select(F.struct("page", "same.sha1").alias("row"), "last").distinct(), "older")
    joined = rows.withColumn("row", F.struct("page", "sha1")).join(older, "row", "left")
    joined = joined.select("page", "url", F.when(F.col("last").isNull(), F.col("html")).alias("html"), "sha1", "copy", "last")
    records = joined.mapInArrow(_records(segment), "record string, value string")
    records.repartition(archives, "record").select("value").write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


def _parsed(batches):
    """A row for each record; the whole payload where there is no other segment."""
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            rows = []
            for h, block in parse(gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content):
                kind = h.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                number = int(h.get("warc-segment-number", 0))
                total = int(h["warc-segment-total-length"]) if "warc-segment-total-length" in h else None
                row = {"kind": kind, "record": h["warc-record-id"], "page": int(h["x-page-id"]) if "x-page-id" in h else None, "origin": h.get("warc-segment-origin-id", h["warc-record-id"]) if number else None, "number": number, "total": total, "refers_to": int(h["x-refers-to-page"]) if kind == "revisit" else None, "claimed": h.get("warc-payload-digest", "").removeprefix("sha1:") or None, "block": block if number else None, "n_bytes": None, "sha1": None}
                if kind == "response" and not number:
                    payload = http_payload(block)
                    row |= {"n_bytes": len(payload), "sha1": digest(payload)}
                rows.append(row)
                if len(rows) == 500:
                    yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)


_PARSED = pa.schema([("kind", pa.string()), ("record", pa.string()), ("page", pa.int64()), ("origin", pa.string()), ("number", pa.int32()), ("total", pa.int64()), ("refers_to", pa.int64()), ("claimed", pa.string()), ("block", pa.binary()), ("n_bytes", pa.int64()), ("sha1", pa.string())])


def reassemble(parts: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length, part of the block) in any order; a part that was read
    twice counts once."""
    by_number = {n: (total, block) for n, total, block in parts}
    if sorted(by_number) != list(range(1, len(by_number) + 1)):
        raise WarcError(f"segments {sorted(by_number)} aren't complete")
    whole = b"".join(by_number[n][1] for n in sorted(by_number))
    total = by_number[len(by_number)][0]
    if total != len(whole):
        raise WarcError(f"segments have {len(whole)} bytes, not {total}")
    return whole


def _reassembled(table: pa.Table) -> pa.Table:
    """One page: its segments are bounded by its own size."""
    rows = table.to_pylist()
    head = next((r for r in rows if r["number"] == 1), None)
    if head is None:
        raise WarcError(f"no first segment for {rows[0]['origin']}")
    payload = http_payload(reassemble([(r["number"], r["total"], r["block"]) for r in rows]))
    return pa.table([pa.array([head["page"]], pa.int64()), pa.array([len(payload)], pa.int64()), pa.array([digest(payload)]), pa.array([head["claimed"]])], names=["page", "n_bytes", "sha1", "claimed"])


def read_archives(spark, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of all archives under path.
    A payload that doesn't have the digest that its record claims is an error."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    parsed = keep(files.mapInArrow(_parsed, _DDL), "records")
    whole = parsed.where("kind = 'response' and number = 0").select("page", "n_bytes", "sha1", "claimed")
    split = parsed.where("number > 0").select("origin", "number", "total", "page", "claimed", "block")
    joined = split.groupBy("origin").applyInArrow(_reassembled, "page long, n_bytes long, sha1 string, claimed string")
    responses = whole.unionByName(joined)
    checked = F.when(F.col("sha1") == F.coalesce("claimed", "sha1"), F.col("sha1")).otherwise(F.raise_error(F.concat(F.lit("wrong payload digest of page "), F.col("page").cast("string"))))
    responses = keep(responses.select("page", "n_bytes", checked.alias("sha1")), "responses")
    target = F.struct(F.col("refers_to").alias("page"), F.col("claimed").alias("sha1")).alias("target")
    revisits = parsed.where("kind = 'revisit'").select("page", "refers_to", target)
    counts = revisits.groupBy("target").agg(F.count(F.lit(1)).alias("k"))
    targets = responses.select(F.struct("page", "sha1").alias("target"), "n_bytes").dropDuplicates(["target"]).join(counts, "target")
    total = max(revisits.count(), 1)
    resolved = join_unique(revisits, keep(targets, "targets"), "target", "k", total, "left")
    wrong = F.raise_error(F.concat(F.lit("nothing to revisit for page "), F.coalesce(F.col("page").cast("string"), F.lit("null"))))
    out = responses.select("page", "n_bytes", "sha1", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    out = out.unionByName(resolved.select("page", F.coalesce("n_bytes", wrong.cast("long")).alias("n_bytes"), "target.sha1", F.lit("revisit").alias("record_type"), "refers_to"))
    return out.select(F.col("page").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("sha1").alias("payload_digest"), "record_type", "refers_to")


_DDL = "kind string, record string, page long, origin string, number int, total long, refers_to long, claimed string, block binary, n_bytes long, sha1 string"


def archive_pages(pages: DataFrame, segment: int = SEGMENT, least_bytes: int = 0) -> DataFrame:
    """Write pages as WARC archives to the shared folder and read them back: one row per page.

    Null html counts as empty and a null url as page:<id>. A null id is smaller than any. Rows that
    repeat an id are records of their own, whether their html is the same (then alike responses or
    revisits) or not. An empty table gives an empty one; other columns are ignored.
    """
    spark = pages.sparkSession
    path = f"{folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, None, segment, least_bytes)
    forget(spark, path)
    return read_archives(spark, path)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS hex, max(page_id) OVER (PARTITION BY b) AS last FROM p),
bits AS (SELECT *, list_transform(generate_series(0, 3), lambda k: CAST('0x' || substr(hex, 10 * k + 1, 10) AS BIGINT)) AS w FROM d)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((w[1 + i // 8] >> (35 - 5 * (i % 8))) & 31 AS INTEGER), 1)), '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits
"""
