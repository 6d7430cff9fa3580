"""Substring de-duplication by recompression.

Rounds rename a text's words: runs of one symbol become one symbol, then, again and again, pairs
of a left and a right symbol (by a coin of the symbol) become one. A name is a hash of what it
stands for, so all partitions give equal stretches equal names without a dictionary between them.
Of a window of words, the symbols that can't have been paired or run together with anything
outside it depend on nothing but the window: its interior. Equal windows have equal interiors,
whatever surrounds them, so a window's anchor, the smallest name of its interior, is shared by all
its copies, and neighbouring windows mostly have the same one.

1. Every document states the anchors of its windows: a few for a hundred words.
2. Only windows whose anchor occurs in two documents are compared, by 96 bits of their words,
   in groups by anchor. An anchor of very many documents is dealt into blocks, from which only
   the smallest document of each window goes on to a second level.
3. Documents that lose words are written anew.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, slices, windows
from .workspace import join_unique, keep, ship

SIZE = 50
ROUNDS = 5
#: Documents of a block of an anchor.
BLOCK = 4096
_LAST = (1 << 63) - 1
_SALTS = mix(np.arange(1, 40, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WINDOW = np.dtype([("anchor", "<u8"), ("one", "<u8"), ("two", "<u4"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4")])


def anchors(names: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """The anchor of the window of size words at each place of first."""
    low, high = first.copy(), first + size - 1  # the interior, as places of symbols
    edge = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
    run = np.cumsum(np.r_[False, names[1:] != names[:-1]])
    length = np.diff(np.r_[edge, len(names)])
    symbols = np.where(length > 1, mix(names[edge] ^ mix(length.astype(np.uint64))), names[edge])
    # A run at an edge of the window may go on outside: it is no part of the interior.
    low, high = run[low] + 1, run[high] - 1
    for k in range(ROUNDS):
        left = (mix(symbols ^ _SALTS[k]) & np.uint64(1)).astype(bool)
        last = len(symbols) - 1
        empty = low > high
        low, high = np.minimum(low, last), np.maximum(high, 0)
        joins = np.zeros(len(symbols), bool)  # a right one that a left one stands before
        joins[1:] = left[:-1] & ~left[1:]
        place = np.cumsum(~joins) - 1
        heads = np.flatnonzero(~joins)
        paired = np.r_[joins[1:], False][heads]
        symbols = np.where(paired, mix(symbols[heads] * np.uint64(0xC2B2AE3D27D4EB4F) + symbols[np.minimum(heads + 1, last)]), symbols[heads])
        # At the edges, a right symbol may be paired to the left, and a left one to the right.
        low, high = place[low] + ~left[low], place[high] - left[high]
        high = np.where(empty, low - 1, high)
    tags = mix(symbols ^ _SALTS[30])
    out = _least(tags, np.minimum(low, len(tags) - 1), np.minimum(high, len(tags) - 1))
    none = low > high
    if none.any():  # words are the symbols of windows that have no interior
        out[none] = _least(mix(names ^ _SALTS[31]), first[none], first[none] + size - 1)
    return out


def _least(tags: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The smallest tag from low to high, at most SIZE of them, by a table of powers of two."""
    power = np.maximum(np.log2(np.maximum(high - low + 1, 1)).astype(np.int64), 0)
    out, level = np.empty(len(low), np.uint64), tags
    for k in range(int(power.max(initial=0)) + 1):
        if k:
            half = 1 << (k - 1)
            level = np.minimum(level, np.r_[level[half:], np.full(min(half, len(level)), level[-1])])
        of = power == k
        out[of] = np.minimum(level[low[of]], level[np.maximum(high[of] - (1 << k) + 1, 0)])
    return out


def _firsts(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The first word of every window, and its text."""
    n = np.maximum(words.counts() - SIZE + 1, 0)
    owner = np.repeat(np.arange(len(n)), n)
    return np.arange(len(owner)) - (np.cumsum(n) - n)[owner] + words.at[:-1][owner], owner


def _own(words: Words, i: int, kept: np.ndarray | None = None) -> bytes:
    at, to = words.at[i], words.at[i + 1]
    start, end = words.start[at:to], words.end[at:to]
    if kept is not None:
        start, end = start[kept], end[kept]
    raw = words.data
    return b" ".join([raw[s:e].tobytes() for s, e in zip(start.tolist(), end.tolist())])


def _state(batches):
    """A row for each document, and one for each of its anchors."""
    for batch in batches:
        for b in slices(batch, "text"):
            words = Words(b.column("text"))
            docs, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
            texts = [t.encode().split() if t else [] for t in b.column("text").to_pylist()]
            digest = [hashlib.sha256(b" ".join(t)).hexdigest() for t in texts]
            first, owner = _firsts(words)
            if len(first):
                got = anchors(words.hashes(False), first)
                new = np.r_[True, (got[1:] != got[:-1]) | (owner[1:] != owner[:-1])]
                got, owner = got[new], owner[new]
            else:
                got = np.zeros(0, np.uint64)
            n, m = len(b), len(got)
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(docs), pa.nulls(m, pa.int64())]), pa.array(np.r_[keys, keys[owner]]),
                pa.concat_arrays([pa.array(words.counts()), pa.nulls(m, pa.int64())]),
                pa.concat_arrays([pa.array(digest, pa.string()), pa.nulls(m, pa.string())]),
                pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(got.view(np.int64))]),
            ], names=["doc", "key", "n_words", "digest", "anchor"])


def _compare(buckets: int):
    """The windows at shared anchors, by bucket of the anchor and its block."""

    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                words = Words(b.column("text"))
                docs, keys = (b.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                first, owner = _firsts(words)
                names, other = words.prints(False)
                got = anchors(names, first)
                shared = b.column("shared")
                values, sizes = shared.flatten(), np.diff(shared.offsets.to_numpy())
                pairs = np.stack([values.field("anchor").to_numpy().view(np.uint64), values.field("blocks").to_numpy().view(np.uint64)], 1)
                ends = np.cumsum(sizes)
                block = np.zeros(len(got), np.uint64)
                for i in range(len(b)):
                    own = slice(*np.searchsorted(owner, [i, i + 1]))
                    mine = pairs[ends[i] - sizes[i] : ends[i]]
                    mine = mine[np.argsort(mine[:, 0])]
                    j = np.minimum(np.searchsorted(mine[:, 0], got[own]), len(mine) - 1)
                    block[own] = np.where(mine[j, 0] == got[own], mine[j, 1], 0)
                hit = np.flatnonzero(block)
                if not len(hit):
                    continue
                at, owner, got, block = first[hit], owner[hit], got[hit], block[hit]
                rows = np.empty(len(hit), _WINDOW)
                rows["anchor"], rows["doc"], rows["key"], rows["at"] = got, docs[owner], keys[owner], at - words.at[owner]
                rows["one"] = windows(names, SIZE)[at]
                rows["two"] = (windows(other, SIZE)[at] >> np.uint64(32)).astype(np.uint32)
                deal = mix(keys.astype(np.int64).view(np.uint64))[owner] % block
                hot = block > 1
                bucket = (mix(got ^ mix(deal + np.uint64(1))) % np.uint64(buckets)).astype(np.int64)
                yield _packed(rows, bucket, hot)

    return run


def _packed(rows: np.ndarray, bucket: np.ndarray, hot: np.ndarray) -> pa.RecordBatch:
    code = bucket * 2 + hot
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    cut = np.flatnonzero(np.r_[True, code[1:] != code[:-1], True])
    code = code[cut[:-1]]
    return pa.RecordBatch.from_arrays([pa.array((code // 2).astype(np.int32)), pa.array((code % 2).astype(bool)), pa.array([_runs(rows[a:z]) for a, z in zip(cut[:-1], cut[1:])], pa.binary())], names=["bucket", "hot", "rows"])


_RUN = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("key", "<i8"), ("at", "<i4"), ("n", "<i4")])


def _runs(rows: np.ndarray) -> bytes:
    """Windows that follow each other in a document at one anchor take twelve bytes each."""
    if not len(rows):
        return b""
    new = np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["doc"][1:] != rows["doc"][:-1]) | (rows["anchor"][1:] != rows["anchor"][:-1]) | (rows["at"][1:] != rows["at"][:-1] + 1)]
    start = np.flatnonzero(new)
    runs = np.empty(len(start), _RUN)
    for name in ("anchor", "doc", "key", "at"):
        runs[name] = rows[name][start]
    runs["n"] = np.diff(np.r_[start, len(rows)])
    return np.array([len(runs), len(rows)], np.int64).tobytes() + runs.tobytes() + rows["one"].tobytes() + rows["two"].tobytes()


def _of_runs(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, _WINDOW)
    k, n = np.frombuffer(raw, np.int64, 2).tolist()
    runs = np.frombuffer(raw, _RUN, k, 16)
    at = 16 + k * _RUN.itemsize
    rows = np.empty(n, _WINDOW)
    for name in ("anchor", "doc", "key", "at"):
        rows[name] = np.repeat(runs[name], runs["n"])
    rows["at"] += (np.arange(n) - np.repeat(np.cumsum(runs["n"]) - runs["n"], runs["n"])).astype(np.int32)
    rows["one"] = np.frombuffer(raw, "<u8", n, at)
    rows["two"] = np.frombuffer(raw, "<u4", n, at + 8 * n)
    return rows


def _judge(final: bool, buckets: int):
    """Of the windows of a bucket, runs (key, doc, at, n) of those that a smaller document has;
    of blocks of hot anchors also the windows of the smallest documents."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_of_runs(x) for x in table.column("rows").to_pylist()]
        hot = np.repeat(table.column("hot").to_numpy(), [len(x) for x in parts])
        rows = np.concatenate(parts)
        order = np.lexsort((rows["doc"], rows["two"], rows["one"]))
        rows, hot = rows[order], hot[order]
        new = np.r_[True, (rows["one"][1:] != rows["one"][:-1]) | (rows["two"][1:] != rows["two"][:-1])]
        least = rows["doc"][np.flatnonzero(new)][np.cumsum(new) - 1]
        out = rows[rows["doc"] > least]
        out = out[np.lexsort((out["at"], out["key"], out["doc"]))]
        step = np.r_[True, (out["key"][1:] != out["key"][:-1]) | (out["doc"][1:] != out["doc"][:-1]) | (out["at"][1:] != out["at"][:-1] + 1)]
        start = np.flatnonzero(step[: len(out)])
        n = np.diff(np.r_[start, len(out)])
        out = out[start]
        onward = rows[(rows["doc"] == least) & hot & (not final)]
        onward = onward[np.lexsort((onward["at"], onward["anchor"], onward["key"]))]
        packed = _packed(onward, (mix(onward["anchor"]) % np.uint64(buckets)).astype(np.int64), np.ones(len(onward), np.int64)) if len(onward) else None
        k = packed.num_rows if packed else 0
        join = lambda a, kind, b=None: pa.concat_arrays([pa.array(a, kind) if a is not None else pa.nulls(len(out), kind), b if b is not None else pa.nulls(k, kind)])
        return pa.Table.from_arrays([
            join(out["key"], pa.int64()), join(out["doc"], pa.int64()), join(out["at"], pa.int32()), join(n.astype(np.int32), pa.int32()),
            join(None, pa.int32(), packed.column(0) if packed else None), join(None, pa.binary(), packed.column(2) if packed else None),
        ], names=["key", "doc", "at", "n", "bucket", "rows"])

    return run


_JUDGED = "key long, doc long, at int, n int, bucket int, rows binary"


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            for b in slices(batch, "text"):
                words = Words(b.column("text"))
                runs = b.column("runs").to_pylist()
                removed, digest, texts = [], [], []
                for i, own in enumerate(runs):
                    change = np.zeros(words.at[i + 1] - words.at[i] + 1, np.int64)
                    for r in own:
                        change[r["at"]] += 1
                        change[r["at"] + r["n"] + SIZE - 1] -= 1
                    kept = np.cumsum(change[:-1]) == 0
                    text = _own(words, i, kept)
                    removed.append(int(len(kept) - kept.sum()))
                    digest.append(hashlib.sha256(text).hexdigest())
                    texts.append(text.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("doc"), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.string())], names=["key", "doc", "n_removed", "digest", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per row of docs: id, n_words, n_removed, kept_sha256 and, if with_text, kept_text
    of documents that lose words.

    A word goes if a window of SIZE words covers it that also starts in a document with a smaller
    id; all windows are those of the input. Within a document nothing is removed for its own sake;
    rows that repeat an id don't remove from each other. A null id counts as the largest of all; a
    null or short text has no window and loses nothing; an empty table gives an empty one.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    docs = docs.select(doc.alias("doc"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    stated = keep(docs.select("doc", "key", "text").mapInArrow(_state, "doc long, key long, n_words long, digest string, anchor long"), "stated")
    whole = stated.where("anchor is null").select("doc", "key", "n_words", "digest")
    total = max(whole.count(), 1)
    buckets = int(max(64, min(total // 1000, 1 << 20)))
    repeats = whole.groupBy("doc", "key").count().where("count > 1").limit(1).count() > 0

    found = stated.where("anchor is not null").select("anchor", "key")
    shared = found.groupBy("anchor").agg(F.min("key").alias("a"), F.max("key").alias("z"), F.count(F.lit(1)).alias("n")).where("a < z")
    shared = keep(shared.select("anchor", "n", F.ceil(F.col("n") / BLOCK).alias("blocks")), "shared")
    n_found = max(shared.agg(F.sum("n")).first()[0] or 1, 1)
    mine = join_unique(found, shared, "anchor", "n", n_found, "inner")
    mine = mine.groupBy("key").agg(F.collect_set(F.struct("anchor", "blocks")).alias("shared"))
    met = docs.select("doc", "key", "text").join(mine, "key")
    if repeats:
        met = met.dropDuplicates(["doc", "key"])
    compared = met.mapInArrow(_compare(buckets), "bucket int, hot boolean, rows binary")
    first = keep(compared.groupBy("bucket").applyInArrow(_judge(False, buckets), _JUDGED), "judged")
    again = first.where("bucket is not null").select("bucket", F.lit(True).alias("hot"), "rows")
    second = again.groupBy("bucket").applyInArrow(_judge(True, buckets), _JUDGED)
    runs = first.where("key is not null").unionByName(second.where("key is not null")).groupBy("doc", "key").agg(F.collect_list(F.struct("at", "n")).alias("runs"))

    changed = docs.select("doc", "key", "text").join(keep(runs, "runs"), ["doc", "key"])
    if repeats:
        changed = changed.dropDuplicates(["doc", "key"])
    changed = changed.mapInArrow(_cut(with_text), "key long, doc long, n_removed long, digest string, kept_text string")
    changed = changed.withColumnRenamed("digest", "new")
    out = whole.join(changed, ["doc", "key"], "left")
    return out.select(
        F.when(F.col("doc") != _LAST, F.col("doc")).alias(id_col), "n_words",
        F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("new", "digest").alias("kept_sha256"), *(["kept_text"] if with_text else []),
    )


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
starts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY same) < doc_id AS again
           FROM (SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS same FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50))),
marked AS (SELECT words.doc_id, word, i, coalesce(bool_or(again) OVER (PARTITION BY words.doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone
           FROM words LEFT JOIN starts USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""
