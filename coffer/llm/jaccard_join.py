"""N-gram Jaccard join: groups of documents that share most of their word shingles.

Documents that may be similar meet in bounded groups, and each group is joined in a trie of its
n-gram sets (link_group). All n-grams stand in one global order, that of their hashes, until rarer
ones are known. What the steps rest on: if two sets of n and m n-grams have at least t in common,
their first n - t + l and m - t + l in any one order have at least l in common.

1. One pass over all texts posts every document's first n-grams, half of them and a few, by ranges
   of the hash, and counts how many of them another document has too. Who has too few is similar
   to nothing; only the others' sets are kept from here on, of equal sets one.
2. Families: documents that share one of four min-hashes; a group of any size is dealt into
   blocks, each min-hash deals it anew. This joins nearly all links, with no claim to all.
3. The rest. Over all n-grams of what is left it is counted how many documents have each, and
   noted whether they are of one family. A document with too few n-grams that another family has
   is done. The others are posted under their rarest n-grams; lists within a family are dropped,
   and pairs whose prefixes share too few n-grams for the lengths. What remains is joined in
   tries; a list beyond BLOCK documents is dealt into blocks and each two blocks meet.

An n-gram that very many documents have takes one entry for each chunk of documents in steps 1
and 3, so no task gets all of its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import Forest, components
from .words import mix, release, shingles, slices
from .workspace import join_unique, keep, ship

SIZE = 5
NUM, DEN = 75, 100
#: Documents of a block of a group.
BLOCK = 512
#: Posting lists up to here are joined pair by pair, at most SHORT ** 2 / 2 of them.
SHORT = 64
#: N-grams of a chunk of documents, about, and of a bucket of the n-grams' order.
CHUNK, BUCKET = 400_000, 1_000_000
#: Bits of the filter that spares most texts the shingling of step 2.
BITS = 1 << 23
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
#: In place of a document of a chunk: several have the n-gram. In place of a family: several have it.
_SEVERAL, _FAMILIES = 0xFFFF, -(1 << 63)


def needed(n: int, m: int) -> int:
    """The least intersection of sets of n and m that reaches the threshold."""
    return -(-NUM * (n + m) // (NUM + DEN))


def least(n):
    """The least intersection of a set of n with any set that it is similar to."""
    return (NUM * n + DEN - 1) // DEN


def prefix_length(n):
    return n - least(n) + 1


def extra(n):
    """How many n-grams more step 1 posts, and counts on."""
    return n // 4


class _Node:
    __slots__ = ("seg", "depth", "kids", "docs", "low", "high", "one", "mixed")

    def __init__(self, seg, depth, doc, size):
        self.seg, self.depth, self.kids, self.docs = seg, depth, {}, []
        self.low = self.high = size
        self.one, self.mixed = doc, False


class Trie:
    """Sets as ascending rank arrays in a trie with a segment of ranks on each edge. depth counts
    the ranks down to a node's end; low and high are the sizes of the sets below; one is a document
    below, and unless mixed all below are in its component."""

    def __init__(self, forest: Forest):
        self.forest = forest
        self.root = _Node(np.zeros(0, np.int64), 0, -1, 0)

    def add(self, doc: int, ranks: np.ndarray) -> None:
        node, at, n, find = self.root, 0, len(ranks), self.forest.find
        root = find(doc)
        while at < n:
            kid = node.kids.get(int(ranks[at]))
            if kid is None:
                kid = node.kids[int(ranks[at])] = _Node(ranks[at:], n, doc, n)
                kid.docs.append(doc)
                return
            k = min(len(kid.seg), n - at)
            differ = np.flatnonzero(kid.seg[:k] != ranks[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(kid.seg):  # the edge is cut where the sets part
                upper = _Node(kid.seg[:k], node.depth + k, kid.one, kid.low)
                upper.high, upper.mixed = kid.high, kid.mixed
                node.kids[int(ranks[at])] = upper
                kid.seg = kid.seg[k:]
                upper.kids[int(kid.seg[0])] = kid
                kid = upper
            kid.low, kid.high = min(kid.low, n), max(kid.high, n)
            kid.mixed = kid.mixed or find(kid.one) != root
            node, at = kid, at + k
        node.docs.append(doc)

    def probe(self, doc: int, ranks: np.ndarray, mark: np.ndarray) -> list[tuple[int, int]]:
        """Links of doc to sets in the trie, one for each component that it joins. The overlap
        with a shared segment is counted once for all sets below; a subtree is left out if not
        even all that may still match, given the lengths, would reach the threshold."""
        found, n, find, union = [], len(ranks), self.forest.find, self.forest.union
        mark[ranks] = True
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.one >= 0 and not node.mixed and find(node.one) == find(doc):
                continue
            if len(node.seg):
                overlap += int(np.count_nonzero(mark[node.seg]))
                left = n - int(np.searchsorted(ranks, node.seg[-1], "right"))
                best = min(max(node.depth + left, node.low), node.high)
                if overlap + min(left, best - node.depth) < needed(n, best):
                    continue
            for other in node.docs:
                m = node.depth
                if DEN * overlap >= NUM * (n + m - overlap) and union(other, doc):
                    found.append((other, doc))
            stack.extend((kid, overlap) for kid in node.kids.values())
        mark[ranks] = False
        return found


def link_group(sets: list[np.ndarray], known: list[int]) -> list[tuple[int, int]]:
    """Links between the sets, by place, that join what known (a label for each) doesn't: enough
    of them for the components of all links of the group. N-grams are ranked by how many sets of
    the group have them, so like sets share long paths; sets go from short to long."""
    forest, first = Forest(), {}
    for i, label in enumerate(known):
        forest.union(first.setdefault(label, i), i)
    if len(first) < 2:
        return []
    values, place, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    ranked = rank[place]
    ends = np.cumsum([len(s) for s in sets])
    mark, trie, links = np.zeros(len(values), bool), Trie(forest), []
    for i in np.argsort([len(s) for s in sets], kind="stable").tolist():
        own = np.sort(ranked[ends[i] - len(sets[i]) : ends[i]])
        links += trie.probe(i, own, mark)
        trie.add(i, own)
    return links


def _ids(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64)


def _binary(parts) -> pa.Array:
    return pa.array([x if isinstance(x, bytes) else x.tobytes() for x in parts], pa.binary())


def _pack(raw: bytes) -> bytes:
    return zstandard.compress(raw, 1)


def _unpack(raw: bytes) -> bytes:
    return zstandard.decompress(raw)


def _six(keys: np.ndarray) -> np.ndarray:
    """48 bits of keys by planes of a byte; those of keys in order mostly pack well. Keys that
    agree in them but not in all count as shared in vain, no more."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].T)


def _of_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").reshape(-1)


def _order(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of n-grams (a bijection's, so that prefixes by n-gram fall on all of them alike) in
    order, where they come from, starts of equal ones, and for these the bucket."""
    key = mix(grams) & ~np.uint64(0xFFFF)
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
    bucket = ((key[start] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return key, order, start, bucket


def _cuts(bucket: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, np.int64)


# Step 1: who has enough n-grams that others have?

_POSTS = "bucket int, chunk binary, packed binary, docs binary"


def _post(buckets: int):
    """Chunks of documents: a row that describes its documents, and a piece of their first n-grams
    for each bucket."""
    def chunk(parts):
        docs, n, one, two, grams, sizes = (np.concatenate(x) for x in zip(*parts))
        name = xxhash.xxh3_128_digest(b"".join(x.tobytes() for x in (docs, n, one, two)))
        key, order, start, bucket = _order(grams, buckets)
        owner = np.repeat(np.arange(len(docs)), sizes)[order]
        many = np.diff(np.r_[start, len(key)]) > 1
        # What several documents of a chunk have is known to be shared by them.
        alone = start[~many]
        among = np.ones(len(key), bool)
        among[alone] = False
        local = np.bincount(owner[among], minlength=len(docs))
        who = np.where(many, _SEVERAL, owner[start]).astype(np.uint16)
        key, cut = key[start], _cuts(bucket)
        pieces = [_pack(_six(key[a:z]).tobytes() + who[a:z].tobytes()) for a, z in zip(cut[:-1], cut[1:])]
        about = np.array([docs, n, one.view(np.int64), two.view(np.int64), local])
        at = int.from_bytes(name[:4], "little") % buckets
        none = len(pieces)
        return pa.RecordBatch.from_arrays([
            pa.array(np.r_[bucket[cut[:-1]], at].astype(np.int32)), pa.array([name] * (none + 1), pa.binary()),
            pa.array([*pieces, None], pa.binary()), pa.array([None] * none + [about.tobytes()], pa.binary()),
        ], names=["bucket", "chunk", "packed", "docs"])

    def run(batches):
        waiting, size, docs = [], 0, 0
        for batch in batches:
            for b in slices(batch, "text"):
                grams, at = shingles(b.column("text"), SIZE)
                n = np.diff(at)
                prints = np.zeros((2, len(b)), np.uint64)
                full = np.flatnonzero(n)
                if len(full):
                    prints[0, full] = np.add.reduceat(mix(grams ^ _SEEDS[0]), at[:-1][full])
                    prints[1, full] = np.bitwise_xor.reduceat(mix(grams ^ _SEEDS[1]), at[:-1][full])
                p = np.where(n > 0, prefix_length(n) + extra(n), 0)
                first = grams[np.arange(p.sum()) + np.repeat(at[:-1] - (np.cumsum(p) - p), p)]
                for k in range(0, len(b), _SEVERAL):  # more documents have no number in a chunk
                    of = slice(k, k + _SEVERAL)
                    ends = np.r_[0, np.cumsum(p)]
                    own = first[ends[k] : ends[min(k + _SEVERAL, len(b))]]
                    if waiting and (size + len(own) > CHUNK or docs + len(n[of]) > _SEVERAL):
                        yield chunk(waiting)
                        waiting, size, docs = [], 0, 0
                    waiting.append((_ids(b.column("doc"))[of], n[of], prints[0, of], prints[1, of], own, p[of]))
                    size, docs = size + len(own), docs + len(n[of])
        if waiting:
            yield chunk(waiting)
            waiting = []
        release()

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Of a bucket, for each piece how often each document of its chunk has an n-gram that another
    chunk has too; descriptions of chunks pass through."""
    about = table.filter(pc.is_valid(table.column("docs"))).select(["chunk", "docs"])
    table = table.filter(pc.is_valid(table.column("packed")))
    keys, owners = [], []
    for raw in table.column("packed").to_pylist():
        raw = _unpack(raw)
        m = len(raw) // 8
        keys.append(_of_six(raw[: 6 * m]))
        owners.append(np.frombuffer(raw, np.uint16, m, 6 * m))
    counts = []
    if keys:
        sizes = [len(k) for k in keys]
        keys = np.concatenate(keys)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        shared = np.zeros(len(keys), bool)
        shared[order] = np.r_[False, same] | np.r_[same, False]
        for own, hit in zip(owners, np.split(shared, np.cumsum(sizes)[:-1])):
            own = own[hit]
            who, k = np.unique(own[own != _SEVERAL], return_counts=True)
            counts.append(who.tobytes() + k.astype(np.uint32).tobytes())
        del keys, owners, order, same, shared
        release()
    return pa.table([
        pa.concat_arrays([*(c.cast(pa.binary()) for c in about.column("chunk").chunks), *(c.cast(pa.binary()) for c in table.column("chunk").chunks)]),
        pa.concat_arrays([*about.column("docs").chunks, pa.nulls(len(counts), pa.binary())]),
        pa.concat_arrays([pa.nulls(len(about), pa.binary()), _binary(counts)]),
    ], names=["chunk", "docs", "counts"])


def _described(table: pa.Table) -> pa.Table:
    """The documents of a chunk: size and 128-bit print of the set, and whether enough of its
    n-grams are shared for the document to be similar to any other."""
    parts = []
    # A chunk's name is a hash of its documents, so chunks of one name have the same ones.
    for about in (x for x in table.column("docs").to_pylist() if x is not None):
        parts.append(np.frombuffer(about, np.int64).reshape(5, -1).copy())
    local = parts[0][4]
    for raw in (x for x in table.column("counts").to_pylist() if x is not None):
        m = len(raw) // 6
        np.add.at(local, np.frombuffer(raw, np.uint16, m).astype(np.int64), np.frombuffer(raw[2 * m :], np.uint32))
    doc, n, one, two = (np.concatenate([x[k] for x in parts]) for k in range(4))
    known = np.tile(local, len(parts))
    # A partner has least(n) n-grams or more, and of its own it counts on as many more.
    some = (n > 0) & (known >= extra(least(n)) + 1)
    return pa.table([pa.array(doc, mask=doc == _FAMILIES), pa.array(n), pa.array(one), pa.array(two), pa.array(some)], names=["doc", "n", "print0", "print1", "some"])


# Step 2: sets and families


def _bitmap(docs: DataFrame) -> np.ndarray:
    """BITS bits, those set that ids of docs fall on: of fixed size, whatever their number."""
    slot = F.pmod(F.xxhash64("doc"), F.lit(BITS))
    # Spark counts from one: numbers 1 to 32768 are the bits of bucket 1.
    rows = docs.groupBy(F.bitmap_bucket_number(slot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot + 1)).alias("bits"))
    out = np.zeros((BITS // 32768, 4096), np.uint8)
    for row in rows.toLocalIterator():
        out[row.bucket - 1] = np.frombuffer(bytes(row.bits), np.uint8)
    return out.reshape(-1)


def _sets(bits: np.ndarray):
    """The sets and min-hashes of documents whose slot (third column) is set: those that are asked
    for, and a few more, without the texts having to move."""

    def run(batches):
        for batch in batches:
            slot = _ids(batch.column("slot"))
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))
            for b in slices(batch, "text"):
                grams, at = shingles(b.column("text"), SIZE)
                n = np.diff(at)
                b, at, n = b.filter(pa.array(n > 0)), np.r_[at[:-1][n > 0], at[-1]], n[n > 0]
                if not len(n):
                    continue
                signs = np.zeros((len(n), len(_SEEDS)), np.uint64)
                for j, seed in enumerate(_SEEDS):
                    signs[:, j] = mix(np.minimum.reduceat(mix(grams * seed), at[:-1]) + np.uint64(j))
                signs = pa.ListArray.from_arrays(np.arange(0, len(n) * len(_SEEDS) + 1, len(_SEEDS), dtype=np.int32), signs.reshape(-1).view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc").cast(pa.int64()), pa.array(n), signs, _binary(grams[s:e] for s, e in zip(at[:-1], at[1:]))], names=["doc", "n", "signs", "grams"])
        release()

    return run


def _join_group(table: pa.Table) -> pa.Table:
    docs, known = table.column("doc").to_pylist(), table.column("family").to_pylist()
    sets = [np.frombuffer(x, np.uint64) for x in table.column("grams").to_pylist()]
    links = link_group(sets, known)
    return pa.table([pa.array([docs[a] for a, _ in links], pa.int64()), pa.array([docs[b] for _, b in links], pa.int64())], names=["u", "v"])


def _linked(sets: DataFrame, members: DataFrame) -> DataFrame:
    """Verified links (u, v) in the groups of members (group, doc, family)."""
    found = members.join(sets.select("doc", "grams"), "doc").groupBy("group").applyInArrow(_join_group, "u long, v long")
    return keep(found, "links")


def _families(sets: DataFrame) -> DataFrame:
    """Links in blocks of documents with the same min-hash; a group met before is left out."""
    signed = sets.select("doc", F.posexplode("signs").alias("j", "sign")).select("doc", "j", F.struct("j", "sign").alias("same"))
    met = signed.groupBy("same").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who")).where("k > 1")
    met = keep(met.groupBy("k", "who").agg(F.min("same").alias("same")).select("k", "same"), "met")
    block = F.pmod(F.xxhash64("doc", "j"), F.ceil(F.col("k") / BLOCK))
    total = max(met.agg(F.sum("k")).first()[0] or 0, 1)
    members = join_unique(signed, met, "same", "k", total, "inner").select(F.xxhash64("same", block).alias("group"), "doc", F.col("doc").alias("family"))
    return _linked(sets, members)


# Step 3: what families leave


def _chunks(batches):
    """Sets with their documents' families, many documents to a row."""

    def row(parts):
        docs, family, grams, sizes = (np.concatenate(x) for x in zip(*parts))
        return pa.RecordBatch.from_arrays([_binary([x]) for x in (docs, family, sizes, grams)], names=["docs", "families", "sizes", "grams"])

    waiting, size = [], 0
    for b in batches:
        for doc, family, raw in zip(b.column("doc").to_pylist(), b.column("family").to_pylist(), b.column("grams").to_pylist()):
            own = np.frombuffer(raw, np.uint64)
            if waiting and size + len(own) > CHUNK:
                yield row(waiting)
                waiting, size = [], 0
            waiting.append((np.array([doc]), np.array([family]), own, np.array([len(own)])))
            size += len(own)
    if waiting:
        yield row(waiting)


def _chunk(b, i: int):
    return tuple(np.frombuffer(b.column(c)[i].as_py(), t) for c, t in (("docs", np.int64), ("families", np.int64), ("sizes", np.int64), ("grams", np.uint64)))


def _weigh(buckets: int):
    """Of each chunk, by bucket: how many of its documents have each n-gram, and their family."""
    def run(batches):
        for b in batches:
            for i in range(len(b)):
                docs, families, sizes, grams = _chunk(b, i)
                key, order, start, bucket = _order(grams, buckets)
                family = np.repeat(families, sizes)[order]
                low, high = np.minimum.reduceat(family, start), np.maximum.reduceat(family, start)
                family = np.where(low == high, low, _FAMILIES)
                count = np.diff(np.r_[start, len(key)]).astype(np.uint32)
                key, cut = key[start], _cuts(bucket)
                pieces = [_pack(_six(key[a:z]).tobytes() + family[a:z].tobytes() + count[a:z].tobytes()) for a, z in zip(cut[:-1], cut[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[cut[:-1]].astype(np.int32)), pa.array([b.column("chunk")[i].as_py()] * len(pieces), pa.int64()), pa.array(pieces, pa.binary())], names=["bucket", "chunk", "packed"])

    return run


def _levels(table: pa.Table) -> pa.Table:
    """For each piece of a bucket the level of its n-grams: 0 for those of one family, else one
    more than the logarithm of how many documents have them."""
    keys, families, counts = [], [], []
    for raw in table.column("packed").to_pylist():
        raw = _unpack(raw)
        m = len(raw) // 18
        keys.append(_of_six(raw[: 6 * m]))
        families.append(np.frombuffer(raw, np.int64, m, 6 * m))
        counts.append(np.frombuffer(raw, np.uint32, m, 14 * m))
    sizes = [len(k) for k in keys]
    _, place = np.unique(np.concatenate(keys), return_inverse=True)
    order = np.argsort(place, kind="stable")
    start = np.flatnonzero(np.r_[True, np.diff(place[order]) > 0])
    family, count = np.concatenate(families)[order], np.concatenate(counts)[order].astype(np.int64)
    low, high, total = np.minimum.reduceat(family, start), np.maximum.reduceat(family, start), np.add.reduceat(count, start)
    level = np.where((low == high) & (low != _FAMILIES), 0, np.log2(total).astype(np.int64) + 1).astype(np.uint8)[place]
    levels = [_pack(x.tobytes()) for x in np.split(level, np.cumsum(sizes)[:-1])]
    del keys, families, counts, place, order, family, count
    release()
    return pa.table([table.column("chunk"), table.column("bucket"), pa.array(levels, pa.binary())], names=["chunk", "bucket", "levels"])


def _prefixes(buckets: int):
    """Postings, by bucket, of the rarest n-grams of those documents of a chunk that have enough
    n-grams of other families: keys, documents, families and sizes, packed."""
    def run(chunk: pa.Table, levels: pa.Table) -> pa.Table:
        docs, families, sizes, grams = _chunk(chunk, 0)
        key, order, start, _ = _order(grams, buckets)
        found = sorted(zip(levels.column("bucket").to_pylist(), levels.column("levels").to_pylist()))
        level = np.frombuffer(b"".join(_unpack(x) for _, x in found), np.uint8)
        level = np.repeat(level, np.diff(np.r_[start, len(key)]))
        owner = np.repeat(np.arange(len(docs)), sizes)[order]
        enough = np.bincount(owner[level > 0], minlength=len(docs)) >= least(sizes)
        hit = np.flatnonzero(enough[owner])
        # N-grams of one family can't be shared with another: they come first and aren't posted.
        hit = hit[np.lexsort((key[hit], level[hit], owner[hit]))]
        own = owner[hit]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][: len(own)])
        place = np.arange(len(own)) - np.repeat(new, np.diff(np.r_[new, len(own)]))
        hit = hit[(place < prefix_length(sizes[own])) & (level[hit] > 0)]
        bucket = ((key[hit] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        hit = hit[np.argsort(bucket, kind="stable")]
        cut = _cuts(np.sort(bucket))
        pieces = []
        for a, z in zip(cut[:-1], cut[1:]):
            of = owner[hit[a:z]]
            pieces.append(_pack(b"".join(x.tobytes() for x in (key[hit[a:z]], docs[of], families[of], sizes[of]))))
        return pa.table([pa.array(np.sort(bucket)[cut[:-1]].astype(np.int32)), pa.array(pieces, pa.binary())], names=["bucket", "rows"])

    return run


_POSTING = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("family", "<i8"), ("n", "<i8")])


def _unpacked(raw: bytes) -> np.ndarray:
    columns = np.frombuffer(_unpack(raw), np.int64).reshape(4, -1)
    out = np.empty(columns.shape[1], _POSTING)
    out["gram"], out["doc"], out["family"], out["n"] = columns[0].view(np.uint64), *columns[1:]
    return out


def _lists(table: pa.Table) -> pa.Table:
    """Of a bucket's postings, the lists of two families at least, cut where sizes are too far
    apart for any link across; short ones as pairs of documents of different families."""
    rows = np.concatenate([_unpacked(x) for x in table.column("rows").to_pylist()])
    rows = rows[np.lexsort((rows["n"], rows["gram"]))]
    apart = (rows["gram"][1:] != rows["gram"][:-1]) | (DEN * rows["n"][:-1] < NUM * rows["n"][1:])
    start = np.flatnonzero(np.r_[True, apart])
    size = np.diff(np.r_[start, len(rows)])
    low, high = np.minimum.reduceat(rows["family"], start), np.maximum.reduceat(rows["family"], start)
    pairs, long_lists = [], []
    for s, k in zip(start[low != high].tolist(), size[low != high].tolist()):
        own = rows[s : s + k]
        if k > SHORT:
            long_lists.append(own)
            continue
        i, j = np.triu_indices(k, 1)
        a, b = own[i], own[j]  # a is no longer than b
        ok = (a["family"] != b["family"]) & (DEN * a["n"] >= NUM * b["n"])
        pairs.append(np.stack([a["doc"][ok], b["doc"][ok], a["n"][ok], b["n"][ok]], 1))
    pairs = np.concatenate(pairs) if pairs else np.zeros((0, 4), np.int64)
    swap = pairs[:, 0] > pairs[:, 1]
    pairs[swap] = pairs[swap][:, [1, 0, 3, 2]]
    pairs, shared = np.unique(pairs, axis=0, return_counts=True) if len(pairs) else (pairs, np.zeros(0, np.int64))
    of = np.concatenate(long_lists) if long_lists else np.zeros(0, _POSTING)
    none = lambda n: pa.nulls(n, pa.int64())
    columns = [np.r_[pairs[:, k], of[name]] for k, name in ((0, "doc"), (2, "n"))]
    return pa.Table.from_arrays([
        pa.array(columns[0]), pa.array(columns[1]),
        pa.concat_arrays([pa.array(pairs[:, 1]), none(len(of))]), pa.concat_arrays([pa.array(pairs[:, 3]), none(len(of))]),
        pa.array(np.r_[shared, np.ones(len(of), np.int64)]),
        pa.concat_arrays([none(len(pairs)), pa.array(of["gram"].view(np.int64))]),
    ], names=["a", "n", "b", "m", "shared", "gram"])


def _late(sets: DataFrame, family: DataFrame) -> DataFrame:
    """Links between families."""
    family = family.select(F.col("node").alias("doc"), F.col("component").alias("_family"))
    known = lambda rows: rows.join(family, "doc", "left").withColumn("family", F.coalesce("_family", "doc"))
    chunks = known(sets.select("doc", "grams")).select("doc", "family", "grams").mapInArrow(_chunks, "docs binary, families binary, sizes binary, grams binary")
    chunks = keep(chunks.withColumn("chunk", F.monotonically_increasing_id()), "chunks")
    buckets = _buckets(sets.agg(F.sum("n")).first()[0])
    levels = chunks.mapInArrow(_weigh(buckets), "bucket int, chunk long, packed binary").groupBy("bucket").applyInArrow(_levels, "chunk long, bucket int, levels binary")
    posts = chunks.groupBy("chunk").cogroup(levels.groupBy("chunk")).applyInArrow(_prefixes(buckets), "bucket int, rows binary")
    lists = keep(posts.groupBy("bucket").applyInArrow(_lists, "a long, n long, b long, m long, shared long, gram long"), "lists")
    long_lists = lists.where("gram is not null").select("gram", F.col("a").alias("doc"), "n")
    per_doc = long_lists.groupBy("doc").agg(F.count(F.lit(1)).alias("more"))
    pairs = lists.where("gram is null").groupBy("a", "b").agg(F.max("n").alias("n"), F.max("m").alias("m"), F.sum("shared").alias("shared"))
    for side in ("a", "b"):
        pairs = pairs.join(per_doc.select(F.col("doc").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    rest = F.greatest(*(F.expr(f"({NUM} * {n} + {DEN - 1}) div {DEN} - 1") for n in ("n", "m")))
    most = F.col("shared") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) + rest
    pairs = pairs.where((NUM + DEN) * most >= NUM * (F.col("n") + F.col("m")))
    # Documents that candidates connect make a group, so a set goes there once; those of a larger
    # component go, a block of partners at a time, to groups around one document.
    pairs = keep(pairs.select("a", "b"), "pairs")
    near = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "doc")
    sizes = near.groupBy("component").agg(F.count(F.lit(1)).alias("k"))
    small = near.join(sizes.where(F.col("k") <= 2 * BLOCK), "component").select(F.xxhash64("component", F.lit("candidates")).alias("group"), "doc")
    large = pairs.join(near.join(sizes.where(F.col("k") > 2 * BLOCK), "component").select(F.col("doc").alias("a")), "a")
    large = large.join(large.groupBy("a").agg(F.count(F.lit(1)).alias("k")), "a")
    around = F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("k") / (2 * BLOCK))))
    close = small.unionByName(large.select(around.alias("group"), F.explode(F.array("a", "b")).alias("doc")).distinct())
    wide = long_lists.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("who"))
    wide = wide.groupBy("k", "who").agg(F.min("gram").alias("gram"))
    wide = long_lists.join(wide.select("gram", F.ceil(F.col("k") / BLOCK).alias("blocks")), "gram").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    wide = wide.select(F.xxhash64("gram", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "doc")
    return _linked(sets, known(close.unionByName(wide)).select("group", "doc", "family"))


def _buckets(grams: int | None) -> int:
    return int(max(64, min((grams or 0) // BUCKET, 1 << 18)))


def jaccard_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id.

    component_id is the smallest id that similar documents reach; a document without words is
    similar to nothing. Ids name documents: rows that repeat an id are one document that links
    with whatever any of its texts links with. A row without id gets no component and links
    nothing. Ties need no rule, as components don't depend on any order; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_FAMILIES)).alias("doc"), F.col(text_col).alias("text"))
    # About five bytes of text to a word, half of whose n-grams are posted.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    posts = docs.mapInArrow(_post(_buckets(size // 10)), _POSTS).groupBy("bucket").applyInArrow(_shared, "chunk binary, docs binary, counts binary")
    rows = keep(posts.groupBy("chunk").applyInArrow(_described, "doc long, n long, print0 long, print1 long, some boolean"), "described")

    # Equal sets are one class, and its smallest document stands for it.
    same = F.struct("n", "print0", "print1").alias("same")
    with_set = rows.where("some and doc is not null").select("doc", same)
    classes = with_set.groupBy("same").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = keep(classes, "classes")
    wanted = classes.select(F.col("first").alias("doc")).distinct()
    slot = F.pmod(F.xxhash64("doc"), F.lit(BITS))
    sets = docs.select("doc", "text", slot.alias("slot")).mapInArrow(_sets(_bitmap(wanted)), "doc long, n long, signs array<long>, grams binary")
    sets = keep(sets.join(wanted, "doc"), "sets")
    repeats = rows.where("doc is not null").groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc")
    links = _families(sets)
    if repeats.limit(1).count():
        # Each of the texts of a document stands for it.
        own = with_set.join(repeats, "doc").join(classes, "same").select(F.col("doc").alias("u"), F.col("first").alias("v"))
        links = links.unionByName(own)
    late = _late(sets, keep(components(links), "family"))

    found = components(links.unionByName(late)).withColumnRenamed("node", "first")
    classes = classes.join(found, "first", "left").select("same", "size", F.coalesce("component", "first").alias("component"))
    total = max(rows.count(), 1)
    grouped = join_unique(rows.where("some and doc is not null").select("doc", "n", same), classes, "same", "size", total, "inner").select("doc", "n", "component")
    alone = rows.where("not some or doc is null").select("doc", "n", F.col("doc").alias("component"))
    return grouped.unionByName(alone).select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stand for their group: of each group the one with the smallest id;
    rows without id stay."""
    groups = jaccard_groups(docs, id_col, text_col)
    gone = groups.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("id")).distinct()
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    return own.join(gone, "id", "left_anti").select("row.*")


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 4], ' ')) AS gram FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS k FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT u, v FROM pairs JOIN sizes s ON s.doc_id = u JOIN sizes t ON t.doc_id = v WHERE 100 * k >= 75 * (s.n + t.n - k)),
both_ways AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT u, v FROM both_ways UNION SELECT reach.u, b.v FROM reach JOIN both_ways b ON reach.v = b.u)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(least(doc_id, (SELECT min(v) FROM reach WHERE u = doc_id)), doc_id) AS component_id FROM d LEFT JOIN sizes USING (doc_id)
"""
