"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

A rotation is learned on a bounded sample so that the signs of rotated vectors are balanced codes
that lose little (iterative quantisation). Every vector gets a code of BITS bits, cut into TABLES
parts, and looks in each table for codes whose part differs in at most one bit. By counting, this
finds all pairs of codes that differ in at most 2 * TABLES - 1 bits. Candidates within that
distance are ranked again with the original vectors. A pair counts at the first table that has it.

Parts that differ in at most one bit share one of their two halves. So vectors are dealt by label,
table and half of a part, eight rows each, and a task looks up the cells of the other half. Two
cells whose vectors have few close codes give pairs. The vectors of two cells that have many are
dealt into blocks, and each two blocks meet in a task, which says for each vector how many it links
with, and links that join what is joined: as many rows as vectors, however many pairs there are.

Spark takes a table that is exploded, grouped or made in Python for as small as what it was made
from, and would send it to the driver to broadcast it; so joins here name how they are done.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, smallest
from .workspace import join_unique, keep, ship

THRESHOLD = 0.98
BITS, TABLES = 64, 4
PART = BITS // TABLES
RADIUS = 2 * TABLES - 1
#: Vectors that the rotation is learned on, about; chosen by a hash of the id.
SAMPLE = 20_000
ROUNDS = 30
HALF = PART // 2
#: Quarters of a pair of close codes for each vector of two cells beyond which these are dealt into
#: blocks, and vectors of a block.
HOT, BLOCK = 32, 2048
#: Pairs of codes that are looked at at once; two cells that have more are dealt into blocks.
AT_ONCE = 1 << 21
#: Rows of a task that looks up cells, about.
ROWS = 1 << 14


def learn_rotation(x: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for signs of (x - mean) @ projection: main axes, then the rotation that
    alternating between nearest codes and nearest rotation gives."""
    dim = x.shape[1]
    mean = x.mean(0) if len(x) else np.zeros(dim)
    rng = np.random.default_rng(seed)
    centred = x - mean
    _, _, axes = np.linalg.svd(centred.T @ centred / max(len(x), 1) if len(x) else np.eye(dim))
    axes = axes[: min(bits, dim)].T
    if axes.shape[1] < bits:  # more bits than dimensions: random directions besides
        axes = np.hstack([axes, rng.standard_normal((dim, bits - axes.shape[1])) / np.sqrt(dim)])
    rotation, _ = np.linalg.qr(rng.standard_normal((bits, bits)))
    v = centred @ axes
    for _ in range(rounds if len(x) else 0):
        codes = np.where(v @ rotation >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        rotation = (left @ right).T
    return mean, axes @ rotation


def codes(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((x - mean) @ projection >= 0).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").reshape(-1).astype(np.uint64).view(np.int64)


def _matrix(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _code(mean, projection, dim):
    def run(batches):
        for b in batches:
            if len(b):
                own = codes(_unit(_matrix(b.column(1), dim)), mean, projection)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own)], names=["id", "code"])

    return run


def _rank(dim: int, threshold: float):
    def run(batches):
        for b in batches:
            if len(b):
                x, y = (_unit(_matrix(b.column(c), dim)) for c in ("x", "y"))
                ok = np.einsum("ij,ij->i", x, y) >= threshold
                yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(ok)) for c in ("u", "v", "n_u", "n_v")], names=["u", "v", "n_u", "n_v"])

    return run


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Rows link if their labels are equal and not null and the cosine in double precision is at
    least threshold. Vectors that are null, empty, zero or hold null or non-finite components link
    with nothing, nor do vectors of different lengths. Equal vectors of a label are one class with
    a number of rows, so copies are never paired with each other. Ids name vectors; a row
    without an id links with nothing. Ties and the order of rows don't matter; an
    empty table gives an empty one.
    """
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"), F.col(label_col).alias("label"))
    valid = F.col("label").isNotNull() & F.col("id").isNotNull() & F.coalesce(F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("x", lambda v: v != 0), F.lit(False))
    rows = keep(rows.withColumn("ok", valid), "vectors")
    good = rows.where("ok")
    classes = good.groupBy("label", "x").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("size"))
    classes = keep(classes, "classes")
    dims = sorted(r[0] for r in classes.select(F.size("x")).distinct().toLocalIterator())
    found = spark.createDataFrame([], _FOUND)
    for dim in dims:
        found = found.unionByName(_links(classes.where(F.size("x") == dim), dim, threshold))
    found = keep(found, "found")

    others = found.where("n is not null").groupBy("first").agg(F.sum("n").alias("others"))
    of_class = components(found.where("other is not null").select(F.col("first").alias("u"), F.col("other").alias("v"))).select(F.col("node").alias("first"), "component")
    classes = classes.join(others.hint("merge"), "first", "left").join(of_class.hint("merge"), "first", "left")
    classes = keep(classes.select(F.struct("label", "x").alias("same"), "size", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "first").alias("component_id")), "linked")
    total = max(rows.count(), 1)
    found = join_unique(good.select("id", F.struct("label", "x").alias("same")), classes, "same", "size", total, "inner", shuffled=True).select("id", "n_links", "component_id")
    alone = rows.where("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


#: n: how many vectors first links with, in part; other: one that it links with.
_FOUND = "first long, n long, other long"


def _new(differ: np.ndarray, t) -> np.ndarray:
    """Whether codes that differ so are close, and no table before t has them."""
    ok = np.bitwise_count(differ) <= RADIUS
    for before in range(TABLES - 1):
        ok &= (np.bitwise_count(differ >> np.uint64(PART * before) & np.uint64((1 << PART) - 1)) > 1) | (t <= before)
    return ok


def _look(group: pa.Table) -> pa.Table:
    """Pairs of close codes of the cells of some (lab, k, half of a part), k: its place in the code;
    of two cells that have many, where they are and how many vectors they have."""
    first, code, lab, k = (group.column(c).to_numpy() for c in ("first", "code", "lab", "k"))
    code, k = code.view(np.uint64), k.astype(np.int64)
    labs, place = np.unique(lab, return_inverse=True)
    half = lambda k: (code >> (HALF * k).astype(np.uint64) & np.uint64((1 << HALF) - 1)).astype(np.int64)
    key = ((place * (2 * TABLES) + k << HALF | half(k)) << HALF) | half(k ^ 1)
    order = np.argsort(key)
    first, code = first[order], code[order]
    cells, start, size = np.unique(key[order], return_index=True, return_counts=True)
    at = cells >> 2 * HALF
    lab, k = labs[at // (2 * TABLES)], at % (2 * TABLES)
    pairs, large = [], []
    for flip in (0, *(1 << i for i in range(HALF))):
        # Cells that are one and the same meet at their lower half only.
        a = np.flatnonzero(k % 2 == 0) if flip == 0 else np.flatnonzero(cells & flip == 0)
        b = np.minimum(np.searchsorted(cells, cells[a] | flip), len(cells) - 1)
        a, b = (x[cells[b] == cells[a] | flip] for x in (a, b))
        n = size[a] * size[b]
        many = n > AT_ONCE
        large.append((a[many], b[many]))
        a, b, n = a[~many & (n > (flip == 0))], b[~many & (n > (flip == 0))], n[~many & (n > (flip == 0))]
        i = 0
        ends = np.cumsum(n)
        while i < len(a):
            to = max(int(np.searchsorted(ends, (ends[i - 1] if i else 0) + AT_ONCE, "right")), i + 1)
            own = np.repeat(np.arange(i, to), n[i:to])
            left, right = np.divmod(np.arange(len(own)) - (ends[own] - n[own] - (ends[i] - n[i])), size[b[own]])
            u, v = start[a[own]] + left, start[b[own]] + right
            ok = _new(code[u] ^ code[v], k[a[own]] // 2)
            if flip == 0:
                ok &= u < v
            found = np.bincount(own[ok] - i, minlength=to - i)
            dense = 4 * found > HOT * (size[a[i:to]] + size[b[i:to]])
            large.append((a[i:to][dense], b[i:to][dense]))
            ok &= ~dense[own - i]
            pairs.append((first[u[ok]], first[v[ok]]))
            i = to
    u, v = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64),) * 2
    a, b = (np.concatenate(x) for x in zip(*large))
    none = lambda n, kind: pa.nulls(n, kind)
    columns = [pa.concat_arrays([pa.array(x), none(len(a), pa.int64())]) for x in (np.minimum(u, v), np.maximum(u, v))]
    columns += [pa.concat_arrays([none(len(u), pa.int64()), pa.array(x.astype(np.int64))]) for x in (lab[a], k[a] // 2, _part(cells[a], k[a]), _part(cells[b], k[a]), size[a], size[b])]
    return pa.table(columns, names=_LOOKED.replace(" long", "").split(", "))


def _part(cell: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The part of a code that the halves in a cell's key are of."""
    shared, other = cell >> HALF & (1 << HALF) - 1, cell & (1 << HALF) - 1
    return np.where(k % 2 == 0, other << HALF | shared, shared << HALF | other)


_LOOKED = "u long, v long, lab long, t long, a long, b long, n_a long, n_b long"


def _meet(dim: int, threshold: float):
    """The links between a block of vectors of a cell and one of vectors of the other cell."""

    def run(group: pa.Table) -> pa.Table:
        looks = group.column("looks").to_numpy()
        first, code, size = (group.column(c).to_numpy() for c in ("first", "code", "size"))
        x = _unit(_matrix(group.column("x").combine_chunks(), dim))
        here, there = np.flatnonzero(~looks), np.flatnonzero(looks)
        t, a, b = (group.column("cells")[0].as_py()[c] for c in ("t", "a", "b"))
        near = _new(code.view(np.uint64)[here][:, None] ^ code.view(np.uint64)[there][None, :], t)
        if a == b:
            near &= first[here][:, None] < first[there][None, :]
        near &= x[here] @ x[there].T >= threshold
        n = near.astype(np.int64)
        counts = np.r_[n @ size[there], n.T @ size[here]]
        i, j = np.nonzero(near)
        node, least = smallest(first[here][i], first[there][j])
        node, least = node[node != least], least[node != least]
        ids, some = np.r_[first[here], first[there]], counts > 0
        none = lambda k: pa.nulls(k, pa.int64())
        return pa.table([
            pa.array(np.r_[ids[some], node]), pa.concat_arrays([pa.array(counts[some]), none(len(node))]),
            pa.concat_arrays([none(int(some.sum())), pa.array(least)]),
        ], names=["first", "n", "other"])

    return run


def _links(classes: DataFrame, dim: int, threshold: float) -> DataFrame:
    """Links of classes of vectors of dim components: rows of _FOUND."""
    n = max(classes.count(), 1)
    share = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("first", F.lit("sample")), F.lit(1 << 62)).cast("double") < share * float(1 << 62)).select("first", "x").limit(2 * SAMPLE)
    x = _matrix(sample.orderBy("first").select("x").toArrow().column(0).combine_chunks(), dim)
    mean, projection = learn_rotation(_unit(x) if len(x) else x)
    coded = classes.select("first", "x").mapInArrow(_code(mean, projection, dim), "id long, code long").withColumnRenamed("id", "first")
    coded = keep(classes.select("first", F.xxhash64("label").alias("lab")).join(coded.hint("merge"), "first"), "codes")
    # Labels meet by their hashes here and are compared before a link counts.
    half = F.array(*[F.shiftrightunsigned("code", HALF * k).bitwiseAND(F.lit((1 << HALF) - 1)) for k in range(2 * TABLES)])
    dealt = coded.select("first", "code", "lab", F.posexplode(half).alias("k", "half"))
    tasks = max(2 * TABLES * n // ROWS, 2 * classes.sparkSession.sparkContext.defaultParallelism)
    dealt = dealt.select(F.pmod(F.xxhash64("lab", "k", "half"), F.lit(tasks)).alias("task"), "first", "code", "lab", "k")
    looked = keep(dealt.groupBy("task").applyInArrow(_look, _LOOKED), "candidates")

    # Few: pairs.
    whole = classes.select("first", "label", "x", "size")
    side = lambda u, x: whole.select(F.col("first").alias(u), F.col("label").alias(f"label_{u}"), F.col("x").alias(x), F.col("size").alias(f"n_{u}")).hint("merge")
    pairs = looked.where("u is not null").select("u", "v").join(side("u", "x"), "u").join(side("v", "y"), "v").where("label_u = label_v")
    pairs = pairs.select("u", "v", "n_u", "n_v", "x", "y").mapInArrow(_rank(dim, threshold), "u long, v long, n_u long, n_v long")
    sides = F.explode(F.array(F.struct(F.col("u").alias("first"), F.col("n_v").alias("n"), F.col("v").alias("other")), F.struct(F.col("v").alias("first"), F.col("n_u").alias("n"), F.lit(None).cast("long").alias("other"))))
    found = pairs.select(sides.alias("side")).select("side.*")
    dense = looked.where("u is null")
    if dense.first() is None:
        return found

    # Many: blocks of the vectors of a cell and of those of the other, each with each.
    cell = lambda part: F.struct("lab", "t", F.col(part).alias("part"))
    blocks_of = lambda n: F.ceil(F.col(n) / BLOCK).cast("long")
    role = lambda part, n, other, looks: F.struct(cell(part).alias("cell"), F.col(n).alias("k"), F.struct(F.struct("lab", "t", "a", "b").alias("cells"), F.lit(looks).alias("looks"), blocks_of(n).alias("own"), blocks_of(other).alias("others")).alias("role"))
    roles = dense.select(F.explode(F.array(role("a", "n_a", "n_b", False), role("b", "n_b", "n_a", True))).alias("r")).select("r.*")
    roles = keep(roles.groupBy("cell").agg(F.max("k").alias("k"), F.collect_list("role").alias("roles")), "dense")
    total = max(roles.agg(F.sum("k")).first()[0] or 0, 1)
    parts = F.array(*[F.shiftrightunsigned("code", PART * t).bitwiseAND(F.lit((1 << PART) - 1)) for t in range(TABLES)])
    cells = coded.select("first", "code", "lab", F.posexplode(parts).alias("t", "part")).withColumn("t", F.col("t").cast("long")).select("first", "code", cell("part").alias("cell"))
    met = join_unique(cells, roles, "cell", "k", total, "inner", shuffled=True).select("first", "code", F.explode("roles").alias("role")).select("first", "code", "role.*")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1))
    met = met.select("first", "code", "cells", "looks", F.pmod(F.xxhash64("first"), F.col("own")).alias("own"), every.alias("other"))
    met = met.select("first", "code", "cells", "looks", F.when(F.col("looks"), F.col("other")).otherwise(F.col("own")).alias("block"), F.when(F.col("looks"), F.col("own")).otherwise(F.col("other")).alias("asker"))
    met = met.join(whole.hint("merge"), "first").groupBy("cells", "label", "block", "asker").applyInArrow(_meet(dim, threshold), _FOUND)
    return found.unionByName(met)
