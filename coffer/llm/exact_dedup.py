"""Exact de-duplication by a tree of merges of sorted digest runs, in DataFrame operations only.

Every input partition is a run of (digest, largest id, rows), and a run has one of 2 ** bits
owners. A digest's home is the owner whose number its second hash ends in. In each round the
owners exchange parts of their runs as binomial trees do: two bits of a digest's owner become those
of its home, so each owner gets parts of four runs, sorts them together and keeps of equal digests
one, with the largest id and the sum of rows. After the last round every digest is at home, in one
sorted run. A group of copies of any size is a row of each run after the first round, and no owner
ever merges more than four of those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import join_unique, keep

_KEY = ("digest", "n_bytes", "check")


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, SHA-256, length in bytes and a 64-bit hash of each text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.xxhash64(text).alias("check"),
    )


#: Rows of digests for a task of the tree, and bits of an owner's number that a round settles.
ROWS, STEP = 500_000, 2


def tree_bits(partitions: int, total: int) -> int:
    """Bits of an owner's number: as many owners as shuffles have partitions, more for more rows."""
    return max(partitions, total // ROWS, 4).bit_length()


def groups(rows: DataFrame, total: int, bits: int | None = None) -> DataFrame:
    """(digest, n_bytes, check, keep_id, size) of each distinct text from digests(), of which there
    are total rows. What counts as equal agrees in digest, length and a second hash."""
    if bits is None:
        bits = tree_bits(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), total)
    home = F.shiftright("check", 8).bitwiseAND(F.lit((1 << bits) - 1).cast("long")).cast("int")
    runs = rows.select(*_KEY, F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("size"), F.spark_partition_id().bitwiseAND((1 << bits) - 1).alias("owner"))
    for low in range(0, bits, STEP):
        settled = ((1 << STEP) - 1) << low & ((1 << bits) - 1)
        runs = runs.withColumn("owner", F.col("owner").bitwiseAND(~settled).bitwiseOR(home.bitwiseAND(settled)))
        # The largest of a struct is found by merging sorted rows, where that of a number would be
        # found in a hash table.
        merged = runs.repartition(1 << bits, "owner").groupBy("owner", *_KEY)
        runs = merged.agg(F.max(F.struct("keep_id")).alias("kept"), F.sum("size").alias("size"))
        runs = runs.select(*_KEY, F.col("kept.keep_id").alias("keep_id"), "size", "owner")
    return runs.drop("owner")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256.

    Of rows with identical texts (null: empty) that with the largest id stays. Rows that repeat
    both id and text can't be told apart and share their fate; a null id is the smallest. An empty
    table gives an empty one; other columns of docs are ignored, whatever their names.
    """
    rows = keep(digests(docs, id_col, text_col), "digests")
    total = rows.count()
    merged = keep(groups(rows, total, bits), "groups")
    same = F.struct("digest", "n_bytes", "check").alias("same")
    found = join_unique(rows.select("id", "digest", same), merged.select(same, "keep_id", "size"), "same", "size", total, "inner")
    return found.select(
        F.col("id").alias(id_col), "keep_id", F.col("size").alias("group_size"),
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup() keeps, with all their columns."""
    rows = keep(digests(docs, id_col, text_col), "digests")
    merged = groups(rows, rows.count()).select("digest", F.col("keep_id").alias("id"), "n_bytes")
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.struct("*").alias("row"), F.unhex(F.sha2(text, 256)).alias("digest"), F.col(id_col).cast("long").alias("id"), F.octet_length(text).cast("long").alias("n_bytes"))
    same = (own["digest"] == merged["digest"]) & own["id"].eqNullSafe(merged["id"]) & (own["n_bytes"] == merged["n_bytes"])
    return own.join(merged, same, "left_semi").select("row.*")


SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""
