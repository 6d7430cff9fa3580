"""Mixing sources to target weights by hash-random order, prefix sums and exact cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .workspace import keep

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
WORD = r"[^\x20\x09-\x0D]+"
#: The leading hexadecimal digits of the key that name a slice of a source.
SLICE_DIGITS = 3


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the words to take of each.

    Sources in the order of their code points, null last, have the weights in turn. A target is
    the source's share by weight of all that is to be taken, but at most epochs * source_size;
    what the bounded ones leave goes to the others by weight. So target = min(epochs * size,
    level * weight) with one level for all. Taking the sources in the order in which they become
    bounded, the level that the rest would have rises up to the true one and then falls.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long")
    s = sizes.withColumn("weight", weight).withColumn("bound", F.col("source_size") * epochs)
    s = s.withColumn("ratio", F.col("bound").cast("double") / F.col("weight"))
    by_ratio = W.orderBy("ratio", F.col("source").isNull(), "source")
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("_all", F.sum("source_size").over(everything))
    s = s.withColumn("_below", F.coalesce(F.sum("bound").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("_weights", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
    s = s.withColumn("_level", (F.col("_all").cast("double") * share - F.col("_below")) / F.col("_weights"))
    s = s.withColumn("_level", F.max("_level").over(everything))
    return s.select("source", "source_size", F.least(F.col("bound").cast("double"), F.col("_level") * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix", **how) -> DataFrame:
    """One row per row of docs: id, size, source, source_size, target, taken.

    Rows get the key md5(seed/id), which orders each source at random and alike in every run; ties
    (rows that repeat an id) go by size and then share a place, so each is taken alike. The whole
    source is taken floor(target / size) times; of the rest, the rows whose running sum of sizes
    is within it, and of the row at the cut just the words that still fit. Only (source, slice)
    sums meet in a window per source: at most 16 ** SLICE_DIGITS rows, however large it is. Null
    and wordless texts have size 0 and nothing taken; a null source is a source; an empty table
    gives an empty one.
    """
    key = F.md5(F.concat_ws("/", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = keep(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key")), "sizes")
    rows = rows.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    of_source = W.partitionBy("source")
    slices = slices.withColumn("before", F.sum("slice_size").over(of_source.orderBy("slice").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("slice_size"))
    goal = targets(slices.groupBy("source").agg(F.sum("slice_size").alias("source_size")), **how)
    slices = slices.join(goal, slices["source"].eqNullSafe(goal["source"])).drop(goal["source"])
    # A source's rows are dealt by slice, so a hot source is no hot key.
    placed = rows.withColumn("upto", F.sum("size").over(W.partitionBy("source", "slice").orderBy("key", "id", "size").rowsBetween(W.unboundedPreceding, W.currentRow)))
    s = slices.select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "before", "source_size", "target")
    placed = placed.join(s, placed["source"].eqNullSafe(s["_source"]) & (placed["slice"] == s["_slice"]))
    start = F.col("before") + F.col("upto") - F.col("size")
    budget = F.round("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.expr("CAST(round(target) AS BIGINT) div greatest(source_size, 1)")).otherwise(F.lit(0))
    rest = budget - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.least(rest - start, F.col("size")), F.lit(0))
    return placed.select(F.col("id").alias(id_col), "size", "source", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes them: a row for each time a document is taken, with all columns. The
    document at a source's cut comes last with the words that fit, up to the end of the last of
    them; a document without words is no part of a mix."""
    taken = mix_sources(docs, id_col, text_col, source_col).where("taken > 0").select(F.col(id_col).alias("id"), "size", "taken").dropDuplicates(["id", "size"])
    own = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), n_words(F.col(text_col)).alias("size"))
    out = own.join(taken, own["id"].eqNullSafe(taken["id"]) & (own["size"] == taken["size"])).select("row", taken["size"], "taken")
    out = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("size")).cast("int"))))
    left = F.col("taken") - (F.col("copy") - 1) * F.col("size")
    text = F.col("row")[text_col]
    words = F.regexp_extract_all(text, F.lit(r"([\x20\x09-\x0D]*" + WORD + ")"), F.lit(1))
    text = F.when(left >= F.col("size"), text).otherwise(F.concat_ws("", F.slice(words, F.lit(1), F.greatest(left, F.lit(1)).cast("int"))))
    return out.select(F.col("row").withField(text_col, text).alias("row")).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5('mix/' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
s2 AS (SELECT *, {EPOCHS} * source_size AS bound, CAST({EPOCHS} * source_size AS DOUBLE) / weight AS ratio FROM s1),
s3 AS (SELECT *, (CAST((SELECT sum(source_size) FROM s2) AS DOUBLE) * {SHARE}
          - coalesce(sum(bound) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM s2),
s AS (SELECT source, source_size, least(CAST(bound AS DOUBLE), (SELECT max(level) FROM s3) * weight) AS target FROM s3),
p AS (SELECT d.*, s.source_size, s.target, CAST(round(s.target) AS BIGINT) AS budget,
             CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
      FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
            + greatest(least(budget - (budget // source_size) * source_size - start, size), 0) END AS BIGINT) AS taken
FROM p
"""
