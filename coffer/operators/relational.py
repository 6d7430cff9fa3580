"""What is done with entries as relations: all of it by DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import columns as X


def common_root(entries: DataFrame, by: str = "archive") -> DataFrame:
    """(archive, root): the one first part of all paths, if it is a folder or something lies below
    it; else null, as for an empty path or several first parts."""
    path = F.regexp_replace(F.col("path"), "/+$", "")
    first = F.substring_index(path, "/", 1)
    below = path.contains("/") | (F.col("kind") == "Dir")
    found = entries.groupBy(by).agg(F.min(first).alias("a"), F.max(first).alias("z"), F.bool_or(below).alias("folder"), F.bool_or(path == "").alias("empty"))
    return found.select(by, F.when((F.col("a") == F.col("z")) & F.col("folder") & ~F.col("empty"), F.col("a")).alias("root"))


def select_entries(entries: DataFrame, selection: DataFrame | None) -> DataFrame:
    """The entries whose (archive, idx) is selected; all, if there is no selection."""
    return entries if selection is None else entries.join(selection.select("archive", "idx").distinct(), ["archive", "idx"], "left_semi")


def without_macos_metadata(entries: DataFrame) -> DataFrame:
    return entries.where(~X.is_macos_metadata("path"))


def encoding_of_names(entries: DataFrame) -> DataFrame:
    """(archive, all_utf8, n_names): whether the names of an archive need no guess."""
    return entries.groupBy("archive").agg(F.bool_and(X.is_utf8("path_raw")).alias("all_utf8"), F.count(F.lit(1)).alias("n_names"))


def encrypted_archives(entries: DataFrame) -> DataFrame:
    """(archive, any_encrypted, first_encrypted): the first encrypted idx, or null."""
    return entries.groupBy("archive").agg(F.bool_or("is_encrypted").alias("any_encrypted"), F.min(F.when(F.col("is_encrypted"), F.col("idx"))).alias("first_encrypted"))


def warc_entries(records: DataFrame) -> DataFrame:
    """Entries of parsed records (archive, record_no, type, uri, date, block): responses and
    resources, with a name from the address, record-k without one (k: entries before), and -n for
    the nth repeat of a name in its archive."""
    kept = records.where(F.col("type").isin("response", "resource"))
    in_order = W.partitionBy("archive").orderBy("record_no")
    kept = kept.withColumn("idx", (F.row_number().over(in_order) - 1).cast("int"))
    base = F.when(F.coalesce(F.col("uri"), F.lit("")) != "", X.uri_to_path("uri")).otherwise(F.concat(F.lit("record-"), F.col("idx").cast("string")))
    kept = kept.withColumn("base", base)
    again = F.row_number().over(W.partitionBy("archive", "base").orderBy("record_no")) - 1
    name = F.when(again > 0, F.concat_ws("-", "base", again.cast("string"))).otherwise(F.col("base"))
    body = F.when(F.col("type") == "response", X.strip_http_headers("block")).otherwise(F.col("block"))
    return kept.select("archive", "idx", name.alias("path"), X.warc_seconds("date").alias("modified_s"), body.alias("content"))


def msi_directories(directories: DataFrame, depth: int = 256) -> DataFrame:
    """(directory, path) of (directory, parent, default_dir), by a recursive query: names from the
    root down. A root, which has no parent or itself, adds no name, nor does one that is empty or
    a dot; a circle ends where it closes. With a column archive, directories are those of an archive
    and so are the results."""
    spark, of = directories.sparkSession, _archive(directories)
    named = directories.select(F.col("archive") if of else F.lit("").alias("archive"), "directory", "parent", X.default_dir_name("default_dir").alias("name"))
    named.createOrReplaceTempView("_msi_directories")
    found = spark.sql(f"""
        WITH RECURSIVE up(archive, start, cur, segs, seen) MAX RECURSION LEVEL {depth + 1} AS (
          SELECT archive, directory, directory, CAST(array() AS ARRAY<STRING>), CAST(array() AS ARRAY<STRING>) FROM _msi_directories
          UNION ALL
          SELECT up.archive, up.start, d.parent, IF(d.name IS NULL, up.segs, concat(array(d.name), up.segs)), concat(up.seen, array(up.cur))
          FROM up JOIN _msi_directories d ON up.cur = d.directory AND up.archive = d.archive
          WHERE d.parent IS NOT NULL AND d.parent <> '' AND d.parent <> d.directory AND NOT array_contains(up.seen, up.cur) AND size(up.seen) < {depth})
        SELECT archive, start AS directory, array_join(max_by(segs, size(seen)), '/') AS path FROM up GROUP BY archive, start""")
    return found.select(*of, "directory", "path")


def _archive(df: DataFrame) -> list[str]:
    return ["archive"] if "archive" in df.columns else []


def msi_paths(members: DataFrame, files: DataFrame, components: DataFrame, directories: DataFrame) -> DataFrame:
    """members (name, ...) of the cabinets with their installed path: three joins. A member without
    a file row keeps its name, a file without a component its bare long name. The tables of many
    archives have a column archive, which is then part of every key."""
    of = _archive(members)
    paths = msi_directories(directories).withColumnRenamed("path", "dir_path")
    f = files.select(*of, F.col("file").alias("name"), "component", X.file_long_name("file_name").alias("long_name"))
    out = members.join(f, [*of, "name"], "left").join(components.select(*of, "component", "directory"), [*of, "component"], "left").join(paths, [*of, "directory"], "left")
    path = F.when(F.col("long_name").isNull(), F.col("name")).when(F.coalesce("dir_path", F.lit("")) == "", F.col("long_name")).otherwise(F.concat_ws("/", "dir_path", "long_name"))
    return out.select(*members.columns, path.alias("path"))


def wim_bodies(dentries: DataFrame, lookup: DataFrame) -> DataFrame:
    """dentries (archive, idx, hash, ...) with (size, resource_offset) of their bodies by a join on
    the hash. The zero hash has an empty body; of a hash that is listed twice the last row counts;
    a missing one is an error."""
    last = lookup.groupBy("archive", "hash").agg(F.max_by(F.struct("size", "resource_offset"), "row_no").alias("body"))
    joined = dentries.join(last, ["archive", "hash"], "left")
    zero = F.col("hash") == F.lit(bytes(20))
    size = F.when(zero, F.lit(0)).when(F.col("body").isNull(), F.raise_error(F.lit("CORRUPT: wim body is missing"))).otherwise(F.col("body.size"))
    return joined.select(*dentries.columns, size.cast("long").alias("size"), F.when(~zero, F.col("body.resource_offset")).alias("resource_offset"))


def dmg_sectors(chunks: DataFrame) -> DataFrame:
    """(archive, total_sectors, data_chunks) of (archive, type, sector, sectors): the image's size
    and how many chunks carry data."""
    carries = ~F.col("type").isin(0, 2, 0x7FFFFFFE, 0xFFFFFFFF)
    return chunks.groupBy("archive").agg(F.max(F.col("sector") + F.col("sectors")).alias("total_sectors"), F.count_if(carries).alias("data_chunks"))


def chunk_spans(offsets: DataFrame, of: str = "resource") -> DataFrame:
    """(resource, chunk, start, end) of chunk tables (resource, chunk, offset, length): a chunk ends
    where the next begins, the last with the resource."""
    order = W.partitionBy(of).orderBy("chunk")
    return offsets.select(of, "chunk", F.col("offset").alias("start"), F.coalesce(F.lead("offset").over(order), F.col("length")).alias("end"))


def volume_members(files: DataFrame) -> DataFrame:
    """(volume, n, path): parts .001, .002, ... of split files, up to the first gap; a set begins
    at .001."""
    parted = files.select("path", F.regexp_extract("path", r"^(.*)\.[0-9]{3,}$", 1).alias("volume"), F.regexp_extract("path", r"\.([0-9]{3,})$", 1).alias("digits"))
    parted = parted.where("digits <> ''").withColumn("n", F.col("digits").cast("int"))
    place = F.row_number().over(W.partitionBy("volume").orderBy("n"))
    return parted.withColumn("place", place).where("n = place").select("volume", "n", "path")


def assemble_volumes(files: DataFrame) -> DataFrame:
    """(path, content) with the parts of each split file put together under the name without the
    number; other files as they are. A set without .001 is left out."""
    parts = volume_members(files).join(files.select("path", "content"), "path")
    whole = parts.groupBy("volume").agg(F.array_sort(F.collect_list(F.struct("n", "content"))).alias("parts"))
    empty = F.lit(b"")
    whole = whole.select(F.col("volume").alias("path"), F.aggregate("parts", empty, lambda a, p: F.concat(a, p["content"])).alias("content"))
    return whole.unionByName(files.where(~F.col("path").rlike(r"\.[0-9]{3,}$")).select("path", "content"))


def first_data_member(members: DataFrame) -> DataFrame:
    """Of package members (archive, member_no, name) the first that begins with data.tar."""
    return members.where(F.startswith(F.col("name"), F.lit("data.tar"))).groupBy("archive").agg(F.min_by("name", F.struct("member_no", "name")).alias("name"), F.min("member_no").alias("member_no"))


def earliest_signature(content: Column | str, *signatures: bytes) -> Column:
    """The first place (from 0) of any signature, or null; the search is on Latin-1 text, where a
    character is a byte."""
    text = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
    places = [F.nullif(F.position(F.decode(F.lit(s), "ISO-8859-1"), text), F.lit(0)) for s in signatures]
    return F.least(*places) - 1 if len(places) > 1 else places[0] - 1


def extract_plan(entries: DataFrame, selection: DataFrame | None = None, keep_macos_metadata: bool = False, wrap: bool = True) -> DataFrame:
    """Where each entry would go: (archive, idx, kind, path, target, status). target lies in a
    folder named like the archive if its entries have no common root; status says why there is
    none."""
    chosen = select_entries(entries, selection)
    if not keep_macos_metadata:
        chosen = without_macos_metadata(chosen)
    roots = common_root(chosen)
    planned = chosen.join(roots, "archive", "left")
    top = F.when(F.col("root").isNull() & F.lit(wrap), X.wrapper_name("archive")).otherwise(F.lit(""))
    target = X.safe_join(top, "path")
    target = F.regexp_replace(target, "^/", "")
    bad_link = (F.col("kind") == "Symlink") & X.safe_symlink_target("path", "link_target").isNull()
    status = F.when(target.isNull() | bad_link, "PATH_TRAVERSAL").otherwise("OK")
    return planned.select("archive", "idx", "kind", "path", F.when(status == "OK", target).alias("target"), status.alias("status"))


def extract_report(plan: DataFrame) -> DataFrame:
    """(archive, extracted, failed) by status."""
    return plan.groupBy("archive").agg(F.count_if(F.col("status") == "OK").alias("extracted"), F.count_if(F.col("status") != "OK").alias("failed"))
