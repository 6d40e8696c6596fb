"""Search, listing and classification of directory entries."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..session import stored


def wildcard(name: Column, pattern: str) -> Column:
    """* any run, ? any character; the whole name, without regard to case."""
    parts = [".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern]
    return name.rlike("(?iu)^" + "".join(parts) + "$")


def predicate(query: str, name: Column) -> Column | None:
    """What a search box's text asks of a name: a wildcard, an extension, or a substring. None for a blank."""
    query = query.strip()
    if not query:
        return None
    if "*" in query or "?" in query:
        return wildcard(name, query)
    if query.startswith("."):
        return S.extension(name) == query.lower()
    return F.contains(F.lower(name), F.lit(query.lower()))


def search(entries: DataFrame, query: str) -> DataFrame:
    """Directories and regular files whose name fits; `.` and `..` never do. A blank query gives all."""
    own = entries.filter(~F.col("name").isin(".", ".."))
    fits = predicate(query, F.col("name"))
    return own if fits is None else own.filter(fits)


def with_extensions(entries: DataFrame, extensions: list[str] | None) -> DataFrame:
    """Directories, and files with one of the extensions; None, or '' among them, means all files."""
    if extensions is None or "" in extensions:
        return entries
    return entries.filter(F.col("is_directory") | S.extension(F.col("name")).isin([e.lower() for e in extensions]))


def on_allocated_volumes(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """Entries of allocated volumes; those of an image without a volume table (start_offset 0) stay.

    volumes is the list of partitions of the images at hand: a left semi join lets the planner pick the side."""
    kept = volumes.filter("is_alloc").select("image_id", F.col("start").alias("start_offset"))
    whole = entries.join(volumes.select("image_id").distinct(), "image_id", "left_anti").filter("start_offset = 0")
    return entries.join(kept, ["image_id", "start_offset"], "left_semi").unionByName(whole)


def with_volume_path(entries: DataFrame, volumes: DataFrame) -> DataFrame:
    """path with its volume's name in front; vol0 where no volume starts at the offset."""
    names = volumes.select("image_id", F.col("start").alias("start_offset"), F.concat(F.lit("vol"), F.col("addr").cast("string")).alias("vol_name"))
    joined = entries.join(names, ["image_id", "start_offset"], "left")
    return joined.withColumn("path", F.concat(F.coalesce("vol_name", F.lit("vol0")), F.lit(":"), "path")).drop("vol_name")


def volume_class(desc: Column) -> Column:
    """special, unallocated or normal, by a partition's description."""
    has = lambda *words: F.greatest(*[F.contains(desc, F.lit(w)) for w in words]) if len(words) > 1 else F.contains(desc, F.lit(words[0]))
    return F.when(has("Primary Table", "Safety Table", "GPT Header"), F.lit("special")).when(has("Unallocated", "Microsoft reserved"), F.lit("unallocated")).otherwise(F.lit("normal"))


def resolve_icons(rows: DataFrame, icons: DataFrame, kind: str, ext: str, default: str) -> DataFrame:
    """icon of each row: that of (kind, ext), else of (kind, generic) or a folder's, else the default.

    icons(type, extension, path) is a dimension of a few hundred rows; the joins are plain, so the planner
    broadcasts it while it is small."""
    exact = icons.select(F.col("type").alias(kind), F.col("extension").alias(ext), F.col("path").alias("icon_exact")).dropDuplicates([kind, ext])
    spare = icons.filter(((F.col("type") == "folder") & (F.col("extension") == "folder")) | ((F.col("type") != "folder") & (F.col("extension") == "generic")))
    spare = spare.select(F.col("type").alias(kind), F.col("path").alias("icon_spare")).dropDuplicates([kind])
    return rows.join(exact, [kind, ext], "left").join(spare, kind, "left").withColumn("icon", F.coalesce("icon_exact", "icon_spare", F.lit(default))).drop("icon_exact", "icon_spare")


def children(entries: DataFrame, start_offset: int, inode: int) -> DataFrame:
    """One directory's listing."""
    return entries.filter((F.col("start_offset") == start_offset) & (F.col("parent_inode") == inode) & ~F.col("name").isin(".", ".."))


def with_parents(entries: DataFrame) -> DataFrame:
    """parent_name and grandparent_inode of each entry, by two self joins on the volume and inode."""
    keys = ["image_id", "start_offset"]
    up = entries.select(*keys, F.col("inode").alias("parent_inode"), F.col("name").alias("parent_name"), F.col("parent_inode").alias("grandparent_inode"))
    return entries.join(up, [*keys, "parent_inode"], "left")


def with_child_flag(entries: DataFrame) -> DataFrame:
    """has_children of each entry."""
    keys = ["image_id", "start_offset"]
    held = entries.groupBy(*keys, F.col("parent_inode").alias("inode")).agg(F.lit(True).alias("has_children"))
    return entries.join(held, [*keys, "inode"], "left").withColumn("has_children", F.coalesce("has_children", F.lit(False)))


def walk(entries: DataFrame, root: int = 0) -> DataFrame:
    """(image_id, start_offset, inode, path, depth): `/inode/inode` of each entry below root, with its level from 1.

    A part of a path knows the entry that it is below (`up`, null where it begins at the root). Each round puts the
    parts of `up` in front of those that don't begin at the root yet, so their length doubles and rounds are as many as
    the logarithm of the depth; only what a round made is written. Entries that lie in themselves, or below what isn't
    there, never begin at the root and have no row: a round that finishes no path is the last. The joins aren't
    broadcast ones: files of paths are many times smaller than the rows in memory."""
    keys = ["image_id", "start_offset"]
    links = entries.filter("parent_inode is not null").select(*keys, "inode", F.when(F.col("parent_inode") != root, F.col("parent_inode")).alias("up"), F.concat(F.lit("/"), F.col("inode").cast("string")).alias("path"), F.lit(1).alias("depth"))
    made = stored(links, "walk")
    whole = made.filter("up is null")
    while not made.filter("up is null").isEmpty() and not made.filter("up is not null").isEmpty():
        parts = made.filter("up is not null")
        above = whole.unionByName(parts).select(*keys, F.col("inode").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"), F.col("depth").alias("before"))
        made = stored(parts.join(above.hint("merge"), [*keys, "up"]).select(*keys, "inode", F.col("next").alias("up"), F.concat("front", "path").alias("path"), (F.col("depth") + F.col("before")).alias("depth")), "walk")
        whole = whole.unionByName(made.filter("up is null"))
    return whole.select(*keys, "inode", "path", "depth")


def under(entries: DataFrame, prefix: str) -> DataFrame:
    """Entries below a path; what an export of it copies."""
    return entries.filter(F.col("path").startswith(prefix.rstrip("/") + "/"))


def locate(entries: DataFrame, inode: int, start_offset: int) -> DataFrame:
    """The entry with an inode on a volume: of several names, the first in path order."""
    return entries.filter((F.col("inode") == inode) & (F.col("start_offset") == start_offset)).orderBy("path").limit(1)


def described(volumes: DataFrame) -> DataFrame:
    """Partitions whose description isn't empty."""
    return volumes.filter("desc <> ''")
