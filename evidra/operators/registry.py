"""Registry keys and values as tables: metadata, listings, and facts drawn from known values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where a Windows volume keeps its version, relative to the software hive.
VERSION_KEY = "Microsoft\\Windows NT\\CurrentVersion"
VERSION_VALUES = ["ProductName", "CurrentVersion", "CurrentBuild", "RegisteredOwner", "CSDVersion", "ProductId"]


def key_metadata(keys: DataFrame, values: DataFrame) -> DataFrame:
    """keys(path, parent, name, ts) with the numbers of subkeys and values and the time as text."""
    subkeys = keys.filter("parent is not null").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_subkeys"))
    held = values.groupBy("path").agg(F.count("*").alias("n_values"))
    return keys.join(subkeys, "path", "left").join(held, "path", "left").withColumns({"n_subkeys": F.coalesce("n_subkeys", F.lit(0)), "n_values": F.coalesce("n_values", F.lit(0)), "modified": F.date_format("ts", "yyyy-MM-dd HH:mm:ss")})


def split_tree(tree: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys, values) of a hive's tree; problems() has the rows of hives that couldn't be read to their end."""
    tree = tree.filter("path is not null")
    return tree.filter("value_name is null").select("hive", "path", "parent", "name", "ts"), tree.filter("value_name is not null").select("hive", "path", F.col("value_name").alias("name"), F.col("value_type").alias("type"), "value")


def problems(tree: DataFrame) -> DataFrame:
    """(hive, problem) of a tree's hives that couldn't be read to their end."""
    return tree.filter("path is null and value_type = 'problem'").select("hive", F.col("value").alias("problem"))


def listing(keys: DataFrame, values: DataFrame) -> DataFrame:
    """(path, depth, kind, name) of the tree view: keys and, below the root, their values; order by path."""
    of_keys = keys.select("path", F.lit("key").alias("kind"), "name", F.col("parent").isNull().alias("root"))
    of_values = values.join(keys.filter("parent is not null").select("path"), "path", "left_semi").select(F.concat("path", F.lit("\\"), "name").alias("path"), F.lit("value").alias("kind"), "name", F.lit(False).alias("root"))
    both = of_keys.unionByName(of_values)
    return both.select("path", (F.size(F.split("path", r"\\")) - 1).alias("depth"), "kind", "name")


def value_table(values: DataFrame, path: str) -> DataFrame:
    """Name, type and value of one key's values."""
    return values.filter(F.col("path") == path).select("name", "type", F.col("value").cast("string").alias("value"))


def facts(values: DataFrame, key: str, names: list[str], path: Column) -> DataFrame:
    """One row for each `key` with a column for each named value under a path, N/A where it is missing."""
    picked = [F.coalesce(F.max(F.when(path & (F.col("name") == n), F.col("value"))), F.lit("N/A")).alias(n) for n in names]
    return values.groupBy(key).agg(*picked)


def windows_version(values: DataFrame, key: str = "hive") -> DataFrame:
    """The Windows version in each software hive, and a text of it."""
    found = facts(values, key, VERSION_VALUES, F.col("path").endswith(VERSION_KEY))
    line = lambda pattern, *columns: F.format_string(pattern, *columns)
    text = F.concat_ws("\n", line("%s Version %s", "ProductName", "CurrentVersion"), line("Build %s %s", "CurrentBuild", "CSDVersion"), line("Owner: %s", "RegisteredOwner"), line("Product ID: %s", "ProductId"))
    return found.withColumn("summary", text)


#: Where a Windows volume keeps its hives.
HIVES = {name: f"/Windows/System32/config/{name}" for name in ("SOFTWARE", "SYSTEM", "SAM", "SECURITY", "DEFAULT", "COMPONENTS")}


def hive_files(entries: DataFrame, volumes: DataFrame, path: str) -> DataFrame:
    """The entries that are the hive at a path, on NTFS volumes only; letters count alike in either case.

    entries(image_id, start_offset, path, ...), volumes(image_id, start, fs_type)."""
    ntfs = volumes.filter("upper(fs_type) = 'NTFS'").select("image_id", F.col("start").alias("start_offset"))
    return entries.filter(F.lower("path") == path.lower()).join(ntfs, ["image_id", "start_offset"], "left_semi")
