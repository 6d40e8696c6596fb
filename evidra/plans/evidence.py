"""Evidence views over tables that stand in for an image: entries, volumes, body rows and intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SECTOR = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: (vol, inode, name, path, lang, size, text, content); the volume is the source."""
    vol = F.concat(F.lit("vol"), F.expr("substring(source, 4)"))
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), "lang")
    return table(spark, sf_dir, "documents").select(vol.alias("vol"), F.col("doc_id").alias("inode"), name.alias("name"), F.concat(vol, F.lit(":/"), "lang", F.lit("/"), name).alias("path"), "lang", F.octet_length("text").cast("long").alias("size"), "text", F.encode("text", "UTF-8").alias("content"))


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A volume for each source, one after the other in order of its number: (addr, start, length, size)."""
    own = table(spark, sf_dir, "documents").groupBy(F.expr("cast(substring(source, 4) as int)").alias("addr")).agg(F.sum(F.octet_length("text").cast("long")).alias("size"))
    sized = own.withColumn("length", F.ceil(F.col("size") / SECTOR).cast("long"))
    # as many rows as there are volumes
    before = F.sum("length").over(Window.orderBy("addr").rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return sized.withColumn("start", before + 2048)


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as body rows: born at the order's date; modified, changed and read by its lines' shipping dates."""
    seconds = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select(
        F.col("o_orderkey").alias("row_no"), F.lit("0").alias("md5"), F.concat(F.lit("/o/"), (F.col("o_orderkey") % 5000).cast("string")).alias("file"), F.col("o_orderkey").cast("string").alias("inode"), F.lit("r/rrw").alias("mode"),
        (F.col("o_custkey") % 7).alias("uid"), (F.col("o_custkey") % 3).alias("gid"), F.floor("o_totalprice").cast("long").alias("size"), seconds("last").alias("atime"), seconds("first").alias("mtime"), seconds("last").alias("ctime"), seconds("o_orderdate").alias("crtime"),
    )
