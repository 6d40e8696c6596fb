"""Body files, and lists of names by id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import percent_decoded

COLUMNS = ["md5", "file", "inode", "mode", "uid", "gid", "size", "atime", "mtime", "ctime", "crtime"]
NUMBERS = ["uid", "gid", "size", "atime", "mtime", "ctime", "crtime"]


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(row_no, value): lines in their files' order."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("row_no"), "value")


def parse(lines: DataFrame) -> DataFrame:
    """Typed body rows of (row_no, value): 11 fields with | between them, %XX escapes in each.

    Comments (#) and blank lines are left out; a field that should be a number and isn't is null.
    """
    parts = F.split("value", r"\|", -1)
    raw = lines.filter(~F.col("value").startswith("#") & ~F.col("value").rlike(r"^\s*$")).select("row_no", *[F.try_element_at(parts, F.lit(k + 1)).alias(c) for k, c in enumerate(COLUMNS)])
    return raw.select("row_no", *[F.col(c).try_cast("long").alias(c) if c in NUMBERS else percent_decoded(F.col(c)).alias(c) for c in COLUMNS])


def read(spark: SparkSession, path: str) -> DataFrame:
    return parse(numbered_lines(spark, path))
