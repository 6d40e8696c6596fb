"""Digests of files and images, and their comparison with stored ones."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scalar import digests


def file_digests(files: DataFrame, content: str = "content") -> DataFrame:
    """files with md5, sha1 and sha256 of the content."""
    return files.withColumn("digest", digests(F.col(content))).select(*files.columns, "digest.md5", "digest.sha1", "digest.sha256")


def compare(rows: DataFrame) -> DataFrame:
    """md5_check and sha1_check (Match or Mismatch; a stored digest that is null is a Mismatch) and verified, either of them."""
    check = lambda k: F.when(F.lower(F.col(f"stored_{k}")) == F.col(k), F.lit("Match")).otherwise(F.lit("Mismatch"))
    return rows.withColumns({"md5_check": check("md5"), "sha1_check": check("sha1")}).withColumn("verified", (F.col("md5_check") == "Match") | (F.col("sha1_check") == "Match"))


def image_digests(chunks: DataFrame) -> DataFrame:
    """(image_id, md5, sha1, sha256, size) over the chunks (image_id, offset, bytes) of each image in order.

    A digest of a whole image can't be merged from parts, so an image's chunks go to one task; they are
    sorted by the shuffle and stream through, never held together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        image, made, size = None, [], 0
        names = ["image_id", "md5", "sha1", "sha256", "size"]

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (image, *(h.hexdigest() for h in made), size)], names=names)

        for batch in batches:
            for i, b in zip(batch.column("image_id").to_pylist(), batch.column("bytes"), strict=True):
                if i != image:
                    if image is not None:
                        yield row()
                    image, made, size = i, [hashlib.md5(), hashlib.sha1(), hashlib.sha256()], 0
                data = b.as_py() or b""
                for h in made:
                    h.update(data)
                size += len(data)
        if image is not None:
            yield row()

    ordered = chunks.select("image_id", "offset", "bytes").repartition("image_id").sortWithinPartitions("image_id", "offset")
    return ordered.mapInArrow(run, "image_id string, md5 string, sha1 string, sha256 string, size long")


def duplicates(rows: DataFrame, key: str, digest: str = "sha256") -> DataFrame:
    """(digest, n, first) of digests that more than one row has."""
    return rows.groupBy(digest).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")


def known(rows: DataFrame, hashes: DataFrame, digest: str = "md5", flagged: bool = True) -> DataFrame:
    """Rows whose digest is (or isn't) in a set of known hashes."""
    return rows.join(hashes.select(digest).distinct(), digest, "left_semi" if flagged else "left_anti")


def observed(rows: DataFrame, size: str = "size", name: str = "progress") -> tuple[DataFrame, Observation]:
    """rows as they are, and what tells, once they have been read, how many rows and bytes went through.

    In a stream the same numbers come with each progress report under the name."""
    seen = Observation(name)
    return rows.observe(seen, F.count("*").alias("rows"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")), seen
