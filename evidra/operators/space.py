"""Space of volumes, allocated regions, and what no file covers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECTOR = 512
#: Bytes of an image read at once when recovering files.
CHUNK = 100 * 1024 * 1024


def space_allocation(volumes: DataFrame, totals: DataFrame) -> DataFrame:
    """Size and share of each partition of an image, and a row for what is left if it is more than nothing.

    volumes(image_id, addr, length in sectors, fs_type), totals(image_id, total_size). An image without
    partitions has one row that is all of it.
    """
    parts = volumes.join(totals, "image_id").select("image_id", F.col("addr").cast("long").alias("addr"), "fs_type", (F.col("length") * SECTOR).alias("size"), "total_size")
    used = volumes.groupBy("image_id").agg((F.sum("length") * SECTOR).alias("used"))
    rest = totals.join(used, "image_id", "left").select("image_id", F.lit(None).cast("long").alias("addr"), F.when(F.col("used").isNull(), F.lit("Entire Disk")).otherwise(F.lit("Unallocated Space")).alias("fs_type"), (F.col("total_size") - F.coalesce("used", F.lit(0))).alias("size"), "total_size").filter("size > 0")
    return parts.unionByName(rest).select("image_id", "addr", "fs_type", "size", (F.col("size") / F.col("total_size") * 100).alias("percentage"))


def allocated_intervals(entries: DataFrame, block_size: Column) -> DataFrame:
    """(image_id, start, end) in bytes of allocated entries with a size, half open.

    A file's place is estimated from its inode number, as where no data runs are known; give data runs to
    the operators below instead where there are some.
    """
    start = F.col("start_offset") * SECTOR + F.col("inode") * block_size
    return entries.filter("is_allocated and size > 0").select("image_id", start.alias("start"), (start + F.col("size")).alias("end"))


def islands(intervals: DataFrame, *keys: str, start: str = "start", end: str = "end", width: int = CHUNK) -> DataFrame:
    """The union of intervals as intervals apart from one another, by key.

    Intervals are ordered within the buckets of `width` in which they start, so a key's intervals spread over many
    tasks. What reaches into a bucket from earlier ones, and which island goes on there, comes from one row for each
    bucket."""
    groups = [*keys, "bucket"]
    placed = intervals.select(*keys, F.col(start).alias("lo"), F.col(end).alias("hi"), F.floor(F.col(start) / width).cast("long").alias("bucket"))
    earlier = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    into = placed.groupBy(*groups).agg(F.max("hi").alias("top")).select(*groups, F.max("top").over(earlier).alias("into"))
    order = Window.partitionBy(*groups).orderBy("lo", "hi")
    reach = F.greatest(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), "into")
    marked = placed.join(into, groups).withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach), 1).otherwise(0))
    counted = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    begun = counted.groupBy(*groups).agg(F.max("n").alias("n"))
    going = begun.select(*groups, F.max(F.when(F.col("n") > 0, F.struct("bucket", "n"))).over(earlier).alias("going"))
    island = F.when(F.col("n") > 0, F.struct("bucket", "n")).otherwise(F.col("going"))
    return counted.join(going, groups).groupBy(*keys, island.alias("island")).agg(F.min("lo").alias(start), F.max("hi").alias(end)).drop("island")


def free_chunks(chunks: DataFrame, intervals: DataFrame, width: int = CHUNK) -> DataFrame:
    """Chunks (image_id, offset, len) that no interval (image_id, start, end) overlaps.

    Both sides are keyed by the buckets of `width` bytes that they touch, so the overlap test is a residual
    of an equi-join. Intervals are cut at the buckets' edges and merged within each bucket first, so a chunk meets
    the islands of its buckets only, however many files lie there.
    """
    bucket = lambda a, b: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor((b - 1) / width).cast("long")))
    cut = intervals.filter(F.col("end") > F.col("start")).withColumn("bucket", bucket(F.col("start"), F.col("end")))
    low, high = F.greatest("start", F.col("bucket") * width), F.least("end", (F.col("bucket") + 1) * width)
    order = Window.partitionBy("image_id", "bucket").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = cut.select("image_id", "bucket", low.alias("start"), high.alias("end")).withColumn("new", F.when(reach.isNull() | (F.col("start") > reach), 1).otherwise(0))
    merged = marked.withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("image_id", "bucket", "n").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    probes = chunks.filter("len > 0").select("image_id", "offset", "len").withColumn("bucket", bucket(F.col("offset"), F.col("offset") + F.col("len")))
    hit = probes.alias("p").join(merged.alias("c"), (F.col("p.image_id") == F.col("c.image_id")) & (F.col("p.bucket") == F.col("c.bucket")) & (F.col("p.offset") < F.col("c.end")) & (F.col("p.offset") + F.col("p.len") > F.col("c.start")), "left_semi")
    return chunks.join(hit.select("image_id", "offset", "len"), ["image_id", "offset", "len"], "left_anti")


def read_range(chunks: DataFrame, start: int, length: int) -> DataFrame:
    """(image_id, offset, bytes) pieces of a byte range, in order of offset; each is cut out of its chunk.

    A range of sectors s..e is start=512*s, length=512*(e-s+1)."""
    stop = start + length
    own = chunks.filter((F.col("offset") < stop) & (F.col("offset") + F.col("len") > start))
    first = F.greatest(F.lit(0), F.lit(start) - F.col("offset"))
    last = F.least(F.col("len").cast("long"), F.lit(stop) - F.col("offset"))
    return own.select("image_id", (F.col("offset") + first).alias("offset"), F.expr("bytes").substr((first + 1).cast("int"), (last - first).cast("int")).alias("bytes"))


def read_ranges(chunks: DataFrame, ranges: DataFrame, keys: list[str], width: int = 16 << 20) -> DataFrame:
    """(image_id, *keys, at, bytes): what chunks hold of each range (image_id, *keys, at, length), a row for each chunk.

    Ranges meet the chunks' places by buckets of `width` bytes, without their bytes; then each chunk is joined with
    the list of what is wanted of it, and cut in one pass. Parts beyond an image have no rows. A chunk's overlap
    with the next one isn't read. The list of a chunk is as long as ranges that meet it, so ask for no range twice;
    a part is as long as the chunk allows, whatever `width` is."""
    spread = lambda a, n: F.explode(F.sequence(F.floor(a / width).cast("long"), F.floor((a + n - 1) / width).cast("long")))
    places = chunks.filter("len > 0").select("image_id", F.col("offset").alias("c_at"), F.col("len").cast("long").alias("c_len"))
    places = places.withColumn("bucket", spread(F.col("c_at"), F.col("c_len")))
    asked = ranges.filter("length > 0").select("image_id", F.struct(*keys).alias("key"), F.col("at").cast("long").alias("at"), F.col("length").cast("long").alias("length"))
    asked = asked.withColumn("bucket", spread(F.col("at"), F.col("length")))
    low, high = F.greatest("at", "c_at"), F.least(F.col("at") + F.col("length"), F.col("c_at") + F.col("c_len"))
    met = asked.join(places, ["image_id", "bucket"]).withColumns({"low": low, "high": high})
    # several buckets may bring the same two together: the one where their common part begins counts
    met = met.filter((F.col("low") < F.col("high")) & (F.floor(F.col("low") / width) == F.col("bucket")))
    lists = met.groupBy("image_id", F.col("c_at").alias("offset")).agg(F.collect_list(F.struct("key", F.col("low").alias("at"), (F.col("high") - F.col("low")).alias("length"))).alias("wanted"))
    both = chunks.filter("len > 0").select("image_id", "offset", "bytes").join(lists, ["image_id", "offset"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        images, held_keys, places, cuts, held = [], [], [], [], 0

        def batch_of() -> pa.RecordBatch:
            own = [pa.concat_arrays([k.field(c) for k in held_keys]) for c in keys]
            return pa.RecordBatch.from_arrays([pa.array(images, pa.string()), *own, pa.array(places, pa.int64()), pa.array(cuts, pa.binary())], names=["image_id", *keys, "at", "bytes"])

        for batch in batches:
            for k in range(batch.num_rows):
                image, offset = batch.column("image_id")[k].as_py(), batch.column("offset")[k].as_py()
                data, wanted = batch.column("bytes")[k].as_buffer(), batch.column("wanted")[k].values
                key, at, size = wanted.field("key"), wanted.field("at").to_pylist(), wanted.field("length").to_pylist()
                for j in range(len(at)):
                    if cuts and (held + size[j] > width or len(cuts) >= 2000):
                        yield batch_of()
                        images, held_keys, places, cuts, held = [], [], [], [], 0
                    images.append(image)
                    held_keys.append(key.slice(j, 1))
                    places.append(at[j])
                    cuts.append(data[at[j] - offset : at[j] - offset + size[j]].to_pybytes())
                    held += size[j]
        if cuts:
            yield batch_of()

    types = ranges.schema
    return both.mapInArrow(run, ", ".join(["image_id string", *(f"`{c}` {types[c].dataType.simpleString()}" for c in keys), "at long", "bytes binary"]))


def whole_ranges(pieces: DataFrame, keys: list[str]) -> DataFrame:
    """Pieces of ranges put together again in order of their places: one row for each of the keys."""
    parts = F.array_sort(F.collect_list(F.struct("at", "bytes")))
    return pieces.groupBy(*keys).agg(F.aggregate(parts, F.lit(b""), lambda a, p: F.concat(a, p["bytes"])).alias("bytes"))


def volume_stats(volumes: DataFrame) -> DataFrame:
    """Size, first and last block, and sector geometry from (start, length, block_size, block_count)."""
    return volumes.withColumns({"end": F.col("start") + F.col("length") - 1, "size": F.col("length") * SECTOR, "volume_size": F.col("block_count") * F.col("block_size"), "first_block": F.lit(0).cast("long"), "last_block": F.col("block_count") - 1})


def image_summary(images: DataFrame, volumes: DataFrame) -> DataFrame:
    """Size, sectors, partitions and status of each image(image_id, size, has_fs)."""
    n = volumes.groupBy("image_id").agg(F.count("*").alias("partitions"))
    status = F.when(F.col("partitions") > 0, F.lit("partitioned")).when(F.col("has_fs"), F.lit("single_fs")).otherwise(F.lit("wiped"))
    return images.join(n, "image_id", "left").withColumn("partitions", F.coalesce("partitions", F.lit(0))).select("image_id", "size", F.floor(F.col("size") / SECTOR).cast("long").alias("sectors"), "partitions", status.alias("status"))


def progress(done: Column, total: Column) -> Column:
    """Percentage done, 100 at most; null without a total."""
    return F.when(total > 0, F.least(F.lit(100.0), done / total * 100))


def partition_details(volumes: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """What is known of each partition, a row each: place, size, blocks, kind, flags, and on NTFS the Windows version.

    volumes(image_id, addr, desc, start, length, fs_type, block_size, block_count, is_alloc, label); versions
    (image_id, addr, summary) of software hives. Missing values are `N/A`."""
    own = volume_stats(volumes)
    if versions is not None:
        own = own.join(versions.select("image_id", "addr", F.col("summary").alias("os_version")), ["image_id", "addr"], "left")
    else:
        own = own.withColumn("os_version", F.lit(None).cast("string"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("N/A"))
    version = F.when(F.upper("fs_type") == "NTFS", shown("os_version")).otherwise(F.lit("N/A"))
    return own.select("image_id", "addr", shown("desc").alias("desc"), "start", "end", "length", "size", shown("fs_type").alias("fs_type"), shown("block_size").alias("block_size"), shown("block_count").alias("block_count"), F.when(F.col("is_alloc"), F.lit("Allocated")).otherwise(F.lit("Unallocated")).alias("status"), shown("label").alias("label"), version.alias("os_version"))


def with_evidence(listed: DataFrame, more: DataFrame) -> DataFrame:
    """The list of images with more of them, each path once."""
    return listed.unionByName(more).distinct()


def without_evidence(listed: DataFrame, gone: DataFrame) -> DataFrame:
    """The list of images without some, by path."""
    return listed.join(gone.select("path").distinct(), "path", "left_anti")
