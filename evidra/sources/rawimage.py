"""Raw disk images as chunk tables, and the volume tables in them (MBR with extended partitions, and GPT)."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.space import read_ranges, whole_ranges
from ..session import checkpointed

SECTOR = 512
SCHEMA = "image_id string, chunk_no long, offset long, len long, bytes binary"
#: Partition types of an MBR and of a GPT that have names here.
MBR_TYPES = {0x01: "FAT12 (0x01)", 0x04: "FAT16 (0x04)", 0x06: "FAT16 (0x06)", 0x07: "NTFS / exFAT (0x07)", 0x0B: "Win95 FAT32 (0x0b)", 0x0C: "Win95 FAT32 (0x0c)", 0x0E: "Win95 FAT16 (0x0e)", 0x82: "Linux Swap (0x82)", 0x83: "Linux (0x83)", 0xEE: "GPT Safety Partition (0xee)", 0xAF: "HFS (0xaf)"}
GPT_TYPES = {"c12a7328-f81f-11d2-ba4b-00a0c93ec93b": "EFI system partition", "e3c9e316-0b5c-4db8-817d-f92df00215ae": "Microsoft reserved partition", "ebd0a0a2-b9e5-4433-87c0-68b6b72699c7": "Basic data partition", "0fc63daf-8483-4772-8e79-3d69d8477de4": "Linux filesystem"}
EXTENDED = (0x05, 0x0F, 0x85)


class _Chunk(InputPartition):
    def __init__(self, path: str, number: int, offset: int, length: int, read: int):
        self.path, self.number, self.offset, self.length, self.read = path, number, offset, length, read


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.chunk = int(options.get("chunkbytes", 100 << 20))
        self.overlap = int(options.get("overlapbytes", 0))

    def partitions(self) -> list[_Chunk]:
        import os

        from ..operators.carve import FINDERS  # noqa: F401  the carvers go with the chunks

        out = []
        for path in self.paths:
            size = os.path.getsize(path)
            out += [_Chunk(path, k, at, min(self.chunk, size - at), min(self.chunk + self.overlap, size - at)) for k, at in enumerate(range(0, size, self.chunk))]
        return out

    def read(self, part: _Chunk) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            f.seek(part.offset)
            data = f.read(part.read)
        yield pa.RecordBatch.from_arrays([pa.array([part.path]), pa.array([part.number]), pa.array([part.offset]), pa.array([part.length]), pa.array([data], pa.binary())], names=["image_id", "chunk_no", "offset", "len", "bytes"])


class RawImage(DataSource):
    """`rawimage`: a partition of the scan for each chunk of images on storage that every machine mounts.

    Options: path or paths (comma-joined), chunkBytes, overlapBytes. For images in a store that only Spark reads,
    and that fit a row, chunks_of_files() makes the same table.
    """

    @classmethod
    def name(cls) -> str:
        return "rawimage"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read(spark: SparkSession, path: str, chunk_bytes: int = 100 << 20, overlap_bytes: int = 0) -> DataFrame:
    spark.dataSource.register(RawImage)
    return spark.read.format("rawimage").option("path", path).option("chunkBytes", str(chunk_bytes)).option("overlapBytes", str(overlap_bytes)).load()


def chunks_of_files(files: DataFrame, chunk_bytes: int, overlap_bytes: int = 0, image: str = "path", content: str = "content") -> DataFrame:
    """Chunks of images that spark.read.format("binaryFile") has read."""
    size = F.octet_length(content).cast("long")
    numbered = files.filter(size > 0).select(F.col(image).alias("image_id"), F.col(content).alias("content"), size.alias("size"), F.posexplode(F.sequence(F.lit(0).cast("long"), size - 1, F.lit(chunk_bytes).cast("long"))).alias("chunk_no", "offset"))
    cut = F.col("content").substr((F.col("offset") + 1).cast("int"), F.lit(chunk_bytes + overlap_bytes))
    return numbered.select("image_id", F.col("chunk_no").cast("long").alias("chunk_no"), "offset", F.least(F.lit(chunk_bytes).cast("long"), F.col("size") - F.col("offset")).alias("len"), cut.alias("bytes"))


def volume_table(head: bytes, sectors: int, extended=None) -> list[tuple[int, str, int, int, bool]]:
    """(addr, desc, start, length, is_alloc) of an image's first bytes, tables and gaps included.

    extended(sector) reads a further sector, for logical partitions; without it they aren't listed.
    """
    if len(head) < SECTOR or head[510:512] != b"\x55\xaa":
        return []
    slots: list[tuple[int, int, str, bool]] = []
    entries = [struct.unpack_from("<B3xB3xII", head, 446 + 16 * k) for k in range(4)]
    if any(kind == 0xEE for _, kind, _, _ in entries) and head[SECTOR : SECTOR + 8] == b"EFI PART":
        slots += [(0, 1, "Safety Table", False), (1, 1, "GPT Header", False)]
        table, count, width = struct.unpack_from("<QII", head, SECTOR + 72)
        slots.append((table, -(-count * width // SECTOR), "Partition Table", False))
        for k in range(count):
            at = table * SECTOR + k * width
            if at + 128 > len(head):
                break
            if any(head[at : at + 16]):
                first, last = struct.unpack_from("<QQ", head, at + 32)
                name = head[at + 56 : at + 128].decode("utf-16-le", "replace").split("\0")[0]
                slots.append((first, last - first + 1, name or GPT_TYPES.get(str(uuid.UUID(bytes_le=head[at : at + 16])), "Unknown"), True))
    else:
        slots.append((0, 1, "Primary Table (#0)", False))
        for _, kind, start, length in entries:
            if kind in EXTENDED:
                slots += _logical(start, extended) if extended else []
            elif kind and length:
                slots.append((start, length, MBR_TYPES.get(kind, f"Unknown Type (0x{kind:02x})"), True))
        if len(slots) == 1:
            return []
    out, at = [], 0
    for start, length, desc, alloc in sorted(slots, key=lambda s: (s[0], s[3], s[1])):
        if start > at:
            out.append(("Unallocated", at, start - at, False))
        out.append((desc, start, length, alloc))
        at = max(at, start + length)
    if sectors > at:
        out.append(("Unallocated", at, sectors - at, False))
    return [(k, *row) for k, row in enumerate(out)]


def _logical(base: int, read) -> list[tuple[int, int, str, bool]]:
    out, at, seen = [], base, set()
    while at not in seen:
        seen.add(at)
        table = read(at)
        if len(table) < SECTOR or table[510:512] != b"\x55\xaa":
            break
        (_, kind, start, length), (_, more, onward, _) = (struct.unpack_from("<B3xB3xII", table, 446 + 16 * k) for k in range(2))
        if kind and length:
            out.append((at + start, length, MBR_TYPES.get(kind, f"Unknown Type (0x{kind:02x})"), True))
        if more not in EXTENDED:
            break
        at = base + onward
    return out


def filesystem(boot: bytes) -> tuple[str, int] | None:
    """(type code, block size) by a volume's first sectors, or None."""
    if boot[3:11] == b"NTFS    ":
        return "ntfs", int.from_bytes(boot[11:13], "little") * boot[13]
    if boot[3:11] == b"EXFAT   ":
        return "exfat", 1 << (boot[108] + boot[109])
    if boot[510:512] == b"\x55\xaa" and int.from_bytes(boot[11:13], "little") in (512, 1024, 2048, 4096) and boot[13]:
        from .fat import Geometry

        return Geometry(boot).kind, int.from_bytes(boot[11:13], "little") * boot[13]
    if boot[1080:1082] == b"\x53\xef":
        flags = int.from_bytes(boot[1116:1120], "little"), int.from_bytes(boot[1120:1124], "little")
        return "ext4" if flags[1] & 0x40 else "ext3" if flags[0] & 4 else "ext2", 1024 << int.from_bytes(boot[1048:1052], "little")
    if boot[1024:1026] in (b"H+", b"HX"):
        return "hfs", int.from_bytes(boot[1064:1068], "big")
    if boot[32:36] == b"NXSB":
        return "apfs", int.from_bytes(boot[36:40], "little")
    if len(boot) > 32774 and boot[32769:32774] == b"CD001":
        return "iso9660", 2048
    return None


def volumes(images: DataFrame, image: str = "path", content: str = "content") -> DataFrame:
    """(image_id, addr, desc, start, length, is_alloc, fs_type, block_size) of images read as binary files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["image_id", "addr", "desc", "start", "length", "is_alloc", "fs_type", "block_size"]
        types = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int32()]
        for batch in batches:
            rows = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = data.as_py() or b""
                for addr, desc, start, length, alloc in volume_table(data[: 64 << 10], len(data) // SECTOR, lambda s, d=data: d[s * SECTOR : (s + 1) * SECTOR]):
                    fs = filesystem(data[start * SECTOR : start * SECTOR + 33000]) if alloc else None
                    rows.append((name, addr, desc, start, length, alloc, fs[0] if fs else None, fs[1] if fs else None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return images.select(image, content).mapInArrow(run, "image_id string, addr int, desc string, start long, length long, is_alloc boolean, fs_type string, block_size int").filter("desc <> ''")


#: Bytes at an image's beginning that its volume table lies in, and at a volume's that tell its filesystem.
HEAD, PROBE = 64 << 10, 33000


def volumes_of_chunks(chunks: DataFrame) -> DataFrame:
    """(image_id, addr, desc, start, length, is_alloc, fs_type, block_size) of images as chunk tables, of any size.

    An image's head and the first sectors of its volumes are read as ranges. Tables of logical partitions are read one
    round each, since each says where the next one is. Images without a volume table have no rows.
    """
    ends = chunks.groupBy("image_id").agg(F.max(F.col("offset") + F.col("len")).alias("size"))
    heads = whole_ranges(read_ranges(chunks, ends.select("image_id", F.lit(0).cast("long").alias("at"), F.lit(HEAD).cast("long").alias("length")), []), ["image_id"])
    state = ends.join(heads.withColumnRenamed("bytes", "head"), "image_id").withColumn("more", F.expr("cast(array() as array<struct<sector:bigint,bytes:binary>>)"))
    layout = pa.list_(pa.struct([("addr", pa.int32()), ("desc", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("is_alloc", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, wants = [], []
            for head, size, more in zip(*(batch.column(c).to_pylist() for c in ("head", "size", "more")), strict=True):
                known, missing = {m["sector"]: m["bytes"] or b"" for m in more}, []

                def sector(s: int, head: bytes = head, known: dict = known, missing: list = missing) -> bytes:
                    if (s + 1) * SECTOR <= len(head):
                        return head[s * SECTOR : (s + 1) * SECTOR]
                    if s not in known:
                        missing.append(s)
                    return known.get(s, b"")

                rows.append([dict(zip(("addr", "desc", "start", "length", "is_alloc"), r, strict=True)) for r in volume_table(head, size // SECTOR, sector)])
                wants.append(missing[0] if missing else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("image_id", "size", "head", "more")), pa.array(rows, layout), pa.array(wants, pa.int64())], names=["image_id", "size", "head", "more", "rows", "want"])

    while True:
        found = checkpointed(state.select("image_id", "size", "head", "more").mapInArrow(run, "image_id string, size long, head binary, more array<struct<sector:bigint,bytes:binary>>, rows array<struct<addr:int,desc:string,start:bigint,length:bigint,is_alloc:boolean>>, want long"))
        asked = found.filter("want is not null").select("image_id", "want", (F.col("want") * SECTOR).alias("at"), F.lit(SECTOR).cast("long").alias("length"))
        if asked.isEmpty():
            break
        read = whole_ranges(read_ranges(chunks, asked, ["want"]), ["image_id", "want"]).select("image_id", F.col("bytes").alias("read"))
        state = found.join(read, "image_id", "left").withColumn("more", F.when(F.col("want").isNull(), F.col("more")).otherwise(F.concat("more", F.array(F.struct(F.col("want").alias("sector"), F.col("read").alias("bytes"))))))
    listed = found.select("image_id", F.explode("rows").alias("r")).select("image_id", "r.*").filter("desc <> ''")
    probes = listed.filter("is_alloc").select("image_id", "addr", (F.col("start") * SECTOR).alias("at"), F.lit(PROBE).cast("long").alias("length"))
    boots = whole_ranges(read_ranges(chunks, probes, ["addr"]), ["image_id", "addr"])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [filesystem(b) or (None, None) for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("addr"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.int32())], names=["image_id", "addr", "fs_type", "block_size"])

    return listed.join(boots.select("image_id", "addr", "bytes").mapInArrow(kinds, "image_id string, addr int, fs_type string, block_size int"), ["image_id", "addr"], "left")
