"""NTFS volumes over chunk tables: directory entries, deleted ones too, and contents in pieces.

Nothing needs an image or a volume in one row. Boot sectors, the file table and contents are byte ranges that
space.read_ranges() cuts out of an image's chunks; the file table's records are parsed where its pieces lie, and the
records that continue others are brought to them by one shuffle.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.space import SECTOR, read_ranges, whole_ranges
from ..session import checkpointed

#: The root directory's record, and attribute types.
ROOT = 5
STANDARD, LIST, NAME, DATA, END = 0x10, 0x20, 0x30, 0x80, 0xFFFFFFFF
#: Bytes of the file table that are parsed as one row, and of a file's content in one piece.
TABLE_PIECE, PIECE = 1 << 20, 4 << 20
#: Contents up to this many bytes may be one row.
WHOLE = 256 << 20
#: Doublings of known path lengths: 2**ROUNDS levels.
ROUNDS = 9
KEYS = ["image_id", "start_offset"]
STAMPS = ["created", "modified", "changed", "accessed"]
REF = (1 << 48) - 1


def geometry(boot: bytes) -> tuple[int, int, int] | None:
    """(bytes of a cluster, of a record, place of the file table in the volume) by a boot sector."""
    if len(boot) < SECTOR or boot[3:11] != b"NTFS    ":
        return None
    sector, per = struct.unpack_from("<HB", boot, 11)
    cluster = sector * (per if per <= 0x80 else 1 << 256 - per)
    size = struct.unpack_from("<b", boot, 64)[0]
    record = size * cluster if size > 0 else 1 << -size
    if not cluster or record < SECTOR or record > TABLE_PIECE or record & record - 1:
        return None
    return cluster, record, struct.unpack_from("<Q", boot, 48)[0] * cluster


def mended(raw: bytes) -> bytes | None:
    """A record with the last two bytes of each sector put back; None if a sector is from another write."""
    at, n = struct.unpack_from("<HH", raw, 4)
    if not n or at + 2 * n > len(raw) or (n - 1) * SECTOR > len(raw):
        return None
    out = bytearray(raw)
    for k in range(1, n):
        end = k * SECTOR
        if out[end - 2 : end] != raw[at : at + 2]:
            return None
        out[end - 2 : end] = raw[at + 2 * k : at + 2 * k + 2]
    return bytes(out)


def runs(data: bytes, vcn: int = 0) -> Iterator[tuple[int, int, int]]:
    """(first cluster in the file, on the volume or -1 where none is stored, clusters) of a run list."""
    at = lcn = 0
    while at < len(data) and data[at]:
        a, b = data[at] & 15, data[at] >> 4
        n = int.from_bytes(data[at + 1 : at + 1 + a], "little")
        lcn += int.from_bytes(data[at + 1 + a : at + 1 + a + b], "little", signed=True)
        if not n or lcn < 0:
            raise ValueError("a broken run list")
        yield vcn, lcn if b else -1, n
        vcn, at = vcn + n, at + 1 + a + b


def _time(value: int) -> datetime | None:
    try:
        return datetime(1601, 1, 1) + timedelta(microseconds=value // 10) if value else None
    except OverflowError:
        return None


def record(raw: bytes) -> dict | None:
    """What a record of the file table says; None for one never used. `problem` says what couldn't be read.

    Of the data streams the unnamed one counts."""
    if raw[:4] == bytes(4):
        return None
    out = {"seq": 0, "base": 0, "base_seq": 0, "in_use": False, "is_directory": False, "names": [], "runs": [], "times": [None] * 4, "size": None, "valid": None, "kept": None, "coded": False, "listed": False, "problem": None}
    body = mended(raw) if raw[:4] == b"FILE" else None
    if body is None:
        return out | {"problem": "a torn record"}
    out["seq"], at, flags = struct.unpack_from("<H2xHH", body, 16)
    out["in_use"], out["is_directory"] = bool(flags & 1), bool(flags & 2)
    base = struct.unpack_from("<Q", body, 32)[0]
    out["base"], out["base_seq"] = base & REF, base >> 48
    try:
        while at + 4 <= len(body):
            kind = struct.unpack_from("<I", body, at)[0]
            if kind == END:
                break
            size, away, name_size = struct.unpack_from("<IBB", body, at + 4)
            if size < 24 or at + size > len(body):
                raise ValueError("an attribute beyond its record")
            own = body[at : at + size]
            coding = struct.unpack_from("<H", own, 12)[0]
            if away:
                first, place = struct.unpack_from("<Q8xH", own, 16)
                if kind == DATA and not name_size:
                    out["runs"] += runs(own[place:], first)
                    out["coded"] |= bool(coding & 0x40FF)
                    if not first:
                        out["size"], out["valid"] = struct.unpack_from("<QQ", own, 48)
            else:
                n, place = struct.unpack_from("<IH", own, 16)
                value = own[place : place + n]
                if kind == DATA and not name_size:
                    out["size"], out["valid"], out["kept"] = n, n, value
                elif kind == STANDARD:
                    out["times"] = [_time(t) for t in struct.unpack_from("<4Q", value)]
                elif kind == NAME:
                    up, letters, space = struct.unpack_from("<Q", value)[0], value[64], value[65]
                    out["names"].append({"parent": up & REF, "parent_seq": up >> 48, "space": space, "name": value[66 : 66 + 2 * letters].decode("utf-16-le", "replace")})
            out["listed"] |= kind == LIST
            at += size
    except (ValueError, struct.error, IndexError) as e:
        out["problem"] = str(e)
    return out


_RUN = pa.list_(pa.struct([("vcn", pa.int64()), ("lcn", pa.int64()), ("n", pa.int64())]))
_NAMES = pa.list_(pa.struct([("parent", pa.int64()), ("parent_seq", pa.int64()), ("space", pa.int32()), ("name", pa.string())]))
_PLACES = "array<struct<vcn:bigint,lcn:bigint,n:bigint>>"


def tables(chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """(image_id, start_offset, cluster, record, runs, size, problem) of the file table of each volume (image_id, start in sectors).

    problem is null, or why the table can't be read, or that parts of it weren't found. A file table that goes on in other
    records is followed from those that are known, a round each time that it grows."""
    places = volumes.select("image_id", F.col("start").cast("long").alias("start_offset")).distinct()
    boots = whole_ranges(read_ranges(chunks, places.select(*KEYS, (F.col("start_offset") * SECTOR).alias("at"), F.lit(SECTOR).cast("long").alias("length")), ["start_offset"]), KEYS)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [geometry(b or b"") or (None, None, None) for b in batch.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("start_offset"), *(pa.array([f[k] for f in found], pa.int64()) for k in range(3))], names=[*KEYS, "cluster", "record", "table"])

    known = boots.select(*KEYS, "bytes").mapInArrow(first, "image_id string, start_offset long, cluster long, record long, table long")
    zero = whole_ranges(read_ranges(chunks, known.filter("table is not null").select(*KEYS, (F.col("start_offset") * SECTOR + F.col("table")).alias("at"), F.col("record").alias("length")), ["start_offset"]), KEYS)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [record(b) or {"runs": [], "size": 0, "listed": False, "problem": "no file table"} for b in batch.column("bytes").to_pylist()]
            places = [[{"vcn": a, "lcn": b, "n": c} for a, b, c in r["runs"]] for r in said]
            problem = [r["problem"] or (None if r["runs"] else "no file table") for r in said]
            plain = [pa.array([r.get(c) for r in said], t) for c, t in (("size", pa.int64()), ("seq", pa.int64()), ("listed", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("image_id"), batch.column("start_offset"), pa.array(places, _RUN), *plain, pa.array(problem, pa.string())], names=[*KEYS, "runs", "size", "seq", "listed", "problem"])

    read = zero.select(*KEYS, "bytes").mapInArrow(opened, f"image_id string, start_offset long, runs {_PLACES}, size long, seq long, listed boolean, problem string")
    missing = F.when(F.col("cluster").isNull(), F.lit("no NTFS boot sector")).when(F.col("runs").isNull(), F.lit("the file table lies outside the image")).otherwise(F.col("problem"))
    found = checkpointed(places.join(known, KEYS, "left").join(read, KEYS, "left").select(*KEYS, "cluster", "record", "runs", "size", "seq", "listed", missing.alias("problem")))
    grown = found.filter("listed and problem is null")
    while not grown.isEmpty():
        more = _parsed(chunks, grown).join(found.select(*KEYS, F.col("seq").alias("own_seq")), KEYS).filter("base = 0 and inode > 0 and in_use and base_seq = own_seq and size(runs) > 0")
        more = more.groupBy(*KEYS).agg(F.flatten(F.collect_list("runs")).alias("more"))
        after = found.join(more, KEYS, "left").withColumn("all", F.array_sort(F.array_union("runs", F.coalesce("more", "runs"))))
        after = checkpointed(after.select(*KEYS, "cluster", "record", F.coalesce("all", "runs").alias("runs"), "size", "seq", (F.size("all") > F.size("runs")).alias("listed"), "problem"))
        found, grown = after, after.filter("listed and problem is null")
    held = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["n"]) * F.col("cluster")
    return found.select(*KEYS, "cluster", "record", "runs", "size", F.when(F.col("problem").isNull() & (held < F.col("size")), F.lit("parts of the file table weren't found")).otherwise(F.col("problem")).alias("problem"))


def _ranges(rows: DataFrame, width: int, end: str) -> DataFrame:
    """(..., pos, at, length): rows' runs cut into ranges of at most `width` bytes, as far as the column `end`; gaps have none."""
    flat = rows.withColumn("run", F.explode("runs")).filter("run.lcn >= 0")
    pos, size = F.col("run.vcn") * F.col("cluster"), F.col("run.n") * F.col("cluster")
    flat = flat.withColumns({"_pos": pos, "_size": F.least(size, F.col(end) - pos), "_at": F.col("start_offset") * SECTOR + F.col("run.lcn") * F.col("cluster")}).filter("_size > 0")
    cut = flat.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1, F.lit(width).cast("long"))))
    return cut.withColumns({"pos": F.col("_pos") + F.col("_k"), "at": F.col("_at") + F.col("_k"), "length": F.least(F.lit(width).cast("long"), F.col("_size") - F.col("_k"))}).drop("run", "_pos", "_size", "_at", "_k")


def _parsed(chunks: DataFrame, said: DataFrame) -> DataFrame:
    """The records of file tables (image_id, start_offset, cluster, record, runs, size), each as it stands."""
    wanted = _ranges(said, TABLE_PIECE, "size").select(*KEYS, "cluster", "record", "pos", "at", "length")
    pieces = whole_ranges(read_ranges(chunks, wanted, ["start_offset", "cluster", "record", "pos"]), [*KEYS, "cluster", "record", "pos"])
    plain = {"inode": pa.int64(), "seq": pa.int64(), "base": pa.int64(), "base_seq": pa.int64(), "in_use": pa.bool_(), "is_directory": pa.bool_(), "names": _NAMES, "runs": _RUN, "size": pa.int64(), "valid": pa.int64(), "kept": pa.binary(), "coded": pa.bool_(), "problem": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image, start, cluster, size, pos, data in zip(*(batch.column(c) for c in (*KEYS, "cluster", "record", "pos", "bytes")), strict=True):
                size, pos, data = size.as_py(), pos.as_py(), data.as_py()
                rows = []
                for k in range(0, len(data) - size + 1, size):
                    r = record(data[k : k + size])
                    if r is not None:
                        inode = (pos + k) // size
                        if not r["base"] and not r["base_seq"]:
                            r |= {"base": inode, "base_seq": r["seq"]}
                        rows.append(r | {"inode": inode, "runs": [{"vcn": a, "lcn": b, "n": c} for a, b, c in r["runs"]]})
                held = [pa.array([image.as_py()] * len(rows), pa.string()), *(pa.array([x.as_py()] * len(rows), pa.int64()) for x in (start, cluster))]
                held += [pa.array([r[c] for r in rows], t) for c, t in plain.items()] + [pa.array([r["times"][k] for r in rows], pa.timestamp("us")) for k in range(4)]
                yield pa.RecordBatch.from_arrays(held, names=[*KEYS, "cluster", *plain, *STAMPS])

    schema = f"image_id string, start_offset long, cluster long, inode long, seq long, base long, base_seq long, in_use boolean, is_directory boolean, names array<struct<parent:bigint,parent_seq:bigint,space:int,name:string>>, runs {_PLACES}, size long, valid long, kept binary, coded boolean, problem string, " + ", ".join(f"{s} timestamp_ntz" for s in STAMPS)
    return pieces.mapInArrow(run, schema)


def records(chunks: DataFrame, volumes: DataFrame) -> DataFrame:
    """A row for each file of each NTFS volume: inode, seq, in_use, is_directory, names, times, size, valid (bytes that
    were ever written), kept (content held in the record), runs, coded (compressed or encrypted), cluster, problem.

    volumes(image_id, start) are places of NTFS volumes in sectors; other volumes give no rows (tables() says why).
    Records that continue a file are joined to it by its number and sequence; those of files that are gone are left
    out. The result is read more than once by what follows: write it to a table first where the images are large."""
    parsed = _parsed(chunks, tables(chunks, volumes).filter("runs is not null"))
    own = F.first(F.when(F.col("inode") == F.col("base"), F.struct("seq", "in_use", "is_directory", *STAMPS, F.col("problem").alias("own_problem"))), ignorenulls=True)
    part = F.collect_list(F.struct("base_seq", "names", "runs", "size", "valid", "kept", "coded", "problem"))
    files = parsed.groupBy(*KEYS, "cluster", F.col("base").alias("inode")).agg(own.alias("o"), part.alias("parts")).filter("o is not null")
    files = files.withColumn("parts", F.filter("parts", lambda p: p["base_seq"] == F.col("o.seq")))
    most = lambda c: F.array_max(F.transform("parts", lambda p: p[c])).alias(c)
    return files.select(*KEYS, "cluster", "inode", "o.seq", "o.in_use", "o.is_directory", *[f"o.{c}" for c in STAMPS], F.flatten("parts.names").alias("names"), F.array_sort(F.flatten("parts.runs")).alias("runs"), most("size"), most("valid"), most("kept"), F.exists("parts", lambda p: p["coded"]).alias("coded"), F.coalesce("o.own_problem", most("problem")).alias("problem"))


def _paths(folders: DataFrame) -> DataFrame:
    """(image_id, start_offset, inode, path) of directories (image_id, start_offset, inode, up, path).

    up is the directory that path is below, null where path is whole. Each round puts the path of `up` in front and
    takes over its `up`, so what is known doubles, and is cut off its lineage by a checkpoint."""
    folders = folders.withColumn("own", F.col("path"))
    for _ in range(ROUNDS):
        folders = checkpointed(folders)
        if folders.filter("up is not null").isEmpty():
            break
        above = folders.select(*KEYS, F.col("inode").alias("up"), F.col("up").alias("next"), F.col("path").alias("front"))
        folders = folders.join(above, [*KEYS, "up"], "left").select(*KEYS, "inode", F.col("next").alias("up"), F.concat(F.coalesce("front", F.lit("")), "path").alias("path"), "own")
    return folders.select(*KEYS, "inode", F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat(F.lit("/$OrphanFiles"), "own")).alias("path"))


def entries(files: DataFrame) -> DataFrame:
    """Directory entries of records(): a row for each name of a file but the short twin of a long one.

    Names whose directory is gone, or was used again since, are below /$OrphanFiles; so are directories that lie in
    themselves or more than 2**ROUNDS deep. The root has no entry; an inode without a name has none."""
    long = lambda n: n["space"] != 2
    shown = F.when(F.exists("names", long), F.filter("names", long)).otherwise(F.col("names"))
    named = files.withColumn("n", F.explode(shown)).filter(F.col("inode") != ROOT)
    named = named.select(*KEYS, "inode", F.col("n.parent").alias("parent_inode"), F.col("n.parent_seq").alias("parent_seq"), F.col("n.name").alias("name"), "seq", "in_use", "is_directory", "size", "modified", "created", "accessed", "changed")
    held = files.filter(F.col("is_directory") & (F.col("inode") != ROOT)).select(*KEYS, F.col("inode").alias("parent_inode"), F.col("seq").alias("up_seq"), F.col("in_use").alias("up_used"))
    placed = named.join(held, [*KEYS, "parent_inode"], "left")
    # a deleted directory's number has gone up by one since its entries were written
    valid = (F.col("parent_seq") == F.col("up_seq")) | (~F.col("up_used") & (F.col("parent_seq") + 1 == F.col("up_seq")))
    front = F.when(F.col("parent_inode") == ROOT, F.lit("/")).when(F.coalesce(valid, F.lit(False)), F.lit(None)).otherwise(F.lit("/$OrphanFiles/"))
    placed = placed.withColumn("front", front)
    # up is null where the path is whole; a directory has one name, the least of several
    folders = placed.filter("is_directory").groupBy(*KEYS, "inode").agg(F.min(F.struct("parent_inode", "name", "front")).alias("m"))
    folders = folders.select(*KEYS, "inode", F.when(F.col("m.front").isNull(), F.col("m.parent_inode")).alias("up"), F.concat(F.coalesce("m.front", F.lit("/")), "m.name").alias("path"))
    above = _paths(folders).select(*KEYS, F.col("inode").alias("parent_inode"), F.col("path").alias("above"))
    path = F.concat(F.coalesce("front", F.concat("above", F.lit("/"))), "name")
    return placed.join(above, [*KEYS, "parent_inode"], "left").select(*KEYS, "inode", "parent_inode", "name", path.alias("path"), "is_directory", F.col("in_use").alias("is_allocated"), F.when(F.col("is_directory"), F.lit(0)).otherwise(F.coalesce("size", F.lit(0))).cast("long").alias("size"), "modified", "created", "accessed", "changed")


def pieces(chunks: DataFrame, files: DataFrame) -> DataFrame:
    """(image_id, start_offset, inode, pos, bytes): contents in pieces of at most PIECE bytes.

    Bytes that no piece holds are zeros: gaps, and what was never written. Compressed and encrypted files have no
    pieces (`coded`)."""
    plain = files.filter(~F.col("coded") & ~F.col("is_directory"))
    away = _ranges(plain.filter("kept is null").select(*KEYS, "inode", "cluster", "runs", F.least("size", "valid").alias("_end")), PIECE, "_end")
    got = read_ranges(chunks, away.withColumn("_from", F.col("at")).select(*KEYS, "inode", "pos", "_from", "at", "length"), ["start_offset", "inode", "pos", "_from"])
    held = plain.filter("kept is not null").select(*KEYS, "inode", F.lit(0).cast("long").alias("pos"), F.col("kept").alias("bytes"))
    return got.select(*KEYS, "inode", (F.col("pos") + F.col("at") - F.col("_from")).alias("pos"), "bytes").unionByName(held)


def contents(chunks: DataFrame, files: DataFrame, most: int = WHOLE) -> DataFrame:
    """(image_id, start_offset, inode, size, content) of files; content is null for compressed and encrypted files, for
    those of more than `most` bytes, which pieces() has, and where the image ends before the file does."""
    small = files.filter(~F.col("is_directory") & F.col("size").isNotNull())
    fit = small.filter((F.col("size") <= most) & ~F.col("coded"))
    parts = pieces(chunks, fit).groupBy(*KEYS, "inode").agg(F.array_sort(F.collect_list(F.struct("pos", "bytes"))).alias("parts"))
    wanted = F.aggregate(F.filter("runs", lambda r: r["lcn"] >= 0), F.lit(0).cast("long"), lambda a, r: a + F.greatest(F.lit(0).cast("long"), F.least(r["n"] * F.col("cluster"), F.least("size", "valid") - r["vcn"] * F.col("cluster"))))
    joined = fit.join(parts, [*KEYS, "inode"], "left").withColumn("wanted", F.when(F.col("kept").isNotNull(), F.col("size")).otherwise(wanted))
    joined = joined.select(*KEYS, "inode", "size", "wanted", "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                size, wanted, parts = (row.column(c)[0] for c in ("size", "wanted", "parts"))
                data, got = bytearray(size.as_py()), 0
                for p in parts.values or () if parts.is_valid else ():
                    b, at = p["bytes"].as_py(), p["pos"].as_py()
                    data[at : at + len(b)] = b
                    got += len(b)
                whole = bytes(data) if got == wanted.as_py() else None
                yield pa.RecordBatch.from_arrays([row.column(c) for c in (*KEYS, "inode", "size")] + [pa.array([whole], pa.binary())], names=[*KEYS, "inode", "size", "content"])

    schema = "image_id string, start_offset long, inode long, size long, content binary"
    rest = small.filter((F.col("size") > most) | F.col("coded")).select(*KEYS, "inode", "size", F.lit(None).cast("binary").alias("content"))
    return joined.mapInArrow(run, schema).unionByName(rest)
