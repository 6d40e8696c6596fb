"""Recovery of files from raw bytes by their signatures.

Each finder takes a buffer and gives (start, end) of the files that begin in it; find() runs them in a fixed order
and keeps the ones whose structure holds. A buffer is a chunk and the bytes after it that a file may run into; a file
belongs to the chunk that holds its first byte.
"""

from __future__ import annotations

import datetime
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

Spans = Iterator[tuple[int, int]]
#: Object identifiers of the ASF format.
ASF_HEADER = bytes.fromhex("3026B2758E66CF11A6D900AA0062CE6C")
ASF_PROPERTIES = bytes.fromhex("A1DCAB8C47A9CF118EE400C00C205365")
#: The atoms by which a QuickTime file is known, and bounds of a bitmap.
ATOMS = (b"moov", b"mdat", b"free", b"wide")
BMP_BYTES, BMP_SIDE = (100, 5_000_000), 10_000
#: A batch of recovered files is full at so many bytes or rows; a batch has its price, so small images share one.
BATCH_BYTES, BATCH_ROWS = 16 << 20, 2000


def between(head: bytes, tail: bytes) -> Callable[[bytes], Spans]:
    """Files from a header to the first footer after it; the search goes on behind the footer."""

    def spans(data: bytes) -> Spans:
        start = data.find(head)
        while start >= 0:
            end = data.find(tail, start + len(head))
            if end < 0:  # no footer follows, so none of the later headers has one
                return
            yield start, end + len(tail)
            start = data.find(head, end + len(tail))

    return spans


def pdf(data: bytes) -> Spans:
    """A linearized document has its length in /L; others end at the first %%EOF."""
    for m in re.finditer(rb"%PDF-", data):
        yield from _one_pdf(data, m.start())


def _one_pdf(data: bytes, start: int) -> Spans:
    head = data[start : start + 2048]
    mark = head.find(b"/Linearized", 0, 1024)
    stated = re.compile(rb"/L\s+(\d+)").search(head, mark) if mark >= 0 else None
    if stated and valid("pdf", data[start : start + int(stated[1])]):
        yield start, min(len(data), start + int(stated[1]))
        return
    end = data.find(b"%%EOF", start)
    if end >= 0:
        yield start, end + 5


def wav(data: bytes) -> Spans:
    for m in re.finditer(rb"RIFF(.{4})WAVE", data, re.DOTALL):
        yield m.start(), min(len(data), m.start() + 8 + int.from_bytes(m[1], "little"))


def mov(data: bytes) -> Spans:
    """Runs of atoms side by side; the first is sought in steps of four bytes."""
    at = 0
    first = re.compile(b"|".join(ATOMS))
    while m := first.search(data, at):
        head = m.start() - 4
        if head < 0 or head % 4:
            at = m.start() + 1
            continue
        end = head
        while end + 8 <= len(data) and data[end + 4 : end + 8] in ATOMS:
            size = int.from_bytes(data[end : end + 4], "big")
            if size < 8:
                break
            end = min(len(data), end + size)
        if end > head:
            yield head, end
        at = max(end, m.start() + 1)


def wmv(data: bytes) -> Spans:
    for m in re.finditer(re.escape(ASF_HEADER), data):
        at = data.find(ASF_PROPERTIES, m.start(), m.start() + 512)
        if at >= 0 and at + 48 <= len(data):
            size = struct.unpack_from("<Q", data, at + 40)[0]
            if size >= 30:
                yield m.start(), min(len(data), m.start() + size)


def zips(data: bytes) -> Spans:
    """From a first member through the end record and its comment; a cut-off header ends the search."""
    at = 0
    while (start := data.find(b"PK\x03\x04", at)) >= 0:
        member = start
        while data[member : member + 4] == b"PK\x03\x04" and member + 30 <= len(data):
            packed, name, extra = struct.unpack_from("<I4xHH", data, member + 18)
            member += 30 + name + extra + packed
        end = data.find(b"PK\x05\x06", member)
        if end < 0 or end + 22 > len(data):
            at = start + 4
            continue
        stop = min(len(data), end + 22 + struct.unpack_from("<H", data, end + 20)[0])
        yield start, stop
        at = stop


def bmp(data: bytes) -> Spans:
    at = 0
    while (start := data.find(b"BM", at)) >= 0 and start + 26 <= len(data):
        size, width, height = struct.unpack_from("<I", data, start + 2)[0], *struct.unpack_from("<II", data, start + 18)
        if BMP_BYTES[0] <= size <= BMP_BYTES[1] and 0 < width <= BMP_SIDE and 0 < height <= BMP_SIDE and start + size <= len(data):
            yield start, start + size
            at = start + size
        else:
            at = start + 2


#: In the order in which types are recovered.
FINDERS: dict[str, Callable[[bytes], Spans]] = {
    "wav": wav, "mov": mov, "pdf": pdf, "jpg": between(b"\xff\xd8\xff", b"\xff\xd9"), "gif": between(b"GIF8", b"\x00\x3b"),
    "png": between(b"\x89PNG\r\n\x1a\n", b"IEND\xaeB`\x82"), "wmv": wmv, "zip": zips, "bmp": bmp,
}


def _jpeg(data: bytes) -> bool:
    """Markers from the start to the image data."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind == 0xDA or kind == 0xD9:
            return True
        if 0xD0 <= kind <= 0xD8 or kind == 0x01:
            at += 2
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return False


def _png(data: bytes) -> bool:
    """Every chunk's length and checksum, from the header to the end chunk."""
    at, seen = 8, []
    while at + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        if at + 12 + size > len(data) or zlib.crc32(data[at + 4 : at + 8 + size]) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            return False
        seen.append(kind)
        at += 12 + size
    return seen[:1] == [b"IHDR"] and seen[-1:] == [b"IEND"]


def valid(kind: str, data: bytes) -> bool:
    """Whether a recovered file has the structure of its type; types without a check always do."""
    if kind == "pdf":
        return data.startswith(b"%PDF-") and b"%%EOF" in data and (b"startxref" in data or b"trailer" in data or b" obj" in data)
    if kind == "jpg":
        return _jpeg(data)
    if kind == "png":
        return _png(data)
    if kind == "gif":
        return data[:6] in (b"GIF87a", b"GIF89a") and len(data) >= 14
    if kind == "wav":
        return data[:4] == b"RIFF" and data[8:12] == b"WAVE"
    return True


def tiff_tags(data: bytes) -> dict[int, object]:
    """Tags of the first directory of TIFF data and its EXIF directory: text and integers."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        return {}
    out: dict[int, object] = {}
    todo, done = [struct.unpack_from(order + "I", data, 4)[0]], set()
    while todo:
        at = todo.pop()
        if at in done or at + 2 > len(data):
            continue
        done.add(at)
        n = struct.unpack_from(order + "H", data, at)[0]
        for k in range(n):
            entry = at + 2 + 12 * k
            if entry + 12 > len(data):
                break
            tag, kind, count = struct.unpack_from(order + "HHI", data, entry)
            if kind == 2:
                place = entry + 8 if count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                out[tag] = data[place : place + count].split(b"\0")[0].decode("latin-1")
            elif kind == 7:
                place = entry + 8 if count <= 4 else struct.unpack_from(order + "I", data, entry + 8)[0]
                out[tag] = bytes(data[place : place + count])
            elif kind in (3, 4) and count == 1:
                out[tag] = struct.unpack_from(order + ("H" if kind == 3 else "I"), data, entry + 8)[0]
                if tag == 0x8769:
                    todo.append(out[tag])
    return out


#: Names of EXIF tags that are text or bytes.
TAG_NAMES = {0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright", 0x9000: "ExifVersion", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x927C: "MakerNote", 0x9286: "UserComment", 0xA420: "ImageUniqueID"}


def exif(data: bytes) -> dict[str, str | bytes]:
    """Named EXIF tags of a JPEG whose values are text or bytes."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return {TAG_NAMES[t]: v for t, v in tiff_tags(data[at + 10 : at + 2 + size]).items() if t in TAG_NAMES and isinstance(v, str | bytes)}
        at += 2 + size
    return {}


def original_time(kind: str, data: bytes) -> datetime.datetime | None:
    """Local time inside a file: an image's EXIF date, a document's creation date, an archive's first member's."""
    try:
        if kind in ("jpg", "jpeg"):
            tags = exif(data)
            said = tags.get("DateTimeOriginal") or tags.get("DateTime")
            return datetime.datetime.strptime(said, "%Y:%m:%d %H:%M:%S") if isinstance(said, str) else None
        if kind == "pdf":
            said = re.search(rb"/CreationDate\s*\(D:(\d{14})", data)
            return datetime.datetime.strptime(said[1].decode(), "%Y%m%d%H%M%S") if said else None
        if kind == "zip":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                return datetime.datetime(*z.infolist()[0].date_time) if z.infolist() else None
    except (ValueError, zipfile.BadZipFile, IndexError, struct.error):
        return None
    return None


def find(data: bytes, kinds: list[str] | None = None, own: int | None = None) -> Iterator[tuple[str, int, int]]:
    """(type, start, end) of valid files that begin in the first `own` bytes, type by type."""
    for kind in kinds or FINDERS:
        free = 0  # a file ends before the next of its type may begin
        for a, b in FINDERS[kind](data):
            if a >= free and (own is None or a < own) and valid(kind, data[a:b]):
                yield kind, a, b
                free = b


def carve(chunks: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """(image_id, offset, type, size, name, mtime, content) of files that begin in chunks.

    chunks(image_id, offset, len, bytes): bytes may be longer than len by the overlap into the next chunk, so a
    file that crosses a chunk's end is whole as far as the overlap goes. name is the offset in hex and the type.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            for image, base, own, chunk in zip(*(batch.column(c) for c in ("image_id", "offset", "len", "bytes")), strict=True):
                data = chunk.as_py() or b""
                for kind, a, b in find(data, kinds, own.as_py()):
                    if rows and (held + b - a > BATCH_BYTES or len(rows) >= BATCH_ROWS):
                        yield batch_of()
                        rows, held = [], 0
                    at = base.as_py() + a
                    rows.append((image.as_py(), at, kind, b - a, f"{at:x}.{kind}", original_time(kind, data[a:b]), data[a:b]))
                    held += b - a
        if rows:
            yield batch_of()

    names = ["image_id", "offset", "type", "size", "name", "mtime", "content"]
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.timestamp("us"), pa.binary()]
    return chunks.select("image_id", "offset", F.col("len").cast("long").alias("len"), "bytes").mapInArrow(run, "image_id string, offset long, type string, size long, name string, mtime timestamp_ntz, content binary")


def exif_tags(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, tag, value) of the EXIF tags of JPEG files; bytes are shown in hex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, t, v if isinstance(v, str) else v.hex()) for k, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for t, v in sorted(exif(c.as_py() or b"").items())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field(0).type), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "tag", "value"])

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, tag string, value string")


def numbered(carved: DataFrame) -> DataFrame:
    """carved with row, from 1 in each image, in the order in which files are found: by offset."""
    return carved.withColumn("row", F.row_number().over(Window.partitionBy("image_id").orderBy("offset", "type")))


def looked_up(names: DataFrame, carved: DataFrame) -> DataFrame:
    """names(image_id, name) with the size, type and time of the recovered file of that name; the first one counts."""
    first = carved.groupBy("image_id", "name").agg(F.min_by(F.struct("offset", "type", "size", "mtime"), "offset").alias("x")).select("image_id", "name", "x.*")
    return names.join(first.hint("merge"), ["image_id", "name"], "left")


def named_offset(name: Column) -> Column:
    """The offset that a recovered file's name tells; null for other names."""
    return F.conv(F.regexp_extract(name, r"^([0-9a-f]+)\.[^.]*$", 1), 16, 10).cast("long")


def reread(names: DataFrame, chunks: DataFrame) -> DataFrame:
    """names(image_id, name, size, ...) with content: the image's bytes at the offset in the name, cut out of its chunk.

    Names meet the chunks' places, without their bytes, by buckets as wide as the largest chunk; then each chunk is
    joined once with the list of what is wanted of it. The places are read twice: they are written to a table. Joins
    with stored tables aren't broadcast ones, since such files are many times smaller than their rows in memory."""
    wanted = names.withColumn("at", named_offset(F.col("name")))
    places = stored(chunks.groupBy("image_id", F.col("offset").alias("c_at")).agg(F.max(F.col("len").cast("long")).alias("c_len")), "places")
    width = places.agg(F.max("c_len")).first()[0] or 1
    placed = places.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("c_at") / width).cast("long"), F.floor((F.col("c_at") + F.greatest("c_len", F.lit(1)) - 1) / width).cast("long"))))
    met = wanted.withColumn("bucket", F.floor(F.col("at") / width).cast("long")).join(placed.hint("merge"), ["image_id", "bucket"]).filter((F.col("at") >= F.col("c_at")) & (F.col("at") < F.col("c_at") + F.col("c_len")))
    lists = met.groupBy("image_id", F.col("c_at").alias("offset")).agg(F.collect_list(F.struct("at", *[F.col(c) for c in names.columns if c != "image_id"])).alias("wanted"))
    each = chunks.select("image_id", "offset", "len", "bytes").join(lists, ["image_id", "offset"]).select("image_id", "offset", "len", "bytes", F.explode("wanted").alias("w")).filter(F.col("w.at") < F.col("offset") + F.col("len"))
    cut = F.col("bytes").substr((F.col("w.at") - F.col("offset") + 1).cast("int"), F.col("w.size").cast("int"))
    return each.select(*[F.col(c) if c == "image_id" else F.col(f"w.{c}") for c in names.columns], cut.alias("content"))


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [valid(t or "", c.as_py() or b"") for t, c in zip(batch.column(1).to_pylist(), batch.column(2), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ok, pa.bool_())], names=[*batch.schema.names[:2], "valid"])


def validity(files: DataFrame, key: str, kind: str = "type", content: str = "content") -> DataFrame:
    """(key, type, valid): whether each file has the structure of its type."""
    return files.select(key, kind, content).mapInArrow(_checked, f"`{key}` {files.schema[key].dataType.simpleString()}, `{kind}` string, valid boolean")
