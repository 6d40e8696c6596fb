"""Expert Witness (EWF version 1) segments: media bytes and stored digests, without a native library."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

SIGNATURE = b"EVF\x09\x0d\x0a\xff\x00"


def sections(data: bytes) -> Iterator[tuple[str, int, int]]:
    """(kind, begin, end of the body) of a segment's sections."""
    if data[:8] != SIGNATURE:
        raise ValueError("no EWF segment")
    at = 13
    while at + 76 <= len(data):
        kind = data[at : at + 16].split(b"\0")[0].decode("latin-1")
        onward, size = struct.unpack_from("<QQ", data, at + 16)
        yield kind, at + 76, min(len(data), at + size) if size else len(data)
        if kind in ("done", "next") or onward <= at:
            return
        at = onward


class Image:
    """The media that segments, in order, hold."""

    def __init__(self, segments: list[bytes]):
        self.segments, self.places = segments, []
        self.chunk = self.size = 0
        self.md5 = self.sha1 = None
        for k, data in enumerate(segments):
            end_of_chunks = len(data)
            for kind, a, b in sections(data):
                if kind in ("volume", "disk"):
                    per_chunk, sector, count = struct.unpack_from("<IIQ", data, a + 8)
                    self.chunk, self.size = per_chunk * sector, sector * count
                elif kind == "sectors":
                    end_of_chunks = b
                elif kind == "table":
                    n, base = struct.unpack_from("<I4xQ", data, a)
                    offsets = struct.unpack_from(f"<{n}I", data, a + 24)
                    begin = [base + (o & 0x7FFFFFFF) for o in offsets]
                    self.places += [(k, x, y, bool(o >> 31)) for x, y, o in zip(begin, [*begin[1:], end_of_chunks], offsets, strict=True)]
                elif kind in ("hash", "digest"):
                    self.md5 = data[a : a + 16].hex()
                    if kind == "digest":
                        self.sha1 = data[a + 16 : a + 36].hex()

    def read(self, offset: int, size: int) -> bytes:
        """Media bytes; only the chunks that hold them are inflated."""
        size = max(0, min(size, self.size - offset))
        out = []
        for c in range(offset // self.chunk, -(-(offset + size) // self.chunk)) if size else ():
            k, a, b, packed = self.places[c]
            out.append(zlib.decompress(self.segments[k][a:b]) if packed else self.segments[k][a : a + min(self.chunk, self.size - c * self.chunk)])
        skip = offset % self.chunk if size else 0
        return b"".join(out)[skip : skip + size]


def media(images: DataFrame, chunk_bytes: int = 16 << 20) -> DataFrame:
    """(image_id, chunk_no, offset, len, bytes, stored_md5, stored_sha1, problem) of images (image_id, segments array<binary>).

    An image that can't be read to its end gives the chunks before, and a row with `problem` and no bytes."""

    types = {"chunk_no": pa.int64(), "offset": pa.int64(), "len": pa.int64(), "bytes": pa.binary(), "stored_md5": pa.string(), "stored_sha1": pa.string(), "problem": pa.string()}

    def chunks(segments: list[bytes] | None) -> Iterator[dict]:
        try:
            image = Image(segments or [])
            if not image.chunk:
                raise ValueError("no EWF volume")
            for k, at in enumerate(range(0, image.size, chunk_bytes)):
                data = image.read(at, chunk_bytes)
                yield {"chunk_no": k, "offset": at, "len": len(data), "bytes": data, "stored_md5": image.md5, "stored_sha1": image.sha1}
        except (ValueError, TypeError, IndexError, struct.error, zlib.error) as e:
            yield {"problem": str(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, segments in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for row in chunks(segments.as_py()):
                    yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()), *(pa.array([row.get(c)], t) for c, t in types.items())], names=["image_id", *types])

    return images.select("image_id", "segments").mapInArrow(run, "image_id string, chunk_no long, offset long, len long, bytes binary, stored_md5 string, stored_sha1 string, problem string")
