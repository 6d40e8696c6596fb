"""Media columns: ISO base media files written, walked and read without decoding what they hold.

write() wraps bytes as 8-bit mono sound ('raw ' sample entry), 192 samples to a frame; walk() and Movie read
any file of nested boxes: sample tables give each frame's place, so codec, duration and the byte ranges of
keyframes come from the tables alone, and payload() copies the frames as they are stored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, stored, texts_of, tidied

FRAME = 192
RATE = 8000
#: Frames of a chunk; the first frame of each chunk is its keyframe.
CHUNK_FRAMES = 64
#: Bytes of texts or files that are worked on at once; a longer one is alone.
SLICE_BYTES = 8 << 20
#: Boxes that hold boxes, with the bytes before the first of them.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"dinf": 0, b"stbl": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"dref": 8, b"stsd": 8}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(data: bytes) -> bytes:
    """data and spaces up to a positive multiple of the frame size."""
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data))


def write(payload: bytes) -> bytes:
    """An ISO media file whose one track holds payload, a positive multiple of FRAME bytes."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError("the payload must be whole frames")
    duration = n * FRAME
    wide = duration >= 1 << 32
    chunks, last = divmod(n, CHUNK_FRAMES)
    firsts = [(1, CHUNK_FRAMES, 1)] * bool(chunks) + [(chunks + 1, last, 1)] * bool(last)
    chunks += bool(last)
    time = ">QQ" if wide else ">II"
    span = ">Q" if wide else ">I"
    version = int(wide)
    entry = box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, RATE << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")

    def moov(base: int) -> bytes:
        offsets = base + np.arange(chunks, dtype=np.int64) * (CHUNK_FRAMES * FRAME)
        places = full(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()) if base + len(payload) >= 1 << 32 else full(b"stco", struct.pack(">I", chunks), offsets.astype(">u4").tobytes())
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, FRAME)),
            full(b"stss", struct.pack(">I", chunks), (1 + np.arange(chunks) * CHUNK_FRAMES).astype(">u4").tobytes()),
            full(b"stsc", struct.pack(">I", len(firsts)), *(struct.pack(">III", *x) for x in firsts)),
            full(b"stsz", struct.pack(">II", FRAME, n)),
            places,
        )
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", struct.pack(time, 0, 0), struct.pack(">I", RATE), struct.pack(span, duration), struct.pack(">HH", 0x55C4, 0), version=version), full(b"hdlr", bytes(4), b"soun", bytes(12), b"sound\0"), minf)
        tkhd = full(b"tkhd", struct.pack(time, 0, 0), struct.pack(">I4x", 1), struct.pack(span, duration), struct.pack(">8xHHHxx", 0, 0, 0x100), MATRIX, bytes(8), version=version, flags=7)
        mvhd = full(b"mvhd", struct.pack(time, 0, 0), struct.pack(">I", RATE), struct.pack(span, duration), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2), version=version)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 16 if len(payload) + 8 >= 1 << 32 else 8
    base = len(ftyp) + len(moov(0)) + head
    table = moov(base)
    if len(ftyp) + len(table) + head != base:  # the offsets got wider
        table = moov(len(ftyp) + len(table) + head)
    return ftyp + table + box(b"mdat", payload)


def walk(data: bytes, start: int = 0, stop: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box kinds, begin, end of the body) of every box, parents first. Sizes are checked against the parent."""
    stop = len(data) if stop is None else stop
    at = start
    while at < stop:
        if stop - at < 8:
            raise ValueError(f"{stop - at} bytes at {at} are no box")
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if stop - at < 16:
                raise ValueError(f"box {kind!r} at {at} is cut off")
            size, body = struct.unpack_from(">Q", data, body)[0], body + 8
        end = stop if size == 0 else at + size
        if end < body or end > stop:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        yield (*path, kind), body, end
        if kind in CONTAINERS:
            yield from walk(data, min(end, body + CONTAINERS[kind]), end, (*path, kind))
        at = end


class Movie:
    """One track of a file, the first by default: codec, timescale, duration, and its frames' sizes, places and keyframes.

    A file whose frames are in fragments is refused with a ValueError: its sample tables don't tell them."""

    def __init__(self, data: bytes, track: int = 0):
        self.data = data
        found: dict[bytes, tuple[int, int]] = {}
        at = -1
        for path, a, b in walk(data):
            if path == (b"moof",):
                raise ValueError("the file is fragmented")
            at += path == (b"moov", b"trak")
            if at == track and path[:2] == (b"moov", b"trak") and found.get(path[-1]) is None:
                found[path[-1]] = (a, b)
                if path[-2:-1] == (b"stsd",) and b"entry" not in found:
                    found[b"entry"] = (a, b)
                    self.codec = path[-1].decode("latin-1")
        need = {b"mdhd", b"entry", b"stts", b"stsc", b"stsz"} - found.keys()
        if need or not found.keys() & {b"stco", b"co64"}:
            raise ValueError(f"the track lacks {sorted(need) or 'chunk offsets'}")

        def table(kind: bytes, columns: int, dtype: str = ">u4") -> np.ndarray:
            a, b = found[kind]
            n = struct.unpack_from(">I", data, a + 4)[0]
            if a + 8 + n * columns * int(dtype[2:]) > b:
                raise ValueError(f"table {kind!r} is cut off")
            return np.frombuffer(data, dtype, n * columns, a + 8).astype(np.int64).reshape(n, columns)

        a, _ = found[b"mdhd"]
        self.timescale, self.duration = struct.unpack_from(">20xIQ" if data[a] else ">12xII", data, a)
        uniform, n = struct.unpack_from(">II", data, found[b"stsz"][0] + 4)
        self.sizes = np.full(n, uniform, np.int64) if uniform else np.frombuffer(data, ">u4", n, found[b"stsz"][0] + 12).astype(np.int64)
        chunks = (table(b"stco", 1) if b"stco" in found else table(b"co64", 1, ">u8"))[:, 0]
        runs = table(b"stsc", 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunks) + 1)))
        if per_chunk.sum() != n or table(b"stts", 2)[:, 0].sum() != n:
            raise ValueError("the sample tables don't agree on the number of frames")
        upto = np.cumsum(self.sizes) - self.sizes
        head = np.cumsum(per_chunk) - per_chunk
        self.places = upto + np.repeat(chunks - upto[head], per_chunk)
        if n and (self.places + self.sizes).max() > len(data):
            raise ValueError("a frame lies beyond the end of the file")
        self.keys = table(b"stss", 1)[:, 0] - 1 if b"stss" in found else np.arange(n)

    def payload(self) -> bytes:
        """The stored bytes of all frames; frames side by side are copied at once."""
        if not len(self.places):
            return b""
        gap = np.flatnonzero(self.places[1:] != self.places[:-1] + self.sizes[:-1]) + 1
        a = self.places[np.concatenate([[0], gap])]
        b = (self.places + self.sizes)[np.concatenate([gap - 1, [len(self.places) - 1]])]
        return b"".join(self.data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True))

    def keyframes(self) -> list[tuple[int, int]]:
        """(offset, length) of each keyframe in the file."""
        return list(zip(self.places[self.keys].tolist(), self.sizes[self.keys].tolist(), strict=True))


def movies(data: bytes) -> list[Movie]:
    """All tracks of a file."""
    return [Movie(data, k) for k in range(sum(path == (b"moov", b"trak") for path, _, _ in walk(data)))]


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column of every whole text, as a stored table: doc_id, n_bytes, media. Null counts as empty."""
    texts = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in slices(batch.column("text"), SLICE_BYTES):
                part = [t or b"" for t in batch.column("text").slice(i, j - i).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([len(t) for t in part], pa.int64()), pa.array([write(padded(t)) for t in part], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return stored(texts.mapInArrow(tidied(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary"), "media")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_s double, keyframes array<struct<offset:long,length:long>>"


def features(media: DataFrame) -> DataFrame:
    """What the boxes and sample tables of a stored media column say, and digests of the bytes read back.

    The payload is read back without its padding for n_bytes of text as given and with it for the
    payload columns. feature is codec, timescale, duration, frames and keyframes, joined by colons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch.column("media")
            for i, j in slices(files, SLICE_BYTES):
                rows = []
                for f in files.slice(i, j - i):
                    data = f.as_py()
                    m = Movie(data)
                    p, keys = m.payload(), m.keyframes()
                    rows.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{m.codec.strip()}:{m.timescale}:{m.duration}:{len(m.sizes)}:{len(keys)}", m.codec, m.duration / m.timescale if m.timescale else 0.0, [{"offset": a, "length": b} for a, b in keys]))
                own = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), batch.column("n_bytes").slice(i, j - i), *own], names=["doc_id", "n_bytes", *names])

    names = [x.split(" ")[0] for x in FEATURES.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))]
    return media.mapInArrow(tidied(run), f"doc_id {media.schema['doc_id'].dataType.simpleString()}, n_bytes long, {FEATURES}")
