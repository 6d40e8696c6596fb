"""Small valid files of every type that recovery knows."""

from __future__ import annotations

import io
import struct
import zipfile
import zlib

from ..operators.carve import ASF_HEADER, ASF_PROPERTIES


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def _tiff() -> bytes:
    """One directory: maker, model and time."""
    said = [(0x010F, b"Maker\0"), (0x0110, b"Model 7\0"), (0x0132, b"2021:03:04 05:06:07\0")]
    at = 8 + 2 + 12 * len(said) + 4
    entries, values = b"", b""
    for tag, text in said:
        entries += struct.pack("<HHII", tag, 2, len(text), at + len(values))
        values += text
    return b"II*\0" + struct.pack("<IH", 8, len(said)) + entries + bytes(4) + values


def _zip() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(zipfile.ZipInfo("a.txt", (2020, 1, 2, 3, 4, 6)), b"member")
    return out.getvalue()


def files() -> dict[str, bytes]:
    """(type: content), the ones whose place counts first."""
    exif = b"Exif\0\0" + _tiff()
    return {
        "mov": struct.pack(">I4s", 16, b"moov") + bytes(8) + struct.pack(">I4s", 12, b"mdat") + b"film",
        "wav": b"RIFF" + struct.pack("<I", 12) + b"WAVE" + b"datadata",
        "pdf": b"%PDF-1.4\n1 0 obj<</CreationDate (D:20190203040506Z)>>endobj\ntrailer<<>>\n%%EOF",
        "jpg": b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xda\x00\x02image\xff\xd9",
        "gif": b"GIF89a" + struct.pack("<HH", 1, 1) + b"\x00\x00\x00picture\x00;",
        "png": b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"\0\0")) + _chunk(b"IEND", b""),
        "wmv": ASF_HEADER + bytes(14) + ASF_PROPERTIES + bytes(24) + struct.pack("<Q", 94) + bytes(16),
        "zip": _zip(),
        "bmp": b"BM" + struct.pack("<IHHI", 120, 0, 0, 54) + struct.pack("<III", 40, 2, 2) + bytes(94),
    }
