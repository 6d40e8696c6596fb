"""WARC archives in Zstandard: the dictionary in a leading skippable frame, then one frame for each record.

An archive is a row of a stored table; its bytes are a .warc.zst file. The reader loads the dictionary from
the skippable frame, decodes frame by frame and checks versions, headers, lengths and digests.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, small_batches, split_marked, stored, tidied, with_rows

#: Fixed value: the magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 16 << 10
#: Bytes of records that the dictionary is trained on, and the fewest records worth one.
SAMPLE_BYTES, SAMPLE_RECORDS = 1 << 20, 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: str, url: str, payload: bytes, payload_bytes: int, payload_digest: str, refers_to: str | None) -> bytes:
    """One WARC record; a revisit has no block, and its payload fields are those of the full payload."""
    uri = "".join(c if 32 < ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url)
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:evidra:page:{page_id}>", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Payload-Length: {payload_bytes}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:evidra:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A .warc.zst file; small sets of records get an empty dictionary frame."""
    samples, size = [], 0
    step = max(1, len(records) * 2 * 4096 // SAMPLE_BYTES)
    for r in records[::step]:
        samples.append(r[:8192])
        size += len(samples[-1])
        if size >= SAMPLE_BYTES:
            break
    raw = b""
    if len(samples) >= SAMPLE_RECORDS:
        try:
            raw = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, level=3).as_bytes()
        except zstandard.ZstdError:  # too little that repeats
            raw = b""
    made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw) if raw else None, write_checksum=True)
    return struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(made.compress(r) for r in records)


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded records of a .warc.zst file."""
    if len(data) < 8:
        raise ValueError("the archive is cut off")
    magic, size = struct.unpack_from("<II", data)
    if magic != DICTIONARY_MAGIC or 8 + size > len(data):
        raise ValueError("the archive doesn't begin with its dictionary")
    raw = data[8 : 8 + size]
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # a dictionary may itself be a frame
        raw = zstandard.ZstdDecompressor().decompress(raw)
    made = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw) if raw else None)
    at = 8 + size
    view = memoryview(data)
    while at < len(data):
        one = made.decompressobj()
        out = one.decompress(view[at : at + 65536])
        at += 65536
        while not one.eof and at < len(data):
            out += one.decompress(view[at : at + 65536])
            at += 65536
        if not one.eof:
            raise ValueError("the last frame is cut off")
        at = min(at, len(data)) - len(one.unused_data)
        yield out


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers in lower case, block) of a record, or ValueError."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(b"WARC/1."):
        raise ValueError("no WARC header")
    headers = {}
    for line in data[:end].decode("utf-8").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name:
            raise ValueError(f"bad header line {line[:80]!r}")
        headers[name.strip().lower()] = value.strip()
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in headers:
            raise ValueError(f"{need} is missing")
    length = int(headers["content-length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("Content-Length doesn't fit the record")
    if headers["warc-type"] == "response" and "warc-payload-digest" in headers and headers["warc-payload-digest"] != f"sha1:{digest(block)}":
        raise ValueError("the payload doesn't have its digest")
    return headers, block


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_dedupe_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of all pages, as a stored table (n_records, id_type, file).

    Of records with equal payloads of at least min_dedupe_bytes, the one with the largest id is a response
    and the others revisit it; smaller payloads are all responses. Null payloads are empty; a null url is
    an empty one; rows with the same id and payload: every row with the largest id is a response. A row
    whose id is null revisits the largest id of its payload if there is one, else it is a response.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    small_batches(pages.sparkSession)
    page = with_rows(pages.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")).cast("binary").alias("payload")), "rid")
    page = page.withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long"))
    names = ["id", "url", "payload", "size", "sha", "refers"]
    # Digests and ids alone are grouped and joined; payloads stay where they are read.
    light = stored(page.select("rid", "id", "url", "sha", "size"), "page-digests")
    owner = light.filter(F.col("size") >= min_dedupe_bytes).groupBy("sha", "size").agg(F.max("id").alias("first"), F.count("*").alias("n")).filter("n > 1").select("sha", "size", "first")
    again = stored(light.join(owner, ["sha", "size"]).filter(F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))).select("rid", "id", "url", F.lit(b"").alias("payload"), "size", "sha", F.col("first").cast("string").alias("refers")), "revisits")
    marks = Marks(again)
    maybe, whole = split_marked(page, marks)
    # rows that are marked and no revisits after all: few, as long as the marks aren't full
    spared = stored(split_marked(light.select("rid"), marks)[0].join(again.select("rid"), "rid", "left_anti"), "spared")
    back = split_marked(maybe, Marks(spared))[0].join(spared, "rid", "left_semi")
    responses = whole.unionByName(back).withColumn("refers", F.lit(None).cast("string"))
    marked = responses.select(*names).unionByName(again.select(*names)).withColumn("id", F.col("id").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in names), strict=True):
                i, url, payload, n, sha, refers = (x.as_py() for x in row)
                held.append(record("response" if refers is None else "revisit", "" if i is None else i, url, payload, n, base64.b32encode(sha).decode(), refers))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([kind]), pa.array([archive(held)], pa.binary())], names=["n_records", "id_type", "file"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([kind]), pa.array([archive(held)], pa.binary())], names=["n_records", "id_type", "file"])

    return stored(marked.mapInArrow(tidied(run), "n_records long, id_type string, file binary"), "warc", "uncompressed")


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of the archives, ids of the type that the pages had: page_id, payload_bytes, payload_digest, record_type, refers_to, url, html (null in revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = lambda uri: uri.removeprefix("<urn:evidra:page:").removesuffix(">") or None
        for batch in batches:
            for file, n in zip(batch.column("file"), batch.column("n_records").to_pylist(), strict=True):
                rows: list[tuple] = []
                seen = 0
                for data in frames(file.as_py()):
                    h, block = parse(data)
                    response = h["warc-type"] == "response"
                    if response and int(h["warc-payload-length"]) != len(block):
                        raise ValueError("the payload's length is not the stated one")
                    rows.append((own(h["warc-record-id"]), int(h["warc-payload-length"]), h["warc-payload-digest"].removeprefix("sha1:"), h["warc-type"], own(h["warc-refers-to"]) if "warc-refers-to" in h else None, h["warc-target-uri"], block.decode("utf-8") if response else None))
                    seen += 1
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows = []
                if seen != n:
                    raise ValueError(f"the archive has {seen} records and should have {n}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "html"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    read = archives.mapInArrow(tidied(run), "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, html string")
    first = archives.select("id_type").first()
    id_type = first[0] if first else "long"
    return read.withColumns({"page_id": F.col("page_id").cast(id_type), "refers_to": F.col("refers_to").cast(id_type)})
