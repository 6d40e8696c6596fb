"""Files out of tables: recovered or exported contents, reports, and timelines."""

from __future__ import annotations

import hashlib
import io
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import LINE
from ..operators.paging import PAGE_LINES, shown_lines

#: A batch of pages is full at so many characters.
PAGE_BATCH = 8 << 20


def write_contents(files: DataFrame, folder: str, name: str = "name", content: str = "content", mtime: str | None = None) -> DataFrame:
    """Write each content under a folder that every machine mounts; (name, path, size, sha256) of what was written.

    A file is written whole under a name of its task's own and then renamed, so a task that runs again leaves
    the same files. Names are kept below the folder. The result must be consumed for the files to be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            times = batch.column(2).to_pylist() if mtime else [None] * batch.num_rows
            for n, c, t in zip(batch.column(0).to_pylist(), batch.column(1), times, strict=True):
                data = c.as_py() or b""
                path = os.path.join(folder, os.path.normpath("/" + n).lstrip("/"))
                os.makedirs(os.path.dirname(path), exist_ok=True)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(data)
                if t is not None:
                    os.utime(part, (t.timestamp(), t.timestamp()))
                os.replace(part, path)
                rows.append((n, path, len(data), hashlib.sha256(data).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.string()))], names=["name", "path", "size", "sha256"])

    columns = [name, content, *([mtime] if mtime else [])]
    return files.select(*columns).mapInArrow(run, "name string, path string, size long, sha256 string")


def write_lines(rows: DataFrame, path: str, line: str, *order: str, header: str | None = None) -> None:
    """A text file set, in the order of columns across its parts; a header goes to a part of its own in front."""
    out = rows.orderBy(*order).select(line) if order else rows.select(line)
    if header is not None:
        first = rows.sparkSession.createDataFrame([(header,)], f"`{line}` string")
        first.coalesce(1).write.mode("overwrite").text(path)
        out.write.mode("append").text(path)
    else:
        out.write.mode("overwrite").text(path)


def hash_report(rows: DataFrame) -> DataFrame:
    """(path, report): the text of a hash report."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("N/A"))) for label, c in (("Path", "path"), ("Size", "size"), ("MD5", "md5"), ("SHA-1", "sha1"), ("SHA-256", "sha256"), ("Stored MD5", "stored_md5"), ("Stored SHA-1", "stored_sha1"), ("MD5 check", "md5_check"), ("SHA-1 check", "sha1_check"))]
    return rows.select("path", F.concat_ws("\n", *lines).alias("report"))


@F.pandas_udf(T.BinaryType())
def zipped(name: pd.Series, content: pd.Series) -> pd.Series:
    """Each content as a ZIP archive of one member."""

    def one(n: str, c: bytes) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(n), c or b"")
        return out.getvalue()

    return pd.Series([one(n, c) for n, c in zip(name, content, strict=True)])


def converted_name(path: Column, kind: str) -> Column:
    """Name of a raw copy: the stem and dd or raw."""
    return F.concat(F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", ""), F.lit(f".{kind}"))


def raw_copy(chunks: DataFrame, folder: str, kind: str = "dd") -> DataFrame:
    """Write images(image_id, offset, len, bytes) as raw files under a folder that every machine mounts: (image_id,
    path, offset, size) of what each task wrote.

    Every chunk goes to its own place in the file, so tasks need no order, and one that runs again writes the same
    bytes. Chunks' overlaps are left out. The result must be consumed for the files to be written.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for image, at, n, data, path in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                path = os.path.join(folder, path)
                with open(path, "r+b" if os.path.exists(path) else "xb") as f:
                    f.seek(at)
                    f.write(data[:n])
                rows.append((image, path, at, n))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["image_id", "path", "offset", "size"])

    # one task creates an image's file: its chunks start with the row that comes first
    ordered = chunks.select(F.col("image_id").cast("string"), F.col("offset").cast("long"), F.col("len").cast("long"), "bytes", converted_name(F.col("image_id"), kind).alias("path"))
    return ordered.repartition("image_id").sortWithinPartitions("image_id", "offset").mapInArrow(run, "image_id string, path string, offset long, size long")


def hex_html(lines: DataFrame, key: str) -> DataFrame:
    """(key, page, html): each page of hex lines as an HTML table; one row a page, 1,024 lines at most."""
    escaped = F.replace(F.replace(F.replace("line", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    row = F.struct("line_no", F.concat(F.lit("<tr><td><pre>"), escaped, F.lit("</pre></td></tr>")).alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda x: x["row"]), "")
    return lines.groupBy(key, "page").agg(F.concat(F.lit("<html><body><table>"), body, F.lit("</table></body></html>")).alias("html"))


def hex_pages(files: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, page, html) of each file's content: what hex_html() makes of its hex lines, with no line on its own.

    A page needs only its own bytes, so nothing is shuffled; hex lines are about seven times as long as the bytes.
    Each file has its own pages: files of one key, which hex_html() would put together, stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pages, made, held = [], [], [], 0

            def batch_of() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pages, pa.int64()), pa.array(made, pa.string())], names=[key, "page", "html"])

            for k, c in enumerate(batch.column(1)):
                data = c.as_py() or b""
                stop = -(-len(data) // LINE)
                for a in range(0, stop, PAGE_LINES):
                    # lines hold no line ends, so they are escaped all at once
                    text = "\n".join(shown_lines(data, a, min(stop, a + PAGE_LINES))).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
                    rows.append(k)
                    pages.append(a // PAGE_LINES)
                    made.append("<html><body><table><tr><td><pre>" + text.replace("\n", "</pre></td></tr><tr><td><pre>") + "</pre></td></tr></table></body></html>")
                    held += len(made[-1])
                    if held >= PAGE_BATCH:
                        yield batch_of()
                        rows, pages, made, held = [], [], [], 0
            if rows:
                yield batch_of()

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, page long, html string")
