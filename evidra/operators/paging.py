"""Hex and text views: lines, pages and positions of matches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import LINE

PAGE_LINES = 1024
PAGE_CHARS = 2000


#: Each byte as it shows beside its hex digits.
_SHOWN = bytes(b if 0x20 <= b <= 0x7E else 0x2E for b in range(256))
#: Rows of one batch of lines or matches.
_ROWS = 1 << 15


def shown_lines(data: bytes, first: int, stop: int) -> list[str]:
    """Lines `first` up to `stop` of a content's hex view: address, 16 bytes, and the bytes as they show."""
    part = data[first * LINE : stop * LINE]
    digits, shown = part.hex(" ").upper(), part.translate(_SHOWN).decode("ascii")
    return [f"0x{(first + i) * LINE:08x}: {digits[48 * i : 48 * i + 47]:<48}  {shown[LINE * i : LINE * i + LINE]}" for i in range(stop - first)]


def hex_lines(files: DataFrame, key: str, content: str = "content", first_line: int = 0, lines: int | None = None) -> DataFrame:
    """(key, page, line_no, line) of 16 bytes each; only the lines asked for are made.

    Each content is turned to hex once and the lines are cut out of it, so the work grows with its bytes; small files
    share batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, made = [], [], []

            def batch_of() -> pa.RecordBatch:
                no = np.concatenate(numbers)
                return pa.RecordBatch.from_arrays([pa.concat_arrays(keys), pa.array(no // PAGE_LINES), pa.array(no), pa.array(made)], names=[key, "page", "line_no", "line"])

            for k, c in enumerate(batch.column(1)):
                data = c.as_py() or b""
                stop = -(-len(data) // LINE)
                stop = stop if lines is None else min(stop, first_line + lines)
                for a in range(first_line, stop, _ROWS):
                    b = min(stop, a + _ROWS)
                    if made and len(made) + b - a > _ROWS:
                        yield batch_of()
                        keys, numbers, made = [], [], []
                    keys.append(_repeated(batch.column(0), k, b - a))
                    numbers.append(np.arange(a, b))
                    made += shown_lines(data, a, b)
            if made:
                yield batch_of()

    return files.select(key, content).mapInArrow(run, f"`{key}` {files.schema[key].dataType.simpleString()}, page long, line_no long, line string")


def _repeated(column: pa.Array, k: int, n: int) -> pa.Array:
    return column.take(pa.array(np.full(n, k)))


def _places(needle: str | bytes, step: int, key: str, kind: str):
    """Of (key, value) rows, (key, position) of the needle, looked for again `step` places after each match."""
    if not needle:
        raise ValueError("nothing to look for")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, rows = [], []
            for k, value in enumerate(batch.column(1)):
                value = value.as_py() or needle[:0]
                at = value.find(needle)
                while at >= 0:
                    found.append(at)
                    rows.append(k)
                    if len(found) == _ROWS:
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(found, pa.int64())], names=[key, "position"])
                        found, rows = [], []
                    at = value.find(needle, at + step)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=[key, "position"])

    return run, f"`{key}` {kind}, position long"


def text_pages(files: DataFrame, key: str, text: str = "text", size: int = PAGE_CHARS) -> DataFrame:
    """(key, page, pages, page_text) of `size` characters; an empty text has no page."""
    pages = F.ceil(F.length(text) / size).cast("long")
    numbered = files.filter(F.length(text) > 0).select(key, text, pages.alias("pages"), F.explode(F.sequence(F.lit(0).cast("long"), pages - 1)).alias("page"))
    return numbered.select(key, "page", "pages", F.col(text).substr((F.col("page") * size + 1).cast("int"), F.lit(size)).alias("page_text"))


def text_positions(files: DataFrame, key: str, needle: str, text: str = "text", size: int = PAGE_CHARS) -> DataFrame:
    """(key, position, page, column) of matches that don't overlap, case counted; columns from 0."""
    found = files.select(key, text).mapInArrow(*_places(needle, len(needle), key, files.schema[key].dataType.simpleString()))
    return found.select(key, "position", F.floor(F.col("position") / size).cast("long").alias("page"), F.pmod("position", F.lit(size)).alias("column"))


def byte_lines(files: DataFrame, key: str, needle: bytes, content: str = "content", overlapping: bool = True) -> DataFrame:
    """(key, position, line_no) of a byte string in contents, each row for itself; overlapping matches if asked for."""
    found = files.select(key, content).mapInArrow(*_places(needle, 1 if overlapping else len(needle), key, files.schema[key].dataType.simpleString()))
    return found.select(key, "position", F.floor(F.col("position") / LINE).cast("long").alias("line_no"))


def query_kinds(query: Column) -> Column:
    """query_kind()'s first answer for a column of search texts."""
    plain = F.replace(query, F.lit(" "), F.lit(""))
    return F.when((F.length(plain) % 2 == 0) & plain.rlike("^[0-9A-Fa-f]+$"), F.lit("bytes")).when(query.rlike("^0[xX][0-9A-Fa-f]+$"), F.lit("address")).otherwise(F.lit("string"))


def query_kind(query: str) -> tuple[str, bytes | int | str]:
    """(bytes, address or string; what to look for) of a hex view's search text.

    An even number of hex digits is bytes, 0x and digits an address, anything else a string."""
    plain = query.replace(" ", "")
    if plain and len(plain) % 2 == 0 and re.fullmatch("[0-9A-Fa-f]+", plain):
        return "bytes", bytes.fromhex(plain)
    if re.fullmatch("0[xX][0-9A-Fa-f]+", query):
        return "address", int(query, 16)
    return "string", query


def address_line(address: Column, size: Column) -> Column:
    """The line that holds an address; null beyond the end. A last short line counts."""
    return F.when(address < size, F.floor(address / LINE).cast("long"))
