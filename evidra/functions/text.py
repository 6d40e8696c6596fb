"""Column builders for text in files: printable strings, hex lines, decoders."""

from __future__ import annotations

import html
import re
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = 16


def latin1(content: Column) -> Column:
    """One character for each byte."""
    return F.decode(content, "ISO-8859-1")


def readable_text(content: Column) -> Column:
    """The content as UTF-8 if it is valid, else as ISO-8859-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), latin1(content))


def printable_strings(content: Column, least: int = 4) -> Column:
    """Runs of `least` or more printable ASCII bytes, one in each line."""
    return F.array_join(F.regexp_extract_all(latin1(content), F.lit(f"([ -~]{{{least},}})"), F.lit(1)), "\n")


def hex_line(chunk: Column, address: Column) -> Column:
    """`0x00000010: 41 42 ...   AB...` of up to 16 bytes."""
    pairs = F.regexp_replace(F.hex(chunk), "(..)(?=.)", "$1 ")
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(address)), 8, "0"), F.lit(": "), F.rpad(pairs, 48, " "), F.lit("  "), F.regexp_replace(latin1(chunk), "[^ -~]", "."))


def parse_hex_line(line: Column) -> Column:
    """struct of address, hex and ascii of a hex line; ascii is stripped."""
    part = lambda k: F.regexp_extract(line, r"^(0x[0-9a-f]+): (.{48})  (.*)$", k)
    return F.struct(part(1).alias("address"), F.trim(part(2)).alias("hex"), F.trim(part(3)).alias("ascii"))


def text_or_null(content: Column) -> Column:
    return F.try_validate_utf8(content.cast("string"))


def from_base64(text: Column, strict: bool = True) -> Column:
    """UTF-8 text of a base64 string; null if it isn't one. strict refuses characters outside the alphabet."""
    clean = text if strict else F.regexp_replace(text, "[^A-Za-z0-9+/=]", "")
    good = (F.length(clean) % 4 == 0) & _solid(clean)  # the decoder itself refuses other characters
    return F.when(good, text_or_null(F.try_to_binary(clean, F.lit("base64"))))


def _solid(text: Column) -> Column:
    """Whether there is no white space in a text."""
    return F.translate(text, " \t\n\x0b\f\r", "") == text


def from_hex(text: Column) -> Column:
    """UTF-8 text of pairs of hex digits, white space between them allowed; null if it isn't that."""
    words = F.split(text, r"\s+")
    good = ~text.rlike(r"[^0-9A-Fa-f\s]") & F.forall(words, lambda w: F.length(w) % 2 == 0)
    spaced = F.when(good, text_or_null(F.unhex(F.regexp_replace(text, r"\s", ""))))
    return F.when(_solid(text), F.when(F.length(text) % 2 == 0, text_or_null(F.unhex(text)))).otherwise(spaced)


def _points(text: Column, digits: str, base: int) -> Column:
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    point = F.transform(words, lambda w: F.conv(w, base, 10).cast("long"))
    good = ~text.rlike(rf"[^{digits}\s]") & (F.size(words) > 0) & F.forall(F.transform(words, F.length), lambda n: n <= 21) & F.forall(point, lambda p: (p <= 0x10FFFF) & ((p < 0xD800) | (p > 0xDFFF)))
    # a code point as UTF-32 big-endian bytes, decoded
    chars = F.transform(point, lambda p: F.decode(F.unhex(F.lpad(F.hex(p), 8, "0")), "UTF-32"))
    return F.when(good, F.array_join(chars, ""))


def from_octal(text: Column) -> Column:
    """Characters of octal code points with white space between them; null if it isn't that."""
    return _points(text, "0-7", 8)


def from_binary(text: Column) -> Column:
    """Characters of binary code points with white space between them; null if it isn't that."""
    return _points(text, "01", 2)


@F.pandas_udf(T.StringType())
def _unquote(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unquote_plus(t))


@F.pandas_udf(T.StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else html.unescape(t))


@F.pandas_udf(T.StringType())
def _percent(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else re.sub(r"%([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), t))


def from_url(text: Column) -> Column:
    """Percent-decoded text, `+` a space; malformed escapes stay as they are (an Arrow UDF handles those)."""
    return F.coalesce(F.try_url_decode(text), _unquote(text))


def from_url_strict(text: Column) -> Column:
    """As from_url(), in the JVM; null if an escape is malformed."""
    return F.try_url_decode(text)


def from_html(text: Column) -> Column:
    return _unescape(text)


def percent_decoded(text: Column) -> Column:
    """%XX as one character each; `+` stays."""
    return F.when(F.contains(text, F.lit("%")), _percent(text)).otherwise(text)


def auto_decode(text: Column) -> Column:
    """The first decoder with a result that isn't empty: binary, octal, base64, hex, URL, HTML."""
    some = lambda c: F.when(c != "", c)
    return F.coalesce(*[some(f(text)) for f in (from_binary, from_octal, from_base64, from_hex, from_url, from_html)])


def pdf_tail(content: Column) -> Column:
    """Bytes up to the last %%EOF and at most ten white-space bytes; all of them without one."""
    text = latin1(content)
    cut = F.regexp_extract(text, r"(?s)^(.*%%EOF[\n\r \t]{0,10})", 1)
    return F.when(cut != "", F.encode(cut, "ISO-8859-1")).otherwise(content)


def sized_text(report: Column) -> Column:
    """A metadata report up to the size that ends its attributes; all of it without one."""
    cut = F.regexp_extract(report, r"(?s)^(.*?init_size: \d+)", 1)
    return F.when(cut != "", cut).otherwise(report)
