"""Expected values of single functions."""

import base64

import pytest
from pyspark.sql import functions as F

from evidra.functions import scalar as S
from evidra.functions import text as X
from evidra.operators import paging, search


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


@pytest.mark.parametrize("n, want", [(None, "0 B"), (0, "0.00 B"), (1023, "1023.00 B"), (1024, "1.00 KB"), (1152, "1.12 KB"), (1536, "1.50 KB"), (1048575, "1024.00 KB"), (1048576, "1.00 MB"), (5497558138880, "5.00 TB"), (1125899906842624, "1.00 PB")])
def test_readable_size(spark, n, want):
    assert one(spark, S.readable_size(F.col("n").cast("long")), n=n) == want


@pytest.mark.parametrize("t, want", [(None, "N/A"), (0, "N/A"), (1704067200, "2024-01-01 00:00:00 UTC")])
def test_epoch_text(spark, t, want):
    assert one(spark, S.epoch_text(F.col("t").cast("long")), t=t) == want


@pytest.mark.parametrize("name, ext, icon", [("Photo.JPG", ".jpg", "jpg"), (".bashrc", "", "bashrc"), ("a.tar.GZ", ".gz", "gz"), ("noext", "", "unknown"), ("..x.y", ".y", "y"), ("a.", ".", "")])
def test_extensions(spark, name, ext, icon):
    assert one(spark, S.extension(F.col("n")), n=name) == ext
    assert one(spark, S.icon_extension(F.col("n")), n=name) == icon


@pytest.mark.parametrize("pattern, name, want", [("*.pdf", "Report.PDF", True), ("a?c", "abc", True), ("a?c", "ac", False), ("[x]*", "[x]y", True), ("*.pdf", "x.pdf.bak", False), ("été.*", "ÉTÉ.pdf", True)])
def test_wildcard(spark, pattern, name, want):
    assert one(spark, search.wildcard(F.col("n"), pattern), n=name) is want


RAW = bytes.fromhex("0041424344E9FF00616263007778797A7E")


def test_strings_and_hex_lines(spark):
    assert one(spark, X.printable_strings(F.col("c")), c=RAW) == "ABCD\nwxyz~"
    df = spark.createDataFrame([(1, RAW)], "k int, content binary")
    assert [r.line for r in paging.hex_lines(df, "k").orderBy("line_no").collect()] == ["0x00000000: 00 41 42 43 44 E9 FF 00 61 62 63 00 77 78 79 7A   .ABCD...abc.wxyz", "0x00000010: 7E" + " " * 48 + ("~")]


@pytest.mark.parametrize("f, text, want", [
    (X.from_base64, "SGVsbG8=", "Hello"), (X.from_base64, "SGVsbG8", None), (X.from_base64, "SGVs!bG8=", None), (lambda c: X.from_base64(c, strict=False), "SGVs!bG8=", "Hello"), (X.from_base64, base64.b64encode(b"\xff\xfe").decode(), None),
    (X.from_hex, "48 65", "He"), (X.from_hex, "ABC", None), (X.from_hex, "zz", None), (X.from_url, "a%20b+c", "a b c"), (X.from_url, "100%", "100%"), (X.from_html, "&lt;b&gt;&eacute;", "<b>é"),
    (X.from_octal, "110 151", "Hi"), (X.from_octal, "9", None), (X.from_octal, "454", "Ĭ"), (X.from_binary, "1001000 1101001", "Hi"), (X.from_binary, "12", None),
    (X.auto_decode, "hello", "hello"), (X.auto_decode, "beef", "beef"), (X.auto_decode, "1001000", "H"), (X.auto_decode, "48656c6c6f", "Hello"), (X.auto_decode, "110 151", "Hi"), (X.auto_decode, "SGVsbG8=", "Hello"), (X.auto_decode, "&lt;", "&lt;"),
    (X.percent_decoded, "a%20b+c%zz", "a b+c%zz"),
])
def test_decoders(spark, f, text, want):
    assert one(spark, f(F.col("t")), t=text) == want


def test_long_input_to_decoders(spark):
    big = "ab " * 200_000
    df = spark.createDataFrame([(big,)], "t string")
    assert df.select(F.length(F.coalesce(X.from_hex(F.col("t")), X.from_octal(F.col("t")), F.lit("")))).first()[0] == 0


@pytest.mark.parametrize("kind, value, want", [("jpg", "2024:01:15 14:30:00", "2024-01-15 14:30:00"), ("pdf", "D:20240115143000+02'00'", "2024-01-15 14:30:00"), ("pdf", "x", None), ("zip", "x", None)])
def test_embedded_time(spark, kind, value, want):
    got = one(spark, S.embedded_time(F.col("k"), F.col("v")), k=kind, v=value)
    assert (str(got) if got else None) == want


def test_classes(spark):
    assert one(spark, S.content_class(F.col("c")), c=b"\x89PNG\r\n\x1a\nxx") == "PNG image data"
    assert one(spark, S.content_class(F.col("c")), c=b"plain\n") == "ASCII text"
    assert one(spark, S.content_class(F.col("c")), c="é".encode()) == "UTF-8 Unicode text"
    assert one(spark, S.content_class(F.col("c")), c=b"\xff\x00") == "data"
    assert one(spark, S.content_class(F.col("c")), c=b"") == "empty"
    assert one(spark, S.fs_name(F.col("c")), c="ntfs") == "NTFS"
    assert one(spark, S.fs_name(F.col("c")), c="zfs") == "Unknown"
    assert one(spark, S.mime_class(F.col("c")), c="a.MP4") == "video/mp4"
    assert one(spark, S.image_kind(F.col("c")), c="/x/a.E01") == "ewf"
    assert one(spark, X.readable_text(F.col("c")), c=b"\xe9") == "é"
    assert one(spark, X.pdf_tail(F.col("c")), c=b"x%%EOF\r\nrest") == b"x%%EOF\r\n"
    assert one(spark, X.pdf_tail(F.col("c")), c=b"none") == b"none"


def test_query_kinds():
    assert paging.query_kind("cafe") == ("bytes", b"\xca\xfe")
    assert paging.query_kind("0x1F") == ("address", 31)
    assert paging.query_kind("hello") == ("string", "hello")


def test_byte_search_overlaps(spark):
    df = spark.createDataFrame([(1, b"aaaa" + b"\xff" * 14 + b"aa")], "k int, content binary")
    assert sorted((r.position, r.line_no) for r in paging.byte_lines(df, "k", b"aa").collect()) == [(0, 0), (1, 0), (2, 0), (18, 1)]
    assert sorted(r.position for r in paging.byte_lines(df, "k", b"aa", overlapping=False).collect()) == [0, 2, 18]
