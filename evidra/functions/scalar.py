"""Column builders for names, sizes, times, paths, hashes and file classes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit names, each 1024 times the one before.
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
#: Extensions of images held as segments of a compressed container, and as raw bytes.
CONTAINER_IMAGES = [".e01", ".s01", ".l01", ".ex01"]
RAW_IMAGES = [".raw", ".img", ".dd", ".iso", ".ad1", ".001", ".dmg", ".sparse", ".sparseimage"]
#: Display names of filesystem types.
FS_TYPES = {"ntfs": "NTFS", "fat12": "FAT12", "fat16": "FAT16", "fat32": "FAT32", "exfat": "ExFAT", "ext2": "Ext2", "ext3": "Ext3", "ext4": "Ext4", "iso9660": "ISO9660", "hfs": "HFS", "apfs": "APFS"}
#: Extensions of each media class; every video is shown as video/mp4.
MIME = {"application/pdf": ["pdf"], "image": ["jpg", "jpeg", "png", "gif", "bmp"], "audio": ["mp3", "wav", "aac", "ogg", "m4a"], "video": ["mp4", "mkv", "flv", "avi", "mov", "wmv"]}
#: First bytes (hex) of file classes, longest first where one begins another.
SIGNATURES = [("89504E470D0A1A0A", "PNG image data"), ("FFD8FF", "JPEG image data"), ("47494638", "GIF image data"), ("25504446", "PDF document"), ("504B0304", "Zip archive data"), ("52494646", "RIFF data"), ("424D", "PC bitmap"), ("7F454C46", "ELF"), ("4D5A", "MS-DOS executable"), ("72656766", "Windows registry file"), ("1F8B", "gzip compressed data"), ("53514C69746520666F726D6174203300", "SQLite 3.x database")]


def readable_size(size: Column) -> Column:
    """`1.12 KB`: steps of 1024 and two decimals, half to even as in C; null is `0 B`."""
    n = size.cast("decimal(20,0)")
    shown = lambda k: F.concat(F.bround(n / F.lit(1024**k).cast("decimal(20,0)"), 2).cast("decimal(24,2)").cast("string"), F.lit(f" {UNITS[k]}"))
    out = F.when(size.isNull(), F.lit("0 B"))
    for k in range(5):
        out = out.when(n < F.lit(1024 ** (k + 1)), shown(k))
    return out.otherwise(shown(5))


def epoch_text(seconds: Column) -> Column:
    """`2024-01-01 00:00:00 UTC`; null and 0 are `N/A`. The session's time zone is UTC."""
    return F.when(seconds.isNull() | (seconds == 0), F.lit("N/A")).otherwise(F.concat(F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC")))


def extension(name: Column) -> Column:
    """`.jpg` in lower case; names that only begin with dots have none."""
    return F.lower(F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1))


def icon_extension(name: Column) -> Column:
    """What follows the last dot, in lower case; `unknown` without a dot."""
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit("unknown"))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def join_path(*parts: Column) -> Column:
    return F.concat_ws("/", *parts)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def volume_label(addr: Column, desc: Column, start: Column, end: Column, size: Column, fs_type: Column) -> Column:
    return F.concat(F.lit("vol"), addr.cast("string"), F.lit(" ("), desc, F.lit(": "), start.cast("string"), F.lit("-"), end.cast("string"), F.lit(", Size: "), readable_size(size), F.lit(", FS: "), fs_type, F.lit(")"))


def image_kind(path: Column) -> Column:
    """`ewf` or `raw` by extension; null for any other, which open_image() refuses."""
    ext = extension(F.substring_index(path, "/", -1))
    return F.when(ext.isin(CONTAINER_IMAGES), F.lit("ewf")).when(ext.isin(RAW_IMAGES), F.lit("raw"))


def fs_name(code: Column) -> Column:
    """Display name of a filesystem code; `Unknown` for other codes and `N/A` where it couldn't be read."""
    names = F.create_map(*[F.lit(x) for pair in FS_TYPES.items() for x in pair])
    return F.when(code.isNull(), F.lit("N/A")).otherwise(F.coalesce(F.try_element_at(names, F.lower(code)), F.lit("Unknown")))


def mime_class(name: Column) -> Column:
    ext = F.lower(F.substring_index(name, ".", -1))
    out = F.when(ext == "pdf", F.lit("application/pdf"))
    for kind, names in MIME.items():
        if kind != "application/pdf":
            out = out.when(ext.isin(names), F.lit("video/mp4") if kind == "video" else F.concat(F.lit(f"{kind}/"), ext))
    return out.otherwise(F.lit("application/octet-stream"))


def content_class(content: Column) -> Column:
    """Class of a file by its first bytes; `ASCII text`, `UTF-8 Unicode text` or `data` without a known signature."""
    out = F.when(F.octet_length(content) == 0, F.lit("empty"))
    for magic, name in SIGNATURES:
        out = out.when(F.hex(F.substring(content, 1, len(magic) // 2)) == magic, F.lit(name))
    text = F.try_validate_utf8(content.cast("string"))
    return out.when(text.isNotNull() & ~text.rlike(r"[^\t\n\r\x20-\x7e]"), F.lit("ASCII text")).when(text.isNotNull() & ~F.contains(text, F.lit("\0")), F.lit("UTF-8 Unicode text")).otherwise(F.lit("data"))


def digests(content: Column) -> Column:
    """struct of md5, sha1 and sha256 in hex, from one read of the content."""
    return F.struct(F.md5(content).alias("md5"), F.sha1(content).alias("sha1"), F.sha2(content, 256).alias("sha256"))


def clock(ms: Column) -> Column:
    """`MM:SS` of milliseconds."""
    s = F.floor(ms / 1000)
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("long"), F.pmod(s, F.lit(60)).cast("long"))


def embedded_time(kind: Column, value: Column) -> Column:
    """Local time of an EXIF date or a PDF date (its zone is ignored); null if malformed."""
    exif = F.try_to_timestamp(value, F.lit("yyyy:MM:dd HH:mm:ss"))
    pdf = F.when(value.startswith("D:"), F.try_to_timestamp(F.substring(value, 3, 14), F.lit("yyyyMMddHHmmss")))
    return F.when(kind == "pdf", pdf).when(kind.isin("jpg", "jpeg", "png"), exif).cast("timestamp_ntz")
