"""The NTFS reader on a volume built here, under chunks of several sizes."""

import struct

import pytest
from test_sources import hive

from evidra.operators import registry, search, space
from evidra.sources import ntfs, rawimage, regf

CLUSTER, RECORD, START = 1024, 1024, 64
STAMP = 133_500_000_000_000_000


def resident(kind, value, name=b""):
    head = 24 + len(name)
    size = -(-(head + len(value)) // 8) * 8
    return (struct.pack("<IIBBHHHIHH", kind, size, 0, len(name) // 2, 24, 0, 0, len(value), head, 0) + name + value).ljust(size, b"\0")


def stored(kind, run_list, size, vcn=0, flags=0, valid=None):
    out, at = b"", 0
    for lcn, n in run_list:
        if lcn is None:
            out += bytes([0x02]) + struct.pack("<H", n)
        else:
            out += bytes([0x22]) + struct.pack("<Hh", n, lcn - at)
            at = lcn
    total = sum(n for _, n in run_list)
    length = -(-(64 + len(out) + 1) // 8) * 8
    return (struct.pack("<IIBBHHHQQHH4xQQQ", kind, length, 1, 0, 64, flags, 0, vcn, vcn + total - 1, 64, 0, total * CLUSTER, size, size if valid is None else valid) + out + b"\0").ljust(length, b"\0")


def name(text, parent, parent_seq=1, space=1):
    return resident(0x30, struct.pack("<Q", parent | parent_seq << 48) + struct.pack("<4Q", *[STAMP] * 4) + bytes(24) + bytes([len(text), space]) + text.encode("utf-16-le"))


def entry(attributes, seq=1, flags=1, base=0):
    body = struct.pack("<4sHHQHHHHIIQHHI", b"FILE", 48, 3, 0, seq, 1, 56, flags, 0, RECORD, base, 9, 0, 0).ljust(56, b"\0")
    out = bytearray((body + b"".join(attributes) + struct.pack("<I", 0xFFFFFFFF)).ljust(RECORD, b"\0"))
    out[48:50] = b"\x07\x07"
    for k in (1, 2):
        out[48 + 2 * k : 50 + 2 * k] = out[512 * k - 2 : 512 * k]
        out[512 * k - 2 : 512 * k] = b"\x07\x07"
    return bytes(out)


def standard():
    return resident(0x10, struct.pack("<4Q", STAMP, STAMP + 10_000_000, STAMP, STAMP) + bytes(16))


#: A file of two runs whose second part is told by a record of its own.
LONG = bytes(range(256)) * 14


def volume(split=False):
    """A file table in two runs, folders, a hive, a kept file, gaps, a deleted file, hard links, a file in two records."""
    own = hive()
    folder = lambda text, parent, **kw: entry([standard(), name(text, parent)], flags=3, **kw)
    table = {
        0: entry([standard(), name("$MFT", 5), stored(0x80, [(4, 24), (60, 16)], 40 * RECORD)]),
        5: entry([standard(), name(".", 5)], flags=3),
        6: folder("Windows", 5),
        7: folder("System32", 6),
        8: folder("config", 7),
        9: entry([standard(), name("SOFTWARE", 8), stored(0x80, [(100, 2), (110, 8)], len(own))]),
        10: entry([standard(), name("LONGNA~1.TXT", 5, space=2), name("Long näme.txt", 5), resident(0x80, b"kept here"), resident(0x80, b"other stream", "ads".encode("utf-16-le"))]),
        11: entry([standard(), name("gaps.bin", 5), stored(0x80, [(120, 1), (None, 2), (121, 2)], 4500, valid=4000)]),
        12: entry([standard(), name("gone.txt", 13), resident(0x80, b"deleted")], flags=0),
        13: entry([standard(), name("Old", 5)], seq=2, flags=2),
        14: entry([standard(), name("a", 5), name("b", 6), stored(0x80, [(130, 1)], 3)]),
        15: entry([standard(), name("lost.txt", 6, parent_seq=9), resident(0x80, b"")]),
        16: entry([standard(), name("coded.txt", 5), stored(0x80, [(131, 16)], 9000, flags=1)]),
        17: entry([standard(), resident(0x20, b"list"), name("two.bin", 8), stored(0x80, [(150, 2)], len(LONG))]),
        30: entry([stored(0x80, [(160, 2)], 0, vcn=2)], base=17 | 1 << 48),
        31: entry([stored(0x80, [(170, 2)], 0, vcn=2)], base=17 | 7 << 48),  # of a file that had the number before
        32: entry([standard(), name("Loop", 33)], flags=3),
        33: entry([standard(), name("Pool", 32)], flags=3),
        34: entry([standard(), name("end", 5), stored(0x80, [(195, 50)], 50 * CLUSTER)]),  # beyond the image
    }
    if split:  # the table's second run is told by record 20, its third part by a record of the second
        table[0] = entry([standard(), resident(0x20, b"list"), name("$MFT", 5), stored(0x80, [(4, 24)], 40 * RECORD)])
        table[20] = entry([stored(0x80, [(60, 8)], 0, vcn=24)], base=1 << 48)
        table[29] = entry([stored(0x80, [(68, 8)], 0, vcn=32)], base=1 << 48)
    torn = bytearray(entry([standard(), name("torn", 5)]))
    torn[510:512] = b"xx"
    table[35] = bytes(torn)
    out = bytearray(200 * CLUSTER)
    out[:512] = (b"\xeb\x52\x90NTFS    " + struct.pack("<HB", 512, 2)).ljust(40, b"\0") + struct.pack("<QQQb", 400, 4, 0, -10) + bytes(447)
    out[510:512] = b"\x55\xaa"
    put = lambda lcn, data: out.__setitem__(slice(lcn * CLUSTER, lcn * CLUSTER + len(data)), data)
    for k, raw in table.items():
        put(4 + k if k < 24 else 60 + k - 24, raw)
    put(100, own[: 2 * CLUSTER])
    put(110, own[2 * CLUSTER :])
    put(120, b"A" * 1024)
    put(121, b"B" * 2048)
    put(130, b"abc")
    put(150, LONG[:2048])
    put(160, LONG[2048:])
    return bytes(out)


def image(split=False):
    head = bytearray(START * 512)
    struct.pack_into("<B3xB3xII", head, 446, 0x80, 0x07, START, 400)
    head[510:512] = b"\x55\xaa"
    return bytes(head) + volume(split)


@pytest.fixture(scope="module", params=[1000, 65536])
def parts(spark, request):
    images = spark.createDataFrame([("i", image()), ("j", image()[: START * 512 + 64 * CLUSTER])], "path string, content binary")
    chunks = rawimage.chunks_of_files(images, request.param)
    places = spark.createDataFrame([("i", START, "ntfs"), ("j", START, "ntfs"), ("i", 0, "ntfs"), ("none", 0, "ntfs")], "image_id string, start long, fs_type string")
    return chunks, places, ntfs.records(chunks, places).cache()


def test_ranges(spark):
    data = bytes(range(256)) * 40
    chunks = rawimage.chunks_of_files(spark.createDataFrame([("i", data)], "path string, content binary"), 1000, 100)
    ranges = [(k, at, n) for k, (at, n) in enumerate([(0, 10), (990, 20), (5, 9000), (10200, 500), (20000, 4), (7, 0), (0, 10)])]
    df = spark.createDataFrame([("i", *r) for r in ranges], "image_id string, k int, at long, length long")
    for width in (64, 1 << 20):
        got = {}
        for r in space.read_ranges(chunks, df, ["k"], width).orderBy("k", "at").collect():
            got[r.k] = got.get(r.k, b"") + bytes(r.bytes)
        assert got == {k: data[at : at + n] for k, at, n in ranges if data[at : at + n]}


def test_entries(parts):
    chunks, places, files = parts
    got = {(r.path, r.inode): r for r in ntfs.entries(files.filter("image_id = 'i'")).collect()}
    assert sorted(got) == sorted([
        ("/$MFT", 0), ("/Windows", 6), ("/Windows/System32", 7), ("/Windows/System32/config", 8), ("/Windows/System32/config/SOFTWARE", 9), ("/Long näme.txt", 10), ("/gaps.bin", 11),
        ("/Old", 13), ("/Old/gone.txt", 12), ("/a", 14), ("/Windows/b", 14), ("/$OrphanFiles/lost.txt", 15), ("/coded.txt", 16), ("/Windows/System32/config/two.bin", 17), ("/end", 34),
        ("/$OrphanFiles/Pool/Loop", 32), ("/$OrphanFiles/Loop/Pool", 33),
    ])
    gone = got["/Old/gone.txt", 12]
    assert not gone.is_allocated and gone.parent_inode == 13 and gone.size == 7
    assert str(got["/a", 14].modified)[:19] == "2024-01-17 21:20:01" and got["/Windows", 6].is_directory and got["/Windows", 6].size == 0
    assert [(r.inode, r.problem) for r in files.filter("image_id = 'i' and problem is not null").collect()] == [(35, "a torn record")]


def test_contents(parts):
    chunks, places, files = parts
    got = {r.inode: r for r in ntfs.contents(chunks, files.filter("image_id = 'i'")).collect()}
    held = {k: r.content and bytes(r.content) for k, r in got.items()}
    assert held[9] == hive() and held[10] == b"kept here" and held[12] == b"deleted" and held[14] == b"abc" and held[15] == b"" and held[17] == LONG
    assert held[11] == (b"A" * 1024 + bytes(2048) + b"B" * 928).ljust(4500, b"\0")
    assert held[16] is None and held[34] is None and got[16].size == 9000
    small = {r.inode: r.content for r in ntfs.contents(chunks, files.filter("image_id = 'i'"), 100).collect()}
    assert small[9] is None and bytes(small[14]) == b"abc" and set(small) == set(got)
    # an image that ends early still gives what it has
    short = {r.inode: r.content for r in ntfs.contents(chunks, files.filter("image_id = 'j'")).collect()}
    assert short[9] is None and bytes(short[10]) == b"kept here"


def test_tables_say_what_is_wrong(parts):
    chunks, places, _ = parts
    got = {(r.image_id, r.start_offset): r.problem for r in ntfs.tables(chunks, places).collect()}
    assert got == {("i", START): None, ("j", START): None, ("i", 0): "no NTFS boot sector", ("none", 0): "no NTFS boot sector"}


def test_hive_by_path(parts):
    """The software hive found by its path, its content joined and its keys read."""
    chunks, places, files = parts
    found = registry.hive_files(ntfs.entries(files), places, registry.HIVES["SOFTWARE"])
    held = ntfs.contents(chunks, files).filter("content is not null")
    own = found.join(held.drop("size"), ["image_id", "start_offset", "inode"])
    assert [(r.value_name, r.value) for r in regf.tree(own).filter("value_name is not null").collect()] == [("(default)", "hi"), ("num", "42")]
    listed = search.children(ntfs.entries(files.filter("image_id = 'i'")), START, 8)
    assert sorted(r.name for r in listed.collect()) == ["SOFTWARE", "two.bin"]


def test_records_that_are_broken():
    assert ntfs.record(bytes(1024)) is None
    assert ntfs.record(b"BAAD" + bytes(1020))["problem"] == "a torn record"
    broken = bytearray(entry([standard(), name("x", 5)]))
    broken[60:64] = struct.pack("<I", 5000)
    assert ntfs.record(bytes(broken))["problem"] == "an attribute beyond its record"
    assert list(ntfs.runs(b"\x21\x03\x10\x00\x01\x02\x11\x04\xf0\x00")) == [(0, 16, 3), (3, -1, 2), (5, 0, 4)]
    with pytest.raises(ValueError):
        list(ntfs.runs(b"\x11\x00\x05\x00"))
    assert ntfs.geometry(bytes(512)) is None and ntfs.geometry(b"short") is None


def test_a_file_table_in_parts(spark):
    places = spark.createDataFrame([("i", START), ("cut", START)], "image_id string, start long")
    cut = bytearray(image(split=True))
    at = (START * 512) + 24 * CLUSTER  # record 20
    cut[at : at + 4] = b"BAAD"
    whole, parts = (rawimage.chunks_of_files(spark.createDataFrame([("i", b), ("cut", bytes(cut))], "path string, content binary"), 5000) for b in (image(), image(split=True)))
    key = lambda r: (r.path, r.inode)
    names = lambda chunks: sorted(key(r) for r in ntfs.entries(ntfs.records(chunks, places)).filter("image_id = 'i'").collect())
    assert names(parts) == names(whole)
    assert {r.image_id: r.problem for r in ntfs.tables(parts, places).collect()} == {"i": None, "cut": "parts of the file table weren't found"}
