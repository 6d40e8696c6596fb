"""Sources and recovery on bytes made here."""

import hashlib
import struct
import zipfile
import zlib
from io import BytesIO

import pytest

from evidra.operators import carve, registry
from evidra.sources import ewf, export, fat, rawimage, regf
from evidra.streaming import counts


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def jpg(date=b"2024:01:15 14:30:00\0"):
    ifd = struct.pack("<HHHIIHHIII", 2, 0x0132, 2, len(date), 8 + 2 + 24 + 4, 0x010F, 2, 4, int.from_bytes(b"Cam\0", "little"), 0)
    tiff = b"II*\0" + struct.pack("<I", 8) + ifd + date
    app1 = b"Exif\0\0" + tiff
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xda\x00\x04\x00\x00imagedata\xff\xd9"


def files():
    z = BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr(zipfile.ZipInfo("a.txt", (2020, 2, 3, 4, 5, 6)), b"hello")
        f.writestr(zipfile.ZipInfo("b.txt", (2021, 2, 3, 4, 5, 6)), b"world")
    wav = b"RIFF" + struct.pack("<I", 20) + b"WAVEfmt " + bytes(12)
    bmp = b"BM" + struct.pack("<I", 120) + bytes(8) + struct.pack("<III", 40, 3, 4) + bytes(94)
    pdf = b"%PDF-1.4\n1 0 obj /CreationDate (D:20240115143000Z) trailer\nstartxref\n%%EOF"
    mov = struct.pack(">I4s", 16, b"wide") + bytes(8) + struct.pack(">I4s", 24, b"mdat") + bytes(16)
    wmv = carve.ASF_HEADER + bytes(20) + carve.ASF_PROPERTIES + bytes(24) + struct.pack("<Q", 120)
    wmv += bytes(120 - len(wmv))
    gif = b"GIF89a" + bytes(range(1, 12)) + b"\x00;"
    return {"png": png(), "jpg": jpg(), "zip": z.getvalue(), "wav": wav, "bmp": bmp, "pdf": pdf, "mov": mov, "wmv": wmv, "gif": gif}


@pytest.mark.parametrize("cross", [False, True])
def test_recovery(spark, cross):
    """Every type at a known place; with cross, some run over the end of a chunk."""
    data, where = bytearray(b"\x11" * 64), {}
    for kind, content in files().items():
        while len(data) % 64 != 0:
            data += b"\x11"
        where[kind] = (len(data), content)
        data += content + b"\x11" * 40
    size = 300 if cross else len(data)
    image = spark.createDataFrame([("i", bytes(data))], "path string, content binary")
    chunks = rawimage.chunks_of_files(image, size, 400 if cross else 0)
    got = {(r.type, r.offset): r for r in carve.carve(chunks).collect()}
    for kind, (at, content) in where.items():
        assert bytes(got[kind, at].content) == content, kind
        assert got[kind, at].name == f"{at:x}.{kind}" and got[kind, at].size == len(content)
    assert str(got["jpg", where["jpg"][0]].mtime) == str(got["pdf", where["pdf"][0]].mtime) == "2024-01-15 14:30:00"
    assert str(got["zip", where["zip"][0]].mtime) == "2020-02-03 04:05:06"


def test_recovery_of_broken_files():
    assert list(carve.find(b"\x30" + struct.pack(">I4s", 0, b"moov") * 3)) == []  # a size of 0
    asf = carve.ASF_HEADER + carve.ASF_PROPERTIES + bytes(32)
    assert list(carve.find(asf)) == []
    assert list(carve.find(b"PK\x03\x04short")) == []
    bad = bytearray(png())
    bad[20] ^= 1
    assert list(carve.find(bytes(bad))) == []
    linear = b"%PDF-1.5 /Linearized 1 /L 70 /H startxref %%EOF more %%EOF"
    linear += b" " * (70 - len(linear))
    assert list(carve.find(linear + b"tail", ["pdf"])) == [("pdf", 0, 70)]
    two = png() + b"xx" + png()
    assert [a for _, a, _ in carve.find(two, ["png"])] == [0, len(png()) + 2]


def test_exif(spark):
    df = spark.createDataFrame([(1, jpg()), (2, b"no"), (3, None)], "k int, content binary")
    assert sorted((r.k, r.tag, r.value) for r in carve.exif_tags(df, "k").collect()) == [(1, "DateTime", "2024:01:15 14:30:00"), (1, "Make", "Cam")]


def fat16():
    """A volume with a long name, a folder, a file of two clusters and a deleted one."""
    boot = bytearray(512)
    boot[3:11] = b"MSDOS5.0"
    struct.pack_into("<HBHBHHBH", boot, 11, 512, 1, 1, 1, 32, 5000, 0xF8, 20)
    boot[510:512] = b"\x55\xaa"
    table = bytearray(20 * 512)
    for c, v in ((0, 0xFFF8), (1, 0xFFFF), (2, 3), (3, 0xFFFF), (4, 0xFFFF), (5, 0xFFFF)):
        struct.pack_into("<H", table, 2 * c, v)
    entry = lambda name, flags, cluster, size: name.ljust(11) + bytes([flags]) + bytes(10) + struct.pack("<HHHI", 0x7000, 0x582F, cluster, size)
    long = "Long name.txt".encode("utf-16-le") + b"\0\0" + b"\xff\xff" * 12
    lfn = bytes([0x41]) + long[:10] + b"\x0f\0\0" + long[10:22] + b"\0\0" + long[22:26]
    root = lfn + entry(b"LONGNA~1TXT", 0x20, 2, 700) + entry(b"DIR", 0x10, 4, 0) + b"\xe5" + entry(b"DELETED BIN", 0x20, 6, 5)[1:]
    sub = entry(b".", 0x10, 4, 0) + entry(b"..", 0x10, 0, 0) + entry(b"IN      TXT", 0x20, 5, 3)
    clusters = (b"A" * 512 + b"B" * 188).ljust(1024, b"\0") + sub.ljust(512, b"\0") + b"abc".ljust(512, b"\0") + b"gone!".ljust(512, b"\0")
    return (bytes(boot) + bytes(table) + root.ljust(1024, b"\0") + clusters).ljust(5000 * 512, b"\0")


def disk():
    volume = fat16()
    head = bytearray(64 * 512)
    struct.pack_into("<B3xB3xII", head, 446, 0x80, 0x06, 64, 5000)
    head[510:512] = b"\x55\xaa"
    return bytes(head) + volume + bytes(512 * 100)


def test_volumes_and_fat(spark, tmp_path):
    (tmp_path / "a.dd").write_bytes(disk())
    images = spark.read.format("binaryFile").load(str(tmp_path / "a.dd")).select("path", "content")
    got = [(r.desc, r.start, r.length, r.is_alloc, r.fs_type) for r in rawimage.volumes(images).orderBy("addr").collect()]
    assert got == [("Primary Table (#0)", 0, 1, False, None), ("Unallocated", 1, 63, False, None), ("FAT16 (0x06)", 64, 5000, True, "fat16"), ("Unallocated", 5064, 100, False, None)]
    v = spark.createDataFrame([("a", 64, fat16())], "image_id string, start_offset long, bytes binary")
    rows = {r.path: r for r in fat.entries(v).collect()}
    assert set(rows) == {"/Long name.txt", "/DIR", "/DIR/IN.TXT", "/_ELETED.BIN"}
    assert bytes(rows["/Long name.txt"].content) == b"A" * 512 + b"B" * 188
    assert bytes(rows["/_ELETED.BIN"].content) == b"gone!" and not rows["/_ELETED.BIN"].is_allocated
    assert rows["/DIR/IN.TXT"].parent_inode == rows["/DIR"].inode
    assert str(rows["/DIR/IN.TXT"].modified) == "2024-01-15 14:00:00"
    broken = spark.createDataFrame([("a", 64, fat16()), ("b", 0, b"short"), ("c", 0, bytes(512)), ("d", 0, None)], "image_id string, start_offset long, bytes binary")
    got = fat.entries(broken).collect()
    assert sum(r.image_id == "a" and r.problem is None for r in got) == 4
    assert sorted(r.image_id for r in got if r.problem is not None) == ["b", "c", "d"] and all(r.path is None for r in got if r.problem)


def extended_disk():
    """A primary FAT volume, and two logical ones whose tables lie 200 and 400 sectors on."""
    out = bytearray(disk() + bytes(512 * 600))
    struct.pack_into("<B3xB3xII", out, 462, 0, 0x05, 5200, 500)
    for at, (start, length), onward in ((5200, (10, 100), 200), (5400, (10, 90), None)):
        struct.pack_into("<B3xB3xII", out, at * 512 + 446, 0, 0x83, start, length)
        if onward:
            struct.pack_into("<B3xB3xII", out, at * 512 + 462, 0, 0x05, onward, 200)
        out[at * 512 + 510 : at * 512 + 512] = b"\x55\xaa"
    return bytes(out)


@pytest.mark.parametrize("width", [1000, 1 << 16])
def test_volumes_of_chunks(spark, width):
    """The same volumes from chunks as from whole images; logical partitions beyond the head too."""
    images = spark.createDataFrame([("a", disk()), ("b", extended_disk()), ("wiped", bytes(9000))], "path string, content binary")
    key = lambda r: (r.image_id, r.addr)
    columns = ["image_id", "addr", "desc", "start", "length", "is_alloc", "fs_type", "block_size"]
    want = sorted(rawimage.volumes(images).select(columns).collect(), key=key)
    got = sorted(rawimage.volumes_of_chunks(rawimage.chunks_of_files(images, width)).select(columns).collect(), key=key)
    assert got == want
    assert [(r.start, r.length) for r in got if r.desc == "Linux (0x83)"] == [(5210, 100), (5410, 90)]
    assert {r.image_id for r in got} == {"a", "b"}


def test_raw_image_source(spark, tmp_path):
    data = bytes(range(256)) * 20
    (tmp_path / "b.img").write_bytes(data)
    rows = rawimage.read(spark, str(tmp_path / "b.img"), 1000, 50).orderBy("chunk_no").collect()
    assert b"".join(bytes(r.bytes)[: r.len] for r in rows) == data
    assert len(rows[0].bytes) == 1050 and rows[-1].len == 120


def test_gpt():
    head = bytearray(64 * 512)
    struct.pack_into("<B3xB3xII", head, 446, 0, 0xEE, 1, 1000)
    head[510:512] = b"\x55\xaa"
    head[512:520] = b"EFI PART"
    struct.pack_into("<QII", head, 512 + 72, 2, 4, 128)
    head[1024:1040] = b"x" * 16
    struct.pack_into("<QQ", head, 1024 + 32, 100, 199)
    head[1024 + 56 : 1024 + 62] = "abc".encode("utf-16-le")
    assert ("abc", 100, 100, True) in [r[1:] for r in rawimage.volume_table(bytes(head), 300)]
    assert rawimage.volume_table(bytes(4096), 8) == []


def hive():
    """A root with one subkey that has a default and a number value."""
    cells, at = bytearray(), 32

    def put(body):
        nonlocal at
        size = -(-(len(body) + 4) // 8) * 8
        place = at
        cells.extend(struct.pack("<i", -size) + body.ljust(size - 4, b"\0"))
        at += size
        return place

    def nk(name, subkeys, n, values, k):
        return b"nk" + struct.pack("<HQIIIIIIIII", 0x20, 133_500_000_000_000_000, 0, 0, n, 0, subkeys, 0xFFFFFFFF, k, values, 0) + bytes(24) + struct.pack("<HH", len(name), 0) + name

    text = put("hi\0".encode("utf-16-le"))
    v1 = put(b"vk" + struct.pack("<HIIIHH", 0, 6, text, 1, 0, 0))
    v2 = put(b"vk" + struct.pack("<HIIIHH", 3, 0x80000004, 42, 4, 1, 0) + b"num")
    values = put(struct.pack("<II", v1, v2))
    child = put(nk(b"Child", 0xFFFFFFFF, 0, values, 2))
    keys = put(b"lf" + struct.pack("<HI4s", 1, child, b"Chil"))
    root = put(nk(b"ROOT", keys, 1, 0xFFFFFFFF, 0))
    return (b"regf" + bytes(32) + struct.pack("<I", root)).ljust(4096, b"\0") + b"hbin".ljust(32, b"\0") + bytes(cells)


def test_hive(spark):
    df = spark.createDataFrame([("SOFTWARE", hive())], "path string, content binary")
    rows = [(r.path, r.value_name, r.value_type, r.value) for r in regf.tree(df).collect()]
    assert rows == [("ROOT", None, None, None), ("ROOT\\Child", None, None, None), ("ROOT\\Child", "(default)", "RegSZ", "hi"), ("ROOT\\Child", "num", "RegDWord", "42")]
    with pytest.raises(ValueError):
        regf.Hive(b"no hive at all")
    cut = bytearray(hive())
    at = cut.index(b"vk") + 8  # where the first value's data lies
    cut[at : at + 4] = struct.pack("<I", 1 << 20)
    df = spark.createDataFrame([("good", hive()), ("bad", b"no hive at all"), ("none", None), ("cut", bytes(cut))], "path string, content binary")
    tree = regf.tree(df)
    assert {r.hive: r.problem for r in registry.problems(tree).collect()} == {"bad": "no registry hive", "none": "no registry hive", "cut": "a cell lies outside the hive"}
    keys, values = registry.split_tree(tree)
    assert sorted((r.hive, r.path) for r in keys.collect()) == [("cut", "ROOT"), ("good", "ROOT"), ("good", "ROOT\\Child")]
    assert sorted((r.hive, r.name) for r in values.collect()) == [("good", "(default)"), ("good", "num")]


def segment(data, chunk=1024):
    out = bytearray(ewf.SIGNATURE + b"\1\1\0\0\0")

    def section(kind, body, last=False):
        at = len(out)
        out.extend(struct.pack("<16sQQ", kind, at if last else at + 76 + len(body), 76 + len(body)).ljust(76, b"\0") + body)

    section(b"volume", struct.pack("<IIIIQ", 1, -(-len(data) // chunk), chunk // 512, 512, len(data) // 512).ljust(1052, b"\0"))
    base = len(out) + 76
    packed = [zlib.compress(data[k : k + chunk]) if (k // chunk) % 2 else data[k : k + chunk] + b"sum4" for k in range(0, len(data), chunk)]
    section(b"sectors", b"".join(packed))
    offsets, at = [], 0
    for k, p in enumerate(packed):
        offsets.append(at | (0x80000000 if k % 2 else 0))
        at += len(p)
    section(b"table", struct.pack("<I4xQ8x", len(packed), base) + struct.pack(f"<{len(packed)}I", *offsets) + b"sum4")
    section(b"hash", hashlib.md5(data).digest().ljust(36, b"\0"))
    section(b"done", b"", last=True)
    return bytes(out)


def test_ewf(spark):
    data = bytes(range(256)) * 40
    image = ewf.Image([segment(data)])
    assert image.size == len(data) and image.read(0, len(data)) == data and image.read(1000, 3000) == data[1000:4000] and image.md5 == hashlib.md5(data).hexdigest()
    df = spark.createDataFrame([("e", [segment(data)])], "image_id string, segments array<binary>")
    rows = ewf.media(df, 4096).orderBy("offset").collect()
    assert b"".join(bytes(r.bytes) for r in rows) == data and rows[0].stored_md5 == image.md5
    cut = segment(data)
    at = cut.rindex(zlib.compress(data[:1024]))  # the tenth chunk
    df = spark.createDataFrame([("e", [segment(data)]), ("bad", [b"no segment"]), ("none", None), ("cut", [cut[:at] + b"\xff" * 20 + cut[at + 20 :]])], "image_id string, segments array<binary>")
    got = ewf.media(df, 4096).collect()
    assert sorted(r.image_id for r in got if r.problem is not None) == ["bad", "cut", "none"]
    assert [(r.offset, r.len) for r in got if r.image_id == "cut" and r.problem is None] == [(0, 4096), (4096, 4096)]
    assert b"".join(bytes(r.bytes) for r in sorted((r for r in got if r.image_id == "e"), key=lambda r: r.offset)) == data


def test_export(spark, tmp_path):
    df = spark.createDataFrame([("a/b.txt", b"one"), ("../c", b"two")], "name string, content binary")
    got = export.write_contents(df, str(tmp_path / "out")).collect()
    assert sorted(r.size for r in got) == [3, 3]
    assert (tmp_path / "out/a/b.txt").read_bytes() == b"one" and (tmp_path / "out/c").read_bytes() == b"two"
    export.write_lines(df, str(tmp_path / "lines"), "name", "name", header="Name")
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "lines")).collect()) == ["../c", "Name", "a/b.txt"]
    z = df.select(export.zipped("name", "content").alias("z")).first().z
    assert zipfile.ZipFile(BytesIO(z)).read("a/b.txt") == b"one"


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, 60.0 * (k % 3), f"2024-01-01 0{k % 3}:10:00") for k in range(9)], "user long, ts double, at string").selectExpr("user % 2 user", "ts", "cast(at as timestamp) at")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = counts.period_counts(stream, "at").writeStream.format("memory").queryName("evidra_counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("evidra_counts").collect()) == [3, 3, 3]
    q = counts.rate_limited(stream.select("user", "ts")).writeStream.format("memory").queryName("evidra_limits").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("evidra_limits").count() == 9


def test_files_of_small_images_share_batches(spark):
    """Recovered files come in few batches, whole and apart: a batch for each image costs more than the search."""
    png_, gif_ = files()["png"], files()["gif"]
    chunks = spark.createDataFrame([(f"i{k}", 1000 * k, len(png_) + len(gif_) + 1, png_ + b"\x11" + gif_) for k in range(5000)], "image_id string, offset long, len long, bytes binary").coalesce(1)

    class Columns:
        def __init__(self, df):
            self.df = df

        def select(self, *columns):
            self.rows = self.df.select(*columns)
            return self

        def mapInArrow(self, run, schema):
            return list(run(self.rows.toArrow().to_batches(1000)))

    got = carve.carve(Columns(chunks))
    assert len(got) == 5
    rows = [r for b in got for r in b.to_pylist()]
    assert sorted((r["image_id"], r["offset"], r["content"]) for r in rows) == sorted(x for k in range(5000) for x in ((f"i{k}", 1000 * k, png_), (f"i{k}", 1000 * k + len(png_) + 1, gif_)))


def test_names_are_read_again_where_they_say(spark):
    """Names in chunks of several sizes, into an overlap, in chunks of one offset, twice the same name, and names that say no place."""
    chunks = [("a", 0, 10, b"0123456789abcd"), ("a", 10, 4, b"abcd"), ("b", 100, 2, b"xy"), ("b", 100, 4, b"uvwz"), ("c", 0, 1000, bytes(range(250)) * 4)]
    names = [("a", "8.gif", 4, "gif"), ("a", "b.png", 2, "png"), ("a", "b.png", 2, "png"), ("a", "e.png", 2, "png"), ("b", "64.bmp", 2, "bmp"), ("b", "67.bmp", 1, "bmp"), ("c", "3e6.zip", 2, "zip"), ("c", "readme", 3, "txt"), ("d", "0.gif", 1, "gif")]
    got = carve.reread(spark.createDataFrame(names, "image_id string, name string, size long, type string"), spark.createDataFrame(chunks, "image_id string, offset long, len long, bytes binary"))
    want = [(i, n, size, k, data[at - o : at - o + size]) for i, n, size, k in names if "." in n for at in [int(n.split(".")[0], 16)] for j, o, own, data in chunks if i == j and o <= at < o + own]
    assert sorted((r.image_id, r.name, r.size, r.type, bytes(r.content)) for r in got.collect()) == sorted(want) and len(want) == 7


def test_carved_reread_carves_once(spark, sf_dir):
    from evidra import catalog

    plan = catalog.QUERIES["carved_reread"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # the list of files was written when they were carved
