"""Operators on small tables, against plain code."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evidra.operators import history, paging, registry, search, space, timeline, verify
from evidra.sources import bodyfile, export


def test_overlaps_and_islands(spark):
    rnd = random.Random(4)
    intervals = [("d", a := rnd.randrange(5000), a + rnd.choice([1, 10, 300, 2000])) for _ in range(60)] + [("d", 0, 1000), ("d", 10, 20), ("d", 30, 40)]
    chunks = [("d", k * 64, 64) for k in range(120)]
    iv = spark.createDataFrame(intervals, "image_id string, start long, end long")
    ch = spark.createDataFrame(chunks, "image_id string, offset long, len long")
    want = sorted(o for _, o, n in chunks if not any(o < e and o + n > s for _, s, e in intervals))
    assert sorted(r.offset for r in space.free_chunks(ch, iv, 64).collect()) == want
    assert sorted(r.offset for r in space.free_chunks(ch, iv, 1000).collect()) == want
    covered = sorted({x for _, s, e in intervals for x in range(s, e)})
    got = [(r.start, r.end) for r in space.islands(iv, "image_id").orderBy("start").collect()]
    assert [x for s, e in got for x in range(s, e)] == covered
    assert all(b[0] > a[1] for a, b in zip(got, got[1:], strict=False))


def test_wholly_free_and_empty(spark):
    none = spark.createDataFrame([], "image_id string, start long, end long")
    ch = spark.createDataFrame([("d", 0, 10)], "image_id string, offset long, len long")
    assert space.free_chunks(ch, none, 10).count() == 1
    totals = spark.createDataFrame([("d", 100)], "image_id string, total_size long")
    v = spark.createDataFrame([], "image_id string, addr int, length long, fs_type string")
    assert [tuple(r) for r in space.space_allocation(v, totals).collect()] == [("d", None, "Entire Disk", 100, 100.0)]


def test_sector_read_is_whole(spark):
    data = bytes(range(256)) * 8
    ch = spark.createDataFrame([("d", k * 700, len(data[k * 700 : k * 700 + 700]), data[k * 700 : k * 700 + 700]) for k in range(3)], "image_id string, offset long, len long, bytes binary")
    first, last = 1, 2
    got = b"".join(bytes(r.bytes) for r in space.read_range(ch, 512 * first, 512 * (last - first + 1)).orderBy("offset").collect())
    assert got == data[512:1536]


BODY = ["# comment", "", "0|/a|5|r/rrw|0|0|10|100|100|200|100", "0|/b%20c+d|6|r/rrw|1|9|11|0|50|-5|0", "0|/z|7|r/rrw|0|0|1|0|0|0|0", "0|/bad|x|r|q|0|1|1|1|1|1", "0|/a|8|d/drw|2|0|99|300|300|300|300"]


def test_timeline(spark):
    lines = spark.createDataFrame(list(enumerate(BODY)), "row_no long, value string")
    body = bodyfile.parse(lines)
    got = {(r.ts, r.inode, r.file): r.macb for r in timeline.events(body).collect()}
    assert got == {(100, "5", "/a"): "ma.b", (200, "5", "/a"): "..c.", (0, "6", "/b c+d"): ".a.b", (50, "6", "/b c+d"): "m...", (300, "8", "/a"): "macb"}
    users = timeline.names_by_id(spark.createDataFrame([(0, "root:x:0"), (1, "toor:x:0"), (2, "+nis:x:1"), (3, "ann:x:2")], "row_no long, value string"))
    rows = {r.inode: r for r in timeline.timeline(body, users=users).filter("ts = 100 or ts = 300").collect()}
    assert (rows["5"].mode, rows["5"].uid, rows["5"].size) == ("d/drw", "ann", 99)  # the last row of a name wins
    assert {r.id: r.names for r in users.collect()} == {"0": "root toor", "2": "ann"}
    text = [r.line for r in timeline.csv_lines(timeline.timeline(body), "iso").orderBy("ts").collect()]
    assert text[0] == '0000-00-00T00:00:00Z,11,.a.b,r/rrw,1,9,6,"/b c+d"'
    aligned = [r.line for r in timeline.aligned_lines(timeline.timeline(body)).orderBy("ts", "inode", "file").collect()]
    assert aligned[1].startswith("Thu Jan 01 1970 00:00:50")
    assert {(str(r.period), r.n) for r in timeline.counts(timeline.events(body).filter("ts > 0")).collect()} == {("1970-01-01 00:00:00", 4)}
    assert timeline.counts(timeline.events(body)).count() == 0  # its first event is at time 0
    assert timeline.iso_range("2024-01-01..2024-01-02T00:00:01") == (1704067200, 1704153601)
    with pytest.raises(ValueError):
        timeline.iso_range("yesterday")


def test_limiter_vector():
    limiter = history.Limiter()
    assert [limiter.ask(t) for t in (1000, 1010, 1020, 1030, 1079, 1081)] == [True, True, True, False, False, True]


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from(["visit", "back", "forward"]), max_size=30))
def test_history_against_two_stacks(steps):
    h, past, ahead, here = history.History(), [], [], None
    for k, s in enumerate(steps):
        if s == "visit":
            past, ahead, here = past + ([here] if here is not None else []), [], str(k)
        elif s == "back" and past:
            ahead, here, past = [here, *ahead], past[-1], past[:-1]
        elif s == "forward" and ahead:
            past, here, ahead = [*past, here], ahead[0], ahead[1:]
        assert h.step(s, str(k)) == here


def test_limit_of_a_day():
    limiter = history.Limiter()
    got = [limiter.ask(60 * k) for k in range(700)]
    assert sum(got) == 500 and got[:500] == [True] * 500
    assert limiter.ask(86400 + 1)


def test_search_kinds(spark):
    rows = [("d", 0, k, 0, n, f"/{n}", d) for k, (n, d) in enumerate([("a.txt", False), ("TXT", True), (".", True), ("b.TXT.bak", False)])]
    e = spark.createDataFrame(rows, "image_id string, start_offset long, inode long, parent_inode long, name string, path string, is_directory boolean")
    names = lambda df: sorted(r.name for r in df.collect())
    assert names(search.search(e, "txt")) == ["TXT", "a.txt", "b.TXT.bak"]
    assert names(search.search(e, ".TXT")) == ["a.txt"]
    assert names(search.search(e, "*.txt*")) == ["a.txt", "b.TXT.bak"]
    assert names(search.search(e, "  ")) == ["TXT", "a.txt", "b.TXT.bak"]
    assert names(search.with_extensions(e, [".txt"])) == [".", "TXT", "a.txt"]
    v = spark.createDataFrame([("d", 1, 0, False), ("x", 1, 8, True)], "image_id string, addr int, start long, is_alloc boolean")
    assert search.on_allocated_volumes(e, v).count() == 0
    assert search.on_allocated_volumes(e, v.filter("image_id = 'x'")).count() == 4


def test_verify(spark):
    df = spark.createDataFrame([("a", b"x" * 10), ("b", b"")], "name string, content binary")
    got = {r.name: r for r in verify.file_digests(df).collect()}
    assert got["b"].md5 == "d41d8cd98f00b204e9800998ecf8427e"
    import hashlib

    chunks = spark.createDataFrame([("i", 5, b"world"), ("i", 0, b"hello"), ("j", 0, b"")], "image_id string, offset long, bytes binary")
    got = {r.image_id: r for r in verify.image_digests(chunks).collect()}
    assert got["i"].sha256 == hashlib.sha256(b"helloworld").hexdigest() and got["i"].size == 10


def test_registry_tables(spark):
    keys = spark.createDataFrame([("R", None, "R", None), ("R\\a", "R", "a", None)], "path string, parent string, name string, ts timestamp")
    values = spark.createDataFrame([("R\\a", "v", "RegSZ", "1"), ("R", "w", "RegSZ", "2")], "path string, name string, type string, value string")
    meta = {r.path: (r.n_subkeys, r.n_values) for r in registry.key_metadata(keys, values).collect()}
    assert meta == {"R": (1, 1), "R\\a": (0, 1)}
    assert sorted((r.path, r.kind) for r in registry.listing(keys, values).collect()) == [("R", "key"), ("R\\a", "key"), ("R\\a\\v", "value")]
    assert [tuple(r) for r in registry.value_table(values, "R").collect()] == [("w", "RegSZ", "2")]
    v = spark.createDataFrame([("h", "X\\Microsoft\\Windows NT\\CurrentVersion", "ProductName", "Windows 10")], "hive string, path string, name string, value string")
    row = registry.windows_version(v).first()
    assert row.ProductName == "Windows 10" and row.CurrentBuild == "N/A"
    assert row.summary == "Windows 10 Version N/A\nBuild N/A N/A\nOwner: N/A\nProduct ID: N/A"


def test_known_hashes(spark):
    rows = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "name string, md5 string")
    known = spark.createDataFrame([("1",), ("1",)], "md5 string")
    assert [r.name for r in verify.known(rows, known).collect()] == ["a"]
    assert sorted(r.name for r in verify.known(rows, known, flagged=False).collect()) == ["b", "c"]


def test_scalar_defaults_of_reports(spark):
    from evidra.operators import reports

    df = spark.createDataFrame([('{"md5":"m","positives":3,"total":9}',), ("{}",)], "report string")
    got = sorted((r.md5, r.score) for r in reports.scan_summary(df).collect())
    assert got == [("N/A", "0/0"), ("m", "3/9")]
    up = spark.createDataFrame([('{"data":{"id":"q","attributes":{"sha256":"s","date":5}}}',)], "report string")
    assert tuple(reports.upload_receipt(up).select("id", "sha256", "date").first()) == ("q", "s", "5")
    assert F is not None


def test_rows_with_equal_keys_are_searched_apart(spark):
    rows = spark.createDataFrame([(1, bytearray(b"banana ana")), (1, bytearray(b"xana")), (2, None), (3, bytearray(b""))], "k long, content binary")
    got = sorted((r.k, r.position) for r in paging.byte_lines(rows, "k", b"ana").collect())
    assert got == [(1, 1), (1, 1), (1, 3), (1, 7)]
    assert sorted((r.k, r.position) for r in paging.byte_lines(rows, "k", b"ana", overlapping=False).collect()) == [(1, 1), (1, 1), (1, 7)]
    plan = paging.byte_lines(rows, "k", b"ana")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        paging.byte_lines(rows, "k", b"")


@pytest.mark.parametrize("width", [7, 50, 10_000])
def test_islands_over_buckets(spark, width):
    """Intervals of one key that span buckets, against a plain sweep."""
    rnd = random.Random(4)
    rows = [(k % 2, a, a + rnd.choice([1, 3, 40, 200])) for k in range(300) for a in [rnd.randrange(5000)]]
    want = set()
    for key in (0, 1):
        lo = hi = None
        for _, a, b in sorted(r for r in rows if r[0] == key):
            if hi is None or a > hi:
                if hi is not None:
                    want.add((key, lo, hi))
                lo, hi = a, b
            hi = max(hi, b)
        want.add((key, lo, hi))
    df = spark.createDataFrame(rows, "k long, start long, end long")
    assert {(r.k, r.start, r.end) for r in space.islands(df, "k", width=width).collect()} == want


def test_chunks_of_one_offset_stay_apart(spark):
    chunks = spark.createDataFrame([("d", 0, 10), ("d", 0, 100), ("d", 300, 10)], "image_id string, offset long, len long")
    taken = spark.createDataFrame([("d", 50, 60), ("d", 55, 58), ("d", 200, 290)], "image_id string, start long, end long")
    assert {(r.offset, r.len) for r in space.free_chunks(chunks, taken, 32).collect()} == {(0, 10), (300, 10)}


def test_timeline_reads_its_body_once(spark, sf_dir):
    from evidra.catalog import QUERIES

    plan = QUERIES["timeline_attributes"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 2  # orders and their lines


def test_time_zones():
    assert timeline.zone("Asia/Tokyo") == "Asia/Tokyo"
    with pytest.raises(ValueError):
        timeline.zone("Nowhere/Here")


def test_raw_copies_and_progress(spark, tmp_path):
    data = bytes(range(256)) * 40
    chunks = spark.createDataFrame([("/x/disk.e01", a, 1000, bytearray(data[a : a + 1100])) for a in range(0, 10_000, 1000)] + [("/x/disk.e01", 10_000, 240, bytearray(data[10_000:]))], "image_id string, offset long, len int, bytes binary")
    rows, seen = verify.observed(export.raw_copy(chunks.repartition(4), str(tmp_path)), "size")
    assert {r.path for r in rows.collect()} == {str(tmp_path / "disk.dd")}
    assert (tmp_path / "disk.dd").read_bytes() == data and seen.get == {"rows": 11, "bytes": len(data)}


def test_walk_of_deep_trees_cycles_and_orphans(spark):
    """A chain deeper than a hundred levels, a wide directory, entries in themselves or below nothing, an inode twice."""
    up = {k: k - 1 for k in range(1, 151)} | {k: 7 for k in range(1000, 1300)} | {2000: 2001, 2001: 2002, 2002: 2000, 2003: 2000, 3001: 3000, 4000: 4000}
    rows = [("d", 0, k, p) for k, p in up.items()] + [("d", 0, 9, 3), ("d", 5, 7, 0), ("d", 0, 5000, None)]
    got = sorted((r.start_offset, r.inode, r.path, r.depth) for r in search.walk(spark.createDataFrame(rows, "image_id string, start_offset long, inode long, parent_inode long")).collect())
    want, level = [], [(o, k, f"/{k}", 1) for _, o, k, p in rows if p == 0]
    while level:
        want += level
        level = [(o, k, f"{path}/{k}", n + 1) for o, i, path, n in level for _, b, k, p in rows if (b, p) == (o, i)]
    assert got == sorted(want) and max(r[3] for r in got) == 150


def test_path_walk_of_more_than_a_million_rows(spark, tmp_path):
    from evidra import catalog

    spark.range(1_100_000).select(F.col("id").alias("p_partkey"), F.lit("p").alias("p_name")).write.parquet(str(tmp_path / "part.parquet"))
    got = catalog.QUERIES["path_walk"](spark, str(tmp_path))
    assert got.agg(F.count("*"), F.max("depth"), F.countDistinct("path")).first() == (1_099_999, 7, 1_099_999)
    assert got.filter("inode = 1099999").first().path == "/1/10/109/1099/10999/109999/1099999"


def test_hex_pages_are_those_of_lines_without_a_shuffle(spark, sf_dir):
    from evidra import catalog

    sizes = [0, 1, 15, 16, 17, 16 * 1024, 16 * 1024 + 1, 3 * 16 * 1024 - 5]
    data = [(n, bytes((7 * k + n) % 256 for k in range(n))) for n in sizes] + [(-1, None), (-2, b"<&>&amp;\n\r\\1\x00" * 999)] + [(10**6 + k, b"%d" % k) for k in range(3000)]
    df = spark.createDataFrame(data, "k long, content binary")
    pages, lines = export.hex_pages(df, "k"), export.hex_html(paging.hex_lines(df, "k"), "k")
    assert pages.schema.simpleString() == lines.schema.simpleString()
    got = sorted(map(tuple, pages.collect()))
    assert got == sorted(map(tuple, lines.collect())) and [(k, p) for k, p, _ in got if 16 < k < 10**6] == [(17, 0), (16384, 0), (16385, 0), (16385, 1), (49147, 0), (49147, 1), (49147, 2)]
    plan = catalog.QUERIES["hex_html"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_places_of_a_timeline(spark, sf_dir):
    """Places over many parts, with one time that most rows have, and of no rows; rows don't go through Python."""
    from evidra import catalog

    data = [(5 if k % 10 else k, str(k), f"/f/{k % 7}", "m...") for k in range(20_000)]
    rows = spark.createDataFrame(data, "ts long, inode string, file string, macb string")
    got = timeline.placed(rows.repartition(7))
    assert got.columns == ["place", "ts", "inode", "file", "macb"]
    assert sorted(map(tuple, got.collect())) == [(n, *r) for n, r in enumerate(sorted(data), 1)]
    assert timeline.placed(rows.filter("ts < 0")).collect() == []
    plan = catalog.QUERIES["timeline_order"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ExistingRDD" not in plan


def test_letters_of_rows_with_one_name(spark):
    """Times of several body rows of a file meet in one event, whose letters are those of all of them."""
    body = spark.createDataFrame([(1, "0", "/a", 7, "r", 0, 0, 1, 10, 20, 30, 40), (2, "0", "/a", 7, "r", 0, 0, 1, 20, 20, 20, 20), (3, "0", "/b", 7, "r", 0, 0, 1, 10, 10, 30, 0)], "row_no long, md5 string, file string, inode long, mode string, uid long, gid long, size long, atime long, mtime long, ctime long, crtime long")
    got = sorted(map(tuple, timeline.events(body).collect()))
    assert got == [(0, "7", "/b", "...b"), (10, "7", "/a", ".a.."), (10, "7", "/b", "ma.."), (20, "7", "/a", "macb"), (30, "7", "/a", "..c."), (30, "7", "/b", "..c."), (40, "7", "/a", "...b")]
