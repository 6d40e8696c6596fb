"""Registered queries of the library's own operators, each over whole tables, and their SQL.

The tables stand in for evidence (plans.evidence): documents are files, sources are volumes, orders and their
lines are file activity, pages are raw bytes to search, events are requests and a session's steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalar as S
from .functions import text as X
from .operators import carve, history, paging, registry, reports, search, space, timeline, verify
from .plans import evidence, samples
from .session import stored
from .sources import bodyfile, export, rawimage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


FILES = """files AS (SELECT 'vol' || substr(source, 4) AS vol, doc_id AS inode, 'doc_' || doc_id || '.' || lang AS name,
 'vol' || substr(source, 4) || ':/' || lang || '/doc_' || doc_id || '.' || lang AS path, lang, CAST(strlen(text) AS BIGINT) AS size, text FROM documents)"""


def _readable(n: str) -> str:
    units = "".join(f" WHEN {n} < {1024 ** (k + 1)} THEN printf('%.2f {u}', {n} / {1024**k}.0::DOUBLE)" for k, u in enumerate(["B", "KB", "MB", "GB", "TB"]))
    return f"CASE WHEN {n} IS NULL THEN '0 B'{units} ELSE printf('%.2f PB', {n} / {1024**5}.0::DOUBLE) END"


def _found(spark: SparkSession, sf_dir: str, query: str) -> DataFrame:
    return search.search(evidence.files(spark, sf_dir), query).select("inode", "name", "path", "size", S.readable_size(F.col("size")).alias("readable_size")).orderBy(F.desc("size"), "inode")


@_query(f"WITH {FILES} SELECT inode, name, path, size, {_readable('size')} AS readable_size FROM files WHERE contains(lower(name), 'oc_1') ORDER BY size DESC, inode")
def search_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that contain a text."""
    return _found(spark, sf_dir, "OC_1")


@_query(f"WITH {FILES} SELECT inode, name, path, size, {_readable('size')} AS readable_size FROM files WHERE lower(regexp_extract(name, '(\\.[^.]*)$', 1)) = '.fr'")
def search_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with an extension."""
    return _found(spark, sf_dir, ".FR")


@_query(f"WITH {FILES} SELECT inode, name, path, size, {_readable('size')} AS readable_size FROM files WHERE regexp_matches(name, '^doc_.7.*\\.e.$', 'i')")
def search_wildcard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """names that fit a wildcard."""
    return _found(spark, sf_dir, "DOC_?7*.e?")


@_query(f"WITH {FILES} SELECT inode, name FROM files WHERE lang IN ('de', 'es')")
def search_extension_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files with one of some extensions."""
    return search.with_extensions(evidence.files(spark, sf_dir).withColumn("is_directory", F.lit(False)), [".de", ".ES"]).select("inode", "name")


@_query(f"WITH {FILES} SELECT vol, count(*) AS results FROM files WHERE contains(lower(name), '.e') GROUP BY vol")
def search_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of a search by volume."""
    return search.search(evidence.files(spark, sf_dir), "*.e*").groupBy("vol").agg(F.count("*").alias("results"))


@_query(f"WITH {FILES} SELECT inode, size * size * size AS size, {_readable('(size * size * size)')} AS readable_size FROM files")
def readable_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1 over sizes of every unit up to petabytes."""
    n = F.col("size") * F.col("size") * F.col("size")
    return evidence.files(spark, sf_dir).select("inode", n.alias("size"), S.readable_size(n).alias("readable_size"))


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN 'N/A' ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || ' UTC' END AS shown, strftime(make_timestamp((o_orderkey % 100) * 1000000), '%M:%S') AS clock FROM orders""")
def shown_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as text, 0 as N/A; milliseconds as a clock."""
    seconds = F.when(F.col("o_orderkey") % 7 == 0, F.lit(0)).otherwise(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")))
    return evidence.table(spark, sf_dir, "orders").select("o_orderkey", S.epoch_text(seconds).alias("shown"), S.clock((F.col("o_orderkey") % 100) * 1000).alias("clock"))


NAMES = "CASE CAST(doc_id % 6 AS INTEGER) WHEN 0 THEN 'Photo' || doc_id || '.JPG' WHEN 1 THEN '.rc' || doc_id WHEN 2 THEN 'a' || doc_id || '.tar.GZ' WHEN 3 THEN 'noext' || doc_id WHEN 4 THEN '..x' || doc_id || '.y' ELSE 'a' || doc_id || '.' END"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.table(spark, sf_dir, "documents").select("doc_id", F.expr(NAMES).alias("name"))


@_query(f"""WITH n AS (SELECT doc_id, {NAMES} AS name FROM documents)
SELECT doc_id, name, CASE CAST(doc_id % 6 AS INTEGER) WHEN 0 THEN '.jpg' WHEN 1 THEN '' WHEN 2 THEN '.gz' WHEN 3 THEN '' WHEN 4 THEN '.y' ELSE '.' END AS ext,
CASE CAST(doc_id % 6 AS INTEGER) WHEN 0 THEN 'jpg' WHEN 1 THEN 'rc' || doc_id WHEN 2 THEN 'gz' WHEN 3 THEN 'unknown' WHEN 4 THEN 'y' ELSE '' END AS icon_ext FROM n""")
def name_extensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions as a listing and as an icon table have them."""
    return _names(spark, sf_dir).select("doc_id", "name", S.extension(F.col("name")).alias("ext"), S.icon_extension(F.col("name")).alias("icon_ext"))


@_query("""SELECT page_id, regexp_replace(url, '/[^/]*$', '') AS parent, 'vol0:/' || regexp_extract(url, '[^/]*$') AS joined FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents of paths, and paths put together."""
    return evidence.table(spark, sf_dir, "pages").select("page_id", S.dirname(F.col("url")).alias("parent"), S.join_path(F.lit("vol0:"), F.substring_index("url", "/", -1)).alias("joined"))


ICONS = "('file', 'gif', 'i/gif'), ('file', 'jpg', 'i/jpg'), ('file', 'gz', 'i/zip'), ('file', 'generic', 'i/file'), ('folder', 'folder', 'i/folder')"


@_query(f"""WITH n AS (SELECT doc_id, {NAMES} AS name, CASE WHEN doc_id % 11 = 0 THEN 'folder' WHEN doc_id % 11 = 1 THEN 'socket' ELSE 'file' END AS type FROM documents),
e AS (SELECT doc_id, type, CASE WHEN contains(name, '.') THEN lower(split_part(name, '.', -1)) ELSE 'unknown' END AS ext FROM n),
i(type, extension, path) AS (VALUES {ICONS})
SELECT doc_id, e.type, e.ext, coalesce(a.path, b.path, 'i/default') AS icon FROM e LEFT JOIN i a ON a.type = e.type AND a.extension = e.ext
LEFT JOIN i b ON b.type = e.type AND b.extension = CASE WHEN b.type = 'folder' THEN 'folder' ELSE 'generic' END""")
def icon_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Icons by type and extension, with two fallbacks."""
    rows = _names(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 11 == 0, "folder").when(F.col("doc_id") % 11 == 1, "socket").otherwise("file").alias("type"), S.icon_extension(F.col("name")).alias("ext"))
    icons = spark.sql(f"SELECT * FROM VALUES {ICONS} AS t(type, extension, path)")
    return search.resolve_icons(rows, icons, "type", "ext", "i/default").select("doc_id", "type", "ext", "icon")


VOLUMES = """v0 AS (SELECT CAST(substr(source, 4) AS INTEGER) AS addr, CAST(sum(strlen(text)) AS BIGINT) AS size FROM documents GROUP BY 1),
v1 AS (SELECT addr, size, CAST((size + 511) // 512 AS BIGINT) AS length FROM v0),
v AS (SELECT addr, size, length, CAST(sum(length) OVER (ORDER BY addr) - length + 2048 AS BIGINT) AS start FROM v1)"""


@_query(f"""WITH {VOLUMES} SELECT addr, start, length, start + length - 1 AS "end", length * 512 AS size, length // 8 * 4096 AS volume_size, CAST(0 AS BIGINT) AS first_block, length // 8 - 1 AS last_block,
'vol' || addr || ' (part: ' || start || '-' || (start + length - 1) || ', Size: ' || {_readable("(length * 512)")} || ', FS: ' || (CASE WHEN addr % 3 = 0 THEN 'NTFS' WHEN addr % 3 = 1 THEN 'Unknown' ELSE 'N/A' END) || ')' AS label,
trim(format('{{:,}}', length * 512)) AS bytes FROM v""")
def volumes_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geometry and labels of volumes."""
    v = evidence.volumes(spark, sf_dir).select("addr", "start", "length", F.lit(4096).cast("long").alias("block_size"), F.floor(F.col("length") / 8).cast("long").alias("block_count"))
    v = space.volume_stats(v)
    fs = S.fs_name(F.when(F.col("addr") % 3 == 0, F.lit("NTFS")).when(F.col("addr") % 3 == 1, F.lit("zfs")))
    return v.select("addr", "start", "length", "end", "size", "volume_size", "first_block", "last_block", S.volume_label(F.col("addr"), F.lit("part"), F.col("start"), F.col("end"), F.col("size"), fs).alias("label"), S.thousands(F.col("size")).alias("bytes"))


@_query(f"""WITH {VOLUMES}, t AS (SELECT sum(length) * 512 + 5000000 AS total FROM v),
p AS (SELECT CAST(addr AS BIGINT) AS addr, 'NTFS' AS fs_type, length * 512 AS size FROM v UNION ALL SELECT NULL, 'Unallocated Space', total - (SELECT sum(length) * 512 FROM v) FROM t)
SELECT addr, fs_type, CAST(size AS BIGINT) AS size, CAST(size AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS percentage FROM p, t""")
def space_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2: shares of an image's space, and what is left."""
    v = evidence.volumes(spark, sf_dir).select(F.lit("disk").alias("image_id"), "addr", "length", F.lit("NTFS").alias("fs_type"))
    totals = v.groupBy("image_id").agg((F.sum("length") * 512 + 5000000).alias("total_size"))
    return space.space_allocation(v, totals).drop("image_id")


@_query(f"WITH {VOLUMES} SELECT 'disk' AS image_id, CAST(sum(size) AS BIGINT) AS size, CAST(sum(size) // 512 AS BIGINT) AS sectors, count(*) AS partitions, 'partitioned' AS status FROM v")
def image_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size, sectors, partitions and status of an image."""
    v = evidence.volumes(spark, sf_dir).withColumn("image_id", F.lit("disk"))
    images = v.groupBy("image_id").agg(F.sum("size").alias("size")).withColumn("has_fs", F.lit(False))
    return space.image_summary(images, v)


@_query("""SELECT c_custkey, d AS "desc", CASE WHEN contains(d, 'Primary Table') OR contains(d, 'Safety Table') OR contains(d, 'GPT Header') THEN 'special' WHEN contains(d, 'Unallocated') OR contains(d, 'Microsoft reserved') THEN 'unallocated' ELSE 'normal' END AS class
FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'GPT Header' WHEN 1 THEN 'Unallocated' WHEN 2 THEN 'Microsoft reserved partition' WHEN 3 THEN 'Primary Table (#0)' ELSE c_mktsegment END AS d FROM customer)""")
def partition_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """partitions by their descriptions."""
    d = F.expr("CASE c_custkey % 5 WHEN 0 THEN 'GPT Header' WHEN 1 THEN 'Unallocated' WHEN 2 THEN 'Microsoft reserved partition' WHEN 3 THEN 'Primary Table (#0)' ELSE c_mktsegment END")
    return evidence.table(spark, sf_dir, "customer").select("c_custkey", d.alias("desc")).withColumn("class", search.volume_class(F.col("desc")))


@_query(f"""WITH {FILES}, {VOLUMES} SELECT inode, coalesce('vol' || addr, 'vol0') || ':/' || name AS path FROM (SELECT inode, name, CASE WHEN inode % 9 = 0 THEN -1 ELSE start END AS at FROM files JOIN v ON vol = 'vol' || addr) f LEFT JOIN v w ON w.start = f.at""")
def volume_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with the volume that starts at an entry's offset, vol0 where none does."""
    v = evidence.volumes(spark, sf_dir).select(F.lit("disk").alias("image_id"), "addr", "start")
    at = F.when(F.col("inode") % 9 == 0, F.lit(-1)).otherwise(F.col("start")).alias("start_offset")
    entries = evidence.files(spark, sf_dir).join(v.select(F.concat(F.lit("vol"), F.col("addr").cast("string")).alias("vol"), "start"), "vol").select(F.lit("disk").alias("image_id"), "inode", at, F.concat(F.lit("/"), "name").alias("path"))
    return search.with_volume_path(entries, v).select("inode", "path")


ALLOCATED = "SELECT vol AS image_id, 512 * 2048 + inode * 1024 AS start, 512 * 2048 + inode * 1024 + size AS \"end\" FROM files WHERE inode % 4 <> 0 AND size > 0"


def _allocated(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = evidence.files(spark, sf_dir).select(F.col("vol").alias("image_id"), "inode", "size", F.lit(2048).cast("long").alias("start_offset"), (F.col("inode") % 4 != 0).alias("is_allocated"))
    return space.allocated_intervals(entries, F.lit(1024))


@_query(f"WITH {FILES} {ALLOCATED}")
def allocated_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3, F8: places of allocated files, estimated."""
    return _allocated(spark, sf_dir)


@_query(f"""WITH {FILES}, a AS ({ALLOCATED}), m AS (SELECT *, max("end") OVER (PARTITION BY image_id ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM a),
n AS (SELECT *, sum(CASE WHEN r IS NULL OR start > r THEN 1 ELSE 0 END) OVER (PARTITION BY image_id ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT image_id, min(start) AS start, max("end") AS "end" FROM n GROUP BY image_id, k""")
def alloc_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The union of allocated places."""
    return space.islands(_allocated(spark, sf_dir), "image_id")


@_query(f"""WITH {FILES}, a AS ({ALLOCATED}), c AS (SELECT image_id, 1048576 + k * 8192 AS "offset" FROM (SELECT image_id, max("end") AS top FROM a GROUP BY 1) x, unnest(range(0, CAST((top - 1048576) // 8192 AS BIGINT) + 9)) AS t(k))
SELECT image_id, "offset", CAST(8192 AS BIGINT) AS len FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.image_id = c.image_id AND c."offset" < a."end" AND c."offset" + 8192 > a.start)""")
def alloc_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that no allocated place overlaps, by a bucketed equi-join."""
    own = _allocated(spark, sf_dir)
    top = own.groupBy("image_id").agg(F.max("end").alias("top"))  # an image reaches eight chunks beyond its last file
    last = F.lit(1048576) + (F.floor((F.col("top") - 1048576) / 8192) + 8) * 8192
    chunks = top.select("image_id", F.explode(F.sequence(F.lit(1048576).cast("long"), last.cast("long"), F.lit(8192).cast("long"))).alias("offset"), F.lit(8192).cast("long").alias("len"))
    return space.free_chunks(chunks, own, 1 << 20)


@_query("SELECT doc_id, array_to_string(regexp_extract_all(text, '[ -~]{4,}'), chr(10)) AS strings FROM documents")
def printable_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of printable ASCII."""
    return evidence.files(spark, sf_dir).select(F.col("inode").alias("doc_id"), X.printable_strings(F.col("content")).alias("strings"))


@_query("""WITH l AS (SELECT doc_id, encode(text) AS b, CAST(k AS BIGINT) AS line_no FROM documents, unnest(range(0, (strlen(text) + 15) // 16)) AS t(k)),
c AS (SELECT doc_id, line_no, hex(b[line_no * 16 + 1:line_no * 16 + 16]) AS h FROM l)
SELECT doc_id, line_no // 1024 AS page, line_no, printf('0x%08x: ', line_no * 16) || rpad(rtrim(regexp_replace(h, '(..)', '\\1 ', 'g')), 48, ' ') || '  ' ||
array_to_string(list_transform(range(1, length(h), 2), lambda i: CASE WHEN substr(h, i, 2) BETWEEN '20' AND '7E' THEN chr(CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS INTEGER)) ELSE '.' END), '') AS line FROM c""")
def hex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hex lines of whole files."""
    return paging.hex_lines(evidence.files(spark, sf_dir).withColumnRenamed("inode", "doc_id"), "doc_id")


@_query("""WITH l AS (SELECT doc_id, encode(text) AS b, CAST(k AS BIGINT) AS line_no FROM documents, unnest(range(0, (strlen(text) + 15) // 16)) AS t(k)),
c AS (SELECT doc_id, line_no, hex(b[line_no * 16 + 1:line_no * 16 + 16]) AS h FROM l)
SELECT doc_id, line_no, printf('0x%08x', line_no * 16) AS address, rtrim(regexp_replace(h, '(..)', '\\1 ', 'g')) AS hex,
trim(array_to_string(list_transform(range(1, length(h), 2), lambda i: CASE WHEN substr(h, i, 2) BETWEEN '20' AND '7E' THEN chr(CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS INTEGER)) ELSE '.' END), '')) AS ascii FROM c""")
def hex_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All hex lines of whole files taken apart again."""
    lines = paging.hex_lines(evidence.files(spark, sf_dir).withColumnRenamed("inode", "doc_id"), "doc_id")
    return lines.select("doc_id", "line_no", X.parse_hex_line(F.col("line")).alias("p")).select("doc_id", "line_no", "p.address", "p.hex", "p.ascii")


@_query("""SELECT doc_id, CAST(k AS BIGINT) AS page, CAST((length(text) + 1999) // 2000 AS BIGINT) AS pages, substr(text, k * 2000 + 1, 2000) AS page_text FROM documents, unnest(range(0, (length(text) + 1999) // 2000)) AS t(k)""")
def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 2000 characters."""
    return paging.text_pages(evidence.table(spark, sf_dir, "documents"), "doc_id")


@_query("""WITH s AS (SELECT doc_id, string_split(text, 'the ') AS p FROM documents),
f AS (SELECT doc_id, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * 4 AS BIGINT) AS position FROM s, unnest(range(1, len(p))) AS t(k))
SELECT doc_id, position, position // 2000 AS page, position % 2000 AS "column" FROM f""")
def text_search_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a text that don't overlap."""
    return paging.text_positions(evidence.table(spark, sf_dir, "documents"), "doc_id", "the ")


@_query("""WITH s AS (SELECT doc_id, text, string_split(text, 'a') AS p FROM documents),
f AS (SELECT doc_id, text, CAST(list_sum(list_transform(p[1:k], lambda x: length(x))) + k - 1 AS INTEGER) AS c FROM s, unnest(range(1, len(p))) AS t(k) WHERE p[k + 1] = 'n' AND len(p) > k + 1)
SELECT doc_id, CAST(strlen(substr(text, 1, c)) AS BIGINT) AS position, CAST(strlen(substr(text, 1, c)) // 16 AS BIGINT) AS line_no FROM f""")
def hex_search_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and lines of a byte string, overlapping ones too."""
    return paging.byte_lines(evidence.files(spark, sf_dir).withColumnRenamed("inode", "doc_id"), "doc_id", b"ana")


@_query("""SELECT doc_id, text AS base64, text AS hex, text AS url, CAST(NULL AS VARCHAR) AS bad FROM documents""")
def decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts encoded and decoded; what isn't base64 decodes to null."""
    raw = F.encode("text", "UTF-8")
    return evidence.table(spark, sf_dir, "documents").select("doc_id", X.from_base64(F.translate(F.base64(raw), "\r\n", "")).alias("base64"), X.from_hex(F.hex(raw)).alias("hex"), X.from_url_strict(F.url_encode("text")).alias("url"), X.from_base64(F.concat(F.lit("!"), "text")).alias("bad"))


@_query("""SELECT doc_id, chr(CAST(97 + doc_id % 26 AS INTEGER)) || chr(CAST(97 + doc_id % 7 AS INTEGER)) AS octal, chr(CAST(97 + doc_id % 26 AS INTEGER)) || chr(CAST(97 + doc_id % 7 AS INTEGER)) AS "binary" FROM documents""")
def number_decoders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Octal and binary code points."""
    a, b = (F.lit(97) + F.col("doc_id") % k for k in (26, 7))
    text = lambda base: F.concat_ws(" ", F.conv(a.cast("string"), 10, base), F.conv(b.cast("string"), 10, base))
    return evidence.table(spark, sf_dir, "documents").select("doc_id", X.from_octal(text(8)).alias("octal"), X.from_binary(text(2)).alias("binary"))


@_query("SELECT doc_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of files."""
    return verify.file_digests(evidence.files(spark, sf_dir)).select(F.col("inode").alias("doc_id"), "md5", "sha1", "sha256", "size")


STORED = "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'x' || md5(text) ELSE upper(md5(text)) END AS stored_md5, CASE WHEN doc_id % 7 = 0 THEN sha1(text) END AS stored_sha1"


@_query(f"""SELECT doc_id, CASE WHEN lower(stored_md5) = md5(text) THEN 'Match' ELSE 'Mismatch' END AS md5_check, CASE WHEN stored_sha1 = sha1(text) THEN 'Match' ELSE 'Mismatch' END AS sha1_check,
coalesce(lower(stored_md5) = md5(text), false) OR coalesce(stored_sha1 = sha1(text), false) AS verified FROM (SELECT doc_id, text, {STORED} FROM documents)""")
def hash_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored digests against computed ones."""
    rows = evidence.table(spark, sf_dir, "documents").selectExpr("doc_id", "md5(text) AS md5", "sha1(text) AS sha1", *STORED.replace(", CASE WHEN doc_id % 7", "\nCASE WHEN doc_id % 7").split("\n"))
    return verify.compare(rows).select("doc_id", "md5_check", "sha1_check", "verified")


@_query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with equal digests."""
    return verify.duplicates(evidence.table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")), "doc_id")


@_query("SELECT CAST(min(doc_id) AS VARCHAR) AS image_id, md5(text) AS md5, sha1(text) AS sha1, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size FROM documents GROUP BY doc_id, text")
def image_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4: digests of images over their chunks, in order."""
    files = evidence.files(spark, sf_dir).select(F.col("inode").cast("string").alias("image_id"), "content")
    size = F.greatest(F.lit(1), F.octet_length("content"))
    chunks = files.select("image_id", "content", F.explode(F.sequence(F.lit(0), size - 1, F.lit(1000))).alias("offset")).select("image_id", F.col("offset").cast("long").alias("offset"), F.col("content").substr(F.col("offset") + 1, F.lit(1000)).alias("bytes"))
    return verify.image_digests(chunks)


BODY = """b AS (SELECT o_orderkey AS row_no, '/o/' || (o_orderkey % 5000) AS file, CAST(o_orderkey AS VARCHAR) AS inode, 'r/rrw' AS mode, o_custkey % 7 AS uid, o_custkey % 3 AS gid, CAST(floor(o_totalprice) AS BIGINT) AS size,
 epoch(l) AS atime, epoch(f) AS mtime, epoch(l) AS ctime, epoch(o_orderdate) AS crtime FROM orders JOIN (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey),
e AS (SELECT CAST(ts AS BIGINT) AS ts, inode, file, CASE WHEN bool_or(k = 'm') THEN 'm' ELSE '.' END || CASE WHEN bool_or(k = 'a') THEN 'a' ELSE '.' END || CASE WHEN bool_or(k = 'c') THEN 'c' ELSE '.' END || CASE WHEN bool_or(k = 'b') THEN 'b' ELSE '.' END AS macb
 FROM (SELECT mtime AS ts, 'm' AS k, inode, file FROM b UNION ALL SELECT atime, 'a', inode, file FROM b UNION ALL SELECT ctime, 'c', inode, file FROM b UNION ALL SELECT crtime, 'b', inode, file FROM b) GROUP BY ts, inode, file)"""
USERS = "(0, 'root'), (1, 'ann bob'), (2, 'cy')"
ATTRIBUTES = f"""a AS (SELECT file, arg_max(mode, row_no) AS mode, arg_max(uid, row_no) AS uid, arg_max(gid, row_no) AS gid, arg_max(size, row_no) AS size FROM b GROUP BY file),
u(id, names) AS (VALUES {USERS}),
t AS (SELECT ts, inode, e.file, macb, mode, coalesce(replace(u.names, ' ', '/'), CAST(uid AS VARCHAR)) AS uid, CAST(gid AS VARCHAR) AS gid, size FROM e JOIN a ON a.file = e.file LEFT JOIN u ON u.id = a.uid)"""


def _timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline.timeline(evidence.body(spark, sf_dir), users=spark.sql(f"SELECT * FROM VALUES {USERS} AS t(id, names)"))


@_query(f"WITH {BODY} SELECT * FROM e")
def timeline_macb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each time of a file, with its letters."""
    return timeline.events(evidence.body(spark, sf_dir))


@_query(f"WITH {BODY}, {ATTRIBUTES} SELECT ts, inode, file, macb, mode, uid, gid, size FROM t")
def timeline_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the attributes of the last row of their name."""
    return _timeline(spark, sf_dir).select("ts", "inode", "file", "macb", "mode", "uid", "gid", "size")


@_query(f"""WITH {BODY}, {ATTRIBUTES} SELECT ts, inode, file, strftime(make_timestamp(ts * 1000000), '%a %b %d %Y %H:%M:%S') || ',' || size || ',' || macb || ',' || mode || ',' || uid || ',' || gid || ',' || inode || ',"' || file || '"' AS line FROM t""")
def timeline_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV lines of the timeline."""
    return timeline.csv_lines(_timeline(spark, sf_dir))


@_query(f"""WITH {BODY}, {ATTRIBUTES} SELECT ts, inode, file, printf('%s %8s %3s %s %-8s %-8s %-8s %s', CASE WHEN row_number() OVER (PARTITION BY ts ORDER BY inode, file) = 1 THEN strftime(make_timestamp(ts * 1000000), '%Y-%m-%dT%H:%M:%SZ') ELSE repeat(' ', 20) END, CAST(size AS VARCHAR), macb, mode, uid, gid, inode, file) AS line FROM t""")
def timeline_aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned lines, a date once."""
    return timeline.aligned_lines(_timeline(spark, sf_dir), "iso")


@_query(f"WITH {BODY} SELECT CAST(date_trunc('day', make_timestamp(ts * 1000000)) AS TIMESTAMP) AS period, count(*) AS n FROM e GROUP BY 1")
def timeline_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day."""
    return timeline.counts(timeline.events(evidence.body(spark, sf_dir)), "day").withColumn("period", F.col("period").cast("timestamp_ntz"))


@_query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS period, count(*) AS n FROM events GROUP BY 1")
def timeline_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour."""
    rows = evidence.table(spark, sf_dir, "events").select(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return timeline.counts(rows, "hour").withColumn("period", F.col("period").cast("timestamp_ntz"))


@_query(f"WITH {BODY} SELECT ts, inode, file, macb FROM e WHERE ts >= epoch(TIMESTAMP '1995-01-01') AND ts < epoch(TIMESTAMP '1996-07-01')")
def timeline_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a range of dates."""
    return timeline.events(evidence.body(spark, sf_dir), *timeline.iso_range("1995-01-01..1996-07-01"))


@_query("SELECT page_id, unnest(regexp_extract_all(html, '<title>([^<]*)</title>', 1)) AS title FROM pages")
def carve_html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands between a header and the next footer."""
    return evidence.table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit("(?s)<title>(.*?)</title>"), F.lit(1))).alias("title"))


_SAMPLES = samples.files()
#: Where each sample stands behind the first: the text, which holds no file, comes after the film.
_BEFORE = {kind: sum(len(c) + 2 for k, c in list(_SAMPLES.items())[1:n] if k != "mov") for n, kind in enumerate(_SAMPLES)}
_CARVED = ", ".join(f"('{k}', {len(c)}, {_BEFORE[k]}, '{hashlib.sha256(c).hexdigest()}')" for k, c in _SAMPLES.items())


def _image(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An image for each document: a film, the whole text, and files of every other type with two bytes after each."""
    text = F.col("text")
    for atom in ("moov", "mdat", "free", "wide"):  # words that would be films
        text = F.replace(text, F.lit(atom), F.lit(atom.upper()))
    parts = [F.lit(_SAMPLES["mov"]), F.encode(text, "UTF-8")]
    for kind, c in _SAMPLES.items():
        parts += [F.lit(c + b"\x01\x02")] if kind != "mov" else []
    return evidence.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("image_id"), F.lit(1000000).cast("long").alias("offset"), F.concat(*parts).alias("bytes")).withColumn("len", F.octet_length("bytes").cast("long"))


CARVED = f"""s(type, size, before, sha256) AS (VALUES {_CARVED}),
c AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, 1000000 + CASE WHEN type = 'mov' THEN 0 ELSE {len(_SAMPLES['mov'])} + strlen(text) + before END AS "offset", type, CAST(size AS BIGINT) AS size, sha256 FROM documents, s)"""


@_query(f"""WITH {CARVED} SELECT image_id, CAST("offset" AS BIGINT) AS "offset", type, size, printf('%x', "offset") || '.' || type AS name, sha256, row_number() OVER (PARTITION BY image_id ORDER BY "offset") AS row FROM c""")
def carve_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of nine types in raw bytes, with their contents' digests and their row in each image."""
    found = carve.numbered(carve.carve(_image(spark, sf_dir)))
    return found.select("image_id", "offset", "type", "size", "name", F.sha2("content", 256).alias("sha256"), F.col("row").cast("long").alias("row"))


@_query(f"""WITH {CARVED} SELECT image_id, type, CASE type WHEN 'jpg' THEN TIMESTAMP '2021-03-04 05:06:07' WHEN 'pdf' THEN TIMESTAMP '2019-02-03 04:05:06' WHEN 'zip' THEN TIMESTAMP '2020-01-02 03:04:06' END AS mtime FROM c WHERE type IN ('jpg', 'pdf', 'zip', 'gif')""")
def carved_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times inside recovered files."""
    return carve.carve(_image(spark, sf_dir), ["jpg", "pdf", "zip", "gif"]).select("image_id", "type", "mtime")


@_query(f"""WITH {CARVED} SELECT image_id, printf('%x', "offset") || '.' || type AS name, type, size, upper(sha256) AS sha256 FROM c WHERE type <> 'mov'""")
def carved_reread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recovered files looked up by name, and their bytes read again at the offset in the name."""
    image = _image(spark, sf_dir)
    # carved once: the list of files is read as the names to look up and as what they are looked up in
    found = stored(carve.carve(image).filter("type <> 'mov'").drop("content"), "carved")
    named = carve.looked_up(found.select("image_id", "name"), found)
    return carve.reread(named.select("image_id", "name", "type", "size"), image).select("image_id", "name", "type", "size", F.upper(F.sha2("content", 256)).alias("sha256"))


@_query("""SELECT doc_id, tag, value FROM documents, (VALUES ('DateTime', '2021:03:04 05:06:07'), ('Make', 'Maker'), ('Model', 'Model 7')) AS t(tag, value) WHERE doc_id % 3 <> 0""")
def exif_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named tags of JPEGs; other contents have none."""
    jpg = F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(_SAMPLES["jpg"]), F.encode("text", "UTF-8"))).otherwise(F.encode("text", "UTF-8"))
    return carve.exif_tags(evidence.table(spark, sf_dir, "documents").select("doc_id", jpg.alias("content")), "doc_id")


@_query(f"""SELECT doc_id, type, CASE WHEN doc_id % 2 = 0 THEN true ELSE type IN ('mov', 'wmv', 'zip', 'bmp') END AS valid FROM documents, (VALUES {", ".join(f"('{k}')" for k in _SAMPLES)}) AS t(type)""")
def file_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether contents have the structure of their type: real files, and texts that only say so."""
    rows = evidence.table(spark, sf_dir, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"), F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(c).alias("file")) for k, c in _SAMPLES.items()])).alias("s"))
    return carve.validity(rows.select("doc_id", "s.type", F.when(F.col("doc_id") % 2 == 0, F.col("s.file")).otherwise(F.col("raw")).alias("content")), "doc_id")


@_query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_orderdate AS TIMESTAMP) END AS at FROM orders""")
def embedded_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF and PDF dates as times; malformed ones are null."""
    day, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 5
    said = F.when(k == 4, F.lit("no date")).when(k % 2 == 0, F.date_format(day, "yyyy:MM:dd HH:mm:ss")).otherwise(F.concat(F.lit("D:"), F.date_format(day, "yyyyMMddHHmmss"), F.lit("+02'00'")))
    return evidence.table(spark, sf_dir, "orders").select("o_orderkey", S.embedded_time(F.when(k % 2 == 0, F.lit("jpg")).otherwise(F.lit("pdf")), said).alias("at"))


@_query("SELECT doc_id, text || '%%EOF' || chr(10) AS kept FROM documents")
def tail_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents cut after the last end mark."""
    raw = F.encode(F.concat("text", F.lit("%%EOF\n"), F.lit("trailing")), "UTF-8")
    return evidence.table(spark, sf_dir, "documents").select("doc_id", X.pdf_tail(raw).cast("string").alias("kept"))


@_query(f"""WITH {FILES}, d AS (SELECT vol, lang, count(*) AS files, sum(size) AS size FROM files GROUP BY GROUPING SETS ((vol), (vol, lang))) SELECT vol || ':/' || coalesce(lang, '') AS path, files, CAST(size AS BIGINT) AS size FROM d""")
def dir_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and bytes below each directory."""
    below = evidence.files(spark, sf_dir).select(F.explode(F.array(F.concat("vol", F.lit(":/")), F.concat("vol", F.lit(":/"), "lang"))).alias("path"), "size")
    return below.groupBy("path").agg(F.count("*").alias("files"), F.sum("size").alias("size"))


TREE = """t AS (SELECT 'disk' AS image_id, CAST(0 AS BIGINT) AS start_offset, p_partkey AS inode, CAST(p_partkey // 10 AS BIGINT) AS parent_inode, p_name AS name FROM part WHERE p_partkey > 0)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.table(spark, sf_dir, "part").filter("p_partkey > 0").select(F.lit("disk").alias("image_id"), F.lit(0).cast("long").alias("start_offset"), F.col("p_partkey").alias("inode"), F.expr("p_partkey div 10").alias("parent_inode"), F.col("p_name").alias("name"))


@_query(f"WITH {TREE} SELECT c.inode, c.parent_inode, p.name AS parent_name, p.parent_inode AS grandparent_inode, EXISTS (SELECT 1 FROM t x WHERE x.parent_inode = c.inode) AS has_children FROM t c LEFT JOIN t p ON p.inode = c.parent_inode")
def tree_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, grandparents and whether there are children."""
    return search.with_child_flag(search.with_parents(_tree(spark, sf_dir))).select("inode", "parent_inode", "parent_name", "grandparent_inode", "has_children")


@_query(f"""WITH RECURSIVE {TREE}, w AS (SELECT inode, CAST('/' || inode AS VARCHAR) AS path, 1 AS depth FROM t WHERE parent_inode = 0 UNION ALL SELECT t.inode, w.path || '/' || t.inode, w.depth + 1 FROM t JOIN w ON t.parent_inode = w.inode) SELECT inode, path, depth FROM w""")
def path_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from parents, twice as many levels in each round."""
    return search.walk(_tree(spark, sf_dir)).select("inode", "path", "depth")


@_query("""SELECT event_id, CAST(event_id AS VARCHAR) AS id, CASE WHEN user_id % 2 = 0 THEN sha256(event_type) END AS sha256, json_extract_string(props, '$.k') AS date FROM events""")
def upload_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS2: id, digest and date of an upload's answer; what is missing is null."""
    answer = F.concat(F.lit('{"data":{"id":"'), F.col("event_id").cast("string"), F.lit('","attributes":{'), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('"sha256":"'), F.sha2(F.col("event_type").cast("binary"), 256), F.lit('",'))).otherwise(F.lit("")), F.lit('"date":'), F.get_json_object("props", "$.k"), F.lit("}}}"))
    return reports.upload_receipt(evidence.table(spark, sf_dir, "events").select("event_id", answer.alias("report"))).select("event_id", "id", "sha256", "date")


@_query("""SELECT event_id, e AS engine, e = 'A' AND user_id % 2 = 0 AS detected, CASE WHEN e = 'A' THEN '1.0' ELSE 'N/A' END AS version, 'N/A' AS "update", CASE WHEN e = 'A' THEN event_type ELSE 'N/A' END AS result FROM events, (VALUES ('A'), ('B')) AS t(e)""")
def scan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS1, A10: scanner reports, a row for each engine."""
    report = F.expr("""concat('{"md5":"x","scans":{"A":{"detected":', if(user_id % 2 = 0, 'true', 'false'), ',"version":"1.0","result":"', event_type, '"},"B":{}}}')""")
    return reports.scan_engines(evidence.table(spark, sf_dir, "events").select("event_id", report.alias("report")), "event_id")


@_query("""SELECT event_id, 'success' AS status, CAST(user_id AS VARCHAR) AS phone, 'N/A' AS carrier FROM events WHERE event_type = 'click'""")
def phone_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JS3: phone reports that succeeded."""
    report = F.to_json(F.struct(F.when(F.col("event_type") == "click", "success").otherwise("error").alias("status"), F.col("user_id").cast("string").alias("phone")))
    return reports.phone_report(evidence.table(spark, sf_dir, "events").select("event_id", report.alias("report"))).select("event_id", "status", "phone", "carrier")


@_query("""WITH RECURSIVE n AS (SELECT event_id AS id, user_id AS usr, CAST(floor(epoch(ts)) AS BIGINT) AS ts, row_number() OVER (PARTITION BY user_id ORDER BY CAST(floor(epoch(ts)) AS BIGINT), event_id) AS k FROM events),
f AS (SELECT id, usr, ts, k, true AS accepted, ts // 86400 AS day, 1 AS today, ts AS last, 1 AS burst FROM n WHERE k = 1
 UNION ALL SELECT id, usr, ts, k, ok, day, base + CASE WHEN ok THEN 1 ELSE 0 END, CASE WHEN ok THEN ts ELSE last END, CASE WHEN base >= 500 THEN burst WHEN near THEN burst + 1 ELSE 1 END
 FROM (SELECT n.id, n.usr, n.ts, n.k, n.ts // 86400 AS day, CASE WHEN n.ts // 86400 = f.day THEN f.today ELSE 0 END AS base, f.last, f.burst, n.ts - f.last < 60 AS near,
  CASE WHEN n.ts // 86400 = f.day THEN f.today ELSE 0 END < 500 AND NOT (n.ts - f.last < 60 AND f.burst + 1 > 3) AS ok FROM f JOIN n ON n.usr = f.usr AND n.k = f.k + 1))
SELECT id, usr AS "user", ts, accepted FROM f""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a limiter of each user says to every event."""
    rows = evidence.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"))
    return history.rate_limited(rows)


@_query("""WITH RECURSIVE n AS (SELECT event_id AS id, user_id AS usr, CASE event_type WHEN 'view' THEN 'back' WHEN 'signup' THEN 'forward' ELSE 'visit' END AS action, '/' || event_type || '/' || event_id AS place, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
f AS (SELECT id, usr, action, place, k, CASE WHEN action = 'visit' THEN [place] ELSE CAST([] AS VARCHAR[]) END AS places, CASE WHEN action = 'visit' THEN 1 ELSE 0 END AS spot FROM n WHERE k = 1
 UNION ALL SELECT n.id, n.usr, n.action, n.place, n.k, CASE WHEN n.action = 'visit' THEN list_append(f.places[1:f.spot], n.place) ELSE f.places END,
  CASE WHEN n.action = 'visit' THEN f.spot + 1 WHEN n.action = 'back' AND f.spot > 1 THEN f.spot - 1 WHEN n.action = 'forward' AND f.spot < len(f.places) THEN f.spot + 1 ELSE f.spot END FROM f JOIN n ON n.usr = f.usr AND n.k = f.k + 1)
SELECT id, usr AS "user", action, place, CASE WHEN spot > 0 THEN places[spot] END AS current FROM f""")
def nav_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each user's session is after every step."""
    step = F.when(F.col("event_type") == "view", "back").when(F.col("event_type") == "signup", "forward").otherwise("visit")
    rows = evidence.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), step.alias("action"), F.concat(F.lit("/"), "event_type", F.lit("/"), F.col("event_id").cast("string")).alias("place"))
    return history.visited(rows)


@_query(f"""WITH n AS (SELECT doc_id, text, {NAMES} AS name FROM documents) SELECT doc_id, CASE lower(split_part(name, '.', -1)) WHEN 'jpg' THEN 'image/jpg' ELSE 'application/octet-stream' END AS mime, CASE WHEN text = '' THEN 'empty' WHEN starts_with(text, '%PDF') THEN 'PDF document' WHEN starts_with(text, 'BM') THEN 'PC bitmap' WHEN starts_with(text, 'MZ') THEN 'MS-DOS executable' WHEN starts_with(text, 'RIFF') THEN 'RIFF data' WHEN starts_with(text, 'GIF8') THEN 'GIF image data'
WHEN NOT regexp_matches(text, '[^\\t\\n\\r\\x20-\\x7e]') THEN 'ASCII text' WHEN NOT contains(text, chr(0)) THEN 'UTF-8 Unicode text' ELSE 'data' END AS content FROM n""")
def mime_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by name and by content."""
    names = _names(spark, sf_dir)
    texts = evidence.table(spark, sf_dir, "documents").select("doc_id", "text")
    kind = S.content_class(F.encode("text", "UTF-8"))
    return names.join(texts, "doc_id").select("doc_id", S.mime_class(F.col("name")).alias("mime"), kind.alias("content"))


KEYS = """k AS (SELECT DISTINCT p AS path, CASE WHEN len(string_split(p, '/')) > 1 THEN regexp_replace(p, '/[^/]*$', '') END AS parent FROM (SELECT unnest(list_transform(range(1, len(string_split(u, '/')) + 1), lambda i: array_to_string(string_split(u, '/')[1:i], '/'))) AS p FROM (SELECT regexp_replace(url, '^[a-z]+://', '') AS u FROM pages)))"""


@_query(f"""WITH {KEYS}, v AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, count(*) AS n FROM pages GROUP BY 1), s AS (SELECT parent AS path, count(*) AS n FROM k WHERE parent IS NOT NULL GROUP BY 1)
SELECT path, coalesce(s.n, 0) AS n_subkeys, coalesce(v.n, 0) AS n_values FROM k LEFT JOIN s USING (path) LEFT JOIN v USING (path)""")
def registry_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of subkeys and values of every key of a tree."""
    pages = evidence.table(spark, sf_dir, "pages").select(F.regexp_replace("url", "^[a-z]+://", "").alias("path"), F.col("page_id").alias("name"))
    parts = F.split("path", "/")
    paths = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("path")).distinct()
    keys = paths.select("path", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), F.substring_index("path", "/", -1).alias("name"), F.lit(None).cast("timestamp").alias("ts"))
    return registry.key_metadata(keys, pages).select("path", "n_subkeys", "n_values")


@_query("""SELECT c_nationkey AS hive, coalesce(max(CASE WHEN c_mktsegment = 'BUILDING' THEN c_name END), 'N/A') AS "BUILDING", coalesce(max(CASE WHEN c_mktsegment = 'NONE' THEN c_name END), 'N/A') AS "NONE" FROM (SELECT c_nationkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'other' ELSE c_mktsegment END AS c_mktsegment FROM customer) GROUP BY 1""")
def registry_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named values as columns, N/A where missing."""
    path = F.when(F.col("c_custkey") % 3 == 0, F.lit("other")).otherwise(F.lit("Microsoft\\\\CurrentVersion"))
    values = evidence.table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("hive"), path.alias("path"), F.col("c_mktsegment").alias("name"), F.col("c_name").alias("value"))
    return registry.facts(values, "hive", ["BUILDING", "NONE"], F.col("path").endswith("\\\\CurrentVersion"))


@_query("""SELECT doc_id, CAST(1024 AS BIGINT) + 100 AS "offset", hex(encode(text)[101:300]) AS bytes FROM documents WHERE strlen(text) > 100""")
def range_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A byte range cut out of every file's chunks."""
    chunks = evidence.files(spark, sf_dir).select(F.col("inode").alias("image_id"), F.lit(1024).cast("long").alias("offset"), F.octet_length("content").cast("long").alias("len"), F.col("content").alias("bytes"))
    return space.read_range(chunks, 1124, 200).select(F.col("image_id").alias("doc_id"), "offset", F.hex("bytes").alias("bytes"))


@_query("""SELECT doc_id, CASE WHEN contains(n, '.e01') THEN 'ewf' WHEN contains(n, '.dd') THEN 'raw' END AS kind FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '/x/a.e01' WHEN 1 THEN '/x/b.dd' ELSE '/x/c.txt' END AS n FROM documents)""")
def image_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of images by extension."""
    path = F.expr("CASE doc_id % 3 WHEN 0 THEN '/x/a.E01' WHEN 1 THEN '/x/b.DD' ELSE '/x/c.txt' END")
    return evidence.table(spark, sf_dir, "documents").select("doc_id", S.image_kind(path).alias("kind"))


@_query("""SELECT doc_id, text AS decoded, CASE WHEN doc_id % 2 = 0 THEN text ELSE 'é' || doc_id || 'ÿ' END AS read FROM documents""")
def text_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTML entities decoded, and contents in UTF-8 or Latin-1 read as text."""
    escaped = F.replace(F.replace(F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;")), F.lit('"'), F.lit("&quot;"))
    latin = F.encode(F.concat(F.lit("é"), F.col("doc_id").cast("string"), F.lit("ÿ")), "ISO-8859-1")
    return evidence.table(spark, sf_dir, "documents").select("doc_id", X.from_html(escaped).alias("decoded"), X.readable_text(F.when(F.col("doc_id") % 2 == 0, F.encode("text", "UTF-8")).otherwise(latin)).alias("read"))


@_query("""SELECT doc_id, CASE CAST(doc_id % 7 AS INTEGER) WHEN 0 THEN 'ab' WHEN 1 THEN 'ab' WHEN 2 THEN 'text ' || doc_id || '~' WHEN 3 THEN 'xyz' WHEN 4 THEN 'a b c' || doc_id WHEN 5 THEN '&lt;' || doc_id ELSE '%zz ' || doc_id END AS decoded FROM documents""")
def auto_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first decoder that gives something, malformed escapes among the texts."""
    i = F.col("doc_id").cast("string")
    base64 = F.base64(F.encode(F.concat(F.lit("text "), i, F.lit("~")), "UTF-8"))
    said = F.when(F.col("doc_id") % 7 == 0, "1100001 1100010").when(F.col("doc_id") % 7 == 1, "141 142").when(F.col("doc_id") % 7 == 2, base64).when(F.col("doc_id") % 7 == 3, "78797A").when(F.col("doc_id") % 7 == 4, F.concat(F.lit("a%20b+c"), i)).when(F.col("doc_id") % 7 == 5, F.concat(F.lit("&lt;"), i)).otherwise(F.concat(F.lit("%zz+"), i))
    return evidence.table(spark, sf_dir, "documents").select("doc_id", X.auto_decode(said).alias("decoded"))


@_query("""SELECT p_partkey, CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'bytes' WHEN 1 THEN 'address' ELSE 'string' END AS kind, CASE WHEN p_partkey * 3 < p_size * 100 THEN CAST(p_partkey * 3 // 16 AS BIGINT) END AS line FROM part""")
def hex_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search text asks for, and the line of an address; none beyond the end."""
    asked = F.expr("CASE p_partkey % 4 WHEN 0 THEN 'de AD 0f' WHEN 1 THEN concat('0x', lower(hex(p_partkey))) WHEN 2 THEN 'abc' ELSE concat('no hex ', p_name) END")
    return evidence.table(spark, sf_dir, "part").select("p_partkey", paging.query_kinds(asked).alias("kind"), paging.address_line(F.col("p_partkey") * 3, F.col("p_size") * 100).alias("line"))


@_query("""WITH s AS (SELECT doc_id, string_split(text, 'an') AS p FROM documents),
f AS (SELECT doc_id, CAST(list_sum(list_transform(p[1:k], lambda x: strlen(x))) + (k - 1) * 2 AS BIGINT) AS position FROM s, unnest(range(1, len(p))) AS t(k))
SELECT doc_id, position, position // 16 AS line_no FROM f""")
def hex_search_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places and lines of a byte string that don't overlap."""
    return paging.byte_lines(evidence.files(spark, sf_dir).withColumnRenamed("inode", "doc_id"), "doc_id", b"an", overlapping=False)


@_query("""SELECT o_orderkey AS row_no, '0' AS md5, '/d/a b+c|' || o_orderkey AS file, CAST(o_orderkey AS VARCHAR) AS inode, 'r/rrw' AS mode, CAST(o_custkey % 7 AS BIGINT) AS uid, CASE WHEN o_orderkey % 3 <> 0 THEN CAST(o_custkey % 5 AS BIGINT) END AS gid, CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders WHERE o_orderkey % 10 <> 0""")
def body_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body lines with escapes; comments are left out, numbers that aren't are null."""
    text = F.concat_ws("|", F.lit("0"), F.concat(F.lit("/d/a%20b+c%7c"), F.col("o_orderkey").cast("string")), F.col("o_orderkey").cast("string"), F.lit("r/rrw"), (F.col("o_custkey") % 7).cast("string"), F.when(F.col("o_orderkey") % 3 != 0, (F.col("o_custkey") % 5).cast("string")).otherwise(F.lit("none")), F.floor("o_totalprice").cast("string"), F.lit("1"), F.lit("2"), F.lit("3"), F.lit("4"))
    lines = evidence.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_no"), F.when(F.col("o_orderkey") % 10 == 0, F.concat(F.lit("#"), text)).otherwise(text).alias("value"))
    return bodyfile.parse(lines).select("row_no", "md5", "file", "inode", "mode", "uid", "gid", "size")


@_query("""SELECT CAST(c_nationkey AS VARCHAR) AS id, string_agg(c_name, ' ' ORDER BY c_custkey) AS names FROM customer WHERE c_custkey % 6 <> 0 GROUP BY 1""")
def names_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of ids from colon-separated lines, several for one id; lines with + in front are left out."""
    text = F.concat(F.when(F.col("c_custkey") % 6 == 0, F.lit("+")).otherwise(F.lit("")), "c_name", F.lit(":x:"), F.col("c_nationkey").cast("string"), F.lit(":rest"))
    return timeline.names_by_id(evidence.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_no"), text.alias("value")))


@_query("""SELECT o_orderkey, strftime(o_orderdate - INTERVAL 5 HOUR, '%a %m %d %Y %H:%M:%S') AS numeric, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS iso, 'Xxx Xxx 00 0000 00:00:00' AS zero FROM orders""")
def timeline_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric and ISO dates in time zones, and time 0."""
    at = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return evidence.table(spark, sf_dir, "orders").select("o_orderkey", timeline.date_text(at, "numeric", "Etc/GMT+5").alias("numeric"), timeline.date_text(at, "iso", "Asia/Tokyo").alias("iso"), timeline.date_text(F.lit(0)).alias("zero"))


@_query(f"WITH {BODY}, d AS (SELECT date_trunc('day', make_timestamp(ts * 1000000)) AS p, count(*) AS n FROM e GROUP BY 1) SELECT CAST(p AS TIMESTAMP) AS period, strftime(p, '%a %b %d %Y') || ': ' || n AS line FROM d")
def timeline_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: lines of a daily index."""
    return timeline.index_lines(timeline.events(evidence.body(spark, sf_dir))).withColumn("period", F.col("period").cast("timestamp_ntz"))


@_query(f"WITH {BODY} SELECT row_number() OVER (ORDER BY ts, inode, file) AS place, ts, inode, file, macb FROM e")
def timeline_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A timeline's order, inodes as text; the place of each row is counted by the parts of a range-partitioned sort."""
    return timeline.placed(timeline.events(evidence.body(spark, sf_dir)))


@_query("""SELECT row_no FROM (SELECT o_orderkey AS row_no, CASE o_orderkey % 5 WHEN 0 THEN NULL ELSE o_custkey END AS uid, CASE WHEN o_orderkey % 5 IN (1, 2) THEN 0 ELSE epoch(o_orderdate) END AS t FROM orders) WHERE uid IS NOT NULL AND t <> 0 AND row_no IN (SELECT l_orderkey FROM lineitem)""")
def sane_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """body rows with numbers and a time; rows without are left out."""
    k = F.col("row_no") % 5
    rows = evidence.body(spark, sf_dir).withColumn("uid", F.when(k != 0, F.col("uid")))
    for t in ("atime", "mtime", "ctime", "crtime"):
        rows = rows.withColumn(t, F.when(k.isin(1, 2), F.lit(0)).otherwise(F.col(t)))
    return timeline.sane(rows).select("row_no")


ENTRIES = f"""{FILES}, {VOLUMES}, n AS (SELECT 'disk' AS image_id, start AS start_offset, inode, CASE WHEN inode % 13 = 0 THEN '.' WHEN inode % 13 = 1 THEN '..' ELSE name END AS name, path, files.size, addr FROM files JOIN v ON vol = 'vol' || addr)"""


def _entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = evidence.volumes(spark, sf_dir).select(F.lit("disk").alias("image_id"), "addr", "start", "length", F.when(F.col("addr") % 3 == 0, F.lit("NTFS")).otherwise(F.lit("Ext4")).alias("fs_type"), (F.col("addr") % 4 != 1).alias("is_alloc"), F.when(F.col("addr") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("part "), F.col("addr").cast("string"))).alias("desc"))
    dots = F.when(F.col("inode") % 13 == 0, F.lit(".")).when(F.col("inode") % 13 == 1, F.lit("..")).otherwise(F.col("name"))
    files = evidence.files(spark, sf_dir).join(v.select(F.concat(F.lit("vol"), F.col("addr").cast("string")).alias("vol"), F.col("start").alias("start_offset")), "vol")
    return files.select(F.lit("disk").alias("image_id"), "start_offset", "inode", dots.alias("name"), "path", "size", F.lit(0).cast("long").alias("parent_inode")), v


@_query(f"WITH {ENTRIES} SELECT inode, name FROM n WHERE addr % 4 <> 1 AND name NOT IN ('.', '..')")
def allocated_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of allocated volumes, without those for a directory itself and its parent."""
    entries, volumes = _entries(spark, sf_dir)
    return search.search(search.on_allocated_volumes(entries, volumes), "").select("inode", "name")


@_query(f"WITH {VOLUMES} SELECT addr, 'part ' || addr AS \"desc\" FROM v WHERE addr % 5 <> 0")
def described_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Partitions with a description."""
    return search.described(_entries(spark, sf_dir)[1]).select("addr", "desc")


@_query(f"WITH {ENTRIES} SELECT inode, path FROM n WHERE addr % 3 = 0 AND lower(path) LIKE '%/en/doc\\_%' ESCAPE '\\' AND inode % 2 = 0")
def hive_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files at a hive's path, on NTFS volumes only."""
    entries, volumes = _entries(spark, sf_dir)
    named = entries.withColumn("own", F.col("path")).withColumn("path", F.when((F.col("inode") % 2 == 0) & F.contains("path", F.lit("/en/")), F.lit("/windows/system32/CONFIG/software")).otherwise(F.col("path")))
    return registry.hive_files(named, volumes, registry.HIVES["SOFTWARE"]).select("inode", F.col("own").alias("path"))


@_query(f"WITH {ENTRIES} SELECT inode, name, path FROM n WHERE start_offset = 2048 AND inode = (SELECT max(inode) FROM n WHERE start_offset = 2048) ORDER BY path LIMIT 1")
def located_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry by its inode and volume."""
    entries, _ = _entries(spark, sf_dir)
    last = entries.filter("start_offset = 2048").agg(F.max("inode")).first()[0]
    return search.locate(entries, last if last is not None else -1, 2048).select("inode", "name", "path")


@_query(f"WITH {ENTRIES} SELECT inode, name FROM n WHERE start_offset = 2048 AND name NOT IN ('.', '..')")
def directory_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One directory of a volume."""
    return search.children(_entries(spark, sf_dir)[0], 2048, 0).select("inode", "name")


@_query(f"""WITH {VOLUMES} SELECT addr, start, start + length - 1 AS "end", length, length * 512 AS size, CASE WHEN addr % 3 = 0 THEN 'NTFS' ELSE 'Ext4' END AS fs_type, '4096' AS block_size, CAST(length // 8 AS VARCHAR) AS block_count, CASE WHEN addr % 4 <> 1 THEN 'Allocated' ELSE 'Unallocated' END AS status, 'N/A' AS label, CASE WHEN addr % 3 = 0 AND addr % 2 = 0 THEN 'Windows ' || addr ELSE 'N/A' END AS os_version FROM v""")
def partition_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each partition."""
    v = _entries(spark, sf_dir)[1].withColumns({"block_size": F.lit(4096).cast("long"), "block_count": F.floor(F.col("length") / 8).cast("long"), "label": F.lit(None).cast("string")})
    versions = v.filter("addr % 2 = 0").select("image_id", "addr", F.concat(F.lit("Windows "), F.col("addr").cast("string")).alias("summary"))
    return space.partition_details(v, versions).select("addr", "start", "end", "length", "size", "fs_type", "block_size", "block_count", "status", "label", "os_version")


@_query("""SELECT o_orderkey, CASE WHEN floor(o_totalprice) % 3 <> 0 THEN least(100.0, CAST(o_custkey AS DOUBLE) / CAST(floor(o_totalprice) AS DOUBLE) * 100) END AS done FROM orders""")
def progress_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: percentages done, 100 at most."""
    total = F.when(F.floor("o_totalprice") % 3 != 0, F.floor("o_totalprice")).otherwise(F.lit(0))
    return evidence.table(spark, sf_dir, "orders").select("o_orderkey", space.progress(F.col("o_custkey"), total).alias("done"))


@_query("SELECT DISTINCT '/img/' || s_nationkey || '.dd' AS path FROM supplier WHERE s_nationkey % 4 <> 0")
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images added to a list, each once, and some taken off again."""
    path = lambda c: F.concat(F.lit("/img/"), F.col(c).cast("string"), F.lit(".dd")).alias("path")
    rows = evidence.table(spark, sf_dir, "supplier")
    listed = space.with_evidence(rows.filter("s_suppkey % 2 = 0").select(path("s_nationkey")).distinct(), rows.filter("s_suppkey % 2 = 1").select(path("s_nationkey")))
    return space.without_evidence(listed, evidence.table(spark, sf_dir, "nation").filter("n_nationkey % 4 = 0").select(path("n_nationkey")))


@_query("""SELECT doc_id, text || chr(10) || 'init_size: ' || doc_id AS report FROM documents WHERE NOT contains(text, 'init_size')""")
def sized_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata reports up to the size that ends their attributes."""
    report = F.concat("text", F.lit("\ninit_size: "), F.col("doc_id").cast("string"), F.lit("\nmore\ninit_size: 7"))
    return evidence.table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("init_size"))).select("doc_id", X.sized_text(report).alias("report"))


@_query(f"""SELECT doc_id, 'Path: /d/' || doc_id || chr(10) || 'Size: ' || strlen(text) || chr(10) || 'MD5: ' || md5(text) || chr(10) || 'SHA-1: ' || sha1(text) || chr(10) || 'SHA-256: ' || sha256(text) || chr(10) || 'Stored MD5: ' || coalesce(stored_md5, 'N/A') || chr(10) || 'Stored SHA-1: ' || coalesce(stored_sha1, 'N/A') || chr(10) ||
'MD5 check: ' || CASE WHEN lower(stored_md5) = md5(text) THEN 'Match' ELSE 'Mismatch' END || chr(10) || 'SHA-1 check: ' || CASE WHEN stored_sha1 = sha1(text) THEN 'Match' ELSE 'Mismatch' END AS report FROM (SELECT doc_id, text, {STORED} FROM documents)""")
def hash_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: hash reports as text."""
    rows = evidence.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat('/d/', doc_id) AS path", "octet_length(text) AS size", "md5(text) AS md5", "sha1(text) AS sha1", "sha2(cast(text AS binary), 256) AS sha256", *STORED.replace(", CASE WHEN doc_id % 7", "\nCASE WHEN doc_id % 7").split("\n"))
    return export.hash_report(verify.compare(rows)).select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "report")


@_query("""SELECT p_partkey, p_name AS stem, p_name || '.dd' AS dd, 'a.b.raw' AS raw FROM part""")
def converted_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6: names of raw copies."""
    return evidence.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("stem"), export.converted_name(F.concat(F.lit("/x/"), "p_name", F.lit(".E01")), "dd").alias("dd"), export.converted_name(F.lit("/x/a.b.e01"), "raw").alias("raw"))


@_query("""WITH l AS (SELECT doc_id, encode(text) AS b, CAST(k AS BIGINT) AS line_no FROM documents, unnest(range(0, (strlen(text) + 15) // 16)) AS t(k)),
c AS (SELECT doc_id, line_no, hex(b[line_no * 16 + 1:line_no * 16 + 16]) AS h FROM l),
d AS (SELECT doc_id, line_no // 1024 AS page, line_no, printf('0x%08x: ', line_no * 16) || rpad(rtrim(regexp_replace(h, '(..)', '\\1 ', 'g')), 48, ' ') || '  ' ||
array_to_string(list_transform(range(1, length(h), 2), lambda i: CASE WHEN substr(h, i, 2) BETWEEN '20' AND '7E' THEN chr(CAST(CAST('0x' || substr(h, i, 2) AS INTEGER) AS INTEGER)) ELSE '.' END), '') AS line FROM c)
SELECT doc_id, page, sha256('<html><body><table>' || string_agg('<tr><td><pre>' || replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></td></tr>', '' ORDER BY line_no) || '</table></body></html>') AS sha256 FROM d GROUP BY 1, 2""")
def hex_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: pages of hex lines as HTML."""
    pages = export.hex_pages(evidence.files(spark, sf_dir).withColumnRenamed("inode", "doc_id"), "doc_id")
    return pages.select("doc_id", "page", F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))


@_query(f"""WITH {KEYS}, v AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, CAST(page_id AS VARCHAR) AS name FROM pages)
SELECT replace(path, '/', chr(92)) AS path, CAST(len(string_split(path, '/')) - 1 AS INTEGER) AS depth, 'key' AS kind, string_split(path, '/')[-1] AS name FROM k
UNION ALL SELECT replace(v.path, '/', chr(92)) || chr(92) || name, CAST(len(string_split(v.path, '/')) AS INTEGER), 'value', name FROM v JOIN k USING (path) WHERE k.parent IS NOT NULL""")
def registry_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: a hive's keys and values as a tree's lines; the root's own values aren't among them."""
    keys, values = _hive(spark, sf_dir)
    return registry.listing(keys, values).select("path", "depth", "kind", "name")


def _hive(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    url = F.replace(F.regexp_replace("url", "^[a-z]+://", ""), F.lit("/"), F.lit("\\"))
    pages = evidence.table(spark, sf_dir, "pages").select(url.alias("path"), F.col("page_id").cast("string").alias("name"), F.octet_length("html").alias("value"))
    parts = F.split("path", r"\\")
    paths = pages.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "\\"))).alias("path")).distinct()
    keys = paths.select("path", F.when(F.contains("path", F.lit("\\")), F.regexp_replace("path", r"\\[^\\]*$", "")).alias("parent"), F.substring_index("path", "\\", -1).alias("name"), F.lit(None).cast("timestamp").alias("ts"))
    return keys, pages.withColumn("type", F.lit("REG_DWORD"))


@_query("""WITH v AS (SELECT regexp_replace(url, '^[a-z]+://', '') AS path, CAST(page_id AS VARCHAR) AS name, CAST(strlen(html) AS VARCHAR) AS value FROM pages) SELECT name, 'REG_DWORD' AS type, value FROM v WHERE path = (SELECT min(path) FROM v)""")
def registry_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: one key's values."""
    _, values = _hive(spark, sf_dir)
    first = values.agg(F.min("path")).first()[0]
    return registry.value_table(values, first or "").select("name", "type", "value")


@_query("""WITH d AS (SELECT doc_id, encode(text) AS b, strlen(text) AS size, doc_id % 97 AS a FROM documents),
r AS (SELECT doc_id, a, b, size, size // 2 + doc_id % 3000 AS n FROM d)
SELECT doc_id, CAST(a AS BIGINT) AS "offset", CAST(octet_length(b[a + 1:a + n]) AS BIGINT) AS size, sha256(b[a + 1:a + n]) AS sha256 FROM r WHERE size > a AND n > 0""")
def range_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One range of every file, over all the chunks that it crosses."""
    files = evidence.files(spark, sf_dir)
    chunks = rawimage.chunks_of_files(files.select(F.col("inode").cast("string").alias("path"), "content"), 1000)
    at = (F.col("inode") % 97).cast("long")
    length = F.floor(F.octet_length("content") / 2).cast("long") + F.col("inode") % 3000
    ranges = files.select(F.col("inode").cast("string").alias("image_id"), F.col("inode").alias("doc_id"), at.alias("at"), length.alias("length"))
    got = space.whole_ranges(space.read_ranges(chunks, ranges, ["doc_id"], 4096), ["image_id", "doc_id"])
    return got.select("doc_id", (F.col("doc_id") % 97).cast("long").alias("offset"), F.octet_length("bytes").cast("long").alias("size"), F.sha2("bytes", 256).alias("sha256"))


PLACED = "c_custkey AS k, 2 + c_custkey % 500 AS start, 1 + c_custkey * 37 AS length FROM customer"


@_query(f"""WITH p AS (SELECT {PLACED})
SELECT CAST(k AS VARCHAR) AS image_id, 0 AS addr, 'Primary Table (#0)' AS "desc", CAST(0 AS BIGINT) AS start, CAST(1 AS BIGINT) AS length, false AS is_alloc FROM p
UNION ALL SELECT CAST(k AS VARCHAR), 1, 'Unallocated', 1, start - 1, false FROM p UNION ALL SELECT CAST(k AS VARCHAR), 2, 'Linux (0x83)', start, length, true FROM p""")
def partition_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The volume table of an image for each customer, made as bytes and read from its chunks."""
    word = lambda c: F.concat(*[F.substring(F.lpad(F.hex(c), 8, "0"), at, 2) for at in (7, 5, 3, 1)])
    rows = evidence.table(spark, sf_dir, "customer").selectExpr(*PLACED.replace(" FROM customer", "").split(", "))
    sector = F.concat(F.lit("00" * 446 + "00" * 4 + "83" + "00" * 3), word(F.col("start")), word(F.col("length")), F.lit("00" * 48 + "55AA"))
    chunks = rawimage.chunks_of_files(rows.select(F.col("k").cast("string").alias("path"), F.unhex(sector).alias("content")), 300)
    return rawimage.volumes_of_chunks(chunks).select("image_id", "addr", "desc", "start", "length", "is_alloc")
