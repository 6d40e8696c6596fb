"""What the corpus operators share: scratch tables, row ids, and flat byte views of text columns."""

from __future__ import annotations

import ctypes
import gc
import json
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage: the session's spark.checkpoint.dir.

    Where it is unset a local session gets a temporary folder; a cluster session raises, since a
    machine's own folder is not visible to the other machines.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isDefined():
            root = jsc.getCheckpointDir().get()
        elif spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            root = tempfile.mkdtemp(prefix="evidra-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return root.rstrip("/")


_LIBC = ctypes.CDLL(None)
#: Blocks of this many bytes go back to the system as soon as they are freed.
LARGE_BLOCK = 4 << 20
if hasattr(_LIBC, "mallopt"):
    _LIBC.mallopt(-3, LARGE_BLOCK)  # M_MMAP_THRESHOLD
pa.set_memory_pool(pa.system_memory_pool())  # so that what Arrow frees goes back as well
_local = threading.local()  # queries of different threads keep their tables apart


def _scopes() -> list[list[str]]:
    if not hasattr(_local, "scopes"):
        _local.scopes = []
    return _local.scopes


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables stored inside, but for those kept, are deleted at the end; what is kept must not read them any more."""
    _scopes().append([])
    try:
        yield
    finally:
        hadoop, conf = spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()
        for p in _scopes().pop():
            path = hadoop.Path(p)
            path.getFileSystem(conf).delete(path, True)


#: Bytes that a task's writer of a stored table gathers before it writes them.
ROW_GROUP = 16 << 20


def stored(df: DataFrame, name: str, compression: str = "zstd", keep: bool = False, **options: str) -> DataFrame:
    """Write df as a table in the shared scratch folder and return the table as read back.

    keep: the table outlives the innermost scratch() and belongs to the one around it, if any.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/evidra/{name}-{uuid.uuid4().hex}"
    scopes = _scopes()[:-1] if keep else _scopes()
    if scopes:
        scopes[-1].append(path)
    df.write.options(**{"parquet.block.size": str(ROW_GROUP), **options}).parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a batch that goes to a Python worker.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Let batches for Python workers hold BATCH_ROWS rows, where the session has Spark's own default of 10,000:
    a batch of whole texts is then some megabytes on both sides. The session keeps the setting."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: Rows of one file that a row number leaves room for, as a power of two.
FILE_BITS = 38
#: File names, in bytes, that with_rows() may broadcast.
NAME_BYTES = 64 << 20


def settle(spark: SparkSession) -> None:
    """Collect garbage on all executors, so that heaps which an earlier job made large shrink beside Python workers."""
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')").alias("done")).write.format("noop").mode("overwrite").save()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _scans_files(df: DataFrame) -> bool:
    """Whether df is a file scan, seen through projections and filters only, so each row is a row of a file."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    return plan.nodeName() in ("LogicalRelation", "Relation")


def with_rows(df: DataFrame, name: str) -> DataFrame:
    """df with the column `name`: a number for each row that is the same whenever and wherever the rows are read.

    Rows of Parquet files are numbered by file, in the order of their paths, and place in the file, however the
    files are split into tasks. Any other plan is written to a scratch table once, and numbered there.
    """
    spark = df.sparkSession
    small_batches(spark)
    if _scans_files(df):
        try:
            placed = df.select("*", F.col("_metadata.file_path").alias(path := fresh(df, "__file")), F.col("_metadata.row_index").alias(at := fresh(df, "__at")))
        except AnalysisException:  # a format without row numbers
            return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")
        paths = sorted(r[0] for r in placed.select(path).distinct().collect())
        if len(paths) <= 1:
            return placed.withColumn(name, F.col(at)).drop(path, at)
        if sum(map(len, paths)) <= NAME_BYTES:
            files = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps([{"f": f, "n": n << FILE_BITS} for n, f in enumerate(paths)])), "array<struct<f:string,n:long>>")).alias("x")).select(F.col("x.f").alias(path), F.col("x.n").alias(name))
            return placed.join(F.broadcast(files), path).withColumn(name, F.col(name) + F.col(at)).select(*[F.col(f"`{c}`") for c in df.columns], name)
    return stored(df.withColumn(name, F.monotonically_increasing_id()), "rows")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text): only these two columns go on, whatever else the table holds."""
    small_batches(df.sparkSession)
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def flat(column: pa.Array, end: str = "\n") -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, null as empty, with `end` appended to each value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.binary_join_element_wise(pc.fill_null(column.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar(end, pa.large_string()))
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def _trim() -> None:
    """Give freed memory back, so that an idle worker doesn't hold what its largest batch took."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def tidied(run):
    """run, and at a task's end what it has freed goes back to the system."""

    def tidy(batches):
        yield from run(batches)
        gc.collect()
        _trim()

    return tidy


def slices(column: pa.Array, limit: int = 1 << 20):
    """(first, last) row ranges whose texts add up to about `limit` bytes; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    ends, first = np.cumsum(size), 0
    while first < len(size):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, last
        first = last


def crc_bucket(col, n: int):
    """crc32 of the id written as text, modulo n."""
    return F.crc32(col.cast("string").cast("binary")) % n


MARK_BITS = 26


class Marks:
    """A set of row numbers as a bitmap of fixed size (2**MARK_BITS bits) that every task may hold.

    It may say yes for a row that isn't in the set, never no for one that is: it only keeps rows that
    surely aren't needed out of a shuffle, and a join decides.
    """

    def __init__(self, rows: DataFrame, column: str = "rid", place=None):
        h = self.column(column) if place is None else place
        words = rows.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("bits")).toArrow()
        bits = np.zeros(1 << MARK_BITS - 6, np.int64)
        bits[words.column("word").to_numpy()] = words.column("bits").to_numpy()
        self.bits = rows.sparkSession.sparkContext.broadcast(bits)

    @staticmethod
    def column(column: str = "rid"):
        """What has() takes, for each row."""
        return F.pmod(F.xxhash64(F.col(f"`{column}`")), F.lit(1 << MARK_BITS))

    @staticmethod
    def has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
        return (bits[h >> 6] >> (h & 63) & 1).astype(bool)


def split_marked(df: DataFrame, marks: Marks, column: str = "rid") -> tuple[DataFrame, DataFrame]:
    """(rows that may be marked, rows that surely aren't) of df, without a shuffle."""
    own, bits, name = df.schema, marks.bits, fresh(df, "mark")

    def part(wanted: bool):
        def run(batches):
            for batch in batches:
                mask = Marks.has(bits.value, batch.column(name).to_numpy())
                yield batch.select([n for n in batch.schema.names if n != name]).filter(pa.array(mask == wanted))

        return df.withColumn(name, Marks.column(column)).mapInArrow(tidied(run), own)

    return part(True), part(False)
