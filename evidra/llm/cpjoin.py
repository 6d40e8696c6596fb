"""Near-duplicate join by chosen paths: texts whose sets of word shingles have a Jaccard similarity of 0.8 or more.

Texts with equal sets are one class. Each class is a sample of its tokens (the smallest hashes of its set). A
run picks a token of the sample with a probability that gives 1/threshold picks on average, by a hash that all
texts share, so similar texts pick the same token and meet in its bucket. Buckets too large to compare are
split again on more picked tokens, seeded by the path so far; a bucket whose texts resemble one another, or that
is still large at the last depth, is compared as it is, in blocks. Runs repeat until the target recall. Within
a bucket all sets are compared exactly; links make components; and within each component all pairs are
compared once more to count every text's links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, fresh, scratch, settle, split_marked, stored, tidied, with_rows
from .graph import components
from .shingles import WIDTH, numbered, sequences
from .words import mix

THRESHOLD = 0.8
SAMPLE = 32
RECALL = 0.999
#: Picks of a text in each deeper split, on average.
DEEPER = 2.5
DEPTH = 3
#: Texts that a bucket may hold before it is split, and texts of one block of a comparison.
BUCKET, BLOCK = 256, 1024
#: Mean similarity with its first text from which a bucket isn't split again.
ALIKE = 0.5


def runs_for(recall: float, threshold: float, depth: int = 0) -> int:
    """Runs after which a pair at the threshold has met with the target recall, in a bucket that is split `depth` times."""
    shared = 2 * threshold / (1 + threshold)  # share of a text's picks that the other makes as well
    again = 1 - math.exp(-DEEPER * shared)  # chance of meeting once more in one split
    return max(1, math.ceil(math.log(1 - recall) / -(shared / threshold * again**depth)))


def picks(sample: np.ndarray, seed: int, rate: float) -> np.ndarray:
    """Paths that a sample takes from the node `seed`: one for each picked token."""
    if not len(sample):
        return sample
    own = mix(sample ^ np.uint64(seed))
    limit = min(1.0, rate / len(sample)) * 2.0**64
    chosen = own[own.astype(np.float64) < limit]
    return mix(chosen * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(seed))


def _seed(run: int) -> int:
    return int(mix(np.array([0xA0761D6478BD642F + run], np.uint64))[0])


def _sketch(width: int, sample: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, seqs, _, _ in sequences(batch.column("text"), width):
                sets = [np.unique(s) for s in seqs]
                part = batch.slice(first, len(sets))
                k1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("rid"), part.column("doc_id"), pa.array(k1), pa.array(k2), pa.array([len(s) for s in sets], pa.int64()), pa.array([s[:sample].view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["rid", "doc_id", "k1", "k2", "n_set", "sample"])

    return run


def _first_paths(runs: int, rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = [_seed(r) for r in range(runs)]
        for batch in batches:
            found = [np.concatenate([picks(np.array(s, np.int64).view(np.uint64), seed, rate) for seed in seeds]) for s in batch.column("sample").to_pylist()]
            yield _rows(batch, found)

    return run


def _deeper_paths(rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [picks(np.array(s, np.int64).view(np.uint64), p & ((1 << 64) - 1), rate) for s, p in zip(batch.column("sample").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            yield _rows(batch, found)

    return run


def _rows(batch: pa.RecordBatch, found: list[np.ndarray]) -> pa.RecordBatch:
    size = np.array([len(f) for f in found], np.int64)
    paths = np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(paths), pa.array(np.repeat(batch.column("rid").to_numpy(), size))], names=["path", "rid"])


def _buckets(reps: DataFrame, runs: int, threshold: float, bucket: int, depth: int) -> DataFrame:
    """(path, n, rid) of the buckets to compare; of buckets with the same texts one stays."""
    sampled = reps.select("rid", "sample")
    at = stored(sampled.mapInArrow(tidied(_first_paths(runs, 1 / threshold)), "path long, rid long"), "paths")
    leaves = None
    for level in range(depth + 1):
        sizes = at.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.xxhash64("rid").cast("decimal(38,0)")).alias("sum"), F.min("rid").alias("head")).filter("n > 1")
        sizes = stored(sizes, "sizes")
        done = sizes.filter(F.col("n") <= bucket)
        large = sizes.filter(F.col("n") > bucket)
        more = level < depth and large.limit(1).count() > 0
        if not more:
            done = sizes
        else:
            members = stored(at.join(large.select("path", "head"), "path"), "members")
            # samples of texts in large buckets only; the others stay out of the joins below
            near = stored(split_marked(sampled, Marks(members))[0], "samples")
            inside = members.join(near, "rid")
            heads = near.select(F.col("rid").alias("head"), F.col("sample").alias("first"))
            alike = inside.join(heads, "head").withColumn("both", F.size(F.array_intersect("sample", "first"))).withColumn("like", F.col("both") / (F.size("sample") + F.size("first") - F.col("both")))
            kind = alike.groupBy("path").agg((F.avg("like") >= ALIKE).alias("alike"))
            large = stored(large.join(kind, "path"), "large")
            done = done.unionByName(large.filter("alike").drop("alike"))
        # buckets with the same texts are compared once
        done = done.groupBy("n", "sum", "head").agg(F.min("path").alias("path"))
        here = at.join(done.select("path", "n"), "path")
        leaves = here if leaves is None else leaves.unionByName(here)
        if not more:
            break
        at = stored(members.join(large.filter("not alike").select("path"), "path").select("path", "rid").join(near, "rid").mapInArrow(tidied(_deeper_paths(DEEPER)), "path long, rid long").distinct(), "paths")
    return stored(leaves, "buckets", keep=True)


#: Bytes of a hash that sets keep: two sets of 20,000 shingles take one for another with a chance of 1 in 700,000.
SET_BYTES = 6


def _set_bytes(shingles: np.ndarray) -> bytes:
    return np.unique(shingles >> np.uint64(64 - 8 * SET_BYTES)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def _set_of(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def _sets(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Marks.has(bits.value, batch.column("mark").to_numpy())))
            for first, _, seqs, _, _ in sequences(batch.column("text"), width):
                own = [_set_bytes(s) for s in seqs]
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(first, len(own)), pa.array(own, pa.binary())], names=["rid", "set"])

    return run


def similar(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each pair of sets reaches the threshold; exact, by products of 0/1 matrices over shared tokens."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    row = np.repeat(np.arange(n), size)
    token, column, df = np.unique(np.concatenate(sets) if n else np.zeros(0, np.uint64), return_inverse=True, return_counts=True)
    shared = df[column] > 1
    row, column = row[shared], (np.cumsum(df > 1) - 1)[column[shared]]
    width = int((df > 1).sum())
    both = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    step = max(256, (16 << 20) // max(n, 1))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(column, [a, a + step])
        m = np.zeros((n, min(step, width - a)), np.float32)
        m[row[lo:hi], column[lo:hi] - a] = 1
        both += m @ m.T
    union = size[:, None] + size[None, :] - both
    with np.errstate(invalid="ignore"):
        out = both >= threshold * union - 1e-6
    out &= (both > 0) | np.eye(n, dtype=bool)
    return out


def connected(link: np.ndarray) -> np.ndarray:
    """The first member of each one's component."""
    root = np.full(len(link), -1)
    for k in range(len(link)):
        if root[k] >= 0:
            continue
        front = np.array([k])
        root[k] = k
        while len(front):
            near = np.flatnonzero(link[front].any(axis=0) & (root < 0))
            root[near] = k
            front = near
    return root


def _edges(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates("rid").sort_values("rid")
        rid = rows["rid"].to_numpy()
        root = connected(similar([_set_of(s) for s in rows["set"]], threshold))
        other = root != np.arange(len(root))
        return pd.DataFrame({"a": rid[other], "b": rid[root[other]]})

    return run


def _counts(threshold: float):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid")
        link = similar([_set_of(s) for s in rows["set"]], threshold)
        np.fill_diagonal(link, False)
        if rows["i"].iloc[0] != rows["j"].iloc[0]:  # two blocks: pairs across them only
            side = rows["block"].to_numpy()
            link &= side[:, None] != side[None, :]
        return pd.DataFrame({"rid": rows["rid"].to_numpy(), "n": link.astype(np.float64) @ rows["copies"].to_numpy(np.float64)}).astype({"n": np.int64})

    return run


def _blocked(rows: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, n, rid, ...) dealt to pairs of blocks (i, j), i <= j; one pair where n fits a block."""
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(block))).cast("int")
    rows = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other")).drop("blocks", "other", "n")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, width: int = WIDTH, recall: float = RECALL, bucket: int = BUCKET, block: int = BLOCK, depth: int = DEPTH, row_col: str | None = None) -> DataFrame:
    """rid, doc_id, class_id, class_rid, copy_id, n_links for every row.

    copy_id: the smallest id among rows with the same set of shingles; class_id: the smallest id in the row's
    component of links and class_rid the number of one of its rows; n_links: other rows whose similarity with this one is the threshold or more, copies
    included. A text without words has no set: no links, and a class of its own (its own id). Null ids sort
    first and give a null class. Rows with equal ids count as rows of their own. Other columns are ignored.

    Shingles are lower-cased words of letters, digits and non-ASCII characters, five by default, compared by
    hash (64 bits in classes and paths, 48 in counts of shared shingles).
    """
    base = numbered(docs, id_col, text_col, row_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = stored(base.mapInArrow(tidied(_sketch(width, SAMPLE)), f"rid long, doc_id {kind}, k1 long, k2 long, n_set long, sample array<long>"), "sketches")
    own = rows.filter("n_set > 0")
    reps = stored(own.groupBy("k1", "k2", "n_set").agg(F.count("*").alias("copies"), F.min("doc_id").alias("copy_id"), F.min(F.struct("rid", "sample")).alias("rep")).select("k1", "k2", "n_set", "copies", "copy_id", "rep.rid", "rep.sample"), "classes")
    settle(docs.sparkSession)
    with scratch(docs.sparkSession):
        buckets = _buckets(reps, runs_for(recall, threshold, depth), threshold, bucket, depth)
    settle(docs.sparkSession)
    needed = buckets.select("rid").distinct()
    marks = Marks(needed)
    sets = stored(base.select("rid", "text", Marks.column().alias("mark")).mapInArrow(tidied(_sets(width, marks.bits)), "rid long, set binary"), "sets", "lz4")
    edges = _blocked(buckets.join(sets, "rid"), "path", block).groupBy("path", "i", "j").applyInPandas(_edges(threshold), "a long, b long")
    with scratch(docs.sparkSession):
        found = stored(components(edges), "components", keep=True)
    settle(docs.sparkSession)
    members = found.join(reps.select(F.col("rid").alias("node"), "copies", "copy_id"), "node")
    size = members.groupBy("root").agg(F.count("*").alias("n"), F.min("copy_id").alias("class_id"))
    inside = _blocked(members.join(size.select("root", "n"), "root").select("root", "n", F.col("node").alias("rid"), "copies").join(sets, "rid"), "root", block)
    counts = inside.groupBy("root", "i", "j").applyInPandas(_counts(threshold), "rid long, n long").groupBy("rid").agg(F.sum("n").alias("near"))
    classes = members.join(size.select("root", "class_id"), "root").select(F.col("node").alias("rid"), "class_id", "root").join(counts, "rid")
    by_class = reps.select("k1", "k2", "n_set", "copies", "copy_id", "rid").join(classes, "rid", "left").select("k1", "k2", "n_set", "copy_id", F.coalesce("class_id", "copy_id").alias("class_id"), F.coalesce("root", "rid").alias("class_rid"), (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return rows.select("rid", "doc_id", "k1", "k2", "n_set").join(by_class, ["k1", "k2", "n_set"], "left").select(
        "rid", "doc_id", F.when(F.col("n_set") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("class_rid", rows["rid"]).alias("class_rid"), F.when(F.col("n_set") > 0, F.col("copy_id")).otherwise(F.col("doc_id")).alias("copy_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )


def distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class of join(): the one with the smallest id, and of those the first.

    Every other column stays as it is, whatever its name. Null and empty texts are classes of their own and stay.
    """
    rid = fresh(docs, "rid")
    own = with_rows(docs, rid)
    with scratch(docs.sparkSession):
        rows = stored(join(own, id_col, text_col, row_col=rid, **options).select("rid", "doc_id", "class_rid"), "classes", keep=True)
    kept = rows.groupBy("class_rid").agg(F.min(F.struct("doc_id", "rid")).alias("first")).select("class_rid", F.col("first.rid").alias("kept"))
    gone = stored(rows.join(kept, "class_rid").filter("rid <> kept").select(F.col("rid").alias(rid)), "gone")
    maybe, rest = split_marked(own, Marks(gone, rid), rid)
    return rest.unionByName(maybe.join(gone, rid, "left_anti").select(*[F.col(f"`{c}`") for c in rest.columns])).drop(rid)
