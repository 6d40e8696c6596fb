"""Benchmark decontamination by Wu-Manber search over words.

A pattern is a window of consecutive words of a benchmark item. For patterns of m words the SHIFT table,
indexed by the hash of a block of two words, says how far the window may move without passing an
occurrence; most blocks occur in no pattern, so most of a text is never looked at. Where the shift is 0
the block's hash selects a bucket of patterns with that suffix, the hash of the whole window picks among
them, and the bytes of the words are compared at last.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Marks, flat, fresh, slices, split_marked, stored, texts_of, tidied, with_rows
from .words import ALNUM, Words, mix

SHIFT_BITS = 18
#: Benchmark text that one compiled block may hold; a larger benchmark is searched block by block.
BLOCK_BYTES = 8 << 20
_K = np.uint64(0x9E3779B97F4A7C15)


def _block(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * np.uint64(0xFF51AFD7ED558CCD) ^ b) * _K


def _slot(block: np.ndarray) -> np.ndarray:
    return (block >> np.uint64(64 - SHIFT_BITS)).astype(np.int64)


class Block:
    """Items of a benchmark as words side by side, and their patterns by length."""

    def __init__(self, names: list[str | None], texts: list[str | None], width: int):
        self.names = names
        data, offsets = flat(pa.array(texts, pa.string()))
        self.words = Words(data, offsets, ALNUM)
        first, n = self.words.first[:-1], np.diff(self.words.first)
        self.groups = []
        for m in np.unique(np.minimum(n, width)).tolist():
            items = np.flatnonzero(np.minimum(n, width) == m)
            count = n[items] - m + 1
            if m:
                at = np.repeat(first[items] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                self.groups.append(Group(m, self.words, at, np.repeat(items, count)))


class Group:
    """Patterns of the same number of words: where each begins among the items' words, and its item.

    Nothing is kept but numbers, some 40 bytes for each pattern beside its words."""

    def __init__(self, m: int, words: Words, at: np.ndarray, items: np.ndarray):
        self.m, self.width = m, min(2, m)
        self.reach = m - self.width + 1  # the largest shift
        self.at, self.items = at.astype(np.int32), items.astype(np.int32)
        self.whole = _windows(words.hash, at, m)
        self.shift = np.full(1 << SHIFT_BITS, self.reach, np.uint8 if m < 255 else np.int64)
        for j in range(self.reach):
            last = _block(words.hash[at + j], words.hash[at + j + self.width - 1])
            np.minimum.at(self.shift, _slot(last), self.reach - 1 - j)
        self.order = np.argsort(last, kind="stable").astype(np.int32)
        self.suffix = last[self.order]

    def find(self, w: Words, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first word, pattern) of every occurrence in a batch."""
        first, last = w.first[:-1], w.first[1:]
        h, none = w.hash, (np.zeros(0, np.int64), np.zeros(0, np.int64))
        begin = first + self.m - 1  # ends of windows
        n = np.maximum(0, -(-(last - begin) // self.reach))
        if not n.sum():
            return none
        before = np.cumsum(n) - n
        at = np.repeat(begin - before * self.reach, n) + np.arange(n.sum()) * self.reach
        stop = np.minimum(at + self.reach, np.repeat(last, n))
        found = []
        while len(at):  # all cursors step at once; most stop at the first look
            b = _block(h[at - self.width + 1], h[at])
            s = self.shift[_slot(b)]
            hit = s == 0
            found.append((at[hit], b[hit]))
            at = at + np.maximum(s, 1)
            go = at < stop
            at, stop = at[go], stop[go]
        at, b = (np.concatenate(x) for x in zip(*found, strict=True))
        lo, hi = np.searchsorted(self.suffix, b), np.searchsorted(self.suffix, b, side="right")
        size = hi - lo
        if not size.sum():
            return none
        at = np.repeat(at, size) - self.m + 1
        which = self.order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        same = _windows(h, at, self.m) == self.whole[which]
        at, which = at[same], which[same]
        sure = [_words(w, a, self.m) == _words(words, p, self.m) for a, p in zip(at.tolist(), self.at[which].tolist(), strict=True)]
        return (at[sure], which[sure]) if sure else none


def _words(w: Words, a: int, m: int) -> list[bytes]:
    return [w.low[x:y].tobytes() for x, y in zip(w.starts[a : a + m].tolist(), w.ends[a : a + m].tolist(), strict=True)]


def _windows(h: np.ndarray, at: np.ndarray, m: int) -> np.ndarray:
    """Hash of the m words from each place."""
    out = np.zeros(len(at), np.uint64)
    for k in range(m):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += h[at + k]
        out ^= out >> np.uint64(31)
    return mix(out)


def _blocks(benchmark: DataFrame, width: int, block_bytes: int) -> Iterator[Block]:
    """Compiled blocks of the benchmark, one after the other, each of block_bytes of text or a single longer item."""
    names, texts, size = [], [], 0
    for item, text in benchmark.toLocalIterator():
        names.append(item)
        texts.append(text)
        size += len((text or "").encode("utf-8", "surrogatepass"))
        if size >= block_bytes:
            yield Block(names, texts, width)
            names, texts, size = [], [], 0
    yield Block(names, texts, width)


def _scan(compiled) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = compiled.value
        groups, names = block.groups, block.names
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                data, offsets = flat(part.column("text"))
                w = Words(data, offsets, ALNUM)
                edge = np.zeros(len(w) + 1, np.int32)
                seen = []
                for g in groups:
                    at, which = g.find(w, block.words)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + g.m, -1)
                    text = np.searchsorted(w.first, at, side="right") - 1
                    seen += zip(text.tolist(), g.items[which].tolist(), strict=True)
                hit = np.cumsum(edge[:-1]) > 0
                total = np.concatenate([[0], np.cumsum(hit)])
                items: list[list[str]] = [[] for _ in range(j - i)]
                spans: list[list[dict]] = [[] for _ in range(j - i)]
                for t, k in set(seen):
                    if names[k] is not None:
                        items[t].append(names[k])
                    spans[t] = spans[t] or _runs(hit[w.first[t] : w.first[t + 1]])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "items", "spans"],
                )

    return run


def _runs(hit: np.ndarray) -> list[dict]:
    step = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return [{"first": int(a), "last": int(b) - 1} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Occurrences of benchmark windows in documents: doc_id, n_words, n_hit, items, spans of words.

    A window is `width` consecutive words of an item, or all of a shorter item; a document's word is hit
    if it stands inside an occurrence of any window. items: the sorted ids, as strings, of the items with
    an occurring window. One row goes out for each row that comes in; repeated rows give repeated rows.
    Null and empty texts have no words and no hits; an item without words has no windows; an item whose
    id is null marks words but has no name to report. Other columns of either table are ignored.

    The benchmark is a query set: it is compiled in blocks of block_bytes of text, each broadcast, about ten times
    that in memory. One block needs no shuffle. More blocks are searched one after the other, the results stored, and
    merged by row at the end.
    """
    spark = docs.sparkSession
    texts = texts_of(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()
    bench = benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{item_text_col}`").cast("string"))
    rest = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"
    blocks = _blocks(bench, width, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return texts.mapInArrow(tidied(_scan(spark.sparkContext.broadcast(block))), f"doc_id {kind}, {rest}")
    rows = with_rows(texts, "rid").select(F.struct("rid", "doc_id").alias("doc_id"), "text")
    parts = None
    while block is not None:
        held = spark.sparkContext.broadcast(block)
        found = stored(rows.mapInArrow(tidied(_scan(held)), f"doc_id struct<rid:long,doc_id:{kind}>, {rest}"), "block-hits")
        held.unpersist()
        parts = found if parts is None else parts.unionByName(found)
        block, more = more, next(blocks, None) if more is not None else None
    merged = parts.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return merged.select("doc_id.doc_id", "n_words", "items", "spans").mapInArrow(tidied(_united), f"doc_id {kind}, {rest}")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose spans, of several blocks, are united and counted."""
    for batch in batches:
        spans = []
        for own in batch.column("spans").to_pylist():
            done: list[dict] = []
            for s in sorted(own, key=lambda s: s["first"]):
                if done and done[-1]["last"] >= s["first"] - 1:
                    done[-1]["last"] = max(done[-1]["last"], s["last"])
                else:
                    done.append(s)
            spans.append(done)
        hit = [sum(s["last"] - s["first"] + 1 for s in own) for own in spans]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(hit, pa.int64()), batch.column("items"), pa.array(spans, batch.column("spans").type)], names=["doc_id", "n_words", "n_hit", "items", "spans"])


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns whatever their names, in which decontaminate() hits no word."""
    rid = fresh(docs, "rid")
    own = with_rows(docs, rid)
    hit = stored(decontaminate(own, benchmark, rid, text_col, **options).filter("n_hit > 0").select(F.col("doc_id").alias(rid)), "hits")
    maybe, rest = split_marked(own, Marks(hit, rid), rid)
    return rest.unionByName(maybe.join(hit, rid, "left_anti").select(*[F.col(f"`{c}`") for c in rest.columns])).drop(rid)
