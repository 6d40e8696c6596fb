"""Token-id files with Re-Pair grammar compression.

A file (one shard of whole documents, in ascending id order) holds the rules of a grammar and one sequence of
symbols. Frequent pairs of symbols are replaced by nonterminals, again and again, until no pair occurs min_count
times; a round takes all pairs that are nearly as frequent as the most frequent one. Stored expansion lengths, and
the token at which every MARK-th symbol begins, give the place of any token range: the symbols that cover it are
found from the mark before it and their rules followed down to it, and nothing else is read.

Layout, little-endian: 4 bytes RPG2; u32 documents, rules, first nonterminal, bytes per symbol (2, 3 or 4); u64
symbols; then i64 document ids, u8 id is null, u64 tokens of each document, u32 left and u32 right symbol and
u32 expansion length of each rule, u64 marks, and the symbols.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, tidied
from .pieces import Encoder, Library, byte_names, gather, tokenizer_path

MAGIC = b"RPG2"
HEADER = struct.Struct("<4sIIIIQ")
END_ID = 1
#: Tokens after which a shard ends, at the end of a document.
SHARD_TOKENS = 1 << 20
#: A pair is frequent if it occurs so often in its shard: a rule takes 12 bytes, and each of its uses saves 2.
MIN_COUNT = 8
#: Symbols from one mark to the next.
MARK = 1024
_FLAG_BITS = 18


def _frequent(s: np.ndarray, least: int) -> np.ndarray:
    """Codes of the pairs to replace now: an eighth of the top count or more."""
    code = np.sort(_codes(s))
    edge = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    count = np.diff(np.append(edge, len(code)))
    top = int(count.max())
    if top < least:
        return code[:0]
    return code[edge[count >= max(least, top // 8)]]


def _codes(s: np.ndarray) -> np.ndarray:
    if s.dtype == np.uint16:
        return s[:-1].astype(np.uint32) << np.uint32(16) | s[1:]
    return s[:-1].astype(np.uint64) << np.uint64(32) | s[1:]


def _flags(code: np.ndarray) -> np.ndarray:
    if code.dtype == np.uint32:
        return code * np.uint32(0x9E3779B1) >> np.uint32(32 - _FLAG_BITS)
    return code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _FLAG_BITS)


def compress(ids: np.ndarray, least: int = MIN_COUNT) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(symbols, left, right, first nonterminal) of a grammar for ids."""
    first = int(ids.max()) + 1 if len(ids) else 0
    s = ids.astype(np.uint16 if first < 1 << 16 else np.uint32)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []
    rules = 0
    while len(s) > 1:
        chosen = _frequent(s, least)
        if not len(chosen):
            break
        half = 16 if s.dtype == np.uint16 else 32
        left.append((chosen >> half).astype(np.uint32))
        right.append((chosen & ((1 << half) - 1)).astype(np.uint32))
        if half == 16 and first + rules + len(chosen) > 1 << 16:  # more symbols than two bytes tell apart
            s, chosen, half = s.astype(np.uint32), left[-1].astype(np.uint64) << np.uint64(32) | right[-1], 32
        flag = np.zeros(1 << _FLAG_BITS, bool)
        flag[_flags(chosen)] = True
        code = _codes(s)
        at = np.flatnonzero(flag[_flags(code)])
        which = np.searchsorted(chosen, code[at])
        good = chosen[np.minimum(which, len(chosen) - 1)] == code[at]
        at, which = at[good], which[good]
        beside = np.concatenate([[False], at[1:] == at[:-1] + 1])  # overlapping pairs: every second one from the left
        head = np.flatnonzero(~beside)
        nth = np.arange(len(at)) - head[np.cumsum(~beside) - 1]
        at, which = at[nth % 2 == 0], which[nth % 2 == 0]
        s[at] = first + rules + which
        keep = np.ones(len(s), bool)
        keep[at + 1] = False
        s = s[keep]
        rules += len(chosen)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    return s, join(left), join(right), first


def lengths(left: np.ndarray, right: np.ndarray, first: int) -> np.ndarray:
    """How many ids each nonterminal stands for; rules use earlier rules only."""
    out = np.ones(first + len(left), np.int64)
    a, b = left.tolist(), right.tolist()
    size = [1] * first + [0] * len(a)
    for k in range(len(a)):
        size[first + k] = size[a[k]] + size[b[k]]
    out[first:] = size[first:]
    return out[first:]


def pack(doc_ids: list[int | None], sizes: np.ndarray, ids: np.ndarray, least: int = MIN_COUNT) -> bytes:
    """A file from documents' ids, one after the other."""
    s, left, right, first = compress(ids, least)
    length = lengths(left, right, first)
    top = first + len(left)
    width = 2 if top <= 1 << 16 else 3 if top <= 1 << 24 else 4
    upto = np.concatenate([np.ones(first, np.int64), length])[s].cumsum()
    marks = np.concatenate([[0], upto[MARK - 1 :: MARK]])[: -(-len(s) // MARK)]
    head = HEADER.pack(MAGIC, len(doc_ids), len(left), first, width, len(s))
    keys = np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.asarray(sizes, "<u8")
    symbols = np.ascontiguousarray(s.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width])
    return b"".join([head, *(x.tobytes() for x in (*keys, left, right, length.astype("<u4"), marks.astype("<u8"), symbols))])


class File:
    """A packed file: its documents, and ids of any token range. Opening it expands nothing."""

    def __init__(self, blob: bytes):
        magic, n, rules, self.first, self.width, m = HEADER.unpack_from(blob)
        if magic != MAGIC or self.width not in (2, 3, 4):
            raise ValueError("not a Re-Pair token file")
        at = HEADER.size

        def take(dtype: str, k: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(blob, dtype, k, at)
            at += out.nbytes
            return out

        ids, null = take("<i8", n), take("u1", n)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, null, strict=True)]
        self.sizes = take("<u8", n).astype(np.int64)
        self.left, self.right, self.length = take("<u4", rules), take("<u4", rules), take("<u4", rules)
        self.marks = take("<u8", -(-m // MARK)).astype(np.int64)
        self.raw = take("u1", m * self.width).reshape(m, self.width)
        if at != len(blob):
            raise ValueError(f"{len(blob) - at} bytes are left over")
        if not np.array_equal(self.size(self.left) + self.size(self.right), self.length):
            raise ValueError("expansion lengths don't fit the rules")
        self.total = int(self.sizes.sum())
        last = max(0, (m - 1) // MARK * MARK)
        if (int(self.marks[-1]) + int(self.size(self.symbols(last, m)).sum()) if m else 0) != self.total:
            raise ValueError("the symbols don't expand to the documents' tokens")

    def symbols(self, a: int, b: int) -> np.ndarray:
        out = np.zeros((max(0, min(b, len(self.raw)) - a), 4), np.uint8)
        out[:, : self.width] = self.raw[a:b]
        return out.view("<u4").ravel()

    def size(self, symbol: np.ndarray) -> np.ndarray:
        """Ids that each symbol stands for, as stored."""
        out = np.ones(len(symbol), np.int64)
        rule = symbol >= self.first
        out[rule] = self.length[symbol[rule] - self.first]
        return out

    def tokens(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop of the shard: rules are followed down to this range only."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        a = max(0, int(np.searchsorted(self.marks, start, side="right")) - 1)
        b = int(np.searchsorted(self.marks, stop, side="left"))
        symbol = self.symbols(a * MARK, b * MARK)
        size = self.size(symbol)
        place = self.marks[a] + np.cumsum(size) - size
        while True:
            near = (place < stop) & (place + size > start)
            symbol, place = symbol[near], place[near]
            rule = symbol >= self.first
            if not rule.any():
                return symbol
            k = symbol[rule] - self.first
            grown = 1 + rule.astype(np.int64)
            at = np.cumsum(grown) - grown
            new, where = np.repeat(symbol, grown), np.repeat(place, grown)
            new[at[rule]], new[at[rule] + 1] = self.left[k], self.right[k]
            where[at[rule] + 1] += self.size(self.left[k])
            symbol, place, size = new, where, self.size(new)

    def everything(self) -> np.ndarray:
        """All ids; each rule is expanded once."""
        table: list[list[int]] = []
        first = self.first
        for a, b in zip(self.left.tolist(), self.right.tolist(), strict=True):
            table.append((table[a - first] if a >= first else [a]) + (table[b - first] if b >= first else [b]))
        flat = np.concatenate([np.arange(first), np.fromiter(itertools.chain.from_iterable(table), np.int64, int(self.length.sum()))]).astype(np.uint32)
        size = np.concatenate([np.ones(first, np.int64), self.length.astype(np.int64)])
        begin = np.cumsum(size) - size
        s = self.symbols(0, len(self.raw))
        return gather(flat, begin[s], size[s])

    def document(self, k: int) -> np.ndarray:
        start = int(self.sizes[:k].sum())
        return self.tokens(start, start + int(self.sizes[k]))


class Model:
    """Ids by the tokenizers library; each distinct pre-token is given to its model once."""

    def __init__(self, path: str):
        self.model = Library(path).tokenizer.model
        self.names = {k: n for k, n in enumerate(byte_names())}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        names, tokenize = self.names, self.model.tokenize
        out = [[t.id for t in tokenize(w.encode("utf-8", "surrogateescape").decode("latin-1").translate(names))] for w in words]
        size = np.array([len(x) for x in out], np.int64)
        return np.fromiter(itertools.chain.from_iterable(out), np.uint32, int(size.sum())), size


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    path = tokenizer_path(path)
    if path not in _encoders:
        _encoders[path] = Encoder(path, Model(path), 1_000_000)
    return _encoders[path]


FILES = "part int, seq int, n_docs long, n_tokens long, base long, file binary"


def write_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Token files of every whole text in ascending id order, as a stored table: part, seq, n_docs, n_tokens, base, file.

    Ids must be integers (null comes first); of rows with equal ids the texts' order decides. Null and
    empty texts hold the end id alone. A shard ends with the document that fills it; base counts the
    tokens before it in its part, and parts are in id order. Rows are dealt by id range, so no task holds
    more than its range however texts or sources repeat.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part = encoder(path), TaskContext.get().partitionId()
        held: list = []
        seq = base = 0

        def shard() -> pa.RecordBatch:
            nonlocal seq, base
            keys, sizes, ids = (list(x) for x in zip(*held, strict=True))
            keys, sizes, ids = list(itertools.chain.from_iterable(keys)), np.concatenate(sizes), np.concatenate(ids)
            n = int(sizes.sum())
            row = {"part": part, "seq": seq, "n_docs": len(keys), "n_tokens": n, "base": base, "file": pack(keys, sizes, ids)}
            seq, base = seq + 1, base + n
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("base", pa.int64()), ("file", pa.binary())])
        size = 0
        for batch in batches:
            for i, j in slices(batch.column("text"), min(1 << 20, 2 * shard_tokens)):
                ids, count = e.encode([t or "" for t in batch.column("text").slice(i, j - i).to_pylist()])
                ids = np.insert(ids.astype(np.uint32), np.cumsum(count), end_id)
                held.append((batch.column("doc_id").slice(i, j - i).to_pylist(), count + 1, ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield shard()
                    size = 0
        if held:
            yield shard()

    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(tidied(run), FILES), "token-files")


def read_files(files: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row for each part of the table, never more than the partitions that wrote it
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, base in zip(batch.column("file"), batch.column("start").to_pylist(), strict=True):
                f = File(blob.as_py())
                ids = f.everything().astype("<u4")
                ends = np.cumsum(f.sizes)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip((ends - f.sizes).tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(f.doc_ids, pa.int64()), pa.array(base + ends - f.sizes), pa.array(f.sizes), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    placed = files.join(F.broadcast(offsets), "part").select((F.col("offset") + F.col("base")).alias("start"), "file")
    return placed.mapInArrow(tidied(run), "doc_id long, start long, n_tokens long, ids_crc32 long")
