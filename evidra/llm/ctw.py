"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions, each with its own context tree over the preceding bytes. Every node has a
Krichevsky-Trofimov estimate from its counts of zeros and ones, and a weighted probability that mixes the
estimate with the product of its children's. Counts of all training texts are gathered as byte (DEPTH+1)-grams, and
every context that occurs is a node, at every depth. With the counts fixed, the mixture of a path is one probability
for each (context, byte), and a text's code length is their sum.

The tree is never in one place. All grams behind the same two bytes are in one bucket, which has whole trees below
them; what lies above is 256 contexts and the root, of fixed size. A bounded number of the most frequent grams
(HEADS) have their probabilities at hand where the text is; a text's other grams meet their bucket by a join, those
that no training text has as well: a gram without counts changes nothing in the tree that it is added to.

Words of the unigram base are counted by 64-bit hash. Words that make up at least one 2**WORD_BITS-th of the
tokens, a bounded number, are looked up where the text is; the others' counts come by a join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, flat, slices, small_batches, stored, tidied
from .langid import held_out
from .pieces import Kept
from .words import LOWER, SOLID, Words

DEPTH = 5
#: Bytes of context that all grams of a bucket's trees have in common.
BASE = 2
#: Grams whose probabilities every task has at hand; the others' come by a join.
HEADS = 1 << 19
#: A head makes up at least one 2**HEAD_BITS-th of the training bytes.
HEAD_BITS = 24
#: Grams that a task holds before it sends them to their buckets.
HELD = 1 << 20
#: Grams that a bucket answers at once.
ASKED = 1 << 22
#: Grams of one row of a bucket.
ROW_GRAMS = 1 << 17
WORD_BITS = 20
#: Hash that stands for a text's end among the words.
END_WORD = 0x5851F42D4C957F2D
WORDS, GRAMS, TOTALS, TOP, HEAD = range(5)


def code_of(data: np.ndarray, offsets: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """At each byte the gram of it (lowest) and the `depth` bytes before it in its text; NUL stands before the text."""
    code = data.astype(np.uint64)
    begin = offsets[:-1]
    for k in range(1, depth + 1):
        before = np.zeros(len(data), np.uint64)
        before[k:] = data[: len(data) - k]
        for j in range(k):
            at = begin + j
            before[at[at < len(data)]] = 0
        code |= before << np.uint64(8 * k)
    return code


def tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, their counts summed)."""
    if counts is None:
        keys = np.sort(keys)
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        return keys[edge], np.diff(np.append(edge, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[edge], np.add.reduceat(counts, edge) if len(edge) else counts


class Tally:
    """Counts of keys from many batches; partial counts are merged as they grow."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = self.base = 0

    def add(self, keys: np.ndarray) -> None:
        self.parts.append(tally(keys))
        self.held += len(self.parts[-1][0])
        if self.held > 2 * self.base + (2 << 20):
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        if len(self.parts) != 1:
            self.parts = [tally(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))] if self.parts else [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        self.held = self.base = len(self.parts[0][0])
        return self.parts[0]


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of each gram, by the last two bytes of its context."""
    return (((keys >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _prepared(column: pa.Array) -> tuple[Words, np.ndarray, np.ndarray]:
    """(words, lower-cased bytes with a NUL after each text, offsets)."""
    data, offsets = flat(column)
    w = Words(data, offsets, SOLID)
    low = w.low.copy()
    low[offsets[1:] - 1] = 0
    return w, low, offsets


def _gather(buckets: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Tally(), Tally()
        n_bytes = n_tokens = n_texts = 0
        for batch in batches:
            column = batch.column("text")
            for i, j in slices(column):
                w, low, offsets = _prepared(column.slice(i, j - i))
                words.add(w.hash)
                grams.add(code_of(low, offsets, depth))
                n_bytes, n_tokens, n_texts = n_bytes + len(low), n_tokens + len(w) + j - i, n_texts + j - i
        if not n_texts:
            return
        rows = [(TOTALS, 0, n_bytes, n_tokens, b"", b"")]
        words.parts.append((np.array([END_WORD], np.uint64), np.array([n_texts])))
        for kind, t, bucket in ((WORDS, words, lambda k: (k % np.uint64(buckets)).astype(np.int64)), (GRAMS, grams, lambda k: bucket_of(k, buckets))):
            keys, counts = t.merge()
            of = bucket(keys)
            order = np.argsort(of, kind="stable")
            at = np.searchsorted(of[order], np.arange(buckets + 1))
            keys, counts = keys[order], counts[order]
            rows += [(kind, b, 0, 0, keys[at[b] : at[b + 1]].tobytes(), counts[at[b] : at[b + 1]].astype(np.int64).tobytes()) for b in range(buckets) if at[b] < at[b + 1]]
        for k in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[k : k + 64], strict=True), (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["kind", "bucket", "n_bytes", "n_tokens", "keys", "counts"])

    return run


def lgamma(x: np.ndarray) -> np.ndarray:
    """log gamma of positive numbers, by Stirling's series beyond 8."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


_SMALL = 1 << 14
_HALF, _WHOLE = (np.array([math.lgamma(n + x) for n in range(_SMALL)]) for x in (0.5, 1.0))


def _lgamma_of(n: np.ndarray, table: np.ndarray, more: float) -> np.ndarray:
    """log gamma of whole numbers and `more`."""
    out = table[np.minimum(n, _SMALL - 1).astype(np.int64)]
    large = n >= _SMALL
    out[large] = lgamma(n[large] + more)
    return out


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """log of the Krichevsky-Trofimov probability of any sequence with these counts."""
    return _lgamma_of(zeros, _HALF, 0.5) + _lgamma_of(ones, _HALF, 0.5) - _lgamma_of(zeros + ones, _WHOLE, 1.0) - np.log(np.pi)


def _weighed(zeros: np.ndarray, ones: np.ndarray, split: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log of the weighted probability, weight of the KT estimate, probability of a one) of nodes; split: the log of
    the product of their children's weighted probabilities, None for leaves."""
    own, one = kt(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
    if split is None:
        return own, np.ones(len(own)), one
    log_w = np.logaddexp(own, split) - np.log(2)
    return log_w, np.exp(own - np.log(2) - log_w), one


def _node(code: np.ndarray, d: int, k: int) -> np.ndarray:
    """Number of the node that has the first k bits of each gram's byte behind d bytes of context."""
    context = code >> np.uint64(8) & np.uint64((1 << 8 * d) - 1)
    return (context << np.uint64(8) | np.uint64(1 << k) | (code & np.uint64(255)) >> np.uint64(8 - k)).astype(np.int64)


class Subtrees:
    """The trees behind BASE bytes of context, of distinct grams in order; grams may have a count of 0."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, depth: int):
        self.levels, self.parents = [(keys, counts.astype(float))], []
        for d in range(depth - 1, BASE - 1, -1):
            low, up = np.unique(self.levels[-1][0] & np.uint64((1 << 8 * (d + 1)) - 1), return_inverse=True)
            self.levels.append((low, np.bincount(up, weights=self.levels[-1][1], minlength=len(low))))
            self.parents.append(up)

    def walk(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For the grams at `wanted`, the probability of each bit of their byte as the nodes here mix it; for all nodes
        behind one byte of context, the sum of the logs of the weighted probabilities below; counts of (context, byte)."""
        out, under = np.empty((len(wanted), 8)), np.zeros(1 << 16)
        last = self.levels[-1][0]
        for k in range(8):
            bit = (self.levels[0][0][wanted] >> np.uint64(7 - k) & np.uint64(1)).astype(bool)
            cell, q, log_w, edge = wanted, None, None, None
            nodes = []
            for i, (code, n) in enumerate(self.levels):
                key = code >> np.uint64(8 - k)
                new = np.concatenate([[True], key[1:] != key[:-1]])
                at = np.cumsum(new) - 1
                split = np.bincount(at[self.parents[i - 1][edge]], weights=log_w, minlength=at[-1] + 1) if i else None
                edge = np.flatnonzero(new)
                ones = np.add.reduceat(n * (code >> np.uint64(7 - k) & np.uint64(1)), edge)
                log_w, weight, one = _weighed(np.add.reduceat(n, edge) - ones, ones, split)
                nodes.append((at, weight, one))
            under += np.bincount(_node(last[edge], BASE - 1, k), weights=log_w, minlength=len(under))
            for i, (at, weight, one) in enumerate(nodes):
                node = at[cell]
                own = np.where(bit, one[node], 1 - one[node])
                q = own if q is None else weight[node] * own + (1 - weight[node]) * q
                if i < len(self.parents):
                    cell = self.parents[i][cell]
            out[:, k] = q
        return out, under, np.bincount((last & np.uint64(0xFFFF)).astype(np.int64), weights=self.levels[-1][1], minlength=1 << 16)


class Top:
    """The root and the contexts of one byte: the weight of each node's KT estimate and its probability of a one."""

    def __init__(self, under: np.ndarray, counts: np.ndarray):
        self.weight, self.one = [np.zeros(1 << 8), np.zeros(1 << 16)], [np.zeros(1 << 8), np.zeros(1 << 16)]
        for k in range(8):
            at = (np.arange(256)[:, None] << 8 | 1 << k | np.arange(1 << k)).ravel()
            n = counts.reshape(256, 1 << k, 2, -1).sum(-1)
            log_w, self.weight[1][at], self.one[1][at] = _weighed(*n.reshape(-1, 2).T, under[at])
            root = 1 << k | np.arange(1 << k)
            _, self.weight[0][root], self.one[0][root] = _weighed(*n.sum(0).T, log_w.reshape(256, -1).sum(0))

    def log10(self, code: np.ndarray, q: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each gram, from its bits' probabilities as Subtrees has them."""
        out = np.zeros(len(code))
        for k in range(8):
            bit, p = (code >> np.uint64(7 - k) & np.uint64(1)).astype(bool), q[:, k].astype(float)
            for d in (1, 0):
                node = _node(code, d, k)
                one, weight = self.one[d][node], self.weight[d][node]
                p = weight * np.where(bit, one, 1 - one) + (1 - weight) * p
            out += np.log10(p)
        return out


def answers(keys: np.ndarray, counts: np.ndarray, asked: np.ndarray, top: Top, depth: int) -> np.ndarray:
    """log10 probability of the byte of each distinct gram asked for, in order; keys are all training grams behind the
    same bytes, in order."""
    both, sums = tally(np.concatenate([keys, asked]), np.concatenate([counts, np.zeros(len(asked), np.int64)]))
    return top.log10(asked, Subtrees(both, sums, depth).walk(np.searchsorted(both, asked))[0]) if len(both) else np.zeros(0)


class Tree:
    """The weighted trees of a counted corpus in one place; grams are those of every depth."""

    def __init__(self, grams: list[tuple[np.ndarray, np.ndarray]]):
        self.depth, (self.keys, self.counts) = len(grams) - 1, grams[-1]
        self.top = Top(*Subtrees(self.keys, self.counts, self.depth).walk(np.zeros(0, np.int64))[1:])

    def log10(self, code: np.ndarray) -> np.ndarray:
        """log10 probability of the byte of each gram; any gram will do."""
        asked, back = np.unique(code, return_inverse=True)
        return answers(self.keys, self.counts, asked, self.top, self.depth)[back]


_MERGED = "kind int, bucket int, key long, n long, w double, keys binary, data binary"


def _merge(least: int, depth: int):
    """Words with their counts; grams of a bucket, what its trees add to the nodes above, and its frequent grams with
    their bits' probabilities, by the logarithm of their counts."""

    def rows(kind: int, bucket: int = 0, key=0, n=0, w=0.0, keys: list | None = None, data: list | None = None) -> pd.DataFrame:
        return pd.DataFrame({"kind": np.int32(kind), "bucket": np.int32(bucket), "key": key, "n": n, "w": w, "keys": keys, "data": data})

    def run(parts: pd.DataFrame) -> pd.DataFrame:
        kind, bucket = int(parts["kind"].iloc[0]), int(parts["bucket"].iloc[0])
        t = Tally()
        for k, c in zip(parts["keys"], parts["counts"], strict=True):
            t.parts.append((np.frombuffer(k, np.uint64), np.frombuffer(c, np.int64)))
            t.held += len(t.parts[-1][0])
            if t.held > 2 * t.base + (2 << 20):
                t.merge()
        keys, counts = t.merge()
        if kind == WORDS:
            return rows(kind, key=keys.view(np.int64), n=counts)
        often = np.flatnonzero(counts >= least)
        q, under, bytes_ = Subtrees(keys, counts, depth).walk(often)
        cut = range(0, len(keys), ROW_GRAMS)
        out = [rows(GRAMS, bucket, keys=[keys[a : a + ROW_GRAMS].tobytes() for a in cut], data=[counts[a : a + ROW_GRAMS].astype(np.int64).tobytes() for a in cut], key=[0] * len(cut))]
        node = np.flatnonzero((under != 0) | (bytes_ != 0))
        out.append(rows(TOP, key=node, n=bytes_[node].astype(np.int64), w=under[node]))
        size = (4 * np.log2(counts[often])).astype(np.int64)
        for x in np.unique(size).tolist():
            own = size == x
            out.append(rows(HEAD, key=[x], n=int(own.sum()), keys=[keys[often[own]].tobytes()], data=[q[own].astype(np.float32).tobytes()]))
        return pd.concat(out)

    return run


class Scorer:
    """Code lengths of texts from the grams at hand, and the grams that aren't."""

    def __init__(self, codes: np.ndarray, values: np.ndarray, depth: int):
        self.depth, self.bits = depth, max(4, (2 * len(codes)).bit_length())
        self.keys, self.values = np.full(1 << self.bits, (1 << 64) - 1, np.uint64), np.zeros(1 << self.bits)
        slot = self._slot(codes)
        self.keys[slot] = codes  # the later ones, which are more frequent, stay
        mine = self.keys[slot] == codes
        self.values[slot[mine]] = values[mine]

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probability of each text with its end, but for the grams left out; these, and their texts."""
        code = code_of(low, offsets, self.depth)
        slot = self._slot(code)
        value = self.values[slot]
        miss = np.flatnonzero(self.keys[slot] != code)
        value[miss] = 0
        return np.add.reduceat(value, offsets[:-1]), code[miss], np.searchsorted(offsets, miss, side="right") - 1


def _asked(held: list, buckets: int, doc_type: pa.DataType) -> pa.RecordBatch:
    """Rows of (first rid, grams, their rids after the first) for each bucket."""
    keys, rids = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(keys)
    keys, rids = keys[order], rids[order]
    of = bucket_of(keys, buckets)
    order = np.argsort(of, kind="stable")
    keys, rids, of, base = keys[order], rids[order], of[order], int(rids.min())
    edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
    after = (rids - base).astype(np.uint64)
    columns = {
        "rid": pa.array([base] * len(edge), pa.int64()), "bucket": pa.array(of[edge], pa.int32()),
        "keys": pa.array([keys[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(of)], strict=True)], pa.binary()),
        "data": pa.array([after[a:b].tobytes() for a, b in zip(edge, [*edge[1:], len(of)], strict=True)], pa.binary()),
    }
    kinds = {"doc_id": doc_type, "held_out": pa.bool_(), "base": pa.float64(), "score": pa.float64(), "rare": pa.list_(pa.int64())}
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(len(edge), kinds.get(c, pa.int64())) for c in _SCORED], names=_SCORED)


_SCORED = ["rid", "doc_id", "held_out", "n_tokens", "n_bytes", "n_known", "base", "score", "rare", "bucket", "keys", "data"]


def _score(model, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not hasattr(model, "ready"):  # a worker has one object for a broadcast, whatever the task
            codes, values, depth, heads, log_counts = model.value
            kept = Kept(max(4, (2 * len(heads)).bit_length()))
            kept.add(heads)
            model.ready = Scorer(codes, values, depth), kept, np.append(log_counts, 0.0)
        score, kept, log_counts = model.ready
        held: list = []
        n, doc_type = 0, None
        for batch in batches:
            doc_type = batch.column("doc_id").type
            for i, j in slices(batch.column("text"), 1 << 20):
                part = batch.slice(i, j - i)
                w, low, offsets = _prepared(part.column("text"))
                ends = w.first[1:]
                h = np.insert(w.hash, ends, np.uint64(END_WORD))
                size = np.diff(w.first) + 1
                begin = np.cumsum(size) - size
                slot = kept.find(h)
                known = slot >= 0
                rare = h[~known].view(np.int64)
                upto = np.concatenate([[0], np.cumsum(np.add.reduceat(~known, begin, dtype=np.int64))])
                own, left, text = score(low, offsets)
                held.append((left, part.column("rid").to_numpy()[text]))
                n += len(left)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in _SCORED[:3]), pa.array(size, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(np.add.reduceat(known, begin, dtype=np.int64)), pa.array(np.add.reduceat(log_counts[slot], begin)), pa.array(own), pa.LargeListArray.from_arrays(upto, pa.array(rare)).cast(pa.list_(pa.int64())), *(pa.nulls(j - i, t) for t in (pa.int32(), pa.binary(), pa.binary()))],
                    names=_SCORED,
                )
                if n >= HELD:
                    yield _asked(held, buckets, doc_type)
                    held, n = [], 0
        if n:
            yield _asked(held, buckets, doc_type)

    return run


def _answer(top, depth: int):
    """Sums of log10 probabilities by rid, of rows sorted by bucket: its grams, then what texts ask for."""

    def summed(trained: list, held: list) -> pa.RecordBatch:
        keys, rids = (np.concatenate(x) for x in zip(*held, strict=True))
        asked, back = np.unique(keys, return_inverse=True)
        own = [np.concatenate(x) for x in zip(*trained, strict=True)] if trained else [np.zeros(0, np.uint64), np.zeros(0, np.int64)]
        got = answers(*own, asked, top.value, depth)[back]
        rids, back = np.unique(rids, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array(rids), pa.array(np.bincount(back, weights=got, minlength=len(rids)))], names=["rid", "left"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, trained, held, n = None, [], [], 0
        for batch in batches:
            for own, rid, asked, keys, data in zip(*(batch.column(c).to_pylist() for c in ("bucket", "rid", "asked")), batch.column("keys"), batch.column("data"), strict=True):
                if held and (own != bucket or n >= ASKED):
                    yield summed(trained, held)
                    held, n = [], 0
                if own != bucket:
                    bucket, trained = own, []
                keys = np.frombuffer(keys.as_buffer(), np.uint64)
                if asked:
                    held.append((keys, np.frombuffer(data.as_buffer(), np.uint64).astype(np.int64) + rid))
                    n += len(keys)
                else:
                    trained.append((keys, np.frombuffer(data.as_buffer(), np.int64)))
        if held:
            yield summed(trained, held)

    return run


def _heads(merged: DataFrame, top: Top, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(grams, log10 probability of their byte) of at most `most` of the most frequent grams, the most frequent last."""
    rows = merged.filter(F.col("kind") == HEAD)
    least, n = 0, 0
    for size, count in sorted(rows.groupBy("key").agg(F.sum("n")).collect(), reverse=True):
        n += count
        if n > most:
            least = size + 1
            break
    table = rows.filter(F.col("key") >= least).select("key", "keys", "data").toArrow()
    codes, values = [np.zeros(0, np.uint64)], [np.zeros(0)]
    for k in np.argsort(table.column("key").to_numpy(), kind="stable").tolist():
        codes.append(np.frombuffer(table.column("keys")[k].as_buffer(), np.uint64))
        values.append(top.log10(codes[-1], np.frombuffer(table.column("data")[k].as_buffer(), np.float32).reshape(-1, 8)))
    return np.concatenate(codes), np.concatenate(values)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2, depth: int = DEPTH, heads: int = HEADS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Both models learn from the rows that aren't held out, over all their texts; A-Z count as a-z in both.
    score is the log10 probability of the lower-cased bytes and the end of the text, bits_per_byte the code length
    of these bytes, the end among them. Null texts are empty:
    one token, the end. Rows with equal ids are rows of their own. Without training rows every token is
    unknown and the byte model is uniform. Other columns are ignored. Every context of up to `depth` bytes (2 to 7) that
    the training texts have counts, whatever their size; heads is how many grams are looked up without a join.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    base = base.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * partitions
    parts = stored(base.filter("not held_out").select("text").mapInArrow(tidied(_gather(buckets, depth)), "kind int, bucket int, n_bytes long, n_tokens long, keys binary, counts binary"), "ctw-parts")
    n_bytes, n_tokens = (x or 0 for x in parts.filter(F.col("kind") == TOTALS).agg(F.sum("n_bytes"), F.sum("n_tokens")).first())
    merged = stored(parts.filter(F.col("kind") != TOTALS).groupBy("kind", "bucket").applyInPandas(_merge(max(1, n_bytes >> HEAD_BITS), depth), _MERGED), "ctw-counts")
    drop_stored(parts)
    words = merged.filter(F.col("kind") == WORDS)
    distinct = words.count()
    often = max(1, -(-n_tokens >> WORD_BITS))
    frequent = words.filter(F.col("n") >= often).select("key", "n").toArrow()
    nodes = merged.filter(F.col("kind") == TOP).groupBy("key").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toArrow()
    at = nodes.column("key").to_numpy()
    top = Top(*(np.bincount(at, weights=nodes.column(c).to_numpy(), minlength=1 << 16) for c in ("w", "n")))
    model = spark.sparkContext.broadcast((*_heads(merged, top, heads), depth, frequent.column("key").to_numpy().view(np.uint64), np.log10(frequent.column("n").to_numpy() + 1.0)))
    kind = docs.schema[id_col].dataType.simpleString()
    scored = stored(base.select("rid", "doc_id", "held_out", "text").mapInArrow(tidied(_score(model, buckets)), f"rid long, doc_id {kind}, held_out boolean, n_tokens long, n_bytes long, n_known long, base double, score double, rare array<long>, bucket int, keys binary, data binary"), "ctw-scored")
    rest = words.filter(F.col("n") < often).select("key", F.log10(F.col("n") + 1.0).alias("log_count"))
    rare = scored.select("rid", F.explode("rare").alias("key")).groupBy("rid", "key").count().join(rest, "key").groupBy("rid").agg(F.sum("count").alias("more"), F.sum(F.col("count") * F.col("log_count")).alias("rare_base"))
    asked = scored.filter("bucket is not null").select("bucket", "rid", F.lit(True).alias("asked"), "keys", "data")
    grams = merged.filter(F.col("kind") == GRAMS).select("bucket", F.lit(0).cast("long").alias("rid"), F.lit(False).alias("asked"), "keys", "data")
    left = grams.unionByName(asked).repartition(partitions, "bucket").sortWithinPartitions("bucket", "asked").mapInArrow(tidied(_answer(spark.sparkContext.broadcast(top), depth)), "rid long, left double").groupBy("rid").agg(F.sum("left").alias("left"))
    unit = float(np.log10(n_tokens + distinct + 1))
    score_ = F.col("score") + F.coalesce("left", F.lit(0.0))
    return scored.filter("bucket is null").join(rare, "rid", "left").join(left, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(unit)).alias("base_score"), score_.alias("score"),
        (score_ * F.lit(-math.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
