"""BPE encoding and decoding with a pair occurrence index.

The unseen pre-tokens of a partition's batch lie in one array of symbols, linked to those beside them in their
word. The index maps each pair, by its rank, to all positions at which it begins. The ranks that occur are active, and
are applied in ascending order, each at all its positions from left to right. A merge enters the new pairs on both
sides into their lists; a position whose pair has gone is skipped when its list's turn comes. Where a merge makes a
pair of a lower rank, that list is taken before the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, texts_of, tidied
from .pieces import Encoder, Kept, byte_names, gather, tokenizer_path
from .words import mix

NEVER = 1 << 40


class PairIndex:
    """Merges of a vocabulary, and the encoding of many words at once."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, model = spec["model"]["vocab"], spec["model"]
        suffix = model["end_of_word_suffix"] or ""
        names = byte_names()
        self.inner = np.array([vocab[n] for n in names], np.int64)
        self.last = np.array([vocab[n + suffix] for n in names], np.int64)
        #: Rank of each pair of symbols, and of each rank the pair and the symbol that it makes.
        self.rank: dict[int, int] = {}
        self.left, self.right, self.made = [], [], []
        for r, m in enumerate(model["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            self.rank[vocab[x] << 32 | vocab[y]] = r
            self.left.append(vocab[x]), self.right.append(vocab[y]), self.made.append(vocab[x + y])
        codes = np.array([*self.rank], np.uint64)
        self.known = Kept(18)
        self.known.add(mix(codes))  # mix() is one to one, so equal hashes are equal pairs
        self.rank_of = np.array([*self.rank.values(), NEVER], np.int64)
        self.strings = {i: s.encode() for s, i in vocab.items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}

    def positions(self, symbol: np.ndarray, word: np.ndarray) -> dict[int, list[int]]:
        """The index: of each rank that occurs, all positions at which its pair begins, from left to right."""
        at = np.flatnonzero(word[1:] == word[:-1])
        rank = self.rank_of[self.known.find(mix((symbol[at] << 32 | symbol[at + 1]).astype(np.uint64)))]
        at, rank = at[rank != NEVER], rank[rank != NEVER]
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        edge = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else np.zeros(0, np.int64)
        place = at.tolist()
        return {r: place[a:b] for r, a, b in zip(rank[edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(place)], strict=False)}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, ids of each word)."""
        data = [w.encode("utf-8", "surrogateescape") for w in words]
        size = np.array([len(x) for x in data], np.int64)
        if not size.sum():
            return np.zeros(0, np.int64), size
        raw = np.frombuffer(b"".join(data), np.uint8)
        first, word = self.inner[raw], np.repeat(np.arange(len(size)), size)
        ends = np.cumsum(size) - 1
        ends = ends[size > 0]
        first[ends] = self.last[raw[ends]]
        index = self.positions(first, word)
        symbol = first.tolist()
        after, before = np.arange(1, len(first) + 1), np.arange(-1, len(first) - 1)
        after[ends] = -1
        before[np.concatenate([[0], ends[:-1] + 1])] = -1
        after, before = after.tolist(), before.tolist()
        active = list(index)  # in ascending order, so a heap already
        rank = self.rank.get
        while active:
            r = heappop(active)
            left, right, made = self.left[r], self.right[r], self.made[r]
            places = index.pop(r)
            places.sort()
            for k, p in enumerate(places):
                q = after[p]
                if q < 0 or symbol[p] != left or symbol[q] != right:
                    continue  # a merge has taken one of the two
                symbol[p], symbol[q] = made, -1
                s = after[p] = after[q]
                after[q] = -1
                lowest = r
                if s >= 0:
                    before[s] = p
                    new = rank(made << 32 | symbol[s])
                    if new is not None:
                        lowest = min(lowest, new)
                        if new in index:
                            index[new].append(p)
                        else:
                            index[new] = [p]
                            heappush(active, new)
                o = before[p]
                if o >= 0:
                    new = rank(symbol[o] << 32 | made)
                    if new is not None:
                        lowest = min(lowest, new)
                        if new in index:
                            index[new].append(o)
                        else:
                            index[new] = [o]
                            heappush(active, new)
                if lowest < r and k + 1 < len(places):  # the merge made a pair of a lower rank, which comes first
                    index[r] = places[k + 1 :] + index.get(r, [])
                    heappush(active, r)
                    break
        out = np.array(symbol, np.int64)
        return out[out >= 0], np.bincount(word[out >= 0], minlength=len(size))


class Renderer:
    """Byte strings of ids, and their concatenation."""

    def __init__(self, strings: dict[int, bytes]):
        names = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        self.size = np.array([len(x) for x in names], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(names), np.uint8)

    def __call__(self, ids: np.ndarray, count: np.ndarray) -> tuple[bytes, np.ndarray]:
        """(strings of all ids, where those of each text begin, and the end)."""
        size = self.size[ids]
        upto = np.concatenate([[0], np.cumsum(size)])
        return gather(self.data, self.begin[ids], size).tobytes(), upto[np.concatenate([[0], np.cumsum(count)])]


class Coder:
    """encode() and decode() of one tokenizer file."""

    def __init__(self, path: str):
        self.index = PairIndex(path)
        self.encoder = Encoder(path, self.index.encode)
        self.numbers = Renderer({i: b"%d " % i for i in range(max(self.index.strings) + 1)})
        self.tokens = Renderer({i: s + b" " for i, s in self.index.strings.items()})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, count = self.encoder.encode(texts)
        return np.split(ids, np.cumsum(count)[:-1]) if texts else []

    def decode(self, ids: np.ndarray) -> str:
        return self.tokens(np.asarray(ids, np.int64), np.array([len(ids)]))[0][:-1].decode("utf-8", "surrogatepass")


_coders: dict[str, Coder] = {}


def coder(path: str | None = None) -> Coder:
    """This worker's coder of a tokenizer file."""
    path = tokenizer_path(path)
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """doc_id, ids array<int>, decoded string: the ids of every whole text and what they decode to.

    Null and empty texts have no ids and decode to the empty string. A row goes out for each row that
    comes in. Strings of the file's special tokens become their ids. Other columns are ignored.
    """
    texts = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                ids = c.encode([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32())), pa.array([c.decode(x) for x in ids])], names=["doc_id", "ids", "decoded"])

    return texts.mapInArrow(tidied(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded string")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of every whole text, and
    ids if asked for; as encode()."""
    texts = texts_of(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(path)
        sha = lambda data, at: [hashlib.sha256(data[a : max(a, b - 1)]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for batch in batches:
            for i, j in slices(batch.column("text")):
                part = batch.slice(i, j - i)
                ids, count = c.encoder.encode([t or "" for t in part.column("text").to_pylist()])
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(count, pa.int64()), "ids_sha256": pa.array(sha(*c.numbers(ids, count)), pa.string()), "decoded_sha256": pa.array(sha(*c.tokens(ids, count)), pa.string())}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(count)]).astype(np.int32), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    return texts.mapInArrow(tidied(run), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
