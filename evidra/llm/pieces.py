"""Pre-tokens of many texts at once, for a tokenizer of the word_bpe kind: NFC, lower case, then the pattern
's|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+ over code points as one array. Each distinct
pre-token is encoded once per worker; its ids are found by 64-bit hash, its letters are compared, and texts are put
together from them. A text with a code point that Python's Unicode tables don't know is cut by the tokenizer's own
normalizer and pre-tokenizer, whose tables may be newer."""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np

from .words import word_hash

OTHER, LETTER, NUMBER, SPACE, NEWER = 0, 1, 2, 3, 4
#: Code points with the Unicode property White_Space.
WHITE = [9, 10, 11, 12, 13, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What the pattern takes after an apostrophe, in its order.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Distinct pre-tokens that a worker keeps before it starts anew.
KEEP = 200_000

_kinds: list[np.ndarray] = []


def kinds() -> np.ndarray:
    """Class of every code point."""
    if not _kinds:
        category = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((NEWER if (name := unicodedata.category(chr(c))) == "Cn" else category.get(name[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        table[WHITE] = SPACE
        _kinds.append(table)
    return _kinds[0]


def normal(text: str) -> str:
    """NFC, then lower case one code point at a time (so a final sigma has no form of its own)."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("Σ", "σ").lower()


def split(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(all normalised text, its code points, starts, ends, hashes, first pre-token of each text and their number,
    texts with code points that the tables don't know)."""
    ready = [normal(t) for t in texts]
    whole = " ".join(ready) + " "
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds()[points]
    begin = np.cumsum([0] + [len(t) + 1 for t in ready])
    newer = np.unique(np.searchsorted(begin, np.flatnonzero(kind == NEWER), side="right") - 1).tolist() if kind.max(initial=0) == NEWER else []
    change = np.empty(len(kind), bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= kind == NUMBER
    for a in np.flatnonzero((points == 0x27) & change).tolist():  # rare: an apostrophe at a token's start
        while True:
            rest = whole[a + 1 : a + 3]
            c = next((c for c in CONTRACTIONS if rest.startswith(c)), None)
            if c is None:
                break
            change[a + 1 : a + 1 + len(c)] = False
            a += 1 + len(c)
            change[a] = True  # what follows starts anew
            if points[a] != 0x27:
                break
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], len(kind))
    solid = kind[starts] != SPACE
    starts, ends = starts[solid], ends[solid]
    return whole, points, starts, ends, word_hash(points, starts, ends), np.searchsorted(starts, begin), newer


class Kept:
    """hash -> slot, open addressing over arrays; slots count up in the order of entry."""

    def __init__(self, bits: int = 16):
        self.bits, self.n = bits, 0
        self.keys, self.slots = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slot of each hash, -1 where it has none."""
        mask = (1 << self.bits) - 1
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = self.slots[at]
        todo = np.flatnonzero((out >= 0) & (self.keys[at] != h))
        at = at[todo]
        while len(todo):
            at = (at + 1) & mask
            out[todo] = self.slots[at]
            go = (out[todo] >= 0) & (self.keys[at] != h[todo])
            todo, at = todo[go], at[go]
        return out

    def add(self, h: np.ndarray) -> None:
        """Distinct hashes without a slot get the next ones."""
        while (self.n + len(h)) * 2 > len(self.keys):
            keys, slots = self.keys[self.slots >= 0], self.slots[self.slots >= 0]
            self.bits += 1
            self.keys, self.slots = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
            self._put(keys, slots)
        self._put(h, np.arange(self.n, self.n + len(h), dtype=np.int32))
        self.n += len(h)

    def _put(self, h: np.ndarray, slots: np.ndarray) -> None:
        mask, at = (1 << self.bits) - 1, (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.slots[at] < 0
            self.slots[at[free]] = slots[free]
            won = free & (self.slots[at] == slots)
            self.keys[at[won]] = h[won]
            h, slots, at = h[~won], slots[~won], (at[~won] + 1) & mask


def gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """values[begin:begin+size] of each entry, one after the other."""
    total = int(size.sum())
    kind = np.int32 if len(values) + total < 1 << 31 else np.int64
    at = np.repeat((begin - (np.cumsum(size) - size)).astype(kind), size)
    at += np.arange(total, dtype=kind)
    return values[at]


class Encoder:
    """Ids of texts. encode_new(words) -> (ids of all, ids of each) does the work for unseen pre-tokens."""

    def __init__(self, path: str, encode_new: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = KEEP):
        self.keep, self.path, self.special, self.encode_new, self.library = keep, path, special_tokens(path), encode_new, None
        self.clear()

    def clear(self) -> None:
        self.kept = Kept()
        self.ids, self.used = np.zeros(1 << 16, np.uint16), 0
        self.begin, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)
        self.letters, self.lettered = np.zeros(1 << 16, np.uint32), 0
        self.at, self.length = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32)

    def learn(self, whole: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> None:
        new, first = np.unique(h, return_index=True)
        starts, ends = starts[first], ends[first]
        ids, size = self.encode_new([whole[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
        if len(ids) and int(ids.max()) >= 1 << 16 and self.ids.dtype == np.uint16:
            self.ids = self.ids.astype(np.uint32)
        letters = gather(points, starts, ends - starts)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.lettered + len(letters) > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.letters[self.lettered : self.lettered + len(letters)] = letters
        n = self.kept.n
        while n + len(new) > len(self.begin):
            self.begin, self.size, self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.size, self.at, self.length))
        self.begin[n : n + len(new)] = self.used + np.cumsum(size) - size
        self.size[n : n + len(new)] = size
        self.at[n : n + len(new)] = self.lettered + np.cumsum(ends - starts) - (ends - starts)
        self.length[n : n + len(new)] = ends - starts
        self.used += len(ids)
        self.lettered += len(letters)
        self.kept.add(new)

    def same(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Whether each pre-token has the letters of its slot."""
        size = ends - starts
        ok = self.length[slot] == size
        if ok.all() and len(ok):
            equal = gather(points, starts, size) == gather(self.letters, self.at[slot], size)
            return ok if equal.all() else np.logical_and.reduceat(equal, np.cumsum(size) - size)
        for k in np.flatnonzero(ok).tolist():  # two pre-tokens of one hash: hardly ever
            ok[k] = np.array_equal(points[starts[k] : ends[k]], self.letters[self.at[slot[k]] :][: size[k]])
        return ok

    def plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, and how many each text has."""
        if not texts:
            return np.zeros(0, np.uint16), np.zeros(0, np.int64)
        if self.kept.n > self.keep:
            self.clear()
        whole, points, starts, ends, h, first, newer = split(texts)
        if newer:
            return self.newer(texts, newer)
        slot = self.kept.find(h)
        missing = slot < 0
        if missing.any():
            self.learn(whole, points, starts[missing], ends[missing], h[missing])
            slot[missing] = self.kept.find(h[missing])
        size, begin, ids = self.size[slot].astype(np.int64), self.begin[slot], self.ids
        other = np.flatnonzero(~self.same(points, starts, ends, slot))
        if len(other):
            more, size[other] = self.encode_new([whole[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist(), strict=True)])
            begin[other] = self.used + np.cumsum(size[other]) - size[other]
            ids = np.concatenate([self.ids[: self.used].astype(np.uint32), more.astype(np.uint32)])
        upto = np.concatenate([[0], np.cumsum(size)])
        return gather(ids, begin, size), np.diff(upto[first])

    def newer(self, texts: list[str], which: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """plain() where some texts are cut by the tokenizer itself."""
        if self.library is None:
            self.library = Library(self.path)
        chosen = set(which)
        ids, count = self.plain(["" if k in chosen else t for k, t in enumerate(texts)])
        place = np.cumsum(count)
        own = [self.encode_new(list(self.library.split(texts[k])))[0].astype(np.uint32) for k in which]
        size = np.array([len(x) for x in own], np.int64)
        out = np.insert(ids.astype(np.uint32), np.repeat(place[which], size), np.concatenate(own))
        count[which] = size
        return out, count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts, one after the other, and how many each has. The strings of special tokens become their ids."""
        marked = [k for k, t in enumerate(texts) if any(s in t for s in self.special)]
        if not marked:
            return self.plain(texts)
        parts: list[str] = []
        owner: list[int] = []
        fixed: list[int] = []  # id that follows the part, or -1
        ks = set(marked)
        for k, t in enumerate(texts):
            if k not in ks:
                parts.append(t), owner.append(k), fixed.append(-1)
                continue
            while t is not None:
                at, s = min(((t.find(s), s) for s in self.special if s in t), default=(-1, None))
                parts.append(t if s is None else t[:at]), owner.append(k), fixed.append(-1 if s is None else self.special[s])
                t = None if s is None else t[at + len(s) :]
        ids, size = self.plain(parts)
        after = np.array(fixed)
        out = np.insert(ids.astype(np.uint32), np.cumsum(size)[after >= 0], after[after >= 0])
        return out, np.bincount(owner, weights=size + (after >= 0), minlength=len(texts)).astype(np.int64)


def byte_names() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 up."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {b: chr(b) for b in own}
    for k, b in enumerate(b for b in range(256) if b not in names):
        names[b] = chr(256 + k)
    return [names[b] for b in range(256)]


class Library:
    """The tokenizers library's parts of one file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.byte = {n: k for k, n in enumerate(byte_names())}

    def split(self, text: str) -> Iterator[str]:
        """The pre-tokens of a text, as the library cuts it."""
        for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text)):
            yield bytes(self.byte[c] for c in piece).decode("utf-8", "surrogateescape")


def special_tokens(path: str) -> dict[str, int]:
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}


def tokenizer_path(path: str | None) -> str:
    """The tokenizer file on this machine: the one named, or the public word_bpe_49k.json."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
