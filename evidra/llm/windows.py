"""Substring deduplication with compact windows.

For a hash function over word shingles, the Cartesian tree of a text's hashes gives compact windows (l, c, r):
every passage within l..r that holds c has the hash at c as its min-hash. An interval join of the compact windows
of two hash functions groups the passages of the shortest length into cells: runs of places at which a passage
may begin whose two min-hashes, and so whose signature, are the same. Near-duplicate passages share each signature
with a chance of about their similarity squared, equal ones for certain; BANDS pairs of functions give several.

Cells of one signature meet at a leader, the first in table order: each task pairs its cells with its own first
one, and the tasks' first ones meet by signature. So a signature's rows are as many as the flushes of all tasks at
most, and pairs as many as cells, whatever a text or a line repeats. A pair of texts is verified on the diagonals
of its anchors: runs of equal shingles are chained over gaps, and the longest passages from run to run that reach
the similarity count; where an insertion has moved the rest, runs of other diagonals are looked for.

A leader may share a line and no more. Therefore each pair gives back, for the cells of the first band, the
passages of the shortest length that the other side doesn't hold in that place, of its own text and of the leader;
these meet once more by the hash of the whole passage. So every repeat of min_words words is found: of two texts
that hold it, each either agrees with a leader that holds it, or both give it back.

Texts that are similar to one another and not to their leaders meet again as well. Cells that aren't copies of their
leader's come together once more by their anchors, the leaders' among them, if one is open: if its anchor is in no
passage found with its leader. Cells with equal shingles are a class. Each class brings its shingles along and is
compared with all earlier ones of the same anchors that it isn't linked with yet, directly or over others; sketches,
bitmaps of the shingles, tell for certain of most that they have too little in common. Places count, and different
shingles: a passage that repeats a few has many places in common with texts that aren't like it. So any two cells of the same
anchors that are alike are linked, and links are as many as cells, whatever a line or a group of near copies repeats.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Marks, drop_stored, fresh, scratch, settle, split_marked, stored, tidied, with_rows
from .shingles import WIDTH, numbered, sequences
from .words import ALNUM, Words, mix, span_hash

MIN_WORDS = 50
BANDS = 3
THRESHOLD = 0.8
#: Bits of a place within a cell; the shortest passage has fewer shingles than that.
PLACE_BITS = 10
#: Cells that a task holds before it pairs them and lets them go.
HELD = 1 << 20
#: Cells of the same anchors whose sketches are compared with all earlier ones' at once.
ALL = 256
#: Pairs of sketches that are compared at once.
BLOCK = 1 << 21
#: Shingles that are hashed at once.
HASHED = 1 << 20
#: 64-bit words of a sketch.
LANES = 4
#: Share of the shortest passage's shingles that both sides must have near an anchor to be looked at closely.
NEAR = 0.6
#: Share of what similar passages of t shingles have in common that cells must have to be looked at closely.
ALIKE = 0.95
ROWS = "key long, rid long, pos long, lead_rid long, lead_pos long"
_NAMES = [x.split(" ")[0] for x in ROWS.split(", ")]
_PLACE = (1 << PLACE_BITS) - 1
_FIRST_BAND = 1 << 3 * PLACE_BITS


def _packed(begin: np.ndarray, more: np.ndarray, c: np.ndarray, d: np.ndarray, first_band: bool) -> np.ndarray:
    """A cell as one number: its first place, how many follow, and both anchors."""
    return begin << 3 * PLACE_BITS + 1 | int(first_band) << 3 * PLACE_BITS | more << 2 * PLACE_BITS | c - begin << PLACE_BITS | d - begin


def _unpacked(pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first place, last place, anchors) of cells."""
    begin = pos >> 3 * PLACE_BITS + 1
    return begin, begin + (pos >> 2 * PLACE_BITS & _PLACE), begin + (pos >> PLACE_BITS & _PLACE), begin + (pos & _PLACE)


def _slide(x: np.ndarray, t: int, of) -> np.ndarray:
    """of() every t values side by side, by the place of the first."""
    span, y = 1, x
    while span * 2 <= t:
        y = of(y[:-span], y[span:])
        span *= 2
    n = len(x) - t + 1
    return of(y[:n], y[t - span : t - span + n])


def compact_windows(x: np.ndarray, first: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of windows of t or more values in concatenated texts; text k is first[k]:first[k+1].

    A place leads such a window only if it is the least of some t values side by side; the Cartesian
    tree is built of these places alone, which has the same windows.
    """
    n = len(x)
    none = np.zeros(0, np.int64)
    if n < t:
        return none, none, none
    least = _slide(x, t, np.minimum)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    least[text[: n - t + 1] != text[t - 1 :]] = 0  # these reach into the next text
    padded = np.concatenate([np.zeros(t - 1, np.uint64), least, np.zeros(t - 1, np.uint64)])
    places = np.flatnonzero((x == _slide(padded, t, np.maximum)) & (x != 0))
    lo, hi = first[text[places]], first[text[places] + 1]
    value, at = x[places].tolist(), places.tolist()
    left, right = lo.tolist(), (hi - 1).tolist()
    begin = left.copy()
    stack: list[int] = []
    for k, (v, p) in enumerate(zip(value, at, strict=True)):
        while stack and (at[stack[-1]] < begin[k] or value[stack[-1]] > v):
            top = stack.pop()
            if at[top] >= begin[k]:
                right[top] = p - 1
        if stack:
            left[k] = at[stack[-1]] + 1
        stack.append(k)
    left, right = np.array(left, np.int64), np.array(right, np.int64)
    wide = right - left + 1 >= t
    return left[wide], places[wide], right[wide]


def cells(x: np.ndarray, y: np.ndarray, first: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, c, d): passages of t values that begin at begin..end have the least x at c and the least y at d."""

    def places(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        l, c, r = compact_windows(v, first, t)
        return np.maximum(l, c - t + 1), np.minimum(c, r - t + 1), c

    (ba, ea, ca), (bb, eb, cb) = places(x), places(y)
    begin = np.union1d(ba, bb)
    i, j = np.searchsorted(ba, begin, side="right") - 1, np.searchsorted(bb, begin, side="right") - 1
    end = np.minimum(ea[i], eb[j])
    ok = (i >= 0) & (j >= 0) & (end >= begin)
    return begin[ok], end[ok], ca[i[ok]], cb[j[ok]]


def _batch(key: np.ndarray, rid: np.ndarray, pos: np.ndarray, lead_rid: np.ndarray | None = None, lead_pos: np.ndarray | None = None) -> pa.RecordBatch:
    rest = [pa.nulls(len(key), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (lead_rid, lead_pos)]
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(rid, pa.int64()), pa.array(pos, pa.int64()), *rest], names=_NAMES)


def _led(key: np.ndarray, rid: np.ndarray, pos: np.ndarray, ordered: bool = False, every: bool = False) -> Iterator[pa.RecordBatch]:
    """One row for each key, and rows that pair its other texts with it. Keys of pairs deal them out evenly.

    A text's own leader says nothing, so its other cells of the first band (every: all of its rows) go on to the
    leader of all tasks. ordered: rows of a key come in order.
    """
    order = np.argsort(key, kind="stable") if ordered else np.lexsort((pos, rid, key))
    if not len(key):
        return
    sorted_ = key[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    lead = np.repeat(order[head], np.diff(np.append(head, len(key))))
    pair = rid[order] != rid[lead]
    p, q = order[pair], lead[pair]
    alone = (order == lead) | ~pair & (every | (pos[order] & _FIRST_BAND != 0))
    heads = np.sort(order[alone])
    for a in range(0, len(heads), 1 << 16):
        h = heads[a : a + (1 << 16)]
        yield _batch(key[h], rid[h], pos[h])
    for a in range(0, len(p), 1 << 16):
        x, y = p[a : a + (1 << 16)], q[a : a + (1 << 16)]
        yield _batch(rid[x], rid[x], pos[x], rid[y], pos[y])


def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _cells(width: int, t: int, bands: int):
    seeds = _seeds(2 * bands)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        n, last, ordered = 0, -1, True
        for batch in batches:
            rids = batch.column("rid").to_numpy()
            ordered &= bool(len(rids) == 0 or (rids[0] >= last and (rids[1:] >= rids[:-1]).all()))
            last = rids[-1] if len(rids) else last
            for i, _, seqs, _, _ in sequences(batch.column("text"), width):
                first = np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)
                s = np.concatenate(seqs) if seqs else np.zeros(0, np.uint64)
                if len(s) < t:
                    continue
                for band in range(bands):
                    x, y = mix(s ^ seeds[2 * band]), mix(s ^ seeds[2 * band + 1])
                    begin, end, c, d = cells(x, y, first, t)
                    k = np.searchsorted(first, begin, side="right") - 1
                    key = mix(x[c] * np.uint64(0x9E3779B97F4A7C15) ^ y[d] ^ seeds[band]).view(np.int64)
                    held.append((key, rids[i + k], _packed(begin - first[k], end - begin, c - first[k], d - first[k], not band)))
                    n += len(key)
                if n >= HELD:
                    yield from _led(*(np.concatenate(x) for x in zip(*held, strict=True)), ordered)
                    held, n = [], 0
        if held:
            yield from _led(*(np.concatenate(x) for x in zip(*held, strict=True)), ordered)

    return run


def _lead(within: bool):
    """Of rows sorted by key, rid and pos, pairs of each key's rows with its first; pairs made before pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            made = batch.column("lead_rid").is_valid()
            if made.true_count:
                yield batch.filter(made)
            key, rid, pos = (x.to_numpy() for x in batch.filter(pc.invert(made)).columns[:3])
            if not len(key):
                continue
            if last is not None:
                key, rid, pos = (np.concatenate([[a], b]) for a, b in zip(last, (key, rid, pos), strict=True))
            head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            lead = np.repeat(head, np.diff(np.append(head, len(key))))
            pair = rid != rid[lead]
            if within:
                pair |= (np.arange(len(key)) != lead) & (pos & _FIRST_BAND != 0)
            pair = np.flatnonzero(pair)
            q = lead[pair]
            if len(pair):
                yield _batch(key[pair], rid[pair], pos[pair], rid[q], pos[q])
            last = tuple(x[head[-1]] for x in (key, rid, pos))

    return run


def _pairs(rows: DataFrame, within: bool) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "rid", "pos").mapInArrow(tidied(_lead(within)), ROWS).filter("lead_rid is not null")


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, rid, pos, met, copy) sorted by key, rid and pos, see _grouped()."""
    held: list = []
    for batch in batches:
        rows = [x.to_numpy() for x in batch.columns]
        if not len(batch):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1]))
        if held and (last or held[-1][0][-1] != rows[0][0]):
            yield from _grouped(*(np.concatenate([*z, x[:last]]) for x, *z in zip(rows, *held, strict=True)))
            held = []
        elif last:
            yield from _grouped(*(x[:last] for x in rows))
        held.append([x[last:] for x in rows])
    if held:
        yield from _grouped(*(np.concatenate(z) for z in zip(*held, strict=True)))


def _grouped(key: np.ndarray, rid: np.ndarray, pos: np.ndarray, met: np.ndarray, copy: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Pairs of cells with the first of their class, and, without a leader, the first cells of classes that aren't all
    linked, with the number of what is linked (lead_pos).

    met: twice the row that a cell has met, and 1 if it is open; -1 for one that leads.
    """
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.append(head[1:], len(key))
    size = end - head
    texts = np.add.reduceat(np.concatenate([[True], (key[1:] != key[:-1]) | (rid[1:] != rid[:-1])]), head, dtype=np.int64)
    other = rid != np.repeat(rid[head], size)
    # a key of one text, of two that have met, or of no open cell says nothing
    use = (texts > 2) | (texts == 2) & (np.maximum.reduceat(np.where(other, met >> 1, -1), head) != rid[head])
    use &= np.maximum.reduceat((met & 1).astype(bool), head)
    out: list = []
    n = 0
    for a, b in zip(head[use].tolist(), end[use].tolist(), strict=True):
        r, p, m = rid[a:b], pos[a:b], met[a:b]
        _, rep, of = np.unique(copy[a:b], return_index=True, return_inverse=True)
        new = np.concatenate([[True], (r[1:] != r[:-1]) | (p[1:] != p[:-1])])
        member = np.flatnonzero(new & (r[rep[of]] != r) & (np.maximum.reduceat(m & 1, np.flatnonzero(new))[np.cumsum(new) - 1] != 0) & (m >> 1 != r[rep[of]]))
        part = np.arange(len(rep))
        leader = {x: c for x, c in zip(r[m == -1][::-1].tolist(), of[m == -1][::-1].tolist(), strict=True)}
        for x, c in zip((m[m & 1 == 0] >> 1).tolist(), of[m & 1 == 0].tolist(), strict=True):  # linked with their leader, and so with one another
            with_ = leader.setdefault(x, c)
            if part[with_] != part[c]:
                part[part == part[c]] = part[with_]
        first = rep if (part != part[0]).any() else rep[:0]
        none = np.full(len(first), -1)
        out.append((np.full(len(member), key[a]), r[member], p[member], r[rep[of[member]]], p[rep[of[member]]]))
        out.append((np.full(len(first), key[a]), r[first], p[first], none, part[: len(first)]))
        n += len(member) + len(first)
        if n >= 1 << 16:
            yield _batch(*(np.concatenate(z) for z in zip(*out, strict=True)))
            out, n = [], 0
    if n:
        yield _batch(*(np.concatenate(z) for z in zip(*out, strict=True)))


def _sketches(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bitmaps of the values of each part of flat that begins at first, LANES words each."""
    bit = mix(flat.astype(np.uint64)) >> np.uint64(32)
    table = np.zeros((LANES, len(bit)), np.uint64)
    table[(bit >> np.uint64(6)) % np.uint64(LANES), np.arange(len(bit))] = np.uint64(1) << (bit & np.uint64(63))
    return np.bitwise_or.reduceat(table, first, axis=1)


def _bits_apart(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many bits each x has that each y hasn't, and the other way round: a shingle for each isn't in common."""
    mine, theirs = (np.zeros((x.shape[1], y.shape[1]), np.int32) for _ in range(2))
    for a, b in zip(x[..., None], y, strict=True):
        mine += np.bitwise_count(a & ~b)
        theirs += np.bitwise_count(~a & b)
    return mine, theirs


def _least(threshold: float, t: int) -> float:
    return ALIKE * 2 * threshold / (1 + threshold) * t


def _most(held: np.ndarray, first: np.ndarray, t: int) -> np.ndarray:
    """The most values held of t side by side, for each part that begins at first, the last one's end included."""
    upto = np.concatenate([[0], np.cumsum(held)])
    sums = upto[t:] - upto[:-t]
    sums[np.repeat(first[1:] - t, np.diff(first))[: len(sums)] < np.arange(len(sums))] = 0  # these reach into the next part
    return np.maximum.reduceat(sums, first[:-1])


def _new(x: np.ndarray, t: int) -> np.ndarray:
    """For each t values side by side, which of them hasn't stood before among them."""
    order = np.argsort(x, kind="stable")
    again = np.flatnonzero(x[order[1:]] == x[order[:-1]])
    before = np.full(len(x), -1)
    before[order[again + 1]] = order[again]
    begin = np.arange(len(x) - t + 1)
    return before[begin[:, None] + np.arange(t)] < begin[:, None]


def _share(x: np.ndarray, held: np.ndarray, t: int) -> float:
    """The largest share of the different values among t side by side that is held."""
    new = _new(x, t)
    return float(((new & np.lib.stride_tricks.sliding_window_view(held, t)).sum(axis=1) / new.sum(axis=1)).max())


def _kinds(cell: np.ndarray, flat: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of numbers below n, those that each cell has, without repeats: (cells, numbers)."""
    return np.divmod(np.unique(cell * n + flat), n)


def _like(a: np.ndarray, c: int, b: np.ndarray, d: int, threshold: float, t: int) -> int:
    """Of the shingles of two cells with anchors at c and d: 2 if passages of t are similar on the anchors' diagonal or
    where each has most of the other, 1 if others may be, 0 if they have too little in common.

    Similarity is of sets: where shingles repeat, many places in common may be few shingles, so these are counted too."""
    same = a[:, None] == b
    at = []
    sides = same.any(axis=1), same.any(axis=0)
    for held in sides:
        upto = np.concatenate([[0], np.cumsum(held)])
        sums = upto[t:] - upto[:-t]
        at.append(int(sums.argmax()))
        if sums[at[-1]] < _least(threshold, t):
            return 0
    if _similarity(a[at[0] : at[0] + t], b[at[1] : at[1] + t]) >= threshold:
        return 2
    for v, held in zip((a, b), sides, strict=True):
        if len(set(v.tolist())) < len(v) and _share(v, held, t) < ALIKE * threshold:
            return 0
    x, y = max(0, c - d), max(0, d - c)
    n = min(len(a) - x, len(b) - y)
    if n >= t:
        upto = np.concatenate([[0], np.cumsum(a[x : x + n] == b[y : y + n])])
        k = int((upto[t:] - upto[:-t]).argmax())
        if _similarity(a[x + k : x + k + t], b[y + k : y + k + t]) >= threshold:
            return 2
    return 1


def _links(rid: np.ndarray, pos: np.ndarray, part: np.ndarray, flat: np.ndarray, first: np.ndarray, threshold: float, t: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the cells of one key, in order: each with earlier ones that may be like it, as long as they aren't linked."""
    least = _least(threshold, t)
    _, flat = np.unique(flat, return_inverse=True)
    values, live = int(flat.max()) + 1, np.arange(len(rid))
    while True:  # cells that have too little of all others together are like none
        size = np.diff(first)
        cell = np.repeat(np.arange(len(live)), size)
        kind_of, kinds = _kinds(cell, flat, values)
        shared = np.bincount(kinds, minlength=values) > 1
        keep = _most(shared[flat], first, t) >= least
        if keep.all() or keep.sum() < 2:
            break
        flat, live, first = flat[keep[cell]], live[keep], np.concatenate([[0], np.cumsum(size[keep])])
    x, y = [], []
    if keep.sum() < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rid, pos, part = rid[live], pos[live], part[live]
    begin, _, c, _ = _unpacked(pos)
    c = c - begin
    different = np.bincount(kind_of, minlength=len(live))
    fewest = np.maximum(1, different - size + t)  # different ones among t side by side, at least
    for k in np.flatnonzero((different < size) & (size > t)).tolist():
        fewest[k] = _new(flat[first[k] : first[k + 1]], t).sum(axis=1).min()
    fewest = ALIKE * threshold * fewest
    kind_of, kinds = kind_of[shared[kinds]], kinds[shared[kinds]]
    bits = _sketches(kinds, np.searchsorted(kind_of, np.arange(len(live))))
    different, places = np.bincount(kind_of, minlength=len(live)), np.bincount(cell[shared[flat]], minlength=len(live))
    mine = np.zeros(values, bool)
    most = max(1, min(most, BLOCK // len(live)))
    for a in range(0, len(live), most):
        b = min(len(live), a + most)
        own_bits, other_bits = _bits_apart(bits[:, a:b], bits[:, :b])
        bound = np.minimum(places[a:b, None] - own_bits, places[:b] - other_bits)
        bound[np.minimum(different[a:b, None] - own_bits, different[:b] - other_bits) < np.maximum(fewest[a:b, None], fewest[:b])] = 0
        for k in range(max(a, 1), b):
            todo = np.flatnonzero((bound[k - a, :k] >= least) & (rid[:k] != rid[k]) & (part[:k] != part[k]))
            own = flat[first[k] : first[k + 1]]
            if len(todo) > 4:  # what has too little of this one's goes at once
                each = np.concatenate([[0], np.cumsum(size[todo])])
                mine[own] = True
                held = mine[flat[np.arange(each[-1]) + np.repeat(first[todo] - each[:-1], size[todo])]]
                mine[own] = False
                todo = todo[_most(held, each, t) >= least]
            todo = todo[np.argsort(-bound[k - a, todo], kind="stable")]
            while len(todo):
                j, todo = int(todo[0]), todo[1:]
                like = _like(own, int(c[k]), flat[first[j] : first[j + 1]], int(c[j]), threshold, t)
                if like:
                    x.append(k)
                    y.append(j)
                if like == 2:
                    part[part == part[j]] = part[k]
                    todo = todo[part[todo] != part[k]]
    return live[np.array(x, np.int64)], live[np.array(y, np.int64)]


def _linked(threshold: float, t: int, most: int):
    """Pairs of cells, from rows (key, rid, pos, part, span) sorted by key, rid and pos, see _links()."""

    def of(key: np.ndarray, rid: np.ndarray, pos: np.ndarray, part: np.ndarray, spans: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        spans = pa.concat_arrays(spans)
        flat = np.frombuffer(b"".join(spans.to_pylist()), np.uint32)
        first = np.concatenate([[0], np.cumsum(pc.binary_length(spans).to_numpy() // 4)]).astype(np.int64)
        edge = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            x, y = _links(rid[a:b], pos[a:b], part[a:b].copy(), flat[first[a] : first[b]], first[a : b + 1] - first[a], threshold, t, most)
            if len(x):
                yield _batch(key[a + x], rid[a + x], pos[a + x], rid[a + y], pos[a + y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            if not len(batch):
                continue
            rows = [x.to_numpy() for x in batch.columns[:4]]
            last = int(np.searchsorted(rows[0], rows[0][-1]))
            if last or held and held[-1][0][-1] != rows[0][0]:
                held.append([*(x[:last] for x in rows), batch.column(4)[:last]])
                *z, spans = zip(*held, strict=True)
                yield from of(*(np.concatenate(x) for x in z), list(spans))
                held = []
            held.append([*(x[last:] for x in rows), batch.column(4)[last:]])
        if held:
            *z, spans = zip(*held, strict=True)
            yield from of(*(np.concatenate(x) for x in z), list(spans))

    return run


def grow(match: np.ndarray, at: int, gap: float) -> tuple[int, int]:
    """The span around `at` where matches count 1 and others -gap, grown each way as long as the sum gains."""
    score = np.where(match, 1.0, -gap)
    right = np.cumsum(score[at:])
    left = np.cumsum(score[at::-1])
    return at - int(left.argmax()), at + int(right.argmax())


def _run(a: np.ndarray, b: np.ndarray) -> int:
    """How many values a and b have in common at their start."""
    n, k, step = min(len(a), len(b)), 0, 64
    while k < n:
        differ = a[k : min(n, k + step)] != b[k : min(n, k + step)]
        at = int(differ.argmax())
        if differ[at]:
            return k + at
        k, step = k + len(differ), step * 4
    return n


_SIDE = 16
_APART = np.add.outer(np.arange(_SIDE + 1), np.arange(_SIDE + 1))


def _next(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int, int] | None:
    """(values of a and b left out, length) of the nearest run that both have, if at most `most` are left out."""
    x, y = a[: min(most, _SIDE) + 1], b[: min(most, _SIDE) + 1]
    apart = np.where(x[:, None] == y[None, :], _APART[: len(x), : len(y)], most + 1)
    best = None
    if apart.size and (least := int(apart.argmin())) >= 0 and apart.flat[least] <= min(most, _SIDE):
        best = divmod(least, len(y))
    elif most > _SIDE and len(x) and len(y):
        x, y = a[: most + 1], b[: most + 1]
        order = np.argsort(y, kind="stable")
        q = np.searchsorted(y, x, sorter=order)
        q = order[np.minimum(q, len(y) - 1)]
        hit = np.flatnonzero(y[q] == x)
        if len(hit):
            k = int(hit[(hit + q[hit]).argmin()])
            if k + q[k] <= most:
                best = k, int(q[k])
    return best and (*best, _run(a[best[0] :], b[best[1] :]))


def chain(own: np.ndarray, other: np.ndarray, c: int, lc: int, weight: float, t: int) -> list[tuple[int, int, int]]:
    """Runs (first, other's first, length) that both texts have, in order, around a common shingle.

    A gap may be as wide as the runs so far and one more of t shingles outweigh: what is beyond a wider one is
    a passage of its own or none.
    """
    back, on = _run(own[:c][::-1], other[:lc][::-1]), _run(own[c:], other[lc:])
    runs = deque([(c - back, lc - back, back + on)])
    total, grew = back + on, True
    while grew:
        grew = False
        i, j, n = runs[-1]
        got = _next(own[i + n :], other[j + n :], int((total + t) / weight))
        if got:
            runs.append((i + n + got[0], j + n + got[1], got[2]))
            total, grew = total + got[2], True
        i, j, _ = runs[0]
        got = _next(own[:i][::-1], other[:j][::-1], int((total + t) / weight))
        if got:
            runs.appendleft((i - got[0] - got[2], j - got[1] - got[2], got[2]))
            total, grew = total + got[2], True
    return list(runs)


def _similarity(a: np.ndarray, b: np.ndarray) -> float:
    s, o = set(a.tolist()), set(b.tolist())
    both = len(s & o)
    return both / (len(s) + len(o) - both)


def longest(own: np.ndarray, other: np.ndarray, runs: list[tuple[int, int, int]], threshold: float, weight: float, t: int) -> list[tuple[int, int, int, int, float]]:
    """(first, last, other's first and last, similarity) of the longest passage from run to run, and of those beside it.

    From run k to run q a passage may go if what its runs count outweighs what lies between them, and its sets are
    similar; where repeated shingles make the sets less alike, the gaps weigh more until they are.
    """
    todo, out = [runs], []
    while todo:
        part = todo.pop()
        if not part or min(part[-1][k] + part[-1][2] - part[0][k] for k in (0, 1)) < t:
            continue
        if len(part) == 1:
            (x, u, n), = part
            out.append((x, x + n - 1, u, u + n - 1, 1.0))
            continue
        i, j, n = np.array(part, np.int64).T
        gap = np.concatenate([[0], i[1:] + j[1:] - i[:-1] - j[:-1] - 2 * n[:-1]])
        upto, gaps, heavy = np.cumsum(n), np.cumsum(gap), weight
        while i[-1] + n[-1] - i[0] >= t and j[-1] + n[-1] - j[0] >= t:
            end, begin = upto - heavy * gaps, upto - n - heavy * gaps
            after = np.maximum.accumulate(end[::-1])
            q = len(n) - 1 - np.searchsorted(after, begin - 1e-6)  # the last run that each may go to
            size, size2 = i[q] + n[q] - i, j[q] + n[q] - j
            ok = (q >= np.arange(len(n))) & (size >= t) & (size2 >= t)
            if not ok.any():
                break
            k = int(np.where(ok, size, -1).argmax())
            z = int(q[k])
            x, y, u, v = int(i[k]), int(i[z] + n[z] - 1), int(j[k]), int(j[z] + n[z] - 1)
            like = 1.0 if k == z else _similarity(own[x : y + 1], other[u : v + 1])
            if like >= threshold:
                out.append((x, y, u, v, like))
                todo += [part[:k], part[z + 1 :]]
                break
            heavy *= 1.25
    return out


def around(own: np.ndarray, other: np.ndarray, anchor: tuple[int, int, int], lead: tuple[int, int, int], threshold: float, t: int) -> tuple[int, int, int, int, float] | None:
    """A passage around the anchors by the shingles that both windows have, in whatever order, the longest first."""
    (l, c, r), (ll, lc, lr) = anchor, lead
    a, b = own[l : r + 1], other[ll : lr + 1]
    mine, theirs = _held(a, b), _held(b, a)
    if min(mine.sum(), theirs.sum()) < threshold * t:
        return None
    for gap in (0.25, 1.0, 4.0, 8.0, 1e9):
        x, y = grow(mine, c - l, gap)
        u, v = grow(theirs, lc - ll, gap)
        if y - x + 1 < t or v - u + 1 < t:
            continue
        like = _similarity(a[x : y + 1], b[u : v + 1])
        if like >= threshold:
            return l + x, l + y, ll + u, ll + v, like
    return None


def along(own: np.ndarray, other: np.ndarray, shift: int, threshold: float, weight: float, t: int) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray, np.ndarray]:
    """Passages on one diagonal (a place in own is a place in other and `shift`), and its runs (begins, ends)."""
    a, b = max(0, shift), min(len(own), len(other) + shift)
    same = np.zeros(b - a + 2, np.int8)
    same[1:-1] = own[a:b] == other[a - shift : b - shift]
    edge = np.flatnonzero(same[1:] != same[:-1]) + a
    begin, end = edge[::2], edge[1::2]
    size = end - begin
    if len(begin) == 1:
        return ([(int(begin[0]), int(end[0]) - 1, int(begin[0]) - shift, int(end[0]) - 1 - shift, 1.0)] if size[0] >= t else []), begin, end
    # a gap that all runs together can't outweigh parts them
    part = np.concatenate([[0], np.cumsum((begin[1:] - end[:-1]) * (2 * weight) > size.sum())])
    out = []
    total = np.bincount(part, weights=size)
    for k in np.flatnonzero(total >= NEAR * t).tolist():
        i, j = np.searchsorted(part, [k, k + 1])
        out += longest(own, other, list(zip(begin[i:j].tolist(), (begin[i:j] - shift).tolist(), size[i:j].tolist(), strict=True)), threshold, weight, t)
    return out, begin, end


def _held(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which values of a are in b."""
    return (a[:, None] == b).any(axis=1) if len(a) * len(b) <= 1 << 14 else np.isin(a, b)


def _zone(own: np.ndarray, other: np.ndarray, a: int, b: int, n: int) -> tuple[bytes, ...]:
    """What lies n or fewer places around a in own and b in other: equal ones give equal results that look no further."""
    return own[max(0, a - n) : a].tobytes(), own[a : a + n].tobytes(), other[max(0, b - n) : b].tobytes(), other[b : b + n].tobytes()


def _beyond(own: np.ndarray, other: np.ndarray, span: tuple[int, int, int, int, float], weight: float, t: int) -> bool:
    """Whether a passage's sides have shingles in common that are near enough to make it longer."""
    x, y, u, v, _ = span
    most = int((y - x + 1 + t) / weight)
    return bool(_held(own[y + 1 : y + 1 + most], other[v + 1 : v + 1 + most]).any() or _held(own[max(0, x - most) : x], other[max(0, u - most) : u]).any())


def _much(own: np.ndarray, other: np.ndarray, c: int, lc: int, t: int) -> bool:
    """Whether enough shingles near the anchor in own are near it in other as well, and enough different ones."""
    near = own[max(0, c - t + 1) : c + t]
    held = _held(near, other[max(0, lc - t + 1) : lc + t])
    if len(near) < t or np.count_nonzero(held) < NEAR * t:
        return False
    return len(set(near.tolist())) == len(near) or _share(near, held, t) >= NEAR


def verified(own: np.ndarray, other: np.ndarray, c: np.ndarray, lc: np.ndarray, threshold: float, t: int) -> tuple[list[tuple[int, int, int, int, float]], np.ndarray, np.ndarray, np.ndarray]:
    """Near-duplicate passages (first, last, other's first and last, similarity) of t or more shingles around the
    anchors; of each anchor, the run of equal shingles on its diagonal (begin, end; empty where not looked for);
    and which places of own begin t shingles that other has as well, one after the other."""
    weight = threshold / max(1 - threshold, 1e-9)
    spans: list[tuple[int, int, int, int, float]] = []
    begins, ends = np.zeros(len(c), np.int64), np.zeros(len(c), np.int64)
    within, equal = np.zeros(len(own) + 1, bool), np.zeros(len(own) + 1, bool)
    wide: list[tuple[int, int, int, int, float]] = []
    seen: dict[int, list[tuple[int, int]]] = {}
    chains: dict[tuple, list[tuple[int, int, int]]] = {}
    arounds: dict[tuple, tuple[bool, list | None]] = {}

    def chained(a: int, b: int) -> bool:
        return any(x <= a < y for x, y in seen.get(a - b, ()))

    def linked(a: int, b: int) -> list[tuple[int, int, int, int, float]]:
        key = _zone(own, other, a, b, 4 * t)
        if key in chains:  # text that repeats itself
            runs = [(a + i, b + j, n) for i, j, n in chains[key]]
        else:
            runs = chain(own, other, a, b, weight, t)
            look = int((sum(n for _, _, n in runs) + t) / weight) + 1
            (i, j, _), (x, y, n) = runs[0], runs[-1]
            if min(i - look - a, j - look - b) >= -4 * t and max(x + n + look - a, y + n + look - b) <= 4 * t:
                chains[key] = [(i - a, j - b, n) for i, j, n in runs]
        for i, j, n in runs:
            seen.setdefault(i - j, []).append((i, i + n))
        out = longest(own, other, runs, threshold, weight, t)
        for x, y, *_ in out:
            within[x : y + 1] = True
        return out

    shift = c - lc
    diagonals, where, count = np.unique(shift, return_inverse=True, return_counts=True)
    for k in np.argsort(-count, kind="stable").tolist():
        which = np.flatnonzero(where == k) if len(diagonals) > 1 else np.arange(len(c))
        if equal[max(0, int(c[which].min()) - t + 1) : max(1, min(int(c[which].max()), len(own) - t) + 1)].all():  # text that repeats itself: said already
            continue
        found, begin, end = along(own, other, int(diagonals[k]), threshold, weight, t)
        if not len(begin):
            continue
        at = np.searchsorted(begin, c[which], side="right") - 1
        begins[which], ends[which] = begin[at], end[at]
        for x, y in zip(begin[end - begin >= t].tolist(), end[end - begin >= t].tolist(), strict=True):
            equal[x : y - t + 1] = True
        for x, y, *_ in found:
            within[x : y + 1] = True
        spans += found
        for f in found:
            if not chained(f[0], f[2]) and _beyond(own, other, f, weight, t):  # an insertion or a deletion moves the rest to another diagonal
                wide += linked(f[0], f[2])
    spans += wide
    left = np.flatnonzero(~within[np.minimum(c, len(own))])
    left = left[np.argsort(c[left], kind="stable")]
    tried: dict[int, int] = {}
    for k in left.tolist():
        a, b = int(c[k]), int(lc[k])
        if within[a] or tried.get(a - b, -t) > a - t:
            continue
        key = _zone(own, other, a, b, t)
        if key not in arounds:
            arounds[key] = _much(own, other, a, b, t), None
        much, got = arounds[key]
        if not much:
            continue
        tried[a - b] = a
        more = [] if chained(a, b) else linked(a, b)
        if not within[a]:
            if got is None:
                got = around(own, other, (max(0, a - t + 1), a, min(len(own) - 1, a + t - 1)), (max(0, b - t + 1), b, min(len(other) - 1, b + t - 1)), threshold, t)
                got = [(got[0] - a, got[1] - a, got[2] - b, got[3] - b, got[4])] if got else []
                arounds[key] = much, got
            more += [(x + a, y + a, u + b, v + b, like) for x, y, u, v, like in got]
        for x, y, *_ in more:
            within[x : y + 1] = True
        spans += more
    outer: list[tuple[int, int, int, int, float]] = []
    for f in sorted(set(spans), key=lambda f: (f[0] - f[1], f)):  # a passage inside another one is no row
        if not any(g[0] <= f[0] and f[1] <= g[1] for g in outer):
            outer.append(f)
    return outer, begins, ends, equal


def _ranges(begin: np.ndarray, end: np.ndarray, n: int) -> np.ndarray:
    """Places of 0..n-1 inside any begin..end (ends included; none where the end is before the begin)."""
    ok = end >= begin
    edge = np.bincount(begin[ok], minlength=n + 1) - np.bincount(end[ok] + 1, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def given_back(own: np.ndarray, other: np.ndarray, pos: np.ndarray, lead_pos: np.ndarray, base: int, begins: np.ndarray, ends: np.ndarray, equal: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of own, and of other, that begin a passage of t shingles in a cell of the first band without its like."""
    first = pos & _FIRST_BAND != 0
    begin, end, c, _ = _unpacked(pos[first])
    lb, le, lc, _ = _unpacked(lead_pos[first])
    mine = np.flatnonzero(_ranges(begin, end, len(own)) & ~equal[: len(own)])
    # what the run on the anchor's diagonal doesn't hold of the leader's cell lies before and after it
    lb, le, shift = lb - base, le - base, c - lc + base
    x, y = begins[first] - shift, ends[first] - t - shift
    none = ends[first] - begins[first] < t
    x, y = np.where(none, le + 1, x), np.where(none, le, y)
    theirs = np.flatnonzero(_ranges(lb, np.minimum(le, x - 1), len(other)) | _ranges(np.maximum(lb, y + 1), le, len(other)))
    return mine, theirs[theirs + t <= len(other)]


def _alike(own: np.ndarray, other: np.ndarray, pos: np.ndarray, lead_pos: np.ndarray, base: int, t: int) -> np.ndarray:
    """Which cells have the same shingles as their leader's."""
    (begin, end, _, _), (lb, le, _, _) = _unpacked(pos), _unpacked(lead_pos)
    lb, le = lb - base, le - base
    ok = (end - begin == le - lb) & (le + t <= len(other))
    for x, y in ((begin, lb), (end, le)):  # the first passage and the last one overlap
        ok[ok] = span_hash(own, x[ok], x[ok] + t) == span_hash(other, y[ok], y[ok] + t)
    return ok


def _outside(c: np.ndarray, spans: list[tuple[int, int, int, int, float]]) -> np.ndarray:
    """Which anchors are in none of the passages."""
    out = np.ones(len(c), bool)
    for x, y, *_ in spans:
        out &= (c < x) | (c > y)
    return out


def _hashes(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """span_hash() of each (values, starts, ends), of many at once."""
    out: list[np.ndarray] = []
    size = np.cumsum([len(v) if len(x) else 0 for v, x, _ in parts])
    while len(out) < len(parts):
        a = len(out)
        b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + HASHED, side="right")))
        some = [(v if len(x) else v[:0], x, y) for v, x, y in parts[a:b]]
        count = [len(x) for _, x, _ in some]
        base = np.repeat(size[a:b] - [len(v) for v, _, _ in some] - (size[a - 1] if a else 0), count)
        values, starts, ends = (np.concatenate(z) for z in zip(*some, strict=True))
        out += np.split(span_hash(values, starts + base, ends + base), np.cumsum(count)[:-1])
    return out


def _copies(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], t: int) -> list[np.ndarray]:
    """Hashes of the shingles of cells (values, begin, end), by their first passage and their last one, which overlap."""
    h = _hashes([(v, x, x + t) for v, begin, end in parts for x in (begin, end)])
    return [mix(a ^ mix(b + (end - begin).astype(np.uint64))).view(np.int64) for (_, begin, end), a, b in zip(parts, h[::2], h[1::2], strict=True)]


def _entries(own: np.ndarray, other: np.ndarray, rid: int, lead_rid: int, pos: np.ndarray, lead_pos: np.ndarray, base: int, equal: np.ndarray | None, spans: list, t: int) -> tuple[list[np.ndarray], tuple, tuple]:
    """(key, rid, pos, met) of cells that aren't copies of their leader's, and of the leaders of open ones; and both's
    (shingles, begin, end)."""
    none = np.zeros(0, np.int64)
    begin, end, c, d = _unpacked(pos)
    if equal is None:
        differ = ~_alike(own, other, pos, lead_pos, base, t)
    else:
        upto = np.concatenate([[0], np.cumsum(~equal[: len(own)])])
        differ = upto[end + 1] > upto[begin]
    if not differ.any():
        return [none] * 4, (own, none, none), (other, none, none)
    begin, end, c, d, pos, lead_pos = (x[differ] for x in (begin, end, c, d, pos, lead_pos))
    key = mix(own[c].astype(np.uint64) << np.uint64(32) | own[d].astype(np.uint64)).view(np.int64)
    is_open = _outside(c, spans)
    if not is_open.any():
        return [key, np.full(len(key), rid), pos, np.full(len(key), 2 * lead_rid)], (own, begin, end), (other, none, none)
    lead, at = np.unique(lead_pos[is_open], return_index=True)
    a, b = len(key), len(lead)
    lb, le, _, _ = _unpacked(lead)
    rows = [np.concatenate([key, key[is_open][at]]), np.repeat([rid, lead_rid], [a, b]), np.concatenate([pos, lead]), np.concatenate([2 * lead_rid + is_open, np.full(b, -1)])]
    return rows, (own, begin, end), (other, lb - base, le - base)


def _once_led(parts: list[list[np.ndarray]]) -> None:
    """Of the leaders' rows among those of many pairs, all but the first of equal ones go."""
    size = np.cumsum([len(p[0]) for p in parts])
    key, rid, pos, met = (np.concatenate(x) for x in list(zip(*parts, strict=True))[:4])
    lead = np.flatnonzero(met == -1)
    order = lead[np.lexsort((pos[lead], rid[lead], key[lead]))]
    again = (key[order[1:]] == key[order[:-1]]) & (rid[order[1:]] == rid[order[:-1]]) & (pos[order[1:]] == pos[order[:-1]])
    keep = np.ones(len(key), bool)
    keep[order[1:][again]] = False
    for k, (a, b) in enumerate(zip([0, *size[:-1]], size, strict=True)):
        if not keep[a:b].all():
            parts[k] = [x[keep[a:b]] for x in parts[k]]


_FOUND = "first:long,last:long,lead_first:long,lead_last:long,similarity:double"
_AGAIN = "key:long,rid:long,pos:long"
_MORE = "key:long,rid:long,pos:long,met:long,copy:long"


def _lists(parts: list[list[np.ndarray]], names: list[str], kinds: list[pa.DataType]) -> pa.ListArray:
    """A list of structs for each row, of the columns that each row has."""
    size = np.concatenate([[0], np.cumsum([len(p[0]) for p in parts])]).astype(np.int32)
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [[] for _ in names]
    return pa.ListArray.from_arrays(pa.array(size), pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names))


def _check(threshold: float, t: int, width: int, first: bool):
    four = [pa.int64()] * 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, len(whole), 512):
                batch = whole.slice(a, 512)
                anchors = batch.column("anchors")
                at = anchors.offsets.to_numpy()
                pos, lead_pos = (x.to_numpy() for x in anchors.values.flatten())
                found, again, more, given, cells_of = [], [], [], [], []
                for k, (rid, lead_rid, base) in enumerate(zip(*(batch.column(x).to_pylist() for x in ("rid", "lead_rid", "base")), strict=True)):
                    own, other = (np.frombuffer(batch.column(x)[k].as_buffer(), np.uint32) for x in ("seq", "lead_seq"))
                    p, q = pos[at[k] : at[k + 1]], lead_pos[at[k] : at[k + 1]]
                    spans: list = []
                    equal = None
                    if not first:
                        if rid != lead_rid:
                            spans = _near(own, other, p, q, base, threshold, t)
                        mine = theirs = np.zeros(0, np.int64)
                    elif rid == lead_rid:
                        begin, end, _, _ = _unpacked(p)
                        mine, theirs = np.flatnonzero(_ranges(begin, end, len(own))), np.zeros(0, np.int64)
                    else:
                        (_, _, c, d), (_, _, lc, ld) = _unpacked(p), _unpacked(q)
                        spans, begins, ends, equal = verified(own, other, np.concatenate([c, d]), np.concatenate([lc, ld]) - base, threshold, t)
                        mine, theirs = given_back(own, other, p, q, base, begins[: len(c)], ends[: len(c)], equal, t)
                    if first:
                        rows, *both = _entries(own, other, rid, lead_rid, p, q, base, equal, spans, t)
                        more.append(rows)
                        cells_of += both
                    else:
                        more.append([np.zeros(0, np.int64)] * 5)
                    found.append([np.array(x) for x in zip(*((x, y + width - 1, u + base, v + base + width - 1, like) for x, y, u, v, like in spans), strict=True)] if spans else [np.zeros(0)] * 5)
                    given += [(own, mine, mine + t), (other, theirs, theirs + t)]
                    again.append([np.repeat([rid, lead_rid], [len(mine), len(theirs)]), np.concatenate([mine, theirs + base])])
                keys = _hashes(given) if first else [np.zeros(0, np.uint64)] * len(given)
                again = [[np.concatenate([x, y]).view(np.int64), *z] for x, y, z in zip(keys[::2], keys[1::2], again, strict=True)]
                if first and more:
                    copies = _copies(cells_of, t)
                    more = [[*z, np.concatenate([x, y])] for z, x, y in zip(more, copies[::2], copies[1::2], strict=True)]
                    _once_led(more)
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("lead_rid"), _lists(found, ["first", "last", "lead_first", "lead_last", "similarity"], [*four, pa.float64()]), _lists(again, ["key", "rid", "pos"], four[:3]), _lists(more, ["key", "rid", "pos", "met", "copy"], [*four, pa.int64()])], names=["rid", "lead_rid", "found", "again", "more"])

    return run


def _near(own: np.ndarray, other: np.ndarray, pos: np.ndarray, lead_pos: np.ndarray, base: int, threshold: float, t: int) -> list[tuple[int, int, int, int, float]]:
    """Passages around the anchors of cells, if they have enough in common near one; others have been found before."""
    (_, _, c, d), (_, _, lc, ld) = _unpacked(pos), _unpacked(lead_pos)
    _, some = np.unique((c - lc) * (len(own) + 1) + c // max(1, t // 4), return_index=True)
    some = np.array([k for k in some.tolist() if _much(own, other, int(c[k]), int(lc[k]) - base, t)], np.int64)
    if not len(some):
        return []
    spans, *_ = verified(own, other, np.concatenate([c[some], d[some]]), np.concatenate([lc[some], ld[some]]) - base, threshold, t)
    return [f for f in spans if ((f[0] <= c) & (c <= f[1])).any()]


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float, t: int, width: int, first: bool = True) -> DataFrame:
    """(rid, lead_rid, found, again, more) of each pair of texts; pairs are gathered by text, sequences join them.

    first: cells that aren't copies of their leader's go on; else none does, and no pair has met before.
    """
    gathered = F.collect_list(F.struct("pos", "lead_pos")) if first else F.collect_set(F.struct("pos", "lead_pos"))
    anchors = pairs.groupBy("rid", "lead_rid").agg(gathered.alias("anchors"))
    leads = texts.select(F.col("rid").alias("lead_rid"), F.col("seq").alias("lead_seq"))
    begins = F.transform("anchors", lambda x: F.shiftright(x["lead_pos"], 3 * PLACE_BITS + 1))
    # only the part of the leading text that the cells cover, and some beside it, goes to the other text
    base = F.greatest(F.lit(0), F.array_min(begins) - 2 * t)
    cut = anchors.join(leads, "lead_rid").select("rid", "lead_rid", "anchors", base.alias("base"), (F.array_max(begins) + 5 * t).alias("top"), "lead_seq")
    cut = cut.withColumn("lead_seq", F.expr("substring(lead_seq, cast(base * 4 + 1 as int), cast((top - base) * 4 as int))")).drop("top")
    both = cut.join(texts.select("rid", "seq"), "rid").select("rid", "lead_rid", "anchors", "base", "seq", "lead_seq")
    return both.mapInArrow(tidied(_check(threshold, t, width, first)), f"rid long, lead_rid long, found array<struct<{_FOUND}>>, again array<struct<{_AGAIN}>>, more array<struct<{_MORE}>>")


def _once(held: list) -> list[np.ndarray]:
    """The rows held, without those given back by several pairs."""
    key, rid, pos = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((pos, rid, key))
    key, rid, pos = key[order], rid[order], pos[order]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (rid[1:] != rid[:-1]) | (pos[1:] != pos[:-1])])
    return [key[new], rid[new], pos[new]]


def _meet_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list = []
    n = 0
    for batch in batches:
        held.append([x.to_numpy() for x in batch.columns])
        n += len(batch)
        if n >= HELD:
            yield from _led(*_once(held), every=True)
            held, n = [], 0
    if held:
        yield from _led(*_once(held), every=True)


def _repeats(checked: DataFrame, t: int, width: int) -> DataFrame:
    """(rid, lead_rid, f): repeats among the passages that were given back, joined where they go on."""
    rows = checked.select(F.explode("again").alias("x")).select("x.*").mapInArrow(tidied(_meet_again), ROWS)
    pairs = _pairs(rows, False).select("rid", "lead_rid", "pos", (F.col("pos") - F.col("lead_pos")).alias("shift")).distinct()
    run = F.col("pos") - F.row_number().over(Window.partitionBy("rid", "lead_rid", "shift").orderBy("pos"))
    spans = pairs.withColumn("run", run).groupBy("rid", "lead_rid", "shift", "run").agg(F.min("pos").alias("first"), (F.max("pos") + F.lit(t + width - 2)).alias("last"))
    return spans.select("rid", "lead_rid", F.struct("first", "last", (F.col("first") - F.col("shift")).alias("lead_first"), (F.col("last") - F.col("shift")).alias("lead_last"), F.lit(1.0).alias("similarity")).alias("f"))


def _met(checked: DataFrame, texts: DataFrame, threshold: float, t: int, most: int) -> DataFrame:
    """Pairs, as _pairs() has them, of cells that come together by their anchors beyond their leader."""
    keys = Marks(checked.select(F.explode("more").alias("x")).filter("x.met & 1 = 1").select("x.key"), "key")
    rows, _ = split_marked(checked.select(F.explode("more").alias("x")).select("x.*"), keys, "key")
    classes = stored(rows.repartition("key").sortWithinPartitions("key", "rid", "pos").mapInArrow(tidied(_classes), ROWS), "classes")
    begin, more = F.shiftright("pos", 3 * PLACE_BITS + 1), F.shiftright("pos", 2 * PLACE_BITS).bitwiseAND(_PLACE)
    span = F.expr("substring(seq, cast(begin * 4 + 1 as int), cast(size * 4 as int))")
    cells = classes.filter("lead_rid = -1").withColumns({"begin": begin, "size": more + t}).join(texts.select("rid", "seq"), "rid").select("key", "rid", "pos", F.col("lead_pos").alias("part"), span.alias("span"))
    links = cells.repartition("key").sortWithinPartitions("key", "rid", "pos").mapInArrow(tidied(_linked(threshold, t, most)), ROWS)
    return stored(links.unionByName(classes.filter("lead_rid >= 0")).drop("key"), "window-met")


def _sequences(width: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(Marks.has(bits.value, batch.column("mark").to_numpy())))
            for i, w, seqs, _, _ in sequences(batch.column("text"), width):
                n = len(seqs)
                own = [(s >> np.uint64(32)).astype(np.uint32).tobytes() for s in seqs]
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(i, n), batch.column("doc_id").slice(i, n), pa.array(own, pa.binary())], names=["rid", "doc_id", "seq"])

    return run


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, threshold: float = THRESHOLD, bands: int = BANDS, width: int = WIDTH, row_col: str | None = None, most: int = ALL) -> DataFrame:
    """rid, doc_id, source_id, first_word, last_word, source_first, source_last, similarity: one row for each
    passage of min_words or more words that is, up to the similarity, in an earlier row of the table as well.

    Words are counted from 0, and rows as by with_rows(). The earliest row that holds a passage is a source and has
    no row for it; a passage that repeats inside one text only is none. Passages of one text and source may
    overlap; one that lies inside another has no row. Every repeat of min_words words is reported; one with edits
    is found by its signatures, with a chance, whatever texts lead them. Null, empty and shorter texts have no passages, rows with equal ids
    are rows of their own, other columns are ignored. min_words may be up to 1,000. most: how many open cells with the same
    anchors are compared with all others at once. row_col: a column that with_rows() has made before.
    """
    t = min_words - width + 1
    if not 0 < t <= _PLACE:
        raise ValueError(f"passages of {min_words} words are too short or too long")
    kind = docs.schema[id_col].dataType.simpleString()
    base = numbered(docs, id_col, text_col, row_col)
    pairs = stored(_pairs(base.select("rid", "text").mapInArrow(tidied(_cells(width, t, bands)), ROWS), True).drop("key"), "window-pairs")
    settle(docs.sparkSession)
    marks = Marks(pairs.select(F.explode(F.array("rid", "lead_rid")).alias("rid")))
    texts = stored(base.withColumn("mark", Marks.column()).mapInArrow(tidied(_sequences(width, marks.bits)), f"rid long, doc_id {kind}, seq binary"), "sequences", "lz4")
    once = stored(_verify(pairs, texts, threshold, t, width), "found")
    drop_stored(pairs)
    more = stored(_verify(_met(once, texts, threshold, t, most), texts, threshold, t, width, False), "found-more")
    found = once.select("rid", "lead_rid", F.explode("found").alias("f")).unionByName(_repeats(once, t, width)).unionByName(more.select("rid", "lead_rid", F.explode("found").alias("f")))
    # a passage inside another one with the same source goes, the longest come first; all others stay
    kept = found.groupBy("rid", "lead_rid").agg(F.collect_list(F.struct((F.col("f.first") - F.col("f.last")).alias("size"), "f.first", "f.last", "f.lead_first", "f.lead_last", "f.similarity")).alias("all"))
    chosen = F.aggregate(F.array_sort("all"), F.expr(f"cast(array() as array<struct<size:long,{_FOUND}>>)"), lambda done, x: F.when(F.exists(done, lambda d: (d["first"] <= x["first"]) & (x["last"] <= d["last"])), done).otherwise(F.concat(done, F.array(x))))
    rows = kept.select("rid", "lead_rid", F.explode(chosen).alias("p"))
    ids = texts.select("rid", "doc_id")
    rows = rows.join(ids.select(F.col("rid").alias("lead_rid"), F.col("doc_id").alias("source_id")), "lead_rid").join(ids, "rid")
    return rows.select("rid", "doc_id", "source_id", F.col("p.first").alias("first_word"), F.col("p.last").alias("last_word"), F.col("p.lead_first").alias("source_first"), F.col("p.lead_last").alias("source_last"), F.col("p.similarity").alias("similarity"))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words first..last of each span, and what stands between them."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    w = Words(data, np.array([0, len(data)]), ALNUM)
    out, at = [], 0
    raw = data.tobytes()[:-1]
    for first, last in sorted(spans):
        a, b = int(w.starts[first]), int(w.ends[last])
        if a > at:
            out.append(raw[at:a])
        at = max(at, b)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def dedupe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = None, **options) -> DataFrame:
    """docs without the repeated passages that passages() finds; every passage stays in its source.

    Rows without any pass unchanged, and so do null and empty texts and all other columns, whatever their names.
    size_col gets the number of characters left. A text that is all repeated becomes what stood outside its words.
    Of equal rows the first stays whole.
    """
    rid, spans_col = fresh(docs, "rid"), fresh(docs, "spans")
    own = with_rows(docs, rid)
    schema, names = docs.schema, docs.columns
    with scratch(docs.sparkSession):
        found = passages(own, id_col, text_col, row_col=rid, **options)
        spans = stored(found.groupBy("rid").agg(F.collect_list(F.struct("first_word", "last_word")).alias(spans_col)).withColumnRenamed("rid", rid), "spans", keep=True)
    maybe, rest = split_marked(own, Marks(spans, rid), rid)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if not s else cut_words(t, [(x["first_word"], x["last_word"]) for x in s]) for t, s in zip(batch.column(text_col).to_pylist(), batch.column(spans_col).to_pylist(), strict=True)]
            columns = {n: batch.column(n) for n in names} | {text_col: pa.array(texts, batch.schema.field(text_col).type)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    cut = maybe.join(spans, rid, "left").select(*[F.col(f"`{n}`") for n in names], spans_col).mapInArrow(tidied(run), schema)
    if size_col:
        cut = cut.withColumn(size_col, F.length(text_col).cast(schema[size_col].dataType))
    return rest.select(*[F.col(f"`{n}`") for n in names]).unionByName(cut)
