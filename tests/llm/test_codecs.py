"""Media columns, token files, archives and BPE: exact round trips and the library's own results."""

import base64
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from evidra.llm import bpe, media, pieces, queries, repair, warc

ODD = [None, "", "  ", "it's we'll 'd ''s 'm'x", "a<|endoftext|>b <|startoftext|>", "ΑΣ ΣΑΣ İ ﬁ é é", "１２ ²³ ½ 12345 a1b2", "日本語 \U0001f600", "x" * 300, "aaaaaaa aaa", "word " * 50_000, "tie", "tie", "\0\x1f\x85"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k if k != 3 else None, t, "x", 1.5) for k, t in enumerate(ODD)] + [(1, "same id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens double")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(pieces.tokenizer_path(None))


def test_bpe_is_the_librarys(odd, library):
    for r in bpe.encode(odd.filter("doc_id is not null and not (doc_id = 1)")).collect():
        want = library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == want
        assert r.decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_digests(odd, empty, library):
    got = bpe.digests(odd, with_ids=True).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(list(r.ids), skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(empty).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcdelmnrstv'' \t<|>0")), max_size=60))
def test_bpe_of_any_text(text):
    coder, lib = bpe.coder(), Tokenizer.from_file(pieces.tokenizer_path(None)) if not hasattr(test_bpe_of_any_text, "lib") else test_bpe_of_any_text.lib
    test_bpe_of_any_text.lib = lib
    assert coder.encode([text])[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_bpe_of_every_code_point(library):
    """Each code point between two letters, and newer ones beside marks that join them, no category left out."""
    coder = bpe.coder()
    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 4096):
        part = [f"a{chr(c)}b" for c in every[i : i + 4096]]
        want = library.encode_batch(part, add_special_tokens=False)
        assert [x.tolist() for x in coder.encode(part)] == [w.ids for w in want], hex(every[i])
    for text in ("\u1c89\u0301 it's \ua7cb e\u0301 <|endoftext|> \ua7dc!", "\U000105c0\u0307\u1c89", "plain"):
        for encode in (coder.encoder.encode, repair.encoder().encode):
            assert encode([text, "a b", text])[0].tolist() == [i for t in (text, "a b", text) for i in library.encode(t, add_special_tokens=False).ids]


def test_words_of_one_hash_are_told_apart(library, monkeypatch):
    """Two strings that any polynomial hash modulo 2**64 takes for one, and a hash that takes all words for one."""
    a = "ab"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    pairs = [a[:n] for n in (512, 1024, 2048)] + [a[:n].translate(str.maketrans("ab", "ba")) for n in (512, 1024, 2048)]
    want = [library.encode(t, add_special_tokens=False).ids for t in pairs]
    assert [x.tolist() for x in bpe.coder().encode(pairs)] == want
    ids, size = repair.encoder().encode(pairs)
    assert ids.tolist() == [i for w in want for i in w]
    monkeypatch.setattr(pieces, "word_hash", lambda v, s, e: np.full(len(s), 7, np.uint64))
    texts = ["one two three", "four one", "", "two two longer"]
    assert [x.tolist() for x in bpe.Coder(pieces.tokenizer_path(None)).encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_pairs_merge_in_rank_order(library):
    """Against a plain loop that merges the lowest rank, leftmost first, over words in which merges overlap."""
    index = bpe.PairIndex(pieces.tokenizer_path(None))
    rnd = np.random.default_rng(3)
    words = ["aaaa", "aaaaaaa", "abcabc", "thethe", "a", "é", "日本語"] + ["".join(rnd.choice(list("aeinorst"), int(rnd.integers(1, 14)))) for _ in range(400)]
    want = []
    for w in words:
        raw = w.encode()
        s = [*index.inner[list(raw[:-1])].tolist(), int(index.last[raw[-1]])] if len(raw) > 1 else [int(index.last[raw[-1]])]
        while True:
            ranks = [(index.rank[s[i] << 32 | s[i + 1]], i) for i in range(len(s) - 1) if s[i] << 32 | s[i + 1] in index.rank]
            if not ranks:
                break
            r, i = min(ranks)
            s[i : i + 2] = [index.made[r]]
        want.append(s)
    ids, size = index.encode(words)
    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=60), max_size=6), st.integers(2, 5))
def test_grammar_round_trip(docs, least):
    ids = np.array([i for d in docs for i in d], np.uint32)
    f = repair.File(repair.pack([*range(len(docs))], np.array([len(d) for d in docs], np.int64), ids, least))
    assert [f.document(k).tolist() for k in range(len(docs))] == docs
    assert f.tokens(0, len(ids)).tolist() == ids.tolist()
    assert f.everything().tolist() == ids.tolist()
    if len(ids) > 3:
        assert f.tokens(1, len(ids) - 2).tolist() == ids[1:-2].tolist()


def test_grammar_compresses():
    ids = np.tile(np.arange(50, dtype=np.uint32), 400)
    s, left, *_ = repair.compress(ids, 4)
    assert len(s) + 3 * len(left) < len(ids) / 10
    wide = np.tile(np.array([70_000, 5, 90_000], np.uint32), 100)
    f = repair.File(repair.pack([None], np.array([300]), wide, 4))
    assert f.document(0).tolist() == wide.tolist() and f.doc_ids == [None]
    with pytest.raises(ValueError):
        repair.File(repair.pack([1], np.array([300]), wide, 4) + b"x")


def test_grammar_leaves_no_frequent_pair():
    """Over a shard with more rules than two bytes tell apart; ranges decode without the rest of the file."""
    rnd = np.random.default_rng(5)
    words = [rnd.integers(0, 65_000, 12, dtype=np.uint32) for _ in range(1500)]
    ids = np.concatenate([words[k] for k in rnd.integers(0, 1500, 9000)])
    s, left, right, first = repair.compress(ids, 3)
    assert s.dtype == np.uint32 and max(np.unique(s[:-1].astype(np.uint64) << np.uint64(32) | s[1:], return_counts=True)[1]) < 3
    f = repair.File(repair.pack([1], np.array([len(ids)]), ids, 3))
    assert f.width == 3 and f.everything().tolist() == ids.tolist()
    for a, b in [(0, 1), (5, 5), (70_001, 70_400), (len(ids) - 3, len(ids))]:
        assert f.tokens(a, b).tolist() == ids[a:b].tolist()


def test_token_files(spark, odd, empty, library):
    files = repair.write_files(odd, shard_tokens=500)
    got = repair.read_files(files).collect()
    assert files.count() > 1 and len(got) == len(ODD) + 1
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    for r in got:
        if r.doc_id not in (None, 1):
            ids = np.array(library.encode(ODD[r.doc_id] or "", add_special_tokens=False).ids + [1], "<u4")
            assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))
    assert repair.read_files(repair.write_files(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=30_000))
def test_movie_round_trip(data):
    payload = media.padded(data)
    m = media.Movie(media.write(payload))
    assert len(payload) % media.FRAME == 0 and payload.startswith(data) and m.payload() == payload
    assert m.codec == "raw " and m.duration == len(payload)
    assert all(media.write(payload)[a : a + n] == payload[k * media.CHUNK_FRAMES * media.FRAME :][:n] for k, (a, n) in enumerate(m.keyframes()))


def test_movies_of_other_shapes():
    """Frames of several sizes, chunks apart, an unknown box between and a box to the end of the file."""
    data = b"ab" + b"cde" + b"f"
    stbl = lambda base: media.box(b"stbl", media.full(b"stsd", struct.pack(">I", 1), media.box(b"mp4a", bytes(8))), media.full(b"stts", struct.pack(">III", 1, 3, 10)), media.full(b"stsz", struct.pack(">IIIII", 0, 3, 2, 3, 1)), media.full(b"stsc", struct.pack(">IIIIIII", 2, 1, 2, 1, 2, 1, 1)), media.full(b"stco", struct.pack(">III", 2, base, base + 9)))
    moov = lambda base: media.box(b"moov", media.box(b"free", b"x"), media.box(b"trak", media.box(b"mdia", media.full(b"mdhd", struct.pack(">QQIQI", 0, 0, 1000, 30, 0), version=1), media.box(b"minf", stbl(base)))))
    base = len(moov(0)) + 8
    m = media.Movie(moov(base) + struct.pack(">I4s", 0, b"mdat") + data[:5] + b"----" + data[5:])
    assert (m.codec, m.timescale, m.duration, m.payload(), m.keyframes()[2]) == ("mp4a", 1000, 30, data, (base + 9, 1))
    with pytest.raises(ValueError):
        media.Movie(moov(base)[:-3])
    with pytest.raises(ValueError):
        media.Movie(media.write(media.padded(b"x"))[:-200])


def test_media_columns(odd, empty):
    got = media.features(media.store(odd)).collect()
    assert len(got) == len(ODD) + 1
    for r in got:
        if r.doc_id not in (None, 1):
            raw = (ODD[r.doc_id] or "").encode()
            payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
            assert r.media_sha256 == hashlib.sha256(media.write(payload)).hexdigest() and r.keyframes[0].length == 192
    assert media.features(media.store(empty)).count() == 0


def test_archives(spark):
    rows = [(1, "http://a/ é", "same"), (2, "http://b/", "same"), (3, None, None), (4, "u", ""), (5, "u", "x" * 100_000), (2, "again", "same"), (None, "n", "same"), (7, "u\r\nEvil: 1", "tail\r\n\r\nWARC/1.1")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int")
    got = warc.read_archives(warc.write_archives(pages, archive_bytes=2000)).collect()
    assert len(got) == len(rows)
    for i, _, html in rows:
        payload = (html or "").encode()
        for r in (r for r in got if r.page_id == i and r.payload_bytes == len(payload)):
            assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
            first = {"same": 2, "": 4}.get(html or "", i)
            assert (r.record_type, r.refers_to) == (("response", None) if i == first else ("revisit", first))
            assert r.html == ((html or "") if i == first else None)
    apart = warc.read_archives(warc.write_archives(pages, min_dedupe_bytes=5)).collect()
    assert sum(r.record_type == "revisit" for r in apart) == 0
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(none)).count() == 0


def test_archive_checks():
    good = [warc.record("response", str(k), "u", b"some page text " * 9, 135, warc.digest(b"some page text " * 9), None) for k in range(40)]
    data = warc.archive(good)
    assert list(warc.frames(data)) == good
    assert struct.unpack_from("<I", data)[0] == 0x184D2A5D and struct.unpack_from("<I", data, 4)[0] > 0  # a dictionary was trained
    for bad in (data[:-3], data[4:], b""):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            list(warc.frames(bad))
    for bad in (good[0].replace(b"Content-Length: 135", b"Content-Length: 134"), good[0].replace(b"sha1:", b"sha1:A"), good[0].replace(b"WARC-Date", b"X-Date"), b"no header"):
        with pytest.raises(ValueError):
            warc.parse(bad)


@pytest.mark.parametrize("name", ["op1_media_columns", "op4_token_files", "op8_warc", "op9_bpe"])
def test_whole_tables(spark, sf_dir, name):
    table = "pages" if name == "op8_warc" else "documents"
    assert queries.QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    assert pa is not None


def test_string_page_ids(spark):
    rows = [("b", "u", "same"), ("a", None, "same"), ("c", "u", None), (None, "u", "same"), ("d", "u", "other")]
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(spark.createDataFrame(rows, "page_id string, url string, html string"))).collect()}
    assert got == {"b": ("response", None), "a": ("revisit", "b"), None: ("revisit", "b"), "c": ("response", None), "d": ("response", None)}


def test_tracks_are_read_apart():
    """A file of two tracks, of which only the second has a table of keyframes."""
    data = media.write(media.padded(b"x" * 30_000))
    boxes = {path: (a, b) for path, a, b in media.walk(data)}
    a, b = boxes[(b"moov", b"trak")]
    trak = data[a:b]
    at = trak.index(b"stss")
    moov_a, moov_b = boxes[(b"moov",)]
    first = media.box(b"trak", trak[:at] + b"skip" + trak[at + 4 :])
    two = data[: moov_a - 8] + media.box(b"moov", data[moov_a : a - 8], first, media.box(b"trak", trak)) + data[moov_b:] + bytes(len(first))
    two = two[: len(two) - len(first)] + media.box(b"free", bytes(len(first)))
    one, other = media.movies(two)
    assert len(one.keys) == len(one.sizes) and len(other.keys) == 3 < len(other.sizes)
    with pytest.raises(ValueError):
        media.Movie(data + media.box(b"moof"))
