"""Decontamination, languages, scores, near-duplicates, passages and licences against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from evidra.llm import common, cpjoin, ctw, decontam, graph, langid, licenses, queries, windows

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
W = [f"w{k}" for k in range(3000)]


def words(text):
    return WORD.findall((text or "").translate(LOW).encode())


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def table(spark, tmp_path_factory, rows, schema, parts=3):
    path = str(tmp_path_factory.mktemp("t") / "t.parquet")
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_decontamination(spark, empty, block):
    rnd = random.Random(5)
    rt = lambda n: " ".join(rnd.choice(W[:40]) for _ in range(n))
    items = [(str(k), rt(rnd.choice([3, 8, 10, 15, 40]))) for k in range(12)] + [("n", None), ("e", " .. "), (None, "only here now"), ("dup", "Only, HERE now")]
    docs = [(k, rt(rnd.randrange(0, 80))) for k in range(60)] + [(100, None), (101, ""), (102, "only here\n\nNOW! é"), (102, "only here"), (103, items[3][1] + " tail " + items[4][1]), (104, ("x " * 30_000) + items[4][1])]
    want = {}
    for key, (i, text) in enumerate(docs):
        w, hit, found = words(text), set(), set()
        for item, t in items:
            p = words(t)
            m = min(10, len(p))
            for a in range(len(p) - m + 1) if m else ():
                for b in range(len(w) - m + 1):
                    if w[b : b + m] == p[a : a + m]:
                        hit |= set(range(b, b + m))
                        found.add(item)
        want[key] = (i, len(w), len(hit), tuple(sorted(x for x in found if x is not None)))
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.decontaminate(d, b, block_bytes=block).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got) == sorted(want.values())
    assert all(sum(s.last - s.first + 1 for s in r.spans) == r.n_hit for r in got)
    kept = decontam.clean(d, b, block_bytes=block)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == sorted(w[0] for w in want.values() if not w[2])
    assert decontam.decontaminate(empty, b).count() == 0
    assert [r.n_hit for r in decontam.decontaminate(d, b.limit(0)).collect()] == [0] * len(docs)


def test_decontamination_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        want = con.execute(sql)
        names = [x[0] for x in want.description]
        assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in queries.QUERIES[name](spark, sf_dir).collect())


def test_languages(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(None, None, "en"), (90001, "", "fr"), (90002, "123 ...", None), (90003, "The " * 50_000, None)], "doc_id long, text string, lang string"))
    got = langid.identify(more).collect()
    labels = {r.doc_id: r.lang for r in docs.collect()}
    held = [r for r in got if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    assert sum(r.lang_pred == labels[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    for i in (None, 90001, 90002):
        assert next((r.lang_pred, r.score) for r in got if r.doc_id == i) == ("und", 0.0)
    assert next(r.lang_pred for r in got if r.doc_id == 90003) == "en"
    assert langid.identify(empty).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", docs.lang.cast("string").substr(1, 0)).selectExpr("doc_id", "text", "nullif(lang, '') lang")).collect()} == {"und"}
    odd = docs.selectExpr("doc_id", "text", "lang", "1 score", "2 lang_pred", "3 __c0")
    assert langid.accepted(odd, 0.4).columns == odd.columns


def test_ftrl_is_sparse_and_calibrated():
    rng = np.random.default_rng(1)
    rows = [(np.array([0, 1 + y, 3 + int(rng.integers(20))]), np.ones(3), y) for y in rng.integers(0, 2, 300)]
    w = langid.ftrl(rows, 2, 40, l1=1.0)
    assert (w == 0).mean() > 0.5 and w[1, 0] > w[1, 1] and w[2, 1] > w[2, 0]
    z = rng.normal(size=(4000, 3))
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=q) for q in p])
    assert 2.3 < langid.temperature(3 * z, y) < 4.2


def test_scores(spark, sf_dir, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, None), (80001, ""), (80001, "\x1f  odd \0 text")], "doc_id long, text string"))
    got = ctw.score(more).collect()
    rows = [(r.doc_id, r.text or "") for r in more.collect()]
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", t.translate(LOW)), None]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert all(r.score < 0 for r in got)
    size = {i: len(t.encode()) + 1 for i, t in rows}
    assert all(abs(r.bits_per_byte + r.score * math.log2(10) / (len((t or "").encode()) + 1)) < 1e-9 for r in got for t in [dict(rows).get(r.doc_id)] if r.doc_id not in (None, 80001))
    bits = [-r.score * math.log2(10) / size[r.doc_id] for r in got if r.held_out and size[r.doc_id] > 500]
    assert sum(bits) / len(bits) < 3.6
    assert ctw.score(empty).count() == 0


def brute_ctw(text, depth):
    """Weighted probability of every byte's bits, from counts of the whole text, by plain recursion over contexts."""
    nodes = defaultdict(lambda: [0, 0])
    padded = b"\0" * depth + text
    for i, byte in enumerate(text):
        context = padded[i : i + depth]
        for d in range(depth + 1):
            for k in range(8):
                nodes[context[depth - d :], k, byte >> (8 - k)][byte >> (7 - k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(s, k, p):
        if (s, k, p) not in memo:
            own = kt(*nodes[s, k, p])
            if len(s) == depth:
                memo[s, k, p] = own, 1.0
            else:
                kids = {c for c, kk, pp in list(nodes) if kk == k and pp == p and len(c) == len(s) + 1 and c.endswith(s)}
                split = sum(weighted(c, k, p)[0] for c in kids) + kt(0, 0)
                total = np.logaddexp(own, split) - math.log(2)
                memo[s, k, p] = total, math.exp(own - math.log(2) - total)
        return memo[s, k, p]

    def byte_probability(context, byte):
        out = 1.0
        for k in range(8):
            p = None
            for d in range(depth, -1, -1):
                s = context[depth - d :]
                if (s, k, byte >> (8 - k)) not in nodes:
                    p = 0.5
                    continue
                a, b = nodes[s, k, byte >> (8 - k)]
                own, w = (b + 0.5) / (a + b + 1), weighted(s, k, byte >> (8 - k))[1]
                p = own if len(s) == depth else w * own + (1 - w) * p
            out *= p if byte >> (7 - k) & 1 else 1 - p
        return out

    return byte_probability


def test_context_tree_against_recursion():
    text, depth = b"abracadabra, abracadabra; banana", 3
    code = ctw.code_of(np.frombuffer(text, np.uint8), np.array([0, len(text)]), depth)
    grams, counts = [], None
    keys = code
    for d in range(depth, -1, -1):
        keys, counts = ctw.tally(keys & np.uint64((1 << 8 * (d + 1)) - 1), counts)
        grams.insert(0, (keys, counts))
    tree = ctw.Tree(grams)
    want = brute_ctw(text, depth)
    for context, byte in [(b"bra", 99), (b"ana", 110), (b"xyz", 97), (b"\0\0\0", 97), (b"abr", 97), (b"zna", 113)]:
        gram = np.array([int.from_bytes(context + bytes([byte]), "big")], np.uint64)
        assert abs(10 ** tree.log10(gram)[0] - want(context, byte)) < 1e-6
    every = np.arange(256, dtype=np.uint64) | np.uint64(int.from_bytes(b"bra\0", "big"))
    assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-5


def ctw_by_recursion(texts, depth):
    """log10 probability of a text and its end, by the weighted trees of all contexts that the texts have."""
    n, kids = defaultdict(lambda: [0, 0]), defaultdict(set)
    for text in texts:
        padded = b"\0" * depth + text + b"\0"
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                kids[padded[i - d + 1 : i]].add(padded[i - d : i]) if d else None
                for k in range(8):
                    n[padded[i - d : i], k, padded[i] >> (8 - k)][padded[i] >> (7 - k) & 1] += 1
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    memo = {}

    def weighted(node):
        if node not in memo:
            own = kt(*n[node])
            split = sum(weighted((c, *node[1:]))[0] for c in kids[node[0]] if (c, *node[1:]) in n)
            total = own if len(node[0]) == depth else np.logaddexp(own, split) - math.log(2)
            memo[node] = total, 1.0 if len(node[0]) == depth else math.exp(own - math.log(2) - total)
        return memo[node]

    def score(text):
        out, padded = 0.0, b"\0" * depth + text + b"\0"
        for i in range(depth, len(padded)):
            for k in range(8):
                p = 0.5
                for d in range(depth, -1, -1):
                    node = (padded[i - d : i], k, padded[i] >> (8 - k))
                    if node in n:
                        w = weighted(node)[1]
                        p = w * (n[node][1] + 0.5) / (sum(n[node]) + 1) + (1 - w) * p
                out += math.log10(p if padded[i] >> (7 - k) & 1 else 1 - p)
        return out

    return score


@pytest.mark.parametrize("options", [{}, {"heads": 300}, {"heads": 0}, {"depth": 3, "heads": 50}])
def test_scores_of_every_context(spark, options):
    rnd = random.Random(11)
    rows = [(k, " ".join(rnd.choice(W[:150] + ["é", "the", "Of"]) for _ in range(rnd.randrange(60)))) for k in range(60)] + [(100, None), (101, ""), (102, "not seen 中\0 at all"), (103, "zzz")]
    texts = {i: (t or "").translate(LOW).encode() for i, t in rows}
    score = ctw_by_recursion([t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2], options.get("depth", 5))
    got = {r.doc_id: r.score for r in ctw.score(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert got.keys() == texts.keys()
    assert all(abs(got[i] - score(t)) < 1e-5 * (1 + len(t)) for i, t in texts.items())


def near_duplicates(rnd):
    """Groups of copies and edited copies, a line that many share, and odd rows."""
    docs = []
    for g in range(8):
        base = [rnd.choice(W) for _ in range(rnd.choice([6, 40, 300]))]
        for _ in range(rnd.choice([1, 2, 9])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2]) * len(t) // 100):
                t[rnd.randrange(len(t))] = rnd.choice(W)
            docs.append(" ".join(t))
    docs += [" ".join(rnd.choice(W) for _ in range(rnd.randrange(5, 60))) + " one line that very many texts have in common here" for _ in range(60)]
    docs += ["", None, "...", "one", "One!", "one two", "three, four", docs[0].upper(), "b " * 20_000]
    rows = [(k, t, k) for k, t in enumerate(docs)]
    return [*rows, (3, docs[3], 0), (3, "another text with the same id", 0), (None, docs[5], 0)]


@pytest.mark.parametrize("bucket, block", [(256, 2048), (3, 4)])
def test_jaccard_join(spark, tmp_path_factory, empty, bucket, block):
    rows = near_duplicates(random.Random(6))
    sets = []
    for _, t, _ in rows:
        w = words(t)
        sets.append({b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                n[a], n[b] = n[a] + 1, n[b] + 1
                root[find(a)] = find(b)
    least = defaultdict(lambda: math.inf)
    for k, (i, *_) in enumerate(rows):
        least[find(k)] = min(least[find(k)], math.inf if i is None else i)
    want = sorted((str(i), str(least[find(k)]), n[k]) for k, (i, *_) in enumerate(rows))
    docs = table(spark, tmp_path_factory, rows, "doc_id long, text string, rid long")
    got = cpjoin.join(docs, bucket=bucket, block=block).collect()
    assert sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in got) == want
    kept = cpjoin.distinct(docs)
    assert kept.columns == docs.columns and kept.count() == len({find(k) for k in range(len(rows))})
    assert cpjoin.join(empty).count() == 0 and cpjoin.distinct(empty).count() == 0


def test_runs_reach_the_recall():
    """Pairs at the threshold share a path in all but the allowed share of trials."""
    rng = np.random.default_rng(2)
    runs, missed = cpjoin.runs_for(0.99, 0.8), 0
    for _ in range(400):
        shared, a, b = (rng.integers(0, 1 << 63, k, dtype=np.int64).astype(np.uint64) for k in (160, 20, 20))
        x, y = (np.unique(np.concatenate([shared, z]))[: cpjoin.SAMPLE] for z in (a, b))
        missed += not any(len(np.intersect1d(cpjoin.picks(x, cpjoin._seed(r), 1.25), cpjoin.picks(y, cpjoin._seed(r), 1.25))) for r in range(runs))
    assert missed <= 16


def test_components(spark):
    rnd = random.Random(8)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(70)] + [(k, k + 1) for k in range(100, 140)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(a != b and x in (a, b) for a, b in edges)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_compact_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        first = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 3))])
        x = rng.permutation(int(first[-1])).astype(np.uint64) + np.uint64(1)
        t = int(rng.integers(1, 12))
        want = set()
        for a, b in zip(first[:-1], first[1:], strict=True):
            for c in range(a, b):
                l = c
                while l > a and x[l - 1] > x[c]:
                    l -= 1
                r = c
                while r < b - 1 and x[r + 1] > x[c]:
                    r += 1
                if r - l + 1 >= t:
                    want.add((l, c, r))
        assert set(zip(*(y.tolist() for y in windows.compact_windows(x, first, t)), strict=True)) == want


def test_passages(spark, tmp_path_factory, empty):
    rnd = random.Random(3)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    docs = [rt(rnd.randrange(30, 300)) for _ in range(200)]
    p1, p2, p3, line = rt(55), rt(90), rt(48), rt(12)
    for k in (5, 50, 100, 199):
        docs[k][10:10] = p1
    for k in (7, 70, 150):
        copy = list(p2)
        copy[45] = f"edit{k}"
        docs[k][0:0] = copy
    for k in (9, 90):
        docs[k] += p3
    for k in range(0, 200, 3):
        docs[k][5:5] = line
    q = [*rt(30), *line, *rt(30)]
    for k in (111, 122):
        docs[k] += q
    docs[30][0:0] = [*p3[:47], "a", *p3[:47]]  # repeats inside one text only
    rows = [(k, " ".join(d), 0) for k, d in enumerate(docs)] + [(300, " ".join(docs[20]).upper(), 0), (301, None, 0), (302, "", 0), (None, "short", 0)]
    df = table(spark, tmp_path_factory, rows, "doc_id long, text string, first_word int", 4)
    got = windows.passages(df).collect()
    pairs = {frozenset((r.doc_id, r.source_id)) for r in got}
    links = {x for p in pairs for x in p}
    assert {5, 50, 100, 199, 7, 70, 150, 111, 122, 20, 300} == links
    for r in got:
        if {r.doc_id, r.source_id} <= {5, 50, 100, 199}:
            assert (r.last_word - r.first_word, r.similarity) == (54, 1.0)
    out = {r.doc_id: r.text for r in windows.dedupe(df).collect()}
    assert len(out) == len(rows) and sum(" ".join(p1) in (t or "") for t in out.values()) == 1
    for k, text, _ in rows:
        if k not in links:
            assert out[k] == text
    assert sorted([out[20] != rows[20][1], out[300] != rows[200][1]]) == [False, True]
    assert windows.passages(empty).count() == 0 and windows.dedupe(empty).count() == 0


def test_windows_meet_again_without_their_leader(spark, tmp_path_factory):
    """A line that many texts share leads elsewhere; the passage around it is found all the same."""
    rnd = random.Random(9)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    line = rt(40)
    docs = [[*rt(100), *line, *rt(100)] for _ in range(40)]
    inner = [*rt(8), *line, *rt(8)]
    docs += [[*rt(60), *inner, *rt(60)] for _ in range(2)]
    df = table(spark, tmp_path_factory, [(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string", 2)
    assert {frozenset((r.doc_id, r.source_id)) for r in windows.passages(df).collect()} == {frozenset((40, 41))}


@pytest.mark.parametrize("kind", ["replace", "insert", "delete"])
def test_short_passages_with_one_edit(spark, tmp_path_factory, kind):
    """Passages of 50 to 70 words with one edited word near an end are found whole, not cut at the edit."""
    rnd = random.Random(21)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    first, second, want = [], [], {}
    for k in range(150):
        p = rt(rnd.randrange(54, 71))
        at = rnd.choice([rnd.randrange(6, 20), len(p) - rnd.randrange(7, 21)])
        copy = [*p[:at], *([] if kind == "delete" else ["edited"] if kind == "replace" else ["edited", p[at]]), *p[at + 1 :]]
        a, b = rt(rnd.randrange(40, 80)), rt(rnd.randrange(40, 80))
        first.append((k, " ".join([*a, *p, *rt(50)])))
        second.append((1000 + k, " ".join([*b, *copy, *rt(50)])))
        want[1000 + k] = (len(b), len(b) + len(copy) - 1, k)
    df = table(spark, tmp_path_factory, first + second, "doc_id long, text string", 2)
    got = {}
    for r in windows.passages(df).collect():
        later = max(r.doc_id, r.source_id)
        got[later] = (r.first_word, r.last_word) if r.doc_id == later else (r.source_first, r.source_last)
    whole = sum(k in got and got[k][0] <= a and got[k][1] >= b for k, (a, b, _) in want.items())
    assert whole >= (0.9 if kind == "replace" else 0.75) * len(want), whole


def test_passages_that_overlap_are_all_cut(spark, tmp_path_factory):
    """Two passages of a text that overlap in a few words and stand apart in the source both go."""
    rnd = random.Random(33)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    p = rt(190)
    rows = [(1, " ".join([*rt(30), *p[:100], *rt(300), *p[90:], *rt(30)])), (2, " ".join(["before", *p, "after"]))]
    df = table(spark, tmp_path_factory, rows, "doc_id long, text string", 1)
    got = windows.passages(df).collect()
    assert len(got) == 2 and {r.doc_id for r in got} | {r.source_id for r in got} == {1, 2}
    later = got[0].doc_id
    left = {r.doc_id: len(r.text.split()) for r in windows.dedupe(df).collect()}
    assert left[later] == (2 if later == 2 else 360)


def test_equal_passages_meet_whatever_line_leads_them(spark, tmp_path_factory):
    """Lines of 42 words that 30 earlier texts hold lead each signature inside; passages around them are found always."""
    rnd = random.Random(17)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    lines = [rt(42) for _ in range(60)]
    docs = [[x for line in lines[k % 2 :: 2] for x in [*rt(20), *line]] for k in range(30)]
    for line in lines:
        inner = [*rt(5), *line, *rt(5)]
        docs += [[*rt(60), *inner, *rt(60)] for _ in range(2)]
    df = table(spark, tmp_path_factory, [(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string", 1)
    pairs = {frozenset((r.doc_id, r.source_id)) for r in windows.passages(df).collect()}
    want = {frozenset((30 + 2 * k, 31 + 2 * k)) for k in range(60)}
    assert pairs == want, len(pairs & want)


@pytest.mark.parametrize("options", [{}, {"most": 2}, {"most": 1000}])
def test_edited_passages_meet_whatever_parts_lead_them(spark, tmp_path_factory, options):
    """Earlier texts hold the first or the last 42 words of passages of 58, and lead most signatures inside; two later
    texts that hold the whole passage, one of them with an edit, are found still."""
    rnd = random.Random(23)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    inner = [rt(58) for _ in range(60)]
    docs = [[x for p in inner for x in [*rt(30), *(p[16:] if k % 2 else p[:42])]] for k in range(30)]
    for p in inner:
        docs += [[*rt(60), *p, *rt(60)], [*rt(60), *p[:29], "edit", *p[30:], *rt(60)]]
    df = table(spark, tmp_path_factory, [(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string", 1)
    pairs = {frozenset((r.doc_id, r.source_id)) for r in windows.passages(df, **options).collect()}
    want = {frozenset((30 + 2 * k, 31 + 2 * k)) for k in range(60)}
    assert not pairs - want and len(pairs) >= 54, (len(pairs), len(pairs & want))


def test_a_line_of_many_texts_makes_no_pairs_of_all(spark, tmp_path_factory, monkeypatch):
    """Cells around a line that 120 texts share are not verified each with each; an edited passage there is found still."""
    rnd = random.Random(29)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    line, made, stored = rt(30), [], windows.stored

    def counted(df, name, *args, **kwargs):
        out = stored(df, name, *args, **kwargs)
        if name == "window-met":
            made.append(out.count())
        return out

    monkeypatch.setattr(windows, "stored", counted)
    docs = [[*rt(60), *line, *rt(60)] for _ in range(120)]
    inner = [*rt(20), *line, *rt(20)]
    docs += [[*rt(60), *inner, *rt(60)], [*rt(60), *inner[:10], "edit", *inner[11:], *rt(60)]]
    df = table(spark, tmp_path_factory, [(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string", 1)
    assert {frozenset((r.doc_id, r.source_id)) for r in windows.passages(df).collect()} == {frozenset((120, 121))}
    assert sum(made) <= 4 * len(docs), made


def test_places_in_common_that_repeat_one_shingle_make_no_links(spark, tmp_path_factory, monkeypatch):
    """60 texts repeat the same words 46 times each: most places in common, few different shingles, so nothing to verify
    each with each; an edited passage with a line that repeats is found still."""
    rnd = random.Random(31)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    made, stored = [], windows.stored

    def counted(df, name, *args, **kwargs):
        out = stored(df, name, *args, **kwargs)
        if name == "window-met":
            made.append(out.count())
        return out

    monkeypatch.setattr(windows, "stored", counted)
    docs = [[x for j in range(30) for x in [*rt(12), *[f"again{j}"] * 46]] for _ in range(60)]
    line = rt(8)
    p = [*rt(12), *line, *rt(5), *line, *rt(12), *line, *rt(12)]
    docs += [[*rt(60), *p, *rt(60)], [*rt(60), *p[:4], "edit", *p[5:], *rt(60)]]
    df = table(spark, tmp_path_factory, [(k, " ".join(d)) for k, d in enumerate(docs)], "doc_id long, text string", 1)
    assert {frozenset((r.doc_id, r.source_id)) for r in windows.passages(df).collect()} == {frozenset((60, 61))}
    assert sum(made) <= 4 * len(docs), made


def test_every_exact_repeat_is_reported(spark):
    """Every word of every 50 words that an earlier row has as well, over a whole table, against a plain search."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    covered = defaultdict(set)
    for r in windows.passages(docs).collect():
        covered[r.doc_id].update(range(r.first_word, r.last_word + 1))
    first, missed, needed = {}, 0, 0
    for doc_id, text in docs.collect():
        w = words(text)
        need = set()
        for i in range(len(w) - 49):
            if first.setdefault(b" ".join(w[i : i + 50]), doc_id) != doc_id:
                need.update(range(i, i + 50))
        needed, missed = needed + len(need), missed + len(need - covered[doc_id])
    assert needed > 10_000 and missed == 0


def test_recall_of_edited_passages(spark, tmp_path_factory):
    """Passages of 60 to 200 words with edits anywhere and a similarity of 0.8 or more: nine of ten words are found."""
    rnd = random.Random(8)
    rt = lambda n: [rnd.choice(W) for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    line = rt(15)
    rows, want = [], {}
    while len(want) < 300:
        p = rt(rnd.randrange(60, 200))
        copy = list(p)
        for _ in range(rnd.randrange(1, 1 + len(p) // 40)):
            at = rnd.randrange(len(copy))
            copy[at : at + rnd.choice([0, 1, 1])] = rnd.choice([[], ["edited"], ["two", "words"]])
        a, b = shingles(p), shingles(copy)
        if len(a & b) < 0.8 * len(a | b) or p == copy:
            continue
        k = len(want)
        before = [*rt(rnd.randrange(30, 90)), *(line if k % 3 else [])]
        rows.append((k, " ".join([*rt(40), *(line if k % 2 else []), *p, *rt(40)])))
        rows.append((1000 + k, " ".join([*before, *copy, *rt(40)])))
        want[1000 + k] = (len(before), len(before) + len(copy))
    df = table(spark, tmp_path_factory, sorted(rows), "doc_id long, text string", 1)
    found = defaultdict(set)
    for r in windows.passages(df).collect():
        later = max(r.doc_id, r.source_id)
        found[later].update(range(r.first_word, r.last_word + 1) if r.doc_id == later else range(r.source_first, r.source_last + 1))
    share = sum(len(found[k] & set(range(a, b))) for k, (a, b) in want.items()) / sum(b - a for a, b in want.values())
    whole = sum(len(found[k] & set(range(a, b))) >= 0.9 * (b - a) for k, (a, b) in want.items()) / len(want)
    assert share >= 0.9 and whole >= 0.9, (share, whole)


def test_rows_keep_their_numbers(spark, tmp_path_factory):
    """Row numbers and results are the same however a table's files are split, and clashing names stay."""
    rnd = random.Random(4)
    rows = [(k, " ".join(rnd.choice(W) for _ in range(120)), 777 + k, 1, 2, 3) for k in range(400)]
    rows += [(1000 + k, rows[k][1], 5, 1, 2, 3) for k in range(0, 400, 9)]
    df = table(spark, tmp_path_factory, rows, "doc_id long, text string, rid long, __row int, __spans int, mark int", 3)
    path, old = df.inputFiles()[0].rsplit("/", 1)[0], spark.conf.get("spark.sql.files.maxPartitionBytes")
    numbers, kept, left = [], [], []
    try:
        for size in ("128m", "9k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            d = spark.read.parquet(path)
            numbers.append({(r.doc_id, r.n) for r in common.with_rows(d, "n").collect()})
            for out, f in ((kept, cpjoin.distinct), (left, windows.dedupe)):
                got = f(d)
                assert got.columns == df.columns
                out.append(sorted(map(tuple, got.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert numbers[0] == numbers[1] and len({n for _, n in numbers[0]}) == len(rows)
    assert kept[0] == kept[1] and len(kept[0]) == 400 and left[0] == left[1] and len(left[0]) == len(rows)
    assert {(r[0], *r[2:]) for r in left[0]} == {(r[0], *r[2:]) for r in rows}
    assert common.with_rows(df.union(df), "n").select("n").distinct().count() == 2 * len(rows)


def test_marks(spark):
    rows = spark.range(5000).withColumnRenamed("id", "rid")
    marks = common.Marks(rows.filter("rid % 7 = 0"))
    yes, no = common.split_marked(rows, marks)
    assert {r.rid for r in yes.collect()} >= set(range(0, 5000, 7)) and yes.count() + no.count() == 5000 and yes.count() < 900


LICENSED = [("MIT", "Released under the MIT License."), ("Apache-2.0", "Licensed under the Apache License, Version 2.0."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."), ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"), ("", "He got his driving license under the old rule."), ("", "Released under the rules of the game."), ("", ""), ("", "Use of this code is subject to the Eclipse Public License 2.0."), ("", "GNU Affero General Public License version 3"), ("", "This is not licensed under the MIT License."), ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"), ("GPL-2.0", "The licenses for most software are designed to take away your freedom to share and change it. By contrast, the GNU General Public License is intended to guarantee your freedom to share and change free software.")]


def test_licences(spark, sf_dir, tmp_path_factory, empty):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("not text rlike '(?i)licen[sc]|CC BY'").select("doc_id", "text")
    rows = [(10**6 + k, f"some words\n{t}\nand more", f) for k, (f, t) in enumerate(LICENSED)] + [(2 * 10**6, LICENSED[0][1] + "\n" + LICENSED[2][1], ""), (2 * 10**6, None, ""), (None, "", ""), (3 * 10**6, "x\n" * 20_000 + LICENSED[1][1], "")]
    more = table(spark, tmp_path_factory, [(i, t, "") for i, t, _ in rows] + [(r.doc_id, r.text, "") for r in docs.collect()], "doc_id long, text string, families string")
    got = licenses.scan(more).collect()
    assert len(got) == more.count()
    by = {r.doc_id: r for r in got}
    for i, _, family in rows[: len(LICENSED)]:
        assert by[i].families == family, i
    assert sorted(r.families for r in got if r.doc_id == 2 * 10**6) == ["", "CC-BY-NC,MIT"]
    assert by[3 * 10**6].top_family == "Apache-2.0" and by[3 * 10**6].n_paragraphs == 20_001
    assert not [r for r in got if r.doc_id is not None and r.doc_id < 10**6 and r.families]
    assert licenses.scan(empty).count() == 0


def test_licence_scores_are_the_softmax(spark, tmp_path_factory):
    """Families and scores of the DataFrame plan against a plain softmax over the model's weights."""
    texts = [t for _, t in LICENSED if t] + ["Available under CC BY 4.0, see the LICENSE file for details.", "MIT", "the apache license", "plain words"]
    df = table(spark, tmp_path_factory, list(enumerate(texts)), "doc_id long, text string", 1)
    base = df.select("doc_id", "text").withColumnRenamed("doc_id", "rid")
    model = licenses.Classifier(licenses.sample_paragraphs(common.with_rows(df, "n"), "n", "text"))
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for k, t in enumerate(texts):
        z = model.weights[[0, *(model.index[g] for g in licenses.grams(licenses.words(t)) if g in model.index)]].sum(axis=0) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(p.argmax())
        said = best < len(licenses.FAMILIES) and p[best] >= model.least
        assert got[k].n_predicted == said and (not got[k].n_confirmed or (got[k].top_family == model.classes[best] and abs(got[k].top_score - p[best]) < 1e-4)), t
    assert base.count() == len(texts)


def test_licence_model_knows_held_out_notices():
    model = licenses.Classifier(["the and of to this is for in a text of prose", "nothing here", "under the sun"] * 20)
    assert model.f1 > 0.75 and 0 < model.least < 1


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language ID" and len(corpus_pipeline.STAGES) == 5
    sizes, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
        sizes.append(docs.count())
        assert name == "BPE encoding and decoding" or docs.columns == columns
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, docs.collect()))
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    path = common.stored(none, "none")
    for _, stage in corpus_pipeline.STAGES:
        path = stage(spark, path, sf_dir)
    assert path.count() == 0
    assert hashlib is not None


def test_stages_on_odd_rows(spark, sf_dir, tmp_path_factory):
    """Null, empty and very long texts, equal rows, equal ids, ties and clashing columns go through every stage."""
    import corpus_pipeline

    rnd = random.Random(12)
    real = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    long = " ".join(rnd.choice(W) for _ in range(30_000))
    odd = [(None, None, None, None, None), (9001, "", "en", "s", 0), (9002, None, "fr", "s", 1), (9003, "the " * 30_000, "en", "s", 2), (9004, long, "en", "s", 3), (9004, long, "en", "s", 3), (9005, long + " tail", "en", None, 4), (9006, "...", "de", "s", 5), (real[0][0], real[1][1], "en", "s", 6), real[2], real[2]]
    rows = [(*r, 7, "x", 1.5, True) for r in real + odd]
    names = ["doc_id", "text", "lang", "source", "n_chars", "rid", "__text", "score", "mark"]
    df = table(spark, tmp_path_factory, rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, __text string, score double, mark boolean")
    before = df
    for name, stage in corpus_pipeline.STAGES:
        after = common.stored(stage(spark, before, sf_dir), "odd")
        assert after.count() <= before.count()
        if name != "BPE encoding and decoding":
            assert after.columns == names
            assert {(r.rid, r["__text"], r.score, r.mark) for r in after.collect()} == {(7, "x", 1.5, True)}
        if name == "language ID":
            assert after.filter("text is null or text in ('', '...')").count() == 0
        if name == "n-gram Jaccard join":
            assert after.filter("doc_id in (9004, 9005)").count() == 1 and after.filter("doc_id = 9003").count() <= 1
        before = after
    # stages by themselves keep what has no words
    for stage in (corpus_pipeline.distinct, corpus_pipeline.without_repeats, corpus_pipeline.decontaminated):
        out = stage(spark, df, sf_dir)
        assert out.filter("text is null").count() == 2 and out.filter("text = '' and doc_id = 9001").count() == 1
    left = [(r.doc_id, len(r.text.split())) for r in corpus_pipeline.without_repeats(spark, df, sf_dir).filter("doc_id in (9003, 9004, 9005)").collect()]
    assert (9003, 30_000) in left and len(left) == 4 and sum(n for i, n in left if i != 9003) == 30_001


def test_scores_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "one two", 1, 2, 3), (2, None, 1, 2, 3), (2, "b " * 40_000, 1, 2, 3)], "doc_id long, text string, rid int, held_out int, rare int")
    got = ctw.score(df).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in got) == [(1, 3), (2, 1), (2, 40_001)]
