"""Runs, source mixes and hard negatives against plain brute-force versions."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from columbine.llm import hard_negatives, periodic_runs, source_mix
from columbine.llm.queries import QUERIES, planted_period

from .conftest import texts_of


# ---- 11 periodic runs ------------------------------------------------------

def brute_runs(w, least=12):
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q) and (i, j + q) not in seen:
                seen.add((i, j + q))
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out)


def odd_words(rng):
    """A text of few letters: random, of repeated pieces, or Sturmian with a flaw."""
    a, n, kind = rng.choice([1, 2, 2, 3, 5]), rng.randint(0, 90), rng.random()
    if kind < 0.4:
        return [rng.randrange(a) for _ in range(n)]
    if kind < 0.8:
        w = []
        while len(w) < n:
            r = [rng.randrange(a) for _ in range(rng.randint(1, 9))]
            w += r * rng.randint(1, 4) + r[:rng.randint(0, len(r))]
        return w
    x, y = ([0], [0, 1]) if rng.random() < 0.5 else ([1], [0, 0, 1])
    for _ in range(rng.randint(1, 7)):
        x, y = y, y + x * rng.choice([1, 1, 2])
    w = y[:200] * rng.choice([1, 2])
    if rng.random() < 0.3:
        w[rng.randrange(len(w))] = 9
    return w


def test_runs_of_few_letters():
    rng = random.Random(5)
    for _ in range(800):
        texts = [odd_words(rng) for _ in range(rng.randint(1, 3))]
        least = rng.choice([1, 2, 4, 12])
        flat = np.array([x for t in texts for x in t], np.int64)
        got = periodic_runs.find(flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts]), least)
        want, at = [], 0
        for t in texts:
            want += [(s + at, n, q) for s, n, q in brute_runs(t, least)]
            at += len(t)
        assert got == want


def brute_digest(doc_id, text, prepare=lambda i, w: w):
    w = prepare(doc_id, (text or "").encode().split())
    runs = brute_runs(w)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    drop = {x for s, n, q in runs for x in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(runs), *(top or (None,) * 3), top and 1000 * top[1] // top[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()),
            sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


def test_periodic_runs(docs, no_docs):
    got = periodic_runs.digest(periodic_runs.find_runs(docs)).collect()
    want = [brute_digest(i, t) for i, t in texts_of(docs) if len((t or "").split()) < 2000]
    got = [tuple(r) for r in got]
    assert len(got) == docs.count()
    for r in want:
        assert got.count(r) == want.count(r), r
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_periodic_runs_query(spark, sf):
    docs = [r for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
            if len((r.text or "").split()) < 1500]
    got = {r.doc_id: tuple(r) for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    assert len(docs) > 150 and sum(got[r.doc_id][1] > 0 for r in docs) > 15
    for r in docs:
        assert got[r.doc_id] == brute_digest(r.doc_id, r.text, planted_period)


def test_planted_period():
    words = [str(i).encode() for i in range(100)]
    for i in range(200):
        h = zlib.crc32(str(i).encode())
        g = h // 10
        a, p = g % 100, 1 + (100 - g % 100) // (3 + g % 8)
        want = words if h % 10 else [words[k if k < a else a + (k - a) % p] for k in range(100)]
        assert planted_period(i, words) == want
    assert planted_period(None, words) == words and planted_period(3, []) == []


# ---- 12 source mix ---------------------------------------------------------

def brute_targets(sizes, share=1.5, most=2.0, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.fixture(scope="module")
def many(spark):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        s = rng.choice(["b", "b", "b", "é", "a", "c", None, "z", "d", "tiny"])
        n = rng.choice([0, 1, 30, 200, 700]) if s != "tiny" else 3
        rows.append((None if i % 50 == 0 else i // 2 * 2 if i % 9 == 0 else i, s,
                     None if i % 71 == 0 else " ".join(f"w{i}x{k}" for k in range(n))))
    rows += [(7, "b", "same text " * 20)] * 30 + [(5000, "a", " ".join(f"v{k}" for k in range(20000)))]
    extra = [(i, s, t, 1, 2, "x") for i, s, t in rows]
    return spark.createDataFrame(extra, "doc_id bigint, source string, text string, row bigint, size bigint, rank string") \
        .repartition(5).cache()


def test_source_mix(spark, many):
    docs = many.collect()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for r in docs:
        sizes[r.source] += size(r.text)
    target = brute_targets(sizes)
    mixed = source_mix.mix(many, block=64, shard_blocks=40)
    got = source_mix.taken(mixed).collect()
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(r.doc_id), size(r.text)) for r in docs)
    rows = {r.row: r for r in mixed.rows.collect()}
    taken = Counter()
    for p in mixed.pieces.collect():
        taken[rows[p.row].source] += p.n_words
    for s in sizes:
        assert taken[s] == int(target[s] + 0.5), s  # exact in words
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    for r in got:
        assert r.source_size in sizes.values() and any(abs(r.target - t) < 1e-6 * max(1, t) for t in target.values())
    # Pieces of one pass never overlap, and lie inside their document.
    spans = defaultdict(list)
    for p in mixed.pieces.collect():
        spans[p.row, p["pass"]].append((p.first_word, p.n_words))
    for (row, _), x in spans.items():
        x.sort()
        assert all(a + n <= b for (a, n), (b, _) in zip(x, x[1:])) and x[-1][0] + x[-1][1] <= rows[row].size
    # Shards hold equally many blocks, and every source is spread over them.
    shards = mixed.pieces.groupBy("shard").agg(F.countDistinct("rank", "place").alias("n")).collect()
    assert len(shards) > 10 and max(r.n for r in shards) - min(r.n for r in shards) <= 1
    again = source_mix.taken(source_mix.mix(many.repartition(3), block=64, shard_blocks=40)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_source_mix_texts(many):
    mixed = source_mix.mix(many, block=64, shard_blocks=40)
    words = source_mix.texts(many, mixed).collect()
    assert sum(len(r.words.split()) for r in words) == mixed.pieces.agg(F.sum("n_words")).first()[0]
    known = {(r.doc_id, w) for r in many.collect() for w in (r.text or "").split()}
    assert all((r.doc_id, w) in known for r in words for w in r.words.split())


def test_source_mix_edges(spark, docs, no_docs):
    assert source_mix.taken(source_mix.mix(no_docs)).count() == 0
    got = source_mix.taken(source_mix.mix(docs)).collect()
    assert len(got) == docs.count() and all(r.taken <= 2 * r.size for r in got)
    blank = docs.where("doc_id < 4")  # no words at all
    assert [(r.target, r.taken) for r in source_mix.taken(source_mix.mix(blank)).collect()] == [(0.0, 0)] * 3


def test_splitting_tree(spark):
    """Margins are exact, parts are disjoint, counts are near their means."""
    q = {r: 7 * r % 50 + (900 if r == 3 else 0) for r in range(1500)}
    frame = spark.createDataFrame(list(q.items()), "rank bigint, quota bigint")
    got = source_mix.split(frame, 130).collect()
    by, shard = defaultdict(list), Counter()
    for r in got:
        by[r["rank"]].append((r.begin, r.quota))
        shard[r.shard] += r.quota
    for r, parts in by.items():
        at = 0
        for b, n in sorted(parts):
            assert b == at
            at += n
        assert at == q[r]
    assert set(by) == {r for r in q if q[r]} and len(shard) == 130
    assert max(shard.values()) - min(shard.values()) <= 2  # one odd block a segment
    hot = [r.quota for r in got if r["rank"] == 3]
    assert max(hot) < 4 * sum(hot) / 130 and len(hot) > 120


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000])
def test_permutation(n):
    for key in (1, 2):
        got = source_mix.permuted(np.arange(n), np.full(n, n), np.full(n, key))
        assert sorted(got.tolist()) == list(range(n))
    for total, turn, shards in ((10, 0, 3), (11, 2, 3), (7, 5, 9), (0, 1, 4), (100, 7, 7)):
        each = [total // shards + ((k + turn) % shards < total % shards) for k in range(shards)]
        assert all(source_mix._held(shards, total, turn, a, b) == sum(each[a:b])
                   for a in range(shards) for b in range(a, shards + 1))


# ---- 13 hard negatives -----------------------------------------------------

def brute_negatives(rows, positives=5, negatives=5):
    """rows: (id, label, vector); partners of equal id and score may stand for each other."""
    ok = [(i, y, [int(np.floor(256 * float(x))) for x in v]) for i, y, v in rows
          if y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda c: (-c[0], c[1] is None, c[1] or 0)
    out = []
    for k, (i, y, v) in enumerate(ok):
        if i is None or i % 100:
            continue
        scored = [(sum(a * b for a, b in zip(v, w)), j, z) for n, (j, z, w) in enumerate(ok) if n != k]
        best = sorted((s for s in scored if s[2] == y), key=order)[:positives]
        for p in best:
            hard = sorted((s for s in scored if s[2] != y and 80 * p[0] <= 100 * s[0] <= 100 * p[0]), key=order)
            out += [(i, p[1], n + 1, h[1], p[0], h[0]) for n, h in enumerate(hard[:negatives])]
    return sorted(map(repr, out))


@pytest.mark.parametrize("width, size", [(16, 1.0), (13, 40.0), (3, 0.02)])
def test_hard_negatives(spark, width, size):
    rng = np.random.default_rng(width)
    rows = []
    for i in range(420):
        v = [float(x) for x in rng.normal(0, size, width)]
        if i % 10 == 1:
            v = rows[-1][2] and list(rows[-1][2])  # ties
        y = int(rng.integers(0, 3)) if i % 3 else 0  # a label with many rows
        rows.append((i, y, v))
    rows += [(100, 1, rows[100][2]), (100, 0, rows[100][2]), (None, 0, rows[2][2]), (None, 1, rows[3][2]),
             (500, None, rows[4][2]), (600, 1, None), (700, 1, [float("nan")] * width), (800, 1, [float("inf")] * width),
             (900, 1, [None] * width), (1000, 0, rows[5][2][:2]), (1100, 2, []), (-100, 1, rows[9][2])]
    frame = spark.createDataFrame([(i, v, y, "x", 1, 2) for i, y, v in rows],
                                  "vec_id bigint, embedding array<double>, label int, row string, id int, score int")
    got = hard_negatives.mine(frame.repartition(4), chunk=100, block=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == brute_negatives(rows)


def test_hard_negatives_empty(spark):
    none = spark.createDataFrame([], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(none).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (200, [1.0], 2)], "vec_id bigint, embedding array<float>, label int")
    assert hard_negatives.mine(alone).count() == 0


def test_four_russians_scores():
    rng = np.random.default_rng(0)
    for low, high in ((-256, 256), (-1, 0), (0, 1), (-(1 << 40), 1 << 20)):
        c, a = rng.integers(low, high + 1, (50, 24)), rng.integers(low, high + 1, (9, 24))
        bits = 1 + max(int(high).bit_length(), (~min(low, 0)).bit_length())
        got = hard_negatives.scores(hard_negatives.planes(c, bits), hard_negatives.tables(a))
        assert (got == c @ a.T).all()
    wide = rng.integers(-256, 257, (7, 64))
    small = hard_negatives.tables(wide, hard_negatives._kind(wide, 10, 64))
    assert small.dtype == np.int32 and (hard_negatives.scores(hard_negatives.planes(wide, 10), small) == wide @ wide.T).all()
