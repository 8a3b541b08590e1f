"""Every operator against a plain brute-force version, with its edge cases."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from columbine.llm import (bpe, decontaminate, host_rules, license_scan, nbsvm, simhash, suffix_dedup,
                           token_attribution, token_store, warc_fixity)
from columbine.llm.common import scratch_path
from columbine.llm.queries import ORACLES, QUERIES, vocabulary

from .conftest import PASSAGE, by_id, texts_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


def rows_of(df, *cols):
    return sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect())))


def test_registered_numbers():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


# ---- 1 token store ---------------------------------------------------------

@pytest.mark.parametrize("bits", [1, 5, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype("<u4")
    packed = token_store.pack(ids, bits)
    assert len(packed) == -(-1003 * bits // 8)
    assert (token_store.unpack(packed, bits, 100, 800) == ids[100:900]).all()


def test_token_store(spark, docs, no_docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    path = scratch_path(spark, "test-store")
    token_store.write_store(docs, path, vocabulary("word_bpe_49k.json"), 1, block_ids=256)
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    want = sorted(texts_of(docs), key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode()))
    start = 0
    for g, (i, t) in zip(got, want, strict=True):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (g.doc_id, g.start, g.n_tokens, g.ids_crc32) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(g.ids) == ids.tobytes()
        start += len(ids)
    one = token_store.read_blocks(spark, path).orderBy("shard", "block").first()
    assert len(token_store.read_span(spark, path, one.shard, 0, 3)) == min(3, one.n_ids)
    path = scratch_path(spark, "test-store")
    token_store.write_store(no_docs, path, vocabulary("word_bpe_49k.json"), 1)
    assert token_store.read_documents(spark, path).count() == 0


# ---- 2 SimHash -------------------------------------------------------------

def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, max_bits):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    v = np.array(values, np.uint64)
    for i in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v ^ v[i]) <= max_bits):
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(v))]


def test_simhash(docs, no_docs):
    pairs = texts_of(docs)
    fps = [brute_fingerprint(t) for _, t in pairs]
    comp = brute_components(fps, 2)
    low = {}
    for c, (i, _) in zip(comp, pairs):
        low[c] = min((x for x in (low.get(c), i) if x is not None), default=None)
    want = sorted(repr((i, f"{f:016x}", low[c])) for (i, _), f, c in zip(pairs, fps, comp))
    assert rows_of(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(no_docs).count() == 0


def test_simhash_index_dense_groups(spark, monkeypatch):
    """Many slabs, hot slabs dealt out, chains and dense balls: same components as brute force."""
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(x) for x in rng.integers(0, 1 << 63, 1500, dtype=np.uint64)}
    for s in seeds.tolist():
        chain = s
        for _ in range(12):
            fps.add(chain)
            chain ^= 1 << int(rng.integers(0, 64))
        fps |= {s ^ 1 << b for b in range(0, 64, 3)}
    fps = sorted(fps)
    monkeypatch.setattr(simhash, "SLAB_ROWS", 150)
    monkeypatch.setattr(simhash, "QUERIES_PER_TASK", 400)
    df = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp bigint")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    comp = brute_components(fps, 2)
    got = {}
    for f, c in zip(fps, comp):
        s = int(np.uint64(f).astype(np.int64))
        got.setdefault(c, set()).add(root.get(s, s))
    assert all(len(v) == 1 for v in got.values())
    assert len({next(iter(v)) for v in got.values()}) == len(got)


@pytest.mark.parametrize("chunk, held", [(256, 5), (256, 100_000), (4, 5), (4, 30), (1, 0)])
def test_simhash_fold_keeps_links(spark, monkeypatch, chunk, held):
    """Pairs folded on the last chunk (one chunk of 256 holds all queries), on every chunk, now and then, never."""
    balls = [0x1234567890ABCDEF, 0x7F00FF00FF00FF00]
    fps = sorted({s ^ 1 << b for s in balls for b in range(0, 60, 4)} | {3 << 20, 5 << 40})
    monkeypatch.setattr(simhash, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(simhash, "PAIRS_HELD", held)
    root = {r.node: r.root for r in simhash.components(
        simhash.links(spark.createDataFrame([(f,) for f in fps], "fp bigint"))).collect()}
    comp = brute_components(fps, 2)
    assert [root.get(f, f) for f in fps] == [fps[c] for c in comp]


# ---- 3 host rules ----------------------------------------------------------

def test_host_rules_measures(docs, no_docs):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        c = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        cover = {j for i in range(len(w) - 2) if c[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        n = len(w)
        return (n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)),
                len(cover), n < 50 or 100 * len(cover) > 50 * n)
    want = sorted(repr((i, *brute(t))) for i, t in texts_of(docs))
    got = host_rules.apply_rules(docs)
    assert rows_of(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                   "base_failed") == want
    assert got.where("base_failed and kept").count() == 0
    assert host_rules.apply_rules(no_docs).count() == 0


def test_host_verdicts(spark):
    """A host whose documents nearly all fail is rejected; small hosts are drawn to the mean."""
    rows = [("good", False)] * 400 + [("good", True)] * 20 + [("bad", True)] * 90 + [("bad", False)] * 10 \
        + [("tiny", True)] + [(f"h{i}", j == 0) for i in range(30) for j in range(20)]
    flags = spark.createDataFrame([(h, b, False, False, False) for h, b in rows],
                                  "source string, few_words boolean, repeats boolean, symbols boolean, dup_lines boolean")
    got = {r.host: r for r in host_rules.host_verdicts(flags, "source").collect()}
    assert got["good"].host_ok and not got["bad"].host_ok
    assert got["tiny"].few_words_rate < 1


# ---- 4 classifier ----------------------------------------------------------

def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.sort(rng.choice(500, 30, replace=False) + (0 if k % 2 else 300)).astype(np.int32) for k in range(200)]
    y = np.array([1.0 if k % 2 else -1.0 for k in range(200)])
    r = nbsvm.log_count_ratio(rows, y)
    w, b = nbsvm.dual_coordinate_descent(rows, y, r)
    margin = np.array([w[x].sum() / np.sqrt(len(x)) + b for x in rows])
    assert ((margin > 0) == (y > 0)).all()


def test_classifier_held_out_accuracy(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = nbsvm.classify(docs, labels)
    assert got.count() == docs.count()
    r = got.where("held_out").join(labels, "doc_id").selectExpr(
        "avg(cast(predicted = quality as int)) acc", "min(score) a", "max(score) b").first()
    assert r.acc > 0.97 and 0 <= r.a and r.b <= 1


def test_classifier_edges(spark, docs, no_docs):
    none = spark.createDataFrame([], "doc_id bigint, quality int, score double")
    got = nbsvm.classify(docs, none)
    assert {round(r.score, 6) for r in got.collect()} == {0.5} and got.count() == docs.count()
    odd = spark.createDataFrame([(6, 1, 0.0), (6, 1, 0.0), (15, 0, 0.0), (None, 1, 0.0), (9, None, 0.0)], none.schema)
    got = nbsvm.classify(docs, odd).collect()
    assert all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    assert nbsvm.classify(no_docs, odd).count() == 0


# ---- 5 repeated strings ----------------------------------------------------

def brute_removal(pairs, length=400):
    raws = [(i, (t or "").encode()) for i, t in pairs]
    seen = Counter()
    for _, b in raws:
        seen.update(b[k:k + length] for k in range(len(b) - length + 1))
    out = []
    for i, b in raws:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k:k + length]] > 1:
                gone[k:k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


COLS5 = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def test_suffix_dedup(spark, docs, no_docs):
    small = docs.where("doc_id <> 9 or doc_id is null")
    assert rows_of(suffix_dedup.digest(small), *COLS5) == sorted(map(repr, brute_removal(texts_of(small))))
    assert suffix_dedup.digest(no_docs).count() == 0
    left = by_id(suffix_dedup.deduplicate(docs).collect())
    assert left[1][0].text is None and "passage3" not in left[10][0].text and left[9][0].text.startswith("w0x0 ")
    assert left[10][0].name == "c"


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_suffix_dedup_cut_and_pasted(spark, monkeypatch, group):
    """Pieces of one another at all offsets, with edits, at and just below the length."""
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = np.random.default_rng(5)
    source = bytes(rng.integers(97, 103, 6000, dtype=np.uint8)).decode()
    texts = [source]
    for _ in range(60):
        a, n = int(rng.integers(0, 5000)), int(rng.integers(380, 900))
        piece = list(source[a:a + n])
        if rng.random() < 0.5:
            piece[int(rng.integers(0, len(piece)))] = "#"
        pad = "".join(rng.choice(list("uvwxyz"), int(rng.integers(0, 300))))
        texts.append(pad + "".join(piece) + pad[::-1])
    texts += ["aaaa" * 250, "b" * 399, "b" * 400, "abc" * 140]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id bigint, text string").repartition(6)
    got = suffix_dedup.digest(df, passage=150).cache()
    assert rows_of(got, *COLS5) == sorted(map(repr, brute_removal(pairs)))
    assert rows_of(got, "doc_id", "n_passage") == sorted(repr((r[0], r[2])) for r in brute_removal(pairs, 150))
    for length in (12, 60) if group > 3 else ():  # small covers
        some = pairs[1:25]
        small = df.where("doc_id between 1 and 24")
        assert rows_of(suffix_dedup.digest(small, length=length, passage=length), *COLS5) == \
            sorted(map(repr, brute_removal(some, length)))


@pytest.mark.parametrize("v", suffix_dedup.COVERS)
def test_difference_covers(v):
    d = suffix_dedup.COVERS[v]
    assert {(a - b) % v for a in d for b in d} == set(range(v)) and len(d) * (len(d) - 1) == v - 1


def test_suffix_samples(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 500)
    rng = np.random.default_rng(1)
    raw = bytes(rng.integers(97, 99, 3000, dtype=np.uint8)) + b"xy" * 700
    for length in (5, 80, 200):
        cover = suffix_dedup.Cover(length)
        for size in (0, length - 1, length, 777, len(raw)):
            want = [p for p in range(size - cover.tuple + 1) if p % cover.v in cover.residues]
            n = cover.count(size)
            assert cover.place(np.arange(n)).tolist() == want
            names = cover.names(raw[:size]).tolist()
            tuples = [raw[p:p + cover.tuple] for p in want]
            assert len(names) == n and len(set(names)) == len(set(tuples)) == len(set(zip(names, tuples)))


def test_suffix_dedup_samples_wrap(spark, monkeypatch):
    """Texts with more samples than a place can number."""
    monkeypatch.setattr(suffix_dedup, "SAMPLE_BITS", 3)
    monkeypatch.setattr(suffix_dedup, "TEXT_BITS", 2)  # and texts that agree in them
    rng = np.random.default_rng(2)
    part = "".join(map(chr, rng.integers(97, 123, 900)))
    noise = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    texts = [noise(1000) + part + noise(50) + part[:500], noise(333) + part[200:700] + noise(2000), noise(10) + part]
    pairs = list(enumerate(texts))
    df = spark.createDataFrame(pairs, "doc_id bigint, text string")
    assert rows_of(suffix_dedup.digest(df), *COLS5) == sorted(map(repr, brute_removal(pairs)))


def test_passages_of_fifty_words(spark):
    """Passages of 50 to 60 words, under 400 bytes, in many texts go; the rest stays."""
    rng = np.random.default_rng(9)
    word = lambda: "".join(map(chr, rng.integers(97, 123, int(rng.integers(2, 9)))))
    passages = [" ".join(word() for _ in range(int(rng.integers(50, 61)))) for _ in range(12)]
    passages = [p for p in passages if len(p) < 400]
    assert len(passages) > 8
    rows = []
    for i in range(120):
        own = [" ".join(word() for _ in range(60)) for _ in range(2)]
        rows.append((i, own, passages[i % len(passages)] if i % 2 else ""))
    df = spark.createDataFrame([(i, f"{a} {p} {b}", 1) for i, (a, b), p in rows], "doc_id bigint, text string, n_chars int")
    left = {r.doc_id: r.text for r in suffix_dedup.deduplicate(df, length=suffix_dedup.PASSAGE).collect()}
    for i, (a, b), p in rows:
        assert left[i].startswith(a[:-4]) and left[i].endswith(b[4:])  # letters next to a passage may agree too
        assert len(left[i]) <= len(a) + len(b) + 2 and (p or left[i] == f"{a}  {b}")
    assert suffix_dedup.digest(df).where("(doc_id % 2 = 1) <> (n_passage > 0) or n_removed > 0").count() == 0


# ---- 6 fixity --------------------------------------------------------------

def test_fixity(spark):
    rows = [(f, k, f"record {f}/{k}".encode() * (k % 7)) for f in range(5) for k in range(300)]
    a = spark.createDataFrame(rows, "file_id bigint, label bigint, record binary").selectExpr(
        "*", "cast(octet_length(record) as bigint) as size")
    laid = warc_fixity.lay_out(a, "file_id", "label").where("file_id = 1").orderBy("label").collect()
    assert [r.at for r in laid] == [sum(x.size for x in laid[:k]) for k in range(300)]
    a = warc_fixity.hash_records(a.selectExpr("*", "label * 3000 as at")).cache()
    alter = a.withColumn("digest", __import__("pyspark").sql.functions.expr(
        "case when file_id = 3 and label = 77 then 'x' else digest end")).where("not (file_id = 1 and label = 5)")
    found = {(r.file_id, r.label, r.status) for r in warc_fixity.audit(a, alter).collect()}
    assert found == {(3, 77, "differs"), (1, 5, "only_first")}
    assert warc_fixity.audit(a, a).count() == 0
    none = a.where("1 = 0")
    assert warc_fixity.audit(none, none).count() == 0
    assert warc_fixity.audit(none, a).where("status = 'only_second'").count() == a.select("file_id", "at").distinct().count()


def test_fixity_odd_addresses(spark):
    """Negative and very large files and offsets, two records at one address, records over a leaf, nulls, other columns."""
    files = [-1, 0, 1 << 23, 1 << 40, -(1 << 62), (1 << 62) + 5, 77]
    rows = [(f, at, bytes([k % 251]) * (1 + 97 * k % 300), k, "x", 1)
            for k, (f, at) in enumerate((f, at) for f in files for at in (0, 1, 5000, (1 << 18) * 3, 1 << 45, -8))]
    rows += [(0, 5000, b"second at one address", 100, "x", 1), (77, 1 << 30, b"big" * 200_000, 101, "x", 1),
             (None, 3, b"no file", 102, "x", 1), (3, None, b"no offset", 103, "x", 1), (5, 9, None, 104, "x", 1)]
    schema = "file_id bigint, at bigint, record binary, label bigint, node string, hash int"
    first = warc_fixity.hash_records(spark.createDataFrame(rows, schema))
    lost, changed = {3, 40, 100}, {0, 17, 101}
    other = [(f, at, r + b"!" if k in changed else r, k, x, y) for f, at, r, k, x, y in rows if k not in lost]
    second = warc_fixity.hash_records(spark.createDataFrame(other, schema))
    at = {k: (f, a) for f, a, _, k, *_ in rows}
    want = {(*at[k], "only_first") for k in (3, 40)} | {(*at[k], "differs") for k in changed | {100}}
    assert {(r.file_id, r.at, r.status) for r in warc_fixity.audit(first, second).collect()} == want
    assert warc_fixity.audit(first, first).count() == 0


def test_fixity_pages_without_id(spark, tmp_path):
    import duckdb

    rows = [(i if i % 3 else None, f"http://h/{i}" if i % 5 else None, f"<p>{i}</p>" * (i % 9) if i % 7 else None) for i in range(900)]
    rows += [(-5, "u", "x"), (-5, "u", "x"), (1 << 40, "v", "y" * 1000), (5, None, None), (None, None, None), (None, None, None)]
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(path)
    got = sorted(map(repr, map(tuple, QUERIES["op6_warc_fixity"](spark, str(tmp_path)).collect())))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{path}/*.parquet')")
    assert got == sorted(map(repr, con.execute(ORACLES["op6_warc_fixity"]).fetchall())) and len(got) > 5


# ---- 7 licenses ------------------------------------------------------------

def test_license_base(docs, no_docs):
    def brute(t):
        w = WORD.findall(lower(t))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            hit = [k for k in range(len(w)) if w[k:k + len(p)] == p]
            at += hit
            labels |= {label} if hit else set()
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))
    want = sorted(repr((i, *brute(t))) for i, t in texts_of(docs))
    assert rows_of(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == want
    assert license_scan.scan(no_docs).count() == 0


def test_license_notices(spark):
    label, text = license_scan.NOTICES[0]
    w = text.split()
    rows = [(1, "before " + text + " after"), (2, " ".join(w[:12] + ["inserted"] + w[12:])),
            (3, " ".join(w[:9])), (4, "nothing to see")]
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got[1][0].labels == label and got[1][0].score == pytest.approx(1.0)
    assert got[2][0].labels == label and 0.8 <= got[2][0].score < 1
    assert got[3][0].labels == "" and got[4][0].score == 0 and got[1][0].n_base == 0


def test_license_shift_up_to_similarity(spark):
    """Words put into the middle of a notice, as many as the similarity allows and one more;
    pieces of the notice before and behind it do not count against it."""
    rows, want = [], {}
    for n, (label, text) in enumerate(license_scan.NOTICES):
        w = text.split()
        gap = max(g for g in range(len(w)) if len(w) / (len(w) + g) >= license_scan.MIN_SIMILARITY)
        more = [f"more{i}" for i in range(gap + 1)]
        half, scores = len(w) // 2, (len(w) / (len(w) + gap), 0, 1, len(w) / (len(w) + gap))
        texts = (w[:half] + more[:gap] + w[half:], w[:half] + more + w[half:], w[:5] * 6 + w + w[-6:] * 6,
                 w[:5] * 6 + w[:half] + more[:gap] + w[half:] + w[-6:] * 6)
        for k, (t, score) in enumerate(zip(texts, scores)):
            rows.append((10 * n + k, " ".join(t)))
            want[10 * n + k] = (score, label)
    rows.append((1000, rows[0][1] + " x" * 50 + " " + rows[0][1]))
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    for i, (score, label) in want.items():
        best = max((s.similarity for s in got[i][0].spans or [] if s.last - s.first > 4 and s.label == label), default=0)
        assert best == pytest.approx(score), (i, label)  # base phrases have up to four words
        assert score == 0 or label in got[i][0].labels.split(",") and got[i][0].score >= best
    assert [s.label for s in got[0][0].spans] == ["mit"] and [s.label for s in got[1000][0].spans] == ["mit", "mit"]


# ---- 8 token counts --------------------------------------------------------

def test_attribution_rule():
    start, end = np.array([0, 2, 5, 6]), np.array([2, 5, 6, 10])
    section, crossing = token_attribution.allocate(start, end, np.array([3, 8, 10]))
    assert section.tolist() == [0, 1, 1, 1] and crossing.tolist() == [False, True, False, True]


def test_attribution(spark, docs, no_docs):
    import tiktoken  # noqa: F401

    got = by_id(token_attribution.attribute(docs, vocabulary("byte_bpe_50k.tiktoken")).collect())
    enc = token_attribution.Encoder(open(vocabulary("byte_bpe_50k.tiktoken")).read())
    for i, t in texts_of(docs):
        rows = got[i]
        copies = sum(1 for j, _ in texts_of(docs) if j == i)
        assert sum(r.n_tokens for r in rows) == copies * len(enc.tok.encode_ordinary(t or ""))
        assert sum(r.n_chars for r in rows) == copies * len(t or "")
        assert len(rows) == copies * len((t or "").split("\n"))
    assert token_attribution.attribute(no_docs, vocabulary("byte_bpe_50k.tiktoken")).count() == 0


# ---- 9 BPE -----------------------------------------------------------------

def test_bpe_matches_library():
    import random

    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    own = bpe.ByteBpe(open(vocabulary("byte_bpe_50k.json"), encoding="utf-8").read())
    rnd = random.Random(9)
    parts = list("abcdeABE  \n\t'sdtl012.,!?&-<|>éßİK中日🙂́\u0085  \x0b\x1c\x00") \
        + ["<|endoftext|>", "the", "   ", " \n", "'ll", "ing", "aaaa"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 50))) for _ in range(1500)] + ["a" * 4000, " " * 999, "ab" * 999]
    for t in texts:
        want = tok.encode(t, add_special_tokens=False).ids
        ids = np.frombuffer(own.encode(t.encode()), "<u4")
        assert ids.tolist() == want, repr(t)
        assert own.decode(ids).decode() == tok.decode(want, skip_special_tokens=False)
    for _ in range(300):  # broken sequences
        ids = rnd.choices(range(50257), k=8)
        assert own.decode(np.array(ids, "<u4")).decode() == tok.decode(ids, skip_special_tokens=False)


def test_bpe_on_documents(docs, no_docs):
    rows = bpe.decode(bpe.encode(docs, vocabulary("byte_bpe_50k.json")), vocabulary("byte_bpe_50k.json")).collect()
    assert all(r.decoded == (r.text or "") and r.raw == "r" for r in rows) and len(rows) == docs.count()
    got = bpe.digest(bpe.round_trip(docs, vocabulary("byte_bpe_50k.json")))
    want = sorted(repr((i, hashlib.sha256((t or "").encode()).hexdigest())) for i, t in texts_of(docs))
    assert rows_of(got, "doc_id", "decoded_sha256") == want
    assert bpe.digest(bpe.round_trip(no_docs, vocabulary("byte_bpe_50k.json"))).count() == 0


# ---- 10 decontamination ----------------------------------------------------

def test_decontaminate(spark, docs, no_docs, monkeypatch):
    items = [(1, " ".join(PASSAGE.split()[5:30])), (2, "TWO words"), (3, None), (4, ""), (5, "not there at all"),
             (5, "quick brown fox"), (None, "one"), (10, "ab " * 20)]
    bench = spark.createDataFrame(items, "item_id bigint, text string")

    def brute(t):
        w, hit, names = WORD.findall(lower(t)), set(), set()
        for i, s in items:
            v = WORD.findall(lower(s))
            n = min(10, len(v))
            for k in range(len(v) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p:p + n] == v[k:k + n]:
                        hit |= set(range(p, p + n))
                        names |= {i} - {None}
        return (len(w), len(hit), len(names),
                hashlib.sha256(",".join(sorted(map(str, names))).encode()).hexdigest(), bool(hit))
    few = docs.where("doc_id <> 9 or doc_id is null")
    want = sorted(repr((i, *brute(t))) for i, t in texts_of(few))
    cols = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert rows_of(decontaminate.digest(decontaminate.scan(few, bench)), *cols) == want
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)  # several blocks give the same rows
    many = decontaminate.scan(few, bench)
    assert many._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1  # however many blocks
    assert rows_of(decontaminate.digest(decontaminate.scan(few, bench)), *cols) == want
    monkeypatch.undo()
    assert decontaminate.digest(decontaminate.scan(no_docs, bench)).count() == 0
    assert decontaminate.scan(docs, bench.where("1 = 0")).where("size(__columbine_spans) > 0").count() == 0
    left = decontaminate.decontaminate(docs, bench)
    assert left.columns == docs.columns and left.where("doc_id in (5, 10)").count() == 0
    cut = by_id(decontaminate.decontaminate(docs, bench, remove="spans").collect())
    assert cut[5][0].text == "" and "passage7 " not in cut[10][0].text and cut[10][0].text.startswith("head passage0")
