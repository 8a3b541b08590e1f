"""Removal of repeated byte strings with a difference-cover suffix sample.

Every byte covered by a string of ``length`` bytes that also starts anywhere
else goes.  Such a string is a common prefix of two suffixes; the method is the
distributed difference-cover one, cut off where prefixes pass ``length``:

1. *Sample.*  Places are sampled whose residue modulo v is in a perfect
   difference cover D: every difference of residues is one of two members of D.
   So for any two starts i and j there is a shift d < v with i + d and j + d both
   sampled, and if the strings at i and j are equal, so are the tuples of
   length - v + 1 bytes at i + d and j + d.  v is the largest one in ``COVERS``
   up to ``REACH`` of the length: 9 % of the places at 133.
2. *Sort and name.*  Sampled tuples are named by a hash of their bytes and
   sorted: every batch of texts sorts its names, sends them packed by their
   highest bits, and a task sorts what it gets of one range.  Equal neighbours
   of different places survive; names that occur once end here, and most do.
3. *Recurse on names.*  Survivors are named anew by a longer tuple, the whole
   stretch that all starts of the sample reach (v - 1 bytes before it, ``length``
   after it).  Equal stretches are repeated entirely; names of which all
   stretches are equal are done.  One level of recursion is enough: a stretch is
   longer than the prefix that matters.
4. *Merge the remaining suffixes, compare prefixes.*  Starts within v of a
   surviving sample whose stretches differ are merged into the group of their
   sample: one copy of each stretch is taken, and a task sorts the starts of the
   groups it gets by (name, distance of the sample, ``length`` bytes) and
   compares neighbours.  A name with more than ``GROUP`` stretches is compared
   by rows instead, in blocks of ``STEP`` starts first, then singly where a
   block is open.

Names are 64-bit hashes, a level's always within a group that agrees in the
name of the level before.

A name found twice within a batch is sent on once, whatever its number, so a
passage of a third of all texts is as many entries as there are batches;
whole copies of a text share their places and are one.  Spark shuffles 11 bytes
for each sampled place, the texts once for the survivors and once for the
result; aggregations combine map-side, joins may be split by size, and the
largest value held is one text.

Defined cases: null and empty texts, and texts shorter than ``length``, lose
nothing; rows with equal texts are copies of each other; an empty table gives
no rows; other columns pass through ``deduplicate`` unchanged.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columbine.llm.common import let_go, materialize, release, text_bytes

LENGTH = 400
# Passages: some 50 words of short words, 35 of usual ones.
PASSAGE = 200
STEP = 25
# Part of a length that a cover may take up.
REACH = 0.7
# Perfect difference covers, modulus to residues.
COVERS = {
    3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18),
    57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63),
    91: (0, 1, 3, 9, 27, 49, 56, 61, 77, 81), 133: (0, 1, 3, 12, 20, 34, 38, 81, 88, 94, 104, 109),
}
# Bytes hashed together.
CHUNK = 1 << 18
# A place on its way to its name's range: bits of the sample's number within
# its text, bits of the text's hash.  Places that agree in them only add survivors.
SAMPLE_BITS = 16
TEXT_BITS = 32
# Bytes of a name beside its range, and of a place.
NAME_BYTES, PLACE_BYTES = 5, 6
# Stretches of a name that one task may compare.
GROUP = 20_000
# Ranges of names for each shuffle partition.
RANGES = 4


class Cover:
    """Sampled places and tuple names for strings of ``length`` bytes."""

    def __init__(self, length: int):
        self.length = length
        self.v = max([m for m in COVERS if m <= REACH * length], default=1)
        self.residues = np.array(COVERS.get(self.v, (0,)), np.int64)
        self.tuple = length - self.v + 1

    def place(self, sample: np.ndarray) -> np.ndarray:
        """Byte offset of the samples of a text, by their number."""
        return sample // len(self.residues) * self.v + self.residues[sample % len(self.residues)]

    def count(self, size: int) -> int:
        """Sampled places of a text whose tuple ends inside it."""
        starts = size - self.tuple + 1
        if starts <= 0:
            return 0
        return starts // self.v * len(self.residues) + int(np.searchsorted(self.residues, starts % self.v))

    def names(self, raw: bytes) -> np.ndarray:
        """Name of every sampled tuple of a text, in order of its place."""
        return tuple_names(raw, self.place(np.arange(self.count(len(raw)))), self.tuple)


@functools.lru_cache(4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, of its inverse, and a random number for every byte."""
    odd = 0x9E3779B97F4A7C15
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, odd, np.uint64))))
    down = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, pow(odd, -1, 1 << 64), np.uint64))))
    return up, down, np.random.default_rng(42).integers(0, 1 << 64, 256, np.uint64)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _hashes(b: np.ndarray, p: np.ndarray, size: int, most: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place ``p`` of up to ``most`` bytes."""
    up, down, byte = _powers(-(-most // (1 << 12)) << 12)  # few sizes
    total = np.empty(len(b) + 1, np.uint64)
    total[0] = 0
    np.cumsum(byte[b] * up[:len(b)], out=total[1:])
    return (total[p + size] - total[p]) * down[p]


def tuple_names(raw: bytes, places: np.ndarray, size: int) -> np.ndarray:
    """Names of the tuples of ``size`` bytes at ascending places of a text."""
    out, at = np.empty(len(places), np.uint64), 0
    for lo in range(0, len(raw), CHUNK):
        to = int(np.searchsorted(places, lo + CHUNK))
        if to > at:
            b = np.frombuffer(raw, np.uint8, min(CHUNK + size, len(raw) - lo), lo)
            out[at:to] = _stirred(_hashes(b, places[at:to] - lo, size, CHUNK + size))
            at = to
    return out


@functools.lru_cache(4)
def cover_of(length: int) -> Cover:
    return Cover(length)


def _packed(values: np.ndarray, width: int, cut: np.ndarray) -> pa.Array:
    """Slices [cut[i], cut[i + 1]) of the values' ``width`` lowest bytes as binary values."""
    low = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])
    return pa.Array.from_buffers(pa.binary(), len(cut) - 1,
                                 [None, pa.py_buffer((width * cut).astype(np.int32)), pa.py_buffer(low)])


def _unpacked(column: pa.ChunkedArray, width: int) -> np.ndarray:
    low = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :width] = low
    return out.view("<u8").ravel()


def _ranges(docs: DataFrame, length: int, bits: int) -> DataFrame:
    """Every batch's sorted names by range: (range, names, places); places
    whose name a batch has found twice come without names, below range 0."""
    def run(batches):
        let_go()
        cover = cover_of(length)
        for b in batches:
            k1 = b.column(0).to_numpy().view(np.uint64)
            k2, seen, names, places = b.column(1).to_numpy(), set(), [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
            for i, value in enumerate(b.column(2)):
                if (int(k1[i]), int(k2[i])) in seen:
                    continue
                seen.add((int(k1[i]), int(k2[i])))
                n = cover.names(value.as_py())
                names.append(n)
                text = k1[i] >> np.uint64(64 - TEXT_BITS) << np.uint64(SAMPLE_BITS)
                places.append(text | np.arange(len(n), dtype=np.uint64) & np.uint64((1 << SAMPLE_BITS) - 1))
            name = np.concatenate(names) >> np.uint64(64 - 8 * NAME_BYTES - bits)
            order = np.argsort(name, kind="stable")
            name, place = name[order], np.concatenate(places)[order]
            same = name[1:] == name[:-1]
            first, twice = np.ones(len(name), bool), np.zeros(len(name), bool)
            first[1:] = ~same
            twice[1:] = same
            twice[:-1] |= same
            sure, name, place = place[twice], name[first], place[first]
            of = (name >> np.uint64(8 * NAME_BYTES)).astype(np.int32)
            begin = np.flatnonzero(np.concatenate((np.ones(min(1, len(of)), bool), of[1:] != of[:-1])))
            cut = np.append(begin, len(of))
            if len(begin):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(of[begin]), _packed(name, NAME_BYTES, cut), _packed(place, PLACE_BYTES, cut)], names=columns)
            if len(sure):
                away = -1 - int(sure[0] >> np.uint64(SAMPLE_BITS)) % (1 << bits)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([away], pa.int32()), pa.array([b""], pa.binary()),
                     _packed(sure, PLACE_BYTES, np.array([0, len(sure)]))], names=columns)

    columns = ["range", "names", "places"]
    return docs.select("k1", "k2", "raw").mapInArrow(run, "range int, names binary, places binary")


def _survivors(docs: DataFrame, length: int) -> DataFrame:
    """(text, sample): sampled places whose name another batch has too, or
    the same one twice; ``text`` has the highest bits of k1."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits = (RANGES * parts - 1).bit_length()

    def meet(t: pa.Table) -> pa.Table:
        places = _unpacked(t.column("places"), PLACE_BYTES)
        if t.column("range")[0].as_py() >= 0:
            name = _unpacked(t.column("names"), NAME_BYTES)
            order = np.argsort(name, kind="stable")  # a merge: every row is sorted
            same = np.diff(name[order]) == 0
            twice = np.zeros(len(name), bool)
            twice[1:] = same
            twice[:-1] |= same
            places = places[order[twice]]
        return pa.table({"text": (places >> np.uint64(SAMPLE_BITS)).astype(np.int64),
                         "sample": (places & np.uint64((1 << SAMPLE_BITS) - 1)).astype(np.int32)})

    return _ranges(docs, length, bits).groupBy("range").applyInArrow(meet, "text bigint, sample int")


def _named(texts: DataFrame, least: int, length: int) -> DataFrame:
    """Rows (k1, k2, place, back, more, name, stretch) of the surviving places
    of (k1, k2, raw, samples), sampled for strings of ``least`` bytes."""
    def run(batches):
        let_go()
        cover = cover_of(least)
        tuple_ = length - cover.v + 1
        digest = xxhash.xxh64_intdigest
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            parts = []
            for i, value in enumerate(b.column(2)):
                raw = value.as_py()
                s, n = np.asarray(b.column(3)[i].values, np.int64), cover.count(len(raw))
                s = (np.arange(0, max(n, 1), 1 << SAMPLE_BITS)[:, None] + s).ravel()  # numbers wrap in very long texts
                q = cover.place(np.sort(s[s < n]))
                q = q[q + tuple_ <= len(raw)]
                lo, hi = np.maximum(q - cover.v + 1, 0), np.minimum(q, len(raw) - length)
                if len(q) and len(raw) >= length:
                    stretch = [digest(raw[x:y], z) for x, y, z in zip(
                        lo.tolist(), (hi + length).tolist(), ((q - lo) << 20 | (hi - lo)).tolist())]
                    parts.append((np.full(len(q), k1[i]), np.full(len(q), k2[i]), q, (q - lo).astype(np.int32),
                                  (hi - lo).astype(np.int32), tuple_names(raw, q, tuple_).view(np.int64),
                                  np.array(stretch, np.uint64).view(np.int64)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names=names)

    names = ["k1", "k2", "place", "back", "more", "name", "stretch"]
    return texts.select("k1", "k2", "raw", "samples").mapInArrow(
        run, "k1 bigint, k2 bigint, place bigint, back int, more int, name bigint, stretch bigint")


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(length of every list, values of all lists field by field) of lists of structs without nulls."""
    return (pc.fill_null(pc.list_value_length(lists), 0).to_numpy(),
            [c.to_numpy(zero_copy_only=False) for c in lists.flatten().flatten()])


def _several(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` whose ``keys`` occur with more than one stretch."""
    groups = rows.groupBy(*keys).agg(F.min("stretch").alias("_a"), F.max("stretch").alias("_b")) \
        .where("_a <> _b").select(*keys)
    return rows.join(groups, keys, "left_semi")


def _compare(texts: DataFrame, length: int) -> DataFrame:
    """Start offsets (name, stretch, lo, hi: bytes before the sample) at which
    stretches of one name share ``length`` bytes with another stretch."""
    digest = xxhash.xxh64_intdigest
    step = min(STEP, length)

    def blocks(batches):
        """Of every block of offsets: the bytes that all its starts share, and
        all that they reach (only where the stretch has all of its starts)."""
        for b in batches:
            out = []
            for name, stretch, back, more, raw in zip(*(c.to_pylist() for c in b.columns)):
                for k in range((back - more) // step, back // step + 1):
                    a0, a1 = k * step, k * step + step - 1
                    common = digest(raw[back - a0:back - a1 + length])
                    whole = back - more <= a0 and a1 <= back
                    reach = digest(raw[back - a1:back - a0 + length]) if whole else None
                    out.append((name, stretch, k, common, reach))
            if out:
                n, s, k, c, r = zip(*out)
                as_long = lambda v: pa.array([x if x is None or x < 1 << 63 else x - (1 << 64) for x in v], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(k, pa.int32()), as_long(c), as_long(r)],
                    names=["name", "stretch", "k", "common", "reach"])

    rows = materialize(texts.select("name", "stretch", "back", "more", "raw").mapInArrow(
        blocks, "name bigint, stretch bigint, k int, common bigint, reach bigint"), "suffix-blocks")
    closed = materialize(_several(rows.where("reach is not null"), ["name", "k", "reach"]), "suffix-closed")
    maybe = materialize(_several(rows, ["name", "k", "common"]), "suffix-maybe")
    release(rows)
    still = maybe.join(closed.select("name", "stretch", "k"), ["name", "stretch", "k"], "left_anti")
    # open blocks, and to compare them with, one of each set of equal closed blocks
    other = closed.groupBy("name", "k", "common", "reach").agg(F.min("stretch").alias("stretch")) \
        .join(still.select("name", "k", "common").distinct(), ["name", "k", "common"], "left_semi")
    left = still.select("name", "stretch", "k").union(other.select("name", "stretch", "k")) \
        .groupBy("name", "stretch").agg(F.collect_set("k").alias("ks"))  # at most v / STEP + 2

    def single(batches):
        for b in batches:
            out = []
            for name, stretch, back, more, raw, ks in zip(*(c.to_pylist() for c in b.columns)):
                for k in ks:
                    for a in range(max(k * step, back - more), min(k * step + step - 1, back) + 1):
                        out.append((name, stretch, a, digest(raw[back - a:back - a + length])))
            if out:
                n, s, a, d = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(n, pa.int64()), pa.array(s, pa.int64()), pa.array(a, pa.int32()),
                     pa.array(np.array(d, np.uint64).view(np.int64))], names=["name", "stretch", "a", "bytes"])

    starts = texts.join(left, ["name", "stretch"]).select("name", "stretch", "back", "more", "raw", "ks") \
        .mapInArrow(single, "name bigint, stretch bigint, a int, bytes bigint")
    starts = materialize(starts, "suffix-starts")
    open_ones = _several(starts, ["name", "a", "bytes"]).select(
        "name", "stretch", F.col("a").alias("lo"), F.col("a").alias("hi"))
    whole = closed.select("name", "stretch", (F.col("k") * step).alias("lo"), (F.col("k") * step + step - 1).alias("hi"))
    return whole.union(open_ones)


def _compare_groups(cuts: DataFrame, length: int) -> DataFrame:
    """(k1, k2, first, last): repeated starts of the stretches that occur once,
    from all stretches of names that have up to ``GROUP`` of them.

    A task takes the names of one hash value, gives every start of every
    stretch the hash of its ``length`` bytes, sorts by (name, distance of the
    sample, hash) and compares neighbours.
    """
    parts = RANGES * int(cuts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        col = {c: t.column(c).to_numpy() for c in ("name", "k1", "k2", "place", "back", "more", "n")}
        raws = t.column("raw").chunk(0)
        off = np.frombuffer(raws.buffers()[1], np.int32, len(raws) + 1, 4 * raws.offset).astype(np.int64)
        data, parts = np.frombuffer(raws.buffers()[2], np.uint8), []
        i = 0
        while i < len(raws):
            to = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
            count = col["more"][i:to].astype(np.int64) + 1
            of = np.repeat(np.arange(i, to), count)
            j = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
            h = _stirred(_hashes(data[off[i]:off[to]], off[of] - off[i] + j, length, CHUNK + 2 * length))
            group = (col["name"][of].view(np.uint64) + (col["back"][of] - j).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((of, j, (h ^ group ^ (group >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)))
            i = to
        of, j, key = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(key)
        same = np.diff(key[order]) == 0
        again = np.zeros(len(key), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        again &= col["n"][of] == 1
        x = np.flatnonzero(again)
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1] + 1) | (of[x[1:]] != of[x[:-1]])
        a = np.flatnonzero(new)
        z = np.append(a[1:], len(x))[:len(a)] - 1
        row, start = of[x[a]], (col["place"] - col["back"])
        return pa.table({"k1": col["k1"][row], "k2": col["k2"][row], "first": start[row] + j[x[a]], "last": start[row] + j[x[z]]})

    return cuts.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(parts))).groupBy("part").applyInArrow(
        meet, "k1 bigint, k2 bigint, first bigint, last bigint")


def _spans(texts: DataFrame, least: int, length: int) -> DataFrame:
    """(k1, k2, length, first, last): intervals of repeated starts in the
    surviving neighbourhoods of (k1, k2, raw, samples)."""
    marked = materialize(_named(texts, least, length), "suffix-named")
    classes = materialize(marked.groupBy("name", "stretch").agg(F.count(F.lit(1)).alias("n")), "suffix-classes")
    names = classes.groupBy("name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("all"))
    shared = classes.join(names.where("all > 1").select("name", "k"), "name")
    found = materialize(marked.join(shared, ["name", "stretch"]), "suffix-shared")
    release(classes)
    release(marked)
    whole = found.where("n > 1").select(
        "k1", "k2", (F.col("place") - F.col("back")).alias("first"),
        (F.col("place") - F.col("back") + F.col("more")).alias("last"))

    # one copy of every stretch whose tuple has others too, with its bytes
    # (picked by a hash, so that no text is the copy of very many)
    place = F.struct(F.xxhash64("k1", "k2", "stretch").alias("pick"), "k1", "k2", "place", "back", "more", "n", "k")
    copies = found.where("k > 1").groupBy("name", "stretch").agg(F.min(place).alias("at")) \
        .groupBy("at.k1", "at.k2").agg(F.collect_list(F.struct(
            "name", "stretch", "at.place", "at.back", "at.more", "at.n", "at.k")).alias("wanted"))  # within one text

    def cut(batches):
        for b in batches:
            count, (name, stretch, at, back, more, *rest) = _flat(b.column(3))
            of = np.repeat(np.arange(len(count)), count)
            raws, lo = b.column(2).to_pylist(), at - back
            for x in range(0, len(of), 8192):
                y = slice(x, x + 8192)
                yield pa.RecordBatch.from_arrays([
                    *map(pa.array, (name[y], stretch[y], b.column(0).to_numpy()[of[y]], b.column(1).to_numpy()[of[y]],
                                    at[y], back[y], more[y])), *(pa.array(r[y]) for r in rest),
                    pa.array([raws[i][p:z] for i, p, z in zip(of[y].tolist(), lo[y].tolist(), (lo + more + length)[y].tolist())],
                             pa.binary())],
                    names=["name", "stretch", "k1", "k2", "place", "back", "more", "n", "k", "raw"])

    cuts = materialize(texts.join(copies, ["k1", "k2"]).select("k1", "k2", "raw", "wanted").mapInArrow(
        cut, "name bigint, stretch bigint, k1 bigint, k2 bigint, place bigint, back int, more int, n bigint, k bigint, raw binary"),
        "suffix-stretches")
    single = _compare_groups(cuts.where(F.col("k") <= GROUP), length)
    if (cuts.agg(F.max("k")).first()[0] or 0) > GROUP:  # names of more stretches than a task should hold
        large = cuts.where(F.col("k") > GROUP)
        same = _compare(large, length).join(
            large.where("n = 1").select("name", "stretch", "k1", "k2", "place"), ["name", "stretch"])
        single = single.union(same.select("k1", "k2", (F.col("place") - F.col("hi")).alias("first"),
                                          (F.col("place") - F.col("lo")).alias("last")))
    out = materialize(whole.union(single).select("k1", "k2", F.lit(length).alias("length"), "first", "last").distinct(),
                      "suffix-spans")
    release(found)
    release(cuts)
    return out


def repeated_spans(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """(k1, k2, spans) of texts with repeated strings, from (k1, k2, raw) rows.
    A span (length, first, last) is an interval of starts of repeated strings
    of one of the ``lengths``, in any order."""
    least = min(lengths)
    keys = materialize(docs.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.octet_length("raw")).cast("bigint").alias("size")), "suffix-keys")
    samples = _survivors(docs, least).groupBy("text").agg(F.collect_set("sample").alias("samples"))  # within one text
    wanted = keys.withColumn("text", F.shiftrightunsigned("k1", 64 - TEXT_BITS)).join(samples, "text").select("k1", "k2", "samples")
    wanted = materialize(wanted, "suffix-samples")
    texts = materialize(docs.groupBy("k1", "k2").agg(F.any_value("raw").alias("raw")).join(wanted, ["k1", "k2"]),
                        "suffix-texts")
    spans = [_spans(texts, least, n) for n in sorted(set(lengths))]
    spans += [keys.where((F.col("n") > 1) & (F.col("size") >= n)).select(
        "k1", "k2", F.lit(n).alias("length"), F.lit(0).cast("bigint").alias("first"), (F.col("size") - n).alias("last"))
        for n in sorted(set(lengths))]  # whole copies
    out = spans[0]
    for s in spans[1:]:
        out = out.union(s)
    return out.groupBy("k1", "k2").agg(
        F.collect_set(F.struct("length", "first", "last")).alias("spans"))  # within one text


def merged(spans: pa.ListArray, length: int) -> list[list[tuple[int, int]]]:
    """Byte intervals [a, b) that the repeated strings of ``length`` bytes cover, for every row."""
    count, (of_length, first, last) = _flat(spans)
    row = np.repeat(np.arange(len(count)), count)[of_length == length]
    first, end = first[of_length == length], last[of_length == length] + length
    apart = int(end.max(initial=0)) + 2  # rows lie end to end, with a gap
    first, end = first + row * apart, end + row * apart
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > end[:-1]
    at = np.flatnonzero(new)
    a, z = first[at], end[np.append(at[1:], len(end))[:len(at)] - 1]
    out: list[list] = [[] for _ in count]
    for r, x, y in zip((a // apart).tolist(), (a % apart).tolist(), (z % apart).tolist()):
        out[r].append((x, y))
    return out


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    raw = text_bytes(text_col)
    return docs.withColumns({"__columbine_k1": F.xxhash64(raw), "__columbine_k2": F.xxhash64(F.lit(1), raw)})


def removals(docs: DataFrame, text_col: str = "text", lengths: tuple[int, ...] = (LENGTH,)) -> DataFrame:
    """``docs`` with ``__columbine_spans`` (starts of repeated strings); the text moves once, not as bytes too."""
    keyed = _keyed(docs, text_col)
    spans = repeated_spans(keyed.select(
        F.col("__columbine_k1").alias("k1"), F.col("__columbine_k2").alias("k2"), text_bytes(text_col).alias("raw")), lengths)
    spans = spans.withColumnsRenamed({"k1": "__columbine_k1", "k2": "__columbine_k2", "spans": "__columbine_spans"})
    return keyed.join(spans, ["__columbine_k1", "__columbine_k2"], "left").select(*docs.columns, "__columbine_spans")


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    keep, pos = [], 0
    for a, b in cuts:
        keep.append(raw[pos:a])
        pos = b
    keep.append(raw[pos:])
    return b"".join(keep)


def deduplicate(docs: DataFrame, text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` without the repeated strings of ``length`` bytes; a character cut in two is dropped,
    null texts stay null."""
    rows = removals(docs, text_col, (length,))
    kept = [f for f in docs.schema.fields]
    schema = T.StructType(kept)

    def run(batches):
        for b in batches:
            at = b.schema.names
            texts = [None if old is None else _kept(old.encode(), s).decode("utf-8", "ignore") if s else old
                     for old, s in zip(b.column(at.index(text_col)).to_pylist(),
                                       merged(b.column(at.index("__columbine_spans")), length))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(texts, pa.string()) if f.name == text_col else b.column(at.index(f.name)) for f in kept],
                names=[f.name for f in kept])

    return rows.mapInArrow(run, schema)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
           passage: int = PASSAGE) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, n_passage) per row of
    ``docs``; n_passage: bytes in repeated strings of ``passage`` bytes."""
    rows = removals(docs.select(id_col, text_col), text_col, (length, passage)) \
        .select(id_col, text_bytes(text_col).alias("__columbine_raw"), "__columbine_spans")
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            raw = b.column(1).to_pylist()
            cuts = merged(b.column(2), length)
            kept = [_kept(r, c) for r, c in zip(raw, cuts)]
            yield pa.RecordBatch.from_arrays([
                b.column(0), pa.array([len(r) for r in raw], pa.int64()),
                pa.array([len(r) - len(k) for r, k in zip(raw, kept)], pa.int64()),
                pa.array([len(c) for c in cuts], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
                pa.array([sum(z - a for a, z in c) for c in merged(b.column(2), passage)], pa.int64())],
                names=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return rows.mapInArrow(
        run, f"`{id_col}` {id_type}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
        "n_passage bigint")
