"""Runs of periodic text, proposed by a dictionary of basic factors.

A run is a stretch of consecutive words with smallest period q and a length of
at least max(``min_length``, 2q) that no neighbouring word extends keeping the
period.

**Dictionary.** Level k names every factor of h = 2^k words that occurs more
than once in its text; a factor's name is the pair of its halves' names, made
dense by hashing.  A factor that occurs once is in no longer factor that
occurs twice, so it leaves, and ordinary text leaves after two or three levels.

**Proposals.** Occurrences of one name that follow each other within h / 2
are an arithmetic progression: a chain, whose difference is the factor's own
period.  Level k looks for periods of h to 2h - 1, so for occurrences within
2h of each other.  Two chains of a name start more than h / 2 apart, so at most
three further chains lie in reach.  Every occurrence proposes its distances to
the first and to the last occurrence of the three chains on either side.

These are enough.  Let [s, e) be a run of period q, h <= q < 2h.  The factor at
s stands at s + q too, in another chain (in the same one the run would have the
chain's difference as a period).  Let the two chains' stretches, periodic in
that difference, be [s1, e1) and [s2, e2).  Left of s the run ends, and inside
both stretches it could not, so s + q = s2, when s + q is the second chain's
first occurrence, or s = s1, when s is the first chain's first occurrence.  In
the second case, on the right either both stretches end together (last to
last), or the run ends with the second one (an occurrence to the last of the
next chain), or its first period ends with the first stretch (first of the
chain before to an occurrence).  All of these are proposed.

**Extension.** Proposals of one period that touch are one; each is extended to
both sides while words a period apart agree.  Equal stretches proposed with
several periods keep the smallest.

Texts are batched and named together, so short texts cost no calls of their
own; a name never crosses texts.  Memory is some 100 bytes for each word of a
batch (16 MB of text, or one longer text).

Defined cases: null and empty texts have no words and no run; repeated rows
each get their result; a null id is handed to ``prepare`` as None; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from columbine.llm.common import text_bytes

MIN_LENGTH = 12
# Chains of a name in reach of an occurrence on one side: starts are over h / 2 apart, reach is under 2h.
CHAINS = 3

RUN_TYPE = "array<struct<start: bigint, length: bigint, period: bigint>>"


def _dense(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(dense codes, whether the key occurs more than once)."""
    code, _ = pd.factorize(key)
    return code, np.bincount(code, minlength=1)[code] > 1 if len(code) else np.zeros(0, bool)


def _proposals(pos: np.ndarray, name: np.ndarray, h: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) proposed by the occurrences ``pos`` of the names ``name`` of length h."""
    order = np.argsort(name, kind="stable")  # positions ascend within a name
    p, n = pos[order], name[order]
    fresh = np.empty(len(p), bool)
    fresh[0] = True
    fresh[1:] = (n[1:] != n[:-1]) | (2 * (p[1:] - p[:-1]) > h)
    chain = np.cumsum(fresh) - 1
    at = np.flatnonzero(fresh)
    first, last, of = p[at], p[np.append(at[1:], len(p)) - 1], n[at]
    where, period = [], []
    for t in range(1, CHAINS + 1):
        if len(at) <= t:
            break
        for ahead in (True, False):
            to = chain + t if ahead else chain - t
            x = np.flatnonzero((to < len(at)) & (to >= 0))
            x = x[of[to[x]] == n[x]]
            for end in (first, last):
                other = end[to[x]]
                d = other - p[x] if ahead else p[x] - other
                ok = (d >= h) & (d < 2 * h)
                where.append((p[x] if ahead else other)[ok])
                period.append(d[ok])
    return (np.concatenate(where), np.concatenate(period)) if where else (p[:0], p[:0])


def _agree(w: np.ndarray, i: int, j: int, most: int, step: int) -> int:
    """How many words agree from i and j on, to the right (step 1) or left (-1), at most ``most``."""
    got, block = 0, 16
    while got < most:
        k = min(block, most - got)
        a, b = i + step * got, j + step * got
        x, y = (w[a:a + k], w[b:b + k]) if step > 0 else (w[a - k + 1:a + 1][::-1], w[b - k + 1:b + 1][::-1])
        bad = x != y
        if bad.any():
            return got + int(bad.argmax())
        got += k
        block *= 4
    return got


def find(words: np.ndarray, text: np.ndarray, min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) in order of (start, period) over the
    concatenation of texts: ``words`` are word codes, ``text`` ascending
    numbers of the texts that the words are in."""
    total = len(words)
    if total == 0:
        return []
    begin = np.searchsorted(text, text, "left")
    end = np.searchsorted(text, text, "right")
    name = np.full(total, -1, np.int64)
    name[:], again = _dense(text.astype(np.int64) * (int(words.max()) + 1) + words)
    pos = np.flatnonzero(again)
    near = np.flatnonzero((words[1:] == words[:-1]) & (text[1:] == text[:-1]))
    found, periods, h = [near], [np.ones(len(near), np.int64)], 1
    while len(pos):
        alive = np.zeros(total, bool)
        alive[pos] = True
        pos = pos[pos + h < end[pos]]
        pos = pos[alive[pos + h]]
        if not len(pos):
            break
        code, again = _dense(name[pos] * total + name[pos + h])
        pos, code, h = pos[again], code[again], 2 * h
        if not len(pos):
            break
        name[pos] = code
        i, d = _proposals(pos, code, h)
        found.append(i)
        periods.append(d)
    at, period = np.concatenate(found), np.concatenate(periods)
    key = np.unique(period * total + at)
    period, at = key // total, key % total
    best: dict[tuple[int, int], int] = {}
    reach, of = -1, 0  # matches of this period are known up to here
    for i, d in zip(at.tolist(), period.tolist()):
        if d == of and i < reach:
            continue
        left = _agree(words, i - 1, i + d - 1, i - int(begin[i]), -1)
        right = _agree(words, i, i + d, int(end[i]) - i - d, 1)
        of, reach = d, i + right
        length = left + right + d
        if length >= max(min_length, 2 * d):
            best.setdefault((i - left, length), d)  # periods ascend: the smallest comes first
    return sorted((s, n, d) for (s, n), d in best.items())


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what runs repeat: of each run its first period stays,
    unless another run drops it."""
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for s, n, q in runs:
        keep[s + q:s + n] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH,
              prepare=None) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row: all runs in order of
    start and period, and the words that are kept joined by one space.

    ``prepare(id, words)`` may return other words for a text.
    """
    rows = docs.select(id_col, text_bytes(text_col).alias("raw"))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            texts = [r.as_py().split() for r in b.column(1)]
            if prepare is not None:
                texts = [prepare(i, w) for i, w in zip(names, texts)]
            sizes = np.array([len(w) for w in texts], np.int64)
            start = np.cumsum(sizes) - sizes
            flat = pa.array([x for w in texts for x in w], pa.binary())
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs: list[list] = [[] for _ in texts]
            text = np.repeat(np.arange(len(texts)), sizes)
            for s, n, q in find(codes, text, min_length):
                t = int(text[s])
                runs[t].append((s - int(start[t]), n, q))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes),
                 pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs],
                          pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array([_collapse(w, r) for w, r in zip(texts, runs)], pa.binary())],
                names=[id_col, "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"`{id_col}` {id_type}, n_words bigint, runs {RUN_TYPE}, collapsed binary")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Numbers and hashes of ``find_runs``: the longest run (ties: smallest
    start, then period) and SHA-256 of the list of runs and of the kept words."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("less"))))

    def line(r: Column) -> Column:
        return F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n"))

    rows = found.select(id_col, F.size("runs").cast("bigint").alias("n_runs"), top.alias("top"),
                        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, period = -F.col("top.back"), -F.col("top.less")
    return rows.select(id_col, "n_runs", start.alias("start"), F.col("top.length").alias("length"),
                       period.alias("period"), F.expr("1000 * top.length div -top.less").alias("exponent_milli"),
                       "runs_sha256", "collapsed_sha256")
