"""Byte-level BPE: exact encoding by backtracking, decoding by offset table.

A piece of text (what the pre-tokenizer pattern cuts out) is encoded without
merging: one Aho-Corasick pass gives the longest token that starts at every
byte, and tokens are laid left to right.  A token may follow another only if
the pair is *compatible*, that is, if BPE of their joined bytes keeps exactly
these two; sequences whose neighbours are all compatible are what the merges
give.  Where a token cannot follow, the next shorter token that is its prefix
is tried, and with none left the token before it is taken back.  A position
found to be a dead end is never entered again, so the work is linear.

Decoding looks ids up in a table of byte offsets into one blob of all token
bytes and gathers whole texts at once.

Repeated chunks of text are encoded once per worker (a bounded memo, freed when
another operator's task comes).  Rows go out in batches of a few MB of text.  The
vocabulary travels as a broadcast of its file's text, whose size is fixed.

Defined cases: a null text is the empty text (no ids); special tokens written
out in a text get their own id; bytes that are no UTF-8 count as U+FFFD;
repeated rows repeat; an empty table gives no rows; other columns pass.
"""

from __future__ import annotations

import json
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from columbine.llm.common import keep_in_worker, read_driver_file, text_bytes

# Entries a worker's memo holds before its older half goes.
MEMO_ENTRIES = 400_000
# Longest stretch in the memo: it stays under 0.25 GB.
MEMO_BYTES = 64
# Text encoded before its rows go out: ids and decoded text are some 5 times as much at a time.
OUT_BYTES = 2 << 20

# The pre-tokenizer pattern of byte-level BPE files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Two white-space bytes in a row, or white space beyond ASCII: only then can
# a cut before single spaces differ from the pattern's own cuts.
_IRREGULAR = regex.compile(
    rb"[\x09-\x0d\x1c-\x20]{2}|\x00|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")

# ASCII marks that never take part in a contraction
_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'")


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of every byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class ByteBpe:
    """Encoder and decoder over one vocabulary file (tokenizers JSON)."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        alphabet = byte_alphabet()
        raw = {s: bytes(alphabet[c] for c in s) for s in spec["model"]["vocab"]}
        vocab = spec["model"]["vocab"]
        size = 1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])])
        # merge order decides everything, so tokens are numbered by it inside
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        made = {a + b for a, b in merges}
        order = [s for s in vocab if s not in made] + list(dict.fromkeys(a + b for a, b in merges))
        self.rank = {raw[s]: r for r, s in enumerate(order)}
        self.tokens = [raw[s] for s in order]
        self.public = [vocab[s] for s in order]
        self.base = len(order) - len(made)
        self.left, self.right = list(range(len(order))), list(range(len(order)))
        self.pair: dict[tuple[int, int], int] = {}
        for a, b in merges:
            x, y, z = self.rank[raw[a]], self.rank[raw[b]], self.rank[raw[a + b]]
            if (x, y) not in self.pair:
                self.pair[x, y] = z
                if self.left[z] == z:
                    self.left[z], self.right[z] = x, y
        self.shorter = [next((r for n in range(len(t) - 1, 0, -1) if (r := self.rank.get(t[:n])) is not None), -1)
                        for t in self.tokens]
        # matches ending at a byte of the reversed text start there in the text itself
        self.matcher = ahocorasick.Automaton()
        for r, t in enumerate(self.tokens):
            self.matcher.add_word(t[::-1].decode("latin-1"), r)
        self.matcher.make_automaton()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")"
        ) if self.special else None
        self.special_bytes = [s.encode() for s in self.special]
        self.pieces = regex.compile(PATTERN)
        by_id = [b""] * size
        for t, i in zip(self.tokens, self.public):
            by_id[i] = t
        for s, i in self.special.items():
            by_id[i] = s.encode()
        self.blob = np.frombuffer(b"".join(by_id), np.uint8)
        self.offset = np.concatenate(([0], np.cumsum([len(t) for t in by_id]))).astype(np.int64)
        self.packed = [np.array([i], "<u4").tobytes() for i in self.public]
        self.length = [len(t) for t in self.tokens]
        self.seams: dict[int, bool] = {}
        self.memo: dict[bytes, bytes] = {b"": b""}

    # ---- pieces -------------------------------------------------------

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side.

        The merges next to the seam are undone, latest first.  If a pair seen
        at the seam merges into a token that comes before the merges undone so
        far, BPE would have crossed the seam at that time.
        """
        key = a << 20 | b
        known = self.seams.get(key)
        if known is not None:
            return known
        bound, ok = len(self.tokens), True
        while True:
            z = self.pair.get((a, b))
            if z is not None and z < bound:
                ok = False
                break
            if max(a, b) < self.base:
                break
            if a > b:
                bound, a = a, self.right[a]
            else:  # of two equal merges the left one comes first
                bound, b = b + 1, self.left[b]
        self.seams[key] = ok
        return ok

    def encode_piece(self, piece: bytes) -> list[int]:
        """Internal numbers of the tokens of one piece."""
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        last = n - 1
        longest = [-1] * n
        for end, r in self.matcher.iter(piece[::-1].decode("latin-1")):
            if longest[last - end] < 0:  # the longest match at a place comes first
                longest[last - end] = r
        length, seams, compatible = self.length, self.seams, self.compatible
        open_at = bytearray(b"\x01") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            end = pos + length[token]
            if open_at[end]:
                fits = not out
                if not fits:
                    before = out[-1]
                    fits = seams.get(before << 20 | token)
                    if fits is None:
                        fits = compatible(before, token)
                if fits:
                    out.append(token)
                    pos = end
                    token = longest[pos] if pos < n else -1
                    continue
            if self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                open_at[pos] = 0
                token = out.pop()
                pos -= length[token]
        return out

    def _piece(self, piece: bytes) -> bytes:
        ids = self.memo.get(piece)
        if ids is None:
            packed = self.packed
            ids = b"".join([packed[r] for r in self.encode_piece(piece)])
            if len(piece) <= MEMO_BYTES:
                self.memo[piece] = ids
        return ids

    def _pieces(self, raw: bytes) -> bytes:
        return b"".join([self._piece(p.encode()) for p in self.pieces.findall(raw.decode("utf-8", "replace"))])

    def _chunk(self, chunk: bytes) -> bytes:
        """Ids of a stretch of text that a cut before single spaces gave."""
        word = chunk.rstrip(_MARKS)
        try:
            letters = word[1:].decode()
        except UnicodeDecodeError:
            return self._pieces(chunk)
        if word[:1] == b" " and letters.isalpha():  # a word and the marks behind it
            return self._piece(word) + (self._piece(chunk[len(word):]) if len(word) < len(chunk) else b"")
        return self._pieces(chunk)

    def _trim(self) -> None:
        if len(self.memo) > MEMO_ENTRIES:
            for k in list(islice(self.memo, len(self.memo) // 2)):
                del self.memo[k]
            self.memo[b""] = b""
        if len(self.seams) > MEMO_ENTRIES:
            self.seams.clear()

    # ---- texts --------------------------------------------------------

    def encode(self, raw: bytes) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if any(s in raw for s in self.special_bytes):
            parts = self.special_cut.split(raw.decode("utf-8", "replace"))
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p.encode())
                            for k, p in enumerate(parts))
        return self._plain(raw)

    def _plain(self, raw: bytes) -> bytes:
        if _IRREGULAR.search(raw):
            ids = self._pieces(raw)
            self._trim()
            return ids
        chunks = raw.replace(b" ", b"\x00 ").split(b"\x00")
        memo = self.memo
        try:
            return b"".join([memo[c] for c in chunks])
        except KeyError:
            pass
        long = {}
        for c in chunks:
            if c not in memo:
                (memo if len(c) <= MEMO_BYTES else long)[c] = self._chunk(c)
        ids = b"".join([memo[c] for c in chunks] if not long else [memo[c] if c in memo else long[c] for c in chunks])
        self._trim()
        return ids

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes behind ``ids``, gathered through the offset table."""
        start = self.offset[ids]
        size = self.offset[ids.astype(np.int64) + 1] - start
        shift = start - (np.cumsum(size) - size)
        return self.blob[np.repeat(shift, size) + np.arange(int(size.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; broken sequences become U+FFFD."""
        raw = self.decode_bytes(ids)
        try:
            raw.decode("utf-8")
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()


def _load(held) -> ByteBpe:
    """The worker's encoder for a broadcast vocabulary."""
    spec = held.value
    return keep_in_worker(("bpe", hash(spec)), lambda: ByteBpe(spec))


def _parts(batch: pa.RecordBatch, source: str):
    """``batch`` in slices of up to ``OUT_BYTES`` in column ``source``; a longer value is one by itself."""
    values = batch.column(batch.schema.names.index(source))
    lists = pa.types.is_list(values.type)
    sizes = pc.fill_null(pc.list_value_length(values) if lists else pc.binary_length(values), 0).to_pylist()
    at = held = 0
    for k, n in enumerate(sizes):
        n = 4 * n if lists else n
        if k > at and held + n > OUT_BYTES:
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += n
    if at < len(sizes):
        yield batch.slice(at)


def _map(docs: DataFrame, path: str, add: list[T.StructField], source: str, fn) -> DataFrame:
    """``docs`` with columns from ``fn(bpe, value)`` over the binary column ``source``."""
    held = docs.sparkSession.sparkContext.broadcast(read_driver_file(path))
    keep = [f for f in docs.schema.fields if f.name not in {a.name for a in add} and f.name != source]
    schema = T.StructType([*keep, *add])

    def run(batches):
        bpe = _load(held)
        for b in (part for batch in batches for part in _parts(batch, source)):
            rows = [fn(bpe, x.as_py()) for x in b.column(b.schema.names.index(source))]
            new = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.names.index(f.name)) for f in keep] + new, names=[f.name for f in [*keep, *add]])

    from pyspark.sql.pandas.types import to_arrow_type
    types = [to_arrow_type(f.dataType) for f in add]
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's token ids."""
    add = [T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)]
    return _map(docs.withColumn("__columbine_raw", text_bytes(text_col)), path, add, "__columbine_raw",
                lambda bpe, raw: (np.frombuffer(bpe.encode(raw), "<i4"),))


def decode(rows: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``rows`` with ``text_col`` decoded from ``ids_col``; null ids give the empty text."""
    add = [T.StructField(text_col, T.StringType(), False)]
    empty = F.array().cast("array<int>")
    return _map(rows.withColumn("__columbine_ids", F.coalesce(ids_col, empty)), path, add, "__columbine_ids",
                lambda bpe, ids: (bpe.decode(np.array(ids, "<u4")).decode(),))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids, decoded) with both as bytes: encoded, then decoded from those ids."""
    def both(bpe, raw):
        ids = bpe.encode(raw)
        return ids, bpe.decode(np.frombuffer(ids, "<u4"))

    add = [T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.BinaryType(), False)]
    return _map(docs.select(id_col, text_bytes(text_col).alias("__columbine_raw")), path, add, "__columbine_raw", both)


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Token count and checksums of ``round_trip``'s rows."""
    return rows.select(
        id_col, (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
