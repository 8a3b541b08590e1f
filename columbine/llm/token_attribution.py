"""Token counts per section from one encoding of the whole document.

A document is encoded once as a whole.  Every token has a character span;
sections are character spans too.  Both lists are sorted, so the interval join
is one ``searchsorted`` over a document's tokens.  A token that crosses a
boundary goes to the section that holds most of its characters, and with a tie
to the earliest of these (``RULE``).  A character whose bytes two tokens share
counts for both.

Sections of a text here: its lines; the line break belongs to the line that it
ends.  ``attribute`` takes any section function.

Defined cases: null and empty texts have one empty section and no token;
repeated rows repeat; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from columbine.llm.common import read_driver_file, text_bytes

RULE = "most characters, ties to the earliest"

# The pre-tokenizer pattern of the rank file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    def __init__(self, spec: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in spec.splitlines() if line)}
        self.tok = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.length[i] = len(t)

    def spans(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Character spans [start, end) of the tokens of a text."""
        ids = np.asarray(self.tok.encode_to_numpy(raw.decode("utf-8", "replace"), disallowed_special=()))
        end = np.cumsum(self.length[ids])
        start = end - self.length[ids]
        begins = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80
        before = np.concatenate(([0], np.cumsum(begins)))  # characters begun before a byte
        inside = np.append(~begins, False)  # the byte continues a character
        return before[start] - inside[start], before[end]


def line_ends(raw: bytes) -> np.ndarray:
    """Character ends of the lines of a text, line breaks included."""
    b = np.frombuffer(raw, np.uint8)
    before = np.concatenate(([0], np.cumsum((b & 0xC0) != 0x80)))
    return np.append(before[np.flatnonzero(b == 10) + 1], before[-1])


def allocate(start: np.ndarray, end: np.ndarray, section_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(section of each token, whether it crosses a boundary) under ``RULE``."""
    first = np.searchsorted(section_end, start, "right")
    last = np.searchsorted(section_end, end, "left")
    crossing = last > first
    for k in np.flatnonzero(crossing):
        edges = np.concatenate(([start[k]], section_end[first[k]:last[k]], [end[k]]))
        first[k] += int(np.argmax(np.diff(edges)))
    return first, crossing


_LOADED: dict[int, Encoder] = {}


def _load(held) -> Encoder:
    key = hash(held.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(held.value)
    return _LOADED[key]


def attribute(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text",
              sections=line_ends) -> DataFrame:
    """(id_col, section, n_chars, n_tokens, n_crossing) for every section of every row."""
    held = docs.sparkSession.sparkContext.broadcast(read_driver_file(ranks))
    rows = docs.select(id_col, text_bytes(text_col).alias("raw"))
    id_type = dict(docs.dtypes)[id_col]

    def run(batches):
        encoder = _load(held)
        for b in batches:
            names, parts = [], []
            for name, value in zip(b.column(0).to_pylist(), b.column(1)):
                raw = value.as_py().decode("utf-8", "replace").encode()
                ends = sections(raw)
                section, crossing = allocate(*encoder.spans(raw), ends)
                names.extend([name] * len(ends))
                parts.append((np.arange(len(ends)), np.diff(ends, prepend=0),
                              np.bincount(section, minlength=len(ends)),
                              np.bincount(section[crossing], minlength=len(ends))))
            if parts:
                cols = [np.concatenate(c).astype(np.int64) for c in zip(*parts)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names, b.column(0).type), *map(pa.array, cols)],
                    names=[id_col, "section", "n_chars", "n_tokens", "n_crossing"])

    return rows.mapInArrow(
        run, f"`{id_col}` {id_type}, section bigint, n_chars bigint, n_tokens bigint, n_crossing bigint")
