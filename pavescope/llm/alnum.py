"""Words of letters and digits: runs of 0-9, a-z and characters beyond ASCII, after A-Z became lower case.

These are the matches of ``WORD`` in the lower-cased text. A chunk of documents is split at once, over its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_bytes

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHUNK_BYTES = 4 << 20

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_inside = np.zeros(256, bool)
_inside[48:58] = _inside[97:123] = _inside[128:] = True


@dataclass
class Chunk:
    """Words of the documents first … first+len(bounds)-2 of a batch; document i has words bounds[i]:bounds[i+1]."""

    first: int
    words: pa.LargeStringArray
    bounds: np.ndarray


def words_of(text: Column) -> Column:
    """The words of a text, in SQL; null of null."""
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def chunks(column: pa.Array | pa.ChunkedArray, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The words of whole texts, documents of about ``size`` bytes (or one longer document) at a time; a null text has none."""
    data, offsets = text_bytes(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        own, edges = _lower[data[offsets[at] : offsets[to]]], offsets[at : to + 1] - offsets[at]
        inside = _inside[own]
        fresh, last = inside.copy(), inside.copy()
        fresh[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cut = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(own))]  # words end with their document
        fresh[cut], last[cut - 1] = inside[cut], inside[cut - 1]
        starts, ends = np.flatnonzero(fresh), np.flatnonzero(last) + 1
        sizes = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(ends - starts, out=sizes[1:])
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(sizes), pa.py_buffer(np.ascontiguousarray(own[inside])))
        yield Chunk(at, words, np.searchsorted(starts, edges))
        at = to
