"""I-Match document fingerprints.

The lexicon holds the terms (lower-cased words) whose inverse document frequency lies in a band. Document
frequencies are counted over all documents, term by term. As both edges of the band are shares of the documents, the
lexicon has at most 1 / LEAST_SHARE times as many terms as a document on average, whatever the corpus. A document's distinct terms
that are in a randomised subset of the lexicon are sorted and hashed; SUBSETS such subsets, the first the
whole lexicon and the others ever smaller shares of it, make the fingerprint. Two fingerprints are as
alike as the share of equal subset hashes among the subsets that hold a term of either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

SUBSETS = 32
#: Shares of the lexicon in the subsets: the whole, half, a quarter, then evenly from 1/8 to 1/2048 in powers.
SHARES = (1.0, 0.5, 0.25, *(2.0 ** -(3 + 8 * i / (SUBSETS - 4)) for i in range(SUBSETS - 3)))
#: A term is in the lexicon if at least this share of the documents (and two of them) and at most that one hold it.
LEAST_SHARE, MOST_SHARE, LEAST_DOCS = 1 / 4096, 0.25, 2
#: Terms of a task that are summed before they go on.
SUM_TERMS = 1 << 21


def distinct_terms(words: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the chunk, ascending) and their distinct term hashes, sorted in each."""
    doc = np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
    order = np.lexsort((words.hashes, doc))
    doc, terms = doc[order], words.hashes[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (terms[1:] != terms[:-1])] if len(doc) else np.zeros(0, bool)
    return doc[new], terms[new]


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def summed() -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], ["term", "n"])

    for batch in tx.slices(batches):
        for words in tx.hashed_words(*tx.text_bytes(batch.column("text")), lower=True):
            held.append(distinct_terms(words)[1])
        if sum(map(len, held)) > SUM_TERMS:
            yield summed()
    if held:
        yield summed()


def lexicon(docs: DataFrame) -> np.ndarray:
    """The hashes of the terms in the band, ascending."""
    rows = docs.count()
    counts = docs.select("text").mapInArrow(_term_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    band = F.col("n").between(max(LEAST_DOCS, LEAST_SHARE * rows), max(LEAST_DOCS, MOST_SHARE * rows))
    # at most (distinct terms of a document, on average) / LEAST_SHARE
    return np.sort(counts.where(band).select("term").toPandas().term.to_numpy(np.int64).view(tx.U64))


def _within(terms: np.ndarray, band: np.ndarray) -> np.ndarray:
    return band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms if len(band) else np.zeros(len(terms), bool)


def hashes_of(texts: pa.Array, band: np.ndarray) -> np.ndarray:
    """Of each text the subset hashes, 0 for a subset without any of its terms."""
    out = np.zeros((len(texts), SUBSETS), np.uint32)
    for words in tx.hashed_words(*tx.text_bytes(texts), lower=True):
        doc, terms = distinct_terms(words)
        kept = _within(terms, band)
        doc, terms = doc[kept], terms[kept]
        for i, share in enumerate(SHARES):
            in_subset = slice(None) if i == 0 else np.flatnonzero(tx.mix(terms ^ tx.U64(0xA5A5 * i)) <= tx.U64(int(share * (2.0**64 - 2048))))
            d, t = doc[in_subset], terms[in_subset]
            if not len(d):
                continue
            begun = np.flatnonzero(np.r_[True, d[1:] != d[:-1]])
            # sorted distinct terms, chained by their sum and exclusive or
            sums, xors = np.add.reduceat(tx.mix(t), begun), np.bitwise_xor.reduceat(t, begun)
            out[words.first + d[begun], i] = np.maximum((tx.mix(sums ^ tx.mix(xors)) >> tx.U64(32)).astype(np.uint32), 1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row; 1 where neither has a term in any subset."""
    held = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    return np.where(held > 0, same / np.maximum(held, 1), 1.0)


def fingerprint_strings(hashes: np.ndarray) -> list[str]:
    return [row.astype(">u4").tobytes().hex() for row in hashes]


def _deal(bounds: np.ndarray, least: int | None):
    """Rows by range of doc_id, with the first row of each range once more at the end of the range before it (role 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            null = ids.is_null().to_numpy(zero_copy_only=False)
            values = ids.fill_null(0).to_numpy(zero_copy_only=False)
            part = np.where(null, len(bounds), np.searchsorted(bounds, values, side="right"))
            for role, rows, to in ((0, np.arange(len(values)), part), (1, np.flatnonzero(~null & np.isin(values, bounds)), part - 1), (1, np.flatnonzero(~null & (values == (0 if least is None else least)) & (least is not None)), np.full(len(values), len(bounds)))):
                if len(rows):
                    got = batch.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(to[rows].astype(np.int32)), pa.array(np.full(len(rows), role, np.int32)), got.column("doc_id"), got.column("text")], ["part", "role", "doc_id", "text"])

    return run


def _range_starts(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.sort(batch.column("doc_id").drop_null().to_numpy(zero_copy_only=False))
            part, at = np.unique(np.searchsorted(cuts, ids, side="right"), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(ids[at], pa.int64())], ["part", "first"])

    return run


_OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Blocks of (doc_id, text, next text) from rows sorted by part, role and doc_id."""
    first, last, out, size, tail_done = None, None, [], 0, False
    for batch in batches:
        for part, role, i, text in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            if last is not None and part != last[0]:
                out.append((last[1], last[2], first)) if not tail_done else None
                last = None
            if last is None:
                first, tail_done = text, role == 1
                last = (part, i, text)
                continue
            if not tail_done:
                out.append((last[1], last[2], text))
                size += len(last[2])
                tail_done = role == 1
            last = (part, i, text)
            if size > 1 << 22:
                yield out
                out, size = [], 0
    if last is not None and not tail_done:
        out.append((last[1], last[2], first))
    yield out


def _print(band: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in _pairs(batches):
            if not pairs:
                continue
            texts, nexts = [t for _, t, _ in pairs], [x for *_, x in pairs]
            edited = [t[: len(t) - len(t) // 2] + x[: len(t) // 2] for t, x in zip(texts, nexts)]
            # a row's next text is the following row's own, but for the ends of ranges
            own, new = hashes_of(pa.array(texts, pa.large_string()), band), hashes_of(pa.array(edited, pa.large_string()), band)
            after = np.zeros_like(own)
            after[:-1] = own[1:]
            odd = [k for k in range(len(pairs)) if k + 1 == len(pairs) or nexts[k] is not texts[k + 1]]
            after[odd] = hashes_of(pa.array([nexts[k] for k in odd], pa.large_string()), band)
            yield pa.RecordBatch.from_arrays([
                pa.array([i for i, *_ in pairs], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
                pa.array(fingerprint_strings(own)), pa.array(fingerprint_strings(new)), pa.array(likeness(own, new)), pa.array(likeness(own, after)),
            ], schema=_OUT)

    return run


def document_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each row of docs.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next
    document's text, in order of doc_id, the first following the last. Null texts are empty. Rows that
    share a doc_id are ordered by text; null doc_ids come last. A lone document is its own next one. An
    empty table gives an empty result. Other columns are not looked at.
    """
    docs = docs.select("doc_id", "text")
    band = docs.sparkSession.sparkContext.broadcast(lexicon(docs))
    n = tx.partitions_for(docs)
    cuts = docs.agg(F.percentile_approx("doc_id", [(i + 1) / n for i in range(n - 1)] or [0.5], 100_000).alias("cuts"), F.min("doc_id").alias("least")).first()
    # the cuts are near their quantiles; the least doc_id in each range is what bounds it
    around = np.unique(np.array(cuts.cuts or [], np.int64))
    firsts = [r.first for r in docs.select("doc_id").mapInArrow(_range_starts(around), "part int, first long").groupBy("part").agg(F.min("first").alias("first")).collect()]
    bounds = np.array(sorted(set(firsts) - {cuts.least}), np.int64)
    dealt = docs.mapInArrow(_deal(bounds, cuts.least), "part int, role int, doc_id long, text string")
    dealt = dealt.repartition(n, "part").sortWithinPartitions("part", "role", F.col("doc_id").isNull(), "doc_id", "text")
    return dealt.mapInArrow(lambda batches: _print(band.value)(batches), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
