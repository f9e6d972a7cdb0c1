"""Substring deduplication with sharded Aho-Corasick automata.

A passage recurs when a window of WINDOW consecutive words occurs at two places. The steps:

1. Seeds. In every window the K-word sequence with the least hash is its seed, so equal windows
   have equal seeds, and one position in seven is one. Each document shard counts its own seeds;
   counts are summed over the corpus, and a seed confirmed at two places or more recurs.
2. Automata. For each shard the recurring seeds that occur in it are compiled, as sequences of
   8-bit word codes, into one pyahocorasick automaton, so all automata together grow as the text
   and none is broadcast. All documents of the shard stream through it, and every hit marks the windows around it.
3. Exact check. Marked windows are compared by a 96-bit hash of their whole word sequence: first
   inside the shard (so that hot passages leave it once), then over the corpus. Every window but
   the first by (doc_id, start) is a repeat, and the words it covers go.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text as tx

WINDOW, K = 20, 8
NULL_ID = (1 << 63) - 1
_ROW = np.int64(1) << 40


def seeds(words: tx.Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the seeds of all windows."""
    grams, span = tx.rolling(words.hashes, k, 1), window - k + 1
    grams |= tx.U64(1)
    least = tx.sliding(grams, span, True)
    if not len(least):
        return np.zeros(0, np.int64), np.zeros(0, tx.U64)
    least = np.where(words.room()[: len(least)] >= window, least, tx.U64(0))
    around = np.concatenate([np.zeros(span - 1, tx.U64), least, np.zeros(span - 1, tx.U64)])
    at = np.flatnonzero(tx.sliding(around, span, False) == grams)
    return at, grams[at]


def _count_seeds(window: int, k: int):
    def run(batches):
        found: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            for words in tx.hashed_words(*tx.text_bytes(batch.column("text"))):
                at, own = seeds(words, window, k)
                doc = np.searchsorted(words.bounds, at, side="right") - 1
                shard = shards[words.first + doc]
                for s in np.unique(shard):
                    found.setdefault(int(s), []).append(own[shard == s])
        for s, parts in found.items():
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.full(len(values), s, np.int32)), pa.array(np.minimum(counts, 2).astype(np.int8))], ["seed", "shard", "places"])

    return run


_SPOTS = pa.schema([("h", pa.int64()), ("x", pa.int32()), ("doc_id", pa.int64()), ("pos", pa.int64()), ("n", pa.int32())])


def _row_numbers(ids: np.ndarray) -> np.ndarray:
    """0, 1, … inside each run of equal doc_ids."""
    first = np.r_[True, ids[1:] != ids[:-1]] if len(ids) else np.zeros(0, bool)
    begun = np.flatnonzero(first)
    return np.arange(len(ids)) - np.repeat(begun, np.diff(np.r_[begun, len(ids)]))


def _codes(words: tx.Words) -> np.ndarray:
    """Symbols of the automata: eight bits a word.

    A state's edges are searched one by one, so a symbol for each word of a vocabulary makes a slow root. Seeds of
    other words with equal codes only mark windows that the exact check then tells apart.
    """
    return (words.hashes >> tx.U64(56)).astype(np.uint8)


def _locate(window: int, k: int):
    def run(docs: pa.Table, recurring: pa.Table) -> pa.Table:
        if not recurring.num_rows or not docs.num_rows:
            return _SPOTS.empty_table()
        docs = tx.sorted_docs(docs)
        ids = docs.column("doc_id").fill_null(NULL_ID).to_numpy()
        row = _row_numbers(ids)
        known = np.sort(recurring.column("seed").to_numpy().view(tx.U64))
        chunks = list(tx.hashed_words(*tx.text_bytes(docs.column("text"))))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for words in chunks:
            at, own = seeds(words, window, k)
            _, one = np.unique(own, return_index=True)
            one = one[known[np.minimum(np.searchsorted(known, own[one]), len(known) - 1)] == own[one]]
            codes = _codes(words)
            for p in at[one].tolist():
                automaton.add_word(tuple(codes[p : p + k].tolist()), 1)
        automaton.make_automaton()
        h, x, doc, pos = [], [], [], []
        for words in chunks:
            codes, hits = _codes(words), []
            for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist()):
                if b - a >= window:
                    hits += [a + end for end, _ in automaton.iter(tuple(codes[a:b].tolist()))]
            ends = np.array(hits, np.int64)
            edge = np.zeros(len(codes) + 2, np.int32)
            np.add.at(edge, np.maximum(ends - window + 1, 0), 1)
            np.add.at(edge, ends - k + 2, -1)
            marked = np.flatnonzero((np.cumsum(edge)[: len(codes)] > 0) & (words.room() >= window))
            d = np.searchsorted(words.bounds, marked, side="right") - 1
            h.append(tx.rolling(words.hashes, window, 2)[marked])
            x.append(tx.rolling(words.hashes, window, 3, tx.OTHER_STEP)[marked])
            doc.append(words.first + d)
            pos.append(row[words.first + d] * _ROW + marked - words.bounds[d])
        h, x, doc, pos = (np.concatenate(v) for v in (h, x, doc, pos))
        x = (x >> tx.U64(32)).astype(np.uint32).view(np.int32)
        order = np.lexsort((x, h))  # stable: equal windows stay in order of doc_id and start
        later = np.zeros(len(h), bool)
        later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (x[order[1:]] == x[order[:-1]])
        # repeats inside the shard need no more comparing and go on as runs of windows
        again = np.flatnonzero(later)
        new = np.r_[True, (doc[again[1:]] != doc[again[:-1]]) | (pos[again[1:]] != pos[again[:-1]] + 1)] if len(again) else np.zeros(0, bool)
        begun, lone = again[new], np.flatnonzero(~later)
        long = np.diff(np.r_[np.flatnonzero(new), len(again)])
        keep = np.r_[lone, begun]
        n = np.r_[np.zeros(len(lone), np.int32), long.astype(np.int32)]
        return pa.table([h[keep].view(np.int64), x[keep], ids[doc[keep]], pos[keep], n], schema=_SPOTS)

    return run


def _cut(window: int, with_text: bool):
    def run(docs: pa.Table, spots: pa.Table) -> pa.Table:
        docs = tx.sorted_docs(docs)
        ids = docs.column("doc_id").fill_null(NULL_ID).to_numpy()
        row = _row_numbers(ids)
        at: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if spots.num_rows:
            pos = spots.column("pos").to_numpy()
            for i, r, p, n in zip(spots.column("doc_id").to_pylist(), (pos // _ROW).tolist(), (pos % _ROW).tolist(), spots.column("n").to_pylist()):
                at.setdefault((i, r), []).append((p, p + max(n, 1) + window - 1))
        total, gone, digest, kept_text, spans_out = [], [], [], [], []
        for i, r, value in zip(ids.tolist(), row.tolist(), docs.column("text")):
            raw = (value.as_py() or "").encode()
            words = raw.split()
            spans: list[list[int]] = []
            for a, b in sorted(at.get((i, r), ())):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            n = len(words)
            for a, b in reversed(spans):
                del words[a:b]
            total.append(n)
            gone.append(n - len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
            if with_text:
                spans_out.append([{"start": a, "end": b} for a, b in spans])
                kept_text.append(value.as_py() if not spans else _without(raw, spans))
        out = {"doc_id": docs.column("doc_id"), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digest, pa.string())}
        if with_text:
            out |= {"kept_text": pa.array(kept_text, pa.string()), "spans": pa.array(spans_out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        if "carried" in docs.column_names:
            out["carried"] = docs.column("carried")
        return pa.table(out)

    return run


def _without(raw: bytes, spans: list[list[int]]) -> str:
    """The text without the words of the spans, the rest as it was."""
    data = np.frombuffer(raw, np.uint8)
    (words,) = tx.hashed_words(data, np.array([0, len(data)]))
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : words.starts[a]])
        at = int(words.starts[b]) if b < len(words.starts) else len(raw)
    return b"".join([*out, raw[at:]]).decode()


def substring_dedup(docs: DataFrame, window: int = WINDOW, k: int = K, with_text: bool = True, carried: list[str] | None = None) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256 and, with_text, kept_text and spans of removed words.

    carried: other columns of docs to return with each row, as a struct ``carried``.

    Null, empty and short texts lose nothing (null counts as empty; kept_text of an untouched row is
    its text, null included). An empty table gives an empty result. Rows that share a doc_id are
    ordered by text, the later ones losing what the earlier have. A null doc_id comes after all others.
    Other columns are not looked at.
    """
    dealt, n = tx.by_shard(docs, carried)
    counted = dealt.mapInArrow(_count_seeds(window, k), "seed long, shard int, places byte")
    everywhere = Window.partitionBy("seed")
    recurring = counted.withColumn("all", F.sum("places").over(everywhere)).where("all > 1").select("seed", "shard")
    spots = dealt.groupBy("shard").cogroup(recurring.repartition(n, "shard").groupBy("shard")).applyInArrow(_locate(window, k), "h long, x int, doc_id long, pos long, n int")
    first = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("h", "x", F.col("n") > 0, F.when(F.col("n") > 0, F.col("doc_id"))))
    repeats = spots.withColumn("first", first).where("n > 0 OR doc_id != first.doc_id OR pos != first.pos").select("doc_id", "pos", "n")
    owner = F.when(F.col("doc_id") != NULL_ID, F.col("doc_id"))
    repeats = repeats.withColumn("shard", F.pmod(F.xxhash64(owner), F.lit(n * tx.SHARDS_EACH)).cast("int")).repartition(n, "shard")
    out = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string, spans array<struct<start:int,end:int>>" * with_text
    if carried:
        out += f", carried {dealt.schema['carried'].dataType.simpleString()}"
    return dealt.groupBy("shard").cogroup(repeats.groupBy("shard")).applyInArrow(_cut(window, with_text), out)
