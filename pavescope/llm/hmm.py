"""Hidden Markov language model over word classes.

Each token is emitted as a class by a hidden state, and as a word by its class. The TOP most frequent
training tokens are classes of their own; all others fall into REST classes by a hash of their last bytes and
share them by smoothed counts, one unseen word included, so probabilities sum to one. Baum-Welch trains the
states: every partition computes the expected counts of its training documents, Spark sums them, and the
driver normalises tables of fixed size. The scaled forward recursion gives the exact likelihood.

Token counts cover the whole training corpus. They are not broadcast: texts are tokenised once, into numbers of a
vocabulary of their shard; vocabularies are cut by token hash (96 bits), summed bucket by bucket, and each shard gets
the totals of its own tokens back, with which its texts become classes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

STATES, TOP, REST = 8, 2_048, 512
#: Rounds of Baum-Welch; tokens of a text that run as one sequence, and of the pieces that what follows is dealt to.
ROUNDS, HEAD, LINK = 4, 2_048, 512
#: Bounds of a shard, entries meant for a bucket of vocabularies, and tokens of a block of texts of like lengths.
SLICE, SHARD_TOKENS, SHARD_WORDS, BUCKET_ENTRIES, BLOCK_TOKENS = 256, 3_000_000, 400_000, 1 << 19, 1 << 19
SMOOTH, MODEL_SMOOTH = 0.1, 0.05
#: The end of a text as a token; no word holds a space.
END = " "


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 10 == 0, F.lit(False))


def rest_class(tokens: pa.Array) -> np.ndarray:
    """The class, 0 to REST - 1, of tokens that are none of their own: by their last three bytes and whether they are long."""
    data, offsets = tx.text_bytes(tokens)
    ends, size = offsets[1:], np.diff(offsets)
    key = np.zeros(len(size), np.uint64)
    for back in (1, 2, 3):
        key = key * tx.U64(257) + np.where(size >= back, data[np.maximum(ends - back, 0)] if len(data) else 0, 0).astype(np.uint64) + tx.U64(1)
    return (tx.mix(key * tx.U64(2) + (size > 8).astype(np.uint64)) % tx.U64(REST)).astype(np.int64)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as numbers of a vocabulary of their shard, and the vocabulary; one row a block of documents, one row a shard.

    A shard is a stretch of a task's rows: of at most SHARD_TOKENS tokens and SHARD_WORDS distinct ones, but for its last slice.
    """
    part, nth = TaskContext.get().partitionId(), 0
    words: defaultdict[bytes, int] = defaultdict()
    words.default_factory = words.__len__
    counts, held = np.zeros(0, np.int64), 0

    def vocabulary() -> pa.RecordBatch:
        tokens = pa.array(list(words), pa.binary())
        hashes = np.concatenate([np.zeros(0, tx.U64), *(w.hashes for w in tx.hashed_words(*tx.text_bytes(tokens.cast(pa.string()))))])
        marks = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
        full = np.zeros(len(words), np.uint32)
        full[: len(counts)] = counts
        return _row(shard=(part << 20) + nth, n=len(words), hashes=hashes, marks=marks, counts=full, rest=rest_class(tokens).astype(np.uint16))

    for whole in batches:
        for a in range(0, whole.num_rows, SLICE):
            batch = whole.slice(a, SLICE)
            docs = [(t or b"").lower().split() for t in batch.column("text").cast(pa.large_binary()).to_pylist()]
            sizes = np.array([len(d) for d in docs], np.int32)
            ids = np.fromiter(map(words.__getitem__, chain.from_iterable(docs)), np.int32, int(sizes.sum()))
            learns = batch.column("train").to_numpy(zero_copy_only=False)
            found = np.bincount(ids[np.repeat(learns, sizes)])
            if len(found) > len(counts):
                counts = np.pad(counts, (0, len(words) - len(counts)))
            counts[: len(found)] += found
            yield _row(shard=(part << 20) + nth, doc_ids=batch.column("doc_id").to_pylist(), train=learns, sizes=sizes, ids=ids)
            held += len(ids)
            if held >= SHARD_TOKENS or len(words) >= SHARD_WORDS:
                yield vocabulary()
                words.clear()
                counts, held, nth = np.zeros(0, np.int64), 0, nth + 1
    if words:
        yield vocabulary()


_TOKENS = pa.schema([("shard", pa.int64()), ("n", pa.int64()), *((k, pa.binary()) for k in ("hashes", "marks", "counts", "rest")), ("doc_ids", pa.list_(pa.int64())), *((k, pa.binary()) for k in ("train", "sizes", "ids"))])


def _row(**values) -> pa.RecordBatch:
    """One row of _TOKENS; arrays as bytes, what is not given null."""
    cell = lambda v: v.tobytes() if isinstance(v, np.ndarray) else v
    return pa.RecordBatch.from_arrays([pa.array([cell(values.get(f.name))], f.type) for f in _TOKENS], schema=_TOKENS)


def _buckets(bits: int):
    """The vocabularies, cut by leading hash bits: equal tokens of all shards meet in a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                hashes, marks, counts, rest = _vocabulary(row)
                bucket = (hashes >> tx.U64(64 - bits)).astype(np.int64) if bits else np.zeros(len(hashes), np.int64)
                order = np.argsort(bucket, kind="stable").astype(np.int32)
                edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) > 0, True])
                cut = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(bucket[c[0]]) for c in cut], pa.int64()), pa.array([row["shard"]] * len(cut), pa.int64()),
                    *(pa.array([v[c].tobytes() for c in cut], pa.binary()) for v in (hashes, marks, counts, rest)), pa.array([c.tobytes() for c in cut], pa.binary()),
                ], ["bucket", "shard", "hashes", "marks", "counts", "rest", "places"])

    return run


def _vocabulary(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(row[k], kind) for k, kind in (("hashes", tx.U64), ("marks", np.uint32), ("counts", np.uint32), ("rest", np.uint16)))


_TOTALS = pa.schema([("shard", pa.int64()), ("places", pa.binary()), ("totals", pa.binary()), ("hash", pa.int64()), ("mark", pa.int64()), ("rest", pa.int32()), ("tokens", pa.int64()), ("words", pa.int64())])


def _totals(table: pa.Table) -> pa.Table:
    """Of one bucket: the corpus totals of each shard's tokens; the TOP most frequent tokens; and the sums of each rest class."""
    rows = table.to_pylist()
    parts = [_vocabulary(r) for r in rows]
    hashes, marks, counts, rest = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((marks, hashes))
    h, m = hashes[order], marks[order]
    begun = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (m[1:] != m[:-1])])
    sums = np.add.reduceat(counts[order].astype(np.int64), begun)
    every = np.empty(len(order), np.int64)
    every[order] = np.repeat(sums, np.diff(np.r_[begun, len(order)]))
    edges = np.cumsum([0, *(len(p[0]) for p in parts)])
    own = pa.table({"shard": [r["shard"] for r in rows], "places": pa.array([r["places"] for r in rows], pa.binary()), "totals": pa.array([every[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())})
    kinds, known = rest[order][begun].astype(np.int32), sums > 0
    best = np.lexsort((m[begun], h[begun], -sums))[:TOP]
    best = best[known[best]]
    top = pa.table({"hash": h[begun][best].view(np.int64), "mark": m[begun][best].astype(np.int64), "rest": kinds[best], "tokens": sums[best]})
    classes = np.unique(kinds[known])
    summed = pa.table({"rest": classes, "tokens": np.bincount(kinds[known], sums[known], REST)[classes].astype(np.int64), "words": np.bincount(kinds[known], minlength=REST)[classes]})
    return pa.concat_tables([_as(t, _TOTALS) for t in (own, top, summed)])


def _as(table: pa.Table, schema: pa.Schema) -> pa.Table:
    return pa.table([table.column(f.name).cast(f.type) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in schema], schema=schema)


@dataclass
class Model:
    """start, move and emit: log-free probabilities of states and of classes in states."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


def _initial(class_counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(17)
    emit = class_counts / class_counts.sum() * rng.gamma(2.0, 0.5, (STATES, len(class_counts)))
    move = np.full((STATES, STATES), 0.3 / STATES) + 0.7 * np.eye(STATES)
    return np.full(STATES, 1 / STATES), move, emit / emit.sum(1, keepdims=True)


def _pieces(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place in it, first token and length of each piece: HEAD tokens, then LINK each. No text is empty."""
    sizes = np.diff(bounds)
    each = 1 + np.maximum(-(-(sizes - HEAD) // LINK), 0)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    from_ = np.where(nth == 0, 0, HEAD + (nth - 1) * LINK)
    return doc, nth, bounds[doc] + from_, np.minimum(np.where(nth == 0, HEAD, LINK), sizes[doc] - from_)


def _forward(classes: np.ndarray, at: np.ndarray, size: np.ndarray, state: np.ndarray, move: np.ndarray, by_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From states (rows, starts, states) at the first tokens of pieces: the scaled ones at the last, and the log scales."""
    order = np.argsort(-size, kind="stable")
    at, size, state = at[order], size[order], state[order]
    logs, states = np.zeros(state.shape[:2]), len(move)
    for t in range(int(size.max(initial=0))):
        k = int(np.searchsorted(-size, -t, side="left"))
        b = by_class[classes[at[:k] + t]][:, None, :]
        now = state[:k] * b if t == 0 else (state[:k].reshape(-1, states) @ move).reshape(k, -1, states) * b
        s = now.sum(2)
        state[:k] = now / s[:, :, None]
        logs[:k] += np.log(s)
    back = np.argsort(order)
    return state[back], logs[back]


def _chained(classes: np.ndarray, bounds: np.ndarray, start: np.ndarray, move: np.ndarray, by_class: np.ndarray):
    """The pieces; scaled states before each and messages after each (rows of 1 at ends); each text's log probability.

    A first piece starts from the start probabilities, any other one from every state by itself; chaining the pieces'
    transfer matrices is the recursion over the whole text, forwards and backwards.
    """
    doc, nth, at, length = _pieces(bounds)
    head = nth == 0
    states = len(start)
    before, after = np.zeros((len(doc), states)), np.ones((len(doc), states))
    lone = head & np.r_[nth[1:] == 0, True]
    many = np.flatnonzero(head & ~lone)
    total = np.zeros(len(bounds) - 1)
    if len(many):
        state, logs = _forward(classes, at[many], length[many], np.tile(start, (len(many), 1, 1)), move, by_class)
        now = np.zeros((len(bounds) - 1, states))
        now[doc[many]], total[doc[many]] = state[:, 0], logs[:, 0]
        rows = np.flatnonzero(~head)
        links, scales = _forward(classes, at[rows], length[rows], np.tile(move, (len(rows), 1, 1)), move, by_class)
        most = scales.max(1)
        links = links * np.exp(scales - most[:, None])[:, :, None]
        by_nth = np.argsort(nth[rows], kind="stable")
        edges = np.searchsorted(nth[rows][by_nth], np.arange(1, int(nth.max()) + 2))
        steps = [by_nth[a:b] for a, b in zip(edges[:-1], edges[1:])]
        for r in steps:
            d = doc[rows[r]]
            before[rows[r]] = now[d]
            ahead = np.einsum("ns,nst->nt", now[d], links[r])
            s = ahead.sum(1)
            now[d] = ahead / s[:, None]
            total[d] += np.log(s) + most[r]
        for r in reversed(steps):
            message = np.einsum("nst,nt->ns", links[r], after[rows[r]])
            after[rows[r] - 1] = message / message.sum(1, keepdims=True)
    return doc, nth, at, length, before, after, total, lone


def log_likelihood(classes: np.ndarray, bounds: np.ndarray, model: Model) -> np.ndarray:
    """Natural log probability of each whole class sequence (none empty) by the scaled forward recursion."""
    by_class = np.ascontiguousarray(model.emit.T)
    doc, _, at, length, _, _, total, lone = _chained(classes, bounds, model.start, model.move, by_class)
    _, logs = _forward(classes, at[lone], length[lone], np.tile(model.start, (int(lone.sum()), 1, 1)), model.move, by_class)
    total[doc[lone]] = logs[:, 0]
    return total


def expected_counts(classes: np.ndarray, bounds: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of whole texts (none empty): start, move, emit; and the log likelihood.

    Pieces of long texts run side by side between the states before and the messages after them, so a cut changes no count.
    """
    by_class = np.ascontiguousarray(emit.T)
    _, nth, at, length, before, after, _, _ = _chained(classes, bounds, start, move, by_class)
    order = np.argsort(-length, kind="stable")
    at, length, before, after, first = at[order], length[order], before[order], after[order], nth[order] == 0
    most, states = int(length.max(initial=0)), len(start)
    active = np.searchsorted(-length, -np.arange(most), side="left")  # pieces longer than t
    offset = np.r_[0, np.cumsum(active)]
    seen = classes[np.concatenate([at[:k] + t for t, k in enumerate(active)])] if most else classes[:0]
    b = by_class[seen]
    alpha, scale, one = np.empty_like(b), np.empty(len(b)), np.ones(states)
    ends = np.empty((len(at), states))
    for t in range(most):
        here = slice(offset[t], offset[t + 1])
        k = active[t]
        a = alpha[here]
        if t:
            np.matmul(alpha[offset[t - 1] : offset[t - 1] + k], move, out=a)
        else:
            a[:] = np.where(first[:, None], start, before @ move)
        a *= b[here]
        s = a @ one
        scale[here] = s
        a /= s[:, None]
        shorter = active[t + 1] if t + 1 < most else 0
        ends[shorter:k] = a[shorter:]
    beta = after / (ends * after).sum(1, keepdims=True)
    starts, moves = np.zeros(states), np.zeros_like(move)
    b /= scale[:, None]
    for t in range(most - 1, -1, -1):
        here = slice(offset[t], offset[t + 1])
        k = active[t]
        onward = b[here]
        onward *= beta[:k]
        if t:
            moves += alpha[offset[t - 1] : offset[t - 1] + k].T @ onward
        else:
            moves += before[~first].T @ onward[~first]
        alpha[here] *= beta[:k]
        np.matmul(onward, move.T, out=beta[:k])
    starts = alpha[: len(at)][first].sum(0)
    emits = np.stack([np.bincount(seen, alpha[:, s], emit.shape[1]) for s in range(states)])
    return starts, move * moves, emits, float(np.log(scale).sum())


def _encode(classes_of: dict[tuple[int, int], int], class_tokens: np.ndarray, class_words: np.ndarray, total: int, distinct: int, ends: int):
    """Of one shard: blocks of whole texts of like lengths as classes, END included, with each text's sums."""

    def run(rows: pa.Table, totals: pa.Table) -> pa.Table:
        rows, out = rows.to_pylist(), []
        own = next((r for r in rows if r["hashes"] is not None), {"hashes": b"", "marks": b"", "rest": b""})  # texts without words have none
        hashes, marks, rest = (np.frombuffer(own[k], kind) for k, kind in (("hashes", tx.U64), ("marks", np.uint32), ("rest", np.uint16)))
        c = np.zeros(len(hashes), np.int64)
        for places, sums in zip(totals.column("places").to_pylist(), totals.column("totals").to_pylist()):
            c[np.frombuffer(places, np.int32)] = np.frombuffer(sums, np.int64)
        own = np.full(len(hashes), -1)
        top = np.array(sorted(h for h, _ in classes_of), np.int64).view(tx.U64)
        for i in np.flatnonzero(np.isin(hashes, top)).tolist():
            own[i] = classes_of.get((int(hashes[i : i + 1].view(np.int64)[0]), int(marks[i])), -1)
        rare = own < 0
        kinds = np.where(rare, TOP + 1 + rest.astype(np.int64), own)
        base = np.log10((c + SMOOTH) / (total + SMOOTH * (distinct + 1)))
        inside = np.where(rare, np.log10((c + SMOOTH) / (class_tokens[kinds] + SMOOTH * (class_words[kinds] + 1))), 0.0)
        kinds, known = np.r_[kinds, TOP].astype(np.uint16), np.r_[c > 0, ends > 0].astype(np.int64)
        base, inside = np.r_[base, np.log10((ends + SMOOTH) / (total + SMOOTH * (distinct + 1)))], np.r_[inside, 0.0]
        blocks = [r for r in rows if r["ids"] is not None]
        sizes = np.concatenate([np.frombuffer(r["sizes"], np.int32) for r in blocks])
        ids = np.insert(np.concatenate([np.frombuffer(r["ids"], np.int32) for r in blocks]), np.cumsum(sizes), len(hashes))
        doc_ids, train = [i for r in blocks for i in r["doc_ids"]], np.concatenate([np.frombuffer(r["train"], bool) for r in blocks])
        bounds = np.r_[0, np.cumsum(sizes + 1)]
        n_known, base_score, inner = (np.add.reduceat(v[ids], bounds[:-1]) for v in (known, base, inside))
        classes = kinds[ids]
        order = np.lexsort((-sizes, ~train))
        ahead = np.r_[0, np.cumsum(sizes[order] + 1)]
        cuts = np.unique(np.r_[0, int(train.sum()), np.searchsorted(ahead, np.arange(BLOCK_TOKENS, ahead[-1], BLOCK_TOKENS)), len(order)])
        for a, b in zip(cuts[:-1], cuts[1:]):
            docs = order[a:b]
            texts = np.concatenate([classes[bounds[d] : bounds[d + 1]] for d in docs.tolist()])
            out.append(pa.RecordBatch.from_arrays([
                pa.array([bool(train[docs[0]])]), pa.array([texts.tobytes()], pa.binary()), pa.array([(sizes[docs] + 1).astype(np.int32).tobytes()], pa.binary()), pa.array([[doc_ids[d] for d in docs.tolist()]], pa.list_(pa.int64())),
                *(pa.array([v[docs].tobytes()], pa.binary()) for v in (n_known, base_score, inner)),
            ], ["train", "classes", "sizes", "doc_ids", "known", "base", "inner"]))
        return pa.Table.from_batches(out)

    return run


_ENCODED = "train boolean, classes binary, sizes binary, doc_ids array<long>, known binary, base binary, inner binary"


def _round(start: np.ndarray, move: np.ndarray, emit: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            for c, s in zip(batch.column("classes"), batch.column("sizes")):
                bounds = np.r_[0, np.cumsum(np.frombuffer(s.as_py(), np.int32))]
                got = expected_counts(np.frombuffer(c.as_py(), np.uint16), bounds, start, move, emit)
                sums = got if sums is None else tuple(x + y for x, y in zip(sums, got))
        if sums is not None:
            flat = np.concatenate([np.ravel(x) for x in sums])
            parts = np.array_split(flat, 8)
            yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "sums"])

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.frombuffer(x.as_py(), float) for x in table.column("sums")], 0)
    return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})


def train(encoded: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[float]]:
    """start, move and emit after so many rounds of Baum-Welch; and the log likelihood before each."""
    start, move, emit = _initial(class_counts + MODEL_SMOOTH)
    seen = []
    for _ in range(rounds):
        rows = tx.in_levels(encoded.mapInArrow(_round(start, move, emit), "part int, sums binary"), "part", _add).collect()
        if not rows:
            break
        flat = np.concatenate([np.frombuffer(r.sums, float) for r in sorted(rows, key=lambda r: r.part)])
        s, m, e = np.split(flat[:-1], [STATES, STATES + STATES * STATES])
        seen.append(float(flat[-1]))
        start, move, emit = (x / x.sum(-1, keepdims=True) for x in (s + 1, m.reshape(STATES, STATES) + 1, e.reshape(STATES, -1) + MODEL_SMOOTH))
    return start, move, emit, seen


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.frombuffer(row["sizes"], np.int32)
                known, base, inner = np.frombuffer(row["known"], np.int64), np.frombuffer(row["base"], float), np.frombuffer(row["inner"], float)
                score = log_likelihood(np.frombuffer(row["classes"], np.uint16), np.r_[0, np.cumsum(sizes)], model) / np.log(10) + inner
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(np.full(len(sizes), not row["train"])), pa.array(sizes.astype(np.int64)), pa.array(known), pa.array(base), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def language_scores(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10) of each row of docs, learned from rows outside held_out().

    Null texts are empty and have the end token only. A null doc_id is not held out. Repeated rows are scored
    (and learned from) each. Without training rows every token is unknown and states are uniform. An empty table
    gives an empty result. Other columns are not looked at.
    """
    source = docs.select("doc_id", "text", (~held_out()).alias("train"))
    # a shard is a stretch of one task of this scan; the written table fixes them
    tokens = tx.written(source.mapInArrow(_shards, tx.ddl(_TOKENS)), "hmm-tokens")
    vocabularies = tokens.where("hashes IS NOT NULL")
    entries = vocabularies.agg(F.sum("n")).first()[0] or 0
    bits = max(0, (entries // BUCKET_ENTRIES).bit_length())
    kinds = "bucket long, shard long, hashes binary, marks binary, counts binary, rest binary, places binary"
    met = vocabularies.select("shard", "hashes", "marks", "counts", "rest").mapInArrow(_buckets(bits), kinds)
    totals = tx.written(met.groupBy("bucket").applyInArrow(_totals, tx.ddl(_TOTALS)), "hmm-totals")
    ends = source.where("train").count()
    # at most TOP tokens, and REST sums, come to the driver
    best = totals.where("hash IS NOT NULL").orderBy(F.desc("tokens"), "hash", "mark").limit(TOP).select("hash", "mark", "rest", "tokens").collect()
    class_tokens, class_words = np.zeros(TOP + 1 + REST), np.zeros(TOP + 1 + REST)
    for r in totals.where("words IS NOT NULL").groupBy("rest").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words")).collect():
        class_tokens[TOP + 1 + r.rest], class_words[TOP + 1 + r.rest] = r.tokens, r.words
    for i, r in enumerate(best):
        class_tokens[i], class_words[i] = r.tokens, 1
        class_tokens[TOP + 1 + r.rest] -= r.tokens
        class_words[TOP + 1 + r.rest] -= 1
    class_tokens[TOP], class_words[TOP] = ends, ends > 0
    total, distinct = int(class_tokens.sum()), int(class_words.sum())
    encode = _encode({(r.hash, r.mark): i for i, r in enumerate(best)}, class_tokens, class_words, total, distinct, ends)
    sums = totals.where("shard IS NOT NULL").select("shard", "places", "totals")
    texts = tokens.drop("n", "counts")
    encoded = tx.written(texts.groupBy("shard").cogroup(sums.groupBy("shard")).applyInArrow(encode, _ENCODED), "hmm-classes")
    tx.discard(tokens)
    tx.discard(totals)
    start, move, emit, _ = train(encoded.where("train").select("classes", "sizes"), class_tokens, rounds)
    scored = encoded.mapInArrow(_score(Model(start, move, emit)), "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
