"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of insult words and stems (a fixed list, and words and word stems that
labelled documents show to mark toxicity), those next to a second-person word, those spelled with digits or
symbols, shares of capitals, punctuation, digits and mixed spellings, and sizes. The lexicon, the trees and
the calibration are learned from at most MOST_LABELS labelled documents, those least by a hash of their doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import boosting
from . import text as tx

#: Bound of the labelled sample; labels on rows of held_out() are never looked at.
MOST_LABELS = 20_000
THRESHOLD = 0.7
STEMS, NEAR = (4, 5, 6), 5
LEAST_TOXIC, FOLDS = 4, 3
SLICE = 256

# Words that insult in the four languages, and words that address a second person.
INSULTS = (
    "idiot moron stupid dumb loser trash scum clown pathetic worthless disgusting garbage filth imbecile fool bastard bitch "
    "idiota estúpido imbécil basura asqueroso patético inútil payaso escoria "
    "dumm dummkopf idiotisch trottel abschaum müll ekelhaft erbärmlich wertlos versager "
    "stupide débile crétin ordure dégoûtant pathétique minable clown racaille"
).split()
SECOND_PERSON = "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos tú ti usted ustedes tuyo vosotros".split()
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}

FEATURES = ["insults", "terms", "stems", "marked", "marked_log", "marked_share", "near_you", "spelled", "second_person", "capitals", "shouted", "punctuation", "exclaims", "digits", "symbols", "mixed", "not_ascii", "word_length", "words_log", "bytes_log"]


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _hashes(words: list[str]) -> np.ndarray:
    data, offsets = tx.text_bytes(pa.array(words))
    return np.unique(np.concatenate([np.zeros(0, tx.U64), *(w.hashes for w in tx.hashed_words(data, offsets))]))


_letter = np.zeros(256, bool)
_letter[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_leet = np.arange(256, dtype=np.uint8)
_leet[[ord(c) for c in LEET]] = [ord(c) for c in LEET.values()]
_symbol = np.zeros(256, bool)
_symbol[[ord(c) for c in LEET]] = True


def spelled_out(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text as letters in lower case and spaces; digits and symbols before a letter stand for letters. And where they did."""
    letter = _letter[data]
    spells = _symbol[data]
    spells[:-1] &= letter[1:]
    spells[-1:] = False
    out = np.where(letter, data, np.uint8(32))
    out = np.where((data >= 65) & (data <= 90), data + np.uint8(32), out)
    return np.where(spells, _leet[data], out), spells


@dataclass
class Lexicon:
    insults: np.ndarray
    you: np.ndarray
    terms: np.ndarray
    stems: dict[int, np.ndarray]


def _among(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values if len(table) else np.zeros(len(values), bool)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """FEATURES of each text, SLICE texts at a time."""
    return np.concatenate([np.zeros((0, len(FEATURES))), *(_features(texts.slice(a, SLICE), lexicon) for a in range(0, len(texts), SLICE))])


def _features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    data, offsets = tx.text_bytes(texts)
    plain, spells = spelled_out(data)
    out = np.zeros((len(texts), len(FEATURES)))

    def totals(flags: np.ndarray, at: np.ndarray = offsets) -> np.ndarray:
        sums = np.r_[0, np.cumsum(flags, dtype=np.int64)]
        return (sums[at[1:]] - sums[at[:-1]]).astype(float)

    size = np.maximum(np.diff(offsets), 1).astype(float)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    mark = (data > 32) & ~_letter[data] & ~digit
    letters = np.maximum(totals(_letter[data]), 1)
    pair = np.zeros(len(data), bool)
    pair[1:] = upper[1:] & upper[:-1]
    out[:, 9:15] = np.stack([totals(upper) / letters, totals(pair) / letters, totals(mark) / size, totals(data == 33) / size, totals(digit) / size, totals(_symbol[data] & mark) / size], 1)
    out[:, 15] = totals(spells) / size
    out[:, 16] = totals(data >= 128) / size
    out[:, 19] = np.log1p(np.diff(offsets))
    for words in tx.hashed_words(plain, offsets, STEMS):
        insult, term = _among(words.hashes, lexicon.insults), _among(words.hashes, lexicon.terms)
        stem = np.zeros(len(insult), bool)
        for n in STEMS:
            stem |= _among(words.stems[n], lexicon.stems[n])
        marked, you = insult | term | stem, _among(words.hashes, lexicon.you)
        after, before = np.minimum(np.arange(len(you)) + NEAR + 1, np.repeat(words.bounds[1:], np.diff(words.bounds))), np.maximum(np.arange(len(you)) - NEAR, np.repeat(words.bounds[:-1], np.diff(words.bounds)))
        yous = np.r_[0, np.cumsum(you)]
        near = marked & (yous[after] > yous[before])
        first = int(offsets[words.first])
        odd = np.r_[0, np.cumsum(spells[first : first + len(words.data)])]
        spelled = marked & (odd[words.ends] > odd[words.starts])
        rows = slice(words.first, words.first + len(words.bounds) - 1)
        count = np.maximum(np.diff(words.bounds), 1).astype(float)
        sums = [totals(v, words.bounds) for v in (insult, term, stem, marked, near, spelled, you)]
        out[rows, :3] = np.stack([np.log1p(s) for s in sums[:3]], 1)
        out[rows, 3:9] = np.stack([sums[3], np.log1p(sums[3]), sums[3] / count, sums[4], sums[5], sums[6] / count], 1)
        out[rows, 17] = totals(words.ends - words.starts, words.bounds) / count
        out[rows, 18] = np.log1p(np.diff(words.bounds))
    return out


def _term_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """fold, kind (0 words, else a stem's length), hash, toxic and clean documents, summed over each slice."""
    for batch in (whole.slice(a, SLICE) for whole in batches for a in range(0, whole.num_rows, SLICE)):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        folds = batch.column("fold").to_numpy(zero_copy_only=False)
        plain, _ = spelled_out((parts := tx.text_bytes(batch.column("text")))[0])
        kinds, hashes, bad, fold = [], [], [], []
        for words in tx.hashed_words(plain, parts[1], STEMS):
            doc = words.first + np.repeat(np.arange(len(words.bounds) - 1), np.diff(words.bounds))
            for kind, own in ((0, words.hashes), *words.stems.items()):
                order = np.lexsort((own, doc))
                d, h = doc[order], own[order]
                one = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)] & (h != 0)
                kinds.append(np.full(one.sum(), kind, np.int32))
                hashes.append(h[one])
                bad.append(toxic[d[one]])
                fold.append(folds[d[one]])
        if kinds:
            sums = pd.DataFrame({"fold": np.concatenate(fold), "kind": np.concatenate(kinds), "hash": np.concatenate(hashes).view(np.int64), "toxic": np.concatenate(bad)}).groupby(["fold", "kind", "hash"]).toxic.agg(["sum", "count"]).reset_index()
            yield pa.RecordBatch.from_arrays([pa.array(sums.fold.astype(np.int32)), pa.array(sums.kind), pa.array(sums.hash), pa.array(sums["sum"].astype(np.int64)), pa.array((sums["count"] - sums["sum"]).astype(np.int64))], ["fold", "kind", "hash", "toxic", "clean"])


def _lexicons(sample: DataFrame) -> tuple[list[Lexicon], int, int]:
    """A lexicon learned without each of the folds, then one of the whole sample; and the sample's toxic and clean documents."""
    sides = {(r.fold, r.toxic): r.n for r in sample.groupBy("fold", "toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = [[f for f in range(FOLDS) if f != without] for without in range(FOLDS)] + [list(range(FOLDS))]
    bad, good = ([sum(sides.get((f, t), 0) for f in folds) for folds in seen] for t in (1, 0))
    terms = sample.mapInArrow(_term_docs, "fold int, kind int, hash long, toxic long, clean long")
    # a term's counts in one fold go to the lexicons that may see them
    goes = F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda k: k != F.col("fold")))
    terms = terms.withColumn("of", goes).groupBy("of", "kind", "hash").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    prior = F.element_at(F.array(*[F.lit(float(np.log((b + 1) / (g + 1)))) for b, g in zip(bad, good)]), F.col("of") + 1)
    lift = F.log((F.col("toxic") + 0.5) / (F.col("clean") + 0.5)) - prior
    # the terms of a bounded sample
    found = terms.where(F.col("toxic") >= LEAST_TOXIC).where((lift > 2.5) & (lift > 2.0 / F.sqrt(F.col("toxic").cast("double")))).select("of", "kind", "hash").toPandas()
    hashes = lambda of, kind: np.sort(found.hash[(found.of == of) & (found.kind == kind)].to_numpy(np.int64).view(tx.U64))
    return [Lexicon(_hashes(INSULTS), _hashes(SECOND_PERSON), hashes(of, 0), {k: hashes(of, k) for k in STEMS}) for of in range(FOLDS + 1)], bad[-1], good[-1]


@dataclass
class Model:
    """Without labels of both classes: no trees, and the share of toxic labels (0 without any) as every score."""

    lexicon: Lexicon
    trees: boosting.Boosted | None
    knots: tuple[np.ndarray, np.ndarray]
    prior: float

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.prior)
        return np.interp(self.trees.margin(features(texts, self.lexicon)), *self.knots)


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELS) -> Model:
    known = labels.where(~held_out() & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most `most` rows of two numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = tx.written(sample.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    lexicons, bad, good = _lexicons(sample)
    if not bad or not good:
        return Model(lexicons[-1], None, (np.zeros(1), np.zeros(1)), bad / max(bad + good, 1))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            x = np.stack([features(batch.column("text"), lexicon) for lexicon in lexicons], 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("fold"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "toxic", "fold", "x"])

    got = sample.select("doc_id", "text", "toxic", "fold").mapInArrow(rows, "doc_id long, toxic int, fold int, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(got.x), float).reshape(len(got), FOLDS + 1, len(FEATURES))
    y, fold = got.toxic.to_numpy(float), got.fold.to_numpy()
    margin = np.zeros(len(y))
    for f in range(FOLDS):  # neither the lexicon nor the trees of a document's calibration margin have seen it
        rest, own = fold != f, fold == f
        if own.any() and rest.any():
            margin[own] = boosting.fit(x[rest, f], y[rest]).margin(x[own, f])
    return Model(lexicons[-1], boosting.fit(x[:, -1], y), boosting.isotonic(margin, y), bad / (bad + good))


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """docs with a column of scores (0 to 1). Null texts score as empty ones; rows and other columns stay; ``name`` must be new."""
    if name in docs.columns:
        raise ValueError(f"docs has a column {name}")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            scores = pa.array(sent.value.score(batch.column("text")), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, DoubleType())])
    return docs.mapInArrow(lambda batches: tx.given_back(run(batches)), schema)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs, learned from labels outside held_out().

    A null doc_id is not held out; documents without labels, with empty or null text, and repeated rows are
    scored like any others; labels that are null or not 0 or 1 are left out, and of several for one document the
    greatest holds. Other columns are not looked at.
    """
    model = train(docs, labels)
    texts = docs.select("doc_id", "text")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sent.value.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    out = texts.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
