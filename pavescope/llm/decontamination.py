"""Benchmark decontamination: Wu-Manber search of all benchmark windows in all documents, words as symbols.

Windows of equal length are searched together. A table of shifts, by the hash of a block of two words, says how far the
search may move on from a place; where it may not move, the windows of that suffix hash are looked up by the hash of
all their words and compared word by word. Words are numbered by the windows' own vocabulary, so comparison is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import alnum
from . import text as tx

WINDOW = 10
#: Windows searched in one pass over the documents: some 80 MB in each Python worker, and the most that the driver holds.
WINDOWS_EACH = 1_000_000
#: Places that one cursor walks over, in step with the others of its chunk.
STRETCH = 256
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class WuManber:
    """Search of distinct sequences of one length; rows holds a sequence of word numbers (from 1) in each row."""

    def __init__(self, rows: np.ndarray):
        self.length = rows.shape[1]
        self.block = min(2, self.length)
        self.bits = max(10, len(rows).bit_length() + 2)
        self.shift = np.full(1 << self.bits, self.length - self.block + 1, np.uint16)
        for j in range(self.block - 1, self.length):  # later blocks allow less, and overwrite
            self.shift[self.hashed(rows.ravel(), np.arange(len(rows)) * self.length + j)] = self.length - 1 - j
        keys = self.keys(rows.ravel(), np.arange(len(rows)) * self.length + self.length - 1)
        self.order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.rows = keys[self.order], rows[self.order]

    def hashed(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of the block that ends at each place."""
        out = words[ends].astype(np.uint64) * _A
        if self.block == 2:
            out = (out ^ (out >> np.uint64(29))) + words[ends - 1].astype(np.uint64) * _B
        return (tx.mix(out) >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, words: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The bucket of the suffix, then a hash of the whole sequence."""
        whole = np.zeros(len(ends), np.uint64)
        for j in range(self.length - 1, -1, -1):
            whole = tx.mix(whole * _B + words[ends - j].astype(np.uint64) + np.uint64(1))
        low = np.uint64(64 - self.bits)
        return (self.hashed(words, ends).astype(np.uint64) << low) | (whole >> np.uint64(self.bits))

    def places(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Last places of the windows that the shifts do not rule out."""
        first, end = bounds[:-1] + self.length - 1, bounds[1:]
        first, end = first[first < end], end[first < end]
        each = -(-(end - first) // STRETCH)
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        at = np.repeat(first, each) + nth * STRETCH
        stop = np.minimum(at + STRETCH, np.repeat(end, each))
        found = []
        while len(at):
            step = self.shift[self.hashed(words, at)].astype(np.int64)
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        return np.concatenate(found) if found else np.zeros(0, np.int64)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of the sequence as given, place of its last word) of each occurrence inside a document."""
        ends = self.places(words, bounds)
        keys = self.keys(words, ends)
        at, to = np.searchsorted(self.sorted_keys, keys, side="left"), np.searchsorted(self.sorted_keys, keys, side="right")
        rows, places = [], []
        steps = np.arange(1 - self.length, 1)
        while len(at := at[on := at < to]):
            to, ends = to[on], ends[on]
            same = (self.rows[at] == words[ends[:, None] + steps]).all(axis=1)
            rows.append(self.order[at[same]])
            places.append(ends[same])
            at = at + 1
        return (np.concatenate(rows), np.concatenate(places)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Searcher:
    """All windows of a pass. windows: their words, one space between; classes: the class of each."""

    def __init__(self, windows: pa.Array, classes: np.ndarray):
        listed = pc.split_pattern(windows.cast(pa.large_string()), " ")
        words = listed.flatten()
        self.vocabulary = words.unique()
        numbers = pc.index_in(words, value_set=self.vocabulary).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        sizes, starts = np.diff(listed.offsets.to_numpy()), listed.offsets.to_numpy()[:-1]
        self.parts = []
        for size in np.unique(sizes):
            which = np.flatnonzero(sizes == size)
            self.parts.append((WuManber(numbers[starts[which][:, None] + np.arange(size)]), classes[which]))

    def numbered(self, words: pa.Array) -> np.ndarray:
        """Word numbers; 0 of words in no window."""
        own = words.dictionary_encode()
        known = pc.fill_null(pc.index_in(own.dictionary, value_set=self.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int32) + 1
        return known[own.indices.to_numpy(zero_copy_only=False)] if len(known) else np.zeros(0, np.int32)


_FOUND = [("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("classes", pa.list_(pa.int64()))]


def _lists(values: np.ndarray, of: np.ndarray, n: int) -> pa.Array:
    """values as a list for each of n documents; of: their documents, ascending."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), pa.array(values.astype(np.int64)))


def _searched(search: Searcher, texts: pa.Array, before: pa.RecordBatch | None) -> list[pa.Array]:
    """_FOUND of the texts; before: the same columns of earlier passes, whose spans and classes are kept."""
    out: list[list[pa.Array]] = [[] for _ in _FOUND]
    for part in alnum.chunks(texts):
        words, n = search.numbered(part.words), len(part.bounds) - 1
        cover = np.zeros(len(words) + 1, np.int64)
        docs, classes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for patterns, of in search.parts:
            rows, places = patterns.search(words, part.bounds)
            cover += np.bincount(places - patterns.length + 1, minlength=len(cover)) - np.bincount(places + 1, minlength=len(cover))
            docs.append(np.searchsorted(part.bounds, places, side="right") - 1)
            classes.append(of[rows])
        docs, classes = np.concatenate(docs), np.concatenate(classes)
        if before is not None:
            own = before.slice(part.first, n)
            for name, sign in (("starts", 1), ("ends", -1)):
                lists = own.column(name)
                doc = np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                cover += sign * np.bincount(part.bounds[doc] + lists.flatten().to_numpy(zero_copy_only=False), minlength=len(cover))
            lists = own.column("classes")
            docs = np.concatenate([docs, np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
            classes = np.concatenate([classes, lists.flatten().to_numpy(zero_copy_only=False)])
        hit = np.cumsum(cover)[:-1] > 0
        first, last = hit.copy(), hit.copy()
        first[1:] &= ~hit[:-1]
        last[:-1] &= ~hit[1:]
        edges = part.bounds[1:-1][(part.bounds[1:-1] > 0) & (part.bounds[1:-1] < len(hit))]  # spans end with their document
        first[edges], last[edges - 1] = hit[edges], hit[edges - 1]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last)
        doc = np.searchsorted(part.bounds, starts, side="right") - 1
        pairs = np.unique(np.stack([docs, classes]), axis=1) if len(docs) else np.zeros((2, 0), np.int64)
        columns = [pa.array(np.diff(part.bounds).astype(np.int64)), _lists(starts - part.bounds[doc], doc, n), _lists(ends + 1 - part.bounds[doc], doc, n), _lists(pairs[1], pairs[0], n)]
        for kept, column in zip(out, columns):
            kept.append(column)
    return [pa.concat_arrays(x) if x else pa.array([], kind) for x, (_, kind) in zip(out, _FOUND)]


def _search(docs: DataFrame, patterns: pa.Table, more: bool) -> DataFrame:
    """docs with what a pass found; more: the text stays for another pass."""
    shared = docs.sparkSession.sparkContext.broadcast(Searcher(patterns.column("win").combine_chunks(), patterns.column("class").to_numpy()))
    kept = ["doc_id", "text"] if more else ["doc_id"]
    again = "starts" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _searched(shared.value, batch.column("text"), batch if again else None)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + found, kept + [name for name, _ in _FOUND])

    own = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in kept)
    return docs.mapInArrow(run, f"{own}, n_words long, starts array<long>, ends array<long>, classes array<long>")


def windows(items: DataFrame, size: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(win, class) of each distinct window, and (class, item) of each class: windows of the same items share a class.

    An item with fewer words than size is one window; an item without words has none. Null item_ids count as one item, ''.
    """
    words = alnum.words_of(F.col("text"))
    each = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, size), " "))
    own = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words.alias("words")).where("size(words) > 0")
    owned = own.select("item", F.explode(each).alias("win")).distinct()
    digest = lambda seed: F.xxhash64(F.lit(seed), "item")
    owners = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(digest(1)).alias("a"), F.bit_xor(digest(2)).alias("b"), F.sum(F.shiftrightunsigned(digest(3), 24)).alias("c"))
    owned = tx.written(owned, "leaks-owned")
    listed = tx.written(owned.groupBy("win").agg(owners.alias("owners")), "leaks-windows")
    classes = tx.written(listed.groupBy("owners").agg(F.min("win").alias("win")).withColumn("class", F.monotonically_increasing_id()), "leaks-classes")
    members = owned.join(classes.select("win", "class"), "win").select("class", "item")
    return listed.join(classes.select("owners", "class"), "owners").select("win", "class"), members


def leaks(docs: DataFrame, items: DataFrame, size: int = WINDOW, each: int = WINDOWS_EACH) -> tuple[DataFrame, DataFrame]:
    """Per row of docs: doc_id, n_words, the spans of words inside windows (starts, ends), classes; and (class, item).

    Documents are read once for each ``each`` windows, and one pass at a time is on the driver and in the workers.
    """
    spark = docs.sparkSession
    listed, members = windows(items, size)
    passes = max(1, -(-listed.count() // each))
    listed = tx.written(listed.withColumn("pass", F.pmod(F.xxhash64("win"), F.lit(passes))), "leaks-passes")
    docs = docs.select("doc_id", "text")
    for k in range(passes):
        patterns = listed.where(F.col("pass") == k).select("win", "class").toArrow()
        with tx.text_batches(spark):
            docs = tx.written(_search(docs, patterns, more=k + 1 < passes), "leaks-found")
    return docs, members


def _digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def decontamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, each: int = WINDOWS_EACH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each row of docs.

    Rows are kept as they are, repeated ones and null doc_ids too; a null or empty text has no words and no hit. Repeated
    item_ids are one item. A document that holds the windows of many items lists them all once, for its digest; documents
    of equal item classes share that list. Other columns are not looked at. Empty tables give no rows, or no hits.
    """
    found, members = leaks(docs, items, size, each)
    span = F.aggregate(F.zip_with("starts", "ends", lambda a, b: b - a), F.lit(0).cast("long"), lambda x, y: x + y)
    out = found.select("doc_id", "n_words", span.alias("n_hit"), "classes")
    clean, hit = out.where("size(classes) = 0"), out.where("size(classes) > 0")
    sets = hit.select("classes").distinct()
    own = sets.select("classes", F.explode("classes").alias("class")).join(members, "class").groupBy("classes").agg(F.array_sort(F.collect_set("item")).alias("items"))
    own = own.select("classes", F.size("items").cast("long").alias("n_items"), _digest(F.col("items")).alias("items_sha256"))
    none = clean.select("doc_id", "n_words", "n_hit", F.lit(0).cast("long").alias("n_items"), _digest(F.array().cast("array<string>")).alias("items_sha256"))
    return none.unionByName(hit.join(own, "classes").drop("classes")).withColumn("contaminated", F.col("n_hit") > 0)


#: DuckDB SQL of the query: every window of every document joined with the windows of the items.
ORACLE = rf"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{alnum.UPPER}', '{alnum.LOWER}'), '{alnum.WORD}'), []::VARCHAR[]) AS words FROM documents),
     b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, '{alnum.UPPER}', '{alnum.LOWER}'), '{alnum.WORD}') AS words FROM benchmark WHERE text IS NOT NULL),
     p AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(len(words) - {WINDOW} + 1, 1) + 1), lambda i: array_to_string(words[i:i + {WINDOW - 1}], ' '))) AS win, least(len(words), {WINDOW}) AS n FROM b WHERE len(words) > 0),
     lengths AS (SELECT DISTINCT n FROM p),
     places AS (SELECT r, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, lengths WHERE len(words) >= n),
     found AS (SELECT a.r, a.i, a.n, p.item FROM places a JOIN w USING (r) JOIN p ON p.n = a.n AND p.win = array_to_string(w.words[a.i:a.i + a.n - 1], ' ')),
     covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS k FROM found) GROUP BY r),
     named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (r) LEFT JOIN named USING (r)"""
