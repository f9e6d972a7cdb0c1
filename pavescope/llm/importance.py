"""Importance resampling towards a target distribution: hashed n-gram buckets, integer word dictionary, Gumbel top-k.

Documents are cut into blocks of some megabytes. A block lists its distinct words once, and its documents hold numbers
of that list. Distinct words of all blocks get ids; an n-gram is a tuple of ids. Each distinct tuple is written out in
bytes and hashed once, its counts over both tables add to its bucket, and the bucket's gain goes back to the blocks
by tuple, so that words never travel with documents. A document's n-grams are then looked up inside its block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import alnum
from . import text as tx

LENGTHS, BUCKETS, SEED, SHARE, LEAST_WORDS = 1, 10_000, 2024, 10, 20
#: Text bytes of a block: the more, the fewer rows of its words for each of its documents.
BLOCK_BYTES = 8 << 20

_ENCODED = "kind string, target boolean, block long, seq long, doc_id {id}, n_words long, n_features long, features array<int>, counts array<int>, feature int, codes array<int>, word string, times long"


def _distinct(codes: np.ndarray, bounds: np.ndarray, lengths: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct n-grams of a block, shortest first: (per occurrence its feature, codes of each feature, per occurrence its place)."""
    room = np.repeat(bounds[1:], np.diff(bounds)) - np.arange(len(codes))
    size = int(codes.max()) + 1 if len(codes) else 0
    feature, place, tuples = [codes.astype(np.int64)], [np.arange(len(codes))], [np.array([c]) for c in range(size)]
    run, first = codes.astype(np.int64), len(tuples)
    for n in range(2, lengths + 1):
        at = np.flatnonzero(room >= n)
        keys, inverse = np.unique(run[at] * size + codes[at + n - 1], return_inverse=True)
        shown = np.zeros(len(keys), np.int64)
        shown[inverse] = at
        tuples += [codes[p : p + n] for p in shown]
        feature.append(first + inverse)
        place.append(at)
        run = np.zeros(len(codes), np.int64)
        run[at] = inverse
        first += len(keys)
    return np.concatenate(feature), tuples, np.concatenate(place)


def _block(part: alnum.Chunk, ids: pa.Array, block: int, target: bool, lengths: int, schema: pa.Schema) -> pa.RecordBatch:
    """Rows of a block: its documents, its words, and its n-grams of two words or more."""
    own = part.words.dictionary_encode()
    codes, docs = own.indices.to_numpy(zero_copy_only=False), len(part.bounds) - 1
    feature, tuples, place = _distinct(codes, part.bounds, lengths)
    doc = np.searchsorted(part.bounds, place, side="right") - 1
    pairs, counts = np.unique(doc * max(1, len(tuples)) + feature, return_counts=True)
    of, which = np.divmod(pairs, max(1, len(tuples)))
    offsets = pa.array(np.searchsorted(of, np.arange(docs + 1)).astype(np.int32))
    times = np.bincount(feature, minlength=len(tuples))
    words, more = len(own.dictionary), len(tuples) - len(own.dictionary)
    rows = docs + words + more
    lists = lambda values: pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))
    pad = lambda before, values: pa.concat_arrays([pa.nulls(before, values.type), values, pa.nulls(rows - before - len(values), values.type)])
    longer = tuples[words:]
    made = {
        "kind": pa.array(["doc"] * docs + ["word"] * words + ["gram"] * more), "target": pa.array([target] * rows), "block": pa.array(np.full(rows, block)),
        "seq": pad(0, pa.array(np.arange(docs))), "doc_id": pad(0, ids.cast(schema.field("doc_id").type)), "n_words": pad(0, pa.array(np.diff(part.bounds).astype(np.int64))),
        "n_features": pad(0, pa.array(np.bincount(doc, minlength=docs).astype(np.int64))), "features": pad(0, lists(which)), "counts": pad(0, lists(counts)),
        "feature": pad(docs, pa.array(np.arange(len(tuples)).astype(np.int32))), "codes": pad(docs + words, pa.array([t.tolist() for t in longer], pa.list_(pa.int32()))),
        "word": pad(docs, own.dictionary.cast(pa.string())), "times": pad(docs, pa.array(times.astype(np.int64))),
    }
    return pa.RecordBatch.from_arrays([made[f.name] for f in schema], schema=schema)


def _encoded(texts: DataFrame, doc_id: str, target: bool, lengths: int) -> DataFrame:
    """texts in blocks; a block's number holds its task, so that a task that runs again gives the same ones."""
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    most = BLOCK_BYTES
    made = StructType.fromDDL(_ENCODED.format(id=texts.schema[doc_id].dataType.simpleString()))

    def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, block = to_arrow_schema(made), (TaskContext.get().partitionId() * 2 + target) << 30
        for lot in lots(batches):
            ids = lot.column(0).combine_chunks()
            ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
            for part in alnum.chunks(lot.column(1), most):
                yield from tx.slices(iter([_block(part, ids.slice(part.first, len(part.bounds) - 1), block, target, lengths, schema)]))
                block += 1

    return texts.select(doc_id, "text").mapInArrow(run, made)


def _gains(t: Column, s: Column, target: Column, source: Column, buckets: int) -> Column:
    """floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), in doubles; s and S are of the documents."""
    d = lambda c: c.cast("double")
    return F.floor(1000 * F.log(((d(t) + 1) * (d(source) + buckets)) / ((d(s) + 1) * (d(target) + buckets)))).cast("long")


def tuples(encoded: DataFrame, lengths: int) -> tuple[DataFrame, DataFrame]:
    """(block, feature, gram, target, times) with each n-gram as a tuple of word ids, and (gram, bucket-ready bytes as text) of each distinct one."""
    words = encoded.where("kind = 'word'").select("target", "block", "feature", "word", "times")
    dictionary = tx.written(words.groupBy("word").agg(F.sum("times").alias("times")).withColumn("id", F.monotonically_increasing_id()).drop("times"), "importance-words")
    ids = words.join(dictionary, "word").select("block", "feature", "id", "target", "times")
    if lengths > 1:
        ids = tx.written(ids, "importance-ids")
    grams = ids.select("block", "feature", F.array("id").alias("gram"), "target", "times")
    if lengths > 1:
        each = encoded.where("kind = 'gram'").select("block", "feature", "target", "times", F.posexplode("codes").alias("nth", "code"))
        numbered = each.join(ids.select("block", F.col("feature").alias("code"), "id"), ["block", "code"])
        longer = numbered.groupBy("block", "feature", "target", "times").agg(F.array_sort(F.collect_list(F.struct("nth", "id"))).alias("of"))  # at most ``lengths`` of each
        grams = grams.unionByName(longer.select("block", "feature", F.col("of.id").alias("gram"), "target", "times"))
    grams = tx.written(grams, "importance-grams")
    if lengths > 1:
        tx.discard(ids)
    distinct = grams.groupBy("gram").agg(F.sum(F.when(F.col("target"), F.col("times")).otherwise(0)).alias("t"), F.sum(F.when(F.col("target"), 0).otherwise(F.col("times"))).alias("s"))
    spelt = distinct.withColumn("text", F.lit(""))
    for n in range(lengths):
        word = dictionary.select(F.col("id").alias("_id"), F.col("word").alias("_word"))
        spelt = spelt.withColumn("_id", F.get("gram", F.lit(n))).join(word, "_id", "inner" if n == 0 else "left")
        spelt = spelt.withColumn("text", F.when(F.lit(n == 0), F.col("_word")).otherwise(F.concat_ws(" ", "text", "_word"))).drop("_id", "_word")
    return grams, spelt


def weights(docs: DataFrame, items: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row of docs."""
    with tx.text_batches(docs.sparkSession):
        encoded = tx.written(_encoded(docs, "doc_id", False, lengths), "importance-documents")
        aimed = tx.written(_encoded(items.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text"), "doc_id", True, lengths), "importance-items")
    grams, spelt = tuples(encoded.unionByName(aimed), lengths)
    hashed = tx.written(spelt.select("gram", "t", "s", F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(buckets)).cast("int").alias("bucket")), "importance-hashed")
    filled = hashed.groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    total = filled.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("target"), F.coalesce(F.sum("s"), F.lit(0)).alias("source"))
    # a row a bucket
    gains = filled.crossJoin(F.broadcast(total)).select("bucket", _gains(F.col("t"), F.col("s"), F.col("target"), F.col("source"), buckets).alias("gain"))
    of = hashed.join(F.broadcast(gains), "bucket").select("gram", "gain")
    back = grams.where("NOT target").select("block", "feature", "gram").join(of, "gram").select("block", F.struct("feature", F.col("gain").cast("int").alias("gain")).alias("of"))
    # a row a block, as large as its vocabulary
    back = tx.written(back.groupBy("block").agg(F.array_sort(F.collect_list("of")).alias("of")).select("block", F.col("of.gain").alias("gains")), "importance-gains")
    for done in (grams, hashed, aimed):
        tx.discard(done)
    rows = encoded.where("kind = 'doc'").select("block", "doc_id", "n_words", "n_features", "features", "counts")

    def weigh(docs: pa.Table, gains: pa.Table) -> pa.Table:
        gain = gains.column("gains").combine_chunks().flatten().to_numpy().astype(np.int64)
        features = docs.column("features").combine_chunks()
        amounts = np.zeros(len(features.flatten()) + 1, np.int64)
        np.cumsum(gain[features.flatten().to_numpy()] * docs.column("counts").combine_chunks().flatten().to_numpy(), out=amounts[1:])
        edges = np.zeros(docs.num_rows + 1, np.int64)
        np.cumsum(features.value_lengths().to_numpy(), out=edges[1:])
        n = docs.column("n_features").to_numpy()
        return docs.select(["doc_id", "n_words", "n_features"]).append_column("weight", pa.array(np.diff(amounts[edges]) // np.maximum(n, 1)))

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long"
    return rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(weigh, schema)


def ranked(scored: DataFrame, drawn: int) -> DataFrame:
    """scored with rank of the ``drawn`` highest scores among eligible rows; ties to the smaller doc_id, nulls last.

    Scores are whole numbers within some 100,000 values, so their counts are a small table; only rows of one score,
    no lower than the last one drawn, meet in a task.
    """
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = scored.where("eligible").groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    ahead = counts.select("score", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_ahead")).where(F.col("_ahead") < drawn)
    own = scored.join(F.broadcast(ahead), "score", "left")
    near = F.col("eligible") & F.col("_ahead").isNotNull()
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last()))
    close = own.where(near).withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return close.unionByName(own.where(~near).withColumn("rank", F.lit(None).cast("long"))).drop("_ahead", "eligible")


def importance(docs: DataFrame, items: DataFrame, lengths: int = LENGTHS, buckets: int = BUCKETS, seed: int = SEED, share: int = SHARE, least: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs; the floor(share N / 100) best of N rows with ``least`` words have a rank.

    Rows are kept as they are; repeated ones have equal scores and ranks of their own. A null text has no features and
    weight 0; a null doc_id is hashed as empty text and comes last in ties. Without items, gains only level the documents'
    own counts. Other columns are not looked at; empty docs give no rows.
    """
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    weighed = weights(docs, items, lengths, buckets)
    scored = tx.written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least).alias("eligible")), "importance-scored")
    drawn = share * scored.where("eligible").count() // 100
    return ranked(scored, drawn).select("doc_id", "n_features", "weight", "score", "rank")


#: DuckDB SQL of a text's crc32, from the polynomial, bit by bit.
CRC32 = "xor(list_reduce(list_transform(range(strlen({0})), lambda i: ('0x' || substr(hex(encode({0})), 2 * i + 1, 2))::BIGINT), lambda c, b: list_reduce(range(8), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, xor(c, b)), 4294967295), 4294967295)"
#: DuckDB SQL of the query.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{alnum.UPPER}', '{alnum.LOWER}'), '{alnum.WORD}') AS words FROM documents),
     dw AS (SELECT r, unnest(words) AS word FROM d),
     bw AS (SELECT unnest(regexp_extract_all(translate(text, '{alnum.UPPER}', '{alnum.LOWER}'), '{alnum.WORD}')) AS word FROM benchmark),
     n AS (SELECT word, sum(s) AS s, sum(t) AS t FROM (SELECT word, 1 AS s, 0 AS t FROM dw UNION ALL SELECT word, 0, 1 FROM bw) GROUP BY word),
     h AS (SELECT word, s, t, {CRC32.format('word')} % {BUCKETS} AS bucket FROM n),
     b AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM h GROUP BY bucket),
     g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM b) + {BUCKETS})) / ((s + 1) * ((SELECT sum(t) FROM b) + {BUCKETS}))))::BIGINT AS gain FROM b),
     w AS (SELECT r, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM dw JOIN h USING (word) JOIN g USING (bucket) GROUP BY r),
     s AS (SELECT r, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
                  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM d LEFT JOIN w USING (r)),
     o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM s WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {SHARE} * (SELECT count(*) FROM o) // 100 THEN rank END AS rank FROM s LEFT JOIN o USING (r)"""
