"""Mixing sources to target weights by a low-discrepancy schedule.

Slot t of the schedule takes the point t / golden ratio (mod 1), in exact 64-bit arithmetic, and the
source whose interval of cumulative target shares holds it. Slots are ranked per source, and the slot
of rank r plays block r of its source: documents in hash order, cut into blocks of equal word counts,
played again from the first block when all have been played. A source has blocks of its own size, BLOCKS at least
where it has as many words; its slots end with its target, the last one inside its block if need be.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .running import hash_bucket, running_before

WEIGHTS, MOST_PASSES = (5, 2, 1), 3
SLOTS, MOST_BLOCK = 1 << 18, 1 << 16
#: Blocks that each source is cut into at least.
BLOCKS = 256
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_CHUNK_BITS = 16


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, passes: int = MOST_PASSES) -> list[float]:
    """Shares of sum(sizes) by weight, none above passes times its size; what is above is shared out again."""
    out, rest, free = [0.0] * len(sizes), float(sum(sizes)), list(range(len(sizes)))
    while free:
        total = sum(weights[i % len(weights)] for i in free)
        share = {i: rest * weights[i % len(weights)] / total for i in free}
        over = [i for i in free if share[i] > passes * sizes[i]]
        for i in over or free:
            out[i] = float(passes * sizes[i]) if over else share[i]
        if not over:
            break
        rest -= sum(passes * sizes[i] for i in over)
        free = [i for i in free if i not in set(over)]
    return out


@dataclass
class Mix:
    """sized: row, doc_id, source, size, and src, the source's number; sources: per source (source, size, target); block: words in a block of each."""

    sized: DataFrame
    sources: list[tuple[str | None, int, float]]
    block: list[int]
    slots: DataFrame
    pieces: DataFrame


def _slot_sources(edges: np.ndarray):
    def run(batches):
        for batch in batches:
            slot = batch.column("id").to_numpy(zero_copy_only=False)
            points = ((slot.astype(np.uint64) + np.uint64(1)) * _GOLDEN >> np.uint64(11)).astype(np.float64) / 2.0**53
            src = np.searchsorted(edges, points, side="right").clip(0, len(edges) - 1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(src.astype(np.int32))], ["slot", "src"])

    return run


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> Mix:
    """The schedule: slots (slot, src, pass, block) and pieces (src, block, doc_id, row, words of the document in the block, and those played in each pass).

    Sources (one row for each on the driver) are numbered by code point, null last. A null text has size 0.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(tx.WORD)), F.lit(0)).cast("long")
    row = F.xxhash64("doc_id", "source", "text")
    sized = tx.written(docs.select("doc_id", "source", size.alias("size"), row.alias("row")), "mixing-sizes")
    found = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode()))
    goal, total = targets([r["size"] for r in found], weights), sum(r["size"] for r in found)
    sources = [(r.source, r["size"], t) for r, t in zip(found, goal)]
    block = [max(1, min(total // SLOTS, MOST_BLOCK, n // BLOCKS)) for _, n, _ in sources]
    blocks = [max(1, -(-n // b)) for (_, n, _), b in zip(sources, block)]
    words = [round(t) for t in goal]
    # slots until the target: whole passes, then the blocks that hold the rest
    needed = [w // n * k + -(-(w % n) // b) if n else 0 for (_, n, _), w, k, b in zip(sources, words, blocks, block)]
    table = spark.createDataFrame([(i, *x) for i, x in enumerate(zip([r.source for r in found], blocks, block, needed, words, [n for _, n, _ in sources]))], "src int, name string, blocks long, block_words long, needed long, goal long, source_size long")
    sized = sized.join(table.select("src", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    # the schedule
    count = sum(needed)
    slots = spark.range(count).mapInArrow(_slot_sources(np.cumsum(needed) / max(count, 1)), "slot long, src int")
    slots = running_before(slots, ["src"], F.shiftright("slot", _CHUNK_BITS), ["slot"], F.lit(1), "rank").select("slot", "src", "rank")
    # the points give a source some slots more or less than it needs: those over are left out, those missing follow at the end
    dealt = {r.src: r.n for r in slots.groupBy("src").agg(F.count(F.lit(1)).alias("n")).collect()}
    missing = [(i, rank) for i, n in enumerate(needed) for rank in range(dealt.get(i, 0), n)]
    slots = slots.unionByName(spark.createDataFrame([(count + j, i, rank) for j, (i, rank) in enumerate(missing)], "slot long, src int, rank long"))
    slots = slots.join(table.select("src", "blocks", "needed"), "src").where("rank < needed")
    slots = slots.select("slot", "src", F.expr("rank div blocks").alias("pass"), F.expr("rank % blocks").alias("block"))
    # the blocks: equal rows of documents keep apart by their running number only, and any order of theirs is the same
    rows = max([r.n for r in found], default=1)
    laid = running_before(sized.where("size > 0"), ["src"], hash_bucket(rows, "row"), ["row", "doc_id"], F.col("size"), "start")
    laid = laid.join(table.select("src", "block_words", "goal", "source_size"), "src")
    pieces = laid.select("*", F.explode(F.sequence(F.expr("start div block_words"), F.expr("(start + size - 1) div block_words"))).alias("block"))
    begins, ends = F.greatest("start", F.col("block") * F.col("block_words")), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * F.col("block_words"))
    # a pass ends at the target
    took = [F.greatest(F.lit(0), F.least(ends, F.col("goal") - p * F.col("source_size")) - begins) for p in range(MOST_PASSES)]
    pieces = pieces.select("src", "block", "doc_id", "row", "start", "size", (ends - begins).alias("words"), F.array(*took).alias("in_pass"))
    return Mix(sized, sources, block, slots, pieces)


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target, taken and passes (words taken in each pass over the source).

    Equal rows are separate documents with one outcome each. Rows without words take nothing. A null
    source is a source of its own. An empty table gives an empty result. Other columns are not looked at.
    """
    m = plan(docs, weights)
    uses = m.slots.groupBy("src", "block").agg(F.count(F.lit(1)).alias("uses"))
    played = m.pieces.join(uses, ["src", "block"])
    taken = played.groupBy("src", "row", "doc_id", "start", "size").agg(*[F.sum(F.when(F.col("uses") > p, F.col("in_pass")[p]).otherwise(0)).alias(f"p{p}") for p in range(MOST_PASSES)])
    taken = taken.select("src", "doc_id", "row", "size", sum((F.col(f"p{p}") for p in range(1, MOST_PASSES)), F.col("p0")).alias("taken"), F.array(*[f"p{p}" for p in range(MOST_PASSES)]).alias("passes"))
    taken = tx.written(taken, "mixing-taken")  # read twice: the schedule is planned and run once
    # rows that took nothing: as many as the sized rows have more than the taken ones of the same key
    have = taken.groupBy("src", "row", F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("doc_id").isNull().alias("null_id")).agg(F.count(F.lit(1)).alias("have"))
    all_rows = m.sized.groupBy("src", "row", F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("doc_id").isNull().alias("null_id"), "size").agg(F.count(F.lit(1)).alias("n"))
    rest = all_rows.join(have, ["src", "row", "k", "null_id"], "left").withColumn("more", F.col("n") - F.coalesce("have", F.lit(0))).where("more > 0")
    rest = rest.select("src", F.when(~F.col("null_id"), F.col("k")).alias("doc_id"), "row", "size", F.lit(0).cast("long").alias("taken"), F.array_repeat(F.lit(0).cast("long"), MOST_PASSES).alias("passes"), F.explode(F.sequence(F.lit(1), F.col("more"))).alias("_i")).drop("_i")
    table = docs.sparkSession.createDataFrame([(i, n, t) for i, (_, n, t) in enumerate(m.sources)], "src int, source_size long, target double")
    return taken.unionByName(rest).join(table, "src").select("doc_id", "size", "source_size", "target", "taken", "passes", "row")


def _prefix(text: str, words: int) -> str:
    data, offsets = tx.text_bytes(pa.array([text]))
    (found,) = tx.hashed_words(data, offsets)
    return data[: found.ends[words - 1]].tobytes().decode()


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each pass over a document, with the words that pass took.

    A pass that the mix leaves in the middle of a document ends its text there (and n_chars, if there is one).
    """
    plays = mix(docs, weights).select(F.col("row").alias("_row"), F.col("size").alias("_size"), F.explode("passes").alias("_words")).where("_words > 0")
    named = docs.withColumn("_row", F.xxhash64("doc_id", "source", "text"))
    counts = named.groupBy("_row").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    if not counts.isEmpty():  # plays of equal rows are interchangeable
        named = named.dropDuplicates(["_row"])
    played, names = named.join(plays, "_row"), docs.columns

    def cut(batches):
        for batch in batches:
            partial = np.flatnonzero(batch.column("_words").to_numpy() < batch.column("_size").to_numpy())
            columns = {name: batch.column(name) for name in names}
            if len(partial):
                texts = batch.column("text").to_pylist()
                for i in partial.tolist():
                    texts[i] = _prefix(texts[i], batch.column("_words")[i].as_py())
                columns["text"] = pa.array(texts, pa.string())
                if "n_chars" in columns:
                    sizes, own = columns["n_chars"].to_pylist(), set(partial.tolist())
                    columns["n_chars"] = pa.array([len(t) if i in own else n for i, (t, n) in enumerate(zip(texts, sizes))], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return played.mapInArrow(cut, docs.schema)
