"""Exact Jaccard join of shingle sets in their metric space.

The Jaccard distance is a metric, and two documents link when it is at most R = 0.1. Sets of unrelated texts
are all at distance one from each other, so document pivots alone cannot part a corpus. The join therefore
uses pivots of two kinds, both by their triangle-inequality windows:

1. Shingle pivots. Every single shingle {s} is a pivot. For all s in x the distance to {s} is the same, and the
   nearest pivot is taken to be the rarest shingle. A document within R of x has at most floor(n / 10) of x's shingles
   missing, so its nearest shared pivot is among the floor(n / 10) + 1 rarest of x: this window of regions is
   where x is replicated to. Rarity comes from hashed counters over the whole corpus; any one order is exact.
2. Document pivots. In each region the document nearest to its centre (fewest rarer shingles) is a pivot p, and
   exact distances to p are computed. Those within R link to it and are connected, so their own pairs need no look. What a
   region still has in different components joins recursively: regions of at most SMALL members pair by
   pair, larger ones again through pivots: members get their distances to FAN pivots, go to the nearest one's
   Voronoi region and to each other region whose pivot is at most 2 R farther, and those regions join in turn.

Equal sets are one class from the start. Components come from min-label propagation over distinct links.
The links of each document are counted afterwards: all of them lie in components, whose sets are compared each with each, tile by tile.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import sketch
from . import text as tx

SHINGLE = 3
#: Links: 100 * intersection >= LEAST * union.
LEAST = 90
SMALL, FAN, SPREAD, DEPTH = 48, 6, 2.5, 12
GROUP_BYTES = 8 << 20
#: Classes in a tile of a component at most, and shingles in a block of its product.
TILE_ROWS, TILE_ITEMS = 2_048, 512
#: Counters of rarity: 8 MB broadcast, whatever the corpus.
RARITY_BITS = 23


def shingles(words: tx.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents (places in the chunk, ascending) and their distinct shingle hashes, sorted in each.

    A document of fewer than k words has its whole sequence as its one shingle.
    """
    sizes = np.diff(words.bounds)
    grams = tx.rolling(words.hashes, k, 5)
    at = np.flatnonzero(words.room()[: len(grams)] >= k)
    doc, own = [words.doc(at)], [grams[at]]
    for short in range(1, k):
        rows = np.flatnonzero(sizes == short)
        doc.append(rows)
        own.append(tx.rolling(words.hashes, short, 5 + short)[words.bounds[:-1][rows]] if len(rows) else np.zeros(0, tx.U64))
    doc, own = np.concatenate(doc), np.concatenate(own)
    order = np.lexsort((own, doc))
    doc, own = doc[order], own[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1])][: len(doc)]
    return doc[new], own[new]


def _window(n: np.ndarray, least: int) -> np.ndarray:
    """How many of the rarest shingles of a set of n some linked set must share one of."""
    return n - -(-n * least // 100) + 1


def _rarity(sums: np.ndarray) -> np.ndarray:
    """One byte for each count, in steps of a fifth of a doubling; any one order of the shingles is exact."""
    return np.minimum(np.rint(5 * np.log2(sums + 1)), 255).astype(np.uint8)


def _prints(rarity: np.ndarray, k: int, least: int):
    """doc_id, text_hash, n, digest (two longs) and the window of shingle pivots, rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            rows = batch.num_rows
            n, a, b = np.zeros(rows, np.int64), np.zeros(rows, tx.U64), np.zeros(rows, tx.U64)
            pivots: list = [[]] * rows
            for words in tx.hashed_words(*tx.text_bytes(batch.column("text")), lower=True):
                doc, own = shingles(words, k)
                if not len(doc):
                    continue
                begun = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                here = words.first + doc[begun]
                n[here] = np.diff(np.r_[begun, len(doc)])
                a[here], b[here] = (np.add.reduceat(tx.mix(own ^ tx.U64(salt)), begun) for salt in (0x51, 0xA7))
                order = np.lexsort((own, rarity[sketch.counter_of(own, RARITY_BITS)], doc))
                sorted_own = own[order].view(np.int64)
                for row, start, take in zip(here.tolist(), begun.tolist(), _window(n[here], least).tolist()):
                    pivots[row] = sorted_own[start : start + take].copy()  # a view would keep the whole chunk
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(pivots, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n", "a", "b", "pivots"])

    return run


def _sets(bits: np.ndarray, k: int):
    """doc_id, text_hash and the sorted set of the marked documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.slices(batches):
            hashes = batch.column("mark").to_numpy(zero_copy_only=False)
            batch = batch.take(pa.array(np.flatnonzero(sketch.marked(bits, hashes))))
            sets: list[bytes] = [b""] * batch.num_rows
            for words in tx.hashed_words(*tx.text_bytes(batch.column("text")), lower=True):
                doc, own = shingles(words, k)
                edges = np.searchsorted(doc, np.arange(len(words.bounds)))
                sets[words.first : words.first + len(words.bounds) - 1] = [own[x:y].tobytes() for x, y in zip(edges[:-1], edges[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(sets, pa.binary())], ["doc_id", "text_hash", "items"])

    return run


def _compare(left: pa.Table, right: pa.Table) -> pa.Table:
    """Sizes of intersections of one set (left) with each of many."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("both", pa.int64()), ("union", pa.int64())])
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    mine = np.frombuffer(left.column("items")[0].as_py(), tx.U64)
    raw = right.column("its_items").to_pylist()
    theirs = np.frombuffer(b"".join(raw), tx.U64)
    edges = np.cumsum([0, *(len(r) // 8 for r in raw)])
    found = np.r_[0, np.cumsum(mine[np.minimum(np.searchsorted(mine, theirs), len(mine) - 1)] == theirs)]
    both = found[edges[1:]] - found[edges[:-1]]
    return pa.table({"x": pa.array(np.full(len(raw), left.column("x")[0].as_py(), np.int64)), "y": right.column("y"), "both": pa.array(both), "union": pa.array(len(mine) + np.diff(edges) - both)}, schema=schema)


def _count(least: int):
    """node and the rows of the classes its set links with, over the pairs of one cell: a tile with itself (low = high), or with another."""

    def run(table: pa.Table) -> pa.Table:
        node, copies, tile = (table.column(c).to_numpy() for c in ("node", "copies", "tile"))
        own = np.flatnonzero(tile == table.column("low")[0].as_py())
        other = np.flatnonzero(tile == table.column("high")[0].as_py())
        raw = table.column("items").to_pylist()
        n = np.array([len(r) // 8 for r in raw], np.int64)
        _, place, held = np.unique(np.frombuffer(b"".join(raw), tx.U64), return_inverse=True, return_counts=True)
        # shingles of one set only are in no intersection
        at = np.flatnonzero(held[place] > 1)
        row, place = np.repeat(np.arange(len(n)), n)[at], (np.cumsum(held > 1) - 1)[place[at]]
        order = np.argsort(place, kind="stable")
        row, place = row[order], place[order]
        kind = np.float32 if n.max(initial=0) < 1 << 24 else np.float64
        both = np.zeros((len(own), len(other)), kind)
        for first in range(0, int(place[-1]) + 1 if len(place) else 0, TILE_ITEMS):
            a, b = np.searchsorted(place, [first, first + TILE_ITEMS])
            holds = np.zeros((len(n), min(TILE_ITEMS, int(place[-1]) + 1 - first)), kind)
            holds[row[a:b], place[a:b] - first] = 1
            both += holds[own] @ holds[other].T
        found, same = np.zeros(len(n), np.int64), tile[own[0]] == tile[other[0]] if len(own) and len(other) else False
        for a in range(0, len(own), 256):
            rows, shared = own[a : a + 256], both[a : a + 256].astype(np.int64)
            linked = shared * 100 >= (n[rows, None] + n[None, other] - shared) * least
            if same:
                linked[np.arange(len(rows)), a + np.arange(len(rows))] = False
            else:
                found[other] += copies[rows] @ linked
            found[rows] += linked @ copies[other]
        return pa.table({"node": pa.array(node), "links": pa.array(found)})

    return run


class Join:
    """The state of one join: classes, their shingle regions, sets, and what has been compared so far."""

    def __init__(self, docs: DataFrame, k: int = SHINGLE, least: int = LEAST):
        self.spark, self.least = docs.sparkSession, least
        self.n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
        rarity, _ = sketch.corpus_counts(docs, lambda words: shingles(words, k)[1], bits=RARITY_BITS, as_kept=_rarity)
        sent = self.spark.sparkContext.broadcast(rarity)
        prints = docs.mapInArrow(lambda batches: tx.given_back(_prints(sent.value, k, least)(batches)), "doc_id long, text_hash long, n long, a long, b long, pivots array<long>")
        with tx.text_batches(self.spark):
            prints = tx.written(prints, "jaccard-prints")
        sent.destroy()  # what was made with it is written
        self.rows = tx.written(prints.drop("pivots"), "jaccard-rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash"))
        classes = prints.where("n > 0").groupBy("a", "b", "n").agg(first.alias("first"), F.any_value("pivots").alias("pivots"), F.count(F.lit(1)).alias("copies"))
        classes = classes.select("a", "b", "n", F.col("first.doc_id").alias("label"), "first.text_hash", "pivots", "copies")
        # numbers given once, in a written table
        full = tx.written(classes.withColumn("node", F.monotonically_increasing_id()), "jaccard-pivots")
        tx.discard(prints)
        self.classes = tx.written(full.drop("pivots"), "jaccard-classes")
        members = full.select("node", F.col("n").cast("int").alias("n"), F.posexplode("pivots").alias("pos", "region"))
        shared = members.groupBy("region").agg(F.count(F.lit(1)).alias("m"), F.min("pos").alias("least_pos")).where("m > 1")
        # no partner of a member has fewer rarer shingles than the region's least; then intersection <= n - pos, union >= n + least_pos
        hopeful = (F.col("pos") == F.col("least_pos")) | ((F.col("n") - F.col("pos")) * 100 >= (F.col("n") + F.col("least_pos")) * least)
        met = tx.written(members.join(shared, "region").where(hopeful).select("region", "node", "n", "pos"), "jaccard-met")
        tx.discard(full)
        again = met.groupBy("region").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
        self.members = tx.written(met.join(again, "region"), "jaccard-members")
        tx.discard(met)
        self.docs, self.k, self.repeated = docs.withColumn("mark", F.xxhash64("doc_id", "text_hash")), k, None
        self.sets = self.read = None
        self.reads = 0
        self.compared = None
        self.components = self.classes.select("node", F.col("node").alias("component"))

    def _repeated(self) -> bool:
        if self.repeated is None:
            self.repeated = not self.rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").isEmpty()
        return self.repeated

    def _read_sets(self, pairs: DataFrame) -> None:
        """The sets of what is to be compared, each read from its text once."""
        wanted = pairs.select(F.col("x").alias("node")).unionByName(pairs.select(F.col("y").alias("node"))).distinct()
        if self.read is not None:
            wanted = wanted.join(self.read, "node", "left_anti")
        wanted = tx.written(wanted.join(self.classes.select("node", F.xxhash64("label", "text_hash").alias("mark")), "node"), "jaccard-wanted")
        if wanted.isEmpty() and self.read is not None:
            return
        # a bit for each wanted document, so that only their sets are written and no texts are shuffled
        bits = self.spark.sparkContext.broadcast(sketch.marks(wanted, "mark"))
        k = self.k
        sets = self.docs.mapInArrow(lambda batches: tx.given_back(_sets(bits.value, k)(batches)), "doc_id long, text_hash long, items binary")
        with tx.text_batches(self.spark):
            sets = tx.written(sets.dropDuplicates(["doc_id", "text_hash"]) if self._repeated() else sets, "jaccard-sets")
        bits.destroy()
        # a document of an earlier read whose bit is set again is read again: the number of the read that wanted it tells which set counts
        self.reads += 1
        sets, own = sets.withColumn("read", F.lit(self.reads)), wanted.select("node", F.lit(self.reads).alias("its_read"))
        self.sets = sets if self.sets is None else self.sets.unionByName(sets)
        self.read = own if self.read is None else self.read.unionByName(own)

    def _with_sets(self, df: DataFrame, node: str) -> DataFrame:
        """df with the items of the nodes in a column."""
        named = self.classes.join(self.read, "node").select(F.col("node").alias("its_node"), "label", F.col("text_hash").alias("its_hash"), "its_read")
        df = df.join(named, F.col(node) == F.col("its_node"))
        return df.join(self.sets, (F.col("text_hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("label")) & (F.col("read") == F.col("its_read")))

    def compare(self, pairs: DataFrame) -> DataFrame:
        """x, y, both, union of pairs (x < y) that have not been compared; added to ``compared``."""
        pairs = pairs.select("x", "y").distinct()
        if self.compared is not None:
            pairs = pairs.join(self.compared, ["x", "y"], "left_anti")
        pairs = tx.written(pairs, "jaccard-pairs")
        self._read_sets(pairs)
        sizes = self.classes.select("node", "n")
        # partners of a set are cut into groups of about GROUP_BYTES
        cuts = pairs.join(sizes, pairs.y == sizes.node).groupBy("x").agg(F.ceil(F.sum("n") * 8 / F.lit(GROUP_BYTES)).cast("int").alias("cuts"))
        ours = self._with_sets(cuts, "x").select("x", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("cut"), "items")
        theirs = self._with_sets(pairs.join(cuts, "x"), "y").select(F.col("x").alias("its_x"), F.pmod(F.xxhash64("y"), F.col("cuts")).cast("int").alias("its_cut"), "y", F.col("items").alias("its_items"))
        found = ours.groupBy("x", "cut").cogroup(theirs.groupBy("its_x", "its_cut")).applyInArrow(_compare, "x long, y long, both long, union long")
        found = tx.written(found, "jaccard-compared")
        tx.discard(pairs)
        self.compared = found if self.compared is None else self.compared.unionByName(found)
        return found

    def links(self) -> DataFrame:
        return self.compared.where(F.col("both") * 100 >= F.col("union") * self.least)

    def connect(self, links: DataFrame) -> None:
        """components after new links: min-label propagation between components, with pointer jumping."""
        of = self.components
        edges = links.join(of.withColumnRenamed("node", "x").withColumnRenamed("component", "u"), "x").join(of.withColumnRenamed("node", "y").withColumnRenamed("component", "v"), "y").where("u != v").select("u", "v").distinct()
        edges = tx.written(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "jaccard-edges")
        if edges.isEmpty():
            return
        label = tx.written(edges.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("c")), "jaccard-labels")
        while True:
            before = label
            around = edges.join(label.select(F.col("u").alias("v"), F.col("c").alias("near")), "v").groupBy("u").agg(F.min("near").alias("near"))
            nearer = label.join(around, "u").select("u", "c", F.least("c", "near").alias("best"))
            jump = label.select(F.col("u").alias("best"), F.col("c").alias("jumped"))
            after = nearer.join(jump, "best", "left").select("u", F.least("best", F.coalesce("jumped", "best")).alias("now"), "c")
            after = tx.written(after, "jaccard-labels")
            tx.discard(before)
            label = after.select("u", F.col("now").alias("c"))
            if after.where("now != c").isEmpty():
                break
        moved = of.join(label, of.component == label.u, "left").select("node", F.coalesce("c", "component").alias("component"))
        self.components = tx.written(moved, "jaccard-components")
        tx.discard(edges)
        tx.discard(label)

    def may_link(self, n: str, pos: str, m: str, at: str):
        """Whether sets of sizes n and m, with pos and at rarer shingles before the shared one, can link if it is the first they share.

        Linked sets meet in the region of the first shingle they share, so no link is lost.
        """
        most = F.least(F.col(n) - F.col(pos), F.col(m) - F.col(at))
        return most * 100 >= (F.col(n) + F.col(m) - most) * self.least

    def run(self) -> None:
        """All links between classes that are not connected otherwise."""
        centre = self.members.groupBy("region").agg(F.min(F.struct("pos", "n", "node")).alias("p"))
        stars = self.members.join(centre, "region").where((F.col("node") != F.col("p.node")) & self.may_link("n", "pos", "p.n", "p.pos"))
        stars = stars.select(F.least("node", "p.node").alias("x"), F.greatest("node", "p.node").alias("y"))
        self.compare(stars)
        self.connect(self.links())
        regions, depth = self.members.select("region", "node", "n", "pos"), 0
        while True:
            regions = self.open_regions(regions)
            if regions.isEmpty():
                return
            large = regions.where(F.col("m") > SMALL)
            parts, flat = self.voronoi(large) if depth < DEPTH else (None, large)
            pairs = self.open_pairs(regions.where(F.col("m") <= SMALL))
            self.compare(pairs if flat is None else pairs.unionByName(self.open_pairs(flat)))
            self.connect(self.links())
            if parts is None:
                return
            regions, depth = parts, depth + 1

    def counted(self) -> DataFrame:
        """node and links of the classes in components of several: the rows of the other classes that each links with. After run()."""
        here = self.components.join(self.classes.select("node", "n", "copies", F.xxhash64("label", "text_hash").alias("mark")), "node")
        sums = here.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("items"), F.sum("copies").alias("all")).where("m > 1")
        here = tx.written(here.join(sums, "component"), "jaccard-connected")
        # two connected classes link; of more, any two may or may not
        couples = here.where("m = 2").select("node", (F.col("all") - F.col("copies")).alias("links"))
        several = here.where("m > 2")
        bits = self.spark.sparkContext.broadcast(sketch.marks(several, "mark"))
        if self.sets is None:
            return couples

        def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(sketch.marked(bits.value, batch.column("mark").to_numpy())))

        # only the sets of such components are moved; each was read for some comparison
        sets = self.sets.withColumn("mark", F.xxhash64("doc_id", "text_hash")).mapInArrow(met, "doc_id long, text_hash long, items binary, read int, mark long").drop("mark")
        cuts = F.ceil(F.greatest(F.col("items") * 8 / F.lit(GROUP_BYTES), F.col("m") / F.lit(TILE_ROWS))).cast("int")
        tiles = several.select("node", "component", "copies", cuts.alias("cuts")).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("cuts")).cast("int"))
        tiles = tiles.join(self.classes.select("node", "label", "text_hash"), "node").join(self.read, "node").join(sets.withColumnRenamed("text_hash", "its_hash"), (F.col("text_hash") == F.col("its_hash")) & F.col("doc_id").eqNullSafe(F.col("label")) & (F.col("read") == F.col("its_read")))
        cells = tiles.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        cells = cells.select("component", F.least("tile", "with").alias("low"), F.greatest("tile", "with").alias("high"), "tile", "node", "copies", "items")
        found = cells.groupBy("component", "low", "high").applyInArrow(_count(self.least), "node long, links long")
        return couples.unionByName(found.groupBy("node").agg(F.sum("links").alias("links")))

    def open_regions(self, regions: DataFrame) -> DataFrame:
        """Members of regions that hold more than one component; of each, m members."""
        here = regions.join(self.components, "node")
        open_ = here.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("m")).where("low < high").select("region", "m")
        return tx.written(here.select("region", "node", "n", "pos", "component").join(open_, "region"), "jaccard-open")

    def open_pairs(self, regions: DataFrame) -> DataFrame:
        """Pairs in the same region and in different components that may link."""
        left, right = (regions.select("region", F.col("node").alias(a), F.col("n").alias(f"n_{a}"), F.col("pos").alias(f"at_{a}"), F.col("component").alias(f"c_{a}")) for a in "xy")
        return left.join(right, "region").where((F.col("x") < F.col("y")) & (F.col("c_x") != F.col("c_y")) & self.may_link("n_x", "at_x", "n_y", "at_y")).select("x", "y")

    def voronoi(self, large: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
        """Regions of FAN document pivots each in place of the given ones, with windows of 2 R; and what this does not part.

        Members of one region whose Voronoi regions would hold over SPREAD times its members lie too evenly for pivots.
        """
        if large.isEmpty():
            return None, None
        pairs = large.join(self._pivots(large), "region")
        self.compare(pairs.where(F.col("node") != F.col("pivot")).select(F.least("node", "pivot").alias("x"), F.greatest("node", "pivot").alias("y")))
        seen = self.compared.select("x", "y", (1 - F.col("both") / F.col("union")).alias("d"))
        far = pairs.withColumn("x", F.least("node", "pivot")).withColumn("y", F.greatest("node", "pivot")).join(seen, ["x", "y"], "left").withColumn("d", F.coalesce("d", F.lit(0.0)))
        homes = far.groupBy("region", "node").agg(F.min("d").alias("home"))
        inside = tx.written(far.join(homes, ["region", "node"]).where(F.col("d") <= F.col("home") + 2 * (1 - self.least / 100) + 1e-9).select("region", "node", "n", "pos", "m", "component", "pivot"), "jaccard-voronoi")
        even = inside.groupBy("region", "m").agg(F.count(F.lit(1)).alias("all")).where(F.col("all") > SPREAD * F.col("m")).select("region")
        parts = inside.join(even, "region", "left_anti").select(F.xxhash64("region", "pivot").alias("region"), "node", "n", "pos")
        return tx.written(parts, "jaccard-regions"), large.join(even, "region", "left_semi")

    def _pivots(self, regions: DataFrame) -> DataFrame:
        """FAN members of each region, least by a hash: kept apart in FAN lots, so no region is gathered."""
        lot = F.pmod(F.xxhash64("node", "region"), F.lit(FAN))
        best = regions.groupBy("region", lot.alias("lot")).agg(F.min(F.struct(F.xxhash64("region", "node").alias("h"), "node")).alias("p"))
        return best.select("region", F.col("p.node").alias("pivot"))


def jaccard_links(docs: DataFrame, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of each row of docs.

    component_id is the least doc_id reachable by links, the row's own included (null only where all of them are
    null). n_links counts all other rows the row links with. Rows without words, with null or empty text, have no shingles and link
    with nothing. Rows of equal sets link, repeated rows too. An empty table gives an empty result. Other columns are not looked at.
    """
    join = Join(docs, k, least)
    join.run()
    return labelled(join, join.counted())


def jaccard_components(docs: DataFrame, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles and component_id as in jaccard_links, without the count of links."""
    join = Join(docs, k, least)
    join.run()
    return labelled(join)


def labelled(join: Join, links: DataFrame | None = None) -> DataFrame:
    """The rows with their components; with links (node, links), also their n_links."""
    named = join.classes.select("node", "a", "b", F.col("n").alias("n_class"), "label", "copies").join(join.components, "node")
    least = named.groupBy("component").agg(F.min("label").alias("component_id"))
    count = [] if links is None else ["n_links"]
    if links is not None:
        named = named.join(links, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("links", F.lit(0)))
    named = named.join(least, "component").select("a", "b", "n_class", "component_id", *count)
    rows = join.rows.select("doc_id", "n", "a", "b")
    full = rows.where("n > 0").join(named, ["a", "b"]).where("n = n_class").select("doc_id", F.col("n").alias("n_shingles"), "component_id", *count)
    bare = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), *[F.lit(0).cast("long").alias(c) for c in count])
    return full.unionByName(bare)


def representatives(docs: DataFrame, k: int = SHINGLE, least: int = LEAST) -> DataFrame:
    """The rows of docs that stay when each group of linked documents keeps one: its least doc_id (nulls last), ties to the least text hash.

    Rows without words stay; of rows that repeat a kept one, one stays. All columns are kept.
    """
    join = Join(docs, k, least)
    join.run()
    best = F.min(F.struct(F.col("label").isNull().alias("bare"), "label", "text_hash"))
    kept = join.classes.join(join.components, "node").groupBy("component").agg(best.alias("best")).select(F.col("best.label").alias("_label"), F.col("best.text_hash").alias("_hash"))
    bare = join.rows.where("n = 0").select(F.col("doc_id").alias("_label"), F.col("text_hash").alias("_hash")).distinct()
    hashed = F.xxhash64(docs["text"])
    kept = kept.unionByName(bare).distinct()
    out = docs.join(kept, docs["doc_id"].eqNullSafe(kept["_label"]) & (hashed == kept["_hash"]), "left_semi")
    if join._repeated():
        number = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(0)))
        out = out.withColumn("_nth", number).where((F.col("_nth") == 1) | (F.coalesce(F.regexp_count("text", F.lit(tx.WORD)), F.lit(0)) == 0)).drop("_nth")
    return out
