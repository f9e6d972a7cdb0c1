import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from pavescope.llm import importance as im


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def features(text, lengths, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, lengths + 1) for i in range(len(w) - n + 1)]


def brute(docs, items, lengths=1, buckets=im.BUCKETS, share=10):
    s, t = Counter(f for _, x in docs for f in features(x, lengths, buckets)), Counter(f for _, x in items for f in features(x, lengths, buckets))
    source, target = sum(s.values()), sum(t.values())
    gain = {f: math.floor(1000 * math.log(((t[f] + 1) * (source + buckets)) / ((s[f] + 1) * (target + buckets)))) for f in s}
    rows = []
    for doc, x in docs:
        f = features(x, lengths, buckets)
        weight = sum(gain[k] for k in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append((doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x)) >= 20))
    best = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))[: share * sum(r[4] for r in rows) // 100]
    ranks = {}
    for k, r in enumerate(best):
        ranks.setdefault(r, []).append(k + 1)
    return sorted(((*r[:4], ranks[r].pop() if ranks.get(r) else None) for r in rows), key=str)


LONG = "the cat sat on the mat and the dog sat by the door of a house in the old town square again"
DOCS = [(i, f"{LONG} {i % 7} naïve É" + " the" * i) for i in range(60)] + [(5, LONG + " 5 x"), (5, LONG + " 5 x"), (None, LONG), (None, None), (99, ""), (98, "..,,"), (97, "zu Weit " * 20_000), (96, "a\x00b\x7fc~d\n é-É"), (95, "word")]
ITEMS = [(1, "the mat and the door " * 3), (1, "Town Square"), (None, None), (2, "")]


@pytest.mark.parametrize("lengths", [1, 3])
def test_brute_force(spark, lengths):
    docs = spark.createDataFrame([(d, t, True, 0) for d, t in DOCS], "doc_id long, text string, target boolean, block int").repartition(5)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, word string")
    got = sorted((tuple(r) for r in im.importance(docs, items, lengths, share=50).collect()), key=str)
    assert got == brute(DOCS, ITEMS, lengths, share=50)


def test_small_blocks_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(im, "BLOCK_BYTES", 300)
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted((tuple(r) for r in im.importance(docs, items, 2).collect()), key=str) == brute(DOCS, ITEMS, 2)


def test_oracle_on_ties_and_nulls():
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(con.sql(im.ORACLE).fetchall(), key=str) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS[:3], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert im.importance(docs.limit(0), items).count() == 0
    assert sorted((tuple(r) for r in im.importance(docs, items.limit(0)).collect()), key=str) == brute(DOCS[:3], [])
