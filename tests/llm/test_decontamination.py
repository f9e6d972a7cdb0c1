import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from pavescope.llm import decontamination as dc

TABLES = ("documents", "benchmark")
LINE = " ".join(f"w{i}" for i in range(14))


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, size=10):
    out = []
    listed = [("" if i is None else str(i), words(t)) for i, t in items]
    for doc, text in docs:
        own, hit, names = words(text), set(), set()
        for name, w in listed:
            n = min(size, len(w))
            for k in range(len(w) - n + 1 if n else 0):
                for at in range(len(own) - n + 1):
                    if own[at : at + n] == w[k : k + n]:
                        hit.update(range(at, at + n))
                        names.add(name)
        out.append((doc, len(own), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


DOCS = [
    (1, LINE), (1, LINE), (2, "x " + LINE.upper() + " y"), (3, LINE.replace(" ", "\n--")), (4, None), (5, ""), (6, "..."), (None, LINE[:28]), (7, " ".join(["a"] * 40)), (8, "solo"), (9, "Été à côté"),
    (10, ("lorem " * 3000) + LINE + (" ipsum" * 3000) + " " + LINE), (11, "w0 w1 w2 w3 w4 w5 w6 w7 w8 W9"), (12, "w1 w2 w3 w4 w5 w6 w7 w8 w9 x"), (13, "pre" + LINE), (14, "q0 q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"),
]
ITEMS = [(1, LINE), (2, LINE), (2, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11"), (10, " ".join(["a"] * 12)), (3, "solo"), (None, "été À côté"), (4, None), (5, "  "), (6, "w3 w4"), (7, "no such words here at all in any of the documents")]


@pytest.mark.parametrize("each", [dc.WINDOWS_EACH, 3])
def test_brute_force(spark, each):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, classes string, class int")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, win int")
    got = sorted((tuple(r) for r in dc.decontamination(docs, items, each=each).collect()), key=str)
    assert got == brute(DOCS, ITEMS)


def test_oracle_on_ties_and_nulls(spark):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(DOCS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    con.register("benchmark", pd.DataFrame(ITEMS, columns=["item_id", "text"]).astype({"item_id": "Int64"}))
    assert sorted(con.sql(dc.ORACLE).fetchall(), key=str) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, LINE)], "doc_id long, text string")
    items = spark.createDataFrame([(1, LINE)], "item_id long, text string")
    assert dc.decontamination(docs.limit(0), items).count() == 0
    assert [tuple(r)[1:4] for r in dc.decontamination(docs, items.limit(0)).collect()] == [(14, 0, 0)]


def test_shifts_skip_and_lose_nothing():
    rng = np.random.default_rng(3)
    for length in (1, 2, 3, 10):
        rows = np.unique(rng.integers(1, 6, (40, length)).astype(np.int32), axis=0)
        words_, bounds = rng.integers(0, 7, 5000).astype(np.int32), np.array([0, 0, 7, 2500, 2500, 5000])
        words_[100 : 100 + length] = rows[0]
        search = dc.WuManber(rows)
        got = sorted(zip(*(x.tolist() for x in search.search(words_, bounds))))
        want = sorted((k, at + length - 1) for a, b in zip(bounds[:-1], bounds[1:]) for at in range(a, b - length + 1) for k in range(len(rows)) if (words_[at : at + length] == rows[k]).all())
        assert got == want and want
    far = dc.WuManber(np.full((1, 10), 9, np.int32))
    assert len(far.places(np.zeros(9000, np.int32), np.array([0, 9000]))) == 0
    assert far.shift.max() == 9
