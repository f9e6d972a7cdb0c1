import random
import zlib

import numpy as np
import pyarrow as pa

from pavescope.llm import boosting
from pavescope.llm.toxicity import FEATURES, Lexicon, _hashes, features, toxicity

SCHEMA = "doc_id long, text string, score string, toxic int"


def corpus(n=2500):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice(["ta", "re", "mi", "no", "lu", "se", "ka"]) for _ in range(rng.randrange(1, 5)))
    bad = ["idiot", "vexo", "m0ron", "grulo"]
    rows, labels = [], []
    for i in range(n):
        words, toxic = [word() for _ in range(rng.randrange(3, 150))], rng.random() < 0.25
        if toxic:
            stem = rng.choice(bad)
            words.insert(rng.randrange(len(words)), stem + (word() if stem in ("vexo", "grulo") else ""))
        rows.append((i, " ".join(words), "x", 1))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out(spark):
    rows, labels = corpus()
    extra = [(9001, None, None, None), (9002, "", None, None), (9003, "w " * 60_000, None, None), (None, "idiot", None, None), (9003, "w", None, None)]
    docs = spark.createDataFrame(rows + extra, SCHEMA)
    known = spark.createDataFrame([*labels, (1, None), (2, 7), (None, 1), (5, labels[5][1])], "doc_id long, toxic int")
    out = toxicity(docs, known).collect()
    assert len(out) == len(rows) + len(extra)
    truth, right, n = dict(labels), 0, 0
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        if r.held_out and r.doc_id in truth:
            n, right = n + 1, right + (r.predicted == truth[r.doc_id])
    assert n > 500 and right / n > 0.95
    flipped = [(i, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, t in labels]
    other = toxicity(docs, spark.createDataFrame(flipped, "doc_id long, toxic int")).collect()
    assert sorted(map(str, other)) == sorted(map(str, toxicity(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()))


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "idiot", "x", 1)], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity(docs, labels).collect()] == [(1, False, 0.0, 0)]
    assert toxicity(docs.limit(0), labels).count() == 0


def test_features():
    lexicon = Lexicon(_hashes(["idiot"]), _hashes(["you"]), _hashes([]), {4: _hashes([]), 5: _hashes([]), 6: _hashes([])})
    x = features(pa.array(["You 1di0t!", "an IDIOT", None, "idiots you", "a b c d e f idiot"]), lexicon)
    marked, near, spelled = (FEATURES.index(f) for f in ("marked", "near_you", "spelled"))
    assert x[:, marked].tolist() == [1, 1, 0, 0, 1] and x[:, near].tolist() == [1, 0, 0, 0, 0] and x[:, spelled].tolist() == [1, 0, 0, 0, 0]
    assert np.isfinite(x).all()


def test_boosting_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = boosting.fit(x[:2000], y[:2000])
    assert ((model.margin(x[2000:]) > 0) == y[2000:]).mean() > 0.97
    at, value = boosting.isotonic(np.array([1.0, 2, 3, 3, 4]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all()
