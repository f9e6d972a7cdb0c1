import random

import numpy as np
import pytest

from pavescope.llm import jaccard_join
from pavescope.llm.jaccard_join import jaccard_components, jaccard_links

SCHEMA = "doc_id long, text string, n int, component_id string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 3 else [tuple(w[i : i + 3]) for i in range(len(w) - 2)])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 90 * len(x | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted([(str(d), len(sets[i]), str(least.get(root(i)))) for i, (d, _) in enumerate(rows)])


def corpus(seed, groups, size, edits):
    rng = random.Random(seed)
    word = lambda: rng.choice("ABcdé") + str(rng.randrange(4000))
    passage, rows = [word() for _ in range(30)], []
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(1, size))]
        if rng.random() < 0.5:
            base += passage
        for _ in range(rng.choice([1, 1, 2, 5, 40])):
            words = list(base)
            for _ in range(rng.randrange(edits)):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [word()]
            rows.append(" ".join(words))
    rng.shuffle(rows)
    return [(i * 2, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed,small", [(1, 48), (2, 4)])
def test_against_brute_force(spark, seed, small, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", small)
    rows = corpus(seed, 25, 150, 4)
    rows += [(5000, None), (5001, ""), (5002, "A b"), (5003, "a B"), (5004, "a"), (5005, " "), (None, rows[0][1]), (None, "only null here twice"), (None, "only null here twice"), (8, rows[3][1]), (8, "own text here"), (9001, "long " + " ".join(map(str, range(40_000)))), (9002, " ".join(map(str, range(40_000))))]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == brute(rows)


def test_large_region(spark):
    """One group of near copies, most of which are farther than a link from each other."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.randrange(1, 5)):
            words[rng.randrange(120)] = f"v{rng.randrange(3)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_components(docs).collect())
    assert got == brute(rows)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d", 1, "x")], SCHEMA)
    assert jaccard_components(docs.limit(0)).count() == 0
    assert [tuple(r) for r in jaccard_components(docs).collect()] == [(1, 2, 1)]


@pytest.mark.parametrize("tile", [2048, 7])
def test_all_links_are_counted(spark, tile, monkeypatch):
    """Also those between texts that a third one connects, and those of repeated rows."""
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", tile)
    monkeypatch.setattr(jaccard_join, "TILE_ITEMS", 50)
    rows = corpus(4, 8, 150, 2)
    rows += [(5000, None), (5001, ""), (None, rows[0][1]), (8, rows[3][1]), (8, rows[3][1]), (9000, "on its own")]
    sets = [shingle_set(t) for _, t in rows]
    want = [sum(i != j and bool(x and y) and 100 * len(x & y) >= 90 * len(x | y) for j, y in enumerate(sets)) for i, x in enumerate(sets)]
    got = sorted((str(r.doc_id), r.n_shingles, r.n_links) for r in jaccard_links(spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)).collect())
    assert got == sorted((str(d), len(sets[i]), want[i]) for i, (d, _) in enumerate(rows)) and max(want) > 10


def test_rarity_fits_a_byte():
    counts = np.array([0, 1, 2, 3, 10, 1_000, 1 << 40, 1 << 62], np.int64)
    kept = jaccard_join._rarity(counts)
    assert kept.dtype == np.uint8 and kept[0] == 0
    assert (np.diff(kept.astype(int)) >= 0).all() and len(set(kept.tolist())) >= 7


def test_documents_read_twice_count_once(spark, monkeypatch):
    """With few mark bits documents of an earlier read are met again; links stay those of brute force."""
    monkeypatch.setattr(jaccard_join.sketch, "MARK_BITS", 12)
    monkeypatch.setattr(jaccard_join, "SMALL", 4)
    rng = random.Random(12)
    texts = []
    for g in range(60):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(rng.choice([1, 2, 6, 14])):
            words = list(base)
            words[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(words))
    texts += [f"lone{i} " + " ".join(f"u{i}v{j}" for j in range(12)) for i in range(2500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingle_set(t) for t in texts]
    got = {r["doc_id"]: r["n_links"] for r in jaccard_links(docs).collect()}
    many = [i for i, t in enumerate(texts) if not t.startswith("lone")]
    for i in many:
        assert got[i] == sum(100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]) for j in many if j != i), i
    assert all(n == 0 for i, n in got.items() if i >= len(many))
