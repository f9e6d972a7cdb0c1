import random
from collections import defaultdict
from itertools import combinations

import numpy as np

from pavescope.llm.packing import boundaries, pack


def test_boundaries_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        n = rng.integers(1, 8)
        lengths, counts = np.sort(rng.choice(np.arange(1, 60), n, replace=False)), rng.integers(1, 20, n)
        k = int(rng.integers(1, 5))
        cost = lambda tops: sum(int(c) * (min(t for t in tops if t >= l) - int(l)) for l, c in zip(lengths, counts))
        best = min(cost([*some, int(lengths[-1])]) for m in range(min(k, n)) for some in combinations(lengths[:-1].tolist(), m))
        got = boundaries(lengths, counts, lengths * counts, k)
        assert len(got) <= k and cost(got) == best


def test_pack(spark):
    rng = random.Random(2)
    data = [(i, "w " * int(rng.paretovariate(1) * 10), "x", 1) for i in range(800)] + [(900, None, "x", 1), (901, "  ", "x", 1), (902, "w " * 70_000, "x", 1), (3, "a b", "x", 1), (3, "a b", "x", 1), (None, "a", None, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string, rank string, batch int")
    out = pack(docs, buckets=6, budget=4096).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in out) == sorted((str(i), len((t or "").split())) for i, t, *_ in data)
    batches, tops = defaultdict(list), set()
    for r in out:
        assert (r.bucket is None) == (r.n_tokens == 0)
        if r.bucket is not None:
            assert r.padding == r.bucket_length - r.n_tokens >= 0
            batches[r.bucket, r.batch].append(r)
            tops.add(r.bucket_length)
    assert len(tops) <= 6
    full = defaultdict(int)
    for (b, _), rs in batches.items():
        assert len(rs) * rs[0].bucket_length <= 4096 or len(rs) == 1
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        full[b] += len(rs) < max(1, 4096 // rs[0].bucket_length)
    assert all(n <= 1 for n in full.values())
    assert pack(docs.limit(0)).count() == 0


def test_long_documents_have_exact_tops(spark):
    """Lengths over 2,048 are their own boundaries."""
    sizes = [2049] * 3 + [2051, 5000, 5003]
    docs = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.bucket_length, r.padding) for r in pack(docs).collect()}
    assert got == {i: (n, n, 0) for i, n in enumerate(sizes)}
    two = {r.doc_id: r.bucket_length for r in pack(docs, buckets=2).collect()}
    assert [two[i] for i in range(6)] == [2051] * 4 + [5003] * 2
