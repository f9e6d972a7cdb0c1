import numpy as np

from pavescope.llm.hilbert_ann import cheapest, hilbert_index, nearest

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def brute(rows, k=5, step=50):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = {}
    for i, q in good:
        if i % step == 0:
            best = {}
            for j, x in good:
                if j != i:
                    best[j] = max(best.get(j, -2), float(np.clip(np.einsum("j,ij->i", q, x[None])[0] / (np.sqrt(q @ q) * np.sqrt(x @ x)), -1, 1)))
            out[i] = sorted(((round(-s, 12), j) for j, s in best.items()))[:k]
    return out


def test_hilbert_is_a_curve():
    side = 1 << 3
    cells = np.stack(np.meshgrid(*[np.arange(side)] * 3, indexing="ij"), -1).reshape(-1, 3)
    order = np.argsort(hilbert_index(cells, 3))
    assert sorted(hilbert_index(cells, 3).tolist()) == list(range(side**3))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(1) == 1).all()


def test_cheapest_choice():
    assert cheapest(np.array([[0, 9, 9, 9]] * 10), 32, 0.95) == (2, 0)
    assert cheapest(np.array([[9, 9, 9, 1]] * 10), 32, 0.95) == (4, 1)
    assert cheapest(np.array([[9, 8, 9, 9]] * 10), 32, 0.95) == (2, 8)


def test_exact_with_goal_one(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(400)]
    rows += [(450, rows[7][1]), (451, rows[7][1]), (500, rows[100][1]), (600, None), (601, []), (602, [0.0] * 16), (603, [float("nan")] * 16), (604, [None] + [1.0] * 15), (None, rows[3][1]), (400, [float("inf")] * 16)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), goal=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(-r.score, 12), r.vec_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows)


def test_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], 1, 1), (3, [1.0, 1.0], 1, 1)], SCHEMA)
    assert [tuple(r)[:3] for r in nearest(df).collect()] == [(0, 1, 3)]
    assert nearest(df.limit(0)).count() == 0


def test_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((8, 32)) * 0.3
    same = rng.standard_normal(32).tolist()
    rows = [(i, same if i % 4 == 1 else (centres[i % 8] + rng.standard_normal(32)).tolist()) for i in range(3000)]
    want = brute(rows)
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = sum(len(got[q] & {j for _, j in best}) for q, best in want.items())
    assert hits >= 0.9 * 5 * len(want) and all(len(v) == 5 for v in got.values())


def test_repeated_ids_above_a_block(spark):
    """A vec_id repeated beside a query takes one place, in a table of some blocks as well."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.standard_normal(16).tolist()) for i in range(3000)]
    rows += [(7, (np.array(rows[0][1]) + 0.001 * j).tolist()) for j in range(6)]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), goal=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(-r.score, 12), r.vec_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows)


def test_repeated_ids_count_once(spark):
    """Rows that repeat a vec_id, equal or not, take one place among the neighbours."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(120)]
    near = [(200 + i, (np.array(rows[50][1]) + 0.01 * (i + 1)).tolist()) for i in range(3)]
    rows = [r for r in rows for _ in range(2)] + [r for r in near for _ in range(7)] + [(201, (np.array(rows[50][1]) * 2 + 0.001).tolist())]
    got = {}
    for r in nearest(spark.createDataFrame([(i, v, 1, 1) for i, v in rows], SCHEMA), goal=1.0).collect():
        got.setdefault(r.query_id, []).append((r.rank, round(-r.score, 12), r.vec_id))
    assert {q: [x[1:] for x in sorted(v)] for q, v in got.items()} == brute(rows)
