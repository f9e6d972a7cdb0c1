import random
from collections import Counter

from pavescope.llm import mixing
from pavescope.llm.mixing import mix, plan, targets

SCHEMA = "doc_id long, text string, source string, size int, src string"


def rows():
    rng = random.Random(3)
    out = []
    for i in range(1500):
        s = rng.choice(["a"] * 20 + ["b", "b", "b", "B", "é", None])
        out.append((i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60))), s, 1, "x"))
    return out + [(5000, None, "a", 1, "x"), (5001, "", "z", 1, "x"), (7, "one two", "a", 1, "x"), (7, "one two", "a", 1, "x"), (None, "w " * 5000, "b", 1, "x"), (None, None, None, None, None)]


def test_targets():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 1000]) == [30.0, 1980 * 2 / 3, 1980 / 3]
    assert targets([]) == [] and targets([0, 5]) == [0.0, 5.0]


def test_mix(spark):
    data = rows()
    docs = spark.createDataFrame(data, SCHEMA)
    out = mix(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in out) == Counter((i, len((t or "").encode().split())) for i, t, *_ in data)
    by = {}
    for r in out:
        assert 0 <= r.taken <= 3 * r["size"] and r.taken == sum(r.passes)
        x = by.setdefault((r.source_size, r.target), [0, 0])
        x[0] += r.taken
        x[1] += r["size"]
    total = sum(s for s, _ in by)
    for (size, target), (taken, own) in by.items():
        assert own == size and abs(taken - target) <= 0.002 * total + 3
    again = mix(docs.repartition(5)).collect()
    assert Counter(map(str, again)) == Counter(map(str, out))
    assert mix(docs.limit(0)).count() == 0


def test_schedule_is_even(spark):
    """Any stretch of the schedule holds each source in proportion to its target."""
    m = plan(spark.createDataFrame(rows(), SCHEMA))
    slots = [r.src for r in m.slots.orderBy("slot").collect()]
    total = sum(s for _, s, _ in m.sources)
    for a in range(0, len(slots) - 2000, 1000):
        seen = Counter(slots[a : a + 2000])
        for i, (_, _, target) in enumerate(m.sources):
            assert abs(seen[i] - 2000 * target / total) <= 14


def test_targets_are_met_with_large_blocks(spark, monkeypatch):
    """Sources smaller than a block of the whole corpus, too, play their targets to the word."""
    monkeypatch.setattr(mixing, "SLOTS", 16)
    data = [(i, "w " * (1 + i % 90), "hot", 1, "x") for i in range(900)] + [(1000 + i, "w " * (7 * i + 1), f"s{i % 4}", 1, "x") for i in range(24)] + [(2000, "one", "t", 1, "x")]
    docs = spark.createDataFrame(data, SCHEMA)
    m = plan(docs)
    assert max(m.block) > 1 and sum(s for _, s, _ in m.sources) // 16 > min(s for _, s, _ in m.sources if s > 1)
    by = {}
    for r in mix(docs).collect():
        assert all(0 <= p <= r["size"] for p in r.passes) and r.taken == sum(r.passes)
        by[r.source_size, r.target] = by.get((r.source_size, r.target), 0) + r.taken
    assert by == {(s, t): round(t) for _, s, t in m.sources}


def test_schedule_is_planned_once(spark):
    """The rows that took nothing are found from the taken ones as written, not by another run of the schedule."""
    docs = spark.createDataFrame([(i, "a b c", "xy"[i % 2]) for i in range(20)], "doc_id long, text string, source string")
    assert "Window" not in mixing.mix(docs)._jdf.queryExecution().optimizedPlan().toString()
