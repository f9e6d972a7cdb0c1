import hashlib
import random

from pavescope.llm.substring_dedup import substring_dedup

SCHEMA = "doc_id long, text string, seed int, shard string"


def brute(rows, window=20):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")):
        words = (text or "").encode().split()
        gone = set()
        for a in range(len(words) - window + 1):
            key = tuple(words[a : a + window])
            if key in seen:
                gone |= set(range(a, a + window))
            seen.add(key)
        kept = [w for j, w in enumerate(words) if j not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def fixture():
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefgh") + rng.choice(["", "é", "zz"]) + str(rng.randrange(40))
    passages = [[word() for _ in range(rng.randrange(15, 60))] for _ in range(6)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rng.randrange(0, 8)):
            words += rng.choice(passages) if rng.random() < 0.4 else [word() for _ in range(rng.randrange(1, 40))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t \x0b", "  "]).join(words)))
    rows += [(400, rows[5][1]), (401, rows[5][1]), (401, rows[6][1]), (401, rows[5][1]), (402, None), (403, ""), (404, " \n "), (None, rows[7][1]), (405, "same " * 200), (406, " ".join(word() for _ in range(30_000)))]
    return rows


def test_against_brute_force(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    got = sorted([tuple(r) for r in substring_dedup(docs, with_text=False).collect()], key=str)
    assert got == brute(rows)


def test_text_and_empty(spark):
    rows = fixture()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA)
    out = substring_dedup(docs).collect()
    texts = {t for _, t in rows}
    for r in out:
        assert hashlib.sha256(b" ".join((r.kept_text or "").encode().split())).hexdigest() == r.kept_sha256
        assert r.n_removed or r.kept_text in texts
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
    assert substring_dedup(docs.limit(0)).count() == 0
