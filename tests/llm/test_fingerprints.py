import hashlib
import random

import pytest

from pavescope.llm.fingerprints import document_fingerprints


def brute(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, x = t or "", rows[(k + 1) % len(rows)][1] or ""
        h = len(t) // 2
        e = t[: len(t) - h] + x[:h]
        out.append((str(i), len(t), hashlib.sha256(e.encode()).hexdigest(), t, e))
    return sorted(out)


@pytest.mark.parametrize("ids", ["plain", "odd", "null"])
def test_edited_and_equal(spark, ids):
    rng = random.Random(4)
    vocab = ["w" + str(i) + rng.choice(["é", "𝄞", "", "ß"]) for i in range(6000)]
    rows = [(i * 7 + (1 << 55), " ".join(rng.choice(vocab) for _ in range(rng.randrange(400)))) for i in range(300)]
    rows += [(8, rows[3][1]), (9, rows[3][1].upper()), (10, None), (11, ""), (12, " ".join(vocab * 5))]
    if ids == "odd":
        rows += [(12, "a b"), (12, "a b"), (None, "tail one"), (None, None)]
    if ids == "null":
        rows = [(None, t) for _, t in rows[:40]]
    docs = spark.createDataFrame([(i, t, "f", 1) for i, t in rows], "doc_id long, text string, fingerprint string, part int")
    got = document_fingerprints(docs).collect()
    want = brute(rows)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == [w[:3] for w in want]
    prints = {}
    texts = {(w[0], w[2]): w for w in want}
    for r in got:
        _, _, _, text, edited = texts[str(r.doc_id), r.edited_sha256]
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        assert prints.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    if ids == "plain":
        assert sum(r.near_edited for r in got) > 3 * sum(r.near_next for r in got)
        assert len({r.fingerprint for r in got}) > 290


def test_small(spark):
    docs = spark.createDataFrame([(1, "ab cd")], "doc_id long, text string")
    (r,) = document_fingerprints(docs).collect()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
    assert document_fingerprints(docs.limit(0)).count() == 0
