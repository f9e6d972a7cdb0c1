import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from pavescope.llm import hmm
from pavescope.llm import text as tx


def brute_counts(seqs, start, move, emit):
    """Plain forward-backward, unscaled: in long doubles, whose exponents hold some thousand tokens."""
    start, move, emit = (x.astype(np.longdouble) for x in (start, move, emit))
    s0, m0, e0, total = np.zeros_like(start), np.zeros_like(move), np.zeros_like(emit), 0.0
    for c in seqs:
        a = [start * emit[:, c[0]]]
        for x in c[1:]:
            a.append(a[-1] @ move * emit[:, x])
        b = [np.ones(len(start))]
        for x in c[:0:-1]:
            b.insert(0, move @ (emit[:, x] * b[0]))
        p = a[-1].sum()
        total += float(np.log(p))
        s0 += a[0] * b[0] / p
        for t, x in enumerate(c):
            e0[:, x] += a[t] * b[t] / p
            if t:
                m0 += np.outer(a[t - 1], emit[:, x] * b[t]) * move / p
    return s0, m0, e0, total


def random_model(rng, k=12):
    norm = lambda x: x / x.sum(-1, keepdims=True)
    return norm(rng.random(hmm.STATES)), norm(rng.random((hmm.STATES, hmm.STATES)) + 2 * np.eye(hmm.STATES)), norm(rng.random((hmm.STATES, k)))


def test_expected_counts():
    rng = np.random.default_rng(1)
    start, move, emit = random_model(rng)
    for sizes in ((1, 2, 30, 7, 50, 1, 50), (3, 1), (5,)):
        seqs = [rng.integers(0, 12, n) for n in sizes]
        bounds = np.r_[0, np.cumsum(sizes)]
        for x, y in zip(hmm.expected_counts(np.concatenate(seqs), bounds, start, move, emit), brute_counts(seqs, start, move, emit)):
            assert np.allclose(x, y)


def test_expected_counts_of_long_texts(monkeypatch):
    """Cuts into pieces change no count, neither of states nor of the transitions over the cuts."""
    rng = np.random.default_rng(4)
    start, move, emit = random_model(rng)
    seqs = [rng.integers(0, 12, n) for n in (128, 127, 300, 64, 65, 1, 257, 96)]
    bounds = np.r_[0, np.cumsum([len(s) for s in seqs])]
    want = brute_counts(seqs, start, move, emit)
    for head, link in ((64, 32), (1, 1), (100, 7)):
        monkeypatch.setattr(hmm, "HEAD", head)
        monkeypatch.setattr(hmm, "LINK", link)
        for x, y in zip(hmm.expected_counts(np.concatenate(seqs), bounds, start, move, emit), want):
            assert np.allclose(x, y)


def test_likelihood_of_long_texts():
    rng = np.random.default_rng(2)
    start, move, emit = random_model(rng)
    seqs = [rng.integers(0, 12, n) for n in (1, 2047, 2048, 2049, 4500, 3, 700)]
    bounds = np.r_[0, np.cumsum([len(s) for s in seqs])]
    want = []
    for c in seqs:
        v, total = start, 0.0
        for t, x in enumerate(c):
            v = (v if t == 0 else v @ move) * emit[:, x]
            total += math.log(v.sum())
            v = v / v.sum()
        want.append(total)
    assert np.allclose(hmm.log_likelihood(np.concatenate(seqs), bounds, hmm.Model(start, move, emit)), want)


def test_scores(spark):
    rng = random.Random(6)
    langs = [[f"{p}{i}" for i in range(300)] for p in ("a", "é", "B")]
    rows = [(i, " ".join(rng.choice(langs[i % 3]) for _ in range(rng.randrange(60))), "x", 1) for i in range(600)]
    rows += [(700, None, None, None), (701, "", None, None), (702, " \t", None, None), (703, "a1 " * 20_000, None, None), (None, "B1 b1", None, None), (5, rows[5][1], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, train int")
    got = hmm.language_scores(docs).collect()
    tokens = lambda t: [*(w.decode() for w in (t or "").encode().lower().split()), hmm.END]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t, *_ in rows if not out(i) for w in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    want = sorted((str(i), out(i), len(tokens(t)), sum(w in counts for w in tokens(t)), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens(t)), 3)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == want
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in got)
    assert hmm.language_scores(docs.limit(0)).count() == 0


def plain_scores(rows, rounds):
    """score of every row by plain loops: vocabulary, classes, Baum-Welch and the forward recursion over whole texts."""
    words = lambda t: [w for w in (t or "").encode().lower().split()]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(w for i, t in rows if not out(i) for w in words(t))
    ends = sum(not out(i) for i, _ in rows)
    number = lambda w: (int(hashed(w).view(np.int64)[0]), zlib.crc32(w))
    hashed = lambda w: next(tx.hashed_words(np.frombuffer(w, np.uint8), np.array([0, len(w)]))).hashes
    top = {w: k for k, w in enumerate(sorted(counts, key=lambda w: (-counts[w], *number(w)))[: hmm.TOP])}
    rest = lambda w: hmm.TOP + 1 + int(hmm.rest_class(pa.array([w], pa.binary()))[0])
    tokens, kinds = np.zeros(hmm.TOP + 1 + hmm.REST), np.zeros(hmm.TOP + 1 + hmm.REST)
    of = {w: top[w] if w in top else rest(w) for i, t in rows for w in words(t)}
    for w, n in counts.items():
        tokens[of[w]] += n
        kinds[of[w]] += 1
    tokens[hmm.TOP], kinds[hmm.TOP] = ends, 1
    seqs = [[*(of[w] for w in words(t)), hmm.TOP] for _, t in rows]
    start, move, emit = hmm._initial(tokens + hmm.MODEL_SMOOTH)
    for _ in range(rounds):
        s, m, e, _ = brute_counts([c for c, (i, _) in zip(seqs, rows) if not out(i)], start, move, emit)
        start, move, emit = (x / x.sum(-1, keepdims=True) for x in (s + 1, m + 1, e + hmm.MODEL_SMOOTH))
    scores = []
    for (_, t), c in zip(rows, seqs):
        v, total = start, 0.0
        for k, x in enumerate(c):
            v = (v if k == 0 else v @ move) * emit[:, x]
            total, v = total + math.log10(v.sum()), v / v.sum()
        inner = sum(math.log10((counts[w] + 0.1) / (tokens[of[w]] + 0.1 * (kinds[of[w]] + 1))) for w in words(t) if w not in top)
        scores.append(total + inner)
    return scores


def test_scores_against_plain_loops(spark, monkeypatch):
    rng = random.Random(12)
    rows = [(i, " ".join(rng.choice(["ab", "Cd", "é", "x1"]) + str(rng.randrange(700)) for _ in range(rng.randrange(40)))) for i in range(120)]
    rows += [(500, None), (501, " "), (None, "ab1 zz"), (7, rows[7][1])]
    got = hmm.language_scores(spark.createDataFrame(rows, "doc_id long, text string"), rounds=2).collect()
    want = plain_scores(rows, 2)
    key = lambda i, x: (str(i), round(x, 6))
    assert sorted(key(r.doc_id, r.score) for r in got) == sorted(key(i, x) for (i, _), x in zip(rows, want))


def test_probabilities_sum_to_one():
    """Of a class: its known words and one unseen word share it whole."""
    c = np.array([5.0, 1.0, 0.0, 2.0])
    known = c > 0
    share = (c + hmm.SMOOTH) / (c.sum() + hmm.SMOOTH * (known.sum() + 1))
    assert math.isclose(share[known].sum() + share[~known][0], 1.0)
    classes = hmm.rest_class(pa.array(["a", "zebra", "zz", "é", "longer-than-eight"]))
    assert ((0 <= classes) & (classes < hmm.REST)).all()


def test_training_raises_likelihood(spark):
    rng = np.random.default_rng(3)
    start, move, emit = random_model(rng)
    rows = [(bytearray(rng.integers(0, 12, 400).astype(np.uint16).tobytes()), bytearray(np.array([100, 200, 100], np.int32).tobytes())) for _ in range(6)]
    encoded = spark.createDataFrame(rows, "classes binary, sizes binary")
    seen = hmm.train(encoded, np.ones(12), rounds=4)[3]
    assert all(b > a - 1e-6 for a, b in zip(seen, seen[1:]))
