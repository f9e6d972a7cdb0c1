"""Quality in long form: blocks of the query, correlations with ties, repeats, reviewed presence."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pavescope.operators import quality
from pavescope.plans import QUERIES

BLOCKS = {"calidad_imagen", "confianza_modelo", "deriva", "correlacion_sensor", "calibracion_idu", "repetibilidad", "validacion_visual"}


def ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def test_all_blocks(spark, sf):
    """All seven blocks of the method, in one row a metric."""
    rows = QUERIES["fld_quality_long"](spark, sf).cache()
    assert {r["block"] for r in rows.select("block").distinct().collect()} == BLOCKS
    assert rows.where("metric = 'dominio_auroc' AND level = 'lote' AND value BETWEEN 0 AND 1").count() == 1
    assert rows.where("level = 'tramo' AND id = 'LOTE' AND metric LIKE 'spearman_%' AND low < high").count() >= 5  # on few stretches a side may have two values
    assert rows.count() == rows.select("level", "id", "block", "metric").distinct().count()


def test_correlations(spark):
    """Average ranks by key; constant sides are null, keys with too few pairs go."""
    rng = np.random.default_rng(1)
    rows = [("p", float(a), float(a * b)) for a, b in zip(rng.integers(0, 5, 60), rng.normal(size=60))] + [("p", None, 1.0)] + [("flat", 1.0, float(i)) for i in range(5)] + [("few", 1.0, 2.0)] * 3
    got = {r["k"]: r for r in quality.correlations(spark.createDataFrame(rows, "k string, a double, b double").repartition(5), "k", 4).collect()}
    a, b = np.array([r[1:] for r in rows[:60]]).T
    assert set(got) == {"p", "flat"} and got["p"]["n"] == 60 and got["flat"]["spearman"] is None and got["flat"]["pearson"] is None
    assert got["p"]["spearman"] == pytest.approx(np.corrcoef(ranks(a), ranks(b))[0, 1]) and got["p"]["pearson"] == pytest.approx(np.corrcoef(a, b)[0, 1])


@pytest.mark.parametrize("block", [7, 64, 1 << 16])
def test_rank_intervals(spark, monkeypatch, block):
    """As resamples drawn and ranked one by one, with ties across blocks; in one block and in many."""
    monkeypatch.setattr(quality.study, "BLOCK", block)
    rng = np.random.default_rng(2)
    rows = [("p", float(round(a, 1)), float(b)) for a, b in zip(rng.normal(size=90), rng.integers(0, 4, 90))] + [("q", float(a), float(a // 3)) for a in rng.integers(0, 9, 90)] + [("r", float(i), float(i % 3)) for i in range(20)] + [("flat", float(i), 1.0) for i in range(20)]
    want, p = {}, quality.study.PRIME
    for k in ("p", "q", "r"):
        a, b = np.array(sorted(r[1:] for r in rows if r[0] == k)).T
        i, rho = np.arange(len(a)), []
        for rep in range(60):
            h = (i * 48271 + rep * 69621 + 12345) % p * 16807 % p
            at = ((h ^ (h >> 13)) * 39373 % p) * 48271 % p % len(a)
            if len(set(a[at])) > 2 and len(set(b[at])) > 2:
                rho.append(np.corrcoef(ranks(a[at]), ranks(b[at]))[0, 1])
        want[k] = np.quantile(rho, [0.025, 0.975])
    got = {r["k"]: (r["low"], r["high"]) for r in quality.rank_intervals(spark.createDataFrame(rows, "k string, a double, b double").repartition(5), "k", 60).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


@pytest.mark.parametrize("block", [8, 1 << 16])
def test_whole_resamples_as_by_blocks(spark, monkeypatch, block):
    """Resamples made whole in a task shuffle no draws and end where those dealt to blocks do, with one long value of a, negatives and as many cells as pairs."""
    monkeypatch.setattr(quality.study, "BLOCK", block)
    rng = np.random.default_rng(3)
    rows = [("long", float(max(i, 40)), float(i % 7)) for i in range(80)] + [("fine", float(a), float(round(a))) for a in rng.normal(size=80)] + [("other", float(a), float(b)) for a, b in rng.integers(-3, 3, (61, 2))]
    pairs, dealt, plain = spark.createDataFrame(rows, "k string, a double, b double").repartition(5), [], quality._draws
    monkeypatch.setattr(quality, "_draws", lambda *args: (dealt.append(args[0]), plain(*args))[1])
    found = lambda: {r["k"]: (r["low"], r["high"]) for r in quality.rank_intervals(pairs, "k", 70).collect()}
    whole = found()
    assert not dealt and set(whole) == {"long", "fine", "other"}
    monkeypatch.setattr(quality, "WHOLE", 70)  # some whole, some by blocks
    mixed = found()
    assert dealt == [80] and all(mixed[k] == pytest.approx(whole[k]) for k in whole)


def test_places_are_those_drawn(spark):
    for start, rep, n in ((0, 0, 7), (77_777, 1, 1), (2**25 - 9, 1999, 2**25)):
        i = np.arange(start, start + 9)
        want = [r[0] for r in spark.createDataFrame([(k, int(v)) for k, v in enumerate(i)], "k int, i long").orderBy("k").select(quality.study.drawn(F.col("i"), F.lit(rep).cast("long"), F.lit(n).cast("long"))).collect()]
        assert quality._places(start, 9, rep, n).tolist() == want


def test_repeats_and_presence(spark):
    rows = spark.createDataFrame([(1, 5.0, None, "a"), (1, 8.0, 2.0, "a"), (2, 1.0, 1.0, "a"), (2, 4.0, 3.0, "b"), (3, 1.0, 1.0, "a"), (None, 0.0, 0.0, "a")], "site long, s double, d double, label string")
    got = {(r["id"], r["metric"]): (r["value"], r["n"]) for r in quality.repeats(rows, ["s", "d"], {"agree": "label"}).collect()}
    assert got == {("1", "s_desv_est"): (pytest.approx(4.5**0.5), 2), ("1", "s_rango"): (3.0, 2), ("1", "agree"): (1.0, 2), ("2", "s_desv_est"): (pytest.approx(4.5**0.5), 2), ("2", "s_rango"): (3.0, 2), ("2", "d_desv_est"): (pytest.approx(2**0.5), 2), ("2", "d_rango"): (2.0, 2), ("2", "agree"): (0.0, 2)}
    photos = spark.createDataFrame([(1, 1), (1, 0), (0, 1), (1, 1), (0, 0)], "a int, b int")
    r = quality.presence(photos, {"x": (F.col("a") > 0, F.col("b") > 0), "none": (F.col("a") > 5, F.col("b") > 5)}).first()
    assert (r["n"], r["precision_x"], r["recall_x"], r["precision_none"]) == (5, pytest.approx(2 / 3), pytest.approx(2 / 3), 0)
