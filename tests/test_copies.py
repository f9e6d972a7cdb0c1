"""Steps over many rows of few places, of few values or of one key: the work grows with what differs, and results stay those of plain loops."""

import math
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from pavescope.operators import fusion, geo, polygons, sampling, study
from pavescope.plans import ORACLES, QUERIES

POINT = "id long, lat double, lon double"


@pytest.fixture
def met(monkeypatch):
    """Numbers of pairs that joins by cells gave, by call."""
    seen, plain = [], geo.pairs_within

    def counted(*args):
        out = plain(*args)
        seen.append(out.count())
        return out

    monkeypatch.setattr(geo, "pairs_within", counted)
    return seen


def _crowd(spark, lat, n=300):
    return spark.range(n).select(F.col("id"), F.lit(lat).alias("lat"), F.lit(-74.0).alias("lon"), (F.col("id") % 3).alias("w"))


def test_within_judges_places_once(spark, met):
    got = geo.within(_crowd(spark, 4.6), _crowd(spark, 4.601), 500.0, "w").collect()
    assert len(got) == 300 and {(r["n"], r["weight"]) for r in got} == {(300, 300)} and met == [1]


def test_nearest_judges_places_once(spark, met):
    got = geo.nearest(_crowd(spark, 4.6), _crowd(spark, 4.601).where("id > 6"), 500.0).collect()
    assert len(got) == 300 and {r["ref_id"] for r in got} == {7} and sum(met) == 1


def test_context_judges_places_once(spark, met):
    crowd = _crowd(spark, 4.601)
    got = geo.context(_crowd(spark, 4.6).drop("w"), crowd, crowd.withColumn("hospital", F.col("id") < 9), crowd.withColumn("anio", F.lit(2020)).withColumnRenamed("w", "peso")).collect()
    assert len(got) == 300 and {(r["colegio_300m"], r["ips_500m"], r["hospital_1000m"], r["siniestros_250m"], r["siniestros_pond_250m"]) for r in got} == {(300, 300, 9, 300, 300.0)}
    assert max(met) == 1


def test_placed_judges_places_and_rings_once(spark, monkeypatch):
    seen, plain = [], polygons.holding
    monkeypatch.setattr(polygons, "holding", lambda points, shapes, cell: (seen.append((points.count(), shapes.count())), plain(points, shapes, cell))[1])
    square = [[[[0.0, 0.0], [0.0, 1.0], [1.0, 1.0], [1.0, 0.0]]]]
    shapes = spark.createDataFrame([(k, *square) for k in range(5, 45)], "polygon long, rings array<array<array<double>>>")
    points = spark.range(300).select("id", F.lit(0.5).alias("lon"), F.lit(0.5).alias("lat"))
    got = polygons.placed(points, shapes, 0.2).collect()
    assert len(got) == 300 and {r["polygon"] for r in got} == {5} and seen == [(1, 1)]
    beside = polygons.placed(points.withColumn("lon", F.lit(1.0001)), shapes, 0.2, 60.0).collect()
    assert len(beside) == 300 and {r["polygon"] for r in beside} == {5}


def test_state_shares_of_many_rows(spark):
    """Terms of the series are added for a batch of rows at a time."""
    rows = spark.range(0, 60_000, 1, 1).select((F.col("id") % 100).cast("double").alias("s"))
    began = time.time()
    assert rows.select(*fusion.state_shares(F.col("s"), F.lit(7.0))).agg(F.sum("p_malo")).first()[0] > 0
    assert time.time() - began < 15


def test_replaced_draws(spark, monkeypatch):
    """As draws made one by one: as many as groups in every resample, over several blocks and lots."""
    monkeypatch.setattr(study, "BLOCK", 128)
    n, reps, values = 300, 60, [float((i * 37) % 101) for i in range(300)]
    groups = spark.createDataFrame([(5 * i, v) for i, v in enumerate(values)], "g long, v double").repartition(5)
    got = {r["rep"]: r for r in study.replaced_sums(groups, "g", ["v"], reps).collect()}
    for rep in range(reps):
        took = []
        for i in range(n):
            h = (i * 48_271 + rep * 69_621 + 12_345) % study.PRIME * 16_807 % study.PRIME
            took.append((h ^ (h >> 13)) * 39_373 % study.PRIME * 48_271 % study.PRIME % n)
        assert (got[rep]["times"], got[rep]["groups"]) == (n, len(set(took))) and got[rep]["v"] == pytest.approx(sum(values[i] for i in took))
    assert study.replaced_sums(groups.limit(0), "g", ["v"], reps).count() == 0


def test_replaced_draws_of_odd_values(spark, monkeypatch):
    """As SQL's sums and means: nulls are no zeros, a null key comes last, an infinity is that of the draws that hold it. Draws are dealt to tasks."""
    monkeypatch.setattr(study, "BLOCK", 16)
    monkeypatch.setattr(study, "DRAWS", 400)
    n, reps = 40, 60
    rows = [(i if i < n - 1 else None, None if i % 4 == 0 else math.inf if i == 21 else -math.inf if i == 22 else math.nan if i == 23 else float(i), None) for i in range(n)]
    groups = spark.createDataFrame(rows, "g long, v double, w double").repartition(3)
    sums = study.replaced_sums(groups, "g", ["v", "w"], reps)
    seen = set()
    for r in sums.collect():
        drawn = []
        for i in range(n):
            h = (i * 48_271 + r["rep"] * 69_621 + 12_345) % study.PRIME * 16_807 % study.PRIME
            drawn.append((h ^ (h >> 13)) * 39_373 % study.PRIME * 48_271 % study.PRIME % n)
        known = [rows[i][1] for i in drawn if rows[i][1] is not None]
        assert (r["times"], r["v_known"], r["w_known"], r["w"]) == (n, len(known), 0, None) and r["v"] == pytest.approx(sum(known), nan_ok=True)
        seen.add(str(r["v"]) if not math.isfinite(r["v"]) else "finite")
    assert seen == {"inf", "-inf", "nan", "finite"}


def test_boot_rows_of_odd_balances(spark, tmp_path):
    """ev_boot_rows is its SQL where balances or a key are null."""
    supplier = spark.range(60).select(F.when(F.col("id") > 0, F.col("id")).alias("s_suppkey"), F.when(F.col("id") % 3 > 0, F.col("id") * F.col("id") + 0.5).alias("s_acctbal"))
    empty = supplier.withColumn("s_acctbal", F.lit(None).cast("double"))
    for name, df in (("some", supplier), ("none", empty)):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}/supplier.parquet")
        with duckdb.connect() as con:
            con.sql(f"CREATE VIEW supplier AS SELECT * FROM '{tmp_path}/{name}/supplier.parquet/*.parquet'")
            [want] = con.sql(ORACLES["ev_boot_rows"]).fetchall()
        got = tuple(QUERIES["ev_boot_rows"](spark, f"{tmp_path}/{name}").first())
        assert (got == want == (None, None)) if name == "none" else got == pytest.approx(want, abs=1e-4)


def test_quantiles_of_many_keys_stay_in_tasks(spark, monkeypatch):
    """Totals go to every task only where keys are few; the quantiles are the same."""
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), (F.col("id") * 7 % 400).cast("double").alias("v"))
    few = sampling.quantiles(rows, "v", {"m": 0.5}, ["k"])
    monkeypatch.setattr(sampling, "FEW_KEYS", 39)
    many = sampling.quantiles(rows, "v", {"m": 0.5}, ["k"])
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) and many.count() == 40
    strategies = [df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") for df in (few, many)]
    assert strategies[0] == strategies[1] + 1
