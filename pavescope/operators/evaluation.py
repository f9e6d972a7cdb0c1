"""Evaluation of predictions and drift, by one or two aggregates each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import config as c
from . import sampling

#: A stability index needs so many values on either side.
LEAST_ROWS = 20


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks with ties averaged, from counts of distinct values."""
    counts = df.groupBy(value).agg(F.count(F.lit(1)).alias("_k"))
    counts = sampling.running(counts, [value], "_k", "_before")
    return df.join(counts.select(value, (F.col("_before") + (F.col("_k") + 1) / 2).alias(name)), value)


def finite(*names: str) -> Column:
    """Whether columns are all numbers: not null, not NaN, not infinite."""
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() & ~F.isnan(F.col(k).cast("double")) & (F.abs(F.col(k).cast("double")) != float("inf")) for k in names])


def regression(df: DataFrame) -> DataFrame:
    """mae, rmse, r2, pearson, spearman and bias of p against y over finite pairs.

    r2 is null for a constant y, the correlations for a constant side or fewer than three pairs; without pairs all but n are null.
    """
    pairs = average_ranks(average_ranks(df.where(finite("y", "p")), "y", "ry"), "p", "rp")
    e = F.col("p") - F.col("y")
    r2 = 1 - F.try_divide(F.sum(e * e), F.var_pop("y") * F.count("y"))
    corr = lambda a, b: F.when((F.count("y") > 2) & (F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), F.corr(a, b))
    return pairs.agg(F.count("y").alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), corr("y", "p").alias("pearson"), corr("ry", "rp").alias("spearman"), F.avg(e).alias("bias"))


def confusion(df: DataFrame) -> DataFrame:
    """All 25 cells of true against predicted states, zeros too."""
    names = [s for s, _ in c.STATES]
    spine = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("truth")).select("truth", F.explode(F.array(*map(F.lit, names))).alias("predicted"))
    return spine.join(df.groupBy("truth", "predicted").agg(F.count(F.lit(1)).alias("n")), ["truth", "predicted"], "left").fillna(0, ["n"])


def ordinal(cells: DataFrame) -> DataFrame:
    """From confusion cells: accuracy, share within one level, macro F1 over the five levels, quadratic kappa, balanced accuracy
    over the true levels that occur, and recall and precision of the two worst levels. Null where a divisor is zero.
    """
    level = lambda k: F.array_position(F.array(*[F.lit(s) for s, _ in c.STATES]), F.col(k)) - 1
    x = cells.withColumn("i", level("truth")).withColumn("j", level("predicted"))
    row, column, every = Window.partitionBy("i"), Window.partitionBy("j"), Window.partitionBy()
    x = x.withColumn("ni", F.sum("n").over(row)).withColumn("nj", F.sum("n").over(column)).withColumn("all", F.sum("n").over(every)).withColumn("d2", F.pow(F.col("i") - F.col("j"), 2))
    f1 = F.when(F.col("i") == F.col("j"), F.coalesce(F.try_divide(2.0 * F.col("n"), F.col("ni") + F.col("nj")), F.lit(0.0)))
    count = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    share = lambda cond: F.try_divide(count(cond), F.max("all"))
    truly, said = F.col("i") >= 3, F.col("j") >= 3
    recall = F.avg(F.when(F.col("i") == F.col("j"), F.try_divide(F.col("n"), F.col("ni"))))
    expected = F.sum(F.try_divide(F.col("d2") * F.col("ni") * F.col("nj"), F.col("all")))
    return x.agg(share(F.col("d2") == 0).alias("accuracy"), share(F.col("d2") <= 1).alias("within_one"), F.avg(f1).alias("macro_f1"), (1 - F.try_divide(F.sum(F.col("d2") * F.col("n")), expected)).alias("kappa"),
                 recall.alias("balanced"), F.try_divide(count(truly & said), count(truly)).alias("recall_bad"), F.try_divide(count(truly & said), count(said)).alias("precision_bad"))


def per_level(cells: DataFrame) -> DataFrame:
    """precision, recall, f1 and support of each of the five levels; 0 where a divisor is zero."""
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)
    of = lambda k: cells.groupBy(F.col(k).alias("level")).agg(F.sum("n").alias(k), F.sum(hit).alias("hits"))
    both = of("truth").join(of("predicted").drop("hits"), "level")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return both.select("level", ratio(F.col("hits"), F.col("predicted")).alias("precision"), ratio(F.col("hits"), F.col("truth")).alias("recall"), ratio(2 * F.col("hits"), F.col("truth") + F.col("predicted")).alias("f1"), F.col("truth").alias("support"))


def calibration_error(df: DataFrame, bins: int = 10) -> DataFrame:
    """Expected calibration error over bins (lo, hi]; confidences of 0 are left out."""
    b = F.ceil(F.round(F.col("conf") * bins, 9))
    binned = df.where("conf > 0").withColumn("bin", F.least(F.greatest(b, F.lit(1)), F.lit(bins))).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg(F.col("hit").cast("double")).alias("hit"))
    return binned.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("hit"))), F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def presence(df: DataFrame, tau: float) -> DataFrame:
    """AUROC with averaged ties, average precision over distinct scores, and precision, recall and F1 at tau.

    Without positives or without negatives AUROC is null, without positives average precision too; recall and F1 are then 0.
    """
    steps = df.groupBy("score").agg(F.sum("truth").alias("p"), F.count(F.lit(1)).alias("k"), F.struct(F.sum("truth").alias("p"), F.count(F.lit(1)).alias("k")).alias("pk")).withColumn("down", -F.col("score"))
    steps = sampling.running(sampling.running(steps, ["down"], "p", "tp"), ["down"], "k", "hits").withColumn("tp", F.col("tp") + F.col("p")).withColumn("hits", F.col("hits") + F.col("k"))
    steps = steps.crossJoin(F.broadcast(steps.agg(F.sum("p").alias("pos"), F.sum("k").alias("all"))))  # one row
    neg_above = (F.col("hits") - F.col("tp")) - (F.col("k") - F.col("p"))
    auc = 1 - F.try_divide(F.sum(F.col("p") * (neg_above + (F.col("k") - F.col("p")) / 2)), F.max("pos") * (F.max("all") - F.max("pos")))
    over = F.col("score") >= tau
    tp, hits = F.sum(F.when(over, F.col("p")).otherwise(0)), F.sum(F.when(over, F.col("k")).otherwise(0))
    return steps.agg(auc.alias("auroc"), F.try_divide(F.sum(F.col("p") * F.col("tp") / F.col("hits")), F.max("pos")).alias("average_precision"), (tp / F.greatest(hits, F.lit(1))).alias("precision"), (tp / F.greatest(F.max("pos"), F.lit(1))).alias("recall"), F.coalesce(F.try_divide(2 * tp, hits + F.max("pos")), F.lit(0.0)).alias("f1"))


def stability_index(reference: DataFrame, current: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """Population stability index over the reference's deciles, of finite values; shares of 0.0001 at least.

    Null where either side has fewer than LEAST_ROWS values, 0 where the reference has fewer than three distinct edges.
    """
    reference, current = reference.where(finite(value)), current.where(finite(value))
    found = sampling.quantiles(reference, value, {f"q{i}": i / bins for i in range(bins + 1)})
    edges = found.select(F.array_distinct(F.array(*[f"q{i}" for i in range(bins + 1)])).alias("all")).select(F.size("all").alias("edges_n"), F.filter("all", lambda e: (e != F.col("all")[0]) & (e != F.array_max("all"))).alias("edges"))
    counts = reference.select(value, F.lit(1).alias("ref")).unionByName(current.select(value, F.lit(0).alias("ref"))).crossJoin(F.broadcast(edges))  # one row
    bin_ = F.size(F.filter("edges", lambda e: e <= F.col(value)))
    binned = counts.groupBy(bin_.alias("bin")).agg(F.sum("ref").alias("r"), F.sum(1 - F.col("ref")).alias("c"), F.max("edges_n").alias("edges_n"))
    every = Window.partitionBy()  # a row a bin
    share = lambda k: F.greatest(F.try_divide(F.col(k), F.sum(k).over(every)), F.lit(1e-4))
    terms = binned.select(share("r").alias("rs"), share("c").alias("cs"), "r", "c", "edges_n")
    psi = F.sum((F.col("cs") - F.col("rs")) * F.ln(F.col("cs") / F.col("rs")))
    few = (F.coalesce(F.sum("r"), F.lit(0)) < LEAST_ROWS) | (F.coalesce(F.sum("c"), F.lit(0)) < LEAST_ROWS)
    return terms.agg(F.when(few, None).when(F.max("edges_n") < 3, 0.0).otherwise(psi).alias("psi"))


def status(value: Column, ok: Column, warn: Column, direction: Column, ok_to: Column | None = None, warn_to: Column | None = None) -> Column:
    """OK, ALERTA, FALLA or INFO: the higher or the lower the better, or (``rango``) inside [ok, ok_to], inside [warn, warn_to]."""
    higher = F.when(value >= ok, "OK").when(value >= warn, "ALERTA").otherwise("FALLA")
    lower = F.when(value <= ok, "OK").when(value <= warn, "ALERTA").otherwise("FALLA")
    inside = F.lit("INFO") if ok_to is None else F.when(value.between(ok, ok_to), "OK").when(value.between(warn, warn_to), "ALERTA").otherwise("FALLA")
    return F.when(value.isNull() | F.isnan(value.cast("double")), "INFO").when(direction == "mayor", higher).when(direction == "menor", lower).when(direction == "rango", inside).otherwise("INFO")
