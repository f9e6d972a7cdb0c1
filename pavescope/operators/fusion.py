"""What is around a learned fusion: preparation of columns, ensembles of member predictions, probabilities of states."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import config as c
from ..functions import exprs as x
from . import pavement, sampling

#: Skewness from which a column without negative values is taken as logarithms, and where z-scores are cut.
SKEWED, FURTHEST = 2.0, 8.0
#: Terms of the series of the normal distribution, enough for |z| up to WIDEST in double precision.
SERIES, WIDEST = 150, 8.0


def _corrected_skew(v: Column) -> Column:
    """Skewness corrected for bias; null under three values."""
    n = F.count(v)
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2) * F.skewness(v))


def scaled(rows: DataFrame, columns: list[str], fit: DataFrame | None = None) -> DataFrame:
    """rows with each of columns as a z-score, by statistics of fit (rows themselves by default).

    Columns without negatives whose corrected skewness is over SKEWED become log(1 + v), negatives of rows counting as 0.
    Nulls and NaN take the median, the deviation has n - 1 degrees (1 where it is 0 or missing), scores end at FURTHEST
    both ways, and what is not finite is 0. Other columns stay. An empty fit gives zeros.
    """
    fit = rows if fit is None else fit
    clean = lambda k: F.when(~F.isnan(F.col(k).cast("double")), F.col(k).cast("double"))
    own = fit.select(*[clean(k).alias(k) for k in columns])
    logged = own.agg(*[F.coalesce((F.min(k) >= 0) & (_corrected_skew(F.col(k)) > SKEWED), F.lit(False)).alias(f"_log_{k}") for k in columns])
    as_log = lambda k: F.when(F.col(f"_log_{k}") & clean(k).isNotNull(), F.log1p(F.greatest(clean(k), F.lit(0.0)))).otherwise(clean(k))  # greatest() passes over nulls
    own = own.crossJoin(F.broadcast(logged)).select(*[as_log(k).alias(k) for k in columns])  # one row
    long = own.select(F.explode(F.array(*[F.struct(F.lit(k).alias("variable"), F.col(k).alias("v")) for k in columns])).alias("e")).select("e.*")
    found = sampling.quantiles(long, "v", {"m": 0.5}, ["variable"])
    middle = found.agg(*[F.max(F.when(F.col("variable") == k, F.col("m"))).alias(f"_mid_{k}") for k in columns])
    filled = own.crossJoin(F.broadcast(middle)).select(*[F.coalesce(k, f"_mid_{k}").alias(k) for k in columns])  # one row
    spread = filled.agg(*[e for k in columns for e in (F.avg(k).alias(f"_mean_{k}"), F.stddev_samp(k).alias(f"_sd_{k}"))])
    learned = logged.crossJoin(middle).crossJoin(spread)  # one row each

    def z(k: str) -> Column:
        sd = F.when(F.col(f"_sd_{k}") > 0, F.col(f"_sd_{k}")).otherwise(1.0)
        score = (F.coalesce(as_log(k), F.col(f"_mid_{k}")) - F.col(f"_mean_{k}")) / sd
        return F.when(score.isNull() | F.isnan(score) | (F.abs(score) == math.inf), 0.0).otherwise(F.least(F.greatest(score, F.lit(-FURTHEST)), F.lit(FURTHEST)))

    out = rows.crossJoin(F.broadcast(learned))  # one row
    return out.select(*[z(k).alias(k) if k in columns else F.col(k) for k in rows.columns])


def derived(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Score of each group of frames (rho of each class, iri): densities and roughness are averaged, then scored. Columns keys, pci_vis, iri, ride, icv."""
    means = frames.groupBy(*keys).agg(*[F.avg(f"rho_{k}").alias(f"rho_{k}") for k in c.CLASSES], F.avg("iri").alias("iri"))
    out = pavement.scored(means).withColumn("ride", x.ride(F.col("iri")))
    return out.withColumn("icv", x.icv(F.col("pci_vis"), F.col("ride"))).select(*keys, "pci_vis", "iri", "ride", "icv")


def ensemble(members: DataFrame) -> DataFrame:
    """segment_id, pci_vis, iri, ride, icv and icv_std of predictions by several members.

    members: member, image_id, segment_id, rho of each class, iri; one row a member and frame. Densities of a frame are
    averaged over members, its roughness by the geometric mean (values that are not positive are left out). icv_std is the
    deviation of the members' own segment scores, null with one member. Null predictions of a member are left out.
    """
    positive = F.when(F.col("iri") > 0, F.ln("iri"))
    frames = members.groupBy("segment_id", "image_id").agg(*[F.avg(f"rho_{k}").alias(f"rho_{k}") for k in c.CLASSES], F.exp(F.avg(positive)).alias("iri"))
    apart = derived(members, ["segment_id", "member"]).groupBy("segment_id").agg(F.stddev_samp("icv").alias("icv_std"))
    return derived(frames, ["segment_id"]).join(apart, "segment_id")


@F.arrow_udf(DoubleType())
def _below(z: pa.Array) -> pa.Array:
    """The power series of the normal distribution, all rows of a batch a term at a time."""
    v = np.clip(z.to_numpy(zero_copy_only=False), -WIDEST, WIDEST)
    term, total, square = v.copy(), v.copy(), v * v
    for k in range(1, SERIES + 1):
        term *= square / (2 * k + 1)
        total += term
    return pa.array(0.5 + total * np.exp(-square / 2) / math.sqrt(2 * math.pi), mask=z.is_null().to_numpy(zero_copy_only=False))


def normal_share(z: Column) -> Column:
    """The normal distribution's share below z, by its power series; z beyond WIDEST counts as WIDEST. Null gives null."""
    return _below(z.cast("double"))


def state_shares(score: Column, sigma: Column) -> list[Column]:
    """p_<state> for each state: the chance that a normal score of this mean and deviation lies between the state's bounds. The ends are open."""
    out, above = [], F.lit(1.0)
    for name, low in c.STATES:
        below = normal_share((F.lit(float(low)) - score) / sigma) if low else F.lit(0.0)
        out.append((above - below).alias(f"p_{name}"))
        above = below
    return out
