"""Pages of delivered segments: filters, search and order over a table, and long tables of quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows of a page.
PAGE = 400


def page(rows: DataFrame, key: str, order: str, descending: bool = False, equal: dict | None = None, search: str = "", over: tuple[str, ...] = (), most: int = PAGE) -> DataFrame:
    """The first ``most`` rows, with ``place`` from 1 and ``matches`` (all rows that fit), that hold the values of ``equal`` and the searched text.

    Values of equal that are None or '' filter nothing. The text is looked for in the columns of ``over``, joined by one
    space, whatever the case; '' fits all and null columns count as ''. Ties of ``order`` go by ``key``; nulls come last
    in both directions. Where nothing fits, the result is empty. The order is kept as a top-k, so no table is sorted.
    """
    fits = F.lit(True)
    for name, value in (equal or {}).items():
        if value is not None and value != "":
            fits = fits & (F.col(name) == F.lit(value))
    if search:
        text = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in over])
        fits = fits & F.contains(F.lower(text), F.lower(F.lit(search)))
    kept = rows.where(fits)
    by = [F.desc_nulls_last(order) if descending else F.asc_nulls_last(order), F.asc(key)]
    top = kept.orderBy(*by).limit(most)
    return top.crossJoin(F.broadcast(kept.agg(F.count(F.lit(1)).alias("matches")))).withColumn("place", F.row_number().over(Window.orderBy(*by)))  # one row; a page


def melted(wide: DataFrame, keys: list[str], block: str, n: str) -> DataFrame:
    """keys, block, metric, value and n: a row for each other column of a wide table of measures."""
    names = [k for k in wide.columns if k not in (*keys, n)]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).cast("double").alias("value")) for k in names])).alias("m")
    return wide.select(*keys, F.lit(block).alias("block"), each, F.col(n).cast("long").alias("n")).select(*keys, "block", "m.metric", "m.value", "n")
