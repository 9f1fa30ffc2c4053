"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import saved

#: A group of more values than this is searched by histograms of so many cells.
SMALL, CELLS = 100_000, 1024


def quantiles(rows: DataFrame, by: Sequence[str], value: str, shares: Sequence[float]) -> DataFrame:
    """``by``, q0, q1, ...: the quantiles of each group at these shares, between neighbours linear; null values and NaN
    don't count, and a group without others has null.

    Groups of up to SMALL values are sorted where they meet.  A larger one is searched by distributed selection: a
    histogram of the range that holds a wanted rank, counted where the rows lie, leaves one cell, whose own least and
    greatest value are the next range, until SMALL values or equal ones are left.  So no task or state holds more than
    SMALL values of a group.  ``rows`` are read once for each histogram: give rows that are written.
    """
    plain = F.percentile("x", list(shares))
    base = rows.select(*by, F.when(~F.isnan(value), F.col(value).cast("double")).alias("x"))
    sizes = saved(base.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")), "group-sizes")
    told = lambda df: df.select(*by, *[F.get("q", F.lit(k)).alias(f"q{k}") for k in range(len(shares))])
    large = sizes.where(F.col("n") > SMALL)
    n_large = large.count()
    if not n_large:
        return told(base.groupBy(*by).agg(plain.alias("q")))
    # a group's own sizes decide where its rows go; the sizes of few groups are sent to them
    near = (lambda df: F.broadcast(df)) if n_large <= 10_000 else (lambda df: df)
    keys = near(large.select(*by))
    small = base.join(keys, list(by), "left_anti").groupBy(*by).agg(plain.alias("q"))
    base = base.where("x IS NOT NULL").join(keys, list(by), "left_semi")
    places = F.array(*[F.struct(F.lit(s).cast("double").alias("share"), up.alias("up")) for s in shares for up in (F.lit(False), F.lit(True))])
    rank = lambda x: F.when(x.up, F.ceil(x.share * (F.col("n") - 1))).otherwise(F.floor(x.share * (F.col("n") - 1))).cast("long")
    ranks = F.array_distinct(F.transform(places, rank))
    open_ = saved(large.select(*by, F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("inside")), "ranks")
    done = []
    while True:
        ended = (F.col("inside") <= SMALL) | (F.col("low") == F.col("high"))
        done.append(open_.where(ended))
        open_ = open_.where(~ended)
        if open_.isEmpty():
            break
        cell = F.least(F.lit(CELLS - 1), F.floor((F.col("x") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2) * CELLS))  # halves: no overflow
        counted = base.join(near(open_), list(by)).where("x BETWEEN low AND high").groupBy(*by, "rank", "below", cell.alias("cell")).agg(F.count("*").alias("inside"), F.min("x").alias("low"), F.max("x").alias("high"))
        upto = F.sum("inside").over(Window.partitionBy(*by, "rank").orderBy("cell"))
        found = counted.withColumn("upto", F.col("below") + upto).where("upto > rank AND upto - inside <= rank")
        open_ = saved(found.select(*by, "rank", "low", "high", (F.col("upto") - F.col("inside")).alias("below"), "inside"), "ranks")
    ends = done[0]
    for part in done[1:]:
        ends = ends.unionByName(part)
    equal = ends.where("low = high").select(*by, "rank", F.col("low").alias("x"))
    left = base.join(near(ends.where("low < high")), list(by)).where("x BETWEEN low AND high").groupBy(*by, "rank", "below").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    values = equal.unionByName(left.select(*by, "rank", F.get("xs", (F.col("rank") - F.col("below")).cast("int")).alias("x")))
    known = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at")).join(near(large.select(*by, "n")), list(by))

    def between(share: float) -> Column:
        place = F.lit(float(share)) * (F.col("n") - 1)
        lower, upper = F.element_at("at", F.floor(place).cast("long")), F.element_at("at", F.ceil(place).cast("long"))
        return lower + (place - F.floor(place)) * (upper - lower)

    return told(small).unionByName(known.select(*by, *[between(s).alias(f"q{k}") for k, s in enumerate(shares)]))
