"""Splits of a dataset by groups, so that no group is in two of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The usual fractions.
FRACTIONS = {"train": 0.7, "val": 0.15, "test": 0.10, "human_eval": 0.05}
# End of fixed values.
#: Groups up to which the greedy order, a sequential rule over group sizes, is worked out in one row.
MOST_GREEDY = 20_000


def checked(fractions: Mapping[str, float]) -> dict[str, float]:
    if abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError(f"fractions sum to {sum(fractions.values())}, not 1")
    return dict(fractions)


def _sizes(df: DataFrame, key: str, seed: int) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit("")))))


def greedy(df: DataFrame, key: str, fractions: Mapping[str, float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """key, split: groups in a seeded order, each to the split that lacks most rows, the first one among equals.

    Only sizes of groups are gathered, MOST_GREEDY of them at most; ``prefix`` is for more.
    """
    names, shares = list(checked(fractions)), list(fractions.values())
    sizes = _sizes(df, key, seed)
    row = sizes.agg(F.array_sort(F.collect_list(F.struct("h", "n", F.col(key).alias("g")))).alias("groups"), F.sum("n").alias("total"))
    row = row.select(F.assert_true(F.size("groups") <= MOST_GREEDY).alias("fits"), "groups", "total").where("fits IS NULL")
    zero = F.struct(F.array(*[F.lit(0).cast("bigint")] * len(names)).alias("taken"), F.array().cast("array<int>").alias("picks"))

    def step(state, group):  # noqa: ANN001, ANN202
        lack = F.array(*[F.lit(float(s)) * F.col("total") - state["taken"][i] for i, s in enumerate(shares)])
        pick = (F.array_position(lack, F.array_max(lack)) - 1).cast("int")
        taken = F.transform(state["taken"], lambda x, i: F.when(i == pick, x + group["n"]).otherwise(x))
        return F.struct(taken.alias("taken"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    picks = F.aggregate("groups", zero, step)["picks"]
    pairs = row.select(F.explode(F.arrays_zip(F.col("groups").alias("groups"), picks.alias("picks"))).alias("x"))
    return pairs.select(F.col("x.groups.g").alias(key), F.element_at(F.array(*map(F.lit, names)), F.col("x.picks") + 1).alias("split"))


def prefix(df: DataFrame, key: str, fractions: Mapping[str, float] = FRACTIONS, seed: int = 42) -> DataFrame:
    """key, split for any number of groups: in the seeded order, the middle of a group's share of all rows decides.
    Shares before a group are summed over 256 buckets of the order first, then within its bucket."""
    names = list(checked(fractions))
    sizes = _sizes(df, key, seed).withColumn("b", F.substring("h", 1, 2))
    buckets = sizes.groupBy("b").agg(F.sum("n").alias("bn"))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("b", F.coalesce(F.sum("bn").over(earlier), F.lit(0)).alias("start"), F.sum("bn").over(Window.partitionBy()).alias("total"))
    inner = F.coalesce(F.sum("n").over(Window.partitionBy("b").orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = (F.col("start") + F.col("before") + F.col("n") / 2) / F.col("total")
    placed = sizes.withColumn("before", inner).join(F.broadcast(starts), "b").withColumn("middle", middle)
    split, edge = F.lit(names[-1]), 1.0
    for name in reversed(names[:-1]):
        edge = sum(fractions[x] for x in names[: names.index(name) + 1])
        split = F.when(F.col("middle") < edge, name).otherwise(split)
    return placed.select(key, split.alias("split"))


def leaks(rows: DataFrame, key: str) -> DataFrame:
    """Groups that are in more than one split."""
    return rows.groupBy(key).agg(F.count_distinct("split").alias("n_splits")).where("n_splits > 1")
