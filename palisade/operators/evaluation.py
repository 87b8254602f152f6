"""Evaluation of detectors: AUC, thresholds at a false-positive budget, confusion, percentiles.

Everything is grouped, so many detectors, fields or slices are measured in one pass. Sorted measures
work on the histogram of distinct scores, not on rows: rows are aggregated before any window, and running sums
are taken inside ranges of scores, so that no task holds the scores of a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def histogram(df: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    pos = (F.col(label) == 1).cast("long")
    return df.groupBy(*group, F.col(score).alias("score")).agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


#: Ranges that the scores of a group are cut into, at about equal numbers of distinct ones, and the scores that are
#: drawn for each.
RANGES, DRAWN = 64, 16


def joined(df: DataFrame, other: DataFrame, group: list[str]) -> DataFrame:
    """df with the columns of other, which has a row for each group (one row without any)."""
    return df.join(other, group) if group else df.crossJoin(F.broadcast(other))


def cuts(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """The values `_cuts` between the ranges of each group: of RANGES * DRAWN slots by hash the value that is least by
    hash. A plan may take them several times, and must then get the same ones, so they hang on the values alone; a
    sketch (percentile_approx) hangs on the order in which its parts are merged, too."""
    spot = F.xxhash64(value)
    drawn = df.filter(F.col(value).isNotNull()).groupBy(*group, F.pmod(spot, F.lit(RANGES * DRAWN)).alias("_slot")).agg(F.min(F.struct(spot.alias("spot"), F.col(value).alias("value"))).alias("_least"))
    lists = drawn.groupBy(*group).agg(F.array_sort(F.collect_list("_least.value")).alias("_drawn"))  # RANGES * DRAWN at most
    return lists.select(*group, F.filter("_drawn", lambda x, i: (i > 0) & ((i * RANGES) % F.size("_drawn") < RANGES)).alias("_cuts"))


def running(df: DataFrame, group: list[str], value: str, held: str, name: str, falling: bool = False) -> DataFrame:
    """df (a row for each group and value) with `name`, the sum of `held` over the values up to its own, or down to
    it: the sums of the ranges before, and the sum inside its range."""
    ranged = joined(df, cuts(df, group, value), group).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    order = (lambda c: F.desc(c)) if falling else (lambda c: F.asc(c))
    sums = ranged.groupBy(*group, "_range").agg(F.sum(held).alias("_sum"))
    before = W.partitionBy(*group).orderBy(order("_range")).rowsBetween(W.unboundedPreceding, -1)  # RANGES rows
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*group, "_range").orderBy(order(value)).rowsBetween(W.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum(held).over(inside)).join(sums, [*group, "_range"])
    return summed.withColumn(name, F.col("_inside") + F.col("_before")).drop("_range", "_inside", "_before")


def auc(df: DataFrame, group: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """auc for each group, ties count a half; 0.5 where there is one class only."""
    h = running(histogram(df, group, score, label), group, "score", "neg", "upto").withColumn("lower", F.col("upto") - F.col("neg"))
    sums = h.groupBy(*group).agg(F.sum(F.col("pos") * F.col("lower") + F.col("pos") * F.col("neg") / 2.0).cast("double").alias("won"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return sums.select(*group, "n_pos", "n_neg", F.coalesce(F.try_divide("won", (F.col("n_pos") * F.col("n_neg")).cast("double")), F.lit(0.5)).alias("auc"))


def thresholds(df: DataFrame, group: list[str], budgets: list[float], score: str = "score", label: str = "label") -> DataFrame:
    """For each group and budget the least score at or above which at most that share of the negatives
    lies; 1.01 where no score does."""
    h = running(histogram(df, group, score, label), group, "score", "neg", "over", falling=True)
    h = joined(h, h.groupBy(*group).agg(F.sum("neg").alias("n_neg")), group)
    h = h.select(*group, "score", (F.col("over") / F.greatest("n_neg", F.lit(1))).alias("fpr"), F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"))
    return h.groupBy(*group, "budget").agg(F.coalesce(F.min(F.when(F.col("fpr") <= F.col("budget"), F.col("score"))), F.lit(1.01)).alias("threshold"))


def confusion(df: DataFrame, group: list[str], flagged: Column, label: str = "label") -> DataFrame:
    hit = flagged.cast("long")
    pos = (F.col(label) == 1).cast("long")
    t = df.groupBy(*group).agg(F.sum(hit * pos).alias("tp"), F.sum(hit * (1 - pos)).alias("fp"), F.sum(pos).alias("p"), F.sum(1 - pos).alias("n"))
    return t.select(*group, "tp", "fp", F.try_divide("tp", "p").alias("tpr"), F.try_divide("fp", "n").alias("fpr"), (F.col("tp") / F.greatest(F.lit(1), F.col("tp") + F.col("fp"))).alias("precision"))


def at_rank(df: DataFrame, group: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at the 0-based ranks that are given in terms of n, the size of the group.

    Ranks are taken from the counts of distinct values.
    """
    h = running(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("held")), group, value, "held", "upto")
    h = joined(h, h.groupBy(*group).agg(F.max("upto").alias("n")), group)
    pick = lambda rank: F.min(F.when(F.col("upto") > rank, F.col(value)))
    return h.groupBy(*group).agg(*[pick(r).alias(name) for name, r in ranks.items()])


def mean_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """df with mean_rank, the 1-based rank of its value in its group; ties have the mean of theirs."""
    h = running(df.groupBy(*group, value).agg(F.count(F.lit(1)).alias("held")), group, value, "held", "upto")
    h = h.select(*group, value, (F.col("upto") - (F.col("held") - 1) / 2).alias("mean_rank"))
    return df.join(h, [*group, value])


def latency_ranks() -> dict[str, Column]:
    """The two middle values, the upper median, and the value at floor(0.95 (n - 1))."""
    n = F.col("n")
    return {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2), "upper": F.floor(n / 2), "p95": F.floor(F.lit(0.95).cast("double") * (n - 1))}


def aggregators(df: DataFrame, key: list[str]) -> DataFrame:
    """Rows (key, k, question, p) to a row for each key and candidate aggregator: name, ordinal, score.

    Each question, the maximum and mean of all, and of each pair in order: n + n (n - 1) + 2.
    """
    wide = df.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("k", "question", "p"))).alias("s"))  # a few questions
    p = F.transform("s", lambda x: x["p"])
    entry = lambda name, score: F.struct(name.alias("name"), score.alias("score"))
    ones = F.transform("s", lambda x: entry(x["question"], x["p"]))
    pairs = F.flatten(F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: b["k"] > a["k"]), lambda b: F.array(
        entry(F.concat(F.lit("max("), a["question"], F.lit(","), b["question"], F.lit(")")), F.greatest(a["p"], b["p"])),
        entry(F.concat(F.lit("mean("), a["question"], F.lit(","), b["question"], F.lit(")")), (a["p"] + b["p"]) / 2))))))
    every = F.concat(F.array(entry(F.lit("maxall"), F.array_max(p)), entry(F.lit("meanall"), F.aggregate(p, F.lit(0.0), lambda a, x: a + x) / F.size("s"))), ones, pairs)
    return wide.select(*key, F.posexplode(every).alias("ordinal", "e")).select(*key, "ordinal", "e.name", "e.score")


def best(df: DataFrame, group: list[str]) -> DataFrame:
    """The aggregator with the highest auc of each group; of equals the first."""
    return df.groupBy(*group).agg(F.max_by(F.struct("name", "auc"), F.struct("auc", -F.col("ordinal"))).alias("b")).select(*group, "b.name", "b.auc")
