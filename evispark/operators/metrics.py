"""Ranking, threshold and calibration metrics on one plan: counts by distinct score, then running totals.

The shuffle carries distinct scores of a key, not rows; ties are exact, as all rows
with a score are one step. Sums stay integers until the last division. Where a key has
very many distinct scores, its running totals are made in ranges of scores, each of
which starts from what the lower ones add up to, so no task orders a whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROUND = 9
#: Distinct scores from which on a key's running totals are made in RANGES ranges.
LONG, RANGES = 1_000_000, 256


def is_fake(col: str = "label") -> Column:
    return (F.col(col) == "fake").cast("long")


def rounded(c: Column) -> Column:
    return F.round(c, ROUND)


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def running_totals(steps: DataFrame, keys: Sequence[str], by: str, values: Sequence[str], long: int = LONG, ranges: int = RANGES) -> DataFrame:
    """Adds of each value the sum over a key's rows with a lower ``by`` (v_below) and over all (v_all); ``by`` is a number, distinct within a key.

    A key of more than ``long`` rows is cut at quantiles of ``by`` into ranges. Rows are ordered within a range only; ranges are added up
    and joined back, ``ranges`` rows for each key. The table of cuts has a row for each such key, so Spark sends it to all tasks.
    """
    cuts = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("_cuts"))
    cuts = cuts.where(F.col("_rows") > long).drop("_rows")
    same = lambda t: [F.col(f"_s.{k}").eqNullSafe(F.col(f"{t}.{k}")) for k in keys]
    placed = steps.alias("_s").join(cuts.alias("_c"), same("_c"), "left").select("_s.*", F.size(F.filter(F.coalesce("_cuts", F.array()), lambda c: c <= F.col(by))).alias("_range"))
    sums = placed.groupBy(*keys, "_range").agg(*[F.sum(v).alias(v) for v in values])
    lower, every = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    sums = sums.select(*keys, "_range", *[_zero(F.sum(v).over(lower)).alias(f"_{v}_low") for v in values], *[F.sum(v).over(every).alias(f"{v}_all") for v in values])
    below = Window.partitionBy(*keys, "_range").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.select("*", *[_zero(F.sum(v).over(below)).alias(f"_{v}_in") for v in values])
    on = [*same("_t"), F.col("_s._range") == F.col("_t._range")]
    return inside.alias("_s").join(sums.alias("_t"), on).select(*[f"_s.{c}" for c in steps.columns], *[(F.col(f"_{v}_low") + F.col(f"_{v}_in")).alias(f"{v}_below") for v in values], *[f"{v}_all" for v in values])


def counted(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, score, label, weight): how many records there are of each kind; of records that are counted already, their sums."""
    weight = F.sum("weight") if "weight" in df.columns else F.count(F.lit(1))
    return df.groupBy(*keys, "score", "label").agg(weight.alias("weight"))


def _weight(weight: str | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight)


def curve(df: DataFrame, keys: Sequence[str], score: str = "score", y: Column | None = None, bounded: bool = False, weight: str | None = None) -> DataFrame:
    """For each distinct score of a key: positives and negatives at (p, n), below (p_below, n_below) and in all (p_all, n_all).

    ``bounded`` says that a key's rows are few by nature, as the pixels of an image: they are ordered in one go. ``weight`` names a column of counts.
    """
    y = is_fake() if y is None else y
    steps = df.select(*keys, F.col(score).alias("score"), y.alias("_y"), _weight(weight).alias("_w")).groupBy(*keys, "score").agg(F.sum(F.col("_y") * F.col("_w")).alias("p"), F.sum((1 - F.col("_y")) * F.col("_w")).alias("n"))
    if not bounded:
        return running_totals(steps, keys, "score", ["p", "n"])
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*keys)
    return steps.select("*", *[_zero(F.sum(v).over(below)).alias(f"{v}_below") for v in "pn"], *[F.sum(v).over(every).alias(f"{v}_all") for v in "pn"])


def auc(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Area under the ROC curve, ties half; null with one label only."""
    total = F.sum(F.col("p") * (2 * F.col("n_below") + F.col("n")))
    both = F.max(2 * F.col("p_all") * F.col("n_all"))
    return c.groupBy(*keys).agg(F.when(both > 0, rounded(total / both)).alias("auc"))


def average_precision(c: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Step-wise; null without positives."""
    return c.groupBy(*keys).agg(precision().alias("average_precision"))


def precision() -> Column:
    """Average precision as an aggregate over a key's curve."""
    hit = F.col("p_all") - F.col("p_below")
    false = F.col("n_all") - F.col("n_below")
    return rounded(F.sum(F.when(F.col("p_all") > 0, F.col("p") / F.col("p_all") * hit / (hit + false))))


def at_threshold(df: DataFrame, keys: Sequence[str], threshold: Column, score: str = "score", y: Column | None = None, weight: str | None = None) -> DataFrame:
    """Counts of the strict rule score > threshold, and accuracy, tpr, fpr and balanced accuracy."""
    y = is_fake() if y is None else y
    said = (F.col(score) > threshold).cast("long")
    w = F.col("w")
    c = df.select(*keys, y.alias("y"), said.alias("s"), _weight(weight).alias("w")).groupBy(*keys).agg(
        F.sum(F.col("y") * F.col("s") * w).alias("tp"), F.sum((1 - F.col("y")) * F.col("s") * w).alias("fp"), F.sum(F.col("y") * w).alias("pos"), F.sum(w).alias("total")
    )
    return rates(c)


def rates(c: DataFrame) -> DataFrame:
    """From tp, fp, pos and total; a rate without a base is 0."""
    neg = F.col("total") - F.col("pos")
    tpr = F.when(F.col("pos") > 0, F.col("tp") / F.col("pos")).otherwise(0.0)
    fpr = F.when(neg > 0, F.col("fp") / neg).otherwise(0.0)
    accuracy = (F.col("tp") + neg - F.col("fp")) / F.col("total")
    return c.withColumns({"accuracy": rounded(accuracy), "tpr": rounded(tpr), "fpr": rounded(fpr), "balanced_accuracy": rounded((tpr + 1 - fpr) / 2)})


def best_threshold(c: DataFrame, keys: Sequence[str], objective: str = "balanced_accuracy") -> DataFrame:
    """The distinct score that serves best as a strict threshold; the lowest of several."""
    tp = F.col("p_all") - F.col("p_below") - F.col("p")
    fp = F.col("n_all") - F.col("n_below") - F.col("n")
    if objective == "accuracy":
        value = (tp + F.col("n_all") - fp) / (F.col("p_all") + F.col("n_all"))
    elif objective == "balanced_accuracy":
        value = (F.when(F.col("p_all") > 0, tp / F.col("p_all")).otherwise(0.0) + 1 - F.when(F.col("n_all") > 0, fp / F.col("n_all")).otherwise(0.0)) / 2
    else:
        raise ValueError(f"objective must be accuracy or balanced_accuracy, not {objective}")
    best = F.max(F.struct(rounded(value).alias("value"), (-F.col("score")).alias("low"), F.col("score").alias("threshold")))
    return c.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.threshold", F.col("b.value").alias(f"best_{objective}"))


def calibration_error(df: DataFrame, keys: Sequence[str], prob: str = "score", bins: int = 15, y: Column | None = None, weight: str | None = None) -> DataFrame:
    """Expected calibration error over equal, right-closed bins; 0 is in the first."""
    y = is_fake() if y is None else y
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: e < F.col("_p")))
    # integers of 1e-9 keep sums independent of their order
    unit = 1_000_000_000
    w = F.col("_w")
    b = df.select(*keys, F.col(prob).alias("_p"), y.alias("y"), _weight(weight).alias("_w")).withColumn("bin", place).groupBy(*keys, "bin").agg(F.sum(w).alias("m"), F.sum(F.round(F.col("_p") * unit).cast("long") * w).alias("s"), F.sum(F.col("y") * w).alias("hit"))
    gap = F.abs(F.sum("s").over(Window.partitionBy(*keys, "bin")) / unit - F.col("hit"))
    return b.withColumn("gap", gap).groupBy(*keys).agg(F.round(F.sum("gap") / F.sum("m"), 7).alias("ece"))


def brier(df: DataFrame, keys: Sequence[str], prob: str = "score", y: Column | None = None, weight: str | None = None) -> DataFrame:
    y = is_fake() if y is None else y
    off = F.pow(F.col(prob) - y, F.lit(2))
    mean = F.avg(off) if weight is None else F.sum(off * F.col(weight)) / F.sum(F.when(off.isNotNull(), F.col(weight)))
    return df.groupBy(*keys).agg(F.round(mean, 7).alias("brier"))


def average_ranks(keys: Sequence[str], value: str) -> Column:
    """1-based ranks with ties averaged, as a column."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def image_metrics(df: DataFrame, keys: Sequence[str], threshold: Column | None = None) -> DataFrame:
    """The bundle of image metrics at a threshold, or at each key's best one.

    Records are counted by score and label first: what is joined, ordered and summed are distinct scores. The thresholds,
    a row for each key, go to all tasks, so that no key's records meet in one.
    """
    df = counted(df, keys)
    c = curve(df, keys, weight="weight")
    best = best_threshold(c, keys)
    if threshold is None:
        own = best.select(*keys, "threshold")
    else:
        own = best.select(*keys, threshold.alias("threshold"))
    named = df.join(F.broadcast(own), list(keys))
    at = at_threshold(named, [*keys, "threshold"], F.col("threshold"), weight="weight")
    out = at
    for part in (auc(c, keys), average_precision(c, keys), calibration_error(df, keys, weight="weight"), brier(df, keys, weight="weight")):
        out = out.join(part, list(keys))
    return out.select(*keys, "total", "pos", "threshold", "auc", "average_precision", "accuracy", "tpr", "fpr", "balanced_accuracy", "ece", "brier")
