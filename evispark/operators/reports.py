"""Report tables over score and pixel records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M
from .entries import known
from .suite import DEFAULT_SUITE

FIXED_THRESHOLD = 0.5
LEVELS = tuple(x.name for x in DEFAULT_SUITE)


def tuned_thresholds(df: DataFrame, fixed: float = FIXED_THRESHOLD) -> DataFrame:
    """(detector, threshold): best on clean val rows, on all clean rows if no detector has val rows, else the fixed one."""
    clean = df.where("level = 'clean'")
    has_val = clean.where("split = 'val'").limit(1).count() > 0
    own = clean.where("split = 'val'") if has_val else clean
    best = M.best_threshold(M.curve(M.counted(own, ["detector"]), ["detector"], weight="weight"), ["detector"])
    return df.select("detector").distinct().join(best, "detector", "left").select("detector", F.coalesce("threshold", F.lit(fixed)).alias("threshold"))


def image_table(df: DataFrame, level: str = "clean", fixed: float = FIXED_THRESHOLD) -> DataFrame:
    """Each detector's metrics at the fixed and at its tuned threshold, and a note where one label is missing."""
    rows = df.where(F.col("level") == level)
    out = M.image_metrics(rows, ["detector"], F.lit(fixed))
    tuned = tuned_thresholds(df, fixed)
    at = M.at_threshold(M.counted(rows, ["detector"]).join(F.broadcast(tuned), "detector"), ["detector", "threshold"], F.col("threshold"), weight="weight")
    at = at.select("detector", F.col("threshold").alias("tuned_threshold"), F.col("balanced_accuracy").alias("tuned_balanced_accuracy"), F.col("fpr").alias("tuned_fpr"))
    return out.join(at, "detector").withColumn("note", F.when((F.col("pos") == 0) | (F.col("pos") == F.col("total")), "one label only"))


def level_order(level: Column, levels: Sequence[str] = LEVELS) -> Column:
    """Clean first, then the suite's order, unknown levels last."""
    rank = F.when(level == "clean", -1)
    for i, name in enumerate(levels):
        rank = rank.when(level == name, i)
    return rank.otherwise(len(levels))


def robustness_table(df: DataFrame, levels: Sequence[str] = LEVELS) -> DataFrame:
    """Detector by level, levels without records included; the level relation is a handful of literals."""
    grid = df.select("detector").distinct().select("detector", F.explode(F.array(*map(F.lit, levels))).alias("level"))
    keys = ["detector", "level"]
    df = M.counted(df, keys)
    auc = M.auc(M.curve(df, keys, weight="weight"), keys)
    at = M.at_threshold(df, keys, F.lit(FIXED_THRESHOLD), weight="weight").select(*keys, "total", "balanced_accuracy", "fpr", "tpr")
    return grid.join(at, keys, "left").join(auc, keys, "left").select("detector", "level", level_order(F.col("level"), levels).alias("ordinal"), F.coalesce("total", F.lit(0)).alias("n"), "auc", "balanced_accuracy", "fpr", "tpr")


def per_group_table(df: DataFrame, key: str) -> DataFrame:
    """AUC on clean rows by generator or source; null for groups of one label."""
    if key not in ("generator", "source"):
        raise ValueError(f"groups are by generator or source, not {key}")
    rows = df.where("level = 'clean'").withColumn("group", known(key))
    keys = ["detector", "group"]
    rows = M.counted(rows, keys)
    return M.auc(M.curve(rows, keys, weight="weight"), keys).join(rows.groupBy(*keys).agg(F.sum("weight").alias("n")), keys)


def against_all_reals(df: DataFrame) -> DataFrame:
    """AUC of each generator's fakes against all reals: reals are counted once, by score, and met by running totals."""
    clean = df.where("level = 'clean'")
    steps = clean.groupBy("detector", "score").agg(F.sum((F.col("label") != "fake").cast("long")).alias("real"))
    placed = M.running_totals(steps, ["detector"], "score", ["real"])
    fakes = clean.where("label = 'fake'").groupBy("detector", "score", known("generator").alias("group")).agg(F.count(F.lit(1)).alias("n"))
    found = fakes.join(placed, ["detector", "score"]).groupBy("detector", "group").agg(F.sum(F.col("n") * (2 * F.col("real_below") + F.col("real"))).alias("s"), F.sum("n").alias("fakes"), F.max("real_all").alias("reals"))
    return found.select("detector", "group", "fakes", F.when(F.col("reals") > 0, M.rounded(F.col("s") / (2 * F.col("fakes") * F.col("reals")))).alias("auc"))


def timing_table(df: DataFrame) -> DataFrame:
    return df.groupBy("detector", "level").agg(F.round(F.avg("elapsed_ms"), 5).alias("mean_ms"), F.count("elapsed_ms").alias("n"))


def pixel_bundle(pixels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per image and detector: F1 and IoU at >= threshold, best F1 over 101 thresholds, and average precision; 0 where undefined."""
    keys = ["image", "detector", "level"]
    steps = M.curve(pixels, keys, "p", F.col("y").cast("long"), bounded=True)
    # a grid threshold t counts the scores >= t: the running totals at the first score that reaches it
    reach = F.floor(F.round(F.col("score") * 100, 9))
    hit = F.col("p_all") - F.col("p_below")
    best = 2 * hit / (hit + F.col("n_all") - F.col("n_below") + F.col("p_all"))
    least = F.coalesce(F.lag(reach).over(Window.partitionBy(*keys).orderBy("score")), F.lit(-1))
    first = (F.col("reach") > F.col("least")) & (F.col("reach") >= 0)
    above = lambda c: F.sum(F.when(F.col("score") >= threshold, c).otherwise(0))
    # all from the curve, which is dealt and ordered by image once
    c = steps.withColumns({"reach": reach, "least": least}).groupBy(*keys).agg(
        above(F.col("p")).alias("tp"), above(F.col("p") + F.col("n")).alias("said"), F.max("p_all").alias("pos"), M.precision().alias("ap"),
        M.rounded(F.max(F.when(first, F.when(F.col("p_all") > 0, best).otherwise(0.0)))).alias("best_f1"),
    )
    ratio = lambda a, b: M.rounded(F.when(b > 0, a / b).otherwise(0.0))
    tp, said, pos = F.col("tp"), F.col("said"), F.col("pos")
    f1, iou = ratio(2 * tp, said + pos), ratio(tp, said + pos - tp)
    return c.select(*keys, f1.alias("f1_at_threshold"), F.coalesce("best_f1", F.lit(0.0)).alias("best_f1"), F.coalesce("ap", F.lit(0.0)).alias("ap"), iou.alias("iou"))


def pixel_table(bundles: DataFrame) -> DataFrame:
    """Mean bundle by detector and level; sums are of integers of 1e-9."""
    mean = lambda c: F.round(F.sum(F.round(F.col(c) * 1_000_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000_000, 7).alias(c)
    return bundles.groupBy("detector", "level").agg(F.count(F.lit(1)).alias("n"), *[mean(c) for c in ("f1_at_threshold", "best_f1", "ap", "iou")])


def top_fraction(df: DataFrame, keys: Sequence[str], value: str, fraction: float = 0.01) -> DataFrame:
    """Mean of a key's greatest values, at least one, as many as the fraction rounds to."""
    w = Window.partitionBy(*keys)
    placed = df.withColumns({"place": F.row_number().over(w.orderBy(F.desc(value))), "size": F.count(F.lit(1)).over(w)})
    keep = F.greatest(F.lit(1), F.bround(F.col("size") * fraction))
    return placed.where(F.col("place") <= keep).groupBy(*keys).agg(F.round(F.sum(F.round(F.col(value) * 1_000_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000_000, 7).alias("top_score"))


def percentile_ranks(keys: Sequence[str], value: str) -> Column:
    """Average ranks scaled to [0, 1]; 0.5 where all values are the same or alone."""
    w = Window.partitionBy(*keys)
    rank, n = M.average_ranks(keys, value), F.count(F.lit(1)).over(w)
    flat = F.min(value).over(w) == F.max(value).over(w)
    return F.when(flat | (n <= 1), 0.5).otherwise((rank - 1) / (n - 1))


def p99_scaled(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Values over their key's 99th percentile, clipped to [0, 1]; 0 where that is no more than 1e-6."""
    top = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.99)).alias("p99"))
    return df.join(top, list(keys)).withColumn("scaled", F.when(F.col("p99") <= 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value) / F.col("p99")))))
