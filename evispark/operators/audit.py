"""Bias audit of a dataset: bucket histograms by label, their distance, dominance, imbalance and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .entries import known

DOMINANT, RARE = 0.9, 0.1
DISTANCE_LIMIT, IMBALANCE_LIMIT = 0.3, 5.0


def resolution_bucket(width: str = "width", height: str = "height") -> Column:
    side = F.least(width, height)
    return F.when(side < 512, "<512").when(side < 1024, "512-1023").when(side < 2048, "1024-2047").otherwise(">=2048")


def quality_bucket(quality: str = "jpeg_quality") -> Column:
    low = F.floor((F.greatest(F.lit(1), F.least(F.lit(100), F.col(quality))) - 1) / 10) * 10 + 1
    return F.when(F.col(quality).isNull(), "none").otherwise(F.concat(low, F.lit("-"), low + 9))


def aspect_bucket(width: str = "width", height: str = "height") -> Column:
    ratio = F.when(F.col(height) == 0, 0.0).otherwise(F.col(width) / F.nullif(F.col(height), F.lit(0)))
    return F.when(ratio < 0.75, "<0.75").when(ratio <= 1.33, "0.75-1.33").otherwise(">1.33")


def axes() -> dict[str, Column]:
    return {"format": known("format"), "resolution": resolution_bucket(), "quality": quality_bucket(), "aspect": aspect_bucket(), "source": known("source")}


def histograms(df: DataFrame, by: dict[str, Column] | None = None) -> DataFrame:
    """(axis, bucket, label, n) of labelled entries, all axes in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), b.alias("bucket")) for a, b in (by or axes()).items()]))
    rows = df.where(F.col("label").isNotNull()).select("label", pairs.alias("x"))
    return rows.groupBy("x.axis", "x.bucket", "label").agg(F.count(F.lit(1)).alias("n"))


def _shares(h: DataFrame) -> DataFrame:
    """(axis, bucket, real, fake): counts side by side, with the axis totals."""
    wide = h.groupBy("axis", "bucket").agg(*[F.sum(F.when(F.col("label") == x, F.col("n")).otherwise(0)).alias(x) for x in ("real", "fake")])
    every = Window.partitionBy("axis")
    return wide.withColumns({"reals": F.sum("real").over(every), "fakes": F.sum("fake").over(every)})


def js_distance(h: DataFrame) -> DataFrame:
    """(axis, js_distance): square root of the base-2 Jensen-Shannon divergence of the labels' histograms, in [0, 1]; 0 if a label is missing."""
    p, q = F.col("real") / F.nullif("reals", F.lit(0)), F.col("fake") / F.nullif("fakes", F.lit(0))
    m = (p + q) / 2
    term = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    value = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.sum((term(p) + term(q)) / 2))))
    empty = (F.max("reals") == 0) | (F.max("fakes") == 0)
    return _shares(h.where(~((F.col("axis") == "quality") & (F.col("bucket") == "none")))).groupBy("axis").agg(F.round(F.when(empty, 0.0).otherwise(value), 7).alias("js_distance"))


def dominance(h: DataFrame, axis: str = "format") -> DataFrame:
    """(axis, bucket, label): the first bucket that holds nearly all of one label and hardly any of the other."""
    s = _shares(h.where(F.col("axis") == axis)).where("reals > 0 and fakes > 0")
    p, q = F.col("real") / F.col("reals"), F.col("fake") / F.col("fakes")
    label = F.when((p >= DOMINANT) & (q <= RARE), "real").when((q >= DOMINANT) & (p <= RARE), "fake")
    found = s.withColumn("label", label).where("label is not null")
    return found.groupBy("axis").agg(F.min(F.struct("bucket", "label")).alias("x")).select("axis", "x.bucket", "x.label")


def imbalance(df: DataFrame) -> DataFrame:
    """One row: the labels' counts, the ratio of the greatest to the least, and whether that is a problem."""
    c = df.where(F.col("label").isNotNull()).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = c.agg(F.sum(F.when(F.col("label") == "real", F.col("n")).otherwise(0)).alias("real"), F.sum(F.when(F.col("label") == "fake", F.col("n")).otherwise(0)).alias("fake"))
    ratio = F.greatest("real", "fake") / F.nullif(F.least("real", "fake"), F.lit(0))
    return out.select("real", "fake", F.round(ratio, 9).alias("ratio"), F.coalesce(ratio > IMBALANCE_LIMIT, F.lit(False)).alias("imbalanced"), (F.least("real", "fake") == 0).alias("single_label"))


def duplicates(df: DataFrame) -> DataFrame:
    """One row: surplus copies, and hashes that both labels have."""
    by = df.where(F.col("label").isNotNull()).groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return by.agg(F.sum(F.col("n") - 1).alias("surplus"), F.sum((F.col("low") != F.col("high")).cast("long")).alias("shared"))


def report(df: DataFrame) -> DataFrame:
    """(problem, detail) rows; none if the dataset passes."""
    h = histograms(df)
    far = js_distance(h).where((F.col("js_distance") > DISTANCE_LIMIT) & F.col("axis").isin("format", "resolution", "quality"))
    found = far.select(F.lit("distance").alias("problem"), F.concat_ws("=", "axis", F.col("js_distance").cast("string")).alias("detail"))
    found = found.unionByName(dominance(h).select(F.lit("dominance").alias("problem"), F.concat_ws("=", "bucket", "label").alias("detail")))
    i = imbalance(df)
    found = found.unionByName(i.where("imbalanced").select(F.lit("imbalance").alias("problem"), F.col("ratio").cast("string").alias("detail")))
    found = found.unionByName(i.where("single_label").select(F.lit("single label").alias("problem"), F.lit("").alias("detail")))
    d = duplicates(df)
    for name in ("surplus", "shared"):
        found = found.unionByName(d.where(F.col(name) > 0).select(F.lit(f"duplicates {name}").alias("problem"), F.col(name).cast("string").alias("detail")))
    return found
