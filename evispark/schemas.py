"""Explicit schemas of the engine's relations; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REAL, FAKE, UNCERTAIN = "real", "fake", "uncertain"
SPLITS = ("train", "val", "test")

ENTRY = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("generator", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("mask_path", T.StringType()),
        T.StructField("sha256", T.StringType(), False),
        T.StructField("width", T.IntegerType(), False),
        T.StructField("height", T.IntegerType(), False),
        T.StructField("format", T.StringType(), False),
        T.StructField("jpeg_quality", T.IntegerType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
    ]
)

SCORE = T.StructType(
    [
        T.StructField("entry_path", T.StringType(), False),
        T.StructField("label", T.StringType(), False),
        T.StructField("source", T.StringType(), False),
        T.StructField("generator", T.StringType()),
        T.StructField("split", T.StringType()),
        T.StructField("level", T.StringType(), False),
        T.StructField("detector", T.StringType(), False),
        T.StructField("score", T.DoubleType(), False),
        T.StructField("elapsed_ms", T.DoubleType()),
    ]
)

PIXEL = T.StructType(
    [
        T.StructField("entry_path", T.StringType(), False),
        T.StructField("detector", T.StringType(), False),
        T.StructField("level", T.StringType()),
        T.StructField("metrics", T.StructType([T.StructField(n, T.DoubleType()) for n in ("f1_at_threshold", "best_f1", "ap", "iou", "threshold")])),
    ]
)


def checked_entries(df: DataFrame) -> DataFrame:
    """The entries, with an error as soon as a label or split is none of the known ones."""
    bad = ~F.col("label").isin(REAL, FAKE) | (F.col("split").isNotNull() & ~F.col("split").isin(*SPLITS))
    return df.withColumn("label", F.when(bad, F.raise_error(F.concat(F.lit("bad label or split: "), F.col("path")))).otherwise(F.col("label")))
