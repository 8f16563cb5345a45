"""The relation of robustness levels and its product with entries."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Level:
    name: str
    kind: str
    params: dict[str, float] = field(default_factory=dict)


# The default levels, in order
DEFAULT_SUITE = (
    Level("clean", "clean"),
    Level("jpeg_q95", "jpeg", {"quality": 95}),
    Level("jpeg_q85", "jpeg", {"quality": 85}),
    Level("jpeg_q75", "jpeg", {"quality": 75}),
    Level("jpeg_q60", "jpeg", {"quality": 60}),
    Level("jpeg_q50", "jpeg", {"quality": 50}),
    Level("webp_q80", "webp", {"quality": 80}),
    Level("resize_0.75", "resize", {"scale": 0.75}),
    Level("resize_0.5", "resize", {"scale": 0.5}),
    Level("resize_0.25", "resize", {"scale": 0.25}),
    Level("roundtrip_0.5", "resize_roundtrip", {"scale": 0.5}),
    Level("crop_0.8", "center_crop", {"fraction": 0.8}),
    Level("noise_2", "gaussian_noise", {"sigma": 2}),
    Level("noise_5", "gaussian_noise", {"sigma": 5}),
    Level("social_1080_q80", "social", {"max_side": 1080, "quality": 80}),
)
LOCALIZATION_SUITE = tuple(x for x in DEFAULT_SUITE if x.kind in ("clean", "jpeg", "webp", "gaussian_noise"))
KINDS = ("clean", "jpeg", "webp", "resize", "resize_roundtrip", "center_crop", "gaussian_noise", "social")
GEOMETRY_KEPT = ("clean", "jpeg", "webp", "gaussian_noise")


def suite_of(levels: Sequence[dict]) -> tuple[Level, ...]:
    """A suite from the mappings of a suite file: names differ and kinds are known."""
    out = tuple(Level(x["name"], x["kind"], dict(x.get("params") or {})) for x in levels)
    if unknown := {x.kind for x in out} - set(KINDS):
        raise ValueError(f"unknown kinds of levels: {sorted(unknown)}")
    if len({x.name for x in out}) < len(out):
        raise ValueError("two levels have the same name")
    return out


def read_suite(path: str) -> tuple[Level, ...]:
    """The levels of a suite file, in order."""
    from ..sources.datasets import _yaml

    return suite_of(_yaml(path).get("levels", []))


def preserves_geometry(kind: Column) -> Column:
    return kind.isin(*GEOMETRY_KEPT)


def relation(spark: SparkSession, levels: Sequence[Level] = DEFAULT_SUITE) -> DataFrame:
    """(ordinal, level, kind, params): a row for each level."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(x.name).alias("level"), F.lit(x.kind).alias("kind"), F.lit(json.dumps(x.params, sort_keys=True)).alias("params")) for i, x in enumerate(levels)])
    return spark.range(1).select(F.explode(rows).alias("x")).select("x.*")


def jobs(entries: DataFrame, levels: Sequence[Level] = DEFAULT_SUITE) -> DataFrame:
    """Every entry at every level; the levels are literals of the plan, so that nothing is shuffled or broadcast."""
    rows = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(x.name).alias("level"), F.lit(x.kind).alias("kind")) for i, x in enumerate(levels)])
    return entries.withColumn("x", F.explode(rows)).select(*entries.columns, "x.*")
