"""The feature cache as a relation: keys, look-up, storing, statistics; batches across images; crops back to images; samples of a run."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics as M
from .crops import Augmentation, CropPolicy
from .fusion import sigmoid

NO_AUGMENT = "none"
KEY = ("image_sha256", "backbone", "policy_hash", "augment_hash", "view")


def keyed(images: DataFrame, backbone: str, policy: CropPolicy, augment: Augmentation | None = None, views: int = 1) -> DataFrame:
    """A row for each view of an image with its cache key: content, backbone, crop policy, augmentation, view."""
    out = images.withColumns({"backbone": F.lit(backbone), "policy_hash": F.lit(policy.fingerprint()), "augment_hash": F.lit(NO_AUGMENT if augment is None else augment.fingerprint())})
    return out.withColumn("view", F.explode(F.sequence(F.lit(0), F.lit(views - 1))))


def put(features: DataFrame, path: str) -> None:
    """Adds features (key columns, features array<float>) to a cache, dealt to folders by the first two digits of the hash; values are kept as 32 bits."""
    shard = F.substring("image_sha256", 1, 2)
    features.withColumn("shard", shard).repartition("shard").write.mode("append").partitionBy("shard").parquet(path)


def stored(spark: SparkSession, path: str, schema: str = "image_sha256 string, backbone string, policy_hash string, augment_hash string, view int, features array<float>, shard string") -> DataFrame:
    """The cache's rows, of a key that was stored twice one; files that can't be read count as missing."""
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(path).where(F.col("features").isNotNull())
    return rows.dropDuplicates(["shard", *KEY])


def looked_up(wanted: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted rows with their features, and those the cache lacks."""
    on = ["shard", *KEY]
    own = wanted.withColumn("shard", F.substring("image_sha256", 1, 2))
    return own.join(cache, on).drop("shard"), own.join(cache.select(*on), on, "left_anti").drop("shard")


def stats(cache: DataFrame) -> DataFrame:
    """Rows and bytes of features by backbone."""
    return cache.groupBy("backbone").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("features") * 4).alias("bytes"))


def in_batches(crops: DataFrame, load: Callable[[], Callable[[np.ndarray], np.ndarray]], size: int, batch: int = 32) -> DataFrame:
    """(image_sha256, crop, features) of crops (image_sha256, crop, rgb): the model gets full batches across images, the last one is smaller.

    ``load`` runs once per task and gives a function from (n, size, size, 3) bytes to (n, values).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        held: list[tuple[str, int, np.ndarray]] = []

        def drained() -> pa.RecordBatch:
            values = np.asarray(model(np.stack([x for _, _, x in held])), np.float32)
            return pa.RecordBatch.from_arrays([pa.array([h for h, _, _ in held]), pa.array([c for _, c, _ in held], pa.int32()), pa.array(list(values), pa.list_(pa.float32()))], ["image_sha256", "crop", "features"])

        for b in batches:
            for sha, crop, rgb in zip(*(b.column(c) for c in ("image_sha256", "crop", "rgb")), strict=True):
                held.append((sha.as_py(), crop.as_py(), np.frombuffer(rgb.as_buffer(), np.uint8).reshape(size, size, 3)))
                if len(held) == batch:
                    yield drained()
                    held = []
        if held:
            yield drained()

    return crops.select("image_sha256", "crop", "rgb").mapInArrow(run, "image_sha256 string, crop int, features array<float>")


def image_scores(crops: DataFrame, keys: tuple[str, ...] = ("entry_path",), logit: str = "logit", how: str = "mean") -> DataFrame:
    """A score for each image from its crops' logits: the mean or the greatest probability."""
    if how not in ("mean", "max"):
        raise ValueError(f"crops are joined by mean or max, not {how}")
    p = sigmoid(F.col(logit))
    whole = F.sum(F.round(p * 1_000_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000_000
    return crops.groupBy(*keys).agg(M.rounded(whole if how == "mean" else F.max(p)).alias("score"), F.count(F.lit(1)).alias("crops"))


def calibrated(z: Column, bias: float = 0.0, temperature: float = 1.0) -> Column:
    """A probability from a logit, moved and stretched."""
    return sigmoid((z + bias) / temperature)


TEMPERATURES = (0.05, 20.0)


def fit_calibration(crops: DataFrame, keys: tuple[str, ...] = ("entry_path",), logit: str = "logit", steps: int = 60) -> tuple[float, float]:
    """Bias and temperature that minimise the log loss of images' mean probabilities (rows: keys, logit, y), kept only if the calibration error does not rise.

    A pattern search over (bias, log temperature): each round tries a cross of points in one aggregate over images, whose rows are
    counted by the driver's five numbers only. With one label, or nothing better than no calibration, the answer is (0, 1).
    """
    rows = crops.select(*keys, F.col(logit).alias("z"), "y").cache()
    try:
        if rows.select("y").distinct().limit(2).count() < 2:
            return 0.0, 1.0

        def losses(points: list[tuple[float, float]]) -> list[float]:
            own = rows.groupBy(*keys).agg(F.first("y").alias("y"), *[F.avg(calibrated(F.col("z"), b, math.exp(t))).alias(f"p{i}") for i, (b, t) in enumerate(points)])
            clip = lambda i: F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col(f"p{i}")))
            return list(own.agg(*[F.avg(-(F.col("y") * F.ln(clip(i)) + (1 - F.col("y")) * F.ln(1 - clip(i)))) for i in range(len(points))]).first())

        def error(b: float, t: float) -> float:
            own = rows.groupBy(*keys).agg(F.first("y").alias("y"), F.avg(calibrated(F.col("z"), b, t)).alias("p"))
            return M.calibration_error(own, [], "p", y=F.col("y")).first()["ece"]

        low, high = (math.log(x) for x in TEMPERATURES)
        at, step, least = (0.0, 0.0), 1.0, losses([(0.0, 0.0)])[0]
        for _ in range(steps):
            tried = [(at[0] + step, at[1]), (at[0] - step, at[1]), (at[0], min(high, at[1] + step)), (at[0], max(low, at[1] - step))]
            found = losses(tried)
            best = min(range(4), key=lambda i: found[i])
            if found[best] < least - 1e-12:
                at, least = tried[best], found[best]
            else:
                step /= 2
                if step < 1e-3:
                    break
        bias, temperature = at[0], math.exp(at[1])
        return (bias, temperature) if error(bias, temperature) <= error(0.0, 1.0) else (0.0, 1.0)
    finally:
        rows.unpersist()


def head_logits(layers: np.ndarray, weights: dict[str, np.ndarray]) -> np.ndarray:
    """Logits of a multi-layer head over features (n, layers, values): each layer is normalised and projected, layers are summed by the softmax of
    their weights, and one hidden layer follows. weights: norm_scale and norm_shift (layers, values), project (layers, hidden, values) and project_bias
    (layers, hidden), mix (layers), hidden (m, hidden), hidden_bias (m), out (m), out_bias."""
    x = layers.astype(np.float64)
    centred = x - x.mean(-1, keepdims=True)
    x = centred / np.sqrt((centred**2).mean(-1, keepdims=True) + 1e-5) * weights["norm_scale"] + weights["norm_shift"]
    x = np.einsum("nlv,lhv->nlh", x, weights["project"]) + weights["project_bias"]
    share = np.exp(weights["mix"] - weights["mix"].max())
    h = np.einsum("nlh,l->nh", x, share / share.sum()) @ weights["hidden"].T + weights["hidden_bias"]
    erf = np.vectorize(math.erf, otypes=[float])
    h = h * 0.5 * (1 + erf(h / np.sqrt(2)))
    return h @ weights["out"] + weights["out_bias"]


def first_after_shuffle(entries: DataFrame, limit: int | None, seed: int = 0, key: str = "path") -> DataFrame:
    """A seeded sample of a run: the entries with the least hashes of seed and path, in lots, so that no task sorts them all."""
    if limit is None:
        return entries
    from .entries import _seeded, lowest

    named = entries.withColumns({"_digest": _seeded(seed, key), "_all": F.lit(0)})
    takes = entries.sparkSession.range(1).select(F.lit(0).alias("_all"), F.lit(limit).cast("long").alias("take"))
    return lowest(named, ["_all"], "_digest", key, takes).select(*entries.columns)
