"""Fusion of detectors: features, hold-out split, logistic stacking, temperature, abstain band, prediction."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M

CLIP = 1e-4
HOLDOUT_PREFIX = "3333333333333333"  # a fifth of 2**64
TRIVIAL = ("random", "signals_mean")


def logit(score: Column) -> Column:
    """Log odds of the clipped score; exactly 0 at 0.5, which means abstention."""
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), score))
    return F.when(score == 0.5, 0.0).when(score.isNotNull(), F.ln(p / (1 - p)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def default_detectors(df: DataFrame) -> DataFrame:
    """The detectors without trivial baselines."""
    name = F.col("detector")
    return df.select("detector").distinct().where(~name.startswith("constant_") & ~name.isin(*TRIVIAL))


def features(df: DataFrame, detectors: Sequence[str], order: str = "score", scores: bool = False) -> DataFrame:
    """One row for each (entry, level): label, and logit and presence of each detector, 0 where it is missing. Of several records the last in ``order`` counts.

    With ``scores`` also each detector's score (score_<detector>), null where it is missing.
    """
    wide = df.groupBy("entry_path", "level").agg(F.min("label").alias("label"), *[F.max_by(F.when(F.col("detector") == d, F.col("score")), F.when(F.col("detector") == d, F.col(order))).alias(f"s_{d}") for d in detectors])
    cols = [c for d in detectors for c in (F.coalesce(logit(F.col(f"s_{d}")), F.lit(0.0)).alias(f"logit_{d}"), F.col(f"s_{d}").isNotNull().cast("int").alias(f"has_{d}"))]
    return wide.select("entry_path", "level", "label", *cols, *[F.col(f"s_{d}").alias(f"score_{d}") for d in detectors if scores])


def held_out(seed: int, path: str = "entry_path") -> Column:
    """A fifth of the paths, all levels of one on the same side."""
    return F.substring(F.sha2(F.concat(F.col(path), F.lit(f":{seed}")), 256), 1, 16) <= HOLDOUT_PREFIX


def class_weights(df: DataFrame) -> DataFrame:
    """(label, weight): n / (2 * n of the label)."""
    c = df.groupBy("label").agg(F.count(F.lit(1)).alias("m"))
    return c.select("label", M.rounded(F.sum("m").over(Window.partitionBy(F.lit(0))) / (2 * F.col("m"))).alias("weight"))


@dataclass
class Fuser:
    """A fitted fusion model."""

    detectors: list[str]
    weights: list[float]  # logit and presence of each detector in turn
    bias: float = 0.0
    temperature: float = 1.0
    low: float = 0.5
    high: float = 0.5
    provenance: dict = field(default_factory=dict)

    def logit(self) -> Column:
        z = F.lit(self.bias)
        for i, d in enumerate(self.detectors):
            z = z + self.weights[2 * i] * F.col(f"logit_{d}") + self.weights[2 * i + 1] * F.col(f"has_{d}")
        return z

    def probability(self) -> Column:
        return sigmoid(self.logit() / self.temperature)

    def label(self, p: Column) -> Column:
        return F.when((p >= self.low) & (p <= self.high), "uncertain").when(p > self.high, "fake").otherwise("real")

    def explain(self) -> Column:
        """Contributions of the detectors' logits, the greatest first; ties in the detectors' order."""
        parts = [F.struct((-F.abs(F.lit(self.weights[2 * i]) * F.col(f"logit_{d}"))).alias("size"), F.lit(i).alias("i"), F.lit(d).alias("detector"), (F.lit(self.weights[2 * i]) * F.col(f"logit_{d}")).alias("value")) for i, d in enumerate(self.detectors)]
        return F.transform(F.array_sort(F.array(*parts)), lambda x: F.struct(x["detector"].alias("detector"), x["value"].alias("value")))

    def dumps(self) -> str:
        return json.dumps({"version": 2} | asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> Fuser:
        """Of either version; the first had no temperature, band and provenance."""
        d = json.loads(text)
        return cls(**{k: d[k] for k in cls.__dataclass_fields__ if k in d})


def _linear(at: np.ndarray, columns: Sequence[str]) -> Column:
    z = F.lit(float(at[-1]))
    for w, c in zip(at, columns, strict=False):
        z = z + float(w) * F.col(c)
    return z


def _log_loss(z: Column) -> Column:
    clip = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), sigmoid(z)))
    return -(F.col("y") * F.ln(clip) + (1 - F.col("y")) * F.ln(1 - clip)) * F.col("w")


def _penalty(at: np.ndarray, l2: float) -> float:
    return l2 / 2 * float((at[:-1] ** 2).sum())


def loss_and_gradient(df: DataFrame, columns: Sequence[str], at: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """Weighted log loss and its gradient at (weights, bias): one aggregate over the rows, of which the driver gets one."""
    z = _linear(at, columns)
    off = F.col("w") * (sigmoid(z) - F.col("y"))
    row = df.agg(F.sum("w"), F.sum(_log_loss(z)), *[F.sum(off * F.col(c)) for c in columns], F.sum(off)).first()
    g = np.asarray(row[2:], float) / row[0]
    g[:-1] += l2 * at[:-1]
    return row[1] / row[0] + _penalty(at, l2), g


#: Step sizes that backtracking tries, from the largest on.
STEPS = tuple(0.5**i for i in range(30))


def losses_along(df: DataFrame, columns: Sequence[str], at: np.ndarray, g: np.ndarray, l2: float) -> list[float]:
    """The loss after each of STEPS against the gradient, all in one aggregate."""
    named = df.select("w", "y", _linear(at, columns).alias("_z"), _linear(g, columns).alias("_d"))
    row = named.agg(F.sum("w"), *[F.sum(_log_loss(F.col("_z") - s * F.col("_d"))) for s in STEPS]).first()
    return [x / row[0] + _penalty(at - s * g, l2) for s, x in zip(STEPS, row[1:], strict=True)]


def fit_logistic(df: DataFrame, columns: Sequence[str], l2: float = 0.01, steps: int = 300, tolerance: float = 1e-6) -> np.ndarray:
    """Gradient descent with backtracking from zero, over rows with y and w: two aggregates a step. Equal rows are counted first."""
    rows = df.groupBy(*columns, "y").agg(F.sum("w").alias("w")).cache()
    at = np.zeros(len(columns) + 1)
    try:
        loss, g = loss_and_gradient(rows, columns, at, l2)
        for _ in range(steps):
            tried = zip(STEPS, losses_along(rows, columns, at, g, l2), strict=True)
            found = next(((s, x) for s, x in tried if x <= loss - 1e-4 * s * float(g @ g)), None)
            if found is None:
                break
            before, at = loss, at - found[0] * g
            loss, g = loss_and_gradient(rows, columns, at, l2)
            if abs(before - loss) < tolerance:
                break
        return at
    finally:
        rows.unpersist()


def temperature_grid() -> list[float]:
    """400 values from 0.05 to 20, evenly apart by logarithm, and 1."""
    return [*(0.05 * 400 ** (i / 399) for i in range(400)), 1.0]


def temperatures(df: DataFrame, z: str = "z", grid: Sequence[float] | None = None) -> DataFrame:
    """(t, nll) for each temperature: distinct logits are counted before they meet the grid."""
    steps = df.groupBy(z, "y").agg(F.count(F.lit(1)).alias("m"))
    tried = steps.select(F.col(z).alias("z"), "y", "m", F.explode(F.array(*map(F.lit, grid or temperature_grid()))).alias("t"))
    p = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), sigmoid(F.col("z") / F.col("t"))))
    nll = -(F.col("y") * F.ln(p) + (1 - F.col("y")) * F.ln(1 - p))
    return tried.groupBy("t").agg((F.sum(F.col("m") * F.round(nll * 1e9).cast("long")) / F.sum("m") / 1e9).alias("nll"))


def best_temperature(df: DataFrame, z: str = "z") -> DataFrame:
    return temperatures(df, z).agg(F.min(F.struct(F.round("nll", 8).alias("nll"), F.abs(F.col("t") - 1).alias("d"), F.col("t"))).alias("x")).select(F.round("x.t", 9).alias("t"), "x.nll")


def outside_floor(n: int, fraction: float = 0.1, count: int = 20) -> int:
    return min(max(count, math.ceil(fraction * n)), n)


def band_candidates(df: DataFrame, prob: str = "p") -> DataFrame:
    """For each pair low <= high of hundredths: what lies outside the band and how well it is told apart.

    Rows become two grid places each, so that the 5,151 pairs meet 101 running totals and no rows.
    """
    grid = F.array(*[F.lit(i / 100) for i in range(101)])
    place = df.select("y", F.size(F.filter(grid, lambda g: g <= F.col(prob))).alias("lo"), F.size(F.filter(grid, lambda g: g < F.col(prob))).alias("hi"))
    c = place.groupBy("lo", "hi").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spark = df.sparkSession
    i = spark.range(101).select(F.col("id").cast("int").alias("i"))
    below = i.join(c, F.col("lo") <= F.col("i"), "left").groupBy("i").agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos_below"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg_below"))
    above = i.join(c, F.col("hi") > F.col("i"), "left").groupBy(F.col("i").alias("j")).agg(F.coalesce(F.sum("pos"), F.lit(0)).alias("pos_above"), F.coalesce(F.sum("neg"), F.lit(0)).alias("neg_above"))
    pairs = below.join(above, F.col("i") <= F.col("j"))
    pos, neg = F.col("pos_below") + F.col("pos_above"), F.col("neg_below") + F.col("neg_above")
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return pairs.select("i", "j", (pos + neg).alias("outside"), M.rounded((rate(F.col("pos_above"), pos) + rate(F.col("neg_below"), neg)) / 2).alias("bacc"))


def abstain_band(df: DataFrame, target: float = 0.9, prob: str = "p", floor: int | None = None) -> DataFrame:
    """One row (low, high, outside, bacc, target_met): the widest band that meets the target, else the most accurate, narrowest one."""
    least = outside_floor(df.count()) if floor is None else floor
    c = band_candidates(df, prob).where((F.col("outside") > 0) & (F.col("outside") >= least))
    width = F.col("j") - F.col("i")
    good = F.max(F.when(F.col("bacc") >= target, F.struct(width.alias("w"), F.col("bacc"), (-F.col("i")).alias("l"), "j", "outside")))
    any_ = F.max(F.struct("bacc", (-width).alias("w"), (-F.col("i")).alias("l"), "j", "outside"))
    x = c.agg(good.alias("g"), any_.alias("a")).select(F.col("g").isNotNull().alias("met"), "g", "a")
    pick = lambda f: F.when(F.col("met"), F.col(f"g.{f}")).otherwise(F.col(f"a.{f}"))
    return x.select(F.coalesce(-pick("l") / 100, F.lit(0.5)).alias("low"), F.coalesce(pick("j") / 100, F.lit(0.5)).alias("high"), F.coalesce(pick("outside"), F.lit(0)).alias("outside"), F.coalesce(pick("bacc"), F.lit(0.0)).alias("bacc"), F.col("met").alias("target_met"))


def fit_fuser(records: DataFrame, detectors: Sequence[str], *, levels: Sequence[str] = ("clean",), l2: float = 0.01, target: float = 0.9, seed: int = 0, steps: int = 300) -> Fuser:
    """Stacks the detectors on four fifths of the images; temperature and band come from the rest."""
    names = sorted(detectors)
    rows = features(records.where(F.col("level").isin(*levels)), names).withColumn("y", M.is_fake()).withColumn("held", held_out(seed))
    train, rest = rows.where("not held"), rows.where("held")
    for side in (train, rest):
        if side.select("y").distinct().limit(2).count() < 2:
            raise ValueError("both labels are needed on either side of the split")
    weights = {r["label"]: r["weight"] for r in class_weights(train).collect()}  # two rows
    weighted = train.withColumn("w", F.when(F.col("y") == 1, weights["fake"]).otherwise(weights["real"]))
    columns = [c for d in names for c in (f"logit_{d}", f"has_{d}")]
    at = fit_logistic(weighted, columns, l2, steps)
    model = Fuser(names, [float(x) for x in at[:-1]], float(at[-1]), provenance={"seed": seed, "l2": l2, "levels": list(levels)})
    scored = rest.select("y", model.logit().alias("z"))
    t = best_temperature(scored).first()["t"]
    error = lambda temp: M.calibration_error(scored.withColumn("p", sigmoid(F.col("z") / temp)), [], "p", y=F.col("y")).first()["ece"]
    model.temperature = float(t) if error(t) <= error(1.0) else 1.0
    band = abstain_band(rest.select("y", model.probability().alias("p")), target).first()
    model.low, model.high = band["low"], band["high"]
    model.provenance |= {"outside": band["outside"], "bacc": band["bacc"], "target_met": band["target_met"]}
    return model


def evaluate(records: DataFrame, model: Fuser, fixed: float = 0.5) -> DataFrame:
    """Rows (level, scorer): each detector on the images it scored, ``fused`` on all, ``fused_outside_band`` where the model decides."""
    y = M.is_fake()
    own = records.where(F.col("detector").isin(*model.detectors)).select("level", F.col("detector").alias("scorer"), "label", "score")
    f = features(records, model.detectors).withColumn("score", M.rounded(model.probability())).select("level", "label", "score")
    fused = f.withColumn("scorer", F.lit("fused"))
    outside = f.where((F.col("score") < model.low) | (F.col("score") > model.high)).withColumn("scorer", F.lit("fused_outside_band"))
    rows = own.unionByName(fused).unionByName(outside)
    keys = ["level", "scorer"]
    return M.at_threshold(rows, keys, F.lit(fixed), y=y).join(M.auc(M.curve(rows, keys), keys), keys).select(*keys, F.col("total").alias("n"), "auc", "balanced_accuracy", "tpr", "fpr")
