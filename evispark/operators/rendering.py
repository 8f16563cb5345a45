"""Reports as Markdown and JSON. Tables come from small aggregates (a row for each detector, level, group or bucket), which the driver may hold."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Sequence
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import audit, reports
from .fusion import Fuser


def jsonable(value: Any) -> Any:
    """A value as JSON knows it: arrays as lists, bytes as text, infinities and NaN as null, keys as text."""
    if isinstance(value, dict):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, np.ndarray):
        return jsonable(value.tolist())
    if isinstance(value, (list, tuple, set, frozenset)):
        return [jsonable(v) for v in (sorted(value, key=repr) if isinstance(value, (set, frozenset)) else value)]
    if isinstance(value, np.generic):
        return jsonable(value.item())
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).decode("utf-8", "replace")
    if isinstance(value, float):
        return value if np.isfinite(value) else None
    return value if value is None or isinstance(value, (bool, int, str)) else str(value)


def number(value: float | None, places: int = 3) -> str:
    return "-" if value is None else f"{value:.{places}f}"


def table(head: Sequence[str], rows: Iterable[Sequence[Any]]) -> list[str]:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return lines + ["| " + " | ".join(map(str, r)) + " |" for r in rows] + [""]


def _rows(df: DataFrame, *by: str) -> list:
    return df.orderBy(*by).collect()


def benchmark_markdown(name: str, records: DataFrame, pixels: DataFrame | None = None, levels: Sequence[str] = reports.LEVELS, fixed: float = reports.FIXED_THRESHOLD, missing: int = 0, caveat: str | None = None) -> str:
    """All tables of a run in a fixed order: what was run, image metrics, robustness, groups, pixels, times."""
    # all tables but the number of entries come from counts of the records, which are no more than these and mostly far fewer
    count = records.select("entry_path").distinct().count()
    kinds = ("detector", "level", "split", "generator", "source", "label", "score")
    records = records.groupBy(*kinds).agg(F.count(F.lit(1)).alias("weight"), F.sum("elapsed_ms").alias("ms"), F.count("elapsed_ms").alias("timed")).persist()
    try:
        seen = [r["level"] for r in records.select("level").distinct().orderBy(reports.level_order(F.col("level"), levels), "level").collect()]
        lines = [f"# Benchmark report: {name}", "", f"- Entries evaluated: {count}", f"- Robustness levels: {', '.join(seen)}", f"- Fixed threshold: {fixed:g}"]
        lines += [f"- Threshold caveat: {caveat}"] * bool(caveat) + [f"- Missing files: {missing}"] * bool(missing) + [""]

        body = []
        for r in _rows(reports.image_table(records, fixed=fixed), "detector"):
            if r["note"]:
                body.append((r["detector"], "-", r["note"], *[""] * 7))
                continue
            rest = (number(r["ece"]), number(r["brier"]))
            body.append((r["detector"], "fixed", *map(number, (r["auc"], r["average_precision"], r["accuracy"], r["balanced_accuracy"], r["fpr"], r["tpr"])), *rest))
            body.append((r["detector"], f"tuned {r['tuned_threshold']:g}", number(r["auc"]), number(r["average_precision"]), "-", number(r["tuned_balanced_accuracy"]), number(r["tuned_fpr"]), "-", *rest))
        lines += ["## Image metrics (clean)", "", *table(("detector", "threshold", "auc", "ap", "accuracy", "balanced_accuracy", "fpr", "tpr", "ece", "brier"), body)]

        robust = _rows(reports.robustness_table(records, levels).where("n > 0"), "detector", "ordinal", "level")
        body = [(r["detector"], r["level"], number(r["auc"]), number(r["balanced_accuracy"]) if r["auc"] is not None else "one label only") for r in robust]
        lines += ["## Robustness (AUC and balanced accuracy at the fixed threshold)", "", *table(("detector", "level", "auc", "balanced_accuracy"), body)]
        for key in ("generator", "source"):
            groups = _rows(reports.per_group_table(records, key), "detector", "group")
            if groups:
                lines += [f"## AUC by {key} (clean)", "", *table(("detector", key, "auc"), [(r["detector"], r["group"], number(r["auc"]) if r["auc"] is not None else "one label only") for r in groups])]
        if pixels is not None:
            found = _rows(reports.pixel_table(pixels), "detector", reports.level_order(F.col("level"), levels), "level")
            if found:
                head = ("detector", "level", "n", "mean f1@0.5", "mean best-f1", "mean ap", "mean iou")
                lines += ["## Pixel metrics", "", *table(head, [(r["detector"], r["level"], r["n"], *map(number, (r["f1_at_threshold"], r["best_f1"], r["ap"], r["iou"]))) for r in found])]
        times = records.groupBy("detector").agg(F.round(F.sum("ms") / F.nullif(F.sum("timed"), F.lit(0)), 5).alias("ms"), F.sum("timed").alias("n"))
        lines += ["## Timing", "", *table(("detector", "n", "mean elapsed_ms"), [(r["detector"], r["n"], number(r["ms"], 2)) for r in _rows(times, "detector")])]
        return "\n".join(lines)
    finally:
        records.unpersist()


def save_result(records: DataFrame, pixels: DataFrame | None, path: str, meta: dict[str, Any]) -> None:
    """A run's records and what its tables need besides: Parquet below ``path``, and one JSON line of facts."""
    records.write.mode("overwrite").partitionBy("level").parquet(f"{path}/records")
    if pixels is not None:
        pixels.write.mode("overwrite").parquet(f"{path}/pixel_records")
    spark = records.sparkSession
    spark.createDataFrame([(json.dumps(jsonable(meta), sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def fusion_markdown(evaluation: DataFrame, levels: Sequence[str] = reports.LEVELS) -> str:
    """A table for each level, detectors by name, the fused scorers last."""
    last = F.when(F.col("scorer") == "fused", 1).when(F.col("scorer") == "fused_outside_band", 2).otherwise(0)
    rows = evaluation.withColumn("_l", reports.level_order(F.col("level"), levels)).orderBy("_l", "level", last, "scorer").drop("_l").collect()
    lines: list[str] = []
    for level in dict.fromkeys(r["level"] for r in rows):
        body = [(r["scorer"], r["n"], *map(number, (r["auc"], r["balanced_accuracy"], r["fpr"], r["tpr"]))) for r in rows if r["level"] == level]
        lines += [f"## Level: {level}", "", *table(("scorer", "n", "auc", "balanced_accuracy", "fpr", "tpr"), body)]
    return "\n".join(lines)


def audit_markdown(entries: DataFrame) -> str:
    """The problems, then a table of buckets by label for each axis."""
    problems = _rows(audit.report(entries), "problem", "detail")
    lines = ["# Bias audit report", ""]
    lines += ["No problems found.", ""] if not problems else [f"**{len(problems)} problem(s) found:**", "", *[f"- {r['problem']}: {r['detail']}" for r in problems], ""]
    wide = audit.histograms(entries).groupBy("axis", "bucket").pivot("label", ["fake", "real"]).sum("n").na.fill(0)
    found = _rows(wide, "axis", "bucket")
    for axis in dict.fromkeys(r["axis"] for r in found):
        lines += [f"## {axis}", "", *table(("bucket", "fake", "real"), [(r["bucket"], r["fake"], r["real"]) for r in found if r["axis"] == axis])]
    return "\n".join(lines)


def fusion_payload(features: DataFrame, model: Fuser, records: DataFrame | None = None, note: Callable[[str], str] | None = None) -> DataFrame:
    """(entry_path, level, payload): the fused verdict of every image as JSON: probability, label, band, and what each detector moved, the most first.

    Without records the features have the scores themselves, so that nothing is grouped again or joined.
    """
    if records is None:
        own = F.create_map(*[x for d in model.detectors for x in (F.lit(d), F.col(f"score_{d}"))])
        joined = features.withColumn("scores", F.map_filter(own, lambda _, v: v.isNotNull()))
    else:
        each = records.where(F.col("detector").isin(*model.detectors)).groupBy("entry_path", "level", "detector").agg(F.max("score").alias("score"))  # of several the one that the features use
        scores = each.groupBy("entry_path", "level").agg(F.map_from_entries(F.collect_list(F.struct("detector", "score"))).alias("scores"))
        joined = features.join(scores, ["entry_path", "level"], "left")
    p = model.probability()
    weight = F.create_map(*[y for i, d in enumerate(model.detectors) for y in (F.lit(d), F.lit(float(model.weights[2 * i])))])
    notes = F.create_map(*[y for d in model.detectors for y in (F.lit(d), F.lit(note(d) if note else ""))])
    moved = F.transform(
        model.explain(),
        lambda c: F.struct(
            c["detector"].alias("detector"), F.element_at("scores", c["detector"]).alias("score"), F.element_at(weight, c["detector"]).alias("weight"), c["value"].alias("contribution"),
            F.coalesce(F.map_contains_key("scores", c["detector"]), F.lit(False)).alias("present"), F.element_at(notes, c["detector"]).alias("note"),
        ),
    )
    payload = F.struct(F.round(p, 9).alias("probability"), model.label(p).alias("label"), F.struct(F.lit(model.low).alias("low"), F.lit(model.high).alias("high")).alias("band"), moved.alias("contributions"))
    return joined.select("entry_path", "level", F.to_json(payload).alias("payload"))


__all__ = ["audit_markdown", "benchmark_markdown", "fusion_markdown", "fusion_payload", "jsonable", "save_result", "table"]
