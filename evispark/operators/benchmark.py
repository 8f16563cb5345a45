"""A benchmark run: entries with their files, every tool at every level, score and pixel records."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import codecs, localize, metadata, pixels
from ..schemas import PIXEL
from ..sources import images, scan
from . import rendering, tools
from .features import first_after_shuffle
from .fusion import CLIP, Fuser
from .suite import DEFAULT_SUITE, Level


@dataclass
class Run:
    """Score records, pixel records where masks and maps are at hand, and the paths without a file."""

    records: DataFrame
    pixels: DataFrame
    missing: DataFrame


def opened(spark: SparkSession, entries: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """The entries' images (entry_path, height, width, rgb, raw, error), and the entries without a file."""
    base = scan.qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), "content")
    wanted = entries.select("path").distinct()
    return images.open_images(files.join(wanted, "path", "left_semi")), wanted.join(files.select("path"), "path", "left_anti")


def score_records(scored: DataFrame, entries: DataFrame) -> DataFrame:
    """Records of tools with what the entries say; labels and groups are joined to records, not to images."""
    facts = entries.select(F.col("path").alias("entry_path"), "label", "source", "generator", "split")
    return scored.join(facts, "entry_path").select("entry_path", "label", "source", "generator", "split", "level", F.col("tool").alias("detector"), "score", "elapsed_ms")


def run(spark: SparkSession, entries: DataFrame, root: str, names: Sequence[str], levels: Sequence[Level] = DEFAULT_SUITE, limit: int | None = None, arguments: dict[str, dict] | None = None, seed: int = 0) -> Run:
    """Every tool on every entry at every level; ``limit`` takes a seeded sample of the entries first."""
    chosen = first_after_shuffle(entries, limit, seed)
    found, missing = opened(spark, chosen, root)
    records = score_records(tools.run_tools(found, names, levels, arguments), chosen)
    masked = chosen.where("mask_path is not null")
    masks = opened(spark, masked.select(F.col("mask_path").alias("path")), root)[0].select(F.col("entry_path").alias("mask_path"), F.col("rgb").alias("mask"), F.col("height").alias("mask_height"), F.col("width").alias("mask_width"))
    pairs = found.join(masked.select(F.col("path").alias("entry_path"), "mask_path"), "entry_path").join(masks, "mask_path")
    return Run(records, pixel_records(pairs, names, levels), missing)


def pixel_metrics(heat: np.ndarray, mask: np.ndarray, threshold: float = 0.5) -> dict[str, float]:
    """F1 and overlap of heat >= threshold, the best F1 over hundredths, and average precision; 0 where undefined."""
    y, p = mask.ravel().astype(bool), heat.ravel().astype(np.float64)
    positives = int(y.sum())

    def f1(said: np.ndarray) -> float:
        size = int(said.sum()) + positives
        return 2 * int((said & y).sum()) / size if size else 0.0

    said = p >= threshold
    union = int((said | y).sum())
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    ends = np.flatnonzero(np.append(np.diff(p[order]) != 0, True)) if len(p) else np.empty(0, int)
    taken = hits[ends]
    gained = np.diff(np.concatenate([[0], taken]))
    precision = taken / (ends + 1)
    best = 0.0
    for t in range(101) if positives else ():
        at = int(np.searchsorted(-p[order], -(t / 100), side="right"))
        best = max(best, 2 * (int(hits[at - 1]) if at else 0) / (at + positives))
    return {"f1_at_threshold": f1(said), "best_f1": best, "ap": float((gained * precision).sum() / positives) if positives else 0.0, "iou": int((said & y).sum()) / union if union else 0.0, "threshold": threshold}


def pixel_records(pairs: DataFrame, names: Sequence[str], levels: Sequence[Level]) -> DataFrame:
    """Pixel metrics of tools with maps on images (entry_path, height, width, rgb, mask, mask_height, mask_width), at levels that keep the geometry."""
    wanted = [tools.get(n).planned() for n in names if tools.get(n).category == "localizer"]
    kept = [x for x in levels if x.kind in ("clean", "jpeg", "webp", "gaussian_noise")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(t.name, t.kernel()) for t in wanted]
        for batch in batches:
            for part in images.slices(batch, "rgb"):
                rows = []
                for r in part.to_pylist():
                    if r["rgb"] is None or r["mask"] is None or (r["height"], r["width"]) != (r["mask_height"], r["mask_width"]):
                        continue
                    rgb = np.frombuffer(r["rgb"], np.uint8).reshape(r["height"], r["width"], 3)
                    mask = np.frombuffer(r["mask"], np.uint8).reshape(rgb.shape).max(-1) > 127
                    for level in kept:
                        seen = tools.perturb(rgb, level)
                        for name, kernel in ready if seen is not None else ():
                            try:
                                heat = kernel(seen).get("map") if kernel else None
                            except Exception:  # noqa: BLE001  its score record says what went wrong
                                continue
                            if heat is not None and heat.shape == mask.shape:
                                rows.append((r["entry_path"], name, level.name, pixel_metrics(heat, mask)))
                fields = [(f.name, pa.float64()) for f in PIXEL["metrics"].dataType]
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
                kinds = [pa.string(), pa.string(), pa.string(), pa.struct(fields)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["entry_path", "detector", "level", "metrics"])

    return pairs.select("entry_path", "height", "width", "rgb", "mask", "mask_height", "mask_width").mapInArrow(measured, PIXEL)


def analysed(data: bytes, names: Sequence[str]) -> str:
    """One image through kernels, as JSON: what a person asks of a single file."""
    try:
        rgb = codecs.pixels(data)
    except codecs.Unreadable as e:
        return json.dumps({"error": str(e)})
    return json.dumps(judged_image(rgb, data, names)[0], default=float, sort_keys=True)


#: Longest side of the pictures in a report.
PICTURE = 1600


def image_report(data: bytes, names: Sequence[str], out: str, name: str, model: Fuser | None = None) -> dict:
    """A folder about one image: report.json, report.md, and of each tool's map a picture and an overlay. ``out`` is a path or a URI."""
    system, base = fs.FileSystem.from_uri(out)
    system.create_dir(base, recursive=True)

    def put(file: str, content: bytes) -> str:
        with system.open_output_stream(f"{base}/{file}") as f:
            f.write(content)
        return file

    rgb = codecs.turned(codecs.pixels(data), metadata.read(data)["orientation"])
    found, maps = judged_image(rgb, data, names)
    step = max(1, -(-max(rgb.shape[:2]) // PICTURE))
    for n, heat in maps.items():
        found[n] |= {"heatmap": put(f"{n}_heatmap.png", pixels.png(heat)), "overlay": put(f"{n}_overlay.png", pixels.png_rgb(localize.overlay(rgb[::step, ::step], heat[::step, ::step])))}
    document = {"image": {"name": name, "width": rgb.shape[1], "height": rgb.shape[0], "format": codecs.kind_of(data), "sha256": hashlib.sha256(rgb.tobytes()).hexdigest()}, "tools": found}
    if model is not None:
        document["fusion"] = verdict({n: x["score"] for n, x in found.items()}, model)
    put("report.json", json.dumps(rendering.jsonable(document), indent=2, sort_keys=True).encode())
    facts = document["image"]
    lines = [f"# {name}", "", f"{facts['width']} x {facts['height']} {facts['format']}, pixels {facts['sha256'][:16]}", ""]
    if model is not None:
        lines += [f"**{document['fusion']['label']}**, probability {document['fusion']['probability']:.3f}", ""]
    lines += rendering.table(("tool", "score", "picture"), [(n, rendering.number(x["score"]), f"![{n}]({x['overlay']})" if "overlay" in x else "") for n, x in found.items()])
    put("report.md", "\n".join(lines).encode())
    return document


def judged_image(rgb: np.ndarray, data: bytes, names: Sequence[str]) -> tuple[dict[str, dict], dict[str, np.ndarray]]:
    """What kernels say of one image, and their maps."""
    said, maps = {}, {}
    for n in names:
        tool = tools.get(n)
        kernel = tool.kernel()
        try:
            got = (kernel(rgb, raw=data) if tool.encoded else kernel(rgb)) if kernel else {"score": tools.ABSTAIN, "reason": tool.note or "a plan of its own"}
            said[n] = {"score": float(got["score"])} | {k: v for k, v in got.items() if isinstance(v, (int, float, str)) and k != "score"}
            if got.get("map") is not None and got["map"].shape == rgb.shape[:2]:
                maps[n] = got["map"]
        except Exception as e:  # noqa: BLE001
            said[n] = {"score": tools.ABSTAIN, "error": str(e) or type(e).__name__}
    return said, maps


def verdict(scores: dict[str, float], model: Fuser) -> dict:
    """The fused verdict of one image's scores; detectors without one count as abstaining."""

    def log_odds(s: float | None) -> float:
        p = min(max(s, CLIP), 1 - CLIP) if s is not None else 0.5
        return 0.0 if s is None or s == 0.5 else math.log(p / (1 - p))

    parts = [(d, model.weights[2 * i] * log_odds(scores.get(d)), model.weights[2 * i + 1] * (d in scores)) for i, d in enumerate(model.detectors)]
    z = model.bias + sum(a + b for _, a, b in parts)
    p = 1 / (1 + math.exp(-z / model.temperature))
    label = "uncertain" if model.low <= p <= model.high else "fake" if p > model.high else "real"
    moved = [{"detector": d, "score": scores.get(d), "weight": model.weights[2 * model.detectors.index(d)], "contribution": a, "present": d in scores} for d, a, _ in sorted(parts, key=lambda x: -abs(x[1]))]
    return {"probability": p, "label": label, "band": {"low": model.low, "high": model.high}, "contributions": moved}
