"""Crops: where they lie (columns), what they hold (kernels), datasets cut to squares, and augmentation for training."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels import pixels, signals
from ..sources.images import slices

ALIGN = 16
# Means and deviations of the channels that backbones expect
CHANNEL_MEAN, CHANNEL_STD = (0.485, 0.456, 0.406), (0.229, 0.224, 0.225)


def _fingerprint(policy: object) -> str:
    return hashlib.sha256(json.dumps(asdict(policy), sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:12]


@dataclass(frozen=True)
class CropPolicy:
    """How an image becomes squares of its own resolution."""

    size: int = 224
    mode: str = "grid"  # center, grid or random
    max_crops: int = 4
    seed: int = 0
    min_side_pad: bool = True

    def __post_init__(self) -> None:
        if self.mode not in ("center", "grid", "random"):
            raise ValueError(f"mode must be center, grid or random, not {self.mode}")
        if self.size <= 0 or self.max_crops <= 0:
            raise ValueError("size and max_crops must be positive")

    def fingerprint(self) -> str:
        """Twelve digits that depend on the values alone."""
        return _fingerprint(self)


def grid_boxes(height: Column, width: Column, policy: CropPolicy) -> Column:
    """Corners (top, left) of a grid's whole tiles, the nearest to the centre first, ties from the top left: an array of structs."""
    size = policy.size
    h, w = F.greatest(height, F.lit(size)), F.greatest(width, F.lit(size))
    starts = lambda n: F.sequence(F.lit(0), n - size, F.lit(size))
    # twice the distances, so that all stay whole numbers
    off = lambda at, n: F.pow(2 * at + size - n, F.lit(2)).cast("long")
    cells = F.flatten(F.transform(starts(h), lambda y: F.transform(starts(w), lambda x: F.struct((off(y, h) + off(x, w)).alias("far"), y.alias("top"), x.alias("left")))))
    return F.transform(F.slice(F.array_sort(cells), 1, policy.max_crops), lambda c: F.struct(c["top"].alias("top"), c["left"].alias("left")))


def crop_boxes(images: DataFrame, policy: CropPolicy, height: str = "height", width: str = "width") -> DataFrame:
    """A row for each crop of an image: its number and its place in the image itself, cut at the edges.

    Crops of a padded image are laid in the padding's frame and moved back, so one that lies in the padding alone is empty. Random
    crops depend on the pixels' hash (``pixel_sha256``) and the policy's seed.
    """
    size = policy.size
    h, w = F.col(height), F.col(width)
    ph, pw = F.greatest(h, F.lit(size)), F.greatest(w, F.lit(size))
    if not policy.min_side_pad:
        small = F.least(h, w) < size
        h = F.when(small, F.raise_error(F.concat(F.lit("smaller than a crop: "), h, F.lit(" x "), w))).otherwise(h)
    if policy.mode == "center":
        corners = F.array(F.struct(F.floor((ph - size) / 2).cast("int").alias("top"), F.floor((pw - size) / 2).cast("int").alias("left")))
    elif policy.mode == "grid":
        corners = grid_boxes(F.col(height), F.col(width), policy)
    else:
        draw = lambda i, axis, n: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", "pixel_sha256", F.lit(policy.seed), i.cast("string"), F.lit(axis)), 256), 1, 12), 16, 10).cast("long"), (n - size + 1).cast("long")).cast("int")
        corners = F.transform(F.sequence(F.lit(0), F.lit(policy.max_crops - 1)), lambda i: F.struct(draw(i, "y", ph).alias("top"), draw(i, "x", pw).alias("left")))
    placed = images.select("*", F.posexplode(corners).alias("crop", "c"))
    inside = lambda v, n: F.greatest(F.lit(0), F.least(v, n))
    top, left = F.col("c.top") - F.floor((ph - F.col(height)) / 2).cast("int"), F.col("c.left") - F.floor((pw - F.col(width)) / 2).cast("int")
    box = {"box_top": inside(top, h), "box_left": inside(left, w), "box_bottom": inside(top + size, h), "box_right": inside(left + size, w)}
    out = placed.select(*images.columns, "crop", *[v.cast("int").alias(k) for k, v in box.items()])
    return out.select(*images.columns, "crop", F.col("box_top").alias("top"), F.col("box_left").alias("left"), (F.col("box_bottom") - F.col("box_top")).alias("box_height"), (F.col("box_right") - F.col("box_left")).alias("box_width"))


def window(at: int, size: int, length: int) -> tuple[int, int]:
    """Start and length of the stretch of twice a crop's size around it, on the coding grid where the edge allows."""
    span = min(2 * size, length)
    start = (at - (span - size) // 2) // ALIGN * ALIGN
    return max(0, min(start, length - span)), span


def sample_offset(length: int, size: int, rng: np.random.Generator, cover: int | None = None, align: int = ALIGN) -> int:
    """A start on the grid, evenly among all (that cover a place); where none does, the last one that covers it."""
    if length <= size:
        return 0
    low = 0 if cover is None else max(0, cover - size + 1)
    high = length - size if cover is None else min(length - size, cover)
    first = (low + align - 1) // align
    last = high // align
    return align * (first + int(rng.integers(0, last - first + 1))) if first <= last else high


def sample_crop_box(height: int, width: int, size: int, rng: np.random.Generator, contains: tuple[int, int] | None = None, align: int = ALIGN) -> tuple[int, int]:
    y, x = contains or (None, None)
    return sample_offset(height, size, rng, y, align), sample_offset(width, size, rng, x, align)


def to_array(crops: Sequence[np.ndarray]) -> np.ndarray:
    """Squares as a batch of planes (n, 3, size, size), each channel centred and scaled."""
    stack = np.stack([c.astype(np.float32) for c in crops]) / 255
    return np.ascontiguousarray(((stack - np.float32(CHANNEL_MEAN)) / np.float32(CHANNEL_STD)).transpose(0, 3, 1, 2))


def target_rows(entries: DataFrame, size: int, mode: str, labels: Sequence[str] | None = None, min_side: int | None = None) -> DataFrame:
    """The entries that cutting a dataset to squares gives, with (source_path, job, top, left): cropped, passthrough or copied.

    Entries with other labels are copied, and those too small pass through; of the rest each gives its centre, or all whole tiles in
    rows from the top. Masks are not cut and go. Several entries whose names differ in the extension alone give one name: an error.
    """
    if mode not in ("center", "tiles"):
        raise ValueError(f"mode must be center or tiles, not {mode}")
    if size <= 0:
        raise ValueError("size must be positive")
    floor = size if min_side is None else max(size, min_side)
    chosen = F.lit(True) if labels is None else F.col("label").isin(*labels)
    job = F.when(~chosen, "copied").when(F.least("width", "height") < floor, "passthrough").otherwise("cropped")
    centre = F.array(F.struct(F.lit(None).cast("int").alias("tile"), F.floor((F.col("height") - size) / 2).cast("int").alias("top"), F.floor((F.col("width") - size) / 2).cast("int").alias("left")))
    across = F.floor(F.col("width") / size).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor(F.col("height") / size).cast("int") * across - 1)), lambda i: F.struct(i.alias("tile"), (F.floor(i / across).cast("int") * size).alias("top"), ((i % across) * size).alias("left")))
    whole = F.array(F.struct(F.lit(None).cast("int").alias("tile"), F.lit(None).cast("int").alias("top"), F.lit(None).cast("int").alias("left")))
    x = entries.withColumn("job", job).withColumn("c", F.explode(F.when(F.col("job") == "cropped", centre if mode == "center" else tiles).otherwise(whole)))
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    name = F.when(F.col("job") != "cropped", F.col("path")).when(F.col("c.tile").isNull(), F.concat(stem, F.lit(".png"))).otherwise(F.concat(stem, F.lit("_t"), F.lpad(F.col("c.tile").cast("string"), F.greatest(F.lit(2), F.length(F.col("c.tile").cast("string"))), "0"), F.lit(".png")))
    asked = F.col("job") != "copied"
    facts = {"source_path": F.col("path"), "original_width": F.col("width").cast("string"), "original_height": F.col("height").cast("string"), "crop_mode": F.when(asked, mode), "crop_size": F.when(asked, str(size)), "tile_index": F.col("c.tile").cast("string")}
    extra = F.map_concat(F.coalesce("extra", F.create_map().cast("map<string,string>")), F.map_filter(F.create_map(*[y for k, v in facts.items() for y in (F.lit(k), v)]), lambda _, v: v.isNotNull()))
    cut = F.col("job") == "cropped"
    return x.select(
        name.alias("path"), "label", "source", "generator", "split", F.lit(None).cast("string").alias("mask_path"), F.when(cut, size).otherwise(F.col("width")).alias("width"), F.when(cut, size).otherwise(F.col("height")).alias("height"),
        F.when(cut, "PNG").otherwise(F.col("format")).alias("format"), F.when(~cut, F.col("jpeg_quality")).alias("jpeg_quality"), extra.alias("extra"), F.col("path").alias("source_path"), "job", "c.top", "c.left",
    )


def crop_report(targets: DataFrame) -> DataFrame:
    """Counts of source entries and of rows by job."""
    return targets.groupBy("job").agg(F.countDistinct("source_path").alias("entries"), F.count(F.lit(1)).alias("rows"))


def cut_images(opened: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """(path, content): the files of a cut dataset; opened: (entry_path, height, width, rgb, raw). Crops are lossless PNGs, the rest keep their bytes."""
    boxes = targets.groupBy("source_path").agg(F.collect_list(F.struct("path", "job", "top", "left")).alias("boxes"))  # as many as an image has tiles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "rgb"):
                names, files = [], []
                for i in range(part.num_rows):
                    h, w, rgb, raw = (part.column(c)[i].as_py() for c in ("height", "width", "rgb", "raw"))
                    a = None if rgb is None else np.frombuffer(rgb, np.uint8).reshape(h, w, 3)
                    for box in part.column("boxes")[i].as_py():
                        if box["job"] != "cropped":
                            names.append(box["path"])
                            files.append(raw)
                        elif a is not None:
                            names.append(box["path"])
                            files.append(pixels.png_rgb(a[box["top"] : box["top"] + size, box["left"] : box["left"] + size]))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(files, pa.binary())], ["path", "content"])

    joined = opened.join(boxes, F.col("entry_path") == F.col("source_path")).select("height", "width", "rgb", "raw", "boxes")
    return joined.mapInArrow(run, "path string, content binary")


@dataclass(frozen=True)
class Augmentation:
    """What training images may undergo: a range for each kind, None to leave it out, and how often."""

    jpeg_quality: tuple[int, int] | None = None
    webp_quality: tuple[int, int] | None = None
    gaussian_blur_sigma: tuple[float, float] | None = None
    downscale_upscale: tuple[float, float] | None = None
    noise_sigma: tuple[float, float] | None = None
    cutout: dict[str, int] | None = None
    p: float = 0.5
    probabilities: dict[str, float] = field(default_factory=dict)

    def rate(self, kind: str) -> float:
        return float(self.probabilities.get(kind, self.p))

    def fingerprint(self) -> str:
        return _fingerprint(self)


def blurred(rgb: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * max(sigma, 1e-6) ** 2))
    kernel /= kernel.sum()
    out = rgb.astype(np.float32)
    for axis in (0, 1):
        padded = np.pad(out, [(reach, reach) if i == axis else (0, 0) for i in range(3)], mode="edge")
        n = out.shape[axis]
        out = sum(k * np.take(padded, np.arange(i, i + n), axis) for i, k in enumerate(kernel))
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def augment(rgb: np.ndarray, config: Augmentation, rng: np.random.Generator) -> np.ndarray:
    """The image after those kinds that the draw picks, in a fixed order; each kind that is set takes one draw, whether it is picked or not.

    Kinds without a codec here (webp) take their draws and change nothing.
    """
    from .tools import resized

    def down_up(a: np.ndarray) -> np.ndarray:
        s = float(rng.uniform(*config.downscale_upscale))
        return resized(resized(a, max(1, round(a.shape[0] * s)), max(1, round(a.shape[1] * s))), *a.shape[:2])

    def noisy(a: np.ndarray) -> np.ndarray:
        sigma = float(rng.uniform(*config.noise_sigma))
        return np.clip(a + rng.normal(0, sigma, a.shape), 0, 255).astype(np.uint8)

    def cut_out(a: np.ndarray) -> np.ndarray:
        a, half = a.copy(), int(config.cutout.get("size", 32)) // 2
        for _ in range(int(config.cutout.get("count", 1))):
            y, x = int(rng.integers(0, a.shape[0])), int(rng.integers(0, a.shape[1]))
            a[max(0, y - half) : y + half, max(0, x - half) : x + half] = 0
        return a

    def webp(a: np.ndarray) -> np.ndarray:
        rng.integers(config.webp_quality[0], config.webp_quality[1] + 1)
        return a

    kinds = {
        "downscale_upscale": down_up,
        "gaussian_blur_sigma": lambda a: blurred(a, float(rng.uniform(*config.gaussian_blur_sigma))),
        "noise_sigma": noisy,
        "jpeg_quality": lambda a: signals.jpeg(a, int(rng.integers(config.jpeg_quality[0], config.jpeg_quality[1] + 1))),
        "webp_quality": webp,
        "cutout": cut_out,
    }
    for kind, change in kinds.items():
        if getattr(config, kind) is not None and rng.random() < config.rate(kind):
            rgb = change(rgb)
    return rgb
