"""The registry of image tools and the one UDF that runs them over image columns.

An image is decoded once for all tools and levels; a tool that fails abstains with
0.5 and says why, and never ends the job. Three kinds of tools are registered: kernels
over pixels, kernels that need the encoded file as well, and tools that are columns over
what the files say (``frame``). Tools with learned weights are slots: they abstain until
``load`` finds weights, so that a plan that names them runs anywhere.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kernels import codecs, pixels, signals
from ..sources.images import read_metadata, slices
from .metadata import judged
from .suite import DEFAULT_SUITE, Level

Kernel = Callable[..., dict]
ABSTAIN = 0.5


@dataclass(frozen=True)
class Parameter:
    """A tool's parameter: its type, default and limits."""

    name: str
    kind: type
    default: object
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def coerce(self, value: object) -> object:
        """The value in its type; whole numbers may come as text, truth values are no numbers."""
        if self.kind in (int, float):
            if isinstance(value, bool):
                raise ValueError(f"{self.name}: a truth value is no number")
            number = float(value)  # type: ignore[arg-type]
            if self.kind is int and number != int(number):
                raise ValueError(f"{self.name}: {value} is not whole")
            value = self.kind(number)
            if self.low is not None and value < self.low or self.high is not None and value > self.high:
                raise ValueError(f"{self.name}: {value} is not in [{self.low}, {self.high}]")
        elif self.kind is bool:
            if not isinstance(value, bool):
                raise ValueError(f"{self.name}: {value} is no truth value")
        else:
            value = str(value)
        if self.choices and value not in self.choices:
            raise ValueError(f"{self.name}: {value} is none of {self.choices}")
        return value


@dataclass(frozen=True)
class Tool:
    name: str
    category: str  # signal, view, baseline, localizer, learned
    run: Kernel | None
    parameters: Sequence[Parameter] = field(default_factory=tuple)
    encoded: bool = False  # the kernel takes the file's bytes as ``raw`` besides the pixels
    frame: Callable[[DataFrame], DataFrame] | None = None  # from (path, content) to (path, score, details)
    load: Callable[[], Kernel | None] | None = None  # once per task: the kernel, or None where its weights are missing
    plan: Callable[[], Kernel] | None = None  # on the driver, when a run is planned: a kernel made of other tools
    note: str = ""

    def arguments(self, given: dict) -> dict:
        unknown = set(given) - {p.name for p in self.parameters}
        if unknown:
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)}")
        return {p.name: p.coerce(given.get(p.name, p.default)) for p in self.parameters}


    def planned(self) -> Tool:
        """The tool as tasks get it, with all that it needs: their registry has only what the package registers."""
        return replace(self, run=self.plan(), plan=None) if self.plan else self

    def kernel(self) -> Kernel | None:
        """What runs, or None where weights are missing."""
        return self.run or (self.plan() if self.plan else self.load() if self.load else None)


_TOOLS: dict[str, Tool] = {}


def register(tool: Tool) -> Tool:
    _TOOLS[tool.name] = tool
    return tool


def get(name: str) -> Tool:
    if name not in _TOOLS:
        raise KeyError(f"no tool {name}; there are {', '.join(available())}")
    return _TOOLS[name]


def available(category: str | None = None) -> list[str]:
    return sorted(n for n, t in _TOOLS.items() if category in (None, t.category))


def _random(rgb: np.ndarray, seed: int = 0) -> dict:
    digest = hashlib.sha256(rgb.tobytes() + str(seed).encode()).digest()
    return {"score": float(np.random.Generator(np.random.PCG64(int.from_bytes(digest[:8], "big"))).random())}


def _view(kernel: Callable) -> Kernel:
    return lambda rgb, **a: {"score": 0.5, "map": kernel(rgb, **a)}


def _grid(rgb: np.ndarray) -> dict:
    found = signals.grid_phase(rgb)
    moved = (found["dx"], found["dy"]) != (0, 0) and found["strength"] > 1.3 and found["margin"] > 1.15
    return {"score": 0.75 if moved else 0.45} | found


def _double_jpeg(rgb: np.ndarray, raw: bytes | None) -> dict:
    """A grid that is off its place 0.75; a second grid, or a comb in the coefficients, 0.60; neither a JPEG nor a grid 0.45; else 0.40."""
    found = signals.grid_phase(rgb)
    is_jpeg = raw is not None and codecs.kind_of(raw) == "JPEG"
    ratio = None
    if is_jpeg:
        try:
            ratio = signals.double_quantisation(codecs.luma_coefficients(raw)[0])
        except codecs.Unreadable as e:
            found["coefficients"] = str(e)
    origin = (found["dx"], found["dy"]) == (0, 0)
    second = origin and (found["second_dx"], found["second_dy"]) != (0, 0) and found["second_strength"] > 1.6
    if not origin and found["strength"] > 1.3 and found["margin"] > 1.15:
        score = 0.75
    elif second or ratio is not None and ratio > signals.TWICE:
        score = 0.60
    else:
        score = 0.45 if not is_jpeg and found["strength"] <= 1.3 else 0.40
    return {"score": score} | found | ({} if ratio is None else {"comb": ratio})


def _judged_metadata(files: DataFrame) -> DataFrame:
    shown = F.struct("ai_markers", "editor_markers", "platform_markers", "thumbnail_mismatch", "camera_make", "note", "error")
    return judged(read_metadata(files)).select("path", "score", F.to_json(shown).alias("details"))


def ensemble(members: Sequence[str], mode: str = "max") -> Kernel:
    """A kernel over the maps of members that don't abstain; without any it abstains and names them all."""
    tools = [get(n) for n in members]

    def run(rgb: np.ndarray, mode: str = mode) -> dict:
        ran, maps, scores = [], [], {}
        for tool in tools:
            kernel = tool.kernel()
            out = kernel(rgb) if kernel else {"score": ABSTAIN}
            scores[tool.name] = round(out["score"], 6)
            if out.get("map") is not None:
                ran.append(tool.name)
                own = out["map"]
                maps.append(own if own.shape == rgb.shape[:2] else resized(own[..., None].repeat(3, -1), *rgb.shape[:2], whole=False)[..., 0])
        if not maps:
            return {"score": ABSTAIN, "reason": f"no member has a map: {', '.join(members)}"}
        both = pixels.combine(maps, mode)
        return {"score": pixels.top_fraction_score(both), "map": both, "members": ", ".join(ran), "member_scores": json.dumps(scores)}

    return run


def _missing() -> None:
    """No weights are shipped; a deployment registers the tool again with a loader of its own."""
    return None


register(Tool("metadata", "signal", None, frame=_judged_metadata))
register(Tool("double_jpeg", "signal", _double_jpeg, encoded=True))
register(Tool("ela", "signal", signals.ela, (Parameter("quality", int, 95, 50, 100),)))
register(Tool("jpeg_ghost", "signal", signals.jpeg_ghost))
register(Tool("copy_move", "signal", signals.copy_move))
register(Tool("block_grid", "signal", _grid))
register(Tool("luminance_gradient", "view", _view(pixels.luminance_gradient), (Parameter("radius", int, 1, 1, 3),)))
register(Tool("noise_residual", "view", _view(pixels.noise_residual), (Parameter("window", int, 3, choices=(3, 5)),)))
register(Tool("bit_planes", "view", _view(pixels.bit_plane), (Parameter("plane", int, 0, 0, 7),)))
register(Tool("constant_real", "baseline", lambda rgb: {"score": 0.0}))
register(Tool("constant_fake", "baseline", lambda rgb: {"score": 1.0}))
register(Tool("random", "baseline", _random, (Parameter("seed", int, 0),)))


SIGNALS_MEAN = ("metadata", "ela", "jpeg_ghost", "double_jpeg", "copy_move", "sd_watermark", "c2pa")
LEARNED = (
    ("sd_watermark", "signal", "no watermark decoder is installed"),
    ("c2pa", "signal", "no reader of signed manifests is installed; their rules are evidence.signed_manifest_score"),
    ("dinov2_head", "learned", "no backbone and no head are installed"),
    ("iml_vit", "localizer", "no weights are installed"),
    ("catnet_v2", "localizer", "no weights are installed"),
    ("dino_inpaint", "localizer", "no weights are installed"),
)
for _name, _category, _note in LEARNED:
    register(Tool(_name, _category, None, load=_missing, note=_note))
ENSEMBLE = ("iml_vit", "catnet_v2", "dino_inpaint")
register(Tool("localizer_ensemble", "localizer", None, (Parameter("mode", str, "max", choices=("max", "mean", "rank_mean")),), plan=lambda: ensemble(ENSEMBLE)))


def resized(rgb: np.ndarray, h: int, w: int, whole: bool = True) -> np.ndarray:
    """Bilinear, pixel centres aligned; rounded to bytes unless told otherwise."""
    y = np.clip((np.arange(h) + 0.5) * rgb.shape[0] / h - 0.5, 0, rgb.shape[0] - 1)
    x = np.clip((np.arange(w) + 0.5) * rgb.shape[1] / w - 0.5, 0, rgb.shape[1] - 1)
    y0, x0 = y.astype(int), x.astype(int)
    y1, x1 = np.minimum(y0 + 1, rgb.shape[0] - 1), np.minimum(x0 + 1, rgb.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    c = rgb.astype(np.float64)
    top, low = c[y0][:, x0] * (1 - fx) + c[y0][:, x1] * fx, c[y1][:, x0] * (1 - fx) + c[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return np.rint(out).astype(np.uint8) if whole else out


def perturb(rgb: np.ndarray, level: Level, coded: Callable[[], list[signals.Plane]] | None = None) -> np.ndarray | None:
    """The image at a level; null where a codec is missing. Noise is seeded by content and level. ``coded`` gives the image's transforms, made once for all levels."""
    p, (h, w) = level.params, rgb.shape[:2]
    coded = coded or (lambda: signals.planes(rgb))
    scaled = lambda f: resized(rgb, max(1, round(h * f)), max(1, round(w * f)))
    if level.kind == "clean":
        return rgb
    if level.kind == "jpeg":
        return signals.decoded(coded(), int(p["quality"]), h, w)
    if level.kind == "resize":
        return scaled(p["scale"])
    if level.kind == "resize_roundtrip":
        return resized(scaled(p["scale"]), h, w)
    if level.kind == "center_crop":
        ch, cw = max(1, round(h * p["fraction"])), max(1, round(w * p["fraction"]))
        return rgb[(h - ch) // 2 : (h - ch) // 2 + ch, (w - cw) // 2 : (w - cw) // 2 + cw]
    if level.kind == "gaussian_noise":
        seed = int.from_bytes(hashlib.sha256(rgb.tobytes() + level.name.encode()).digest()[:8], "big")
        return np.clip(rgb + np.random.default_rng(seed).normal(0, p["sigma"], rgb.shape).astype(np.float32), 0, 255).astype(np.uint8)
    if level.kind == "social":
        f = min(1.0, p["max_side"] / max(h, w))
        return signals.jpeg(scaled(f), int(p["quality"])) if f < 1 else signals.decoded(coded(), int(p["quality"]), h, w)
    return None


RECORD = "entry_path string, level string, tool string, score double, details string, elapsed_ms double"


def _record(path: str, level: str, name: str, began: float, score: float, note: dict) -> tuple:
    return path, level, name, float(score), json.dumps(note, sort_keys=True, default=float), (time.perf_counter() - began) * 1000


def _plain(out: dict) -> dict:
    """What a kernel says besides score and map; of a map its mean and a digest, so that a change shows."""
    note = {k: v for k, v in out.items() if isinstance(v, (int, float, str, tuple)) and k != "score"}
    if (found := out.get("map")) is not None:
        found = np.asarray(found, np.float32)
        note |= {"map_mean": round(float(found.mean()), 6) if found.size else 0.0, "map_shape": list(found.shape)}
    return note


def run_tools(images: DataFrame, tools: Sequence[str], levels: Sequence[Level] = DEFAULT_SUITE[:1], arguments: dict[str, dict] | None = None) -> DataFrame:
    """Score records of images (entry_path, height, width, rgb binary, and raw binary if files are at hand): every tool at every level.

    A batch is handled a few megabytes at a time. Whatever a tool or a level does wrong is its record's error alone. Encoded files
    exist at the clean level only; elsewhere tools that need them abstain.
    """
    wanted = [(t.planned(), t.arguments((arguments or {}).get(t.name, {}))) for t in map(get, tools)]
    has_raw = "raw" in images.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = [(t, t.kernel(), args) for t, args in wanted]
        for batch in batches:
            for part in slices(batch, "rgb"):
                rows = []
                for i in range(part.num_rows):
                    path, h, w = (part.column(c)[i].as_py() for c in ("entry_path", "height", "width"))
                    data, raw = part.column("rgb")[i].as_py(), part.column("raw")[i].as_py() if has_raw else None
                    broken = data is None or h is None or w is None or len(data) != 3 * h * w or not len(data)
                    rgb = None if broken else np.frombuffer(data, np.uint8).reshape(h, w, 3)
                    coded = lru_cache(1)(partial(signals.planes, rgb))
                    for level in levels:
                        began, seen, fault = time.perf_counter(), None, "unreadable image"
                        if rgb is not None:
                            try:
                                seen = perturb(rgb, level, coded)
                                fault = f"{level.kind} is unsupported"
                            except Exception as e:  # noqa: BLE001  a level that fails is this image's error alone
                                fault = f"{level.name}: {e or type(e).__name__}"
                        for tool, kernel, args in ready:
                            began = time.perf_counter()
                            own = raw if level.kind == "clean" else None
                            if tool.frame and level.kind == "clean" and has_raw:
                                continue  # from its own plan
                            if tool.frame:
                                score, note = ABSTAIN, {"reason": "no encoded file at hand"}
                            elif seen is None:
                                score, note = ABSTAIN, {"error": fault}
                            elif kernel is None:
                                score, note = ABSTAIN, {"reason": tool.note or "no weights are installed"}
                            else:
                                try:
                                    out = kernel(seen, raw=own, **args) if tool.encoded else kernel(seen, **args)
                                    score, note = float(out["score"]), _plain(out)
                                except Exception as e:  # noqa: BLE001
                                    score, note = ABSTAIN, {"error": str(e) or type(e).__name__}
                            rows.append(_record(path, level.name, tool.name, began, score, note))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
                kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["entry_path", "level", "tool", "score", "details", "elapsed_ms"])

    out = images.select("entry_path", "height", "width", "rgb", *(["raw"] if has_raw else [])).mapInArrow(run, RECORD)
    clean = [x.name for x in levels if x.kind == "clean"]
    for tool, _ in wanted if has_raw and clean else ():
        if tool.frame:
            own = tool.frame(images.select(F.col("entry_path").alias("path"), F.col("raw").alias("content")))
            out = out.unionByName(own.select(F.col("path").alias("entry_path"), F.explode(F.array(*map(F.lit, clean))).alias("level"), F.lit(tool.name).alias("tool"), "score", "details", F.lit(None).cast("double").alias("elapsed_ms")))
    return out


def signals_mean(records: DataFrame, members: Sequence[str] = SIGNALS_MEAN) -> DataFrame:
    """Records of a baseline: the mean score of an image's signals at a level, abstentions included; times add up."""
    own = records.where(F.col("tool").isin(*members))
    mean = F.sum(F.round(F.col("score") * 1_000_000_000).cast("long")) / F.count(F.lit(1)) / 1_000_000_000
    found = own.groupBy("entry_path", "level").agg(mean.alias("score"), F.sum("elapsed_ms").alias("elapsed_ms"), F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "score"))))).alias("details"))
    return found.select("entry_path", "level", F.lit("signals_mean").alias("tool"), "score", "details", "elapsed_ms")


#: What the tools are called where their name, made readable, won't do; groups of the tool tree are the categories.
TITLES = {"ela": "Error level analysis", "jpeg_ghost": "JPEG ghosts", "copy_move": "Copied regions", "double_jpeg": "Double JPEG coding", "c2pa": "Signed manifests", "sd_watermark": "Generator watermark"}


def catalogue(spark: SparkSession) -> DataFrame:
    """All registered tools by category and name: title, whether they can run here, parameters as JSON, note. A tool with missing weights runs, and abstains."""
    rows = []
    for t in _TOOLS.values():
        members = t.name == "localizer_ensemble"
        installed = any(_installed(get(n)) for n in ENSEMBLE) if members else _installed(t)
        told = [{"name": p.name, "kind": p.kind.__name__, "default": p.default, "low": p.low, "high": p.high, "choices": list(p.choices)} for p in t.parameters]
        title = TITLES.get(t.name) or t.name.replace("_", " ").capitalize()
        rows.append((t.name, title, t.category, t.category in ("learned", "localizer"), installed, json.dumps(told), t.note))
    return spark.createDataFrame(rows, "name string, title string, category string, learned boolean, installed boolean, parameters string, note string").orderBy("category", "name")


def _installed(tool: Tool) -> bool:
    return bool(tool.frame or tool.kernel())


def enriched(records: DataFrame) -> DataFrame:
    """Records with their tools' titles, categories and notes; unknown tools keep their names."""
    known = F.broadcast(catalogue(records.sparkSession).select(F.col("name").alias("tool"), "title", "category", "note"))  # a row for each registered tool
    return records.join(known, "tool", "left").withColumns({"title": F.coalesce("title", "tool"), "category": F.coalesce("category", F.lit("other"))})


def pyramid_tiles(maps: DataFrame, tile: int = 256) -> DataFrame:
    """(entry_path, level, row, column, png) of maps (entry_path, height, width, values binary of 32-bit floats): each level half as large as the last, edge tiles filled with zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "values"):
                for i in range(part.num_rows):
                    path, h, w, raw = (part.column(c)[i].as_py() for c in ("entry_path", "height", "width", "values"))
                    for level, a in enumerate(pixels.pyramid(np.frombuffer(raw, "<f4").reshape(h, w), tile)):
                        rows = []
                        for y in range(0, a.shape[0], tile):
                            for x in range(0, a.shape[1], tile):
                                rows.append((path, level, y // tile, x // tile, pixels.png(pixels.pad_for_tiles(a[y : y + tile, x : x + tile], tile))))
                        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["entry_path", "level", "row", "column", "png"])

    return maps.select("entry_path", "height", "width", "values").mapInArrow(run, "entry_path string, level int, row int, column int, png binary")
