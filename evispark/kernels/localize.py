"""Plumbing of models that work on tiles and crops, and pictures of their maps."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np

from .pixels import pad_for_tiles, stitch, tile_origins, top_fraction_score

#: Coefficient sizes told apart: 0 to 19, and 20 or more.
SIZES = 21
# Stops of the colour ramp, from cold to hot
RAMP = ((0.0, 0, 0, 255), (0.25, 0, 255, 255), (0.5, 0, 255, 0), (0.75, 255, 255, 0), (1.0, 255, 0, 0))
MAX_ALPHA, OUTLINE = 0.6, (255, 255, 255)


def tiled(rgb: np.ndarray, model: Callable[[np.ndarray], np.ndarray], tile: int, stride: int) -> dict:
    """The map of a model that takes one size of tile: overlaps are averaged, small images filled with zeros, and the score is the mean of the top hundredth."""
    a = pad_for_tiles(rgb, tile)
    parts = [(y, x, np.asarray(model(a[y : y + tile, x : x + tile]), np.float32)) for y in tile_origins(a.shape[0], tile, stride) for x in tile_origins(a.shape[1], tile, stride)]
    heat = np.clip(stitch(a.shape[:2], parts)[: rgb.shape[0], : rgb.shape[1]], 0, 1).astype(np.float32)
    return {"score": top_fraction_score(heat), "map": heat}


def coefficient_volume(coefficients: np.ndarray) -> np.ndarray:
    """Quantised coefficients (rows, columns, 8, 8) as SIZES planes of zeros and ones in the image's layout; signs are dropped."""
    flat = coefficients.swapaxes(1, 2).reshape(coefficients.shape[0] * 8, -1)
    return (np.minimum(np.abs(flat), SIZES - 1)[None] == np.arange(SIZES)[:, None, None]).astype(np.float32)


def _grown(a: np.ndarray, size: int) -> np.ndarray:
    """A square grid at another size, bilinear."""
    at = np.clip((np.arange(size) + 0.5) * len(a) / size - 0.5, 0, len(a) - 1)
    low = np.floor(at).astype(int)
    high, f = np.minimum(low + 1, len(a) - 1), at - low
    rows = a[low] * (1 - f)[:, None] + a[high] * f[:, None]
    return rows[:, low] * (1 - f) + rows[:, high] * f


def _inner(start: int, length: int, limit: int, size: int) -> int:
    """Where in a crop its visible part begins: what was cut off lay before the image, behind it, or, of a small image, on both sides."""
    if length >= size or start > 0:
        return 0
    return size - length if length < limit else (size - length) // 2


def painted(shape: tuple[int, int], boxes: Sequence[tuple[int, int, int, int]], grids: Sequence[np.ndarray], size: int) -> np.ndarray | None:
    """Grids of crops (top, left, height, width in the image) as one map, each by its own maximum: means where they overlap, 0 where none is; None if the numbers differ."""
    if len(boxes) != len(grids):
        return None
    total, count = np.zeros(shape), np.zeros(shape)
    for (top, left, h, w), grid in zip(boxes, grids, strict=True):
        if h > 0 and w > 0:
            most = float(np.max(grid))
            full = _grown(np.asarray(grid, float) / (most if most > 0 else 1.0), size)
            y, x = _inner(top, h, shape[0], size), _inner(left, w, shape[1], size)
            total[top : top + h, left : left + w] += full[y : y + h, x : x + w]
            count[top : top + h, left : left + w] += 1
    return np.clip(total / np.maximum(count, 1), 0, 1).astype(np.float32)


def mask_loss(p: np.ndarray, y: np.ndarray, weight: float = 1.0) -> float:
    """Weighted cross entropy plus one minus the dice of a map and its mask; masked places count ``weight`` times."""
    clip = np.clip(p, 1e-6, 1 - 1e-6)
    entropy = -(weight * y * np.log(clip) + (1 - y) * np.log(1 - clip)).mean()
    return float(entropy + 1 - (2 * (p * y).sum() + 1) / (p.sum() + y.sum() + 1))


def coloured(heat: np.ndarray) -> np.ndarray:
    stops = np.array(RAMP)
    return np.stack([np.interp(np.clip(heat, 0, 1), stops[:, 0], stops[:, c]) for c in (1, 2, 3)], -1).astype(np.uint8)


def outline(mask: np.ndarray) -> np.ndarray:
    """Masked places with a neighbour, of four, that is not; the image's edge is no neighbour."""
    padded = np.pad(mask, 1, constant_values=True)
    return mask & ~(padded[:-2, 1:-1] & padded[2:, 1:-1] & padded[1:-1, :-2] & padded[1:-1, 2:])


def overlay(rgb: np.ndarray, heat: np.ndarray, alpha: float = MAX_ALPHA) -> np.ndarray:
    """The image under its map: the hotter the more opaque, with a line around what exceeds a half."""
    if rgb.shape[:2] != heat.shape:
        raise ValueError(f"the image has {rgb.shape[:2]} pixels, the map {heat.shape}")
    a = (np.clip(heat, 0, 1) * alpha)[..., None]
    out = rgb * (1 - a) + coloured(heat) * a
    out[outline(heat > 0.5)] = OUTLINE
    return np.clip(out, 0, 255).astype(np.uint8)
