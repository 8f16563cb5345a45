"""Luma, views, tiles, crops, block statistics and map combination."""

from __future__ import annotations

import zlib

import numpy as np

# ITU-R BT.601
LUMA = np.array([0.299, 0.587, 0.114])


def luma(rgb: np.ndarray) -> np.ndarray:
    return rgb.astype(np.float64) @ LUMA


def neighbourhood(a: np.ndarray, radius: int) -> np.ndarray:
    """All shifts within the radius, row by row, of an array that is mirrored at its edges."""
    p = np.pad(a, radius, mode="reflect") if min(a.shape) > radius else np.pad(a, radius, mode="edge")
    side = 2 * radius + 1
    return np.stack([p[y : y + a.shape[0], x : x + a.shape[1]] for y in range(side) for x in range(side)])


def p99_scaled(a: np.ndarray) -> np.ndarray:
    """In [0, 1] by the 99th percentile; zeros where that is next to nothing."""
    top = float(np.percentile(a, 99)) if a.size else 0.0
    return np.clip(a / top, 0, 1).astype(np.float32) if top > 1e-6 else np.zeros(a.shape, np.float32)


def luminance_gradient(rgb: np.ndarray, radius: int = 1) -> np.ndarray:
    """Size of the Sobel gradient of the blurred luma, scaled; radius 1 is no blur."""
    y = luma(rgb)
    if radius > 1:
        y = neighbourhood(y, radius - 1).mean(0)
    n = neighbourhood(y, 1)
    gx = n[2] + 2 * n[5] + n[8] - n[0] - 2 * n[3] - n[6]
    gy = n[6] + 2 * n[7] + n[8] - n[0] - 2 * n[1] - n[2]
    return p99_scaled(np.hypot(gx, gy))


def noise_residual(rgb: np.ndarray, window: int = 3) -> np.ndarray:
    """What the median of a window leaves of the luma, scaled."""
    y = luma(rgb)
    return p99_scaled(np.abs(y - np.median(neighbourhood(y, window // 2), axis=0)))


def bit_plane(rgb: np.ndarray, plane: int = 0) -> np.ndarray:
    return (np.clip(np.rint(luma(rgb)), 0, 255).astype(np.uint8) >> plane & 1).astype(np.float32)


def block_reduce(a: np.ndarray, size: int = 16, what: str = "mean") -> np.ndarray:
    """Mean or variance of whole blocks; what is left at the edges is dropped."""
    h, w = a.shape[0] // size * size, a.shape[1] // size * size
    return getattr(a[:h, :w].reshape(h // size, size, w // size, size), what)(axis=(1, 3))


def tile_origins(length: int, tile: int, stride: int) -> list[int]:
    """Starts of tiles that cover the length; the last is pulled back to end with it."""
    if length <= tile:
        return [0]
    return sorted({*range(0, length - tile + 1, stride), length - tile})


def stitch(shape: tuple[int, int], tiles: list[tuple[int, int, np.ndarray]]) -> np.ndarray:
    """Mean of overlapping tiles (y, x, values); a pixel that none covers is an error."""
    total, count = np.zeros(shape), np.zeros(shape)
    for y, x, t in tiles:
        h, w = min(t.shape[0], shape[0] - y), min(t.shape[1], shape[1] - x)
        total[y : y + h, x : x + w] += t[:h, :w]
        count[y : y + h, x : x + w] += 1
    if not count.all():
        raise ValueError("the tiles leave pixels uncovered")
    return total / count


def center_crop(a: np.ndarray, size: int) -> np.ndarray:
    a = mirrored(a, size)
    y, x = (a.shape[0] - size) // 2, (a.shape[1] - size) // 2
    return a[y : y + size, x : x + size]


def grid_crops(shape: tuple[int, int], size: int, limit: int | None = None) -> list[tuple[int, int]]:
    """Whole tiles of a grid, the nearest to the centre first, ties from top left."""
    ys, xs = range(0, shape[0] - size + 1, size), range(0, shape[1] - size + 1, size)
    middle = ((shape[0] - size) / 2, (shape[1] - size) / 2)
    return sorted(((y, x) for y in ys for x in xs), key=lambda p: ((p[0] - middle[0]) ** 2 + (p[1] - middle[1]) ** 2, *p))[:limit]


def patch_targets(mask: np.ndarray, size: int = 14, hard: bool = False) -> np.ndarray:
    """Share of masked pixels in each patch, or whether it is above a half."""
    share = block_reduce(mask.astype(np.float64), size)
    return (share > 0.5).astype(np.float32) if hard else share.astype(np.float32)


def average_ranks(a: np.ndarray) -> np.ndarray:
    flat = a.ravel()
    _, where, n = np.unique(flat, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[where].reshape(a.shape)


def percentile_ranks(a: np.ndarray) -> np.ndarray:
    if a.size <= 1 or a.min() == a.max():
        return np.full(a.shape, 0.5)
    return (average_ranks(a) - 1) / (a.size - 1)


def combine(maps: list[np.ndarray], mode: str = "max") -> np.ndarray:
    """Mean, maximum, or mean of ranks of maps of one shape."""
    if not maps:
        raise ValueError("no map to combine")
    stack = np.stack([percentile_ranks(m) for m in maps] if mode == "rank_mean" else maps)
    if mode not in ("max", "mean", "rank_mean"):
        raise ValueError(f"mode must be max, mean or rank_mean, not {mode}")
    return np.clip(stack.max(0) if mode == "max" else stack.mean(0), 0, 1).astype(np.float32)


def top_fraction_score(a: np.ndarray, fraction: float = 0.01) -> float:
    """Mean of the greatest values; 0.5 of none."""
    if not a.size:
        return 0.5
    k = max(1, round(fraction * a.size))
    return float(np.sort(a.ravel())[-k:].mean())


def halved(a: np.ndarray) -> np.ndarray:
    """Box mean of two by two; an odd edge is repeated."""
    a = np.pad(a, [(0, a.shape[0] % 2), (0, a.shape[1] % 2)], mode="edge")
    return (a[::2, ::2] + a[1::2, ::2] + a[::2, 1::2] + a[1::2, 1::2]) / 4


def pyramid(a: np.ndarray, least: int = 1) -> list[np.ndarray]:
    levels = [a.astype(np.float32)]
    while max(levels[-1].shape) > least:
        levels.append(halved(levels[-1]).astype(np.float32))
    return levels


def _png_file(rows: np.ndarray, colour: int) -> bytes:
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    raw = b"".join(b"\x00" + r.tobytes() for r in rows)
    head = rows.shape[1].to_bytes(4, "big") + rows.shape[0].to_bytes(4, "big") + bytes([8, colour, 0, 0, 0])
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png(gray: np.ndarray) -> bytes:
    """An 8-bit PNG of values in [0, 1], clipped and cut off."""
    return _png_file((np.clip(gray, 0, 1) * 255).astype(np.uint8), 0)


def png_rgb(rgb: np.ndarray) -> bytes:
    """A lossless PNG of RGB pixels."""
    return _png_file(np.ascontiguousarray(rgb, np.uint8), 2)


def pad_for_tiles(a: np.ndarray, tile: int) -> np.ndarray:
    """An image of at least one tile, filled up with zeros at the far edges."""
    grow = [(0, max(0, tile - n)) for n in a.shape[:2]] + [(0, 0)] * (a.ndim - 2)
    return np.pad(a, grow) if any(g[1] for g in grow) else a


def mirrored(a: np.ndarray, size: int) -> np.ndarray:
    """At least that large, the same amount on both sides, mirrored without repeating the edge however far it goes."""
    for axis in (0, 1):
        n = a.shape[axis]
        more = max(0, size - n)
        if more:
            at = np.arange(-(more // 2), n + more - more // 2)
            period = max(1, 2 * (n - 1))
            at = np.abs((at + n - 1) % period - (n - 1)) if n > 1 else np.zeros_like(at)
            a = np.take(a, at, axis)
    return a
