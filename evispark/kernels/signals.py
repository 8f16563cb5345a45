"""Signals of manipulation: error levels, ghosts, block grids, copied regions, and the JPEG simulator they need."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .pixels import block_reduce, luma, p99_scaled

# The standard's quantisation tables (ITU-T T.81, Annex K), in natural order
LUMINANCE = np.array(
    [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
     18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
)
CHROMINANCE = np.array(
    [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99] + [99] * 32
)


@lru_cache(maxsize=4)
def dct_matrix(n: int) -> np.ndarray:
    """The orthonormal DCT-II basis."""
    k, x = np.mgrid[:n, :n]
    m = np.cos(np.pi * (2 * x + 1) * k / (2 * n)) * np.sqrt(2 / n)
    m[0] /= np.sqrt(2)
    return m


@lru_cache(maxsize=4)
def zigzag(n: int) -> tuple[tuple[int, int], ...]:
    return tuple(sorted(((y, x) for y in range(n) for x in range(n)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1])))


def scale_factor(quality: int) -> int:
    return 5000 // quality if quality < 50 else 200 - 2 * quality


def quant_table(base: np.ndarray, quality: int) -> np.ndarray:
    return np.clip((base * scale_factor(quality) + 50) // 100, 1, 255)


def estimate_quality(table: np.ndarray) -> int:
    """The quality whose scaling of the standard table has this one's mean."""
    ratio = 100 * table.mean() / LUMINANCE.mean()
    return int(np.clip(round((200 - ratio) / 2 if ratio <= 100 else 5000 / ratio), 1, 100))


def exact_quality(luminance: np.ndarray, chrominance: np.ndarray | None) -> int | None:
    """The highest quality that gives exactly these tables."""
    if chrominance is None:
        return None
    return next((q for q in range(100, 0, -1) if (quant_table(LUMINANCE, q) == luminance).all() and (quant_table(CHROMINANCE, q) == chrominance).all()), None)


@lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    """The two-dimensional transform of a block as one matrix over its 64 samples."""
    return np.kron(dct_matrix(8), dct_matrix(8)).astype(np.float32)


def transformed(a: np.ndarray) -> tuple[np.ndarray, tuple[int, int]]:
    """Coefficients (blocks in raster order, 64) of a plane, edges repeated up to whole blocks, and the plane's shape."""
    a = np.pad(a, [(0, -a.shape[0] % 8), (0, -a.shape[1] % 8)], mode="edge") if a.shape[0] % 8 or a.shape[1] % 8 else a
    blocks = a.reshape(a.shape[0] // 8, 8, a.shape[1] // 8, 8).swapaxes(1, 2).reshape(-1, 64)
    return blocks @ _basis().T, a.shape


def restored(coefficients: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    back = (coefficients @ _basis()).reshape(shape[0] // 8, shape[1] // 8, 8, 8)
    return back.swapaxes(1, 2).reshape(shape)


Plane = tuple[np.ndarray, tuple[int, int], np.ndarray, bool]


def planes(rgb: np.ndarray, subsample: bool = True) -> list[Plane]:
    """What JPEG coding quantises: the transforms of luma and chroma with their base tables, and whether each is of half size."""
    r, g, b = rgb.transpose(2, 0, 1).astype(np.float32, order="C")  # plane by plane, as rows of pixels are slow to walk
    y = np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b
    out = [(*transformed(np.rint(y) - 128), LUMINANCE, False)]
    for p in ((b - y) / np.float32(1.772), (r - y) / np.float32(1.402)):
        if subsample:
            p = np.pad(p, [(0, p.shape[0] % 2), (0, p.shape[1] % 2)], mode="edge") if p.shape[0] % 2 or p.shape[1] % 2 else p
            p = (p[::2, ::2] + p[1::2, ::2] + p[::2, 1::2] + p[1::2, 1::2]) / 4
        out.append((*transformed(np.rint(p)), CHROMINANCE, subsample))
    return out


def decoded(coded: list[Plane], quality: int, height: int, width: int) -> np.ndarray:
    """Pixels of the planes after quantisation at a quality."""
    got = []
    for coefficients, shape, base, half in coded:
        table = quant_table(base, quality).astype(np.float32)
        p = np.rint(restored(np.rint(coefficients / table) * table, shape))
        if half:
            p = p.repeat(2, 0).repeat(2, 1)
        got.append(np.clip(p[:height, :width], -128, 127))
    y, cb, cr = got
    y = y + 128
    r, b = y + np.float32(1.402) * cr, y + np.float32(1.772) * cb
    g = (y - np.float32(0.299) * r - np.float32(0.114) * b) / np.float32(0.587)
    out = np.empty((height, width, 3), np.uint8)
    for i, p in enumerate((r, g, b)):
        out[..., i] = np.clip(np.rint(p, out=p), 0, 255, out=p)
    return out


def jpeg(rgb: np.ndarray, quality: int, subsample: bool = True) -> np.ndarray:
    """What an image is after JPEG coding: entropy coding loses nothing, so it is left out."""
    return decoded(planes(rgb, subsample), quality, *rgb.shape[:2])


def ela(rgb: np.ndarray, quality: int = 95) -> dict:
    """Error level analysis: what coding once more changes, and how unevenly."""
    off = np.abs(rgb.astype(np.int16) - jpeg(rgb, quality))
    diff = np.maximum(np.maximum(off[..., 0], off[..., 1]), off[..., 2]).astype(np.float32)
    scaled = p99_scaled(diff)
    share = float((scaled > 0.5).mean())
    b = block_reduce(diff)
    uneven = float((np.percentile(b, 95) - np.median(b)) / (np.median(b) + 1e-6)) if b.size else 0.0
    return {"score": float(np.clip(0.5 + 0.3 * np.tanh((share - 0.05) / 0.05), 0.3, 0.65)), "map": scaled, "inhomogeneity": uneven}


def jpeg_ghost(rgb: np.ndarray, qualities: tuple[int, ...] = tuple(range(50, 100, 5))) -> dict:
    """Blocks whose error has a dip at another quality than the image's. The transforms are made once for all qualities."""
    h, w = rgb.shape[:2]
    if h < 16 or w < 16:
        return {"score": 0.5, "map": np.zeros((h, w), np.float32)}
    coded, signed = planes(rgb), rgb.astype(np.int16)

    def error(q: int) -> np.ndarray:
        off = (signed - decoded(coded, q, h, w)).astype(np.float32)
        off *= off
        return block_reduce(off[..., 0] + off[..., 1] + off[..., 2]) / 3

    errors = np.stack([error(q) for q in qualities])
    spread = errors.std((1, 2), keepdims=True)
    z = np.where(spread > 1e-9, (errors - errors.mean((1, 2), keepdims=True)) / np.maximum(spread, 1e-9), 0.0)
    before = np.concatenate([np.ones_like(z[:1], bool), z[1:] < z[:-1]])
    after = np.concatenate([z[:-1] < z[1:], np.ones_like(z[:1], bool)])
    low = before & after
    first = np.where(low.any(0), low.argmax(0), z.argmin(0))
    main = int(errors.mean((1, 2)).argmin())
    depth = z[main] - np.take_along_axis(z, first[None], 0)[0]
    apart = np.abs(np.asarray(qualities)[first] - qualities[main]) >= 10
    ghost = (depth >= 0.4) & apart & (block_reduce(luma(rgb), what="var") >= 20)
    share = float(ghost.mean())
    heat = p99_scaled(np.maximum(depth, 0)).repeat(16, 0).repeat(16, 1)
    heat = np.pad(heat, [(0, h - heat.shape[0]), (0, w - heat.shape[1])])
    return {"score": float(np.clip(0.5 + 0.2 * np.tanh((share - 0.03) / 0.03), 0.3, 0.7)), "map": heat, "share": share}


#: Places in a block whose coefficients tell of an earlier coding; values counted on either side of 0; the part of the spectrum that is searched, and how it is smoothed.
PLACES, REACH, BAND, SMOOTH = ((0, 1), (1, 0), (1, 1)), 64, (15, 64), 41
#: A comb that stands out so much is suspected to come from an earlier coding.
TWICE = 1.9


def comb(values: np.ndarray) -> float:
    """How far the histogram of whole numbers is a comb: the highest part of its spectrum over the spectrum's running mean."""
    counts = np.bincount(np.clip(values, -REACH, REACH) + REACH, minlength=2 * REACH + 1)
    spectrum = np.abs(np.fft.rfft(counts))
    sums = np.cumsum(np.concatenate([[0.0], np.pad(spectrum, SMOOTH // 2, mode="edge")]))
    mean = (sums[SMOOTH:] - sums[:-SMOOTH]) / SMOOTH
    return float((spectrum / np.maximum(mean, 1e-9))[BAND[0] : BAND[1]].max())


def double_quantisation(coefficients: np.ndarray) -> float:
    """Mean comb of quantised luma coefficients (rows, columns, 8, 8): numbers that an earlier, coarser coding has left out."""
    return float(np.mean([comb(coefficients[:, :, y, x].ravel()) for y, x in PLACES]))


def phase_energy(y: np.ndarray, axis: int) -> np.ndarray:
    """Mean size of first differences by the position, modulo 8, of their first pixel."""
    d = np.abs(np.diff(y, axis=axis)).mean(1 - axis)
    return np.array([d[i::8].mean() if len(d[i::8]) else 0.0 for i in range(8)])


def grid_phase(rgb: np.ndarray) -> dict:
    """Where the 8-pixel coding grid begins, and how far it stands out: from its mean and from the next phase; and the same of the next strongest grid."""
    y, out = luma(rgb), {}
    strength, margins, second = [], [], []
    for name, axis in (("dy", 0), ("dx", 1)):
        e = phase_energy(y, axis)
        order = np.sort(e)
        out[name] = int((7 - e.argmax()) % 8)
        strength.append(order[-1] / max(e.mean(), 1e-9))
        margins.append(order[-1] / max(order[-2], 1e-9))
        rest = np.delete(e, e.argmax())
        out[f"second_{name}"] = int((7 - np.where(np.arange(8) == e.argmax(), -1.0, e).argmax()) % 8)
        second.append(rest.max() / max(rest.mean(), 1e-9))
    return out | {"strength": float(np.mean(strength)), "margin": float(min(margins)), "second_strength": float(np.mean(second))}


def copy_move(rgb: np.ndarray, size: int = 16, step: int = 4) -> dict:
    """Regions that occur twice: equal quantised block transforms whose displacement many pairs share."""
    y = luma(rgb)
    if min(y.shape) < size:
        return {"score": 0.5, "votes": 0, "shift": (0, 0), "area": 0.0}
    views = np.lib.stride_tricks.sliding_window_view(y, (size, size))[::step, ::step]
    gy, gx = np.mgrid[: views.shape[0], : views.shape[1]] * step
    keep = views.var((2, 3)) >= 12
    blocks, pos = views[keep], np.stack([gy[keep], gx[keep]], 1)
    if len(blocks) < 2:
        return {"score": 0.45, "votes": 0, "shift": (0, 0), "area": 0.0}
    d = dct_matrix(size)
    coded = np.einsum("ij,njk,lk->nil", d[:4], blocks, d[:4])
    places = [p for p in zigzag(size) if max(p) < 4][:9]
    f = np.rint(np.stack([coded[:, a, b] for a, b in places], 1) / 8).astype(np.int32)
    order = np.lexsort([pos[:, 1], pos[:, 0], *f.T[::-1]])
    f, pos = f[order], pos[order]
    found = []
    for k in range(1, 6):
        same = (f[k:] == f[:-k]).all(1)
        shift = pos[k:][same] - pos[:-k][same]
        far = (shift**2).sum(1) >= 24**2
        shift, a, b = shift[far], pos[:-k][same][far], pos[k:][same][far]
        turn = np.where((shift[:, 0] < 0) | ((shift[:, 0] == 0) & (shift[:, 1] < 0)), -1, 1)
        found.append(np.concatenate([shift * turn[:, None], a, b], 1))
    pairs = np.concatenate(found)
    if not len(pairs):
        return {"score": 0.45, "votes": 0, "shift": (0, 0), "area": 0.0}
    shifts, votes = np.unique(pairs[:, :2], axis=0, return_counts=True)
    best = max(range(len(votes)), key=lambda i: (votes[i], -shifts[i, 1], -shifts[i, 0]))
    strong = int((votes >= 12).sum())
    near = (np.abs(pairs[:, :2] - shifts[best]) <= 2).all(1)
    area = np.zeros(y.shape, bool)
    if votes[best] >= 12:
        for p in (pairs[near][:, 2:4], pairs[near][:, 4:6]):
            for a, b in p:
                area[a : a + size, b : b + size] = True
    share = float(area.mean())
    score = 0.45 if votes[best] < 12 or strong > 3 else 0.85 if share >= 0.01 else 0.60
    return {"score": score, "votes": int(votes[best]), "shift": (int(shifts[best, 1]), int(shifts[best, 0])), "area": share}
