"""Readers of encoded images: containers, PNG pixels, JPEG coefficients and pixels, orientation.

JPEG is read as far as sequential Huffman coding goes (8 bits, any sampling, restart
intervals, one or three components); progressive, lossless and arithmetic coding are
errors, as are PNGs with damaged chunks. Chroma is spread by repetition, so pixels can
differ by a few levels from readers that interpolate; coefficients are exact.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np

from .signals import dct_matrix, zigzag

PNG_SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Passes of an interlaced PNG: first column and row, steps.
ADAM7 = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class Unreadable(ValueError):
    """An image that is damaged or coded in a way that is not supported."""


def kind_of(data: bytes) -> str | None:
    if data[:8] == PNG_SIGNATURE:
        return "PNG"
    if data[:2] == b"\xff\xd8":
        return "JPEG"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "WEBP"
    return "TIFF" if data[:4] in (b"II*\x00", b"MM\x00*") else None


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Name and body of each chunk, checksums checked."""
    at = 8
    while at + 12 <= len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        name, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + size]
        if len(body) != size or zlib.crc32(name + body) != int.from_bytes(data[at + 8 + size : at + 12 + size], "big"):
            raise Unreadable("damaged PNG chunk")
        yield name, body
        if name == b"IEND":
            return
        at += 12 + size


def _unfiltered(raw: bytes, rows: int, row_bytes: int, step: int) -> np.ndarray:
    """Rows of a PNG pass with their filters undone."""
    if len(raw) < rows * (row_bytes + 1):
        raise Unreadable("truncated PNG data")
    lines = np.frombuffer(raw, np.uint8, rows * (row_bytes + 1)).reshape(rows, row_bytes + 1)
    out = np.zeros((rows + 1, row_bytes), np.uint8)  # a row of zeros goes before
    for i in range(rows):
        how, line, up = int(lines[i, 0]), lines[i, 1:], out[i]
        if how == 0:
            out[i + 1] = line
        elif how == 1:
            pad = np.zeros(-(-row_bytes // step) * step, np.uint8)
            pad[:row_bytes] = line
            out[i + 1] = np.cumsum(pad.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[:row_bytes]
        elif how == 2:
            out[i + 1] = line + up
        elif how in (3, 4):
            left, above = [0] * step + line.tolist(), [0] * step + up.tolist()
            for x in range(step, step + row_bytes):
                a, b = left[x - step], above[x]
                if how == 3:
                    guess = (a + b) >> 1
                else:
                    c = above[x - step]
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                left[x] = left[x] + guess & 255
            out[i + 1] = left[step:]
        else:
            raise Unreadable("unknown PNG filter")
    return out[1:]


def read_png(data: bytes) -> np.ndarray:
    """RGB pixels; transparency is dropped and 16 bits are cut to 8."""
    head, palette, packed = None, None, []
    for name, body in png_chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            packed.append(body)
    if head is None or not packed:
        raise Unreadable("a PNG without header or data")
    width, height, depth, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
    if channels is None or not width or not height or colour == 3 and palette is None:
        raise Unreadable("an unknown kind of PNG")
    try:
        raw = zlib.decompress(b"".join(packed))
    except zlib.error as e:
        raise Unreadable(f"PNG data: {e}") from e
    out = np.zeros((height, width, channels), np.uint8)
    at = 0
    for x0, y0, dx, dy in ADAM7 if interlaced else ((0, 0, 1, 1),):
        w, h = -(-(width - x0) // dx), -(-(height - y0) // dy)
        if w <= 0 or h <= 0:
            continue
        row_bytes = (w * channels * depth + 7) // 8
        lines = _unfiltered(raw[at:], h, row_bytes, max(1, channels * depth // 8))
        at += h * (row_bytes + 1)
        if depth == 16:
            part = lines[:, ::2].reshape(h, w, channels)
        elif depth == 8:
            part = lines.reshape(h, w, channels)
        else:
            part = np.unpackbits(lines, axis=1).reshape(h, -1, depth)[:, : w * channels]
            part = (part @ (1 << np.arange(depth)[::-1])).astype(np.uint8).reshape(h, w, channels)
            if colour == 0:
                part = part * np.uint8(255 // ((1 << depth) - 1))
        out[y0::dy, x0::dx] = part
    if colour == 3:
        if out.max() >= len(palette):
            raise Unreadable("a PNG colour outside the palette")
        return palette[out[..., 0]]
    return out[..., :3].copy() if channels >= 3 else out[..., :1].repeat(3, axis=2)


def jpeg_segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """Marker, body and the place behind it of each segment up to the scan."""
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise Unreadable("a JPEG segment is missing")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
            continue
        if marker == 0xD9:
            return
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(data):
            raise Unreadable("truncated JPEG segment")
        yield marker, data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDA:
            return
        at += 2 + size


@dataclass
class Component:
    number: int
    across: int
    down: int
    table: int
    coefficients: np.ndarray = field(default_factory=lambda: np.zeros((0, 0, 64), np.int32))  # rows, columns, natural order


@dataclass
class Jpeg:
    width: int
    height: int
    components: list[Component]
    tables: dict[int, np.ndarray]  # quantisation, natural order

    def quantised(self, i: int) -> np.ndarray:
        """The quantised coefficients of a component, without the blocks that only fill up."""
        c = self.components[i]
        most_across, most_down = max(x.across for x in self.components), max(x.down for x in self.components)
        rows = -(-(-(-self.height * c.down // most_down)) // 8)
        columns = -(-(-(-self.width * c.across // most_across)) // 8)
        return c.coefficients[:rows, :columns]


@lru_cache(maxsize=1)
def _natural() -> np.ndarray:
    return np.array([8 * y + x for y, x in zigzag(8)])


def quantisation_tables(body: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Number and natural-order values of each table in a segment."""
    at = 0
    while at < len(body):
        wide, number = body[at] >> 4, body[at] & 15
        raw = body[at + 1 : at + 1 + 64 * (1 + wide)]
        if wide > 1 or len(raw) < 64 * (1 + wide):
            raise Unreadable("damaged quantisation table")
        out = np.zeros(64, np.int32)
        out[_natural()] = np.frombuffer(raw, ">u2" if wide else "u1")
        yield number, out
        at += 1 + 64 * (1 + wide)


def _huffman(body: bytes) -> Iterator[tuple[int, list[int]]]:
    """Class and number of each table in a segment with its look-up by the next 16 bits: length << 8 | symbol, or 0."""
    at = 0
    while at < len(body):
        key, counts = body[at], body[at + 1 : at + 17]
        symbols = body[at + 17 : at + 17 + sum(counts)]
        if len(counts) < 16 or len(symbols) < sum(counts):
            raise Unreadable("damaged Huffman table")
        look = np.zeros(1 << 16, np.int32)
        code = taken = 0
        for length, count in enumerate(counts, 1):
            for symbol in symbols[taken : taken + count]:
                first = code << 16 - length
                if first >= 1 << 16:
                    raise Unreadable("a Huffman table has too many codes")
                look[first : first + (1 << 16 - length)] = length << 8 | symbol
                code += 1
            taken += count
            code <<= 1
        yield key, look.tolist()
        at += 17 + taken


def _entropy_parts(data: bytes, start: int) -> list[bytes]:
    """The scan's data between restart markers, stuffing undone."""
    parts, at, begin = [], start, start
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            parts.append(data[begin:])
            break
        after = data[at + 1]
        if 0xD0 <= after <= 0xD7:
            parts.append(data[begin:at])
            begin = at + 2
        elif after not in (0x00, 0xFF):
            parts.append(data[begin:at])
            break
        at += 2 if after != 0xFF else 1
    return [p.replace(b"\xff\x00", b"\xff") for p in parts]


def _decode_part(data: bytes, units: int, plan: list[tuple[int, list[int], list[int]]], count: int) -> list[list[tuple[int, int, int]]]:
    """Decodes ``units`` coding units of blocks; per component (block in order, place, value) of all coefficients that are not 0."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(count)]
    done = [0] * count
    last = [0] * count  # direct currents are differences
    held = bits = at = 0
    size = len(data)
    for _ in range(units):
        for component, dc, ac in plan:
            block, found = done[component], out[component]
            k = 0
            while k < 64:
                while bits < 32:  # a code and its value have at most 27 bits
                    held = held << 8 | (data[at] if at < size else 0)
                    if at > size + 8:
                        raise Unreadable("truncated JPEG scan")
                    at += 1
                    bits += 8
                entry = (ac if k else dc)[held >> bits - 16 & 0xFFFF]
                length = entry >> 8
                if not length:
                    raise Unreadable("a code that the Huffman table lacks")
                bits -= length
                symbol = entry & 255
                if k:
                    width = symbol & 15
                    if not width:
                        if symbol != 0xF0:
                            break  # the block's end
                        k += 16
                        continue
                    k += symbol >> 4
                else:
                    width = symbol
                if width > 15 or k > 63:
                    raise Unreadable("a coefficient out of range")
                value = 0
                if width:
                    bits -= width
                    value = held >> bits & (1 << width) - 1
                    if value < 1 << width - 1:
                        value -= (1 << width) - 1
                held &= (1 << bits) - 1
                if k == 0:
                    last[component] += value
                    value = last[component]
                if value:
                    found.append((block, k, value))
                k += 1
            done[component] += 1
    return out


def read_jpeg(data: bytes) -> Jpeg:
    """The quantised coefficients of all components."""
    tables: dict[int, np.ndarray] = {}
    codes: dict[int, list[int]] = {}
    frame: Jpeg | None = None
    restart = 0
    for marker, body, after in jpeg_segments(data):
        if marker == 0xDB:
            tables.update(quantisation_tables(body))
        elif marker == 0xC4:
            codes.update(_huffman(body))
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or n not in (1, 3) or not width or not height:
                raise Unreadable("a JPEG of an unsupported kind")
            parts = [Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if any(not 1 <= c.across <= 4 or not 1 <= c.down <= 4 for c in parts):
                raise Unreadable("bad sampling factors")
            frame = Jpeg(width, height, parts, tables)
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Unreadable("only sequential Huffman JPEGs are supported")
        elif marker == 0xDA:
            if frame is None:
                raise Unreadable("a JPEG scan without a frame")
            _read_scan(data, after, body, frame, codes, restart)
            if any(c.table not in tables for c in frame.components):
                raise Unreadable("a quantisation table is missing")
            return frame
    raise Unreadable("a JPEG without a scan")


def _read_scan(data: bytes, start: int, body: bytes, frame: Jpeg, codes: dict[int, list[int]], restart: int) -> None:
    parts = frame.components
    n = body[0]
    wanted = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}
    if n != len(parts) or any(c.number not in wanted for c in parts):
        raise Unreadable("scans of single components are not supported")
    if n == 1:
        parts[0].across = parts[0].down = 1  # a lone component is not interleaved
    across, down = max(c.across for c in parts), max(c.down for c in parts)
    columns, rows = -(-frame.width // (8 * across)), -(-frame.height // (8 * down))
    plan = []
    for i, c in enumerate(parts):
        tables = wanted[c.number]
        dc, ac = codes.get(tables >> 4), codes.get(0x10 | tables & 15)
        if dc is None or ac is None:
            raise Unreadable("a Huffman table is missing")
        plan += [(i, dc, ac)] * (c.across * c.down)
    units = rows * columns
    each = restart or units
    lots = _entropy_parts(data, start)
    if len(lots) < -(-units // each):
        raise Unreadable("JPEG restart intervals are missing")
    flat = [np.zeros((units * c.across * c.down, 64), np.int32) for c in parts]
    for j in range(-(-units // each)):
        found = _decode_part(lots[j], min(each, units - j * each), plan, n)
        for i, (c, cells) in enumerate(zip(parts, found, strict=True)):
            if cells:
                block, place, value = np.array(cells).T
                flat[i][block + j * each * c.across * c.down, _natural()[place]] = value
    for c, blocks in zip(parts, flat, strict=True):
        grid = blocks.reshape(rows, columns, c.down, c.across, 64).transpose(0, 2, 1, 3, 4)
        c.coefficients = grid.reshape(rows * c.down, columns * c.across, 64)


def plane(frame: Jpeg, i: int) -> np.ndarray:
    """Samples of a component, not clipped, at its own resolution."""
    d = dct_matrix(8)
    c = frame.components[i]
    blocks = (c.coefficients * frame.tables[c.table]).reshape(-1, 8, 8).astype(np.float64)
    pixels = (d.T @ blocks @ d).reshape(*c.coefficients.shape[:2], 8, 8).swapaxes(1, 2)
    return pixels.reshape(pixels.shape[0] * 8, -1) + 128


def jpeg_pixels(frame: Jpeg) -> np.ndarray:
    across, down = max(c.across for c in frame.components), max(c.down for c in frame.components)
    planes = []
    for i, c in enumerate(frame.components):
        p = np.clip(np.rint(plane(frame, i)), 0, 255)
        planes.append(p.repeat(down // c.down, 0).repeat(across // c.across, 1)[: frame.height, : frame.width])
    if len(planes) == 1:
        return np.stack(planes * 3, -1).astype(np.uint8)
    y, cb, cr = planes
    r, b = y + 1.402 * (cr - 128), y + 1.772 * (cb - 128)
    g = y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128)
    return np.clip(np.rint(np.stack([r, g, b], -1)), 0, 255).astype(np.uint8)


def luma_coefficients(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The quantised luma coefficients (rows, columns, 8, 8) of a JPEG and its luma table (8, 8)."""
    frame = read_jpeg(data)
    q = frame.quantised(0)
    return q.reshape(*q.shape[:2], 8, 8), frame.tables[frame.components[0].table].reshape(8, 8)


def turned(rgb: np.ndarray, orientation: int) -> np.ndarray:
    """The image as it is to be seen, by the orientation tag."""
    if orientation in (5, 6, 7, 8):
        rgb = rgb.swapaxes(0, 1)
    # What each orientation mirrors, after swapping rows and columns
    flip_rows, flip_columns = orientation in (3, 4, 7, 8), orientation in (2, 3, 6, 7)
    return np.ascontiguousarray(rgb[:: -1 if flip_rows else 1, :: -1 if flip_columns else 1])


def pixels(data: bytes) -> np.ndarray:
    """RGB pixels as stored, not turned."""
    kind = kind_of(data)
    if kind == "PNG":
        return read_png(data)
    if kind == "JPEG":
        return jpeg_pixels(read_jpeg(data))
    raise Unreadable(f"no reader for {kind} images" if kind else "no known image header")
