"""What an encoded image says about itself: EXIF fields, text chunks, XMP, image resources, captions, thumbnail.

Every reader takes what is sound and stops at what is not; none raises for damaged metadata.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

from .codecs import PNG_SIGNATURE, Unreadable, jpeg_segments, kind_of, pixels, png_chunks, quantisation_tables
from .pixels import luma

# Tags of the EXIF and TIFF formats
ORIENTATION, MAKE, MODEL, SOFTWARE, EXIF_PART = 0x0112, 0x010F, 0x0110, 0x0131, 0x8769
TAKEN, LENS, THUMB_AT, THUMB_SIZE, XMP_TAG = 0x9003, 0xA434, 0x0201, 0x0202, 0x02BC
#: Bytes of a value of each TIFF type.
WIDTHS = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
XMP_HEAD, RESOURCE_HEAD = b"http://ns.adobe.com/xap/1.0/\x00", b"Photoshop 3.0\x00"
PNG_XMP = "XML:com.adobe.xmp"
#: The image resource that holds a caption record.
CAPTIONS = 1028
# Fields of the caption record (record 2) that are reported
CAPTION_FIELDS = {40: "special_instructions", 65: "originating_program", 70: "program_version", 80: "byline", 110: "credit", 115: "source", 116: "copyright", 120: "caption"}
CAPTION_CHARS = 200
#: Longest text of a compressed chunk.
TEXT_BYTES = 1 << 20


def directory(block: bytes, at: int, order: str) -> tuple[dict[int, bytes | int], int]:
    """Tags of a TIFF directory (texts and other bytes as they are, whole numbers as such), and where the next directory is."""
    out: dict[int, bytes | int] = {}
    if at <= 0 or at + 2 > len(block):
        return out, 0
    count = struct.unpack_from(f"{order}H", block, at)[0]
    for i in range(count):
        place = at + 2 + 12 * i
        if place + 12 > len(block):
            return out, 0
        tag, kind, n = struct.unpack_from(f"{order}HHI", block, place)
        size = WIDTHS.get(kind, 0) * n
        start = place + 8 if size <= 4 else struct.unpack_from(f"{order}I", block, place + 8)[0]
        raw = block[start : start + size]
        if not size or len(raw) != size:
            continue
        if kind in (3, 4) and n == 1:
            out[tag] = struct.unpack(f"{order}{'H' if kind == 3 else 'I'}", raw)[0]
        else:
            out[tag] = raw
    end = at + 2 + 12 * count
    return out, struct.unpack_from(f"{order}I", block, end)[0] if end + 4 <= len(block) else 0


def exif(block: bytes) -> dict:
    """The fields of a TIFF block: main, exif (its part for photographs) and thumbnail (bytes or None)."""
    order = {b"II": "<", b"MM": ">"}.get(block[:2])
    if order is None or len(block) < 8:
        return {"main": {}, "exif": {}, "thumbnail": None}
    main, after = directory(block, struct.unpack_from(f"{order}I", block, 4)[0], order)
    part = main.get(EXIF_PART)
    photo = directory(block, part, order)[0] if isinstance(part, int) else {}
    second = directory(block, after, order)[0] if after else {}
    at, size = second.get(THUMB_AT), second.get(THUMB_SIZE)
    thumb = block[at : at + size] if isinstance(at, int) and isinstance(size, int) else b""
    return {"main": main, "exif": photo, "thumbnail": thumb or None}


def text_of(value: bytes | int | None) -> str | None:
    """A text field without its end mark and blanks; None where there is none."""
    if not isinstance(value, bytes):
        return None
    return value.decode("utf-8", "replace").strip("\x00").strip() or None


def resources(block: bytes) -> dict[int, bytes]:
    """Image resources (number to data) of a segment, as far as they are sound."""
    out, at = {}, 0
    while block[at : at + 4] == b"8BIM" and at + 12 <= len(block):
        number = int.from_bytes(block[at + 4 : at + 6], "big")
        at += 6
        at += (1 + block[at] + 1) & ~1  # a name, padded to even
        size = int.from_bytes(block[at : at + 4], "big")
        data = block[at + 4 : at + 4 + size]
        if len(data) != size:
            break
        out[number] = data
        at += 4 + size + (size & 1)
    return out


def captions(record: bytes) -> dict[str, str]:
    """The reported fields of a caption record; the first of several counts, and reading ends at the first malformed one."""
    out: dict[str, str] = {}
    at = 0
    while at + 5 <= len(record) and record[at] == 0x1C:
        part, field, size = record[at + 1], record[at + 2], int.from_bytes(record[at + 3 : at + 5], "big")
        value = record[at + 5 : at + 5 + size]
        if size & 0x8000 or len(value) != size:
            break
        name = CAPTION_FIELDS.get(field) if part == 2 else None
        text = value.decode("utf-8", "replace").strip()
        if name and text and name not in out:
            out[name] = text[:CAPTION_CHARS]
        at += 5 + size
    return out


def _inflated(data: bytes) -> bytes:
    return zlib.decompressobj().decompress(data, TEXT_BYTES)


def png_texts(data: bytes) -> dict[str, str]:
    """Text chunks by key, plain, compressed and international."""
    out: dict[str, str] = {}
    try:
        for name, body in png_chunks(data):
            if name not in (b"tEXt", b"zTXt", b"iTXt"):
                continue
            key, _, rest = body.partition(b"\x00")
            try:
                if name == b"tEXt":
                    value = rest.decode("latin-1")
                elif name == b"zTXt":
                    value = _inflated(rest[1:]).decode("latin-1")
                else:
                    packed, rest = rest[:1] == b"\x01", rest[2:]
                    rest = rest.partition(b"\x00")[2].partition(b"\x00")[2]  # language and translated key
                    value = (_inflated(rest) if packed else rest).decode("utf-8", "replace")
            except zlib.error:
                continue
            out.setdefault(key.decode("latin-1"), value)
    except Unreadable:
        pass
    return out


def _parts(data: bytes) -> tuple[dict[str, str], bytes, str | None, dict[int, bytes], dict[int, np.ndarray]]:
    """Texts, EXIF block, XMP, image resources and quantisation tables of a file."""
    texts: dict[str, str] = {}
    block, xmp, found, tables = b"", None, {}, {}
    kind = kind_of(data)
    if kind == "PNG":
        texts = png_texts(data)
        xmp = texts.pop(PNG_XMP, None)
        try:
            block = next((body for name, body in png_chunks(data) if name == b"eXIf"), b"")
        except Unreadable:
            pass
    elif kind == "JPEG":
        packed = b""
        try:
            for marker, body, _ in jpeg_segments(data):
                if marker == 0xE1 and body[:6] == b"Exif\x00\x00":
                    block = block or body[6:]
                elif marker == 0xE1 and body.startswith(XMP_HEAD):
                    xmp = xmp or body[len(XMP_HEAD) :].decode("utf-8", "replace")
                elif marker == 0xED and body.startswith(RESOURCE_HEAD):
                    packed += body[len(RESOURCE_HEAD) :]
                elif marker == 0xFE:
                    texts.setdefault("comment", body.decode("utf-8", "replace"))
                elif marker == 0xDB:
                    tables.update(quantisation_tables(body))
        except Unreadable:
            pass
        found = resources(packed)
    elif kind == "TIFF":
        block = data
        value = exif(data)["main"].get(XMP_TAG)
        xmp = value.decode("utf-8", "replace") if isinstance(value, bytes) else None
    elif kind == "WEBP":
        at = 12
        while at + 8 <= len(data):
            name, size = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
            body = data[at + 8 : at + 8 + size]
            if name == b"EXIF":
                block = body.removeprefix(b"Exif\x00\x00")
            elif name == b"XMP ":
                xmp = body.decode("utf-8", "replace")
            at += 8 + size + (size & 1)
    return texts, block, xmp, found, tables


def shrunk(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """A plane at a smaller size: triangle weights as wide as the step, so that every pixel counts."""

    def weights(n: int, m: int) -> np.ndarray:
        step = max(1.0, n / m)
        centre = (np.arange(m) + 0.5) * n / m - 0.5
        w = np.maximum(0.0, 1 - np.abs(np.arange(n)[None] - centre[:, None]) / step)
        return w / w.sum(1, keepdims=True)

    return weights(gray.shape[0], height) @ gray @ weights(gray.shape[1], width).T


def thumbnail_likeness(data: bytes, thumbnail: bytes) -> tuple[float, float]:
    """Mean difference (of 1) and correlation of the image and its embedded thumbnail."""
    small = luma(pixels(thumbnail))
    full = shrunk(luma(pixels(data)), *small.shape)
    a, b = full - full.mean(), small - small.mean()
    size = float(np.sqrt((a * a).sum() * (b * b).sum()))
    return float(np.abs(full - small).mean() / 255), float((a * b).sum() / size) if size else 0.0


def read(data: bytes) -> dict:
    """All that the rules ask for."""
    if not data.startswith(PNG_SIGNATURE) and kind_of(data) is None:
        raise Unreadable("no known image header")
    texts, block, xmp, found, tables = _parts(data)
    fields = exif(block)
    main, photo = fields["main"], fields["exif"]
    mad = ncc = error = None
    if fields["thumbnail"] and kind_of(data) in ("JPEG", "TIFF"):
        try:
            mad, ncc = thumbnail_likeness(data, fields["thumbnail"])
        except Unreadable as e:
            error = f"thumbnail: {e}"
    return {
        "format": kind_of(data),
        "has_exif": bool(main),
        "camera_make": text_of(main.get(MAKE)),
        "camera_model": text_of(main.get(MODEL)),
        "software": text_of(main.get(SOFTWARE)),
        "datetime_original": text_of(photo.get(TAKEN)),
        "lens_model": text_of(photo.get(LENS)),
        "orientation": main[ORIENTATION] if isinstance(main.get(ORIENTATION), int) else 1,
        "texts": texts,
        "xmp": xmp,
        "resources": sorted(found) if found else None,
        "iptc": captions(found.get(CAPTIONS, b"")),
        "thumbnail_mad": mad,
        "thumbnail_ncc": ncc,
        "luma_table": tables[0].tolist() if 0 in tables else None,
        "chroma_table": tables[1].tolist() if 1 in tables else None,
        "error": error,
    }
