"""Encoded images as rows: pixels with their hash, metadata, JPEG coefficients. A file that can't be read gives an error, never a failed job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from ..kernels import codecs, metadata

#: Bytes of encoded or raw images that a Python worker holds at a time, unless one image has more.
SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``limit`` bytes in a binary column."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if batch.num_rows:
        yield batch.slice(start)


def per_image(files: DataFrame, work: Callable[[bytes], dict], fields: dict[str, pa.DataType], schema: str, path: str = "path") -> DataFrame:
    """(path, fields, error) of files (path, content): what ``work`` says of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "content"):
                rows = []
                for data in part.column("content"):
                    try:
                        if not data.is_valid:
                            raise codecs.Unreadable("no content")
                        rows.append({"error": None} | work(data.as_py()))
                    except Exception as e:  # noqa: BLE001  any damage is this image's error alone
                        rows.append({"error": str(e) or type(e).__name__})
                columns = [pa.array([r.get(f) for r in rows], kind) for f, kind in fields.items()]
                yield pa.RecordBatch.from_arrays([part.column(path), *columns, pa.array([r["error"] for r in rows], pa.string())], [path, *fields, "error"])

    return files.select(path, "content").mapInArrow(run, f"{path} string, {schema}, error string")


def _open(data: bytes) -> dict:
    turn = metadata.read(data)["orientation"]
    rgb = codecs.turned(codecs.pixels(data), turn)
    raw = rgb.tobytes()
    return {"format": codecs.kind_of(data), "height": rgb.shape[0], "width": rgb.shape[1], "rgb": raw, "raw": data, "pixel_sha256": hashlib.sha256(raw).hexdigest()}


def open_images(files: DataFrame) -> DataFrame:
    """Upright RGB pixels of files beside their bytes, and a hash of the pixels."""
    fields = {"format": pa.string(), "height": pa.int32(), "width": pa.int32(), "rgb": pa.binary(), "raw": pa.binary(), "pixel_sha256": pa.string()}
    return per_image(files, _open, fields, "format string, height int, width int, rgb binary, raw binary, pixel_sha256 string").withColumnRenamed("path", "entry_path")


def read_metadata(files: DataFrame) -> DataFrame:
    """What files say about themselves, for the rules of ``operators.metadata``."""
    text = ("format", "camera_make", "camera_model", "software", "datetime_original", "lens_model", "xmp")
    fields = {f: pa.string() for f in text} | {
        "has_exif": pa.bool_(),
        "orientation": pa.int32(),
        "texts": pa.map_(pa.string(), pa.string()),
        "iptc": pa.map_(pa.string(), pa.string()),
        "resources": pa.list_(pa.int32()),
        "thumbnail_mad": pa.float64(),
        "thumbnail_ncc": pa.float64(),
        "luma_table": pa.list_(pa.int32()),
        "chroma_table": pa.list_(pa.int32()),
    }

    def work(data: bytes) -> dict:
        got = metadata.read(data)
        return got | {"texts": list(got["texts"].items()), "iptc": list(got["iptc"].items())}

    kinds = {f: "string" for f in text} | {
        "has_exif": "boolean", "orientation": "int", "texts": "map<string,string>", "iptc": "map<string,string>", "resources": "array<int>",
        "thumbnail_mad": "double", "thumbnail_ncc": "double", "luma_table": "array<int>", "chroma_table": "array<int>",
    }
    return per_image(files, work, fields, ", ".join(f"{f} {kinds[f]}" for f in fields))


def luma_coefficients(files: DataFrame) -> DataFrame:
    """(path, rows, columns, coefficients binary, table, error): quantised luma coefficients as little-endian 16-bit numbers, block by block in raster order, each block's 64 in natural order."""

    def work(data: bytes) -> dict:
        c, table = codecs.luma_coefficients(data)
        return {"rows": c.shape[0], "columns": c.shape[1], "coefficients": np.ascontiguousarray(c).astype("<i2").tobytes(), "table": table.ravel().tolist()}

    fields = {"rows": pa.int32(), "columns": pa.int32(), "coefficients": pa.binary(), "table": pa.list_(pa.int32())}
    return per_image(files, work, fields, "rows int, columns int, coefficients binary, table array<int>")
