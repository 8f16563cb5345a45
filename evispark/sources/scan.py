"""Scans: file trees with header probes, JSON lines, image shards in Parquet; and their sinks."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kernels.signals import estimate_quality, zigzag
from ..schemas import ENTRY, SCORE
from . import paths

IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff")
PROMPT_CHARS = 200


def _segments(data: bytes) -> Iterator[tuple[int, bytes]]:
    """Marker segments of a JPEG up to its first scan."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xFF, 0x01) or 0xD0 <= marker <= 0xD8:
            at += 1 if marker == 0xFF else 2
            continue
        size = int.from_bytes(data[at + 2 : at + 4], "big")
        yield marker, data[at + 4 : at + 2 + size]
        if marker == 0xDA:
            return
        at += 2 + size


def luma_table(data: bytes) -> np.ndarray | None:
    """The first quantisation table, in natural order."""
    for marker, body in _segments(data):
        at = 0
        while marker == 0xDB and at < len(body):
            wide, number = body[at] >> 4, body[at] & 15
            raw = body[at + 1 : at + 1 + 64 * (1 + wide)]
            if number == 0 and len(raw) == 64 * (1 + wide):
                out = np.zeros((8, 8), np.int64)
                for (y, x), v in zip(zigzag(8), np.frombuffer(raw, ">u2" if wide else "u1"), strict=True):
                    out[y, x] = v
                return out.ravel()
            at += 1 + 64 * (1 + wide)
    return None


def probe(data: bytes) -> tuple[int, int, str, int | None]:
    """Width, height, format and JPEG quality from an image's header; pixels are not decoded."""
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        w, h = struct.unpack(">II", data[16:24])
        return w, h, "PNG", None
    if data[:2] == b"\xff\xd8":
        for marker, body in _segments(data):
            if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", body[1:5])
                table = luma_table(data)
                return w, h, "JPEG", None if table is None else estimate_quality(table)
        raise ValueError("no frame header")
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        if data[12:16] == b"VP8X":
            return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "WEBP", None
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "WEBP", None
        if data[12:16] == b"VP8 ":
            w, h = struct.unpack("<HH", data[26:30])
            return w & 0x3FFF, h & 0x3FFF, "WEBP", None
    if data[:4] in (b"II*\x00", b"MM\x00*"):
        e = "<" if data[:2] == b"II" else ">"
        at = struct.unpack(e + "I", data[4:8])[0]
        tags = {}
        for i in range(struct.unpack(e + "H", data[at : at + 2])[0]):
            tag, kind, _, value = struct.unpack(e + "HHI4s", data[at + 2 + 12 * i : at + 14 + 12 * i])
            tags[tag] = struct.unpack(e + ("H" if kind == 3 else "I"), value[: 2 if kind == 3 else 4])[0]
        if 256 in tags and 257 in tags:
            return tags[256], tags[257], "TIFF", None
    raise ValueError("no known image header")


_PROBE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("format", T.StringType()), T.StructField("jpeg_quality", T.IntegerType()), T.StructField("error", T.StringType())])


@F.arrow_udf(_PROBE)
def _probe(contents: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in contents:
        rows = []
        for data in batch:
            try:
                rows.append((*probe(data.as_py()), None))
            except (ValueError, IndexError, TypeError, struct.error) as e:
                rows.append((None, None, None, None, str(e) or "truncated"))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.string()]
        yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], _PROBE.names)


def probed(files: DataFrame) -> DataFrame:
    """Files (path, content, ...) with sha256, width, height, format and jpeg_quality, or an error; Python gets the contents alone, the other columns stay where they are."""
    kept = [c for c in files.columns if c != "content"]
    return files.select(*kept, F.sha2("content", 256).alias("sha256"), _probe("content").alias("_p")).select(*kept, "sha256", "_p.*")


def qualified(spark: SparkSession, root: str) -> str:
    """A folder's full name, as file listings have it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def _any_case(extension: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)


def scan_tree(spark: SparkSession, root: str, source: str, layout: paths.Layout | None = None, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> tuple[DataFrame, DataFrame]:
    """Entries of a tree and the files that could not be read; files without a label are left out without notice.

    Only files with these extensions are listed, and those without a label are dropped by path before a byte is read by Python.
    """
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{{{','.join(map(_any_case, extensions))}}}").load(base)
    files = files.select(F.substring("path", len(base) + 2, 1 << 20).alias("path"), "content")
    rules = layout or paths.Layout()
    listing = files.select("path") if rules.masks or rules.mask_template else None
    got = probed(paths.apply_layout(files, rules, listing))
    out = got.where("error is null").withColumn("source", F.lit(source)).select([f.name for f in ENTRY])
    return out, got.where("error is not null").select("path", "error")


def write_lines(path: str, lines: Iterator[str]) -> None:
    """A text file, in place only when it is whole."""
    system, place = fs.FileSystem.from_uri(path)
    with system.open_output_stream(f"{place}.part") as f:
        for line in lines:
            f.write(line.encode() + b"\n")
    system.move(f"{place}.part", place)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ENTRY).option("mode", "FAILFAST").json(path)


def write_entries(df: DataFrame, path: str) -> None:
    """JSON lines in the order of their paths; range partitions, so that no single task gets all."""
    df.orderBy("path").write.mode("overwrite").json(path)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORE).parquet(path)


SHARD = ("image_name", "format", "image_data", "label")
OPTIONAL = {"model_name": "string", "nsfw_flag": "boolean", "prompt": "string", "real_source": "string", "subset": "string", "split": "string", "architecture": "string"}


def read_shards(spark: SparkSession, path: str, existing: DataFrame | None = None) -> DataFrame:
    """Rows of image shards with a target path, or a reason why they are skipped."""
    raw = spark.read.parquet(path)
    missing = [c for c in SHARD if c not in raw.columns]
    if missing:
        raise ValueError(f"the shards lack {missing}")
    kind = dict(raw.dtypes)["label"]
    x = raw.select(*SHARD, *[F.col(c) if c in raw.columns else F.lit(None).cast(t).alias(c) for c, t in OPTIONAL.items()])
    label = paths.label_folder(F.col("label"), kind)
    stem = F.regexp_replace("image_name", r"\.[^./]*$", "")
    target = F.concat_ws("/", "label", F.coalesce(F.nullif(F.trim("model_name"), F.lit("")), F.lit("none")), F.coalesce("split", F.lit("none")), F.concat(stem, F.lit("."), paths.extension(F.col("format"))))
    x = x.withColumn("label", label).withColumn("target", target)
    reason = F.when(F.coalesce("nsfw_flag", F.lit(False)), "nsfw").when(F.col("image_data").isNull(), "no image")
    if existing is not None:
        there = existing.select(F.col("path").alias("target"), F.lit(True).alias("_there"))
        x = x.join(there, "target", "left")
        reason = reason.when(F.col("_there"), "exists")
    return x.withColumn("skip_reason", reason).withColumn("prompt", F.substring("prompt", 1, PROMPT_CHARS)).drop("_there")


def shard_report(rows: DataFrame) -> DataFrame:
    """Counts of what was written and why the rest was not."""
    return rows.groupBy(F.coalesce("skip_reason", F.lit("written")).alias("outcome"), "label").agg(F.count(F.lit(1)).alias("n"))
