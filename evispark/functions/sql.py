"""The engine's scalar rules as temporary SQL functions, and its tiles as a table function.

The scalar ones are SQL bodies that Catalyst inlines, so they cost what the written-out expression costs; each equals the
column of the same rule in ``operators``.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import HIGH, LOW
from ..operators.fusion import CLIP, HOLDOUT_PREFIX
from ..sources.paths import EXTENSIONS

_CLIPPED = f"greatest({CLIP}D, least(1 - {CLIP}D, score))"
_STEP = "floor((greatest(1, least(100, quality)) - 1) / 10) * 10 + 1"
#: name: (arguments, type, body)
FUNCTIONS = {
    "evi_label": ("score DOUBLE", "STRING", f"CASE WHEN score < {LOW}D THEN 'real' WHEN score > {HIGH}D THEN 'fake' ELSE 'uncertain' END"),
    "evi_logit": ("score DOUBLE", "DOUBLE", f"CASE WHEN score = 0.5D THEN 0D WHEN score IS NOT NULL THEN ln({_CLIPPED} / (1 - {_CLIPPED})) END"),
    "evi_group": ("value STRING", "STRING", "coalesce(nullif(value, ''), 'none')"),
    "evi_resolution": ("width INT, height INT", "STRING", "CASE WHEN least(width, height) < 512 THEN '<512' WHEN least(width, height) < 1024 THEN '512-1023' WHEN least(width, height) < 2048 THEN '1024-2047' ELSE '>=2048' END"),
    "evi_quality": ("quality INT", "STRING", f"CASE WHEN quality IS NULL THEN 'none' ELSE concat({_STEP}, '-', {_STEP} + 9) END"),
    "evi_aspect": ("width INT, height INT", "STRING", "CASE WHEN height = 0 OR width / nullif(height, 0) < 0.75D THEN '<0.75' WHEN width / nullif(height, 0) <= 1.33D THEN '0.75-1.33' ELSE '>1.33' END"),
    "evi_held_out": ("path STRING, seed INT", "BOOLEAN", f"substring(sha2(concat(path, ':', seed), 256), 1, 16) <= '{HOLDOUT_PREFIX}'"),
    "evi_extension": (
        "format STRING",
        "STRING",
        "CASE lower(trim(format)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EXTENSIONS.items()) + " ELSE coalesce(nullif(lower(trim(format)), ''), 'bin') END",
    ),
}


class Tiles:
    """Whole tiles of an image in rows from the top: (tile, top, left)."""

    def eval(self, height: int, width: int, size: int) -> Iterator[tuple[int, int, int]]:
        if height is None or width is None or size is None or size <= 0:
            return
        across = width // size
        for i in range(height // size * across):
            yield i, i // across * size, i % across * size


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to a session; returns their names."""
    for name, (arguments, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("evi_tiles", F.udtf(Tiles, returnType="tile: int, top: int, left: int"))
    return [*FUNCTIONS, "evi_tiles"]
