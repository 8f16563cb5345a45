"""The rules that judge metadata: columns over what ``sources.images.read_metadata`` extracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kernels.signals import CHROMINANCE, LUMINANCE, quant_table
from .evidence import EDITORS, ai_terms, editor_terms

CAPTIONS = 1028
#: A thumbnail that is less alike, or further off, belongs to another picture.
LEAST_NCC, MOST_MAD = 0.6, 0.15
# Text chunks that only generators write, and those that may name one
GENERATOR_CHUNKS = ("parameters", "prompt", "workflow")
NAMING_CHUNKS = ("Software", "Comment", "Description", "comment", "description")
#: The mark that one platform leaves in captions; it tells of a new encoding, not of an edit.
PLATFORM_MARK = r"^FBMD[0-9a-fA-F]{8,}"


def _marker(where: str | Column, what: Column) -> Column:
    return F.struct((F.lit(where) if isinstance(where, str) else where).alias("place"), what.alias("name"))


def _each(where: str, terms: Column) -> Column:
    return F.transform(terms, lambda t: _marker(where, t))


def _if(holds: Column, where: str, what: str | Column) -> Column:
    return F.when(holds, _marker(where, F.lit(what) if isinstance(what, str) else what))


def ai_markers() -> Column:
    """Where a generator is named, in order and once each: text chunks, software, texts, XMP."""
    texts, soft = F.col("texts"), F.coalesce("software", F.lit(""))
    chunks = F.array_compact(F.array(*[_if(F.coalesce(F.map_contains_key(texts, F.lit(c)), F.lit(False)), "chunk", c) for c in GENERATOR_CHUNKS]))
    said = [_each("Software", ai_terms(F.when(soft != "", soft).otherwise(F.coalesce(F.element_at(texts, F.lit("Software")), F.lit("")))))]
    said += [_each(k, ai_terms(F.coalesce(F.element_at(texts, F.lit(k)), F.lit("")))) for k in NAMING_CHUNKS if k != "Software"]
    return F.array_distinct(F.concat(chunks, *said, _each("XMP", ai_terms(F.coalesce("xmp", F.lit(""))))))


def _first_editor(text: Column) -> Column:
    return F.get(editor_terms(text), F.lit(0))


def editor_markers() -> Column:
    """Traces of editors: the software field, image resources beside captions, the captions' program, and XMP."""
    xmp = F.coalesce("xmp", F.lit(""))
    low = F.lower(xmp)
    program = F.coalesce(F.element_at("iptc", F.lit("originating_program")), F.lit(""))
    others = F.filter(F.coalesce("resources", F.array().cast("array<int>")), lambda r: r != CAPTIONS)
    tool = F.regexp_extract(xmp, "(?i)creatortool[^>\"]*[>\"]([^<\"]+)[<\"]", 1)
    found = [
        F.when(_first_editor(F.coalesce("software", F.lit(""))).isNotNull(), _marker("Software", _first_editor(F.coalesce("software", F.lit(""))))),
        F.when(F.size(others) > 0, _marker("image resources", F.array_join(others.cast("array<string>"), ","))),
        F.when(_first_editor(program).isNotNull(), _marker("caption program", _first_editor(program))),
        _if(low.contains("xmpmm:history"), "XMP", "history"),
        _if(low.contains("stevt:action") & low.contains("edited"), "XMP", "edited"),
        _if(low.contains("photoshop:"), "XMP", "photoshop namespace"),
        F.when(_first_editor(tool).isNotNull(), _marker("XMP tool", _first_editor(tool))),
    ]
    return F.array_compact(F.array(*found))


def platform_markers() -> Column:
    special = F.coalesce(F.element_at("iptc", F.lit("special_instructions")), F.lit(""))
    return F.array_compact(F.array(F.when(special.rlike(PLATFORM_MARK), F.lit("FBMD"))))


def quality_columns(luma: str = "luma_table", chroma: str = "chroma_table") -> dict[str, Column]:
    """JPEG quality by the mean of the luma table, and whether the tables are the standard's at some quality (the highest that fits)."""
    mean = F.aggregate(F.col(luma), F.lit(0.0), lambda a, x: a + x) / F.size(luma)
    ratio = 100 * mean / float(LUMINANCE.mean())
    estimate = F.greatest(F.lit(1.0), F.least(F.lit(100.0), F.when(ratio <= 100, (200 - ratio) / 2).otherwise(5000 / ratio)))
    # the standard's tables as text, looked up by the file's, which are put together once for each row
    text = lambda q: ",".join(str(x) for base in (LUMINANCE, CHROMINANCE) for x in quant_table(base, q))
    standard = F.create_map(*[F.lit(x) for table, q in {text(q): q for q in range(1, 101)}.items() for x in (table, q)])
    exact = F.element_at(standard, F.array_join(F.concat(F.col(luma), F.col(chroma)).cast("array<string>"), ",", "null"))
    return {
        "jpeg_quality_estimate": F.when(F.col(luma).isNotNull(), F.bround(estimate).cast("int")),
        "jpeg_quality_exact": F.when(F.col(chroma).isNotNull() & F.col(luma).isNotNull(), exact),
        "jpeg_standard": F.when(F.col(chroma).isNotNull() & F.col(luma).isNotNull(), exact.isNotNull()),
    }


def judged(fields: DataFrame) -> DataFrame:
    """The fields with markers, score, label and note; the first rule that holds decides.

    A generator's marker 0.95; a thumbnail of another picture 0.85; an editor's marker 0.70; a camera without any 0.30; else 0.50,
    as for a file that can't be read. Platform marks never change the score.
    """
    mismatch = F.coalesce((F.col("thumbnail_ncc") < LEAST_NCC) | (F.col("thumbnail_mad") > MOST_MAD), F.lit(False))
    x = fields.withColumns({"ai_markers": ai_markers(), "editor_markers": editor_markers(), "platform_markers": platform_markers(), "thumbnail_mismatch": mismatch})
    camera = F.coalesce(F.col("has_exif") & F.col("camera_make").isNotNull(), F.lit(False))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    score = F.when(some("ai_markers"), 0.95).when(F.col("thumbnail_mismatch"), 0.85).when(some("editor_markers"), 0.70).when(camera, 0.30).otherwise(0.50)
    x = x.withColumn("score", score)
    label = F.when(F.col("score") >= 0.7, "fake").when(F.col("score") < 0.5, "real").otherwise("uncertain")
    note = F.when(F.col("score") == 0.5, F.when(some("platform_markers"), "encoded anew by a platform").otherwise("no metadata evidence"))
    return x.withColumns({"label": label, "note": note})


__all__ = ["EDITORS", "ai_markers", "editor_markers", "judged", "platform_markers", "quality_columns"]
