"""Evidence from marker texts, signed manifests, and block matches: the parts of the signal tools that columns can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Names and patterns of generators, in the order in which they are reported
AI_MARKERS = (
    ("Stable Diffusion", r"stable[\s_-]*diffusion"),
    ("SDXL", r"(?<![a-z0-9])sdxl(?![a-z0-9])"),
    ("Midjourney", r"midjourney"),
    ("DALL-E", r"dall[\s·•_-]?e(?![a-z])"),
    ("Adobe Firefly", r"(?<![a-z0-9])firefly(?![a-z0-9])"),
    ("Google Imagen", r"google\s*imagen|(?<![a-z0-9])imagen[\s_-]*\d"),
    ("FLUX", r"(?<![a-z0-9])flux(?:[\s_.-]*(?:1|dev|schnell|pro|kontext))(?![a-z0-9])|black[\s-]*forest[\s-]*labs"),
    ("ComfyUI", r"comfyui"),
    ("NovelAI", r"novelai"),
    ("Leonardo.Ai", r"leonardo[\s._-]*ai(?![a-z])"),
    ("Ideogram", r"(?<![a-z0-9])ideogram(?![a-z0-9])"),
    ("Automatic1111", r"automatic1111|sd[\s_-]*webui"),
    ("IPTC digitalSourceType algorithmicMedia", r"algorithmicmedia|compositesynthetic"),
)
# Names of editors
EDITORS = ("Photoshop", "Lightroom", "GIMP", "Affinity", "Snapseed", "Pixelmator", "Capture One", "Luminar", "Canva", "Picsart", "Facetune")
# Status codes, actions and source types of signed manifests
HASH_MISMATCH = ("assertion.dataHash.mismatch", "assertion.hashedURI.mismatch")
TRUST_FAILURE = ("signingCredential.untrusted", "signingCredential.selfSigned")
EDIT_ACTIONS = ("c2pa.edited", "c2pa.placed", "c2pa.removed", "c2pa.cropped", "c2pa.filtered", "c2pa.color_adjustments", "c2pa.resized")
AI_SOURCES = ("trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia")
CAPTURE = "digitalCapture"

LOW, HIGH = 0.35, 0.65
MIN_VOTES, NEIGHBOURS, MIN_DISTANCE = 12, 5, 24


def label_from_score(score: Column) -> Column:
    """Strict on both sides."""
    return F.when(score < LOW, "real").when(score > HIGH, "fake").otherwise("uncertain")


def ai_terms(text: Column) -> Column:
    """The generators that a text names, in the fixed order."""
    return F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), F.lit(n)) for n, p in AI_MARKERS]))


def editor_terms(text: Column) -> Column:
    lower = F.lower(text)
    return F.array_compact(F.array(*[F.when(lower.contains(n.lower()), F.lit(n)) for n in EDITORS]))


def _starts(codes: Column, prefixes) -> Column:
    return F.exists(codes, lambda c: F.exists(F.array(*map(F.lit, prefixes)), lambda p: c.startswith(p)))


def signed_manifest_score(df: DataFrame, manifest: str = "manifest") -> DataFrame:
    """score and verdict from JSON (codes, actions, source_type, claim_generator): the first rule that holds; no manifest proves nothing."""
    schema = "codes array<string>, actions array<string>, source_type string, claim_generator string"
    x = df.withColumn("m", F.from_json(manifest, schema))
    codes, actions = F.coalesce("m.codes", F.array().cast("array<string>")), F.coalesce("m.actions", F.array().cast("array<string>"))
    source = F.element_at(F.split(F.coalesce("m.source_type", F.lit("")), "/"), F.lit(-1))
    trust_only = (F.size(codes) > 0) & F.forall(codes, lambda c: F.exists(F.array(*map(F.lit, TRUST_FAILURE)), lambda p: c.startswith(p)))
    ok = (F.size(codes) == 0) | trust_only
    ai = source.rlike("|".join(AI_SOURCES)) | (F.size(ai_terms(F.coalesce("m.claim_generator", F.lit("")))) > 0)
    edited = F.arrays_overlap(actions, F.array(*map(F.lit, EDIT_ACTIONS)))
    score = (
        F.when(F.col(manifest).isNull(), 0.50)
        .when(_starts(codes, HASH_MISMATCH), 0.85)
        .when(ok & ai, 0.95)
        .when(ok & edited, 0.60)
        .when(ok & (source == CAPTURE), 0.15)
        .when(~ok, 0.70)
        .otherwise(0.50)
    )
    return x.withColumn("score", score).withColumn("verdict", F.when(F.col("score") >= 0.7, "fake").when(F.col("score") < LOW, "real").otherwise("uncertain")).drop("m")


def block_pairs(blocks: DataFrame, features: list[str]) -> DataFrame:
    """(image, dx, dy) of blocks (image, x, y, features) with equal features, near in the features' order and far apart in the image.

    The neighbourhood of the next few rows takes the place of a self join; the shift is that from the raster-earlier block.
    """
    order = Window.partitionBy("image").orderBy(*features, "y", "x")
    near = F.array(*[F.lead(F.struct(*features, "x", "y"), k).over(order) for k in range(1, NEIGHBOURS + 1)])
    other = blocks.withColumn("near", near).select("image", "x", "y", *features, F.explode("near").alias("o"))
    same = F.lit(True)
    for f in features:
        same &= F.col(f) == F.col(f"o.{f}")
    dx, dy = F.col("o.x") - F.col("x"), F.col("o.y") - F.col("y")
    found = other.where(same & (dx * dx + dy * dy >= MIN_DISTANCE**2))
    turn = F.when((dy < 0) | ((dy == 0) & (dx < 0)), -1).otherwise(1)
    return found.select("image", (dx * turn).alias("dx"), (dy * turn).alias("dy"))


def dominant_shift(pairs: DataFrame) -> DataFrame:
    """(image, dx, dy, votes): the shift with the most votes, the smaller dx, then dy, of several."""
    votes = pairs.groupBy("image", "dx", "dy").agg(F.count(F.lit(1)).alias("votes"))
    best = F.max(F.struct("votes", (-F.col("dx")).alias("a"), (-F.col("dy")).alias("b")))
    return votes.groupBy("image").agg(best.alias("x")).select("image", (-F.col("x.a")).alias("dx"), (-F.col("x.b")).alias("dy"), "x.votes")


def first_local_minimum(df: DataFrame, keys: list[str], axis: str, value: str) -> DataFrame:
    """The first place along the axis that is strictly below both neighbours, ends included; else the first of the least values."""
    w = Window.partitionBy(*keys).orderBy(axis)
    before, after = F.lag(value).over(w), F.lead(value).over(w)
    low = (before.isNull() | (F.col(value) < before)) & (after.isNull() | (F.col(value) < after))
    return df.withColumn("low", F.when(low, F.col(axis))).groupBy(*keys).agg(F.coalesce(F.min("low"), F.min_by(axis, F.struct(value, axis))).alias(axis))
