"""Queries of dataset preparation, metadata, crops, caches and samples, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import crops, entries, features, fusion, metadata, metrics, reports, tools
from ..operators import rendering as R
from ..sources import adapters as A
from ..sources import datasets, paths
from .registry import query

E, S = A.ENTRIES_SQL, A.SCORE_SQL

LAYOUT = paths.Layout(
    real=["*/en/*.jpg"], fake=["*/de/*.jpg", "*/fr/*.jpg"], generator="grandparent", split="parent", split_map={"de": "val", "en": "train"},
    masks=[paths.MaskRule(r"/(?P<lang>de)/0*(?P<no>\d+)\.", "masks/{no}.png")], extra=[r"/0*(?P<no>\d+)\."],
)
PREPARED = """files AS (SELECT doc_id, source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.jpg' AS path, source, lang FROM documents WHERE lang IN ('en', 'de', 'fr')),
found AS (SELECT path, CASE lang WHEN 'en' THEN 'real' ELSE 'fake' END AS label, CASE lang WHEN 'en' THEN 'train' WHEN 'de' THEN 'val' END AS own_split, source, doc_id,
  CASE WHEN lang = 'de' THEN 'masks/' || doc_id || '.png' END AS rule, CASE WHEN lang = 'de' AND doc_id % 4 = 0 THEN 'masks/' || doc_id || '.png' END AS mask_path FROM files),
prepared AS (SELECT path, label, CASE WHEN label = 'fake' THEN CASE WHEN doc_id % 3 = 0 THEN 'side' ELSE source END END AS generator, CASE WHEN doc_id % 3 = 0 AND doc_id % 2 = 0 THEN 'test' ELSE own_split END AS split,
  mask_path, CAST(doc_id AS VARCHAR) AS no, rule FROM found)"""


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout, masks that are there, sidecar and the rule for reals' generators, as preparation applies them."""
    d = A.table(spark, sf_dir, "documents")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".jpg"))
    listing = d.where("doc_id % 4 = 0").select(F.concat(F.lit("masks/"), "doc_id", F.lit(".png")).alias("path"))
    found = paths.apply_layout(d.select(path.alias("path")), LAYOUT, listing)
    side = d.where("doc_id % 3 = 0").select(path.alias("path"), F.lit("side").alias("generator"), F.when(F.col("doc_id") % 2 == 0, "test").alias("split"), F.col("doc_id").alias("line"))
    return entries.generators_only_for_fakes(entries.with_sidecar(found, side))


@query(f"WITH {PREPARED} SELECT path, label, generator, split, mask_path, no FROM prepared")
def prepare_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prepared(spark, sf_dir).select("path", "label", "generator", "split", "mask_path", F.element_at("extra", F.lit("no")).alias("no"))


@query(
    f"WITH {PREPARED} SELECT count(*) AS fakes, count(mask_path) AS paired, count(*) FILTER (mask_path IS NULL AND rule IS NULL) AS no_rule, count(*) FILTER (mask_path IS NULL AND rule IS NOT NULL) AS no_file FROM prepared WHERE label = 'fake'"
)
def mask_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets.mask_coverage(_prepared(spark, sf_dir), LAYOUT)


@query(
    "SELECT r_regionkey AS region, names AS name, CASE WHEN kinds = 1 AND known = n THEN low END AS license, CASE WHEN bad > 0 THEN 'false' WHEN known = n THEN 'true' END AS commercial_ok, nullif(notes, '') AS notes FROM ("
    " SELECT n_regionkey AS r_regionkey, string_agg(n_name, '+' ORDER BY n_name) AS names, count(*) AS n, count(lic) AS known, count(DISTINCT lic) AS kinds, min(lic) AS low, count(*) FILTER (ok = false) AS bad, coalesce(string_agg(note, '; ' ORDER BY n_name), '') AS notes"
    " FROM (SELECT *, CASE WHEN n_nationkey % 5 <> 4 THEN 'L' || (n_regionkey % 2 + CASE WHEN n_regionkey = 3 THEN n_nationkey % 2 ELSE 0 END) END AS lic, CASE WHEN n_nationkey % 5 <> 4 THEN n_regionkey <> 1 END AS ok, CASE WHEN n_nationkey % 3 = 0 THEN 'note ' || n_nationkey END AS note FROM nation) GROUP BY n_regionkey)"
)
def merge_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets, merged by region."""
    known = F.col("n_nationkey") % 5 != 4
    number = F.col("n_regionkey") % 2 + F.when(F.col("n_regionkey") == 3, F.col("n_nationkey") % 2).otherwise(0)
    parts = A.table(spark, sf_dir, "nation").select(
        F.col("n_regionkey").alias("region"), F.col("n_name").alias("name"), F.when(known, F.concat(F.lit("L"), number.cast("string"))).alias("license"),
        F.when(known, F.col("n_regionkey") != 1).alias("commercial_ok"), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("note "), "n_nationkey")).alias("notes"),
    )
    return datasets.merged_meta(parts, "region").withColumn("commercial_ok", F.col("commercial_ok").cast("string"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What files might say about themselves: every document is one, with each kind of trace in some."""
    d = F.col("doc_id")
    pick = lambda m, *values: F.get(F.array(*[F.lit(v) for v in values]), (d % m).cast("int"))
    none = F.create_map().cast("map<string,string>")
    text = F.when(d % 11 == 0, F.create_map(F.lit("parameters"), F.lit("steps"))).when(d % 11 == 1, F.create_map(F.lit("Comment"), F.lit("made with ComfyUI"))).when(d % 11 == 2, F.create_map(F.lit("Description"), F.lit("an SDXL turbo")))
    iptc = F.when(d % 17 == 0, F.create_map(F.lit("special_instructions"), F.lit("FBMD0123456789"))).when(d % 17 == 1, F.create_map(F.lit("originating_program"), F.lit("gimp 2")))
    return A.table(spark, sf_dir, "documents").select(
        d.alias("doc_id"),
        F.coalesce(d % 4 != 0, F.lit(False)).alias("has_exif"),
        F.when(d % 3 == 0, "Acme").alias("camera_make"),
        pick(7, "Adobe Photoshop", "Midjourney v6", "firmware 2").alias("software"),
        F.coalesce(text, F.when(d % 11 == 3, F.create_map(F.lit("comment"), F.col("text"))), none).alias("texts"),
        pick(13, "<xmpMM:History/>", 'xmp:CreatorTool="Snapseed"', "trainedAlgorithmicMedia", "photoshop:City", "stEvt:action is Edited").alias("xmp"),
        F.coalesce(iptc, none).alias("iptc"),
        F.when(d % 19 == 0, F.array(F.lit(1028))).when(d % 19 == 1, F.array(F.lit(1005), F.lit(1028))).alias("resources"),
        F.when(d % 5 == 0, (d % 10) / 10.0).alias("thumbnail_ncc"),
        F.when(d % 5 == 0, F.lit(0.05)).alias("thumbnail_mad"),
        F.lit(None).cast("string").alias("error"),
    )


NAMED = r"(?i)stable[\s_-]*diffusion|(^|[^a-z0-9])(sdxl|firefly|ideogram)($|[^a-z0-9])|midjourney|dall[\s·•_-]?e($|[^a-z])|google\s*imagen|(^|[^a-z0-9])imagen[\s_-]*\d|(^|[^a-z0-9])flux[\s_.-]*(1|dev|schnell|pro|kontext)($|[^a-z0-9])|black[\s-]*forest[\s-]*labs|comfyui|novelai|leonardo[\s._-]*ai($|[^a-z])|automatic1111|sd[\s_-]*webui|algorithmicmedia|compositesynthetic"


@query(
    f"""WITH m AS (SELECT doc_id,
  CASE WHEN doc_id % 7 = 1 OR doc_id % 11 IN (0, 1, 2) OR doc_id % 13 = 2 THEN 1 WHEN doc_id % 11 = 3 THEN CAST(regexp_matches(coalesce(text, ''), '{NAMED}') AS INTEGER) ELSE 0 END AS ai,
  CASE WHEN doc_id % 5 = 0 AND doc_id % 10 < 6 THEN 1 ELSE 0 END AS swapped,
  CAST(doc_id % 7 = 0 AS INTEGER) + CAST(doc_id % 19 = 1 AS INTEGER) + CAST(doc_id % 17 = 1 AS INTEGER) + CAST(doc_id % 13 IN (0, 1, 3, 4) AS INTEGER) AS editors, doc_id % 4 <> 0 AND doc_id % 3 = 0 AS camera, doc_id % 17 = 0 AS platform FROM documents),
s AS (SELECT *, CASE WHEN ai > 0 THEN 0.95 WHEN swapped > 0 THEN 0.85 WHEN editors > 0 THEN 0.70 WHEN camera THEN 0.30 ELSE 0.50 END::DOUBLE AS score FROM m)
SELECT doc_id, score, CASE WHEN score >= 0.7 THEN 'fake' WHEN score < 0.5 THEN 'real' ELSE 'uncertain' END AS verdict, editors, platform, CASE WHEN score = 0.5 THEN CASE WHEN platform THEN 'encoded anew by a platform' ELSE 'no metadata evidence' END END AS note FROM s"""
)
def metadata_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = metadata.judged(_fields(spark, sf_dir))
    return got.select("doc_id", "score", F.col("label").alias("verdict"), F.size("editor_markers").alias("editors"), (F.size("platform_markers") > 0).alias("platform"), "note")


BASE = ", ".join(map(str, (*metadata.LUMINANCE.tolist(), *metadata.CHROMINANCE.tolist())))


@query(
    f"""WITH p AS (SELECT p_partkey, p_size, CASE WHEN p_size < 50 THEN 5000 // p_size ELSE 200 - 2 * p_size END AS scale, p_partkey % 5 = 0 AS odd FROM part),
t AS (SELECT *, list_transform([{BASE}], lambda b: greatest(1, least(255, (b * scale + 50) // 100)) + CAST(odd AS INTEGER)) AS v FROM p),
every AS (SELECT q, list_transform([{BASE}], lambda b: greatest(1, least(255, (b * CASE WHEN q < 50 THEN 5000 // q ELSE 200 - 2 * q END + 50) // 100))) AS w FROM range(1, 101) r(q)),
m AS (SELECT p_partkey, v, 100 * list_avg(v[1:64]) / (SELECT list_avg([{BASE}][1:64])) AS ratio FROM t)
SELECT p_partkey, CAST(round_even(greatest(1.0, least(100.0, CASE WHEN ratio <= 100 THEN (200 - ratio) / 2 ELSE 5000 / ratio END)), 0) AS INTEGER) AS estimate, coalesce((SELECT CAST(max(q) AS INTEGER) FROM every WHERE w = v), 0) AS exact FROM m"""
)
def jpeg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as JPEGs of a quality between 1 and 50, every fifth with tables of its own."""
    base = F.array(*[F.lit(int(x)) for x in (*metadata.LUMINANCE, *metadata.CHROMINANCE)])
    q = F.col("p_size")
    scale = F.when(q < 50, F.floor(F.lit(5000) / q)).otherwise(200 - 2 * q)
    odd = (F.col("p_partkey") % 5 == 0).cast("int")
    t = A.table(spark, sf_dir, "part").select("p_partkey", "p_size")
    p = t.repartition(A.parts(t, 32 << 10)).select("p_partkey", F.transform(base, lambda b: (F.greatest(F.lit(1), F.least(F.lit(255), F.floor((b * scale + 50) / 100))) + odd).cast("int")).alias("v"))
    x = p.select("p_partkey", F.slice("v", 1, 64).alias("luma_table"), F.slice("v", 65, 64).alias("chroma_table")).withColumns(metadata.quality_columns())
    return x.select("p_partkey", F.col("jpeg_quality_estimate").alias("estimate"), F.coalesce("jpeg_quality_exact", F.lit(0)).alias("exact"))


GRID = crops.CropPolicy(size=300, max_crops=4)


@query(
    f"""WITH {E}, i AS (SELECT path, width AS w, height AS h, greatest(width, 300) AS pw, greatest(height, 300) AS ph FROM entries WHERE width IS NOT NULL),
c AS (SELECT i.*, y.v AS y, x.v AS x, row_number() OVER (PARTITION BY path ORDER BY (2 * y.v + 300 - ph) * (2 * y.v + 300 - ph) + (2 * x.v + 300 - pw) * (2 * x.v + 300 - pw), y.v, x.v) - 1 AS crop
  FROM i, LATERAL (SELECT unnest(range(0, ph - 299, 300)) AS v) y, LATERAL (SELECT unnest(range(0, pw - 299, 300)) AS v) x),
b AS (SELECT path, crop, w, h, y - (ph - h) // 2 AS y, x - (pw - w) // 2 AS x FROM c WHERE crop < 4)
SELECT path, CAST(crop AS INTEGER) AS crop, CAST(greatest(0, least(y, h)) AS INTEGER) AS top, CAST(greatest(0, least(x, w)) AS INTEGER) AS left_, CAST(greatest(0, least(y + 300, h)) - greatest(0, least(y, h)) AS INTEGER) AS box_height,
  CAST(greatest(0, least(x + 300, w)) - greatest(0, least(x, w)) AS INTEGER) AS box_width FROM b"""
)
def crop_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crops.crop_boxes(A.entries(spark, sf_dir).where("width is not null").select("path", "width", "height"), GRID).select("path", "crop", "top", F.col("left").alias("left_"), "box_height", "box_width")


def _target_sql(mode: str) -> str:
    across = "(width // 400)"
    tiles = f"unnest(range(0, (height // 400) * {across}))" if mode == "tiles" else "CAST(NULL AS BIGINT)"
    place = f"(tile // {across}) * 400 AS top, (tile % {across}) * 400 AS left_" if mode == "tiles" else "(height - 400) // 2 AS top, (width - 400) // 2 AS left_"
    return f"""WITH {E}, jobs AS (SELECT *, CASE WHEN label IS NULL OR label <> 'real' THEN 'copied' WHEN least(width, height) < 450 THEN 'passthrough' ELSE 'cropped' END AS job FROM entries WHERE width IS NOT NULL),
cut AS (SELECT *, {place} FROM (SELECT *, {tiles} AS tile FROM jobs WHERE job = 'cropped'))
SELECT replace(path, '.jpg', '') || CASE WHEN tile IS NULL THEN '' ELSE '_t' || lpad(CAST(tile AS VARCHAR), CAST(greatest(2, length(CAST(tile AS VARCHAR))) AS INTEGER), '0') END || '.png' AS path, 400 AS width, 400 AS height, 'PNG' AS format, job, CAST(top AS INTEGER) AS top, CAST(left_ AS INTEGER) AS left_,
  CAST(tile AS VARCHAR) AS tile, path AS source_path, '{mode}' AS crop_mode FROM cut
UNION ALL SELECT path, width, height, format, job, -1, -1, NULL, path, CASE job WHEN 'passthrough' THEN '{mode}' END FROM jobs WHERE job <> 'cropped'"""


def _targets(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    e = A.entries(spark, sf_dir).where("width is not null").withColumn("label", F.coalesce("label", F.lit("unknown")))
    t = crops.target_rows(e, 400, mode, ["real"], 450)
    at = lambda k: F.element_at("extra", F.lit(k))
    return t.select("path", "width", "height", "format", "job", F.coalesce("top", F.lit(-1)).alias("top"), F.coalesce("left", F.lit(-1)).alias("left_"), at("tile_index").alias("tile"), "source_path", at("crop_mode").alias("crop_mode"))


@query(_target_sql("tiles"))
def crop_entries_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir, "tiles")


@query(_target_sql("center"))
def crop_entries_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _targets(spark, sf_dir, "center")


POLICY = features.CropPolicy(size=224)


@query(
    f"SELECT vec_id, CAST(view AS INTEGER) AS view, sha256(CAST(vec_id AS VARCHAR)) AS image_sha256, '{POLICY.fingerprint()}' AS policy_hash, vec_id % 3 = 0 AND view = 0 AS hit FROM embeddings, range(2) v(view)"
)
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of each vector against a cache of every third one's first view."""
    images = A.table(spark, sf_dir, "embeddings").select("vec_id", F.sha2(F.col("vec_id").cast("string"), 256).alias("image_sha256"), "embedding")
    wanted = features.keyed(images.drop("embedding"), "net", POLICY, views=2)
    cache = features.keyed(images.where("vec_id % 3 = 0"), "net", POLICY).select(*features.KEY, F.col("embedding").alias("features"), F.substring("image_sha256", 1, 2).alias("shard"))
    hits, misses = features.looked_up(wanted, cache)
    cols = ["vec_id", "view", "image_sha256", "policy_hash"]
    return hits.select(*cols, F.lit(True).alias("hit")).unionByName(misses.select(*cols, F.lit(False).alias("hit")))


@query("SELECT label AS backbone, count(*) AS n, CAST(sum(len(embedding) * 4) AS BIGINT) AS bytes FROM embeddings GROUP BY label")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.stats(A.table(spark, sf_dir, "embeddings").select(F.col("label").alias("backbone"), F.col("embedding").alias("features")))


@query("SELECT l_orderkey AS image, round(round(avg(round(1 / (1 + exp(-(l_discount * 100 - 5))), 9)), 9), 6) AS mean_score, round(round(max(1 / (1 + exp(-(l_discount * 100 - 5)))), 9), 6) AS max_score, count(*) AS crops FROM lineitem GROUP BY l_orderkey")
def crop_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as crops of their order."""
    t = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), (F.col("l_discount") * 100 - 5).alias("logit"))
    mean, most = (features.image_scores(t, ("image",), how=h).withColumn("score", F.round("score", 6)) for h in ("mean", "max"))
    return mean.withColumnRenamed("score", "mean_score").join(most.select("image", F.col("score").alias("max_score")), "image")


@query(f"WITH {E} SELECT path FROM entries ORDER BY sha256('5:' || path), path LIMIT 200")
def shuffled_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.first_after_shuffle(A.entries(spark, sf_dir), 200, 5).select("path")


def _calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.score_records(spark, sf_dir).select(fusion.logit(F.col("score")).alias("z"), metrics.is_fake().alias("y"))


@query(
    f"""WITH {S}, steps AS (SELECT y, CASE WHEN score = 0.5 THEN 0.0 ELSE ln(greatest(0.0001, least(0.9999, score)) / (1 - greatest(0.0001, least(0.9999, score)))) END AS z, count(*) AS m FROM score_records GROUP BY ALL),
g AS (SELECT 0.05 * pow(400, i / 399) AS t FROM range(400) r(i) UNION ALL SELECT 1.0),
n AS (SELECT t, round(sum(-m * (y * ln(p) + (1 - y) * ln(1 - p))) / sum(m), 8) AS nll FROM (SELECT y, m, t, greatest(0.0001, least(0.9999, 1 / (1 + exp(-z / t)))) AS p FROM steps, g) GROUP BY t)
SELECT round(t, 6) AS t, round(nll, 6) AS nll FROM n ORDER BY n.nll, abs(t - 1), t LIMIT 1"""
)
def best_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best_temperature(_calibration(spark, sf_dir)).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


@query()
def tool_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tools.catalogue(spark)


DETECTORS = ["discount", "quantity", "tax"]
MODEL = fusion.Fuser(DETECTORS, [0.5, -0.1, 0.25, 0.0, -0.75, 0.2], 0.1, 1.25, 0.4, 0.6)


@query(
    f"""WITH {S}, wide AS (SELECT entry_path, level, max(score) FILTER (detector = 'discount') AS d, max(score) FILTER (detector = 'quantity') AS q, max(score) FILTER (detector = 'tax') AS t FROM score_records WHERE NOT (detector = 'tax' AND elapsed_ms IS NULL) GROUP BY ALL)
SELECT entry_path, level, 3 AS detectors, CAST(d IS NOT NULL AS INTEGER) + CAST(q IS NOT NULL AS INTEGER) + CAST(t IS NOT NULL AS INTEGER) AS present, 0.4::DOUBLE AS low, 0.6::DOUBLE AS high, t AS tax_score FROM wide"""
)
def fusion_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payload, read back."""
    records = A.score_records(spark, sf_dir, by_entry=True).where(~((F.col("detector") == "tax") & F.col("elapsed_ms").isNull()))
    got = R.fusion_payload(fusion.features(records, DETECTORS, scores=True), MODEL)
    schema = "probability double, label string, band struct<low: double, high: double>, contributions array<struct<detector: string, score: double, weight: double, contribution: double, present: boolean, note: string>>"
    x = got.select("entry_path", "level", F.from_json("payload", schema).alias("p"))
    tax: Column = F.get(F.filter("p.contributions", lambda c: c["detector"] == "tax"), F.lit(0))["score"]
    present = F.size(F.filter("p.contributions", lambda c: c["present"]))
    return x.select("entry_path", "level", F.size("p.contributions").alias("detectors"), present.alias("present"), "p.band.low", "p.band.high", tax.alias("tax_score"))


@query()
def benchmark_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Markdown of a run, line by line."""
    text = R.benchmark_markdown("records", A.score_records(spark, sf_dir), reports.pixel_bundle(A.pixels(spark, sf_dir)))
    return spark.createDataFrame(list(enumerate(text.split("\n"))), "line long, text string")


@query()
def audit_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(R.audit_markdown(A.entries(spark, sf_dir).where("label is not null")).split("\n"))), "line long, text string")
