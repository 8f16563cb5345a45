"""Queries of the library's own operators by name, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import audit, entries, evidence, fusion, metrics, reports, suite, tools
from ..sources import adapters as A
from ..sources import paths
from ..streaming import sessions
from .registry import QUERIES, SQL, Query
from .registry import query as _query

DL = ["detector", "level"]


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


S = A.SCORE_SQL
RANKED = "ranked AS (SELECT *, rank() OVER (PARTITION BY {k} ORDER BY score) + (count(*) OVER (PARTITION BY {k}, score) - 1) / 2.0 AS r FROM {t})"


def _auc(keys: str, rows: str = "ranked") -> str:
    return f"SELECT {keys}, round((sum(CASE WHEN y = 1 THEN r END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0), 9) AS auc FROM {rows} GROUP BY {keys}"


RATES = """round(avg(CASE WHEN (score > thr) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(coalesce(sum(CASE WHEN score > thr AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(y), 0), 0.0), 9) AS tpr,
  round(coalesce(sum(CASE WHEN score > thr AND y = 0 THEN 1 ELSE 0 END) / nullif(sum(1 - y), 0), 0.0), 9) AS fpr,
  round((coalesce(sum(CASE WHEN score > thr AND y = 1 THEN 1 ELSE 0 END) / nullif(sum(y), 0), 0.0) + 1 - coalesce(sum(CASE WHEN score > thr AND y = 0 THEN 1 ELSE 0 END) / nullif(sum(1 - y), 0), 0.0)) / 2, 9) AS balanced_accuracy"""


def _best(keys: str, rows: str, name: str = "best") -> str:
    """Every distinct score against every row: the plain definition."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ks = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""tries AS (SELECT {ks}, b.score AS thr, (coalesce(sum(CASE WHEN a.score > b.score AND y = 1 THEN m ELSE 0 END) / nullif(sum(CASE WHEN y = 1 THEN m ELSE 0 END), 0), 0.0)
    + 1 - coalesce(sum(CASE WHEN a.score > b.score AND y = 0 THEN m ELSE 0 END) / nullif(sum(CASE WHEN y = 0 THEN m ELSE 0 END), 0), 0.0)) / 2 AS v
  FROM (SELECT {keys}, score, y, count(*) AS m FROM {rows} GROUP BY ALL) a JOIN (SELECT DISTINCT {keys}, score FROM {rows}) b ON {on} GROUP BY {ks}, b.score),
{name} AS (SELECT {keys}, arg_min(thr, (-round(v, 9), thr)) AS threshold, max(round(v, 9)) AS value FROM tries GROUP BY {keys})"""


@_query(_with(S, RANKED.format(k="detector, level", t="score_records")) + _auc("detector, level"))
def auc_by_detector_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(metrics.curve(A.score_records(spark, sf_dir), DL), DL)


@_query(_with(S, RANKED.format(k="detector, level", t="score_records")) + "SELECT detector, level, score, r AS average_rank, count(*) AS n FROM ranked GROUP BY ALL")
def average_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks from the curve's distinct scores: no window sees rows."""
    c = metrics.curve(A.score_records(spark, sf_dir), DL)
    n, below = F.col("p") + F.col("n"), F.col("p_below") + F.col("n_below")
    return c.select("detector", "level", "score", (below + (n + 1) / 2).alias("average_rank"), n.alias("n"))


@_query(
    _with(S)
    + """SELECT detector, level, round(sum(p / pos * tp / (tp + fp)), 9) AS average_precision FROM (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY detector, level) AS pos FROM (
    SELECT detector, level, score, sum(y) AS p, sum(1 - y) AS n FROM score_records GROUP BY ALL)
  WINDOW w AS (PARTITION BY detector, level ORDER BY score DESC)) GROUP BY detector, level"""
)
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(metrics.curve(A.score_records(spark, sf_dir), DL), DL)


@_query(_with(S) + f"SELECT detector, level, {RATES} FROM (SELECT *, 0.5 AS thr FROM score_records) GROUP BY detector, level")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.at_threshold(A.score_records(spark, sf_dir), DL, F.lit(0.5)).select(*DL, "accuracy", "tpr", "fpr", "balanced_accuracy")


@_query(_with(S, _best("detector, level", "score_records")) + "SELECT detector, level, threshold, value AS best_balanced_accuracy FROM best")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(metrics.curve(A.score_records(spark, sf_dir), DL), DL)


@_query(
    _with(S)
    + """SELECT detector, level, arg_min(thr, (-round(v, 9), thr)) AS threshold, max(round(v, 9)) AS best_accuracy FROM (
  SELECT a.detector, a.level, b.score AS thr, sum(CASE WHEN (a.score > b.score) = (y = 1) THEN m ELSE 0 END) / sum(m) AS v
  FROM (SELECT detector, level, score, y, count(*) AS m FROM score_records GROUP BY ALL) a JOIN (SELECT DISTINCT detector, level, score FROM score_records) b
  ON a.detector = b.detector AND a.level = b.level GROUP BY ALL) GROUP BY detector, level"""
)
def best_threshold_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.best_threshold(metrics.curve(A.score_records(spark, sf_dir), DL), DL, "accuracy")


ECE = """SELECT detector, level, round(sum(abs(s - h)) / sum(m), 7) AS ece FROM (
  SELECT detector, level, len(list_filter([i / 15::DOUBLE for i in range(1, 15)], lambda e: e < score)) AS bin, count(*) AS m, sum(score) AS s, sum(y) AS h
  FROM score_records GROUP BY ALL) GROUP BY detector, level"""


@_query(_with(S) + ECE)
def ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration_error(A.score_records(spark, sf_dir), DL)


@_query(_with(S) + "SELECT detector, level, round(avg((score - y) * (score - y)), 7) AS brier FROM score_records GROUP BY ALL")
def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.brier(A.score_records(spark, sf_dir), DL)


TUNED = _best("detector", "(SELECT * FROM score_records WHERE level = 'clean' AND split = 'val')")


@_query(_with(S, TUNED) + "SELECT DISTINCT s.detector, coalesce(threshold, 0.5) AS threshold FROM score_records s LEFT JOIN best USING (detector)")
def tuned_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tuned_thresholds(A.score_records(spark, sf_dir))


@_query(
    _with(S, "clean AS (SELECT * FROM score_records WHERE level = 'clean')", RANKED.format(k="detector", t="clean"), TUNED)
    + f"""SELECT detector, total, pos, threshold, auc, average_precision, accuracy, tpr, fpr, balanced_accuracy, ece, brier, tuned_threshold, tuned_balanced_accuracy, tuned_fpr, CAST(NULL AS VARCHAR) AS note
FROM (SELECT detector, count(*) AS total, CAST(sum(y) AS BIGINT) AS pos, 0.5::DOUBLE AS threshold, round(avg((score - y) * (score - y)), 7) AS brier, {RATES} FROM (SELECT *, 0.5 AS thr FROM clean) GROUP BY detector)
JOIN ({_auc("detector")}) USING (detector)
JOIN (SELECT detector, ece FROM ({ECE}) WHERE level = 'clean') USING (detector)
JOIN (SELECT detector, round(sum(p / pos2 * tp / (tp + fp)), 9) AS average_precision FROM (
  SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY detector) AS pos2 FROM (SELECT detector, score, sum(y) AS p, sum(1 - y) AS n FROM clean GROUP BY ALL)
  WINDOW w AS (PARTITION BY detector ORDER BY score DESC)) GROUP BY detector) USING (detector)
JOIN (SELECT detector, threshold AS tuned_threshold FROM best) USING (detector)
JOIN (SELECT detector, balanced_accuracy AS tuned_balanced_accuracy, fpr AS tuned_fpr FROM (
  SELECT detector, {RATES} FROM (SELECT clean.*, best.threshold AS thr FROM clean JOIN best USING (detector)) GROUP BY detector)) USING (detector)"""
)
def image_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.image_table(A.score_records(spark, sf_dir))


LEVEL_VALUES = ", ".join(f"('{x}')" for x in reports.LEVELS)


@_query(
    _with(S, RANKED.format(k="detector, level", t="score_records"), f"levels(level) AS (VALUES {LEVEL_VALUES})")
    + f"""SELECT d.detector, l.level, CASE l.level {' '.join(f"WHEN '{x}' THEN {-1 if x == 'clean' else i}" for i, x in enumerate(reports.LEVELS))} END AS ordinal, coalesce(n, 0) AS n, auc, balanced_accuracy, fpr, tpr
FROM (SELECT DISTINCT detector FROM score_records) d CROSS JOIN levels l
LEFT JOIN (SELECT detector, level, count(*) AS n, {RATES} FROM (SELECT *, 0.5 AS thr FROM score_records) GROUP BY detector, level) USING (detector, level)
LEFT JOIN ({_auc("detector, level")}) USING (detector, level)"""
)
def robustness_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.robustness_table(A.score_records(spark, sf_dir))


def _group_sql(key: str) -> str:
    grouped = f"grouped AS (SELECT *, coalesce({key}, 'none') AS \"group\" FROM score_records WHERE level = 'clean')"
    return _with(S, grouped, RANKED.format(k='detector, "group"', t="grouped")) + f'SELECT detector, "group", n, auc FROM ({_auc("detector, \"group\"")}) JOIN (SELECT detector, "group", count(*) AS n FROM grouped GROUP BY ALL) USING (detector, "group")'


@_query(_group_sql("source"))
def per_group_auc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_group_table(A.score_records(spark, sf_dir), "source").select("detector", "group", "n", "auc")


@_query(_group_sql("generator"))
def per_group_auc_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.per_group_table(A.score_records(spark, sf_dir), "generator").select("detector", "group", "n", "auc")


@_query(
    _with(
        S,
        "g AS (SELECT s.*, f.\"group\" FROM (SELECT DISTINCT generator AS \"group\" FROM score_records WHERE y = 1) f JOIN score_records s ON level = 'clean' AND (s.y = 0 OR s.generator = f.\"group\"))",
        RANKED.format(k='detector, "group"', t="g"),
    )
    + f'SELECT detector, "group", fakes, auc FROM ({_auc("detector, \"group\"")}) JOIN (SELECT detector, "group", CAST(sum(y) AS BIGINT) AS fakes FROM g GROUP BY ALL HAVING sum(y) > 0) USING (detector, "group")'
)
def generator_against_reals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.against_all_reals(A.score_records(spark, sf_dir))


@_query(_with(S) + "SELECT detector, level, round(avg(elapsed_ms), 5) AS mean_ms, count(elapsed_ms) AS n FROM score_records GROUP BY ALL")
def timing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.timing_table(A.score_records(spark, sf_dir))


P = A.PIXELS_SQL
PIXEL = """bundle AS (
  SELECT image, detector, level,
    round(CASE WHEN sum(said) + sum(y) > 0 THEN 2 * sum(y * said) / (sum(said) + sum(y)) ELSE 0.0 END, 9) AS f1_at_threshold,
    round(CASE WHEN sum(greatest(y, said)) > 0 THEN sum(y * said) / sum(greatest(y, said)) ELSE 0.0 END, 9) AS iou
  FROM (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS said FROM pixels) GROUP BY ALL),
bests AS (
  SELECT image, detector, level, round(max(f1), 9) AS best_f1 FROM (
    SELECT image, detector, level, t, CASE WHEN sum(y) + count(*) FILTER (p >= t) > 0 THEN 2 * sum(CASE WHEN p >= t THEN y ELSE 0 END) / (sum(y) + count(*) FILTER (p >= t)) ELSE 0.0 END AS f1
    FROM pixels, (SELECT i / 100::DOUBLE AS t FROM range(101) r(i)) GROUP BY ALL) GROUP BY ALL),
aps AS (
  SELECT image, detector, level, round(coalesce(sum(p1 / nullif(pos, 0) * tp / (tp + fp)), 0.0), 9) AS ap FROM (
    SELECT *, sum(p1) OVER w AS tp, sum(n1) OVER w AS fp, sum(p1) OVER (PARTITION BY image) AS pos FROM (SELECT image, detector, level, p, sum(y) AS p1, sum(1 - y) AS n1 FROM pixels GROUP BY ALL)
    WINDOW w AS (PARTITION BY image ORDER BY p DESC)) GROUP BY ALL)"""


@_query(_with(P, PIXEL) + "SELECT image, detector, level, f1_at_threshold, best_f1, ap, iou FROM bundle JOIN bests USING (image, detector, level) JOIN aps USING (image, detector, level)")
def pixel_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pixel_bundle(A.pixels(spark, sf_dir))


@_query(
    _with(P, PIXEL)
    + "SELECT detector, level, count(*) AS n, round(avg(f1_at_threshold), 7) AS f1_at_threshold, round(avg(best_f1), 7) AS best_f1, round(avg(ap), 7) AS ap, round(avg(iou), 7) AS iou FROM bundle JOIN bests USING (image, detector, level) JOIN aps USING (image, detector, level) GROUP BY ALL"
)
def pixel_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.pixel_table(reports.pixel_bundle(A.pixels(spark, sf_dir)))


@_query(
    _with(P)
    + """SELECT image, round(avg(p), 7) AS top_score FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY p DESC) AS i, count(*) OVER (PARTITION BY image) AS n FROM pixels)
WHERE i <= greatest(1, round_even(n * 0.34, 0)) GROUP BY image"""
)
def top_fraction_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a third in place of a hundredth, as these images have few pixels."""
    return reports.top_fraction(A.pixels(spark, sf_dir), ["image"], "p", 0.34)


@_query(
    _with(P)
    + """SELECT image, pixel, round(CASE WHEN n <= 1 OR lo = hi THEN 0.5 ELSE (r - 1) / (n - 1) END, 9) AS percentile FROM (
  SELECT *, rank() OVER (PARTITION BY image ORDER BY p) + (count(*) OVER (PARTITION BY image, p) - 1) / 2.0 AS r, count(*) OVER w AS n, min(p) OVER w AS lo, max(p) OVER w AS hi FROM pixels WINDOW w AS (PARTITION BY image))"""
)
def percentile_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.pixels(spark, sf_dir).select("image", "pixel", metrics.rounded(reports.percentile_ranks(["image"], "p")).alias("percentile"))


@_query(_with(P) + "SELECT image, pixel, round(CASE WHEN q <= 1e-6 THEN 0.0 ELSE greatest(0.0, least(1.0, p / q)) END, 9) AS scaled FROM (SELECT *, quantile_cont(p, 0.99) OVER (PARTITION BY image) AS q FROM pixels)")
def p99_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.p99_scaled(A.pixels(spark, sf_dir), ["image"], "p").select("image", "pixel", metrics.rounded(F.col("scaled")).alias("scaled"))


E = A.ENTRIES_SQL


def _axes_sql(*axes: str) -> str:
    return " UNION ALL ".join(f"SELECT '{a}' AS axis, coalesce(nullif({a}, ''), 'none') AS value, count(*) AS n FROM entries GROUP BY ALL" for a in axes)


@_query(_with(E) + _axes_sql("label", "source", "generator", "split", "format"))
def manifest_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.summary(A.entries(spark, sf_dir))


@_query(
    _with(E)
    + """SELECT path, label, split, mask_path, sha256 FROM (SELECT *, row_number() OVER (PARTITION BY sha256 ORDER BY path) AS i FROM entries
  WHERE split = 'train' AND mask_type IN ('bbox', 'segm') AND lang IN ('en', 'de') AND mask_path IS NOT NULL) WHERE i = 1"""
)
def filter_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = entries.filter_entries(A.entries(spark, sf_dir), split="train", extra={"mask_type": ["bbox", "segm"], "lang": ["en", "de"]}, require_mask=True, dedupe=True)
    return got.select("path", "label", "split", "mask_path", "sha256")


@_query(_with(E) + "SELECT sha256, min(path) AS path FROM entries GROUP BY sha256")
def dedupe_sha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.first_by_hash(A.entries(spark, sf_dir)).select("sha256", "path")


ALLOCATION = """sizes AS (SELECT coalesce(label, 'none') || '/' || coalesce(generator, 'none') AS stratum, count(*) AS size FROM entries GROUP BY ALL),
shares AS (SELECT *, least(floor(size * 100 / sum(size) OVER ()), size) AS fl, size * 100 / sum(size) OVER () AS quota, least(100, sum(size) OVER ()) AS want FROM sizes),
takes AS (SELECT stratum, size, CAST(least(size, fl + CASE WHEN row_number() OVER (ORDER BY round(fl - quota, 9), stratum) <= want - sum(fl) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS take FROM shares)"""


@_query(
    _with(E, ALLOCATION)
    + """SELECT path, label, generator FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY sha256('7:' || path), path) AS i
  FROM (SELECT *, coalesce(label, 'none') || '/' || coalesce(generator, 'none') AS stratum FROM entries)) JOIN takes USING (stratum) WHERE i <= take"""
)
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entries.stratified_sample(A.entries(spark, sf_dir), 100, 7).select("path", "label", "generator")


@_query(
    _with(
        E,
        "sizes AS (SELECT source AS g, count(*) AS size FROM entries WHERE label IS NOT NULL GROUP BY ALL)",
        "chosen AS (SELECT g FROM (SELECT g, sum(size) OVER w - size AS before, round_even(sum(size) OVER () * 0.25, 0) AS target FROM sizes WINDOW w AS (ORDER BY size DESC, sha256('3:' || g) ROWS UNBOUNDED PRECEDING)) WHERE before < target)",
    )
    + """SELECT path, CASE WHEN label IS NULL THEN CASE WHEN CAST('0x' || substr(sha256('3:' || path), 1, 8) AS BIGINT) / 4294967296 < 0.25 THEN 'val' ELSE 'train' END WHEN source IN (SELECT g FROM chosen) THEN 'val' ELSE 'train' END AS split FROM entries"""
)
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled entries in groups by source, the others one by one."""
    return entries.split_by_group(A.entries(spark, sf_dir), F.when(F.col("label").isNotNull(), F.col("source")), 0.25, 3).select("path", "split")


@_query(_with(E) + "SELECT '/a/' || path AS path, label FROM entries WHERE split = 'train' UNION ALL SELECT '/b/' || path, label FROM entries WHERE split = 'val'")
def merge_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir)
    return entries.merge([("/a", e.where("split = 'train'")), ("/b/", e.where("split = 'val'"))]).select("path", "label")


@_query(
    _with(E)
    + "SELECT source, coalesce(CAST(ok3 AS VARCHAR), 'unknown') AS commercial_ok FROM (SELECT source, CASE WHEN bool_or(ok = false) THEN false WHEN count(ok) = count(*) THEN true END AS ok3 FROM (SELECT source, CASE WHEN toxic IS NULL THEN NULL ELSE toxic = 0 END AS ok FROM entries) GROUP BY source)"
)
def licence_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.entries(spark, sf_dir).withColumn("ok", F.col("toxic") == 0)
    return e.groupBy("source").agg(F.coalesce(entries.commercial_ok("ok").cast("string"), F.lit("unknown")).alias("commercial_ok"))


@_query(
    _with(E)
    + """SELECT path, coalesce(s.generator, e.generator) AS generator, coalesce(s.split, e.split) AS split FROM entries e LEFT JOIN (
  SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.jpg' AS path, CASE WHEN doc_id % 2 = 0 THEN 'side' END AS generator, CASE WHEN doc_id % 3 = 0 THEN 'test' END AS split FROM documents WHERE doc_id % 5 < 3) s USING (path)"""
)
def sidecar_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents").where("doc_id % 5 < 3")
    path = F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".jpg"))
    side = d.select(path.alias("path"), F.when(F.col("doc_id") % 2 == 0, "side").alias("generator"), F.when(F.col("doc_id") % 3 == 0, "test").alias("split"), F.col("doc_id").alias("line"))
    earlier = side.select("path", F.lit("old").alias("generator"), F.lit("train").alias("split"), F.lit(-1).cast("long").alias("line"))
    return entries.with_sidecar(A.entries(spark, sf_dir), side.unionByName(earlier)).select("path", "generator", "split")


@_query(
    "SELECT vec_id, label IS NOT NULL AND vec_id % 3 = 0 AS hit FROM embeddings"
)
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = A.table(spark, sf_dir, "embeddings").select("vec_id")
    hits, misses = entries.cached(wanted, wanted.where("vec_id % 3 = 0"), ["vec_id"])
    return hits.withColumn("hit", F.lit(True)).unionByName(misses.withColumn("hit", F.lit(False)))


BUCKETS = {
    "format": "coalesce(format, 'none')",
    "resolution": "CASE WHEN least(width, height) < 512 THEN '<512' WHEN least(width, height) < 1024 THEN '512-1023' WHEN least(width, height) < 2048 THEN '1024-2047' ELSE '>=2048' END",
    "quality": "CASE WHEN jpeg_quality IS NULL THEN 'none' ELSE ((jpeg_quality - 1) // 10 * 10 + 1) || '-' || ((jpeg_quality - 1) // 10 * 10 + 10) END",
    "aspect": "CASE WHEN height = 0 OR width / height < 0.75 THEN '<0.75' WHEN width / height <= 1.33 THEN '0.75-1.33' ELSE '>1.33' END",
    "source": "source",
}
HISTOGRAMS = "histograms AS (" + " UNION ALL ".join(f"SELECT '{a}' AS axis, {b} AS bucket, label, count(*) AS n FROM entries WHERE label IS NOT NULL GROUP BY ALL" for a, b in BUCKETS.items()) + ")"


@_query(_with(E, HISTOGRAMS) + "SELECT axis, bucket, label, n FROM histograms")
def audit_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.histograms(A.entries(spark, sf_dir))


SHARES = """shares AS (SELECT axis, bucket, coalesce(sum(n) FILTER (label = 'real'), 0) / sum(coalesce(sum(n) FILTER (label = 'real'), 0)) OVER (PARTITION BY axis) AS p,
    coalesce(sum(n) FILTER (label = 'fake'), 0) / sum(coalesce(sum(n) FILTER (label = 'fake'), 0)) OVER (PARTITION BY axis) AS q FROM histograms WHERE NOT (axis = 'quality' AND bucket = 'none') GROUP BY axis, bucket)"""


@_query(
    _with(E, HISTOGRAMS, SHARES)
    + "SELECT axis, round(sqrt(greatest(0.0, least(1.0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))), 7) AS js_distance FROM shares GROUP BY axis"
)
def audit_js(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.js_distance(audit.histograms(A.entries(spark, sf_dir)))


@_query(
    "WITH e AS (SELECT 'format' AS axis, CASE WHEN quality = 1 AND doc_id % 20 > 0 THEN 'JPEG' WHEN quality = 1 THEN 'PNG' ELSE 'PNG' END AS bucket, CASE quality WHEN 1 THEN 'real' ELSE 'fake' END AS label FROM labels),"
    " s AS (SELECT axis, bucket, count(*) FILTER (label = 'real') / sum(count(*) FILTER (label = 'real')) OVER () AS p, count(*) FILTER (label = 'fake') / sum(count(*) FILTER (label = 'fake')) OVER () AS q FROM e GROUP BY ALL)"
    " SELECT axis, bucket, CASE WHEN p >= 0.9 AND q <= 0.1 THEN 'real' ELSE 'fake' END AS label FROM s WHERE (p >= 0.9 AND q <= 0.1) OR (q >= 0.9 AND p <= 0.1) ORDER BY bucket LIMIT 1"
)
def audit_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a relation that is biased on purpose: nearly all reals are JPEG."""
    e = A.table(spark, sf_dir, "labels").select(
        F.when((F.col("quality") == 1) & (F.col("doc_id") % 20 > 0), "JPEG").otherwise("PNG").alias("format"), F.when(F.col("quality") == 1, "real").otherwise("fake").alias("label")
    )
    return audit.dominance(audit.histograms(e, {"format": F.col("format")}))


@_query(
    _with(E)
    + 'SELECT real, fake, round(greatest(real, fake) / nullif(least(real, fake), 0), 9) AS ratio, coalesce(greatest(real, fake) / nullif(least(real, fake), 0) > 5, false) AS imbalanced, least(real, fake) = 0 AS single_label FROM (SELECT count(*) FILTER (label = \'real\') AS "real", count(*) FILTER (label = \'fake\') AS fake FROM entries)'
)
def audit_imbalance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.imbalance(A.entries(spark, sf_dir))


@_query(_with(E) + "SELECT CAST(sum(n - 1) AS BIGINT) AS surplus, CAST(count(*) FILTER (labels > 1) AS BIGINT) AS shared FROM (SELECT sha256, count(*) AS n, count(DISTINCT label) AS labels FROM entries WHERE label IS NOT NULL GROUP BY ALL)")
def audit_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.duplicates(A.entries(spark, sf_dir))


@_query(
    _with(E, HISTOGRAMS, SHARES)
    + """, js AS (SELECT axis, round(sqrt(greatest(0.0, least(1.0, sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)))), 7) AS d FROM shares GROUP BY axis),
n AS (SELECT count(*) FILTER (label = 'real') AS r, count(*) FILTER (label = 'fake') AS f FROM entries),
dup AS (SELECT sum(n - 1) AS surplus, count(*) FILTER (labels > 1) AS shared FROM (SELECT count(*) AS n, count(DISTINCT label) AS labels FROM entries WHERE label IS NOT NULL GROUP BY sha256))
SELECT 'distance' AS problem, axis || '=' || CAST(d AS VARCHAR) AS detail FROM js WHERE d > 0.3 AND axis IN ('format', 'resolution', 'quality')
UNION ALL (SELECT 'dominance', bucket || '=' || CASE WHEN p >= 0.9 THEN 'real' ELSE 'fake' END FROM shares WHERE axis = 'format' AND (p >= 0.9 AND q <= 0.1 OR q >= 0.9 AND p <= 0.1) ORDER BY bucket LIMIT 1)
UNION ALL SELECT 'imbalance', CAST(round(greatest(r, f) / least(r, f), 9) AS VARCHAR) FROM n WHERE least(r, f) > 0 AND greatest(r, f) / least(r, f) > 5
UNION ALL SELECT 'single label', '' FROM n WHERE least(r, f) = 0
UNION ALL SELECT 'duplicates surplus', CAST(CAST(surplus AS BIGINT) AS VARCHAR) FROM dup WHERE surplus > 0 UNION ALL SELECT 'duplicates shared', CAST(shared AS VARCHAR) FROM dup WHERE shared > 0"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.report(A.entries(spark, sf_dir))


LOGIT = "CASE WHEN {s} IS NULL OR {s} = 0.5 THEN 0.0 ELSE ln(greatest(0.0001, least(0.9999, {s})) / (1 - greatest(0.0001, least(0.9999, {s})))) END"
WIDE = """wide AS (SELECT entry_path, level, min(label) AS label, max(score) FILTER (detector = 'discount') AS s_discount, max(score) FILTER (detector = 'quantity') AS s_quantity, max(score) FILTER (detector = 'tax') AS s_tax
  FROM score_records WHERE NOT (detector = 'tax' AND elapsed_ms IS NULL) GROUP BY ALL),
z AS (SELECT entry_path, level, label, """ + ", ".join(f"{LOGIT.format(s=f's_{d}')} AS logit_{d}, CAST(s_{d} IS NOT NULL AS INTEGER) AS has_{d}" for d in ("discount", "quantity", "tax")) + " FROM wide)"
DETECTORS = ["discount", "quantity", "tax"]


def _some(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score records, where one detector misses some entries."""
    return A.score_records(spark, sf_dir, by_entry=True).where(~((F.col("detector") == "tax") & F.col("elapsed_ms").isNull()))


@_query(_with(S, WIDE) + "SELECT entry_path, level, label, " + ", ".join(f"round(logit_{d}, 9) AS logit_{d}, has_{d}" for d in DETECTORS) + " FROM z")
def fusion_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.features(_some(spark, sf_dir), DETECTORS)
    return f.withColumns({f"logit_{d}": metrics.rounded(F.col(f"logit_{d}")) for d in DETECTORS})


@_query(_with(S) + "SELECT DISTINCT entry_path, substr(sha256(entry_path || ':0'), 1, 16) <= '3333333333333333' AS held FROM score_records")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.score_records(spark, sf_dir).select("entry_path").distinct().select("entry_path", fusion.held_out(0).alias("held"))


@_query(_with(S) + "SELECT label, round(sum(count(*)) OVER () / (2 * count(*)), 9) AS weight FROM score_records GROUP BY label")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.class_weights(A.score_records(spark, sf_dir))


#: A model with round weights, for the queries that apply one.
MODEL = fusion.Fuser(DETECTORS, [0.5, -0.1, 0.25, 0.0, -0.75, 0.2], 0.1, 1.25, 0.4, 0.6)
Z = "(0.1 + 0.5 * logit_discount - 0.1 * has_discount + 0.25 * logit_quantity - 0.75 * logit_tax + 0.2 * has_tax)"


@_query(_with(S, WIDE) + f"SELECT entry_path, level, round(p, 9) AS probability, CASE WHEN round(p, 9) BETWEEN 0.4 AND 0.6 THEN 'uncertain' WHEN round(p, 9) > 0.6 THEN 'fake' ELSE 'real' END AS verdict FROM (SELECT *, 1 / (1 + exp(-{Z} / 1.25)) AS p FROM z)")
def fused_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.features(_some(spark, sf_dir), DETECTORS).withColumn("probability", metrics.rounded(MODEL.probability()))
    return f.select("entry_path", "level", "probability", MODEL.label(F.col("probability")).alias("verdict"))


@_query(
    _with(S, WIDE)
    + """SELECT entry_path, level, i AS place, detector, round(value, 9) AS value FROM (SELECT *, row_number() OVER (PARTITION BY entry_path, level ORDER BY round(abs(value), 12) DESC, detector) - 1 AS i FROM (
  SELECT entry_path, level, unnest(['discount', 'quantity', 'tax']) AS detector, unnest([0.5 * logit_discount, 0.25 * logit_quantity, -0.75 * logit_tax]) AS value FROM z))"""
)
def fused_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fusion.features(_some(spark, sf_dir), DETECTORS)
    x = f.select("entry_path", "level", F.posexplode(MODEL.explain()).alias("place", "c"))
    return x.select("entry_path", "level", F.col("place").cast("long").alias("place"), "c.detector", metrics.rounded(F.col("c.value")).alias("value"))


@_query(
    _with(S, WIDE, f"f AS (SELECT level, label, round(1 / (1 + exp(-{Z} / 1.25)), 9) AS score FROM z)")
    + f""", rows AS (SELECT level, detector AS scorer, label, score FROM score_records WHERE NOT (detector = 'tax' AND elapsed_ms IS NULL) UNION ALL SELECT level, 'fused', label, score FROM f
  UNION ALL SELECT level, 'fused_outside_band', label, score FROM f WHERE score < 0.4 OR score > 0.6), marked AS (SELECT *, CASE label WHEN 'fake' THEN 1 ELSE 0 END AS y, 0.5 AS thr FROM rows), {RANKED.format(k="level, scorer", t="marked")}
SELECT level, scorer, n, auc, balanced_accuracy, tpr, fpr FROM (SELECT level, scorer, count(*) AS n, {RATES} FROM marked GROUP BY level, scorer) JOIN ({_auc("level, scorer")}) USING (level, scorer)"""
)
def fused_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.evaluate(_some(spark, sf_dir), MODEL)


@_query(
    _with(S)
    + """SELECT round(t, 6) AS t, round(sum(-(y * ln(p) + (1 - y) * ln(1 - p))) / count(*), 6) AS nll FROM (
  SELECT y, t, greatest(0.0001, least(0.9999, 1 / (1 + exp(-z / t)))) AS p FROM (SELECT y, """ + LOGIT.format(s="score") + """ AS z FROM score_records WHERE detector = 'discount' AND level = 'clean'),
  (SELECT 0.05 * pow(400, i / 399) AS t FROM range(400) r(i) UNION ALL SELECT 1.0)) GROUP BY t"""
)
def temperature_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.score_records(spark, sf_dir).where("detector = 'discount' and level = 'clean'").select(fusion.logit(F.col("score")).alias("z"), metrics.is_fake().alias("y"))
    return fusion.temperatures(rows).select(F.round("t", 6).alias("t"), F.round("nll", 6).alias("nll"))


@_query(
    _with(
        S,
        "s AS (SELECT score AS p, y FROM score_records WHERE detector = 'quantity' AND level = 'clean')",
        "g AS (SELECT i, i / 100::DOUBLE AS t FROM range(101) r(i))",
        """c AS (SELECT lo.i AS i, hi.i AS j, sum(m) FILTER (p < lo.t OR p > hi.t) AS o, (coalesce(sum(m) FILTER (p > hi.t AND y = 1) / nullif(sum(m) FILTER ((p < lo.t OR p > hi.t) AND y = 1), 0), 0)
    + coalesce(sum(m) FILTER (p < lo.t AND y = 0) / nullif(sum(m) FILTER ((p < lo.t OR p > hi.t) AND y = 0), 0), 0)) / 2 AS b
  FROM g lo JOIN g hi ON lo.i <= hi.i, (SELECT p, y, count(*) AS m FROM s GROUP BY ALL) GROUP BY ALL)""",
        "ok AS (SELECT i, j, o, round(b, 9) AS b FROM c WHERE o >= (SELECT least(greatest(20, ceil(0.1 * count(*))), count(*)) FROM s))",
    )
    + """SELECT i / 100 AS low, j / 100 AS high, CAST(o AS BIGINT) AS outside, b AS bacc, b >= 0.5 AS target_met FROM ok
ORDER BY b >= 0.5 DESC, CASE WHEN b >= 0.5 THEN i - j END, CASE WHEN b < 0.5 THEN -b END, CASE WHEN b < 0.5 THEN j - i END, -b, i LIMIT 1"""
)
def abstain_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.score_records(spark, sf_dir).where("detector = 'quantity' and level = 'clean'").select(F.col("score").alias("p"), metrics.is_fake().alias("y"))
    return fusion.abstain_band(rows, 0.5)


LAYOUT = paths.Layout(
    real=["http*/**/en/**"], fake=["http*/**/fr/**", "http*/**/de/**"], exclude=["**/spam-farm*/**"], generator=r"//(?P<gen>\w+)\.", split=r"/(?P<split>[a-z]{2})/\d*[02468](?!\d)", split_map={"en": "train", "fr": "val", "de": "test"},
    masks=[paths.MaskRule(r"/(?P<lang>de|fr)/(?P<no>\d+)", "masks/{lang}_{no}.png")], extra=[r"page=(?P<page>\d+)", r"ref=(?P<ref>\w+)"],
)


@_query(
    r"""SELECT page_id, path, label, CASE WHEN label = 'fake' THEN nullif(regexp_extract(path, '//(\w+)\.', 1), '') END AS generator,
  CASE regexp_extract(path, '/([a-z]{2})/\d*[02468](?:[^\d]|$)', 1) WHEN 'en' THEN 'train' WHEN 'fr' THEN 'val' WHEN 'de' THEN 'test' END AS split,
  CASE WHEN regexp_matches(path, '/(de|fr)/(\d+)') THEN 'masks/' || regexp_extract(path, '/(de|fr)/(\d+)', 1) || '_' || regexp_extract(path, '/(de|fr)/(\d+)', 2) || '.png' END AS mask_path,
  nullif(regexp_extract(path, 'page=(\d+)', 1), '') AS page, nullif(regexp_extract(path, 'ref=(\w+)', 1), '') AS ref
FROM (SELECT page_id, url AS path, CASE WHEN regexp_full_match(url, '(?s)(?:.*/)?spam-farm[^/]*/.*') THEN NULL WHEN regexp_full_match(url, '(?s)http[^/]*/(?:.*/)?en/.*') THEN 'real'
  WHEN regexp_full_match(url, '(?s)http[^/]*/(?:.*/)?(?:fr|de)/.*') THEN 'fake' END AS label FROM pages) WHERE label IS NOT NULL"""
)
def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = paths.apply_layout(A.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path")), LAYOUT)
    return got.select("page_id", "path", "label", "generator", "split", "mask_path", F.element_at("extra", F.lit("page")).alias("page"), F.element_at("extra", F.lit("ref")).alias("ref"))


@_query(
    "SELECT page_id, array_to_string(list_filter([CASE WHEN regexp_matches(html, '(?i)stable[\\s_-]*diffusion') THEN 'Stable Diffusion' END, CASE WHEN regexp_matches(html, '(?i)midjourney') THEN 'Midjourney' END, CASE WHEN regexp_matches(html, '(?i)(^|[^a-z0-9])firefly([^a-z0-9]|$)') THEN 'Adobe Firefly' END], lambda x: x IS NOT NULL), ',') AS markers FROM (SELECT page_id, html || CASE page_id % 4 WHEN 0 THEN ' made with stable_diffusion' WHEN 1 THEN ' MidJourney v5, firefly.' ELSE ' fireflys' END AS html FROM pages)"
)
def marker_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with marker texts put in, as they have none."""
    mark = F.when(F.col("page_id") % 4 == 0, " made with stable_diffusion").when(F.col("page_id") % 4 == 1, " MidJourney v5, firefly.").otherwise(" fireflys")
    pages = A.table(spark, sf_dir, "pages").select("page_id", F.concat("html", mark).alias("html"))
    return pages.select("page_id", F.array_join(evidence.ai_terms(F.col("html")), ",").alias("markers"))


@_query(
    """WITH m AS (SELECT event_id, event_id % 7 AS k, event_type FROM events)
SELECT event_id, CASE k WHEN 0 THEN 0.50 WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 WHEN 3 THEN 0.60 WHEN 4 THEN 0.15 WHEN 5 THEN 0.70 ELSE 0.50 END::DOUBLE AS score,
  CASE k WHEN 1 THEN 'fake' WHEN 2 THEN 'fake' WHEN 5 THEN 'fake' WHEN 4 THEN 'real' ELSE 'uncertain' END AS verdict FROM m"""
)
def signed_manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest for each rule."""
    kinds = [
        None,
        '{"codes": ["assertion.dataHash.mismatch"], "source_type": "x/digitalCapture"}',
        '{"codes": ["signingCredential.untrusted"], "source_type": "http://x/trainedAlgorithmicMedia"}',
        '{"codes": [], "actions": ["c2pa.created", "c2pa.cropped"]}',
        '{"source_type": "http://x/digitalCapture", "actions": ["c2pa.created"]}',
        '{"codes": ["signingCredential.untrusted", "claimSignature.missing"]}',
        '{"source_type": "http://x/humanEdits"}',
    ]
    pick = F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 7 + 1).cast("int"))
    return evidence.signed_manifest_score(A.table(spark, sf_dir, "events").select("event_id", pick.alias("manifest"))).select("event_id", "score", "verdict")


@_query("SELECT event_id, CASE WHEN value < 0.35 THEN 'real' WHEN value > 0.65 THEN 'fake' ELSE 'uncertain' END AS verdict FROM events")
def score_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "events").select("event_id", evidence.label_from_score(F.col("value")).alias("verdict"))


BLOCKS = "blocks AS (SELECT l_suppkey AS image, l_partkey * 4 AS x, l_orderkey * 4 AS y, CAST(l_quantity AS INTEGER) AS f0, l_linenumber AS f1 FROM (SELECT DISTINCT l_suppkey, l_partkey, l_orderkey, l_quantity, l_linenumber FROM lineitem))"


@_query(
    _with(BLOCKS)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY f0, f1, y, x) AS i FROM blocks),
pairs AS (SELECT a.image, CASE WHEN b.y < a.y OR (b.y = a.y AND b.x < a.x) THEN a.x - b.x ELSE b.x - a.x END AS dx, CASE WHEN b.y < a.y OR (b.y = a.y AND b.x < a.x) THEN a.y - b.y ELSE b.y - a.y END AS dy
  FROM o a JOIN o b ON a.image = b.image AND b.i BETWEEN a.i + 1 AND a.i + 5 AND a.f0 = b.f0 AND a.f1 = b.f1 WHERE (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) >= 576),
votes AS (SELECT image, dx, dy, count(*) AS votes FROM pairs GROUP BY ALL)
SELECT image, dx, dy, votes FROM (SELECT *, row_number() OVER (PARTITION BY image ORDER BY votes DESC, dx, dy) AS r FROM votes) WHERE r = 1"""
)
def dominant_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = A.table(spark, sf_dir, "lineitem")
    # dealt by image once: the distinct rows, their order and the votes need no further shuffle
    rows = t.select("l_suppkey", "l_partkey", "l_orderkey", "l_quantity", "l_linenumber").repartition(A.parts(t), "l_suppkey").distinct()
    blocks = rows.select(F.col("l_suppkey").alias("image"), (F.col("l_partkey") * 4).alias("x"), (F.col("l_orderkey") * 4).alias("y"), F.col("l_quantity").cast("int").alias("f0"), F.col("l_linenumber").alias("f1"))
    return evidence.dominant_shift(evidence.block_pairs(blocks, ["f0", "f1"]))


@_query(
    """WITH q AS (SELECT l_orderkey AS block, l_linenumber AS quality, sum(CAST(l_extendedprice * 100 AS BIGINT)) AS mse FROM lineitem GROUP BY ALL),
n AS (SELECT *, lag(mse) OVER w AS b, lead(mse) OVER w AS a FROM q WINDOW w AS (PARTITION BY block ORDER BY quality))
SELECT block, coalesce(min(quality) FILTER ((b IS NULL OR mse < b) AND (a IS NULL OR mse < a)), arg_min(quality, (mse, quality))) AS quality FROM n GROUP BY block"""
)
def first_local_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("quality")).agg(F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("mse"))
    return evidence.first_local_minimum(q, ["block"], "quality", "mse")


@_query(_with(E) + f", levels(level, ordinal) AS (VALUES {', '.join(f"('{x.name}', {i})" for i, x in enumerate(suite.DEFAULT_SUITE))}) SELECT level, ordinal, count(*) AS jobs FROM entries CROSS JOIN levels GROUP BY ALL")
def benchmark_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suite.jobs(A.entries(spark, sf_dir).select("path")).groupBy("level", "ordinal").agg(F.count(F.lit(1)).alias("jobs"))


GAPS = """s AS (SELECT user_id, ts, sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k
  FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)),
sessions AS (SELECT user_id, min(ts) AS start, max(ts) AS last_used, count(*) AS n FROM s GROUP BY user_id, k)"""


@_query(_with(GAPS) + "SELECT user_id, start, last_used, n FROM sessions")
def ttl_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.ttl_sessions(A.table(spark, sf_dir, "events"))


@_query(_with(GAPS) + "SELECT user_id, start, last_used, n FROM sessions ORDER BY last_used DESC, user_id, start DESC LIMIT 32")
def lru_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.most_recent(sessions.ttl_sessions(A.table(spark, sf_dir, "events")))


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("session"), F.col("event_type").alias("tool"), (F.col("event_id") % 5).alias("params"), F.col("event_id").alias("seq"), F.col("value").alias("result"))


@_query("SELECT user_id AS session, event_type AS tool, arg_max(value, event_id) AS result, min(event_id) AS first_seq FROM events GROUP BY ALL")
def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.latest_runs(_runs(spark, sf_dir))


@_query("SELECT user_id AS session, event_type AS tool, event_id % 5 AS params, min(event_id) AS seq, count(*) - 1 AS hits FROM events GROUP BY ALL")
def memoised_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.memoised(_runs(spark, sf_dir))


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 64 x 64 pixels, drawn from the embeddings: each row an outer product, with a patch copied in every third."""
    import numpy as np
    import pyarrow as pa

    def draw(batches):
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            ids, data = batch.column("vec_id").to_pylist(), []
            for i, v in zip(ids, batch.column("embedding").to_pylist(), strict=True):
                v = np.asarray(v, float)
                waves = np.sin(np.outer(np.arange(64), v[:8]).sum(1))[:, None] + np.cos(np.outer(np.arange(64), v[8:16]).sum(1))[None, :]
                a = 128 + 40 * waves + 25 * np.outer(v, v[::-1]) / max(1e-9, np.abs(v).max() ** 2)
                rgb = np.clip(np.stack([a, np.roll(a, 1, 0), a.T], -1), 0, 255).astype(np.uint8)
                if i % 3 == 0:
                    rgb[36:60, 36:60] = rgb[4:28, 4:28]
                data.append(rgb.tobytes())
            n = len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}.png" for i in ids]), pa.array([64] * n, pa.int32()), pa.array([64] * n, pa.int32()), pa.array(data, pa.binary())], ["entry_path", "height", "width", "rgb"])

    # a vector is small and its image is much work, so tasks get few rows: no worker is sent more than some hundred images, and all cores have some
    t = A.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return t.repartition(A.parts(t, 128 << 10)).mapInArrow(draw, "entry_path string, height int, width int, rgb binary")


@_query()
def image_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All signals and baselines over drawn images."""
    got = tools.run_tools(_images(spark, sf_dir), [*tools.available("signal"), *tools.available("baseline")])
    return got.select("entry_path", "level", "tool", F.round("score", 6).alias("score"), "details")


@_query()
def image_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = tools.run_tools(_images(spark, sf_dir), tools.available("view"), arguments={"bit_planes": {"plane": 3}, "noise_residual": {"window": 5}})
    return got.select("entry_path", "level", "tool", "score", "details")  # a map's mean and shape are in the details


@_query()
def image_robustness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error levels at all levels of the default suite; levels without a codec abstain."""
    got = tools.run_tools(_images(spark, sf_dir), ["ela"], suite.DEFAULT_SUITE)
    return got.groupBy("level").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.sum(F.col("details").contains("unsupported").cast("long")).alias("unsupported"))


from . import preparation  # noqa: E402, F401  its queries register themselves
