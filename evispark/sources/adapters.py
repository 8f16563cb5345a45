"""Views over the supplied tables with the engine's schemas, as DataFrames and as SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of Parquet whose rows one task groups or orders.
TASK_BYTES = 4 << 20


def parts(t: DataFrame, task_bytes: int = TASK_BYTES) -> int:
    """Into how many tasks a table's rows are dealt: by its bytes on disk, so that a task's share doesn't grow with the table; at least the session's number."""
    size = int(t._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return max(int(t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // task_bytes))


def score_records(spark: SparkSession, sf_dir: str, by_entry: bool = False) -> DataFrame:
    """Long-form score records: every line item is an entry with three detectors' scores; ``by_entry`` deals them by entry, for plans that group by it."""
    t = table(spark, sf_dir, "lineitem")
    rows = t.withColumn("entry_path", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    if by_entry:
        rows = rows.repartition(parts(t), "entry_path")
    fake = F.col("l_returnflag") == "R"
    base = rows.select(
        "entry_path",
        F.when(fake, "fake").otherwise("real").alias("label"),
        F.concat(F.lit("src"), F.col("l_suppkey") % 20).alias("source"),
        F.when(fake, F.concat(F.lit("gen"), F.col("l_partkey") % 7)).alias("generator"),
        F.when(F.col("l_orderkey") % 5 == 0, "val").otherwise("test").alias("split"),
        F.when(F.col("l_linestatus") == "O", "clean").otherwise("jpeg_q75").alias("level"),
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") / 100).alias("elapsed_ms"),
        F.explode(
            F.array(
                F.struct(F.lit("discount").alias("detector"), (F.col("l_discount") * 10).alias("score")),
                F.struct(F.lit("tax").alias("detector"), (F.col("l_tax") * 12.5).alias("score")),
                F.struct(F.lit("quantity").alias("detector"), (F.col("l_quantity") / 50).alias("score")),
            )
        ).alias("d"),
    )
    return base.select("entry_path", "label", "source", "generator", "split", "level", F.col("d.detector").alias("detector"), F.col("d.score").alias("score"), "elapsed_ms")


SCORE_SQL = """score_records AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber) AS entry_path, CASE WHEN l_returnflag = 'R' THEN 'fake' ELSE 'real' END AS label,
    'src' || (l_suppkey % 20) AS source, CASE WHEN l_returnflag = 'R' THEN 'gen' || (l_partkey % 7) END AS generator,
    CASE WHEN l_orderkey % 5 = 0 THEN 'val' ELSE 'test' END AS split, CASE WHEN l_linestatus = 'O' THEN 'clean' ELSE 'jpeg_q75' END AS level,
    d.detector AS detector, d.score AS score, CASE WHEN l_linenumber % 3 <> 0 THEN l_extendedprice / 100 END AS elapsed_ms,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y
  FROM lineitem, LATERAL (SELECT unnest([{'detector': 'discount', 'score': l_discount * 10}, {'detector': 'tax', 'score': l_tax * 12.5}, {'detector': 'quantity', 'score': l_quantity / 50}]) AS d))"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dataset relation: every document is an entry; quality 1 is real, the rest of the labelled ones fake, others have no label."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    j = d.join(labels, "doc_id", "left")
    label = F.when(F.col("quality") == 1, "real").when(F.col("quality") == 0, "fake")
    return j.select(
        F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit(".jpg")).alias("path"),
        label.alias("label"),
        "source",
        F.when(label == "fake", F.concat(F.lit("g"), F.col("doc_id") % 3)).alias("generator"),
        F.when(F.col("doc_id") % 10 == 0, "test").when(F.col("doc_id") % 10 == 1, "val").when(F.col("doc_id") % 10 < 8, "train").alias("split"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("masks/"), F.col("doc_id"), F.lit(".png"))).alias("mask_path"),
        F.sha2("text", 256).alias("sha256"),
        F.col("n_chars").cast("int").alias("width"),
        (F.col("n_chars") * (F.col("doc_id") % 5 + 1) / 3).cast("int").alias("height"),
        F.upper("lang").alias("format"),
        F.when(F.col("lang") != "es", (F.col("doc_id") % 100 + 1).cast("int")).alias("jpeg_quality"),
        F.map_filter(F.create_map(F.lit("lang"), F.col("lang"), F.lit("mask_type"), F.when(F.col("doc_id") % 4 == 0, F.when(F.col("doc_id") % 8 == 0, "bbox").otherwise("segm"))), lambda _, v: v.isNotNull()).alias("extra"),
        "toxic",
    )


ENTRIES_SQL = """entries AS (
  SELECT source || '/' || lang || '/' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || '.jpg' AS path,
    CASE quality WHEN 1 THEN 'real' WHEN 0 THEN 'fake' END AS label, source, CASE WHEN quality = 0 THEN 'g' || (doc_id % 3) END AS generator,
    CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'val' WHEN doc_id % 10 < 8 THEN 'train' END AS split,
    CASE WHEN doc_id % 4 = 0 THEN 'masks/' || doc_id || '.png' END AS mask_path, sha256(text) AS sha256, CAST(n_chars AS INTEGER) AS width,
    CAST(trunc(n_chars * (doc_id % 5 + 1) / 3) AS INTEGER) AS height, upper(lang) AS format,
    CASE WHEN lang <> 'es' THEN CAST(doc_id % 100 + 1 AS INTEGER) END AS jpeg_quality, lang,
    CASE WHEN doc_id % 8 = 0 THEN 'bbox' WHEN doc_id % 4 = 0 THEN 'segm' END AS mask_type, toxic
  FROM documents LEFT JOIN labels USING (doc_id))"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of images: every order is an image, its line items are pixels with a mask bit and a probability; dealt by image, which is what their plans group and order by."""
    t = table(spark, sf_dir, "lineitem")
    return t.repartition(parts(t), "l_orderkey").select(
        F.col("l_orderkey").alias("image"),
        F.row_number().over(_line_order()).alias("pixel"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        F.when(F.col("l_orderkey") % 3 == 0, "map_a").otherwise("map_b").alias("detector"),
        F.when(F.col("l_orderkey") % 2 == 0, "clean").otherwise("jpeg_q75").alias("level"),
    )


def _line_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


PIXELS_SQL = """pixels AS (
  SELECT l_orderkey AS image, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS INTEGER) AS pixel,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, l_discount * 10 AS p, CASE WHEN l_orderkey % 3 = 0 THEN 'map_a' ELSE 'map_b' END AS detector,
    CASE WHEN l_orderkey % 2 = 0 THEN 'clean' ELSE 'jpeg_q75' END AS level
  FROM lineitem)"""
