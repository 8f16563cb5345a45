"""What keeps the queries' cost in proportion to their input: plans that don't grow worse, with the same results."""

import numpy as np
from pyspark.sql import functions as F

from evispark.kernels import signals
from evispark.operators import fusion, rendering, reports, suite, tools
from evispark.operators import metadata as rules
from evispark.operators import metrics as M
from evispark.plans import catalogue
from evispark.sources import adapters as A

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_exact_quality_is_looked_up(spark):
    """no table is computed for each row and quality; missing and odd tables still fit none."""
    tables = [([2] * 64, [2] * 64), ([None] + [255] * 63, [255] * 64), ([255] * 64, [255] * 64), ([1] * 64, [1] * 64), ([1] * 64, [1] * 63)]
    df = spark.createDataFrame(tables, "luma_table array<int>, chroma_table array<int>").select(rules.quality_columns()["jpeg_quality_exact"].alias("q"), F.monotonically_increasing_id().alias("i"))
    assert "lambda" not in plan(df.select("q"))
    assert [r.q for r in df.orderBy("i").collect()] == [None, None, 1, 100, None]


def shuffles(df):
    return plan(df).count("Exchange hashpartitioning") + plan(df).count("Exchange rangepartitioning")


def test_parts_grow_with_the_table(spark, tmp_path):
    spark.range(100_000).write.parquet(str(tmp_path / "t.parquet"))
    t = A.table(spark, str(tmp_path), "t")
    size = sum(f.stat().st_size for f in (tmp_path / "t.parquet").glob("*.parquet"))
    assert A.parts(t, 1 << 14) == -(-size // (1 << 14)) and A.parts(t) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_shifts_are_found_after_one_shuffle(spark):
    """blocks are dealt by image once, in a number of tasks that follows the input."""
    assert shuffles(catalogue.queries()["dominant_shift"](spark, DATA)) == 1


def test_payload_needs_one_shuffle(spark):
    """the features carry the scores, so records aren't grouped twice and joined; a missing detector is told as such."""
    got = catalogue.queries()["fusion_payload"](spark, DATA)
    assert shuffles(got) == 1 and "Join" not in plan(got)
    r = [("a", "clean", "fake", d, s) for d, s in (("x", 0.9), ("x", 0.7), ("y", None))] + [("b", "clean", "real", "y", 0.5)]
    records = spark.createDataFrame(r, "entry_path string, level string, label string, detector string, score double")
    model = fusion.Fuser(["x", "y"], [1.0, 0.1, 2.0, 0.2])
    own = rendering.fusion_payload(fusion.features(records, model.detectors, scores=True), model)
    whole = records.where("score is not null")
    joined = rendering.fusion_payload(fusion.features(whole, model.detectors), model, whole)
    assert {tuple(x) for x in own.collect()} == {tuple(x) for x in joined.collect()}


def test_ranks_need_one_shuffle(spark):
    """F8: pixels are dealt by image in a number of tasks that follows the input."""
    got = catalogue.queries()["percentile_ranks"](spark, DATA)
    assert shuffles(got) == 1 and "REPARTITION_BY_NUM" in plan(got)


def test_metrics_come_from_counts(spark):
    """records are counted by score and label before anything is joined, thresholds go to all tasks, and counts give what records give."""
    rows = [("d", "clean", "val", "g", "s", ("real", "fake")[i % 3 == 0], i % 7 / 7, 1.0) for i in range(60)] + [("e", "clean", "test", "g", "s", "fake", 0.4, None)] * 3
    df = spark.createDataFrame(rows, "detector string, level string, split string, generator string, source string, label string, score double, elapsed_ms double")
    counts = M.counted(df, ["detector", "level", "split", "generator", "source"])
    for f in (lambda x: reports.per_group_table(x, "source"), reports.tuned_thresholds):
        assert sorted(map(repr, f(counts).collect())) == sorted(map(repr, f(df).collect()))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan(M.image_metrics(df, ["detector"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_jpeg_levels_share_their_transforms():
    """levels from transforms made once are the levels made one by one."""
    rgb = np.random.default_rng(0).integers(0, 256, (37, 50, 3), dtype=np.uint8)
    coded = signals.planes(rgb)
    for level in suite.DEFAULT_SUITE:
        one, own = tools.perturb(rgb, level, lambda: coded), tools.perturb(rgb, level)
        assert own is None and one is None or (one == own).all()
