"""Preparation of datasets, crops, caches and reports: hand cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.kernels import codecs, pixels
from evispark.operators import crops, features, fusion, rendering, suite, tools
from evispark.sources import datasets, images, paths, scan

LAYOUT_FILE = """
layouts:
  - dataset: "Set (one+two)"
    real_globs: ["real/**"]
    fake_globs: ["fake/*/*"]
    generator_from: "regex"
    generator_regex: "fake/(?P<gen>[a-z]+)/"
    split_from: "top"
    split_map: {"real": "train"}
    mask_rules: [{regex: "fake/(?P<g>[a-z]+)/(?P<n>[0-9]+)", template: "masks/{g}_{n}.png"}]
    extra_regex: "/(?P<n>[0-9]+)\\\\."
"""


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "set (one+two)"
    rng = np.random.default_rng(1)
    for i, name in enumerate(("real/a/1.png", "real/2.PNG", "fake/gan/3.png", "fake/gan/4.png", "fake/GAN/5.png", "masks/gan_3.png")):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(pixels.png_rgb(rng.integers(0, 255, (20 + i, 30, 3))))
    (root / "fake/gan/6.jpg").write_bytes(b"broken")
    (root / "notes.txt").write_text("x")
    (root / datasets.SIDECAR).write_text('{"path": "fake/gan/4.png", "model_name": "side", "split": "test"}\n{"path": "real/2.PNG", "model_name": "no", "split": "other"}\nbroken\n{"model_name": "x"}\n{"path": "fake/GAN/5.png", "model_name": ""}\n')
    return root


def test_prepare(spark, tree, tmp_path):
    (tmp_path / "layouts.yaml").write_text(LAYOUT_FILE)
    known = datasets.read_layouts(str(tmp_path / "layouts.yaml"))
    registry = datasets.registry_rows(spark, [{"name": "Set (one+two)", "license": "L", "commercial_ok": False, "approx_size_gb": 3}])
    out = datasets.prepare(spark, "Set (one+two)", str(tree), str(tmp_path / "out"), known, registry)
    got = {r.path: r for r in out.entries.collect()}
    assert set(got) == {"real/a/1.png", "real/2.PNG", "fake/gan/3.png", "fake/gan/4.png", "fake/GAN/5.png"}
    facts = {k: (r.label, r.generator, r.split, r.mask_path) for k, r in got.items()}
    assert facts["fake/gan/3.png"] == ("fake", "gan", None, "masks/gan_3.png") and facts["fake/gan/4.png"] == ("fake", "side", "test", None)
    assert facts["real/2.PNG"] == ("real", None, "train", None) and facts["fake/GAN/5.png"] == ("fake", None, None, None) and got["fake/gan/3.png"].extra == {"n": "3"}
    assert [r.path for r in out.skipped.collect()] == ["fake/gan/6.jpg"] and (out.license, out.commercial_ok) == ("L", False)
    assert tuple(out.masks.first()) == (3, 1, 1, 1)
    assert sorted(r.path for r in scan.read_entries(spark, str(tmp_path / "out")).collect()) == sorted(got)
    with pytest.raises(KeyError, match="one"):
        datasets.named(known, "Set")
    fallback = datasets.prepare(spark, "other", str(tree))
    assert fallback.entries.where("label = 'real'").count() == 1 and fallback.license is None  # the folder 'a' names no label
    with pytest.raises(ValueError, match="Set"):
        datasets.prepare(spark, "Set (one+two)", str(tree / "fake" / "gan"), layouts={"Set (one+two)": paths.Layout(fake=["**"])}, strict=True)
    with pytest.raises(ValueError):
        datasets.layout_of({"dataset": "x", "generator_from": "regex"})
    with pytest.raises(ValueError):
        datasets.layout_of({"dataset": "x", "split_from": "somewhere"})


def test_materialised_shards(spark, tmp_path):
    png = pixels.png_rgb(np.zeros((6, 8, 3)))
    rows = [(f"i{i}.png", "PNG", bytearray(png), "fake" if i % 2 else "real", "gan" if i % 2 else None, i == 3, "p" * 300, "train") for i in range(6)]
    spark.createDataFrame(rows, "image_name string, format string, image_data binary, label string, model_name string, nsfw_flag boolean, prompt string, split string").write.parquet(str(tmp_path / "s"))
    out = str(tmp_path / "tree")
    counts = lambda **k: {(r.outcome, r.label): r.n for r in datasets.materialise_shards(spark, str(tmp_path / "s"), out, **k).collect()}
    assert counts(max_rows=2) == {("written", "real"): 1, ("written", "fake"): 1}
    assert counts() == {("exists", "real"): 1, ("exists", "fake"): 1, ("written", "real"): 2, ("written", "fake"): 1, ("nsfw", "fake"): 1}
    side = [json.loads(x) for x in (tmp_path / "tree" / datasets.SIDECAR).read_text().splitlines()]
    assert len(side) == 5 and {len(x["prompt"]) for x in side} == {200}
    prepared = datasets.prepare(spark, "x", out, layouts={"x": paths.Layout(real=["real/**"], fake=["fake/**"], split="top")})
    assert {(r.label, r.generator, r.split) for r in prepared.entries.collect()} == {("real", None, "train"), ("fake", "gan", "train")}


def test_crop_boxes(spark):
    sizes = spark.createDataFrame([("big", 500, 700, "aa"), ("small", 100, 90, "bb"), ("exact", 224, 224, "cc")], "path string, height int, width int, pixel_sha256 string")
    boxes = lambda **k: {(r.path, r.crop): (r.top, r.left, r.box_height, r.box_width) for r in crops.crop_boxes(sizes, crops.CropPolicy(**k)).collect()}
    assert boxes(mode="center") == {("big", 0): (138, 238, 224, 224), ("small", 0): (0, 0, 100, 90), ("exact", 0): (0, 0, 224, 224)}
    grid = boxes()
    assert [grid["big", i] for i in range(4)] == [(224, 224, 224, 224), (0, 224, 224, 224), (224, 448, 224, 224), (0, 448, 224, 224)]
    random = boxes(mode="random", seed=3)
    assert len(random) == 12 and random == boxes(mode="random", seed=3) != boxes(mode="random", seed=4) and all(0 <= t <= 276 and 0 <= x <= 476 for (p, _), (t, x, *_) in random.items() if p == "big")
    with pytest.raises(Exception, match="smaller than a crop"):
        crops.crop_boxes(sizes, crops.CropPolicy(min_side_pad=False)).collect()
    assert crops.CropPolicy().fingerprint() != crops.CropPolicy(seed=1).fingerprint() and len(crops.CropPolicy().fingerprint()) == 12
    nearest = pixels.grid_crops((500, 700), 224, 4)
    assert [grid["big", i][:2] for i in range(4)] == nearest


def test_windows_and_sampling():
    assert crops.window(100, 224, 2000) == (0, 448) and crops.window(500, 224, 2000) == (384, 448) and crops.window(1776, 224, 2000) == (1552, 448) and crops.window(0, 224, 300) == (0, 300)
    rng = np.random.default_rng(0)
    seen = {crops.sample_crop_box(512, 512, 448, rng) for _ in range(400)}
    assert {y for y, _ in seen} == {0, 16, 32, 48, 64}
    for _ in range(200):
        y, x = crops.sample_crop_box(600, 700, 448, rng, contains=(599, 3))
        assert y <= 599 < y + 448 and x <= 3 < x + 448
    assert crops.sample_crop_box(100, 460, 448, rng, contains=(5, 459)) == (0, 12)
    batch = crops.to_array([np.full((4, 4, 3), 255, np.uint8)] * 2)
    assert batch.shape == (2, 3, 4, 4) and batch[0, 0, 0, 0] == pytest.approx((1 - 0.485) / 0.229)


def test_mirrored_padding():
    a = np.arange(3).reshape(1, 3, 1)
    assert pixels.mirrored(a, 9)[0, :, 0].tolist() == [1, 2, 1, 0, 1, 2, 1, 0, 1]
    assert pixels.mirrored(np.zeros((1, 1, 3)), 4).shape == (4, 4, 3) and pixels.center_crop(np.ones((3, 9, 3)), 5).shape == (5, 5, 3)


def test_cut_images(spark):
    rgb = np.random.default_rng(2).integers(0, 255, (9, 13, 3)).astype(np.uint8)
    file = pixels.png_rgb(rgb)
    entry = lambda path, label, h, w: (path, label, "s", None, "train", "m.png", "00", w, h, "PNG", None, {"k": "v"})
    e = spark.createDataFrame([entry("r/a.png", "real", 9, 13), entry("r/b.png", "real", 3, 13), entry("f/c.png", "fake", 9, 13)], scan.ENTRY)
    targets = crops.target_rows(e, 4, "tiles", ["real"])
    assert {(r.job, r.entries, r["rows"]) for r in crops.crop_report(targets).collect()} == {("cropped", 1, 6), ("passthrough", 1, 1), ("copied", 1, 1)}
    opened = images.open_images(spark.createDataFrame([("r/a.png", file), ("r/b.png", pixels.png_rgb(rgb[:3])), ("f/c.png", file)], "path string, content binary"))
    files = {r.path: bytes(r.content) for r in crops.cut_images(opened, targets, 4).collect()}
    assert len(files) == 8 and files["f/c.png"] == file
    assert (codecs.pixels(files["r/a_t04.png"]) == rgb[4:8, 4:8]).all() and (codecs.pixels(files["r/a_t05.png"]) == rgb[4:8, 8:12]).all()
    row = targets.where("path = 'r/a_t05.png'").first()
    assert row.mask_path is None and row.extra == {"k": "v", "source_path": "r/a.png", "original_width": "13", "original_height": "9", "crop_mode": "tiles", "crop_size": "4", "tile_index": "5"}
    with pytest.raises(ValueError):
        crops.target_rows(e, 0, "tiles")


def test_augmentation():
    rgb = np.random.default_rng(3).integers(0, 255, (40, 48, 3)).astype(np.uint8)
    config = crops.Augmentation(jpeg_quality=(60, 60), gaussian_blur_sigma=(1, 1), downscale_upscale=(0.5, 0.5), noise_sigma=(3, 3), webp_quality=(70, 80), cutout={"size": 8, "count": 2}, p=1.0)
    a, b = (crops.augment(rgb, config, np.random.default_rng(5)) for _ in range(2))
    assert (a == b).all() and a.shape == rgb.shape and (a == 0).all(-1).sum() > 20
    assert (crops.augment(rgb, crops.Augmentation(noise_sigma=(3, 3), probabilities={"noise_sigma": 0.0}), np.random.default_rng(1)) == rgb).all()
    rng = np.random.default_rng(9)
    crops.augment(rgb, crops.Augmentation(noise_sigma=(3, 3), cutout={}, p=0.0), rng)
    other = np.random.default_rng(9)
    other.random(2)  # a draw for each kind that is set
    assert rng.random() == other.random() and config.fingerprint() != crops.Augmentation().fingerprint()
    assert crops.blurred(np.full((9, 9, 3), 7, np.uint8), 2.0).min() == 7


def test_feature_cache(spark, tmp_path):
    imgs = spark.createDataFrame([(f"i{i}", f"{i:02x}" * 32) for i in range(6)], "path string, image_sha256 string")
    wanted = features.keyed(imgs, "net", crops.CropPolicy(), crops.Augmentation(p=0.3), views=2)
    path = str(tmp_path / "cache")
    features.put(wanted.where("view = 0 and path < 'i3'").select(*features.KEY, F.array(F.lit(1.0).cast("float"), F.lit(2.0).cast("float")).alias("features")), path)
    features.put(wanted.where("view = 1 and path = 'i5'").select(*features.KEY, F.array(F.lit(3.0).cast("float")).alias("features")), path)
    cache = features.stored(spark, path)
    hits, misses = features.looked_up(wanted, cache)
    assert {(r.path, r.view) for r in hits.collect()} == {("i0", 0), ("i1", 0), ("i2", 0), ("i5", 1)} and misses.count() == 8
    assert features.looked_up(features.keyed(imgs, "net", crops.CropPolicy(seed=9), crops.Augmentation(p=0.3)), cache)[0].count() == 0
    assert tuple(features.stats(cache).first()) == ("net", 4, 28)


def test_batches_across_images(spark):
    rows = [(f"h{i}", c, bytearray([i * 10 + c] * 12)) for i in range(5) for c in range(2)]
    df = spark.createDataFrame(rows, "image_sha256 string, crop int, rgb binary").coalesce(1)

    def load():
        return lambda x: np.stack([x.reshape(len(x), -1).mean(1), np.full(len(x), len(x))], 1)

    got = {(r.image_sha256, r.crop): r.features for r in features.in_batches(df, load, 2, 4).collect()}
    assert got["h3", 1][0] == 31 and sorted(v[1] for v in got.values()) == [2, 2] + [4] * 8


def test_head_equals_plain_sums():
    import math

    rng = np.random.default_rng(4)
    n, layers, v, h, m = 3, 2, 5, 4, 6
    w = {"norm_scale": rng.normal(size=(layers, v)), "norm_shift": rng.normal(size=(layers, v)), "project": rng.normal(size=(layers, h, v)), "project_bias": rng.normal(size=(layers, h)), "mix": rng.normal(size=layers), "hidden": rng.normal(size=(m, h)), "hidden_bias": rng.normal(size=m), "out": rng.normal(size=m), "out_bias": 0.3}
    x = rng.normal(size=(n, layers, v))
    share = [math.exp(z) for z in w["mix"]]
    for i, got in enumerate(features.head_logits(x, w)):
        mixed = [0.0] * h
        for k in range(layers):
            mu, sd = x[i, k].mean(), math.sqrt(x[i, k].var() + 1e-5)
            z = [(a - mu) / sd * s + t for a, s, t in zip(x[i, k], w["norm_scale"][k], w["norm_shift"][k], strict=True)]
            for j in range(h):
                mixed[j] += share[k] / sum(share) * (sum(a * b for a, b in zip(w["project"][k, j], z, strict=True)) + w["project_bias"][k, j])
        hidden = [sum(a * b for a, b in zip(row, mixed, strict=True)) + b0 for row, b0 in zip(w["hidden"], w["hidden_bias"], strict=True)]
        assert got == pytest.approx(sum(o * 0.5 * z * (1 + math.erf(z / math.sqrt(2))) for o, z in zip(w["out"], hidden, strict=True)) + 0.3)


def test_reports(spark, tmp_path):
    rows = [(f"{i}", "fake" if i % 2 else "real", "s", "g" if i % 2 else None, "val", level, d, (i + (d == "a")) % 5 / 4, 1.0 + i) for i in range(12) for level in ("clean", "jpeg_q95") for d in ("a", "b")]
    rows.append(("x", "real", "s", None, "val", "clean", "lonely", 0.5, None))
    records = spark.createDataFrame(rows, "entry_path string, label string, source string, generator string, split string, level string, detector string, score double, elapsed_ms double")
    text = rendering.benchmark_markdown("set", records, missing=2, caveat="few rows")
    lines = text.split("\n")
    assert lines[0] == "# Benchmark report: set" and "- Entries evaluated: 13" in lines and "- Robustness levels: clean, jpeg_q95" in lines and "- Missing files: 2" in lines
    heads = [x for x in lines if x.startswith("## ")]
    assert heads == ["## Image metrics (clean)", "## Robustness (AUC and balanced accuracy at the fixed threshold)", "## AUC by generator (clean)", "## AUC by source (clean)", "## Timing"]
    assert "| lonely | - | one label only |  |  |  |  |  |  |  |" in lines and "| lonely | 0 | - |" in lines
    rendering.save_result(records, None, str(tmp_path / "r"), {"levels": ["clean"], "p": np.float32(0.5), "bad": float("nan")})
    assert json.loads(spark.read.text(str(tmp_path / "r" / "meta")).first()[0]) == {"bad": None, "levels": ["clean"], "p": 0.5}
    assert spark.read.parquet(str(tmp_path / "r" / "records")).count() == len(rows)
    model = fusion.Fuser(["a", "b"], [1.0, 0.0, -2.0, 0.0], 0.0, 1.0, 0.4, 0.6)
    own = records.where("detector <> 'lonely'")
    md = rendering.fusion_markdown(fusion.evaluate(own, model))
    assert md.index("Level: clean") < md.index("Level: jpeg_q95") and md.index("| b |") < md.index("| fused |") < md.index("| fused_outside_band |")
    payload = json.loads(rendering.fusion_payload(fusion.features(own.where("entry_path = '1' and not (detector = 'b' and level = 'clean')"), ["a", "b"]), model, own.where("not (detector = 'b' and level = 'clean')")).where("level = 'clean'").first().payload)
    assert [c["detector"] for c in payload["contributions"]] == ["a", "b"] or payload["contributions"][0]["contribution"] == 0
    assert {c["detector"]: c["present"] for c in payload["contributions"]} == {"a": True, "b": False} and payload["band"] == {"low": 0.4, "high": 0.6}
    e = spark.createDataFrame([(f"{i}", "real" if i < 30 else "fake", "JPEG" if i < 30 else "PNG", "s", str(i), 800, 600, 90) for i in range(40)], "path string, label string, format string, source string, sha256 string, width int, height int, jpeg_quality int")
    audit = rendering.audit_markdown(e)
    assert "problem(s) found" in audit and "| JPEG | 0 | 30 |" in audit and "| PNG | 10 | 0 |" in audit
    assert rendering.jsonable({1: {2.5, 1.5}, "b": b"x\xff", "n": np.int64(3), "i": float("inf")}) == {"1": [1.5, 2.5], "b": "x�", "n": 3, "i": None}


def test_catalogue_and_suites(spark, tmp_path):
    rows = tools.catalogue(spark).collect()
    assert [(r.category, r.name) for r in rows] == sorted((r.category, r.name) for r in rows)
    by = {r.name: r for r in rows}
    assert not by["iml_vit"].installed and not by["localizer_ensemble"].installed and by["ela"].installed and json.loads(by["ela"].parameters)[0]["high"] == 100
    got = {r.tool: r.title for r in tools.enriched(spark.createDataFrame([("ela",), ("new_tool",)], "tool string")).collect()}
    assert got == {"ela": "Error level analysis", "new_tool": "new_tool"}
    (tmp_path / "s.yaml").write_text("version: 1\nlevels:\n  - {name: clean, kind: clean, params: {}}\n  - {name: j, kind: jpeg, params: {quality: 50}}\n")
    assert suite.read_suite(str(tmp_path / "s.yaml")) == (suite.Level("clean", "clean"), suite.Level("j", "jpeg", {"quality": 50}))
    assert len(suite.LOCALIZATION_SUITE) == 9
    with pytest.raises(ValueError):
        suite.suite_of([{"name": "a", "kind": "blur"}])
    with pytest.raises(ValueError):
        suite.suite_of([{"name": "a", "kind": "clean"}] * 2)


def test_pyramid_tiles(spark):
    a = np.linspace(0, 1, 24 * 16, dtype=np.float32).reshape(16, 24)
    df = spark.createDataFrame([("m", 16, 24, bytearray(a.tobytes()))], "entry_path string, height int, width int, values binary")
    got = {(r.level, r.row, r.column): codecs.read_png(bytes(r.png)) for r in tools.pyramid_tiles(df, 8).collect()}
    assert {k[0] for k in got} == {0, 1, 2} and len([k for k in got if k[0] == 0]) == 6 and all(v.shape == (8, 8, 3) for v in got.values())
    assert (got[0, 1, 2][..., 0] == (a[8:, 16:] * 255).astype(np.uint8)).all() and got[1, 0, 1][0, 5, 0] == 0


def test_fit_fuser(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        y = i % 2
        for d, s in (("good", 0.1 + 0.8 * y + rng.normal(0, 0.15)), ("turned", 0.9 - 0.8 * y + rng.normal(0, 0.2)), ("silent", 0.5)):
            rows.append((f"p{i}", "fake" if y else "real", "s", None, "val", "clean", d, float(np.clip(s, 0.01, 0.99)), None))
    records = spark.createDataFrame(rows, scan.SCORE)
    model = fusion.fit_fuser(records, ["good", "turned", "silent"], steps=12)
    w = dict(zip(model.detectors, model.weights[::2], strict=True))
    assert w["good"] > 0.05 and w["turned"] < -0.05 and abs(w["silent"]) < 1e-9
    assert 0 <= model.low <= model.high <= 1 and model.provenance["target_met"] and fusion.Fuser.loads(model.dumps()) == model
    got = {(r.scorer): r for r in fusion.evaluate(records, model).collect()}
    assert got["fused"].auc > 0.97 and got["fused"].n == 300
    with pytest.raises(ValueError, match="both labels"):
        fusion.fit_fuser(records.where("label = 'fake'"), ["good"])


def test_sql_functions_equal_the_columns(spark):
    from evispark.functions import sql
    from evispark.operators import audit, entries, evidence

    assert "evi_tiles" in sql.register(spark)
    rows = [(s, w, h, q, f, f"p{i}") for i, (s, w, h, q, f) in enumerate([(0.1, 300, 900, 5, "JPEG"), (0.5, 2048, 2050, None, " png "), (0.99999, 700, 0, 100, ""), (None, 1000, 700, 41, None), (0.35, 90, 200, 200, "Heic"), (0.65, 1330, 1000, 10, "tiff")])]
    df = spark.createDataFrame(rows, "score double, width int, height int, jpeg_quality int, format string, entry_path string")
    df.createOrReplaceTempView("files")
    got = spark.sql("SELECT entry_path, evi_label(score) a, evi_logit(score) b, evi_group(format) c, evi_resolution(width, height) d, evi_quality(jpeg_quality) e, evi_aspect(width, height) f, evi_held_out(entry_path, 3) g, evi_extension(format) h FROM files")
    own = df.select(
        "entry_path", evidence.label_from_score(F.col("score")), fusion.logit(F.col("score")), entries.known("format"), audit.resolution_bucket(), audit.quality_bucket(), audit.aspect_bucket(), fusion.held_out(3), paths.extension(F.col("format")),
    )
    assert [tuple(r) for r in got.orderBy("entry_path").collect()] == [tuple(r) for r in own.orderBy("entry_path").collect()]
    tiles = spark.sql("SELECT entry_path, tile, top, left FROM files, LATERAL evi_tiles(height, width, 300) WHERE entry_path = 'p3'").collect()
    assert [(r.tile, r.top, r.left) for r in tiles] == [(0, 0, 0), (1, 0, 300), (2, 0, 600), (3, 300, 0), (4, 300, 300), (5, 300, 600)]
