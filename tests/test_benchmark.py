"""A benchmark from files to reports, and the commands over the library."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark import __main__ as cli
from evispark.kernels import codecs, localize, pixels
from evispark.operators import benchmark, features, fusion, reports, suite, tools
from evispark.sources import scan


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    rng = np.random.default_rng(2)
    for i in range(8):
        label = "fake" if i % 2 else "real"
        (root / label).mkdir(parents=True, exist_ok=True)
        (root / label / f"{i}.png").write_bytes(pixels.png_rgb(rng.integers(0, 255, (32, 40, 3))))
    mask = np.zeros((32, 40, 3), np.uint8)
    mask[:16] = 255
    (root / "masks").mkdir()
    (root / "masks" / "1.png").write_bytes(pixels.png_rgb(mask))
    return root


def entry(path, label, mask=None):
    return (path, label, "s", "g" if label == "fake" else None, "val", mask, path, 40, 32, "PNG", None, {})


def test_run(spark, tree):
    rows = [entry(f"{'fake' if i % 2 else 'real'}/{i}.png", "fake" if i % 2 else "real", "masks/1.png" if i == 1 else None) for i in range(8)]
    e = spark.createDataFrame([*rows, entry("real/none.png", "real")], scan.ENTRY)
    half = np.zeros((32, 40), np.float32)
    half[:16], half[16:] = 0.9, 0.2
    tools.register(tools.Tool("half", "localizer", lambda rgb: {"score": 0.9, "map": half}))
    try:
        levels = suite.DEFAULT_SUITE[:2] + suite.DEFAULT_SUITE[7:8]
        done = benchmark.run(spark, e, str(tree), ["random", "half", "metadata"], levels)
        assert [r.path for r in done.missing.collect()] == ["real/none.png"]
        assert done.records.count() == 8 * 3 * 3 and done.records.columns == scan.SCORE.names
        got = done.pixels.collect()
        assert {(r.entry_path, r.detector, r.level) for r in got} == {("fake/1.png", "half", "clean"), ("fake/1.png", "half", "jpeg_q95")}
        assert got[0].metrics.asDict() == {"f1_at_threshold": 1.0, "best_f1": 1.0, "ap": 1.0, "iou": 1.0, "threshold": 0.5}
        few = benchmark.run(spark, e, str(tree), ["random"], levels[:1], limit=3)
        assert few.records.count() + few.missing.count() == 3
    finally:
        del tools._TOOLS["half"]


def test_pixel_metrics_equal_the_relational_ones(spark):
    rng = np.random.default_rng(5)
    cases = [(np.round(rng.random((4, 6)), 2), rng.random((4, 6)) < 0.4) for _ in range(12)] + [(np.zeros((2, 2)), np.zeros((2, 2), bool)), (np.ones((2, 2)), np.ones((2, 2), bool)), (np.full((2, 3), 0.5), np.arange(6).reshape(2, 3) < 2)]
    rows = [(i, "d", "clean", int(y), float(p)) for i, (h, m) in enumerate(cases) for p, y in zip(h.ravel(), m.ravel(), strict=True)]
    got = {r.image: r for r in reports.pixel_bundle(spark.createDataFrame(rows, "image int, detector string, level string, y int, p double")).collect()}
    for i, (h, m) in enumerate(cases):
        own = benchmark.pixel_metrics(h, m)
        for name in ("f1_at_threshold", "best_f1", "ap", "iou"):
            assert own[name] == pytest.approx(got[i][name], abs=1e-8), (i, name)


def test_commands(spark, tree, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda: spark)
    out = lambda x: str(tmp_path / x)

    def said(*args):
        capsys.readouterr()
        cli.main(args)
        return capsys.readouterr().out

    said("prepare", "set", str(tree), "--out", out("all"))
    assert scan.read_entries(spark, out("all")).count() == 8
    assert '{"axis": "label", "n": 4, "value": "fake"}' in said("summary", out("all"))
    said("filter", out("all"), "--out", out("fakes"), "--label", "fake", "--dedupe")
    said("sample", out("all"), "--out", out("some"), "-n", "4")
    said("merge", f"{out('fakes')}=/a", f"{out('some')}=/b", "--out", out("both"))
    assert scan.read_entries(spark, out("both")).where(F.col("path").startswith("/a/")).count() == 4
    said("split", out("all"), "--out", out("split"), "--group", "none", "--val-fraction", "0.5")
    assert {r.split for r in scan.read_entries(spark, out("split")).select("split").collect()} <= {"train", "val"}
    assert "# Bias audit report" in said("audit", out("all"))
    assert '"job": "cropped"' in said("crop", out("all"), str(tree), "--out", out("cut"), "--size", "16", "--mode", "tiles")
    assert len(list((tmp_path / "cut").rglob("*_t03.png"))) == 8
    text = said("benchmark", out("all"), str(tree), "--out", out("run"), "--tools", "random", "constant_real", "--limit", "8")
    assert "## Robustness" in text and "constant_real" in text
    assert "ela" in json.loads(said("analyze", str(tree / "real" / "0.png"), "--tools", "ela", "metadata"))
    assert '"name": "ela"' in said("tools") and '"label": "uncertain"' in said("metadata", str(tree / "real"))


def test_localizer_plumbing():
    rgb = np.random.default_rng(1).integers(0, 255, (50, 70, 3)).astype(np.uint8)
    out = localize.tiled(rgb, lambda t: t[..., 0] / 255, 32, 24)
    assert np.allclose(out["map"], rgb[..., 0] / 255, atol=1e-6)
    assert localize.tiled(rgb[:10, :10], lambda t: t[..., 0] / 255, 32, 24)["map"].shape == (10, 10)
    c = np.arange(-32, 32).reshape(1, 1, 8, 8)
    volume = localize.coefficient_volume(c)
    assert volume.shape == (21, 8, 8) and (volume.sum(0) == 1).all() and volume[0].sum() == 1 and volume[20].sum() == 13 + 12 and volume[3].sum() == 2
    flat = localize.painted((10, 12), [(0, 0, 8, 8), (2, 4, 8, 8), (0, 0, 0, 3)], [np.ones((2, 2)), np.full((2, 2), 3.0), np.ones((2, 2))], 8)
    assert flat[:8, :4].min() == 1 and flat[5, 6] == 1 and flat[9, 0] == 0 and localize.painted((4, 4), [], [np.ones((1, 1))], 4) is None
    corner = localize.painted((20, 20), [(0, 0, 5, 8)], [np.array([[0.0, 0], [1, 1]])], 8)
    assert corner[4, 0] == 1 and corner[0, 0] > 0  # what lay before the image is cut away
    assert localize.mask_loss(np.ones((4, 4)), np.ones((4, 4))) < 1e-5 < localize.mask_loss(np.zeros((4, 4)), np.ones((4, 4)))
    heat = np.zeros((6, 6))
    heat[1:5, 1:5] = 1
    seen = localize.overlay(np.full((6, 6, 3), 100, np.uint8), heat)
    assert (seen[0, 0] == 100).all() and (seen[1, 1] == 255).all() and tuple(seen[2, 2]) == (193, 40, 40) and tuple(localize.coloured(np.array([0.0, 1.0]))[1]) == (255, 0, 0)
    with pytest.raises(ValueError):
        localize.overlay(np.zeros((2, 2, 3)), np.zeros((3, 3)))


def test_image_report(tmp_path):
    rgb = np.random.default_rng(3).integers(0, 255, (48, 64, 3)).astype(np.uint8)
    model = fusion.Fuser(["ela", "other"], [1.0, 0.5, -1.0, 0.25], 0.1, 2.0, 0.2, 0.4)
    document = benchmark.image_report(pixels.png_rgb(rgb), ["ela", "random", "iml_vit", "metadata"], str(tmp_path / "r"), "a.png", model)
    assert json.loads((tmp_path / "r" / "report.json").read_text())["image"] == document["image"] and "a.png" in (tmp_path / "r" / "report.md").read_text()
    assert codecs.pixels((tmp_path / "r" / "ela_overlay.png").read_bytes()).shape == (48, 64, 3) and not (tmp_path / "r" / "random_heatmap.png").exists()
    s = document["tools"]["ela"]["score"]
    z = 0.1 + (np.log(s / (1 - s)) if s != 0.5 else 0) + 0.5
    assert document["fusion"]["probability"] == pytest.approx(1 / (1 + np.exp(-z / 2))) and [c["present"] for c in sorted(document["fusion"]["contributions"], key=lambda c: c["detector"])] == [True, False]


def test_calibration(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        z = rng.normal()
        y = int(rng.random() < 1 / (1 + np.exp(-z)))
        rows += [(f"{i}", float(4 * z + 2), y)] * 2  # four times too sure, and shifted
    df = spark.createDataFrame(rows, "entry_path string, logit double, y int")
    bias, temperature = features.fit_calibration(df.coalesce(1))
    assert -3 < bias < -1 and 2.5 < temperature < 6
    assert features.fit_calibration(df.where("y = 1")) == (0.0, 1.0)
