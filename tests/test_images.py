"""Encoded images: codecs against the JVM's, metadata from bytes built by hand, tools that must not end a job."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.kernels import codecs, metadata, pixels, signals
from evispark.operators import metadata as rules
from evispark.operators import tools
from evispark.operators.suite import DEFAULT_SUITE
from evispark.sources import images


def picture(seed, h=96, w=120):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    a = 128 + 50 * np.sin(x / 9.0)[..., None] * np.cos(y / 7.0)[..., None] + np.array([20.0, -10, 5]) * np.sin((x + y) / 23.0)[..., None] + rng.normal(0, 6, (h, w, 3))
    a[h // 4 : h // 2, w // 4 : w // 2] += rng.normal(0, 40, 3)
    return np.clip(a, 0, 255).astype(np.uint8)


@pytest.fixture(scope="module")
def jpeg_file(spark):
    """An encoder of the JVM: bytes of a baseline JPEG, and its own reading of them."""
    jvm = spark._jvm
    io = jvm.javax.imageio.ImageIO

    def buffered(rgb):
        return io.read(jvm.java.io.ByteArrayInputStream(filtered_png(rgb, 0)))

    def make(rgb, quality=0.8, kind="jpg"):
        stream = jvm.java.io.ByteArrayOutputStream()
        writer = io.getImageWritersByFormatName(kind).next()
        param = writer.getDefaultWriteParam()
        if kind == "jpg":
            param.setCompressionMode(2)
            param.setCompressionQuality(float(quality))
        target = io.createImageOutputStream(stream)
        writer.setOutput(target)
        writer.write(None, jvm.javax.imageio.IIOImage(buffered(rgb), None, None), param)
        target.flush()
        return bytes(stream.toByteArray())

    def read(data):
        stream = jvm.java.io.ByteArrayOutputStream()
        io.write(io.read(jvm.java.io.ByteArrayInputStream(data)), "png", stream)
        return codecs.read_png(bytes(stream.toByteArray()))

    return make, read


def test_jpegs_read_as_the_jvm_reads_them(jpeg_file):
    make, read = jpeg_file
    for seed, shape, quality in ((1, (40, 56), 0.9), (2, (33, 47), 0.5), (3, (16, 16), 0.95)):
        rgb = picture(seed, *shape)
        data = make(rgb, quality)
        got, other = codecs.pixels(data).astype(int), read(data).astype(int)
        assert got.shape == rgb.shape
        assert np.abs(got - other).mean() < 3 and np.abs(got.mean(-1) - other.mean(-1)).mean() < 2.5  # chroma is spread in another way
        c, table = codecs.luma_coefficients(data)
        assert c.shape == (-(-shape[0] // 8), -(-shape[1] // 8), 8, 8)
        y = codecs.plane(codecs.read_jpeg(data), 0)[: shape[0], : shape[1]]
        assert np.abs(y - pixels.luma(rgb.astype(float))).mean() < 6
        assert metadata.read(data)["luma_table"] == table.ravel().tolist()
    with pytest.raises(codecs.Unreadable):
        codecs.read_jpeg(data[: len(data) // 2])
    progressive = data.replace(b"\xff\xc0\x00\x11", b"\xff\xc2\x00\x11")
    with pytest.raises(codecs.Unreadable, match="sequential"):
        codecs.read_jpeg(progressive)


def test_coefficients_survive_coding_again(jpeg_file):
    make, _ = jpeg_file
    c, table = codecs.luma_coefficients(make(picture(5, 64, 64), 0.7))
    coded, shape = signals.transformed(np.rint(codecs.plane(codecs.read_jpeg(make(picture(5, 64, 64), 0.7)), 0)).astype(np.float32) - 128)
    assert np.abs(np.rint(coded / table.ravel()).reshape(c.shape) - c).max() <= 1
    assert (np.rint(coded / table.ravel()).reshape(c.shape) == c).mean() > 0.99


def filtered_png(rgb, how, interlaced=False):
    h, w = rgb.shape[:2]

    def lines(part):
        rows, out = part.reshape(part.shape[0], -1).astype(int), b""
        for i, row in enumerate(rows):
            up = rows[i - 1] if i else np.zeros_like(row)
            left, corner = np.concatenate([[0] * 3, row[:-3]]), np.concatenate([[0] * 3, up[:-3]])
            p = left + up - corner
            pa, pb, pc = abs(p - left), abs(p - up), abs(p - corner)
            paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, up, corner))
            guess = {0: 0, 1: left, 2: up, 3: (left + up) // 2, 4: paeth}[how]
            out += bytes([how]) + ((row - guess) & 255).astype(np.uint8).tobytes()
        return out

    raw = b"".join(lines(rgb[y::dy, x::dx]) for x, y, dx, dy in codecs.ADAM7 if rgb[y::dy, x::dx].size) if interlaced else lines(rgb)
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    return codecs.PNG_SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, int(interlaced))) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_pngs(jpeg_file):
    make, _ = jpeg_file
    rgb = picture(7, 21, 34)
    for how in range(5):
        assert (codecs.pixels(filtered_png(rgb, how)) == rgb).all()
    assert (codecs.pixels(filtered_png(rgb, 4, True)) == rgb).all()
    assert (codecs.pixels(make(rgb, kind="png")) == rgb).all()
    gray = np.linspace(0, 1, 12).reshape(3, 4)
    assert (codecs.pixels(pixels.png(gray))[..., 1] == (gray * 255).astype(np.uint8)).all()
    broken = bytearray(filtered_png(rgb, 0))
    broken[60] ^= 1
    with pytest.raises(codecs.Unreadable):
        codecs.pixels(bytes(broken))


def test_orientation():
    a = np.arange(6).reshape(2, 3, 1)
    seen = {1: a, 2: a[:, ::-1], 3: np.rot90(a, 2), 4: a[::-1], 5: a.swapaxes(0, 1), 6: np.rot90(a, -1), 7: np.rot90(a, 2).swapaxes(0, 1), 8: np.rot90(a, 1)}
    assert all((codecs.turned(a, k) == v).all() for k, v in seen.items())


def tiff(tags, thumb=b"", photo=()):
    """A little-endian EXIF block of (tag, text or number)."""

    def ifd(entries, at, after):
        head, tail = struct.pack("<H", len(entries)), b""
        place = at + 2 + 12 * len(entries) + 4
        for tag, v in entries:
            if isinstance(v, int):
                head += struct.pack("<HHII", tag, 4, 1, v)
            elif len(v) <= 4:
                head += struct.pack("<HHI", tag, 2, len(v)) + v.ljust(4, b"\0")
            else:
                head += struct.pack("<HHII", tag, 2, len(v), place + len(tail))
                tail += v
        return head + struct.pack("<I", after) + tail

    main = [*tags, *([(metadata.EXIF_PART, 0)] if photo else [])]
    size = len(ifd(main, 8, 0))
    if photo:
        main[-1] = (metadata.EXIF_PART, 8 + size)
    part = ifd(list(photo), 8 + size, 0) if photo else b""
    second = 8 + size + len(part)
    end = second + len(ifd([(metadata.THUMB_AT, 0), (metadata.THUMB_SIZE, 0)], second, 0))
    out = b"II*\0" + struct.pack("<I", 8) + ifd(main, 8, second if thumb else 0) + part
    return out + (ifd([(metadata.THUMB_AT, end), (metadata.THUMB_SIZE, len(thumb))], second, 0) + thumb if thumb else b"")


def with_segments(jpeg, *segments):
    return jpeg[:2] + b"".join(b"\xff" + bytes([m]) + (len(b) + 2).to_bytes(2, "big") + b for m, b in segments) + jpeg[2:]


def caption(number, value, size=None):
    return b"\x1c\x02" + bytes([number]) + (len(value) if size is None else size).to_bytes(2, "big") + value


def resource(number, data):
    return b"8BIM" + number.to_bytes(2, "big") + b"\0\0" + len(data).to_bytes(4, "big") + data + b"\0" * (len(data) & 1)


def test_metadata_rules(spark, jpeg_file):
    make, _ = jpeg_file
    rgb = picture(9, 48, 64)
    plain, other = make(rgb), make(picture(20, 48, 64)[::-1, ::-1])
    small = make(rgb[::4, ::4])
    exif = lambda *tags, **k: (0xE1, b"Exif\0\0" + tiff(tags, **k))
    xmp = lambda text: (0xE1, metadata.XMP_HEAD + text.encode())
    photoshop = lambda *r: (0xED, metadata.RESOURCE_HEAD + b"".join(r))
    chunk = lambda kind, data: len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")
    png = filtered_png(rgb, 1)
    texts = lambda *c: png[:33] + b"".join(c) + png[33:]
    camera = (metadata.MAKE, b"Acme\0\0\0\0"), (metadata.MODEL, b"One\0")
    cases = {
        "plain": (plain, 0.5, {"note": "no metadata evidence", "has_exif": False}),
        "camera": (with_segments(plain, exif(*camera, photo=[(metadata.TAKEN, b"2020:01:01 00:00:00\0"), (metadata.LENS, b"Lens 50mm\0")])), 0.3, {"camera_make": "Acme", "lens_model": "Lens 50mm", "datetime_original": "2020:01:01 00:00:00"}),
        "editor": (with_segments(plain, exif(*camera, (metadata.SOFTWARE, b"Adobe Photoshop 25\0"))), 0.7, {"software": "Adobe Photoshop 25"}),
        "generator": (with_segments(plain, exif((metadata.SOFTWARE, b"Midjourney v6\0"))), 0.95, {}),
        "thumbnail": (with_segments(plain, exif(*camera, thumb=small)), 0.3, {"thumbnail_mismatch": False}),
        "swapped": (with_segments(other, exif(*camera, thumb=small)), 0.85, {"thumbnail_mismatch": True}),
        "damaged thumbnail": (with_segments(plain, exif(*camera, thumb=small[:80])), 0.3, {}),
        "platform": (with_segments(plain, photoshop(resource(1028, caption(40, b"FBMD0123456789abcdef")))), 0.5, {"platform_markers": ["FBMD"], "note": "encoded anew by a platform", "resources": [1028]}),
        "resources": (with_segments(plain, photoshop(resource(1028, b""), resource(1005, b"abc"), resource(1036, b"x"))), 0.7, {"resources": [1005, 1028, 1036]}),
        "program": (with_segments(plain, photoshop(resource(1028, caption(65, b"GIMP") + caption(120, b"c" * 300) + caption(120, b"again") + caption(80, b"x", 0x8001)))), 0.7, {"iptc": {"originating_program": "GIMP", "caption": "c" * 200}}),
        "history": (with_segments(plain, xmp("<xmpMM:History><x stEvt:action='Edited'/>")), 0.7, {}),
        "creator tool": (with_segments(plain, xmp('xmp:CreatorTool="Snapseed 2"')), 0.7, {}),
        "xmp generator": (with_segments(plain, xmp("iptc digitalsourcetype trainedAlgorithmicMedia")), 0.95, {}),
        "parameters": (texts(chunk(b"tEXt", b"parameters\0steps: 20")), 0.95, {}),
        "compressed": (texts(chunk(b"zTXt", b"Comment\0\0" + zlib.compress(b"made with ComfyUI"))), 0.95, {}),
        "international": (texts(chunk(b"iTXt", b"Description\0\1\0en\0\0" + zlib.compress("dall·e 3".encode()))), 0.95, {}),
        "ordinary words": (texts(chunk(b"tEXt", b"Comment\0a firefly of dalles")), 0.95, {}),
        "harmless words": (texts(chunk(b"tEXt", b"Comment\0fireflys of dalles")), 0.5, {}),
        "junk": (b"not an image", 0.5, {"error": "no known image header"}),
        "nothing": (None, 0.5, {"error": "no content"}),
    }
    files = spark.createDataFrame([(k, v[0]) for k, v in cases.items()], "path string, content binary")
    got = {r.path: r for r in rules.judged(images.read_metadata(files)).collect()}
    for k, (_, score, fields) in cases.items():
        assert (k, got[k].score) == (k, score)
        assert {f: got[k][f] for f in fields} == fields, k
        assert got[k].label == ("fake" if score >= 0.7 else "real" if score < 0.5 else "uncertain")
    assert [tuple(m) for m in got["history"].editor_markers] == [("XMP", "history"), ("XMP", "edited")]
    assert got["damaged thumbnail"].error.startswith("thumbnail")


def test_quality_columns(spark):
    rows = [(q, signals.quant_table(signals.LUMINANCE, q).tolist(), signals.quant_table(signals.CHROMINANCE, q).tolist()) for q in (30, 50, 75, 92, 100)]
    rows += [(-1, [3] * 64, [3] * 64), (-2, [3] * 64, None), (-3, None, None)]
    df = spark.createDataFrame(rows, "q int, luma_table array<int>, chroma_table array<int>").withColumns(rules.quality_columns())
    got = {r.q: r for r in df.collect()}
    for q in (30, 50, 75, 92, 100):
        assert got[q].jpeg_quality_exact == q and got[q].jpeg_standard and abs(got[q].jpeg_quality_estimate - q) <= 2
        assert got[q].jpeg_quality_estimate == signals.estimate_quality(np.array(rows[[r[0] for r in rows].index(q)][1]))
    assert (got[-1].jpeg_quality_exact, got[-1].jpeg_standard, got[-2].jpeg_standard, got[-3].jpeg_quality_estimate) == (None, False, None, None)


def test_open_images_and_tools_never_fail(spark, jpeg_file):
    make, _ = jpeg_file
    rgb = picture(11, 64, 64)
    data = make(rgb, 0.9)
    turned = with_segments(data, (0xE1, b"Exif\0\0" + tiff([(metadata.ORIENTATION, 6)])))
    files = spark.createDataFrame([("a.jpg", data), ("b.jpg", turned), ("c.png", filtered_png(rgb[:40], 2)), ("d", b"\xff\xd8junk"), ("e", None)], "path string, content binary")
    opened = images.open_images(files)
    got = {r.entry_path: r for r in opened.collect()}
    assert (got["b.jpg"].height, got["b.jpg"].width, got["c.png"].height) == (64, 64, 40) and got["d"].error and got["e"].error == "no content"
    a, b = (np.frombuffer(got[k].rgb, np.uint8).reshape(64, 64, 3) for k in ("a.jpg", "b.jpg"))
    assert (np.rot90(a, -1) == b).all() and got["a.jpg"].pixel_sha256 != got["b.jpg"].pixel_sha256
    extra = spark.createDataFrame([("f", 0, 0, bytearray(), None), ("g", 2, 2, bytearray(12), None), ("h", 3, 1, bytearray(5), None)], "entry_path string, height int, width int, rgb binary, raw binary")
    both = opened.select(*extra.columns).unionByName(extra)
    names = [n for c in ("signal", "view", "baseline", "learned", "localizer") for n in tools.available(c)]
    records = tools.run_tools(both, names, DEFAULT_SUITE).cache()
    assert records.count() == 8 * len(names) * len(DEFAULT_SUITE) == records.select("entry_path", "level", "tool").distinct().count()
    assert records.where("score is null or score < 0 or score > 1").count() == 0
    by = {(r.entry_path, r.level, r.tool): r for r in records.where("level = 'clean'").collect()}
    assert "comb" in by["a.jpg", "clean", "double_jpeg"].details and "comb" not in by["c.png", "clean", "double_jpeg"].details
    assert by["f", "clean", "ela"].score == 0.5 and "unreadable" in by["f", "clean", "ela"].details
    assert by["a.jpg", "clean", "iml_vit"].score == 0.5 and "weights" in by["a.jpg", "clean", "iml_vit"].details
    assert "no member" in by["a.jpg", "clean", "localizer_ensemble"].details
    means = {r.entry_path: r.score for r in tools.signals_mean(records.where("level = 'clean'")).collect()}
    assert means["a.jpg"] == pytest.approx(np.mean([by["a.jpg", "clean", n].score for n in tools.SIGNALS_MEAN]))


def test_ensemble_of_members_with_maps():
    tools.register(tools.Tool("half_map", "localizer", lambda rgb: {"score": 0.9, "map": np.full((8, 8), 0.25, np.float32)}))
    tools.register(tools.Tool("late_map", "localizer", None, load=lambda: lambda rgb: {"score": 0.1, "map": np.linspace(0, 1, rgb.shape[0] * rgb.shape[1]).reshape(rgb.shape[:2])}))
    try:
        rgb = picture(1, 16, 16)
        out = tools.ensemble(("half_map", "iml_vit", "late_map"))(rgb)
        assert out["members"] == "half_map, late_map" and out["map"].min() == pytest.approx(0.25) and out["map"].max() == 1 and json.loads(out["member_scores"]) == {"half_map": 0.9, "iml_vit": 0.5, "late_map": 0.1}
        assert tools.ensemble(("half_map", "late_map"))(rgb, "mean")["map"].max() == pytest.approx(0.625)
    finally:
        del tools._TOOLS["half_map"], tools._TOOLS["late_map"]


def test_double_quantisation(jpeg_file):
    make, read = jpeg_file
    rng = np.random.default_rng(13)
    f = np.maximum(1, np.hypot(*np.meshgrid(np.fft.fftfreq(512) * 512, np.fft.fftfreq(512) * 512)))
    field = np.fft.ifft2(np.fft.fft2(rng.normal(size=(512, 512))) / f).real  # as rough at all scales as photographs are
    rgb = np.clip(128 + 45 * field[..., None] / field.std() + rng.normal(0, 2, (512, 512, 3)), 0, 255).astype(np.uint8)
    once = signals.double_quantisation(codecs.luma_coefficients(make(rgb, 0.9))[0])
    again = signals.double_quantisation(codecs.luma_coefficients(make(codecs.pixels(make(rgb, 0.55)), 0.9))[0])
    assert once < signals.TWICE < again
