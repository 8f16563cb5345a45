"""Commands over the library: python -m evispark COMMAND ...; entries are JSON lines, records Parquet, reports Markdown."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import audit, benchmark, crops, entries, fusion, rendering, suite, tools
from .sources import datasets, images, scan


def _session() -> SparkSession:
    return SparkSession.builder.appName("evispark").getOrCreate()


def _show(df: DataFrame) -> None:
    for row in df.toLocalIterator():
        print(json.dumps(rendering.jsonable(row.asDict(recursive=True)), sort_keys=True))


def _extra(pairs: Sequence[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for p in pairs:
        key, _, value = p.partition("=")
        out.setdefault(key, []).append(value)
    return out


def _analyze(a: argparse.Namespace) -> None:
    names = a.tools or tools.available("signal")
    with open(a.image, "rb") as f:
        data = f.read()
    if a.report:
        benchmark.image_report(data, names, a.report, a.image.rpartition("/")[2], _fuser(a.model) if a.model else None)
    print(benchmark.analysed(data, names))


def _tools(a: argparse.Namespace) -> None:
    _show(tools.catalogue(_session()))


def _prepare(a: argparse.Namespace) -> None:
    spark = _session()
    found = datasets.prepare(spark, a.dataset, a.root, a.out, datasets.read_layouts(a.layouts) if a.layouts else None, datasets.read_registry(spark, a.registry) if a.registry else None, strict=a.strict_audit)
    _show(found.problems)
    _show(found.skipped)
    if found.masks is not None:
        _show(found.masks)


def _materialize(a: argparse.Namespace) -> None:
    _show(datasets.materialise_shards(_session(), a.shards, a.out, a.max_rows))


def _audit(a: argparse.Namespace) -> None:
    e = scan.read_entries(_session(), a.entries)
    print(rendering.audit_markdown(e))
    if a.strict and not audit.report(e).isEmpty():
        sys.exit(1)


def _summary(a: argparse.Namespace) -> None:
    _show(entries.summary(scan.read_entries(_session(), a.entries)).orderBy("axis", "value"))


def _sample(a: argparse.Namespace) -> None:
    scan.write_entries(entries.stratified_sample(scan.read_entries(_session(), a.entries), a.n, a.seed, a.by), a.out)


def _filter(a: argparse.Namespace) -> None:
    e = scan.read_entries(_session(), a.entries)
    scan.write_entries(entries.filter_entries(e, split=a.split, label=a.label, generators=a.generator, extra=_extra(a.extra), require_mask=a.require_mask, dedupe=a.dedupe), a.out)


def _merge(a: argparse.Namespace) -> None:
    spark = _session()
    scan.write_entries(entries.merge([(root, scan.read_entries(spark, path)) for path, root in (p.split("=", 1) for p in a.parts)]), a.out)


def _split(a: argparse.Namespace) -> None:
    e = scan.read_entries(_session(), a.entries)
    group = F.col(a.group) if a.group in e.columns else F.element_at("extra", F.lit(a.group))
    scan.write_entries(entries.split_by_group(e, group, a.val_fraction, a.seed, a.holdout), a.out)


def _crop(a: argparse.Namespace) -> None:
    from pyarrow import fs

    spark = _session()
    e = scan.read_entries(spark, a.entries)
    targets = crops.target_rows(e, a.size, a.mode, a.labels or None, a.min_side)
    found, _ = benchmark.opened(spark, e, a.root)
    out = a.out

    def write(batches):
        system, base = fs.FileSystem.from_uri(out)
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                place = f"{base}/{path}"
                if data.is_valid and system.get_file_info(place).type == fs.FileType.NotFound:
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    with system.open_output_stream(place + ".part") as f:
                        f.write(data.as_buffer())
                    system.move(place + ".part", place)
            yield batch.select(["path"])

    crops.cut_images(found, targets, a.size).mapInArrow(write, "path string").count()
    _show(crops.crop_report(targets))


def _benchmark(a: argparse.Namespace) -> None:
    spark = _session()
    e = scan.read_entries(spark, a.entries)
    done = benchmark.run(spark, e, a.root, a.tools or tools.available("signal"), suite.read_suite(a.suite) if a.suite else suite.DEFAULT_SUITE, a.limit)
    done.records.write.mode("overwrite").parquet(f"{a.out}/records")
    records = scan.read_scores(spark, f"{a.out}/records")
    print(rendering.benchmark_markdown(a.entries, records, missing=done.missing.count()))


def _fit(a: argparse.Namespace) -> None:
    records = scan.read_scores(_session(), a.records)
    names = a.detectors or [r["detector"] for r in fusion.default_detectors(records).collect()]  # a row for each detector
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(fusion.fit_fuser(records, names, levels=a.levels, l2=a.l2, target=a.target, seed=a.seed).dumps())


def _fuser(path: str) -> fusion.Fuser:
    with open(path, encoding="utf-8") as f:
        return fusion.Fuser.loads(f.read())


def _eval(a: argparse.Namespace) -> None:
    print(rendering.fusion_markdown(fusion.evaluate(scan.read_scores(_session(), a.records), _fuser(a.model))))


def _info(a: argparse.Namespace) -> None:
    print(json.dumps(json.loads(_fuser(a.model).dumps()), indent=2))


def _metadata(a: argparse.Namespace) -> None:
    from .operators import metadata

    files = _session().read.format("binaryFile").option("recursiveFileLookup", "true").load(a.root)
    _show(metadata.judged(images.read_metadata(files)).select("path", "score", "label", "ai_markers", "editor_markers", "platform_markers", "note", "error"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("evispark", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(name: str, run: Callable[[argparse.Namespace], None], *arguments: tuple) -> None:
        p = sub.add_parser(name)
        p.set_defaults(run=run)
        for flags, options in arguments:
            p.add_argument(*flags.split(), **options)

    opt = lambda flag, **k: (flag, k)
    source, out, many = opt("entries"), opt("--out", required=True), {"nargs": "*", "default": []}
    command("analyze", _analyze, opt("image"), opt("--tools", **many), opt("--report"), opt("--model"))
    command("tools", _tools)
    command("metadata", _metadata, opt("root"))
    command("prepare", _prepare, opt("dataset"), opt("root"), out, opt("--layouts"), opt("--registry"), opt("--strict-audit", action="store_true"))
    command("materialize", _materialize, opt("shards"), out, opt("--max-rows", type=int))
    command("audit", _audit, source, opt("--strict", action="store_true"))
    command("summary", _summary, source)
    command("sample", _sample, source, out, opt("-n", type=int, required=True), opt("--seed", type=int, default=0), opt("--by", nargs="*", default=["label", "generator"]))
    command("filter", _filter, source, out, opt("--split"), opt("--label"), opt("--generator", **many), opt("--extra", **many), opt("--require-mask", action="store_true"), opt("--dedupe", action="store_true"))
    command("merge", _merge, opt("parts", nargs="+", metavar="ENTRIES=ROOT"), out)
    command("split", _split, source, out, opt("--group", required=True), opt("--val-fraction", type=float, default=0.2), opt("--seed", type=int, default=0), opt("--holdout", **many))
    command("crop", _crop, source, opt("root"), out, opt("--size", type=int, required=True), opt("--mode", choices=["center", "tiles"], default="center"), opt("--labels", **many), opt("--min-side", type=int))
    command("benchmark", _benchmark, source, opt("root"), out, opt("--tools", **many), opt("--suite"), opt("--limit", type=int))
    command("fusion-fit", _fit, opt("records"), out, opt("--detectors", **many), opt("--levels", nargs="*", default=["clean"]), opt("--l2", type=float, default=0.01), opt("--target", type=float, default=0.9), opt("--seed", type=int, default=0))
    command("fusion-eval", _eval, opt("records"), opt("model"))
    command("fusion-info", _info, opt("model"))
    return top


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(a)


if __name__ == "__main__":
    main()
