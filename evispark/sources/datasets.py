"""Datasets from files to audited entries: layout and registry files, sidecars, preparation, materialised shards."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, entries
from . import paths, scan

SIDECAR = "attributes.jsonl"
SPLITS = ("train", "val", "test")


def _yaml(path: str) -> Any:
    try:
        import yaml
    except ImportError as e:  # not part of the engine's requirements
        raise RuntimeError("layout, registry and suite files need PyYAML; pass dictionaries instead") from e
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def layout_of(spec: dict[str, Any]) -> paths.Layout:
    """A layout from a mapping of a layout file."""
    if unknown := {spec.get("generator_from", "none")} - {"none", "parent", "grandparent", "regex"} | {spec.get("split_from", "none")} - {"none", "top", "parent", "regex"}:
        raise ValueError(f"{spec.get('dataset')}: unknown rule {sorted(unknown)}")

    def rule(kind: str) -> str:
        if spec.get(f"{kind}_from", "none") != "regex":
            return spec.get(f"{kind}_from", "none")
        if not spec.get(f"{kind}_regex"):
            raise ValueError(f"{spec.get('dataset')}: {kind}_regex is missing")
        return spec[f"{kind}_regex"]

    return paths.Layout(
        real=tuple(spec.get("real_globs") or ()),
        fake=tuple(spec.get("fake_globs") or ()),
        exclude=tuple(spec.get("exclude_globs") or ()),
        generator=rule("generator"),
        split=rule("split"),
        split_map=dict(spec.get("split_map") or {}),
        masks=tuple(paths.MaskRule(m["regex"], m["template"]) for m in spec.get("mask_rules") or ()),
        mask_template=spec.get("mask_template"),
        extra=(spec["extra_regex"],) if spec.get("extra_regex") else (),
    )


def read_layouts(path: str) -> dict[str, paths.Layout]:
    """Layouts by dataset from a file with a list ``layouts``."""
    return {x["dataset"]: layout_of(x) for x in _yaml(path).get("layouts", [])}


def named(known: dict[str, Any], name: str) -> Any:
    """What goes by exactly that name; the error lists the names there are."""
    if name not in known:
        raise KeyError(f"no {name}; there are {', '.join(sorted(known)) or 'none'}")
    return known[name]


REGISTRY = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("name", "task", "homepage", "download", "access", "license")]
    + [T.StructField("commercial_ok", T.BooleanType()), T.StructField("approx_size_gb", T.DoubleType()), T.StructField("verified", T.BooleanType())]
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The datasets of a registry file as rows."""
    return registry_rows(spark, _yaml(path).get("datasets", []))


def registry_rows(spark: SparkSession, specs: Iterable[dict[str, Any]]) -> DataFrame:
    rows = [[None if (v := x.get(f.name)) is None else float(v) if isinstance(f.dataType, T.DoubleType) else v for f in REGISTRY] for x in specs]
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a dataset is registered twice")
    return spark.createDataFrame(rows, REGISTRY)


def read_sidecar(spark: SparkSession, root: str) -> DataFrame | None:
    """(path, generator, split, line) of a tree's sidecar, None if it has none. Lines that are no JSON, and those without a path, are left out."""
    base = scan.qualified(spark, root)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{SIDECAR}")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    lines = spark.read.text(where.toString()).select(F.monotonically_increasing_id().alias("line"), "value")
    got = lines.select("line", F.from_json("value", "path string, model_name string, split string").alias("x")).where("x.path is not null")
    return got.select("x.path", F.nullif("x.model_name", F.lit("")).alias("generator"), F.when(F.col("x.split").isin(*SPLITS), F.col("x.split")).alias("split"), "line")


def mask_coverage(found: DataFrame, layout: paths.Layout) -> DataFrame:
    """One row of counts over the fakes: with a mask, matched by no rule, and matched while the file is missing."""
    named_ = found.where("label = 'fake'").withColumn("_rule", paths.mask(F.col("path"), layout).isNotNull())
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    has = F.col("mask_path").isNotNull()
    return named_.agg(F.count(F.lit(1)).alias("fakes"), n(has).alias("paired"), n(~has & ~F.col("_rule")).alias("no_rule"), n(~has & F.col("_rule")).alias("no_file"))


@dataclass
class Prepared:
    """A dataset's entries, the files that could not be read, the audit's problems, and what is known of it."""

    entries: DataFrame
    skipped: DataFrame
    problems: DataFrame
    license: str | None
    commercial_ok: bool | None
    masks: DataFrame | None


def prepare(
    spark: SparkSession, dataset: str, root: str, out: str | None = None, layouts: dict[str, paths.Layout] | None = None, registry: DataFrame | None = None, license_: str | None = None, commercial_ok: bool | None = None, strict: bool = False
) -> Prepared:
    """Scans, labels and audits a tree: by the dataset's layout, else by the folders' names.

    A sidecar overrides what paths tell of generators and splits, fakes alone keep a generator, the licence comes from the registry
    unless given, and entries are written to ``out`` before the audit. ``strict`` makes any problem an error.
    """
    layout = (layouts or {}).get(dataset)
    found, skipped = scan.scan_tree(spark, root, dataset, layout)
    sidecar = read_sidecar(spark, root)
    if sidecar is not None:
        found = entries.with_sidecar(found, sidecar)
    found = entries.generators_only_for_fakes(found)
    known = registry.where(F.col("name") == dataset).select("license", "commercial_ok").first() if registry is not None else None
    if known is not None:
        license_ = known["license"] if license_ is None else license_
        commercial_ok = known["commercial_ok"] if commercial_ok is None else commercial_ok
    if out is not None:
        scan.write_entries(found, out)
        found = scan.read_entries(spark, out)
    problems = audit.report(found)
    if strict and (first := problems.first()) is not None:
        raise ValueError(f"{dataset}: {first['problem']} {first['detail']}")
    return Prepared(found, skipped, problems, license_, commercial_ok, mask_coverage(found, layout) if layout is not None and layout.masks else None)


def merged_meta(parts: DataFrame, *by: str) -> DataFrame:
    """One row (for each key) for datasets (name, license, commercial_ok, notes) that are merged: names sorted and joined, a licence only if all agree, notes joined."""
    licence = F.when((F.countDistinct("license") == 1) & (F.count("license") == F.count(F.lit(1))), F.min("license"))
    noted = F.transform(F.array_sort(F.collect_list(F.when(F.col("notes").isNotNull() & (F.col("notes") != ""), F.struct("name", "notes")))), lambda x: x["notes"])
    return parts.groupBy(*by).agg(F.array_join(F.array_sort(F.collect_list("name")), "+").alias("name"), licence.alias("license"), entries.commercial_ok("commercial_ok").alias("commercial_ok"), F.nullif(F.array_join(noted, "; "), F.lit("")).alias("notes"))


def materialise_shards(spark: SparkSession, shards: str, out: str, max_rows: int | None = None) -> DataFrame:
    """Writes the images of shards as a tree with a sidecar, and returns counts by outcome.

    Tasks write files that are not there yet, under another name first, so a run that was cut short goes on where it ended and a task
    that runs again does no harm. ``max_rows`` takes the first rows by image name. ``out`` is an absolute path or a URI that driver and
    executors share.
    """
    rows = scan.read_shards(spark, shards)
    if max_rows is not None:
        rows = rows.orderBy("image_name").limit(max_rows)
    done = rows.mapInArrow(_writer(out), "target string, label string, generator string, split string, prompt string, real_source string, subset string, architecture string, outcome string")
    done = done.persist()
    try:
        side = done.where("outcome in ('written', 'exists')").select(F.col("target").alias("path"), F.col("generator").alias("model_name"), "label", "split", "prompt", "real_source", "subset", "architecture")
        lines = side.orderBy("path").select(F.to_json(F.struct(*side.columns)).alias("value")).toLocalIterator()  # a line at a time
        scan.write_lines(f"{out}/{SIDECAR}", (r["value"] for r in lines))
        counts = done.groupBy("outcome", "label").agg(F.count(F.lit(1)).alias("n")).collect()  # a row for each outcome and label
        return spark.createDataFrame([tuple(r) for r in counts], "outcome string, label string, n long")
    finally:
        done.unpersist()


def _writer(out: str):
    """Writes the images of a batch below a folder of any file system that Arrow knows."""
    fields = ("target", "label", "model_name", "split", "prompt", "real_source", "subset", "architecture")

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(out)
        for batch in batches:
            data = batch.column("image_data")
            outcomes = []
            for i, (target, reason) in enumerate(zip(batch.column("target").to_pylist(), batch.column("skip_reason").to_pylist(), strict=True)):
                place = f"{base}/{target}"
                if reason is None and system.get_file_info(place).type == fs.FileType.NotFound:
                    system.create_dir(place.rpartition("/")[0], recursive=True)
                    part = f"{place}.{uuid.uuid4().hex}.part"
                    with system.open_output_stream(part) as f:
                        f.write(data[i].as_buffer())
                    system.move(part, place)
                    reason = "written"
                outcomes.append(reason or "exists")
            columns = [batch.column(f).cast(pa.string()) for f in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outcomes, pa.string())], ["target", "label", "generator", "split", "prompt", "real_source", "subset", "architecture", "outcome"])

    return run
