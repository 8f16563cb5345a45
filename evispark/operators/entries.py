"""The algebra of dataset entries: filter, summarise, deduplicate, sample, split, merge."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = "none"


def known(col: str | Column) -> Column:
    """Null and empty values group under ``none``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.nullif(c.cast("string"), F.lit("")), F.lit(NONE))


def in_extra(key: str, values: Iterable[str]) -> Column:
    """The key is in the map and its value, as text, among the given ones."""
    return F.coalesce(F.map_contains_key("extra", F.lit(key)) & F.element_at("extra", F.lit(key)).isin(*values), F.lit(False))


def filter_entries(
    df: DataFrame, *, split: str | None = None, label: str | None = None, generators: Sequence[str] = (), extra: dict[str, Sequence[str]] | None = None, require_mask: bool = False, dedupe: bool = False
) -> DataFrame:
    """Criteria are ANDed, the values of one ORed; duplicates go after the filter."""
    if split is not None:
        df = df.where(F.col("split") == split)
    if label is not None:
        df = df.where(F.col("label") == label)
    if generators:
        df = df.where(F.col("generator").isin(*generators))
    for key, values in (extra or {}).items():
        df = df.where(in_extra(key, values))
    if require_mask:
        df = df.where(F.col("mask_path").isNotNull())
    return first_by_hash(df) if dedupe else df


def first_by_hash(df: DataFrame) -> DataFrame:
    """Of entries with equal content the first by path; a hash of a third of all rows is reduced map-side."""
    least = df.groupBy("sha256").agg(F.min("path").alias("path"))
    return df.join(least, ["sha256", "path"], "left_semi")


def summary(df: DataFrame, axes: Sequence[str] = ("label", "source", "generator", "split", "format")) -> DataFrame:
    """(axis, value, n) over all axes in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), known(a).alias("value")) for a in axes]))
    return df.select(pairs.alias("x")).groupBy("x.axis", "x.value").agg(F.count(F.lit(1)).alias("n"))


def _stratum(keys: Sequence[str]) -> Column:
    return F.concat_ws("/", *[known(k) for k in keys])


def allocation(df: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """(stratum, size, take): largest remainders first, ties by stratum; the strata are few, as their keys are categories."""
    sizes = df.groupBy(_stratum(keys).alias("stratum")).agg(F.count(F.lit(1)).alias("size"))
    every = Window.partitionBy(F.lit(0))
    quota = F.col("size") * n / F.sum("size").over(every)
    base = sizes.withColumn("quota", quota).withColumn("floor", F.least(F.floor("quota"), F.col("size")))
    left = F.least(F.lit(n), F.sum("size").over(every)) - F.sum("floor").over(every)
    order = Window.partitionBy(F.lit(0)).orderBy(F.round(F.col("floor") - F.col("quota"), 9), "stratum")
    base = base.withColumn("left", left).withColumn("place", F.row_number().over(order))
    return base.select("stratum", "size", F.least(F.col("size"), F.col("floor") + (F.col("place") <= F.col("left")).cast("long")).alias("take"))


def _seeded(seed: int, col: str) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(col)), 256)


def lowest(df: DataFrame, keys: Sequence[str], digest: str, ties: str, takes: DataFrame) -> DataFrame:
    """Of each key the ``take`` rows with the least hexadecimal digest, of equal ones by ``ties``.

    Rows are counted by the digest's first four digits; lots below the one in which the number is reached stay whole,
    and only that one is put in order, so no task sees a key's rows.
    """
    lot = F.substring(digest, 1, 4)
    named = df.withColumn("_lot", lot)
    counts = named.groupBy(*keys, "_lot").agg(F.count(F.lit(1)).alias("_n"))
    below = Window.partitionBy(*keys).orderBy("_lot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_left", F.lit(0) - F.coalesce(F.sum("_n").over(below), F.lit(0)))
    open_ = counts.join(takes.select(*keys, "take"), list(keys)).select(*keys, "_lot", "_n", (F.col("take") + F.col("_left")).alias("_left")).where("_left > 0")
    met = named.join(open_, [*keys, "_lot"])
    whole = met.where("_n <= _left")
    place = F.row_number().over(Window.partitionBy(*keys, "_lot").orderBy(digest, ties))
    part = met.where("_n > _left").withColumn("_place", place).where("_place <= _left").drop("_place")
    return whole.unionByName(part).drop("_lot", "_n", "_left")


def stratified_sample(df: DataFrame, n: int, seed: int = 0, keys: Sequence[str] = ("label", "generator")) -> DataFrame:
    """About n entries with the strata's shares; within a stratum by a seeded hash of the path."""
    named = df.withColumns({"stratum": _stratum(keys), "_digest": _seeded(seed, "path")})
    return lowest(named, ["stratum"], "_digest", "path", allocation(df, n, keys)).select(*df.columns)


def split_by_group(df: DataFrame, group: Column, val_fraction: float, seed: int = 0, holdout: Sequence[str] = ()) -> DataFrame:
    """Whole groups go to val or train; entries without a group are dealt one by one, by a seeded hash.

    Held-out groups are named, or else taken from the largest on while val is short of its share.
    """
    named = df.withColumn("_group", group)
    sizes = named.where("_group is not null").groupBy("_group").agg(F.count(F.lit(1)).alias("size"))
    if holdout:
        chosen = sizes.where(F.col("_group").isin(*holdout)).select("_group")
    else:
        # by distinct size first, of which there are few: the groups of a size are taken whole, or as many as are needed by their hash
        classes = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"), F.sum("size").alias("rows"))
        larger = Window.partitionBy(F.lit(0)).orderBy(F.desc("size")).rowsBetween(Window.unboundedPreceding, -1)
        target = F.bround(F.sum("rows").over(Window.partitionBy(F.lit(0))) * val_fraction)
        before = F.coalesce(F.sum("rows").over(larger), F.lit(0))
        takes = classes.withColumn("take", F.least(F.col("groups"), F.ceil((target - before) / F.col("size")))).where("take > 0").select("size", "take")
        chosen = lowest(sizes.withColumn("_digest", _seeded(seed, "_group")), ["size"], "_digest", "_group", takes).select("_group")
    chosen = chosen.withColumn("_val", F.lit(True))
    share = F.conv(F.substring(_seeded(seed, "path"), 1, 8), 16, 10).cast("long") / (1 << 32)
    held = F.when(F.col("_group").isNull(), share < val_fraction).otherwise(F.coalesce("_val", F.lit(False)))
    return named.join(chosen, "_group", "left").withColumn("split", F.when(held, "val").otherwise("train")).drop("_group", "_val")


def merge(parts: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Bag union; entries of different roots get absolute paths."""
    roots = {root for root, _ in parts}
    absolute = lambda root, df: df.withColumn("path", F.concat(F.lit(root.rstrip("/") + "/"), "path")) if len(roots) > 1 else df
    out = absolute(*parts[0])
    for part in parts[1:]:
        out = out.unionByName(absolute(*part))
    return out


def commercial_ok(col: str) -> Column:
    """Any false is false, else any null is null, else true: an aggregate."""
    return F.when(F.min(col) == F.lit(False), F.lit(False)).when((F.count(col) == F.count(F.lit(1))) & (F.count(F.lit(1)) > 0), F.lit(True))


def with_sidecar(df: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Attributes of a sidecar (path, generator, split) override path-derived ones, field by field; the last line of a path wins."""
    last = sidecar.groupBy("path").agg(F.max_by(F.struct("generator", "split"), "line").alias("s"))
    return df.join(last, "path", "left").withColumns({"generator": F.coalesce("s.generator", "generator"), "split": F.coalesce("s.split", "split")}).drop("s")


def generators_only_for_fakes(df: DataFrame) -> DataFrame:
    return df.withColumn("generator", F.when(F.col("label") == "fake", F.col("generator")))


def cached(wanted: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows whose keys a feature cache has, and those it lacks."""
    have = cache.select(*keys)
    return wanted.join(have, list(keys), "left_semi"), wanted.join(have, list(keys), "left_anti")
