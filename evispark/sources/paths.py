"""Declarative rules from paths to columns: globs, labels, generators, splits, masks, extra attributes."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Folder names that tell the label, and the extension of each image format
FOLDERS = {"real": "real", "fake": "fake", "0_real": "real", "1_fake": "fake", "authentic": "real", "tampered": "fake", "nature": "real", "ai": "fake"}
EXTENSIONS = {"jpeg": "jpg", "jpg": "jpg", "png": "png", "webp": "webp", "tiff": "tif", "bmp": "bmp", "gif": "gif"}


def glob_regex(pattern: str) -> str:
    """``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay within a folder; the whole path must match."""
    out, i = ["(?s)^"], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            c = pattern[i]
            out.append("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c))
            i += 1
    return "".join([*out, r"\z"])


def matches(path: Column, patterns: Sequence[str]) -> Column:
    """Whether the path fits one of the globs."""
    return path.rlike("|".join(f"(?:{glob_regex(p)})" for p in patterns)) if patterns else F.lit(False)


def label_from_parent(path: Column) -> Column:
    folder = F.lower(F.element_at(F.split(path, "/"), F.lit(-2)))
    return F.element_at(F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv]), F.when(F.size(F.split(path, "/")) > 1, folder).otherwise(""))


def folder(path: Column, up: int) -> Column:
    """The name of the folder so many steps above the file, null where there is none."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > up, F.element_at(parts, F.lit(-1 - up)))


def group(path: Column, pattern: str, number: int | str = 1) -> Column:
    """What a group of the first match holds, null where it takes no part."""
    if isinstance(number, str):
        number = re.compile(pattern).groupindex[number]
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", pattern)
    return F.nullif(F.regexp_extract(path, java, number), F.lit(""))


@dataclass(frozen=True)
class MaskRule:
    pattern: str
    template: str  # with {group} fields


@dataclass(frozen=True)
class Layout:
    """Rules of a dataset; exclusion comes before real, real before fake."""

    real: Sequence[str] = ()
    fake: Sequence[str] = ()
    exclude: Sequence[str] = ()
    generator: str = "none"  # none, parent, grandparent, or a pattern with a group named gen
    split: str = "none"  # none, top, parent, or a pattern with a group named split
    split_map: dict[str, str] = field(default_factory=dict)
    masks: Sequence[MaskRule] = ()
    mask_template: str | None = None  # with {stem}, {parent} and {name}
    extra: Sequence[str] = ()  # patterns with named groups


def label(path: Column, layout: Layout) -> Column:
    return F.when(matches(path, layout.exclude), None).when(matches(path, layout.real), "real").when(matches(path, layout.fake), "fake")


def generator(path: Column, rule: str) -> Column:
    if rule == "none":
        return F.lit(None).cast("string")
    return folder(path, 1) if rule == "parent" else folder(path, 2) if rule == "grandparent" else group(path, rule, "gen")


def split(path: Column, rule: str, mapping: dict[str, str]) -> Column:
    if rule == "none":
        raw = F.lit(None).cast("string")
    elif rule == "top":
        raw = F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1))
    else:
        raw = folder(path, 1) if rule == "parent" else group(path, rule, "split")
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), raw), raw) if mapping else raw
    return F.when(named.isin("train", "val", "test"), named)


def mask(path: Column, layout: Layout) -> Column:
    """The first mask rule that matches; rules override the template."""
    out = None
    for rule in layout.masks:
        names = re.compile(rule.pattern).groupindex
        unknown = set(re.findall(r"\{(\w+)\}", rule.template)) - set(names)
        if unknown:
            raise ValueError(f"the mask template names groups that its pattern lacks: {sorted(unknown)}")
        parts = [F.coalesce(group(path, rule.pattern, x[1:-1]), F.lit("")) if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", rule.template) if x]
        hit = path.rlike(re.sub(r"\(\?P<(\w+)>", r"(?<\1>", rule.pattern))
        out = F.when(hit, F.concat(*parts)) if out is None else out.when(hit, F.concat(*parts))
    if out is not None:
        return out
    if layout.mask_template:
        name = F.element_at(F.split(path, "/"), F.lit(-1))
        fields = {"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "parent": F.coalesce(folder(path, 1), F.lit(""))}
        return F.concat(*[fields[x[1:-1]] if x.startswith("{") else F.lit(x) for x in re.split(r"(\{\w+\})", layout.mask_template) if x])
    return F.lit(None).cast("string")


def extra(path: Column, patterns: Sequence[str]) -> Column:
    """The named groups that take part, as a map."""
    pairs = [x for p in patterns for n in re.compile(p).groupindex for x in (F.lit(n), group(path, p, n))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")


def apply_layout(files: DataFrame, layout: Layout, listing: DataFrame | None = None) -> DataFrame:
    """Columns label, generator, split, mask_path and extra of files by path; unlabelled files go, masks that no listing has are null."""
    p = F.col("path")
    out = files.withColumns({"label": label(p, layout) if layout.real or layout.fake else label_from_parent(p), "split": split(p, layout.split, layout.split_map), "mask_path": mask(p, layout), "extra": extra(p, layout.extra)})
    out = out.where(F.col("label").isNotNull()).withColumn("generator", F.when(F.col("label") == "fake", generator(p, layout.generator)))
    if listing is not None:
        have = listing.select(F.col("path").alias("mask_path"), F.lit(True).alias("_there"))
        out = out.join(have, "mask_path", "left").withColumn("mask_path", F.when(F.col("_there"), F.col("mask_path"))).drop("_there")
    return out


def extension(fmt: Column) -> Column:
    """The file extension of an image format; ``bin`` for none."""
    lower = F.lower(F.trim(fmt))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv]), lower)
    return F.coalesce(known, F.nullif(lower, F.lit("")), F.lit("bin"))


def label_folder(value: Column, kind: str) -> Column:
    """The label of a raw shard value: bool, 0 or 1, or text; anything else is an error."""
    if kind == "boolean":
        return F.when(value, "fake").when(~value, "real").otherwise(F.raise_error(F.lit("unknown label: null")))
    text = F.lower(F.trim(value.cast("string")))
    return F.when(text.isin("0", "real", "false"), "real").when(text.isin("1", "fake", "true"), "fake").otherwise(F.raise_error(F.concat(F.lit("unknown label: "), F.coalesce(text, F.lit("null")))))
