"""URL filtering by stated host and path rules, and by mined association rules for the rest.

A stated rule fits its host and all subdomains if the path starts with its path; the
longest fitting one decides. The pages it decides are the labelled ones: their URL
tokens (scheme, host labels, path segments, extension, query keys, fragment; numbers
are one token) together with the verdict are mined by Spark's FP-growth. Rules whose
consequent is a verdict stay if their support and confidence are high enough and no
rule of fewer tokens is as confident. A rule is posted under its rarest token; a
token set meets the rules posted under its tokens and takes the most confident of
those it contains. Equal token sets are matched once.

Edge cases: a null url, or one without "://", has an empty host and path and no
tokens; pages that no rule matches take the default verdict; ties among matching
rules go to support, then fewer tokens, then the tokens' order; repeated rows are
kept; an empty table, or one without labelled pages, mines nothing; extra columns
are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: (host, path, verdict)
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
MIN_SUPPORT, MIN_CONFIDENCE = 0.01, 0.8
DEFAULT = "allow"
#: Places that the sets with a token are dealt to; token sets with this share of all pages (1 / HOT) are looked up without a shuffle.
SPLIT, HOT = 32, 1024
_LABEL = "verdict="


def split_url(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path, and what follows the path."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    path = F.regexp_extract(tail, r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path, F.substring(tail, F.length(path) + 1, F.length(tail))


def fitting(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(size, rule, verdict), or null."""
    fits = [
        F.when(((host == h) | host.endswith(f".{h}")) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("size"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits)) if len(fits) else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def tokens(url: Column, host: Column, path: Column, tail: Column) -> Column:
    """The distinct tokens of a URL."""
    blank = lambda a: F.filter(a, lambda x: x != "")
    number = lambda x: F.when(x.rlike(r"^\d+$"), "#").otherwise(x)
    scheme = F.when(F.instr(url, "://") > 0, F.array(F.concat(F.lit("scheme="), F.substring_index(url, "://", 1)))).otherwise(F.array().cast("array<string>"))
    labels = F.transform(blank(F.split(host, r"\.")), lambda x: F.concat(F.lit("host="), number(x)))
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    stem = F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", "")
    segments = F.transform(blank(F.split(stem, "/")), lambda x: F.concat(F.lit("path="), number(x)))
    kind = F.when(extension != "", F.array(F.concat(F.lit("extension="), extension))).otherwise(F.array().cast("array<string>"))
    keys = F.transform(blank(F.split(F.regexp_extract(tail, r"^\?([^#]*)", 1), "&")), lambda x: F.concat(F.lit("query="), F.substring_index(x, "=", 1)))
    fragment = F.when(F.instr(tail, "#") > 0, F.array(F.lit("fragment"))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(scheme, labels, segments, kind, keys, fragment)))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(needs, n_needs, verdict, confidence, support) of (items, verdict) rows; min_support bounds the rules, whatever the input's size."""
    marked = labelled.select(F.array_append("items", F.concat(F.lit(_LABEL), "verdict")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(marked)
    said = F.element_at("consequent", 1)
    rules = model.associationRules.where(said.startswith(_LABEL)).select(
        F.array_sort("antecedent").alias("needs"), F.size("antecedent").alias("n_needs"), F.substring(said, F.lit(len(_LABEL) + 1), F.length(said)).alias("verdict"), "confidence", "support"
    )
    rules = materialise(rules, "url-rules")
    # a rule goes if one with a token less is as confident of the same verdict; chains of such rules end in a shortest one
    less = rules.select(F.col("needs").alias("short"), F.col("verdict"), F.col("confidence").alias("sure"))
    more = rules.where("n_needs > 1").select("needs", "verdict", "confidence", F.explode("needs").alias("without"))
    more = more.select("needs", "verdict", "confidence", F.array_remove("needs", F.col("without")).alias("short"))
    idle = more.join(less, ["short", "verdict"]).where("sure >= confidence").select("needs", "verdict").distinct()
    return rules.join(idle, ["needs", "verdict"], "left_anti")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(items, best): the best rule of each distinct token set that contains one, as struct with verdict, confidence and needs.

    A token that very many sets have is dealt to SPLIT places, its rules to all of them.
    """
    exploded = sets.select("items", F.pmod(F.xxhash64("items"), F.lit(SPLIT)).cast("int").alias("place"), F.explode("items").alias("token"))
    frequency = exploded.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    posted = rules.select("*", F.explode("needs").alias("token")).join(frequency, "token")
    keys = posted.groupBy("needs", "verdict").agg(F.min(F.struct("n", "token")).token.alias("token"))
    index = rules.join(keys, ["needs", "verdict"]).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(SPLIT - 1))))
    met = exploded.join(index, ["token", "place"]).where(F.size(F.array_except("needs", "items")) == 0)
    rank = F.struct(F.col("confidence"), F.col("support"), (-F.col("n_needs")).alias("shortness"), F.array_join("needs", " ").alias("pattern"), F.col("verdict"))
    return met.groupBy("items").agg(F.max(rank).alias("best"))


def looked_up(pages: DataFrame, sets: DataFrame, best: DataFrame) -> DataFrame:
    """The pages (with items) and the best rule of their token set. Sets that 1 / HOT of all pages or more have, at most HOT, are looked up where the pages stand."""
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = sets.where(F.col("n") * HOT >= total).select("items").join(best, "items", "left").withColumn("hot", F.lit(True))
    marked = pages.join(F.broadcast(hot), "items", "left")
    rest = marked.where("hot is null").drop("hot", "best").join(best, "items", "left")
    return marked.where("hot").drop("hot").unionByName(rest)


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, default: str = DEFAULT) -> DataFrame:
    """Verdict of every page: a stated rule's, else a mined rule's, else the default."""
    host, path, tail = split_url(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"), tail.alias("tail"))
    ruled = parsed.select("*", fitting(F.col("host"), F.col("path"), rules).alias("fit"), tokens(F.col("url"), F.col("host"), F.col("path"), F.col("tail")).alias("items"))
    labelled = ruled.where("fit is not null").select("items", F.col("fit.verdict").alias("verdict"))
    none = [F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("double").alias("confidence")]
    stated = ruled.where("fit is not null").select("page_id", "host", "path", "fit.rule", "fit.verdict", *none)
    open_ = ruled.where("fit is null").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), "items")
    if labelled.isEmpty():
        return open_.select("page_id", "host", "path", "rule", F.lit(default).alias("verdict"), *none)
    sets = materialise(open_.groupBy("items").agg(F.count(F.lit(1)).alias("n")), "url-sets")
    best = materialise(match(sets, mine(labelled, min_support, min_confidence)), "url-matches")
    mined = looked_up(open_, sets, best).select(
        "page_id", "host", "path", "rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.col("best.pattern").alias("pattern"), F.col("best.confidence").alias("confidence")
    )
    return stated.unionByName(mined)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
