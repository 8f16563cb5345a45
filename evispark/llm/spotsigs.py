"""SpotSigs: fingerprints of the content words that follow common words.

Every common word (an anchor) forms a signature with the next CHAIN content words,
however many other anchors stand in between; the start of the text is an anchor too,
so that each text with a content word has a signature. Where anchors are missing
(tables, lists, code, other languages) every content word is one: in texts without any
anchor and more than BARE words, and in runs of more than GAP content words, so that
their signatures cover the whole length. The fingerprint is the sorted set of the
signatures' 64-bit hashes, its likeness to another one their Jaccard index.

Everything is DataFrame functions. Texts cross one shuffle, dealt to buckets by
quantiles of doc_id, where each finds its successor; a bucket's last row takes the
first of the next bucket that has one.

Edge cases: a null text is empty; an empty fingerprint is like another empty one (1)
and like no other (0); rows with one id follow each other by text, so that each is
the next document of the one before; a null id is the smallest; the only document of
a table is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import json
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import doc_key, materialise, table

CHAIN = 2
#: Content words that a text without anchors, and a run between two anchors, may have without signatures of their own.
BARE, GAP = 10, 30
THRESHOLD = 0.8
# Common words of English, German, French and Spanish
ANCHORS = (
    "the of and to a in is that it for was on are as with be this by at from have or not "
    "der die das und den von zu mit ist ein eine nicht auf dem im für auch des sich als "
    "le la les et des en un une est que du dans pour qui au par sur avec plus ne "
    "el los las de y del se por una con su al lo como para más pero es"
).split()
_NULL_KEY = -(1 << 63)
_MARK = "\x01"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: what a lambda's body holds besides its variable is computed for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def signatures(text: Column) -> Column:
    """The sorted distinct hashes of a text's signatures."""
    words = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")
    spaced = F.concat(F.lit(f"{_MARK}^ "), F.ltrim(words), F.lit(" "))
    marked = F.rtrim(F.regexp_replace(spaced, rf" (?=(?:{'|'.join(sorted(set(ANCHORS)))}) )", _MARK))
    none = F.array().cast("array<string>")

    def chains(pieces: Column) -> Column:
        """Pieces are a content word each, with the anchors that follow it; every anchor is chained to the next pieces' words."""

        def of(both: Column) -> Column:
            chain = lambda i: F.concat_ws(" ", *(F.get(both["content"], i + j) for j in range(1, CHAIN + 1)))
            joined = lambda x, i: _bound(chain(i), lambda c: F.when(c != "", F.transform(F.slice(F.split(x, _MARK), 2, 1 << 30), lambda a: F.concat(a, F.lit(" "), c))).otherwise(none))
            return F.flatten(F.transform(both["pieces"], lambda x, i: F.when(F.instr(x, _MARK) > 0, joined(x, i)).otherwise(none)))

        return _bound(F.struct(pieces.alias("pieces"), F.transform(pieces, lambda x: F.substring_index(x, _MARK, 1)).alias("content")), of)

    def runs(parts: Column) -> Column:
        """Parts are an anchor each, with the content words that follow it; where these are many, all form chains."""
        limit = F.when(F.size(parts) <= 2, BARE).otherwise(GAP)
        every = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 2), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(CHAIN + 1))))
        split = lambda part: _bound(F.split(part, " "), lambda w: F.when(F.size(w) - 1 > limit, every(w)).otherwise(none))
        return F.flatten(F.transform(parts, lambda part: F.when(F.length(part) > 2 * limit, split(part)).otherwise(none)))

    found = _bound(marked, lambda m: F.concat(_bound(F.split(m, " "), chains), _bound(F.split(m, _MARK), runs)))
    return F.array_sort(F.array_distinct(F.transform(found, lambda c: F.xxhash64(c))))


def likeness(a: Column, b: Column) -> Column:
    """The Jaccard index of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, F.lit(1.0)).otherwise(both / either)


def printed(fingerprint: Column) -> Column:
    """A fingerprint as sixteen hexadecimal digits for each signature, in the order of the set."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _place(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are not above the value, looked up in two levels."""
    if not cuts:
        return F.lit(0)
    width = isqrt(len(cuts))
    groups = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)  # noqa: E731  folded to a constant
    upto = lambda a: F.size(F.filter(a, lambda c: c <= value))
    group = upto(literal([g[0] for g in groups], "array<bigint>"))
    within = F.transform(F.array(group), lambda g: F.when(g == 0, 0).otherwise((g - 1) * width + upto(F.element_at(literal(groups, "array<array<bigint>>"), F.greatest(g, F.lit(1))))))
    return F.element_at(within, 1)


def digests(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited forms, and the likeness to these and to the next document's."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(doc_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.agg(F.percentile_approx("k", [i / (4 * parts) for i in range(1, 4 * parts)], 40 * parts)).first()[0] or []  # numbers as many as buckets
    rows = rows.withColumn("bucket", _place(F.col("k"), sorted(set(cuts))))

    # a bucket's successor is the next one that has rows, the first one's after the last
    lows = rows.groupBy("bucket").agg(F.min("k").alias("k"))
    order = Window.orderBy("bucket")
    after = lows.select(F.col("bucket").alias("of"), F.coalesce(F.lead("bucket").over(order), F.first("bucket").over(order)).alias("bucket"))
    heads = rows.join(F.broadcast(lows), ["bucket", "k"]).groupBy("bucket").agg(F.min("text").alias("head"))  # one row for each bucket
    heads = after.join(heads, "bucket").select(F.col("of").alias("bucket"), "head", signatures(F.col("head")).alias("head_sig"))

    dealt = rows.repartition(parts, "bucket").withColumn("sig", signatures(F.col("text")))
    here = Window.partitionBy("bucket").orderBy("k", "text")
    placed = dealt.select("*", F.lead("k").over(here).alias("next_k"), F.lead("text").over(here).alias("next_text"), F.lead("sig").over(here).alias("next_sig"))
    joined = placed.join(heads.hint("merge"), "bucket")
    last = F.col("next_k").isNull()
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.when(last, F.col("head")).otherwise(F.col("next_text")), F.lit(1), half))
    joined = joined.select("k", "sig", n.cast("long").alias("n_chars"), edited.alias("edited"), F.when(last, F.col("head_sig")).otherwise(F.col("next_sig")).alias("next_sig"))
    joined = joined.withColumn("edited_sig", signatures(F.col("edited")))
    return joined.select(
        F.when(F.col("k") != _NULL_KEY, F.col("k")).alias("doc_id"),
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sig")).alias("fingerprint"),
        printed(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
        likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(doc_id, class) of all documents with signatures, a class being the least id of equal fingerprints; and (a, b, likeness) of all pairs of classes with that likeness.

    Classes are partitioned by the length of their sets, so that only equal or neighbouring partitions can hold a pair, and posted
    under their rarest signatures, as many as a pair must have one of in common; lengths prune what meets.
    """
    found = docs.select(doc_key().alias("doc_id"), signatures(F.coalesce("text", F.lit(""))).alias("sig")).where(F.size("sig") > 0)
    classes = materialise(found.groupBy("sig").agg(F.min("doc_id").alias("class"), F.collect_set("doc_id").alias("ids")).withColumn("n", F.size("sig")), "spotsigs")
    members = classes.select(F.explode("ids").alias("doc_id"), "class")
    posted = classes.select("class", "n", F.explode("sig").alias("s"))
    counted = posted.join(posted.groupBy("s").count(), "s")
    rare = counted.groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("count", "s"))).alias("all"))
    length = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / threshold)) + 1e-9)
    prefix = F.slice("all", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).cast("int"))
    index = rare.select("class", "n", length.alias("part"), F.explode(prefix).alias("p")).select("class", "n", "part", "p.s")
    probe = index.select(F.col("class").alias("a"), F.col("n").alias("n_a"), F.explode(F.array("part", F.col("part") + 1)).alias("part"), "s")
    meet = probe.join(index.withColumnsRenamed({"class": "b", "n": "n_b"}), ["part", "s"])
    meet = meet.where(((F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))) & (F.col("n_a") >= threshold * F.col("n_b"))).select("a", "b").distinct()
    sets = classes.select("class", "sig")
    both = meet.join(sets.toDF("a", "sig_a"), "a").join(sets.toDF("b", "sig_b"), "b")
    pairs = both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), likeness(F.col("sig_a"), F.col("sig_b")).alias("likeness")).where(F.col("likeness") >= threshold)
    return members, pairs


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
