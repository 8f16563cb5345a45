"""Near duplicates by an inverted join on the coordinates of MinHash signatures.

1. A document's set of word shingles (as 64-bit hashes) gives a signature of
   COORDINATES minima and a 128-bit digest of the whole set. Documents with equal
   sets are one class from here on, so that copies never form pairs.
2. Two sets with the wanted similarity agree in at least ``t`` coordinates (they miss
   that with a probability of MISS). So they agree in one of the first
   COORDINATES - t + 1, the prefix: pairs meet in the lists of these (coordinate,
   value) pairs only, and the other coordinates are counted only for pairs that meet
   ("skip"). Lists with one class are dropped, and classes left in fewer than t lists.
3. A shingle that one class alone has bounds all its similarities: a class with too
   few shared shingles has no links, and of two classes the bound is known at once.
4. In each list all classes are held against one centre, the class of the most
   crowded lists (of several the one that shares most of its set), and confirmed on
   full sets; links give components. Lists that still have several take two further
   centres, the class that shares most of its set and the one of the most crowded lists
   outside the components of their centres, for at most ROUNDS rounds and while these
   find links: a group whose first centre lies at its edge comes together here, at two
   comparisons for each member and round, before pairs are sought.
   Two classes that met the same first centre are similar exactly if their differences
   from it have enough in common, and those with a link left meet in the rarest
   elements of these differences. What is left are pairs in a list one of which did
   not pass the match threshold with that centre; they are matched and confirmed one
   by one. No pair within a component is ever made, and no other pair is lost.
5. Components come from contraction: every root hooks to its least neighbour until
   no link joins two roots. Each round is written to the shared folder.

Edge cases: a null or empty text, or one without words, has an empty set and no
links; fewer words than a shingle has are one shingle; repeated rows, and documents
with one id, are documents of their own; a null id is the smallest; ties go to the
smallest id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, doc_key, map_batches, materialise, table
from .suffix_dedup import _BYTE, _UP

WORDS, PERCENT = 5, 80
COORDINATES = 32
#: Probability that a pair of the wanted similarity is not found.
MISS = 1e-8
#: Classes against one copy of a centre.
FAN = 256
#: Bands of classes around a centre by how far they are from it.
BANDS = 16
#: Further centres of a list, at most; what they leave apart is searched pair by pair.
ROUNDS = 4
_NULL_KEY = -(1 << 63)

_RNG = np.random.default_rng(5)
_ODD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_WORD = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def match_threshold(percent: int, coordinates: int = COORDINATES, miss: float = MISS) -> int:
    """The most matches that pairs of that similarity fall short of with a probability of at most ``miss``."""
    p, below = percent / 100, 0.0
    for t in range(coordinates + 1):
        if below > miss:
            return max(1, t - 1)
        below += comb(coordinates, t) * p**t * (1 - p) ** (coordinates - t)
    return coordinates


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, and each word's text; words are runs without ASCII white space, A-Z lower-cased."""
    raw = np.frombuffer(b"\n".join([t.lower() for t in texts]) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.flatnonzero(~space)
    if not len(inside):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    new = np.ones(len(inside), bool)
    new[1:] = np.diff(inside) != 1
    first = np.flatnonzero(new)
    starts = inside[first]
    lengths = np.diff(np.append(first, len(inside)))
    local = np.arange(len(inside)) - np.repeat(first, lengths)
    h = np.add.reduceat(_BYTE[raw[inside]] * _UP[local & 4095] + (local >> 12).astype(np.uint64), first)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return mix(h + lengths.astype(np.uint64)), np.searchsorted(begins, starts, side="right") - 1


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, ascending within each, and each one's text."""
    h, doc = word_hashes(texts)
    n = len(h)
    if not n:
        return h, doc
    total = np.bincount(doc, minlength=len(texts))
    out = np.zeros(n, np.uint64)
    same = np.arange(n)
    for j in range(words):
        ok = same[: n - j][doc[: n - j] == doc[j:]] if j else same
        out[ok] += h[ok + j] * _WORD[j]
    first = np.append(True, doc[1:] != doc[:-1])
    whole = np.zeros(n, bool)
    if n >= words:
        whole[: n - words + 1] = doc[: n - words + 1] == doc[words - 1 :]
    short = first & (total[doc] < words)  # the sequence of a short text
    out[short] += total[doc[short]].astype(np.uint64) * _WORD[63]
    keep = whole | short
    out, doc = mix(out[keep]), doc[keep]
    order = np.lexsort((out, doc))
    out, doc = out[order], doc[order]
    new = np.append(True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])) if len(out) else np.empty(0, bool)
    return out[new], doc[new]


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode() for t in column.to_pylist()]


def _set_digests(sets: np.ndarray, doc: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty text: its number, the size of its set, and two hashes of it."""
    n = np.bincount(doc, minlength=count)
    some = np.flatnonzero(n)
    first = np.searchsorted(doc, some)
    if not len(some):
        return some, n[some], np.empty(0, np.int64), np.empty(0, np.int64)
    one = np.add.reduceat(mix(sets + np.uint64(1)), first)
    two = np.add.reduceat(mix(sets ^ np.uint64(0x5851F42D4C957F2D)), first)
    return some, n[some], mix(one).view(np.int64), mix(two).view(np.int64)


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """(k, n, one, two, sig): one row for each document; without shingles n is 0 and sig null."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            count = batch.num_rows
            sets, doc = shingle_sets(_texts(batch.column("text")), words)
            some, n, one, two = _set_digests(sets, doc, count)
            first = np.searchsorted(doc, some)
            sig = np.empty((len(some), COORDINATES), np.int32)
            for i in range(COORDINATES if len(some) else 0):
                sig[:, i] = (np.minimum.reduceat(sets * _ODD[i] + _ADD[i], first) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            full = [np.zeros(count, np.int64) for _ in range(3)]
            for to, values in zip(full, (n, one, two), strict=True):
                to[some] = values
            has = np.zeros(count, bool)
            has[some] = True
            ends = np.concatenate([[0], np.cumsum(has) * COORDINATES]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("k"), *map(pa.array, full), lists], ["k", "n", "one", "two", "sig"])

        return work

    return map_batches(docs.select(doc_key().alias("k"), "text"), make, "k long, n long, one long, two long, sig array<int>")


def full_sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """(cid, shingles): the full sets of classes, from their first documents' texts; twice or more where rows repeat, which does no harm."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets, doc = shingle_sets(_texts(batch.column("text")), words)
            some, n, one, two = _set_digests(sets, doc, batch.num_rows)
            want = [batch.column(c).to_numpy()[some] for c in ("n", "one", "two")]
            same = (want[0] == n) & (want[1] == one) & (want[2] == two)  # other documents of the same id
            first, last = np.searchsorted(doc, some[same]), np.searchsorted(doc, some[same], side="right")
            data = [sets[a:b].astype("<u8").tobytes() for a, b in zip(first, last, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("cid").take(pa.array(some[same])), pa.array(data, pa.binary())], ["cid", "shingles"])

        return work

    rows = docs.select(doc_key().alias("k"), "text").join(classes.select("k", "cid", "n", "one", "two"), "k")
    return map_batches(rows, make, "cid long, shingles binary")


_MISSING = np.uint64(1)  # the lowest bit of an element of a difference tells what the centre has from what it lacks


def compare(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, similar, n_a, n_b, missing, diff) of pairs, on full sets: whether they are similar, how many shingles of a are missing in b, and what b lacks and has besides.

    A class ``a`` of many pairs is copied to each FAN of them.
    """
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).cast("int").alias("fans"))
    spread = pairs.join(fans, "a").withColumn("fan", F.pmod(F.xxhash64("b"), F.col("fans")).cast("int"))
    heads = fans.join(sets, fans.a == sets.cid).select("a", F.explode(F.sequence(F.lit(0), F.col("fans") - 1)).alias("fan"), F.lit(None).cast("long").alias("b"), "shingles")
    tails = spread.join(sets, spread.b == sets.cid).select("a", "fan", "b", "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head = None, np.empty(0, np.uint64)
        for batch in batches:
            rows = []
            for a, fan, b, raw in zip(*(batch.column(c) for c in ("a", "fan", "b", "shingles")), strict=True):
                data = np.frombuffer(raw.as_buffer(), "<u8")
                if not b.is_valid:
                    key, head = (a.as_py(), fan.as_py()), data.copy()
                elif key == (a.as_py(), fan.as_py()):
                    lacks, more = np.setdiff1d(head, data, assume_unique=True), np.setdiff1d(data, head, assume_unique=True)
                    both = len(head) - len(lacks)
                    similar = 100 * both >= percent * (len(data) + len(lacks))
                    diff = np.concatenate([lacks | _MISSING, more & ~_MISSING]).view(np.int64)
                    rows.append((a.as_py(), b.as_py(), similar, len(head), len(data), len(lacks), diff))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["a", "b", "similar", "n_a", "n_b", "missing", "diff"])

    dealt = heads.unionByName(tails).repartition("a", "fan").sortWithinPartitions("a", "fan", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(run, "a long, b long, similar boolean, n_a long, n_b long, missing long, diff array<long>")


def links_around_centres(compared: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """(a, b): components that similar classes link which were held against the same centre, at least one of which is not similar to it.

    With m missing and r more shingles than the centre's n, let g = percent r + 100 m. Two such classes are similar if and only if their
    differences have k = (g + g' - (100 - percent) n) / (100 + percent) elements in common. So they meet in the rarest elements of both,
    of a difference all but its k - 1 most frequent. As k rises with the partner's g, classes are dealt to BANDS bands by g, and post
    for each band of partners as many elements as its least g asks for: far from the centre k is nearly the whole difference of the
    nearer class, of which only the very rarest elements are posted, and edits that one class alone has meet nothing. The places of the
    first common element bound what can follow it, and prune what meets.
    """
    scale = 100 + percent
    own = compared.select("a", "b", "similar", "diff", (percent * (F.col("n_b") - F.col("n_a") + F.col("missing")) + 100 * F.col("missing")).alias("g"), ((100 - percent) * F.col("n_a")).alias("room"))
    own = own.join(roots.toDF("b", "root"), "b", "left").withColumn("root", F.coalesce("root", "b"))
    elements = own.select("a", "b", F.explode("diff").alias("e"))
    frequency = elements.groupBy("a", "e").agg(F.count(F.lit(1)).alias("df"))
    ranked = elements.join(frequency, ["a", "e"]).groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("df", "e"))).alias("sorted"))
    width = F.greatest(F.lit(1), F.ceil(F.col("room") / (BANDS // 2)))
    band = lambda g: F.least(F.floor(g / width), F.lit(BANDS - 1)).cast("int")
    ranked = own.drop("diff").join(ranked, ["a", "b"]).select("*", F.size("sorted").alias("size"), width.alias("width"), band(F.col("g")).alias("band"), band(F.col("room") + 1).alias("least_far"))

    def posted(rows: DataFrame, partners, least, names: dict[str, str]) -> DataFrame:
        """The elements of a difference but for the k - 1 most frequent, for each band of partners; those that no other has are left out."""
        each = rows.withColumn("partner", F.explode(partners))
        k = F.greatest(F.lit(1), F.ceil((F.col("g") + least - F.col("room")) / scale))
        first = F.transform(F.slice("sorted", F.lit(1), F.greatest(F.lit(0), F.col("size") - k + 1).cast("int")), lambda p, i: F.struct(p.df.alias("df"), p.e.alias("e"), (F.col("size") - i).alias("left")))
        each = each.select("*", F.explode(F.filter(first, lambda p: p.df > 1)).alias("p"))
        return each.select("a", F.col("p.e").alias("e"), *[F.col(c).alias(n) for c, n in names.items()], F.col("p.left").alias(f"left_{names['b']}"))

    low = F.col("partner") * F.col("width")
    far = posted(ranked.where("not similar"), F.sequence(F.lit(0), F.lit(BANDS - 1)), low, {"b": "x", "root": "root_x", "g": "g_x", "room": "room", "band": "far", "partner": "near"})
    near = posted(ranked, F.sequence("least_far", F.lit(BANDS - 1)), F.greatest(low, F.col("room") + 1), {"b": "y", "root": "root_y", "g": "g_y", "band": "near", "partner": "far"})
    enough = scale * F.least("left_x", "left_y") >= F.col("g_x") + F.col("g_y") - F.col("room")
    met = far.join(near, ["a", "e", "far", "near"]).where((F.col("x") != F.col("y")) & (F.col("root_x") != F.col("root_y")) & enough).select("a", "x", "y", "root_x", "root_y", "g_x", "g_y", "room").distinct()
    diffs = own.select("a", "b", "diff")
    both = met.join(diffs.toDF("a", "x", "diff_x"), ["a", "x"]).join(diffs.toDF("a", "y", "diff_y"), ["a", "y"])
    common = F.size(F.array_intersect("diff_x", "diff_y"))
    return both.where(scale * common >= F.col("g_x") + F.col("g_y") - F.col("room")).select(F.least("root_x", "root_y").alias("a"), F.greatest("root_x", "root_y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(cid, root): the least member of each linked class's component."""
    edges = materialise(edges.select("a", "b"), "links")
    size = 2 * edges.count()  # more than there are members
    labels = materialise(edges.select(F.col("a").alias("cid")).union(edges.select("b")).distinct().select("cid", F.col("cid").alias("root")), "roots", size)
    while True:
        left, right = labels.toDF("a", "x"), labels.toDF("b", "y")
        cross = edges.join(left, "a").join(right, "b").where("x <> y").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
        told = materialise(cross.groupBy("y").agg(F.min("x").alias("x")), "hooks", size)
        if told.isEmpty():
            discard(edges, told)
            return labels
        hooks = told
        for _ in range(2):  # pointer jumping
            up = hooks.select(F.col("y").alias("x"), F.col("x").alias("z"))
            hooks = hooks.join(up, "x", "left").select("y", F.coalesce("z", "x").alias("x"))
        before, labels = labels, materialise(labels.join(hooks.select(F.col("y").alias("root"), "x"), "root", "left").select("cid", F.coalesce("x", "root").alias("root")), "roots", size)
        discard(before, told)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(k, n, root): each document's key, the size of its set, and the key that names its component."""
    need = match_threshold(percent)
    prefix = COORDINATES - need + 1
    signed = materialise(signatures(docs, words), "signatures")
    classes = signed.where("n > 0").groupBy("n", "one", "two").agg(F.min("k").alias("k"), F.first("sig").alias("sig"))
    classes = materialise(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")

    def crowded(own: DataFrame, first: int) -> DataFrame:
        """Postings (slot, cid, n_slot) of the first coordinates, in lists of two classes and more."""
        posted = own.select("cid", F.posexplode(F.slice("sig", 1, first)).alias("i", "v")).select(
            "cid", (F.shiftleft(F.col("i").cast("long"), 32) + F.col("v").cast("long").bitwiseAND(0xFFFFFFFF)).alias("slot")
        )
        lists = posted.groupBy("slot").agg(F.count(F.lit(1)).alias("n_slot")).where("n_slot > 1")
        return posted.join(lists, "slot")

    # a class in fewer lists than a match takes has no partner
    meeting = crowded(classes, COORDINATES).groupBy("cid").agg(F.count(F.lit(1)).alias("lists")).where(F.col("lists") >= need).select("cid")
    sets = materialise(full_sets(docs, classes.join(meeting, "cid"), words), "sets")
    size = sets.count()

    def cut():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw = batch.column("shingles").to_pylist()
            sizes = [len(r) // 8 for r in raw]
            return pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column("cid").to_numpy(), sizes)), pa.array(np.frombuffer(b"".join(raw), "<i8"))], ["cid", "shingle"])

        return work

    alone = map_batches(sets.select("cid", "shingles"), cut, "cid long, shingle long", "shingles").groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("cid").alias("cid")).where("n = 1").groupBy("cid").agg(F.count(F.lit(1)).alias("alone"))
    linkable = classes.join(sets.select("cid").distinct(), "cid").join(alone, "cid", "left").select("cid", "n", "sig", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared"))
    linkable = materialise(linkable.where(F.col("shared") * 100 >= F.col("n") * percent), "linkable", size)
    size = linkable.count()
    postings = materialise(crowded(linkable, prefix), "postings", size * prefix)

    def may_link(n_a, n_b, shared_a, shared_b, sig_a, sig_b):
        """Whether bounds and matches allow the similarity."""
        both = F.least(shared_a, shared_b)
        matches = F.size(F.filter(F.zip_with(sig_a, sig_b, lambda x, y: x == y), lambda x: x))
        return (both * 100 >= (n_a + n_b - both) * percent) & (matches >= need)

    def passing(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b), once each, that may link."""
        one, two = (linkable.select(*(F.col(c).alias(f"{c}_{s}" if c != "cid" else s) for c in linkable.columns)) for s in "ab")
        fits = may_link(*(F.col(f"{c}_{s}") for c in ("n", "shared", "sig") for s in "ab"))
        return pairs.distinct().join(one, "a").join(two, "b").where(fits).select("a", "b")

    def apart(rows: DataFrame, roots: DataFrame) -> DataFrame:
        """The lists (slot, cid, weight, share, root) that have several components."""
        placed = rows.join(roots, "cid", "left").select("slot", "cid", "weight", "share", F.coalesce("root", "cid").alias("root"))
        mixed = placed.groupBy("slot").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("slot")
        return placed.join(mixed, "slot")

    def joined(roots: DataFrame) -> DataFrame:
        """Links (a, b) that give these components, one for each class."""
        return roots.where("cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b"))

    weight = postings.groupBy("cid").agg(F.sum("n_slot").alias("weight")).join(linkable.select("cid", (F.col("shared") / F.col("n")).alias("share")), "cid")
    ranked = materialise(postings.join(weight, "cid").select("slot", "cid", "weight", "share"), "ranked", size * prefix)
    centre = ranked.groupBy("slot").agg(F.max(F.struct("weight", "share", "cid")).cid.alias("a"))
    stars = materialise(passing(ranked.join(centre, "slot").where("a <> cid").select("a", F.col("cid").alias("b"))), "stars", size * prefix)
    compared = materialise(compare(stars, sets, percent), "compared")
    roots = components(compared.where("similar").select("a", "b"))

    lists, centres = materialise(apart(ranked, roots), "apart", size * prefix), centre
    for _ in range(ROUNDS):
        reached = centres.join(roots.toDF("a", "root"), "a", "left").select("slot", F.coalesce("root", "a").alias("root")).distinct()
        free = lists.join(centres.toDF("slot", "cid"), ["slot", "cid"], "left_anti").join(reached.withColumn("reached", F.lit(True)), ["slot", "root"], "left")
        top = free.groupBy("slot").agg(
            F.max(F.struct("share", "weight", "cid", "root")).alias("inner"), F.max(F.when(F.col("reached").isNull(), F.struct("weight", "share", "cid", "root"))).alias("outer")
        )
        both = F.array_distinct(F.array(*[F.struct(F.col(f"{c}.cid").alias("a"), F.col(f"{c}.root").alias("root_a")) for c in ("inner", "outer")]))
        further = materialise(top.select("slot", F.inline(both)).where("a is not null"), "centres", 2 * size * prefix)
        held = lists.join(further, "slot").where("root <> root_a").select("a", F.col("cid").alias("b"))
        held = materialise(passing(held), "further", 2 * size * prefix)
        found = materialise(compare(held, sets, percent).where("similar").select("a", "b"), "found", 2 * size * prefix)
        if found.isEmpty():
            break
        centres = centres.unionByName(further.select("slot", "a"))
        roots = components(joined(roots).unionByName(found))
        before, lists = lists, materialise(apart(lists.drop("root"), roots), "apart", size * prefix)
        discard(before, held, found)

    # pairs of classes that were not both held against the list's first centre
    held = lists.select("slot", "cid", "root").join(centre, "slot").join(stars.select("a", F.col("b").alias("cid"), F.lit(True).alias("met")), ["a", "cid"], "left")
    held = held.withColumn("met", F.coalesce("met", F.col("a") == F.col("cid"))).join(linkable.select("cid", "n", "shared", "sig"), "cid")
    held = materialise(held.select("slot", "cid", "root", "met", "n", "shared", "sig"), "held")
    out = held.where("not met").select("slot", *[F.col(c).alias(f"{c}_x") for c in ("cid", "root", "n", "shared", "sig")])
    once = F.col("met") | (F.col("cid_x") < F.col("cid"))
    rest = out.join(held, "slot").where(once & (F.col("root") != F.col("root_x")) & may_link(F.col("n"), F.col("n_x"), F.col("shared"), F.col("shared_x"), F.col("sig"), F.col("sig_x")))
    rest = materialise(rest.select(F.least("cid_x", "cid").alias("a"), F.greatest("cid_x", "cid").alias("b")).distinct(), "rest")
    more = compare(rest, sets, percent).where("similar").select("a", "b")
    roots = components(joined(roots).unionByName(links_around_centres(compared, roots, percent)).unionByName(more))

    named = classes.join(roots, "cid", "left").select("n", "one", "two", "k", F.coalesce("root", "cid").alias("root"))
    least = named.groupBy("root").agg(F.min("k").alias("least"))
    named = named.join(least, "root").select("n", "one", "two", "least")
    return signed.select("k", "n", "one", "two").join(named, ["n", "one", "two"], "left").select("k", "n", F.coalesce("least", "k").alias("root"))


def _id(col: str) -> F.Column:
    return F.when(F.col(col) != _NULL_KEY, F.col(col))


def digests(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    found = near_duplicates(docs, words, percent)
    return found.select(_id("k").alias("doc_id"), F.col("n").alias("n_shingles"), _id("root").alias("component_id"), (F.col("k") == F.col("root")).alias("kept"))


def keep_first(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents, of each component the one row with the smallest id (of several with that id the first by text).

    Where ids repeat or are null, rows are numbered by id and text first, and judged one by one.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    if docs.groupBy(doc_key()).count().where("count > 1").isEmpty():
        keyed = docs.withColumn(row, doc_key())
    else:
        keyed = materialise(docs.orderBy(doc_key(), F.coalesce("text", F.lit(""))).withColumn(row, F.monotonically_increasing_id()), "numbered")
    gone = near_duplicates(keyed.select(F.col(row).alias("doc_id"), "text"), words, percent).where("k <> root").select(F.col("k").alias(row))
    return keyed.join(gone, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), 3, 85)


#: All pairs that share a shingle, and what each document reaches through links.
SQL = r"""WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n FROM s),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * both_ >= 85 * (na.n + nb.n - both_)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT u.b, r.root FROM r JOIN u ON u.a = r.doc_id WHERE r.root < u.b),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN c USING (doc_id)"""
