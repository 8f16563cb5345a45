"""Removal of repeated byte strings by sorting sampled suffixes in range partitions.

Every byte covered by a string of ``min_bytes`` bytes that also starts earlier
(smaller doc_id, or earlier in the same document) goes. Sorting all suffixes would
move the corpus a hundredfold, so suffixes are sampled by content, without loss:

1. A suffix counts where the hash of its first GRAM bytes is the least among all
   grams of some window of min_bytes bytes. Equal windows pick equal suffixes, and
   each window picks one, so no repeat escapes.
2. A suffix travels as the hash of its gram and a second one of its context, the bytes
   that a window around it can reach. Of equal contexts (128 bits) in one slice of
   texts only the first meets the others; the rest are known to be repeats at once,
   which keeps hot strings from gathering. Sorted by gram and context, a stream tells
   what is alone, what repeats as a whole, and what shares its gram with another
   context: the border suffixes, of which one for each context stays.
3. These, with their contexts' bytes, are dealt by sampled splitters on their leading
   bytes, so that no gram is cut apart and the buckets' borders lie between different
   strings. Buckets stream through in sorted order; at a block's border the last gram
   is carried over to the next block.
4. A block is sorted by multikey quicksort, eight bytes at a time, refining ties only.
   Each window is held, byte by byte, against the first equal one of its gram.
5. A gram with more than CROWD contexts would be one long block. Its contexts' windows
   are dealt by their digests instead, and each is held against the first equal one.

Edge cases: a null text is empty; texts shorter than min_bytes stay; documents with
the same id, repeated rows included, count as separate documents in the order of
their texts; a null id is the smallest; extra columns are ignored by the query and
kept by the stage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_key, map_batches, materialise, table

MIN_BYTES = 100
GRAM = 32
#: Grams hashed at a time.
CHUNK = 1 << 19
#: Rows of contexts sorted at a time, unless one gram has more.
BLOCK = 20_000
#: Contexts of a gram from which on its windows are dealt one by one.
CROWD = 200_000
#: Bytes of text whose equal contexts meet before the shuffle; they are hashed CHUNK at a time.
SLICE = 4 << 20
_NULL_KEY = -(1 << 63)

_RNG = np.random.default_rng(20240607)
_BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    up = np.full(n, _BASE, np.uint64)
    down = np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_UP, _DOWN = _powers(CHUNK + 8192)


def gram_hashes(raw: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each run of ``gram`` bytes; at most CHUNK + 8192 bytes at a time."""
    n = len(raw) - gram + 1
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE[raw] * _UP[: len(raw)], out=total[1:])
    h = (total[gram:] - total[:n]) * _DOWN[:n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _sliding(a: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """The best of each run of ``width`` values, by doubling."""
    done = 1
    while 2 * done <= width:
        a = best(a[:-done], a[done:])
        done *= 2
    return best(a[: len(a) - (width - done)], a[width - done :]) if done < width else a


def anchors(raw: np.ndarray, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Sampled suffixes of a text: their starts and the hashes of their grams."""
    width, n = min_bytes - gram + 1, len(raw) - gram + 1
    starts, hashes = [], []
    for s in range(0, n, CHUNK) if n >= width else ():
        lo, hi = max(0, s - width + 1), min(n, s + CHUNK + width - 1)
        if hi - lo < width:
            lo = max(0, hi - width)
        h = gram_hashes(raw[lo : hi + gram - 1], gram)
        least = np.zeros(len(h) + width - 1, np.uint64)
        least[width - 1 : len(h)] = _sliding(h, width, np.minimum)
        at = np.flatnonzero(h == _sliding(least, width, np.maximum))
        at = at[(at + lo >= s) & (at + lo < s + CHUNK)]
        starts.append(at + lo)
        hashes.append(h[at])
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    return np.concatenate(starts), np.concatenate(hashes)


def multikey_order(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows of a matrix of big-endian words, and the class of each sorted row: equal rows share one.

    Word by word: only rows that tie so far are sorted on, within their ties; the order among equal rows is that of the input.
    """
    n = len(words)
    order, klass = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n)  # places in the order whose rows still tie
    for column in words.T:
        if not len(active):
            break
        rows = order[active]
        sort = np.lexsort((column[rows], klass[active]))
        rows = rows[sort]
        order[active] = rows
        value, group = column[rows], klass[active]
        new = np.ones(len(active), bool)
        new[1:] = (value[1:] != value[:-1]) | (group[1:] != group[:-1])
        first = np.maximum.accumulate(np.where(new, active, 0))
        klass[active] = first  # a class is named by its first place
        tied = np.zeros(len(active), bool)
        tied[:-1] |= ~new[1:]
        tied[1:] |= ~new[1:]
        active = active[tied]
    return order, klass


def repeats_in_block(context: np.ndarray, before: np.ndarray, after: np.ndarray, gram: int, min_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows in document order: which of them repeat, and from how far before their suffix to how far after it.

    Row: ``before`` bytes in front of the suffix and ``after`` bytes of it, set around column min_bytes - gram of ``context``.
    """
    reach, n = min_bytes - gram, len(context)
    lo, hi = np.full(n, -1, np.int64), np.full(n, -1, np.int64)  # the repeat windows' least and greatest distance before the suffix
    # contexts that are equal as a whole; the gram leads, so that rows of one gram are neighbours
    sizes = np.stack([before, after], 1).astype(np.uint64)
    pad = -(context.shape[1]) % 8
    turned = np.concatenate([context[:, reach:], context[:, :reach], np.zeros((n, pad), np.uint8)], 1)
    words = np.concatenate([np.ascontiguousarray(turned).view(">u8").astype(np.uint64), sizes], 1)
    order, klass = multikey_order(words)
    leader = order[klass]  # the first row of each sorted row's class
    whole = (leader != order) & (before[order] + after[order] >= min_bytes)
    again = order[whole]
    lo[again], hi[again] = min_bytes - np.minimum(after[again], min_bytes), np.minimum(before[again], reach)

    rows = np.sort(order[leader == order])  # distinct contexts
    g = words[rows][:, : gram // 8]
    gram_order, gram_class = multikey_order(g)
    group = np.empty(len(rows), np.int64)
    group[gram_order] = gram_class
    counts = np.bincount(group, minlength=len(rows) or 1)
    rows, group = rows[counts[group] > 1], group[counts[group] > 1]
    if len(rows):
        part, b, a = context[rows], before[rows], after[rows]
        columns = np.ascontiguousarray(part.T)
        term = lambda j: _BYTE[columns[j]] * _UP[j]
        window = np.zeros(len(rows), np.uint64)  # the hash of the window that begins d bytes before the suffix, moved on byte by byte
        for j in range(reach, reach + min_bytes):
            window += term(j)
        spread = group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for d in range(reach + 1):
            left = reach - d
            if d:
                window += term(left) - term(left + min_bytes)
            ok = np.flatnonzero((b >= d) & (a >= min_bytes - d))
            if len(ok) < 2:
                continue
            key = window[ok] ^ spread[ok]
            sort = np.argsort(key, kind="stable")
            ks = key[sort]
            new = np.ones(len(ok), bool)
            new[1:] = ks[1:] != ks[:-1]
            first = ok[sort[np.maximum.accumulate(np.where(new, np.arange(len(ok)), 0))]]
            mine = ok[sort]
            later = mine != first
            mine, first = mine[later], first[later]
            same = (part[mine, left : left + min_bytes] == part[first, left : left + min_bytes]).all(1)
            hit = rows[mine[same]]
            lo[hit] = np.where(lo[hit] < 0, d, lo[hit])
            hi[hit] = d
    found = np.flatnonzero(hi >= 0)
    return found, hi[found], min_bytes - lo[found]


def _numbered(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """(k, rk, text): rk tells documents of the same id apart, in the order of their texts. Rows that share an id are sorted with all others, by ranges, so no task gets them all."""
    out = docs.select(doc_key().alias("k"), F.coalesce("text", F.lit("")).alias("text"), *extra)
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out.withColumn("rk", F.lit(0).cast("long"))
    return materialise(out.orderBy("k", "text", *extra).withColumn("rk", F.monotonically_increasing_id()), "numbered")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a string column, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


_SECOND = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_COLUMN = _RNG.integers(0, 1 << 63, 2048, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def context_hashes(raw: np.ndarray, at: np.ndarray, begin: np.ndarray, end: np.ndarray, reach: int, min_bytes: int) -> np.ndarray:
    """Hashes of what lies from ``reach`` bytes before to ``min_bytes`` after each suffix start, as far as its text [begin, end) goes."""
    out = np.empty(len(at), np.uint64)
    column = _COLUMN[: reach + min_bytes]
    for s in range(0, len(at), 8192):
        own = slice(s, s + 8192)
        index = at[own, None] + np.arange(-reach, min_bytes)
        ok = (index >= begin[own, None]) & (index < end[own, None])
        out[own] = (np.where(ok, _SECOND[raw[np.where(ok, index, 0)]], np.uint64(0)) * column).sum(1, dtype=np.uint64)
    out += np.minimum(at - begin, reach).astype(np.uint64) * _COLUMN[-1] + np.minimum(end - at, min_bytes).astype(np.uint64) * _COLUMN[-2]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


_TOLD = ["gram", "k", "rk", "place", "kind"]


def _sorted_out(batches: Iterator[pa.RecordBatch], min_bytes: int, crowd: int) -> Iterator[pa.RecordBatch]:
    """From suffixes sorted by (gram, context, k, rk, place): whole repeats (kind 0), one border suffix for each context of grams that have several (kind 1), and the grams with more than ``crowd`` of them (kind 2)."""
    before = None  # the last row's gram and context
    leader, told = None, False  # the first row of its gram, and whether it went out
    count = 0  # border suffixes of the last gram so far

    def out(gram: np.ndarray, k: np.ndarray, rk: np.ndarray, place: np.ndarray, kind: int | np.ndarray) -> pa.RecordBatch:
        kinds = kind if isinstance(kind, np.ndarray) else np.full(len(gram), kind, np.int32)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (gram, k, rk, place)), pa.array(kinds, pa.int32())], _TOLD)

    def crowded(grams: np.ndarray) -> pa.RecordBatch:
        none = np.zeros(len(grams), np.int64)
        return out(grams, none, none, none, 2)

    for batch in batches:
        known = batch.column("known").to_numpy(zero_copy_only=False)
        gram, context, k, rk, place = (batch.column(c).to_numpy() for c in ("gram", "context", "k", "rk", "place"))
        if known.any():
            yield out(gram[known], k[known], rk[known], place[known], 0)
            gram, context, k, rk, place = (x[~known] for x in (gram, context, k, rk, place))
        n = len(gram)
        if not n:
            continue
        new_gram, new_context = np.ones(n, bool), np.ones(n, bool)
        new_gram[1:] = gram[1:] != gram[:-1]
        new_context[1:] = new_gram[1:] | (context[1:] != context[:-1])
        if before is not None:
            new_gram[0] = gram[0] != before[0]
            new_context[0] = new_gram[0] or context[0] != before[1]
            if new_gram[0] and count > crowd:
                yield crowded(np.array([before[0]]))
        whole = ~new_context & ((place >> 10 & 1023) + (place & 1023) >= min_bytes)
        border = new_context & ~new_gram
        lead = np.maximum.accumulate(np.where(new_gram, np.arange(n), -1))  # -1: an earlier batch's
        needed = np.unique(lead[border], return_counts=True)[0]
        if len(needed) and needed[0] < 0:
            needed = needed[1:]
            if not told:
                yield out(gram[:1], *(np.array([x]) for x in leader), 1)
                told = True
        rows = np.concatenate([np.flatnonzero(whole), np.flatnonzero(border), needed])
        kind = np.concatenate([np.zeros(whole.sum(), np.int32), np.ones(len(rows) - whole.sum(), np.int32)])
        yield out(gram[rows], k[rows], rk[rows], place[rows], kind)
        part = np.cumsum(new_gram) - int(new_gram[0])
        each = np.bincount(part[border], minlength=part[-1] + 1)
        each[0] += 0 if new_gram[0] else count
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        if (many := each[:-1] > crowd).any():
            yield crowded(gram[first[:-1][many]])
        count = int(each[-1])
        before = (gram[-1], context[-1])
        if lead[-1] >= 0:
            leader, told = (int(k[lead[-1]]), int(rk[lead[-1]]), int(place[lead[-1]])), bool(len(needed)) and needed[-1] == lead[-1]
    if count > crowd:
        yield crowded(np.array([before[0]]))


def _window_repeats(contexts: DataFrame, reach: int, min_bytes: int) -> DataFrame:
    """(k, rk, start, end): repeats among the contexts of crowded grams. Each window of a context is dealt by its digest, so no task meets all contexts of a gram."""
    low, high = F.greatest(F.lit(0), F.lit(min_bytes) - F.col("after")), F.least(F.col("before"), F.lit(reach))
    each = contexts.where(low <= high).select("k", "rk", "at", "context", F.explode(F.sequence(low, high)).alias("d"))
    each = each.select("k", "rk", "at", "d", F.md5(F.col("context").substr(F.lit(reach + 1) - F.col("d"), F.lit(min_bytes))).alias("m"))
    place = F.struct("k", "rk", "at")
    first = each.groupBy("d", "m").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("d", "m", "first")
    again = each.join(first, ["d", "m"]).where(place != F.col("first"))
    return again.select("k", "rk", (F.col("at") - F.col("d")).alias("start"), (F.col("at") - F.col("d") + min_bytes).alias("end"))


def spans(numbered: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM) -> DataFrame:
    """(k, rk, starts, ends): the repeated byte runs of documents that have any, possibly overlapping."""
    if min_bytes > 1000:
        raise ValueError("strings of at most 1000 bytes can be asked for")
    reach = min_bytes - gram
    size = reach + min_bytes
    parts = int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def sampled():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = _bytes_of(batch.column("text"))
            k, rk = batch.column("k").to_numpy(), batch.column("rk").to_numpy()
            # one pass over all texts; what lies across two of them is left out
            base = int(offsets[0])
            at, h = anchors(raw[base : int(offsets[-1])], min_bytes, gram)
            at = at + base
            doc = np.searchsorted(offsets, at, side="right") - 1
            inside = (at + gram <= offsets[doc + 1]) & (offsets[doc + 1] - offsets[doc] >= min_bytes)
            at, h, doc = at[inside], h[inside], doc[inside]
            begin, end = offsets[doc], offsets[doc + 1]
            context = context_hashes(raw, at, begin, end, reach, min_bytes)
            left, right = np.minimum(at - begin, reach), np.minimum(end - at, min_bytes)
            order = np.lexsort((at - begin, rk[doc], k[doc], context, h))
            again = np.zeros(len(order), bool)
            again[1:] = (h[order][1:] == h[order][:-1]) & (context[order][1:] == context[order][:-1])
            known = np.zeros(len(order), bool)
            known[order] = again
            known &= left + right >= min_bytes
            place = (at - begin) << 20 | left << 10 | right
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(context.view(np.int64)), pa.array(k[doc]), pa.array(rk[doc]), pa.array(place), pa.array(known)], ["gram", "context", "k", "rk", "place", "known"])

        return work

    found = map_batches(numbered.select("k", "rk", "text"), sampled, "gram long, context long, k long, rk long, place long, known boolean", slice_bytes=SLICE)
    # a known repeat goes anywhere
    dealt_by = F.when(F.col("known"), F.xxhash64("k", "place")).otherwise(F.col("gram"))
    streamed = found.repartition(parts, dealt_by).sortWithinPartitions("gram", "context", "k", "rk", "place")
    crowd = CROWD
    told = materialise(streamed.mapInArrow(lambda batches: _sorted_out(batches, min_bytes, crowd), "gram long, k long, rk long, place long, kind int"), "repeats")
    at = F.shiftright("place", 20)
    whole = told.where("kind = 0").select("k", "rk", (at - F.shiftright("place", 10).bitwiseAND(1023)).cast("int").alias("start"), (at + F.col("place").bitwiseAND(1023)).cast("int").alias("end"))
    def cut():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, offsets = _bytes_of(batch.column("text"))
            outs = []
            for i, places_ in enumerate(batch.column("places")):
                at = np.sort(places_.values.to_numpy()).astype(np.int64)
                text = raw[offsets[i] : offsets[i + 1]]
                for s in range(0, len(at), 4096):
                    own = at[s : s + 4096]
                    view = np.zeros((len(own), size), np.uint8)
                    index = own[:, None] + np.arange(-reach, min_bytes)
                    ok = (index >= 0) & (index < len(text))
                    view[ok] = text[index[ok]]
                    outs.append((i, own, view, np.minimum(own, reach), np.minimum(len(text) - own, min_bytes)))
            if not outs:
                return None
            rows = np.concatenate([np.full(len(o[1]), o[0]) for o in outs])
            data = np.concatenate([o[2] for o in outs])
            packed = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * size).astype(np.int32)), pa.py_buffer(data)])
            return pa.RecordBatch.from_arrays(
                [packed, batch.column("k").take(pa.array(rows)), batch.column("rk").take(pa.array(rows)), *(pa.array(np.concatenate([o[j] for o in outs]).astype(np.int32)) for j in (1, 3, 4))],
                ["context", "k", "rk", "at", "before", "after"],
            )

        return work

    def contexts_of(suffixes: DataFrame) -> DataFrame:
        places = suffixes.groupBy("k", "rk").agg(F.collect_list(at.cast("int")).alias("places"))
        return map_batches(numbered.select("k", "rk", "text").join(places, ["k", "rk"]), cut, "context binary, k long, rk long, at int, before int, after int")

    border, crowded = told.where("kind = 1"), told.where("kind = 2").select("gram").distinct()
    some = not crowded.isEmpty()
    contexts = contexts_of(border.join(crowded, "gram", "left_anti") if some else border)
    lead = F.substring("context", reach + 1, gram)
    dealt = contexts.repartitionByRange(parts, lead).sortWithinPartitions(lead, "k", "rk", "at")

    def solve(blocks: list[pa.Table]) -> pa.RecordBatch | None:
        t = pa.concat_tables(blocks).combine_chunks()
        data = t.column("context").chunk(0) if t.column("context").num_chunks else None
        if data is None or len(data) < 2:
            return None
        first = np.frombuffer(data.buffers()[1], np.int32)[data.offset]
        context = np.frombuffer(data.buffers()[2], np.uint8)[first : first + len(data) * size].reshape(-1, size)
        k, rk, at, before, after = (t.column(c).to_numpy() for c in ("k", "rk", "at", "before", "after"))
        found_, left, right = repeats_in_block(context, before, after, gram, min_bytes)
        return pa.RecordBatch.from_arrays(
            [pa.array(k[found_]), pa.array(rk[found_]), pa.array((at[found_] - left).astype(np.int32)), pa.array((at[found_] + right).astype(np.int32))], ["k", "rk", "start", "end"]
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        count = 0
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held.append(t)
            count += len(t)
            if count < BLOCK:
                continue
            whole = pa.concat_tables(held).combine_chunks()
            keys = whole.column("context")
            last = keys[len(whole) - 1].as_py()[reach : reach + gram]
            lo, hi = 0, len(whole) - 1  # the first row of the last gram
            while lo < hi:
                mid = (lo + hi) // 2
                if keys[mid].as_py()[reach : reach + gram] < last:
                    lo = mid + 1
                else:
                    hi = mid
            if lo:
                if (out := solve([whole.slice(0, lo).combine_chunks()])) is not None:
                    yield out
                held = [whole.slice(lo)]
                count = len(whole) - lo
            else:
                held = [whole]
        if held and (out := solve(held)) is not None:
            yield out

    repeated = dealt.mapInArrow(scan, "k long, rk long, start int, end int")
    if some:
        repeated = repeated.unionByName(_window_repeats(contexts_of(border.join(crowded, "gram", "left_semi")), reach, min_bytes))
    return whole.unionByName(repeated).groupBy("k", "rk").agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of half-open intervals."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    last = np.append(np.flatnonzero(new)[1:], len(s)) - 1
    return s[new], e[last]


def _runs(starts: pa.Scalar, ends: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if not starts.is_valid:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return merged(starts.values.to_numpy().astype(np.int64), ends.values.to_numpy().astype(np.int64))


def _kept(text: bytes, s: np.ndarray, e: np.ndarray) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True))


def digests(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """What is removed from every document, and a digest of what stays."""
    numbered = _numbered(docs)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for k, text, starts, ends in zip(*(batch.column(c) for c in ("k", "text", "starts", "ends")), strict=True):
                raw = (text.as_py() or "").encode()
                s, e = _runs(starts, ends)
                key = k.as_py()
                rows.append((None if key == _NULL_KEY else key, len(raw), int((e - s).sum()), len(s), hashlib.sha256(_kept(raw, s, e)).hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return work

    with_spans = numbered.select("k", "rk", "text").join(spans(numbered, min_bytes), ["k", "rk"], "left")
    return map_batches(with_spans, make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The documents without repeated strings, n_chars renewed; a character of which a byte stays is kept whole."""
    names = docs.columns
    extra = tuple(c for c in names if c not in ("doc_id", "text"))
    inner_names = {c: f"extra_{i}" for i, c in enumerate(extra)}
    numbered = _numbered(docs.select("doc_id", "text", *[F.col(c).alias(a) for c, a in inner_names.items()]), tuple(inner_names.values()))
    kept = docs.schema

    def clean(text: str, s: np.ndarray, e: np.ndarray) -> str:
        if not len(s):
            return text
        raw = text.encode()
        inner = np.frombuffer(raw + b" ", np.uint8) & 0xC0 == 0x80  # continuation bytes
        out, at = [], 0
        for a, b in zip(s.tolist(), e.tolist(), strict=True):
            while inner[a]:
                a += 1
            while inner[b]:
                b -= 1
            if a < b:
                out.append(raw[at:a])
                at = b
        return b"".join([*out, raw[at:]]).decode()

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [clean(t, *_runs(s, e)) for t, s, e in zip(batch.column("text").to_pylist(), batch.column("starts"), batch.column("ends"), strict=True)]
            keys = batch.column("k").to_pylist()
            cols = {"doc_id": pa.array([None if k == _NULL_KEY else k for k in keys], pa.int64()), "text": pa.array(texts, pa.string())}
            if "n_chars" in extra:
                cols["n_chars"] = pa.array([len(t) for t in texts], batch.column(inner_names["n_chars"]).type)
            return pa.RecordBatch.from_arrays([cols[n] if n in cols else batch.column(inner_names[n]) for n in names], names)

        return work

    joined = numbered.join(spans(numbered, min_bytes), ["k", "rk"], "left")
    return map_batches(joined, make, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


#: Every string of 100 bytes, as hexadecimal digits, against the first place where it starts.
SQL = """WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, j, substr(h, 1024 * j + 1, 1222) AS part FROM (SELECT doc_id, h, unnest(range(0, greatest(0, (length(h) // 2 + 412) // 512))) AS j FROM b)),
w AS (SELECT doc_id, 512 * j + o AS i, md5_number(substr(part, 2 * o + 1, 200)) AS m FROM (SELECT doc_id, j, part, unnest(range(0, greatest(0, length(part) // 2 - 99))) AS o FROM p)),
f AS (SELECT m, min({'d': doc_id, 'i': i}) AS first_ FROM w GROUP BY m HAVING count(*) > 1),
r AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM w JOIN f USING (m) WHERE first_.d <> doc_id OR first_.i <> i),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM r),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM g GROUP BY doc_id, run),
kept AS (SELECT doc_id, z AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY a), length(h) // 2) AS z FROM runs JOIN b USING (doc_id) UNION ALL SELECT doc_id, 0, coalesce(min(a), any_value(length(h)) // 2) FROM b LEFT JOIN runs USING (doc_id) GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM kept JOIN b USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT b.doc_id, CAST(length(b.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(k.h)) AS kept_sha256
FROM b JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)"""
