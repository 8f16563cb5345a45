"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

The model has the given order over the ids of a fixed tokenizer. A document is scored
by what all *other* rows count: from each count its own share is taken away, as every
n-gram of a document would otherwise be known from the document itself and nothing
would ever back off. With these counts c, an id w after its context h (the order - 1
ids before it, or as many as there are) has the score

    S(w | h) = c(h w) / c(h)              if c(h w) > 0
             = BACKOFF * S(w | h')        else, h' being h without its first id

down to c(w) / N, where N counts all ids of other documents; an id that no other
document has counts as one. A document's score is the sum of the logarithms to the
base 10, each rounded to 1e-6, so that sums do not depend on their order. No n-gram
is left out, however rare it is.

The relations, from the second order up:

1. ``encoded``: the ids, written once to the shared folder, a row for each chunk of
   about CHUNK ids of whole documents.
2. ``ngrams`` (chunk, order, n-gram, n): the n-grams of each chunk with their counts,
   combined in the chunk before anything is shuffled.
3. ``counted``: dealt by a hash of the n-gram, all chunks' rows of an n-gram meet in
   one bucket of the count table, which adds them up and joins the sum to each row.
4. ``score``: back at their chunk, the joined counts meet its exploded n-grams; each
   document's own counts are taken away and the logarithms summed by document.

An n-gram has one row in a chunk at most, so a hot one puts no more rows into its
bucket than there are chunks. The rows of a bucket and a chunk travel as one, columns
packed; buckets and chunks have bounded sizes, whatever the corpus. Counts of single
ids have at most as many rows as the vocabulary and go to all tasks.

Edge cases: a null or empty text, or one without ids, has 0 tokens and a null score;
rows are scored one by one even where they repeat or share an id, and a repeated row
knows its copies; one document alone has no others, so all its ids count as unknown;
a text longer than a chunk is a chunk of its own; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, tokenizer_path
from .common import drop_caches, give_back, materialise, slices, small_batches, table

ORDER, BACKOFF = 3, 0.4
#: Ids of a chunk, unless one document has more.
CHUNK = 1 << 21
#: Ids whose n-grams of one order make a bucket, before they are combined.
BUCKET = 1 << 21
VOCABULARY = 1 << 16
UNIT = 1_000_000
_CODEC = pa.Codec("zstd", 1)


def packed(values: np.ndarray) -> bytes:
    """An array's bytes, plane by plane, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def unpacked(raw: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(_CODEC.decompress(raw[8:], size), np.uint8) if size else np.empty(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(chunk, doc_ids, lengths, ids): whole documents, ids as 16-bit numbers."""
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path)
        held: list[np.ndarray] = []
        names: list[int | None] = []
        count = 0

        def told() -> pa.RecordBatch:
            flat = np.concatenate(held)
            lengths = np.asarray([len(i) for i in held], np.uint32)
            return pa.RecordBatch.from_arrays(
                [pa.array([names], pa.list_(pa.int64())), pa.array([packed(lengths)], pa.binary()), pa.array([packed(flat)], pa.binary())], ["doc_ids", "lengths", "ids"]
            )

        for batch in batches:
            for part in slices(batch, "text"):
                for doc_id, text in zip(part.column("doc_id").cast(pa.int64()).to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(tool.encode(text), "<u4")
                    if len(ids) and ids.max() >= VOCABULARY:
                        raise ValueError(f"the vocabulary has more than {VOCABULARY} ids")
                    if held and count + len(ids) > CHUNK:
                        yield told()
                        held, names, count = [], [], 0
                    held.append(ids.astype("<u2"))
                    names.append(doc_id)
                    count += len(ids)
        if held:
            yield told()
        give_back()

    small_batches(docs.sparkSession)
    found = docs.select("doc_id", "text").mapInArrow(run, "doc_ids array<long>, lengths binary, ids binary")
    return materialise(found.select(F.monotonically_increasing_id().alias("chunk"), "doc_ids", "lengths", "ids"), "ids")


def unigrams(chunks: DataFrame) -> np.ndarray:
    """Counts by id; the driver gets at most as many rows as the vocabulary has ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        n = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for raw in batch.column("ids").to_pylist():
                n += np.bincount(unpacked(raw, "<u2"), minlength=VOCABULARY)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["id", "n"])

    got = chunks.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(VOCABULARY, np.int64)
    out[got["id"].to_numpy("int64")] = got["n"].to_numpy("int64")
    return out


def exploded(flat: np.ndarray, doc: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of that order within documents, as one number each, and the place where each ends."""
    n = len(flat) - order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = flat[:n].astype(np.int64)
    for i in range(1, order):
        key = key << 16 | flat[i : i + n]
    inside = doc[:n] == doc[order - 1 :]
    return key[inside], np.flatnonzero(inside) + order - 1


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)


def _chunk(lengths: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lengths of a chunk's documents, all ids, and each one's document."""
    sizes = unpacked(lengths, "<u4").astype(np.int64)
    return sizes, unpacked(ids, "<u2").astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


NGRAMS = "bucket long, chunk long, order int, keys binary, times binary"


def ngrams(chunks: DataFrame, order: int, buckets: int) -> DataFrame:
    """The distinct n-grams of the orders from 2 of each chunk and their counts: a row for all those of one order and bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        for batch in batches:
            for chunk, lengths, ids in zip(*(batch.column(c).to_pylist() for c in ("chunk", "lengths", "ids")), strict=True):
                _, flat, doc = _chunk(lengths, ids)
                for k in range(2, order + 1):
                    keys, times = np.unique(exploded(flat, doc, k)[0], return_counts=True)
                    where = bucket_of(keys, buckets)
                    by = np.argsort(where, kind="stable")
                    keys, times, where = keys[by], times[by].astype("<u4"), where[by]
                    cuts = np.flatnonzero(np.append(True, np.diff(where) != 0)[: len(where)]).tolist()
                    ends = [*cuts[1:], len(where)]
                    rows = [(int(where[a]), chunk, k, packed(np.diff(keys[a:b], prepend=0)), packed(times[a:b])) for a, b in zip(cuts, ends, strict=False) if a < b]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "order", "keys", "times"]
                        )
        give_back()

    return chunks.select("chunk", "lengths", "ids").mapInArrow(run, NGRAMS)


def counted(rows: DataFrame, buckets: int) -> DataFrame:
    """The rows' n-grams joined with their counts in all chunks: (chunk, order, bucket, totals), in the order of the rows' keys."""

    def solve(order: int, bucket: int, held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        each = [np.cumsum(unpacked(k, "<i8")) for _, k, _ in held]
        _, where = np.unique(np.concatenate(each), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate([unpacked(t, "<u4") for _, _, t in held])).astype("<u8")[where]
        cuts = np.cumsum([len(k) for k in each])[:-1]
        n = len(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([c for c, _, _ in held], pa.int64()), pa.array([order] * n, pa.int32()), pa.array([bucket] * n, pa.int64()), pa.array([packed(t) for t in np.split(total, cuts)], pa.binary())],
            ["chunk", "order", "bucket", "totals"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes]] = []
        now = None
        for batch in batches:
            for bucket, order, *row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "order", "chunk", "keys", "times")), strict=True):
                if (order, bucket) != now and held:
                    yield solve(*now, held)
                    held = []
                now = order, bucket
                held.append(tuple(row))
        if held:
            yield solve(*now, held)
        give_back()

    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets // 2)
    return rows.repartition(parts, "bucket", "order").sortWithinPartitions("bucket", "order").mapInArrow(run, "chunk long, order int, bucket long, totals binary")


def log_shares(part: np.ndarray, whole: np.ndarray | int, backed: np.ndarray) -> np.ndarray:
    """Rounded logarithms of part / whole after ``backed`` steps of backoff, in units of 1 / UNIT."""
    return np.rint(np.log10(BACKOFF**backed * part / whole) * UNIT).astype(np.int64)


def _others(key: np.ndarray, doc: np.ndarray, total: np.ndarray) -> np.ndarray:
    """What other documents count of each exploded n-gram, numbered ``key``: its total without what its own document has."""
    _, where, own = np.unique(doc << 32 | key, return_inverse=True, return_counts=True)
    return total[key] - own[where]


def chunk_scores(sizes: np.ndarray, flat: np.ndarray, doc: np.ndarray, totals: dict[int, np.ndarray], single: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """The score of each document of a chunk, in units of 1 / UNIT; totals: the counts of the chunk's n-grams by order, bucket by bucket."""
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    longest = np.minimum(place, order - 1)  # ids of the context at most
    below = _others(flat, doc, single)  # of the n-gram one shorter, by the place where it ends
    known = np.maximum(below, 1)
    out = log_shares(known, np.maximum(single.sum() - sizes[doc], 1), longest)
    for k in range(2, order + 1):
        keys, ends = exploded(flat, doc, k)
        distinct, number = np.unique(keys, return_inverse=True)
        total = np.empty(len(distinct), np.int64)
        if len(distinct):
            total[np.argsort(bucket_of(distinct, buckets), kind="stable")] = totals[k]
        count = np.zeros(len(flat), np.int64)
        count[ends] = _others(number, doc[ends], total)
        seen = ends[count[ends] > 0]
        out[seen] = log_shares(count[seen], below[seen - 1], longest[seen] - (k - 1))
        below = count
    sums = np.zeros(len(sizes), np.int64)
    np.add.at(sums, doc, out)
    return sums


def score(docs: DataFrame, path: str | None = None, order: int = ORDER) -> DataFrame:
    """(doc_id, n_tokens, log10_score, log10_per_token) of every document."""
    if not 2 <= order <= 4:
        raise ValueError("the order must be from 2 to 4")
    spark = docs.sparkSession
    chunks = encoded(docs, path)
    single = unigrams(chunks)
    buckets = max(1, ceil(int(single.sum()) / BUCKET))
    shared = spark.sparkContext.broadcast(single)  # 512 kB
    joined = counted(ngrams(chunks, order, buckets), buckets)
    kinds = {"doc_ids": "array<long>", "lengths": "binary", "ids": "binary", "order": "int", "bucket": "long", "totals": "binary"}
    both = [t.select("chunk", *[F.col(c) if c in t.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()]) for t in (chunks, joined)]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(single.sum()) // (2 * CHUNK))
    met = both[0].unionByName(both[1]).repartition(parts, "chunk").sortWithinPartitions("chunk", F.col("order").asc_nulls_first(), "bucket")

    def solve(own: tuple, told: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
        names, lengths, ids = own
        sizes, flat, doc = _chunk(lengths, ids)
        totals = {k: np.concatenate(v).astype(np.int64) for k, v in told.items()}
        sums = chunk_scores(sizes, flat, doc, totals, shared.value, order, buckets)
        some = sizes > 0
        value = np.where(some, sums / UNIT, np.nan)
        return pa.RecordBatch.from_arrays(
            [pa.array(names, pa.int64()), pa.array(sizes), pa.array(value, mask=~some), pa.array(value / np.maximum(sizes, 1), mask=~some)], ["doc_id", "n_tokens", "log10_score", "log10_per_token"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: tuple = ()
        told: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for names, lengths, ids, k, totals in zip(*(batch.column(c).to_pylist() for c in ("doc_ids", "lengths", "ids", "order", "totals")), strict=True):
                if k is not None:
                    told.setdefault(k, []).append(unpacked(totals, "<u8"))
                    continue
                if own:
                    yield solve(own, told)
                own, told = (names, lengths, ids), {}
        if own:
            yield solve(own, told)
        give_back()

    return met.mapInArrow(run, "doc_id long, n_tokens long, log10_score double, log10_per_token double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
