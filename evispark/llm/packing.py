"""First-fit decreasing packing of tokenised documents into fixed sequences.

A document's ids, closed by one end id, are cut into full sequences and a rest.
Pieces go to randomised groups (a hash of document, start and row, so that rows without
an id, or repeated ones, are spread as well), whose size does not depend on the input's. Within a group they are placed from the longest to the
shortest into the first sequence with room, found by a tournament tree of the
sequences' free capacities in O(log n).

Edge cases: a null or empty text is a piece of the end id alone; documents with the
same id, repeated rows included, are packed one by one, ties in length go by
(doc_id, start, crc); an empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import codec, tokenizer_path
from .common import map_batches, table

CAPACITY = 2048
END_ID = 1
#: Documents whose pieces form a group, on average.
GROUP_DOCS = 4096

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class CapacityTree:
    """Tournament tree over bins: the winner of a match is the greater free capacity, so the first bin with room is one descent away."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, bins - 1).bit_length()
        self.free = [capacity] * (2 * self.size)

    def place(self, need: int) -> tuple[int, int]:
        """Takes ``need`` from the first bin with room; returns the bin and what was free in it."""
        free, node, size = self.free, 1, self.size
        if free[1] < need:
            raise ValueError("no bin has room")
        while node < size:
            node += node
            if free[node] < need:
                node += 1
        was, leaf = free[node], node
        free[node] = was - need
        while node > 1:
            node >>= 1
            a, b = free[2 * node], free[2 * node + 1]
            free[node] = a if a > b else b
        return leaf - size, was


def first_fit_decreasing(lengths: Sequence[int], capacity: int = CAPACITY) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; the lengths must fall."""
    full = 0
    while full < len(lengths) and lengths[full] >= capacity:
        full += 1
    bins, offsets = list(range(full)), [0] * full
    tree = CapacityTree(max(1, len(lengths) - full), capacity)
    for need in lengths[full:]:
        at, was = tree.place(int(need))
        bins.append(full + at)
        offsets.append(capacity - was)
    return bins, offsets


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """One row for each piece of each document."""
    path = path or tokenizer_path()
    end = END_ID.to_bytes(4, "little")

    def make():
        tool = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at, size, crc, total = [], [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = tool.encode(text) + end
                n = len(raw) // 4
                for start in range(0, n, capacity):
                    part = raw[4 * start : 4 * (start + capacity)]
                    ids.append(doc_id)
                    at.append(start)
                    size.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(n)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, at, size, crc, total)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, PIECE, warm=True)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces with the sequence and the offset where each lies."""
    groups = max(1, -(-docs.count() // group_docs))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(frame["length"].tolist(), capacity)
        return frame.assign(sequence_id=frame["pack_group"].to_numpy("int64") * (1 << 32) + np.asarray(bins, "int64"), offset=np.asarray(offsets, "int64")).drop(columns="pack_group")

    dealt = pieces(docs, capacity, path).withColumn("pack_group", F.pmod(F.xxhash64("doc_id", "start", F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("pack_group").applyInPandas(place, f"{PIECE}, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
