"""Language identification with a bit-sliced Bloom filter over character n-grams.

The filter is one array of machine words: word ``i`` holds bit ``i`` of the Bloom
filters of up to 64 languages, so that ANDing the words of an n-gram's positions
gives the set of all languages that contain it. A text's language has the most
n-grams by per-language popcounts, corrected for the false positives that the
filling of each language's slice lets expect.

An n-gram is three characters around a letter (lower-cased; other characters are
blanks), as one of 2**GRAM_BITS codes, so that counts and filter have a size that
does not grow with the corpus. A language contains an n-gram if it uses it at least
``ratio`` times as often, by share, as the language that uses it most: the same rule
at every size. With 0 every n-gram seen once counts; a large corpus, in which each
language quotes the others, has then nearly all n-grams in all languages.

Texts are handled PIECE characters at a time, long ones in pieces that overlap by the
characters around a letter, so memory does not depend on a text's length. Python gets
the texts alone; the other columns stay in the JVM. Counts are combined in a task, and
the driver gets one row for each code and 64 languages.

Edge cases: a null or empty text, or one without letters, is ``und`` with score 0, as
are all texts if nothing was learned; ties go to the first language in sorted order;
rows without id or language are not learned from; repeated rows count each time;
extra columns are kept, but for those named as the two results, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_caches, give_back, materialise, small_batches, table

UNKNOWN = "und"
GRAM_BITS = 20
#: Words of the filter and positions of an n-gram in it.
SLOTS, HASHES = 1 << 20, 3
RATIO = 0.2
#: The pipeline rejects texts whose score is below.
MIN_SCORE = 0.3
#: Characters handled at a time.
PIECE = 1 << 18
#: Languages whose counts a task holds at a time.
HELD = 16


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    out = np.zeros(0x110000, bool)
    out[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return out


def pieces(texts: list[str | None]) -> Iterator[tuple[list[str], list[int], list[int]]]:
    """Lower-cased texts in lots of about PIECE characters, with each one's number and how many characters at its end only surround others.

    A piece that continues a text begins with the character before it, in place of a blank.
    """
    lot, number, tail, size = [], [], [], 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        for at in range(0, len(low), PIECE):
            end = min(at + PIECE, len(low))
            lot.append((low[at - 1] if at else " ") + low[at : end + 1])
            number.append(i)
            tail.append(int(end < len(low)))
            size += end - at
            if size >= PIECE:
                yield lot, number, tail
                lot, number, tail, size = [], [], [], 0
    if lot:
        yield lot, number, tail


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the n-grams of all texts, one for each letter, and each one's text, a lot at a time."""
    for lot, number, tail in pieces(texts):
        c = np.frombuffer(" ".join([*lot, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[c]
        centre = letter.copy()
        begins = np.cumsum([0, *(len(p) + 1 for p in lot)])
        centre[begins[:-1]] = False  # the character before a piece
        centre[begins[1:][np.asarray(tail) > 0] - 2] = False  # the one after it
        c = np.where(letter, c, np.uint32(32)).astype(np.uint64)
        mid = np.flatnonzero(centre)
        h = c[mid - 1] * np.uint64(0x9E3779B97F4A7C15)
        h += c[mid] * np.uint64(0xC2B2AE3D27D4EB4F)
        h += c[mid + 1] * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        yield (h >> np.uint64(64 - GRAM_BITS)).astype(np.int64), np.asarray(number)[np.searchsorted(begins, mid, side="right") - 1]


def positions(codes: np.ndarray) -> list[np.ndarray]:
    """The filter words of each n-gram, by double hashing."""
    h = codes.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    one, two = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return [((one + np.uint64(i) * two) % np.uint64(SLOTS)).astype(np.int64) for i in range(HASHES)]


class Filter:
    """Bit-sliced Bloom filters of the languages, 64 to a slice."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.words = np.zeros((-(-len(languages) // 64), SLOTS), np.uint64)

    def add(self, codes: np.ndarray, part: np.ndarray, masks: np.ndarray) -> None:
        """Puts n-grams into the slice ``part`` for the languages of their masks."""
        for at in positions(codes):
            np.bitwise_or.at(self.words, (part, at), masks)

    def false_positives(self) -> np.ndarray:
        """Of each language, the probability that an n-gram it lacks passes."""
        fill = [((self.words[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(self.languages))]
        return np.asarray(fill) ** HASHES

    def hits(self, codes: np.ndarray, doc: np.ndarray, count: int) -> np.ndarray:
        """n-grams of each text by language."""
        at = positions(codes)
        out = np.zeros((count, len(self.languages)))
        for s, words in enumerate(self.words):
            mask = words[at[0]]
            for more in at[1:]:
                mask &= words[more]
            for bit in range(min(64, len(self.languages) - 64 * s)):
                out[:, 64 * s + bit] = np.bincount(doc, weights=(mask >> np.uint64(bit)) & np.uint64(1), minlength=count)
        return out

    def decide(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Language and score of each text."""
        count = len(texts)
        pred, score = np.full(count, UNKNOWN, object), np.zeros(count)
        if not self.languages or not count:
            return pred, score
        found, total = np.zeros((count, len(self.languages))), np.zeros(count)
        for codes, doc in grams(texts):
            low = int(doc.min()) if len(doc) else 0
            span = int(doc.max()) + 1 - low if len(doc) else 0
            total[low : low + span] += np.bincount(doc - low, minlength=span)
            found[low : low + span] += self.hits(codes, doc - low, span)
        wrong = self.false_positives()
        right = (found - total[:, None] * wrong) / np.maximum(1 - wrong, 1e-9)
        best = right.argmax(1)
        some = total > 0
        pred[some] = np.asarray(self.languages, object)[best[some]]
        score[some] = np.clip(right[some, best[some]] / total[some], 0, 1)
        return pred, score


def held_out() -> F.Column:
    """Whether a document is kept from learning; a null id is neither learned from nor held out."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0


def counts(training: DataFrame) -> DataFrame:
    """(lang, code, n) of (text, lang) rows: a task adds up its counts, at most 2**GRAM_BITS for each of HELD languages at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_caches()
        held: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for lang, n in held.items():
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], ["lang", "code", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lang in sorted(set(langs)):
                if lang not in held:
                    if len(held) == HELD:
                        yield from told()
                    held[lang] = np.zeros(1 << GRAM_BITS, np.int64)
                rows = pa.array([i for i, x in enumerate(langs) if x == lang])
                for codes, _ in grams(batch.column("text").take(rows).to_pylist()):
                    held[lang] += np.bincount(codes, minlength=1 << GRAM_BITS)
        yield from told()

    small_batches(training.sparkSession)
    return training.select("text", "lang").mapInArrow(run, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def learn(training: DataFrame, ratio: float = RATIO) -> Filter:
    """The filter of (text, lang) rows. The driver gets at most 2**GRAM_BITS rows for each 64 languages."""
    spark = training.sparkSession
    languages = training.select("lang").distinct().count()
    each = materialise(counts(training), "gram-counts", languages << GRAM_BITS)
    totals = sorted(tuple(r) for r in each.groupBy("lang").agg(F.sum("n").alias("total")).collect())  # a row a language
    out = Filter([lang for lang, _ in totals])
    if not totals:
        return out
    numbered = spark.createDataFrame([(lang, i, total) for i, (lang, total) in enumerate(totals)], "lang string, number int, total long")
    share = each.join(F.broadcast(numbered), "lang").select("code", "number", (F.col("n") / F.col("total")).alias("share"))
    most = share.groupBy("code").agg(F.max("share").alias("most"))
    kept = share.join(most, "code").where(F.col("share") >= ratio * F.col("most"))
    bit = F.expr("shiftleft(1L, number % 64)")
    rows = kept.groupBy("code", F.expr("number div 64").alias("part")).agg(F.bit_or(bit).alias("mask")).toPandas()
    out.add(rows["code"].to_numpy("int64"), rows["part"].to_numpy("int64"), rows["mask"].to_numpy("int64").view(np.uint64))
    return out


def predict(docs: DataFrame, learned: Filter, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """The documents' columns and the two results, which replace columns of these names; lang is not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast((learned.languages, learned.words))  # 8 MB for each 64 languages

    @F.arrow_udf("lang string, score double")
    def decide(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        drop_caches()
        own = Filter.__new__(Filter)
        own.languages, own.words = shared.value
        for texts in batches:
            langs, scores = own.decide(texts.to_pylist())
            give_back()
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], ["lang", "score"])

    small_batches(docs.sparkSession)
    inner = "_language"
    while inner in docs.columns:
        inner += "_"
    kept = [c for c in docs.columns if c not in (pred, score)]
    return docs.select(*kept, decide(docs["text"]).alias(inner)).select(*kept, F.col(f"{inner}.lang").alias(pred), F.col(f"{inner}.score").alias(score))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), learn(training_rows(docs)))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language is known well enough."""
    pred, score = "_lang_pred", "_lang_score"
    while pred in docs.columns or score in docs.columns:
        pred, score = pred + "_", score + "_"
    found = predict(docs, learn(training_rows(docs)), pred, score)
    return found.where((F.col(pred) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
