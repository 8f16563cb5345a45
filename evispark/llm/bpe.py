"""Exact BPE by per-prefix dynamic programming.

For each prefix of a word there is exactly one token that can end the prefix's
encoding. An automaton over the vocabulary yields all tokens that are suffixes of
the prefix; the one that is compatible with the token stored for the shorter
prefix is stored. Two adjacent tokens are compatible when undoing their merges,
newest first, never meets a merge across their border that BPE would have done
earlier. Following the stored tokens backwards gives the word's ids.

Edge cases: a null or empty text has no ids; strings of special tokens in a text
stand for those tokens, as in the tokenizers library; repeated rows are encoded
independently; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterable
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import cached, map_batches, table

TOKENIZER = "word_bpe_49k.json"
#: Entries of a worker's caches; a full cache is emptied.
CACHE = 600_000
#: Added to the code point of a word's last byte symbol, to tell word ends apart.
END = 0x10000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(extra)) for b in range(256)]


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers JSON file whose merges have rising ids."""

    def __init__(self, path: str):
        import ahocorasick

        spec = json.loads(Path(path).read_text())
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.symbols = byte_symbols()  # as str.translate takes it, for bytes read as latin-1
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces: list[str] = [""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for piece, i in [*vocab.items(), *self.added.items()]:
            self.pieces[i] = piece
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))))
        self.special_hint = "<|" if all(x.startswith("<|") for x in self.added) else ""

        n = len(self.pieces)
        self.left, self.right, self.pair = list(range(n)), list(range(n)), {}
        for merge in model["merges"]:
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.left[z], self.right[z] = x, y
            self.pair[x, y] = z
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocab.items():
            word, ends = (piece.removesuffix(self.suffix), True) if piece.endswith(self.suffix) and piece != self.suffix else (piece, False)
            key = word[:-1] + chr(ord(word[-1]) + END) if ends else word
            self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.words: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(n)]

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b apart when they stand side by side."""
        key = (a, b)
        if (known := self.fits.get(key)) is not None:
            return known
        if len(self.fits) >= 4 * CACHE:
            self.fits.clear()
        left, right, pair = self.left, self.right, self.pair
        limit, ok = len(self.pieces) + 1, True
        while True:
            merged = pair.get((a, b))
            if merged is not None and merged < limit:
                ok = False
                break
            # undo the newer of the two tokens' last merges, as long as there is one
            if a > b:
                if left[a] != a:
                    limit, a = a, right[a]
                elif left[b] != b:
                    limit, b = b + 1, left[b]
                else:
                    break
            elif left[b] != b:
                limit, b = b + 1, left[b]
            elif left[a] != a:
                limit, a = a, right[a]
            else:
                break
        self.fits[key] = ok
        return ok

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of a word of byte symbols whose last symbol bears the word end."""
        n, fits = len(word), self.fits
        last, size = [-1] * n, [0] * n
        for end, (length, token) in self.automaton.iter(word):  # of one end the longest come first
            if last[end] >= 0:
                continue
            if length <= end:
                before = last[end - length]
                ok = fits.get((before, token))
                if ok is None:
                    ok = self.compatible(before, token)
                if not ok:
                    continue
            last[end], size[end] = token, length
        out, at = [], n - 1
        while at >= 0:
            out.append(last[at])
            at -= size[at]
        out.reverse()
        return out

    def encode_word(self, word: str) -> bytes:
        """Little-endian ids of one word that the pre-tokenizer cut, lower-cased already."""
        ids = self.words.get(word)
        if ids is None:
            symbols = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
            if symbols is word and not word.isprintable():
                symbols = word.translate(self.symbols)
            found = self.encode_symbols(symbols[:-1] + chr(ord(symbols[-1]) + END))
            ids = self.raw[found[0]] if len(found) == 1 else b"".join([self.raw[i] for i in found])
            if len(self.words) >= CACHE:
                self.words.clear()
            self.words[word] = ids
        return ids

    def encode_chunk(self, chunk: str) -> bytes:
        """Little-endian ids of a piece of text without special tokens."""
        if not chunk.isascii():
            chunk = unicodedata.normalize("NFC", chunk).replace("Σ", "σ")
        lowered = chunk.lower()
        if lowered.isalpha():
            return self.encode_word(lowered)
        return b"".join(map(self.encode_word, self.pattern.findall(lowered)))


#: Signs that are a word of their own after letters, whatever follows.
SIGNS = frozenset(".,;:!?")


class ChunkCache(dict):
    """Little-endian ids of white-space-free chunks, encoded when first met."""

    def __init__(self, bpe: WordBpe):
        super().__init__()
        self.bpe = bpe

    def __missing__(self, chunk: str) -> bytes:
        core, last = chunk[:-1], chunk[-1:]
        out = self[core] + self[last] if last in SIGNS and core.isalpha() else self.bpe.encode_chunk(chunk)
        if len(self) >= CACHE:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = out
        return out


#: str.split() also cuts at these four, which the vocabulary's pattern does not count as white space.
NOT_SPACE = regex.compile("[\x1c-\x1f]")
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")


class TextCodec:
    """Encodes whole texts to little-endian 32-bit ids and decodes them again."""

    def __init__(self, path: str):
        self.bpe = WordBpe(path)
        self.chunks = ChunkCache(self.bpe)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.bpe.special_hint in text:
            out, at = [], 0
            for m in self.bpe.special.finditer(text):
                out += [self._plain(text[at : m.start()]), self.bpe.added[m[0]].to_bytes(4, "little")]
                at = m.end()
            return b"".join([*out, self._plain(text[at:])])
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        chunks = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        return b"".join(map(self.chunks.__getitem__, chunks))

    def decode(self, ids: Iterable[int]) -> str:
        """As the vocabulary has no decoder, its pieces are joined by spaces."""
        return " ".join(map(self.bpe.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> TextCodec:
    """One codec per worker process and vocabulary."""
    return TextCodec(path)


cached(codec.cache_clear)


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>) of every text."""
    path = path or tokenizer_path()

    def make():
        tool = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            coded = [np.frombuffer(tool.encode(t), "<i4") for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(coded, pa.list_(pa.int32()))], ["doc_id", "ids"])

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, ids array<int>", warm=True)


def decode_documents(ids: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of every row of ids."""
    path = path or tokenizer_path()

    def make():
        tool = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [None if x is None else tool.decode(x) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

        return work

    return map_batches(ids.select("doc_id", "ids"), make, "doc_id long, text string", None, warm=True)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Digests of the ids of every text and of the text decoded from them."""
    path = path or tokenizer_path()

    def make():
        tool = codec(path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text").to_pylist():
                raw = tool.encode(text)
                counts.append(len(raw) // 4)
                ids_sha.append(hashlib.sha256(raw).hexdigest())
                text_sha.append(hashlib.sha256(tool.decode(np.frombuffer(raw, "<u4").tolist()).encode()).hexdigest())
            return pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

        return work

    return map_batches(docs.select("doc_id", "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", warm=True)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
