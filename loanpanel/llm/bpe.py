"""Byte-pair encoding and decoding of whole texts, by numpy merge rounds over many words at once.

The vocabulary is a ``tokenizers`` file of the kind that ends words with a suffix. Texts are cut at
the strings of special tokens, normalised and split into words; each batch's new words are encoded
together. Their symbols lie in one flat array. A round looks up every pair of neighbours among the
sorted keys of all pairs that merge, finds each word's lowest rank, and merges that pair wherever
it stands in the word, until no word has a pair left. Words are remembered per task, up to a bound.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

VOCABULARY = "word_bpe_49k.json"
REMEMBERED = 200_000  # words kept per task, about 60 MB
NONE = np.iinfo(np.int64).max  # rank of a pair that does not merge
PLAIN = 0x250  # texts of code points below take the short way to their words


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    moved = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    return [chr(moved.get(b, b)) for b in range(256)]


def plain_words() -> re.Pattern:
    """The vocabulary's word pattern for lower-cased text of code points below ``PLAIN``."""
    def of(kind: str) -> str:
        return "".join(c for c in map(chr, range(PLAIN)) if unicodedata.category(c)[0] == kind)

    letters, numbers, space = map(re.escape, (of("L"), of("N"), "\t\n\x0b\x0c\r \x85\xa0"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{space}{letters}{numbers}]+")


class Codec:
    """Encoder and decoder of one task. ``vocabulary`` is a file name of the package or a full path."""

    def __init__(self, vocabulary: str = VOCABULARY):
        path = public_tokenizers.path(vocabulary)
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model, self.tokenizer = file["model"], Tokenizer.from_file(path)
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], np.int64)
        self.last = np.array([ids[s + suffix] for s in symbols], np.int64)
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        names = {**ids, **self.special}
        self.size = max(names.values()) + 1
        self.pieces = [""] * self.size
        for piece, i in names.items():
            self.pieces[i] = piece
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order
        self.merged = np.array([ids[a + b] for a, b in pairs], np.int64)  # by rank
        self.words, self.seen = plain_words(), {}

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the pairs, by binary search over the sorted keys."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def encode_words(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """Ids of non-empty words, given as UTF-8."""
        length = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbols, ends = self.inner[data], np.cumsum(length)
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), length)
        rank = np.full(len(symbols), NONE)  # of the pair of a symbol and the next one of its word
        same = owner[1:] == owner[:-1]
        rank[:-1][same] = self.rank_of(symbols[:-1][same], symbols[1:][same])
        found: list[tuple[int, ...]] = [()] * len(words)
        while len(symbols):
            start = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            size = np.diff(np.append(start, len(owner)))
            low = np.minimum.reduceat(rank, start)
            done = low == NONE
            if done.any():
                for word, a, n in zip(owner[start[done]].tolist(), start[done].tolist(), size[done].tolist()):
                    found[word] = tuple(symbols[a:a + n].tolist())
                stay = np.repeat(~done, size)
                symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
                low, size = low[~done], size[~done]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == np.repeat(low, size))
            # of pairs that overlap (a symbol repeated), every second one merges, from the left
            run = np.append(True, np.diff(at) != 1)
            at = at[(at - at[run][np.cumsum(run) - 1]) % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            stay = np.ones(len(symbols), bool)
            stay[at + 1] = False
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            at -= np.arange(len(at))  # one symbol less for every merge before
            near = np.unique(np.concatenate((at[at > 0] - 1, at)))
            inside = np.append(owner[1:] == owner[:-1], False)[near]
            rank[near[~inside]] = NONE
            near = near[inside]
            rank[near] = self.rank_of(symbols[near], symbols[near + 1])
        return found

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens; their bytes are those of UTF-8."""
        small = text.lower()
        if small.isascii() or max(small) < chr(PLAIN):  # composed already, so nothing else to normalise
            return self.words.findall(small)
        normal = self.tokenizer.normalizer.normalize_str(text)
        # the splitter shows bytes as characters: its spans say what a word was
        spans = [at for _, at in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)]
        return [normal[a:b] for a, b in spans]

    def parts(self, text: str) -> Iterator[list[str] | int]:
        """The words between special tokens, and the special tokens' ids."""
        for i, part in enumerate(self.at_special.split(text) if self.at_special else [text]):
            if i % 2:
                yield self.special[part]
            elif part:
                yield self.split(part)

    def encode(self, texts: Iterable[str | None]) -> list[list[int]]:
        """Ids of every text; null is empty."""
        split = [list(self.parts(t)) if t else [] for t in texts]
        fresh = {w for parts in split for p in parts if not isinstance(p, int) for w in p if w not in self.seen}
        if len(self.seen) + len(fresh) > REMEMBERED:
            self.seen.clear()
            fresh = {w for parts in split for p in parts if not isinstance(p, int) for w in p}
        if fresh:
            fresh = list(fresh)
            self.seen.update(zip(fresh, self.encode_words([w.encode() for w in fresh])))
        return [list(chain.from_iterable((p,) if isinstance(p, int) else chain.from_iterable(map(self.seen.__getitem__, p))
                                         for p in parts)) for parts in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The pieces joined by spaces, as the library decodes a vocabulary without a decoder.

        Special tokens stay; ids outside the vocabulary are left out.
        """
        return " ".join([self.pieces[i] for i in ids if 0 <= i < self.size and self.pieces[i]])


def slices(texts: pa.Array, most: int = 1 << 22) -> Iterator[pa.Array]:
    """Runs of texts of about ``most`` bytes, beyond which a single text may go."""
    size = np.cumsum([0 if t is None else t for t in pa.compute.binary_length(texts).to_pylist()])
    first = 0
    while first < len(texts):
        before = size[first - 1] if first else 0
        end = max(first + 1, int(np.searchsorted(size, before + most)))
        yield texts.slice(first, end - first)
        first = end


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, ids (array<int>) of every row; special tokens' strings become their ids.

    A null or empty text, or one of white space, has no ids. Texts count whole; rows that repeat
    are encoded each; other columns are not read. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            first = 0
            for texts in slices(batch.column("text")):
                ids = pa.array(codec.encode(texts.to_pylist()), pa.list_(pa.int32()))
                yield pa.record_batch([batch.column("doc_id").slice(first, len(texts)), ids], ["doc_id", "ids"])
                first += len(texts)

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode_ids(rows: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text of rows (doc_id, ids); null ids are none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        for batch in batches:
            texts = [codec.decode(ids.as_py() or ()) for ids in batch.column("ids")]
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: digests of each text's ids and of what they decode to.

    Encoded and decoded in one pass, so that no ids are shuffled or written. Edge cases as in
    ``encode_texts``.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(vocabulary)
        number = list(map(str, range(codec.size)))
        for batch in batches:
            counts, digests, decoded = [], [], []
            for texts in slices(batch.column("text")):
                for ids in codec.encode(texts.to_pylist()):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(" ".join([number[i] for i in ids]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            yield pa.record_batch([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()),
                                   pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
