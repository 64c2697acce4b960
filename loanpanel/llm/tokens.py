"""Token ids of whole documents by a public byte-level BPE vocabulary.

Ids are those of the ``tokenizers`` file. Its pre-tokeniser never joins text across a single
space, so a text without runs of spaces is the join of its space-separated units, and the ids
of a unit are remembered per task. Other texts, and those that hold a special token's string,
go to the tokenizer whole.
"""

from __future__ import annotations

import base64
import sys
from array import array
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import tiktoken
from tokenizers import Tokenizer

REMEMBERED = 300_000  # units kept per task, about 60 MB


def little_endian(ids: list[int]) -> bytes:
    numbers = array("I", ids)  # unsigned 32 bits
    if sys.byteorder == "big":
        numbers.byteswap()
    return numbers.tobytes()


class UnitIds(dict):
    """Unit behind a space -> its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, tokenizer: Tokenizer, ranks: tiktoken.Encoding | None):
        self.tokenizer, self.ranks = tokenizer, ranks
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(self, text: str) -> bytes:
        # the rank file gives the same ids faster; rare scripts and long runs stay with the tokenizer
        if self.ranks and len(text) < 200 and max(text, default="") < "ɐ":
            ids = self.ranks.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return little_endian(ids)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[unit] = self.encode(" " + unit)
        return ids

    def whole(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.special):
            return little_endian(self.tokenizer.encode(text, add_special_tokens=False).ids)
        first, *units = text.split(" ")
        return self.encode(first) + b"".join(map(self.__getitem__, units))


def encoder(vocabulary: str, rank_file: str | None) -> UnitIds:
    """An encoder for one task. ``vocabulary`` and ``rank_file`` are names or full paths."""
    ranks = None
    if rank_file:
        with open(public_tokenizers.path(rank_file), "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table,
                                  special_tokens={})
    return UnitIds(Tokenizer.from_file(public_tokenizers.path(vocabulary)), ranks)


def texts(batch: pa.RecordBatch) -> Iterator[tuple[int, str]]:
    """(row number, text) of a batch's column ``text``; null is empty."""
    for i, text in enumerate(batch.column("text")):
        yield i, text.as_py() or ""
