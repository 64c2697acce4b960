"""Quality rules: counts of words, symbols and repetition, and tokeniser fertility.

Fertility is measured word by word with a public vocabulary that falls back to bytes:
characters per token, the share of byte tokens, and the entropy of the document's token
distribution, less what its length explains. A document is compared with its group, its language
or, without one, its main script, among documents of about its length: it is rejected where a
measure lies outside the group's band, the middle half of all documents widened by a multiple
of its width. Bands come from all documents, equal texts of a group counted once, by sums and
mergeable quantile summaries.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.llm import shingles
from loanpanel.llm.storage import cut

SYMBOLS = b"#*$%&|<>"
REMEMBERED = 300_000  # words kept per task
WINDOW = 5  # words
MEASURES = ("chars_per_token", "byte_share", "token_entropy")
#: How many times the middle half's width a measure may lie outside of it.
WIDTHS = {"chars_per_token": 8.0, "byte_share": 8.0, "token_entropy": 4.0}
#: The least that counts as the middle half's width, whatever the documents: most groups have no byte token at all.
LEAST = {"chars_per_token": 0.05, "byte_share": 0.005, "token_entropy": 0.05}
CHARACTER = 4  # byte tokens of one character at most
#: First code point of a range and its script; other code points count for no script.
SCRIPTS = ((0x41, "latin"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"),
           (0x700, "other"), (0x900, "indic"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"),
           (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, ""), (0x3040, "japanese"), (0x3100, "other"),
           (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0x20000, "han"), (0x30000, "other"))


class WordPieces(dict):
    """Word -> its piece ids as unsigned 16-bit bytes."""

    def __init__(self, vocabulary: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(vocabulary))
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])

    def learn(self, words: set[bytes]) -> None:
        if len(self) + len(words) > REMEMBERED:
            self.clear()
        new = [w for w in words if w not in self]
        for word, ids in zip(new, self.model.encode([w.decode() for w in new], num_threads=1)):
            self[word] = np.array(ids, "<u2").tobytes()


def main_script(text: str) -> str:
    """The script of most letters of a text; ``none`` without one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    points = points[(points >= 0x80) | ((points | 32) - 97 < 26)]
    place = np.searchsorted([p for p, _ in SCRIPTS], points, "right") - 1
    count = np.bincount(place[place >= 0], minlength=len(SCRIPTS))
    total: dict[str, int] = {}
    for (_, script), n in zip(SCRIPTS, count.tolist()):
        total[script] = total.get(script, 0) + n
    total.pop("", None)
    best = max(total, key=lambda s: total[s])
    return best if total[best] else "none"


def repeated_words(hashes: np.ndarray) -> int:
    """Words within windows of ``WINDOW`` words that are found twice or more."""
    windows = shingles.chained(hashes, WINDOW)
    if len(windows) < 2:
        return 0
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    change = np.zeros(len(hashes) + 1, np.int64)
    found = order[np.append(same, False) | np.append(False, same)]
    np.add.at(change, found, 1)
    np.add.at(change, found + WINDOW, -1)
    return int((np.cumsum(change[:-1]) > 0).sum())


def measured(docs: DataFrame, group_col: str | None = "lang", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: doc_id, the base counts, the measures (null without a word), its group and a digest of its text."""
    kept = dict(docs.dtypes)["doc_id"]
    own = docs.select("doc_id", "text", (F.col(group_col).cast("string") if group_col else F.lit(None).cast("string")).alias("lang"))
    continuation = np.zeros(256, np.int64)
    continuation[0x80:0xC0] = 1
    symbol, space = np.zeros(256, np.int64), np.zeros(256, np.int64)
    symbol[list(SYMBOLS)] = 1
    space[[32, 9, 10, 11, 12, 13]] = 1
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens"]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = WordPieces(vocabulary)
        for batch in batches:
            texts = [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]
            found: dict[str, list] = {c: [] for c in (*counts, *MEASURES)}
            for part in shingles.chunks(texts):
                mine = [texts[i] for i in part]
                hashes, of = shingles.word_hashes(mine, fold=False)
                first = np.searchsorted(of, np.arange(len(mine) + 1))
                split = [t.split() for t in mine]
                pieces.learn({w for words in split for w in words})
                for i, (text, words) in enumerate(zip(mine, split)):
                    raw = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
                    lines = [x for x in text.split(b"\n") if x.strip()]
                    chars = int(len(text) - raw @ continuation - raw @ space)
                    ids = np.frombuffer(b"".join([pieces[w] for w in words]), "<u2")
                    n = len(ids)
                    found["n_words"].append(len(words))
                    found["word_chars"].append(chars)
                    found["n_symbols"].append(int(raw @ symbol))
                    found["n_dup_lines"].append(len(lines) - len(set(lines)))
                    found["n_repeat_words"].append(repeated_words(hashes[first[i]:first[i + 1]]))
                    found["n_tokens"].append(n)
                    found["chars_per_token"].append(chars / n if n else None)
                    found["byte_share"].append(float(pieces.is_byte[ids].mean()) if n else None)
                    found["token_entropy"].append(_entropy(ids) if n else None)
            groups = [lang if lang is not None else main_script(t.decode())
                      for lang, t in zip(batch.column("lang").to_pylist(), texts)]
            digests = [hashlib.blake2b(t, digest_size=16).digest() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(found[c], pa.int64()) for c in counts),
                 *(pa.array(found[c], pa.float64()) for c in MEASURES), pa.array(groups, pa.string()),
                 pa.array(digests, pa.binary())],
                ["doc_id", *counts, *MEASURES, "group", "digest"])

    return own.mapInArrow(measure, f"doc_id {kept}, {', '.join(f'{c} long' for c in counts)}, "
                                   f"{', '.join(f'{c} double' for c in MEASURES)}, group string, digest binary")


def _entropy(ids: np.ndarray) -> float:
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    return float(-(share * np.log(share)).sum())


def length_class(n_tokens: Column) -> Column:
    """Documents of the same length class differ by less than a factor of four."""
    return F.floor(F.log2(F.greatest(n_tokens, F.lit(1))) / 2)


def distinct_texts(rows: DataFrame) -> DataFrame:
    """Of ``rows`` with a word and a length class, one per text of a group: copies must not set its bands."""
    return (rows.filter("n_words > 0").groupBy("group", "length_class", "digest")
            .agg(*[F.first(c).alias(c) for c in ("n_tokens", *MEASURES)]))


def log_length() -> Column:
    return F.log(F.greatest("n_tokens", F.lit(1)))


def trends(texts: DataFrame) -> DataFrame:
    """Per group and length class: trend, the slope of token_entropy over log length."""
    slope = F.try_divide(F.covar_pop("token_entropy", log_length()), F.var_pop(log_length()))
    return texts.groupBy("group", "length_class").agg(F.coalesce(slope, F.lit(0.0)).alias("trend"))


def less_trend() -> Column:
    return F.col("token_entropy") - F.col("trend") * log_length()


def bands(texts: DataFrame, widths: dict[str, float], accuracy: int = 10_000) -> DataFrame:
    """Per group and length class: the trend, and the lowest and highest allowed value of every measure.

    token_entropy counts less its trend. Where the middle half is narrower than a hundredth of the
    median or than ``LEAST``, the larger of these counts as its width.
    """
    rows = texts.join(trends(texts), ["group", "length_class"]).withColumn("token_entropy", less_trend())
    out = rows.groupBy("group", "length_class").agg(
        F.first("trend").alias("trend"),
        *[F.percentile_approx(m, [0.25, 0.5, 0.75], accuracy).alias(m) for m in MEASURES])
    for m in MEASURES:
        low, middle, high = (F.get(m, F.lit(i)) for i in range(3))
        spread = widths[m] * F.greatest(high - low, F.abs(middle) / 100, F.lit(LEAST[m]))
        out = out.withColumn(f"{m}_low", low - spread).withColumn(f"{m}_high", high + spread)
    return out.drop(*MEASURES)


def judge(docs: DataFrame, widths: dict[str, float] | None = None, min_words: int = 10, max_repeat: int = 20,
          group_col: str | None = "lang", vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """One row per document: doc_id, the counts and measures, base_failed, fertility_failed, kept.

    The base rules reject a text of fewer than ``min_words`` words and one with more than
    ``max_repeat`` per cent of its words in repeated windows. A null, empty or blank text has no
    words and is rejected. Bands count equal texts of a group once; near copies count each. The byte
    tokens of a single character never reject. A group's band needs no least number of documents: a
    document alone in its group lies within its own band. Texts count whole; repeated rows are
    judged each; other columns are not read; an empty table gives no rows.
    """
    rows = cut(measured(docs, group_col, vocabulary).withColumn("length_class", length_class(F.col("n_tokens"))))
    limits = bands(cut(distinct_texts(rows)), {**WIDTHS, **(widths or {})})
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat)
    outside = F.lit(False)
    for m in MEASURES:
        above = F.col(m) > F.col(f"{m}_high")
        if m == "byte_share":  # a share says little of a short text
            above = above & (F.round(F.col(m) * F.col("n_tokens")) > CHARACTER)
        outside = outside | (F.col(m) < F.col(f"{m}_low")) | above
    rows = rows.join(limits, ["group", "length_class"], "left").withColumn("token_entropy", less_trend())
    rows = rows.withColumn("base_failed", base).withColumn("fertility_failed", F.coalesce(outside, F.lit(False)))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_tokens",
                       *MEASURES, "group", "base_failed", "fertility_failed",
                       (~F.col("base_failed") & ~F.col("fertility_failed")).alias("kept"))


def passing(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that the rules reject.

    Rows that share a doc_id stay if one of them passes.
    """
    verdict = judge(docs, **options).groupBy(F.col("doc_id").alias("_id")).agg(F.max("kept").alias("good"))
    bad = verdict.filter("not good").select("_id")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_id"]), "left_anti")
