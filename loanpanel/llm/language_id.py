"""Language identification by sparse multinomial logistic regression on character n-grams.

Letters of any script with their marks, in lower case, and other characters as single breaks give
hashed n-grams of code points; their TF-IDF vector, scaled to length one, is the input. Document
frequencies come from all training documents. Weights are trained with follow-the-regularised-leader and an elastic
net, so most are zero; one temperature is then fitted on training documents the weights have
not seen. Only the text is an input of a prediction.
"""

from __future__ import annotations

import math
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.shingles import mix
from loanpanel.operators.sampling import stratified_ids

BITS = 15  # hashed features
ORDERS = (1, 2, 3)
CHUNK = 1 << 20  # bytes of text turned to features at once, beyond which a single text may go


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray  # by feature
    weights: np.ndarray  # feature, language; most are zero
    bias: np.ndarray
    temperature: float


@cache
def _folded() -> np.ndarray:
    """By code point: letters as their lower case, marks as they are, all else a break (32)."""
    table = np.full(sys.maxunicode + 1, 32, np.uint32)
    for point in range(sys.maxunicode + 1):
        if unicodedata.category(c := chr(point))[0] in "LM":
            low = c.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def _points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le") + b" \0\0\0", "<u4")


def has_letter(text: str | None) -> bool:
    return text is not None and any(c.isalpha() for c in text)


def features(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number, feature, count) of every text with an n-gram; several texts are hashed at once."""
    table = _folded()
    first = 0
    while first < len(texts):
        last, size = first, 0
        while last < len(texts) and (last == first or size + len(texts[last]) <= CHUNK):
            size += len(texts[last]) + 1
            last += 1
        points = [_points(t) for t in texts[first:last]]
        data = table[np.concatenate(points)]
        owner = np.repeat(np.arange(first, last), [len(p) for p in points])
        keep = np.append(True, (data[1:] != 32) | (data[:-1] != 32) | (owner[1:] != owner[:-1]))  # one break in a row
        data, owner = data[keep].astype(np.uint64), owner[keep]
        grams, owners = [], []
        for n in ORDERS:
            code = np.full(max(0, len(data) - n + 1), n, np.uint64)
            for i in range(n):
                code = code * np.uint64(len(table)) + data[i:i + len(code)]
            whole = owner[:len(code)] == owner[n - 1:n - 1 + len(code)]
            grams.append((mix(code[whole]) >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[:len(code)][whole])
        bounds = [np.searchsorted(o, np.arange(first, last + 1)) for o in owners]
        for i in range(first, last):
            own = np.concatenate([g[b[i - first]:b[i - first + 1]] for g, b in zip(grams, bounds)])
            if len(own):
                count = np.bincount(own, minlength=1)
                feature = np.flatnonzero(count)
                yield i, feature, count[feature]
        first = last


def _vector(feature: np.ndarray, count: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = (1 + np.log(count)) * idf[feature]
    return value / max(math.sqrt(float(value @ value)), 1e-12)


def _encoded(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each feature occurs, and the number of texts with one.

    A task gives one row per feature it met; the sums have at most 2^BITS rows.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, texts = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for _, feature, _ in features(_encoded(batch)):
                seen[feature] += 1
                texts += 1
        own = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(own, -1)), pa.array(np.append(seen[own], texts))], ["feature", "n"])

    rows = docs.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    found = {r["feature"]: r["n"] for r in rows}
    total = found.pop(-1, 0)
    out = np.zeros(1 << BITS, np.int64)
    for feature, n in found.items():
        out[feature] = n
    return out, total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, passes: int, alpha: float = 0.5,
               beta: float = 1.0, l1: float = 0.02, l2: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from rows of (feature, value, class), in an order fixed by a seed.

    Per coordinate, z collects gradients less the proximal shift and n their squares; a weight
    is zero while abs(z) is at most l1. The bias is an unpenalised coordinate of value one.
    """
    z, n = np.zeros((2, (1 << BITS) + 1, classes))
    order = np.random.default_rng(7).permutation
    last = 1 << BITS

    def weights(at: np.ndarray) -> np.ndarray:
        penalty1, penalty2 = np.where(at == last, 0, l1)[:, None], np.where(at == last, 0, l2)[:, None]
        shrunk = np.sign(z[at]) * penalty1 - z[at]
        return np.where(np.abs(z[at]) <= penalty1, 0.0, shrunk / ((beta + np.sqrt(n[at])) / alpha + penalty2))

    for _ in range(passes):
        for k in order(len(rows)):
            feature, value, label = rows[k]
            at, x = np.append(feature, last), np.append(value, 1.0)
            w = weights(at)
            p = _softmax(x @ w)
            p[label] -= 1
            g = x[:, None] * p
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / alpha * w
            n[at] = new
    w = weights(np.arange(last + 1))
    return w[:last], w[last]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden-section search over its logarithm."""
    def loss(log_t: float) -> float:
        p = _softmax(logits / math.exp(log_t))
        return -float(np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean())

    low, high, ratio = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def train(docs: DataFrame, per_language: int = 1_000, passes: int = 3) -> Model:
    """A model from ``docs`` (doc_id, text, lang); rows without a language or text are left out.

    Document frequencies count every row. Weights and temperature are fitted on at most
    ``per_language`` documents of each language, the first in a hash order of the id; every fifth
    of them, in the order of ids, is set aside for the temperature. A null id is in no sample.
    """
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "text", "lang")
    seen, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + seen)) + 1
    # the sample has a bound, so its ids may be sent along and its texts collected
    ids = stratified_ids(docs.select("doc_id", "lang").distinct(), ["lang"], lambda sizes: sizes.withColumn(
        "quota", F.least("size", F.lit(per_language))), seed=11, key="doc_id").distinct()
    sample = docs.join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id", "lang"]).collect()
    sample = sorted(sample, key=lambda r: (r["lang"], r["doc_id"]))
    languages = sorted({r["lang"] for r in sample})
    rows = []
    texts = [r["text"].encode() for r in sample]
    for i, feature, count in features(texts):
        rows.append((feature, _vector(feature, count, idf), languages.index(sample[i]["lang"]), i))
    fitted = [r[:3] for r in rows if r[3] % 5]
    aside = [r[:3] for r in rows if r[3] % 5 == 0] or fitted
    weights, bias = train_ftrl(fitted, len(languages), passes)
    temperature = 1.0
    if aside and len(languages) > 1:
        logits = np.array([value @ weights[feature] + bias for feature, value, _ in aside])
        temperature = fit_temperature(logits, np.array([label for *_, label in aside]))
    return Model(languages, idf, weights, bias, temperature)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, lang_pred, score.

    A null text, and one without a letter, is ``und`` with score 0; so is every text if the model
    knows no language. Ties go to the first language by code point. Texts count whole; other
    columns are not read.
    """
    kept = dict(docs.dtypes)["doc_id"]
    # plain lists and arrays: a broadcast class would have to be installed on the executors
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.idf, model.weights, model.bias, model.temperature))

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in batches:
            texts = _encoded(batch)
            language: list[str] = ["und"] * len(texts)
            score = np.zeros(len(texts))
            if known.languages:
                for i, feature, count in features(texts):
                    if not has_letter(texts[i].decode("utf-8", "replace")):
                        continue
                    value = _vector(feature, count, known.idf)
                    p = _softmax((value @ known.weights[feature] + known.bias) / known.temperature)
                    best = int(p.argmax())
                    language[i], score[i] = known.languages[best], p[best]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(language), pa.array(score)],
                                             ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(classify, f"doc_id {kept}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Every fourth document by crc32 of the id as text; never trained on."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, **options) -> DataFrame:
    """Train on the documents that are not held out and predict all: doc_id, held_out, lang_pred, score.

    A null doc_id counts as not held out.
    """
    aside = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    model = train(docs.filter(~aside), **options)
    return predict(docs, model).select("doc_id", aside.alias("held_out"), "lang_pred", "score")
