"""How far the sources of a language differ in their words: exact integer divergences of every pair.

Terms are runs of letters of a-z and A-Z and of code points from 128 up, A-Z lower-cased. A
language keeps the terms of at least ``min_docs`` of its documents. What a term adds to the
divergence of two sources depends only on how often each source has it, so the terms are grouped by
their pair of counts: in a block of terms, one-hot indicator columns for every (source, count) are
multiplied by their transpose, which gives the joint table of every two sources; the blocks' tables
are summed, and each cell is priced once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.storage import cut, shared_table

SCALE = 1_000_000_000
PENDING = 300_000  # counted terms a task holds before it hands them on
BLOCK_CELLS = 400_000  # counts of a block of terms, on average
BLOCK_TERMS = 8_192  # terms of a block, on average; counts of cells stay exact in single precision
COLUMNS = 1_024  # indicator columns multiplied at once

# bytes of terms stay (A-Z as a-z), all others part them; bytes from 128 belong to code points from 128
_TERM_BYTES = bytes(b if b >= 128 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents): counts to be summed, whole texts.

    Also a row with a null term for each (lang, source) of a task, so that groups without terms
    are there. Null lang, source and text are empty.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def counted() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in totals.items():
                terms = list(n)
                yield pa.record_batch([pa.repeat(pa.scalar(lang, pa.string()), len(terms) + 1), pa.repeat(pa.scalar(source, pa.string()), len(terms) + 1),
                                       pa.array([*terms, None], pa.binary()).cast(pa.string()),
                                       pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, terms), 0], pa.int64())],
                                      ["lang", "source", "term", "n", "docs"])
            totals.clear()

        held = 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
                if (lang, source) not in totals:
                    totals[lang, source] = Counter(), Counter()
                n, docs = totals[lang, source]
                terms = (text.as_py() or b"").translate(_TERM_BYTES).split()
                held -= len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n)
                if held >= PENDING:
                    yield from counted()
                    held = 0
        yield from counted()

    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return known.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(docs: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """The counts of kept terms, and the groups.

    Counts: lang, source, term, n, lang_n (of the language). Groups: lang, source, g (number in
    the language), groups, total (the group's counts), lang_total, terms (V). Both are written once.
    """
    counts = term_counts(docs).repartition("lang", "term").groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row per source
    counts = counts.withColumn("lang_n", F.sum("n").over(term)).withColumn("in_docs", F.sum("docs").over(term))
    counts = shared_table(counts.filter(F.col("term").isNull() | (F.col("in_docs") >= min_docs)).drop("docs", "in_docs"), "terms")
    kept = counts.filter("term is not null")
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    size = kept.groupBy("lang", "term").agg(F.lit(1).alias("one")).groupBy("lang").agg(F.count("*").alias("terms"))
    lang = Window.partitionBy("lang")  # a row per source
    groups = (groups.withColumn("g", F.row_number().over(lang.orderBy("source")) - 1).withColumn("groups", F.count("*").over(lang).cast("int"))
              .withColumn("lang_total", F.sum("total").over(lang)).join(size, "lang", "left").fillna(0, ["terms"]))
    return kept, cut(groups)


def share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for counts beyond 64-bit products."""
    top = (n + 1).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.try_add(F.call_function("div", top, (total + terms).cast("decimal(20,0)")), F.lit(1)).cast("long")


def price(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q); both are at most SCALE + 1, so the square fits 64 bits."""
    return F.call_function("div", (p - q) * (p - q), q)


def joint_tables(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, g, a, h, b, n: how many kept terms source g has a times and source h has b times, g < h.

    Terms are dealt to blocks by hash. In a block, the columns of source g are its counts there, 0
    included, so all n of a pair of sources sum to the number of kept terms.
    """
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.ceil(F.col("terms") * F.col("groups") / BLOCK_CELLS))
    rows = (kept.join(groups.select("lang", "source", "g", "groups", "terms"), ["lang", "source"])
            .select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), F.xxhash64("term").alias("key"),
                    F.xxhash64(F.lit(1), "term").alias("key2"), "g", "groups", "n"))

    def product(block: pd.DataFrame) -> pd.DataFrame:
        term = block.groupby(["key", "key2"], sort=False).ngroup().to_numpy()
        terms, sources = int(term.max()) + 1, int(block["groups"].iloc[0])
        level = np.zeros((sources, terms), np.int64)
        level[block["g"].to_numpy(), term] = block["n"].to_numpy()
        pair = np.stack((np.repeat(np.arange(sources), terms), level.ravel()))
        columns, column = np.unique(pair, axis=1, return_inverse=True)  # (source, count), in order of the source
        column = column.reshape(sources, terms)
        found = []

        def indicators(first: int) -> np.ndarray:
            """One-hot columns first to first + COLUMNS, as [column, term]."""
            last = min(first + COLUMNS, columns.shape[1])
            low, high = columns[0, first], columns[0, last - 1] + 1
            one_hot = np.zeros((last - first, terms), np.float32)
            at = column[low:high] - first
            inside = (at >= 0) & (at < last - first)
            one_hot[at[inside], np.nonzero(inside)[1]] = 1
            return one_hot

        for i in range(0, columns.shape[1], COLUMNS):
            left = indicators(i)
            for j in range(i, columns.shape[1], COLUMNS):
                right = left if i == j else indicators(j)
                table = left @ right.T  # whole numbers up to the number of terms: exact in single precision
                x, y = np.nonzero(table)
                ours, theirs = columns[:, i + x], columns[:, j + y]
                ordered = ours[0] < theirs[0]
                found.append(np.stack((ours[0], ours[1], theirs[0], theirs[1], table[x, y].astype(np.int64)))[:, ordered])
        cells = np.concatenate(found, axis=1)
        out = pd.DataFrame(dict(zip("gahbn", cells)))
        out.insert(0, "lang", block["lang"].iloc[0])
        return out

    cells = rows.groupBy("lang", "block").applyInPandas(product, "lang string, g int, a long, h int, b long, n long")
    return cells.groupBy("lang", "g", "a", "h", "b").agg(F.sum("n").alias("n"))


def pair_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (the other source), value, both ways for all two sources of a language."""
    def side(name: str, *extra: str) -> DataFrame:
        cols = [F.col("g").alias(name), F.col("source").alias(f"source_{name}"), F.col("total").alias(f"total_{name}")]
        return groups.select("lang", *cols, *extra)

    cells = (joint_tables(kept, groups).join(side("g", "terms"), ["lang", "g"]).join(side("h"), ["lang", "h"])
             .withColumn("p", share(F.col("a"), F.col("total_g"), F.col("terms")))
             .withColumn("q", share(F.col("b"), F.col("total_h"), F.col("terms"))))
    priced = {s: F.sum(F.col("n").cast("decimal(20,0)") * price(F.col(x), F.col(y)).cast("decimal(18,0)")).cast("long")
              for s, x, y in (("there", "p", "q"), ("back", "q", "p"))}
    sums = cells.groupBy("lang", "g", "h").agg(*[v.alias(s) for s, v in priced.items()])
    both = sums.select("lang", F.inline(F.array(F.struct("g", "h", F.col("there").alias("value")),
                                                F.struct(F.col("h").alias("g"), F.col("g").alias("h"), F.col("back").alias("value")))))
    # every pair of a language's sources is a row of the result
    every = side("g").join(side("h"), "lang").filter("g <> h").select("lang", "g", "h", "source_g", "source_h")
    return every.join(both, ["lang", "g", "h"], "left").select(
        "lang", F.col("source_g").alias("source"), F.col("source_h").alias("item"),
        F.coalesce("value", F.lit(0).cast("long")).alias("value"))


def term_divergences(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (a term that the source has more often than its language), value."""
    rows = (kept.join(groups, ["lang", "source"]).filter("n > 0")
            .withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
            .withColumn("q", share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))).filter("p > q"))
    return rows.select("lang", "source", F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of each source, and its most telling terms.

    Ranks go by value, highest first, then item in UTF-8 order; all other sources are listed, and
    the first ``top_terms`` terms. Null lang, source and text are empty strings; a source without
    terms has rows for its pairs only; a language without kept terms has pairs of value 0. Every row
    is a document, repeated ids too. Other columns are not read. An empty table gives no rows.
    """
    kept, groups = kept_counts(docs, min_docs)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_divergences(kept, groups).withColumn("rank", F.row_number().over(order))
    terms = term_divergences(kept, groups).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)
    return pairs.withColumn("part", F.lit("pair")).unionByName(terms.withColumn("part", F.lit("term"))).select(
        "lang", "source", "part", "item", "value", "rank")
