"""Best-fit packing of documents into sequences, certified by lower bounds.

Documents become token ids with an end id; only those longer than a sequence are cut. Pieces
are dealt by hash to partitions of bounded size, each packed by best-fit decreasing. A
partition whose number of sequences equals a lower bound from dual feasible functions is
optimal and stays. The others keep their full sequences; the pieces in sequences with a gap
are exchanged (dealt anew among those partitions) and packed again, as long as that saves
sequences.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm import tokens
from loanpanel.llm.storage import cut


def tokenized_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 2,
                     vocabulary: str = "byte_bpe_50k.json", rank_file: str | None = "byte_bpe_50k.tiktoken",
                     with_ids: bool = True) -> DataFrame:
    """One row per piece: row, doc_id, piece, start, length, ids_crc32[, ids].

    ``ids`` are unsigned little-endian 32-bit numbers. A document over ``capacity`` ids is cut
    from its end, so only its first piece may be shorter. A null or empty text is its end id
    alone. Repeated rows are told apart by ``row``; other columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    kept = dict(rows.drop("text").dtypes)
    schema = (f"row long, doc_id {kept['doc_id']}, piece int, start long, length long, ids_crc32 long"
              + ", ids binary" * with_ids)
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(vocabulary, rank_file).whole
        for batch in batches:
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in tokens.texts(batch):
                own = encode(text) + end
                total = len(own) // 4
                at = 0
                until = (total - 1) % capacity + 1
                while at < total:
                    part = own[4 * at:4 * until]
                    of.append(i)
                    piece.append(-(-at // capacity))
                    start.append(at)
                    length.append(until - at)
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part)
                    at, until = until, until + capacity
            columns = [batch.column("row").take(pa.array(of, pa.int32())),
                       batch.column("doc_id").take(pa.array(of, pa.int32())), pa.array(piece, pa.int32()),
                       pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(cut_up, schema)


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every size, and the number of bins.

    Bins are kept by gap; a bit per gap finds the smallest one that fits.
    """
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, count = 0, 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_gaps >> size
        if fitting:
            gap = size + (fitting & -fitting).bit_length() - 1
            b = by_gap[gap].pop()
            if not by_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b = capacity, count
            count += 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > size:
            by_gap[gap - size].append(b)
            open_gaps |= 1 << (gap - size)
    return bins, offsets, count


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """The best bound of two families of dual feasible functions.

    For a threshold k: sizes over capacity - k count whole, those under k nothing, others as they
    are. For a k of 1 to 64: size / capacity is rounded down to the next multiple of 1 / k after
    multiplying by k + 1 (kept where that is whole).
    """
    count = np.bincount(sizes, minlength=capacity + 1)
    size = np.arange(capacity + 1)
    n, words = np.append(0, np.cumsum(count)), np.append(0, np.cumsum(count * size))
    total = int(words[-1])
    best = -(-total // capacity)
    for k in range(1, capacity // 2 + 1):
        whole = int(n[-1] - n[capacity - k + 1])
        rest = int(words[capacity - k + 1] - words[k])
        best = max(best, whole - (-rest // capacity))
    for k in range(1, 65):
        scaled = (k + 1) * size
        units = np.where(scaled % capacity == 0, size * k, scaled // capacity * capacity)  # of 1 / (k * capacity)
        best = max(best, -(-int((count * units).sum()) // (k * capacity)))
    return best


def pack(pieces: DataFrame, capacity: int = 1024, per_partition: int = 50_000, rounds: int = 4) -> DataFrame:
    """``pieces`` (row, piece, length and more, none longer than ``capacity``) with sequence_id, offset.

    Every round deals the open pieces to ``ceil(n / per_partition)`` partitions; one that is
    alone cannot exchange and stays as it is. (row, piece) must be unique.
    """
    schema = ("row long, piece int, length long, sequence_id long, offset long, is_open boolean, bins long, gap_bins long")

    def pack_partition(turn: int):
        def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True]).reset_index(drop=True)
            sizes = pdf["length"].to_numpy(np.int64)
            bins, offsets, count = best_fit_decreasing(sizes, capacity)
            certified = count == lower_bound(sizes, capacity)
            gap = np.bincount(bins, sizes, count) < capacity
            pdf["sequence_id"] = (turn << 58) + (int(key[0]) << 28) + bins
            pdf["offset"] = offsets
            pdf["is_open"] = False if certified else gap[bins]
            pdf["bins"] = (offsets == 0).astype(np.int64)  # one per sequence
            pdf["gap_bins"] = pdf["bins"] * pdf["is_open"]
            return pdf[["row", "piece", "length", "sequence_id", "offset", "is_open", "bins", "gap_bins"]]
        return run

    pieces = cut(pieces)
    todo, done, before = pieces.select("row", "piece", "length"), None, None
    for turn in range(rounds):
        count = todo.count()
        partitions = max(1, -(-count // per_partition))
        dealt = todo.withColumn("part", F.pmod(F.xxhash64(F.lit(turn), "row", "piece"), F.lit(partitions)))
        packed = cut(dealt.groupBy("part").applyInPandas(pack_partition(turn), schema))
        bins, gaps = packed.agg(F.sum("bins"), F.sum("gap_bins")).first()
        if before is not None and (bins or 0) >= before[1]:  # no better: the sequences of the last round stay
            done = done.unionByName(before[0])
            break
        if before is None:
            done = packed.filter(~F.col("is_open"))
        else:
            done = done.unionByName(packed.filter(~F.col("is_open")))
        before = (packed.filter("is_open"), gaps or 0)
        todo = before[0].select("row", "piece", "length")
        if not gaps or partitions == 1 or turn == rounds - 1:
            done = done.unionByName(before[0])
            break
    return pieces.join(done.select("row", "piece", "sequence_id", "offset"), ["row", "piece"])


def pack_documents(docs: DataFrame, capacity: int = 1024, with_ids: bool = True, **options) -> DataFrame:
    """The pieces of ``docs`` with sequence_id (any number) and offset in it.

    An empty table gives no rows; every document gives at least one piece, its end id.
    """
    pieces = tokenized_pieces(docs, capacity, with_ids=with_ids, **options)
    return pack(pieces, capacity).drop("row")


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: sequence_id, length and the pieces' doc_ids and ids in order."""
    part = F.struct("offset", "doc_id", "piece", "length", "ids")
    return (packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))
            .select("sequence_id", "length", F.col("parts.doc_id").alias("doc_ids"), F.col("parts.ids").alias("ids")))
