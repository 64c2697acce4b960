"""Token ids in training order, as binary shards of fixed-stride records.

Documents are cut into sequences of at most ``length`` ids. A keyed Feistel network with
cycle-walking permutes the sequence numbers 0..n-1; a sequence's image is its global slot.
Shards are ranges of slots, each a file ``shard-<k>.bin``. A record holds the number of ids as an unsigned 32-bit number and
the ids as unsigned 16-bit numbers, padded with zeros to the stride, so the record of a slot
is found by arithmetic and reading can resume at any slot. Number, key and rounds give the
slot without a table, and the inverse network gives the number of a slot.

Sequences are numbered in the order of (id, digest of the text, piece), by a sort of these keys
alone in ranges: a number is the position within the range plus the counts of the ranges before.
The slots follow from the rows alone, not from their partitions; rows that tie are equal. The ids
move twice, to their number and to their shard.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanpanel.llm import tokens
from loanpanel.llm.storage import shared_table
from loanpanel.session import scratch_path

HEADER = 4
READ_RECORDS = 1_024  # records read at once
ROUNDS = 6


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64 (fixed constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _network(x: np.ndarray, key: int, half: int, backwards: bool) -> np.ndarray:
    mask, bits = np.uint64((1 << half) - 1), np.uint64(half)
    left, right = x >> bits, x & mask
    for turn in (reversed(range(ROUNDS)) if backwards else range(ROUNDS)):
        salt = _mixed(np.array([(key * ROUNDS + turn) % 2**64], np.uint64))
        if backwards:
            left, right = right ^ (_mixed(left ^ salt) & mask), left
        else:
            left, right = right, left ^ (_mixed(right ^ salt) & mask)
    return (left << bits) | right


def permuted(numbers: np.ndarray, n: int, key: int, backwards: bool = False) -> np.ndarray:
    """The keyed permutation of 0..n-1 at ``numbers``, or its inverse.

    The network permutes a power of four of at least n; images of n and more are sent through
    it again, which ends since the walk follows a cycle that holds a number below n.
    """
    half = max(1, -(-max(n - 1, 1).bit_length() // 2))
    x = _network(numbers.astype(np.uint64), key, half, backwards)
    while (over := x >= np.uint64(n)).any():
        x[over] = _network(x[over], key, half, backwards)
    return x.astype(np.int64)


def token_sequences(docs: DataFrame, length: int = 1024, end_id: int = 2, vocabulary: str = "byte_bpe_50k.json",
                    rank_file: str | None = "byte_bpe_50k.tiktoken") -> DataFrame:
    """One row per sequence: task, nth (in the task), doc_id, digest, piece, n_ids, ids (unsigned 16-bit).

    A null or empty text is its end id alone. Ids must be below 65,536.
    """
    kept = dict(docs.dtypes)["doc_id"]
    end = np.array([end_id], "<u4").tobytes()

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task, nth = tokens.encoder(vocabulary, rank_file).whole, TaskContext.get().partitionId(), 0
        for batch in batches:
            of, piece, size, ids = [], [], [], []
            for i, text in tokens.texts(batch):
                own = np.frombuffer(encode(text) + end, "<u4")
                if own.max() > 0xFFFF:
                    raise ValueError("ids over 65,535 don't fit 16 bits")
                own = own.astype("<u2")
                for k, at in enumerate(range(0, len(own), length)):
                    part = own[at:at + length]
                    of.append(i)
                    piece.append(k)
                    size.append(len(part))
                    ids.append(part.tobytes())
            n = len(of)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, task), pa.int64()), pa.array(np.arange(nth, nth + n), pa.int64()),
                 *(batch.column(c).take(pa.array(of, pa.int32())) for c in ("doc_id", "digest")), pa.array(piece, pa.int32()),
                 pa.array(size, pa.int32()), pa.array(ids, pa.binary())],
                ["task", "nth", "doc_id", "digest", "piece", "n_ids", "ids"])
            nth += n

    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")
    return docs.select("doc_id", "text", digest).mapInArrow(
        cut_up, f"task long, nth long, doc_id {kept}, digest long, piece int, n_ids int, ids binary")


def training_order(docs: DataFrame, key: int = 42, length: int = 1024, per_shard: int = 8_192,
                   **options) -> tuple[DataFrame, int]:
    """Sequences with their slot and shard, and the number of sequences.

    Tokens are written once to the shared folder. Other columns of ``docs`` are not read;
    repeated rows are separate sequences; an empty table has none.
    """
    written = shared_table(token_sequences(docs, length, **options), "tokens")
    # the last keys part equal documents, which may be many
    order = ["doc_id", "digest", "piece", "task", "nth"]
    ranged = written.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()  # the range above the 33rd bit, the row in it below
    ranged = shared_table(ranged.select("task", "nth", F.shiftright(place, 33).alias("range"),
                                        place.bitwiseAND(2**33 - 1).alias("row")), "numbers")
    counts = ranged.groupBy("range").count()  # one row per range
    before = F.sum("count").over(Window.orderBy("range")) - F.col("count")
    counts = counts.select("range", before.alias("before"))
    n = ranged.count()

    @F.pandas_udf("long")
    def slot_of(numbers: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for number in numbers:
            yield pd.Series(permuted(number.to_numpy(np.int64), n, key))

    slots = (ranged.join(F.broadcast(counts), "range")  # as many rows as ranges
             .select("task", "nth", slot_of(F.col("before") + F.col("row")).alias("slot")))
    ordered = written.join(slots.hint("merge"), ["task", "nth"])
    return ordered.select("slot", F.floor(F.col("slot") / per_shard).alias("shard"), "doc_id", "piece",
                          "n_ids", "ids"), n


def token_shards(docs: DataFrame, key: int = 42, length: int = 1024, per_shard: int = 8_192,
                 per_block: int = 256, **options) -> DataFrame:
    """One row per block of ``per_block`` consecutive slots: shard, first_slot, n, stride, doc_ids, pieces, records.

    ``records`` is the concatenation of the block's records; ordered by first_slot, the blocks
    of a shard are its bytes; :func:`write_shards` makes files of them. Blocks bound what a task
    holds; a shard is never built in memory.
    """
    ordered, n = training_order(docs, key, length, per_shard, **options)
    shards = max(1, -(-n // per_shard))
    stride = HEADER + 2 * length
    kept = dict(ordered.dtypes)["doc_id"]
    rows = ordered.repartitionByRange(shards, "shard").sortWithinPartitions("slot")

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []

        def done() -> pa.RecordBatch:
            records = bytearray(stride * len(block))
            for i, (_, _, _, _, size, ids) in enumerate(block):
                records[i * stride:i * stride + HEADER] = int(size).to_bytes(HEADER, "little")
                records[i * stride + HEADER:i * stride + HEADER + len(ids)] = ids
            return pa.RecordBatch.from_arrays(
                [pa.array([block[0][1]], pa.int64()), pa.array([block[0][0]], pa.int64()), pa.array([len(block)], pa.int32()),
                 pa.array([stride], pa.int32()), pa.array([[b[2] for b in block]]), pa.array([[b[3] for b in block]], pa.list_(pa.int32())),
                 pa.array([bytes(records)], pa.binary())],
                ["shard", "first_slot", "n", "stride", "doc_ids", "pieces", "records"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("slot", "shard", "doc_id", "piece", "n_ids", "ids"))):
                if block and (len(block) == per_block or row[1] != block[0][1]):
                    yield done()
                    block = []
                block.append(row)
        if block:
            yield done()

    return rows.mapInArrow(lay_out, f"shard long, first_slot long, n int, stride int, doc_ids array<{kept}>, "
                                    "pieces array<int>, records binary")


@dataclass(frozen=True)
class Shards:
    """Written shards: their folder, ``manifest`` (a row per file) and ``index`` (a row per block)."""

    folder: str
    manifest: DataFrame
    index: DataFrame


def write_shards(docs: DataFrame, folder: str | None = None, **options) -> Shards:
    """Write the shards of ``docs`` as files below ``folder`` (else the cluster's shared folder).

    ``index``: the blocks, with the crc32 of their records instead of these. ``manifest``: shard,
    file, first_slot, n, stride, bytes. Both are Parquet tables in the folder. A task appends block
    by block, under a temporary name that becomes the shard's when it is whole; a repeated task
    writes the same bytes. An empty table has no shard. Options are those of :func:`token_shards`.
    """
    folder = (folder or scratch_path(docs.sparkSession, "shards")).rstrip("/")
    blocks = token_shards(docs, **options)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root)
        shard, out, temporary = None, None, ""

        def finish() -> None:
            if out is not None:
                out.close()
                files.move(temporary, f"{root}/{shard_name(shard)}")

        try:
            for batch in batches:
                crc = []
                for k, records in zip(batch.column("shard").to_pylist(), batch.column("records").to_pylist()):
                    if k != shard:
                        finish()
                        shard, temporary = k, f"{root}/_{shard_name(k)}.{uuid.uuid4().hex}"
                        out = files.open_output_stream(temporary)
                    out.write(records)
                    crc.append(zlib.crc32(records))
                kept = [c for c in batch.schema.names if c != "records"]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(crc, pa.int64())],
                                                 [*kept, "crc32"])
            finish()
            out = None
        finally:
            if out is not None:  # a task that failed
                out.close()
                files.delete_file(temporary)

    kinds = [f"{c} {kind}" for c, kind in blocks.dtypes if c != "records"]
    index = blocks.mapInArrow(write, ", ".join([*kinds, "crc32 long"]))
    index.write.mode("overwrite").parquet(f"{folder}/_index")
    session, name = docs.sparkSession, F.format_string("shard-%08d.bin", F.col("shard"))
    index = session.read.schema(index.schema).parquet(f"{folder}/_index")
    manifest = index.groupBy("shard", "stride").agg(F.min("first_slot").alias("first_slot"), F.sum("n").alias("n")).select(
        "shard", name.alias("file"), "first_slot", "n", "stride", (F.col("n") * F.col("stride")).alias("bytes"))
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return Shards(folder, session.read.schema(manifest.schema).parquet(f"{folder}/_manifest"), index)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def read_slots(spark: SparkSession, folder: str, first: int = 0, last: int | None = None) -> DataFrame:
    """``(slot, ids)`` of slots ``first`` to ``last`` (to the end if none), in slot order within a shard.

    Files outside are not opened; a file is read on from the first wanted record, whose place
    follows from its slot.
    """
    folder = folder.rstrip("/")
    manifest = spark.read.parquet(f"{folder}/_manifest").where(F.col("first_slot") + F.col("n") > first)
    if last is not None:
        manifest = manifest.where(F.col("first_slot") <= last)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for file, start, n, stride in zip(*(batch.column(c).to_pylist() for c in ("file", "first_slot", "n", "stride"))):
                at = max(first, start)
                end = start + n if last is None else min(start + n, last + 1)
                with files.open_input_file(f"{root}/{file}") as source:
                    source.seek((at - start) * stride)
                    for low in range(at, end, READ_RECORDS):
                        count = min(READ_RECORDS, end - low)
                        data = source.read(count * stride)
                        if len(data) != count * stride:
                            raise OSError(f"{file} is cut short")
                        ids = [np.frombuffer(data, "<u2", int.from_bytes(data[i:i + HEADER], "little"), i + HEADER)
                               .astype(np.int32) for i in range(0, len(data), stride)]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.arange(low, low + count), pa.int64()), pa.array(ids, pa.list_(pa.int32()))],
                            ["slot", "ids"])

    return (manifest.repartitionByRange("shard").sortWithinPartitions("shard")
            .mapInArrow(read, "slot long, ids array<int>"))
