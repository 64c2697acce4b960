"""Trie of conversation prefixes from vertical bitmaps.

Conversations are rebuilt first: some take their first turns from the conversation that opens
their family. Turns then lie in tiles, a shard of conversations by a segment of positions. A tile
maps every (position, turn) to the bitset of its conversations; going down from the prefixes that
enter the tile, a node's bitset meets the bitset of a member's next turn, which is a child, until
no member is left. Nodes of all tiles are summed by their prefix, a running hash of its turns.

Sums over subtrees need no walk of the whole trie: a node counts for its smallest member, in whose
tile it is, so every tile sums what its nodes own, and the tiles' sums of a prefix add up. What lies
in deeper segments enters as one sum per conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.storage import cut, shared_table

FAMILY = 20  # conversations c - c % FAMILY lend their first turns to the others
MOST_LENT = 3
RANGE_ROWS = 100_000  # turns of a range of conversations, on average
SEGMENT = 1_024  # positions of a tile
MEMBERS = 1_024  # conversations of a shard: bits held together
SHARDS = 1 << 20  # of a range, so that shards are numbered in the order of their conversations
WORD = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_key (128 bits of role and text), words, part, of rows with a conv_id.

    Ordered by turn, null first; ties by the digest of role and text. ``part`` numbers ranges of
    (conv_id, turn), so a conversation of very many turns lies in several.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, F.lit(":"), text)))
    rows = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("turn_key"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    parts = max(1, -(-conversations.count() // RANGE_ROWS))
    order = ["conv_id", F.asc_nulls_first("turn"), "turn_key"]
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("turn"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Place among the rows of the conversation in this partition."""
        last, before = None, 0
        for batch in batches:
            conv = batch.column("conv_id").to_numpy()
            if not len(conv):
                continue
            start = np.append(True, conv[1:] != conv[:-1])
            place = np.arange(1, len(conv) + 1) - np.flatnonzero(start)[np.cumsum(start) - 1]
            if conv[0] == last:
                place[:np.argmin(conv == last) or len(conv)] += before
            last, before = conv[-1], place[-1]
            yield pa.record_batch([*batch.columns, pa.array(place, pa.int64())], [*batch.schema.names, "pos"])

    rows = rows.withColumn("part", F.spark_partition_id()).mapInArrow(
        numbered, "conv_id long, turn_key binary, words long, part int, pos long")
    # at most two conversations of a part can go on in another one
    edges = (rows.groupBy("part").agg(F.array(F.min("conv_id"), F.max("conv_id")).alias("ends"))
             .select("part", F.explode("ends").alias("conv_id")).distinct())
    across = edges.groupBy("conv_id").agg(F.count("*").alias("parts")).filter("parts > 1").select("conv_id")
    sizes = rows.join(F.broadcast(across), "conv_id").groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offset = sizes.select("conv_id", "part", earlier.alias("before")).filter("before is not null")
    return rows.join(F.broadcast(offset), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "turn_key", "words", "part")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt turns and conversations of :func:`ordered_turns`.

    Turns: conv_id, pos, turn_key, words, shard, length. Conversations: conv_id, shard, length. A
    conversation's first h = crc32(conv_id) % 4 turns are replaced by as many of the first of its
    family, or by all that there are.
    """
    head = turns.filter((F.col("pos") <= MOST_LENT) & (F.col("conv_id") % FAMILY == 0))
    lenders = head.groupBy(F.col("conv_id").alias("base")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "turn_key", "words"))).alias("lent"))  # at most three
    lend = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_LENT + 1)
    convs = (turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("part"))
             .withColumn("h", lend).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
             .join(lenders, "base", "left").withColumn("lent", F.coalesce(F.slice("lent", F.lit(1), F.col("h").cast("int")), F.array()))
             .withColumn("taken", F.size("lent")).withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    place = F.row_number().over(Window.partitionBy("part").orderBy("conv_id")) - 1  # a range's conversations
    convs = convs.withColumn("shard", F.col("part").cast("long") * SHARDS + F.floor(place / MEMBERS))
    convs = cut(convs.select("conv_id", "shard", "length", "h", "taken", "lent"))
    lent = convs.select("conv_id", "shard", "length", F.inline("lent"))
    own = (turns.drop("part").join(convs.drop("lent"), "conv_id").filter("pos > h")
           .withColumn("pos", F.col("pos") - F.col("h") + F.col("taken")))
    columns = ["conv_id", "pos", "turn_key", "words", "shard", "length"]
    return lent.select(columns).unionByName(own.select(columns)), convs.select("conv_id", "shard", "length")


def tiles(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of all tiles, and starts: conv_id, shard, segment (from 1), start1, start2.

    A row is a turn with segment, step1, step2 (hash of turn and position), start1 and start2, the
    running hash of the conversation's turns in earlier segments, 0 for the first. Conversations
    without turns have a row at position 0.
    """
    step = [F.xxhash64(F.lit(seed), "pos", "turn_key").alias(f"step{seed}") for seed in (1, 2)]
    none = convs.filter("length = 0").select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_key"),
                                             F.lit(0).cast("long").alias("words"), "shard", "length")
    rows = turns.unionByName(none).select("*", *step, F.floor((F.greatest("pos", F.lit(1)) - 1) / SEGMENT).alias("segment"))
    long = rows.filter(F.col("length") > SEGMENT).groupBy("conv_id", "shard", "segment").agg(
        *[F.bit_xor(f"step{s}").alias(f"step{s}") for s in (1, 2)])
    before = Window.partitionBy("conv_id").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)  # a row per segment
    starts = cut(long.select("conv_id", "shard", "segment", *[F.bit_xor(f"step{s}").over(before).alias(f"start{s}") for s in (1, 2)])
                 .filter("segment > 0"))
    zero = F.lit(0).cast("long")
    rows = rows.join(starts.drop("shard"), ["conv_id", "segment"], "left").withColumns(
        {f"start{s}": F.coalesce(f"start{s}", zero) for s in (1, 2)})
    return rows, starts


NODE = {"shard": "long", "segment": "long", "depth": "long", "key1": "long", "key2": "long", "parent1": "long", "parent2": "long",
        "low": "long", "n": "long", "words": "long", "ends": "binary"}


def _nodes_of(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a tile; low is the smallest member, n the number of members.

    ``ends``: the conversations that end at the node, ascending, as little-endian 64-bit numbers.
    """
    shard, segment = int(rows["shard"].iloc[0]), int(rows["segment"].iloc[0])
    ids, bit = np.unique(rows["conv_id"].to_numpy(), return_inverse=True)
    ids = ids.tolist()
    index: dict[tuple[int, bytes], int] = {}  # (position, turn) -> bitset of conversations
    turn_at: dict[tuple[int, int], tuple] = {}  # (position, conversation) -> its turn
    starts: dict[tuple[int, int], int] = {}  # prefix that enters the tile -> bitset
    ends_at: dict[int, int] = {}  # depth -> bitset of the conversations of that length
    columns = ("pos", "turn_key", "words", "step1", "step2", "start1", "start2", "length")
    for i, pos, turn, words, step1, step2, start1, start2, length in zip(bit.tolist(), *(rows[c].tolist() for c in columns)):
        mine = 1 << i
        starts[start1, start2] = starts.get((start1, start2), 0) | mine
        ends_at[length] = ends_at.get(length, 0) | mine
        if pos:
            index[pos, turn] = index.get((pos, turn), 0) | mine
            turn_at[pos, i] = turn, words, step1, step2
    found: list[tuple] = []

    def add(depth: int, key: tuple, parent: tuple, members: int, words: int) -> int:
        """Note a node; the members that go on."""
        ends = held = members & ends_at.get(depth, 0)
        numbers = []
        while held:
            numbers.append(ids[(held & -held).bit_length() - 1])
            held &= held - 1
        packed = np.array(numbers, "<i8").tobytes() if numbers else None
        found.append((shard, segment, depth, *key, *parent, ids[(members & -members).bit_length() - 1], members.bit_count(), words, packed))
        return members ^ ends

    stack = []
    for start, members in starts.items():
        stack.append((segment * SEGMENT, start, members if segment else add(0, start, (None, None), members, 0)))
    while stack:
        depth, key, left = stack.pop()
        if depth == (segment + 1) * SEGMENT:
            continue
        while left:
            turn, words, step1, step2 = turn_at[depth + 1, (left & -left).bit_length() - 1]
            child = left & index[depth + 1, turn]
            left ^= child
            own = key[0] ^ step1, key[1] ^ step2
            stack.append((depth + 1, own, add(depth + 1, own, key, child, words)))
    columns = dict(zip(NODE, zip(*found)))
    return pd.DataFrame({c: pd.array(columns[c], "Int64") if kind == "long" else list(columns[c]) for c, kind in NODE.items()})


def _ends_digests(ends: DataFrame) -> DataFrame:
    """key1, key2, ends_sha256 of rows (key1, key2, shard, ends).

    The lists of a node come in the order of their shards and pass through a running digest, so
    a node where very many conversations end needs no memory; its digest itself is sequential.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            found: list[tuple] = []
            for key1, key2, packed in zip(batch.column("key1").to_pylist(), batch.column("key2").to_pylist(), batch.column("ends")):
                numbers = ",".join(map(str, np.frombuffer(packed.as_py(), "<i8").tolist())).encode()
                if now == (key1, key2):
                    digest.update(b"," + numbers)
                else:
                    if now:
                        found.append((*now, digest.hexdigest()))
                    now, digest = (key1, key2), hashlib.sha256(numbers)
            if found:
                yield rows_of(found)
        if now:
            yield rows_of([(*now, digest.hexdigest())])

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        key1, key2, digest = zip(*found)
        return pa.record_batch([pa.array(key1, pa.int64()), pa.array(key2, pa.int64()), pa.array(digest, pa.string())],
                               ["key1", "key2", "ends_sha256"])

    ordered = ends.repartition("key1", "key2").sortWithinPartitions("key1", "key2", "shard")
    return ordered.select("key1", "key2", "ends").mapInArrow(run, "key1 long, key2 long, ends_sha256 string")


def _sums_below(rows: pd.DataFrame) -> pd.DataFrame:
    """key1, key2, leaves, saved: what a tile's nodes own, summed over their subtrees in the tile."""
    nodes = rows.groupby(["key1", "key2"], as_index=False).agg(
        {"depth": "min", "parent1": "max", "parent2": "max", "leaves": "sum", "saved": "sum"}).sort_values("depth", ascending=False)
    keys = list(zip(nodes["key1"].tolist(), nodes["key2"].tolist()))
    total = {k: [a, b] for k, a, b in zip(keys, nodes["leaves"].tolist(), nodes["saved"].tolist())}
    for key, parent in zip(keys, zip(nodes["parent1"].tolist(), nodes["parent2"].tolist())):
        if parent in total:  # the parent of the tile's top is in another one
            total[parent][0] += total[key][0]
            total[parent][1] += total[key][1]
    sums = list(map(total.__getitem__, keys))
    return pd.DataFrame({"key1": nodes["key1"].to_numpy(), "key2": nodes["key2"].to_numpy(),
                         "leaves": [a for a, _ in sums], "saved": [b for _, b in sums]})


def subtree_sums(local: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """key1, key2, leaves, saved of every node that two conversations share.

    A node with one member has one leaf and saves nothing, so a shared node owns its single
    children's leaves (itself if it has no child), and what its last turn saves.
    """
    key = ["key1", "key2"]
    own_leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("single")).cast("long")
    shared = nodes.filter("n_convs > 1").select(*key, "conv_id", "depth", own_leaves.alias("leaves"),
                                                ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    owned = F.col("low") == F.col("conv_id")
    none = F.lit(-2**63).cast("long")  # pandas would turn columns with nulls into doubles
    up = [F.coalesce(c, none).alias(c) for c in ("parent1", "parent2")]
    here = local.drop("depth").join(shared, key).select("shard", "segment", "depth", *key, *up, *[
        F.when(owned, F.col(c)).otherwise(0).alias(c) for c in ("leaves", "saved")])
    # what a conversation owns in deeper segments counts at its node on their border
    deep = (shared.filter(F.col("depth") > SEGMENT).groupBy("conv_id", F.floor((F.col("depth") - 1) / SEGMENT).alias("segment"))
            .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    below = Window.partitionBy("conv_id").orderBy(F.desc("segment"))  # a row per segment
    border = starts.join(deep, ["conv_id", "segment"], "left").select(
        "shard", "segment", "start1", "start2", F.sum("leaves").over(below).alias("leaves"), F.sum("saved").over(below).alias("saved"))
    border = border.filter("leaves is not null").select(
        "shard", (F.col("segment") - 1).alias("segment"), (F.col("segment") * SEGMENT).alias("depth"), F.col("start1").alias("key1"),
        F.col("start2").alias("key2"), none.alias("parent1"), none.alias("parent2"), "leaves", "saved")
    sums = here.unionByName(border).groupBy("shard", "segment").applyInPandas(_sums_below, "key1 long, key2 long, leaves long, saved long")
    return sums.groupBy(*key).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conv_id is the smallest conversation that starts with the node's turns. Rows with a null
    conv_id are left out; null roles and texts are empty; turns of equal number, null ones first,
    go by the digest of role and text, and repeated rows count each. A conversation may be left
    without turns, which ends at the root. Other columns are not read; texts count whole. An empty
    table gives no rows.
    """
    turns, convs = rebuilt(ordered_turns(conversations))
    rows, starts = tiles(turns, convs)
    local = shared_table(rows.groupBy("shard", "segment").applyInPandas(_nodes_of, ", ".join(f"{c} {k}" for c, k in NODE.items())), "nodes")
    key, parent = ["key1", "key2"], ["parent1", "parent2"]
    nodes = local.groupBy(*key).agg(*[F.min(c).alias(c) for c in ("depth", "words", *parent)], F.min("low").alias("conv_id"),
                                    F.sum("n").alias("n_convs"))
    nodes = shared_table(nodes, "merged")
    children = nodes.filter("depth > 0").groupBy(F.col("parent1").alias("key1"), F.col("parent2").alias("key2")).agg(
        F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("single"))
    full = nodes.join(children, key, "left").fillna(0, ["n_children", "single"])
    above = nodes.select(F.col("key1").alias("parent1"), F.col("key2").alias("parent2"), F.col("conv_id").alias("parent_conv_id"))
    ends = _ends_digests(local.filter("ends is not null"))
    sums = subtree_sums(local, full, starts)
    return (full.join(sums, key, "left").join(ends, key, "left").join(above, parent, "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
                    F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
