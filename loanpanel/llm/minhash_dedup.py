"""Near-duplicate documents by a chosen-path set similarity join over minwise tokens.

1. Every document becomes the set of its hashed word shingles, of which the number, a 128-bit
   digest and ``PERMUTATIONS`` minimum hash values are kept. Documents with equal sets are one
   class, joined through its smallest doc_id.
2. Independent trees branch the classes: a node chooses one or two of the minwise tokens
   (1 / threshold on average), and a class goes to the child of its value there. Nodes of at
   most ``limit`` classes are compared exhaustively; larger ones branch again. The number of
   trees follows from the target recall.
3. Within a node, pairs that look similar enough (the estimate's error allowed for) are
   reduced to a heaviest spanning forest, so a group of copies gives as many pairs as it has
   members. The forests of all trees make candidate groups; the pairs are confirmed on full sets,
   and confirmed links are joined to components.
4. A candidate group that is not one component yet is compared exactly: its members outside the
   largest component meet all members, on full sets, until they are linked. Pairs within a
   component can add nothing, so no link is lost to the forest.

Nodes and groups that are larger than a task should hold are compared in chunks.

(Christiani, Pagh, Sivertsen: Scalable and Robust Set Similarity Join.)
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm import shingles
from loanpanel.llm.components import connected_components
from loanpanel.llm.storage import cut, sent_if_small, shared_table

PERMUTATIONS = 64
POSTINGS = 1 << 20  # posting-list entries counted at once
GROUP = ["node", "chunk", "chunk2"]
ERRORS = 4.0  # standard errors below the threshold at which an estimate still counts as similar


def _bytes(batch: pa.RecordBatch, column: str) -> list[bytes]:
    """The values as UTF-8; null is empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def _minimums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum hash values (32 bits) of the non-empty runs of ``values``."""
    seeds = shingles.mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=np.uint64))
    out = np.empty((len(bounds), PERMUTATIONS), np.uint32)
    for i in range(PERMUTATIONS):
        hashed = (values * (seeds[2 * i] | np.uint64(1)) + seeds[2 * i + 1]) >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(hashed, bounds)
    return out


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, h1, h2 (digest of the set), signature (32-bit minimums), short (their low bytes).

    An empty set has no signature.
    """
    kept = dict(docs.dtypes)["doc_id"]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _bytes(batch, "text")
            sizes, h1, h2 = (np.zeros(len(texts), t) for t in (np.int64, np.uint64, np.uint64))
            signature: list = [None] * len(texts)
            short: list = [None] * len(texts)
            for part in shingles.chunks(texts):
                values, first = shingles.shingle_lists([texts[i] for i in part], words)
                full = np.flatnonzero(np.diff(first))
                if not len(full):
                    continue
                minimums = _minimums(values, first[full])
                for k, i in enumerate(full):
                    own = np.unique(values[first[i]:first[i + 1]])
                    at = part.start + i
                    sizes[at], h1[at] = len(own), np.add.reduce(shingles.mix(own))
                    h2[at] = np.add.reduce(shingles.mix(own ^ np.uint64(0x5851F42D4C957F2D)))
                    signature[at] = minimums[k].astype("<u4").tobytes()
                    short[at] = minimums[k].astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                 pa.array(signature, pa.binary()), pa.array(short, pa.binary())],
                ["doc_id", "n_shingles", "h1", "h2", "signature", "short"])

    return docs.select("doc_id", "text").mapInArrow(
        sketch, f"doc_id {kept}, n_shingles long, h1 long, h2 long, signature binary, short binary")


def trees_for(recall: float, threshold: float, levels: int) -> int:
    """Trees that bring a pair at the threshold into a common node with probability ``recall``.

    In a node, a pair shares the first child with chance ``threshold``, and the second, which is
    there with chance 1 / threshold - 1, likewise; taken for pairs that need all ``levels`` levels.
    """
    together = 1.0
    for _ in range(levels):
        together = 1 - (1 - threshold * together) * (1 - (1 - threshold) * together)
    return math.ceil(math.log(1 - recall) / math.log(1 - together))


def _children(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, rep, signature) to (node, rep) of the next level."""
    kept = dict(nodes.dtypes)["rep"]
    second = np.uint64(int((1 / threshold - 1) * 2**64))

    def branch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = np.asarray(batch.column("node")).view(np.uint64)
            values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u4").reshape(-1, PERMUTATIONS)
            for child in range(2):
                draw = shingles.mix(node + np.uint64(2 * child + 1))
                own = np.arange(len(node)) if child == 0 else np.flatnonzero(
                    shingles.mix(node ^ np.uint64(0x2545F4914F6CDD1D)) < second)
                chosen = (draw[own] % np.uint64(PERMUTATIONS)).astype(np.int64)
                value = values[own, chosen].astype(np.uint64)
                to = shingles.mix(shingles.mix(draw[own] + chosen.astype(np.uint64)) ^ value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(to.view(np.int64)), batch.column("rep").take(pa.array(own))], ["node", "rep"])

    return nodes.select("node", "rep", "signature").mapInArrow(branch, f"node long, rep {kept}")


def _similar(group: np.ndarray, size: np.ndarray, short: np.ndarray, threshold: float,
             part: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one group (adjacent, by size) whose estimate may reach the threshold, and matches.

    Equal low bytes by chance are allowed for. With ``part``, only pairs of different parts.
    """
    chance = 1 / 256
    least = threshold + (1 - threshold) * chance
    least = PERMUTATIONS * (least - ERRORS * math.sqrt(least * (1 - least) / PERMUTATIONS))
    left, right, weight = [], [], []
    at, distance = np.arange(len(group)), 0
    while True:
        distance += 1
        at = at[at + distance < len(group)]
        other = at + distance
        near = (group[other] == group[at]) & (size[at] >= threshold * size[other] - 1e-9)
        at = at[near]
        if not len(at):
            break
        pairs = at if part is None else at[part[at] != part[at + distance]]
        for k in range(0, len(pairs), 1 << 16):
            a = pairs[k:k + (1 << 16)]
            same = (short[a] == short[a + distance]).sum(1)
            found = same >= least
            left.append(a[found])
            right.append(a[found] + distance)
            weight.append(same[found])
    if not left:
        return (np.empty(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(weight)


def _spanning_forest(label: np.ndarray, left: np.ndarray, right: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of a heaviest spanning forest (Boruvka) over the labels; ties by place."""
    order = np.argsort(-weight, kind="stable")
    a, b, number = label[left[order]], label[right[order]], order
    n = int(label.max(initial=0)) + 1
    root = np.arange(n)
    taken: list[np.ndarray] = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    while len(a):
        best = np.full(n, len(a))
        rank = np.arange(len(a))
        np.minimum.at(best, a, rank)
        np.minimum.at(best, b, rank)
        chosen = np.unique(best[best < len(a)])
        for k in chosen:
            x, y = find(a[k]), find(b[k])
            root[max(x, y)] = min(x, y)
        taken.append(number[chosen])
        now = root.copy()
        while (now != now[now]).any():
            now = now[now]
        a, b = now[a], now[b]
        keep = a != b
        a, b, number = a[keep], b[keep], number[keep]
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups (node, chunk, chunk2) from batches that are sorted by them."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        keys = [table.column(c).to_numpy() for c in GROUP]
        last = np.logical_and.reduce([k == k[-1] for k in keys])
        cut_at = int(np.flatnonzero(~last)[-1]) + 1 if not last.all() else 0
        if cut_at:
            yield table.slice(0, cut_at)
        held = table.slice(cut_at)
    if held is not None and held.num_rows:
        yield held


def _group_numbers(table: pa.Table) -> np.ndarray:
    keys = [table.column(c).to_numpy() for c in GROUP]
    return np.append(0, np.cumsum(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))


def _compared(groups: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a heaviest spanning forest of the similar-looking pairs within each of ``groups``.

    ``groups`` has node, chunk, chunk2, rep, n_shingles, short and part; pairs within a part are
    left out, and a part counts as connected (null: a row is its own part).
    """
    kept = dict(groups.dtypes)["rep"]
    rows = groups.repartition(*GROUP).sortWithinPartitions(*GROUP, "n_shingles", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            group, size = _group_numbers(table), table.column("n_shingles").to_numpy()
            short = np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, PERMUTATIONS)
            part = table.column("part")
            label, given = np.arange(len(group)), None
            if not part.null_count:
                given = part.to_numpy()
                _, label = np.unique(np.stack([group, given]), axis=1, return_inverse=True)
                label = label.ravel()
            a, b, weight = _similar(group, size, short, threshold, given)
            tree = _spanning_forest(label, a, b, weight)
            rep = table.column("rep").combine_chunks()
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(a[tree])), rep.take(pa.array(b[tree]))], ["a", "b"])

    return rows.mapInArrow(compare, f"a {kept}, b {kept}")


def _linked_exactly(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b): links that join parts within each of ``groups``, found on full sets.

    ``groups`` has node, chunk, chunk2, rep, part and outside; rows outside the main part meet all
    rows, by posting lists of the group's shingles.
    """
    kept = dict(groups.dtypes)["rep"]
    parts = round(threshold * 1_000_000)
    rows = (groups.join(sets.withColumnRenamed("doc_id", "rep"), "rep")
            .repartition(*GROUP).sortWithinPartitions(*GROUP, "rep"))

    def joined(outside: np.ndarray, parts_of: np.ndarray, own: list[np.ndarray]) -> list[tuple[int, int]]:
        _, label = np.unique(parts_of, return_inverse=True)
        size = np.array([len(x) for x in own])
        _, shingle = np.unique(np.concatenate(own), return_inverse=True)
        order = np.argsort(shingle, kind="stable")
        holder = np.repeat(np.arange(len(own)), size)[order]
        start = np.append(0, np.cumsum(np.bincount(shingle)))
        first = np.append(0, np.cumsum(size))
        found = []
        for i in np.flatnonzero(outside):
            mine, common = shingle[first[i]:first[i + 1]], np.zeros(len(own), np.int64)
            count = start[mine + 1] - start[mine]
            for part in np.split(np.arange(len(mine)), np.flatnonzero(np.diff(np.cumsum(count) // POSTINGS)) + 1):
                n = count[part]
                place = np.repeat(start[mine[part]] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                common += np.bincount(holder[place], minlength=len(own))
            for j in np.flatnonzero((common * 1_000_000 >= parts * (size[i] + size - common)) & (label != label[i])):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((i, j))
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches):
            first = np.append(np.flatnonzero(np.diff(_group_numbers(table), prepend=-1)), table.num_rows)
            rep = table.column("rep").combine_chunks()
            left, right = [], []
            for lo, hi in zip(first[:-1].tolist(), first[1:].tolist()):
                own = [np.frombuffer(x, np.uint64) for x in table.column("own").slice(lo, hi - lo).to_pylist()]
                outside, part = (table.column(c).slice(lo, hi - lo).to_numpy() for c in ("outside", "part"))
                for i, j in joined(outside, part, own):
                    left.append(lo + i)
                    right.append(lo + j)
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(x, pa.int64())) for x in (left, right)], ["a", "b"])

    return rows.mapInArrow(compare, f"a {kept}, b {kept}")


def _full_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, own): the sorted shingle hashes of the documents in ``ids``."""
    kept = dict(docs.dtypes)["doc_id"]

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, out = _bytes(batch, "text"), []
            for part in shingles.chunks(texts):
                values, first = shingles.shingle_lists([texts[i] for i in part], words)
                out += [np.unique(values[first[i]:first[i + 1]]).tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "own"])

    wanted = docs.select("doc_id", "text").join(sent_if_small(ids.select("doc_id").distinct()), "doc_id", "left_semi")
    return wanted.mapInArrow(full_sets, f"doc_id {kept}, own binary")


def _confirmed(pairs: DataFrame, docs: DataFrame, words: int, threshold: float) -> DataFrame:
    """Of the distinct ``pairs`` (a, b of doc_ids), those whose full sets reach the threshold.

    Sets are computed for the documents of pairs only, and each is sent once per pair.
    """
    kept = dict(docs.dtypes)["doc_id"]
    parts = round(threshold * 1_000_000)

    def linked(sides: tuple[set[bytes], set[bytes]]) -> bool:
        for mine, theirs in ((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x in sides[0] for y in sides[1]):
            common = len(np.intersect1d(mine, theirs, assume_unique=True))
            if common * 1_000_000 >= parts * (len(mine) + len(theirs) - common):
                return True
        return False

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, sides, kind = None, (set(), set()), None  # more than one set where a doc_id repeats
        for batch in batches:
            links, kind = [], batch.column("a").type
            for a, b, doc_id, own in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "doc_id", "own"))):
                if pair is not None and pair != (a, b):
                    if linked(sides):
                        links.append(pair)
                    sides = (set(), set())
                pair = (a, b)
                sides[doc_id == b].add(own)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], kind) for i in (0, 1)], ["a", "b"])
        if pair is not None and linked(sides):
            yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x in pair], ["a", "b"])

    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b")
    rows = ends.join(_full_sets(docs, ends, words), "doc_id").repartition("a", "b").sortWithinPartitions("a", "b")
    return rows.select("a", "b", "doc_id", "own").mapInArrow(overlaps, f"a {kept}, b {kept}").distinct()


def _groups(nodes: DataFrame, limit: int) -> DataFrame:
    """First comparison: nodes whole, larger ones in chunks that share eight leaders."""
    chunks = F.ceil(F.col("members") / limit).cast("int")
    chunked = nodes.withColumn("chunks", chunks).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    large = chunked.filter("chunks > 1")
    leaders = (large.groupBy("node", F.pmod(F.xxhash64(F.lit(7), "rep"), F.lit(8)).alias("eighth"))
               .agg(F.min("rep").alias("rep"), F.first("chunks").alias("chunks"))
               .select("node", "rep", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    rows = chunked.select("node", "chunk", "rep").unionByName(leaders.select("node", F.col("chunk").cast("int").alias("chunk"), "rep"))
    return rows.withColumn("chunk2", F.lit(0)).withColumn("part", F.lit(None).cast("long"))


def _open_groups(nodes: DataFrame, part_of: DataFrame, limit: int) -> DataFrame:
    """Second comparison: of each node (node, rep), all against the members outside its largest part.

    Both sides are dealt to chunks of about ``limit``, and every chunk of the one meets every
    chunk of the other. Nodes of a single part are left out.
    """
    rows = (nodes.join(part_of, "rep", "left")
            .select("node", "rep", F.xxhash64(F.coalesce("component", "rep")).alias("part")))
    counts = rows.groupBy("node", "part").agg(F.count("*").alias("n"))
    nodes = counts.groupBy("node").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count("*").alias("parts"),
                                       F.sum("n").alias("all"), F.max("n").alias("most")).filter("parts > 1")
    rows = (rows.join(nodes, "node").withColumn("outside", F.col("part") != F.col("main"))
            .withColumn("m", F.ceil(F.col("all") / limit).cast("int"))
            .withColumn("k", F.ceil((F.col("all") - F.col("most")) / limit).cast("int"))
            .withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("m")).cast("int"))
            .withColumn("other", F.pmod(F.xxhash64(F.lit(1), "rep"), F.col("k")).cast("int")))
    one = ["node", "rep", "part", "outside"]
    everyone = rows.select(*one, F.col("mine").alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("chunk2"))
    others = rows.filter("outside").select(
        *one, F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("chunk"), F.col("other").alias("chunk2"))
    return everyone.unionByName(others).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, recall: float = 0.995,
                    limit: int = 1024, levels: int = 4, seed: int = 42) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when the Jaccard similarity of their shingle sets reaches
    ``threshold``; the component is the smallest doc_id reachable by links, and that document
    is kept. A null or empty text, or one of white space, has an empty set and is linked with
    nothing; a text with fewer than ``words`` words has one shingle. Texts count whole. Rows
    that share a doc_id are one document to links. Other columns are not read. An empty table
    gives no rows.
    """
    docs = docs.select("doc_id", "text")
    sketch = cut(sketches(docs, words))
    classes = (sketch.filter("n_shingles > 0").groupBy("h1", "h2", "n_shingles")
               .agg(F.min("doc_id").alias("rep"), F.min("signature").alias("signature"), F.min("short").alias("short")))
    classes = cut(classes)
    members = classes.select("rep", "n_shingles", "short")

    roots = F.array(*[F.xxhash64(F.lit(seed), F.lit(t)) for t in range(trees_for(recall, threshold, levels))])
    current = _children(classes.withColumn("node", F.explode(roots)), threshold)
    leaves = []
    for level in range(levels):
        sizes = current.groupBy("node").agg(F.count("*").alias("members")).filter("members > 1")
        current = cut(current.join(sizes, "node"))
        large = current.filter(F.col("members") > limit)
        if level == levels - 1 or large.isEmpty():
            leaves.append(current)
            break
        leaves.append(current.filter(F.col("members") <= limit))
        current = _children(large.join(classes.select("rep", "signature"), "rep"), threshold)
    nodes = leaves[0]
    for more in leaves[1:]:
        nodes = nodes.unionByName(more)

    def components(links: DataFrame) -> DataFrame:
        return cut(connected_components(links)).withColumnRenamed("id", "rep")

    forest = cut(_compared(_groups(nodes, limit).join(members, "rep"), threshold).filter("a <> b").distinct())
    group_of = components(forest)
    huge = nodes.filter(F.col("members") > limit).select("node", "rep")
    if not huge.isEmpty():  # their chunks have met through the leaders only
        more = cut(_compared(_open_groups(huge, group_of, limit).join(members, "rep"), threshold).filter("a <> b").distinct())
        if not more.isEmpty():
            forest = forest.unionByName(more).distinct()
            group_of = components(forest)
    links = cut(_confirmed(forest, docs, words, threshold))
    part_of = components(links)
    groups = _open_groups(group_of.select(F.xxhash64("component").alias("node"), "rep"), part_of, limit // 2)
    groups = cut(groups)
    if not groups.isEmpty():
        sets = _full_sets(docs, groups.select(F.col("rep").alias("doc_id")), words)
        more = cut(_linked_exactly(groups, sets, threshold).filter("a <> b").distinct())
        if not more.isEmpty():
            part_of = components(links.unionByName(more))

    digest = ["h1", "h2", "n_shingles"]
    found = (sketch.join(classes.select(*digest, "rep"), digest, "left").join(part_of, "rep", "left")
             .withColumn("component_id", F.coalesce("component", "rep", "doc_id")))
    return found.select("doc_id", "n_shingles", "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller doc_id, and without repeated rows.

    Rows with equal ids and equal texts are one document. Documents that share an id but not the
    text, or have no id, are documents of their own: of a group of near copies the smallest id
    stays, null last, equal ids by the digest of the text.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or doc_id is null").isEmpty():
        others = near_duplicates(docs, **options).filter("not kept").select(F.col("doc_id").alias("_id"))
        return docs.join(others, docs["doc_id"] == others["_id"], "left_anti")
    digest = [F.xxhash64(F.lit(i), "text") for i in (1, 2)]
    rows = shared_table(docs.select(F.struct("doc_id", *[d.alias(f"text{i}") for i, d in enumerate(digest)]).alias("key"),
                                    F.struct("*").alias("row")), "rows")
    order = [F.asc_nulls_last("key.doc_id"), "key.text0", "key.text1"]
    parts = max(8, -(-rows.count() // 1_000_000))
    # numbers in the order of the keys
    keys = cut(rows.select("key").distinct().repartitionByRange(parts, *order).sortWithinPartitions(*order)
               .withColumn("number", F.monotonically_increasing_id()))
    same = F.col("r.key").eqNullSafe(F.col("k.key"))
    rows = shared_table(rows.alias("r").join(keys.alias("k"), same).select("number", "row"), "numbered")
    others = near_duplicates(rows.select(F.col("number").alias("doc_id"), "row.text"), **options).filter("not kept")
    kept = rows.join(others.select(F.col("doc_id").alias("number")).distinct(), "number", "left_anti")
    return kept.dropDuplicates(["number"]).select("row.*")
