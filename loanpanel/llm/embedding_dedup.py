"""Near-duplicate embeddings by navigable small-world graphs, one per shard.

Vectors are compared within a label. Equal vectors are one (with their number), dealt to
shards of bounded size by hash; every shard gets a hierarchical graph. Each pair of shards of a
label is searched in both directions: a beam descends the levels, then spreads from what lies
within the threshold to all neighbours that do. An audit compares a sample of the queries with
brute force over the shard; beams are doubled until it passes, at the latest when they are as
wide as the shard. Links are confirmed by cosine in double precision, counted, and joined to
components.

(Malkov, Yashunin: Efficient and Robust Approximate Nearest Neighbor Search Using Hierarchical
Navigable Small World Graphs.) Inserting and searching go over many vectors at once in numpy.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.llm.components import connected_components
from loanpanel.llm.storage import cut

BLOCK = 256  # vectors that are inserted or searched together
AUDITED = 64  # queries of a search that brute force repeats


class SmallWorld:
    """A hierarchical graph over unit vectors.

    Level l holds about 1 / width^l of the vectors. Level by level from the top, vectors are
    inserted in blocks: candidates come from a beam search among those already there and from
    the block itself, and neighbours are chosen so that none is closer to an earlier choice
    than to the vector.
    """

    def __init__(self, vectors: np.ndarray, width: int = 12, beam: int = 48):
        n = len(vectors)
        level = np.floor(-np.log(1 - np.random.default_rng(n).random(n)) / np.log(width)).astype(int)
        self.width = width
        self.order = np.argsort(-level, kind="stable")  # members of higher levels first
        self.x = vectors[self.order].astype(np.float32)  # from here on, vectors go by their place in the order
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max()), -1, -1)]
        self.links: list[np.ndarray] = []
        for depth, size in enumerate(self.sizes):
            self._build(depth, size, beam)

    def _build(self, depth: int, size: int, beam: int) -> None:
        most = self.width * (2 if depth == len(self.sizes) - 1 else 1)  # more on the ground level
        links = np.full((size, most), -1, np.int32)
        self.links.append(links)
        done = 0
        while done < size:
            block = np.arange(done, min(size, done + max(self.width, min(BLOCK, done))))
            own = self.x[block]
            near = own @ own.T
            near[np.triu_indices(len(block))] = -2  # a vector of the block sees those before it
            k = min(beam, len(block))
            within = np.argsort(-near, 1, kind="stable")[:, :k]
            found, sims = block[within], np.take_along_axis(near, within, 1)
            if done:
                ids, there = self._descend(own, beam, depth, done)
                found, sims = np.hstack([ids, found]), np.hstack([there, sims])
            found = np.where(sims > -1.5, found, -1)
            links[block] = self._chosen(block, found, self.width, most)
            done = int(block[-1]) + 1
            self._reversed(links, block, most)

    def _chosen(self, nodes: np.ndarray, candidates: np.ndarray, most: int, places: int) -> np.ndarray:
        """Up to ``most`` neighbours of each node, diverse ones first, in ``places`` columns."""
        sims = np.where(candidates >= 0, np.einsum("bd,bcd->bc", self.x[nodes], self.x[candidates]), -2)
        order = np.argsort(-sims, 1, kind="stable")
        candidates, sims = np.take_along_axis(candidates, order, 1), np.take_along_axis(sims, order, 1)
        again = np.zeros(candidates.shape, bool)
        by_id = np.argsort(candidates, 1, kind="stable")
        ordered = np.take_along_axis(candidates, by_id, 1)
        np.put_along_axis(again, by_id[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
        free = (candidates >= 0) & ~again & (candidates != nodes[:, None])
        own = self.x[candidates]
        between = own @ own.transpose(0, 2, 1)
        kept, shadowed = np.zeros(free.shape, bool), np.zeros(free.shape, bool)
        for c in range(free.shape[1]):
            pick = free[:, c] & ~shadowed[:, c] & (kept.sum(1) < most)
            kept[:, c] = pick
            shadowed |= pick[:, None] & (between[:, c] > sims)
        rank = np.argsort(np.where(kept, 0, np.where(free, 1, 2)), 1, kind="stable")[:, :most]
        out = np.where(np.take_along_axis(free, rank, 1), np.take_along_axis(candidates, rank, 1), -1)
        return np.pad(out, ((0, 0), (0, places - out.shape[1])), constant_values=-1)

    def _reversed(self, links: np.ndarray, block: np.ndarray, most: int) -> None:
        """Let the neighbours of a block's nodes point back, choosing anew where they have too many."""
        source, to = np.repeat(block, most), links[block].ravel()
        source, to = source[to >= 0], to[to >= 0]
        order = np.argsort(to, kind="stable")
        source, to = source[order], to[order]
        nodes, first, count = np.unique(to, return_index=True, return_counts=True)
        by_count = np.argsort(count, kind="stable")  # blocks of about equal width
        for k in range(0, len(nodes), BLOCK):
            part = by_count[k:k + BLOCK]
            place = first[part][:, None] + np.arange(min(int(count[part].max()), 4 * most))
            new = np.where(place < (first + count)[part][:, None], source[np.minimum(place, len(source) - 1)], -1)
            links[nodes[part]] = self._chosen(nodes[part], np.hstack([links[nodes[part]], new]), most, most)

    def _beam(self, q: np.ndarray, ids: np.ndarray, beam: int, depth: int, among: int,
              seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` best found from ``ids`` on one level, for every query, best first."""
        links = self.links[depth]
        rows = np.arange(len(q))[:, None]
        sims = np.where(ids >= 0, np.einsum("bd,bcd->bc", q, self.x[ids]), -2)
        done = ids < 0
        while True:
            todo = np.where(done, -2, sims)
            step = np.argsort(-todo, 1, kind="stable")[:, :4]  # the four best that are not expanded
            going = np.take_along_axis(todo, step, 1) > -1.5
            if not going.any():
                return ids, sims
            np.put_along_axis(done, step, True, 1)
            at = np.where(going, np.take_along_axis(ids, step, 1), -1)
            more = np.where((at >= 0)[:, :, None], links[at], -1).reshape(len(q), -1)
            more = np.where((more >= 0) & (more < among), more, -1)
            more = np.where((more >= 0) & ~seen[rows, more], more, -1)
            more = np.sort(more, 1)
            more[:, 1:][more[:, 1:] == more[:, :-1]] = -1
            seen[np.broadcast_to(rows, more.shape)[more >= 0], more[more >= 0]] = True
            there = np.where(more >= 0, np.einsum("bd,bcd->bc", q, self.x[more]), -2)
            ids, sims, done = np.hstack([ids, more]), np.hstack([sims, there]), np.hstack([done, more < 0])
            best = np.argsort(-sims, 1, kind="stable")[:, :beam]
            ids, sims, done = (np.take_along_axis(a, best, 1) for a in (ids, sims, done))

    def _descend(self, q: np.ndarray, beam: int, depth: int, among: int) -> tuple[np.ndarray, np.ndarray]:
        """A beam on level ``depth``, entered through the levels above; ``among``: the nodes there so far."""
        ids = np.zeros((len(q), 1), np.int64)
        for d in range(depth + 1):
            most = self.sizes[d] if d < depth else among
            ids = np.where(ids < most, ids, -1)[:, :8]
            ids[(ids < 0).all(1), 0] = 0
            seen = np.zeros((len(q), most), bool)
            row, col = np.nonzero(ids >= 0)
            seen[row, ids[row, col]] = True
            ids, sims = self._beam(q, ids, beam if d == depth else 8, d, most, seen)
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int) -> np.ndarray:
        """Boolean (query, place in the order): vectors found with a similarity of ``least`` or more.

        Where the whole beam is within the threshold, it is widened to the whole shard.
        """
        n, depth = len(self.x), len(self.sizes) - 1
        out = np.zeros((len(q), n), bool)
        for at in range(0, len(q), BLOCK):
            part, own = q[at:at + BLOCK], out[at:at + BLOCK]
            if beam >= n:
                own[:] = part @ self.x.T >= least
                continue
            ids, sims = self._descend(part, beam, depth, n)
            hit = (sims >= least) & (ids >= 0)
            wide = hit.sum(1) >= beam
            own[wide] = part[wide] @ self.x.T >= least
            hit[wide] = False
            row, node = np.nonzero(hit)[0], ids[hit]
            own[row, node] = True
            while len(row):  # spread to neighbours within the threshold
                new_row, new = np.repeat(row, self.links[depth].shape[1]), self.links[depth][node].ravel()
                new_row, new = new_row[new >= 0], new[new >= 0].astype(np.int64)
                fresh = np.unique((new_row * n + new)[~own[new_row, new]])
                row, node = fresh // n, fresh % n
                near = [np.einsum("bd,bd->b", part[row[k:k + 65536]], self.x[node[k:k + 65536]]) >= least
                        for k in range(0, len(row), 65536)]
                near = np.concatenate(near) if near else np.zeros(0, bool)
                row, node = row[near], node[near]
                own[row, node] = True
        return out


def search(graph: SmallWorld, base: np.ndarray, queries: np.ndarray, threshold: float, beam: int,
           recall: float) -> tuple[np.ndarray, list[tuple[int, float]]]:
    """Boolean (query, base row): pairs with cosine of ``threshold`` or more, and the audits (beam, recall).

    ``base`` and ``queries`` are unit vectors in double precision; ``base`` in the order given to
    the graph. Audited queries are spread evenly over all.
    """
    audits, sample = [], np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(int))
    wanted = queries[sample] @ base.T >= threshold
    if base is queries:  # a vector finds itself anyway
        wanted[np.arange(len(sample)), sample] = False
    loose = np.float32(threshold - 1e-5)
    while True:
        found = np.zeros((len(queries), len(base)), bool)
        found[:, graph.order] = graph.within(queries.astype(np.float32), loose, beam)
        share = float((found[sample] & wanted).sum() / max(1, wanted.sum()))
        audits.append((beam, share))
        if wanted.sum() == 0 or share >= recall or beam >= len(base):
            break
        beam *= 2
    for at in range(0, len(queries), BLOCK):
        row, col = np.nonzero(found[at:at + BLOCK])
        for k in range(0, len(row), 65536):
            r, c = row[k:k + 65536] + at, col[k:k + 65536]
            found[r, c] = np.einsum("bd,bd->b", queries[r], base[c]) >= threshold
    return found, audits


def _weighted(found: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per row, the sum of the weights of what it found."""
    blocks = [found[at:at + BLOCK].astype(np.float64) @ weights for at in range(0, len(found), BLOCK)]
    return np.concatenate(blocks).astype(np.int64)


def _lowest(found: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Per row, the lowest label of what it found; a large number if nothing."""
    none = np.iinfo(np.int64).max
    return np.concatenate([np.where(found[at:at + BLOCK], labels, none).min(1) for at in range(0, len(found), BLOCK)])


def _union(found: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
    """Smallest reachable node of every node.

    Nodes are 0, 1, ...; ``rows`` and ``cols`` name those of the matrix ``found``.
    """
    label = np.arange(max(rows.max(), cols.max()) + 1)
    while True:
        new = label.copy()
        new[rows] = np.minimum(new[rows], _lowest(found, label[cols]))
        new[cols] = np.minimum(new[cols], _lowest(found.T, new[rows]))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, shard_rows: int = 8_192, beam: int = 32,
                    recall: float = 0.98) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors are linked when their labels are equal and not null, they have the same number of
    components, and their cosine reaches ``threshold``. Vectors that are null, empty, zero or
    hold a null or non-finite component are linked with nothing: n_links 0 and their own
    component. Repeated rows are vectors of their own. Other columns are not read; an empty
    table gives no rows.
    """
    kept = dict(vectors.dtypes)
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    usable = (F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
              & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    # equal vectors once: the smallest id stands for them
    classes = cut(rows.filter("usable").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    counts = classes.groupBy("label", F.size("v").alias("dim")).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    dealt = (classes.withColumn("dim", F.size("v")).join(counts, ["label", "dim"])
             .withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int")))
    key = f"label {kept['label']}, dim int, shard int, shards int"

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep", kind="stable")
        x = np.array(pdf["v"].tolist(), np.float64)
        x /= np.abs(x).max(1, keepdims=True)  # no overflow in the squares
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        reps, copies = pdf["rep"].to_numpy(), pdf["copies"].to_numpy(np.int64)
        graph = SmallWorld(x)
        payload = pickle.dumps((reps, copies, x, graph.order, graph.sizes, graph.links, graph.width))
        return pdf[["label", "dim", "shard", "shards"]].head(1).assign(payload=payload)

    graphs = cut(dealt.groupBy("label", "dim", "shard").applyInPandas(build, f"{key}, payload binary"))

    def unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, SmallWorld]:
        reps, copies, x, order, sizes, links, width = pickle.loads(payload)
        graph = SmallWorld.__new__(SmallWorld)
        graph.x, graph.order, graph.sizes, graph.links, graph.width = x[order].astype(np.float32), order, sizes, links, width
        return reps, copies, x, graph

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        reps, copies, x, graph = unpacked(pdf["payload"].iloc[0])
        if pdf["other"].iloc[0] is None:  # the shard with itself
            found, _ = search(graph, x, x, threshold, beam, recall)
            found |= found.T
            np.fill_diagonal(found, False)
            links = _weighted(found, copies)
            first = reps[_union(found, np.arange(len(x)), np.arange(len(x)))]  # rows are ordered by id
        else:
            others, more, y, other = unpacked(pdf["other"].iloc[0])
            found = search(graph, x, y, threshold, beam, recall)[0].T | search(other, y, x, threshold, beam, recall)[0]
            links = np.concatenate([_weighted(found, more), _weighted(found.T, copies)])
            reps = np.concatenate([reps, others])
            place = np.argsort(np.argsort(reps, kind="stable"), kind="stable")
            label = _union(found, place[:len(x)], place[len(x):])
            first = np.sort(reps)[label][place]
        return pd.DataFrame({"rep": reps, "links": links, "first": first})

    # every unordered pair of a label's shards is one task; each brings its two graphs
    first = graphs.select("label", "dim", F.col("shard").alias("a"), "shards", "payload").withColumn(
        "b", F.explode(F.sequence(F.col("a"), F.col("shards") - 1)))
    second = graphs.select("label", "dim", F.col("shard").alias("b"), F.col("payload").alias("other"))
    pairs = first.join(second.withColumnsRenamed({"other": "second"}), ["label", "dim", "b"]).withColumn(
        "other", F.when(F.col("a") != F.col("b"), F.col("second"))).drop("second")
    matched = cut(pairs.groupBy("label", "dim", "a", "b").applyInPandas(
        match, f"rep {kept['vec_id']}, links long, first {kept['vec_id']}"))

    part_of = connected_components(matched.select(F.col("rep").alias("a"), F.col("first").alias("b")))
    links = matched.groupBy("rep").agg(F.sum("links").alias("links"))
    known = (classes.join(links, "rep").join(part_of.withColumnRenamed("id", "rep"), "rep", "left")
             .select("label", "v", "copies", "links", F.coalesce("component", "rep").alias("component")))
    usable_rows = rows.filter("usable").join(known, ["label", "v"]).select(
        "vec_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("component").alias("component_id"))
    others = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                              F.col("vec_id").alias("component_id"))
    return usable_rows.unionByName(others).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
