"""Random survival forest grown as Spark aggregations.

Rows stay in the executors. While a node has more rows than one task should hold, its level is one
job: rows walk down the trees grown so far and are counted per (node, feature, value, time), and
the best log-rank split of every such node comes back as one row. A node of at most
``ROWS_PER_NODE`` rows is sent to one task, which grows all levels below it; so the levels moved by
a shuffle are only those above. A tree has at most ``2 ** max_depth`` nodes, so the split tables
are small whatever the number of rows. All distinct values are cuts, unless ``bins`` are asked for.

The log-rank statistic of every cut of a node follows from prefix sums over its counts in value
order. Large nodes are cut into ranges of values: a range also gets the counts per time of all
smaller and of all larger values, which is all that the statistics of its own cuts depend on.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loanpanel.functions.stats import histogram, quantiles, running_sum
from loanpanel.session import cut, remove_path, scratch_path

try:  # three times as fast on short strings as the one of hashlib
    from _md5 import md5
except ImportError:
    from hashlib import md5

CELLS_PER_TASK = 200_000  # (node, feature, value, time) counts scored together, on average
ROWS_PER_NODE = 1_000_000  # a node with more rows is scored range by range, any other grown in one task
HELD_CELLS = 500_000  # cells a task sums up before it sends them
FEW_TIMES = 64  # up to so many times, the statistics are summed time by time


@dataclass(frozen=True)
class ForestParams:
    trees: int = 50
    max_depth: int = 10
    min_split: int = 10
    min_leaf: int = 15
    max_features: int | None = None  # None: square root of the feature count
    sample: float = 0.1
    seed: int = 42
    bins: int | None = None  # None: every distinct value is a cut; else quantile bins


@dataclass
class Forest:
    """Split table, bin edges, leaf mortality, and leaf hazard steps as a DataFrame.

    A row goes right where its value (its bin, if there are bins) is above ``cut``.
    """

    features: list[str]
    edges: dict[str, list[float]] | None
    splits: pd.DataFrame  # tree, node, feature (index), cut
    mortality: pd.DataFrame  # tree, node, mortality
    leaf_steps: DataFrame  # tree, node, time, hazard, drop
    params: ForestParams

    def _values(self) -> list[Column]:
        return [_plain(c) for c in self.features]

    def _cuts(self) -> pd.DataFrame:
        """The splits by value: more edges than ``cut`` lie below a value if edge number ``cut`` does."""
        if not self.edges:
            return self.splits
        of = [self.edges[c] for c in self.features]
        return self.splits.assign(cut=[float(of[int(f)][int(c)]) for f, c in zip(self.splits["feature"], self.splits["cut"])])

    def score(self, df: DataFrame, output: str = "risk") -> DataFrame:
        """Ensemble mortality: the leaf's summed cumulative hazard, averaged over trees.

        Scores are found in the JVM, by a tree ensemble of Spark's; a row that lacks a value which a tree asks for has none.
        """
        x = F.array(*[F.coalesce(v, F.lit(math.nan)) for v in self._values()], F.lit(0.0))
        known = [i for i, c in enumerate(self.features) if not df.schema[c].nullable]
        model = _ensemble(df.sparkSession, self._cuts(), self.mortality, self.params.trees, len(self.features) + 1, known)
        rows = model.setFeaturesCol("__x").setPredictionCol("__mean").transform(df.withColumn("__x", array_to_vector(x)))
        return rows.select(*df.columns, F.nanvl("__mean", F.lit(None)).alias(output))

    def leaves(self, df: DataFrame) -> DataFrame:
        """One row per (row of ``df``, tree) with the leaf it falls into."""
        rows = df.withColumn("__x", F.array(*self._values()))
        found = F.transform(_tree_arrays(self._cuts(), self.params.trees), lambda tree: _leaf(F.col("__x"), tree, self.params.max_depth)["node"])
        return rows.withColumn("__leaves", found).select(*df.columns, F.posexplode("__leaves").alias("tree", "node"))

    def _rows_per_leaf(self, df: DataFrame) -> DataFrame:
        """tree, node, n: the rows of ``df`` in every leaf, counted in the tasks."""
        trees = _Trees(self._cuts(), self.params.trees)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(len(trees.node), np.int64)  # the last place is for missing values
            for batch in batches:
                x = _matrix([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                for at in trees.reached(x):
                    counts += np.bincount(at, minlength=len(counts))
            some = np.flatnonzero(counts)
            yield _batch([trees.tree[some], trees.node[some], counts[some]], LEAF_COUNTS)

        values = df.select(*[c.alias(f"x{i}") for i, c in enumerate(self._values())])
        return values.mapInArrow(count, LEAF_COUNTS).groupBy("tree", "node").agg(F.sum("n").alias("n"))

    def average_curve(self, df: DataFrame) -> DataFrame:
        """``(time, survival, cum_hazard)``: mean predicted survival over all rows of ``df``.

        Only the number of rows per leaf is needed, so no per-row curve is formed.
        """
        counts = cut(self._rows_per_leaf(df))
        total = counts.agg(F.sum("n")).scalar()
        drops = (self.leaf_steps.join(counts, ["tree", "node"]).groupBy("time")
                 .agg((F.sum(F.col("drop") * F.col("n")) / total).alias("fall")))
        curve = running_sum(drops, "time", ["fall"])
        s = 1 - F.col("fall")
        return curve.select("time", s.alias("survival"), (-F.log(s + 1e-9)).alias("cum_hazard"))

    def survival_curves(self, rows: DataFrame, key: str) -> DataFrame:
        """``(key, time, survival)`` for a few rows, at the times where their curve falls."""
        falls = (self.leaves(rows.select(key, *self.features)).join(self.leaf_steps, ["tree", "node"])
                 .groupBy(key, "time").agg((F.sum("drop") / self.params.trees).alias("fall")))
        upto = F.sum("fall").over(Window.partitionBy(key).orderBy("time"))  # bounded by the months
        return falls.select(key, "time", (1 - upto).alias("survival"))


def risk_histogram(scored: DataFrame, risk: str = "risk", bins: int = 30) -> DataFrame:
    return histogram(scored, risk, bins)


def fit_forest(df: DataFrame, features: Sequence[str], key: str = "LOAN_ID",
               event: str = "survival_event", duration: str = "survival_time",
               params: ForestParams = ForestParams()) -> Forest:
    """Grow the forest.  ``key`` identifies a row and decides its bootstrap weights."""
    return fit_forests(df, {"": list(features)}, key, event, duration, params)[""]


def fit_forests(df: DataFrame, models: Mapping[str, Sequence[str]], key: str = "LOAN_ID",
                event: str = "survival_event", duration: str = "survival_time",
                params: ForestParams = ForestParams()) -> dict[str, Forest]:
    """Forests over several feature lists, their trees grown side by side in the same jobs.

    Each is the forest that :func:`fit_forest` gives; a row's draws are those of its tree.
    """
    models = {name: list(own) for name, own in models.items()}
    features = list(dict.fromkeys(c for own in models.values() for c in own))
    if df.where(" OR ".join(f"`{c}` IS NULL" for c in features)).limit(1).count():
        raise ValueError("features of a forest must not be null: impute them first")
    edges = _edges(df, features, params.bins) if params.bins else None
    columns = df.select(F.col(key).cast("string").alias("key"), F.col(duration).cast("double").alias("time"), F.col(event).cast("long").alias("event"),
                        *[_plain(c).alias(f"x{i}") for i, c in enumerate(features)])
    kinds = "time double, event long, " + "".join(f"x{i} double, " for i in range(len(features))) + "tree array<int>, w array<int>"
    rows = cut(columns.mapInArrow(_drawn(params, [edges[c] for c in features] if edges else None), kinds))  # read once a level
    grower = _Grower(rows.where(F.size("tree") > 0), [[features.index(c) for c in own] for own in models.values()], params, len(features))
    grower.grow()
    leaf_steps = cut(_leaf_steps(grower.leaf_counts()))
    # the mortality of a leaf sums its cumulative hazard over all event times of the data
    grid = rows.where("event = 1").groupBy("time").agg(F.lit(1).alias("later"))
    later = running_sum(grid, "time", ["later"], descending=True)
    mortality = (leaf_steps.join(later, "time").groupBy("tree", "node")
                 .agg(F.sum(F.col("hazard") * F.col("later")).alias("mortality")).toPandas())
    forests = {}
    for i, (name, own) in enumerate(models.items()):
        first, last = i * params.trees, (i + 1) * params.trees
        splits, scores = (t[(t["tree"] >= first) & (t["tree"] < last)].assign(tree=lambda t: t["tree"] - first).reset_index(drop=True)
                          for t in (grower.splits, mortality))
        places = {features.index(c): k for k, c in enumerate(own)}
        splits["feature"] = splits["feature"].map(places).astype(int)
        steps = (leaf_steps.where(F.col("tree").between(first, last - 1))
                 .withColumns({"tree": F.col("tree") - first, "time": F.col("time").cast(df.schema[duration].dataType)}))
        forests[name] = Forest(own, {c: edges[c] for c in own} if edges else None, splits, scores, steps, params)
    return forests


def _edges(df: DataFrame, features: Sequence[str], bins: int) -> dict[str, list[float]]:
    found = quantiles(df, features, [i / bins for i in range(1, bins)]).select("column", F.col("quantile").alias("cut"))
    cuts = found.distinct().collect()  # fewer than ``bins`` a feature
    return {c: sorted(r["cut"] for r in cuts if r["column"] == c) for c in features}


def _plain(c: str) -> Column:
    """A feature as a double; NaN is above all numbers, as in comparisons of Spark."""
    value = F.col(c).cast("double")
    return F.when(F.isnan(value), F.lit(math.inf)).otherwise(value)


def _matrix(columns: Sequence, edges: Sequence[Sequence[float]] | None = None) -> np.ndarray:
    """Rows by features; with ``edges``, how many of them lie below each value. NaN is a missing value."""
    x = np.column_stack([np.asarray(c, dtype=float) for c in columns])
    if edges is not None:
        x = np.column_stack([np.where(np.isnan(v), v, np.searchsorted(np.asarray(e, dtype=float), v)) for v, e in zip(x.T, edges)])
    return x


def _below(params: ForestParams) -> np.ndarray:
    """The chance of at most 0, 1, .. draws of a row by a tree."""
    if not 0 < params.sample <= 10:
        raise ValueError("sample is the mean number of draws of a row, above 0 and at most 10")
    below, term = [math.exp(-params.sample)], math.exp(-params.sample)
    for k in range(1, 13 + math.ceil(8 * params.sample)):  # the tail beyond is below 1e-17
        term *= params.sample / k
        below.append(below[-1] + term)
    return np.array(below)


def _draws(keys: pa.Array, params: ForestParams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, tree, w), by rows: the trees that draw a row, by a Poisson count from a hash of tree and key."""
    below = _below(params)
    names, drawn = _Names(keys), []
    for t in range(params.trees):
        first = names.hashed(b"%d:%d" % (params.seed, t)) >> np.uint64(12)  # 52 bits
        u = (first.astype(float) + 0.5) / 2.0**52
        some = np.flatnonzero(u >= below[0])
        drawn.append((some, np.full(len(some), t), np.searchsorted(below, u[some], side="right")))
    row, tree, w = (np.concatenate(parts) for parts in zip(*drawn))
    order = np.argsort(row, kind="stable")
    return row[order], tree[order], w[order]


MD5_TURNS = [r for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for r in four * 4]
MD5_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
ONE_BLOCK = 55  # bytes of a text that MD5 takes in one block


class _Names:
    """Keys as texts ``:key`` (a missing key: no text) that are hashed behind a prefix, all at once."""

    def __init__(self, keys: pa.Array):
        keys = keys.cast(pa.large_string())
        self.keys, known = keys, keys.is_valid().to_numpy(zero_copy_only=False)
        binary = keys.fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(binary.buffers()[1], np.int64)[binary.offset:binary.offset + len(keys) + 1]
        data = np.frombuffer(binary.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(keys) else np.zeros(0, np.uint8)
        size = np.diff(ends)
        self.size = size + known
        width = max(int(self.size.max(initial=0)), 1)
        self.text = None
        if width < ONE_BLOCK:
            row = np.repeat(np.arange(len(keys)), size)
            place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
            self.text = np.zeros((len(keys), width + 1), np.uint8)
            self.text[known, 0] = ord(":")
            self.text[row, place + 1] = data
            self.text[np.arange(len(keys)), self.size] = 0x80  # the mark behind a text

    def hashed(self, prefix: bytes) -> np.ndarray:
        """The first 64 bits of the MD5 of every text behind ``prefix``."""
        if self.text is None or len(prefix) + self.text.shape[1] > ONE_BLOCK + 1:
            texts = [prefix + (b"" if k is None else b":" + k.encode()) for k in self.keys.to_pylist()]
            return np.frombuffer(b"".join([md5(t).digest() for t in texts]), ">u8")[::2].astype(np.uint64)
        used = len(prefix) + self.text.shape[1]
        block = np.zeros((len(self.text), -(-used // 4) * 4), np.uint8)
        block[:, :len(prefix)] = np.frombuffer(prefix, np.uint8)
        block[:, len(prefix):used] = self.text
        words: list[np.ndarray | None] = [np.ascontiguousarray(c, np.uint32) for c in block.view("<u4").T]
        words += [None] * (16 - len(words))  # zeros
        words[14] = (8 * (len(prefix) + self.size)).astype(np.uint32)
        first, second = _md5_block(words)
        return (first.byteswap().astype(np.uint64) << np.uint64(32)) | second.byteswap()


def _md5_block(words: Sequence[np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """The first two words of the MD5 (RFC 1321) of many texts of one block, given as 16 words each."""
    start = [np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = (np.full(len(words[0]), v) for v in start)
    f, high = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
            word = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
            word = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
            word = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
            word = words[7 * i % 16]
        f += a
        f += np.uint32(MD5_ADDED[i])
        if word is not None:
            f += word
        np.right_shift(f, np.uint32(32 - MD5_TURNS[i]), out=high)
        np.left_shift(f, np.uint32(MD5_TURNS[i]), out=f)
        f |= high
        f += b
        a, b, c, d, f = d, f, b, c, a
    return a + start[0], b + start[1]


def _drawn(params: ForestParams, edges: Sequence[Sequence[float]] | None):
    """Rows of key, time, event and features -> the same without the key, with the trees that draw them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, tree, w = _draws(batch.column("key"), params)
            starts = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            x = _matrix([c.to_numpy(zero_copy_only=False) for c in batch.columns[3:]], edges)
            lists = [pa.ListArray.from_arrays(starts, pa.array(v, pa.int32())) for v in (tree, w)]
            yield pa.RecordBatch.from_arrays([batch.column("time"), batch.column("event"), *map(pa.array, np.ascontiguousarray(x.T)), *lists],
                                             ["time", "event", *batch.schema.names[3:], "tree", "w"])
    return run


def bootstrap(rows: DataFrame, params: ForestParams) -> DataFrame:
    """One row per (row, tree) drawn, weighted by a Poisson count from a hash of tree and column ``key``."""
    _below(params)

    @F.pandas_udf("array<struct<tree:int,w:int>>")
    def draws(keys: pd.Series) -> pd.Series:
        row, tree, w = _draws(pa.array(keys, pa.string(), from_pandas=True), params)
        ends = np.searchsorted(row, np.arange(len(keys) + 1))
        return pd.Series([[{"tree": t, "w": n} for t, n in zip(tree[a:b].tolist(), w[a:b].tolist())] for a, b in zip(ends[:-1], ends[1:])])

    return rows.withColumn("__draws", draws(F.col("key").cast("string"))).select(*rows.columns, F.inline("__draws"))


def _tree_arrays(splits: pd.DataFrame, trees: int, mortality: pd.DataFrame | None = None) -> Column:
    """Constant array of trees, each as arrays over its nodes, the root first.

    A node has a feature (-1: leaf), a cut, the place of its left child (the right one follows),
    its heap number and its mortality. They reach the executors as one constant of the plan.
    """
    of_tree = {t: {n: (f, c) for n, f, c in own[["node", "feature", "cut"]].itertuples(index=False)} for t, own in splits.groupby("tree")}
    deaths = {} if mortality is None else dict(zip(zip(mortality["tree"], mortality["node"]), mortality["mortality"]))
    rows = []
    for t in range(trees):
        own, nodes, child = of_tree.get(t, {}), [1], []
        for node in nodes:  # grows as it goes
            child.append(len(nodes))
            if node in own:
                nodes += [2 * node, 2 * node + 1]
        rows.append({"feature": [int(own[n][0]) if n in own else -1 for n in nodes], "cut": [float(own[n][1]) if n in own else 0.0 for n in nodes],
                     "child": child, "node": nodes, "mortality": [float(deaths.get((t, n), 0.0)) for n in nodes]})
    kind = "feature:array<int>,cut:array<double>,child:array<int>,node:array<int>,mortality:array<double>"
    return F.from_json(F.lit(json.dumps(rows)), f"array<struct<{kind}>>")


def _leaf(x: Column, tree: Column, depth: int) -> Column:
    """(node, mortality) that the values ``x`` reach in at most ``depth`` levels of a tree."""
    def step(at: Column, _: Column) -> Column:
        f = F.get(tree["feature"], at)
        return F.when(f < 0, at).otherwise(F.get(tree["child"], at) + (F.get(x, f) > F.get(tree["cut"], at)).cast("int"))

    def reached(at: Column) -> Column:
        return F.struct(F.get(tree["node"], at).alias("node"), F.get(tree["mortality"], at).alias("mortality"))

    return F.aggregate(F.slice(F.array(*[F.lit(i) for i in range(max(1, depth))]), 1, depth), F.lit(0), step, reached)


def _ensemble(spark: SparkSession, splits: pd.DataFrame, mortality: pd.DataFrame, trees: int, features: int,
              known: Sequence[int] = ()) -> RandomForestRegressionModel:
    """The trees as a model of Spark's that predicts the mean mortality, read from the form in which Spark saves one.

    Spark sends NaN, here a missing value, to the right. So before a path first goes to the right of a cut of a
    feature, it asks whether the value is at most infinity; if not, the prediction is NaN. Features in ``known`` miss no value.
    """
    never = sum(1 << f for f in known)
    of_tree = {t: {n: (int(f), float(c)) for n, f, c in own[["node", "feature", "cut"]].itertuples(index=False)} for t, own in splits.groupby("tree")}
    deaths = dict(zip(zip(mortality["tree"], mortality["node"]), mortality["mortality"]))
    rows: list[tuple[int, int, float, int, int, int, float]] = []  # tree, place, prediction, children, feature, cut
    for t in range(trees):
        own, nodes = of_tree.get(t, {}), [(1, -1, never)]  # heap number (0: value missing), the feature to ask for, bits of those asked
        for i, (node, ask, asked) in enumerate(nodes):  # grows as it goes
            feature, edge, below = -1, 0.0, []
            if ask >= 0:
                feature, edge, below = ask, math.inf, [(node, -1, asked), (0, -1, asked)]
            elif node in own:
                feature, edge = own[node]
                more = asked | 1 << feature
                below = [(2 * node, -1, more), (2 * node + 1, -1 if more == asked else feature, more)]
            left = len(nodes) if below else -1
            nodes += below
            rows.append((t, i, float(deaths.get((t, node), 0.0)) if node else math.nan, left, left + 1 if below else -1, feature, edge))
    names = ["treeID", "id", "prediction", "leftChild", "rightChild", "featureIndex", "cut"]
    kinds = [pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    table = spark.createDataFrame(pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names))
    split = F.struct("featureIndex", F.array("cut").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", F.lit(0.0).alias("impurity"), F.array(*[F.lit(0.0)] * 3).alias("impurityStats"), F.lit(0).cast("long").alias("rawCount"),
                    F.lit(0.0).alias("gain"), "leftChild", "rightChild", split.alias("split"))

    def saved(kind: str, uid: str, **params) -> str:
        return json.dumps({"class": f"org.apache.spark.ml.regression.{kind}", "timestamp": 0, "sparkVersion": spark.version, "uid": uid,
                           "paramMap": {"impurity": "variance", **params}, "defaultParamMap": {}, "numFeatures": features, "numTrees": trees})

    path = scratch_path(spark, "forest")
    try:
        spark.createDataFrame([(saved("RandomForestRegressionModel", "forest", numTrees=trees),)], "value string").coalesce(1).write.text(f"{path}/metadata")
        spark.createDataFrame([(t, saved("DecisionTreeRegressionModel", f"tree_{t}"), 1.0) for t in range(trees)],
                              "_1 int, _2 string, _3 double").write.parquet(f"{path}/treesMetadata")
        table.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/data")
        return RandomForestRegressionModel.load(path)
    finally:
        remove_path(spark, path)


class _Trees:
    """The nodes of several trees, each tree's root first, as arrays by place.

    A node has a feature (-1: leaf), a cut, the place of its left child (the right one follows), its
    tree, heap number and mortality. The last place is no node: rows get there that lack a value.
    """

    def __init__(self, splits: pd.DataFrame, trees: int, mortality: pd.DataFrame | None = None):
        of_tree = {t: {n: (f, c) for n, f, c in own[["node", "feature", "cut"]].itertuples(index=False)} for t, own in splits.groupby("tree")}
        deaths = {} if mortality is None else dict(zip(zip(mortality["tree"], mortality["node"]), mortality["mortality"]))
        roots, rows = [], []
        for t in range(trees):
            own, nodes, first = of_tree.get(t, {}), [1], len(rows)
            roots.append(first)
            for node in nodes:  # grows as it goes
                feature, at = own.get(node, (-1, 0.0))
                rows.append((feature, at, first + len(nodes), t, node, deaths.get((t, node), 0.0)))
                if node in own:
                    nodes += [2 * node, 2 * node + 1]
        rows.append((-1, 0.0, 0, -1, -1, math.nan))
        feature, at, child, tree, node, mortality = zip(*rows)
        self.roots, self.feature, self.child, self.tree, self.node = (np.array(v, dtype=int) for v in (roots, feature, child, tree, node))
        self.cut, self.mortality = np.array(at, dtype=float), np.array(mortality, dtype=float)
        self.levels = np.array([int(self.node[a:b].max()).bit_length() - 1 for a, b in zip(roots, [*roots[1:], len(self.node) - 1])], dtype=int)

    def reached(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Tree by tree, the places that all rows of ``x`` reach.

        All rows take as many steps as the tree has levels: a leaf's step leads to itself. So a step is
        a few lookups by place, with no choice of rows.
        """
        leaf = self.feature < 0
        feature, edge = np.where(leaf, 0, self.feature), np.where(leaf, math.inf, self.cut)
        child = np.where(leaf, np.arange(len(leaf)), self.child)
        lacking = np.flatnonzero(np.isnan(x).any(axis=1))
        values, first = np.ascontiguousarray(x).ravel(), np.arange(len(x)) * x.shape[1]
        for t, (root, levels) in enumerate(zip(self.roots, self.levels)):
            at = np.full(len(x), root)
            for _ in range(levels):
                right = values.take(first + feature.take(at)) > edge.take(at)
                at = child.take(at)
                at += right
            if len(lacking):
                at[lacking] = self.walk(x, lacking, np.full(len(lacking), t))
            yield at

    def walk(self, x: np.ndarray, row: np.ndarray, tree: np.ndarray) -> np.ndarray:
        """The places that rows of ``x`` reach in their trees."""
        at = self.roots[tree]
        inner = np.arange(len(at))
        while len(inner):
            here = at[inner]
            feature = self.feature[here]
            inner, here, feature = (v[feature >= 0] for v in (inner, here, feature))
            value = x[row[inner], feature]
            at[inner] = np.where(np.isnan(value), len(self.node) - 1, self.child[here] + (value > self.cut[here]))
        return at


LEAF_COUNTS = "tree int, node int, n long"
NODE_COUNTS = "tree int, node int, time double, n long, d long"
CELLS = "part long, slot long, feature long, range long, value double, time double, rows long, n long, d long"
BEST = "tree long, node long, feature long, cut double, left long, right long"
KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}


def _batch(columns: Sequence[np.ndarray], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(KINDS[kind]) for c, (_, kind) in zip(columns, fields)], [name for name, _ in fields])


def _summed(blocks: Iterator[list[np.ndarray]], keys: int) -> Iterator[list[np.ndarray]]:
    """Blocks of columns, the first ``keys`` of which name a cell: the others summed, as far as a task holds them."""
    held, size = [], 0

    def sums() -> list[np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(columns[:keys])
        columns = [c[order] for c in columns]
        new = np.ones(len(order), bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in columns[:keys]], axis=0)
        first = np.flatnonzero(new)
        return [c[first] for c in columns[:keys]] + [np.add.reduceat(c, first) for c in columns[keys:]]

    for block in blocks:
        if len(block[0]):
            held.append(block)
            size += len(block[0])
        if size > HELD_CELLS:
            held = [sums()]
            size = len(held[0][0])
            if size > HELD_CELLS // 2:
                yield held[0]
                held, size = [], 0
    if held:
        yield sums()


def tried_features(seed: int, tree: int, node: int, n: int, most: int) -> list[int]:
    """``most`` of ``n`` features for a node: those with the smallest hash."""
    def place(i: int) -> str:
        return hashlib.md5(f"{seed}:{tree}:{node}:{i}".encode()).hexdigest()
    return sorted(range(n), key=place)[:most]


def _chooser(models: Sequence[Sequence[int]], params: ForestParams):
    """The features tried at a node of a tree."""
    def tried(tree: int, node: int) -> list[int]:
        own = models[tree // params.trees]
        most = params.max_features or max(1, int(math.sqrt(len(own))))
        return [own[i] for i in tried_features(params.seed, tree % params.trees, node, len(own), most)]
    return tried


class _Grower:
    """Grows the trees of several models; tree m * trees + t is tree t of model m.

    ``rows`` has time, event, the features as x0, x1, .. and the lists tree and w of its draws.
    """

    def __init__(self, rows: DataFrame, models: Sequence[Sequence[int]], params: ForestParams, features: int):
        self.rows, self.models, self.params, self.features = rows, models, params, features
        self.splits = pd.DataFrame({"tree": pd.Series(dtype=int), "node": pd.Series(dtype=int), "feature": pd.Series(dtype=int),
                                    "cut": pd.Series(dtype=float)})
        self.bounds: list[np.ndarray] = []  # of each feature's ranges

    def _placed(self):
        """A function of batches: x and (row, place, time, event, w) of every draw, at the nodes grown so far."""
        models, own = len(self.models), self.params.trees
        trees, features = _Trees(self.splits, models * own), self.features

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                x = _matrix([batch.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(features)])
                row = np.repeat(np.arange(len(x)), batch.column("tree").value_lengths().to_numpy())
                tree, w = (batch.column(c).flatten().to_numpy() for c in ("tree", "w"))
                time, event = (batch.column(c).to_numpy(zero_copy_only=False)[row] for c in ("time", "event"))
                for m in range(models):  # the same draws for all
                    yield x, row, trees.walk(x, row, tree + m * own), time, event, w

        return trees, run

    def leaf_counts(self) -> DataFrame:
        """tree, node, time, n, d of the drawn rows at the leaves, summed within tasks."""
        trees, placed = self._placed()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks = ([time, place, w.astype(np.int64), w * event] for _, _, place, time, event, w in placed(batches))
            for time, place, n, d in _summed(blocks, 2):
                yield _batch([trees.tree[place], trees.node[place], time, n, d], NODE_COUNTS)

        return self.rows.mapInArrow(count, NODE_COUNTS)

    def grow(self) -> None:
        trees = self.params.trees
        sizes = {r["tree"]: r["n"] for r in self.rows.select(F.explode("tree").alias("tree")).groupBy("tree").agg(F.count("*").alias("n")).collect()}
        open_nodes = {(t, 1): sizes.get(t % trees, 0) for t in range(len(self.models) * trees)}
        small = {}
        for depth in range(self.params.max_depth):
            large = {at: size for at, size in open_nodes.items() if size > ROWS_PER_NODE}
            small.update({at: size for at, size in open_nodes.items() if at not in large})
            if not large:
                break
            if not self.bounds:
                self.bounds = self._ranges(max(large.values()))
            best = self._best_splits(large)
            self.splits = pd.concat([self.splits, best[["tree", "node", "feature", "cut"]]], ignore_index=True)
            need = max(self.params.min_split, 2 * self.params.min_leaf)
            open_nodes = {(t, 2 * n + side): size for t, n, left, right in best[["tree", "node", "left", "right"]].itertuples(index=False)
                          for side, size in ((0, left), (1, right)) if size >= need and depth + 1 < self.params.max_depth}
        if small and self.params.max_depth > 0:
            below = self._below(small)
            self.splits = pd.concat([self.splits, below[["tree", "node", "feature", "cut"]]], ignore_index=True)
        self.splits = self.splits.sort_values(["tree", "node"], ignore_index=True)

    def _ranges(self, rows: int) -> list[np.ndarray]:
        """For each feature, bounds that cut its values into ranges of about ``CELLS_PER_TASK`` of ``rows`` rows."""
        n = max(2, -(-rows // CELLS_PER_TASK))
        probs = [i / n for i in range(1, n)]
        found = self.rows.agg(*[F.percentile_approx(f"x{i}", probs, max(10_000, 10 * n)).alias(f"x{i}") for i in range(self.features)]).head()
        return [np.unique(np.array(bounds, dtype=float)) for bounds in found]

    def _best_splits(self, nodes: Mapping[tuple[int, int], int]) -> pd.DataFrame:
        """tree, node, feature, cut, left, right (rows) of the large ``nodes`` that have a split."""
        names = list(nodes)
        choose = _chooser(self.models, self.params)
        tried = {name: choose(*name) for name in names}
        width = max(len(t) for t in tried.values())
        wanted = np.array([t + [-1] * (width - len(t)) for t in tried.values()])
        trees, placed = self._placed()
        numbers = {name: i for i, name in enumerate(names)}
        slots = np.array([numbers.get(name, -1) for name in zip(trees.tree.tolist(), trees.node.tolist())])
        bounds, features = self.bounds, self.features
        ranges = max(len(b) for b in bounds) + 1
        parts = max(1, -(-sum(nodes.values()) * width // CELLS_PER_TASK))

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
            for x, row, place, time, event, w in placed(batches):
                keep = np.flatnonzero(slots[place] >= 0)
                row, slot, time, n = row[keep], slots[place[keep]], time[keep], w[keep].astype(np.int64)
                d, of = n * event[keep], np.column_stack([np.searchsorted(b, v) for b, v in zip(bounds, x.T)])
                for k in range(width):
                    some = np.flatnonzero(wanted[slot, k] >= 0)
                    f = wanted[slot[some], k]
                    # slot, feature and range as one number: fewer columns to sort by
                    place_of = (slot[some] * features + f) * ranges + of[row[some], f]
                    yield [time[some], x[row[some], f], place_of, np.ones(len(some), np.int64), n[some], d[some]]

        def names_of(number):  # part (neighbours go to different tasks), slot, feature, range
            return [number % parts, number // (features * ranges), number // ranges % features, number % ranges]

        def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for time, value, number, rows, n, d in _summed(cells(batches), 3):
                yield _batch([*names_of(number), value, time, rows, n, d], CELLS)

        def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for time, number, rows, n, d in _summed(([t, *rest] for t, _, *rest in cells(batches)), 2):
                yield _batch([*names_of(number), time, time, rows, n, d], CELLS)

        # each range also gets all smaller and all larger values, at minus and plus infinity
        counts = [F.sum(c).alias(c) for c in ("rows", "n", "d")]
        sums = self.rows.mapInArrow(totals, CELLS).groupBy("slot", "feature", "range", "time").agg(*counts)
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long")))
        infinite = F.when(F.col("own") < F.col("range"), F.lit(-math.inf)).otherwise(F.lit(math.inf))
        beside = (sums.withColumnRenamed("range", "own").withColumn("range", others).where("range <> own")
                  .groupBy("slot", "feature", "range", infinite.alias("value"), "time").agg(*counts)
                  .withColumn("part", F.pmod((F.col("slot") * features + F.col("feature")) * ranges + F.col("range"), F.lit(parts))))
        both = self.rows.mapInArrow(values, CELLS).unionByName(beside)
        scores = both.groupBy("part").applyInPandas(_scorer(self.params), "slot long, feature long, cut double, left long, right long, stat double")
        order = F.struct("stat", -F.col("feature"), -F.col("cut"))  # ties: the first feature, the lowest cut
        best = scores.groupBy("slot").agg(F.max_by(F.struct("feature", "cut", "left", "right"), order).alias("s"))
        best = best.select("slot", "s.*").orderBy("slot").toPandas()
        return best.assign(tree=[names[i][0] for i in best["slot"]], node=[names[i][1] for i in best["slot"]])

    def _below(self, nodes: Mapping[tuple[int, int], int]) -> pd.DataFrame:
        """All splits at and below ``nodes``, each of which one task can hold."""
        trees, placed = self._placed()
        wanted = np.array([name in nodes for name in zip(trees.tree.tolist(), trees.node.tolist())])
        names = [f"x{i}" for i in range(self.features)]
        schema = ", ".join(["tree int", "node int", "time double", "event int", "w int", *[f"{c} double" for c in names]])

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x, row, place, time, event, w in placed(batches):
                keep = np.flatnonzero(wanted[place])
                at = place[keep]
                yield _batch([trees.tree[at], trees.node[at], time[keep], event[keep], w[keep], *x[row[keep]].T], schema)

        params, tried = self.params, _chooser(self.models, self.params)

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            return _subtree(pdf, names, params, tried)

        return self.rows.mapInArrow(send, schema).groupBy("tree", "node").applyInPandas(grow, BEST).toPandas()


def _subtree(pdf: pd.DataFrame, names: Sequence[str], params: ForestParams, tried) -> pd.DataFrame:
    """The splits at and below one node, from its drawn rows (runs in the executors).

    A feature's values are sorted once; a level deals them to its nodes in that order. Where a level
    has fewer (node, value, time) than rows, its rows are counted instead.
    """
    tree, root = int(pdf["tree"].iat[0]), int(pdf["node"].iat[0])
    x = pdf[list(names)].to_numpy(float)
    times, time = np.unique(pdf["time"].to_numpy(), return_inverse=True)
    w = pdf["w"].to_numpy(float)
    d = w * pdf["event"].to_numpy(float)
    del pdf
    ones = np.ones(len(x))
    sorted_by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}  # feature: order, rank, values

    def values_of(f: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if f not in sorted_by:
            order = np.argsort(x[:, f], kind="stable").astype(np.int32)
            value = x[order, f]
            new = np.r_[True, value[1:] != value[:-1]]
            rank = np.empty(len(x), np.int32)
            rank[order] = np.cumsum(new) - 1
            sorted_by[f] = order, rank, value[new]
        return sorted_by[f]

    place, nodes, out = np.zeros(len(x), np.int32), [root], []  # place -1: in no node that is cut again
    need = max(params.min_split, 2 * params.min_leaf)
    while nodes and nodes[0].bit_length() <= params.max_depth:
        tries = np.zeros((len(nodes) + 1, x.shape[1]), bool)  # the last one for rows in no node
        for i, node in enumerate(nodes):
            tries[i, tried(tree, node)] = True
        found = []
        for f in np.flatnonzero(tries.any(axis=0)).tolist():
            order, rank, value = values_of(f)
            own = np.flatnonzero(tries[:, f])
            number = np.zeros(len(tries), np.uint16 if len(own) < 2**16 else np.int64)  # short ones sort in linear time
            number[own] = np.arange(len(own))
            rows = np.flatnonzero(tries[place, f])
            cells = len(own) * len(value) * len(times)
            if cells <= len(rows):
                cell = (number[place[rows]].astype(np.int64) * len(value) + rank[rows]) * len(times) + time[rows]
                count = np.bincount(cell, minlength=cells)
                some = np.flatnonzero(count)
                group, at = some // (len(value) * len(times)), some // len(times) % len(value)
                sums = (np.bincount(cell, c[rows], cells)[some] for c in (w, d))
                best = _best_cuts(group, value[at], some % len(times), len(times), count[some].astype(float), *sums, params)
            else:
                at = place[order]
                rows = np.flatnonzero(tries[at, f])
                group = number[at[rows]]
                dealt = np.argsort(group, kind="stable")
                group, rows = group[dealt].astype(np.int64), order[rows[dealt]]
                best = _best_cuts(group, value[rank[rows]], time[rows], len(times), ones[rows], w[rows], d[rows], params)
            found.append(best.assign(place=own[best["group"].to_numpy()], feature=f))
        best = pd.concat(found, ignore_index=True)
        best = best.sort_values(["place", "stat", "feature", "cut"], ascending=[True, False, True, True]).drop_duplicates("place")
        out.append(pd.DataFrame({"tree": tree, "node": [nodes[i] for i in best["place"]], "feature": best["feature"], "cut": best["cut"],
                                 "left": best["left"], "right": best["right"]}))
        # rows of nodes that were cut go on to those children that can be cut again
        split, cuts = np.zeros(len(tries), int), np.full(len(tries), math.nan)
        split[best["place"]], cuts[best["place"]] = best["feature"], best["cut"]
        below = np.full((len(tries), 2), -1, np.int32)
        following = []
        for i, left, right in best[["place", "left", "right"]].itertuples(index=False):
            for side, n in ((0, left), (1, right)):
                if n >= need:
                    below[i, side] = len(following)
                    following.append(2 * nodes[i] + side)
        right = x[np.arange(len(x)), split[place]] > cuts[place]
        place = below[place, right.astype(int)]
        nodes = following
    return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=[f.split()[0] for f in BEST.split(", ")])


def _scorer(params: ForestParams):
    """Best log-rank split per (slot, feature, range) from counts per value and time (runs in the executors)."""
    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["slot", "feature", "range", "value"], kind="stable")
        names = pdf[["slot", "feature", "range"]].to_numpy()
        first = np.flatnonzero(np.r_[True, (names[1:] != names[:-1]).any(axis=1)])
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(pdf)]))
        times, time = np.unique(pdf["time"].to_numpy(), return_inverse=True)
        best = _best_cuts(group, pdf["value"].to_numpy(), time, len(times), *(pdf[c].to_numpy(float) for c in ("rows", "n", "d")), params)
        of = names[first[best["group"]]]
        return best.assign(slot=of[:, 0], feature=of[:, 1])[["slot", "feature", "cut", "left", "right", "stat"]]

    return score


def _best_cuts(group: np.ndarray, value: np.ndarray, time: np.ndarray, times: int, rows: np.ndarray, n: np.ndarray, d: np.ndarray,
               params: ForestParams) -> pd.DataFrame:
    """group, cut, left, right (rows), stat: the best cut of every group that has one, at equal statistics the lowest.

    Cells stand by group (0, 1, ..) and value; ``time`` numbers the times in ascending order.
    """
    left = _cumulative(rows, group)
    every = np.bincount(group, rows)[group]
    last = np.r_[(value[1:] != value[:-1]) | (group[1:] != group[:-1]), True]
    at = np.flatnonzero(last & np.isfinite(value) & (left >= params.min_leaf) & (every - left >= params.min_leaf) & (every >= params.min_split))
    if times <= FEW_TIMES:
        u, v = _logrank_by_time(group, time, times, n, d, at)
    else:
        u, v = (a[at] for a in _logrank(group, time, n, d))
    with np.errstate(divide="ignore", invalid="ignore"):
        # equal splits have equal statistics but for rounding errors
        stat = np.round(np.where((v > 1e-12) & (np.abs(u) > 1e-9), np.abs(u) / np.sqrt(v), 0.0), 9)
    # cells stand by value: of a group's largest statistics, the first is that of the lowest cut
    own = group[at]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:len(own)])
    top = np.maximum.reduceat(stat, first) if len(first) else stat
    some = np.flatnonzero((stat > 0) & (stat == np.repeat(top, np.diff(np.r_[first, len(own)]))))
    some = some[np.r_[True, own[some[1:]] != own[some[:-1]]][:len(some)]]
    at = at[some]
    return pd.DataFrame({"group": group[at], "cut": value[at], "left": left[at].astype(int), "right": (every - left)[at].astype(int), "stat": stat[some]})


def _logrank_by_time(group: np.ndarray, time: np.ndarray, times: int, n: np.ndarray, d: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What :func:`_logrank` gives behind the cells ``at``, from whole counts at each time."""
    cell, groups = group * times + time, int(group.max(initial=-1)) + 1
    alive, died = (np.bincount(cell, c, groups * times).reshape(groups, times) for c in (n, d))
    risk = alive[:, ::-1].cumsum(axis=1)[:, ::-1]
    some = np.maximum(risk, 1)
    hazard = died / some
    b = np.where(risk > 1, died * (risk - died) / np.maximum(risk - 1, 1), 0.0) / some**2
    of, u, v = group[at], np.zeros(len(at)), np.zeros(len(at))
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]][:len(group)])
    run = np.searchsorted(first, at, side="right") - 1

    def upto(x: np.ndarray) -> np.ndarray:  # running sums within groups, behind the cells ``at``
        total = np.cumsum(x)
        return total[at] - (total[first] - x[first])[run]

    for t in np.flatnonzero(died.any(axis=0)):
        under = upto(np.where(time >= t, n, 0.0))
        u += upto(np.where(time == t, d, 0.0)) - under * hazard[of, t]
        v += b[of, t] * (under * risk[of, t] - under * under)
    return u, v


def _cumulative(x: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Running sums that start anew with every group (ascending numbers)."""
    total = np.cumsum(x)
    first = np.r_[True, group[1:] != group[:-1]]
    before = (total - x)[first]
    return total - before[np.cumsum(first) - 1]


def _logrank(group: np.ndarray, time: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-rank numerator and variance of cutting each group behind each of its cells.

    Cells (time, n rows of which d died then) stand in the order of their values. With y at risk
    and d dead in the whole group at a time, hazard d / y and b = d (y - d) / ((y - 1) y^2), a
    cell on the left adds d - n H(time) to the numerator, H the summed hazard up to its time. The
    variance sums b (y1 y - y1^2) over times, y1 at risk on the left: the first part adds up over
    cells; the square couples each cell with those before it, by B(the earlier time of both), B
    the sum of b.
    """
    order = np.lexsort((time, group))
    g, t = group[order], time[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (t[1:] != t[:-1])]
    slot = np.cumsum(new) - 1  # of a (group, time)
    owner = g[new]
    at, died = np.bincount(slot, n[order]), np.bincount(slot, d[order])
    risk = _cumulative(at[::-1], owner[::-1])[::-1]
    b = np.where(risk > 1, died * (risk - died) / np.maximum(risk - 1, 1), 0.0) / risk**2
    hazard, linear, square = (_cumulative(x, owner) for x in (died / risk, b * risk, b))
    place = np.empty(len(group), int)
    place[order] = slot
    first_slot = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    rank = place - first_slot[np.searchsorted(owner[first_slot], group)]
    u = _cumulative(d - n * hazard[place], group)
    own = square[place]
    sooner, sooner_n = _sooner(group, rank, np.stack((n * own, n)))
    later_n = _cumulative(n, group) - n - sooner_n
    pairs = _cumulative(n * n * own + 2 * n * (sooner + own * later_n), group)
    return u, _cumulative(n * linear[place], group) - pairs


def _sooner(group: np.ndarray, rank: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each cell, the sums of ``weights`` over earlier cells of its group with a smaller rank.

    Two ranks part at the highest bit where they differ: a running sum per bit counts all such pairs.
    """
    total = np.zeros_like(weights)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        prefix = rank >> (bit + 1)
        order = np.lexsort((prefix, group))  # stable: keeps the order of the cells
        high = (rank[order] >> bit) & 1 == 1
        run = np.r_[True, (np.diff(group[order]) != 0) | (np.diff(prefix[order]) != 0)].cumsum() - 1
        for k in range(len(weights)):
            low = np.where(high, 0.0, weights[k][order])
            total[k][order] += np.where(high, _cumulative(low, run), 0.0)
    return total


def _leaf_steps(counts: DataFrame) -> DataFrame:
    """Per leaf and event time: hazard increment and fall of the survival curve."""
    leaf = Window.partitionBy("tree", "node")  # at most one row per month of age
    cells = counts.groupBy("tree", "node", "time").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    risk = F.sum("n").over(leaf.orderBy(F.desc("time")))
    hazard = F.col("d") / F.col("at_risk")
    steps = cells.withColumn("at_risk", risk).where("d > 0").withColumn("hazard", hazard)
    # survival before and after the step; a hazard of 1 sends it to zero
    keep = F.log(F.when(F.col("hazard") < 1, 1 - F.col("hazard")))
    done = F.max((F.col("hazard") >= 1).cast("int"))
    upto = leaf.orderBy("time")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    alive = F.exp(F.coalesce(F.sum(keep).over(before), F.lit(0.0)))
    alive = F.when(F.coalesce(done.over(before), F.lit(0)) == 1, 0.0).otherwise(alive)
    return (steps.withColumn("drop", alive * F.col("hazard"))
            .select("tree", "node", "time", "hazard", "drop"))
