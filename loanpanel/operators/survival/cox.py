"""Cox proportional hazards as a distributed Newton iteration.

Every evaluation is one job: blocks of rows are reduced to sums per distinct time, and only
those sums are accumulated over the risk sets, from the last time back: totals by range of
times, a scan of the totals, then the times within each range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loanpanel.functions.stats import order_bucket, running_sum
from loanpanel.operators.survival.table import Z95

HELD_CELLS = 4_096  # (time, event) sums a task holds before it sends them
BLOCK_BYTES = 16_384  # features of one block; an Arrow batch has 10,000 blocks at most


class CoxFitError(RuntimeError):
    """The iteration did not converge."""


def linear_predictor(beta: Mapping[str, float]) -> Column:
    return sum((F.col(c) * float(b) for c, b in beta.items()), F.lit(0.0))


@dataclass(frozen=True)
class Evaluation:
    """Partial log-likelihood with gradient and Hessian at some coefficients."""

    log_likelihood: float
    gradient: np.ndarray
    hessian: np.ndarray
    rows: int
    events: int

def _blocks(df: DataFrame, features: Sequence[str], event: str, duration: str) -> DataFrame:
    """``(t, e, n, x)``: up to ``n`` rows of one time and event, their features as bytes of doubles, row by row.

    Each Arrow batch is sorted once, here, and not at every evaluation. Rows without time count nowhere.
    """
    p = len(features)
    most = max(1, BLOCK_BYTES // (8 * max(1, p)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten()
            if flat.null_count:
                raise ValueError("features must not be null")
            x = flat.to_numpy().reshape(len(batch), p)
            t, e = batch.column("t").to_numpy(), batch.column("e").to_numpy()
            order = np.lexsort((e, t))
            x, t, e = np.ascontiguousarray(x[order]), t[order], e[order]
            at = np.arange(len(t))
            new = np.r_[True, (t[1:] != t[:-1]) | (e[1:] != e[:-1])][:len(t)]
            first = np.flatnonzero(new | ((at - np.maximum.accumulate(np.where(new, at, 0))) % most == 0))
            bounds = np.append(first, len(t))
            rows = pa.Array.from_buffers(pa.binary(), len(first), [
                None, pa.py_buffer((bounds * (8 * p)).astype(np.int32)), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(t[first]), pa.array(e[first]), pa.array(np.diff(bounds).astype(np.int32)), rows], ["t", "e", "n", "x"])

    rows = df.select(F.col(duration).cast("double").alias("t"),
                     F.coalesce(F.col(event).cast("int") == 1, F.lit(False)).cast("int").alias("e"),
                     F.array(*[F.col(c).cast("double") for c in features]).cast("array<double>").alias("x"))
    known = rows.where(F.col("t").isNotNull() & ~F.isnan("t"))
    return known.mapInArrow(pack, "t double, e int, n int, x binary")


def _time_sums(blocks: DataFrame, beta: Sequence[float]) -> DataFrame:
    """Per (time, event): v, the sums of 1, w, w x, w x x' (lower triangle) and x, from :func:`_blocks`.

    A task sends one row per cell, or a few more where it meets more than ``HELD_CELLS`` cells.
    """
    p, b = len(beta), np.asarray(beta, dtype=float)
    lower = np.tril_indices(p)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def sent() -> pa.RecordBatch:
            v = pa.array([np.concatenate([[n, w], wx, wxx[lower], x]) for n, w, wx, wxx, x in held.values()],
                         pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in held], pa.float64()), pa.array([k[1] for k in held], pa.int32()), v],
                ["t", "e", "v"])

        for batch in batches:
            t, e, n = (batch.column(c).to_pylist() for c in ("t", "e", "n"))
            x = np.frombuffer(b"".join(batch.column("x").to_pylist())).reshape(sum(n), p)
            w = np.exp(x @ b)
            k = 0
            for key, size in zip(zip(t, e), n):
                i, k = k, k + size
                rows, weights = x[i:k], w[i:k]
                weighted = rows * weights[:, None]
                cell = [size, weights.sum(), weighted.sum(axis=0), weighted.T @ rows, rows.sum(axis=0)]
                held[key] = [a + c for a, c in zip(held[key], cell)] if key in held else cell
            if len(held) > HELD_CELLS:
                yield sent()
                held = {}
        if held:
            yield sent()

    parts = (blocks.mapInArrow(sums, "t double, e int, v array<double>")
             .withColumn("b", order_bucket(F.col("t"), 256)))
    # one exchange, by range: the cells, the ranges' totals and the last walk all keep to it
    return parts.repartition("b").groupBy("b", "t", "e").agg(_vector_sum("v").alias("v"))


def _vector_sum(c: str) -> Column:
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(c))["sum"])


def _later_sums(totals: DataFrame) -> DataFrame:
    """``(b, later)``: the sums of all later ranges, by a scan of the ranges' totals.

    There are at most 256 ranges for a power of two of the times; the scan holds one of them.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        later = 0.0
        for batch in batches:
            out = []
            for v in batch.column("v"):
                v = v.values.to_numpy()
                out.append(np.zeros(len(v)) + later)
                later = out[-1] + v
            yield pa.RecordBatch.from_arrays([batch.column("b"), pa.array(out, pa.list_(pa.float64()))], ["b", "later"])

    return (totals.repartition(1).sortWithinPartitions(F.desc("b"))
            .mapInArrow(scan, "b long, later array<double>"))


def evaluate(df: DataFrame, beta: Mapping[str, float], event: str = "survival_event",
             duration: str = "survival_time", ties: str = "efron") -> Evaluation:
    """Log-likelihood, gradient and Hessian at ``beta``: one job over the rows."""
    return _evaluate(_blocks(df, list(beta), event, duration), list(beta.values()), ties)


def _evaluate(blocks: DataFrame, b: Sequence[float], ties: str) -> Evaluation:
    """:func:`evaluate` over the rows of :func:`_blocks`.

    Sums per time are accumulated over the risk sets range by range, each from the sums of the
    later ranges. No task holds more than a few times' sums; the driver gets one row per task.
    """
    p = len(b)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ll, grad, hess, rows, events = _accumulate(_cells(batches), p, b, ties)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ll]), pa.array([grad]), pa.array([hess.ravel()]), pa.array([rows], pa.int64()),
             pa.array([events], pa.int64())], ["ll", "grad", "hess", "rows", "events"])

    # kept for the two uses in the job below: Spark does not see that both are the same exchange
    sums = _time_sums(blocks, b).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        later = _later_sums(sums.groupBy("b").agg(_vector_sum("v").alias("v")))
        ranged = sums.join(later, "b").repartition("b").sortWithinPartitions("b", F.desc("t"), "e")
        parts = ranged.mapInArrow(walk, "ll double, grad array<double>, hess array<double>, rows long, events long").toPandas()
    finally:
        sums.unpersist()
    return Evaluation(float(parts["ll"].sum()), np.sum(np.stack(parts["grad"]), axis=0),
                      np.sum(np.stack(parts["hess"]), axis=0).reshape(p, p),
                      int(parts["rows"].sum()), int(parts["events"].sum()))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("b", "e")]
        for b, e, v, later in zip(*keys, batch.column("v"), batch.column("later")):
            yield b, e, v.values.to_numpy(), later


def _accumulate(cells: Iterator[tuple], p: int, beta: Sequence[float], ties: str):
    """Log-likelihood terms of cells (range, event, v, later), latest time of a range first.

    A time's censored cell comes before its events, so both are in its risk set.
    """
    lower, beta = np.tril_indices(p), np.asarray(beta, dtype=float)

    def parts(v: np.ndarray):
        m = np.zeros((p, p))
        m[lower] = v[2 + p:2 + p + len(lower[0])]
        return v[1], v[2:2 + p], m + np.tril(m, -1).T

    ll, grad, hess, rows, events = 0.0, np.zeros(p), np.zeros((p, p)), 0, 0
    at, upto = None, None
    for b, event, v, later in cells:
        upto = (upto if b == at else later.values.to_numpy()) + v
        at = b
        n = round(v[0])  # vector sums of counts may miss the whole number by rounding
        rows += n
        if event != 1:
            continue
        d = n
        events += d
        s0, r1, r2 = parts(upto)
        d0, d1, d2 = parts(v)
        if ties == "efron":
            a0, a1, b0, b1, b2, logs = _efron_sums(s0, d0, d)
        else:
            a0, a1, b0, b1, b2, logs = d / s0, 0.0, d / s0**2, 0.0, 0.0, d * math.log(s0)
        x = v[len(v) - p:]
        ll += float(x @ beta) - logs
        grad += x - (r1 * a0 - d1 * a1)
        cross = np.outer(r1, d1)
        hess -= (r2 * a0 - d2 * a1) - (np.outer(r1, r1) * b0 - (cross + cross.T) * b1
                                       + np.outer(d1, d1) * b2)
    return float(ll), grad, hess, rows, events


def _efron_sums(s0: float, d0: float, d: int, near: int = 2_000) -> np.ndarray:
    """Sums over the d tied events of 1/u, f/u, 1/u^2, f/u^2, f^2/u^2, ln u with u = s0 - f d0.

    f runs over 0, 1/d, ..., (d-1)/d.  The last ``near`` terms, where u may be close to zero,
    are added one by one; the others come from the Euler-Maclaurin formula in closed form.
    """
    first = max(0, d - near)
    f = np.arange(first, d) / d
    u = s0 - f * d0
    out = np.array([(1 / u).sum(), (f / u).sum(), (1 / u**2).sum(), (f / u**2).sum(),
                    (f**2 / u**2).sum(), np.log(u).sum()])
    if not first:
        return out
    # sums of powers and of the logarithm of v = a - j, j = 0 .. first-1, with u = v * d0 / d
    step = d0 / d
    a = s0 / step
    lo, hi = a - first + 1, a

    def total(integral, value, slope, third) -> float:
        return float(integral + (value(lo) + value(hi)) / 2 + (slope(hi) - slope(lo)) / 12
                     - (third(hi) - third(lo)) / 720)

    p1 = total(math.log(hi / lo), lambda v: 1 / v, lambda v: -1 / v**2, lambda v: -6 / v**4)
    p2 = total(1 / lo - 1 / hi, lambda v: 1 / v**2, lambda v: -2 / v**3, lambda v: -24 / v**5)
    log = total(hi * math.log(hi) - lo * math.log(lo) - (hi - lo), math.log, lambda v: 1 / v, lambda v: 2 / v**3)
    # j = a - v turns sums over f = j / d into those above
    inverse, square = p1 / step, p2 / step**2
    return out + [inverse, (a * p1 - first) / (d * step), square, (a * p2 - p1) / (d * step**2),
                  (a * a * p2 - 2 * a * p1 + first) / (d * d * step**2), log + first * math.log(step)]


@dataclass(frozen=True)
class CoxModel:
    """Fitted coefficients with their covariance and fit statistics."""

    beta: dict[str, float]
    covariance: np.ndarray
    log_likelihood: float
    rows: int
    events: int
    penalizer: float
    ties: str
    iterations: int = 0
    attempt: int = 1  # which of the fallbacks gave the model, see fit_cox_with_fallback
    event: str = "survival_event"
    duration: str = "survival_time"
    gradient: np.ndarray | None = field(default=None, repr=False)

    @property
    def features(self) -> list[str]:
        return list(self.beta)

    @property
    def penalty(self) -> float:
        return 0.5 * self.penalizer * self.rows * sum(b * b for b in self.beta.values())

    @property
    def aic_partial(self) -> float:
        return -2 * (self.log_likelihood - self.penalty) + 2 * len(self.beta)

    def partial_hazard(self) -> Column:
        return F.exp(linear_predictor(self.beta))

    def hazard_ratios(self, spark, only: Sequence[str] | None = None,
                      top: int | None = None) -> DataFrame:
        """Hazard ratio with 95% limits per feature, largest first."""
        rows = [(c, float(b), math.exp(b), math.exp(b - Z95 * se), math.exp(b + Z95 * se))
                for (c, b), se in zip(self.beta.items(), np.sqrt(np.diag(self.covariance)))
                if only is None or c in only]
        out = spark.createDataFrame(
            rows, "feature string, coef double, hazard_ratio double, ci_lower double, ci_upper double")
        out = out.withColumn("err_low", F.greatest(F.col("hazard_ratio") - F.col("ci_lower"), F.lit(0.0)))
        out = out.withColumn("err_high", F.greatest(F.col("ci_upper") - F.col("hazard_ratio"), F.lit(0.0)))
        out = out.orderBy(F.desc("hazard_ratio"), "feature")
        return out.limit(top) if top else out

    def baseline(self, df: DataFrame) -> DataFrame:
        """``(time, hazard, cum_hazard, survival)``: events over summed partial hazards."""
        w = self.partial_hazard()
        cells = df.groupBy(F.col(self.duration).alias("time")).agg(
            F.sum(w).alias("s0"), F.sum(self.event).alias("d"))
        risk = running_sum(cells, "time", ["s0"], descending=True)
        steps = risk.select("time", (F.col("d") / F.col("s0")).alias("hazard"))
        cum = running_sum(steps.withColumn("cum_hazard", F.col("hazard")), "time", ["cum_hazard"])
        return cum.withColumn("survival", F.exp(-F.col("cum_hazard")))

    def survival_curves(self, rows: DataFrame, baseline: DataFrame) -> DataFrame:
        """Survival at every baseline time for a few ``rows``: one output row per time."""
        grid = baseline.select("time", F.col("cum_hazard").alias("__h"))
        return (grid.crossJoin(rows.withColumn("__w", self.partial_hazard()))  # a few rows by contract
                .withColumn("survival_probability", F.exp(-F.col("__h") * F.col("__w")))
                .select(*rows.columns, "time", "survival_probability"))

    def scores(self, df: DataFrame, baseline: DataFrame) -> DataFrame:
        """``df`` with partial hazard, expected hazard at the last time and two residuals.

        ``residual`` is duration minus expected hazard; ``martingale`` is event minus the
        cumulative hazard at the row's own time.
        """
        last = baseline.agg(F.max("cum_hazard")).scalar()
        own = baseline.select(F.col("time").alias(self.duration), F.col("cum_hazard").alias("__h"))
        out = (df.withColumn("partial_hazard", self.partial_hazard())
               .withColumn("baseline_cumulative_hazard", last)
               .withColumn("expected_cumulative_hazard", F.col("partial_hazard") * last)
               .withColumn("residual", F.col(self.duration) - F.col("expected_cumulative_hazard")))
        martingale = F.col(self.event) - F.col("__h") * F.col("partial_hazard")
        return out.join(own, self.duration, "left").withColumn("martingale", martingale).drop("__h")


def fit_cox(df: DataFrame, features: Sequence[str], event: str = "survival_event",
            duration: str = "survival_time", penalizer: float = 0.1, ties: str = "efron",
            max_iter: int = 50, tolerance: float = 1e-9) -> CoxModel:
    """Maximise ``ll / n - penalizer / 2 * |beta|^2`` over standardised features.

    The needed columns are cached in blocks for the iterations and released afterwards; lost
    partitions are recomputed from the input.
    """
    data = _blocks(df, features, event, duration).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        beta = np.zeros(len(features))

        def at(b: np.ndarray) -> Evaluation:
            return _evaluate(data, [float(x) for x in b], ties)

        def objective(e: Evaluation, b: np.ndarray) -> float:
            return e.log_likelihood / e.rows - 0.5 * penalizer * float(b @ b)

        now = at(beta)
        if not now.events:
            raise CoxFitError("no events")
        for i in range(1, max_iter + 1):
            grad = now.gradient / now.rows - penalizer * beta
            curve = now.hessian / now.rows - penalizer * np.eye(len(beta))
            try:
                step = np.linalg.solve(curve, -grad)
            except np.linalg.LinAlgError as e:
                raise CoxFitError("singular information matrix") from e
            size, before = 1.0, objective(now, beta)
            if np.abs(step).max(initial=0.0) < tolerance:
                break
            new = at(beta + step)
            while not objective(new, beta + size * step) >= before - 1e-12 * abs(before):
                size /= 2
                if size < 1e-6:
                    raise CoxFitError("no ascent direction")
                new = at(beta + size * step)
            beta, now = beta + size * step, new
        else:
            raise CoxFitError(f"no convergence in {max_iter} iterations")
        covariance = np.linalg.inv(-(now.hessian - penalizer * now.rows * np.eye(len(beta))))
        return CoxModel(dict(zip(features, map(float, beta))), covariance, now.log_likelihood, now.rows,
                        now.events, penalizer, ties, i, 1, event, duration, grad)
    finally:
        data.unpersist()


def fit_cox_with_fallback(df: DataFrame, features: Sequence[str], penalizer: float = 0.1,
                          minimal: int = 15, **options) -> CoxModel:
    """As :func:`fit_cox`; on failure a stronger penalty, then the first ``minimal`` features.

    The model's ``attempt`` says which of the three it is, ``penalizer`` and ``features`` how.
    """
    attempts = [(list(features), penalizer), (list(features), 10 * penalizer),
                (list(features)[:minimal], penalizer)]
    for i, (names, strength) in enumerate(attempts):
        try:
            return replace(fit_cox(df, names, penalizer=strength, **options), attempt=i + 1)
        except CoxFitError:
            if i == len(attempts) - 1:
                raise
    raise AssertionError("unreachable")


def metrics(model: CoxModel, spark) -> DataFrame:
    """One row: size, events, log-likelihoods and partial AIC."""
    return spark.createDataFrame(
        [(len(model.beta), model.rows, model.events, model.log_likelihood,
          model.log_likelihood - model.penalty, model.aic_partial)],
        "features int, observations long, events long, log_likelihood double, "
        "penalized_log_likelihood double, partial_aic double")
