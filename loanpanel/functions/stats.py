"""Statistics that stay exact and bounded at any row count."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.session import cut


def safe_corr(a: str | Column, b: str | Column) -> Column:
    """Pairwise-complete Pearson correlation; null (not an error) on zero variance."""
    sxx, syy = F.regr_sxx(a, b), F.regr_syy(a, b)
    return F.try_divide(F.regr_sxy(a, b), F.nullif(F.sqrt(sxx * syy), F.lit(0.0)))


def correlation_pairs(df: DataFrame, cols: Sequence[str], value: str = "corr") -> DataFrame:
    """Correlation of every unordered pair as rows ``(var_a, var_b, <value>)``, one pass."""
    pairs = list(combinations(cols, 2))
    row = df.agg(*[safe_corr(a, b).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("var_a"), F.lit(b).alias("var_b"),
                      F.col(f"p{i}").alias(value)) for i, (a, b) in enumerate(pairs)]
    return row.select(F.inline(F.array(*cells)))


def small_total(c: str | Column) -> Column:
    """Sum over all rows of a table already reduced to a bounded number of groups."""
    return F.sum(c).over(Window.partitionBy())


SENT_BYTES = 64 * 2**20  # a table of one row per group of at most so many bytes is sent to every task


def attach_group_row(df: DataFrame, small: DataFrame, by: Sequence[str]) -> DataFrame:
    """``df`` with the columns of its group's row in ``small``.

    ``small`` has one row per group; with no key it has a single row, read as a scalar
    subquery.  Null groups match each other.  A table of at most ``SENT_BYTES`` is counted and sent to
    the tasks, so ``df`` is not dealt by group, which would put a group's rows into one task.
    """
    added = [c for c in small.columns if c not in by]
    if not by:
        row = small.select(F.struct(*added)).scalar()
        return df.withColumns({c: row.getField(c) for c in added})
    on = [F.col(f"d.{k}").eqNullSafe(F.col(f"g.{k}")) for k in by]
    small = cut(small)  # small by contract: one row per group
    width = sum((F.size(c) if t.startswith("array") else F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(1)
                 for c, t in small.dtypes), F.lit(0))
    if (small.agg(F.sum(8 * width)).first()[0] or 0) <= SENT_BYTES:
        small = F.broadcast(small)
    out = df.alias("d").join(small.alias("g"), on=on, how="left")
    return out.select("d.*", *[f"g.{c}" for c in added])


def present(c: str) -> Column:
    """The column as a double; NaN counts as missing."""
    value = F.col(c).cast("double")
    return F.when(~F.isnan(value), value)


def values_of(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``(by..., column, value)``: the values of several columns that are not missing."""
    wide = df.select(*by, *[present(c).alias(c) for c in cols])
    return wide.unpivot(list(by), list(cols), "column", "value").where(F.col("value").isNotNull())


def order_bucket(v: Column, per_octave: int) -> Column:
    """A monotone, data-independent bucket of a number: ``per_octave`` per power of two."""
    # 1100 lifts log2 of the smallest positive double (-1074) above zero
    finite = F.least(F.abs(v), F.lit(1.7976931348623157e308))
    size = F.floor((F.log2(finite) + 1100) * per_octave)
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("long")


def running_sum(df: DataFrame, order: str, cols: Sequence[str],
                descending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """``cols`` replaced by their running sums in ``order`` (one row per ``by`` and ``order``).

    Totals per value bucket are accumulated first and added to the sums inside a bucket, so
    no task holds the whole table however many distinct values it has.
    """
    def asc(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    # at most 256 buckets per power of two: the offsets stay a small table
    keys = [*by, "__b"]
    rows = df.withColumn("__b", order_bucket(F.col(order), 256))
    totals = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"__s_{c}") for c in cols])
    w = Window.partitionBy(*by).orderBy(asc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, *[F.coalesce(F.sum(f"__s_{c}").over(w), F.lit(0)).alias(f"__o_{c}")
                                     for c in cols])
    inside = Window.partitionBy(*keys).orderBy(asc(order))
    out = rows.join(offsets, keys)
    sums = {c: F.sum(c).over(inside) + F.col(f"__o_{c}") for c in cols}
    return out.select(*[sums[c].alias(c) if c in sums else F.col(c) for c in df.columns])


def _ranks_in(totals: DataFrame, keys: Sequence[str], cell: str, wanted: DataFrame) -> DataFrame:
    """Where wanted ranks fall among the cells of each key, in the order of ``cell``.

    ``totals`` has (keys, cell, m); ``wanted`` has (keys, prob, upper, offset, frac).  The
    offset is counted from the key's first row, in the result from the cell's.
    """
    upto = F.sum("m").over(Window.partitionBy(*keys).orderBy(cell))
    cells = totals.withColumn("before", upto - F.col("m"))
    on = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in keys]
    inside = (F.col("w.offset") >= F.col("c.before")) & (F.col("w.offset") < F.col("c.before") + F.col("c.m"))
    return (cells.alias("c").join(wanted.alias("w"), on=on).where(inside)
            .select(*[F.col(f"c.{k}").alias(k) for k in [*keys, cell]], "w.prob", "w.upper",
                    (F.col("w.offset") - F.col("c.before")).alias("offset"), "w.frac"))


def _limited_to(rows: DataFrame, keys: Sequence[str], wanted: DataFrame) -> DataFrame:
    """``rows`` of the keys that hold a wanted rank (null-safe: a null group is a group)."""
    places = wanted.select(*keys).distinct()
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in keys]
    return rows.alias("r").join(places.alias("p"), on=on, how="left_semi")


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float],
                        by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation quantiles of ``(by..., column, value, n)`` rows.

    Returns ``(by..., column, prob, quantile)``.  Values need not be distinct.  Rows are first
    counted per bucket of 1/1024 of a power of two, a small table after the map-side combine;
    a second pass keeps the buckets that hold a wanted rank, and counts them in 4096 parts each;
    only the values of the parts that hold one are grouped and ordered.
    """
    keys = [*by, "column"]
    cells = (counts.withColumn("bucket", order_bucket(F.col("value"), 1024))
             .withColumn("part", order_bucket(F.col("value"), 1024 * 4096)))
    totals = cells.groupBy(*keys, "bucket").agg(F.sum("n").alias("m"))
    h = F.col("prob") * (F.col("total") - 1)
    ranks = (totals.groupBy(*keys).agg(F.sum("m").alias("total"))
             .withColumn("prob", F.explode(F.array(*[F.lit(float(p)) for p in probs])))
             .withColumn("upper", F.explode(F.array(F.lit(False), F.lit(True))))
             .select(*keys, "prob", "upper", F.when(F.col("upper"), F.ceil(h)).otherwise(F.floor(h)).alias("offset"),
                     (h - F.floor(h)).alias("frac")))
    wanted = _ranks_in(totals, keys, "bucket", ranks)
    near = _limited_to(cells, [*keys, "bucket"], wanted)
    totals = near.groupBy(*keys, "bucket", "part").agg(F.sum("n").alias("m"))
    wanted = _ranks_in(totals, [*keys, "bucket"], "part", wanted)
    near = _limited_to(near, [*keys, "bucket", "part"], wanted)
    totals = near.groupBy(*keys, "bucket", "part", "value").agg(F.sum("n").alias("m"))
    picked = _ranks_in(totals, [*keys, "bucket", "part"], "value", wanted)
    lo = F.max(F.when(~F.col("upper"), F.col("value")))
    hi = F.max(F.when(F.col("upper"), F.col("value")))
    return (picked.groupBy(*keys, "prob")
            .agg((lo + (hi - lo) * F.max("frac")).alias("quantile")))


# a sketch misses a rank by at most this part of the rows; its size, and the time to merge the tasks' sketches, grow with it
ACCURACY = 2_000


def rank_sketches(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                  more: Sequence[Column] = ()) -> DataFrame:
    """One row per group, from one scan: s0, s1, .. with values around each wanted rank, and ``more``.

    A sketch has two values per probability, between which the value at its rank lies.
    """
    around = [min(max(p + side * 3 / ACCURACY, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketches = [F.percentile_approx(present(c), around, ACCURACY).alias(f"s{i}") for i, c in enumerate(cols)]
    return df.groupBy(*by).agg(*sketches, *more)


def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
              sketches: DataFrame | None = None) -> DataFrame:
    """Exact quantiles of several columns in two scans; missing values don't count.

    Returns ``(by..., column, prob, quantile)``. The first scan brackets every wanted rank by a
    mergeable sketch (``sketches``, where it has been made, then ``probs`` ascend). The second counts: each value inside a
    bracket by itself, all values of a gap between brackets together, as the least of them. The
    counts are written once, and the ranks found among them.
    """
    if sketches is None:
        probs = sorted(probs)
        sketches = cut(rank_sketches(df, cols, probs, by))
    wide = df.select(*by, *[present(c).alias(f"v{i}") for i, c in enumerate(cols)])
    wide = attach_group_row(wide, sketches.select(*by, *[f"s{i}" for i in range(len(cols))]), by)
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("value"), F.col(f"s{i}").alias("sketch"))
                     for i, c in enumerate(cols)])
    long = wide.select(*by, F.inline(each)).where(F.col("value").isNotNull())
    value = F.col("value")

    def gaps(first: int, last: int) -> Column:  # how many brackets end below the value, by halving
        if first == last:
            return F.lit(first)
        middle = (first + last) // 2
        return F.when(F.get("sketch", F.lit(2 * middle + 1)) < value, gaps(middle + 1, last)).otherwise(gaps(first, middle))

    inside = F.get("sketch", 2 * F.col("gap")) <= value  # no bracket ends below and begins above another's
    cells = (long.select(*by, "column", "value", "sketch", gaps(0, len(probs)).alias("gap"))
             .select(*by, "column", "value", "gap", F.when(inside, value).alias("own"))
             .groupBy(*by, "column", "gap", "own").agg(F.min("value").alias("value"), F.count("*").alias("n")))
    return quantiles_of_counts(cut(cells).select(*by, "column", "value", "n"), probs, by)


def breaks_below(value: Column, cut: Column, n: int) -> Column:
    """How many of the ``n`` breaks in the array ``cut`` lie strictly below ``value``."""
    return sum((F.coalesce((value > F.get(cut, i)).cast("int"), F.lit(0)) for i in range(n)), F.lit(0))


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max, one row per column.

    NaN counts as missing; a column without values has count 0 and nulls.
    """
    parts = {"count": F.count, "mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    row = [F.struct(*[f(present(c)).alias(name) for name, f in parts.items()]).alias(f"c{i}") for i, c in enumerate(cols)]
    probs = [0.25, 0.5, 0.75]
    first = cut(rank_sketches(df, cols, probs, more=row))
    moments = first.select(F.inline(F.array(*[F.struct(
        F.lit(c).alias("column"), *[F.col(f"c{i}.{name}").alias(name) for name in parts])
        for i, c in enumerate(cols)])))
    quart = (quantiles(df, cols, probs, sketches=first)
             .groupBy("column").pivot("prob", probs).agg(F.max("quantile"))
             .toDF("column", "p25", "p50", "p75"))
    return (moments.join(quart, "column", "left")
            .select("column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"))


def histogram(df: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width histogram per group: ``(by..., bin, lo, hi, count, density)``.

    Bins are left-closed with the last one closed on both sides; empty bins are kept.
    Each group has its own range.  ``by`` must be low-cardinality.
    """
    counts = (df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v"))
              .agg(F.count("*").alias("n")))
    flat = F.max("v") == F.min("v")
    bounds = (counts.groupBy(*by)
              .agg(F.when(flat, F.min("v") - 0.5).otherwise(F.min("v")).alias("low"),
                   F.when(flat, F.lit(1.0)).otherwise(F.max("v") - F.min("v")).alias("span"),
                   F.sum("n").alias("total"))
              .where(F.col("total").isNotNull()))
    # one row per group, `by` is low-cardinality by contract
    spine = bounds.select(*by, "low", "span", "total",
                          F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    placed = attach_group_row(counts, bounds, by)
    spot = F.least(F.floor((F.col("v") - F.col("low")) * bins / F.col("span")),
                   F.lit(bins - 1)).cast("int")
    filled = (placed.select(*by, spot.alias("bin"), "n")
              .groupBy(*by, "bin").agg(F.sum("n").alias("n")))
    on = [F.col(f"s.{k}").eqNullSafe(F.col(f"f.{k}")) for k in [*by, "bin"]]
    out = spine.alias("s").join(filled.alias("f"), on=on, how="left")
    step = F.col("s.span") / bins
    n = F.coalesce(F.col("f.n"), F.lit(0))
    return out.select(
        *[F.col(f"s.{k}").alias(k) for k in by], F.col("s.bin").alias("bin"),
        (F.col("s.low") + F.col("s.bin") * step).alias("lo"),
        (F.col("s.low") + (F.col("s.bin") + 1) * step).alias("hi"),
        n.cast("long").alias("count"),
        (n / (F.col("s.total") * step)).alias("density"))
