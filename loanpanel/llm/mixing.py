"""Mixing sources to target weights under a time-varying curriculum.

Every source has a weight that changes linearly over the training run. Its integral, scaled
to the source's target, is the cumulative demand for the source's words. A document copy that
starts at a given running word count of its source trains when the demand reaches that count:
the inverse of the demand gives its position in [0, 1], and documents are range-sorted by it.

Words are counted once and written with the source; sources, slices of sources and running
sums are DataFrame aggregates, so no source's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanpanel.llm.storage import cut

WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(seed: int) -> Column:
    """60 bits of a hash of the document: the seeded order within a source."""
    text = F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.col("text"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source: source, source_size, docs, target.

    Sources by code point, null last, get ``weights`` in turn. Together they want ``share`` of
    all words; none gets over ``most`` times its own, and what is cut off goes to the others by
    weight. That is one water level: in the order of cap / weight, the first sources are full,
    and the level of the rest is what remains over their weights.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    table = F.array(*[F.lit(float(w)) for w in weights])
    rows = (by_source.withColumn("place", place)
            .withColumn("weight", F.get(table, (F.col("place") % len(weights)).cast("int")))
            .withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("weight")))
    upto = Window.orderBy("full_at", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    rows = (rows.withColumn("wanted", F.sum("source_size").over(everything) * share)
            .withColumn("caps", F.sum("cap").over(upto) - F.col("cap"))
            .withColumn("rest", F.sum("weight").over(everything) - F.sum("weight").over(upto) + F.col("weight"))
            .withColumn("level", F.greatest((F.col("wanted") - F.col("caps")) / F.col("rest"), F.lit(0.0))))
    # the first source that the level of the others doesn't fill, and all after it, get that level
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(everything)
    rows = rows.withColumn("found", level)
    target = (F.when(F.col("found").isNull() | (F.struct("full_at", "place") < F.struct("found.full_at", "found.place")),
                     F.col("cap")).otherwise(F.least("cap", F.col("weight") * F.col("found.level"))))
    return rows.select("source", "source_size", "docs", "weight", "place", target.alias("target"))


def training_position(done: Column, ramp: Column) -> Column:
    """The time at which the demand for a source reaches the share ``done`` of its target.

    The weight runs from 1 - ramp to 1 + ramp, so demand is (1 - ramp) t + ramp t^2; a ramp of
    0 is a constant weight.
    """
    low = 1 - ramp
    root = F.sqrt(low * low + 4 * ramp * done)
    return F.when(ramp == 0, done).otherwise(2 * done / (low + root))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
        ramps: Sequence[float] = (-0.6, 0.0, 0.6), seed: int = 42, rows_per_slice: int = 4_096) -> DataFrame:
    """One row per document: doc_id, source, u, size, source_size, target, copies, taken, positions.

    Rows are range-sorted by the training position of the first copy, those not taken last. Every document of a source is taken floor(target / source_size) times, and once more while
    the running word count in seeded hash order is below the remainder. ``positions`` holds the
    training position of each copy, taken ones only. Null text has size 0 and is taken like any
    other; a null source is a source. Repeated rows are separate documents (a repeated row has
    the same hash, so their order doesn't matter). A source without words has target 0. Empty
    input gives no rows. Other columns are not read. ``u`` is the document's key in the hash order.

    Sources weigh ``weights`` on average over the run; their weights change by ``ramps``, both
    given in turn to the sources in code point order.
    """
    sizes = cut(docs.select("doc_id", "source", words_in(F.col("text")).alias("size"), order_key(seed).alias("u")))
    targets = source_targets(sizes, weights, share, most).withColumn(
        "ramp", F.get(F.array(*[F.lit(float(x)) for x in ramps]), (F.col("place") % len(ramps)).cast("int"))
    ).withColumn("slices", F.ceil(F.col("docs") / rows_per_slice).cast("int"))
    named = targets.withColumnRenamed("source", "of")
    part = F.floor(F.col("u") / F.lit(2.0**60) * F.col("slices")).cast("int")
    rows = (sizes.join(named, sizes["source"].eqNullSafe(named["of"])).drop("of", "docs", "weight")
            .withColumn("slice", F.least(part, F.col("slices") - 1)))
    sums = rows.groupBy("place", "slice").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("place").orderBy("slice")) - F.col("words")
    sums = sums.select("place", "slice", before.alias("before"))
    inside = (Window.partitionBy("place", "slice").orderBy("u", "doc_id", "size")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = (rows.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
            .join(sums, ["place", "slice"]).withColumn("start", F.col("before") + F.col("inside")))
    whole = F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)))
    once_more = F.col("start") + F.col("size") / 2 < F.col("target") - F.col("whole") * F.col("source_size")
    rows = (rows.withColumn("whole", whole)
            .withColumn("copies", (F.col("whole") + once_more.cast("int")).cast("int")))
    done = F.transform(F.sequence(F.lit(1), F.col("copies")), lambda k: training_position(
        F.least(F.coalesce(F.try_divide((k - 1) * F.col("source_size") + F.col("start") + F.col("size") / 2,
                                        F.col("target")), F.lit(0.0)), F.lit(1.0)), F.col("ramp")))
    positions = F.when(F.col("copies") > 0, done).otherwise(F.array().cast("array<double>"))
    rows = rows.select("doc_id", "source", "u", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"), positions.alias("positions"))
    return rows.orderBy(F.get("positions", F.lit(0)).asc_nulls_last(), "u", "doc_id")


def in_training_order(mixed: DataFrame) -> DataFrame:
    """One row per copy, range-sorted by training position: doc_id, size, position."""
    copies = mixed.select("doc_id", "size", F.posexplode("positions").alias("copy", "position"))
    return copies.orderBy("position", "doc_id", "copy")


def mixed_documents(docs: DataFrame, seed: int = 42, **options) -> DataFrame:
    """The documents in training order, each as often as the mix takes it; columns as in ``docs``."""
    taken = mix(docs, seed=seed, **options).select("source", "u", F.explode("positions").alias("position"))
    keyed = docs.select(F.col("source").alias("own_source"), order_key(seed).alias("own"), F.struct("*").alias("row"))
    # rows equal in id, text and source are one here: each of them brings its own copies
    repeated = keyed.groupBy("own", "own_source").agg(F.count("*").alias("n")).filter("n > 1")
    if not repeated.isEmpty():
        keyed = keyed.dropDuplicates(["own", "own_source"])
    same = F.col("own_source").eqNullSafe(F.col("source")) & (F.col("own") == F.col("u"))
    return keyed.join(taken, same).orderBy("position", "u").select("row.*")
