"""Effect of macro factors: two Cox models on the early period, tested on the later one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanpanel.operators import features as FE
from loanpanel.operators.survival.compare import compare, metrics_table, model_row
from loanpanel.operators.survival.concordance import concordance
from loanpanel.operators.survival.cox import CoxModel, fit_cox_with_fallback
from loanpanel.operators.survival.forest import Forest, ForestParams, fit_forests, risk_histogram
from loanpanel.session import cut


@dataclass
class MacroEffect:
    """Fitted models, their scaled data, and the comparison tables."""

    non_macro: CoxModel
    full: CoxModel
    macro_features: list[str]
    train: dict[str, DataFrame]
    test: dict[str, DataFrame]
    metrics: DataFrame
    comparison: DataFrame
    test_c_index: dict[str, float]


def macro_effect(df: DataFrame, components: Sequence[str], split: str = "2020-12-31",
                 max_features: tuple[int, int] = (30, 50), penalizer: float = 0.1) -> MacroEffect:
    """Train with and without macro features up to ``split``, evaluate after it.

    Test rows are imputed and scaled with the training medians and moments, each model on
    its own copy.  ``components`` are the macro columns that were joined.
    """
    # one row per loan, read by every step below; lost partitions are recomputed
    data = FE.valid_survival(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = FE.time_split(data, split)
        names = FE.feature_names(train)
        macro = FE.macro_features(names, components)
        medians = FE.fit_medians(train, names)
        train, test = FE.fill_features(train, medians), FE.fill_features(test, medians)
        models, fitted, held_out, risks = {}, {}, {}, []
        choices = {"Non-Macro": ([c for c in names if c not in macro], max_features[0]),
                   "Full": (names, max_features[1])}
        for name, (cols, top) in choices.items():
            cols = FE.select_features(train, cols, top)
            scaler = FE.Scaler.fit(train, cols)
            fitted[name], held_out[name] = scaler.transform(train), scaler.transform(test)
            models[name] = fit_cox_with_fallback(fitted[name], cols, penalizer=penalizer)
            for rows in (fitted[name], held_out[name]):
                risks.append(rows.select(F.lit(len(risks)).alias("sample"), "survival_time", "survival_event",
                                         models[name].partial_hazard().alias("risk")))
        # both models on both periods at once: one set of jobs instead of four
        found = {x["sample"]: x["c_index"] for x in concordance(reduce(DataFrame.union, risks), "risk", by=["sample"]).collect()}
        rows = [model_row(name, model, found.get(2 * i)) for i, (name, model) in enumerate(models.items())]
        scores = {name: found.get(2 * i + 1) for i, name in enumerate(models)}
        table = metrics_table(df.sparkSession, rows)
        chosen = [c for c in models["Full"].features if c in macro]
        return MacroEffect(models["Non-Macro"], models["Full"], chosen, fitted, held_out, table,
                           compare(table, "Non-Macro", "Full"), scores)
    finally:
        data.unpersist()


@dataclass
class ForestEffect:
    """Two forests, their concordance on both periods, and the full one's curves and scores."""

    non_macro: Forest
    full: Forest
    c_index: DataFrame  # model, part, c_index
    curves: DataFrame  # part, time, survival, cum_hazard
    test_scores: DataFrame  # histogram of the full forest's scores after the split


def forest_effect(df: DataFrame, components: Sequence[str], split: str = "2020-12-31", key: str = "LOAN_ID",
                  params: ForestParams = ForestParams()) -> ForestEffect:
    """Forests with and without macro features, grown up to ``split``, evaluated on both sides of it.

    Missing features are filled with the training medians.
    """
    data = FE.valid_survival(df).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        train, test = FE.time_split(data, split)
        names = FE.feature_names(train)
        macro = FE.macro_features(names, components)
        medians = FE.fit_medians(train, names)
        parts = {"train": FE.fill_features(train, medians), "test": FE.fill_features(test, medians)}
        forests = fit_forests(parts["train"], {"Non-Macro": [c for c in names if c not in macro], "Full": names}, key, params=params)
        both = parts["train"].withColumn("part", F.lit("train")).unionByName(parts["test"].withColumn("part", F.lit("test")))
        for i, forest in enumerate(forests.values()):
            both = forest.score(both, f"risk_{i}")
        scored = cut(both)
        # both forests on both periods at once: one set of jobs instead of four
        risks = [scored.select(F.lit(i).alias("model"), "part", "survival_time", "survival_event", F.col(f"risk_{i}").alias("risk"))
                 for i in range(len(forests))]
        found = {(x["model"], x["part"]): x["c_index"] for x in concordance(reduce(DataFrame.union, risks), "risk", by=["model", "part"]).collect()}
        rows = [(name, part, found.get((i, part))) for i, name in enumerate(forests) for part in parts]
        full = forests["Full"]
        curves = [full.average_curve(scored.where(F.col("part") == part)).withColumn("part", F.lit(part)) for part in parts]
        histogram = risk_histogram(scored.where("part = 'test'"), "risk_1")
        table = df.sparkSession.createDataFrame(rows, "model string, part string, c_index double")
        return ForestEffect(forests["Non-Macro"], full, table, cut(curves[0].unionByName(curves[1])), cut(histogram))
    finally:
        data.unpersist()
