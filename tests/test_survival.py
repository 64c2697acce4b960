"""Estimators against brute force on small data, and their invariants."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanpanel.operators import features as FE
from loanpanel.operators.survival import compare as CM
from loanpanel.operators.survival import concordance as CC
from loanpanel.operators.survival import cox as CX
from loanpanel.operators.survival import forest as FO
from loanpanel.operators.survival import table as T
from loanpanel.plans.macro_effect import macro_effect


@pytest.fixture(scope="module")
def small():
    """Tied times, censoring, two covariates; x drives the hazard."""
    rng = np.random.default_rng(3)
    n = 400
    x, z = rng.normal(size=n), rng.integers(0, 4, n).astype(float)
    t = np.ceil(rng.exponential(6 / np.exp(1.0 * x)))
    c = rng.integers(2, 14, n)
    return x, z, np.minimum(t, c), (t <= c).astype(int)


@pytest.fixture(scope="module")
def frame(spark, small):
    x, z, t, e = small
    rows = [(i, *map(float, r[:3]), int(r[3])) for i, r in enumerate(zip(x, z, t, e))]
    return spark.createDataFrame(rows, "LOAN_ID long, x double, z double, survival_time double, survival_event int").cache()


def test_survival_table(spark):
    rows = [("a", 0.0, 0, 1.0, "112016"), ("a", 1.0, 1, 2.0, "122016"), ("a", 2.0, 1, 3.0, "012017"),
            ("b", 0.0, 0, 4.0, "052017"), ("b", 3.0, 0, None, "082017")]
    panel = spark.createDataFrame(rows, "LOAN_ID string, time double, event int, v double, act_period string")
    got = {r["LOAN_ID"]: r for r in T.survival_table(panel.withColumn("data_quarter", F.lit("q")), ["v"]).collect()}
    assert (got["a"]["survival_time"], got["a"]["survival_event"], got["a"]["v"]) == (1.0, 1, 2.0)
    assert (got["b"]["survival_time"], got["b"]["survival_event"], got["b"]["v"]) == (3.0, 0, None)
    assert got["a"]["macro_quarter"] == dt.date(2016, 10, 1) and got["b"]["macro_quarter"] == dt.date(2017, 7, 1)


def test_nelson_aalen_hand_table(spark):
    df = spark.createDataFrame([(1.0, 1), (1.0, 1), (2.0, 0), (3.0, 1), (3.0, 0)], "survival_time double, survival_event int")
    risk = {r["time"]: r for r in T.risk_table(df).collect()}
    assert [(risk[t]["at_risk"], risk[t]["events"], risk[t]["censored"]) for t in (1.0, 2.0, 3.0)] == [(5, 2, 0), (3, 0, 1), (2, 1, 1)]
    got = {r["time"]: r for r in T.nelson_aalen(T.risk_table(df)).collect()}
    assert got[1.0]["cum_hazard"] == pytest.approx(1 / 5 + 1 / 4) and got[3.0]["cum_hazard"] == pytest.approx(0.45 + 0.5)
    plain = {r["time"]: r for r in T.nelson_aalen(T.risk_table(df), tie_corrected=False).collect()}
    assert plain[3.0]["cum_hazard"] == pytest.approx(2 / 5 + 1 / 2)


def test_tied_sums_of_large_groups(spark):
    """The closed form equals the term-by-term sum, far from and close to zero survivors."""
    cases = [(10, 10), (99, 3), (150, 149), (5000, 4950), (5000, 10), (100000, 99990), (7, 0)]
    df = spark.createDataFrame([(float(i), n, d) for i, (n, d) in enumerate(cases)], "time double, at_risk long, events long")
    a, b = T._tied_sums(F.col("at_risk"), F.col("events"))
    for r, (n, d) in zip(df.select(a.alias("a"), b.alias("b")).collect(), cases):
        k = np.arange(n - d + 1, n + 1, dtype=float)
        assert r["a"] == pytest.approx((1 / k).sum(), rel=1e-12, abs=1e-15)
        assert r["b"] == pytest.approx((1 / k**2).sum(), rel=1e-12, abs=1e-15)


def brute_loglik(beta, x, t, e, ties):
    w, total = np.exp(x @ beta), 0.0
    for at in np.unique(t[e == 1]):
        dead, risk = (t == at) & (e == 1), w[t >= at].sum()
        d, tied = dead.sum(), w[dead].sum()
        total += (x[dead] @ beta).sum()
        total -= sum(math.log(risk - (j / d * tied if ties == "efron" else 0)) for j in range(d))
    return total


@pytest.mark.parametrize("ties", ["efron", "breslow"])
def test_cox_derivatives_match_finite_differences(frame, small, ties):
    x, z, t, e = small
    design, beta, h = np.column_stack([x, z]), np.array([0.3, -0.2]), 1e-5
    got = CX.evaluate(frame, {"x": 0.3, "z": -0.2}, ties=ties)
    assert got.log_likelihood == pytest.approx(brute_loglik(beta, design, t, e, ties), rel=1e-12)
    for i in range(2):
        step = np.eye(2)[i] * h
        up, down = [brute_loglik(beta + s, design, t, e, ties) for s in (step, -step)]
        assert got.gradient[i] == pytest.approx((up - down) / (2 * h), rel=1e-6)
        second = [CX.evaluate(frame, dict(zip("xz", beta + s)), ties=ties).gradient for s in (step, -step)]
        assert np.allclose(got.hessian[i], (second[0] - second[1]) / (2 * h), rtol=1e-6)


@pytest.mark.parametrize("held", [CX.HELD_CELLS, 10])
def test_cox_many_times(frame, small, monkeypatch, held):
    monkeypatch.setattr(CX, "HELD_CELLS", held)
    x, z, t, e = small
    far = frame.withColumn("survival_time", 1000 + F.col("survival_time") + F.col("LOAN_ID") / 1000)  # few ranges
    wide = frame.withColumn("survival_time", F.exp(F.col("survival_time") + F.col("LOAN_ID") / 1000))  # many
    t, design = t + np.arange(len(t)) / 1000, np.column_stack([x, z])
    for df in (far, wide):
        got = CX.evaluate(df.repartition(3), {"x": 0.4, "z": 0.1})
        assert got.log_likelihood == pytest.approx(brute_loglik(np.array([0.4, 0.1]), design, t, e, "efron"), rel=1e-12)
        assert (got.rows, got.events) == (len(t), e.sum())
    # a missing time counts nowhere, a missing feature is an error
    assert CX.evaluate(df.withColumn("survival_time", F.when(F.col("LOAN_ID") > 9, F.col("survival_time"))), {"x": 0.0}).rows == len(t) - 10
    with pytest.raises(Exception, match="must not be null"):
        CX.evaluate(df.withColumn("x", F.when(F.col("LOAN_ID") > 9, F.col("x"))), {"x": 0.0})


def test_cox_fit(spark, frame):
    scaled = FE.Scaler.fit(frame, ["x", "z"]).transform(frame)
    model = CX.fit_cox(scaled, ["x", "z"])
    assert np.abs(model.gradient).max() < 1e-8 and model.beta["x"] > 0.5 and abs(model.beta["z"]) < 0.3
    free = CX.fit_cox(scaled, ["x", "z"], penalizer=0.0)
    null = CX.evaluate(scaled, {"x": 0.0, "z": 0.0})
    assert free.log_likelihood > model.log_likelihood > null.log_likelihood
    base = {r["time"]: r for r in model.baseline(scaled).collect()}
    assert [base[t]["survival"] for t in sorted(base)] == sorted((r["survival"] for r in base.values()), reverse=True)
    martingale = model.scores(scaled, model.baseline(scaled)).agg(F.sum("martingale")).first()[0]
    assert martingale == pytest.approx(0, abs=1e-8)
    hr = model.hazard_ratios(spark).collect()
    assert hr[0]["feature"] == "x" and hr[0]["ci_lower"] < hr[0]["hazard_ratio"] < hr[0]["ci_upper"]
    with pytest.raises(CX.CoxFitError):
        CX.fit_cox(scaled.withColumn("survival_event", F.lit(0)), ["x"])


def test_cox_fallback_reduces_features(frame):
    wide = frame.withColumns({f"c{i}": F.lit(0.0) for i in range(3)})
    model = CX.fit_cox_with_fallback(wide, ["x", "z", "c0", "c1", "c2"], penalizer=0.0, minimal=2)
    assert model.features == ["x", "z"]


def brute_concordance(risk, t, e):
    conc = tied = pairs = 0
    for i in np.flatnonzero(e == 1):
        later = (t > t[i]) | ((t == t[i]) & (e == 0))
        pairs += later.sum()
        conc += (risk[later] < risk[i]).sum()
        tied += (risk[later] == risk[i]).sum()
    return conc, tied, pairs


@pytest.mark.parametrize("cells", [CC.CELLS_PER_RANGE, 20])
@pytest.mark.parametrize("risk", ["x", "z", "one"])
def test_concordance_brute_force(frame, small, monkeypatch, cells, risk):
    monkeypatch.setattr(CC, "CELLS_PER_RANGE", cells)
    x, z, t, e = small
    values = {"x": x, "z": z, "one": np.ones(len(x))}[risk]
    df = frame.withColumn("one", F.lit(1.0))
    got = CC.concordance(df.repartition(5), risk).first()
    assert (got["concordant"], got["tied"], got["pairs"]) == brute_concordance(values, t, e)
    if risk == "one":
        assert got["c_index"] == 0.5
    if risk == "x":
        flipped = CC.c_index(df.withColumn("m", -F.col("x")), "m")
        assert flipped == pytest.approx(1 - got["c_index"])
        true_order = -(2 * F.col("survival_time") + 1 - F.col("survival_event"))
        assert CC.c_index(df.withColumn("m", true_order), "m") == 1.0


PARAMS = FO.ForestParams(trees=12, max_depth=4, sample=0.6, min_leaf=10, bins=16, seed=1)


@pytest.fixture(scope="module")
def forest(frame):
    return FO.fit_forest(frame, ["x", "z"], params=PARAMS)


def test_forest_is_reproducible(frame, forest):
    again = FO.fit_forest(frame.repartition(6), ["x", "z"], params=PARAMS)
    key = ["tree", "node"]
    assert forest.splits.sort_values(key).reset_index(drop=True).equals(again.splits.sort_values(key).reset_index(drop=True))


def test_forest_structure_and_scores(frame, small, forest):
    x, _, t, e = small
    leaves = forest.leaves(frame).select("LOAN_ID", "tree", "node").toPandas()
    assert len(leaves) == len(x) * PARAMS.trees and leaves["node"].max() < 2 ** (PARAMS.max_depth + 1)
    split = set(map(tuple, forest.splits[["tree", "node"]].to_numpy()))
    assert not split & set(map(tuple, leaves[["tree", "node"]].drop_duplicates().to_numpy()))
    # score = mean over trees of the leaf's cumulative hazard summed over all event times
    grid = np.unique(t[e == 1])
    steps = forest.leaf_steps.toPandas()
    mortality = {k: sum(g.loc[g["time"] <= at, "hazard"].sum() for at in grid) for k, g in steps.groupby(["tree", "node"])}
    want = leaves.assign(m=[mortality.get(k, 0.0) for k in zip(leaves["tree"], leaves["node"])]).groupby("LOAN_ID")["m"].mean()
    got = forest.score(frame).select("LOAN_ID", "risk").toPandas().set_index("LOAN_ID")["risk"]
    assert np.allclose(got.sort_index(), want.sort_index())
    assert CC.c_index(forest.score(frame), "risk") > 0.7  # x drives the hazard
    hazards = steps.sort_values("time").groupby(["tree", "node"])
    for _, g in hazards:  # the falls of a leaf's curve follow the product-limit estimate
        alive = np.cumprod(1 - g["hazard"])
        assert np.allclose(1 - g["drop"].cumsum(), alive)


def test_forest_curves(frame, forest):
    curve = forest.average_curve(frame).toPandas().sort_values("time")
    assert (curve["survival"].diff().dropna() <= 1e-12).all() and curve["survival"].between(-1e-9, 1).all()
    some = forest.survival_curves(frame, "LOAN_ID").toPandas()
    wide = some.pivot(index="time", columns="LOAN_ID", values="survival").ffill().fillna(1.0)
    assert np.allclose(wide.mean(axis=1), curve["survival"])


def test_forest_leaf_size(frame):
    params = FO.ForestParams(trees=3, max_depth=6, sample=1.0, min_leaf=15, seed=2)
    model = FO.fit_forest(frame, ["x", "z"], params=params)
    drawn = FO.bootstrap(frame.select(F.col("LOAN_ID").alias("key")), params).withColumnRenamed("key", "LOAN_ID")
    sizes = drawn.join(model.leaves(frame), ["LOAN_ID", "tree"]).groupBy("tree", "node").count().toPandas()
    assert sizes["count"].min() >= 15
    mean = FO.bootstrap(frame.select(F.col("LOAN_ID").alias("key")), FO.ForestParams(trees=200, sample=0.1)
                         ).agg(F.sum("w")).first()[0] / (200 * 400)
    assert mean == pytest.approx(0.1, abs=0.01)


def test_logrank_matches_definition(small):
    x, _, t, e = small
    order = np.argsort(x)
    x, t, e = x[order], t[order], e[order]
    n = np.arange(len(x)) % 3 + 1.0  # weights
    group = np.r_[np.zeros(250, int), np.ones(len(x) - 250, int)]
    u, v = FO._logrank(group, t, n, n * e)
    for cell in (40, 249, 300):
        own = group == group[cell]
        left = own & (np.arange(len(x)) <= cell)
        num = var = 0.0
        for at in np.unique(t[own & (e == 1)]):
            y, y1 = n[own & (t >= at)].sum(), n[left & (t >= at)].sum()
            d, d1 = (n * e)[own & (t == at)].sum(), (n * e)[left & (t == at)].sum()
            num += d1 - d * y1 / y
            var += d * (y1 / y) * (1 - y1 / y) * (y - d) / (y - 1) if y > 1 else 0.0
        assert u[cell] == pytest.approx(num, abs=1e-9) and v[cell] == pytest.approx(var, abs=1e-9)


def test_chi_square_tail():
    for x, df, p in ((3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
                     (18.307038053275146, 10, 0.05), (0.0, 4, 1.0)):
        assert CM.chi2_tail(x, df) == pytest.approx(p, abs=1e-10)


def test_features(spark):
    df = spark.createDataFrame(
        [(1.0, 1, 5.0, 1.0, 1.0, "t"), (2.0, 0, None, 1.0, float("inf"), "t"), (3.0, 1, 7.0, 1.0, 2.0, "t"), (-1.0, 1, 100.0, 1.0, 3.0, "t")],
        "survival_time double, survival_event int, good double, flat double, wild double, text string")
    df = df.withColumn("orig_year", F.col("survival_time"))
    assert FE.feature_names(df) == ["good"]
    valid = FE.valid_survival(df)
    assert valid.count() == 3 and FE.fit_medians(valid, ["good"]) == {"good": 6.0}
    assert [r["good"] for r in FE.fill_features(valid, {"good": 6.0}).orderBy("survival_time").collect()] == [5.0, 6.0, 7.0]
    assert FE.macro_features(["a_PC1", "housing_PC1", "OLTV"], ["a_PC1"]) == ["a_PC1", "housing_PC1"]
    ranked = FE.select_features(spark.createDataFrame([(0, 0.0, 1.0), (1, 1.0, 0.0), (1, 0.9, 1.0)], "survival_event int, a double, b double"),
                                ["b", "a"], 1)
    assert ranked == ["a"]
    dates = FE.coerce_dates(spark.createDataFrame([("2017-01-02",), ("x",)], "ORIG_DATE string"))
    assert [r[0] for r in dates.collect()] == [dt.datetime(2017, 1, 2), None]


def test_macro_effect(spark, frame):
    """A macro factor that drives the hazard improves the full model."""
    df = frame.withColumns({"f_PC1": F.col("x") + F.when(F.col("LOAN_ID") % 97 == 0, None).otherwise(0.0),
                            "macro_quarter": F.when(F.col("LOAN_ID") % 3 == 0, F.lit("2021-04-01")).otherwise(F.lit("2019-01-01")).cast("date")}).drop("x", "LOAN_ID")
    out = macro_effect(df, ["f_PC1"])
    assert out.macro_features == ["f_PC1"] and out.non_macro.features == ["z"]
    row = out.comparison.first()
    assert row["c_index_verdict"] == "MEANINGFUL" and row["aic_verdict"] == "SUBSTANTIAL" and row["significant"]
    assert out.test_c_index["Full"] > 0.65 > out.test_c_index["Non-Macro"]
    mean = out.train["Full"].agg(F.avg("f_PC1"), F.stddev_pop("f_PC1")).first()
    assert mean[0] == pytest.approx(0, abs=1e-9) and mean[1] == pytest.approx(1)


def test_concordance_over_ranges_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(float(rng.integers(0, 60)) / 7, float(rng.integers(1, 90)) / 4, int(rng.random() < 0.6)) for _ in range(700)]
    rows += [(1.0, 3.0, 1)] * 50 + [(None, 2.0, 1), (1.0, None, 0)]
    concordant = tied = pairs = 0
    known = [r for r in rows if None not in r]
    for s, t, e in known:
        if e:
            later = [x for x, u, f in known if u > t or (u == t and f == 0)]
            pairs += len(later)
            concordant += sum(x < s for x in later)
            tied += sum(x == s for x in later)
    df = spark.createDataFrame(rows, "risk double, survival_time double, survival_event int")
    for cells in (50_000, 20):
        monkeypatch.setattr(CC, "CELLS_PER_RANGE", cells)
        got = CC.concordance(df, "risk").first()
        assert (got["concordant"], got["tied"], got["pairs"], got["left_out"]) == (concordant, tied, pairs, 2)


@pytest.mark.parametrize("values", [[0.5], [0.5, 0.25], [0.0, 1.0, 2.0, -7.0]])
def test_concordance_of_few_risks_and_many_times(spark, monkeypatch, values):
    monkeypatch.setattr(CC, "CELLS_PER_RANGE", 50)
    rng = np.random.default_rng(8)
    risk, t, e = rng.choice(values, 900), rng.permutation(900) / 4, rng.integers(0, 2, 900)
    df = spark.createDataFrame([(float(a), float(b), int(c)) for a, b, c in zip(risk, t, e)],
                               "risk double, survival_time double, survival_event int")
    got = CC.concordance(df, "risk").first()
    assert (got["concordant"], got["tied"], got["pairs"]) == brute_concordance(risk, t, e)
    splits, levels, left_out = CC._ranges(df.toDF("risk", "t", "e").withColumn("n", F.lit(1)))
    assert len(splits) - 1 <= 2**levels and left_out == 0
    # every value has a range of its own, so no task counts its cells
    assert set(values) | {np.nextafter(v, np.inf) for v in values} == set(splits[1:-1])


def test_a_censored_loan_takes_its_last_row(spark):
    df = spark.createDataFrame([("a", 1.0, 0, "2017Q4", 1.0), ("a", 2.0, 0, "2017Q1", 2.0), ("a", 2.0, 0, "2018Q1", 3.0),
                                ("b", 1.0, 1, "2018Q1", 5.0), ("b", 1.0, 1, "2017Q1", 4.0), ("b", 3.0, 0, "2018Q1", 6.0)],
                               "LOAN_ID string, time double, event int, data_quarter string, x double")
    got = {r["LOAN_ID"]: (r["survival_time"], r["x"]) for r in T.survival_table(df, ["x"]).collect()}
    assert got == {"a": (2.0, 3.0), "b": (1.0, 4.0)}


def test_efron_sums_in_closed_form():
    for s0, d0, d in ((1e5, 5e4, 40_000), (5e4, 5e4, 40_000), (123.0, 7.0, 3_000), (10.0, 4.0, 5)):
        f = np.arange(d) / d
        u = s0 - f * d0
        want = [(1 / u).sum(), (f / u).sum(), (1 / u**2).sum(), (f / u**2).sum(), (f**2 / u**2).sum(), np.log(u).sum()]
        assert CX._efron_sums(s0, d0, d) == pytest.approx(want, rel=1e-10)


def naive_forest(rows, features, draws, params):
    """Splits of an unbinned forest: every cut of every tried feature, the log-rank statistic from its definition."""
    found = set()
    for tree, drawn in sorted(draws.items()):
        level = {1: [(rows[k], w) for k, w in drawn]}
        for _ in range(params.max_depth):
            deeper = {}
            for node, own in sorted(level.items()):
                best = None
                for f in FO.tried_features(params.seed, tree, node, len(features), max(1, int(len(features) ** 0.5))):
                    for cut in sorted({x[f] for (x, _, _), _ in own}):
                        left = [x[f] <= cut for (x, _, _), _ in own]
                        if min(sum(left), len(own) - sum(left)) < params.min_leaf or len(own) < params.min_split:
                            continue
                        u = v = 0.0
                        for t in sorted({t for (_, t, e), _ in own if e}):
                            y = sum(w for (_, s, _), w in own if s >= t)
                            y1 = sum(w for ((_, s, _), w), l in zip(own, left) if s >= t and l)
                            d = sum(w for (_, s, e), w in own if s == t and e)
                            u += sum(w for ((_, s, e), w), l in zip(own, left) if s == t and e and l) - d * y1 / y
                            v += d * (y1 / y) * (1 - y1 / y) * (y - d) / (y - 1) if y > 1 else 0.0
                        stat = round(abs(u) / v ** 0.5, 9) if v > 1e-12 and abs(u) > 1e-9 else 0.0
                        if stat > 0 and (best is None or (-stat, f, cut) < best[:3]):
                            best = (-stat, f, cut, left)
                if best:
                    _, f, cut, left = best
                    found.add((tree, node, f, cut))
                    for side in (0, 1):
                        part = [o for o, l in zip(own, left) if l == (side == 0)]
                        if len(part) >= max(params.min_split, 2 * params.min_leaf):
                            deeper[2 * node + side] = part
            level = deeper
    return found


@pytest.fixture(scope="module")
def days(spark):
    """Nearly as many values and times as rows, a few ties of both, one constant feature."""
    rng = np.random.default_rng(12)
    n = 260
    x, z = rng.normal(size=n), np.round(rng.normal(size=n), 1)
    t = np.round(rng.exponential(30 / np.exp(x)), 1)
    e = (rng.random(n) < 0.6).astype(int)
    rows = [(i, float(x[i]), float(z[i]), 1.0, float(t[i]), int(e[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "LOAN_ID long, x double, z double, flat double, survival_time double, survival_event int")
    return df, {r[0]: (r[1:4], r[4], r[5]) for r in rows}


EXACT = FO.ForestParams(trees=4, max_depth=4, sample=0.8, min_leaf=6, seed=3)


def split_set(model):
    return set(map(tuple, model.splits[["tree", "node", "feature", "cut"]].itertuples(index=False)))


@pytest.mark.parametrize("most", [200_000, 40])
def test_splits_are_those_of_an_unbinned_forest(days, monkeypatch, most):
    """Also when nodes of more than 40 rows are scored range by range."""
    monkeypatch.setattr(FO, "ROWS_PER_NODE", most)
    monkeypatch.setattr(FO, "CELLS_PER_TASK", 300)
    df, rows = days
    features = ["x", "z", "flat"]
    draws = {}
    for r in FO.bootstrap(df.select(F.col("LOAN_ID").alias("key")), EXACT).collect():
        draws.setdefault(r["tree"], []).append((r["key"], r["w"]))
    want = naive_forest(rows, features, draws, EXACT)
    assert len(want) > 10
    assert split_set(FO.fit_forest(df, features, params=EXACT)) == want


def test_forests_grown_together_are_those_grown_alone(days):
    df, _ = days
    lists = {"one": ["x", "flat"], "two": ["z", "x"]}
    both = FO.fit_forests(df, lists, params=EXACT)
    for name, features in lists.items():
        alone = FO.fit_forest(df, features, params=EXACT)
        assert split_set(both[name]) == split_set(alone)
        got, want = (m.score(df).toPandas().set_index("LOAN_ID")["risk"].sort_index() for m in (both[name], alone))
        assert np.allclose(got, want)
    plan = both["one"].score(df)._jdf.queryExecution().toString()
    assert "Python" not in plan  # scored in the JVM


def test_forest_rejects_missing_features(spark):
    df = spark.createDataFrame([("a", 1.0, 1, None), ("b", 2.0, 0, 1.0)], "LOAN_ID string, survival_time double, survival_event int, x double")
    with pytest.raises(ValueError):
        FO.fit_forest(df, ["x"])


def test_forest_pair_grows_the_whole_forests(monkeypatch):
    """The macro comparison's queries use the reference's forest: 50 trees of depth 10."""
    import inspect

    from verification import queries_survival as Q

    calls = []
    monkeypatch.setattr(Q, "surv_macro", lambda spark, d: None)
    real = inspect.signature(Q.run_forest_effect)
    monkeypatch.setattr(Q, "run_forest_effect", lambda *a, **b: calls.append(real.bind(*a, **b)))
    Q.forest_pair(None, None)
    calls[0].apply_defaults()
    used = calls[0].arguments["params"]
    assert used == FO.ForestParams() and (used.trees, used.max_depth, used.sample) == (50, 10, 0.1)


def test_small_nodes_are_grown_without_a_job_a_level(days, monkeypatch):
    """A level's rows are shuffled only while a node has more rows than one task should hold."""
    df, _ = days
    real, levels = FO._Grower._best_splits, []
    monkeypatch.setattr(FO._Grower, "_best_splits", lambda self, *nodes: levels.append(1) or real(self, *nodes))
    assert len(FO.fit_forest(df, ["x", "z", "flat"], params=EXACT).splits) and not levels
    few = "DataFrame[key: string, tree: int, w: int]"
    keys = df.sparkSession.createDataFrame([("a",), (None,), ("7",)], "key string")
    drawn = FO.bootstrap(keys, FO.ForestParams(trees=20, sample=5.0))
    assert str(drawn) == few and {r["key"] for r in drawn.collect()} == {"a", None, "7"}


def test_forest_score_follows_its_leaves(days):
    """Scores are the mean mortality of the leaves, also for NaN (above all cuts); a missing value has none."""
    df, _ = days
    model = FO.fit_forest(df, ["x", "z"], params=EXACT)
    odd = df.sparkSession.createDataFrame([(1, float("nan"), 0.5), (2, -9.0, float("inf")), (3, 0.1, float("nan")), (4, None, None)],
                                          "LOAN_ID long, x double, z double")
    dead = dict(zip(zip(model.mortality["tree"], model.mortality["node"]), model.mortality["mortality"]))
    got = {r["LOAN_ID"]: r["risk"] for r in model.score(odd).collect()}
    for name in (1, 2, 3):
        own = [dead[r["tree"], r["node"]] for r in model.leaves(odd).where(F.col("LOAN_ID") == name).collect()]
        assert len(own) == EXACT.trees and got[name] == pytest.approx(sum(own) / EXACT.trees)
    assert got[4] is None
    counts = {(r["tree"], r["node"]): r["n"] for r in model._rows_per_leaf(df).collect()}
    assert counts == {(r["tree"], r["node"]): r["n"] for r in model.leaves(df).groupBy("tree", "node").agg(F.count("*").alias("n")).collect()}


def test_a_large_forest_is_scored_without_its_nodes_in_the_plan(days):
    """Spark's own trees score; columns that cannot be missing need no question whether they are."""
    df, _ = days
    model = FO.fit_forest(df, ["x", "z"], params=FO.ForestParams(trees=50, max_depth=6, sample=0.8))
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in ("x", "z")})
    assert len(model.splits) > 200 and len(model.score(filled)._jdf.queryExecution().toString()) < 20_000
    own = model.leaves(df).join(df.sparkSession.createDataFrame(model.mortality), ["tree", "node"], "left")
    want = {r["LOAN_ID"]: r["m"] / 50 for r in own.groupBy("LOAN_ID").agg(F.sum("mortality").alias("m")).collect()}
    for rows in (df, filled):
        got = {r["LOAN_ID"]: r["risk"] for r in model.score(rows).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_both_forests_and_periods_share_one_concordance_run(days, monkeypatch):
    from loanpanel.plans import macro_effect as ME

    df, _ = days
    early = F.when(F.substring(F.md5(F.col("LOAN_ID").cast("string")), 1, 1) < "8", "2019-01-01").otherwise("2021-01-01").cast("date")
    df = df.select("LOAN_ID", "survival_time", "survival_event", "x", F.col("z").alias("alpha_PC1"), early.alias("macro_quarter"))
    real, runs = ME.concordance, []
    monkeypatch.setattr(ME, "concordance", lambda *a, **b: runs.append(1) or real(*a, **b))
    effect = ME.forest_effect(df, ["alpha_PC1"], params=EXACT)
    assert len(runs) == 1
    got = {(r["model"], r["part"]): r["c_index"] for r in effect.c_index.collect()}
    train, test = FE.time_split(FE.valid_survival(df))
    for name, model in (("Non-Macro", effect.non_macro), ("Full", effect.full)):
        for part, rows in (("train", train), ("test", test)):
            assert got[name, part] == CC.c_index(model.score(rows), "risk")


def test_draws_hash_all_keys_of_a_batch_at_once():
    """The first 64 bits of the MD5 of seed, tree and key: missing, empty, longer than one block, not of one width."""
    import hashlib

    import pyarrow as pa

    for keys in ([None, "a", "", "12345", "é" * 9, "x" * 40], ["y" * 200, None], ["7" * 50], ["7" * 52, "1"], [None], []):
        names = FO._Names(pa.array(keys, pa.string()))
        for prefix in (b"42:1", b"42:49"):
            texts = [prefix + (b"" if k is None else b":" + k.encode()) for k in keys]
            assert names.hashed(prefix).tolist() == [int.from_bytes(hashlib.md5(t).digest()[:8], "big") for t in texts]


def test_a_node_of_some_hundred_thousand_rows_is_grown_in_one_task():
    """Rows of few distinct values are counted, so a level of the task costs no sort of its rows."""
    import pandas as pd

    rng = np.random.default_rng(4)
    n = 300_000
    pdf = pd.DataFrame({"tree": 0, "node": 1, "time": rng.integers(1, 6, n).astype(float), "event": rng.integers(0, 2, n), "w": 1,
                        **{f"x{i}": rng.integers(0, most, n).astype(float) for i, most in enumerate((40, 5, 100_000, 25))}})
    params = FO.ForestParams(max_depth=6)
    sorts, real = [], np.argsort
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(FO.np, "argsort", lambda a, *more, **kind: (sorts.append((len(a), a.dtype.itemsize)), real(a, *more, **kind))[1])
        splits = FO._subtree(pdf, ["x0", "x1", "x2", "x3"], params, FO._chooser([[0, 1, 2, 3]], params))
    assert len(splits) > 6 and {"tree", "node", "feature", "cut", "left", "right"} <= set(splits.columns)
    assert sum(1 for size, width in sorts if size == n and width == 8) <= 4  # one sort by value a feature
    assert FO.ROWS_PER_NODE > n


def test_cox_queries_move_only_their_covariates(spark, monkeypatch):
    """A model of three covariates must not carry the others through the panel's shuffles."""
    from verification import queries_survival as Q

    monkeypatch.setattr(Q.FE.Scaler, "fit", classmethod(lambda cls, df, cols: cls({}, {})))
    scaled, cached = Q.scaled(spark, "/root/testdata/sf0.001", Q.TRIPLE)
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    cached.unpersist()
    assert "o_custkey" in plan and not any(c in plan for c in ("o_totalprice", "c_nationkey", "c_mktsegment"))


def test_concordance_of_groups_shares_jobs_and_ranges(spark, monkeypatch):
    """Each group's counts are those of a run on its rows alone; a null group counts nowhere."""
    rng = np.random.default_rng(21)
    rows = [(int(g), float(rng.integers(0, 40)) * (g + 1) / 7, float(rng.integers(1, 60)) / 4, int(rng.random() < 0.6))
            for g in (0, 1, 2) for _ in range(250)]
    rows += [(1, 3.0, 5.0, 1)] * 30 + [(2, None, 2.0, 1), (0, 1.0, None, 0), (None, 1.0, 1.0, 1), (3, None, 1.0, 1)]
    df = spark.createDataFrame(rows, "g int, risk double, survival_time double, survival_event int")
    for cells in (50_000, 20):
        monkeypatch.setattr(CC, "CELLS_PER_RANGE", cells)
        got = {x["g"]: tuple(x)[1:] for x in CC.concordance(df, "risk", by=["g"]).collect()}
        assert set(got) == {0, 1, 2, 3} and got[3] == (0.0, 0.0, 0.0, None, 1)
        for g in (0, 1, 2):
            assert got[g] == tuple(CC.concordance(df.where(F.col("g") == g), "risk").first())


def test_macro_effect_counts_all_concordance_at_once(spark, frame, monkeypatch):
    from loanpanel.plans import macro_effect as ME

    calls, count = [], ME.concordance
    monkeypatch.setattr(ME, "concordance", lambda *a, **k: calls.append(1) or count(*a, **k))
    df = frame.withColumns({"f_PC1": F.col("x"), "macro_quarter": F.when(F.col("LOAN_ID") % 3 == 0, F.lit("2021-04-01"))
                            .otherwise(F.lit("2019-01-01")).cast("date")}).drop("x", "LOAN_ID")
    out = macro_effect(df, ["f_PC1"])
    assert len(calls) == 1
    for name, model in (("Non-Macro", out.non_macro), ("Full", out.full)):
        risk = model.partial_hazard()
        alone = [CC.c_index(part[name].withColumn("risk", risk), "risk") for part in (out.train, out.test)]
        assert out.metrics.where(F.col("model") == name).first()["c_index"] == pytest.approx(alone[0], abs=1e-12)
        assert out.test_c_index[name] == pytest.approx(alone[1], abs=1e-12)


def test_survival_rows_are_dealt_by_loan_once(spark):
    """The join deals lines by loan; keeping the last row and the row per loan must not deal them again."""
    from verification import inputs as I
    from verification import queries_survival as Q

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = Q.T.survival_table(I.panel(spark, "/root/testdata/sf0.001"), ["OLTV"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) == 4 and sum("hashpartitioning(LOAN_ID" in line for line in dealt) == 2  # lines and loans, once each


def test_rows_are_sorted_into_blocks_once_a_fit(spark, frame, monkeypatch):
    """A fit sorts its rows into blocks once; evaluations of blocks of any size agree with those of rows."""
    beta = {"x": 0.3, "z": -0.2}
    want = CX.evaluate(frame, beta)
    calls, pack = [], CX._blocks
    monkeypatch.setattr(CX, "_blocks", lambda *a: calls.append(1) or pack(*a))
    model = CX.fit_cox(frame, ["x", "z"])
    assert len(calls) == 1 and model.rows == want.rows == frame.count()
    monkeypatch.setattr(CX, "BLOCK_BYTES", 64)
    blocks = pack(frame, ["x", "z"], "survival_event", "survival_time")
    sizes = [(r["n"], len(r["x"])) for r in blocks.collect()]
    assert sum(n for n, _ in sizes) == want.rows and all(1 <= n <= 4 and size == 16 * n for n, size in sizes)
    got = CX._evaluate(blocks, list(beta.values()), "efron")
    assert got.log_likelihood == pytest.approx(want.log_likelihood, rel=1e-12) and got.events == want.events
    assert np.allclose(got.gradient, want.gradient) and np.allclose(got.hessian, want.hessian)
