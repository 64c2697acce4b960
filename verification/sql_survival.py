"""DuckDB side of the survival queries: loan-level table, Newton iterations, pair counts."""

from math import exp, factorial

from loanpanel.operators.survival.forest import tried_features
from verification import sql as Q

ROW = "ORDER BY 1 - event, CASE WHEN event = 1 THEN time ELSE -time END, "\
    "CASE WHEN event = 1 THEN 1 ELSE -1 END * (cast(substring(data_quarter, 1, 4) AS int) * 4 + cast(substring(data_quarter, 6, 1) AS int))"
COVARIATES = ["OLTV", "DTI", "CSCORE_B", "ORIG_RATE", "ORIG_UPB", "balance_ratio", "rate_change",
              "credit_score_change", "alpha_PC1", "alpha_PC2", "beta_PC1", "beta_PC2"]


def surv_cte(source: str, covariates: list[str], macro: bool) -> str:
    cols = ", ".join(f"first({c} {ROW}) AS {c}" for c in covariates)
    quarter = (f", cast(date_trunc('quarter', strptime(first(act_period {ROW}), '%m%Y')) AS date) AS macro_quarter"
               if macro else "")
    return f"""surv AS (SELECT LOAN_ID, max(event) AS survival_event,
 coalesce(min(time) FILTER (event = 1), max(time)) AS survival_time, {cols}{quarter} FROM {source} GROUP BY LOAN_ID),
 valid AS (SELECT * FROM surv WHERE survival_time > 0 AND survival_event IN (0, 1))"""


STATIC = ["OLTV", "DTI", "ORIG_RATE", "ORIG_UPB"]
SURV = f"WITH {Q.PANEL_CTE},\n{surv_cte('panel', STATIC, False)}"
SURV_MACRO = f"WITH {Q.PANEL_MACRO_CTE},\n{surv_cte('panel_macro', COVARIATES, True)}"


def scaled_cte(cols: list[str], source: str = "valid", name: str = "std") -> str:
    z = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in cols)
    return f"{name} AS (SELECT LOAN_ID, survival_time, survival_event, {z} FROM {source})"


def _inverse(m: dict, p: int) -> tuple[str, dict]:
    """Determinant and adjugate of a symmetric matrix given by its entries' SQL."""
    def e(i, j):
        return m[min(i, j), max(i, j)]
    if p == 1:
        return e(0, 0), {(0, 0): "1"}
    if p == 2:
        return (f"({e(0, 0)}*{e(1, 1)} - {e(0, 1)}*{e(0, 1)})",
                {(0, 0): e(1, 1), (1, 1): e(0, 0), (0, 1): f"(-{e(0, 1)})"})
    adj = {}
    for i in range(3):
        for j in range(i, 3):
            a, b = [k for k in range(3) if k != i], [k for k in range(3) if k != j]
            sign = "" if (i + j) % 2 == 0 else "-"
            adj[i, j] = f"({sign}({e(a[0], b[0])}*{e(a[1], b[1])} - {e(a[0], b[1])}*{e(a[1], b[0])}))"
    det = "(" + " + ".join(f"{e(0, j)}*{adj[0, j]}" for j in range(3)) + ")"
    return det, adj


def evaluate_cte(n: str, b: str, cols: list[str], source: str, ties: str) -> str:
    """CTE ``n``: log-likelihood ``ll``, gradient ``g*``, information ``h*`` at table ``b`` (b0, b1, ..)."""
    p = range(len(cols))
    pairs = [(i, j) for i in p for j in p if i <= j]
    lin = " + ".join(f"b{i}*{cols[i]}" for i in p)
    raw = ["sum(w) AS s", *[f"sum(w*{cols[i]}) AS s{i}" for i in p],
           *[f"sum(w*{cols[i]}*{cols[j]}) AS s{i}{j}" for i, j in pairs]]
    dead = [x.replace(" AS s", " FILTER (e = 1) AS d") for x in raw]
    names = ["s", *[f"s{i}" for i in p], *[f"s{i}{j}" for i, j in pairs]]
    risk = ", ".join(f"sum({s}) OVER (ORDER BY t DESC) AS r{s[1:]}" for s in names)
    dx = ", ".join(f"coalesce(d{s[1:]}, 0) AS d{s[1:]}" for s in names)
    frac = "unnest(range(d_n)) / d_n" if ties == "efron" else "unnest(range(d_n)) * 0e0"
    means = ", ".join(f"(r{i} - f*d{i}) / u AS m{i}" for i in p)
    return f"""{n}_w AS (SELECT survival_time AS t, survival_event AS e, {', '.join(cols)}, {lin} AS eta, exp({lin}) AS w FROM {source}, {b}),
{n}_g AS (SELECT t, count(*) AS c, count(*) FILTER (e = 1) AS d_n, {', '.join(raw)}, {', '.join(dead)} FROM {n}_w GROUP BY t),
{n}_r AS (SELECT t, d_n, {risk}, {dx} FROM {n}_g),
{n}_j AS (SELECT *, {frac} AS f FROM {n}_r WHERE d_n > 0),
{n}_u AS (SELECT *, r - f*d AS u FROM {n}_j),
{n}_m AS (SELECT *, {means} FROM {n}_u),
{n}_s AS (SELECT sum(ln(u)) AS logs, {', '.join(f'sum(m{i}) AS e{i}' for i in p)},
 {', '.join(f'sum((r{i}{j} - f*d{i}{j}) / u - m{i}*m{j}) AS h{i}{j}' for i, j in pairs)} FROM {n}_m),
{n}_x AS (SELECT count(*) AS n, count(*) FILTER (e = 1) AS events, sum(eta) FILTER (e = 1) AS eta,
 {', '.join(f'sum({cols[i]}) FILTER (e = 1) AS x{i}' for i in p)} FROM {n}_w),
{n} AS (SELECT n, events, eta - logs AS ll, {', '.join(f'x{i} - e{i} AS g{i}' for i in p)},
 {', '.join(f'h{i}{j}' for i, j in pairs)}, {', '.join(f'b{i}' for i in p)} FROM {n}_s, {n}_x, {b})"""


def fit_cte(name: str, cols: list[str], source: str = "std", ties: str = "efron", penalizer: float = 0.1,
            iterations: int = 5) -> str:
    """CTE ``name``: Newton iterations from zero, unrolled; covariance as ``v<i><i>``."""
    p = range(len(cols))
    out = [f"{name}_b0 AS (SELECT {', '.join(f'0e0 AS b{i}' for i in p)})"]

    def info(i, j):
        return f"(h{i}{j} + {penalizer if i == j else 0}*n)"
    m = {(i, j): info(i, j) for i in p for j in p if i <= j}
    det, adj = _inverse(m, len(cols))
    inv = {(i, j): f"({adj[min(i, j), max(i, j)]} / {det})" for i in p for j in p}
    for k in range(iterations):
        out.append(evaluate_cte(f"{name}_e{k}", f"{name}_b{k}", cols, source, ties))
        moved = [f"b{i} + " + " + ".join(f"{inv[i, j]}*(g{j} - {penalizer}*n*b{j})" for j in p) + f" AS b{i}" for i in p]
        out.append(f"{name}_b{k + 1} AS (SELECT {', '.join(moved)} FROM {name}_e{k})")
    out.append(evaluate_cte(f"{name}_e", f"{name}_b{iterations}", cols, source, ties))
    pen = " + ".join(f"b{i}*b{i}" for i in p)
    out.append(f"{name} AS (SELECT *, ll - {penalizer}*n*0.5*({pen}) AS pll, {', '.join(f'{inv[i, i]} AS v{i}' for i in p)} FROM {name}_e)")
    return ",\n".join(out)


def concordance_cte(name: str, risk: str, source: str) -> str:
    """CTE ``name`` with all comparable pairs counted one by one over (risk, time, event) cells."""
    return f"""{name}_c AS (SELECT {risk} AS s, survival_time AS t, survival_event AS e, count(*) AS n FROM {source} GROUP BY ALL),
{name} AS (SELECT cast(sum(CASE WHEN b.s < a.s THEN a.n * b.n ELSE 0 END) AS bigint) AS concordant,
 cast(sum(CASE WHEN b.s = a.s THEN a.n * b.n ELSE 0 END) AS bigint) AS tied, cast(sum(a.n * b.n) AS bigint) AS pairs
 FROM {name}_c a JOIN {name}_c b ON a.e = 1 AND (b.t > a.t OR (b.t = a.t AND b.e = 0)))"""


def bootstrap_cte(params, source: str = "valid") -> str:
    """CTE ``drawn``: the loans a tree draws and how often, by Poisson quantiles of a hash."""
    steps = [sum(exp(-params.sample) * params.sample**j / factorial(j) for j in range(k + 1)) for k in range(14)]
    u = f"(('0x' || substr(md5('{params.seed}:' || tree || ':' || LOAN_ID), 1, 13))::bigint + 0.5) / 4503599627370496e0"
    weight = " + ".join(f"(u >= {p!r})::int" for p in steps)
    return (f"drawn AS (SELECT LOAN_ID, tree::int AS tree, ({weight})::int AS w FROM (SELECT *, {u} AS u FROM"
            f" (SELECT LOAN_ID, unnest(range({params.trees})) AS tree FROM {source})) WHERE u >= {steps[0]!r})")


def _level_cte(n: int, placed: str, params, tried: dict) -> str:
    """CTE ``best<n>``: the best log-rank split of every node of ``placed`` that has one."""
    pairs = ", ".join(f"({t}, {node}, {f})" for (t, node), fs in sorted(tried.items()) for f in fs)
    return f"""
tried{n}(tree, node, feature) AS (VALUES {pairs}),
cells{n} AS (SELECT p.tree, p.node, feature, bins[feature + 1] AS bin, time, count(*) AS rows, sum(w) AS n, sum(w * event) AS d
  FROM {placed} p JOIN tried{n} t ON p.tree = t.tree AND p.node = t.node GROUP BY ALL),
cuts{n} AS (SELECT DISTINCT a.tree, a.node, a.feature, c.cut, a.time FROM
  (SELECT DISTINCT tree, node, feature, time FROM cells{n}) a, (SELECT unnest(range({params.bins})) AS cut) c),
at{n} AS (SELECT k.tree, k.node, k.feature, cut, k.time,
  coalesce(sum(n) FILTER (bin <= cut AND c.time >= k.time), 0) AS y1, sum(n) FILTER (c.time >= k.time) AS y,
  coalesce(sum(d) FILTER (bin <= cut AND c.time = k.time), 0) AS d1, coalesce(sum(d) FILTER (c.time = k.time), 0) AS d
  FROM cuts{n} k JOIN cells{n} c ON k.tree = c.tree AND k.node = c.node AND k.feature = c.feature GROUP BY ALL),
sizes{n} AS (SELECT k.tree, k.node, k.feature, cut, coalesce(sum(rows) FILTER (bin <= cut), 0) AS lft, sum(rows) AS al
  FROM (SELECT DISTINCT tree, node, feature, cut FROM cuts{n}) k
  JOIN cells{n} c ON k.tree = c.tree AND k.node = c.node AND k.feature = c.feature GROUP BY ALL),
stat{n} AS (SELECT tree, node, feature, cut, abs(sum(d1 - d * y1 / y)) AS u,
  sum(CASE WHEN y > 1 THEN d * (y1 / y) * (1 - y1 / y) * (y - d) / (y - 1) ELSE 0 END) AS v FROM at{n} GROUP BY ALL),
best{n} AS (SELECT tree, node, feature, cut AS bin, lft, al - lft AS rgt FROM (
  SELECT s.*, lft, al, row_number() OVER (PARTITION BY s.tree, s.node ORDER BY round(u / sqrt(v), 9) DESC, s.feature, s.cut) AS k
  FROM stat{n} s JOIN sizes{n} z ON s.tree = z.tree AND s.node = z.node AND s.feature = z.feature AND s.cut = z.cut
  WHERE v > 1e-12 AND u > 1e-9 AND lft >= {params.min_leaf} AND al - lft >= {params.min_leaf} AND al >= {params.min_split}) WHERE k = 1),
placed{n} AS (SELECT p.* REPLACE (CASE WHEN b.tree IS NULL THEN p.node
  ELSE 2 * p.node + (bins[b.feature + 1] > b.bin)::int END AS node) FROM {placed} p
  LEFT JOIN best{n} b ON p.tree = b.tree AND p.node = b.node)"""


def forest_cte(params, features: list[str], source: str = "valid") -> str:
    """CTEs of a two-level forest: ``splits``, ``score`` (LOAN_ID, risk) and ``curve`` (time, s)."""
    most = max(1, int(len(features) ** 0.5))
    probs = ", ".join(f"{i / params.bins!r}" for i in range(1, params.bins))
    edges = ", ".join(f"list_sort(list_distinct(quantile_cont({c}, [{probs}]))) AS e{i}" for i, c in enumerate(features))
    bins = ", ".join(f"len(list_filter(e{i}, lambda x: {c} > x))" for i, c in enumerate(features))
    draws = [{(t, node): tried_features(params.seed, t, node, len(features), most) for t in range(params.trees) for node in nodes}
             for nodes in ((1,), (2, 3))]
    need = max(params.min_split, 2 * params.min_leaf)
    route = "SELECT LOAN_ID, tree, 1 AS node, bins FROM binned, (SELECT unnest(range({0}))::int AS tree)".format(params.trees)
    return f""",
edges AS (SELECT {edges} FROM {source}),
binned AS (SELECT LOAN_ID, survival_time AS time, survival_event AS event, [{bins}] AS bins FROM {source}, edges),
{bootstrap_cte(params, source)},
placed0 AS (SELECT d.tree, 1 AS node, b.LOAN_ID, w, time, event, bins FROM drawn d JOIN binned b USING (LOAN_ID)),
{_level_cte(1, 'placed0', params, draws[0])},
open1 AS (SELECT p.* FROM placed1 p JOIN best1 b ON p.tree = b.tree AND p.node // 2 = b.node
  AND CASE WHEN p.node % 2 = 0 THEN lft ELSE rgt END >= {need}),
{_level_cte(2, 'open1', params, draws[1])},
splits AS (SELECT tree::int AS tree, node::int AS node, feature::int AS feature, bin::int AS bin FROM
  (SELECT * FROM best1 UNION ALL SELECT * FROM best2)),
down1 AS (SELECT p.* REPLACE (CASE WHEN s.tree IS NULL THEN p.node ELSE 2 * p.node + (bins[s.feature + 1] > s.bin)::int END AS node)
  FROM placed0 p LEFT JOIN splits s ON p.tree = s.tree AND p.node = s.node),
down2 AS (SELECT p.* REPLACE (CASE WHEN s.tree IS NULL THEN p.node ELSE 2 * p.node + (bins[s.feature + 1] > s.bin)::int END AS node)
  FROM down1 p LEFT JOIN splits s ON p.tree = s.tree AND p.node = s.node),
leaf AS (SELECT tree, node, time, sum(w) AS n, sum(w * event) AS d FROM down2 GROUP BY ALL),
haz AS (SELECT tree, node, time, h FROM (SELECT tree, node, time, d / sum(n) OVER (PARTITION BY tree, node ORDER BY time DESC) AS h
  FROM leaf) WHERE h > 0),
grid AS (SELECT DISTINCT survival_time AS time FROM {source} WHERE survival_event = 1),
mortality AS (SELECT tree, node, sum(h * (SELECT count(*) FROM grid g WHERE g.time >= haz.time)) AS m FROM haz GROUP BY ALL),
all0 AS ({route}),
all1 AS (SELECT p.* REPLACE (CASE WHEN s.tree IS NULL THEN p.node ELSE 2 * p.node + (bins[s.feature + 1] > s.bin)::int END AS node)
  FROM all0 p LEFT JOIN splits s ON p.tree = s.tree AND p.node = s.node),
all2 AS (SELECT p.* REPLACE (CASE WHEN s.tree IS NULL THEN p.node ELSE 2 * p.node + (bins[s.feature + 1] > s.bin)::int END AS node)
  FROM all1 p LEFT JOIN splits s ON p.tree = s.tree AND p.node = s.node),
score AS (SELECT LOAN_ID, sum(coalesce(m, 0)) / {params.trees} AS risk FROM all2 a LEFT JOIN mortality m
  ON a.tree = m.tree AND a.node = m.node GROUP BY LOAN_ID),
alive AS (SELECT a.tree, a.node, a.time, a.h * coalesce((SELECT CASE WHEN max(b.h) >= 1 THEN 0 ELSE exp(sum(ln(1 - least(b.h, 1 - 1e-15)))) END
  FROM haz b WHERE b.tree = a.tree AND b.node = a.node AND b.time < a.time), 1) AS fall FROM haz a),
falls AS (SELECT time, sum(fall * c) AS f FROM alive JOIN (SELECT tree, node, count(*) AS c FROM all2 GROUP BY ALL) USING (tree, node) GROUP BY time),
curve AS (SELECT time, 1 - sum(f) OVER (ORDER BY time) / (SELECT count(*) FROM all2) AS s FROM falls)"""
