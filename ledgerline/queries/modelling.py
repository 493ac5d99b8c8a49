"""Queries on sample rules, design matrices, models and run reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.config import PanelConfig
from ledgerline.functions import scalars as S
from ledgerline.operators import aggregates as A
from ledgerline.operators import design, linear, metrics, models, preprocess, sample
from ledgerline.plans import training
from ledgerline.plans.panel import PreparedPanel, prepare_panel
from ledgerline.queries import fixtures as fx
from ledgerline.queries.registry import query
from ledgerline.session import materialize, scratch_path
from ledgerline.sources.series import index_table, macro_table

# --- sample rules -------------------------------------------------------------------------

_LOG = "logged AS (SELECT id, date, ln(total_assets) AS x FROM panel)"


def _logged(spark, sf):
    return fx.panel(spark, sf).select("id", "date", S.log_floor("total_assets").alias("x"))


@query(
    "top_n_entities", "id date:d x:6", "panel", _LOG,
    "SELECT * FROM logged WHERE id IN (SELECT id FROM logged GROUP BY id ORDER BY avg(x) DESC, id LIMIT 20)",
)
def top_n_entities(spark, sf):
    return sample.largest_entities(_logged(spark, sf), "x", 20)


def _key(seed: int) -> str:
    return f"substr(md5(id || ':{seed}'), 1, 12)"


@query(
    "sample_entities", "id date:d x:6", "panel", _LOG,
    f"SELECT * FROM logged WHERE id IN (SELECT id FROM (SELECT DISTINCT id FROM logged) ORDER BY {_key(42)}, id LIMIT 25)",
)
def sample_entities(spark, sf):
    return sample.sample_entities(_logged(spark, sf), 25, 42)


_RATIOS = """ratios AS (SELECT id, date, total_assets, total_deposits / total_assets AS deposit_ratio, net_income / total_assets AS roa,
  total_equity / total_assets AS equity, ln(total_assets) AS log_total_assets FROM panel)"""


def _ratios(spark, sf):
    return fx.panel(spark, sf).select(
        "id", "date", "total_assets", S.ratio("total_deposits", "total_assets").alias("deposit_ratio"),
        S.ratio("net_income", "total_assets").alias("roa"), S.ratio("total_equity", "total_assets").alias("equity"),
        S.log_floor("total_assets").alias("log_total_assets"),
    )


def _outlier_sql(source: str, targets: list[str], k: float, prefix: str) -> str:
    parts, last = [], source
    for i, t in enumerate(targets):
        name = f"{prefix}{i}"
        parts.append(
            f"{name} AS (SELECT s.* FROM {last} s, (SELECT avg({t}) AS m, stddev_samp({t}) AS d FROM {last}) WHERE {t} IS NULL OR d = 0 OR d IS NULL OR abs(({t} - m) / d) < {k})"
        )
        last = name
    return ",\n".join(parts)


@query(
    "zscore_outlier_filter", "id date:d equity:6 roa:6 deposit_ratio:6", "panel", _RATIOS, _outlier_sql("ratios", ["equity", "roa", "deposit_ratio"], 2.0, "o"),
    "SELECT * FROM o2",
)
def zscore_outlier_filter(spark, sf):
    rows = materialize(_ratios(spark, sf), "ratios")
    return sample.remove_outliers(rows, ["equity", "roa", "deposit_ratio"], 2.0)


@query(
    "winsorize", "id date:d equity:6 roa:6", "panel", _RATIOS,
    """SELECT id, date, CASE WHEN equity IS NULL THEN NULL ELSE least(greatest(equity, e1), e2) END AS equity, least(greatest(roa, r1), r2) AS roa
       FROM ratios, (SELECT quantile_cont(equity, 0.01) AS e1, quantile_cont(equity, 0.99) AS e2, quantile_cont(roa, 0.01) AS r1, quantile_cont(roa, 0.99) AS r2 FROM ratios)""",
)
def winsorize(spark, sf):
    return sample.winsorize(_ratios(spark, sf), ["equity", "roa"], 0.01, 0.99)


_RESTRICT = """r1 AS (SELECT * FROM ratios WHERE date BETWEEN DATE '1996-01-01' AND DATE '2000-10-01'),
r2 AS (SELECT * FROM (SELECT *, coalesce(abs(deposit_ratio - lag(deposit_ratio) OVER (PARTITION BY id ORDER BY date)), 0) AS step FROM r1) WHERE step <= 0.2),
r3 AS (SELECT * FROM r2 WHERE id IN (SELECT id FROM r2 GROUP BY id HAVING avg(total_assets) >= 1100000)),
r4 AS (SELECT * FROM r3 WHERE id IN (SELECT id FROM r3 GROUP BY id HAVING min(deposit_ratio) >= 0.33)),
r5 AS (SELECT * FROM r4 WHERE id IN (SELECT id FROM r4 GROUP BY id ORDER BY avg(log_total_assets) DESC, id LIMIT 40))"""


@query(
    "restrict_sample", "id date:d deposit_ratio:6 total_assets:4", "panel", _RATIOS, _RESTRICT,
    f"SELECT * FROM r5 WHERE id IN (SELECT id FROM (SELECT DISTINCT id FROM r5) ORDER BY {_key(42)}, id LIMIT 15)",
)
def restrict_sample(spark, sf):
    cfg = PanelConfig(
        data_begin="1996-01-01", data_end="2000-10-01", max_ratio_change=0.2, min_mean_size=1100000.0, min_ratio=0.33,
        largest_entities=40, sample_entities=15,
    )
    return sample.restrict_sample(_ratios(spark, sf), cfg)


# --- splits, scaling, design --------------------------------------------------------------

_CUT = "(SELECT list_sort(list(DISTINCT date)) AS ds FROM {t})"


@query(
    "split_by_date", "split rows:i first:d last:d", "thin",
    """SELECT split, count(*) AS rows, min(date) AS first, max(date) AS last FROM (SELECT date, CASE WHEN date <= ds[len(ds) - CAST(ceil(len(ds) * 0.2) AS INT)] THEN 'train' ELSE 'test' END AS split
       FROM thin, (SELECT list_sort(list(DISTINCT date)) AS ds FROM thin)) GROUP BY split""",
)
def split_by_date(spark, sf):
    rows = design.split_by_date(fx.thin(spark, sf), 0.2)
    return rows.groupBy("split").agg(F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last"))


@query(
    "split_by_entity", "id date:d split", "thin",
    f"""SELECT id, date, CASE WHEN id IN (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY {_key(42)}, id) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT id FROM thin))
        WHERE rn <= ceil(n * 0.2)) THEN 'test' ELSE 'train' END AS split FROM thin""",
)
def split_by_entity(spark, sf):
    return design.split_by_entity(fx.thin(spark, sf), 0.2, 42)


@query(
    "standard_scale", "id date:d split num__total_assets:6 num__roa:6 num__one:6", "panel", _RATIOS,
    """SELECT id, date, CASE WHEN date <= DATE '1999-10-01' THEN 'train' ELSE 'test' END AS split, (total_assets - ma) / sa AS num__total_assets, (roa - mr) / sr AS num__roa, 0.0 AS num__one
       FROM ratios, (SELECT avg(total_assets) AS ma, stddev_pop(total_assets) AS sa, avg(roa) AS mr, stddev_pop(roa) AS sr FROM ratios WHERE date <= DATE '1999-10-01')""",
)
def standard_scale(spark, sf):
    rows = design.split_by_date(_ratios(spark, sf), "1999-10-01").withColumn("one", F.lit(1.0))
    return design.standard_scale(rows, ["total_assets", "roa", "one"])


@query(
    "one_hot", "id date:d cat__level_q1:0 cat__level_q2:0 cat__level_q3:0 cat__level_q4:0", "panel",
    """SELECT id, date, """ + ", ".join(f"CASE WHEN date <= DATE '1999-10-01' AND quarter(date) = {q} THEN 1.0 ELSE 0.0 END AS cat__level_q{q}" for q in (1, 2, 3, 4)) + " FROM panel",
)
def one_hot(spark, sf):
    # The level names of the test rows do not occur in training.
    rows = design.split_by_date(fx.panel(spark, sf), "1999-10-01")
    level = F.concat(F.when(F.col("split") == "train", "q").otherwise("late_q"), F.quarter("date"))
    rows = rows.select("id", "date", "split", level.alias("level"))
    return design.one_hot(rows, "level", design.train_levels(rows, "level"))


_DESIGN_CFG = PanelConfig(lags=2, test_split=0.2)
_DESIGN = f"""w1 AS (SELECT id, date, roa, deposit_ratio, equity, 'quarter_' || quarter(date) AS quarter, lag(roa, 1) OVER w AS roa_ar_lag_1, lag(roa, 2) OVER w AS roa_ar_lag_2 FROM ratios WINDOW w AS (PARTITION BY id ORDER BY date)),
w2 AS (SELECT * FROM w1 WHERE roa IS NOT NULL AND roa_ar_lag_1 IS NOT NULL AND roa_ar_lag_2 IS NOT NULL),
w3 AS (SELECT w2.*, CASE WHEN date <= ds[len(ds) - CAST(ceil(len(ds) * 0.2) AS INT)] THEN 'train' ELSE 'test' END AS split FROM w2, {_CUT.format(t='w2')}),
w4 AS (SELECT *, lead(roa, 1) OVER (PARTITION BY split, id ORDER BY date) AS label, lag(deposit_ratio, 1) OVER w AS deposit_ratio_lag_1, lag(deposit_ratio, 2) OVER w AS deposit_ratio_lag_2,
  lag(equity, 1) OVER w AS equity_lag_1, lag(equity, 2) OVER w AS equity_lag_2 FROM w3 WINDOW w AS (PARTITION BY id ORDER BY date)),
design AS (SELECT * FROM w4 WHERE label IS NOT NULL AND deposit_ratio IS NOT NULL AND deposit_ratio_lag_1 IS NOT NULL AND deposit_ratio_lag_2 IS NOT NULL AND equity IS NOT NULL
  AND equity_lag_1 IS NOT NULL AND equity_lag_2 IS NOT NULL)"""
_DESIGN_NUM = ["deposit_ratio", "deposit_ratio_lag_1", "deposit_ratio_lag_2", "equity", "equity_lag_1", "equity_lag_2", "roa_ar_lag_1", "roa_ar_lag_2"]


def _design(spark, sf):
    rows = _ratios(spark, sf).withColumn("quarter", design.quarter_effect())
    return design.horizon_dataset(rows, "roa", 1, _DESIGN_CFG, ["deposit_ratio", "equity"], ["quarter"])


@query(
    "horizon_dataset", "id date:d split label:6 " + " ".join(f"num__{c}:6" for c in _DESIGN_NUM) + " " + " ".join(f"cat__quarter_quarter_{q}:0" for q in (1, 2, 3, 4)),
    "panel", _RATIOS, _DESIGN,
    "SELECT id, date, split, label, " + ", ".join(f"({c} - avg({c}) FILTER (split = 'train') OVER ()) / stddev_pop({c}) FILTER (split = 'train') OVER () AS num__{c}" for c in _DESIGN_NUM)
    + ", " + ", ".join(f"CASE WHEN quarter = 'quarter_{q}' THEN 1.0 ELSE 0.0 END AS cat__quarter_quarter_{q}" for q in (1, 2, 3, 4)) + " FROM design",
)
def horizon_dataset(spark, sf):
    return design.scale_and_encode(materialize(_design(spark, sf), "design"), ["quarter"])


@query(
    "expanding_time_folds", "fold:i role rows:i first:d last:d", "thin",
    """SELECT fold, role, count(*) AS rows, min(date) AS first, max(date) AS last FROM (SELECT i + 1 AS fold, date, CASE WHEN date <= ds[n - (3 - i) * b] THEN 'train'
         WHEN date BETWEEN ds[n - (3 - i) * b + 1] AND ds[n - (3 - i) * b + b] THEN 'test' END AS role
         FROM thin, (SELECT list_sort(list(DISTINCT date)) AS ds, len(list(DISTINCT date)) AS n, len(list(DISTINCT date)) // 4 AS b FROM thin), range(3) t(i))
       WHERE role IS NOT NULL GROUP BY fold, role""",
)
def expanding_time_folds(spark, sf):
    rows = fx.thin(spark, sf)
    return design.fold_rows(rows, design.expanding_folds(rows, 3)).groupBy("fold", "role").agg(
        F.count("*").alias("rows"), F.min("date").alias("first"), F.max("date").alias("last")
    )


# --- the whole preparation ----------------------------------------------------------------

PREP_CFG = PanelConfig(
    targets=("interest_income_to_assets", "net_charge_offs_to_loans_and_leases"),
    features={
        "deposit_ratio": "bank", "equity_to_asset_ratio": "bank", "log_total_assets": "bank", "gdp_qoq": "macro",
        "sp500_qoq": "macro", "never_reported": "macro", "is_structural_break": "bank",
    },
    outlier_threshold=2.5, min_obs_per_entity=20, largest_entities=60, break_std_threshold=1.5, winsorize=("deposit_ratio",),
)
_PREP_ENTITY = ["deposit_ratio", "equity_to_asset_ratio", "log_total_assets", *PREP_CFG.targets, "total_assets"]
_PREP_OUT = ["deposit_ratio", "equity_to_asset_ratio", "log_total_assets", "gdp_qoq", "sp500_qoq", *PREP_CFG.targets, "is_structural_break", "total_assets_qoq", "deposit_ratio_diff"]
_PREP = f"""p0 AS (SELECT * REPLACE (CASE WHEN total_rwa < 0.35 * total_assets THEN NULL ELSE total_assets END AS total_assets) FROM panel WHERE date IN (SELECT date FROM macro)),
p1 AS (SELECT i.id, g.date, p0.* EXCLUDE (id, date) FROM (SELECT DISTINCT id FROM p0) i CROSS JOIN
  (SELECT CAST(unnest(generate_series((SELECT min(date) FROM p0), (SELECT max(date) FROM p0), INTERVAL 3 MONTH)) AS DATE) AS date) g LEFT JOIN p0 ON p0.id = i.id AND p0.date = g.date),
p2 AS (SELECT * FROM (SELECT * REPLACE (coalesce(total_assets, CASE WHEN lead(total_assets) OVER w IS NOT NULL THEN lag(total_assets) OVER w END) AS total_assets) FROM p1
  WINDOW w AS (PARTITION BY id ORDER BY date)) WHERE total_assets IS NOT NULL),
p3 AS (SELECT id, date, total_assets, total_deposits / total_assets AS deposit_ratio, total_equity / total_assets AS equity_to_asset_ratio, ln(total_assets) AS log_total_assets,
  interest_income / total_assets AS interest_income_to_assets, net_charge_offs / total_loans_and_leases AS net_charge_offs_to_loans_and_leases FROM p2),
p4 AS (SELECT *, deposit_ratio - lag(deposit_ratio) OVER w AS deposit_ratio_diff, total_assets / lag(total_assets) OVER w - 1 AS total_assets_qoq FROM p3 WINDOW w AS (PARTITION BY id ORDER BY date)),
p5 AS (SELECT p4.*, m.gdp_qoq, x.sp500_qoq FROM p4 JOIN (SELECT date, gdp / lag(gdp) OVER (ORDER BY date) - 1 AS gdp_qoq FROM macro) m USING (date)
  LEFT JOIN (SELECT date, sp500 / lag(sp500) OVER (ORDER BY date) - 1 AS sp500_qoq FROM index_q) x USING (date)),
p6 AS (SELECT * FROM p5 WHERE id IN (SELECT id FROM p5 GROUP BY id HAVING count(log_total_assets) >= 20)),
{_outlier_sql('p6', list(PREP_CFG.targets), 2.5, 'po')},
p7 AS (SELECT * FROM po1 WHERE id IN (SELECT id FROM po1 GROUP BY id ORDER BY avg(log_total_assets) DESC, id LIMIT 60)),
p8 AS (SELECT *, log_total_assets - lag(log_total_assets) OVER w AS step, lag(log_total_assets) OVER w AS prev FROM p7 WINDOW w AS (PARTITION BY id ORDER BY date)),
p9 AS (SELECT *, CASE WHEN abs(step) > 1.5 * (SELECT stddev_samp(step) FROM p8) THEN 1.0 ELSE 0.0 END AS is_structural_break FROM p8),
p10 AS (SELECT * REPLACE (log_total_assets * coalesce(product(CASE WHEN is_structural_break = 1 AND prev <> 0 THEN log_total_assets / prev END)
  OVER (PARTITION BY id ORDER BY date ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 1) AS log_total_assets) FROM p9),
prepared AS (SELECT * REPLACE (least(greatest(deposit_ratio, (SELECT quantile_cont(deposit_ratio, 0.01) FROM p10)), (SELECT quantile_cont(deposit_ratio, 0.99) FROM p10)) AS deposit_ratio),
  'quarter_' || quarter(date) AS quarter FROM p10)"""


def prepared(spark, sf):
    panel = fx.panel(spark, sf).withColumn(
        "total_assets", F.when(F.col("total_rwa") < 0.35 * F.col("total_assets"), F.lit(None)).otherwise(F.col("total_assets"))
    )
    macro = materialize(macro_table(fx.macro_long(spark, sf)), "macro")
    index = materialize(index_table(fx.daily_index(spark, sf), "close"), "index")
    return prepare_panel(panel, macro, index, PREP_CFG)


@query(
    "prepare_panel", "id date:d quarter " + " ".join(f"{c}:6" for c in _PREP_OUT), "panel", "macro", "daily", "index_q", _PREP,
    "SELECT * FROM prepared",
)
def prepare_panel_query(spark, sf):
    return prepared(spark, sf).data


@query(
    "prepare_stage_stats", "stage rows:i entities:i min_date:d max_date:d", "panel", "macro", "daily", "index_q", _PREP,
    " UNION ALL ".join(
        f"SELECT '{s}' AS stage, count(*) AS rows, count(DISTINCT id) AS entities, min(date) AS min_date, max(date) AS max_date FROM {t}"
        for s, t in (("features", "p5"), ("min_observations", "p6"), ("outliers", "po1"), ("restricted", "p7"))
    ),
)
def prepare_stage_stats(spark, sf):
    return prepared(spark, sf).stages


# --- models -------------------------------------------------------------------------------

_XY = """xy AS (SELECT id, date, roa AS label, x1, x2, CASE WHEN date <= DATE '1999-10-01' THEN 'train' ELSE 'test' END AS split FROM (
  SELECT id, date, net_income / total_assets AS roa, interest_income / total_assets AS x1, total_deposits / total_assets AS x2 FROM panel)),
fit AS (SELECT covar_pop(label, x1) AS c1, covar_pop(label, x2) AS c2, covar_pop(x1, x2) AS c12, var_pop(x1) AS v1, var_pop(x2) AS v2, avg(label) AS my, avg(x1) AS m1, avg(x2) AS m2 FROM xy WHERE split = 'train'),
ols AS (SELECT *, (c1 * v2 - c2 * c12) / (v1 * v2 - c12 * c12) AS b1, (c2 * v1 - c1 * c12) / (v1 * v2 - c12 * c12) AS b2 FROM fit)"""


def _xy(spark, sf):
    rows = fx.panel(spark, sf).select(
        "id", "date", S.ratio("net_income", "total_assets").alias("label"), S.ratio("interest_income", "total_assets").alias("x1"),
        S.ratio("total_deposits", "total_assets").alias("x2"),
    )
    return materialize(design.split_by_date(rows, "1999-10-01"), "xy")


def _train(rows):
    return rows.filter("split = 'train'")


@query("mean_baseline", "id date:d split prediction:6", "panel", _XY, "SELECT id, date, split, my AS prediction FROM xy, fit")
def mean_baseline(spark, sf):
    rows = _xy(spark, sf)
    return models.fit(models.MEAN, _train(rows), ["x1", "x2"]).predict(rows)


@query(
    "ols", "model feature importance:6", "panel", _XY,
    "SELECT 'LinearRegression' AS model, 'x1' AS feature, b1 AS importance FROM ols UNION ALL SELECT 'LinearRegression', 'x2', b2 FROM ols",
)
def ols(spark, sf):
    return models.importance_table(spark, [models.fit(models.OLS, _train(_xy(spark, sf)), ["x1", "x2"])])


@query(
    "ols_cross_products", "feature importance:6 intercept:6", "panel", _XY,
    "SELECT 'x1' AS feature, b1 AS importance, my - b1 * m1 - b2 * m2 AS intercept FROM ols UNION ALL SELECT 'x2', b2, my - b1 * m1 - b2 * m2 FROM ols",
)
def ols_cross_products(spark, sf):
    beta, intercept = linear.solve(linear.cross_products(_train(_xy(spark, sf)), ["x1", "x2"]))
    return spark.createDataFrame([(f, float(b), intercept) for f, b in zip(["x1", "x2"], beta)], "feature string, importance double, intercept double")


@query("batch_score", "id date:d split prediction:6", "panel", _XY, "SELECT id, date, split, my + b1 * (x1 - m1) + b2 * (x2 - m2) AS prediction FROM xy, ols")
def batch_score(spark, sf):
    rows = _xy(spark, sf)
    fitted = models.fit(models.OLS, _train(rows), ["x1", "x2"])
    return models.predictions(fitted, rows, "roa", 1)


def _within(rows: str, a: str, b: str) -> str:
    """Slopes of two features and entity levels: least squares on what is left of entity means."""
    return f"""dev AS (SELECT label - avg(label) OVER w AS y, {a} - avg({a}) OVER w AS u, {b} - avg({b}) OVER w AS v FROM {rows} WHERE split = 'train' WINDOW w AS (PARTITION BY id)),
dev_sums AS (SELECT sum(u * u) AS uu, sum(v * v) AS vv, sum(u * v) AS uv, sum(u * y) AS uy, sum(v * y) AS vy FROM dev),
within_fit AS (SELECT (uy * vv - vy * uv) / (uu * vv - uv * uv) AS w1, (vy * uu - uy * uv) / (uu * vv - uv * uv) AS w2 FROM dev_sums),
levels AS (SELECT id, avg(label) - w1 * avg({a}) - w2 * avg({b}) AS effect, w1, w2 FROM {rows}, within_fit WHERE split = 'train' GROUP BY id, w1, w2)"""


@query("fixed_effects_ols", "id slope:6 slope_2:6 effect:6", "panel", _XY, _within("xy", "x1", "x2"), "SELECT id, w1 AS slope, w2 AS slope_2, effect FROM levels")
def fixed_effects_ols(spark, sf):
    beta, effects = linear.fixed_effects(_train(_xy(spark, sf)), ["x1", "x2"])
    return effects.withColumns({"slope": F.lit(float(beta[0])), "slope_2": F.lit(float(beta[1]))})


# With a penalty a on slope and levels alike, a level is its summed residual over its rows plus a.
_EFFECT_RIDGE = """cells AS (SELECT id, label, (x1 - m1) / sqrt(v1) AS x FROM xy, fit WHERE split = 'train'),
sums AS (SELECT id, count(*) AS n, sum(x) AS x, sum(label) AS y, sum(x * x) AS xx, sum(x * label) AS xy FROM cells GROUP BY id),
reduced AS (SELECT sum(n - n * n / (n + 25.0)) AS a00, sum(x - n * x / (n + 25.0)) AS a01, sum(xx - x * x / (n + 25.0)) + 25.0 AS a11, sum(y - n * y / (n + 25.0)) AS b0, sum(xy - x * y / (n + 25.0)) AS b1 FROM sums),
solved AS (SELECT (b0 * a11 - b1 * a01) / (a00 * a11 - a01 * a01) AS c, (b1 * a00 - b0 * a01) / (a00 * a11 - a01 * a01) AS b FROM reduced)"""


@query("effects_ridge", "id slope:8 effect:6", "panel", _XY, _EFFECT_RIDGE, "SELECT id, b AS slope, c + (y - n * c - b * x) / (n + 25.0) AS effect FROM sums, solved")
def effects_ridge(spark, sf):
    rows = _train(design.standard_scale(_xy(spark, sf), ["x1"]))
    absorbed = linear.absorb(rows, ["num__x1"], penalty=25.0)
    beta, _, effects = linear.absorbed_fit(absorbed, ["num__x1"], ["num__x1"], 25.0)
    return effects.withColumn("slope", F.lit(float(beta[0])))


def _penalised(spark, sf, model, params):
    rows = design.standard_scale(_xy(spark, sf), ["x1", "x2"])
    return models.importance_table(spark, [models.fit(model, _train(rows), ["num__x1"], params)])


# With one standardised feature the penalised estimates have a closed form in c = cov(label, x).
_ONE = "(SELECT c1 / sqrt(v1) AS c FROM fit), (SELECT count(*) AS n FROM xy WHERE split = 'train')"


@query("ridge", "model feature importance:8", "panel", _XY, f"SELECT 'Ridge' AS model, 'num__x1' AS feature, n * c / (n + 50) AS importance FROM {_ONE}")
def ridge(spark, sf):
    return _penalised(spark, sf, models.RIDGE, {"alpha": 50.0})


@query("lasso", "model feature importance:8", "panel", _XY, f"SELECT 'Lasso' AS model, 'num__x1' AS feature, sign(c) * greatest(abs(c) - 0.001, 0) AS importance FROM {_ONE}")
def lasso(spark, sf):
    return _penalised(spark, sf, models.LASSO, {"alpha": 0.001})


@query(
    "elastic_net", "model feature importance:8", "panel", _XY,
    f"SELECT 'ElasticNet' AS model, 'num__x1' AS feature, sign(c) * greatest(abs(c) - 0.001 * 0.3, 0) / (1 + 0.001 * 0.7) AS importance FROM {_ONE}",
)
def elastic_net(spark, sf):
    return _penalised(spark, sf, models.ELASTIC, {"alpha": 0.001, "l1_ratio": 0.3})


# Over features with few values a fully grown tree predicts the train mean of every cell; so does every tree of
# a forest without resampling, and the later trees of a boosted model have nothing left to fit.
_CELLS = """cells AS (SELECT *, quarter(date) AS q, CAST(id AS BIGINT) % 5 AS g, year(date) % 2 AS y FROM xy),
cell_means AS (SELECT q, g, y, avg(label) AS mean FROM cells WHERE split = 'train' GROUP BY 1, 2, 3)"""
_GROWN = {
    models.TREE: {"max_depth": 20},
    models.FOREST: {"max_depth": 20, "n_estimators": 3, "bootstrap": False},
    models.BOOSTED: {"max_depth": 20, "n_estimators": 3, "learning_rate": 0.1},
}


def _tree(spark, sf, model):
    rows = _xy(spark, sf).withColumns(
        {"q": F.quarter("date").cast("double"), "g": (F.col("id").cast("bigint") % 5).cast("double"), "y": (F.year("date") % 2).cast("double")}
    )
    fitted = models.fit(model, _train(rows), ["q", "g", "y"], _GROWN[model])
    return models.predictions(fitted, rows, "roa", 1)


def _cell_means(model):
    return f"SELECT 'roa' AS target, 1 AS horizon, '{model}' AS model, split, id, date, label, mean AS prediction FROM cells JOIN cell_means USING (q, g, y)"


_SCORES = "target horizon:i model split id date:d label:6 prediction:6"


@query("decision_tree", _SCORES, "panel", _XY, _CELLS, _cell_means(models.TREE))
def decision_tree(spark, sf):
    return _tree(spark, sf, models.TREE)


@query("random_forest", _SCORES, "panel", _XY, _CELLS, _cell_means(models.FOREST))
def random_forest(spark, sf):
    return _tree(spark, sf, models.FOREST)


@query("boosted_trees", _SCORES, "panel", _XY, _CELLS, _cell_means(models.BOOSTED))
def boosted_trees(spark, sf):
    return _tree(spark, sf, models.BOOSTED)


@query(
    "rfe_pair", "model feature importance:6", "panel", _XY,
    """SELECT 'LinearRegression_RFE' AS model, CASE WHEN first THEN 'num__x1' ELSE 'num__x2' END AS feature, CASE WHEN first THEN r1 * s ELSE r2 * s END AS importance
       FROM (SELECT *, abs(r1 - r12 * r2) > abs(r2 - r12 * r1) AS first FROM (SELECT corr(label, x1) AS r1, corr(label, x2) AS r2, corr(x1, x2) AS r12, stddev_pop(label) AS s FROM xy WHERE split = 'train'))""",
)
def rfe_pair(spark, sf):
    rows = design.standard_scale(_xy(spark, sf), ["x1", "x2"])
    return models.importance_table(spark, [models.fit("LinearRegression_RFE", _train(rows), ["num__x1", "num__x2"], keep=1)])


# Over one feature the fold errors of penalised models have a closed form.
_FOLDS = """train AS (SELECT date, label, (x1 - m1) / sqrt(v1) AS x FROM xy, fit WHERE split = 'train'),
days AS (SELECT list_sort(list(DISTINCT date)) AS ds, len(list(DISTINCT date)) AS n, len(list(DISTINCT date)) // 4 AS b FROM train),
roles AS (SELECT i AS fold, x, label, CASE WHEN date <= ds[n - (3 - i) * b] THEN 'train' WHEN date BETWEEN ds[n - (3 - i) * b + 1] AND ds[n - (3 - i) * b + b] THEN 'test' END AS role FROM train, days, range(3) t(i)),
fold_stats AS (SELECT fold, count(*) AS n, avg(x) AS mx, avg(label) AS ml, covar_pop(label, x) AS c, var_pop(x) AS v FROM roles WHERE role = 'train' GROUP BY fold)"""
_ERRORS = """errors AS (SELECT fold, model, a, l, avg((label - ml - slope * (x - mx)) * (label - ml - slope * (x - mx))) AS e FROM roles JOIN fold_fits USING (fold) WHERE role = 'test' GROUP BY ALL)"""
_RIDGE_FOLDS = f"""{_FOLDS},
fold_fits AS (SELECT fold, 'Ridge' AS model, a, 0 AS l, mx, ml, c * n / (v * n + a) AS slope FROM fold_stats, (VALUES (0.001), (0.01), (0.1), (1), (10), (50), (100)) AS p(a)),
{_ERRORS}"""
_SPARSE_FOLDS = f"""{_FOLDS},
points AS (SELECT 'Lasso' AS model, CAST(a AS DOUBLE) AS a, 1.0 AS l FROM (VALUES (0.0001), (0.001), (0.01), (0.1), (1), (10), (20)) AS p(a) UNION ALL
  SELECT 'ElasticNet', CAST(a AS DOUBLE), l FROM (VALUES (0.001), (0.01), (0.1), (1), (10)) AS p(a), (VALUES (0.1), (0.3), (0.5), (0.7), (0.9)) AS q(l)),
fold_fits AS (SELECT fold, model, a, l, mx, ml, sign(c) * greatest(abs(c) - a * l, 0) / (v + a * (1 - l)) AS slope FROM fold_stats, points),
{_ERRORS}"""


@query("ridge_search", "alpha:3 mse:9", "panel", _XY, _RIDGE_FOLDS, "SELECT a AS alpha, avg(e) AS mse FROM errors GROUP BY a")
def ridge_search(spark, sf):
    rows = _train(design.standard_scale(_xy(spark, sf), ["x1"]))
    _, scored = models.param_search(models.RIDGE, rows, ["num__x1"], models.grid_points(models.RIDGE))
    return spark.createDataFrame([(float(p["params"]["alpha"]), p["mse"]) for p in scored], "alpha double, mse double")


def _searched(spark, rows, features, names):
    """Scores of the whole grids of several linear models, all from one pass over the rows."""
    moments = models.fold_moments(rows, features, 3)
    out = []
    for name in names:
        _, scored = models.param_search(name, rows, features, models.grid_points(name, len(features)), moments=lambda: moments)
        out += [(name, models.params_json(s["params"]), float(s["params"].get("alpha", 0.0)), float(s["params"].get("l1_ratio", 1.0)), s["mse"]) for s in scored]
    return spark.createDataFrame(out, "model string, params string, alpha double, l1_ratio double, mse double")


@query("sparse_search", "model alpha:4 l1_ratio:1 mse:9", "panel", _XY, _SPARSE_FOLDS, "SELECT model, a AS alpha, l AS l1_ratio, avg(e) AS mse FROM errors GROUP BY model, a, l")
def sparse_search(spark, sf):
    rows = materialize(_train(design.standard_scale(_xy(spark, sf), ["x1"])), "search-rows")
    return _searched(spark, rows, ["num__x1"], (models.LASSO, models.ELASTIC))


# Ridge over two features: solutions of two equations.
_PAIR_FOLDS = """train AS (SELECT date, label, (x1 - m1) / sqrt(v1) AS x, (x2 - m2) / sqrt(v2) AS z FROM xy, fit WHERE split = 'train'),
days AS (SELECT list_sort(list(DISTINCT date)) AS ds, len(list(DISTINCT date)) AS n, len(list(DISTINCT date)) // 4 AS b FROM train),
roles AS (SELECT i AS fold, x, z, label, CASE WHEN date <= ds[n - (3 - i) * b] THEN 'train' WHEN date BETWEEN ds[n - (3 - i) * b + 1] AND ds[n - (3 - i) * b + b] THEN 'test' END AS role FROM train, days, range(3) t(i)),
fold_stats AS (SELECT fold, count(*) AS n, avg(x) AS mx, avg(z) AS mz, avg(label) AS ml, covar_pop(label, x) AS cx, covar_pop(label, z) AS cz, covar_pop(x, z) AS xz, var_pop(x) AS vx, var_pop(z) AS vz FROM roles WHERE role = 'train' GROUP BY fold),
fold_fits AS (SELECT *, n * (cx * (n * vz + a) - cz * n * xz) / d AS bx, n * (cz * (n * vx + a) - cx * n * xz) / d AS bz
  FROM (SELECT *, (n * vx + a) * (n * vz + a) - n * xz * n * xz AS d FROM fold_stats, (VALUES (0.001, '0.001'), (0.01, '0.01'), (0.1, '0.1'), (1, '1'), (10, '10'), (50, '50'), (100, '100')) AS p(a, t))),
pair_errors AS (SELECT fold, t, avg(pow(label - ml - bx * (x - mx) - bz * (z - mz), 2)) AS e FROM roles JOIN fold_fits USING (fold) WHERE role = 'test' GROUP BY fold, t)"""


@query("param_search", "params mse:10", "panel", _XY, _PAIR_FOLDS, """SELECT '{"alpha": ' || t || '}' AS params, avg(e) AS mse FROM pair_errors GROUP BY t""")
def param_search(spark, sf):
    rows = materialize(_train(design.standard_scale(_xy(spark, sf), ["x1", "x2"])), "search-rows")
    return _searched(spark, rows, ["num__x1", "num__x2"], (models.RIDGE,))


_RFE = ["num__" + c for c in _DESIGN_NUM]


def _matrix(spark, sf):
    return materialize(design.scale_and_encode(materialize(_design(spark, sf), "design"), ["quarter"]), "matrix")


@query("param_search_design", "model params mse:8")
def param_search_design(spark, sf):
    """All linear models with their whole grids, with and without feature selection, over the design matrix."""
    names = [m + s for m in (models.OLS, models.RIDGE, models.LASSO, models.ELASTIC) for s in ("", "_RFE")]
    return _searched(spark, _train(_matrix(spark, sf)), _RFE, names)


# Elimination among three standardised features: three equations, then two, by Cramer's rule.
_THREE = """x3 AS (SELECT id, date, total_loans_and_leases / total_assets AS x3 FROM panel),
three AS (SELECT corr(label, x1) AS r1, corr(label, x2) AS r2, corr(label, x3) AS r3, corr(x1, x2) AS r12, corr(x1, x3) AS r13, corr(x2, x3) AS r23, stddev_pop(label) AS s FROM xy JOIN x3 USING (id, date) WHERE split = 'train'),
first_fit AS (SELECT *, r1 * (1 - r23 * r23) - r2 * (r12 - r13 * r23) - r3 * (r13 - r12 * r23) AS d1, r2 * (1 - r13 * r13) - r1 * (r12 - r13 * r23) - r3 * (r23 - r12 * r13) AS d2,
  r3 * (1 - r12 * r12) - r1 * (r13 - r12 * r23) - r2 * (r23 - r12 * r13) AS d3 FROM three),
left_two AS (SELECT s, out, CASE out WHEN 1 THEN 2 ELSE 1 END AS i, CASE out WHEN 3 THEN 2 ELSE 3 END AS j, CASE out WHEN 1 THEN r2 ELSE r1 END AS ri, CASE out WHEN 3 THEN r2 ELSE r3 END AS rj,
  CASE out WHEN 1 THEN r23 WHEN 2 THEN r13 ELSE r12 END AS rij
  FROM (SELECT *, CASE WHEN abs(d1) <= least(abs(d2), abs(d3)) THEN 1 WHEN abs(d2) <= abs(d3) THEN 2 ELSE 3 END AS out FROM first_fit))"""


@query(
    "rfe_select", "model feature importance:6", "panel", _XY, _THREE,
    """SELECT 'LinearRegression_RFE' AS model, 'num__x' || CASE WHEN stays THEN i ELSE j END AS feature, s * CASE WHEN stays THEN ri ELSE rj END AS importance
       FROM (SELECT *, abs(ri - rij * rj) > abs(rj - rij * ri) AS stays FROM left_two)""",
)
def rfe_select(spark, sf):
    third = fx.panel(spark, sf).select("id", "date", S.ratio("total_loans_and_leases", "total_assets").alias("x3"))
    names = ["x1", "x2", "x3"]
    rows = _train(design.standard_scale(materialize(_xy(spark, sf).join(third, ["id", "date"]), "xyz"), names))
    return models.importance_table(spark, [models.fit("LinearRegression_RFE", rows, [f"num__{n}" for n in names])])


@query("rfe_select_design", "model feature importance:6")
def rfe_select_design(spark, sf):
    return models.importance_table(spark, [models.fit("LinearRegression_RFE", _train(_matrix(spark, sf)), _RFE)])


@query("tree_importance", "target horizon:i model rank:i feature display importance:6")
def tree_importance(spark, sf):
    """Largest importances of trees and forests of default size over the design matrix."""
    rows = _train(_matrix(spark, sf))
    fitted = [models.fit(m, rows, _RFE, importances_only=True) for m in (models.TREE, models.FOREST)]
    table = models.importance_table(spark, fitted).withColumns({"target": F.lit("roa"), "horizon": F.lit(1)})
    return training.importance_report(table, 5)


@query(
    "stored_preprocessing", "kind column level mean:6 deviation:6", "panel", _RATIOS, _DESIGN,
    " UNION ALL ".join(f"SELECT 'numeric' AS kind, '{c}' AS \"column\", NULL AS level, avg({c}) AS mean, stddev_pop({c}) AS deviation FROM design WHERE split = 'train'" for c in _DESIGN_NUM)
    + " UNION ALL SELECT DISTINCT 'category', 'quarter', quarter, NULL, NULL FROM design WHERE split = 'train'",
)
def stored_preprocessing(spark, sf):
    """What is stored beside a model: statistics and levels of its train rows."""
    path = scratch_path(spark, "preprocessing")
    preprocess.fit(materialize(_design(spark, sf), "design"), ["quarter"]).save(path, spark)
    return preprocess.load(path, spark).table(spark)


_METRICS = """count(*) AS n, avg(abs(label - prediction)) AS mae, avg((label - prediction) * (label - prediction)) AS mse, sqrt(avg((label - prediction) * (label - prediction))) AS rmse,
 1 - avg((label - prediction) * (label - prediction)) / var_pop(label) AS r2, avg(abs((label - prediction) / nullif(label, 0))) * 100 AS mape"""


# --- a stored run ---------------------------------------------------------------------------
# A study of two features whose linear models have closed forms.

_STUDY_CFG = PanelConfig(targets=("roa",), features={"deposit_ratio": "bank", "equity": "bank"}, include_lags=False, lags=0)
_STUDY_MODELS = (models.MEAN, models.OLS, models.RIDGE, models.EFFECTS, "LinearRegression_RFE")
_STUDY = f"""s1 AS (SELECT id, date, roa, deposit_ratio, equity FROM ratios WHERE roa IS NOT NULL),
s2 AS (SELECT s1.*, CASE WHEN date <= ds[len(ds) - CAST(ceil(len(ds) * 0.2) AS INT)] THEN 'train' ELSE 'test' END AS split FROM s1, {_CUT.format(t='s1')}),
s3 AS (SELECT *, lead(roa) OVER (PARTITION BY split, id ORDER BY date) AS label FROM s2),
study AS (SELECT id, date, split, label, deposit_ratio, equity FROM s3 WHERE label IS NOT NULL AND deposit_ratio IS NOT NULL AND equity IS NOT NULL),
scaling AS (SELECT avg(deposit_ratio) AS m1, stddev_pop(deposit_ratio) AS d1, avg(equity) AS m2, stddev_pop(equity) AS d2 FROM study WHERE split = 'train'),
scaled AS (SELECT id, date, split, label, (deposit_ratio - m1) / d1 AS x, (equity - m2) / d2 AS z FROM study, scaling),
mom AS (SELECT count(*) AS n, avg(label) AS my, covar_pop(label, x) AS cx, covar_pop(label, z) AS cz, covar_pop(x, z) AS xz FROM scaled WHERE split = 'train'),
{_within("scaled", "x", "z")},
slopes AS (SELECT 'DummyRegressor' AS model, my AS c, 0.0 AS bx, 0.0 AS bz FROM mom UNION ALL
  SELECT 'LinearRegression', my, (cx - cz * xz) / (1 - xz * xz), (cz - cx * xz) / (1 - xz * xz) FROM mom UNION ALL
  SELECT 'Ridge', my, n * (cx * (n + 1) - cz * n * xz) / ((n + 1) * (n + 1) - n * xz * n * xz), n * (cz * (n + 1) - cx * n * xz) / ((n + 1) * (n + 1) - n * xz * n * xz) FROM mom UNION ALL
  SELECT 'LinearRegression_RFE', my, CASE WHEN abs(cx - cz * xz) > abs(cz - cx * xz) THEN cx ELSE 0 END, CASE WHEN abs(cx - cz * xz) > abs(cz - cx * xz) THEN 0 ELSE cz END FROM mom UNION ALL
  SELECT 'FixedEffectsLR', (SELECT avg(effect) FROM levels), w1, w2 FROM within_fit),
scores AS (SELECT 'roa' AS target, 1 AS horizon, model, split, id, date, label, CASE WHEN model = 'FixedEffectsLR' THEN coalesce(effect, c) ELSE c END + bx * x + bz * z AS prediction
  FROM slopes, scaled LEFT JOIN levels USING (id))"""


def _study_run(spark, sf, names=_STUDY_MODELS, search=None):
    """The folder of a finished run; readers take everything from there."""
    out = scratch_path(spark, "run")
    panel = PreparedPanel(_ratios(spark, sf), ["deposit_ratio", "equity"], [], [], None, None)
    training.train_matrix(panel, _STUDY_CFG, names=names, search=search, out=out)
    return out


@query("train_matrix", "target horizon:i model split n:i mae:6 rmse:6 r2:6 mape:4", "panel", _RATIOS, _STUDY, f"SELECT target, horizon, model, split, {_METRICS} FROM scores GROUP BY 1, 2, 3, 4")
def train_matrix(spark, sf):
    return metrics.regression_metrics(training.load_run(spark, _study_run(spark, sf)).predictions)


@query("train_matrix_default", "target horizon:i model split n:i mae:6 rmse:6 r2:6 mape:4")
def train_matrix_default(spark, sf):
    """All configured targets with the default models, mean and entity effects, and the ensemble of the tree models."""
    out = scratch_path(spark, "run")
    names = (models.MEAN, models.EFFECTS, *models.DEFAULT_MODELS)
    training.train_matrix(prepared(spark, sf), PREP_CFG, names=names, search=None, out=out)
    return metrics.regression_metrics(training.load_run(spark, out).predictions)


@query(
    "score_new_panel", "target horizon:i model id date:d label:6 prediction:6", "panel", "new_panel", _RATIOS, _STUDY,
    """unseen AS (SELECT *, lead(roa) OVER (PARTITION BY id ORDER BY date) AS label FROM (SELECT id, date, net_income / total_assets AS roa, total_deposits / total_assets AS deposit_ratio,
       total_equity / total_assets AS equity FROM new_panel) WHERE roa IS NOT NULL)""",
    """SELECT 'roa' AS target, 1 AS horizon, model, id, date, label, c + bx * (deposit_ratio - m1) / d1 + bz * (equity - m2) / d2 AS prediction
       FROM unseen, scaling, slopes WHERE deposit_ratio IS NOT NULL AND equity IS NOT NULL""",
)
def score_new_panel(spark, sf):
    """A run trained on one panel scores the entities of another from what it stored."""
    rows = fx.new_panel(spark, sf).select(
        "id", "date", S.ratio("net_income", "total_assets").alias("roa"), S.ratio("total_deposits", "total_assets").alias("deposit_ratio"),
        S.ratio("total_equity", "total_assets").alias("equity"),
    )
    return training.score_panel(spark, _study_run(spark, sf), rows)


@query(
    "run_report", "target horizon:i model base_model run_type n_features:i "
    + " ".join(f"{s}_{c}" for s in ("train", "test") for c in ("n:i", "mae:6", "rmse:6", "r2:6", "mape:4", "missing:i", "entities:i", "first_date:d", "last_date:d", "avg_dates_per_entity:6")),
    "panel", _RATIOS, _STUDY,
    f"""per_split AS (SELECT target, horizon, model, split, {_METRICS}, sum(CASE WHEN label IS NULL THEN 1 ELSE 0 END) AS missing, count(DISTINCT id) AS entities, min(date) AS first_date, max(date) AS last_date,
       count(*) * 1.0 / count(DISTINCT id) AS avg_dates_per_entity FROM scores GROUP BY 1, 2, 3, 4)""",
    "SELECT r.target, r.horizon, r.model, replace(r.model, '_RFE', '') AS base_model, CASE WHEN r.model LIKE '%RFE' THEN 'RFE' ELSE 'Standard' END AS run_type, CASE WHEN r.model LIKE '%RFE' THEN 1 ELSE 2 END AS n_features, "
    + ", ".join(f"{a}.{c} AS {s}_{c}" for a, s in (("r", "train"), ("t", "test")) for c in ("n", "mae", "rmse", "r2", "mape", "missing", "entities", "first_date", "last_date", "avg_dates_per_entity"))
    + " FROM per_split r JOIN per_split t USING (target, horizon, model) WHERE r.split = 'train' AND t.split = 'test'",
)
def run_report(spark, sf):
    return training.run_report(training.load_run(spark, _study_run(spark, sf)))


# Coefficients are the importances of linear models; the entity levels of the effects model are not among them.
_COEFFICIENTS = """coefficients AS (SELECT model, 'num__deposit_ratio' AS feature, 'Deposit Ratio' AS display, bx AS importance FROM slopes UNION ALL SELECT model, 'num__equity', 'equity', bz FROM slopes),
kept AS (SELECT * FROM coefficients WHERE model <> 'DummyRegressor' AND NOT (model = 'LinearRegression_RFE' AND importance = 0))"""


@query(
    "feature_importance", "target horizon:i model rank:i feature display importance:6", "panel", _RATIOS, _STUDY, _COEFFICIENTS,
    "SELECT 'roa' AS target, 1 AS horizon, model, row_number() OVER (PARTITION BY model ORDER BY abs(importance) DESC) AS rank, feature, display, importance FROM kept",
)
def feature_importance(spark, sf):
    return training.importance_report(training.load_run(spark, _study_run(spark, sf)).importances, 5)


@query("selected_features", "target horizon:i model feature", "panel", _RATIOS, _STUDY, _COEFFICIENTS, "SELECT 'roa' AS target, 1 AS horizon, model, feature FROM kept WHERE model = 'LinearRegression_RFE'")
def selected_features(spark, sf):
    return training.selected_features(training.load_run(spark, _study_run(spark, sf)).registry)


# --- run reports --------------------------------------------------------------------------

@query(
    "regression_metrics", "target horizon:i model split n:i mae:8 mse:8 rmse:8 r2:6 mape:4", "panel", "predictions",
    f"SELECT target, horizon, model, split, {_METRICS} FROM predictions GROUP BY 1, 2, 3, 4",
)
def regression_metrics(spark, sf):
    return metrics.regression_metrics(fx.predictions(spark, sf))


@query(
    "voting_ensemble", "target horizon:i split id date:d label:6 prediction:6 model", "panel", "predictions",
    "SELECT target, horizon, split, id, date, max(label) AS label, avg(prediction) AS prediction, 'VotingEnsemble' AS model FROM predictions WHERE model IN ('last', 'damped') GROUP BY 1, 2, 3, 4, 5",
)
def voting_ensemble(spark, sf):
    return metrics.voting_ensemble(fx.predictions(spark, sf), ["last", "damped", "absent"])


_COMPARED = f"""compared AS (SELECT target, horizon, model, replace(model, '_RFE', '') AS base_model, CASE WHEN model LIKE '%\\_RFE' ESCAPE '\\' THEN 'RFE' ELSE 'Standard' END AS run_type,
  {_METRICS} FROM predictions WHERE split = 'test' GROUP BY 1, 2, 3)"""


@query(
    "model_comparison", "target horizon:i model base_model run_type n:i rmse:8 r2:6 test_rows:i total_entities:i", "panel", "predictions", _COMPARED,
    "SELECT *, n AS test_rows, (SELECT count(DISTINCT id) FROM predictions) AS total_entities FROM compared",
)
def model_comparison(spark, sf):
    return metrics.model_comparison(fx.predictions(spark, sf))


@query("best_per_group", "base_model rmse:8", "panel", "predictions", _COMPARED, "SELECT base_model, min(rmse) AS rmse FROM compared GROUP BY 1")
def best_per_group(spark, sf):
    return A.best_per_group(metrics.model_comparison(fx.predictions(spark, sf)), "base_model", "rmse")


@query(
    "feature_count_report", "base_model run_type roa absent", "panel", _RATIOS, _STUDY,
    """SELECT DISTINCT replace(model, '_RFE', '') AS base_model, CASE WHEN model LIKE '%RFE' THEN 'RFE' ELSE 'Standard' END AS run_type, CASE WHEN model LIKE '%RFE' THEN '1.0' ELSE '2.0' END AS roa, '-' AS absent FROM scores""",
)
def feature_count_report(spark, sf):
    run = training.load_run(spark, _study_run(spark, sf))
    return training.feature_count_report(metrics.model_comparison(run.predictions, run.registry), ["roa", "absent"])


# The penalty that the search over the train dates of the study chooses.
_STUDY_FOLDS = _PAIR_FOLDS.replace("(x1 - m1) / sqrt(v1) AS x, (x2 - m2) / sqrt(v2) AS z FROM xy, fit", "x, z FROM scaled")


@query(
    "param_report", "target Ridge|Standard DummyRegressor|Standard Lasso|Standard", "panel", _RATIOS, _STUDY, _STUDY_FOLDS,
    """SELECT 'roa' AS target, '{"alpha": ' || (SELECT t FROM pair_errors GROUP BY t ORDER BY avg(e) LIMIT 1) || '}' AS "Ridge|Standard", '{}' AS "DummyRegressor|Standard", 'N/A' AS "Lasso|Standard" """,
)
def param_report(spark, sf):
    run = training.load_run(spark, _study_run(spark, sf, (models.MEAN, models.RIDGE), "grid"))
    return training.param_report(metrics.model_comparison(run.predictions, run.registry), ["Ridge|Standard", "DummyRegressor|Standard", "Lasso|Standard"])


@query(
    "pivot_mean", "o_orderpriority F:4 O:4 P:4",
    """SELECT o_orderpriority, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS "F", avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS "O",
       avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS "P" FROM orders GROUP BY 1""",
)
def pivot_mean(spark, sf):
    return A.pivot_mean(fx.table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query(
    "pivot_first", "c_mktsegment 0|true 1|true 1|false",
    """SELECT c_mktsegment, arg_min(c_name, c_custkey) FILTER (c_nationkey = 0 AND c_acctbal < 0) AS "0|true", arg_min(c_name, c_custkey) FILTER (c_nationkey = 1 AND c_acctbal < 0) AS "1|true",
       arg_min(c_name, c_custkey) FILTER (c_nationkey = 1 AND c_acctbal >= 0) AS "1|false" FROM customer GROUP BY 1""",
)
def pivot_first(spark, sf):
    rows = fx.table(spark, sf, "customer").withColumn("debt", F.col("c_acctbal") < 0)
    return A.pivot_first(rows, "c_mktsegment", ["c_nationkey", "debt"], "c_name", ["0|true", "1|true", "1|false"], ["c_custkey"])


@query(
    "top_n_importance", "model rank:i feature importance:6", "panel", _RATIOS,
    "cc AS (" + " UNION ALL ".join(
        f"SELECT '{a}' AS model, '{b}' AS feature, corr({a}, {b}) AS importance FROM ratios" for a in ("deposit_ratio", "roa", "equity", "total_assets") for b in ("deposit_ratio", "roa", "equity", "total_assets") if a != b
    ) + ")",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY abs(importance) DESC, feature) AS rank FROM cc) WHERE rank <= 2",
)
def top_n_importance(spark, sf):
    table = A.correlation_table(_ratios(spark, sf), ["deposit_ratio", "roa", "equity", "total_assets"])
    pairs = table.filter("var_a <> var_b").select(F.col("var_a").alias("model"), F.col("var_b").alias("feature"), F.col("r").alias("importance"))
    return A.top_n_importance(pairs, 2)


@query(
    "report_sort", "o_orderstatus o_orderpriority report_rank:i n:i",
    """SELECT o_orderstatus, o_orderpriority, CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS report_rank, count(*) AS n FROM orders WHERE o_orderstatus IN ('P', 'F') GROUP BY 1, 2""",
)
def report_sort(spark, sf):
    counts = fx.table(spark, sf, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))
    return A.report_sort(counts, "o_orderstatus", ["P", "F"], ["o_orderpriority"])
