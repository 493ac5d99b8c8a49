"""Properties that must hold for any data, partitioning and skew."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import aggregates, clean, design, quantiles, sample, windows
from ledgerline.queries import catalog, fixtures
from tests.compare import difference

PROBS = {"p0": 0.0, "p1": 0.01, "q25": 0.25, "median": 0.5, "q75": 0.75, "p99": 0.99, "p100": 1.0}


def samples(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    return {
        "normal": rng.normal(0, 1, 801),
        "heavy": np.exp(rng.normal(0, 8, 500)) * rng.choice([-1, 1], 500),
        # One value holds most of the group, and the group holds most of the rows.
        "hot": np.concatenate([np.full(3000, 7.25), rng.integers(-5, 20, 997)]),
        "near": 1e6 + rng.integers(0, 50, 300) * 1e-9,
        "zeros": np.array([0.0, 0.0, -0.0, 1.0]),
        "single": np.array([-3.5]),
    }


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("bracket_rows", [10_000, 16])
def test_quantiles_equal_sorting(spark, seed, bracket_rows, monkeypatch):
    monkeypatch.setattr(quantiles, "BRACKET_ROWS", bracket_rows)
    data = samples(seed)
    rows = [(g, float(v)) for g, vs in data.items() for v in vs] + [("normal", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r.g: r for r in quantiles.grouped_quantiles(df, ["g"], "v", PROBS, moments=True).collect()}
    assert set(got) == set(data)
    for g, vs in data.items():
        for name, p in PROBS.items():
            assert got[g][name] == pytest.approx(np.quantile(vs, p), rel=1e-12, abs=1e-12), (g, name)
        assert (got[g].n, got[g]["min"], got[g]["max"]) == (len(vs), vs.min(), vs.max())
        assert got[g]["mean"] == pytest.approx(vs.mean(), rel=1e-9)
        assert got[g]["std"] is None if len(vs) == 1 else got[g]["std"] == pytest.approx(vs.std(ddof=1), rel=1e-6, abs=1e-15 * abs(vs).max())


def test_brackets_are_narrowed_until_they_are_small(spark, monkeypatch):
    """200 000 values within a millionth and one far off: no pass that counts single values sees many of them."""
    values = np.append(1 + np.arange(200_000) * 5e-12, 1.02)
    df = spark.createDataFrame([(float(v),) for v in values], "v double").repartition(8)
    counted, original = [], quantiles._narrow

    def counting(rows, by, bucket):
        out = original(rows, by, bucket)
        if "_sub" not in str(bucket) and str(bucket) == str(F.col("_v")):
            counted.append(rows.select("t", "_v").distinct().groupBy("t").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(quantiles, "_narrow", counting)
    got = quantiles.grouped_quantiles(df, [], "v", PROBS).first()
    assert counted and max(c or 0 for c in counted) <= quantiles.BRACKET_ROWS
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15)


def test_quantiles_of_extreme_values(spark):
    for values in ([-1.7e308, 1.7e308, 0.0, 5e-324, 1.0], [2.0**-k for k in range(60)], []):
        df = spark.createDataFrame([(float(v),) for v in values], "v double")
        got = quantiles.order_statistics(df, [], "v", lambda n: [F.lit(0), F.floor(n / 2), n - 1]).collect()
        ordered = sorted(values)
        assert [(r.s0, r.s1, r.s2) for r in got] == ([(ordered[0], ordered[len(values) // 2], ordered[-1])] if values else [])


def test_quantiles_without_groups_of_a_union(spark):
    half = spark.createDataFrame([(float(v),) for v in range(50)], "v double")
    got = quantiles.grouped_quantiles(half.unionByName(half.select((F.col("v") + 50).alias("v"))), [], "v", {"median": 0.5}).collect()
    assert [r.median for r in got] == [49.5]


def test_correlations_over_pairs_that_know_both(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (400, 6)) @ rng.normal(0, 1, (6, 6)) + 1e6
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:, 4] = 3.0
    x[10:, 5] = np.nan
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(None if np.isnan(v) else float(v) for v in r) for r in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    got = {(r.var_a, r.var_b): r.r for r in aggregates.correlation_table(df, names).collect()}
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if 4 in (i, j):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(np.corrcoef(x[both, i], x[both, j])[0, 1], rel=1e-9)


def test_correlations_of_three_hundred_columns(spark):
    names = [f"c{i}" for i in range(300)]
    df = spark.range(0, 500, 1, 4).select(*[F.when(F.col("id") % (i % 7 + 3) != 0, F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(1000)).cast("double")).alias(n) for i, n in enumerate(names)])
    table = aggregates.correlation_table(df, names)
    got = {(r.var_a, r.var_b): r.r for r in table.filter("var_a in ('c0', 'c150', 'c299')").collect()}
    assert table.count() == 300 * 300
    for a, b in (("c0", "c1"), ("c150", "c299"), ("c299", "c4")):
        assert got[a, b] == pytest.approx(df.agg(F.corr(a, b)).first()[0], rel=1e-9)


def test_order_statistics_without_groups(spark):
    values = np.random.default_rng(3).integers(0, 200, 2000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = quantiles.order_statistics(df, [], "v", lambda n: [F.lit(0), F.lit(999), n - 1]).first()
    ordered = np.sort(values)
    assert (got.n, got.s0, got.s1, got.s2) == (2000, ordered[0], ordered[999], ordered[-1])


@pytest.mark.parametrize("share", [0.2, 0.01, 0.5])
def test_entity_split_has_the_exact_size(spark, share):
    df = spark.range(337).select(F.col("id").cast("string").alias("id"))
    split = design.split_by_entity(df, share)
    assert split.filter("split = 'test'").count() == int(np.ceil(337 * share))
    again = design.split_by_entity(df.repartition(13), share)
    assert difference(split.toPandas(), again.toPandas()) is None


def test_equal_rank_values_are_cut_by_key(spark):
    keys = spark.createDataFrame([(f"{i:02d}", float(i // 10)) for i in range(40)], "id string, r double")
    got = sample.smallest_keys(keys, "r", lambda n: F.lit(14).cast("bigint"))
    assert sorted(x.id for x in got.collect()) == [f"{i:02d}" for i in range(14)]


@pytest.mark.parametrize("name", ["gap_fill_single", "break_back_adjust", "panel_pct_change", "feature_lags", "dedup_keep_first", "date_profile"])
def test_results_do_not_depend_on_partitioning(spark, sf_dir, name):
    query = catalog.queries()[name]
    first = query(spark, sf_dir).toPandas()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        assert difference(query(spark, sf_dir).toPandas(), first) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_gap_fill_equals_filling_the_full_grid(spark, sf_dir):
    thin = fixtures.thin(spark, sf_dir)
    w = windows.by_entity()
    grid = windows.panel_spine(thin)
    filled = F.coalesce("total_assets", F.when(F.lead("total_assets").over(w).isNotNull(), F.lag("total_assets").over(w)))
    expected = grid.select("id", "date", filled.alias("total_assets")).filter("total_assets is not null")
    got = windows.gap_fill_single(thin, "total_assets").select("id", "date", "total_assets")
    assert difference(got.toPandas(), expected.toPandas()) is None


def test_spine_is_complete(spark, sf_dir):
    thin = fixtures.thin(spark, sf_dir)
    ids, lo, hi = thin.agg(F.count_distinct("id"), F.min("date"), F.max("date")).first()
    quarters = (hi.year - lo.year) * 4 + (hi.month - lo.month) // 3 + 1
    spine = windows.panel_spine(thin)
    assert spine.count() == ids * quarters == spine.select("id", "date").distinct().count()


def test_quarterly_flows_add_up_to_the_year(spark, sf_dir):
    panel = fixtures.panel(spark, sf_dir).select("id", "date", F.col("interest_income").alias("x"))
    from pyspark.sql import Window

    w = Window.partitionBy("id", F.year("date")).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    back = windows.ytd_to_quarterly(panel.withColumn("x", F.sum("x").over(w)), ["x"])
    worst = back.alias("b").join(panel.alias("p"), ["id", "date"]).agg(F.max(F.abs(F.col("b.x") - F.col("p.x")))).first()[0]
    assert worst < 1e-6


def test_one_pass_lags_equal_two_passes(spark, sf_dir):
    rows = design.split_by_date(fixtures.panel(spark, sf_dir).select("id", "date", "npl"), 0.3)
    one, names = windows.feature_lags(rows, ["npl"], 3)
    train = windows.feature_lags(rows.filter("split = 'train'"), ["npl"], 3)[0]
    both = windows.feature_lags(rows, ["npl"], 3)[0].filter("split = 'test'")
    two = train.unionByName(both)
    assert difference(one.toPandas(), two.toPandas()) is None


def test_scaling_uses_train_rows_only(spark, sf_dir):
    rows = design.split_by_date(fixtures.panel(spark, sf_dir).select("id", "date", "total_assets"), 0.25)
    scaled = design.standard_scale(rows, ["total_assets"])
    mean, std = scaled.filter("split = 'train'").agg(F.avg("num__total_assets"), F.stddev_pop("num__total_assets")).first()
    assert mean == pytest.approx(0, abs=1e-9) and std == pytest.approx(1)
    shifted = rows.withColumn("total_assets", F.when(F.col("split") == "test", F.col("total_assets") * 100).otherwise(F.col("total_assets")))
    again = design.standard_scale(shifted, ["total_assets"]).filter("split = 'train'")
    assert difference(again.toPandas(), scaled.filter("split = 'train'").toPandas()) is None


def test_hot_key_dedup_combines_before_the_shuffle(spark):
    rows = spark.range(20000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("o"), F.lit("v").alias("v"))
    out = clean.dedup_keep_first(rows, ["k"], [F.col("o")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "partial_min_by" in plan
    assert out.count() == rows.select("k").distinct().count()
    assert out.filter("k = 0").first().o == 0
