"""Semantics on small hand-made or random inputs, against pandas or brute force."""

from __future__ import annotations

import math
import random
from datetime import date, datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions.steps import step_number
from panelloom.operators import (
    aggregates,
    calendar,
    correlate,
    features,
    gaps,
    impute,
    interpolate,
    names,
    nearest,
    quality,
    reduce,
    shape,
)


def month(i: int) -> date:
    return date(2000 + i // 12, i % 12 + 1, 1)


def series(spark, values, key="A"):
    return spark.createDataFrame(
        [(key, month(i), v) for i, v in enumerate(values)], "k string, t date, v double"
    )


def values_of(df, column, order="t"):
    return [r[column] for r in df.orderBy(order).collect()]


# ---- aggregates -------------------------------------------------------------


def test_first_non_null_and_dedup_first(spark):
    rows = [("k", None, "A", 1), ("k", 2.0, "B", 2), ("k", 3.0, "B", 1), ("n", None, "A", 1)]
    df = spark.createDataFrame(rows, "k string, v double, name string, row int").repartition(4)
    got = dict(df.groupBy("k").agg(aggregates.first_non_null("v", ["name", "row"])).collect())
    assert got == {"k": 3.0, "n": None}
    kept = aggregates.dedup_first(df, ["k"], ["name", "row"]).collect()
    assert {r.k: r.v for r in kept} == {"k": None, "n": None}


def hourly(spark):
    rows = [
        ("g", datetime(2001, 1, 3, 5), 280.0, 0.001),
        ("g", datetime(2001, 1, 9, 6), 290.0, 0.002),
        ("g", datetime(2001, 3, 1, 0), None, None),
    ]
    return spark.createDataFrame(rows, "k string, ts timestamp_ntz, t2m double, tp double")


def test_sparse_and_dense_rollup(spark):
    rules = {"mean": ("t2m", "mean"), "rain": ("tp", "sum"), "none": ("absent", "mean")}
    sparse = aggregates.rollup_sparse(
        hourly(spark), ["k"], "ts", rules, units={"mean": (1.0, -273.15), "rain": (1000.0, 0.0)}
    )
    assert sorted(sparse.columns) == ["date", "k", "mean", "rain"]
    got = {r.date.month: (r.mean, r.rain) for r in sparse.collect()}
    assert got == {1: (pytest.approx(11.85), pytest.approx(3.0)), 3: (None, None)}
    dense = aggregates.rollup_dense(
        hourly(spark), ["k"], "ts", rules, units={"t2m": (1.0, -273.15), "tp": (1000.0, 0.0)}
    )
    got = {r.month_start.month: (r.mean, r.rain) for r in dense.collect()}
    assert got == {1: (pytest.approx(11.85), pytest.approx(3.0)), 2: (None, 0.0), 3: (None, 0.0)}


def test_bias_factor_limits(spark):
    def rows(key, n, model):
        return [(key, 2.0 * i, model(i)) for i in range(1, n + 1)] + [(key, 5.0, None), (key, None, 7.0)]

    data = rows("short", 11, float) + rows("ok", 12, float) + rows("zero", 12, lambda i: 0.0)
    df = spark.createDataFrame(data, "k string, obs double, model double")
    got = dict(aggregates.bias_factor(df, "k", "obs", "model").collect())
    assert got == {"short": None, "ok": 2.0, "zero": None}


# ---- calendars and interpolation --------------------------------------------


def test_densify_own_range_and_bounds(spark):
    df = spark.createDataFrame(
        [("A", date(1982, 8, 1), 1.0), ("A", date(1984, 2, 1), 2.0), ("B", date(1983, 1, 1), 3.0)],
        "k string, t date, v double",
    )
    dense = calendar.densify(df, ["k"], "t")
    assert dense.where("k = 'A'").count() == 19
    assert dense.where("k = 'A' and v is null").count() == 17
    again = calendar.densify(dense, ["k"], "t")
    assert quality.check_subset(again, dense).count() == 0
    fixed = calendar.densify(df, ["k"], "t", bounds=("1983-01-01", "1983-12-01"))
    assert fixed.count() == 24 and fixed.where("v is not null").count() == 1
    assert quality.check_complete(dense, "k", "t").count() == 0
    assert quality.check_complete(df, "k", "t").count() == 1


def test_long_calendar_is_laid_out_in_blocks(spark):
    ends = [("A", datetime(2000, 1, 1, 0)), ("A", datetime(2001, 12, 31, 23))]
    df = spark.createDataFrame(ends, "k string, t timestamp_ntz").withColumn("v", F.lit(1.0))
    dense = calendar.densify(df, ["k"], "t", grain="hour")
    hours = 24 * 731
    assert hours > 2 * calendar.CALENDAR_BLOCK
    assert dense.count() == hours == dense.select("t").distinct().count()
    assert dense.where("v is not null").count() == 2


def test_interpolation_ends(spark):
    df = series(spark, [None, 1.0, None, 3.0, None, None])
    got = interpolate.interpolate_linear(df, "k", step_number("t", "month"), "v")
    assert values_of(got, "interpolated") == [None, 1.0, 2.0, 3.0, 3.0, 3.0]


@pytest.mark.parametrize("block", [1, 5, 12, 4096])
def test_interpolation_equals_pandas_for_any_block_size(spark, block):
    rng = random.Random(block)
    frames, expected = [], {}
    for k in "ABCDEF":
        gappy = rng.random()
        vals = [rng.uniform(-5, 5) if rng.random() > gappy else None for _ in range(160)]
        frames += [(k, month(i), v) for i, v in enumerate(vals)]
        expected[k] = pd.Series(vals, dtype=float).interpolate(method="linear").tolist()
    frames += [("N", month(i), None) for i in range(5)]
    expected["N"] = [math.nan] * 5
    df = spark.createDataFrame(frames, "k string, t date, v double").repartition(7)
    got = interpolate.interpolate_linear(
        df, "k", step_number("t", "month"), "v", block_steps=block
    ).toPandas()
    for k, want in expected.items():
        have = got[got.k == k].sort_values("t").interpolated.astype(float).tolist()
        np.testing.assert_allclose(have, want, rtol=1e-12)


def test_fill_static_and_missing_lists(spark):
    df = spark.createDataFrame(
        [("A", month(0), None, 1.0), ("A", month(3), "x", None), ("A", month(5), "y", 2.0)],
        "k string, t date, name string, v double",
    )
    dense = calendar.fill_static(calendar.densify(df, ["k"], "t"), "k", "t", ["name"])
    assert values_of(dense, "name") == ["x"] * 6
    listed = calendar.missing_by_year(dense, "k", "t", "v").collect()
    assert [(r.year, r.missing) for r in listed] == [(2000, ["2000-02", "2000-03", "2000-04", "2000-05"])]


# ---- imputation -------------------------------------------------------------


def test_climatology_fill_matches_pandas(spark):
    rng = random.Random(3)
    data, want = [], {}
    for k in "AB":
        vals = [rng.uniform(0, 9) if rng.random() > 0.5 else None for _ in range(48)]
        for i in range(0, 48, 12):  # January is never observed
            vals[i] = None
        data += [(k, month(i), v) for i, v in enumerate(vals)]
        s = pd.Series(vals, dtype=float)
        means = s.groupby(np.arange(48) % 12).transform("mean")
        want[k] = s.fillna(means).interpolate(method="linear").tolist()
    data += [("C", month(i), float(i)) for i in range(24)]
    df = spark.createDataFrame(data, "k string, t date, v double")
    skipped = impute.impute_climatology(df, "k", "t", "v", block_steps=7).toPandas()
    assert sorted(set(skipped.k)) == ["A", "B"]
    for k in "AB":
        got = skipped[skipped.k == k].sort_values("t").v_imputed.astype(float)
        np.testing.assert_allclose(got, want[k], rtol=1e-12)
        assert math.isnan(got.iloc[0])  # a leading gap without climatology stays
    kept = impute.impute_climatology(df, "k", "t", "v", on_complete="keep")
    assert kept.where("k = 'C' and v = v_imputed").count() == 24
    assert kept.where("v is not null and v <> v_imputed").count() == 0


def test_flags(spark):
    df = spark.createDataFrame([(1.0, 9.0), (None, 9.0), (None, None)], "obs double, model double")
    for rule, flags in (("reference", [False, True, True]), ("strict", [False, True, False])):
        got = impute.impute_from_model(df, {"obs": "model"}, rule).collect()
        assert [r.obs_imputed for r in got] == flags
        assert [r.obs_filled for r in got] == [1.0, 9.0, None]
        assert [r.obs for r in got] == [1.0, None, None]
    absent = impute.impute_from_model(df, {"obs": "nothing"}).collect()
    assert [r.obs_imputed for r in absent] == [False] * 3


# ---- correlation ------------------------------------------------------------


def brute_corr(data, min_periods=24):
    wide = pd.DataFrame(data, columns=["k", "t", "v"]).pivot(index="t", columns="k", values="v")
    r = wide.corr(min_periods=min_periods)
    return {(a, b): r.loc[a, b] for a in r for b in r if a < b}


def corr_data():
    rng = np.random.default_rng(5)
    base = rng.normal(size=120)
    data = []
    for j in range(23):
        own = rng.uniform(-1, 1) * base + rng.normal(size=120) + 1e6 * (j % 3)
        seen = rng.random(120) > rng.uniform(0, 0.8)
        data += [(f"s{j:02d}", i, float(own[i])) for i in range(120) if seen[i]]
    data += [("const", i, 0.1) for i in range(120)]
    data += [("few", i, float(i % 7)) for i in range(23)]
    # Varies, but not over the months it shares with "few" alone.
    data += [("step", i, 5.3 if i < 60 else float(i)) for i in range(120)]
    data += [("half", i, float(i * i)) for i in range(60)]
    return data


@pytest.mark.parametrize(("blocks", "stretch"), [(1, 4096), (4, 4096), (3, 17), (30, 50)])
def test_corr_equals_pandas_for_any_blocking(spark, blocks, stretch):
    data = corr_data()
    df = spark.createDataFrame(data, "k string, t long, v double").repartition(5)
    got = correlate.pairwise_corr(
        df, "k", F.col("t"), "v", entity_blocks=blocks, time_block=stretch
    ).collect()
    have = {(r.a, r.b): r.r for r in got}
    want = brute_corr(data)
    assert len(have) == len(got)
    for pair, r in want.items():
        if math.isnan(r):
            assert have.get(pair) is None, pair
        else:
            assert have[pair] == pytest.approx(r, abs=1e-9), pair
    assert have[("half", "step")] is None and ("const", "s00") in have


def test_ranked_pairs_classes_and_donors(spark):
    rows = [("a", "b", 30, -0.2), ("a", "c", 30, -0.6), ("b", "c", 30, None), ("a", "e", 30, -0.2), ("b", "e", 30, 0.75)]
    corr = spark.createDataFrame(rows, "a string, b string, n long, r double")
    assert [(r.a, r.b) for r in correlate.ranked_pairs(corr).collect()] == [("b", "e"), ("a", "b"), ("a", "e"), ("a", "c")]
    entities = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    best = {r.target: (r.donor, r.r) for r in correlate.best_donor(corr, entities, "k").collect()}
    assert best == {"a": ("b", -0.2), "b": ("e", 0.75), "c": ("a", -0.6), "d": (None, None), "e": ("b", 0.75)}
    classes = {r: None for r in (0.7, 0.69, 0.5, 0.4, 0.29, -0.29, -0.9, None)}
    df = spark.createDataFrame([(r,) for r in classes], "r double")
    got = [x[0] for x in df.select(correlate.corr_class("r")).collect()]
    assert got == ["strong", "moderate", "moderate", None, "weak", "weak", None, None]


@pytest.mark.parametrize("make", [correlate._block_products])
def test_task_functions_need_no_installed_package(tmp_path, make):
    import subprocess
    import sys

    from pyspark import cloudpickle

    path = tmp_path / "function"
    path.write_bytes(cloudpickle.dumps(make()))
    load = "import pickle, sys; pickle.load(open(sys.argv[1], 'rb'))"
    subprocess.run([sys.executable, "-c", load, str(path)], cwd=tmp_path, check=True)


# ---- names and places -------------------------------------------------------

ALIASES = [("jiji", "Jiji"), ("mulembwe", "Mulembwe"), ("basse mulembwe", "Mulembwe"), ("murembwe", "Mulembwe"), ("ji", "Short"), ("rusizi", "Rusizi")]


def test_canonical_names_by_list_and_by_table(spark):
    cases = {
        "BASSE-MULEMBWE (Mutambara)": "Mulembwe", "Murembwe": "Mulembwe", "Rusizi (Gatumba)": "Rusizi",
        "dama": None, "": None, None: None, "Jiji/Ndago": "Jiji", "xjix": "Short", "ji": "Short", "ruSÍzi": "Rusizi",
    }
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = {r.raw: r.entity for r in names.canonicalize(df, "raw", ALIASES).collect()}
    assert got == cases
    table = spark.createDataFrame([(a, e, i) for i, (a, e) in enumerate(ALIASES)], "alias string, entity string, ord int")
    got = {r.raw: r.entity for r in names.canonicalize_by_table(df, "raw", table).collect()}
    assert got == cases
    for some, shard in ((table.limit(0), 5), (table.union(table).unionByName(table.selectExpr("cast(null as string) alias", "entity", "ord")), 3)):
        got = {r.raw: r.entity for r in names.canonicalize_by_table(df, "raw", some, shard=shard).collect()}
        assert got == ({k: None for k in cases} if shard == 5 else cases)


@pytest.mark.parametrize("shard", [names.SHARD, 7, 1])
def test_alias_table_equals_brute_force(spark, shard):
    rng = random.Random(11)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip() or "a"
    aliases = [(" ".join(word(rng.randint(1, 6)).split()), f"e{i}", i) for i in range(60)]
    texts = list({word(rng.randint(1, 40)) for _ in range(200)})
    df = spark.createDataFrame([(t,) for t in texts], "raw string")
    table = spark.createDataFrame(aliases, "alias string, entity string, ord int")
    got = {r.raw: r.entity for r in names.canonicalize_by_table(df, "raw", table, shard=shard).collect()}

    def brute(raw):
        name = " ".join(raw.split())
        exact = [e for a, e, _ in aliases if a == name]
        return (exact or [e for a, e, _ in aliases if a in name] or [None])[0]

    assert got == {t: brute(t) for t in texts}


def brute_nearest(entities, stations):
    out = {}
    for k, cell, lat, lon in entities:
        same = [s for s in stations if s[1] == cell and cell is not None]
        pool = same or stations
        best = min(pool, key=lambda s: (math.sqrt((lat - s[2]) ** 2 + (lon - s[3]) ** 2), s[0]))
        out[k] = (best[0], "same_era5_grid" if same else "nearest_fallback")
    return out


@pytest.mark.parametrize("n_stations", [3, 40, 70, 300])
@pytest.mark.parametrize("spread", [9, 0.05, 4000])
def test_nearest_equals_brute_force(spark, n_stations, spread):
    """Ties, NULL and NaN places, many and few stations, dense and far apart: one meaning."""
    rng = random.Random(n_stations)
    number = lambda: rng.randint(-9, 9) * spread / 9
    place = lambda i, p: (f"{p}{i:03d}", rng.choice(["a", "b", "c", "d", None]), number(), number())
    entities = [place(i, "e") for i in range(80)]
    stations = [s for s in (place(i, "s") for i in range(n_stations)) if s[1] not in ("c", "d")] + [("s999", "b", 1e7, 0.0)]
    nowhere = [("x", "a", float("nan"), 1.0), ("y", "a", None, 1.0), ("z", "d", 1.0, float("nan")), ("w", "a", float("inf"), 1.0)]
    schema = "id string, cell string, lat double, lon double"
    got = nearest.nearest_join(
        spark.createDataFrame(entities + nowhere, schema).withColumnRenamed("id", "k"),
        spark.createDataFrame(stations + nowhere, schema).withColumnRenamed("id", "s"),
        "k", "s",
    ).collect()
    want = brute_nearest(entities, stations)
    assert {r.k: (r.s, r.selection_mode) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize(("page", "leaf", "towns"), [(2048, 16, False), (9, 2, False), (40, 3, True)])
def test_nearest_in_all_quadrants(spark, monkeypatch, page, leaf, towns):
    """Entities and stations of all quadrants, with crowded towns: any splitting, the same stations."""
    monkeypatch.setattr(nearest, "PAGE", page)
    monkeypatch.setattr(nearest, "LEAF", leaf)
    rng = random.Random(page)
    spot = lambda: (rng.choice([(0, 0), (51.5, -0.1), (-33.9, 18.4)]) if towns and rng.random() < 0.7 else (0, 0))

    def place(i, p):
        (lat, lon), wide = spot(), 0.05 if towns and rng.random() < 0.7 else 170
        return (f"{p}{i:03d}", rng.choice(["a", "b", None]), lat + rng.uniform(-wide, wide) / 2, lon + rng.uniform(-wide, wide))

    entities, stations = [place(i, "e") for i in range(150)], [place(i, "s") for i in range(300)]
    schema = "id string, cell string, lat double, lon double"
    e = spark.createDataFrame(entities, schema).withColumnRenamed("id", "k")
    s = spark.createDataFrame(stations, schema).withColumnRenamed("id", "s")
    got = {r.k: (r.s, r.selection_mode) for r in nearest.nearest_join(e, s, "k", "s").collect()}
    assert got == brute_nearest(entities, stations)


def test_nearest_bound_is_not_worked_out_for_each_box(spark):
    box = F.struct(*(F.col("id").cast("double").alias(c) for c in ("lat0", "lat1", "lon0", "lon1")))
    found = spark.range(1).select(F.array(box, box).alias("boxes"), F.rand().alias("x")).select(nearest._near("boxes", F.col("x"), F.col("x")).alias("found"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_min" in plan and "array_min" not in plan.split("filter(", 1)[1].split(chr(10))[0]


def test_nearest_across_the_equator_is_no_cross_join(spark):
    """300 entities north, 300 stations south: pages met, not pairs."""
    rng = random.Random(2)
    schema = "id string, cell string, lat double, lon double"
    north = [(f"e{i}", None, rng.uniform(0.01, 9), rng.uniform(-9, 9)) for i in range(300)]
    south = [(f"s{i}", None, rng.uniform(-9, -0.01), rng.uniform(-9, 9)) for i in range(300)]
    e = spark.createDataFrame(north, schema).withColumnRenamed("id", "k")
    s = spark.createDataFrame(south, schema).withColumnRenamed("id", "s")
    found = nearest.nearest_join(e, s, "k", "s")
    assert {r.k: (r.s, r.selection_mode) for r in found.collect()} == brute_nearest(north, south)
    plan = found._jdf.queryExecution().executedPlan()
    rows, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.executedPlan())
            continue
        if node.metrics().contains("numOutputRows"):
            rows.append(node.metrics().apply("numOutputRows").value())
        todo += [node.plan()] if node.nodeName().endswith("QueryStage") else []
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    assert max(rows) < 10_000


def test_long_names_cost_their_length(spark):
    """The rows between the steps stay short whatever the name's length."""
    table = spark.createDataFrame([("needle", "N", 0), ("abcdefgh", "A", 1), ("zz", "Z", 2)], "alias string, entity string, ord int")
    long = "x " * 20_000
    df = spark.createDataFrame([(long + "needle",), (long + "zz" + long,), (long,), ("x" * 255 + "abcdefgh",)], "raw string")
    got = {r.raw: r.entity for r in names.canonicalize_by_table(df, "raw", table).collect()}
    assert [got[r.raw] for r in df.collect()] == ["N", "Z", None, "A"]


def test_repeated_time_in_a_series_raises(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), ("b", 1, 1.0)], "k string, t int, v double")
    with pytest.raises(Exception, match="a time is repeated in series a"):
        correlate.pairwise_corr(df, "k", F.col("t"), "v", entity_blocks=2).collect()


@pytest.mark.parametrize(("grain", "freq"), [("day", "D"), ("hour", "h")])
def test_climatology_of_finer_grains(spark, grain, freq):
    """As pandas: season mean, then linear interpolation and the last value carried on."""
    import pandas as pd

    times = pd.date_range("2001-01-01", periods=90, freq=freq)
    values = [float(i % 31) if i < 31 or i in (45, 70) else None for i in range(90)]
    series = pd.Series(values, times)
    filled = series.fillna(series.groupby(series.index.month).transform("mean")).interpolate(limit_direction="both")
    kind = "date" if grain == "day" else "timestamp_ntz"
    rows = [("k", t.date() if grain == "day" else t.to_pydatetime(), v) for t, v in zip(times, values)]
    df = spark.createDataFrame(rows, f"k string, t {kind}, v double")
    got = impute.impute_climatology(df, "k", "t", "v", grain=grain).orderBy("t").collect()
    assert [r.v_imputed for r in got] == pytest.approx(filled.tolist())


def test_an_absent_model_fills_nothing(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None)], "k string, v double")
    rows = impute.impute_bias_corrected(df, "k", "v", "model").orderBy("v").collect()
    assert [(r.k, r.v, r.bias_factor, r.v_filled, r.v_imputed) for r in rows] == [("a", None, None, None, False), ("a", 1.0, None, 1.0, False)]


def test_listed_entities_get_their_months(spark):
    df = spark.createDataFrame([("a", datetime(2000, 2, 3), 2, 1.0)], "k string, t timestamp_ntz, c int, w double")
    listed = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    bounds = ("2000-01-01", "2000-03-01")
    got = reduce.class_fraction(df, "k", "t", "c", "w", bounds, listed).orderBy("k", "month").collect()
    assert [(r.k, r.month, r.water_fraction, r.water_pixels) for r in got] == [
        ("a", 1, None, 0), ("a", 2, 1.0, 1), ("a", 3, None, 0), ("b", 1, None, 0), ("b", 2, None, 0), ("b", 3, None, 0),
    ]
    got = reduce.monthly_index(df, "k", "t", "w", bounds, entities=listed).orderBy("k", "month").collect()
    assert [(r.k, r.ndvi) for r in got] == [("a", None), ("a", 0.0001), ("a", None), ("b", None), ("b", None), ("b", None)]
    empty = reduce.class_fraction(df.limit(0), "k", "t", "c", "w", bounds, listed)
    assert empty.count() == 6


def test_nearest_prefers_own_cell(spark):
    schema = "id string, cell string, lat double, lon double"
    e = spark.createDataFrame([("x", "a", 0.0, 0.0)], schema).withColumnRenamed("id", "k")
    s = spark.createDataFrame([("far", "a", 5.0, 0.0), ("near", "b", 1.0, 0.0)], schema).withColumnRenamed("id", "s")
    row = nearest.nearest_join(e, s, "k", "s").first()
    assert (row.s, row.distance_deg, row.selection_mode) == ("far", 5.0, "same_era5_grid")


def test_attach_nearest_keeps_source_without_reading(spark):
    base = spark.createDataFrame([("x", month(0)), ("x", month(1))], "k string, t date")
    choices = spark.createDataFrame([("x", "s1")], "k string, s string")
    readings = spark.createDataFrame([("s1", month(0), 4.0)], "s string, t date, v double")
    got = nearest.attach_nearest(base, choices, readings, key="k", t="t", station="s", measures=["v"])
    assert [(r.v, r.source) for r in got.orderBy("t").collect()] == [(4.0, "s1"), (None, "s1")]


# ---- shape and checks -------------------------------------------------------


def test_upsert_columns(spark):
    base = spark.createDataFrame([(1, 1.0, "old"), (2, 2.0, "old")], "ts int, a double, b string")
    extra = spark.createDataFrame([(1, "new", 7)], "ts int, b string, c int")
    once = shape.upsert_columns(base, extra, ["ts"])
    assert once.columns == ["ts", "a", "b", "c"]
    assert sorted(map(tuple, once.collect())) == [(1, 1.0, "new", 7), (2, 2.0, None, None)]
    twice = shape.upsert_columns(once, extra, ["ts"])
    assert quality.check_subset(twice, once).count() == 0
    with pytest.raises(Exception, match="not unique"):
        shape.upsert_columns(base, extra.union(extra), ["ts"]).collect()


def test_unpivot_pivot(spark):
    wide = spark.createDataFrame([(1, 2.0, None), (2, 4.0, 5.0)], "t int, x double, y double")
    long = shape.unpivot(wide, ["t"])
    assert long.columns == ["t", "ord", "source_name", "value"] and long.count() == 4
    back = shape.pivot_series(long, "source_name", "t", "value", ["x", "y"])
    assert quality.check_subset(back, wide).count() == 0


def test_checks_find_faults(spark):
    df = spark.createDataFrame([("a", month(0), 1.0), ("a", month(0), None), ("a", month(2), 1.0)], "k string, t date, v double")
    assert quality.check_unique(df, ["k", "t"]).collect()[0].n_rows == 2
    assert quality.check_complete(df, "k", "t").count() == 1
    assert quality.check_subset(df.limit(0), df).agg(F.sum("surplus")).first()[0] == -3
    with pytest.raises(ValueError, match="check failed"):
        quality.require_empty(quality.check_unique(df, ["k", "t"]))


# ---- reductions, gaps, features ---------------------------------------------


def test_class_fraction_cuts_counts_after_dividing(spark):
    rows = [
        ("r", datetime(1984, 1, 5), 0, 3.0),
        ("r", datetime(1984, 2, 5), 2, 0.1), ("r", datetime(1984, 2, 6), 1, 0.3),
        ("r", datetime(1984, 3, 5), 2, 5.3), ("r", datetime(1984, 3, 6), 1, 5.3),
    ]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, cls int, w double")
    got = reduce.class_fraction(df, "k", "ts", "cls", "w", ("1984-01-01", "1984-04-01")).orderBy("month").collect()
    assert [(r.water_fraction, r.water_pixels, r.total_pixels) for r in got] == [
        (None, 0, 0), (0.25, 0, 0), (0.5, 5, 10), (None, 0, 0)
    ]


def test_gap_inventory_and_final_values(spark):
    df = series(spark, [None, 1.0, None, None, 4.0, None, 6.0, None])
    rows = gaps.gap_rows(df, "k", "t", "v", line="line", block_steps=3)
    inventory = gaps.gap_inventory(rows, "k", "t").orderBy("gap_start").collect()
    assert [(r.gap_position, r.gap_length, r.gap_start, r.gap_end) for r in inventory] == [
        ("edge", 1, month(0), month(0)), ("internal", 2, month(2), month(3)),
        ("internal", 1, month(5), month(5)), ("edge", 1, month(7), month(7)),
    ]
    policy = [dict(position="internal", lo=1, hi=1, method="linear_interpolation", basis="b", note="n", table="t", confidence="benchmark_supported")]
    final = gaps.finalise(gaps.apply_policy(rows, policy), "v", {"linear_interpolation": "line"})
    assert values_of(final, "value_final") == [None, 1.0, None, None, 4.0, 5.0, 6.0, None]
    assert values_of(final, "fill_source").count("unresolved_missing") == 4
    assert values_of(final, "fill_method")[5] == "linear_interpolation"
    assert gaps.sensitivity_subset(final).count() == 3
    assert gaps.sensitivity_subset(final, ["benchmark_supported"]).count() == 4
    assert gaps.sensitivity_subset(final, None).count() == 4


def test_features(spark):
    cells = spark.createDataFrame([("b", 1.0, 1.0), ("b", None, 1.0), ("b", 4.0, 2.0), ("n", None, 3.0)], "k string, v double, w double")
    got = {r.k: (r.mean, r.valid_area_fraction) for r in features.area_weighted(cells, ["k"], "v", "w").collect()}
    assert got == {"b": (3.0, 0.75), "n": (None, 0.0)}
    soil = spark.createDataFrame([("a", "clay", "0_5", 1.0), ("a", "sand", "5_15", 2.0), ("z", "other", "0_5", 1.0)], "k string, p string, d string, v double")
    wide = features.pivot_features(soil, "k", "p", "d", "v", ["clay", "sand"], ["0_5", "5_15"])
    flagged = features.missing_flags(wide, wide.columns[1:])
    assert {r.k: (r.missing_feature_count, r.all_missing_flag) for r in flagged.collect()} == {"a": (2, False), "z": (4, True)}
    land = spark.createDataFrame([("a", "10", 1.0), ("a", "20", 1.0), ("a", "30", 2.0), ("b", "20", 1.0), ("b", "10", 1.0)], "k string, c string, w double")
    rows = features.category_share(land, "k", "c", "w").collect()
    assert {(r.k, r.c): r.share for r in rows}[("a", "30")] == 0.5
    assert {r.k: r.dominant for r in rows} == {"a": "30", "b": "10"}


def test_results_do_not_depend_on_partitioning(spark):
    data = corr_data()
    df = spark.createDataFrame(data, "k string, s long, v double").select(
        "k", F.add_months(F.lit(date(2000, 1, 1)), F.col("s").cast("int")).alias("t"), "v"
    )
    dense = lambda d: calendar.densify(d, ["k"], "t")
    one = gaps.gap_rows(dense(df.coalesce(1)), "k", "t", "v")
    many = gaps.gap_rows(dense(df.repartition(13)), "k", "t", "v")
    assert quality.check_subset(one, many).count() == 0


@pytest.mark.parametrize("block", [4, 4096])
@pytest.mark.parametrize("bounds", [None, ("2020-02-01", "2020-11-30")])
def test_densify_brings_gaps_with_rows(spark, monkeypatch, block, bounds):
    """Rows repeated, off the grain, without a time or a key, outside the bounds; blocks without a row."""
    from panelloom.operators import calendar

    monkeypatch.setattr(calendar, "CALENDAR_BLOCK", block)
    day = date
    rows = [("a", day(2020, 1, 1), 1), ("a", day(2020, 3, 1), 2), ("a", day(2020, 3, 1), 3), ("a", day(2020, 12, 1), None), ("a", day(2020, 5, 7), 4)]
    rows += [("b", day(2020, 6, 1), 5), ("b", None, 6), (None, day(2020, 7, 1), 7), ("c", day(2021, 1, 1), 8), ("d", day(2020, 4, 1), 9), ("d", day(2020, 4, 1), 9)]
    df = spark.createDataFrame(rows, "k string, t date, v int")
    got = sorted(((r.k, r.t, r.v) for r in calendar.densify(df, ["k"], "t", bounds=bounds).collect()), key=str)
    want = []
    for k in "abcd":
        mine = [(t, v) for x, t, v in rows if x == k and t]
        months = [(t.year, t.month) for t, _ in mine] if bounds is None else [(2020, 2), (2020, 11)]
        (y, m), last = min(months), max(months)
        while (y, m) <= last:
            found = [v for t, v in mine if t == day(y, m, 1)] or [None]
            want += [(k, day(y, m, 1), v) for v in found]
            y, m = (y, m + 1) if m < 12 else (y + 1, 1)
    assert got == sorted(want, key=str)


def test_a_calendar_is_not_shuffled(spark):
    """Ten thousand hours of a series with two readings: two rows and a few blocks reach the join."""
    df = spark.createDataFrame([("a", 0), ("a", 9_999)], "k string, h int").selectExpr("k", "timestamp_ntz '2020-01-01 00:00:00' + make_dt_interval(0, h) AS t", "h")
    from panelloom.operators import calendar

    dense = calendar.densify(df, ["k"], "t", grain="hour")
    plan = dense._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode(sequence") < plan.index("Window") < plan.index("Join")
    assert dense.count() == 10_000 and dense.where("h IS NOT NULL").count() == 2
