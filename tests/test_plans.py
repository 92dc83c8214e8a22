"""Whole jobs on small files: sheets to published panel, fills, exports."""

from __future__ import annotations

import csv
import os
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelloom.operators import quality
from panelloom.plans import climate_fill, hourly_export, level_fill, panel_build
from panelloom.plans import fixed_values as fv
from panelloom.sinks import commit, write
from panelloom.sources import files, payload, sheets


def write_csv(path, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8") as out:
        csv.writer(out).writerows(rows)


LEVEL_JIJI = [
    ["Niveaux d'eau", "", "", "", "", "", ""],
    ["", "", "", "", "", "", ""],
    ["Station_Name", "Lat", "Lon", "Elev", "Year", "Month", "Haut moy (m)"],
    ["JIJI (Ndago)", "-4.00", "29.75", "900", "2000", "1", "1.5"],
    ["JIJI (Ndago)", "-4.00", "29.75", "900", "2000", "2", ""],
    ["JIJI (Ndago)", "-4.00", "29.75", "900", "2000", "5", "2,5"],
    ["JIJI (Ndago)", "-4.00", "29.75", "900", "2000", "13", "9"],
    ["Autre", "-4.10", "29.80", "900", "2000", "1", "7"],
    ["", "", "", "", "", "", ""],
    ["JIJI (Ndago)", "", "", "", "", "", ""],
]
LEVEL_RUSIZI = [
    ["Name", "lat", "lon", "Alt", "YY", "MM", "haut.moy"],
    *[["RUSIZI (Gatumba)", "-3.34", "29.27", "780", str(2000 + i // 12), str(i % 12 + 1), str(i + 1)] for i in range(30)],
]


@pytest.fixture(scope="module")
def raw(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("raw"))
    write_csv(f"{root}/levels/Niveaux d'eau de la Riviere Jiji.csv", LEVEL_JIJI)
    write_csv(f"{root}/levels/Niveaux d'eau de la Riviere RUSIZI.csv", LEVEL_RUSIZI)
    write_csv(
        f"{root}/runoff/Ruissellement.csv",
        [["Année", "Mois", "Jiji", "Rusizi", "Dama", "Ndago Jiji"], ["2000", "1", "", "3.5", "9", "8.5"], ["2000", "3", "4.5", "x", "9", ""]],
    )
    head = ["Station_Name", "Lat", "Lon", "Year", "Month", "Temp max", "Temp min"]
    write_csv(
        f"{root}/temp/a_Temp.csv",
        [["Températures"] + [""] * 6, head]
        + [["BUJUMBURA (Aéroport)", "-3.32", "29.32", "2000", str(m), str(30 + m), str(15 + m)] for m in range(1, 13)]
        + [["MPOTA (Tora)", "-3.73", "29.57", "2000", "1", "20", "10"]],
    )
    # The same station again in another file: it must not multiply rows.
    write_csv(f"{root}/temp/b_Temp.csv", [head, ["Bujumbura aeroport", "-3.32", "29.32", "2000", "1", "99", "99"]])
    write_csv(
        f"{root}/precip/les precipitations mensuelles.csv",
        [["Name", "Lat", "Lon", "YY", "MM", "Total mensuel"]]
        + [["BUJUMBURA (Aeroport)", "-3.32", "29.32", str(2000 + i // 12), str(i % 12 + 1), str(10 * (i + 1))] for i in range(14)],
    )
    for grid in ("grid_m4.00_29.75", "grid_m3.25_29.25"):
        rows = [["timestamp", "latitude", "longitude", "u10", "v10", "t2m", "tp", "d2m", "msl"]]
        start = datetime(2000, 1, 1)
        for d in range(0, 31 * 27):
            t = start + timedelta(days=d)
            if t.month == 4 and t.year == 2000:
                continue
            rows.append([t.isoformat(sep=" "), -3, 29, 1, 2, 290 + d % 3, 0.001 * t.month, 280, 101300])
        write_csv(f"{root}/hourly/era5_{grid}_1940_2026.csv", rows)
    return root


def sheet(spark, path):
    return sheets.read_sheet_rows(spark, path, 7)


@pytest.fixture(scope="module")
def panel(spark, raw):
    levels, located, unmatched = panel_build.river_levels(sheet(spark, f"{raw}/levels/*.csv"))
    wide = files.read_series(spark, f"{raw}/runoff/Ruissellement.csv", expect_files=1).withColumn(
        "row", F.monotonically_increasing_id()
    )
    runoff, unmapped = panel_build.river_runoff(wide, "row")
    temperature = panel_build.station_months(
        sheet(spark, f"{raw}/temp/*.csv"),
        {"temp_max_observed": ["temp", "max"], "temp_min_observed": ["temp", "min"]},
    )
    precipitation = panel_build.station_months(
        sheet(spark, f"{raw}/precip/*.csv"), {"precip_observed": ["total", "mensuel"]}
    )
    grids = spark.createDataFrame(list(fv.RIVER_GRID.items()), "river string, cell string")
    rivers = located.join(grids, "river", "left")
    hourly = hourly_export.read_hourly(spark, f"{raw}/hourly/*.csv", key="era5_grid")
    built, sources = panel_build.assemble(
        levels, runoff, rivers, temperature, precipitation, panel_build.hourly_months(hourly)
    )
    return built.cache(), sources, unmatched, unmapped


def test_sheet_rows_keep_their_order(spark, raw):
    rows = sheet(spark, f"{raw}/levels/*Jiji.csv").orderBy("row_idx").collect()
    assert [r.row_idx for r in rows] == list(range(len(LEVEL_JIJI)))
    assert [r.cells[0] or "" for r in rows] == [r[0] for r in LEVEL_JIJI]


def test_panel(panel):
    built, sources, unmatched, unmapped = panel
    assert tuple(built.columns) == fv.PANEL_COLUMNS
    jiji = {r.date: r for r in built.where("river = 'Jiji'").collect()}
    assert sorted(jiji) == [date(2000, m, 1) for m in range(1, 6)]
    january = jiji[date(2000, 1, 1)]
    # "Autre" sorts before "JIJI" within the month.
    assert january.water_level == 7.0 and january.runoff == 8.5
    assert [jiji[date(2000, m, 1)].water_level for m in range(2, 6)] == [None] * 4
    assert jiji[date(2000, 3, 1)].runoff == 4.5
    assert january.temp_source == "MPOTA (Tora)" and january.temp_max_observed == 20.0
    assert jiji[date(2000, 2, 1)].temp_source == "MPOTA (Tora)" and jiji[date(2000, 2, 1)].temp_max_observed is None
    rusizi = built.where("river = 'Rusizi'").orderBy("date").collect()
    assert len(rusizi) == 30 and rusizi[0].temp_max_observed == 31.0
    assert rusizi[0].runoff == 3.5 and rusizi[2].runoff is None
    assert rusizi[0].era5_tp_sum == pytest.approx(31.0) and rusizi[0].era5_msl_mean == 101300.0
    assert rusizi[3].era5_tp_sum is None
    assert {(r.river, r.station_name_raw) for r in unmatched.collect()} == {("Jiji", "Autre")}
    assert [r[0] for r in unmapped.collect()] == ["dama"]
    report = {r.river: r for r in panel_build.coverage_report(built, sources).collect()}
    assert (report["Jiji"].n_total, report["Jiji"].n_missing, report["Jiji"].temp_mode) == (5, 4, "nearest_fallback")
    assert report["Rusizi"].precip_mode == "same_era5_grid"


def test_publish_checks_first(spark, panel, tmp_path):
    built = panel[0]
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="check failed"):
        panel_build.publish(built.union(built), out)
    assert not os.path.exists(out) and not os.path.exists(out + "_unpublished")
    for _ in range(2):  # a second run replaces, it does not add
        listed = {r.file: r.row_count for r in panel_build.publish(built, out).collect()}
    assert {f.rsplit("/", 1)[0] for f in listed} == {"master_dataset_monthly", "per_river/slug=jiji", "per_river/slug=rusizi"}
    assert all(os.path.exists(f"{out}/{f}") for f in listed)
    assert sum(n for f, n in listed.items() if "jiji" in f) == 5 and sum(listed.values()) == 70
    assert not os.path.exists(out + "_unpublished")
    schema = built.schema
    whole = spark.read.schema(schema).option("header", "true").csv(f"{out}/master_dataset_monthly")
    assert quality.check_subset(whole, built).count() == 0
    parts = spark.read.option("header", "true").option("basePath", f"{out}/per_river").csv(f"{out}/per_river/slug=jiji")
    assert parts.count() == 5 and "slug" in parts.columns


def test_publish_refuses_shared_names_and_lost_levels(spark, panel, tmp_path):
    built, out = panel[0], str(tmp_path / "out")
    for name in ("Jiji-", "水"):
        twin = built.where("river = 'Jiji'").withColumn("river", F.lit(name))
        with pytest.raises(ValueError, match="check failed"):
            panel_build.publish(built.union(twin), out)
        with pytest.raises(Exception, match="no file name of its own"):
            write.manifest(built.union(twin), "river", "all", "per/{slug}").collect()
    levels = built.select("river", "date", "water_level")
    with pytest.raises(ValueError, match="check failed"):
        panel_build.publish(built, out, levels=levels.withColumn("water_level", F.col("water_level") + 1))
    assert not os.path.exists(out)
    assert panel_build.publish(built, out, levels=levels).count() > 0


def test_publish_evaluates_the_panel_once(spark, panel, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(x):
        seen.add(1)
        return x

    rows = panel[0].repartition(2).withColumn("river", counted.asNondeterministic()("river"))
    panel_build.publish(rows, str(tmp_path / "out"))
    assert seen.value == panel[0].count()


def test_per_entity_rewrite_leaves_others_alone(spark, panel, tmp_path):
    built, out = panel[0], str(tmp_path / "per")
    write.write_per_entity(built, out, "river", "date", built.columns)
    write.write_per_entity(built.where("river = 'Jiji'"), out, "river", "date", built.columns)
    again = spark.read.option("header", "true").csv(out)
    assert dict(again.groupBy("slug").count().collect()) == {"jiji": 5, "rusizi": 30}


def test_climate_fill(panel):
    filled = climate_fill.fill_climate(panel[0])
    rusizi = filled.where("river = 'Rusizi'").orderBy("date").collect()
    pairs = [(r.precip_observed, r.era5_tp_sum) for r in rusizi if r.precip_observed is not None and r.era5_tp_sum is not None]
    factor = sum(a for a, _ in pairs) / sum(b for _, b in pairs)
    assert len(pairs) == 13 and rusizi[0].precip_bias_factor == pytest.approx(factor)
    later = rusizi[15]
    assert later.precip_observed is None and later.precip_imputed
    assert later.precip_filled == pytest.approx(later.era5_tp_sum * factor)
    assert rusizi[20].temp_max_filled == rusizi[20].era5_t2m_max and rusizi[20].temp_max_imputed
    assert rusizi[0].temp_max_filled == rusizi[0].temp_max_observed and not rusizi[0].temp_max_imputed
    jiji = filled.where("river = 'Jiji'").orderBy("date").collect()
    assert jiji[0].precip_bias_factor is None
    april = jiji[3]
    assert april.era5_tp_sum is None and april.precip_filled == 40.0 and not april.precip_imputed
    assert april.temp_max_filled is None and april.temp_max_imputed
    laid = climate_fill.in_place(filled)
    assert laid.columns[: len(fv.PANEL_COLUMNS)] == list(fv.PANEL_COLUMNS)
    # The readings end two months before the levels do.
    assert laid.where("river = 'Rusizi' and precip_observed is null").count() == 2
    counts = {r.river: r for r in climate_fill.summary(filled).collect()}
    assert counts["Rusizi"].n_total == 30 and counts["Rusizi"].precip_filled == 16


def test_climate_fill_from_files_to_files(spark, panel, tmp_path):
    built = panel[0]
    write.write_panel(built.where("river = 'Jiji'"), f"{tmp_path}/in/jiji", "river", "date", built.columns)
    write.write_panel(built.where("river = 'Rusizi'"), f"{tmp_path}/in/rusizi", "river", "date", built.columns)
    write_csv(f"{tmp_path}/in/jiji/jiji_imputed_monthly.csv", [["river"], ["old"]])
    paths, out = [f"{tmp_path}/in/jiji", f"{tmp_path}/in/rusizi"], f"{tmp_path}/out"
    counts = {r.river: r for r in climate_fill.fill_files(spark, paths, out).collect()}
    assert counts["Rusizi"].n_total == 30 and counts["Rusizi"].precip_filled == 16 and set(counts) == {"Jiji", "Rusizi"}
    want = climate_fill.in_place(climate_fill.fill_climate(built))
    whole = spark.read.schema(want.schema).option("header", "true").csv(f"{out}/master_dataset_monthly_imputed")
    assert whole.columns == want.columns and whole.count() == want.count()
    assert whole.where("precip_imputed").count() == want.where("precip_imputed").count()
    assert sorted(os.listdir(f"{out}/per_river_imputed"))[-2:] == ["slug=jiji", "slug=rusizi"]
    assert not os.path.exists(out + "_unpublished")


def test_level_fill_and_donors(spark, raw):
    dense = level_fill.dense_levels(sheet(spark, f"{raw}/levels/*.csv")).cache()
    jiji = dense.where("river = 'Jiji'").orderBy("Date").collect()
    # Keep-first per month: the first row in the sheet, not the first name.
    assert [r.haut_moy for r in jiji] == [1.5, None, None, None, None]
    assert {r.Station_Name for r in jiji} == {"JIJI (Ndago)"} and {r.Elev for r in jiji} == {900.0}
    filled = level_fill.fill_levels(dense)
    assert filled.columns == ["river", "Date", "Station_Name", "Lat", "Lon", "Elev", "Year", "Month", "haut_moy_original", "haut_moy_imputed"]
    assert [r.haut_moy_imputed for r in filled.orderBy("Date").collect()] == [1.5] * 5
    assert filled.where("river = 'RUSIZI'").count() == 0
    kept = level_fill.summary(level_fill.fill_levels(dense, "keep"))
    by_river = {r.river: r for r in kept.collect()}
    assert (by_river["Jiji"].missing_before, by_river["Jiji"].missing_after, by_river["Jiji"].pct_filled) == (4, 0, 100.0)
    assert (by_river["RUSIZI"].n_total, by_river["RUSIZI"].pct_filled) == (30, 0.0)
    pairs, donors = level_fill.donors(dense, 1)
    assert pairs.count() == 0
    assert {r.target: r.donor for r in donors.collect()} == {"Jiji": None, "RUSIZI": None}


def test_hourly_export_and_extra_variables(spark, raw):
    hourly = hourly_export.read_hourly(spark, f"{raw}/hourly/*.csv")
    months = hourly_export.export_months(hourly).where("location = 'grid_m4.00_29.75'").orderBy("month_start").collect()
    assert len(months) == 28
    april = months[3]
    assert april.month_start == date(2000, 4, 1) and april.tp_sum_mm == 0.0 and april["t2m_mean_C"] is None
    assert months[0]["msl_mean_hPa"] == pytest.approx(1013.0) and months[0].tp_sum_mm == pytest.approx(31.0)
    extra = hourly.select("location", F.col("timestamp").alias("valid_time"), "latitude", F.lit(1.0).alias("msl"), F.lit(5.0).alias("sp"))
    merged = hourly_export.add_variables(hourly, extra)
    assert merged.where("msl = 1.0 and sp = 5.0").count() == hourly.count()
    assert "latitude" in merged.columns


def test_a_second_run_reads_changed_files_only(spark, tmp_path):
    """Months kept by a ledger equal those of a full run, whatever came, changed or went in between."""
    from panelloom.plans import hourly_ledger

    head = ["timestamp", "latitude", "longitude", "u10", "v10", "t2m", "tp", "d2m", "msl"]

    def hours(name, month, n, shift=0.0):
        start = datetime(2000, month, 27)
        rows = [[(start + timedelta(hours=7 * i)).isoformat(sep=" "), -3, 29, i, "" if i % 4 else 2, 290 + shift + i, 0.001 * i, 280, 101300] for i in range(n)]
        write_csv(f"{tmp_path}/in/era5_{name}_1940_x.csv", [head, *rows])

    def check(*read, gone=0):
        report = {}
        got = hourly_ledger.refresh_months(spark, f"{tmp_path}/in/*.csv", f"{tmp_path}/state", report=report)
        assert sorted(os.path.basename(f).split("_")[1] for f in report["read"]) == sorted(read) and report["gone"] == gone
        full = panel_build.hourly_months(hourly_export.read_hourly(spark, f"{tmp_path}/in/*.csv", key="era5_grid"))
        rows = lambda df: sorted((r.era5_grid, r.date, *(None if x is None else round(x, 9) for x in r[2:])) for r in df.select(full.columns).collect())
        assert rows(got) == rows(full)

    (tmp_path / "in").mkdir()
    hours("a", 1, 40), hours("b", 2, 30)
    check("a", "b")
    check()
    hours("c", 1, 5), hours("b", 2, 31, 0.5)
    check("b", "c", gone=1)
    os.remove(f"{tmp_path}/in/era5_a_1940_x.csv")
    check(gone=1)
    hours("a", 5, 3)
    check("a")
    check()
    assert len(os.listdir(f"{tmp_path}/state/ledger")) == 2


def test_rerun_ignores_earlier_results_and_guards_counts(spark, tmp_path):
    for name in ("jiji_monthly", "rusizi_monthly", "jiji_imputed_monthly"):
        write_csv(f"{tmp_path}/{name}.csv", [["date", "v"], ["2000-01-01", "1"]])
    got = files.read_series(spark, f"{tmp_path}/*.csv", key_regex="^(.+)_monthly", key="river", exclude_regex="_imputed")
    assert sorted(r.river for r in got.collect()) == ["jiji", "rusizi"]
    with pytest.raises(FileNotFoundError):
        files.read_series(spark, f"{tmp_path}/*.csv", expect_files=1)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    """Another order, a column more, NaN: never by position."""
    write_csv(f"{tmp_path}/s_a.csv", [["t", "x", "y"], ["1", "1.5", "2.5"], ["2", "NaN", ""]])
    write_csv(f"{tmp_path}/s_b.csv", [["y", "number", "x", "t"], ["20", "7", "10", "3"]])
    got = files.read_series(spark, str(tmp_path), key_regex="^s_(.)", key="s", schema="t int, x double, y double")
    assert sorted(map(tuple, got.collect())) == [("a", 1, 1.5, 2.5), ("a", 2, None, None), ("b", 3, 10.0, 20.0)]
    write_csv(f"{tmp_path}/s_c.csv", [["t", "x"], ["1", "1"]])
    with pytest.raises(ValueError, match="missing in"):
        files.read_series(spark, str(tmp_path), schema="t int, x double, y double")


def test_file_without_series_id_stops_the_job(spark, tmp_path):
    write_csv(f"{tmp_path}/other.csv", [["v"], ["1"]])
    with pytest.raises(Exception, match="no series id in file name other.csv"):
        files.read_series(spark, str(tmp_path), key_regex="^s_(.)").collect()


def test_sheet_rows_lose_nothing(spark, tmp_path):
    path = f"{tmp_path}/sheet.csv"
    with open(path, "w") as f:
        f.write('title\n"A\nB",1,2000,"say ""x"""\n,,\na,b,c,d,e\n')
    rows = sheets.read_sheet_rows(spark, path, 6).orderBy("row_idx").collect()
    assert [[c for c in r.cells if c is not None] for r in rows] == [["title"], ["A\nB", "1", "2000", 'say "x"'], [], list("abcde")]
    assert [r.row_idx for r in rows] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="more than 4 cells"):
        sheets.read_sheet_rows(spark, path, 4).collect()


def test_quoted_commas_are_no_cells(spark, tmp_path):
    path = f"{tmp_path}/sheet.csv"
    with open(path, "w") as f:
        f.write('"a,b,c,d,e",1\nx,"1,2\n3,4",y,z\n"say ""p,q,r,s"" now",2,3\n')
    rows = sheets.read_sheet_rows(spark, path, 4).orderBy("row_idx").collect()
    assert [[c for c in r.cells if c is not None] for r in rows] == [["a,b,c,d,e", "1"], ["x", "1,2\n3,4", "y", "z"], ['say "p,q,r,s" now', "2", "3"]]
    with open(path, "w") as f:
        f.write('"a,b",1,2,3,,x\n')
    with pytest.raises(Exception, match="more than 4 cells"):
        sheets.read_sheet_rows(spark, path, 4).collect()


def test_files_are_known_by_their_path(spark, tmp_path):
    head = ["Station_Name", "Lat", "Lon", "Year", "Month", "haut moy", "x"]
    for folder in ("north", "south é+"):
        (tmp_path / folder).mkdir()
        write_csv(f"{tmp_path}/{folder}/Jiji.csv", [head, [folder, "1", "2", "2000", "1", "5", ""]])
    rows = sheet(spark, [f"{tmp_path}/north/*.csv", f"{tmp_path}/south*/*.csv"])
    assert sorted((r.file, r.row_idx, r.cells[0]) for r in rows.collect()) == [
        ("north/Jiji.csv", 0, "Station_Name"), ("north/Jiji.csv", 1, "north"), ("south é+/Jiji.csv", 0, "Station_Name"), ("south é+/Jiji.csv", 1, "south é+"),
    ]
    assert sheets.detect_header(rows).count() == 2
    with pytest.raises(Exception, match="more than one file for Jiji"):
        panel_build.river_levels(rows)[0].collect()
    assert {r.file for r in sheet(spark, f"{tmp_path}/north/*.csv").collect()} == {"Jiji.csv"}


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    for i in range(30):
        names = ["t", "x", "y"] if i % 3 else ["y", "t", "more", "x"]
        write_csv(f"{tmp_path}/s_{i:02d} [a].csv", [names, *[[str(k) for k, _ in enumerate(names)]] * (i + 1)])
    (tmp_path / "s_99.csv").write_text("")  # no line at all
    sc = spark.sparkContext
    sc.setJobGroup("headers", "headers")
    got = files.read_series(spark, f"{tmp_path}/*.csv", key_regex="^s_(..)", key="s", schema="t int, x double, y double")
    jobs = sc.statusTracker().getJobIdsForGroup("headers")
    sc.setJobGroup("rest", "rest")
    assert len(jobs) == 1
    counts = {r.s: (r.n, r.t) for r in got.groupBy("s").agg(F.count("*").alias("n"), F.max("t").alias("t")).collect()}
    assert counts == {f"{i:02d}": (i + 1, 0 if i % 3 else 1) for i in range(30)}


def one_river(spark, river, levels):
    rows = [(river, date(2000, m, 1), level) for m, level in enumerate(levels, 1)]
    return spark.createDataFrame(rows, "river string, date date, water_level double")


def everything(spark, out):
    read = lambda path: sorted((r.river, str(r.date), float(r.water_level)) for r in spark.read.option("header", "true").csv(path).collect())
    listed = spark.read.option("header", "true").csv(f"{out}/output_manifest")
    return read(f"{out}/master_dataset_monthly"), read(f"{out}/per_river"), sorted((r.file, int(r.row_count)) for r in listed.collect())


def test_a_job_that_dies_leaves_the_old_panel_whole(spark, tmp_path, monkeypatch):
    out = f"{tmp_path}/published"
    panel_build.publish(one_river(spark, "Jiji", [1.0, 2.0]), out)
    panel_build.publish(one_river(spark, "Rusizi", [5.0]), out)  # Jiji's folder stays
    before = everything(spark, out)
    assert [r[0] for r in before[1]] == ["Jiji", "Jiji", "Rusizi"] and len(before[2]) == 3
    with monkeypatch.context() as patch:  # dies between the two writes
        patch.setattr(panel_build, "write_per_entity", lambda *a, **k: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            panel_build.publish(one_river(spark, "Jiji", [9.0]), out)
    assert everything(spark, out) == before and not (tmp_path / "published_unpublished").exists()
    panel_build.publish(one_river(spark, "Jiji", [3.0]), out)
    assert [r[2] for r in everything(spark, out)[1]] == [3.0, 5.0]


@pytest.mark.parametrize("dies_at", [0, 1, 2])
def test_a_job_that_dies_while_switching_is_finished(spark, tmp_path, monkeypatch, dies_at):
    out = f"{tmp_path}/published"
    both = lambda x: one_river(spark, "Jiji", [x]).union(one_river(spark, "Rusizi", [x]))
    panel_build.publish(both(1.0), out)
    calls, real = [], commit._move
    with monkeypatch.context() as patch:
        patch.setattr(commit, "_move", lambda *a: real(*a) if len(calls) != dies_at and not calls.append(a) else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            panel_build.publish(both(2.0), out)
    assert commit.recover(spark, out) and not commit.recover(spark, out)
    combined, per_river, listed = everything(spark, out)
    assert combined == per_river == [("Jiji", "2000-01-01", 2.0), ("Rusizi", "2000-01-01", 2.0)] and sum(n for _, n in listed) == 4
    assert all((tmp_path / "published" / name).exists() for name, _ in listed)


def test_two_files_of_one_river_stop_the_build(spark, tmp_path):
    head = ["Station_Name", "Lat", "Lon", "Year", "Month", "haut moy", "x"]
    for name in ("Jiji", "Jiji (2)"):
        write_csv(f"{tmp_path}/{name}.csv", [head, ["Jiji", "1", "2", "2000", "1", "5", ""], ["Rusizi", "1", "2", "2000", "2", "5", ""]])
    _, _, suspect = panel_build.river_levels(sheet(spark, f"{tmp_path}/Jiji.csv"))
    assert [tuple(r) for r in suspect.collect()] == [("Jiji", "Rusizi", "Rusizi")]
    with pytest.raises(Exception, match="more than one file for Jiji"):
        panel_build.river_levels(sheet(spark, f"{tmp_path}/*.csv"))[0].collect()


def test_file_names_are_decoded(spark, tmp_path):
    name = "Rivière d'été +%20 x"
    write_csv(f"{tmp_path}/{name}.csv", [["v"], ["1"]])
    got = files.read_series(spark, str(tmp_path), key_regex=r"^(.+)\.csv$", key="river")
    assert got.first().river == name


def test_payload_wrapped_or_bare(spark):
    entry = '{"datetime": "1992-10-21 02:53:51", "wse": 771.304, "wse_u": 0.001}'
    no_time = '{"datetime": null, "wse": 1.0, "wse_u": 0.1}'
    df = spark.createDataFrame([(f'{{"data": [{entry}, {no_time}]}}',), (f" [{entry}]",), ("[]",)], "body string")
    rows = payload.lake_levels(df, "body").collect()
    assert [tuple(r) for r in rows] == [(datetime(1992, 10, 21, 2, 53, 51), 771.304, 0.001)] * 2


def test_sheet_headers(spark):
    rows = [
        ("tie", 0, ["Station", "x"]), ("tie", 1, ["Station", "y"]),
        ("none", 0, ["p", "q"]), ("none", 1, ["r", None]),
        ("late", 8, ["Year", "Month", "Station", "Temp"]), ("late", 0, ["a"]),
        ("exact", 0, ["Title"]), ("exact", 2, [" YY ", "x"]), ("exact", 3, ["year", "x"]),
    ]
    df = spark.createDataFrame(rows, "file string, row_idx int, cells array<string>")
    scored = {r.file: (r.header_row, r.header_score) for r in sheets.detect_header(df).collect()}
    assert scored["tie"] == (0, 1) and scored["none"] == (0, 0) and scored["late"][0] == 0
    exact = {r.file: r.header_row for r in sheets.detect_header_exact(df).collect()}
    assert exact == {"tie": 0, "none": 0, "late": 8, "exact": 2}


def test_header_names_and_location(spark):
    rows = [("f", 0, ["Année", None, "Temp Max", "Temp Max", "YY"]), ("f", 1, ["1", "2", "3", "4"])]
    df = spark.createDataFrame(rows, "file string, row_idx int, cells array<string>")
    header = sheets.headers(df, spark.createDataFrame([("f", 0)], "file string, header_row int"))
    row = header.first()
    assert row.columns == ["annee", "unnamed_1", "temp_max", "temp_max_1", "yy"]
    found = header.select(
        sheets.locate("columns", exact=["year", "yy"]).alias("a"),
        sheets.locate("columns", contains=["max", "temp"]).alias("b"),
        sheets.locate("columns", exact=["lat"]).alias("c"),
        sheets.locate("columns", exact=["lat"], contains=["annee"]).alias("d"),
    ).first()
    # Without tokens an absent name is absent; it is not the first column.
    assert tuple(found) == (5, 3, None, 1)
    values = sheets.promote_header(df, header).first()["values"]
    assert values == {"annee": "1", "unnamed_1": "2", "temp_max": "3", "temp_max_1": "4", "yy": None}


def test_missing_column_stops_the_job(spark, tmp_path):
    write_csv(f"{tmp_path}/Jiji.csv", [["Station_Name", "Lat", "Lon", "Year", "Month", "other", "x"], ["a", "1", "2", "2000", "1", "5", ""]])
    with pytest.raises(Exception, match="no column for"):
        panel_build.river_levels(sheet(spark, f"{tmp_path}/*.csv"))[0].collect()
