from __future__ import annotations

import re
import sys
import unicodedata
from datetime import date

import pytest
from pyspark.sql import functions as F

from panelloom.functions import numbers, steps, text


def python_strip(value: str) -> str:
    return "".join(
        c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)
    )


def python_normalize(value: str) -> str:
    plain = python_strip(value).lower().replace("&", " and ")
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def test_strip_accents_is_exact_for_every_character(spark):
    """Every character that changes, and its neighbours, each between two letters."""
    chosen = set()
    for code in range(sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        if unicodedata.decomposition(chr(code)) or unicodedata.combining(chr(code)):
            chosen.update({code, min(code + 1, sys.maxunicode)})
    chosen.update(range(0xAC00, 0xD7A5, 7))
    chosen.update(range(0x20, 0x400))
    texts = [f"a{chr(c)}z" for c in sorted(chosen) if not 0xD800 <= c <= 0xDFFF]
    # Long runs as well: several expanding characters in one text.
    texts += ["".join(texts[i : i + 50]) for i in range(0, len(texts), 1000)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").repartition(8)
    got = {r[0]: (r[1], r[2]) for r in df.select("s", text.strip_accents("s"), text.normalize_text("s")).collect()}
    wrong = [t for t in texts if got[t] != (python_strip(t), python_normalize(t))]
    assert not wrong, [(t, got[t], python_strip(t)) for t in wrong[:5]]


@pytest.mark.parametrize(
    ("raw", "expected"),
    [
        ("Bujumbura (Aéroport)", "bujumbura aeroport"),
        ("A & B", "a and b"),
        ("  ", ""),
        (None, ""),
        ("R&D/2", "r and d 2"),
    ],
)
def test_normalize_text(spark, raw, expected):
    df = spark.createDataFrame([(raw,)], "s string")
    assert df.select(text.normalize_text("s")).first()[0] == expected


def test_normalize_name_and_label(spark):
    df = spark.createDataFrame([("Haut. Moy (m)", "lower_case_name")], "s string, t string")
    row = df.select(text.normalize_name("s"), text.title_label("t")).first()
    assert tuple(row) == ("haut_moy_m", "Lower Case Name")


def test_to_number(spark):
    cases = {
        " 3 ": 3.0, "1,5": None, "1.5d": None, "1e3": 1000.0, "1_000": None, "NaN": None, "": None,
        "\t-.5\n": -0.5, "7.": 7.0, "+2": 2.0, "inf": float("inf"), "-Infinity": float("-inf"),
        "1f": None, "e3": None, ".": None, "\xa04": 4.0,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r[0]: r[1] for r in df.select("s", numbers.to_number("s")).collect()}
    assert got == cases


def test_monthly_date(spark):
    rows = [(81.0, 1.0), (2000.0, 13.0), (2000.0, 0.0), (2000.0, 12.7), (1500.0, 5.0), (3000.0, 5.0), (None, 5.0), (1999.0, 2.0)]
    df = spark.createDataFrame(rows, "y double, m double")
    got = sorted(tuple(r) for r in steps.monthly_date(df, "y", "m").select("year", "month", "date").collect())
    assert got == [(1999, 2, date(1999, 2, 1)), (2000, 12, date(2000, 12, 1))]


@pytest.mark.parametrize("grain", steps.GRAINS)
def test_steps_round_trip(spark, grain):
    stamps = ["1899-12-31 23:59:59", "1969-12-31 00:00:00", "1970-01-01 01:00:00", "2024-02-29 13:30:00"]
    df = spark.createDataFrame([(s,) for s in stamps], "s string").select(F.col("s").cast("timestamp_ntz").alias("t"))
    same = df.select(
        (steps.step_start(steps.step_number("t", grain), grain) == steps.truncate_to("t", grain)).alias("ok"),
        (F.date_trunc(grain, "t") == steps.truncate_to("t", grain).cast("timestamp_ntz").cast("timestamp")).alias("trunc"),
    ).collect()
    assert all(r.ok and r.trunc for r in same)


def test_nan_and_units(spark):
    df = spark.createDataFrame([(300.0, float("nan")), (None, 1.0)], "t double, x double")
    row = numbers.convert_units(df, {"t": (1.0, -273.15), "absent": (2.0, 0.0)}).collect()
    assert row[0].t == 300.0 - 273.15 and row[1].t is None
    assert [r[0] for r in df.select(numbers.nan_to_null("x")).collect()] == [None, 1.0]
    assert df.select(numbers.scale_round("t", 0.0001)).first()[0] == 0.03


def test_rounded_equals_round(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    whole = rng.integers(-(10**9), 10**9, 20_000)
    values = [*rng.uniform(-1, 1, 50_000), *(whole / 1e9), *((whole + 0.5) / 1e9), *np.nextafter((whole + 0.5) / 1e9, 2), *np.nextafter((whole + 0.5) / 1e9, -2)]
    values += [0.0, -0.0, 1.0, -1.0, 1e-12, -1e-12, 5e-10, -5e-10, 4.9999999999e-10, 0.1 + 0.2, 1e300, -123456789.123456789, 2.5, float("inf"), float("-inf")]
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    for digits in (9, 3, 0):
        rows = df.select(F.round("x", digits).alias("want"), numbers.rounded(F.col("x"), digits).alias("got")).collect()
        assert [repr(r.got) for r in rows] == [repr(r.want) for r in rows]
    assert spark.createDataFrame([(float("nan"),)], "x double").select(numbers.rounded(F.col("x"), 9)).collect()[0][0] != 0
