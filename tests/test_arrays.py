"""Factors by arrays against the same as window expressions, on rows with gaps, zeros and runs of equal values."""

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tapeloom.functions import arrays
from tapeloom.functions import factors as fx
from tapeloom.plans import registry

DATA = "/root/testdata/sf0.001"


def test_factors_of_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for code, n in ((1, 200), (2, 1), (3, 45), (None, 90)):
        for i in range(n):
            close = float(rng.integers(1, 8)) if code == 3 else 5.0 if 100 < i < 140 else float(rng.normal(50, 5))
            x = [close + 0.1, close + 1, close - 1, close, float(rng.integers(0, 3)), float(rng.integers(0, 4)) * 100]
            rows.append((code, dt.date(2020, 1, 1) + dt.timedelta(i), *(None if rng.random() < 0.01 else 0.0 if rng.random() < 0.003 else v for v in x)))
    rng.shuffle(rows)
    bars = spark.createDataFrame([(None if r[0] is None else int(r[0]), *r[1:]) for r in map(tuple, rows)], "code long, date date, open double, high double, low double, close double, volume double, amount double")
    monkeypatch.setattr(arrays, "CHUNK", 64)
    assert set(arrays.FACTORS) == set(fx.FACTORS)
    want = fx.enriched(bars).select("code", "date", *(f().alias(name) for name, (f, _) in fx.FACTORS.items()))
    order = [F.col("code").asc_nulls_first(), "date"]
    a, b = (x.orderBy(*order).toPandas() for x in (want, arrays.by_code(bars, arrays.FACTORS)))
    for c in fx.FACTORS:
        assert (a[c].isna() == b[c].isna()).all() and a[c].notna().any(), c
        assert np.allclose(a[c], b[c], rtol=1e-9, atol=1e-9, equal_nan=True), c


def test_no_moving_frames_over_the_bars(spark):
    """All factors, regimes and panels read a code's rows once, without an exchange before."""
    for name in ("c06_all_factors", "e03_trend_regime", "c11_orthogonal_factors"):
        text = registry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "specifiedwindowframe(rowframe, -" not in text.lower()
    assert "Exchange" not in registry.queries()["c06_all_factors"](spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_the_composite_makes_its_panel_once(spark):
    """Scores are written with the size; neither the panel is made again nor the bars joined."""
    text = registry.queries()["c12_orthogonal_composite"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "bars_" not in text and "REPARTITION_BY_NUM" in text
