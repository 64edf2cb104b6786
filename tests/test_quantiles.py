import numpy as np
from pyspark.sql import functions as F

from larder.functions.clock import parsed_date
from larder.operators import quantiles
from larder.operators.quantiles import described_columns, exact_quantiles

PROBS = {"q25": 0.25, "q50": 0.5, "q75": 0.75, "q0": 0.0, "q100": 1.0}


def values_moved(spark, columns, n):
    """Rows of the widest shuffle that numbers of ``n`` rows take, told by the counted values that meet their positions."""
    df = spark.range(n).select(*[F.pmod(F.xxhash64("id", F.lit(c)), F.lit(10**9)).cast("double").alias(c) for c in columns])
    seen = []
    old = quantiles._at_positions

    def counted(counts, positions, probs):
        seen.append(counts.count())
        return old(counts, positions, probs)

    quantiles._at_positions = counted
    try:
        return df, described_columns(df, columns, PROBS).collect(), seen[0]
    finally:
        quantiles._at_positions = old


def test_only_values_beside_a_position_are_moved(spark):
    """Distinct values by the hundred thousand, of which a few hundredths are counted; the quantiles are exact."""
    df, got, moved = values_moved(spark, ["a", "b"], 200_000)
    assert 0 < moved < 0.05 * 2 * 200_000
    for r in got:
        values = [x[0] for x in df.select(r.column).collect()]
        for name, p in PROBS.items():
            assert abs(r[name] - np.quantile(values, p)) < 1e-6
        assert (r.n, r.min, r.max) == (len(values), min(values), max(values))
        assert abs(r.std / np.std(values, ddof=1) - 1) < 1e-9 and abs(r.mean / np.mean(values) - 1) < 1e-9


def test_columns_of_shared_odd_and_missing_values(spark):
    """Infinities, NaN, one value in all rows, minus zero, and columns without values, which have no row."""
    inf, nan = float("inf"), float("nan")
    data = [(5.0, inf if i % 3 == 0 else float(i), nan if i % 2 else float(i), None, -0.0) for i in range(9000)]
    df = spark.createDataFrame(data, "same double, far double, odd double, none double, zero double").repartition(3)
    got = {r.column: r for r in described_columns(df, df.columns, {"q25": 0.25, "q50": 0.5}).collect()}
    assert set(got) == {"same", "far", "odd", "zero"}
    assert (got["same"].n, got["same"].q25, got["same"].q50, got["same"].std) == (9000, 5.0, 5.0, 0.0)
    far = sorted(x[1] for x in data)
    assert got["far"].q25 == far[2249] + (far[2250] - far[2249]) * 0.75 and got["far"].max == inf
    assert got["odd"].q25 == 4499.5 and got["odd"].n == 9000 and np.isnan(got["odd"].max)
    assert str(got["zero"].min) == "0.0"
    assert described_columns(df.limit(0), ["same"], {"q25": 0.25}).collect() == []


def test_a_bad_sketch_costs_rows_and_no_exactness(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BESIDE", -0.3)
    df = spark.createDataFrame([(i % 3, float(i * 37 % 9001)) for i in range(9001)], "k int, v double")
    for row in exact_quantiles(df, ["k"], "v", PROBS, 50).collect():
        values = [float(i * 37 % 9001) for i in range(9001) if i % 3 == row.k]
        assert all(abs(row[q] - np.quantile(values, p)) < 1e-9 for q, p in PROBS.items())
    row = described_columns(df, ["v"], PROBS).first()
    assert all(abs(row[q] - np.quantile(range(9001), p)) < 1e-9 for q, p in PROBS.items())


def test_dates_are_read_as_by_the_pattern(spark):
    texts = ["1998-09-02", "1998-9-2", "1998-02-30", "0000-01-01", "9999-12-31", "19980902", " 1998-09-02", "1998-09-02\n", "1998-09-2 ",
             "1998-13-01", "+998-01-01", "98-01-01", "2000-02-29", "1900-02-29", "1998-09-02T", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", parsed_date(F.col("t")).cast("string").alias("a"), F.try_to_date("t", "yyyy-M-d").cast("string").alias("b")).collect()
    assert all(r.a == r.b for r in got) and sum(r.a is not None for r in got) >= 5
    assert df.select(parsed_date(F.col("t"), "yyyyMMdd").alias("a")).filter("a is not null").count() == 1
