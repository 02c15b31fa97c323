import numpy as np
import pytest

from gridlens.operators import quantiles

PROBS = [i / 32 for i in range(33)]


def table(spark, missing=0.0):
    """Continuous, repeated and infinite values, nulls, a signed zero; NaN as the largest value on demand."""
    draw = np.random.default_rng(9)
    x = np.round(draw.normal(size=(900, 5)), 2)
    x[:, 1] = np.round(x[:, 1])
    x[draw.random(900) < missing, 2] = np.nan
    data = [[None if j == 3 and i % 7 == 0 else float(v) for j, v in enumerate(r)] for i, r in enumerate(x)]
    data[5] = [float("inf"), float("-inf"), -0.0, None, 0.0]
    return spark.createDataFrame(data, "a double, b double, c double, d double, e double").repartition(3)


def same(got, want):
    return got.keys() == want.keys() and all(np.array_equal(np.array(got[c]), np.array(want[c]), equal_nan=True) for c in want)


@pytest.mark.parametrize("missing", [0.0, 0.1])
@pytest.mark.parametrize("accuracy, limit", [(2000, 899), (50, 20)])  # one round, several rounds
def test_many_ranks_are_found_in_tasks(spark, monkeypatch, missing, accuracy, limit):
    df = table(spark, missing)
    want = quantiles.column_quantiles(df, df.columns, PROBS)

    def refused(*_):
        raise AssertionError("an expression per wanted rank is too long to compile")

    monkeypatch.setattr(quantiles, "_position", refused)
    monkeypatch.setattr(quantiles, "_ACCURACY", accuracy)
    assert same(quantiles.column_quantiles(df, df.columns, PROBS, limit=limit), want)


def test_few_ranks_with_missing_numbers(spark):
    df = table(spark, 0.1)
    want = quantiles.column_quantiles(df, ["c"], PROBS)
    assert same(quantiles.column_quantiles(df, ["c"], PROBS, limit=899), want)


def test_many_columns_dont_keep_all_values_in_one_task(spark, monkeypatch):
    x = np.random.default_rng(4).normal(size=(60, 12))
    df = spark.createDataFrame([[float(v) for v in r] for r in x], ", ".join(f"x{j} double" for j in range(12)))
    monkeypatch.setattr(quantiles.F, "percentile", lambda *_: pytest.fail("60 rows, but 720 values"))
    got = quantiles.column_quantiles(df, df.columns, PROBS, limit=60)
    assert all(np.allclose(got[f"x{j}"], np.quantile(x[:, j], PROBS), rtol=1e-12) for j in range(12))
