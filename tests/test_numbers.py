"""Numbers read tolerantly, exact integers in CSV files, and tails at large degrees of freedom."""

import math

import pytest
from pyspark.sql import functions as F

from siftwright.functions.numbers import tolerant
from siftwright.functions.tails import chi2_upper, normal_two_sided, t_two_sided
from siftwright.operators import report
from siftwright.operators.sparse_solve import least_p
from siftwright.sources import readers, writers


def test_tolerant_numbers(spark):
    texts = ["1", " 7 ", "-2.5e3", ".5", "3.", "inf", "-Infinity", "NaN", "nan", "12d", "5f", "0x1p3", "1,5", "", "abc", None]
    df = spark.createDataFrame([(i, t, float("nan") if i % 2 else float(i)) for i, t in enumerate(texts)], "i int, t string, d double")
    got = [r.v for r in df.select("i", tolerant(df, "t").alias("v")).orderBy("i").collect()]
    assert got == [1.0, 7.0, -2500.0, 0.5, 3.0, math.inf, -math.inf] + [None] * 9
    assert [r.v for r in df.select("i", tolerant(df, "d").alias("v")).orderBy("i").collect()] == [None if i % 2 else float(i) for i in range(len(texts))]


def test_long_integers_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,t\n9007199254740993001,"a\nb"\n9007199254740993002,"c ""d"""\n')
    rows = readers.read_csv(spark, str(tmp_path / "a.csv"), multiline=True).orderBy("id").collect()
    assert [(r.id, r.t) for r in rows] == [(9007199254740993001, "a\nb"), (9007199254740993002, 'c "d"')]


@pytest.mark.parametrize("stored", [True, False])
def test_associations_in_several_parts(spark, tmp_path, stored):
    pairs = spark.range(12).select(F.format_string("a%02d", "id").alias("var1"), F.lit("b").alias("var2"), F.lit(0.01).alias("p_value"), F.col("id").alias("pair_pos"))
    pairs = pairs.repartitionByRange(4, "var1")
    writers.write_csv(pairs if stored else pairs.drop("pair_pos"), str(tmp_path / "x"))
    rows = readers.read_associations(spark, str(tmp_path / "x"), "d").orderBy("pair_pos").collect()
    assert [r.pair_pos for r in rows] == list(range(12)) and [r.var1 for r in rows] == [f"a{i:02d}" for i in range(12)]


@pytest.mark.parametrize("df", [1e5, 9e5, 1.1e6, 1e8, 1e10])
def test_chi_square_tail_at_large_df(df):
    assert abs(chi2_upper(df - math.sqrt(2 * df), df) - 0.841344746) < 1e-5
    assert abs(chi2_upper(df, df) - 0.5) < 1e-3


def test_t_tail_at_large_dof():
    # the share itself is only known to 2**-53, times the degrees of freedom
    assert abs(t_two_sided(2e9 / (2e9 + 4), 2e9) - math.erfc(math.sqrt(2))) < 1e-8


def test_first_column_wins_among_equal_p():
    import numpy as np

    b, spread = np.array([9.0, 1.0, 5.0]), np.array([81.0, 1 / 2500, 25 / 8100])  # z of 1, 50 and 90: the last two have p = 0
    found = least_p(b, np.array([True] * 3), spread, lambda c: spread[c], lambda z2: normal_two_sided(math.sqrt(z2)), 1.0)
    assert found == (1, 0.0)


def test_missing_columns_per_dataset(spark):
    rows = [(d, f"c{i}", i, 0.5 if i % 2 else 0.25) for d in ("a", "b", "c") for i in range(24)]
    out = report.top_missing(spark.createDataFrame(rows, "dataset string, column string, position int, missing_rate double")).collect()
    assert sorted({r.dataset: 0 for r in out}) == ["a", "b", "c"] and len(out) == 60
    assert sum(r.missing_rate == 0.5 for r in out) == 36
