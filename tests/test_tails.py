"""Tail probabilities against closed forms, enumeration and recorded values."""

import csv
import glob
import math
import time
from itertools import combinations

import pytest

from siftwright.functions import tails as t


@pytest.mark.parametrize("x", [0.1, 1.0, 5.0, 40.0, 900.0])
def test_chi_square_with_even_degrees_is_a_finite_sum(x):
    for half in (1, 2, 5):
        want = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))
        assert t.chi2_upper(x, 2 * half) == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("v", [0.2, 1.0, 3.5, 50.0])
def test_student_with_one_and_two_degrees(v):
    one = 1 - 2 * math.atan(v) / math.pi
    two = 1 - v / math.sqrt(2 + v * v)
    assert t.t_two_sided(1 / (1 + v * v), 1) == pytest.approx(one, rel=1e-10)
    assert t.t_two_sided(2 / (2 + v * v), 2) == pytest.approx(two, rel=1e-9)


def test_edges():
    assert t.r_p_value(1.0, 50) == 0.0
    assert t.r_p_value(0.0, 50) == 1.0
    assert math.isnan(t.r_p_value(float("nan"), 50))
    assert t.chi2_upper(0.0, 3) == 1.0
    assert t.normal_two_sided(1.959963984540054) == pytest.approx(0.05, rel=1e-12)
    assert t.u_two_sided(8.0, 4.0, 4.0, 60.0 * 8) <= 1.0


@pytest.mark.parametrize("n1,n2", [(3, 3), (5, 5), (4, 7), (8, 9)])
def test_exact_u_tail_matches_enumeration(n1, n2):
    us = [sum(c) - n1 * (n1 + 1) // 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(0, n1 * n2 + 1, 3):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(x >= top for x in us) / len(us))
        assert t.u_two_sided(u, n1, n2, 0.0) == pytest.approx(want, rel=1e-9)


def test_u_tail_is_normal_with_ties():
    n1 = n2 = 20.0
    spread = math.sqrt(n1 * n2 / 12 * (41 - 60.0 / (40 * 39)))
    want = math.erfc((250 - 200 - 0.5) / spread / math.sqrt(2))
    assert t.u_two_sided(150.0, n1, n2, 60.0) == pytest.approx(want, rel=1e-12)


def test_recorded_correlation_p_values(recorded):
    seen = 0
    for path in glob.glob(f"{recorded}/*/associations/*_all_associations_fdr.csv"):
        for row in csv.DictReader(open(path)):
            p = float(row["p_value"]) if row["p_value"] else 0.0
            if row["type"] == "num_num" and p > 1e-300:
                assert math.log(t.r_p_value(float(row["effect"]), float(row["n"]))) == pytest.approx(math.log(p), rel=1e-9, abs=1e-9)
                seen += 1
    assert seen > 200


def gaussian(n1, n2):
    """Ways to each U, by the recurrence over the larger sample."""
    ways = {0: [1]}
    for m in range(1, n1 + 1):
        ways[m] = [1]
    for n in range(1, n2 + 1):
        now = {0: [1]}
        for m in range(1, n1 + 1):
            out = [0] * (m * n + 1)
            for i, w in enumerate(ways[m]):
                out[i] += w
            for i, w in enumerate(now[m - 1]):
                out[i + n] += w
            now[m] = out
        ways = now
    return ways[n1]


@pytest.mark.parametrize("n1,n2", [(1, 1), (1, 60), (2, 31), (5, 40), (7, 8), (8, 8), (8, 70)])
def test_exact_u_tail_against_the_recurrence(n1, n2):
    ways = gaussian(n1, n2)
    for u in range(0, n1 * n2 + 1, 7):
        assert t._u_exact_upper(u, n1, n2) == pytest.approx(sum(ways[u:]) / sum(ways), rel=1e-14)


def test_exact_u_tail_of_eight_against_very_many():
    start = time.time()
    n2 = 10**9
    spread = math.sqrt(8 * n2 * (n2 + 9) / 12)
    p = t.u_two_sided(8 * n2 / 2 + 1.5 * spread, 8.0, float(n2), 0.0)
    assert time.time() - start < 1 and p == pytest.approx(math.erfc(1.5 / math.sqrt(2)), rel=0.05)
    assert t.u_two_sided(8.0 * n2, 8.0, float(n2), 0.0) == pytest.approx(2 * math.factorial(8) / float(n2) ** 8, rel=1e-6)
