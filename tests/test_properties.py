"""Randomised properties (hypothesis) of the draws operators vs brute force."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from traitlab.operators import draws as D

VALUES = st.lists(st.floats(min_value=-50, max_value=50, allow_nan=False, allow_infinity=False).map(
    lambda v: round(v, 1)), min_size=3, max_size=60)


def _df(spark, vals):
    rows = [("m", i % 2, i // 2 + 1, "a", float(v)) for i, v in enumerate(vals)]
    return spark.createDataFrame(rows, "model string, chain int, iter long, par string, value double")


@settings(max_examples=6, deadline=None)
@given(VALUES)
def test_tail_p_in_unit_interval_and_brute_force(spark, vals):
    p = D.tail_p(_df(spark, vals)).first().p
    v = np.array(vals)
    m = np.median(v)
    ref = 2 * (1 - np.mean(v > 0)) if m > 0 else 2 * (1 - np.mean(v < 0))
    assert p == pytest.approx(ref, abs=1e-12)
    assert -1e-12 <= p <= 2.0          # zeros count toward neither sign, so p may exceed 1
    if not np.any(v == 0):
        assert p <= 1.0 + 1e-12


@settings(max_examples=6, deadline=None)
@given(VALUES)
def test_hpd_brute_force_and_coverage(spark, vals):
    r = D.hpd_interval(_df(spark, vals)).first()
    s = np.sort(np.array(vals))
    n = len(s)
    k = math.floor(0.95 * n)
    widths = s[k:] - s[:n - k]
    i = int(np.argmin(widths))
    assert (r.lower, r.upper) == (s[i], s[i + k])
    assert np.sum((s >= r.lower) & (s <= r.upper)) >= k + 1
