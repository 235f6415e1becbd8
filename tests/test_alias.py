import numpy as np
import pytest
from graphs import EQUAL, NO_BIAS, STAR, ZERO_EDGE, graph
from hypothesis import given, settings
from hypothesis import strategies as st

from ambler.operators.alias import alias_row, build_alias_table, reconstruct


@given(st.lists(st.floats(0, 1e6), min_size=1, max_size=200).filter(lambda w: sum(w) > 1e-3))
@settings(max_examples=200, deadline=None)
def test_row_draws_in_proportion(weights):
    w = np.array(weights)
    prob, alias = alias_row(w)
    n = len(w)
    p = prob / n
    np.add.at(p, alias, (1 - prob) / n)
    assert np.allclose(p, w / w.sum(), atol=1e-9)
    assert ((prob >= -1e-12) & (prob <= 1)).all()


@pytest.mark.parametrize("edges, expected", [
    (STAR, {i: (0.5 if i < 35 else 2.0) / 27.5 for i in range(40)}),
    (ZERO_EDGE, {0: 0.25, 1: 0.75, 2: 0.0}),
    (EQUAL, {0: 0.5, 1: 0.5}),
])
def test_table_reconstructs_probabilities(spark, edges, expected):
    got = {r.pos: r.p for r in reconstruct(build_alias_table(graph(spark, edges))).collect()}
    assert set(got) == set(expected)
    assert all(abs(got[k] - p) < 1e-9 for k, p in expected.items())


def test_row_without_bias_is_invalid(spark):
    table = build_alias_table(graph(spark, NO_BIAS))
    assert [r.valid for r in table.collect()] == [False, False]
    assert reconstruct(table).count() == 0
