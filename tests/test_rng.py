import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ambler.functions import rng


def test_spark_numpy_and_sql_draw_alike(spark, duck):
    rows = spark.range(500).select(
        "id", *[rng.draw(F.col("id") * 7919, step, channel, 5).alias(f"c{step}_{channel}") for step in (0, 99) for channel in (0, 3)]
    )
    walker = np.arange(500) * 7919
    found = {c: [r[c] for r in rows.orderBy("id").collect()] for c in rows.columns}
    for step in (0, 99):
        for channel in (0, 3):
            assert found[f"c{step}_{channel}"] == rng.draw_numpy(walker, step, channel, 5).tolist()
            sql = rng.draw_sql("i * 7919", str(step), channel, 5)
            told = duck.execute(f"select {sql} from range(500) t(i) order by i").fetchall()
            assert found[f"c{step}_{channel}"] == [x for (x,) in told]


@given(st.integers(0, rng.MAX_WALKER), st.integers(0, 10_000), st.sampled_from(list(rng.Channel)))
def test_draws_stay_in_range(walker, step, channel):
    h = int(rng.draw_numpy(np.array([walker]), step, channel)[0])
    assert 0 <= h < rng.M


def test_draws_are_uniform_and_uncorrelated():
    h = np.stack([rng.draw_numpy(np.arange(20_000), t, 0) for t in range(8)]) / rng.M
    assert abs(h.mean() - 0.5) < 0.005
    for x in h:
        counts = np.bincount((x * 16).astype(int), minlength=16)
        assert ((counts - 1250) ** 2 / 1250).sum() < 45
    assert np.abs(np.corrcoef(h) - np.eye(8)).max() < 0.03
    coin = rng.draw_numpy(np.arange(20_000), 0, rng.Channel.COIN) / rng.M
    assert abs(np.corrcoef(h[0], coin)[0, 1]) < 0.03
