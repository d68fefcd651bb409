"""Frames found in chunks against the same worked out in one piece."""

import numpy as np

from pagestream.functions.specs import MODES
from pagestream.operators import acquire as A


def test_correlation_is_the_sliding_product():
    r = np.random.default_rng(3)
    x, t = r.normal(size=300), A.template(MODES[1][1], 1)
    want = [x[i : i + 64] @ t / np.sqrt((x[i : i + 64] ** 2).sum() * 64) for i in range(300 - 63)]
    assert np.allclose(A.correlation(x, t), want)
    assert len(A.correlation(x[:60], t)) == 0


def test_frames_on_the_grid(spark):
    period, spb, chunk, to_data, symbols = 900, 2, 512, 150.0, 100
    r = np.random.default_rng(5)
    rows, planted = [], {}
    for carrier, mode, first in ((1, 2, 37), (2, 0, 511)):
        x = 0.4 * r.normal(size=6000)
        sync = A.template(MODES[mode][1], spb)
        slots = [k for k in range(6) if k != 3]  # one slot holds no sync
        for k in slots:
            x[first + k * period : first + k * period + len(sync)] += sync
        rows += [(carrier, i, float(v)) for i, v in enumerate(x)]
        baud = MODES[mode][2]
        n, step = baud * symbols // 1000 + 2, int(1600 / baud * spb)
        planted[carrier] = [(k, mode, first + k * period + 150) for k in slots if first + k * period + 150 + n * step < 5999]
    samples = spark.createDataFrame(rows, "carrier long, n long, x double")
    got = A.frames(samples, spb=spb, period=period, to_data=to_data, symbols=symbols, chunk=chunk).orderBy("carrier", "k").collect()
    for carrier, want in planted.items():
        mine = [(f.k, f.mode, f.p0) for f in got if f.carrier == carrier]
        assert [m[:2] for m in mine] == [w[:2] for w in want]
        assert all(abs(m[2] - w[2]) <= 1 for m, w in zip(mine, want))  # the phase is a mean of peaks
    assert A.frames(samples.where("n < 0"), spb=spb, period=period, chunk=chunk).count() == 0
