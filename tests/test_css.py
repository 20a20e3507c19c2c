import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.operators import arima as ar
from seriesloom.operators import css
from seriesloom.operators import splits


def plain_errors(w, first, p, q, sp, sq, s, theta, constant):
    """Residuals one at a time, from the factors of the polynomials."""
    phi, th = theta[:p], theta[p : p + q]
    big = theta[p + q] if sp else 0.0
    big_th = theta[p + q + sp] if sq else 0.0
    c = theta[-1] if constant else 0.0
    e = np.zeros(len(w))

    def ar_part(t):
        return w[t] - sum(phi[i] * w[t - 1 - i] for i in range(p))

    def ma_part(t):
        return sum(th[i] * e[t - 1 - i] for i in range(q) if t - 1 - i >= 0)

    for t in range(first, len(w)):
        value = ar_part(t) - (big * ar_part(t - s) if sp else 0.0) - c
        seasonal = big_th * (e[t - s] + ma_part(t - s)) if sq and t - s >= 0 else 0.0
        e[t] = value - ma_part(t) - seasonal
    return e


def plain_fit(w, first, p, q, sp, sq, s, constant, start):
    """Gauss-Newton with halved steps."""
    theta = np.array(start, float)

    def err(x):
        return plain_errors(w, first, p, q, sp, sq, s, x, constant)

    for _ in range(200):
        e = err(theta)
        jac = np.array([(err(theta + d) - err(theta - d)) / 2e-6 for d in np.eye(len(theta)) * 1e-6]).T
        shift = np.linalg.lstsq(jac, -e, rcond=None)[0]
        rate = 1.0
        while rate > 1e-6 and not (np.isfinite(x := (err(theta + rate * shift) ** 2).sum()) and x <= (e**2).sum()):
            rate /= 2
        theta = theta + rate * shift
        if np.abs(shift).max() < 1e-10:
            break
    return theta


def fitted(w, first, orders, constant):
    """Fits of several orders, with the parameters that each one has."""
    found = css.fit_orders(w, np.array(first), orders, 12, constant)
    used = css.Layout(orders, 12, constant).used
    return [(theta[u], status, sse) for (theta, status, sse), u in zip(found, used, strict=True)]


def simulated(seed, n=240):
    rnd = np.random.default_rng(seed)
    e = rnd.normal(size=n + 24)
    w = np.zeros(n + 24)
    for t in range(13, n + 24):
        w[t] = 0.5 * w[t - 1] + 0.4 * w[t - 12] - 0.2 * w[t - 13] + e[t] + 0.3 * e[t - 1]
    return w[24:]


@pytest.mark.parametrize("order", [(1, 1, 1, 0), (2, 1, 0, 1), (1, 0, 0, 0), (0, 1, 1, 1), (2, 2, 0, 0)])
@pytest.mark.parametrize("constant", [False, True])
def test_equals_a_plain_fit(order, constant):
    p, q, sp, sq = order
    w = simulated(sum(order)) + (3.0 if constant else 0.0)
    first = p + 12 * sp
    shape = {"p": p, "q": q, "sp": sp, "sq": sq}
    others = [{"p": 0, "q": 1, "sp": 1, "sq": 0}, {"p": 2, "q": 1, "sp": 0, "sq": 1}]
    theta, status, sse = fitted(w, [13, first, 2], [others[0], shape, others[1]], constant)[1]
    if status == "ok":
        want = plain_fit(w, first, p, q, sp, sq, 12, constant, theta * 0.9 + 0.01)
        assert theta == pytest.approx(want, abs=1e-6)
        assert sse == pytest.approx((plain_errors(w, first, p, q, sp, sq, 12, want, constant) ** 2).sum(), rel=1e-9)
    else:
        assert order == (2, 2, 0, 0)  # two common factors: no single best fit


def test_weights_of_a_known_process():
    theta, status, _ = fitted(simulated(3, 3000), [13], [{"p": 1, "q": 1, "sp": 1, "sq": 0}], False)[0]
    assert status == "ok" and theta == pytest.approx([0.5, 0.3, 0.4], abs=0.06)


def test_roots_inside_the_circle_are_refused():
    w = 1.05 ** np.arange(80.0) + np.random.default_rng(1).normal(size=80) * 0.01
    assert fitted(w, [1], [{"p": 1, "q": 0, "sp": 0, "sq": 0}], False)[0][1] == "not stationary"
    assert css._stable(np.array([0.5])) and not css._stable(np.array([1.0])) and not css._stable(np.array([0.6, 0.6]))


def test_grid_drops_what_does_not_converge(spark):
    rnd = random.Random(2)
    rows = [(m, i, 100 + 0.5 * i + 8 * np.sin(i / 12 * 2 * np.pi) + rnd.gauss(0, 1 + k)) for k, m in enumerate("ab") for i in range(84)]
    df = splits.three_way(spark.createDataFrame([(m, i, float(v)) for m, i, v in rows], "member string, ts int, total double"), "member", "ts")
    fits = ar.fit_grid(df, "member", "ts", "total", F.col("split") == "TRAIN", ar.seasonal_grid(), split="split", method="css").collect()
    assert len(fits) == 2 * 216
    kept = [r for r in fits if r.status == "ok"]
    assert 100 < len(kept) < len(fits)
    for r in kept:
        first = r.p + r.d + 12 * (r.sp + r.sd)
        assert np.isnan(r.predicted[:first]).all() and np.isfinite(r.predicted[first:]).all() and r.val_rmse is not None
    assert all(r.predicted is None and r.aic is None for r in fits if r.status != "ok")


def test_forecast_continues_the_recursion():
    y = np.cumsum(simulated(5, 150))
    grid = ar.Grid(p=(1,), d=(1,), q=(1,), sp=(1,), season=12)
    row = css.fit_variant(y, 120, grid, grid.variants()[0], extra=5)[0]
    assert row["status"] == "ok"
    c, phi, th, big = row["beta"]
    w = np.diff(y[:120])
    e = plain_errors(w, 13, 1, 1, 1, 0, 12, np.array([phi, th, big]), False)
    ws, es, ys = list(w), list(e), list(y[:120])
    for _ in range(35):
        ws.append(phi * ws[-1] + big * ws[-12] - phi * big * ws[-13] + th * es[-1])
        es.append(0.0)
        ys.append(ys[-1] + ws[-1])
    assert row["predicted"][120:] == pytest.approx(ys[120:])
    assert row["predicted"][14:120] == pytest.approx(y[14:120] - e[13:])
