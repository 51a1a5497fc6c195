"""Statistics in numpy: regression tests for unit roots, distributions, copulas and hidden Markov models.

There is no statistics library at run time, so the special functions are here, each by its textbook series.
"""

from __future__ import annotations

import math

import numpy as np

# Response-surface coefficients for p-values of Dickey-Fuller and Engle-Granger statistics with a constant,
# for N = 1 and 2 variables (MacKinnon 1994): smallest and largest statistic, turning point, and the polynomials of the
# lower and upper part.
MACKINNON = {
    1: {"max": 2.74, "min": -18.83, "star": -1.61, "small": (2.1659, 1.4412, 0.038269), "large": (1.7339, 0.93202, -0.12745, -0.010368)},
    2: {"max": 0.92, "min": -18.86, "star": -2.62, "small": (2.92, 1.5012, 0.039796), "large": (2.1945, 0.64695, -0.29198, -0.042377)},
}


def normal_cdf(x: np.ndarray | float) -> np.ndarray:
    return 0.5 * (1 + np.vectorize(math.erf, otypes=[float])(np.asarray(x, float) / math.sqrt(2)))


def normal_quantile(p: np.ndarray | float) -> np.ndarray:
    """By bisection and Newton steps on the distribution function."""
    p = np.clip(np.asarray(p, float), 1e-300, 1 - 1e-16)
    lo, hi = np.full(p.shape, -40.0), np.full(p.shape, 40.0)
    for _ in range(80):
        mid = (lo + hi) / 2
        low = normal_cdf(mid) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def p_value(t: float, variables: int = 1) -> float:
    """MacKinnon's approximate p-value of a unit-root statistic."""
    c = MACKINNON[variables]
    if t > c["max"]:
        return 1.0
    if t < c["min"]:
        return 0.0
    poly = c["small"] if t <= c["star"] else c["large"]
    return float(normal_cdf(sum(k * t**i for i, k in enumerate(poly))))


def ols(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Coefficients, their standard errors, and the residual sum of squares."""
    q, r = np.linalg.qr(x)
    b = np.linalg.solve(r, q.T @ y)
    e = y - x @ b
    rss = float(e @ e)
    inv = np.linalg.inv(r)
    return b, np.sqrt(np.maximum((inv * inv).sum(1) * rss / max(1, len(y) - x.shape[1]), 0)), rss


def adf(y: np.ndarray, max_lag: int | None = None, constant: bool = True, variables: int = 1) -> tuple[float, float, int]:
    """Statistic, p-value and lag of the augmented Dickey-Fuller test; the lag has the least AIC on a common sample."""
    y = np.asarray(y, float)
    n = len(y)
    if n < 12 or np.ptp(y) == 0:
        return math.nan, math.nan, 0
    k = min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2) if max_lag is None else max_lag
    k = max(0, k)
    d = np.diff(y)

    def design(lag: int, start: int) -> tuple[np.ndarray, np.ndarray]:
        cols = [y[start:-1], *(d[start - i : -i] for i in range(1, lag + 1))]
        if constant:
            cols.append(np.ones(len(d) - start))
        return d[start:], np.column_stack(cols)

    best, lag = math.inf, 0
    try:
        for p in range(k + 1):
            z, x = design(p, k)
            _, _, rss = ols(z, x)
            aic = len(z) * math.log(max(rss, 1e-300) / len(z)) + 2 * x.shape[1]
            if aic < best:
                best, lag = aic, p
        z, x = design(lag, lag)
        b, se, _ = ols(z, x)
    except np.linalg.LinAlgError:
        return math.nan, math.nan, 0
    t = float(b[0] / se[0]) if se[0] > 0 else math.nan
    return t, p_value(t, variables) if math.isfinite(t) else math.nan, lag


def engle_granger(y: np.ndarray, x: np.ndarray) -> tuple[float, float, float]:
    """Statistic, p-value and hedge ratio: Dickey-Fuller without a constant on the residuals of y on x and a constant."""
    if len(y) < 20 or np.ptp(x) == 0 or np.ptp(y) == 0:
        return math.nan, math.nan, math.nan
    b, _, _ = ols(y, np.column_stack([x, np.ones(len(x))]))
    t, _, _ = adf(y - x * b[0] - b[1], constant=False, variables=2)
    return t, p_value(t, 2) if math.isfinite(t) else math.nan, float(b[0])


def beta_inc(a: float, b: float, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function of every x: Lentz's continued fraction on the side where it converges fast."""
    x = np.asarray(x, float)
    flip = x > (a + 1) / (a + b + 2)
    p, q = np.where(flip, b, a), np.where(flip, a, b)
    y = np.clip(np.where(flip, 1 - x, x), 1e-300, 1 - 1e-16)
    front = np.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + p * np.log(y) + q * np.log1p(-y)) / p
    safe = lambda v: np.where(np.abs(v) < 1e-300, 1e-300, v)
    c, d = np.ones_like(y), 1 / safe(1 - (p + q) * y / (p + 1))
    h = d.copy()
    for m in range(1, 300):
        for k in (m * (q - m) / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) / ((p + 2 * m) * (p + 2 * m + 1))):
            d, c = 1 / safe(1 + k * y * d), safe(1 + k * y / c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-15):
            break
    out = np.where(flip, 1 - front * h, front * h)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_cdf(x: np.ndarray, df: float, loc: float = 0.0, scale: float = 1.0) -> np.ndarray:
    """Student's t distribution function, whole arrays at once; NaN stays NaN."""
    z = (np.asarray(x, float) - loc) / scale
    tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + z * z))
    return np.where(np.isnan(z), np.nan, np.where(z > 0, 1 - tail, tail))


def t_quantile(p: np.ndarray, df: float) -> np.ndarray:
    p = np.asarray(p, float)
    lo, hi = np.full(p.shape, -1e4), np.full(p.shape, 1e4)
    for _ in range(70):
        mid = (lo + hi) / 2
        low = t_cdf(mid, df) < p
        lo, hi = np.where(low, mid, lo), np.where(low, hi, mid)
    return (lo + hi) / 2


def t_loglik(x: np.ndarray, df: float, loc: float, scale: float) -> float:
    z = (x - loc) / scale
    c = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - 0.5 * math.log(df * math.pi) - math.log(scale)
    return float(len(x) * c - (df + 1) / 2 * np.log1p(z * z / df).sum())


def fit_t(x: np.ndarray, steps: int = 200) -> tuple[float, float, float]:
    """Degrees of freedom, location and scale by maximum likelihood: EM for the last two, a golden search for the first."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    if len(x) < 5 or np.ptp(x) == 0:
        return math.nan, math.nan, math.nan

    def given(df: float, loc: float, scale: float) -> tuple[float, float]:
        for _ in range(steps):
            w = (df + 1) / (df + ((x - loc) / scale) ** 2)
            m = float((w * x).sum() / w.sum())
            s = float(math.sqrt((w * (x - m) ** 2).mean()))
            done = abs(m - loc) < 1e-10 * (1 + abs(m)) and abs(s - scale) < 1e-10 * s
            loc, scale = m, max(s, 1e-12)
            if done:
                break
        return loc, scale

    start = float(np.median(x)), float(x.std() or 1.0)
    value = lambda u: t_loglik(x, math.exp(u), *given(math.exp(u), *start))
    lo, hi = math.log(0.5), math.log(200.0)
    g = (math.sqrt(5) - 1) / 2
    a, b = hi - g * (hi - lo), lo + g * (hi - lo)
    fa, fb = value(a), value(b)
    for _ in range(40):
        if fa > fb:
            hi, b, fb = b, a, fa
            a = hi - g * (hi - lo)
            fa = value(a)
        else:
            lo, a, fa = a, b, fb
            b = lo + g * (hi - lo)
            fb = value(b)
    df = math.exp((lo + hi) / 2)
    return df, *given(df, *start)


def ks(u: np.ndarray) -> tuple[float, float]:
    """Kolmogorov-Smirnov distance of u from uniform, and its asymptotic p-value."""
    u = np.sort(np.asarray(u, float))
    n = len(u)
    if not n:
        return math.nan, math.nan
    i = np.arange(1, n + 1)
    d = float(max((i / n - u).max(), (u - (i - 1) / n).max()))
    z = (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)) * d
    k = np.arange(1, 101)
    return d, float(np.clip(2 * ((-1.0) ** (k - 1) * np.exp(-2 * k * k * z * z)).sum(), 0, 1)) if z > 0.2 else 1.0


def tawn_a(w: np.ndarray, theta: float, psi: float) -> np.ndarray:
    """Pickands function of the type-1 Tawn copula: (1 - psi)(1 - w) + ((1 - w)^theta psi^theta + w^theta)^(1 / theta)."""
    return (1 - psi) * (1 - w) + ((psi * (1 - w)) ** theta + w**theta) ** (1 / theta)


def tawn_cdf(u: np.ndarray, v: np.ndarray, theta: float, psi: float) -> np.ndarray:
    """C(u, v) = exp(log(uv) A(log v / log uv))."""
    lu, lv = np.log(np.clip(u, 1e-10, 1 - 1e-10)), np.log(np.clip(v, 1e-10, 1 - 1e-10))
    return np.exp((lu + lv) * tawn_a(lv / (lu + lv), theta, psi))


def tawn_h(u: np.ndarray, v: np.ndarray, theta: float, psi: float, step: float = 1e-5) -> tuple[np.ndarray, np.ndarray]:
    """Mispricing indices: the numeric partial derivatives of C by v and by u, P(U <= u | v) and P(V <= v | u)."""
    u, v = np.clip(u, 2 * step, 1 - 2 * step), np.clip(v, 2 * step, 1 - 2 * step)
    h1 = (tawn_cdf(u, v + step, theta, psi) - tawn_cdf(u, v - step, theta, psi)) / (2 * step)
    h2 = (tawn_cdf(u + step, v, theta, psi) - tawn_cdf(u - step, v, theta, psi)) / (2 * step)
    return np.clip(h1, 0, 1), np.clip(h2, 0, 1)


def tawn_density(u: np.ndarray, v: np.ndarray, theta: float, psi: float, step: float = 1e-4) -> np.ndarray:
    u, v = np.clip(u, 2 * step, 1 - 2 * step), np.clip(v, 2 * step, 1 - 2 * step)
    c = lambda a, b: tawn_cdf(a, b, theta, psi)
    return np.maximum((c(u + step, v + step) - c(u + step, v - step) - c(u - step, v + step) + c(u - step, v - step)) / (4 * step * step), 1e-12)


def fit_tawn(u: np.ndarray, v: np.ndarray) -> tuple[float, float, float]:
    """Theta (1 to 15), psi (0 to 1) and log-likelihood, by a grid that is refined around its best point."""
    lo, hi, best = np.array([1.0, 0.01]), np.array([15.0, 0.99]), (-math.inf, 1.0, 0.5)
    for _ in range(5):
        for t in np.linspace(lo[0], hi[0], 9):
            for p in np.linspace(lo[1], hi[1], 9):
                ll = float(np.log(tawn_density(u, v, t, p)).sum())
                if ll > best[0]:
                    best = ll, float(t), float(p)
        span = (hi - lo) / 5
        at = np.array(best[1:])
        lo, hi = np.maximum(at - span, [1.0, 0.0]), np.minimum(at + span, [15.0, 1.0])
    return best[1], best[2], best[0]


def empirical_copula(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The share of points with both coordinates no larger, for each point; by sorting and a Fenwick tree."""
    n = len(u)
    rank = np.searchsorted(np.sort(v), v, side="right")
    order, tree, out = np.argsort(u, kind="stable"), np.zeros(n + 1, np.int64), np.zeros(n)
    i = 0
    while i < n:
        j = i
        while j < n and u[order[j]] == u[order[i]]:  # ties in u count for each other
            r = rank[order[j]]
            while r <= n:
                tree[r] += 1
                r += r & -r
            j += 1
        for k in range(i, j):
            r, s = rank[order[k]], 0
            while r > 0:
                s += tree[r]
                r -= r & -r
            out[order[k]] = s / n
        i = j
    return out


def cramer_von_mises(u: np.ndarray, v: np.ndarray, theta: float, psi: float) -> float:
    """Sum of squared distances of the empirical from the fitted copula."""
    return float(((empirical_copula(u, v) - tawn_cdf(u, v, theta, psi)) ** 2).sum())


def conditional_gaussian(u: np.ndarray, v: np.ndarray, rho: float) -> np.ndarray:
    """P(U <= u | V = v) under a Gaussian copula."""
    return normal_cdf((normal_quantile(u) - rho * normal_quantile(v)) / math.sqrt(max(1e-12, 1 - rho * rho)))


def conditional_t(u: np.ndarray, v: np.ndarray, rho: float, df: float) -> np.ndarray:
    """P(U <= u | V = v) under a t copula."""
    x, y = t_quantile(u, df), t_quantile(v, df)
    return t_cdf((x - rho * y) * np.sqrt((df + 1) / ((df + y * y) * max(1e-12, 1 - rho * rho))), df + 1)


def hmm(x: np.ndarray, states: int = 3, steps: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Most likely states (0: lowest mean), means and deviations of a Gaussian hidden Markov model.

    Baum-Welch from quantile starts, a fixed number of steps, then Viterbi.
    """
    x = np.asarray(x, float)
    n = len(x)
    if n < 2 * states or np.ptp(x) == 0:
        return np.zeros(n, int), np.full(states, x.mean() if n else 0.0), np.zeros(states)
    cut = np.quantile(x, np.linspace(0, 1, states + 1))
    mu = np.array([x[(x >= cut[i]) & (x <= cut[i + 1])].mean() for i in range(states)])
    sd = np.full(states, x.std() + 1e-12)
    trans, start = np.full((states, states), 0.1 / max(1, states - 1)), np.full(states, 1 / states)
    np.fill_diagonal(trans, 0.9 if states > 1 else 1.0)
    floor = 1e-3 * x.std() + 1e-12
    for _ in range(steps):
        log_b = -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd)
        b = np.exp(log_b - log_b.max(1, keepdims=True))
        a, c = np.zeros((n, states)), np.zeros(n)
        a[0] = start * b[0]
        c[0] = a[0].sum()
        a[0] /= c[0]
        for t in range(1, n):
            a[t] = (a[t - 1] @ trans) * b[t]
            c[t] = a[t].sum()
            a[t] /= c[t]
        back = np.ones((n, states))
        for t in range(n - 2, -1, -1):
            back[t] = trans @ (b[t + 1] * back[t + 1]) / c[t + 1]
        g = a * back
        g /= g.sum(1, keepdims=True)
        xi = trans * (a[:-1].T @ (b[1:] * back[1:] / c[1:, None]))
        trans = xi / xi.sum(1, keepdims=True)
        start, w = g[0], g.sum(0) + 1e-12
        mu = (g * x[:, None]).sum(0) / w
        sd = np.maximum(np.sqrt((g * (x[:, None] - mu) ** 2).sum(0) / w), floor)
    order = np.argsort(mu, kind="stable")
    mu, sd, trans, start = mu[order], sd[order], trans[np.ix_(order, order)], start[order]
    log_b, log_t = -0.5 * ((x[:, None] - mu) / sd) ** 2 - np.log(sd), np.log(trans + 1e-300)
    v, came = np.log(start + 1e-300) + log_b[0], np.zeros((n, states), int)
    for t in range(1, n):
        s = v[:, None] + log_t
        came[t] = s.argmax(0)
        v = s.max(0) + log_b[t]
    path = np.zeros(n, int)
    path[-1] = int(v.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path, mu, sd
