"""Seasonal ARIMA by likelihood, many parameter vectors at a time.

The model is (p, d, q)(s, s, s) with a weekly season: differenced values minus their mean follow the product of a plain
and a weekly autoregressive and moving-average polynomial. The likelihood comes from a Kalman filter that runs over the days once
for all orders, starts and trial steps of a differencing together; where the filter has settled, only its innovations go on. Orders
are compared and forecasts made with the exact filter; while parameters are sought, its gain is held after ``FROZEN`` days. Scaled
innovations make the likelihood a sum of squares, which damped least-squares steps lower from a grid of starts.
Parameters move freely: partial correlations tanh(u) keep the polynomials stationary and invertible.
"""

from __future__ import annotations

import numpy as np

WEEK = 7
#: First values of (autoregressive, moving-average) parameters.
STARTS = ((0.0, 0.0), (0.5, -0.5), (-0.4, 0.2))
ROUNDS, ALL_STARTS, SETTLED = 14, 4, 1e-10
#: Days after which the filter's gain stays fixed while parameters are sought.
FROZEN = 90
DAMPING = (1e-3, 1e-1, 10.0)


def difference(y: np.ndarray, d: int, s: int) -> np.ndarray:
    z = y[WEEK:] - y[:-WEEK] if s else y
    return np.diff(z, n=d) if d else z


def polynomial(u: np.ndarray) -> np.ndarray:
    """Coefficients of stationary polynomials from free numbers (rows x order), by the Durbin-Levinson steps over partial correlations."""
    r = np.tanh(u)
    out = np.zeros_like(r)
    for k in range(r.shape[1]):
        before = out[:, :k].copy()
        out[:, :k] = before - r[:, k:k + 1] * before[:, ::-1]
        out[:, k] = r[:, k]
    return out


class Orders:
    """The free parameters of several orders (p, q) with the same season, laid out alike: AR, MA, weekly AR, weekly MA."""

    def __init__(self, p: np.ndarray, q: np.ndarray, s: int):
        self.p, self.q, self.s = np.asarray(p), np.asarray(q), s
        self.most_p, self.most_q = int(self.p.max(initial=0)), int(self.q.max(initial=0))
        self.size = self.most_p + self.most_q + 2 * s
        used = [np.arange(self.most_p) < self.p[:, None], np.arange(self.most_q) < self.q[:, None], np.full((len(self.p), 2 * s), True)]
        self.used = np.concatenate(used, axis=1)

    def lags(self, u: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """AR and MA coefficients by lag for parameter rows ``u`` of the orders ``at``."""
        u = np.where(self.used[at], u, 0.0)
        a, b = self.most_p, self.most_p + self.most_q
        ar, ma = self._filled(u[:, :a], self.p[at]), -self._filled(u[:, a:b], self.q[at])
        if not self.s:
            return ar, ma
        big_ar, big_ma = np.tanh(u[:, b:b + 1]), -np.tanh(u[:, b + 1:b + 2])
        return self._times(ar, big_ar, -1.0), self._times(ma, big_ma, 1.0)

    @staticmethod
    def _filled(u: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Polynomials of mixed order: those of a lower order have zeros beyond it."""
        out = np.zeros_like(u)
        for k in range(1, u.shape[1] + 1):
            rows = order == k
            out[rows, :k] = polynomial(u[rows, :k])
        return out

    @staticmethod
    def _times(small: np.ndarray, big: np.ndarray, sign: float) -> np.ndarray:
        """Lags of (1 + small)(1 + big B^7), where autoregressive parts carry the opposite sign."""
        out = np.zeros((len(small), WEEK + small.shape[1]))
        out[:, :small.shape[1]] += small
        out[:, WEEK - 1:WEEK] += big
        out[:, WEEK:] += sign * small * big
        return out


def innovations(z: np.ndarray, ar: np.ndarray, ma: np.ndarray, days: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One-step errors and their relative variances (rows x days) of each model over ``z``, and the last state. Kalman filter
    in Harvey's form; a model's gain stays as it is once it has settled, or after ``days`` days."""
    b, n = len(ar), len(z)
    r = max(ar.shape[1], ma.shape[1] + 1)
    phi, rho = np.zeros((b, r)), np.zeros((b, r))
    phi[:, :ar.shape[1]] = ar
    rho[:, 0], rho[:, 1:ma.shape[1] + 1] = 1.0, ma
    step = np.zeros((b, r, r))
    step[:, :, 0] = phi
    step[:, np.arange(r - 1), np.arange(1, r)] = 1.0
    noise = rho[:, :, None] * rho[:, None, :]
    cov = _stationary(step, noise)
    state, err, var = np.zeros((b, r)), np.empty((b, n)), np.ones((b, n))
    gain, f = np.zeros((b, r)), np.ones(b)
    open_to = np.arange(b)
    p, q = phi, noise
    for t in range(n):
        if len(open_to):
            f[open_to] = here = cov[:, 0, 0]
            moved = p[:, :, None] * cov[:, :1, :]
            moved[:, :-1] += cov[:, 1:]
            gain[open_to] = own = moved[:, :, 0] / here[:, None]
            after = moved[:, :, :1] * p[:, None, :]
            after[:, :, :-1] += moved[:, :, 1:]
            after += q - own[:, :, None] * own[:, None, :] * here[:, None, None]
            if t % 8 == 7 or t + 1 == days:
                still = (np.abs(after - cov).max(axis=(1, 2)) > SETTLED) & (t + 1 != days)
                if not still.all():
                    open_to, after, p, q = open_to[still], after[still], p[still], q[still]
            cov = after
        var[:, t] = f
        e = z[t] - state[:, 0]
        err[:, t] = e
        moved = phi * state[:, :1] + gain * e[:, None]
        moved[:, :-1] += state[:, 1:]
        state = moved
    return err, np.maximum(var, 1e-12), state


def _stationary(step: np.ndarray, noise: np.ndarray) -> np.ndarray:
    """Covariance that a state keeps: the sum of S^k N S'^k, by doubling."""
    cov, power = noise, step
    for _ in range(40):
        more = power @ cov @ power.transpose(0, 2, 1)
        cov = cov + more
        if np.abs(more).max() < 1e-11 * np.abs(cov).max():
            break
        power = power @ power
    return cov


def residuals(z: np.ndarray, orders: Orders, u: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Innovations scaled so that the sum of their squares orders models by likelihood (rows x days)."""
    err, var, _ = innovations(z, *orders.lags(u, at), FROZEN)
    return err / np.sqrt(var) * np.exp(np.log(var).mean(axis=1) / 2)[:, None]


def fit(z: np.ndarray, p: list[int], q: list[int], s: int) -> tuple[Orders, np.ndarray]:
    """The most likely parameters (orders x size) of every order (p[i], q[i]) for the centred series ``z``."""
    orders = Orders(p, q, s)
    m, size = len(orders.p), orders.size
    if not size:
        return orders, np.zeros((m, 0))
    first = np.array([[a] * orders.most_p + [-b] * orders.most_q + [a, -b] * s for a, b in STARTS])
    at = np.repeat(np.arange(m), len(STARTS))
    u = np.where(orders.used[at], np.tile(first, (m, 1)), 0.0)
    base = residuals(z, orders, u, at)
    cost = (base * base).sum(axis=1)
    damp, h = np.full(len(u), 1e-2), 1e-4
    going = np.ones(len(u), bool)
    for k in range(ROUNDS):
        if k == ALL_STARTS:  # from here on only the best start of each order
            lead = cost.reshape(m, -1).argmin(axis=1) + np.arange(m) * len(STARTS)
            going &= np.isin(np.arange(len(u)), lead)
        own = np.flatnonzero(going)
        if not len(own):
            break
        moved = (u[own, None, :] + h * np.eye(size)[None]).reshape(-1, size)
        slope = (residuals(z, orders, moved, np.repeat(at[own], size)).reshape(len(own), size, -1) - base[own, None, :]) / h
        slope *= orders.used[at[own]][:, :, None]
        square = slope @ slope.transpose(0, 2, 1)
        right = (slope @ base[own][:, :, None])[:, :, 0]
        bulk = np.maximum(np.einsum("ijj->ij", square), 1e-8 * cost[own, None] + 1e-300)
        trial = np.concatenate([u[own] - np.clip(np.linalg.solve(
            square + np.einsum("ij,jk->ijk", bulk * (damp[own] * f)[:, None], np.eye(size)), right[:, :, None])[:, :, 0], -1.5, 1.5) for f in DAMPING])
        trial = np.clip(trial, -4.0, 4.0)
        got = residuals(z, orders, trial, np.tile(at[own], len(DAMPING)))
        sums = (got * got).sum(axis=1).reshape(len(DAMPING), -1)
        pick = sums.argmin(axis=0)
        best = sums[pick, np.arange(len(own))]
        better = best < cost[own]
        rows = pick * len(own) + np.arange(len(own))
        small = (cost[own] - best) < 1e-7 * cost[own]
        u[own[better]], base[own[better]], cost[own[better]] = trial[rows[better]], got[rows[better]], best[better]
        damp[own] = np.clip(np.where(better, damp[own] * np.array(DAMPING)[pick], damp[own] * 100), 1e-9, 1e9)
        going[own[(better & small) | (~better & (damp[own] > 1e4))]] = False
    # of equally likely starts the first, so that rounding does not choose
    table = np.round(cost.reshape(m, len(STARTS)) / cost.reshape(m, -1).min(axis=1, keepdims=True), 9)
    return orders, u.reshape(m, len(STARTS), size)[np.arange(m), table.argmin(axis=1)]


def criteria(z: np.ndarray, orders: Orders, u: np.ndarray, told: int) -> np.ndarray:
    """AIC of each order over the last ``told`` days, so that differencings are compared on the same days."""
    err, var, _ = innovations(z, *orders.lags(u, np.arange(len(u))))
    e, f = err[:, -told:], var[:, -told:]
    sigma = np.maximum((e * e / f).mean(axis=1), 1e-12)
    return told * np.log(sigma) + np.log(f).sum(axis=1) + 2 * (orders.used.sum(axis=1) + 2)


def enough(n: int, p: int, d: int, q: int, s: int) -> bool:
    """Whether a series of ``n`` days reaches for an order: at least twice as many differenced days as parameters and lags."""
    return n - d - WEEK * s >= 2 * (p + q + 2 * s) + WEEK * s + 3


def forecast(y: np.ndarray, spec: tuple[int, int, int, int], steps: int) -> np.ndarray:
    """The next days by an order (p, d, q, s); the mean where the series is too short for it."""
    p, d, q, s = spec
    y = y.astype(float)
    if not enough(len(y), p, d, q, s):
        return np.full(steps, y.mean())
    z = difference(y, d, s)
    mean = z.mean()
    orders, u = fit(z - mean, [p], [q], s)
    ar, ma = orders.lags(u, np.zeros(1, int))
    _, _, state = innovations(z - mean, ar, ma)
    state, out = state[0], np.empty(steps)
    for k in range(steps):
        out[k] = state[0] + mean
        head = state[0]
        state = np.append(state[1:], 0.0)
        state[:ar.shape[1]] += ar[0] * head
    if d:
        base = y[WEEK:] - y[:-WEEK] if s else y
        out = base[-1] + np.cumsum(out)
    if s:
        full = list(y[-WEEK:])
        for step in out:
            full.append(full[-WEEK] + step)
        out = np.array(full[WEEK:])
    return out
