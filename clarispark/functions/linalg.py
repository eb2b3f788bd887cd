"""Small dense solvers for the driver: least squares with signs, linear programs, quantiles."""

from __future__ import annotations

import math

import numpy as np


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """min |ax - b| with x >= 0, by an active set."""
    n = a.shape[1]
    x, active = np.zeros(n), np.zeros(n, bool)
    gram, rhs = a.T @ a, a.T @ b
    scale = max(1.0, float(np.abs(rhs).max(initial=0)))
    for _ in range(rounds or 3 * n + 10):
        slope = rhs - gram @ x
        slope[active] = -np.inf
        j = int(np.argmax(slope)) if n else 0
        if not n or slope[j] <= 1e-10 * scale:
            break
        active[j] = True
        while active.any():
            at = np.flatnonzero(active)
            z = np.linalg.lstsq(gram[np.ix_(at, at)], rhs[at], rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[at] = z
                break
            ratio = np.full(len(at), np.inf)
            ratio[z <= 0] = x[at][z <= 0] / np.maximum(x[at][z <= 0] - z[z <= 0], 1e-300)
            out = int(np.argmin(ratio))
            x[at] += ratio[out] * (z - x[at])
            active[at[out]] = False  # at least one leaves, so the loop ends
            active[at[x[at] <= 1e-12]] = False
            x[~active] = 0
    return x


def lp_text(cost: np.ndarray, cover: np.ndarray, slack_cost: np.ndarray) -> str:
    """The covering program in the LP file format."""
    term = lambda c, v: f"{'-' if c < 0 else '+'} {abs(c):.12g} {v}"
    rows = [f" c{i}: " + " ".join([f"+ 1 y{i}", *[f"+ {cover[i, j]:g} x{j}" for j in np.flatnonzero(cover[i])]]) + " >= 1" for i in range(cover.shape[0])]
    goal = " ".join([*(term(c, f"y{i}") for i, c in enumerate(slack_cost)), *(term(c, f"x{j}") for j, c in enumerate(cost))])
    return "\n".join(["Minimize", f" obj: {goal}", "Subject To", *rows, "End", ""])


def covering_lp(cost: np.ndarray, cover: np.ndarray, slack_cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """min cost.x + slack_cost.y with y + cover x >= 1, x, y >= 0: (x, y, duals, objective).

    Solved through its dual, max sum(u) with cover' u <= cost and 0 <= u <= slack_cost, by a
    bounded primal simplex with Bland's rule; the reduced costs of that give x.  Costs must be
    at least 0, so u = 0 is a first vertex.
    """
    m, n = cover.shape
    # Columns: m duals (bounded by slack_cost), n slacks of the dual's rows.
    table = np.hstack([cover.T.astype(float), np.eye(n)])
    upper = np.concatenate([slack_cost, np.full(n, np.inf)])
    gain = np.concatenate([np.ones(m), np.zeros(n)])
    base = np.arange(m, m + n)
    at_upper = np.zeros(m + n, bool)
    for it in range(50 * (m + n) + 100):
        inv = table[:, base]
        fixed = np.where(at_upper, np.where(np.isfinite(upper), upper, 0), 0.0)
        fixed[base] = 0
        value = np.linalg.solve(inv, cost - table @ fixed) if n else np.zeros(0)
        price = np.linalg.solve(inv.T, gain[base]) if n else np.zeros(0)
        reduced = gain - table.T @ price
        reduced[base] = 0
        good = ((~at_upper) & (reduced > 1e-9)) | (at_upper & (reduced < -1e-9))
        if not good.any():
            break
        j = int(np.flatnonzero(good)[0]) if it > 5 * (m + n) else int(np.argmax(np.where(good, np.abs(reduced), -1)))
        way = -1.0 if at_upper[j] else 1.0
        move = -way * np.linalg.solve(inv, table[:, j]) if n else np.zeros(0)
        room = np.full(n, np.inf)
        down, up = move < -1e-12, (move > 1e-12) & np.isfinite(upper[base])
        room[down] = value[down] / -move[down]
        room[up] = (upper[base[up]] - value[up]) / move[up]
        r = int(np.argmin(room)) if n else -1
        out = r if n and room[r] < upper[j] - 1e-12 else -1
        if out < 0:
            at_upper[j] = not at_upper[j]
            continue
        leaving = base[out]
        at_upper[leaving] = bool(move[out] > 0)
        at_upper[j] = False
        base[out] = j
    u = fixed.copy()
    u[base] = value
    x = np.maximum(price, 0)
    y = np.maximum(0, 1 - cover @ x)
    return x, y, u[:m], float(cost @ x + slack_cost @ y)


def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t, by bisection on its distribution function."""
    def beta_cf(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 / max(1e-300, 1 - (a + b) * x / (a + 1)) if abs(1 - (a + b) * x / (a + 1)) > 1e-300 else 1e300
        h = d
        for k in range(1, 400):
            for num in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                c = 1 + num / c
                c = c if abs(c) > 1e-300 else 1e-300
                h *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return h

    def beta_inc(a: float, b: float, x: float) -> float:
        if x <= 0 or x >= 1:
            return float(x >= 1)
        front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
        return front * beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * beta_cf(b, a, 1 - x) / b

    def below(t: float) -> float:
        tail = 0.5 * beta_inc(df / 2, 0.5, df / (df + t * t))
        return 1 - tail if t > 0 else tail

    lo, hi = -1e3, 1e3
    while below(hi) < p:
        hi *= 10
    while below(lo) > p:
        lo *= 10
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return (lo + hi) / 2
