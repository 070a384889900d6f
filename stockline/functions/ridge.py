"""Closed-form ridge regression as SQL expressions over per-series moments.

For every series the fit needs only sums: n, Σx_j, Σx_j·x_k, Σx_j·y, Σy.  Those
are native aggregates (one ``groupBy(series)`` pass, map-side combined).  The
centred normal equations (XcᵀXc + αI) w = Xcᵀyc — what a ridge fit with an
unpenalised intercept solves — are then solved per row by Gaussian elimination
written out as column expressions: one projection per pivot and one per
back-substitution step.  The system is symmetric positive definite, so no
pivoting is needed.  The same expression text runs in Spark SQL and DuckDB.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd

# Trend plus annual, semiannual and quarterly Fourier terms.
FEATURES: list[tuple[str, str]] = [
    ("t", "{t}"),
    ("s52", "sin(2 * pi() * {t} / 52)"),
    ("c52", "cos(2 * pi() * {t} / 52)"),
    ("s26", "sin(4 * pi() * {t} / 52)"),
    ("c26", "cos(4 * pi() * {t} / 52)"),
    ("s13", "sin(8 * pi() * {t} / 52)"),
    ("c13", "cos(8 * pi() * {t} / 52)"),
]
K = len(FEATURES)
COEFFICIENTS = [f"w_{name}" for name, _ in FEATURES]


def feature_exprs(t: str) -> list[tuple[str, str]]:
    """(column name, expression) of every feature for time index column ``t``."""
    return [(f"x_{name}", tmpl.format(t=f"CAST({t} AS DOUBLE)")) for name, tmpl in FEATURES]


def moment_aggregates(prefix: str, condition: str, y: str = "y") -> list[tuple[str, str]]:
    """Aggregates over rows satisfying ``condition`` (features named x_*)."""
    xs = [f"x_{name}" for name, _ in FEATURES]

    def s(expr: str) -> str:
        return f"sum(CASE WHEN {condition} THEN {expr} END)"

    out = [(f"{prefix}n", f"CAST(count(CASE WHEN {condition} THEN 1 END) AS DOUBLE)"), (f"{prefix}sy", s(y))]
    for j in range(K):
        out.append((f"{prefix}sx{j}", s(xs[j])))
        out.append((f"{prefix}sxy{j}", s(f"{xs[j]} * {y}")))
        for k in range(j, K):
            out.append((f"{prefix}sxx{j}_{k}", s(f"{xs[j]} * {xs[k]}")))
    return out


def solve_stages(prefix: str, alpha: float) -> list[list[tuple[str, str]]]:
    """Projection stages turning ``{prefix}`` moments into ``{prefix}w_*`` and
    ``{prefix}intercept``.  Each stage only refers to columns of earlier stages."""
    p = prefix
    a = {}
    stage0 = []
    for i in range(K):
        for j in range(K):
            lo, hi = min(i, j), max(i, j)
            name = f"{p}a0_{i}_{j}"
            expr = f"{p}sxx{lo}_{hi} - {p}sx{i} * {p}sx{j} / {p}n"
            if i == j:
                expr += f" + {float(alpha)!r}"
            stage0.append((name, expr))
            a[(i, j)] = name
        stage0.append((f"{p}b0_{i}", f"{p}sxy{i} - {p}sx{i} * {p}sy / {p}n"))
    b = {i: f"{p}b0_{i}" for i in range(K)}
    stages = [stage0]
    for k in range(K - 1):
        stage = []
        new_a, new_b = dict(a), dict(b)
        for i in range(k + 1, K):
            factor = f"({a[(i, k)]} / {a[(k, k)]})"
            for j in range(k + 1, K):
                name = f"{p}a{k + 1}_{i}_{j}"
                stage.append((name, f"{a[(i, j)]} - {factor} * {a[(k, j)]}"))
                new_a[(i, j)] = name
            name = f"{p}b{k + 1}_{i}"
            stage.append((name, f"{b[i]} - {factor} * {b[k]}"))
            new_b[i] = name
        a, b = new_a, new_b
        stages.append(stage)
    w = {}
    for i in reversed(range(K)):
        terms = " ".join(f"- {a[(i, j)]} * {w[j]}" for j in range(i + 1, K))
        name = f"{p}{COEFFICIENTS[i]}"
        stages.append([(name, f"({b[i]} {terms}) / {a[(i, i)]}")])
        w[i] = name
    intercept = f"{p}sy / {p}n - (" + " + ".join(f"{p}sx{j} / {p}n * {w[j]}" for j in range(K)) + ")"
    stages.append([(f"{p}intercept", intercept)])
    return stages


def prediction_expr(prefix: str) -> str:
    """intercept + Σ w_j x_j, with the features x_* of the current row."""
    terms = " + ".join(f"{prefix}{COEFFICIENTS[j]} * x_{name}" for j, (name, _) in enumerate(FEATURES))
    return f"{prefix}intercept + {terms}"


def merged_stages(prefixes: tuple[str, ...], alpha: float) -> list[list[tuple[str, str]]]:
    """The solve stages of several moment sets run side by side (same depth)."""
    per = [solve_stages(p, alpha) for p in prefixes]
    return [sum(group, []) for group in zip(*per)]


_IDENT = re.compile(r"\b[a-z]+_[a-z0-9_]+\b")


def live_columns(stages: list[list[tuple[str, str]]], keep: set[str]) -> list[set[str]]:
    """For each stage, the generated columns still needed after it runs."""
    needed = set(keep)
    out: list[set[str]] = []
    for stage in reversed(stages):
        out.append(set(needed))
        for name, expr in stage:
            needed.discard(name)
        for _, expr in stage:
            needed |= set(_IDENT.findall(expr))
    return list(reversed(out))


def solve_batches(prefixes: Sequence[str], carry: Sequence[str], alpha: float):
    """mapInPandas function: moments (one row per series) -> coefficients.

    The same centred normal equations as ``solve_stages``, solved with a
    batched LAPACK call over all series of an Arrow batch.  Only the bounded
    one-row-per-series table passes through Python.
    """
    carry = list(carry)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        eye = np.eye(K)[None]
        for pdf in batches:
            out = pdf[carry].copy()
            for p in prefixes:
                n = pdf[f"{p}n"].to_numpy(dtype=float)
                sy = pdf[f"{p}sy"].to_numpy(dtype=float)
                sx = np.stack([pdf[f"{p}sx{j}"].to_numpy(dtype=float) for j in range(K)], axis=1)
                sxy = np.stack([pdf[f"{p}sxy{j}"].to_numpy(dtype=float) for j in range(K)], axis=1)
                sxx = np.empty((len(pdf), K, K))
                for j in range(K):
                    for k in range(j, K):
                        sxx[:, j, k] = sxx[:, k, j] = pdf[f"{p}sxx{j}_{k}"].to_numpy(dtype=float)
                a = sxx - sx[:, :, None] * sx[:, None, :] / n[:, None, None] + alpha * eye
                b = sxy - sx * (sy / n)[:, None]
                w = np.linalg.solve(a, b[..., None])[..., 0] if len(pdf) else np.empty((0, K))
                out[f"{p}intercept"] = sy / n - (sx / n[:, None] * w).sum(axis=1)
                for j, name in enumerate(COEFFICIENTS):
                    out[f"{p}{name}"] = w[:, j]
            yield out

    return run
