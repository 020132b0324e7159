"""Quantile functions as Columns: a law and a uniform give a draw."""

from __future__ import annotations

import math
from datetime import datetime, timezone
from itertools import accumulate
from typing import Any

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions import special
from tabloom.functions.keyed import inv_norm
from tabloom.plans.spec import Law

#: Steps up to which a table is a chain of comparisons; beyond, it is searched as an array.
LADDER = 64


def epoch_micros(text: str) -> int:
    t = datetime.fromisoformat(text)
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp() * 1_000_000)


def _steps_below(u: Column, edges: list[float], closed: bool) -> Column:
    """How many of the rising edges lie below u (at u too if closed)."""
    passed = (lambda e: u >= e) if closed else (lambda e: u > e)
    if len(edges) <= LADDER:
        out = F.lit(len(edges))
        for i in range(len(edges) - 1, -1, -1):
            out = F.when(~passed(F.lit(edges[i])), F.lit(i)).otherwise(out)
        return out
    return F.size(F.filter(F.array(*map(F.lit, edges)), passed))


def _pick(u: Column, values: list[Any], probs: list[float]) -> Column:
    edges = list(accumulate(map(float, probs)))
    at = F.least(_steps_below(u, edges, True), F.lit(len(values) - 1))
    if len(values) > LADDER:
        return F.get(F.array(*map(F.lit, values)), at)
    out = F.lit(values[-1])
    for edge, value in list(zip(edges, values, strict=True))[-2::-1]:
        out = F.when(u < edge, F.lit(value)).otherwise(out)
    return out


def poisson_edges(lam: float, most: int) -> list[float]:
    """Cumulative probabilities of 0 .. most-1 events."""
    logs = [k * math.log(lam) - lam - math.lgamma(k + 1) for k in range(most)]
    return list(np.cumsum(np.exp(logs)).tolist()) if logs else []


def _floor_range(u: Column, low: int, high: int) -> Column:
    drawn = F.floor(F.lit(float(low)) + F.lit(float(high - low + 1)) * u).cast("long")
    return F.least(F.greatest(drawn, F.lit(low).cast("long")), F.lit(high).cast("long"))


def draw(law: Law, u: Column) -> Column:
    """What law gives at the uniform u; timestamps as microseconds since 1970 (bigint)."""
    p = law.params
    match law.kind:
        case "categorical":
            return _pick(u, p["categories"], p["probs"])
        case "normal":
            return F.lit(float(p["mean"])) + F.lit(float(p["std"])) * inv_norm(u)
        case "lognormal":
            return F.exp(F.lit(float(p["mu"])) + F.lit(float(p["sigma"])) * inv_norm(u))
        case "uniform":
            return F.lit(float(p["low"])) + F.lit(float(p["high"]) - float(p["low"])) * u
        case "exponential":
            return -F.log1p(-u) / F.lit(float(p["rate"]))
        case "gamma":
            return special.gamma_column(u, p["shape"], p["scale"])
        case "beta":
            return special.beta_column(u, p["a"], p["b"])
        case "uniform_int" if "max" in p:
            return F.least(F.greatest(_floor_range(u, p["low"], p["high"]), F.lit(0).cast("long")), F.lit(p["max"]).cast("long"))
        case "uniform_int":
            return _floor_range(u, p["low"], p["high"])
        case "zipf" if p["n"] <= LADDER:
            return F.least(_steps_below(u, special.zipf_cdf(p["a"], p["n"]).tolist(), False), F.lit(p["n"] - 1)).cast("long")
        case "zipf":
            return special.zipf_column(u, p["a"], p["n"])
        case "datetime_uniform":
            low, high = epoch_micros(p["start"]), epoch_micros(p["end"])
            return (F.lit(float(low)) + F.lit(float(high - low)) * u).cast("long")
        case "poisson":
            return _steps_below(u, poisson_edges(p["lam"], p["max"]), False).cast("long")
        case "bernoulli":
            return (u > 1.0 - p["p"]).cast("long")
        case "fixed":
            return F.lit(p["n"]).cast("long")
    raise ValueError(f"unknown distribution kind {law.kind!r}")
