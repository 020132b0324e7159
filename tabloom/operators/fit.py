"""Parameters of a plan from real tables, with optional Laplace noise.

Every estimate is read off Spark aggregates; what reaches the driver is a row per column, a
category list or a table of how often each frequency occurs. With epsilon, releases are noised
in the order in which they were fitted, from one generator, so a seed gives the same plan.

Not noised: date ranges, delays, popularity laws, and the list of categories. The largest count
of children bounds the sensitivity of a cardinality and is itself a number from the data, so
this is noise on parameters and no full guarantee of differential privacy.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.functions.special import harmonic
from tabloom.operators.stats import Facts, children_per_parent, facts, iso_seconds, median, micros, pow2_above, q, spearmans, value_counts
from tabloom.plans.spec import Column, Copula, Delay, Law, Plan, Table

TINY = 1e-9
#: Values that a categorical law may list.
MOST_CATEGORIES = 100_000
GRID = np.round(np.arange(0.0, 3.5001, 0.05), 2)


@dataclass
class Release:
    """A parameter that noise can be added to: its price in shares of epsilon, and how."""

    price: int
    noise: Callable[[float, np.random.Generator], None]


def _laplace(value: float, sensitivity: float, epsilon: float, rng: np.random.Generator) -> float:
    return float(value + rng.laplace(0.0, sensitivity / epsilon))


# --- one column ----------------------------------------------------------------------------


def date_range(f: Facts) -> Law:
    low, high = (math.floor(f.low / 1e6), math.ceil(f.high / 1e6)) if f.filled else (0, 1)
    return Law("datetime_uniform", {"start": iso_seconds(low), "end": iso_seconds(max(high, low + 1))})


def number(f: Facts) -> Law:
    """Lognormal for positive values with a long right tail, else normal."""
    if not f.filled:
        return Law("normal", {"mean": 0.0, "std": TINY})
    if f.low > 0 and (f.skew or 0) > 1:
        return Law("lognormal", {"mu": f.log_mean, "sigma": max(f.log_std, TINY)})
    return Law("normal", {"mean": f.mean, "std": max(f.std, TINY)})


def categories(df: DataFrame, column: str) -> tuple[Law, list[int]]:
    """All values in order with their shares, and their counts. A plan lists them, so there may be MOST_CATEGORIES."""
    found = value_counts(df, column).limit(MOST_CATEGORIES + 1).collect()
    if len(found) > MOST_CATEGORIES:
        raise ValueError(f"column {column!r} has more than {MOST_CATEGORIES} different values, too many for a list of categories")
    rows = sorted(((r["value"], r["n"]) for r in found), key=lambda r: r[0])
    total = sum(n for _, n in rows)
    return Law("categorical", {"categories": [v for v, _ in rows], "probs": [n / total for _, n in rows]}), [n for _, n in rows]


def zipf_exponent(df: DataFrame, column: str, n: int) -> float:
    """Maximum-likelihood exponent on GRID, the smaller of equals.

    The likelihood needs the sum of count * log(rank). Values of one count fill a range of
    ranks, so a table of counts and how many values have each is enough; ranges of logs are
    differences of log-gamma.
    """
    of = value_counts(df, column).groupBy("n").agg(F.count("*").alias("values")).orderBy(F.desc("n")).collect()
    total = weighted = 0.0
    rank = 0
    for count, values in of:
        weighted += count * (math.lgamma(rank + values + 1) - math.lgamma(rank + 1))
        total += count * values
        rank += values
    if not total or n <= 0:
        return float(GRID[0])
    like = [-a * weighted - total * math.log(harmonic(float(a), n)) for a in GRID]
    return float(GRID[int(np.argmax(like))])


def delay_law(delays: DataFrame) -> Law:
    """A law of the non-negative seconds in column s."""
    s = F.col("s")
    log = F.when(s > 0, F.log(s))
    r = delays.agg(F.count("s").alias("n"), F.avg((s > 0).cast("double")).alias("positive"), F.avg("s").alias("mean"), F.stddev_pop(log).alias("sd")).first()
    if r["n"] and r["positive"] >= 0.95:
        mu = median(delays.filter("s > 0").select(F.log("s").alias("l")), "l")
        return Law("lognormal", {"mu": mu, "sigma": max(r["sd"], TINY)})
    return Law("exponential", {"rate": max(1 / max(r["mean"] if r["n"] else TINY, TINY), TINY)})


def delays(plan: Plan, t: Table, c: Column, frames: dict[str, DataFrame]) -> DataFrame:
    """s: seconds from the anchor to the event, 0 at least, where both are given. Those to a parent's
    anchor are stored: a law takes several passes, and each would join again."""
    from tabloom.sources.files import stored

    df, anchor = frames[t.name], c.temporal.anchor
    event = micros(q(c.name))
    if "." in anchor:
        table, name = anchor.split(".", 1)
        above = frames[table].select(q(plan.tables[table].primary_key).alias("__key"), micros(q(name)).alias("__a"))
        both = df.select(q(t.foreign_key).alias("__fk"), event.alias("__e")).join(above, F.col("__fk") == F.col("__key"))
    else:
        both = df.select(event.alias("__e"), micros(q(anchor)).alias("__a"))
    s = both.select(F.when(F.col("__e").isNotNull() & F.col("__a").isNotNull(), F.greatest((F.col("__e") - F.col("__a")) / F.lit(1e6), F.lit(0.0))).alias("s")).filter("s IS NOT NULL")
    return stored(s, "delays") if "." in anchor else s


# --- a plan --------------------------------------------------------------------------------


class _Fit:
    def __init__(self, plan: Plan, frames: dict[str, DataFrame]):
        from tabloom.sources.payloads import fill_from_payloads

        self.plan, self.tables, self.releases = plan, {}, []
        self.frames = {n: fill_from_payloads(plan.tables[n], df) if n in plan.tables else df for n, df in frames.items()}

    def _marginal(self, t: Table, c: Column, df: DataFrame, f: Facts) -> Law:
        if c.reference is not None:
            n = self.plan.tables[c.reference].rows
            return Law("zipf", {"a": zipf_exponent(df, c.name, n), "n": n})
        if c.distribution.kind == "categorical" or f.type in ("string", "bool"):
            law, counts = categories(df, c.name)
            if counts:
                self.releases.append(Release(len(counts), lambda e, rng: self._noise_shares(law, counts, e, rng)))
            return law
        if f.type == "timestamp":
            return date_range(f)
        law = number(f)
        self.releases.append(Release(2, lambda e, rng: self._noise_number(t, c, law, f.filled, e, rng)))
        return law

    @staticmethod
    def _noise_shares(law: Law, counts: list[int], epsilon: float, rng: np.random.Generator) -> None:
        noisy = np.maximum(0.0, np.asarray(counts, float) + rng.laplace(0.0, 1.0 / epsilon, size=len(counts)))
        law.params["probs"] = [float(x) for x in noisy / max(float(noisy.sum()), TINY)]

    @staticmethod
    def _span(t: Table, c: Column, law: Law) -> float:
        """How far a value can lie from another, by the column's clamp."""
        where = f"{t.name}.{c.name}"
        if c.clamp is None:
            raise ValueError(f"{where} needs a clamp before noise can be added: it bounds what one row can change")
        low, high = c.clamp
        if law.kind != "lognormal":
            return high - low
        if low <= 0:
            raise ValueError(f"{where} is lognormal, so its clamp has to start above 0, not at {low!r}, before noise can be added")
        return math.log(high) - math.log(low)

    def _noise_number(self, t: Table, c: Column, law: Law, n: int, epsilon: float, rng: np.random.Generator) -> None:
        place, spread = ("mu", "sigma") if law.kind == "lognormal" else ("mean", "std")
        step = self._span(t, c, law) / max(n, 1)
        law.params[place] = _laplace(law.params[place], step, epsilon, rng)
        law.params[spread] = max(_laplace(law.params[spread], step, epsilon, rng), TINY)

    def _cardinality(self, t: Table) -> tuple[Law, int]:
        above = self.plan.tables[t.parent]
        per = children_per_parent(self.frames[t.name], t.foreign_key, self.frames[t.parent], above.primary_key)
        r = per.agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("most")).first()
        parents, mean, most = r["n"], r["mean"] or 0.0, r["most"] or 0
        if parents and most <= 1:
            law, stride, name, step, bound = Law("bernoulli", {"p": mean}), 2, "p", 1 / parents, lambda v: min(max(v, 0.0), 1.0)
        else:
            limit = max(1, math.ceil(most * 1.5))
            law, stride, name, step, bound = Law("poisson", {"lam": max(mean, TINY), "max": limit}), pow2_above(limit), "lam", most / max(parents, 1), lambda v: max(v, TINY)
        self.releases.append(Release(1, lambda e, rng: law.params.update({name: bound(_laplace(law.params[name], step, e, rng))})))
        return law, stride

    def _copula(self, g: Copula, df: DataFrame) -> list[list[float]]:
        k, ranks = len(g.columns), spearmans(df, list(g.columns))
        m = np.eye(k).tolist()

        def put(i: int, j: int, r: float) -> None:
            m[i][j] = m[j][i] = r

        for i, j in combinations(range(k), 2):
            rho, n = ranks[g.columns[i], g.columns[j]]
            put(i, j, min(max(2 * math.sin(math.pi * rho / 6), -1.0), 1.0))
            self.releases.append(Release(1, lambda e, rng, i=i, j=j, n=n: put(i, j, min(max(_laplace(m[i][j], 6 / max(n, 1), e, rng), -0.99), 0.99))))
        return m

    def table(self, t: Table) -> Callable[[], Table]:
        """Fits t; what is returned builds the table once noise has been added."""
        if t.name not in self.frames:
            return lambda: t
        df = self.frames[t.name]
        drawn = [c for c in t.columns.values() if c.distribution is not None]
        found = facts(df.select(*(c.name for c in drawn))) if drawn else {}
        laws = {c.name: self._marginal(t, c, df, found[c.name]) for c in drawn}
        card = self._cardinality(t) if t.role == "child" else (t.cardinality, t.child_stride)
        matrices = [self._copula(g, df) for g in t.copulas]
        waits = {c.name: delay_law(delays(self.plan, t, c, self.frames)) for c in t.columns.values() if c.temporal is not None}

        def build() -> Table:
            columns = {
                n: replace(c, distribution=laws[n]) if n in laws else replace(c, temporal=Delay(c.temporal.anchor, waits[n])) if n in waits else c
                for n, c in t.columns.items()
            }
            copulas = tuple(replace(g, correlation=tuple(map(tuple, m))) for g, m in zip(t.copulas, matrices, strict=True))
            return replace(t, columns=columns, cardinality=card[0], child_stride=card[1], copulas=copulas)

        return build


def fit(frames: dict[str, DataFrame], skeleton: Plan, epsilon: float | None = None, dp_seed: int = 0) -> Plan:
    """skeleton with parameters from frames. A table without a frame keeps its own; skeleton isn't changed.

    Raises KeyError where a child's parent has no frame, ValueError for a bad epsilon or a
    column that noise needs a clamp for.
    """
    if epsilon is not None and epsilon <= 0:
        raise ValueError(f"epsilon has to be above 0, not {epsilon!r}")
    work = _Fit(skeleton, frames)
    built = {n: work.table(skeleton.tables[n]) for n in skeleton.order()}
    if epsilon is not None:
        share = epsilon / max(sum(r.price for r in work.releases), 1)
        rng = np.random.default_rng(dp_seed)
        for r in work.releases:
            r.noise(share, rng)
    return replace(skeleton, tables={n: built[n]() for n in skeleton.tables})
