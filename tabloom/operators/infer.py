"""A plan's structure from real tables: keys, parents, references, events, dependent columns.

All tests are aggregates over whole tables. Decisions are deterministic: ties go by name.
"""

from __future__ import annotations

import fnmatch
import math
from dataclasses import dataclass, field, replace
from functools import cached_property
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.fit import date_range
from tabloom.operators.scan import COVERAGE
from tabloom.operators.stats import Facts, containments, facts, medians, micros, pow2_above, q, spearmans, top_values, value_counts
from tabloom.plans.spec import Column, Copula, Delay, Law, Plan, Table, dump, parse

STRING_MOST, STRING_TOP, INT_MOST, RHO = 200, 20, 20, 0.3
FOLLOWS = 0.98


@dataclass
class Link:
    """A table's column that holds another table's key."""

    column: str
    parent: str
    coverage: float
    mean_children: float = 0.0


@dataclass
class Inference:
    frames: dict[str, DataFrame]
    seed: int = 42
    sources: list[tuple[str, str]] | None = None
    warnings: list[str] = field(default_factory=list)

    @cached_property
    def facts(self) -> dict[str, dict[str, Facts]]:
        return {t: facts(self.frames[t]) for t in sorted(self.frames)}

    def rows(self, t: str) -> int:
        return next((f.rows for f in self.facts[t].values()), 0)

    # --- keys -------------------------------------------------------------------------------

    @cached_property
    def unique(self) -> dict[str, list[str]]:
        """Columns that could be keys: all values there, all different, no event times."""
        return {t: [c for c, f in cols.items() if f.unique and f.type != "timestamp"] for t, cols in self.facts.items()}

    @cached_property
    def forced(self) -> dict[str, Link]:
        """Tables whose unique column is another table's key: the table of fewer rows is the child."""
        shared = [(c, a, b) for a, b in permutations(self.unique, 2) for c in self.unique[a] if c in self.unique[b]]
        shares = containments([(self.frames[a], c, self.frames[b], c) for c, a, b in shared])
        holds = {pair: share for pair, share in zip(shared, shares, strict=True) if share >= COVERAGE}
        # of two tables that hold each other's values the one with more rows is above, the first name among equals
        above = lambda t: (-self.rows(t), t)
        claims = sorted((c, sorted((a, b)), a, b) for c, a, b in holds if (c, b, a) not in holds or above(b) < above(a))
        out: dict[str, Link] = {}
        for c, _, child, parent in claims:
            if child in out:
                self.warnings.append(f"{child}.{c} could also be the key of {parent}; {child} stays under {out[child].parent}")
            out.setdefault(child, Link(c, parent, holds[c, child, parent]))
        return out

    @cached_property
    def keys(self) -> dict[str, str]:
        out = {}
        for t, columns in self.unique.items():
            lent = {self.forced[t].column} if t in self.forced else set()
            free = [c for c in columns if c not in lent]
            named = [c for c in free if c == "id" or c.endswith("_id")]
            out[t] = min(named) if named else free[0] if free else f"{t}_id"
            if not free:
                why = f"its only unique column {min(lent)} is the key of {self.forced[t].parent} (parent-as-pk)" if lent else "it has no unique column without nulls"
                self.warnings.append(f"{t} gets the new key {out[t]}: {why}")
        return out

    # --- links ------------------------------------------------------------------------------

    @cached_property
    def links(self) -> dict[str, list[Link]]:
        """Each table's columns that hold other tables' keys. All shares come from one job."""
        owners = {t: k for t, k in self.keys.items() if k in self.facts[t]}
        pairs = [
            (t, c, p) for t in self.facts for c in self.facts[t] for p, k in owners.items()
            if c == k and p != t and c != self.keys[t] and (t not in self.forced or c != self.forced[t].column)
        ]
        shares = containments([(self.frames[t], c, self.frames[p], c) for t, c, p in pairs])
        out: dict[str, list[Link]] = {t: [] for t in self.facts}
        for (t, c, p), share in zip(pairs, shares, strict=True):
            f = self.facts[t][c]
            if share >= COVERAGE:
                out[t].append(Link(c, p, share, f.rows / f.n_unique if f.n_unique else math.inf))
        return out

    @cached_property
    def parents(self) -> dict[str, Link]:
        """The parent of each child table; of a cycle the link of least coverage goes. References are to roots only."""
        self.references: dict[str, list[Link]] = {}
        out: dict[str, Link] = {}
        for t in self.facts:
            links = self.links[t]
            best = self.forced.get(t) or min(links, key=lambda x: (x.mean_children, x.parent), default=None)
            if best is not None:
                out[t] = best
            self.references[t] = [x for x in links if x is not best]
        while loop := self._cycle(out):
            worst = min(loop, key=lambda t: out[t].coverage)
            self.warnings.append(f"{worst} becomes a root: its link to {out[worst].parent} closes a circle of parents")
            del out[worst]
        for t, links in self.references.items():
            for x in links:
                if x.parent in out:
                    self.warnings.append(f"{t}: {x.column!r} holds keys of {x.parent!r}, a child table, which a plan can't reference; it stays a plain column")
            self.references[t] = [x for x in links if x.parent not in out]
        return out

    def _cycle(self, links: dict[str, Link]) -> list[str]:
        for start in self.facts:
            chain = [start]
            while chain[-1] in links:
                after = links[chain[-1]].parent
                if after in chain:
                    return chain[chain.index(after) :]
                chain.append(after)
        return []

    # --- columns ----------------------------------------------------------------------------

    def _nulls(self, t: str, c: str) -> float:
        return round(self.facts[t][c].null_rate, 4) if c in self.facts[t] else 0.0

    def _plain(self, t: str, c: str, f: Facts) -> tuple[Column, bool] | None:
        """A column by its values, and whether it may depend on others; None if it is left out."""
        even = lambda values: Law("categorical", {"categories": values, "probs": [1 / len(values)] * len(values)})
        spread, tied = Law("lognormal", {"mu": 0.0, "sigma": 1.0}), True
        if f.type == "bool":
            law, tied = even([True, False]), False
        elif f.type == "int64" and 0 < f.n_unique <= INT_MOST:
            law = even(sorted(r["value"] for r in value_counts(self.frames[t], c).collect()))
        elif f.type in ("int64", "float64"):
            law = spread
        elif f.n_unique > STRING_MOST:
            self.warnings.append(f"{t}.{c} is left out: {f.n_unique} different strings")
            return None
        elif f.n_unique == 0:
            self.warnings.append(f"{t}.{c} is left out: it holds no values")
            return None
        else:
            law, tied = even([r["value"] for r in top_values(self.frames[t], c, STRING_TOP).collect()]), False
        return Column(c, f.type, distribution=law, null_rate=self._nulls(t, c)), tied

    def _events(self, t: str, columns: list[str], link: Link | None) -> dict[str, Column]:
        """Event columns, earliest median first; each follows the closest earlier one that it hardly ever precedes."""
        df = self.frames[t]
        middles = medians(df, {c: micros(q(c)) for c in columns})
        order = sorted(columns, key=lambda c: math.inf if middles[c] is None else middles[c])
        known: dict[str, str] = {}
        flat = df.select(*(micros(q(c)).alias(f"__e_{c}") for c in order), *([q(link.column).alias("__fk")] if link else []))
        if link is not None:
            above = [c for c, f in self.facts[link.parent].items() if f.type == "timestamp"]
            known = {f"{link.parent}.{c}": f"__p_{c}" for c in above}
            if above:
                key = self.keys[link.parent] if self.keys[link.parent] in self.facts[link.parent] else link.column
                p = self.frames[link.parent].select(q(key).alias("__key"), *(micros(q(c)).alias(f"__p_{c}") for c in above))
                flat = flat.join(p, F.col("__fk") == F.col("__key"), "left")
        pairs = []
        for c in order:
            pairs += [(a, n, c) for a, n in known.items()]
            known[c] = f"__e_{c}"
        gaps = {(a, c): (q(f"__e_{c}") - q(n)) / F.lit(1e6) for a, n, c in pairs}
        names = {k: i for i, k in enumerate(gaps)}
        share = flat.agg(*(F.avg((g >= 0).cast("double")).alias(f"s{names[k]}") for k, g in gaps.items())).first() if gaps else None
        middle = medians(flat, {f"m{i}": g for i, g in zip(names.values(), gaps.values(), strict=True) if (share[f"s{i}"] or 0) >= FOLLOWS})
        out = {}
        for c in order:
            fits = [(middle[f"m{i}"], i, a) for (a, d), i in names.items() if d == c and (middle.get(f"m{i}") or 0) > 0]
            if fits:
                out[c] = Column(c, "timestamp", temporal=Delay(min(fits)[2], Law("lognormal", {"mu": 10.0, "sigma": 1.0})), null_rate=self._nulls(t, c))
            else:
                out[c] = Column(c, "timestamp", distribution=date_range(self.facts[t][c]), null_rate=self._nulls(t, c))
        return out

    def _groups(self, t: str, columns: list[str]) -> tuple[Copula, ...]:
        """Columns joined by rank correlations of RHO or more."""
        group, rho = {c: {c} for c in sorted(columns)}, spearmans(self.frames[t], columns)
        names = list(group)
        for i, a in enumerate(names):
            for b in names[i + 1 :]:
                if group[a] is not group[b] and abs(rho[a, b][0]) >= RHO:
                    group[a] |= group[b]
                    for c in group[b]:
                        group[c] = group[a]
        found = sorted({tuple(sorted(g)) for g in group.values() if len(g) > 1})
        one = lambda k: tuple(tuple(float(i == j) for j in range(k)) for i in range(k))
        return tuple(Copula(f"corr_{i}", g, one(len(g))) for i, g in enumerate(found, 1))

    def _source(self, t: str) -> str | None:
        return next((name for name, pattern in self.sources or () if fnmatch.fnmatch(t, pattern)), None)

    def _cardinality(self, t: str, link: Link) -> tuple[Law, int]:
        per = value_counts(self.frames[t], link.column).agg(F.avg("n"), F.max("n")).first()
        if t in self.forced or (per[1] or 0) <= 1:
            return Law("bernoulli", {"p": 0.5}), 2
        limit = math.ceil(per[1] * 1.5)
        return Law("poisson", {"lam": round(per[0], 2), "max": limit}), pow2_above(limit)

    def table(self, t: str) -> Table:
        key, link = self.keys[t], self.parents.get(t)
        columns = {key: Column(key, "int64", "key")}
        if link is not None:
            columns[link.column] = Column(link.column, "int64", "parent_key")
        if any(c in self.facts[t] and self.facts[t][c].type == "string" for c in list(columns)):
            self.warnings.append(f"{t} has keys of strings; generated ones are int64")
        for r in sorted(self.references[t], key=lambda r: (r.column, r.parent)):
            columns[r.column] = Column(r.column, "int64", distribution=Law("zipf", {"a": 0.5, "n": self.rows(r.parent)}), reference=r.parent, null_rate=self._nulls(t, r.column))
        left = {c: f for c, f in self.facts[t].items() if c not in columns}
        tied = []
        for c, f in left.items():
            if f.type != "timestamp" and (made := self._plain(t, c, f)) is not None:
                columns[c] = made[0]
                tied += [c] if made[1] else []
        columns |= self._events(t, [c for c, f in left.items() if f.type == "timestamp"], link)
        card, stride = (None, None) if link is None else self._cardinality(t, link)
        return Table(t, "root" if link is None else "child", columns, key, self.rows(t) if link is None else None, link and link.parent, card, stride, self._groups(t, tied), source=self._source(t))

    def plan(self) -> Plan:
        self.parents, self.keys  # noqa: B018  warnings in this order
        made = Plan(1, self.seed, {t: self.table(t) for t in self.facts})
        return parse(dump(made))


def infer(frames: dict[str, DataFrame], seed: int = 42, sources: list[tuple[str, str]] | None = None) -> tuple[Plan, list[str]]:
    """A checked skeleton for frames, and what was decided that may surprise."""
    work = Inference(frames, seed, sources)
    plan = work.plan()
    return replace(plan), work.warnings
