"""Plans to DataFrames.

Each table is one lazy chain of narrow projections from spark.range: children are exploded out
of their parents' rows, with the parent's columns that they need carried along, so generation
has no join and no shuffle at any size. Key, parent key and draws of a row depend on nothing
but the plan and the seed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column as C
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions.keyed import inv_norm, with_uniforms, wrapping
from tabloom.functions.samplers import draw
from tabloom.functions.special import norm_cdf_column
from tabloom.plans.check import event_order
from tabloom.plans.spec import Column, Plan, Table

KEY, PARENT = "__key", "__parent_key"
#: Values before null masks and clamping, values after, and the parent's values.
RAW, DONE, ABOVE, DRAW, NULL = "__raw_", "__done_", "__above_", "__u_", "__null_"
#: Least eigenvalue of a repaired correlation matrix; reach of its uniforms.
FLOOR, REACH = 1e-6, 1e-15
SPARK_TYPES = {"int64": "bigint", "float64": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp_ntz"}


def repair(correlation: object) -> np.ndarray:
    """The nearest by symmetry, eigenvalues of FLOOR at least, and a diagonal of ones."""
    m = np.asarray(correlation, float)
    values, vectors = np.linalg.eigh((m + m.T) / 2)
    m = vectors @ np.diag(np.maximum(values, FLOOR)) @ vectors.T
    scale = 1 / np.sqrt(np.diag(m))
    return m * np.outer(scale, scale)


def to_timestamp(micros: C) -> C:
    """timestamp_ntz of microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def clamp(x: C, low: float, high: float) -> C:
    """x within [low, high]; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x.cast("double"))))


@dataclass
class Generator:
    spark: SparkSession
    plan: Plan
    seed: int | None = None
    partitions: int | None = None

    def __post_init__(self) -> None:
        self.seed = self.plan.seed if self.seed is None else self.seed
        self._states: dict[str, DataFrame] = {}

    # --- rows -------------------------------------------------------------------------------

    def _carried(self, t: Table) -> list[str]:
        """Columns of the parent that t's columns copy or follow."""
        anchors = (c.temporal.anchor for c in t.columns.values() if c.temporal is not None)
        wanted = [c.inherits for c in t.columns.values() if c.inherits] + [a.split(".", 1)[1] for a in anchors if "." in a]
        return list(dict.fromkeys(wanted))

    def _rows(self, t: Table) -> DataFrame:
        if t.role == "root":
            return self.spark.range(0, t.rows, 1, self.partitions).select(F.col("id").alias(KEY))
        above = self._state(self.plan.tables[t.parent])
        held = above.select(KEY, *(F.col(f"{DONE}{c}").alias(f"{ABOVE}{c}") for c in self._carried(t)))
        if t.cardinality.kind == "fixed":
            counted = held.withColumn("__n", F.lit(t.cardinality.params["n"]).cast("long"))
        else:
            counted = with_uniforms(held, KEY, self.seed, {"__n": f"{t.name}.__cardinality__"})
            counted = counted.withColumn("__n", draw(t.cardinality, F.col("__n")))
        each = counted.filter("__n > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)).alias("__j"))
        with wrapping(self.spark):
            keyed = each.select((F.col(KEY) * F.lit(t.child_stride).cast("long") + F.col("__j")).alias(KEY), F.col(KEY).alias(PARENT), *(c for c in held.columns if c != KEY))
            _ = keyed.schema
        return keyed

    # --- values -----------------------------------------------------------------------------

    def _namespaces(self, t: Table) -> dict[str, str]:
        """Every draw of a row of t: column of the frame and namespace."""
        tied = {c: g for g in t.copulas for c in g.columns}
        out = {}
        for c in t.columns.values():
            if c.distribution is not None:
                out[f"{DRAW}{c.name}"] = f"{t.name}.__copula__.{tied[c.name].name}.{c.name}" if c.name in tied else f"{t.name}.{c.name}"
            if c.temporal is not None:
                out[f"{DRAW}{c.name}"] = f"{t.name}.{c.name}.__delay__"
            if c.null_rate > 0:
                out[f"{NULL}{c.name}"] = f"{t.name}.{c.name}.__null__"
        return out

    def _coupled(self, t: Table, df: DataFrame) -> DataFrame:
        """Uniforms of copula columns replaced by dependent ones."""
        for g in t.copulas:
            lower = np.linalg.cholesky(repair(g.correlation))
            normal = {c: f"__z_{c}" for c in g.columns}
            df = df.select("*", *(inv_norm(F.col(f"`{DRAW}{c}`")).alias(z) for c, z in normal.items()))
            mixed = {}
            for i, c in enumerate(g.columns):
                z = sum((F.col(normal[d]) * F.lit(float(lower[i, j])) for j, d in enumerate(g.columns[: i + 1])), F.lit(0.0))
                mixed[f"{DRAW}{c}"] = F.least(F.greatest(norm_cdf_column(z), F.lit(REACH)), F.lit(1.0 - REACH))
            df = df.select(*(mixed[c].alias(c) if c in mixed else F.col(f"`{c}`") for c in df.columns if c not in normal.values()))
        return df

    def _first(self, c: Column) -> C:
        """Drawn, key or copied value of a column that follows no other."""
        if c.distribution is not None:
            value = draw(c.distribution, F.col(f"`{DRAW}{c.name}`"))
            if c.reference is not None:
                last = self.plan.tables[c.reference].rows - 1
                value = F.least(F.greatest(value, F.lit(0).cast("long")), F.lit(last).cast("long"))
            return value
        if c.inherits:
            return F.col(f"`{ABOVE}{c.inherits}`")
        return F.col(KEY if c.generator == "key" else PARENT)

    def _follow(self, t: Table, c: Column) -> C:
        anchor = c.temporal.anchor
        base = F.col(f"`{ABOVE}{anchor.split('.', 1)[1]}`") if "." in anchor else F.col(f"`{RAW}{anchor}`")
        seconds = F.greatest(draw(c.temporal.law, F.col(f"`{DRAW}{c.name}`")).cast("double"), F.lit(0.0))
        return base + (seconds * F.lit(1e6)).cast("long")

    def _finish(self, c: Column) -> C:
        x = F.col(f"`{RAW}{c.name}`")
        if c.null_rate > 0:
            x = F.when(F.col(f"`{NULL}{c.name}`") >= c.null_rate, x)
        if c.clamp is not None and c.type in ("int64", "float64", "timestamp"):
            x = clamp(x, *c.clamp)
        if c.type == "int64":
            whole = c.clamp is None and (c.generator is not None or (c.distribution and c.distribution.kind in ("uniform_int", "zipf")))
            return x.cast("long") if whole else F.rint(x.cast("double")).cast("long")
        if c.type == "float64":
            return F.rint(x.cast("double")) if c.round else x.cast("double")
        return x.cast({"timestamp": "long", "bool": "boolean", "string": "string"}[c.type])

    def _state(self, t: Table) -> DataFrame:
        """KEY, PARENT and the final values of t, timestamps as microseconds."""
        if t.name in self._states:
            return self._states[t.name]
        df = self._coupled(t, with_uniforms(self._rows(t), KEY, self.seed, self._namespaces(t)))
        plain = [c for c in t.columns.values() if c.temporal is None and c.document is None]
        df = df.select("*", *(self._first(c).alias(f"{RAW}{c.name}") for c in plain))
        for name in event_order(t):
            df = df.select("*", self._follow(t, t.columns[name]).alias(f"{RAW}{name}"))
        values = [c for c in t.columns.values() if c.document is None]
        payload_draws = [F.col(f"`{NULL}{c.name}`") for c in t.columns.values() if c.document is not None and c.null_rate > 0]
        keys = [KEY] if t.role == "root" else [KEY, PARENT]
        df = df.select(*keys, *payload_draws, *(self._finish(c).alias(f"{DONE}{c.name}") for c in values))
        for c in t.columns.values():
            if c.document is not None:
                from tabloom.sources.documents import payload

                text = payload(self.plan, t, c, lambda n: self._shown(t.columns[n]))
                if c.null_rate > 0:
                    text = F.when(F.col(f"`{NULL}{c.name}`") >= c.null_rate, text)
                df = df.select("*", text.alias(f"{DONE}{c.name}"))
        self._states[t.name] = df
        return df

    def _shown(self, c: Column) -> C:
        x = F.col(f"`{DONE}{c.name}`")
        return to_timestamp(x) if c.type == "timestamp" else x

    def table(self, name: str) -> DataFrame:
        """The declared columns in order, then the derived ones, none of which sees another."""
        t = self.plan.tables[name]
        df = self._state(t).select(*(self._shown(c).alias(c.name) for c in t.columns.values()))
        return df.select("*", *(F.expr(d.expr).alias(d.name) for d in t.derived)) if t.derived else df

    def tables(self) -> dict[str, DataFrame]:
        return {n: self.table(n) for n in self.plan.order()}


def generate(spark: SparkSession, plan: Plan, seed: int | None = None, partitions: int | None = None) -> dict[str, DataFrame]:
    return Generator(spark, plan, seed, partitions).tables()
