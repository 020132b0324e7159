"""Aggregates that profiling, fitting and inference share. Each is one or two passes, all columns at once."""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.plans.spec import pow2_above as pow2_above

#: Rows up to which the built-in exact median (one task's memory) is used.
MEDIAN_ROWS = 10_000_000
#: Characters from which a value is hashed before values are counted.
LONG = 48
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def dsl_type(kind: T.DataType) -> str:
    """The plan's type for a Spark type; decimals count as floats."""
    match kind:
        case T.BooleanType():
            return "bool"
        case T.ByteType() | T.ShortType() | T.IntegerType() | T.LongType():
            return "int64"
        case T.FloatType() | T.DoubleType() | T.DecimalType():
            return "float64"
        case T.TimestampType() | T.TimestampNTZType() | T.DateType():
            return "timestamp"
    return "string"


def types_of(df: DataFrame) -> dict[str, str]:
    return {f.name: dsl_type(f.dataType) for f in df.schema}


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def micros(x: Column) -> Column:
    """Microseconds since 1970 of a naive timestamp or date."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), x.cast("timestamp_ntz"))


def iso_seconds(seconds: int) -> str:
    return (EPOCH + timedelta(seconds=seconds)).isoformat()


def distinct_counts(df: DataFrame) -> DataFrame:
    """column, n_unique (non-null). Columns are unpivoted, so there is one shuffle for all of them; long
    values go as 128-bit hashes."""

    def short(c: str) -> Column:
        text = q(c).cast("string")
        return F.when(F.length(text) > LONG, F.concat(F.lit("#"), F.md5(text))).otherwise(text) if kinds[c] == "string" else text

    kinds = types_of(df)
    pairs = F.inline(F.array(*(F.struct(F.lit(c).alias("column"), short(c).alias("value")) for c in df.columns)))
    return df.select(pairs).distinct().groupBy("column").agg(F.count("value").alias("n_unique"))


def column_profile(df: DataFrame) -> DataFrame:
    """column, type, n_rows, n_null, n_unique, is_unique."""
    kinds = types_of(df)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count("*").alias("n_rows"), F.count_if(q(c).isNull()).alias("n_null")) for c in df.columns]
    wide = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    unique = (F.col("n_null") == 0) & (F.col("n_unique") == F.col("n_rows")) & (F.col("n_rows") > 0)
    return wide.join(distinct_counts(df), "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0))).withColumn("is_unique", unique)


@dataclass(frozen=True)
class Facts:
    """What one column holds; moments are of non-null values, low and high of timestamps are microseconds."""

    type: str
    rows: int
    nulls: int
    n_unique: int
    low: Any = None
    high: Any = None
    mean: float | None = None
    std: float | None = None
    std_sample: float | None = None
    skew: float | None = None
    log_mean: float | None = None
    log_std: float | None = None
    log_std_sample: float | None = None

    @property
    def unique(self) -> bool:
        return self.rows > 0 and self.nulls == 0 and self.n_unique == self.rows

    @property
    def null_rate(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def filled(self) -> int:
        return self.rows - self.nulls


def _measures(c: str, kind: str) -> dict[str, Column]:
    x = q(c)
    if kind == "timestamp":
        return {"low": F.min(micros(x)), "high": F.max(micros(x))}
    if kind not in ("int64", "float64"):
        return {}
    v = x.cast("double")
    log = F.when(v > 0, F.log(v))
    return {
        "low": F.min(x), "high": F.max(x), "mean": F.avg(v), "std": F.stddev_pop(v), "std_sample": F.stddev_samp(v), "skew": F.skewness(v),
        "log_mean": F.avg(log), "log_std": F.stddev_pop(log), "log_std_sample": F.stddev_samp(log),
    }


def facts(df: DataFrame) -> dict[str, Facts]:
    """Facts of every column: one wide aggregate and one distinct count; what comes back is a row per column."""
    kinds = types_of(df)
    wanted = {(c, m): e for c, k in kinds.items() for m, e in _measures(c, k).items()}
    names = {key: f"m{i}" for i, key in enumerate(wanted)}
    row = df.agg(F.count("*").alias("rows"), *(F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(kinds)), *(e.alias(names[k]) for k, e in wanted.items())).first()
    unique = {r["column"]: r["n_unique"] for r in distinct_counts(df).collect()} if kinds else {}
    return {c: Facts(k, row["rows"], row[f"n{i}"], unique.get(c, 0), **{m: row[names[c, m]] for (d, m) in wanted if d == c}) for i, (c, k) in enumerate(kinds.items())}


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value, n of the non-null values."""
    return df.filter(q(column).isNotNull()).groupBy(q(column).alias("value")).agg(F.count("*").alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; the smaller of equally frequent ones first."""
    return value_counts(df, column).orderBy(F.desc("n"), "value").limit(k)


def median(df: DataFrame, column: str) -> float | None:
    """Exact median of a numeric column, the mean of the middle two for even counts.

    Beyond MEDIAN_ROWS an approximate quantile bounds the middle, and only values between the
    bounds are sorted.
    """
    x = df.select(q(column).cast("double").alias("x")).filter("x IS NOT NULL")
    n = x.count()
    if n == 0:
        return None
    if n <= MEDIAN_ROWS:
        return x.agg(F.median("x")).first()[0]
    low, high = x.agg(F.percentile_approx("x", [0.499, 0.501], 10_000)).first()[0]
    before = x.filter(F.col("x") < low).count()
    middle = x.filter(F.col("x").between(low, high)).orderBy("x")
    at = (n - 1) // 2
    found = [r[0] for r in middle.offset(at - before).limit(2 - n % 2).collect()]
    return sum(found) / len(found)


def with_rank(df: DataFrame, column: str, name: str, parts: int = 256) -> DataFrame:
    """df with the average rank (from 1) of column's value, without a global window.

    Distinct values are cut at approximate quantiles; totals of the cuts give offsets, windows
    run inside a cut.
    """
    counts = value_counts(df, column)
    cuts = [i / parts for i in range(1, parts)]
    bounds = counts.agg(F.percentile_approx("value", cuts, 10_000).alias("b"))
    placed = counts.withColumn("b", F.lit(bounds.first()[0] or []).cast("array<double>"))
    placed = placed.withColumn("cut", F.size(F.filter("b", lambda e: e <= F.col("value")))).drop("b")
    totals = placed.groupBy("cut").agg(F.sum("n").alias("t"))
    offsets = totals.select("cut", F.coalesce(F.sum("t").over(Window.orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("o"))
    inside = Window.partitionBy("cut").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = placed.join(F.broadcast(offsets), "cut").select("value", (F.col("o") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + (F.col("n") + 1) / 2).alias(name))
    return df.join(ranked, q(column) == F.col("value"), "left").drop("value")


def _corr(a: str, b: str) -> Column:
    """Correlation; null where a side has one value only, for which the built-in divides by zero."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _rho(rho: float | None, n: int) -> float:
    return rho if n >= 2 and rho is not None and math.isfinite(rho) else 0.0


def spearman(df: DataFrame, a: str, b: str) -> tuple[float, int]:
    """Rank correlation over rows where both are given (0 if undefined), and their number."""
    both = df.select(q(a).cast("double").alias("a"), q(b).cast("double").alias("b")).na.drop()
    ranked = with_rank(with_rank(both, "a", "ra"), "b", "rb")
    rho, n = ranked.agg(_corr("ra", "rb"), F.count("*")).first()
    return _rho(rho, n), n


def spearmans(df: DataFrame, columns: list[str]) -> dict[tuple[str, str], tuple[float, int]]:
    """spearman() of all pairs, both ways round. Columns without nulls are ranked once for all their
    partners and correlated in one aggregate; ranks of others differ from partner to partner."""
    nulls = df.agg(*(F.count_if(q(c).isNull()).alias(f"n{i}") for i, c in enumerate(columns))).first() if columns else []
    full = [c for c, n in zip(columns, nulls, strict=True) if not n]
    out: dict[tuple[str, str], tuple[float, int]] = {}
    if len(full) > 1:
        ranked = df.select(*(q(c).cast("double").alias(f"x{i}") for i, c in enumerate(full)))
        for i in range(len(full)):
            ranked = with_rank(ranked, f"x{i}", f"r{i}").drop(f"x{i}")
        pairs = list(combinations(range(len(full)), 2))
        row = ranked.agg(F.count("*"), *(_corr(f"r{i}", f"r{j}") for i, j in pairs)).first()
        out = {(full[i], full[j]): (_rho(row[k], row[0]), row[0]) for k, (i, j) in enumerate(pairs, 1)}
    for a, b in combinations(columns, 2):
        if (a, b) not in out:
            out[a, b] = spearman(df, a, b)
        out[b, a] = out[a, b]
    return out


def medians(df: DataFrame, columns: dict[str, Column]) -> dict[str, float | None]:
    """Exact medians. The built-in keeps a column's values in one task, so it is used, for all columns in
    one pass, while rows times columns are few; beyond, each column's middle is bracketed and sorted."""
    if not columns:
        return {}
    if df.count() * len(columns) <= MEDIAN_ROWS:
        row = df.agg(*(F.median(e).alias(f"m{i}") for i, e in enumerate(columns.values()))).first()
        return {k: row[f"m{i}"] for i, k in enumerate(columns)}
    return {k: median(df.select(e.alias("m")), "m") for k, e in columns.items()}


def _inside(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """inside, total: the child's non-null values that are among the parent's, and all of them.

    Values are counted first, so a value that a third of all rows hold is one row of the join.
    """
    kind = parent.schema[key].dataType
    values = value_counts(child, column).select(F.expr("try_cast(value AS %s)" % kind.simpleString()).alias("value"), "n")
    keys = parent.select(q(key).alias("value")).filter("value IS NOT NULL").distinct()
    hit = values.join(keys.withColumn("hit", F.lit(1)), "value", "left")
    return hit.agg(F.sum(F.when(F.col("hit") == 1, F.col("n"))).alias("inside"), F.sum("n").alias("total"))


def containments(links: list[tuple[DataFrame, str, DataFrame, str]]) -> list[float]:
    """For each (child, column, parent, key) the share of the child's non-null values that are among
    the parent's; 0 if types don't meet. One job for all links."""
    parts = [_inside(*x).withColumn("link", F.lit(i)) for i, x in enumerate(links)]
    rows = reduce(DataFrame.unionByName, parts).collect() if parts else []
    share = {r["link"]: (r["inside"] or 0) / r["total"] if r["total"] else 0.0 for r in rows}
    return [share[i] for i in range(len(links))]


def containment(child: DataFrame, column: str, parent: DataFrame, key: str) -> float:
    return containments([(child, column, parent, key)])[0]


def children_per_parent(child: DataFrame, fk: str, parent: DataFrame, key: str) -> DataFrame:
    """key, n for every parent row, childless ones with 0."""
    counts = child.groupBy(q(fk).alias("__fk")).agg(F.count("*").alias("n"))
    return parent.select(q(key).alias("key")).join(counts, F.col("key") == F.col("__fk"), "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def count_moments(child: DataFrame, fk: str, parent: DataFrame) -> dict[str, float]:
    """Parents, parents with children, children, sum of squares, least and most children of those that have any."""
    per = child.filter(q(fk).isNotNull()).groupBy(q(fk)).agg(F.count("*").alias("n"))
    r = per.agg(F.count("*").alias("seen"), F.sum("n").alias("total"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min("n").alias("low"), F.max("n").alias("high")).first()
    return {"parents": parent.count(), **{k: v or 0 for k, v in r.asDict().items()}}
