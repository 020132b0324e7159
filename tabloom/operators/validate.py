"""Whether tables keep what their plan promises.

Each check is a one-row aggregate; their union is one DataFrame of violations. Integrity checks
are anti-joins of the values in use, counted first, against the keys.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.stats import q
from tabloom.plans.spec import Plan, Table


def _row(df: DataFrame, table: str, check: str, column: str, bad) -> DataFrame:
    return df.agg(F.coalesce(bad, F.lit(0)).cast("long").alias("bad_count")).select(F.lit(table).alias("table"), F.lit(check).alias("check"), F.lit(column).alias("column"), "bad_count")


def unmatched(child: DataFrame, column: str, parent: DataFrame, key: str, nulls: bool) -> DataFrame:
    """n: rows of each value of column without a parent; null values count if nulls."""
    used = child.groupBy(q(column).alias("value")).agg(F.count("*").alias("n"))
    used = used if nulls else used.filter("value IS NOT NULL")
    return used.join(parent.select(q(key).alias("key")), F.col("value") == F.col("key"), "left_anti").select("n")


def early(child: DataFrame, column: str, anchor: str, fk: str | None = None, parent: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Rows whose column lies before the anchor; nulls on either side are exempt."""
    if parent is None:
        return child.filter(q(column) < q(anchor))
    above = parent.select(q(key).alias("__key"), q(anchor).alias("__anchor")).filter("__anchor IS NOT NULL")
    return child.select(q(fk).alias("__fk"), q(column).alias("__event")).filter("__event IS NOT NULL").join(above, F.col("__fk") == F.col("__key")).filter("__event < __anchor")


def _checks(plan: Plan, t: Table, frames: dict[str, DataFrame]) -> list[DataFrame]:
    df, pk = frames[t.name], t.primary_key
    out = [_row(df.groupBy(q(pk)).agg(F.count("*").alias("n")), t.name, "primary_key", pk, F.sum("n") - F.count(q(pk)))]
    if t.role == "root":
        out.append(_row(df, t.name, "row_count", "", F.abs(F.count("*") - F.lit(t.rows))))
    else:
        above = plan.tables[t.parent]
        out.append(_row(unmatched(df, t.foreign_key, frames[t.parent], above.primary_key, True), t.name, "foreign_key", t.foreign_key, F.sum("n")))
    for c in t.columns.values():
        if c.reference is not None:
            target = plan.tables[c.reference].primary_key
            out.append(_row(unmatched(df, c.name, frames[c.reference], target, False), t.name, "reference", c.name, F.sum("n")))
        if c.temporal is not None:
            anchor = c.temporal.anchor
            if "." in anchor:
                table, name = anchor.split(".", 1)
                late = early(df, c.name, name, t.foreign_key, frames[table], plan.tables[table].primary_key)
            else:
                late = early(df, c.name, anchor)
            out.append(_row(late, t.name, "order", c.name, F.count("*")))
    return out


def checks(plan: Plan, frames: dict[str, DataFrame]) -> DataFrame:
    """table, check, column, bad_count: a row per check, 0 where it holds."""
    return reduce(DataFrame.unionByName, [c for n in plan.order() for c in _checks(plan, plan.tables[n], frames)])


def violations(plan: Plan, frames: dict[str, DataFrame]) -> list[str]:
    """A line for each check that fails; none means that all is well."""

    def text(r) -> str:
        t = plan.tables[r["table"]]
        n, c = r["bad_count"], r["column"]
        match r["check"]:
            case "primary_key":
                return f"{t.name}: primary key {c!r} is not unique ({n} rows too many or null)"
            case "row_count":
                return f"{t.name}: expected {t.rows} rows, off by {n}"
            case "foreign_key":
                return f"{t.name}: {n} rows have {c!r} with no matching {t.parent}.{plan.tables[t.parent].primary_key}"
            case "reference":
                to = t.columns[c].reference
                return f"{t.name}.{c}: {n} rows have no matching {to}.{plan.tables[to].primary_key} (reference integrity)"
        return f"{t.name}.{c}: {n} rows precede their anchor {t.columns[c].temporal.anchor!r}"

    return [text(r) for r in checks(plan, frames).filter("bad_count > 0").collect()]
