"""Whether written documents hold what their tables hold. Nothing here raises: problems are lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.plans.spec import Plan, Table
from tabloom.sources import xml
from tabloom.sources.documents import document_path
from tabloom.sources.files import json_records


def _records(t: Table, df: DataFrame, path: str) -> tuple[int, dict[str, int]]:
    """Records of a document, and the records inside each first-level list (JSON kinds)."""
    spark = df.sparkSession
    if t.format.kind == "xml":
        return xml.count(spark, path), {}
    doc = json_records(spark, path)
    lists = [n.name for n in t.format.nest if n.name in doc.columns]
    row = doc.agg(F.count("*").alias("__n"), *(F.sum(F.coalesce(F.size(c), F.lit(0))).alias(c) for c in lists)).first()
    return row["__n"], {c: row[c] or 0 for c in lists}


def document_violations(plan: Plan, frames: dict[str, DataFrame], out: str) -> list[str]:
    found = []
    for name, t in plan.tables.items():
        if t.format is None:
            continue
        path, df = document_path(out, t), frames[name]
        try:
            p = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            if not p.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(p):
                found.append(f"{name}: document {path} does not exist")
                continue
            n, inside = _records(t, df, path)
            want = df.count()
            if n != want:
                found.append(f"{name}: document {path} has {n} records, the table {want} rows")
            for nest in t.format.nest:
                want = frames[nest.table].count()
                if t.format.kind != "xml" and inside.get(nest.name, 0) != want:
                    found.append(f"{name}: document {path} has {inside.get(nest.name, 0)} nested {nest.name!r} records, {nest.table} has {want} rows")
        except Exception as e:  # an unreadable document is a finding
            found.append(f"{name}: document {path} can't be read: {str(e).splitlines()[0][:200]}")
    return found
