"""Tables from and to folders: Parquet, CSV, JSON, XML."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.plans.spec import Plan, Table
from tabloom.sources import xml
from tabloom.sources.payloads import expand_all, extract, flatten, rescue_dates

JSON = (".json", ".jsonl", ".ndjson")


class SourceError(Exception):
    """A folder or file that can't be read as tables."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, removed at the end; a temporary one where a local master has none set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise SourceError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tabloom-")
    path = f"{base}/tabloom-{name}-{uuid.uuid4().hex}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    @atexit.register
    def remove() -> None:
        try:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # the JVM may have gone already
            return

    return path


#: Shuffle files of a write are of no use after it; Spark removes them at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to a scratch path and read again, so that what several passes read is made once."""
    spark = df.sparkSession
    path, before = scratch(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def table_path(out: str, t: Table) -> str:
    """Where a table's Parquet stands: under its source, if it has one."""
    return "/".join(filter(None, (out.rstrip("/"), t.source, t.name)))


def write_tables(plan: Plan, frames: dict[str, DataFrame], out: str) -> None:
    for n, df in frames.items():
        df.write.mode("overwrite").parquet(table_path(out, plan.tables[n]))


def read_tables(spark: SparkSession, plan: Plan, out: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(table_path(out, plan.tables[n])) for n in plan.order()}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quotes inside quoted fields are doubled. Only files with line breaks inside quotes are read whole."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    broken = spark.read.text(path).filter(quotes % 2 == 1).limit(1).count() > 0
    return rescue_dates(spark.read.csv(path, header=True, inferSchema=True, escape='"', multiLine=broken, timestampFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"))


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of a JSON array or of a file of a record per line. An array that has a record on each
    line, as documents written here have, is read by lines and so in parts; any other one whole."""
    lines = spark.read.text(path).select(F.trim("value").alias("value")).filter("value NOT IN ('', '[', ']')")
    bare = F.regexp_replace("value", r",$", "")
    n, good, first = lines.agg(F.count("*"), F.count_if(F.when(bare.startswith("{"), F.try_parse_json(bare).isNotNull()).otherwise(False)), F.min("value")).first()
    if n and n == good:
        values = getattr(lines.select(bare.alias("value"))._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        return DataFrame(spark._jsparkSession.read().json(values), spark)
    begins = spark.read.text(path).filter("trim(value) <> ''").limit(1).collect()
    return spark.read.json(path, multiLine=bool(begins) and begins[0][0].lstrip().startswith(("[", "{")) and n != good)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return rescue_dates(flatten(json_records(spark, path)))


def _listing(spark: SparkSession, folder: str) -> list[tuple[str, str, bool]]:
    """name, path, whether a folder, of what folder holds, by name."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        raise SourceError(f"no such folder: {folder}")
    return sorted((s.getPath().getName(), s.getPath().toString(), s.isDirectory()) for s in fs.listStatus(p))


def _naive(df: DataFrame) -> DataFrame:
    """Time-zoned timestamps as naive ones."""
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(*(df[f"`{c}`"].cast("timestamp_ntz").alias(c) if isinstance(k, T.TimestampType) else df[f"`{c}`"] for c, k in kinds.items()))


def load(spark: SparkSession, folder: str, most: int | None = None) -> dict[str, DataFrame]:
    """Every table of a folder by file name; documents in columns are expanded, nested lists become tables.
    most: rows of each table to look at, whichever come first; None for all."""
    out: dict[str, DataFrame] = {}
    for name, path, is_folder in _listing(spark, folder):
        stem, dot, suffix = name.rpartition(".")
        kind = f"{dot}{suffix}".lower()
        if kind == ".parquet":
            out[stem] = flatten(spark.read.parquet(path))
        elif kind == ".csv":
            out[stem] = read_csv(spark, path)
        elif kind in JSON:
            out[stem] = read_json(spark, path)
        elif kind == ".xml":
            out |= xml.read_entities(spark, path, stem)
        elif is_folder and any(n.lower().endswith(".xml") for n, _, _ in _listing(spark, path)):
            out |= xml.read_entities(spark, path, name)
    if not out:
        raise SourceError(f"no Parquet, CSV, JSON or XML tables in {folder}")
    out = out if most is None else {n: df.limit(most) for n, df in out.items()}
    expanded = {n: _naive(expand_all(df)) for n, df in out.items()}
    return {n: part for name, df in expanded.items() for n, part in extract(name, df)}
