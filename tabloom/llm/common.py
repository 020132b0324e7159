"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word of the plain kind: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: A word of the alphanumeric kind, after ASCII lower-casing.
ALNUM_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows and bytes up to which a side is broadcast; beyond either the join shuffles.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. A local master (tests) gets one of its own where that is
    unset; on a cluster, where executors don't share local disks, that is an error."""
    context = spark.sparkContext
    if found := spark.conf.get("spark.checkpoint.dir", None):
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found
    if kept := context.getCheckpointDir():
        return kept
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tabloom-')}")
    return context.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's Python ends."""
    path = f"{shared_dir(spark)}/tabloom-{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # the JVM may have gone already
            return


#: Shuffle files of a write are of no use after it; Spark removes them at its end where this is set.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, lost executors lose nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: it is bound as a lambda's variable.

    Catalyst would otherwise inline value at each place of use, inside lambdas once per element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def plain_words(text: Column) -> Column:
    """Array of the words of WORD; null text gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else. lower() is the fast way where all characters are ASCII."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def alnum_words(text: Column) -> Column:
    """Array of the words between ALNUM_GAP runs of the lower-cased text; null text gives none."""
    return F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_GAP), lambda w: w != "")


def _bytes(df: DataFrame) -> Column:
    """About what a row of df takes: eight bytes for a plain column, what it holds for others."""
    total = F.lit(0).cast("long")
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        match f.dataType:
            case T.StringType() | T.BinaryType():
                total += F.coalesce(F.octet_length(c), F.lit(0)) + 8
            case T.ArrayType(elementType=T.StringType()):
                total += F.coalesce(F.octet_length(F.array_join(c, " ")), F.lit(0)) + 8 * F.greatest(F.size(c), F.lit(1))
            case T.ArrayType():
                total += 8 * F.greatest(F.size(c), F.lit(1))
            case _:
                total += 8
    return total


def maybe_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes, else as it is. df should be
    stored: rows are counted in its files' footers, and bytes only if the rows are few enough."""
    n = df.count()
    fits = n == 0 or (n <= rows and df.agg(F.sum(_bytes(df))).first()[0] <= size)
    return F.broadcast(df) if fits else df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs with its columns folded into one, _row, beside keys made from them; so no name of docs can
    clash with a key's. unfolded() is the way back."""
    return docs.select(F.struct(*map(quoted, docs.columns)).alias("_row"), *(k.alias(n) for n, k in keys.items()))


def unfolded(rows: DataFrame) -> DataFrame:
    return rows.select("_row.*")


def text_key(text: str = "text") -> Column:
    """64-bit hash of the text, null as empty; with doc_id it tells apart the texts under one id."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def except_keys(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of docs whose (doc_id, text) is none of gone (doc_id, text_key; stored)."""
    rows = as_row(docs, _doc=F.col("doc_id"), _key=text_key())
    return unfolded(rows.join(maybe_broadcast(gone), F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_key") == F.col("text_key")), "left_anti"))
