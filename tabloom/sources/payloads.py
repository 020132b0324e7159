"""Columns out of JSON and XML text: payload expansion, flattening, extraction of nested lists.

What a column holds is decided by all its values. Schemas are inferred by Spark's JSON reader over
all values, inside the JVM; XML values go through one Arrow-batched function that yields flat maps
of strings.
"""

from __future__ import annotations

import json
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import chain, count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabloom.operators.stats import q
from tabloom.plans.spec import Table
from tabloom.sources.xml import flatten_record

_SPARK = {"int64": "bigint", "float64": "double", "string": "string", "bool": "boolean", "timestamp": "timestamp_ntz"}
INTEGER, STAMP = r"^[+-]?[0-9]+$", r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?)?$"


# --- typing of strings ---------------------------------------------------------------------


def _tests(x: Column) -> dict[str, Column]:
    """Whether a string reads as each type; the order is the order of preference."""
    return {
        "bigint": x.rlike(INTEGER) & x.try_cast("bigint").isNotNull(),
        "double": x.try_cast("double").isNotNull(),
        "boolean": x.isin("true", "false"),
        "timestamp_ntz": x.rlike(STAMP) & x.try_cast("timestamp_ntz").isNotNull(),
    }


def probe(df: DataFrame) -> DataFrame:
    """column, n, and for each type how many non-null strings don't read as it. One aggregate for all columns."""
    cells = [
        F.struct(F.lit(f.name).alias("column"), F.count(q(f.name)).alias("n"), *(F.count_if(q(f.name).isNotNull() & ~ok).alias(f"not_{k}") for k, ok in _tests(q(f.name)).items()))
        for f in df.schema if isinstance(f.dataType, T.StringType)
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def typed(df: DataFrame, only: tuple[str, ...] = ("bigint", "double", "boolean", "timestamp_ntz")) -> DataFrame:
    """df with string columns cast to the first type that all their values read as; no values: string."""
    if not any(isinstance(f.dataType, T.StringType) for f in df.schema):
        return df
    found = {r["column"]: next((k for k in only if r["n"] and not r[f"not_{k}"]), None) for r in probe(df).collect()}
    cast = lambda c, k: F.when(q(c) == "true", True).when(q(c) == "false", False) if k == "boolean" else q(c).cast(k)
    return df.select(*(cast(c, found[c]).alias(c) if found.get(c) else q(c) for c in df.columns))


def rescue_dates(df: DataFrame) -> DataFrame:
    """String columns all of whose values are dates or times, as timestamps."""
    return typed(df, ("timestamp_ntz",))


#: Forms of dates and times that lenient_dates tries in turn.
DATE_FORMS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy", "MM-dd-yyyy", "yyyyMMdd")


def lenient_dates(df: DataFrame, *columns: str, forms: tuple[str, ...] = DATE_FORMS) -> DataFrame:
    """df with the columns as timestamps by the first form that a value has, null where it has none."""
    read = lambda c: F.coalesce(*(F.try_to_timestamp(F.trim(q(c)), F.lit(form)) for form in forms)).cast("timestamp_ntz")
    return df.select(*(read(c).alias(c) if c in columns else q(c) for c in df.columns))


# --- structs and payloads ------------------------------------------------------------------


def flatten(df: DataFrame) -> DataFrame:
    """Struct fields as columns, recursively: by field name, or struct_field where that is taken."""
    while any(isinstance(f.dataType, T.StructType) for f in df.schema):
        taken = {f.name for f in df.schema if not isinstance(f.dataType, T.StructType)}
        out = []
        for f in df.schema:
            if not isinstance(f.dataType, T.StructType):
                out.append(q(f.name))
                continue
            for g in f.dataType.fields:
                name = g.name if g.name not in taken else f"{f.name}_{g.name}"
                taken.add(name)
                out.append(q(f.name).getField(g.name).alias(name))
        df = df.select(*out)
    return df


@F.pandas_udf(T.BooleanType())
def _is_xml(texts: pd.Series) -> pd.Series:
    def parses(t: str | None) -> bool:
        try:
            return t is not None and ET.fromstring(t) is not None
        except ET.ParseError:
            return False

    return texts.map(parses).astype(bool)


def payload_kinds(df: DataFrame) -> dict[str, str]:
    """The string columns that hold documents only, json or xml: there are values, and each is an
    object or an element. One aggregate for all columns; XML is parsed only where all values look like it."""
    strings = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    if not strings:
        return {}
    json_ = lambda x: F.when(x.startswith("{"), F.schema_of_variant(F.try_parse_json(x)).startswith("OBJECT")).otherwise(False)
    tests = {"n": F.count, "json": lambda x: F.count_if(json_(F.trim(x))), "xml": lambda x: F.count_if(F.trim(x).startswith("<") & F.trim(x).endswith(">"))}
    row = df.agg(*(t(q(c)).alias(f"{k}{i}") for i, c in enumerate(strings) for k, t in tests.items())).first()
    held = {k: [c for i, c in enumerate(strings) if row[f"n{i}"] and row[f"n{i}"] == row[f"{k}{i}"]] for k in ("json", "xml")}
    broken = df.agg(*(F.count_if(q(c).isNotNull() & ~_is_xml(q(c))).alias(f"b{i}") for i, c in enumerate(held["xml"]))).first() if held["xml"] else []
    return dict.fromkeys(held["json"], "json") | {c: "xml" for c, b in zip(held["xml"], broken, strict=True) if not b}


def json_schema(df: DataFrame, column: str) -> T.StructType:
    """What all values of column hold."""
    spark = df.sparkSession
    values = df.select(q(column).cast("string").alias("value")).filter("value IS NOT NULL")._jdf
    return T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(getattr(values, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())).schema().json()))


def _merge(df: DataFrame, drop: str, made: Column, kind: T.StructType) -> DataFrame:
    """df with the fields of made in place of column drop, under names that no column has."""
    kept = [c for c in df.columns if c != drop]
    names: dict[str, str] = {}
    for f in kind.fields:
        tries = chain([f.name, f"{drop}_{f.name}"], (f"{drop}_{f.name}_{i}" for i in count(2)))
        names[f.name] = next(n for n in tries if n not in kept and n not in names.values())
    inner = df.withColumn("__payload", made)
    return inner.select(*map(q, kept), *(F.col("__payload").getField(a).alias(b) for a, b in names.items()))


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def _xml_map(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else {k: v for k, v in flatten_record(ET.fromstring(t)).items() if v is not None})


def _xml_fields(df: DataFrame, column: str) -> list[str]:
    keys = df.select(F.explode(F.map_keys(_xml_map(q(column)))).alias("k")).distinct()
    return sorted(r["k"] for r in keys.collect())


def expand(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with column replaced by what its documents hold, flattened and typed."""
    if kind == "json":
        schema = json_schema(df, column)
        return rescue_dates(flatten(_merge(df, column, F.from_json(q(column), schema), schema)))
    names = _xml_fields(df, column)
    struct = T.StructType([T.StructField(n, T.StringType()) for n in names])
    wide = df.withColumn("__map", _xml_map(q(column)))
    made = F.struct(*(F.get(F.array(F.col("__map")[n]), F.lit(0)).alias(n) for n in names)) if names else F.struct(F.lit(None).alias("_"))
    out = _merge(wide, column, made, struct).drop("__map")
    strings = [n if n in out.columns else f"{column}_{n}" for n in names]
    new = typed(out.select(*strings))
    casts = {f.name: f.dataType.simpleString() for f in new.schema}
    return out.select(*((F.when(q(c) == "true", True).when(q(c) == "false", False).alias(c) if casts[c] == "boolean" else q(c).cast(casts[c]).alias(c)) if c in casts else q(c) for c in out.columns))


def expand_all(df: DataFrame) -> DataFrame:
    """Every string column of documents expanded."""
    for c, kind in payload_kinds(df).items():
        df = expand(df, c, kind)
    return df


def fill_from_payloads(t: Table, df: DataFrame) -> DataFrame:
    """df with the columns of t that only its document columns hold. JSON gives top-level keys,
    XML leaves; a malformed document raises when it is read."""
    for c in t.columns.values():
        if c.document is None or c.name not in df.columns:
            continue
        wanted = [n for n in t.payload_columns(c.name) if n not in df.columns]
        if not wanted:
            continue
        if c.document.kind == "json":
            schema = T.StructType([T.StructField(n, T.StringType()) for n in wanted])
            df = df.withColumn("__doc", F.from_json(q(c.name), schema, {"mode": "FAILFAST"}))
            get = lambda n: F.col("__doc").getField(n)
        else:
            df = df.withColumn("__doc", _xml_map(q(c.name)))
            get = lambda n: F.try_element_at(F.col("__doc"), F.lit(n))
        df = df.select("*", *(get(n).cast(_SPARK[t.columns[n].type]).alias(n) for n in wanted)).drop("__doc")
    return df


# --- nested lists --------------------------------------------------------------------------


def _keys(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if (f.name == "id" or f.name.endswith("_id")) and not isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType))]


def extract(name: str, df: DataFrame) -> Iterator[tuple[str, DataFrame]]:
    """The table without its lists of records, and each list as a table of its own.

    Rows of a list get the id-like columns of the row that held them, as parent_column where the
    name is taken; lists inside lists follow in turn.
    """
    lists = [f for f in df.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    yield name, df.drop(*(f.name for f in lists))
    for f in lists:
        fields = {g.name for g in f.dataType.elementType.fields}
        above = {c: c if c not in fields else f"{name}_{c}" for c in _keys(df)}
        rows = df.select(*(q(c).alias(n) for c, n in above.items()), F.explode(q(f.name)).alias("__item")).filter("__item IS NOT NULL")
        inner = rows.select(*above.values(), *(F.col("__item").getField(g).alias(g) for g in [x.name for x in f.dataType.elementType.fields]))
        yield from extract(f.name, flatten(inner))
