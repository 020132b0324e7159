"""XML files as tables: records are the root's direct children, read one at a time.

A file is opened where it lies and parsed by one task, element by element, so memory follows the
largest record and a batch of rows, not the file; many files are spread over tasks by their sizes.
Stores that Arrow's file systems don't reach are read through Spark instead, a file at a time.
Values are strings until they are typed. Columns stand in the order in which records first have
them, files by name.
"""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.operators.stats import q

BATCH_ROWS = 8192
#: Schemes that Arrow opens by itself, and the names that it knows them by.
OPENED = {"file": "file", "hdfs": "hdfs", "s3": "s3", "s3a": "s3", "gs": "gs"}


class EmptySource(FileNotFoundError):
    """A place without records to read."""


def local(tag: str) -> str:
    """A tag without its namespace or prefix."""
    return tag.rsplit("}", 1)[-1].rsplit(":", 1)[-1]


def _leaves(el: ET.Element) -> Iterator[tuple[str, str, str | None]]:
    """owner, name, text of what el holds: the names of a child with children are those of its own flat
    record, owned by the child; a leaf is owned by el."""
    for child in el:
        if not isinstance(child.tag, str):
            continue  # a comment or an instruction
        if len(child):
            yield from ((local(child.tag), n, t) for n, t in flatten_record(child).items())
        else:
            yield local(el.tag), local(child.tag), (child.text or "").strip() or None


def flatten_record(record: ET.Element) -> dict[str, str | None]:
    """Leaf texts by name; a name that is taken at some level becomes owner_name there, one that is taken
    again is replaced. Blank texts are None, attributes and text between elements are ignored."""
    out: dict[str, str | None] = {}
    for owner, name, text in _leaves(record):
        out[name if name not in out else f"{owner}_{name}"] = text
    return out


def iter_records(source: object) -> Iterator[ET.Element]:
    """The root's children, each freed after it has been used."""
    depth, root = 0, None
    for event, el in ET.iterparse(source, events=("start", "end")):
        if event == "start":
            depth += 1
            root = el if root is None else root
        else:
            depth -= 1
            if depth == 1:
                yield el
                root.remove(el)



def _opened(source: object) -> object:
    """A stream of a file's bytes, by its URI; content that Spark has read comes as bytes."""
    if isinstance(source, bytes):
        return io.BytesIO(source)
    scheme, _, rest = source.partition(":")
    system, path = pyarrow.fs.FileSystem.from_uri(f"{OPENED[scheme]}://{rest.removeprefix('//')}" if rest.startswith("//") else f"{OPENED[scheme]}://{rest}")
    return system.open_input_stream(path, buffer_size=1 << 20)


def _sources(b: pa.RecordBatch) -> Iterator[tuple[str, Iterator[ET.Element]]]:
    """Path and records of each file of a batch of (path) or (path, content)."""
    held = b.column(1) if b.num_columns > 1 else b.column(0)
    for path, source in zip(b.column(0).to_pylist(), held, strict=True):
        with _opened(source.as_py()) as stream:
            yield path, iter_records(stream)


_RECORDS = "path string, row long, tag string, fields map<string,string>"


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.map_(pa.string(), pa.string())

    def pack(path: str, first: int, tags: list[str], maps: list[list]) -> pa.RecordBatch:
        rows = pa.array(range(first, first + len(tags)), pa.int64())
        return pa.record_batch([pa.array([path] * len(tags), pa.string()), rows, pa.array(tags, pa.string()), pa.array(maps, kind)], names=["path", "row", "tag", "fields"])

    for b in batches:
        for path, records in _sources(b):
            first, tags, maps = 0, [], []
            for el in records:
                tags.append(local(el.tag))
                maps.append(list(flatten_record(el).items()))
                if len(maps) == BATCH_ROWS:
                    yield pack(path, first, tags, maps)
                    first, tags, maps = first + len(maps), [], []
            yield pack(path, first, tags, maps)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """path (and content where executors can't open it) of an .xml file or of those of a folder."""
    reader = spark.read.format("binaryFile")
    reader = reader if path.lower().endswith(".xml") else reader.option("pathGlobFilter", "*.xml")
    found = reader.load(path)
    first = found.select("path").first()
    if first is None:
        raise EmptySource(f"no .xml files in {path}")
    return found.select("path") if first[0].partition(":")[0] in OPENED else found.select("path", "content")


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """path, row (in its file), tag, fields (map of strings) of each record of a file or of all files of a folder."""
    return _files(spark, path).mapInArrow(_records, _RECORDS)


def _wide(found: DataFrame, place: str) -> DataFrame:
    """The fields as columns, in order of their first appearance. A record's place in its file is one
    number, row and position, since Spark sorts all rows of a task for a smallest string or struct;
    those are compared once a file and name."""
    keys = found.select("path", "row", F.posexplode(F.map_keys("fields")).alias("at", "k"))
    first = keys.groupBy("path", "k").agg(F.min(F.shiftleft("row", 24) + F.col("at")).alias("place"))
    seen = first.groupBy("k").agg(F.min(F.struct("path", "place")).alias("first"))
    names = [r["k"] for r in seen.orderBy("first").select("k").collect()]
    if not names:
        raise EmptySource(f"{place} holds no records with fields")
    return found.select(*(F.try_element_at("fields", F.lit(n)).alias(n) for n in names))


def read(spark: SparkSession, path: str, types: bool = True) -> DataFrame:
    """One row per record; columns are all names that occur, absent ones null."""
    from tabloom.sources.payloads import typed

    out = _wide(raw_records(spark, path), path)
    return typed(out) if types else out


def count(spark: SparkSession, path: str) -> int:
    """Records, without keeping any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array([sum(1 for _ in records) for _, records in _sources(b)], pa.int64())], names=["n"])

    return _files(spark, path).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def _split(record: ET.Element, lists: set[str], name: str, keys: dict[str, str]) -> Iterator[tuple[str, dict[str, str | None]]]:
    """The record's row, then the rows of its nested records, which get its ids."""
    nested = [c for c in record if local(c.tag) in lists]
    own = ET.Element(record.tag)
    own.extend(c for c in record if c not in nested)
    row = flatten_record(own)
    for k, v in keys.items():
        row[k if k not in row else f"{name}_{k}"] = v
    ids = {k: v for k, v in row.items() if (k == "id" or k.endswith("_id")) and v is not None}
    yield name, row
    for c in nested:
        if not len(c):
            continue  # a container without records
        items = list(c) if len({x.tag for x in c}) == 1 and all(len(x) for x in c) else [c]
        for item in items:
            yield from _split(item, lists, local(c.tag), ids)


def list_tags(path_records: DataFrame | Iterator[ET.Element]) -> set[str]:
    """Tags that hold nested records: repeated ones whose every occurrence has children, or one
    container of records of one tag."""
    repeated, containers, plain = set(), set(), set()

    def look(el: ET.Element) -> None:
        times = Counter(local(c.tag) for c in el)
        for c in el:
            tag = local(c.tag)
            if times[tag] > 1 and len(c):
                repeated.add(tag)
            elif len(c) and len({x.tag for x in c}) == 1 and all(len(x) for x in c):
                containers.add(tag)
            elif not len(c) and times[tag] > 1:
                plain.add(tag)
            for x in c if tag in containers else [c]:
                look(x)

    for r in path_records:
        look(r)
    return (repeated - plain) | containers


def read_entities(spark: SparkSession, path: str, name: str) -> dict[str, DataFrame]:
    """The records of path as table name, and their nested records as tables of their own."""
    from tabloom.sources.payloads import typed

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sorted({t for _, records in _sources(b) for t in list_tags(records)})
            yield pa.record_batch([pa.array(found, pa.string())], names=["tag"])

    files = _files(spark, path)
    lists = {r["tag"] for r in files.mapInArrow(tags, "tag string").distinct().collect()}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.string(), pa.string())
        for b in batches:
            for place, records in _sources(b):
                held: list[tuple[int, str, list]] = []

                def pack() -> pa.RecordBatch:
                    return pa.record_batch([pa.array([place] * len(held), pa.string()), pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([h[2] for h in held], kind)], names=["path", "row", "tag", "fields"])  # noqa: B023

                for i, el in enumerate(records):
                    held += [(i, t, list(r.items())) for t, r in _split(el, lists, name, {})]
                    if len(held) >= BATCH_ROWS:
                        yield pack()
                        held = []
                yield pack()

    found = files.mapInArrow(rows, _RECORDS)
    return {t: typed(_wide(found.filter(q("tag") == t), path)) for t in [name, *sorted(lists - {name})]}


def ingest(spark: SparkSession, path: str, out: str, types: bool = True) -> DataFrame:
    """The records of path as Parquet at out. Strings are written once and cast from there."""
    from tabloom.sources.payloads import typed

    if not types:
        read(spark, path, False).write.mode("overwrite").parquet(out)
        return spark.read.parquet(out)
    jvm = spark.sparkContext._jvm
    staged = f"{out.rstrip('/')}.staging"
    try:
        read(spark, path, False).write.mode("overwrite").parquet(staged)
        typed(spark.read.parquet(staged)).write.mode("overwrite").parquet(out)
    finally:
        p = jvm.org.apache.hadoop.fs.Path(staged)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.parquet(out)
