"""Size-tiered compaction of immutable shards under a versioned manifest.

A store is a folder of any Hadoop file system. An append writes each arrival as a run: a folder
of small Parquet shards that are never changed. Runs whose sizes fall in the same tier (powers
of FANOUT) are merged, once there are FANOUT of them, into one run of shards of the target
size. A merge reads its runs and coalesces their scan tasks, one for each new shard: nothing is
shuffled. A version is committed by renaming its commit file to the version's number, which
fails if that exists, so readers see a version whole or not at all and of two writers one wins:
an append that loses commits again on top of the winner, a merge gives up. (On a store without an
atomic rename, one writer at a time has to be seen to otherwise.) The commit lists the runs; the
shards with their rows and bytes stand in a Parquet manifest beside it. All paths in both are
relative to the store's folder, which may be moved.

A writer marks its folder as staged before the first file and removes the mark after the commit;
vacuum() leaves staged folders alone until the mark is stale, which is when their writer must have
died, and deletes what no kept version names.

Defined results: rows are kept as they are, nulls, repeats and extra columns included; an empty
arrival is an empty store's schema and no run; a store without versions, and a version that has
been vacuumed, read as an error. A failed append or merge leaves files that no version names.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabloom.llm.common import scratch

TARGET_BYTES = 128 << 20
FANOUT = 4
SMALL_ROWS = 20_000
ARRIVALS = 8
_PART = "_tabloom_arrival"


#: Seconds after which a writer's mark no longer protects its folder.
STALE = 24 * 3600


class CommitConflict(RuntimeError):
    """Another writer has committed the version first."""


class VersionError(LookupError):
    """A version that was never committed or has been vacuumed."""


@dataclass(frozen=True)
class Run:
    path: str
    rows: int
    bytes: int
    shards: int

    def tier(self, base: int = 1 << 20, fanout: int = FANOUT) -> int:
        return max(0, math.floor(math.log(max(self.bytes, 1) / base, fanout))) if self.bytes >= base else 0


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT):
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def _listed(self, folder: str) -> list:
        at = self._path(f"{self.root}/{folder}")
        return list(self._fs.listStatus(at)) if self._fs.exists(at) else []

    # --- versions -------------------------------------------------------------------------

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._listed("_commits"))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0] != ".")

    def version(self) -> int:
        """The latest committed version; 0 if there is none."""
        return max(self.versions(), default=0)

    def _commit_of(self, version: int) -> dict:
        at = self._path(f"{self.root}/_commits/{version:08d}.json")
        if not self._fs.exists(at):
            raise VersionError(f"{self.root} has no version {version}")
        stream = self._fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def runs(self, version: int | None = None) -> list[Run]:
        v = self.version() if version is None else version
        return [Run(**r) for r in self._commit_of(v)["runs"]] if v else []

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, path, rows, bytes of each shard of a version."""
        v = version or self.version()
        return self.spark.read.parquet(f"{self.root}/{self._commit_of(v)['manifest']}")

    def _commit(self, version: int, runs: list[Run], shards: DataFrame | None, schema: StructType) -> None:
        at = f"_manifests/{version:08d}-{uuid.uuid4().hex}"
        shards = self.spark.createDataFrame([], "run string, path string, rows long, bytes long") if shards is None else shards
        shards.write.parquet(f"{self.root}/{at}")
        text = json.dumps({"version": version, "manifest": at, "schema": schema.jsonValue(), "runs": [asdict(r) for r in runs]})
        draft, final = self._path(f"{self.root}/_commits/.{uuid.uuid4().hex}"), self._path(f"{self.root}/_commits/{version:08d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf).rename(draft, final, none)
        except Exception as e:
            self._fs.delete(draft, False)
            raise CommitConflict(f"version {version} of {self.root} exists") from e

    # --- writing --------------------------------------------------------------------------

    def _staged(self, folder: str) -> object:
        """Marks folder as being written; the mark's path."""
        mark = self._path(f"{self.root}/_staged/{folder}")
        self._fs.create(mark, False).close()
        return mark

    def _measured(self, runs: list[str]) -> tuple[list[Run], DataFrame]:
        """Runs (relative paths) and their shards; footers are read, not data."""
        rows = self.spark.read.parquet(*(f"{self.root}/{r}" for r in runs))
        of = rows.metadataColumn("_metadata")  # also where the data has a column of that name
        rows = rows.select(of["file_path"].alias("path"), of["file_size"].alias("bytes"))
        shards = rows.groupBy("path", "bytes").agg(F.count("*").alias("rows")).withColumn("path", F.regexp_extract("path", r"data/[^/]+/[^/]+/[^/]+$", 0))
        shards = shards.select(F.regexp_replace("path", "/[^/]*$", "").alias("run"), "path", "rows", "bytes")
        each = shards.groupBy("run").agg(F.sum("rows").alias("r"), F.sum("bytes").alias("b"), F.count("*").alias("n"))
        return [Run(x.run, x.r, x.b, x.n) for x in each.orderBy("run").collect()], shards

    def append(self, rows: DataFrame, arrival: Column | None = None, small_rows: int = SMALL_ROWS) -> int:
        """Each value of arrival (one arrival if None) becomes a run; all are committed as one version."""
        folder = uuid.uuid4().hex
        mark = self._staged(folder)
        part = max([_PART, *(c + "_" for c in rows.columns if c.startswith(_PART))], key=len)
        named = rows.withColumn(part, F.lit(0) if arrival is None else arrival)
        named.write.option("maxRecordsPerFile", small_rows).partitionBy(part).parquet(f"{self.root}/data/{folder}")
        names = [s.getPath().getName() for s in self._listed(f"data/{folder}") if s.isDirectory()]
        new, shards = self._measured([f"data/{folder}/{n}" for n in names]) if names else ([], None)
        while True:
            version, old = self.version(), self.runs()
            every = shards
            if version:
                every = self.manifest(version) if shards is None else self.manifest(version).unionByName(shards)
            try:
                self._commit(version + 1, [*old, *new], every, rows.schema)
            except CommitConflict:
                continue  # appends commute
            self._fs.delete(mark, False)
            return version + 1

    def compact(self) -> int:
        """Merges while a tier holds enough runs; a run of target-sized shards alone in its tier rests."""
        while True:
            version = self.version()
            commit = self._commit_of(version)
            tiers: dict[int, list[Run]] = {}
            for r in self.runs(version):
                tiers.setdefault(r.tier(fanout=self.fanout), []).append(r)
            due = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fanout), None)
            if due is None:
                return version
            folder = uuid.uuid4().hex
            mark = self._staged(folder)
            files = max(1, round(sum(r.bytes for r in due) / self.target))
            schema = StructType.fromJson(commit["schema"])
            merged = self.spark.read.schema(schema).parquet(*(f"{self.root}/{r.path}" for r in due)).coalesce(files)
            merged.write.parquet(f"{self.root}/data/{folder}/merged")
            new, shards = self._measured([f"data/{folder}/merged"])
            kept = self.manifest(version).filter(~F.col("run").isin([r.path for r in due]))
            self._commit(version + 1, [r for r in self.runs(version) if r not in due] + new, kept.unionByName(shards), schema)
            self._fs.delete(mark, False)

    def vacuum(self, keep: int = 1, stale: float = STALE) -> int:
        """Drops all versions but the latest keep and the runs that only these named; returns how many
        runs went. Folders that a writer has staged stay until their mark is stale seconds old."""
        # in this order: a writer marks its folder before the first file and removes the mark after the commit
        written = [b.getPath().getName() for b in self._listed("data")]
        now, held = time.time(), set()
        for s in self._listed("_staged"):
            old = now - s.getModificationTime() / 1000 >= stale
            self._fs.delete(s.getPath(), False) if old else held.add(s.getPath().getName())
        versions = self.versions()
        live = {r.path for v in versions[-keep:] for r in self.runs(v)}
        for v in versions[:-keep]:
            manifest = self._commit_of(v)["manifest"]
            self._fs.delete(self._path(f"{self.root}/_commits/{v:08d}.json"), False)
            self._fs.delete(self._path(f"{self.root}/{manifest}"), True)
        n = 0
        for folder in written:
            for run in self._listed(f"data/{folder}") if folder not in held else []:
                if run.isDirectory() and f"data/{folder}/{run.getPath().getName()}" not in live:
                    self._fs.delete(run.getPath(), True)
                    n += 1
        return n

    # --- reading --------------------------------------------------------------------------

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version with _metadata of their shards at hand."""
        v = version or self.version()
        schema = StructType.fromJson(self._commit_of(v)["schema"])
        runs = self.runs(v)
        return self.spark.read.schema(schema).parquet(*(f"{self.root}/{r.path}" for r in runs)) if runs else self.spark.createDataFrame([], schema)


def arrival_of(doc_id: Column, arrivals: int = ARRIVALS) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(arrivals)).cast("int")


def shard(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Appends docs as ARRIVALS arrivals, compacts, and reads the committed version back: doc_id,
    n_bytes and digest (MD5) of the text, shard (number in its run) and shard_bytes. An arrival is
    what a group of scan tasks holds, so each task writes to one run alone."""
    store = ShardStore(docs.sparkSession, scratch(docs.sparkSession, "shards"), target_bytes)
    store.append(docs, F.pmod(F.spark_partition_id(), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    rows = store.read()
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = ["doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.md5(text).alias("digest")]
    if not store.runs():
        return rows.select(*cols, F.lit(0).alias("shard"), F.lit(0).cast("long").alias("shard_bytes"))
    of = rows.metadataColumn("_metadata")
    return rows.select(*cols, F.regexp_extract(of["file_name"], r"part-(\d+)", 1).cast("int").alias("shard"), of["file_size"].alias("shard_bytes"))
