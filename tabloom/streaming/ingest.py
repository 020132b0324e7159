"""Documents that keep arriving, as tables: new files in a folder, each read once.

These are Structured Streaming jobs with a checkpoint, so a restart goes on where it stopped and
a file's rows are written once. available_now ends when the folder has been caught up with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabloom.sources.xml import _RECORDS, _records

_FILES = "path string, modificationTime timestamp, length long, content binary"


def xml_records(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of tag and fields (map of strings) of each record of each new file."""
    files = spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.xml").load(folder)
    return files.select("path", "content").mapInArrow(_records, _RECORDS).select("tag", "fields")


def columns(records: DataFrame, names: list[str]) -> DataFrame:
    """The named fields as string columns; absent ones are null."""
    return records.select(*(F.try_element_at("fields", F.lit(n)).alias(n) for n in names))


def ingest(records: DataFrame, out: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends records to Parquet at out."""
    writer = records.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start(out)


def late_events(events: DataFrame, at: str, anchor: str, window: str = "1 hour", watermark: str = "1 day") -> DataFrame:
    """Per window of at: events, and those that precede their anchor; windows close behind the watermark."""
    timed = events.withWatermark(at, watermark)
    return timed.groupBy(F.window(at, window)).agg(F.count("*").alias("events"), F.count_if(F.col(at) < F.col(anchor)).alias("early"))
