"""Mixing sources to target weights.

Each document gets a hash-random key. Within a source, documents are range-sorted by that
key: the key space is cut into equal ranges (chunks of about CHUNK documents), totals of the
chunks give each chunk's offset, and a window inside a chunk gives the distributed prefix
sums. A source is cut at its exact budget: whole epochs of all its documents, then the prefix
that fills the rest; the document at the cut gives its first words only. Text is read once
and never shuffled.

Defined results: null text has size 0; a null source is a source of its own, last in order;
sources without words get target 0; ties of the key are ordered by doc_id and a hash of the
text, and rows equal in all of these share one outcome up to their order; an empty table
gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import WORD, maybe_broadcast, stored

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
CHUNK = 4096
SEED = "mix-1"


def random_key(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash bits of seed and doc_id as a long; md5, so that any engine can repeat it."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """One row per source: sid (order by code point, null last), source_size, n_docs, target.

    Targets are water-filling: target = min(most * size, weight * level). With sources ordered
    by cap / weight, the level is the largest of (all - caps before) / (weights not before);
    it is what resharing the excess until none is above converges to. Windows here run over
    one row per source, not over documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    per = per.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1)
    per = per.withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    before = Window.orderBy(F.col("cap") / F.col("w"), "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return per.select("source", "sid", "source_size", "n_docs", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def allot(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """sized (doc_id, source, size, key, tie and any others) with source_size, target and taken."""
    sources = stored(source_targets(sized, weights, most), "sources")
    s = maybe_broadcast(sources.withColumnRenamed("source", "_s"))
    bucket = F.floor(F.col("key").cast("double") / float(1 << 60) * F.ceil(F.col("n_docs") / CHUNK)).cast("long")
    d = sized.join(s, F.col("source").eqNullSafe(F.col("_s"))).withColumn("chunk", bucket)
    sums = d.groupBy("sid", "chunk").agg(F.sum("size").alias("_sum"))
    at = Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "chunk", F.coalesce(F.sum("_sum").over(at), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("sid", "chunk").orderBy("key", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.floor(F.col("target") - full * F.col("source_size"))
    taken = full * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - start))
    return d.join(offsets, ["sid", "chunk"]).withColumn("taken", taken.cast("long")).drop("_s", "sid", "chunk", "_offset", "n_docs")


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, key and tie of each document, written once so that text is read once."""
    return stored(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), random_key(F.col("doc_id"), seed).alias("key"), F.xxhash64("text").alias("tie")), "sized")


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken."""
    return allot(sized(docs)).select("doc_id", "size", "source_size", "target", "taken")


def first_words(text: Column, n: Column) -> Column:
    """text up to the end of its n-th word, white space as it stands."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), F.lit(1), n), "")


def cuts(plan: DataFrame) -> DataFrame:
    """One row per source of an allotment that mixes whole epochs and a prefix: source, full
    (epochs), and the place of the cut: its key, doc_id and tie, and the words that a row there
    gives (rows equal in all three share what is left evenly)."""
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    part = plan.withColumn("full", full).withColumn("over", F.col("taken") - F.col("full") * F.col("size"))
    # the cut is the last place, in order of the keys, that gives anything beyond whole epochs
    at = F.struct("key", "doc_id", "tie")
    per = part.groupBy("source").agg(F.max("full").alias("full"), F.max(F.when(F.col("over") > 0, at)).alias("at"))
    s = per.select(F.col("source").alias("_s"), F.col("full").alias("_full"), F.col("at").alias("_at"))
    equal = part.join(s, F.col("source").eqNullSafe(F.col("_s"))).filter(at == F.col("_at")).groupBy("source").agg(F.floor(F.sum("over") / F.count("*")).alias("words"))
    return per.join(equal.select(F.col("source").alias("_e"), "words"), F.col("source").eqNullSafe(F.col("_e")), "left").select("source", "full", "at", "words")


def materialise(docs: DataFrame) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each epoch of a document; what a document
    at a source's cut gives beyond whole epochs is its first words. Documents without words are left
    out. Each row is decided by its source's cut alone: texts are neither shuffled nor joined by id."""
    cols = docs.columns
    cut = stored(cuts(allot(sized(docs))), "cuts").select(F.col("source").alias("_s"), "full", "at", "words")
    row = F.struct(*(F.col(f"`{c}`") for c in cols)).alias("_row")
    at = F.struct(random_key(F.col("doc_id")).alias("key"), F.col("doc_id"), F.xxhash64("text").alias("tie"))
    held = docs.filter(F.col("text").rlike(WORD)).select(row, at.alias("_at"), F.col("source").alias("_source"))
    both = held.join(maybe_broadcast(cut), F.col("_source").eqNullSafe(F.col("_s")))
    # 0: a whole epoch; else the first words of the text
    last = F.when(F.col("_at") < F.col("at"), F.array(F.lit(0))).when((F.col("_at") == F.col("at")) & (F.col("words") > 0), F.array(F.col("words").cast("int"))).otherwise(F.array().cast("array<int>"))
    epochs = F.concat(F.array_repeat(F.lit(0), F.col("full").cast("int")), last)
    out = both.select("_row", F.explode(epochs).alias("_words"))
    text = F.when(F.col("_words") > 0, first_words(F.col("_row.text"), F.col("_words"))).otherwise(F.col("_row.text"))
    fixed = {"text": text} | ({"n_chars": F.when(F.col("_words") > 0, F.length(text)).otherwise(F.col("_row.n_chars")).cast(docs.schema["n_chars"].dataType)} if "n_chars" in cols else {})
    return out.select(*((fixed[c] if c in fixed else F.col("_row")[c]).alias(c) for c in cols))
