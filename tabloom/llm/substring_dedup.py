"""Removal of repeated passages by fixed-block anchors.

A window of WIDTH words holds a whole block of the non-overlapping blocks of its document,
if blocks have (WIDTH + 1) // 2 words. So:

1. Blocks are indexed; every rolling window of block length, of every document, probes them. A
   block whose words also stand at another place is an anchor. Probes travel as sorted hash
   arrays, one for each hash range and chunk of documents, in which a hash stands at most twice:
   a passage that a third of all documents share is sent once or twice a chunk. The number of
   ranges and of their partitions follows the words of the corpus, so no task's share grows with it.
2. Hits are extended: the windows of WIDTH words around anchors are hashed in turn, and those
   met at two or more places are repeats; runs of them are the maximal exact repeats. Here too a
   hash travels once for a chunk of documents, and the repeated ones come back as a list a chunk.
3. Words under them go; documents without repeats are never looked at again.

Documents of equal word sequences form a class. A class of several has every window elsewhere,
so all its words go if it has WIDTH; only one of it takes part in step 2. Windows are known by
64-bit hashes of their words.

Joins of texts are on doc_id and a 64-bit hash of the text with the list of documents that hold
anchors, which is broadcast while its rows and bytes are few and shuffled beyond.

Defined results: null or empty text has no words and keeps none (digest of the empty string);
rows are documents, so a row that is repeated is a copy; doc_id may be null or repeated. An empty
table gives an empty one. Extra columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.llm.common import as_row, maybe_broadcast, stored, text_key, unfolded
from tabloom.llm.hashing import WordHasher, windows

WIDTH = 35
#: Words whose probes are sorted and sent together.
CHUNK = 1_000_000
#: Hash ranges at least, and for each partition of probes; probes of a partition, about.
RANGES, RANGES_EACH = 1024, 8
PROBES = 4_000_000


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    values = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _sequence_key(h: np.ndarray) -> tuple[int, int]:
    d = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def _base(block: int):
    """Per document: its sequence key, words, digest of all words, hashes of its blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            keys, n, sha, blocks = [], [], [], []
            for text in _column(b, "text"):
                words = (text or b"").split()
                h = hasher(words)
                keys.append(_sequence_key(h))
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
                blocks.append((windows(h, block)[::block] & ~np.uint64(1)).view(np.int64))
            yield pa.record_batch([b.column(0), b.column(2), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array(n, pa.int64()), pa.array(sha), _lists(blocks, pa.int64())], names=["doc_id", "text_key", "k1", "k2", "n_words", "sha", "blocks"])

    return run


def _probes(block: int, ranges: int):
    """Hash arrays of all rolling windows, by range; the lowest bit tells those that are blocks."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def pack(parts: list[np.ndarray]) -> pa.RecordBatch:
        h, count = np.unique(np.concatenate(parts), return_counts=True)
        h = np.repeat(h, np.minimum(count, 2))
        where, first = np.unique(h >> shift, return_index=True)
        offsets = np.concatenate([first, [len(h)]]).astype(np.int32)
        return pa.record_batch([pa.array(where.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(h.view(np.int64)))], names=["range", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, parts, held = WordHasher(), [], 0
        for b in batches:
            for text in _column(b, "text"):
                h = windows(hasher((text or b"").split()), block) & ~np.uint64(1)
                if not len(h):
                    continue
                h[::block] |= np.uint64(1)
                parts.append(h)
                held += len(h)
                if held >= CHUNK:
                    yield pack(parts)
                    parts, held = [], 0
        if parts:
            yield pack(parts)

    return run


def _extend(width: int, block: int):
    """Hashes of the windows around a document's anchors, with their places; each class once in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen = WordHasher(), set()
        for b in batches:
            k1, k2, at, found = [], [], [], []
            for key1, key2, text, anchors in zip(*(_column(b, c) for c in ("k1", "k2", "text", "anchors")), strict=True):
                h = hasher((text or b"").split())
                if len(h) < width or (key1, key2) in seen or _sequence_key(h) != (key1, key2):
                    continue  # a repeated row, or another text of the same doc_id and hash
                seen.add((key1, key2))
                last = len(h) - width
                starts = (np.asarray(anchors)[:, None] * block - np.arange(width - block + 1)[None, :]).ravel()
                starts = np.unique(starts[(starts >= 0) & (starts <= last)])
                k1.append(key1)
                k2.append(key2)
                at.append(starts.astype(np.int32))
                found.append(windows(h, width)[starts].view(np.int64))
            yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(at, pa.int32()), _lists(found, pa.int64())], names=["k1", "k2", "at", "hashes"])

    return run


_CHUNKED = "chunk long, k1 long, k2 long, at array<int>, hashes array<long>, twice array<long>"


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with the number of their chunk, about CHUNK windows of a task, and for each
    chunk a row without a place: its distinct hashes, and those that it holds more than once."""
    number, held, size, base = 0, [], 0, None

    def total() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        none, empty = pa.array([None], pa.int64()), pa.array([None], pa.list_(pa.int32()))
        return pa.record_batch([pa.array([base + number], pa.int64()), none, none, empty, _lists([h], pa.int64()), _lists([h[n > 1]], pa.int64())], names=["chunk", "k1", "k2", "at", "hashes", "twice"])

    for b in batches:
        hashes, chunks = b.column(b.schema.get_field_index("hashes")), []
        full = []
        for i in range(b.num_rows):
            base = b.column(0)[i].as_py() << 32
            held.append(hashes[i].values.to_numpy())
            size += len(held[-1])
            chunks.append(base + number)
            if size >= CHUNK:
                full.append(total())
                number, held, size = number + 1, [], 0
        none = pa.array([None] * b.num_rows, pa.list_(pa.int64()))
        yield pa.record_batch([pa.array(chunks, pa.int64()), *(b.column(b.schema.get_field_index(c)) for c in ("k1", "k2", "at", "hashes")), none], names=["chunk", "k1", "k2", "at", "hashes", "twice"])
        yield from full
    if held:
        yield total()


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, of each chunk its repeated hashes first: the places of repeated windows of each document."""
    chunk, repeated = None, np.empty(0, np.int64)
    for b in batches:
        cols = {n: b.column(b.schema.get_field_index(n)) for n in ("at", "hashes")}
        k1, k2, starts = [], [], []
        for i, (c, first, a, z) in enumerate(zip(*(_column(b, n) for n in ("chunk", "first", "k1", "k2")), strict=True)):
            h = cols["hashes"][i].values.to_numpy()
            if first:
                chunk, repeated = c, np.sort(h)
            elif c == chunk and len(repeated) and len(h):
                hit = repeated[np.minimum(np.searchsorted(repeated, h), len(repeated) - 1)] == h
                if hit.any():
                    k1.append(a)
                    k2.append(z)
                    starts.append(cols["at"][i].values.to_numpy()[hit])
        yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), _lists(starts, pa.int32())], names=["k1", "k2", "starts"])


def _cut(width: int):
    """What is left of a document without the words under its repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for b in batches:
            k1, k2, gone, kept = [], [], [], []
            for key1, key2, text, starts in zip(*(_column(b, c) for c in ("k1", "k2", "text", "starts")), strict=True):
                words = (text or b"").split()
                if _sequence_key(hasher(words)) != (key1, key2):
                    continue  # another text of the same doc_id and hash
                k1.append(key1)
                k2.append(key2)
                edge = np.zeros(len(words) + 1, np.int64)
                s = np.unique(np.asarray(starts))
                np.add.at(edge, s, 1)
                np.add.at(edge, s + width, -1)
                under = np.cumsum(edge)[:-1] > 0
                gone.append(int(under.sum()))
                kept.append(b" ".join(w for w, u in zip(words, under.tolist(), strict=True) if not u))
            sha = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.record_batch([pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary()).cast(pa.string())], names=["k1", "k2", "n_removed", "kept_sha", "kept"])

    return run


def _find(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """base (a row per document: doc_id, text_key, k1, k2, n_words, sha) and changed (k1, k2, copied,
    n_removed, kept_sha, kept): the classes that lose words; copied ones lose all."""
    spark, block = docs.sparkSession, (width + 1) // 2
    read = docs.select("doc_id", F.col("text").cast("binary").alias("text"), text_key().alias("text_key"))
    base = stored(read.mapInArrow(_base(block), "doc_id long, text_key long, k1 long, k2 long, n_words long, sha string, blocks array<long>"), "base")
    words = base.agg(F.sum("n_words")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // PROBES))
    ranges = max(RANGES, 1 << (RANGES_EACH * parts - 1).bit_length())
    probes = read.select("text").mapInArrow(_probes(block, ranges), "range int, hashes array<long>").repartition(parts, "range")
    each = probes.select("range", F.explode("hashes").alias("h")).select("range", F.col("h").bitwiseAND(F.lit(-2).cast("long")).alias("block"), F.col("h").bitwiseAND(F.lit(1).cast("long")).alias("own"))
    met = each.groupBy("range", "block").agg(F.count("*").alias("n"), F.max("own").alias("own")).filter("n > 1 AND own = 1")
    anchors = maybe_broadcast(stored(met.select("block"), "anchors"))

    whole = base.filter(F.col("n_words") >= width)
    one = F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "text_key")).alias("one")
    grouped = whole.groupBy("k1", "k2").agg(F.count("*").alias("copies"), one, F.first("blocks").alias("blocks"))
    classes = stored(grouped.select("k1", "k2", "copies", "one.doc_id", "one.text_key", "blocks"), "classes")
    hits = classes.select("k1", "k2", "doc_id", "text_key", F.posexplode("blocks").alias("pos", "block")).join(anchors, "block", "left_semi")
    held = stored(hits.groupBy("k1", "k2", "doc_id", "text_key").agg(F.collect_list("pos").alias("anchors")), "hits")
    named = maybe_broadcast(held.withColumnsRenamed({"doc_id": "_doc", "text_key": "_key"}))
    texts = stored(read.join(named, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("k1", "k2", "text", "anchors"), "texts")
    starts = _starts(texts, classes, width, block)
    cut = texts.select("k1", "k2", "text").join(maybe_broadcast(starts), ["k1", "k2"]).mapInArrow(_cut(width), "k1 long, k2 long, n_removed long, kept_sha string, kept string")
    copied = classes.filter("copies > 1").select("k1", "k2", F.lit(True).alias("copied"), F.lit(0).cast("long").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha"), F.lit("").alias("kept"))
    changed = cut.select("k1", "k2", F.lit(False).alias("copied"), "n_removed", "kept_sha", "kept").unionByName(copied)
    return base.drop("blocks"), stored(changed, "changed")


def _starts(texts: DataFrame, classes: DataFrame, width: int, block: int) -> DataFrame:
    """k1, k2, starts: places of the repeated windows of the classes of one. Stored."""
    around = texts.mapInArrow(_extend(width, block), "k1 long, k2 long, at array<int>, hashes array<long>").dropDuplicates(["k1", "k2"])
    chunked = stored(around.select(F.spark_partition_id().cast("long").alias("task"), "k1", "k2", "at", "hashes").mapInArrow(_chunked, _CHUNKED), "windows")
    sums = chunked.filter("twice IS NOT NULL")
    each = sums.select("chunk", F.explode("hashes").alias("h"), F.lit(1).alias("n")).unionByName(sums.select("chunk", F.explode("twice").alias("h"), F.lit(1).alias("n")))
    repeated = stored(each.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h"), "repeated")
    back = sums.select("chunk", F.explode("hashes").alias("h")).join(repeated, "h").groupBy("chunk").agg(F.collect_list("h").alias("hashes"))
    # a class of several needs no places: all its words go
    single = classes.filter("copies = 1").select("k1", "k2")
    rows = chunked.filter("twice IS NULL").join(single, ["k1", "k2"], "left_semi").select("chunk", F.lit(False).alias("first"), "k1", "k2", "at", "hashes")
    none = F.lit(None)
    lists = back.select("chunk", F.lit(True).alias("first"), none.cast("long").alias("k1"), none.cast("long").alias("k2"), none.cast("array<int>").alias("at"), "hashes")
    dealt = lists.unionByName(rows).repartition("chunk").sortWithinPartitions("chunk", F.desc("first"))
    return stored(dealt.mapInArrow(_marked, "k1 long, k2 long, starts array<int>"), "starts")


def digest(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each row of docs."""
    base, changed = _find(docs, width)
    told = stored(changed.select(F.col("k1").alias("_1"), F.col("k2").alias("_2"), "copied", "n_removed", "kept_sha"), "told")
    out = base.join(maybe_broadcast(told), (F.col("k1") == F.col("_1")) & (F.col("k2") == F.col("_2")), "left")
    gone = F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long")))
    return out.select("doc_id", "n_words", gone.alias("n_removed"), F.coalesce("kept_sha", "sha").alias("kept_sha256"))


def remove(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs with text less its repeated passages, words joined by one space where any went. A text that
    loses nothing stays as it is."""
    base, changed = _find(docs, width)
    new = base.filter(F.col("n_words") >= width).join(changed.filter("copied OR n_removed > 0"), ["k1", "k2"])
    new = stored(new.groupBy(F.col("doc_id").alias("_d"), F.col("text_key").alias("_k")).agg(F.first("kept").alias("_kept")), "new")
    rows = as_row(docs, _doc=F.col("doc_id"), _key=text_key())
    out = rows.join(maybe_broadcast(new), F.col("_doc").eqNullSafe(F.col("_d")) & (F.col("_key") == F.col("_k")), "left")
    return unfolded(out.select(F.col("_row").withField("text", F.coalesce("_kept", "_row.text")).alias("_row")))
