"""Quality classifier by supervised subword embeddings.

A document is the average of learned vectors: of its words and of their character n-grams, all
hashed into one table, and of a marker for each 3-word sequence that the text has had before.
A softmax layer turns the average into class probabilities; vectors and layer are trained by
stochastic gradient descent in numpy, a document a step.

Training takes at most SAMPLE labelled documents, those with the smallest hash of their doc_id,
so the bound is a parameter and the choice doesn't depend on order or size. Features are made on
the executors; the driver gets the sample's features and trains. Scoring covers every whole text:
the layer is linear, so each hashed feature has one number, the numbers of a word are summed once
for all its occurrences in a batch of texts, and the score is the logistic of their mean.

The marker is an addition to the method: averaged words alone can't tell a text that says the same
again and again from one that doesn't. It stands for AGAIN features, about those of a word.

Defined results: null or empty text has no features and is scored by the bias alone; without
labels of both classes every score is the share of label 1 (0.5 without labels); labels that are
null, held out, or other than 0 and 1 are not learned; of several labels of a document the
smallest counts; a null doc_id is never held out nor learned. Only text is an input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.llm.hashing import finish

BUCKETS = 1 << 16
DIMENSION = 16
GRAMS = (3, 4)
SAMPLE = 3000
EPOCHS = 5
RATE = 1.0
SEED = 11
_STEP = 0x9E3779B97F4A7C15
THRESHOLD = 0.7
#: The marker's bucket, and the features that one marker stands for.
_AGAIN = BUCKETS - 1
AGAIN = 12
#: Words that are scored together, about.
BATCH_WORDS = 200_000


@dataclass(frozen=True)
class Model:
    """weight: for each bucket what one occurrence adds to the sum of log odds; bias: of no features."""

    weight: np.ndarray
    bias: float


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket, and number of its word, of every feature of the words: the word itself and its character
    n-grams, the word's ends marked. Hashes are polynomials of the characters, mixed."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), np.int64, len(marked))
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(marked)), size)
    place = np.arange(len(codes)) - first[word]
    powers = np.cumprod(np.full(max(size.max(initial=0), max(GRAMS)), _STEP, np.uint64))
    owners, hashes = [np.arange(len(marked))], [np.add.reduceat(codes * powers[place], first) if len(marked) else codes]
    for n in GRAMS:
        at = np.flatnonzero(place + n <= size[word])
        owners.append(word[at])
        hashes.append(sum((codes[at + j] * powers[j] for j in range(n)), np.full(len(at), n << 32, np.uint64)))
    return (finish(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners)


def again(words: list[str]) -> int:
    """3-word sequences that the text has had before."""
    return max(0, len(words) - 2) - len(set(zip(words, words[1:], words[2:], strict=False)))


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares of its features."""
    words = split(pa.array([text], pa.string()))[0]
    coded = words.dictionary_encode()
    times = np.bincount(coded.indices.to_numpy(zero_copy_only=False), minlength=len(coded.dictionary))
    buckets, owner = word_features(coded.dictionary.to_pylist())
    counts = np.bincount(buckets, weights=times[owner], minlength=BUCKETS)
    counts[_AGAIN] += again(words.to_pylist()) * AGAIN
    ids = np.flatnonzero(counts)
    return ids.astype(np.int32), (counts[ids] / max(counts.sum(), 1)).astype(np.float32)


def train(samples: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """samples: (label 0 or 1, buckets, shares)."""
    labels = {s[0] for s in samples}
    if labels != {0, 1}:
        p = float(np.clip(np.mean([s[0] for s in samples]) if samples else 0.5, 0.01, 0.99))
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(p / (1 - p))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1, 1, (BUCKETS, DIMENSION)).astype(np.float32)
    layer, bias = np.zeros((DIMENSION, 2), np.float32), np.zeros(2, np.float32)
    steps, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            label, ids, share = samples[i]
            now = rate * (1 - done / steps)
            done += 1
            mean = share @ vectors[ids]
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            error = p / p.sum()
            error[label] -= 1
            step = layer @ error
            layer -= now * np.outer(mean, error)
            bias -= now * 0.1 * error
            vectors[ids] -= (now * share)[:, None] * step
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, what stands between white space, and for each the number of its text."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words = lists.flatten()
    held = pc.not_equal(words, "")
    doc = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    return words.filter(held), doc[held.to_numpy(zero_copy_only=False)]


def _repeats(ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """again() of each text at once. ids: a number for each word, equal for equal words; doc: its text.
    Windows are sorted by text and a hash in the bits that the texts' numbers leave."""
    own = doc[2:] == doc[:-2]  # windows that lie in one text
    three = [part.astype(np.uint64)[own] for part in (ids[:-2], ids[1:-1], ids[2:])]
    bits = np.uint64(max(docs - 1, 1).bit_length())
    key = finish(three[0] << np.uint64(32) | three[1])
    key = finish(key + three[2] * np.uint64(0x9E3779B97F4A7C15)) >> bits
    key |= doc[2:].astype(np.uint64)[own] << (np.uint64(64) - bits)
    key.sort()
    same = key[1:][key[1:] == key[:-1]]
    return np.bincount((same >> (np.uint64(64) - bits)).astype(np.int64), minlength=docs)


def _sums(texts: pa.Array, numbers: np.ndarray) -> np.ndarray:
    """The mean of the numbers of each text's features, 0 without any."""
    words, doc = split(texts)
    coded = words.dictionary_encode()
    ids = coded.indices.to_numpy(zero_copy_only=False)
    buckets, owner = word_features(coded.dictionary.to_pylist())
    weight, size = (np.bincount(owner, weights=x, minlength=len(coded.dictionary)) for x in (numbers[buckets], None))
    total, n = (np.bincount(doc, weights=x[ids], minlength=len(texts)) for x in (weight, size))
    r = _repeats(ids, doc, len(texts)) * AGAIN
    return (total + r * numbers[_AGAIN]) / np.maximum(n + r, 1)


def _score(weight: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = weight.astype(np.float64)
        for b in batches:
            texts = b.column(2)
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
            cuts = np.searchsorted(sizes, np.arange(1, sizes[-1] // (6 * BATCH_WORDS) + 1) * 6 * BATCH_WORDS) if len(sizes) else []
            bounds = [0, *sorted({int(c) for c in cuts} - {0}), b.num_rows]
            out = []
            for low, high in zip(bounds, bounds[1:], strict=False):
                out.append(_sums(texts.slice(low, high - low), numbers))
            z = bias + np.concatenate(out)
            score = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])

    return run


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [features(t) for t in b.column(2).to_pylist()]
        yield pa.record_batch([b.column(0), b.column(1), pa.array([f[0].tobytes() for f in found], pa.binary()), pa.array([f[1].tobytes() for f in found], pa.binary())], names=["order", "label", "ids", "shares"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of the labels that are not held out."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    chosen = known.select(F.xxhash64("doc_id", F.lit(SEED)).alias("order"), "doc_id", "label").orderBy("order", "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # a doc_id may stand on any number of rows: one text each goes on, so the driver gets sample rows at most
    texts = texts.groupBy("order", "label", "doc_id").agg(F.min("text").alias("text")).select("order", "label", "text")
    rows = texts.mapInArrow(_featurise, "order long, label int, ids binary, shares binary").toPandas()
    rows = rows.sort_values(["order", "ids"])
    return train([(int(y), np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for y, i, s in zip(rows["label"], rows["ids"], rows["shares"], strict=True)])


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""
    read = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    out = read.mapInArrow(_score(model.weight, model.bias), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, fit(docs, labels))
