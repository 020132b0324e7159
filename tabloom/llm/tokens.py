"""Token counts by offset-mapped attribution.

A whole document is encoded once. Byte-level tokens have known byte lengths, so their running
sum gives each token's span; sections are spans of the same text that tile it. Both lists are
sorted, so the interval join is one binary search per boundary. A token that crosses boundaries
is allocated by rule:

- "largest" (default): to the section with most of its bytes, the earlier of equals;
- "start": to the section in which it starts;
- "split": to each section in proportion to its bytes (counts are then fractions).

A document's allocations add up to its tokens under each rule.

Defined results: null or empty text has one empty section without tokens; an empty section (no
characters) gets none; repeated rows are counted one by one. Extra columns are not read. The
vocabulary file is read on the driver and sent to the workers: its size does not depend on data.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Words with a leading space, digits, signs and white space: the pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("largest", "start", "split")


def lines(text: str) -> list[tuple[str, int, int]]:
    """Sections by line: name, first and last character; a line's break belongs to it."""
    out, at = [], 0
    for i, line in enumerate(text.split("\n")):
        out.append((str(i), at, at := min(at + len(line) + 1, len(text))))
    return out


def allocate(lengths: np.ndarray, bounds: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section. lengths: bytes of each token; bounds: bytes at which sections end."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    n, ends = len(bounds), np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(bounds, starts, side="right")  # the section that holds a token's first byte
    last = np.searchsorted(bounds, ends, side="left")
    out = np.bincount(first[(first == last) | (rule == "start")], minlength=n).astype(float)
    for t in np.flatnonzero(first != last) if rule != "start" else []:
        inside = np.arange(first[t], last[t] + 1)
        low = np.maximum(np.concatenate([[0], bounds])[inside], starts[t])
        share = np.minimum(bounds[inside], ends[t]) - low
        if rule == "split":
            out[inside] += share / lengths[t]
        else:
            out[inside[share.argmax()]] += 1
    return out


def _count(ranks_: bytes, sections: Callable[[str], list[tuple[str, int, int]]], rule: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_.splitlines())}
        encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            size[i] = len(token)
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, rows = b.slice(i, 500), ([], [], [], [], [])
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    found = sections(text)
                    raw = np.frombuffer(text.encode(), np.uint8)
                    at = np.concatenate([np.flatnonzero((raw & 0xC0) != 0x80), [len(raw)]])  # first byte of each character
                    tokens = np.asarray(encoding.encode_ordinary(text), np.int64)
                    counts = allocate(size[tokens], at[[s[2] for s in found]], rule)
                    for col, values in zip(rows, ([doc] * len(found), *zip(*found, strict=True), counts.tolist()), strict=True):
                        col.extend(values)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["doc_id", "section", "start", "end", "n_tokens"])

    return run


def count(docs: DataFrame, sections: Callable[[str], list[tuple[str, int, int]]] = lines, rule: str = "largest", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, section, start, end (characters), n_tokens: a row for each section of each document."""
    if rule not in RULES:
        raise ValueError(f"rule {rule!r} is none of {RULES}")
    with open(vocabulary, "rb") as f:
        ranks = f.read()
    out = docs.select("doc_id", "text").mapInArrow(_count(ranks, sections, rule), "doc_id long, section string, start long, end long, n_tokens double")
    return out if rule == "split" else out.withColumn("n_tokens", F.col("n_tokens").cast("long"))
