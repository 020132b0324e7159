"""Near-duplicates at the threshold, in groups larger than a block, and in awkward rows."""

import random

import numpy as np
import pytest

from tabloom.llm import near_dedup
from tests.llm.test_documents_ops import _components


def _pairs(n, seed=4):
    """Pairs of texts whose sets of 4-word shingles have a similarity of 0.80 to 0.85."""
    rng = random.Random(seed)
    out = []
    while len(out) < 2 * n:
        words = [f"p{len(out)}w{i}" for i in range(rng.randrange(60, 160))]
        other = list(words)
        for k in rng.sample(range(len(words)), rng.randrange(1, 6)):
            other[k] = f"x{rng.random()}"
        a, b = ({tuple(w[i : i + 4]) for i in range(len(w) - 3)} for w in (words, other))
        if 0.80 <= len(a & b) / len(a | b) <= 0.85:
            out += [" ".join(words), " ".join(other)]
    return list(enumerate(out))


@pytest.mark.parametrize("exact", [False, True])
def test_recall_at_the_threshold(spark, exact):
    rows = _pairs(150)
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80, exact).collect()}
    assert sum(got[2 * i] == got[2 * i + 1] for i in range(150)) >= (150 if exact else 149)


def test_exact_links_what_shares_no_band(spark, monkeypatch):
    """Without any band in common only the rarest shingles tell."""
    monkeypatch.setattr(near_dedup, "_banded", _lonely)
    rows = _pairs(20, 9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.kept for r in near_dedup.link(df, 4, 80).collect())
    assert [r.component_id for r in sorted(near_dedup.link(df, 4, 80, exact=True).collect())] == [i - i % 2 for i in range(40)]


def _lonely(batches):
    import pyarrow as pa

    for b in batches:
        yield pa.record_batch([b.column(0), b.column(1), b.column(0)], names=["v", "n", "band"])


def test_groups_larger_than_a_block(spark, monkeypatch):
    """Chains of texts that drift apart: most pairs of a bucket are not similar, and blocks are small."""
    for name, value in (("SPREAD", 5), ("BLOCK", 300), ("BLOCKS", 3), ("MOST", 700)):
        monkeypatch.setattr(near_dedup, name, value)
    words = [f"t{i}" for i in range(400)]
    rng = random.Random(1)
    rows = [(i, " ".join(words[k : k + 100] + [f"own{i}"] * (i % 7))) for i, k in enumerate(rng.randrange(40) for _ in range(150))]
    want = _components(rows, 4, 80)
    got = near_dedup.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 4, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: c for d, (_, c) in want.items()}


def test_band_keys_tell_bands_apart():
    r = np.arange(2 * near_dedup.REGISTERS, dtype=np.uint16).reshape(2, -1)
    keys = near_dedup.band_keys(r)
    assert keys.shape == (2, near_dedup.BANDS) and len(np.unique(keys)) == keys.size
    same = near_dedup.band_keys(np.zeros((2, near_dedup.REGISTERS), np.uint16))
    assert (same[0] == same[1]).all() and len(set(same[0].tolist())) == near_dedup.BANDS


AWKWARD = "doc_id long, text string, _row string, _doc string, _key string, text_key string, doc_id_ string"
COPY = "a copy without an id that stands there more than once"


def test_keep_one_keeps_one_of_each(spark):
    near = "word " * 3 + "this text is long enough to have some shingles of its own and one changed word at its end"
    texts = [
        (None, COPY), (None, COPY), (None, near + " x"), (5, near), (5, near), (5, "another text under the id of the first one"), (3, near + " y"),
        (8, None), (8, None), (None, ""), (9, "short"), (9, "Short"), (None, "short"), (2, COPY.upper()),
    ]
    docs = spark.createDataFrame([(*t, "a", "b", "c", "d", str(i)) for i, t in enumerate(texts)], AWKWARD).repartition(3)
    kept = near_dedup.keep_one(docs, 4)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr)
    # of "short" and "Short" under one id either text may stay: they are one set
    short = [t for d, t in got if d == 9]
    assert len(short) == 1 and short[0].lower() == "short"
    want = [(2, COPY.upper()), (3, near + " y"), (5, "another text under the id of the first one"), (8, None), (8, None), (None, ""), (9, short[0])]
    assert got == sorted(want, key=repr)
    assert near_dedup.keep_one(docs.limit(0), 4).count() == 0
