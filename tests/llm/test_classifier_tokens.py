"""Scores against their definition, held-out quality on real labels, and token counts of every section."""

import base64
import os
import random

import numpy as np
import pytest

from tabloom.llm import classifier, tokens
from tabloom.llm.common import table
from tests.llm.test_documents_ops import _texts

SF = "/root/testdata/sf0.01"


def _score_by_definition(text, model):
    """The logistic of bias + sum over features of share x number, features counted one by one."""
    ids, share = classifier.features(text)
    return 1 / (1 + np.exp(-(model.bias + float((model.weight[ids].astype(float) * share).sum()))))


@pytest.mark.parametrize("words", [10, 1_000_000])
def test_scores_by_definition(spark, monkeypatch, words):
    monkeypatch.setattr(classifier, "BATCH_WORDS", words)
    rng = np.random.default_rng(3)
    model = classifier.Model(rng.normal(size=classifier.BUCKETS).astype(np.float32), 0.3)
    texts = [*_texts(), "a b c a b c a b c", "a b", "x " * 50, " wide　space"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(2)
    got = {r.doc_id: r for r in classifier.score(docs, model).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].score == pytest.approx(_score_by_definition(t, model), abs=1e-5)
        assert got[i].predicted == int(got[i].score >= classifier.THRESHOLD)


def test_repeats_of_many_texts_at_once():
    rng = random.Random(2)
    texts = [[rng.choice("abc") for _ in range(n)] for n in (0, 1, 2, 3, 40, 0, 7, 2, 100)]
    ids = np.array([ord(w) for t in texts for w in t], np.int32)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    assert classifier._repeats(ids, doc, len(texts)).tolist() == [classifier.again(t) for t in texts]
    assert classifier._repeats(ids[:0], doc[:0], 2).tolist() == [0, 0]


def test_a_label_on_many_rows_sends_one_text(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(classifier, "train", lambda samples: seen.append(len(samples)))
    rows = [(i % 2, f"text {i}") for i in range(3000)] + [(k, "once") for k in range(2, 30)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)], "doc_id long, quality int")
    classifier.fit(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), labels)
    held = sum(r.h for r in labels.select(classifier.held_out(labels.doc_id).cast("int").alias("h")).collect())
    assert seen == [30 - held]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_held_out_quality_of_real_labels(spark):
    labels = table(spark, SF, "labels").select("doc_id", "quality")
    out = classifier.classify(table(spark, SF, "documents"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    auc = (good[:, None] > bad[None, :]).mean() + (good[:, None] == bad[None, :]).mean() / 2
    assert len(out) > 50 and auc >= 0.95
    assert (out.predicted == out.quality).mean() >= 0.93


def _section_counts(text, rule, encoding):
    """Tokens of each line, one token after the other and byte by byte."""
    owner = []
    for k, line in enumerate(text.split("\n")):
        owner += [k] * len((line + "\n").encode())
    owner = owner[: len(text.encode())]
    out = [0.0] * len(text.split("\n"))
    at = 0
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        parts = owner[at : at + n]
        at += n
        if rule == "start":
            out[parts[0]] += 1
        elif rule == "split":
            for k in parts:
                out[k] += 1 / n
        else:
            out[min(set(parts), key=lambda k: (-parts.count(k), k))] += 1
    return out


@pytest.mark.parametrize("rule", tokens.RULES)
def test_every_sections_tokens(spark, rule):
    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [*_texts(), "a\n\n\n  b\n \n\n\nc  \n", "\n" * 20, "é\n é\n日本\n語", "tab\t\n\t\n end\n"]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, section string, start int").repartition(3)
    got = {}
    for r in tokens.count(docs, rule=rule).collect():
        got.setdefault(r.doc_id, {})[int(r.section)] = r.n_tokens
    for i, t in enumerate(texts):
        want = _section_counts(t or "", rule, encoding)
        assert len(got[i]) == len(want) and [got[i][k] for k in range(len(want))] == pytest.approx(want)
