"""The pipeline's stages on awkward rows, each against brute force on its own input."""

import hashlib
import random
from collections import Counter

import corpus_pipeline as pipeline
from tabloom.llm import quality_rules
from tests.llm.test_documents_ops import WORD, _brute_hits, _components, _targets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars int, _row string, _key string, _metadata string, digest string, shard string, size string, `odd.name` int"


def _rows():
    rng = random.Random(8)
    say = lambda n: " ".join(f"{rng.choice('abcdefghijklm')}{rng.randrange(90)}on" for _ in range(n))
    leak = say(20)
    texts = [(i, say(70)) for i in range(40)]
    texts += [(100, texts[0][1]), (None, texts[1][1] + " more"), (None, say(80)), (None, say(60)), (7, say(90)), (7, texts[7][1]), texts[9], texts[9]]
    texts += [(200, say(40) + " " + leak + " " + say(20)), (201, say(60) + " so it goes"), (202, say(60) + " so it goes and goes on"), (203, say(60) + " goes on"), (None, leak + " " + say(60))]
    texts += [(300, None), (301, ""), (302, "few words"), (None, None), (303, "very " * 100), (304, say(9000))]
    twice = [(None, texts[42][1])]
    rows = [(d, t, "en", None if k % 7 == 0 else f"s{k % 3}", len(t or ""), "r", "k", "m", "d", "h", "z", k) for k, (d, t) in enumerate(texts + twice)]
    return rows, [(1, leak), (2, "so it goes"), (3, "goes on")]


def _told(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_on_awkward_rows(spark, tmp_path):
    rows, items = _rows()
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, at = dict(pipeline.STAGES), docs

    def step(name):
        out = stages[name](spark, at, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    judged = Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs).collect())
    at = step("quality_rules")
    assert at.columns == docs.columns and at.count() == sum(n for (_, kept), n in judged.items() if kept)
    assert not {300, 301, 302, 303} & {d for d, _ in _told(at)}

    # near-dedup: as if each text had an id of its own, those with an id first
    before = _told(at)
    distinct = sorted(set(before), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    comp = _components(list(enumerate(t for _, t in distinct)), 5, 80)
    groups = {}
    for i, row in enumerate(distinct):
        groups.setdefault(comp[i][1], []).append(row)
    at = step("near_dedup")
    after = _told(at)
    assert at.columns == docs.columns and len(after) == len(groups) and set(after) <= set(before)
    for members in groups.values():
        (kept,) = [m for m in members if m in after]
        ids = [d for d, _ in members if d is not None]
        assert kept[0] == (min(ids) if ids else None)

    # a whole window of one item, or two items of which none is that long
    def contaminated(text):
        n_items = _brute_hits([text], items)[2]
        return n_items >= 2 or _brute_hits([text], items[:1])[2] > 0

    want = [r for r in after if not contaminated(r[1])]
    at = step("decontamination")
    assert at.columns == docs.columns and _told(at) == want
    assert {201, 203} <= {d for d, _ in want} and not {200, 202} & {d for d, _ in want}

    sizes, inputs = Counter(), {(r.doc_id, r.text): r.source for r in at.collect()}
    for (_, t), source in inputs.items():
        sizes[source] += len(WORD.findall(t))
    at = step("mixing")
    mixed = at.collect()
    assert at.columns == docs.columns
    taken, whole = Counter(), {t for _, t in inputs}
    for r in mixed:
        taken[r.source] += len(WORD.findall(r.text))
        assert r.text in whole or any(t.startswith(r.text) for t in whole)
        assert r.n_chars == len(r.text) and r["odd.name"] is not None
    for source, target in _targets(sizes).items():
        assert abs(taken[source] - target) <= 1

    out = stages["sharding"](spark, at, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.digest, r.n_bytes) for r in out) == Counter((r.doc_id, hashlib.md5(r.text.encode()).hexdigest(), len(r.text.encode())) for r in mixed)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "an item")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
