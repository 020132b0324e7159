"""Near matches against brute force, short items, clashing column names, and the joins of large benchmarks."""

import random
from collections import Counter

import pytest

from tabloom.llm import common, decontaminate
from tests.llm.test_documents_ops import ALNUM, LOWER, _brute_hits


def _words(text):
    return ALNUM.findall((text or "").translate(LOWER))


def _table(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(25)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60))) for _ in range(30)] + [None, "", "V1 v2, v3"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(n))) for i, n in enumerate([1, 2, 3, 5, 8, 9, 12])] + [(4, "v1 v1 v2"), (None, "v1"), (9, None), (10, "absent words")]
    return [(i if i % 9 else None, t) for i, t in enumerate(texts)], items


def _brute_near(docs, items, width=4, slack=2):
    texts = list(dict.fromkeys(docs))
    words = [_words(t) for _, t in texts]
    used = {w for _, t in items for w in _words(t)}
    df = Counter(w for ws in words for w in ws if w in used)
    out = Counter()
    places = set()
    for item, text in items:
        w = _words(text)
        if item is None or not w:
            continue
        for p in range(max(1, len(w) - width + 1)):
            window = w[p : p + width]
            rare = min(range(len(window)), key=lambda i: (df[window[i]], i))
            rest = {x for i, x in enumerate(window) if i != rare}
            for d, ws in enumerate(words):
                for at, x in enumerate(ws):
                    near = set(ws[max(0, at - len(window) - slack) : at + len(window) + slack + 1])
                    if x == window[rare] and rest <= near:
                        places.add((str(item), d, at))
    for item, d, _ in places:
        out[item, d] += 1
    return sorted(repr((item, texts[d][0], n)) for (item, d), n in out.items())


@pytest.mark.parametrize("rows", [None, 0])
def test_joins_agree(spark, rows, monkeypatch):
    """The same with broadcasts and, as for benchmarks too large for them, with salted shuffles."""
    if rows is not None:
        monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df: common.maybe_broadcast(df, rows))
    docs, items = _table()
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(repr((r.item_id, r.doc_id, r.n_places)) for r in decontaminate.near_matches(d, i, 4, 2).collect())
    assert got == _brute_near(docs, items) and len(got) > 20
    want = [(k, *_brute_hits([t], items, 4)) for k, t in docs]
    assert sorted(repr(tuple(r)) for r in decontaminate.report(d, i, 4).collect()) == sorted(map(repr, want))


@pytest.mark.parametrize("rows", [None, 0])
def test_repeated_rows_count_once(spark, rows, monkeypatch):
    """Rows repeated with their id and text change neither which term is rarest nor a count."""
    if rows is not None:
        monkeypatch.setattr(decontaminate, "maybe_broadcast", lambda df: common.maybe_broadcast(df, rows))
    docs, items = _table(5)
    docs += docs[:8] * 4 + docs[2:5] * 3
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(repr((r.item_id, r.doc_id, r.n_places)) for r in decontaminate.near_matches(d, i, 4, 2).collect())
    assert got == _brute_near(docs, items) and len(got) > 20


def test_near_matches_move_no_words(spark):
    """What is shuffled and stored follows the matches: here few words stand near each other, all are the benchmark's."""
    rng = random.Random(7)
    vocabulary = [f"v{i}" for i in range(400)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(500))) for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(20))) for i in range(60)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).cache(), spark.createDataFrame(items, "item_id long, text string").cache()
    assert d.count() == 400 and i.count() == 60
    sc = spark.sparkContext
    sc.setJobGroup("near", "near")
    decontaminate.near_matches(d, i).collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = {s for j in sc.statusTracker().getJobIdsForGroup("near") for s in sc.statusTracker().getJobInfo(j).stageIds}
    seen = [sc._jsc.sc().statusStore().lastStageAttempt(s) for s in stages]
    assert sum(s.shuffleWriteBytes() + s.outputBytes() for s in seen) < 200_000 * 4


def test_short_items_need_company(spark):
    names = "doc_id long, text string, _bad string, _bad_key string, _row string, key string, contaminated string"
    texts = ["so red green blue it is", "red green blue and one two", "one two only", "a b c d e f g h", "clean"]
    docs = spark.createDataFrame([(i, t, "1", "2", "3", "4", "5") for i, t in enumerate(texts)], names)
    items = spark.createDataFrame([(1, "red green blue"), (2, "one two"), (3, "a b c d e f g h")], "item_id long, text string")
    kept = lambda **how: sorted(r.doc_id for r in decontaminate.keep_clean(docs, items, **how).collect())
    assert kept() == [4] and kept(least_short=2) == [0, 2, 4]
    assert decontaminate.keep_clean(docs, items).columns == docs.columns
    assert decontaminate.near_matches(docs.limit(0), items).count() == 0
