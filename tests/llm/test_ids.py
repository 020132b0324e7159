"""Documents whose doc_id is null or repeated, each with a text of its own."""

import hashlib
import random
from collections import Counter

from tabloom.llm import decontaminate, substring_dedup

ITEMS = [(1, "one two three four five six seven eight"), (2, "red green blue")]
#: Null-id halves of an item, whose words would make it whole if laid over each other.
DOCS = [
    (None, "one two three four x x x x"), (None, "y y y y five six seven eight"), (None, "clean text"), (None, "so red green blue it is"), (None, None),
    (7, "one two three four five six seven eight red green blue"), (7, "clean too"), (7, "red x x"), (7, "x green blue"), (8, "one two three four five six seven eight red green blue"),
]


def test_decontaminate_judges_each_text_alone(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(docs, items).collect()]
    want = [(None, 8, 0, 0, False), (None, 8, 0, 0, False), (None, 2, 0, 0, False), (None, 6, 3, 1, False), (None, 0, 0, 0, False), (7, 11, 11, 2, True), (7, 2, 0, 0, False), (7, 3, 0, 0, False), (7, 3, 0, 0, False), (8, 11, 11, 2, True)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    clean = decontaminate.keep_clean(docs, items)
    assert sorted(map(repr, map(tuple, clean.collect()))) == sorted(map(repr, DOCS[:3] + DOCS[4:5] + DOCS[6:9]))


def _say(n, seed):
    rng = random.Random(seed)
    return " ".join(f"v{rng.randrange(500)}" for _ in range(n))


def test_substring_dedup_cuts_each_text_alone(spark):
    """A passage in documents of null or shared doc_id, beside longer, shorter and repeated texts."""
    shared = _say(40, 1)
    docs = [
        (None, _say(50, 2) + " " + shared), (None, shared + " " + _say(30, 3)), (None, _say(60, 4)), (None, _say(3, 5)), (None, None), (None, _say(45, 6)), (None, _say(45, 6)),
        (7, _say(90, 7) + " " + shared), (7, _say(40, 8)), (7, _say(200, 9)), (8, shared), (8, shared), (9, _say(70, 10)),
    ]
    words = [(d, (t or "").encode().split()) for d, t in docs]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))

    def brute(w):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        return len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()

    got = substring_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((d, *brute(w))) for d, w in words)


def test_small_chunks_and_clashing_names(spark, monkeypatch):
    """Passages in many documents, chunks of a few windows, columns named as the operator's own."""
    monkeypatch.setattr(substring_dedup, "CHUNK", 50)
    monkeypatch.setattr(substring_dedup, "PROBES", 100)
    shared = [_say(45, 20), _say(36, 21)]
    rows = [(i if i % 4 else None, " ".join([_say(40 + i, 100 + i), shared[i % 2], _say(i, 200 + i), shared[0] if i % 5 == 0 else ""])) for i in range(40)]
    rows += [(90, rows[3][1]), (90, rows[3][1]), (None, rows[4][1]), (91, ""), (92, None)]
    df = spark.createDataFrame([(d, t, "a", "b", "c", "d") for d, t in rows], "doc_id long, text string, _kept string, _row string, _d string, _key string").repartition(4)
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))

    def left(w):
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        return len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)

    got = [tuple(r) for r in substring_dedup.digest(df).collect()]
    assert sorted(map(repr, got)) == sorted(repr((d, len(w), left(w)[0], hashlib.sha256(left(w)[1]).hexdigest())) for d, w in words)
    out = substring_dedup.remove(df)
    assert out.columns == df.columns
    want = [(d, t if not left(w)[0] else left(w)[1].decode()) for (d, t), (_, w) in zip(rows, words, strict=True)]
    assert sorted(repr((r.doc_id, r.text)) for r in out.collect()) == sorted(map(repr, want))
