"""Operators on documents against brute force, over a table of awkward rows and random ones."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tabloom.llm import classifier, decontaminate, licenses, mixing, near_dedup, quality_rules, substring_dedup, tokens
from tabloom.llm.common import stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, taken string, component_id string"


def _texts() -> list[str | None]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Été", "naïve", "THE", "x*y", "ÀB"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    shared = say(60)
    base = say(120).split()
    near = []
    for k in range(12):
        words = list(base)
        for _ in range(k % 6):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(9)}"
        near.append(" ".join(words))
    return [
        None, "", " \t\n ", "one", "One one", "a b c", "a b c d", "A B C D", "\x1c odd space  x", "all rights reserved", "CC-BY and cc by, General Public License v3",
        "// SPDX-License-Identifier: MIT OR (Apache-2.0 AND GPL-2.0-only WITH Classpath-exception-2.0)\ncode", "SPDX-License-Identifier: MIT OR\nx", "!!! ###", "line\nline\n\nline\nother", "der " * 80,
        say(100), say(100) + " " + shared, shared + " " + say(10), say(40) + "\n" + shared, say(9000), *near, near[0], near[0], say(5) + " bench one two three four five six seven eight nine " + say(5), "😀 emoji " * 30,
    ]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", None, "clash", "clash", "clash") for i, t in enumerate(_texts())]
    rows += [rows[16], rows[16], (None, "no id here", None, None, None, None, None, None)]
    return stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "fixture")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def _match(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_quality_measures(docs, rows, empty):
    def brute(text):
        text = text or ""
        w = WORD.findall(text)
        tri = Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {i + d for i, k in enumerate(zip(w, w[1:], w[2:], strict=False)) if tri[k] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        failed = len(w) < 50 or 100 * len(inside) > 50 * len(w)
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside), failed

    out = quality_rules.judge(docs).collect()
    _match([(r.doc_id, *(r[m] for m in quality_rules.MEASURES[:5]), r.base_failed) for r in out], [(d, *brute(t)) for d, t in rows])
    assert all(not r.kept for r in out if r.base_failed)
    assert any(r.kept for r in out)
    assert quality_rules.judge(empty).count() == 0
    kept = quality_rules.keep_passing(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in out)


def test_ablation(docs):
    led = quality_rules.ledger(quality_rules.measure(docs))
    bits = [r.failure_bits for r in led.collect()]
    policy = quality_rules.STANDARD
    for r in quality_rules.ablate(led, [policy, quality_rules.BASE]).collect():
        p = policy if r.policy == policy.version else quality_rules.BASE
        rule = next(x for x in quality_rules.RULES if x.name == r.rule)
        assert (r.documents, r.kept, r.kept_without) == (len(bits), sum(not b & p.mask() for b in bits), sum(not b & p.mask() & ~(1 << rule.bit) for b in bits))


def test_stored_ledger(spark, docs, tmp_path):
    """Policies applied to a stored ledger decide as they do on the documents."""
    led = quality_rules.write_ledger(docs, str(tmp_path / "ledger"))
    for policy in (quality_rules.BASE, quality_rules.STANDARD):
        _match(quality_rules.apply(led, policy).collect(), quality_rules.judge(docs, policy).collect())


def _components(rows, width, threshold):
    sets = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        k = min(width, len(w))
        sets.setdefault(d, set()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k)
    up = {d: d for d in sets if d is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in up:
        for b in up:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
    return {d: (len(s), top(d) if d is not None else None) for d, s in sets.items()}


@pytest.mark.parametrize("width", [4, 5])
def test_near_dedup(docs, rows, empty, width):
    want = _components(rows, width, 80)
    out = near_dedup.link(docs, width, 80).collect()
    _match([(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in out], [(d, *want[d], d is None or want[d][1] == d) for d, _ in rows])
    assert near_dedup.link(empty, width).count() == 0
    kept = near_dedup.keep_one(docs, width)
    assert kept.columns == docs.columns
    # one row of each group, repeated rows and null ids included
    left = sorted(repr(r.doc_id) for r in kept.collect())
    assert left == sorted(repr(d) for d in {d for d, _ in rows if d is None or want[d][1] == d})


def test_near_dedup_strays_reach_their_group(spark):
    """A chain in which only neighbours are similar: no document is a hub for all."""
    words = [f"t{i}" for i in range(400)]
    chain = [(i, " ".join(words[i * 5 : i * 5 + 120])) for i in range(40)]
    df = spark.createDataFrame(chain, "doc_id long, text string")
    want = _components(chain, 4, 80)
    assert {r.doc_id: r.component_id for r in near_dedup.link(df, 4, 80).collect()} == {d: c for d, (_, c) in want.items()}


def test_similarity_estimate():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.5, 0.8, 0.95):
        pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        common = int(4000 * share)
        rest = (4000 - common) // 2
        u, v = np.unique(np.concatenate([pool[:common], pool[common : common + rest]])), np.unique(np.concatenate([pool[:common], pool[common + rest :]]))
        got = near_dedup.estimate(near_dedup.registers(u)[None], near_dedup.registers(v)[None], np.array([len(u)]), np.array([len(v)]))[0]
        assert abs(got - len(np.intersect1d(u, v)) / len(np.union1d(u, v))) < 0.12
    both = near_dedup.registers(np.unique(np.concatenate([u, v])))
    assert (both == np.maximum(near_dedup.registers(u), near_dedup.registers(v))).all()


def test_licenses(docs, rows, empty):
    def brute(text):
        w = ALNUM.findall((text or "").translate(LOWER))
        at, labels = [], set()
        for phrase, label in licenses.BASE.items():
            p = phrase.split()
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    at.append(i)
                    labels.add(label)
        return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))

    out = licenses.licenses(docs).collect()
    _match([(r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out], [(d, *brute(t)) for d, t in rows])
    by = {r.doc_id: r for r in out}
    assert by[11].labels == "apache-2.0,gpl-2.0-only,mit" and by[11].expressions == "mit apache-2.0 gpl-2.0-only classpath-exception-2.0 with and or" and by[11].permitted
    assert by[12].labels == "mit" and by[12].expressions == "mit"
    assert all(0 <= r.score <= 1 for r in out) and by[0].score == 0
    assert licenses.licenses(empty).count() == 0


def test_license_expressions():
    assert licenses.postfix("MIT OR Apache-2.0 AND BSD") == ["mit", "apache-2.0", "bsd", "and", "or"]
    assert licenses.postfix("(MIT OR A) AND B") == ["mit", "a", "or", "b", "and"]
    assert licenses.evaluate("GPL-2.0 WITH Classpath-exception-2.0 OR MIT", ["mit"])
    assert not licenses.evaluate("MIT AND GPL-3.0", ["mit"])
    for bad in ("", "MIT OR", "(MIT", "MIT)", "AND MIT", "MIT GPL", "()"):
        with pytest.raises(ValueError):
            licenses.postfix(bad)


@pytest.mark.parametrize("text,labels,permitted", [
    ("MIT and more words here", "mit", True), ("GPL-2.0 WITH Classpath-exception-2.0 #", "gpl-2.0", False), ("MIT.", "mit", True), ("(MIT OR GPL-3.0-only) AND", "gpl-3.0-only,mit", True),
    ("MIT AND GPL-3.0-or-later -->", "gpl-3.0-or-later,mit", False), ("see the file", "unparsed", None), ("", "unparsed", None), ("LicenseRef-own OR (isc", "licenseref-own", False), (") MIT", "unparsed", None),
])
def test_what_a_tag_is_followed_by(text, labels, permitted):
    found = licenses.scan(f"x\n// SPDX-License-Identifier: {text}\nAND more".encode())
    assert (found[5], found[8]) == (labels, permitted)


def test_versions_of_licences():
    say = lambda t: licenses.scan(t.encode())[5]
    assert say("under the Apache License, Version 2.0;") == "apache-2.0"
    assert say("GNU Lesser General Public License v2.1 or later") == "gpl,lgpl-2.1"
    assert len(licenses.PHRASES) > 100


def test_substring_dedup(docs, rows, empty):
    words = [(d, (t or "").encode().split()) for d, t in rows]
    seen = Counter(tuple(w[i : i + 35]) for _, w in words for i in range(len(w) - 34))

    def brute(w):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        return len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()

    _match([tuple(r) for r in substring_dedup.digest(docs).collect()], [(d, *brute(w)) for d, w in words])
    assert substring_dedup.digest(empty).count() == 0
    left = substring_dedup.remove(docs.filter("doc_id IS NOT NULL"))
    assert left.columns == docs.columns
    assert left.select(F.sum(F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda x: x != "")))).first()[0] == sum(brute(w)[0] - brute(w)[1] for d, w in words if d is not None)


def _brute_hits(texts, items, width=8):
    windows = {}
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - width + 1)) if w and item is not None else []:
            windows.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    hit, found, n = set(), set(), 0
    for k, t in enumerate(texts):
        w = ALNUM.findall((t or "").translate(LOWER))
        n = len(w)
        for i in range(len(w)):
            for size in {len(x) for x in windows}:
                if s := windows.get(tuple(w[i : i + size])) if i + size <= len(w) else None:
                    hit |= {(k, j) for j in range(i, i + size)}
                    found |= s
    return n, len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2


ITEMS = [(1, "bench one two three four five six seven eight nine"), (2, "One, two; THREE four five six seven eight"), (10, "a b c"), (3, None), (4, "..."), (None, "der der"), (5, "never there at all in any of the documents"), (1, "one")]


def test_decontaminate(spark, docs, rows, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.report(docs, items).collect()
    by = {d: [t for e, t in rows if e == d][:1] for d, _ in rows}
    _match([tuple(r) for r in out], [(d, *_brute_hits(by[d], ITEMS)) for d, _ in rows])
    assert decontaminate.report(empty, items).count() == 0
    none = decontaminate.report(docs, items.limit(0)).collect()
    assert {r.items_sha256 for r in none} == {hashlib.sha256(b"").hexdigest()}
    clean = decontaminate.keep_clean(docs, items)
    assert clean.columns == docs.columns and clean.count() == sum(r.n_items == 0 for r in out)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x four three y two one z"), (2, "one " + "gap " * 40 + "two three four")], "doc_id long, text string")
    windows = decontaminate.item_windows(spark.createDataFrame([(1, "one two three four")], "item_id long, text string"))
    postings = decontaminate.index(docs, windows.select(F.explode("terms").alias("term")))
    assert [r.doc for r in decontaminate.proximity(postings, windows).select("doc").distinct().collect()] == [1]


def _targets(sizes):
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, target = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    left, open_ = float(total), set(sizes)
    while left > 1e-9 and open_:
        w = sum(weights[s] for s in open_)
        share = {s: left * weights[s] / w for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= 3 * sizes[s]:
                left += target[s] - 3 * sizes[s]
                target[s] = 3.0 * sizes[s]
                open_.discard(s)
    return target


def test_mixing(docs, empty):
    size = {}
    for r in docs.collect():
        size[r.source] = size.get(r.source, 0) + len(WORD.findall(r.text or ""))
    target = _targets(size)
    out = mixing.mix(docs.withColumn("size", F.lit("other")))
    got = out.collect()
    assert [tuple(r) for r in sorted(got, key=repr)] == [tuple(r) for r in sorted(mixing.mix(docs.repartition(5)).collect(), key=repr)]
    assert len(got) == docs.count() and all(0 <= r.taken <= 3 * r["size"] for r in got)
    totals = {}
    for r in got:
        totals[round(r.target, 6)] = totals.get(round(r.target, 6), 0) + r.taken
    assert sorted(totals) == sorted({round(t, 6) for t in target.values()})
    assert all(abs(v - t * list(map(lambda x: round(x, 6), target.values())).count(t)) <= 4 for t, v in totals.items())
    assert mixing.mix(empty).count() == 0
    mixed = mixing.materialise(docs)
    assert mixed.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in mixed.collect())
    assert abs(words - sum(r.taken for r in got)) <= 8


def test_first_words(spark):
    df = spark.createDataFrame([(" a\tb  c\n",), ("a",)], "t string")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.lit(2))).collect()] == [" a\tb", "a"]


def test_tokens(docs, rows, empty):
    import base64

    import tiktoken

    with open(tokens.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    total = Counter()
    for d, t in rows:
        total[d] += len(enc.encode_ordinary(t or ""))
    for rule in tokens.RULES:
        got = Counter()
        for r in tokens.count(docs, rule=rule).collect():
            got[r.doc_id] += r.n_tokens
        assert all(abs(got[d] - total[d]) < 1e-6 for d in total)
    assert tokens.count(empty).count() == 0
    with pytest.raises(ValueError):
        tokens.count(docs, rule="none")
    sections = [r for r in tokens.count(docs).collect() if r.doc_id == 14]
    text = dict(rows)[14]
    assert [text[r.start : r.end] for r in sorted(sections, key=lambda r: int(r.section))] == ["line\n", "line\n", "\n", "line\n", "other"]


def test_allocation_rules():
    import numpy as np

    lengths, bounds = np.array([2, 3, 4]), np.array([4, 4, 9])  # token 1 spans bytes 2-5: two in section 0, one in section 2
    assert tokens.allocate(lengths, bounds, "largest").tolist() == [2, 0, 1]
    assert tokens.allocate(lengths, bounds, "start").tolist() == [2, 0, 1]
    assert tokens.allocate(lengths, bounds, "split").round(6).tolist() == [round(1 + 2 / 3, 6), 0, round(1 + 1 / 3, 6)]


def test_classifier(spark, docs, empty):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    data = [(i, " ".join(rng.choice(words) + ("***" if i % 5 == 0 else "") for _ in range(60))) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 != 0)) for i in range(400)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    out = {r.doc_id: r for r in classifier.classify(df, labels).collect()}
    held = [r for r in out.values() if r.held_out]
    assert 60 < len(held) < 140
    assert sum((r.doc_id % 5 != 0) == bool(r.predicted) for r in held) >= 0.95 * len(held)
    model = classifier.fit(df, labels)
    scored = classifier.score(docs, model).collect()
    assert len(scored) == docs.count() and all(0 <= r.score <= 1 for r in scored)
    assert classifier.score(empty, model).count() == 0
    one = classifier.classify(df, labels.filter("quality = 1"))
    assert one.select("score").distinct().count() == 1
    assert classifier.classify(df, labels.limit(0)).first().score == 0.5
