"""Shards, WARC archives and the pipeline."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import sharding, warc
from tabloom.llm.common import scratch


@pytest.fixture
def store(spark):
    return sharding.ShardStore(spark, scratch(spark, "test"), target_bytes=1 << 16)


def _docs(spark, n, start=0):
    return spark.range(start, start + n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 5 > 0, F.repeat(F.md5(F.col("id").cast("string")), 20)).alias("text"), F.lit("x").alias("shard"))


def test_shards_round_trip(spark, store):
    docs = _docs(spark, 800)
    assert store.version() == 0
    assert store.append(docs, sharding.arrival_of(F.col("doc_id"), 6), small_rows=40) == 1
    assert len(store.runs()) == 6 and all(r.shards >= 3 for r in store.runs())
    assert store.compact() == 2
    (run,) = store.runs()
    assert run.rows == 800 and store.manifest().agg(F.sum("rows")).first()[0] == 800
    for v in (1, 2):
        assert store.read(v).exceptAll(docs).count() == 0 and store.read(v).count() == 800
    assert store.append(_docs(spark, 10, 1000)) == 3
    assert store.compact() == 3  # one small run beside a large one: nothing to merge
    assert store.vacuum() == 6
    assert store.read().count() == 810


def test_second_writer_loses(spark, store):
    docs = _docs(spark, 5)
    store.append(docs)
    with pytest.raises(sharding.CommitConflict):
        store._commit(1, [], None, docs.schema)
    assert store.version() == 1 and store.read().count() == 5


def test_vacuum_spares_what_is_being_written(spark, tmp_path, monkeypatch):
    """A vacuum between another writer's write and its commit; a store under a folder named data; versions kept."""
    root = f"{tmp_path}/data/store"
    ours, theirs = sharding.ShardStore(spark, root), sharding.ShardStore(spark, root)
    for start in (0, 100):
        ours.append(_docs(spark, 50, start), sharding.arrival_of(F.col("doc_id"), 2))
    commit, gone = theirs._commit, []

    def late(*a):
        if not gone:
            gone.append(ours.vacuum(keep=2))
            ours.append(_docs(spark, 5, 500))  # and another writer is first
        commit(*a)

    monkeypatch.setattr(theirs, "_commit", late)
    assert theirs.append(_docs(spark, 20, 300)) == 4 and gone == [0]
    assert ours.read().count() == 125 and ours.read(2).count() == 100
    ours.compact()
    assert ours.read().count() == 125
    assert ours.vacuum() > 0 and ours.read().count() == 125
    with pytest.raises(sharding.VersionError):
        ours.read(1)
    # a writer that died: its files go once its mark is stale
    monkeypatch.setattr(theirs, "_commit", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        theirs.append(_docs(spark, 5, 900))
    assert ours.vacuum() == 0 and ours.vacuum(stale=0) == 1
    (tmp_path / "data" / "store").rename(tmp_path / "moved")
    assert sharding.ShardStore(spark, f"{tmp_path}/moved").read().count() == 125


def test_empty_arrival(spark, store):
    docs = _docs(spark, 0)
    store.append(docs)
    assert store.read().count() == 0 and store.read().schema == docs.schema
    assert sharding.shard(docs).count() == 0


def test_shard_query(spark):
    docs = _docs(spark, 100).union(_docs(spark, 3))
    out = sharding.shard(docs).collect()
    assert sorted((r.doc_id, r.digest) for r in out) == sorted((r.doc_id, hashlib.md5((r.text or "").encode()).hexdigest()) for r in docs.collect())


def _pages(spark):
    big = "<p>" + "abc WARC/1.1\r\n\r\n" * 4000
    rows = [(5, "http://a/ b", "x" * 200), (2, "http://b", "x" * 200), (9, None, "x" * 200), (3, "u", "short"), (4, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", big), (1, "u", big + "é"), (None, "u", "y" * 150), (11, "u", "y" * 150), (12, "u", "z" * 300), (12, "u", "z" * 300)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("record_type", F.lit("clash")).repartition(3)


def test_warc_round_trip(spark):
    pages = _pages(spark)
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for p, b in rows:
        if p is not None:
            first[b] = min(p, first.get(b, p))
    want = []
    for p, b in rows:
        again = len(b) >= 100 and p != first.get(b)
        want.append((p, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None))
    assert sorted(map(repr, map(tuple, warc.round_trip(pages).collect()))) == sorted(map(repr, want))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_payloads_and_small_segments(spark):
    path = scratch(spark, "warc")
    pages = _pages(spark).filter("page_id IN (1, 3, 8)")
    warc.write(pages, path, segment=500, file_bytes=4000)
    got = {r.page_id: bytes(r.payload) for r in warc.read(spark, path, payloads=True).collect()}
    assert got == {r.page_id: r.html.encode() for r in pages.collect()}


def _sha1(data):
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_warc_of_another_writer(spark, tmp_path):
    """Compressed members, other record types, sha1 digests in base 32, ids of any kind, folded headers."""
    page, other = b"<html>" + b"real page " * 40 + b"</html>", b"{}"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"

    def record(kind, name, block, *more):
        head = [b"WARC/1.0", b"WARC-Type: " + kind, b"WARC-Record-ID: " + name, b"Content-Length: %d" % len(block), *more]
        return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"

    first, second = b"<urn:uuid:0b0a>", b"<http://archive/2>"
    framed = http.replace(b"\r\n\r\n", b"\r\nTransfer-Encoding: chunked\r\n\r\n") + warc.chunked(page, 100)
    parts = [record(b"response", b"<urn:s>", framed[:200], b"WARC-Segment-Number: 1", b"WARC-Payload-Digest: md5:" + hashlib.md5(page).hexdigest().encode())]
    parts += [record(b"continuation", b"<urn:s2>", framed[200:], b"WARC-Segment-Number: 2", b"WARC-Segment-Origin-ID: <urn:s>", b"WARC-Segment-Total-Length: %d" % len(framed))]
    gz = [
        record(b"warcinfo", b"<urn:i>", b"software: other\r\n"), record(b"request", b"<urn:r>", b"GET / HTTP/1.1\r\n\r\n"),
        record(b"response", first, http + page, b"WARC-Payload-Digest: " + _sha1(page).encode(), b"X-Folded: a", b"\tb"), record(b"metadata", b"<urn:m>", b"x: y"), *parts,
    ]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in gz))
    revisit = [b"WARC-Refers-To: " + first, b"WARC-Payload-Digest: " + _sha1(page).encode()]
    lost = b"sha256:" + hashlib.sha256(b"elsewhere").hexdigest().encode()
    plain = [record(b"revisit", second, http, *revisit), record(b"resource", b"<urn:o>", other), record(b"revisit", b"<urn:x>", http, b"WARC-Refers-To: <urn:gone>", b"WARC-Payload-Digest: " + lost)]
    (tmp_path / "a" / "two.warc").write_bytes(b"".join(plain))
    got = [(r.payload_bytes or 0, r.payload_digest, r.record_type, r.page_id, r.refers_to) for r in warc.read(spark, str(tmp_path / "a")).collect()]
    whole = (len(page), hashlib.sha256(page).hexdigest())
    want = [(0, lost[7:].decode(), "revisit", None, None), (2, hashlib.sha256(other).hexdigest(), "response", None, None), (*whole, "response", None, None), (*whole, "response", None, None), (*whole, "revisit", None, None)]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    wrong = record(b"response", b"<urn:w>", http + page, b"WARC-Payload-Digest: " + _sha1(b"not it").encode())
    with pytest.raises(ValueError, match="urn:w"):
        [warc.decode(*r) for r in warc.parse(wrong)]


def test_revisit_has_to_agree_with_its_response(spark, tmp_path):
    warc.write(spark.createDataFrame([(1, "u", "x" * 200), (2, "u", "x" * 200)], "page_id long, url string, html string").coalesce(1), f"{tmp_path}/a")
    (file,) = (tmp_path / "a").glob("*/part-*")
    digest = hashlib.sha256(b"x" * 200).hexdigest().encode()
    before, _, revisit = file.read_bytes().partition(b"WARC-Type: revisit")
    file.write_bytes(before + b"WARC-Type: revisit" + revisit.replace(digest, b"0" * 64))
    (file.parent / f".{file.name}.crc").unlink()
    with pytest.raises(Exception, match="another digest"):
        warc.read(spark, f"{tmp_path}/a").collect()


def test_warc_damage():
    good = [(1, None, b"ab"), (2, 3, b"c")]
    assert warc.join(good[::-1], "o") == b"abc"
    for bad in ([good[1]], [(1, None, b"ab"), (3, 3, b"c")], [(1, None, b"ab"), (2, 9, b"c")]):
        with pytest.raises(ValueError):
            warc.join(bad, "o")
    assert warc.unchunked(warc.chunked(b"hello" * 3000)) == b"hello" * 3000
    assert warc.unchunked(b"3;x=y\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.unchunked(b"4\r\nabc\r\n0\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"))


def test_pipeline(spark, tmp_path):
    import random

    import corpus_pipeline as pipeline

    rng = random.Random(2)
    say = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + f"{rng.randrange(50)}o" for _ in range(n))
    bench = say(30)
    clean = [say(80) for _ in range(30)]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(clean)] + [(100, clean[0], "s0"), (101, clean[1] + " tail", "s1"), (102, say(40) + " " + bench + " " + say(40), "s0"), (103, "few words", "s0"), (104, "*** " * 90, "s1"), (105, None, None)]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    at = docs
    seen = []
    for name, stage in pipeline.STAGES[:3]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns, name
        seen.append({r.doc_id for r in at.collect()})
    assert seen[0] == set(range(30)) | {100, 101, 102}
    assert seen[1] == set(range(30)) | {102}
    assert seen[2] == set(range(30))
    out = pipeline.run(spark, str(tmp_path)).collect()
    whole = {i: hashlib.md5(t.encode()).hexdigest() for i, t in enumerate(clean)}
    assert {r.doc_id for r in out} <= set(whole)
    assert sum(r.digest != whole[r.doc_id] for r in out) <= 2  # a document at each source's cut
